"""Exact top-k search by inner product, by distributed histogram selection.

Vectors are stored once with integer components and a number each, in the order of their ids. A wave of queries, bounded in number, is
sent to all tasks; each scores its vectors against the whole wave, block by block, and counts scores in 256 bins for every query. The
counts are summed over all tasks, which tells the bin that holds each query's k-th score; the next round splits that bin, until few
enough vectors lie at or above its lower edge. Where too many share the k-th score, the same rounds go on over the vectors' numbers.
The last pass keeps what lies above, at most ``2 * k`` rows a query, and a window ranks those.

Scores are made anew in each pass and never stored; a task sends no bin that lies under its own k-th score, so at most ``k`` rows a
query leave it. A wave passes through the driver, the vectors do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import discard, id_of, key_of, map_batches, materialise, numbered

#: A round tells BITS bits of a score, in 2 ** BITS bins.
BITS = 8
#: Scores beyond it on either side count as it, so differences fit 64 bits.
MOST = 1 << 61
#: Queries and vectors of a block of scores.
BLOCK = (256, 4096)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of ``dim`` components; missing ones are zero."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(offsets)
    if len(size) and (size == dim).all():
        return values[offsets[0] : offsets[-1]].reshape(len(size), dim)
    there = np.arange(dim) < size[:, None]
    out = np.zeros((len(size), dim), np.int64)
    out[there] = values[(offsets[:-1, None] + np.arange(dim))[there]]
    return out


def _products(queries: np.ndarray, vectors: np.ndarray, bound: int) -> np.ndarray:
    """Exact inner products: in floats where ``bound`` on all partial sums lets them be exact, else in whole numbers of any size."""
    if bound < 1 << 24:
        return (queries.astype(np.float32) @ vectors.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return np.clip(queries.astype(object) @ vectors.astype(object).T, -MOST, MOST).astype(np.int64)


def _blocks(batch: pa.RecordBatch, wave: dict):
    """(first query, vectors' numbers, vectors' ids, scores, own): scores of some queries and some vectors; own marks a query's own row."""
    numbers, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    vectors = _matrix(batch.column(2), wave["vectors"].shape[1])
    for v in range(0, len(numbers), BLOCK[1]):
        for q in range(0, len(wave["numbers"]), BLOCK[0]):
            keys = wave["numbers"][q : q + BLOCK[0]]
            scores = _products(wave["vectors"][q : q + BLOCK[0]], vectors[v : v + BLOCK[1]], wave["bound"])
            yield q, numbers[v : v + BLOCK[1]], ids[v : v + BLOCK[1]], scores, keys[:, None] == numbers[None, v : v + BLOCK[1]]


def _counter(wave, state):
    """Counts of a task's vectors by query and bin: by score, from the highest bin down, or by number among those of one score, from the
    lowest up. Only bins that can hold the wanted place are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, s = wave.value, state.value
        bins = s["bins"]
        counts = np.zeros((len(w["numbers"]), bins), np.int64)
        for batch in batches:
            for q, numbers, _, scores, own in _blocks(batch, w):
                some = slice(q, q + len(scores))
                if s["tied"] is None:
                    place = (scores - s["low"][some, None]) >> s["shift"]
                    fits = (place >= 0) & (place < bins) & ~own
                    place = bins - 1 - place
                else:
                    place = (numbers[None, :] - s["low"][some, None]) >> s["shift"]
                    fits = (place >= 0) & (place < bins) & ~own & (scores == s["score"][some, None]) & s["tied"][some, None]
                row, col = np.nonzero(fits)
                counts[some] += np.bincount(row * bins + place[row, col], minlength=len(scores) * bins).reshape(-1, bins)
        before = np.cumsum(counts, axis=1) - counts
        q, b = np.nonzero((counts > 0) & (before < s["need"][:, None]))
        for i in range(0, len(q), 1 << 16):
            j = slice(i, i + (1 << 16))
            yield pa.record_batch([pa.array(q[j], pa.int32()), pa.array(b[j], pa.int32()), pa.array(counts[q[j], b[j]]), pa.array(s["need"][q[j]])], names=["query", "bin", "n", "need"])

    return run


def _keeper(wave, state):
    """The vectors that may be among a query's best: (query, query_id, number, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, s = wave.value, state.value
        for batch in batches:
            for q, numbers, ids, scores, own in _blocks(batch, w):
                some = slice(q, q + len(scores))
                edge = s["score"][some, None]
                row, col = np.nonzero(((scores > edge) | (scores == edge) & (numbers[None, :] < s["until"][some, None])) & ~own)
                if len(row):
                    columns = (pa.array(row + q, pa.int32()), pa.array(w["ids"][row + q]), pa.array(numbers[col]), pa.array(ids[col]), pa.array(scores[row, col]))
                    yield pa.record_batch(list(columns), names=["query", "query_id", "number", "id", "score"])

    return run


def _place(vectors: DataFrame, wave, low: np.ndarray, need: np.ndarray, left: int, shift: int, **more) -> list:
    """(query, bin, before, n) of the bin in which each query's wanted place lies."""
    context = vectors.sparkSession.sparkContext
    state = context.broadcast({"low": low, "need": need, "shift": shift, "bins": 1 << (left - shift), "tied": None} | more)
    rows = vectors.select("number", "id", "vector").transform(map_batches, _counter(wave, state), "query int, bin int, n long, need long")
    rows = rows.groupBy("query", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    upto = F.sum("n").over(Window.partitionBy("query").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("before", upto - F.col("n")).where("before < need and before + n >= need").select("query", "bin", "before", "n").collect()
    state.unpersist()
    return found


def _best(vectors: DataFrame, n_vectors: int, queries: DataFrame, k: int, largest: int) -> DataFrame:
    """The best of one wave of queries, at most ``2 * k`` for each."""
    spark = vectors.sparkSession
    rows = queries.orderBy("number").collect()
    dim = max((len(r.vector) for r in rows), default=0)
    matrix = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        matrix[i, : len(r.vector)] = r.vector
    bound = max((sum(abs(x) for x in r.vector) for r in rows), default=0) * largest
    wave = spark.sparkContext.broadcast({"numbers": np.array([r.number for r in rows], np.int64), "ids": np.array([r.id for r in rows], np.int64), "vectors": matrix, "bound": bound})
    reach, size = min(bound, MOST), len(rows)
    low, need, held = np.full(size, -reach, np.int64), np.full(size, k, np.int64), np.full(size, n_vectors, np.int64)
    until = np.full(size, n_vectors, np.int64)
    if n_vectors - 1 > k:
        left = (2 * reach + 1).bit_length()
        while left > 0 and (k - need + held).max() > 2 * k:
            shift = max(0, left - BITS)
            for r in _place(vectors, wave, low, need, left, shift):
                low[r.query] += ((1 << (left - shift)) - 1 - r.bin) << shift
                need[r.query] -= r.before
                held[r.query] = r.n
            left = shift
        tied = k - need + held > 2 * k
        first, left = np.zeros(size, np.int64), n_vectors.bit_length()
        while left > 0 and tied.any():
            shift = max(0, left - BITS)
            for r in _place(vectors, wave, first, need, left, shift, score=low, tied=tied):
                first[r.query] += r.bin << shift
                until[r.query] = first[r.query] + (1 << shift)
                need[r.query] -= r.before
                held[r.query] = r.n
            left, tied = shift, tied & (k - need + held > 2 * k)
    state = spark.sparkContext.broadcast({"score": low, "until": until})
    kept = vectors.select("number", "id", "vector").transform(map_batches, _keeper(wave, state), "query int, query_id long, number long, id long, score long")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "number"))
    found = materialise(kept.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "id", "score"), "topk-found")
    state.unpersist()
    wave.unpersist()
    return found


def search(rows: DataFrame, is_query, k: int = 20, scale: int = 64, wave: int = 32768, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, id, score) of the ``k`` rows with the highest integer inner product with each query, all if there are
    fewer; ties go to the smaller id. Queries are the rows for which the column ``is_query`` holds; every other row is a candidate.

    Components become ``floor(scale * x)`` in doubles, limited to 64 bits. Rows whose vector is null or holds a null, NaN or infinite
    component take no part. In vectors of unequal lengths what is missing counts as zero, so an empty vector scores 0 with all. Scores
    beyond 2**61 on either side count as that. Rows may share an id: each is a query and a candidate of its own, and the equal ids
    stand as often as there are rows; a missing id comes after all others and is never a query unless ``is_query`` says so. An empty
    table, or one without queries, gives an empty result; other columns are ignored. ``wave`` bounds the queries that the driver and
    every task hold at a time (some 200 MB of counts at 32,768); all queries are answered, whatever their number.
    """
    x = F.col(vector_col)
    whole = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    plain = rows.where(whole).select(key_of(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("long")).alias("vector"))
    # Rows of one id are spread over ranges by their components, equal rows by chance.
    vectors, n = numbered(plain, "topk-vectors", F.col("id"), F.xxhash64("vector"), F.rand(1))
    asked, n_asked = numbered(vectors.where("asks").select("number", "id", "vector"), "topk-queries", F.col("number"), name="turn")
    ends = vectors.agg(F.max(F.array_max("vector")), F.min(F.array_min("vector"))).first()
    largest = max(abs(x or 0) for x in ends)
    found = None
    for first in range(0, n_asked, wave):
        part = _best(vectors, n, asked.where(F.col("turn").between(first, first + wave - 1)), k, largest)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.where("false").select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    else:
        discard(vectors, asked)
    return found.select(id_of("query_id").alias("query_id"), "rank", id_of().alias(id_col), "score")


def brute_force(rows: list[tuple], asks, k: int = 20, scale: int = 64) -> list[tuple]:
    """The same by plain loops, for tests: (query id, rank, id, score)."""
    from math import floor, isfinite

    whole = [(i, [floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for p, (i, q) in enumerate(whole):
        if i is not None and asks(i):
            scored = sorted((-max(-MOST, min(MOST, sum(a * b for a, b in zip(q, v, strict=False)))), (j is None, j or 0)) for o, (j, v) in enumerate(whole) if o != p)
            out += [(i, r, None if missing else j, -s) for r, (s, (missing, j)) in enumerate(scored[:k], 1)]
    return out
