"""Importance resampling towards a target distribution by hashed n-gram features.

Texts are cut into overlapping chunks: a chunk ends between two words, carries the next ``n - 1`` words and owns the n-grams that start
before them, so every n-gram of a text is counted once, in whichever chunk owns its first word. Chunks are written once; long texts
then are many rows, which Spark reads in as many tasks as it likes. One pass over them counts features by bucket, summed over all
documents; a second adds up the gains of each chunk's features, and sums by document give its number of features and its weight.
Keyed Gumbel noise turns weights into scores, and the highest are drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import ALNUM, LOWER, discard, id_of, key_of, map_batches, materialise, numbered, text_chunks, word_spans

#: Bytes of text from which on a chunk ends at the next word.
CHUNK = 1 << 16


# ---------------------------------------------------------------- CRC-32 of joined words


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


TABLE = _crc_table()


def _zero_bytes(powers: int = 40) -> list[np.ndarray]:
    """For each k: what 2**k zero bytes make of a register, as four tables of 256, one for each of its bytes."""
    one = np.arange(256, dtype=np.uint32)
    step = np.stack([TABLE[one], *(one << np.uint32(8 * (b - 1)) for b in (1, 2, 3))])
    out = [step]
    for _ in range(powers - 1):
        out.append(_through(out[-1], out[-1]))
    return out


def _through(step: np.ndarray, x: np.ndarray) -> np.ndarray:
    return step[0][x & 255] ^ step[1][(x >> 8) & 255] ^ step[2][(x >> 16) & 255] ^ step[3][x >> 24]


STEPS = _zero_bytes()


def _shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Registers after ``size`` zero bytes."""
    crc, k = crc.copy(), 0
    while (left := size >> k).any():
        odd = (left & 1).astype(bool)
        crc[odd] = _through(STEPS[k], crc[odd])
        k += 1
    return crc


def _joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings in a row, from the CRC-32 of each and the size of the second."""
    return _shifted(first, size) ^ second


def _word_crcs(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    crc = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -64, side="left")  # words of over 64 bytes come first
    for i in order[:live]:
        crc[i] = zlib.crc32(low[begin[i] : end[i]].tobytes()) ^ 0xFFFFFFFF
    order = order[live:]
    for at in range(int(size[order[0]]) if len(order) else 0):
        order = order[: np.searchsorted(-size[order], -at, side="left")]
        crc[order] = TABLE[(crc[order] ^ low[begin[order] + at]) & 255] ^ (crc[order] >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def ngram_crcs(low: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, CRC-32 of the k words from each word on, joined by one space) for k from 1 to n, without regard to where texts end."""
    words = _word_crcs(low, begin, end)
    size = (end - begin).astype(np.int64)
    spaced = _joined(np.full(len(words), zlib.crc32(b" "), np.uint32), words, size)
    crc = words
    for k in range(1, n + 1):
        if k > 1:
            crc = _joined(crc[:-1], spaced[k - 1 :], size[k - 1 :] + 1)
        yield k, crc


# ---------------------------------------------------------------- chunks


def _placed(batch: pa.RecordBatch, column: int):
    """``text_chunks`` of one column, with the rows' places in the batch as ids."""
    text = batch.column(column)
    if pa.types.is_binary(text.type):
        text = text.cast(pa.large_binary()).view(pa.large_string())
    return text_chunks(iter([pa.record_batch([pa.array(np.arange(batch.num_rows), pa.int64()), text], names=["place", "text"])]))


def _cutter(n: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, id, own, chunk): own is the number of words that the chunk owns; words after them are carried."""
        for batch in batches:
            names = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for at, raw, starts in _placed(batch, 2):
                begin, end = word_spans(LOWER[raw], starts, ALNUM)
                first = np.searchsorted(begin, starts)
                rows, own, texts = [], [], []
                for i, row in enumerate(at):
                    a, last = first[i], first[i + 1]
                    while True:
                        short = a == last or starts[i + 1] - begin[a] <= limit
                        b = last if short else min(last, max(a + 1, int(np.searchsorted(begin, begin[a] + limit))))
                        rows.append(row)
                        own.append(b - a)
                        texts.append(raw[begin[a] : end[min(last, b + n - 1) - 1]].tobytes() if b > a else b"")
                        a = b
                        if a == last:
                            break
                        if len(texts) >= 256:
                            yield _chunk_rows(names, rows, own, texts)
                            rows, own, texts = [], [], []
                yield _chunk_rows(names, rows, own, texts)

    return run


def _chunk_rows(names: list, rows: list, own: list, texts: list) -> pa.RecordBatch:
    return pa.record_batch([*(pa.array(x[rows], pa.int64()) for x in names), pa.array(own, pa.int64()), pa.array(texts, pa.binary())], names=["row", "id", "own", "chunk"])


def chunks(docs: DataFrame, n: int = 3, limit: int = CHUNK) -> DataFrame:
    """(row, id, own, chunk) of (row, id, text): every text in chunks of about ``limit`` bytes, at least one, empty if it has no word."""
    return docs.select("row", "id", "text").transform(map_batches, _cutter(n, limit), "row long, id long, own long, chunk binary")


def _features(batches: Iterator[pa.RecordBatch], n: int, buckets: int):
    """(columns row, id and own of some chunks, for each feature its chunk among them, and its bucket)."""
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        for at, raw, starts in _placed(batch, 3):
            low = LOWER[raw]
            begin, end = word_spans(low, starts, ALNUM)
            first = np.searchsorted(begin, starts)
            chunk = np.searchsorted(starts, begin, side="right") - 1
            owned = np.arange(len(begin)) - first[chunk] < columns[2][at][chunk]
            found = []
            for k, crc in ngram_crcs(low, begin, end, n):
                m = len(crc)
                fits = owned[:m] & (np.arange(m) + k <= first[chunk[:m] + 1])
                found.append((chunk[:m][fits], (crc[fits] % np.uint32(buckets)).astype(np.int64)))
            yield [c[at] for c in columns], np.concatenate([c for c, _ in found]), np.concatenate([b for _, b in found])


def bucket_counts(cut: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all chunks, with a sum in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for _, _, found in _features(batches, n, buckets):
            counts += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(there, pa.int32()), pa.array(counts[there])], names=["bucket", "n"])

    return cut.transform(map_batches, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _weigher(gains, n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, id, n_words, n_features, weight) of each chunk."""
        for columns, chunk, found in _features(batches, n, buckets):
            total = np.concatenate([[0], np.cumsum(gains.value[found[np.argsort(chunk, kind="stable")]])])
            count = np.bincount(chunk, minlength=len(columns[0]))
            upto = np.cumsum(count)
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in (*columns, count)), pa.array(total[upto] - total[upto - count], pa.int64())], names=["row", "id", "n_words", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, n: int = 3, buckets: int = 10000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", limit: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score, rank (from 1; null if not drawn).

    Words are runs of letters, digits and non-ASCII characters, lower-cased A-Z only; features are all runs of 1 to ``n`` words of one
    text, hashed into ``buckets``. ``target`` (any table with ``text_col``) sets the distribution that is wanted. A bucket's gain is
    ``floor(1000 * ln)`` of its share of the target over its share of ``docs``, each count raised by one. Of the documents with
    ``least_words`` words, the ``percent`` percent with the highest scores are drawn, ties to the smaller id.

    Null and empty texts have no features and a weight of 0. Rows that share an id are documents of their own with the same noise; a
    missing id is written as nothing in the noise's key and ranks after equal scores. An empty ``docs`` gives an empty result, an empty
    target only evens the gains out; other columns are ignored.
    """
    # Rows get their numbers where they are read, and are written with them.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), key_of(id_col).alias("id"), F.col(text_col).alias("text"))
    cut = materialise(chunks(rows, n, limit), "resample-chunks")
    aim = chunks(target.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("id"), F.col(text_col).alias("text")), n, limit)
    # ``buckets`` counts each.
    have, want = ({r.bucket: r.n for r in bucket_counts(x, n, buckets).collect()} for x in (cut, aim))
    all_have, all_want = sum(have.values()) + buckets, sum(want.values()) + buckets
    gains = np.zeros(buckets, np.int64)
    for b, s in have.items():
        gains[b] = floor(1000 * log((want.get(b, 0) + 1) * all_have / ((s + 1) * all_want)))
    summed = cut.transform(map_batches, _weigher(docs.sparkSession.sparkContext.broadcast(gains), n, buckets), "row long, id long, n_words long, n_features long, weight long")
    summed = summed.groupBy("row", "id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_of().cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(summed.withColumn("score", F.col("weight") + noise), "resample-scores")
    discard(cut)
    may = scored.where(F.col("n_words") >= least_words)
    ranked, n_may = numbered(may, "resample-ranked", F.desc("score"), F.col("id"), F.col("n_features"), F.col("row"))
    drawn = F.when(F.col("number") < percent * n_may // 100, F.col("number") + 1)
    out = ranked.withColumn("rank", drawn).drop("number").unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(id_of().alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def brute_force(docs: list[tuple], target: list, percent: int = 5, least_words: int = 20, n: int = 3, buckets: int = 10000, seed: int = 42) -> list[tuple]:
    """The same by plain loops, for tests: (id, features, weight, score, rank)."""
    import hashlib
    import re
    from collections import Counter

    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    found = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    gain = {b: floor(1000 * log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for d, words, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, words, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))))
    may = sorted((i for i, r in enumerate(rows) if r[1] >= least_words), key=lambda i: (-rows[i][4], rows[i][0] is None, rows[i][0] or 0, rows[i][2]))
    drawn = {i: rank for rank, i in enumerate(may[: percent * len(may) // 100], 1)}
    return [(r[0], *r[2:], drawn.get(i)) for i, r in enumerate(rows)]
