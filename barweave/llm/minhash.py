"""Near-duplicate detection by b-bit MinHash.

Each text's set of word shingles gives 128 minima. Bands of the full minima give the candidates; of each minimum only the low two
bits are kept, packed into four longs, and the similarity of a candidate pair is estimated from the equal two-bit fields by
``bit_count``, corrected for chance collisions (``p = J + (1 - J) / 4``). Pairs that pass are confirmed on the full sets.

Hot groups: rows with the same words in the same order, by SHA-256, are folded into one representative first. Shingles that only one
candidate has can be in no intersection, so with ``m`` the least number of other shingles of two sets, their similarity is at most ``m / (a + b - m)``; this bound is exact and drops most pairs of a crowd of edited copies. Every
bucket first compares its members with one pivot, the one with the smallest share of such private shingles; links are
confirmed and connected components taken. Members that are in one component then need no comparison with each other. Of
those in different ones, two that share a rare shingle are compared, and all others unless the bound, with rare shingles in
the place of private ones, or the estimate rules it out; so no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import LOWER, NON_SPACE, id_of, key_of, map_batches, materialise, mix, prefix_sums, sequence_hashes, span_hashes, text_chunks, word_spans
from barweave.llm.components import connected_components

#: A shingle is rare among the members left to compare if so many of them hold it at most.
RARE = 16
HASHES, BAND_ROWS = 128, 5
BANDS = HASHES // BAND_ROWS
#: Fixed odd multipliers and offsets of the 128 permutations of 32-bit values.
_SEED = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLIERS, OFFSETS = (_SEED[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEED[HASHES:] >> np.uint64(32)).astype(np.uint32)

SKETCH = "id long, n_shingles long, words binary, bands array<long>, sig array<long>"


def _shingle_sets(ids: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts of a chunk, text by text and sorted in each, and the counts."""
    low = LOWER[raw]
    begin, end = word_spans(low, starts, NON_SPACE)
    doc = np.searchsorted(starts, begin, side="right") - 1
    words = span_hashes(prefix_sums(low), begin, end)
    counts = np.bincount(doc, minlength=len(ids))
    runs = sequence_hashes(words, size)
    if len(runs):
        inside = doc[: len(runs)] == doc[size - 1 :]
        key_doc, key = doc[: len(runs)][inside], runs[inside]
    else:
        key_doc, key = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(counts)])
    for d in np.flatnonzero((counts > 0) & (counts < size)):  # too short: the whole sequence is one shingle
        key_doc, key = np.append(key_doc, d), np.append(key, sequence_hashes(words[first[d] : first[d + 1]], int(counts[d])))
    order = np.lexsort((key, key_doc))
    key_doc, key = key_doc[order], key[order]
    if len(key):
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (key_doc[1:] != key_doc[:-1])])
        key_doc, key = key_doc[fresh], key[fresh]
    return key, np.bincount(key_doc, minlength=len(ids))


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, starts in text_chunks(batches):
            key, counts = _shingle_sets(ids, raw, starts, size)
            some = np.flatnonzero(counts)
            at = np.concatenate([[0], np.cumsum(counts)])[:-1][some]
            minima = np.zeros((HASHES, len(some)), np.uint32)
            if len(some):
                folded = (key ^ (key >> np.uint64(32))).astype(np.uint32)
                for k in range(HASHES):
                    minima[k] = np.minimum.reduceat(folded * MULTIPLIERS[k] + OFFSETS[k], at)
            bands = np.zeros((len(some), BANDS), np.uint64)
            for b in range(BANDS):
                h = np.full(len(some), b + 1, np.uint64)
                for k in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
                    h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + minima[k])
                bands[:, b] = h
            sig = np.zeros((len(some), 4), np.uint64)
            for half in range(2):
                for bit in range(2):
                    for k in range(64):
                        sig[:, 2 * half + bit] |= ((minima[64 * half + k] >> np.uint32(bit)) & np.uint32(1)).astype(np.uint64) << np.uint64(k)
            sizes = np.zeros(len(ids), np.int64)
            sizes[some] = 1
            lists = lambda flat, width: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes * width)]), pa.int32()), pa.array(flat.reshape(-1).view(np.int64)))
            words = [hashlib.sha256(b" ".join(LOWER[raw[a:b]].tobytes().split())).digest() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(words, pa.binary()), lists(bands, BANDS), lists(sig, 4)], names=["id", "n_shingles", "words", "bands", "sig"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, starts in text_chunks(batches):
            key, counts = _shingle_sets(ids, raw, starts, size)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(key.view(np.int64)))], names=["id", "shingles"])

    return run


def _confirm(size: int, percent: int):
    """The pairs whose shingles, compared as words, are as similar as asked for."""

    def shingles(text: str) -> frozenset:
        w = text.encode().lower().split()
        k = min(size, len(w))
        return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if k else frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset] = {}  # the pivot of a crowd comes again and again
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                sets = []
                for text in (a.as_py(), b.as_py()):
                    if text not in known:
                        if len(known) >= 8:
                            known.pop(next(iter(known)))
                        known[text] = shingles(text)
                    else:
                        known[text] = known.pop(text)  # the last to go
                    sets.append(known[text])
                both = len(sets[0] & sets[1])
                good.append(both > 0 and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def estimate(a: str, b: str):
    """The similarity of two signatures, corrected for fields that agree by chance."""
    differ = lambda i: F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]).bitwiseOR(F.col(a)[i + 1].bitwiseXOR(F.col(b)[i + 1])))
    equal = (HASHES - differ(0) - differ(2)) / F.lit(float(HASHES))
    return (equal - 0.25) / 0.75


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.22) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept.

    Words are runs of other than ASCII white space, lower-cased A-Z only. A set holds the distinct shingles of
    ``shingle_words`` words; a text of fewer words is one shingle; without words (or null) the set is empty and linked with
    nothing. Two documents are linked if 100 * intersection >= ``percent`` * union on full sets. A pair is a candidate if one
    of 25 bands of 5 minima agrees (missed with a chance of 5e-7 at a similarity of 0.85, 5e-5 at 0.8) and its estimate is not
    ``slack`` (six standard deviations) below the threshold; candidates are compared by the words of their shingles. Ids are
    integers; rows that share an id are one node, linked by any of their texts, and rows without an id share one after all others. Other
    columns are ignored, whatever their names.
    """
    rows = docs.select(key_of(id_col).alias("id"), F.col(text_col).alias("text"))
    sketch = materialise(rows.transform(map_batches, _sketch(shingle_words), SKETCH), "minhash-sketch")
    classes = sketch.where("n_shingles > 0").groupBy("words").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    repeated = materialise(classes.where("copies > 1").select("words", "rep"), "minhash-classes")
    slim = sketch.select("id", "n_shingles", "words")
    member = materialise(slim.join(repeated, "words", "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("rep")), "minhash-members")

    tokens = sketch.join(member.where("id <> rep").select("id"), "id", "left_anti").where("n_shingles > 0")
    band = tokens.select(F.col("id").alias("rep"), "n_shingles", "sig", F.explode("bands").alias("band"))
    crowded = band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    open_rows = materialise(band.join(crowded, "band"), "minhash-buckets")
    wanted = materialise(open_rows.select(F.col("rep").alias("id")).distinct(), "minhash-wanted")
    texts = materialise(rows.join(wanted.hint("merge"), "id", "left_semi").select("id", F.coalesce("text", F.lit("")).alias("text")), "minhash-texts")
    sets = materialise(texts.transform(map_batches, _sets(shingle_words), "id long, shingles array<long>"), "minhash-sets")

    # How many of a candidate's shingles another candidate has too.
    single = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    private = single.groupBy("id").agg(F.count("*").alias("private"))
    open_rows = open_rows.join(private.withColumnRenamed("id", "rep"), "rep", "left").withColumn("shared", F.col("n_shingles") - F.coalesce("private", F.lit(0)))
    open_rows = open_rows.where(100 * F.col("shared") >= percent * F.col("n_shingles")).select("band", "rep", "sig", "n_shingles", "shared")
    open_rows = materialise(open_rows, "minhash-open")

    floor = percent / 100 - slack
    side = lambda rows, x: rows.select("band", F.col("rep").alias(x), F.col("label").alias(f"label_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("shared").alias(f"shared_{x}"))
    most = F.least("shared_a", "shared_b", "n_a", "n_b")
    possible = (100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)) & (estimate("sig_a", "sig_b") >= floor)
    links, label = None, None
    for turn in ("pivots", "rest"):
        if label is None:
            now = open_rows.withColumn("label", F.col("rep"))
        else:
            now = open_rows.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
            mixed = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
            now = materialise(now.join(mixed, "band", "left_semi"), "minhash-rest")
        if turn == "pivots":
            central = F.struct((-F.col("shared") / F.col("n_shingles")).alias("place"), "rep", "label", "sig", "n_shingles", "shared")
            pivot = now.groupBy("band").agg(F.min(central).alias("p"), F.count("*").alias("n")).where("n > 1").select("band", "p.*")
            pairs = side(now, "b").join(materialise(side(pivot, "a"), "minhash-pivots"), "band").where((F.col("label_a") != F.col("label_b")) & possible)
        else:
            apart = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))
            members = materialise(now.drop("band", "shared").distinct(), "minhash-members")
            grams = materialise(sets.join(members.select(F.col("rep").alias("id")), "id").select(F.col("id").alias("rep"), F.explode("shingles").alias("s")), "minhash-grams")
            rare = grams.groupBy("s").agg(F.count("*").alias("holders")).where(F.col("holders") <= RARE)
            rare = materialise(grams.join(materialise(rare, "minhash-rare"), "s"), "minhash-rare-grams")
            kept = now.join(rare.groupBy("rep").agg(F.count("*").alias("rare")), "rep", "left").withColumn("shared", F.col("n_shingles") - F.coalesce("rare", F.lit(0)))
            kept = materialise(kept.where(100 * F.col("shared") >= percent * F.col("n_shingles")), "minhash-kept")
            pairs = side(kept, "b").join(side(kept, "a"), "band").where(apart & possible).select("a", "b")
            held = rare.where("holders > 1").select("s", "rep").join(members, "rep").withColumns({"band": F.col("s"), "shared": F.col("n_shingles")})
            held = materialise(held, "minhash-held")
            pairs = pairs.unionByName(side(held, "b").join(side(held, "a"), "band").where(apart & possible).select("a", "b"))
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "minhash-pairs")
        if pairs.isEmpty():
            continue
        both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
        confirmed = materialise(both.select("a", "b", "text_a", "text_b").transform(map_batches, _confirm(shingle_words, percent), "a long, b long").distinct(), "minhash-links")
        if confirmed.isEmpty():
            continue
        links = confirmed if links is None else links.unionByName(confirmed)
        label = connected_components(links).withColumnsRenamed({"node": "rep", "component": "label"})
    joined = member if label is None else member.join(label, "rep", "left")
    component = F.col("rep") if label is None else F.coalesce("label", "rep")
    found = joined.select("id", "n_shingles", component.alias("component_id"))
    return found.select(id_of().alias(id_col), "n_shingles", id_of("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def brute_force(docs: list[tuple], shingle_words: int, percent: int) -> list[tuple]:
    """The same over all pairs, for tests: (id, n_shingles, component_id)."""
    import re

    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        k = min(shingle_words, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [(d, len(sets[d]), top(d)) for d in ids]
