"""Stupid-backoff scores of documents by a word n-gram model counted on the same corpus: count tables joined to exploded n-grams.

Texts become arrays of words in batches of some 260,000, one stored row a batch. An order's n-grams are exploded from them, each different
n-gram of a batch once with the times it occurs there, so that a batch's repeats are summed before any shuffle and the most frequent n-gram
stands there no more often than there are batches. They are dealt by ranges of their hash: a row has all n-grams of a batch that fall
into a range, and Spark groups the rows of a range. Each group makes its count table, which drops what is too rare, and joins it to its
n-grams. The counts go back to their batches, where every word takes its longest n-gram that is frequent enough, and a document's score is a
sum over its words.

An n-gram is known by 96 bits of hash where batches meet and by 64 bits inside a batch. A batch's n-grams stand in the order of their hashes, so
counts go back without the hash, as runs. A fixed share of the n-grams of an order, by hash, is counted and joined at a time, and a fixed
share of the batches is scored at a time, which bounds what is in a shuffle to that share of the corpus; ranges are as many as keep a
group small. Words, n-grams and counts are stored as bytes, which Spark passes on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import LOWER, NON_SPACE, discard, id_of, key_of, map_batches, materialise, mix, prefix_sums, sequence_hashes, span_hashes, text_chunks, word_spans

#: In how many shares the n-grams of an order are counted and joined; longer ones than these count as the last. In how many batches are scored.
SHARES, SCORED = {1: 1, 2: 2, 3: 3}, 4
#: Bits of a place in a batch, and so of a count in it, and the words of a batch; the rest of 63 bits numbers the batches.
BITS, WORDS = 18, (1 << 18) - 1
#: About how many exploded n-grams are in a range of hashes.
ROWS = 1 << 20

BATCH = "batch long, own long, ids binary, sizes binary, leads binary, vocabulary binary, words binary"
#: What of a batch goes to its scores, and the types of its arrays: a word is a number in the batch's sorted vocabulary of hashes.
KINDS = {"ids": np.int64, "sizes": np.int32, "leads": np.int32, "vocabulary": np.uint64, "words": np.int32}


def _bytes(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes of each values[offsets[i]:offsets[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _array(batch: pa.RecordBatch, name: str, i: int, kind) -> np.ndarray:
    """The array of row ``i``, from its bytes or a list."""
    value = batch.column(name)[i]
    return np.frombuffer(value.as_buffer(), kind) if pa.types.is_binary(value.type) else value.values.to_numpy(zero_copy_only=False).astype(kind)


def _joint(batch: pa.RecordBatch, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of all rows one after the other, and where each begins and ends; from their bytes."""
    column = batch.column(name).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _words(order: int, limit: int):
    """Batches of texts: ids, the words of each, how many of them only lead up to the first (it stands in the batch before), and a
    64-bit hash of each word. A text that is too long for a batch goes on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        texts: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            nonlocal texts, held, made
            ids, leads = (np.array([t[k] for t in texts], np.int64) for k in (0, 1))
            sizes = np.array([len(t[2]) for t in texts], np.int64)
            vocabulary, words = np.unique(np.concatenate([t[2] for t in texts]), return_inverse=True)
            arrays = [a.astype(kind) for a, kind in zip((ids, sizes, leads, vocabulary, words), KINDS.values(), strict=True)]
            columns = [pa.array([made << 32 | task]), pa.array([int((sizes - leads).sum())]), *(_bytes(a, np.array([0, len(a)])) for a in arrays)]
            texts, held, made = [], 0, made + 1
            return pa.record_batch(columns, names=["batch", "own", *KINDS])

        for keys, raw, starts in text_chunks(batches):
            low = LOWER[raw]
            begin, end = word_spans(low, starts, NON_SPACE)
            cuts = np.searchsorted(begin, starts)
            hashes = span_hashes(prefix_sums(low), begin, end)
            for key, a, b in zip(keys.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                lead = 0
                if held and held + b - a > limit or len(texts) >= limit:
                    yield batch()
                while b - a > limit:
                    texts.append((key, lead, hashes[a : a + limit]))
                    yield batch()
                    a, lead = a + limit - (order - 1), order - 1
                texts.append((key, lead, hashes[a:b]))
                held += b - a
        if texts:
            yield batch()

    return run


def _row(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """Of row ``i``: the words of each text, the words' hashes, the place of each in its text, and whether it is one of the batch's own."""
    sizes, leads = (_array(batch, name, i, np.int32).astype(np.int64) for name in ("sizes", "leads"))
    if "vocabulary" in batch.schema.names:
        words = _array(batch, "vocabulary", i, np.uint64)[_array(batch, "words", i, np.int32)]
    else:
        words = _array(batch, "words", i, np.int64).view(np.uint64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return sizes, words, place, place >= np.repeat(leads, sizes)


def _occurrences(words: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The place in the batch of the last word of every n-gram of ``k`` words, and the n-gram's hash."""
    last = np.flatnonzero(place >= k - 1)
    return last, sequence_hashes(words, k)[last - (k - 1)]


def _sorted(last: np.ndarray, found: np.ndarray, share: int, shares: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of a share in the order of their hashes: last words, hashes, and where a new n-gram begins."""
    if shares > 1:
        ours = np.flatnonzero(found % np.uint64(shares) == share)
        last, found = last[ours], found[ours]
    order = np.argsort(found)
    last, found = last[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    return last, found, new


def _grams(k: int, share: int, shares: int):
    """(gram, rest, at): 96 bits of hash of each different n-gram of a batch; its batch, its place there, and the times it occurs in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, words, place, own = _row(batch, i)
                last, found, new = _sorted(*_occurrences(words, place, k), share, shares)
                first = np.flatnonzero(new)
                n = np.add.reduceat(own[last].astype(np.int64), first) if len(first) else first
                rest = np.zeros(len(first), np.uint64)
                for j in range(k):
                    rest = mix(rest * np.uint64(0x9E3779B97F4A7C15) + words[last[first] - (k - 1) + j])
                at = (batch.column("number")[i].as_py() << 2 * BITS) + (np.arange(len(first)) << BITS) + n
                yield pa.record_batch([pa.array(found[first].view(np.int64)), pa.array((rest >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(at, pa.int64())], names=["gram", "rest", "at"])

    return run


GRAMS = "range int, number int, start int, grams binary, rests binary, times binary"


def _dealt(k: int, share: int, shares: int, ranges: int):
    """The n-grams of a batch by ranges of their hash: those from place ``start`` on, 96 bits of hash each and the times it occurs."""
    bounds = np.array([r * (1 << 64) // ranges for r in range(1, ranges)], np.uint64)
    explode = _grams(k, share, shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in explode(batches):
            if not rows.num_rows:
                continue
            gram, rest, at = (rows.column(c).to_numpy() for c in range(3))
            ends = np.concatenate([[0], np.searchsorted(gram.view(np.uint64), bounds), [len(gram)]])
            full = np.flatnonzero(np.diff(ends)).astype(np.int32)
            offsets = np.append(ends[full], len(gram))
            number = np.full(len(full), at[0] >> 2 * BITS, np.int32)
            columns = [pa.array(full), pa.array(number), pa.array(offsets[:-1].astype(np.int32)), _bytes(gram, offsets), _bytes(rest, offsets), _bytes((at & WORDS).astype(np.int32), offsets)]
            yield pa.record_batch(columns, names=["range", "number", "start", "grams", "rests", "times"])

    return run


COUNTS = "number int, part int, start int, width int, counts binary"


def _joined(part: int, least: int):
    """The count table of a range of n-grams, joined to them: for each run of a batch's n-grams how often these occur in all, 0 for too rare."""

    def run(rows: pa.Table) -> pa.Table:
        (batch,) = rows.combine_chunks().to_batches()
        (gram, offsets), (rest, _), (times, _) = (_joint(batch, c, kind) for c, kind in (("grams", np.uint64), ("rests", np.int32), ("times", np.int32)))
        order = np.argsort(gram)
        same = gram[order[1:]] == gram[order[:-1]]
        other = rest[order[1:]] != rest[order[:-1]]
        if (same & other).any():  # half of the hash is not enough
            order = np.lexsort((rest, gram))
            same = gram[order[1:]] == gram[order[:-1]]
            other = rest[order[1:]] != rest[order[:-1]]
        first = np.flatnonzero(np.concatenate([[True], ~same | other]))
        total = np.add.reduceat(times[order].astype(np.int64), first)
        total[total < least] = 0
        n = np.empty(len(gram), np.int64)
        n[order] = np.repeat(total, np.diff(np.append(first, len(gram))))
        n = n.astype(np.min_scalar_type(n.max()))
        part_of, width = (pa.array(np.full(batch.num_rows, x, np.int32)) for x in (part, n.itemsize))
        columns = [batch.column("number"), part_of, batch.column("start"), width, _bytes(n, offsets)]
        return pa.table(columns, names=["number", "part", "start", "width", "counts"])

    return run


def _parts(order: int) -> list[tuple[int, int, int]]:
    """(words, share, shares) of what is counted at a time."""
    shares = [(k, SHARES.get(k, max(SHARES.values()))) for k in range(1, order + 1)]
    return [(k, share, n) for k, n in shares for share in range(n)]


def _read(counts: pa.Table) -> dict[int, list[tuple[int, np.ndarray]]]:
    """The runs of a batch's counts (start, counts) by part."""
    runs: dict[int, list[tuple[int, np.ndarray]]] = {}
    for batch in counts.to_batches():
        parts, starts, widths = (batch.column(c).to_pylist() for c in ("part", "start", "width"))
        for i, (part, start, width) in enumerate(zip(parts, starts, widths, strict=True)):
            runs.setdefault(part, []).append((start, _array(batch, "counts", i, f"u{width}")))
    return runs


def _counted(runs: dict[int, list[tuple[int, np.ndarray]]], words: np.ndarray, place: np.ndarray, k: int, order: int) -> np.ndarray:
    """How often the n-gram of ``k`` words that ends at each word occurs, 0 if there is none or it is too rare. Before the first word stands a 0."""
    last, found = _occurrences(words, place, k)
    at = np.zeros(len(words) + 1)
    for part, (size, share, shares) in enumerate(_parts(order)):
        if size == k:
            where, _, new = _sorted(last, found, share, shares)
            n = np.zeros(np.count_nonzero(new))
            for start, many in runs.get(part, ()):
                n[start : start + len(many)] = many
            at[where + 1] = n[np.cumsum(new) - 1]
    return at


def _scored(order: int, least: int, factor: float, tokens: float):
    """A batch's scores from its words and the counts of its n-grams, by their place; those that are too rare have none."""

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        ids, n_words, missed, total = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, float))
        runs = _read(counts)
        for batch in texts.to_batches():
            for i in range(batch.num_rows):
                sizes, words, place, own = _row(batch, i)
                before = np.zeros(len(words) + 1)  # of the next shorter n-gram, at the word before
                value, steps = np.zeros(len(words)), np.zeros(len(words), np.int64)
                for k in range(1, order + 1):
                    at = _counted(runs, words, place, k, order)
                    last = place >= k - 1
                    frequent = np.flatnonzero(last & (at[1:] >= (least if k > 1 else 1)))
                    steps[last] += 1
                    steps[frequent] = 0
                    value[frequent] = np.log(at[frequent + 1] / (before[frequent] if k > 1 else tokens))
                    before = at
                value += steps * log(factor)
                text = np.repeat(np.arange(len(sizes)), sizes)[own]
                ids.append(_array(batch, "ids", i, np.int64))
                n_words.append(np.bincount(text, minlength=len(sizes)))
                missed.append(np.bincount(text[steps[own] > 0], minlength=len(sizes)))
                total.append(np.bincount(text, value[own], len(sizes)))
        return pa.table([pa.array(np.concatenate(x)) for x in (ids, n_words, missed, total)], names=["id", "n_words", "n_backoff", "log_score"])

    return run


def _union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    return every


def score(docs: DataFrame, order: int = 3, least: int = 2, factor: float = 0.4, id_col: str = "doc_id", text_col: str = "text", batch_words: int = WORDS) -> DataFrame:
    """One row per id: id, n_words, n_backoff (words whose longest n-gram is too rare), log_score (sum of natural logs),
    mean_log_score (null without words).

    Words are runs of other than ASCII white space, lower-cased A-Z only. A word's score is ``c(n-gram) / c(context)`` for the
    longest n-gram that ends there, inside the text, and occurs ``least`` times in the corpus; each step to a shorter one costs
    ``factor``, down to the word's share of all words. Counts are over all documents, in 64 bits. Null and empty texts have no words
    and a log_score of 0; rows that share an id are scored together, as are rows without one; an empty table gives an empty
    result; other columns are ignored. ``batch_words``, more than ``order``, is how many words are exploded at a time.
    """
    if not order < batch_words <= WORDS:
        raise ValueError(f"batch_words must be more than the order and at most {WORDS}")
    rows = docs.select(key_of(id_col).alias("id"), F.col(text_col).alias("text"))
    words = materialise(rows.transform(map_batches, _words(order, batch_words), BATCH), "lm-words")
    # Batches are numbered task by task: where a task's numbers begin follows from one count a task.
    task = F.col("batch").bitwiseAND(0xFFFFFFFF)
    made = words.groupBy(task.cast("int").alias("task")).agg(F.count("*").alias("n"), F.sum("own").alias("own")).orderBy("task").collect()
    tokens, starts = float(sum(r.own for r in made)), np.cumsum([0, *(r.n for r in made)]).tolist()
    if starts[-1] >= 1 << 63 - 2 * BITS:
        raise ValueError("too many batches")
    begin = np.zeros(max((r.task for r in made), default=0) + 1, np.int64)
    for r, start in zip(made, starts, strict=False):
        begin[r.task] = start
    number = F.element_at(F.lit(begin.tolist()).cast("array<long>"), (task + 1).cast("int")) + F.shiftright("batch", 32)
    texts = words.select(number.cast("int").alias("number"), *KINDS)

    found = []
    for part, (k, share, shares) in enumerate(_parts(order)):
        grams = texts.drop("ids").transform(map_batches, _dealt(k, share, shares, max(1, ceil(tokens / shares / ROWS))), GRAMS)
        counts = grams.groupBy("range").applyInArrow(_joined(part, least if k > 1 else 1), COUNTS)
        found.append(materialise(counts, f"lm-counts-{k}"))
    every, sums = _union(found), []
    for share in range(SCORED):
        here = F.col("number") % SCORED == share
        scored = texts.where(here).groupBy("number").cogroup(every.where(here).groupBy("number")).applyInArrow(_scored(order, least, factor, tokens), "id long, n_words long, n_backoff long, log_score double")
        sums.append(materialise(scored, "lm-sums"))
    discard(words, *found)
    every = _union(sums)
    scores = every.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_backoff", "log_score")))
    mean = F.col("log_score") / F.nullif(F.col("n_words"), F.lit(0))
    return scores.select(id_of().alias(id_col), "n_words", "n_backoff", "log_score", mean.alias("mean_log_score"))


def brute_force(docs: list[tuple], order: int = 2, least: int = 2, factor: float = 0.4) -> list[tuple]:
    """The same by plain loops, for tests: (id, words, backed off, log score)."""
    import re
    from collections import Counter

    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))) for d, t in docs]
    counts = Counter(tuple(w[i : i + k]) for _, w in texts for k in range(1, order + 1) for i in range(len(w) - k + 1))
    tokens, out = sum(len(w) for _, w in texts), []
    for d, w in texts:
        total, missed = 0.0, 0
        for i in range(len(w)):
            longest = k = min(order, i + 1)
            while k > 1 and counts[tuple(w[i - k + 1 : i + 1])] < least:
                k -= 1
            below = counts[tuple(w[i - k + 1 : i])] if k > 1 else tokens
            total += log(counts[tuple(w[i - k + 1 : i + 1])] / below) + (longest - k) * log(factor)
            missed += k < longest
        out.append((d, len(w), missed, total))
    return out
