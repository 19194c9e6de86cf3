"""Substring deduplication with a logarithmic family of sparse suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id, or before
in the same one. The suffixes that are indexed start at anchors: each window of ``length`` bytes belongs to the smallest hashed
32-gram in it, so equal windows have their anchor at the same place wherever they stand, and about one suffix in 32 is kept.

Documents come in batches by id. One pass over the table, whatever their number, finds the suffixes and stores them in a folder a
batch. A batch's suffixes are range-partitioned and sorted: by their first
eight bytes, then by a hash of their first 32 (head) and of all windows of the anchor (context), then by document. Neighbours with
equal head and context are long matches; the later ones are removed and the earliest stays in the array, which becomes a level of
the family. Levels of equal size are merged after each batch, and the rest at the end. A cascade of merges, the new batch included, is one
scan over all of them in suffix order that finds the matches between them; so a suffix moves a number of times that grows with the
logarithm of the number of batches.

In the last level, neighbours with equal heads but other contexts may have some windows in common; these windows are compared
one by one. At last the bytes of every match are fetched from the text that holds them first and compared with those to be removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barweave.llm.common import MISSING, all_span_hashes, discard, id_of, key_of, map_batches, materialise, mix, prefix_sums, span_hashes, text_chunks

GRAM = 32
#: Bytes of text in a batch, on average, and the least and largest number of batches; beyond it batches grow with the corpus.
BATCH, LEAST_BATCHES, MOST_BATCHES = 128 << 20, 4, 64
#: A suffix: its order, its document, the windows of its anchor (first << 32 | last). ``holder`` and ``holder_span`` are those of the
#: earliest suffix with the same bytes, null if it is this one; ``shared`` says that a neighbour has the same head.
SUFFIXES = "lead long, head long, context long, key long, span long, shared boolean, holder long, holder_span long"
NAMES = ["lead", "head", "context", "key", "span", "shared", "holder", "holder_span"]


def anchors(raw: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """The anchors of a chunk of texts. Each window of ``length`` bytes inside a text belongs to the smallest hashed ``gram`` in it, the
    leftmost of equals; an anchor has a run of such windows. Returns (text, anchor, first window, last window, gram hash, range
    hash); the range hash covers the bytes of all the anchor's windows and the anchor's place among them."""
    n, span = len(raw), length - gram + 1
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < length:
        return none
    if n > 1 << 23:  # places take 24 bits; a cut inside a text only splits an anchor's run of windows
        parts = []
        for a in range(0, n - length + 1, 1 << 22):
            b = min(n, a + (1 << 22) + length - 1)
            inner = starts[(starts > a) & (starts < b)]
            first = int(np.searchsorted(starts, a, side="right")) - 1
            text, *rest = anchors(raw[a:b], np.concatenate([[a], inner, [b]]) - a, length, gram)
            parts.append((text + first, *(x + a for x in rest[:3]), *rest[3:]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    sums = prefix_sums(raw)
    hashes = all_span_hashes(sums, gram)
    # Sliding minimum of (hash, place) over ``span`` places, by doubling.
    low = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = span - size
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    pick = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    whole = np.maximum(np.diff(starts) - (length - 1), 0)  # windows inside each text
    if not whole.any():
        return none
    text = np.repeat(np.arange(len(whole)), whole)
    window = np.arange(len(text)) + np.repeat(starts[:-1] - (np.cumsum(whole) - whole), whole)
    pick = pick[window]
    new = np.concatenate([[True], (pick[1:] != pick[:-1]) | (window[1:] != window[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    anchor, lo, hi = pick[first], window[first], window[last]
    ranges = span_hashes(sums, lo, hi + length)
    ranges = mix(ranges + (anchor - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return text[first], anchor, lo, hi, hashes[anchor], ranges


def _lead(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a long, in the order of bytes."""
    value = np.zeros(len(at), np.uint64)
    for k in range(8):
        value = value << np.uint64(8) | raw[at + k].astype(np.uint64)
    return (value ^ np.uint64(1 << 63)).view(np.int64)


def _rows(lead, head, context, key, span, shared, holder=None, holder_span=None) -> pa.RecordBatch:
    of = lambda x: pa.nulls(len(key), pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.record_batch([of(lead), of(head), of(context), of(key), of(span), pa.array(shared, pa.bool_()), of(holder), of(holder_span)], names=NAMES)


def _scan(length: int, cuts: np.ndarray):
    """The suffixes of rows (key, text) and the batch of each, which is the number of ``cuts`` below its key; what is a later one within
    an Arrow batch already comes with its holder."""

    def batched(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.append_column("batch", pa.array(np.searchsorted(cuts, rows.column("key").to_numpy()), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for keys, raw, starts in text_chunks([batch]):
                text, at, lo, hi, head, context = anchors(raw, starts, length, GRAM)
                span = (lo - starts[text]).astype(np.int64) << 32 | (hi - starts[text]).astype(np.int64)
                parts.append((_lead(raw, at), head.view(np.int64), context.view(np.int64), keys[text].astype(np.int64), span))
            if not parts:
                continue
            lead, head, context, key, span = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((span, key, context, head))
            lead, head, context, key, span = (x[order] for x in (lead, head, context, key, span))
            new, holder = _groups(head, context)
            yield batched(_rows(lead[new], head[new], context[new], key[new], span[new], np.zeros(new.sum(), bool)))
            later = ~new
            yield batched(_rows(None, None, None, key[later], span[later], np.zeros(later.sum(), bool), key[holder[later]], span[holder[later]]))

    return run


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: whether a row begins a group of equal keys, and the place of its group's first row."""
    n = len(keys[0])
    new = np.ones(n, bool)
    for k in keys:
        differs = k[1:] != k[:-1]
        new[1:] = differs if k is keys[0] else new[1:] | differs
    return new, np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the neighbours of a sorted partition (lead, head, context, key, span). The last suffix of a batch waits for the next."""
    waiting, before = None, False
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns[:5]]
        if not len(columns[0]):
            continue
        if waiting is not None:
            columns = [np.concatenate([w, c]) for w, c in zip(waiting, columns, strict=True)]
        lead, head, context, key, span = columns
        new, holder = _groups(head, context)
        later, first = ~new, np.flatnonzero(new)
        yield _rows(None, None, None, key[later], span[later], np.zeros(later.sum(), bool), key[holder[later]], span[holder[later]])
        same = head[first[1:]] == head[first[:-1]]
        shared = np.concatenate([[before], same]) | np.concatenate([same, [False]])
        done = first[:-1]
        yield _rows(lead[done], head[done], context[done], key[done], span[done], shared[:-1])
        waiting, before = [c[first[-1] :][:1] for c in columns], bool(shared[-1])
    if waiting is not None:
        yield _rows(*waiting, np.array([before]))


class SuffixFamily:
    """Levels of sorted suffix tables; batches are added in the order of their documents. A level that was just merged is a list of the
    tables that it will be made of. ``gone`` collects the matches (key, span, holder, holder_span) that were found."""

    def __init__(self):
        self.levels: list[tuple[int, list[DataFrame]]] = []
        self.gone: list[DataFrame] = []

    def _matches(self, suffixes: DataFrame) -> None:
        self.gone.append(materialise(suffixes.where("holder is not null").select("key", "span", "holder", "holder_span"), "suffix-gone"))

    def _sorted(self, suffixes: DataFrame) -> DataFrame:
        """The suffix array of what is left; its matches go to ``gone``."""
        rows = suffixes.where("holder is null").select("lead", "head", "context", "key", "span")
        # Equal heads have equal leads, so a head's suffixes are in one partition, and no more of each context than were scanned apart.
        rows = rows.repartitionByRange("lead", "head").sortWithinPartitions("lead", "head", "context", "key")
        array = materialise(rows.transform(map_batches, _neighbours, SUFFIXES), "suffix-level")
        self._matches(array)
        return array

    def _merge(self) -> None:
        (size, later), (other, first) = self.levels.pop(), self.levels.pop()
        self.levels.append((size + other, [*first, *later]))

    def _settle(self) -> list[DataFrame]:
        """Makes one table of the last level; returns those it was made of."""
        size, tables = self.levels.pop()
        rows = tables[0]
        for table in tables[1:]:
            rows = rows.unionByName(table)
        self.levels.append((size, [self._sorted(rows)]))
        return tables

    def add(self, scanned: DataFrame) -> None:
        """``scanned`` is read twice: it should be a stored table."""
        self._matches(scanned)
        self.levels.append((1, [scanned]))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            self._merge()
        discard(*self._settle()[:-1])

    def whole(self) -> DataFrame:
        """The one level that is left when all have been merged."""
        if len(self.levels) > 1:
            while len(self.levels) > 1:
                self._merge()
            discard(*self._settle())
        return self.levels[0][1][0]


def _windows(length: int):
    """(hash, key, place) of each window in the listed runs; columns key, text, runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            runs = batch.column(2)
            for keys, raw, starts in text_chunks([batch]):
                listed = runs.slice(done, len(keys))
                done += len(keys)
                flat = listed.flatten()
                lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                text = np.repeat(np.arange(len(keys)), np.diff(listed.offsets.to_numpy()))
                size = hi - lo + 1
                text = np.repeat(text, size)
                place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                begin = place + starts[text]
                found = span_hashes(prefix_sums(raw), begin, begin + length)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(keys[text], pa.int64()), pa.array(place, pa.int32())], names=["hash", "key", "place"])

    return run


PAIRS = "key long, holder long, runs array<struct<lo:int,hi:int,`from`:int>>"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, holder, runs) of matches (key, holder, lo, hi, from) that are sorted by key and holder; windows that follow each other and are
    as far from their holder's make one run. A pair that goes on in the next batch is there twice, with other runs."""
    for batch in batches:
        key, holder, lo, hi, at = (c.to_numpy().astype(np.int64) for c in batch.columns)
        if not len(key):
            continue
        order = np.lexsort((lo, at - lo, holder, key))
        key, holder, lo, hi, at = (x[order] for x in (key, holder, lo, hi, at))
        pair, far = np.ones(len(key), bool), np.ones(len(key), bool)
        pair[1:] = (key[1:] != key[:-1]) | (holder[1:] != holder[:-1])
        far[1:] = pair[1:] | (at[1:] - lo[1:] != at[:-1] - lo[:-1])
        group = np.cumsum(far)
        reach = np.maximum.accumulate((group << 32) + hi)
        first = np.flatnonzero(np.concatenate([[True], (group[1:] << 32) + lo[1:] > reach[:-1] + 1]))
        end = (reach - (group << 32))[np.append(first[1:], len(key)) - 1]
        runs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (lo[first], end, at[first])], names=["lo", "hi", "from"])
        begins = np.flatnonzero(pair[first])
        named = first[begins]
        yield pa.record_batch([pa.array(key[named]), pa.array(holder[named]), pa.ListArray.from_arrays(pa.array(np.append(begins, len(first)), pa.int32()), runs)], names=["key", "holder", "runs"])


PIECES = "array<struct<start:int,bytes:binary>>"


def _held(length: int):
    """(key, pieces): the bytes that a text must have where it is to lose them; columns text, key, runs (lo, hi, from) of its holder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(0).fill_null("").cast(pa.large_binary()), batch.column(2)
            start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = memoryview(texts.buffers()[2] or b"")
            flat = runs.flatten()
            lo, hi, at = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            row = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
            order = np.lexsort((lo, at - lo, row))
            row, lo, hi, at = row[order], lo[order], hi[order] + length, at[order]
            # Runs that touch and are as far from their holder's make one piece.
            group = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]) | (at[1:] - lo[1:] != at[:-1] - lo[:-1])])[: len(row)])
            reach = np.maximum.accumulate((group << 32) + hi)
            first = np.flatnonzero(np.concatenate([[True], (group[1:] << 32) + lo[1:] > reach[:-1]])[: len(row)])
            end = (reach - (group << 32))[np.append(first[1:], len(row)) - 1] if len(row) else hi
            begin = start[row[first]] + at[first]
            held = [bytes(raw[x:y]) for x, y in zip(begin.tolist(), (begin + end - lo[first]).tolist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(runs)))])
            pieces = pa.StructArray.from_arrays([pa.array(lo[first], pa.int32()), pa.array(held, pa.binary())], names=["start", "bytes"])
            yield pa.record_batch([batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces)], names=["key", "pieces"])

    return run


def _equal_runs(raw: np.ndarray, piece: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The runs of at least ``length`` equal bytes."""
    if np.array_equal(raw, piece):
        return [(0, len(piece))]
    edge = np.diff(np.concatenate([[0], (raw[: len(piece)] == piece[: len(raw)]).astype(np.int8), [0]]))
    return [(a, b) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if b - a >= length]


def _remove(length: int, with_text: bool):
    """Columns id, text, pieces (lists of what it shares with the texts that come first, or null)."""

    kind = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pieces = batch.column(1).fill_null("").cast(pa.large_binary()), batch.column(2)
            start = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
            data = texts.buffers()[2]
            every, flat = np.frombuffer(data if data is not None else b"", np.uint8), pieces.flatten()
            begins, held = flat.field(0).to_pylist(), flat.field(1).to_pylist()
            sizes, done = pc.fill_null(pc.list_value_length(pieces), 0).to_pylist(), 0
            n_bytes, n_removed, spans, digests, left = [], [], [], [], []
            for row, size in enumerate(sizes):
                raw, runs = every[start[row] : start[row + 1]], []
                for at, piece in zip(begins[done : done + size], held[done : done + size], strict=True):
                    piece = np.frombuffer(piece, np.uint8)
                    runs += [(at + a, at + b) for a, b in _equal_runs(raw[at : at + len(piece)], piece, length)]
                done += size
                gone: list[list[int]] = []
                for lo, hi in sorted(runs):
                    if gone and lo <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], hi)
                    else:
                        gone.append([lo, hi])
                kept, at = [], 0
                for lo, hi in gone:
                    kept.append(raw[at:lo])
                    at = hi
                kept.append(raw[at:])
                digest = hashlib.sha256()
                for part in kept:
                    digest.update(part)
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - sum(map(len, kept)))
                spans.append([{"start": lo, "end": hi} for lo, hi in gone])
                digests.append(digest.hexdigest())
                left.append(b"".join(kept) if with_text else None)
            columns = (batch.column(0), n_bytes, n_removed, spans, digests, left)
            yield pa.record_batch([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, kind, strict=True)], schema=kind)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): the key is the id, or a number in the order of ids and texts if an id comes more than once."""
    rows = docs.select(key_of(id_col).alias("id"), F.col(text_col).alias("text"))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows.select("id", F.col("id").alias("key"), "text")
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    return materialise(rows.select("id", F.monotonically_increasing_id().alias("key"), "text"), "suffix-keyed")


def remove_repeats(docs: DataFrame, length: int = 100, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (maximal removed runs, byte offsets in the UTF-8 text), kept_sha256, kept
    (the remaining bytes, if asked for).

    Null texts count as empty; texts under ``length`` bytes keep everything. Rows that share an id follow each other like documents,
    in a fixed order of their texts, and rows without an id come last. ``batches`` ranges of ids are indexed one after the other; by
    default their number follows from the size of the texts, up to 64. An empty table gives an empty result; other columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col)
    if batches is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        batches = min(MOST_BATCHES, max(LEAST_BATCHES, ceil(size / BATCH)))
    cuts = sorted(set(rows.approxQuantile("key", [k / batches for k in range(1, batches)], 0.1 / batches))) if batches > 1 else []
    scan = _scan(length, np.array([min(int(c), MISSING) for c in cuts], np.int64))
    suffixes = materialise(rows.select("key", "text").transform(map_batches, scan, f"{SUFFIXES}, batch int"), "suffix-batches", "batch")
    family = SuffixFamily()
    for batch in range(len(cuts) + 1):
        family.add(suffixes.where(F.col("batch") == batch).drop("batch"))
        discard(suffixes, part=f"batch={batch}")
    discard(suffixes)
    level = family.whole()

    lo, hi = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF).cast("int"))
    runs = level.where("shared").groupBy("key").agg(F.collect_list(F.struct(lo("span").alias("lo"), hi("span").alias("hi"))).alias("runs"))  # of one document
    edges = materialise(runs, "suffix-edges")
    discard(level)
    windows = rows.join(edges.hint("merge"), "key").select("key", "text", "runs").transform(map_batches, _windows(length), "hash long, key long, place int")
    first, here = F.min(F.struct("key", "place")).over(Window.partitionBy("hash")), F.struct("key", "place")
    later = windows.withColumn("first", first).where(here > F.col("first")).select("key", F.col("place").alias("lo"), F.col("place").alias("hi"), F.col("first.key").alias("holder"), F.col("first.place").alias("from"))
    found = materialise(later, "suffix-gone")
    family.gone.append(found)
    for part in family.gone[:-1]:
        found = found.unionByName(part.select("key", lo("span").alias("lo"), hi("span").alias("hi"), "holder", lo("holder_span").alias("from")))
    matches = found.select("key", "holder", "lo", "hi", "from").repartition("key", "holder").sortWithinPartitions("key", "holder")
    pairs = materialise(matches.transform(map_batches, _pairs, PAIRS), "suffix-pairs")
    discard(edges, *family.gone)
    # Merge joins whatever the sizes: the plan is the same for a small and a large corpus.
    held = rows.select(F.col("key").alias("holder"), "text").join(pairs.hint("merge"), "holder").select("text", "key", "runs").transform(map_batches, _held(length), f"key long, pieces {PIECES}")
    pieces = materialise(held.groupBy("key").agg(F.flatten(F.collect_list("pieces")).alias("pieces")), "suffix-pieces")  # no more than the document and its matches
    discard(pairs)
    out = rows.join(pieces.hint("merge"), "key", "left").select("id", "text", "pieces").transform(map_batches, _remove(length, with_text), "id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string, kept binary")
    return out.withColumn("id", id_of()).withColumnRenamed("id", id_col)


def brute_force(docs: list[tuple], length: int) -> list[tuple]:
    """The same by a set of all windows, for tests: (id, bytes, removed, spans, digest of what is left)."""
    seen, out = set(), []
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
