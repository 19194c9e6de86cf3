"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces that match a text form a lattice. A forward pass sums the weight of all paths to each place; a backward pass draws a
path, each edge in proportion to the weight that flows through it, from random numbers that follow from the row's key and the
place alone. White space is written as U+2581 and a piece never goes on past a run of it, so the lattice falls into units (a
run of spaces with the word after it) and the forward pass is done once for each distinct unit; the draws are still made for
every occurrence. A unit falls into segments at the places that no piece crosses: every path goes through them, so segments are
filtered and drawn independently, and a text without spaces takes as many steps as its longest segment. A character without a piece, and a literal U+2581, is spelt in byte pieces, so decoding gives every text back
exactly. Models with log probabilities (unigram) use them; BPE models carry merge ranks, which get Zipf weights -ln(rank + 1).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import CHUNK_BYTES, id_of, key_of, map_batches, mix

SPACE = "▁"
UNIT = re.compile(r" *[^ ]+| +")
#: Edges of the lattices that a task keeps at most, of some 20 bytes each, before it starts anew.
CACHE_EDGES = 2_000_000
#: Characters whose lattices are built at once, and units that are drawn at once; a longer unit makes a block of its own.
BLOCK_CHARS, BLOCK_UNITS = 50_000, 100_000
#: Slots of the trie's hash table are two to this power.
HASH_BITS = 20

SCHEMA = "id long, pieces array<int>, lossless boolean, decoded string"


class Lattices:
    """Piece lattices of distinct units, flattened for drawing. Node k is a place in a unit; its incoming edges are first[k] to
    first[k + 1] - 1, with cumulative probabilities to which k is added."""

    def __init__(self, vocabulary: list[tuple[str, float, bool]], unigram: bool, alpha: float):
        piece: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        self.bytes_of: list[bytes] = []
        for i, (p, score, is_byte) in enumerate(vocabulary):
            if is_byte:
                self.byte[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            else:
                self.bytes_of.append(p.replace(SPACE, " ").encode())
                if p and SPACE not in p.lstrip(SPACE):
                    piece[p] = (i, alpha * (score if unigram else -np.log(i + 1.0)))
        self.spelt: pa.Array | None = None
        self.fallback = min(w for _, w in piece.values()) - 2 * alpha
        # A trie: children are found by node * 2**21 + character in a sorted list.
        trie: dict[tuple[int, str], int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for p, value in piece.items():
            k = 0
            for c in p:
                k = trie.setdefault((k, c), len(trie) + 1)
            ends[k] = value
        keys = np.array([(k << 21) + ord(c) for k, c in trie], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(trie.values()), np.int64)[order]
        # The place of a key by its hash; a slot that more keys want is crowded, and the sorted list is searched.
        slot = self._slot(self.keys)
        self.slot, self.crowded = np.full(1 << HASH_BITS, -1, np.int32), np.bincount(slot, minlength=1 << HASH_BITS) > 1
        self.slot[slot] = np.arange(len(self.keys), dtype=np.int32)
        self.ends_piece, self.weight = np.full(len(trie) + 1, -1, np.int64), np.zeros(len(trie) + 1)
        for k, (i, w) in ends.items():
            self.ends_piece[k], self.weight[k] = i, w
        self.clear()

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HASH_BITS)).view(np.int64)

    def _find(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the trie, and the places of these."""
        slot = self._slot(want)
        at = self.slot[slot]
        hit = self.keys[at] == want
        other = np.flatnonzero(self.crowded[slot] & ~hit)
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.keys, want[other]), len(self.keys) - 1)
            hit[other] = self.keys[at[other]] == want[other]
        return hit, at

    def clear(self) -> None:
        self.unit: dict[str, int] = {}
        self.cum, self.back, self.what, self.first = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.segment, self.ends = np.zeros(1, np.int64), np.zeros(0, np.int64)  # of unit k: ends[segment[k] : segment[k + 1]], nodes

    def add(self, units: list[str]) -> None:
        """Adds the lattices of new units, block by block, so that working arrays stay small."""
        base, parts = len(self.first) - 1, [(self.cum, self.back, self.what, self.first, self.segment, self.ends)]
        edges, segments, block, size = self.first[-1], self.segment[-1], [], 0
        for i, unit in enumerate(units):
            block.append(unit)
            size += len(unit)
            if size >= BLOCK_CHARS or i + 1 == len(units):
                cum, back, what, count, many, ends = self._forward(block, base)
                parts.append((cum, back, what, edges + np.cumsum(count), segments + np.cumsum(many), ends))
                for u in block:
                    self.unit[u] = len(self.unit)
                base, edges, segments, block, size = base + len(count), edges + len(cum), segments + len(ends), [], 0
        self.cum, self.back, self.what, self.first, self.segment, self.ends = (np.concatenate(x) for x in zip(*parts, strict=True))

    def _forward(self, units: list[str], base: int):
        """Forward filtering of a block, place by place: its edges in order of nodes (cumulative probability plus node, source, piece),
        the edges of each node, the segments of each unit, and each segment's last node."""
        text = "".join(units)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        literal, code = code == ord(SPACE), np.where(code == 32, ord(SPACE), code)
        size = np.array([len(u) for u in units], np.int64)
        ends = np.repeat(np.cumsum(size), size)
        # Walk the trie from every character at once.
        start, node, length, found = np.arange(len(code)), np.zeros(len(code), np.int64), 0, []
        spelt = np.ones(len(code), bool)
        while len(start):
            at = start + length
            inside = at < ends[start]
            start, node, at = start[inside], node[inside], at[inside]
            want = (node << 21) + code[at]
            hit, pos = self._find(want)
            hit &= ~literal[at]
            start, node, length = start[hit], self.child[pos[hit]], length + 1
            whole = self.ends_piece[node] >= 0
            found.append((start[whole], start[whole] + length, self.ends_piece[node[whole]], self.weight[node[whole]]))
            if length == 1:
                spelt[start[whole]] = False
        alone = np.flatnonzero(spelt)
        found.append((alone, alone + 1, -1 - code[alone], np.full(len(alone), self.fallback)))
        a, b, what, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        # Segments start where no piece crosses; nodes: one before each segment's first character and one after each character.
        crossed = np.cumsum(np.bincount(a + 1, minlength=len(code) + 1) - np.bincount(b, minlength=len(code) + 1))[: len(code)] > 0
        head = np.flatnonzero(~crossed)
        segment = np.cumsum(~crossed) - 1
        rank = np.arange(len(code)) - head[segment]
        long = np.diff(np.append(head, len(code)))
        after = base + np.arange(len(code)) + segment + 1  # the node after a character
        source, target = after[a] - 1, after[b - 1]
        order = np.lexsort((target, rank[b - 1]))
        source, target, what, weight, step = source[order], target[order], what[order], weight[order], rank[b - 1][order]
        log, cum = np.zeros(len(code) + len(head)), np.zeros(len(order))
        cuts = np.searchsorted(step, np.arange(step[-1] + 2)) if len(step) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            t, x = target[lo:hi] - base, log[source[lo:hi] - base] + weight[lo:hi]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            many = np.diff(np.append(first, len(t)))
            top = np.maximum.reduceat(x, first)
            e = np.exp(x - np.repeat(top, many))
            total = np.add.reduceat(e, first)
            log[t[first]] = top + np.log(total)
            run = np.cumsum(e)
            cum[lo:hi] = (run - np.repeat(run[first] - e[first], many)) / np.repeat(total, many)
        order = np.argsort(target, kind="stable")
        count = np.bincount(target - base, minlength=len(code) + len(head))
        segments = np.bincount(np.repeat(np.arange(len(units)), size)[head], minlength=len(units))
        return target[order] + np.minimum(cum[order], 1.0), source[order].astype(np.int32), what[order].astype(np.int32), count, segments, base + np.cumsum(long + 1) - 1

    def sample(self, ids: np.ndarray, texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all texts in order, number of pieces of each)."""
        key = mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        drawn, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        block, doc, place = [], [], []
        for d, text in enumerate(texts):
            units, done = UNIT.findall(text), 0
            while done < len(units):
                many = min(len(units) - done, BLOCK_UNITS - len(block))
                block += units[done : done + many]
                doc.append(np.full(many, d))
                place.append(np.arange(done, done + many))
                done += many
                if len(block) == BLOCK_UNITS:
                    drawn.append(self._draw(key, block, np.concatenate(doc), np.concatenate(place), counts))
                    block, doc, place = [], [], []
        if block:
            drawn.append(self._draw(key, block, np.concatenate(doc), np.concatenate(place), counts))
        return np.concatenate(drawn), counts

    def _draw(self, key: np.ndarray, units: list[str], doc: np.ndarray, place: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Backward sampling of units, given the text and the place in it of each; adds to the pieces' counts of the texts."""
        if len(self.cum) > CACHE_EDGES:
            self.clear()
        fresh = [u for u in dict.fromkeys(units) if u not in self.unit]
        if fresh:
            self.add(fresh)
        which = np.fromiter(map(self.unit.__getitem__, units), np.int64, len(units))
        many = self.segment[which + 1] - self.segment[which]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ends = self.ends[np.repeat(self.segment[which], many) + inner]
        doc, place = np.repeat(doc, many), np.repeat(place, many)
        cum, back, what, first = self.cum, self.back, self.what, self.first
        state = mix(mix(key[doc] + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) + inner.astype(np.uint64))
        live, at, step = np.arange(len(ends)), ends, 1
        segment_of, drawn = [], []
        while len(live):
            salt = np.uint64(step * 0xC2B2AE3D27D4EB4F % 2**64)
            lo, hi = first[at], first[at + 1] - 1
            edge, open_ = lo.copy(), np.flatnonzero(lo < hi)
            u = (mix(state[live[open_]] + salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            want, a, b = at[open_] + u, lo[open_], hi[open_]
            for _ in range(int((b - a).max(initial=0)).bit_length()):  # a node has few edges, so they are searched in place of all
                half = (a + b) >> 1
                below = (cum[half] < want) & (a < b)
                a, b = np.where(below, half + 1, a), np.where(below, b, half)
            edge[open_] = a
            segment_of.append(live)
            drawn.append(what[edge])
            at = back[edge]
            more = first[at + 1] > first[at]
            live, at, step = live[more], at[more], step + 1
        segment_of, drawn = np.concatenate(segment_of[::-1]), np.concatenate(drawn[::-1])
        order = np.argsort(segment_of, kind="stable")
        segment_of, drawn = segment_of[order], drawn[order]
        plain = drawn >= 0
        if not plain.all():  # characters without a piece, as bytes
            spelt = {c: np.array([self.byte[b] for b in chr(-1 - c).encode()], np.int32) for c in np.unique(drawn[~plain]).tolist()}
            size = np.ones(len(drawn), np.int64)
            for c, v in spelt.items():
                size[drawn == c] = len(v)
            out = np.repeat(drawn, size)
            start = np.cumsum(size) - size
            for c, v in spelt.items():
                where = start[drawn == c]
                for k, b in enumerate(v):
                    out[where + k] = b
            segment_of, drawn = np.repeat(segment_of, size), out
        counts += np.bincount(doc[segment_of], minlength=len(counts))
        return drawn

    def decode(self, pieces: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, pieces.tolist()))

    def decode_all(self, pieces: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each run of ``counts`` pieces: the pieces' bytes are taken one after the other and cut where a text ends."""
        if self.spelt is None:
            self.spelt = pa.array(self.bytes_of, pa.large_binary())
        spelt = self.spelt.take(pa.array(pieces))
        begins = np.frombuffer(spelt.buffers()[1], np.int64)[spelt.offset : spelt.offset + len(pieces) + 1]
        offsets = begins[np.concatenate([[0], np.cumsum(counts)])].copy()
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), spelt.buffers()[2]])
        return joined.cast(pa.large_string())  # fails where it is not UTF-8


def load_vocabulary(model_file: str) -> tuple[list[tuple[str, float, bool]], bool]:
    """(piece, score, is a byte) of a SentencePiece model, and whether the scores are log probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.vocab_size()
    rows = [("" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i), sp.get_score(i), sp.is_byte(i)) for i in range(n)]
    ranks = [s for p, s, b in rows if p and not b and s > -1e6]
    return rows, not all(float(s).is_integer() for s in ranks)


def _encode(vocabulary, unigram: bool, alpha: float, seed: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary, unigram, alpha)
        for batch in batches:
            ids, texts, i = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).fill_null(""), 0
            whole = texts.to_pylist()
            while i < len(ids):
                size, j = 0, i
                while j < len(ids) and (j == i or size < CHUNK_BYTES):
                    size += len(whole[j])
                    j += 1
                pieces, counts = lattices.sample(ids[i:j], whole[i:j], seed)
                decoded = lattices.decode_all(pieces, counts)
                same = pc.equal(decoded, texts[i:j].cast(pa.large_string()))
                coded = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(pieces, pa.int32()))
                yield pa.record_batch([pa.array(ids[i:j], pa.int64()), coded, same, decoded.cast(pa.string()) if with_text else pa.nulls(j - i, pa.string())], names=["id", "pieces", "lossless", "decoded"])
                i = j

    return run


def sample_encode(docs: DataFrame, model_file: str, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id, pieces (ids of a sampled segmentation), lossless (they decode to the text), decoded (that text, if
    asked for).

    The model file is read by the driver and only its vocabulary is sent to the tasks. ``alpha`` sharpens (over 1) or flattens the
    weights. A row's segmentation depends on its id, ``seed`` and text alone, not on partitioning; rows with equal ids and
    texts get equal pieces. Null and empty texts have no pieces and decode to the empty text.
    """
    vocabulary, unigram = load_vocabulary(model_file)
    rows = docs.select(key_of(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.transform(map_batches, _encode(vocabulary, unigram, alpha, seed, with_text), SCHEMA).withColumn("id", id_of()).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(id, text) of piece ids. Null pieces decode to the empty text."""
    vocabulary, unigram = load_vocabulary(model_file)
    spelt = Lattices(vocabulary, unigram, 1.0).bytes_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(map(spelt.__getitem__, p or [])).decode("utf-8", "replace") for p in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(pieces_col).alias("pieces")).transform(map_batches, run, "id long, text string").withColumnRenamed("id", id_col)
