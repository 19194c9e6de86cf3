"""Substring deduplication by hashed units: sentences of a line, lines or paragraphs.

Texts are cut into units; a unit's normal form (white space collapsed, lower case A-Z) gives a 128-bit digest. Digests are
grouped over all documents and the earliest occurrence in the order of (document, place) stays. What is left of an occurrence
depends on its neighbours: a run of consecutive repeated units is removed if it has ``min_words`` words in all, so that a
passage goes whole, wherever in a line it stands, while a stock phrase among other text stays. Only digests and places are
shuffled; a frequent unit is counted before the shuffle, and the join that finds its occurrences can be split by Spark. Removed
units keep their offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import map_batches, materialise

#: What ends a unit; it belongs to the unit that it ends, so the units of a text make up the text.
ENDS = {"sentence": r"[.!?][ \t\r\x0b\x0c]+|\n", "line": r"\n", "paragraph": r"\n\n+"}
UNITS = "id long, twin long, place int, again boolean, a long, b long"
SCHEMA = "id long, n_units long, n_removed long, n_removed_chars long, spans array<struct<start:int,end:int>>, text string"
#: Units that a task sends on at once.
BLOCK = 50_000


def _cut(text, end: re.Pattern) -> list:
    out, at = [], 0
    for m in end.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def _scan(unit: str):
    end = re.compile(ENDS[unit].encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block():
            ab = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            many = lambda x: pa.array(x, pa.int64()).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            return pa.record_batch([many(ids), many(twins), pa.array(places, pa.int32()), pa.array(again), pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["id", "twin", "place", "again", "a", "b"])

        ids, twins, counts, places, again, digests = [], [], [], [], [], []
        for batch in batches:
            for i, twin, text in zip(*batch.columns, strict=True):
                seen: set[bytes] = set()
                before = len(places)
                for place, u in enumerate(_cut(text.as_py().encode(), end)):
                    if norm := b" ".join(u.lower().split()):
                        digest = blake2b(norm, digest_size=16).digest()
                        places.append(place)
                        again.append(digest in seen)
                        digests.append(digest)
                        seen.add(digest)
                ids.append(i.as_py())
                twins.append(twin.as_py())
                counts.append(len(places) - before)
                if len(places) >= BLOCK:
                    yield block()
                    for x in (ids, twins, counts, places, again, digests):
                        x.clear()
        if places:
            yield block()

    return run


def _remove(unit: str, min_words: int):
    end = re.compile(ENDS[unit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_removed_chars", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("text", pa.string())])
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                for i, text, repeated in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns), strict=True):
                    units = _cut(text, end)
                    gone = _long_runs(units, set(repeated or ()), min_words)
                    spans, kept, at = [], [], 0
                    for place, u in enumerate(units):
                        if place in gone:
                            spans.append({"start": at, "end": at + len(u)})
                        else:
                            kept.append(u)
                        at += len(u)
                    rows.append({"id": i, "n_units": len(units), "n_removed": len(spans), "n_removed_chars": sum(s["end"] - s["start"] for s in spans), "spans": spans, "text": "".join(kept)})
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return run


def _long_runs(units: list[str], repeated: set[int], min_words: int) -> set[int]:
    """The places of ``repeated`` that lie in a run with ``min_words`` words; blank units neither end a run nor belong to one."""
    gone: set[int] = set()
    if not repeated:
        return gone
    run, words = [], 0
    for place, u in enumerate(units):
        if place in repeated:
            run.append(place)
            words += len(u.encode().split())
        elif u.encode().strip():
            if words >= min_words:
                gone.update(run)
            run, words = [], 0
    return gone | set(run) if words >= min_words else gone


def remove_repeats(docs: DataFrame, unit: str = "sentence", min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_units, n_removed, n_removed_chars, spans (offsets of removed units in the original text, in
    code points), text (what is left).

    Every unit that is not blank is grouped, whatever its length, and repeats within a document count too; a run of repeated units
    of fewer than ``min_words`` words in all stays. Null texts count as empty and have no units. Ids are integers; rows that
    share an id count as one document and take nothing from each other, equal rows get equal results, and rows without an
    id keep everything. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("twin"), text.alias("text"))
    units = rows.transform(map_batches, _scan(unit), UNITS)
    first = units.groupBy("a", "b").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    first = materialise(first, "lines-repeated")
    later = units.join(first.hint("merge"), ["a", "b"]).where("again or id > first")
    repeated = later.groupBy("id", "twin").agg(F.collect_list("place").alias("repeated"))  # no more than the document's own units
    repeated = materialise(repeated, "lines-removed")
    # A merge join whatever the sizes: the texts are shuffled once by id, and the plan is the same for a small and a large corpus.
    joined = rows.join(repeated.hint("merge"), ["id", "twin"], "left").select("id", "text", "repeated")
    return joined.transform(map_batches, _remove(unit, min_words), SCHEMA).withColumnRenamed("id", id_col)


def brute_force(docs: list[tuple], unit: str = "sentence", min_words: int = 20) -> list[tuple]:
    """The same by plain loops, for tests: (id, n_units, n_removed, text). Ids are unique."""
    white = " \t\n\x0b\x0c\r"
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seen, out = set(), []
    for i, text in sorted(docs):
        units, at, text = [], 0, text or ""
        for k in range(len(text)):  # a unit ends after k
            c, after = text[k], text[k + 1 : k + 2]
            if unit == "line":
                ends = c == "\n"
            elif unit == "paragraph":
                ends = c == "\n" and after != "\n" and text[max(at, k - 1) : k] == "\n"
            else:
                blank = len(text[at : k + 1]) - len(text[at : k + 1].rstrip(white.replace("\n", "")))
                ends = c == "\n" or c in white and (after == "" or after not in white.replace("\n", "")) and blank < k + 1 - at and text[k - blank] in ".!?"
            if ends:
                units.append(text[at : k + 1])
                at = k + 1
        units += [text[at:]] if at < len(text) else []
        marks = []
        for u in units:
            norm = " ".join(w for w in re.split(f"[{white}]+", u.translate(fold)) if w)
            marks.append((u, len(norm.split(" ")) if norm else 0, norm in seen))
            seen |= {norm} - {""}
        kept, run = [], []
        for u, words, known in [*marks, (None, 1, False)]:
            if words and known:
                run.append((u, words))
            elif not words:
                run.append((u, 0))
            else:
                if sum(n for _, n in run) >= min_words:
                    run = [(x, 0) for x, n in run if not n]
                kept += [x for x, _ in run]
                run = []
                if u is not None:
                    kept.append(u)
        out.append((i, len(units), len(units) - len(kept), "".join(kept)))
    return out
