"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams, scanned over every window of every text.

Texts are lower-cased (A-Z only) and cut into words of digits, letters a-z and all non-ASCII characters. A benchmark item gives
its windows of ``n`` consecutive words; an item of fewer words, but not none, is one window. A window that matches by hash is
then compared by its words. Null and empty texts have no words; items without words match nothing; equal windows of several
items count for each of them. A benchmark too large for a broadcast is joined with the texts' windows instead, by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import ALNUM, LOWER, id_of, key_of, map_batches, materialise, prefix_sums, sequence_hashes, span_hashes, text_chunks, word_spans

#: Bytes of benchmark text up to which its windows are broadcast; they take some 50 times as much memory.
BROADCAST_BYTES = 4 << 20

MATCHES = "array<struct<place:int,words:int,item:string>>"
SCHEMA = "id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<begin:int,end:int>>"


def _item_windows(items: list[tuple], n: int) -> dict[int, tuple[np.ndarray, list]]:
    """For each window length: the sorted distinct hashes, and for each hash its windows (words) with the items they come from."""
    found: dict[int, dict[int, dict[tuple, set]]] = {}
    for item, text in items:
        low = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        begin, end = word_spans(low, np.array([0, len(low)]), ALNUM)
        if not len(begin):
            continue
        k, raw = min(n, len(begin)), low.tobytes()
        words = [raw[b:e] for b, e in zip(begin, end, strict=True)]
        for i, h in enumerate(sequence_hashes(span_hashes(prefix_sums(low), begin, end), k).tolist()):
            found.setdefault(k, {}).setdefault(h, {}).setdefault(tuple(words[i : i + k]), set()).add(str(item))
    out = {}
    for k, by in found.items():
        keys = np.array(sorted(by), np.uint64)
        out[k] = (keys, [by[h] for h in keys.tolist()])
    return out


def _scan(sent: Broadcast, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        tables = {k: np.zeros(1 << 16, bool) for k in windows}  # a first, cheap test of 16 bits
        for k, (keys, _) in windows.items():
            tables[k][(keys >> np.uint64(48)).astype(np.int64)] = True
        for ids, raw, starts in text_chunks(batches):
            low = LOWER[raw]
            begin, end = word_spans(low, starts, ALNUM)
            doc = np.searchsorted(starts, begin, side="right") - 1
            hashes = span_hashes(prefix_sums(low), begin, end)
            hit, items = np.zeros(len(begin) + 1, np.int64), [set() for _ in ids]
            for k, (keys, values) in windows.items():
                runs = sequence_hashes(hashes, k)
                at = np.flatnonzero(tables[k][(runs >> np.uint64(48)).astype(np.int64)])
                at = at[doc[at] == doc[at + k - 1]]
                pos = np.minimum(np.searchsorted(keys, runs[at]), len(keys) - 1)
                same = keys[pos] == runs[at]
                for i, p in zip(at[same].tolist(), pos[same].tolist(), strict=True):
                    owners = values[p].get(tuple(low[b:e].tobytes() for b, e in zip(begin[i : i + k], end[i : i + k], strict=True)))
                    if owners:  # verified by its words
                        hit[i] += 1
                        hit[i + k] -= 1
                        items[doc[i]] |= owners
            yield _result(ids, starts, begin, end, doc, hit, items, with_spans)

    return run


def _result(ids, starts, begin, end, doc, hit, items: list, with_spans: bool) -> pa.RecordBatch:
    """The rows of a chunk; ``hit`` is, at each word, how many more windows start there than end before it."""
    inside = np.cumsum(hit[:-1]) > 0
    spans: list[list] = [[] for _ in ids]
    if with_spans and inside.any():
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        split = np.flatnonzero(inside[1:] & inside[:-1] & (doc[1:] != doc[:-1])) + 1
        first, last = np.sort(np.append(np.flatnonzero(edge == 1), split)), np.sort(np.append(np.flatnonzero(edge == -1), split)) - 1
        for f, t in zip(first.tolist(), last.tolist(), strict=True):
            d = doc[f]
            spans[d].append({"begin": int(begin[f] - starts[d]), "end": int(end[t] - starts[d])})
    of = lambda x: pa.array(x, pa.int64())
    columns = [of(ids), of(np.bincount(doc, minlength=len(ids))), of(np.bincount(doc[inside], minlength=len(ids))), of([len(s) for s in items])]
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    return pa.record_batch([*columns, pa.array([sorted(s) for s in items], pa.list_(pa.string())), pa.array(spans, kind)], names=["id", "n_words", "n_hit", "n_items", "items", "spans"])


def _listed(n: int, lengths: list[int] | None):
    """(id or row, place, gram): the windows of items (their own length, ``lengths`` is None), or of texts in each of ``lengths``, as words."""

    first = "id" if lengths is None else "row"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                low = LOWER[np.frombuffer((text.as_py() or "").encode(), np.uint8)]
                words = [low[b:e].tobytes() for b, e in zip(*word_spans(low, np.array([0, len(low)]), ALNUM), strict=True)]
                for k in lengths or [min(n, len(words))]:
                    for at in range(len(words) - k + 1 if k else 0):
                        for column, x in zip(rows, (i, at, b" ".join(words[at : at + k]).decode()), strict=True):
                            column.append(x)
                if len(rows[0]) > 20_000:
                    yield pa.record_batch([pa.array(rows[0], batch.column(0).type), pa.array(rows[1], pa.int32()), pa.array(rows[2])], names=[first, "place", "gram"])
                    rows = [[], [], []]
            if rows[0]:
                yield pa.record_batch([pa.array(rows[0], batch.column(0).type), pa.array(rows[1], pa.int32()), pa.array(rows[2])], names=[first, "place", "gram"])

    return run


def _marked(with_spans: bool):
    """The result of texts with their matches: columns id, text, matches (place, words, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, raw, starts in text_chunks([batch]):
                begin, end = word_spans(LOWER[raw], starts, ALNUM)
                doc = np.searchsorted(starts, begin, side="right") - 1
                first = np.searchsorted(doc, np.arange(len(ids)))
                hit, items = np.zeros(len(begin) + 1, np.int64), [set() for _ in ids]
                for d, matches in enumerate(batch.column(2).slice(done, len(ids)).to_pylist()):
                    for m in matches or ():
                        hit[first[d] + m["place"]] += 1
                        hit[first[d] + m["place"] + m["words"]] -= 1
                        items[d].add(m["item"])
                done += len(ids)
                yield _result(ids, starts, begin, end, doc, hit, items, with_spans)

    return run


def _joined(rows: DataFrame, items: DataFrame, n: int, with_spans: bool) -> DataFrame:
    """The same by a join on the words of windows, for a benchmark of any size."""
    windows = materialise(items.select(F.col("item").cast("string").alias("id"), "text").transform(map_batches, _listed(n, None), "id string, place int, gram string").select("gram", F.col("id").alias("item")).distinct(), "benchmark-windows")
    lengths = [r[0] for r in windows.select((F.length(F.regexp_replace("gram", "[^ ]", "")) + 1).alias("k")).distinct().orderBy("k").collect()]  # n at most
    # Each row has a key of its own, written with it; ids may repeat or be missing.
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "contamination-rows")
    if not lengths:
        matches = rows.select("row").where("false").withColumn("matches", F.lit(None).cast(MATCHES))
    else:
        met = rows.select("row", "text").transform(map_batches, _listed(n, lengths), "row long, place int, gram string").join(windows.hint("merge"), "gram")
        words = F.length(F.regexp_replace("gram", "[^ ]", "")) + 1
        matches = met.select("row", F.struct("place", words.alias("words"), "item").alias("m")).groupBy("row").agg(F.collect_set("m").alias("matches"))  # of one document
    return rows.join(materialise(matches, "benchmark-matches").hint("merge"), "row", "left").select("id", "text", "matches").transform(map_batches, _marked(with_spans), SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", spans: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted), spans (byte spans of hit words in the UTF-8 text).

    The benchmark's bytes are summed first; up to ``broadcast_bytes`` its windows are broadcast, beyond that they are joined. Ids may
    repeat or be missing, and items without an id count as one called ``null``; an empty benchmark hits nothing, an empty table of
    documents gives an empty result; other columns are ignored, whatever their names.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select(key_of(id_col).alias("id"), F.col(text_col).alias("text"))
    if size > broadcast_bytes:
        found = _joined(rows, items, n, spans)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(_item_windows([tuple(r) for r in items.collect()], n))
        found = rows.transform(map_batches, _scan(sent, spans), SCHEMA)
    return found.withColumn("id", id_of()).withColumnRenamed("id", id_col)


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the hit spans cut out of the text (the words and what lies between them). ``found`` is what ``contamination``
    returns for it; ids are unique."""
    from pyspark.sql import types as T

    place = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    spans = found.where("n_hit > 0").select(F.col(id_col).alias("key"), F.col("spans").alias("cut"))
    joined = plain.join(spans, plain[f"c{docs.columns.index(id_col)}"] == spans["key"], "left").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut(text.as_py(), cut.as_py()) for text, cut in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True)]
            yield pa.record_batch([*batch.columns[:place], pa.array(texts, pa.string()), *batch.columns[place + 1 : -1]], names=names)

    names = plain.columns
    return joined.transform(map_batches, run, T.StructType([T.StructField(c, f.dataType) for c, f in zip(names, docs.schema, strict=True)])).toDF(*docs.columns)


def _cut(text: str | None, spans: list | None) -> str | None:
    if text is None or not spans:
        return text
    raw, at, out = text.encode(), 0, []
    for s in spans:
        out.append(raw[at : s["begin"]])
        at = s["end"]
    return b"".join([*out, raw[at:]]).decode()


def items_digest(items) -> str:
    """Lower-case hex SHA-256 of the comma-joined sorted item ids."""
    return F.sha2(F.concat_ws(",", items), 256)


def brute_force(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """The same by plain loops, for tests: (id, n_words, n_hit, items)."""
    import re

    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    out = []
    for d, text in docs:
        w = words(text)
        hit, got = set(), set()
        for item, other in items:
            v = words(other)
            k = min(n, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    got.add(str(item))
        out.append((d, len(w), len(hit), sorted(got)))
    return out


