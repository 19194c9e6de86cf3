"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, each partition is sorted externally, and neighbours are compared
in full. A partition's key is (leading characters, hash, id): the leading characters and the hash only place a row, so
the splitters' sample stays small whatever the texts' length, and a group of equal texts of any size is spread over as many
partitions as it needs, because the id takes part in the order. Only the first and the last run of a partition can go on
in another; these two rows a partition are joined up afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barweave.llm.common import MISSING, ascii_lower, id_of, key_of, map_batches, materialise

SCHEMA = "id long, part int, run int, run_keep long, run_size long, sha string, edge string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring full comparison of one sorted partition (columns id, norm; best id of each text first). Emits a row per
    text; of an open run only the ids are held."""
    from pyspark import TaskContext

    part, run, text, ids = TaskContext.get().partitionId(), -1, None, []

    def closed(edge: bool) -> pa.RecordBatch:
        n, sha = len(ids), hashlib.sha256(text.encode()).hexdigest()
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([run] * n, pa.int32()), pa.array([ids[0]] * n, pa.int64()), pa.array([n] * n, pa.int64()), pa.array([sha] * n), pa.array(([text] if edge else [None]) + [None] * (n - 1), pa.string())],
            names=["id", "part", "run", "run_keep", "run_size", "sha", "edge"],
        )

    out: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm, new = batch.column(1), batch.column(0).to_pylist()
        same = [norm[0].as_py() == text] + (pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_pylist() if n > 1 else [])
        for i, equal in enumerate(same):
            if not equal:
                if ids:
                    out.append(closed(run == 0))
                    if len(out) >= 512:
                        yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                        out = []
                run, text, ids = run + 1, norm[i].as_py(), []
            ids.append(new[i])
    if ids:
        out.append(closed(True))
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", lead: int = 48) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal if they are identical after lower-casing A-Z; null counts as empty, and all empty texts form one group.
    ``keep`` names the identifier of a group that stays, ``smallest`` or ``largest``. Ids are integers; rows of a group that share its
    best id all stay, and rows without an id count as one id after all others. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    rank = F.col("id") if keep == "smallest" else -F.col("id")
    norm = docs.select(key_of(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm"))
    order = [F.substring("norm", 1, lead), F.xxhash64("norm"), rank]
    placed = norm.repartitionByRange(*order).sortWithinPartitions(order[0], order[1], "norm", rank)
    runs = materialise(placed.select("id", "norm").transform(map_batches, _runs, SCHEMA), "exact-runs")
    edges = runs.where("edge is not null")  # at most two rows a partition
    whole = edges.withColumn("keep_id", best("run_keep").over(Window.partitionBy("edge"))).withColumn("group_size", F.sum("run_size").over(Window.partitionBy("edge")))
    joined = whole.select("part", "run", "keep_id", "group_size")
    return runs.join(joined, ["part", "run"], "left").select(  # Spark broadcasts it while it is small
        id_of().alias(id_col),
        F.nullif(F.coalesce("keep_id", "run_keep"), F.lit(MISSING)).alias("keep_id"),
        F.coalesce("group_size", "run_size").alias("group_size"),
        (F.col("id") == F.coalesce("keep_id", "run_keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
