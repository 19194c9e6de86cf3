"""Notes of a vault built from bars and sweeps: one a symbol, one a configuration, and an index; and their sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.functions.scalars import round_exact, slug

COLUMNS = ("folder", "slug", "ntype", "title", "body", "links", "data_through")


def symbol_notes(bars: DataFrame) -> DataFrame:
    """Rows and range of each symbol's bars."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    rows = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    body = F.concat(F.lit("Daily bars: "), F.col("n").cast("string"), F.lit(", from "), day("a"), F.lit(" to "), day("b"), F.lit(". Part of [[Universe]]."))
    return rows.select(F.lit("symbols").alias("folder"), slug(F.col("symbol")).alias("slug"), F.lit("symbol").alias("ntype"), F.col("symbol").alias("title"), body.alias("body"), F.array(F.lit("Universe")).alias("links"), F.to_date("b").alias("data_through"))


def config_notes(verdicts: DataFrame, data_through) -> DataFrame:
    """Of each configuration its best horizon out of sample and what it is worth; ``verdicts`` as of ``evaluate.verdicts``."""
    names = [c for c in verdicts.columns if c != "config"]
    best = verdicts.groupBy("config").agg(F.max_by(F.struct(*names), F.struct("oos_cond_edge_pp", -F.col("horizon"))).alias("b")).select("config", "b.*")
    family = F.substring_index("config", "[", 1)
    worth = F.when(F.col("real_edge"), "real-edge-claim").when(F.col("drift_rider"), "drift-rider").otherwise("no-edge")
    edge = F.format_string("%+.1f", round_exact(F.col("oos_cond_edge_pp"), 1))
    body = F.concat(F.lit("Family [["), family, F.lit("]], best after "), F.col("horizon").cast("string"), F.lit(" bars: "), edge, F.lit(" pp on "), F.col("oos_signals").cast("string"), F.lit(" signals. Verdict: "), worth, F.lit("."))
    return best.select(F.lit("configs").alias("folder"), slug(F.col("config")).alias("slug"), F.lit("config").alias("ntype"), F.col("config").alias("title"), body.alias("body"), F.array(slug(family), F.lit("Edge Search"), F.lit("Costs")).alias("links"), data_through.alias("data_through"))


def index_note(notes: DataFrame, most: int = 60) -> DataFrame:
    """One row a folder: its heading and links to its first notes by slug."""
    first = F.slice(F.array_sort(F.collect_list("slug")), 1, most)  # a vault's folder, some hundred notes
    listed = F.array_join(F.transform(first, lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n")
    return notes.groupBy("folder").agg(F.concat(F.lit("## "), F.initcap("folder"), F.lit(" ("), F.count("*").cast("string"), F.lit(")\n"), listed).alias("section"))


def write_notes(notes: DataFrame, decisions: DataFrame, path: str) -> None:
    """Writes the notes that are new, stale or have newer data, by folder; ``decisions`` as of ``graph.decide``."""
    wanted = decisions.where(F.col("decision").isin("new", "new-data", "stale")).select("slug")
    notes.join(wanted, "slug", "left_semi").select(*COLUMNS).write.mode("append").partitionBy("folder").json(path)
