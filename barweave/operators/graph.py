"""Notes with links as a graph, and when a note has to be written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def links_of(notes: DataFrame) -> DataFrame:
    """(src, dst) of ``[[…]]`` in the bodies, without loops and repeats."""
    found = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))
    return notes.select(F.col("slug").alias("src"), F.explode(found).alias("dst")).where("src <> dst")


def nodes_of(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, grp, degree, value): notes, and the ends of edges that are no notes, as ``unresolved``; an edge counts at both ends."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    known = notes.select(F.col("slug").alias("id"), F.col("ntype").alias("grp"))
    both = known.join(degree, "id", "full")
    return both.select("id", F.coalesce("grp", F.lit("unresolved")).alias("grp"), F.coalesce("degree", F.lit(0)).alias("degree"), (1 + F.coalesce("degree", F.lit(0))).alias("value"))


def hubs(nodes: DataFrame, n: int = 8) -> DataFrame:
    return nodes.orderBy(F.desc("degree"), "id").limit(n)


def per_folder(notes: DataFrame, n: int = 60) -> DataFrame:
    return notes.withColumn("_r", F.row_number().over(Window.partitionBy("folder").orderBy("slug"))).where(F.col("_r") <= n).drop("_r")


def decide(notes: DataFrame, existing: DataFrame, today, ttl_days: int = 7, archive_days: int = 30) -> DataFrame:
    """(slug, decision): new, pinned, new-data, stale or fresh; of notes that are gone: archive once they are old, else keep."""
    old = existing.select("slug", F.col("updated").alias("_updated"), F.col("data_through").alias("_through"), F.col("pinned").alias("_pinned"))
    both = notes.select("slug", "data_through", F.lit(True).alias("_here")).join(old, "slug", "full")
    age = F.coalesce(F.datediff(today, F.col("_updated")), F.lit(1_000_000))
    gone = F.when(F.coalesce("_pinned", F.lit(False)), "pinned").when(age > archive_days, "archive").otherwise("keep")
    here = (
        F.when(F.col("_updated").isNull() & F.col("_pinned").isNull(), "new").when(F.coalesce("_pinned", F.lit(False)), "pinned")
        .when(F.coalesce(F.col("data_through") > F.col("_through"), F.lit(False)), "new-data").when(age >= ttl_days, "stale").otherwise("fresh")
    )
    return both.select("slug", F.when(F.col("_here").isNull(), gone).otherwise(here).alias("decision"))


def front_matter(slug, ntype, tags) -> "F.Column":
    """The head of a note."""
    return F.concat(F.lit("---\ntype: "), ntype, F.lit("\nslug: "), slug, F.lit("\ntags: ["), F.concat_ws(", ", tags), F.lit("]\n---\n"))


def parse_front_matter(text) -> "F.Column":
    """The head's keys and values as a map."""
    head = F.regexp_extract(text, "(?s)^---\\n(.*?)\\n---", 1)
    return F.str_to_map(head, F.lit("\n"), F.lit(": "))
