"""Notes as Markdown files and a graph page: a data source whose executors write, and whose batches are seen whole or not at all.

    write(notes, path)                        # a batch: <path>/batch=<n>/task-<k>/<folder>/<slug>.md
    current(read(spark, path))                # the newest note of each slug

Each task writes into a staging folder of its own attempt. The commit, on the driver, gathers the folders of the attempts that Spark
took and gives the batch its name by one rename; a failed job leaves a staging folder that nothing reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

COLUMNS = ("folder", "slug", "text")


def _store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class VaultWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.path)
        task = TaskContext.get()
        mine = f"{root}/_staging-{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(mine, recursive=True)
        files, made = 0, set()
        for folder, slug, text in iterator:
            place = f"{mine}/{quote(folder, safe=' ')}"
            if place not in made:
                store.create_dir(place, recursive=True)
                made.add(place)
            with store.open_output_stream(f"{place}/{quote(slug, safe=' ')}.md") as out:
                out.write(text.encode())
            files += 1
        return Written(mine, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        whole = f"{root}/_staging-{self.job}/whole"
        store.create_dir(whole, recursive=True)
        for k, m in enumerate(m for m in messages if m is not None and m.files):
            store.move(m.folder, f"{whole}/task-{k}")
        known = [int(x.base_name.removeprefix("batch=")) for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("batch=")]
        store.move(whole, f"{root}/batch={max(known, default=-1) + 1}")
        store.delete_dir(f"{root}/_staging-{self.job}")

    def abort(self, messages) -> None:
        store, root = _store(self.path)
        staging = f"{root}/_staging-{self.job}"
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class Vault(DataSource):
    """Rows of folder, slug and text as files; option path."""

    @classmethod
    def name(cls) -> str:
        return "note_vault"

    def writer(self, schema, overwrite) -> VaultWriter:
        return VaultWriter(self.options)


def markdown(updated) -> F.Column:
    """A note's text from the columns of ``notes``: front matter, title, body and the links that its body lacks a list of."""
    shown = F.transform(F.filter(F.array_distinct("links"), lambda x: (x != "") & (x != F.col("slug"))), lambda x: F.concat(F.lit("- [["), x, F.lit("]]")))
    head = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("type: "), F.col("ntype")), F.concat(F.lit('title: "'), F.regexp_replace("title", '"', "'"), F.lit('"')), F.concat(F.lit("slug: "), F.col("slug")),
        F.concat(F.lit("updated: "), F.date_format(updated, "yyyy-MM-dd")), F.concat(F.lit("data_through: "), F.date_format("data_through", "yyyy-MM-dd")), F.lit("---"),
    )
    listed = F.when(F.size(shown) > 0, F.concat(F.lit("\n## Links\n"), F.array_join(shown, "\n"), F.lit("\n"))).otherwise("")
    return F.concat(head, F.lit("\n\n# "), F.col("title"), F.lit("\n\n"), F.rtrim("body"), F.lit("\n"), listed)


def write(rows: DataFrame, path: str) -> None:
    """A batch of files from rows of folder, slug and text; rows with a null are left out, and of equal names one stays."""
    spark = rows.sparkSession
    spark.dataSource.register(Vault)
    kept = rows.select(*(F.col(c).cast("string").alias(c) for c in COLUMNS)).na.drop("any").dropDuplicates(["folder", "slug"])
    kept.write.format("note_vault").option("path", path).mode("append").save()


def write_decided(notes: DataFrame, decisions: DataFrame, path: str, updated) -> None:
    """Writes the notes that are new, stale or have newer data as Markdown; ``decisions`` as of ``graph.decide``."""
    wanted = decisions.where(F.col("decision").isin("new", "new-data", "stale")).select("slug")
    write(notes.join(wanted, "slug", "left_semi").select("folder", "slug", markdown(updated).alias("text")), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(folder, slug, batch, text) of all files of all batches."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(f"{path}/batch=*", wholetext=True).withColumn("_p", F.col("_metadata.file_path"))
    part = lambda pattern: F.try_url_decode(F.regexp_extract("_p", pattern, 1))  # noqa: E731  the path quotes what is quoted in names once more
    return files.select(F.try_url_decode(part(r"/([^/]+)/[^/]+\.md$")).alias("folder"), F.try_url_decode(part(r"/([^/]+)\.md$")).alias("slug"), F.regexp_extract("_p", r"/batch=(\d+)/", 1).cast("int").alias("batch"), F.col("value").alias("text"))


def current(files: DataFrame) -> DataFrame:
    """The newest file of each name."""
    newest = F.row_number().over(Window.partitionBy("folder", "slug").orderBy(F.desc("batch")))
    return files.withColumn("_r", newest).where("_r = 1").drop("_r")


PAGE = ("""<!doctype html><meta charset="utf-8"><title>Graph of notes</title><body><canvas id="c" width="1200" height="1200"></canvas><script>
const nodes = [
""", """];
const edges = [
""", """];
const at = {}, g = document.getElementById("c").getContext("2d");
nodes.forEach((n, i) => { const a = 2 * Math.PI * i / nodes.length; at[n.id] = [600 + 520 * Math.cos(a), 600 + 520 * Math.sin(a)]; });
g.strokeStyle = "#99a"; g.lineWidth = 0.4;
edges.forEach(e => { g.beginPath(); g.moveTo(...at[e.src]); g.lineTo(...at[e.dst]); g.stroke(); });
nodes.forEach(n => { g.beginPath(); g.arc(...at[n.id], 2 + Math.sqrt(n.value), 0, 7); g.fill(); g.fillText(n.id, at[n.id][0] + 6, at[n.id][1]); });
</script>
""")


def write_page(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as one page, ``<path>/page/part-….txt``: a line a node and a line an edge, put in order by ranges and streamed into the
    file by one task. The page is there with its ``_SUCCESS`` or not at all."""
    spark = nodes.sparkSession
    line = lambda part, of, *by: of.select(F.lit(part).alias("part"), F.concat_ws(" ", *by).alias("by"), F.concat(F.regexp_replace(F.to_json(F.struct("*")), "</", r"<\\\\/"), F.lit(",")).alias("value"))
    fixed = spark.createDataFrame([(2 * k, "", text.rstrip("\n")) for k, text in enumerate(PAGE)], "part int, by string, value string")
    rows = fixed.unionByName(line(1, nodes.select("id", "grp", "value"), "id")).unionByName(line(3, edges.select("src", "dst"), "src", "dst"))
    rows.orderBy("part", "by").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/page")
