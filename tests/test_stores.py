"""Upserts with a manifest, Markdown batches, and the graph page."""

import os

import pytest
from pyspark.sql import functions as F

from barweave.sources import upserts, vault

KIND = "day int, mode string, pnl double"


def content(rows):
    return sorted(map(tuple, rows.collect()), key=str)


def test_upserts_touch_their_partitions_only(spark, tmp_path):
    table = upserts.UpsertTable(spark, str(tmp_path), KIND, ["day", "mode"], "mode")
    make = lambda *rows: spark.createDataFrame(rows, KIND)
    assert table.read().count() == 0 and table.version() == 0
    assert table.upsert(make((1, "a", 1.0), (2, "a", 2.0), (1, "b", 3.0), (None, None, 4.0))) == 1
    first = table._manifest(1)
    assert table.upsert(make((2, "a", 5.0), (3, "a", 6.0), (None, None, 7.0))) == 2
    second = table._manifest(2)
    assert first["=b"] == second["=b"] and first["=a"] != second["=a"]
    assert content(table.read()) == sorted([(1, "a", 1.0), (2, "a", 5.0), (3, "a", 6.0), (1, "b", 3.0), (None, None, 7.0)], key=str)
    assert content(table.read(1)) == sorted([(1, "a", 1.0), (2, "a", 2.0), (1, "b", 3.0), (None, None, 4.0)], key=str)
    with pytest.raises(ValueError, match="twice"):
        table.upsert(make((1, "a", 1.0), (1, "a", 2.0)))
    assert table.upsert(make((1, "a", 1.0)).where("false")) == 3 and table.read().count() == 5


def test_a_lost_commit_is_not_seen_and_the_second_writer_fails(spark, tmp_path):
    one, other = (upserts.UpsertTable(spark, str(tmp_path), KIND, ["day", "mode"], "mode") for _ in range(2))
    rows = spark.createDataFrame([(1, "a", 1.0)], KIND)
    one.upsert(rows)
    (tmp_path / "data" / "lost" / "_part=0").mkdir(parents=True)
    (tmp_path / "data" / "lost" / "_part=0" / "x.parquet").write_bytes(b"torn")
    assert content(one.read()) == [(1, "a", 1.0)]
    base = other.version()
    one.upsert(rows.withColumn("pnl", F.lit(2.0)))
    with pytest.raises(RuntimeError, match="another writer"):
        other._switch(base + 1, {})
    assert content(other.read()) == [(1, "a", 2.0)]


def test_a_batch_of_notes_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "vault")
    rows = spark.createDataFrame([("a b", f"n {i}/ä?", f"text {i}\nmore") for i in range(40)] + [("f", "x", None), ("f", "dup", "1"), ("f", "dup", "1")], "folder string, slug string, text string").repartition(3)
    vault.write(rows, path)
    assert sorted(os.listdir(path)) == ["batch=0"]
    got = content(vault.read(spark, path))
    assert got == sorted([("a b", f"n {i}/ä?", 0, f"text {i}\nmore") for i in range(40)] + [("f", "dup", 0, "1")], key=str)
    bad = F.udf(lambda i: "x" if i < 90 else 1 // 0)
    with pytest.raises(Exception):
        vault.write(spark.range(100).repartition(4).select(F.lit("g").alias("folder"), F.col("id").cast("string").alias("slug"), bad("id").alias("text")), path)
    assert sorted(os.listdir(path)) == ["batch=0"]
    vault.write(spark.createDataFrame([("f", "dup", "2")], "folder string, slug string, text string"), path)
    assert {(r.slug, r.text) for r in vault.current(vault.read(spark, path)).where("folder = 'f'").collect()} == {("dup", "2")}


def test_markdown_has_a_head_and_links(spark):
    rows = spark.createDataFrame([("n", "a", 'Say "A"', "body  ", ["b", "a", "b", ""], "2024-01-02")], "ntype string, slug string, title string, body string, links array<string>, d string").withColumn("data_through", F.to_date("d"))
    text = rows.select(vault.markdown(F.to_date(F.lit("2024-02-01")))).first()[0]
    assert text == "---\ntype: n\ntitle: \"Say 'A'\"\nslug: a\nupdated: 2024-02-01\ndata_through: 2024-01-02\n---\n\n# Say \"A\"\n\nbody\n\n## Links\n- [[b]]\n"


def test_the_page_holds_every_node_and_edge_in_order(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", "</script>", i) for i in range(9)], "id string, grp string, value long")
    edges = spark.createDataFrame([("n1", "n2"), ("n0", "n8")], "src string, dst string")
    vault.write_page(nodes, edges, str(tmp_path))
    (page,) = (tmp_path / "page").glob("part-*.txt")
    text = page.read_text()
    lines = text.split("\n")
    assert lines[2].startswith('{"id":"n0"') and text.count("</script>") == 1 and text.rstrip().endswith("</script>")
    assert lines.index("];") == 11 and lines[13:15] == ['{"src":"n0","dst":"n8"},', '{"src":"n1","dst":"n2"},']
