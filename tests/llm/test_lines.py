"""Repeated sentences, lines and paragraphs against plain loops."""

import random

import pytest

from barweave.llm import line_dedup, registry


def corpus() -> list[tuple]:
    rng = random.Random(8)
    word = lambda: rng.choice(["ab", "Cd", "éf", "ghi", "jkl", "mn", "日本"]) + str(rng.randrange(400))
    say = lambda n: " ".join(word() for _ in range(n)) + rng.choice(".!?")
    passage = " ".join(say(9) for _ in range(6))
    stock = "All rights reserved."
    texts = [passage, say(30) + " " + stock, say(12) + " and then " + passage + " " + say(20), stock + "\n" + say(40), "x\n\n" + passage.upper() + "\n\n" + say(5)]
    texts += [None, "", " ", "\n\n", ".", "a. b", "a.\tb!\n c?? d", passage, (say(25) + " ") * 3, say(20000) + "\n" + passage]
    texts += [" ".join(rng.choice(["be be be.", "Of.", "The end!", say(4)]) for _ in range(30)) for _ in range(8)]
    return [(5 * i + 2, t) for i, t in enumerate(texts)]


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "n", 1, None) for i, t in DOCS], "doc_id long, text string, id long, units string, twin int, again string").repartition(3)


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
@pytest.mark.parametrize("min_words", [1, 20])
def test_against_loops(docs, unit, min_words):
    got = line_dedup.remove_repeats(docs, unit, min_words).collect()
    assert {(r.doc_id, r.n_units, r.n_removed, r.text) for r in got} == set(line_dedup.brute_force(DOCS, unit, min_words))
    original = dict(DOCS)
    for r in got:
        gone = "".join(original[r.doc_id][s.start : s.end] for s in r.spans)
        assert len(gone) == r.n_removed_chars and len(gone) + len(r.text) == len(original[r.doc_id] or "")


def test_a_passage_in_mid_line_goes_and_a_stock_phrase_stays(docs):
    got = {r.doc_id: r for r in line_dedup.remove_repeats(docs).collect()}
    assert got[2].n_removed == 0 and got[12].n_removed >= 4 and got[62].text == ""
    assert got[17].n_removed == 0 and got[17].text.startswith("All rights reserved.")


def test_empty_table_and_rows_that_share_an_id(spark):
    kind = "doc_id long, text string"
    assert line_dedup.remove_repeats(spark.createDataFrame([], kind)).count() == 0
    texts = [(1, "one line\nand another"), (1, "one line\nand another"), (1, "and another"), (2, "another text\none line"), (None, "one line")]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.remove_repeats(spark.createDataFrame(texts, kind), "line", 1).collect())
    assert got == [(0, "one line"), (1, "and another"), (1, "one line\nand another"), (1, "one line\nand another"), (2, "another text\n")]


def test_short_lines_are_judged_too(spark, tmp_path):
    texts = ["all rights reserved.\nbody of the first text", "All  rights reserved.\n\nyes\n", "yes\nYES\n \nbody of the first text", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_units, r.n_removed, r.text) for r in registry.QUERIES["op5_line_dedup_all"](spark, str(tmp_path)).collect()}
    assert got == set(line_dedup.brute_force(list(enumerate(texts)), "line", 1)) >= {(1, 3, 1, "\nyes\n"), (2, 4, 3, " \n")}
