"""Backed-off scores whose n-grams are exploded batch by batch."""

import random

import pytest

from barweave.llm import backoff_lm

RNG = random.Random(1)
DOCS = [(i, " ".join(RNG.choice("abcdefg") for _ in range(RNG.randrange(60)))) for i in range(30)]
DOCS += [(100, None), (101, ""), (102, "A"), (103, " ".join(RNG.choice("abcdefghijkl") for _ in range(300)))]


@pytest.mark.parametrize("batch_words", [4, 7, 50])
def test_texts_that_go_on_in_another_batch(spark, batch_words):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    want = {d: (n, b, s) for d, n, b, s in backoff_lm.brute_force(DOCS, 3)}
    got = backoff_lm.score(docs, 3, batch_words=batch_words).collect()
    assert len(got) == len(want)
    for r in got:
        n, b, s = want[r.doc_id]
        assert (r.n_words, r.n_backoff) == (n, b) and r.log_score == pytest.approx(s)


def test_a_batch_has_one_row_for_each_different_ngram():
    import numpy as np
    import pyarrow as pa

    words = np.array([5, 6] * 1000, np.int64)
    one = pa.record_batch([pa.array([[len(words)]]), pa.array([[0]]), pa.array([words]), pa.array([3])], names=["sizes", "leads", "words", "number"])
    for k in (1, 2, 3):
        (rows,) = backoff_lm._grams(k, 0, 1)(iter([one]))
        assert sorted(a & backoff_lm.WORDS for a in rows.column("at").to_pylist()) == sorted([1000 - (k - 1) // 2, 1000 - k // 2])


def test_ngrams_of_a_batch_go_as_one_row_a_range():
    import numpy as np
    import pyarrow as pa

    words = np.random.default_rng(1).integers(1, 1 << 62, 1000)
    one = pa.record_batch([pa.array([[len(words)]]), pa.array([[0]]), pa.array([words]), pa.array([3])], names=["sizes", "leads", "words", "number"])
    (rows,) = backoff_lm._dealt(2, 0, 1, 8)(iter([one]))
    sizes = [len(times.as_py()) // 4 for times in rows.column("times")]
    assert rows.column("range").to_pylist() == list(range(8)) and sum(sizes) == 999
    assert rows.column("start").to_pylist() == [sum(sizes[:i]) for i in range(8)]
    assert sum(rows.column(c).nbytes for c in ("grams", "rests", "times")) < 17 * 999


def test_ngrams_that_share_64_bits_of_hash_are_counted_apart():
    import numpy as np
    import pyarrow as pa

    runs = [([5, 5, 9], [1, 2, 0], [1, 2, 300]), ([5, 9], [2, 0], [4, 7])]  # hashes, their rests, times
    columns = [pa.array([np.array(r[c], kind).tobytes() for r in runs], pa.binary()) for c, kind in enumerate((np.uint64, np.int32, np.int32))]
    rows = pa.table([pa.array([0, 0], pa.int32()), pa.array([7, 8], pa.int32()), pa.array([0, 4], pa.int32()), *columns], names=["range", "number", "start", "grams", "rests", "times"])
    got = backoff_lm._joined(0, 2)(rows).to_pylist()
    assert [(r["number"], r["start"], np.frombuffer(r["counts"], f"u{r['width']}").tolist()) for r in got] == [(7, 0, [0, 6, 307]), (8, 4, [6, 307])]


def test_counts_of_many_ranges_come_back(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "ROWS", 100)
    rows = [*DOCS, (200, "a " * 400), (201, "b a " * 200)]
    want = {d: (n, b, s) for d, n, b, s in backoff_lm.brute_force(rows, 3)}
    got = backoff_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, batch_words=150).collect()
    assert len(got) == len(want)
    for r in got:
        n, b, s = want[r.doc_id]
        assert (r.n_words, r.n_backoff) == (n, b) and r.log_score == pytest.approx(s)
