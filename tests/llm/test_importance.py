"""Importance resampling against plain loops: chunks of every size, odd rows, and the checksum of joined words."""

import random
import zlib

import numpy as np
import pytest

from barweave.llm import importance
from barweave.llm.common import ALNUM, LOWER, word_spans

KIND = "doc_id long, text string, row long, id long, own int, rank string"


def corpus(n=150):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["ÉTÉ", "日本", "Zürich", "a" * 100]
    docs = [(3 * i, " ".join(rng.choice(words) + rng.choice(["", ",", ".\n", "_"]) for _ in range(rng.randrange(0, 90)))) for i in range(n)]
    return docs + [(5, None), (5, ""), (7, " ., "), (None, " ".join(words)), (None, None), (8, "x" * 3000), (9, docs[9][1]), (9, docs[9][1])]


DOCS, AIM = corpus(), ["w1 w2 w3 w4 ÉTÉ w5 " * 5, None, "", "w9 w8"]


def found(spark, docs, aim, **more):
    left = spark.createDataFrame([(i, t, 1, 2, 3, "r") for i, t in docs], KIND).repartition(4)
    right = spark.createDataFrame([(1, t) for t in aim], "item_id long, text string")
    got = importance.resample(left, right, **more).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("limit", [1, 40, 1 << 16])
def test_against_plain_loops(spark, limit):
    assert found(spark, DOCS, AIM, limit=limit) == sorted(importance.brute_force(DOCS, AIM), key=str)


def test_other_parameters(spark):
    more = {"percent": 30, "least_words": 3, "n": 2, "buckets": 7, "seed": 5}
    assert found(spark, DOCS, AIM, limit=100, **more) == sorted(importance.brute_force(DOCS, AIM, **more), key=str)


def test_a_very_long_text_is_many_chunks(spark):
    rng = random.Random(1)
    docs = [(1, " ".join(f"v{rng.randrange(5000)}" for _ in range(200_000))), (2, "one two"), (3, "y" * 200_000)]
    rows = spark.createDataFrame([(i, i, t) for i, t in docs], "row long, id long, text string")
    cut = importance.chunks(rows).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in cut}[1] > 10
    assert found(spark, docs, AIM) == sorted(importance.brute_force(docs, AIM), key=str)


def test_empty_tables(spark):
    assert found(spark, [], AIM) == []
    assert found(spark, DOCS, []) == sorted(importance.brute_force(DOCS, []), key=str)
    assert found(spark, [(1, None)], [None]) == sorted(importance.brute_force([(1, None)], [None]), key=str)


def test_checksums_of_joined_words():
    text = ("ab CD ef-" + "g" * 70 + " é " + "h" * 64 + " i " + "j" * 5000 + " k").encode()
    low = LOWER[np.frombuffer(text, np.uint8)]
    begin, end = word_spans(low, np.array([0, len(low)]), ALNUM)
    words = [low[a:b].tobytes() for a, b in zip(begin, end)]
    for k, crc in importance.ngram_crcs(low, begin, end, 3):
        assert crc.tolist() == [zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
