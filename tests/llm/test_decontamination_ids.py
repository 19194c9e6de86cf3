"""Both ways of decontamination on repeated and missing ids of unequal lengths."""

import random

import pytest

from barweave.llm import decontaminate

ITEM = " ".join(f"b{i}" for i in range(12))


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_rows_that_share_an_id_have_matches_of_their_own(spark, broadcast_bytes):
    rng = random.Random(1)
    docs = [(1, f"long text with {ITEM} and a tail"), (1, "x y z"), (2, "other words " * 30), (None, ITEM.upper()), (None, "q"), (None, None), (3, "")]
    docs += [(rng.choice([4, 5, None]), " ".join(rng.choice([f"b{rng.randrange(12)}", ITEM, "w"]) for _ in range(rng.randrange(9)))) for _ in range(30)]
    items = [(7, ITEM), (8, "b1 b2"), (None, "b3"), (9, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(table, bench, broadcast_bytes=broadcast_bytes)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)
    want = decontaminate.brute_force(docs, [("null" if i is None else i, t) for i, t in items])
    assert got == sorted(want, key=str) and {g[2] for g in got} > {0, 12}
