"""The prefix trie against plain loops: deep, equal, turnless, repeated and missing conversations."""

import random

import pytest

from barweave.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string, conv string, place int, name long, depth int"


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], KIND).repartition(3)
    turns, lengths = prefix_trie.share_openings(prefix_trie.ordered_turns(table))
    return sorted(map(tuple, prefix_trie.trie(turns, lengths).collect()), key=str)


def wanted(rows):
    return sorted(prefix_trie.brute_force(rows), key=str)


def test_against_plain_loops(spark):
    rng = random.Random(3)
    said = ["hello there", "a b  c", "", None, "x\ty z", "long " * 30]
    rows = []
    for c in range(64):
        rows += [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "bot", None]), rng.choice(said[: rng.randrange(1, 6)])) for t in range(rng.randrange(1, 9))]
    rows += [(-25, 0, "user", "hello there"), (-21, 3, "user", "a"), (None, 0, "user", "nobody's"), (1000, 5, "r", "t"), (1001, 5, "r", "t"), (1001, 5, "r", "t")]
    assert found(spark, rows) == wanted(rows)


@pytest.mark.parametrize("depth", [4, 33])
def test_depths_around_powers_of_two(spark, depth):
    rows = [(c, t, "u", f"t{t % 3}" if t < depth - 1 or c else "end") for c in (0, 20, 40, 100) for t in range(depth)]
    assert found(spark, rows) == wanted(rows)


def test_a_crowd_of_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(20 * c, t, "u", f"turn {t}") for c in range(90) for t in range(2)]
    got = found(spark, rows)
    assert got == wanted(rows) and len(got) == 3


def test_role_and_text_are_kept_apart(spark):
    rows = [(0, 0, "ab", "c"), (20, 0, "a", "bc"), (40, 0, "", "abc"), (60, 0, "1:a", "b")]
    got = found(spark, rows)
    assert got == wanted(rows) and len(got) == 5


def test_turnless_conversations_end_at_the_root(spark):
    # 1 has h turns fewer than its own, and no source: it keeps nothing.
    alone = [(c, 0, "u", "only") for c in range(1, 20)]
    got = found(spark, alone)
    assert got == wanted(alone) and any(r[1] == 0 and r[3] == 19 for r in got)


def test_an_empty_table(spark):
    assert found(spark, []) == []
