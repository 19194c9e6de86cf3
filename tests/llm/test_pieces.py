"""Sampled segmentations against an enumeration of all of them, and on texts without spaces."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from barweave.llm import sentencepiece_sampling as pieces
from barweave.llm.registry import MODEL


def segmentations(unit: str, weight: dict[str, float], fallback: float):
    """(pieces, log weight) of every way to cut a unit, by recursion."""
    if not unit:
        yield (), 0.0
    for k in range(1, len(unit) + 1):
        w = weight.get(unit[:k], fallback if k == 1 else None)
        if w is not None:
            for rest, more in segmentations(unit[k:], weight, fallback):
                yield (unit[:k], *rest), w + more


@pytest.mark.parametrize("unit", ["▁abab", "▁", "aabbc", "cab", "bcbcb"])
def test_draws_follow_the_enumerated_weights(unit):
    vocabulary = [("", 0.0, False), *((p, -w, False) for p, w in (("a", 1.0), ("b", 1.5), ("ab", 0.7), ("ba", 2.0), ("aab", 1.1), ("▁", 0.5), ("▁a", 1.0), ("▁ab", 2.5), ("bb", 0.9))), *((f"<0x{i:02X}>", 0.0, True) for i in range(256))]
    lattices = pieces.Lattices(vocabulary, True, 1.0)
    weight = {p: s for p, s, is_byte in vocabulary if p and not is_byte}
    ways = {p: math.exp(w) for p, w in segmentations(unit, weight, lattices.fallback)}
    total, n = sum(ways.values()), 40_000
    drawn, counts = lattices.sample(np.arange(n), [unit.replace("▁", " ")] * n, 3)
    at = np.concatenate([[0], np.cumsum(counts)])
    number = {p: (i,) for i, (p, _, is_byte) in enumerate(vocabulary) if p and not is_byte}
    spelt = {tuple(x for piece in way for x in number.get(piece, tuple(lattices.byte[b] for b in piece.encode()))): w / total for way, w in ways.items()}
    seen = Counter(tuple(drawn[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True))
    assert set(seen) <= set(spelt)
    for way, p in spelt.items():
        assert abs(seen[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_unbroken_texts_take_few_steps_and_come_back():
    rng = random.Random(1)
    vocabulary, unigram = pieces.load_vocabulary(MODEL)
    lattices = pieces.Lattices(vocabulary, unigram, 1.0)
    for letters in ("etaoinshr", "".join(map(chr, range(0x4E00, 0x4EFF))), "ABCabc012+/"):
        text = "".join(rng.choice(letters) for _ in range(400_000))
        drawn, counts = lattices.sample(np.array([5]), [text], 0)
        assert counts.tolist() == [len(drawn)] and lattices.decode(drawn).decode() == text


def test_blocks_and_forgotten_lattices_change_nothing(monkeypatch):
    vocabulary, unigram = pieces.load_vocabulary(MODEL)
    texts = ["the cat sat on the mat", "", "  two  spaces ▁ and é日", "x" * 40]
    whole = pieces.Lattices(vocabulary, unigram, 1.0).sample(np.arange(4), texts, 0)
    for name, value in (("BLOCK_CHARS", 5), ("BLOCK_UNITS", 2), ("CACHE_EDGES", 10)):
        monkeypatch.setattr(pieces, name, value)
    parts = pieces.Lattices(vocabulary, unigram, 1.0).sample(np.arange(4), texts, 0)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_missing_ids_and_texts(spark):
    rows = [(None, "some text"), (1, None), (1, ""), (2, " ")]
    got = pieces.sample_encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, with_text=True).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == [(0, "some text"), (1, ""), (1, ""), (2, " ")] and all(r.lossless for r in got)


def test_the_trie_is_looked_up_by_hash_also_where_slots_are_crowded():
    import numpy as np

    from barweave.llm import sentencepiece_sampling as pieces

    vocabulary = [("▁", -1.0, False)] + [(chr(0x4E00 + i) + chr(0x61 + j), -1.0, False) for i in range(3000) for j in range(9)] + [(f"<0x{b:02X}>", 0.0, True) for b in range(256)]
    made = pieces.Lattices(vocabulary, True, 1.0)
    assert made.crowded.any()
    want = np.concatenate([made.keys, made.keys + 13, np.array([0, 5], np.int64)])
    hit, at = made._find(want)
    assert (hit == np.isin(want, made.keys)).all() and (made.keys[at[hit]] == want[hit]).all()
    ids, texts = np.arange(3), ["", "一a 一z", "丁b▁x"]
    drawn, counts = made.sample(ids, texts, 0)
    assert made.decode_all(drawn, counts).to_pylist() == texts
