"""Suffix-array deduplication against a set of all windows."""

import hashlib
import random

import numpy as np
import pytest

from barweave.llm import registry, suffix_dedup


def corpus() -> list[tuple]:
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    passage, base = say(60), say(150)
    texts = [base, base, base + " tail", say(80) + "\n" + passage, passage + "\n" + say(70) + "\n" + passage, "x " + passage + " y", None, "", " ", "a", "é ü ñ 日本 " * 30, say(3000)]
    for _ in range(12):
        near = base.split()
        for _ in range(rng.randrange(1, 6)):
            near[rng.randrange(150)] = f"w{rng.randrange(900)}"
        texts.append(" ".join(near))
    texts += ["be " * 200, "ab" * 300, "x" * 99, "x" * 100, "x" * 101] + [say(9) + passage[k : k + 99 + k % 5] + say(4) for k in range(0, 40, 3)]
    rng.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


DOCS = corpus()
WANT = set(suffix_dedup.brute_force(DOCS, 100))


def found(df):
    return {(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "n", 1, 2) for i, t in DOCS], "doc_id long, text string, id long, lead string, key int, holder int").repartition(3)


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_against_all_windows(spark, docs, batches, monkeypatch):
    """The texts are scanned once for suffixes, however many batches there are."""
    scan, scanned, made = suffix_dedup._scan, spark.sparkContext.accumulator(0), []

    def counted(length, cuts):
        made.append(len(cuts))
        run = scan(length, cuts)

        def tell(parts):
            for part in parts:
                scanned.add(part.num_rows)
                yield part

        return lambda parts: run(tell(parts))

    monkeypatch.setattr(suffix_dedup, "_scan", counted)
    assert found(suffix_dedup.remove_repeats(docs, 100, batches)) == WANT
    assert made == [batches - 1] and scanned.value == len(DOCS)


def test_batches_grow_with_the_corpus(docs, monkeypatch):
    sizes = []
    add = suffix_dedup.SuffixFamily.add
    monkeypatch.setattr(suffix_dedup.SuffixFamily, "add", lambda self, scanned: (add(self, scanned), sizes.append(1)))
    monkeypatch.setattr(suffix_dedup, "BATCH", 100)
    monkeypatch.setattr(suffix_dedup, "MOST_BATCHES", 5)
    assert found(suffix_dedup.remove_repeats(docs)) == WANT and len(sizes) == 5


def test_a_frequent_window(spark):
    """Runs of one letter in many documents, in contexts that differ."""
    rows = [(i, f"{i:>7}" + "-" * (120 + i % 9) + f"{i * 7919}") for i in range(60)]
    got = found(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == set(suffix_dedup.brute_force(rows, 100))


def test_levels_merge_geometrically_and_are_in_suffix_order(docs, monkeypatch):
    families = []

    class Watched(suffix_dedup.SuffixFamily):
        def __init__(self):
            super().__init__()
            families.append(self)
            self.sizes, self.merges = [], 0

        def _merge(self):
            super()._merge()
            self.merges += 1

        def add(self, scanned):
            super().add(scanned)
            self.sizes.append([n for n, _ in self.levels])

        def whole(self):
            level = super().whole()
            order = [tuple(r) for r in level.where("holder is null").orderBy("lead", "head", "context").select("lead", "head", "context").collect()]
            assert len(order) == len(set(order)) > 100
            for part in level.rdd.glom().map(lambda rows: [(r.lead, r.head, r.context) for r in rows if r.holder is None]).collect():
                assert part == sorted(part)
            return level

    monkeypatch.setattr(suffix_dedup, "SuffixFamily", Watched)
    monkeypatch.setattr(suffix_dedup, "BATCH", sum(len((t or "").encode()) for _, t in DOCS) // 5)
    assert found(suffix_dedup.remove_repeats(docs)) == WANT
    assert families[-1].sizes[:4] == [[1], [2], [2, 1], [4]] and families[-1].merges == len(families[-1].sizes) - 1


def test_the_registered_query_merges_levels(spark, tmp_path, monkeypatch):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    merges = []
    merge = suffix_dedup.SuffixFamily._merge
    monkeypatch.setattr(suffix_dedup.SuffixFamily, "_merge", lambda self: (merges.append([n for n, _ in self.levels]), merge(self)))
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op10_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got == WANT and merges == [[1, 1], [2, 1, 1], [2, 2]]


def test_rows_that_share_an_id_and_rows_without_one(spark):
    text = "abc " * 60
    rows = [(1, text + "q"), (1, text + "z"), (2, "x"), (None, text + "q"), (2, "y" * 100)]
    got = sorted((r.doc_id or 9, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    kept = [241 - n for i, _, n in got if i == 1]
    assert sorted(kept) == [1, 5] and got[-1][2] == 241 and [x for x in got if x[0] == 2] == [(2, 1, 0), (2, 100, 0)]
    twice = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in twice) == [236, 240]  # one keeps its first period


def test_hashes_that_collide_remove_nothing(spark, monkeypatch):
    """Bytes decide, not hashes: with the same hash for all spans only what is equal goes."""
    monkeypatch.setattr(suffix_dedup, "span_hashes", lambda sums, begin, end: np.zeros(len(begin), np.uint64))
    raw = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    other = raw.copy()
    other[150] ^= 1
    assert suffix_dedup._equal_runs(raw, other, 100) == [(0, 150), (151, 300)]
    assert suffix_dedup._equal_runs(raw, raw[::-1].copy(), 100) == []


def test_nothing_and_one_long_text(spark):
    kind = "doc_id long, text string"
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], kind)).count() == 0
    rng = random.Random(2)
    half = "".join(rng.choice("etaoin shrdlu") for _ in range(600_000))
    row = suffix_dedup.remove_repeats(spark.createDataFrame([(1, half + "|" + half)], kind), with_text=False).first()
    assert (row.n_removed, row.kept_sha256) == (len(half), hashlib.sha256((half + "|").encode()).hexdigest())


def test_anchors_of_a_long_text_are_cut_without_harm():
    raw = np.frombuffer(random.Random(1).randbytes(3000) * 3, np.uint8)
    *_, lo, hi, _, _ = suffix_dedup.anchors(raw, np.array([0, len(raw)]), 100, 32)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
    assert np.array_equal(np.sort(covered), np.arange(len(raw) - 99))


def test_a_cascade_of_merges_is_one_sort(spark, monkeypatch):
    sorts, plain = [], suffix_dedup.SuffixFamily._sorted
    monkeypatch.setattr(suffix_dedup.SuffixFamily, "_sorted", lambda self, rows: sorts.append(1) or plain(self, rows))
    docs = [(i, f"{'x y z ' * 30}{i % 7}{'some words that come again ' * 6}{i % 3}") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(frame, 100, batches=4, with_text=False).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got] == suffix_dedup.brute_force(docs, 100)
    assert len(sorts) == 4  # one a batch, with what is merged after it


def test_windows_of_a_pair_become_runs():
    import pyarrow as pa

    rows = [(1, 0, 5, 5, 15), (1, 0, 6, 6, 16), (1, 0, 4, 4, 14), (1, 0, 8, 9, 18), (1, 0, 7, 7, 90), (2, 0, 7, 7, 17), (2, 1, 8, 8, 18)]
    batch = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["key", "holder", "lo", "hi", "from"])
    got = [r for b in suffix_dedup._pairs(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert [(r["key"], r["holder"], [tuple(x.values()) for x in r["runs"]]) for r in got] == [(1, 0, [(4, 6, 14), (8, 9, 18), (7, 7, 90)]), (2, 0, [(7, 7, 17)]), (2, 1, [(8, 8, 18)])]


def test_hashes_of_all_spans_are_those_of_each():
    import numpy as np

    from barweave.llm import common

    raw = np.random.default_rng(3).integers(0, 256, 5000).astype(np.uint8)
    sums, at = common.prefix_sums(raw), np.arange(5000 - 32 + 1)
    assert (common.all_span_hashes(sums, 32) == common.span_hashes(sums, at, at + 32)).all()
