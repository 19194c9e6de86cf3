"""Secret scans against plain loops over the same patterns, and on long texts."""

import random
import re
import time

from barweave.llm import secrets

BASE = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 6),
    ("access", re.compile("(AKIA[A-Z0-9]+)"), 20),
    ("hex", re.compile("([0-9a-f]+)"), 24),
)


def base_spans(text: str) -> list[tuple]:
    return sorted((m.start(), k, m.end()) for k, (_, pattern, least) in enumerate(BASE) for m in pattern.finditer(text) if len(m[1]) >= least)


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: r.spans for r in secrets.scan(rows).collect()}


def test_base_spans_against_regular_expressions(spark):
    rng = random.Random(4)
    bits = ["password", "Token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "\n", "\t", "é", "abc.def", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef", "deadbeef", ", ", "word", "secret"]
    texts = ["".join(rng.choice(bits) for _ in range(n)) for n in (5, 50, 400, 3000, 20_000) for _ in range(6)] + [None, "", "x" * 9000, "0123456789abcdef" * 2000, "token : " + "a" * 9000]
    got = scanned(spark, texts)
    for i, text in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in got[i] if s.kind < 3] == base_spans(text or "")
        assert all((text or "")[s.start : s.end] == s.value for s in got[i])


def test_a_long_text_takes_time_in_proportion(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    took = []
    for n in (100, 10_000, 40_000):
        text = " ".join(key() for _ in range(n))
        began = time.time()
        (spans,) = scanned(spark, [text]).values()
        took.append(time.time() - began)
        assert len(spans) > 0.8 * n
    assert took[2] < 10 * took[1] + 20


def test_ordinary_text_has_no_added_spans(spark):
    words = "The quick brown fox jumps over internationalization_settings and customerAddressLine2 in /usr/local/share/applications/defaults.list".split()
    text = " ".join(words * 300)
    assert [s.kind for s in scanned(spark, [text])[0]] == []


def test_minified_json_is_scanned_in_proportion(spark):
    import time

    def took(n):
        line = "{" + ",".join(f'"password":"abc{i:05d}xyz"' for i in range(n)) + "}"
        rows = spark.createDataFrame([(1, line)], "doc_id long, text string")
        began = time.time()
        found = secrets.scan(rows).first()["spans"]
        assert len(found) == n and [line[s["start"] : s["end"]] for s in found[:2]] == ['password":"abc00000xyz', 'password":"abc00001xyz']
        return time.time() - began

    took(500)
    assert took(16_000) < 8 * took(4_000) + 2
