"""Secret scans with DataFrame functions only: fixed patterns, and two character Markov models compared by log-likelihood ratio.

A first-order Markov model of random strings and one of ordinary identifiers are estimated from labelled samples (add-one
smoothing over 54 symbols: the letters of either case, a digit, anything else). Candidate tokens are runs of key characters;
one whose summed log ratio reaches a threshold, and that no pattern span overlaps, is added as kind ``markov``. Log ratios are
kept in thousandths as integers, so sums don't depend on their order.

A text is scanned in segments of some 4,000 characters, each ending where no pattern can go on: before a character that no match
contains, such as a comma, a brace or a line break, or before blanks outside an assignment. So the work grows with a text's length and
not with its square, and no match is cut; a longer run without such a place, such as one of key characters, is one segment.
"""

from __future__ import annotations

import base64
import hashlib
import math

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

#: Fixed patterns and the least length that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # runs of [0-9a-f]+ of at least 24 characters: the same spans
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Segments end at the first place after so many characters that no pattern spans: before a character that no match contains, or before
#: blanks that stand between neither a name nor a mark and a mark of assignment.
SEGMENT = r"""(?s).{4000,}?(?:(?=[^A-Za-z0-9+/_.=:\x20"'-])|(?<![:=\x20])(?=\x20+[^:=\x20])|\z)|.+"""

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = 54
#: Thousandths of the summed log ratio from which a token is taken for random: odds of exp(14) for it.
THRESHOLD = 14_000


def symbol_of(code: int) -> int:
    c = chr(code)
    return LETTERS.index(c) if c in LETTERS else 52 if c.isdigit() else 53


SYMBOL_OF = [symbol_of(i) for i in range(128)]


#: Words of ordinary identifiers.
PARTS = (
    "get set user name file path list item count index value key data time date type size page line text node tree map table row column "
    "query result error message server client request response session config option default update create delete insert select order "
    "group window function method class object string number double vector array batch stream source target parent child start end first "
    "last next previous current total average minimum maximum report account payment invoice product customer address contact email image"
).split()


def labelled_samples(n: int = 1500) -> list[tuple[str, int]]:
    """(value, random 0/1): bounded labelled samples, the same everywhere. Random ones follow from a hash: base64, upper-case base32
    and URL-safe base64. Ordinary ones are identifiers of two to four words in snake, camel, kebab and capital case, and paths."""
    digest = lambda i: hashlib.sha512(str(i).encode()).digest()
    made = [f(digest(i))[:40].decode().strip("=") for i in range(n // 3) for f in (base64.b64encode, base64.b32encode, base64.urlsafe_b64encode)]
    ordinary = []
    for i in range(n // 5):
        chosen = [PARTS[x % len(PARTS)] for x in digest(n + i)[: 2 + i % 3]]
        camel = chosen[0] + "".join(w.title() for w in chosen[1:])
        ordinary += ["_".join(chosen), camel, "-".join(chosen), "_".join(chosen).upper(), "/".join(chosen) + f"/{camel}{i % 100}"]
    return [(v, 1) for v in made] + [(v, 0) for v in ordinary]


def log_ratios(counts: dict[tuple[int, int], int]) -> list[int]:
    """counts: by (label, first symbol * 54 + second). The table of log P(random) - log P(ordinary), in thousandths."""
    total = {(k, a): SYMBOLS + sum(counts.get((k, a * SYMBOLS + b), 0) for b in range(SYMBOLS)) for k in (0, 1) for a in range(SYMBOLS)}
    p = lambda k, x: (1 + counts.get((k, x), 0)) / total[k, x // SYMBOLS]
    return [round(1000 * math.log(p(1, x) / p(0, x))) for x in range(SYMBOLS * SYMBOLS)]


def _symbols(token):
    table = F.lit(SYMBOL_OF)
    return F.transform(F.split(token, ""), lambda c: table[F.ascii(c)])


def _pairs(token):
    s = _symbols(token)
    return F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a * SYMBOLS + b)


def train(samples: DataFrame) -> list[int]:
    """``samples``: value (ASCII), random 0/1. At most 2 * 54 * 54 counts come to the driver."""
    pairs = samples.where("length(value) > 1").select("random", F.explode(_pairs(F.col("value"))).alias("pair"))
    rows = pairs.groupBy("random", "pair").count().collect()
    return log_ratios({(r[0], r[1]): r[2] for r in rows})


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text, pattern: str, kind: int):
    """Spans (start, kind, end, value) of all leftmost non-overlapping matches: what ``split`` leaves between them gives their places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state, pair):
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    spans = F.aggregate(pairs, zero, step, lambda s: s["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def _segments(text):
    """(text, start) of a text's segments; a short text is one."""
    cut = F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0))
    starts = F.aggregate(cut, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    many = F.zip_with(cut, F.slice(starts, 1, F.size(cut)), lambda x, at: F.struct(x.alias("text"), at.alias("start")))
    return F.when(F.length(text) < 4000, F.array(F.struct(text.alias("text"), F.lit(0).alias("start")))).otherwise(many)


def scan(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: id and ``spans``, an array of (start, kind, end, value) by start and kind, in code points with the
    end exclusive; kind counts in ``KINDS``. Null and empty texts have none; ids may repeat and may be null; an empty table gives an
    empty result; other columns are ignored."""
    spark: SparkSession = docs.sparkSession
    samples = spark.createDataFrame(labelled_samples(), "value string, random int") if samples is None else samples
    ratios = F.lit(train(samples))
    score = lambda s: F.aggregate(_pairs(s["value"]), F.lit(0), lambda t, p: t + ratios[p])

    def base_of(text):
        assign = F.filter(_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_replace(s["value"], ASSIGN_HEAD, "")) >= 6)
        access = F.filter(_spans(text, ACCESS, 1), lambda s: F.length(s["value"]) >= 20)
        return F.concat(assign, access, _spans(text, HEX, 2))

    def all_of(part):
        free = lambda s: ~F.exists(part["base"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        found = F.concat(part["base"], F.filter(F.filter(_spans(part["text"], TOKEN, 3), lambda s: score(s) >= threshold), free))
        return F.transform(found, lambda s: F.struct((s["start"] + part["start"]).alias("start"), s["kind"].alias("kind"), (s["end"] + part["start"]).alias("end"), s["value"].alias("value")))

    rows = docs.select(F.col(id_col).alias("id"), _segments(F.coalesce(F.col(text_col), F.lit(""))).alias("parts"))
    rows = rows.select("id", F.transform("parts", lambda p: F.struct(p["text"].alias("text"), p["start"].alias("start"), base_of(p["text"]).alias("base"))).alias("parts"))
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.flatten(F.transform("parts", all_of))).alias("spans"))


def digest(spans, base_only: bool):
    """kind:start:end of the spans, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"] < 3) if base_only else spans
    return F.concat_ws(",", F.transform(kept, lambda s: F.concat_ws(":", F.lit(list(KINDS))[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def oracle_sql() -> str:
    counts: dict[tuple[int, int], int] = {}
    for value, random in labelled_samples():
        s = [SYMBOL_OF[ord(c)] for c in value]
        for a, b in zip(s, s[1:], strict=False):
            counts[random, a * SYMBOLS + b] = counts.get((random, a * SYMBOLS + b), 0) + 1
    table = "[" + ",".join(map(str, log_ratios(counts))) + "]"

    # The patterns as the contract has them, not as the scan has them.
    names, value = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])", "[A-Za-z0-9+/_.=-]+"
    head = names + """["'']?\\x20*[:=]\\x20*["'']?"""

    def spans(pattern: str, kind: int) -> str:
        p = pattern
        return f"""SELECT doc_id, {kind} AS kind, unnest(list_transform(range(1, len(f) + 1), lambda i: struct_pack(s := list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0), v := f[i]))) AS m
FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS f, regexp_split_to_array(t, '{p}') AS g FROM d)"""

    symbol = lambda c: f"CASE WHEN strpos('{LETTERS}', {c}) > 0 THEN strpos('{LETTERS}', {c}) - 1 WHEN strpos('0123456789', {c}) > 0 THEN 52 ELSE 53 END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({spans(head + value, 0)} UNION ALL {spans("AKIA[A-Z0-9]+", 1)} UNION ALL {spans("[0-9a-f]+", 2)} UNION ALL {spans("[A-Za-z0-9+/_=-]{16,}", 3)}),
s AS (SELECT doc_id, kind, CAST(m.s AS BIGINT) AS b, CAST(m.s + length(m.v) AS BIGINT) AS e, m.v AS v FROM m),
base AS (SELECT doc_id, kind, b, e FROM s WHERE kind = 0 AND length(regexp_replace(v, '^{head}', '')) >= 6 OR kind = 1 AND length(v) >= 20 OR kind = 2 AND length(v) >= 24),
tok AS (SELECT doc_id, kind, b, e, string_split(v, '') AS c FROM s WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = s.doc_id AND x.b < s.e AND s.b < x.e)),
sym AS (SELECT doc_id, kind, b, e, list_transform(c, lambda x: {symbol("x")}) AS y FROM tok),
added AS (SELECT doc_id, kind, b, e FROM sym WHERE list_sum(list_transform(range(1, len(y)), lambda i: ({table})[y[i] * {SYMBOLS} + y[i + 1] + 1])) >= {THRESHOLD}),
al AS (SELECT *, ['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || b || ':' || e AS lab FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(lab, ',' ORDER BY b, kind) FILTER (kind < 3) AS bs, string_agg(lab, ',' ORDER BY b, kind) AS sp FROM al GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
