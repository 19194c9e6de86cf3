"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import backoff_lm, decontaminate, exact_dedup, html_text, importance, line_dedup, minhash, prefix_trie, secrets, sentencepiece_sampling, suffix_dedup, topk_search, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_list(spans):
    """start:end of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))


#: A document is rejected from this score on.
TOXIC_FROM = 0.7


def toxicity_machine(docs: DataFrame, labels: DataFrame) -> toxicity.Machine:
    """Trained on the labels of documents whose crc32(doc_id as text) mod 3 is not 1."""
    return toxicity.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_machine(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


#: Where the public tokenizers lie; the files stay there.
TOKENIZERS = "/opt/tokenizers"
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL) -> DataFrame:
    """Sampled segmentations of every document: pieces, their number, and whether they decode to the text (null as empty)."""
    docs = table(spark, sf_dir, "documents")
    coded = sentencepiece_sampling.sample_encode(docs, model_file, with_text=True)
    return coded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", F.sha2("decoded", 256).alias("decoded_sha256"), F.col("lossless"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10, spans=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_units", "n_removed", "n_removed_chars", span_list(F.col("spans")).alias("spans"), "text")


def op5_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines, removed however short and alone they stand."""
    found = line_dedup.remove_repeats(table(spark, sf_dir, "documents"), unit="line", min_words=1)
    return found.select("doc_id", "n_units", "n_removed", "n_removed_chars", span_list(F.col("spans")).alias("spans"), "text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    spans, base = F.col("spans"), secrets.digest(F.col("spans"), base_only=True)
    kinds = [secrets.count_kind(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *kinds, F.sha2(base, 256).alias("base_sha256"), secrets.digest(spans, base_only=False).alias("spans"))


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_lm.score(table(spark, sf_dir, "documents"), order=3)
    return found.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100, with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the conversations rebuilt with shared openings."""
    return prefix_trie.trie(*prefix_trie.share_openings(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gumbel top 5 % of the documents of 20 words and more, by hashed n-gram gains towards the benchmark."""
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every row whose vec_id is divisible by 20."""
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sentencepiece, op3_decontamination, op4_html_text, op5_line_dedup, op5_line_dedup_all, op6_exact_dedup, op7_minhash, op8_secrets, op9_backoff_lm, op10_suffix_dedup, op11_prefix_trie, op12_importance, op13_topk_search)}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The units of a text, each with what ends it.
SENTENCES, LINES = r"[^\n]*?(?:[.!?][ \t\r\x0b\x0c]+|\n|\z)", r"[^\n]*(?:\n|\z)"


def _repeats_sql(unit: str, min_words: int) -> str:
    return rf"""
WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '{unit}'), lambda x: x <> '') AS l FROM documents),
u AS (SELECT doc_id, generate_subscripts(l, 1) AS p, unnest(l) AS u FROM l),
n AS (SELECT doc_id, p, u, trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM u),
r AS (SELECT doc_id, p, u, t = '' AS blank, len(string_split(t, ' ')) AS w, t <> '' AND row_number() OVER (PARTITION BY t ORDER BY doc_id, p) > 1 AS again,
        sum(length(u)) OVER (PARTITION BY doc_id ORDER BY p) - length(u) AS s FROM n),
g AS (SELECT *, count(*) FILTER (NOT again AND NOT blank) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
x AS (SELECT *, again AND sum(w) FILTER (again) OVER (PARTITION BY doc_id, run) >= {min_words} AS gone FROM g),
y AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, sum(length(u)) FILTER (gone) AS n_removed_chars,
  string_agg(CAST(s AS BIGINT) || ':' || CAST(s + length(u) AS BIGINT), ',' ORDER BY p) FILTER (gone) AS spans,
  string_agg(u, '' ORDER BY p) FILTER (NOT gone) AS text
  FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(n_removed_chars, 0) AS n_removed_chars,
  coalesce(spans, '') AS spans, coalesce(y.text, '') AS text
FROM (SELECT doc_id FROM documents) d LEFT JOIN y USING (doc_id)"""


#: CRC-32 of a string without other than ASCII characters, from its table made by rule.
CRC = """
crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS crc_of FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(256) r(i)))"""


def _crc_sql(column: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({column}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, crc_of[(xor(c, b) % 256) + 1])), 4294967295)"


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The table of CRC-32, made by rule.
CRC_OF = f"[{','.join(map(str, importance.TABLE.tolist()))}]"

ORACLES = {
    "op12_importance": rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{WORDS}') AS w FROM documents),
b AS (SELECT regexp_extract_all({LOWERED}, '{WORDS}') AS w FROM benchmark),
dg AS MATERIALIZED (SELECT r, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS n FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL),
bg AS MATERIALIZED (SELECT array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS n FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL),
h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM dg UNION SELECT g FROM bg)),
c AS MATERIALIZED (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c // 256, {CRC_OF}[(xor(c, b) % 256) + 1])), 4294967295) % 10000 AS bucket FROM h),
s AS (SELECT bucket, sum(n) AS n FROM dg JOIN c USING (g) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS n FROM bg JOIN c USING (g) GROUP BY bucket),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT r, sum(dg.n) AS n, sum(dg.n * gain) AS weight FROM dg JOIN c USING (g) JOIN gain USING (bucket) GROUP BY r),
z AS (SELECT d.r, doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN f USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM k) // 100 THEN rank END AS rank FROM z LEFT JOIN k USING (r)""",
    "op11_prefix_trie": rf"""
WITH {CRC},
t AS (SELECT conv_id AS c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS m, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(m ORDER BY p) AS l FROM t GROUP BY c),
h AS (SELECT c, l, {_crc_sql("CAST(c AS VARCHAR)")} % 4 AS h FROM l, crc_table),
b AS MATERIALIZED (SELECT h.c, list_concat(coalesce(s.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN l s ON s.c = h.c - h.c % 20),
m AS MATERIALIZED (SELECT c, d, l[1:d] AS k, d = len(l) AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM b)),
g AS MATERIALIZED (SELECT d, k, min(c) AS c, count(*) AS n, max(w) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM m GROUP BY d, k),
n AS MATERIALIZED (SELECT m.c AS member, g.c, g.d FROM m JOIN g ON m.d = g.d AND m.k = g.k),
p AS (SELECT g.c, g.d, g.n, g.w, g.ids, n.c AS parent FROM g LEFT JOIN n ON n.member = g.c AND n.d = g.d - 1),
q AS (SELECT p.*, coalesce(x.n_children, 0) AS n_children FROM p LEFT JOIN (SELECT parent, d - 1 AS d, count(*) AS n_children FROM p WHERE d > 0 GROUP BY ALL) x ON x.parent = p.c AND x.d = p.d),
s AS (SELECT n.c, n.d, count(*) FILTER (q.n_children = 0) AS n_leaves, sum((q.n - 1) * q.w) AS saved FROM q JOIN n ON n.member = q.c AND n.d <= q.d GROUP BY n.c, n.d)
SELECT q.c AS conv_id, q.d AS depth, q.parent AS parent_conv_id, q.n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(q.ids) AS ends_sha256
FROM q JOIN s ON s.c = q.c AND s.d = q.d""",
    "op13_topk_search": """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.i <> c.i WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_backoff_lm": rf"""
WITH l AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM l)),
c1 AS (SELECT c, count(*) AS n FROM p GROUP BY c),
c2 AS (SELECT b, c, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL),
c3 AS (SELECT a, b, c, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT p.doc_id, CASE WHEN c3.n >= 2 THEN ln(c3.n / ab.n) WHEN c2.n >= 2 THEN CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END + ln(c2.n / m.n)
    ELSE least(i - 1, 2) * ln(0.4) + ln(c1.n / (SELECT count(*) FROM p)) END AS v, i > 1 AND coalesce(CASE WHEN i > 2 THEN c3.n ELSE c2.n END, 0) < 2 AS backed
  FROM p JOIN c1 ON c1.c = p.c LEFT JOIN c2 ON c2.b = p.b AND c2.c = p.c LEFT JOIN c3 ON c3.a = p.a AND c3.b = p.b AND c3.c = p.c
  LEFT JOIN c2 ab ON ab.b = p.a AND ab.c = p.b LEFT JOIN c1 m ON m.c = p.b),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (backed) AS k, sum(v) AS v FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(k, 0) AS n_backoff, round(coalesce(v, 0), 4) AS log_score, round(v / n, 4) AS mean_log_score
FROM (SELECT doc_id FROM documents) d LEFT JOIN t USING (doc_id)""",
    "op8_secrets": secrets.oracle_sql(),
    "op6_exact_dedup": f"""
WITH n AS (SELECT doc_id, {LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""",
    "op5_line_dedup": _repeats_sql(SENTENCES, 20),
    "op5_line_dedup_all": _repeats_sql(LINES, 1),
    "op3_decontamination": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ik AS (SELECT item_id, w, least(10, len(w)) AS k FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ik)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, win.k AS k, item_id FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op7_minhash": rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + k - 1], ' ')) AS s
  FROM (SELECT doc_id, w, least(3, len(w)) AS k, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM dw WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
top AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, least(dw.doc_id, coalesce(top.m, dw.doc_id)) AS component_id,
       dw.doc_id <= coalesce(top.m, dw.doc_id) AS kept
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN top ON top.a = dw.doc_id""",
}
