"""The queries of this subpackage: each applies one operator, with production parameters, to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, media, ngram_join, secrets, sentencepieces, suffix_dedup, token_counts, toxicity, url_filter

#: Token budget of op8.
LIMIT = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark, sf_dir):
    found = secrets.secret_scan(_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("strong", lambda p: p["rank"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    whole = F.array_sort(F.concat("strong", "extra"))
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.rendered(F.col("strong")), 256).alias("base_sha256"),
        secrets.rendered(whole).alias("spans")
    )


def op2_sentencepiece(spark, sf_dir):
    return sentencepieces.sentencepiece_encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_url_filters(spark, sf_dir):
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    kept = F.octet_length("kept").cast("long")
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_media_columns(spark, sf_dir):
    return media.digests(media.media_columns(media.store_texts(_table(spark, sf_dir, "documents"))))


def op8_token_counts(spark, sf_dir):
    counted = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    n = F.size("token_ends").cast("long")
    return counted.select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > LIMIT).alias("over_limit"),
        token_counts.cut_bytes(F.col("n_bytes"), F.col("token_ends"), LIMIT).alias("cut_bytes")
    )


def op9_decontamination(spark, sf_dir):
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated"
    )


def op10_chat_format(spark, sf_dir):
    return chat.chat_format(chat.with_tools(_table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP5_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p
), r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM q
), w AS (SELECT unnest(['casino', 'spam', 'adult', 'porn', 'warez', 'viagra', 'phishing']) AS word)
, s AS (SELECT page_id, host, path, rule, regexp_matches(host, '(^|[^a-z0-9])(casino|spam|adult|porn|warez|viagra|phishing)($|[^a-z0-9])') AS bad,
  list_distinct(list_concat(regexp_extract_all(host, '[a-z0-9]+'), regexp_extract_all(path, '[a-z0-9]+'))) AS tokens FROM r)
, c AS (SELECT t.token, count(*) AS n FROM s, unnest(s.tokens) AS t(token) GROUP BY 1)
, k AS (
  SELECT name, min_by(token, lpad(CAST(n AS VARCHAR), 20, '0') || token) AS token
  FROM (SELECT o.name, o.token, coalesce(c.n, 0) AS n
        FROM (VALUES ('net/', 'net'), ('example.net/en/', 'example'), ('example.net/en/', 'net'), ('example.net/en/', 'en'),
                     ('example.com/de/', 'example'), ('example.com/de/', 'com'), ('example.com/de/', 'de'), ('org/fr/', 'org'), ('org/fr/', 'fr')) o(name, token)
        LEFT JOIN c USING (token)) GROUP BY name
  UNION ALL SELECT word, word FROM w
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad THEN 'block' ELSE 'allow' END AS verdict,
       (SELECT count(*) FROM k WHERE list_contains(s.tokens, k.token)) AS rules_tried
FROM s
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles FROM w
), t AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, sha256(array_to_string(list_sort(shingles), chr(10))) AS of FROM s),
-- equal sets are one; pairs of others are counted by shared shingles
u AS MATERIALIZED (SELECT of, n, min(doc_id) AS node, count(*) AS n_same FROM t WHERE n > 0 GROUP BY ALL),
g AS MATERIALIZED (SELECT u.node, u.n, hash(x.shingle) AS h, x.shingle FROM u JOIN (SELECT doc_id, unnest(shingles) AS shingle FROM s) x ON x.doc_id = u.node),
links AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.shingle = b.shingle AND a.node < b.node AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM u UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b),
least AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)
SELECT t.doc_id, t.n::BIGINT AS n_shingles, coalesce(l.component, t.doc_id) AS component_id, coalesce(u.n_same, 1)::BIGINT AS n_same
FROM t LEFT JOIN u ON u.of = t.of AND u.n = t.n LEFT JOIN least l ON l.node = u.node
"""

OP6_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 400)) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d)),
s AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w SEMI JOIN (SELECT x FROM w GROUP BY x HAVING count(*) > 1) r USING (x)),
n AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s),
r AS MATERIALIZED (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM n GROUP BY ALL),
k AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS kept
  FROM (SELECT r.*, substr(d.h, 2 * lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1, 2 * (a - lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a))) AS piece FROM r JOIN d USING (doc_id)) GROUP BY doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP9_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS MATERIALIZED (SELECT item_id::VARCHAR AS item, words, least(13, len(words)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL) WHERE len(words) > 0),
iw AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(words[k : k + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS k FROM i)),
dw AS (SELECT doc_id, n, k, array_to_string(words[k : k + n - 1], ' ') AS w FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(words) >= n)),
m AS MATERIALIZED (SELECT dw.doc_id, dw.n, dw.k, iw.item FROM dw JOIN iw ON iw.n = dw.n AND iw.w = dw.w),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, n, k FROM m)) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)
"""

OP10_SQL = """
WITH m AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, length(coalesce(text, '')) % 6 AS k, turn % 4 AS q FROM conversations
), c AS (
  SELECT *, CASE q WHEN 1 THEN 'search' WHEN 3 THEN 'calculator' ELSE 'fetch' END AS name, CASE WHEN k <> 5 THEN 'c' || conv_id || '-' || turn END AS id,
         CASE q WHEN 1 THEN k BETWEEN 1 AND 4 AND n > 0 WHEN 3 THEN k % 2 = 0 ELSE k NOT IN (3, 4) END AS valid,
         CASE q WHEN 1 THEN json_object('limit', k, 'query', substr(text, 1, 20))
                 WHEN 3 THEN json_object('expression', substr(text, 1, 10), 'mode', CASE WHEN k % 2 = 0 THEN 'exact' ELSE 'guessed' END)
                 ELSE json_merge_patch(json_object('headers', json_array(CASE WHEN k = 3 THEN json_object('value', 'text') ELSE json_object('name', 'accept', 'value', 'text') END)),
                                       CASE WHEN k = 4 THEN '{}' ELSE json_object('url', 'https://host.example/' || turn) END) END AS arguments
  FROM m WHERE role = 'assistant'
), r AS (
  SELECT conv_id, turn, text, n, CASE WHEN q = 2 THEN turn - 1 ELSE turn + 1 END AS target FROM m WHERE role = 'user'
)
SELECT conv_id, turn, role, turn AS order_turn, 0 AS order_step, CAST(CASE WHEN k = 2 THEN 2 ELSE 1 END AS BIGINT) AS n_calls, CAST(valid AS BIGINT) AS n_valid, CAST(NULL AS BOOLEAN) AS linked,
       CAST(json_object('content', text, 'role', role, 'tool_calls',
         CASE WHEN k = 2 THEN json_array(json_object('arguments', arguments, 'id', coalesce(id, ''), 'name', name, 'valid', valid), json_object('id', '', 'name', '', 'valid', false))
              ELSE json_array(json_object('arguments', arguments, 'id', coalesce(id, ''), 'name', name, 'valid', valid)) END) AS VARCHAR) AS json
FROM c
UNION ALL
SELECT r.conv_id, r.turn, 'tool', CASE WHEN c.turn >= r.turn THEN c.turn ELSE r.turn END, CASE WHEN c.turn >= r.turn THEN 1 ELSE 0 END, 0, 0, c.id IS NOT NULL,
       CAST(json_object('content', CASE WHEN r.n % 2 = 0 THEN r.text ELSE CAST(json_object('n', r.n, 'text', r.text) AS VARCHAR) END, 'name', coalesce(c.name, ''), 'role', 'tool', 'tool_call_id', 'c' || r.conv_id || '-' || r.target) AS VARCHAR)
FROM r LEFT JOIN (SELECT * FROM c WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1) c ON c.conv_id = r.conv_id AND c.turn = r.target
UNION ALL
SELECT conv_id, turn, role, turn, 0, 0, 0, NULL, CAST(json_object('content', text, 'role', role) AS VARCHAR) FROM m WHERE role NOT IN ('assistant', 'user')
"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express."""
    return {"op3_ngram_jaccard_join": OP3_SQL, "op5_url_filters": OP5_SQL, "op6_suffix_dedup": OP6_SQL, "op9_decontamination": OP9_SQL, "op10_chat_format": OP10_SQL}
