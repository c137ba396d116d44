"""The registered queries of this package, with SQL where SQL can say them on whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from gaugeframe.catalogue.registry import Tables, query
from gaugeframe.llm import alignment, bpe, conversation_repair, decontamination, exact_dedup, near_dedup, packing, quality, repeats, secret_scan, sharding, toxicity, url_filter

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

OP1_SQL = r"""
WITH split AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/'
  END AS rule
  FROM split)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op1_url_filter", OP1_SQL)
def op1_url_filter(tables: Tables):
    rules = tables.spark.createDataFrame(RULES, url_filter.RULES)
    return url_filter.judge_urls(tables("pages"), rules, "page_id", "url")


@query("op2_suffix_dedup")
def op2_suffix_dedup(tables: Tables):
    return repeats.repeated_spans(tables("documents"), "doc_id", "text").drop("spans")


@query("op3_bpe")
def op3_bpe(tables: Tables):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode_ids(bpe.encode_texts(tables("documents"), "doc_id", "text", path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP4_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
ranked AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256
  FROM normal)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""


@query("op4_exact_dedup", OP4_SQL)
def op4_exact_dedup(tables: Tables):
    return exact_dedup.exact_classes(tables("documents"), "doc_id", "text")


OP5_SQL = r"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1),
gaps AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM again),
repeated AS (SELECT doc_id, sum(g) AS n_repeat_words FROM gaps GROUP BY doc_id),
base AS (
  SELECT s.doc_id, lang, source, len(words) AS n_words, len(lines) AS n_lines,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN repeated r ON s.doc_id = r.doc_id),
long AS (
  SELECT lang, source, 'word_length' AS m, 100 * word_chars // n_words AS v FROM base WHERE n_words > 0
  UNION ALL SELECT lang, source, 'symbol_share', 1000 * n_symbols // n_words FROM base WHERE n_words > 0
  UNION ALL SELECT lang, source, 'dup_line_share', 1000 * n_dup_lines // n_lines FROM base WHERE n_lines > 0
  UNION ALL SELECT lang, source, 'repeat_share', 1000 * n_repeat_words // n_words FROM base WHERE n_words > 0),
sketch AS (
  SELECT lang, source, m, CASE WHEN v < 32 THEN v ELSE (v >> CAST(length(bin(v)) - 5 AS BIGINT)) << CAST(length(bin(v)) - 5 AS BIGINT) END AS b
  FROM long),
ranked AS (
  SELECT lang, source, m, b,
         count(*) OVER (PARTITION BY lang, source, m ORDER BY b) AS u0, count(*) OVER (PARTITION BY lang, source, m) AS n0,
         count(*) OVER (PARTITION BY lang, m ORDER BY b) AS u1, count(*) OVER (PARTITION BY lang, m) AS n1,
         count(*) OVER (PARTITION BY m ORDER BY b) AS u2, count(*) OVER (PARTITION BY m) AS n2
  FROM sketch),
q0 AS (SELECT lang, source, m, max(n0) AS n, min(CASE WHEN u0 * 4 >= n0 THEN b END) AS q1, min(CASE WHEN u0 * 4 >= n0 * 3 THEN b END) AS q3 FROM ranked GROUP BY lang, source, m),
q1 AS (SELECT lang, m, max(n1) AS n, min(CASE WHEN u1 * 4 >= n1 THEN b END) AS q1, min(CASE WHEN u1 * 4 >= n1 * 3 THEN b END) AS q3 FROM ranked GROUP BY lang, m),
q2 AS (SELECT m, min(CASE WHEN u2 * 4 >= n2 THEN b END) AS q1, min(CASE WHEN u2 * 4 >= n2 * 3 THEN b END) AS q3 FROM ranked GROUP BY m),
chosen AS (
  SELECT q0.lang, q0.source, q0.m,
         CASE WHEN q0.n >= 50 THEN q0.q1 WHEN q1.n >= 50 THEN q1.q1 ELSE q2.q1 END AS q1,
         CASE WHEN q0.n >= 50 THEN q0.q3 WHEN q1.n >= 50 THEN q1.q3 ELSE q2.q3 END AS q3
  FROM q0 JOIN q1 ON q0.lang IS NOT DISTINCT FROM q1.lang AND q0.m = q1.m JOIN q2 ON q0.m = q2.m),
limits AS (
  SELECT lang, source,
         max(CASE WHEN m = 'word_length' THEN q3 + 4 * (q3 - q1) + 200 END) AS wl_high, max(CASE WHEN m = 'word_length' THEN q1 - 4 * (q3 - q1) - 200 END) AS wl_low,
         max(CASE WHEN m = 'symbol_share' THEN q3 + 4 * (q3 - q1) + 100 END) AS s_high,
         max(CASE WHEN m = 'dup_line_share' THEN q3 + 4 * (q3 - q1) + 300 END) AS d_high,
         max(CASE WHEN m = 'repeat_share' THEN q3 + 4 * (q3 - q1) + 150 END) AS r_high
  FROM chosen GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND coalesce(100 * word_chars // n_words BETWEEN wl_low AND wl_high AND 1000 * n_symbols // n_words <= s_high
                      AND 1000 * n_dup_lines // n_lines <= d_high AND 1000 * n_repeat_words // n_words <= r_high, true) AS kept
FROM base b LEFT JOIN limits l ON b.lang IS NOT DISTINCT FROM l.lang AND b.source IS NOT DISTINCT FROM l.source
"""


@query("op5_quality_rules", OP5_SQL)
def op5_quality_rules(tables: Tables):
    return quality.judge_quality(tables("documents"), "doc_id", "text", "lang", "source")


@query("op6_minhash_near_dedup")
def op6_minhash_near_dedup(tables: Tables):
    return near_dedup.near_classes(tables("documents"), "doc_id", "text", width=3, percent=85)


@query("op7_best_fit_packing")
def op7_best_fit_packing(tables: Tables):
    return packing.pack(tables("documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


def _op8_sql() -> str:
    """The spans of each rule from the texts between its matches."""
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    parts = []
    for number, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, i, gaps, ms, length(ps[i]) AS part, {rule.least} AS least
  FROM (SELECT doc_id, gaps, ms, ps, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS gaps, regexp_extract_all(coalesce(text, ''), '{pattern}', 0) AS ms,
                     regexp_extract_all(coalesce(text, ''), '{pattern}', {rule.group}) AS ps FROM documents) AS a{number}) AS b{number}""")
    return f"""
WITH found AS ({" UNION ALL ".join(parts)}),
spans AS (
  SELECT doc_id, k, kind,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) - length(ms[i]) AS s, length(ms[i]) AS n
  FROM found WHERE part >= least),
texts AS (SELECT doc_id, k, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS span FROM spans),
listed AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(span, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans
  FROM texts GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""


@query("op8_secret_scan", _op8_sql())
def op8_secret_scan(tables: Tables):
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    found = secret_scan.find_spans(tables("documents"), "doc_id", "text", rules)
    base = F.filter("found", lambda s: s["kind"] < len(secret_scan.BASE_RULES))
    count = lambda n: F.size(F.filter("found", lambda s: s["kind"] == n)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.spelled(base, rules), 256).alias("base_sha256"), secret_scan.spelled(F.col("found"), rules).alias("spans"),
    )


SHARD_BYTES = 1 << 20

OP9_SQL = f"""
WITH hashed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS bits
  FROM documents),
deep AS (SELECT *, unnest(range(0, 61)) AS depth FROM hashed),
sums AS (
  SELECT depth, substr(bits, 1, depth) AS shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM deep GROUP BY ALL),
fit AS (
  SELECT d.doc_id, d.n_bytes, s.shard, CAST(s.depth AS INTEGER) AS depth, shard_bytes, shard_rows, row_number() OVER (PARTITION BY d.doc_id ORDER BY s.depth) AS r
  FROM deep d JOIN sums s ON d.depth = s.depth AND substr(d.bits, 1, d.depth) = s.shard
  WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1)
SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_rows FROM fit WHERE r = 1
"""


@query("op9_sharding", OP9_SQL)
def op9_sharding(tables: Tables):
    return sharding.assign_shards(tables("documents"), "doc_id", "text", SHARD_BYTES)


@query("op10_toxicity")
def op10_toxicity(tables: Tables):
    docs = tables("documents")
    model = toxicity.learn(docs, tables("labels"), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, model, "doc_id", "text")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op11_token_alignment")
def op11_token_alignment(tables: Tables):
    path = public_tokenizers.path
    return alignment.score_links(tables("documents"), "doc_id", "text", path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM item_windows) AS sizes ON len(w) >= n)),
hits AS (SELECT doc_id, n, i, item_id FROM doc_windows JOIN item_windows USING (n, g)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) WHERE k IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


@query("op12_decontamination", OP12_SQL)
def op12_decontamination(tables: Tables):
    found = decontamination.benchmark_hits(tables("documents"), "doc_id", "text", tables("benchmark"), "item_id", "text")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query("op13_conversation_repair")
def op13_conversation_repair(tables: Tables):
    turns = tables("conversations")
    repair = conversation_repair.Repair(conversation_repair.damaged(turns, "conv_id", "turn", "role", "text"))
    return conversation_repair.summarize(turns, "conv_id", repair)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(tables: Tables):
    return corpus_pipeline.run(tables.spark, tables.folder)
