"""Registered queries of the llm operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import (classifier, clustering, conversations, decontaminate, lm_score, near_dedup, packing, quality_rules, reference_dedup,
                           secrets, suffix_dedup, token_counts, url_filter)
from cohortkit.llm.common import read_table, stage, stage_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


# White space, symbols, thresholds and rules are the fixed values of the contract, written out for SQL.
SQL_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT row_number() OVER () AS rid, * FROM d),
n AS (SELECT rid, doc_id, source, t, w, len(w) AS n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM k),
tri AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM k WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM rep, range(0, 3) AS s(o) GROUP BY rid),
f AS (SELECT rid, doc_id, source, n_words, word_chars, n_symbols, len(l) AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM n LEFT JOIN cov USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             100 * n_symbols > 10 * word_chars AS s1, 100 * n_symbols > 3 * word_chars AS m1,
             100 * n_dup_lines > 60 * n_lines AS s2, 100 * n_dup_lines > 30 * n_lines AS m2,
             100 * n_repeat_words > 50 * n_words AS s3, 100 * n_repeat_words > 35 * n_words AS m3,
             word_chars > 20 * n_words OR word_chars < 2 * n_words AS s4,
             word_chars > 15 * n_words OR word_chars < 3 * n_words AS m4 FROM f),
long AS (SELECT source, r, f FROM j, LATERAL (VALUES (1, m1), (2, m2), (3, m3), (4, m4)) AS v(r, f)),
h AS (SELECT source, r, count(*) AS n, sum(f::INT) AS f FROM long GROUP BY ALL),
p AS (SELECT r, avg(f / n) AS m, var_pop(f / n) AS v FROM h GROUP BY r),
q AS (SELECT r, m, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM p),
b AS (SELECT source, bool_or(r = 1 AND x) AS b1, bool_or(r = 2 AND x) AS b2, bool_or(r = 3 AND x) AS b3,
             bool_or(r = 4 AND x) AS b4
      FROM (SELECT source, r, (f + m * s) / (n + s) > 0.25 AS x FROM h JOIN q USING (r)) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR s1 OR s2 OR s3 OR s4 OR (m1 AND b1) OR (m2 AND b2) OR (m3 AND b3) OR (m4 AND b4)) AS kept
FROM j JOIN b ON j.source IS NOT DISTINCT FROM b.source
"""

SQL_URL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://')
                  THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
s AS (SELECT row_number() OVER () AS rid, page_id,
             translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                      ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT rid, arg_max(struct_pack(rule := h || p, v := v), length(h || p)) AS best
      FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM s LEFT JOIN m USING (rid)
"""


@query("op3_url_filter", SQL_URL)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.rules_table(spark, url_filter.RULES))


@query("op5_quality_rules", SQL_QUALITY)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


# The 10-word window, word class and case rule are the fixed values of the contract.
SQL_DECONTAMINATE = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, list_slice(w, i, i + least(10, len(w)) - 1) AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
occ AS (SELECT rid, k, i, list_slice(w, i, i + k - 1) AS g
        FROM (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM doc, sizes WHERE len(w) >= k)),
hit AS (SELECT rid, occ.k, i, item_id FROM occ JOIN win ON occ.k = win.k AND occ.g = win.g),
n AS (SELECT rid, count(DISTINCT i + o) AS n_hit
      FROM (SELECT rid, i, unnest(range(0, k)) AS o FROM hit) GROUP BY rid),
m AS (SELECT rid, count(DISTINCT item_id) AS n_items,
             sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""


@query("op2_decontaminate", SQL_DECONTAMINATE)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.search(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"]))


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


# Five words, 75 per cent, white space and case rule are the fixed values of the contract.
SQL_NEAR_DEDUP = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS g, list_slice(w, i, i + 4) AS x
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.x = b.x AND a.doc_id < b.doc_id
          GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
          WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT id, b FROM reach JOIN edge ON r = a),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN comp ON doc_id = id LEFT JOIN n USING (doc_id)
"""


@query("op1_near_dedup", SQL_NEAR_DEDUP)
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op6_lm_score")
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good; background: all documents."""
    good = read_table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_score.score(read_table(spark, sf_dir, "documents"), good)


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document counted, recounted by a second tokenizer version, texts with other white space than single spaces
    revised under both versions, exact copies deleted, one batch sent twice."""
    docs = read_table(spark, sf_dir, "documents")
    store = token_counts.TokenStore(spark, stage_path(spark, "token-counts"))
    store.commit("1", docs, versions=["words-1"])
    store.commit("2", docs, versions=["byte_bpe_50k"])
    plain = docs.withColumn("text", F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    store.commit("3", plain.filter(F.col("text") != docs["text"]))
    store.commit("4", deletes=stage(token_counts.exact_copies(docs), "copies"))
    store.commit("2", docs, versions=["byte_bpe_50k"])
    return store.totals()


# The 50-word window and white space are the fixed values of the contract.
SQL_PASSAGES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT rid, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
gone AS (SELECT DISTINCT rid, i + o AS i FROM (SELECT rid, i FROM win JOIN firsts USING (g) WHERE first < doc_id), range(0, 50) AS s(o)),
lists AS (SELECT rid, count(*) AS n, list(i) AS at FROM gone GROUP BY rid),
words AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (rid) LEFT JOIN kept USING (rid)
"""


@query("op11_reference_dedup", SQL_PASSAGES)
def op11_reference_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_dedup.remove_passages(read_table(spark, sf_dir, "documents"))


def kmeans_sql(k: int = clustering.K, rounds: int = clustering.ROUNDS) -> str:
    """Plain k-means in long form; 64 components, 1024 and the seed 3 are the fixed values of the contract."""
    parts = ["""v0 AS (SELECT row_number() OVER () AS rid, vec_id, embedding AS e FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    v AS MATERIALIZED (SELECT rid, unnest(range(1, 65)) AS j, floor(1024 * unnest(e)::DOUBLE)::BIGINT AS x FROM v0)""",
             f"""c0 AS MATERIALIZED (SELECT k, j, x FROM v JOIN (
        SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM v0) USING (rid) WHERE k < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, k := k)) AS m FROM (
        SELECT rid, k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{i} c USING (j) GROUP BY rid, k) GROUP BY rid)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.k, c.j, coalesce((s - ((s % n) + n) % n) // n, c.x)::BIGINT AS x FROM c{i} c LEFT JOIN (
        SELECT m.k AS k, j, sum(x) AS s, count(*) AS n FROM a{i} JOIN v USING (rid) GROUP BY ALL) t ON c.k = t.k AND c.j = t.j)""")
    return f"""WITH {", ".join(parts)},
    h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
    SELECT vec_id, k::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
           (sum(m.d) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a{rounds} JOIN v0 USING (rid) JOIN h ON m.k = h.k"""


@query("op12_centroid_clustering", kmeans_sql())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(read_table(spark, sf_dir, "embeddings"))


# Damage kinds, costs, pattern and white space are the fixed values of the contract; every row extends the cheapest
# (cost, audit) of each state, a plain forward table beside the library's divide and conquer.
SQL_REPAIR = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS ck FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(ck, ''),
            lambda b: [ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END),
        4294967295) % 20 AS kind FROM raw),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key, copy) AS i
        FROM (SELECT *, md5(strlen(role)::VARCHAR || ':' || role || ':' || text) AS key FROM hurt)),
f AS MATERIALIZED (SELECT conv_id, turn, i, role, text, substr(role, 1, 1) AS ini,
        CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
             WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE 'fine' END AS fault FROM placed),
ins(p, x, c, a, r) AS (VALUES (0, 0, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
        (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
        (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])),
op(l, ini, x, y, c, r) AS (VALUES ('D', NULL, 0, 0, 3, NULL), ('D', NULL, 1, 1, 3, NULL), ('D', NULL, 2, 2, 3, NULL), ('D', NULL, 3, 3, 3, NULL),
        ('R', NULL, 0, 2, 2, 'user:'), ('R', NULL, 1, 2, 2, 'user:'), ('R', NULL, 2, 3, 2, 'assistant:'), ('R', NULL, 3, 2, 2, 'user:'),
        ('K', 's', 0, 1, 0, NULL), ('K', 'u', 0, 2, 0, NULL), ('K', 'u', 1, 2, 0, NULL), ('K', 'u', 3, 2, 0, NULL), ('K', 'a', 2, 3, 0, NULL)),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, struct_pack(c := 0, a := '', r := []::VARCHAR[]) AS w FROM (SELECT DISTINCT conv_id FROM f)
       UNION ALL
       SELECT conv_id, i, q, min(w) FROM (
         SELECT dp.conv_id, f.i, op.y AS q, struct_pack(
              c := dp.w.c + ins.c + op.c + CASE WHEN op.l <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END,
              a := dp.w.a || ins.a || op.l,
              r := list_concat(dp.w.r, list_concat(ins.r, CASE op.l WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
                                                          ELSE [op.r || f.text] END))) AS w
         FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
         JOIN ins ON ins.p = dp.q JOIN op ON op.x = ins.x AND (op.ini IS NULL OR op.ini = f.ini)
              AND (op.l = 'D' OR f.fault NOT IN ('blank', 'duplicate'))) GROUP BY conv_id, i, q),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated FROM f GROUP BY conv_id),
bad AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (
             SELECT conv_id, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f) GROUP BY conv_id),
fin AS (SELECT dp.conv_id, min(struct_pack(c := dp.w.c + ins.c, a := dp.w.a || ins.a, r := list_concat(dp.w.r, ins.r))) AS w
        FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i JOIN ins ON ins.p = dp.q AND ins.x IN (0, 3)
        GROUP BY dp.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost,
       coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op13_conversation_repair", SQL_REPAIR)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return conversations.digest(conversations.repair(conversations.damage(rows)), rows)
