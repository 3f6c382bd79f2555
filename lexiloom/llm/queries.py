"""The queries opN_<name> of this subpackage and their SQL, over whole tables. Each derives its columns from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, crf_quality, exact_dedup, mixing, near_vectors, ngram_join, packing, phrases, pii, quality_rules, sharding, token_counts, url_filter
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As the files lie: blocks are numbered by row, and a task that runs again must read the same rows in the same order.
    return token_counts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


def op7_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.FIGURES, "base_failed", "kept", "lost_words")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), shingle=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_token_counts, op3_best_fit_packing, op4_crf_quality, op5_exact_dedup, op6_virtual_slots, op7_cube_mixing, op8_pii, op9_quality_rules, op10_ngram_join, op11_collocations, op12_near_vectors, op13_token_alignment)}

WS = r"[\x20\x09-\x0D]+"
_OP5 = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM n JOIN g USING (norm)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in url_filter.RULES)


def _hits(terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::BIGINT" for t in terms) + ")"


_OP1 = rf"""
WITH p AS (SELECT page_id, row_number() OVER () AS n, coalesce(translate(url, '{_UPPER}', '{_LOWER}'), '') AS u,
  CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, n, u, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES {_RULES}) AS r(rule, verdict, rule_host, rule_path)),
m AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n),
c AS (SELECT *, {_hits(url_filter.STRICT)} AS n_strict, {_hits(url_filter.SOFT)} AS n_soft FROM h LEFT JOIN m USING (n))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM c"""

_OP9 = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT doc_id, r, source, text, list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
v AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS v FROM g),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM v) WHERE n > 1),
e AS (SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r),
l0 AS (SELECT r, source, text, unnest(lines) AS line FROM w),
l AS MATERIALIZED (SELECT r, source, md5(text) AS h, lower(regexp_replace(regexp_replace(line, '^{WS}|{WS}$', '', 'g'), '{WS}', ' ', 'g')) AS line FROM l0),
hosts AS (SELECT source, count(DISTINCT md5(text)) AS host_docs FROM t GROUP BY source),
often AS (SELECT l.source, line FROM l JOIN hosts ON l.source IS NOT DISTINCT FROM hosts.source GROUP BY l.source, line, host_docs HAVING count(DISTINCT h) > 5 AND (count(DISTINCT h) > 0.1 * host_docs OR count(DISTINCT h) > 10000)),
lost AS (SELECT r, sum(len(string_split(l.line, ' ')))::BIGINT AS lost_words FROM l JOIN often ON l.source IS NOT DISTINCT FROM often.source AND l.line = often.line GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{WS}', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words FROM w LEFT JOIN e USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT n_words - lost_words < 0.5 * n_words AS kept FROM f"""

_OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS ks(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::BIGINT AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, f AS a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS tail FROM c, (VALUES (1), (2), (3)) AS js(j) WHERE j < k),
scored AS (SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score FROM cut JOIN f x ON cut.lang = x.lang AND head = x.phrase JOIN f y ON cut.lang = y.lang AND tail = y.phrase),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(f) AS longer FROM c, (VALUES (2), (3)) AS ms(m), (VALUES (1), (2), (3)) AS starts(i) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
kept AS (SELECT lowest.*, n FROM lowest JOIN sizes USING (lang) LEFT JOIN inside ON lowest.lang = inside.lang AND lowest.phrase = inside.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000"""

_OP12 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS MATERIALIZED (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE e IS NOT NULL AND list_aggregate(list_transform(e, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0 AND list_dot_product(e, e) > 0),
link AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.95),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON b = r GROUP BY a),
n AS (SELECT a, count(*)::BIGINT AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN comp ON r = comp.a LEFT JOIN n ON r = n.a"""

#: In order of the operators; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op1_url_filter": _OP1, "op5_exact_dedup": _OP5, "op9_quality_rules": _OP9, "op11_collocations": _OP11, "op12_near_vectors": _OP12}
