"""The queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepair, chosen_path, codebooks, content_sort, kdshard, packing, preferences, qgram, repair, secrets, suffix_dedup, toxicity, urlfilter
from .common import table

SHARDS = 24
#: URL rules: verdict, host, path. Fixed values.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Hosts whose pages make up the list of blocked URLs. Fixed values.
LISTED_HOSTS = r"(^|[.-])(casino|bets|pills|win)([.-]|$)"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    s = F.col("secrets")
    return found.select(
        "doc_id",
        *[secrets.count_of(s, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.secret_spans(s, True), 256).alias("base_sha256"),
        secrets.secret_spans(s, False).alias("spans"),
    )


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = kdshard.kd_shards(table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.first_turn_pairs(preferences.conversations(table(spark, sf_dir, "conversations")))
    made = preferences.format_preferences(pairs)
    masks = [preferences.mask_text(F.col(c)).alias(c) for c in ("chosen_mask", "rejected_mask")]
    return made.select("pair_id", "prompt_turns", "prompt", "chosen_text", "rejected_text", *masks, "usable")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(urlfilter.url_host(F.col("url")).rlike(LISTED_HOSTS)).select(urlfilter.canonical_url(F.col("url")).alias("listed_url"))
    return urlfilter.filter_urls(pages, listed, "listed_url", URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary, with_ids=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = qgram.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.min(F.struct("edits", "start", "end", "item_start")).alias("best")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.item_start", "best.start", "best.end", "best.edits")


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = content_sort.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold=80)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks.codebooks_digest(books)).alias("codebooks_sha256"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytepair.encode_texts(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, with_ids=False)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_kd_sharding": op2_kd_sharding,
    "op3_preferences": op3_preferences,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_content_sort": op7_content_sort,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_chosen_path": op9_chosen_path,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_conversation_repair": op13_conversation_repair,
}

def _any_case(words: str) -> str:
    """A pattern's ASCII letters in either case, spelled out as classes: (?i) would also take letters that fold to ASCII ones."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def _secrets_sql() -> str:
    sep, value = r"""["'']?\x20*[:=]\x20*["'']?""", "[A-Za-z0-9+/_.=-]+"
    patterns = {
        "assign": f"({_any_case('password|passwd|secret|token|api_?key')}){sep}({value})",
        "access": "AKIA[A-Z0-9]{12,}",
        "hex": "[0-9a-f]{32,}",
        "weak_id": f"(?:{_any_case('access_?key_?id|client_?id|user(?:name)?|login')}){sep}[A-Za-z0-9_.@-]{{4,}}|AKIA[A-Z0-9]{{4,}}",
        "weak_secret": "[A-Za-z0-9+/=_-]{20,}",
        "endpoint": f"""(?:{_any_case('https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp')})://[^\\x20\\x09-\\x0D"''<>]+|(?:{_any_case('host|endpoint|server')}){sep}[A-Za-z0-9.-]+(?::[0-9]+)?""",
    }
    every = " UNION ALL ".join(f"SELECT doc_id, {k} AS ord, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS b FROM t" for k, (kind, p) in enumerate(patterns.items()))
    near = lambda role: f"coalesce(start - max(CASE WHEN role = '{role}' THEN stop END) OVER b <= 200, false) OR coalesce(min(CASE WHEN role = '{role}' THEN start END) OVER a - stop <= 200, false)"
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({every}), p AS (
            SELECT doc_id, ord, kind, m[i] AS s, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
            FROM m, unnest(range(1, len(m) + 1)) AS u(i)
        ), r AS (
            SELECT *, start + length(s) AS stop, CASE WHEN kind IN ('access', 'weak_id') THEN 'id' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END AS role FROM p
            WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(s, '{patterns["assign"]}', 2)) >= 8
                            WHEN 'weak_id' THEN NOT (starts_with(s, 'AKIA') AND length(s) >= 16)
                            WHEN 'weak_secret' THEN regexp_full_match(s, '[A-Za-z0-9+/]{{20,}}={{0,2}}') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]')
                            ELSE true END
        ), n AS (
            SELECT *, {near("id")} AS by_id, {near("secret")} AS by_secret, {near("endpoint")} AS by_endpoint FROM r
            WINDOW b AS (PARTITION BY doc_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY doc_id ORDER BY start, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ), l AS (
            SELECT doc_id, ord, start, kind, kind || ':' || start || ':' || stop AS span FROM n
            WHERE ord < 3 OR (kind = 'weak_id' AND by_secret) OR (kind = 'weak_secret' AND (by_id OR by_endpoint)) OR (kind = 'endpoint' AND by_id AND by_secret)
        ), g AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                   string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM l GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN g USING (doc_id)
    """


def _codes_sql() -> str:
    nearest = lambda book: f"SELECT vec_id, p, label, q, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT vec_id, p, label, q, e, list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) AS d FROM pts JOIN {book} USING (p)) GROUP BY vec_id, p, label, q"
    moved = lambda book, given: f"""
        SELECT p, e, coalesce(m, c) AS c FROM {book} LEFT JOIN (
            SELECT p, e, list(CAST(floor((s - ((s % n) + n) % n) / n) AS BIGINT) ORDER BY i) AS m FROM (
                SELECT p, e, i, sum(q[i]) AS s, count(*) AS n FROM {given}, unnest(range(1, len(q) + 1)) AS u(i) GROUP BY p, e, i) GROUP BY p, e
        ) USING (p, e)"""  # noqa: E731
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pts AS MATERIALIZED (
            SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS q FROM kept, unnest(range(16)) AS u(p)
        ), b0 AS MATERIALIZED (
            SELECT p, e, q AS c FROM pts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < 64
        ), a0 AS MATERIALIZED ({nearest("b0")}), b1 AS MATERIALIZED ({moved("b0", "a0")}), a1 AS MATERIALIZED ({nearest("b1")}),
        b2 AS MATERIALIZED ({moved("b1", "a1")}), a2 AS MATERIALIZED ({nearest("b2")}), coded AS (
            SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label
        ), books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
    """


ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op1_secret_scan": _secrets_sql(),
    "op7_content_sort": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
    "op3_preferences": r"""
        WITH t AS (
            SELECT conv_id, turn, replace(replace(coalesce(role, 'user'), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS role, replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id
        ), k AS (
            SELECT *, row_number() OVER (PARTITION BY turns[1] ORDER BY conv_id) - 1 AS k FROM c
        ), w AS (
            SELECT conv_id, turns, k, lead(turns) OVER (PARTITION BY turns[1] ORDER BY conv_id) AS partner,
                   list_aggregate(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant'), 'max') AS last FROM k
        ), p AS (
            SELECT conv_id AS pair_id, turns AS c, coalesce(partner, CASE WHEN last IS NOT NULL THEN list_concat(turns[1:last - 1],
                   [struct_pack(role := 'assistant', text := coalesce(list_filter(turns[1:last - 1], lambda x: x.role = 'assistant')[-1].text, ''))]) END, []) AS r
            FROM w WHERE k % 2 = 0
        ), n AS (
            SELECT *, CAST(coalesce(nullif(list_position(list_transform(range(1, least(len(c), len(r)) + 1), lambda i: c[i] = r[i]), false), 0) - 1, least(len(c), len(r))) AS INTEGER) AS prompt_turns FROM p
        ), s AS (
            SELECT pair_id, prompt_turns, c[1:prompt_turns] AS p, c[prompt_turns + 1:] AS c, r[prompt_turns + 1:] AS r FROM n
        ), o AS (
            SELECT pair_id, prompt_turns,
                   array_to_string(list_transform(p, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS prompt,
                   array_to_string(list_transform(c, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS chosen_text,
                   array_to_string(list_transform(r, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS rejected_text,
                   list_transform(range(1, len(c) + 1), lambda i: coalesce(list_sum(list_transform(c[1:i - 1], lambda x: length(x.role) + length(x.text) + 24)), 0)) AS ca,
                   list_transform(range(1, len(r) + 1), lambda i: coalesce(list_sum(list_transform(r[1:i - 1], lambda x: length(x.role) + length(x.text) + 24)), 0)) AS ra, c, r
            FROM s
        ), m AS (
            SELECT pair_id, prompt_turns, prompt, chosen_text, rejected_text,
                   coalesce(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: CAST(CAST(ca[i] + 22 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(ca[i] + 32 + length(c[i].text) AS BIGINT) AS VARCHAR)), ','), '') AS chosen_mask,
                   coalesce(array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: CAST(CAST(ra[i] + 22 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(ra[i] + 32 + length(r[i].text) AS BIGINT) AS VARCHAR)), ','), '') AS rejected_mask
            FROM o
        )
        SELECT *, chosen_mask <> '' AND rejected_mask <> '' AS usable FROM m
    """,
    "op4_url_filter": r"""
        WITH u AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
                   list_aggregate(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), 'string_agg', '&') AS query
            FROM pages
        ), c AS (
            SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
                   || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical
            FROM u
        ), r(said, rule_host, start) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), best AS (
            SELECT page_id, arg_max(rule_host || start, length(rule_host || start)) AS rule, arg_max(said, length(rule_host || start)) AS said
            FROM c JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, start)
            GROUP BY page_id
        ), listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|[.-])(casino|bets|pills|win)([.-]|$)'))
        SELECT c.page_id, host, path, rule,
               coalesce(said, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, listed.canonical IS NOT NULL AS listed
        FROM c LEFT JOIN best USING (page_id) LEFT JOIN listed ON c.canonical = listed.canonical
    """,
}
