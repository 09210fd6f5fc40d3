"""Thin queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe_table, collocations, decontaminate, exact_dedup, langid, simhash, spelling, token_counts, token_store, toxicity, url_filter, warc_convert, wrapper_extract
from factloom.llm.shared import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_convert.archived(table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_bpe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_table.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extract.extracted(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: a row for each contaminated document."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("contaminated")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), spoil=199)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the URL filter: host, path and rule of every page, and the verdict where a rule gives it."""
    out = op6_url_filter(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_warc, op3_token_files, op4_token_counts, op5_bpe_table, op6_url_filter, op7_simhash, op8_wrapper_extract, op9_decontaminate, op10_language, op11_spelling, op12_toxicity, op13_collocations, url_rules)}

#: A SHA-1 in base 32: four times 40 bits, eight letters of five bits each.
BASE32_SQL = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 8 * 10 + 1)::INT, 10))::UBIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), 'string_agg', '')"
_HOST = "translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " ".join(
    f"WHEN (host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}') THEN '{{{n}}}'" for n, (rule, _) in enumerate(sorted(url_filter.RULES, key=lambda r: -len(r[0])))
)
_RULES = sorted(url_filter.RULES, key=lambda r: -len(r[0]))

ORACLE_SQL = {
    "op2_warc": f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages), d AS (SELECT *, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS first FROM p)
        SELECT page_id, strlen(t) AS payload_bytes, {BASE32_SQL} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
          CASE WHEN coalesce(url, '') = '' THEN 'urn:row:' || page_id ELSE replace(url, ' ', '%20') END AS url, strftime(TIMESTAMP '2001-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS date FROM d
    """,
    "url_rules": f"""
        WITH h AS (SELECT page_id, CASE WHEN contains(url, '://') THEN {_HOST} ELSE '' END AS host, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages)
        SELECT page_id, host, path, CASE {_FITS.format(*[r for r, _ in _RULES])} END AS rule, CASE {_FITS.format(*[v for _, v in _RULES])} END AS rule_verdict FROM h
    """,
    "op13_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (SELECT lang, 1 AS size, unnest(ws) AS phrase FROM w
          UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) > 1
          UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w WHERE len(ws) > 2),
        f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
        i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM c WHERE size = 3) GROUP BY ALL),
        k AS (SELECT c.* FROM c LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
        cut AS (SELECT lang, phrase, a, 1 AS k, ws[1] AS head, array_to_string(ws[2:], ' ') AS tail FROM k UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM k WHERE size = 3),
        s AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
    """,
}
