"""Queries of vector search, re-ranking and clustering over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalogue import query
from factloom.operators import answer, cells, rerank, trace
from factloom.operators import vectors as ops
from factloom.session import table

c = F.col
#: The stated queries: every row whose id is divisible by 50, against all rows.
QUERY_SQL = "q AS (SELECT vec_id AS qid, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 50 = 0)"
NEAR_SQL = f"""WITH {QUERY_SQL}, d AS (SELECT qid, vec_id AS id, 1 - list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]) AS distance, ql, label FROM q, embeddings),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d WHERE {{}}), k AS (SELECT * FROM n WHERE rank <= 18)"""
ALL_SQL, OWN_SQL = NEAR_SQL.format("true"), NEAR_SQL.format("label IN (ql, (ql + 1) % 10)")


def queries_of(spark, sf):
    rows = table(spark, sf, "embeddings").where("vec_id % 50 = 0")
    return rows.select(c("vec_id").alias("qid"), c("embedding"), F.array(c("label"), (c("label") + 1) % 10).alias("allowed"))


def near(spark, sf, filtered: bool = False, k: int = 18):
    """The stated queries' nearest rows, from an index of all rows."""
    corpus = table(spark, sf, "embeddings").select(c("vec_id").alias("id"), "embedding", "label")
    index = cells.build(corpus, label_col="label" if filtered else None)
    return cells.search(index, queries_of(spark, sf), k, allowed_col="allowed" if filtered else None)


@query(ALL_SQL + "SELECT qid, id, round(distance, 6) AS distance, rank::INT AS rank FROM k")
def knn_unfiltered(spark, sf):
    return near(spark, sf).select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


@query(OWN_SQL + "SELECT qid, id, round(distance, 6) AS distance, rank::INT AS rank FROM k")
def knn_filtered(spark, sf):
    return near(spark, sf, True).select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


@query(OWN_SQL + ", o AS (SELECT * FROM k WHERE id <> qid) SELECT q.qid, round(coalesce(max(1 - distance), 0), 6) AS best, coalesce(max(1 - distance) >= 0.3, false) AS grounded FROM q LEFT JOIN o USING (qid) GROUP BY q.qid")
def similarity_floor(spark, sf):
    out = ops.grounded(near(spark, sf, True).where("id <> qid"), queries_of(spark, sf))
    return out.select("qid", F.round("best", 6).alias("best"), "grounded")


@query("SELECT count(*) AS n, round(min(sqrt(list_inner_product(e, e))), 6) AS min_norm, round(max(sqrt(list_inner_product(e, e))), 6) AS max_norm, bool_and(abs(sqrt(list_inner_product(e, e)) - 1) <= 0.00101) AS all_unit, bool_and(len(e) = 64) AS all_dim FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings)")
def vector_norms(spark, sf):
    report = ops.norm_report(table(spark, sf, "embeddings"), c("embedding"), 64)
    return report.withColumns({"min_norm": F.round("min_norm", 6), "max_norm": F.round("max_norm", 6)})


@query("""WITH stored AS (SELECT vec_id, embedding AS a FROM embeddings WHERE vec_id % 8 <> 0),
    fresh AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN vec_id % 10 = 1 AND i = 6 THEN (x::DOUBLE + 0.01)::FLOAT ELSE x END) AS b FROM embeddings WHERE vec_id % 9 <> 0 OR vec_id % 8 = 0),
    j AS (SELECT coalesce(stored.vec_id, fresh.vec_id) AS vec_id, a, b FROM stored FULL JOIN fresh ON stored.vec_id = fresh.vec_id),
    f AS (SELECT vec_id, CASE WHEN b IS NULL THEN 'not fresh' WHEN a IS NULL THEN 'not stored' WHEN len(a) <> 64 OR len(b) <> 64 THEN 'length' WHEN list_max(list_transform(list_zip(a, b), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) >= 0.0001 THEN 'differs' END AS failure FROM j)
    SELECT * FROM f WHERE failure IS NOT NULL""")
def vector_delta(spark, sf):
    from factloom.operators import store

    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    moved = F.transform("embedding", lambda x, i: F.when(i == 5, x + F.lit(0.01)).otherwise(x).cast("float"))
    fresh = rows.where("vec_id % 9 <> 0 or vec_id % 8 = 0").withColumn("embedding", F.when(c("vec_id") % 10 == 1, moved).otherwise(c("embedding")))
    return store.vector_failures(rows.where("vec_id % 8 <> 0"), fresh, "vec_id", 64)


@query("SELECT DISTINCT a.label, least(a.vec_id, b.vec_id) AS a, greatest(a.vec_id, b.vec_id) AS b, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 0.75")
def close_pairs(spark, sf):
    """Close pairs of the stated queries and all other rows of their label."""
    rows = table(spark, sf, "embeddings")
    pairs = ops.close_pairs(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", "label", 0.75)
    return pairs.withColumn("distance", F.round("distance", 6))


CANDIDATE_SQL = ALL_SQL + ", c AS (SELECT k.qid, k.id, k.rank AS r, k.distance AS dq, CASE WHEN id % 7 = 0 THEN 'f' || (label % 3) || '_historical' ELSE 'f' || (label % 3) END AS field, (id % 5)::VARCHAR AS value, id % 7 = 0 AS historical FROM k)"
POOL_SQL = CANDIDATE_SQL + """, m AS (SELECT *, historical AND coalesce(bool_or(NOT historical) OVER (PARTITION BY qid, regexp_replace(field, '_historical$', '')), false) AS old FROM c),
    w AS (SELECT *, sum(CASE WHEN old THEN 0 ELSE 1 END) OVER (PARTITION BY qid) AS left_n FROM m), pool AS (SELECT qid, id, r, dq, field, value, historical FROM w WHERE NOT old OR left_n = 0)"""


def candidates(spark, sf):
    labels = table(spark, sf, "embeddings").select(c("vec_id").alias("id"), "embedding", "label")
    rows = near(spark, sf).join(labels, "id")
    old = c("id") % 7 == 0
    field = F.concat(F.lit("f"), (c("label") % 3).cast("string"), F.when(old, "_historical").otherwise(""))
    return rows.select("qid", "id", "distance", "rank", field.alias("field"), (c("id") % 5).cast("string").alias("value"), old.alias("historical"), "embedding")


@query(POOL_SQL + "SELECT qid, id, field FROM pool")
def superseded_drop(spark, sf):
    return rerank.without_superseded(candidates(spark, sf)).select("qid", "id", "field")


def mmr_sql(penalty: str) -> str:
    """Four selections, one CTE each: lowest tier, then score, then rank."""
    apart = "1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])" if penalty == "distance" else "list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])"
    sql = POOL_SQL + f", apart AS (SELECT p.qid, p.id AS i, o.id AS j, {apart} AS d FROM pool p JOIN pool o ON p.qid = o.qid JOIN embeddings x ON x.vec_id = p.id JOIN embeddings y ON y.vec_id = o.id)"
    sql += ", s0 AS (SELECT qid, id, field, value, 0 AS n FROM pool WHERE false)"
    for n in range(1, 5):
        sql += f""", g{n} AS (SELECT p.*, (SELECT coalesce(max(greatest(d, 0)), 0) FROM apart a JOIN s{n - 1} s ON a.qid = s.qid AND a.j = s.id WHERE a.qid = p.qid AND a.i = p.id) AS worst,
            (SELECT count(*) FROM s{n - 1} s WHERE s.qid = p.qid AND s.field = p.field) >= 3 AS full_field,
            EXISTS (SELECT 1 FROM s{n - 1} s WHERE s.qid = p.qid AND s.field = p.field AND s.value = p.value) AS seen
            FROM pool p WHERE NOT EXISTS (SELECT 1 FROM s{n - 1} s WHERE s.qid = p.qid AND s.id = p.id)),
          s{n} AS (SELECT * FROM s{n - 1} UNION ALL SELECT qid, id, field, value, {n} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY 2 * full_field::INT + seen::INT, 0.7 * (1 - dq) - 0.3 * worst DESC, r) AS w FROM g{n}) WHERE w = 1)"""
    return sql + " SELECT s4.qid, s4.id, round(pool.dq, 6) AS distance, s4.n::INT AS rank FROM s4 JOIN pool ON pool.qid = s4.qid AND pool.id = s4.id"


@query(mmr_sql("distance"))
def mmr_rerank(spark, sf):
    return rerank.rerank(candidates(spark, sf)).select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


@query(mmr_sql("similarity"))
def mmr_similarity_option(spark, sf):
    return rerank.rerank(candidates(spark, sf), penalty="similarity").select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


def _lines(spark, sf):
    rows = candidates(spark, sf).where("rank <= 4")
    text = F.concat(F.lit("text of "), c("id").cast("string"))
    value = F.when(c("value") != "0", c("value")).otherwise("")
    return rows.withColumn("line", answer.context_line(c("field"), c("historical"), F.lit("Entity (Direct Growth)"), value, text, F.concat(F.lit("https://x.example/"), c("id").cast("string"))))


@query(CANDIDATE_SQL + "SELECT qid, string_agg('[' || field || ']' || CASE WHEN historical THEN ' [SUPERSEDED - not current]' ELSE '' END || ' Entity (Direct Growth): ' || CASE WHEN value <> '0' THEN value ELSE 'text of ' || id END || chr(10) || 'source: https://x.example/' || id, chr(10) || chr(10) ORDER BY r) AS context FROM c WHERE r <= 4 GROUP BY qid")
def prompt_context(spark, sf):
    return answer.prompt_contexts(_lines(spark, sf))


@query(CANDIDATE_SQL + "SELECT qid, r::INT AS rank, id::VARCHAR AS chunk_id, field, value, round(dq, 6) AS cosine_distance FROM c WHERE r <= 4")
def trace_rows(spark, sf):
    rows = candidates(spark, sf).where("rank <= 4")
    told = trace.top_chunk(c("rank"), c("id").cast("string"), F.lit("s"), c("field"), c("value"), c("distance"), F.lit("u"))
    return rows.select("qid", told.alias("t")).select("qid", "t.rank", "t.chunk_id", "t.field", "t.value", "t.cosine_distance")


#: One step for each cluster of a label: the first row left leads, the rows that are not near it are left to the next.
LEADERS_SQL = """WITH RECURSIVE s AS (SELECT label, list({'id': vec_id, 'e': embedding::DOUBLE[]} ORDER BY vec_id) AS left_rows FROM embeddings GROUP BY label
    UNION ALL SELECT label, list_filter(left_rows, lambda r: r.id <> left_rows[1].id AND 1 - list_cosine_similarity(r.e, left_rows[1].e) > 0.75) FROM s WHERE len(left_rows) > 0)
    SELECT label, left_rows[1].id AS seed, unnest(list_filter(left_rows, lambda r: r.id = left_rows[1].id OR 1 - list_cosine_similarity(r.e, left_rows[1].e) <= 0.75)).id AS id FROM s WHERE len(left_rows) > 0"""


@query(LEADERS_SQL)
def leader_clusters(spark, sf):
    """Greedy clusters of the vectors of each label: every row with its leader."""
    return ops.leaders(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 0.75)
