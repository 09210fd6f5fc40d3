"""The vector index gives what the product of all blocks gives, from few of them where vectors form clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import cells, vectors


def clustered(spark, n=4000, groups=20, dim=16, spread=0.12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, rows[i].tolist(), f"l{i % 7}") for i in range(n)], "id long, embedding array<double>, label string").repartition(5)


def told(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect())


def asked(corpus, every=100, allowed=None):
    own = F.array(*[F.lit(x) for x in allowed]) if allowed else F.array().cast("array<string>")
    return corpus.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), "embedding", own.alias("allowed"))


@pytest.mark.parametrize("skip_self", [False, True])
@pytest.mark.parametrize("allowed", [None, ["l1", "l4"], ["none"]])
def test_same_rows_from_few_blocks(spark, allowed, skip_self):
    corpus = clustered(spark).checkpoint()
    queries = asked(corpus, allowed=allowed)
    index = cells.build(corpus, label_col="label" if allowed else None, block=64)
    kinds = {"allowed_col": "allowed" if allowed else None, "skip_self": skip_self}
    want = told(vectors.nearest(corpus, queries, 5, label_col="label" if allowed else None, **kinds))
    assert told(cells.search(index, queries, 5, block=16, **kinds)) == want and len(want) == (0 if allowed == ["none"] else 200)
    if not allowed:
        assert cells.share_read(index, queries, 5, block=16, **kinds) < 0.2


def test_first_cells_alone_find_most(spark):
    corpus = clustered(spark).checkpoint()
    queries = asked(corpus)
    index = cells.build(corpus)
    want = {x[:1] + x[2:3] for x in told(vectors.nearest(corpus, queries, 10))}
    got = {x[:1] + x[2:3] for x in told(cells.search(index, queries, 10, exact=False))}
    assert len(got & want) >= 0.9 * len(want)


def test_no_clusters_zero_vectors_and_copies(spark):
    """Nothing to prune by: the same rows all the same; zero vectors are at distance 1, equal vectors tie by id."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(1000 + i, [0.0] * 6) for i in range(5)] + [(2000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(3000, [-1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = corpus.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    for k in (1, 7, 500):
        want = told(vectors.nearest(corpus, queries, k))
        for cells_ in (1, 9, None):
            assert told(cells.search(cells.build(corpus, cells=cells_, block=16), queries, k, block=3)) == want, (k, cells_)


def test_a_label_of_most_rows_is_many_blocks(spark):
    corpus = clustered(spark, groups=2).withColumn("label", F.when(F.col("id") < 3000, "hot").otherwise("rest"))
    blocks = cells.build(corpus, label_col="label", cells=2, block=128).blocks
    assert blocks.agg(F.max("n")).first()[0] <= 128 and blocks.agg(F.sum("n")).first()[0] == 4000 and blocks.where("label = 'hot'").count() >= 3000 / 128


def test_empty(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "qid long, embedding array<double>")
    assert cells.search(cells.build(none), some, 3).collect() == []
    assert cells.search(cells.build(some.withColumnRenamed("qid", "id")), none.withColumnRenamed("id", "qid"), 3).collect() == []
    with pytest.raises(Exception, match="numbers|length|shape|matmul"):
        cells.search(cells.build(some.withColumnRenamed("qid", "id")), spark.createDataFrame([(1, [1.0])], "qid long, embedding array<double>"), 3).collect()


def test_angles_are_worked_out_for_a_bounded_number_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(rng.normal(size=(3000, 4)))], "id long, embedding array<double>").coalesce(1)
    asked = data.select(F.col("id").alias("qid"), "embedding")
    long = spark.sparkContext.accumulator(0)
    plain = cells._angles

    def watched(units, centroids):
        long.add(int(len(units) > 512))
        return plain(units, centroids)

    monkeypatch.setattr(cells, "_angles", watched)
    found = cells.search(cells.build(data), asked, 3).collect()
    assert len(found) == 9000 and long.value == 0
