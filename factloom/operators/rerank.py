"""Diversity re-ranking of candidate lists.

Each query's candidates (a list bounded by the search's k) are one array, which is
re-ranked by a fold in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.functions.text import let
from factloom.functions.vectors import dot, doubles, norm

CANDIDATE = ("id", "distance", "field", "value", "historical", "embedding")


def base_field(c: Column) -> Column:
    return F.regexp_replace(c, "_historical$", "")


def without_superseded(candidates: DataFrame) -> DataFrame:
    """Drops historical candidates whose base field has a current one among the query's; keeps all where that would leave none."""
    pool, own = Window.partitionBy("qid"), Window.partitionBy("qid", base_field(F.col("field")))
    marked = candidates.withColumn("_old", F.col("historical") & F.coalesce(F.max(~F.col("historical")).over(own), F.lit(False)))
    marked = marked.withColumn("_left", F.sum(F.when(F.col("_old"), 0).otherwise(1)).over(pool))
    return marked.where(~F.col("_old") | (F.col("_left") == 0)).drop("_old", "_left")


def _apart(rows: Column, penalty: str) -> Column:
    """For each candidate its penalty to every one by place; each pair's product is made once.

    A candidate without vector, or one beside it, counts by its own distance to the query.
    """

    def unit(r: Column) -> Column:
        # a zero vector has cosine 0 with all
        return let(norm(r["embedding"]), lambda n: F.transform(doubles(r["embedding"]), lambda x: F.when(n == 0, 0.0).otherwise(x / n)))

    def below(units: Column) -> Column:
        return F.transform(units, lambda u, i: F.transform(F.slice(units, 1, i), lambda v: dot(u, v)))

    def whole(products: Column) -> Column:
        def penalties(r: Column, i: Column) -> Column:
            alone = r["distance"] if penalty == "distance" else 1.0 - r["distance"]

            def one(j: Column) -> Column:
                product = F.get(F.get(products, F.greatest(i, j)), F.least(i, j))
                return F.coalesce(1.0 - product if penalty == "distance" else product, alone)

            return F.transform(F.sequence(F.lit(0), F.size(rows) - 1), one)

        return F.transform(rows, penalties)

    return let(let(F.transform(rows, unit), below), whole)


def select_diverse(rows: Column, k: int, weight: float, max_per_field: int | None, penalty: str) -> Column:
    """Places (from 0) of up to k candidates of an array in rank order, chosen one by one; see ``rerank``.

    A fold whose state is what was chosen and what is left; the list is bounded by the search's k.
    """
    left_type = "array<struct<i:int,worst:double>>"

    def fold(apart: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("chosen"), F.transform(rows, lambda r, i: F.struct(i.alias("i"), F.lit(0.0).alias("worst"))).cast(left_type).alias("left"))

        def step(state: Column, _: Column) -> Column:
            def told(x: Column) -> Column:
                r = F.get(rows, x["i"])
                same = F.filter(state["chosen"], lambda j: F.get(rows, j)["field"].eqNullSafe(r["field"]))
                seen = F.exists(same, lambda j: F.get(rows, j)["value"].eqNullSafe(r["value"])).cast("int")
                tier = seen if max_per_field is None else F.when(F.size(same) >= max_per_field, 2).otherwise(0) + seen
                score = (1 - weight) * (1 - r["distance"]) - weight * x["worst"]
                return F.struct(tier.alias("tier"), (-score).alias("score"), x["i"].alias("i"))

            # the tiers only ever grow, so taking the lowest at each step is running them in turn
            def taken(best: Column) -> Column:
                others = F.filter(state["left"], lambda x: x["i"] != best)
                worse = F.transform(others, lambda x: F.struct(x["i"].alias("i"), F.greatest(x["worst"], F.get(F.get(apart, x["i"]), best)).alias("worst")))
                return F.struct(F.concat(state["chosen"], F.array(best)).alias("chosen"), worse.cast(left_type).alias("left"))

            return F.when(F.size(state["left"]) > 0, let(F.array_min(F.transform(state["left"], told))["i"], taken)).otherwise(state)

        return F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step)["chosen"]

    return let(_apart(rows, penalty), fold)


def rerank(candidates: DataFrame, k: int = 4, weight: float = 0.3, max_per_field: int | None = 3, penalty: str = "distance") -> DataFrame:
    """(qid, id, distance, rank) of k candidates of each query, chosen one by one.

    ``candidates`` has qid, rank and the columns of CANDIDATE. Superseded ones are
    dropped first. The score is (1 - weight) * similarity - weight * the largest
    ``penalty`` to those chosen: "distance" is the behaviour to match, "similarity"
    the usual one. Lowest tier first (field not full and pair unseen; field not full;
    pair unseen; any), then score, then rank.
    """
    if penalty not in ("distance", "similarity"):
        raise ValueError("penalty is 'distance' or 'similarity'")
    own = without_superseded(candidates).withColumn("value", F.col("value").cast("string")).select("qid", F.struct("rank", *CANDIDATE).alias("c"))
    lists = own.groupBy("qid").agg(F.array_sort(F.collect_list("c")).alias("candidates"))

    chosen = F.transform(select_diverse(F.col("candidates"), k, weight, max_per_field, penalty), lambda i: F.get("candidates", i))
    told = lists.select("qid", F.posexplode(chosen).alias("n", "c"))
    return told.select("qid", "c.id", "c.distance", (F.col("n") + 1).alias("rank"))
