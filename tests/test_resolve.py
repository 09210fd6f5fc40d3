"""Resolution by a table of aliases gives what the expression over the same aliases gives."""

import random

from pyspark.sql import functions as F

from factloom.operators import resolve


def told(rows):
    return sorted(((r["id"], r["text"], *[tuple(x) if isinstance(x, list) else x for x in r["resolution"]]) for r in rows.collect()), key=str)


def test_table_equals_expression(spark):
    rng = random.Random(4)
    words = ["large", "cap", "balanced", "fund", "l&t", "a-b", "x", "é", "mid", "(new)"]
    aliases = {f"s{i}": sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(3)}) for i in range(12)}
    aliases["s3"].append("large cap")
    aliases["s7"].append("large cap")
    scope = ["s1", "s3", "s5", "s7", "s9", "gone"]
    texts = [" ".join(rng.choice([*words, "LARGE  Cap", "sbi", "capx", "Balanced,fund"]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "large cap", "large cap"]
    rows = spark.createDataFrame([(i % 150, t, "kept") for i, t in enumerate(texts)], "id long, text string, _found string").repartition(3)
    ordered = resolve.ordered_aliases({s: [a for a in own if any("a" <= c <= "z" for c in a)] for s, own in aliases.items()})
    place = {a: n for n, (a, _) in enumerate(ordered)}
    table = spark.createDataFrame([(a, s, n) for n, (a, s) in enumerate((a, s) for s, own in aliases.items() for a in own)], "alias string, scheme string, place long")
    want = rows.withColumn("resolution", resolve.resolve(F.col("text"), {s: [a for a in own if a in place] for s, own in aliases.items()}, scope))
    got = resolve.resolve_rows(rows.drop("_found").withColumn("other", F.lit(1)), "text", table, spark.createDataFrame([(s,) for s in scope], "scheme string"))
    assert got.columns == ["id", "text", "other", "resolution"] and told(got) == told(want)
    assert len({r[2] for r in told(want)}) > 5


def test_very_many_aliases(spark):
    """A hundred thousand aliases are rows: the plan is as short as for one."""
    rows = spark.createDataFrame([(i, f"tell me of alias {i * 1000} number and of alias {i * 1000}") for i in range(50)], "id long, text string")
    many = spark.range(100_000).select(F.concat(F.lit("alias "), "id", F.when(F.col("id") % 2 == 0, " number").otherwise("")).alias("alias"), F.col("id").cast("string").alias("scheme"), F.col("id").alias("place"))
    scope = many.select("scheme")
    out = resolve.resolve_rows(rows, "text", many, scope)
    assert [r["resolution"]["scheme_ids"] for r in out.orderBy("id").collect()] == [[str(i * 1000)] for i in range(50)]
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 1.2 * len(resolve.resolve_rows(rows, "text", many.limit(1), scope)._jdf.queryExecution().optimizedPlan().toString())


def test_no_aliases(spark):
    rows = spark.createDataFrame([(1, "a large cap"), (2, None)], "id long, text string")
    none = spark.createDataFrame([], "alias string, scheme string, place long")
    assert [r["resolution"]["scheme_ids"] for r in resolve.resolve_rows(rows, "text", none, none.select("scheme")).collect()] == [[], []]
