"""A store with identity: snapshots named by a manifest, and drift by tree hash.

A snapshot is a folder of its own: rows in Parquet by ranges of their key's hash, a tree
of hashes over those ranges, and a manifest (model, dimension, metric, row count,
fingerprint, columns, files). The store's pointer names the current snapshot and is
replaced by one rename, after all else is written: whoever opens the store meanwhile,
or after a rebuild that was killed, reads the last whole snapshot.

The tree: a row's hash counts for its range, a range's for the range of one digit less,
up to the root. Hashes of rows are added up, so a node is a partial sum of any number
of rows in any order. Two trees are compared level by level, below unequal nodes alone,
and only ranges that differ are read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import staged

#: Hexadecimal digits of a key's hash that make a range (and a folder), and ranges that are named in a filter at most; more are joined.
DIGITS, NAMED = 2, 256


class StoreMismatch(ValueError):
    """The store was made with another model, dimension or metric."""


@dataclass(frozen=True)
class Identity:
    model: str
    dim: int
    metric: str = "cosine"


def range_of(key: Column, digits: int = DIGITS) -> Column:
    return F.left(F.md5(key.cast("string").cast("binary")), F.lit(digits))


def _hash(columns: list[str]) -> Column:
    """A hash of a row's columns as text, nulls apart from empty texts."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"))


def tree(rows: DataFrame, key: str, columns: list[str], digits: int = DIGITS) -> DataFrame:
    """level, range, n, sum: a row for each node that has rows, from the root (level 0) to the ranges."""
    h = _hash([key, *[c for c in columns if c != key]])
    parts = [F.sum(F.conv(F.substring("_h", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(2)]
    leaves = rows.select(range_of(F.col(key), digits).alias("range"), h.alias("_h")).groupBy("range").agg(F.count(F.lit(1)).alias("n"), *parts)
    nodes = leaves.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(digits)), lambda i: F.struct(i.alias("level"), F.left("range", i).alias("range")))).alias("at"), "n", "s0", "s1")
    sums = nodes.groupBy("at.level", "at.range").agg(F.sum("n").alias("n"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    return sums.select("level", "range", "n", F.concat_ws(",", "s0", "s1").alias("sum"))


def differing(a: DataFrame, b: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The ranges (range) in which two trees differ: each level's nodes are compared below those that differ above."""
    unequal = None
    for level in range(digits + 1):
        x, y = (t.where(F.col("level") == level).select(F.col("range").alias(f"r{s}"), F.col("n").alias(f"n{s}"), F.col("sum").alias(f"sum{s}")) for t, s in ((a, "x"), (b, "y")))
        if unequal is not None:
            above = unequal.select(F.col("range").alias("above"))
            x, y = (t.join(above, F.left(f"r{s}", F.lit(level - 1)) == F.col("above"), "left_semi") for t, s in ((x, "x"), (y, "y")))
        met = x.join(y, F.col("rx") == F.col("ry"), "full_outer").where(~(F.col("nx").eqNullSafe(F.col("ny")) & F.col("sumx").eqNullSafe(F.col("sumy"))))
        unequal = met.select(F.coalesce("rx", "ry").alias("range"))
    return unequal


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str | None:
    files, p = _path(spark, path)
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    """A whole new file that replaces the old one by one rename."""
    files, p = _path(spark, path)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = files.create(own, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(files.makeQualified(own).toUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    how[0] = getattr(jvm, "Options$Rename").OVERWRITE
    context.rename(files.makeQualified(own), files.makeQualified(p), how)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The current snapshot's manifest; None where there is no store."""
    name = _read(spark, f"{path}/CURRENT")
    text = _read(spark, f"{path}/{name.strip()}/manifest.json") if name else None
    return json.loads(text) if text else None


def write(rows: DataFrame, path: str, identity: Identity, key: str = "chunk_id", digits: int = DIGITS) -> dict:
    """Stores ``rows`` as a new snapshot and makes it the current one; its manifest."""
    spark, name = rows.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    folder = f"{path}/{name}"
    rows.withColumn("_range", range_of(F.col(key), digits)).repartition("_range").write.partitionBy("_range").parquet(f"{folder}/rows")
    kept = spark.read.schema(_schema(rows)).parquet(f"{folder}/rows")
    made = tree(kept, key, rows.columns, digits)
    made.coalesce(1).write.parquet(f"{folder}/tree")
    root = spark.read.parquet(f"{folder}/tree").where("level = 0").first()
    files, p = _path(spark, f"{folder}/rows")
    listed, names = files.listFiles(p, True), []
    while listed.hasNext():
        file = listed.next().getPath().toString()
        if file.endswith(".parquet"):
            names.append(file.split(f"/{name}/", 1)[1])
    told = {"snapshot": name, "key": key, "digits": digits, **asdict(identity), "rows": root["n"] if root else 0, "fingerprint": root["sum"] if root else "", "columns": rows.dtypes, "files": sorted(names)}
    _write(spark, f"{folder}/manifest.json", json.dumps(told))
    _write(spark, f"{path}/CURRENT", name)
    return told


def _schema(rows: DataFrame):
    from pyspark.sql.types import StringType, StructType

    return StructType([*rows.schema.fields]).add("_range", StringType())


def _rows(spark: SparkSession, path: str, told: dict) -> DataFrame:
    schema = ", ".join(f"`{n}` {t}" for n, t in [*told["columns"], ("_range", "string")])
    return spark.read.schema(schema).parquet(f"{path}/{told['snapshot']}/rows")


def opened(spark: SparkSession, path: str, identity: Identity) -> DataFrame:
    """The current snapshot's rows; a store of another model, dimension or metric is an error, as is none."""
    told = manifest(spark, path)
    if told is None:
        raise FileNotFoundError(f"no store at {path}")
    other = {n: (told[n], x) for n, x in asdict(identity).items() if told[n] != x}
    if other:
        raise StoreMismatch("; ".join(f"{n} is {a}, asked for {b}" for n, (a, b) in other.items()))
    return _rows(spark, path, told).drop("_range")


def _ranges(rows: DataFrame, ranges: DataFrame, column: Column) -> DataFrame:
    """The rows of some ranges: folders are left out by name where the ranges are few, by a join else."""
    some = [r["range"] for r in ranges.limit(NAMED + 1).collect()]
    if len(some) <= NAMED:
        return rows.where(column.isin(some) if some else F.lit(False))
    return rows.join(ranges, column == F.col("range"), "left_semi")


def drift(spark: SparkSession, path: str, fresh: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(key, change) of ``fresh`` against the current snapshot, as ``quality.drift`` tells it; of the store only the tree and the ranges that differ are read.

    Without ``columns`` all count. With some of them, ranges that differ in others are read and tell nothing.
    """
    from factloom.operators.quality import drift as compared

    told = manifest(spark, path)
    if told is None:
        raise FileNotFoundError(f"no store at {path}")
    key, digits, names = told["key"], told["digits"], [n for n, _ in told["columns"]]
    fresh = fresh.select(*names)
    stored_tree = spark.read.parquet(f"{path}/{told['snapshot']}/tree")
    ranges = staged(differing(stored_tree, tree(fresh, key, names, digits), digits), "differing-ranges")
    old = _ranges(_rows(spark, path, told), ranges, F.col("_range")).drop("_range")
    new = _ranges(fresh, ranges, range_of(F.col(key), digits))
    return compared(old, new, key, columns or [n for n in names if n != key])


def replaced(rows: DataFrame, path: str, identity: Identity, key: str = "chunk_id") -> DataFrame:
    """Makes ``rows`` the current snapshot and tells the ids (key) that the last one had and this one has not."""
    spark = rows.sparkSession
    last = manifest(spark, path)
    told = write(rows, path, identity, key)
    new = _rows(spark, path, told).select(key)
    if last is None:
        return new.where("false")
    return _rows(spark, path, last).select(key).join(new, key, "left_anti")
