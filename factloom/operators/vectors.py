"""Exact filtered nearest-neighbour search, in blocks, with partial top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.functions import vectors as V
from factloom.session import staged

#: Rows and queries of one block, and queries of a block that are multiplied at once: a task's matrices have TILE times BLOCK numbers.
BLOCK, TILE = 4096, 256


def _blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Packs rows (id, vector, array of tags) into blocks: ids (packed longs), vectors (packed doubles), dim, tags."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                dim = len(flat) // max(1, part.num_rows)
                if dim * part.num_rows != len(flat) or part.column(1).null_count:
                    raise ValueError("vectors of a block differ in length or are missing")
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                tags = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(2))
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(flat).tobytes()], pa.binary()), pa.array([dim], pa.int32()), tags], names=["ids", "packed", "dim", "tags"])

    return rows.mapInArrow(pack, "ids binary, packed binary, dim int, tags array<array<string>>")


def _products(corpus: DataFrame, queries: DataFrame, columns: list[Column], asked: list[Column], filtered: bool, skip_self: bool, keep) -> DataFrame:
    """(qid, id, distance) of what ``keep(distances, ids)`` keeps (a mask) of the product of each block of queries with each block of rows.

    ``columns`` and ``asked`` are id, vector and tags of rows and queries; with
    ``filtered`` a row is apart from a query whose tags, if it has any, lack the row's
    first. A query without tags meets all. Zero vectors are at distance 1.

    Blocks are stored: they are packed once, not for each task that meets them, and no
    packing worker lives beside one that multiplies. Of a block of queries TILE are
    multiplied at a time, so a worker's memory does not follow the tables.
    """
    left = staged(_blocks(corpus.select(*columns)), "blocks")
    right = staged(_blocks(queries.select(*asked)), "asked-blocks").select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "packed", "dim", "tags")])

    def product(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ids, packed, dim, tags, q_ids, q_packed, q_dim, q_tags = (batch.column(j)[i] for j in range(8))
                if dim != q_dim:
                    raise ValueError(f"vectors of {dim} and {q_dim} numbers")
                ids, q_ids = (np.frombuffer(x.as_buffer(), "<i8") for x in (ids, q_ids))
                rows, other = (np.frombuffer(x.as_buffer(), "<f8").reshape(-1, dim.as_py()) for x in (packed, q_packed))
                norms, q_norms = (np.sqrt((x * x).sum(1)) for x in (rows, other))
                if filtered:
                    # tags as numbers: a row's own, and for each query which of them it takes
                    names, own = np.unique(np.array(tags.values.flatten().to_pylist(), object).astype(str), return_inverse=True)
                    taken = q_tags.as_py()
                for start in range(0, len(q_ids), TILE):
                    tile = slice(start, start + TILE)
                    size = np.outer(q_norms[tile], norms)
                    distance = other[tile] @ rows.T
                    np.divide(distance, size, out=distance, where=size > 0)
                    distance[size == 0] = 0.0
                    np.subtract(1.0, distance, out=distance)
                    if filtered:
                        for q, t in enumerate(taken[tile]):
                            if t:
                                distance[q, ~np.isin(names, t)[own]] = np.inf
                    if skip_self:
                        distance[q_ids[tile, None] == ids[None, :]] = np.inf
                    q, at = np.nonzero(keep(distance, ids) & np.isfinite(distance))
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[tile][q]), pa.array(ids[at]), pa.array(distance[q, at])], names=["qid", "id", "distance"])

    return right.crossJoin(left).select("ids", "packed", "dim", "tags", "q_ids", "q_packed", "q_dim", "q_tags").mapInArrow(product, "qid long, id long, distance double")


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", label_col: str | None = None, query_id: str = "qid", query_vector: str = "embedding", allowed_col: str | None = None, skip_self: bool = False) -> DataFrame:
    """(qid, id, distance, rank): the k rows of the corpus at the smallest cosine distance of each query, ties by id.

    With ``label_col`` and ``allowed_col`` (an array; null or empty allows all) rows of
    other labels are left out before ranking. Blocks of queries meet blocks of rows;
    each product passes on k rows a query at most, and those are ranked. Zero vectors
    are at distance 1. With ``skip_self`` a row is no neighbour of the query of its id.
    """
    label = F.array(F.coalesce(F.col(label_col).cast("string"), F.lit(""))) if label_col else F.array().cast("array<string>")
    allowed = F.coalesce(F.col(allowed_col).cast("array<string>"), F.array().cast("array<string>")) if allowed_col else F.array().cast("array<string>")

    def first(distance, ids):
        import numpy as np

        if distance.shape[1] <= k:
            return np.ones(distance.shape, bool)
        kept = distance <= np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
        # of rows at the k-th distance those of the smallest ids stay
        for q in np.flatnonzero(kept.sum(1) > k):
            near = np.flatnonzero(kept[q])
            kept[q, near[np.lexsort((ids[near], distance[q, near]))[k:]]] = False
        return kept

    rows = [F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"), label]
    asked = [F.col(query_id).cast("long"), F.col(query_vector).cast("array<double>"), allowed]
    found = _products(corpus, queries, rows, asked, bool(label_col and allowed_col), skip_self, first)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k)


def grounded(candidates: DataFrame, queries: DataFrame, floor: float = 0.30) -> DataFrame:
    """(qid, best, grounded) of every query: the best similarity, 0.0 without candidates, against an inclusive floor."""
    best = candidates.groupBy("qid").agg(F.max(F.lit(1.0) - F.col("distance")).alias("best"), F.count(F.lit(1)).alias("_n"))
    return queries.select("qid").join(best, "qid", "left").select("qid", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce((F.col("best") >= floor) & (F.col("_n") > 0), F.lit(False)).alias("grounded"))


def norm_report(rows: DataFrame, vector: Column, dim: int) -> DataFrame:
    """One row: n, min and max norm, whether all are unit vectors of ``dim`` numbers."""
    n = V.norm(vector)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("min_norm"), F.max(n).alias("max_norm"), F.coalesce(F.bool_and(V.is_unit(vector)), F.lit(True)).alias("all_unit"), F.coalesce(F.bool_and(F.size(vector) == dim), F.lit(True)).alias("all_dim")
    )


def close_pairs(corpus: DataFrame, asked: DataFrame, id_col: str, vector_col: str, label_col: str, most: float = 0.25) -> DataFrame:
    """(label, a, b, distance), a < b: each pair of an asked row and a row of the corpus of its label within ``most``, once.

    Blocks of asked rows meet blocks of rows, whatever their labels, so a label that
    very many rows have is no task by itself. Rows without a label have no pairs.
    """
    columns = [F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"), F.array(F.col(label_col).cast("string"))]
    known = F.col(label_col).isNotNull()
    near = _products(corpus.where(known), asked.where(known), columns, columns, True, True, lambda distance, ids: distance <= most)
    pairs = near.select("qid", F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b"), "distance").groupBy("a", "b").agg(F.min("qid").alias("qid"), F.min("distance").alias("distance"))
    return pairs.join(asked.select(F.col(id_col).cast("long").alias("qid"), F.col(label_col).alias("label")), "qid").select("label", "a", "b", "distance")


#: Rows of a label that are settled in one round of ``leaders``.
BATCH = 256


def leaders(rows: DataFrame, id_col: str, vector_col: str, label_col: str, most: float = 0.25) -> DataFrame:
    """(label, id, seed) of every row: greedy leader clustering within each label, in id order; ids are unique.

    The first row that no cluster has leads and takes every such row within ``most`` of
    it. That depends on order, so it goes by rounds: the first BATCH undecided rows
    of each label are settled one after the other, and all undecided rows are then
    compared with the new leaders, wherever they are. A label is never one task, and
    no label is too large. Each round is a stored table; there are as many as the
    leaders of a label, over BATCH.
    """
    import numpy as np
    import pyarrow as pa

    kind = rows.schema[label_col].dataType.simpleString()
    left = staged(rows.select(F.col(label_col).alias("label"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")), "undecided")
    decided: list[DataFrame] = []

    def units(vectors) -> np.ndarray:
        x = np.array(vectors, float).reshape(len(vectors), -1)
        size = np.sqrt((x * x).sum(1))
        return x / np.where(size == 0, 1, size)[:, None]

    def lowest(batches):
        """The BATCH first rows of each label of a task."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            place = held.select(["label", "id"]).append_column("at", pa.array(range(held.num_rows))).to_pandas().sort_values("id")
            held = held.take(pa.array(np.sort(place.groupby("label", dropna=False).head(BATCH)["at"].to_numpy())))
        if held is not None:
            yield from held.to_batches()

    def settle(table):
        """The leaders among the first rows of a label, with their vectors in id order."""
        table = table.sort_by("id")
        unit, own = units(table["vector"].to_pylist()), []
        for i in range(len(unit)):
            if not own or not (1 - unit[own] @ unit[i] <= most).any():
                own.append(i)
        return pa.table({"label": table["label"][:1], "ids": pa.array([[table["id"][i].as_py() for i in own]], pa.list_(pa.int64())), "packed": pa.array([unit[own].astype("<f8").tobytes()], pa.binary())})

    def take(batches):
        for batch in batches:
            seeds = [None] * batch.num_rows
            unit = units(batch.column(2).to_pylist())
            # by label: two labels may have the same leaders' vectors, but never their ids
            of = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            for label in np.unique(of):
                own = np.flatnonzero(of == label)
                names = batch.column(3)[int(own[0])].as_py()
                lead = np.frombuffer(batch.column(4)[int(own[0])].as_buffer(), "<f8").reshape(len(names), -1)
                near = 1 - unit[own] @ lead.T <= most
                near |= batch.column(1).to_numpy()[own][:, None] == np.array(names)[None, :]
                for r, row in zip(own.tolist(), near, strict=True):
                    seeds[r] = names[int(row.argmax())] if row.any() else None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(seeds, pa.int64())], names=["label", "id", "vector", "seed"])

    while left.limit(1).count():
        some = left.mapInArrow(lowest, left.schema)
        nth = F.row_number().over(Window.partitionBy("label").orderBy("id"))  # BATCH rows for each task and label
        new = some.withColumn("_n", nth).where(F.col("_n") <= BATCH).drop("_n").groupBy("label").applyInArrow(settle, f"label {kind}, ids array<long>, packed binary")
        new = staged(new, "leaders")
        met = left.join(new.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label"))).select("label", "id", "vector", "ids", "packed")
        told = staged(met.mapInArrow(take, f"label {kind}, id long, vector array<double>, seed long"), "told")
        decided.append(told.where("seed is not null").select("label", "id", "seed"))
        left = staged(told.where("seed is null").select("label", "id", "vector"), "undecided")
    if not decided:
        return left.select("label", "id", F.lit(None).cast("long").alias("seed"))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionAll(part)
    return out


def leader_clusters(rows: DataFrame, id_col: str, vector_col: str, label_col: str, text_col: str, most: float = 0.25) -> DataFrame:
    """(label, seed, members, text): the clusters of ``leaders`` put together, the seed first, then by id.

    A cluster is one row here, so this is for labels that are single entities with
    some chunks each; ``leaders`` is the form for clusters of any size.
    """
    told = leaders(rows, id_col, vector_col, label_col, most)
    texts = rows.select(F.col(label_col).alias("_label"), F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    own = told.join(texts, F.col("label").eqNullSafe(F.col("_label")) & (F.col("id") == F.col("_id")))
    member = F.struct((F.col("id") != F.col("seed")).alias("after"), "id", F.col("_text").alias("text"))
    lists = own.groupBy("label", "seed").agg(F.array_sort(F.collect_list(member)).alias("m"))
    return lists.select("label", "seed", F.transform("m", lambda x: x["id"]).alias("members"), F.array_join(F.transform("m", lambda x: x["text"]), " ").alias("text"))
