"""A partitioned vector index: nearest neighbours by cosine distance, exact, from the cells that may hold them.

Rows lie in the cell of the centroid at the smallest angle; centroids are fitted on a
bounded sample. Within a cell rows are sorted by that angle and packed in blocks of one
label, each with the least and the largest angle of its rows. Angles obey the triangle
inequality: a row of a block [low, high] is no nearer to a query at angle p to the
centroid than max(p - high, low - p). So a search has two steps: the PROBES cells
nearest to a query give a first distance of its k-th neighbour, and then only blocks
whose bound is not beyond that are met. No row that could be a neighbour is left out;
where the vectors form no clusters, more blocks are read and the result is the same.

Cells are join keys, so a search reads cells where they lie; a cell or label of very
many rows is many blocks, dealt by range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.session import staged

#: Rows that centroids are fitted on, most centroids, rows of a block, and cells that a query visits first.
SAMPLE, MOST_CELLS, BLOCK, PROBES = 20_000, 4_096, 1_024, 4
#: Rows or queries whose angles to all centroids are worked out at once: a task's matrices have SLICE times MOST_CELLS numbers at most.
SLICE = 512
#: Parts in which the queries of a cell are dealt.
DEALT = 8
#: Angles that roundoff may be off by.
SLACK = 1e-6
#: The cell of zero vectors, which are at distance 1 from all.
ZERO = -1


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length one, whether each was zero)."""
    size = np.sqrt((vectors * vectors).sum(1))
    return vectors / np.where(size == 0, 1, size)[:, None], size == 0


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = len(flat) // max(1, len(column))
    if column.null_count or dim * len(column) != len(flat):
        raise ValueError("vectors differ in length or are missing")
    return flat.reshape(len(column), dim)


def _slices(batches):
    """Up to SLICE rows of each batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def fit_centroids(vectors: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Directions of ``cells`` clusters at most (spherical k-means, started far apart)."""
    units, zero = _units(vectors)
    units = units[~zero]
    if not len(units):
        return np.zeros((0, vectors.shape[1] if vectors.ndim == 2 else 0))
    rng, chosen = np.random.default_rng(seed), [0]
    far = 1 - units @ units[0]
    while len(chosen) < min(cells, len(units)) and far.max() > 1e-12:
        share = np.maximum(far, 0) ** 2
        chosen.append(int(rng.choice(len(units), p=share / share.sum())))
        far = np.minimum(far, 1 - units @ units[chosen[-1]])
    out = units[chosen]
    for _ in range(rounds):
        own = (units @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, units)
        moved, empty = _units(sums)
        out = np.where(empty[:, None], out, moved)
    return out


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1, 1))


@dataclass
class Index:
    """``blocks``: label, cell, low, high, n, ids, packed (vectors), dim; ``centroids`` and each cell's own [low, high] are small."""

    blocks: DataFrame
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    has_zero: bool


def build(corpus: DataFrame, id_col: str = "id", vector_col: str = "embedding", label_col: str | None = None, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> Index:
    """The index of all rows of ``corpus``, a stored table.

    ``cells`` is the root of the rows' number if it is not given, MOST_CELLS at most.
    Vectors are of one length and not null; zero vectors have a cell of their own.
    """
    label = F.coalesce(F.col(label_col).cast("string"), F.lit("")) if label_col else F.lit("")
    rows = corpus.select(label.alias("label"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    cells = cells or max(1, min(MOST_CELLS, math.isqrt(rows.count())))
    some = rows.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).toArrow()["vector"].combine_chunks()  # SAMPLE rows
    centroids = fit_centroids(_matrix(some), cells) if len(some) else np.zeros((0, 0))
    told = corpus.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            units, zero = _units(_matrix(batch.column(2)))
            cell, angle = np.full(len(units), ZERO, np.int32), np.zeros(len(units))
            if len(told.value):
                all_angles = _angles(units, told.value)
                cell[~zero], angle[~zero] = all_angles.argmin(1)[~zero], all_angles.min(1)[~zero]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(angle), batch.column(1), batch.column(2)], names=["label", "cell", "angle", "id", "vector"])

    def pack(batches):
        import pyarrow as pa

        def packed(parts):
            table = pa.Table.from_batches(parts)
            angle = table["angle"].to_numpy()
            vectors = _matrix(table["vector"].combine_chunks())
            return pa.RecordBatch.from_arrays(
                [table["label"][:1].combine_chunks(), table["cell"][:1].combine_chunks(), pa.array([angle.min()]), pa.array([angle.max()]), pa.array([len(angle)], pa.int32()), pa.array([table["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([vectors.astype("<f8").tobytes()], pa.binary()), pa.array([vectors.shape[1]], pa.int32())],
                names=["label", "cell", "low", "high", "n", "ids", "packed", "dim"],
            )

        key, parts, size = None, [], 0
        for batch in batches:
            labels, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < batch.num_rows:
                end, own = at, (labels[at], numbers[at])
                if own != key or size >= block:
                    if parts:
                        yield packed(parts)
                    key, parts, size = own, [], 0
                while end < batch.num_rows and (labels[end], numbers[end]) == own and end - at < block - size:
                    end += 1
                parts.append(batch.slice(at, end - at))
                size, at = size + end - at, end
        if parts:
            yield packed(parts)

    placed = staged(rows.mapInArrow(assign, "label string, cell int, angle double, id long, vector array<double>"), "index-rows")
    dealt = placed.repartitionByRange("cell", "label", "angle", "id").sortWithinPartitions("cell", "label", "angle", "id")
    blocks = staged(dealt.mapInArrow(pack, "label string, cell int, low double, high double, n int, ids binary, packed binary, dim int"), "index-blocks")
    bounds = {r["cell"]: r for r in blocks.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # MOST_CELLS rows
    low, high = np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf)  # empty cells are never met
    for cell, r in bounds.items():
        if cell != ZERO:
            low[cell], high[cell] = r["low"], r["high"]
    return Index(blocks, centroids, low, high, ZERO in bounds)


def _visits(index: Index, asked: DataFrame, first: bool, block: int) -> DataFrame:
    """Blocks of queries of a cell (cell, q_low, q_high, q_reach, q_ids, q_packed, q_allowed, q_limits): for the first step, or all other cells within each query's limit."""
    told = asked.sparkSession.sparkContext.broadcast((index.centroids, index.low, index.high, index.has_zero))

    def choose(batches):
        import pyarrow as pa

        centroids, low, high, has_zero = told.value
        full = high >= 0
        for batch in _slices(batches):
            units, zero = _units(_matrix(batch.column(1)))
            angle = _angles(units, centroids) if len(centroids) else np.zeros((len(units), 0))
            probes = np.zeros(angle.shape, bool)
            if full.any():
                nearest = np.argsort(np.where(full, angle, np.inf), axis=1, kind="stable")[:, : min(PROBES, int(full.sum()))]
                np.put_along_axis(probes, nearest, True, 1)
            limit = batch.column(3).to_numpy(zero_copy_only=False)
            reach = np.arccos(np.clip(1 - limit, -1, 1)) + SLACK  # the largest angle within the limit
            if first:
                wanted = probes
            else:
                bound = np.maximum(np.maximum(angle - high, low - angle), 0)
                wanted = ~probes & full & ((bound <= reach[:, None]) | zero[:, None])
            q, cell = np.nonzero(wanted)
            # a zero vector is at distance 1, of rows and of queries alike: both go without bounds
            if has_zero and not first:
                at = np.flatnonzero(limit >= 1 - 1e-12)
                q, cell = np.append(q, at), np.append(cell, np.full(len(at), ZERO))
            own = np.where(cell == ZERO, 0.0, angle[q, np.maximum(cell, 0)] if angle.shape[1] else 0.0)
            reach = np.where(zero, math.pi, reach)
            picked = pa.array(q)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(own), pa.array(reach[q]), *(batch.column(i).take(picked) for i in range(4))], names=["cell", "angle", "reach", "qid", "vector", "allowed", "limit"])

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                for at in range(start, stop, block):
                    part = batch.slice(at, min(block, stop - at))
                    angle, reach = part.column(1).to_numpy(), part.column(2).to_numpy()
                    vectors = _matrix(part.column(4)).astype("<f8")
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0)[:1], pa.array([angle.min()]), pa.array([angle.max()]), pa.array([reach.max()]), pa.array([part.column(3).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary()), pa.array([part.column(5).to_pylist()], pa.list_(pa.list_(pa.string()))), pa.array([part.column(6).to_numpy().astype("<f8").tobytes()], pa.binary())],
                        names=["cell", "q_low", "q_high", "q_reach", "q_ids", "q_packed", "q_allowed", "q_limits"],
                    )

    chosen = asked.mapInArrow(choose, "cell int, angle double, reach double, qid long, vector array<double>, allowed array<string>, limit double")
    # queries of a cell are sorted by their angle, so that the bounds of a block of them are close
    # a cell that very many queries visit is several tasks
    dealt = chosen.repartition("cell", F.pmod("qid", F.lit(DEALT))).sortWithinPartitions("cell", "angle", "qid")
    return dealt.mapInArrow(pack, "cell int, q_low double, q_high double, q_reach double, q_ids binary, q_packed binary, q_allowed array<array<string>>, q_limits binary")


def _meetings(index: Index, visits: DataFrame) -> DataFrame:
    """The pairs of a block of queries and a block of rows of its cell that the bounds do not part."""
    bound = F.greatest(F.col("q_low") - F.col("high"), F.col("low") - F.col("q_high"), F.lit(0.0))
    allowed = F.exists("q_allowed", lambda x: (F.size(x) == 0) | F.array_contains(x, F.col("label")))
    return index.blocks.join(visits, "cell").where((bound <= F.col("q_reach")) & allowed)


def _found(meetings: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """(qid, id, distance): the k nearest rows of each query in each meeting, within the query's limit."""

    def product(batches):
        import pyarrow as pa

        for batch in batches:
            for label, ids, packed, dim, q_ids, q_packed, q_allowed, q_limits in zip(*(batch.column(i) for i in range(8)), strict=True):
                ids, q_ids = (np.frombuffer(x.as_buffer(), "<i8") for x in (ids, q_ids))
                rows = np.frombuffer(packed.as_buffer(), "<f8").reshape(-1, dim.as_py())
                other = np.frombuffer(q_packed.as_buffer(), "<f8").reshape(len(q_ids), -1)
                if rows.shape[1] != other.shape[1]:
                    raise ValueError(f"vectors of {rows.shape[1]} and {other.shape[1]} numbers")
                size = np.outer(np.sqrt((other * other).sum(1)), np.sqrt((rows * rows).sum(1)))
                distance = 1.0 - np.divide(other @ rows.T, size, out=np.zeros_like(size), where=size > 0)
                name = label.as_py()
                distance[[bool(own) and name not in own for own in q_allowed.as_py()]] = np.inf
                if skip_self:
                    distance[q_ids[:, None] == ids[None, :]] = np.inf
                limit = np.frombuffer(q_limits.as_buffer(), "<f8")[:, None]
                distance[distance > limit + 1e-9] = np.inf
                order = np.lexsort((np.broadcast_to(ids, distance.shape), distance), axis=1)[:, :k]
                near = np.take_along_axis(distance, order, 1)
                q, at = np.nonzero(np.isfinite(near))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(ids[order[q, at]]), pa.array(near[q, at])], names=["qid", "id", "distance"])

    return meetings.select("label", "ids", "packed", "dim", "q_ids", "q_packed", "q_allowed", "q_limits").mapInArrow(product, "qid long, id long, distance double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, query_id: str = "qid", query_vector: str = "embedding", allowed_col: str | None = None, skip_self: bool = False, exact: bool = True, block: int = BLOCK) -> DataFrame:
    """(qid, id, distance, rank): the k nearest rows of each query, ties by id, as ``vectors.nearest`` gives them.

    ``allowed_col`` is an array of labels (null or empty allows all). ``exact=False``
    stops after the PROBES nearest cells of a query.
    """
    out, _ = _searched(index, queries, k, query_id, query_vector, allowed_col, skip_self, exact, block)
    return out


def share_read(index: Index, queries: DataFrame, k: int, query_id: str = "qid", query_vector: str = "embedding", allowed_col: str | None = None, skip_self: bool = False, exact: bool = True, block: int = BLOCK) -> float:
    """The rows times queries that a search multiplies, as a share of all of them."""
    _, meetings = _searched(index, queries, k, query_id, query_vector, allowed_col, skip_self, exact, block)
    met = sum(m.select((F.col("n") * (F.octet_length("q_ids") / 8)).alias("met")).agg(F.sum("met")).first()[0] or 0 for m in meetings)
    every = queries.count() * (index.blocks.agg(F.sum("n")).first()[0] or 0)
    return met / max(1, every)


def _searched(index: Index, queries: DataFrame, k: int, query_id: str, query_vector: str, allowed_col: str | None, skip_self: bool, exact: bool, block: int) -> tuple[DataFrame, list[DataFrame]]:
    no_labels = F.array().cast("array<string>")
    allowed: Column = F.coalesce(F.col(allowed_col).cast("array<string>"), no_labels) if allowed_col else no_labels
    asked = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(query_vector).cast("array<double>").alias("vector"), allowed.alias("allowed"), F.lit(2.0).alias("limit"))
    meetings = [_meetings(index, _visits(index, asked, True, block))]
    first = _ranked(_found(meetings[0], k, skip_self), k)
    if not exact:
        return first, meetings
    first = staged(first.drop("rank"), "index-first")
    # with fewer than k rows so far any distance may be among the k
    limits = first.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
    limited = asked.drop("limit").join(limits, "qid", "left").select("qid", "vector", "allowed", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(2.0)).alias("limit"))
    meetings.append(_meetings(index, _visits(index, limited, False, block)))
    return _ranked(first.unionAll(_found(meetings[1], k, skip_self)), k), meetings
