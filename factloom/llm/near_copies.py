"""Near copies by the similarity of word-shingle sets: SimHash near-dedup where a
similarity is asked for.

At a similarity of 0.8 fingerprints differ in more bits than keys made of
fingerprints can find among many documents. So candidates share a rare shingle, as
below; the pigeonring filter and the full Hamming distance of their fingerprints (four
words of 64 bits, a ring of four segments) then leave out nearly all that only share a
passage, within the join that finds them, before the whole sets decide. How many bits
may differ follows from the similarity and the sets' size (``most_bits``).

All shingles have one order. Of two sets of similarity t or more, the larger (n) has a
shingle of the smaller (m) among its first n - ceil(t n) + 1, and that shingle is among
the first m - ceil(2 t m / (1 + t)) + 1 of the smaller, so those are the keys of an
equi-join; the sets' sizes are part of the key as classes of ratio t. Sizes, places,
fingerprints and the count of shared keys prune what it finds, and the whole sets
decide. Any order gives the same pairs: shingles that are frequent in a sample go
last, so that they are seldom keys.

What is asked for is components, so a group of g copies need not become g * g
pairs. First the sets of a key are compared with a few of them alone (CENTERS stars, by
the first STAR_KEYS shared keys of a set), which makes most of a group one component; then
sets of one key in different components, those of the closest fingerprints before the others
(CLOSE), which joins groups whose members have a few links each among many that are
just not similar; at last all sets of one key that are still in different components. A link within
a component changes nothing, so the rounds before the last bear on speed alone. Keys that a single set has are
left out before anything is joined, and equal sets are one node: a hash of 64 bits,
with a second one beside it that tells sets of one hash apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.llm.shared import discard, fresh, stored, tidy
from factloom.llm.simhash import PART, SEED, components

#: Share of the rows that tells frequent shingles (a share, so that what escapes it is in a bounded number of texts at
#: any size) and the most shingles taken from it, 8 bytes each in a broadcast; they bear on speed alone.
SAMPLE, FREQUENT = 0.2, 500_000
#: Sets of each key that all others of the key are compared with first, and keys of a set that count for that.
CENTERS, STAR_KEYS = 6, 8
#: Words of 64 bits of a fingerprint, made of the shingles' hashes by these odd factors.
FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: Deviations that similar sets' fingerprints may differ by beyond what is expected, and what sets of n shingles are allowed beyond large ones, over the root of n.
DEVIATIONS, SMALL = 6, 0.12
#: The same for pairs that are compared in rounds before the others, the closest first: of these more are similar.
CLOSE = (-2, -1)
PRINTS = [f"f{i}" for i in range(len(FACTORS))]


def shingle_set(text: str | None, words: int):
    """The distinct shingle hashes of a text, ascending; a text of fewer words is one shingle."""
    import numpy as np
    import xxhash

    own, hashed, join = (text or "").encode().lower().split(), xxhash.xxh64_intdigest, b" ".join
    if len(own) < words:
        return np.array([hashed(join(own), SEED)], np.uint64).view(np.int64)
    found = []
    for at in range(0, len(own) - words + 1, PART):
        part = own[at : at + PART + words - 1]
        shingles = zip(*(part[i:] for i in range(words)), strict=False)
        found.append(np.unique(np.array([hashed(join(s), SEED) for s in shingles], np.uint64).view(np.int64)))
    return np.unique(np.concatenate(found))


def _node(own) -> tuple[int, int]:
    """Two hashes of a set."""
    import numpy as np
    import xxhash

    packed = own.tobytes()
    return tuple(int(np.uint64(xxhash.xxh64_intdigest(packed, SEED + i)).astype(np.int64)) for i in range(2))


def _fingerprint(own) -> list[int]:
    """The words of a set's fingerprint: a bit is 1 if set in over half the hashes."""
    import numpy as np

    bits = np.zeros(64 * len(FACTORS), np.int64)
    for at in range(0, len(own), PART // len(FACTORS)):
        h, words = own[at : at + PART // len(FACTORS)].view(np.uint64), []
        for factor in FACTORS:
            x = h * np.uint64(factor)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xFF51AFD7ED558CCD)
            words.append(x ^ (x >> np.uint64(29)))
        bits += np.unpackbits(np.stack(words, 1).astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(bits * 2 > len(own)).view(">i8").tolist()


def most_bits(least: float, n: Column, deviations: float = DEVIATIONS) -> Column:
    """Bits of a fingerprint that two sets of similarity ``least`` may differ in, the smaller of ``n`` shingles.

    Their cosine is 2 t / (1 + t) or more, so a bit differs with the angle's share of a
    half turn at most, a little oftener for few shingles, whose halves tie. DEVIATIONS
    beyond what is expected are a loss of one similar pair in a hundred million.
    """
    size = 64 * len(FACTORS)
    share = F.least(F.lit(0.5), math.acos(2 * least / (1 + least)) / math.pi + SMALL / F.sqrt(n))
    return size * share + deviations * F.sqrt(size * share * (1 - share))


def near(a: list[Column], b: list[Column], bits: Column) -> Column:
    """Whether fingerprints differ in at most ``bits`` bits: a chain of words from some start on the ring within its shares of them first, then all words."""
    differ = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    m, some = len(differ), F.lit(False)
    for i in range(m):
        good, total = F.lit(True), F.lit(0)
        for length in range(1, m):
            total = total + differ[(i + length - 1) % m]
            good = good & (total <= bits * length / m)
        some = some | good
    return some & (sum(differ[1:], differ[0]) <= bits)


def _least(share: float, n: int) -> int:
    """The smallest whole number that is at least ``share`` of ``n``."""
    return math.ceil(share * n - 1e-9)


def frequent(docs: DataFrame, text_col: str, words: int) -> bytes:
    """The shingles in several rows of a sample, the most frequent last, as packed longs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words))], names=["key"])

    import numpy as np

    sample = docs.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(1_000)) < SAMPLE * 1_000)
    seen = sample.mapInArrow(tidy(run), "key long").groupBy("key").count().where("count > 2")
    top = seen.orderBy(F.desc("count"), "key").limit(FREQUENT).select("key").toArrow()["key"].to_numpy()
    return np.ascontiguousarray(top[::-1], "<i8").tobytes()


def _prefixes(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """id, node and twin (hashes of the whole set), n (its size), the words of its fingerprint and keys (its first shingles in the common order)."""
    late = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col, words))  # FREQUENT numbers at most

    def run(batches):
        import numpy as np
        import pyarrow as pa

        told = np.frombuffer(late.value, "<i8")
        by = np.argsort(told)
        told = told[by]
        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, words)
                rank = np.zeros(len(own), np.int64)
                if len(told):
                    at = np.minimum(np.searchsorted(told, own), len(told) - 1)
                    rank = np.where(told[at] == own, by[at] + 1, 0)
                nodes.append(_node(own))
                sizes.append(len(own))
                prints.append(_fingerprint(own))
                keys.append(own[np.lexsort((own, rank))[: len(own) - _least(least, len(own)) + 1]])
            columns = [*zip(*nodes, strict=True), sizes, *zip(*prints, strict=True)] if nodes else [[]] * (3 + len(FACTORS))
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * len(FACTORS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(keys, pa.list_(pa.int64()))], names=[id_col, "node", "twin", "n", *PRINTS, "keys"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), f"`{id_col}` {id_type}, node long, twin long, n int, {', '.join(f'{f} long' for f in PRINTS)}, keys array<long>")


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with a node of its own for each set: sets that share the first hash are told apart by the second."""
    shared = rows.groupBy("node").agg(F.min("twin").alias("_first"), F.max("twin").alias("_last")).where("_first <> _last").select(F.col("node").alias("_node"), "_first")
    shared = stored(shared, "near-shared-nodes")  # next to none
    joined = rows.join(shared, F.col("node") == F.col("_node"), "left")
    return joined.withColumn("node", F.when(F.col("twin") != F.col("_first"), F.xxhash64("node", "twin")).otherwise(F.col("node"))).drop("_node", "_first")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """node and its whole set as packed longs, once each, of rows (node, twin, text); a text of another set (an id may have several) is none of the node's."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for node, twin, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = shingle_set(text, words)
                if _node(own)[1] == twin:
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["node", "own"])

    return docs.mapInArrow(tidy(run), "node long, own binary").dropDuplicates(["node"])


def _similar(pairs: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, own_a, own_b) whose sets are similar enough."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= _least(least, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b", "own_a", "own_b").mapInArrow(tidy(run), "a long, b long")


def _shared(rows: DataFrame) -> DataFrame:
    """(key, node, n, fingerprint, at), once each, of the keys that several sets have."""
    keys = rows.select("node", "n", *PRINTS, F.posexplode("keys").alias("at", "key"))
    # least and greatest set of a key: partial, and a set that very many rows have counts once
    ends = keys.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a <> _b").select("key")
    return keys.join(ends, "key", "left_semi").dropDuplicates(["key", "node"])


def _whole(least: float, n: str) -> Column:
    """The shingles that a set of ``n`` shares with a similar one no smaller."""
    return F.ceil(F.col(n) * (2 * least / (1 + least)) - 1e-9)


def _fits(least: float, exact: bool, deviations: float = DEVIATIONS) -> Column:
    """Whether sets x and y (y no larger) that share a key at their places may be similar enough, by sizes, places and fingerprints."""
    enough = (F.col("n_x") + F.col("n_y")) * (least / (1 + least)) - 1e-9
    room = 1 + F.least(F.col("n_x") - F.col("at_x") - 1, F.col("n_y") - F.col("at_y") - 1)
    smaller = (F.col("n_y") < F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("y") < F.col("x")))
    prints = [[F.col(f"{f}_{s}") for f in PRINTS] for s in "xy"]
    fits = smaller & (F.col("n_y") >= F.col("n_x") * least - 1e-9) & (room >= enough)
    return fits if exact else fits & near(*prints, most_bits(least, F.col("n_y"), deviations))


def _side(rows: DataFrame, name: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "at", *PRINTS)])


def _pruned(found: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``found`` (a row for each key that x and y share) that share enough keys to be similar."""
    shared = found.groupBy("x", "y", "n_x", "n_y").agg(F.count(F.lit(1)).alias("both"), F.max("at_x").alias("at_x"), F.max("at_y").alias("at_y"))
    # what else the sets share comes after the last shared key that had room, in both
    more = F.least(F.col("n_x") - F.col("at_x") - 1, F.col("n_y") - F.col("at_y") - 1)
    return shared.where(F.col("both") + more >= (F.col("n_x") + F.col("n_y")) * (least / (1 + least)) - 1e-9).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _stars(shared: DataFrame, least: float, exact: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of CENTERS sets of each key (those with the least of several hashes, the same ones wherever they occur) with the others of the key; and the stored table they come from.

    Only the first keys of a set that others have count, so a similar pair may be missed
    here; it is found where sets that are still apart are compared.
    """
    nth = F.row_number().over(Window.partitionBy("node").orderBy("at"))  # as many rows as a set has keys
    few = stored(shared.withColumn("_nth", nth).where(F.col("_nth") <= STAR_KEYS).drop("_nth"), "near-first-keys")
    held = ("node", "n", "at", *PRINTS)
    least_of = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), *held)).alias(f"c{i}") for i in range(CENTERS)]
    # the key is made anew, so that the rows of a key that very many sets have can be split in the join
    centers = few.groupBy("key").agg(*least_of).select(F.bitwise_not("key").alias("_key"), F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"c{i}.{x}").alias(x) for x in held]) for i in range(CENTERS)]))).alias("c")).select("_key", "c.*")
    others = few.withColumn("_key", F.bitwise_not("key"))
    pairs = [_side(x, "x", "_key").join(_side(y, "y", "_key"), "_key").where(_fits(least, exact)).select("x", "y") for x, y in ((others, centers), (centers, others))]
    return pairs[0].unionAll(pairs[1]).distinct().select(F.col("x").alias("a"), F.col("y").alias("b")), few


def _across(shared: DataFrame, stars: DataFrame, least: float, exact: bool, deviations: float = DEVIATIONS) -> tuple[DataFrame, DataFrame]:
    """Pairs of sets that share a key and are in different components of ``stars`` (node, root); and the stored table of the keys they share, with ``root``."""
    rooted = shared.drop("root").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # keys whose sets are all in one component have nothing left to compare
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("key")
    held = stored(rooted.join(open_keys, "key", "left_semi"), "near-open")
    left = held.withColumn("_key", F.bitwise_not("key"))
    # a set no larger than another and of its size times ``least`` or more is in its size class or the one below
    size = F.floor(F.log(F.col("n").cast("double")) / -math.log(least) + 1e-9).cast("int") if least < 1 else F.col("n")
    x = _side(left.withColumn("class", F.explode(F.array(size, size - 1))), "x", "_key", "class", F.col("root").alias("root_x"))
    y = _side(left.where(F.col("at") <= F.col("n") - _whole(least, "n")).withColumn("class", size), "y", "_key", "class", F.col("root").alias("root_y"))
    return _pruned(x.join(y, ["_key", "class"]).where((F.col("root_x") != F.col("root_y")) & _fits(least, exact, deviations)), least), held


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """The (a, b) of ``pairs`` whose whole sets, made from the texts once more, are similar enough; and the tables they are made of."""
    pairs = stored(pairs, "near-pairs")
    asked = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    ids = nodes.join(asked, "node", "left_semi").select(F.col("_least").alias("_id"), "node", "twin")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(ids, "_id")
    sets = stored(_sets(texts.select("node", "twin", "_text"), words), "near-sets")
    whole = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
    return _similar(whole, least), [pairs, sets]


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, exact: bool = False) -> DataFrame:
    """(id, component_id) of the rows that go: all of a component but its smallest id.

    Rows link where the Jaccard similarity of their sets of ``words``-word shingles
    is ``least`` or more: all pairs but one in a hundred million, whose fingerprints
    are by chance further apart than ``most_bits``; ``exact=True`` goes without
    fingerprints. A text of fewer words is one shingle, a null text is empty, and empty
    texts are copies of each other. Null ids take no part.
    """
    if not 0 < least <= 1:
        raise ValueError("a similarity over 0 and up to 1")
    docs = docs.where(F.col(id_col).isNotNull())
    hashed = stored(_prefixes(docs, id_col, text_col, words, least), "near-prefixes")
    rows = stored(_told_apart(hashed), "near-rows")
    discard(hashed)
    nodes = stored(rows.groupBy("node", "twin").agg(F.min(id_col).alias("_least")), "near-nodes")
    shared = stored(_shared(rows), "near-keys")
    pairs, few = _stars(shared, least, exact)
    links, made = _links(pairs, nodes, docs, id_col, text_col, words, least)
    first = stored(links, "near-links")
    discard(few, *made)
    found, linked = [first], first
    for deviations in (*CLOSE, None):
        only = (False, deviations) if deviations is not None else (exact,)
        pairs, opened = _across(shared, components(linked, "near-star"), least, *only)
        links, made = _links(pairs, nodes, docs, id_col, text_col, words, least)
        found.append(stored(links, "near-links"))
        linked = linked.unionAll(found[-1])
        discard(*made, shared)
        shared = opened  # keys whose sets are in one component stay closed
    roots = components(linked, "near-star")
    discard(shared, *found)

    rooted = nodes.select("node", "_least").join(roots, "node", "left").select("node", "_least", F.coalesce("root", "node").alias("root"))
    least_of = rooted.groupBy("root").agg(F.min("_least").alias("component_id")).select(F.bitwise_not("root").alias("_root"), "component_id")
    named = rooted.select("node", F.bitwise_not("root").alias("_root")).join(least_of, "_root").select(F.bitwise_not("node").alias("_node"), "component_id")
    own = rows.select(id_col, F.bitwise_not("node").alias("_node")).join(named, "_node")
    out = stored(own.where(F.col(id_col) != F.col("component_id")).select(id_col, "component_id"), "near-copies")
    discard(rows, nodes)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, exact: bool = False) -> DataFrame:
    """The rows of ``docs`` without ``copies``; rows of null id stay."""
    (gone,) = fresh(docs, "_gone")
    drop = copies(docs, id_col, text_col, words, least, exact).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(drop, docs[id_col] == F.col(gone), "left_anti")
