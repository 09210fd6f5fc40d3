"""SimHash near-dedup with pigeonring candidate filtering.

Fingerprints differ in at most T bits. Cut into m > T segments on a ring, the
differences d of two such fingerprints have a start i from which every run of
consecutive segments stays within its share: d[i] + ... + d[i+l-1] <= l * T / m
for all l (the pigeonring principle). The first segment of that chain is then
equal and the first two differ in floor(2 T / m) <= 1 bits, which is an equi-join:
one side has a key for each start, the other the same key and those at one bit
from it in the second segment. Longer runs of the chain prune what the join
finds, and the full Hamming distance decides.

Equal fingerprints are one node, so copies never pair up. Components are found by
alternating large and small stars on tables of edges; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import discard, stored

SEED = 42
#: Shingles hashed at once; a longer text goes on in parts.
PART = 50_000


def fingerprint_bytes(text: str | None, words: int) -> bytes:
    """The 8 bytes (most significant first) of a text's fingerprint."""
    import numpy as np
    import xxhash

    hashed = xxhash.xxh64_digest
    own = (text or "").encode().lower().split()
    if not own:
        return bytes(8)
    if len(own) < words:
        return hashed(b" ".join(own), SEED)
    total, n = np.zeros(64, np.int64), len(own) - words + 1
    join = b" ".join
    for at in range(0, n, PART):
        part = own[at : at + PART + words - 1]
        shingles = zip(*(part[i:] for i in range(words)), strict=False)
        bits = np.unpackbits(np.frombuffer(b"".join([hashed(join(s), SEED) for s in shingles]), np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return np.packbits(total * 2 > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row; whole texts, null as empty."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            prints = b"".join([fingerprint_bytes(t, words) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(prints, ">i8").astype(np.int64), pa.int64())], names=[id_col, "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def ring(bits: int, m: int) -> tuple[list[int], list[int]]:
    """(edges of m segments of 64 bits, the most bits that runs of 1 to m segments of a chain may differ in)."""
    return [64 * i // m for i in range(m + 1)], [length * bits // m for length in range(1, m + 1)]


def segment(fp: Column, edges: list[int], i: int) -> Column:
    return F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))


def chain_from(differ: Column, i: int, edges: list[int], share: list[int]) -> Column:
    """Whether every run from segment i on, short of the whole ring, stays within its share; ``differ`` is two fingerprints' exclusive or."""
    m = len(share)
    good, total = F.lit(True), F.lit(0)
    for length in range(m - 1):
        total = total + F.bit_count(segment(differ, edges, (i + length) % m))
        good = good & (total <= share[length])
    return good


def near(a: Column, b: Column, bits: int, m: int = 8) -> Column:
    """Whether two fingerprints differ in at most ``bits`` bits: some chain of segments within its shares first, then all bits."""
    edges, share = ring(bits, m)
    differ = a.bitwiseXOR(b)
    some = F.lit(False)
    for i in range(m):
        some = some | chain_from(differ, i, edges, share)
    return some & (F.bit_count(differ) <= bits)


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b), a < b, of all fingerprints of ``prints`` (column fp, distinct) at 1 to ``bits`` bits; a pair may come more than once."""
    if not 0 <= bits <= 12:
        raise ValueError("from 0 to 12 bits")
    m = max(3, bits + 1)
    edges, share = ring(bits, m)
    wide = [edges[i + 1] - edges[i] for i in range(m)]
    fp = F.col("fp")
    keys, probes = [], []
    for i, j in [(i, (i + 1) % m) for i in range(m)]:
        head = F.shiftleft(segment(fp, edges, i), wide[j])
        keys.append(F.struct(F.lit(i).alias("chain"), head.bitwiseOR(segment(fp, edges, j)).alias("key")))
        flips = [0, *(1 << k for k in range(wide[j]))] if share[1] else [0]
        probes += [F.struct(F.lit(i).alias("chain"), head.bitwiseOR(segment(fp, edges, j).bitwiseXOR(F.lit(x))).alias("key")) for x in flips]
    left = prints.select(fp.alias("a"), F.explode(F.array(*probes)).alias("k")).select("a", "k.chain", "k.key")
    right = prints.select(fp.alias("b"), F.explode(F.array(*keys)).alias("k")).select("b", "k.chain", "k.key")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(False)
    for i in range(m):
        chain = F.when(F.col("chain") == i, chain_from(differ, i, edges, share)).otherwise(chain)
    return left.join(right, ["chain", "key"]).where("a < b").where(chain).where(F.bit_count(differ) <= bits).select("a", "b")


def _key(name: str) -> Column:
    """A join key made anew: the join then has an exchange of its own, and the rows of a key that very many have (a star's centre) can be split."""
    return F.bitwise_not(name)


def _anew(name: str) -> Column:
    return _key(name).alias("_key")


def components(edges: DataFrame, name: str = "star") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root is the component's smallest node.

    Alternating large and small stars. Each round's edges are a stored table, so
    the plan stays short and lost executors cost one round's work at most.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = mark(now)
    while before[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(_anew("a"), F.least("a", "m").alias("m"))
        large = both.withColumns({"_key": _key("a")}).join(least, "_key").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(_anew("a"), "m")
        small = large.withColumns({"_key": _key("a")}).join(least, "_key")
        small = small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        last, now = now, stored(small, name)
        after = mark(now)
        discard(last)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """A row for each row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most ``bits``
    differing bits. Texts without words (null, empty, white space) have the
    fingerprint zero and link like others; a text of fewer than ``words`` words is
    one shingle. Null ids never name a component unless all its ids are null.
    Repeated rows and equal texts share a fingerprint; other columns are not read;
    an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min(id_col).alias("_least")), "nodes")
    stars = components(links(nodes.select("fp"), bits))
    rooted = nodes.join(stars, nodes["fp"] == stars["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id")).select(_anew("root"), "component_id")
    named = rooted.select("fp", _anew("root")).join(least, "_key").select(_anew("fp"), "component_id")
    told = rows.select(id_col, "fp", _anew("fp")).join(named, "_key")
    return told.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, one id for each component: the smallest, all its rows.

    Rows of null id take no part and stay: no id could say which of them another is
    a copy of.
    """
    keep = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, words, bits).select("component_id").distinct()
    return docs.where(F.col(id_col).isNull()).unionAll(docs.join(keep, docs[id_col] == keep["component_id"], "left_semi"))
