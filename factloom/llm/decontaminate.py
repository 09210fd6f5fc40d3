"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage within k edits of an item of n characters shares at least
n + 1 - q - k q of the item's q-grams with it, and all of them lie on at most
k + 1 neighbouring diagonals (place in the text minus place in the item). Shared
q-grams are counted in diagonal bands of 2 (k + 1), each overlapping the next by
half, so every such passage lies whole in a band. Bands that reach the item's
count are verified by an alignment that computes these diagonals alone.

The lemma sees k edits of q-grams only where n >= q (k + 1); items too short for
their budget at Q are counted by grams of SHORT_Q characters, and items of fewer
than Q characters, whose budget is no edit at all, are searched for as they are.

The documents are read once and never shuffled: the distinct item texts, whose size
is checked, are broadcast in parts of bounded size, PARTS to a pass. A larger
benchmark takes more passes over the documents; each of them is stored, as hits by
the document's text, and holds one group of parts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import fresh, stored, tidy
from factloom.llm.tokens import gather, slices

Q, SHORT_Q = 12, 8
#: Edits allowed for each character of an item.
BUDGET = 0.06
#: Bytes of item texts in one broadcast, and broadcasts of one pass over the documents.
PART_BYTES, PARTS = 1 << 20, 4
BLOCK_BYTES = 4 << 20
_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)  # arrays wrap without a warning


def plain(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def gram_hashes(text: str, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on, put together from runs of 1, 2, 4, ... characters."""
    run = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n, length, power, out, have = len(run) - q + 1, 1, _BASE, None, 0
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if q & length:
            out = run[:n] if out is None else out * power + run[have : have + n]
            have += length
        if have == q:
            return out
        run = run[:-length] * power + run[length:]
        power, length = power * power, length * 2


def banded_distance(item: str, text: str, low: int, high: int) -> int:
    """The least number of edits between ``item`` and any part of ``text`` that
    starts and goes on within the diagonals low..high (place in text - place in item)."""
    a = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), "<u4")
    b = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    far, width = len(a) + len(b) + 1, high - low + 1
    steps = np.arange(width)
    starts = low + steps
    row = np.where((starts >= 0) & (starts <= len(b)), 0, far)
    padded = np.concatenate([b, np.zeros(1, "<u4")])
    for i in range(len(a)):
        at = starts + i  # place in text that item[i] is compared with
        inside = (at >= 0) & (at < len(b))
        same = row + (padded[np.clip(at, 0, len(b))] != a[i])
        same[~inside] = far
        down = np.append(row[1:], far) + 1
        down[~((at >= 0) & (at <= len(b)))] = far
        best = np.minimum(same, down) - steps
        row = np.minimum.accumulate(best) + steps
        row[(at + 1 < 0) | (at + 1 > len(b))] = far
    return int(row.min()) if width > 0 else far


def edits_of(length: int, q: int = Q, budget: float = BUDGET) -> int:
    """The edits an item of so many characters may have: its budget, or what grams of SHORT_Q characters can see of it."""
    most = int(length * budget)
    return most if length < q else min(most, max((length - q) // q, (length - min(q, SHORT_Q)) // min(q, SHORT_Q)))


class Literal:
    """Items of less than q characters: they leak where they stand as words of their own."""

    def __init__(self, rows: list[tuple[tuple, str]]):
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        for ids, text in rows:
            self.tree.add_word(text, (ids, len(text)))
        if rows:
            self.tree.make_automaton()
        self.any = bool(rows)

    def search(self, texts: list[str], found: dict[int, dict]) -> None:
        if not self.any:
            return
        for d, text in enumerate(texts):
            for end, (ids, n) in self.tree.iter(text):
                start = end + 1 - n
                if not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end + 1 < len(text) and text[end].isalnum() and text[end + 1].isalnum()):
                    found.setdefault(d, {}).update(dict.fromkeys(ids, 0))


class Items:
    """The index of a part of the benchmark: its rows by text, each with the ids that have it."""

    def __init__(self, rows: list[tuple], q: int = Q, budget: float = BUDGET):
        of: dict[str, dict] = {}
        for item, text in rows:
            if text := plain(text):
                of.setdefault(text, {})[item] = None
        known = [(tuple(ids), text) for text, ids in of.items()]
        self.literal = Literal([x for x in known if len(x[1]) < q])
        enough = [(len(t) - q) // q >= edits_of(len(t), q, budget) for _, t in known]
        self.grams = [Grams([x for x, e in zip(known, enough, strict=True) if e and len(x[1]) >= q], q, q, budget), Grams([x for x, e in zip(known, enough, strict=True) if not e and len(x[1]) >= q], min(q, SHORT_Q), q, budget)]

    def search(self, texts: list[str]) -> dict[int, dict]:
        """Of normalised texts: {text's place: {item id: edits}}."""
        found: dict[int, dict] = {}
        self.literal.search(texts, found)
        for index in self.grams:
            index.search(texts, found)
        return found


class Grams:
    """The q-gram index of items that the lemma can see."""

    def __init__(self, rows: list[tuple[tuple, str]], q: int, long_q: int, budget: float):
        self.q = q
        self.ids = [ids for ids, _ in rows]
        self.texts = [t for _, t in rows]
        n = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([edits_of(len(t), long_q, budget) for t in self.texts], np.int64)
        self.least = n + 1 - q - self.edits * q
        self.lengths = n
        grams = [gram_hashes(t, q) for t in self.texts]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.hashes, self.first, self.count = np.unique(hashes, return_index=True, return_counts=True)
        self.shift = np.uint64(44)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> self.shift).astype(np.int64)] = True

    def search(self, texts: list[str], found: dict[int, dict]) -> None:
        if not len(self.hashes):
            return
        whole = "\x00".join(texts) + "\x00"
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        starts = np.cumsum(sizes) - sizes
        hashes = gram_hashes(whole, self.q)
        at = np.flatnonzero(self.seen[(hashes >> self.shift).astype(np.int64)])
        rank = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[rank] == hashes[at]
        at, rank = at[same], rank[same]
        if not len(at):
            return
        which, each = gather(self.first, self.count, np.arange(len(self.item)), rank)
        at, item = np.repeat(at, each), self.item[which]
        diagonal = at - self.place[which]
        # diagonals count from their document's start, else a band could join two documents
        doc = np.searchsorted(starts, at, side="right") - 1
        diagonal -= starts[doc]
        half = self.edits[item] + 1
        band = np.floor_divide(diagonal, half)
        keys = np.stack([np.concatenate([doc, doc]), np.concatenate([item, item]), np.concatenate([band, band - 1])])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        n = np.diff(np.append(new, keys.shape[1]))
        doc, item, band = keys[:, new]
        for d, i, b in zip(*(x[n >= self.least[item]].tolist() for x in (doc, item, band)), strict=True):
            k, text, names = int(self.edits[i]), texts[d], self.ids[i]
            known = found.get(d, {}).get(names[0])
            if known == 0:
                continue
            low = b * (k + 1)
            high = low + 2 * (k + 1) - 1
            begin = max(0, low)
            end = min(len(text), high + int(self.lengths[i]) + k)
            region = text[begin:end]
            edits = 0 if self.texts[i] in region else banded_distance(self.texts[i], region, low - begin, high - begin) if k else k + 1
            if edits <= k and (known is None or edits < known):
                own = found.setdefault(d, {})
                own.update({name: min(edits, own.get(name, edits)) for name in names})


def _parts(benchmark: DataFrame, item_col: str, text_col: str):
    """The benchmark's distinct rows in lists of about PART_BYTES of text at most, one list at a time; a longer text is a list alone."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / PART_BYTES))
    rows = stored(rows, "benchmark-items") if n > 1 else rows
    for part in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == part).sort("item", "text").collect()]


def _searched(rows: DataFrame, columns: list[str], parts: list[list[tuple]], q: int, budget: float) -> DataFrame:
    """Fills the last two of ``columns`` (text, items, edits) with what these parts of the benchmark find."""
    told = [rows.sparkSession.sparkContext.broadcast(part) for part in parts]
    names = rows.columns
    text_at, items_at, edits_at = map(names.index, columns)

    def run(batches):
        import pyarrow as pa

        indexes = [Items(part.value, q, budget) for part in told]
        for batch in batches:
            texts = batch.column(text_at)
            items, edits = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for start, stop in slices(texts, BLOCK_BYTES):
                own = [plain(t) for t in texts.slice(start, stop - start).to_pylist()]
                found: dict[int, dict] = {}
                for index in indexes:
                    for d, more in index.search(own).items():
                        told_of = found.setdefault(d, {})
                        told_of.update({name: min(e, told_of.get(name, e)) for name, e in more.items()})
                for d, of in found.items():
                    both = sorted(of.items())
                    items[start + d], edits[start + d] = [i for i, _ in both], [e for _, e in both]
            arrays = list(batch.columns)
            arrays[items_at], arrays[edits_at] = pa.array(items, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(tidy(run), rows.schema)


def _groups(parts, size: int):
    """Lists of up to ``size`` parts, one list at a time."""
    held: list = []
    for part in parts:
        held.append(part)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _marked(rows: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, q: int, budget: float) -> tuple[DataFrame, str, str]:
    """``rows`` with two more columns, ids and edits of the items found, and their names."""
    text, items, edits, key = fresh(rows, "_text", "_items", "_edits", "_key")
    none = {items: F.array().cast("array<long>"), edits: F.array().cast("array<int>")}
    whole = rows.withColumn(text, F.col(text_col).cast("string"))
    hits: DataFrame | None = None
    last: list[list[tuple]] = []
    for group in _groups(_parts(benchmark, item_col, item_text), PARTS):
        if last:  # more than one pass: what the one before found is stored by text
            own = _searched(whole.select(text).withColumns(none), [text, items, edits], last, q, budget).where(F.size(items) > 0)
            own = stored(own.select(F.sha2(text, 256).alias(key), F.explode(F.arrays_zip(items, edits)).alias("hit")).distinct(), "leaks-of-parts")
            hits = own if hits is None else hits.unionAll(own)
        last = group
    found = _searched(whole.withColumns(none), [text, items, edits], last, q, budget)
    if hits is None:
        return found.drop(text), items, edits
    pair = F.struct(F.col(f"hit.{items}").alias("item"), F.col(f"hit.{edits}").alias("edits"))
    earlier = hits.groupBy(key).agg(F.collect_set(pair).alias("_earlier"))
    own = F.transform(F.arrays_zip(items, edits), lambda h: F.struct(h[items].alias("item"), h[edits].alias("edits")))
    both = F.array_sort(F.concat(own, F.coalesce("_earlier", F.array().cast("array<struct<item:long,edits:int>>"))))
    # of an item with several texts the fewest edits count: the first of its entries in order
    both = F.filter(both, lambda h, i: (i == 0) | (F.get(both, i - 1)["item"] != h["item"]))
    joined = found.withColumn(key, F.sha2(text, 256)).join(earlier, key, "left").withColumn("_earlier", both)
    return joined.withColumns({items: F.transform("_earlier", lambda h: h["item"]), edits: F.transform("_earlier", lambda h: h["edits"])}).select(*rows.columns, items, edits), items, edits


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, budget: float = BUDGET) -> DataFrame:
    """A row for each row of ``docs``: id, contaminated, n_items, item_ids (ascending), edits (of each).

    A document is contaminated by an item where some part of it is within
    floor(budget * characters) edits of the whole item, both in lower case with
    single spaces. An item of fewer than ``q`` characters leaks where it stands as it
    is and as words of its own. Items with a null id or text and items without a
    character are not looked for; null and empty documents are clean. Repeated rows
    pass through; equal items with different ids are all named, one id with two
    texts once, with the fewer edits. Other columns are not read. An empty benchmark
    leaves all documents clean; an empty table gives no rows.
    """
    marked, items, edits = _marked(docs.select(id_col, text_col), text_col, benchmark, item_col, item_text, q, budget)
    n = F.size(items)
    return marked.select(id_col, (n > 0).alias("contaminated"), n.alias("n_items"), F.col(items).alias("item_ids"), F.col(edits).alias("edits"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    marked, items, _ = _marked(docs, text_col, benchmark, item_col, item_text, q, budget)
    return marked.where(F.size(items) == 0).select(*docs.columns)
