"""Phrase collocation mining by direct-address tiling.

Words of each language get ids by frequency, so that frequent pairs have small ids.
A task turns its texts into ids and counts pairs (unit, next word) in tiles of TILE by
TILE ids: a tile with many pairs is a dense array, counted by its addresses with
bincount; the pairs of all other tiles are sorted codes with run lengths (COO).
Frequent pairs are then ranked by frequency and become the units of the next round,
which counts (pair, next word) alike; so on to the longest phrase.

A part of a frequent phrase is at least as frequent, so a phrase is counted only where
both the phrase without its last word and that without its first are known as
frequent. Tasks know the ids of the TABLE most frequent words and of the PAIRS most
frequent units, which bounds what is broadcast. Where there are more, the phrases that
lack an id are counted too, as texts: no phrase is lost, whatever the table holds.

Tasks add up what they count before it is shuffled, and all that follows are sums and
joins of counts. Scores are exact: counts and products are decimals of 38 digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.llm.shared import stored, tidy

#: Words and units whose ids are broadcast (words of at most LONGEST bytes), width of a tile, and tokens that are counted at once.
TABLE, PAIRS, LONGEST, TILE, TOKENS = 1_000_000, 2_000_000, 64, 1_024, 1_000_000
#: Distinct words and phrases a task holds before it hands them on, and bytes of a text that are split at once.
HELD, PART = 300_000, 1 << 22
#: Parts in which the first rows of a language are looked for.
PARTS = 16
UNDETERMINED = "und"
#: The marks between pieces.
MARKS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"."
_GAP = re.compile(rb"[ \t.]")
_TO_BREAK = bytes(BREAK[0] if x in MARKS else x for x in range(256))

COUNTS = "lang string, unit int, next int, phrase string, f long"


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased words in order, BREAK between pieces; a long text comes in parts."""
    whole, at = (text or "").encode().lower().translate(_TO_BREAK), 0
    while at < len(whole):
        gap = _GAP.search(whole, at + PART)
        end = gap.start() if gap else len(whole)
        yield whole[at:end].replace(BREAK, b" . ").split()
        at = end


def _language(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.col(text_col).cast("string").alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word, f: how often each word occurs."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        total: dict[str, Counter] = {}

        def told():
            for lang, own in total.items():
                own.pop(BREAK, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64())], names=["lang", "word", "f"])
            total.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, Counter())
                for part in tokens(text):
                    own.update(part)
                if sum(map(len, total.values())) > HELD:
                    yield from told()
        yield from told()

    return _language(docs, text_col, lang_col).mapInArrow(tidy(run), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


@dataclass
class Ids:
    """The ids that tasks know: of words, and of the units (as codes of word and unit ids) of each round so far.

    ``whole``: everything frequent has an id, so what has none needs no count.
    """

    words: dict[str, dict[bytes, int]]
    rounds: list[dict[str, tuple[np.ndarray, np.ndarray]]]
    whole: bool

    def encoded(self, lang: str, found: list[bytes]) -> np.ndarray:
        """Word ids in order; -1 is a break, -2 a word without an id."""
        return np.fromiter(map(self.words.get(lang, {BREAK: -1}).get, found, repeat(-2)), np.int32, len(found))

    def units(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """The id of the unit that starts at each place, in the units of the last round; -1 over a break, -2 without an id."""
        units = ids
        for known in self.rounds:
            codes, rank = known.get(lang, (np.empty(0, np.int64), np.empty(0, np.int32)))
            left, right = units[:-1], ids[len(ids) - len(units) + 1 :]
            code = (left.astype(np.int64) << 32) | right
            at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            hit = (codes[at] == code) & (left >= 0) & (right >= 0) if len(codes) else np.zeros(len(code), bool)
            units = np.where((left == -1) | (right == -1), np.int32(-1), np.int32(-2))
            units[hit] = rank[at[hit]]
        return units


def tiled(left: np.ndarray, right: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, count) of the distinct pairs: full tiles by direct addresses, the others as sorted codes with run lengths."""
    out, rest = [], np.ones(len(left), bool)
    of = ((left // tile) << 32) | (right // tile)
    tiles, sizes = np.unique(of, return_counts=True)
    for t in tiles[sizes * 4 >= tile * tile]:
        own = np.flatnonzero(of == t)
        rest[own] = False
        counts = np.bincount((left[own] % tile) * tile + right[own] % tile, minlength=tile * tile)
        at = np.flatnonzero(counts)
        out.append(((t >> 32) * tile + at // tile, (t & 0xFFFFFFFF) * tile + at % tile, counts[at]))
    codes = np.sort((left[rest] << 32) | right[rest])
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    out.append((codes[first] >> 32, codes[first] & 0xFFFFFFFF, np.diff(np.append(first, len(codes)))))
    a, b, n = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b, n


def phrase_counts(docs: DataFrame, ids: Ids, text_col: str = "text", lang_col: str = "lang", tile: int = TILE) -> DataFrame:
    """COUNTS of the phrases one word longer than the units of ``ids``: by ids (phrase is null), or by their text where they lack one (unit and next are -1)."""
    held = docs.sparkSession.sparkContext.broadcast(ids)  # TABLE words of LONGEST bytes and PAIRS codes a round at most
    size, whole = len(ids.rounds) + 2, ids.whole

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        known, waiting, texts = held.value, {}, {}

        def batch_of(lang, unit, after, phrases, f):
            n = len(f)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), n), pa.array(unit, pa.int32()), pa.array(after, pa.int32()), phrases, pa.array(f, pa.int64())], names=["lang", "unit", "next", "phrase", "f"])

        def counts(lang):
            row = np.concatenate(waiting.pop(lang))
            units = known.units(lang, row)
            left, right = units[:-1], row[size - 1 :]
            full = (left >= 0) & (right >= 0)
            if size > 2:  # the phrase without its first word is frequent too, or is one without an id
                full &= (units[1:] >= 0) | ((units[1:] == -2) & (not whole))
            if full.any():
                a, b, n = tiled(left[full].astype(np.int64), right[full].astype(np.int64), tile)
                for at in range(0, len(n), HELD):
                    part = slice(at, at + HELD)
                    yield batch_of(lang, a[part], b[part], pa.nulls(len(n[part]), pa.string()), n[part])

        def odd(lang, found, row):
            """Phrases without an id, as texts: only where not everything frequent has one."""
            units = known.units(lang, row)
            left, right = units[:-1], row[size - 1 :]
            lacks = (left != -1) & (right != -1) & ((left == -2) | (right == -2))
            own = texts.setdefault(lang, Counter())
            own.update(b" ".join(found[i : i + size]) for i in np.flatnonzero(lacks).tolist())

        def told():
            for lang, own in texts.items():
                yield batch_of(lang, pa.repeat(pa.scalar(-1, pa.int32()), len(own)), pa.repeat(pa.scalar(-1, pa.int32()), len(own)), pa.array(list(own), pa.binary()).cast(pa.string()), list(own.values()))
            texts.clear()

        total = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last: list[bytes] = []
                for part in tokens(text):
                    part = last + part  # phrases that begin in the part before
                    last = part[1 - size :]
                    row = known.encoded(lang, part)
                    if not whole and len(row) >= size:
                        odd(lang, part, row)
                        if sum(map(len, texts.values())) > HELD:
                            yield from told()
                    waiting.setdefault(lang, []).extend((row, np.array([-1], np.int32)))
                    total += len(row)
                    if total > TOKENS:
                        for one in list(waiting):
                            yield from counts(one)
                        total = 0
        for lang in list(waiting):
            yield from counts(lang)
        yield from told()

    return _language(docs, text_col, lang_col).mapInArrow(tidy(run), COUNTS).groupBy("lang", "unit", "next", "phrase").agg(F.sum("f").alias("f"))


def _ranked(counts: DataFrame, most: int, name: str, *columns: str) -> DataFrame:
    """The ``most`` most frequent rows of ``counts`` with their rank in their language, from 0."""
    order = [F.desc("f"), *columns]
    top = counts.select("lang", *columns, "f").orderBy(F.desc("f"), "lang", *columns).limit(most)  # so no language has more rows than that
    return stored(top.select("lang", *columns, (F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).alias("rank")), name)


def _by_language(ranks: DataFrame, *columns: str) -> Iterator[tuple[str, list]]:
    """(language, its values of ``columns`` in order of rank) of a table of ``_ranked``."""
    import pyarrow.compute as pc

    told = ranks.select("lang", *columns).orderBy("lang", "rank").toArrow()  # TABLE or PAIRS rows at most
    lang = told["lang"].combine_chunks().dictionary_encode()
    for i, name in enumerate(lang.dictionary.to_pylist()):
        own = told.filter(pc.equal(lang.indices, i))
        yield name, [own[c].combine_chunks() for c in columns]


def phrases(docs: DataFrame, words: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, table: int = TABLE, most: int = PAIRS, tile: int = TILE) -> DataFrame:
    """lang, phrase, words, f: every phrase of 1 to ``longest`` words that occurs ``least`` times or more in its language, within pieces.

    ``words`` are the ``word_counts``.
    """
    frequent = stored(words.where(F.col("f") >= least), "phrase-frequent")
    names = _ranked(frequent.where(F.octet_length("word") <= LONGEST), table, "phrase-names", "word")
    known = {lang: {BREAK: -1} | {w.encode(): i for i, w in enumerate(own.to_pylist())} for lang, (own,) in _by_language(names, "word")}
    held = Ids(known, [], frequent.count() == names.count())
    units, names = names.select("lang", F.col("rank").alias("unit"), F.col("word").alias("start")), names.select("lang", F.col("rank").alias("next"), "word")
    out = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")
    for size in range(2, longest + 1):
        counts = stored(phrase_counts(docs, held, text_col, lang_col, tile).where(F.col("f") >= least), "phrase-counts")
        named = counts.where("phrase is null").drop("phrase").join(units, ["lang", "unit"]).join(names, ["lang", "next"])
        named = stored(named.select("lang", "unit", "next", F.concat_ws(" ", "start", "word").alias("phrase"), "f"), "phrase-named")
        out = out.unionAll(named.select("lang", "phrase", F.lit(size), "f")).unionAll(counts.where("phrase is not null").select("lang", "phrase", F.lit(size), "f"))
        if size < longest:
            ranks = _ranked(named, most, "phrase-ranks", "unit", "next")
            coded = {}
            for lang, (unit, after) in _by_language(ranks, "unit", "next"):
                codes = (unit.to_numpy().astype(np.int64) << 32) | after.to_numpy()
                by = np.argsort(codes)
                coded[lang] = codes[by], by.astype(np.int32)
            held = Ids(known, [*held.rounds, coded], held.whole and counts.count() == ranks.count())
            units = stored(named.join(ranks, ["lang", "unit", "next"]).select("lang", F.col("rank").alias("unit"), F.col("phrase").alias("start")), "phrase-units")
    return out


def _ratio(a: str, left: str, right: str) -> Column:
    """floor(10^6 a^2 / (left right)), exact for counts of up to 15 digits."""
    whole = {x: f"cast({x} AS DECIMAL(15,0))" for x in (a, left, right)}
    return F.expr(f"({whole[a]} * {whole[a]} * 1000000BD) div ({whole[left]} * {whole[right]})")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, share: int = 50, first: int = 2_000, table: int = TABLE, most: int = PAIRS, tile: int = TILE) -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to ``longest`` words that occur ``least`` times or more (a) within
    the pieces between marks are scored at each cut by floor(10^6 a^2 / (l r)), where
    l and r are what the two parts occur; the lowest cut counts, the shortest first
    part of several. A phrase of which ``share`` per cent or more stand within one
    longer candidate is dropped. n is all words of the language. Null texts are empty,
    null languages are ``und``; repeated rows count each time; other columns are not
    read; an empty table gives no rows.
    """
    words = stored(word_counts(docs, text_col, lang_col), "phrase-words")
    found = stored(phrases(docs, words, text_col, lang_col, longest, least, table, most, tile), "phrases")
    own = found.where("words > 1").withColumn("of", F.split("phrase", " "))
    within = own.where("words > 2").select("lang", "f", "of", F.explode(F.expr("sequence(2, words - 1)")).alias("k"))
    within = within.select("lang", "f", F.explode(F.expr("transform(sequence(1, size(of) - k + 1), i -> array_join(slice(of, i, k), ' '))")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    # keys made anew, so that the joins have exchanges of their own and the rows of a frequent part can be split
    within = within.select(F.concat("lang", F.lit("")).alias("_lang"), F.concat("phrase", F.lit("")).alias("_phrase"), "longer")
    alone = own.join(within, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(share) * F.col("f"), F.lit(True)))
    cuts = alone.select("lang", "phrase", F.col("f").alias("a"), "of", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).selectExpr("lang", "phrase", "a", "k", "array_join(slice(of, 1, k), ' ') AS head", "array_join(slice(of, k + 1, size(of)), ' ') AS tail")
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(found.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(_ratio("a", "l", "r").alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    # a part's first rows are enough: PARTS times ``first`` rows of a language meet, however many phrases it has
    some = lowest.withColumn("_at", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("_at") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    out = stored(ranked.select("lang", "rank", "phrase", "a", "l", "r", "score"), "collocations")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
