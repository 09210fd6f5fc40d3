"""Spelling variant grouping with a bit-sliced position index.

Two words are near if one inserted, deleted or replaced code point makes one of the
other. A vocabulary's index has a bitset over its words for each (position, letter),
bit j being word j. A word is looked up in all of them at once: bitsets of those that
agree with what was read so far (no error), and of those that agree but for one error,
where a replaced letter keeps the positions, a letter too many or too few shifts them
by one. Each letter read is a handful of word-parallel steps.

One error leaves the first or the second half of the shorter word as it is, so
words meet in a group only if they share that half and their lengths fit; each group
has an index of its own. Groups larger than BLOCK words are cut into blocks, and each
pair of blocks is a group by itself: no group is larger than two blocks, and none
is dropped. A pair is told in one group alone: by the second halves only where the first ones differ.

Occurrences are counted in each task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import discard, stored, tidy

#: Most words of one side of an index, and distinct words a task counts before it hands them on.
BLOCK, HELD = 4_096, 300_000
#: Letters of a run: A-Z, a-z and U+00C0 to U+00FF, which are C3 80 to C3 BF in UTF-8.
RUN = rb"(?:[a-z]+|\xc3[\x80-\xbf])+"


class Index:
    """The bit-sliced position index of a list of words."""

    def __init__(self, words: list[str]):
        self.words = words
        self.slices: dict[tuple[int, str], int] = {}
        self.of_length: dict[int, int] = {}
        held = self.slices
        for j, word in enumerate(words):
            bit = 1 << j
            self.of_length[len(word)] = self.of_length.get(len(word), 0) | bit
            for at in enumerate(word):
                held[at] = held.get(at, 0) | bit

    def near(self, word: str) -> Iterator[int]:
        """The numbers of the words at exactly one error."""
        at, n = self.slices.get, len(word)
        some = self.of_length.get(n - 1, 0) | self.of_length.get(n, 0) | self.of_length.get(n + 1, 0)
        if not some:
            return
        # agree; agree with a replaced letter; the indexed word lacks a letter; it has a letter more
        same, other, lacks, more = some, 0, 0, 0
        here = at((0, word[0]), 0) if word else 0
        for i, letter in enumerate(word):
            before, after = (at((i - 1, letter), 0) if i else 0), at((i + 1, letter), 0)
            other, lacks, more, same = (other & here) | (same & ~here), (lacks & before) | same, (more | same) & after, same & here
            if i + 1 < n:
                here = at((i + 1, word[i + 1]), 0)
        found = (other & self.of_length.get(n, 0)) | (lacks & self.of_length.get(n - 1, 0)) | ((more | same) & self.of_length.get(n + 1, 0))
        while found:
            low = found & -found
            yield low.bit_length() - 1
            found ^= low


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int = 0) -> DataFrame:
    """word, n: how often each lower-cased run of letters occurs; a null text has none.

    With ``spoil``, a run loses one letter where the CRC-32 h of ``<id>:<run>`` is a
    multiple of it: the code point at h modulo the run's length. A null id is an empty one.
    """

    def run(batches):
        import re
        from collections import Counter
        from zlib import crc32

        import pyarrow as pa

        runs, total = re.compile(RUN).findall, Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                found = Counter(runs(text.encode().lower()))
                if spoil:
                    seed, spoilt = crc32(f"{'' if own is None else own}:".encode()), []
                    for word in found:
                        h = crc32(word, seed)
                        if not h % spoil:
                            spoilt.append((word, h))
                    for word, h in spoilt:
                        letters, n = word.decode(), found.pop(word)
                        at = h % len(letters)
                        total[(letters[:at] + letters[at + 1 :]).encode()] += n
                total.update(found)
                if len(total) > HELD:
                    yield told()
                    total.clear()
        yield told()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(tidy(run), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _halves(words: DataFrame, least_length: int) -> DataFrame:
    """word, n, key, of: the groups of each word; ``of`` is the length of the group's shorter words."""
    length, word = F.char_length("word"), F.col("word")

    def keys(of: Column) -> list[Column]:
        half = F.floor(of / 2).cast("int")
        return [F.struct(of.alias("of"), F.concat(F.lit(side), of.cast("string"), F.lit(":"), part).alias("key")) for side, part in (("<", F.left(word, half)), (">", F.right(word, of - half)))]

    held = F.when(length > least_length, F.array(*keys(length), *keys(length - 1))).otherwise(F.array(*keys(length)))
    return words.select("word", "n", F.explode(held).alias("k")).select("word", "n", "k.key", "k.of")


def pairs(words: DataFrame, least_length: int = 6, block: int = BLOCK) -> DataFrame:
    """(a, n_a, b, n_b) of all near words of ``words`` (word of ``least_length`` code points or more, distinct, and n), each pair once."""
    if least_length < 2:
        raise ValueError("words of two code points at least")
    members = _halves(words, least_length)
    # sums of each task: a group that a third of all words are in is counted before it is shuffled
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.char_length("word") == F.col("of")).cast("long")).alias("short"))
    sizes = sizes.where("rows > 1 and short > 0").select(F.concat("key", F.lit("")).alias("_key"), F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    # the key is made anew, so that the rows of a large group can be split in the join
    members = members.withColumn("_key", F.concat("key", F.lit(""))).join(sizes, "_key")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    asks = F.char_length("word") == F.col("of")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = F.concat(
        F.transform(every, lambda x: F.struct(own.alias("index"), x.alias("query"), F.lit(False).alias("asks"))),
        F.when(asks, F.transform(every, lambda x: F.struct(x.alias("index"), own.alias("query"), F.lit(True).alias("asks")))).otherwise(F.array().cast("array<struct<index:int,query:int,asks:boolean>>")),
    )
    dealt = members.select("key", "of", "word", "n", F.explode(cells).alias("c")).select("key", "c.index", "c.query", "c.asks", "of", "word", "n")

    def run(batches):
        import pyarrow as pa

        def told(group, of: int):
            index = Index([w for w, _, asks in group if not asks])
            counts = [n for _, n, asks in group if not asks]
            half, second = of // 2, key[0].startswith(">")
            for word, n, asks in group:
                if asks:
                    for j in index.near(word):
                        other = index.words[j]
                        # words of one length ask for each other; what shares the first half is told there
                        if (len(other) > len(word) or word < other) and not (second and word[:half] == other[:half]):
                            yield word, n, other, counts[j]

        def batch_of(rows):
            a, n_a, b, n_b = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n_a, pa.int64()), pa.array(b, pa.string()), pa.array(n_b, pa.int64())], names=["a", "n_a", "b", "n_b"])

        key, of, group, out = None, 0, [], []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for k, i, q, asks, length, word, n in zip(*cols, strict=True):
                if (k, i, q) != key:
                    if len(group) > 1:
                        out.extend(told(group, of))
                        if len(out) > 20_000:
                            yield batch_of(out)
                            out = []
                    key, of, group = (k, i, q), length, []
                group.append((word, n, asks))
        if len(group) > 1:
            out.extend(told(group, of))
        yield batch_of(out)

    return dealt.repartition("key", "index", "query").sortWithinPartitions("key", "index", "query").mapInArrow(tidy(run), "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): forms followed to the last, twice as far in each round.

    A chain of forms never closes, as each is more frequent than the one before.
    """
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while now.where("moved").take(1):
        far = now.select(F.concat("word", F.lit("")).alias("_at"), F.col("root").alias("_far"))
        new = now.withColumn("_at", F.concat("root", F.lit(""))).join(far, "_at", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("moved"))
        last, now = now, stored(new, "spelling-roots")
        discard(last)
    return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, ratio: int = 5, spoil: int = 0, block: int = BLOCK) -> DataFrame:
    """A row for each word of ``docs`` (``least_length`` code points and ``least_count`` occurrences or more): word, n, form, form_n, n_near, root.

    The form of a word is its near word of largest n, the smallest in code-point
    order of several, if that n is ``ratio`` times the word's own or more, else null;
    the root is the last of the chain of forms, the word itself where there is none.
    Null texts have no words, null ids count as empty; repeated rows count each time;
    other columns are not read; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms are more frequent than their words: a ratio of 2 at least")
    words = counted(docs, id_col, text_col, spoil)
    words = stored(words.where((F.col("n") >= least_count) & (F.char_length("word") >= least_length)), "spelling-words")
    found = stored(pairs(words, least_length, block), "spelling-pairs")
    both = found.select(F.col("a").alias("word"), F.col("b").alias("form"), F.col("n_b").alias("form_n")).unionAll(found.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    enough = F.col("form_n") >= F.col("n") * ratio
    told = stored(told.select("word", "n", "n_near", *[F.when(enough, F.col(c)).alias(c) for c in ("form", "form_n")]), "spelling-forms")
    discard(found, words)
    last = roots(told.where("form is not null"))
    return told.join(last, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
