"""Toxicity by multiple-instance learning.

Labels are of documents, causes are sentences: a document is toxic if one of its
sentences is, or by itself with a small probability (the leak). A sentence's
probability is logistic in the weights of its distinct words, and noisy-or combines
sentences: P(document) = 1 - (1 - leak) * product of (1 - P(sentence)). The weights are
trained from the documents' labels through that formula, so training finds which
sentences carry the label; the same probabilities then locate them.

A word counts as itself and by its beginnings of four to eight letters, so that forms
of a known stem count. Only features that tell the classes apart beyond chance are learned,
and a sentence without any is no instance.

The model is fitted in one task on a bounded sample of the labelled rows: TOXIC and
CLEAN ids of either class, those with the smallest hash; a broadcast of these ids picks
their texts, so no text is shuffled by its label. Whole texts of all documents are
scored in one pass.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import discard, give_back, stored, tidy

#: Labelled documents of either class that the model is fitted on, and the most features that it learns.
TOXIC, CLEAN, FEATURES = 6_000, 12_000, 4_096
#: Least log-likelihood ratio of a learned feature: one chance in a thousand.
TELLING = 10.83
#: Cost of a weight's size, times of the fit, first step.
COST, ROUNDS, STEP = 1e-4, 600, 0.05
#: The most a sentence's logit may be before its words count: what is toxic must be told by them.
BIAS = -4.0
#: Distinct words a worker remembers, and distinct features a task counts before it hands them on.
HELD = 200_000
#: Letters of a word's beginnings.
STEMS = range(4, 9)
SENTENCE = re.compile(r"[^.!?\r\n]+")
WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: Column) -> Column:
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(word: str) -> list[str]:
    """The word and its beginnings, marked by a hyphen."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of each sentence that has any; places count code points."""
    return [(m.start(), m.end(), words) for m in SENTENCE.finditer(text) if (words := set(WORD.findall(m.group().casefold())))]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float = 0.0
    leak: float = 0.0
    known: dict[str, float | None] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def weight(self, word: str) -> float | None:
        """A word's weight; None where it has no learned feature."""
        if word in self.known:
            return self.known[word]
        own = [self.weights[f] for f in features(word) if f in self.weights]
        if len(self.known) >= HELD:
            self.known.clear()
        self.known[word] = told = math.fsum(own) if own else None
        return told

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences with a learned feature."""
        hits = {w: x for w in set(WORD.findall(text.casefold())) if (x := self.weight(w)) is not None}
        out = []
        for start, end, words in sentences(text) if hits else ():
            own = [hits[w] for w in words if w in hits]
            if own:
                out.append((start, end, 1 / (1 + math.exp(-max(-500.0, min(500.0, math.fsum(own) + self.bias))))))
        return out

    def score(self, spans: list[tuple[int, int, float]]) -> float:
        """The noisy-or of the leak and the sentences."""
        return abs(math.expm1(math.log1p(-self.leak) + math.fsum(math.log1p(-min(p, 1 - 1e-15)) for _, _, p in spans)))


def fit(bags: list[list[list[int]]], toxic: np.ndarray, weight: np.ndarray, n: int, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """(weights, bias, leak) of least weighted log-loss of the noisy-or, by steps scaled to the gradients' size, each followed by a shrinking of the weights.

    ``bags`` has each document's sentences as lists of feature numbers under ``n``.
    """
    of_doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    flat = [s for b in bags for s in b]
    of_sentence = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    feature = np.array([f for s in flat for f in s], np.int64)
    at = np.concatenate([start, [BIAS, -5.0]])  # weights, bias, the leak's logit
    mean, spread = np.zeros(n + 2), np.zeros(n + 2)
    share = weight / max(weight.sum(), 1e-12)
    for step in range(1, rounds + 1):
        z = np.clip(at[n] + np.bincount(of_sentence, at[feature], len(flat)), -500, 500)
        p, leak = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-at[n + 1]))
        clear = math.log1p(-leak) - np.bincount(of_doc, np.logaddexp(0, z), len(bags))  # log of the probability of no cause
        q = np.exp(clear)
        pull = share * np.where(toxic, -q / np.maximum(1 - q, 1e-12), 1.0)
        g = pull[of_doc] * p
        slope = np.concatenate([np.bincount(feature, g[of_sentence], n), [g.sum(), (pull * leak).sum()]])
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope * slope
        rate = STEP * (1 - (step - 1) / rounds)
        size = np.sqrt(spread / (1 - 0.99**step)) + 1e-6
        at -= rate * (mean / (1 - 0.9**step)) / size
        at[:n] = np.sign(at[:n]) * np.maximum(np.abs(at[:n]) - rate * COST / size[:n], 0)
        at[n], at[n + 1] = min(at[n], BIAS), min(at[n + 1], -1.0)
    return at[:n], float(at[n]), 1 / (1 + math.exp(-float(at[n + 1])))


def _picked(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sizes: tuple[int, int]) -> tuple[DataFrame, dict[bool, int]]:
    """(_toxic, _text of the sample, each text once; learnable rows by class)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg((F.max(F.col(label_col).cast("int")) > 0).alias("_toxic"))
    known = stored(known.withColumn("_hash", F.xxhash64("_id")), "toxic-labels")
    total = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}  # two rows
    picked = [known.where(F.col("_toxic") == toxic).orderBy("_hash", "_id").limit(n) for toxic, n in zip((True, False), sizes, strict=True)]
    picked = stored(picked[0].unionAll(picked[1]).select("_id", "_toxic"), "toxic-picked")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.join(F.broadcast(picked), "_id")  # TOXIC + CLEAN ids at most
    return rows.groupBy("_text").agg(F.max("_toxic").alias("_toxic")), total


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sizes: tuple[int, int] = (TOXIC, CLEAN), most: int = FEATURES) -> Model:
    """The model of the labelled documents; rows of null id, text or label do not count, nor held-out ones. Without both classes nothing is learned."""
    rows, total = _picked(docs, labels, id_col, text_col, label_col, sizes)
    rows = stored(rows, "toxic-sample")

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def told():
            for toxic, own in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([toxic] * len(own)), pa.array(own.values(), pa.int64())], names=["feature", "toxic", "n"])
                own.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update({f for _, _, words in sentences(text) for w in words for f in features(w)})
                if len(seen[True]) + len(seen[False]) > HELD:
                    yield from told()
        yield from told()

    sizes_of = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}  # two rows
    if len(sizes_of) < 2:
        return Model({}, leak=0.75 if True in sizes_of else 0.0)
    yes, no = (F.sum(F.when(F.col("toxic") == x, F.col("n")).otherwise(0)).cast("double") for x in (True, False))
    counts = rows.select("_text", "_toxic").mapInArrow(tidy(count), "feature string, toxic boolean, n long").groupBy("feature").agg(yes.alias("a"), no.alias("b")).where("a + b > 2")
    n1, n0 = F.lit(float(sizes_of[True])), F.lit(float(sizes_of[False]))
    share = (F.col("a") + F.col("b")) / (n1 + n0)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    telling = 2 * (part(F.col("a"), n1 * share) + part(F.col("b"), n0 * share) + part(n1 - F.col("a"), n1 * (1 - share)) + part(n0 - F.col("b"), n0 * (1 - share)))
    top = counts.select("feature", "a", "b", telling.alias("g")).where(F.col("g") >= TELLING).orderBy(F.desc("g"), "feature").limit(most).collect()  # FEATURES rows at most
    number = {r["feature"]: i for i, r in enumerate(top)}
    start = np.array([math.log((r["a"] + 0.5) / (r["b"] + 0.5) * sizes_of[False] / sizes_of[True]) for r in top])
    told = docs.sparkSession.sparkContext.broadcast(number)
    weigh = {toxic: total[toxic] / sizes_of[toxic] for toxic in (True, False)}

    def bag(batches):
        import pyarrow as pa

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [[told.value[f] for w in sorted(words) for f in features(w) if f in told.value] for _, _, words in sentences(text)]
                yield pa.RecordBatch.from_arrays([pa.array([toxic]), pa.array([[s for s in own if s]], pa.list_(pa.list_(pa.int32())))], names=["toxic", "bag"])

    def fitted(table):
        import pyarrow as pa

        bags, toxic = table["bag"].to_pylist(), np.array(table["toxic"].to_pylist(), bool)
        by = sorted(range(len(bags)), key=lambda i: (bool(toxic[i]), bags[i]))  # sums must not depend on the order of rows
        toxic = toxic[by]
        w, bias, leak = fit([bags[i] for i in by], toxic, np.where(toxic, weigh[True], weigh[False]), len(number), np.clip(start, -2, 2))
        out = pa.table({"w": pa.array([w.astype("<f8").tobytes()], pa.binary()), "bias": pa.array([bias]), "leak": pa.array([leak])})
        del bags, table
        give_back()
        return out

    bags = stored(rows.select("_text", "_toxic").mapInArrow(tidy(bag), "toxic boolean, bag array<array<int>>"), "toxic-bags")
    row = bags.groupBy(F.lit(1).alias("one")).applyInArrow(fitted, "w binary, bias double, leak double").first()  # TOXIC + CLEAN rows in one task
    discard(rows, bags)
    w = np.frombuffer(row["w"], "<f8")
    return Model({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-3}, row["bias"], row["leak"])


def _with(docs: DataFrame, model: Model, id_col: str, text_col: str, columns: str, rows_of) -> DataFrame:
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            picked, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for row in rows_of(told.value, text or ""):
                    picked.append(i)
                    out.append(row)
            made = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(picked, pa.int32())), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=names)

    import pyarrow as pa

    of = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    names, kinds = [id_col, *(c.split()[0] for c in columns.split(", "))], [of[c.split()[1]] for c in columns.split(", ")]
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), f"`{id_col}` {id_type}, {columns}")


def offending(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, start, end (code points), sentence, probability of the sentences whose own probability is ``least`` or more."""
    return _with(docs, model, id_col, text_col, "start int, end int, sentence string, probability double", lambda m, text: [(a, b, text[a:b], p) for a, b, p in m.spans(text) if p >= least])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, score, n_offending (sentences at 0.5 or more) and worst_start, worst_end (of the likeliest sentence, the first of several; null without one)."""

    def row(m: Model, text: str):
        spans = m.spans(text)
        worst = max(spans, key=lambda s: (s[2], -s[0]), default=(None, None, 0.0))
        return [(m.score(spans), sum(p >= 0.5 for _, _, p in spans), worst[0], worst[1])]

    return _with(docs, model, id_col, text_col, "score double, n_offending int, worst_start int, worst_end int", row)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """A row for each row of ``docs``: id, held_out, score, predicted, n_offending, worst_start, worst_end.

    Scores come from the whole text alone; a null or empty text has the leak's
    probability. Several labels of an id count as toxic if one is. Rows of null id are
    not held out and not learned from, but scored. With clean labels only, or none, all
    scores are 0; with toxic ones only 0.75. Repeated rows get equal scores; other
    columns are not read; an empty table gives no rows.
    """
    out = scored(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end")
