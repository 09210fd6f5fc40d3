"""Language identification in two levels: family first, then one against one.

A text's features are the shares of its hashed character bigrams and trigrams
over letters (everything else is a gap). A linear support vector machine for each
family tells families apart, one against the rest; within the winning family a
linear machine for each pair of languages votes. Whole texts are scored, in
blocks, in one pass without a shuffle.

The machines are fitted on a bounded sample of the labelled rows, each in a task of
its own: ``PER_LANGUAGE`` rows of each language, those with the smallest hash of
their id; the other side of a family's machine has ``OTHERS`` rows at most, dealt
evenly over the other languages. Every language that occurs is learned; what comes
to the driver are the languages and the machines' weights.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.llm.shared import fresh, give_back, stored, tidy
from factloom.llm.tokens import slices

BITS = 12
BUCKETS = 1 << BITS
#: Rows of each language that the machines are fitted on, and rows of the other side of a family's machine.
PER_LANGUAGE, OTHERS = 500, 2_000
#: Times PER_LANGUAGE that are ranked; so many that the first PER_LANGUAGE hashes are among them but for a chance beyond any machine's.
SPARE = 4
BLOCK_BYTES = 1 << 20
#: Texts whose features are held as rows at once, and characters that are counted at once: a longer text goes on in pieces.
ROWS, PIECE = 128, 1 << 18
UNDETERMINED = "und"

#: Families of common languages; any other language is a family by itself.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne"),
    "semitic": ("ar", "he"),
}


def family(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), f"family of {language}")


_letters: list = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once for each worker."""
    if not _letters:
        import unicodedata

        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _pieces(texts: list[str]):
    """Lists of (text's number, its characters from a place on, grams that start there), of PIECE characters or one piece more; a gram is in one piece."""
    held, size = [], 0
    for i, text in enumerate(texts):
        text = f"  {text.lower()}    "  # begins and ends with two gaps, so no gram has letters of two texts; two more for the last grams
        for at in range(0, len(text) - 2, PIECE):
            part = text[at : at + PIECE + 2]
            held.append((i, part, len(part) - 2))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def shares(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of 2 * BUCKETS gram shares for each text, scaled to be around one for common grams; whether it has a letter)."""
    counts, sizes, lettered = np.zeros((len(texts), 2 * BUCKETS), np.float32), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for pieces in _pieces(texts):
        codes = np.frombuffer("".join([p for _, p, _ in pieces]).encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters()[codes]
        codes = np.where(is_letter, codes, 32).astype(np.uint32)
        n = np.fromiter((x for _, _, x in pieces), np.int64, len(pieces))
        which = np.fromiter((i for i, _, _ in pieces), np.int64, len(pieces))
        starts_gram = np.ones(len(codes), bool)
        ends = np.cumsum(n + 2)
        starts_gram[ends - 1] = starts_gram[ends - 2] = False
        at = np.flatnonzero(starts_gram)
        two = codes[at] * np.uint32(0x9E3779B1) + codes[at + 1] * np.uint32(0x85EBCA77)
        three = two * np.uint32(0xC2B2AE3D) + codes[at + 2] * np.uint32(0x27D4EB2F)
        first, last = int(which[0]), int(which[-1]) + 1
        row = np.repeat((which - first) * BUCKETS, n)
        for k, grams in enumerate((two, three)):
            found = np.bincount(row + (grams >> np.uint32(32 - BITS)), minlength=(last - first) * BUCKETS)
            counts[first:last, k * BUCKETS : (k + 1) * BUCKETS] += found.reshape(last - first, BUCKETS)
        np.add.at(sizes, which, n)
        np.logical_or.at(lettered, which, np.logical_or.reduceat(is_letter, ends - n - 2))
    return counts * (SCALE / np.maximum(sizes, 1)).astype(np.float32)[:, None], lettered


SCALE = 30.0


def fit_linear(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine, squared hinge loss, by dual coordinate ascent; y is 1 or -1."""
    w, bias, alpha, rng = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(x)), np.random.default_rng(seed)
    weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * len(y) / 2  # classes count alike
    diagonal = 1 / (2 * c * weight)
    norms = np.array([float(row @ row) for row in (r.astype(np.float32) for r in x)]) + 1 + diagonal
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            row = x[i].astype(np.float32, copy=False)  # rows may be held in half precision
            gradient = y[i] * (float(row @ w) + bias) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norms[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * row
                bias += step
                alpha[i] = new
    return np.append(w.astype(np.float64), bias)


@dataclass
class Model:
    """Machines as columns of ``weights``: one for each family, then one for each pair within a family."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: dict[str, list[tuple[str, str]]]
    weights: dict[str, np.ndarray]  # by family name: its pairs' columns; "" has the families'
    bias: dict[str, np.ndarray]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for at in range(0, len(texts), ROWS):
            x, lettered = shares(texts[at : at + ROWS])
            out += self._decide(x, lettered)
        return out

    def _decide(self, x: np.ndarray, lettered: np.ndarray) -> list[tuple[str, float]]:
        """Language and score: the product of the family's and of the weakest pair's logistic confidence."""
        told: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(x)
        if not self.families:
            return told
        margins = x @ self.weights[""] + self.bias[""]
        first = margins.argmax(1)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(lettered & (first == f))
            if not len(rows):
                continue
            own = _confidence(margins[rows, f]) if len(self.families) > 1 else np.ones(len(rows))
            members = self.members[name]
            votes, least = np.zeros((len(rows), len(members)), np.int64), np.ones((len(rows), len(members)))
            if self.pairs[name]:
                against = x[rows] @ self.weights[name] + self.bias[name]
                for k, pair in enumerate(self.pairs[name]):
                    for sign, m in ((1, members.index(pair[0])), (-1, members.index(pair[1]))):
                        won = against[:, k] >= 0 if sign > 0 else against[:, k] < 0
                        votes[won, m] += 1
                        least[won, m] = np.minimum(least[won, m], _confidence(sign * against[won, k]))
            best = np.lexsort((least, votes), axis=1)[:, -1]
            for r, b, o in zip(rows.tolist(), best.tolist(), own.tolist(), strict=True):
                told[r] = members[b], o
            for i, (r, b) in enumerate(zip(rows.tolist(), best.tolist(), strict=True)):
                told[r] = told[r][0], float(told[r][1] * least[i, b])
        return told


def _confidence(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margins, -50, 50)))


def plan(languages: list[str]) -> tuple[Model, list[tuple[str, str, bool, int]]]:
    """(a model without weights, (machine, language, whether it is the machine's own side, rows of it)) for the languages that occur."""
    members: dict[str, list[str]] = {}
    for lang in sorted(languages):
        members.setdefault(family(lang), []).append(lang)
    names = sorted(members)
    pairs = {name: [(a, b) for i, a in enumerate(members[name]) for b in members[name][i + 1 :]] for name in names}
    rows: list[tuple[str, str, bool, int]] = []
    for name in names if len(names) > 1 else []:
        others = len(languages) - len(members[name])
        rows += [(f"f {name}", lang, lang in members[name], PER_LANGUAGE if lang in members[name] else max(1, OTHERS // others)) for lang in languages]
    rows += [(f"p {a}\t{b}", lang, lang == a, PER_LANGUAGE) for name in names for a, b in pairs[name] for lang in (a, b)]
    return Model(names, members, pairs, {}, {}), rows


def with_weights(model: Model, of: dict[str, np.ndarray]) -> Model:
    """``of`` has a machine's weights, bias last, by its name in ``plan``; a lone family needs none."""
    none = np.zeros(2 * BUCKETS + 1)
    keys = {"": [f"f {name}" for name in model.families]} | {name: [f"p {a}\t{b}" for a, b in pairs] for name, pairs in model.pairs.items()}
    for name, machines in keys.items():
        both = np.array([of.get(m, none) for m in machines]).reshape(len(machines), 2 * BUCKETS + 1)
        model.weights[name], model.bias[name] = np.ascontiguousarray(both[:, :-1].T.astype(np.float32)), both[:, -1]
    return model


def held_out(id_col: Column) -> Column:
    """Whether a row must not be learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fits the machines on ``per_language`` rows of each language at most.

    Only rows with text, language and id that are not held out count. A machine's
    rows meet in one task, PER_LANGUAGE rows of each of its family's languages and
    OTHERS more at most.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    ranked = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("_hash"), F.col(text_col).cast("string").alias("_text"))
    counts = {r["lang"]: r["count"] for r in ranked.groupBy("lang").count().collect()}  # a row for each language
    model, machines = plan(sorted(counts))
    if not machines:
        return with_weights(model, {})
    spark = docs.sparkSession
    # both tables are made of the languages, which the driver holds anyway, and are broadcast; texts must not be dealt by language.
    # of a frequent language only hashes low enough to be among the first are ranked, a few times as many as are taken
    share = spark.createDataFrame([(lang, min(1.0, SPARE * per_language / n)) for lang, n in counts.items()], "lang string, _share double")
    low = (F.col("_hash") / F.lit(2.0**64) + 0.5) <= F.col("_share")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "_id", "_text"))
    sample = ranked.join(F.broadcast(share), "lang").where(low).withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "nth", "_text")

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in slices(batch.column(2), BLOCK_BYTES):
                part = batch.slice(start, stop - start)
                for at in range(0, part.num_rows, ROWS):
                    own = part.slice(at, ROWS)
                    x, _ = shares(own.column(2).to_pylist())
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], names=["lang", "nth", "x"])

    told = stored(sample.mapInArrow(tidy(features), "lang string, nth int, x binary"), "language-sample")
    sides = spark.createDataFrame(machines, "machine string, lang string, own boolean, quota int")
    fitted = told.join(F.broadcast(sides), "lang").where(F.col("nth") <= F.col("quota")).select("machine", "own", "lang", "nth", "x").groupBy("machine").applyInArrow(_fitted, "machine string, weights binary")
    return with_weights(model, {r["machine"]: np.frombuffer(r["weights"], "<f4").astype(np.float64) for r in fitted.collect()})  # a row for each machine


def _fitted(table):
    """A machine's weights from its rows (machine, own, lang, nth, x)."""
    import pyarrow as pa

    table = table.sort_by([("lang", "ascending"), ("nth", "ascending")])
    packed = table["x"].combine_chunks()
    x = np.frombuffer(packed.buffers()[2], "<f2", table.num_rows * 2 * BUCKETS, packed.offset * 4 * BUCKETS).reshape(table.num_rows, 2 * BUCKETS)
    own = table["own"].to_numpy(zero_copy_only=False).astype(bool)
    weights = fit_linear(x, np.where(own, 1.0, -1.0)).astype("<f4")
    out = pa.table({"machine": table["machine"][:1], "weights": pa.array([weights.tobytes()], pa.binary())})
    del x, packed, table
    give_back()
    return out


def _predicted(batch_texts, model: Model) -> tuple[list[str], list[float]]:
    languages, scores = [], []
    for start, stop in slices(batch_texts, BLOCK_BYTES):
        own = batch_texts.slice(start, stop - start).to_pylist()
        for lang, score in model.predict([t or "" for t in own]):
            languages.append(lang)
            scores.append(score)
    return languages, scores


def with_language(docs: DataFrame, model: Model, text_col: str, to: tuple[str, str]) -> DataFrame:
    """Adds the language and the score, computed from the text alone; a row's other columns pass through."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    (text,) = fresh(docs, "_text")
    rows = docs.withColumn(text, F.col(text_col).cast("string")).withColumns({to[0]: F.lit("").cast("string"), to[1]: F.lit(0.0)})
    schema, names = rows.schema, rows.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            languages, scores = _predicted(batch.column(names.index(text)), told.value)
            columns = list(batch.columns)
            columns[-2:] = [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(tidy(run), schema).drop(text)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """A row for each row of ``docs``: id, held_out, lang_pred, score.

    lang_pred is a learned language; ``und`` (score 0) where the text is null or has
    no letter, or where nothing could be learned. Rows with a null id are neither
    learned from nor held out, but get a prediction. Language, source and id are no
    inputs of a prediction. Repeated rows get equal ones; other columns are not
    read; an empty table gives no rows.
    """
    model = train(docs, id_col, text_col, lang_col, per_language)
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("_own"))
    return with_language(rows, model, "_own", ("lang_pred", "score")).drop("_own")


def identified(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a score of ``least`` or more, all columns kept."""
    lang, score = fresh(docs, "_lang_pred", "_score")
    rows = with_language(docs, train(training, id_col, text_col, lang_col), text_col, (lang, score))
    return rows.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)
