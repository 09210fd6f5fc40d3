"""Spelling variants, toxicity and collocations against brute force and on awkward tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from tests.llm.test_operators import ODD, table

from factloom.llm import collocations, spelling, toxicity

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_words(rows, spoil):
    counts = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
            if spoil and h % spoil == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return counts


def brute_variants(rows, spoil=199, length=6, least=5, ratio=5):
    n = {w: c for w, c in brute_words(rows, spoil).items() if len(w) >= length and c >= least}
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and edits(v, w) == 1] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n[w], form[w], n[form[w]] if form[w] else None, len(near[w]), root(w)) for w in n)


def got_variants(df):
    return sorted(tuple(r) for r in df.select("word", "n", "form", "form_n", "n_near", "root").collect())


def corpus():
    """Words with all kinds of one-letter errors, chains of forms and letters of two bytes."""
    rng, texts = random.Random(5), []
    stems = ["planet", "plänet", "éclair", "straße", "abcdefg", "aaaaaa", "aaaaaaa", "aaaaaaaa", "xplanet"]
    for i in range(60):
        words = []
        for _ in range(120):
            w = list(rng.choice(stems[: 1 + i % len(stems)]))
            if rng.random() < 0.3:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (kind > 0)] = [rng.choice("abeÉß")] if kind < 2 else []
            words.append("".join(w))
        texts.append(" ".join(words))
    return texts + [f"chain{x} " * 300 + f"chain{x}b " * 50 + f"chain{x}bc " * 8 for x in "pqrstu"]  # forms of forms


@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
def test_spelling_against_brute_force(spark, block):
    texts = corpus() + ODD
    ids = [*range(len(texts) - 1), None]
    got = got_variants(spelling.variants(table(spark, texts, ids), spoil=19, block=block))
    want = brute_variants(list(zip(ids, texts, strict=True)), spoil=19)
    assert got == want and len(want) > 100 and sum(w[5] != w[2] and w[2] is not None for w in want) > 3


def test_spelling_of_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got_variants(spelling.variants(docs, spoil=199)) == brute_variants([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_spelling_of_short_words(spark):
    texts = [" ".join(["ab"] * 9 + ["abc"] * 2 + ["ac", "bc", "b", "a"])]
    assert got_variants(spelling.variants(table(spark, texts), least_length=2, least_count=1, ratio=2)) == brute_variants([(0, texts[0])], 0, 2, 1, 2)
    with pytest.raises(ValueError, match="two code points"):
        spelling.variants(table(spark, texts), least_length=1)


def test_index_finds_what_edits_say():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(150)})
    index = spelling.Index(words)
    for w in words:
        assert [index.words[j] for j in index.near(w)] == [v for v in words if edits(v, w) == 1]


def brute_phrases(rows, longest=3, least=10, share=50, first=2000):
    out = []
    of = defaultdict(list)
    for lang, text in rows:
        of[lang or "und"].append(text or "")
    for lang, texts in of.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split("[.,;:!?\n-\r]", text.translate(UPPER)):
                words = [w for w in re.split("[ \t]+", piece) if w]
                n += len(words)
                for size in range(1, longest + 1):
                    f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
        own = [p for p, a in f.items() if len(p) > 1 and a >= least]
        gone = {p[i : i + size] for p in own for size in range(2, len(p)) for i in range(len(p) - size + 1) if 100 * f[p] >= share * f[p[i : i + size]]}
        rows = []
        for p in own:
            if p not in gone:
                score, k = min((10**6 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def phrase_table(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)] + ["É", "naïve", "日本", "x" * 70]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", " "]) for _ in range(rng.randint(0, 300))) for _ in range(90)]
    texts += ["Of The People by the people " * 40, *[t or "" for t in ODD], " ".join(f"r{i} s t{i % 3}" for i in range(400))]
    rows = [(i, t if i else None, [None, "en", "de", "en"][i % 4], "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, unit long").repartition(3)


@pytest.mark.parametrize("kinds", [{}, {"table": 9, "most": 12, "tile": 4}, {"most": 5, "tile": 2}, {"longest": 4, "share": 70, "first": 7}, {"longest": 5, "table": 14, "most": 20}, {"longest": 2}])
def test_collocations_against_brute_force(spark, kinds, monkeypatch):
    monkeypatch.setattr(collocations, "PART", 100)
    docs = phrase_table(spark)
    want = brute_phrases([(r["lang"], r["text"]) for r in docs.collect()], **{k: v for k, v in kinds.items() if k in ("longest", "share", "first")})
    assert sorted(tuple(r) for r in collocations.collocations(docs, **kinds).collect()) == want and len(want) > 12


def test_scores_pass_64_bits(spark):
    big = spark.createDataFrame([(4 * 10**14, 10**15 - 1, 4 * 10**14 + 1)], "a long, l long, r long")
    assert big.select(collocations._ratio("a", "l", "r")).first()[0] == 10**6 * (4 * 10**14) ** 2 // ((10**15 - 1) * (4 * 10**14 + 1))


def test_tiles_count_every_pair():
    rng = np.random.default_rng(0)
    left, right = np.append(rng.zipf(1.5, 5000) % 50, [0, 2**31 - 1]), np.append(rng.zipf(1.3, 5000) % 40, [2**31 - 1, 0])
    for tile in (1, 4, 16, 1024):
        a, b, n = collocations.tiled(left, right, tile)
        assert Counter({(int(x), int(y)): int(c) for x, y, c in zip(a, b, n, strict=True)}) == Counter(zip(left.tolist(), right.tolist(), strict=True))


def labelled(spark):
    rng, texts, toxic = random.Random(2), [], []
    plain = [f"{a}{b}" for a in ("lu", "mo", "ra", "ti") for b in ("na", "so", "vel", "kin")]
    for i in range(400):
        own = [" ".join(rng.choice(plain) for _ in range(6)) for _ in range(rng.randint(1, 8))]
        if i % 4 == 0:
            own[rng.randrange(len(own))] += f" grobian{rng.choice('abcdefgh')}"
        texts.append(". ".join(own) + ".")
        toxic.append(int(i % 4 == 0))
    docs = spark.createDataFrame([(i, t, "en", "s", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, score double")
    return docs.repartition(3), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"), texts, toxic


def test_toxicity_learns_and_locates(spark):
    docs, labels, texts, toxic = labelled(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        i = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == toxic[i] == int(r["score"] >= 0.5)
        if toxic[i]:
            assert "grobian" in texts[i][r["worst_start"] : r["worst_end"]] and r["n_offending"] == 1
    model = toxicity.train(docs, labels)
    found = toxicity.offending(docs, model).collect()
    assert len(found) == sum(toxic) and all("grobian" in r["sentence"] for r in found)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels, _, _ = labelled(spark)
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.toxicity(docs, turned).collect())) == sorted(map(tuple, toxicity.toxicity(docs, labels).collect()))


def test_noisy_or_is_the_plain_product():
    model = toxicity.Model({"bad": 3.0, "worse": 4.0, "mild-": 1.0}, -2.0, 0.1)
    text = "Bad. So WORSE and bad! milder things\nnothing here"
    p = [1 / (1 + math.exp(-z)) for z in (1.0, 5.0, -1.0)]
    assert model.score(model.spans(text)) == pytest.approx(1 - 0.9 * (1 - p[0]) * (1 - p[1]) * (1 - p[2]))
    assert [text[a:b].strip() for a, b, _ in model.spans(text)] == ["Bad", "So WORSE and bad", "milder things"]


def test_slope_of_the_fit_is_that_of_the_loss():
    """A fit from the same start ends no worse than any small move of its weights (no cost of size)."""
    bags, toxic = [[[0], [1]], [[1]], [[0, 2]], [[2], [2]], [], [[0]]], np.array([True, False, True, False, False, False])
    w, bias, leak = toxicity.fit(bags, toxic, np.ones(6), 3, np.zeros(3), 4000)

    def loss(w, bias, leak):
        total = 0.0
        for bag, y in zip(bags, toxic, strict=True):
            clear = (1 - leak) * math.prod(1 - 1 / (1 + math.exp(-sum(w[f] for f in s) - bias)) for s in bag)
            total -= math.log(max(1e-300, 1 - clear if y else clear)) / len(bags)
        return total + toxicity.COST * sum(map(abs, w))

    best = loss(w, bias, leak)
    for i in range(3):
        for step in (-0.3, 0.3):
            assert loss([x + step * (i == j) for j, x in enumerate(w)], bias, leak) > best - 1e-3
    assert loss(w, bias + 0.3, leak) > best - 1e-3 and loss(w, bias, min(0.9, leak + 0.05)) > best - 1e-3


def test_toxicity_of_odd_rows(spark):
    docs, labels, _, _ = labelled(spark)
    odd = table(spark, [*ODD, "grobiana", "x" * 200_000, "grobianb " * 3000], [*range(1000, 1000 + len(ODD)), None, 7, 7])
    got = toxicity.scored(odd, toxicity.train(docs, labels))
    rows = got.collect()
    assert got.columns == ["doc_id", "score", "n_offending", "worst_start", "worst_end"] and len(rows) == len(ODD) + 3
    assert all(0 <= r["score"] <= 1 for r in rows) and next(r for r in rows if r["doc_id"] is None)["score"] > 0.5
    for some, want in ((labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 0.75), (labels.where("false"), 0.0), (labels.selectExpr("doc_id", "cast(null as int) AS toxic"), 0.0)):
        assert {r["score"] for r in toxicity.toxicity(docs, some).collect()} == {want}


def test_empty_tables(spark):
    docs, labels = table(spark, []), spark.createDataFrame([], "doc_id long, toxic int")
    assert spelling.variants(docs, spoil=199).collect() == [] and toxicity.toxicity(docs, labels).collect() == [] and collocations.collocations(docs).collect() == []


def test_held_out_toxicity(spark):
    """On the larger table, labels that were never read: nearly all found, nearly no clean document accused."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    told = Counter((r["toxic"], r["predicted"]) for r in toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect())
    assert told[1, 1] >= 0.85 * (told[1, 0] + told[1, 1]) and told[0, 1] <= 0.01 * (told[0, 0] + told[0, 1])


def test_pairs_are_told_once(spark):
    words = sorted({a + b + c for a, b in pairwise("abcabdabe") for c in ("aaaa", "aaab", "aaa", "baaa")})
    found = [tuple(sorted((r["a"], r["b"]))) for r in spelling.pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), 5, 4).collect()]
    assert sorted(found) == sorted((v, w) for v in words for w in words if v < w and edits(v, w) == 1)
