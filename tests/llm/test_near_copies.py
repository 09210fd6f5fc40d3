"""The near-copy stage against brute force over all pairs."""

import random

import corpus_pipeline
import pytest

from factloom.llm import near_copies


def brute_kept(texts, least=0.8):
    """The smallest id of each component of five-word similarity ``least`` or more."""

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    parent, sets = {i: i for i in texts}, {i: shingles(t) for i, t in texts.items()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both * 10 >= least * 10 * (len(sets[a] | sets[b])) - 1e-6:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {find(i) for i in ids}


def test_stage_takes_five_words_at_four_fifths(spark, sf):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = {}
    for n in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 200]))]
        for k in range(4):
            own = list(base)
            for _ in range(len(base) * k // 60 + (k > 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[n * 4 + k] = " ".join(own)
    texts |= {900: " ".join(words[:24]), 901: " ".join([*words[:20], "x"]), 902: "", 903: None}
    rows = spark.createDataFrame([*texts.items(), (None, texts[0])], "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, rows, sf).collect()]
    assert got.count(None) == 1
    assert sorted(i for i in got if i is not None) == sorted(brute_kept(texts))


def test_order_does_not_change_pairs(spark, monkeypatch):
    shared = "the same line of licence text stands at the end of every one of these rows"
    texts = {n: f"{' '.join(f'a{n // 2}b{i}' for i in range(80))} {'z' * (n % 2)} {shared}" for n in range(30)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for most in (0, 50_000):
        monkeypatch.setattr(near_copies, "FREQUENT", most)
        assert {r["doc_id"] for r in near_copies.dedup(rows).collect()} == brute_kept(texts) == set(range(0, 30, 2))


def test_a_large_group_is_no_square_of_pairs(spark, monkeypatch):
    """Three hundred copies of one text, each with a word of its own, and others that share a passage with it."""
    base = [f"b{i}" for i in range(200)]
    texts = {n: " ".join([*base[: n % 50 + 5], f"own{n}", *base[n % 50 + 5 :]]) for n in range(300)}
    texts |= {1000 + n: " ".join([*base[:12], *(f"o{n}x{i}" for i in range(40))]) for n in range(5)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    seen = []
    links = near_copies._links

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return links(pairs, *rest)

    monkeypatch.setattr(near_copies, "_links", counted)
    assert {r["doc_id"] for r in near_copies.dedup(rows).collect()} == brute_kept(texts)
    assert sum(seen) < 300 * 10


def edited(rng, words, share):
    """``words`` with a share of them replaced, in runs, so that most shingles of the others stay."""
    own, at = list(words), rng.randrange(max(1, len(words) - int(len(words) * share)))
    for i in range(at, min(len(own), at + int(len(words) * share))):
        own[i] = f"e{rng.random()}"
    return own


@pytest.mark.parametrize("least", [0.8, 0.5, 0.3])
@pytest.mark.parametrize("exact", [False, True])
def test_no_link_is_lost_at_any_similarity(spark, least, exact):
    """Texts of all sizes at similarities around ``least``, with passages that many of them share."""
    rng, texts = random.Random(round(least * 10)), {}
    passage = [f"p{i}" for i in range(30)]
    for n in range(60):
        base = [f"n{n}w{i}" for i in range(rng.choice([6, 9, 15, 40, 120, 400]))] + (passage if n % 3 == 0 else [])
        for k in range(3):
            share = (1 - least) / (1 + least) * (0.6 + 0.4 * k)
            texts[3 * n + k] = " ".join(edited(rng, base, share if k else 0))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in near_copies.dedup(rows, least=least, exact=exact).collect()}
    want = brute_kept(texts, least)
    assert kept == want and len(texts) * 0.4 < len(want) < len(texts) * 0.95


def test_fingerprints_of_similar_sets_stay_within_their_bits(spark):
    """Simulated: for each similarity and size, no pair of thousands comes within two deviations of the limit."""
    import math

    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    for least in (0.8, 0.5, 0.3):
        for n in (5, 9, 20, 100):
            m = n - 1 if n < 10 and least > 0.7 else n
            both = min(m, math.ceil(least / (1 + least) * (n + m) - 1e-9))
            limit = spark.range(1).select(near_copies.most_bits(least, F.lit(m))).first()[0]
            for _ in range(250):
                own = rng.integers(-(2**63), 2**63, n + m - both, dtype=np.int64)
                a, b = near_copies._fingerprint(own[:n]), near_copies._fingerprint(np.append(own[:both], own[n:]))
                assert sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True)) < limit - 10


def test_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    texts = {n: " ".join(f"t{n // 2}w{i}" for i in range(20 + n % 2)) for n in range(20)}
    rows = spark.createDataFrame([*texts.items(), (7, "another text of the same id")], "doc_id long, text string")
    plain = near_copies._told_apart
    monkeypatch.setattr(near_copies, "_told_apart", lambda df: plain(df.selectExpr("doc_id", "node % 4 AS node", "twin", "n", *near_copies.PRINTS, "keys")))
    assert {r["doc_id"] for r in near_copies.dedup(rows).collect()} == brute_kept(texts) == set(range(0, 20, 2))


def test_a_group_of_few_links_is_no_square_of_pairs(spark, monkeypatch):
    """Texts with some words of their own each, most pairs of them just not similar and some similar: the closest are compared first, which leaves few others."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = {}
    for n in range(240):
        own = list(base)
        for at in rng.sample(range(150), 1 if n % 12 == 0 else 2):
            own[at] = f"own{n}x{at}"
        texts[n] = " ".join(own)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    links, compared = near_copies._links, []

    def counted(pairs, *rest):
        compared[-1] += pairs.count()
        return links(pairs, *rest)

    monkeypatch.setattr(near_copies, "_links", counted)
    monkeypatch.setattr(near_copies, "CENTERS", 1)  # stars alone join less of it
    for rounds in (near_copies.CLOSE, ()):
        monkeypatch.setattr(near_copies, "CLOSE", rounds)
        compared.append(0)
        assert {r["doc_id"] for r in near_copies.dedup(rows).collect()} == brute_kept(texts)
    assert compared[0] * 2 < compared[1], compared
