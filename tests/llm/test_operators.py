"""The training-data operators against brute force and on awkward tables."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import bpe_table, decontaminate, exact_dedup, langid, simhash, token_counts, token_store, tokens, url_filter, warc_convert, wrapper_extract

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\t ", "a", "A b  c", "Émile's  café — naïve ﬁne\u00a0x", "ΣΑΣ οδος Σ", "İstanbul e\u0301te\u0301", "日本語のテキスト。テスト", "한국어 텍스트", "<|endoftext|> inside<|startoftext|>x", "x\x1cy\x85z\u2028w", "tab\tnew\r\nline   three",
    "don't we'll 's 't 12345 ½ ²", "!!! ... ??? #$%", "🙂🙂 emoji👍🏽", "word " * 3000, "x" * 5000, "\x00nul", "a \n\n \nb", "end spaces   ", "   start", "a\u0345b \u1e9b\u0323",
]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, _text string, _id long, fp long, _items string"


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[n], t, "en", "s", len(t or ""), 7, "clash", 8, 9, "y") for n, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


def le(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


def test_exact_groups(spark):
    texts = ["a  b", "a b", "A b", None, "", "a\tb", "x", "x"]
    ids = [5, 3, 1, 9, 8, None, 4, 4]
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(table(spark, texts, ids)).collect()}
    ab, empty, x = (hashlib.sha256(t).hexdigest() for t in (b"a b", b"", b"x"))
    assert (got[5, ab]["keep_id"], got[5, ab]["group_size"], got[5, ab]["kept"]) == (3, 3, False)
    assert got[3, ab]["kept"] and not got[None, ab]["kept"] and got[None, ab]["keep_id"] == 3
    assert (got[9, empty]["keep_id"], got[8, empty]["kept"]) == (8, True)
    assert got[4, x]["group_size"] == 2
    kept = exact_dedup.dedup(table(spark, texts, ids))
    assert kept.columns == table(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 8]
    assert all(r["_text"] == "clash" for r in kept.collect())


def test_empty_tables(spark):
    docs = table(spark, [])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        exact_dedup.exact_groups(docs), exact_dedup.dedup(docs), simhash.near_duplicates(docs), decontaminate.leaks(docs, benchmark), langid.languages(docs), token_counts.token_counts(docs, BYTES), token_store.token_files(docs, WORDS),
        bpe_table.round_trip(docs, WORDS), url_filter.judged(pages), wrapper_extract.extracted(pages), warc_convert.archived(pages),
    ):
        assert df.collect() == []


def test_words_equal_the_library(word_library):
    import pyarrow as pa

    own = tokens.WordTokenizer(WORDS)
    texts = [t or "" for t in ODD]
    codes, counts, words = own.split(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        ids = [i for c in codes[at : at + n] for i in own.ids(words[c])]
        at += n
        assert ids == word_library.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_every_character_equals_the_library(word_library):
    """Cuts and cases of all characters that are taken the fast way."""
    import pyarrow as pa

    chars = [chr(c) for c in [*range(9, 14), *range(32, 0x250), *range(0x400, 0x530), *range(0x2000, 0x2070), 0x20AC, 0x3042, 0x4E2D, 0xAC00]]
    texts = [f"a{c}b{c.upper()} {c}" for c in chars]
    own = tokens.WordTokenizer(WORDS)
    codes, counts, words = own.split(pa.array(texts))
    library = word_library.encode_batch(texts, add_special_tokens=False)
    at = 0
    for text, n, want in zip(texts, counts, library, strict=True):
        assert [i for c in codes[at : at + n] for i in own.ids(words[c])] == want.ids, repr(text)
        at += n


def test_token_files(spark, word_library):
    ids = [3 * i - 5 for i in range(len(ODD))]
    random.Random(1).shuffle(ids)
    docs = table(spark, ODD, ids)
    got = sorted(token_store.token_files(docs, WORDS).collect())
    start = 0
    for r, (doc, text) in zip(got, sorted(zip(ids, ODD, strict=True)), strict=True):
        want = [*word_library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(want), zlib.crc32(le(want)))
        start += len(want)
    files = token_store.write_token_files(docs, WORDS, planes="bit", block=64)  # many chunks for the longest texts
    back = {r["doc_id"]: r["ids"] for r in token_store.read_ids(spark, files).collect()}
    assert back[ids[4]] == [*word_library.encode("a", add_special_tokens=False).ids, 1]


def test_token_files_of_null_and_repeated_ids(spark, word_library, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 60)
    monkeypatch.setattr(token_store, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(token_store, "_workers", {})
    texts = ["b twice", "no id at all", "a twice", "last one, with a longer text than a block holds " * 5, "a twice", None]
    got = [tuple(r) for r in token_store.token_files(table(spark, texts, [4, None, 4, 9, 4, None]), WORDS).collect()]
    want = {i: zlib.crc32(le([*word_library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in enumerate(texts)}
    assert sorted((r[0] is not None, r[0], r[3]) for r in got if r[0] is not None) == sorted((True, d, want[i]) for i, d in ((0, 4), (2, 4), (3, 9), (4, 4)))
    assert sorted(r[3] for r in got if r[0] is None) == sorted((want[1], want[5]))
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in by_start] == [None, None, 4, 4, 4, 9] and [r[1] for r in by_start] == [0, *np.cumsum([r[2] for r in by_start])[:-1]]


def test_cached_encoder_equals_the_library(word_library):
    import pyarrow as pa

    encoder = tokens.CachedEncoder(WORDS, 10)
    for _ in range(3):
        ids, ends = encoder.encode(pa.array([t or "" for t in ODD]))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [word_library.encode(t or "", add_special_tokens=False).ids for t in ODD]
    marks = [f"{w}{m}" for w in ("Ab", "é", "x9", "9", "don't", "") for m in ".,;:!?)\"'(-"]
    ids, ends = encoder.encode(pa.array([" ".join(marks)]))
    assert ids.tolist() == word_library.encode(" ".join(marks), add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    out = io.BytesIO()
    writer = token_store.PlaneWriter(out, kind, block=100)
    docs = [(5, np.arange(250, dtype=np.uint32)), (None, np.zeros(0, np.uint32)), (9, np.array([2**32 - 1, 0, 7], np.uint32)), (10, np.arange(97, dtype=np.uint32) * 70_001)]
    for doc in docs:
        writer.add(*doc)
    writer.close()
    read = list(token_store.PlaneReader(io.BytesIO(out.getvalue())).documents())
    assert [d for d, _ in read] == [d for d, _ in docs]
    for (_, runs), (_, ids) in zip(read, docs, strict=True):
        assert np.array_equal(np.concatenate([*runs, np.zeros(0, np.uint32)]), ids)
    with pytest.raises(ValueError):
        token_store.PlaneReader(io.BytesIO(out.getvalue()[:-3]))


def test_token_counts(spark):
    library = Tokenizer.from_file(BYTES)
    got = {r["doc_id"]: r for r in token_counts.token_counts(table(spark, ODD), BYTES).collect()}
    for i, text in enumerate(ODD):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 512), repr(text and text[:40])


def test_bpe_round_trip(spark, word_library):
    docs = table(spark, [*ODD, "a", "a"], [*range(len(ODD)), 500, None])
    got = {r["doc_id"]: r for r in bpe_table.round_trip(docs, WORDS).collect()}
    for i, text in [*enumerate(ODD), (500, "a"), (None, "a")]:
        ids = word_library.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256(word_library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[i])[1:] == want
    encoded = bpe_table.encode(docs.where("doc_id < 8"), WORDS)
    decoded = {r["doc_id"]: r["text"] for r in bpe_table.decode(encoded, WORDS, "doc_id").collect()}
    assert decoded == {i: word_library.decode(word_library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(ODD[:8])}


def test_words_split_into_blocks(spark, word_library, monkeypatch):
    monkeypatch.setattr(bpe_table, "BLOCK_BYTES", 40)
    texts = [f"some words {i % 7} again and again {i}" for i in range(60)]
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe_table.round_trip(table(spark, texts), WORDS).collect()}
    assert got == {i: hashlib.sha256(le(word_library.encode(t, add_special_tokens=False).ids)).hexdigest() for i, t in enumerate(texts)}


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def brute_components(prints, bits):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def test_simhash(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(200)) for _ in range(6)]
    texts = [*ODD]
    for t in base:
        for _ in range(12):
            words = t.split()
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice("xyz")
            texts.append(" ".join(words))
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(prints, 3)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == prints
    assert {d: r["component_id"] for d, r in got.items()} == want
    kept = simhash.dedup(table(spark, [*texts, "no id", "no id"], [*range(len(texts)), None, None]))
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == {*want.values(), None} and ids.count(None) == 2


def test_simhash_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 7)
    text = " ".join(f"w{i % 13}x{i % 5}" for i in range(400))
    (row,) = simhash.near_duplicates(table(spark, [text])).collect()
    assert int(row["fingerprint"], 16) == brute_fingerprint(text)
    assert simhash.fingerprint_bytes(text, 3) == brute_fingerprint(text).to_bytes(8, "big")


def test_joins_without_broadcasts(spark):
    """A star of many points, with joins that must shuffle."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame([(0, i) for i in range(1, 500)] + [(1000, 1001)], "a long, b long")
        assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {*((i, 0) for i in range(1, 500)), (1001, 1000)}
        pages = spark.createDataFrame([(i, "u", "same" if i % 3 else f"page {i}") for i in range(60)], "page_id long, url string, html string").repartition(7)
        got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc_convert.archived(pages).collect()}
        assert got == {i: ("response", None) if i % 3 == 0 or i == 59 else ("revisit", 59) for i in range(60)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5])
def test_pigeonring_loses_no_link(spark, bits):
    rnd = random.Random(bits)
    prints = set()
    for _ in range(25):
        center = rnd.getrandbits(64)
        for _ in range(20):
            prints.add(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, bits + 1))))
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), bits).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    assert got == want


def test_chains_leave_out_no_near_fingerprint(spark):
    """The filter is the Hamming distance itself: whatever is within it has a chain."""
    rnd = random.Random(9)
    pairs = []
    for _ in range(3_000):
        a, b = rnd.getrandbits(64), rnd.getrandbits(64)
        for p in rnd.sample(range(64), rnd.randint(0, 30)):
            b = b & ~(1 << p) | a & (1 << p)
        pairs.append((a - (1 << 63), b - (1 << 63)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a long, b long")
    for bits, m in ((26, 8), (3, 4), (11, 12)):
        got = {(r["a"], r["b"]) for r in df.where(simhash.near(F.col("a"), F.col("b"), bits, m)).collect()}
        assert got == {(a, b) for a, b in pairs if ((a ^ b) & (2**64 - 1)).bit_count() <= bits}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {*((i, 0) for i in range(1, 41)), (101, 100)}


def semi_global(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rnd = random.Random(1)
    parts = "the of and tion er ing thea onth rest hat was ont erst blew Über".split()

    def prose(n):
        return " ".join(rnd.choice(parts) + rnd.choice(parts) for _ in range(n))

    items = [(i, prose(rnd.randint(8, 40))) for i in range(17)] + [(17, "twentytwo characters!!"), (18, "thirty-four characters of an item."), (19, "twelve chars")] + [(90, "short"), (91, None), (None, prose(20)), (92, ""), (93, "SHORT"), (0, "another text of the first item's id")]
    texts = [None, "", *(prose(rnd.randint(0, 60)) for _ in range(30)), f"{prose(50_000)} {items[3][1]} {prose(10)}", "it is Short.", "shorter shortens"]
    for _ in range(90):
        item = list(rnd.choice(items[:20])[1])
        for _ in range(rnd.randint(0, 14)):
            at, how = rnd.randrange(len(item)), rnd.random()
            item[at : at + 1] = [] if how < 0.3 else [rnd.choice("xyz")] if how < 0.6 else [item[at], rnd.choice("xyz")]
        texts.append(f"{prose(rnd.randint(0, 30))}\n{''.join(item).upper()}  {prose(rnd.randint(0, 30))}")
    got = {r["doc_id"]: dict(zip(r["item_ids"], r["edits"], strict=True)) for r in decontaminate.leaks(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    n = 0
    for d, text in enumerate(texts):
        want = {}
        for i, t in items[:20]:
            t = decontaminate.plain(t)
            # a far longer text holds the item as it is, or this loop would take minutes
            edits = semi_global(t, decontaminate.plain(text)) if len(text or "") < 20_000 else 0 if t in decontaminate.plain(text) else len(t)
            if edits <= int(len(t) * decontaminate.BUDGET):
                want[i] = edits
        if text == "it is Short.":
            want |= {90: 0, 93: 0}
        n += len(want)
        assert got[d] == want
    assert n > 20
    clean = decontaminate.clean(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in clean.collect()} == {d for d, found in got.items() if not found}
    assert clean.columns == table(spark, []).columns and clean.first()["_text"] == "clash"


def test_benchmark_in_parts(spark, monkeypatch):
    items = [(i, f"item number {i} has a text of its own kind {i * i}") for i in range(40)]
    texts = [f"before {t} after" for _, t in items[:15]] + ["nothing of the kind"]
    whole = {r["doc_id"]: r for r in decontaminate.leaks(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    monkeypatch.setattr(decontaminate, "PART_BYTES", 500)
    monkeypatch.setattr(decontaminate, "PARTS", 1)
    benchmark = spark.createDataFrame([*items, *items], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(table(spark, texts), benchmark).collect()}
    assert got == whole
    assert all(i in got[i]["item_ids"] for i in range(15)) and got[15]["item_ids"] == []
    assert decontaminate.clean(table(spark, texts), benchmark).columns == table(spark, []).columns


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.languages(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert set(held.doc_id) == {d for d in got.doc_id if zlib.crc32(str(d).encode()) % 4 == 2}
    assert (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()
    odd = docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame([(10_000, None, "en"), (10_001, "123 !!", "en"), (10_002, "", None), (None, "The thing that was", None)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.languages(odd).where("doc_id >= 10000 or doc_id is null").collect()}
    assert [got[i]["lang_pred"] for i in (10_000, 10_001, 10_002)] == ["und"] * 3
    assert got[None]["lang_pred"] != "und" and got[None]["held_out"] is False
    kept = langid.identified(odd, odd)
    assert {10_000, 10_001, 10_002}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_language_scores_equal_a_plain_computation(spark, sf):
    """Grams counted one by one, margins as sums, families first and votes within."""
    import math
    import unicodedata

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(25).collect()] + ["Ein Ü", "x" * 50, "the the " * 40_000]

    def plain(text):
        low = f"  {text.lower()}  "
        codes = [ord(c) if unicodedata.category(c)[0] == "L" else 32 for c in low] + [32, 32]
        x = [0.0] * (2 * langid.BUCKETS)
        mask = (1 << 32) - 1
        two = [(a * 0x9E3779B1 + b * 0x85EBCA77) & mask for a, b in zip(codes, codes[1:], strict=False)]
        for h in two[:-1]:
            x[h >> 32 - langid.BITS] += 1
        for h, c in zip(two, codes[2:], strict=False):
            x[langid.BUCKETS + ((h * 0xC2B2AE3D + c * 0x27D4EB2F & mask) >> 32 - langid.BITS)] += 1
        x = [v * langid.SCALE / len(low) for v in x]

        def margin(name, k):
            return sum(v * w for v, w in zip(x, model.weights[name][:, k].tolist(), strict=True)) + model.bias[name][k]

        def sure(m):
            return 1 / (1 + math.exp(-4 * max(-50, min(50, m))))

        margins = [margin("", k) for k in range(len(model.families))]
        best = max(range(len(margins)), key=margins.__getitem__)
        name = model.families[best]
        votes, least = dict.fromkeys(model.members[name], 0), dict.fromkeys(model.members[name], 1.0)
        for k, (a, b) in enumerate(model.pairs[name]):
            m = margin(name, k)
            won = a if m >= 0 else b
            votes[won] += 1
            least[won] = min(least[won], sure(abs(m)))
        lang = max(sorted(votes), key=lambda v: (votes[v], least[v]))
        return lang, sure(margins[best]) * least[lang]

    for text, (lang, score) in zip(texts, model.predict(texts), strict=True):
        want = plain(text)
        assert lang == want[0] and math.isclose(score, want[1], abs_tol=2e-3), text[:40]


def test_machine_equals_a_plain_optimum():
    """The dual coordinate ascent reaches the least value of the loss it is made for."""
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 6)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0, 1]) + 0.3 * rnd.normal(size=60) > 0.4, 1.0, -1.0)
    weight = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum()) * 30

    def loss(w):
        return 0.5 * w @ w + (weight * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2).sum()

    w = langid.fit_linear(x, y, rounds=300)
    best = loss(w)
    for step in (1e-1, 1e-2, 1e-3):
        for _ in range(300):
            assert loss(w + step * rnd.normal(size=7)) >= best - 1e-3


def test_more_languages_than_a_screenful(spark):
    """Seventy languages of an alphabet of their own each: every one is learned."""
    rows = [(i, " ".join(chr(0x4E00 + 40 * (i % 70) + (i * 7 + j) % 30) * 2 for j in range(12)), f"l{i % 70:02d}") for i in range(70 * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as score", "'y' as held_out", "1 as machine")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select("lang").distinct().count() >= 60
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def test_one_language_or_none(spark):
    docs = table(spark, ["only english here", "and more of it", None])
    assert {r["lang_pred"] for r in langid.languages(docs).where("doc_id < 2").collect()} == {"en"}
    unlabelled = docs.withColumn("lang", docs["source"].substr(5, 1).cast("string")).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.languages(unlabelled).collect()} == {"und"}


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/", "http://example.net/en", "http://notexample.net/en/1", "https://x.example.com/de/4", "https://xexample.com/de/4", "ftp://é.org/fr/", "http://org/fr/a",
        "http://a.org/FR/a", "http://h?q/de", "http://h#f", "://x.net/a", "a://b://c.net/d", "http://net/x", "HTTP://Ö.NET/\n/en",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://z.net/q", "x"), (0, None, "x")], "page_id long, url string, host string")
    got = url_filter.judged(pages).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r["page_id"] is not None:
            host, path, rule, verdict = brute_rule(urls[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
            assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_urls_of_any_length(spark):
    """Very long ones of mixed characters, before and after the host; many null and repeated ones, without broadcasts."""
    import time

    long = "\U0001f600aé" * 70_000
    urls = [f"http://good{i % 9}.net/en/{i}" for i in range(30)] + [f"http://x.example.net/en/{i}" for i in range(30)] + [long + "://h.net/p", "http://" + long, f"http://h.site/{long}?q", long, "http://same.site/a"] + [None, "http://same.site/a"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = time.time()
        got = {r["page_id"]: r for r in url_filter.judged(pages).collect()}
        assert time.time() - began < 120 and len(got) == len(urls)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(got[i]["host"], got[i]["path"]) for i in range(60, 64)] == [("h.net", "/p"), (long, ""), ("h.site", "/" + long), ("", "")]
    assert got[60]["rule"] == "net/" and len({(r["score"], r["verdict"]) for r in got.values() if r["host"] == "same.site"}) == 1
    assert {(r["host"], r["verdict"]) for i, r in got.items() if urls[i] is None} == {("", "allow")}


def test_url_models(spark):
    """The table's numbers against a plain computation, and the ratio's direction."""
    import math
    from collections import Counter

    good, bad = [f"good{i % 5}.site/news/{i}" for i in range(40)], [f"spam{i % 5}.site/win/{i}" for i in range(40)]
    labelled = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "_url string, accepted boolean")
    order = 2
    table_ = {r["gram"]: r["delta"] for r in url_filter.gram_table(labelled, order).collect()}
    assert {r["k"] + 1 == len(r["gram"]) for r in url_filter.gram_table(labelled, order).collect()} == {True}
    counts = {True: Counter(), False: Counter()}
    for accepted, urls in ((True, good), (False, bad)):
        for u in urls:
            padded = url_filter.START * order + u
            for at in range(order, len(padded)):
                for k in range(order + 1):
                    counts[accepted][padded[at - k : at + 1]] += 1

    def p(accepted, gram):
        own = counts[accepted]
        lower = p(accepted, gram[1:]) if len(gram) > 1 else 1 / url_filter.ALPHABET
        total = sum(n for g, n in own.items() if len(g) == len(gram) and g[:-1] == gram[:-1])
        return (own[gram] + url_filter.SMOOTHING * lower) / (total + url_filter.SMOOTHING)

    assert set(table_) == set(counts[True]) | set(counts[False]) and len(table_) > 50
    for gram, delta in table_.items():
        assert math.isclose(delta, math.log(p(True, gram)) - math.log(p(False, gram)), abs_tol=1e-9), gram
    urls = ["good9.site/news/99", "spam9.site/win/7", "ÄÖÜ" * 700]
    scores = {r["_url"]: r["score"] for r in url_filter.scored(spark.createDataFrame([(u,) for u in urls], "_url string"), url_filter.gram_table(labelled, order), ["_url"], order).collect()}
    assert scores["good9.site/news/99"] > 0 > scores["spam9.site/win/7"]
    for u in urls:
        padded, total = url_filter.START * order + u, 0.0
        for at in range(order, len(padded)):
            total += next((table_[padded[at - k : at + 1]] for k in range(order, -1, -1) if padded[at - k : at + 1] in table_), 0.0)
        assert math.isclose(scores[u], total / len(u), abs_tol=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>First  para.<br><p>Second&nbsp;para</p> loose text <div>In a div</div><form>Search <input></form><aside>Side</aside>
<section id="comments"><p>Nice!</p></section><ul><li>one<li>two</ul></article><div class="ad">Buy</div><footer>&copy; X</footer></body></html>"""


def test_wrapper_text(spark):
    want = "Title & more\nFirst para.\nSecond para\nloose text\nIn a div\none\ntwo"
    cut = "<html><body><article><p>cut off in the midd<p>le of <b"
    pages = [(1, "http://h/1", PAGE), (2, None, None), (3, "http://h/2", ""), (4, "x", "plain < text & more"), (5, "http://h/3", cut), (None, "http://h/1", PAGE), (6, "http://h/9", "<p>" * 3000 + "deep" + "<script>" * 50)]
    got = {r["page_id"]: r for r in wrapper_extract.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == got[None]["text"] == want and got[1]["n_chars"] == len(want)
    assert (got[2]["text"], got[3]["text"], got[4]["text"]) == ("", "", "plain < text & more")
    assert got[5]["text"] == "cut off in the midd\nle of" and got[6]["text"] == "deep"


def test_wrapper_learns_the_template(spark):
    """Nothing marks the article here; what the pages of a host share is template."""
    pages = [(i, f"http://same.host/{i}", f"<body><div class=top>Welcome to the site</div><div class=story><p>Story {i} tells of {i * i}.</p><p>Read more every day</p></div><div class=end>All rights reserved</div></body>") for i in range(8)]
    other = [(100, "http://single.host/1", "<body><div class=top>Welcome to the site</div><div class=story><p>Alone.</p></div></body>")]
    got = {r["page_id"]: r["text"] for r in wrapper_extract.extracted(spark.createDataFrame(pages + other, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Story {i} tells of {i * i}." for i in range(8)}, 100: "Welcome to the site\nAlone."}


def test_copies_of_an_article_are_no_template(spark):
    story = "<p>The same long story is on this host many times, with all of its words.</p>"
    pages = [(i, f"http://copies.host/{i}", f"<body><article><h1>Copy {i}</h1>{story}<p>By the editors</p></article><div>foot {i}</div></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrapper_extract.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Copy 3\nThe same long story is on this host many times, with all of its words.\nBy the editors"


def paths(tree, nodes):
    out = set()
    for n in nodes:
        path = []
        while n:
            path.append(tree.labels[n])
            n = tree.parents[n]
        out.add("/".join(reversed(path)))
    return out


def test_simple_tree_matching():
    def tree(page):
        return wrapper_extract.parse(page)[0]

    a, b = tree("<body><div class=a><p>x</p></div><div class=b>y</div></body>"), tree("<body><div class=a><p>x</p><p>z</p><ul><li>q</ul></div><div class=c>y</div></body>")
    both = paths(a, [x for x, _ in wrapper_extract.aligned(a, b)])
    assert "body/div.a/p" in both and "body/div.b" not in both
    assert wrapper_extract.Tree.loaded(b.dumped()).dumped() == b.dumped()


def test_tree_matching_against_brute_force():
    """The number of pairs is that of the recursive definition over all order-keeping choices."""
    rnd = random.Random(5)

    def grow(tree, node, depth):
        labels = rnd.sample("abcdef", rnd.randint(0, 4 if depth else 5))
        for label in labels:
            child = tree.child(node, label)
            if depth < 3:
                grow(tree, child, depth + 1)

    def size(a, b, x, y):
        if a.labels[x] != b.labels[y]:
            return 0
        left = [i for i in range(1, len(a.labels)) if a.parents[i] == x]
        right = [i for i in range(1, len(b.labels)) if b.parents[i] == y]
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, u in enumerate(left):
            for j, v in enumerate(right):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size(a, b, u, v))
        return 1 + best[-1][-1]

    for _ in range(60):
        a, b = wrapper_extract.Tree(), wrapper_extract.Tree()
        grow(a, 0, 0)
        grow(b, 0, 0)
        found = wrapper_extract.aligned(a, b)
        assert len(found) == size(a, b, 0, 0)
        of = dict(found)
        for x, y in found:
            assert a.labels[x] == b.labels[y] and (x == 0 or of[a.parents[x]] == b.parents[y])


def test_pages_that_break_parsers():
    import time

    began = time.time()
    none = frozenset()
    assert wrapper_extract.text_of("<body>" + "<div>" * 5_000 + "deep", none, none) == "deep"
    assert wrapper_extract.text_of("<p>kept<p>lost <a " + " ".join(f'a{i}="{i}"' for i in range(1_000)), none, none) == "kept\nlost"
    assert wrapper_extract.text_of("<p>kept" + "<a b='" * 5_000, none, none) == "kept"
    assert wrapper_extract.text_of("<span>" * 5_000 + "<p>x" * 5_000, none, none).count("x") == 5_000
    assert wrapper_extract.text_of("<b>" + "x</i>" * 20_000, none, none) == "x" * 20_000
    tree, _ = wrapper_extract.parse("".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}>" for i in range(5_000)))
    assert len(wrapper_extract.aligned_slots(tree.dumped(), tree.dumped())) == 5_000
    assert time.time() - began < 8


def unmarked(page):
    """The page without anything that says what its parts are."""
    import re

    for tag in ("nav", "article", "footer"):
        page = re.sub(f"<(/?){tag}>", r"<\1section>", page)
    return page.replace(' class="ad"', "").replace("<h1>", "<div>").replace("</h1>", "</div>")


def test_wrapper_finds_the_article_without_its_marks(spark):
    """The given pages, their marks taken away: what the wrapper leaves is what the marks tell, nearly always; without it hardly ever."""
    import re

    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    plain = pages.withColumn("html", F.udf(unmarked)("html"))
    want = {r["page_id"]: r["text"] for r in wrapper_extract.extracted(pages, wrappers=False).collect()}
    assert {r["page_id"]: r["text"] for r in wrapper_extract.extracted(pages).collect()} == want
    on = {r["page_id"]: r["text"] for r in wrapper_extract.extracted(plain).collect()}
    off = {r["page_id"]: r["text"] for r in wrapper_extract.extracted(plain, wrappers=False).collect()}

    def share(got):
        return sum(got[i] == want[i] for i in want) / len(want)

    assert share(on) >= 0.9 and share(off) <= 0.1, (share(on), share(off))


def test_the_wrapper_decides_on_the_given_pages(spark):
    """With wrappers every block that goes is one of a stock slot; markup is asked where there is no wrapper."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    on, off = ({r["rule"]: r["blocks"] for r in wrapper_extract.removals(pages, wrappers=w).collect()} for w in (True, False))
    assert set(on) == {"kept", "stock"} and set(off) == {"kept", "markup"} and on["stock"] == off["markup"] > 10_000 and on["kept"] == off["kept"]


def test_an_article_whose_marks_lie(spark):
    """All of the page is marked as article: the wrapper tells its furniture by what repeats."""
    stock = [f"{a} of {b}" for a in ("All the news", "The weather", "The shop", "A letter") for b in ("today", "this site")]

    def page(i):
        story = [f"Paragraph {k} of story {i} is told at length in words {i * 31 + k} of its own and no other page has them." for k in range(3)]
        links = "".join(f"<li>{stock[(i + k) % 8]}</li>" for k in range(2))
        return f"<body><article><ul class=top>{links}</ul><div class=promo2x>Subscribe today for half the price</div><div class=story>{''.join(f'<p>{p}</p>' for p in story)}</div><div class=end>All rights reserved</div></article></body>", "\n".join(story)

    rows = [(i, f"http://lies.host/{i}", page(i)[0]) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in wrapper_extract.extracted(df).collect()} == {i: page(i)[1] for i in range(20)}
    assert {r["rule"]: r["pages"] for r in wrapper_extract.removals(df).collect()} == {"constant": 20, "stock": 20, "kept": 20}
    assert all(r["text"] != page(r["page_id"])[1] for r in wrapper_extract.extracted(df, wrappers=False).collect())


def test_weak_names_in_an_article():
    none = frozenset()
    long = "This paragraph of the story happens to stand in a box that has a name of the usual kind."
    page = f'<article><p>Story.</p><div class="notice">{long}</div><div class="related">More</div><div class="alert"><a href=x>{long}</a></div><div class="comments">{long}</div></article><div class="notice">{long}</div>'
    assert wrapper_extract.text_of(page, none, none) == f"Story.\n{long}"


def test_clashing_names_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "<p>text", "a", "b", "c", 4)], "page_id long, url string, html string, text string, host string, _host string, n_chars long")
    assert [tuple(r) for r in wrapper_extract.extracted(pages).collect()] == [(1, "http://h/1", "text", 4)]


def test_warc(spark):
    big = "é" * 200_000
    rows = [(1, "http://a/1", "same"), (5, "http://a/2", "same"), (3, None, "same"), (2, "http://a b/\t", "other\r\n\r\n<html>"), (7, "u", None), (8, "u", ""), (9, "http://big", big), (None, "n", "same"), (None, "n", "lone")]
    pages = spark.createDataFrame([(*r, "clash", 4) for r in rows], "page_id long, url string, html string, payload_bytes string, row long").repartition(3)
    got = warc_convert.archived(pages).collect()
    assert len(got) == len(rows)
    of = {r["page_id"]: r for r in got if r["page_id"] is not None}
    for page, _, html in rows[:7]:
        data = (html or "").encode()
        assert (of[page]["payload_bytes"], of[page]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {p: (r["record_type"], r["refers_to"]) for p, r in of.items()} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 2: ("response", None), 7: ("revisit", 8), 8: ("response", None), 9: ("response", None)}
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None) == [("response", None), ("revisit", 5)]
    assert of[3]["url"] == "urn:row:3" and of[2]["url"] == "http://a%20b/%09" and of[5]["date"] == "2001-01-01T00:00:05Z"


def test_arc_versions():
    for version in (1, 2):
        line = "http://x y/z 1.2.3.4 20010203040506 text/html " + ("" if version == 1 else "200 - - 17 f.arc ") + "5"
        packed = warc_convert._member(warc_convert.version_block(version, "f.arc")) + warc_convert._member(line.encode() + b"\nhello\n")
        ((fields, block),) = list(warc_convert.arc_records(io.BytesIO(packed)))
        assert (fields["URL"], fields["Archive-date"], block) == ("http://x y/z", "20010203040506", b"hello")
    with pytest.raises(ValueError):
        list(warc_convert.arc_records(io.BytesIO(packed[:-4])))


def test_warc_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc_convert.archived(pages, least_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_token_counts_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 50)
    library = Tokenizer.from_file(BYTES)
    texts = [*ODD, "no id", "no id"]
    rows = token_counts.token_counts(table(spark, texts, [*range(len(ODD)), None, None]), BYTES).collect()
    got = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert got == {i if i < len(ODD) else None: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert sum(r["doc_id"] is None for r in rows) == 2


def test_files_of_hadoop_schemes(monkeypatch):
    from pyarrow import fs

    from factloom.llm import shared

    monkeypatch.setattr(shared, "SCHEMES", {**shared.SCHEMES, "other": "file"})
    assert shared.filesystem("other:///tmp/x")[1] == "/tmp/x" and isinstance(shared.filesystem("/tmp/x")[0], fs.LocalFileSystem)
    assert shared.SCHEMES["s3a"] == "s3"
