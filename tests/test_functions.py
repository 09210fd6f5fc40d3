"""Text, format, guard, resolution and answer functions on rows of our own."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import formats as fmt
from factloom.functions import text as T
from factloom.functions import vectors as V
from factloom.operators import guards, history, resolve, validate
from factloom.sources import pages as P


def values(spark, column, texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}").coalesce(1)
    return [r[0] for r in df.select(column(F.col("x")).alias("v"), "i").orderBy("i").select("v").collect()]


def test_urls(spark):
    got = values(spark, T.normalized_url, ["HTTPS://A.B:443/x//?q#f", "http://a.b:80/", "http://a.b:443/X", " https://a.b ", "no url", None])
    assert got == ["https://a.b/x", "http://a.b", "http://a.b:443/X", "https://a.b", None, None]
    assert values(spark, T.urls, ["see https://a.b/c. and (http://x/y)", None]) == [["https://a.b/c.", "http://x/y"], []]


def test_normalized(spark):
    assert values(spark, T.normalized, ["  a\r\nb\rc \t d  \n\n\n\n e – f’s x ", "", None]) == ["a\nb\nc d\n\ne - f's x", "", None]
    assert values(spark, T.cleaned, [" a\r\nb ", None]) == ["a b", None]
    assert values(spark, T.squeezed, ["A b C\n"]) == ["abc"]


@given(st.text(alphabet="aZ \t\r\n–’ .é", max_size=40))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_normalized_twice_is_once(spark, text):
    df = spark.createDataFrame([(text,)], "x string").select(T.normalized(F.col("x")).alias("a"))
    assert df.select(F.col("a") == T.normalized(F.col("a"))).first()[0]


def test_noise(spark):
    near = "keep\nReturn calculator\n" + "x" * 50 + "\n\ntail"
    far = "keep\nReturn calculator\n" + "x" * 500 + "\n\ntail"
    end = "keep Check past data now"
    assert values(spark, T.without_noise, [near, far, end]) == ["keep\n\n\ntail".replace("\n\n\n", "\n\n"), far, "keep"]


def test_sentences_and_tokens(spark):
    texts = ["One. Two! three. Four? (Five) https://a.b. Yes", "1.03% of x.y is fine.", "", None, "  "]
    assert values(spark, T.sentence_count, texts) == [4, 1, 0, 0, 0]
    assert values(spark, T.fact_tokens, ["₹1,00.5 and 5 % or 01-Jan-2013, 2013-01-02; 7 Cr 8 crore 9"]) == [["₹1,00.5", "5 %", "01-Jan-2013", "2013-01-02", "7 Cr", "8 crore", "9"]]
    assert [str(x) for x in values(spark, T.last_updated, ["LAST updated from sources: 2024-02-03", "Last updated from sources: 2024-02-33", None])] == ["2024-02-03", "None", "None"]


def test_labelled_value(spark):
    text = "x\nNAV: \n ₹1,234.50 Cr\nRisk rating : Very High (x)\n"
    rules = [("NAV", r"₹[\d,]+(?:\.\d+)?(?:\s*Cr)?"), ("risk rating", r"[^\n(]+"), ("Other", ".+")]
    for label in (lambda x: x, F.lit, lambda x: F.concat(F.lit(x), F.substring(F.uuid(), 1, 0))):  # as text, as a literal, as a column
        assert list(spark.range(1).select(*[T.labelled_value(F.lit(text), label(name), pattern).alias(name) for name, pattern in rules]).first()) == ["₹1,234.50 Cr", "Very High", None]


def test_formats(spark):
    assert values(spark, fmt.inr, [None, 0.0, -5.0, 999.5, 1000.0, 113606.0, 12345678.9, -1234.56], "double") == ["Not available", "₹0", "₹-5", "₹999.5", "₹1,000", "₹1,13,606", "₹1,23,45,678.9", "₹-1,234.56"]
    assert values(spark, fmt.percent, [None, " 5 ", "5%"]) == ["Not available", "5%", "5%"]
    assert values(spark, fmt.day, [None, "01-Jan-2013", "2015-05-08T20:00:00Z", "2015-05-08", "soon", "2013"]) == ["Not available", "01-Jan-2013", "09 May 2015", "08 May 2015", "soon", "2013"]
    assert values(spark, fmt.month, [None, "", "2015-05-31T20:00:00+00:00", "x"]) == ["Not available", "Not available", "Jun 2015", "x"]
    assert [str(x) for x in values(spark, fmt.parsed_date, ["05 Mar 2013", "05-Mar-2013", "2013-03-05", "2013-03-05T20:00:00Z", "x", None])] == ["2013-03-05"] * 3 + ["2013-03-06", "None", "None"]
    lock = spark.createDataFrame([(1, 0, 2), (0, 0, 0), (None, 1, None), (3, 2, 1)], "y int, m int, d int")
    assert [r[0] for r in lock.select(fmt.lock_in(F.col("y"), F.col("m"), F.col("d"))).collect()] == ["1 year 2 days", "None", "1 month", "3 years 2 months 1 day"]
    assert values(spark, T.without_exit_load_label, ["Exit load of 1%", "Exit Load for units in : x", "exit load", None]) == ["1%", "x", "exit load", "Not available"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    got = [(round(r[0], 9), r[1]) for r in df.select(V.cosine_distance(F.col("a"), F.col("b")), V.is_unit(F.col("a"))).collect()]
    assert got == [(1.0, True), (1.0, False), (0.0, False)]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("ABCDE1234F", "pan"), ("abcde1234f", None), ("Aadhaar no: 2345 6789 0123", "aadhaar"), ("x a.b@c.de", "email"), ("+91 9876543210", "phone"), ("OTP is 1234", "otp"), ("folio no. 123456", "folio"), ("123456789", "account_number"),
        ("12345678", None), ("1234567890123456", None), (None, None), ("a@b.cd ABCDE1234F", "pan"),
    ],
)
def test_pii(spark, text, kind):
    got = values(spark, guards.pii, [text])[0]
    assert (got and got["kind"]) == kind
    if got:
        assert 0 <= got["start"] < got["end"] <= len(text)


def test_intents(spark):
    texts = ["Should I  buy it?", "what should i know about the exit load", "will it return 5%", "the SBI fund", "which of these funds has a lock-in", None]
    assert values(spark, guards.advice, texts) == [True, True, False, False, True, False]
    assert values(spark, guards.structural_intent, texts) == ["advice", "factual", "factual", "out_of_scope", "factual", "factual"]
    assert [r["blocked"] for r in values(spark, guards.two_layer_advice, texts)] == [True, False, False, False, False, False]
    assert [r["blocked"] for r in values(spark, guards.two_layer_performance, texts)] == [False, False, True, False, False, False]
    assert values(spark, guards.foreign_name, ["tata or sbi", "maximum", "l&t fund"]) == ["sbi", None, "l&t"]
    failing = lambda t: F.lit(None).cast("string")
    assert values(spark, lambda t: guards.second_opinion(t, failing), ["the SBI fund"]) == ["out_of_scope"]


def test_guard_chain(spark):
    chain = values(spark, lambda t: guards.guard_chain(t, F.lit(False)), ["ABCDE1234F should i buy", "should i buy", "tell me", "any fund"])
    assert [[d["guard"] for d in c] for c in chain] == [["pii"], ["pii", "advice"], ["pii", "advice", "performance", "out_of_corpus"], ["pii", "advice", "performance", "out_of_corpus"]]
    assert [c[-1]["triggered"] for c in chain] == [True, True, False, True] and not chain[0][0]["loggable"]


ALIASES = {"a": ["large cap", "alpha fund"], "b": ["balanced advantage", "balanced"], "c": ["fund"]}


def test_resolution(spark):
    texts = ["LARGE  cap please", "balanced advantage vs balanced", "xlarge cap", "large cap and balanced", "sbi large cap", "alpha fund fund", None, "small cap"]
    got = values(spark, lambda t: resolve.resolve(t, ALIASES, ["a", "b"]), texts)
    assert [r["scheme_ids"] for r in got] == [["a"], ["b"], [], ["a", "b"], [], ["a"], [], []]
    assert [r["confidence"] for r in got] == [0.95, 0.95, 0.0, 0.6, 0.0, 0.95, 0.0, 0.0]
    assert got[3]["matched_alias"] == "large cap,balanced" and got[3]["ambiguous"] and got[0]["matched_alias"] == "large cap"


def test_history(spark):
    rows = spark.createDataFrame([(1, t, q) for t, q in enumerate(["a?", "", "[redacted x", "b?", "c?"])], "conv_id long, turn long, question string").withColumn("answer", F.lit("z"))
    got = history.history(rows, 10).orderBy("turn").select(history.history_text(F.col("history"))).collect()
    assert [r[0] for r in got] == ["", "Q: a?\nA: z", "Q: a?\nA: z", "Q: a?\nA: z", "Q: a?\nA: z\nQ: b?\nA: z"]
    hint = history.carried_forward(rows, F.when(F.col("question") == "a?", "s"), 2).orderBy("turn")
    assert [r["hint"] for r in hint.collect()] == [None, "s", "s", None, None]


GOOD = "The large cap exit load is 1.5%. https://facts.example/a\nLast updated from sources: 2024-01-02"


@pytest.mark.parametrize(
    ("answer", "failures", "discardable"),
    [
        (GOOD, [], False), (GOOD.replace("https://facts.example/a", ""), ["citation_present", "citation_allowed"], True), (GOOD.replace("facts.example", "other.example"), ["citation_allowed"], True), (GOOD.replace("1.5%", "2.5%"), ["grounded"], False),
        (GOOD.replace("large cap ", ""), ["scheme_named"], False), ("You should buy. " + GOOD, ["no_advice"], True), ("Mail a@b.cd. " + GOOD, ["no_pii"], True), ("One. Two. Three. " + GOOD, ["sentence_budget"], False), (GOOD.split("\n")[0], ["has_last_updated"], False), (None, ["citation_present", "citation_allowed", "scheme_named", "has_last_updated"], True),
    ],
)
def test_validation(spark, answer, failures, discardable):
    row = spark.createDataFrame([(answer, "q", [("s_large_cap", "load 1.5%")], (["s_large_cap"], "large cap", 0.95, False))], "answer string, query string, evidence array<struct<scheme_id:string,text:string>>, resolution struct<scheme_ids:array<string>,matched_alias:string,confidence:double,ambiguous:boolean>")
    got = validate.validated(row, ["https://facts.example/a"], 3, "s_").first()
    assert (got["failures"], got["discardable"]) == (failures, discardable)


def test_evidence_of_another_scheme(spark):
    row = spark.createDataFrame([([("b", "x")], (["a"], "m", 0.9, False)), ([("b", "x")], (["a", "b"], "m", 0.6, True)), ([], (["a"], "m", 0.9, False))], "e array<struct<scheme_id:string,text:string>>, r struct<scheme_ids:array<string>,matched_alias:string,confidence:double,ambiguous:boolean>")
    assert [r[0] for r in row.select(validate.evidence_conflicts(F.col("e"), F.col("r"))).collect()] == [["b"], [], []]
    told = F.array(F.struct(F.lit("a").alias("scheme_id"), F.lit("15").alias("text")))
    both = row.limit(1).select(validate.ungrounded(F.lit("It is 5"), told, F.lit("")), validate.ungrounded(F.lit("It is 5"), told, F.lit(""), True)).first()
    assert list(both) == [[], ["5"]]


def test_page_sources(spark):
    html = '<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"mfServerSideData":{"a":1}}}}</script>'
    assert values(spark, P.payload, [html, html.replace('{"a":1}', "[1]"), html.replace("{", ""), "x", None]) == ['{"a":1}', None, None, None, None]
    page = "<html><body><nav>menu</nav><div>short</div><div class=b>long <p>text here</p><script>x</script></div></body></html>"
    assert P.dom_text_of(page) == "long\ntext here" and P.dom_text_of("<main>only <b>this</b></main><div>not this long div</div>") == "only\nthis" and P.dom_text_of(None) == ""
    assert values(spark, lambda c: P.main_text(c, None, 5), [page, "<p>ab</p>"]) == ["long\ntext here", None]
    assert values(spark, P.tag_text, [page + "&lt;b&gt;&amp;amp;"]) == ["short long text here <b>&amp;"]


def test_every_pattern_needs_one_of_its_marks():
    """Texts put together of the patterns' own words: none is matched without a mark."""
    words = (
        "should can could would do will i buy sell hold redeem invest exit switch good right time idea worth it buying best top better most safe fund scheme plan option one which of these is you go for opt consider put money what how much many "
        "return returns grow gain earn appreciate be performance profit loss yield growth in over after year month compare versus vs outperform beat against expected projected likely estimated make 5 risk-adjusted 12 % p.a. appreciation"
    ).split()
    rnd = random.Random(1)
    for _ in range(20_000):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(2, 9)))
        for patterns, marks in ((guards.ADVICE_SIGNALS, guards.ADVICE_MARKS), (guards.PERFORMANCE_SIGNALS, guards.PERFORMANCE_MARKS), (guards.PERFORMANCE_PATTERNS, guards.RETURN_MARKS)):
            assert any(m in text for m in marks) or not any(re.search(p, text) for p in patterns), text
