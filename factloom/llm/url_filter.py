"""URL filter: host rules, then a character language-model ratio, with built-in functions alone.

URLs that a rule decides are the labelled rows: allowed ones train the accepted
model, blocked ones the rejected model. Both are variable-order Markov models
over the characters of host and path: a character's probability after its longest
seen context, smoothed towards the next shorter one (n + B * P(shorter)) / (N + B),
down to a uniform distribution. For each gram the table holds the difference of
the two models' log-probabilities. A URL's score is the mean difference over its
characters (so length does not matter), and the threshold is the one that errs
least on labelled URLs, with both classes weighted alike.

The models count all distinct labelled URLs, by partial sums, and keep every gram;
the threshold is set on all of them that are held back. Each distinct window of
order + 1 characters is looked up once, longest gram first, and windows meet their
differences in a join that Spark may split or broadcast by size. A URL's rows carry its
128-bit hash, never the URL, so what is shuffled grows with the URLs' length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.llm.shared import stored

#: (rule, verdict): host and path of a rule as ``host/path``.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 4
SMOOTHING, ALPHABET, BINS = 2.0, 128, 400
#: Characters of a URL that are cut into windows together.
PIECE = 256
START = "\u0002"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*+", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*+([^?#]*+)", 1)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``, else an empty text. No pattern looks for it: one that repeats a group recurses for long URLs of mixed characters."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first, so it is put around the others
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _windows(rows: DataFrame, keep: list[str], order: int) -> DataFrame:
    """A row for each character of ``_url``: the character with the ``order`` ones before it.

    A URL is first cut into pieces of PIECE characters, as finding a place takes time in proportion to it.
    """
    padded = F.concat(F.lit(START * order), F.col("_url"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.char_length("_url") - 1) / PIECE).cast("int")), lambda i: F.substring(padded, i * PIECE + 1, F.lit(PIECE + order)))
    cut = rows.select(*keep, F.explode(pieces).alias("_piece"))
    at = cut.select(*keep, "_piece", F.explode(F.sequence(F.lit(1), F.char_length("_piece") - order)).alias("_at"))
    return at.select(*keep, F.substring("_piece", F.col("_at"), F.lit(order + 1)).alias("_window"))


def _grams(window: str, order: int) -> Column:
    """The grams (context and character) of length 1 to order + 1 that end a window."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"substring({window}, {order + 1 - k})").alias("gram")) for k in range(order + 1)]))


def gram_table(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """k (the context's length), gram, delta: the accepted model's log-probability less the rejected one's, of every gram seen.

    ``labelled`` has _url and accepted.
    """
    windows = _windows(labelled.where("_url <> ''"), ["accepted"], order)
    yes, no = F.sum(F.col("accepted").cast("long")), F.sum((~F.col("accepted")).cast("long"))
    seen = windows.groupBy("_window").agg(yes.alias("yes"), no.alias("no"))
    counts = seen.select("yes", "no", _grams("_window", order).alias("g")).groupBy("g.k", "g.gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    counts = counts.withColumns({"context": F.expr("left(gram, k)"), "shorter": F.expr("substring(gram, 2)")})
    context = Window.partitionBy("k", "context")  # as many rows as characters may follow
    counts = stored(counts.withColumns({"of_yes": F.sum("yes").over(context), "of_no": F.sum("no").over(context)}), "url-grams")
    level, tables = None, []
    for k in range(order + 1):
        own = counts.where(F.col("k") == k)
        if level is None:
            own = own.withColumns({"p": F.lit(1.0 / ALPHABET), "q": F.lit(1.0 / ALPHABET)})
        else:
            own = own.join(level, own["shorter"] == level["up"]).drop("up")
        own = own.withColumns({"p": (F.col("yes") + SMOOTHING * F.col("p")) / (F.col("of_yes") + SMOOTHING), "q": (F.col("no") + SMOOTHING * F.col("q")) / (F.col("of_no") + SMOOTHING)})
        level = own.select(F.col("gram").alias("up"), "p", "q")
        tables.append(own.select("k", "gram", (F.log("p") - F.log("q")).alias("delta")))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionAll(t)
    return every


def scored(rows: DataFrame, grams: DataFrame, keep: list[str], order: int = ORDER) -> DataFrame:
    """keep and score: the mean difference over the characters of ``_url``, each after its longest context in ``grams``.

    ``keep`` must tell the rows apart and is carried by each character, so it should be short; rows with an empty ``_url`` give none.
    """
    places = _windows(rows.where("_url <> ''"), keep, order)
    asked = places.select("_window").distinct().select("_window", _grams("_window", order).alias("g")).select("_window", "g.k", "g.gram")
    deltas = asked.join(grams, ["k", "gram"]).groupBy("_window").agg(F.max_by("delta", "k").alias("delta"))
    # a window of which nothing was seen says nothing; the key is made anew, so that a window which nearly all URLs have can be split
    key = F.concat("_window", F.lit("")).alias("_key")
    told = places.select(*keep, key).join(deltas.select(key, "delta"), "_key", "left")
    return told.groupBy(*keep).agg(F.avg(F.coalesce("delta", F.lit(0.0))).alias("score"))


def threshold(scores: DataFrame) -> float:
    """The score from which to accept, by the labelled rows (accepted, score): least error, both classes weighted alike."""
    binned = scores.select("accepted", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + 4) * BINS / 8))).alias("bin"))
    counts = {(r["accepted"], r["bin"]): r["count"] for r in binned.groupBy("accepted", "bin").count().collect()}  # 2 * BINS rows at most
    total = {c: sum(n for (a, _), n in counts.items() if a == c) for c in (True, False)}
    if not total[True] or not total[False]:
        return float("-inf") if total[True] or not total[False] else float("inf")
    best, cut, yes, no = None, [], 0, 0
    for b in range(BINS + 1):  # accept from bin b on: accepted rows below are errors, rejected ones from it on too
        error = yes / total[True] + (total[False] - no) / total[False]
        if best is None or error < best - 1e-12:
            best, cut = error, [b]
        elif error <= best + 1e-12:
            cut.append(b)
        yes, no = yes + counts.get((True, b), 0), no + counts.get((False, b), 0)
    return (cut[0] + cut[-1]) / 2 * 8 / BINS - 4


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """A row for each row of ``pages``: id, host, path, rule, verdict, score.

    A rule's verdict stands; else the models decide: ``allow`` from the threshold on.
    An empty or null URL, or one without ``://``, has an empty host and path, fits no
    rule and is allowed (score 0, nothing speaks against it) unless only rejected
    URLs are known. Without labelled URLs of both classes the known one decides;
    without any, all are allowed. Null ids and repeated rows pass through; other
    columns are not read; an empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("_id", _digest(F.concat("host", "path")))
    texts = rows.select("_id", F.concat("host", "path").alias("_url"), F.col("_rule.verdict").alias("_verdict")).where("_url <> ''").dropDuplicates(["_id"])
    known = texts.where("_verdict is not null").select("_id", "_url", (F.col("_verdict") == "allow").alias("accepted"))
    known = stored(known, "url-labelled")
    # every fourth labelled URL calibrates, the others train
    held = F.pmod(F.xxhash64("_url", F.lit(1)), F.lit(4)) == 0
    grams = stored(gram_table(known.where(~held)), "url-model")
    cut = threshold(scored(known.where(held), grams, ["_id", "accepted"]))
    # the key is made anew on both sides, so that rows of a URL that very many pages have can be split; empty ones take no part
    open_urls = scored(texts.where("_verdict is null"), grams, ["_id"]).select(F.concat("_id", F.lit(b"")).alias("_key"), "score")
    joined = rows.withColumn("_key", F.when(F.concat("host", "path") != "", F.concat("_id", F.lit(b"")))).join(open_urls, "_key", "left")
    by_score = F.when(F.coalesce("score", F.lit(0.0)) >= F.lit(cut), "allow").otherwise("block")
    by_score = F.when((F.col("host") == "") & (F.col("path") == "") & F.lit(cut != float("inf")), "allow").otherwise(by_score)
    return joined.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", by_score).alias("verdict"), "score")


def _digest(url: Column) -> Column:
    return F.unhex(F.md5(url.cast("binary")))
