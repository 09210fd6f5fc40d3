"""Registry-driven chunks: one fact, one chunk; long prose in overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.config import Settings
from factloom.functions.formats import parsed_date
from factloom.functions.text import collapse, label_lines, labelled_value, let, nonblank_lines, strip, token_count, tokens
from factloom.operators.facts import present, weight_text
from factloom.session import staged

CURRENCY = r"₹[\d,]+(?:\.\d+)?(?:\s*Cr)?"
# Field, section, label, value type, scope, is a fact, value pattern; the order is the chunks' order.
REGISTRY = (
    ("category", "overview", "Fund category", "enum", "fund", True, r"[^\n]+"),
    ("fund_house", "overview", "Fund house", "text", "fund", True, r"[^\n]+"),
    ("nav", "overview", "NAV", "currency", "fund", True, CURRENCY),
    ("fund_aum", "overview", "Fund size (AUM)", "currency_cr", "fund", True, CURRENCY),
    ("expense_ratio", "overview", "Expense ratio", "percent", "fund", True, r"[0-9.]+%"),
    ("rating", "overview", "Rating", "int", "fund", True, r"\d+"),
    ("risk_rating", "overview", "Risk rating", "enum", "fund", True, r"[^\n(]+"),
    ("benchmark", "overview", "Fund benchmark", "index_name", "fund", True, r"[^\n]+"),
    ("scheme_launch_date", "overview", "Scheme launch date", "date", "fund", True, r"[^\n]+"),
    ("amc_incorporation_date", "overview", "Date of Incorporation of {amc_name}", "date", "amc", True, r"[^\n]+"),
    ("amc_aum_total", "overview", "Total AUM of {amc_name} (AMC level, not this fund)", "currency_cr", "amc", True, CURRENCY),
    ("min_first_inv", "fees_and_minimums", "Min. for 1st investment", "currency", "fund", True, CURRENCY),
    ("min_additional_inv", "fees_and_minimums", "Min. for 2nd investment", "currency", "fund", True, CURRENCY),
    ("min_sip", "fees_and_minimums", "Min. for SIP", "currency", "fund", True, CURRENCY),
    ("purchase_multiplier", "fees_and_minimums", "Purchase multiplier", "currency", "fund", True, CURRENCY),
    ("exit_load", "fees_and_minimums", "Exit load", "text", "fund", True, r"[^\n]+"),
    ("stamp_duty", "fees_and_minimums", "Stamp duty on investment", "percent", "fund", True, r"[^\n]+"),
    ("tax_note", "fees_and_minimums", "Tax implication", "text", "fund", False, r"[^\n]+"),
    ("lock_in", "fees_and_minimums", "Lock-in period", "duration", "fund", True, r"[^\n]+"),
    ("investment_objective", "about", "Investment Objective", "text", "fund", False, r"[^\n]+"),
    ("category_helper_text", "about", "Category description", "text", "fund", False, r"[^\n]+"),
    ("custodian", "about", "Custodian", "text", "fund", True, r"[^\n]+"),
    ("rta", "about", "Registrar & Transfer Agent", "text", "fund", True, r"[^\n]+"),
    ("holdings_count", "portfolio", "Holdings count", "int", "fund", True, r"\d+"),
)
#: What a rule adds to a document's row.
RULE = ("pos", "field", "section", "label", "value_type", "scope", "is_fact", "from_facts", "from_text")


def resolved_label(label: Column, house: Column) -> Column:
    return F.replace(label, F.lit("{amc_name}"), F.coalesce(F.nullif(house, F.lit("")), F.lit("the AMC")))


def registry_values(docs: DataFrame, rules=REGISTRY, compared: bool = True) -> DataFrame:
    """Documents (scheme_id, text, amc_name, facts: map) by registry rules: from_facts, from_text, value (facts first), disagrees.

    Unless both are ``compared``, only value is told, and a text is searched only for
    what the facts do not have.

    The rules are configuration, so their product with the documents is an array of
    one struct a rule in each row: patterns are literals (but where a label holds
    the house's name) and nothing is joined.
    """

    def rule(pos: int, field: str, section: str, label: str, value_type: str, scope: str, is_fact: bool, value_pattern: str) -> Column:
        shown = resolved_label(F.lit(label), F.col("amc_name")) if "{" in label else F.lit(label)
        found = labelled_value(F.col("text"), shown if "{" in label else label, value_pattern)
        known = F.try_element_at("facts", F.lit(field))
        values = {"pos": F.lit(pos), "field": F.lit(field), "section": F.lit(section), "label": shown, "value_type": F.lit(value_type), "scope": F.lit(scope), "is_fact": F.lit(is_fact)}
        values |= {"from_facts": known, "from_text": found} if compared else {"value": strip(F.coalesce(known, found))}
        return F.struct(*[v.alias(n) for n, v in values.items()])

    added = RULE if compared else (*RULE[:-2], "value")
    rows = docs.withColumn("_rule", F.explode(F.array(*[rule(i, *r) for i, r in enumerate(rules)]))).select(*[c for c in docs.columns if c not in added], *[f"_rule.{n}" for n in added])
    if not compared:
        return rows
    both = F.col("from_facts").isNotNull() & F.col("from_text").isNotNull()
    return rows.withColumns({"value": strip(F.coalesce("from_facts", "from_text")), "disagrees": both & (collapse(F.col("from_facts")) != collapse(F.col("from_text")))})


def fact_body(name: Column, label: Column, scope: Column, value: Column) -> Column:
    prefix = F.when(scope == "amc", "AMC-level figure, not this scheme. ").otherwise("")
    return F.concat(name, F.lit(" — "), label, F.lit(": "), prefix, value, F.when(value.endswith("."), "").otherwise("."))


BODY = ("scheme_id", "doc_id", "scheme_name", "source_url", "section", "field", "value", "body", "value_type", "scope", "is_fact", "historical", "effective_date", "family", "pos")


def bodies(docs: DataFrame, rules=REGISTRY, holdings_mode: str = "sector_summary") -> DataFrame:
    """Chunk bodies of five families: registry facts, superseded exit loads, top holdings, sector summary, managers."""
    lit, c = F.lit, F.col
    base = ["scheme_id", "doc_id", "scheme_name", "source_url"]

    def family(n: int, rows: DataFrame, section, name, value, body, kind, pos, scope=lit("fund"), fact=lit(False), old: bool = False, date=None) -> DataFrame:
        values = [section, name, value, body, kind, scope, fact, lit(old), lit(None).cast("date") if date is None else date, lit(n), pos]
        return rows.select(*base, *[v.alias(a) for v, a in zip(values, BODY[4:], strict=True)])

    told = registry_values(docs, rules, compared=False).where(present(c("value")))
    known = family(0, told, c("section"), c("field"), c("value"), fact_body(c("scheme_name"), c("label"), c("scope"), c("value")), c("value_type"), c("pos"), c("scope"), c("is_fact"))
    old = docs.select(*base, F.posexplode(F.filter("exit_load_history", lambda h, i: i > 0)).alias("pos", "h"))
    old = family(
        1, old, lit("fees_and_minimums"), lit("exit_load_historical"), c("h.note"),
        F.concat(c("scheme_name"), lit(" — historical exit load, effective "), F.coalesce(c("h.as_on_date"), lit("None")), lit(": "), c("h.note"), lit(". Superseded, not the current exit load.")),
        lit("text"), c("pos"), old=True, date=parsed_date(c("h.as_on_date")),
    )
    line = F.transform("top_holdings", lambda h: F.concat(h["company"], lit(" | sector "), h["sector"], lit(" | instrument "), F.coalesce(h["instrument"], lit("None")), lit(" | weight "), weight_text(h["weight_pct"])))
    top = docs.where(F.size("top_holdings") > 0).withColumn("_l", line)
    head = F.concat(c("scheme_name"), lit(" — top holdings"), F.coalesce(F.concat(lit(" as on "), c("holdings_portfolio_date")), lit("")))
    top = family(2, top, lit("portfolio"), lit("top_holding"), F.get("_l", lit(0)), F.concat(head, lit(": "), F.array_join("_l", "; "), lit(".")), lit("table"), lit(0))
    every = known.unionByName(old).unionByName(top)
    if holdings_mode == "sector_summary":
        share = docs.where(F.size("sector_allocation") > 0).withColumn("_l", F.transform("sector_allocation", lambda s: F.concat(s["sector"], lit(" "), weight_text(s["weight_pct"]))))
        every = every.unionByName(family(3, share, lit("portfolio"), lit("sector_allocation"), F.get("_l", lit(0)), F.concat(c("scheme_name"), lit(" — sector allocation: "), F.array_join("_l", "; "), lit(".")), lit("table"), lit(0)))
    people = docs.select(*base, F.posexplode("fund_managers").alias("pos", "m")).where(F.coalesce(c("m.name") != "", lit(False)))
    text = F.concat(c("scheme_name"), lit(" — fund manager: "), c("m.name"), lit(" (from "), c("m.tenure_from"), lit(")."), F.when(F.coalesce(c("m.education"), lit("")) != "", F.concat(lit(" "), c("m.education"))).otherwise(""))
    return every.unionByName(family(4, people, lit("fund_management"), lit("fund_manager"), c("m.name"), text, lit("text"), c("pos")))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...], length) -> list[str]:
    """Pieces of at most ``size``: cut at the first separator that occurs, merge neighbours up to size with ``overlap``, cut longer ones again with the rest."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, rest = separators[at], separators[at + 1 :]
    if mark:
        cut = text.split(mark)
        parts = [p for p in [cut[0], *(mark + x for x in cut[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[str] = []

    def merge() -> None:
        window: list[str] = []
        total = 0
        for piece in held:
            n = length(piece)
            if window and total + n > size:
                if joined := "".join(window).strip():
                    out.append(joined)
                while window and (total > overlap or total + n > size):
                    total -= length(window.pop(0))
            window.append(piece)
            total += n
        if joined := "".join(window).strip():
            out.append(joined)
        held.clear()

    for part in parts:
        if length(part) < size:
            held.append(part)
            continue
        merge()
        if rest:
            out += split_recursively(part, size, overlap, rest, length)
        else:
            out.append(part)
    merge()
    return out


def pieces(text: Column, settings: Settings, tokenizer=None) -> Column:
    """Array of pieces: the text where it is within the budget, else the recursive split, with the default or a given tokenizer (str to int); null of null."""
    import re

    size, overlap, separators = settings.chunk_tokens, settings.overlap_tokens, settings.separators
    count = tokenizer or (lambda t: len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", t, re.A)))

    @F.pandas_udf("array<string>")
    def split(texts):
        return texts.map(lambda t: split_recursively(t, size, overlap, separators, count), na_action="ignore")

    return split(text)


def chunks(body_rows: DataFrame, categories: DataFrame, settings: Settings, *keep: str) -> DataFrame:
    """Bodies as chunks: long ones in pieces, ids numbered within (scheme, section, field), embedding input and token count.

    The categories table (scheme_id, category) is the allowlist's; a body without one
    is left out and is the orphan check's to report. ``keep`` are columns of the bodies
    (or ``piece`` or ``category``) that come last.
    """
    # bodies are made and counted once; the Python function sees nulls for those within the budget
    rows = body_rows.withColumn("_tokens", token_count(F.col("body")))
    rows = rows.withColumn("_cut", pieces(F.when(F.col("_tokens") > settings.chunk_tokens, F.col("body")), settings))
    rows = rows.withColumn("_tokens", F.when(F.col("_cut").isNull(), F.col("_tokens")))
    rows = rows.select("*", F.posexplode(F.coalesce("_cut", F.array("body"))).alias("piece", "text")).drop("_cut", "body")
    nth = F.row_number().over(Window.partitionBy("scheme_id", "section", "field").orderBy("family", "pos", "piece")) - 1
    rows = rows.join(categories, "scheme_id").withColumn("_nth", nth)
    template = settings.prefix_template.replace("%", "%%").replace("{scheme_name}", "%1$s").replace("{category}", "%2$s").replace("{text}", "%3$s")
    return rows.select(
        F.concat_ws("_", "scheme_id", "section", "field", "_nth").alias("chunk_id"), "doc_id", "scheme_id", "section", "field", "text",
        F.format_string(template, "scheme_name", "category", "text").alias("embed_input"),
        "source_url", "value", "value_type", "scope", "effective_date", "historical", "is_fact", F.coalesce("_tokens", token_count(F.col("text"))).alias("token_count"), *keep,
    )


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """Adds the place of each row within its group, from 0, where a group may be of any size.

    Rows are dealt by ranges of group and order, so a large group spans tasks; rows
    are numbered within their task, after the rows that earlier tasks have of the
    group. ``order`` must tell the rows of a group apart.
    """
    ranged = rows.repartitionByRange(*by, *order).withColumn("_task", F.spark_partition_id())
    told = staged(ranged, "numbered")  # the tasks' bounds are fixed by what is written
    counts = told.groupBy(*by, "_task").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_task").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_task").orderBy(*order)) - 1
    same = F.col("_task") == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return told.withColumn("_own", own).join(before, same).select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))


def windows(text: Column, size: int = 200, overlap: int = 40) -> Column:
    """Overlapping token windows as array of struct(nth, n, text); one window for a short text."""
    step = size - overlap

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(step))
        own = F.transform(starts, lambda s: F.slice(words, s + 1, size))
        return F.transform(own, lambda w, i: F.struct(i.alias("nth"), F.size(w).alias("n"), F.array_join(w, " ").alias("text")))

    return let(tokens(text), cut)  # the text is cut into tokens once, not for each window


def stat_figures(text: str = "text") -> dict[str, Column]:
    """Sums over documents that ``stats_of`` makes statistics of."""
    c = F.col(text)
    return {"docs": F.count(F.lit(1)), "told": F.count(c), "chars": F.coalesce(F.sum(F.length(c)), F.lit(0)), "lines": F.coalesce(F.sum(nonblank_lines(c)), F.lit(0)), "labelled": F.coalesce(F.sum(label_lines(c)), F.lit(0))}


def stats_of(sums: DataFrame) -> DataFrame:
    """One row: doc_count, mean_doc_chars, total_lines, labelled_lines, labelled_line_ratio."""
    mean = F.when(F.col("told") > 0, F.col("chars") / F.col("told")).otherwise(0.0)
    ratio = F.when(F.col("lines") > 0, F.col("labelled") / F.col("lines")).otherwise(0.0)
    # ties go to the even digit
    return sums.select(F.col("docs").alias("doc_count"), F.bround(mean, 1).alias("mean_doc_chars"), F.col("lines").alias("total_lines"), F.col("labelled").alias("labelled_lines"), F.bround(ratio, 4).alias("labelled_line_ratio"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Statistics of documents' texts, see ``stats_of``."""
    return stats_of(docs.agg(*[v.alias(n) for n, v in stat_figures(text).items()]))


def strategy(stats: DataFrame, settings: Settings, single_fact_ratio: float = 1.0) -> DataFrame:
    """The decision beside the statistics: four recorded rules; only an explicit ``semantic`` changes the outcome."""
    if settings.strategy == "semantic" and not settings.semantic_available:
        raise ValueError("strategy is semantic but it is not available")
    r1 = F.col("labelled_line_ratio") > 0.15
    r2 = (F.col("doc_count") <= 10) & (F.col("mean_doc_chars") <= 60_000)
    chosen = "semantic" if settings.strategy == "semantic" else "label_aware_recursive"
    return stats.withColumns({"r1": r1, "r2": r2, "r3": r1, "r4": F.lit(single_fact_ratio >= 0.8), "selected": F.lit(chosen)})


def single_fact_ratio(golden: DataFrame, field: str = "field") -> DataFrame:
    return golden.agg(F.coalesce(F.avg(F.coalesce(F.col(field) != "", F.lit(False)).cast("double")), F.lit(1.0)).alias("ratio"))
