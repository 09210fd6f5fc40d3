"""Facts of a page payload, their text, and documents made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.functions.formats import MISSING, day, inr, lock_in, month, percent
from factloom.functions.text import cleaned, let, normalized, or_else, strip, without_exit_load_label

PAYLOAD = (
    "scheme_name string, plan_type string, category string, sub_category string, sub_sub_category string, fund_house string, nav double, nav_date string, aum double, expense_ratio string, rating int,"
    " min_investment_amount double, mini_additional_investment double, min_sip_investment double, sip_multiplier double, purchase_multiplier double, exit_load string, stamp_duty string,"
    " lock_in struct<years:int,months:int,days:int>, benchmark_name string, benchmark string, launch_date string, description string, nfo_risk string,"
    " stp_details struct<stp_in_minimum_installment_amount:double>, rta_details struct<custodian_name:string,rta_name:string>, amc_info struct<name:string,aum:double,rank:string,launch_date:string>,"
    " category_info struct<category_helper_text:string,tax_impact:string>, return_stats array<struct<risk:string>>, historic_exit_loads array<struct<as_on_date:string,note:string>>,"
    " fund_manager_details array<struct<person_name:string,date_from:string,education:string>>,"
    " holdings array<struct<company_name:string,sector_name:string,instrument_name:string,nature_name:string,corpus_per:double,portfolio_date:string>>"
)


def present(c: Column) -> Column:
    """Neither null, empty nor the missing mark."""
    return F.coalesce(~strip(c).isin("", MISSING), F.lit(False))


def parsed(rows: DataFrame, json_col: str) -> DataFrame:
    """The payload's columns beside the row's other ones."""
    return rows.withColumn("_p", F.from_json(json_col, PAYLOAD)).select(*[c for c in rows.columns if c != json_col], "_p.*")


def _falling(rows: Column, key) -> Column:
    """Rows by falling key, equal ones in their order."""
    at = F.transform(rows, lambda x, i: F.struct((-key(x)).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(at), lambda s: s["x"])


def _sector_sums(rows: Column) -> Column:
    """array of struct(sector, weight_pct) in order of first appearance: rows are sorted by sector and each run is summed in one pass."""
    run = "struct<sector:string,first:int,weight_pct:double>"
    by_sector = F.sort_array(F.transform(rows, lambda h, i: F.struct(h["sector"].alias("sector"), i.alias("first"), h["weight_pct"].alias("weight_pct"))))
    start = F.struct(F.lit(None).cast(run).alias("now"), F.array().cast(f"array<{run}>").alias("done"))

    def step(state: Column, h: Column) -> Column:
        now = state["now"]
        grown = F.struct(now["sector"].alias("sector"), now["first"].alias("first"), (now["weight_pct"] + h["weight_pct"]).alias("weight_pct"))
        same = F.struct(grown.alias("now"), state["done"].alias("done"))
        other = F.struct(h.alias("now"), F.when(now.isNull(), state["done"]).otherwise(F.array_append(state["done"], now)).alias("done"))
        return F.when(now["sector"] == h["sector"], same).otherwise(other)

    runs = F.aggregate(by_sector, start, step, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["now"])))
    in_order = F.sort_array(F.transform(runs, lambda r: F.struct(r["first"].alias("first"), r["sector"].alias("sector"), r["weight_pct"].alias("weight_pct"))))
    return F.transform(in_order, lambda r: F.struct(r["sector"].alias("sector"), r["weight_pct"].alias("weight_pct")))


def sector_totals(holdings: DataFrame, by: str, sector: str = "sector", weight: str = "weight", place: str = "pos") -> DataFrame:
    """(by, sector, weight_pct, nth): sums of the known weights, sectors by falling unrounded sum, then first seen."""
    known = holdings.where(F.col(weight).isNotNull()).groupBy(by, or_else(F.col(sector), F.lit("Unspecified")).alias("sector")).agg(F.sum(weight).alias("_sum"), F.min(place).alias("_first"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_sum"), "_first", "sector"))
    return known.select(by, "sector", F.round("_sum", 2).alias("weight_pct"), nth.alias("nth"))


def top_holdings(holdings: DataFrame, by: str, weight: str = "weight", place: str = "pos", k: int = 5) -> DataFrame:
    """The k rows of each group by falling weight, unknown ones as -1, equal ones in their order."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.coalesce(F.col(weight), F.lit(-1.0)).desc(), place))
    return holdings.withColumn("nth", nth).where(F.col("nth") <= k)


def versions(rows: DataFrame, by: str, on: str, place: str) -> DataFrame:
    """Adds version (1 is the latest) and historical (all but the latest)."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.coalesce(F.col(on).cast("string"), F.lit("")).desc(), place))
    return rows.withColumn("version", nth).withColumn("historical", F.col("version") > 1)


def facts(rows: DataFrame, id_col: str = "scheme_id", fallback_tax_note: str = MISSING, fallback_rta: str = MISSING) -> DataFrame:
    """One row of display facts for each payload row (columns of PAYLOAD and the id)."""
    c, lit = F.col, F.lit
    holdings = F.filter("holdings", lambda h: h.isNotNull())
    names = F.transform(holdings, lambda h: F.struct(*[cleaned(h[f"{n}_name"]).alias(n) for n in ("company", "sector", "instrument", "nature")], h["corpus_per"].alias("weight_pct")))
    rows_of = F.transform(names, lambda h: F.struct(h["company"].alias("company"), or_else(h["sector"], lit("Unspecified")).alias("sector"), or_else(h["instrument"], h["nature"]).alias("instrument"), h["weight_pct"].alias("weight_pct")))
    rows, rows_of = rows.withColumn("_held", rows_of), c("_held")  # read three times, cleaned once
    known = F.filter(rows_of, lambda h: h["weight_pct"].isNotNull())
    sectors = _sector_sums(known)
    history = F.transform(F.filter("historic_exit_loads", lambda h: h.isNotNull()), lambda h: F.struct(cleaned(h["as_on_date"]).alias("as_on_date"), without_exit_load_label(h["note"]).alias("note")))
    dated = F.transform(history, lambda h, i: F.struct(F.coalesce(h["as_on_date"], lit("")).alias("d"), (-i).alias("i"), h.alias("h")))
    managers = F.filter(
        F.transform("fund_manager_details", lambda m: F.struct(cleaned(m["person_name"]).alias("name"), month(m["date_from"]).alias("tenure_from"), cleaned(m["education"]).alias("education"))), lambda m: F.coalesce(m["name"] != "", lit(False))
    )
    risk = F.get(F.filter(F.transform("return_stats", lambda r: cleaned(r["risk"])), lambda r: F.coalesce(r != "", lit(False))), lit(0))
    as_on = F.get(F.filter(F.transform(holdings, lambda h: h["portfolio_date"]), lambda d: F.coalesce(d != "", lit(False))), lit(0))
    none = F.array()
    missing = lit(MISSING)
    return rows.select(
        c(id_col).alias("scheme_id"),
        cleaned(c("scheme_name")).alias("scheme_name"),
        or_else(cleaned(c("plan_type")), lit("Direct")).alias("plan_type"),
        strip(F.concat(F.coalesce(cleaned(c("category")), lit("")), lit(" "), F.coalesce(cleaned(c("sub_category")), lit("")))).alias("category"),
        F.coalesce(cleaned(c("category")), lit("")).alias("category_raw"),
        F.coalesce(cleaned(c("sub_category")), lit("")).alias("sub_category"),
        cleaned(c("sub_sub_category")).alias("sub_sub_category"),
        or_else(cleaned(c("fund_house")), cleaned(c("amc_info.name"))).alias("fund_house"),
        inr(c("nav")).alias("nav"),
        day(c("nav_date")).alias("nav_date"),
        inr(c("aum"), " Cr").alias("fund_aum"),
        inr(c("amc_info.aum"), " Cr").alias("amc_aum_total"),
        cleaned(c("amc_info.rank")).alias("amc_rank"),
        percent(c("expense_ratio")).alias("expense_ratio"),
        c("rating"),
        or_else(risk, missing).alias("risk_rating"),
        inr(c("min_investment_amount")).alias("min_first_inv"),
        inr(c("mini_additional_investment")).alias("min_additional_inv"),
        inr(c("min_sip_investment")).alias("min_sip"),
        inr(c("sip_multiplier")).alias("sip_multiplier"),
        inr(c("purchase_multiplier")).alias("purchase_multiplier"),
        inr(c("stp_details.stp_in_minimum_installment_amount")).alias("min_stp_in"),
        without_exit_load_label(c("exit_load")).alias("exit_load"),
        F.coalesce(F.transform(F.reverse(F.array_sort(dated)), lambda x: x["h"]), none).alias("exit_load_history"),
        or_else(cleaned(c("stamp_duty")), missing).alias("stamp_duty"),
        lock_in(c("lock_in.years"), c("lock_in.months"), c("lock_in.days")).alias("lock_in"),
        or_else(cleaned(c("benchmark_name")), missing).alias("benchmark"),
        or_else(cleaned(c("benchmark")), missing).alias("benchmark_short"),
        day(c("launch_date")).alias("scheme_launch_date"),
        day(c("amc_info.launch_date")).alias("amc_incorporation_date"),
        cleaned(c("amc_info.name")).alias("amc_name"),
        or_else(cleaned(c("rta_details.custodian_name")), missing).alias("custodian"),
        or_else(cleaned(c("rta_details.rta_name")), lit(fallback_rta)).alias("rta"),
        or_else(cleaned(c("description")), missing).alias("investment_objective"),
        or_else(cleaned(c("category_info.category_helper_text")), missing).alias("category_helper_text"),
        or_else(cleaned(c("category_info.tax_impact")), lit(fallback_tax_note)).alias("tax_note"),
        F.coalesce(F.size(rows_of), lit(0)).alias("holdings_count"),
        F.when(as_on.isNotNull(), day(as_on)).alias("holdings_portfolio_date"),
        F.coalesce(F.slice(_falling(rows_of, lambda h: F.coalesce(h["weight_pct"], lit(-1.0))), 1, 5), none).alias("top_holdings"),
        F.coalesce(F.transform(_falling(sectors, lambda s: s["weight_pct"]), lambda s: F.struct(s["sector"].alias("sector"), F.round(s["weight_pct"], 2).alias("weight_pct"))), none).alias("sector_allocation"),
        F.coalesce(managers, none).alias("fund_managers"),
        or_else(cleaned(c("nfo_risk")), missing).alias("nfo_risk"),
    )


def weight_text(weight: Column) -> Column:
    return F.when(weight.isNotNull(), F.format_string("%.2f%%", weight)).otherwise(F.lit(MISSING))


def facts_text(url: Column) -> Column:
    """The facts' lines, normalised."""
    return normalized(facts_lines(url))


def facts_lines(url: Column) -> Column:
    """The facts' lines ``label: value`` in order, over the columns of ``facts``; lists give a line for each entry."""
    c, lit = F.col, F.lit

    def line(label: str, *parts) -> Column:
        return F.concat(lit(label), *[F.coalesce(p.cast("string"), lit("None")) for p in parts])

    def many(array: Column) -> Column:
        return F.nullif(F.array_join(array, "\n"), lit(""))

    history = F.transform("exit_load_history", lambda h, i: F.concat(lit("Exit load effective "), day(h["as_on_date"]), F.when(i == 0, " (current): ").otherwise(" (historical): "), h["note"]))
    managers = F.transform("fund_managers", lambda m: F.concat(lit("Fund manager: "), m["name"], lit(" (from "), m["tenure_from"], lit(")"), F.when(F.coalesce(m["education"], lit("")) != "", F.concat(lit("\n"), m["name"], lit(" education: "), m["education"])).otherwise("")))
    holdings = F.transform("top_holdings", lambda h: F.concat(lit("Top holding: "), h["company"], lit(" | sector "), h["sector"], lit(" | instrument "), F.coalesce(h["instrument"], lit("None")), lit(" | weight "), weight_text(h["weight_pct"])))
    sectors = F.transform("sector_allocation", lambda s: F.concat(lit("Sector allocation: "), s["sector"], lit(" | weight "), weight_text(s["weight_pct"])))
    lines = [
        or_else(c("scheme_name"), c("scheme_id")),
        lit(""),
        line("Fund category: ", c("category")),
        line("Fund house: ", c("fund_house")),
        line("Plan: ", F.concat(c("plan_type"), lit(" Growth"))),
        line("Source page: ", url),
        lit(""),
        lit("Overview"),
        line("NAV: ", F.concat(c("nav"), lit(" (as on "), c("nav_date"), lit(")"))),
        line("Fund size (AUM): ", c("fund_aum")),
        line("Expense ratio: ", c("expense_ratio")),
        line("Rating: ", c("rating"), lit(" out of 5")),
        line("Risk rating: ", c("risk_rating")),
        line("Fund benchmark: ", c("benchmark")),
        line("Scheme launch date: ", c("scheme_launch_date")),
        line("Date of Incorporation of ", F.concat(F.coalesce(c("amc_name"), lit("None")), lit(": "), c("amc_incorporation_date"))),
        line("Total AUM of ", F.concat(F.coalesce(c("amc_name"), lit("None")), lit(" (AMC level, not this fund): "), c("amc_aum_total"))),
        lit(""),
        lit("Minimum investments"),
        line("Min. for 1st investment: ", c("min_first_inv")),
        line("Min. for 2nd investment: ", c("min_additional_inv")),
        line("Min. for SIP: ", c("min_sip")),
        line("Purchase multiplier: ", c("purchase_multiplier")),
        lit(""),
        lit("Exit load, stamp duty and tax"),
        line("Exit load: ", c("exit_load")),
        many(history),
        line("Stamp duty on investment: ", c("stamp_duty")),
        line("Tax implication: ", c("tax_note")),
        line("Lock-in period: ", c("lock_in")),
        lit(""),
        lit("Fund management"),
        F.coalesce(many(managers), lit("Fund manager: Not available")),
        lit(""),
        lit("About the scheme"),
        line("Investment Objective: ", c("investment_objective")),
        line("Category description: ", c("category_helper_text")),
        line("Custodian: ", c("custodian")),
        line("Registrar & Transfer Agent: ", c("rta")),
        lit(""),
        lit("Holdings"),
        line("Holdings count: ", c("holdings_count")),
        F.concat(lit("Holdings as on: "), c("holdings_portfolio_date")),
        many(holdings),
        many(sectors),
    ]
    return F.concat_ws("\n", *lines)  # concat_ws leaves out null lines


def documents(rows: DataFrame, text: Column) -> DataFrame:
    """Adds the normalised text and the SHA-256 of it."""
    return rows.withColumn("text", normalized(text)).withColumn("text_sha256", F.sha2("text", 256))


def document_failures(rows: DataFrame, markers: tuple[str, ...] = ("Compare similar funds", "Return calculator", "Understand terms")) -> DataFrame:
    """(scheme_id, failure) of facts rows with text: required facts, needles that must stand in the text, noise that must not."""
    required = ("expense_ratio", "min_sip", "benchmark", "exit_load", "fund_aum", "nav", "stamp_duty", "risk_rating", "custodian")
    checks = [F.when(~F.coalesce(F.col("scheme_name") != "", F.lit(False)), "scheme_name missing")]
    checks += [F.when(~present(F.col(f)), f"{f} missing") for f in required]
    checks += [F.when(F.size("fund_managers") == 0, "fund_managers missing")]
    for f in ("scheme_name", "expense_ratio", "min_sip", "benchmark"):
        needle = F.coalesce(F.col(f), F.lit(""))
        checks.append(F.when((needle != "") & ~F.contains("text", needle), F.concat(F.lit("'"), needle, F.lit("' absent from text"))))
    checks += [F.when(F.col("text").contains(m), f"noise marker '{m}' present") for m in markers]
    return rows.select("scheme_id", F.explode(F.array_compact(F.array(*checks))).alias("failure"))
