"""Queries of projections, joins, aggregates, windows, audits and stores."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from factloom.catalogue import query
from factloom.config import Settings
from factloom.functions import text as T
from factloom.operators import chunking, facts, quality, store
from factloom.operators.chunking import REGISTRY
from factloom.session import table

c = F.col


def holdings(spark, sf):
    """Line items as a supplier's holdings: sector is the part's type, weight the price (unknown for some), pos the order (line numbers repeat, so the part is in it)."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    weight = F.when(c("l_orderkey") % 11 != 0, c("l_extendedprice"))
    sector = F.when(c("p_partkey") % 13 != 0, c("p_type"))
    return lines.join(parts, c("l_partkey") == c("p_partkey")).select(c("l_suppkey").alias("scheme"), sector.alias("sector"), c("p_name").alias("company"), c("p_brand").alias("instrument"), weight.alias("weight"), ((c("l_orderkey") * 10 + c("l_linenumber")) * 10_000_000 + c("l_partkey")).alias("pos"))


HOLD_SQL = """WITH h AS (SELECT l_suppkey AS scheme, CASE WHEN p_partkey % 13 <> 0 THEN p_type END AS sector, p_name AS company, p_brand AS instrument,
    CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice END AS weight, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS pos FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(HOLD_SQL + """, s AS (SELECT scheme, coalesce(sector, 'Unspecified') AS sector, sum(weight) AS w, min(pos) AS f FROM h WHERE weight IS NOT NULL GROUP BY ALL)
    SELECT scheme, sector, round(w, 2) AS weight_pct, row_number() OVER (PARTITION BY scheme ORDER BY w DESC, f, sector) AS nth FROM s""")
def sector_totals(spark, sf):
    return facts.sector_totals(holdings(spark, sf), "scheme")


@query(HOLD_SQL + "SELECT scheme, company, weight, nth FROM (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY coalesce(weight, -1) DESC, pos) AS nth FROM h) WHERE nth <= 5")
def top5_per_group(spark, sf):
    return facts.top_holdings(holdings(spark, sf), "scheme").select("scheme", "company", "weight", "nth")


@query(HOLD_SQL + "SELECT scheme, count(*) AS holdings_count, arg_min(sector, pos) FILTER (WHERE sector IS NOT NULL) AS first_sector FROM h GROUP BY scheme")
def group_first_nonnull(spark, sf):
    first = F.min_by("sector", F.when(c("sector").isNotNull(), c("pos")))
    return holdings(spark, sf).groupBy("scheme").agg(F.count(F.lit(1)).alias("holdings_count"), first.alias("first_sector"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) > 1 AS historical FROM orders")
def version_history(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("on"))
    return facts.versions(rows, "o_custkey", "on", "o_orderkey").drop("on")


@query("WITH v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) > 1 AS historical FROM orders) SELECT o_custkey, count(*) FILTER (WHERE historical) AS n_historical FROM v GROUP BY 1")
def historical_counts(spark, sf):
    rows = facts.versions(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")
    return rows.groupBy("o_custkey").agg(F.count_if("historical").alias("n_historical"))


def payloads(spark, sf):
    """Page payloads as JSON, one for each supplier: its master data, its part types as holdings, its nation's history."""
    held = holdings(spark, sf).groupBy("scheme", "sector", "instrument").agg(F.max("weight").alias("weight"), F.min("pos").alias("pos"))
    lists = held.groupBy("scheme").agg(F.sort_array(F.collect_list(F.struct("pos", "sector", "instrument", "weight"))).alias("h"))
    rows = table(spark, sf, "supplier").join(lists, c("s_suppkey") == c("scheme"), "left").join(F.broadcast(table(spark, sf, "nation")), c("s_nationkey") == c("n_nationkey"))
    k = c("s_suppkey")
    day = F.format_string("20%02d-%02d-%02dT20:00:00.000Z", k % 20 + 5, k % 12 + 1, k % 28 + 1)
    payload = F.struct(
        F.concat(F.lit(" "), c("s_name"), F.lit("\n")).alias("scheme_name"),
        F.when(k % 3 == 0, "Regular").when(k % 3 == 1, "").alias("plan_type"),
        c("n_name").alias("category"),
        F.when(k % 2 == 0, "Cap").alias("sub_category"),
        F.round(c("s_acctbal"), 2).alias("nav"),
        day.alias("nav_date"),
        (k * 1000 + 113606).cast("double").alias("aum"),
        F.concat((k % 5).cast("string"), F.lit(".25")).alias("expense_ratio"),
        (k % 5 + 1).cast("int").alias("rating"),
        F.lit(100.0).alias("min_investment_amount"),
        F.when(k % 4 != 0, F.lit(250.5)).alias("min_sip_investment"),
        F.concat(F.lit("Exit load of "), k.cast("string"), F.lit("%.")).alias("exit_load"),
        F.lit("0.005%").alias("stamp_duty"),
        F.struct((k % 3).cast("int").alias("years"), F.lit(0).alias("months"), (k % 2).cast("int").alias("days")).alias("lock_in"),
        F.concat(F.lit("INDEX "), c("n_name")).alias("benchmark_name"),
        F.date_format(F.to_timestamp(F.regexp_replace(day, "T.*", "")), "dd-MMM-yyyy").alias("launch_date"),
        F.struct(F.lit("House One").alias("name"), F.lit(1234567.5).alias("aum")).alias("amc_info"),
        F.array(F.struct(F.lit("").alias("risk")), F.struct(F.when(k % 7 != 0, "High").alias("risk"))).alias("return_stats"),
        F.array(F.struct(F.lit("2013-01-01").alias("as_on_date"), F.lit("Nil").alias("note")), F.struct(F.lit("2015-05-08").alias("as_on_date"), F.lit("Exit load: 1%").alias("note"))).alias("historic_exit_loads"),
        F.array(F.struct(F.concat(F.lit("Manager "), k.cast("string")).alias("person_name"), day.alias("date_from"), F.when(k % 2 == 0, "MBA").alias("education")), F.struct(F.lit("").alias("person_name"), day.alias("date_from"), F.lit("x").alias("education"))).alias("fund_manager_details"),
        F.transform("h", lambda x: F.struct(F.concat_ws(" ", x["sector"], x["instrument"]).alias("company_name"), x["sector"].alias("sector_name"), F.lit("").alias("instrument_name"), x["instrument"].alias("nature_name"), x["weight"].alias("corpus_per"), F.lit("2024-03-31").alias("portfolio_date"))).alias("holdings"),
    )
    return rows.select(F.concat(F.lit("s"), k.cast("string")).alias("scheme_id"), k.alias("supplier"), F.to_json(payload).alias("payload"))


@query("""WITH b AS (SELECT s_suppkey AS k, s_name, n_name, s_acctbal AS nav FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    f AS (SELECT *, printf('%.2f', abs(nav)) AS s, make_date((2000 + k % 20 + 5)::INT, (k % 12 + 1)::INT, (k % 28 + 1)::INT) AS d FROM b),
    g AS (SELECT *, split_part(s, '.', 1) AS w, rtrim(split_part(s, '.', 2), '0') AS fr FROM f)
    SELECT 's' || k AS scheme_id, s_name AS scheme_name, CASE WHEN k % 3 = 0 THEN 'Regular' ELSE 'Direct' END AS plan_type, n_name || CASE WHEN k % 2 = 0 THEN ' Cap' ELSE '' END AS category,
      '₹' || CASE WHEN nav < 0 THEN '-' ELSE '' END || CASE WHEN length(w) > 3 THEN reverse(rtrim(regexp_replace(reverse(left(w, -3)), '(\\d{2})', '\\1,', 'g'), ',')) || ',' || right(w, 3) ELSE w END || CASE WHEN fr <> '' THEN '.' || fr ELSE '' END AS nav,
      strftime(d + INTERVAL 1 DAY, '%d %b %Y') AS nav_date, '₹12,34,567.5 Cr' AS amc_aum_total, (k % 5) || '.25%' AS expense_ratio, (k % 5 + 1)::INT AS rating,
      CASE WHEN k % 7 <> 0 THEN 'High' ELSE 'Not available' END AS risk_rating, CASE WHEN k % 4 <> 0 THEN '₹250.5' ELSE 'Not available' END AS min_sip, k || '%.' AS exit_load,
      '2015-05-08 1%, 2013-01-01 Nil' AS history,
      coalesce(nullif(concat_ws(' ', CASE WHEN k % 3 > 0 THEN (k % 3) || CASE WHEN k % 3 = 1 THEN ' year' ELSE ' years' END END, CASE WHEN k % 2 > 0 THEN '1 day' END), ''), 'None') AS lock_in,
      'INDEX ' || n_name AS benchmark, strftime(d, '%d-%b-%Y') AS scheme_launch_date, 'Manager ' || k || ' ' || strftime(d + INTERVAL 1 DAY, '%b %Y') AS managers FROM g""".replace("\\\\", "\\"))
def facts_projection(spark, sf):
    made = facts.facts(facts.parsed(payloads(spark, sf), "payload"))
    history = F.array_join(F.transform("exit_load_history", lambda h: F.concat_ws(" ", h["as_on_date"], h["note"])), ", ")
    managers = F.array_join(F.transform("fund_managers", lambda m: F.concat_ws(" ", m["name"], m["tenure_from"])), ", ")
    return made.select("scheme_id", "scheme_name", "plan_type", "category", "nav", "nav_date", "amc_aum_total", "expense_ratio", "rating", "risk_rating", "min_sip", "exit_load", history.alias("history"), "lock_in", "benchmark", "scheme_launch_date", managers.alias("managers"))


@query(HOLD_SQL + """, m AS (SELECT scheme, sector, instrument, max(weight) AS w, min(pos) AS pos FROM h GROUP BY ALL),
    t AS (SELECT scheme, sector, instrument, w, row_number() OVER (PARTITION BY scheme ORDER BY coalesce(w, -1) DESC, pos) AS nth FROM m),
    n AS (SELECT scheme, count(*) AS holdings_count FROM m GROUP BY scheme)
    SELECT 's' || scheme AS scheme_id, holdings_count::INT AS holdings_count, string_agg(concat_ws(' ', sector, instrument) || '|' || coalesce(sector, 'Unspecified') || '|' || instrument || '|' || coalesce(printf('%.2f%%', w), 'Not available'), ';' ORDER BY nth) AS top_lines
    FROM t JOIN n USING (scheme) WHERE nth <= 5 GROUP BY scheme, holdings_count""")
def facts_holdings(spark, sf):
    made = facts.facts(facts.parsed(payloads(spark, sf), "payload"))
    line = F.transform("top_holdings", lambda h: F.concat_ws("|", h["company"], h["sector"], h["instrument"], facts.weight_text(h["weight_pct"])))
    return made.where("holdings_count > 0").select("scheme_id", "holdings_count", F.array_join(line, ";").alias("top_lines"))


def fact_documents(spark, sf):
    made = facts.facts(facts.parsed(payloads(spark, sf), "payload"))
    url = F.concat(F.lit("https://facts.example/"), c("scheme_id"))
    keys = [r[0] for r in chunking.REGISTRY]
    as_map = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[c(k).cast("string") for k in keys]))
    return facts.documents(made.withColumn("source_url", url), facts.facts_lines(url)).withColumns({"facts": as_map, "doc_id": c("scheme_id")})


def _inr_sql(v: str) -> str:
    w, d = f"split_part(printf('%.2f', abs({v})), '.', 1)", f"rtrim(split_part(printf('%.2f', abs({v})), '.', 2), '0')"
    pairs = f"CASE WHEN length({w}) > 3 THEN reverse(rtrim(regexp_replace(reverse(left({w}, -3)), '(\\d{{2}})', '\\1,', 'g'), ',')) || ',' || right({w}, 3) ELSE {w} END"
    return f"('₹' || CASE WHEN {v} < 0 THEN '-' ELSE '' END || {pairs} || CASE WHEN {d} <> '' THEN '.' || {d} ELSE '' END)"


#: The suppliers' facts: what of them has a value, and their holdings and sectors in order.
FACTS_SQL = HOLD_SQL + f""", m AS (SELECT scheme, sector, instrument, max(weight) AS w, min(pos) AS pos FROM h GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY coalesce(w, -1) DESC, pos) AS nth, concat_ws(' ', sector, instrument) || ' | sector ' || coalesce(sector, 'Unspecified') || ' | instrument ' || instrument || ' | weight ' || coalesce(printf('%.2f%%', w), 'Not available') AS line FROM m),
    tops AS (SELECT scheme, list(line ORDER BY nth) AS tops FROM t WHERE nth <= 5 GROUP BY scheme),
    s AS (SELECT scheme, coalesce(sector, 'Unspecified') AS sector, sum(w) AS w, min(pos) AS first FROM m WHERE w IS NOT NULL GROUP BY ALL),
    sectors AS (SELECT scheme, list({{'sector': sector, 'weight': printf('%.2f%%', round(w, 2))}} ORDER BY w DESC, first) AS sectors FROM s GROUP BY scheme),
    n AS (SELECT scheme, count(*) AS held FROM m GROUP BY scheme),
    f AS (SELECT s_suppkey AS k, 's' || s_suppkey AS scheme_id, 'https://facts.example/s' || s_suppkey AS url, s_name AS name, n_name, make_date((2000 + s_suppkey % 20 + 5)::INT, (s_suppkey % 12 + 1)::INT, (s_suppkey % 28 + 1)::INT) AS d, CASE WHEN s_suppkey % 3 = 0 THEN 'Regular' ELSE 'Direct' END AS plan,
      n_name || CASE WHEN s_suppkey % 2 = 0 THEN ' Cap' ELSE '' END AS category, {_inr_sql("round(s_acctbal, 2)")} AS nav, {_inr_sql("(s_suppkey * 1000 + 113606)::DOUBLE")} || ' Cr' AS aum, (s_suppkey % 5) || '.25%' AS expense, (s_suppkey % 5 + 1) AS rating, CASE WHEN s_suppkey % 7 <> 0 THEN 'High' ELSE 'Not available' END AS risk,
      CASE WHEN s_suppkey % 4 <> 0 THEN '₹250.5' ELSE 'Not available' END AS min_sip, s_suppkey || '%.' AS exit_load, 'INDEX ' || n_name AS benchmark,
      coalesce(nullif(concat_ws(' ', CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 3) || CASE WHEN s_suppkey % 3 = 1 THEN ' year' ELSE ' years' END END, CASE WHEN s_suppkey % 2 > 0 THEN '1 day' END), ''), 'None') AS lock_in, coalesce(held, 0) AS held, coalesce(tops, []) AS tops, coalesce(sectors, []) AS sectors
      FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN n ON n.scheme = s_suppkey LEFT JOIN tops ON tops.scheme = s_suppkey LEFT JOIN sectors ON sectors.scheme = s_suppkey)"""
#: Their text, line by line.
FACT_LINES_SQL = """[name, '', 'Fund category: ' || category, 'Fund house: House One', 'Plan: ' || plan || ' Growth', 'Source page: ' || url, '', 'Overview', 'NAV: ' || nav || ' (as on ' || strftime(d + INTERVAL 1 DAY, '%d %b %Y') || ')', 'Fund size (AUM): ' || aum, 'Expense ratio: ' || expense, 'Rating: ' || rating || ' out of 5',
    'Risk rating: ' || risk, 'Fund benchmark: ' || benchmark, 'Scheme launch date: ' || strftime(d, '%d-%b-%Y'), 'Date of Incorporation of House One: Not available', 'Total AUM of House One (AMC level, not this fund): ₹12,34,567.5 Cr', '', 'Minimum investments', 'Min. for 1st investment: ₹100', 'Min. for 2nd investment: Not available', 'Min. for SIP: ' || min_sip,
    'Purchase multiplier: Not available', '', 'Exit load, stamp duty and tax', 'Exit load: ' || exit_load, 'Exit load effective 08 May 2015 (current): 1%', 'Exit load effective 01 Jan 2013 (historical): Nil', 'Stamp duty on investment: 0.005%', 'Tax implication: Not available', 'Lock-in period: ' || lock_in, '', 'Fund management',
    'Fund manager: Manager ' || k || ' (from ' || strftime(d + INTERVAL 1 DAY, '%b %Y') || ')', CASE WHEN k % 2 = 0 THEN 'Manager ' || k || ' education: MBA' END, '', 'About the scheme', 'Investment Objective: Not available', 'Category description: Not available', 'Custodian: Not available', 'Registrar & Transfer Agent: Not available', '', 'Holdings', 'Holdings count: ' || held,
    CASE WHEN held > 0 THEN 'Holdings as on: 31 Mar 2024' END]"""
FACT_TEXT_SQL = f"array_to_string(list_concat(list_filter({FACT_LINES_SQL}, lambda x: x IS NOT NULL), list_transform(tops, lambda x: 'Top holding: ' || x), list_transform(sectors, lambda x: 'Sector allocation: ' || x.sector || ' | weight ' || x.weight)), chr(10))"


@query(FACTS_SQL + f" SELECT scheme_id, {FACT_TEXT_SQL} AS text, sha256({FACT_TEXT_SQL}) AS text_sha256 FROM f")
def facts_text(spark, sf):
    return fact_documents(spark, sf).select("scheme_id", "text", "text_sha256")


@query("""WITH b AS (SELECT s_suppkey AS k FROM supplier), f AS (SELECT k, unnest([CASE WHEN k % 4 = 0 THEN 'min_sip missing' END, CASE WHEN k % 7 = 0 THEN 'risk_rating missing' END, 'custodian missing']) AS failure FROM b) SELECT 's' || k AS scheme_id, failure FROM f WHERE failure IS NOT NULL""")
def document_failures(spark, sf):
    return facts.document_failures(fact_documents(spark, sf))


#: A small registry over orders: field, section, label, value type, scope, is a fact, value pattern.
ORDER_REGISTRY = (("status", "order", "Order status", "enum", "fund", True, r"[A-Z]"), ("total", "order", "Total of {amc_name}", "currency", "amc", True, r"[\d.]+"), ("priority", "order", "Priority", "text", "fund", True, r"[^\n]+"), ("clerk", "order", "Clerk", "text", "fund", False, r"[^\n]+"))


def order_documents(spark, sf):
    """Orders as labelled texts, with a map of facts that is missing or different for some."""
    k = c("o_orderkey")
    text = F.concat(F.lit("Order status : "), c("o_orderstatus"), F.lit("\nTotal of House: "), F.format_string("%.2f", "o_totalprice"), F.lit("\npriority:  "), c("o_orderpriority"), F.lit(".\nend"))
    known = F.create_map(F.lit("status"), F.when(k % 3 != 0, c("o_orderstatus")), F.lit("total"), F.when(k % 5 == 0, F.lit("0")), F.lit("priority"), F.lit(None).cast("string"))
    return table(spark, sf, "orders").select(k.alias("scheme_id"), F.lit("House").alias("amc_name"), text.alias("text"), known.alias("facts"))


@query("""WITH r AS (SELECT o_orderkey AS scheme_id, 'status' AS field, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS from_facts, o_orderstatus AS from_text FROM orders
    UNION ALL SELECT o_orderkey, 'total', CASE WHEN o_orderkey % 5 = 0 THEN '0' END, printf('%.2f', o_totalprice) FROM orders
    UNION ALL SELECT o_orderkey, 'priority', NULL, o_orderpriority || '.' FROM orders UNION ALL SELECT o_orderkey, 'clerk', NULL, NULL FROM orders)
    SELECT *, coalesce(from_facts, from_text) AS value, coalesce(from_facts <> from_text, false) AS disagrees FROM r""")
def registry_cross_join(spark, sf):
    rows = chunking.registry_values(order_documents(spark, sf), ORDER_REGISTRY)
    return rows.select("scheme_id", "field", "from_facts", "from_text", "value", "disagrees")


@query("""SELECT o_orderkey AS scheme_id, 'status' AS field, 'O — Order status: ' || o_orderstatus || '.' AS body FROM orders
    UNION ALL SELECT o_orderkey, 'total', 'O — Total of House: AMC-level figure, not this scheme. ' || CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE printf('%.2f', o_totalprice) END || '.' FROM orders
    UNION ALL SELECT o_orderkey, 'priority', 'O — Priority: ' || o_orderpriority || '.' FROM orders""")
def fact_bodies(spark, sf):
    rows = chunking.registry_values(order_documents(spark, sf), ORDER_REGISTRY).where(facts.present(c("value")))
    return rows.select("scheme_id", "field", chunking.fact_body(F.lit("O"), c("label"), c("scope"), c("value")).alias("body"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.toxic IS NULL AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def dim_left_join(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), c("toxic").isNull().alias("unlabelled"))


GOLD_SQL = """WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS value FROM orders), r AS (SELECT o_orderkey, ' ' || o_orderstatus || ' ' AS got FROM orders WHERE o_orderkey % 89 <> 0),
    f AS (SELECT g.o_orderkey::VARCHAR AS key, CASE WHEN got IS NULL THEN 'missing' ELSE 'expected ' || value || ', got ' || got END AS detail FROM g LEFT JOIN r USING (o_orderkey) WHERE got IS NULL OR trim(got) <> value)"""


def _gold(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", c("o_orderstatus").alias("value"))
    gold = orders.withColumn("value", F.when(c("o_orderkey") % 97 == 0, "X").otherwise(c("value")))
    return quality.gold_mismatches(gold, orders.where("o_orderkey % 89 <> 0").withColumn("value", F.concat(F.lit(" "), c("value"), F.lit(" "))), ["o_orderkey"])


@query(GOLD_SQL + "SELECT 'gold' AS rule, key, detail FROM f")
def gold_mismatch(spark, sf):
    return _gold(spark, sf)


ORPHAN_SQL = "SELECT 'orphan' AS rule, l_orderkey::VARCHAR AS key, l_suppkey::VARCHAR AS detail FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"


def _orphans(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    return quality.orphans(lines, table(spark, sf, "supplier").where("s_acctbal > 0"), "l_suppkey", "s_suppkey", row_key="l_orderkey")


@query(ORPHAN_SQL)
def orphan_anti(spark, sf):
    return _orphans(spark, sf)


@query("""WITH a AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE text END AS text, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang FROM documents WHERE doc_id % 9 <> 0)
    SELECT doc_id, change FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'added' WHEN a.text IS DISTINCT FROM b.text THEN 'changed text' WHEN a.lang IS DISTINCT FROM b.lang THEN 'changed lang' END AS change
    FROM a FULL JOIN b ON a.doc_id = b.doc_id) WHERE change IS NOT NULL""")
def drift_full_outer(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    fresh = docs.where("doc_id % 9 <> 0").withColumns({"text": F.when(c("doc_id") % 7 == 0, "x").otherwise(c("text")), "lang": F.when(c("doc_id") % 11 != 0, c("lang"))})
    return quality.drift(docs.where("doc_id % 10 <> 0"), fresh, "doc_id", ["text", "lang"])


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def id_set_difference(spark, sf):
    return quality.id_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT 'unique' AS rule, sha256(text) AS key, count(*) || ' rows' AS detail FROM documents GROUP BY text HAVING count(*) > 1")
def key_uniqueness(spark, sf):
    return quality.repeated_keys(table(spark, sf, "documents").select(F.sha2("text", 256).alias("k")), "k")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n_distinct, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def distinct_per_field(spark, sf):
    return quality.distinct_values(table(spark, sf, "lineitem"), "l_returnflag", "l_partkey", c("l_linestatus") == "O")


MARKERS = ("MIT License", "All rights reserved")
MARKER_SQL = " UNION ALL ".join(f"SELECT 'noise' AS rule, doc_id::VARCHAR AS key, '{m}' AS detail FROM documents WHERE contains(text, '{m}')" for m in MARKERS)


@query(MARKER_SQL)
def noise_marker_audit(spark, sf):
    return quality.noisy(table(spark, sf, "documents"), "doc_id", "text", MARKERS)


@query("SELECT 'accepted' AS rule, event_id::VARCHAR AS key, event_type AS detail FROM events WHERE event_type NOT IN ('click', 'view')")
def accepted_values(spark, sf):
    return quality.outside(table(spark, sf, "events"), "event_id", "event_type", ["click", "view"])


@query(f"""{GOLD_SQL}, every AS (SELECT 'gold' AS rule FROM f UNION ALL SELECT rule FROM ({ORPHAN_SQL}) UNION ALL SELECT rule FROM ({MARKER_SQL})),
    rules AS (SELECT unnest(['gold', 'orphan', 'noise', 'unique']) AS rule)
    SELECT rules.rule, count(every.rule) AS failures, CASE WHEN count(every.rule) = 0 THEN 'ok' ELSE 'fail' END AS status FROM rules LEFT JOIN every USING (rule) GROUP BY rules.rule""")
def audit_summary(spark, sf):
    docs = table(spark, sf, "documents")
    found = quality.together([_gold(spark, sf), _orphans(spark, sf), quality.noisy(docs, "doc_id", "text", MARKERS), quality.repeated_keys(docs, "doc_id")])
    return quality.summary(found, ["gold", "orphan", "noise", "unique"])


@query("""WITH old AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, 'new' AS lang, source FROM documents WHERE doc_id % 2 = 0)
    SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new""")
def upsert_merge(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return store.upsert(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 2 = 0").withColumn("lang", F.lit("new")), ["doc_id"])


@query("""SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 6 = 1 OR doc_id % 10 = 3""")
def cache_validity(spark, sf):
    """Documents whose cached vector is missing, of another text or of another model."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    text = F.when(c("doc_id") % 6 == 1, "old").otherwise(c("text"))
    cached = docs.where("doc_id % 4 <> 0").select("doc_id", F.sha2(text, 256).alias("text_hash"), F.when(c("doc_id") % 10 == 3, "m0").otherwise("m1").alias("model"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    return store.stale(docs, cached, "doc_id", "text", "m1", 2).select("doc_id")


@query("SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, CASE WHEN l_linenumber = 3 THEN '' ELSE l_returnflag END AS flag, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem")
def store_records(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(c("l_linenumber") != 3, c("l_returnflag")).alias("flag"), c("l_shipdate").cast("date").alias("shipped"))
    return store.records(rows)


@query("SELECT source, count(*) AS n_chunks, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS langs FROM documents GROUP BY source")
def chunk_counts(spark, sf):
    rows = table(spark, sf, "documents").groupBy("source")
    return rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"), F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("langs"))


@query("SELECT bool_and(n_chars > 0) AS all_long, bool_or(contains(text, 'MIT License')) AS any_license, count(DISTINCT source) = 1 AS one_source, min(length(text)) AS shortest FROM documents")
def all_any_checks(spark, sf):
    return table(spark, sf, "documents").agg(F.bool_and(c("n_chars") > 0).alias("all_long"), F.bool_or(c("text").contains("MIT License")).alias("any_license"), (F.countDistinct("source") == 1).alias("one_source"), F.min(F.length("text")).alias("shortest"))


def _known_sql() -> str:
    """A struct for each registry rule in order, with the fact's value where there is one."""
    values = {
        "category": "category", "fund_house": "'House One'", "nav": "nav", "fund_aum": "aum", "expense_ratio": "expense", "rating": "rating::VARCHAR", "risk_rating": "risk", "benchmark": "benchmark", "scheme_launch_date": "strftime(d, '%d-%b-%Y')",
        "amc_aum_total": "'₹12,34,567.5 Cr'", "min_first_inv": "'₹100'", "min_sip": "min_sip", "exit_load": "exit_load", "stamp_duty": "'0.005%'", "lock_in": "lock_in", "holdings_count": "held::VARCHAR",
    }
    rules = [r for r in chunking.REGISTRY if r[0] in values]
    label = {r[0]: r[2].replace("{amc_name}", "House One") for r in rules}
    one = "{{'field': '{}', 'section': '{}', 'label': '{}', 'type': '{}', 'scope': '{}', 'fact': {}, 'value': {}}}"
    return "[" + ", ".join(one.format(r[0], r[1], label[r[0]], r[3], r[4], str(r[5]).lower(), values[r[0]]) for r in rules) + "]"


CHUNK_SQL = FACTS_SQL + f""", r AS (SELECT *, unnest({_known_sql()}) AS r FROM f), bodies AS (
    SELECT k, r.section AS section, r.field AS field, name || ' — ' || r.label || ': ' || CASE WHEN r.scope = 'amc' THEN 'AMC-level figure, not this scheme. ' ELSE '' END || r.value || CASE WHEN ends_with(r.value, '.') THEN '' ELSE '.' END AS text, r.value AS value, r.type AS value_type, r.scope AS scope, NULL::DATE AS effective_date, false AS historical, r.fact AS is_fact FROM r WHERE r.value <> 'Not available'
    UNION ALL SELECT k, 'fees_and_minimums', 'exit_load_historical', name || ' — historical exit load, effective 2013-01-01: Nil. Superseded, not the current exit load.', 'Nil', 'text', 'fund', DATE '2013-01-01', true, false FROM f
    UNION ALL SELECT k, 'portfolio', 'top_holding', name || ' — top holdings as on 31 Mar 2024: ' || array_to_string(tops, '; ') || '.', tops[1], 'table', 'fund', NULL, false, false FROM f WHERE len(tops) > 0
    UNION ALL SELECT k, 'portfolio', 'sector_allocation', name || ' — sector allocation: ' || array_to_string(list_transform(sectors, lambda x: x.sector || ' ' || x.weight), '; ') || '.', sectors[1].sector || ' ' || sectors[1].weight, 'table', 'fund', NULL, false, false FROM f WHERE len(sectors) > 0
    UNION ALL SELECT k, 'fund_management', 'fund_manager', name || ' — fund manager: Manager ' || k || ' (from ' || strftime(d + INTERVAL 1 DAY, '%b %Y') || ').' || CASE WHEN k % 2 = 0 THEN ' MBA' ELSE '' END, 'Manager ' || k, 'text', 'fund', NULL, false, false FROM f),
    chunks AS (SELECT scheme_id || '_' || section || '_' || field || '_0' AS chunk_id, scheme_id AS doc_id, scheme_id, section, field, text, name || ' (' || category || '). ' || text AS embed_input, url AS source_url, value, value_type, scope, effective_date, historical, is_fact, len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS token_count FROM bodies JOIN f USING (k))"""


WHOLE_SQL = FACTS_SQL + """ SELECT scheme_id, name AS scheme_name, plan AS plan_type, category, n_name AS category_raw, CASE WHEN k % 2 = 0 THEN 'Cap' ELSE '' END AS sub_category, CASE k % 3 WHEN 0 THEN 'Sub Sub' WHEN 1 THEN '' END AS sub_sub_category,
    CASE WHEN k % 3 = 1 THEN 'House Two' ELSE 'House One' END AS fund_house, nav, strftime(d + INTERVAL 1 DAY, '%d %b %Y') AS nav_date, aum AS fund_aum, '₹12,34,567.5 Cr' AS amc_aum_total, CASE WHEN k % 2 = 0 THEN '#' || k END AS amc_rank, expense AS expense_ratio,
    rating::INT AS rating, risk AS risk_rating, '₹100' AS min_first_inv, CASE WHEN k % 2 = 0 THEN '₹1,00,000' ELSE 'Not available' END AS min_additional_inv, min_sip, CASE WHEN k % 3 = 0 THEN '₹1' ELSE 'Not available' END AS sip_multiplier,
    CASE WHEN k % 5 = 0 THEN '₹0.25' ELSE 'Not available' END AS purchase_multiplier, CASE WHEN k % 4 = 0 THEN '₹1,000' ELSE 'Not available' END AS min_stp_in, exit_load, '2015-05-08 1%, 2013-01-01 Nil' AS exit_load_history, '0.005%' AS stamp_duty, lock_in, benchmark,
    CASE WHEN k % 2 = 0 THEN 'IDX ' || n_name ELSE 'Not available' END AS benchmark_short, strftime(d, '%d-%b-%Y') AS scheme_launch_date, CASE k % 3 WHEN 0 THEN '31 Dec 1999' WHEN 1 THEN 'long ago' ELSE 'Not available' END AS amc_incorporation_date, 'House One' AS amc_name,
    CASE WHEN k % 2 = 0 THEN 'Keeper ' || k ELSE 'Not available' END AS custodian, CASE WHEN k % 3 = 0 THEN 'Agent' ELSE 'their agent' END AS rta, CASE WHEN k % 4 <> 0 THEN 'Aims at ' || n_name ELSE 'Not available' END AS investment_objective, CASE WHEN k % 2 = 1 THEN 'Of many' ELSE 'Not available' END AS category_helper_text,
    CASE WHEN k % 5 = 0 THEN 'Taxed' ELSE 'see the law' END AS tax_note, held::INT AS holdings_count, CASE WHEN held > 0 THEN '31 Mar 2024' END AS holdings_portfolio_date, array_to_string(tops, '; ') AS top_holdings,
    array_to_string(list_transform(sectors, lambda x: x.sector || ' ' || x.weight), '; ') AS sector_allocation, 'Manager ' || k || '|' || strftime(d + INTERVAL 1 DAY, '%b %Y') || CASE WHEN k % 2 = 0 THEN '|MBA' ELSE '' END AS fund_managers, CASE WHEN k % 3 = 0 THEN 'Very High' ELSE 'Not available' END AS nfo_risk FROM f"""


@query(WHOLE_SQL)
def facts_whole(spark, sf):
    """Every column of the facts, each present, empty and missing by turns; lists as text."""
    k, lit = c("supplier"), F.lit

    def told(every: int, value, kind: str = "string", other=None):
        return F.when(k % every == 0, lit(value) if not hasattr(value, "cast") else value).otherwise(lit(other)).cast(kind)

    rows = facts.parsed(payloads(spark, sf), "payload")
    house = c("amc_info")
    rows = rows.withColumns(
        {
            "sub_sub_category": F.when(k % 3 == 0, " Sub\nSub ").when(k % 3 == 1, " "), "fund_house": F.when(k % 3 == 1, "House\r\nTwo ").when(k % 3 == 0, ""), "mini_additional_investment": told(2, 100000.0, "double"), "sip_multiplier": told(3, 1.0, "double"),
            "purchase_multiplier": told(5, 0.25, "double"), "stp_details": F.struct(told(4, 1000.0, "double").alias("stp_in_minimum_installment_amount")), "benchmark": told(2, F.regexp_replace("benchmark_name", "INDEX", "IDX"), other=" "),
            "amc_info": F.struct(house["name"].alias("name"), house["aum"].alias("aum"), told(2, F.concat(lit(" #"), k)).alias("rank"), F.when(k % 3 == 0, "1999-12-31").when(k % 3 == 1, " long ago ").alias("launch_date")),
            "rta_details": F.struct(told(2, F.concat(lit("Keeper "), k)).alias("custodian_name"), told(3, "Agent", other="").alias("rta_name")), "description": F.when(k % 4 != 0, F.concat(lit(" Aims\nat "), "category")),
            "category_info": F.struct(F.when(k % 2 == 1, "Of\nmany").alias("category_helper_text"), told(5, "Taxed", other="").alias("tax_impact")), "nfo_risk": told(3, "Very High"),
        }
    )
    made = facts.facts(rows, fallback_tax_note="see the law", fallback_rta="their agent")
    lists = {
        "exit_load_history": F.array_join(F.transform("exit_load_history", lambda h: F.concat_ws(" ", h["as_on_date"], h["note"])), ", "),
        "top_holdings": F.array_join(F.transform("top_holdings", lambda h: F.concat(h["company"], lit(" | sector "), h["sector"], lit(" | instrument "), h["instrument"], lit(" | weight "), facts.weight_text(h["weight_pct"]))), "; "),
        "sector_allocation": F.array_join(F.transform("sector_allocation", lambda x: F.concat(x["sector"], lit(" "), facts.weight_text(x["weight_pct"]))), "; "),
        "fund_managers": F.array_join(F.transform("fund_managers", lambda m: F.concat_ws("|", m["name"], m["tenure_from"], m["education"])), ", "),
    }
    return made.withColumns(lists)


@query(CHUNK_SQL + " SELECT * FROM chunks")
def chunk_families(spark, sf):
    """Chunks of the suppliers' documents, all five families, ids unique."""
    from factloom.plans.ingest import chunk_rows

    return chunk_rows(fact_documents(spark, sf))


@query(CHUNK_SQL + " SELECT chunk_id, scheme_id, section, field, value, token_count, 64 AS dim, 1.0 AS norm FROM chunks")
def ingest_pipeline(spark, sf):
    """Documents to stored chunks: audit gate, embedding, records; of a vector its length and norm."""
    from factloom.functions import vectors as V
    from factloom.plans.ingest import ingest

    made = ingest(fact_documents(spark, sf))
    return made.select("chunk_id", "scheme_id", "section", "field", "value", "token_count", F.size("embedding").alias("dim"), F.round(V.norm(c("embedding")), 4).alias("norm"))


#: What the log of a run tells, by its path in the entry, and how SQL finds it out from the documents and chunks.
LOGGED = {
    "n_documents": ("stage_summary.documents", "(SELECT count(*) FROM f)"), "n_lines": ("decision.total_lines", f"(SELECT sum(len(list_filter(string_split({FACT_TEXT_SQL}, chr(10)), lambda x: trim(x) <> ''))) FROM f)"),
    "n_chunks": ("stage_summary.chunks.n", "count(*)"), "tokens": ("stage_summary.chunks.tokens", "sum(token_count)"), "longest": ("stage_summary.chunks.longest", "max(token_count)"), "shortest": ("stage_summary.chunks.shortest", "min(token_count)"),
    "n_facts": ("stage_summary.chunks.facts", "count(*) FILTER (is_fact)"), "n_historical": ("stage_summary.chunks.historical", "count(*) FILTER (historical)"),
    **{f"n_{s}": (f"stage_summary.chunks_per_section.{s}", f"count(*) FILTER (section = '{s}')") for s in ("overview", "fees_and_minimums", "about", "portfolio", "fund_management")},
    "n_of_s5": ("stage_summary.chunks_per_scheme.s5", "count(*) FILTER (scheme_id = 's5')"), "n_vectors": ("stage_summary.vectors.n", "count(*)"), "dim": ("stage_summary.vectors.longest", "64"),
}


@query(CHUNK_SQL + " SELECT " + ", ".join(f"({sql})::BIGINT AS {n}" for n, (_, sql) in LOGGED.items()) + ", 1.0 AS least_norm, 1.0 AS most_norm, 'label_aware_recursive' AS selected, true AS in_time, true AS same_stored FROM chunks")
def ingest_run_log(spark, sf):
    """A whole ingest into a store, and what its log tells: figures that the writing tasks took, read back."""
    from factloom.config import Source
    from factloom.plans.ingest import ingest_run
    from factloom.session import shared_folder

    stored, log = shared_folder(spark, "stored"), shared_folder(spark, "run-log")
    began = time.monotonic()
    ingest_run(fact_documents(spark, sf), stored, log, Settings(sources=(Source("s5", "", "", ""),)))
    took = time.monotonic() - began

    def told(path: str):
        return F.get_json_object("value", f"$.{path}")

    norms = [F.round(told(f"stage_summary.vectors.{x}").cast("double"), 4).alias(x) for x in ("least_norm", "most_norm")]
    rows = spark.read.text(log).select(*[told(path).cast("long").alias(x) for x, (path, _) in LOGGED.items()], *norms, told("decision.selected").alias("selected"), told("duration_s").cast("double").between(0, took + 0.001).alias("in_time"))
    return rows.withColumn("same_stored", c("n_chunks") == spark.read.parquet(stored).count())


FIELDS_SQL = ", ".join(f"'{f}'" for f in [*(r[0] for r in REGISTRY), "exit_load_historical", "top_holding", "sector_allocation", "fund_manager"])


@query(CHUNK_SQL + f""", labelled AS (SELECT *, len(text) % 8 AS class, list_position([{FIELDS_SQL}], field) AS pos FROM chunks),
    merged AS (SELECT scheme_id, class, min(pos) AS pos, string_agg(text, ' ' ORDER BY pos) AS text, arg_min(section, pos) AS section, arg_min(value, pos) AS value, arg_min(doc_id, pos) AS doc_id, arg_min(source_url, pos) AS source_url FROM labelled GROUP BY scheme_id, class),
    numbered AS (SELECT merged.*, category, row_number() OVER (PARTITION BY scheme_id ORDER BY pos) - 1 AS nth FROM merged JOIN (SELECT DISTINCT scheme_id, category FROM f) USING (scheme_id))
    SELECT scheme_id || '_' || section || '_semantic_' || nth AS chunk_id, doc_id, section, 'semantic_cluster' AS field, text, scheme_id || ' (' || category || '). ' || text AS embed_input, source_url, value, 'prose' AS value_type, false AS is_fact, len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS token_count FROM numbered""")
def semantic_ingest(spark, sf):
    """Ingest with the semantic strategy; the embedder tells texts apart by their length, so that SQL can say what is merged."""
    from factloom.plans.ingest import ingest

    def by_length(text):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.char_length(text) % 8 == i).cast("float"))

    made = ingest(fact_documents(spark, sf), Settings(strategy="semantic", chunk_tokens=5000), embedder=by_length)
    return made.select("chunk_id", "doc_id", "section", "field", "text", "embed_input", "source_url", "value", "value_type", "is_fact", "token_count")


@query(CHUNK_SQL + """, stored AS (SELECT *, CASE WHEN scheme_id = 's5' AND field = 'nav' THEN 'other' ELSE text END AS kept, scheme_id = 's7' AND field = 'nav' AS doubled, CASE WHEN scheme_id = 's2' AND field = 'rating' THEN '9' ELSE value END AS told, field = 'expense_ratio' AND scheme_id = 's4' AS old FROM chunks WHERE NOT chunk_id LIKE 's3\\_fees%' ESCAPE '\\'),
    j AS (SELECT fresh.chunk_id, stored.chunk_id IS NULL AS lost, stored.kept <> fresh.text AS changed, coalesce(stored.doubled, false) AS doubled, stored.told <> fresh.value OR stored.old AS meta FROM chunks fresh LEFT JOIN stored USING (chunk_id)),
    faults AS (SELECT count(*) FILTER (lost OR changed OR meta) AS drift, count(*) FILTER (NOT lost AND meta) AS meta, count(*) FILTER (lost) AS lost, count(*) FILTER (doubled) AS doubled FROM j),
    u AS (SELECT unnest([{'rule': 'documents', 'n': 0}, {'rule': 'unique_documents', 'n': 0}, {'rule': 'text_hash', 'n': 0}, {'rule': 'chunk_drift', 'n': drift}, {'rule': 'metadata', 'n': meta}, {'rule': 'token_budget', 'n': 0}, {'rule': 'ids', 'n': lost}, {'rule': 'unit_vectors', 'n': doubled}, {'rule': 'vectors', 'n': lost + doubled}, {'rule': 'allowlist', 'n': 0}]) AS u FROM faults)
    SELECT u.rule AS rule, u.n AS failures, CASE WHEN u.n = 0 THEN 'ok' ELSE 'fail' END AS status FROM u""")
def verify_store(spark, sf):
    """A store with planted faults against its documents: changed texts and values, vanished chunks, moved vectors."""
    from factloom.plans.ingest import ingest
    from factloom.plans.verify import verify
    from factloom.session import staged

    docs = staged(fact_documents(spark, sf), "documents")
    stored = ingest(docs).where(~c("chunk_id").like("s3\\_fees%"))

    def planted(scheme: str, field: str):
        return (c("scheme_id") == scheme) & (c("field") == field)

    moved = F.transform("embedding", lambda x: (x * 2).cast("float"))
    stored = stored.withColumns(
        {
            "text": F.when(planted("s5", "nav"), "other").otherwise(c("text")),
            "value": F.when(planted("s2", "rating"), "9").otherwise(c("value")),
            "historical": planted("s4", "expense_ratio") | c("historical"),
            "embedding": F.when(planted("s7", "nav"), moved).otherwise(c("embedding")),
        }
    )
    return verify(docs, stored, docs.select(c("source_url").alias("url")))
