"""Queries of text, page and format functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalogue import query
from factloom.config import Settings
from factloom.functions import formats as fmt
from factloom.functions import text as T
from factloom.operators import chunking, store
from factloom.session import table
from factloom.sources import pages as P

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
URL_SQL = r"""
    CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
      lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
      CASE lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))
        WHEN 'https' THEN regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':443$', '')
        WHEN 'http' THEN regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':80$', '')
        ELSE lower(regexp_extract(url, '://([^/?#]*)', 1)) END ||
      regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') END"""
NORMAL_SQL = STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '\r\n?', chr(10), 'g'), '–—’' || chr(160), '--'' '), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT page_id, {URL_SQL} AS url_norm FROM pages")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalized_url(F.col("url")).alias("url_norm"))


@query(f"WITH n AS (SELECT page_id, {URL_SQL} AS u FROM pages) SELECT page_id FROM n WHERE u IN (SELECT u FROM n WHERE page_id % 2 = 0)")
def url_allowlist(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return P.allowed(pages, pages.where("page_id % 2 = 0")).select("page_id")


@query(f"WITH n AS (SELECT page_id, {URL_SQL} AS url_norm FROM pages) SELECT url_norm, count(*) AS n_pages, min(page_id) AS first_page FROM n GROUP BY url_norm")
def url_groups(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", T.normalized_url(F.col("url")).alias("url_norm"))
    return pages.groupBy("url_norm").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


def _tag_text_sql() -> str:
    sql = "html"
    for tag in ("script", "style", *P.DROPPED):
        sql = f"regexp_replace({sql}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}>', ' ', 'g')"
    sql = f"regexp_replace(regexp_replace({sql}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for code, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        sql = f"replace({sql}, '{code}', '{char}')"
    return STRIP.format(f"regexp_replace({sql}, '\\s+', ' ', 'g')")


@query(f"WITH t AS (SELECT page_id, {_tag_text_sql()} AS x FROM pages) SELECT page_id, length(x) AS n_chars, sha256(x) AS text_sha256 FROM t")
def html_main_text(spark, sf):
    text = P.tag_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", text.alias("x")).select("page_id", F.length("x").alias("n_chars"), F.sha2("x", 256).alias("text_sha256"))


@query(f"WITH t AS (SELECT page_id, {_tag_text_sql()} AS x FROM pages), d AS (SELECT page_id, CASE WHEN length(x) >= 1500 THEN x END AS text FROM t) SELECT page_id, text, length(text) AS n_chars FROM d")
def html_dom_text(spark, sf):
    """Tag text where it is long enough, else the DOM's; no page here has a division of that length, so the rest have none."""
    return table(spark, sf, "pages").select("page_id", P.main_text(F.col("html"), P.tag_text, 1500).alias("text")).select("page_id", "text", F.length("text").alias("n_chars"))


SELECTED = Settings(min_text_chars=1, drop_selectors=("nav", "footer", "div.ad", "head > title", "[id*='none' i", "article > h1"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav>.*?</nav>|<footer>.*?</footer>|<div class="ad">.*?</div>|<title>.*?</title>|<h1>.*?</h1>', '<x>', 'g') AS h FROM pages),
    t AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(h, '(?s)<!--.*?-->|<[^>]*>'), lambda x: regexp_replace(regexp_replace(replace(replace(replace(replace(replace(x, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS parts FROM p)
    SELECT page_id, nullif(array_to_string(parts, chr(10)), '') AS text FROM t""")
def html_selected_text(spark, sf):
    """The DOM's text with selectors from settings: tags, a class, children, and one that is no selector."""
    return table(spark, sf, "pages").select("page_id", P.main_text(F.col("html"), None, SELECTED.min_text_chars, SELECTED.drop_selectors).alias("text"))


@query("WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 4 THEN html WHEN page_id % 5 = 3 THEN '<script id=\"__NEXT_DATA__\" type=\"application/json\">{broken</script>' || html ELSE '' END AS h, page_id % 5 AS k, url FROM pages) SELECT page_id, CASE WHEN k < 3 THEN url END AS payload_url FROM p")
def html_payload(spark, sf):
    """The embedded payload of pages that get one here (two of five have none or a broken one)."""
    pages = table(spark, sf, "pages")
    data = F.to_json(F.struct(F.struct(F.struct(F.struct(F.col("url").alias("link")).alias("mfServerSideData")).alias("pageProps")).alias("props")))
    script = F.when(F.col("page_id") % 5 == 4, F.lit("")).when(F.col("page_id") % 5 == 3, F.lit('<script id="__NEXT_DATA__" type="application/json">{broken</script>')).otherwise(F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>")))
    return pages.select("page_id", F.get_json_object(P.payload(F.concat(script, F.col("html"))), "$.link").alias("payload_url"))


@query(r"""SELECT page_id, len(regexp_extract_all(t, 'https?://[^\s)\]}>"'']+')) AS n_urls, coalesce(array_to_string(regexp_extract_all(t, 'https?://[^\s)\]}>"'']+'), ' '), '') AS urls
    FROM (SELECT page_id, 'See ' || url || ' (and ' || url || '/x).' AS t FROM pages)""")
def url_extract(spark, sf):
    text = F.concat(F.lit("See "), F.col("url"), F.lit(" (and "), F.col("url"), F.lit("/x)."))
    return table(spark, sf, "pages").select("page_id", F.size(T.urls(text)).alias("n_urls"), F.array_join(T.urls(text), " ").alias("urls"))


@query(f"SELECT doc_id, sha256({NORMAL_SQL}) AS text_sha256, length({NORMAL_SQL}) AS n_chars FROM documents")
def text_normalize(spark, sf):
    text = T.normalized(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.length(text).alias("n_chars"))


@query("SELECT doc_id, sha256(" + STRIP.format("replace(replace(text, chr(13), ''), chr(10), ' ')") + ") AS clean_sha256 FROM documents")
def text_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.cleaned(F.col("text")), 256).alias("clean_sha256"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS low_sha256 FROM documents")
def text_collapse_lower(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.lowered(F.col("text")), 256).alias("low_sha256"))


@query("""WITH r AS (SELECT sha256(doc_id::VARCHAR || chr(10) || coalesce(text, '')) AS h FROM documents)
    SELECT sha256(concat_ws(',', 'model-1', count(*)::VARCHAR, sum(('0x' || substr(h, 1, 15))::UBIGINT::HUGEINT)::VARCHAR, sum(('0x' || substr(h, 16, 15))::UBIGINT::HUGEINT)::VARCHAR, sum(('0x' || substr(h, 31, 15))::UBIGINT::HUGEINT)::VARCHAR, sum(('0x' || substr(h, 46, 15))::UBIGINT::HUGEINT)::VARCHAR)) AS fingerprint FROM r""")
def corpus_fingerprint(spark, sf):
    return store.fingerprint(table(spark, sf, "documents"), "doc_id", "text", "model-1")


@query("SELECT sha256('m' || string_agg(s_suppkey::VARCHAR || s_name, '' ORDER BY s_suppkey::VARCHAR)) AS fingerprint FROM supplier")
def manifest_fingerprint(spark, sf):
    return store.ordered_fingerprint(table(spark, sf, "supplier"), "s_suppkey", "s_name", "m")


STATS_SQL = r"""
    WITH l AS (SELECT doc_id, text, len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) AS lines,
      len(regexp_extract_all(text, '(?m)^[A-Z][^\n:]{2,60}\s*:\s*\S')) AS labelled FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Fund house: x' || chr(10) || text ELSE text END AS text FROM documents)),
    s AS (SELECT count(*) AS doc_count, round_even(avg(length(text)), 1) AS mean_doc_chars, sum(lines)::BIGINT AS total_lines, sum(labelled)::BIGINT AS labelled_lines, round_even(sum(labelled) / sum(lines), 4) AS labelled_line_ratio FROM l)"""


def _labelled(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Fund house: x\n"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


@query(STATS_SQL + "SELECT * FROM s")
def corpus_stats(spark, sf):
    return chunking.corpus_stats(_labelled(spark, sf))


@query(STATS_SQL + "SELECT s.*, labelled_line_ratio > 0.15 AS r1, doc_count <= 10 AND mean_doc_chars <= 60000 AS r2, labelled_line_ratio > 0.15 AS r3, true AS r4, 'label_aware_recursive' AS selected FROM s")
def strategy_decision(spark, sf):
    from factloom.config import Settings

    return chunking.strategy(chunking.corpus_stats(_labelled(spark, sf)), Settings())


@query("SELECT avg(CASE WHEN lang <> 'de' THEN 1.0 ELSE 0.0 END) AS ratio FROM documents")
def single_fact_ratio(spark, sf):
    rows = table(spark, sf, "documents").select(F.when(F.col("lang") != "de", F.col("lang")).otherwise("").alias("field"))
    return chunking.single_fact_ratio(rows)


@query(f"SELECT doc_id, length({NORMAL_SQL}) AS n_chars FROM documents WHERE length({NORMAL_SQL}) >= 1500")
def min_length_filter(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.length(T.normalized(F.col("text"))).alias("n_chars"))
    return rows.where(F.col("n_chars") >= 1500)


NOISE_TEXT_SQL = "CASE WHEN page_id % 2 = 0 THEN 'a' || chr(10) || 'Return calculator' || chr(10) || left(html, (100 + page_id % 500)::INT) || repeat(chr(10), 3) || html ELSE html END"


@query(f"""WITH t AS (SELECT page_id, regexp_replace({NOISE_TEXT_SQL}, '\\r\\n?', chr(10), 'g') AS x FROM pages),
    a AS (SELECT page_id, CASE WHEN page_id % 2 = 0 AND position(chr(10) || chr(10) IN x) - position('Return calculator' IN x) - 17 BETWEEN 0 AND 400
      THEN left(x, (position('Return calculator' IN x) - 1)::INT) || substr(x, position(chr(10) || chr(10) IN x)) ELSE x END AS x FROM t)
    SELECT page_id, sha256({STRIP.format("regexp_replace(x, '\\n{3,}', chr(10) || chr(10), 'g')")}) AS text_sha256 FROM a""")
def noise_strip(spark, sf):
    """Noise blocks of pages' whole source; every second page gets one before it, some longer than the window."""
    block = F.concat(F.lit("a\nReturn calculator\n"), F.expr("left(html, cast(100 + page_id % 500 as int))"), F.lit("\n\n\n"), F.col("html"))
    text = F.when(F.col("page_id") % 2 == 0, block).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.sha2(T.without_noise(text), 256).alias("text_sha256"))


TOKEN_SQL = r"'₹\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?%|\d{1,2}-[A-Za-z]{3}-\d{4}|\d{4}-\d{2}-\d{2}|\d[\d,]*(?:\.\d+)?\s?(?:Cr|crore|crores|BPS|bps)|\b\d[\d,]*(?:\.\d+)?\b'"


@query(f"""WITH t AS (SELECT o_orderkey, 'Paid ₹' || printf('%.2f', o_totalprice) || ' or ' || (o_orderkey % 100) || '.5 % on ' || strftime(o_orderdate, '%d-%b-%Y') || ', due ' || strftime(o_orderdate, '%Y-%m-%d') || ', ' || o_custkey || ' Cr. See https://x.example/' || o_orderkey || '?a=12 now' || chr(10) || 'last updated FROM sources: 2024-01-02' AS x FROM orders)
    SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(x, 'https?://[^\\s)\\]}}>"'']+', ' ', 'g'), '(?i)Last updated from sources:[^\\n]*', ' ', 'g'), {TOKEN_SQL}), lambda y: trim(y)), '|') AS tokens FROM t""")
def fact_tokens(spark, sf):
    c = F.col
    text = F.concat(F.lit("Paid ₹"), F.format_string("%.2f", "o_totalprice"), F.lit(" or "), (c("o_orderkey") % 100).cast("string"), F.lit(".5 % on "), F.date_format("o_orderdate", "dd-MMM-yyyy"), F.lit(", due "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", "), c("o_custkey").cast("string"), F.lit(" Cr. See https://x.example/"), c("o_orderkey").cast("string"), F.lit("?a=12 now\nlast updated FROM sources: 2024-01-02"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(T.fact_tokens(text), "|").alias("tokens"))


@query(r"""WITH m AS (SELECT doc_id, """ + STRIP.format(r"""regexp_replace(text, 'https?://[^\s)\]}>"'']+', ' ', 'g')""") + r""" AS t FROM documents)
    SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE 1 + len(regexp_extract_all(t, '[.!?]\s+[A-Z"''(\[]')) END AS n_sentences FROM m""")
def sentence_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sentence_count(F.col("text")).alias("n_sentences"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\w+|[^\w\s]')) AS n_tokens FROM documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query(r"SELECT doc_id, n_tokens FROM (SELECT doc_id, len(regexp_extract_all(text, '\w+|[^\w\s]')) AS n_tokens FROM documents) WHERE n_tokens > 230")
def token_budget_audit(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))
    return store.too_long(rows, "doc_id", "n_tokens", 230)


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\w+|[^\w\s]') AS t FROM documents),
    s AS (SELECT doc_id, t, unnest(generate_series(0, greatest(len(t) - 41, 0), 160)) AS a FROM w)
    SELECT doc_id, (a // 160)::INT AS nth, len(t[a + 1 : a + 200])::INT AS n, sha256(array_to_string(t[a + 1 : a + 200], ' ')) AS text_sha256 FROM s""")
def token_windows(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(chunking.windows(F.col("text"))).alias("w"))
    return rows.select("doc_id", "w.nth", "w.n", F.sha2("w.text", 256).alias("text_sha256"))


@query(r"""WITH i AS (SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN repeat(chr(10) || ' ', (doc_id % 5)::INT) || chr(160) WHEN 4 THEN ' .' ELSE text END AS t FROM documents)
    SELECT 'blank_input' AS rule, doc_id::VARCHAR AS key, coalesce(length(t), 0) || ' blank characters' AS detail FROM i WHERE coalesce(regexp_matches(t, '^[\s\x{A0}]*$'), true)""")
def blank_inputs(spark, sf):
    """Inputs of the embedder that the gate refuses: planted null, empty and blank ones among all documents."""
    from factloom.operators import quality

    place = F.col("doc_id") % 9
    spaces = F.concat(F.repeat(F.lit("\n "), (F.col("doc_id") % 5).cast("int")), F.lit("\u00a0"))
    text = F.when(place == 1, None).when(place == 2, "").when(place == 3, spaces).when(place == 4, " .").otherwise(F.col("text"))
    return quality.blank(table(spark, sf, "documents").withColumn("input", text), "doc_id", "input")


@query()
def prose_pieces(spark, sf):
    """The exact recursive splitter over whole documents."""
    from factloom.config import Settings

    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.pieces(F.coalesce("text", F.lit("")), Settings())).alias("nth", "piece"))
    return rows.select("doc_id", "nth", T.token_count(F.col("piece")).alias("n_tokens"), F.sha2("piece", 256).alias("piece_sha256"))


@query("""SELECT doc_id, source || '_' || lang || '_' || (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1) AS chunk_id, sha256('Doc ' || doc_id || ' (' || lang || '). ' || text) AS embed_input_sha256 FROM documents""")
def chunk_ids(spark, sf):
    """Keys numbered within source and language, groups of any size, and a digest of the whole embedding input."""
    made = F.sha2(F.format_string("%s (%s). %s", F.concat(F.lit("Doc "), F.col("doc_id")), "lang", "text"), 256)
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", made.alias("embed_input_sha256"))
    return chunking.numbered(rows, ["source", "lang"], ["doc_id"]).select("doc_id", F.concat_ws("_", "source", "lang", "nth").alias("chunk_id"), "embed_input_sha256")


@query("""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders), p AS (SELECT o_orderkey, v, printf('%.2f', abs(v)) AS s FROM f),
    q AS (SELECT o_orderkey, v, split_part(s, '.', 1) AS w, rtrim(split_part(s, '.', 2), '0') AS d FROM p)
    SELECT o_orderkey, '₹' || CASE WHEN v < 0 THEN '-' ELSE '' END ||
      CASE WHEN length(w) > 3 THEN reverse(rtrim(regexp_replace(reverse(left(w, -3)), '(\\d{2})', '\\1,', 'g'), ',')) || ',' || right(w, 3) ELSE w END ||
      CASE WHEN d <> '' THEN '.' || d ELSE '' END || ' Cr' AS amount FROM q""".replace("\\\\", "\\"))
def inr_format(spark, sf):
    value = F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", fmt.inr(value, " Cr").alias("amount"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'Not available' ELSE (l_quantity::INT)::VARCHAR || '%' END AS pct FROM lineitem")
def percent_format(spark, sf):
    n = F.col("l_quantity").cast("int").cast("string")
    value = F.when(F.col("l_linenumber") == 2, F.concat(n, F.lit("% "))).when(F.col("l_linenumber") > 2, n)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fmt.percent(value).alias("pct"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%d-%b-%Y') WHEN 1 THEN 'soon' ELSE strftime(date_trunc('second', ts) + INTERVAL 330 MINUTE, '%d %b %Y') END AS day, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%d-%b-%Y') WHEN 1 THEN 'soon' ELSE strftime(date_trunc('second', ts) + INTERVAL 330 MINUTE, '%b %Y') END AS month FROM events")
def date_format_ist(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    value = F.when(k == 0, F.date_format("ts", "dd-MMM-yyyy")).when(k == 1, "soon").when(k == 2, F.concat(iso, F.lit("Z"))).otherwise(iso)
    return table(spark, sf, "events").select("event_id", fmt.day(value).alias("day"), fmt.month(value).alias("month"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 3 THEN (o_orderdate + INTERVAL 330 MINUTE)::DATE ELSE o_orderdate::DATE END AS parsed FROM orders")
def date_parse_cascade(spark, sf):
    k = F.col("o_orderkey") % 5
    value = (
        F.when(k == 0, F.date_format("o_orderdate", "dd MMM yyyy")).when(k == 1, F.date_format("o_orderdate", "dd-MMM-yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 3, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise("some day")
    )
    return table(spark, sf, "orders").select("o_orderkey", fmt.parsed_date(value).alias("parsed"))


@query("""SELECT p_partkey, coalesce(nullif(concat_ws(' ', CASE WHEN p_size % 3 > 0 THEN (p_size % 3) || CASE WHEN p_size % 3 = 1 THEN ' year' ELSE ' years' END END,
    CASE WHEN p_size % 4 > 0 THEN (p_size % 4) || CASE WHEN p_size % 4 = 1 THEN ' month' ELSE ' months' END END,
    CASE WHEN p_size % 5 > 0 THEN (p_size % 5) || CASE WHEN p_size % 5 = 1 THEN ' day' ELSE ' days' END END), ''), 'None') AS lock_in FROM part""")
def lock_in_format(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", fmt.lock_in(size % 3, size % 4, size % 5).alias("lock_in"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'Not available' WHEN 2 THEN 'Nil' ELSE 'Exit load:' END AS exit_load FROM orders""")
def exit_load_clean(spark, sf):
    k = F.col("o_orderkey") % 4
    value = F.when(k == 0, F.concat(F.lit("Exit load of "), F.col("o_orderpriority"), F.lit("\r\n"))).when(k == 2, "EXIT LOAD for units in - Nil").when(k == 3, "Exit load:")
    return table(spark, sf, "orders").select("o_orderkey", T.without_exit_load_label(value).alias("exit_load"))


@query("SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*$') AS slug, regexp_matches(replace(p_name, ' ', '_'), '^[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*$') AS underscored FROM part")
def slug_check(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.is_slug(F.col("p_name")).alias("slug"), T.is_slug(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("underscored"))


@query("SELECT o_orderkey, o_orderdate::DATE AS updated FROM orders")
def last_updated(spark, sf):
    text = F.concat(F.lit("A load of 1%.\nLast Updated from sources:  "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", T.last_updated(text).alias("updated"))


@query("SELECT o_orderkey, round_even(o_orderkey / 8.0, 2) AS to_2, round_even(o_orderkey / 2.0, 0) AS to_0 FROM orders")
def half_even_rounding(spark, sf):
    """Every second value is a tie, which goes to the even digit."""
    n = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.bround(n / 8.0, 2).alias("to_2"), F.bround(n / 2.0, 0).alias("to_0"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, make_date((2000 + doc_id % 20)::INT, 2, 3) AS on_day, sha256(text) AS text_sha256, doc_id % 3 = 0 AS null_kept FROM documents")
def json_lines_round_trip(spark, sf):
    """Documents as line-delimited JSON, written and read back; null fields keep their keys."""
    from factloom.session import shared_folder

    rows = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.make_date((F.lit(2000) + F.col("doc_id") % 20).cast("int"), F.lit(2), F.lit(3)).alias("on_day"), "text")
    path = shared_folder(spark, "json-lines")
    P.write_json_lines(rows, path)
    lines = spark.read.text(path).select(F.from_json("value", "doc_id long, lang string, on_day date, text string").alias("r"), F.col("value").contains('"lang":null').alias("null_kept"))
    return lines.select("r.doc_id", "r.lang", "r.on_day", F.sha2("r.text", 256).alias("text_sha256"), "null_kept")


@query("""SELECT 'c' || doc_id AS chunk_id, CASE WHEN doc_id % 3 <> 0 THEN 'stored' ELSE source END AS doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'nav' ELSE lang END AS field, CASE WHEN doc_id % 3 <> 0 THEN '1' WHEN doc_id % 2 = 0 THEN NULL ELSE 'v' END AS value,
    CASE WHEN doc_id % 3 <> 0 THEN 'int' ELSE 'text' END AS value_type, CASE WHEN doc_id % 3 <> 0 THEN 'amc' ELSE 'fund' END AS scope, doc_id % 3 <> 0 AS is_fact, sha256(CASE WHEN doc_id % 3 <> 0 THEN 'row ' ELSE '' END || text) AS text_sha256 FROM documents""")
def chunk_rebuild(spark, sf):
    """Search hits as chunks: from the stored row for two of three, else from metadata and defaults."""
    docs = table(spark, sf, "documents")
    key = F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id")
    hits = docs.select(key, F.col("source").alias("scheme_id"), F.col("lang").alias("field"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("v").alias("value"), "text")
    rows = docs.where("doc_id % 3 <> 0").select(key, F.lit("stored").alias("doc_id"), F.lit("nav").alias("field"), F.lit("1").alias("value"), F.lit("int").alias("value_type"), F.lit("amc").alias("scope"), F.lit(True).alias("is_fact"), F.concat(F.lit("row "), "text").alias("text"))
    made = store.chunks_from_metadata(hits, rows)
    return made.select("chunk_id", "doc_id", "field", "value", "value_type", "scope", "is_fact", F.sha2("text", 256).alias("text_sha256"))
