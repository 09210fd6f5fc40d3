"""Queries of guards, resolution, conversation state and answer checks over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalogue import query
from factloom.config import Settings, Source
from factloom.functions import text as T
from factloom.operators import answer, guards, history, resolve, validate
from factloom.session import staged, table

c = F.col

SOURCES = (
    Source("alpha_large_cap", "Large Cap", "Alpha Large Cap Fund Direct Growth", "https://facts.example/alpha-large-cap"),
    Source("alpha_flexi_cap", "Flexi Cap", "Alpha Flexi Cap Fund Direct Growth", "https://facts.example/alpha-flexi-cap"),
    Source("alpha_balanced", "Balanced Advantage", "Alpha Balanced Advantage Fund Direct Growth", "https://facts.example/alpha-balanced"),
)
SETTINGS = Settings(sources=SOURCES)
ALIASES = {
    "alpha_large_cap": ["large cap", "alpha large cap fund", "largecap fund"],
    "alpha_flexi_cap": ["flexi cap", "equity fund", "alpha equity fund"],
    "alpha_balanced": ["balanced advantage", "balanced", "balanced advantage fund"],
    "beta_small_cap": ["small cap"],
}
IN_SCOPE = [s.scheme_id for s in SOURCES]

#: What a user turn is led by, so that every rule has turns that it hits and turns that it misses.
LEADS = (
    "", "Should I buy the Large  Cap fund?", "What is the exit load of balanced advantage fund and large cap?", "my pan is ABCDE1234F", "mail me at a.b@x-y.org please", "Will it give good returns in 5 years?", "call 9876543210 now",
    "What about the SBI fund?", "alpha equity fund nav", "Is it a good time to invest in flexi cap?", "compare returns of balanced and equity fund", "folio no: 123456", "What should I know about small cap?", "aadhaar number 2345 6789 0123", "otp is 4321",
    "id 12345678 or 123456789", "an elss scheme", "which of these funds is worth it", "how much will it earn", "balanced", "tell me more",
)


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


LEAD_SQL = f"([{', '.join(map(_sql_text, LEADS))}])[(conv_id * 7 + turn) % {len(LEADS)} + 1]"
QUESTION_SQL = f"""SELECT conv_id, turn, role, text, CASE WHEN turn % 3 = 0 THEN {LEAD_SQL} ELSE {LEAD_SQL} || ' ' || text END AS question FROM conversations"""
LOW_SQL = "lower(trim(regexp_replace(question, '\\s+', ' ', 'g')))"


def turns(spark, sf):
    return led(table(spark, sf, "conversations"))


def led(rows):
    lead = F.get(F.array(*map(F.lit, LEADS)), ((c("conv_id") * 7 + c("turn")) % len(LEADS)).cast("int"))
    return rows.withColumn("question", F.when(c("turn") % 3 == 0, lead).otherwise(F.concat(lead, F.lit(" "), c("text"))))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def pii_sql(column: str, of: str = "'{kind}'") -> str:
    """``of`` for the first pattern in order that the column has, else null."""
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{_re2(p)}') THEN " + of.replace("{kind}", kind).replace("{hit}", f"regexp_extract({column}, '{_re2(p)}')") for kind, p in guards.PII) + " END"


@query(f"SELECT doc_id, {pii_sql('text')} AS kind FROM documents WHERE {pii_sql('text')} IS NOT NULL")
def pii_documents(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", guards.pii(c("text"))["kind"].alias("kind"))
    return rows.where("kind is not null")


@query(f"WITH t AS ({QUESTION_SQL}) SELECT conv_id, turn, {pii_sql('question')} AS kind, ({pii_sql('question', 'strpos(question, {hit}) - 1')})::INT AS start_at, ({pii_sql('question', 'strpos(question, {hit}) - 1 + length({hit})')})::INT AS end_at FROM t")
def pii_detect(spark, sf):
    hit = guards.pii(c("question"))
    return turns(spark, sf).select("conv_id", "turn", hit["kind"].alias("kind"), hit["start"].alias("start_at"), hit["end"].alias("end_at"))


@query(f"WITH t AS ({QUESTION_SQL}) SELECT conv_id, turn, CASE WHEN {pii_sql('question')} IS NULL THEN question ELSE '[redacted: personal identifier]' END AS question FROM t")
def pii_redact(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", guards.redacted(c("question")).alias("question"))


def _any_sql(patterns) -> str:
    return _re2("|".join(f"(?:{p})" for p in patterns))


FOREIGN_SQL = "CASE " + " ".join(f"WHEN regexp_matches({LOW_SQL}, '(^|[^\\pL\\pN_]){n}([^\\pL\\pN_]|$)') THEN '{n}'" for n in guards.FOREIGN) + " END"
ADVICE_SQL = f"regexp_matches({LOW_SQL}, '{_any_sql(guards.ADVICE)}')"
PERFORMANCE_SQL = f"regexp_matches({LOW_SQL}, '{_any_sql((*guards.PERFORMANCE, *guards.PERFORMANCE_PATTERNS))}')"
INTENT_SQL = f"CASE WHEN {FOREIGN_SQL} IS NOT NULL THEN 'out_of_scope' WHEN regexp_matches({LOW_SQL}, '{_any_sql(guards.ADVICE_SIGNALS)}') THEN 'advice' WHEN regexp_matches({LOW_SQL}, '{_any_sql(guards.PERFORMANCE_SIGNALS)}') THEN 'performance' ELSE 'factual' END"
RULES_SQL = f"rules AS (SELECT *, {ADVICE_SQL} AS advice, {PERFORMANCE_SQL} AS performance, {FOREIGN_SQL} AS foreign_name, {INTENT_SQL} AS intent, {pii_sql('question')} AS kind FROM t)"


@query(f"WITH t AS ({QUESTION_SQL}), {RULES_SQL} SELECT conv_id, turn, advice, performance, foreign_name, intent FROM rules")
def intent_rules(spark, sf):
    q = c("question")
    return turns(spark, sf).select("conv_id", "turn", guards.advice(q).alias("advice"), guards.performance(q).alias("performance"), guards.foreign_name(q).alias("foreign_name"), guards.structural_intent(q).alias("intent"))


@query(f"WITH t AS ({QUESTION_SQL}), {RULES_SQL} SELECT conv_id, turn, advice AND intent = 'advice' AS advice_blocked, performance AS performance_blocked, performance AND CASE WHEN turn % 2 = 0 THEN 'performance' ELSE intent END = 'performance' AS with_classifier FROM rules")
def two_layer(spark, sf):
    q = c("question")
    own = guards.two_layer_performance(q, lambda text: F.when(c("turn") % 2 == 0, "performance"))
    return turns(spark, sf).select("conv_id", "turn", guards.two_layer_advice(q)["blocked"].alias("advice_blocked"), guards.two_layer_performance(q)["blocked"].alias("performance_blocked"), own["blocked"].alias("with_classifier"))


def _resolve_sql() -> str:
    """A CTE for each alias, longest first: a claimed span is blanked out of the text."""
    sql, last = f"a0 AS (SELECT *, {LOW_SQL} AS s, []::VARCHAR[] AS schemes, []::VARCHAR[] AS found FROM rules)", "a0"
    for n, (alias, scheme) in enumerate(resolve.ordered_aliases(ALIASES), 1):
        p = f"(^|[^a-z0-9]){alias}([^a-z0-9]|$)"
        sql += f""", a{n} AS (SELECT * REPLACE (CASE WHEN regexp_matches(s, '{p}') THEN regexp_replace(s, '{p}', '\\1{"#" * len(alias)}\\2') ELSE s END AS s,
            CASE WHEN regexp_matches(s, '{p}') AND NOT list_contains(schemes, '{scheme}') THEN list_append(schemes, '{scheme}') ELSE schemes END AS schemes,
            CASE WHEN regexp_matches(s, '{p}') THEN list_append(found, '{alias}') ELSE found END AS found) FROM {last})"""
        last = f"a{n}"
    scope = ", ".join(f"'{s}'" for s in IN_SCOPE)
    return sql + f""", kept AS (SELECT *, CASE WHEN foreign_name IS NULL THEN list_filter(schemes, lambda x: x IN ({scope})) ELSE []::VARCHAR[] END AS ids FROM {last}),
        resolved AS (SELECT *, array_to_string(ids, ',') AS scheme_ids, CASE WHEN len(ids) = 1 THEN found[1] WHEN len(ids) > 1 THEN array_to_string(found, ',') END AS matched_alias,
          CASE len(ids) WHEN 0 THEN 0.0 WHEN 1 THEN 0.95 ELSE 0.6 END::DOUBLE AS confidence, len(ids) <> 1 AS ambiguous FROM kept)"""


RESOLVED_SQL = f"WITH t AS ({QUESTION_SQL}), {RULES_SQL}, {_resolve_sql()}"


def resolved(spark, sf):
    return turns(spark, sf).withColumn("resolution", resolve.resolve(c("question"), ALIASES, IN_SCOPE))


@query(RESOLVED_SQL + " SELECT conv_id, turn, scheme_ids, matched_alias, confidence, ambiguous FROM resolved")
def entity_resolve(spark, sf):
    return resolved(spark, sf).select("conv_id", "turn", F.array_join("resolution.scheme_ids", ",").alias("scheme_ids"), "resolution.matched_alias", "resolution.confidence", "resolution.ambiguous")


@query(RESOLVED_SQL + " SELECT conv_id, turn, scheme_ids, matched_alias, confidence, ambiguous FROM resolved")
def entity_resolve_table(spark, sf):
    """The same with the aliases as a table, among those of every customer and part, which no question names."""
    few = spark.createDataFrame([(alias, scheme, n) for n, (alias, scheme) in enumerate(resolve.ordered_aliases(ALIASES))], "alias string, scheme string, place long")
    names = table(spark, sf, "customer").select(F.lower("c_name").alias("alias"), F.concat(F.lit("c"), "c_custkey").alias("scheme"), (c("c_custkey") + 100).cast("long").alias("place"))
    parts = table(spark, sf, "part").select(F.lower("p_name").alias("alias"), F.concat(F.lit("p"), "p_partkey").alias("scheme"), (c("p_partkey") + 10**9).cast("long").alias("place"))
    scope = spark.createDataFrame([(s,) for s in IN_SCOPE], "scheme string")
    rows = resolve.resolve_rows(turns(spark, sf), "question", few.unionAll(names).unionAll(parts), scope)
    return rows.select("conv_id", "turn", F.array_join("resolution.scheme_ids", ",").alias("scheme_ids"), "resolution.matched_alias", "resolution.confidence", "resolution.ambiguous")


SCOPE_SQL = "(foreign_name IS NOT NULL OR (len(ids) = 0 AND regexp_matches(" + LOW_SQL + ", '" + "|".join(guards.SCOPE_WORDS) + "')))"


@query(RESOLVED_SQL + f" SELECT conv_id, turn, {SCOPE_SQL} AS hit FROM resolved")
def scope_detect(spark, sf):
    return resolved(spark, sf).select("conv_id", "turn", guards.out_of_corpus(c("question"), F.size("resolution.scheme_ids") > 0)["hit"].alias("hit"))


@query(RESOLVED_SQL + f""" SELECT conv_id, turn, CASE WHEN kind IS NOT NULL THEN 'pii' WHEN advice AND intent = 'advice' THEN 'advice' WHEN performance THEN 'performance' WHEN {SCOPE_SQL} THEN 'out_of_corpus' END AS refusal_type,
    (CASE WHEN kind IS NOT NULL THEN 1 WHEN advice AND intent = 'advice' THEN 2 WHEN performance THEN 3 ELSE 4 END)::INT AS n_decisions FROM resolved""")
def guard_chain(spark, sf):
    rows = resolved(spark, sf).withColumn("chain", guards.guard_chain(c("question"), F.size("resolution.scheme_ids") > 0))
    return rows.select("conv_id", "turn", guards.refusal_type(c("chain")).alias("refusal_type"), F.size("chain").alias("n_decisions"))


HINT_SQL = RESOLVED_SQL + """, u AS (SELECT *, CASE WHEN kind IS NULL THEN question ELSE '[redacted]' END AS shown FROM resolved WHERE role = 'user'),
    h AS (SELECT *, last_value(CASE WHEN shown <> '' AND NOT starts_with(shown, '[redacted') AND NOT ambiguous THEN scheme_ids END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS hint FROM u)"""


def hinted(spark, sf):
    rows = resolved(spark, sf).where("role = 'user'").withColumn("question", guards.redacted(c("question"), "[redacted]"))
    return history.carried_forward(rows, F.when(~c("resolution.ambiguous"), c("resolution.scheme_ids")))


@query(HINT_SQL + " SELECT conv_id, turn, hint FROM h")
def history_carry_forward(spark, sf):
    return hinted(spark, sf).select("conv_id", "turn", F.array_join("hint", ",").alias("hint"))


@query(HINT_SQL + """ SELECT conv_id, turn, CASE WHEN len(ids) = 0 AND hint IS NOT NULL THEN hint ELSE scheme_ids END AS scheme_ids, CASE WHEN len(ids) = 0 AND hint IS NOT NULL THEN 'from conversation history' ELSE matched_alias END AS matched_alias,
    CASE WHEN len(ids) = 0 AND hint IS NOT NULL THEN 0.5 ELSE confidence END::DOUBLE AS confidence FROM h""")
def scheme_hint(spark, sf):
    r = history.with_hint(c("resolution"), c("hint"))
    return hinted(spark, sf).select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", F.array_join("r.scheme_ids", ",").alias("scheme_ids"), "r.matched_alias", "r.confidence")


@query("""WITH o AS (SELECT *, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    e AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 2 THEN '[redacted: personal identifier]' ELSE text END AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer FROM o WHERE role = 'user')
    SELECT conv_id, turn, coalesce(string_agg(CASE WHEN question <> '' AND NOT starts_with(question, '[redacted') THEN 'Q: ' || question || chr(10) || 'A: ' || coalesce(answer, '') END, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS history FROM e""")
def history_window(spark, sf):
    rows = history.exchanges(table(spark, sf, "conversations")).withColumn("question", F.when(c("turn") % 5 == 2, "[redacted: personal identifier]").otherwise(c("question")))
    return history.history(rows).select("conv_id", "turn", history.history_text(c("history")).alias("history"))


#: Answers over orders: each is right but for one fault, by key.
def answers(spark, sf):
    k = c("o_orderkey")
    total = F.format_string("%.2f", "o_totalprice")
    url = F.when(k % 9 == 1, "https://elsewhere.example/x").otherwise(SOURCES[0].url)
    shown = F.when(k % 9 == 2, F.format_string("%.2f", c("o_totalprice") + 1000)).otherwise(total)
    text = F.concat(
        F.when(k % 9 == 4, "The order total is ").otherwise("The large cap total is "), F.lit("₹"), shown, F.lit(". "),
        F.when(k % 9 == 5, "You should buy it. ").when(k % 9 == 6, "Mail a@b.org now. ").when(k % 9 == 7, "One. Two. Three. Four. ").otherwise(""),
        F.when(k % 9 == 8, "").otherwise(F.concat(url, F.lit(" "))), F.when(k % 9 == 3, "").otherwise("\nLast updated from sources: 2024-01-02"),
    )
    scheme = F.when(k % 10 == 0, "alpha_balanced").otherwise("alpha_large_cap")
    evidence = F.array(F.struct(scheme.alias("scheme_id"), F.concat(F.lit("NAV ₹ "), total).alias("text")))
    found = F.struct(F.array(F.lit("alpha_large_cap")).alias("scheme_ids"), F.lit("large cap").alias("matched_alias"), F.lit(0.95).alias("confidence"), (k % 4 == 0).alias("ambiguous"))
    return table(spark, sf, "orders").select(k, text.alias("answer"), F.lit("what is it in 2024?").alias("query"), evidence.alias("evidence"), found.alias("resolution"))


#: The same answers, and every check worked out from their text.
ANSWER_TEXT_SQL = f"""WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS k, o_orderkey % 4 = 0 AS vague, CASE WHEN o_orderkey % 10 = 0 THEN 'alpha_balanced' ELSE 'alpha_large_cap' END AS scheme, printf('%.2f', o_totalprice) AS total, printf('%.2f', o_totalprice + 1000) AS wrong FROM orders),
    a AS (SELECT o_orderkey, vague, scheme, 'NAV ₹ ' || total AS evidence, 'what is it in 2024?' AS asked,
      CASE WHEN k = 4 THEN 'The order total is ' ELSE 'The large cap total is ' END || '₹' || CASE WHEN k = 2 THEN wrong ELSE total END || '. ' || CASE k WHEN 5 THEN 'You should buy it. ' WHEN 6 THEN 'Mail a@b.org now. ' WHEN 7 THEN 'One. Two. Three. Four. ' ELSE '' END
      || CASE WHEN k = 8 THEN '' ELSE CASE WHEN k = 1 THEN 'https://elsewhere.example/x' ELSE '{SOURCES[0].url}' END || ' ' END || CASE WHEN k = 3 THEN '' ELSE chr(10) || 'Last updated from sources: 2024-01-02' END AS answer FROM o)"""
URL_RE = "https?://[^\\s)\\]}>\"'']+"
TOKEN_RE = "₹\\s?\\d[\\d,]*(?:\\.\\d+)?|\\d[\\d,]*(?:\\.\\d+)?\\s?%|\\d{1,2}-[A-Za-z]{3}-\\d{4}|\\d{4}-\\d{2}-\\d{2}|\\d[\\d,]*(?:\\.\\d+)?\\s?(?:Cr|crore|crores|BPS|bps)|\\b\\d[\\d,]*(?:\\.\\d+)?\\b"
ANSWER_LOW_SQL = LOW_SQL.replace("question", "answer")
UNGROUNDED_SQL = f"""list_filter(regexp_extract_all(regexp_replace(regexp_replace(answer, '{URL_RE}', ' ', 'g'), '(?i)last updated from sources:[^\\n]*', ' ', 'g'), '{TOKEN_RE}'),
    lambda x: NOT contains(lower(regexp_replace(evidence, '\\s+', '', 'g')), lower(regexp_replace(x, '\\s+', '', 'g'))) AND NOT contains(lower(regexp_replace(asked, '\\s+', '', 'g')), lower(regexp_replace(x, '\\s+', '', 'g'))))"""
ANSWER_SQL = ANSWER_TEXT_SQL + f""", c AS (SELECT *, regexp_extract_all(answer, '{URL_RE}') AS cited, trim(regexp_replace(answer, '{URL_RE}', ' ', 'g'), ' ' || chr(10)) AS masked, {UNGROUNDED_SQL} AS ungrounded FROM a),
    f AS (SELECT o_orderkey, list_filter([CASE WHEN len(cited) <> 1 THEN 'citation_present' END, CASE WHEN len(cited) <> 1 OR cited[1] NOT IN ({", ".join(f"'{x.url}'" for x in SOURCES)}) THEN 'citation_allowed' END, CASE WHEN len(ungrounded) > 0 THEN 'grounded' END,
      CASE WHEN NOT vague AND scheme <> 'alpha_large_cap' THEN 'evidence_scheme_match' END, CASE WHEN NOT vague AND NOT regexp_matches(lower(answer), 'large[ _]cap') THEN 'scheme_named' END,
      CASE WHEN {ADVICE_SQL.replace(LOW_SQL, ANSWER_LOW_SQL)} OR {INTENT_SQL.replace(LOW_SQL, ANSWER_LOW_SQL)} = 'advice' THEN 'no_advice' END, CASE WHEN {pii_sql('answer')} IS NOT NULL THEN 'no_pii' END,
      CASE WHEN 1 + len(regexp_extract_all(masked, '[.!?]\\s+[A-Z"''(\\[]')) > 3 THEN 'sentence_budget' END, CASE WHEN NOT contains(lower(answer), 'last updated from sources:') THEN 'has_last_updated' END], lambda x: x IS NOT NULL) AS failed FROM c)"""


@query(ANSWER_SQL + " SELECT o_orderkey, array_to_string(failed, ',') AS failures, len(failed) = 0 AS passed, list_has_any(failed, ['citation_allowed', 'no_advice', 'no_pii']) AS discardable FROM f")
def validate_answers(spark, sf):
    rows = validate.validated(answers(spark, sf), [s.url for s in SOURCES], 3, "alpha_")
    return rows.select("o_orderkey", F.array_join("failures", ",").alias("failures"), "passed", "discardable")


@query(ANSWER_TEXT_SQL + f" SELECT o_orderkey, array_to_string({UNGROUNDED_SQL}, ',') AS ungrounded FROM a")
def grounding(spark, sf):
    return answers(spark, sf).select("o_orderkey", F.array_join(validate.ungrounded(c("answer"), c("evidence"), c("query")), ",").alias("ungrounded"))


@query(rf"""WITH a AS (SELECT o_orderkey, (['{SOURCES[1].url}/', 'https://elsewhere.example/x', '{SOURCES[2].url}?a=1', 'no link', '{SOURCES[0].url}'])[o_orderkey % 5 + 1] AS u FROM orders),
    t AS (SELECT o_orderkey, 'See ' || u || ' or https://elsewhere.example/y' AS t FROM a), f AS (SELECT o_orderkey, regexp_extract(t, 'https?://[^\s)\]}}>"'']+') AS own FROM t)
    SELECT o_orderkey, CASE WHEN rtrim(split_part(own, '?', 1), '/') IN ({", ".join(f"'{x.url}'" for x in SOURCES)}) THEN own ELSE '{SOURCES[0].url}' END AS citation FROM f""")
def safe_citation(spark, sf):
    """The answer's own first link where it is an allowed one (written in several ways), else the first allowed one."""
    own = F.get(F.array(F.lit(SOURCES[1].url + "/"), F.lit("https://elsewhere.example/x"), F.lit(SOURCES[2].url + "?a=1"), F.lit("no link"), F.lit(SOURCES[0].url)), (c("o_orderkey") % 5).cast("int"))
    text = F.concat(F.lit("See "), own, F.lit(" or https://elsewhere.example/y"))
    return table(spark, sf, "orders").select("o_orderkey", validate.safe_citation(text, [s.url for s in SOURCES]).alias("citation"))


@query(f"WITH t AS ({QUESTION_SQL}) SELECT conv_id, turn, left(trim(regexp_replace(question, '\\s+', ' ', 'g')), 500) AS query FROM t")
def query_normalize(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.substring(T.collapse(c("question")), 1, SETTINGS.max_query_chars).alias("query"))


@query()
def answer_batch(spark, sf):
    """Every user turn answered, refused or sent to the fixed fallback."""
    from factloom.plans.answering import answer_turns

    return answer_turns(spark, turns(spark, sf).where("role = 'user'"), SETTINGS, ALIASES, table(spark, sf, "embeddings"))


class Scripted:
    """A generator whose first and second answer to "case N" have the fault that WRITES states, or that raises."""

    def chat(self, system: str, user: str, temperature: float = 0.0, max_tokens: int = 220) -> str:
        total = system.split("<context>\n", 1)[1].split("\n</context>", 1)[0].removeprefix("NAV ₹")
        fault = WRITES.get(user.removeprefix("case "), ("", ""))["Your previous answer failed" in system]
        if fault == "raise":
            raise RuntimeError("no answer")
        shown = f"{float(total) + 1000:.2f}" if fault == "number" else total
        url = "https://elsewhere.example/x" if fault == "link" else SOURCES[0].url
        return f"The large cap total is ₹{shown}. {url}" + ("" if fault == "date" else "\nLast updated from sources: 2024-01-02")


#: Faults of the first and of the second answer, by case; the other cases never reach the generator or are right at once.
WRITES = {"1": ("date", ""), "2": ("number", "number"), "3": ("link", ""), "4": ("raise", ""), "5": ("number", "link"), "6": ("date", "raise")}
ROUNDS_SQL = f"""WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS k, 'The large cap total is ₹' || printf('%.2f', o_totalprice) || '. {SOURCES[0].url}' || chr(10) || 'Last updated from sources: 2024-01-02' AS good FROM orders)
    SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN good WHEN k IN (2, 3, 5) THEN '{answer.FALLBACK}' || chr(10) || chr(10) || 'Source: {SOURCES[0].url}' || chr(10) || 'Last updated from sources: 2024-03-04' WHEN k IN (4, 6) THEN '{answer.FALLBACK}' WHEN k = 7 THEN 'refused ' || o_orderkey ELSE '{answer.NOT_AVAILABLE}' END AS text,
      CASE WHEN k <> 7 THEN '{SOURCES[0].url}' END AS citation_url, CASE WHEN k IN (0, 1) THEN 'answered' WHEN k IN (2, 3, 5) THEN 'fallback' WHEN k IN (4, 6) THEN 'generator_failed' WHEN k = 7 THEN 'refused' ELSE 'not_available' END AS status,
      CASE k WHEN 2 THEN 'grounded' WHEN 3 THEN 'citation_allowed' WHEN 5 THEN 'citation_allowed' ELSE '' END AS failures, (k IN (1, 2, 5, 6))::INT AS retries FROM o"""


@query(ROUNDS_SQL)
def answer_rounds(spark, sf):
    """An answer for each order by a scripted generator: at once, after a retry, by the fallback, discarded, failed, refused, not grounded, without context."""
    k = c("o_orderkey") % 10
    text = F.concat(F.lit("NAV ₹"), F.format_string("%.2f", "o_totalprice"))
    found = F.struct(F.array(F.lit("alpha_large_cap")).alias("scheme_ids"), F.lit("large cap").alias("matched_alias"), F.lit(0.95).alias("confidence"), F.lit(False).alias("ambiguous"))
    rows = table(spark, sf, "orders").select(
        c("o_orderkey").alias("qid"), F.concat(F.lit("case "), k).alias("query"), F.when(k != 9, text).alias("context"), F.array(F.struct(F.lit("alpha_large_cap").alias("scheme_id"), text.alias("text"))).alias("evidence"), found.alias("resolution"),
        F.when(k == 7, "advice").alias("refusal_type"), F.when(k == 7, F.concat(F.lit("refused "), "o_orderkey")).alias("refusal_text"), (k != 8).alias("grounded"), F.array().cast("array<struct<question:string,answer:string>>").alias("history"),
    )
    out = answer.answered(rows, Scripted(), SETTINGS, "2024-03-04", "alpha_")
    return out.select(c("qid").alias("o_orderkey"), "text", "citation_url", "status", F.array_join("failures", ",").alias("failures"), "retries")


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS n_before FROM conversations WHERE role = 'user'")
def history_stream(spark, sf):
    """The history window by a stream with state, replayed over the table."""
    from factloom.streaming.history import replayed

    return replayed(spark, f"{sf}/conversations.parquet").select("conv_id", "turn", "n_before")


@query(HINT_SQL + " SELECT conv_id, turn, hint FROM h")
def history_hints_stream(spark, sf):
    """The entities carried forward by a stream with a list as state, replayed over the table."""
    from factloom.streaming.history import hints_replayed

    def asked(rows):
        told = led(rows.where("role = 'user'")).withColumn("r", resolve.resolve(c("question"), ALIASES, IN_SCOPE))
        return told.select("conv_id", "turn", guards.redacted(c("question"), "[redacted]").alias("question"), F.when(~c("r.ambiguous"), c("r.scheme_ids")).alias("scheme_ids"))

    return hints_replayed(spark, f"{sf}/conversations.parquet", asked).select("conv_id", "turn", F.array_join("hint", ",").alias("hint"))


#: What is expected of a lead by its place: a kind of personal data, or a refusal.
EXPECTED = {3: "pan", 4: "email", 6: "phone", 11: "folio", 13: "aadhaar", 14: "otp", 15: "account_number", 1: "advice", 5: "performance", 7: "out_of_corpus", 9: "advice", 10: "performance"}
PERSONAL = {k: v for k, v in EXPECTED.items() if v in dict(guards.PII)}


def _case_sql(of: dict[int, str]) -> str:
    return "CASE (conv_id * 7 + turn) % " + str(len(LEADS)) + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in of.items()) + " END"


REFUSAL_SQL = f"CASE WHEN kind IS NOT NULL THEN 'pii' WHEN advice AND intent = 'advice' THEN 'advice' WHEN performance THEN 'performance' WHEN {SCOPE_SQL} THEN 'out_of_corpus' END"


@query(RESOLVED_SQL + f""", e AS (SELECT 'pii' AS set, {_case_sql(PERSONAL)} AS expected, kind AS got FROM resolved UNION ALL SELECT 'refusal', {_case_sql({k: ("pii" if k in PERSONAL else v) for k, v in EXPECTED.items()})}, {REFUSAL_SQL} FROM resolved
    UNION ALL SELECT 'golden', o_orderstatus, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 6 = 5 THEN 'X' ELSE 'status ' || o_orderstatus END END FROM orders)
    SELECT set, count(*) AS n, count(*) FILTER (CASE WHEN set = 'golden' THEN coalesce(contains(got, expected), false) ELSE got IS NOT DISTINCT FROM expected END) AS passed FROM e WHERE set = 'golden' OR expected IS NOT NULL GROUP BY set""")
def evaluation_totals(spark, sf):
    """Golden, refusal and personal-data sets over the tables, with totals."""
    from factloom.plans import evaluate

    at = ((c("conv_id") * 7 + c("turn")) % len(LEADS)).cast("int")
    told = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    rows = turns(spark, sf).withColumns({"id": F.concat_ws("-", "conv_id", "turn"), "label": F.try_element_at(told, at)}).where("label is not null")
    kinds = list(PERSONAL.values())
    refused = rows.withColumn("expected_refusal_type", F.when(c("label").isin(kinds), "pii").otherwise(c("label"))).select("id", c("question").alias("query"), "expected_refusal_type")
    orders = table(spark, sf, "orders").select(c("o_orderkey").alias("id"), c("o_orderkey").alias("scheme_id"), F.lit("status").alias("field"), c("o_orderstatus").alias("expected_value"))
    facts = orders.where("id % 4 <> 0").select("scheme_id", "field", F.when(c("id") % 6 == 5, "X").otherwise(F.concat(F.lit("status "), "expected_value")).alias("value"))
    results = evaluate.refusals(refused, SETTINGS, ALIASES).unionAll(evaluate.personal_data(rows.where(c("label").isin(kinds)), text="question")).unionAll(evaluate.golden(orders, facts))
    return evaluate.totals(results)


@query(RESOLVED_SQL + f""" SELECT conv_id, turn, {REFUSAL_SQL} AS reason_guard, (CASE WHEN kind IS NOT NULL THEN 1 WHEN advice AND intent = 'advice' THEN 2 WHEN performance THEN 3 ELSE 4 END)::INT AS n_decisions, scheme_ids, '{{"documents": 2}}' AS stage1, true AS stage2_missing, turn % 3 = 0 AS retried FROM resolved""")
def full_trace(spark, sf):
    """The whole trace of each turn as text, read back: recorded stages, guard decisions and resolution, generation."""
    from factloom.operators import trace

    rows = resolved(spark, sf).withColumn("chain", guards.guard_chain(c("question"), F.size("resolution.scheme_ids") > 0))
    taken = F.array(trace.top_chunk(F.lit(1), F.lit("c"), F.lit("s"), F.lit("f"), F.lit("v"), F.lit(0.25), F.lit("u")))
    wrote = F.when(c("turn") % 3 == 0, trace.generation(F.lit(SOURCES[0].url), F.struct(F.lit(True).alias("passed")), F.lit(1)))
    whole = trace.trace(**trace.recorded({"trace": {"stage1": {"documents": 2}, "stage2": "none"}}), stage5=trace.retrieval(c("chain"), c("resolution"), taken), stage6=wrote)
    text = staged(rows.select("conv_id", "turn", trace.to_text(whole).alias("t")), "traces")  # made once, not for each path that is read of it
    guard = F.get_json_object("t", "$.stage5.guard_decisions[*].guard")
    n = F.size(F.from_json(F.get_json_object("t", "$.stage5.guard_decisions"), "array<struct<guard:string,triggered:boolean>>"))
    last = F.element_at(F.from_json(F.get_json_object("t", "$.stage5.guard_decisions"), "array<struct<guard:string,triggered:boolean>>"), -1)
    ids = F.array_join(F.from_json(F.get_json_object("t", "$.stage5.scheme_resolution.scheme_ids"), "array<string>"), ",")
    return text.where(guard.isNotNull()).select(
        "conv_id", "turn", F.when(last["triggered"], last["guard"]).alias("reason_guard"), n.alias("n_decisions"), ids.alias("scheme_ids"), F.get_json_object("t", "$.stage1").alias("stage1"), F.get_json_object("t", "$.stage2").isNull().alias("stage2_missing"),
        (F.get_json_object("t", "$.stage6.retry_count") == "1").eqNullSafe(F.lit(True)).alias("retried"),
    )


SHOWN_SQL = f"SELECT conv_id, turn, role, text, left(trim(regexp_replace(question, '\\s+', ' ', 'g')), 500) AS question FROM ({QUESTION_SQL})"


@query(HINT_SQL.replace(QUESTION_SQL, SHOWN_SQL) + f""", r AS (SELECT conv_id, turn, CASE WHEN kind IS NOT NULL THEN 'pii' WHEN advice AND intent = 'advice' THEN 'advice' WHEN performance THEN 'performance' WHEN foreign_name IS NOT NULL OR (len(ids) = 0 AND hint IS NULL AND {SCOPE_SQL}) THEN 'out_of_corpus' END AS refusal_type FROM h)
    SELECT conv_id, turn, refusal_type, 'refused' AS status, 0 AS retries FROM r WHERE refusal_type IS NOT NULL""")
def answer_refusals(spark, sf):
    """Of all user turns answered: those that a guard stopped, which never reach the search."""
    return answer_batch(spark, sf).where("refusal_type is not null and refusal_type <> 'ungrounded'").select("conv_id", "turn", "refusal_type", "status", "retries")
