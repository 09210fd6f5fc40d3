"""Question guards: ordered pattern rules as columns. Patterns see collapsed lower-case text unless said."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import let, lowered

# Personal-data patterns in order of precedence (on the raw text), then the bare long number.
PII = (
    ("pan", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("aadhaar", r"(?i)(?:\baadhaar\b\s*(?:number|no\.?|#)?\s*[:\-]?\s*)?\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("phone", r"\b(?:\+?91[\-\s]?)?[6-9][0-9]{4}[0-9]{5}\b"),
    ("otp", r"(?i)\b(?:otp|one\s*time\s*(?:password|otp|code))\b\s*(?:is|:|=)?\s*[0-9]{4,6}\b"),
    ("folio", r"(?i)\b(?:folio|account|acct|acc)\s*(?:number|no\.?|#)?\s*[:\-]?\s*[0-9]{6,14}\b"),
    ("account_number", r"\b[0-9]{9,14}\b"),
)

# Advice phrases.
ADVICE = (
    "should i buy", "should i sell", "should i invest", "should i redeem", "which is better", "what should i", "is it a good time", "is now a good time",
    "good time to", "recommend", "suggest", "worth it", "best fund for", "build me a portfolio", "exit or hold", "hold or exit", "buy or sell",
    "the best one", "which of these", "best scheme", "good pick", "safe to invest", "can i invest in",
)

# Performance phrases and patterns.
PERFORMANCE = (
    "will it return", "expected return", "projected", "which performed better", "compare returns", "outperform", "top performing", "return in 5 years",
    "returns in 5 years", "performance comparison", "which is better performing", "past performance", "how much will", "how much does it return",
    "expected to return", "will it give", "profit",
)
RETURN_WORDS = "(?:return|returns|yield|gain|gains|performance|profit|appreciation)"
PERFORMANCE_PATTERNS = (
    rf"\bwhat will\b.*{RETURN_WORDS}",
    rf"\bwill\b.*{RETURN_WORDS}\b",
    rf"\bcompare\b.{{0,40}}{RETURN_WORDS}",
    rf"\b{RETURN_WORDS}\b.{{0,20}}\bvs\b",
    rf"\bvs\b.{{0,40}}{RETURN_WORDS}",
    rf"\b{RETURN_WORDS}\b.{{0,30}}\d+\s*%",
    rf"\b\d+\s*%\s*(?:p\.?a\.?)?\s*{RETURN_WORDS}",
    rf"\bexpected\b.{{0,30}}\b{RETURN_WORDS}",
    rf"\bhow much\b.{{0,40}}{RETURN_WORDS}",
    r"\bprojected\b",
    rf"\bwhich\b.{{0,40}}{RETURN_WORDS}",
)

# Names of other houses, in order of precedence.
FOREIGN = (
    "sbi", "kotak", "icici", "axis", "nippon", "franklin", "parag parikh", "ppfas", "motilal", "quant", "bandhan", "canara", "baroda", "union", "lic",
    "principal", "invesco", "mirae", "aditya", "sundaram", "shriram", "l&t", "hsbc", "idbi", "jm financial", "tata", "parag", "max", "sbi mf", "nippon india",
)

# Structural signals of advice and of performance questions.
ADVICE_SIGNALS = (
    r"\b(should|can|could|would|do|will)\s+i\s+(\w+\s+){0,2}?(buy|sell|hold|redeem|invest|exit|switch|enter|continue|avg|average)\b",
    r"\b(good|right|ideal|bad|poor)\s+(time|idea|entry|exit)\b",
    r"\bworth\s+(it|buying|investing|it\s+to)\b",
    r"\b(best|top|better|optimal|safest|most\s+\w+)\b[^?]{0,40}?\b(fund|scheme|plan|option|one|which)\b",
    r"\bwhich\s+(of\s+these|one|is)\b[^?]{0,40}?\b(best|good|better|hold|suitable|worth|recommend|prefer|choose|pick)\b",
    r"\b(you\s+should|go\s+for|opt\s+for|you\s+can\s+consider)\b",
    r"\bcan\s+i\s+(invest|put\s+money)\b",
)
PERFORMANCE_SIGNALS = (
    r"\b(what|how\s+much)\b[^?]{0,40}?\b(will|would|could|should)\b[^?]{0,40}?\b(return|grow|gain|earn|appreciate|be\s+worth)\b",
    r"\b(returns?|performance|profit|gain|loss|yield|growth)\b[^?]{0,30}?\b(in|over|after)\b[^?]{0,20}?\b(year|yr|month|5\s*year|10\s*year)\b",
    r"\b(compare|versus|vs\.?|outperform|beat|against)\b[^?]{0,40}?\b(return|performance|fund|scheme)\w*\b",
    r"\b(expected|projected|likely|estimated)\b[^?]{0,30}?\b(return|gain|growth)\b",
    r"\bhow\s+(much|many)\b[^?]{0,40}?\b(make|earn|gain)\b",
    r"\bsafe\s+for\b[^?]{0,20}?\b\d+\s*(year|month)",
    r"\b(risk[- ]adjusted\s+)?returns?\b[^?]{0,20}?\bvs\b",
)
# Words of which every pattern above needs one, in collapsed text.
RETURN_MARKS = ("return", "yield", "gain", "performance", "profit", "appreciation", "projected")
ADVICE_MARKS = ("should", "can i ", "could i ", "would i ", "do i ", "will i ", "good ", "right ", "ideal ", "bad ", "poor ", "worth ", "best", "top", "better", "optimal", "safest", "most ", "which ", "go for", "opt for", "you can consider")
PERFORMANCE_MARKS = ("return", "grow", "gain", "earn", "appreciate", "be worth", "performance", "profit", "loss", "yield", "compare", "versus", "vs", "outperform", "beat", "against", "how much", "how many", "safe for")
SCOPE_WORDS = ("cap", "fund", "elss", "tax saver", "balanced", "advantage", "equity")

REFUSALS = {
    "pii": "I don't accept or store personal or account identifiers. Please remove it from your question.",
    "advice": "I only share published facts, so I can't tell you whether to buy, sell, or hold anything.",
    "performance": "I don't compute or compare returns, and I can't forecast future performance.",
    "ungrounded": "I could not find that in the published pages I have.",
}


def any_of(patterns) -> str:
    """One alternation, matched with Unicode word boundaries and white space."""
    return "(?U)" + "|".join(f"(?:{p})" for p in patterns)


def literal(phrase: str) -> str:
    return rf"\Q{phrase}\E"


def pii(text: Column) -> Column:
    """struct(kind, start, end) of the first pattern in order that hits (not the leftmost); never the text; null if none."""

    def first(t: Column) -> Column:
        out = F.lit(None).cast("struct<kind:string,start:int,end:int>")
        for kind, pattern in reversed(PII):
            pattern = f"(?U){pattern}"
            at = F.regexp_instr(t, F.lit(pattern))
            hit = F.struct(F.lit(kind).alias("kind"), (at - 1).alias("start"), (at - 1 + F.length(F.regexp_extract(t, pattern, 0))).alias("end"))
            out = F.when(t.rlike(pattern), hit).otherwise(out)
        return out

    return let(F.coalesce(text, F.lit("")), first)


def has_pii(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("|".join(f"(?:(?U){p})" for _, p in PII))


def redacted(text: Column, marker: str = "[redacted: personal identifier]") -> Column:
    return F.when(has_pii(text), F.lit(marker)).otherwise(text)


def holds(low: Column, words) -> Column:
    """Whether any of the words stands in the text, within longer ones too: a plain search, far cheaper than a pattern."""
    return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])


def matched(low: Column, patterns, words) -> Column:
    """Whether a pattern matches; each of them needs one of the words, so most texts are told by these."""
    return holds(low, words) & low.rlike(any_of(patterns))


def advice(text: Column) -> Column:
    return let(lowered(text), _advice)


def _advice(low: Column) -> Column:
    return holds(low, ADVICE)


def performance(text: Column) -> Column:
    return let(lowered(text), _performance)


def _performance(low: Column) -> Column:
    return holds(low, PERFORMANCE) | matched(low, PERFORMANCE_PATTERNS, RETURN_MARKS)


def foreign_name(text: Column, names=FOREIGN) -> Column:
    """The first name in list order that stands as a word, else null."""
    return let(lowered(text), lambda low: _foreign_name(low, names))


def _foreign_name(low: Column, names=FOREIGN) -> Column:
    # a literal pattern a name, which a task compiles once; only texts that one of them hits are asked for which
    one = F.coalesce(*[F.when(low.rlike(any_of([rf"\b{literal(n)}\b"])), n) for n in names])
    return F.when(_foreign(low, names), one)


def _foreign(low: Column, names=FOREIGN) -> Column:
    return matched(low, [rf"\b{literal(n)}\b" for n in names], names)


def structural_intent(text: Column, names=FOREIGN) -> Column:
    """out_of_scope, advice, performance or factual, by grammar rather than phrases."""
    return let(lowered(text), lambda low: _structural_intent(low, names))


def _structural_intent(low: Column, names=FOREIGN) -> Column:
    return F.when(_foreign(low, names), "out_of_scope").when(matched(low, ADVICE_SIGNALS, ADVICE_MARKS), "advice").when(matched(low, PERFORMANCE_SIGNALS, PERFORMANCE_MARKS), "performance").otherwise("factual")


def gives_advice(text: Column, names=FOREIGN) -> Column:
    """Whether a text has an advice phrase, or is advice by its structure; the signals are asked before the names, which rule few texts out."""
    return let(lowered(text), lambda low: _advice(low) | (matched(low, ADVICE_SIGNALS, ADVICE_MARKS) & ~_foreign(low, names)))


def second_opinion(text: Column, classifier=None) -> Column:
    """Layer two: ``classifier`` (Column to Column, null where it fails) before the structural one."""
    return let(lowered(text), lambda low: _second_opinion(text, low, classifier))


def _second_opinion(text: Column, low: Column, classifier) -> Column:
    own = _structural_intent(low)
    return F.coalesce(classifier(text), own) if classifier is not None else own


def two_layer_advice(text: Column, classifier=None) -> Column:
    """struct(blocked, reason): both layers must say advice."""
    return let(lowered(text), lambda low: _two_layer_advice(text, low, classifier))


def _two_layer_advice(text: Column, low: Column, classifier) -> Column:
    return _two_layer(_advice(low), _second_opinion(text, low, classifier), "advice", False)


def two_layer_performance(text: Column, classifier=None) -> Column:
    """As for advice, but without a classifier layer one alone blocks."""
    return let(lowered(text), lambda low: _two_layer_performance(text, low, classifier))


def _two_layer_performance(text: Column, low: Column, classifier) -> Column:
    return _two_layer(_performance(low), _second_opinion(text, low, classifier), "performance", classifier is None)


def _two_layer(first: Column, second: Column, label: str, alone: bool) -> Column:
    """The second layer is asked only where the first says yes and does not decide alone."""

    def decide(one: Column) -> Column:
        blocked, none = F.struct(F.lit(True).alias("blocked"), F.lit(f"{label} phrases: match; no classifier, blocked on phrases alone").alias("reason")), F.struct(F.lit(False).alias("blocked"), F.lit(f"{label} phrases: no match").alias("reason"))
        if alone:
            return F.when(one, blocked).otherwise(none)

        def told(two: Column) -> Column:
            reason = F.when(two == label, f"{label} phrases: match; second layer agreed").otherwise(F.concat(F.lit(f"{label} phrases: match; second layer said "), two))
            return F.struct((two == label).alias("blocked"), reason.alias("reason"))

        return F.when(one, let(second, told)).otherwise(none)

    return let(first, decide)


def out_of_corpus(text: Column, resolved: Column, names=FOREIGN) -> Column:
    """struct(hit, detail): a foreign name hits; else a resolved entity clears; else a scope word hits."""
    return let(lowered(text), lambda low: _out_of_corpus(low, resolved, names))


def _out_of_corpus(low: Column, resolved: Column, names) -> Column:
    told = F.struct(_foreign_name(low, names).alias("name"), (~resolved & holds(low, SCOPE_WORDS)).alias("word"))
    return let(told, lambda t: F.struct((t["name"].isNotNull() | t["word"]).alias("hit"), F.when(t["name"].isNotNull(), t["name"]).when(t["word"], "nothing in scope matched").alias("detail")))


def scope_refusal(scheme_names: list[str]) -> str:
    return f"I only have facts for {len(scheme_names)} entries, so I can't answer that. In scope: {'; '.join(scheme_names)}."


def guard_chain(text: Column, resolved: Column, classifier=None, names=FOREIGN) -> Column:
    """array of struct(guard, triggered, reason, loggable) up to the first that triggers: pii, advice, performance, out_of_corpus."""

    def asked(low: Column) -> Column:
        """What every guard says; the text is collapsed and lower-cased once for all of them."""
        return F.struct(pii(text)["kind"].alias("kind"), _two_layer_advice(text, low, classifier).alias("a"), _two_layer_performance(text, low, classifier).alias("p"), _out_of_corpus(low, resolved, names).alias("s"))

    def decision(guard: str, triggered: Column, reason: Column, loggable: bool = True) -> Column:
        return F.struct(F.lit(guard).alias("guard"), F.coalesce(triggered, F.lit(False)).alias("triggered"), reason.alias("reason"), F.lit(loggable).alias("loggable"))

    def chain(f: Column) -> Column:
        return F.array(decision("pii", f["kind"].isNotNull(), f["kind"], False), decision("advice", f["a"]["blocked"], f["a"]["reason"]), decision("performance", f["p"]["blocked"], f["p"]["reason"]), decision("out_of_corpus", f["s"]["hit"], f["s"]["detail"]))

    def cut(every: Column) -> Column:
        first = F.array_position(F.transform(every, lambda d: d["triggered"]), True)
        return F.when(first > 0, F.slice(every, F.lit(1), first.cast("int"))).otherwise(every)

    return let(let(let(lowered(text), asked), chain), cut)


def refusal_type(chain: Column) -> Column:
    """The guard that triggered, else null."""
    return let(F.element_at(chain, -1), lambda last: F.when(last["triggered"], last["guard"]))
