"""Text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every white-space run, as str.split and the re module's \\s see it.
WS = r"(?U)\s+"
#: The characters of WS, for trims.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: what counts as a URL in a text.
URL = r"https?://[^\s)\]}>\"']+"
#: Fixed value: what counts as a fact token, longest forms first.
FACT_TOKEN = (
    r"₹\s?\d[\d,]*(?:\.\d+)?"
    r"|\d[\d,]*(?:\.\d+)?\s?%"
    r"|\d{1,2}-[A-Za-z]{3}-\d{4}"
    r"|\d{4}-\d{2}-\d{2}"
    r"|\d[\d,]*(?:\.\d+)?\s?(?:Cr|crore|crores|BPS|bps)"
    r"|\b\d[\d,]*(?:\.\d+)?\b"
)
#: A labelled line, the line that tells the date, the end of a sentence, an exit load's label.
LABEL_LINE = r"(?m)^[A-Z][^\n:]{2,60}\s*:\s*\S"
UPDATED_PREFIX = "Last updated from sources:"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z\"'(\[]|$)"
EXIT_LOAD_LABEL = r"(?i)^exit\s*load\s*(of\s*)?(for\s*units\s*in\s*)?[:\-]?\s*"
#: Fixed value: headings whose block is page noise.
NOISE_HEADINGS = ("Compare similar funds", "Return calculator", "Understand terms", "Check past data")
TOKEN = r"\w+|[^\w\s]"


def let(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, WS, " "))


def lowered(c: Column) -> Column:
    """Collapsed and lower-cased, null as empty."""
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def normalized(c: Column) -> Column:
    """Line ends, dashes, quotes and spaces unified; at most one blank line; stripped."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.translate(c, "–—’ ", "--' ")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def cleaned(c: Column) -> Column:
    return strip(F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")))


def or_else(c: Column, *others: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (c, *others)])


def without_noise(c: Column, headings=NOISE_HEADINGS, window: int = 400) -> Column:
    """Drops each heading's block up to a blank line or the end, if that comes within ``window`` characters."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    for heading in headings:
        c = F.regexp_replace(c, rf"(?s)\Q{heading}\E.{{0,{window}}}?(?=\n{{2,}}|\z)", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalized_url(c: Column) -> Column:
    """Scheme and host lower-cased, default port, trailing slashes, query and fragment dropped; null where it is no URL."""
    c = strip(c)
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
    scheme = F.lower(F.regexp_extract(c, parts, 1))
    host = F.lower(F.regexp_extract(c, parts, 2))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(c, parts, 3), "/+$", "")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, path))


def without_exit_load_label(c: Column) -> Column:
    text = cleaned(c)
    rest = strip(F.regexp_replace(text, EXIT_LOAD_LABEL, ""))
    return or_else(rest, text, F.lit("Not available"))


def labelled_value(text: Column, label: Column | str, value_pattern: str) -> Column:
    """The value behind ``label:`` at a line's start, collapsed; null where there is none.

    A label given as text makes a literal pattern, which a task compiles once.
    """
    head, tail = r"(?im)^\Q", rf"\E\s*:\s*({value_pattern})"
    pattern = F.lit(f"{head}{label}{tail}") if isinstance(label, str) else F.concat(F.lit(head), label, F.lit(tail))
    return F.nullif(collapse(F.call_function("regexp_extract", text, pattern, F.lit(1))), F.lit(""))


def without_urls(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), URL, " ")


def urls(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL), F.lit(0))


def sentence_count(c: Column) -> Column:
    masked = strip(without_urls(c))
    parts = F.split(masked, SENTENCE_END)
    return F.when(masked == "", F.lit(0)).otherwise(F.size(F.filter(parts, lambda p: strip(p) != "")))


def fact_tokens(c: Column) -> Column:
    body = F.regexp_replace(without_urls(c), rf"(?i)\Q{UPDATED_PREFIX}\E[^\n]*", " ")
    return F.transform(F.regexp_extract_all(body, F.lit(FACT_TOKEN), F.lit(0)), strip)


def squeezed(c: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(c, WS, ""))


def last_updated(c: Column) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i)\Q{UPDATED_PREFIX}\E\s*(\d{{4}}-\d{{2}}-\d{{2}})", 1)
    return F.nullif(found, F.lit("")).try_cast("date")


def tokens(c: Column) -> Column:
    """The default, pluggable tokenizer: words and single marks."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def label_lines(c: Column) -> Column:
    return F.regexp_count(c, F.lit(LABEL_LINE))


def nonblank_lines(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda line: strip(line) != ""))


def is_slug(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*$"), F.lit(False))
