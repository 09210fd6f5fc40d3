"""Reading pages: embedded payloads, main text, snapshots and line-delimited files."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.config import DROP_SELECTORS
from factloom.functions.text import normalized_url, strip
from factloom.sources.selectors import Element, Matcher

PAYLOAD_PATH = "$.props.pageProps.mfServerSideData"
DROPPED = ("nav", "header", "footer", "aside")


def payload(html: Column, path: str = PAYLOAD_PATH) -> Column:
    """The JSON object at ``path`` of the page's embedded data script; null where there is none or it is no object."""
    script = F.regexp_extract(F.coalesce(html, F.lit("")), r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    found = F.get_json_object(F.nullif(script, F.lit("")), path)
    return F.when(found.startswith("{"), found)


def tag_text(html: Column) -> Column:
    """Main text by patterns alone: page furniture, scripts and tags dropped, white space collapsed."""
    html = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", *DROPPED):
        html = F.regexp_replace(html, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}>", " ")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    html = F.regexp_replace(html, r"<[^>]*>", " ")
    for code, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(code), F.lit(char))
    return strip(F.regexp_replace(html, r"\s+", " "))


class _Dom(HTMLParser):
    """Text of the first <main>, else of the <div> with the most text, else of the page."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self, drop: Matcher):
        super().__init__(convert_charrefs=True)
        self.drop = drop
        self.stack: list[list] = [["", False, []]]
        self.path: list[Element] = []
        self.main: list[str] | None = None
        self.best: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        self.path.append((tag, dict(attrs)))
        self.stack.append([tag, tag in ("script", "style") or self.drop.takes(self.path), []])

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.stack[1:]):
            while self.stack[-1][0] != tag:
                self._close()
            self._close()

    def _close(self):
        tag, drop, texts = self.stack.pop()
        self.path.pop()
        if drop:
            return
        if tag == "main" and self.main is None:
            self.main = texts
        if tag == "div" and (self.best is None or sum(map(len, texts)) >= sum(map(len, self.best))):
            self.best = texts  # an outer div closes later and holds at least as much
        self.stack[-1][2].extend(texts)

    def handle_data(self, data):
        self.stack[-1][2].append(data)

    def text(self) -> str:
        while len(self.stack) > 1:
            self._close()
        target = self.main if self.main is not None else self.best if self.best is not None else self.stack[0][2]
        return "\n".join(t for t in (x.strip() for x in target) if t)


def dom_text_of(html: str | None, selectors: Sequence[str] = DROP_SELECTORS) -> str:
    return _dom_text(html, Matcher(selectors))


def _dom_text(html: str | None, drop: Matcher) -> str:
    parser = _Dom(drop)
    parser.feed(html or "")
    parser.close()
    return parser.text()


def dom_text(html: Column, selectors: Sequence[str] = DROP_SELECTORS) -> Column:
    """The DOM extraction without what ``selectors`` take, batched."""

    @F.pandas_udf("string")
    def run(pages):
        drop = Matcher(selectors)
        return pages.map(lambda page: _dom_text(page, drop))

    return run(html)


def main_text(html: Column, first=None, least: int = 1500, selectors: Sequence[str] = DROP_SELECTORS) -> Column:
    """``first`` (an extractor, Column to Column) where it gives ``least`` characters, else the DOM's text; null where that is too short too."""
    second = dom_text(html, selectors)
    text = second if first is None else F.when(F.length(strip(first(html))) >= least, first(html)).otherwise(second)
    return F.when(F.length(strip(text)) >= least, text)


def allowed(pages: DataFrame, allowlist: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose normalised URL is one of the allowlist's (column url)."""
    known = allowlist.select(normalized_url(F.col("url")).alias("_known")).where("_known is not null").distinct()
    return pages.join(known, normalized_url(F.col(url)) == F.col("_known"), "left_semi")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(scheme_id, text, fetched_at) of ``<scheme_id>.txt`` files; the date is that of ``<scheme_id>.json`` (fetched_at), else the file's."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.(?:txt|json)$", 1)
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{txt,json}").select(name.alias("scheme_id"), "value", F.col("_metadata.file_path").endswith(".txt").alias("_text"), F.col("_metadata.file_modification_time").cast("date").alias("_on"))
    dates = files.where("not _text").select("scheme_id", F.get_json_object("value", "$.fetched_at").try_cast("date").alias("_told"))
    return files.where("_text").join(dates, "scheme_id", "left").select("scheme_id", F.col("value").alias("text"), F.coalesce("_told", "_on").alias("fetched_at"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Line-delimited JSON in UTF-8, a line a row; nulls keep their keys, dates are ISO."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").option("dateFormat", "yyyy-MM-dd").json(path)


def write_snapshots(rows: DataFrame, path: str) -> None:
    """A partition for each scheme_id with its text and metadata; only those that occur are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scheme_id").parquet(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Line-delimited JSON; a missing file has no rows, blank lines are skipped."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)
    return lines.where(strip(F.col("value")) != "").select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, record) of a JSON object of objects; records stay JSON text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "record"))
