"""Greedy longest-match entity resolution: as an expression over few aliases, or as joins with a table of any number of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import let, lowered
from factloom.operators.guards import FOREIGN, foreign_name
from factloom.session import staged

#: Stands for each character of a claimed span: no alias has it.
BLANK = "\u0001"


def ordered_aliases(aliases: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(alias, scheme) by falling length; equal lengths keep their order. An alias of two schemes is the later one's."""
    of = {alias: scheme for scheme, own in aliases.items() for alias in own}
    return sorted(of.items(), key=lambda x: -len(x[0]))


def resolve(text: Column, aliases: dict[str, list[str]], in_scope: list[str], foreign=FOREIGN) -> Column:
    """struct(scheme_ids, matched_alias, confidence, ambiguous).

    The longest alias claims its span first; an alias takes its first place that no
    earlier span touches. A foreign name empties the result.
    """
    return let(lowered(text), lambda low: _resolve(low, aliases, in_scope, foreign))


def _resolve(low: Column, aliases: dict[str, list[str]], in_scope: list[str], foreign) -> Column:
    """Texts without any alias are not looked at by alias."""
    ordered = ordered_aliases(aliases)
    if not ordered:
        return _result(_nothing(low), low, foreign, in_scope)
    table = F.array(*[_claimable(F.lit(a), F.lit(s)) for a, s in ordered])
    every = "|".join(WORD.format(a) for a, _ in ordered)
    found = F.when(low.rlike(every), F.aggregate(table, _nothing(low), _claim)).otherwise(_nothing(low))
    return let(found, lambda state: _result(state, low, foreign, in_scope))


WORD = r"(?<![a-z0-9])\Q{}\E(?![a-z0-9])"


def _claimable(alias: Column, scheme: Column) -> Column:
    before, after = WORD.split("{}")
    return F.struct(alias.alias("alias"), F.concat(F.lit("(?s)^(.*?)" + before), alias, F.lit(after)).alias("pattern"), F.concat(F.lit("$1"), F.repeat(F.lit(BLANK), F.char_length(alias))).alias("blank"), scheme.alias("scheme"))


def _claim(state: Column, row: Column) -> Column:
    """A claimed span is blanked out of the text, so that no later alias touches it."""

    def taken(left: Column) -> Column:
        hit = left != state["left"]
        return F.struct(
            left.alias("left"),
            F.when(hit & ~F.array_contains(state["schemes"], row["scheme"]), F.array_append(state["schemes"], row["scheme"])).otherwise(state["schemes"]).alias("schemes"),
            F.when(hit, F.array_append(state["aliases"], row["alias"])).otherwise(state["aliases"]).alias("aliases"),
        )

    return let(F.regexp_replace(state["left"], row["pattern"], row["blank"]), taken)


def _nothing(low: Column) -> Column:
    return F.struct(low.alias("left"), F.array().cast("array<string>").alias("schemes"), F.array().cast("array<string>").alias("aliases"))


def _result(state: Column, low: Column, foreign, in_scope: list[str] | Column) -> Column:
    """``in_scope`` is a list of schemes, or an array of those of the state's that are."""
    none = F.array().cast("array<string>")
    if isinstance(in_scope, Column):
        kept = F.filter(state["schemes"], lambda s: F.array_contains(in_scope, s))
    else:
        kept = F.filter(state["schemes"], lambda s: s.isin(in_scope)) if in_scope else none
    # names are asked for only where there is something to empty
    kept = let(kept, lambda own: F.when((F.size(own) > 0) & foreign_name(low, foreign).isNull(), own).otherwise(none))

    def shape(ids: Column) -> Column:
        one, known = F.size(ids) == 1, F.size(ids) > 0
        return F.struct(
            ids.alias("scheme_ids"),
            F.when(one, F.get(state["aliases"], F.lit(0))).when(known, F.array_join(state["aliases"], ",")).alias("matched_alias"),
            F.when(one, 0.95).when(known, 0.6).otherwise(0.0).alias("confidence"),
            (~one).alias("ambiguous"),
        )

    return let(kept, shape)


#: Letters and digits, of which the tokens of texts and aliases are made.
TOKEN = "[a-z0-9]+"
#: Most tokens of an alias, as texts are asked for runs of as many tokens as aliases have.
MOST_TOKENS = 32


def alias_table(aliases: DataFrame, in_scope: DataFrame) -> DataFrame:
    """alias, scheme, place, in_scope, tokens (joined by spaces), size: the aliases (alias, scheme, place) that can be asked for, each once.

    Of an alias of several schemes the last place's scheme counts, at the first place;
    one without letters or digits matches nothing and is left out.
    """
    once = aliases.where("alias is not null and scheme is not null").groupBy("alias").agg(F.max_by("scheme", "place").alias("scheme"), F.min("place").alias("place"))
    tokens = F.regexp_extract_all("alias", F.lit(TOKEN), F.lit(0))
    told = once.select("alias", "scheme", "place", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).alias("size")).where("size > 0")
    known = in_scope.select(F.col("scheme").alias("_scheme")).distinct().withColumn("in_scope", F.lit(True))
    return staged(told.join(known, told["scheme"] == known["_scheme"], "left").select("alias", "scheme", "place", F.coalesce("in_scope", F.lit(False)).alias("in_scope"), "tokens", "size"), "aliases")


def resolve_rows(rows: DataFrame, text_col: str, aliases: DataFrame, in_scope: DataFrame, to: str = "resolution", foreign=FOREIGN) -> DataFrame:
    """``rows`` with the struct of ``resolve``, for a table of any number of aliases (alias, scheme, place) and schemes in scope (scheme).

    A text is asked for its runs of as many tokens as some alias has: first those whose
    first token begins an alias, then the whole run, an equi-join of tokens. What a text
    may hold comes back to it as a bounded array, whose longest alias claims its span
    first, as in ``resolve``. Aliases of equal length go by place. Null texts are empty,
    repeated rows stay. The plan does not depend on the aliases.
    """
    table = alias_table(aliases, in_scope)
    sizes = sorted(r["size"] for r in table.select("size").distinct().collect())  # MOST_TOKENS at most
    if sizes and sizes[-1] > MOST_TOKENS:
        raise ValueError(f"an alias of {sizes[-1]} tokens; {MOST_TOKENS} at most")
    held = staged(rows.withColumns({"_row": F.monotonically_increasing_id(), "_low": lowered(F.col(text_col))}), "resolve-rows")  # row numbers must not change
    words = held.select("_row", F.regexp_extract_all("_low", F.lit(TOKEN), F.lit(0)).alias("w"))
    starts = words.select("_row", "w", F.posexplode("w").alias("at", "first"))
    begin = table.select(F.substring_index("tokens", " ", 1).alias("first"), "size").distinct().groupBy("first").agg(F.collect_set("size").alias("sizes"))  # MOST_TOKENS sizes at most
    runs = starts.join(begin, "first").select("_row", "w", "at", F.explode("sizes").alias("size")).where(F.col("at") + F.col("size") <= F.size("w"))
    asked = runs.select("_row", F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("tokens")).distinct()
    place = F.struct((-F.char_length("alias")).alias("less"), "place", "alias", "scheme", "in_scope")
    candidates = asked.join(table.drop("size"), "tokens").groupBy("_row").agg(F.array_sort(F.collect_list(place)).alias("_found"))
    told = held.join(candidates, "_row", "left")
    scope = F.transform(F.filter("_found", lambda x: x["in_scope"]), lambda x: x["scheme"])
    claimed = F.aggregate(F.transform("_found", lambda x: _claimable(x["alias"], x["scheme"])), _nothing(F.col("_low")), _claim)
    state = F.when(F.col("_found").isNotNull(), claimed).otherwise(_nothing(F.col("_low")))
    resolution = let(state, lambda s: _result(s, F.col("_low"), foreign, F.coalesce(scope, F.array().cast("array<string>"))))
    return told.withColumn(to, resolution).select(*rows.columns, to)
