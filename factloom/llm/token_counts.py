"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

The unit of lookup is a space-delimited run of whole pre-tokens (a word with the
space before it and the marks after it). First tier: a table of the corpus's
frequent units and their numbers of tokens, of at most ``FREQUENT`` entries, is
broadcast. Second tier: a unit that is not in it is encoded in the worker, which
keeps a bounded cache. Counts do not depend on what either tier holds.

The frequent units are found over all documents: each task keeps a bounded
summary (units counted, rare ones thrown out as it fills) and passes on its
``SUMMARY`` most frequent; only these meet, so what is shuffled grows with the
number of tasks, not with the pre-tokens.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import slices, spelled

#: Entries of the broadcast table, units each task passes on, units it counts at once, units a worker's cache holds.
FREQUENT, SUMMARY, COUNTED, CACHE = 16_384, 8_192, 100_000, 200_000
BLOCK_BYTES = 8 << 20

#: A text of these characters alone, with no white space before a space, falls into pre-tokens at its spaces.
UNEVEN = r"\s |[^\t-\r -~\x{A0}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}]|[\x{A0}\x{85}]"


class PieceTokenizer:
    """A byte-level BPE file without normaliser: pre-tokens carry the space before them."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.normalizer is not None:
            raise ValueError(f"{path}: a normaliser is not supported here")
        self.model = self.tokenizer.model
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def unit(self, unit: str) -> int:
        return sum(len(self.model.tokenize(spelled(p))) for p in self.find(unit))


def units(texts, specials: list[str]):
    """(units by code, codes in order, units of each text, texts to take whole) of an Arrow string array without nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc

    slow = pc.match_substring_regex(texts, UNEVEN)
    for special in specials:
        slow = pc.or_(slow, pc.match_substring(texts, special))
    slow = slow.to_numpy(zero_copy_only=False)
    even = pc.if_else(pa.array(slow), "", texts) if slow.any() else texts
    lists = pc.split_pattern(even, pattern=" ")
    parts = lists.flatten()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    first = np.zeros(len(parts), bool)
    first[offsets[:-1]] = True  # no space before the first unit of a text; split_pattern gives one part at least
    coded = pc.if_else(pa.array(first), parts, pc.binary_join_element_wise("", parts, " ")).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(offsets), slow


_workers: dict = {}


def _tokenizer(path: str):
    if path not in _workers:
        _workers[path] = PieceTokenizer(path), {}
    return _workers[path]


def frequent_units(docs: DataFrame, tokenizer_path: str, text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """The (about) most frequent units of all texts: unit, n; at most ``most`` rows.

    A unit that makes up more than 1 / COUNTED of a task's units is in that task's
    summary for certain.
    """

    def summary(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        specials = _tokenizer(tokenizer_path)[0].specials
        seen: Counter = Counter()
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for start, stop in slices(texts, BLOCK_BYTES):
                names, codes, _, _ = units(texts.slice(start, stop - start), specials)
                n = np.bincount(codes, minlength=len(names))
                top = np.argsort(-n, kind="stable")[:COUNTED]
                seen.update({names[i]: int(n[i]) for i in top})
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = seen.most_common(SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["unit", "n"])

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(summary, "unit string, n long")
    return parts.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(most)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """A row for each row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text is an empty text of no bytes and no tokens. Special tokens'
    strings inside a text count as the library counts them. Repeated rows and null
    ids pass through; other columns are not read; an empty table gives no rows.
    Texts with characters or white space for which the cut at spaces is not
    certain are encoded whole by the library.
    """
    tokenizer = PieceTokenizer(tokenizer_path)
    names = [r["unit"] for r in frequent_units(docs, tokenizer_path, text_col).collect()]  # FREQUENT rows at most
    table = docs.sparkSession.sparkContext.broadcast({u: tokenizer.unit(u) for u in names})

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        worker, cache = _tokenizer(tokenizer_path)
        frequent = table.value

        def length(unit: str) -> int:
            n = frequent.get(unit)
            if n is None:
                n = cache.get(unit)
                if n is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    n = cache[unit] = worker.unit(unit)
            return n

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            tokens = []
            for start, stop in slices(texts, BLOCK_BYTES):
                own = texts.slice(start, stop - start)
                names, codes, each, slow = units(own, worker.specials)
                lengths = np.fromiter(map(length, names), np.int64, len(names))[codes]
                upto = np.concatenate([[0], np.cumsum(lengths)])
                ends = np.cumsum(each)
                n = upto[ends] - upto[ends - each]
                for i in np.flatnonzero(slow):
                    n[i] = worker.whole(own[int(i)].as_py())
                tokens.append(n)
            n = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            sizes = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n, pa.int64()), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
