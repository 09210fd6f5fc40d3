"""Splitting blocks of texts into words and encoding single words, for tasks.

Both tokenizers used here cut a text into words first and then merge within each
word, so a text's ids are its words' ids in order. A block of texts is cut by
Arrow, each distinct white-space chunk of the block is looked at once, and what
is left for each position is a gather of numbers.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts of these characters alone are in NFC, and every library used agrees on
#: their letters, digits, case and white space. Others take the tokenizer's own
#: normaliser and splitter.
PLAIN = (
    r"\t-\r -~\x{A0}-\x{12F}\x{131}-\x{1C3}\x{1CD}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}"
    r"\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}"
)
NOT_PLAIN = f"[^{PLAIN}]"
#: Marks of which one behind letters is a word of its own.
MARKS = frozenset(".,;:!?)\"")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    letters = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    for b in range(256):
        letters.setdefault(b, chr(256 + sum(x >= 256 for x in map(ord, letters.values()))))
    return letters


_LETTERS = byte_letters()


def spelled(word: str) -> str:
    """``word`` in byte letters, as the merge model reads it."""
    if word.isascii() and " " not in word and word.isprintable():
        return word
    return "".join(map(_LETTERS.__getitem__, word.encode("utf-8", "replace")))


def gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[starts[i] : starts[i] + lengths[i]] of each item in turn, and each item's length."""
    each = lengths[items]
    total = int(each.sum())
    kind = np.int32 if max(total, len(values)) < 2**31 - 1 else np.int64
    at = np.repeat((starts[items] - (np.cumsum(each) - each)).astype(kind), each)
    at += np.arange(total, dtype=kind)
    return values[at], each


def flattened(lists: list, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, values) of a list of lists."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    values = np.fromiter((x for one in lists for x in one), kind, int(lengths.sum()))
    return np.cumsum(lengths) - lengths, lengths, values


def slices(column, most_bytes: int):
    """(start, stop) of runs of rows of a string column of about ``most_bytes`` each; a longer row is a run alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most_bytes:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


class WordTokenizer:
    """A tokenizer file of normaliser (NFC, white space, lower case), word pattern and byte-level merges."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split = [p for p in file["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        if len(split) != 1 or not split[0]["invert"] or split[0]["behavior"] != "Removed" or file["post_processor"] or file["decoder"]:
            raise ValueError(f"{path}: only word patterns that keep what they match, without post-processor and decoder, are supported")
        pattern = split[0]["pattern"]["Regex"]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.pattern = regex.compile(pattern)
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.specials = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def words_slowly(self, text: str) -> list[str]:
        """The words of any text, by the tokenizer's own parts; a special token's string is a word."""
        words = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.specials:
                words.append(part)
            elif part:
                words += [w for w, _ in self.splitter.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
        return words

    def split(self, texts, part_bytes: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Of an Arrow string array without nulls: all words' codes in order, the number of words of each text, and the distinct words by code.

        Texts are cut in parts of about ``part_bytes``, which bounds what is held beside the result.
        """
        index: dict[str, int] = {}
        parts = [self._split(texts.slice(a, b - a), index) for a, b in slices(texts, part_bytes)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), []
        codes, counts = zip(*parts, strict=True)
        return np.concatenate(codes), np.concatenate(counts), list(index)

    def chunks(self, texts) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(distinct white-space chunks, their codes in text order, each text's first and end place in the codes, which texts must be taken whole).

        Texts that must be taken whole have no chunks.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        slow = pc.match_substring_regex(texts, NOT_PLAIN)
        for special in self.specials:
            slow = pc.or_(slow, pc.match_substring(texts, special))
        slow = slow.to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(slow), "", texts) if slow.any() else texts
        lists = pc.utf8_split_whitespace(plain)
        found = lists.flatten().dictionary_encode()
        return found.dictionary.to_pylist(), found.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), slow

    def _split(self, texts, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        names, indices, offsets, slow = self.chunks(texts)
        find, code = self.pattern.findall, index.setdefault
        parts = [[code(w, len(index)) for w in find(chunk.lower())] for chunk in names]
        codes, each = gather(*flattened(parts, np.int32), indices)
        upto = np.concatenate([[0], np.cumsum(each)])
        counts = upto[offsets[1:]] - upto[offsets[:-1]]
        if slow.any():
            at, pieces = np.cumsum(counts) - counts, []
            for i in range(len(counts)):
                if slow[i]:
                    own = [code(w, len(index)) for w in self.words_slowly(texts[i].as_py())]
                    pieces.append(np.array(own, np.int32))
                    counts[i] = len(own)
                else:
                    pieces.append(codes[at[i] : at[i] + counts[i]])
            codes = np.concatenate(pieces)
        return codes, counts

    def ids(self, word: str) -> list[int]:
        if word in self.specials:
            return [self.specials[word]]
        return [t.id for t in self.model.tokenize(spelled(word))]


class CachedEncoder:
    """Encodes blocks of texts through a cache from white-space chunks to their ids.

    The cache outlives batches and tasks of a worker; it starts anew before a block
    once it holds ``most`` chunks, so it is bounded by that and one block's chunks.
    What it holds bears on speed alone.
    """

    def __init__(self, path: str, most: int):
        self.tokenizer, self.most = WordTokenizer(path), most
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.of_word: dict[str, list[int]] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _words(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The words of a chunk: letters alone or with one mark behind them need no pattern."""
        if chunk.isalpha():
            return (chunk.lower(),)
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return chunk[:-1].lower(), chunk[-1]
        return self.tokenizer.pattern.findall(chunk.lower())

    def _learn(self, chunks: list[str]) -> None:
        words, known, tokenize = self._words, self.of_word, self.tokenizer.model.tokenize
        ids, ends, code = self.ids, self.ends, self.code
        for chunk in chunks:
            for word in words(chunk):
                own = known.get(word)
                if own is None:  # no special token and no white space is in a chunk
                    own = known[word] = [t.id for t in tokenize(word if word.isascii() else spelled(word))]
                ids.extend(own)
            ends.append(len(ids))
            code[chunk] = len(code)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Of an Arrow string array without nulls: all ids in order, and the place in them where each text ends."""
        if len(self.code) >= self.most:
            self._clear()
        names, indices, offsets, slow = self.tokenizer.chunks(texts)
        known = self.code
        self._learn([c for c in names if c not in known])
        codes = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        ends = np.frombuffer(self.ends, np.int64)
        ids, each = gather(ends[:-1], np.diff(ends), np.frombuffer(self.ids, np.uint32), codes[indices])
        upto = np.concatenate([[0], np.cumsum(each)])[offsets]
        if not slow.any():
            return ids, upto[1:]
        parts = []
        for i, whole in enumerate(slow):
            parts.append(np.array([x for w in self.tokenizer.words_slowly(texts[i].as_py()) for x in self.tokenizer.ids(w)], np.uint32) if whole else ids[upto[i] : upto[i + 1]])
        return np.concatenate(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
