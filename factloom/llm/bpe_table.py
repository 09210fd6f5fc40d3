"""BPE encoding and decoding through a table of distinct words.

1. Split: each task cuts blocks of whole texts into words and stores, for each
   block, its documents, its words' codes in text order and its distinct words.
   Block files lie in the shared folder and their list is stored, so everything
   later reads the same blocks however often a task runs again.
2. Word table: (word, block, code) rows, one for each distinct word of a block,
   are dealt and sorted by word; a word's rows lie together, and it is encoded
   once, at the first of them. A word that all texts share has one row for each
   block of about 16 MB, so no word makes a task large.
3. Ids to pieces: the distinct ids of what a task encoded are joined with the
   vocabulary, a table of ids and pieces, and go on with their pieces.
4. Back by position: a block's packets meet; its codes turn into ids by one gather,
   and its words into text by the pieces that came with them.

Nothing is broadcast but the id-to-piece table of the vocabulary, whose size the
tokenizer file fixes.
"""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.shared import filesystem, give_back, shared_folder, stored, tidy, write_atomically
from factloom.llm.tokens import WordTokenizer, gather, slices

BLOCK_BYTES = 16 << 20
#: Bytes of packed ids that a task holds before it passes them on.
PACKED_BYTES = 16 << 20

_workers: dict = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def _pack(*parts: bytes) -> list[bytes]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    return [compress(p) for p in parts]


def _planes(codes: np.ndarray) -> bytes:
    return np.ascontiguousarray(codes, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _codes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def write_blocks(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """Stores the blocks; returns their list: block, path, words."""
    folder = shared_folder(docs.sparkSession, "blocks")

    def split(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for start, stop in slices(texts, BLOCK_BYTES):
                codes, counts, words = _tokenizer(tokenizer_path).split(texts.slice(start, stop - start))
                order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words get small codes
                rank = np.empty(len(words), np.int32)
                rank[order] = np.arange(len(words), dtype=np.int32)
                ids = batch.column(0).slice(start, stop - start)
                known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                parts = _pack(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), known.tobytes(), counts.astype("<i8").tobytes(), _planes(rank[codes]), "\n".join(words[i] for i in order).encode())
                path = f"{folder}/part-{part:06d}-{n:06d}.words"

                def fill(out, parts=parts):
                    out.write(struct.pack("<5Q", *map(len, parts)))
                    for p in parts:
                        out.write(p)

                write_atomically(path, fill)
                del codes, rank, parts
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([pa.array([(part << 24) + n]), pa.array([path]), pa.array([len(words)])], names=["block", "path", "words"])
                n += 1

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return stored(rows.mapInArrow(tidy(split), "block long, path string, words long"), "block-list")


def _read_block(path: str, which: tuple[int, ...]) -> list[bytes]:
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    store, name = filesystem(path)
    with store.open_input_file(name) as f:
        sizes = struct.unpack("<5Q", f.read(40))
        out = []
        for i in which:
            f.seek(40 + sum(sizes[:i]))
            out.append(decompress(f.read(sizes[i])))
        return out


def block_words(blocks: DataFrame) -> DataFrame:
    """(word, block, code) for each distinct word of each block."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for block, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (text,) = _read_block(path, (4,))
                words = text.decode().split("\n") if text else []
                for i in range(0, len(words), 50_000):
                    own = words[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(np.full(len(own), block)), pa.array(np.arange(i, i + len(own), dtype=np.int32))], names=["word", "block", "code"])

    return spread(blocks).select("block", "path").mapInArrow(tidy(read), "word string, block long, code int")


def spread(blocks: DataFrame) -> DataFrame:
    """The block list, a few blocks to a task."""
    n = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(n, "block")


def encoded_words(pairs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Packets of (block; codes, numbers of ids, ids, own distinct ids), each distinct word encoded once; the first of those that are passed on together has all their distinct ids too.

    ``pairs`` are dealt by word here; within a task a word's rows are neighbours.
    """

    def encode(batches):
        import pyarrow as pa

        ids = _tokenizer(tokenizer_path).ids
        held: dict[int, list] = {}
        size, last, made = 0, None, np.zeros(0, "<u2")

        def packets():
            rows = []
            for block, (codes, lengths, runs) in held.items():
                own = np.frombuffer(b"".join(runs), "<u4")
                known = np.unique(own)
                rows.append((block, *_pack(_planes(np.array(codes)), np.array(lengths, "<u2").tobytes(), _planes(own), known.tobytes()), known))
            held.clear()
            every = np.unique(np.concatenate([r[5] for r in rows])).astype(np.int32)
            distinct = pa.array([every if n == 0 else [] for n in range(len(rows))], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4)], distinct], names=["block", "codes", "lengths", "ids", "known", "distinct"])

        for batch in batches:
            for word, block, code in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if word != last:
                    last, run = word, ids(word)
                    n, made = len(run), np.array(run, "<u4").tobytes()
                codes, lengths, runs = held.setdefault(block, ([], [], []))
                # a word of more than 65,535 ids goes in parts
                for at in range(0, max(n, 1), 65_535):
                    part = made[4 * at : 4 * (at + 65_535)]
                    codes.append(code)
                    lengths.append(len(part) // 4)
                    runs.append(part)
                    size += 40 + len(part)
            if size > PACKED_BYTES:
                yield packets()
                size = 0
        if held:
            yield packets()

    by_word = pairs.repartition("word").sortWithinPartitions("word")
    return by_word.mapInArrow(tidy(encode), "block long, codes binary, lengths binary, ids binary, known binary, distinct array<int>")


def vocabulary(tokenizer_path: str) -> dict[int, str]:
    """The piece of each id, special ones too."""
    with open(tokenizer_path, encoding="utf-8") as f:
        file = json.load(f)
    return {i: p for p, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}


def pieces(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """The vocabulary as a table: id, piece."""
    return spark.createDataFrame(list(vocabulary(tokenizer_path).items()), "id int, piece string")


def with_pieces(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows with an id, joined with their pieces: the vocabulary has as many rows as the tokenizer file has ids. Rows of ids outside of it are left out."""
    return rows.join(F.broadcast(pieces(rows.sparkSession, tokenizer_path)), "id")


def packets_with_pieces(packets: DataFrame, tokenizer_path: str) -> DataFrame:
    """The packets with the pieces of their ids: a row for each distinct id of a task is joined with the vocabulary where it is, then packets take theirs.

    The columns of the packet that brings the ids go with the first of them alone.
    """
    own = ("codes", "lengths", "ids", "known")
    at = packets.select("*", F.posexplode_outer("distinct").alias("_pos", "id")).drop("distinct")
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    told = at.select("block", *[F.when(first, F.col(c)).alias(c) for c in own], F.coalesce("_pos", F.lit(0)).alias("_pos"), "id")
    joined = told.join(F.broadcast(pieces(packets.sparkSession, tokenizer_path)), "id", "left").select("block", *own, "_pos", "id", "piece")

    def take(batches):
        import pyarrow as pa
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        piece_of: dict[int, str] = {}
        held: tuple | None = None

        def packet():
            texts = [piece_of[i] for i in np.frombuffer(decompress(held[4]), "<u4").tolist()]
            columns = [pa.array([held[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in (*held[1:], *_pack("\n".join(texts).encode()))]]
            return pa.RecordBatch.from_arrays(columns, names=["block", *own, "pieces"])

        for batch in batches:
            places, ids, texts = batch.column(5).to_numpy(), batch.column(6).to_pylist(), batch.column(7).to_pylist()
            starts = np.flatnonzero(places == 0).tolist()
            if starts[:1] != [0]:
                starts.insert(0, 0)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if a == b:
                    continue
                if places[a] == 0:
                    if held is not None:
                        yield packet()
                    held = tuple(batch.column(i)[a].as_py() for i in range(5))
                    if ids[a] is not None:
                        piece_of = {}
                elif held is None or places[a] != len(piece_of):
                    raise RuntimeError("the ids of a task came apart")
                if ids[a] is not None:
                    piece_of.update(zip(ids[a:b], texts[a:b], strict=True))
        if held is not None:
            yield packet()

    return joined.mapInArrow(tidy(take), "block long, codes binary, lengths binary, ids binary, known binary, pieces binary")


def decode(rows: DataFrame, tokenizer_path: str, key: str, ids_col: str = "ids") -> DataFrame:
    """(key, text) of rows with an array of ids, by a join with the id-to-piece table.

    As the library does without a decoder: pieces joined by a space, special ones
    too; ids outside the vocabulary are left out, no ids or null give "". ``key``
    must be unique.
    """
    joined = with_pieces(rows.select(key, F.posexplode(ids_col).alias("_pos", "id")), tokenizer_path)
    texts = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "piece"))).alias("_pieces")).select(key, F.array_join(F.col("_pieces.piece"), " ").alias("text"))
    return rows.select(key).join(texts, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, finish, schema: str) -> DataFrame:
    """Runs ``finish(doc_ids, ids of all texts, ends, decoded words, their codes, code ends)`` on each block."""
    blocks = write_blocks(docs, tokenizer_path, id_col, text_col)
    packets = packets_with_pieces(encoded_words(block_words(blocks), tokenizer_path), tokenizer_path)

    def assemble(key, left, right):
        import pyarrow as pa
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        ids, known, counts, planes = _read_block(left.column("path")[0].as_py(), (0, 1, 2, 3))
        counts = np.frombuffer(counts, "<i8")
        codes, lengths, runs = [], [], []
        piece_of: dict[int, str] = {}
        for c, n, r, i, p in zip(*[right.column(x).to_pylist() for x in ("codes", "lengths", "ids", "known", "pieces")], strict=True):
            codes.append(_codes(decompress(c)))
            lengths.append(np.frombuffer(decompress(n), "<u2").astype(np.int64))
            runs.append(_codes(decompress(r)))
            if i := np.frombuffer(decompress(i), "<u4").tolist():
                piece_of.update(zip(i, decompress(p).decode().split("\n"), strict=True))
        n_words = left.column("words")[0].as_py()
        if n_words:
            codes, lengths, runs = np.concatenate(codes), np.concatenate(lengths), np.concatenate(runs)
            order = np.argsort(codes, kind="stable")
            values, part = gather(np.cumsum(lengths) - lengths, lengths, runs, order)
            total = np.bincount(codes[order], weights=part, minlength=n_words).astype(np.int64)
            if len(np.unique(codes)) != n_words:
                raise RuntimeError("a block's words came back incomplete")
        else:
            values, total = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        starts = np.cumsum(total) - total
        piece = list(map(piece_of.__getitem__, values.tolist()))
        words = [" ".join(piece[a:b]) for a, b in zip(starts.tolist(), (starts + total).tolist(), strict=True)]
        known = np.frombuffer(known, np.uint8)
        doc_ids = [i if k else None for i, k in zip(np.frombuffer(ids, "<i8").tolist(), known.tolist(), strict=True)]
        in_order = _codes(planes).astype(np.int32)
        rows, at = [], 0
        for doc, n in zip(doc_ids, counts.tolist(), strict=True):
            own = in_order[at : at + n]
            at += n
            rows.append(finish(doc, gather(starts, total, values, own)[0], own, words))
        out = pa.Table.from_pylist(rows, schema=arrow_schema)
        del rows, codes, lengths, runs, values, piece, words, in_order, left, right
        give_back()
        return out

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct_type = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(struct_type)
    return blocks.groupBy("block").cogroup(packets.groupBy("block")).applyInArrow(assemble, struct_type)


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256.

    The hashes are of the ids as little-endian 32-bit integers and of the decoded
    text in UTF-8. A null text is empty: no ids, the hashes of nothing. Null ids
    and repeated rows pass through; other columns are not read; an empty table
    gives no rows.
    """

    def finish(doc, ids, codes, words):
        text = " ".join([words[c] for c in codes.tolist()])
        return {id_col: doc, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.ascontiguousarray(ids, "<u4")).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}

    return encode_documents(docs, tokenizer_path, id_col, text_col, finish, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id and the array of ids of its text."""

    def finish(doc, ids, codes, words):
        return {id_col: doc, "ids": ids.tolist()}

    return encode_documents(docs, tokenizer_path, id_col, text_col, finish, f"`{id_col}` long, ids array<int>")
