"""Token ids in binary files of bit- or byte-plane shuffled, compressed blocks.

A file holds ids of whole documents in id order. Each run of ``block`` ids is one
chunk: the 32-bit ids are transposed into 4 byte planes or 32 bit planes, and
each plane is compressed by itself with zstandard, so that planes which are all
zero or slowly changing take next to nothing. The index behind the chunks gives
every chunk's place, its planes' lengths and its number of ids, and every
document's id and number of ids; the last 16 bytes give the index's place. A
reader decompresses one chunk at a time.

    magic "PLNSTOR1" | planes of chunk 0 | planes of chunk 1 | ... | index (zstandard, JSON head + arrays) | index length u64 | magic
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.shared import discard, filesystem, shared_folder, stored, write_atomically
from factloom.llm.tokens import CachedEncoder, slices

MAGIC = b"PLNSTOR1"
BLOCK_IDS = 1 << 16
BLOCK_BYTES = 16 << 20
#: White-space chunks that a worker keeps encoded; beyond it the cache starts anew.
CACHE_CHUNKS = 400_000


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    as_bytes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [p.tobytes() for p in as_bytes]
    return [np.packbits((as_bytes[i // 8] >> (i % 8)) & 1).tobytes() for i in range(32)]


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4") if n else np.zeros(0, "<u4")
    out = np.zeros((n, 4), np.uint8)
    for i, p in enumerate(planes):
        out[:, i // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (i % 8)
    return out.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes documents' ids to a stream; holds one block of ids and the index."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK_IDS, level: int = 3):
        import zstandard

        if kind not in ("byte", "bit"):
            raise ValueError(f"planes are 'byte' or 'bit', not {kind!r}")
        self.out, self.kind, self.block = out, kind, block
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.at, self.chunks, self.docs = len(MAGIC), [], []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            ready = np.concatenate(self.waiting)
            whole = len(ready) // self.block * self.block
            for i in range(0, whole, self.block):
                self._chunk(ready[i : i + self.block])
            self.waiting, self.n_waiting = [ready[whole:]], len(ready) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.compress(p) for p in planes_of(ids, self.kind)]
        self.chunks.append((self.at, len(ids), [len(p) for p in packed]))
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_waiting:
            self._chunk(np.concatenate(self.waiting))
        known = np.array([d is not None for d, _ in self.docs], np.uint8)
        arrays = [np.array([d or 0 for d, _ in self.docs], "<i8"), known, np.array([n for _, n in self.docs], "<u8")]
        head = json.dumps({"planes": self.kind, "block": self.block, "chunks": self.chunks, "docs": len(self.docs)}).encode()
        index = self.compress(struct.pack("<Q", len(head)) + head + b"".join(a.tobytes() for a in arrays))
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


class PlaneReader:
    """Reads a file of ``PlaneWriter`` from a seekable stream."""

    def __init__(self, f):
        import zstandard

        self.f, self.decompress = f, zstandard.ZstdDecompressor().decompress
        f.seek(0, 2)
        size = f.tell()
        f.seek(size - 16)
        tail = f.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or cut off")
        (n,) = struct.unpack("<Q", tail[:8])
        f.seek(size - 16 - n)
        index = self.decompress(f.read(n))
        (n,) = struct.unpack("<Q", index[:8])
        self.head = json.loads(index[8 : 8 + n])
        docs, rest = self.head["docs"], index[8 + n :]
        self.doc_ids = np.frombuffer(rest, "<i8", docs)
        self.known = np.frombuffer(rest, np.uint8, docs, 8 * docs)
        self.lengths = np.frombuffer(rest, "<u8", docs, 9 * docs).astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.head["chunks"][k]
        self.f.seek(at)
        return ids_of([self.decompress(self.f.read(s)) for s in sizes], n, self.head["planes"])

    def documents(self):
        """(doc_id, its ids in one or more runs) in file order, a chunk in memory at a time."""
        k, have, used = 0, np.zeros(0, "<u4"), 0
        for doc, known, length in zip(self.doc_ids.tolist(), self.known.tolist(), self.lengths.tolist(), strict=True):
            runs = []
            while length:
                if used == len(have):
                    have, used, k = self.chunk(k), 0, k + 1
                take = min(length, len(have) - used)
                runs.append(have[used : used + take])
                used, length = used + take, length - take
            yield (doc if known else None), runs


_workers: dict = {}


def _encoder(tokenizer_path: str) -> CachedEncoder:
    if tokenizer_path not in _workers:
        _workers[tokenizer_path] = CachedEncoder(tokenizer_path, CACHE_CHUNKS)
    return _workers[tokenizer_path]


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """_id, _hash (of the text) and _ids of each row: a text's ids as byte planes of 16-bit integers where the vocabulary fits in them, else of 32-bit ones, packed.

    A null text is empty. Texts are encoded where they are read; nothing moves.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        file = json.load(f)
    most = max([end_id or 0, *file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])])
    kind = "<u2" if most < 1 << 16 else "<u4"

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard

        pack, end = zstandard.ZstdCompressor(level=1).compress, np.array([] if end_id is None else [end_id], kind)
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            packed = []
            for start, stop in slices(texts, BLOCK_BYTES):
                ids, ends = _encoder(tokenizer_path).encode(texts.slice(start, stop - start))
                ids, ends = ids.astype(kind), ends.tolist()
                for a, b in zip([0, *ends], ends, strict=False):
                    packed.append(pack(np.append(ids[a:b], end).view(np.uint8).reshape(-1, end.itemsize).T.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["_id", "_hash", "_ids"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    return rows.mapInArrow(run, "_id long, _hash long, _ids binary").withColumn("_wide", F.lit(kind == "<u4"))


def write_token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, planes: str = "byte", block: int = BLOCK_IDS) -> DataFrame:
    """Encodes every text and writes the files; returns their list: file_no, path, n_docs, n_ids.

    Texts are encoded first and the ids stored, so a text is encoded once and only
    ids are dealt out. Files hold ascending ids, and a later file_no holds later ids:
    rows are dealt by ranges of the id (nulls first; equal ids by a hash of their
    text, so that an id which very many rows have may span files). A null text is
    empty and gets the end id alone. Other columns are not read. An empty table
    gives no files. The list is stored: files are written by whole files, and an
    attempt that is run again replaces its own.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")

    def write(batches):
        import pyarrow as pa

        part, made = TaskContext.get().partitionId(), []
        first = next(batches, None)
        if first is None:
            return

        def rows():
            yield first
            yield from batches

        def fill(out):
            import zstandard

            unpack = zstandard.ZstdDecompressor().decompress
            writer = PlaneWriter(out, planes, block)
            total = 0
            for batch in rows():
                for doc, ids, wide in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    size = 4 if wide else 2
                    ids = np.ascontiguousarray(np.frombuffer(unpack(ids), np.uint8).reshape(size, -1).T).view(f"<u{size}").reshape(-1).astype(np.uint32)
                    writer.add(doc, ids)
                    total += len(ids)
            writer.close()
            made.append((part, f"{folder}/part-{part:06d}.planes", len(writer.docs), total))

        write_atomically(f"{folder}/part-{part:06d}.planes", fill)
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made]) for i in range(4)], names=["file_no", "path", "n_docs", "n_ids"])

    ids = stored(encoded(docs, tokenizer_path, id_col, text_col, end_id), "token-ids")
    ranged = ids.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash").select("_id", "_ids", "_wide")
    files = stored(ranged.mapInArrow(write, "file_no long, path string, n_docs long, n_ids long"), "token-files")
    discard(ids)
    return files


def read_token_files(files: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """A row for each document in the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only the list of files is put in order in one place; files are read in parallel,
    each chunk by chunk.
    """
    from pyspark.sql import Window

    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.where("n_docs > 0").select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), F.row_number().over(Window.orderBy("file_no")).alias("_n"))
    dealt = placed.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_n").select("path", "start")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = filesystem(path)
                with store.open_input_file(name) as f:
                    rows = []
                    for doc, runs in PlaneReader(f).documents():
                        crc, n = 0, 0
                        for run in runs:
                            crc, n = zlib.crc32(np.ascontiguousarray(run, "<u4").tobytes(), crc), n + len(run)
                        rows.append((doc, start, n, crc))
                        start += n
                        if len(rows) == 10_000:
                            yield _batch(pa, rows, id_name)
                            rows = []
                    if rows:
                        yield _batch(pa, rows, id_name)

    return dealt.mapInArrow(read, f"{id_name} long, start long, n_tokens long, ids_crc32 long")


def _batch(pa, rows: list[tuple], id_name: str):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[id_name, "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, planes: str = "byte") -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer_path, id_col, text_col, end_id, planes), id_col)


def read_ids(spark: SparkSession, files: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """The documents' ids themselves: id and an array of ids in the files' order."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = filesystem(path)
                with store.open_input_file(name) as f:
                    for doc, runs in PlaneReader(f).documents():
                        ids = [int(x) for run in runs for x in run]
                        yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=[id_name, "ids"])

    return files.where("n_docs > 0").select("path").mapInArrow(read, f"{id_name} long, ids array<long>")
