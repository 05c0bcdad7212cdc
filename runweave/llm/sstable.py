"""Sorted-string-table shards of token ids, keyed by document identifier.

Shard layout, all numbers little-endian:

- data blocks: entries in key order, each ``varint shared, varint unshared,
  varint value length, key suffix, value``; the first entry of a block shares
  nothing. A block is compressed as a whole and followed by its crc32.
- Bloom filter: bits over the distinct keys, ``hashes`` probes from one 128-bit digest.
- index: per block ``u64 offset, u32 stored size, u32 raw size, u32 entries,
  u64 ids before it, u8 key length, first key``.
- footer of 56 bytes: offsets and sizes of filter and index, counts, id width, magic.

A key is the identifier as eight big-endian bytes with the sign bit flipped,
so byte order is numeric order; a null identifier has the empty key.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import tokenizer_file, word_encoder
from .shared import shared_dir, written

MAGIC = b"SSTOK001"
FOOTER = struct.Struct("<QQQQQIHH8s")
ENTRY = struct.Struct("<QIIIQB")
#: Most tasks that read shards, and shards in a broadcast block of the manifest.
READERS, SHARDS = 10_000, 100_000
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, first_id long, last_id long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _take(raw: bytes, at: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    """Bits over keys: no false negatives, about one false positive in a hundred."""

    def __init__(self, bits: np.ndarray, hashes: int = 7):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def of(cls, keys: list[bytes], per_key: int = 10, hashes: int = 7) -> Bloom:
        self = cls(np.zeros(max(8, (len(keys) * per_key + 7) // 8), np.uint8), hashes)
        for k in keys:
            for p in self._places(k):
                self.bits[p >> 3] |= 1 << (p & 7)
        return self

    def _places(self, key: bytes) -> list[int]:
        a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
        return [(a + i * (b | 1)) % (len(self.bits) * 8) for i in range(self.hashes)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Writer:
    """Writes one shard; entries must come in key order."""

    def __init__(self, out, width: int, block_bytes: int):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.block, self.last, self.entries = bytearray(), b"", 0
        self.index, self.keys, self.at = [], [], 0
        self.n_docs = self.n_tokens = self.block_tokens = 0
        self.first = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.block_tokens = key, self.n_tokens
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last, self.entries = key, self.entries + 1
        self.n_docs += 1
        self.n_tokens += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            raw = bytes(self.block)
            stored = pa.compress(raw, codec="zstd", asbytes=True)
            self.out.write(stored + struct.pack("<I", zlib.crc32(stored)))
            self.index.append((self.at, len(stored), len(raw), self.entries, self.block_tokens, self.first))
            self.at += len(stored) + 4
            self.block, self.entries, self.last = bytearray(), 0, b""

    def close(self) -> None:
        self._flush()
        bloom = Bloom.of(self.keys)
        raw = bloom.bits.tobytes()
        index = b"".join(ENTRY.pack(*x[:5], len(x[5])) + x[5] for x in self.index)
        self.out.write(raw + index)
        self.out.write(FOOTER.pack(self.at, len(raw), self.at + len(raw), len(index), self.n_tokens, self.n_docs, self.width, bloom.hashes, MAGIC))
        self.out.close()


class Reader:
    """Reads a shard: footer, filter and index at once, blocks as they are asked for."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - FOOTER.size)
        bloom_at, bloom_n, index_at, index_n, self.n_tokens, self.n_docs, self.width, hashes, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(bloom_at)
        raw = file.read(bloom_n + index_n)
        self.bloom = Bloom(np.frombuffer(raw[:bloom_n], np.uint8), hashes)
        self.index, at = [], bloom_n
        while at < len(raw):
            *entry, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            self.index.append((*entry, raw[at : at + n]))
            at += n
        self.firsts = [x[5] for x in self.index]

    def block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """Key, ids of the shard before it, and ids of each entry of block ``k``."""
        at, stored, size, entries, before, _ = self.index[k]
        self.file.seek(at)
        data = self.file.read(stored + 4)
        if zlib.crc32(data[:stored]) != struct.unpack("<I", data[stored:])[0]:
            raise ValueError("damaged block")
        raw, at, key = pa.decompress(data[:stored], decompressed_size=size, codec="zstd", asbytes=True), 0, b""
        for _ in range(entries):
            shared, at = _take(raw, at)
            own, at = _take(raw, at)
            n, at = _take(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            ids = np.frombuffer(raw, f"<u{self.width}", n // self.width, at).astype("<u4")
            at += n
            yield key, before, ids
            before += len(ids)

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, key: bytes) -> list[np.ndarray]:
        """All values of a key: filter, binary search of the index, then the blocks that may hold it."""
        if key not in self.bloom:
            return []
        k, out = max(0, bisect_right(self.firsts, key) - 1), []
        while k and self.firsts[k] == key:
            k -= 1
        for j in range(k, len(self.index)):
            if self.firsts[j] > key:
                break
            out += [ids for own, _, ids in self.block(j) if own == key]
        return out


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, folder: str, *, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 64 << 10, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encodes whole texts and writes them as shards in ascending identifier order.

    Returns the manifest, one row per shard, itself a written table; only shards
    that it names count, so files of lost or repeated attempts do no harm.
    ``folder`` is any URI that pyarrow's file systems and all executors reach.

    Range partitioning carries the text hash behind the identifier, so one
    identifier that many rows share is split as well. Null texts count as
    empty, every text gets ``end_id``; rows with one identifier all stay, in the
    order of their text's hash; a null identifier comes first; an empty table
    writes no shards; other columns are not read.
    """
    path = tokenizer or tokenizer_file("word_bpe_49k.json")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, writer, rows = word_encoder(path), TaskContext.get().partitionId(), 0, None, []
        width = 2 if max(encoder.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        store, base = _fs(folder)
        store.create_dir(base, recursive=True)

        def closed() -> None:
            nonlocal writer, seq
            if writer:
                writer.close()
                rows.append((part, seq, name, writer.n_docs, writer.n_tokens, id_of(writer.keys[0]), id_of(writer.keys[-1])))
                writer, seq = None, seq + 1

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                cut = batch.slice(lo, 500)
                for doc, raw in zip(cut.column(0).to_pylist(), encoder.encode(cut.column(1).to_pylist())):
                    if writer is None:
                        name = f"{folder}/shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                        writer = Writer(store.open_output_stream(_fs(name)[1]), width, block_bytes)
                    writer.add(key_of(doc), np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)))
                    if writer.at >= shard_bytes:
                        closed()
        closed()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.spark_partition_id().alias("p"))
    ordered = rows.repartitionByRange("doc_id", "h", "p").sortWithinPartitions("doc_id", "h", "p")
    return written(ordered.select("doc_id", "text").mapInArrow(task, MANIFEST), "manifest")


def read_shards(manifest: DataFrame, width: int | None = None) -> DataFrame:
    """Every document of the shards, block by block: doc_id, start, n_tokens, ids (binary).

    ``start`` counts the ids of all documents before it over all shards. The
    running sum goes over the manifest, a row of some bytes per shard, in one task;
    the shards are then dealt to as many tasks as there are shards, READERS at most.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = _fs(name)
                with store.open_input_file(path) as file:
                    reader = Reader(file)
                    for k in range(len(reader.index)):
                        rows = [(id_of(key), base + before, len(ids), ids.tobytes()) for key, before, ids in reader.block(k)]
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("long")))
    return based.select("path", "base").repartition(max(1, min(READERS, manifest.count()))).mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, keys: DataFrame, *, key_col: str = "doc_id") -> DataFrame:
    """Values of the asked identifiers: doc_id, ids. Opens only the shards whose range holds a key.

    The manifest is broadcast in blocks of SHARDS rows, in which a key finds its shards
    by binary search; within a shard each key costs one filter probe, one binary
    search and the blocks that can hold it. Identifiers that no shard has give no
    row; a null one finds the rows without identifier; repeated ones are asked once.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            rows = []
            for name, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != opened:
                    store, path = _fs(name)
                    reader, opened = Reader(store.open_input_file(path)), name
                rows += [(doc, ids.tobytes()) for ids in reader.get(key_of(doc))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    asked, spark = keys.select(F.col(key_col).cast("long").alias("doc_id")).distinct(), manifest.sparkSession
    hits = None
    shards = manifest.orderBy("part", "seq").select("path", "first_id", "last_id").toLocalIterator()
    while block := list(islice(shards, SHARDS)):
        found = asked.mapInArrow(_holders(spark.sparkContext.broadcast(block)), "path string, doc_id long")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], "doc_id long, ids binary")
    hits = hits.repartition(max(1, min(READERS, manifest.count())), "path").sortWithinPartitions("path")
    return hits.mapInArrow(task, "doc_id long, ids binary")


def _holders(block):
    """(path, doc_id) of the shards whose range holds a key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [(path, key_of(first), key_of(last)) for path, first, last in block.value]
        firsts, lasts = [x[1] for x in shards], [x[2] for x in shards]
        for batch in batches:
            rows = []
            for doc in batch.column(0).to_pylist():
                key = key_of(doc)
                rows += [(shards[k][0], doc) for k in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "doc_id"])

    return task


def token_shards(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Writes shards to the shared folder and reads every document back from them."""
    return read_shards(write_shards(docs, shared_dir(spark, "sstable"), **options))


def shards_digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
