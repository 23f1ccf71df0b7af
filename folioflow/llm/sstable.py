"""Token ids in sorted-string-table shards.

Documents are range-partitioned by key (ties by a hash of their text), so the shards in order hold all documents in ascending
key order. Each task streams its partition into one file in the shared folder:

    data blocks   entries of about BLOCK bytes: varint shared key bytes, varint other key bytes, varint value bytes,
                  key suffix, value (the ids, little-endian, 2 or 4 bytes each)
    index         for each block: varint key bytes, last key, varint offset, varint bytes, varint ids before it
    Bloom filter  bits of all keys, PROBES a key
    footer        FOOT: index and filter offsets and sizes, entries, ids, bytes an id, index entries, crc32, magic

A key is one byte (0 for null, else 1) and the id as 8 big-endian bytes with the sign bit turned, so bytes order as ids do.
A file is written under another name and moved, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import bpe
from folioflow.llm.textscan import give_back
from folioflow.session import importable, shared_dir

BLOCK = 1 << 16
BITS_A_KEY, PROBES = 10, 7
FOOT = struct.Struct("<QQQQQQIIII")
MAGIC = 0x53535431


def key_bytes(k: int | None) -> bytes:
    return b"\0" if k is None else b"\1" + (k + (1 << 63)).to_bytes(8, "big")


def key_value(b: bytes) -> int | None:
    return None if b == b"\0" else int.from_bytes(b[1:], "big") - (1 << 63)


def varint(x: int) -> bytes:
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def take(data, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        b = data[at]
        at += 1
        x |= (b & 0x7F) << shift
        if b < 0x80:
            return x, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9747B28C) | 1
    a = (a * 0x9E3779B1 ^ (a >> 15)) & 0xFFFFFFFF
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Entries come in ascending key order; ids are written width bytes each."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.block, self.index, self.keys = bytearray(), bytearray(), []
        self.last, self.at, self.ids, self.block_ids, self.blocks, self.crc = b"", 0, 0, 0, 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if len(self.block) >= BLOCK:
            self._close()
        shared = 0
        if self.block:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last = key
        self.ids += len(value) // self.width

    def _put(self, data) -> None:
        self.sink.write(bytes(data))
        self.crc = zlib.crc32(data, self.crc)
        self.at += len(data)

    def _close(self) -> None:
        if self.block:
            self.index += varint(len(self.last)) + self.last + varint(self.at) + varint(len(self.block)) + varint(self.block_ids)
            self._put(self.block)
            self.block, self.block_ids, self.blocks = bytearray(), self.ids, self.blocks + 1

    def close(self, entries: int) -> None:
        self._close()
        index_at = self.at
        self._put(self.index)
        bloom_at, bits = self.at, max(64, len(self.keys) * BITS_A_KEY)
        filled = np.zeros(bits, bool)
        for k in self.keys:
            filled[probes(k, bits)] = True
        packed = np.packbits(filled).tobytes()
        self._put(struct.pack("<Q", bits) + packed)
        self.sink.write(FOOT.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, entries, self.ids, self.width, self.blocks, self.crc, MAGIC))


class Reader:
    """A shard file opened for scans and lookups; only footer, index and filter are held."""

    def __init__(self, source, size: int):
        self.source = source
        foot = self._read(size - FOOT.size, FOOT.size)
        index_at, index_n, bloom_at, bloom_n, self.entries, self.ids, self.width, blocks, self.crc, magic = FOOT.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw, at, self.blocks = self._read(index_at, index_n), 0, []
        for _ in range(blocks):
            n, at = take(raw, at)
            last = raw[at : at + n]
            where, at = take(raw, at + n)
            size_, at = take(raw, at)
            ids, at = take(raw, at)
            self.blocks.append((last, where, size_, ids))
        raw = self._read(bloom_at, bloom_n)
        self.bits, self.filter = struct.unpack_from("<Q", raw)[0], raw[8:]
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def entries_of(self, block: int):
        """(key, first id's place in the shard, ids) of a block."""
        _, where, size, ids = self.blocks[block]
        raw, at, key = self._read(where, size), 0, b""
        while at < len(raw):
            shared, at = take(raw, at)
            other, at = take(raw, at)
            n, at = take(raw, at)
            key = key[:shared] + raw[at : at + other]
            at += other
            yield key, ids, np.frombuffer(raw, self.dtype, n // self.width, at)
            at += n
            ids += n // self.width

    def scan(self):
        for b in range(len(self.blocks)):
            yield from self.entries_of(b)

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with this key: filter, binary search in the index, then its blocks."""
        k = key_bytes(key)
        if not all(self.filter[p >> 3] >> (7 - (p & 7)) & 1 for p in probes(k, self.bits)):
            return []
        out, b = [], bisect.bisect_left(self.blocks, k, key=lambda x: x[0])
        while b < len(self.blocks):
            for found, _, ids in self.entries_of(b):
                if found == k:
                    out.append(ids)
                elif found > k:
                    return out
            if self.blocks[b][0] > k:
                break
            b += 1
        return out


def open_shard(uri: str) -> Reader:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    source = files.open_input_file(path)
    return Reader(source, source.size())


def _writer(folder: str, vocabulary: str, end: int, key: str, text: str):
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        encoder = bpe.encoder(vocabulary)
        width = 2 if max(encoder.size, end + 1) <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        files, top = fs.FileSystem.from_uri(folder)
        name = f"{top}/shard-{shard:06d}.sst"
        part = f"{name}.{TaskContext.get().taskAttemptId()}"
        writer, sink, rows = None, None, 0
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            if not keys:
                continue
            if writer is None:
                files.create_dir(top, recursive=True)
                sink = files.open_output_stream(part)
                writer = Writer(sink, width)
            texts = batch.column(batch.schema.get_field_index(text))
            step = 512
            for i in range(0, len(keys), step):
                ids, at = encoder.encode(texts.slice(i, step))
                ids = ids.astype(np.uint16 if width == 2 else np.uint32)
                tail = np.array([end], ids.dtype).tobytes()
                for k, (a, b) in zip(keys[i : i + step], zip(at[:-1], at[1:], strict=True), strict=True):
                    writer.add(key_bytes(k), ids[a:b].tobytes() + tail)
            rows += len(keys)
        if writer is not None:
            writer.close(rows)
            sink.close()
            if files.get_file_info(name).type != fs.FileType.NotFound:
                files.delete_file(name)
            files.move(part, name)
            give_back()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/shard-{shard:06d}.sst"], "n_docs": [rows], "n_ids": [writer.ids]}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 2) -> list:
    """Writes all documents to shard files in folder; the manifest (one row a shard, in order) comes to the driver.

    Null keys come first, repeated keys are kept as they are (ordered by a hash of the text), a null text has the end id alone. An empty table
    writes no shard.
    """
    importable(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    dealt = own.repartitionByRange(F.col("k").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("k").asc_nulls_first(), "h", "t").select("k", "t")
    made = dealt.mapInArrow(_writer(folder, vocabulary or bpe.vocabulary(), end, "k", "t"), "shard int, path string, n_docs long, n_ids long")
    return sorted(made.collect(), key=lambda r: r.shard)


def read(spark, manifest: list) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids of every document in the shard files, in the manifest's order.

    A null key comes back as null, a key that was written several times as often, each with its own ids; an empty manifest gives no rows.
    """
    return _scan(spark, manifest, False)


def _scan(spark, manifest: list, digest: bool) -> DataFrame:
    importable(spark)
    base, rows = 0, []
    for r in manifest:
        rows.append((r.path, base))
        base += r.n_ids
    kind = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")

    def run(batches):
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = open_shard(path)
                for b in range(len(shard.blocks)):
                    got = list(shard.entries_of(b))
                    last = [zlib.crc32(ids.astype("<u4").tobytes()) for _, _, ids in got] if digest else [ids.tolist() for _, _, ids in got]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key_value(k) for k, _, _ in got], pa.int64()), pa.array([at + s for _, s, _ in got], pa.int64()), pa.array([len(ids) for _, _, ids in got], pa.int64()), pa.array(last, pa.int64() if digest else pa.list_(pa.int32()))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                    )

    paths = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return paths.mapInArrow(run, kind)


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query: write, then read the files back."""
    from folioflow.sources.tables import table

    return tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of docs (doc_id, text), written to shards and read back.

    Null ids come first, rows of one id in order of a hash of their text, a null text is the end id alone. Other columns play no part, whatever
    their names; an empty table gives none.
    """
    spark = docs.sparkSession
    return _scan(spark, write(docs, shared_dir(spark)), True)
