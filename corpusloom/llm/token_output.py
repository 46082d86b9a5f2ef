"""Token-ID files: one zstandard frame a document, a trailing seek table and a checksum for each frame.

A shard file holds, in ascending doc_id order,

* a zstandard frame for each document: its ids as little-endian unsigned 32-bit integers, the end id last;
* a skippable frame with the documents' ids (and which are null), so that a reader finds a document's frame;
* the seek table of the public zstandard seekable format in a skippable frame: for every frame its compressed size,
  its size and the low 32 bits of the XXH64 of its content.

Any zstandard reader can decompress the whole file; SeekReader decompresses only the frames asked for.

Shards are ranges of doc_id, so their order is the corpus order. Nothing but the manifest (one row a shard) is ever
in one place. A shard is written under a name of the attempt's own and then renamed, so that a repeated task
replaces it whole. Null texts are empty documents (the end id alone), null ids come first, repeated rows are
documents of their own, ordered by text; an empty table gives no documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.pretokens import encoder

#: Fixed values of the zstandard seekable format.
SEEK_FRAME, SEEK_FOOTER, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
DIRECTORY_FRAME = 0x184D2A50

MANIFEST = "shard int, path string, n_docs long, n_ids long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"


def open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes frames to a stream; close() adds the directory and the seek table."""

    def __init__(self, stream, level: int = 3):
        import xxhash
        import zstandard

        self.stream, self.entries, self.keys = stream, [], []
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.digest = lambda data: xxhash.xxh64_intdigest(data) & 0xFFFFFFFF

    def add(self, key: int | None, data: bytes) -> None:
        packed = self.compress(data)
        self.stream.write(packed)
        self.entries.append((len(packed), len(data), self.digest(data)))
        self.keys.append(key)

    def close(self) -> None:
        keys = b"".join(struct.pack("<qB", k or 0, k is None) for k in self.keys)
        self.stream.write(struct.pack("<II", DIRECTORY_FRAME, len(keys)) + keys)
        rows = b"".join(struct.pack("<III", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEK_FOOTER)
        self.stream.write(struct.pack("<II", SEEK_FRAME, len(rows) + len(footer)) + rows + footer)


class SeekReader:
    """Random access to the frames of a file that has read_at(size, offset) and size()."""

    def __init__(self, source):
        import xxhash
        import zstandard

        self.source, end = source, source.size()
        count, flags, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != SEEK_FOOTER or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = source.read_at(12 * count, end - 9 - 12 * count)
        self.entries = list(struct.iter_unpack("<III", table))
        directory = end - 9 - 12 * count - 8 - 9 * count
        self.keys = [None if null else k for k, null in struct.iter_unpack("<qB", source.read_at(9 * count, directory))]
        self.starts, at = [], 0
        for size, _, _ in self.entries:
            self.starts.append(at)
            at += size
        if at + 8 != directory:
            raise ValueError("the seek table doesn't fit the file")
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.digest = lambda data: xxhash.xxh64_intdigest(data) & 0xFFFFFFFF

    def frame(self, i: int) -> bytes:
        size, length, digest = self.entries[i]
        data = self.unpack(self.source.read_at(size, self.starts[i]))
        if len(data) != length or self.digest(data) != digest:
            raise ValueError(f"frame {i} doesn't match its checksum")
        return data

    def find(self, key: int | None) -> list[int]:
        return [i for i, k in enumerate(self.keys) if k == key]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, *, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 8000) -> DataFrame:
    """Encode docs and write them to shard files below path (a folder that all executors see); returns the manifest."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = common.split_count(rows, shard_docs)
    store, top = open_store(path)
    store.create_dir(top)
    end = struct.pack("<I", end_id)

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, where = open_store(path)
        encode, writer, stream, n_ids = encoder(tokenizer_path).encode, None, None, 0
        final, draft = f"{where}/part-{shard:06d}.ids.zst", f"{where}/.draft-{uuid.uuid4().hex}"
        for batch in common.bounded(batches, "text"):
            if not writer:
                fs.create_dir(where)
                stream = fs.open_output_stream(draft, compression=None)
                writer = FrameWriter(stream)
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                writer.add(key, ids + end)
                n_ids += len(ids) // 4 + 1
        if writer:
            writer.close()
            stream.close()
            fs.move(draft, final)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{path}/part-{shard:06d}.ids.zst"], "n_docs": pa.array([len(writer.keys)], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    ranged = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return common.stored(ranged.mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files named in a manifest; checksums are verified."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, where = open_store(path)
                with fs.open_input_file(where) as source:
                    reader, at = SeekReader(source), base
                    for first in range(0, len(reader.keys), 2000):
                        keys, starts, sizes, sums = reader.keys[first : first + 2000], [], [], []
                        for i in range(first, first + len(keys)):
                            data = reader.frame(i)
                            starts.append(at)
                            sizes.append(len(data) // 4)
                            sums.append(zlib.crc32(data))
                            at += len(data) // 4
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return shards.repartition(n, "shard").mapInArrow(read, READ_BACK)


def read_documents(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of the wanted documents only: each shard is opened once and only their frames are decompressed."""
    spans = manifest.select("shard", "path")

    def directory(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, where = open_store(path)
                with fs.open_input_file(where) as source:
                    found = SeekReader(source).keys
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([path] * len(found)), pa.array(range(len(found)), pa.int64())], ["doc_id", "path", "frame"])

    def fetch(batches):
        for batch in batches:
            by_path: dict[str, list] = {}
            for key, path, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "path", "frame")), strict=True):
                by_path.setdefault(path, []).append((key, frame))
            for path, found in by_path.items():
                fs, where = open_store(path)
                with fs.open_input_file(where) as source:
                    reader = SeekReader(source)
                    ids = [list(memoryview(reader.frame(f)).cast("I")) for _, f in found]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    index = spans.mapInArrow(directory, "doc_id long, path string, frame long")
    asked = wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    return index.join(asked, "doc_id", "left_semi").repartition("path").sortWithinPartitions("path", "frame").mapInArrow(fetch, "doc_id long, ids array<long>")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as token files and read back."""
    import public_tokenizers

    manifest = write_token_files(common.table(spark, sf_dir, "documents"), common.shared_dir(spark), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest)
