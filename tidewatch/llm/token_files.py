"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is, in this order: a skippable frame with a JSON header (id width in bytes, end id), one zstandard frame per
document, and the seek table of the public zstandard seekable format (a skippable frame with compressed size, plain
size and checksum of every frame, then the number of frames and a magic number). The checksum is the low half of the
XXH64 of the plain ids. A reader finds a frame by the table and decompresses only the documents asked for.

Documents are range-partitioned by id, so that file after file and frame after frame the ids ascend. A task writes its
file under a name of its own and reports it in the index, a Parquet table; files of tasks that were lost or repeated are
in no index and are never read. The files lie in the shared folder and are written and read by pyarrow's file systems.

Defined cases: a null text is encoded as an empty one, its document is the end id alone; null ids come first; documents
that share an id stand in the order of their texts' hashes; an empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import shared_folder

from .common import documents, durable
from .texts import batch_slices
from .tokens import default_path, encoder

# Fixed values of the zstandard frame and seekable formats.
SKIPPABLE_HEADER, SKIPPABLE_TABLE, TABLE_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80

END_ID = 2
LEVEL = 1


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file: ``add`` a document's ids, then ``close``."""

    def __init__(self, path: str, width: int, end_id: int, level: int = LEVEL):
        import zstandard

        system, place = _open(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self._file = system.open_output_stream(place, compression=None)
        self._compressor = zstandard.ZstdCompressor(level=level)
        self._kind = np.dtype(f"<u{width}")
        self._table: list[tuple[int, int, int]] = []
        header = json.dumps({"width": width, "end_id": end_id}).encode()
        self._file.write(struct.pack("<II", SKIPPABLE_HEADER, len(header)) + header)

    def add(self, ids: np.ndarray) -> None:
        import xxhash

        plain = ids.astype(self._kind).tobytes()
        packed = self._compressor.compress(plain)
        self._file.write(packed)
        self._table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        table = np.array(self._table, "<u4").tobytes()
        self._file.write(struct.pack("<II", SKIPPABLE_TABLE, len(table) + 9) + table)
        self._file.write(struct.pack("<IBI", len(self._table), HAS_CHECKSUMS, TABLE_END))
        self._file.close()


class Reader:
    """Reads single documents of one file; checks every frame it decompresses."""

    def __init__(self, path: str):
        import zstandard

        system, place = _open(path)
        self.path, self._file = path, system.open_input_file(place)
        self._decompressor = zstandard.ZstdDecompressor()
        size = self._file.size()
        frames, flags, magic = struct.unpack("<IBI", self._file.read_at(9, size - 9))
        if magic != TABLE_END or not flags & HAS_CHECKSUMS:
            raise ValueError(f"no seek table with checksums at the end of {path}")
        self.table = np.frombuffer(self._file.read_at(12 * frames, size - 9 - 12 * frames), "<u4").reshape(-1, 3)
        magic, length = struct.unpack("<II", self._file.read_at(8, 0))
        header = json.loads(self._file.read_at(length, 8))
        self.end_id, self._kind = header["end_id"], np.dtype(f"<u{header['width']}")
        self._begin = 8 + length + np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])

    def ids(self, frame: int) -> np.ndarray:
        import xxhash

        packed, plain_size, checksum = (int(x) for x in self.table[frame])
        plain = self._decompressor.decompress(self._file.read_at(packed, int(self._begin[frame])), max_output_size=plain_size)
        if len(plain) != plain_size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {frame} of {self.path} is damaged")
        return np.frombuffer(plain, self._kind)

    def close(self) -> None:
        self._file.close()


def write_tokens(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents; returns the index (doc_id, file, file_number, frame, in_file, n_tokens).

    ``in_file`` counts the ids before the document in its file. The index is a stored table.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    vocabulary = vocabulary or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        number = TaskContext.get().partitionId()
        path = f"{folder}/part-{number:06d}-{uuid.uuid4().hex}.zst"
        writer, before, frame = None, 0, 0
        for batch in batches:
            for part in batch_slices(batch, "text"):
                writer = writer or Writer(path, 2 if tokenizer.vocabulary <= 1 << 16 and end_id < 1 << 16 else 4, end_id)
                ids, begins = tokenizer.encode(part.column("text"))
                for i in range(part.num_rows):
                    writer.add(np.append(ids[begins[i] : begins[i + 1]], np.uint32(end_id)))
                lengths = np.diff(begins) + 1
                starts = before + np.concatenate([[0], np.cumsum(lengths)[:-1]])
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([path] * n, pa.string()), pa.array(np.full(n, number, np.int64)),
                     pa.array(np.arange(frame, frame + n)), pa.array(starts.astype(np.int64)), pa.array(lengths)],
                    ["doc_id", "file", "file_number", "frame", "in_file", "n_tokens"])
                before, frame = before + int(lengths.sum()), frame + n
        if writer:
            writer.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(ordered.mapInArrow(
        write, f"doc_id {kind}, file string, file_number bigint, frame bigint, in_file bigint, n_tokens bigint"))


def read_tokens(index: DataFrame, ids: bool = True) -> DataFrame:
    """Read back the documents of an index, or of any selection of its rows: adds the ids, or only their checksum.

    ``ids_crc32`` is the CRC-32 of the ids as little-endian 32-bit integers.
    """
    names = index.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            found, sums, counts = [], [], []
            for path, frame in zip(batch.column("file").to_pylist(), batch.column("frame").to_pylist()):
                if reader is None or reader.path != path:
                    if reader:
                        reader.close()
                    reader = Reader(path)
                got = reader.ids(frame).astype("<u4")
                sums.append(zlib.crc32(got.tobytes()))
                counts.append(len(got))
                found.append(got if ids else None)
            columns = [batch.column(c) for c in names if c != "n_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), *([pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))] if ids else [])],
                [*[c for c in names if c != "n_tokens"], "n_tokens", "ids_crc32", *(["ids"] if ids else [])])
        if reader:
            reader.close()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields if f.name != "n_tokens")
    return index.mapInArrow(read, f"{kept}, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else ""))


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids of all documents before; only totals per file meet in one task."""
    totals = index.groupBy("file_number").agg(F.sum("n_tokens").alias("_total"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumnRenamed("file_number", "_file").withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    return index.join(offsets, F.col("file_number") == F.col("_file")).withColumn("start", F.col("_before") + F.col("in_file")).drop("_file", "_before", "_total")


def token_digest(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents, read them back, and return per document start, number and checksum of its ids."""
    index = write_tokens(docs, vocabulary=vocabulary, end_id=end_id)
    return with_starts(read_tokens(index, ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_digest(documents(spark, folder))
