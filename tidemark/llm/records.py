"""Token ids as length-delimited, checksummed records with an offset index.

Frame of a record: payload length (8 bytes), masked CRC-32 of these 8 bytes,
payload, masked CRC-32 of the payload; all little-endian.  The payload is a
flag byte (1: the document has an id), the document id (8 bytes) and the token
ids, two bytes each while the vocabulary allows it, else four.  The index is a
Parquet table with one row per record; a reader can seek to any record, in any
order.  Data files that a failed or doubled task left behind are in no index
row, so they are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import ready, scratch_path
from tidemark.llm.encoding import encoder

HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
OWNER = struct.Struct("<Bq")
#: Bytes a reader or writer holds at a time, besides one record.
BUFFER = 1 << 22

INDEX = "part int, file string, seq long, doc_id long, offset long, length long, n_tokens long"
READ = "part int, seq long, doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(crc: int) -> int:
    """Rotated and shifted, so that a checksum of stored checksums stays useful."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, TAIL.pack(masked(zlib.crc32(size))), payload,
                     TAIL.pack(masked(zlib.crc32(payload)))))


def store_of(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> None:
    """Encodes every whole text of ``docs`` and writes records below ``folder``.

    Records follow ascending doc_id (null last; repeated ids by text); files
    are numbered in that order.  A null or empty text gives just ``end_id``; an
    empty table gives an empty index.  Repeated rows give repeated records.
    Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    data = f"{folder}/data"
    width = 2 if vocabulary_size(tokenizer) <= 1 << 16 else 4
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
     .repartitionByRange(F.col("doc_id").asc_nulls_last())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
     .mapInArrow(partial(_write_part, data, tokenizer, width, end_id), INDEX).write.parquet(f"{folder}/index"))
    spark.range(1).select(F.lit(width).alias("width")).write.parquet(f"{folder}/format")


_INDEX_NAMES = ["part", "file", "seq", "doc_id", "offset", "length", "n_tokens"]
_INDEX_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _write_part(data: str, tokenizer: str, width: int, end_id: int,
                batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One data file per task; yields its index rows."""
    code, kind = encoder(tokenizer), f"<u{width}"
    end = end_id.to_bytes(width, "little")
    part = TaskContext.get().partitionId()
    name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.rec"
    out, at, seq = None, 0, 0
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, found in zip(batch.column(0).to_pylist(), code.encoded(batch.column(1))):
            if out is None:
                store, root = store_of(data)
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", buffer_size=BUFFER)
            ids = found.astype(kind).tobytes() + end
            record = frame(OWNER.pack(doc_id is not None, doc_id or 0) + ids)
            out.write(record)
            rows.append((part, name, seq, doc_id, at, len(record), len(ids) // width))
            at, seq = at + len(record), seq + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), t) for x, t in zip(zip(*rows), _INDEX_TYPES)] if rows
            else [pa.array([], t) for t in _INDEX_TYPES], names=_INDEX_NAMES)
    if out is not None:
        out.close()


def vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def unframe(read, width: int) -> tuple[int | None, bytes]:
    """The next record's document id and its ids as 4-byte numbers."""
    import numpy as np

    head = read(HEAD.size)
    size, check = HEAD.unpack(head)
    if masked(zlib.crc32(head[:8])) != check:
        raise ValueError("a record's length is damaged")
    payload = read(size)
    (check,) = TAIL.unpack(read(TAIL.size))
    if len(payload) != size or masked(zlib.crc32(payload)) != check:
        raise ValueError("a record is damaged")
    known, doc_id = OWNER.unpack_from(payload)
    ids = payload[OWNER.size:]
    if width != 4:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return (doc_id if known else None), ids


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of ``folder``, read from the data files in their order.

    Returns part, seq, doc_id, start (ids of all records before it), n_tokens
    and ids_crc32.  A file whose records or totals differ from the index, or
    whose checksums fail, raises an error.
    """
    ready(spark)
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    width = spark.read.parquet(f"{folder}/format").first()["width"]
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = (index.groupBy("part", "file")
             .agg(F.count("*").alias("n"), F.sum("n_tokens").alias("ids"))
             .withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))))
    data = f"{folder}/data"

    n = max(1, files.count())
    return files.repartition(n, "part").mapInArrow(partial(_read_part, data, width), READ)


def _read_part(data: str, width: int,
               batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All records of the files named in the rows, with their checks."""
    for batch in batches:
        for f in batch.to_pylist():
            store, root = store_of(data)
            start, total, rows = f["base"], 0, []
            with store.open_input_stream(f"{root}/{f['file']}", buffer_size=BUFFER) as file:
                for seq in range(f["n"]):
                    doc_id, ids = unframe(file.read, width)
                    n = len(ids) // 4
                    rows.append((f["part"], seq, doc_id, start + total, n, zlib.crc32(ids)))
                    total += n
                    if len(rows) == 20_000:
                        yield _read_batch(rows)
                        rows = []
                if file.read(1) or total != f["ids"]:
                    raise ValueError(f"{f['file']} differs from its index")
            if rows:
                yield _read_batch(rows)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(x), t) for x, t in zip(zip(*rows), types)],
        names=["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_at(folder: str, file: str, offset: int, width: int) -> tuple[int | None, bytes]:
    """One record by its index entry, for reads in shuffled order."""
    store, root = store_of(f"{folder}/data")
    with store.open_input_file(f"{root}/{file}") as data:
        data.seek(offset)
        return unframe(data.read, width)


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0,
                  folder: str | None = None) -> DataFrame:
    """Writes ``docs`` as records and returns what reading them back gives."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "records")
    write_records(docs, folder, tokenizer, end_id)
    return read_records(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
