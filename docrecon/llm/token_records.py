"""Token ids as length-delimited binary records, with a separate offset index.

A record file is a run of frames. A frame is the payload's length (8 bytes), the masked checksum of those 8 bytes
(4 bytes), the payload, and the masked checksum of the payload (4 bytes), all least byte first. A payload is the id
(1 byte: 1 if it is null; 8 bytes), the width of a token id in bytes (1 byte: 2 or 4) and the token ids. A mask turns a
checksum by 15 bits and adds a constant, so that a checksum stored inside checked data does no harm.

Documents are dealt by ranges of their id, so files in name order hold them in id order and no task sees more than its
range. Each task writes files of about file_bytes under a name of its own and renames them when they are whole: a task
that is lost and run again leaves the same files. The index (Parquet: file, place, id, offset, length, tokens) lets a
reader fetch records in any order. Files are written with pyarrow's file systems, so the folder may be in any store that
pyarrow opens.
"""

import struct
import zlib
from collections.abc import Iterator
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrecon.llm.storage import keep, map_batches, new_folder
from docrecon.llm.tokens import byte_encoder, pack

MASK = 0xA282EAD8
#: Of text in a range of ids, so that a task's share does not grow with the corpus; and files that a reading task takes.
RANGE_BYTES, FILES_PER_TASK = 256 << 20, 4
FRAME, HEAD = struct.Struct("<QI"), struct.Struct("<?qB")
SCAN = "file string, place long, doc_id long, n_tokens long, ids_crc32 long"
FETCH = "file string, offset long, doc_id long, ids array<long>"
INDEX = "file string, place long, doc_id long, offset long, length long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each frame of an open file; raises ValueError where a checksum or length does not hold."""
    offset = 0
    while head := stream.read(FRAME.size):
        if len(head) < FRAME.size:
            raise ValueError(f"cut-off frame at {offset}")
        size, check = FRAME.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError(f"wrong length checksum at {offset}")
        payload, tail = stream.read(size), stream.read(4)
        if len(payload) < size or len(tail) < 4:
            raise ValueError(f"cut-off record at {offset}")
        if struct.unpack("<I", tail)[0] != masked(payload):
            raise ValueError(f"wrong record checksum at {offset}")
        yield offset, payload
        offset += FRAME.size + size + 4


def payload_of(doc_id: int | None, ids: bytes) -> bytes:
    """ids: packed unsigned 32-bit; stored in 2 bytes each if all fit."""
    import numpy as np

    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    return HEAD.pack(doc_id is None, doc_id or 0, 2 if narrow else 4) + (wide.astype("<u2").tobytes() if narrow else ids)


def ids_of(payload: bytes):
    """(id, token ids as an array of unsigned 32-bit)."""
    import numpy as np

    null, doc_id, width = HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=HEAD.size).astype("<u4")


def open_store(folder: str):
    """(file system, path) of a folder given as a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_column: str = "doc_id", text: str = "text", file_bytes: int = 32 << 20) -> DataFrame:
    """Encodes, writes folder/records and folder/index, and returns the index.

    Null texts are as empty ones: they hold the end id alone. Rows of one id stand together, ordered by text; null ids
    come first. An empty table writes an empty index and no record file. Other columns are not read.
    """
    def run(batches):
        import uuid

        from pyspark import TaskContext

        store, at = open_store(f"{folder}/records")
        store.create_dir(at, recursive=True)
        encode, end, part = byte_encoder(tokenizer_path), pack([end_id]), TaskContext.get().partitionId()
        number, size, stream, name, draft, rows = 0, 0, None, "", "", []

        def finish():
            stream.close()
            store.move(draft, f"{at}/{name}")

        for batch in batches:
            for doc_id, content in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if stream is None:
                    name, draft = f"part-{part:06d}-{number:05d}.rec", f"{at}/_draft-{uuid.uuid4().hex}"
                    stream, size, place = store.open_output_stream(draft), 0, 0
                ids = encode(content) + end
                made = frame(payload_of(doc_id, ids))
                stream.write(made)
                rows.append((name, place, doc_id, size, len(made), len(ids) // 4))
                size, place = size + len(made), place + 1
                if size >= file_bytes:
                    finish()
                    stream, number = None, number + 1
            yield batch_of(rows, INDEX)
            rows = []
        if stream is not None:
            finish()

    chosen = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"))
    size = chosen.agg(F.sum(F.octet_length("_text"))).head()[0] or 0
    ordered = chosen.repartitionByRange(shards(docs, size / RANGE_BYTES), "_id").sortWithinPartitions("_id", "_text")
    map_batches(ordered, run, INDEX).write.parquet(f"{folder}/index")
    return read_index(docs.sparkSession, folder)


def batch_of(rows: list[tuple], schema: str):
    """Rows as an Arrow batch; schema names the columns and their types as in the Spark schema of the same text."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def shards(df: DataFrame, least: float) -> int:
    """Parts to deal rows into: as many as the session gives a shuffle, and more where the data needs them."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(least))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records in whole-file reads: file, place, doc_id, n_tokens, ids_crc32 (of the ids as unsigned 32-bit)."""

    def run(batches):
        store, at = open_store(f"{folder}/records")
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with store.open_input_stream(f"{at}/{name}", buffer_size=1 << 20) as stream:
                    for place, (_, payload) in enumerate(frames(stream)):
                        doc_id, ids = ids_of(payload)
                        rows.append((name, place, doc_id, len(ids), zlib.crc32(ids.tobytes())))
                yield batch_of(rows, SCAN)

    files = read_index(spark, folder).filter("place = 0").select("file")
    return map_batches(files.repartition(shards(files, files.count() / FILES_PER_TASK), "file"), run, SCAN)


def fetch_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Token ids of wanted(file, offset, length) by way of the index alone: file, offset, doc_id, ids."""

    def run(batches):
        import io

        store, at = open_store(f"{folder}/records")
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                with store.open_input_file(f"{at}/{row['file']}") as source:
                    source.seek(row["offset"])
                    ((_, payload),) = frames(io.BytesIO(source.read(row["length"])))
                doc_id, ids = ids_of(payload)
                rows.append((row["file"], row["offset"], doc_id, ids.tolist()))
            yield batch_of(rows, FETCH)

    return map_batches(wanted.select("file", "offset", "length"), run, FETCH)


def record_starts(records: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Adds start, the tokens of all records before, and returns id, start, n_tokens, ids_crc32.

    Sums run within a file, and over one row per file (of file_bytes each) for what stands before it, which is the one step
    that is a single task.
    """
    totals = records.groupBy("file").agg(F.sum("n_tokens").alias("_total"))
    before = totals.select(F.col("file"), (F.sum("_total").over(Window.orderBy("file")) - F.col("_total")).alias("_before"))
    own = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place")) - F.col("n_tokens")
    return records.withColumn("_own", own).join(before, "file").select(F.col("doc_id").alias(id_column), (F.col("_before") + F.col("_own")).alias("start"), "n_tokens", "ids_crc32")


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_column: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the records of all documents, reads the files back, and returns per document: id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; a text of any length is one record. Rows of one id stand together, ordered
    by text, and count once each; null ids come first. An empty table gives no rows. Other columns are not read. Ids are
    whole numbers: others raise ValueError.
    """
    if docs.schema[id_column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_column} holds no whole numbers")
    folder = folder or new_folder(docs.sparkSession, "records")
    write_records(docs, folder, tokenizer_path, end_id, id_column, text)
    return record_starts(keep(scan_records(docs.sparkSession, folder), "scanned"), id_column)
