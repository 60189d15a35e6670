"""Token counts from flat token files by a separator scan.

A token file is nothing but little-endian ids, documents one after another, each
closed by the separator id; it has no index. The scan cuts files into blocks of
``block_tokens`` ids by their sizes alone, reads each block as a byte range, and
finds its separators in one vectorised comparison. A block gives one row: the
places of its separators. A prefix scan over a file's blocks (running number of
separators, running place of the last one) then tells each block which document
it begins in and where that began, so documents that cross block borders are
stitched without reading anything twice. Documents come out as rows of
(file, ordinal, start, n_tokens).

Files are read and written by the tasks through the file system that their URI
names. Written files' names hold the task attempt, and only those that the written
manifest names are read, so lost executors and retried tasks do no harm.

Edge cases: an empty document (two separators in a row) has 0 tokens. Ids after a
file's last separator are a document with ``closed`` false. An empty file has no
document. A file whose size isn't a whole number of ids is refused. Null texts are
empty documents. An empty table writes no file and gives an empty result. A
separator's string inside a text is ordinary text and closes nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decisium.llm import tokens
from decisium.runtime import materialise, shared_path

SEPARATOR = 49407
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 27
ID_BYTES = 2
#: Summaries of at most this many blocks are sent to every task; beyond, blocks are joined to theirs.
BROADCAST_ROWS = 1_000_000


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer_path: str | None = None, separator: int = SEPARATOR, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids (16 bits each) of (text) row by row into files of ``folder``; gives (file_no, path, n_docs, bytes)."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    path = tokenizer_path or tokens.default_path()
    end = separator.to_bytes(ID_BYTES, "little")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        wp = tokens.word_pieces(path, "H", specials_are_text=True)
        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        sink, n, size, made = None, 0, 0, []
        for batch in batches:
            for text in tokens.text_bytes(batch.column(0)):
                if sink is None:
                    store.create_dir(root, recursive=True)
                    name = f"part-{context.partitionId():05d}-{len(made):04d}-{context.taskAttemptId()}.bin"
                    sink, n, size = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                ids = wp.ids(text)
                sink.write(ids)
                sink.write(end)
                n, size = n + 1, size + len(ids) + ID_BYTES
                if size >= file_tokens * ID_BYTES:
                    sink.close()
                    sink = None
                    made.append((len(made), f"{folder}/{name}", n, size))
        if sink is not None:
            sink.close()
            made.append((len(made), f"{folder}/{name}", n, size))
        part = context.partitionId() << 20
        yield pa.RecordBatch.from_arrays(
            [pa.array([part + m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.int64()), pa.array([m[3] for m in made], pa.int64())],
            names=["file_no", "path", "n_docs", "bytes"],
        )

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "file_no long, path string, n_docs long, bytes long")
    return materialise(rows, "token-files")


def list_files(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(file_no, path, bytes) of existing token files, numbered as given."""
    from pyarrow import fs

    rows = []
    for i, uri in enumerate(uris):
        store, place = fs.FileSystem.from_uri(uri)
        rows.append((i, uri, store.get_file_info(place).size))
    return spark.createDataFrame(rows, "file_no long, path string, bytes long")


def scan_blocks(files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, id_bytes: int = ID_BYTES) -> DataFrame:
    """(file_no, block_no, n_tokens, ends array<long>): the separators' places (in ids from the file's start) of every block."""
    whole = F.when(F.col("bytes") % id_bytes != 0, F.raise_error(F.concat(F.lit("not a whole number of ids: "), F.col("path")))).otherwise(F.col("bytes"))
    blocks = files.select("file_no", "path", whole.cast("long").alias("bytes")).filter("bytes > 0")
    last = F.floor((F.col("bytes") - 1) / (block_tokens * id_bytes)).cast("long")
    blocks = blocks.select("file_no", "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block_no"))
    spread = max(1, files.sparkSession.sparkContext.defaultParallelism) * 4

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for file_no, path, size, block_no in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                first = block_no * block_tokens
                with store.open_input_file(place) as source:
                    data = source.read_at(min(block_tokens * id_bytes, size - first * id_bytes), first * id_bytes)
                ids = np.frombuffer(data, f"<u{id_bytes}")
                ends = np.flatnonzero(ids == separator) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file_no], pa.int64()), pa.array([block_no], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file_no", "block_no", "n_tokens", "ends"],
                )

    return blocks.repartition(spread, "file_no", "block_no").mapInArrow(run, "file_no long, block_no long, n_tokens long, ends array<long>")


def documents(blocks: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file_no, ordinal, start, n_tokens, closed) of every document, stitched over blocks.

    The prefix scan runs over one short row a block, without the places of separators.
    """
    held = materialise(blocks, "blocks")
    order = Window.partitionBy("file_no").orderBy("block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = held.select("file_no", "block_no", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    summary = summary.select(
        "file_no",
        "block_no",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last_before"),
        F.lead("block_no").over(order).isNull().alias("is_last"),
    )
    summary = materialise(summary, "summary")
    summary = F.broadcast(summary) if summary.count() <= BROADCAST_ROWS else summary
    df = held.withColumn("stop", F.col("block_no") * block_tokens + F.col("n_tokens")).join(summary, ["file_no", "block_no"])
    open_end = F.when(F.col("is_last") & (F.col("stop") - 1 > F.coalesce(F.when(F.size("ends") > 0, F.element_at("ends", -1)), F.col("last_before"))), F.array(F.col("stop")))
    df = df.withColumn("n_closed", F.size("ends")).withColumn("ends", F.concat("ends", F.coalesce(open_end, F.array().cast("array<bigint>"))))
    df = df.select("*", F.posexplode("ends").alias("i", "stop_at"))
    start = F.when(F.col("i") == 0, F.col("last_before")).otherwise(F.get("ends", F.greatest(F.col("i") - 1, F.lit(0)))) + 1
    return df.select(
        "file_no",
        (F.col("n_before") + F.col("i")).cast("long").alias("ordinal"),
        start.cast("long").alias("start"),
        (F.col("stop_at") - start).cast("long").alias("n_tokens"),
        (F.col("i") < F.col("n_closed")).alias("closed"),
    )


def token_counts(files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, id_bytes: int = ID_BYTES) -> DataFrame:
    """Every document of the token files ``files`` (file_no, path, bytes)."""
    return documents(scan_blocks(files, separator, block_tokens, id_bytes), block_tokens)
