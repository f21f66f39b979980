"""Token counts of flat token files that have no index, by a scan for the end-of-document identifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiframe.llm.common import bounded_batches, materialize, text_bytes
from lumiframe.llm.files import Output, listing, open_store

#: Bytes of a written file at about which the next one begins, and bytes that one task scans at a time.
FILE_BYTES, BLOCK_BYTES = 128 << 20, 4 << 20


def write_token_files(df: DataFrame, folder: str, vocabulary: str, eod: int, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the tokens of each text and eod after it to flat files; returns their order as doc_id, file, ordinal.

    Identifiers are little-endian uint16, or uint32 where the vocabulary needs it. Strings of special tokens are
    ordinary text here, so eod stands at ends only. Null and empty texts are eod alone. Keys are numbers or text of whole
    numbers, other text raises; null and repeated keys stay as they are. Every attempt of a task has
    names of its own; the returned table has those of the committed ones, whose files are complete.
    """
    from lumiframe.llm.bpe import shared_encoder

    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary, special=False)
        kind = token_type(max(encoder.v.size, eod + 1))
        task, k, out, keys = TaskContext.get(), 0, None, []
        name = lambda: f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{k:04d}.tok"

        def close():
            out.close()
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([name()] * n, pa.string()), pa.array(range(n), pa.int64())], names=["doc_id", "file", "ordinal"])

        try:
            for b in batches:
                if out is None:
                    out, keys = Output(folder, name()), []
                ids, sizes = encoder.flat([t.decode("utf-8", "replace") for t in text_bytes(b.column(1))])
                stops = np.cumsum(sizes + 1) - 1
                tokens = np.full(len(ids) + len(sizes), eod, kind)
                inside = np.ones(len(tokens), bool)
                inside[stops] = False
                tokens[inside] = ids
                out.write(tokens.tobytes())
                keys.extend(b.column(0).to_pylist())
                if out.size >= file_bytes:
                    yield close()
                    k, out = k + 1, None
            if out is not None:
                yield close()
                out = None
        finally:
            if out is not None:
                out.abort()

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, file string, ordinal long"), "token-order")


def token_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def scan(spark: SparkSession, folder: str, eod: int, size: int, block_bytes: int = BLOCK_BYTES, files: DataFrame | None = None) -> DataFrame:
    """file, ordinal, n_tokens, terminated of every document of the token files of a folder.

    Blocks are searched for eod alone. A prefix scan over the blocks of each file then gives the documents before a
    block and the tokens that its first document has in earlier blocks. Tokens after a file's last eod are a document
    that isn't terminated; bytes after the last whole identifier are ignored. An empty file or folder has no document.
    """
    kind = np.dtype(token_type(size))
    step = max(1, block_bytes // kind.itemsize)
    found = [(n, s // kind.itemsize) for n, s in listing(folder, ".tok")]
    table = spark.createDataFrame(found, "file string, tokens long").where("tokens > 0")
    if files is not None:
        table = table.join(files.select("file").distinct(), "file", "left_semi")
    blocks = table.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {step}"))).alias("block"))
    # dealt over the default parallelism: a block is a task's unit of memory
    blocks = blocks.repartition(max(1, min(sum(-(-t // step) for _, t in found), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for b in batches:
            for file, tokens, block in zip(*[c.to_pylist() for c in b.columns], strict=True):
                n = min(step, tokens - block * step)
                with store.open_input_file(f"{path}/{file}") as f:
                    ids = np.frombuffer(f.read_at(n * kind.itemsize, block * step * kind.itemsize), dtype=kind)
                ends = np.flatnonzero(ids == eod).astype(np.int64)
                inner = np.diff(ends, prepend=-1) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([block * step], pa.int64()), pa.array([block * step + int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([tokens], pa.int64()), pa.array([len(ends)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), pa.array(inner))],
                    names=["file", "block", "start", "last_eod", "tokens", "n_ends", "inner"],
                )

    found = materialize(blocks.select("file", "tokens", "block").mapInArrow(run, "file string, block long, start long, last_eod long, tokens long, n_ends long, inner array<long>"), "token-blocks")
    # the prefix scan sees a row of a few numbers per block, never what is in it
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = found.select(
        "file",
        "block",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("docs_before"),
        (F.col("start") - F.coalesce(F.max("last_eod").over(before), F.lit(-1)) - 1).alias("carried"),
    )
    marked = found.select("file", "block", "inner").join(materialize(marks, "token-marks"), ["file", "block"])
    ended = marked.select("file", "docs_before", "carried", F.posexplode("inner").alias("at", "n")).select("file", (F.col("docs_before") + F.col("at")).alias("ordinal"), (F.col("n") + F.when(F.col("at") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("terminated"))
    tails = found.groupBy("file").agg(F.sum("n_ends").alias("ordinal"), (F.max("tokens") - F.coalesce(F.max("last_eod"), F.lit(-1)) - 1).alias("n_tokens")).where("n_tokens > 0").withColumn("terminated", F.lit(False))
    return ended.unionByName(tails)
