"""Token counts of documents in flat, unindexed token files, by a separator scan.

A token file is a run of little-endian 16-bit ids; each document is followed
by an end-of-document id. Nothing else is stored, so where documents begin
must be found. Files are cut into blocks of fixed size that are read by range,
each block alone: one vectorised search finds its separators and gives the
tokens before the first, between each two, and after the last. A prefix scan
over the blocks' separator counts numbers the documents, and the parts of a
document that straddles blocks are added by that number.

The separator lies outside the vocabulary, so that no text can contain it.

Writing: each task writes files of its own under a name that holds its attempt
and reports what it wrote; only reported files are scanned, so that lost or
repeated tasks leave nothing behind that counts.

Defined results: null and empty texts have 0 tokens; a trailing part without
a separator is a document that isn't terminated; repeated rows are counted one
by one; an empty table writes no file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.llm.common import documents, fresh_path, map_arrow, materialize
from groundline.llm.vocab import WORD_BPE, in_slices, tokenizer, vocabulary, word_encoder

BLOCK_TOKENS = 1 << 21
FILE_TOKENS = 1 << 26


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def separator(path: str) -> int:
    """The first id beyond the vocabulary."""
    return tokenizer(path).get_vocab_size(with_added_tokens=True)


MANIFEST = "file string, ordinal long, doc_id long"


def write_token_files(docs: DataFrame, folder: str, path: str) -> DataFrame:
    """Encode documents into flat files below `folder`; return (file, ordinal, doc_id), which the scan doesn't read."""
    end = separator(path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        out = name = None
        files = ordinal = written = 0
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), ["" if x is None else x for x in batch["text"].to_pylist()]
            for a, b in in_slices(texts):
                found = word_encoder(path).encode(texts[a:b])
                if out is None or written > FILE_TOKENS:
                    if out is not None:
                        out.close()
                    name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}-{files}.u16"
                    out, files, ordinal, written = store.open_output_stream(f"{base}/{name}"), files + 1, 0, 0
                for tokens in found:
                    out.write(np.append(tokens, end).astype("<u2").tobytes())
                    written += len(tokens) + 1
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.array(ids[a:b], pa.int64())], ["file", "ordinal", "doc_id"]
                )
                ordinal += n
        if out is not None:
            out.close()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, MANIFEST)


def blocks_of(files: DataFrame, block_tokens: int) -> DataFrame:
    """(path, file, block) of files given as (path, length)."""
    block = 2 * block_tokens
    return (
        files.where("length > 0")
        .withColumn("file", F.element_at(F.split("path", "/"), -1))
        .select("path", "file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block).cast("long"))).alias("block"))
    )


SUMMARY = "file string, block long, separators long, head long, inner array<int>, tail long"


def scan_blocks(blocks: DataFrame, end: int, block_tokens: int) -> DataFrame:
    """Each block's separators: tokens before the first, between each two, after the last."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, block in zip(*(batch[c].to_pylist() for c in ("path", "file", "block"))):
                store, place = _filesystem(path)
                with store.open_input_file(place) as f:
                    f.seek(2 * block_tokens * block)
                    tokens = np.frombuffer(f.read(2 * block_tokens), "<u2")
                at = np.flatnonzero(tokens == end)
                head, tail = (at[0], len(tokens) - at[-1] - 1) if len(at) else (len(tokens), 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file]),
                        pa.array([block], pa.int64()),
                        pa.array([len(at)], pa.int64()),
                        pa.array([int(head)], pa.int64()),
                        pa.array([(np.diff(at) - 1).astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([int(tail)], pa.int64()),
                    ],
                    [x.split()[0] for x in SUMMARY.split(", ")],
                )

    return map_arrow(blocks, kernel, SUMMARY)


def stitch(summary: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens, terminated) of every document, from the blocks' summaries."""
    before = F.sum("separators").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("separators")
    total = F.sum("separators").over(Window.partitionBy("file"))
    placed = summary.withColumn("before", before).withColumn("total", total)
    whole = placed.select("file", "before", F.posexplode("inner").alias("i", "n")).select(
        "file", (F.col("before") + 1 + F.col("i")).alias("ordinal"), F.col("n").cast("long").alias("n_tokens"), F.lit(True).alias("terminated")
    )
    ends = F.array(
        F.struct(F.col("before").alias("ordinal"), F.col("head").alias("n")),
        F.struct((F.col("before") + F.col("separators")).alias("ordinal"), F.col("tail").alias("n")),
    )
    straddling = (
        placed.select("file", "total", F.explode(ends).alias("e"))
        .groupBy("file", "e.ordinal")
        .agg(F.sum("e.n").alias("n_tokens"), F.max("total").alias("total"))
        .select("file", "ordinal", "n_tokens", (F.col("ordinal") < F.col("total")).alias("terminated"))
        .where("terminated OR n_tokens > 0")
    )
    return whole.unionByName(straddling)


def count_tokens(files: DataFrame, end: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token counts of all documents in token files given as (path, length)."""
    blocks = blocks_of(files, block_tokens)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stitch(materialize(scan_blocks(blocks.repartition(parts, "path", "block"), end, block_tokens), "blocks"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files in a folder; their content isn't read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, folder = vocabulary(WORD_BPE), fresh_path(spark, "token-files")
    manifest = materialize(write_token_files(documents(spark, sf_dir), folder, path), "manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, file string, ordinal long, n_tokens long, terminated boolean")
    written = manifest.select(F.col("file").alias("_file")).distinct()
    files = listed(spark, folder).join(written, F.element_at(F.split("path", "/"), -1) == F.col("_file"), "left_semi")
    counts = count_tokens(files, separator(path))
    return counts.join(manifest, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens", "terminated")
