"""Token counts from flat token files without an index.

A token file is a run of 16-bit little-endian ids with a separator after each document. Files are cut into blocks; each
block is searched for separators on its own, all ids at once. A prefix scan over the blocks' sums (separators before the
block, place of the last of them) then gives every document its number, start and length, also where it crosses blocks.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from editlens.llm.bpe import load_ranks
from editlens.session import materialize

WIDTH = 2
#: Free in the vocabulary of 50,256 ids.
SEPARATOR = 50_256
BLOCK_TOKENS = 1 << 20
GROUP = 1024


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def write_token_files(docs: DataFrame, path: str, vocabulary: str, pattern: str) -> None:
    """One flat file per partition of `docs`, texts in order. A null text counts as empty.

    Spark's text writer puts the separator's two bytes after each document, so any store Spark can write to will do.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, pattern)
        for batch in batches:
            ids = [np.array(encoding.encode_ordinary(t.as_py() or ""), "<u2").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    separator = int(SEPARATOR).to_bytes(WIDTH, "little").decode("iso-8859-1")
    tokens = docs.select("text").mapInArrow(encode, "ids binary").select(F.col("ids").cast("string").alias("value"))
    tokens.write.option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)


def _open(path: str) -> pa.NativeFile:
    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path))
    store, inner = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)


def scan_blocks(files: DataFrame, block_tokens: int = BLOCK_TOKENS, separator: int = SEPARATOR) -> DataFrame:
    """One row per block of the files (path, length): its first token, token count and the places of its separators.

    Places count tokens from the start of the file. A block is read by one task, and no task holds more than one.
    """
    step = block_tokens * WIDTH
    uneven = F.raise_error(F.concat(F.lit("not a whole number of tokens: "), F.col("path")))
    blocks = files.where("length > 0").select(
        "path", F.when(F.col("length") % WIDTH == 0, F.col("length")).otherwise(uneven.cast("long")).alias("length")
    ).select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("block", "at"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = min(step, row["length"] - row["at"])
                with _open(row["path"]) as source:
                    ids = np.frombuffer(source.read_at(size, row["at"]), "<u2")
                if len(ids) * WIDTH != size:
                    raise OSError(f"{row['path']} ends before byte {row['at'] + size}")
                first = row["at"] // WIDTH
                places = np.flatnonzero(ids == separator) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["block"]], pa.int32()), pa.array([first], pa.int64()),
                     pa.array([len(ids)], pa.int64()), pa.array([len(places)], pa.int64()),
                     pa.array([int(places[-1]) if len(places) else None], pa.int64()), pa.array([places.tolist()], pa.list_(pa.int64()))],
                    ["path", "block", "first", "n", "n_separators", "last", "places"],
                )

    spread = blocks.repartition("path", "block")
    return spread.mapInArrow(search, "path string, block int, first long, n long, n_separators long, last long, places array<long>")


def documents_in(blocks: DataFrame) -> DataFrame:
    """path, doc_no, start, n_tokens, closed of every document, from the blocks' rows.

    Sums and maxima run over groups of 1,024 blocks and then within each group, so a file may hold a third of all data.
    Two separators in a row enclose a document of no tokens. Tokens after the last separator are a document that is not
    closed. An empty file has no documents.
    """
    sums = blocks.select("path", "block", "first", "n", "n_separators", "last", F.floor(F.col("block") / GROUP).alias("group"))
    groups = sums.groupBy("path", "group").agg(F.sum("n_separators").alias("gs"), F.max("last").alias("gl"), F.max(F.col("first") + F.col("n")).alias("ge"))
    earlier = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "path", "group", F.sum("gs").over(earlier).alias("gs"), F.max("gl").over(earlier).alias("gl"),
        F.max("ge").over(Window.partitionBy("path")).alias("end"),
    )
    inside = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        "path", "group", "block", F.sum("n_separators").over(inside).alias("s"), F.max("last").over(inside).alias("l"),
        (F.col("first") + F.col("n")).alias("block_end"),
    ).join(groups, ["path", "group"]).select(
        "path", "block", (F.coalesce("s", F.lit(0)) + F.coalesce("gs", F.lit(0))).alias("before"),
        F.coalesce(F.greatest("l", "gl"), F.lit(-1)).alias("open_at"), (F.col("block_end") == F.col("end")).alias("is_last"), "end",
    )
    stitched = blocks.select("path", "block", "places").join(carried, ["path", "block"])
    ends = F.transform("places", lambda p, i: F.struct(
        p.alias("end"), F.when(i == 0, F.col("open_at")).otherwise(F.get("places", i - 1)).alias("open"), F.lit(True).alias("closed")
    ))
    tail_open = F.coalesce(F.try_element_at("places", F.lit(-1)), F.col("open_at"))
    tail = F.array(F.struct(F.col("end").alias("end"), tail_open.alias("open"), F.lit(False).alias("closed")))
    rest = F.col("is_last") & (tail_open < F.col("end") - 1)
    all_ends = F.when(rest, F.concat(ends, tail)).otherwise(ends)
    return stitched.select("path", "before", F.posexplode(all_ends).alias("i", "e")).select(
        "path", (F.col("before") + F.col("i")).alias("doc_no"), (F.col("e.open") + 1).alias("start"),
        (F.col("e.end") - F.col("e.open") - 1).alias("n_tokens"), "e.closed",
    )


def scan_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of all token files in a folder. Block rows, with the places found, are written once and scanned after."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return documents_in(materialize(scan_blocks(files, block_tokens), "blocks"))


def part_number(path: str = "path"):
    """Number of the partition that wrote a file."""
    return F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).cast("int")
