"""File inventory and digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.guards import GateError
from ..session import shared_table_path
from .contract import INVENTORY

# Lines of one leaf of the digest tree.
LEAF_LINES = 4096
# A run of line hashes that stand together in a split; ``hashes`` is their bytes in order.
RUN_TYPES = {"file": pa.int64(), "split": pa.int64(), "first": pa.int64(), "n": pa.int64(), "hashes": pa.binary()}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, length) of every file, without reading contents."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")
    )


def missing_files(spark: SparkSession, folder: str, expected=INVENTORY) -> list[str]:
    wanted = spark.createDataFrame([(n,) for n in expected], "name string")
    # A source may be one file or a folder of part files under the same name.
    found = list_files(spark, folder).select(F.explode(F.split("path", "/")).alias("name")).distinct()
    lost = {r["name"] for r in wanted.join(found, "name", "left_anti").collect()}
    return [n for n in expected if n in lost]


def check_inventory(spark: SparkSession, folder: str, expected=INVENTORY) -> None:
    lost = missing_files(spark, folder, expected)
    if lost:
        raise FileNotFoundError(f"missing source files: {lost}")


def line_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line hashes put together as runs of one split: ``(file, split, first, n, hashes)``.

    A split comes in its order through one task; ``first`` numbers its lines from 0.
    """
    place, seen = None, 0
    for batch in batches:
        files, splits = (batch.column(name).to_numpy() for name in ("file", "split"))
        cuts = (np.flatnonzero((files[1:] != files[:-1]) | (splits[1:] != splits[:-1])) + 1).tolist()
        runs = []
        for start, end in zip([0, *cuts], [*cuts, len(files)]):
            for low in range(start, end, LEAF_LINES):
                here = (int(files[low]), int(splits[low]))
                place, seen = here, seen if here == place else 0
                hashes = batch.column("hash").slice(low, min(LEAF_LINES, end - low)).to_pylist()
                runs.append((*here, seen, len(hashes), b"".join(hashes)))
                seen += len(hashes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([run[i] for run in runs], kind) for i, kind in enumerate(RUN_TYPES.values())], list(RUN_TYPES)
        )


def file_digests(spark: SparkSession, path: str, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """(name, length, digest) per file: one definition for every size.

    The digest is a tree of SHA-256 values: over each line, over leaves of ``leaf_lines`` lines in
    their order, and over the leaves in their order together with the length in bytes. Files are
    read once, in splits of any size; lines are numbered through a file by the counts of its splits.
    Line hashes travel as runs, cut where a leaf ends. Files without a byte are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # Lines carry a number instead of the path; it must tell the files apart.
    files = files.select(F.col("_metadata.file_path").alias("path"), "length", F.xxhash64("_metadata.file_path").alias("file"))
    alone = F.count("*").over(Window.partitionBy("file")) == 1
    files = files.withColumn("file", F.when(alone, F.col("file")).otherwise(F.raise_error(F.lit("two paths have one hash")).cast("long")))
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    found = lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.unhex(F.sha2("value", 256)).alias("hash"),
    )
    target = shared_table_path(spark, "line-digests")
    found.mapInArrow(line_runs, "file long, split long, first long, n long, hashes binary").write.parquet(target)
    runs = spark.read.parquet(target)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = runs.groupBy("file", "split").agg(F.sum("n").alias("lines"))
    splits = splits.select("file", "split", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    # One row per split of a file, so the counts are small enough to travel.
    placed = runs.join(F.broadcast(splits), ["file", "split"]).withColumn("line", F.col("start") + F.col("first"))
    cut = placed.withColumn("leaf", F.explode(F.expr(f"sequence(line div {leaf_lines}, (line + n - 1) div {leaf_lines})")))
    low = F.greatest("line", F.col("leaf") * leaf_lines)
    high = F.least(F.col("line") + F.col("n"), (F.col("leaf") + 1) * leaf_lines)
    part = F.substring("hashes", ((low - F.col("line")) * 32 + 1).cast("int"), ((high - low) * 32).cast("int"))
    pieces = cut.select("file", "leaf", low.alias("line"), part.alias("hash"))
    in_order = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: F.hex(x[value]))
    leaves = pieces.groupBy("file", "leaf").agg(F.unhex(F.sha2(F.array_join(in_order("line", "hash"), ""), 256)).alias("hash"))
    roots = leaves.groupBy("file").agg(F.array_join(in_order("leaf", "hash"), "").alias("leaves"))
    joined = files.join(roots, "file", "left")
    root = F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.coalesce("leaves", F.lit(""))), 256)
    return joined.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.concat(F.lit("tree:"), root).alias("digest"))


def provenance(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two digest sets compared by name: same, different, or present on one side."""
    joined = left.alias("a").join(right.alias("b"), "name", "full_outer")
    verdict = (
        F.when(F.col("b.digest").isNull(), "left_only")
        .when(F.col("a.digest").isNull(), "right_only")
        .when(F.col("a.digest") == F.col("b.digest"), "same")
        .otherwise("different")
    )
    return joined.select("name", F.col("a.digest").alias("left_digest"), F.col("b.digest").alias("right_digest"), verdict.alias("verdict"))


def require_frozen(found: DataFrame, manifest: DataFrame) -> None:
    """Every manifest entry must match before an evaluation may start."""
    report = provenance(manifest, found)
    broken = [r["name"] for r in report.filter(~F.col("verdict").isin("same", "right_only")).collect()]
    if broken:
        raise GateError(f"frozen inputs changed: {broken}")
