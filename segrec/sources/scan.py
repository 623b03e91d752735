"""Reading and writing tables: typed scans without personal columns, checksums, manifests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrec.sources.schema import TABLES, Table
from segrec.sources.scratch import stored_in_small_batches


class IntegrityError(ValueError):
    """A source isn't what its manifest or schema says."""


def coerce(df: DataFrame, table: Table) -> DataFrame:
    """Declared columns cast to their types; a missing column is an error."""
    missing = [c.name for c in table.columns if c.name not in df.columns and not c.personal]
    if missing:
        raise IntegrityError(f"{table.name}: missing columns {missing}")
    return df.select(*[F.col(c.name).cast(c.kind).alias(c.name) for c in table.columns if c.name in df.columns])


def load(spark: SparkSession, sf_dir: str, name: str, drop_personal: bool = True) -> DataFrame:
    """A declared table; personal columns never leave the scan."""
    table = TABLES[name]
    rows = coerce(spark.read.parquet(f"{sf_dir}/{name}.parquet"), table)
    return rows.drop(*[c.name for c in table.columns if c.personal]) if drop_personal else rows


def load_all(spark: SparkSession, sf_dir: str, manifest: str | None = None) -> dict[str, DataFrame]:
    """All declared tables; with a ``manifest`` only if every file is as it says."""
    if manifest is not None:
        verify(spark, sf_dir, manifest)
    return {name: load(spark, sf_dir, name) for name in TABLES}


#: Bytes up to which a file is one value of one row; larger ones come in pieces of about ``PIECE``.
WHOLE, PIECE = 64 << 20, 16 << 10
#: Names of files that Spark's text reader would unpack.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|xz)$"
_MARK = b"\xef\xbb\xbf"


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, start of their split, line) in order, joined to pieces that are numbered within their split."""
    key, number, lines, size = None, 0, [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([number], pa.int64()), pa.array([b"\n".join(lines)], pa.binary())], names=["file", "start", "number", "piece"])

    for batch in batches:
        for file, start, line in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if lines and ((file, start) != key or size >= PIECE):
                yield made()
                number, lines, size = number + 1, [], 0
            if (file, start) != key:
                key, number = (file, start), 0
            lines.append(line)
            size += len(line) + 1
    if lines:
        yield made()


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each file from its pieces (file, bytes, piece) in order. A file's last line break and its byte order mark, which no line has, show in its length."""
    file, length, done, plain, marked = None, 0, 0, None, None

    def told() -> pa.RecordBatch:
        missing = length - done
        if missing not in (0, 1, len(_MARK), len(_MARK) + 1):
            raise ValueError(f"{file}: {done} of {length} bytes were read")
        digest = marked if missing >= len(_MARK) else plain
        if missing in (1, len(_MARK) + 1):
            digest.update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([digest.hexdigest()]), pa.array([length])], names=["file", "sha256", "bytes"])

    for batch in batches:
        for name, size, piece in zip(*(batch.column(c) for c in range(3)), strict=True):
            piece = piece.as_py()
            if name.as_py() != file:
                if file is not None:
                    yield told()
                file, length, done, plain, marked = name.as_py(), size.as_py(), len(piece), hashlib.sha256(), hashlib.sha256(_MARK)
            else:
                piece = b"\n" + piece
                done += len(piece)
            plain.update(piece)
            marked.update(piece)
    if file is not None:
        yield told()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, sha256, bytes) of the files under ``path``, by their place in it, read on the executors.

    A file of more than ``WHOLE`` bytes is read in splits as lines, whatever it holds; these are joined to pieces, which one task
    hashes in order as a stream: a digest is one chain, but no task holds a file, and none is too large for a value.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    folder = path.rstrip("/").rsplit("/", 1)[-1] + "/"
    inside = lambda at: F.when(F.contains(at, F.lit(folder)), F.substring_index(at, folder, -1)).otherwise(F.element_at(F.split(at, "/"), -1))
    read = lambda rows: rows.select(inside(F.col("path")).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    whole = read(files.where(F.col("length") <= WHOLE))  # the scan's own filter: what it leaves out isn't read
    larger = files.where(F.col("length") > WHOLE).select("path", "length").collect()  # a row for each file of more than WHOLE bytes
    packed = [r["path"] for r in larger if re.search(PACKED, r["path"].lower())]
    if packed:
        whole = whole.unionByName(read(spark.read.format("binaryFile").load(packed)))
    larger = [r for r in larger if r["path"] not in packed]
    if not larger:
        return whole
    at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.option("lineSep", "\n").text([r["path"] for r in larger]).select(inside(at).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = lines.mapInArrow(_piece_batches, "file string, start bigint, number bigint, piece binary")
    sizes = spark.createDataFrame([(r["path"], r["length"]) for r in larger], "path string, bytes bigint").select(inside(F.col("path")).alias("file"), "bytes")
    ordered = pieces.join(F.broadcast(sizes), "file").repartition("file").sortWithinPartitions("file", "start", "number").select("file", "bytes", "piece")
    return whole.unionByName(stored_in_small_batches(ordered.mapInArrow(_digest_batches, "file string, sha256 string, bytes bigint"), "checksums"))


def save_manifest(spark: SparkSession, tables: str, path: str, version: str) -> None:
    """Write the checksums of a stored table set, one JSON line for each file, with the set's version."""
    checksums(spark, tables).withColumn("version", F.lit(version)).write.mode("overwrite").json(path)


def check_integrity(spark: SparkSession, tables: str, manifest: str) -> DataFrame:
    """Rows (file, problem) where files and manifest differ: missing, unexpected or changed."""
    told = spark.read.schema("file string, sha256 string, bytes bigint, version string").json(manifest)
    found = checksums(spark, tables).select("file", F.col("sha256").alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("now") != F.col("sha256"), "changed")
    return told.join(found, "file", "full_outer").select("file", problem.alias("problem")).where("problem IS NOT NULL")


def verify(spark: SparkSession, tables: str, manifest: str) -> None:
    problems = check_integrity(spark, tables, manifest).limit(20).collect()
    if problems:
        raise IntegrityError(json.dumps([p.asDict() for p in problems]))


def set_version(*parts: str) -> str:
    """Identifier of an artifact set from what went into it."""
    import hashlib

    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:12]


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Sink in ``parquet``, ``json``, ``csv`` or ``orc``."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def inventory(df: DataFrame, name: str) -> DataFrame:
    """Rows (table, column, kind, n_rows, n_null, n_distinct) from one pass over the table."""
    total = df.agg(
        F.count("*").alias("n"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{i}") for i, c in enumerate(df.columns)],
        *[F.count_distinct(c).alias(f"distinct_{i}") for i, c in enumerate(df.columns)],
    )
    entries = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col("n").alias("n_rows"), F.col(f"null_{i}").alias("n_null"), F.col(f"distinct_{i}").alias("n_distinct")) for i, (c, k) in enumerate(df.dtypes)]
    return total.select(F.explode(F.array(*entries)).alias("e")).select(F.lit(name).alias("table_name"), "e.*")
