"""Indexed archive containers for very many tiny files (problem 1).

``pack`` concatenates original bytes into blocks and stores, beside each block,
the path, offset, length and checksum of every member.  A container file is a
Parquet file of such blocks, so any file system that Spark can write will do;
the index is the same table read without its payload column.  Packing is a
map-only job: no shuffle, no driver-side listing, one block in memory per task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeassay.session import default_parallelism, materialize, ship_package

ENTRY = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("crc32", T.LongType()),
    ]
)
BLOCK = T.StructType([T.StructField("block_id", T.LongType()), T.StructField("entries", T.ArrayType(ENTRY)), T.StructField("payload", T.BinaryType())])

_ARROW_ENTRY = pa.struct([("file_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("crc32", pa.int64())])
_ARROW_BLOCK = pa.schema([("block_id", pa.int64()), ("entries", pa.list_(_ARROW_ENTRY)), ("payload", pa.binary())])


def pack_batches(batches: Iterable[pa.RecordBatch], first_block: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at least ``block_bytes`` from batches of (file_id, path, content)."""
    block, ids, paths, offsets, lengths, sums, parts, at = first_block, [], [], [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        entries = pa.StructArray.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
            fields=list(_ARROW_ENTRY),
        )
        members = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), entries)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), members, pa.array([b"".join(parts)], pa.binary())], schema=_ARROW_BLOCK)

    for batch in batches:
        for file_id, path, content in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(file_id)
            paths.append(path)
            offsets.append(at)
            if content is None:
                lengths.append(None)
                sums.append(None)
            else:
                lengths.append(len(content))
                sums.append(zlib.crc32(content))
                parts.append(content)
                at += len(content)
            if at >= block_bytes or len(ids) >= 1 << 20:
                yield flush()
                block, ids, paths, offsets, lengths, sums, parts, at = block + 1, [], [], [], [], [], [], 0
    if ids:
        yield flush()


def pack(df: DataFrame, out_dir: str, *, file_id: str = "file_id", path: str = "image_path", content: str = "content", block_bytes: int = 1 << 20, container_bytes: int = 32 << 20) -> None:
    """Write every row of ``df`` into containers of about ``container_bytes`` under ``out_dir``.

    ``content`` may be text (stored as UTF-8) or binary.  Each row becomes one
    member, equal rows included: packing never drops or merges.  A null content
    is kept as a member of null length, an empty one as a member of length 0; a
    member longer than ``block_bytes`` gets a block that large.  Extra columns
    are not stored.  An empty ``df`` gives an archive without blocks.
    """
    spark = df.sparkSession
    ship_package(spark)
    members = df.select(F.col(file_id).cast("long").alias("file_id"), F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    total = members.agg(F.sum(F.coalesce(F.octet_length("content"), F.lit(0)))).first()[0] or 0
    parts = members.rdd.getNumPartitions()
    wanted = max(1, -(-total // container_bytes))
    if parts > wanted:
        # Fewer, larger inputs per task: no shuffle.  Small data keeps its cores busy.
        members = members.coalesce(max(wanted, min(parts, default_parallelism(spark))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack_batches(batches, TaskContext.get().partitionId() << 32, block_bytes)

    blocks = members.mapInArrow(run, BLOCK)
    blocks.write.mode("error").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(out_dir)


def archive(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(directory)


def index(spark: SparkSession, directory: str) -> DataFrame:
    """One row per member: block_id, file_id, path, offset, length, crc32; payloads are not read."""
    return archive(spark, directory).select("block_id", F.inline("entries"))


def members(blocks: DataFrame) -> DataFrame:
    """The members of blocks with their original bytes, sliced in the JVM.

    The slices are cut inside the block's row before it is exploded, so a block
    is never copied per member.  ``sound`` says whether the checksum holds.
    """
    # The payload is bound to a lambda variable: read as a column, it would be copied for every entry.
    cut = F.transform(
        F.array("payload"),
        lambda payload: F.transform(
            "entries",
            lambda e: F.struct(
                e["file_id"].alias("file_id"),
                e["path"].alias("path"),
                e["crc32"].alias("crc32"),
                F.when(e["length"].isNotNull(), F.substring(payload, e["offset"].cast("int") + 1, e["length"].cast("int"))).alias("content"),
            ),
        ),
    )[0]
    out = blocks.select(F.inline(cut))
    return out.select("file_id", "path", "content", (F.col("content").isNull() | (F.crc32("content") == F.col("crc32"))).alias("sound"))


def checked(members: DataFrame) -> DataFrame:
    """Members as they are; reading one whose checksum does not hold is an error that names it."""
    fault = F.raise_error(F.concat(F.lit("checksum of member "), F.coalesce(F.col("file_id").cast("string"), F.lit("null")), F.lit(" does not hold")))
    return members.withColumn("content", F.when(F.col("sound"), F.col("content")).otherwise(fault.cast("binary")))


#: Blocks that a lookup names one by one.
FEW_BLOCKS = 1 << 16


def lookup(spark: SparkSession, directory: str, paths: list[str]) -> DataFrame:
    """Members stored under the given paths, all of them.

    Up to ``FEW_BLOCKS`` blocks are named, so that others are not read; with
    more, every block is read where it lies and those without a path are dropped.
    """
    wanted = F.col("path").isin(paths)
    hits = index(spark, directory).where(wanted).select("block_id").distinct().limit(FEW_BLOCKS + 1).collect()
    few = len(hits) <= FEW_BLOCKS
    held = F.col("block_id").isin([r[0] for r in hits]) if few else F.exists("entries", lambda e: e["path"].isin(paths))
    return members(archive(spark, directory).where(held)).where(wanted)


def canonical_path(path: Column) -> Column:
    """The path as seen from one common root.

    Back slashes separate like slashes; empty and ``.`` steps vanish, ``..``
    takes back one step and nothing at the root.  Letter case counts.  Null
    stays null.
    """
    slashed = F.translate(path, "\\", "/")
    steps = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    plain = F.array_join(steps, "/")
    resolved = F.array_join(
        F.aggregate(
            steps,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
        ),
        "/",
    )
    return F.when(slashed.rlike(r"(^|/)\.\.(/|$)"), resolved).when(slashed.rlike(r"(^|/)\.?(/|$)"), plain).otherwise(slashed)


#: More lines than a file of the narrow position type may have.
LINE_SPAN = 1 << 24
FIELDS = ("cls", "x", "y", "w", "h")


def label_records(files: DataFrame, wide: bool = True) -> DataFrame:
    """The label records of members (file_id, path, content): file_id, line_no, image, the five values.

    A record is a line (split at line feeds, numbered from 1) with at least five
    blank-separated tokens; later tokens do not count.  Values are compared as
    numbers; if any of the five is not a number, ``odd`` holds all five as
    written and takes part in the comparison.  ``pos`` orders records by file
    and line and is unique if file ids are; see :func:`needs_wide` for ``wide``.
    """
    # The path is resolved once per file, below the explode.
    named = files.select("file_id", canonical_path(F.col("path")).alias("image"), F.col("content").cast("string").alias("content"))
    lines = named.select("file_id", "image", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    blank = F.btrim(F.translate("line", "\t\r\f\u000b", "    "))
    tokens = lines.select("file_id", "image", (F.col("n") + 1).alias("line_no"), F.split(blank, " +", 6).alias("t")).where(F.size("t") >= 5)
    five = F.concat_ws(" ", F.slice("t", 1, 5))
    values = [F.col("t")[i].try_cast("double") for i in range(5)]
    parsed = tokens.select("file_id", "line_no", "image", *[v.alias(f) for v, f in zip(values, FIELDS)], five.alias("five"), (F.translate("five", "0123456789+-.eE ", "") == "").alias("plain"))
    # Only these characters make a number: no infinities, hexadecimals or type suffixes.
    numeric = F.col("plain")
    for f in FIELDS:
        numeric = numeric & F.col(f).isNotNull()
    out = parsed.select("file_id", "line_no", "image", *[F.when(F.col("plain"), F.col(f)).alias(f) for f in FIELDS], F.when(~numeric, F.col("five")).alias("odd"))
    return out.withColumn("pos", position_of(F.col("file_id"), F.col("line_no"), wide))


def position_of(file_id: Column, line_no: Column, wide: bool) -> Column:
    """One number that orders records by file, then line: a long where file ids allow, else a decimal."""
    if wide:
        return file_id.cast("decimal(20,0)") * F.lit(LINE_SPAN).cast("decimal(10,0)") + line_no
    return file_id * F.lit(LINE_SPAN) + line_no


def needs_wide(spark: SparkSession, directory: str) -> bool:
    """Whether file ids or line numbers are too large for positions in a long."""
    m = index(spark, directory).agg(F.max(F.abs("file_id")).alias("i"), F.max("length").alias("n")).first()
    return (m["i"] or 0) >= 1 << 38 or (m["n"] or 0) >= LINE_SPAN


def first_records(records: DataFrame) -> DataFrame:
    """Each distinct record of each image once, with the position of its first occurrence.

    The minimum is combined on the map side, so a record that makes up a third
    of the input is one row per task when it is shuffled.  Records whose path is
    null belong to no image and are left out.
    """
    return records.where(F.col("image").isNotNull()).groupBy("image", *FIELDS, "odd").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n_copies"))


def repeated_records(records: DataFrame) -> DataFrame:
    """Positions (file_id, line_no) that repeat an earlier record of the same image.

    All positions minus the first ones: the join runs on positions, which are
    unique, so no image or record can become hot.  Records are grouped by 128
    bits of their hash, which keeps the shuffle to three numbers a row.  Those
    numbers are written once, so that no line is parsed twice.
    """
    key = ["image", *FIELDS, "odd"]
    named = records.where(F.col("image").isNotNull()).select(F.xxhash64(*key).alias("k1"), F.xxhash64(F.lit(1), *reversed(key)).alias("k2"), "pos", "file_id", "line_no")
    named = materialize(named, "records")
    first = named.groupBy("k1", "k2").agg(F.min("pos").alias("pos"))
    return named.select("pos", "file_id", "line_no").join(first.select("pos"), "pos", "left_anti").select("file_id", "line_no")
