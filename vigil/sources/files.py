"""File sources and sinks (survey 2.1 A1-A4, A7-A10).

Scratch output of the registered queries goes under the session's
``spark.checkpoint.dir`` (the shared folder the cluster names), never a
machine-local temporary folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import ensure_checkpoint_dir
from vigil.sources import versions as V


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """Paths of the folder's files with the suffix, listed by the
    ``binaryFile`` source (only path and length are read)."""
    try:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
                 .load(folder).select("path").collect())  # one row per file, not per record
    except AnalysisException:
        return []
    return sorted(r["path"] for r in files)


def headers(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """First line of each file, in one scan: the lines of each file's first
    block, the earliest of them per file."""
    if not files:
        return {}
    lines = (spark.read.text(files)
             .select("value", F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("pos"))
             .where(F.col("block") == 0))
    first = lines.groupBy("path").agg(F.min_by("value", "pos").alias("header")).collect()
    return {r["path"]: r["header"] for r in first}


class Unreadable(str):
    """A file left out of a read: its path, and how many of its lines could be read."""
    lines: int

    def __new__(cls, path: str, lines: int = 0):
        self = super().__new__(cls, path)
        self.lines = lines
        return self


def corrupt_files(spark: SparkSession, files: list[str]) -> list[Unreadable]:
    """Files whose content cannot be read to the end. One scan for all; where
    it fails the list is halved, so good files are read about log2(n) times."""
    if not files:
        return []
    lines = lambda some, **o: spark.read.options(**o).text(some).count()
    try:
        lines(files)
        return []
    except Exception:
        if len(files) > 1:
            half = len(files) // 2
            return corrupt_files(spark, files[:half]) + corrupt_files(spark, files[half:])
    return [Unreadable(files[0], lines(files, ignoreCorruptFiles="true"))]


def read_csv_folder(spark: SparkSession, folder: str, empty_schema: str = "is_ato int", verify: bool = True) -> tuple[DataFrame, list[Unreadable]]:
    """A1: every CSV of a folder, all columns as text, unioned by column
    name (missing → null).  Files are grouped by header line so there is
    one read per distinct schema.  Files without a header, and those that
    cannot be read to their end, are left out whole and listed with the number of
    lines that could be read (``verify`` scans the text once for that; without
    it such a file fails the job that meets it).
    No file (or none readable) gives an empty frame of ``empty_schema``."""
    files = list_files(spark, folder)
    errors = corrupt_files(spark, files) if verify else []
    heads = headers(spark, [f for f in files if f not in set(errors)])
    groups: dict[str, list[str]] = {}
    for f in files:
        if f in set(errors):
            continue
        h = heads.get(f)
        if h is None or not h.strip():
            errors.append(Unreadable(f))
            continue
        groups.setdefault(h, []).append(f)
    frames = [spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
              .option("mode", "PERMISSIVE").csv(some) for some in groups.values()]
    if not frames:
        return spark.createDataFrame([], empty_schema), errors
    out = frames[0]
    for fr in frames[1:]:
        out = out.unionByName(fr, allowMissingColumns=True)
    return out, errors


def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A2 / A10: parquet table (overwrite)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


LIST_ENTRY = T.StructType([
    T.StructField("count", T.LongType()), T.StructField("account", T.StringType()),
    T.StructField("fraud_confirmed", T.BooleanType()), T.StructField("last_updated", T.StringType()),
    T.StructField("reason", T.StringType())])


def write_list_documents(lists: DataFrame, folder: str) -> None:
    """A4: each list as JSON-lines documents, one ``{"key": {...}}`` object
    per line, partitioned by list — splittable, so no document is ever
    one task's whole input. ``folder`` is new; :func:`publish_lists` makes it
    the current version."""
    entry = F.struct(F.col("count").cast("long").alias("count"), "account", "fraud_confirmed",
                     F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated"), "reason")
    docs = lists.select("list", F.to_json(F.create_map(F.col("key"), entry)).alias("value"))
    docs.write.mode("overwrite").partitionBy("list").text(folder)


def publish_lists(lists: DataFrame, root: str) -> V.Version:
    """A4: the lists as a new version under ``root``; readers see the old one until it is whole."""
    return V.publish(lists.sparkSession, root, lambda folder: write_list_documents(lists, folder))


def read_published_lists(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """A3 + G7 of the current version, or the given one; nothing published gives an empty frame."""
    found = V.current(spark, root, number)
    return read_list_documents(spark, found.path if found else f"{root}/nothing")


def read_list_documents(spark: SparkSession, folder: str, whole_file: bool = False) -> DataFrame:
    """A3 + G7: read list documents (JSON objects keyed by entity, one per
    line; or one object per file with ``whole_file``) and flatten them to
    rows; an absent folder gives an empty typed frame."""
    schema = "list string, key string, count long, account string, fraud_confirmed boolean, " \
             "last_updated string, reason string"
    try:
        raw = spark.read.text(folder, wholetext=whole_file)
    except AnalysisException:  # absent folder = empty list
        return spark.createDataFrame([], schema)
    if "list" not in raw.columns:
        raw = raw.withColumn("list", F.regexp_extract(F.input_file_name(), r"([a-z]+)_blacklist\.json$", 1))
    m = F.from_json("value", T.MapType(T.StringType(), LIST_ENTRY))
    return (raw.select("list", F.explode(m).alias("key", "v"))
               .select("list", "key", "v.count", "v.account", "v.fraud_confirmed", "v.last_updated", "v.reason"))


#: Rows of a replay feed that make a file (and, read one a trigger, a micro-batch).
SLICE_ROWS = 25_000
#: Rows of a micro-batch of a long feed: a batch costs seconds of planning, state
#: commits and sink commits whatever it holds.
BATCH_ROWS = 1_000_000


def slices_for(rows: int) -> int:
    """Files of a feed of so many rows: one per SLICE_ROWS, at least four."""
    return max(4, -(-rows // SLICE_ROWS))


def files_per_batch(rows: int) -> int:
    """Files a trigger of a feed of so many rows: up to BATCH_ROWS in a
    micro-batch, and at least four micro-batches."""
    return max(1, min(BATCH_ROWS // SLICE_ROWS, slices_for(rows) // 4))


def publish_messages(df: DataFrame, folder: str | None, stamp: str, files: int | None = None,
                     order: list[str] | None = None, kafka_options: dict | None = None) -> None:
    """NaN → null, a ``streamed_at`` stamp (a parameter, so replays are
    repeatable), one JSON message per line — to a folder, or to a topic
    with ``kafka_options`` (``kafka.bootstrap.servers``, ``topic``)."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    d = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in num}).withColumn("streamed_at", F.lit(stamp))
    if files:
        d = d.repartitionByRange(files, *[F.col(c) for c in order]) if order else d.repartition(files)
    out = d.select(F.to_json(F.struct(*d.columns)).alias("value"))
    if kafka_options is not None:
        out.write.format("kafka").options(**kafka_options).save()
        return
    out.write.mode("overwrite").option("compression", "gzip").text(folder)


def publish_in_time_order(df: DataFrame, folder: str, time_col: str, slices: int, value: str = "value") -> None:
    """S6 replay feed: write ``value`` lines in ``slices`` files of consecutive
    time ranges, so that a file source (which replays files by modification
    time) sees the feed in event-time order. The files are written by one job and
    then handed over in their order, each with a later modification time."""
    spark = df.sparkSession
    epoch = F.unix_micros(F.col(time_col).cast("timestamp"))
    dealt = scratch_dir(spark, "replay")
    (df.select(F.col(value).alias("value"), epoch.alias("e")).repartitionByRange(slices, "e")
     .select("value").write.option("compression", "gzip").text(dealt))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(dealt).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(path(dealt))
    fs.mkdirs(path(folder))
    last = lambda d: max((f.getModificationTime() for f in fs.listStatus(path(d)) if f.isFile()), default=0)
    parts = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(path(dealt))) if n.startswith("part-"))
    at = max(last(folder), last(dealt) - len(parts))
    for i, name in enumerate(parts):  # one a slice, in order of the ranges
        part = path(f"{dealt}/{name}")
        fs.setTimes(part, at + 1 + i, -1)
        if fs.getFileStatus(part).getModificationTime() != at + 1 + i:  # a store that keeps only its own times
            spark.read.text(f"{dealt}/{name}").write.mode("append").text(folder)
        elif not fs.rename(part, path(f"{folder}/{name}")):
            raise OSError(f"{name} could not be moved to {folder}")


def newest(df: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """Keep the newest n messages (TakeOrdered)."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in an explicit order."""
    return df.orderBy(order).limit(n)
