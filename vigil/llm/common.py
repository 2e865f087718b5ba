"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.session import ensure_session_defaults


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the session defaults (UTC, shared folder, package on
    the executors) are set on the way."""
    ensure_session_defaults(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key (as long) and the text: any other column, whatever its
    name, cannot clash with what an operator adds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def content_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id and content are in
    ``kept(doc_id, text_md5)``; of repeated rows one. Ids may be null. The text
    moves once, for the join; the numbering uses the join's partitions."""
    keyed = docs.select("*", F.col(id_col).cast("long").alias("__id"), content_key(F.col(text_col)).alias("__key"))
    wanted = kept.select(F.col("doc_id").alias("__kept_id"), F.col("text_md5").alias("__kept_key"))
    joined = keyed.join(wanted, F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__key") == F.col("__kept_key")), "left_semi")
    first = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(F.lit(0)))
    return joined.withColumn("__n", first).filter("__n = 1").select(*[joined[c] for c in docs.columns])


def filter_rows(docs: DataFrame, text_col: str, rejects: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows whose text is not rejected, every column untouched, without a
    shuffle. ``rejects()`` is called once per task and gives the function from
    texts to verdicts."""
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = rejects()
        for batch in batches:
            yield batch.filter(pa.array([not bad for bad in judge(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
