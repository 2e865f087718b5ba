"""Operator 6: exact duplicates by deterministic block naming.

Every text (A-Z lower-cased, UTF-8) is cut into fixed-size blocks. The
distinct blocks are sorted and named by integers; then adjacent names are
paired, the distinct pairs are sorted and named, and so on, halving the
sequence until each document is one integer. Two documents end at the same
level with the same name exactly when their texts are equal: every step maps
distinct content to distinct names, so no hash decides anything.

* The text crosses the network once: each task drops the blocks it has seen
  before (hot blocks are combined there and again before the shuffle), and the
  distinct blocks meet on (hash, block). The hash only routes; where two
  blocks share one (``hash_bits`` shortens it in tests) their rank in the
  sorted blocks of that hash tells them apart, and documents holding such a
  block are joined on its content.
* Sorting is by bucket of the key: name = rank in the bucket * buckets + bucket.
* Every level is written to the shared folder, so a lost executor costs one level.
* Hot names are only grouped with partial aggregation or joined to a table
  with one row per name, which adaptive execution can split.

Defined cases: null text counts as empty, the empty text is one empty block;
null ids sort below all others; of repeated rows exactly one stays; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import id_and_text, keep_rows, table
from vigil.session import materialize

BLOCK_BYTES = 4096
BUCKETS = 4096
#: Blocks a task remembers to drop repeats before the shuffle; a full memory is emptied (repeats then meet in the shuffle).
REMEMBERED = 20_000


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased (bytes.lower touches nothing else)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i:i + size] for i in range(0, len(data), size)] or [b""]


def _hash(block: bytes, bits: int) -> int:
    value = xxhash.xxh64_intdigest(block) >> (64 - bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _distinct_blocks(docs: DataFrame, size: int, bits: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            hashes, blocks = [], []
            for text in batch.column("text").to_pylist():
                for block in _blocks(normalised(text), size):
                    digest = hashlib.md5(block).digest()
                    if digest not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(digest)
                        hashes.append(_hash(block, bits))
                        blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(blocks, pa.binary())], ["h", "block"])

    return docs.select("text").mapInArrow(cut, "h long, block binary").distinct()


def _occurrences(docs: DataFrame, size: int, bits: int, with_blocks: bool) -> DataFrame:
    """One row per document: a row number of its own, id, digest, and its blocks' hashes in order."""
    schema = "row long, doc_id long, text_md5 string, text_sha256 string, hs array<long>" + (", blocks array<binary>" if with_blocks else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            md5s, shas, hs, kept = [], [], [], []
            for text in batch.column("text").to_pylist():
                data = normalised(text)
                md5s.append(hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest())
                blocks = _blocks(data, size)
                shas.append(hashlib.sha256(data).hexdigest())
                hs.append([_hash(b, bits) for b in blocks])
                kept.append(blocks)
            columns = [pa.array(range(row, row + len(shas)), pa.int64()), batch.column("doc_id"),
                       pa.array(md5s, pa.string()), pa.array(shas, pa.string()), pa.array(hs, pa.list_(pa.int64()))]
            names = ["row", "doc_id", "text_md5", "text_sha256", "hs"]
            if with_blocks:
                columns.append(pa.array(kept, pa.list_(pa.binary())))
                names.append("blocks")
            row += len(shas)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _named(distinct: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Integer names of distinct keys: sort each bucket, rank * buckets + bucket."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)).cast("long") - 1
    return distinct.select(*keys, bucket.alias("_bucket")).select(*keys, (rank * buckets + F.col("_bucket")).alias("name"))


def document_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64,
                   buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, text_md5, text_sha256, level, name): one row per input row; (level,
    name) is equal exactly for equal normalised texts."""
    docs = id_and_text(docs)
    distinct = _distinct_blocks(docs, block_bytes, hash_bits)
    per_hash = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    ranked = per_hash.select("h", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("r"))
    names = materialize(_named(ranked, ["h", "r"], buckets), "block-names")
    shared = names.filter("r > 0").select("h").distinct()
    collided = not shared.isEmpty()
    attributes = ["row", "doc_id", "text_md5", "text_sha256"]
    rows = _occurrences(docs, block_bytes, hash_bits, collided)
    if collided:
        by_content = Window.partitionBy("h").orderBy("block")
        ranks = materialize(distinct.join(shared, "h", "left_semi")
                            .select("h", "block", (F.row_number().over(by_content) - 1).alias("r")), "block-ranks")
        spread = rows.select(*attributes, F.posexplode(F.arrays_zip("hs", "blocks")).alias("pos", "b"))
        spread = (spread.select(*attributes, "pos", F.col("b.hs").alias("h"), F.col("b.blocks").alias("block"))
                  .join(ranks, ["h", "block"], "left")
                  .groupBy(*attributes)
                  .agg(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("r", F.lit(0)).alias("r")))).alias("bs")))
        written = materialize(spread, "documents")
    else:
        rows = rows.withColumn("bs", F.transform("hs", lambda h, i: F.struct(i.alias("pos"), h.alias("h"), F.lit(0).alias("r"))))
        written = materialize(rows.select(*attributes, "bs"), "documents")
    ids = written.select("row", F.size("bs").alias("n"), F.explode("bs").alias("b"))
    level = materialize(ids.select("row", "n", "b.pos", "b.h", "b.r").join(names, ["h", "r"])
                        .select("row", "pos", "name", "n"), "level-0")
    done = level.filter("n = 1").select("row", F.lit(0).alias("level"), "name")
    longest = written.agg(F.max(F.size("bs"))).first()[0] or 1
    depth = 0
    while longest > 1:
        depth += 1
        longest = (longest + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = (level.filter("n > 1").groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
                 .agg(F.max(F.when(even, F.col("name"))).alias("left"),
                      F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("right"),
                      F.floor((F.max("n") + 1) / 2).cast("int").alias("n")))
        pair_names = _named(pairs.select("left", "right").distinct(), ["left", "right"], buckets)
        level = materialize(pairs.join(pair_names, ["left", "right"]).select("row", "pos", "name", "n"), f"level-{depth}")
        done = done.unionByName(level.filter("n = 1").select("row", F.lit(depth).alias("level"), "name"))
    return written.select(*attributes).join(done, "row")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_md5 for every row: of equal
    texts the row with the largest doc_id stays."""
    named = materialize(document_names(docs, block_bytes, hash_bits), "identities")
    # written, so that the join below has plain shuffles on both sides and a hot group's rows can be split
    groups = materialize(named.groupBy("level", "name")
                         .agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size")), "groups")
    return (named.join(groups, ["level", "name"])
            .select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256", "text_md5"))


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, all columns."""
    return keep_rows(docs, exact_duplicates(docs).filter("kept"))


def op6_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("text_md5")


OP6_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
