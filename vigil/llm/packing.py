"""Operator 10: vector bin packing of tokenised examples.

A text becomes its token ids and one end id; every id but the end id bears loss.
Longer texts are cut so that no piece exceeds the capacity or the loss limit: the
pieces that fill either are sequences of their own, the remainder is an item with
a demand on three limits at once: tokens, segments (one) and loss-bearing tokens.
Items go to sequences by the dot-product heuristic: for
the open sequence, take the item that fits and has the largest dot product of
its demand with the room left (both scaled by the limits); when nothing fits,
open the next one. Items with equal demand are interchangeable, so a step
looks at the distinct demands only.

Tokenising happens once, in tasks that also number their pieces; the slim
pieces (no text, no ids) are written to the shared folder and dealt to packing
groups of about ``group_items`` by that number, so neither a common length nor
repeated rows make a large group.

Token ids: the text is cut where no token can cross (before a run of spaces
and line ends, see ``ChunkTokenizer``), and each distinct chunk is encoded by
the given tokenizer once per task while it is remembered; texts with other
white space or with the special token's string are encoded whole.

Defined cases: null text counts as empty, an empty text is the end id alone;
null and repeated ids are carried as they are; ties go to the larger number of
tokens, then of loss tokens; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import id_and_text, table
from vigil.session import materialize

#: Chunks a task remembers; a full memory is emptied.
REMEMBERED = 800_000
#: A chunk: an optional run of spaces and line ends, then everything up to the next one.
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")


class ChunkTokenizer:
    """Ids of whole texts from a byte-level BPE file whose pre-tokenizer lets
    a token begin with white space but never go on over it; cutting before a
    run of spaces and line ends is then the same as not cutting.

    Distinct chunks are encoded from the file's own vocabulary by ``tiktoken``
    (the same merges by rank, an order faster on single words); what cannot be
    cut is encoded whole by ``tokenizers``."""

    def __init__(self, path: str):
        import json
        import os

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable}  # byte-level files write the other bytes from code point 256 on
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.specials}
        self.tokenizer = Tokenizer.from_file(path)
        self.single = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.after_space = _Remembered(lambda word: self._one(" " + word))
        self.chunks = _Remembered(self._one)

    def _one(self, chunk: str) -> bytes:
        ids = array("I", self.single(chunk))
        return ids.tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if _OTHER_SPACE.search(text) or any(s in text for s in self.specials):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.after_space) + len(self.chunks) > REMEMBERED:
            self.after_space.clear()
            self.chunks.clear()
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in ("", " ", "\n") or text[-1] in " \n":
            return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))
        found: list[bytes] = []
        start = ""
        for line in text.split("\n"):
            words = line.split(" ")
            found.append(self.chunks[start + words[0]])
            found.extend(map(self.after_space.__getitem__, words[1:]))
            start = "\n"
        return b"".join(found)


class _Remembered(dict):
    """A dict that asks ``make`` for what it lacks."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> ChunkTokenizer:
    """One for all tasks of a Python worker."""
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, longest: int = 1024, end_id: int = 0,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    loss_tokens (all but the end id), _task and _n (its number in the task)
    and, on request, the ids as little-endian 32-bit bytes."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "_task", "_n"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, _task int, _n long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows: list[tuple] = []
            kept: list[bytes] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = tokenizer.ids(text or "") + end
                total = len(data) // 4
                for start in range(0, total, longest):
                    part = data[4 * start:4 * (start + longest)]
                    length = len(part) // 4
                    rows.append((doc_id, start, length, zlib.crc32(part), total, length - (start + length == total), task, n))
                    n += 1
                    if with_ids:
                        kept.append(part)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            arrays = [pa.array(c, pa.int32() if k == "_task" else pa.int64()) for k, c in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary())] if with_ids else arrays,
                                             [*names, "ids"] if with_ids else names)

    return id_and_text(docs).mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def dot_product_pack(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bin number of each item; demands is (items, dimensions) of whole
    numbers, each at most its limit."""
    kinds, kind_of = np.unique(demands, axis=0, return_inverse=True)  # ordered by the first dimension
    kind_of = kind_of.reshape(-1)
    left = np.bincount(kind_of, minlength=len(kinds))
    members = np.argsort(kind_of, kind="stable")
    following = np.cumsum(left) - left  # place in members of each kind's next item
    names = np.arange(len(kinds))       # of the kinds not used up
    scaled = kinds / limits
    bins = np.empty(len(demands), dtype=np.int64)
    current, room, gone = 0, limits.astype(np.int64).copy(), 0
    for _ in range(len(demands)):
        while True:
            n = int(np.searchsorted(kinds[:, 0], room[0], "right"))
            fits = left[:n] > 0
            for k in range(1, len(limits)):
                fits &= kinds[:n, k] <= room[k]
            score = (scaled[:n] @ (room / limits)) * fits - (~fits)
            best = n - 1 - int(np.argmax(score[::-1])) if n else 0  # ties: the larger demand
            if n and fits[best]:
                break
            current, room = current + 1, limits.astype(np.int64).copy()
        name = names[best]
        bins[members[following[name]]] = current
        following[name] += 1
        left[best] -= 1
        room = room - kinds[best]
        gone += left[best] == 0
        if gone * 4 > len(kinds):
            some = left > 0
            kinds, scaled, left, names, gone = kinds[some], scaled[some], left[some], names[some], 0
    return bins


def pack(items: DataFrame, capacity: int = 1024, max_segments: int = 64, max_loss: int | None = None,
         group_items: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to rows with length, loss_tokens, _task and
    _n (a number unique in the task). No item may exceed a limit; one that has
    the whole capacity, or nothing but loss and all of that, stays alone."""
    max_loss = capacity if max_loss is None else max_loss
    limits = np.array([capacity, max_segments, max_loss], dtype=np.int64)
    fills = (F.col("length") == capacity) | ((F.col("loss_tokens") == max_loss) & (F.col("length") == max_loss))
    above = (F.col("length") > capacity) | (F.col("loss_tokens") > max_loss) | F.lit(max_segments < 1)
    items = items.withColumn("length", F.when(above, F.raise_error(F.lit("an item exceeds a limit"))).otherwise(F.col("length")))
    full = items.filter(fills).select(
        "*", (F.shiftleft(F.col("_task").cast("long"), 36) + F.col("_n") + F.lit(1 << 62)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    rest = items.filter(~fills)
    groups = max(1, -(-rest.count() // group_items))
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_task", "_n"), F.lit(groups)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id long, offset long"

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_task", "_n"]).reset_index(drop=True)
        demands = np.column_stack([rows["length"], np.ones(len(rows), dtype=np.int64), rows["loss_tokens"]]).astype(np.int64)
        rows["sequence_id"] = (int(key[0]) << 32) + dot_product_pack(demands, limits)
        rows = rows.sort_values(["sequence_id", "_task", "_n"])
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows.drop(columns="_group")

    return full.unionByName(dealt.groupBy("_group").applyInPandas(place, schema))


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, max_segments: int = 64,
                     max_loss: int | None = None) -> DataFrame:
    """Pieces of whole documents in sequences; without a loss limit of its own a sequence may be all loss."""
    max_loss = capacity if max_loss is None else max_loss
    made = materialize(pieces(docs, tokenizer_path, min(capacity, max_loss)), "pieces")
    return pack(made, capacity, max_segments, max_loss).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of at most 1024 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"), default_tokenizer())
