"""Operator 12: exact token counts with a whole-token shortcut.

A byte-level BPE file cuts a text into pre-tokens and merges each on its own,
so a pre-token's number of tokens depends on nothing around it. Before the job,
:func:`proven_whole` encodes every string of the vocabulary alone and keeps
those that come out as one token; a pre-token that is one of them counts one
and is never merged. Only the others are merged, by the library's own model,
and the count of each distinct one is remembered in the task.

* The proof goes to the tasks as a broadcast; it holds at most the vocabulary.
* Pre-tokens are found by the published pattern. The library's character tables
  may be of another Unicode version than the pattern engine's, so each distinct
  character beyond ASCII is first tried in :data:`_TRIALS` by both; a text
  with one that they cut differently is cut by the library.
* Special strings inside a text are one token each, as the library's default has it.
* The map needs no shuffle and keeps no state across rows but what it remembers.

Defined cases: null text counts as empty, an empty text has no bytes and no
tokens; null and repeated ids are carried as they are; texts of any length are
counted whole, very long ones without listing their pre-tokens; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import id_and_text, table

#: Distinct merged pre-tokens a task remembers; a full memory is emptied.
REMEMBERED = 400_000
#: Longer pre-tokens are merged each time and not remembered.
REMEMBERED_CHARS = 64
#: From this length on a text's pre-tokens are walked, not listed.
WALKED_CHARS = 1 << 20
#: A character in the company of letters, digits, signs, white space, itself and an apostrophe.
_TRIALS = "a{0}a 1{0}1 !{0}! \n{0} {0}{0}  {0}'s{0}"


def _letters() -> list[str]:
    """The letter that byte-level files write for each byte: printable bytes
    stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class BytePairFile:
    """A byte-level BPE file: its library, pattern and special strings."""

    def __init__(self, path: str):
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
                or model["type"] != "BPE" or model.get("dropout"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"added tokens that reach into the text around them: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(PATTERN)
        self.letters = dict(enumerate(_letters()))
        backwards = {letter: b for b, letter in self.letters.items()}
        self.vocabulary = [bytes(backwards[c] for c in token) for token in model["vocab"] if token not in self.specials]

    def merged(self, pre_token: str) -> int:
        """Number of tokens of one pre-token, by the library's merges."""
        return len(self.tokenizer.model.tokenize(pre_token.encode("utf-8").decode("latin-1").translate(self.letters)))

    def cuts_alike(self, character: str) -> bool:
        trial = _TRIALS.format(character)
        return [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(trial)] == [m.span() for m in self.pattern.finditer(trial)]


@lru_cache(maxsize=2)
def file_of(path: str) -> BytePairFile:
    """One for all tasks of a Python worker."""
    return BytePairFile(path)


def proven_whole(path: str) -> list[str]:
    """The vocabulary strings that the library encodes, alone, as their one token.

    One token means one pre-token, and a pre-token's merges see nothing else:
    wherever such a string is a pre-token it is exactly one token. Pieces of
    characters are no strings and cannot be pre-tokens."""
    file = file_of(path)
    strings = []
    for token in file.vocabulary:
        try:
            strings.append(token.decode("utf-8"))
        except UnicodeDecodeError:
            continue
    strings = [s for s in strings if not any(special in s for special in file.specials)]
    encoded = file.tokenizer.encode_batch(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1]


class Counts(dict):
    """Tokens of each pre-token: one for the proven strings, merged and remembered for the rest."""

    def __init__(self, file: BytePairFile, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.file, self.whole, self.limit = file, whole, len(whole) + REMEMBERED

    def __missing__(self, pre_token: str) -> int:
        n = self.file.merged(pre_token)
        if len(pre_token) <= REMEMBERED_CHARS:
            if len(self) >= self.limit:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[pre_token] = n
        return n


class TokenCounter:
    """Number of tokens of whole texts."""

    def __init__(self, path: str, whole: list[str]):
        self.file = file_of(path)
        self.counts = Counts(self.file, whole)
        self.alike: set[str] = {chr(c) for c in range(128)}
        self.unlike: set[str] = set()
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.file.specials, key=len, reverse=True)))) if self.file.specials else None

    def _settled(self, text: str) -> bool:
        """Whether the pattern cuts the text as the library does."""
        if text.isascii():
            return True
        new = set(text) - self.alike
        for character in new - self.unlike:
            (self.alike if self.file.cuts_alike(character) else self.unlike).add(character)
        return new.isdisjoint(self.unlike)

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not self._settled(text):
            spans = (span for _, span in self.file.tokenizer.pre_tokenizer.pre_tokenize_str(text))
            return sum(self.counts[text[a:b]] for a, b in spans)
        if len(text) >= WALKED_CHARS:
            return sum(self.counts[m.group()] for m in self.file.pattern.finditer(text))
        return sum(map(self.counts.__getitem__, self.file.pattern.findall(text)))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens): one row per document."""
    whole = docs.sparkSession.sparkContext.broadcast(proven_whole(tokenizer_path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer_path, whole.value)
        for batch in batches:
            texts = batch.column("text")
            tokens = pa.array(map(counter.count, texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), tokens, pc.greater(tokens, limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    filled = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return filled.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
