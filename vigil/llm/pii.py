"""Operator 4: personal data by bootstrapped contextual extraction.

One pass over the whole texts finds the base entities (email, ip, card, phone;
fixed patterns with their checks, linear in the text) and what else could be an
identifier: a token with a digit, an ``@`` or a spelt-out ``(at)``, a run of digit
groups with the tokens it lies in, or words spelt ``name at host dot org``; none
overlaps a base entity. Each occurrence is kept with its lexical patterns, the two
whole words before it and the words around it (a word above ``LONG_WORD``
characters stands by its digest).

The occurrences form a bipartite graph of patterns and values. Base entities are
seeds of score 1. In each round Spark scores every pattern for a kind by the mass
of known values among all values it goes with (at least ``min_support`` different
known ones), and every unknown value by the patterns it occurs in (noisy or);
values above ``min_value`` become known with their score. The rounds end when one
finds no further value (scores only rise, so the rounds do end). The occurrences
of discovered values are added as spans; base spans stay.

The graph is written once and holds occurrences only, never texts; patterns and
values are aggregated before each join, so a pattern or a value that occurs in
a third of all rows is a pre-aggregated sum or one side of a join that adaptive
execution splits.

Defined cases: null text is empty; offsets are code points, ends exclusive; the
spans of a document are ordered by start, then kind as listed; repeated rows
repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import id_and_text, table
from vigil.session import materialize

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the fixed patterns: they match the same and stay linear on very long runs.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]|[(\[]at[)\]]")
_REST = re.compile(r"\S*")
_GROUPS = re.compile(r"[0-9]++(?:(?:[ .-]?\(|\)[ .-]?|[ .-])[0-9]++)*+")
_SPELT = re.compile(r" (?:at|[(\[]at[)\]]) [a-z0-9-]++(?: (?:dot|[(\[]dot[)\]]) [a-z0-9-]++)++", re.IGNORECASE)
_DIGIT = re.compile(r"[0-9]")
_TRIM = "\"'`.,;:!?()[]{}<>|*#%$&="
MIN_VALUE_CHARS = 5
LONG_WORD = 40


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_entities(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) ordered by start, then kind."""
    found: list[tuple[int, int, int]] = []
    floor = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, m.end(), 0))
                floor = m.end()
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def _word_start(text: str, at: int, floor: int) -> int:
    while at > floor and not text[at - 1].isspace():
        at -= 1
    return at


def _spelt(text: str) -> list[tuple[int, int]]:
    """(start, end) of the addresses written in words."""
    found: list[tuple[int, int]] = []
    floor = 0
    for m in _SPELT.finditer(text):
        start = _word_start(text, m.start(), floor)
        while start < m.start() and text[start] in _TRIM:
            start += 1
        if start < m.start():
            found.append((start, m.end()))
        floor = m.end()
    return found


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what else could be an identifier, ordered."""
    found: list[tuple[int, int]] = []
    floor, k = 0, 0
    busy = sorted((a, b) for a, b, _ in taken)
    for start, end in _spelt(text):
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        if not (k < len(busy) and busy[k][0] < end):
            found.append((start, end))
    busy = sorted(busy + found)
    k = 0
    for m in _ANCHOR.finditer(text):
        if m.start() < floor:
            continue
        start = _word_start(text, m.start(), floor)
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        stop = busy[k][0] if k < len(busy) else len(text)
        if stop <= m.start():  # this token is taken, as a whole or in part
            floor = _REST.match(text, max(busy[k][1], m.end())).end()
            continue
        groups = _GROUPS.match(text, m.start(), stop)
        last = groups.end() if groups else m.end()
        end = floor = _REST.match(text, last).end()
        while start < end and (text[start] in _TRIM or text[start].isspace()):
            start += 1
        while start < end and (text[end - 1] in _TRIM or text[end - 1].isspace()):
            end -= 1
        if start and text[start - 1] == "(" and ")" in text[start:end]:  # the bracket of an area code
            start -= 1
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        if end - start >= MIN_VALUE_CHARS and not (k < len(busy) and busy[k][0] < end):
            found.append((start, end))
    return sorted(found)


def _near(text: str, at: int, words: int, step: int) -> list[str]:
    """The last (step -1) or first (step 1) whole words beside a place, long ones by their digest."""
    reach = 64
    while True:
        lo, hi = (max(0, at - reach), at) if step < 0 else (at, min(len(text), at + reach))
        part = text[lo:hi]
        found = part.split()
        whole = lo == 0 if step < 0 else hi == len(text)
        if whole or len(found) > words or len(found) == words and part[0 if step < 0 else -1].isspace():
            break
        reach *= 4
    found = found[-words:] if step < 0 else found[:words]
    return [w if len(w) <= LONG_WORD else "#" + hashlib.sha256(w.encode("utf-8", "surrogatepass")).hexdigest()[:24]
            for w in (_DIGIT.sub("9", w.lower()) for w in found)]


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an occurrence: the two words before it, and the words around it."""
    before = _near(text, start, 2, -1)
    after = _near(text, end, 1, 1)
    out = [" ".join(before) + " _"] if len(before) == 2 else []
    return [*out, f"{before[-1]} _ {after[0]}"] if before and after else out


def extract(docs: DataFrame) -> DataFrame:
    """One row per document: row, doc_id, base (start, end, kind) and the
    occurrences (start, end, kind or -1, value, patterns)."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])
    seen = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string()),
                      ("patterns", pa.list_(pa.string()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            bases, occurrences = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_entities(text)
                bases.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
                occurrences.append([{"start": a, "end": b, "kind": k, "value": text[a:b], "patterns": patterns(text, a, b)}
                                    for a, b, k in [*base, *((a, b, -1) for a, b in candidates(text, base))]])
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(bases)), pa.int64()), batch.column("doc_id"),
                                              pa.array(bases, pa.list_(span)), pa.array(occurrences, pa.list_(seen))],
                                             ["row", "doc_id", "base", "seen"])
            row += len(bases)

    return id_and_text(docs).mapInArrow(read, "row long, doc_id long, base array<struct<start:int,end:int,kind:int>>, "
                                              "seen array<struct<start:int,end:int,kind:int,value:string,patterns:array<string>>>")


def discover(extracted: DataFrame, min_support: int = 3, min_pattern: float = 0.5, min_value: float = 0.7) -> DataFrame:
    """(value, kind, score) of the values that the pattern graph finds beside the seeds."""
    seen = extracted.select(F.explode("seen").alias("s")).select("s.kind", "s.value", "s.patterns")
    edges = materialize(seen.select("kind", "value", F.explode("patterns").alias("pattern")).distinct(), "pattern-edges")
    seeds = materialize(seen.filter("kind >= 0").select("value", "kind").distinct().withColumn("score", F.lit(1.0)), "seeds")
    totals = edges.groupBy("pattern").agg(F.countDistinct("value").alias("values"))
    open_edges = edges.filter("kind < 0").select("value", "pattern")
    known = seeds
    values = 0
    while True:
        held = (edges.select("value", "pattern").distinct().join(known, "value").groupBy("pattern", "kind")
                .agg(F.count(F.lit(1)).alias("support"), F.sum("score").alias("mass")).filter(F.col("support") >= min_support))
        scored = (held.join(totals, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("values") + 1)).alias("trust"))
                  .filter(F.col("trust") >= min_pattern))
        miss = F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))))
        per_kind = open_edges.join(scored, "pattern").groupBy("value", "kind").agg((1 - miss).alias("score"))
        best = Window.partitionBy("value").orderBy(F.desc("score"), "kind")
        found = materialize(per_kind.filter(F.col("score") >= min_value).withColumn("_n", F.row_number().over(best))
                            .filter("_n = 1").drop("_n"), "discovered")
        now = found.count()
        if now <= values:
            return found
        values, known = now, seeds.unionByName(found.join(seeds.select("value"), "value", "left_anti"))


def personal_data(docs: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, end, kind, score), base ones with score 1."""
    extracted = materialize(extract(docs), "entities")
    found = discover(extracted, **limits)
    more = (extracted.select("row", F.explode("seen").alias("s")).filter("s.kind < 0")
            .select("row", "s.start", "s.end", "s.value").join(found, "value")
            .groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "score")).alias("more")))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                  F.lit(1.0).alias("score")))
    both = F.array_sort(F.concat(base, F.coalesce("more", F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int,score:double>>)"))))
    return extracted.join(more, "row", "left").select("doc_id", base.alias("base"), both.alias("spans"))


def _joined(spans):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts and digest of the base spans, and all spans."""
    found = personal_data(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(i) for i in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))

