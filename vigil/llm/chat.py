"""Operator 7: relational chat formatting, Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent
turns of one role are merged by an array aggregation, and the blocks are
concatenated:

    <|role:user|>
    first text<|turn|>second text of the same role<|end|>

Every control string begins with ``<``, so escaping ``&`` and ``<`` in texts
(and ``|`` in roles) makes them unmistakable and is undone exactly. The loss
mask is a list of spans (start, end in code points of the formatted text), one
per text of a learned role and without markers. ``read_back`` recovers the
turns from the formatted text alone.

A conversation is one value in the result, so its turns meet in one row by
definition; grouping is on the conversation and nothing wider.

Defined cases: null text is empty, null role is the empty role; turns with
equal numbers (and null ones, first) are ordered by role, then text; repeated
rows repeat; null conversations form one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import table

ROLE, ROLE_END, TURN, END = "<|role:", "|>\n", "<|turn|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("|"), F.lit("&bar;"))


def _role_back(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&bar;"), F.lit("|")))


def _merged(turns: Column) -> Column:
    """array<struct<role, texts>> of adjacent turns of one role."""
    def one(t: Column) -> Column:
        return F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))

    def add(blocks: Column, t: Column) -> Column:
        last = F.element_at(blocks, -1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        joins = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == t["role"])
        return F.when(joins, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer))).otherwise(F.concat(blocks, F.array(one(t))))

    return F.aggregate(turns, F.expr("CAST(array() AS array<struct<role:string,texts:array<string>>>)"), add)


def format_conversations(turns: DataFrame, learned: tuple[str, ...] = ("assistant",), conv: str = "conv_id",
                         order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation."""
    row = F.struct(F.col(order).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blocks = (turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
              .select("conv_id", _merged(F.col("turns")).alias("blocks")))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(ROLE), _role(b["role"]), F.lit(ROLE_END),
        F.array_join(F.transform(b["texts"], escaped), TURN), F.lit(END))), "")
    # what stands before each text since the one before it, and its own length
    steps = F.flatten(F.transform("blocks", lambda b, i: F.transform(b["texts"], lambda t, j: F.struct(
        F.when(j > 0, F.lit(len(TURN))).otherwise(F.when(i > 0, F.lit(len(END))).otherwise(F.lit(0))
                                                  + F.lit(len(ROLE) + len(ROLE_END)) + F.length(_role(b["role"]))).alias("skip"),
        F.length(escaped(t)).alias("own"), b["role"].isin(*learned).alias("learned")))))
    empty = F.expr("CAST(struct(0, array()) AS struct<at:int,spans:array<struct<start:int,end:int>>>)")
    spans = F.aggregate(steps, empty, lambda done, s: F.struct(
        (done["at"] + s["skip"] + s["own"]).alias("at"),
        F.when(s["learned"], F.concat(done["spans"], F.array(F.struct((done["at"] + s["skip"]).alias("start"),
                                                                       (done["at"] + s["skip"] + s["own"]).alias("end")))))
        .otherwise(done["spans"]).alias("spans")), lambda done: done["spans"])
    return blocks.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns, from the formatted text alone."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.locate(ROLE_END, block)
        role = _role_back(F.substr(block, F.lit(len(ROLE) + 1), head - F.lit(len(ROLE) + 1)))
        body = F.substr(block, head + F.lit(len(ROLE_END)))
        return F.transform(F.split(body, r"<\|turn\|>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    # locate() takes a literal needle and a column only outside lambdas in some versions, so it is spelt as position()
    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def op7_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, read back from the formatted text."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"),
                 F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    made = format_conversations(given.unionByName(own))
    read = made.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                       masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS begins,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS own,
         length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&bar;')) AS role_chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(own + CASE WHEN begins THEN {len(ROLE) + len(ROLE_END) + len(END)} + role_chars ELSE {len(TURN)} END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
