import hashlib
import random

import pytest

from vigil.llm.chat import format_conversations, masked_text, op7_relational_chat, read_back

NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n", "<|turn|>", "&lt;&amp;", "&bar;|>\n", "", "a\nb", "\U0001f600é", "<|role:user|>\n"]


def test_round_trip_of_control_strings(spark):
    from pyspark.sql import functions as F
    random.seed(4)
    rows = [(c, t, random.choice(["user", "assistant", "system", "we|rd<|end|>"]), random.choice(NASTY) + random.choice(NASTY))
            for c in range(40) for t in range(random.randint(1, 9))]
    made = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = made.select("conv_id", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"),
                      masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in got:
        mine = [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == mine
        assert r["loss"] == "".join(t for role, t in mine if role == "assistant")
        merged = sum(1 for i, (role, _) in enumerate(mine) if i == 0 or mine[i - 1][0] != role)
        assert r["formatted"].count("<|role:") == merged and len(r["loss_spans"]) == sum(role == "assistant" for role, _ in mine)


EDGE = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, None, None, "first"), (2, 1, "assistant", None),
        (None, 1, "user", "x"), (3, 1, "user", "same"), (3, 1, "user", "same"), (4, 0, "assistant", "long " * 20000)]


@pytest.mark.parametrize("rows", [EDGE, []])
def test_edge_rows(spark, tmp_path, rows):
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F
    d.withColumns({"formatted": F.lit(1), "turns": F.lit(2), "blocks": F.lit(3)}).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op7_relational_chat(spark, str(tmp_path)).collect()}
    every = rows + [(-1, 0, "user", NASTY[0]), (-1, 1, "assistant", NASTY[0])]
    assert set(got) == {r[0] for r in every}
    for c, r in got.items():
        mine = sorted(((t is not None, t or 0, role or "", x or "") for k, t, role, x in every if k == c))
        lines = "".join(f"{role}\n{x}\n" for _, _, role, x in mine)
        loss = "".join(x for _, _, role, x in mine if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256(lines.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_python_runs_on_the_executors(spark):
    plan = op7_relational_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
