import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import prefixtrie
from vigil.llm.prefixtrie import (OP11_SQL, ends_digests, op11_prefix_trie, positions, prefix_trie, rebuilt, sketch_width, turn_digests)

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def sequences(rows):
    """The turns of each conversation in order."""
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [(r[3], r[4]) for r in sorted(v)] for c, v in found.items()}


def rebuilt_plainly(seqs):
    made = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = seqs.get(c - c % 100, [])[:h] + own[h:]
    return made


def brute(seqs):
    """Nodes by plain recursion over the sequences themselves."""
    members, last = defaultdict(list), {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        last[c] = tuple(seq)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    rows = []
    for node, mine in members.items():
        todo, leaves, saved = [node], 0, 0
        while todo:
            at = todo.pop()
            leaves += not children[at]
            saved += (len(members[at]) - 1) * (len(at[-1][1]) if at else 0)
            todo += children[at]
        ends = ",".join(map(str, sorted(c for c in mine if last[c] == node)))
        rows.append((min(mine), len(node), min(members[node[:-1]]) if node else None, len(mine), len(children[node]), leaves, saved,
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def rows_of(df):
    assert df.columns == COLUMNS and all(t in ("bigint", "string") for _, t in df.dtypes)
    return sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[0]))


def made(n, seed, turns=6, words=3):
    rng = random.Random(seed)
    return [(c, t, "user" if t % 2 == 0 else "assistant", "w" * rng.randint(1, words)) for c in range(n) for t in range(rng.randint(1, turns))]


def write(spark, rows, path):
    df = spark.createDataFrame(rows, SCHEMA)
    df.withColumns({k: F.lit(1) for k in ("digest", "chars", "pos", "n", "pid", "top", "depth")}).write.parquet(str(path / "conversations.parquet"))
    return str(path)


@pytest.mark.parametrize("cells", [prefixtrie.MOST_CELLS, prefixtrie.BLOCK_CELLS])
def test_against_plain_recursion(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(prefixtrie, "MOST_CELLS", cells)
    rows = made(330, 1)
    assert rows_of(op11_prefix_trie(spark, write(spark, rows, tmp_path))) == brute(rebuilt_plainly(sequences(rows)))


def test_a_sketch_far_too_small_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "_cells", lambda digests, width: np.zeros((4, len(digests)), dtype=np.int64) + np.arange(4)[:, None] * width)
    rows = made(60, 2)
    placed = positions(turn_digests(spark.createDataFrame(rows, SCHEMA)))
    assert rows_of(prefix_trie(placed.select("conv_id").distinct(), placed)) == brute(sequences(rows))


def test_a_crowded_sketch_keeps_tails_whole(spark):
    """Estimates of two in the midst of a tail: after a prefix proven single come some that are not."""
    rows = [(c, t, "user", f"{c % 7}" if t == 0 else f"{c} {t}") for c in range(1200) for t in range(25)]
    placed = positions(turn_digests(spark.createDataFrame(rows, SCHEMA)))
    got = prefix_trie(placed.select("conv_id").distinct(), placed, most_cells=prefixtrie.BLOCK_CELLS)
    assert rows_of(got) == brute(sequences(rows))


EDGE = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, None, None, "first"), (2, 1, "assistant", None), (None, 1, "user", "x"),
        (3, 1, "user", "same"), (3, 1, "user", "same"), (4, 0, "assistant", "long " * 20000), (205, 0, "user", "absent lead"), (-7, 1, "user", "é\U0001f600"),
        (100, 0, "user", "lead"), (100, 1, "assistant", "lead too"), (103, 0, "user", "own"), (104, 0, "user", "own"), (104, 1, "user", "own")]


@pytest.mark.parametrize("rows", [EDGE, EDGE[9:10], []])
def test_edge_rows(spark, tmp_path, rows):
    plain = sequences(rows)
    rebuilt_rows = {}
    for c, own in plain.items():  # the remainder has the sign of the id, as in SQL
        h, lead = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        rebuilt_rows[c] = plain.get(lead, [])[:h] + own[h:]
    assert rows_of(op11_prefix_trie(spark, write(spark, rows, tmp_path))) == brute(rebuilt_rows)


def test_conversations_over_many_tasks(spark):
    """Two copies of one long conversation, a third of all rows each, beside many short ones."""
    long = [("user", f"turn {i} " + "x" * (i % 7)) for i in range(1500)]
    seqs = {5: long, 9: [*long[:1400], ("user", "another end")], **{c: long[:c % 4] + [("user", str(c))] for c in range(10, 300)}, 400: long[:3], 401: long[:3]}
    rows = [(c, t, r, x) for c, seq in seqs.items() for t, (r, x) in enumerate(seq)]
    placed = positions(turn_digests(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    assert placed.agg(F.max("pos")).first()[0] == 1500
    got = rows_of(prefix_trie(placed.select("conv_id").distinct(), placed))
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[(d, hashlib.sha256(repr(seq[:d]).encode()).digest())].append(c)
    assert [(r[0], r[1], r[3]) for r in got] == sorted(((min(m), d, len(m)) for (d, _), m in members.items()), key=lambda r: (r[1], r[0]))
    root = got[0]
    assert root[5] == sum(1 for r in got if r[4] == 0)
    assert root[6] == sum((len(m) - 1) * max((len(seqs[m[0]][d - 1][1]) if d else 0), 0) for (d, _), m in members.items())


def test_ends_in_segments(spark):
    rows = [(bytes([i % 3]) * 16, i) for i in range(1000)] + [(b"z" * 16, -5)]
    got = {r["digest"]: r["ends_sha256"] for r in ends_digests(spark.createDataFrame(rows, "digest binary, conv_id long").repartition(5), segment_ids=7).collect()}
    want = defaultdict(list)
    for d, c in rows:
        want[d].append(c)
    assert {bytes(k): v for k, v in got.items()} == {d: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest() for d, c in want.items()}


def test_tails_are_screened(spark):
    """The sketch proves most tails, so that few of the prefixes that occur once are shuffled."""
    rows = [(c, t, "user", f"{c} {t}" if t > 1 else f"shared {c % 5} {t}") for c in range(500) for t in range(8)]
    placed = positions(turn_digests(spark.createDataFrame(rows, SCHEMA)))
    walked = prefixtrie._ranges(placed, "conv_id", "pos").select("conv_id", "digest", "chars").mapInArrow(prefixtrie._walk_prefixes, prefixtrie._STEPS)
    walked = prefixtrie.materialize(walked, "walked")
    carried, n = prefixtrie._carried(walked)
    width = sketch_width(n)
    assert n == 4000 and width >= 2 * n
    seen = prefixtrie.screened(walked, carried, prefixtrie.count_min(walked, carried, width), width)
    assert seen.filter("single").filter("depth <= 2").count() == 0
    assert seen.filter("single").count() > 0.9 * 3000


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP11_SQL})").fetchall()
    assert rows_of(op11_prefix_trie(spark, "/root/testdata/sf0.01")) == sorted(want, key=lambda r: (r[1], r[0]))


def test_rebuilt_rows(spark):
    rows = made(230, 3)
    want = rebuilt_plainly(sequences(rows))
    got = defaultdict(list)
    for r in rebuilt(positions(turn_digests(spark.createDataFrame(rows, SCHEMA)))).collect():
        got[r["conv_id"]].append((r["pos"], bytes(r["digest"]).hex()))
    assert {c: [d for _, d in sorted(v)] for c, v in got.items()} == {c: [digest(*t) for t in seq] for c, seq in want.items() if seq}
