import random
import zlib

import numpy as np
import pytest
from edge import ROWS, documents
from tokenizers import Tokenizer

from vigil.llm.packing import ChunkTokenizer, default_tokenizer, dot_product_pack, pack, packed_documents, pieces


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_tokenizer())


def test_ids_are_the_tokenizers_own(plain):
    chunks = ChunkTokenizer(default_tokenizer())
    random.seed(0)
    parts = [" ", "\n", "  ", "a", "Bc", "'s", "'", "1", "é", "!", "<|endoftext|>", "\t", "\xa0", "中", "\r\n", "I'm", "\x1c", " ", " x"]
    texts = ["".join(random.choices(parts if k % 2 else [p for p in parts if not p.isspace() or p in " \n"], k=random.randint(0, 14)))
             for k in range(3000)]
    for t in texts + [t or "" for _, t, _, _ in ROWS]:
        assert np.frombuffer(chunks.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_heuristic_takes_the_largest_dot_product_that_fits():
    limits = np.array([10, 3, 8])
    demands = np.array([[6, 1, 5], [4, 1, 4], [4, 1, 1], [3, 1, 3], [2, 1, 0], [2, 1, 2]])
    bins = dot_product_pack(demands, limits)
    left, want, now = list(range(6)), {}, 0
    room = limits.copy()
    while left:
        fit = [i for i in left if (demands[i] <= room).all()]
        if not fit:
            now, room = now + 1, limits.copy()
            continue
        best = max(fit, key=lambda i: ((demands[i] / limits) @ (room / limits), tuple(demands[i])))
        want[best] = now
        room = room - demands[best]
        left.remove(best)
    assert bins.tolist() == [want[i] for i in range(6)]


def test_every_limit_holds_and_little_is_padding(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 1025, 3000)
    rows = [(int(n), int(rng.integers(0, n + 1)), 0, i) for i, n in enumerate(lengths)] + [(1, 0, 1, i) for i in range(500)]
    d = spark.createDataFrame(rows, "length long, loss_tokens long, _task int, _n long")
    out = pack(d, 1024, max_segments=5, max_loss=700 + 324, group_items=1000).toPandas()
    assert len(out) == len(rows)
    by = out.groupby("sequence_id")
    assert by["length"].sum().max() <= 1024 and by["length"].count().max() <= 5 and by["loss_tokens"].sum().max() <= 1024
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered["offset"] == ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"]).all()
    assert out["length"].sum() / (1024 * out["sequence_id"].nunique()) > 0.9
    tight = pack(d.filter("loss_tokens <= 300"), 1024, max_segments=8, max_loss=300, group_items=1000).toPandas()
    assert tight.groupby("sequence_id")["loss_tokens"].sum().drop(tight.loc[tight["length"] == 1024, "sequence_id"]).max() <= 300


def test_an_item_above_a_limit_is_an_error(spark):
    d = spark.createDataFrame([(10, 9, 0, 0)], "length long, loss_tokens long, _task int, _n long")
    with pytest.raises(Exception, match="exceeds a limit"):
        pack(d, 1024, max_loss=5).collect()


@pytest.mark.parametrize("rows", [ROWS, []])
def test_edge_rows_round_trip(spark, plain, rows):
    d = documents(spark, rows)
    out = packed_documents(d, default_tokenizer()).collect()
    ids = [(i, plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _, _ in rows]
    want = sorted((str(i), s, len(x[s:s + 1024]), zlib.crc32(np.array(x[s:s + 1024], "<u4").tobytes()), len(x))
                  for i, x in ids for s in range(0, len(x), 1024))
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    full = pieces(d, default_tokenizer(), with_ids=True).collect()
    assert sorted(zlib.crc32(r["ids"]) for r in full) == sorted(w[3] for w in want)


def test_documents_under_a_loss_limit_below_the_capacity(spark):
    """Pieces are cut to the limit, it binds, and full pieces are held to it too."""
    rng = np.random.default_rng(2)
    d = documents(spark, [(i, " ".join(f"w{k}" for k in rng.integers(0, 99, int(rng.integers(0, 900)))), "en", "a") for i in range(150)])
    made = pieces(d, default_tokenizer(), 300)
    loss = {(r["doc_id"], r["start"]): r["loss_tokens"] for r in made.collect()}
    out = packed_documents(d, default_tokenizer(), capacity=1024, max_segments=3, max_loss=300).toPandas()
    assert {(r.doc_id, r.start) for r in out.itertuples()} == set(loss)
    out["loss"] = [loss[r.doc_id, r.start] for r in out.itertuples()]
    by = out.groupby("sequence_id")
    assert by["loss"].sum().max() == 300 and by["length"].count().max() <= 3 and (out["length"] == 300).sum() > 100
    assert out.groupby("doc_id")["length"].sum().tolist() == out.groupby("doc_id")["doc_tokens"].first().tolist()


def test_full_pieces_are_held_to_every_limit(spark):
    d = spark.createDataFrame([(1024, 1024, 0, 0)], "length long, loss_tokens long, _task int, _n long")
    assert pack(d, 1024).count() == 1
    with pytest.raises(Exception, match="exceeds a limit"):
        pack(d, 1024, max_loss=1000).collect()
