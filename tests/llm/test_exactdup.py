import hashlib
import random

import pytest
from edge import ROWS, documents

from vigil.llm.common import content_key
from vigil.llm.exactdup import exact_duplicates, without_exact_duplicates


def norm(text):
    return (text or "").encode().lower()


def check(rows, given):
    groups = {}
    for i, t in given:
        groups.setdefault(norm(t), []).append(i)
    largest = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    by_sha = {hashlib.sha256(k).hexdigest(): k for k in groups}
    assert len(rows) == len(given)
    kept = {}
    for r in rows:
        k = by_sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (largest[k], len(groups[k]))
        if r["kept"]:
            assert r["doc_id"] == largest[k]
            kept[k] = kept.get(k, 0) + 1
    assert kept == dict.fromkeys(groups, 1)


@pytest.mark.parametrize("bits", [64, 3])
def test_against_brute_force_with_many_levels_and_colliding_hashes(spark, bits):
    random.seed(5)
    texts = ["".join(random.choices("abAB", k=random.randint(0, 60))) for _ in range(120)]
    given = [(i, random.choice(texts) if i % 3 else texts[0]) for i in range(400)] + [(9, None), (None, ""), (9, None)]
    d = spark.createDataFrame(given, "doc_id long, text string")
    check(exact_duplicates(d, block_bytes=4, hash_bits=bits).collect(), given)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_edge_rows(spark, rows):
    check(exact_duplicates(documents(spark, rows)).collect(), [r[:2] for r in rows])


def test_kept_rows_keep_every_column(spark):
    d = documents(spark)
    out = without_exact_duplicates(d)
    assert out.schema.names == d.schema.names
    assert sorted(str(r["doc_id"]) + str(r["text"])[:20] for r in out.collect()) == sorted(
        str(i) + str(t)[:20] for i, t in {(2, ROWS[1][1]), (4, ""), (5, ROWS[6][1]), (6, ROWS[7][1]), (7, ROWS[8][1]), (7, ROWS[10][1])})
    assert d.select(content_key(d["text"])).distinct().count() == 8
