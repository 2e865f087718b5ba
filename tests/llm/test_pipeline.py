import random
import zlib

import numpy as np
from edge import ROWS, documents
from test_simhash import plain_fingerprint

import corpus_pipeline as P

random.seed(12)
WORDS = [f"{a}{b}{c}" for a in "bdgkmnprst" for b in "aeiou" for c in ("l", "n", "rk", "st")]


def prose(n):
    return " ".join(random.choice(WORDS) + random.choice(WORDS) for _ in range(n)) + "."


def write(spark, folder, rows, labels, items):
    documents(spark, rows).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))


def test_each_stage_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from vigil.llm.packing import default_tokenizer
    rows = [(i, prose(80) + (" you pathetic worthless idiot, what trash" if i % 3 == 0 else ""), "en", "a") for i in range(120)]
    item = prose(30)
    rows += [(200, "Exact copy of " + rows[1][1], "en", "a"), (201, "EXACT copy of " + rows[1][1], "en", "a"),
             (202, prose(40) + " " + item + " " + prose(40), "en", "a"), (203, "", "en", "a"), (204, None, "en", "a")]
    rows += [(300 + k, rows[2][1].replace(rows[2][1].split()[40], "other"), "en", "a") for k in range(2)]
    write(spark, tmp_path, rows, [(i, 1, int(i % 3 == 0)) for i in range(120)], [(1, item)])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]

    clean = stage["toxicity"](spark, docs, str(tmp_path))
    assert clean.schema.names == docs.schema.names
    left = {r[0]: r[1] for r in rows if not (r[1] and "pathetic" in r[1])}
    assert {r["doc_id"] for r in clean.collect()} == set(left)

    exact = stage["exact_dedup"](spark, clean, str(tmp_path))
    largest = {}
    for i, t in left.items():
        k = (t or "").lower()
        largest[k] = max(i, largest.get(k, i))
    left = {i: left[i] for i in largest.values()}
    assert exact.schema.names == docs.schema.names and {r["doc_id"] for r in exact.collect()} == set(left)

    near = stage["simhash_near_dedup"](spark, exact, str(tmp_path))
    fp, kept = {i: plain_fingerprint(t) for i, t in left.items()}, []
    for i in sorted(left):  # groups here are no longer than one link
        if not any((fp[i] ^ fp[j]).bit_count() <= 2 for j in kept):
            kept.append(i)
    left = {i: left[i] for i in kept}
    assert near.schema.names == docs.schema.names and {r["doc_id"] for r in near.collect()} == set(left)

    leaks = stage["benchmark_decontamination"](spark, near, str(tmp_path))
    left = {i: t for i, t in left.items() if item not in (t or "")}
    assert leaks.schema.names == docs.schema.names and {r["doc_id"] for r in leaks.collect()} == set(left)

    packed = stage["packing"](spark, leaks, str(tmp_path)).collect()
    plain = Tokenizer.from_file(default_tokenizer())
    want = {(i, s, zlib.crc32(np.array(x[s:s + 1024], "<u4").tobytes())) for i, t in left.items()
            for x in [plain.encode(t or "", add_special_tokens=False).ids + [0]] for s in range(0, len(x), 1024)}
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packed} == want
    whole = P.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in whole} == want


def test_edge_rows_and_no_rows(spark, tmp_path):
    for k, rows in enumerate((ROWS, [])):
        (tmp_path / str(k)).mkdir()
        write(spark, tmp_path / str(k), rows, [(1, 1, 0)], [(1, None)])
        got = P.run(spark, str(tmp_path / str(k))).collect()
        assert len({r["doc_id"] for r in got}) == (4 if rows else 0)
