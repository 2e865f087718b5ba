import random

import public_tokenizers
import pytest
from edge import ROWS, documents

from vigil.llm import tokencount
from vigil.llm.tokencount import TokenCounter, file_of, op12_whole_token_counts, proven_whole, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH, proven_whole(PATH))


def test_proven_strings_are_one_token_inside_texts(library):
    whole = proven_whole(PATH)
    assert 40_000 < len(whole) < 50_257
    assert "<|endoftext|>" not in whole and " the" in whole
    file = file_of(PATH)
    random.seed(5)
    for s in random.sample(whole, 3000):
        for text in (f"a{s} b", f"x {s}{s}9", s + "\n"):
            cut = file.pattern.findall(text)
            assert sum(1 if p == s else file.merged(p) for p in cut) == library(text)


SIGNS = ["don't", "  ", "\t", "\n\n", "  ", "　", "é", "мир", "世界", "\U0001f600", "<|endoftext|>", "<|endoftext", "123", "x" * 200,
         "\x1c", "\x85", "՘", "\U00033479", "‍", "١٢", "'ll", "_", "Hello", "﻿", "\x00", "퟿", "￿"]


def test_against_the_library(library, counter):
    random.seed(6)
    texts = ["".join(random.choices(SIGNS, k=random.randint(0, 30))) for _ in range(3000)] + [" ".join(SIGNS), "<|endoftext|>" * 3, "a" * 300_000]
    assert [counter.count(t) for t in texts] == [library(t) for t in texts]


def test_a_long_text_is_walked_and_a_full_memory_emptied(library, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 50)
    monkeypatch.setattr(tokencount, "WALKED_CHARS", 1000)
    random.seed(7)
    text = " ".join("".join(random.choices("abcdefgh", k=random.randint(1, 9))) for _ in range(5000))
    small = TokenCounter(PATH, proven_whole(PATH)[:1000])
    assert small.count(text) == library(text)
    assert len(small.counts) <= 1050


@pytest.mark.parametrize("rows", [None, []])
def test_edge_rows(spark, library, rows):
    got = token_counts(documents(spark, rows).withColumnRenamed("n_chars", "n_bytes"), PATH, limit=20).collect()
    want = [(d, len((t or "").encode()), library(t or ""), library(t or "") > 20) for d, t, *_ in (ROWS if rows is None else rows)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_all_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in op12_whole_token_counts(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for d in docs:
        n = library(d["text"] or "")
        assert got[d["doc_id"]] == (d["doc_id"], len((d["text"] or "").encode()), n, n > 1024)


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        file_of(public_tokenizers.path("word_bpe_49k.json"))
