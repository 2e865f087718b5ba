import pytest
from edge import ROWS, documents

from vigil.llm.toxicity import Lexicon, fit, folded_words, op3_lexicon_toxicity, score, without_toxic

SF01 = "/root/testdata/sf0.01"
EXCEPTIONS = ("trash can", "circus clown")


def test_folding_undoes_disguise():
    assert folded_words("You 1d10t! trаsh $cum m0r0n ｓｔｕｐｉｄ PÂTHETIC c​lown") == \
        ["you", "idiot", "trash", "scum", "moron", "stupid", "pathetic", "clown"]
    assert folded_words("in 2024, 7 cats") == ["in", "2024", "7", "cats"]
    assert folded_words(None) == folded_words("") == []


def test_matches_weights_and_exceptions():
    lexicon = Lexicon({" clown ": 3.0, " trash ": 2.0, " reeux": 1.5}, EXCEPTIONS, (-3.0, 2.0, 1.0))
    automaton = lexicon.automaton()
    plain = lambda text: lexicon.measure(automaton, folded_words(text))
    assert plain("a clown")[1] == pytest.approx(3 / 2 ** 0.5)
    assert plain("a c1own") == plain("a clown") and plain("réeuxment")[1] == 1.5
    assert plain("clowns here") == (0.0, 0.0)
    assert plain("the trash can") == (0.0, 0.0) and plain("the trash here")[1] > 0
    assert plain("trash can and trash")[1] == pytest.approx(2 / 2)
    assert 0 <= lexicon.score(automaton, []) < 0.5 < lexicon.score(automaton, ["clown", "trash"]) <= 1


def test_a_sign_may_stand_for_i_or_l_in_any_number():
    lexicon = Lexicon({" lollipolls ": 2.0, " hello ": 1.0, " iii ": 1.0, " lil ": 4.0}, ("iil ok",))
    automaton = lexicon.automaton()
    total = lambda text: lexicon.measure(automaton, folded_words(text))[1]
    assert total("lo11ipo11s") == total("lollipolls") == total("1o!lipol|s") == 2.0
    assert total("hel1o") == total("he1lo") == 1.0 and total("heiio") == 1.0
    assert total("iii") == 1.0 and total("l1l") == 4.0 and total("lll") == 0.0  # an own spelling first, l is never i
    assert total("hello iil ok") > 0 and total("l1l ok") > 0


def test_matches_against_plain_comparison():
    import random
    draw = random.Random(3)
    for _ in range(300):
        weights = {" " + "".join(draw.choices("lia", k=draw.randint(1, 3))) + draw.choice([" ", ""]): draw.uniform(1, 3) for _ in range(4)}
        lexicon = Lexicon(weights)
        words = ["".join(draw.choices("lia", k=draw.randint(1, 4))) for _ in range(6)]
        text, at = " " + " ".join(words) + " ", {}
        for start in range(len(text)):
            for size in {len(k) for k in weights}:
                seen = text[start:start + size]
                fits = [w for k, w in weights.items() if k == seen] or [
                    w for k, w in weights.items() if len(k) == len(seen) and all(c == e or c == "i" and e == "l" for c, e in zip(seen, k))]
                at[start] = max([at.get(start, 0.0), *fits])
        assert lexicon.measure(lexicon.automaton(), words)[1] == pytest.approx(sum(at.values()) / 6 ** 0.5)


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, fit(docs, labels)


def test_held_out_accuracy(spark, learned):
    docs, labels, _ = learned
    rows = op3_lexicon_toxicity(spark, SF01).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    assert right > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    assert not [r for r in held if r["predicted"] and not r["toxic"]]


def test_held_out_labels_teach_nothing(spark, learned):
    from pyspark.sql import functions as F
    docs, labels, lexicon = learned
    from vigil.llm.common import fold_of
    flipped = labels.withColumn("toxic", F.when(fold_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = fit(docs, flipped)
    assert again.weights == lexicon.weights and again.curve == pytest.approx(lexicon.curve)


def test_toxic_documents_go_and_clean_ones_stay(spark, learned):
    lexicon = learned[2]
    rows = [(1, "you pathetic idiot, worthless trash", "en", "a"), (2, "a calm walk by the river", "en", "a"),
            (3, "you p4thetic 1d10t, w0rthless trаsh", "en", "a"), (4, None, None, None)]
    d = documents(spark, rows)
    out = without_toxic(d, lexicon)
    assert out.schema.names == d.schema.names and sorted(r["doc_id"] for r in out.collect()) == [2, 4]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_edge_rows(spark, rows):
    d = documents(spark, rows)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, None), (99, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = score(d, fit(d, labels)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in got)
