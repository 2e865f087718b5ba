import hashlib
import random
import re
import time

import pytest
from edge import ROWS, documents

from vigil.llm.pii import KINDS, base_entities, candidates, discover, extract, op4_bootstrapped_pii, patterns, personal_data


def plain(t):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and luhn % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_entities_against_the_plain_patterns():
    random.seed(1)
    parts = [*"a@.b1-+ ()_é2345", "4111111111111111", "1.2.3.4", "256", "a@b.co", " ", "@", "."]
    for _ in range(20000):
        t = "".join(random.choices(parts, k=random.randint(0, 25)))
        assert base_entities(t) == plain(t), t


def test_long_runs_stay_linear():
    began = time.time()
    for t in ("1" * 300_000, "a" * 300_000 + "@", "@" * 100_000, "1.1.1." * 50_000, "+1" * 100_000, "a@b." * 50_000, "1 " * 100_000,
              "a at b dot c " * 30_000, "(1) " * 100_000, "x" * 300_000 + " 12345 " + "y" * 300_000):
        for a, b in candidates(t, base_entities(t))[:2000]:
            patterns(t, a, b)
    assert time.time() - began < 20


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


@pytest.mark.parametrize("rows", [ROWS + [(8, "é mail a.b@c.de, ip 10.0.0.1, card 4111 1111 1111 1111, call +1 (509) 555-6973", "en", "c")], []])
def test_edge_rows(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in op4_bootstrapped_pii(spark, str(tmp_path)).collect():
        got.setdefault(str(r["doc_id"]), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, _, _ in rows:
        base = plain(t or "")
        want = hashlib.sha256(joined(base).encode()).hexdigest()
        same = [r for r in got[str(i)] if r["base_sha256"] == want]
        assert same and [same[0][f"n_{k}"] for k in KINDS] == [sum(s[2] == j for s in base) for j in range(4)]
        assert set(joined(base).split(",")) - {""} <= set(same[0]["spans"].split(","))


def test_patterns_of_seeds_discover_unseen_identifiers_and_nothing_else(spark):
    rows = [(i, f"Hello. Please write to user{i}@mail.org for details", "en", "a") for i in range(20)]
    rows += [(50, "Hello. Please write to jane(at)mail(dot)org for details", "en", "a"),
             (51, "later we saw jane(at)mail(dot)org again", "en", "a"), (52, "it cost about 12345 euro at h0me", "en", "a")]
    got = {r["doc_id"]: r for r in personal_data(documents(spark, rows)).collect()}
    found = {i: [(s["kind"], rows_text[s["start"]:s["end"]]) for s in got[i]["spans"]]
             for i, rows_text in ((r[0], r[1]) for r in rows)}
    assert found[50] == [(0, "jane(at)mail(dot)org")] == found[51] and found[52] == [] and len(found[3]) == 1
    assert len(got[50]["base"]) == 0


def test_candidates_run_over_digit_groups_and_spelt_addresses():
    def values(t):
        return [t[a:b] for a, b in candidates(t, base_entities(t))]
    assert values("call (509) 555-6973, now") == ["(509) 555-6973"]
    assert values("card 4111 1111 1111 1112.") == ["4111 1111 1111 1112"]
    assert values("Write to jane at mail dot org today") == ["jane at mail dot org"]
    assert values("a1b2c3, x@y 12-34 5 and 1.2.3.4 20 30") == ["a1b2c3", "12-34 5", "20 30"]
    assert values("meet at noon") == [] == values("")


def test_context_words_are_whole():
    long = "z" * 5000
    t = f"one {long} 12345 {long}q end"
    a = t.index("12345")
    two, around = patterns(t, a, a + 5)
    assert two.startswith("one #") and around.startswith("#") and two.split()[1] == around.split()[0] != around.split()[2]
    assert patterns("my own 12345", 7, 12) == ["my own _"] and patterns("12345", 0, 5) == []


def plain_discovery(occurrences, min_support=3, min_pattern=0.5, min_value=0.7):
    edges = {(v, p) for k, v, ps in occurrences for p in ps}
    loose = {(v, p) for k, v, ps in occurrences if k < 0 for p in ps}
    seeds = {(v, k): 1.0 for k, v, _ in occurrences if k >= 0}
    values = {p: len({v for v, q in edges if q == p}) for _, p in edges}
    found, known = {}, dict(seeds)
    while True:
        trust = {}
        for p in values:
            for kind in range(4):
                scores = [known[v, kind] for v, q in edges if q == p and (v, kind) in known]
                if len(scores) >= min_support and sum(scores) / (values[p] + 1) >= min_pattern:
                    trust[p, kind] = sum(scores) / (values[p] + 1)
        now = {}
        for v in {v for v, _ in loose}:
            best = []
            for kind in range(4):
                miss = 1.0
                for w, p in loose:
                    if w == v:
                        miss *= 1 - min(trust.get((p, kind), 0.0), 0.999)
                best.append((-(1 - miss), kind))
            if -min(best)[0] >= min_value:
                now[v] = (min(best)[1], -min(best)[0])
        if len(now) <= len(found):
            return now
        found = now
        known = dict(seeds) | {(v, k): s for v, (k, s) in found.items() if not any((v, j) in seeds for j in range(4))}


def test_rounds_go_on_until_nothing_new_as_restated(spark):
    sets = [[f"+1 509 555 69{i:02d}" for i in range(40)]]
    sets += [[f"(50{k}) 555-11{i:02d}" for i in range(n)] for k, n in enumerate((20, 9, 4, 1))]  # each known from the one before
    words = ["red", "green", "blue", "grey"]
    rows = [(1000 * k + 100 * side + i, f"so {words[k]} call {v} x{words[k]} now", "en", "a")
            for k in range(4) for side in (0, 1) for i, v in enumerate(sets[k + side])]
    rows += [(900 + i, f"it cost 1 {i}00 000 euro", "en", "a") for i in range(5)]
    extracted = extract(documents(spark, rows))
    occurrences = [(s["kind"], s["value"], s["patterns"]) for r in extracted.collect() for s in r["seen"]]
    want = plain_discovery(occurrences)
    got = {r["value"]: (r["kind"], r["score"]) for r in discover(extracted).collect()}
    assert {v: k for v, (k, _) in got.items()} == {v: k for v, (k, _) in want.items()}
    assert all(abs(got[v][1] - want[v][1]) < 1e-9 for v in want)
    assert set(got) == {v for s in sets[1:] for v in s}


def test_identifiers_written_in_groups_or_words_are_found(spark):
    rows = [(i, f"Hello. Please write to user{i}@mail.org for details", "en", "a") for i in range(20)]
    rows += [(100 + i, f"Now please call +1 509 555 69{i:02d} for help", "en", "a") for i in range(20)]
    rows += [(200 + i, f"we charged your card {c} for it", "en", "a")
             for i, c in enumerate(["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004", "4012 8888 8888 1881"])]
    new = {300: (0, "jane at mail dot org", "Hello. Please write to jane at mail dot org for details"),
           301: (3, "(509) 555-6973", "Now please call (509) 555-6973 for help"),
           302: (2, "4111 1111 1111 1112", "we charged your card 4111 1111 1111 1112 for it")}
    rows += [(i, t, "en", "a") for i, (_, _, t) in new.items()]
    got = {r["doc_id"]: r for r in personal_data(documents(spark, rows)).collect()}
    for i, (kind, value, text) in new.items():
        assert [(s["kind"], text[s["start"]:s["end"]]) for s in got[i]["spans"]] == [(kind, value)]
        assert not got[i]["base"]
