import random

import pytest

from vetch.operators import amounts as A
from vetch.operators import findings as N
from vetch.operators import matching as M
from vetch.operators import quotes as Q

SCHEMA = "{0}_id string, source_id string, status string, anchor struct<kind:string>, terms array<string>, numbers array<string>"


def brute(claims, evidence, k):
    """Every claim against every piece of evidence."""
    out = {}
    for c, source, _, _, terms, numbers in claims:
        found = []
        for e, other, status, anchor, held, amounts in evidence:
            both = len(set(terms or ()) & set(held or ()))
            if both and source != other:
                same = len(set(numbers or ()) & set(amounts or ()))
                score = both * 6000 // (len(terms) + len(held) - both) + (same * 2000 // len(numbers) if numbers else 0) + M.STATUS_WEIGHT.get(status, 50) * 15 + (500 if anchor else 0)
                found.append((-score, e, both, same))
        out |= {(c, r): x for r, x in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("reach,hot", [(96, 1000), (3, 4), (1, 0)])
def test_suggestions(spark, monkeypatch, reach, hot):
    monkeypatch.setattr(M, "HOT", hot)
    rng = random.Random(reach)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]

    def rows(kind, n):
        pick = lambda m, pool: list(dict.fromkeys(rng.choices(pool, k=m)))
        return [(f"{kind}{k:04}", f"s{rng.randrange(6)}", rng.choice(["final", "draft", "old", None]), rng.choice([None, ("p",)]), pick(rng.randrange(1, 40), words), pick(rng.randrange(4), list("123456789"))) for k in range(n)]

    claims, evidence = rows("c", 80) + [("none", "s", None, None, [], [])], rows("e", 150) + [("eNone", "s9", "final", ("p",), [], ["1"])]
    a, b = (spark.createDataFrame(x, SCHEMA.format(n)) for x, n in ((claims, "claim"), (evidence, "evidence")))
    got = {(r["claim_id"], r["rank"]): (-r["confidence"], r["evidence_id"], r["term_overlap"], r["number_overlap"]) for r in M.suggest(a, b, reach=reach).collect()}
    assert got == brute(claims, evidence, M.TOP)


def test_frequent_terms_are_in_no_join(spark):
    """Of 400 texts that share 5 common terms with all evidence, few pairs are met."""
    common = [f"common{k}" for k in range(5)]
    claims = [(f"c{k}", "s", None, None, common + [f"r{k % 50}x{j}" for j in range(20)], []) for k in range(400)]
    evidence = [(f"e{k:03}", "t", "final", ("p",), common + [f"r{k % 50}x{j}" for j in range(20)], []) for k in range(200)]
    a, b = (spark.createDataFrame(x, SCHEMA.format(n)) for x, n in ((claims, "claim"), (evidence, "evidence")))
    met = []
    real = M._met
    try:
        M._met = lambda *x: met.append(real(*x)) or met[-1]
        assert {(r["term_overlap"], r["confidence"]) for r in M.suggest(a, b).collect()} == {(25, 8000)}
    finally:
        M._met = real
    assert all(m.count() <= 400 * 4 for m in met)  # of 80,000 that share a term


@pytest.mark.parametrize("shard", [1 << 20, 30])
def test_quotes(spark, shard):
    passages = [(1, "she sells"), (2, "sells sea"), (3, "sea"), (4, "sea"), (5, ""), (6, None), (7, "\U0001f600 naïve"), (8, "absent"), (9, "e"), (10, "x" * 100)]
    texts = [(1, "a", "she sells sea shells, she sells"), (2, "b", "\U0001f600\U0001f600 naïve sea"), (3, "c", None), (4, "d", ""), (None, "e", "x" * 150)]
    got = Q.quoted(spark.createDataFrame(texts, "doc_id long, lang string, text string"), spark.createDataFrame(passages, "passage_id long, text string"), shard)
    want = {(i, g, p, t.find(q), t.find(q) + len(q)) for i, g, t in texts for p, q in passages if t is not None and q is not None and q in t}
    rows = [tuple(r) for r in got.select("doc_id", "lang", "passage_id", "begin", "end").collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_contradicted_amounts(spark):
    claims = [("c1", "As of March 31, 2006 the firm had $36.1 billion in assets under management."), ("c2", "Fees were 2 percent."), ("c3", "It holds 12 funds worth $1,200."), ("c4", None)]
    evidence = [("e1", "On November 30, 2006 assets under management of the firm were $40.9 billion."), ("e2", "Fees came to 2% then."), ("e3", "Worth $1200.00 or $1,300; 13 funds."), ("e4", "On 2005-12-31 assets under management of the firm were $30 billion."), ("e5", "The firm manages $1 billion in assets.")]
    pairs = [("c1", e, 5) for e in ("e1", "e4", "e5")] + [("c2", "e2", 3), ("c3", "e3", 3), ("c4", "e1", 9), ("c2", "e1", 9)]
    make = lambda rows, s: spark.createDataFrame(rows, s)
    got = A.contradicted(make(claims, "claim_id string, text string"), make(evidence, "evidence_id string, text string"), make(pairs, "claim_id string, evidence_id string, term_overlap long"))
    assert [tuple(r) for r in got.collect()] == [("c1", "e1", "$36100000000", "$40900000000", "outdated")]
    assert "later says $40900000000" in N.number_findings(got).first()["issue"]


def test_pairs_that_meet_once_are_in_no_grouping(spark):
    rows = [("a", ["x"]), ("b", ["x", "y", "y", None]), ("c", ["x", "y", "z"]), ("d", [None, "z", "z"]), ("e", []), ("f", None), ("g", [None])]
    a, b = (spark.createDataFrame(rows, f"{i} string, e array<string>") for i in ("i", "j"))
    got, want = (sorted(M.overlap(a, b, "i", "j", "e", "n", unique=u).collect()) for u in (True, False))
    assert got == want and len(got) == 12
    groups = lambda u: M.overlap(a.where("i in ('a', 'd')"), b, "i", "j", "e", "n", unique=u)
    assert sorted(groups(True).collect()) == sorted(groups(False).collect())


def test_elements_are_told_apart_by_their_place(spark):
    """Terms and numbers are strings in one column, not structs; null ones, repeated ones and the same string as both are kept."""
    rows = [(1, ["x", "7", "x", None], ["7", "8", "8"]), (2, None, ["1"]), (3, [], None), (4, ["y"], [])]
    got = M._elements(spark.createDataFrame(rows, "k long, terms array<string>, numbers array<string>"), "k")
    assert got.columns == ["k", "term", "e"] and got.schema["e"].dataType.simpleString() == "string"
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, True, "x"), (1, True, "7"), (1, True, None), (1, False, "7"), (1, False, "8"), (2, False, "1"), (4, True, "y")]))
