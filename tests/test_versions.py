import itertools
import random

import pandas as pd
from vetch.operators import versions as V


def test_heaviest_rising_run_by_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randint(1, 7)
        b, w = rng.sample(range(n), n), [rng.randint(1, 3) for _ in range(n)]
        runs = [c for r in range(1, n + 1) for c in itertools.combinations(range(n), r) if all(b[i] < b[j] for i, j in itertools.pairwise(c))]
        most = max(sum(w[i] for i in c) for c in runs)
        got = tuple(V.rising(pd.DataFrame({"a": range(n), "b": b, "n": w}))["a"])
        assert got in runs and sum(w[i] for i in got) == most
        assert got == min(c for c in runs if sum(w[i] for i in c) == most)


def _packet(spark, files):
    rows = [(n, k, h, f"{n}_{k}") for n, hs in files.items() for k, h in enumerate(hs, 1)]
    return spark.createDataFrame([(n, "/".join(hs)) for n, hs in files.items()], "name string, sha256 string"), spark.createDataFrame(rows, "name string, place long, hash string, evidence_id string")


def test_kept_moved_changed_and_new(spark):
    (fo, old), (fn, new) = (_packet(spark, x) for x in ({"x.md": "abcdefgb", "y.md": "klmn", "z.md": "qrs", "gone.md": "t"}, {"x.md": "aCdefbgNM", "v.md": "klmn", "w.md": "qrS", "came.md": "u"}))
    pairs = V.paired(fo, fn, old, new)
    assert {tuple(r) for r in pairs.collect()} == {("x.md", "x.md", "same name"), ("y.md", "v.md", "same content"), ("z.md", "w.md", "shared passages")}
    changes = V.aligned(pairs, old, new)
    got = {(r["old_name"], r["old_place"]): (r["change"], r["new_name"], r["new_place"]) for r in changes.collect() if r["old_place"]}
    assert [got["x.md", k][0] for k in range(1, 9)] == ["kept", "moved", "changed", "kept", "kept", "kept", "kept", "changed"]
    assert got["x.md", 3] == ("changed", "x.md", 2) and got["z.md", 3] == ("changed", "w.md", 3) and got["y.md", 1] == ("kept", "v.md", 1) and got["gone.md", 1] == ("removed", None, None)
    assert {(r["new_name"], r["new_place"]) for r in changes.where("change = 'new'").collect()} == {("x.md", 9), ("came.md", 1)}
    approved = spark.createDataFrame([("x.md_1",), ("x.md_2",), ("x.md_3",), ("gone.md_1",)], "evidence_id string")
    assert {r["evidence_id"]: r["void"] for r in V.approvals(changes, old, approved).collect()} == {"x.md_1": False, "x.md_2": False, "x.md_3": True, "gone.md_1": True}
    assert V.aligned(V.paired(fo.limit(0), fn.limit(0), old.limit(0), new.limit(0)), old.limit(0), new.limit(0)).count() == 0


def test_versions_are_read_once(spark, small):
    """What compares two versions reads their passages from the shared folder, not from the documents over again."""
    from vetch.plans import packet_queries as Q

    for side in Q._two_versions(spark, small)[2:]:
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Window" not in plan and side.count()
