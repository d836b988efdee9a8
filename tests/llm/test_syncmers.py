import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from vetch.llm import syncmers as S


def brute(data):
    h = [int(S._mixed(S.np.array([int.from_bytes(data[k : k + S.S], "little")], S.np.uint64))[0]) for k in range(len(data) - S.S + 1)]
    w = S.K - S.S + 1
    return [k for k in range(len(data) - S.K + 1) if min(h[k : k + w]) in (h[k], h[k + w - 1])]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=S.K, max_size=120))
def test_closed_syncmers(data):
    assert S.syncmers(data)[0].tolist() == brute(data)


def test_anchors_don_t_depend_on_context():
    core = b"the quick brown fox jumps over the lazy dog and runs away"
    a, b = (dict(zip(*(x.tolist() for x in S.syncmers(p + core)))) for p in (b"", b"some other words before it "))
    assert a == {k - 27: v for k, v in b.items() if k >= 27}


def test_passages_are_placed_in_long_texts():
    rng = S.np.random.default_rng(3)
    for k in range(20):
        a, b = (rng.integers(32, 127, 120_000, dtype=S.np.uint8).tobytes() for _ in "ab")
        shared, at, to = rng.integers(32, 127, 600, dtype=S.np.uint8).tobytes(), int(rng.integers(119_000)), int(rng.integers(119_000))
        x, y = (S.syncmers(t[:p] + shared + t[p:]) for t, p in ((a, at), (b, to)))
        found = [m for m in S.matched(x, y) if m[2] > 2 * S.K]
        assert found and all(p - q == at - to and at <= p and p + n <= at + 600 for p, q, n in found) and sum(n for *_, n in found) > 450
    assert S.matched(S.syncmers(b""), S.syncmers(a)) == []


def test_fingerprints_grow_with_the_text():
    rng = S.np.random.default_rng(4)
    text = lambda n: rng.integers(32, 127, n, dtype=S.np.uint8).tobytes()
    print_of = lambda t: S.sketch(S.syncmers(t)[1])
    for n in (0, 5, 100, 2_000, 20_000, 400_000):
        own = S.np.unique(S.syncmers(text(n))[1])
        kept = S.sketch(own)
        assert set(kept.tolist()) >= set(own[own < S.BOUND].tolist()) | set(own[: S.SKETCH].tolist()) and len(kept) >= min(len(own), max(S.SKETCH, len(own) / 20))
        assert set(own[own < S.whole_below(kept)].tolist()) == set(kept.tolist())
    for _ in range(20):  # a passage of 600 bytes in texts of 120,000
        shared = text(600)
        assert S.likeness(print_of(text(60_000) + shared + text(60_000)), print_of(shared + text(120_000))) > 0
    for n, m in ((500, 500), (500, 60_000), (3_000, 9_000), (60_000, 300_000)):  # the true share, whatever the lengths
        for keep in (0.1, 0.5, 0.9):
            a = text(n)
            b = a[: int(keep * n)] + text(m - int(keep * n))
            x, y = (set(S.syncmers(t)[1].tolist()) for t in (a, b))
            assert abs(S.likeness(print_of(a), print_of(b)) - len(x & y) / len(x | y)) < 0.2
            assert S.likeness(print_of(a), print_of(b)) == S.likeness(print_of(b), print_of(a))
        assert S.likeness(print_of(a), print_of(a)) == 1.0


def test_query_by_brute_force(spark, small, documents):
    rows = {r["doc_id"]: r for r in S.op4_syncmers(spark, small).collect()}
    assert len(rows) == len(documents)
    for k, (i, text) in enumerate(documents):
        other, half, r = documents[(k + 1) % len(documents)][1], len(text) // 2, rows[i]
        edited = text[: len(text) - half] + other[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (S.sketch(S.syncmers(x.encode())[1]) for x in (text, edited, other))
        assert r["fingerprint"] == a.astype(">u4").tobytes().hex() and r["edited_fingerprint"] == b.astype(">u4").tobytes().hex()
        assert (r["near_edited"], r["near_next"]) == (S.likeness(a, b), S.likeness(a, c))
    half = [r["near_edited"] for r in rows.values() if r["n_chars"] > 500]
    assert sum(half) / len(half) > 0.2 > 0.05 > sum(r["near_next"] for r in rows.values()) / len(rows)


def test_odd_rows(odd, none):
    rows = S.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["fingerprint"] == "" for r in rows if r["n_chars"] == 0)
    assert S.fingerprints(none).count() == 0
    assert S.fingerprints(odd.where("doc_id = 1")).first()["near_next"] == 1.0
