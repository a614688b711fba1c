"""near_dedup() against brute force on five-word shingles."""

import numpy as np

from quillmine.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup_brute(spark):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(20):
        words = [f"v{x}" for x in rng.integers(0, 5000, 60 + 5 * i)]
        texts.append(" ".join(words))
        for part in (0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(w if rng.random() > part else "other" for w in words))
    texts += ["same passage of words again and " * 40 + " ".join(f"{c}{k}" for k in range(30)) for c in "pq"]  # one repeated passage: no copies
    component = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    near = [[j for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)] for x in sets]
    for _ in texts:
        new = [min(component[j] for j in near[i]) for i in range(len(texts))]
        if new == component:
            break
        component = new
    want = {i for i, c in enumerate(component) if c == i}
    assert len(want) < 0.8 * len(texts)
    got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_near_dedup_ids(spark):
    rows = [(7, "a clean text of its own words"), (7, "another text that shares only its number"), (None, "a clean text of its own words"), (None, "known by no number at all"), (None, "known by no number at all"), (9, None), (8, "")]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [rows[0], rows[1], rows[3], rows[6]]))


def test_family_joined_by_pivots(spark, monkeypatch):
    """a family of near copies is joined through its buckets' pivots, by links in proportion to its size, and is kept once."""
    rng = np.random.default_rng(5)
    base = [f"v{x}" for x in rng.integers(0, 5000, 120)]
    texts = [" ".join(base)]
    for i in range(160):
        words = list(base)
        words[int(rng.integers(0, 120))] = f"new{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(40)]
    edges = []
    real = simhash.components
    monkeypatch.setattr(simhash, "components", lambda e, tag: (edges.append(e.count()), real(e, tag))[1])
    got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0, *range(161, 201)}
    assert max(edges) < 4 * len(texts)


def test_large_buckets_make_no_pairs(spark, monkeypatch):
    """copies that no pivot joins meet in blocks, with links in proportion to their number; more than one block gives the same."""
    rng = np.random.default_rng(6)
    base = [f"v{x}" for x in rng.integers(0, 5000, 360)]
    texts = []
    for i in range(150):  # those of 3 edits are alike, those of 4 only to these, those of 7 to none
        words = list(base)
        for at in rng.choice(360, (3, 4, 7)[i % 3], replace=False):
            words[int(at)] = f"new{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(40)]
    sets = [shingles(t) for t in texts]
    component = list(range(len(texts)))
    near = [[j for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)] for x in sets]
    for _ in texts:
        component = [min(component[j] for j in near[i]) for i in range(len(texts))]
    assert 4 * len(texts) < sum(map(len, near))
    monkeypatch.setattr(simhash, "NEAR_BLOCK", 32, raising=False)
    pairs, edges = [], []
    verified, real = simhash._verified, simhash.components
    monkeypatch.setattr(simhash, "_verified", lambda met, *a: (pairs.append(met.count()), verified(met, *a))[1])
    monkeypatch.setattr(simhash, "components", lambda e, tag: (edges.append(e.count()), real(e, tag))[1])
    got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i for i, c in enumerate(component) if c == i}
    assert max(pairs + edges) < 4 * len(texts)


def test_joining_brute():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.choice(60, 48 + i % 8, replace=False).astype(np.uint64)) for i in range(40)] + [np.zeros(0, np.uint64)]
    both = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    assert (simhash.shared_counts(sets) == both).all()
    size = np.diag(both)
    component = np.arange(41) // 2

    def joined(pairs):
        c = component.copy()
        for i, j in pairs:
            c[c == c[j]] = c[i]
        return {(i, j) for i in range(41) for j in range(41) if c[i] == c[j]}

    alike = [(i, j) for i in range(41) for j in range(i) if both[i, j] >= simhash.NEAR_JACCARD * (size[i] + size[j] - both[i, j])]
    found = simhash.joining(sets, component)
    assert set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, alike)))
    assert joined(found) == joined(alike) and len(found) < 21 and alike
