"""The model's counts are those of true words and pairs, however many there are."""

import re
from collections import Counter

import numpy as np

from quillmine.llm import toxicity


def test_counts_are_not_folded(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"x{k}" for k in rng.integers(0, 10**9, 2000))) for i in range(400)]  # more words than 2^18
    labels = [(i, int(i % 5 == 0)) for i in range(0, 400, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), held_out=None)
    tokens = {i: re.findall(r"\w+", t) for i, t in rows}
    assert model.totals["words"] == len({w for t in tokens.values() for w in t})
    assert model.totals["shared"] == sum(map(len, tokens.values()))
    keys, values = toxicity._unpacked(model.table.toArrow())
    assert len(set(keys.tolist())) == len(keys)
    found = dict(zip(keys.tolist(), values.tolist(), strict=True))
    pairs = Counter(p for i, c in labels if c for p in zip(["", *tokens[i]], tokens[i]))
    one = Counter(w for i, c in labels if c for w in tokens[i])
    for i in range(0, 400, 10):
        w = toxicity.words(rows[i][1])
        pair = found[int(toxicity._key(toxicity.PAIR, toxicity._lefts(w)[1:2], w[1:2]).view(np.uint64)[0])] if i in dict(labels) else [0] * toxicity.WIDTH
        assert sum(pair[1:8:2]) == pairs[tuple(tokens[i][:2])]
        word = found[int(toxicity._key(toxicity.WORD, w[3:4]).view(np.uint64)[0])]
        assert sum(word[1:8:2]) == one[tokens[i][3]]  # it begins a pair wherever it isn't last
        assert word[-1] == sum(t.count(tokens[i][3]) for t in tokens.values())


def test_rows_that_repeat_are_scored_each(spark):
    rows = [(i, f"word{i % 7} good text number {i}" + (" vile slur" if i % 3 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"))
    one = {r.doc_id: r.toxic_score for r in toxicity.score(docs, model).collect()}
    twice = toxicity.score(docs.coalesce(1).union(docs.coalesce(1)), model).collect()
    assert Counter(r.doc_id for r in twice) == Counter({i: 2 for i in range(60)})
    assert all(abs(r.toxic_score - one[r.doc_id]) < 1e-9 for r in twice)
    same = spark.createDataFrame([(1, "equal rows everywhere")] * 40, "doc_id long, text string").repartition(4)
    assert toxicity.score(same, model).count() == 40
    assert toxicity.score(same.where("false"), model).count() == 0


def test_words_of_many_texts_at_once():
    """words are found and hashed in all texts at once, as a plain search finds them in each."""
    odd = [None, "", " ", "A_b a_B", "x\0y\x7fz", "É é ß İ Жж 中文 ́a \ud800 ²½", *("W" * k + " w" for k in (7, 8, 9, 16, 63, 64, 65, 66, 500))]
    rng = np.random.default_rng(5)
    odd += ["".join(rng.choice(list("abZ09_ .\n\téЖ"), int(n))) for n in rng.integers(0, 60, 300)]
    plain = [re.findall(r"\w+", (t or "").lower()) for t in odd]
    hashes, sizes = toxicity.words_of(odd)
    assert sizes.tolist() == [len(p) for p in plain]
    names = [w for p in plain for w in p]
    assert len(set(hashes.tolist())) == len(set(names)) == len(set(zip(names, hashes.tolist(), strict=True)))
    assert [toxicity.words(t).tolist() for t in odd] == [h.tolist() for h in np.split(hashes, np.cumsum(sizes)[:-1])]


def test_pairs_are_packed_without_columns_of_words(spark):
    """a pair takes the room of its counts, and both kinds are read back alike."""
    docs = spark.createDataFrame([(i, f"some words {i} more {i % 3}") for i in range(50)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int"))
    widths = {len(toxicity._stretch(r["vals"], np.int64)) // len(toxicity._keys_in(r["keys"])) for r in model.table.collect()}
    assert widths == {len(toxicity.SLOTS), toxicity.WIDTH}


def _shuffled(spark) -> set[str]:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_rounds_score_alike_and_leave_no_exchanges(spark):
    """F2: exchanges of steps that are done don't stay on disk; rounds score every row once, repeated ones too."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 40, 30)) + (" vile slur" if i % 3 == 0 else "")) for i in range(300)] + [(7, None), (7, ""), (None, "w1 w2")]
    docs = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string")
    before, conf = _shuffled(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(conf)
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    assert model.weights is not None and not _shuffled(spark) - before
    packed = model.table.toArrow()
    keys, sums = toxicity._unpacked_sums(packed)
    assert (keys == toxicity._unpacked(packed)[0]).all() and (sums.T == toxicity._summed(toxicity._unpacked(packed)[1])).all() and sums.any(1).all()
    rounds = toxicity.score(docs, model, keep=["doc_id"], rounds=3)
    assert not _shuffled(spark) - before and spark.conf.get(conf) == was
    assert rounds.columns == ["doc_id", "toxic_score"]
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.toxic_score) for r in rounds.collect())
    want = sorted((-1 if r.doc_id is None else r.doc_id, r.toxic_score) for r in toxicity.score(docs, model).collect())
    assert [f[0] for f in found] == [w[0] for w in want] and len(found) == 305
    assert max(abs(f[1] - w[1]) for f, w in zip(found, want, strict=True)) < 1e-9
