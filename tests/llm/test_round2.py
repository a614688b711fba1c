"""Sketch estimates against exact sets, the transaction join, added personal data, clashing column names."""

import numpy as np
import pytest

from quillmine.llm import fingerprints, mixing, pii, simhash, warc


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_short_sketches_are_exact(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 40))) for _ in range(40)] + [None]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(len(texts)):
        own, nxt = shingles(texts[i]), shingles(texts[(i + 1) % len(texts)])
        edited = shingles(got[i].edited)
        assert got[i].near_next == pytest.approx(len(own & nxt) / len(own | nxt))
        assert got[i].near_edited == pytest.approx(len(own & edited) / len(own | edited))
        assert got[i].contained_edited == pytest.approx(len(own & edited) / len(own))
        assert got[i].n_distinct == len(own)


def test_null_and_repeated_ids_are_ordered(spark):
    rows = [(None, "n one"), (None, "n two"), (5, "five"), (5, "five again"), (5, "five again"), (9, "nine")]
    got = fingerprints.neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.text for r in got) == sorted(r.next_text for r in got) == sorted(t for _, t in rows)


def test_transactions_reach_the_result(spark):
    html = ["<p>é</p>" * 40, "<p>é</p>" * 40, "x", None]
    pages = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    rows = warc.digest_rows(warc.captures(pages, payload=False))
    assert "Join" in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r.page_id: r for r in rows.collect()}
    assert [got[i].payload_bytes for i in range(4)] == [len((h or "").encode()) for h in html]
    assert got[1].record_type == "revisit" and got[1].refers_to == 0 and all(r.requests == r.metadata_records == 1 for r in got.values())


def test_added_personal_data(spark):
    texts = ['the token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" of', "pay DE89 3704 0044 0532 0130 00 to the account", "no data, a: word", "ask Dr. Maria Smith"]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, pii_spans string")
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.pii_spans] for r in pii.find(docs, pii.fit(docs)).collect()}
    assert ("secret", "0b96a8c8d79c4a5085c919698889f59b72ab7bb6") in found[0] and found[2] == []
    assert ("iban", "DE89 3704 0044 0532 0130 00") in found[1]


def test_clashing_names(spark):
    schema = "doc_id long, text string, source string, set_ int, Size_ int, row_ int, x_ int, n_ int, of_ int, texts_ int, one_ int, left_ int, taken int"
    docs = spark.createDataFrame([(i, "some words of a text " * (i + 1), "s", *[i] * 10) for i in range(6)], schema)
    for out in (simhash.near_dedup(docs), mixing.apply_mix(docs)):
        assert out.columns == docs.columns
        assert all(r[3] == r[-1] == r.doc_id for r in out.collect())
