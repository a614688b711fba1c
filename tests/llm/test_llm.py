"""Operators against brute force, round trips and held-out accuracy."""

import re

import numpy as np
import pytest
import xxhash

from quillmine.llm import fingerprints, language, media, packing, pii, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)]


def texts(n=60, seed=1):
    rng = np.random.default_rng(seed)
    out = [" ".join(rng.choice(WORDS, rng.integers(1, 90))) for _ in range(n)]
    out[5] = out[4]
    out[7] = " ".join(out[6].split() + out[4].split())
    out[8] = out[9] = "aa " * 70
    return out + ["", None, " \t", "one"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings_brute(docs):
    seen, want = set(), {}
    for i, t in enumerate(texts()):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            gone |= set(range(s, s + 20)) if k in seen else set()
            seen.add(k)
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs).collect()} == want


def test_simhash_brute(docs):
    def one(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fp = [one(t) for t in texts()]
    comp = list(range(len(fp)))
    for _ in fp:
        for i in range(len(fp)):
            comp[i] = min(comp[j] for j in range(len(fp)) if bin(fp[i] ^ fp[j]).count("1") <= 4)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.groups(docs).collect()}
    assert got == {i: (fp[i], comp[i]) for i in range(len(fp))}


def test_fingerprints(docs):
    all_texts = [t or "" for t in texts()]
    rows = {r.doc_id: r for r in fingerprints.compare_edited(docs).collect()}
    assert len(rows) == len(all_texts)
    for i, t in enumerate(all_texts):
        n, nxt = len(t), all_texts[(i + 1) % len(all_texts)]
        assert rows[i].edited == t[: n - n // 2] + nxt[: n // 2]
        assert rows[i].near_next == pytest.approx(1.0 if t.split() == nxt.split() else rows[i].near_next)
        assert 0 <= rows[i].near_edited <= 1
    assert rows[4].sketch == rows[5].sketch and rows[4].near_next == 1.0


def test_pii_base_spans():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    rng = np.random.default_rng(3)
    for _ in range(3000):
        t = "".join(rng.choice(list("ab@@..11 -+(4)9é"), rng.integers(0, 40)))
        for k in ("email", "ip", "phone"):
            want = [m.span() for m in re.finditer(patterns[k], t)]
            if k == "ip":
                want = [s for s in want if all(int(p) <= 255 for p in t[s[0] : s[1]].split("."))]
            if k == "phone":
                want = [s for s in want if 9 <= sum(map(str.isdigit, t[s[0] : s[1]])) <= 15]
            assert [(a, b) for kind, a, b in pii.base_spans(t) if kind == k] == want, (k, t)
    assert [s for s in pii.base_spans("pay 4111 1111 1111 1111 now")] == [("card", 4, 23)]


def test_packing(docs):
    from tokenizers import Tokenizer

    rows = packing.pack(docs).collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in enumerate(texts()):
        n = len(plain.encode(t or "", add_special_tokens=False).ids) + 1
        assert sum(r.length for r in rows if r.doc_id == i) == n
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_language_held_out(spark):
    kinds = {"x": "alpha beta gamma delta", "y": "uno due tre quattro"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(kinds[k].split(), 40)), k, None, None) for i in range(100) for k in ["xy"[i % 2]]]
    df = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "12 !", "x", None, None)], SCHEMA)
    got = {r.doc_id: r.lang_pred for r in language.classify(df, language.fit(df)).collect()}
    assert all(got[i] == "xy"[i % 2] for i in range(100)) and got[900] == got[901] == "und"


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join([*rng.choice(WORDS, 60), *(["vile"] * (i % 4 == 0))]), None, None, None) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic_score for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert min(got[i] for i in got if i % 4 == 0) > max(got[i] for i in got if i % 4)


def test_media_finds_crops(spark):
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.random(64)]) for i in range(40)] + [(99, None)], "vec_id long, embedding array<double>")
    found = media.copies(media.render(vectors.where("vec_id % 20 = 0"), edited=True), media.render(vectors)).collect()
    assert {(r.query_id, r.id) for r in found} == {(0, 0), (20, 20)}


def turned(image, scale, degrees):
    """The image resized and turned about its middle, by bilinear sampling."""
    n, middle = int(image.shape[0] * scale), (image.shape[0] - 1) / 2
    yy, xx = np.mgrid[:n, :n] - (n - 1) / 2
    z = (xx + 1j * yy) / scale * np.exp(-1j * np.radians(degrees)) + middle * (1 + 1j)
    low = [np.clip(np.floor(c).astype(int), 0, image.shape[0] - 2) for c in (z.imag, z.real)]
    fy, fx = z.imag - low[0], z.real - low[1]
    at = lambda dy, dx: image[low[0] + dy, low[1] + dx]
    out = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return np.where((fx >= 0) & (fx <= 1) & (fy >= 0) & (fy <= 1), out, 0)


def test_media_finds_turned_and_resized(spark):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.random(64)]) for i in range(24)], "vec_id long, embedding array<double>")
    images = media.render(vectors)
    edits = [(1.0, 90), (1.0, 20), (1.25, 0), (0.7, 0), (1.2, 35), (1.4, 200)]
    rows = {r.id: media.decode(r.image) for r in images.where("id < 12").collect()}
    edited = [(1000 + i, media.encode(turned(rows[i], *edits[i % 6]))) for i in range(12)] + [(2000, None), (2001, b"P5\n9"), (2002, media.encode(np.full((64, 64), 7.0)))]
    found = media.copies(spark.createDataFrame(edited, "id long, image binary"), images).collect()
    assert {(r.query_id, r.id) for r in found} == {(1000 + i, i) for i in range(12)}
    for r in found:
        scale, degrees = edits[r.id % 6]
        assert abs(r.scale * scale - 1) < 0.05 and abs((r.turn + degrees + 180) % 360 - 180) < 3


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert substrings.dedup(empty).count() == 0
    assert simhash.groups(empty).count() == 0
    assert fingerprints.compare_edited(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert language.classify(empty, language.fit(empty)).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert pii.find(empty, pii.fit(empty)).count() == 0
