"""Alignment, importance resampling and sharding against brute force, and their defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmine.llm import alignment, importance, sharding

TEXTS = [
    None, "", " ", "a", "one two  three", " led", "end ", "a \n  b\tc\n\nd  ", "<|endoftext|> and <s> x </s> <0x41>", "it's we'll they've", "naïve café 😀😀 日本語 text",
    "under▁score", "zero\x00byte", "no break   em", "12345678 1,234.5", "word " * 300, "x" * 3000, "ﬁ ligature ①", "é combining ́", "a \x1cb", "tail\n", "\n lead", "one two  three",
]


def drawn_texts(n: int) -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choice(["the", " ", " ", "  ", "\n", "é", "ing", ".", "7", "漢", "\t", "'s", "Ab", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def brute_alignment(texts):
    a, b = alignment.ByteTokens(alignment.default_tokenizers()[0]), alignment.PieceTokens(alignment.default_tokenizers()[1])
    docs, counts = [], Counter()
    for t in texts:
        ids_a = a.tokenizer.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.model.encode(t) if t else []
        if not t or not b"".join(a.bytes[i] for i in ids_a) == b"".join(b.bytes[i] for i in ids_b) == (" " + t).encode():
            docs.append(([], [], [], []))
            continue
        spans = []
        for side, ids in ((a, ids_a), (b, ids_b)):
            at, found = 0, []
            for i in ids:
                found.append((at, at + len(side.bytes[i]), i))
                at += len(side.bytes[i])
            spans.append(found)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        groups, last = [], 0
        for e in sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]}):
            groups.append("|".join(",".join(str(x[2]) for x in side if last < x[1] <= e) for side in spans))
            last = e
        docs.append((ids_a, ids_b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (len(x), len(y), len(g), len(li), sum(counts[k] == best[k[1]] for k in li), sum(counts[k] for k in li), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for x, y, g, li in docs
    ]


def test_alignment_brute_force(spark):
    texts = TEXTS + drawn_texts(60)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk int, pairs string").repartition(3)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment(texts)


def test_segments_do_not_change_tokens():
    both = alignment.Aligner(*alignment.default_tokenizers(), "overlap")
    assert both.splits
    for t in filter(None, TEXTS + drawn_texts(300)):
        parts = both.segments(t)
        whole = both.a.tokenizer.encode(" " + t, add_special_tokens=False).ids
        assert sum(both.a.encode([" " + p for p in parts]), []) == both.a.encode([" " + t])[0] == whole
        assert sum(both.b.encode(parts), []) == both.b.encode([t])[0]


def test_alignment_groups_and_products(spark):
    docs = spark.createDataFrame([(1, "Internationalisation of naïve 😀 tokens"), (2, None), (3, "")], "doc_id long, text string")
    whole = (" " + docs.first().text).encode()
    rows = sorted(alignment.groups(docs).collect(), key=lambda r: r.nth)
    a, b = alignment.ByteTokens(alignment.default_tokenizers()[0]), alignment.PieceTokens(alignment.default_tokenizers()[1])
    assert rows[0].start == 0 and rows[-1].end == len(whole) and all(x.end == y.start for x, y in zip(rows, rows[1:], strict=False))
    for r in rows:
        assert b"".join(a.bytes[i] for i in r.a_ids) == b"".join(b.bytes[i] for i in r.b_ids) == whole[r.start : r.end]
    got = {(r.a, r.b): r["count"] for r in alignment.link_counts(docs, links="product").collect()}
    assert got == Counter((x, y) for r in rows for x in r.a_ids for y in r.b_ids)


def test_alignment_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "same text here"), (None, "same text here")], "doc_id long, text string")
    one, four = alignment.align(docs.where("doc_id = 1")).first(), alignment.align(docs.union(docs).repartition(4)).collect()
    assert len(four) == 4 and {r.count_sum for r in four} == {4 * one.count_sum} and {r.n_best for r in four} == {one.n_best}
    assert alignment.align(docs.where("false")).count() == 0 and alignment.groups(docs.where("false")).count() == 0


def brute_importance(docs, target, orders=2, buckets=10_000):
    def grams(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = "".join(c if ord(c) > 127 or "0" <= c <= "9" or "a" <= c <= "z" else " " for c in low).split(" ")
        w = [x for x in w if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    mine = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for _, _, g in mine for b in g), Counter(b for x in target for b in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, g in mine:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = math.floor(sum(gain[b] for b in g) / len(g)) if g else 0
        rows.append([i, n, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * 25 // 100])}
    return sorted(repr((r[0], *r[2:], rank.get(id(r)))) for r in rows)


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_importance_brute_force(spark, orders):
    rng = random.Random(orders)
    vocabulary = ["alpha", "Beta", "gämma", "delta9", "É", "x", "the", "of", "漢字", "end"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", " ", "-", "\x00"]) for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    docs = [*enumerate(texts), (500, None), (501, ""), (None, texts[5]), (3, texts[3]), (3, texts[3]), (502, "...,,"), (503, "word " * 20_000)]
    target = ["alpha beta gämma the end", None, "", "of the alpha"]
    frame = spark.createDataFrame([(i, t, "k", 0) for i, t in docs], "doc_id long, text string, key string, range int").repartition(3)
    found = importance.draw(importance.weigh(frame, spark.createDataFrame([(t,) for t in target], "text string"), orders))
    assert sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in found.collect()) == brute_importance(docs, target, orders)


def test_resampled_documents(spark):
    rows = [(i, f"word{i} " * 25, i) for i in range(40)] + [(7, "same " * 30, 1)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, x_ long")
    target = spark.createDataFrame([("word1 word2",)], "text string")
    ranked = importance.draw(importance.weigh(docs, target)).where("rank is not null")
    got = importance.resample(docs, target)
    assert got.columns == docs.columns and ranked.count() == 70 * 25 // 100
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r.doc_id, rows[r.doc_id][1] if r.key == k[r.doc_id] else "same " * 30) for k in [{r.doc_id: r.h for r in docs.where("x_ = doc_id").select("doc_id", F.xxhash64("text").alias("h")).collect()}] for r in ranked.collect())
    empty = docs.where("false")
    assert importance.draw(importance.weigh(empty, target)).count() == 0 and importance.resample(empty, target).count() == 0
    assert importance.draw(importance.weigh(docs, target.where("false"))).count() == 70


def test_manifest(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(0, 400), "s") for i in range(900)] + [(None, None, "s"), (5, "", "s")] + [(7, "copy " * 30, "t")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(5)
    where = str(tmp_path / "map")
    got = sharding.manifest(docs, where).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    loads = Counter()
    for shard in range(40):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
        loads[shard] = sum(r.size for r in got if r.shard == shard)
    assert max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 40
    again = sharding.manifest(docs.repartition(2), str(tmp_path / "other")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    # The stored map is the base of the next edit, and stays if nothing is to gain.
    assert {r.map_version for r in got} == {1} and {r.map_version for r in sharding.manifest(docs, where).collect()} == {1}
    assert sharding.load(spark, where, 0)[1] == sharding.first_map() and sharding.load(spark, where)[0] == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sharding.save(spark, where, 1, sharding.first_map(), {})
    assert sharding.manifest(docs.where("false")).count() == 0


def test_rebalancing_moves_few_and_growth_only_to_the_new_shard():
    rng = random.Random(9)
    sizes = {s: rng.randrange(50, 150) for s in range(8192)}
    first = sharding.rebalanced(sharding.first_map(), sizes)
    load = Counter()
    for s, n in sizes.items():
        load[first[s]] += n
    assert max(load.values()) - min(load.values()) <= 2
    assert sum(a != b for a, b in zip(first, sharding.first_map(), strict=True)) < 8192 // 10
    sizes |= {s: 400 for s in range(20)}
    assert sum(a != b for a, b in zip(sharding.rebalanced(first, sizes), first, strict=True)) < 200
    more = sharding.grown(first, sizes)
    assert all(a == b or b == 40 for a, b in zip(first, more, strict=True))
    held = sum(n for s, n in sizes.items() if more[s] == 40)
    assert abs(held - sum(sizes.values()) / 41) < 500


def test_placed_rows_follow_the_map(spark):
    docs = spark.createDataFrame([(i, f"text {i}", i, "c") for i in range(300)], "doc_id long, text string, slot_ long, `a.b` string")
    rows = sharding.manifest(docs)
    where = {r.virtual_slot: r.shard for r in rows.collect()}
    got = sharding.placed(docs, [where.get(s, 0) for s in range(sharding.SLOTS)])
    assert got.columns == [*docs.columns, "shard"]
    assert {r.doc_id: r.shard for r in got.collect()} == {r.doc_id: r.shard for r in rows.collect()}
