"""SimHash near-duplicates by pivot distance tables.

Distinct fingerprints are the points. Each carries its row of the pivot table: Hamming distances to many
reference fingerprints. Fingerprints within 4 bits agree in at least two of six blocks, so that joins on
pairs of blocks meet every link; a met pair is discarded if any coordinate of the pivot table differs by
more than 4 (the triangle inequality), and survivors are verified bit by bit.

near_dedup() has a setting of its own: sets of five-word shingles that are alike at a Jaccard similarity of
at least 0.8. Such sets differ in about 15 of 100 bits of a SimHash, which no 64 bits can tell with a join, so
that its fingerprints have 1152 bits. They meet in tables keyed by bits chosen at random, as many tables as
meet 0.99 of the pairs at 0.8 (more of closer ones). Each bucket has a pivot, and each row its distance to it:
rows near their pivot are joined to it first, the others meet rows of other components whose distances to the
pivot differ little enough, and what meets within a wide radius of bits is compared shingle by shingle. Large
buckets make no pairs: blocks of their rows meet with their texts, two at a time, and each two give as many links
as join their components.

Defined cases: a null text is empty; a text without words has fingerprint zero and links like any other;
equal texts, repeated rows and shared ids meet in one fingerprint; a null doc_id has a null component
unless a row of its group has an id; an empty table gives no rows; other columns pass through
near_dedup() untouched and are ignored elsewhere. near_dedup() takes texts alike up to white space and the
case of ASCII letters, and all texts without words, as equal; it never links by id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, MapType, StructField, StructType

from quillmine.llm.common import components, mapped, materialize, unused

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Reference fingerprints: hashes of their numbers.
PIVOTS = tuple(xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(16))
#: Shingles whose bits are summed at once.
CHUNK = 1 << 16

#: Setting of near_dedup(): words of a shingle, least Jaccard similarity, and the part of pairs just that similar that tables meet.
NEAR_SHINGLE, NEAR_JACCARD, NEAR_RECALL = 5, 0.8, 0.99
#: 64-bit words of its fingerprint; tables draw on all but the first NEAR_SIFT, by which rows are measured against pivots and each other.
NEAR_WORDS, NEAR_SIFT = 18, 2
#: Bits that may differ in the first words and in all: 19 and 174 are expected at 0.8, 24 and 216 for sets of 4 and 5, and 64 and 576 by chance.
NEAR_NEAR, NEAR_ALL = 44, 288
#: Tables in which rows are compared with pivots alone.
NEAR_STARS = 16
#: Rows of a bucket that meet as pairs; larger buckets are compared by blocks of so many rows and shingles on average.
NEAR_PAIRS, NEAR_BLOCK, NEAR_BLOCK_SHINGLES = 8, 256, 1 << 20
#: Shingles of a block that are counted at once.
NEAR_COLUMNS = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(a, min(n, a + CHUNK))), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _block(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def links(points: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), fp_a < fp_b, of the ids of distinct fingerprints (fp, id) at most distance bits apart.

    A pair is emitted at the first pair of blocks on which it agrees, so that it appears once.
    """
    if distance > DISTANCE:
        raise ValueError("six blocks meet all links of at most 4 bits")
    keyed = list(combinations(range(len(BLOCKS)), 2))
    fp = F.col("fp")
    keys = [F.struct(F.lit(n).alias("n"), _block(fp, *BLOCKS[i]).alias("u"), _block(fp, *BLOCKS[j]).alias("v")) for n, (i, j) in enumerate(keyed)]
    table = F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("byte") for p in PIVOTS])
    rows = points.select("fp", "id", table.alias("t"), F.explode(F.array(*keys)).alias("k")).select("fp", "id", "t", "k.*")
    a, b = rows.alias("a"), rows.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = F.lit(True)
    for i in range(len(PIVOTS)):
        near = near & (F.abs(F.col("a.t")[i] - F.col("b.t")[i]) <= distance)
    zero = F.array(*[_block(x, *block) == 0 for block in BLOCKS])
    equal = [i for i in range(len(BLOCKS))]
    first = F.lit(None).cast("int")
    for n in reversed(range(len(keyed))):
        i, j = keyed[n]
        first = F.when(zero[equal[i]] & zero[equal[j]], F.lit(n)).otherwise(first)
    met = a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.u") == F.col("b.u")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp")) & near & (F.bit_count(x) <= distance))
    return met.where(F.col("a.n") == first).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the least id reachable over links of fingerprints (null where no row reachable has one)."""
    rows = materialize(fingerprints(docs), "simhash")
    points = rows.groupBy("fp").agg(F.min("doc_id").alias("id"))
    found = components(materialize(links(points.select("fp", F.col("fp").alias("id"))), "simhash-links"), "simhash-components")
    named = points.join(found, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return rows.join(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - NEAR_SHINGLE + 1)
    h = np.full(n, min(len(words), NEAR_SHINGLE), np.uint64)
    for i in range(min(len(words), NEAR_SHINGLE)):
        h = _mix(h ^ w[i : i + n])
    return np.unique(h)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles, as NEAR_WORDS words."""
    ones = np.zeros(64 * NEAR_WORDS, np.int64)
    salts = _mix(np.arange(NEAR_WORDS, dtype=np.uint64))
    for a in range(0, len(shingles), 255):  # sums of 255 bits fit a byte
        h = _mix(shingles[a : a + 255, None] ^ salts)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")


def near_tables(points: int) -> np.ndarray:
    """The bits of each table's key: keys long enough that few points meet by chance, tables enough for NEAR_RECALL."""
    width = min(56, max(8, math.ceil(math.log2(max(2, points))) - 1))
    differ = math.acos(2 * NEAR_JACCARD / (1 + NEAR_JACCARD)) / math.pi
    count = math.ceil(math.log(1 - NEAR_RECALL) / math.log1p(-((1 - differ) ** width)))
    rng = np.random.Generator(np.random.PCG64(SEED))
    return np.stack([64 * NEAR_SIFT + rng.choice(64 * (NEAR_WORDS - NEAR_SIFT), width, replace=False) for _ in range(count)])


def _signed_rows(docs: DataFrame, set_: str, size_: str, fp_: str) -> DataFrame:
    """The documents with the digest of the set of shingles, its size, and its fingerprint."""
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(set_, BinaryType()), StructField(size_, IntegerType()), StructField(fp_, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(at)]
            new = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([wide_fingerprint(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, set_, size_, fp_])

    return mapped(docs, run, schema)


def _near_keys(points: DataFrame, tables: np.ndarray) -> DataFrame:
    """A row of every point (id, size, fp, component) in every table: n, key, id, size, component, rank, and the words by which met pairs are sifted."""
    powers = 1 << np.arange(tables.shape[1], dtype=np.int64)
    words = [f"w{i}" for i in range(NEAR_SIFT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, NEAR_WORDS)
            bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
            rank = pa.array(_mix(batch.column(0).to_numpy().astype(np.uint64)).view(np.int64))
            sift = [pa.array(np.ascontiguousarray(fps[:, i]).view("<i8")) for i in range(NEAR_SIFT)]
            for i, which in enumerate(tables):
                key = bits[:, which].astype(np.int64) @ powers
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key), batch.column(0), batch.column(1), batch.column(3), rank, *sift], names=["n", "key", "id", "size", "component", "rank", *words])

    return mapped(points.select("id", "size", "fp", "component"), run, "n int, key long, id long, size int, component long, rank long, " + ", ".join(f"{w} long" for w in words))


def _pivoted(keys: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component, with their bucket's pivot, the row of the least rank: p.id, p.size, p.component, t, the row's distance to it, and the bucket's rows m and shingles s."""
    bucket = Window.partitionBy("n", "key")
    ranked = bucket.orderBy("rank", "id")
    words = [f"w{i}" for i in range(NEAR_SIFT)]
    pivot = F.first(F.struct("id", "size", "component", *words)).over(ranked).alias("p")
    mixed = (F.min("component").over(bucket) < F.max("component").over(bucket)).alias("mixed")
    rows = keys.select("*", pivot, mixed, F.count("*").over(bucket).alias("m"), F.sum("size").over(bucket).alias("s")).where("mixed").drop("mixed")
    return rows.withColumn("t", _apart([F.col(w) for w in words], [F.col(f"p.{w}") for w in words])).withColumn("p", F.struct("p.id", "p.size", "p.component"))


def _apart(a: list[Column], b: list[Column]) -> Column:
    return reduce(Column.__add__, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])


def _alike(a: Column, b: Column) -> Column:
    return (a >= NEAR_JACCARD * b) & (b >= NEAR_JACCARD * a)


def _close(met: DataFrame, points: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of ids of points, those within NEAR_ALL bits."""
    ends = [points.select(F.col("id").alias(c), F.col("fp").alias(f"fp_{c}")) for c in ("a", "b")]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(-1, NEAR_WORDS) for i in (2, 3))
            keep = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= NEAR_ALL
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return materialize(mapped(met.join(ends[0], "a").join(ends[1], "b").select("a", "b", "fp_a", "fp_b"), close, "a long, b long"), "near-met")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def _verified(met: DataFrame, read: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of ids, those whose texts (id, text) are at least NEAR_JACCARD alike."""
    pairs = met.join(read.toDF("a", "text_a"), "a").join(read.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                x, y = shingle_set(s.as_py()), shingle_set(t.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= NEAR_JACCARD * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(mapped(pairs, verify, "a long, b long"), "near-links")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    owner, each = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    _, which, times = np.unique(each, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[which] > 1
    owner, column = owner[shared], number[which][shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    found = np.diag([len(x) for x in sets]).astype(np.int64)
    for a in range(0, int((times > 1).sum()), NEAR_COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + NEAR_COLUMNS])
        held = np.zeros((len(sets), NEAR_COLUMNS), np.float32)  # counts up to NEAR_COLUMNS are exact
        held[owner[lo:hi], column[lo:hi] - a] = 1
        part = (held @ held.T).astype(np.int64)
        np.fill_diagonal(part, 0)
        found += part
    return found


def joining(sets: list[np.ndarray], component: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of alike sets of different components: as many as join all components that such pairs join, at the largest component first."""
    size, both = np.array([len(x) for x in sets]), shared_counts(sets)
    alike = both >= NEAR_JACCARD * (size[:, None] + size - both)
    names, of, rows = np.unique(component, return_inverse=True, return_counts=True)
    members = [np.flatnonzero(of == c) for c in range(len(names))]
    seen, out = np.zeros(len(names), bool), []
    for root in np.lexsort((names, -rows)).tolist():
        if seen[root]:
            continue
        seen[root] = True
        queue = [root]
        for c in queue:  # grows meanwhile
            for i in members[c].tolist():
                for j in np.flatnonzero(alike[i] & ~seen[of]).tolist():
                    if not seen[of[j]]:
                        seen[of[j]] = True
                        out.append((i, j))
                        queue.append(of[j])
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """(n, key, i, j, id, component) of rows of large buckets: each block of a bucket beside each other one."""
    count = F.greatest(F.ceil(F.col("m") / NEAR_BLOCK), F.ceil(F.col("s") / NEAR_BLOCK_SHINGLES), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("count")).cast("int")
    dealt = rows.select("n", "key", "id", "component", count.alias("count")).withColumn("own", own)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))))
    return dealt.select("n", "key", "id", "component", pair.alias("to")).select("n", "key", "to.i", "to.j", "id", "component")


def _block_links(blocks: DataFrame, read: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of the blocks' rows, one of each two components."""

    def link(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, component = rows["id"].to_numpy(), rows["component"].to_numpy()
        found = joining([shingle_set(t.as_py()) for t in rows["text"]], component) if (component != component[:1]).any() else []
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": ids[i], "b": ids[j], "ca": component[i], "cb": component[j]})

    texts = blocks.join(read, "id")
    found = texts.groupBy("n", "key", "i", "j").applyInArrow(link, "a long, b long, ca long, cb long")
    ends = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(ends).alias("l")).select("l.a", "l.b")


def _named(points: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """The points with their component over the links."""
    found = components(links, tag)
    return points.drop("component").join(found, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).drop("node")


def near_links(points: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) of ids of points (id, size, fp) whose texts (texts gives (id, text) of ids) are at least NEAR_JACCARD alike: as many as join every component of the pairs that the tables meet.

    First the rows of buckets of a few tables are compared with their bucket's pivot alone, each with the first and
    the last by rank of the pivots near it. Then, in all tables, the rows that aren't of their pivot's component meet
    the rows of other components: a family of copies that its pivots already joined makes no pairs, however large.
    A row is left out where its distance to the pivot and the other's differ by more than NEAR_NEAR (the triangle
    inequality), so that the pivot table discards before bits and texts are compared. Rows of buckets of more than
    NEAR_PAIRS meet in blocks instead, where all are compared by shingles and only links that join components leave.
    """
    tables = near_tables(points.count())
    alone = points.withColumn("component", F.col("id"))
    near = _pivoted(_near_keys(alone, tables[:NEAR_STARS])).where((F.col("id") != F.col("p.id")) & (F.col("t") <= NEAR_NEAR) & _alike(F.col("size"), F.col("p.size")))
    ranked = near.select("id", F.struct(F.xxhash64("p.id").alias("rank"), F.col("p.id").alias("id")).alias("to"))
    ends = ranked.groupBy("id").agg(F.min("to.id").alias("x"), F.max("to.id").alias("y"))
    stars = ends.select(F.explode(F.array("x", "y")).alias("to"), "id").select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()
    stars = _close(stars, points)
    joined = _verified(stars, materialize(texts(_ends(stars).distinct()), "near-texts"))
    rows = _pivoted(_near_keys(_named(alone, joined, "near-stars"), tables))
    # t needs all columns of the rows, and keys are tested as the join tests them, so that blocks and pairs come from one exchange.
    blocks = _blocks(rows.where((F.col("m") > NEAR_PAIRS) & (F.col("t") >= 0) & F.col("n").isNotNull() & F.col("key").isNotNull()))
    rows = rows.where(F.col("m") <= NEAR_PAIRS)
    a, b = rows.where(F.col("component") != F.col("p.component")).alias("a"), rows.alias("b")
    words = [[F.col(f"{side}.w{i}") for i in range(NEAR_SIFT)] for side in "ab"]
    # Both ends of a pair outside the pivot's component: once, by id.
    once = (F.col("b.component") == F.col("b.p.component")) | (F.col("a.id") < F.col("b.id"))
    sifted = (F.abs(F.col("a.t") - F.col("b.t")) <= NEAR_NEAR) & _alike(F.col("a.size"), F.col("b.size")) & (_apart(*words) <= NEAR_NEAR)
    met = a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & once & sifted)
    met = met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    both = materialize(met.unionByName(blocks, allowMissingColumns=True), "near-pairs")
    blocks = both.where("a is null").drop("a", "b")
    rest = _close(both.where("a is not null").select("a", "b").distinct(), points)
    read = materialize(texts(_ends(rest).union(blocks.select("id")).distinct()), "near-texts")
    return joined.union(_verified(rest, read)).union(materialize(_block_links(blocks, read), "near-block-links"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """Of every group of near duplicates the row of the least id (a null one last, then by the row's hash), once."""
    set_, size_, fp_, row_ = (unused(docs, n) for n in ("set_", "size_", "fp_", "row_"))
    rows = materialize(_signed_rows(docs, set_, size_, fp_), "near-rows")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    rows = rows.withColumn(row_, F.xxhash64(*hashed))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(row_).alias("row"))
    points = rows.groupBy(F.col(set_).alias("set")).agg(F.first(size_).alias("size"), F.first(fp_).alias("fp"), F.min(order).alias("least"))
    # Points are numbered once they are written: a number is the place in the files.
    points = materialize(materialize(points, "near-sets").withColumn("id", F.monotonically_increasing_id()), "near-points")
    # Any text of a set has its shingles; that of the least row is taken.
    heads = points.select("id", F.col("set").alias(set_), F.col("least.row").alias(row_))

    def texts(ids: DataFrame) -> DataFrame:
        wanted = materialize(heads.join(ids, "id", "left_semi"), "near-heads")  # as files, so that its size is known and few are broadcast
        return rows.join(wanted, [set_, row_]).dropDuplicates(["id"]).select("id", "text")

    named = _named(points.select("id", "set", "least"), near_links(points.select("id", "size", "fp"), texts), "near-components")
    keep = named.groupBy("component").agg(F.min(F.struct("least", "set")).alias("k")).select(F.col("k.set").alias(set_), F.col("k.least.row").alias(row_))
    return rows.join(keep, [set_, row_], "left_semi").dropDuplicates([set_, row_]).select(*[f"`{c}`" for c in docs.columns])
