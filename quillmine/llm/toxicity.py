"""Toxicity by class-conditional Kneser-Ney bigram models.

Each class has discounted bigram counts that back off to its continuation counts, and these to counts that
both classes share, those of the words of all texts. The length-normalised log-likelihoods of both models are
compared over the whole text and over its likeliest stretches of a few lengths; a small logistic calibration
of these ratios is the score. The classes' counts cover all labelled documents outside the held-out fold.

The model is a table of 64-bit keys in buckets, which grows with the input and isn't broadcast. Documents
are gathered to chunks; each asks the buckets for the keys of its words and pairs, and is scored with the
answers. Chunks and questions leave the scan in one exchange, each chunk as one compressed block.

Defined cases: a null or empty text, or one without words, scores as the base rate of label 1; labels of
null are ignored, the greatest of several for a document counts; without any labels, or with one class
only, every score is the share of label 1 (0 without labels); very long texts are scored whole; rows that
repeat are scored each; an empty table gives no rows; other columns pass through, one of the score's name is
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillmine.llm.common import discard, mapped, materialize, power_of_two, tidied, union_all

#: Kneser-Ney discount.
DISCOUNT = 0.75
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
#: The calibration is fitted on about so many labelled rows at most, those of the least hashes.
CALIBRATION_ROWS = 20_000
#: Words of the stretches over which the likeliest is sought.
STRETCHES = (12, 3, 1)
#: Counts that a word's class counts are weighed against.
RARE = 5.0
#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Keys of a bucket on average, buckets at least, and rows that a task gathers before it packs them.
BUCKET_KEYS, LEAST_BUCKETS, PACK_ROWS = 1 << 17, 32, 200_000
#: Bits of a key that a question holds. A bucket answers with the whole keys that fit, of which the asker takes its own.
MARK_BITS = 24
#: Rounds in which all documents are scored where the disk is short.
ROUNDS = 3
#: Labels up to so many are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: A count of every fold and class.
SLOTS = [f"c{i}" for i in range(2 * FOLDS)]
#: Values of a key. Pair: its counts in the first columns. Word: pairs and kinds of pairs that it begins, kinds that it ends, in all slots, and how often it occurs in all texts.
WIDTH = 3 * len(SLOTS) + 1
PAIR, WORD = range(2)
_WORD = re.compile(r"\w+")
#: Bytes of words, lower-cased; 0 stands for any other.
_LOWER = np.frombuffer(bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 0 for b in bytes(range(256)).lower()), np.uint8)
#: The first so many bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Destinations of chunks lie above those of buckets.
CHUNKS_FROM = 1 << 40


def fold(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS).cast("int")


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts, end to end, and how many each text has.

    Words are found and hashed eight bytes at a time in all texts at once; texts beyond ASCII are brought to words and spaces before.
    """
    parts = [(t if t.isascii() else " ".join(_WORD.findall(t.lower()))).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = _LOWER[np.frombuffer(b" ".join([b"", *parts, b" " * 8]), np.uint8)]
    edges = np.flatnonzero(np.diff(data != 0)) + 1
    first, size = edges[::2], np.diff(edges)[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data.tobytes(), strides=(1,))
    hashes = _mix((eight[first] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = 8
    while len(more := np.flatnonzero((size > at) & (size <= LONG_WORD))):
        hashes[more] = _mix(hashes[more] + (eight[first[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]))
        at += 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[first[i] : first[i] + size[i]])
    ends = np.cumsum([len(p) + 1 for p in parts])
    return (hashes >> np.uint64(1)).astype(np.int64), np.diff(np.searchsorted(first, ends), prepend=0)


def words(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words."""
    return words_of([text])[0]


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[_firsts(a)]


def _firsts(a: np.ndarray) -> np.ndarray:
    """Where a sorted array has a value for the first time."""
    return np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]])


def _ranked(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and the place among them of every value."""
    order = np.argsort(a)
    first = _firsts(a[order])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(first) - 1
    return a[order][first], place


def _lefts(w: np.ndarray) -> np.ndarray:
    """The word before each; word 0 stands for the start."""
    return np.concatenate([np.zeros(1, np.int64), w[:-1]])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(kind: int, word: np.ndarray, right: np.ndarray | int = 0) -> np.ndarray:
    x = _mix(np.asarray(word).astype(np.uint64) + np.uint64((kind + 1) * 0x1E3779B97F4A7C15))
    return _mix(x + np.asarray(right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right, slot, n) of the pairs of texts (slot, text)."""
    for batch in batches:
        right, size = words_of(batch.column(1).to_pylist())
        if not len(right):
            continue
        slot, left = np.repeat(batch.column(0).to_numpy().astype(np.int64), size), _lefts(right)
        left[(np.cumsum(size) - size)[size > 0]] = 0
        pair = _key(PAIR, left, right) + slot
        order = np.argsort(pair)
        first = np.flatnonzero(_firsts(pair[order]))
        at, n = order[first], np.diff(first, append=len(order))
        order = np.argsort(right[at])  # like words together, as blocks of a shuffle are compressed
        at, n = at[order], n[order]
        yield pa.RecordBatch.from_arrays([pa.array(left[at]), pa.array(right[at]), pa.array(slot[at].astype(np.int32)), pa.array(n)], names=["left", "right", "slot", "n"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, shared): words and how often they occur."""
    for batch in batches:
        w = np.sort(words_of(batch.column(0).to_pylist())[0])
        first = np.flatnonzero(_firsts(w))
        yield pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(np.diff(first, append=len(w)))], names=["left", "shared"])


def _squeeze(a: np.ndarray) -> bytes:
    """Bytes of an array, like bytes of all numbers together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _stretch(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _keys_out(keys: np.ndarray) -> bytes:
    """Ascending keys (of either sign, as unsigned ones), as steps."""
    return _squeeze(np.diff(keys.view(np.uint64), prepend=np.uint64(0)))


def _keys_in(data: bytes) -> np.ndarray:
    return np.cumsum(_stretch(data, np.uint64), dtype=np.uint64)


def _bucketed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending unsigned keys, the buckets that hold some and where each begins (and the last ends)."""
    of = (keys >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
    found, first = np.unique(of, return_index=True)
    return found, np.append(first, len(keys))


def _marks(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The MARK_BITS bits of keys after those that tell the bucket."""
    return (keys << np.uint64(buckets.bit_length() - 1)) >> np.uint64(64 - MARK_BITS)


def _rest(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of keys after bucket and mark."""
    return keys & np.uint64((1 << (64 - MARK_BITS - (buckets.bit_length() - 1))) - 1)


def _joined(bucket: int, marks: np.ndarray, rest: np.ndarray, buckets: int) -> np.ndarray:
    """Keys from their bucket, mark and other bits."""
    bits = buckets.bit_length() - 1
    top = np.uint64((bucket << (64 - bits)) & ((1 << 64) - 1)) if bits else np.uint64(0)
    return top | (marks << np.uint64(64 - MARK_BITS - bits)) | rest


def _packing(kind: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (left, right if they are pairs, values) to packed rows (to, keys, values) of the buckets; a pair has only its counts."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, values = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], 1)
        order = np.argsort(keys)
        keys, values = keys[order], values[:, order]
        found, first = _bucketed(keys, buckets)
        parts = [(_keys_out(keys[a:b]), _squeeze(values[:, a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["to", "keys", "vals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            keys = _key(PAIR, *columns[:2]) if kind == PAIR else _key(WORD, columns[0])
            held.append((keys.view(np.uint64), np.stack(columns[2 if kind == PAIR else 1 :]).astype(np.int64)))
            n += len(keys)
            if n >= PACK_ROWS:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _unpacked_sums(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of packed rows, ascending, and for each (a column here) the values that _summed() gives over all folds."""
    keys, sums = [np.zeros(0, np.uint64)], [np.zeros((7, 0), np.int32)]
    for k, v in zip(rows["keys"].to_pylist(), rows["vals"].to_pylist(), strict=True):
        keys.append(_keys_in(k))
        v = _stretch(v, np.int64).reshape(-1, len(keys[-1]))
        sums.append(np.zeros((7, v.shape[1]), np.int32))
        for i in range(len(v) // len(SLOTS) * 2):
            first = i // 2 * len(SLOTS)
            sums[-1][i] = v[first + i % 2 : first + len(SLOTS) : 2].sum(0)
        if len(v) == WIDTH:
            sums[-1][6] = v[-1]
    every = np.concatenate(keys)
    order = np.argsort(every)
    return every[order], np.concatenate(sums, 1)[:, order]


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of packed rows, ascending, and their values."""
    parts = [(_keys_in(k), _stretch(v, np.int64)) for k, v in zip(rows["keys"].to_pylist(), rows["vals"].to_pylist(), strict=True)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros((0, WIDTH), np.int64)
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    values, at = np.zeros((len(keys), WIDTH), np.int64), 0
    for k, v in parts:
        v = v.reshape(-1, len(k))
        values[place[at : at + len(k)], : len(v)] = v.T
        at += len(k)
    return keys[order], values


class Asked:
    """The words of a chunk's texts, end to end, and the keys that they ask for, ascending."""

    def __init__(self, texts: list, places: bool = False):
        w, size = words_of(texts)
        self.base = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        starts = self.base[:-1][size > 0]
        left = _lefts(w)
        left[starts] = 0  # a text's first word follows the start
        pairs = _key(PAIR, left, w).view(np.uint64)
        if not places:
            names = _key(WORD, _distinct(np.append(w, 0))).view(np.uint64)
            self.keys = _distinct(np.concatenate([pairs, names])) if len(w) else np.zeros(0, np.uint64)
            return
        own, pair = _ranked(pairs)
        each, word = _ranked(np.append(w, 0))
        names = _key(WORD, each).view(np.uint64)
        self.keys = _distinct(np.concatenate([own, names])) if len(w) else np.zeros(0, np.uint64)
        # Places among the keys of every word's pair, of itself and of the word before it.
        self.pair = np.searchsorted(self.keys, own)[pair]
        spot = np.searchsorted(self.keys, names)[word]
        self.word, self.left = spot[:-1], np.append(spot[-1:], spot[:-2])[: len(w)]
        self.left[starts] = spot[-1]


class Model:
    """The packed count table, its totals and the calibration."""

    def __init__(self, table: DataFrame, buckets: int, totals: dict[str, int], rate: float):
        self.table, self.buckets, self.totals, self.rate = table, buckets, totals, rate
        self.weights: np.ndarray | None = None

    def gather(self, docs: DataFrame, judge: Callable, schema: StructType | str, folds: bool = False) -> DataFrame:
        """judge(rows, Asked, values) of every chunk of docs, values being those of the keys that the texts ask for.

        Values are summed over the folds unless these are asked for.
        """
        buckets, at = self.buckets, docs.columns.index("text")
        width = WIDTH if folds else 7

        def question(held: list[pa.RecordBatch], nth: int) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            keys = Asked(rows.column(at).to_pylist()).keys
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            block = sink.getvalue().to_pybytes()
            # Chunks alike in content but from other places are chunks of their own.
            place = TaskContext.get().partitionId() << 32 | nth
            chunk = CHUNKS_FROM + (xxhash.xxh3_64_intdigest(block, place) >> 2)
            found, first = _bucketed(keys, buckets)
            parts = [_keys_out(_distinct(_marks(keys[a:b], buckets))) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)] if len(keys) else []
            to = [*(found.tolist() if parts else []), chunk]
            return pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int64()), pa.array([chunk] * len(to), pa.int64()), pa.array([*parts, None], pa.binary()), pa.array([None] * len(parts) + [block], pa.binary())], names=["to", "chunk", "keys", "docs"]
            )

        def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, nth = [], 0, 0
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    size += batch.column(at).nbytes
                if size >= CHUNK_BYTES:
                    yield question(held, nth)
                    held, size, nth = [], 0, nth + 1
            if held:
                yield question(held, nth)

        def answer(asks: pa.Table, rows: pa.Table) -> pa.Table:
            """(to, bucket, nth, rest, vals): of the keys of this bucket that fit a chunk's marks, which mark they fit and their bits after it."""
            out = []
            known, values = np.zeros(0, np.uint64), None
            if asks.num_rows and asks["docs"].null_count:
                known, values = _unpacked(rows) if folds else _unpacked_sums(rows)
                values = values.T if folds else values
            marks = _marks(known, buckets)
            for to, chunk, keys in zip(asks["to"].to_pylist(), asks["chunk"].to_pylist(), asks["keys"].to_pylist(), strict=True):
                if keys is None or not len(known):
                    continue
                wanted = _keys_in(keys)
                # What is asked for is sought in the table, as a chunk asks for a small part of it.
                begin = np.searchsorted(marks, wanted)
                i = np.flatnonzero(marks[np.minimum(begin, len(marks) - 1)] == wanted)
                many = np.searchsorted(marks, wanted[i], "right") - begin[i]
                fit = np.repeat(begin[i] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                if len(fit):
                    got = values[:, fit]
                    nth = np.diff(np.repeat(i, many).astype(np.int32), prepend=np.int32(0))
                    out.append({"to": chunk, "bucket": to, "nth": _squeeze(nth), "rest": _squeeze(_rest(known[fit], buckets)), "vals": _squeeze(got.astype(np.int32))})
            return pa.Table.from_pylist(out, pa.schema([("to", pa.int64()), ("bucket", pa.int64()), ("nth", pa.binary()), ("rest", pa.binary()), ("vals", pa.binary())]))

        def judged(asks: pa.Table, answers: pa.Table) -> pa.Table:
            found = [pa.ipc.open_stream(b).read_all() for b in asks["docs"].to_pylist() if b is not None]
            return pa.concat_tables([judged_one(rows, answers) for rows in found]) if found else empty

        def judged_one(rows: pa.Table, answers: pa.Table) -> pa.Table:
            asked = Asked(rows.column(at).to_pylist(), places=True)
            values = np.zeros((len(asked.keys), width), np.int64)
            found_in, first = _bucketed(asked.keys, buckets)
            spans = {b: (x, y) for b, x, y in zip(found_in.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)}
            for bucket, nth, rest, v in zip(*[answers[c].to_pylist() for c in ("bucket", "nth", "rest", "vals")], strict=True):
                begin, end = spans[bucket]
                keys = asked.keys[begin:end]
                marks = _marks(keys, buckets)
                marks = marks[_firsts(marks)][np.cumsum(_stretch(nth, np.int32))]
                known = _joined(bucket, marks, _stretch(rest, np.uint64), buckets)
                i = np.minimum(np.searchsorted(keys, known), len(keys) - 1)
                mine = keys[i] == known
                values[begin + i[mine]] = _stretch(v, np.int32).reshape(width, -1).T[mine]
            return judge(rows, asked, values)

        empty = _empty(schema)
        asks = mapped(docs, questions, "to long, chunk long, keys binary, docs binary").repartition("to")
        answers = asks.groupBy("to").cogroup(self.table.groupBy("to")).applyInArrow(answer, "to long, bucket long, nth binary, rest binary, vals binary")
        return asks.groupBy("to").cogroup(answers.groupBy("to")).applyInArrow(judged, schema)


def _empty(schema: StructType | str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema)).empty_table()


def _summed(values: np.ndarray, without: int | None = None) -> np.ndarray:
    """Of the values of keys: n of class 0 and 1, kinds of both, ends of both, and the shared ends, over all folds but one."""
    use = [[2 * f + c for f in range(FOLDS) if f != without] for c in range(2)]
    w = len(SLOTS)
    return np.stack([*(values[:, [part * w + i for i in u]].sum(1) for part in range(3) for u in use), values[:, -1]], 1)


def features(asked: Asked, sums: np.ndarray, totals: dict[str, int], without: int | None = None) -> list[np.ndarray | None]:
    """Mean log-likelihood ratios of each text, of bigrams and of continuations alone: over the whole text, and over its likeliest stretch of each length.

    sums are those of _summed() for the keys asked for; a text without words has none.
    """
    use = [[2 * f + c for f in range(FOLDS) if f != without] for c in range(2)]
    types = [sum(totals[SLOTS[i]] for i in u) for u in use]
    # Columns one by one, as a chunk has many more words than keys.
    of = lambda column, places: sums[:, column].astype(np.float64)[places]
    base = (of(6, asked.word) + 0.5) / (totals["shared"] + 0.5 * (totals["words"] + 1))
    floor, logs, lows = RARE / max(1.0, float(sum(types))), [], []
    for c in range(2):
        low = base if not types[c] else (np.maximum(of(4 + c, asked.word) - DISCOUNT, 0) + DISCOUNT * totals[f"distinct_{without}_{c}"] * base) / types[c]
        low = low + floor
        seen = of(c, asked.left)
        there = np.maximum(seen, 1)
        high = np.maximum(of(c, asked.pair) - DISCOUNT, 0) / there + np.minimum(DISCOUNT * of(2 + c, asked.left) / there, 1) * low
        logs.append(np.log(np.maximum(np.where(seen > 0, high, low), 1e-30)))
        lows.append(np.log(low))
    run = [np.concatenate([[0.0], np.cumsum(x)]) for x in (logs[1] - logs[0], lows[1] - lows[0])]
    out: list[np.ndarray | None] = []
    for a, b in zip(asked.base[:-1].tolist(), asked.base[1:].tolist(), strict=True):
        n = b - a
        out.append(np.array([x for r in run for x in ((r[b] - r[a]) / n, *((r[a + k : b + 1] - r[a : b + 1 - k]).max() / k for k in [min(m, n) for m in STRETCHES]))]) if n else None)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps; weights in the features' own units."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / dev])
    w = np.zeros(a.shape[1])
    keep = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -5, 5)
    return np.concatenate([[w[0] - (w[1:] * mean / dev).sum()], w[1:] / dev])


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = HELD_OUT) -> Model:
    """Learns from the labelled documents outside the held-out fold, and the shared counts from all texts."""
    with tidied(docs.sparkSession):
        return _fitted(docs, labels, held_out)


def _fitted(docs: DataFrame, labels: DataFrame, held_out: int | None) -> Model:
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("c_"))
    marks = marks.withColumn("f_", fold(F.col("doc_id")))
    if held_out is not None:
        marks = marks.where(F.col("f_") != held_out)
    marks = materialize(marks, "toxic-labels")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    known = docs.select("doc_id", "text").where("doc_id is not null").join(marks, "doc_id")
    n = {r["c_"]: r["n"] for r in known.groupBy("c_").agg(F.count("*").alias("n")).collect()}
    texts = known.select((2 * F.col("f_") + F.col("c_")).cast("int").alias("slot"), "text")
    # Pairs meet where their right word is dealt, so that the kinds of pairs that it ends are counted there too.
    counts = mapped(texts, _count, "left long, right long, slot int, n long").repartition("right").groupBy("left", "right")
    counts = materialize(counts.agg(*[F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(SLOTS)]), "toxic-counts")
    none = F.lit(0).cast("long")
    kinds = [F.count_if(F.col(c) > 0) for c in SLOTS]
    begun = counts.groupBy("left").agg(*[F.sum(c).alias(f"a{i}") for i, c in enumerate(SLOTS)], *[k.alias(f"k{i}") for i, k in enumerate(kinds)])
    ended = counts.groupBy(F.col("right").alias("left")).agg(*[k.alias(f"e{i}") for i, k in enumerate(kinds)])
    shared = mapped(docs.select("text"), _tokens, "left long, shared long").groupBy("left").agg(F.sum("shared").alias("shared"))
    names = [f"{p}{i}" for p in "ake" for i in range(len(SLOTS))] + ["shared"]
    every = begun.join(ended, "left", "full").join(shared, "left", "full")
    every = materialize(every.select("left", *[F.coalesce(c, none).alias(c) for c in names]), "toxic-words")
    left_out = [None, *range(FOLDS)]
    some = {f"distinct_{without}_{c}": sum((F.col(f"e{2 * f + c}") for f in range(FOLDS) if f != without), F.lit(0)) > 0 for without in left_out for c in range(2)}
    totals = every.agg(F.count_if(F.col("shared") > 0).alias("words"), F.coalesce(F.sum("shared"), none).alias("shared"), F.count("*").alias("rows"),
                       *[F.coalesce(F.sum(f"e{i}"), none).alias(c) for i, c in enumerate(SLOTS)], *[F.count_if(x).alias(name) for name, x in some.items()]).first().asDict()
    buckets = power_of_two((counts.count() + totals["rows"]) / BUCKET_KEYS, LEAST_BUCKETS)
    packed = [mapped(rows, _packing(kind, buckets), "to long, keys binary, vals binary") for kind, rows in ((PAIR, counts.select("left", "right", *SLOTS)), (WORD, every.select("left", *names)))]
    model = Model(materialize(packed[0].union(packed[1]), "toxic-model"), buckets, totals, n.get(1, 0) / max(1, sum(n.values())))
    discard(counts)
    discard(every)
    if len(n) < 2:
        return model
    part = min(1.0, CALIBRATION_ROWS / sum(n.values()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))).select("f_", "c_", "text")

    def judge(rows: pa.Table, asked: Asked, values: np.ndarray) -> pa.Table:
        of = rows["f_"].to_pylist()
        seen = {f: features(asked, _summed(values, f), totals, f) for f in set(of)}
        found = [(c, seen[f][i]) for i, (f, c) in enumerate(zip(of, rows["c_"].to_pylist(), strict=True))]
        out = [{"c": c, "x": x.tolist()} for c, x in found if x is not None]
        return pa.Table.from_pylist(out, pa.schema([("c", pa.int32()), ("x", pa.list_(pa.float64()))]))

    seen = model.gather(sample, judge, "c int, x array<double>", folds=True).collect()
    if len({r["c"] for r in seen}) == 2:
        model.weights = _logistic(np.array([r["x"] for r in seen]), np.array([r["c"] for r in seen], float))
    return model


def score(docs: DataFrame, model: Model, out: str = "toxic_score", keep: list[str] | None = None, rounds: int = 1) -> DataFrame:
    """The documents with a column of that name, which replaces one that they have.

    Columns to keep may be named. In several rounds, each of which scores its part of the documents, writes them and
    clears its exchanges before the next begins, the disk holds a part of the texts, questions and answers at a time.
    """
    docs = docs.drop(out)
    keep = docs.columns if keep is None else keep
    if model.weights is None:
        return docs.select(*keep).withColumn(out, F.lit(float(model.rate)))
    weights, rate, totals = model.weights, float(model.rate), model.totals
    schema = StructType([*docs.select(*keep).schema.fields, StructField(out, DoubleType())])

    def judge(rows: pa.Table, asked: Asked, sums: np.ndarray) -> pa.Table:
        found = features(asked, sums, totals)
        scores = [rate if x is None else float(1 / (1 + np.exp(-np.clip(float(weights[0] + x @ weights[1:]), -40, 40)))) for x in found]
        return rows.select(keep).append_column(out, pa.array(scores, pa.float64()))

    if rounds == 1:
        return model.gather(docs, judge, schema)
    turn = F.pmod(F.xxhash64("text"), F.lit(rounds))
    with tidied(docs.sparkSession):
        return union_all([materialize(model.gather(docs.where(turn == i), judge, schema), "toxic-scores") for i in range(rounds)])
