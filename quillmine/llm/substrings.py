"""Substring dedup by recompression.

Names tell what is merged (hashes of content), so that every task gives equal stretches of words the same
symbols. Three Spark rounds look at all documents' symbols together. First, low symbols of at most four
words: each window of 20 words takes the highest symbol in its interior, named together with the words
around it that the window surely holds, as its anchor; windows whose anchor occurs once repeat nothing. Second,
over what the other windows cover, all higher symbols, up to whole stretches: a symbol whose words came
earlier (128-bit hashes) shows that every window inside it repeats. Third, the windows that lie in no such
symbol, which are named singly by a 128-bit hash of their words.

Defined cases: a null text has no words; texts shorter than a window are never cut; windows of very long
texts are all judged; rows are ordered by doc_id (null first), then a hash of the row, and rows of one id and
equal texts are one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import mapped

WINDOW = 20
#: Words at either end of a substring whose symbols depend on what lies beyond: 2 + 1 in the first round, 3 in the second.
MARGIN = 6
#: Words of a symbol at most, so that the interior of a window holds one whole symbol.
LONGEST = 4
#: Rounds of recompression at most; each leaves about three quarters of the symbols, so these name stretches of any text.
MOST_ROUNDS = 64


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the parts in order."""
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _names(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def symbols(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after two rounds: name, first word, length."""
    n = len(names)
    sym, at, size = names, np.arange(n), np.ones(n, np.int64)

    def merge(pick: np.ndarray, tag: int) -> None:
        """Merges each picked symbol with its right neighbour; picks never overlap."""
        nonlocal sym, at, size
        i = np.flatnonzero(pick)
        if len(i):
            new, length = sym.copy(), size.copy()
            new[i] = _mixed(np.full(len(i), tag, np.uint64), sym[i], sym[i + 1])
            length[i] += size[i + 1]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            sym, at, size = new[keep], at[keep], length[keep]

    # A run of exactly two equal words is a symbol; longer runs stay as they are.
    eq = np.zeros(n + 1, bool)
    eq[1:n] = names[1:] == names[:-1]
    pick = np.zeros(n, bool)
    pick[: n - 1] = eq[1:n] & ~eq[: n - 1] & ~eq[2 : n + 1]
    merge(pick, 1)
    for tag, longest in ((2, 2), (3, LONGEST)):
        side = (_mixed(sym, np.full(len(sym), tag, np.uint64)) & np.uint64(1)).astype(bool)
        pick = np.zeros(len(sym), bool)
        pick[:-1] = ~side[:-1] & side[1:] & (size[:-1] + size[1:] <= longest)
        merge(pick, tag)
    return sym, at, size


def anchors(names: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor's first word, and for each word the anchor's name were it one."""
    n = len(names)
    count = n - window + 1
    sym, at, size = symbols(names)
    rank = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    rank[at] = ((LONGEST - size).astype(np.uint64) << np.uint64(62)) | (_mixed(sym) >> np.uint64(2))
    end = np.zeros(n, np.int64)
    end[at] = at + size
    best = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    where = np.full(count, -1, np.int64)
    starts = np.arange(count)
    for o in range(MARGIN, window - MARGIN):
        r = rank[o : o + count]
        better = (r < best) & (end[o : o + count] <= starts + window - MARGIN)
        best[better], where[better] = r[better], starts[better] + o
    # A window holds the six words before each of its anchors and the six from it on.
    around = np.concatenate([np.zeros(MARGIN, np.uint64), names, np.zeros(MARGIN, np.uint64)])
    context = _mixed(*[around[o : o + n] for o in range(2 * MARGIN)])
    return where, _mixed(context, rank)


def high_symbols(names: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of every symbol of at least a window's words, of all rounds of recompression.

    A round merges each run of equal symbols to one, then each pair whose left symbol is of class 0 and
    whose right one is of class 1; classes are a bit of the symbol's name, drawn anew in every round. Equal
    stretches get equal symbols but for their ends, in all documents, as names tell only what is merged.
    stretch numbers the stretch of each word; symbols never span two.
    """
    sym, at, size = names, np.arange(len(names)), np.ones(len(names), np.int64)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def keep(new: np.ndarray) -> None:
        big = new[size[new] >= WINDOW]
        found.append((at[big], size[big]))

    for r in range(MOST_ROUNDS):
        if len(sym) < 2:
            break
        first = np.flatnonzero(np.concatenate([[True], (sym[1:] != sym[:-1]) | (stretch[1:] != stretch[:-1])]))
        if len(first) < len(sym):
            count = np.diff(np.append(first, len(sym)))
            size = np.add.reduceat(size, first)
            at, stretch, sym = at[first], stretch[first], np.where(count > 1, _mixed(sym[first], count.astype(np.uint64)), sym[first])
            keep(np.flatnonzero(count > 1))
        side = (_mixed(sym, np.full(len(sym), r, np.uint64)) & np.uint64(1)).astype(bool)
        beside = stretch[:-1] == stretch[1:]
        if not beside.any():
            break
        pick = np.flatnonzero(~side[:-1] & side[1:] & beside)
        if len(pick):
            sym, size = sym.copy(), size.copy()
            sym[pick] = _mixed(sym[pick], sym[pick + 1], np.full(len(pick), 1 << 32, np.uint64))
            size[pick] += size[pick + 1]
            new, rest = np.zeros(len(sym), bool), np.ones(len(sym), bool)
            new[pick], rest[pick + 1] = True, False
            sym, at, size, stretch, new = sym[rest], at[rest], size[rest], stretch[rest], new[rest]
            keep(np.flatnonzero(new))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


#: A place and a length (below 2^31 each) are kept as one number: the place, shifted so far, and the length.
SHIFT = 31


class Texts:
    """The documents of a batch, end to end: their words, the windows that may repeat, their high symbols.

    Places are counted over the whole batch within a task and from the document's start between rounds.
    """

    def __init__(self, batch: pa.RecordBatch, skip: list | None = None):
        self.batch = batch
        texts = batch.column("text").to_pylist()
        each = [words_of(None if skip and skip[i] else t) for i, t in enumerate(texts)]
        self.words = [w for words in each for w in words]
        self.n = np.array([len(words) for words in each], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)

    def listed(self, column: str) -> np.ndarray:
        """The numbers of a list column, their places counted over the batch."""
        values = self.batch.column(column)
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        count = np.array([0 if x is None else x for x in pc.list_value_length(values).to_pylist()], np.int64)
        return flat + (np.repeat(self.base[:-1], count) << SHIFT)

    def rows(self, at: np.ndarray, n: np.ndarray | None, **columns: np.ndarray) -> pa.RecordBatch:
        """doc_id, tie, columns, at of places over the batch."""
        doc = np.searchsorted(self.base, at, "right") - 1
        row = pa.array(doc)
        local = (at - self.base[doc]) << SHIFT
        place = local if n is None else local | n
        arrays = {"doc_id": self.batch.column("doc_id").take(row), "tie": self.batch.column("tie").take(row), **{k: pa.array(v) for k, v in columns.items()}, "at": pa.array(place)}
        return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    def pairs(self, at: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """128-bit names of stretches of words."""
        joined = memoryview(b" ".join(self.words))
        edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)])
        raw = b"".join([xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(edge[at].tolist(), (edge[at + n] - 1).tolist(), strict=True)])
        pair = np.frombuffer(raw, "<i8").reshape(-1, 2)
        return {"k1": pair[:, 0], "k2": pair[:, 1]}

    def covered(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether each place lies in one of the stretches."""
        marks = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + n, -1)
        return np.cumsum(marks)[: len(self.words)] > 0

    def candidates(self) -> np.ndarray:
        x = self.listed("runs")
        return np.flatnonzero(self.covered(x >> SHIFT, x & ((1 << SHIFT) - 1)))

    def symbols(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """High symbols of the stretches of words that windows in a row cover."""
        where = np.flatnonzero(self.covered(candidates, np.full(len(candidates), WINDOW, np.int64)))
        doc = np.searchsorted(self.base, where, "right")
        breaks = np.concatenate([[0], np.cumsum((np.diff(where) > 1) | (np.diff(doc) > 0))]) if len(where) else where
        at, n = high_symbols(_names([self.words[i] for i in where.tolist()]), breaks)
        return where[at], n

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows that may repeat: those inside a symbol that isn't the first of its words, and the others."""
        c = self.candidates()
        at, n = self.symbols(c)
        again = ~np.isin((at << SHIFT) | n, self.listed("symbols"))
        inside = self.covered(at[again], n[again] - WINDOW + 1)[c]
        return c[inside], c[~inside]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors, each with the windows in a row that chose it. Windows that span two documents are no windows."""
    for batch in batches:
        d = Texts(batch, batch.column("copy").to_pylist())
        count = len(d.words) - WINDOW + 1
        if count < 1:
            continue
        where, name = anchors(_names(d.words))
        starts = np.arange(count)
        doc = np.searchsorted(d.base, starts, "right") - 1
        whole = starts + WINDOW <= d.base[doc + 1]
        starts, where, doc = starts[whole], where[whole], doc[whole]
        if not len(starts):
            continue
        head = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])]))
        yield d.rows(starts[head], np.diff(np.append(head, len(starts))), anchor=name[where[head]].view(np.int64))


def _symbol_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = Texts(batch)
        at, n = d.symbols(d.candidates())
        yield d.rows(at, n, **d.pairs(at, n))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = Texts(batch)
        _, single = d.told()
        yield d.rows(single, None, **d.pairs(single, np.full(len(single), WINDOW)))


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = Texts(batch)
        inside, single = d.told()
        again = np.concatenate([inside, np.setdiff1d(single, d.listed("windows") >> SHIFT)])
        gone = d.covered(again, np.full(len(again), WINDOW, np.int64))
        kept, n_removed = [], []
        for i, copy in enumerate(batch.column("copy").to_pylist()):
            a, b = d.base[i], d.base[i + 1]
            if copy and b - a >= WINDOW:
                gone[a:b] = True
            g = gone[a:b]
            n_removed.append(int(g.sum()))
            words = d.words[a:b]
            kept.append(b" ".join([w for w, x in zip(words, g.tolist(), strict=True) if not x] if n_removed[-1] else words).decode("utf-8", "surrogatepass"))
        columns = [batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(d.n), pa.array(n_removed, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept", "n_words", "n_removed"])


KEY = ["id_", "tie"]


def _firsts(rows: DataFrame, name: str) -> DataFrame:
    """Of rows (doc_id, tie, k1, k2, at) the first of each name (k1, k2), listed by document."""
    first = rows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "tie", "at")).alias("f")).select("f.*")
    return first.groupBy(F.coalesce("doc_id", F.lit(0)).alias("id_"), "tie").agg(F.collect_list("at").alias(name))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the text's words that stay, joined by spaces), n_words, n_removed: one row per document.

    Texts move once, to the partition of their document; each round reads that exchange again and moves only
    names. Round 1 counts anchors, which leaves the windows that may repeat; round 2 names the high symbols
    of what those cover, and finds the first of each; round 3 names singly the windows that lie in no symbol
    whose words came earlier. Of equal texts only the first is searched: every window of the others also
    starts there.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id_"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("tie"), "text")
    ids = base.select("doc_id", *KEY, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    least = ids.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "tie")).alias("f"), F.count("*").alias("n")).where("n > 1")
    copies = ids.join(least, ["t1", "t2"]).where((F.col("tie") != F.col("f.tie")) | ~F.col("doc_id").eqNullSafe(F.col("f.doc_id"))).select(*KEY).distinct()
    texts = base.repartition(*KEY).select("doc_id", *KEY, "text")
    # Copies are passed over in the task: an anti join would be moved below the exchange, which would then be another one.
    flagged = texts.join(copies.withColumn("copy", F.lit(True)), KEY, "left").select("doc_id", *KEY, "text", "copy")
    found = mapped(flagged, _anchor_rows, "doc_id long, tie long, anchor long, at long")
    shared = found.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where("c > 1")
    runs = shared.groupBy(F.coalesce("doc_id", F.lit(0)).alias("id_"), "tie").agg(F.collect_set("at").alias("runs"))
    named = "doc_id long, tie long, k1 long, k2 long, at long"
    symbols = _firsts(mapped(texts.join(runs, KEY).select("doc_id", *KEY, "text", "runs"), _symbol_rows, named), "symbols")
    told = runs.join(symbols, KEY, "left")
    windows = _firsts(mapped(texts.join(told, KEY).select("doc_id", *KEY, "text", "runs", "symbols"), _window_rows, named), "windows")
    known = told.join(windows, KEY, "left").join(copies.withColumn("copy", F.lit(True)), KEY, "full")
    joined = texts.join(known, KEY, "left").select("doc_id", *KEY, "text", F.coalesce("copy", F.lit(False)).alias("copy"), "runs", "symbols", "windows")
    return mapped(joined, _cut_rows, "doc_id long, kept string, n_words long, n_removed long")


#: DuckDB SQL for the query op9_substrings.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM k) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, s + o AS i FROM r, range(20) AS t(o)),
x AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
j AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS m, w, coalesce(gone, []) AS gone FROM d LEFT JOIN x USING (doc_id)),
u AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN g USING (doc_id, i)),
q AS (SELECT u.doc_id, string_agg(w[i], ' ' ORDER BY i) AS t FROM u JOIN d USING (doc_id) GROUP BY u.doc_id)
SELECT j.doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM j LEFT JOIN q USING (doc_id)
"""
