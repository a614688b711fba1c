"""Alignment of two tokenizers over one text.

Both encode the space-led text; the ends of their tokens, in bytes, are joined into elementary intervals
(union1d), searchsorted finds the token of either side that owns an interval, and every interval is one
overlapping pair of tokens. Ends that both sides share close groups; with links="product" every token of a
group is linked with every token of its other side instead.

Work is shared by segments. Where a space follows anything but white space, neither tokenizer joins what
stands on both sides (checked when the tokenizers are loaded; otherwise a text is one segment), so both end a
token there. A chunk of documents aligns each different segment once, and a document is the list of its
segments. Corpus-wide counts of linked ids are asked for once by chunk and pair, so the exchange holds a
chunk's different pairs and never its links.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte by byte, have
no tokens: all figures are 0 and the digest is ''. Texts of any length are taken whole. Rows that repeat, with
equal or null ids, are rows of their own and count as often as they occur. An empty table gives no rows.
Other columns are ignored, whatever their names. Ties for a B id's highest count are all best.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import mapped, materialize
from quillmine.llm.packing import BYTE_LEVEL

#: Bytes of text that are aligned together.
CHUNK_BYTES = 4 << 20
#: Segments whose tokens a Python worker keeps, and their greatest length; others are encoded each time.
MEMO_SEGMENTS, MEMO_LENGTH = 150_000, 40
#: Longer segments are encoded by the tokenizers library, whose time does not grow with a segment's square.
LONG = 2048
#: A pair of ids is one number: a * PAIR + b.
PAIR = 1 << 32
SPACE = "▁"
#: A space after white space, at the beginning or at the end.
IRREGULAR = re.compile(r"(?:^|\s) | $")

_ALIGNERS: dict[tuple, Aligner] = {}


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


class ByteTokens:
    """A byte-level vocabulary of the tokenizers library.

    Where merges come in the order of the ids that they make, an entry's id is its rank, and tiktoken, which
    knows entries by rank, gives the same ids several times faster (a test compares both).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        said = json.loads(self.tokenizer.to_str())
        cut, model = said["pre_tokenizer"] or {}, said["model"]
        special = {t["content"] for t in said["added_tokens"] if t["special"]}
        self.splits = said["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and len(special) == len(said["added_tokens"])
        byte = {code: b for b, code in BYTE_LEVEL.items()}
        n = self.tokenizer.get_vocab_size()
        self.bytes = [bytes(byte.get(ord(c), ord(c)) for c in self.tokenizer.id_to_token(i) or "") for i in range(n)]
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.ranked = self._ranked(special, model["vocab"]) if self.splits and made == sorted(made) else None

    def _ranked(self, special: set[str], vocab: dict[str, int]):
        import public_tokenizers
        import tiktoken

        ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space."""
        if self.ranked is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        short = self.ranked.encode_ordinary
        return [short(t) if len(t) <= LONG else self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class PieceTokens:
    """A vocabulary of the sentencepiece library, which puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts without the space that they are led by."""
        return self.model.encode(texts, num_threads=1)


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared): the tokens of both sides that own each elementary interval, and the ends that both share."""
    cuts = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts), np.intersect1d(ends_a, ends_b, assume_unique=True)


def products(group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of both sides, each with each of its group; group_a and group_b are the tokens' groups, in order."""
    na, nb = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    of = np.repeat(np.arange(groups), na * nb)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
    return (np.cumsum(na) - na)[of] + nth // nb[of], (np.cumsum(nb) - nb)[of] + nth % nb[of]


class Aligned:
    """The alignment of segments that stand one after another: figures and texts of the groups of each, links and ends of groups of all."""

    def __init__(self, figures: np.ndarray, links: np.ndarray, groups: list[str], ends: np.ndarray):
        self.figures, self.links, self.groups, self.ends = figures, links, groups, ends


class Aligner:
    """Aligns segments; figures are n_a, n_b, n_groups and n_links."""

    def __init__(self, a: str, b: str, links: str):
        self.a, self.b, self.links = ByteTokens(a), PieceTokens(b), links
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.names = [str(i) for i in range(max(len(self.size_a), len(self.size_b)))]
        self.splits = self.a.splits and self.b.splits
        #: Ids of both sides as 32-bit bytes, or None where their bytes differ from the segment.
        self.memo: dict[str, tuple[bytes, bytes] | None] = {}

    @classmethod
    def at(cls, *key: str) -> Aligner:
        if key not in _ALIGNERS:
            _ALIGNERS[key] = cls(*key)
        return _ALIGNERS[key]

    def segments(self, text: str) -> list[str]:
        """The space-led text, cut before each space that follows anything but white space; without their first spaces."""
        if not self.splits:
            return [text]
        parts = text.split(" ")
        if not IRREGULAR.search(text):
            return parts
        out, held = [], None
        for p in parts:
            held = p if held is None else f"{held} {p}"
            if p and not p[-1].isspace():
                out.append(held)
                held = None
        if held == "" and out:  # a lone space at the end: B puts none before an empty text
            out[-1] += " "
            held = None
        return out if held is None else [*out, held]

    def tokens(self, segments: list[str]) -> list[tuple[bytes, bytes] | None]:
        memo = self.memo
        new = [s for s in segments if s not in memo]
        made: dict[str, tuple[bytes, bytes] | None] = {}
        if new:
            ids_a, ids_b = self.a.encode([" " + s for s in new]), self.b.encode(new)
            known_a, known_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
            for s, a, b in zip(new, ids_a, ids_b, strict=True):
                same = b"".join(map(known_a, a)) == b"".join(map(known_b, b)) == b" " + s.encode()
                made[s] = (array("i", a).tobytes(), array("i", b).tobytes()) if same else None
            if len(memo) < MEMO_SEGMENTS:
                memo.update((s, x) for s, x in made.items() if len(s) <= MEMO_LENGTH)
        return [made[s] if s in made else memo[s] for s in segments]

    def __call__(self, tokens: list[tuple[bytes, bytes] | None]) -> Aligned:
        """The alignment of segments from their tokens; those without have none."""
        some = [t or (b"", b"") for t in tokens]
        sides = [[t[k] for t in some] for k in (0, 1)]
        n_a, n_b = (np.array([len(x) >> 2 for x in side], np.int64) for side in sides)
        a, b = (np.frombuffer(b"".join(side), np.int32).astype(np.int64) for side in sides)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        own_a, own_b, shared = intervals(ends_a, ends_b)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        if self.links == "product":
            own_a, own_b = products(group_a, group_b, len(shared))
        links = a[own_a] * PAIR + b[own_b]
        # Both sides end a token where a segment ends; links and groups come in the order of their A tokens.
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        last_link = np.searchsorted(own_a, last_a)
        last_group = np.concatenate([[0], group_a + 1])[last_a]
        # Tokens in the order of the groups' text, A before B, with what follows each.
        per_a, per_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        place_a = np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(per_a)[group_b]
        order, after = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ",", "<U1")
        order[place_a], order[place_b] = a, b
        after[place_a[np.cumsum(per_a) - 1]], after[place_b[np.cumsum(per_b) - 1]] = "|", ";"
        names = self.names
        words = [names[i] + t for i, t in zip(order.tolist(), after.tolist(), strict=True)]
        stops = (last_a + last_b).tolist()
        groups = ["".join(words[w:v]) for w, v in zip([0, *stops], stops, strict=False)]
        zero = np.zeros(1, np.int64)
        figures = np.stack([n_a, n_b, np.diff(np.concatenate([zero, last_group])), np.diff(np.concatenate([zero, last_link]))])
        start = np.concatenate([zero, ends_a])[last_a - n_a]
        return Aligned(figures, links, groups, shared - np.repeat(start, figures[2]))


ALIGNED = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, group_ends array<int>, "
    "segments binary, pairs array<long>, times array<long>, links binary, link_counts binary"
)


def _chunk(aligner: Aligner, chunk: int, ids: list, texts: list, whole: bool) -> pa.RecordBatch:
    """The rows of a chunk's documents, and one row of its pairs and of the pairs of each segment."""
    number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    put = number.__getitem__
    cut = [list(map(put, aligner.segments(t))) if t else [] for t in texts]
    tokens = aligner.tokens(list(number))
    bad = {i for i, x in enumerate(tokens) if x is None}
    if bad:
        for d, segments in enumerate(cut):
            if not bad.isdisjoint(segments):
                # Bytes of one segment differ; whether those of the text do is decided on the whole.
                found = put(texts[d])
                if found == len(tokens):
                    tokens += aligner.tokens([texts[d]])
                cut[d] = [] if tokens[found] is None else [found]
    done = aligner(tokens)
    flat = np.fromiter(itertools.chain.from_iterable(cut), np.int32)
    ends = np.cumsum([len(c) for c in cut])
    starts = np.concatenate([[0], ends[:-1]])
    figures = []
    for f in done.figures:
        sums = np.concatenate([[0], np.cumsum(f[flat])])
        figures.append((sums[ends] - sums[starts]).tolist())
    told = ["".join(map(done.groups.__getitem__, c))[:-1] for c in cut]
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in told]
    counts = done.figures[3].astype(np.int32)
    pairs, which = np.unique(done.links, return_inverse=True)
    times = np.bincount(flat, minlength=len(counts))
    total = np.bincount(which, np.repeat(times, counts), len(pairs)).astype(np.int64)
    group_ends: list = [None] * len(cut)
    if whole:
        per_segment = np.split(done.ends, np.cumsum(done.figures[2])[:-1])
        for d, c in enumerate(cut):
            parts = [per_segment[i] for i in c]
            base = itertools.accumulate([0, *(int(p[-1]) for p in parts[:-1])])
            group_ends[d] = np.concatenate([p + s for p, s in zip(parts, base, strict=False)]).tolist() if parts else []
    segments = [np.array(c, np.int32).tobytes() for c in cut]
    n = len(cut)
    columns = [
        pa.array([chunk] * (n + 1), pa.int64()), pa.array([*ids, None], pa.int64()), *[pa.array([*f, None], pa.int64()) for f in figures],
        pa.array([*(told if whole else [None] * n), None], pa.string()), pa.array([*digests, None], pa.string()), pa.array([*group_ends, None], pa.list_(pa.int32())),
        pa.array([*segments, None], pa.binary()), pa.array([None] * n + [pairs], pa.list_(pa.int64())), pa.array([None] * n + [total], pa.list_(pa.int64())),
        pa.array([None] * n + [which.astype(np.int32).tobytes()], pa.binary()), pa.array([None] * n + [counts.tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])


def _chunks(docs: DataFrame, a: str | None, b: str | None, links: str, whole: bool) -> DataFrame:
    if links not in ("overlap", "product"):
        raise ValueError(f"links must be overlap or product, not {links}")
    given = default_tokenizers()
    key = (a or given[0], b or given[1], links)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.at(*key)
        at, nth = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            size += batch.column(1).nbytes
            if size >= CHUNK_BYTES:
                yield _chunk(aligner, at + nth, ids, texts, whole)
                ids, texts, size, nth = [], [], 0, nth + 1
        if ids:
            yield _chunk(aligner, at + nth, ids, texts, whole)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, ALIGNED)


def groups(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, nth, start, end, a_ids, b_ids): the groups of every text, their bytes counted in the space-led text."""
    rows = _chunks(docs, a, b, "overlap", True).where("segments is not null and n_groups > 0")
    each = rows.select("doc_id", "group_ends", F.posexplode(F.split("groups", ";")).alias("nth", "g"))
    ids = [F.split(F.split("g", r"\|")[i], ",").cast("array<int>").alias(f"{side}_ids") for i, side in enumerate("ab")]
    start = F.when(F.col("nth") > 0, F.try_element_at("group_ends", F.when(F.col("nth") > 0, F.col("nth")))).otherwise(0)
    return each.select("doc_id", "nth", start.alias("start"), F.element_at("group_ends", F.col("nth") + 1).alias("end"), *ids)


def _counted(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks' pairs (chunk, nth, pair, times) and the counts (pair, count, best) of all chunks."""
    asked = chunks.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("nth", "p")).select("chunk", "nth", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = materialize(asked.groupBy("pair").agg(F.sum("times").alias("count")), "align-counts")
    of = F.pmod("pair", F.lit(PAIR))
    # One row for each id of B's vocabulary at most.
    best = F.broadcast(counts.groupBy(of.alias("b")).agg(F.max("count").alias("highest")))
    return asked, counts.join(best, of == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def link_counts(docs: DataFrame, a: str | None = None, b: str | None = None, links: str = "overlap") -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold each pair of ids; best: no A id has more with this B id."""
    counts = _counted(materialize(_chunks(docs, a, b, links, False), "align"))[1]
    return counts.select(F.floor(F.col("pair") / PAIR).cast("int").alias("a"), F.pmod("pair", F.lit(PAIR)).cast("int").alias("b"), "count", "best")


FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, a: str | None = None, b: str | None = None, links: str = "overlap") -> DataFrame:
    """One row per document: numbers of tokens, groups and links, links that are best for their B id, and the sum of the links' counts."""
    chunks = materialize(_chunks(docs, a, b, links, False), "align")
    asked, counts = _counted(chunks)
    answers = asked.select(F.col("chunk").alias("of"), "nth", "pair").join(counts, "pair").select("of", "nth", "count", "best")

    def judge(rows: pa.Table, found: pa.Table) -> pa.Table:
        at = [i for i, x in enumerate(rows["links"].is_null().to_pylist()) if not x]
        which = np.frombuffer(rows["links"][at[0]].as_py(), np.int32)
        per = np.frombuffer(rows["link_counts"][at[0]].as_py(), np.int32)
        values = np.zeros((2, found.num_rows), np.int64)
        nth = found["nth"].to_numpy()
        values[0, nth], values[1, nth] = found["best"].to_numpy(zero_copy_only=False), found["count"].to_numpy()
        ends = np.cumsum(per)
        sums = np.hstack([np.zeros((2, 1), np.int64), np.cumsum(values[:, which], axis=1)])
        of_segment = sums[:, ends] - sums[:, ends - per]
        docs = rows.filter(rows["links"].is_null())
        cut = [np.frombuffer(x, np.int32) for x in docs["segments"].to_pylist()]
        figures = [[int(of_segment[k][c].sum()) for c in cut] for k in range(2)]
        out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return out.append_column("n_best", pa.array(figures[0], pa.int64())).append_column("count_sum", pa.array(figures[1], pa.int64())).select([c.split()[0] for c in FIGURES.split(", ")])

    side = chunks.drop("pairs", "times", "groups", "group_ends")
    return side.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(judge, FIGURES)
