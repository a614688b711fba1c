"""Packing token sequences: best-fit decreasing.

Documents are tokenised in Arrow batches, a separator id ends each, and overlong ones are first cut into
full windows. The remaining pieces are dealt to groups by hash; in a group they are placed longest first,
and a segment tree indexed by remaining capacity finds the tightest open window. A group is one task's
bounded share, so the number of groups, not their size, grows with the corpus. Windows left loose at the end of a group are packed once more across groups.

Defined cases: a null or empty text is the separator alone; texts of any length are cut, never shortened;
repeated rows and equal ids are packed as rows of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import mapped, materialize, power_of_two

WINDOW = 4096
SEPARATOR = 2
#: Pieces of a group on average; a group is packed by one task.
GROUP_PIECES = 16_384
LEAST_GROUPS = 16
#: Windows with more free than this part are packed once more, together with those of so many groups.
SLACK, GROUPS_AGAIN = 1 / 32, 1024
#: Words whose ids a Python worker keeps; others are tokenised each time.
MEMO_WORDS = 150_000
#: Printable ASCII and Latin letters, which have one lower-case form each and stand composed already.
PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u024f]+")
LETTERS = re.compile("[A-Za-z]+")
#: Letters and what may follow them as one part: printable ASCII but digits, apostrophes and what begins an added token.
TAILED = re.compile(r"([A-Za-z]+)([!-&(-/:;=-@\[-`{-~]*)")
#: Byte-level vocabularies write a byte as itself if Latin-1 prints it, and the others, in order, from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = dict(zip((b for b in range(256) if b not in _PRINTED), range(256, 512), strict=False))

_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class _Memo(dict):
    """What `of` gives of a word; that of the first MEMO_WORDS words is kept."""

    def __init__(self, of: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.of = of

    def __missing__(self, word: str) -> bytes:
        ids = self.of(word)
        if len(self) < MEMO_WORDS and len(word) <= 40:
            self[word] = ids
        return ids


class Encoder:
    """Ids of a text as little-endian 32-bit bytes.

    The tokenizer never joins characters across ASCII spaces or line breaks, so a text's ids are those of
    its words in turn; the ids of words met before are looked up. A plain word (Latin letters, ASCII) is split into the
    tokenizer's own parts, which its model names singly; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo, self.parts = _Memo(self._ids), _Memo(self._part)
        self.split = self._plain_split()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added)) or "(?!)")
        # A word of letters is one part if nothing but what begins with an apostrophe is tried before runs of letters.
        before, runs, after = self.split.pattern.partition(r"[\p{L}]+|") if self.split else ("", "", "")
        self.whole = bool(runs) and all(x.startswith("'") for x in before.split("|")[:-1]) and not any(map(LETTERS.fullmatch, added))
        # So are marks after them, if nothing else is tried before runs of marks and added tokens begin with what isn't among these.
        self.tailed = self.whole and after == r"[\p{N}]|[^\s\p{L}\p{N}]+" and all(t.startswith("<") for t in added)

    def _plain_split(self) -> regex.Pattern | None:
        """The pattern of the parts that the model names one by one, if the tokenizer only lower-cases and splits plain words."""
        said = json.loads(self.tokenizer.to_str())
        steps, cuts = ((said[k] or {}).get(inner, []) for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} for s in steps)
        if not plain or not any(s["type"] == "Lowercase" for s in steps) or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or said["model"]["type"] != "BPE":
            return None
        cut, level = cuts
        whole = cut["invert"] and cut["behavior"] == "Removed" and not level["add_prefix_space"] and not level["use_regex"]
        return regex.compile(cut["pattern"]["Regex"]) if whole and "Regex" in cut["pattern"] else None

    def _ids(self, word: str) -> bytes:
        plain = TAILED.fullmatch(word)
        if plain and (self.tailed or self.whole and not plain[2]):
            letters, tail = plain.groups()
            return self.parts[letters.lower()] + self.parts[tail] if tail else self.parts[letters.lower()]
        if self.split is None or not PLAIN.fullmatch(word) or self.added.search(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.parts.__getitem__, self.split.findall(word.lower())))

    def _part(self, part: str) -> bytes:
        level = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LEVEL)  # printable ASCII stands for itself
        return array("I", [t.id for t in self.model.tokenize(level)]).tobytes()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def __call__(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.memo.__getitem__, words))


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """Pieces of at most window ids, in order: doc_id, start, length, doc_tokens, ids (little-endian 32-bit bytes)."""
    path = tokenizer or default_tokenizer()
    end = np.asarray([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.at(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for a in range(0, n, window):
                    part = ids[4 * a : 4 * (a + window)]
                    out.append((doc, a, len(part) // 4, n, part))
            kinds = [*[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECES)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree of counts finds the least capacity that suffices."""

    def __init__(self, window: int):
        self.leaves = power_of_two(window + 1)
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        self._count(capacity, 1)

    def _count(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.tree[at] += by
            at >>= 1

    def tightest(self, least: int) -> tuple[int, int] | None:
        """Takes out the window of the least capacity that is at least this."""
        at, tree = self.leaves + least, self.tree
        while not tree[at]:
            while at & 1:  # a right child: nothing further right under this parent
                at >>= 1
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # beyond the right end of its level
                return None
        while at < self.leaves:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._count(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; lengths must be at most window."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, used = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        got = free.tightest(n) if n < window else None
        capacity, which = got if got else (window, used)
        used += got is None
        where[i], offset[i] = which, window - capacity
        if capacity > n:
            free.add(capacity - n, which)
    return where, offset


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """Rows of pieces() with sequence_id, offset and ids_crc32.

    A sequence is its pieces in the order of offset, padded to window; a last piece of a power of two
    needs no padding. Pieces are written under numbers first; only numbers and lengths are placed, and the
    ids move once, to meet their places. The same table read in the same splits gives the same sequences.
    """
    cut = materialize(pieces(docs, tokenizer, window, separator).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    groups = power_of_two(cut.count() / GROUP_PIECES, LEAST_GROUPS)
    again = max(1, groups // GROUPS_AGAIN)
    dealt = cut.select("piece", "doc_id", "start", "length", F.pmod(F.xxhash64("doc_id", "start", "piece"), F.lit(groups)).cast("int").alias("g"))
    order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("piece", "ascending")]

    def place(part: pa.Table, of: int, last: bool) -> pa.Table:
        part = part.sort_by(order)
        lengths = part["length"].to_numpy()
        which, at = best_fit_decreasing(lengths, window)
        loose = np.bincount(which, lengths) < window * (1 - SLACK)
        ids = 2 * (which * of + part["g"].to_numpy()) + last
        if not last:
            part = part.append_column("loose", pa.array(loose[which]))
        return part.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(at))

    base = "piece long, doc_id long, start long, length long, g int"
    first = materialize(dealt.groupBy("g").applyInArrow(lambda part: place(part, groups, False), base + ", loose boolean, sequence_id long, offset long"), "places")
    rest = first.where("loose").drop("loose", "sequence_id", "offset").withColumn("g", (F.col("g") % again).cast("int"))
    second = rest.groupBy("g").applyInArrow(lambda part: place(part, again, True), base + ", sequence_id long, offset long")
    placed = first.where("not loose").drop("loose").unionByName(second).select("piece", "sequence_id", "offset")
    return cut.join(placed, "piece").drop("piece").withColumn("ids_crc32", F.crc32("ids"))


def sequences(packed: DataFrame, window: int = WINDOW, padding: int = SEPARATOR) -> DataFrame:
    """(sequence_id, ids, length) of the rows of pack(): the pieces' ids in the order of offset, padded to window unless length is a power of two."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    ids = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    pad = F.lit(np.asarray([padding], "<u4").tobytes().hex())
    short = (window - F.col("length")).cast("int")
    exact = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    return parts.select("sequence_id", F.when(exact, ids).otherwise(F.concat(ids, F.unhex(F.repeat(pad, short)))).alias("ids"), "length")
