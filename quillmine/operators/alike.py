"""Sets that are alike: blocks of sets, packed, and the pairs of two blocks by bits of their members."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Sets of a block on average; up to FEW of a feature are joined without blocks; tasks at most.
BLOCK, FEW, MOST_PARTS = 8192, 64, 2000
#: Bits that members are folded to, exact up to so many different ones; pairs that are tested at once, and members of pairs.
BITS, PAIRS, MEMBERS = 256, 1 << 22, 1 << 22


def pack(rows: pa.Table) -> pa.Table:
    """The sets (file, at, s) of a block as one value; at counts the members of s before the block's feature."""
    held = rows.select(["file", "at", "s"]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(held)
    return rows.slice(0, 1).select(["feature", "blocks", "block"]).append_column("held", pa.array([sink.getvalue().to_pybytes()], pa.binary()))


class _Sets:
    """Sets in the order of their sizes: file, n, at, and their members end to end (member, of which set, place in it)."""

    def __init__(self, rows: pa.Table):
        s = rows["s"].combine_chunks()
        rows = rows.take(pa.array(np.argsort(np.diff(s.offsets.to_numpy()), kind="stable")))
        s = rows["s"].combine_chunks()
        self.file, self.at, self.values = rows["file"].combine_chunks(), rows["at"].to_numpy(), s.flatten()
        self.n = np.diff(s.offsets.to_numpy()).astype(np.int64)
        self.first = np.append(0, np.cumsum(self.n))
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.of)) - self.first[self.of]

    def bits(self, member: np.ndarray, words: int, early: bool) -> np.ndarray:
        """Words of bits of members, folded by parity; of those before the block's feature if early."""
        out = np.zeros((words, len(self.n)), np.uint64)
        on = np.flatnonzero(self.place < self.at[self.of]) if early else np.arange(len(self.of))
        bit = (member[on] % (64 * words)).astype(np.uint64)
        np.bitwise_xor.at(out, (bit >> np.uint64(6), self.of[on]), np.uint64(1) << (bit & np.uint64(63)))
        return out


def _shared(x: _Sets, y: _Sets, mx: np.ndarray, my: np.ndarray, i: np.ndarray, j: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j): how many members both have, and whether both have one before the block's feature."""
    key = y.of * many + my
    order = np.argsort(key)
    key, early = key[order], (y.place < y.at[y.of])[order]
    both, sooner = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
    for part in np.array_split(np.arange(len(i)), 1 + int(x.n[i].sum()) // MEMBERS):
        n = x.n[i[part]]
        pair = np.repeat(part, n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + x.first[i[pair]]
        asked = j[pair] * many + mx[k]
        found = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        hit = key[found] == asked
        both += np.bincount(pair[hit], minlength=len(i))
        sooner[pair[hit & early[found] & (x.place[k] < x.at[i[pair]])]] = True
    return both, sooner


def pairs(x: pa.Table, y: pa.Table, same: bool, least: float) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Files of x and y, and their similarity if it is least or more and the block's feature is the first they share; same if x is y."""
    x = _Sets(x)
    y = x if same else _Sets(y)
    coded = pa.concat_arrays([x.values, y.values]).dictionary_encode()
    member, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    mx, my = member[: len(x.values)], member[len(x.values) :]
    words, exact = min(BITS, many + 63) // 64, many <= BITS
    bx, by = x.bits(mx, words, False), y.bits(my, words, False)
    ex, ey = (x.bits(mx, words, True), y.bits(my, words, True)) if exact else (None, None)
    # Sets so alike differ in no more members than this.
    apart = np.floor((1 - least) / (1 + least) * np.arange(int(x.n.max() + y.n.max()) + 1) + 1e-6).astype(np.int64)
    step = max(1, PAIRS // len(y.n))
    ends = np.flatnonzero(np.diff(x.n)) + 1
    for a, b in zip(np.append(0, ends).tolist(), np.append(ends, len(x.n)).tolist(), strict=True):
        most = np.minimum(apart[x.n[a] + y.n], np.iinfo(np.uint16).max).astype(np.uint16)
        for c in range(a, b, step):
            d = min(b, c + step)
            differ = sum(np.bitwise_count(p[c:d, None] ^ q[None, :]).astype(np.uint16) for p, q in zip(bx, by, strict=True))
            i, j = np.nonzero(differ <= most)
            apart_by, i = differ[i, j].astype(np.int64), i + c
            if same:
                once = i < j
                i, j, apart_by = i[once], j[once], apart_by[once]
            if exact:
                both = (x.n[i] + y.n[j] - apart_by) // 2
                sooner = ((ex[:, i] & ey[:, j]) != 0).any(0)
            else:
                both, sooner = _shared(x, y, mx, my, i, j, many)
            similarity = both / (x.n[i] + y.n[j] - both)
            ok = np.flatnonzero((similarity >= least) & ~sooner)
            if len(ok):
                yield x.file.take(pa.array(i[ok])), y.file.take(pa.array(j[ok])), similarity[ok]


def compare(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, b, similarity) of batches (x, y, same) of packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, same in zip(*batch.columns, strict=True):
                held = [pa.ipc.open_stream(c.as_buffer()).read_all() for c in (x, y)]
                for a, b, similarity in pairs(*held, same.as_py(), least):
                    yield pa.RecordBatch.from_arrays([a, b, pa.array(similarity)], names=["a", "b", "similarity"])

    return run
