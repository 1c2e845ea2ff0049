"""Periodic runs of words: difference-cover longest common extensions, and runs enumerated from a harmonic grid.

A run is a maximal stretch of words with smallest period q and a length of max(24, 3 q) or more. Documents are rows and
are worked on where they are: nothing is shuffled. Texts of a batch are one sequence of word numbers with a symbol of its
own after each document, so that no extension crosses a document's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_text, text_buffers, text_slices

#: fixed values: a difference cover of the residues modulo 31 (every difference is one of two of these, exactly once)
PERIOD, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
#: grid points that are looked at together
BLOCK = 1 << 21


def _cover_tables() -> tuple[np.ndarray, np.ndarray]:
    """(steps by two residues until both are in the cover, place of a residue in the cover)."""
    slot = np.full(PERIOD, -1)
    slot[COVER] = np.arange(len(COVER))
    at = np.arange(PERIOD)
    inside = slot[(at[:, None] + at) % PERIOD] >= 0  # by residue and step
    return (inside[:, None, :] & inside[None]).argmax(axis=2), slot


STEPS, SLOT = _cover_tables()


class Extensions:
    """Longest common extensions of a sequence of symbols below `symbols`, whose last symbol occurs once.

    Only the suffixes at cover positions are sorted: by their first 31 symbols, then by doubling, since a cover position
    and 31 symbols, 62, 124 ... further is one too. Neighbours' common prefixes get a sparse table of range minima. A query
    compares under 31 symbols until both positions are in the cover, and then asks the table."""

    def __init__(self, seq: np.ndarray, symbols: int):
        blocks = -(-len(seq) // PERIOD)
        # what follows the end are symbols of their own, so that all suffixes differ
        self.seq = np.concatenate([seq, symbols + np.arange(blocks * PERIOD - len(seq) + 2 * PERIOD)]).astype(np.int64)
        self.at = (np.arange(blocks)[:, None] * PERIOD + COVER).ravel()
        levels, order = self._sorted(int(self.seq.max()).bit_length())
        self.rank = levels[-1]
        common = self._neighbours(levels, order)
        table = [common]
        while 2 ** len(table) <= len(common):
            half = 2 ** (len(table) - 1)
            low = table[-1].copy()
            np.minimum(table[-1][:-half], table[-1][half:], out=low[:-half])
            table.append(low)
        self.table = np.stack(table)

    def _sorted(self, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(ranks of cover positions by their first 31, 62, 124 ... symbols until all differ, their order)."""
        each, keys = max(1, 63 // max(bits, 1)), []
        for lo in range(0, PERIOD, each):
            key = np.zeros(len(self.at), np.int64)
            for j in range(lo, min(lo + each, PERIOD)):
                key = (key << bits) | self.seq[self.at + j]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        fresh = np.zeros(len(order), bool)
        for key in keys:
            fresh[1:] |= key[order[1:]] != key[order[:-1]]
        m, step, levels = len(order), len(COVER), []
        while True:
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(fresh)
            levels.append(rank)
            if rank[order[-1]] == m - 1:
                return levels, order
            pair = rank * (m + 1)
            pair[: max(m - step, 0)] += rank[step:] + 1
            order = np.argsort(pair)
            fresh = np.concatenate([[False], pair[order[1:]] != pair[order[:-1]]])
            step *= 2

    def _neighbours(self, levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Symbols that neighbours in the order have in common."""
        i, j = order[:-1].copy(), order[1:].copy()
        out = np.zeros(max(len(order) - 1, 1), np.int64)
        for t in range(len(levels) - 2, -1, -1):
            left, right = np.append(levels[t], -1), np.append(levels[t], -2)
            alike = np.flatnonzero(left[np.minimum(i, len(order))] == right[np.minimum(j, len(order))])
            out[alike] += PERIOD << t
            i[alike] += len(COVER) << t
            j[alike] += len(COVER) << t
        live = np.arange(len(i))
        a, b = self.at[order[:-1]] + out[: len(i)], self.at[order[1:]] + out[: len(i)]
        for _ in range(PERIOD - 1):
            live = live[self.seq[a[live]] == self.seq[b[live]]]
            if not len(live):
                break
            out[live] += 1
            a[live] += 1
            b[live] += 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at i and j, i != j, have in common."""
        need = STEPS[i % PERIOD, j % PERIOD]
        out, live = np.zeros(len(i), np.int64), np.arange(len(i))
        while True:
            live = live[out[live] < need[live]]
            live = live[self.seq[i[live] + out[live]] == self.seq[j[live] + out[live]]]
            if not len(live):
                break
            out[live] += 1
        reached = np.flatnonzero(out == need)
        a, b = i[reached] + need[reached], j[reached] + need[reached]
        x = self.rank[a // PERIOD * len(COVER) + SLOT[a % PERIOD]]
        y = self.rank[b // PERIOD * len(COVER) + SLOT[b % PERIOD]]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        k = np.frexp((hi - lo).astype(float))[1] - 1
        out[reached] += np.minimum(self.table[k, lo], self.table[k, hi - (1 << k)])
        return out


def _grid(size: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, period, multiple): for every row and period, the multiples that `times` - 1 more follow; in blocks."""
    most = size // times
    row = np.repeat(np.arange(len(size)), most)
    q = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = np.maximum((size[row] - 1) // np.maximum(q, 1) - (times - 2), 0)
    end = np.cumsum(count)
    for lo in range(0, int(end[-1]) if len(end) else 0, BLOCK):
        first, last = np.searchsorted(end, lo, side="right"), np.searchsorted(end, lo + BLOCK - 1, side="right") + 1
        begin = np.maximum(end[first:last] - count[first:last], lo)
        n = np.minimum(end[first:last], lo + BLOCK) - begin
        of = np.repeat(np.arange(first, min(last, len(end))), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin - (end - count)[first:last], n)
        yield row[of], q[of], k


def find_runs(rows: list[np.ndarray], symbols: int, least: int = 24, times: int = 3) -> list[np.ndarray]:
    """For each row of word numbers below `symbols`, its runs as [start, length, period], by start, then period.

    A run of `times` periods or more holds that many multiples of its period. So for every period only its multiples are
    looked at; the first one in a run gives the run by its extensions to the right, and a binary search to the left."""
    if times < 3:
        raise ValueError("runs have three periods at least")
    size = np.array([len(r) for r in rows], np.int64)
    start = np.cumsum(size + 1) - (size + 1)
    seq = np.empty(int((size + 1).sum()), np.int64)
    for d, r in enumerate(rows):
        seq[start[d] : start[d] + size[d]] = r
        seq[start[d] + size[d]] = symbols + d
    found, common = [], None
    for d, q, k in _grid(np.where(size >= least, size, 0), times):
        i = start[d] + k * q
        near = np.flatnonzero((seq[i] == seq[i + q]) & (seq[i] == seq[i + 2 * q]))
        d, q, i = d[near], q[near], i[near]
        near = np.flatnonzero(seq[i + 1] == seq[i + q + 1])
        d, q, i = d[near], q[near], i[near]
        if not len(i):
            continue
        common = common or Extensions(seq, symbols + len(rows))
        right = common(i, i + q)
        near = np.flatnonzero(right >= np.maximum(least + 1 - 2 * q, (times - 2) * q + 1))
        d, q, i, right = d[near], q[near], i[near], right[near]
        first = np.ones(len(i), bool)
        back = np.flatnonzero(i - q >= start[d])
        first[back] = common(i[back] - q[back], i[back]) < q[back]
        d, q, i, right = d[first], q[first], i[first], right[first]
        lo, hi = np.zeros(len(i), np.int64), np.minimum(q - 1, i - start[d])
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_] + 1) // 2
            holds = common(i[open_] - mid, i[open_] - mid + q[open_]) >= mid
            lo[open_[holds]] = mid[holds]
            hi[open_[~holds]] = mid[~holds] - 1
        length = lo + q + right
        keep = length >= np.maximum(least, times * q)
        found.append(np.stack([d, i - lo - start[d], length, q])[:, keep])
    if not found:
        return [np.zeros((0, 3), np.int64) for _ in rows]
    d, at, length, q = np.concatenate(found, axis=1)
    # the same stretch by a multiple of its period is the same run
    order = np.lexsort([q, length, at, d])
    d, at, length, q = d[order], at[order], length[order], q[order]
    own = np.concatenate([[True], (d[1:] != d[:-1]) | (at[1:] != at[:-1]) | (length[1:] != length[:-1])])[: len(d)]
    d, at, length, q = d[own], at[own], length[own], q[own]
    order = np.lexsort([q, at, d])
    parts = np.stack([at, length, q], axis=1)[order]
    return np.split(parts, np.searchsorted(d[order], np.arange(1, len(rows))))


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, runs array<struct<start, length, period>> by start, then period, collapsed: the text's words without those
    that a run repeats, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0 and told apart as they are. Null and empty texts
    have no runs and an empty collapsed text. Every row is worked on alone: repeated rows and null doc_ids give a row
    each, an empty table none; other columns are left out, whatever their names. Runs of several periods may overlap; a
    stretch is reported once, with its smallest period. Memory follows the longest text, times the logarithm of its words."""

    def run(batches):
        for whole in batches:
            for b in text_slices(whole):
                data, off = text_buffers(b.column("text"))
                texts = [data[lo:hi].tobytes().split() for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                every = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
                ids = np.asarray(every.indices, np.int64)
                ends = np.cumsum([len(t) for t in texts])
                runs = find_runs(np.split(ids, ends[:-1]), len(every.dictionary), least, times)
                flat = np.concatenate(runs)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array([_collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return ids_text(docs).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column | str) -> Column:
    """The run with the greatest exact length / period; of equal ones the first, then the one with the smallest period."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth document, by a digest of its id, repeats a stretch of its words up to its end.

    With h = crc32(doc_id), g = floor(h / 10): if h % 10 = 0, each of the n words i >= a = g % n becomes the word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Texts without words and null doc_ids stay."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h, n, g = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("w").cast("long"), F.col("g")
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    marked = ids_text(docs).withColumn("h", h)
    held = marked.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.floor(F.col("h") / 10))
    held = held.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(F.col("w"), place(i).cast("int"))), " ")
    return held.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))
