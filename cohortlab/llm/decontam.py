"""Benchmark decontamination by spaced seeds: masked windows are hashed, joined with the benchmark's, and verified.

A mask keeps some positions of a window of words and ignores the others, so a hit survives substitutions in ignored
places; the masks are fixed. Hits of a document and an item on one diagonal are verified over the whole stretch: an
aligned window of `window` words of which `share` match counts as contamination. An item with fewer words than that
must match as a whole; its masks are made from its length, so that the substitutions it may have always leave one
intact. The join is a broadcast join of hashes: the benchmark, in slices of bounded size, goes to every worker once.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_text, materialise, mix64, rows_where, seeds64, text_slices, word_hashes

#: fixed masks over windows of up to 11 words; 1 keeps a word, 0 ignores it
MASKS = ("11101101011", "1101101", "1110111", "101111")
#: items' words hashed into one broadcast at most; a larger benchmark is taken in several passes
SLICE_WORDS = 2_000_000
#: hits looked at together
HITS = 1 << 20
_held: dict[str, "Index"] = {}


def short_masks(n: int, share: float) -> list[str]:
    """Masks over all n words of an item that may have n - ceil(share * n) substitutions, one of which they all leave intact.

    The words are cut into two segments more than there may be substitutions; each mask keeps two of them."""
    spare = n - int(np.ceil(share * n - 1e-9))
    cut = [n * i // (spare + 2) for i in range(spare + 3)]
    segments = [range(a, b) for a, b in itertools.pairwise(cut)]
    kept = [{*x, *y} for x, y in itertools.combinations(segments, 2)]
    return list(dict.fromkeys("".join("01"[j in k] for j in range(n)) for k in kept if k))


def _mask_hashes(words: np.ndarray, off: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the window's first word) of every window that lies inside one row."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kept = [j for j, c in enumerate(mask) if c == "1"]
    mult = seeds64(len(kept), 131 + len(mask)) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for m, j in zip(mult, kept, strict=True):
            h += words[j : j + n] * m
        h = mix64(h + np.uint64(int(mask, 2)) + np.uint64(len(mask)))
    begin = np.arange(n)
    at = np.flatnonzero(np.searchsorted(off, begin, "right") == np.searchsorted(off, begin + len(mask) - 1, "right")) if len(off) > 2 else begin
    return h[at], at


class Seeds:
    """One mask's hashes of a benchmark slice, with the hash of the window before each: seeds that only go on with a hit add nothing to its diagonal."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, row: np.ndarray):
        self.known, number = np.unique(hashes, return_inverse=True)
        self.n = np.int64(len(self.known) + 1)
        place = np.full(len(row) + 1, -1, np.int64)
        place[at] = number
        before = np.where((at > 0) & (row[at - 1] == row[at]), place[at - 1] + 1, 0)
        key = number * self.n + before
        order = np.argsort(key, kind="stable")
        self.key, self.at = key[order], at[order]

    def number(self, h: np.ndarray) -> np.ndarray:
        """Of each hash, -1 where it isn't known."""
        if not len(self.known):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at, -1)

    def hits(self, h: np.ndarray, pos: np.ndarray, bits: np.ndarray):
        """Chunks of (position, seed's position), without hits that follow a hit one word before."""
        some = np.flatnonzero(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
        number = self.number(h[some])
        some, number = some[number >= 0], number[number >= 0]
        if not len(some):
            return
        # the window before, if it begins one word before
        at = np.maximum(some - 1, 0)
        follows = (some > 0) & (pos[at] == pos[some] - 1)
        before = np.where(follows, self.number(h[at]), -1) + 1
        lo, hi = np.searchsorted(self.key, number * self.n), np.searchsorted(self.key, (number + 1) * self.n)
        a = np.where(before > 0, np.searchsorted(self.key, number * self.n + before), hi)
        b = np.where(before > 0, np.searchsorted(self.key, number * self.n + before, "right"), hi)
        for first, last in ((lo, a), (b, hi)):
            n = last - first
            on = np.flatnonzero(n)
            done = np.concatenate([[0], np.cumsum(n[on])])
            x = 0
            while x < len(on):
                y = max(x + 1, int(np.searchsorted(done, done[x] + HITS, "right")) - 1)
                c = n[on[x:y]]
                yield np.repeat(pos[some[on[x:y]]], c), self.at[np.repeat(first[on[x:y]] - (done[x:y] - done[x]), c) + np.arange(c.sum())]
                x = y


class Index:
    """Seeds of one slice of the benchmark, and a bitmap for a first look."""

    def __init__(self, ids: list[int | None], texts: list[str | None], window: int, share: float, min_words: int):
        self.ids, self.window, self.share = ids, window, share
        self.words, self.off = word_hashes(pa.array(texts, pa.string()), punctuation=True)
        self.size = np.diff(self.off)
        self.row = np.repeat(np.arange(len(ids)), self.size)
        self.bits = np.zeros(1 << 21, bool)
        #: (mask, whether it is over whole items, seeds)
        self.masks: list[tuple[str, bool, Seeds]] = []
        for mask in MASKS:
            self._add(mask, False, self.size >= window)
        for n in range(min_words, window):
            if (self.size == n).any():
                for mask in short_masks(n, share):
                    self._add(mask, True, self.size == n)

    def _add(self, mask: str, whole: bool, wanted: np.ndarray) -> None:
        h, at = _mask_hashes(self.words, self.off, mask)
        on = wanted[self.row[at]]
        h, at = h[on], at[on]
        self.masks.append((mask, whole, Seeds(h, at, self.row)))
        self.bits[(h & np.uint64(len(self.bits) - 1)).astype(np.int64)] = True

    def matches(self, words: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, matched words, aligned words, first word in the row, first in the item), the best of each row and item."""
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}

        def better(row: int, item: int, found: tuple[int, int, int, int]) -> None:
            if found > best.get((row, item), (0, 0, 0, 0)):
                best[row, item] = found

        diagonals = np.zeros((0, 3), np.int64)
        for mask, whole, seeds in self.masks:
            h, pos = _mask_hashes(words, off, mask)
            for hit, seed in seeds.hits(h, pos, self.bits):
                item = self.row[seed]
                row = np.searchsorted(off, hit, "right") - 1
                if whole:
                    n = len(mask)
                    same = np.zeros(len(hit), np.int64)
                    for j in range(n):
                        same += words[hit + j] == self.words[seed + j]
                    for i in np.flatnonzero(same >= self.share * n - 1e-9):
                        better(int(row[i]), int(item[i]), (int(same[i]), n, int(hit[i] - off[row[i]]), 0))
                else:
                    # one alignment for each row, item and diagonal
                    diagonals = np.unique(np.concatenate([diagonals, np.stack([row, item, hit - (seed - self.off[item])], axis=1)]), axis=0)
        for row, item, shift in diagonals.tolist():
            lo, hi = max(int(off[row]), shift), min(int(off[row + 1]), shift + int(self.size[item]))
            if hi - lo < self.window:
                continue
            first = int(self.off[item]) + lo - shift
            same = words[lo:hi] == self.words[first : first + hi - lo]
            total = np.concatenate([[0], np.cumsum(same)])
            starts = np.flatnonzero(total[self.window :] - total[: -self.window] >= self.share * self.window)
            if len(starts):
                x, y = int(starts[0]), int(starts[-1]) + self.window
                better(row, item, (int(same[x:y].sum()), y - x, lo + x - int(off[row]), lo + x - shift))
        return [(r, i, *f) for (r, i), f in sorted(best.items())]


def _slices_of(benchmark: DataFrame, slice_words: int) -> list:
    """Functions, one for each slice of the benchmark, that bring it to the workers. They give (what gives a worker its Index,
    made once in its life; what lets the slice go, None if there is no other)."""

    def share_out(part: DataFrame, alone: bool, **how):
        held = part.select("item_id", "text").collect()  # slice_words words, about
        spread = benchmark.sparkSession.sparkContext.broadcast(([r["item_id"] for r in held], [r["text"] for r in held]))
        name = uuid.uuid4().hex

        def index() -> Index:
            if name not in _held:
                while len(_held) > 1:
                    _held.pop(next(iter(_held)))
                _held[name] = Index(*spread.value, **how)
            return _held[name]

        # with more than one slice, each is done and let go before the next one comes to the driver
        return index, None if alone else spread.destroy

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    slices = max(1, -(-int(total) // slice_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    return [lambda k=k, **how: share_out(items.where(part == k), slices == 1, **how) for k in range(slices)]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, min_words: int = 5, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Overlaps of documents(doc_id, text, ...) with benchmark(item_id, text, ...), the best of each row and item.

    Columns: doc_id, item_id, matched, aligned (words of the stretch), doc_word, item_word (where it starts). Words are
    lower-cased and parted by white space and ASCII punctuation. The benchmark is broadcast in slices of about
    slice_words words: one pass over the documents if it fits in one, more passes if it doesn't; its size is counted
    first. Items of fewer than min_words words say too little and match nothing; 1 takes all. Null or empty text on
    either side matches nothing; rows that repeat are reported each; null ids stay null; empty tables give an empty
    result; other columns are ignored, whatever their names. Hits grow with a text's length, not with its repetitions:
    those that only go on with a hit are left out, as they are on its diagonal."""
    form = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.int32()) for c in ("matched", "aligned", "doc_word", "item_word"))])
    out = None
    for make in _slices_of(benchmark, slice_words):
        index, release = make(window=window, share=share, min_words=min_words)

        def run(batches, index=index):
            for b in batches:
                for part in text_slices(b):
                    words, off = word_hashes(part.column("text"), punctuation=True)
                    ids, found = part.column("doc_id").to_pylist(), index()
                    rows = [(ids[r], found.ids[i], *rest) for r, i, *rest in found.matches(words, off)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), form, strict=True)], schema=form)

        found = ids_text(docs).mapInArrow(run, "doc_id long, item_id long, matched int, aligned int, doc_word int, item_word int")
        if release:
            found = materialise(found, "matches")
            release()
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, min_words: int = 5, slice_words: int = SLICE_WORDS) -> DataFrame:
    """docs without the rows whose text overlaps with the benchmark; every column stays, whatever its name.

    Rows are judged each by its own text in the pass that reads them, so nothing is shuffled; cases as in contaminated()."""
    for make in _slices_of(benchmark, slice_words):
        index, release = make(window=window, share=share, min_words=min_words)

        def clean(col, index=index):
            words, off = word_hashes(col, punctuation=True)
            out = np.ones(len(col), bool)
            out[[r for r, *_ in index().matches(words, off)]] = False
            return out

        docs = rows_where(docs, clean)
        if release:
            docs = materialise(docs, "clean")
            release()
    return docs
