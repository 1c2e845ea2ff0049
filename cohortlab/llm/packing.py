"""Best-fit packing of token pieces into sequences of fixed length, improved by swap-based local search.

Pieces are dealt by hash into groups of bounded size. A group is packed best-fit decreasing; then bins that are not full
exchange pieces (a move, one for one, two for one) whenever that raises the sum of squared fills, until a bin is empty
or nothing improves. A group leaves less than one sequence of slack more than one packing of everything would.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_text, materialise, quoted
from .tokens import MEMORY, encoder

#: pieces packed together, about
GROUP = 5_000


def token_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int = 0, with_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """doc_id, rid, piece, start, length, ids_crc32 (and ids, little-endian, with_ids): each document's ids and end_id, cut at length.

    rid is a hash that tells rows apart which share a doc_id. Null text counts as empty: one piece with the end id."""
    schema = "doc_id long, rid long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        enc = encoder(tokenizer, memory)
        end = np.array([end_id], enc.dtype).tobytes()
        wide = np.dtype("<u4")
        for b in batches:
            out = []
            for doc_id, rid, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "rid", "text")), strict=True):
                ids = np.frombuffer(enc.encode(text) + end, enc.dtype).astype(wide)
                for n, at in enumerate(range(0, len(ids), length)):
                    raw = ids[at : at + length].tobytes()
                    out.append((doc_id, rid, n, at, len(raw) // 4, zlib.crc32(raw), *([raw] if with_ids else [])))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in schema.split(", ")], x, strict=True)) for x in out], schema=arrow)

    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(f.split()[0], types[f.split()[1]]) for f in schema.split(", ")])
    rows = ids_text(docs).withColumn("rid", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(run, schema)


def pack_lengths(lengths: np.ndarray, room: int) -> np.ndarray:
    """Bin number of each length, every bin of at most room; bins are numbered from 0 without gaps."""
    order = np.argsort(-lengths, kind="stable")
    bins: list[list[int]] = []
    fill: list[int] = []
    # open bins by free room: free[r] holds the bins with r left, levels the r in use
    free: dict[int, list[int]] = {}
    levels: list[int] = []

    def put(b: int) -> None:
        r = room - fill[b]
        if r not in free or not free[r]:
            if r not in free:
                free[r] = []
            bisect.insort(levels, r)
        free[r].append(b)

    for i in order:
        n = int(lengths[i])
        at = bisect.bisect_left(levels, n)
        if at == len(levels):
            bins.append([])
            fill.append(0)
            b = len(bins) - 1
        else:
            r = levels[at]
            b = free[r].pop()
            if not free[r]:
                levels.pop(at)
        bins[b].append(int(i))
        fill[b] += n
        put(b)
    where = np.empty(len(lengths), dtype=np.int64)
    for k, members in enumerate(bins):
        where[members] = k
    improve(where, np.array(fill, dtype=np.int64), lengths, room)
    return np.unique(where, return_inverse=True)[1]


def improve(where: np.ndarray, fill: np.ndarray, lengths: np.ndarray, room: int) -> None:
    """Local search in place, until the lower bound on bins is met or no bin can give anything any more.

    A donor, the emptiest bin not yet tried, gives to bins at least as full: a piece that fits, or a longer piece for a
    shorter one, or two of its pieces for one longer than either. Every step makes a fuller bin fuller, so the sum of
    squared fills grows and the search ends."""
    tried = np.zeros(len(fill), bool)
    least = -(-int(lengths.sum()) // room)
    while (fill > 0).sum() > least:
        left = np.flatnonzero((fill > 0) & (fill < room) & ~tried)
        if not len(left):
            return
        d = int(left[np.argmin(fill[left])])
        while fill[d] > 0 and _step(d, where, fill, lengths, room):
            tried[:] = False
        tried[d] = fill[d] > 0


def _step(d: int, where: np.ndarray, fill: np.ndarray, lengths: np.ndarray, room: int) -> bool:
    mine = np.flatnonzero(where == d)
    mine = mine[np.argsort(-lengths[mine], kind="stable")]
    gap = np.where(fill >= fill[d], room - fill, 0)
    gap[d] = 0
    for i in mine:
        fits = np.flatnonzero(gap >= lengths[i])
        if len(fits):
            return _swap(d, fits[np.argmin(gap[fits])], [i], [], where, fill, lengths)
    theirs = np.flatnonzero(gap[where] > 0)
    if not len(theirs):
        return False
    # pieces of one length in bins with one gap are alike: the first of them stands for all
    _, first = np.unique(lengths[theirs] * (room + 1) + gap[where[theirs]], return_index=True)
    theirs = theirs[first]
    back, most = lengths[theirs], gap[where[theirs]]
    for two in (False, True):
        for n, i in enumerate(mine):
            # all pairs with this piece at a time
            others = mine[n + 1 :] if two else mine[n : n + 1]
            out = lengths[i] + (lengths[others] if two else 0 * lengths[others])
            gain = out[:, None] - back
            best = np.where((gain > 0) & (gain <= most), gain, 0)
            if best.any():
                h, j = np.unravel_index(best.argmax(), best.shape)
                return _swap(d, where[theirs[j]], [i, others[h]] if two else [i], [theirs[j]], where, fill, lengths)
    return False


def _swap(d: int, r: int, out: list[int], back: list[int], where: np.ndarray, fill: np.ndarray, lengths: np.ndarray) -> bool:
    step = int(lengths[out].sum() - lengths[back].sum())
    where[out], where[back] = r, d
    fill[d] -= step
    fill[r] += step
    return True


def pack(pieces: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """pieces(..., rid, piece, length) with sequence_id and offset: sequences of at most `length`, offsets gapless from 0.

    pieces is a table that reads alike each time. Pieces that fill a sequence alone need no search and no group. The number of groups follows the number of pieces, which is
    counted; only a group is in one task. An empty table gives an empty one."""
    n = pieces.where(F.col("length") < length).count()
    groups = max(1, -(-n // group))
    names = [f.name for f in pieces.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    # a full piece is a sequence where it lies: numbers below 0 are theirs
    full = pieces.where(F.col("length") >= length).select(*map(quoted, names), (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = pieces.where(F.col("length") < length).withColumn("__group", F.pmod(F.xxhash64("rid", "piece"), F.lit(groups)).cast("int"))

    def run(key, pdf):
        g = int(key[0])
        pdf = pdf.sort_values(["length", "doc_id", "rid", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        where = pack_lengths(lengths, length)
        at = np.argsort(where, kind="stable")
        end = np.cumsum(lengths[at])
        first = np.concatenate([[True], where[at][1:] != where[at][:-1]])
        begin = end - lengths[at]
        offset = np.empty(len(at), dtype=np.int64)
        offset[at] = begin - np.repeat(begin[first], np.diff(np.append(np.flatnonzero(first), len(at))))
        return pdf[names].assign(sequence_id=where + (g << 32), offset=offset)

    return dealt.groupBy("__group").applyInPandas(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, with_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """Packs documents(doc_id, text, ...) into sequences of at most `length` ids: a row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, with_ids). Null or empty text: one
    piece with the end id. Repeated rows and ties are packed each for itself; a null doc_id stays null; an empty table
    gives an empty result; other columns are ignored, whatever their names."""
    pieces = materialise(token_pieces(docs, tokenizer, length, end_id, with_ids, memory), "pieces")
    return pack(pieces, length).drop("rid")


def sequences(packed: DataFrame) -> DataFrame:
    """From pack_documents(..., with_ids=True): sequence_id, ids array<int>, length; the ids of its pieces in order."""
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("offset")
        ids = np.frombuffer(b"".join(pdf["ids"]), "<u4")
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [ids.astype(np.int64)], "length": [len(ids)]})

    return packed.groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids array<long>, length long")
