"""MinHash fingerprints: universal hash permutations over word shingles, and what they say about edits and neighbours."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_text, materialise, partitions_for, seeds64, shingle_hashes, word_hashes
from .near_dup import band_keys, near_duplicates, signed

PERMUTATIONS, SHINGLE = 128, 5
#: a prime: x -> (a * x + b) mod PRIME permutes 0 .. PRIME - 1, and random a and b make a universal family
PRIME = np.uint64((1 << 31) - 1)
_A = seeds64(PERMUTATIONS, 201) % (PRIME - np.uint64(1)) + np.uint64(1)
_B = seeds64(PERMUTATIONS, 202) % PRIME


def minhash(shingles: np.ndarray, off: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """[rows, PERMUTATIONS] uint32: the least of (a * x + b) mod PRIME over a row's shingles; rows without any get the largest value."""
    n = len(off) - 1
    out = np.full((n, PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    x = shingles % PRIME
    some = np.flatnonzero(np.diff(off) > 0)
    at = 0
    while at < len(some):
        # rows together, about one cache-sized block of shingles
        to = max(at + 1, int(np.searchsorted(off[some], off[some[at]] + block)))
        rows = some[at:to]
        lo, hi = off[rows[0]], off[rows[-1] + 1]
        part, starts = x[lo:hi], off[rows] - lo
        held, high = np.empty(len(part), np.uint64), np.empty(len(part), np.uint64)
        for j in range(PERMUTATIONS):
            np.multiply(part, _A[j], out=held)
            held += _B[j]
            # 2**31 is 1 modulo PRIME: the upper bits are added to the lower ones, which leaves less than 2 * PRIME
            np.right_shift(held, np.uint64(31), out=high)
            held &= PRIME
            held += high
            np.subtract(held, PRIME, out=high)
            np.minimum(held, high, out=held)
            out[rows, j] = np.minimum.reduceat(held, starts)
        at = to
    return out


def short(signature: np.ndarray) -> np.ndarray:
    """16 mixed bits of every coordinate: least values are small, so their upper bits say little."""
    with np.errstate(over="ignore"):
        return ((signature * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def signatures_of(texts: list[str | None], k: int = SHINGLE) -> np.ndarray:
    return short(minhash(*shingle_hashes(*word_hashes(pa.array(texts, pa.string())), k)))


def _bytes(signature: np.ndarray) -> bytes:
    return signature.astype(">u2").tobytes()


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


_FORM = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("open_text", pa.string()), ("first_text", pa.string())])
_COLUMNS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compare(rows: list[tuple[int | None, str, str]], k: int) -> list[dict]:
    """Result rows of (doc_id, text, next text)."""
    edited = []
    for _, text, nxt in rows:
        m = len(text) // 3
        edited.append(text[: len(text) - m] + nxt[:m])
    texts = [t for _, t, _ in rows]
    own, other = signatures_of(texts, k), signatures_of(edited, k)
    follow = signatures_of([n for _, _, n in rows[-1:]], k)
    out = []
    for i, (doc_id, text, nxt) in enumerate(rows):
        # the next text is usually the next row's
        after = own[i + 1] if i + 1 < len(rows) and rows[i + 1][1] is nxt else follow[0] if i + 1 == len(rows) else signatures_of([nxt], k)[0]
        out.append({"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited[i].encode()).digest(), "fingerprint": _bytes(own[i]), "edited_fingerprint": _bytes(other[i]), "near_edited": _likeness(own[i], other[i]), "near_next": _likeness(own[i], after)})
    return out


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Fingerprints of documents(doc_id, text, ...) and of their edited texts.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    has its last third replaced by as much of the next document's start, by descending doc_id, after the last the
    first. Documents are sorted by range partition; a partition's last document meets the next partition's first in a
    second, small step. Null text: empty. Empty texts share one fingerprint. Rows that share a doc_id are ordered by a
    hash of their text; null doc_ids come last. A lone document is its own next one. Empty table: empty result. Other
    columns are ignored, whatever their names."""
    rows = ids_text(docs).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]

    def run(batches):
        part, before, first, held, size = TaskContext.get().partitionId(), None, None, [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if first is None:
                    first = text
                if before is not None:
                    held.append((*before, text))
                    size += len(before[1])
                before = (doc_id, text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist([r | {"part": part} for r in _compare(held, k)], schema=_FORM)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([r | {"part": part} for r in _compare(held, k)], schema=_FORM)
        if before is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": before[0], "part": part, "open_text": before[1], "first_text": first}], schema=_FORM)

    ordered = rows.repartitionByRange(partitions_for(docs, 24 << 20), *order).sortWithinPartitions(*order)
    done = materialise(ordered.select("doc_id", "text").mapInArrow(run, _COLUMNS + ", part int, open_text string, first_text string"), "fingerprints")

    # one row per written partition: its last document with the first text of the next partition, or of the first
    edge = done.where("open_text is not null").select("part", "doc_id", "open_text", "first_text")
    follow = edge.select(F.lead("part").over(Window.orderBy("part")).alias("to"), F.first("part").over(Window.orderBy("part")).alias("start"), "part").select("part", F.coalesce("to", "start").alias("to"))
    nexts = edge.select(F.col("part").alias("to"), F.col("first_text").alias("next_text"))
    pairs = edge.drop("first_text").join(follow, "part").join(nexts, "to").select("doc_id", "open_text", "next_text")

    def close(batches):
        for b in batches:
            got = [_compare([tuple(r.values())], k)[0] for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(got, schema=pa.schema(list(_FORM)[:7]))

    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    out = done.where("open_text is null").select(*names).union(pairs.mapInArrow(close, _COLUMNS))
    # kept as bytes until here: hexadecimal would take twice the disk
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def _signed(docs: DataFrame, k: int) -> DataFrame:
    return signed(docs, k, lambda sets, off: band_keys(short(minhash(sets, off)).astype(np.uint64)))


def fingerprint_classes(docs: DataFrame, k: int = SHINGLE, percent: int = 80) -> DataFrame:
    """Classes of like documents: signature bands are joined in Spark, every candidate's Jaccard similarity is verified.

    Columns and cases as in near_dup.near_duplicates, with MinHash signatures in place of its sketches."""
    return near_duplicates(docs, k, percent, signer=_signed)
