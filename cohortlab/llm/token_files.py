"""Token ids written as canonical, length-limited Huffman codes in independent blocks, and read back.

Format. `codebook`: one row per id that occurs (id, length); codes are canonical: by length, then id. `blocks`: one row
per block of whole documents, with part and seq that order the blocks, the ids before it in its part, the documents' numbers of ids, the bits of all
ids one after another (most significant bit first), and the bit offset of every STRIDE-th id. A block needs nothing but
the codebook, so blocks decode on their own; inside a block all stretches between checkpoints are decoded together,
one table look-up per id. Blocks travel in Parquet files, which any store that Spark reads can hold.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_text, materialise, partitions_for, shared_path
from .tokens import MEMORY, encoder

#: ids between checkpoints; ids after which a block ends with its document; longest code
STRIDE, BLOCK_IDS, LIMIT = 256, 1 << 19, 20


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0, memory: int = MEMORY) -> DataFrame:
    """doc_id, ids (binary, little-endian, 2 or 4 bytes each): the whole text's ids and end_id. Null text counts as empty."""

    def run(batches):
        enc = encoder(tokenizer, memory)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([ids + end for ids in enc.encode_all(b.column("text"))], pa.binary())], ["doc_id", "ids"])

    return ids_text(docs).mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, dtype: str) -> DataFrame:
    """id, n over all rows: each task counts its own ids first, so at most the vocabulary per task is shuffled."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for ids in b.column("ids"):
                part = np.bincount(np.frombuffer(ids.as_buffer(), dtype))
                if len(part) > len(total):
                    total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
                total[: len(part)] += part
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Huffman code lengths of the symbols, none above limit.

    A plain Huffman tree gives lengths; those beyond the limit are cut, and Kraft's sum is brought back to 1 by
    lengthening the rarest symbols that have room, then shortening frequent ones into what is left."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    if n <= 1:
        return np.ones(n, np.int64)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, np.int64)
    for node in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = node
        heapq.heappush(heap, (a[0] + b[0], node))
    depth = np.zeros(2 * n - 1, np.int64)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    out = np.minimum(depth[:n], limit)
    over = int((1 << (limit - out)).sum()) - (1 << limit)
    if over > 0:
        by_count = np.argsort(counts, kind="stable")
        while over > 0:
            for i in by_count:
                if over > 0 and out[i] < limit:
                    over -= 1 << (limit - int(out[i]) - 1)
                    out[i] += 1
        for i in by_count[::-1]:
            while out[i] > 1 and (gain := 1 << (limit - int(out[i]))) <= -over:
                over += gain
                out[i] -= 1
    return out


class Codebook:
    """Canonical codes of ids: order by (length, id), each code the next number, shifted where lengths grow."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.limit = int(self.lengths.max(initial=1))
        first = np.cumsum(np.concatenate([[0], 1 << (self.limit - self.lengths)]))[:-1].astype(np.int64)
        self.codes = first >> (self.limit - self.lengths)
        size = int(self.ids.max(initial=0)) + 1
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids], self.length_of[self.ids] = self.codes.astype(np.uint64), self.lengths

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every STRIDE-th id)."""
        size = self.length_of[ids]
        end = np.cumsum(size)
        at = end - size
        total = int(end[-1]) if len(end) else 0
        # a code touches two neighbouring 32-bit words at most; its bits go to both by one 64-bit shift
        word = at >> 5
        wide = self.code_of[ids] << (np.uint64(64) - (at & 31).astype(np.uint64) - size.astype(np.uint64))
        n = (total + 31) // 32 + 1
        words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
        return words.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], at[::STRIDE]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_table"):
            sizes = 1 << (self.limit - self.lengths)
            pad = (1 << self.limit) - int(sizes.sum())
            self._table = (np.concatenate([np.repeat(self.ids, sizes), np.zeros(pad, np.int64)]).astype(np.uint32), np.concatenate([np.repeat(self.lengths, sizes), np.ones(pad, np.int64)]).astype(np.uint8))
        return self._table

    def decode(self, bits: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """n ids; the stretches after each checkpoint are walked side by side."""
        if not n:
            return np.zeros(0, np.uint32)
        ids, sizes = self.table()
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint64)
        # 32 bits from every byte on
        view = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16)) | (raw[3:-1] << np.uint64(8)) | raw[4:]
        lanes = len(checkpoints)
        out = np.zeros((lanes, STRIDE), np.uint32)
        at = checkpoints.astype(np.int64).copy()
        shift, mask, last = np.int64(40 - self.limit), np.uint64((1 << self.limit) - 1), len(view) - 1
        for step in range(min(STRIDE, n)):
            key = (view[np.minimum(at >> 3, last)] >> (shift - (at & 7)).astype(np.uint64)) & mask
            out[:, step] = ids[key]
            at += sizes[key]
        return out.reshape(-1)[:n]


def write_token_files(tokens: DataFrame, path: str, dtype: str, bytes_each: int = 48 << 20) -> None:
    """Writes tokens(doc_id, ids) to path/codebook and path/blocks, in ascending doc_id order.

    Counts are of all ids. Documents are sorted by range partition, so no task gets everything; rows that share a
    doc_id are ordered by their ids' hash, null doc_ids come first. Only the codebook, which the vocabulary bounds,
    passes the driver."""
    spark = tokens.sparkSession
    found = np.array([(r["id"], r["n"]) for r in id_counts(tokens, dtype).toLocalIterator()], np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0])]
    lengths = code_lengths(found[:, 1])
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(found[:, 0], lengths, strict=True)], "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    spread = spark.sparkContext.broadcast((found[:, 0], lengths))  # at most one entry per id of the vocabulary

    def run(batches):
        book = Codebook(*spread.value) if len(spread.value[0]) else None
        part, seq, before, docs, parts, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def block():
            ids = np.concatenate(parts)
            bits, marks = book.encode(ids)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "before": [before], "doc_ids": [[d for d, _ in docs]], "sizes": [[n for _, n in docs]], "n_ids": [len(ids)], "bits": [bits], "checkpoints": [marks.astype("<i8").tobytes()]}, schema=form)

        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), dtype).astype(np.int64)
                docs.append((doc_id, len(ids)))
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield block()
                    seq, before, docs, parts, held = seq + 1, before + held, [], [], 0
        if docs:
            yield block()

    form = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("bits", pa.binary()), ("checkpoints", pa.binary())])
    n = partitions_for(tokens, bytes_each)
    # the hash only orders rows that share a doc_id
    ordered = tokens.withColumn("h", F.xxhash64("ids")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    ordered.select("doc_id", "ids").mapInArrow(run, "part int, seq int, before long, doc_ids array<long>, sizes array<long>, n_ids long, bits binary, checkpoints binary").write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids array<long>) of every document in the files at path.

    start counts the ids of all documents before it: blocks' sums per part, at most one row per written partition, are
    added up on the driver; within a part each block says how many ids precede it."""
    blocks = spark.read.parquet(f"{path}/blocks")
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most the vocabulary
    spread = spark.sparkContext.broadcast((np.array([r["id"] for r in book], np.int64), np.array([r["length"] for r in book], np.int64)))
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    ends = np.cumsum([n for _, n in parts])
    bases = spark.sparkContext.broadcast({p: int(e - n) for (p, n), e in zip(parts, ends, strict=True)})

    def run(batches):
        book = Codebook(*spread.value) if len(spread.value[0]) else None
        for b in batches:
            for r in b.to_pylist():
                ids = book.decode(r["bits"], r["n_ids"], np.frombuffer(r["checkpoints"], "<i8"))
                raw, at = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(r["sizes"])]).astype(np.int64)
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(at[:-1] + bases.value[r["part"]] + r["before"]), pa.array(np.diff(at)), pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.select("part", "before", "doc_ids", "sizes", "n_ids", "bits", "checkpoints").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, with_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """Encodes documents(doc_id, text, ...), writes token files to the shared folder and reads them back.

    One row per document: doc_id, start, n_tokens (with the end id), ids_crc32. Null or empty text: only the end id.
    Rows that share a doc_id are documents of their own, in the order of their ids' hash; null doc_ids come first; an
    empty table gives an empty result; other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    tokens = materialise(token_table(docs, tokenizer, memory=memory), "tokens")
    path = shared_path(spark, "token-files")
    write_token_files(tokens, path, encoder(tokenizer).dtype.str)
    return read_token_files(spark, path, with_ids)
