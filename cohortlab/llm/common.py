"""Shared pieces of the corpus operators: table access, shared folders, and word hashing on Arrow buffers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  binds pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, which `spark.checkpoint.dir` names.

    Without that setting a local session, whose executors are on the driver's machine, gets a folder of its own there;
    any other session is refused, since its executors would write to disks that nobody else reads."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-cohortlab-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Shuffles of finished steps go from the disks with the plans that held them; Spark finds those when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Intermediate tables in the shared folder, removed at the end of a `with` block, whether it succeeds or not."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """df, written and read again; gone after the block."""
        path = shared_path(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove_folder(self.spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bucketed(df: DataFrame, label: str, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """(df as a table in the shared folder that is dealt by key, so that joins on key don't shuffle it; what removes it)."""
    spark = df.sparkSession
    path, name = shared_path(spark, label), f"{label}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)

    def remove() -> None:
        spark.sql(f"drop table if exists {name}")
        remove_folder(spark, path)

    return spark.table(name), remove


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df has; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a DataFrame's plan, used to choose partition counts."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions_for(df: DataFrame, bytes_each: int = 48 << 20) -> int:
    """A partition count that follows the size of df's source, and is at least the session's shuffle setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(input_bytes(df) // bytes_each, 100_000))


def text_slices(batch: pa.RecordBatch, text: str = "text", limit: int = 2 << 20):
    """Slices of a batch with about limit bytes of text each."""
    size = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0)))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def rows_where(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs for whose text keep gives True; every column stays, whatever its name."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[[c.lower() for c in docs.columns].index("text")]

    def run(batches):
        for whole in batches:
            for b in text_slices(whole, text):
                yield b.filter(pa.array(keep(b.column(text))))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


# --- word hashing -----------------------------------------------------------------------------------------------------

_MUL = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values (a splitmix64 stream)."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(_MUL))


_BYTE = seeds64(256, 11) | np.uint64(1)
_P = 0x2545F4914F6CDD1D
_PINV = pow(_P, -1, 1 << 64)

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: byte values of lower-cased text, and the same with ASCII punctuation taken as white space
WORD_VALUES = _BYTE[_LOWER]
_PUNCT = _WS.copy()
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_P, _PINV):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_hashes(col: pa.Array, punctuation: bool = False, chunk: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column: (uint64 per word, word offsets per row).

    A word is a run of bytes other than \\x20 and \\x09-\\x0D, with A-Z lower-cased; with punctuation=True,
    ASCII punctuation parts words too. Equal words have equal hashes in any process."""
    data, off = text_buffers(col)
    space = _PUNCT if punctuation else _WS
    n_rows = len(off) - 1
    hashes, counts = [], np.zeros(n_rows + 1, dtype=np.int64)
    row = 0
    with np.errstate(over="ignore"):
        while row < n_rows:
            last = max(row + 1, int(np.searchsorted(off, off[row] + chunk, side="right")) - 1)
            part, at = data[off[row] : off[last]], off[row : last + 1] - off[row]
            if len(part):
                solid = ~space[part]
                fresh = np.zeros(len(part) + 1, dtype=bool)
                fresh[at] = True
                before = np.empty(len(part), dtype=bool)
                before[0] = False
                before[1:] = solid[:-1]
                starts = np.flatnonzero(solid & (~before | fresh[:-1]))
                after = np.empty(len(part), dtype=bool)
                after[-1] = False
                after[:-1] = solid[1:]
                ends = np.flatnonzero(solid & (~after | fresh[1:]))
                up, down = _power_tables(len(part) + 1)
                total = np.cumsum(WORD_VALUES[part] * up[: len(part)], dtype=np.uint64)
                lead = np.where(starts > 0, total[starts - 1], np.uint64(0))
                hashes.append(mix64((total[ends] - lead) * down[starts]))
                counts[row + 1 : last + 1] = np.diff(np.searchsorted(starts, at))
            row = last
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def shingle_hashes(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row; a row with fewer words has its whole sequence as one, an empty row none."""
    n = np.diff(off)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(counts)])
    mult = seeds64(k, 23) | np.uint64(1)
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        roll = np.zeros(len(words), np.uint64)
        for j in range(k):
            roll += padded[j : j + len(words)] * mult[j]
        roll = mix64(roll + np.uint64(k))
        row_of = np.repeat(np.arange(len(n)), counts)
        out = roll[off[row_of] + (np.arange(out_off[-1]) - out_off[row_of])] if out_off[-1] else np.zeros(0, np.uint64)
        for r in np.flatnonzero((n > 0) & (n < k)):
            s = words[off[r] : off[r + 1]]
            out[out_off[r]] = mix64(np.array([(s * mult[: len(s)]).sum(dtype=np.uint64) + np.uint64(len(s))]))[0]
    return out, out_off


def blob_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def ids_text(docs: DataFrame, *more: str) -> DataFrame:
    """The columns that an operator reads; every other column is left out, whatever its name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
