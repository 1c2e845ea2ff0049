"""Shards by a k-d tree: splits at weighted medians along the widest dimension of the rows' metadata.

Equal texts are one atom with the sum of their bytes; only where a text's copies weigh more than a two-hundredth of a shard
is each row an atom of its own. Atoms have a coordinate for each dimension, and a digest that orders equal coordinates. A
level of the tree finds the medians of all its nodes together: bytes are summed up by node and bin, and the bin that holds
a median is cut into bins again, until it is one atom. The driver keeps a few numbers a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise, quoted, unused

#: bins of a node's range in one pass; a text whose copies weigh more than a shard over this is dealt out row by row
BINS, LOOSE = 4096, 200
#: rows that are numbered in one task
SLOTS = 50_000
#: shards that one call makes at most: the tree's nodes are held by the driver
MOST = 100_000


def _ordered(text: Column) -> Column:
    """A number that orders strings by their first seven bytes; 0 for null."""
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(F.encode(text, "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("long"), F.lit(0).cast("long"))


def _digest(text: Column) -> Column:
    """The first 60 bits of a hexadecimal digest, as a number."""
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def metadata(docs: DataFrame) -> list[Column]:
    """Coordinates of documents: a thousand times the root of their bytes; source and language where there are such columns."""
    named = {c.lower(): c for c in docs.columns}
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    return [F.floor(F.sqrt(size.cast("double")) * 1000).cast("long"), *(_ordered(quoted(named[c]).cast("string")) for c in ("source", "lang") if c in named)]


def _cuts(atoms: DataFrame, nodes: dict[int, dict], dims: int) -> dict[int, dict]:
    """nodes with value, at and last: atoms up to (value, at), that one included if last, go left.

    A node has dim, its range lo to hi there, its weight w, the share (part, want) of w that is to go left, and below: the
    weight before its range."""
    coordinate = F.element_at(F.array(*(F.col(f"x{i}") for i in range(dims))), F.col("dim") + 1)
    live = dict(nodes)
    while live:
        rows = [(n, c["dim"], c["value"], c["lo"], c["hi"], (c["hi"] - c["lo"]) // BINS + 1, -(-c["w"] * c["part"] // c["want"]) - c["below"]) for n, c in live.items()]
        table = atoms.sparkSession.createDataFrame(rows, "node int, dim int, value long, lo long, hi long, width long, goal long")
        held = atoms.join(F.broadcast(table), "node").where(F.col("value").isNull() | (coordinate == F.col("value")))
        held = held.withColumn("x", F.when(F.col("value").isNull(), coordinate).otherwise(F.col("tie"))).where(F.col("x").between(F.col("lo"), F.col("hi")))
        bins = held.groupBy("node", "goal", F.expr("(x - lo) div width").alias("bin")).agg(F.sum("w").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        bins = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        for r in bins.where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("w") < F.col("goal"))).collect():
            c = live[r["node"]]
            c["below"] += r["upto"] - r["w"]
            c["lo"], c["hi"] = r["lo"], r["hi"]
            if c["lo"] == c["hi"] and c["value"] is None:
                c |= {"value": c["lo"], "lo": 0, "hi": (1 << 60) - 1}
            elif c["lo"] == c["hi"]:
                # the atom at the cut goes to the side that this leaves nearer to its share
                c |= {"at": c["lo"], "last": (2 * c["below"] + r["w"]) * c["want"] <= 2 * c["w"] * c["part"]}
                del live[r["node"]]
    return nodes


def kd_tree(scratch: Scratch, atoms: DataFrame, shards: int, dims: int) -> DataFrame:
    """atoms(key, w, x0, x1 .., tie) with `shard`; the shards' shares of w are equal, but for half an atom at each cut."""
    spark, names = atoms.sparkSession, atoms.columns
    atoms = scratch.table(atoms.withColumn("node", F.lit(0)), "tree")
    open_, whole = {0: (0, shards)}, None  # by node: its first shard, its number of shards
    coordinate = F.element_at(F.array(*(F.col(f"x{i}") for i in range(dims))), F.col("dim") + 1)
    while any(want > 1 for _, want in open_.values()):
        ranges = [f(f"x{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["node"]: r for r in atoms.groupBy("node").agg(F.sum("w").alias("w"), *ranges).collect()}
        if not stats:
            break
        whole = whole or [max(stats[0][f"hi{i}"] - stats[0][f"lo{i}"], 1) for i in range(dims)]
        nodes = {}
        for n, (_, want) in open_.items():
            if want > 1 and n in stats:
                s = stats[n]
                dim = max(range(dims), key=lambda i: ((s[f"hi{i}"] - s[f"lo{i}"]) / whole[i], -i))
                nodes[n] = {"dim": dim, "lo": s[f"lo{dim}"], "hi": s[f"hi{dim}"], "below": 0, "w": s["w"], "part": want // 2, "want": want, "value": None}
        cut = spark.createDataFrame([(n, c["dim"], c["value"], c["at"], c["last"]) for n, c in _cuts(atoms, nodes, dims).items()], "node int, dim int, value long, at long, last boolean")
        left = (coordinate < F.col("value")) | ((coordinate == F.col("value")) & ((F.col("tie") < F.col("at")) | (F.col("last") & (F.col("tie") == F.col("at")))))
        child = 2 * F.col("node") + F.when(F.col("dim").isNull() | left, 1).otherwise(2)
        atoms = scratch.table(atoms.join(F.broadcast(cut), "node", "left").select(*names, child.cast("int").alias("node")), "tree")
        open_ = {k: v for n, (first, want) in open_.items() for k, v in ([(2 * n + 1, (first, want // 2)), (2 * n + 2, (first + want // 2, want - want // 2))] if want > 1 else [(2 * n + 1, (first, 1))])}
    leaves = spark.createDataFrame([(n, first) for n, (first, _) in open_.items()], "node int, shard int")
    return atoms.join(F.broadcast(leaves), "node").select(*names, "shard")


def _placed(scratch: Scratch, docs: DataFrame, shards: int | None, target_bytes: int | None, dimensions: list[Column] | None) -> DataFrame:
    """doc_id, digest, size, crc, key, shard for every row; the texts are read once, and don't travel."""
    dimensions = metadata(docs) if dimensions is None else dimensions
    text = F.coalesce(F.col("text"), F.lit(""))
    places = [F.coalesce(c, F.lit(0)).cast("long").alias(f"x{i}") for i, c in enumerate(dimensions)]
    rows = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), *places), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    if shards > MOST:
        raise ValueError(f"{shards} shards; one call makes {MOST} at most")
    # texts of over total / (shards * LOOSE) bytes together: fewer than shards * LOOSE, whatever the table
    heavy = rows.groupBy("digest").agg(F.sum("size").alias("w")).where(F.col("w") > total // (shards * LOOSE)).select("digest", F.lit(True).alias("heavy"))
    own = F.md5(F.concat_ws(":", "digest", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = scratch.table(rows.join(F.broadcast(heavy), "digest", "left").withColumn("key", F.when(F.col("heavy"), own).otherwise(F.col("digest"))).drop("heavy"), "keyed")
    n = len(dimensions)
    atoms = keyed.groupBy("key").agg(F.sum("size").alias("w"), *(F.min(f"x{i}").alias(f"x{i}") for i in range(n))).withColumn("tie", _digest(F.col("key")))
    tree = kd_tree(scratch, atoms, shards, n)
    return keyed.join(tree.select("key", "shard"), "key").select("doc_id", "digest", "size", "crc", "key", "shard")


def assign_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: list[Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of near equal bytes, or of target_bytes; slots are gapless from 0.

    size is the text's UTF-8 bytes plus 1. Null and empty texts are one text of size 1; equal texts share a shard unless
    their copies weigh over a two-hundredth of one; repeated rows get a slot each; null doc_ids are placed as rows are; an
    empty table gives an empty one. Null coordinates count as 0; columns of other names don't matter."""
    if (shards is None) == (target_bytes is None):
        raise ValueError("either shards or target_bytes")
    with Scratch(docs.sparkSession) as scratch:
        placed = _placed(scratch, docs, shards, target_bytes, dimensions)
        placed = placed.withColumn("o", _digest(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest").cast("binary"))))
        placed = scratch.table(placed, "placed")
        parts = placed.count() // SLOTS + 1
        placed = placed.withColumn("part", F.expr(f"o div {(1 << 60) // parts + 1}"))
        # rows are numbered in ranges of a digest; a range begins where the shard's earlier ranges end
        ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        begins = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
        slot = F.col("begin") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("o", "doc_id", "digest")) - 1
        out = placed.join(begins, ["shard", "part"]).withColumn("slot", slot)
        return materialise(out.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot")), "shards")


def write_shards(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, dimensions: list[Column] | None = None, files: int = 4) -> None:
    """Writes all rows and columns of docs to path/shard=N, in `files` files a shard."""
    shard, key, own = unused(docs, "shard", "key", "own")
    text = F.coalesce(F.col("text"), F.lit(""))
    with Scratch(docs.sparkSession) as scratch:
        placed = scratch.table(_placed(scratch, docs, shards, target_bytes, dimensions).select(F.col("key").alias(key), F.col("shard").alias(shard), (F.col("key") != F.col("digest")).alias(own), "digest", "doc_id").distinct(), "placed")
        whole = placed.where(~F.col(own)).select(key, shard).distinct()
        single = placed.where(own)
        digest = F.md5(text.cast("binary"))
        # a heavy text's rows are keyed by their doc_id too, and are never joined on the text alone
        heavy = single.select(F.col("digest").alias(key), F.lit(True).alias(own)).distinct()
        named = docs.withColumn(key, digest).join(F.broadcast(heavy), key, "left")
        named = named.withColumn(key, F.when(F.col(own), F.md5(F.concat_ws(":", F.col(key), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))).otherwise(F.col(key))).drop(own)
        out = named.join(whole.unionByName(single.select(key, shard)).distinct(), key).drop(key)
        out.repartition(F.col(shard), F.pmod(F.xxhash64("text", "doc_id"), F.lit(files))).write.partitionBy(shard).parquet(path)
