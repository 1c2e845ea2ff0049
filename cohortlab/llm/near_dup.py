"""Near-duplicate classes by fast similarity sketching, banding, exact verification and connected components.

A sketch has T coordinates. In round i < T every element is hashed to a coordinate and a value in [i, i+1); in round
T + j all elements go to coordinate j. A coordinate keeps its least value, and a row is done once all its coordinates
are filled, which the second half of the rounds guarantees. Equal coordinates estimate Jaccard similarity.

In a bucket of a band, all members are verified against one pivot. What is left are pairs of members of which one at
least is unlike the pivot; they are found without comparing everything with everything, by what they have in common
apart from the pivot. With t the least similarity, P the pivot's set, and of each member X its additions A(X) = X - P,
its removals R(X) = P - X and w(X) = t |A(X)| + |R(X)|:

    J(X, Y) >= t   exactly if   |A(X) & A(Y)| + |R(X) & R(Y)| >= (w(X) + w(Y) - (1 - t) |P|) / (1 + t)
    J(X, P) < t    exactly if   w(X) > (1 - t) |P|

So two linked members, one of them unlike the pivot, share a difference from it, and each alone bounds from below how
many: a join on the rarest differences (as many as can be in a linked pair's way) loses no link. Near copies differ
from their pivot in words of their own, so that few rows meet; what all of a group have in common isn't joined on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, ids_text, let_go, materialise, mix64, quoted, seeds64, shingle_hashes, text_slices, unused, word_hashes
from .components import connected_components

SLOTS, BANDS, BAND_ROWS = 128, 32, 4
#: members that meet one copy of their pivot's set
BLOCK = 256


def distinct_sets(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row."""
    h, row = hashes.copy(), np.repeat(np.arange(len(off) - 1), np.diff(off))
    # rows are short: sorting each alone is several times faster than one sort by row and hash
    for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        h[x:y].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(off) - 1))]).astype(np.int64)


def sketch_rows(sets: np.ndarray, off: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Fast similarity sketches, [rows, slots] uint64; rows without elements keep the largest value."""
    n = len(off) - 1
    bits = slots.bit_length() - 1
    if 1 << bits != slots:
        raise ValueError("slots must be a power of two")
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, slots), full, dtype=np.uint64)
    flat = out.reshape(-1)
    seeds = seeds64(2 * slots, 41)
    live = np.flatnonzero(np.diff(off) > 0)
    size = np.diff(off)[live]
    base = np.repeat(live * slots, size)
    with np.errstate(over="ignore"):
        for i in range(2 * slots):
            if not len(live):
                break
            h = (sets ^ seeds[i]) * (seeds[i] | np.uint64(1))
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            slot = (h >> np.uint64(64 - bits)).astype(np.int64) if i < slots else np.int64(i - slots)
            # the round stands above the value, so that an earlier round always wins
            h &= np.uint64((1 << (62 - bits)) - 1)
            np.minimum.at(flat, base + slot, h | (np.uint64(i) << np.uint64(62 - bits)))
            open_rows = (out[live] == full).any(axis=1)
            if not open_rows.all():
                on = np.repeat(open_rows, size)
                sets, base, live, size = sets[on], base[on], live[open_rows], size[open_rows]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """[rows, bands] int64: hashes of groups of `rows` coordinates, from the first on."""
    n = len(sketch)
    mult = seeds64(rows, 57) | np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = (sketch[:, : bands * rows].reshape(n, bands, rows) * mult).sum(axis=2, dtype=np.uint64) + seeds64(bands, 58)
        return mix64(mixed).view(np.int64)


def set_ids(sets: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each row's set; None for the empty set."""
    with np.errstate(over="ignore"):
        out = []
        for seed in (71, 72):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ seeds64(1, seed)[0]), dtype=np.uint64)])
            out.append(mix64(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64)))
    both = np.stack(out, axis=1).astype("<u8").tobytes()
    return [both[16 * i : 16 * i + 16] if off[i + 1] > off[i] else None for i in range(len(off) - 1)]


def _sets_of(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_sets(*shingle_hashes(*word_hashes(col), k))


def signatures(docs: DataFrame, k: int, slots: int = SLOTS) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, node (128-bit name of the set, null when empty), bands."""
    return signed(docs, k, lambda sets, off: band_keys(sketch_rows(sets, off, slots)))


def signed(docs: DataFrame, k: int, bands_of) -> DataFrame:
    """signatures() with the band keys that bands_of(sets, offsets) makes of the distinct shingles."""

    def run(batches):
        for whole in batches:
            for b in text_slices(whole):
                sets, off = _sets_of(b.column("text"), k)
                bands = bands_of(sets, off)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), b.column("h"), pa.array(np.diff(off)), pa.array(set_ids(sets, off), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(off), dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1))),
                    ],
                    ["doc_id", "h", "n_shingles", "node", "bands"],
                )

    return ids_text(docs).withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, n_shingles long, node binary, bands array<long>")


def _full_sets(docs: DataFrame, who: DataFrame, k: int):
    """(node, items) of the nodes in who(node, rep_id, rep_h), by a row that has the set: the whole sets, dealt by node; and what removes them."""

    def sets(batches):
        for whole in batches:
            for b in text_slices(whole):
                hashes, off = _sets_of(b.column("text"), k)
                names = set_ids(hashes, off)
                want = b.column("node").to_pylist()
                raw = hashes.astype("<u8").tobytes()
                keep = [i for i in range(len(want)) if names[i] == want[i]]
                yield pa.RecordBatch.from_arrays([pa.array([want[i] for i in keep], pa.binary()), pa.array([raw[8 * off[i] : 8 * off[i + 1]] for i in keep], pa.binary())], ["node", "items"])

    texts = ids_text(docs).withColumn("h", F.xxhash64("text")).join(who, (F.col("h") == F.col("rep_h")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("node", "text")
    return bucketed(texts.mapInArrow(sets, "node binary, items binary").dropDuplicates(["node"]), "sets", "node")


def _with_pivots(pairs: DataFrame, held: DataFrame, make, schema: str) -> DataFrame:
    """make(pivot, its set, [(node, its set)]) -> columns, over pairs(node, pivot), in blocks of a pivot's nodes.

    A pivot's set travels once for each block; rows follow each other, so a task holds one pivot and one batch."""
    blocks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = pairs.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(held, "node")
    heads = blocks.join(held.withColumnRenamed("node", "pivot"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("binary").alias("node"), "items")
    rows = members.select("pivot", "block", "node", "items").union(heads)
    rows = rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block", F.col("node").asc_nulls_first())

    def run(batches):
        pivot = items = None
        for b in batches:
            found = []
            for p, node, raw in zip(*(b.column(c).to_pylist() for c in ("pivot", "node", "items")), strict=True):
                if node is None:
                    pivot, items = p, np.frombuffer(raw, "<u8")
                else:
                    assert p == pivot
                    found.append((node, pivot, *make(items, np.frombuffer(raw, "<u8"))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), form, strict=True)], schema=form)

    types = {"binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    schema = "node binary, pivot binary, " + schema
    form = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])
    return rows.select("pivot", "node", "items").mapInArrow(run, schema)


def _verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """pairs(node, pivot) with like (their similarity) and linked (whether it is `percent` at least)."""

    def make(p, x):
        both = len(np.intersect1d(p, x, assume_unique=True))
        union = len(p) + len(x) - both
        return both / union, 100 * both >= percent * union

    return materialise(_with_pivots(pairs, held, make, "like double, linked boolean"), "verified")


def _differences(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Of each node: items (differences from the pivot that a partner can share), adds (how many of them, the first ones,
    are additions), total (all that count), w (of the docstring above, times 100), p_n (size of the pivot), few and many
    (rarest ones to be joined on, see _candidates), long.

    A long node has over (1 - t) of its own size in additions: then any partner shares at least so many additions as
    exceed that, and its removals don't matter."""

    def make(p, x):
        more, gone = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
        a, r = len(more), len(gone)
        w = percent * a + 100 * r
        if 100 * a > (100 - percent) * len(x):
            rarest = (100 - percent) * len(x) // 100 + 1
            return more.view(np.int64), a, a, w, len(p), rarest, rarest, True
        least = max(1, -(-(w - (100 - percent) * len(p)) // 100))
        return np.concatenate([more, gone]).view(np.int64), a, a + r, w, len(p), a + r - w // (100 + percent), a + r - least + 1, False

    return _with_pivots(pairs, held, make, "items array<long>, adds int, total int, w int, p_n int, few int, many int, long boolean")


def _meeting(nodes: DataFrame, percent: int) -> DataFrame:
    """The rows that _candidates joins: a node's differences e that others have too, with few and many (whether it is one of
    those to be joined on), and rest and added_rest (how many shared ones, and additions, follow in the order)."""
    cols = ["pivot", "node", "n", "comp", "outlier", "left", "total", "adds", "w", "p_n", "few", "many", "long"]
    each = materialise(nodes.select(*cols, F.posexplode("items").alias("at", "e")).withColumn("added", F.col("at") < F.col("adds")).drop("at"), "differences")
    known = each.groupBy("pivot", "e").agg(F.count("*").alias("c"), F.max("left").alias("l"), F.max("outlier").alias("o"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("w").alias("least_w"))
    known = known.where((F.col("c") > 1) & F.col("l") & F.col("o") & (F.col("x") != F.col("y"))).select("pivot", "e", "c", "least_w")
    # differences that nobody shares come first in the order; rest: shared ones from here on, added_rest: additions among them
    w = Window.partitionBy("pivot", "node")
    onward = w.orderBy("c", "e").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    each = each.join(known, ["pivot", "e"]).withColumns({"rest": F.count("*").over(onward), "added_rest": F.sum(F.col("added").cast("int")).over(onward)})
    place = F.col("total") - F.col("rest") + 1
    each = each.withColumns({"few": place <= F.col("few"), "many": place <= F.col("many")})
    # a row's own numbers can rule out every partner: none has a smaller w than the least with this difference, nor fewer
    # shingles than `percent` of the row's; what is left is bounded by the differences it has in common with anybody
    near = F.col("w") + F.col("least_w") - (100 - percent) * F.col("p_n") <= (100 + percent) * F.col("rest")
    own = percent * F.col("n") - 100 * (F.col("n") - F.col("adds")) <= 100 * F.col("added_rest")
    can = F.when(F.col("long"), F.col("added") & F.col("few") & own).otherwise(((F.col("many") | F.col("few")) & near) | (F.col("added") & own))
    return each.where(can).drop("total", "least_w")


def _candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, pivot) across components that can be linked, of nodes(pivot, node, n, comp, outlier, left, ...).

    A pair has a left node, and one that is an outlier: unlike the pivot. Differences are ordered by how many of the
    pivot's nodes have them; a pair is found at its first common one. Two outliers, and any inlier, share over
    w / (1 + t) differences: all but so many of a node's, the rarest (few), are joined on; an outlier with an inlier is
    joined on its `many` rarest. Where one of the two is long, additions alone are: its few rarest and all of the
    other's. What both have left from a common difference on must be as much as this pair needs to have in common; rows
    that can't have that with any partner, by their own numbers, don't meet anybody: pages of one template that lack the
    pivot's words and share nothing else stay apart."""
    each = _meeting(nodes, percent)
    a = each.where("left").select(*(F.col(c).alias(f"a_{c}") for c in each.columns))
    b = each.select(*(F.col(c).alias(f"b_{c}") for c in each.columns))
    c = F.col
    additions = c("a_added") & (~c("a_long") | c("a_few")) & (~c("b_long") | c("b_few"))
    outside = F.least(c("a_n") - c("a_adds"), c("b_n") - c("b_adds"))
    additions &= percent * (c("a_n") + c("b_n")) - (100 + percent) * outside <= (100 + percent) * F.least("a_added_rest", "b_added_rest")
    every = F.when(c("a_outlier") & c("b_outlier"), c("a_few") & c("b_few")).when(c("a_outlier"), c("a_many") & c("b_few")).otherwise(c("a_few") & c("b_many"))
    every &= c("a_w") + c("b_w") - (100 - percent) * c("a_p_n") <= (100 + percent) * F.least("a_rest", "b_rest")
    fits = (c("a_outlier") | c("b_outlier")) & (percent * F.greatest("a_n", "b_n") <= 100 * F.least("a_n", "b_n"))
    on = (c("a_pivot") == c("b_pivot")) & (c("a_e") == c("b_e")) & (c("a_comp") != c("b_comp")) & fits & F.when(c("a_long") | c("b_long"), additions).otherwise(every)
    return a.join(b, on).select(F.least("a_node", "b_node").alias("node"), F.greatest("a_node", "b_node").alias("pivot")).distinct()


def _pivots(rows: DataFrame) -> DataFrame:
    """rows(band, node, w) with the pivot of each band: the node of the largest w, then name."""
    chosen = rows.groupBy("band").agg(F.max(F.struct("w", "node")).alias("p"), F.count("*").alias("n")).where("n > 1")
    return rows.join(chosen.select("band", F.col("p.node").alias("pivot")), "band").where("node != pivot")


def _named(rows: DataFrame, comp: DataFrame, node: str = "node", name: str = "comp") -> DataFrame:
    """rows with the component of a node: the node itself if it is linked with nothing."""
    return rows.join(comp.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _joined(links: DataFrame, new: DataFrame, comp: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(all links, their components), after new(node, pivot) ones; the work is left out if they join no components."""
    if comp is not None:
        new = materialise(_named(_named(new, comp), comp, "pivot", "other").where("comp != other"), "links")
        if new.isEmpty():
            return links, comp
    new = new.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links = new if links is None else links.union(new)
    return links, connected_components(links)


def _components(buckets: DataFrame, sizes: DataFrame, held: DataFrame, percent: int, levels: int) -> DataFrame:
    """Components of the nodes, linked within buckets(band, node, w): connected_components() of all links.

    At each level a bucket's nodes are verified against its pivot, and those unlike it are the bucket of the next
    level. A node's home is the level whose pivot it is most like, so large groups of different kinds in one bucket
    have homes of their own. Pairs are found by their differences from the pivot of the home that comes first."""
    links = comp = None
    found = []
    rows = buckets
    for level in range(levels):
        let_go(held.sparkSession)
        rows = _pivots(rows)
        done = _verified(rows.select("node", "pivot").distinct(), held, percent)
        links, comp = _joined(links, done.where("linked").select("node", "pivot"), comp)
        named = _named(rows, comp)
        # without the pivot, which all have been held against
        spans = named.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("band")
        rows = materialise(named.drop("comp").join(spans, "band").join(done, ["node", "pivot"]), "spanning")
        found.append(rows.withColumn("level", F.lit(level)))
        rows = rows.where("not linked").select("band", "node", "w")
        if rows.isEmpty():
            break
    every = found[0]
    for rows in found[1:]:
        every = every.union(rows)
    homes = every.groupBy("band", "node").agg(F.max(F.struct("like", (-F.col("level")).alias("before"))).alias("best")).select("band", "node", (-F.col("best.before")).alias("home"))
    use = every.join(homes, ["band", "node"]).where("home >= level")
    # a pivot can serve buckets on several levels: its nodes are looked at together
    use = _named(use.groupBy("pivot", "node").agg(F.first("linked").alias("linked"), F.max(F.col("home") == F.col("level")).alias("left")), comp)
    alive = use.groupBy("pivot").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("linked").alias("alike")).where("x != y and not alike").select("pivot")
    use = materialise(use.join(alive, "pivot").join(sizes, "node"), "compared")
    let_go(held.sparkSession)
    nodes = _differences(use.select("node", "pivot"), held, percent).join(use, ["node", "pivot"]).withColumn("outlier", ~F.col("linked"))
    pairs = materialise(_candidates(nodes, percent), "pairs")
    let_go(held.sparkSession)
    more = _verified(pairs, held, percent)
    return _joined(links, more.where("linked").select("node", "pivot"), comp)[1]


def classes(docs: DataFrame, k: int = 5, percent: int = 80, signer=signatures, levels: int = 2) -> DataFrame:
    """near_duplicates() with h, the xxhash64 of the row's text (of empty text for null)."""
    sig = materialise(signer(docs, k), "signatures")
    full = sig.where("node is not null")
    reps = materialise(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.min(F.struct("doc_id", "h")).alias("row")), "nodes")

    # buckets with two nodes or more; a node's weight is how many nodes share its buckets
    rows = full.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode(F.array_distinct("bands")).alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    rows = materialise(rows.join(sizes, "band"), "buckets")
    weight = materialise(rows.groupBy("node").agg(F.sum("size").alias("w")), "weights")
    who = weight.select("node").join(reps, "node").select("node", F.col("row.doc_id").alias("rep_id"), F.col("row.h").alias("rep_h"))
    held, remove = _full_sets(docs, who, k)
    try:
        comp = _components(rows.join(weight, "node").select("band", "node", "w"), reps.select("node", F.col("n_shingles").alias("n")), held, percent, levels)
    finally:
        remove()

    # least doc_id of each component, or of each class of copies
    named = reps.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = named.join(least, "root").where("copies > 1 or component_id != doc_id").select("node", "component_id")
    out = sig.select("doc_id", "h", "n_shingles", "node").join(label, "node", "left")
    return out.select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, signer=signatures, levels: int = 2) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    A document's set is its distinct k-word shingles (with fewer words the whole sequence as one). Sets are linked if
    100 * |intersection| >= percent * |union|; component_id is the least doc_id reachable, kept says that it is the
    row's own. Candidates share a band of the sketch (of a pair at 0.8, all 32 bands differ with odds of 5e-8); every
    candidate across components is confirmed on full sets or ruled out exactly. Copies, which have equal sets, are one
    node from the start. No task gets a whole bucket, and no pair inside a component is made but those with a pivot.

    Null or empty text: empty set, linked with nothing, kept. Rows that repeat a doc_id go each by its own text: they
    can be in different components. A null doc_id sorts as absent: it never names a component unless its class has no
    other id, and is always kept. Empty table: empty result. Other columns are ignored, whatever their names."""
    return classes(docs, k, percent, signer, levels).drop("h")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, every column as it is, with one row of each near-duplicate class: of the least doc_id.

    Rows with one doc_id and different texts are judged each by its text; rows with equal doc_id and text are one
    document, of which one row stays. Rows with null or empty text, or a null doc_id, stay, but for such repeats.
    An empty table gives an empty one."""
    h, n, key = unused(docs, "__h", "__n", "__id")
    gone = classes(docs, k, percent).where("not kept").select(F.col("doc_id").alias(key), F.col("h").alias(h)).distinct()
    rows = docs.withColumns({h: F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), key: F.col("doc_id").cast("long")})
    one = rows.withColumn(n, F.row_number().over(Window.partitionBy(key, h).orderBy(F.lit(1)))).where(F.col(n) == 1)
    return one.join(gone, [key, h], "left_anti").select(*(quoted(c) for c in docs.columns))
