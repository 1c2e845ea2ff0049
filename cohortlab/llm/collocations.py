"""Phrase collocations: word and pair counts over the whole corpus, then best-first growth of the pairs to triples.

The score of a phrase is that of its worst cut, a * a / (l * r). A pair's count bounds what grows from it: a triple that
begins with the pair w1 w2 scores f(w1 w2) / f(w1) at most, and one that ends with w2 w3 scores f(w2 w3) / f(w3) at most.
So with a threshold for each language only triples between two pairs whose bounds reach it are counted, and those that
could hold a pair that reaches it. Thresholds begin at the score of a pair at twice the wanted rank, and are lowered for
languages whose last wanted score isn't settled, down to 0, where all is counted.

Words are 64-bit keys of word and language, checked to be unique; texts are read by vectorised numpy, counts meet in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, Scratch, _power_tables, materialise, mix64, seeds64, text_buffers, text_slices
from .common import WORD_VALUES as VALUES

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?\n\x0b\x0c\r"]] = True
_SPACE = _PIECE.copy()
_SPACE[[9, 32]] = True
_LOW8 = _LOWER.astype(np.uint8)
#: bits of a filter: so many for each key, and at most 2**28 in all (32 MB); a fuller filter lets more pass, and misses none
BITS_A_KEY, MOST_BITS, PROBES = 16, 1 << 28, 4


def _words(col: pa.Array, langs: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys of all words, whether the next word follows in the same piece, lower-cased bytes, word starts, word ends)."""
    data, off = text_buffers(col)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(bool), data, none, none
    solid = ~_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[off] = True
    starts = np.flatnonzero(solid & (~np.append(False, solid[:-1]) | fresh[:-1]))
    ends = np.flatnonzero(solid & (~np.append(solid[1:], False) | fresh[1:])) + 1
    piece = np.cumsum(_PIECE[data] | fresh[:-1])[starts]
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.cumsum(VALUES[data] * up[: len(data)], dtype=np.uint64)
        lead = np.where(starts > 0, total[starts - 1], np.uint64(0))
        keys = mix64((total[ends - 1] - lead) * down[starts] ^ seeds64(1, 7 + seed)[0])
        salt = {x: np.uint64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, salt=b"%d" % seed).digest())) for x in set(langs.to_pylist())}
        rows = np.array([salt[x] for x in langs.to_pylist()], np.uint64)
        keys = mix64(keys ^ rows[np.searchsorted(off, starts, side="right") - 1])
    return keys, np.append(piece[1:] == piece[:-1], False), _LOW8[data], starts, ends


def _slices(batches: Iterator[pa.RecordBatch], seed: int):
    for whole in batches:
        for b in text_slices(whole, limit=4 << 20):
            yield b, _words(b.column("text"), b.column("lang"), seed)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _word_counts(seed: int):
    def run(batches):
        for b, (keys, _, data, starts, ends) in _slices(batches, seed):
            if len(keys):
                off = text_buffers(b.column("text"))[1]
                keys, first, n = np.unique(keys, return_index=True, return_counts=True)
                lang = b.column("lang").take(pa.array(np.searchsorted(off, starts[first], side="right") - 1))
                words = [data[lo:hi].tobytes() for lo, hi in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([_signed(keys), lang, pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], ["h", "lang", "word", "n"])

    return run


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _bits(key: np.ndarray, size: int, probe: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(key + seeds64(PROBES, 31)[probe]) & np.uint64(size - 1)


class Filters:
    """Membership filters of keys, one for each kind, without false negatives; made in Spark, and of bounded size.

    df has kind (0 to kinds - 1) and one or two columns of keys."""

    def __init__(self, df: DataFrame, kinds: int, n: int):
        size = self.size = min(max(1 << 16, 1 << (n * BITS_A_KEY - 1).bit_length() if n else 1), MOST_BITS)

        def run(batches):
            for b in batches:
                cols = [np.asarray(c, np.int64).view(np.uint64) for c in b.columns[1:]]
                key = cols[0] if len(cols) == 1 else _pair_key(*cols)
                kind = np.asarray(b.column(0), np.uint64)
                for probe in range(PROBES):
                    at = _bits(key, size, probe)
                    place = kind * np.uint64(size >> 6) + (at >> np.uint64(6))
                    order = np.argsort(place)
                    place, bit = place[order], np.uint64(1) << (at[order] & np.uint64(63))
                    if len(place):
                        new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                        yield pa.RecordBatch.from_arrays([_signed(place[new]), _signed(np.bitwise_or.reduceat(bit, new))], ["place", "bits"])

        got = df.mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(kinds * (size >> 6), np.uint64)
        table[np.asarray(got.column("place"))] = np.asarray(got.column("bits")).view(np.uint64)
        self.spread = df.sparkSession.sparkContext.broadcast(table)

    def test(self) -> Callable[[int, np.ndarray], np.ndarray]:
        """In a task: what says of keys whether they may be of a kind."""
        spread, size = self.spread, self.size

        def has(kind: int, key: np.ndarray) -> np.ndarray:
            table, live = spread.value, np.arange(len(key))
            for probe in range(PROBES):
                at = _bits(key[live], size, probe)
                live = live[(table[(at >> np.uint64(6)) + np.uint64(kind * (size >> 6))] >> (at & np.uint64(63))) & np.uint64(1) == 1]
            out = np.zeros(len(key), bool)
            out[live] = True
            return out

        return has

    def drop(self) -> None:
        self.spread.destroy()


def _counted(parts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct tuples of keys, their counts), exactly."""
    place, names = np.zeros(len(parts[0]), np.int64), []
    for x in parts:
        u, inv = np.unique(x, return_inverse=True)
        # places stay below the number of rows squared
        _, place = np.unique(place * len(u) + inv, return_inverse=True)
        names.append(x)
    _, first, n = np.unique(place, return_index=True, return_counts=True)
    return [x[first] for x in names], n


def _pair_counts(seed: int, has):
    def run(batches):
        for _, (keys, follows, *_rest) in _slices(batches, seed):
            often = has(0, keys)
            i = np.flatnonzero(follows[:-1] & often[:-1] & often[1:]) if len(keys) else np.zeros(0, int)
            if len(i):
                (a, b), n = _counted([keys[i], keys[i + 1]])
                yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.array(n)], ["h1", "h2", "n"])

    return run


def _triple_counts(seed: int, has):
    def run(batches):
        for _, (keys, follows, *_rest) in _slices(batches, seed):
            i = np.flatnonzero(follows[:-2] & follows[1:-1]) if len(keys) > 2 else np.zeros(0, int)
            if not len(i):
                continue
            # a pair's key is looked up once, as a beginning, an end, and a pair whose own score counts
            pair = _pair_key(keys[:-1], keys[1:])
            starts, closes, scored = (has(k, pair) for k in range(3))
            i = i[(starts[i] & closes[i + 1]) | scored[i] | scored[i + 1]]
            if len(i):
                (a, b, c), n = _counted([keys[i], keys[i + 1], keys[i + 2]])
                yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), _signed(c), pa.array(n)], ["h1", "h2", "h3", "n"])

    return run


def score_of(a: str, left: str, right: str):
    """floor(1000000 a a / (left right)), exactly: products have up to 38 digits."""
    return F.expr(f"cast(1000000 as decimal(38,0)) * cast({a} as decimal(19,0)) * cast({a} as decimal(19,0)) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


#: steps of the thresholds: scores in buckets, this many each time they double
STEPS = 64


def _thresholds(scores: DataFrame, want: int, before: DataFrame | None) -> DataFrame:
    """lang, least: the score that `want` of a language's scores reach, 0 if they are fewer; under a quarter of `before`."""
    bucket = F.floor(F.log2(F.col("score") + 1) * STEPS).cast("long")
    # buckets, not rows, are summed up: at most 20 times STEPS of a language
    w = Window.partitionBy("lang").orderBy(F.desc("bucket"))
    h = scores.groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("above", F.sum("n").over(w))
    # the lowest score of a bucket, less one where rounding may have moved it
    least = F.greatest(F.floor(F.pow(F.lit(2.0), F.max(F.when(F.col("above") >= want, F.col("bucket"))) / STEPS) - 1) - 1, F.lit(0)).cast("long")
    got = h.groupBy("lang").agg(F.coalesce(least, F.lit(0).cast("long")).alias("least"))
    if before is None:
        return got
    return got.join(before.select("lang", F.floor(F.col("least") / 4).alias("quarter")), "lang").select("lang", F.least("least", "quarter").alias("least"))


def mine_collocations(docs: DataFrame, top: int = 2000, least: int = 10, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two or three words by score, then a
    descending, then the phrase's bytes.

    Words are `[^\\x20\\x09]+` of pieces between `[.,;:!?\\x0A-\\x0D]`, A-Z lower-cased; candidates occur `least` times.
    score is the floor of a million times a * a / (l * r) at the phrase's worst cut, a, l and r being the counts of the
    phrase and its two parts; n counts the language's words. A pair goes if a triple that is a candidate holds it and has
    `share` percent of its occurrences or more. Null languages count as 'und', null and empty texts have no words,
    repeated rows count each, an empty table gives none; doc_ids and other columns aren't read."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        for seed in range(8):
            vocabulary = scratch.table(docs.mapInArrow(_word_counts(seed), "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n")), "words")
            if vocabulary.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").limit(1).count() == 0:
                break
        else:
            raise RuntimeError("words share their keys under every seed")
        often = scratch.table(vocabulary.where(F.col("n") >= least), "often")
        total = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))

        frequent = Filters(often.select(F.lit(0).alias("kind"), "h"), 1, often.count())
        pairs = docs.mapInArrow(_pair_counts(seed, frequent.test()), "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        word = lambda i: often.select(F.col("h").alias(f"h{i}"), F.col("n").alias(f"f{i}"), *(["lang"] if i == 1 else []))
        pairs = scratch.table(pairs.join(word(1), "h1").join(word(2), "h2").withColumn("score", score_of("a", "f1", "f2")), "pairs")
        frequent.drop()

        settled, before, want = [], None, 2 * top
        while True:
            open_ = pairs if before is None else pairs.join(before.select("lang"), "lang", "left_semi")
            reach = scratch.table(_thresholds(open_.select("lang", "score"), want, before), "reach")
            grown = _grown(scratch, docs, pairs, reach, seed, least, share)
            count = grown.groupBy("lang").agg(F.count("*").alias("k"))
            state = scratch.table(reach.join(count, "lang", "left").select("lang", "least", ((F.coalesce("k", F.lit(0)) >= top) | (F.col("least") == 0)).alias("done")), "state")
            settled.append(grown.join(state.where("done"), "lang", "left_semi"))
            before = state.where("not done").select("lang", "least")
            if before.limit(1).count() == 0:
                break
            want *= 4
        found = settled[0]
        for more in settled[1:]:
            found = found.unionByName(more)
        named = found
        for i in (1, 2, 3):
            named = named.join(often.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}")), f"h{i}", "left")
        named = named.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
        order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
        # best of salted parts first, so that no task sorts a language
        salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        best = named.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return materialise(best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "collocations")


def _grown(scratch: Scratch, docs: DataFrame, pairs: DataFrame, reach: DataFrame, seed: int, least: int, share: int) -> DataFrame:
    """lang, h1, h2, h3, a, l, r, score of all surviving phrases of these languages whose score reaches their threshold."""
    held = pairs.join(reach, "lang")
    bound = lambda f: F.expr(f"cast(1000000 as decimal(38,0)) * a div {f}") >= F.col("least")
    kinds = F.array_compact(F.array(F.when(bound("f1"), F.lit(0)), F.when(bound("f2"), F.lit(1)), F.when(F.col("score") >= F.col("least"), F.lit(2))))
    keys = held.select(F.explode(kinds).alias("kind"), "h1", "h2")
    filters = Filters(keys, 3, held.count())
    triples = docs.mapInArrow(_triple_counts(seed, filters.test()), "h1 long, h2 long, h3 long, n long").groupBy("h1", "h2", "h3").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    first = held.select("lang", "least", "h1", "h2", "f1", F.col("a").alias("f12"))
    second = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
    triples = scratch.table(triples.join(first, ["h1", "h2"]).join(second, ["h2", "h3"]), "triples")
    filters.drop()
    scored = triples.withColumn("s1", score_of("a", "f1", "f23")).withColumn("s2", score_of("a", "f12", "f3"))
    early = F.col("s1") <= F.col("s2")
    three = scored.select("lang", "least", "h1", "h2", "h3", "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score")).where(F.col("score") >= F.col("least"))
    inside = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a")).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    two = held.where(F.col("score") >= F.col("least")).join(inside, ["h1", "h2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    two = two.select("lang", "h1", "h2", F.lit(None).cast("long").alias("h3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    return scratch.table(two.unionByName(three.drop("least")), "survivors")
