"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it.

The models are fitted on a bounded sample of labelled documents; the probabilities that a later model is trained with
are out of fold, so that they look like those it meets on new documents. Features are words (present or not) chosen by
a chi-square test on the training part alone, and a few figures of the text's shape. Words are counted and chosen in
Spark; only the chosen ones of the sample's rows come to the driver. Every document is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_text, materialise, rows_where, shingle_hashes, text_buffers, text_slices, word_hashes

#: labelled documents in the sample at most; words chosen per category at most; folds; ridge penalty
MAX_TRAIN, MAX_WORDS, FOLDS, RIDGE = 12_000, 256, 4, 2.0
SHAPE = 6


def shape_features(col: pa.Array, words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[rows, SHAPE]: log words, log characters a word, shares of upper case, digits and punctuation, share of distinct words."""
    data, at = text_buffers(col)
    total = np.maximum(np.diff(at), 1).astype(float)

    def share(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[at]) / total

    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, row))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][fresh], minlength=len(n)) / np.maximum(n, 1)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    punct = (data > 32) & (data < 127) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
    return np.stack([np.log1p(n), np.log1p(total / np.maximum(n, 1)), share(upper), share(digit), share(punct), distinct], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept, which isn't penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        # damped: separable words would overshoot
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Link:
    """One category's model: its words, and weights of words, shape, earlier categories and intercept."""

    words: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def scores(self, row: np.ndarray, word: np.ndarray, dense: np.ndarray) -> np.ndarray:
        n = len(dense)
        if self.constant is not None:
            return np.full(n, self.constant)
        z = dense @ self.weights[len(self.words) : -1] + self.weights[-1]
        if len(self.words) and len(word):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = self.words[at] == word
            pair = np.unique(row[hit] * len(self.words) + at[hit])
            z += np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(row: np.ndarray, word: np.ndarray, dense: np.ndarray, y: np.ndarray, words: np.ndarray) -> Link:
    if y.sum() < 2 or (1 - y).sum() < 2:
        return Link(np.zeros(0, np.uint64), np.zeros(0), float(y.mean()) if len(y) else 0.0)
    x = np.zeros((len(y), len(words) + dense.shape[1]))
    if len(words):
        at = np.minimum(np.searchsorted(words, word), len(words) - 1)
        hit = words[at] == word
        x[row[hit], at[hit]] = 1
    x[:, len(words) :] = dense
    return Link(words, _logistic(x, y))


@dataclass
class Chain:
    categories: list[str]
    links: list[Link]
    centre: np.ndarray
    scale: np.ndarray

    def dense(self, shape: np.ndarray) -> np.ndarray:
        return np.clip((shape - self.centre) / self.scale, -4, 4)

    def predict(self, row: np.ndarray, word: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """[rows, categories] probabilities, each fed with those before it."""
        seen = self.dense(shape)
        out = []
        for link in self.links:
            out.append(link.scores(row, word, seen))
            seen = np.hstack([seen, out[-1][:, None]])
        return np.stack(out, axis=1)


def fit_chain(categories: list[str], row: np.ndarray, words: np.ndarray, shape: np.ndarray, y: np.ndarray, fold: np.ndarray, chosen: dict[tuple[int, int], np.ndarray]) -> Chain:
    """words: distinct chosen hashes, each with its row; y: [rows, categories] of 0 and 1; fold: of each row; chosen: sorted
    words of each category and held-out fold, -1 for none held out."""
    centre = shape.mean(axis=0) if len(shape) else np.zeros(SHAPE)
    scale = np.where(shape.std(axis=0) > 1e-9, shape.std(axis=0), 1.0) if len(shape) else np.ones(SHAPE)
    chain = Chain(categories, [], centre, scale)
    none = np.zeros(0, np.uint64)
    seen = chain.dense(shape) if len(shape) else shape.reshape(0, SHAPE)
    for j in range(len(categories)):
        target = y[:, j].astype(float)
        oof = np.zeros(len(target))
        for k in np.unique(fold):
            inside = fold != k
            number = np.cumsum(inside) - 1
            on = inside[row]
            part = _fit(number[row[on]], words[on], seen[inside], target[inside], chosen.get((j, int(k)), none))
            on = ~inside[row]
            oof[~inside] = part.scores((np.cumsum(~inside) - 1)[row[on]], words[on], seen[~inside])
        chain.links.append(_fit(row, words, seen, target, chosen.get((j, -1), none)))
        seen = np.hstack([seen, oof[:, None]])
    return chain


def choose_words(sample: DataFrame, categories: int, most: int = MAX_WORDS) -> DataFrame:
    """category, fold, word: the words of sample(words, fold, y0, y1, ...) that tell a category, learned without that fold (-1: with all).

    A word counts that is in 5 rows at least and whose presence depends on the category by chi-square over 15; of
    these the strongest `most`. Words are counted once, by fold and category; the rest works on the counts."""
    ys = [f"y{j}" for j in range(categories)]
    each = sample.select(F.explode("words").alias("word"), "fold", *ys).groupBy("word", "fold").agg(F.count("*").alias("df"), *(F.sum(y).alias(y) for y in ys))
    size = sample.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(y).alias(f"n{y}") for y in ys))
    folds = F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1))).alias("held")
    without = lambda t: t.select("*", folds).where("held != fold")
    words = without(each).groupBy("word", "held").agg(F.sum("df").alias("df"), *(F.sum(y).alias(y) for y in ys)).where("df >= 5")
    sizes = without(size).groupBy("held").agg(F.sum("n").alias("n"), *(F.sum(f"n{y}").alias(f"n{y}") for y in ys))  # one row a fold
    found = words.join(F.broadcast(sizes), "held")
    cells = F.explode(F.array(*(F.struct(F.lit(j).alias("category"), F.col(y).alias("pos"), F.col(f"n{y}").alias("of")) for j, y in enumerate(ys))))
    found = found.select("word", "held", "df", "n", cells.alias("c")).select("word", "held", "df", "n", "c.*")
    p = F.col("of") / F.col("n")
    chi = (F.col("pos") - F.col("df") * p) * (F.col("pos") - F.col("df") * p) / (F.col("df") * (1 - F.col("df") / F.col("n")) * p * (1 - p))
    found = found.where((F.col("df") < F.col("n")) & (F.col("of") > 0) & (F.col("of") < F.col("n"))).withColumn("chi", chi).where("chi > 15")
    order = Window.partitionBy("category", "held").orderBy(F.col("chi").desc(), "word")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("category", F.col("held").alias("fold"), "word")


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_train: int = MAX_TRAIN) -> Chain:
    """Fits the chain on at most max_train labelled documents, those with the least hash of their id.

    Texts with the same least 5-word shingle hash count once, so that a group of copies doesn't outweigh the rest, and
    folds are made of those hashes. Null labels count as 0; several labels of one id: the largest. To the driver come
    at most MAX_WORDS words for each category and fold, and of each row those of these words that it has."""
    ys = [f"y{i}" for i in range(len(categories))]
    marks = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(c.cast("int"), F.lit(0)).alias(y) for c, y in zip(categories.values(), ys, strict=True)))
    marks = marks.groupBy("doc_id").agg(*(F.max(y).alias(y) for y in ys))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # at most max_train rows
    rows = ids_text(docs).join(F.broadcast(sample), "doc_id")

    def run(batches):
        for whole in batches:
            for b in text_slices(whole):
                col = b.column("text")
                words, off = word_hashes(col, punctuation=True)
                shape = shape_features(col, words, off)
                least = np.zeros(len(off) - 1, np.uint64)
                sh, so = shingle_hashes(words, off, 5)
                some = np.diff(so) > 0
                if some.any():
                    least[some] = np.minimum.reduceat(sh, so[:-1][some])
                each = [np.unique(words[x:y]).view(np.int64) for x, y in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(each, pa.list_(pa.int64())), pa.array(list(shape), pa.list_(pa.float64())), pa.array(least.view(np.int64)), *(b.column(y) for y in ys)], ["doc_id", "words", "shape", "least", *ys])

    made = rows.mapInArrow(run, "doc_id long, words array<long>, shape array<double>, least long, " + ", ".join(f"{y} int" for y in ys))
    first = Window.partitionBy("least").orderBy("doc_id", F.xxhash64("words"))
    made = made.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("fold", F.pmod("least", F.lit(FOLDS)).cast("int")).drop("n")
    made = materialise(made, "sample")
    wanted = choose_words(made, len(ys)).collect()
    chosen = {}
    for r in wanted:
        chosen.setdefault((r["category"], r["fold"]), []).append(r["word"])
    chosen = {k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in chosen.items()}
    every = docs.sparkSession.createDataFrame([(w,) for w in sorted({r["word"] for r in wanted})], "word long")
    held = made.select("least", F.explode("words").alias("word")).join(F.broadcast(every), "word").groupBy("least").agg(F.collect_list("word").alias("held"))
    got = made.drop("words").join(held, "least", "left").orderBy("doc_id", "least").collect()
    parts = [np.array(r["held"] or [], np.int64) for r in got]
    row = np.repeat(np.arange(len(got)), [len(x) for x in parts])
    words = np.concatenate([np.zeros(0, np.int64), *parts]).view(np.uint64)
    shape = np.array([r["shape"] for r in got], float).reshape(len(got), SHAPE)
    y = np.array([[r[c] for c in ys] for r in got], np.int64).reshape(len(got), len(ys))
    return fit_chain(list(categories), row, words, shape, y, np.array([r["fold"] for r in got], np.int64), chosen)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> of every whole document; null or empty text is scored by its shape alone."""
    spread = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        c = spread.value
        for whole in batches:
            for b in text_slices(whole):
                p = _scored(c, b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, j]) for j in range(p.shape[1]))], ["doc_id", *names])

    return ids_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs without the rows that toxicity() rejects; every column stays, whatever its name.

    Rows are judged each by its own text in the pass that scores them, so nothing is shuffled; null and empty texts are
    judged by their shape; an empty table gives an empty one."""
    chain = train(docs, labels, default_categories(), max_train)
    spread = docs.sparkSession.sparkContext.broadcast(chain)
    at = chain.categories.index("toxic")

    return rows_where(docs, lambda col: _scored(spread.value, col)[:, at] < threshold)


def _scored(chain: Chain, col: pa.Array) -> np.ndarray:
    words, off = word_hashes(col, punctuation=True)
    return chain.predict(np.repeat(np.arange(len(off) - 1), np.diff(off)), words, shape_features(col, words, off))


def default_categories() -> dict[str, Column]:
    """In chain order: poor quality, toxic, both."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "toxic_and_poor": (F.col("toxic") == 1) & (F.col("quality") == 0)}


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """documents(doc_id, text, ...) and labels(doc_id, quality, toxic) -> doc_id, p_low_quality, p_toxic, p_toxic_and_poor, rejected.

    rejected: p_toxic >= threshold. Empty or one-sided labels make a category's probability its share among them, 0
    without any. Rows that repeat are scored each; an empty table gives an empty result; a null doc_id stays null and
    is never a training row; other columns are ignored, whatever their names."""
    chain = train(docs, labels, default_categories(), max_train)
    return score(docs, chain).withColumn("rejected", F.col("p_toxic") >= F.lit(threshold))
