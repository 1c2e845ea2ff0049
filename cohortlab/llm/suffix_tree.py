"""Language-model scores by a probabilistic suffix tree over words.

Symbols are words and one end per document. Contexts of one to DEPTH words are candidates if they occur at least `floor`
times in the training documents, whatever the corpus's size; a candidate becomes a state if its next-symbol distribution
diverges from its suffix's. Next symbols are kept with a state if they follow it at least floor times, discounted, and
the rest of the state's mass goes to the next shorter state, down to the smoothed unigram distribution. A token is
scored by the longest states that end right before it.

The tree is never gathered: its contexts are dealt into buckets by 64-bit keys. Documents travel as chunks: a dictionary
of word hashes and local word numbers. Level after level a chunk sends each bucket its distinct contexts and next
symbols, as packed arrays; the bucket adds all chunks' counts up, settles its contexts and answers each chunk.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  binds pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_text, let_go, materialise, mix64, seeds64, shared_path, word_hashes

#: words in a chunk, about; training tokens of a bucket
CHUNK_WORDS, DEPTH, BUCKET_TOKENS = 3 << 18, 3, 4_000_000
DISCOUNT = 0.5
#: bytes of a gram's key that tell it from the others of its context
ID_BYTES = 5
#: a context that occurs more often is dealt into slices of about so many occurrences
HOT = 200_000
END = seeds64(1, 97)[0]
_TWENTY = np.int64(20)


_STEP = seeds64(1, 98)[0] | np.uint64(1)


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpack(x: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), dtype)


def _planes(x: np.ndarray) -> bytes:
    """Numbers under 2**32, the bytes of each weight together."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unplane(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


def _narrow(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widen(x: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _sorted_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys by their differences, the bytes of each weight together."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _keys_of(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T.copy().view("<u8").reshape(-1), dtype=np.uint64)


#: steps of a probability's logarithm in _short()
_FINE = 2400


def _short(p: np.ndarray) -> bytes:
    """Probabilities in two bytes, to a share of 2e-4; only the divergence test reads them."""
    return np.clip(np.round(-np.log(p) * _FINE), 0, 65_535).astype("<u2").tobytes()


def _short_of(x: bytes) -> np.ndarray:
    return np.exp(np.frombuffer(x, "<u2") / -_FINE)


def _floats(x: np.ndarray) -> bytes:
    return _planes(x.astype("<f4").view("<u4"))


def _floats_of(x: bytes) -> np.ndarray:
    return _unplane(x).view("<f4").astype(float)


def held_out(doc_ids: list[int | None]) -> np.ndarray:
    """crc32 of the id as text, modulo 10, is 0; a null id counts as the text 'null'."""
    return np.array([zlib.crc32(str(d if d is not None else "null").encode()) % 10 == 0 for d in doc_ids], dtype=bool)


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, doc_ids, sizes (tokens with the end), words (sorted hashes, packed), counts (in training documents), ranks (numbers of the words from the most frequent on), tokens (ranks: small numbers take little room)."""
    form = pa.schema([("chunk", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("counts", pa.binary()), ("ranks", pa.binary()), ("tokens", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids: list = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def chunk():
            size = np.concatenate(sizes)
            words, local = np.unique(np.concatenate(hashes), return_inverse=True)
            train = np.repeat(~held_out(ids), size)
            counts = np.bincount(local[train], minlength=len(words))
            ranks = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[ranks] = np.arange(len(words))
            return pa.RecordBatch.from_pydict({"chunk": [f"{part}-{n}"], "doc_ids": [ids], "sizes": [size], "words": [_sorted_keys(words)], "counts": [_pack(counts.astype("<u4"))], "ranks": [_planes(ranks)], "tokens": [_planes(rank[local])]}, schema=form)

        for whole in batches:
            col = whole.column("text")
            ends = np.cumsum(np.asarray(pa.compute.binary_length(col).fill_null(0)))
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
                h, off = word_hashes(col.slice(at, to - at))
                size = np.diff(off)
                hashes.append(np.insert(h, off[1:], END))
                sizes.append(size + 1)
                ids += whole.column("doc_id").slice(at, to - at).to_pylist()
                held += len(h) + len(size)
                at = to
                if held >= CHUNK_WORDS:
                    yield chunk()
                    n, held, ids, hashes, sizes = n + 1, 0, [], [], []
        if ids:
            yield chunk()

    # a bucketed table: answers are dealt to the chunks, and the chunks never again
    made = ids_text(docs).mapInArrow(run, "chunk string, doc_ids array<long>, sizes array<long>, words binary, counts binary, ranks binary, tokens binary")
    spark, name = docs.sparkSession, f"chunks_{uuid.uuid4().hex}"
    made.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").option("path", shared_path(spark, "chunks")).saveAsTable(name)
    return spark.table(name)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    uniq, inv = np.unique(k, return_inverse=True)
    return uniq, np.bincount(inv, weights=c, minlength=len(uniq)).astype(np.int64)


def _bucket_count(df: DataFrame, tokens: int) -> int:
    """Buckets of about BUCKET_TOKENS counted tokens at most, as one is worked on in the memory of a task."""
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))


def _cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets begin in sorted keys: a bucket is a range of them."""
    cut = np.searchsorted(keys >> np.uint64(32), (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets))
    cut[-1] = len(keys)
    return cut


def global_counts(held: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, counts: how often a chunk's words occur in the whole training corpus; v: see below.

    Every chunk sends a bucket its words and counts; a bucket adds them up and answers each chunk. One row of a bucket
    also has v, its distinct training words."""

    def send(batches):
        for b in batches:
            for r in b.to_pylist():
                words, counts = _keys_of(r["words"]), _unpack(r["counts"], "<u4")
                cut = _cut(words, buckets)
                on = np.flatnonzero(np.diff(cut))
                parts = [slice(cut[k], cut[k + 1]) for k in on]
                yield pa.RecordBatch.from_pydict({"chunk": [r["chunk"]] * len(on), "bucket": pa.array(on, pa.int32()), "words": pa.array([words[x].tobytes() for x in parts], pa.binary()), "counts": pa.array([counts[x].tobytes() for x in parts], pa.binary())})

    def add(key, pdf):
        import pandas as pd

        words, counts = [np.frombuffer(w, "<u8") for w in pdf["words"]], [np.frombuffer(c, "<u4") for c in pdf["counts"]]
        uniq, total = _merge(words, counts)
        back = [_pack(total[np.searchsorted(uniq, w)].astype("<i8")) for w in words]
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "counts": back, "v": [int((total > 0).sum())] + [0] * (len(pdf) - 1)})

    sent = held.select("chunk", "words", "counts").mapInArrow(send, "chunk string, bucket int, words binary, counts binary")
    return materialise(sent.groupBy("bucket").applyInPandas(add, "chunk string, bucket int, counts binary, v long"), "counts")


def training_tokens(held: DataFrame) -> int:
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pydict({"n": [int(np.array(r["sizes"], np.int64)[~held_out(r["doc_ids"])].sum())]})

    return int(held.select("doc_ids", "sizes").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)


class Tree:
    """The same model in the memory of one process, for small trees and to compare with. Level d (from 0) holds frequent (d+1)-grams: keys sorted, counts; level 0's key is the word.

    A level's key joins the number of the gram's first d words in level d-1 with the last word's number in level 0."""

    def __init__(self, n: int, v: int, words: np.ndarray, counts: np.ndarray):
        self.n, self.v = n, v
        self.keys, self.counts = [words], [counts]
        self.share: list[np.ndarray] = []  # kept share of each gram as a next symbol of its context
        self.rest: list[np.ndarray] = []  # mass that a context leaves to its suffix
        self.state: list[np.ndarray] = []  # contexts that passed the divergence test

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.n + 0.1 * (self.v + 1))

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Positions in sorted keys, -1 where absent or where the wanted key is negative."""
        if not len(keys):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def walk(self, first: np.ndarray, starts: np.ndarray, depth: int) -> list[np.ndarray]:
        """For each token the numbers of the grams of 1, 2, ... depth + 1 words that end with it, or -1; none crosses a document."""
        out = [first]
        begin = np.zeros(len(first), bool)
        begin[starts] = True
        for d in range(1, min(depth + 1, len(self.keys))):
            before = np.full(len(first), -1, np.int64)
            before[1:] = out[-1][:-1]
            before[begin] = -1
            key = np.where((before >= 0) & (first >= 0), (before << _TWENTY) | first, -1)
            got = np.full(len(first), -1, np.int64)
            some = np.flatnonzero(key >= 0)
            got[some] = self.find(self.keys[d], key[some])
            out.append(got)
        return out

    def suffix(self, d: int) -> np.ndarray:
        """For each gram of level d its number without the first word, in level d - 1."""
        ctx, word = self.keys[d] >> _TWENTY, self.keys[d] & ((1 << 20) - 1)
        if d == 1:
            return word
        return self.find(self.keys[d - 1], (self.suffix(d - 1)[ctx] << _TWENTY) | word)

    def settle(self, base: np.ndarray, least: float) -> None:
        """Fills share, rest and state from the counts; base: the unigram probabilities of level 0.

        full[d] is the probability that states of up to d words give to the last word of each gram of level d. A context
        of d words is a state if sum of c * log(p / p given by its suffix) is at least `least`, over its kept symbols
        and the loose rest. A kept gram's suffix is at least as frequent, so it is kept too and always found."""
        full = base
        for d in range(1, len(self.keys)):
            ctx, word, c = self.keys[d] >> _TWENTY, self.keys[d] & ((1 << 20) - 1), self.counts[d]
            total = self.counts[d - 1].astype(float)
            share = np.maximum(c - DISCOUNT, 0) / total[ctx]
            rest = np.clip(1 - np.bincount(ctx, share, len(total)), 1e-12, 1)
            back = full[self.suffix(d)]
            p = share + rest[ctx] * back
            loose = np.maximum(total - np.bincount(ctx, c, len(total)), 0)
            gain = np.bincount(ctx, c * np.log(p / back), len(total)) + loose * np.log(rest)
            self.state.append((np.bincount(ctx, minlength=len(total)) > 0) & (gain >= least))
            self.share.append(share)
            self.rest.append(rest)
            full = np.where(self.state[-1][ctx], p, back)

    def log10(self, first: np.ndarray, p0: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of every token; p0: unigram probabilities."""
        grams = self.walk(first, starts, len(self.share))
        begin = np.zeros(len(first), bool)
        begin[starts] = True
        p = p0.copy()
        for d in range(1, len(self.share) + 1):
            ctx = np.full(len(first), -1, np.int64)
            ctx[1:] = grams[d - 1][:-1]
            ctx[begin] = -1
            if not len(self.share[d - 1]):
                break
            on = np.flatnonzero((ctx >= 0) & self.state[d - 1][np.maximum(ctx, 0)])
            g = grams[d][on]
            own = np.where(g >= 0, self.share[d - 1][np.maximum(g, 0)], 0.0)
            p[on] = own + self.rest[d - 1][ctx[on]] * p[on]
        return np.log10(p)


class Ask:
    """What a chunk asks the buckets about the contexts of d words, and where its tokens find the answers.

    on: tokens after a context that occurs floor times; ctx: sorted keys of the contexts, of slices where one is hot;
    at: a token's context; real: the context's own key if ctx is a slice, else 0; known: tokens whose shorter gram is
    kept, as only these can be kept; gram: their place in ids. All other occurrences are added up in loose."""

    def __init__(self, on, own, total, key, known, train, p, hot):
        self.on, self.own, self.total = on, own, total
        slices = (total + hot - 1) // hot
        self.hot = slices > 1
        virtual = np.where(self.hot, mix64(own + (key >> np.uint64(20)) % np.maximum(slices, 1).astype(np.uint64) + np.uint64(1)), own)
        self.ctx, self.at, rep = _group(virtual)
        self.real = np.where(self.hot[rep], own[rep], np.uint64(0))
        self.known = np.flatnonzero(known)
        bits = np.uint64(max(1, len(self.ctx).bit_length()))
        at, k = self.at[self.known], key[self.known]
        _, self.gram, rep = _group((at.astype(np.uint64) << (np.uint64(64) - bits)) | (k >> bits))
        self.ids, self.p = k[rep], p[self.known][rep]
        self.counts = np.bincount(self.gram, train[self.known], len(rep)).astype("<u4")
        self.each = np.bincount(at[rep], minlength=len(self.ctx)).astype("<u4")
        self.loose = np.bincount(self.at, train * ~known, len(self.ctx)).astype("<u4")

    def rows(self, chunk: str, buckets: int) -> pa.RecordBatch:
        cut = _cut(self.ctx, buckets)
        some = np.flatnonzero(np.diff(cut))
        ends = np.concatenate([[0], np.cumsum(self.each, dtype=np.int64)])
        cols: dict[str, list] = {k: [] for k in ("ctx", "real", "each", "loose", "ids", "counts", "p")}
        for k in some:
            c = slice(cut[k], cut[k + 1])
            g = slice(ends[cut[k]], ends[cut[k + 1]])
            cols["ctx"].append(_sorted_keys(self.ctx[c]))
            cols["real"].append(_pack(self.real[c]))
            cols["each"].append(_planes(self.each[c]))
            cols["loose"].append(_planes(self.loose[c]))
            cols["ids"].append(_narrow(self.ids[g], ID_BYTES))
            cols["counts"].append(_planes(self.counts[g]))
            cols["p"].append(_short(self.p[g]))
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(some), pa.string()), "bucket": pa.array(some, pa.int32())} | {k: pa.array(x, pa.binary()) for k, x in cols.items()})


def _group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted; each row's place in them; a row of each."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return ranked[fresh], at, order[fresh]


def settled(at: np.ndarray, c: np.ndarray, p: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """For each context: the mass it leaves to its suffix if it is a state, 0 if it is none, -1 if it keeps no symbol.

    at, c, p: context, count and shorter states' probability of each kept symbol. A context is a state if the sum of
    c * log(p / p given by its suffix) is at least `least`, over its kept symbols and the loose rest."""
    n = len(total)
    share = (c - DISCOUNT) / total[at]
    rest = np.clip(1 - np.bincount(at, share, n), 1e-12, 1)
    gain = np.bincount(at, c * np.log((share + rest[at] * p) / p), n) + (total - np.bincount(at, c, n)) * np.log(rest)
    return np.where(np.bincount(at, minlength=n) == 0, -1.0, np.where(gain >= least, rest, 0.0))


class Scorer:
    """Goes through a chunk level by level as far as there are answers. hot: per level the keys of hot contexts, sorted, and
    what settled() gave for them."""

    def __init__(self, n: int, v: int, floor: int, hot_size: int):
        self.n, self.v, self.floor, self.hot_size = n, v, floor, hot_size
        self.hot: list[tuple[np.ndarray, np.ndarray]] = []

    def load(self, r: dict) -> None:
        words, local = _keys_of(r["words"]), _unplane(r["ranks"])[_unplane(r["tokens"])]
        self.size = np.array(r["sizes"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.answers: list[list[dict]] = [[] for _ in range(len(self.hot) + 1)]
        for a in r["got"]:
            self.answers[a["level"]].append(a)
        self.words = words[local]
        self.count = np.concatenate([_unpack(a["counts"], "<i8") for a in self.answers[0]])[local]
        self.base = (self.count + 0.1) / (self.n + 0.1 * (self.v + 1))
        self.place = (np.arange(len(local)) - np.repeat(self.starts, self.size)).astype(np.int32)
        self.train = np.repeat(~held_out(r["doc_ids"]), self.size)

    def run(self, more: bool) -> Ask | np.ndarray:
        """What to ask next if there is more, else the probability of every token."""
        gram, seen, p = self.words, self.count, self.base.copy()
        awake = np.ones(len(p), bool)
        for d in range(1, len(self.hot) + 1 + more):
            after = np.zeros(len(p), bool)
            after[1:] = seen[:-1] >= self.floor
            on = np.flatnonzero(awake & after & (self.place >= d))
            own, total, known = gram[on - 1], seen[on - 1], seen[on] >= self.floor
            with np.errstate(over="ignore"):
                key = mix64(own * _STEP + self.words[on])
                ask = Ask(on, own, total, key, known, self.train[on], p[on], self.hot_size)
            if d > len(self.hot):
                return ask
            got = self.answers[d]
            rest = np.concatenate([np.zeros(0), *(_floats_of(a["rest"]) for a in got)])[ask.at]
            if ask.hot.any():
                keys, value = self.hot[d - 1]
                rest[ask.hot] = value[np.searchsorted(keys, own[ask.hot])]
            c = np.zeros(len(on), np.int64)
            c[ask.known] = np.concatenate([np.zeros(0, np.int64), *(_unplane(a["counts"]) for a in got)])[ask.gram]
            state = rest > 0
            share = np.maximum(c - DISCOUNT, 0) / total
            p[on[state]] = share[state] + rest[state] * p[on[state]]
            gram, seen, awake = np.zeros(len(p), np.uint64), np.zeros(len(p), np.int64), np.zeros(len(p), bool)
            gram[on], seen[on], awake[on] = key, c, rest >= 0
        return p


def _settle_level(asked: DataFrame, floor: int, least: float, level: int) -> DataFrame:
    """The buckets' answers: chunk, bucket, rest (of each context it sent), counts (of each gram, 0 under the floor).

    Rows without a chunk are slices of hot contexts: real, total, and counts and p of the kept symbols."""

    def add(pdf):
        import pandas as pd

        ctx = [_keys_of(x) for x in pdf["ctx"]]
        each, loose = np.concatenate([_unplane(x) for x in pdf["each"]]), np.concatenate([_unplane(x) for x in pdf["loose"]])
        ids, n, p = np.concatenate([_widen(x, ID_BYTES) for x in pdf["ids"]]), np.concatenate([_unplane(x) for x in pdf["counts"]]), np.concatenate([_short_of(x) for x in pdf["p"]])
        everything = np.concatenate(ctx)
        keys, at, rep = _group(everything)
        real = np.concatenate([_unpack(x, "<u8") for x in pdf["real"]])[rep]
        row = np.repeat(np.arange(len(everything)), each)
        _, gram, first = _group(mix64(everything[row] + ids * _STEP))
        where = at[row[first]]
        c = np.bincount(gram, n, len(first)).astype(np.int64)
        total = np.bincount(where, c, len(keys)) + np.bincount(at, loose, len(keys))
        keep = c >= floor
        c, where, p = np.where(keep, c, 0), where[keep], p[first[keep]]
        rest = settled(where, c[keep], p, np.maximum(total, 1), least)
        a, b = np.cumsum([0, *(len(x) for x in ctx)]), np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        back = rest[at]
        out = [(x, k, _floats(back[a[i] : a[i + 1]]), _planes(c[gram[b[a[i]] : b[a[i + 1]]]]), None, None, None) for i, (x, k) in enumerate(zip(pdf["chunk"], pdf["bucket"], strict=True))]
        for i in np.flatnonzero(real):
            mine = where == i
            out.append((None, None, None, _pack(c[keep][mine].astype("<i8")), real[i].astype("<u8").tobytes(), _pack(total[i : i + 1].astype("<i8")), _pack(p[mine])))
        return pd.DataFrame(out, columns=["chunk", "bucket", "rest", "counts", "real", "total", "p"]).astype({"bucket": "Int32"})

    return materialise(asked.groupBy("bucket").applyInPandas(add, "chunk string, bucket int, rest binary, counts binary, real binary, total binary, p binary"), f"level-{level}")


def _hot_contexts(answers: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys and settled() of the hot contexts, from all their slices; there are n / HOT of them at most."""

    def finish(key, pdf):
        import pandas as pd

        c, p = np.concatenate([_unpack(x, "<i8") for x in pdf["counts"]]), np.concatenate([_unpack(x, "<f8") for x in pdf["p"]])
        rest = settled(np.zeros(len(c), np.int64), c, p, np.array([max(1, sum(int(_unpack(x, "<i8")[0]) for x in pdf["total"]))]), least)
        return pd.DataFrame({"real": [key[0]], "rest": rest})

    rows = answers.where("chunk is null").groupBy("real").applyInPandas(finish, "real binary, rest double").collect()
    keys = np.frombuffer(b"".join(r["real"] for r in rows), "<u8")
    order = np.argsort(keys)
    return keys[order], np.array([r["rest"] for r in rows], float)[order]


def suffix_tree_scores(docs: DataFrame, floor: int = 2, depth: int = DEPTH, least: float = 10.0, hot: int = HOT) -> DataFrame:
    """Scores documents(doc_id, text, ...) by a tree learned from those whose crc32(doc_id as text) mod 10 is not 0.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; scores are log10 probabilities of
    the whole text's lower-cased words and its end. Null or empty text: only the end. A null doc_id counts as the text
    'null' for the split and stays null. Rows that repeat count as often as they occur. An empty table gives an empty
    result; with no training document all counts are 0. Other columns are ignored, whatever their names."""
    if floor < 1:
        raise ValueError("floor must be at least 1")
    held = chunks(docs)
    context = held.sparkSession.sparkContext
    tokens = training_tokens(held)
    buckets = _bucket_count(held, tokens)
    words = global_counts(held, buckets)
    scorer = Scorer(tokens, int(words.agg(F.sum("v")).first()[0] or 0), floor, hot)
    got = words.select("chunk", F.lit(0).alias("level"), "bucket", F.lit(None).cast("binary").alias("rest"), "counts")

    def with_answers() -> DataFrame:
        let_go(held.sparkSession)
        answers = got.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("level", "bucket", "rest", "counts"))).alias("got"))
        return held.select("chunk", "doc_ids", "sizes", "words", "ranks", "tokens").join(answers, "chunk")

    for level in range(1, depth + 1):
        spread = context.broadcast(scorer)

        def ask(batches, spread=spread):
            s = spread.value
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    s.load(r)
                    yield s.run(True).rows(r["chunk"], buckets)

        asked = with_answers().mapInArrow(ask, "chunk string, bucket int, ctx binary, real binary, each binary, loose binary, ids binary, counts binary, p binary")
        answers = _settle_level(asked, floor, least, level)
        del asked
        scorer.hot.append(_hot_contexts(answers, least))
        got = got.unionByName(answers.where("chunk is not null").select("chunk", F.lit(level).alias("level"), "bucket", "rest", "counts"))
    spread = context.broadcast(scorer)

    def score(batches):
        s = spread.value
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                s.load(r)
                own = np.log10(s.run(False))
                add = lambda x: np.add.reduceat(x, s.starts)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(held_out(r["doc_ids"])), pa.array(s.size), pa.array(add((s.count > 0).astype(np.int64))), pa.array(np.full(len(s.size), s.n)), pa.array(add(np.log10(s.base))), pa.array(add(own))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers().mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
