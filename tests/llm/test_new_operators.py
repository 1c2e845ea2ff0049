"""Shards, collocations and periodic runs against brute force, planted cases and odd inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import collocations, periodic_runs, queries, sharding

from test_operators import ODD, WORDS, D, frame, text


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


# --- periodic runs ----------------------------------------------------------------------------------------------------


def brute_runs(w, least=24, times=3):
    n, seen = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                seen.setdefault((start, i + q - start), q)
            i += 1
    return sorted(((s, length, q) for (s, length), q in seen.items()), key=lambda r: (r[0], r[2]))


def test_cover_has_every_difference():
    cover = periodic_runs.COVER.tolist()
    assert {(a - b) % periodic_runs.PERIOD for a in cover for b in cover} == set(range(periodic_runs.PERIOD))


def test_extensions_are_those_of_comparing():
    rng = random.Random(3)
    w = [rng.randrange(2) for _ in range(300)]
    w[100:200] = w[:100]
    seq = np.array([*w, 2])
    lce = periodic_runs.Extensions(seq, 3)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(300), np.arange(300)))
    i, j = i[i != j], j[i != j]

    def brute(a, b):
        k = 0
        while seq[a + k : a + k + 1] == seq[b + k : b + k + 1] and max(a, b) + k < 300:
            k += 1
        return k

    assert lce(i, j).tolist() == [brute(a, b) for a, b in zip(i, j, strict=True)]


@pytest.mark.parametrize("block", [1 << 21, 7])
def test_runs_are_those_of_brute_force(monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for _ in range(120):
        n, k = rng.choice([0, 1, 23, 24, 25, 60, 150, 300]), rng.choice([1, 2, 3, 40])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3) if n > 10 else 0):
            p, a = rng.randrange(1, 1 + n // 3), rng.randrange(n)
            for i in range(a, rng.randrange(a, n) + 1):
                w[i] = w[a + (i - a) % p]
        rows.append(w)
    got = periodic_runs.find_runs([np.array(w, np.int64) for w in rows], 40)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(w) for w in rows]
    assert sum(map(len, got)) > 20


def test_query_of_runs_is_that_of_plain_python(spark, tmp_path):
    rng = random.Random(6)
    docs = [(i, text(rng, rng.randrange(0, 200)) if i % 3 else " ".join(rng.choices(["x", "Y"], k=90))) for i in range(150)] + [(900, None), (901, ""), (902, "\x1c one\x0btwo \x85"), (903, "a b c " * 40), (903, "a b c " * 40), (904, "w " * 4000)]
    frame(spark, docs).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in docs:
        w, h = (t or "").encode().split(), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and sum(r[1] for r in want) > 10


def test_runs_of_odd_rows(spark, odd):
    got = periodic_runs.periodic_runs(odd).collect()
    assert len(got) == len(ODD) and [tuple(x) for x in next(r.runs for r in got if r.doc_id == 5)] == [(0, 3000, 1)]
    assert next(r.collapsed for r in got if r.doc_id == 5) == "word" and periodic_runs.periodic_runs(odd.limit(0)).count() == 0
    assert periodic_runs.with_planted_periods(odd).count() == len(ODD)


# --- collocations -----------------------------------------------------------------------------------------------------


def brute_collocations(rows, top, least=10, share=50):
    import re

    out = []
    by_lang = defaultdict(list)
    for lang, t in rows:
        low = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            by_lang[lang or "und"].append([w for w in re.split(r"[\x20\x09]+", piece) if w])
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        held = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in held.items():
            if len(g) == 2 and any(len(o) == 3 and g in (o[:2], o[1:]) and 100 * c >= share * a for o, c in held.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))]
            s, _, left, right = min(cuts)
            found.append((-s, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrases(rng, n):
    fixed = ["new york city", "in the", "of the sea", "é à", "top-k set", "a b c d"]
    words = [rng.choice(WORDS[:40]) if rng.random() < 0.5 else rng.choice(fixed) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ", ", "\n"]) for w in words)


@pytest.mark.parametrize("top", [3, 20, 2000])
def test_collocations_are_those_of_counting(spark, top):
    rng = random.Random(4)
    rows = [(rng.choice(["en", "EN", None, "und"]), phrases(rng, rng.randrange(1, 120))) for _ in range(120)] + [("en", None), ("en", ""), ("xx", "too few here"), ("en", "Ab aB AB ab " * 30)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, h1 int, word string").repartition(3)
    assert sorted(map(tuple, collocations.mine_collocations(df, top).collect())) == brute_collocations(rows, top)


def test_collocations_lower_their_thresholds(spark):
    """Nearly all pairs go to triples that score no better, so that the first threshold leaves too few."""
    rng = random.Random(9)
    rows = []
    for _ in range(400):
        rows.append(("en", ". ".join(" ".join(rng.sample(WORDS[:7], 3)) if rng.random() < 0.6 else f"x{k} y{k} z{k}" for k in rng.choices(range(30), k=12))))
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.mine_collocations(df, 60).collect())) == brute_collocations(rows, 60)


def test_scores_are_exact(spark):
    a, left, right = 3_000_000_007, 4_000_000_007, 5_000_000_029
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations.score_of("a", "l", "r")).first()[0] == 1_000_000 * a * a // (left * right)


def test_collocations_of_odd_rows(spark, odd):
    assert [(r.phrase, r.a) for r in collocations.mine_collocations(odd).collect()] == [("word word word", 2998)]
    assert collocations.mine_collocations(odd.limit(0)).count() == 0


def test_shared_keys_are_noticed(spark, monkeypatch):
    df = spark.createDataFrame([("en", "a b " * 12)], "lang string, text string")
    plain, seen = collocations._words, []

    def narrow(col, langs, seed):
        keys, *rest = plain(col, langs, seed)
        return (keys * np.uint64(0) if seed == 0 else keys), *rest

    # in a task of this process: the counting function is called by hand
    monkeypatch.setattr(collocations, "_words", narrow)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["a b"])], ["lang", "text"])
    for seed in (0, 1):
        seen.append(len({h for b in collocations._word_counts(seed)([batch]) for h in b.column("h").to_pylist()}))
    assert seen == [1, 2] and df.count() == 1


# --- shards -------------------------------------------------------------------------------------------------------------


def check_shards(rows, got, shards, slack):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    weight, slots = Counter(), defaultdict(list)
    for r in got:
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(weight) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(weight.values()) / shards
    assert all(abs(weight[k] - mean) <= slack for k in range(shards)), (weight, mean)


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shards_are_even_and_keep_copies(spark, shards):
    rng = random.Random(shards)
    rows = [(i, text(rng, rng.randrange(1, 60))) for i in range(1200)]
    rows += [(2000 + i, rows[i % 50][1]) for i in range(100)] + [(5000 + i, "a hot text of some words") for i in range(2500)]
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, f"s{i % 7}", len(t), 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, shard int, key int").repartition(3)
    got = sharding.assign_shards(df, shards).collect()
    # a cut is off by half an atom at most; three levels of cuts
    atom = sum(len(t) + 1 for _, t in rows) / shards / sharding.LOOSE
    check_shards(rows, got, shards, 3 * max(atom, 500))
    of = defaultdict(set)
    for r in got:
        of[(r.size, r.text_crc32)].add(r.shard)
    total = sum(r.size for r in got)
    light = [k for k, v in Counter((r.size, r.text_crc32) for r in got).items() if k[0] * v <= total // (shards * sharding.LOOSE)]
    assert light and all(len(of[k]) == 1 for k in light) and (shards == 1 or len(of[(25, zlib.crc32(b"a hot text of some words"))]) > 1)
    assert sorted(map(tuple, sharding.assign_shards(df.repartition(7), shards).collect())) == sorted(map(tuple, got))


def test_shards_of_odd_rows_and_of_target_bytes(spark, odd, tmp_path):
    check_shards(ODD, sharding.assign_shards(odd, 2).collect(), 2, math.inf)
    assert sharding.assign_shards(odd.limit(0), 8).count() == 0
    assert {r.shard for r in sharding.assign_shards(odd.where("doc_id != 5"), target_bytes=60).collect()} <= set(range(3))
    with pytest.raises(ValueError):
        sharding.assign_shards(odd)
    sharding.write_shards(odd, f"{tmp_path}/out", shards=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r.doc_id, r.text, r.kept) for r in back.collect()) == Counter((i, t, 1.5) for i, t in ODD)
    of = {(r.doc_id, r.size): r.shard for r in sharding.assign_shards(odd, 2).collect()}
    assert all(of[(r.doc_id, len((r.text or "").encode()) + 1)] == r["shard"] for r in back.collect())


def test_query_of_shards(spark):
    got = queries.op11_kd_shards(spark, D)
    assert dict(got.dtypes)["shard"] == "int" and {r.law for r in got.select("law").distinct().collect()} == {"bytes"} and got.where(F.col("grown_shard").isNotNull()).count() == 0


# --- near-duplicates of one template --------------------------------------------------------------------------------------


def test_unlike_pages_of_one_template_dont_meet(spark, monkeypatch):
    """All share a long text and bring as many words again: nobody is linked, and what is compared grows with the pages."""
    from cohortlab.llm import near_dup

    plain, met = near_dup._meeting, []

    def counted(nodes, percent):
        each = plain(nodes, percent)
        sides = each.groupBy("pivot", "e").agg(F.sum(F.col("left").cast("long")).alias("l"), F.count("*").alias("c"))
        met.append(sides.agg(F.sum(F.col("l") * F.col("c"))).first()[0] or 0)
        return each

    monkeypatch.setattr(near_dup, "_meeting", counted)
    rng = random.Random(1)
    template = " ".join(f"t{i}" for i in range(300))
    for n in (100, 200):
        rows = [(i, template + " " + " ".join(f"w{i}x{j}" for j in range(rng.randrange(60, 120)))) for i in range(n)]
        # and a few that are alike: a change of one word in a hundred or so
        rows += [(1000 + i, template + " " + " ".join(f"v{i}" if j == 7 * i else f"u{j}" for j in range(80))) for i in range(6)]
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows), 2).collect()}
        assert all(got[i] == i for i in range(n)) and all(got[1000 + i] == 1000 for i in range(6))
    assert met[1] <= 2 * met[0] + 5000, met


# --- packing ----------------------------------------------------------------------------------------------------------------


def fewest_bins(lengths, room):
    """By trying everything: the largest piece left goes to each different open bin, or to a new one."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for f in set(bins):
            if f + lengths[i] <= room:
                k = bins.index(f)
                place(i + 1, bins[:k] + [f + lengths[i]] + bins[k + 1 :])
        place(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_packing_against_all_packings():
    from cohortlab.llm import packing

    rng, more = random.Random(2), 0
    for _ in range(150):
        lengths = np.array([rng.randrange(1, 12) for _ in range(rng.randrange(1, 10))])
        where = packing.pack_lengths(lengths, 12)
        assert np.bincount(where, lengths).max() <= 12 and set(where) == set(range(where.max() + 1))
        extra = where.max() + 1 - fewest_bins(lengths.tolist(), 12)
        assert 0 <= extra <= 1
        more += extra
    assert more <= 5


def test_search_ends_where_nothing_improves():
    from cohortlab.llm import packing

    rng = np.random.default_rng(5)
    lengths = rng.integers(3, 40, 60)
    where = packing.pack_lengths(lengths, 100)
    fill = np.bincount(where, lengths).astype(int)
    if len(fill) > -(-lengths.sum() // 100):
        for d in range(len(fill)):
            mine = np.flatnonzero(where == d)
            for r in range(len(fill)):
                if r != d and fill[r] >= fill[d]:
                    gap = 100 - fill[r]
                    out = [[i] for i in mine] + [[i, j] for i in mine for j in mine if i < j]
                    assert all(lengths[i] > gap for i in mine)
                    assert not any(0 < lengths[o].sum() - lengths[b] <= gap for o in out for b in np.flatnonzero(where == r))


def test_full_pieces_need_no_group(spark):
    from cohortlab.llm import packing

    rows = [(i, i, 0, 0, 8 if i % 50 else 3, 1) for i in range(1000)]
    pieces = spark.createDataFrame(rows, "doc_id long, rid long, piece int, start long, length long, ids_crc32 long").repartition(4)
    got = packing.pack(pieces, 8, group=7).collect()
    full = [r.sequence_id for r in got if r.length == 8]
    assert len(set(full)) == 980 and max(full) < 0 <= min(r.sequence_id for r in got if r.length == 3) and all(r.offset == 0 for r in got if r.length == 8)
    shuffled = packing.pack(pieces.where("length = 8"), 8).where("length = 8")._jdf.queryExecution().executedPlan().toString()
    assert len(got) == 1000 and "sequence_id" in shuffled


# --- pages ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<style>.h{display:none}</style><p class=h>no<p class='x h y'>no<p>yes", "yes"),
        ("<p class=h>no<p>yes<style>/* .q{} */ p.h , #k { color: red; DISPLAY : None !important }</style><p id=k>no", "yes"),
        ("<style>.h{display:none}#i{display:block}</style><p class=h id=i>yes<p class=h style='display:block'>yes", "yes\n\nyes"),
        ("<style>p{visibility:hidden}b{visibility:visible}</style><p>no <b>yes</b> no<div>on</div>", "yes\n\non"),
        ("<style>div p{display:none}p:hover{display:none}@media print{p{display:none}}</style><div><p>yes</div>", "yes"),
        ("<style media=print>p{display:none}</style><p>yes", "yes"),
        ("<style>*{visibility:hidden}.y{visibility:visible}</style>no<p class=y>yes", "no\n\nyes"),
        ("<style>.h{display:none", ""),
        ("<details><summary>head</summary>no<p>no</details>on", "head\non"),
        ("<details open><summary>head</summary>yes</details>", "head\nyes"),
        ("<details>no</details>on", "on"),
        ("a<br><br>b<br>c", "a\n\nb\nc"),
        ("<p>a<br></p><p>b", "a\n\nb"),
    ],
)
def test_visibility_and_breaks(page, want):
    from cohortlab.llm import html_text

    assert html_text.page_text(page) == want


def test_columns_are_aligned_at_any_width_and_depth():
    from cohortlab.llm import html_text

    wide = "w" * 300
    lines = html_text.page_text(f"<table><tr><td>{wide}<td>b<tr><td>c<td>d</table>").split("\n")
    assert lines == [f"{wide} | b", f"c{' ' * 299} | d"]
    page = "<table><tr>" + "".join(f"<td rowspan=2>x{i}" for i in range(25)) + "<td>y<tr><td>z</table>"
    first, second = html_text.page_text(page).split("\n")
    assert first.index("y") == second.index("z")
    # padding stays in proportion: one cell of a long page's text, and many short rows below it
    page = f"<table><tr><td>{'v' * 200_000}<td>b" + "<tr><td>c<td>d" * 2000 + "</table>"
    out = html_text.page_text(page)
    assert len(out) < 64 * len(page) and out.split("\n")[-1] == "c | d"


def test_pages_of_odd_rows(spark):
    from cohortlab.llm import html_text

    rows = [(1, "<p>a", "x", 7), (1, "<p>a", "x", 7), (None, "<p>b", "y", 8), (2, None, "z", 9), (3, "", None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_lines int").repartition(2)
    got = sorted((r.page_id or 0, r.text, r.n_lines, r.n_chars) for r in html_text.extract_text(df).collect())
    assert got == [(0, "b", 1, 1), (1, "a", 1, 1), (1, "a", 1, 1), (2, "", 0, 0), (3, "", 0, 0)]
    nulls = html_text.extract_text(df.where("html is null")).collect()
    assert [(r.page_id, r.text, r.n_lines) for r in nulls] == [(2, "", 0)]


# --- stages on odd tables ---------------------------------------------------------------------------------------------------


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns named like those that operators make."""
    rows = [(i, t, "en" if i is None or i % 2 else None, None, len(t) if t is not None else None, 2.5, "n", 4) for i, t in [*ODD, (7, "the same long line of words is here\nown seven"), (8, "the same long line of words is here\nown eight"), (9, "the same long line of words is here"), (10, "the same long line of words is here\n"), (11, "the same long line of words is here\nown eleven"), (12, None), (13, "   ")]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept double, node string, length int").repartition(3)


def test_line_stage_on_odd_rows(spark):
    import corpus_pipeline as P

    docs = odd_documents(spark)
    out = P.drop_lines(spark, docs, D)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    got = {r.doc_id: r for r in out.collect()}
    assert got[7].text.startswith("the same") and got[8].text == "own eight" and got[8].n_chars == 9
    # documents that had text and have none left go; those without text stay
    assert 9 not in got and 10 not in got and got[12].text is None and got[12].n_chars is None and got[13].text == "   " and got[1].text == ""
    assert sum(r.doc_id == 3 for r in out.collect()) == 2 and all(r.kept == 2.5 and r.node == "n" for r in got.values())
    assert P.drop_lines(spark, docs.limit(0), D).count() == 0


def test_near_duplicate_stage_on_odd_rows(spark):
    import corpus_pipeline as P

    docs = odd_documents(spark)
    out = P.drop_near_duplicates(spark, docs, D)
    assert out.columns == docs.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in out.collect())
    # 3 came twice as one row; 9 and 10 have one set, of which the least id stays
    assert [i for i, _ in ids] == [-1, 1, 2, 3, 4, 5, 7, 8, 9, 11, 12, 13]
    assert P.drop_near_duplicates(spark, docs.limit(0), D).count() == 0


def test_packing_stage_on_odd_rows_and_ties(spark):
    import corpus_pipeline as P

    docs = odd_documents(spark)
    got = P.pack(spark, docs, D).collect()
    # the long text is two pieces; those without text are their end id alone
    assert len(got) == docs.count() + 1 and {r.doc_id for r in got if r.length == 1} >= {1, 2, 12} and sum(r.doc_id is None for r in got) == 1
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 2048
    again = P.pack(spark, docs.repartition(1), D).collect()
    key = lambda rows: sorted((r.doc_id or -1, r.piece, r.length, r.sequence_id, r.offset) for r in rows)
    # equal rows can't be told apart; all others have the same place, however the table is dealt
    assert [k for k in key(got) if k[0] != 3] == [k for k in key(again) if k[0] != 3] and len(spans) == len({r.sequence_id for r in again})
    assert P.pack(spark, docs.limit(0), D).count() == 0


def test_words_are_chosen_alike_on_ties_and_conflicting_labels(spark):
    from cohortlab.llm import toxicity

    rng = random.Random(12)
    # eight words that tell the category equally well, and ids with two labels, of which the larger counts
    rows = [(i, " ".join([text(rng, 20), *(f"bad{j}" for j in range(8) if i % 4 == 0)])) for i in range(200)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(i, 1, 0) for i in range(0, 200, 8)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    made = [sorted((r.doc_id, round(r.p_toxic, 9)) for r in toxicity.toxicity(frame(spark, rows).repartition(n), marks.repartition(n)).collect()) for n in (1, 4)]
    assert made[0] == made[1] and all((p > 0.5) == (i % 4 == 0) for i, p in made[0])
    sample = spark.createDataFrame([([j, 100 + j], i % 2, i % 2) for i in range(60) for j in [i % 2]], "words array<long>, fold int, y0 int")
    picked = [sorted(map(tuple, toxicity.choose_words(sample.repartition(n), 1, most=1).collect())) for n in (1, 3)]
    assert picked[0] == picked[1] and all(w in (0, 1, 100, 101) for _, _, w in picked[0])
