"""Registered queries and their SQL twins: every operator bound to a table of the same shape.

Recordings are the event series of users (channel and cohort by number), embeddings are the vectors with cohort
`vec_id % 3` and disease `label >= 5`, scores are documents' lengths with their labels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import kernels as K
from .operators import select as P
from .operators import signal as S
from .operators import stats as T
from .plans import experiments as X
from .sources import tables as IO
from .sources.shared import written

QUERIES: dict = {}
SQL: dict[str, str] = {}
USER_SCALES = [4, 6, 8, 12, 16]
TYPE_SCALES = [16, 32, 64, 128, 256]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- bindings -----------------------------------------------------------------------------------------------------------


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def series(spark: SparkSession, d: str, key: str = "user_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return read(spark, d, "events").select(key, "event_id", (F.row_number().over(w) - 1).alias("t"), F.col("value").alias("x"))


def arrays(spark: SparkSession, d: str) -> DataFrame:
    """recording_id (user), samples in time order."""
    g = read(spark, d, "events").groupBy(F.col("user_id").alias("recording_id"))
    return g.agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s.value).alias("samples"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("subject_id"), F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("cohort"), (F.col("label") >= 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("vec"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, d, "labels"), "doc_id")


def targets(spark: SparkSession, d: str) -> DataFrame:
    """user_id, alpha, r2, m (mean), sd."""
    s = series(spark, d)
    return S.dfa_sql(s, "user_id", USER_SCALES).join(s.groupBy("user_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd")), "user_id")


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) + F.lit(0.0) for c in cols})


SIG = "select user_id, event_type, event_id, value as x, row_number() over (partition by user_id order by ts, event_id) - 1 as t from events"
VEC = "select vec_id as subject_id, 'c' || (vec_id % 3) as cohort, case when label >= 5 then 1 else 0 end as y, embedding::double[] as vec from embeddings"
LONGV = f"select subject_id, cohort, y, unnest(vec) as v, generate_subscripts(vec, 1) - 1 as feature from ({VEC})"


def _dfa_cte(source: str, key: str, scales: list[int]) -> str:
    """CTEs that end in dfa(key, alpha, r2) for a query with columns key, t, x."""
    return f"""src as ({source}), prof as (
  select {key}, t, n, sum(x0) over (partition by {key} order by t rows unbounded preceding) as p
  from (select {key}, t, x - avg(x) over (partition by {key}) as x0, count(*) over (partition by {key}) as n from src)
), cut as (
  select {key}, s, t // s as seg, (t % s)::double as pos, p from prof, (select unnest({scales}) as s) where n // s >= 2 and t // s < n // s
), mse as (
  select {key}, s, seg, (regr_syy(p, pos) - regr_sxy(p, pos) * regr_sxy(p, pos) / regr_sxx(p, pos)) / s as mse from cut group by {key}, s, seg
), fl as (
  select {key}, ln(s) as u, ln(sqrt(avg(greatest(mse, 0)))) as v from mse group by {key}, s having avg(greatest(mse, 0)) > 0
), dfa as (
  select {key}, regr_slope(v, u) as alpha, 1 - (regr_syy(v, u) - regr_sxy(v, u) * regr_sxy(v, u) / regr_sxx(v, u)) / (regr_syy(v, u) + 1e-12) as r2 from fl group by {key} having count(*) >= 3
)"""


DFA_USER = _dfa_cte(SIG, "user_id", USER_SCALES)
TARGETS = f"{DFA_USER}, targets as (select d.user_id, alpha, r2, m, sd from dfa d join (select user_id, avg(x) as m, stddev_pop(x) as sd from src group by user_id) using (user_id))"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return l7_dfa_qc(spark, d)


# --- sources, selection, joins ------------------------------------------------------------------------------------------


@query("select page_id, g as grp, 'NA' as site, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') as subject_id, case when g = 'en' then 1 else 0 end as label from (select page_id, url, list_filter(string_split(url, '/'), lambda x: x in ('en', 'fr', 'de'))[1] as g from pages) where g is not null")
def s3_labels_from_path(spark, d):
    return IO.labels_from_path(read(spark, d, "pages"), "url", ["en"], ["fr", "de"], ["AR", "CL"]).select("page_id", "grp", "site", "subject_id", "label")


@query(f"select vec_id as subject_id, round(list_sum(embedding::double[]), 6) as total, len(embedding) as width from embeddings")
def s4_unify_embeddings(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("subject_id"), F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).alias("first_name"), F.when(F.col("vec_id") % 2 == 1, F.col("embedding")).alias("other_name"))
    u = IO.unify_embeddings(e, ("embedding", "first_name", "other_name"))
    return rounded(u.select("subject_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("embedding").cast("long").alias("width")), "total")


@query(f"with {DFA_USER} select user_id, round(alpha, 6) as alpha from dfa")
def s7_incremental_targets(spark, d):
    s = series(spark, d)
    cached = S.dfa_sql(s.where("user_id % 2 = 0"), "user_id", USER_SCALES).select("user_id", "alpha")
    return rounded(IO.incremental_targets(s, cached, lambda x: S.dfa_sql(x, "user_id", USER_SCALES).select("user_id", "alpha"), "user_id"), "alpha")


@query("select grp, site, ext, case when grouping(ext) = 0 then count(*) else count(*) filter (where ext2 = 'toxic') end as n from (select lang as grp, source as site, case when toxic = 1 then 'toxic' else 'clean' end as ext, case when toxic = 1 then 'toxic' else 'clean' end as ext2 from documents join labels using (doc_id)) group by grouping sets ((grp), (site), (ext))")
def s8_cohort_inventory(spark, d):
    return IO.cohort_inventory(scored(spark, d).withColumn("ext", F.when(F.col("toxic") == 1, "toxic").otherwise("clean")), "lang", "source", "ext", "toxic")


@query("select distinct upper(event_type) as name, count(*) as n from events group by 1")
def p1_normalise_channel(spark, d):
    return read(spark, d, "events").withColumn("raw", F.concat(F.lit("EEG "), F.col("event_type"), F.lit("-REF"))).groupBy(P.normalise_channel(F.col("raw")).alias("name")).agg(F.count("*").alias("n"))


@query("with e as (select user_id % 20 as recording_id, upper(event_type) as channel, event_id, value, (select list(distinct upper(event_type) order by upper(event_type)) from events) as m from events), l as (select recording_id, channel, arg_max(value, event_id) as value, max(event_id) as event_id, any_value(m) as m from e group by 1, 2) select recording_id, channel, list_position(m, channel) - 1 as ch_idx, event_id, round(value, 6) as value from l where recording_id in (select recording_id from l group by 1 having count(*) = max(len(m)))")
def p2_select_montage(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 20).alias("recording_id"), F.col("event_type").alias("channel"), "event_id", "value")
    names = sorted(r[0].upper() for r in e.select("channel").distinct().collect())
    return rounded(P.select_montage(e, names, order="event_id"), "value")


@query("with n as (select ['T3', 't4', 'XX-T5', 'Fpz-CZ', 'T6', 'T7', 'zz-yy'][user_id % 7 + 1] as name, event_type from events) select name, case name when 'T3' then 'T7' when 't4' then 'T8' when 'XX-T5' then 'P7' when 'Fpz-CZ' then 'CZ' when 'T6' then 'T6' when 'T7' then 'T7' else name end as resolved, count(*) as n from n group by 1, 2")
def p3_resolve_alias(spark, d):
    # T6's alias isn't known, but its own name is; the last has no known part
    names = F.array(*(F.lit(x) for x in ("T3", "t4", "XX-T5", "Fpz-CZ", "T6", "T7", "zz-yy")))
    e = read(spark, d, "events").withColumn("name", F.element_at(names, (F.col("user_id") % 7 + 1).cast("int")))
    return e.groupBy("name", P.resolve_alias(F.col("name"), ["T7", "P7", "CZ", "T4", "T8", "T6"]).alias("resolved")).agg(F.count("*").alias("n"))


@query("with e as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings), cap as (select * from e where vec_id < 128), q as (select * from e where vec_id >= 128) select q.vec_id as name, arg_min(cap.vec_id, sqrt((q.x-cap.x)*(q.x-cap.x)+(q.y-cap.y)*(q.y-cap.y)+(q.z-cap.z)*(q.z-cap.z))) as nearest, round(min(sqrt((q.x-cap.x)*(q.x-cap.x)+(q.y-cap.y)*(q.y-cap.y)+(q.z-cap.z)*(q.z-cap.z))), 6) as dist from q, cap group by q.vec_id")
def p4_nearest_electrode(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("name"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")), F.col("vec_id").alias("ord"))
    # the cap is a fixed list of 128 electrodes, whatever the number of positions to place
    return rounded(P.nearest_electrode(e.where("name >= 128"), e.where("name < 128")), "dist")


@query(f"select user_id as recording_id, count(*) as n, round(sum(x), 6) as total from ({SIG}) where t < 64 group by user_id having count(*) = 64")
def p5_duration_gate(spark, d):
    g = P.duration_gate(arrays(spark, d), 64)
    return rounded(g.select("recording_id", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("select doc_id, lang, case when lang = 'en' then 1 else 0 end as y from documents where lang in ('en', 'fr', 'de')")
def p6_binary_task(spark, d):
    return P.binary_task(read(spark, d, "documents").select("doc_id", "lang"), "lang", ["en"], ["fr", "de"])


@query("select doc_id, quality, rank_in_class from (select doc_id, quality, row_number() over (partition by quality order by doc_id) as rank_in_class from labels) where rank_in_class <= 20")
def p7_head_per_class(spark, d):
    return P.head_per_class(read(spark, d, "labels").select("doc_id", "quality"), 20, "quality", "doc_id")


@query("select doc_id, n_chars from documents where doc_id in (select doc_id from labels) order by doc_id limit 50")
def p8_head_n(spark, d):
    return P.head_n(read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id", "left_semi"), 50, "doc_id")


@query("select doc_id, lang from documents order by md5(concat_ws(':', doc_id, '7')), doc_id limit 300")
def p9_cap_sample(spark, d):
    return P.cap_sample(read(spark, d, "documents").select("doc_id", "lang"), 300, 7, "doc_id")


@query(f"with v as ({VEC}), r as (select subject_id, cohort, row_number() over (partition by cohort order by subject_id) as r from v) select subject_id, cohort from r where r <= (select min(c) from (select count(*) as c from v group by cohort))")
def p10_balance_cohorts(spark, d):
    return P.balance_cohorts(vectors(spark, d).select("subject_id", "cohort"), "cohort", "subject_id")


@query(f"with {TARGETS} select count(*) as n from targets where sd is not null and alpha is not null and m > 0")
def p11_finite_only(spark, d):
    t = targets(spark, d).withColumn("q", F.when(F.col("m") > 0, F.col("alpha")).otherwise(F.lit(float("nan"))))
    return P.finite_only(t, "q", "sd").agg(F.count("*").alias("n"))


@query("select d.doc_id, d.lang, l.quality, e.label from documents d join labels l using (doc_id) join embeddings e on e.vec_id = d.doc_id")
def j1_assemble_cohort(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("subject_id"), "lang")
    return P.assemble_cohort(docs, read(spark, d, "labels").select(F.col("doc_id").alias("subject_id"), "quality"), read(spark, d, "embeddings").select(F.col("vec_id").alias("subject_id"), "label")).withColumnRenamed("subject_id", "doc_id")


@query("select user_id from events where event_type in ('click', 'view', 'purchase') group by user_id having count(distinct event_type) = 3 and user_id in (select c_custkey from customer)")
def j2_common_subjects(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("event_type").alias("encoder"))
    return P.common_subjects(e, ["click", "view", "purchase"], "user_id", read(spark, d, "customer").select(F.col("c_custkey").alias("user_id")))


@query("select vec_id as subject_id, label, quality, toxic from embeddings join labels on doc_id = vec_id")
def j3_labelled_embeddings(spark, d):
    return P.labelled_embeddings(read(spark, d, "embeddings").select(F.col("vec_id").alias("subject_id"), "label"), read(spark, d, "labels").withColumnRenamed("doc_id", "subject_id"))


@query(f"select subject_id, cohort, y from ({VEC}) where cohort != 'c2'")
def j4_stack_cohorts(spark, d):
    v = vectors(spark, d).select("subject_id", "y", F.col("cohort").alias("c"))
    return P.stack_cohorts("c2", **{n: v.where(F.col("c") == n).drop("c") for n in ("c0", "c1", "c2")}).select("subject_id", "cohort", "y")


@query(f"with s as ({SIG}), n as (select user_id, count(*) as n from s group by user_id) select stage, n from (select 'read' as stage, count(*) as n from n union all select 'long enough', count(*) from n where n >= 64)")
def attrition_report(spark, d):
    a = arrays(spark, d)
    return P.attrition({"read": a, "long enough": P.duration_gate(a, 64)})


# --- signals ------------------------------------------------------------------------------------------------------------


HALVED = f"with s as (select user_id, t, x, count(*) over (partition by user_id) as n from ({SIG})), sz as (select distinct user_id, n, round_even(n / 2.0, 0)::bigint as m from s), f as (select s.user_id, k, sum(x * cos(2 * pi() * k * t / s.n)) as re, -sum(x * sin(2 * pi() * k * t / s.n)) as im from s join (select user_id, m, unnest(range(0, m // 2 + 1)) as k from sz) z on z.user_id = s.user_id group by 1, 2), g as (select user_id, n, m, unnest(range(0, m)) as j from sz) select g.user_id as recording_id, g.j as i, round(sum((f.re * cos(2 * pi() * k * j / g.m) - f.im * sin(2 * pi() * k * j / g.m)) * case when k = 0 then 1 else 2 end) / n, 6) + 0.0 as x from g join f on f.user_id = g.user_id group by g.user_id, g.j, g.n, g.m"


@query(HALVED)
def h1_resample_fft(spark, d):
    r = S.resample(arrays(spark, d), 2.0, 1.0)
    return rounded(r.select("recording_id", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long")), "x")


LINEAR = f"with s as (select user_id, t, x, count(*) over (partition by user_id) as n from ({SIG})), g as (select user_id, n, unnest(range(0, n * 3 // 2)) as i from (select distinct user_id, n from s)), a as (select user_id, n, i, greatest(least((i + 0.5) * n / (n * 3 // 2) - 0.5, n - 1), 0) as place from g), b as (select *, least(floor(place)::bigint, n - 2) as lo from a) select b.user_id as recording_id, b.i as i, round(l.x * (1 - (b.place - b.lo)) + h.x * (b.place - b.lo), 7) + 0.0 as x from b join s l on l.user_id = b.user_id and l.t = b.lo join s h on h.user_id = b.user_id and h.t = b.lo + 1"


@query(LINEAR)
def h2_resample_linear(spark, d):
    r = S.resample(arrays(spark, d), 2.0, 3.0, "linear")
    return rounded(r.select("recording_id", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long")), "x", n=7)


@query(f"with s as (select user_id % 10 as recording_id, user_id as channel, t, x from ({SIG})), c as (select recording_id, x - avg(x) over (partition by recording_id, t) as x from s) select recording_id, count(*) as n, round(sum(x * x), 2) as ss from c group by recording_id")
def h3_common_average_reference(spark, d):
    s = series(spark, d).withColumnsRenamed({"user_id": "channel"}).withColumn("recording_id", F.col("channel") % 10)
    c = S.common_average_reference(s).groupBy("recording_id").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    return rounded(c, "ss", n=2)


def _filter_cte(sf: float, lo: float, hi: float, source: str = f"src as ({SIG})") -> str:
    """CTEs (recursive) after one named src(user_id, t, x), that end in filtered(user_id, t, x): second-order sections one sample after another, forward, then backward."""
    sections = [([float(v) for v in c], [float(v) for v in d]) for c, d in K.butter_band(4, lo, hi, sf)]
    pad = 3 * (2 * len(sections) + 1)
    state = [f"{c}{k}" for k in range(len(sections)) for c in "pq"]
    level, begin = "x", []
    for k, (c, d) in enumerate(sections):
        gain = sum(c) / sum(d)
        begin += [f"{level} * {gain - c[0]!r} as p{k}", f"{level} * {c[2] - d[2] * gain!r} as q{k}"]
        level = f"{level} * {gain!r}"
    steps, u = [], "e.x"
    for k, (c, d) in enumerate(sections):
        steps += [f"{c[0]!r} * {u} + f.p{k} as y{k}", f"{c[1]!r} * {u} - {d[1]!r} * y{k} + f.q{k} as p{k}n", f"{c[2]!r} * {u} - {d[2]!r} * y{k} as q{k}n"]
        u = f"y{k}"

    def once(name: str, source: str) -> str:
        return f"""{name}(user_id, i, y, {", ".join(state)}) as (
  select user_id, -1::bigint, 0::double, {", ".join(begin)} from {source} where i = 0
  union all select user_id, i, {u}, {", ".join(f"{c}n" for c in state)} from (select e.user_id, e.i, {", ".join(steps)} from {name} f join {source} e on e.user_id = f.user_id and e.i = f.i + 1)
)"""

    return f"""{source}, ends as (
  select user_id, count(*) as n, least({pad}, count(*) - 1) as pad, arg_min(x, t) as head, arg_max(x, t) as tail from src group by 1
), ext as (
  select e.user_id, k as i, case when k < pad then 2 * head - s.x when k >= pad + n then 2 * tail - s.x else s.x end as x
  from (select *, unnest(range(n + 2 * pad)) as k from ends) e join src s on s.user_id = e.user_id and s.t = case when k < pad then pad - k when k >= pad + n then 2 * (n - 1) - (k - pad) else k - pad end
), {once("ahead", "ext")}, turned as (
  select a.user_id, n + 2 * pad - 1 - i as i, y as x from ahead a join ends e on e.user_id = a.user_id where i >= 0
), {once("back", "turned")}, filtered as (
  select b.user_id, n + pad - 1 - i as t, y as x from back b join ends e on e.user_id = b.user_id where i >= pad and i < pad + n
)"""


@query(f"with recursive {_filter_cte(200.0, 8.0, 45.0)} select user_id as recording_id, t as i, round(x, 5) + 0.0 as x from filtered")
def h4_bandpass(spark, d):
    b = S.bandpass(arrays(spark, d), 200.0, 8.0, 45.0)
    return rounded(b.select("recording_id", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long")), "x", n=5)


def _spectral_cte(source: str, out: str, length: str, gain: str = "1") -> str:
    """CTEs that end in out(user_id, t, x): the spectrum of source by sums, times a gain of bin k, back to `length` samples of n."""
    return f"""{out}_n as (
  select *, ({length})::bigint as m from (select user_id, count(*) as n from {source} group by 1)
), {out}_dft as (
  select f.user_id, z.n, z.m, k, sum(x * cos(2 * pi() * k * t / z.n)) as re, -sum(x * sin(2 * pi() * k * t / z.n)) as im
  from {source} f join (select *, unnest(range(m // 2 + 1)) as k from {out}_n) z on z.user_id = f.user_id group by 1, 2, 3, 4
), {out} as (
  select g.user_id, g.t, sum(({gain}) * case when k = 0 or (d.m = d.n and 2 * k = d.n) then 1 else 2 end * (re * cos(2 * pi() * k * g.t / d.m) - im * sin(2 * pi() * k * g.t / d.m))) / any_value(d.n) as x
  from (select user_id, unnest(range(m)) as t from {out}_n) g join {out}_dft d on d.user_id = g.user_id group by 1, 2
)"""


_TENS = f"raw as ({SIG}), lengths as (select user_id, count(*) as n from raw group by 1), shortest as (select user_id // 10 as rec, min(n) as n from lengths group by 1), referenced as (select user_id, t, x - avg(x) over (partition by user_id // 10, t) as x from raw join shortest on rec = user_id // 10 where t < shortest.n)"
_NOTCHED = _TENS + ", " + _spectral_cte("referenced", "notched", "n", "(1 - cos(pi() * least(abs(k * 500.0 / d.n - 50) / 2, 1))) / 2")
_WIDE = _filter_cte(500.0, 0.5, 70.0, _NOTCHED + ", src as (select * from notched)") + ", " + _spectral_cte("filtered", "slower", "round_even(n * 200.0 / 500.0, 0)")


@query(f"with recursive {_WIDE} select user_id // 10 as recording_id, user_id as ch_idx, t as i, round(x, 5) + 0.0 as x from slower")
def h5_recipe_notch_wide(spark, d):
    # ten users of unequal lengths are the channels of a recording
    a = arrays(spark, d).select(F.floor(F.col("recording_id") / 10).alias("recording_id"), F.col("recording_id").alias("ch_idx"), "samples")
    r = S.recipe_notch_wide(a)
    return rounded(r.select("recording_id", "ch_idx", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long")), "x", n=5)


ENVELOPE = "n as (select user_id, count(*) as n from filtered group by 1), dft as (select f.user_id, n.n, k, sum(x * cos(2 * pi() * k * t / n.n)) as re, -sum(x * sin(2 * pi() * k * t / n.n)) as im from filtered f join (select *, unnest(range(n // 2 + 1)) as k from n) n on n.user_id = f.user_id group by 1, 2, 3), whole as (select f.user_id, f.t, sum(case when k = 0 or 2 * k = d.n then 1 else 2 end * (re * cos(2 * pi() * k * t / d.n) - im * sin(2 * pi() * k * t / d.n))) / any_value(d.n) as re, sum(case when k = 0 or 2 * k = d.n then 1 else 2 end * (re * sin(2 * pi() * k * t / d.n) + im * cos(2 * pi() * k * t / d.n))) / any_value(d.n) as im from filtered f join dft d on d.user_id = f.user_id group by 1, 2)"


@query(f"with recursive {_filter_cte(200.0, 8.0, 13.0)}, {ENVELOPE} select user_id as recording_id, t as i, round(sqrt(re * re + im * im), 5) as x from whole")
def h6_envelope(spark, d):
    e = S.envelope(arrays(spark, d), 200.0)
    return rounded(e.select("recording_id", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long")), "x", n=5)


_MONTAGE = "raw as (select (user_id // 5) * 100 + idx as user_id, row_number() over (partition by user_id // 5, event_type order by ts, event_id) - 1 as t, value as x from events join (select event_type, row_number() over (order by upper(event_type)) - 1 as idx from (select distinct event_type from events)) using (event_type))"
_GATED = _MONTAGE + ", " + _spectral_cte("raw", "halved", "round_even(n / 2.0, 0)") + ", whole as (select user_id // 100 as rec from halved where t = 19 group by 1 having count(*) = 5 and count(*) = (select count(distinct event_type) from events)), src as (select user_id, t, x - avg(x) over (partition by user_id // 100, t) as x from halved where t < 20 and user_id // 100 in (select rec from whole))"


@query(f"with recursive {_filter_cte(200.0, 1.0, 45.0, _GATED)} select user_id // 100 as recording_id, (user_id % 100)::int as ch_idx, t as i, round(x, 5) + 0.0 as x from filtered")
def h7_harmonise(spark, d):
    """The event series of five users are the channels of a recording, at 400 Hz; a tenth of a second is what all have."""
    e = read(spark, d, "events").withColumn("recording_id", F.floor(F.col("user_id") / 5))
    w = e.groupBy("recording_id", F.col("event_type").alias("channel")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s.value).alias("samples"), F.max("event_id").alias("pos"))
    names = sorted(r[0].upper() for r in e.select("event_type").distinct().collect())
    h = S.harmonise(w, 400.0, names, 200.0, 0.1, (1.0, 45.0))
    return rounded(h.select("recording_id", "ch_idx", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long")), "x", n=5)


@query(f"with s as (select user_id, t // 16 as epoch_idx, x from ({SIG})) select user_id as recording_id, epoch_idx, round(avg(x), 6) as m from s group by 1, 2 having count(*) = 16")
def h8_epoch(spark, d):
    e = S.epoch(arrays(spark, d), 16)
    return rounded(e.select("recording_id", F.col("epoch_idx").cast("long").alias("epoch_idx"), (F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / 16).alias("m")), "m")


REJECT = f"with s as (select user_id % 50 as recording_id, user_id, t // 8 as epoch_idx, x from ({SIG})), c as (select recording_id, user_id, epoch_idx, max(x) - min(x) as ptp from s group by 1, 2, 3 having count(*) = 8), g as (select recording_id, epoch_idx, bool_and(ptp < 60) as ok, count(*) as ch from c group by 1, 2), k as (select *, count(*) over (partition by recording_id) as b, count(*) filter (where ok) over (partition by recording_id) as a from g) select recording_id, count(*) as epochs, sum(ch)::bigint as rows from k where ok and b >= 5 and a >= 1 group by 1"


@query(REJECT)
def h9_reject_artifacts(spark, d):
    e = S.epoch(arrays(spark, d), 8).withColumn("recording_id", F.col("recording_id") % 50)
    k = S.reject_artifacts(e, 60.0, 5, 1)
    return k.groupBy("recording_id").agg(F.countDistinct("epoch_idx").alias("epochs"), F.count("*").alias("rows"))


@query(f"select user_id as recording_id, round(max(x) * 1e3, 6) as top from ({SIG}) group by 1")
def h10_scale_units(spark, d):
    return rounded(S.scale_units(arrays(spark, d), 1e3).select("recording_id", F.array_max("samples").alias("top")), "top")


def _welch_cte(most: int, sf: float, source: str = f"src as ({SIG})") -> str:
    """CTEs, after one named src(user_id, t, x), that end in psd(user_id, k, freq, p): Hann windows that overlap by half, by the sums of a discrete Fourier transform."""
    return f"""{source}, size as (
  select user_id, count(*) as n, least({most}, count(*)) as w from src group by 1
), seg as (
  select user_id, w, unnest(range(0, n - w + 1, greatest(1, w - w // 2))) as org from size
), cut as (
  select g.user_id, g.w, g.org, s.t - g.org as j, s.x - avg(s.x) over (partition by g.user_id, g.org) as x from seg g join src s on s.user_id = g.user_id and s.t >= g.org and s.t < g.org + g.w
), han as (
  select *, x * (0.5 - 0.5 * cos(2 * pi() * j / w)) as y, 0.5 - 0.5 * cos(2 * pi() * j / w) as h from cut
), dft as (
  select user_id, w, org, k, sum(y * cos(2 * pi() * k * j / w)) as re, sum(y * sin(2 * pi() * k * j / w)) as im, sum(h * h) as hh from (select *, unnest(range(0, w // 2 + 1)) as k from han) group by 1, 2, 3, 4
), psd as (
  select user_id, k, k * {sf} / w as freq, avg((re * re + im * im) / ({sf} * hh) * case when k = 0 or (w % 2 = 0 and k = w // 2) then 1 else 2 end) as p from dft group by 1, 2, 3
)"""


@query(f"with {_welch_cte(32, 200.0)} select user_id as recording_id, k as bin, round(p, 5) + 0.0 as p from psd")
def f1_welch_psd(spark, d):
    w = S.welch_psd(arrays(spark, d), 200.0, 32)
    return rounded(w.select("recording_id", F.posexplode("psd").alias("bin", "p")).withColumn("bin", F.col("bin").cast("long")), "p", n=5)


def _band(name: str) -> str:
    lo, hi = K.BANDS[name]
    return f"coalesce(sum(step) filter (where freq >= {lo} and prior >= {lo} and freq <= {hi}), 0) / sum(step) as {name}"


SPECTRAL = f"with {_welch_cte(64, 200.0)}, steps as (select *, (freq - lag(freq) over w) * (p + lag(p) over w) / 2 as step, lag(freq) over w as prior from psd window w as (partition by user_id order by k)), bands as (select user_id, {', '.join(_band(n) for n in K.BANDS)} from steps group by 1), parts as (select user_id, p / sum(p) over (partition by user_id) + 1e-10 as q from psd), ent as (select user_id, -sum(q / t * ln(q / t)) as entropy from (select user_id, q, sum(q) over (partition by user_id) as t from parts) group by 1) select b.user_id as recording_id, {', '.join(f'round({n}, 5) + 0.0 as {n}' for n in [*K.BANDS, 'entropy'])} from bands b join ent using (user_id)"


@query(SPECTRAL)
def f2_f4_spectral(spark, d):
    c = S.channel_spectral(arrays(spark, d), 200.0, 64)
    names = [*K.BANDS, "entropy"]
    return rounded(c.select("recording_id", *(F.col("spectral")[i].alias(n) for i, n in enumerate(names))), *names, n=5)


HJORTH = f"with d1 as (select user_id, t, x, x - lag(x) over (partition by user_id order by t) as d1 from ({SIG})), d2 as (select *, d1 - lag(d1) over (partition by user_id order by t) as d2 from d1), v as (select user_id, var_pop(x) as a, var_pop(d1) as v1, var_pop(d2) as v2 from d2 group by 1) select user_id, round(a, 6) as activity, round(sqrt(v1 / a), 6) as mobility, round(sqrt(v2 / v1) / sqrt(v1 / a), 6) as complexity from v"


@query(HJORTH)
def f3_hjorth(spark, d):
    return rounded(S.hjorth_sql(series(spark, d), "user_id"), "activity", "mobility", "complexity")


@query(HJORTH)
def f3_hjorth_kernel(spark, d):
    c = S.channel_spectral(arrays(spark, d), 200.0, 64)
    return rounded(c.select(F.col("recording_id").alias("user_id"), *(F.col("spectral")[6 + i].alias(n) for i, n in enumerate(("activity", "mobility", "complexity")))), "activity", "mobility", "complexity")


def _absolute(name: str) -> str:
    lo, hi = K.BANDS[name]
    return f"coalesce(sum(step) filter (where freq >= {lo} and prior >= {lo} and freq <= {hi}), 0) as abs_{name}"


#: epochs of 32 samples; user_id stands for user and epoch, eight users are the channels of a recording
_EPOCHS = f"src as (select user_id * 1000 + t // 32 as user_id, t % 32 as t, x from ({SIG}) qualify count(*) over (partition by user_id, t // 32) = 32)"
CLASSICAL = f"""with {_welch_cte(256, 200.0, _EPOCHS)}, steps as (
  select *, (freq - lag(freq) over w) * (p + lag(p) over w) / 2 as step, lag(freq) over w as prior from psd window w as (partition by user_id order by k)
), bands as (
  select user_id, {', '.join(_band(n) for n in K.BANDS)}, {_absolute('alpha')}, {_absolute('theta')} from steps group by 1
), parts as (
  select user_id, p / sum(p) over (partition by user_id) + 1e-10 as q from psd
), ent as (
  select user_id, -sum(q / z * ln(q / z)) as entropy from (select user_id, q, sum(q) over (partition by user_id) as z from parts) group by 1
), d1 as (
  select user_id, t, x, x - lag(x) over (partition by user_id order by t) as d1 from src
), d2 as (
  select *, d1 - lag(d1) over (partition by user_id order by t) as d2 from d1
), hj as (
  select user_id, var_pop(x) as v0, var_pop(d1) as v1, var_pop(d2) as v2 from d2 group by 1
), ch as (
  select user_id // 8000 as rec, user_id % 1000 as epoch, row_number() over (partition by user_id // 8000, user_id % 1000 order by user_id) - 1 as c, count(*) over (partition by user_id // 8000, user_id % 1000) as n, *,
         v0 as activity, sqrt(v1 / v0) as mobility, sqrt(v2 / v1) / sqrt(v1 / v0) as complexity from bands join ent using (user_id) join hj using (user_id)
), spread as (
  select rec, epoch, unnest([{', '.join(f'5 * c + {i}' for i in range(5))}, {', '.join(f'5 * n + 3 * c + {i}' for i in range(3))}, 8 * n + c]) as pos, unnest([{', '.join(K.BANDS)}, activity, mobility, complexity, entropy]) as v from ch
  union all select rec, epoch, 9 * any_value(n), ln(avg(abs_alpha) filter (where c % 2 = 0) + 1e-10) - ln(coalesce(avg(abs_alpha) filter (where c % 2 = 1), 1e-10) + 1e-10) from ch group by 1, 2
  union all select rec, epoch, 9 * any_value(n) + 1, avg(abs_theta) filter (where c < 4) from ch group by 1, 2
) select rec as recording_id, epoch as epoch_idx, pos, round(v, 3) + 0.0 as v from spread"""


@query(CLASSICAL)
def f7_classical_features(spark, d):
    e = S.epoch(arrays(spark, d), 32).select(F.floor(F.col("recording_id") / 8).alias("recording_id"), F.col("epoch_idx").cast("int").alias("epoch_idx"), F.col("recording_id").cast("int").alias("ch_idx"), "samples")
    c = S.classical_features(e, 200.0)
    return rounded(c.select("recording_id", F.col("epoch_idx").cast("long").alias("epoch_idx"), F.posexplode("vec").alias("pos", "v")).withColumn("pos", F.col("pos").cast("long")), "v", n=3)


@query(f"select cohort, feature, round(avg(v), 6) as v, count(*) as n from ({LONGV}) group by 1, 2")
def f8_subject_mean(spark, d):
    m = S.subject_mean(vectors(spark, d), "cohort", "vec")
    return rounded(m.select("cohort", F.posexplode("vec").alias("f", "v"), F.col("n_epochs").alias("n")).select("cohort", F.col("f").cast("long").alias("feature"), "v", "n"), "v")


# --- scale-free ---------------------------------------------------------------------------------------------------------


@query(f"with {DFA_USER} select user_id, round(alpha, 6) as alpha, round(r2, 6) as r2 from dfa")
def l1_dfa_kernel(spark, d):
    return rounded(S.dfa(arrays(spark, d), USER_SCALES).where("not isnan(alpha)").select(F.col("recording_id").alias("user_id"), "alpha", "r2"), "alpha", "r2")


@query(f"with {DFA_USER} select user_id, round(alpha, 6) as alpha, round(r2, 6) as r2 from dfa")
def l2_dfa_sql(spark, d):
    return rounded(S.dfa_sql(series(spark, d), "user_id", USER_SCALES), "alpha", "r2")


@query("with " + _dfa_cte("select event_type, value as x, row_number() over (partition by event_type order by ts, event_id) - 1 as t from events", "event_type", TYPE_SCALES) + " select event_type, round(alpha, 6) as alpha, round(r2, 6) as r2 from dfa")
def l2_dfa_event_types(spark, d):
    # a few keys hold everything: stretches of time are ranked and summed up apart
    long = S.ranked(read(spark, d, "events"), "event_type", "ts", "event_id", "value")
    return rounded(S.dfa_sql(long, "event_type", TYPE_SCALES), "alpha", "r2")


@query()
def l3_aperiodic_fit(spark, d):
    a = S.aperiodic_fit(arrays(spark, d), 100.0, 32)
    return rounded(a.select("recording_id", "offset", "exponent"), "offset", "exponent")


@query()
def l4_criticality_features(spark, d):
    a = arrays(spark, d).select(F.floor(F.col("recording_id") / 5).alias("recording_id"), F.col("recording_id").cast("string").alias("channel"), (F.col("recording_id") % 5).cast("int").alias("ch_idx"), "samples")
    return rounded(S.criticality_features(a, 200.0, USER_SCALES), "exponent", "offset", "dfa", "dfa_r2")


@query(f"with {TARGETS} select user_id % 3 as cohort, round(avg(alpha), 6) as alpha, round(avg(r2), 6) as r2 from targets group by 1")
def l5_subject_targets(spark, d):
    return rounded(S.subject_targets(targets(spark, d).withColumn("cohort", F.col("user_id") % 3), "cohort", ["alpha", "r2"]), "alpha", "r2")


@query(f"select cohort, round(sum(v), 6) as total, count(v) as n from (select cohort, coalesce(w, avg(w) over (partition by cohort, feature)) as v from (select *, case when subject_id % 7 = 0 then null else v end as w from ({LONGV}))) group by 1")
def l6_impute_mean(spark, d):
    long = T.long_vectors(vectors(spark, d), ["subject_id", "cohort"], "vec").withColumn("v", F.when(F.col("subject_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return rounded(S.impute_mean(long, ["cohort", "feature"], "v").groupBy("cohort").agg(F.sum("v").alias("total"), F.count("v").alias("n")), "total")


@query(f"with {TARGETS} select user_id % 3 as cohort, round(avg(alpha), 6) as mean_alpha, round(avg(case when alpha between 0.5 and 1 then 1.0 else 0 end), 6) as share_in_range, round(avg(r2), 6) as mean_r2 from targets group by 1")
def l7_dfa_qc(spark, d):
    return rounded(S.dfa_qc(targets(spark, d).withColumn("cohort", F.col("user_id") % 3), "cohort"), "mean_alpha", "share_in_range", "mean_r2")


_HALF = f"select user_id * 2 + (case when t >= n // 2 then 1 else 0 end) as k, case when t >= n // 2 then t - n // 2 else t end as t, x from (select *, count(*) over (partition by user_id) as n from ({SIG})) where t < 2 * (n // 2)"


_HALVES = _dfa_cte(_HALF, "k", [4, 6, 8, 12]) + ", ab as (select a.k // 2 as user_id, (a.k // 2) % 5 as fold, a.alpha as x, b.alpha as y from dfa a join dfa b on b.k = a.k + 1 and a.k % 2 = 0), fit as (select f.fold, regr_slope(ab.y, ab.x) as b, regr_intercept(ab.y, ab.x) as a from ab join (select distinct fold from ab) f on f.fold != ab.fold group by f.fold), cv as (select 1 - sum((y - a - b * x) * (y - a - b * x)) / (var_pop(y) * count(*)) as r2_cv from ab join fit using (fold))"


@query(f"with {_HALVES} select count(*) as n, round(corr(x, y), 6) as r, round(2 * corr(x, y) / (1 + corr(x, y)), 6) as spearman_brown, round(avg(x), 6) as mean_1, round(stddev_pop(x), 6) as sd_1, round(avg(y), 6) as mean_2, round(stddev_pop(y), 6) as sd_2, round((select r2_cv from cv), 6) as r2_cv from ab")
def l8_split_half(spark, d):
    r = X.reliability_report(arrays(spark, d).withColumn("fold", F.col("recording_id") % 5), [4, 6, 8, 12], "fold")
    return rounded(r, "r", "spearman_brown", "mean_1", "sd_1", "mean_2", "sd_2", "r2_cv")


@query()
def l9_surrogate_controls(spark, d):
    return rounded(X.surrogate_report(arrays(spark, d), 200.0, USER_SCALES, 3), "mean_alpha", "sd_alpha", "mean_r2")


@query(f"with {TARGETS} select user_id, round(alpha - (select regr_intercept(alpha, m) from targets) - (select regr_slope(alpha, m) from targets) * m, 6) as resid from targets")
def l10_residualise(spark, d):
    return rounded(S.residualise(targets(spark, d), "alpha", "m").select("user_id", "resid"), "resid")


@query(f"with {TARGETS} select count(*) as n, round(corr(alpha, m), 6) as r, round(100 * corr(alpha, m) * corr(alpha, m), 6) as percent from targets")
def l10_residual_report(spark, d):
    return rounded(S.residual_report(targets(spark, d), "alpha", "m").drop("p"), "r", "percent")


_MIXED = "select user_id, row_number() over (partition by user_id order by md5(event_id::varchar), event_id) - 1 as t, value - avg(value) over (partition by user_id) as x from events"
#: orders of fractional integration; white noise of order o has exponent 0.5 + o
ORDERS = [0.0, 0.25, 0.5, 0.75, 1.0]
_KNOWN = f"select a.user_id * {len(ORDERS)} + i as k, a.t, sum(b.x * case when o > 0 then exp(lgamma(a.t - b.t + o) - lgamma(o) - lgamma(a.t - b.t + 1)) when a.t = b.t then 1 else 0 end) as x from ({_MIXED}) a join ({_MIXED}) b on b.user_id = a.user_id and b.t <= a.t, (select unnest(range({len(ORDERS)})) as i, unnest({ORDERS})::double as o) group by 1, 2"


@query("with " + _dfa_cte(_KNOWN, "k", USER_SCALES) + f", known as (select alpha, 0.5 + ({ORDERS})[k % {len(ORDERS)} + 1]::double as h from dfa) select round(corr(alpha, h), 5) as r, round(avg(alpha - h), 5) as bias, round(regr_slope(alpha, h), 5) as slope, round(stddev_pop(alpha - h), 5) as resid_sd, corr(alpha, h) > 0.94 and abs(avg(alpha - h)) <= 0.02 and regr_slope(alpha, h) between 0.95 and 1.05 as passed from known")
def l11_calibration_report(spark, d):
    """The estimator on series of known exponents: values in an order that a digest gives are white, and are integrated to five orders."""
    w = Window.partitionBy("user_id")
    white = written(read(spark, d, "events").select("user_id", (F.row_number().over(w.orderBy(F.md5(F.col("event_id").cast("string")), "event_id")) - 1).alias("t"), (F.col("value") - F.avg("value").over(w)).alias("x")), "white")
    longest = white.agg(F.max("t")).first()[0] or 0
    # what a value adds to the k-th one after it, for each order
    step = F.when(F.col("k") == 0, 0.0).otherwise(F.ln((F.col("k") - 1 + F.col("order")) / F.col("k")))
    lags = spark.range(longest + 1).select(F.col("id").alias("k"), F.explode(F.array(*(F.lit(o) for o in ORDERS[1:]))).alias("order")).withColumn("w", F.exp(F.sum(step).over(Window.partitionBy("order").orderBy("k"))))
    later = white.select("user_id", F.col("t").alias("at")).join(white, "user_id").where("t <= at").withColumn("k", F.col("at") - F.col("t")).join(lags, "k")
    made = later.groupBy("user_id", "order", "at").agg(F.sum(F.col("w") * F.col("x")).alias("x")).unionByName(white.select("user_id", F.lit(ORDERS[0]).alias("order"), F.col("t").alias("at"), "x"))
    known = made.groupBy("user_id", (F.col("order") + 0.5).alias("h")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s.x).alias("samples"))
    return rounded(S.calibration_report(known.select("h", "samples"), USER_SCALES), "r", "bias", "slope", "resid_sd", n=5)


# --- encoder side -------------------------------------------------------------------------------------------------------


@query("select vec_id as subject_id, 18 as cut, 80 as padded, round(list_sum(embedding[1:18]::double[]), 6) as head from embeddings")
def n1_fit_channels(spark, d):
    v = vectors(spark, d)
    c = S.fit_channels(v, "vec", 18).select("subject_id", F.size("vec").alias("cut"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("head"))
    return rounded(c.join(S.fit_channels(v, "vec", 80).select("subject_id", F.size("vec").alias("padded")), "subject_id"), "head")


@query("select vec_id as subject_id, 3 as patches, round(embedding[41]::double, 6) as third from embeddings")
def n2_patchify(spark, d):
    p = S.patchify(vectors(spark, d), "vec", 20)
    return rounded(p.select("subject_id", F.size("patches").alias("patches"), F.col("patches")[2][0].alias("third")), "third")


@query(f"with s as (select user_id, t // 16 as e, x from ({SIG})), m as (select user_id, e, avg(x) as m from s group by 1, 2 having count(*) = 16) select user_id as recording_id, round(avg(m), 9) as mean, count(*) as n_epochs from m group by 1")
def n3_embed_epochs(spark, d):
    e = S.epoch(arrays(spark, d), 16).select("recording_id", "epoch_idx", F.array("samples").alias("x"))
    g = S.embed_epochs(e, lambda b: b.mean(axis=2), 8)
    return rounded(g.select("recording_id", F.col("embedding")[0].alias("mean"), "n_epochs"), "mean", n=9)


@query(f"select cohort, y, feature, round(avg(v), 6) as v from ({LONGV}) group by 1, 2, 3")
def n4_pool_tokens(spark, d):
    p = S.pool_tokens(vectors(spark, d), ["cohort", "y"])
    return rounded(p.select("cohort", "y", F.posexplode("vec").alias("f", "v")).select("cohort", "y", F.col("f").cast("long").alias("feature"), "v"), "v")


@query(f"select cohort as encoder, round(stddev_pop(v), 6) as sd, count(*) as n from ({LONGV}) group by 1")
def n6_embedding_std(spark, d):
    return rounded(S.embedding_std(vectors(spark, d).withColumnsRenamed({"cohort": "encoder", "vec": "embedding"})), "sd")


@query(f"with s as (select user_id, t // 20 as e, x from ({SIG})) select user_id as recording_id, e as epoch_idx, round(sum(x), 6) as total from s where e < 2 group by 1, 2 having count(*) = 20")
def n7_sequence_windows(spark, d):
    e = S.epoch(arrays(spark, d), 20, most=2)
    return rounded(e.select("recording_id", F.col("epoch_idx").cast("long").alias("epoch_idx"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


def _tokens(spark, d):
    """Subjects of 64 vectors each: four windows of eight patches of two channels."""
    at = F.col("subject_id") % 64
    return vectors(spark, d).select(F.floor(F.col("subject_id") / 64).alias("subject_id"), F.floor(at / 16).cast("int").alias("window"), (F.floor(at / 2) % 8).cast("int").alias("patch"), (at % 2).cast("int").alias("ch_idx"), "vec")


TOKENS = f"tok as (select subject_id // 64 as s, (subject_id % 64) // 16 as w, ((subject_id % 64) // 2) % 8 as p, subject_id as id, v, feature from ({LONGV}))"


@query(f"with {TOKENS}, m as (select s, w, p, feature, avg(v) as v from tok group by 1, 2, 3, 4), a as (select s, w, p, sqrt(sum(v * v)) as x from m group by 1, 2, 3), b as (select s, w, p, avg(x) as x from (select s, w, p, id, sqrt(sum(v * v)) as x from tok group by 1, 2, 3, 4) group by 1, 2, 3), t as (select s, count(*) as n, max(x) as top from a group by 1), l as (select s, min(x) as low from b group by 1) select s as subject_id, n::int as n, round(top, 6) as top, round(low, 6) as low from t join l using (s)")
def n8_token_trajectories(spark, d):
    t = S.token_trajectories(_tokens(spark, d))
    return rounded(t.select("subject_id", F.size("pc1").alias("n"), F.array_max("norm_of_mean").alias("top"), F.array_min("mean_of_norm").alias("low")), "top", "low")


_ORDERS = "select s * 2 as k, i as t, x from base union all select s * 2 + 1, row_number() over (partition by s order by md5('0:' || s || ':' || i), i) - 1, x from base"


@query(f"with {TOKENS}, mean as (select s, w, p, feature, avg(v) as v from tok group by 1, 2, 3, 4), norm as (select s, w, p, sqrt(sum(v * v)) as x from mean group by 1, 2, 3), base as (select s, row_number() over (partition by s order by w, p) - 1 as i, x from norm qualify count(*) over (partition by s) >= 30), {_dfa_cte(_ORDERS, 'k', [3, 4, 5, 7, 9])} select a.k // 2 as subject_id, round(a.alpha, 6) as ordered, round(b.alpha, 6) as shuffled from dfa a join dfa b on b.k = a.k + 1 and a.k % 2 = 0")
def n9_order_control(spark, d):
    return rounded(S.order_control(S.token_trajectories(_tokens(spark, d)), "norm_of_mean", [3, 4, 5, 7, 9]), "ordered", "shuffled")


@query(f"with w as (select cohort, y, feature, avg(v) as v from ({LONGV}) group by 1, 2, 3) select cohort as subject_id, feature, round(avg(v), 6) as v from w group by 1, 2")
def n10_pooled_from_tokens(spark, d):
    p = S.pooled_from_tokens(vectors(spark, d).select(F.col("cohort").alias("subject_id"), F.col("y").alias("window"), "vec"))
    return rounded(p.select("subject_id", F.posexplode("vec").alias("f", "v")).select("subject_id", F.col("f").cast("long").alias("feature"), "v"), "v")


# --- cohorts, folds, metrics, estimators --------------------------------------------------------------------------------


@query(f"select subject_id, feature, round((v - avg(v) over w) / (stddev_pop(v) over w + 1e-8), 6) + 0.0 as v from ({LONGV}) window w as (partition by cohort, feature)")
def a1_persite_z(spark, d):
    z = T.persite_z(T.long_vectors(vectors(spark, d), ["subject_id", "cohort"], "vec"), "cohort")
    return rounded(z.select("subject_id", F.col("feature").cast("long").alias("feature"), "v"), "v")


@query(f"with l as ({LONGV}), f as (select feature, avg(v) as m, stddev_pop(v) as s from l where cohort = 'c0' group by 1) select subject_id, feature, round((v - m) / s, 6) + 0.0 as v from l join f using (feature) where cohort = 'c1'")
def a2_train_scaler(spark, d):
    long = T.long_vectors(vectors(spark, d), ["subject_id", "cohort"], "vec")
    z = T.apply_scaler(long.where("cohort = 'c1'"), T.fit_scaler(long.where("cohort = 'c0'")))
    return rounded(z.select("subject_id", F.col("feature").cast("long").alias("feature"), "v"), "v")


def _combat_cte(steps: int = 16) -> str:
    """CTEs that end in adjusted(subject_id, cohort, feature, v): the empirical-Bayes iteration step by step, each batch until it stands still."""
    parts = [f"""long as ({LONGV}), moments as (
  select cohort, feature, count(*) as n, avg(v) as mean, var_pop(v) as var from long group by 1, 2
), pooled as (
  select feature, sum(n * mean) / sum(n) as grand, case when sum(n * var) > 0 then sqrt(sum(n * var) / sum(n)) else 1 end as sd from moments group by 1
), z as (
  select cohort, feature, n, grand, sd, (mean - grand) / sd as g0, var * n / greatest(n - 1, 1) / sd / sd as d0 from moments join pooled using (feature)
), priors as (
  select *, avg(g0) over b as gbar, greatest(var_samp(g0) over b, 1e-12) as tau2, avg(d0) over b as m, greatest(var_samp(d0) over b, 1e-12) as s2 from z window b as (partition by cohort)
), eb0 as (
  select *, (2 * s2 + m * m) / s2 as a, (m * s2 + m * m * m) / s2 as b, g0 as g, greatest(d0, 1e-12) as d, false as done from priors
)"""]
    for k in range(steps):
        parts.append(f"""moved{k} as (
  select *, (0.5 * ((n - 1) * d0 + n * (g0 - g2) * (g0 - g2)) + b) / (n / 2.0 + a - 1) as d2 from (select *, (tau2 * n * g0 + d * gbar) / (tau2 * n + d) as g2 from eb{k})
), eb{k + 1} as (
  select * exclude (g, d, done, g2, d2, change), case when done then g else g2 end as g, case when done then d else d2 end as d, done or change < 1e-4 as done
  from (select *, max(greatest(abs(g2 - g) / greatest(abs(g), 1e-12), abs(d2 - d) / d)) over (partition by cohort) as change from moved{k})
)""")
    parts.append(f"""adjusted as (
  select subject_id, cohort, l.feature, sd * ((v - grand) / sd - g) / sqrt(greatest(d, 1e-12)) + grand as v from long l join eb{steps} using (cohort, feature)
)""")
    return ", ".join(parts)


@query(f"with {_combat_cte()} select cohort, feature, round(avg(v), 6) + 0.0 as mean, round(stddev_pop(v), 6) as sd from adjusted group by 1, 2")
def a3_combat(spark, d):
    z = T.combat(T.long_vectors(vectors(spark, d), ["subject_id", "cohort"], "vec"), "cohort")
    return rounded(z.groupBy("cohort", F.col("feature").cast("long").alias("feature")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")), "mean", "sd")


@query()
def a4_pooled_pca(spark, d):
    p = T.pooled_pca(vectors(spark, d), 10)
    return p.select("subject_id", F.size("pcs").alias("k"), F.round(F.abs(F.col("pcs")[0]), 4).alias("first"))


@query(f"with {_combat_cte()}, scored as (select cohort, (v - avg(v) over w) / (stddev_pop(v) over w + 1e-8) as v from long window w as (partition by cohort, feature)), every as (select 'raw' as regime, cohort, v from long union all select 'persite_z', cohort, v from scored union all select 'combat', cohort, v from adjusted) select regime, cohort, round(avg(v), 6) + 0.0 as mean, round(stddev_pop(v), 6) as sd, count(*) as n, null::varchar as note from every group by 1, 2")
def a5_regimes(spark, d):
    found, note = T.regimes(T.long_vectors(vectors(spark, d), ["subject_id", "cohort"], "vec"), "cohort")
    parts = [z.groupBy("cohort").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n")).select(F.lit(name).alias("regime"), "cohort", "mean", "sd", "n", F.lit(note).cast("string").alias("note")) for name, z in found.items() if z is not None]
    return rounded(reduce(DataFrame.unionByName, parts), "mean", "sd")


@query(f"with f as (select subject_id, (row_number() over (partition by y order by subject_id) - 1) % 5 as fold, y from ({VEC})) select fold, y, count(*) as n, min(subject_id) as first from f group by 1, 2")
def r1_assign_folds(spark, d):
    f = T.assign_folds(vectors(spark, d).drop("vec"), 5, "subject_id", stratify="y")
    return f.groupBy(F.col("fold").cast("long").alias("fold"), "y").agg(F.count("*").alias("n"), F.min("subject_id").alias("first"))


def _drawn(rows: str, n: int, seed: int) -> str:
    """CTEs that end in drawn: the columns of rows (with id), rep and w, how often a replicate draws the row."""
    weight = " + ".join(f"(u >= {c})::int" for c in T.POISSON)
    return f"""rows as ({rows}), digests as (
  select *, md5('{seed}:' || id || ':' || block) as d from rows, (select unnest(range({-(-n // T.DRAWS)})) as block)
), drawn as (
  select *, {weight} as w from (select *, block * {T.DRAWS} + k as rep, ('0x' || substr(d, 4 * k + 1, 4))::int as u from digests, (select unnest(range({T.DRAWS})) as k)) where rep < {n}
)"""


SCORED = "select doc_id as id, n_chars::double as score, quality as y from documents join labels using (doc_id)"


@query(f"with {_drawn(SCORED, 2000, 1)}, s as (select rep, score, sum(w * y) as p, sum(w * (1 - y)) as n from drawn group by 1, 2), c as (select *, coalesce(sum(n) over (partition by rep order by score rows between unbounded preceding and 1 preceding), 0) as b from s), v as (select rep, sum(p * (b + n / 2)) / sum(p) / sum(n) as value from c group by 1 having sum(p) > 0 and sum(n) > 0) select count(*) as n, round(quantile_cont(value, 0.025), 6) as lo, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.975), 6) as hi from v")
def r2_bootstrap_auroc(spark, d):
    s = scored(spark, d).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), F.col("quality").alias("y"))
    b = T.bootstrap_auroc(s, 2000, 1)
    return rounded(b.agg(F.count("*").alias("n")).join(T.percentile_ci(b, "value"), F.lit(True)), "lo", "median", "hi")


@query("with o as (select event_type, avg(value) as obs from events group by 1) select event_type, round((1 + count(*) filter (where value >= obs)) / (count(*) + 1), 6) as p_above, round((1 + count(*) filter (where value <= obs)) / (count(*) + 1), 6) as p_below from events join o using (event_type) group by 1")
def r4_permutation_p(spark, d):
    e = read(spark, d, "events")
    o = e.groupBy("event_type").agg(F.avg("value").alias("obs"))
    return rounded(T.permutation_p(e.join(o, "event_type"), ["event_type"], "value", "obs"), "p_above", "p_below")


@query("select lang, round(quantile_cont(n_chars, 0.025), 6) as lo, round(quantile_cont(n_chars, 0.5), 6) as median, round(quantile_cont(n_chars, 0.975), 6) as hi from documents group by 1")
def r5_percentile_ci(spark, d):
    return rounded(T.percentile_ci(read(spark, d, "documents"), "n_chars", "lang"), "lo", "median", "hi")


@query("with p as (select source, ((sum(n_chars) % 997) + 1) / 20000.0 as p from documents group by 1), r as (select source, p, least(1, max((m - i + 1) * p) over (order by p, source rows unbounded preceding)) as h from (select *, count(*) over () as m, row_number() over (order by p, source) as i from p)) select source, round(p, 6) as p, round(h, 6) as p_holm, h < 0.05 as reject from r")
def r7_holm(spark, d):
    p = read(spark, d, "documents").groupBy("source").agg(((F.sum("n_chars") % 997 + 1) / 20000.0).alias("p"))
    return rounded(T.holm(p, "p", None, "source"), "p", "p_holm")


@query()
def r6_gaussian_null(spark, d):
    """The out-of-fold AUROC of the vectors over that of Gaussian matrices as long and as wide, with the same labels and folds."""
    f = _folded(spark, d)
    real = T.auroc(T.svc_cv(f).withColumn("y", F.col("y").cast("int")), "pred", "y")
    return rounded(T.excess(real, T.svc_null(f, 20), "auroc"), "auroc", "null", "null_sd", "excess", n=4)


@query("with r as (select lang, quality as y, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as r from documents join labels using (doc_id)), g as (select lang, sum(r) filter (where y = 1) as s, count(*) filter (where y = 1) as p, count(*) filter (where y = 0) as n from r group by 1) select lang, case when p > 0 and n > 0 then round((s - p * (p + 1) / 2.0) / (p * n), 6) end as auroc from g")
def e1_auroc(spark, d):
    return rounded(T.auroc(scored(spark, d), "n_chars", "quality", "lang"), "auroc")


@query("with r as (select doc_id % 5 as fold, quality, avg(case when (case when n_chars > 1500 then 1 else 0 end) = quality then 1.0 else 0 end) as r from documents join labels using (doc_id) group by 1, 2), b as (select fold, avg(r) as b from r group by 1) select round(avg(b), 6) as mean, round(stddev_pop(b), 6) as sd from b")
def e2_balanced_accuracy(spark, d):
    s = scored(spark, d).withColumn("pred", (F.col("n_chars") > 1500).cast("int")).withColumn("fold", F.col("doc_id") % 5)
    return rounded(T.balanced_accuracy(s, "pred", "quality", "fold"), "mean", "sd")


@query("with m as (select *, avg(value) over (partition by user_id) as pred from events) select event_type, round(1 - sum((value - pred) * (value - pred)) / (var_pop(value) * count(*)), 6) as r2 from m group by 1")
def e3_r2(spark, d):
    e = read(spark, d, "events").withColumn("pred", F.avg("value").over(Window.partitionBy("user_id")))
    return rounded(T.r2(e, "value", "pred", "event_type"), "r2")


_FOLDS = "f as (select l_orderkey % 5 as fold, l_quantity::double as x, l_extendedprice::double as y from lineitem), s as (select k.fold, regr_slope(f.y, f.x) as b, regr_intercept(f.y, f.x) as a from f join (select unnest(range(5)) as fold) k on k.fold != f.fold group by k.fold)"


@query(f"with {_FOLDS} select fold, count(*) as n, round(1 - sum((y - a - b * x) * (y - a - b * x)) / (var_pop(y) * count(*)), 6) as r2 from f join s using (fold) group by 1")
def e4_ols_cv(spark, d):
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    p = T.ols_cv(li, "x", "y")
    return rounded(T.r2(p, "y", "pred", "fold").join(p.groupBy("fold").agg(F.count("*").alias("n")), "fold"), "r2")


@query("select l_returnflag, count(*) as n, round(corr(l_quantity::double, l_extendedprice::double), 6) as r from lineitem group by 1")
def e5_pearson(spark, d):
    li = read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return rounded(T.pearson(li, "x", "y", "l_returnflag").drop("p"), "r")


def _folded(spark, d):
    return T.assign_folds(vectors(spark, d), 5, "subject_id", stratify="y")


@query()
def e6_ridge_cv(spark, d):
    return rounded(T.r2(T.ridge_cv(_folded(spark, d)), "y", "pred"), "r2", n=4)


#: ridge on two features with a fixed penalty of 10, in closed form
_PAIR = "with v as (select vec_id as subject_id, vec_id % 5 as fold, embedding[1]::double as x1, embedding[2]::double as x2, embedding[3]::double as y from embeddings), f as (select k.fold, count(*) as n, avg(x1) as m1, avg(x2) as m2, avg(y) as my, stddev_pop(x1) as s1, stddev_pop(x2) as s2, count(*) + 10 as a, count(*) * corr(x1, x2) as b, count(*) * covar_pop(x1, y) / stddev_pop(x1) as g1, count(*) * covar_pop(x2, y) / stddev_pop(x2) as g2 from v join (select unnest(range(5)) as fold) k on k.fold != v.fold group by k.fold), p as (select subject_id, fold, y, my + (a * g1 - b * g2) / (a * a - b * b) * (x1 - m1) / s1 + (a * g2 - b * g1) / (a * a - b * b) * (x2 - m2) / s2 as pred from v join f using (fold))"


def _two_features(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("subject_id"), (F.col("vec_id") % 5).cast("int").alias("fold"), F.slice("embedding", 1, 2).cast("array<double>").alias("vec"), F.col("embedding")[2].cast("double").alias("y"))
    return T.ridge_cv(e, alphas=[10.0])


@query(_PAIR + " select subject_id, fold::int as fold, round(pred, 6) as pred from p")
def e6_ridge_fixed_penalty(spark, d):
    return rounded(_two_features(spark, d).select("subject_id", "fold", "pred"), "pred")


@query(_PAIR + f", {_drawn('select subject_id as id, pred, y from p', 2000, 0)}, r as (select rep, 1 - sum(w * (y - pred) * (y - pred)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)) as value from drawn group by 1) select round(quantile_cont(value, 0.025), 6) as lo, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.975), 6) as hi, (select round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) from p) as r2 from r")
def r8_bootstrap_r2(spark, d):
    p = _two_features(spark, d).select(F.col("subject_id").alias("id"), F.col("pred").alias("score"), "y")
    return rounded(T.percentile_ci(T.bootstrap_r2(p), "value").join(T.r2(p, "y", "score"), F.lit(True)), "lo", "median", "hi", "r2")


@query()
def e7_kernel_ridge_cv(spark, d):
    return rounded(T.r2(T.kernel_ridge_cv(_folded(spark, d)), "y", "pred"), "r2", n=4)


@query()
def e8_forest_probe(spark, d):
    return rounded(T.r2(T.tree_cv(_folded(spark, d), "forest"), "y", "pred"), "r2", n=4)


@query()
def e8_gbt_probe(spark, d):
    return rounded(T.r2(T.tree_cv(_folded(spark, d), "gbt"), "y", "pred"), "r2", n=4)


@query()
def e9_site_classifier(spark, d):
    f = T.assign_folds(vectors(spark, d).withColumn("y", F.substring("cohort", 2, 1).cast("int")), 5, "subject_id", stratify="y")
    return rounded(T.balanced_accuracy(T.site_classifier(f), "pred", "y", "fold"), "mean", "sd", n=4)


@query()
def e10_svc_rbf(spark, d):
    return rounded(T.auroc(T.svc_cv(_folded(spark, d)).withColumn("y", F.col("y").cast("int")), "pred", "y"), "auroc", n=4)


# --- experiments --------------------------------------------------------------------------------------------------------

FAMILIES = {"first": (0, 32), "both": (0, 64)}
PROBES = ("ridge", "ridge_pcs", "kernel_ridge", "gbt", "forest")


@query()
def x1_within_cohort(spark, d):
    return rounded(X.within_cohort(vectors(spark, d)), "auroc", n=4)


@query()
def x1_transfer_matrix(spark, d):
    return rounded(X.transfer_matrix(vectors(spark, d), FAMILIES), "auroc", "lo", "hi", n=4)


@query()
def x2_transfer_statistics(spark, d):
    return rounded(X.transfer_statistics(vectors(spark, d), FAMILIES, primary=("both",)), "point", "median", "lo", "hi", "null_mean", n=4)


@query()
def x3_multi_cohort_transfer(spark, d):
    return rounded(X.multi_cohort_transfer(vectors(spark, d), FAMILIES, n_perm=5000), "point", "median", "lo", "hi", "null_mean", n=4)


@query()
def x4_site_probe(spark, d):
    return rounded(X.site_report(vectors(spark, d).drop("y"), "cohort"), "mean", "sd", "chance", "null", "null_sd", "excess", n=4)


@query()
def x5_rescue(spark, d):
    return rounded(X.rescue(vectors(spark, d), {"both": (0, 64)}), "auroc", "lo", "hi", n=4)


def _encoders(spark, d):
    v = vectors(spark, d)
    t = v.select("subject_id", F.col("vec")[63].alias("full"), F.col("vec")[62].alias("short"))
    return {"a": v.select("subject_id", F.slice("vec", 1, 30).alias("vec")), "b": v.select("subject_id", F.slice("vec", 31, 30).alias("vec"))}, t


@query()
def x6_encoding_probe(spark, d):
    enc, t = _encoders(spark, d)
    return rounded(X.best_probe(X.encoding_probe(enc, t, ["full", "short"], probes=PROBES), {"dfa": ("full", "short")}), "r2", n=4)


@query()
def x7_residual_probe(spark, d):
    enc, t = _encoders(spark, d)
    return rounded(X.residual_probe(enc, t, "full", "short", probes=PROBES), "r2", n=4)


@query()
def x8_predicted_vs_true(spark, d):
    enc, t = _encoders(spark, d)
    return rounded(X.predicted_vs_true(enc, t, "full"), "y", "pred", n=4)


@query()
def x9_sequence_recovery(spark, d):
    # trajectories and pooled vectors of the first halves, against the exponents of the second ones
    half = F.floor(F.size("samples") / 2).cast("int")
    h = S.split_halves(arrays(spark, d), USER_SCALES[:4]).where("not isnan(alpha_1) and not isnan(alpha_2)").withColumn("samples", F.slice("samples", F.lit(1), half)).withColumnRenamed("recording_id", "subject_id")
    control = S.order_control(h.select("subject_id", F.col("samples").alias("pc1")), "pc1", USER_SCALES[:4], least=20)
    t = h.select("subject_id", F.col("alpha_2").alias("alpha"))
    pooled = S.epoch(h.select("subject_id", "samples"), 8).groupBy("subject_id").agg(F.avg(F.array_max("samples")).alias("a"), F.avg(F.array_min("samples")).alias("b"), F.avg(F.col("samples")[0]).alias("c")).select("subject_id", F.array("a", "b", "c").alias("vec"))
    return rounded(X.sequence_recovery(control, t, "alpha", pooled), "r", "p", "r2", "lo", "hi", n=4)
