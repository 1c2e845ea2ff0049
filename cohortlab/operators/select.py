"""Names, montages, gates, tasks, samples and joins of subjects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import first_of, rank

#: fixed values: the montage in order, and old names of electrodes
MONTAGE = ["FP1", "FP2", "F3", "F4", "C3", "C4", "P3", "P4", "O1", "O2", "F7", "F8", "T3", "T4", "T5", "T6", "FZ", "CZ", "PZ"]
#: electrodes of a cap at most
CAP = 4096
ALIASES = {"T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8", "A1": "M1", "A2": "M2"}


def normalise_channel(col: Column) -> Column:
    out = F.upper(col)
    for junk in ("-AVG", "-REF", "EEG "):
        out = F.replace(out, F.lit(junk), F.lit(""))
    return F.trim(out)


def resolve_alias(col: Column, known: list[str]) -> Column:
    """The alias if known, else the name if known, the first known part (as its alias) of a compound name, else unchanged."""
    table = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    alias = lambda c: F.coalesce(F.try_element_at(table, c), c)
    up = F.upper(col)
    parts = F.transform(F.split(up, "-"), alias)
    return F.when(alias(up).isin(*known), alias(up)).when(up.isin(*known), up).otherwise(F.coalesce(F.try_element_at(F.filter(parts, lambda x: x.isin(*known)), F.lit(1)), col))


def select_montage(signals: DataFrame, montage: list[str] = MONTAGE, rec: str = "recording_id", channel: str = "channel", order: str = "pos") -> DataFrame:
    """The montage's channels with ch_idx, of recordings that have all of them; of equal names the last wins, others go."""
    names = F.array(*(F.lit(m) for m in montage))
    df = signals.withColumn("__n", normalise_channel(F.col(channel))).where(F.col("__n").isin(*montage))
    rest = [c for c in signals.columns if c not in (rec, channel)]
    last = df.groupBy(rec, "__n").agg(F.max_by(F.struct(*rest), order).alias("v"))
    full = last.groupBy(rec).agg(F.count("*").alias("k")).where(F.col("k") == len(montage)).select(rec)
    return last.join(full, rec, "left_semi").select(rec, F.col("__n").alias(channel), (F.array_position(names, F.col("__n")) - 1).cast("int").alias("ch_idx"), "v.*")


def nearest_electrode(montage_pos: DataFrame, cap_pos: DataFrame) -> DataFrame:
    """name -> nearest, dist: the closest label of the cap; ties go to the least ord. The cap is a list of electrodes: over CAP of them is an error."""
    if cap_pos.limit(CAP + 1).count() > CAP:
        raise ValueError(f"a cap has {CAP} electrodes at most")
    a = montage_pos.select(F.col("name"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    d = F.sqrt(sum(((F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in "xyz"), F.lit(0.0)))
    pairs = a.join(F.broadcast(cap_pos.select(F.col("name").alias("label"), "x", "y", "z", "ord")), F.lit(True))
    return pairs.groupBy("name").agg(F.min(F.struct(d.alias("dist"), "ord", "label")).alias("m")).select("name", F.col("m.label").alias("nearest"), F.col("m.dist").alias("dist"))


def duration_gate(signals: DataFrame, n: int, samples: str = "samples") -> DataFrame:
    """The first n samples; shorter rows go."""
    return signals.where(F.size(samples) >= n).withColumn(samples, F.slice(samples, 1, n))


def binary_task(df: DataFrame, col: str, pos: list, neg: list) -> DataFrame:
    return df.where(F.col(col).isin(*pos, *neg)).withColumn("y", F.col(col).isin(*pos).cast("int"))


def head_per_class(df: DataFrame, n: int, cls: str, *order: str) -> DataFrame:
    """The first n rows of each class, with rank_in_class; a class is ranked in parts, and only their first n rows together."""
    return first_of(df, n, list(order), cls, "rank_in_class")


def head_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cap_sample(df: DataFrame, cap: int, seed: int, key: str) -> DataFrame:
    """A seeded sample of `cap` rows without replacement, by a digest of key and seed: the same under any partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(cap).orderBy(key)


def balance_cohorts(df: DataFrame, cohort: str, *order: Column | str, key: str = "subject_id") -> DataFrame:
    """Each cohort cut to the smallest one's size, by the given order. Ranks are taken on keys alone; the rows follow by a semi-join."""
    least = df.groupBy(cohort).count().agg(F.min("count").alias("__cap"))
    cols = [F.expr(o) if isinstance(o, str) else o for o in order]
    keys = df.select(cohort, key, *(c.alias(f"__o{i}") for i, c in enumerate(cols)))
    kept = rank(keys, [f"__o{i}" for i in range(len(cols))], [cohort], "__r").join(F.broadcast(least), F.col("__r") <= F.col("__cap")).select(key)
    return df.join(kept, key, "left_semi")


def finite_only(df: DataFrame, *cols: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in cols)))


def assemble_cohort(features: DataFrame, labels: DataFrame, *embeddings: DataFrame, key: str = "subject_id") -> DataFrame:
    """Inner joins on the subject: one missing anywhere is dropped."""
    return reduce(lambda a, b: a.join(b, key), [labels, *embeddings], features)


def common_subjects(embeddings: DataFrame, encoders: list[str], key: str = "subject_id", targets: DataFrame | None = None) -> DataFrame:
    """Subjects that all encoders have (and targets); keys only, so wide vectors aren't shuffled."""
    ids = embeddings.where(F.col("encoder").isin(*encoders)).select(key, "encoder").distinct().groupBy(key).count().where(F.col("count") == len(encoders)).select(key)
    return ids if targets is None else ids.join(targets, key, "left_semi")


def labelled_embeddings(emb: DataFrame, labels: DataFrame, key: str = "subject_id") -> DataFrame:
    return emb.join(labels, key).orderBy(key)


def stack_cohorts(held_out: str | None = None, **cohorts: DataFrame) -> DataFrame:
    """All cohorts with their name; held_out is left out."""
    return reduce(DataFrame.unionByName, (df.withColumn("cohort", F.lit(n)) for n, df in cohorts.items() if n != held_out))


def attrition(stages: dict[str, DataFrame], key: str = "recording_id") -> DataFrame:
    """stage, n: distinct keys left after each stage."""
    return reduce(DataFrame.unionByName, (df.agg(F.countDistinct(key).alias("n")).select(F.lit(s).alias("stage"), "n") for s, df in stages.items()))
