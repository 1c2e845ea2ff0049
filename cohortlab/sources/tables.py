"""Reading and writing collections: recordings, manifests, embeddings, results, provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_signals(spark: SparkSession, path: str, cohort: str | None = None) -> DataFrame:
    """One row per (recording, channel); a cohort is a partition filter."""
    df = spark.read.parquet(path)
    return df if cohort is None else df.where(F.col("cohort") == cohort)


def read_manifest(spark: SparkSession, path: str, label_map: dict[str, int], splits: tuple[str, ...] = ("train_split", "validation_split", "test_split")) -> DataFrame:
    """subject_id, class_name, label, split_no, pos of a nested JSON manifest; splits in the given order, classes of label_map only."""
    raw = spark.read.json(path, multiLine=True)
    parts = [raw.select(F.lit(i).alias("split_no"), F.posexplode(s).alias("pos", "e")).select("split_no", "pos", F.col("e.serial").alias("subject_id"), F.col("e.class_name").alias("class_name")) for i, s in enumerate(splits) if s in raw.columns]
    if not parts:
        raise ValueError(f"the manifest has none of the splits {', '.join(splits)}")
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    table = F.create_map(*(F.lit(x) for kv in label_map.items() for x in kv))
    return df.withColumn("label", F.try_element_at(table, F.col("class_name"))).where("label is not null")


def labels_from_path(df: DataFrame, path: str, pos_groups: list[str], neg_groups: list[str], sites: list[str]) -> DataFrame:
    """Adds grp, site, subject_id, label from the parts of a path; rows without a wanted group are dropped.

    grp: first part that is a wanted group; site: first part among sites, else 'NA'; subject_id: first part that
    starts with 'sub-', else the file's stem."""
    parts = F.split(F.col(path), "/")
    first = lambda cond: F.try_element_at(F.filter(parts, cond), F.lit(1))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return (
        df.withColumn("grp", first(lambda x: x.isin(*pos_groups, *neg_groups)))
        .where("grp is not null")
        .withColumn("site", F.coalesce(first(lambda x: x.isin(*sites)), F.lit("NA")))
        .withColumn("subject_id", F.coalesce(first(lambda x: x.startswith("sub-")), stem))
        .withColumn("label", F.col("grp").isin(*pos_groups).cast("int"))
    )


def unify_embeddings(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One `embedding` array<double>: the first that isn't null of the columns in names that exist."""
    found = [F.col(n).cast("array<double>") for n in names if n in df.columns]
    return df.withColumn("embedding", F.coalesce(*found)).drop(*(n for n in names if n != "embedding"))


def explode_encoders(df: DataFrame, nested: str) -> DataFrame:
    """encoder, subject_id, embedding of a map<encoder, map<subject, vector>> column."""
    return df.select(F.explode(nested).alias("encoder", "m")).select("encoder", F.explode("m").alias("subject_id", "embedding")).withColumn("embedding", F.col("embedding").cast("array<double>"))


def read_embeddings(spark: SparkSession, path: str, names: tuple[str, ...] = ("embedding",), encoder: str | None = None) -> DataFrame:
    df = unify_embeddings(spark.read.parquet(path), names)
    return df if encoder is None else df.where(F.col("encoder") == encoder)


def write_cells(df: DataFrame, path: str, meta: dict[str, str], fmt: str = "parquet") -> None:
    """Results with their meta block as a column, as Parquet or JSON lines."""
    block = F.struct(*(F.lit(v).alias(k) for k, v in meta.items())) if meta else F.lit(None)
    df.withColumn("meta", block).write.mode("overwrite").format(fmt).save(path)


#: bytes of a file that a task holds at a time; files that one task reads, about
PIECE, FILES = 8 << 20, 16


def fingerprint_inputs(spark: SparkSession, paths: list[tuple[str, str]], allowed_roots: list[str]) -> DataFrame:
    """path, role, sha256, size_bytes of existing inputs; a path outside all roots is an error, a missing one is skipped.

    Paths are rows of one plan; tasks stream their files in pieces, so neither many files nor large ones matter. Plain paths
    and URIs that pyarrow knows are read where the tasks run."""
    for p, _ in paths:
        if ".." in p.split("/") or not any(p.startswith(r.rstrip("/") + "/") for r in allowed_roots):
            raise ValueError(f"not under an allowed root: {p}")

    def run(batches):
        import hashlib

        import pandas as pd
        from pyarrow import fs

        for b in batches:
            rows = []
            for path, role in zip(b["path"], b["role"], strict=True):
                store, name = fs.FileSystem.from_uri(path)
                if store.get_file_info(name).type != fs.FileType.File:
                    continue
                digest, size = hashlib.sha256(), 0
                with store.open_input_stream(name) as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                rows.append((path, role, digest.hexdigest(), size))
            yield pd.DataFrame(rows, columns=["path", "role", "sha256", "size_bytes"])

    listed = spark.createDataFrame([(p, r) for p, r in paths], "path string, role string")
    return listed.repartition(max(1, -(-len(paths) // FILES)), "path").mapInPandas(run, "path string, role string, sha256 string, size_bytes long")


def incremental_targets(signals: DataFrame, cached: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "subject_id") -> DataFrame:
    """Cached targets and those computed for the subjects that aren't cached."""
    return cached.unionByName(compute(signals.join(cached.select(key), key, "left_anti")))


def cohort_inventory(files: DataFrame, grp: str = "grp", site: str = "site", ext: str = "ext", data_ext: str = "set") -> DataFrame:
    """grp, site, ext, n: files by extension, and data files by group and by site, in one pass by grouping sets."""
    spark = files.sparkSession
    view = files.select(F.col(grp).alias("grp"), F.col(site).alias("site"), F.col(ext).alias("ext"))
    return spark.sql(
        f"""select grp, site, ext, case when grouping(ext) = 0 then count(*) else count_if(e = '{data_ext}') end as n
        from (select grp, site, ext, ext as e from {{v}}) group by grouping sets ((grp), (site), (ext))""",
        v=view,
    )


def suffix(col: Column) -> Column:
    """Lower-case extension of a path or URL, empty without one."""
    return F.lower(F.regexp_extract(col, r"\.([A-Za-z0-9]+)$", 1))
