"""Table sinks: merges, guarded bundle writes, decision folders, versioned folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.runtime import checkpointed
from statuta.sources import stores


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; a null in ``new`` leaves the old value."""
    rest = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in rest])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce(f"_n_{c}", c).alias(c) for c in rest])


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends exist; others write nothing."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "head_id"), "head_id", "left_semi").join(ids.withColumnRenamed("id", "tail_id"), "tail_id", "left_semi")


def whole_bundles(edges: DataFrame, nodes: DataFrame, bundle: str, expected: str) -> DataFrame:
    """All rows of the bundles that are complete and whose ends all exist, none of the others'."""
    ids = nodes.select(F.col("id").alias("_id")).distinct().withColumn("_known", F.lit(1))
    seen = edges.join(ids, F.col("tail_id") == F.col("_id"), "left")
    fine = seen.groupBy(bundle).agg(F.count(F.lit(1)).alias("_n"), F.count("_known").alias("_k"), F.max(expected).alias("_e")).where("_n = _k and _n = _e")
    return edges.join(fine.select(bundle), bundle, "left_semi")


def write_decisions(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines for each decision; what is there stays."""
    rows.write.mode("append").partitionBy("decision").json(path)


def publish(rows: DataFrame, root: str, run_id: str) -> str:
    """Writes a version under its run's name, and only once that is committed switches the pointer to it by one rename."""
    target = f"{root}/versions/{run_id}"
    rows.write.mode("errorifexists").parquet(target)
    stores.point(rows.sparkSession, root, run_id)
    return target


def current_version(spark: SparkSession, root: str) -> DataFrame:
    """The version that the pointer names."""
    return spark.read.parquet(stores.current(spark, root))


def write_bundles(edges: DataFrame, root: str, nodes: DataFrame, bundle: str = "bundle_id", expected: str = "expected") -> DataFrame:
    """Adds the edges of whole bundles to a stored table, all of a bundle or none, and gives ``bundle, status``.

    ``edges`` is the bundle, ``head_id, type, tail_id, relation_id`` and the number expected.  A bundle is refused that is INCOMPLETE or has a MISSING_END, that would
    change what is stored for it (TARGET_CHANGED: other targets; PARTLY_STORED: some of them), or whose relation ids are another bundle's (CONFLICT); one that is stored
    whole already is UNCHANGED; the others are WRITTEN in one switch of versions.
    """
    spark = edges.sparkSession
    columns = [bundle, "head_id", "type", "tail_id", "relation_id"]
    stored = spark.read.parquet(stores.current(spark, root)) if stores.exists(spark, f"{root}/CURRENT") else edges.select(*columns).limit(0)
    ids = nodes.select(F.col("id").alias("_id")).distinct().withColumn("_known", F.lit(1))
    ends = edges.join(ids.select(F.col("_id").alias("tail_id"), F.col("_known").alias("_t")), "tail_id", "left").join(ids.select(F.col("_id").alias("head_id"), F.col("_known").alias("_h")), "head_id", "left")
    had = stored.groupBy(bundle).agg(F.array_sort(F.collect_set("relation_id")).alias("_had"))
    taken = stored.select("relation_id", F.col(bundle).alias("_other"))
    clash = edges.join(taken, "relation_id").where(F.col(bundle) != F.col("_other")).select(bundle).distinct().withColumn("_clash", F.lit(True))
    state = ends.groupBy(bundle).agg(F.count(F.lit(1)).alias("_n"), F.max(expected).alias("_e"), F.count("_t").alias("_nt"), F.count("_h").alias("_nh"), F.array_sort(F.collect_set("relation_id")).alias("_new"))
    judged = state.join(had, bundle, "left").join(clash, bundle, "left")
    status = (
        F.when(F.coalesce(F.col("_n") != F.col("_e"), F.lit(True)) | (F.size("_new") != F.col("_n")), "INCOMPLETE").when((F.col("_nt") < F.col("_n")) | (F.col("_nh") < F.col("_n")), "MISSING_END")
        .when(F.col("_had") == F.col("_new"), "UNCHANGED").when(F.size(F.array_except("_had", "_new")) > 0, "TARGET_CHANGED").when(F.size("_had") > 0, "PARTLY_STORED").when(F.col("_clash"), "CONFLICT").otherwise("WRITTEN")
    )
    verdict = checkpointed(judged.select(bundle, status.alias("status")))
    fresh = edges.join(verdict.where("status = 'WRITTEN'").select(bundle), bundle, "left_semi").select(*columns)
    if verdict.where("status = 'WRITTEN'").limit(1).count():
        stores.replace(stored.unionByName(fresh), root)
    return verdict
