"""Files that are written and read back: checked lines, page bodies, versioned and content-addressed folders, snapshots, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import legal
from statuta.runtime import shared_dir

# The line that ends a page's navigation, the heading of a trailing contents list, and editors' notes.
NAVIGATION, CONTENTS = "Tải về", "mục lục"
NOTES = ["Điều khoản được sửa đổi, bổ sung", "Điều khoản được bổ sung"]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checked_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``error``: the line itself where it is no JSON object of these types, else null."""
    found = spark.read.schema(f"{schema}, error string").option("columnNameOfCorruptRecord", "error").option("mode", "PERMISSIVE").json(path)
    return found


def body_lines(text: Column) -> Column:
    """A page's lines after its last navigation line, up to a contents list that follows an article, without editors' notes."""
    lines = F.split(text, "\r?\n|\r")
    numbered = F.transform(lines, lambda x, i: F.when(F.trim(x) == NAVIGATION, i + 1).otherwise(0))
    body = F.slice(lines, F.coalesce(F.array_max(numbered), F.lit(0)) + 1, F.greatest(F.size(lines), F.lit(1)))
    first = F.array_position(F.transform(body, lambda x: F.trim(x).rlike(r"(?iu)^Điều\s+\d+\b")), True)
    ends = F.filter(F.transform(body, lambda x, i: F.when((F.lower(F.trim(x)) == CONTENTS) & (first > 0) & (i + 1 > first), i)), lambda i: i.isNotNull())
    kept = F.when(F.size(ends) > 0, F.slice(body, F.lit(1), F.get(ends, F.lit(0)))).otherwise(body)
    return F.filter(kept, lambda x: ~F.trim(x).isin(NOTES))


def projection(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of ``ids(id)`` and the edges between them."""
    some = ids.select("id").distinct()
    ends = edges.join(some.withColumnRenamed("id", "head_id"), "head_id", "left_semi").join(some.withColumnRenamed("id", "tail_id"), "tail_id", "left_semi")
    return nodes.join(some, "id", "left_semi"), ends


def _path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Hadoop objects, so that any store that Spark can write is reached."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Takes a file or folder away, if it is there."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _rename(spark: SparkSession, old: str, new: str, overwrite: bool) -> None:
    """One rename within a store; without ``overwrite`` it fails where the target is there."""
    jvm = spark._jvm
    a, _ = _path(spark, old)
    b, _ = _path(spark, new)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if overwrite else jvm.org.apache.hadoop.fs.Options.Rename.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), spark._jsc.hadoopConfiguration()).rename(a, b, options)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder's write was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def row_digest(rows: DataFrame) -> str:
    """A sha256 of the rows whatever their order, each as often as it occurs.

    Rows are hashed and counted, hashes with the same beginning are sorted and hashed together, and so are those hashes, so no task holds more than a share of them.
    """
    line = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    level = rows.select(line.alias("h")).groupBy("h").agg(F.count(F.lit(1)).cast("string").alias("n")).select("h", F.concat_ws(":", "h", "n").alias("x"))
    for width in (5, 2, 0):
        key = F.substring("h", 1, width) if width else F.lit("")
        level = level.groupBy(key.alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "h", "x"))), "\n").cast("binary"), 256).alias("x"))
    found = level.first()
    return found["x"] if found else "0" * 64


def publish_by_content(rows: DataFrame, root: str) -> str:
    """Writes rows under the digest of their content, once; the digest is the build's name.

    A build is written aside and gets its name by one rename after its write was committed.  What a broken job left under the name is taken away first; a
    build that is there whole is not written again, and of two jobs that write the same build the second leaves the first's.
    """
    spark = rows.sparkSession
    build = row_digest(rows)
    target = f"{root}/build_id={build}"
    if complete(spark, target):
        return build
    aside = f"{root}/_aside-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    if not complete(spark, aside):
        raise OSError(f"the write of {aside} was not committed")
    if not complete(spark, target):
        delete(spark, target)
    try:
        _rename(spark, aside, target, overwrite=False)
    except Exception:
        if not complete(spark, target):
            raise
        delete(spark, aside)
    return build


def load_build(spark: SparkSession, root: str, build: str) -> DataFrame:
    if not complete(spark, f"{root}/build_id={build}"):
        raise FileNotFoundError(f"no whole build {build}")
    return spark.read.parquet(f"{root}/build_id={build}")


def replace(rows: DataFrame, root: str, kind: str = "parquet", **options: str) -> str:
    """Replaces what ``current`` reads: the new version is written aside, and once its write is committed one rename switches the pointer to it.

    Readers see the old version whole or the new one; a job that fails before the switch changes nothing.  Returns the version's name.
    """
    spark = rows.sparkSession
    version = uuid.uuid4().hex
    folder = f"{root}/versions/{version}"
    rows.write.options(**options).format(kind).save(folder)
    if not complete(spark, folder):
        raise OSError(f"the write of {folder} was not committed")
    point(spark, root, version)
    return version


def point(spark: SparkSession, root: str, version: str) -> None:
    """Switches the pointer to a version by one rename."""
    aside = f"{root}/_next-{version}"
    p, fs = _path(spark, aside)
    out = fs.create(p, True)
    out.write(bytearray(version.encode()))
    out.close()
    _rename(spark, aside, f"{root}/CURRENT", overwrite=True)


def current(spark: SparkSession, root: str) -> str:
    """The folder of the version that the pointer names."""
    version = spark.read.text(f"{root}/CURRENT").first()
    if version is None or not complete(spark, f"{root}/versions/{version[0]}"):
        raise FileNotFoundError(f"{root} has no whole current version")
    return f"{root}/versions/{version[0]}"


def clean_up(spark: SparkSession, root: str) -> list[str]:
    """Takes away what broken jobs left beside the current version: half-written versions, pointers and builds.  Names what went; no job may be writing."""
    gone = [f"versions/{v}" for v in _children(spark, f"{root}/versions") if not complete(spark, f"{root}/versions/{v}")]
    gone += [c for c in _children(spark, root) if c.startswith(("_next-", "_aside-")) or (c.startswith("build_id=") and not complete(spark, f"{root}/{c}"))]
    for name in gone:
        delete(spark, f"{root}/{name}")
    return gone


def replace_text(spark: SparkSession, root: str, text: str) -> None:
    """Replaces a text as a whole: readers see the old one or the new one."""
    replace(spark.createDataFrame([(text,)], "value string").coalesce(1), root, "text", lineSep="\n")


def read_text(spark: SparkSession, root: str) -> DataFrame:
    """``value``: the text as it was given."""
    return spark.read.text(current(spark, root), wholetext=True).select(F.regexp_replace("value", r"\n\z", "").alias("value"))


def write_snapshot(counts: DataFrame, path: str) -> None:
    """One JSON row."""
    counts.coalesce(1).write.mode("errorifexists").json(path)


def quality_markdown(counts: DataFrame, names: list[str]) -> DataFrame:
    """``report``: one row of figures as a Markdown table."""
    lines = [F.concat(F.lit(f"| {n} | "), F.coalesce(F.col(n).cast("string"), F.lit("–")), F.lit(" |")) for n in names]
    return counts.select(F.concat_ws("\n", F.lit("| metric | value |"), F.lit("|-|-|"), *lines).alias("report"))


def write_embeddings(units: DataFrame, vectors: DataFrame, dimension: int, model: str) -> tuple[DataFrame, DataFrame]:
    """``units(id, content_hash)`` with their new vectors and state, and the vectors refused: ``id, reason``.

    A vector counts if it has the dimension, its unit is there, and the content that it was made of is the unit's.
    """
    reason = F.when(F.size("vector") != dimension, "dimension").when(F.col("_there").isNull(), "unknown_unit").when(F.col("made_of").isNull(), "no_content_hash").when(F.col("made_of") != F.col("content_hash"), "stale")
    judged = vectors.join(units.select("id", "content_hash", F.lit(True).alias("_there")), "id", "left").withColumn("reason", reason)
    fine = judged.where("reason is null").select("id", "vector", F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), "made_of")
    return units.join(fine, "id", "left"), judged.where("reason is not null").select("id", "reason")


def inferred_manifest(rows: DataFrame) -> DataFrame:
    """``code, title, number`` with ``graph_id`` and ``doc_type``: the number's words as an id, else the title's, else the code."""
    from statuta.functions import strings

    named = F.coalesce(legal.blank_as_null(strings.slug(F.coalesce("number", F.lit("")))), F.regexp_replace(legal.blank_as_null(F.substring(strings.slug(F.coalesce("title", F.lit(""))), 1, 40)), "_+$", ""), F.lower("code"))
    return rows.withColumns({"graph_id": named, "doc_type": legal.type_of_title(F.col("title"))})
