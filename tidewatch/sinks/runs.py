"""Saved runs: tables below one folder, sealed, listed, loaded and deleted.

``files/<run_id>/<table>`` holds JSON lines, ``manifest`` the digest of each
file, ``index`` one row a run with its chain hash, ``deleted`` the ids of runs
whose files are gone. Index and manifest rows stay, so that the chain can still
be checked and a deleted run shows as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sinks import archive

INDEX = "run_id string, saved_at string, note string, files_sha256 string, chain_hash string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _files(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """(path below the run, content)."""
    at = f"{root}/files/{run_id}"
    if not _exists(spark, at):
        return spark.createDataFrame([], "path string, content binary")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(at)
    return read.select(F.substring_index("path", f"/files/{run_id}/", -1).alias("path"), "content")


def _index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INDEX).json(f"{root}/index") if _exists(spark, f"{root}/index") else spark.createDataFrame([], INDEX)


def _manifest_digests(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, files_sha256): the digest of each run's manifest lines, of which a
    run has as many as files."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256"))), "\n")
    return spark.read.parquet(f"{root}/manifest").groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.sha2(lines, 256).alias("files_sha256"))


def save_run(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame], note: str = "", saved_at: str = "") -> str:
    """Write and seal a run, and link it to the latest; returns its chain hash.
    Ids must be new and in order: the chain follows them."""
    latest = _index(spark, root).agg(F.max_by("chain_hash", "run_id"), F.max("run_id")).first()
    if latest[1] is not None and run_id <= latest[1]:
        raise ValueError(f"run {run_id} does not come after {latest[1]}")
    for name, rows in tables.items():
        rows.write.mode("errorifexists").json(f"{root}/files/{run_id}/{name}")
    sealed = archive.seal(_files(spark, root, run_id)).withColumn("run_id", F.lit(run_id))
    sealed.write.mode("append").partitionBy("run_id").parquet(f"{root}/manifest")
    whole = _manifest_digests(spark, root).where(F.col("run_id") == run_id).select("files_sha256")
    row = whole.select(F.lit(run_id).alias("run_id"), F.lit(saved_at).alias("saved_at"), F.lit(note).alias("note"), "files_sha256",
                       F.sha2(F.concat(F.lit(latest[0] or ""), "files_sha256"), 256).alias("chain_hash")).persist()
    row.coalesce(1).write.mode("append").json(f"{root}/index")
    return row.first()["chain_hash"]


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs whose files are kept, latest first."""
    rows = _index(spark, root)
    if _exists(spark, f"{root}/deleted"):
        rows = rows.join(spark.read.schema("run_id string").json(f"{root}/deleted"), "run_id", "left_anti")
    return rows.orderBy(F.desc("run_id"))


def load_run(spark: SparkSession, root: str, run_id: str, tables: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.json(f"{root}/files/{run_id}/{name}") for name in tables}


def verify_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """(path, status) of each file of a run, against its manifest."""
    sealed = spark.read.parquet(f"{root}/manifest").where(F.col("run_id").cast("string") == run_id).drop("run_id")
    return archive.verify(sealed, _files(spark, root, run_id))


def verify_chain(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, ok): whether a run links to the one before and its manifest is
    still the one that was sealed."""
    index = _index(spark, root)
    linked = archive.verify_chain(index).join(index.select("run_id", "files_sha256"), "run_id")
    now = _manifest_digests(spark, root).withColumnRenamed("files_sha256", "now") if _exists(spark, f"{root}/manifest") else index.select("run_id", F.lit(None).cast("string").alias("now")).limit(0)
    return linked.join(now, "run_id", "left").select("run_id", (F.col("ok") & F.coalesce(F.col("now") == F.col("files_sha256"), F.lit(False))).alias("ok"))


def delete_run(spark: SparkSession, root: str, run_id: str) -> bool:
    """Delete a run's files; false if it has none."""
    if not _exists(spark, f"{root}/files/{run_id}"):
        return False
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/files/{run_id}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark.createDataFrame([(run_id,)], "run_id string").coalesce(1).write.mode("append").json(f"{root}/deleted")
    return True
