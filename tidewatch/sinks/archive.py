"""Sealed runs: file digests, chained from run to run, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seal(files: DataFrame) -> DataFrame:
    """(path, sha256) of rows (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): ok, MISMATCH, MISSING, or EXTRA where nothing was sealed."""
    now = seal(files).withColumnRenamed("sha256", "now")
    status = F.when(F.col("now").isNull(), "MISSING").when(F.col("sha256").isNull(), "EXTRA").when(F.col("now") == F.col("sha256"), "ok").otherwise("MISMATCH")
    return manifest.join(now, "path", "full_outer").select("path", status.alias("status"))


def verify_chain(runs: DataFrame) -> DataFrame:
    """(run_id, ok): whether each run of (run_id, files_sha256, chain_hash) links
    to the one before: sha256(previous chain_hash || files_sha256)."""
    # One row a run: the archive's own index, not data.
    before = F.coalesce(F.lag("chain_hash").over(Window.orderBy("run_id")), F.lit(""))
    return runs.select("run_id", (F.sha2(F.concat(before, "files_sha256"), 256) == F.col("chain_hash")).alias("ok"))


def chained(runs: DataFrame) -> DataFrame:
    """(run_id, files_sha256, chain_hash) of (run_id, files_sha256): every run's link
    to the one before. The archive's index, a row a run, is one array: each link
    takes the hash of the last, which no other order can make."""
    index = runs.agg(F.array_sort(F.collect_list(F.struct("run_id", "files_sha256"))).alias("runs"))
    start = F.array().cast("array<struct<run_id: string, files_sha256: string, chain_hash: string>>")

    def link(done, run):
        before = F.when(F.size(done) > 0, F.element_at(done, -1)["chain_hash"]).otherwise("")
        own = F.struct(run["run_id"].alias("run_id"), run["files_sha256"].alias("files_sha256"), F.sha2(F.concat(before, run["files_sha256"]), 256).alias("chain_hash"))
        return F.concat(done, F.array(own))

    return index.select(F.inline(F.aggregate("runs", start, link)))
