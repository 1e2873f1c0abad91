"""Statistics over a job log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.text import failure_category

RUNNING = ("running", "dispatching")


def queue_stats(jobs: DataFrame, dead_letters: DataFrame | None = None) -> DataFrame:
    """One row: jobs in all and by state; dead_letter counts the rows of a dead-letter table, 0 without one."""
    state = F.col("status")
    one = jobs.agg(
        F.count("*").alias("total"), F.count_if(state == "queued").alias("queued"), F.count_if(state.isin(*RUNNING)).alias("running"),
        F.count_if(state == "completed").alias("completed"), F.count_if(state == "failed").alias("failed"), F.count_if(state == "aborted").alias("aborted"),
    )
    if dead_letters is None:
        return one.withColumn("dead_letter", F.lit(0).cast("long"))
    return one.crossJoin(dead_letters.agg(F.count("*").alias("dead_letter")))  # one row each


def dashboard(jobs: DataFrame) -> DataFrame:
    """One row: jobs, those that run, failed or are done, and the rows they quarantined."""
    state = F.col("status")
    return jobs.agg(
        F.count("*").alias("n_jobs"), F.count_if(state.isin("queued", *RUNNING)).alias("n_open"), F.count_if(state == "completed").alias("n_done"),
        F.count_if(state == "failed").alias("n_failed"), F.coalesce(F.sum("n_quarantined"), F.lit(0)).cast("long").alias("n_quarantined"),
    )


def health(runs: DataFrame, parser: str = "file", order: str = "run") -> DataFrame:
    """A row a parser: runs, passes, failures since its last pass, and the last failure's reason, in one aggregate and one join back of the failures."""
    last = runs.groupBy(parser).agg(
        F.count("*").alias("n_runs"), F.count_if("passed").alias("n_passed"), F.max(F.when(F.col("passed"), F.col(order))).alias("last_pass"),
        F.max_by("error", F.when(~F.col("passed"), F.col(order))).alias("last_reason"),
    )
    tail = runs.where(~F.col("passed")).select(F.col(parser).alias("p"), F.col(order).alias("o"))
    both = last.join(tail, F.col(parser) == F.col("p"), "left")
    late = F.col("o").isNotNull() & (F.col("last_pass").isNull() | (F.col("o") > F.col("last_pass")))
    return both.groupBy(parser, "n_runs", "n_passed", "last_reason").agg(F.count_if(late).alias("n_consecutive"))


def failure_samples(runs: DataFrame, most: int = 3) -> DataFrame:
    """A row a category: failures, its share of all, whether it is the most common (the first in name of equals), and its `most` least distinct error texts."""
    bad = runs.where(~F.col("passed")).withColumn("category", failure_category(F.col("error")))
    texts = bad.groupBy("category", "error").agg(F.count("*").alias("n"))  # distinct texts; a window keeps the least few of each partition
    w = W.partitionBy("category").orderBy("error")
    few = texts.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most).groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("error")), "|").alias("samples"))
    per = texts.groupBy("category").agg(F.sum("n").alias("n_failures"))
    total = per.agg(F.sum("n_failures").alias("total"), F.min_by("category", F.struct(-F.col("n_failures"), "category")).alias("modal"))
    out = per.join(few, "category").crossJoin(F.broadcast(total))  # seven categories at most, and one row
    return out.select("category", "n_failures", F.round(F.col("n_failures") / F.col("total"), 6).alias("share"), (F.col("category") == F.col("modal")).alias("most_common"), "samples")


def top_failing(runs: DataFrame, k: int = 10, file: str = "file") -> DataFrame:
    return runs.where(~F.col("passed")).groupBy(file).agg(F.count("*").alias("n_failures")).orderBy(F.desc("n_failures"), file).limit(k)
