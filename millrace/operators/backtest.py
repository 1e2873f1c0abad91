"""Parser quality over a log of runs: failure categories, health, islands of failures, plateaus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.text import failure_category
from millrace.operators.contract import ERROR
from millrace.operators.staging import staged


def iteration_metrics(runs: DataFrame, by: str) -> DataFrame:
    return runs.groupBy(by).agg(F.count("*").alias("n_tested"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"))


def failure_summary(runs: DataFrame) -> DataFrame:
    """category, failures, files, and the least error text of each category."""
    bad = runs.where(~F.col("passed")).withColumn("category", failure_category(F.col("error")))
    return bad.groupBy("category").agg(F.count("*").alias("n_failures"), F.count_distinct("file").alias("n_files"), F.min("error").alias("example"))


def consecutive_failures(runs: DataFrame, file: str = "file", order: str = "run") -> DataFrame:
    """Per file: runs, passes and the failures since its last pass. The last pass is an aggregate, so no window sorts the log."""
    last = runs.groupBy(file).agg(F.count("*").alias("n_runs"), F.count_if("passed").alias("n_passed"), F.max(F.when(F.col("passed"), F.col(order))).alias("last_pass"))
    tail = runs.join(last.select(F.col(file).alias("f"), "last_pass"), F.col(file) == F.col("f"))
    tail = tail.where(~F.col("passed") & (F.col("last_pass").isNull() | (F.col(order) > F.col("last_pass")))).groupBy(file).agg(F.count("*").alias("n_consecutive"))
    return last.join(tail, file, "left").select(file, "n_runs", "n_passed", F.coalesce("n_consecutive", F.lit(0)).cast("long").alias("n_consecutive"))


def plateaus(metrics: DataFrame, series: str, order: str, trailing: int = 3, least: float = 0.01) -> DataFrame:
    """Whether the rate gained under `least` over the trailing iterations of a series."""
    before = F.lag("pass_rate", trailing - 1).over(W.partitionBy(series).orderBy(order))
    return metrics.select(series, order, "pass_rate", F.coalesce((F.col("pass_rate") - before) < least, F.lit(False)).alias("plateau"))


def backtest_order(health: DataFrame, file: str = "file") -> DataFrame:
    """Files to test first: failing ones by failures in a row, then resolved, then passing."""
    bucket = F.when(F.col("n_consecutive") > 0, 0).when(F.col("n_passed") < F.col("n_runs"), 1).otherwise(2)
    return health.withColumn("bucket", bucket).orderBy("bucket", F.desc("n_consecutive"), file)


def stop_reason(rates: list[float], elapsed: float, enough: float = 0.95, iterations: int = 10, seconds: float = 300, window: int = 3, least: float = 0.01) -> str | None:
    """Why a loop over iterations ends after these pass rates: pass_rate_achieved, max_iterations, timeout or plateau, the first that holds; else it goes on."""
    if not rates:
        return None
    if rates[-1] >= enough:
        return "pass_rate_achieved"
    if len(rates) >= iterations:
        return "max_iterations"
    if elapsed >= seconds:
        return "timeout"
    return "plateau" if len(rates) >= window and rates[-1] - rates[-window] < least else None


def failure_history(runs: DataFrame, file: str = "file", order: str = "run") -> DataFrame:
    """Files that ever failed: failures, last failing run, its error and category, and whether a later run passed. A partial aggregate; the log is append-only."""
    bad = ~F.col("passed")
    h = runs.groupBy(file).agg(
        F.count_if(bad).alias("n_failures"), F.max(F.when(bad, F.col(order))).alias("last_failure"), F.max_by("error", F.when(bad, F.col(order))).alias("last_error"), F.max_by("passed", order).alias("resolved")
    )
    return h.where("n_failures > 0").withColumn("category", failure_category(F.coalesce("last_error", F.lit(""))))


def job_status(outputs: DataFrame, job: str = "job_id", status: str = "status") -> DataFrame:
    """failed over partial_success over success, a row a job."""
    rank = F.when(F.col(status) == "failed", 2).when(F.col(status) == "partial_success", 1).otherwise(0)
    worst = F.max(rank)
    return outputs.groupBy(job).agg(F.when(worst == 2, "failed").when(worst == 1, "partial_success").otherwise("success").alias("status"))


def file_results(enforced: DataFrame, errors: DataFrame, file: str = "_source_path") -> DataFrame:
    """file, passed, n_rows, n_bad, error and category: of a parser's rows under a contract, and of the files (path, error) that it failed on. A file's error is that of its first bad row."""
    bad = F.col(ERROR).isNotNull()
    rows = enforced.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad"), F.min_by(ERROR, F.when(bad, F.col("_source_row"))).alias("error"))
    failed = errors.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_bad"), "error")
    every = rows.unionByName(failed)
    return every.select("file", F.col("error").isNull().alias("passed"), "n_rows", "n_bad", "error", F.when(F.col("error").isNotNull(), failure_category(F.col("error"))).alias("category"))


def fail_fast(files: DataFrame, history: DataFrame, run, file: str = "file", threshold: float = 0.8, least: int = 3) -> tuple[DataFrame, bool]:
    """Results of `run` (files to rows of file, passed, error) and whether it stopped early.

    Files with unresolved failures run first, all at once as executors do; if at least `least` of them ran and under
    `threshold` passed, the rest does not run. The gate reads one row.
    """
    open_ = history.where("not resolved").select(file)
    first = staged(run(files.join(open_, file, "left_semi")), "first")
    gate = first.agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("int")).alias("rate")).first()
    if gate["n"] >= least and gate["rate"] < threshold:
        return first, True
    return first.unionByName(run(files.join(open_, file, "left_anti"))), False
