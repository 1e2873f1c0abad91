"""Contracts on a stream of files: each micro-batch is enforced once and written to two tables, whose rows appear together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.contract import ContractColumn, enforce, split
from millrace.operators.manifest import put_if_absent
from millrace.operators.sinks import file_system

#: Below an output folder: an empty file for each of the last batches that are visible.
DONE, KEPT = "_done", 8


def done_batches(spark: SparkSession, out: str) -> list[int]:
    fs, make = file_system(spark, out)
    folder = make(f"{out}/{DONE}")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()) if fs.exists(folder) else []


def visible(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Valid and quarantined rows of the batches that are done, with their number; a batch of which only one table is written is not read."""
    last = max(done_batches(spark, out), default=-1)
    return tuple(spark.read.parquet(f"{out}/{t}").where(F.col("batch") <= last) for t in ("valid", "quarantine"))


def run_available(spark: SparkSession, source: str, schema: StructType, columns: list[ContractColumn], select: list[str], out: str, job_id: str) -> tuple[DataFrame, DataFrame]:
    """Processes the files that are there, each once (the checkpoint remembers), and gives valid and quarantined rows.

    A batch that is tried again overwrites its own folders, so a lost driver writes no row twice; its mark, by which readers see
    both tables' rows at once, comes after both.
    """

    def write(batch: DataFrame, number: int) -> None:
        enforced = enforce(batch.selectExpr(*select), columns).persist()
        try:
            valid, bad = split(enforced, job_id)
            valid.write.mode("overwrite").parquet(f"{out}/valid/batch={number}")
            bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        finally:
            enforced.unpersist()
        put_if_absent(spark, f"{out}/{DONE}/{number}", "")
        fs, make = file_system(spark, out)
        for old in done_batches(spark, out)[:-KEPT]:
            fs.delete(make(f"{out}/{DONE}/{old}"), False)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return visible(spark, out)
