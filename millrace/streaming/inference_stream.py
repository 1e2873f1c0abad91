"""Type inference over a stream that stops once nothing more can be learned.

What the values so far leave possible is the streaming aggregate's state: a mask and two counts a column. After each batch
the columns that changed are told; the stream is stopped when every column is resolved, or enough rows were read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from millrace.operators.inference import concluded, eliminated, hints, masks
from millrace.operators.staging import shared_folder

MIN_ROWS, MAX_ROWS = 100, 100_000
#: Seconds between looks at the stream.
LOOK = 0.2


@dataclass(frozen=True)
class Inferred:
    """types: as of inference.infer(), of the rows read until the stop. stopped: why, `resolved`, `rows` or `end` of the input. resolved_at: rows read when each column was first resolved."""

    types: DataFrame
    rows: int
    stopped: str
    resolved_at: dict[str, int]


def infer_until_resolved(
    stream: DataFrame, columns: list[str], min_rows: int = MIN_ROWS, max_rows: int | None = MAX_ROWS, cannot_be: dict | None = None, must_be: dict | None = None, checkpoint: str | None = None
) -> Inferred:
    """Reads a stream batch by batch until all columns are resolved and min_rows were read, or max_rows were (None: no limit), or the input ends.

    Limits are looked at after each batch, so a batch counts whole; its size is the source's (maxFilesPerTrigger). A column of
    nulls alone is never resolved. A batch's rows are dealt over all cores before values are judged, so that few files, or
files of one row group, are not few tasks' work. Given a checkpoint, a stream that was stopped goes on where it was. The driver holds a row
    a column.
    """
    spark = stream.sparkSession
    hinted = hints(cannot_be, must_be)
    known: dict[str, tuple[int, int, int | None]] = {}
    said: dict[str, object] = {"stopped": "", "rows": 0}
    resolved_at: dict[str, int] = {}

    def conclude(rows: dict[str, tuple[int, int, int | None]]) -> DataFrame:
        return concluded(spark.createDataFrame([(c, *x) for c, x in rows.items()], "name string, n_null long, n_values long, mask int"), hinted)

    def look(batch: DataFrame, number: int) -> None:
        if said["stopped"]:
            return
        known.update({r["name"]: (r.n_null, r.n_values, r.mask) for r in batch.collect()})
        n = max((a + b for a, b, _ in known.values()), default=0)
        open_ = {r["name"] for r in conclude(known).where("resolved in ('ambiguous', 'null')").collect()} if known else set(columns)
        for c in columns:
            if c in known and c not in open_:
                resolved_at.setdefault(c, n)
        said["rows"] = n
        if max_rows is not None and n >= max_rows:
            said["stopped"] = "rows"
        elif known.keys() >= set(columns) and not open_ and n >= min_rows:
            said["stopped"] = "resolved"

    at = checkpoint or f"{shared_folder(spark)}/inference-{uuid.uuid4().hex}"
    dealt = stream.select(*columns).repartition(spark.sparkContext.defaultParallelism)
    query = eliminated(masks(dealt, columns)).writeStream.outputMode("update").foreachBatch(look).option("checkpointLocation", at).trigger(availableNow=True).start()
    while not query.awaitTermination(LOOK):
        if said["stopped"]:
            query.stop()
            break
    return Inferred(conclude(known), int(said["rows"]), str(said["stopped"] or "end"), resolved_at)
