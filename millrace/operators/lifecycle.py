"""Life cycle of files: a log of status changes folded into final states, with the moves that are not allowed.

What a run of changes does to a file is a function of the state before it: the state after it and the illegal moves on the
way, for each of the eight states. Such functions compose, and composing is associative; so a log is cut into blocks of
consecutive changes, each block becomes a function, blocks of functions become one again, until a file has one. A file with
a third of all changes is cut as any other. Going back down, each block learns its state before, and its changes are judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.positions import with_group, with_positions
from millrace.operators.staging import staged

#: States of a file, and to which each may go.
STATES = ("pending", "tagged", "queued", "processing", "processed", "failed", "skipped", "deleted")
MOVES = {
    "pending": ("tagged", "queued", "skipped", "deleted"),
    "tagged": ("pending", "queued", "skipped", "deleted"),
    "queued": ("pending", "processing", "failed", "deleted"),
    "processing": ("queued", "processed", "failed", "deleted"),
    "processed": ("pending", "deleted"),
    "failed": ("pending", "queued", "skipped", "deleted"),
    "skipped": ("pending", "deleted"),
    "deleted": ("pending",),
}
FIRST = "pending"
#: Changes or functions that are put together at a time.
BLOCK = 256


def code_of(status: Column) -> Column:
    """Number of a state (any case); null for an unknown one."""
    known = F.array_position(F.array(*map(F.lit, STATES)), F.lower(status))
    return F.when(known > 0, (known - 1).cast("int"))


def legal(before: Column, to: Column) -> Column:
    """Whether a move is allowed; to stay is, an unknown state is not."""
    bits = F.array(*[F.lit(sum(1 << STATES.index(t) for t in (*MOVES[s], s))) for s in STATES])
    return F.coalesce(F.getbit(F.get(bits, before).cast("long"), to) == 1, F.lit(False))


def _step(acc: Column, x: Column) -> Column:
    allowed = legal(acc["state"], x["_code"])
    return F.struct(F.when(allowed, x["_code"]).otherwise(acc["state"]).alias("state"), (acc["bad"] + F.when(allowed, 0).otherwise(1)).alias("bad"))


def _begin(state: Column) -> Column:
    return F.struct(state.cast("int").alias("state"), F.lit(0).cast("long").alias("bad"))


def _function(fold) -> Column:
    """A fold from each of the states: array of (state, bad)."""
    return F.transform(F.sequence(F.lit(0), F.lit(len(STATES) - 1)), lambda s: fold(_begin(s)))


def _through(acc: Column, f: Column) -> Column:
    """A state and its illegal moves so far, taken through a function."""
    to = F.get(f, acc["state"])
    return F.struct(to["state"].alias("state"), (acc["bad"] + to["bad"]).alias("bad"))


def numbered(log: DataFrame, file: str, order: list[str], status: str) -> DataFrame:
    """_file, _nth (from 0 in each file's order), _order (struct), _status, _code; staged. Positions come from prefix sums over (file, order), less the file's first."""
    own = log.select(F.col(file).alias("_file"), F.struct(*order).alias("_order"), F.col(status).alias("_status"))
    wide = staged(with_positions(own, ["_file", "_order"], "_position"), "positions")
    out = with_group(wide, ["_file"], {"_first": F.min("_position")}).withColumn("_nth", F.col("_position") - F.col("_first"))
    return staged(out.select("_file", "_nth", "_order", "_status", code_of(F.col("_status")).alias("_code")), "changes")


def runs_of(df: DataFrame, block: int, *columns: str) -> DataFrame:
    """_file, _up and xs: blocks of consecutive rows, in order, no longer than `block`."""
    return df.groupBy("_file", F.floor(F.col("_nth") / block).alias("_up")).agg(F.sort_array(F.collect_list(F.struct("_nth", *columns))).alias("xs"))


def levels(changes: DataFrame, block: int) -> list[DataFrame]:
    """Functions of blocks of changes, then of blocks of functions, until each file has one: _file, _nth, f, n (changes)."""
    here = [F.col("_file"), F.col("_up").alias("_nth")]
    first = runs_of(changes, block, "_code").select(*here, _function(lambda s: F.aggregate("xs", s, _step)).alias("f"), F.size("xs").cast("long").alias("n"))
    out = [staged(first, "functions")]
    while not out[-1].where("_nth > 0").isEmpty():
        total = F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        up = runs_of(out[-1], block, "f", "n").select(*here, _function(lambda s: F.aggregate("xs", s, lambda a, x: _through(a, x["f"]))).alias("f"), total.alias("n"))
        out.append(staged(up, "functions"))
    return out


def with_start(runs: DataFrame, start: DataFrame) -> DataFrame:
    """Runs with the state that each begins with."""
    begin = start.select(F.col("_file").alias("_own"), F.col("_nth").alias("_at"), "state")
    return runs.join(begin, F.col("_file").eqNullSafe(F.col("_own")) & (F.col("_up") == F.col("_at")))


def final_states(log: DataFrame, file: str, order: list[str], status: str = "status", block: int = BLOCK) -> DataFrame:
    """file, status, n_changes, n_illegal of each file; illegal moves leave the state as it is. Changes that tie in their order come in no certain one. Null files are one file; an empty log has none."""
    top = levels(numbered(log, file, order, status), block)[-1]
    end = F.get("f", F.lit(STATES.index(FIRST)))
    names = F.array(*map(F.lit, STATES))
    return top.select(F.col("_file").alias(file), F.get(names, end["state"]).alias("status"), F.col("n").alias("n_changes"), end["bad"].alias("n_illegal"))


def illegal_moves(log: DataFrame, file: str, order: list[str], status: str = "status", block: int = BLOCK) -> DataFrame:
    """file, the order's columns, from_status and status of each move that is not allowed; cases as for final_states.

    From the top down, each block hands its parts the states that they begin with; at the bottom the changes themselves are judged.
    """
    changes = numbered(log, file, order, status)
    up = levels(changes, block)
    start = up[-1].select("_file", "_nth", F.lit(STATES.index(FIRST)).alias("state"))
    for functions in reversed(up[:-1]):
        both = with_start(runs_of(functions, block, "f"), start)
        walk = F.aggregate(
            "xs", F.struct(F.col("state").alias("state"), F.array().cast("array<struct<_nth:bigint,state:int>>").alias("seen")),
            lambda a, x: F.struct(F.get(x["f"], a["state"])["state"].alias("state"), F.array_append(a["seen"], F.struct(x["_nth"].alias("_nth"), a["state"].alias("state"))).alias("seen")),
        )
        start = both.select("_file", F.explode(walk["seen"]).alias("s")).select("_file", "s._nth", "s.state")
    both = with_start(runs_of(changes, block, "_code", "_order", "_status"), start)
    kind = both.schema["xs"].dataType.elementType.simpleString()
    move = lambda a, x: F.struct(a["state"].alias("state"), x.alias("x"))
    walk = F.aggregate(
        "xs", F.struct(F.col("state").alias("state"), F.array().cast(f"array<struct<state:int,x:{kind}>>").alias("bad")),
        lambda a, x: F.struct(F.when(legal(a["state"], x["_code"]), x["_code"]).otherwise(a["state"]).alias("state"), F.when(legal(a["state"], x["_code"]), a["bad"]).otherwise(F.array_append(a["bad"], move(a, x))).alias("bad")),
    )
    names = F.array(*map(F.lit, STATES))
    each = both.select("_file", F.explode(walk["bad"]).alias("b"))
    return each.select(F.col("_file").alias(file), *[F.col(f"b.x._order.{c}").alias(c) for c in order], F.get(names, F.col("b.state")).alias("from_status"), F.col("b.x._status").alias("status"))
