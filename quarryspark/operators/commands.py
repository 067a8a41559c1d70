"""Replay of a log of commands: every proposal's status, and the commands that its status did not allow.

A command is a function from status to status, and functions compose in any grouping as long as their order stays. So a
proposal's log is cut into chunks of SPAN sequence numbers, each chunk becomes the function of its commands (for every status
it could begin with: the status it ends with, how many commands were illegal, and the first of them), and chunks of chunks
compose likewise. No group holds more than SPAN rows, however long one proposal's log is.

Edge cases: an illegal or unknown (or null) command leaves the status; of commands with equal sequence numbers the one first
in the alphabet comes first, nulls before; rows without a proposal or a sequence number are left out; a proposal without
commands has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.operators.schemas import PROPOSAL_STATUS

#: The statuses that each command may find, and the one it leaves.
MOVES = {
    "approve": (("pending",), "approved"),
    "reject": (("pending",), "rejected"),
    "apply": (("approved",), "applied"),
    "supersede": (("pending", "approved"), "superseded"),
}
#: Rows of a chunk, at most, and how often chunks are put together: logs of up to SPAN ** LEVELS sequence numbers a proposal.
SPAN, LEVELS = 1024, 4
STEP = "struct<status:int,illegal:long,seq:long,command:string,found:int>"


def _next(command: Column, status: Column) -> Column:
    """The status after a command, null if the status does not allow it."""
    code = {s: k for k, s in enumerate(PROPOSAL_STATUS)}
    out = F.lit(None).cast("int")
    for name, (before, after) in MOVES.items():
        out = F.when((command == name) & status.isin(*(code[b] for b in before)), code[after]).otherwise(out)
    return out


def _start() -> Column:
    return F.array(*(F.struct(F.lit(k).alias("status"), F.lit(0).cast("long").alias("illegal"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("command"), F.lit(None).cast("int").alias("found")) for k in range(len(PROPOSAL_STATUS)))).cast(f"array<{STEP}>")


def _told(before: Column, status: Column, illegal: Column, seq: Column, command: Column, found: Column) -> Column:
    """A step whose first illegal command is the earlier one."""
    first = before["illegal"] > 0
    pick = lambda name, new: F.when(first, before[name]).otherwise(new).alias(name)
    return F.struct(status.alias("status"), (before["illegal"] + illegal).alias("illegal"), pick("seq", seq), pick("command", command), pick("found", found)).cast(STEP)


def _then(step: Column, row: Column) -> Column:
    """The step after one more command."""
    after = _next(row["command"], step["status"])
    bad = after.isNull()
    none = lambda c: F.when(bad, c)
    return _told(step, F.coalesce(after, step["status"]), bad.cast("long"), none(row["seq"]), none(row["command"]), none(step["status"]))


def _compose(step: Column, chunk: Column) -> Column:
    """The step after a whole chunk."""
    own = F.get(chunk, step["status"])
    return _told(step, own["status"], own["illegal"], own["seq"], own["command"], own["found"])


def replay(log: DataFrame, initial: str = "pending") -> DataFrame:
    """proposal_id, status, illegal (their number), and seq, command and status found of the first illegal one.

    log: proposal_id, seq, command.
    """
    rows = log.where("proposal_id IS NOT NULL AND seq IS NOT NULL").select("proposal_id", F.col("seq").cast("long").alias("seq"), F.col("command").cast("string").alias("command"))
    chunks = rows.groupBy("proposal_id", F.floor(F.col("seq") / SPAN).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("seq", "command"))).alias("rows"))
    steps = chunks.select("proposal_id", "chunk", F.aggregate("rows", _start(), lambda steps, r: F.transform(steps, lambda s: _then(s, r))).alias("f"))
    for level in range(1, LEVELS):
        up = F.floor(F.col("chunk") / SPAN) if level < LEVELS - 1 else F.lit(0).cast("long")
        grouped = steps.groupBy("proposal_id", up.alias("up")).agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("fs"))
        steps = grouped.select("proposal_id", F.col("up").alias("chunk"), F.aggregate("fs", _start(), lambda steps, c: F.transform(steps, lambda s: _compose(s, c["f"]))).alias("f"))
    names = F.array(*(F.lit(s) for s in PROPOSAL_STATUS))
    end = steps.select("proposal_id", F.get("f", F.lit(PROPOSAL_STATUS.index(initial))).alias("s"))
    return end.select("proposal_id", F.get(names, F.col("s.status")).alias("status"), F.col("s.illegal").alias("illegal"), F.col("s.seq").alias("first_seq"), F.col("s.command").alias("first_command"), F.get(names, F.col("s.found")).alias("first_status"))
