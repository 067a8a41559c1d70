"""The replay of commands as a stream: each proposal's status is state, and every command tells what it did.

Commands are taken in the order of their sequence numbers within a micro-batch, and batches as they come; one whose number is
not above the last one taken counts as late and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarryspark.operators.commands import MOVES

OUT = "proposal_id long, seq long, command string, found string, status string, legal boolean"


class Replay(StatefulProcessor):
    def __init__(self, initial: str, moves: dict):
        self.initial, self.moves = initial, moves

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = pd.concat(rows).dropna(subset=["seq"]).sort_values(["seq", "command"], na_position="first")
        status, last = self.state.get() if self.state.exists() else (self.initial, None)
        out = []
        for seq, command in zip(taken["seq"].tolist(), taken["command"].tolist()):
            before, after = self.moves.get(command, ((), None))
            legal = status in before and (last is None or seq > last)
            out.append((key[0], int(seq), command, status, after if legal else status, legal))
            status = after if legal else status
            last = int(seq) if last is None else max(last, int(seq))
        if out:
            self.state.update((status, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def replayed(log: DataFrame, initial: str = "pending") -> DataFrame:
    """A row for each command of a stream (proposal_id long, seq long, command string). Needs the RocksDB state store."""
    keyed = log.where("proposal_id IS NOT NULL").groupBy("proposal_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Replay(initial, MOVES), outputStructType=OUT, outputMode="Append", timeMode="None")
