"""Replay of commands against a plain fold, as a batch and as a stream."""

import random

import pytest

from quarryspark.operators import commands
from quarryspark.operators.commands import MOVES
from quarryspark.streaming.commands import replayed

LOG = "proposal_id long, seq long, command string"


def plain(log):
    status, illegal, first = "pending", 0, (None, None, None)
    for seq, command in sorted(log, key=lambda r: (r[0], r[1] or "")):
        before, after = MOVES.get(command, ((), None))
        if status in before:
            status = after
            continue
        first = first if illegal else (seq, command, status)
        illegal += 1
    return status, illegal, *first


@pytest.mark.parametrize("span", [4, 1024])
def test_replay_equals_a_plain_fold(spark, monkeypatch, span):
    monkeypatch.setattr(commands, "SPAN", span)
    rng = random.Random(span)
    rows = [(rng.randrange(40), s, rng.choice([*MOVES, *MOVES, None, "odd"])) for s in range(-100, 155)]
    rows += [(99, s, "approve") for s in range(200)] + [(98, 5, "reject"), (98, 5, "approve"), (97, 1, None)]  # a hot one, a tie, a null
    log = spark.createDataFrame([*rows, (None, 1, "approve"), (3, None, "approve")], LOG)
    want = {k: plain([(s, c) for p, s, c in rows if p == k]) for k in {p for p, _, _ in rows}}
    assert {r.proposal_id: tuple(r)[1:] for r in commands.replay(log).collect()} == want
    assert want[98][0] == "approved" and want[99][1] == 199


def test_an_empty_log(spark):
    assert commands.replay(spark.createDataFrame([], LOG)).collect() == []


def test_the_stream_keeps_states_between_batches(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = []
    batches = [[(1, 1, "approve"), (2, 1, "apply"), (1, 2, "approve")], [(1, 5, "apply"), (2, 3, "reject"), (2, 2, None), (None, 1, "apply")], [(1, 3, "reject"), (3, 1, "supersede")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = replayed(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")))
        query = stream.writeStream.foreachBatch(lambda df, _: told.extend((k, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted((k, p, s, c, a, b) for k, p, s, c, a, b, legal in told if legal) == [
        (0, 1, 1, "approve", "pending", "approved"), (1, 1, 5, "apply", "approved", "applied"), (1, 2, 3, "reject", "pending", "rejected"), (2, 3, 1, "supersede", "pending", "superseded"),
    ]
    assert sorted((k, p, s) for k, p, s, *_, legal in told if not legal) == [(0, 1, 2), (0, 2, 1), (1, 2, 2), (2, 1, 3)]
