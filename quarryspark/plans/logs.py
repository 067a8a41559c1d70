"""Replayed commands and compared sets over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.operators import citations, commands
from quarryspark.plans.registry import query, views

_COMMAND = "CASE event_type WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'look' ELSE 'approve' END WHEN 'click' THEN 'apply' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'supersede' ELSE 'apply' END"


def event_log(v: views) -> DataFrame:
    """Events as commands on a few hundred proposals; every third view is no command."""
    return v.read("events").select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("seq"), F.expr(_COMMAND).alias("command"))


@query(f"""WITH RECURSIVE l AS (SELECT user_id AS proposal_id, event_id AS seq, {_COMMAND} AS command, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT proposal_id, CAST(0 AS BIGINT) AS n, 'pending' AS status, CAST(0 AS BIGINT) AS illegal, CAST(NULL AS BIGINT) AS first_seq, CAST(NULL AS VARCHAR) AS first_command, CAST(NULL AS VARCHAR) AS first_status FROM l
 UNION ALL SELECT proposal_id, n, coalesce(after, status), illegal + CASE WHEN after IS NULL THEN 1 ELSE 0 END, CASE WHEN illegal = 0 AND after IS NULL THEN seq ELSE first_seq END, CASE WHEN illegal = 0 AND after IS NULL THEN command ELSE first_command END, CASE WHEN illegal = 0 AND after IS NULL THEN status ELSE first_status END
 FROM (SELECT s.proposal_id, l.n, s.status, s.illegal, s.first_seq, s.first_command, s.first_status, l.seq, l.command,
  CASE WHEN l.command = 'approve' AND status = 'pending' THEN 'approved' WHEN l.command = 'reject' AND status = 'pending' THEN 'rejected' WHEN l.command = 'apply' AND status = 'approved' THEN 'applied' WHEN l.command = 'supersede' AND status IN ('pending', 'approved') THEN 'superseded' END AS after
  FROM s JOIN l ON l.proposal_id = s.proposal_id AND l.n = s.n + 1))
SELECT s.proposal_id, status, illegal, first_seq, first_command, first_status FROM s JOIN (SELECT proposal_id, max(n) AS n FROM l GROUP BY 1) m ON m.proposal_id = s.proposal_id AND m.n = s.n""")
def command_replay(spark, sf_dir):
    """Each proposal's last status, and the first command that its status did not allow."""
    return commands.replay(event_log(views(spark, sf_dir)))


_STORED = "(SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE NOT (l_orderkey % 10 = 3 AND l_linenumber = 1) UNION ALL SELECT l_orderkey, l_partkey, l_suppkey + 1, l_quantity FROM lineitem WHERE l_orderkey % 10 = 7 AND l_linenumber = 2)"


@query(f"""WITH e AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem), s AS (SELECT DISTINCT * FROM {_STORED})
SELECT l_orderkey, l_partkey, l_suppkey, side FROM (SELECT *, 'expected' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'stored' FROM (SELECT * FROM s EXCEPT SELECT * FROM e))""")
def order_set_difference(spark, sf_dir):
    """Each order's lines as a set against a changed copy: lines that went, and lines that came."""
    l = views(spark, sf_dir).read("lineitem")  # noqa: E741
    went = (F.col("l_orderkey") % 10 == 3) & (F.col("l_linenumber") == 1)
    came = l.where("l_orderkey % 10 = 7 AND l_linenumber = 2").withColumn("l_suppkey", F.col("l_suppkey") + 1)
    found = citations.set_difference(l, l.where(~went).unionByName(came), ["l_partkey", "l_suppkey", "l_quantity"], by=["l_orderkey"])
    return found.select("l_orderkey", "l_partkey", "l_suppkey", "side")
