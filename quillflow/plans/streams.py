"""Stream operators run over the whole table at once; tests run them as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillflow.plans.registry import query
from quillflow.session import ship_package
from quillflow.sources.tables import table
from quillflow.streaming import events as ops
from quillflow.streaming import machine

STAMP = "yyyy-MM-dd HH:mm:ss"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ends, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s
""")
def sessions(spark, sf_dir):
    """Sessions closed after 30 idle minutes."""
    found = ops.sessions(_events(spark, sf_dir))
    return found.select("user_id", F.date_format("begins", STAMP).alias("begins"), F.date_format("ends", STAMP).alias("ends"), "n")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_audit(spark, sf_dir):
    """Daily counts of the audit log."""
    return ops.tumbling_counts(_events(spark, sf_dir)).select(F.date_format("begins", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS rn FROM events),
k AS (SELECT user_id, event_id, t, rn, t AS latest, true AS kept FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.t, e.rn, CASE WHEN e.t - k.latest >= 3600 THEN e.t ELSE k.latest END, e.t - k.latest >= 3600 FROM k JOIN e ON e.user_id = k.user_id AND e.rn = k.rn + 1)
SELECT user_id, event_id, t AS "at" FROM k WHERE kept
""")
def touch_sampled(spark, sf_dir):
    """Last-seen refreshes, at most one an hour and user."""
    return ops.sampled_touches(table(spark, sf_dir, "events"), 3600).select("user_id", "event_id", "at")


#: Events as uploads, runs and actions on documents, in SQL that Spark and DuckDB both read.
_WORDS = ("upload", "run", "load", "run", "post", "exclude", "include", "mark", "complete", "reject", "revert", "upload", "run", "load")
ACTION = "CASE WHEN event_id % 71 = 0 THEN 'expire' ELSE CASE event_id % 14 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_WORDS)) + " END END"
TARGET = "CASE WHEN user_id % 3 = 0 THEN 'READY TO LOAD' ELSE CASE (event_id * 7 + user_id) % 8 " + " ".join("WHEN {} THEN '{}'".format(k, t.replace("'", "''")) for k, t in enumerate(machine.RUN_RESULTS)) + " ELSE 'NONE' END END"
_QUOTED = lambda names: "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"
_MOVED = " ".join(f"WHEN action = '{a}' AND s IN {_QUOTED(f)} THEN '{t}'" for a, (f, t) in machine.MOVES.items())


@query(f"""
WITH RECURSIVE e AS (SELECT user_id AS document, event_id, epoch_us(ts) AS t, {ACTION} AS action, {TARGET} AS target, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
k AS (
  SELECT DISTINCT document, 0::BIGINT AS rn, 0::BIGINT AS event_id, 0::BIGINT AS t, NULL::VARCHAR AS kind, NULL::VARCHAR AS was, NULL::VARCHAR AS s, NULL::VARCHAR AS x, NULL::VARCHAR AS m, 0 AS g FROM e
  UNION ALL
  SELECT document, rn, event_id, t, CASE WHEN action = 'upload' THEN CASE WHEN s IS NULL THEN 'created' WHEN s IN {_QUOTED(machine.REWORKABLE)} THEN 'reworked' WHEN s IN {_QUOTED(machine.WAITING)} THEN 'renewed' ELSE 'duplicate' END WHEN new IS NULL THEN 'illegal' ELSE 'moved' END,
    s, CASE WHEN action = 'upload' AND (s IS NULL OR s IN {_QUOTED(machine.REWORKABLE + machine.WAITING)}) THEN 'INITIATED' ELSE coalesce(new, s) END,
    CASE WHEN action = 'upload' AND s IN {_QUOTED(machine.REWORKABLE + machine.WAITING)} THEN NULL WHEN new IS NOT NULL AND action = 'exclude' THEN s WHEN new IS NOT NULL AND action = 'include' THEN NULL ELSE x END,
    CASE WHEN action = 'upload' AND s IN {_QUOTED(machine.REWORKABLE + machine.WAITING)} THEN NULL WHEN new IS NOT NULL AND action = 'mark' THEN s WHEN new IS NOT NULL AND action = 'revert' THEN NULL ELSE m END,
    CASE WHEN action = 'upload' AND (s IS NULL OR s IN {_QUOTED(machine.WAITING)}) THEN g + 1 ELSE g END
  FROM (SELECT e.*, k.s, k.x, k.m, k.g, CASE WHEN action = 'run' AND s = 'INITIATED' AND target IN {_QUOTED(machine.RUN_RESULTS)} THEN target WHEN action = 'exclude' AND s NOT IN {_QUOTED(machine.STAYING)} THEN 'EXCLUDED'
    WHEN action = 'include' AND s = 'EXCLUDED' THEN x WHEN action = 'mark' AND s IN {_QUOTED(machine.MARKABLE)} THEN 'NEW TEMPLATE' WHEN action = 'revert' AND s = 'NEW TEMPLATE' THEN m {_MOVED} END AS new
    FROM k JOIN e ON e.document = k.document AND e.rn = k.rn + 1))
SELECT document, event_id, t AS "at", kind, was AS before, s AS after, g AS generation FROM k WHERE rn > 0
""")
def status_replay(spark, sf_dir):
    """What each upload, run and action did to its document: legal moves, late uploads by status, refusals."""
    ship_package(spark)
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("document"), "event_id", "ts", F.expr(ACTION).alias("action"), F.expr(TARGET).alias("target"))
    return machine.replay(events)
