"""Reports: a registry of name to builder, open to more."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillflow.plans.aggregates import STAMPS
from quillflow.plans.registry import QUERIES, query
from quillflow.sources.tables import stage_stamps, table


def report(spark, sf_dir, name):
    """A registered report by name."""
    return QUERIES[name](spark, sf_dir)


@query(f"""
SELECT s.user_id, coalesce('Created: ' || strftime(created, '%Y-%m-%d %H:%M:%S'), '') || chr(10) || coalesce('Loaded: ' || strftime(loaded, '%Y-%m-%d %H:%M:%S'), '') AS label,
  c1.c_name AS created_by, c2.c_name AS posted_by, datediff('day', created, loaded)::BIGINT AS to_load, datediff('day', loaded, posted)::BIGINT AS to_post,
  datediff('day', posted, completed)::BIGINT AS to_complete, e.event_id AS last_edit
FROM ({STAMPS}) s LEFT JOIN customer c1 ON c1.c_custkey = s.user_id LEFT JOIN customer c2 ON c2.c_custkey = s.user_id + 1
LEFT JOIN (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1) e ON e.user_id = s.user_id
""")
def report_sla(spark, sf_dir):
    """Stage gaps in days with who did what: one dimension in several roles, and the latest edit."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    role = lambda key, name: people.select(F.col("c_custkey").alias(key), F.col("c_name").alias(name))
    edits = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("last_edit"))
    rows = stage_stamps(spark, sf_dir).withColumn("next", F.col("user_id") + 1)
    rows = rows.join(role("user_id", "created_by"), "user_id", "left").join(role("next", "posted_by"), "next", "left").join(edits, "user_id", "left")
    stamp = lambda label, c: F.coalesce(F.concat(F.lit(f"{label}: "), F.date_format(c, "yyyy-MM-dd HH:mm:ss")), F.lit(""))
    days = lambda a, b: F.datediff(F.to_date(b), F.to_date(a)).cast("long")
    return rows.select(
        "user_id", F.concat_ws("\n", stamp("Created", "created"), stamp("Loaded", "loaded")).alias("label"), "created_by", "posted_by",
        days("created", "loaded").alias("to_load"), days("loaded", "posted").alias("to_post"), days("posted", "completed").alias("to_complete"), "last_edit",
    )
