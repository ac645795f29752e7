"""Queries that run the event streams to the end of what is there and return the tables they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views as v
from ..sources.shared import shared_folder
from ..streaming import flows
from .sql_views import Register

register = Register()


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = _folder(spark)
    flows.into_table(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _changes(spark: SparkSession, stream: DataFrame, *keys: str) -> DataFrame:
    folder = _folder(spark)
    flows.upserts_into(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return flows.latest(spark, stream.schema, f"{folder}/rows", list(keys))


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = v.table(spark, d, "events").schema
    return flows.events(spark, f"{d}/event[s].parquet", schema)  # a pattern, as a stream takes no single file by name


@register("SELECT CAST(user_id % 5 AS INT) AS agency_id, event_type, time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS start, round(sum(value), 2) AS used, count(*) AS n FROM events GROUP BY ALL")
def x5_usage_windows(spark, d):
    e = _events(spark, d).withColumn("agency_id", (F.col("user_id") % 5).cast("int"))
    out = _changes(spark, flows.usage_windows(e, ["agency_id", "event_type"], "value"), "agency_id", "event_type", "start")
    return out.withColumn("used", F.round("used", 2))


@register("SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL")
def x6_access_counts(spark, d):
    return _changes(spark, flows.sliding_counts(_events(spark, d), ["event_type"]), "event_type", "start")


@register("""WITH s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def x7_sessions(spark, d):
    """Sessions that have ended by the watermark, ten minutes before the last event; each is written once."""
    return _run(spark, flows.sessions(_events(spark, d), "user_id"))


@register("""SELECT event_id % 3000 AS candidate_id, CASE event_id % 5 WHEN 0 THEN 'INTERVIEW_SCHEDULED' WHEN 1 THEN 'SHORTLISTED' ELSE 'REJECTED' END AS stage, ts FROM events WHERE event_id % 5 < 3 AND event_type <> 'error'""")
def p17_mail_stream(spark, d):
    m = _events(spark, d).selectExpr(
        "event_id % 3000 as candidate_id", "element_at(array('interview_invite', 'shortlist_mail', 'rejection_mail', 'offer_letter', null), cast(event_id % 5 as int) + 1) as email_type",
        "if(event_type = 'error', 'failed', 'sent') as status", "ts",
    )
    return _run(spark, flows.mail_stages(m))


@register("SELECT user_id, event_type FROM events GROUP BY ALL")
def x1_stream_repeats(spark, d):
    """With a window longer than the data each key comes through once."""
    out = _run(spark, flows.without_repeats(_events(spark, d), ["user_id", "event_type"], "400 days"))
    return out.select("user_id", "event_type")


@register("""WITH e AS (SELECT event_id, ts, event_type, event_id % 10 = 0 AS tardy, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)),
w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events WHERE event_id % 10 BETWEEN 1 AND 8)
SELECT event_type, start, count(*) AS n FROM e, w WHERE NOT tardy OR start + INTERVAL 1 HOUR > mark GROUP BY event_type, start""")
def x8_late_rows(spark, d):
    """A tenth of the events comes two batches late; of these only rows of windows that the first batch's watermark leaves open count."""
    e, path = v.table(spark, d, "events"), f"{_folder(spark)}/events"
    for digits in ("between 1 and 8", "= 9", "= 0"):  # a file and a batch each
        e.filter(f"event_id % 10 {digits}").coalesce(1).write.mode("append").parquet(path)
    stream = flows.events(spark, path, e.schema, files_per_trigger=1)
    return _changes(spark, flows.sliding_counts(stream, ["event_type"]), "event_type", "start")


@register("""WITH i AS (SELECT l_orderkey AS candidate_id, min(l_shipdate) AS due, min(l_partkey) % 3 = 0 AS started FROM lineitem GROUP BY l_orderkey),
m AS (SELECT max(CASE WHEN started THEN due + INTERVAL 10 MINUTE ELSE due - INTERVAL 1 DAY END) - INTERVAL 1 MINUTE AS mark FROM i)
SELECT candidate_id, 'NO_SHOW' AS stage FROM i, m WHERE NOT started AND due + INTERVAL 30 MINUTE <= mark""")
def x4_no_shows(spark, d):
    """Interviews that are set a day before; a third of them begins ten minutes late, the others never."""
    first = v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("due"), F.min("l_partkey").alias("part"))
    told = first.selectExpr("l_orderkey as candidate_id", "'scheduled' as status", "due as scheduled_at", "due - interval 1 day as ts")
    begun = first.filter("part % 3 = 0").selectExpr("l_orderkey as candidate_id", "'started' as status", "due as scheduled_at", "due + interval 10 minutes as ts")
    path = f"{_folder(spark)}/interviews"
    told.union(begun).write.parquet(path)
    return _run(spark, flows.no_shows(spark.readStream.schema(told.schema).parquet(path)))


@register("SELECT event_id AS id, user_id, event_type FROM events WHERE value > 50")
def s16_posted_events(spark, d):
    """Events that are posted as JSON lines, read as a stream."""
    path, posted = f"{_folder(spark)}/posted", v.table(spark, d, "events").filter("value > 50").select(F.col("event_id").alias("id"), "user_id", "event_type")
    posted.write.json(path)
    return _run(spark, flows.json_events(spark, path, "id long, user_id long, event_type string"))
