"""Queries that run as streams over the tables, and the SQL of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.plans.common import table
from skein.session import shared_folder
from skein.streaming import buffer, sessions, watch
from skein.streaming.sink import committed

GAP_SECONDS, DELAY_SECONDS, BUFFERED = 3600, 1830, 4


def stream_session_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations start every ten minutes and take a minute a turn; every fourth pauses for two hours after three turns."""
    from skein.plans.catalogue import _stream

    seconds = F.lit(1_704_067_200) + F.col("conv_id") * 600 + F.col("turn") * 60 + F.when(F.col("conv_id") % 4 == 0, F.floor(F.col("turn") / 3) * 7200).otherwise(F.lit(0))
    source = _stream(spark, sf).withColumn("ts", F.timestamp_seconds(seconds))
    return sessions.stream_session_outcomes(spark, source, shared_folder(spark, "stream"), 0.15, 0.1, f"{GAP_SECONDS} seconds", f"{DELAY_SECONDS} seconds")


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls on fifty sessions: errors are marks on one of the session's last records, and every session is closed at the end."""
    e = table(spark, sf, "events").select(F.pmod("user_id", F.lit(50)).cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    order = Window.partitionBy("session_id").orderBy("ts", "seq")
    said = e.withColumn("kind", F.when(F.col("event_type") == "error", "mark").otherwise("record")).withColumn("no", F.count_if(F.col("kind") == "record").over(order))
    records = said.filter("kind = 'record'").select("session_id", "kind", F.col("seq").cast("string").alias("id"), "ts", "seq", "no", F.col("event_type").alias("payload"))
    aimed = said.filter("kind = 'mark'").select("session_id", "kind", "ts", "seq", (F.col("no") - F.col("seq") % 6).alias("no"), F.when(F.col("value") > 20, "positive").otherwise("negative").alias("feedback"))
    marks = aimed.join(records.select("session_id", "no", "id"), ["session_id", "no"])
    ends = e.groupBy("session_id").agg(F.max("ts").alias("ts"), (F.max("seq") + 1).alias("seq")).withColumn("kind", F.lit("close"))
    every = records.unionByName(marks, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    return every.select("session_id", "kind", "id", "ts", "seq", "payload", "feedback", F.lit(None).cast("boolean").alias("edited"))


def stream_buffered(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "buffered")
    _calls(spark, sf).write.parquet(f"{folder}/calls")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/calls").schema).parquet(f"{folder}/calls")
    buffer.write_buffered(stream, folder, BUFFERED, "1 hour")
    written = committed(spark, f"{folder}/interactions", buffer.WRITTEN)
    return written.select("session_id", "kind", "day", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("batch_no", "position")), "reason", "id", "feedback")


def _watched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Files of twenty-five conversations each; of every tenth file all lines are cut at the front."""
    said = table(spark, sf, "conversations").withColumn("session", F.floor(F.col("conv_id") / 25).cast("long"))
    record = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    lines = said.select("session", (F.col("session") % 5).alias("project"), "conv_id", "turn", F.when(F.col("session") % 10 == 7, F.substr(record, F.lit(2))).otherwise(record).alias("value"))
    folder = shared_folder(spark, "watched")
    lines.repartition("session").sortWithinPartitions("project", "session", "conv_id", "turn").select("project", "session", "value").write.partitionBy("project", "session").text(f"{folder}/in")
    watch.watch_sessions(spark, f"{folder}/in", folder)
    return watch.watched(spark, folder)


def _session() -> F.Column:
    return F.regexp_extract("file_key", r"session=(\d+)", 1).cast("long").alias("session")


def stream_watch(spark: SparkSession, sf: str) -> DataFrame:
    return _watched(spark, sf)[0].select(_session(), "status", "reason", "records", "pairs")


def stream_watch_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _watched(spark, sf)[1].groupBy(_session(), "category").agg(F.count("*").alias("n"), F.min("pair_id").alias("first_pair"))


QUERIES = (stream_session_outcomes, stream_buffered, stream_watch, stream_watch_pairs)


def _sql() -> dict[str, str]:
    from skein.plans import oracles

    with_seconds = "SELECT *, conv_id * 600 + turn * 60 + CASE WHEN conv_id % 4 = 0 THEN (turn // 3) * 7200 ELSE 0 END AS s FROM conversations WHERE role = 'user'"
    outcomes = f"""
WITH c AS MATERIALIZED ({with_seconds}),
wm AS (SELECT max(s) - {DELAY_SECONDS} AS wm FROM c),
n AS (SELECT conv_id, turn, s, lead(s) OVER (PARTITION BY conv_id ORDER BY s, turn) AS next_s FROM c),
known AS (SELECT n.*, next_s IS NULL OR next_s - s > {GAP_SECONDS} AS ended FROM n, wm WHERE CASE WHEN next_s IS NULL OR next_s - s > {GAP_SECONDS} THEN s + {GAP_SECONDS} < wm ELSE next_s <= wm END)
SELECT conv_id, turn, CASE WHEN ended THEN 'neutral' ELSE outcome END AS outcome, CASE WHEN ended THEN 'session_close' ELSE reason END AS reason, CASE WHEN NOT ended THEN overlap END AS overlap
FROM known JOIN ({oracles._outcomes(0.15, 0.1)}) USING (conv_id, turn)"""
    buffered = f"""
WITH e AS (SELECT (user_id % 50)::VARCHAR AS session_id, event_id AS seq, ts, event_type, value, CASE WHEN event_type = 'error' THEN 'mark' ELSE 'record' END AS kind FROM events),
said AS (SELECT *, count(*) FILTER (kind = 'record') OVER (PARTITION BY session_id ORDER BY ts, seq) AS no FROM e),
r AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY session_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, seq) - 1 AS k FROM said WHERE kind = 'record'),
b AS (SELECT *, k // {BUFFERED} AS batch_no, count(*) OVER w AS n, max(row(ts, seq)) OVER w AS last FROM r WINDOW w AS (PARTITION BY session_id, day, k // {BUFFERED})),
m AS (SELECT said.session_id, said.ts, said.seq, strftime(said.ts, '%Y-%m-%d') AS day, CASE WHEN said.value > 20 THEN 'positive' ELSE 'negative' END AS feedback,
             b.seq AS target, b.n < {BUFFERED} OR row(said.ts, said.seq) < b.last AS held
      FROM said JOIN b ON b.session_id = said.session_id AND b.no = said.no - said.seq % 6 WHERE said.kind = 'mark'),
last_mark AS (SELECT target, arg_max(feedback, row(ts, seq)) AS feedback FROM m WHERE held GROUP BY target)
SELECT session_id, 'record' AS kind, day, batch_no::BIGINT AS batch_no, (k % {BUFFERED})::BIGINT AS position, CASE WHEN n = {BUFFERED} THEN 'full' ELSE 'close' END AS reason, seq::VARCHAR AS id, feedback
FROM b LEFT JOIN last_mark ON target = seq
UNION ALL
SELECT session_id, 'mark', day, -1, -1, NULL, target::VARCHAR, feedback FROM m WHERE NOT held"""
    scored = oracles.SQL["pair_quality"]
    own = "(SELECT conv_id // 25 AS conv_id, row_number() OVER (PARTITION BY conv_id // 25 ORDER BY conv_id, turn) AS turn, role, text FROM conversations WHERE (conv_id // 25) % 10 <> 7)"
    pairs = f"SELECT conv_id AS session, category, pair_id FROM ({scored.replace('FROM conversations', f'FROM {own} AS f')})"
    marker = f"""
SELECT session, CASE WHEN session % 10 = 7 THEN 'failed' ELSE 'done' END AS status, CASE WHEN session % 10 = 7 THEN 'no JSON object' END AS reason,
       CASE WHEN session % 10 = 7 THEN 0 ELSE records END AS records, coalesce(n, 0) AS pairs
FROM (SELECT conv_id // 25 AS session, count(*) AS records FROM conversations GROUP BY 1) LEFT JOIN (SELECT session, count(*) AS n FROM ({pairs}) GROUP BY 1) USING (session)"""
    return {
        "stream_session_outcomes": outcomes,
        "stream_buffered": buffered,
        "stream_watch": marker,
        "stream_watch_pairs": f"SELECT session, category, count(*) AS n, min(pair_id) AS first_pair FROM ({pairs}) GROUP BY 1, 2",
    }


SQL = _sql()
