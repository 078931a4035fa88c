"""The event log: hash chain, replay, durations and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log
from ..operators.graph import checkpointed
from ..registry import query
from ..sources.tables import table

KINDS = ["signup", "view", "click", "purchase", "error"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


PAYLOAD_SQL = "event_id || '|' || event_type || '|' || props"
CHAIN_SQL = f"""digests AS (SELECT event_id, user_id, sha256({PAYLOAD_SQL}) AS digest, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events),
  chained AS (SELECT event_id, user_id, sequence, NULL::VARCHAR AS previous_hash, sha256('|' || digest) AS event_hash FROM digests WHERE sequence = 1
    UNION ALL SELECT d.event_id, d.user_id, d.sequence, c.event_hash, sha256(c.event_hash || '|' || d.digest) FROM chained c JOIN digests d ON d.user_id = c.user_id AND d.sequence = c.sequence + 1)"""


def payload():
    return F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT * FROM chained")
def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's hash, which covers its predecessor's hash and so the whole log before it."""
    return log.chain(events(spark, sf_dir).select("event_id", "user_id", "event_type", "props"), ["user_id"], ["event_id"], payload()).select("event_id", "user_id", "sequence", "previous_hash", "event_hash")


LATEST_SQL = "latest AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props, count(*) AS events FROM events GROUP BY 1)"


@query(f"WITH {LATEST_SQL} SELECT * FROM latest")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user after replay: one aggregation, no sort of the log."""
    return log.latest(events(spark, sf_dir), ["user_id"], ["event_id"], ["event_type", "props"])


@query(f"WITH {LATEST_SQL} SELECT event_type, count(*) AS users, sum(events)::BIGINT AS events FROM latest GROUP BY 1")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = log.latest(events(spark, sf_dir), ["user_id"], ["event_id"], ["event_type"])
    return state.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"), F.sum("events").alias("events"))


@query("""SELECT event_id, user_id, event_type, (epoch_us(ts) - epoch_us(started)) // 1000 AS duration_ms FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS started FROM events)""")
def asof_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds since the latest view of the same user; null before the first."""
    df = log.as_of(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", "ts")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return df.select("event_id", "user_id", "event_type", F.floor((micros("ts") - micros("started_at")) / 1000).cast("long").alias("duration_ms"))


@query("SELECT event_type, count(*) AS events, count(value) AS reported, sum(value::DECIMAL(18, 2))::DOUBLE AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums are exact decimals, so no order of adding changes them."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count("value").alias("reported"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""SELECT user_id, round(purchases / nullif(views, 0), 6) AS purchases_per_view, round(errors / nullif(events, 0), 6) AS error_rate, round(clicks / nullif(views, 0), 6) AS clicks_per_view FROM
  (SELECT user_id, count(*) AS events, count_if(event_type = 'purchase') AS purchases, count_if(event_type = 'view') AS views, count_if(event_type = 'error') AS errors, count_if(event_type = 'click') AS clicks FROM events GROUP BY 1)""")
def efficiency_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of each user; null where the divisor is 0."""
    n = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), *[F.count_if(F.col("event_type") == k).alias(k) for k in ("purchase", "view", "error", "click")])
    r = lambda a, b, name: log.ratio(F.col(a), F.col(b)).alias(name)
    return n.select("user_id", r("purchase", "view", "purchases_per_view"), r("error", "events", "error_rate"), r("click", "view", "clicks_per_view"))


STATUS_SQL = "CASE WHEN count_if(event_type = '{k}') > 1 THEN 1.0 WHEN count_if(event_type = '{k}') = 1 THEN 0.5 ELSE 0.0 END"


@query("SELECT user_id, " + ", ".join(f"{STATUS_SQL.format(k=k)}::DOUBLE AS {k}" for k in KINDS) + ", round((" + " + ".join(STATUS_SQL.format(k=k) for k in KINDS) + f")::DOUBLE / {len(KINDS)}, 3) AS overall FROM events GROUP BY 1")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage of each user: 1 where it is complete (twice), 0.5 where it is partial (once), else 0; and their mean to three digits."""
    n = events(spark, sf_dir).groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in KINDS])
    part = lambda k: F.when(F.col(k) > 1, 1.0).when(F.col(k) == 1, 0.5).otherwise(0.0)
    total = sum((part(k) for k in KINDS[1:]), part(KINDS[0]))
    return n.select("user_id", *[part(k).alias(k) for k in KINDS], F.round(total / len(KINDS), 3).alias("overall"))


@query("SELECT event_type, count(*) AS events, sum(k)::BIGINT AS total, count(DISTINCT k) AS different FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    per_k = events(spark, sf_dir).select("event_type", k).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
    return per_k.groupBy("event_type").agg(F.sum("n").alias("events"), F.sum(F.col("k") * F.col("n")).alias("total"), F.count("k").alias("different"))


def tampered(chained: DataFrame) -> DataFrame:
    """A chain with faults in every log of a user_id divisible by 5: its third event says another type, its fifth is lost."""
    hit = F.col("user_id") % 5 == 0
    said = F.when(hit & (F.col("sequence") == 3), F.lit("forged")).otherwise(F.col("event_type"))
    return chained.where(~(hit & (F.col("sequence") == 5))).withColumn("event_type", said)


@query(f"""WITH RECURSIVE {CHAIN_SQL}, longest AS (SELECT user_id, max(sequence) AS n, arg_max(event_hash, sequence) AS head FROM chained GROUP BY 1)
  SELECT user_id, n - (user_id % 5 = 0 AND n >= 5)::INT AS events, (user_id % 5 = 0 AND n >= 3)::INT::BIGINT AS forged, (user_id % 5 = 0 AND n >= 6)::INT::BIGINT AS gaps, (user_id % 5 = 0 AND n >= 6)::INT::BIGINT AS broken_links FROM longest""")
def chain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains are written, some of them with planted faults, read again and followed: what the audit finds of each log."""
    source = events(spark, sf_dir).select("event_id", "user_id", "event_type", "props")
    kept = checkpointed(tampered(log.chain(source, ["user_id"], ["event_id"], payload())))
    found = log.verify_chain(kept, ["user_id"], "event_id", payload())
    count = lambda reason, name: F.count_if(F.col("reason") == reason).alias(name)
    faults = found.groupBy("user_id").agg(count("hash-mismatch", "forged"), count("sequence-gap", "gaps"), count("link-mismatch", "broken_links"))
    logs = kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return logs.join(faults, "user_id", "left").select("user_id", "events", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("forged", "gaps", "broken_links")])
