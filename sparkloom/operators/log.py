"""Event-log operators: hash chains, replay to state, as-of durations."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def streamed(df: DataFrame, by: list[str], order: list[str], schema: str, step) -> DataFrame:
    """Runs over each log (the rows of equal by, in order) with a state that starts at None: step(state, row) gives a new state and the values to add.

    Logs are hash-partitioned and sorted, then pass through as a stream, so a log of any length needs the memory of one batch.
    """
    import pyarrow as pa

    names = df.columns
    added = [part.split()[0] for part in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[c] for c in by)
                if own != key:
                    key, state = own, None
                state, values = step(state, row)
                out.append(values)
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *added])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, f"{kept}, {schema}")


def event_hash(previous: str | None, digest: str) -> str:
    return hashlib.sha256(f"{previous or ''}|{digest}".encode()).hexdigest()


def chain(events: DataFrame, by: list[str], order: list[str], payload: Column) -> DataFrame:
    """Adds digest, sequence (from 1), previous_hash (null for the first) and event_hash.

    An event's hash covers the hash of the event before it, so the last one commits to the whole log. Only keys and digests
    pass through the fold; it is sequential within a log by its definition.
    """

    def step(state, row):
        n, previous = state or (0, None)
        own = event_hash(previous, row["digest"])
        return (n + 1, own), (n + 1, previous, own)

    return streamed(events.withColumn("digest", F.sha2(payload, 256)), by, order, "sequence bigint, previous_hash string, event_hash string", step)


def verify_chain(chained: DataFrame, by: list[str], id_column: str, payload: Column, first_type: Column | None = None) -> DataFrame:
    """What is wrong with written logs: the key columns, sequence and reason.

    Reasons: sequence-gap, link-mismatch, hash-mismatch, duplicate-id, and, with first_type (whether an event may only begin
    a log), missing-start and second-start. The chain is followed as it is written, so one fault is reported once.
    """

    def step(state, row):
        n, previous = state or (0, None)
        found = []
        if row["sequence"] != n + 1:
            found.append("sequence-gap")
        if row["previous_hash"] != previous:
            found.append("link-mismatch")
        if event_hash(row["previous_hash"], row["own_digest"]) != row["event_hash"]:
            found.append("hash-mismatch")
        if row["starts"] is not None and row["starts"] != int(n == 0):
            found.append("second-start" if row["starts"] else "missing-start" if n == 0 else "")
        return (row["sequence"], row["event_hash"]), ("|".join(x for x in found if x),)

    starts = first_type.cast("bigint") if first_type is not None else F.lit(None).cast("bigint")
    narrow = chained.select(*by, id_column, "sequence", "previous_hash", "event_hash", F.sha2(payload, 256).alias("own_digest"), starts.alias("starts"))
    told = streamed(narrow, by, ["sequence", id_column], "reasons string", step).where("reasons <> ''").select(*by, "sequence", F.explode(F.split("reasons", r"\|")).alias("reason"))
    twice = chained.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in by], F.max("sequence").alias("sequence")).where("n > 1")
    return told.unionByName(twice.select(*by, "sequence", F.lit("duplicate-id").alias("reason")))


def latest(events: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """State after replay: the values of the last event of each key, in one aggregation."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return events.groupBy(*by).agg(last.alias("__last"), F.count(F.lit(1)).alias("events")).select(*by, *[f"__last.{v}" for v in values], "events")


def as_of(events: DataFrame, by: list[str], order: list[str], is_start: Column, at: str) -> DataFrame:
    """Adds started_at: the time of the latest start at or before each event of the key; null where there is none."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("started_at", F.last(F.when(is_start, F.col(at)), ignorenulls=True).over(w))


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded, null where b is 0."""
    return F.when(b != 0, F.round(a / b, digits))
