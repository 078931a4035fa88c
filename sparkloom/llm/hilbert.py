"""Sharding along a Hilbert curve over quantised metadata.

Four dimensions of BITS bits: source and lang by cumulative share (equi-depth over the sorted values),
length by the bit length of n_chars, doc_id by its place between the least and the greatest. Documents
are counted by cell of the grid; the curve index orders the cells, and runs of about target_chars
characters become shards. A cell above the target is split by doc_id modulo. The cells are at most
2 ** (4 * BITS) rows whatever the input, so they are broadcast; the text is shuffled once, by shard.

Defined results: null source or lang counts as the empty string, null n_chars as the length of the text,
null text as length 0, null doc_id as the least; repeated rows stay and fall in one cell; ties order by
doc_id; an empty table gives an empty one; extra columns pass through. The added columns hilbert and
shard_id replace columns of these names (in any case of letters).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shielded

BITS = 4
DIMS = ["__x0", "__x1", "__x2", "__x3"]
TARGET = 8_000_000
#: Above so many distinct values, the table of values is joined without a broadcast.
BROADCAST_VALUES = 100_000


def curve_steps(dims: list[str], bits: int, xor) -> list[dict[str, str]]:
    """Projections (column -> SQL) from coordinates to their transposed curve index (Skilling's method)."""
    n, top, steps = len(dims), 1 << (bits - 1), []
    q = top
    while q > 1:
        for i, x in enumerate(dims):
            a = dims[0]
            if i == 0:
                steps.append({a: f"CASE WHEN ({a} & {q}) <> 0 THEN {xor(a, str(q - 1))} ELSE {a} END"})
            else:
                swap = f"({xor(a, x)} & {q - 1})"
                steps.append({a: f"CASE WHEN ({x} & {q}) <> 0 THEN {xor(a, str(q - 1))} ELSE {xor(a, swap)} END", x: f"CASE WHEN ({x} & {q}) <> 0 THEN {x} ELSE {xor(x, swap)} END"})
        q >>= 1
    for i in range(1, n):
        steps.append({dims[i]: xor(dims[i], dims[i - 1])})
    t, q = "0", top
    while q > 1:
        t = xor(t, f"(CASE WHEN ({dims[-1]} & {q}) <> 0 THEN {q - 1} ELSE 0 END)")
        q >>= 1
    steps.append({x: xor(x, t) for x in dims})
    return steps


def index_sql(dims: list[str], bits: int) -> str:
    """Interleaves the bits of the transposed index."""
    n = len(dims)
    return " + ".join(f"(CASE WHEN ({x} & {1 << b}) <> 0 THEN {1 << (b * n + n - 1 - i)} ELSE 0 END)" for i, x in enumerate(dims) for b in range(bits))


def hilbert_index(df: DataFrame, dims: list[str], bits: int, name: str = "hilbert") -> DataFrame:
    """Adds the curve index of integer coordinates below 2 ** bits; the coordinate columns are used up."""
    for step in curve_steps(dims, bits, lambda a, b: f"({a} ^ {b})"):
        df = df.withColumns({c: F.expr(e) for c, e in step.items()})
    return df.withColumn(name, F.expr(index_sql(dims, bits)).cast("long")).drop(*dims)


def shares(docs: DataFrame, column: str, out: str) -> DataFrame:
    """A bin for each value of column, by the share of rows that sort before it."""
    value = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias(f"{out}v")
    counts = docs.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(f"{out}v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(f"{out}v", F.floor(before * (1 << BITS) / total).cast("int").alias(out))


def shard(docs: DataFrame, target_chars: int = TARGET) -> DataFrame:
    """Documents with hilbert and shard_id, each shard in one partition and sorted by the curve."""
    return shielded(docs, lambda d: placed(d, target_chars))


def placed(docs: DataFrame, target_chars: int) -> DataFrame:
    ids = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, span = (ids["lo"] or 0), (ids["hi"] or 0) - (ids["lo"] or 0) + 1
    size = F.coalesce(F.col("n_chars"), F.length("text"), F.lit(0)).cast("long")
    grid = docs.drop("hilbert", "shard_id").withColumns({
        "__size": size,
        "__x0v": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "__x1v": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "__x2": F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.length(F.bin(size)) - 2)).cast("int"),
        "__x3": F.expr(f"cast(((coalesce(doc_id, {lo}) - {lo}) * {1 << BITS}) div {span} as int)"),
    })
    for out, column in (("__x0", "source"), ("__x1", "lang")):
        values = shares(docs, column, out)
        small = values.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
        grid = grid.join(F.broadcast(values) if small else values, f"{out}v").drop(f"{out}v")
    cells = grid.groupBy(*DIMS).agg(F.sum("__size").alias("__chars"))
    cells = hilbert_index(cells.withColumns({f"{d}k": F.col(d) for d in DIMS}), DIMS, BITS)
    before = F.coalesce(F.sum("__chars").over(Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(*[F.col(f"{d}k").alias(d) for d in DIMS], "hilbert", F.floor(before / target_chars).cast("long").alias("__run"), F.greatest(F.lit(1), F.ceil(F.col("__chars") / target_chars)).cast("long").alias("__parts"))
    out = grid.join(F.broadcast(cells), DIMS).withColumn("shard_id", F.col("__run") + F.coalesce(F.pmod(F.col("doc_id"), F.col("__parts")), F.lit(0)))
    names = [c for c in docs.columns if c.lower() not in ("hilbert", "shard_id")]
    return out.select(*[F.col(f"`{c}`") for c in names], "hilbert", "shard_id").repartition("shard_id").sortWithinPartitions("shard_id", "hilbert", "doc_id")


def write_shards(docs: DataFrame, path: str, target_chars: int = TARGET, row_group_bytes: int = 32 << 20) -> None:
    """One folder for each shard, rows in curve order, so that folders, row groups and pages all prune on the metadata."""
    shard(docs, target_chars).write.option("parquet.block.size", row_group_bytes).partitionBy("shard_id").parquet(path)


def shard_sql(target_chars: int = TARGET) -> str:
    """DuckDB SQL for shard() over documents."""
    side = 1 << BITS
    bins = lambda c, o: f"SELECT {o}v, floor(coalesce(sum(n) OVER (ORDER BY {o}v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {side} / (sum(n) OVER ()))::INT AS {o} FROM (SELECT coalesce({c}, '') AS {o}v, count(*) AS n FROM documents GROUP BY 1)"
    d = [x.strip("_") for x in DIMS]
    cells = f"(SELECT {', '.join(d)}, {', '.join(f'{x} AS {x}k' for x in d)}, sum(size) AS chars FROM grid GROUP BY {', '.join(d)})"
    for step in curve_steps(d, BITS, lambda a, b: f"xor({a}, {b})"):
        cells = f"(SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in step.items())}) FROM {cells})"
    return f"""
    WITH ids AS (SELECT min(doc_id) AS lo, max(doc_id) - min(doc_id) + 1 AS span FROM documents),
    s AS ({bins("source", "x0")}), l AS ({bins("lang", "x1")}),
    base AS (SELECT d.*, coalesce(n_chars, length(text), 0) AS size, lo, span FROM documents d, ids),
    grid AS (SELECT base.*, x0, x1, least({side - 1}, greatest(0, length(bin(size)) - 2))::INT AS x2, (((coalesce(doc_id, lo) - lo) * {side}) // span)::INT AS x3
      FROM base JOIN s ON coalesce(source, '') = x0v JOIN l ON coalesce(lang, '') = x1v),
    cells AS (SELECT *, ({index_sql(d, BITS)})::BIGINT AS hilbert FROM {cells}),
    runs AS (SELECT *, floor(coalesce(sum(chars) OVER (ORDER BY hilbert ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {target_chars})::BIGINT AS run, greatest(1, ceil(chars / {target_chars}))::BIGINT AS parts FROM cells)
    SELECT doc_id, text, lang, source, n_chars, hilbert, run + coalesce(doc_id % parts, 0) AS shard_id
    FROM grid g JOIN runs r ON {" AND ".join(f"g.{x} = r.{x}k" for x in d)}"""
