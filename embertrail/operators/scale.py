"""Building blocks that keep plans balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from embertrail.session import durable

# A side is broadcast only when its measured content stays below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
# Rows of one key that a single task may hold before the key is salted.
ROWS_PER_TASK = 500_000


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters and projections read instead of repeating.

    The optimizer inlines a plain projected expression wherever a filter above uses it, which would parse a JSON text
    once per looked-up key. Columns coming out of a generator are evaluated once per row. The generator itself only passes
    on what a projection below it has made: projections run as compiled code that shares what is common to its columns,
    generators that hold JSON, regular expression or lambda work do not.
    """
    made = df.select("*", F.struct(*[value.alias(name) for name, value in columns.items()]).alias("_made"))
    return made.select("*", F.inline(F.array("_made"))).drop("_made")


def widen(df: DataFrame, *by: str) -> DataFrame:
    """At least one partition per core before work that multiplies or rewrites rows.

    A small table often arrives in one or two file splits; it is spread by `by`. Anything that already has a partition
    per core passes unchanged, so large inputs are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *by)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows as held in memory, from one pass over the columns' lengths."""
    widths = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        if kind == "string":
            widths.append(F.coalesce(F.octet_length(column), F.lit(0)) + 16)
        elif kind.startswith(("array", "map", "struct")):
            widths.append(F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) * 2)
        else:
            widths.append(F.lit(16))
    total = sum(widths[1:], widths[0]) if widths else F.lit(0)
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("bytes")).first()["bytes"]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark `df` for broadcast only when its measured size is below the limit; beyond it the join shuffles."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """1-based consecutive numbers in `order` (which must be total) over the whole table.

    Rows are range-partitioned and sorted, numbered inside each partition, and shifted by the sizes of the earlier
    partitions. The only table brought together is one count per partition.
    """
    marked = durable(df.orderBy(*order).withColumn("sort_mark", F.monotonically_increasing_id()))
    part = F.shiftright("sort_mark", 33)
    inside = F.col("sort_mark").bitwiseAND((1 << 33) - 1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(part.alias("part")).count().withColumn("shift", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    return (
        marked.withColumn("part", part)
        .join(F.broadcast(sizes.select("part", "shift")), "part")
        .withColumn(name, F.col("shift") + inside + 1)
        .drop("part", "shift", "sort_mark")
    )


def running_sums(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], carry: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds, per key, the running sums up to and including each row in `order` (total within a key), and the values that
    the columns of `previous` have in the row before (NULL in a key's first row).

    A plain window would bring a key's whole history into one task. Here rows are range-partitioned on (keys, order),
    so a long key spreads over many partitions: each partition sums its own rows, and every (key, partition) pair adds
    the totals of the key's earlier partitions.
    """
    columns, before = {**sums, **(carry or {})}, previous or {}
    placed = df.select("*", *[c.alias(f"_v_{n}") for n, c in columns.items()], *[c.alias(f"_p_{n}") for n, c in before.items()])
    placed = placed.orderBy(*[F.col(k) for k in keys], *order).withColumn("_mark", F.monotonically_increasing_id())
    placed = durable(placed).withColumn("_part", F.shiftright("_mark", 33))
    inside = Window.partitionBy("_part", *keys).orderBy("_mark")
    local = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", *keys).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums], F.count(F.lit(1)).alias("_n"),
        *([F.max_by(F.struct(*[f"_p_{n}" for n in before]), "_mark").alias("_last")] if before else []),
    )
    offsets = totals.select(
        "_part", *keys, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *([F.last("_last").over(earlier).alias("_before")] if before else []),
    )
    summed = placed.select(
        "*", *[F.sum(f"_v_{n}").over(local).alias(f"_s_{n}") for n in sums],
        *([F.lag(F.struct(*[f"_p_{n}" for n in before])).over(inside).alias("_prior")] if before else []),
    )
    joined = summed.join(offsets, ["_part", *keys])
    return joined.select(
        *[c for c in df.columns], *[(F.col(f"_s_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
        *[F.col(f"_v_{n}").alias(n) for n in (carry or {})], *[F.coalesce("_prior", "_before")[f"_p_{n}"].alias(n) for n in before],
    )


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """`keys` with more rows than a task should hold, and into how many parts to split each.

    At most (rows / rows_per_task) keys can qualify, which bounds the table.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
    return counted.filter(F.col("key_rows") > rows_per_task).select(
        *keys, F.ceil(F.col("key_rows") / F.lit(rows_per_task)).cast("int").alias("parts")
    )


def salted_join(
    facts: DataFrame, lookups: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """`facts` joined to a much smaller side, with the facts of hot keys split over several tasks.

    `spread_by` names columns that tell a hot key's rows apart; hashing them keeps the split the same when a task is
    rerun. Only the hot keys' lookup rows are repeated, once per part. For inner, left and left_semi joins.
    """
    hot = broadcast_if_small(durable(hot_keys(facts, keys, rows_per_task)))
    parts = F.coalesce("parts", F.lit(1))
    spread = facts.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*spread_by), parts).cast("int"))
    repeated = lookups.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.drop("parts").join(repeated.drop("parts"), [*keys, "salt"], how).drop("salt")


def lookup_join(
    facts: DataFrame, lookups: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner"
) -> DataFrame:
    """Join to a lookup side. Once the sides are shuffled their true sizes are known: adaptive execution then turns the
    join into a broadcast below `spark.sql.adaptive.autoBroadcastJoinThreshold`, and splits the partitions of hot keys
    beyond it. Nothing is run ahead of the query to size a side. `spread_by` names what tells a hot key's rows apart, for
    callers that salt a materialized side with `salted_join` instead."""
    return facts.join(lookups, keys, how)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows per key. Spark prunes each map task to k rows per key before the shuffle
    (`WindowGroupLimit`), so a hot key sends at most k rows per task."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`."""
    return top_rows(df, keys, order, 1, "latest_rank").drop("latest_rank")
