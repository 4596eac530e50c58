"""Clusters that are new, growing or statistically rare compared with earlier clustering runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embertrail.functions.scoring import fixed
from embertrail.operators.matching import best_matches
from embertrail.operators.scale import latest_wins, number_rows, running_sums
from embertrail.operators.tables import latest_run
from embertrail.session import durable


def _size_sums(history: DataFrame) -> DataFrame:
    """Per (key, run): entries, exact sums of sizes and squares, and the run's last size."""
    size = F.col("log_count").cast("decimal(38,0)")
    return history.groupBy("cluster_key", "run_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.col("log_count").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"),
        F.sum((F.col("log_count").cast("decimal(19,0)") * F.col("log_count").cast("decimal(19,0)"))).cast("decimal(38,0)").alias("squares"),
        F.max_by(size, "cluster_id").alias("last_size"),
    )


def baseline_columns(entries: Column, total: Column, squares: Column, last_size: Column) -> list[Column]:
    """Mean and population deviation of all sizes but the last one; exact integers until the final root."""
    n = (entries - 1).cast("decimal(19,0)")
    rest = total - last_size
    rest_squares = squares - last_size * last_size
    spread = n * rest_squares - rest * rest
    return [
        entries.alias("history_points"),
        F.try_divide(rest.cast("double"), n.cast("double")).alias("baseline_mean"),
        F.when(n > 1, F.try_divide(F.sqrt(spread.cast("double")), n.cast("double"))).otherwise(F.lit(0.0)).alias("baseline_sigma"),
    ]


def z_score(size: Column) -> Column:
    """0 without a varying baseline."""
    score = F.try_divide(size.cast("double") - F.col("baseline_mean"), F.nullif("baseline_sigma", F.lit(0.0)))
    return F.when(F.col("history_points") >= 2, F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0))


def history_baselines(history: DataFrame) -> DataFrame:
    """`(cluster_key, run_id, history_points, baseline_mean, baseline_sigma)` for every key and run: the sizes up to and
    including the run, its last one left out. Running sums keep one long-lived key from filling a task."""
    sums = _size_sums(history)
    columns = {name: F.col(name) for name in ("entries", "total", "squares")}
    running = running_sums(sums.select("cluster_key", "run_id", "last_size", *[F.col(c).alias(f"in_{c}") for c in columns]),
                           ["cluster_key"], [F.col("run_id")], {c: F.col(f"in_{c}") for c in columns})
    as_exact = lambda name: F.col(name).cast("decimal(38,0)")
    return running.select(
        "cluster_key", "run_id", *baseline_columns(F.col("entries"), as_exact("total"), as_exact("squares"), F.col("last_size"))
    )


def latest_baselines(history: DataFrame, newest: DataFrame) -> DataFrame:
    """The same for the newest run only, as one aggregation."""
    sums = _size_sums(history.join(F.broadcast(newest.select(F.col("run_id").alias("upto"))), F.col("run_id") <= F.col("upto")))
    whole = sums.groupBy("cluster_key").agg(
        F.sum("entries").alias("entries"), F.sum("total").cast("decimal(38,0)").alias("total"),
        F.sum("squares").cast("decimal(38,0)").alias("squares"), F.max_by("last_size", "run_id").alias("last_size"),
    )
    return whole.select("cluster_key", *baseline_columns(F.col("entries"), F.col("total"), F.col("squares"), F.col("last_size")))


def _describe(compared: DataFrame, min_growth: int, z_threshold: float) -> DataFrame:
    """Types, severities and reasons from `(…, previous_size or NULL, previous_run_id or NULL, baselines)`."""
    size = F.col("log_count")
    rows = (
        compared.filter(F.col("previous_run_id").isNotNull())
        .withColumn("novel", F.col("previous_size").isNull())
        .withColumn("previous_size", F.coalesce("previous_size", F.lit(0)).cast("bigint"))
        .withColumn("delta", size - F.col("previous_size"))
        .filter(F.col("novel") | (F.col("delta") >= min_growth))
        .withColumn("z_score", F.when(F.col("novel"), F.lit(0.0)).otherwise(z_score(size)))
    )
    rare = ~F.col("novel") & (F.col("history_points") >= 2) & (F.col("z_score") >= z_threshold)
    kind = F.when(F.col("novel"), "novel_cluster").when(rare, "rare_spike").otherwise("growth_spike")
    reason = (
        F.when(F.col("novel"), F.lit("Cluster appears in the latest run but was absent in the previous snapshot."))
        .when(rare, F.concat(F.lit("Cluster size is "), fixed(F.col("z_score"), 2), F.lit(" standard deviations above its historical baseline.")))
        .otherwise(F.concat(F.lit("Cluster grew by "), F.col("delta").cast("string"), F.lit(" logs between the last two clustering runs.")))
    )
    return rows.select(
        "run_id", kind.alias("anomaly_type"), "cluster_key", "cluster_id", size.alias("current_size"), "previous_size", "delta",
        "z_score", F.when(F.col("novel") | rare, "high").otherwise("medium").alias("severity"), reason.alias("reason"), "example_message",
    )


def _previous_by_key(previous: DataFrame, keys: list[str]) -> DataFrame:
    """Of several clusters of one key the last in listing order (fewest logs, then highest id) counts."""
    return latest_wins(previous, keys, [F.asc("log_count"), F.desc("cluster_id")])


def detect_anomalies(
    history: DataFrame, runs: DataFrame, min_growth: int = 2, z_threshold: float = 2.0, match_threshold: float = 0.92
) -> DataFrame:
    """Anomalies of the newest run against the one before it; nothing without an earlier run."""
    newest = durable(latest_run(runs))
    latest = history.join(F.broadcast(newest), "run_id")
    previous = history.join(F.broadcast(newest.select(F.col("previous_run_id").alias("run_id"))), "run_id")
    by_key = _previous_by_key(previous, ["cluster_key"]).select("cluster_key", F.col("log_count").alias("key_size"))
    compared = latest.join(by_key, "cluster_key", "left")
    matched = best_matches(compared.filter(F.col("key_size").isNull()), previous, match_threshold)
    compared = compared.join(matched.select("cluster_id", F.col("matched_size")), "cluster_id", "left")
    compared = compared.withColumn("previous_size", F.coalesce("key_size", "matched_size"))
    return _describe(compared.join(latest_baselines(history, newest), "cluster_key", "left"), min_growth, z_threshold)


def detect_anomalies_by_run(history: DataFrame, runs: DataFrame, min_growth: int = 2, z_threshold: float = 2.0) -> DataFrame:
    """Anomalies of every run against the run before it, matched by cluster key.

    The order of runs comes from the run table, since a run without clusters leaves no history rows.
    """
    ordered = durable(number_rows(runs.select("run_id").distinct(), [F.col("run_id")], "turn"))
    before = ordered.select((F.col("turn") + 1).alias("turn"), F.col("run_id").alias("previous_run_id"))
    steps = ordered.join(before, "turn", "left").drop("turn")
    sizes = _previous_by_key(history, ["run_id", "cluster_key"]).select(
        F.col("run_id").alias("previous_run_id"), "cluster_key", F.col("log_count").alias("previous_size")
    )
    compared = history.join(steps, "run_id").join(sizes, ["previous_run_id", "cluster_key"], "left")
    return _describe(compared.join(history_baselines(history), ["cluster_key", "run_id"], "left"), min_growth, z_threshold)


def anomaly_order() -> list[Column]:
    """Worst first; ties in cluster listing order."""
    return [F.desc(F.col("severity") == "high"), F.desc("delta"), F.desc("current_size"), F.asc("cluster_id")]
