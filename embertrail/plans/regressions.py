"""Deploy-bound regressions: how often each cluster's logs occur before and after every deploy of their service."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from embertrail.functions.scoring import percent_change, regression_confidence, regression_reason
from embertrail.operators.scale import lookup_join, running_sums
from embertrail.session import durable


# Deploys of one service that are handed to spans as one list, and windows that one task writes out, about.
BLOCK_DEPLOYS = 64
TASK_WINDOWS = 500_000
# Growth from which a spike is severe.
HIGH_PERCENT = 300


def window_spans(deploys: DataFrame, clustered: DataFrame, before_minutes: int, after_minutes: int) -> tuple[DataFrame, DataFrame]:
    """(spans, numbered): `spans(service, cluster_id, low, high, before_count, after_count, first_seen_after)` say what a
    cluster's counts are in the windows of deploys `low` to `high` of a service, where they hold any of its logs, and
    `numbered(service, number, deploy_id)` names the deploys.

    `clustered` holds `(log_id, ts, service, cluster_id)`. The window is [d-before, d) and [d, d+after].

    One sweep over a service's logs and edges in time order numbers the deploys and tells each log how many windows have
    begun, reached their deploy and ended before it. As all windows are equally long, a log lies before an edge of deploy n
    if fewer than n such edges came before it. Logs of a cluster between the same edges become one row; each is added to the
    three running counts at the deploys from which on it lies before their edge. Between two such deploys nothing changes,
    so there are at most three spans per row, however many deploys' windows hold it. The first log after a deploy is a
    running sum too, of the steps from each row's time to the next.
    """
    return _swept(deploys, clustered, before_minutes, after_minutes)[:2]


def _swept(deploys: DataFrame, clustered: DataFrame, before_minutes: int, after_minutes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`spans` and `numbered` of `window_spans`, and `firsts(service, cluster_id, first_seen, begun)`: of each service with logs
    of a cluster, the cluster's first log of any service and how many of the service's windows have begun by then."""
    moved = lambda minutes: F.col("deployed_at") + F.make_dt_interval(mins=F.lit(minutes))
    known = deploys.filter(F.col("service").isNotNull() & F.col("deployed_at").isNotNull())
    # At one instant windows begin and deploys happen before the logs, and windows end after them.
    edges = known.select(
        "service", F.col("deploy_id").alias("id"), F.lit(None).cast("bigint").alias("cluster_id"),
        F.inline(F.array(
            F.struct(moved(-before_minutes).alias("at"), F.lit(0).alias("kind")),
            F.struct(F.col("deployed_at").alias("at"), F.lit(1).alias("kind")), F.struct(moved(after_minutes).alias("at"), F.lit(3).alias("kind")),
        )),
    )
    logs = clustered.filter(F.col("ts").isNotNull() & (F.col("cluster_id") >= 0))
    events = logs.filter(F.col("service").isNotNull()).select("service", F.col("log_id").alias("id"), F.col("cluster_id").cast("bigint"), F.col("ts").alias("at"), F.lit(2).alias("kind"))
    marks = events.select("service", "cluster_id").distinct().join(first_seen(clustered), "cluster_id").select(
        "service", F.lit(None).cast("string").alias("id"), F.col("cluster_id").cast("bigint"), F.col("first_seen").alias("at"), F.lit(4).alias("kind")
    )
    swept = durable(running_sums(
        edges.unionByName(events).unionByName(marks), ["service"], [F.col("at"), F.col("kind"), F.col("id")],
        {name: (F.col("kind") == kind).cast("bigint") for name, kind in (("begun", 0), ("deployed", 1), ("ended", 3))},
    ))
    numbered = swept.filter(F.col("kind") == 0).select("service", F.col("begun").alias("number"), F.col("id").alias("deploy_id"))
    firsts = swept.filter(F.col("kind") == 4).select("service", "cluster_id", F.col("at").alias("first_seen"), "begun")

    place = ["begun", "deployed", "ended"]
    tallies = swept.filter(F.col("kind") == 2).groupBy("service", "cluster_id", *place).agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("at")).alias("first_at"))
    rows = running_sums(tallies, ["service", "cluster_id"], [F.col(name) for name in place], {}, previous={f"{name}_0": F.col(name) for name in ("deployed", "first_at")})
    zero = F.lit(0).cast("bigint")
    step = F.col("first_at") - F.coalesce("first_at_0", zero)
    names = ("begin", "deploy", "end", "first")
    changes = [
        F.struct((at + 1).alias("at"), *[(added if name == edge else zero).alias(f"d_{name}") for name in names])
        for edge, at, added in (
            ("begin", F.col("begun"), F.col("n")), ("deploy", F.col("deployed"), F.col("n")), ("end", F.col("ended"), F.col("n")),
            ("first", F.coalesce("deployed_0", zero), step),
        )
    ]
    changed = rows.select("service", "cluster_id", F.inline(F.array(*changes))).groupBy("service", "cluster_id", "at").agg(
        *[F.sum(f"d_{name}").alias(f"d_{name}") for name in names]
    )
    summed = running_sums(changed, ["service", "cluster_id"], [F.col("at")], {name: F.col(f"d_{name}") for name in names}, previous={"low": F.col("at")})
    begin, deploy, end, first = (F.col(name) - F.col(f"d_{name}") for name in names)
    spans = summed.filter(F.col("low").isNotNull() & (end > begin)).select(
        "service", "cluster_id", "low", (F.col("at") - 1).alias("high"), (deploy - begin).alias("before_count"), (end - deploy).alias("after_count"),
        F.when(end > deploy, F.timestamp_micros(first)).alias("first_seen_after"),
    )
    return spans, numbered, firsts


def first_seen(clustered: DataFrame) -> DataFrame:
    """Each cluster's first log of any service."""
    return clustered.filter(F.col("ts").isNotNull() & (F.col("cluster_id") >= 0)).groupBy("cluster_id").agg(F.min("ts").alias("first_seen"))


def per_window(spans: DataFrame, named: DataFrame) -> DataFrame:
    """One row per deploy and span that reaches it, with the columns of `named(service, number, …)`.

    Deploys meet the spans as lists of neighbouring ones, so what is shuffled are spans; windows are written out behind the
    join and not moved again.
    """
    block = lambda number: F.floor((F.col(number) - 1) / BLOCK_DEPLOYS)
    rest = [name for name in named.columns if name not in ("service", "number")]
    held = [name for name in spans.columns if name not in ("service", "low", "high", *rest)]
    pieces = durable(spans.withColumn("block", F.explode(F.sequence(block("low"), block("high")))))
    windows = pieces.agg(F.sum(F.least("high", (F.col("block") + 1) * BLOCK_DEPLOYS) - F.greatest("low", F.col("block") * BLOCK_DEPLOYS))).first()[0] or 0
    parts = max(pieces.sparkSession.sparkContext.defaultParallelism, -(-windows // TASK_WINDOWS))
    lists = named.groupBy("service", block("number").alias("block")).agg(F.collect_list(F.struct("number", *rest)).alias("listed"))
    met = pieces.repartition(parts, "service", "block").join(lists, ["service", "block"])
    reached = F.filter("listed", lambda deploy: deploy["number"].between(F.col("low"), F.col("high")))
    return met.select(*held, F.inline(reached)).drop("number")


def window_counts(deploys: DataFrame, clustered: DataFrame, before_minutes: int, after_minutes: int) -> DataFrame:
    """`(deploy_id, cluster_id, before_count, after_count, first_seen_after, first_seen)` of all windows that hold a log of
    the cluster (see `window_spans`); `first_seen` is the cluster's first log of any service."""
    spans, numbered, firsts = _swept(deploys, clustered, before_minutes, after_minutes)
    spans = lookup_join(spans, firsts.drop("begun"), ["service", "cluster_id"], ["low"])
    return per_window(spans, numbered).select("deploy_id", "cluster_id", "before_count", "after_count", "first_seen_after", "first_seen")


def classify(
    counts: DataFrame, before_minutes: int, min_growth: int, spike_percent: float
) -> DataFrame:
    """Adds delta, percent_change, regression_type and severity; pairs that are no regression drop out.

    `counts` carries the deploy time next to the columns of `window_counts`.
    """
    window_start = F.col("deployed_at") - F.make_dt_interval(mins=F.lit(before_minutes))
    measured = (
        counts.filter(F.col("after_count") > 0)
        .withColumn("delta", F.col("after_count") - F.col("before_count"))
        .withColumn("percent_change", percent_change(F.col("before_count"), F.col("after_count")))
    )
    absent_before = F.col("before_count") == 0
    kind = (
        F.when(absent_before & (F.col("first_seen") < window_start), "reappearing_cluster")
        .when(absent_before & F.col("first_seen_after").isNotNull(), "new_cluster_after_deploy")
        .when((F.col("delta") >= min_growth) & (F.col("percent_change") >= spike_percent), "frequency_spike_after_deploy")
    )
    severity = (
        F.when(F.col("regression_type") == "new_cluster_after_deploy", "high")
        .when((F.col("regression_type") == "frequency_spike_after_deploy") & (F.col("percent_change") >= HIGH_PERCENT), "high")
        .otherwise("medium")
    )
    typed = measured.withColumn("regression_type", kind).filter(F.col("regression_type").isNotNull())
    return typed.withColumn("severity", severity)


class Regressions:
    """The regressions of every deploy, each in one span of deploys over which its counts are equal. They are written out when
    they are asked for: all of them (`rows`), those of some clusters (`rows_of`), or those that incidents go by (`leading`)."""

    def __init__(
        self, deploys: DataFrame, clustered: DataFrame, clusters: DataFrame, before_minutes: int, after_minutes: int, min_growth: int,
        spike_percent: float,
    ):
        self.rules = (before_minutes, min_growth, spike_percent)
        self.clusters = clusters.select("cluster_id", "cluster_key", "example_message")
        spans, numbered, firsts = _swept(deploys, clustered, before_minutes, after_minutes)
        before, after = F.col("before_count"), F.col("after_count")
        # What is constant in a span is looked at there: most windows are no regression and are never written out.
        may_be = (before == 0) | ((after - before >= min_growth) & (percent_change(before, after) >= spike_percent))
        self.spans = durable(lookup_join(spans.filter((after > 0) & may_be), firsts, ["service", "cluster_id"], ["low"]))
        facts = deploys.select("deploy_id", F.col("service").alias("deploy_service"), "deployed_at", "commit_sha", "branch", "changed_files")
        self.named = durable(lookup_join(numbered, facts, ["deploy_id"], ["number"]))
        self.others: Regressions | None = None

    def written(self, clusters: DataFrame | None = None) -> DataFrame:
        """All regressions, or those of some of the clusters."""
        spans = lookup_join(self.spans.drop("begun"), self.clusters if clusters is None else clusters, ["cluster_id"], ["low"])
        found = self._finished(per_window(spans, self.named))
        return found if self.others is None else found.unionByName(self.others.written(clusters))

    @functools.cached_property
    def rows(self) -> DataFrame:
        return durable(self.written())

    def rows_of(self, cluster_keys: DataFrame) -> DataFrame:
        """The regressions of `cluster_keys(cluster_key)`."""
        return durable(self.written(self.clusters.join(cluster_keys, "cluster_key", "left_semi")))

    @functools.cached_property
    def leading(self) -> DataFrame:
        """Of each cluster at least its first and last regression in `regression_order` and the first that names changed files.

        Deploys of a service are numbered in time order, so what a service's deploys find of a cluster is compared by severity,
        counts and number alone: the first regression of a span lies at its lowest deploy, the last one at its highest. A
        span that reaches over the deploys after which the cluster no longer counts as new is two of them.
        """
        return durable(self._leading() if self.others is None else self._leading().unionByName(self.others.written()))

    def _leading(self) -> DataFrame:
        before_minutes, min_growth, spike_percent = self.rules
        absent, begun = F.col("before_count") == 0, F.col("begun")
        part = lambda here, low, high, lower: F.when(here, F.struct(low.alias("from"), high.alias("to"), lower.alias("lower")))
        low, high = F.col("low"), F.col("high")
        parts = F.array(
            part(absent & (low <= begun), low, F.least(high, begun), F.lit(False)),
            part(absent & (high > begun), F.greatest(low, begun + 1), high, F.lit(True)),
            part(~absent, low, high, percent_change(F.col("before_count"), F.col("after_count")) < HIGH_PERCENT),
        )
        held = ["before_count", "after_count", "first_seen_after", "first_seen"]
        rows = self.spans.select("service", "cluster_id", *held, F.inline(F.filter(parts, lambda p: p.isNotNull())))
        rows = rows.join(self._next_with_files(), [rows["service"] == F.col("files_service"), rows["from"] == F.col("files_from")], "left").drop("files_service", "files_from")
        place = lambda number: F.struct(
            "lower", (F.col("before_count") - F.col("after_count")).alias("delta"), (-F.col("after_count")).alias("after"), F.col(number).alias("number"), *held,
        )
        ends = rows.groupBy("service", "cluster_id").agg(
            F.min(place("from")).alias("first"), F.max(place("to")).alias("last"),
            F.min(F.when(F.col("with_files") <= F.col("to"), place("with_files"))).alias("filed"),
        )
        chosen = ends.select("service", "cluster_id", F.explode(F.array_distinct(F.array("first", "last", "filed"))).alias("found")).filter("found IS NOT NULL")
        chosen = chosen.select("service", "cluster_id", "found.number", *[f"found.{name}" for name in held])
        met = chosen.join(self.named, ["service", "number"]).drop("service", "number")
        return self._finished(lookup_join(met, self.clusters, ["cluster_id"], ["deploy_id"]))

    def _next_with_files(self) -> DataFrame:
        """`(files_service, files_from, with_files)`: of each deploy the first from it on that names changed files."""
        filed = F.max((F.size("changed_files") > 0).cast("bigint"))
        counted = running_sums(
            self.named.groupBy("service", "number").agg(F.coalesce(filed, F.lit(0)).alias("filed")), ["service"], [F.col("number")], {"upto": F.col("filed")}
        )
        counted = durable(counted)
        ranked = counted.filter("filed = 1").select(F.col("service").alias("files_service"), F.col("upto").alias("turn"), F.col("number").alias("with_files"))
        here = counted.select(F.col("service").alias("files_service"), F.col("number").alias("files_from"), (F.col("upto") - F.col("filed") + 1).alias("turn"))
        return here.join(ranked, ["files_service", "turn"]).drop("turn")

    def _finished(self, windows: DataFrame) -> DataFrame:
        """Regressions among windows that carry their deploy and cluster."""
        before, after = F.col("before_count"), F.col("after_count")
        named = classify(windows.withColumnRenamed("deploy_service", "service"), *self.rules)
        files = F.coalesce("changed_files", F.array().cast("array<string>"))
        return named.select(
            "regression_type", "cluster_id", "cluster_key", "deploy_id", "service", "deployed_at", "commit_sha", "branch",
            files.alias("changed_files"), "before_count", "after_count", "delta", "percent_change", "first_seen_after", "severity",
            regression_confidence(before, after, files, F.col("severity")).alias("confidence"),
            regression_reason(
                F.col("regression_type"), F.col("service"), F.col("deploy_id"), F.col("commit_sha"), before, after,
                F.col("percent_change"), files,
            ).alias("reason"),
            "example_message",
        )


def find_regressions(
    deploys: DataFrame, logs: DataFrame, assignments: DataFrame, clusters: DataFrame, before_minutes: int = 60,
    after_minutes: int = 60, min_growth: int = 2, spike_percent: float = 200.0,
) -> Regressions:
    """Regressions of every deploy; `assignments(log_id, cluster_id)` and `clusters(cluster_id, cluster_key, example_message)`
    are those of one run."""
    clustered = durable(logs.select("log_id", "ts", "service").join(assignments.select("log_id", "cluster_id"), "log_id"))
    deploys = deploys.filter(F.col("deploy_id").isNotNull())
    place = F.struct("service", "deployed_at")
    spread = deploys.groupBy("deploy_id").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter(~F.col("low").eqNullSafe(F.col("high")))
    spread = durable(spread.select("deploy_id"))
    made = lambda some: Regressions(some, clustered, clusters, before_minutes, after_minutes, min_growth, spike_percent)
    if spread.isEmpty():
        return made(deploys)
    # An id that stands for deploys of several services or times tells no place of its own: such deploys are always written out.
    found = made(deploys.join(spread, "deploy_id", "left_anti"))
    found.others = made(deploys.join(spread, "deploy_id", "left_semi"))
    return found


def detect_regressions(
    deploys: DataFrame, logs: DataFrame, assignments: DataFrame, clusters: DataFrame, before_minutes: int = 60,
    after_minutes: int = 60, min_growth: int = 2, spike_percent: float = 200.0,
) -> DataFrame:
    """All of `find_regressions`, in the `regressions` layout without ids."""
    return find_regressions(deploys, logs, assignments, clusters, before_minutes, after_minutes, min_growth, spike_percent).written()


def regression_order() -> list[Column]:
    """Worst first; ties in the order the deploys and their clusters are examined."""
    return [
        F.desc(F.col("severity") == "high"), F.desc("delta"), F.desc("after_count"), F.asc("deployed_at"),
        F.asc("deploy_id"), F.asc("cluster_id"),
    ]


def regression_place() -> Column:
    """The same order as one value to compare."""
    return F.struct(
        (F.col("severity") != "high").alias("lower"), (-F.col("delta")).alias("delta"), (-F.col("after_count")).alias("after"), "deployed_at",
        "deploy_id", "cluster_id",
    )


def stored_order() -> list[Column]:
    """Newest deploy first, then high before medium (ranked, not compared as text)."""
    return [F.desc("deployed_at"), F.desc(F.col("severity") == "high"), F.desc("delta"), F.asc("deploy_id"), F.asc("cluster_id"), F.asc("regression_type")]


def list_regressions(regressions: DataFrame) -> DataFrame:
    return regressions.orderBy(*stored_order())


def merge_regressions(current: DataFrame, found: DataFrame) -> DataFrame:
    """Upsert by (type, cluster key, deploy) of the columns that `current` has: known regressions keep their id, new ones are numbered on in detection
    order; of several findings of one key the last one counts."""
    from embertrail.operators.scale import latest_wins, number_rows

    keys = ["regression_type", "cluster_key", "deploy_id"]
    newest = latest_wins(found, keys, [F.desc("deployed_at"), F.asc("after_count"), F.desc("cluster_id")])
    known = current.select("regression_id", *keys, F.lit(True).alias("is_known"))
    newest = durable(newest.join(known, keys, "left"))
    kept, added = newest.filter("is_known"), newest.filter(F.col("is_known").isNull()).drop("regression_id")
    top = current.agg(F.coalesce(F.max("regression_id"), F.lit(0)).alias("top"))
    numbered = number_rows(
        added, [F.col("deployed_at"), F.col("deploy_id"), F.desc("after_count"), F.col("cluster_id"), F.col("regression_type")], "n"
    ).join(F.broadcast(top)).withColumn("regression_id", F.col("top") + F.col("n")).drop("top", "n")
    untouched = current.join(newest.select(*keys), keys, "left_anti")
    columns = current.columns
    return untouched.select(*columns).unionByName(kept.select(*columns)).unionByName(numbered.select(*columns))
