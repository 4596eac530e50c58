"""Log lines and sessions standing for a cluster, for all clusters at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embertrail.operators.scale import lookup_join, top_rows


def distinct_messages(members: DataFrame) -> DataFrame:
    """Each cluster's distinct messages with their first and last time; copies are combined before the shuffle."""
    return members.groupBy("cluster_id", "message").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def oldest_messages(members: DataFrame, k: int = 5) -> DataFrame:
    """`(cluster_id, rank, message, first_ts)`: the k earliest distinct messages, missing times last."""
    order = [F.asc_nulls_last("first_ts"), F.asc("message")]
    return top_rows(distinct_messages(members), ["cluster_id"], order, k).select("cluster_id", "rank", "message", "first_ts")


def newest_messages(members: DataFrame, k: int = 5) -> DataFrame:
    """`(cluster_id, rank, message, last_ts)`: the k latest distinct messages."""
    order = [F.desc_nulls_last("last_ts"), F.asc("message")]
    return top_rows(distinct_messages(members), ["cluster_id"], order, k).select("cluster_id", "rank", "message", "last_ts")


def first_logs(members: DataFrame, k: int) -> DataFrame:
    """The k first log rows of each cluster, copies included."""
    return top_rows(members, ["cluster_id"], [F.asc_nulls_last("ts"), F.asc("log_id")], k)


def cluster_sessions(members: DataFrame, sessions: DataFrame, k: int = 5) -> DataFrame:
    """`(cluster_id, rank, session_id, command, git_sha, exit_code)`: the k newest sessions seen in a cluster's logs.

    Logs shrink to distinct (cluster, session) pairs before they meet the session table.
    """
    seen = members.filter(F.col("session_id").isNotNull()).select("cluster_id", "session_id").distinct()
    facts = sessions.select("session_id", "command", "git_sha", "exit_code")
    joined = lookup_join(seen, facts, ["session_id"], ["cluster_id"])
    return top_rows(joined, ["cluster_id"], [F.desc("session_id")], k)


def session_text() -> Column:
    return F.concat(
        F.lit("session="), F.col("session_id").cast("string"), F.lit(" command="), F.col("command"), F.lit(" git_sha="),
        F.coalesce(F.nullif("git_sha", F.lit("")), F.lit("unknown")), F.lit(" exit_code="),
        F.coalesce(F.col("exit_code").cast("string"), F.lit("running")),
    )


def ordered_texts(rows: DataFrame, key: str, order: str, text: str, name: str) -> DataFrame:
    """One array per key of a bounded number of ranked texts."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return rows.groupBy(key).agg(F.transform(pairs, lambda pair: pair[text]).alias(name))
