"""Run sessions folded from their start and end events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fold_sessions(events: DataFrame) -> DataFrame:
    """One row per session from `events(session_id, kind, at, command, exit_code, git_sha, branch, changed_files)`, where
    kind is start or end; a session without an end event is still running."""
    start = F.when(F.col("kind") == "start", F.col("at"))
    end = F.when(F.col("kind") == "end", F.col("at"))
    begun = ["command", "git_sha", "branch", "changed_files"]
    folded = events.groupBy("session_id").agg(
        F.min(start).alias("started_at"), F.max(end).alias("ended_at"), F.max_by("exit_code", end).alias("exit_code"),
        F.min_by(F.struct(*begun), start).alias("begun"),
    )
    return folded.select(
        "session_id", "begun.command", "started_at", "ended_at", "exit_code", "begun.git_sha", "begun.branch",
        F.coalesce("begun.changed_files", F.array().cast("array<string>")).alias("changed_files"),
    )
