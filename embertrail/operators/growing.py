"""Density clustering of a table that grows: a batch compares only its own vectors with what lies near them.

What is stored per distinct vector is its weight, its neighbours' weight, whether it is core, its group and its leaf of a
metric tree. A batch adds weight to known vectors and brings new ones. Both are sent to the leaves within the radius, where
neighbour weights are brought up to date; they never fall, so rows only ever become core. New core rows and new rows are then
sent out once more, to join groups and to note which rows they border. The groups that meet are united, and clusters are
numbered anew by their first core row. Labels equal those of `density_clusters` over all rows at once.

The rows compared depend on the batch and on how many rows lie near it, not on how much is stored. Reading the stored
columns and writing everyone's label stay linear, as a clustering run lists all its rows. Each batch writes its own version
of the state, so a batch that is repeated starts from the same one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrail.operators.balltree import NODES, at_root, home_leaves, meet, split_nodes, unit_points, visited_leaves
from embertrail.operators.components import connected_components
from embertrail.operators.density import NOISE, _hits, forest, grouped_vectors, keyed_vectors
from embertrail.operators.scale import lookup_join, number_rows
from embertrail.operators.tiles import TILE_ROWS
from embertrail.session import durable

TABLES = {
    "points": "row_id long, h1 long, h2 long, weight long, first struct<missing: boolean, ts: timestamp, log_id: string>, zero boolean, leaf long, "
    "neighbours long, core boolean, grp long",
    "vectors": "row_id long, vector array<double>",
    "members": "log_id string, row_id long",
    "borders": "a long, b long",
    "nodes": NODES,
}


def _count_work(top: int):
    """What a batch adds to the neighbours of rows up to `top`, and all neighbours of the rows beyond it, which are new."""

    def count(eps: float):
        def work(visitors: pd.DataFrame, homes: pd.DataFrame) -> pd.DataFrame:
            hits = _hits(homes, visitors, eps)
            known, new = homes["row_id"].to_numpy() <= top, visitors["row_id"].to_numpy() > top
            gained, whole = hits[known] @ visitors["weight"].to_numpy(), hits[:, new].T @ homes["weight"].to_numpy()
            found = pd.DataFrame({"row_id": np.concatenate([homes["row_id"].to_numpy()[known], visitors["row_id"].to_numpy()[new]]), "neighbours": np.concatenate([gained, whole])})
            return found[found["neighbours"] > 0]

        return work

    return count


def _link_work(eps: float):
    """Edges between core rows, and (row that is none, core row) pairs; a visitor's weight says whether it is core."""

    def work(visitors: pd.DataFrame, homes: pd.DataFrame) -> pd.DataFrame:
        hits = _hits(homes, visitors, eps)
        core, sure = homes["core"].to_numpy().astype(bool), visitors["weight"].to_numpy() == 1
        down, across = homes["row_id"].to_numpy(), visitors["row_id"].to_numpy()
        edges = pd.DataFrame(forest(hits[core][:, sure], down[core], across[sure]), columns=["a", "b"]).drop_duplicates()
        row, column = np.nonzero(hits & ~core[:, None] & sure[None, :])
        back, forth = np.nonzero(hits & core[:, None] & ~sure[None, :])
        border = pd.DataFrame({"a": np.concatenate([down[row], across[forth]]), "b": np.concatenate([across[column], down[back]]), "border": True})
        return pd.concat([edges.assign(border=False), border], ignore_index=True)

    return work


@dataclass
class GrowingClusters:
    """The state lives under `root`, a folder that every executor can reach."""

    root: str
    eps: float
    min_samples: int
    leaf_rows: int = TILE_ROWS

    def _stored(self, spark: SparkSession, table: str) -> DataFrame:
        schema = TABLES[table] + ", version long"
        try:
            return spark.read.schema(schema).parquet(f"{self.root.rstrip('/')}/{table}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return spark.createDataFrame([], schema)
            raise

    def _write(self, rows: DataFrame, table: str, version: int) -> None:
        (
            rows.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("version").parquet(f"{self.root.rstrip('/')}/{table}")
        )

    def _before(self, spark: SparkSession, table: str, version: int, newest: int | None = None) -> DataFrame:
        """What earlier versions added, or the whole table as the newest of them left it."""
        stored = self._stored(spark, table)
        kept = stored.filter(F.col("version") < version) if newest is None else stored.filter(F.col("version") == newest)
        return kept.drop("version")

    def add(self, rows: DataFrame, version: int) -> DataFrame:
        """`(log_id, cluster_id)` of all rows after `rows(log_id, ts, vector)`; those added by earlier versions are skipped."""
        spark = rows.sparkSession
        newest = self._stored(spark, "points").filter(F.col("version") < version).agg(F.max("version")).first()[0]
        newest = -1 if newest is None else newest
        points, nodes = self._before(spark, "points", version, newest), self._before(spark, "nodes", version, newest)
        members = self._before(spark, "members", version)
        keyed = durable(keyed_vectors(rows.join(members.select("log_id"), "log_id", "left_anti"), self.eps))
        top = points.agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0]
        zero = ~F.exists("vector", lambda x: x != 0) & F.lit(self.eps < 1.0)
        groups = durable(grouped_vectors(keyed).withColumn("zero", zero).join(points.select("h1", "h2", F.col("row_id").alias("known")), ["h1", "h2"], "left"))
        fresh = number_rows(groups.filter(F.col("known").isNull()).drop("known"), [F.col("h1"), F.col("h2")], "n")
        fresh = durable(fresh.withColumn("row_id", F.col("n") + top).drop("n"))
        gained = groups.filter(F.col("known").isNotNull()).select(F.col("known").alias("row_id"), F.col("weight").alias("added"), F.col("first").alias("added_first"))

        units = durable(unit_points(fresh.filter(~F.col("zero"))))
        homes, nodes = home_leaves(units, nodes)
        vectors = self._before(spark, "vectors", version).unionByName(units.select("row_id", "vector"))
        known = points.join(gained, "row_id", "left").withColumn("weight", F.col("weight") + F.coalesce("added", F.lit(0))).withColumn(
            "first", F.least("first", F.coalesce("added_first", "first"))
        )
        new = fresh.join(homes.select("row_id", F.col("node").alias("leaf")), "row_id", "left").select(
            "row_id", "h1", "h2", "weight", "first", "zero", "leaf", F.when(F.col("zero"), F.col("weight")).alias("neighbours"), F.lit(False).alias("core"), F.lit(None).cast("long").alias("grp")
        )
        points = durable(known.drop("added", "added_first").unionByName(new))

        moved = gained.select("row_id", F.col("added").alias("weight")).join(vectors, "row_id").unionByName(units)
        counted = self._compared(moved, nodes, points, vectors, _count_work(top)(self.eps), "row_id long, neighbours long")
        counted = counted.groupBy("row_id").agg(F.sum("neighbours").alias("more"))
        weighed = points.join(counted, "row_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)) + F.coalesce("more", F.lit(0))).drop("more")
        weighed = durable(weighed.withColumn("was_core", F.col("core")).withColumn("core", F.col("neighbours") >= self.min_samples))

        changed = weighed.filter(~F.col("zero") & ((F.col("row_id") > top) | (F.col("core") & ~F.col("was_core"))))
        sent = changed.select("row_id", F.col("core").cast("long").alias("weight")).join(vectors, "row_id")
        links = durable(self._compared(sent, nodes, weighed, vectors, _link_work(self.eps), "a long, b long, border boolean"))
        points = weighed.drop("was_core").withColumn("grp", F.when(F.col("core"), F.coalesce("grp", "row_id")))
        points = durable(self._united(points, links.filter(~F.col("border")).select("a", "b")))
        points, nodes = self._split(points, nodes, vectors)

        self._write(units.select("row_id", "vector"), "vectors", version)
        joined = lookup_join(keyed.select("log_id", "h1", "h2"), points.select("h1", "h2", "row_id"), ["h1", "h2"], ["log_id"])
        self._write(joined.select("log_id", "row_id"), "members", version)
        self._write(links.filter("border").select("a", "b").distinct(), "borders", version)
        self._write(nodes, "nodes", version)
        self._write(points, "points", version)
        return self.labels(spark, version)

    def _compared(self, sent: DataFrame, nodes: DataFrame, points: DataFrame, vectors: DataFrame, work, schema: str) -> DataFrame:
        """`work` for the rows of `sent` in each leaf they come near, with the points that are at home there."""
        visitors = durable(visited_leaves(sent.select("row_id", "weight", "vector"), nodes, math.sqrt(2.0 * self.eps)))
        near = points.filter(~F.col("zero")).withColumn("node", F.col("leaf")).join(visitors.select("node").distinct(), "node", "left_semi")
        return meet(visitors, near.select("node", "row_id", "weight", "core").join(vectors, "row_id"), work, schema, TILE_ROWS, TILE_ROWS)

    def _united(self, points: DataFrame, edges: DataFrame) -> DataFrame:
        """Points with the groups that `edges` join made one, named by its smallest member."""
        group = points.filter("core").select("row_id", "grp")
        between = edges.join(group.select(F.col("row_id").alias("a"), F.col("grp").alias("x")), "a").join(group.select(F.col("row_id").alias("b"), F.col("grp").alias("y")), "b")
        roots = connected_components(between.select(F.col("x").alias("a"), F.col("y").alias("b")))
        return lookup_join(points, roots.select(F.col("row_id").alias("grp"), "root"), ["grp"], ["row_id"], "left").withColumn("grp", F.coalesce("root", "grp")).select(*points.columns)

    def _split(self, points: DataFrame, nodes: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Leaves of more than twice the rows a leaf should have are split, as the tree's nodes are, where that pays."""
        full = durable(points.filter(F.col("leaf").isNotNull()).groupBy("leaf").count().filter(F.col("count") > 2 * self.leaf_rows).select("leaf"))
        if full.isEmpty():
            return points, nodes
        crowded = points.join(full, "leaf", "left_semi").select("row_id", "weight", "leaf").join(vectors, "row_id")
        waiting = at_root(crowded.select("row_id", "weight", "vector", "leaf")).drop("node").join(crowded.select("row_id", F.col("leaf").alias("node")), "row_id")
        leaves, made = split_nodes(durable(waiting.select("row_id", "weight", "vector", "node", "home", "grp")), 0.0, self.leaf_rows, met_within=math.sqrt(2.0 * self.eps))
        moved = leaves.filter("home").select("row_id", F.col("node").alias("new_leaf"))
        nodes = nodes.join(made.select(F.col("node").alias("child"), F.lit(True).alias("now_open")).distinct(), "child", "left").withColumn("open", F.coalesce("now_open", "open")).select(*nodes.columns)
        points_now = points.join(moved, "row_id", "left").withColumn("leaf", F.coalesce("new_leaf", "leaf")).select(*points.columns)
        return durable(points_now), durable(nodes.unionByName(made))

    def labels(self, spark: SparkSession, version: int) -> DataFrame:
        """`(log_id, cluster_id)` as of a version."""
        points, members, borders = self._before(spark, "points", version, version), self._before(spark, "members", version + 1), self._before(spark, "borders", version + 1)
        cores = points.filter("core")
        first = cores.groupBy("grp").agg(F.min("first").alias("first"))
        numbered = number_rows(first, [F.col("first.missing"), F.col("first.ts"), F.col("first.log_id")], "n").select("grp", (F.col("n") - 1).alias("cluster_id"))
        core_labels = durable(lookup_join(cores.select("row_id", "grp"), numbered, ["grp"], ["row_id"]).select("row_id", "cluster_id"))
        near = borders.join(cores.select(F.col("row_id").alias("a")), "a", "left_anti").join(core_labels.withColumnRenamed("row_id", "b"), "b")
        labelled = core_labels.unionByName(near.groupBy(F.col("a").alias("row_id")).agg(F.min("cluster_id").alias("cluster_id")).select("row_id", "cluster_id"))
        return lookup_join(members, labelled, ["row_id"], ["log_id"], "left").select("log_id", F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"))
