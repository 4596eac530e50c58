"""Best match of each cluster among the clusters of another run."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from embertrail.functions.vectors import CENTROID_WEIGHT, KEY_WEIGHT, SERVICE_WEIGHT
from embertrail.operators.scale import top_rows
from embertrail.operators.tiles import TILE_ROWS, Zoning, per_tile, tile_rows_between
from embertrail.session import durable


def _lengths(vectors) -> np.ndarray:
    return np.array([len(v) for v in vectors])


def _similar(first: pd.DataFrame, second: pd.DataFrame) -> np.ndarray:
    """Similarity of every row of one block to every row of the other, by matrix products."""
    cosine = np.zeros((len(first), len(second)))
    widths_a, widths_b = _lengths(first["centroid"]), _lengths(second["centroid"])
    for width in np.intersect1d(widths_a, widths_b):
        if width == 0:
            continue
        rows, columns = np.flatnonzero(widths_a == width), np.flatnonzero(widths_b == width)
        left = np.stack(first["centroid"].to_numpy()[rows]).astype(float)
        right = np.stack(second["centroid"].to_numpy()[columns]).astype(float)
        scale = np.sqrt((left * left).sum(axis=1))[:, None] * np.sqrt((right * right).sum(axis=1))[None, :]
        cosine[np.ix_(rows, columns)] = np.divide(left @ right.T, scale, out=np.zeros_like(scale), where=scale > 0)
    names = {name: i for i, name in enumerate(sorted({n for block in (first, second) for row in block["services"] for n in row}))}
    flags = []
    for block in (first, second):
        table = np.zeros((len(block), len(names)))
        for i, row in enumerate(block["services"]):
            table[i, [names[n] for n in row]] = 1.0
        flags.append(table)
    shared = flags[0] @ flags[1].T
    either = flags[0].sum(axis=1)[:, None] + flags[1].sum(axis=1)[None, :] - shared
    overlap = np.divide(shared, either, out=np.ones_like(shared), where=either > 0)
    same_key = first["cluster_key"].to_numpy()[:, None] == second["cluster_key"].to_numpy()[None, :]
    return CENTROID_WEIGHT * cosine + SERVICE_WEIGHT * overlap + KEY_WEIGHT * same_key


def _best_work(threshold: float):
    """Per tile: for each row of the first block its best row of the second, in listing order on equal scores."""

    def work(first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
        second = second.sort_values(["log_count", "cluster_id"], ascending=[False, True])
        score = _similar(first, second)
        best = score.argmax(axis=1)
        top = score[np.arange(len(first)), best]
        kept = top >= threshold
        chosen = second.iloc[best[kept]]
        return pd.DataFrame({
            "cluster_id": first["cluster_id"].to_numpy()[kept], "score": top[kept],
            "matched_id": chosen["cluster_id"].to_numpy(), "matched_size": chosen["log_count"].to_numpy(),
        })

    return work


def _no_match(latest: DataFrame) -> DataFrame:
    kind = latest.schema["cluster_id"].dataType.simpleString()
    return latest.sparkSession.createDataFrame([], f"cluster_id {kind}, matched_id bigint, matched_size bigint, score double")


def best_matches(
    latest: DataFrame, previous: DataFrame, threshold: float = 0.92, keys_may_match: bool = False, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """`(cluster_id, matched_id, matched_size, score)` for the rows of `latest` whose best match reaches the threshold.

    Without equal keys a score is at most 0.85 (centroid and service weights), so a higher threshold matches nothing:
    the answer is then empty and nothing is read. Otherwise a match needs a centroid cosine of at least
    (threshold - 0.25 [- 0.15]) / 0.6; the vectors are zoned for that radius, and each tile hands on one candidate per
    row. Only when that bound is not positive must every block meet every other.
    """
    slack = 1e-9
    ceiling = CENTROID_WEIGHT + SERVICE_WEIGHT + (KEY_WEIGHT if keys_may_match else 0.0)
    if threshold > ceiling + slack:
        return _no_match(latest)
    columns = ["cluster_id", "cluster_key", "log_count", "services", "centroid"]
    clean = [
        df.select(*columns).withColumn("services", F.filter("services", lambda s: s.isNotNull() & (s != "")))
        for df in (latest, previous)
    ]
    need = (threshold - SERVICE_WEIGHT - (KEY_WEIGHT if keys_may_match else 0.0)) / CENTROID_WEIGHT - slack
    left, right = [
        durable(df.withColumn("row_id", F.xxhash64("cluster_id")).withColumn("weight", F.lit(1)).withColumn("zone", F.lit(0)).withColumn("reach", F.array(F.lit(0))))
        for df in clean
    ]
    if need > 0:
        pairs_of = _zoned(left, right, need, tile_rows)
    else:
        sizes = [df.groupBy("zone").agg(F.count(F.lit(1)).alias("n")).toPandas() for df in (left, right)]
        blocks = [{int(z): max(1, math.ceil(n / tile_rows)) for z, n in zip(s["zone"], s["n"])} for s in sizes]
        pairs = pd.DataFrame([(0, 0)], columns=["zone_a", "zone_b"]) if all(len(s) for s in sizes) else None
        pairs_of = None if pairs is None else (left, right, pairs, *blocks)
    if pairs_of is None:
        return _no_match(latest)
    rows = tile_rows_between(*pairs_of)
    found = per_tile(rows, _best_work(threshold), "cluster_id long, score double, matched_id long, matched_size long", one_table=False)
    best = top_rows(found, ["cluster_id"], [F.desc("score"), F.desc("matched_size"), F.asc("matched_id")], 1)
    return best.select("cluster_id", "matched_id", "matched_size", "score")


def _zoned(left: DataFrame, right: DataFrame, need: float, tile_rows: int):
    """Zones per vector width (a positive cosine needs equal widths and no zero vector)."""
    usable = [df.drop("reach").filter(F.exists("centroid", lambda x: x != 0)) for df in (left, right)]
    widths = [{r[0] for r in df.select(F.size("centroid")).distinct().collect()} for df in usable]
    radius = math.sqrt(max(0.0, 2.0 * (1.0 - need)))
    shift = 0
    sides: list[list[DataFrame]] = [[], []]
    tables, blocks_a, blocks_b = [], {}, {}
    for width in sorted(widths[0] & widths[1]):
        vectors = [df.filter(F.size("centroid") == width).withColumn("vector", F.col("centroid")) for df in usable]
        zoning = Zoning.fit(vectors[1], radius, tile_rows)
        placed = [durable(zoning.assign(df)) for df in vectors]
        stats = [zoning.statistics(df) for df in placed]
        close = zoning.close_zones(*stats) + shift
        tables.append(close)
        for target, stat in ((blocks_a, stats[0]), (blocks_b, stats[1])):
            target.update({z + shift: n for z, n in zoning.blocks(stat).items()})
        for side, df, others in zip(sides, placed, reversed(stats)):
            moved = F.transform("reach", lambda z: z + F.lit(shift))
            side.append(zoning.reach(df, others).drop("vector").withColumn("zone", F.col("zone") + F.lit(shift)).withColumn("reach", moved))
        shift += len(zoning.pivots) * zoning.rings
    if not tables:
        return None
    joined = []
    for side in sides:
        whole = side[0]
        for part in side[1:]:
            whole = whole.unionByName(part)
        joined.append(whole)
    return joined[0], joined[1], pd.concat(tables, ignore_index=True), blocks_a, blocks_b
