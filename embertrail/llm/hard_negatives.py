"""Operator 11: hard-negative mining by slot-decomposed selection.

Vectors become whole numbers, floor(256 x), and a score is an inner product. An anchor's positives are its best rows of the
same label. Each positive asks for the best rows of other labels whose score lies in a window below its own score. The
windows of one anchor overlap, so they are not searched one by one: the positives' upper limits, in falling order, cut the
scores into disjoint slots, and every row of another label lies in one slot at most. Each task keeps the best k of each slot,
tasks are combined per slot, and what a positive may see is its own slot and all below it. Those lie one after another once
the kept rows are sorted, so each positive reads its k from its slot's begin, and the lower limit cuts the end off.

Anchors meet all rows in blocks: a task holds one block of rows and one block of anchors and returns at most k rows per
anchor and slot. Positives are searched the same way within each label, whose blocks follow from its own size.

Defined cases: rows with a null label, id or vector, or a null or non-finite component take no part. Only vectors of equal
length are compared. Rows that share an anchor's id are no partners of it; an anchor that comes in several rows counts once,
with its smallest label and vector. Equal scores go by the smaller id; repeated rows are returned as often as they occur.
Anchors without a positive, and windows without a row, give no rows. Scores are exact below 2^53. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from embertrail.operators.scale import lookup_join, top_rows
from embertrail.session import durable

POSITIVES, NEGATIVES = 5, 10
# Fixed: a negative's score lies between these hundredths of its positive's score.
LOWEST, HIGHEST = 30, 90
# Rows and anchors of a block at most. On small tables blocks are smaller, so that every core has one.
BLOCK_ROWS, BLOCK_ANCHORS, LEAST_ROWS = 65_536, 4_096, 1_024
# Scores that a task computes at a time, and candidates it gathers before it cuts them to the best k.
SCORES, GATHERED = 1 << 20, 1 << 17


@dataclass
class Best:
    """The best `k` rows of each slot of each anchor, for rows that come in rising order of their ids.

    `upper` holds an anchor's upper limits in falling order, -inf behind the last; a score belongs to the last slot whose
    limit is not below it. Scores below `lower` belong to none.
    """

    upper: np.ndarray
    lower: np.ndarray
    k: int

    def __post_init__(self):
        slots = self.upper.shape[1]
        self.last = np.arange(len(self.upper)) * slots + np.maximum((self.upper > -np.inf).sum(1), 1) - 1
        self.limit = np.full(self.upper.size, -np.inf)  # of full slots: the k-th best score
        self.floor = self.lower.astype(float)
        self.kept = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        self.waiting, self.n_waiting = [], 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, marks: np.ndarray, anchor_marks: np.ndarray) -> None:
        """`scores` has a row for each id and a column for each anchor; equal marks are no partners."""
        row, anchor = np.nonzero((scores <= self.upper[None, :, 0]) & (scores >= self.floor[None, :]))
        other = marks[row] != anchor_marks[anchor]
        row, anchor = row[other], anchor[other]
        score = scores[row, anchor].astype(float)
        slot = (self.upper[anchor] >= score[:, None]).sum(1) - 1
        key = anchor * self.upper.shape[1] + slot
        better = score > self.limit[key]  # an equal score has a smaller id already
        self.waiting.append((key[better], score[better], ids[row[better]]))
        self.n_waiting += int(better.sum())
        if self.n_waiting > GATHERED + len(self.kept[0]):
            self.cut()

    def cut(self) -> None:
        key, score, ids = (np.concatenate(x) for x in zip(self.kept, *self.waiting))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        place = np.arange(len(key)) - np.repeat(begins, np.diff(np.r_[begins, len(key)]))
        held = place < self.k
        full = place == self.k - 1
        self.limit[key[full]] = score[full]
        self.floor = np.maximum(self.floor, self.limit[self.last])
        self.kept, self.waiting, self.n_waiting = (key[held], score[held], ids[held]), [], 0


def whole_numbers(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks] or [np.empty(0)])
    return np.floor(256 * flat.astype(float)).reshape(len(vectors), width)


def best_per_slot(rows: pa.Table, anchors: pa.Table, mark: str, k: int) -> pa.Table:
    """anchor_id, slot, score and vec_id of the best k rows of each anchor's slots. Ids are `vec_id` on both sides."""
    width = len(anchors["embedding"][0])
    rows = rows.sort_by("vec_id")
    left, right = whole_numbers(rows["embedding"], width), whole_numbers(anchors["embedding"], width)
    bound = np.sqrt((left * left).sum(1).max(initial=0) * (right * right).sum(1).max(initial=0))
    exact = np.float32 if bound < 1 << 23 else np.float64  # sums of whole numbers, exact in either
    left, right = left.astype(exact), right.astype(exact).T.copy()
    ids, marks, anchor_marks = rows["vec_id"].to_numpy(), rows[mark].to_numpy(), anchors[mark].to_numpy()
    upper = np.array([[math.inf if x is None else x for x in u] for u in anchors["upper"].to_pylist()], dtype=float)
    best = Best(upper, anchors["lower"].to_numpy(), k)
    step = max(1, SCORES // len(anchor_marks))
    for start in range(0, len(ids), step):
        part = slice(start, start + step)
        best.offer(left[part] @ right, ids[part], marks[part], anchor_marks)
    best.cut()
    key, score, found = best.kept
    owner, slot = np.divmod(key, upper.shape[1])
    columns = [anchors["vec_id"].to_numpy()[owner], slot.astype(np.int32), score.astype(np.int64), found]
    return pa.table([pa.array(c) for c in columns], names=["anchor_id", "slot", "score", "vec_id"])


def _searched(rows: DataFrame, anchors: DataFrame, keys: list[str], mark: str, k: int) -> DataFrame:
    """Per anchor and slot the best k of `rows` that share `keys` with it; both sides carry their blocks already."""
    schema = "anchor_id bigint, slot int, score bigint, vec_id bigint"

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=["anchor_id", "slot", "score", "vec_id"])
        return best_per_slot(left, right, mark, k)

    keys = [*keys, "row_block", "anchor_block"]
    found = rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(work, schema)
    return top_rows(found, ["anchor_id", "slot"], [F.desc("score"), F.asc("vec_id")], k, "place").drop("place")


def _blocked(rows: DataFrame, own: str, own_blocks: Column, other: str, other_blocks: Column) -> DataFrame:
    """Each row in one block of its own side and once for every block of the other side."""
    place = F.pmod(F.xxhash64("vec_id"), own_blocks).cast("int")
    return rows.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), other_blocks.cast("int") - 1)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and width of the rows that take part."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    return rows.filter(fine).filter(~broken).withColumn("width", F.size("embedding"))


def _blocks(n: Column | int, per_block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(n) / per_block)).cast("int") if isinstance(n, int) else F.greatest(F.lit(1), F.ceil(n / per_block)).cast("int")


def positives(rows: DataFrame, anchors: DataFrame, k: int, block_rows: int, block_anchors: int) -> DataFrame:
    """anchor_id, score and vec_id of the best k other rows of each anchor's label."""
    keys = ["label", "width"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    asked = anchors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_anchors"))
    parts = durable(sizes.join(asked, keys).select(*keys, _blocks(F.col("n"), block_rows).alias("row_parts"), _blocks(F.col("n_anchors"), block_anchors).alias("anchor_parts")))
    left = _blocked(lookup_join(rows, parts, keys, ["vec_id"]), "row_block", F.col("row_parts"), "anchor_block", F.col("anchor_parts"))
    open_ended = anchors.withColumn("upper", F.array(F.lit(None).cast("double"))).withColumn("lower", F.lit(float("-inf")))
    right = _blocked(lookup_join(open_ended, parts, keys, ["vec_id"]), "anchor_block", F.col("anchor_parts"), "row_block", F.col("row_parts"))
    drop = ["row_parts", "anchor_parts"]
    return _searched(left.drop(*drop), right.drop(*drop), keys, "vec_id", k).drop("slot")


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
    block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; `anchor` marks the rows to mine for.

    A negative's score s satisfies lowest * p <= 100 * s <= highest * p for its positive's score p.
    """
    rows = durable(usable(vectors))
    spark = rows.sparkSession
    first = F.min(F.struct("label", "embedding"))
    anchors = rows.filter(anchor).groupBy("vec_id").agg(first.alias("first")).select("vec_id", "first.label", "first.embedding")
    anchors = durable(anchors.withColumn("width", F.size("embedding")))
    n, n_anchors = rows.count(), anchors.count()
    block_rows = min(block_rows, max(LEAST_ROWS, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    chosen = durable(positives(rows, anchors, n_positives, block_rows, block_anchors))
    # Falling scores, ties by id: the order of the slots.
    listed = chosen.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id").alias("positive_id")))).alias("held"))
    score = lambda x: -x["minus"]
    limited = listed.select(
        "anchor_id", "held",
        F.transform(F.sequence(F.lit(0), F.lit(n_positives - 1)), lambda i: F.coalesce(F.floor(highest * score(F.get("held", i)) / 100).cast("double"), F.lit(float("-inf")))).alias("upper"),
        F.array_min(F.transform(F.filter("held", lambda x: score(x) >= 0), lambda x: F.ceil(lowest * score(x) / 100).cast("double"))).alias("lower"),
    ).filter(F.col("lower").isNotNull())  # below zero no window holds a score
    limited = durable(limited)
    asking = anchors.join(limited.select(F.col("anchor_id").alias("vec_id"), "upper", "lower"), "vec_id")
    row_parts, anchor_parts = _blocks(n, block_rows), _blocks(n_anchors, block_anchors)
    left = _blocked(rows, "row_block", row_parts, "anchor_block", anchor_parts)
    right = _blocked(asking, "anchor_block", anchor_parts, "row_block", row_parts)
    found = _searched(left, right, ["width"], "label", n_negatives)
    # At most k rows a slot: sorted by slot, the slots from a positive's own on follow one another in falling order of score.
    slots = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), F.col("vec_id").alias("negative_id")))).alias("slots"))
    asked = limited.select("anchor_id", F.posexplode("held").alias("place", "positive")).join(slots, "anchor_id")
    from_slot = F.slice(F.filter("slots", lambda x: x["slot"] >= F.col("place")), 1, n_negatives)
    inside = F.filter(from_slot, lambda x: 100 * score(x) >= lowest * score(F.col("positive")))
    answered = asked.select("anchor_id", "positive", F.posexplode(inside).alias("rank", "negative"))
    return answered.select(
        "anchor_id", F.col("positive.positive_id").alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("negative.negative_id").alias("negative_id"),
        score(F.col("positive")).alias("positive_score"), score(F.col("negative")).alias("negative_score"),
    )
