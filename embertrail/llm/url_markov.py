"""Operator 4: URL rules, and a character language-model ratio for the rest, in DataFrame operations only.

Rules name a host and a path; the longest one that fits decides. The URLs that rules accept and reject train two smoothed
variable-order Markov models over characters: the share of a character after a context of ORDER characters is mixed with
its share after shorter contexts, each context weighing as much as it has been seen (Witten-Bell). A URL's score is the
mean over its characters of log(share among accepted) - log(share among rejected), and the threshold lies midway between
the mean scores of the two training classes.

Characters map to a fixed alphabet (lower-cased letters and digits, URL punctuation, one for all others), so contexts and
characters are at most 44**3 cells, whose ratios fit a broadcast of a known size.

Defined cases: a null or empty url, or one without `://`, has an empty host and path, no rule fits it, and a url without
characters scores 0. Without training URLs of a class its model is uniform, and without either the threshold is 0: every
url that no rule fits is then allowed. Other columns of `pages` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embertrail.session import durable

# Fixed: the characters that are told apart. Position 0 is any other character, and one more stands before the first.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./:-_?=&"
OTHER, START = 0, len(ALPHABET) + 1
SYMBOLS = len(ALPHABET) + 2
# Characters of context at most.
ORDER = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path up to `?` or `#`; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of `rules` (verdict, host and path written together) that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # longer rules are asked first
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _cells(rows: DataFrame, *carry: str) -> DataFrame:
    """One row per character of `url`: its code `c` and the codes `c1`, `c2` of the two before it."""
    code = F.instr(F.lit(ALPHABET), F.col("ch")).cast("int")
    split = rows.select(*carry, F.posexplode(F.split(F.lower(F.coalesce("url", F.lit(""))), "")).alias("at", "ch"), "url")
    text = F.lower("url")
    before = lambda step: F.when(F.col("at") < step, F.lit(START)).otherwise(
        F.instr(F.lit(ALPHABET), F.substr(text, F.col("at") - step + 1, F.lit(1))).cast("int")
    )
    return split.filter(F.col("ch") != "").select(*carry, code.alias("c"), before(1).alias("c1"), before(2).alias("c2"))


def markov_ratios(known: DataFrame) -> DataFrame:
    """(cell, ratio) for every cell of the alphabet from `known(url, accepted)`; cell = (c2 * SYMBOLS + c1) * SYMBOLS + c."""
    seen = durable(
        _cells(known, "accepted").groupBy("c2", "c1", "c").agg(
            F.sum(F.col("accepted").cast("bigint")).alias("n_true"), F.sum((~F.col("accepted")).cast("bigint")).alias("n_false")
        )
    )
    grid = known.sparkSession.range(SYMBOLS**3).select(
        F.col("id").alias("cell"), F.floor(F.col("id") / SYMBOLS**2).cast("int").alias("c2"),
        (F.floor(F.col("id") / SYMBOLS) % SYMBOLS).cast("int").alias("c1"), (F.col("id") % SYMBOLS).cast("int").alias("c"),
    )
    for side in ("true", "false"):
        share = F.lit(1.0 / SYMBOLS)
        for length in range(ORDER + 1):
            context = ["c1", "c2"][:length]
            n = F.sum(f"n_{side}")
            counts = seen.groupBy(*context, "c").agg(n.alias("_n")).filter(F.col("_n") > 0)
            totals = counts.groupBy(*context).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_kinds"))
            grid = grid.join(F.broadcast(counts), [*context, "c"], "left")
            grid = grid.join(F.broadcast(totals), context, "left") if context else grid.crossJoin(F.broadcast(totals))
            mixed = (F.coalesce("_n", F.lit(0)) + F.coalesce("_kinds", F.lit(0)) * share) / (F.col("_all") + F.col("_kinds"))
            grid = grid.withColumn("_share", F.when(F.coalesce("_all", F.lit(0)) > 0, mixed).otherwise(share)).drop("_n", "_all", "_kinds")
            grid = grid.drop(f"share_{side}").withColumnRenamed("_share", f"share_{side}")
            share = F.col(f"share_{side}")
    return grid.select("cell", (F.log("share_true") - F.log("share_false")).alias("ratio"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id") -> DataFrame:
    """`key`, host, path, rule, verdict and score for every row of `pages`."""
    host, path = host_and_path(F.col("url"))
    parted = pages.select(key, "url", host.alias("host"), path.alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = durable(parted.withColumn("rule", rule).withColumn("said", said).withColumn("row_no", F.monotonically_increasing_id()))
    known = rows.filter(F.col("said").isNotNull()).select("url", (F.col("said") == "allow").alias("accepted"))
    ratios = durable(markov_ratios(known))
    cell = (F.col("c2") * SYMBOLS + F.col("c1")) * SYMBOLS + F.col("c")
    # A cell for each of SYMBOLS**3, hence broadcast. A url's characters lie in one task, so partial sums leave one row each.
    characters = _cells(rows, "row_no").select("row_no", cell.cast("bigint").alias("cell"))
    scores = characters.join(F.broadcast(ratios), "cell").groupBy("row_no").agg(F.avg("ratio").alias("score"))
    scored = durable(rows.join(scores, "row_no", "left").withColumn("score", F.coalesce("score", F.lit(0.0))))
    means = scored.filter(F.col("said").isNotNull()).groupBy("said").agg(F.avg("score").alias("mean"))
    middle = means.agg(F.when(F.count(F.lit(1)) == 2, F.avg("mean")).otherwise(F.lit(0.0)).alias("threshold"))
    judged = F.when(F.col("score") >= F.col("threshold"), F.lit("allow")).otherwise(F.lit("block"))
    return scored.crossJoin(F.broadcast(middle)).select(key, "host", "path", "rule", F.coalesce("said", judged).alias("verdict"), "score")
