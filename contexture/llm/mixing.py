"""Mixing sources to target weights over a domain, language and source tree.

A budget of tokens goes down the tree. At every node it is shared among the
children by their weights; a child cannot take more than its subtree supplies
(its tokens times the epochs allowed), and what it leaves goes to its siblings
by their weights. Only what all siblings together cannot take stays with their
parent's own bound, and so reaches the parent's siblings. All sums are of whole
tokens, and shares are rounded so that they add up.

A leaf with budget b and t tokens gives all its documents ``b div t`` times and
of the next epoch the longest prefix that fits, in that epoch's order: by the
md5 of seed, epoch, doc_id and token count. The prefix is found from sums of 4096
buckets of that order, so only the bucket it ends in is sorted, and a source
with a third of all rows is spread like any other.

Weights are whole numbers, fractions or decimals; those of a level are brought to
whole numbers of the same ratios, and products are exact to 38 digits. A weight of
0 leaves out all rows below it; their tokens still count in what ``share`` is of.
A negative weight is refused.

Defined results: a null domain, language, source or text counts as empty; a name
without a weight has weight 1; a text without words has no tokens and is taken
with the prefix it falls in; a leaf without tokens gives each document once; rows
with the same doc_id and length are told apart by a hash of their text; a
repeated row is a document of its own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contexture.llm.tables import written

WORDS = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3
BUCKETS = 16**BUCKET_DIGITS
LEVELS = ("domain", "language", "origin")
EXACT = "decimal(38, 0)"
Weight = int | float | Decimal | Fraction


def token_count(text: str = "text") -> Column:
    """Blank-separated words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_family(source: str = "source") -> Column:
    """A domain for tables that have none: one of three families of sources."""
    digit = F.substring(F.md5(F.coalesce(F.col(source), F.lit(""))), 1, 1)
    return F.when(digit < "6", "a").when(digit < "b", "b").otherwise("c")


def with_leaves(docs: DataFrame, domain: Column, tokens: Column) -> DataFrame:
    """What mixing goes by, as ``doc_id, _domain, _language, _origin, _tokens, _print``.

    The row itself is kept as the one column ``_row``, so its names cannot clash.
    """
    return docs.select(
        F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("_row"),
        "doc_id",
        F.coalesce(domain, F.lit("")).alias("_domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("_language"),
        F.coalesce(F.col("source"), F.lit("")).alias("_origin"),
        tokens.alias("_tokens"),
        F.xxhash64("text").alias("_print"),
    )


def whole_weights(weights: dict[str, Weight]) -> tuple[dict[str, int], int]:
    """Weights as whole numbers of the same ratios, and that of a name without one."""
    exact = {name: Fraction(str(weight)) for name, weight in weights.items()}
    if any(weight < 0 for weight in exact.values()):
        raise ValueError(f"a weight is negative: {weights}")
    scale = math.lcm(*(weight.denominator for weight in exact.values()))
    return {name: int(weight * scale) for name, weight in exact.items()}, scale


def _weight(name: str, weights: dict[str, Weight]) -> Column:
    whole, other = whole_weights(weights)
    out = F.lit(str(other))
    for value, weight in whole.items():
        out = F.when(F.col(name) == value, F.lit(str(weight))).otherwise(out)
    return out.cast(EXACT)


def _shared(nodes: DataFrame, parents: DataFrame, by: list[str], name: str, weights: dict) -> DataFrame:
    """The budget of every child: ``by, name, parent_budget``."""
    children = nodes.groupBy(*by, name).agg(F.sum("supply").cast(EXACT).alias("supply"))
    children = children.withColumn("weight", _weight(name, weights))
    children = children.join(parents, by)
    # Those that run out first, in proportion to their weight, come first.
    order = [F.col("supply").cast("double") / F.col("weight").cast("double"), F.col(name)]
    own = Window.partitionBy(*by).orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    after = own.rowsBetween(0, Window.unboundedFollowing)
    taken = F.coalesce(F.sum("supply").over(before).cast(EXACT), F.lit(0).cast(EXACT))
    children = children.withColumn("left", (F.col("parent_budget") - taken).cast(EXACT))
    children = children.withColumn("weights", F.sum("weight").over(after).cast(EXACT))
    short = F.col("supply") * F.col("weights") <= F.col("weight") * F.col("left")
    children = children.withColumn("short", short)
    rest = Window.partitionBy(*by, "short")
    upto = rest.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    children = children.withColumn("upto", F.sum("weight").over(upto).cast(EXACT))
    children = children.withColumn("most", F.max("left").over(rest))
    children = children.withColumn("whole", F.sum("weight").over(rest).cast(EXACT))
    part = F.expr("most * upto div whole - most * (upto - weight) div whole")
    budget = F.when(F.col("short"), F.col("supply").cast("bigint")).otherwise(part)
    return children.select(*by, name, budget.alias("parent_budget"))


def budgets(
    counted: DataFrame, weights: dict[str, dict[str, Weight]], share: float, epochs: int
) -> DataFrame:
    """Per leaf: tokens, budget, whole epochs and what remains for the next one.

    ``counted`` has the columns of ``with_leaves``. The budget is ``share`` of
    all tokens. The tree is one row a leaf and stays a DataFrame.
    """
    keys = [f"_{level}" for level in LEVELS]
    leaves = written(counted.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")), "leaves")
    nodes = leaves.withColumn("supply", F.col("tokens") * epochs).withColumn("_root", F.lit(0))
    wanted = F.lit(True)
    for level, key in zip(LEVELS, keys, strict=True):
        wanted &= _weight(key, weights.get(level, {})) > 0
    open_ = F.coalesce(F.sum(F.when(wanted, F.col("supply"))), F.lit(0))
    share_of_all = F.floor(F.sum("tokens") * F.lit(share)).cast("bigint")
    top = nodes.groupBy("_root").agg(F.least(share_of_all, open_).alias("parent_budget"))
    nodes = nodes.where(wanted)
    for depth, key in enumerate(keys):
        above = ["_root", *keys[:depth]]
        top = _shared(nodes, top, above, key, weights.get(LEVELS[depth], {}))
    top = top.drop("_root")
    leaves = leaves.join(top.withColumnRenamed("parent_budget", "budget"), keys)
    leaves = leaves.withColumn("full", F.expr("coalesce(budget div nullif(tokens, 0), 0L)"))
    return leaves.withColumn("rest", F.expr("budget - full * tokens"))


def _key(seed: str) -> Column:
    epoch = (F.col("full") + 1).cast("string")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, doc, F.col("_tokens").cast("string")))


def mixed(
    docs: DataFrame,
    counted: DataFrame,
    weights: dict[str, dict[str, Weight]],
    share: float = 1.0,
    epochs: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` chosen to the weights, with ``epoch`` (from 1) added; a row for each time.

    Both have the columns of ``with_leaves``; ``counted`` needs no others and is
    read twice, so it had better be a narrow written table.
    """
    keys = [f"_{level}" for level in LEVELS]
    leaves = written(budgets(counted, weights, share, epochs), "budgets")
    bucket = F.conv(F.substring(F.col("_key"), 1, BUCKET_DIGITS), 16, 10).cast("int")
    sums = counted.join(leaves, keys).withColumn("_key", _key(seed))
    sums = sums.groupBy(*keys, "rest", bucket.alias("_bucket")).agg(F.sum("_tokens").alias("n"))
    running = Window.partitionBy(*keys).orderBy("_bucket")
    sums = sums.withColumn("upto", F.sum("n").over(running))
    ends = sums.where("upto > rest").groupBy(*keys).agg(
        F.min(F.struct("_bucket", (F.col("upto") - F.col("n")).alias("base"))).alias("end")
    )
    ends = ends.select(*keys, F.col("end._bucket").alias("_end"), F.col("end.base").alias("base"))
    plan = leaves.join(ends, keys, "left").select(
        *keys, "full", "rest", F.coalesce("_end", F.lit(BUCKETS)).alias("_end"), "base"
    )
    plan = written(plan, "mixing-plan")
    rows = docs.join(plan, keys).withColumn("_key", _key(seed)).withColumn("_bucket", bucket)
    open_ = F.col("full") < epochs
    times = F.col("full").cast("int") + (open_ & (F.col("_bucket") < F.col("_end"))).cast("int")
    whole = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), times))).where("epoch > 0")
    inside = Window.partitionBy(*keys).orderBy("_key", "_print").rowsBetween(
        Window.unboundedPreceding, 0
    )
    edge = rows.where(open_ & (F.col("_bucket") == F.col("_end")))
    edge = edge.withColumn("upto", F.sum("_tokens").over(inside) + F.col("base"))
    edge = edge.where("upto <= rest").withColumn("epoch", F.col("full").cast("int") + 1)
    kept = [*docs.columns, "epoch"]
    return whole.select(kept).unionByName(edge.select(kept))


def mix_documents(
    docs: DataFrame, weights: dict[str, dict[str, Weight]], share: float, epochs: int, seed: str
) -> DataFrame:
    """``docs`` mixed by token counts of their texts, with their own columns only."""
    own = with_leaves(docs, source_family(), token_count())
    counted = written(own.drop("_row"), "counted")
    return mixed(own, counted, weights, share, epochs, seed).select("_row.*")
