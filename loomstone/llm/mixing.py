"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's weight is its share of the corpus' tokens raised to an exponent, normalised: 1 keeps the shares, 0 makes
them equal. The exponent is bisected to reach a target entropy of the weights, or to keep every source within a number
of repetitions. Each source gets its weight's part of the token budget. Its documents are dealt into blocks by hash; in
each epoch the blocks are put in another order (by a hash of seed, epoch and block) and taken until the budget is met,
so a source that is read 2.3 times gives every document twice and a random 30 % of its blocks once more. A block's
place, the tokens before it over the source's budget, orders the whole mix: any stretch of it has the target weights.

Token counts are summed by source before the shuffle; the driver sees a row per source. The running sums over a
source's blocks are taken in two steps, over ranges of the block order and within them, so a source with a third of all
tokens isn't sorted in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from .scratch import Scratch

#: Of the production query: entropy of the weights over that of equal ones, and most repetitions of a source.
ENTROPY, REPETITIONS = 0.95, 4.0
#: Tokens of a block, and blocks that a source has at least (so that budgets are met within half a percent).
BLOCK_TOKENS, LEAST_BLOCKS = 1 << 20, 200
#: Ranges of the block order.
RANGES = 256
SEED = 20240229
#: The mix is solved on the driver; more sources than this are an error.
MOST_SOURCES = 100_000


@dataclass
class Mix:
    """exponent, weights by source, and the token budget of each source."""

    exponent: float
    weights: dict[str, float]
    budgets: dict[str, float]


def weights_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised weights: shares raised to the exponent (in logarithms, so that tiny shares don't vanish)."""
    logs = {s: exponent * math.log(n) for s, n in tokens.items()}
    top = max(logs.values(), default=0.0)
    raised = {s: math.exp(x - top) for s, x in logs.items()}
    total = math.fsum(raised.values())
    return {s: x / total for s, x in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    """Entropy in nats."""
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def _bisect(holds, low: float, high: float) -> float:  # noqa: ANN001
    """The boundary of a condition that holds at low and not at high (from the side where it holds)."""
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def solve(tokens: dict[str, int], budget: float | None, target: float | None = ENTROPY, repetitions: float | None = REPETITIONS) -> Mix:
    """The mix of sources with the given (positive) token counts.

    budget: tokens of the mix; None for as many as give every source one whole epoch at least. target: entropy of the
    weights over the entropy of equal weights; the exponent nearest to 1 that reaches it is taken. repetitions: the most
    epochs of any source; where it and the target conflict, it prevails. With no target, the exponent is the least (the
    most even weights) within the repetitions. A budget of more than all tokens times the repetitions is an error.
    """
    if not tokens:
        return Mix(1.0, {}, {})

    def budgets(exponent: float) -> dict[str, float]:
        w = weights_at(tokens, exponent)
        whole = budget if budget is not None else max(n / w[s] for s, n in tokens.items())
        return {s: x * whole for s, x in w.items()}

    def bearable(exponent: float) -> bool:
        return repetitions is None or max(b / tokens[s] for s, b in budgets(exponent).items()) <= repetitions * (1 + 1e-12)

    if not bearable(1.0):
        raise ValueError("the budget is more than all tokens times the repetitions")
    exponent = 0.0
    if target is not None:
        least = target * math.log(len(tokens))
        reached = lambda x: entropy(weights_at(tokens, x)) >= least - 1e-12
        exponent = 1.0 if reached(1.0) else _bisect(reached, 0.0, 1.0)
    if not bearable(exponent):
        exponent = 1 - _bisect(lambda x: bearable(1 - x), 0.0, 1 - exponent)
    return Mix(exponent, weights_at(tokens, exponent), budgets(exponent))


def count_tokens(text: Column) -> Column:
    """Words of a text, 1 at least, so that every document takes its place."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))).cast("long")


def schedule(blocks: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The blocks of each epoch within the budgets: source, block, epoch, start (tokens of the source before it), at.

    blocks: source, block, tokens. plan: source, tokens (of all its blocks), budget. A block is taken if it starts before
    the budget's end, so a budget is overrun by less than a block.
    """
    epochs = blocks.join(plan.withColumnRenamed("tokens", "all"), "source").withColumn("epoch", F.explode(F.expr("sequence(0, cast(greatest(ceil(budget / all), 1) as int) - 1)")))
    order = F.xxhash64("source", "block", "epoch", F.lit(seed))
    placed = epochs.withColumn("order", order).withColumn("range", F.shiftrightunsigned(F.col("order").bitwiseXOR(F.lit(-(1 << 63))), 64 - int(math.log2(RANGES))))
    group = ["source", "epoch"]
    sums = placed.groupBy(*group, "range").agg(F.sum("tokens").alias("in_range"))
    before = sums.withColumn("before", F.coalesce(F.sum("in_range").over(W.partitionBy(*group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("in_range")
    within = F.coalesce(F.sum("tokens").over(W.partitionBy(*group, "range").orderBy("order", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    started = placed.withColumn("within", within).join(before, [*group, "range"]).withColumn("start", F.col("epoch") * F.col("all") + F.col("before") + F.col("within"))
    return started.filter(F.col("start") < F.col("budget")).select("source", "block", "epoch", "start", (F.col("start") / F.col("budget")).alias("at"))


#: Columns that the mix adds.
ADDED = ("mix_tokens", "mix_epoch", "mix_block", "mix_at")


def mixed(docs: DataFrame, carried: list[str], *, whole: bool = False, target: float | None = ENTROPY, repetitions: float | None = REPETITIONS, key: str = "doc_id", text: str = "text", source: str = "source", added: bool = True) -> DataFrame:
    """The mix: a row per document and epoch with the carried columns and, if added, mix_tokens, mix_epoch, mix_block and mix_at.

    whole: the budget is such that every document is in the mix; otherwise it is the corpus' number of tokens. Null
    sources count as the source with an empty name; rows that repeat an id share a block; an empty table gives no rows.
    Carried columns may have any names; those of the added ones are replaced by them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    quoted = lambda c: F.col(f"`{c}`")
    name = F.coalesce(quoted(source), F.lit(""))
    hashed = F.xxhash64(F.coalesce(quoted(key).cast("string"), F.xxhash64(quoted(text)).cast("string")))
    counted = scratch.keep(docs.select(name.alias("source"), hashed.alias("hash"), count_tokens(quoted(text)).alias("tokens")), "counted")
    totals = counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"there are more than {MOST_SOURCES} sources")
    tokens = {r.source: r.tokens for r in totals}
    mix = solve(tokens, None if whole else float(sum(tokens.values())), target, repetitions)
    plan = spark.createDataFrame([(s, n, mix.budgets[s], max(LEAST_BLOCKS, round(n / BLOCK_TOKENS))) for s, n in sorted(tokens.items())], "source string, tokens long, budget double, n_blocks long")
    sized = F.broadcast(plan.select("source", "n_blocks"))  # a row per source, MOST_SOURCES at most
    block = lambda df: df.join(sized, "source").withColumn("block", F.pmod("hash", F.col("n_blocks"))).drop("n_blocks", "hash")
    blocks = block(counted).groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
    taken = scratch.keep(schedule(blocks, plan.drop("n_blocks")), "schedule").select("source", "block", "epoch", "at")
    scratch.drop(counted)
    # the carried columns in a struct of their own, so that no name of theirs meets one of the mix
    row = F.struct(*(quoted(c) for c in dict.fromkeys(carried)))
    found = block(docs.select(row.alias("row"), name.alias("source"), hashed.alias("hash"), count_tokens(quoted(text)).alias("tokens"))).join(taken, ["source", "block"])
    own = [F.col(c).alias(a) for c, a in zip(("tokens", "epoch", "block", "at"), ADDED, strict=True)] if added else []
    return found.select(*(F.col(f"row.`{c}`") for c in dict.fromkeys(carried) if not (added and c.lower() in ADDED)), *own)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``' sources: doc_id, source, n_tokens, epoch, block, at."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs, ["doc_id", "source"]).withColumnsRenamed({"mix_tokens": "n_tokens", "mix_epoch": "epoch", "mix_block": "block", "mix_at": "at"})
