"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.llm.common import numbered, staged, unit_hash, whole_rows

WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def weights_at(totals: dict[str, int], exponent: float) -> dict[str, float]:
    """Shares raised to ``exponent`` and normalised; sources without tokens weigh nothing."""
    whole = sum(totals.values())
    powered = {s: (t / whole) ** exponent if t else 0.0 for s, t in totals.items()}
    norm = sum(powered.values())
    return {s: p / norm for s, p in powered.items()} if norm else powered


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * log(w) for w in weights.values() if w > 0)


def repeats(totals: dict[str, int], weights: dict[str, float], budget: float) -> dict[str, float]:
    """Passes over each source that its part of the budget pays for."""
    return {s: budget * weights[s] / t if t else 0.0 for s, t in totals.items()}


def whole_budget(totals: dict[str, int], weights: dict[str, float]) -> float:
    """The smallest budget that covers every source at least once."""
    return max((t / weights[s] for s, t in totals.items() if t), default=0.0)


def bisect(fits: Callable[[float], bool], steps: int = 60) -> float:
    """The smallest exponent in [0, 1] that fits, where a larger one fits if a smaller does; 1 if none below it does."""
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


@dataclass(frozen=True)
class Mix:
    exponent: float
    budget: float
    weights: dict[str, float]
    passes: dict[str, float]


def plan_mix(
    totals: dict[str, int], target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None
) -> Mix:
    """Choose the exponent by bisection.

    With ``target_entropy`` (nats): the largest exponent, i.e. the mix closest to the natural one, whose
    entropy reaches the target. With ``max_repeats``: the smallest exponent, i.e. the flattest mix, in
    which no source is passed over more often. Without a budget, the smallest one that covers every
    source at least once is taken, so no document is left out.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")

    def paid(weights: dict[str, float]) -> float:
        return whole_budget(totals, weights) if budget is None else float(budget)

    if max_repeats is not None:

        def fits(a: float) -> bool:
            w = weights_at(totals, a)
            return max(repeats(totals, w, paid(w)).values(), default=0.0) <= max_repeats * (1 + 1e-12)

        exponent = bisect(fits)
    else:
        exponent = 1.0 if entropy(weights_at(totals, 1.0)) >= target_entropy else 1.0 - bisect(
            lambda b: entropy(weights_at(totals, 1.0 - b)) >= target_entropy
        )
    weights = weights_at(totals, exponent)
    total = paid(weights)
    return Mix(exponent, total, weights, repeats(totals, weights, total))


SOURCES = "array<struct<key: string, weight: double, passes: double, whole: int, rest: double>>"


def source_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``key, weight, passes, whole, rest`` of each source, from one literal: no Python worker makes it."""
    text = json.dumps([dict(zip(("key", "weight", "passes", "whole", "rest"), r, strict=True)) for r in rows])
    return spark.range(1).select(F.from_json(F.lit(text), SOURCES).alias("rows")).select(F.inline("rows"))


def source_key(source_col: str) -> Column:
    """":" before a name keeps a null apart from every name."""
    return F.coalesce(F.concat(F.lit(":"), F.col(source_col).cast("string")), F.lit(""))


def _uses(base: DataFrame, counted: DataFrame, seed: int, **target) -> DataFrame:
    """The rows of ``base`` (``id, key, tokens`` and others) once per use, with a struct ``mix``.

    ``counted`` holds ``id, key, tokens`` of the same documents, staged. A source with p passes gives
    floor(p) whole permutations of its documents and the start of another, up to the document that
    reaches its budget (documents whose order hash is equal go together). Each pass has its own order, a
    hash of id and pass. The start of the last pass ends at one hash per source, so ``base`` is neither
    joined with documents nor shuffled.
    """
    sums = counted.groupBy("key").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    totals, count = {r["key"]: r["t"] for r in sums}, sum(r["n"] for r in sums)
    plan = plan_mix(totals, **target)
    # a whole number that the division missed by a rounding is that number
    passes = {s: float(round(p)) if abs(p - round(p)) < 1e-9 else p for s, p in plan.passes.items()}
    passes = {s: p if totals[s] else 1.0 for s, p in passes.items()}
    table = [(s, plan.weights[s], p, int(p), (p - int(p)) * totals[s]) for s, p in passes.items()]
    table = staged(source_table(base.sparkSession, table))

    order = lambda epoch: unit_hash("id", epoch, F.lit(seed))
    last = counted.join(table.filter("rest > 0"), "key").withColumn("order", order(F.col("whole")))
    last = numbered(last, ["key"], "order", count, weight="tokens", ties=["id", "tokens"]).filter("before < rest")
    table = table.join(last.groupBy("key").agg(F.max("order").alias("until")), "key", "left")
    # one row per source, and staged: small tables are broadcast by their measured size
    table = staged(table.select("key", F.struct("weight", "passes", "whole", "until").alias("plan")))

    out = base.join(table, "key")
    again = order(F.col("plan.whole")) <= F.coalesce(F.col("plan.until"), F.lit(-1))
    epochs = F.sequence(F.lit(0), F.col("plan.whole") - F.when(again, 0).otherwise(1))
    epochs = F.when((F.col("plan.whole") > 0) | again, epochs).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("epoch", F.explode(epochs))
    position = (F.col("epoch") + order(F.col("epoch")) / F.lit(float(1 << 31))) / F.col("plan.passes")
    position = F.least(position, F.lit(1 - 2**-53)).alias("position")
    return out.select(*base.columns, F.struct("tokens", "epoch", position, "plan.weight", "plan.passes").alias("mix"))


def repeat_rows(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: float | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` once per use, with their columns unchanged, whatever they are called."""
    rows = docs.select(whole_rows(docs), F.col(id_col).alias("id"), source_key(source_col).alias("key"), word_count(F.col(text_col)).alias("tokens"))
    target = {"target_entropy": target_entropy, "max_repeats": max_repeats, "budget": budget}
    return _uses(rows, staged(rows.select("id", "key", "tokens")), seed, **target).select("row.*")


def mix(
    docs: DataFrame,
    blocks: int = 1000,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: float | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed order: one row per use of a document,
    ``doc_id, source, tokens, epoch, block, position, weight, passes``.

    ``position`` in [0, 1) is the place in the whole mix: each source is spread evenly, so each of the
    ``blocks`` equal ranges of it holds the target weights; rows of one position go by (source, epoch,
    doc_id). ``weight`` is the share of the budget that the source shall get. Texts are read once, for
    their tokens.

    Tokens are words between ASCII white space. A null source is a source of its own. Documents without
    words cost nothing: they are part of each whole pass of their source, and a source of only such
    documents is passed over once. Repeated rows are documents of their own; null ids are kept; other
    columns are ignored; an empty table gives no rows. One total per source reaches the driver: sources
    are names of corpora, not of documents.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("tokens"))
    rows = staged(rows.withColumn("key", source_key("source")))
    target = {"target_entropy": target_entropy, "max_repeats": max_repeats, "budget": budget}
    used = _uses(rows, rows, seed, **target)
    return used.select(
        F.col("id").alias("doc_id"),
        "source",
        "mix.tokens",
        "mix.epoch",
        F.floor(F.col("mix.position") * blocks).cast("int").alias("block"),
        "mix.position",
        "mix.weight",
        "mix.passes",
    )
