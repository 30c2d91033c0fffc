"""URL filter: suffix and path rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import staged, unit_hash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for texts without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls. The rules are a short list of the caller."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashed_grams(host: Column, path: Column, size: int, lengths: tuple[int, ...]) -> Column:
    """Buckets of the character n-grams of host and path, each with its own marks.

    A text is split into characters once, so the work is linear in its length.
    """

    def grams(text: Column, mark: str) -> Column:
        def run(chars: Column, n: int) -> Column:
            def at(i: Column) -> Column:
                parts = [F.get(chars, (i + k).cast("int")) for k in range(n)]
                return F.pmod(F.xxhash64(F.lit(mark), *parts), F.lit(size)).cast("int")

            found = F.transform(F.sequence(F.lit(0), F.size(chars) - n), at)
            return F.when(F.size(chars) >= n, found).otherwise(F.array().cast("array<int>"))

        marked = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
        return once(marked, lambda chars: F.concat(*[run(chars, n) for n in lengths]))

    return F.concat(grams(host, "host"), grams(path, "path"))


@dataclass
class UrlModel:
    bias: float
    weights: list[float]

    def margin(self, buckets: Column) -> Column:
        """Bias and mean weight times the root of the count, i.e. features of length one."""
        w = F.split(F.lit(" ".join(map(repr, self.weights))), " ").cast("array<double>")

        def linear(found: Column) -> Column:
            total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(w, b))
            return F.lit(self.bias) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))

        return once(buckets, linear)

    def probability(self, buckets: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin(buckets)))


def fit(examples: DataFrame, size: int, rounds: int, rate: float = 4.0, penalty: float = 1e-4) -> UrlModel:
    """Logistic regression by momentum descent; ``examples`` holds ``buckets`` and ``y`` (1: block).

    Each round is one aggregation by bucket; at most ``size`` + 1 sums reach the driver.
    """
    rows = max(1, examples.count())
    model = UrlModel(0.0, [0.0] * size)
    speed_b, speed = 0.0, [0.0] * size
    for _ in range(rounds):
        scored = examples.withColumn("error", model.probability(F.col("buckets")) - F.col("y"))
        scale = F.col("error") / F.sqrt(F.greatest(F.size("buckets"), F.lit(1)).cast("double"))
        each = scored.select(F.explode(F.concat(F.array(F.lit(-1)), "buckets")).alias("bucket"), "error", scale.alias("scaled"))
        pull = F.when(F.col("bucket") < 0, F.col("error")).otherwise(F.col("scaled"))
        sums = {r["bucket"]: r["g"] / rows for r in each.groupBy("bucket").agg(F.sum(pull).alias("g")).collect()}
        speed_b = 0.8 * speed_b - rate * 0.25 * sums.get(-1, 0.0)
        speed = [0.8 * v - rate * (sums.get(k, 0.0) + penalty * w) for k, (v, w) in enumerate(zip(speed, model.weights, strict=True))]
        model = UrlModel(model.bias + speed_b, [w + v for w, v in zip(model.weights, speed, strict=True)])
    return model


def small_sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows by a hash of their content, or all of fewer: a bounded table to learn from."""
    share = min(1.0, most / max(1, rows.count()))
    return rows.filter(unit_hash("host", "path") < F.lit(int(share * (1 << 31))))


def url_filter(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    labelled: DataFrame | None = None,
    size: int = 2048,
    lengths: tuple[int, ...] = (3, 4),
    most: int = 4000,
    rounds: int = 25,
    cut: float = 0.5,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, score``; score is the probability of ``block``.

    The method learns from ``labelled`` (``url, verdict``), or without it from the urls that the rules
    judge; at most about ``most`` distinct (host, path) of them are used. Where a rule fits, its verdict
    holds. Null urls, empty ones and those without ``://`` have an empty host and path and are judged by
    the method. Without any labelled url the score is 0.5 and the verdict ``allow``. Repeated rows are
    judged alike; other columns are ignored; an empty table gives no rows.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict})
    if labelled is None:
        table = rows.filter("ruled IS NOT NULL").select("host", "path", F.col("ruled").alias("label")).distinct()
    else:
        lhost, lpath = url_parts(F.col("url"))
        table = labelled.filter("verdict IN ('block', 'allow')").select(lhost.alias("host"), lpath.alias("path"), F.col("verdict").alias("label")).distinct()
    table = staged(table)
    buckets = hashed_grams(F.col("host"), F.col("path"), size, lengths)
    examples = staged(small_sample(table, most).select(buckets.alias("buckets"), (F.col("label") == "block").cast("double").alias("y")))
    model = fit(examples, size, rounds) if not examples.isEmpty() else UrlModel(0.0, [0.0] * size)
    score = model.probability(buckets)
    rows = rows.withColumn("score", score)
    judged = F.when(F.col("score") > cut, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
