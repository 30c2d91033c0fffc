"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import bounded_batches, staged, unit_hash, whole_rows
from floorledger.llm.language_id import held_out
from floorledger.llm.textarrays import SPACES, byte_table, column_bytes, groups, words

WORD_BITS = 14
TABLE = byte_table(SPACES, fold=False)
#: Names of the statistics, in the order of ``statistics``; the last four describe the text as a whole.
STATISTICS = (
    "letters", "upper", "digits", "marks", "high bytes", "marks at word ends", "mean word length", "long words",
    "distinct words", "repeated pairs", "most frequent word", "words per line", "repeated lines", "distinct marks",
    "log bytes", "log words", "log lines", "bytes per word",
)
_KIND = np.full(256, 3, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 mark, 4 high byte, 5 space
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 4
_KIND[np.frombuffer(SPACES, np.uint8)] = 5


def _counted(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, value, times) of the distinct pairs, in order of text."""
    if not len(text):
        return text, value, np.zeros(0, np.int64)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    first = np.concatenate(([True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])))
    at = np.flatnonzero(first)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def statistics(data: np.ndarray, offsets: np.ndarray, found) -> np.ndarray:
    """One row of ``STATISTICS`` per text of a range; zeros for texts without words."""
    text, start, end, hashed = found
    n = len(offsets) - 1
    body = data[int(offsets[0]) : int(offsets[-1])]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(owner * 6 + _KIND[body], minlength=6 * n).reshape(n, 6).astype(float)
    size, visible = np.diff(offsets).astype(float), np.maximum(kinds[:, :5].sum(1), 1)
    count = np.bincount(text, minlength=n).astype(float)
    some = np.maximum(count, 1)
    each = lambda mask: np.bincount(text, weights=mask, minlength=n) / some
    wt, _, times = _counted(text, hashed, n)
    distinct = np.bincount(wt, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, wt, times)
    pair = text[1:] == text[:-1]
    pairs = (hashed[1:] * np.uint64(3) + hashed[:-1])[pair]
    pt, _, _ = _counted(text[1:][pair], pairs, n)
    pair_count = np.bincount(text[1:][pair], minlength=n)
    # a line is known by the sum of its words' hashes
    breaks = np.concatenate(([0], np.cumsum(body == 10)))
    line = breaks[start]
    new = np.concatenate(([True], (line[1:] != line[:-1]) | (text[1:] != text[:-1]))) if len(line) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    sums = np.add.reduceat(hashed, at) if len(at) else np.zeros(0, np.uint64)
    lines = np.bincount(text[at], minlength=n).astype(float)
    lt, _, _ = _counted(text[at], sums, n)
    length = (end - start).astype(float)
    marks = np.unique(owner[_KIND[body] == 3].astype(np.int64) * 256 + body[_KIND[body] == 3])
    columns = [
        kinds[:, 0] / visible, kinds[:, 1] / visible, kinds[:, 2] / visible, kinds[:, 3] / visible, kinds[:, 4] / visible,
        each(_KIND[body[end - 1]] == 3) if len(end) else np.zeros(n),
        each(length) / 10, each(length > 20), distinct / some,
        1 - np.bincount(pt, minlength=n) / np.maximum(pair_count, 1) * (pair_count > 0) - (pair_count == 0),
        most / some, np.log1p(count / np.maximum(lines, 1)), 1 - np.bincount(lt, minlength=n) / np.maximum(lines, 1) * (lines > 0) - (lines == 0),
        np.bincount(marks // 256, minlength=n) / 10,
        np.log1p(size) / 10, np.log1p(count) / 10, np.log1p(lines) / 10, np.log1p(size / some) / 5,
    ]
    return np.stack(columns, 1) * (count > 0)[:, None]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the hashed words of a range, of length one per text, and its statistics."""
    found = words(data, offsets, TABLE)
    n = len(offsets) - 1
    text, bucket, times = _counted(found[0], (found[3] >> np.uint64(64 - WORD_BITS)).astype(np.int64), n)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(text, weights=value**2, minlength=n))
    return text, bucket, value / np.maximum(norm, 1e-12)[text] if len(text) else value, statistics(data, offsets, found)


@dataclass
class Machine:
    """w0 + sum w x + 1/2 sum over factors of ((sum v x)^2 - sum v^2 x^2); linear in the number of features."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @property
    def words(self) -> int:
        return len(self.w) - len(self.mean)

    def joined(self, text, bucket, value, stats):
        """Words and standardised statistics as one list of features, in order of text."""
        n, s = stats.shape
        z = np.clip((stats - self.mean) / self.scale, -5, 5) / np.sqrt(s)
        all_text = np.concatenate((text, np.repeat(np.arange(n), s)))
        order = np.argsort(all_text, kind="stable")
        column = np.concatenate((bucket, np.tile(self.words + np.arange(s), n)))[order]
        return all_text[order], column, np.concatenate((value, z.reshape(-1)))[order]

    def sums(self, text, column, value):
        """Per text: linear sum and, per factor, sum of v x and of (v x)^2. Every text has its statistics."""
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        vx = self.v[column] * value[:, None]
        return np.add.reduceat(self.w[column] * value, first), np.add.reduceat(vx, first), np.add.reduceat(vx**2, first)

    def probability(self, text, bucket, value, stats) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        linear, vx, vx2 = self.sums(*self.joined(text, bucket, value, stats))
        margin = self.w0 + linear + 0.5 * (vx**2 - vx2).sum(1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(
    examples, y: np.ndarray, factors: int = 8, epochs: int = 20, steps: int = 400, rate: float = 0.02, penalty: float = 1e-5, seed: int = 3
) -> Machine:
    """Adam over mini-batches of ``examples``: (bucket, value, statistics) per text; at least ``steps`` of them."""
    random = np.random.default_rng(seed)
    stats = np.stack([x[2] for x in examples])
    size = (1 << WORD_BITS) + stats.shape[1]
    p = float(np.clip(y.mean(), 0.01, 0.99))
    machine = Machine(np.log(p / (1 - p)), np.zeros(size), random.normal(0, 0.05, (size, factors)), stats.mean(0), stats.std(0) + 1e-3)
    moments = [np.zeros(size), np.zeros(size), np.zeros((size, factors)), np.zeros((size, factors))]
    step = 0
    batches = max(1, len(y) // 128)
    for _ in range(max(epochs, -(-steps // batches))):
        for rows in np.array_split(random.permutation(len(y)), batches):
            some = [examples[i] for i in rows]
            text = np.repeat(np.arange(len(rows)), [len(x[0]) for x in some])
            text, column, value = machine.joined(
                text, np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some]), stats[rows]
            )
            linear, vx, vx2 = machine.sums(text, column, value)
            margin = machine.w0 + linear + 0.5 * (vx**2 - vx2).sum(1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            own = error[text] * value
            gw = np.bincount(column, weights=own, minlength=size)
            inner = own[:, None] * (vx[text] - machine.v[column] * value[:, None])
            gv = np.stack([np.bincount(column, weights=inner[:, f], minlength=size) for f in range(factors)], 1)
            step += 1
            machine.w0 -= rate * error.sum()
            for x, g, (m, s) in ((machine.w, gw, moments[:2]), (machine.v, gv, moments[2:])):
                used = g != 0
                g = g + penalty * x * used
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                x -= rate * used * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return machine


_FEATURES = "y double, buckets array<int>, vals array<float>, stats array<double>"


def collect_examples(rows: DataFrame) -> tuple[list, np.ndarray]:
    """Features of ``text, y`` rows, computed on the executors; the caller bounds the rows."""

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            y = batch.column("y")
            for first, last in groups(offsets):
                text, bucket, value, stats = features(data, offsets[first : last + 1])
                cuts = np.searchsorted(text, np.arange(last - first + 1))
                lists = lambda x, t: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x.astype(t)))  # noqa: E731, B023
                flat = pa.array(np.arange(0, stats.size + 1, stats.shape[1]), pa.int32())
                columns = [y.slice(first, last - first), lists(bucket, np.int32), lists(value, np.float32), pa.ListArray.from_arrays(flat, pa.array(stats.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(columns, ["y", "buckets", "vals", "stats"])

    bounded_batches(rows.sparkSession)
    table = rows.select("text", "y").mapInArrow(run, _FEATURES).toArrow()
    got = [table.column(c).to_numpy(zero_copy_only=False) if c == "y" else table.column(c) for c in ("y", "buckets", "vals", "stats")]
    lists = [[np.asarray(v.values) for v in c] for c in got[1:]]
    return list(zip(*[[x.astype(t) for x in c] for c, t in zip(lists, (np.int64, float, float), strict=True)], strict=True)), got[0]


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of ``rows``, by a hash of the column ``doc_id``."""
    share = min(1.0, most / max(1, rows.count()))
    return rows.filter(unit_hash("doc_id", F.lit(9)) < F.lit(int(share * (1 << 31))))


def known_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """About ``most`` labelled ids that may be learned from, with their label ``y`` (the smallest, where an id repeats)."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    return staged(sampled(known, most))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 6000, **options) -> Machine | None:
    """Train on about ``most`` labelled texts; None without examples of both labels."""
    ids = known_ids(labels, label, most)
    # ids are at most about ``most``, a documented parameter
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    examples, y = collect_examples(rows)
    if len(set(y)) < 2:
        return None
    return train(examples, y, **options)


def score_quality(docs: DataFrame, model: Machine | None, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with ``score`` of ``text``."""
    spark = docs.sparkSession

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            scores = np.full(len(offsets) - 1, 0.5)
            if model is not None:
                for first, last in groups(offsets):
                    scores[first:last] = model.probability(*features(data, offsets[first : last + 1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(scores)], [*columns, "score"])

    bounded_batches(spark)
    schema = docs.select(*columns).schema.add("score", "double")
    return docs.select(*columns, *([] if "text" in columns else ["text"])).mapInArrow(run, schema)


def quality(
    docs: DataFrame, labels: DataFrame, cut: float = 0.3, most: int = 6000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Learns from labelled rows whose id's crc32 mod 5 is not 0. Null and empty texts have no words and no
    statistics and get the score that the model gives to that; without labels of both kinds every score
    is 0.5. Repeated rows are scored alike, null ids kept, other columns ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 5, 0).alias("held_out"), F.col(text_col).alias("text"))
    model = fit_quality(rows, labels, most=most)
    scored = score_quality(rows, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, most: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``cut``, with their columns unchanged; nothing is shuffled."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit_quality(known, labels, most=most)
    whole = docs.select(whole_rows(docs), F.col(text_col).alias("text"))
    return score_quality(whole, model, ["row"]).filter(F.col("score") >= cut).select("row.*")
