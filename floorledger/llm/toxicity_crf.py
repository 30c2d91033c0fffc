"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give document scores and offsets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from floorledger.llm.common import bounded_batches, staged, unit_hash
from floorledger.llm.language_id import held_out
from floorledger.llm.textarrays import SPACES, byte_table, column_bytes, groups, mixed, words

#: Tokens are runs of other bytes than white space and ASCII marks; chains end at these bytes.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
TABLE = byte_table(SPACES + MARKS)
ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))
RANGE = 2 << 20


#: A token's stems are its first bytes, as many as these.
STEMS = (4, 5, 6, 7, 8)
_CODES = np.random.default_rng(5).integers(1, 1 << 63, size=max(STEMS) + 1, dtype=np.uint64) | np.uint64(1)


@dataclass
class Tokens:
    """Tokens of a range of texts; ``first`` marks the first one of each chain, a sentence or line."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    stems: np.ndarray
    first: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    text, start, end, word = words(data, offsets, TABLE)
    body = data[int(offsets[0]) : int(offsets[-1])]
    chain = np.concatenate(([0], np.cumsum(ENDS[body])))[start]
    first = np.ones(len(word), bool)
    first[1:] = (chain[1:] != chain[:-1]) | (text[1:] != text[:-1])
    return Tokens(text, start, end, word, _stems(body, start, end), first)


def shortened(found: Tokens, offsets: np.ndarray, longest: int, piece: int = 256) -> Tokens:
    """``found`` with about ``longest`` bytes of tokens of each longer text: whole sentences, those of more than ``piece``
    tokens in pieces, drawn by a hash of their place and first word from all of the text."""
    long = np.flatnonzero(np.diff(offsets) > longest)
    if not len(long):
        return found
    keep, first = np.ones(len(found.word), bool), found.first.copy()
    for t in long:
        a, b = np.searchsorted(found.text, [t, t + 1])
        if a == b:
            continue
        begins = found.first[a:b]
        since = np.arange(b - a) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        begins = first[a:b] = since % piece == 0
        at = np.flatnonzero(begins)
        size = np.add.reduceat(found.end[a:b] - found.start[a:b] + 1, at)
        drawn = np.argsort(mixed(found.word[a:b][at] + np.arange(len(at), dtype=np.uint64) * _CODES[0]), kind="stable")
        chosen = np.zeros(len(at), bool)
        chosen[drawn[np.cumsum(size[drawn]) - size[drawn] < longest]] = True
        keep[a:b] = chosen[np.cumsum(begins) - 1]
    return Tokens(found.text[keep], found.start[keep], found.end[keep], found.word[keep], found.stems[:, keep], first[keep])


def _stems(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(len(STEMS), tokens) hashes of the first bytes; 0 for shorter tokens."""
    out = np.zeros((len(STEMS), len(start)), np.uint64)
    value = np.zeros(len(start), np.uint64)
    for k in range(max(STEMS)):
        value += TABLE[body[np.minimum(start + k, len(body) - 1)]].astype(np.uint64) * _CODES[k] if len(start) else value
        if k + 1 in STEMS:
            out[STEMS.index(k + 1)] = np.where(end - start > k, mixed(value + np.uint64(k)), np.uint64(0))
    return out


def _scan(m: np.ndarray, v: np.ndarray, block: int = 64) -> np.ndarray:
    """(2, n): the row vector ``v`` times the first t + 1 of the n matrices ``m`` (rows 00, 01, 10, 11), scaled to sum one.

    Blocks are multiplied side by side, their products scanned, then the vectors carried through the
    blocks side by side: the number of steps does not depend on the lengths of the chains.
    """
    n = m.shape[1]
    if n <= 2 * block:
        out = np.empty((2, n))
        a, b = float(v[0]), float(v[1])
        for t in range(n):
            a, b = a * m[0, t] + b * m[2, t], a * m[1, t] + b * m[3, t]
            s = a + b
            a, b = a / s, b / s
            out[0, t], out[1, t] = a, b
        return out
    count = -(-n // block)
    padded = np.empty((4, count * block))
    padded[:, :n] = m
    padded[:, n:] = np.array([1.0, 0.0, 0.0, 1.0])[:, None]
    steps = np.ascontiguousarray(padded.reshape(4, count, block).transpose(2, 0, 1))
    p = steps[0].copy()
    for t in range(1, block):
        x = steps[t]
        p = np.stack([p[0] * x[0] + p[1] * x[2], p[0] * x[1] + p[1] * x[3], p[2] * x[0] + p[3] * x[2], p[2] * x[1] + p[3] * x[3]])
        if t % 8 == 7 or t == block - 1:
            p /= p.max(0)
    ends = _scan(p, v, block)
    a, b = np.concatenate(([v[0]], ends[0, :-1])), np.concatenate(([v[1]], ends[1, :-1]))
    out = np.empty((2, block, count))
    for t in range(block):
        x = steps[t]
        a, b = a * x[0] + b * x[2], a * x[1] + b * x[3]
        s = a + b
        a, b = a / s, b / s
        out[0, t], out[1, t] = a, b
    return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def marginals(emission: np.ndarray, first: np.ndarray, move: np.ndarray, pairs: bool = False):
    """P(toxic) of each token, and with ``pairs`` the expected counts of the four transitions.

    Forward-backward over two states; ``emission`` is the score of toxic against other, ``move[i, j]``
    that of a step from i to j. A chain's first token forgets the state before it, so all chains make one
    sequence of matrices.
    """
    n = len(emission)
    if not n:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    a, e = np.exp(move), np.exp(np.clip(emission, -30, 30))
    m = np.stack([np.full(n, a[0, 0]), a[0, 1] * e, np.full(n, a[1, 0]), a[1, 1] * e])
    m[:, first] = np.stack([np.ones(first.sum()), e[first]] * 2)
    half = np.array([0.5, 0.5])
    forward = _scan(m, half)
    # backward: the transposed matrices of the tokens after, from the end
    turned = m[[0, 2, 1, 3], 1:][:, ::-1]
    backward = np.concatenate([half[:, None], _scan(turned, half)], 1)[:, ::-1] if n > 1 else half[:, None]
    p = forward * backward
    p = p[1] / (p[0] + p[1])
    if not pairs:
        return p
    inner = np.flatnonzero(~first)
    joint = np.stack([forward[0, inner - 1], forward[0, inner - 1], forward[1, inner - 1], forward[1, inner - 1]]) * m[:, inner]
    joint *= backward[[0, 1, 0, 1]][:, inner]
    return p, (joint / joint.sum(0)).sum(1).reshape(2, 2)


def _places(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places in the sorted ``known``; its length for other values."""
    if not len(known):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, len(known))


@dataclass
class Field:
    """Weights of known words and stems, of the words before and after, and of transitions; unknown ones have none."""

    vocabulary: np.ndarray
    stems: np.ndarray
    bias: float
    weights: np.ndarray
    stem_weights: np.ndarray
    move: np.ndarray
    document: np.ndarray

    def look_up(self, word: np.ndarray, stems: np.ndarray):
        """Each distinct word's places of word and stems, and each token's distinct word."""
        _, at, own = np.unique(word, return_index=True, return_inverse=True)
        return _places(self.vocabulary, word[at]), np.stack([_places(self.stems, x[at]) for x in stems]), own

    def emission(self, places, first: np.ndarray) -> np.ndarray:
        word, stems, own = places
        out = self.bias + (self.weights[0, word] + self.stem_weights[stems].sum(0))[own]
        inner = ~first[1:]
        out[1:] += inner * self.weights[1, word][own[:-1]]
        out[:-1] += inner * self.weights[2, word][own[1:]]
        return out

    def tag(self, found: Tokens) -> np.ndarray:
        if not len(found.word):
            return np.zeros(0)
        return marginals(self.emission(self.look_up(found.word, found.stems), found.first), found.first, self.move)

    def score(self, text: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
        margin = summary(text, p, n) @ self.document
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def summary(text: np.ndarray, p: np.ndarray, n: int, weak: float = 0.3) -> np.ndarray:
    """Of each text: 1, the largest marginal, and the log of the sum of those of at least ``weak``; the many
    small ones of a long text are no evidence."""
    most = np.zeros(n)
    np.maximum.at(most, text, p)
    return np.stack([np.ones(n), most, np.log1p(np.bincount(text, weights=p * (p >= weak), minlength=n))], 1)


def marking(value: np.ndarray, context: np.ndarray, toxic: np.ndarray, least: int = 8, precision: float = 0.9) -> np.ndarray:
    """Words or stems that mark a toxic text: the weak labels of tokens, as labels are given for documents only.

    Evidence is counted in distinct contexts, so copied texts count once. A value is taken if it has at
    least ``least`` of them in toxic texts and they make up ``precision`` of what both kinds of text have
    in relation to their sizes.
    """
    some = np.flatnonzero(value)  # 0: no such stem
    _, once = np.unique(mixed(mixed(value[some]) + context[some] * np.uint64(2) + toxic[some]), return_index=True)
    value, toxic = value[some[once]], toxic[some[once]]
    sizes = np.bincount(toxic, minlength=2).astype(float)
    known, at = np.unique(value, return_inverse=True)
    bad = np.bincount(at, weights=toxic, minlength=len(known))
    good = np.bincount(at, weights=~toxic, minlength=len(known))
    rate, other = bad / max(sizes[1], 1), (good + 0.5) / max(sizes[0], 1)
    return known[(bad >= least) & (rate >= precision * (rate + other))]


@dataclass
class Sample:
    """Tokens of training documents one after the other: the document of each, its word, whether a chain begins;
    the stems of the distinct words in order; and a label and a weight per document."""

    text: np.ndarray
    word: np.ndarray
    first: np.ndarray
    stems: np.ndarray
    y: np.ndarray
    weight: np.ndarray


def fit_field(sample: Sample, turns: int = 30, rate: float = 0.4, penalty: float = 1e-3) -> Field | None:
    """Train on a sample; None if nothing marks the toxic documents."""
    text, word, first, y = sample.text, sample.word, sample.first, sample.y
    if not len(word):
        return None
    distinct_words, own = np.unique(word, return_inverse=True)
    edge, toxic = np.zeros(1, np.uint64), y[text] == 1
    before, after = np.concatenate((edge, word[:-1])), np.concatenate((word[1:], edge))
    context = mixed(before * np.uint64(3) + word * np.uint64(7) + after * np.uint64(5))
    label = np.zeros(len(word), bool)
    for value in (distinct_words, *sample.stems):
        label |= np.isin(value, marking(value[own], context, toxic))[own]
    label = (label & toxic).astype(float)
    if not label.any():
        return None
    # words and stems seen as or beside toxic ones, and the frequent ones; all others share the bias
    near = label > 0
    near[1:] |= label[:-1] > 0
    near[:-1] |= label[1:] > 0

    times, beside = np.bincount(own), np.bincount(own, weights=near) > 0

    def kept(value: np.ndarray) -> np.ndarray:
        known, at = np.unique(value, return_inverse=True)
        out = known[(np.bincount(at, weights=times) >= 20) | (np.bincount(at, weights=beside) > 0)]
        return out[out != 0]

    vocabulary, known_stems = kept(distinct_words), np.unique(np.concatenate([kept(x) for x in sample.stems]))
    v, k = len(vocabulary), len(known_stems)
    field = Field(vocabulary, known_stems, -3.0, np.zeros((3, v + 1)), np.zeros(k + 1), np.zeros((2, 2)), np.zeros(3))
    at, stems_at = _places(vocabulary, distinct_words), np.stack([_places(known_stems, x) for x in sample.stems])
    places = at, stems_at, own
    observed = np.zeros((2, 2))
    inner = ~first[1:]
    np.add.at(observed, (label[:-1][inner].astype(int), label[1:][inner].astype(int)), 1)
    means = [0.0, np.zeros((3, v + 1)), np.zeros(k + 1), np.zeros((2, 2))]
    squares = [0.0, np.zeros((3, v + 1)), np.zeros(k + 1), np.zeros((2, 2))]
    for turn in range(1, turns + 1):
        p, counts = marginals(field.emission(places, first), first, field.move, pairs=True)
        error = p - label
        distinct = np.bincount(own, weights=error, minlength=len(at))
        sums = [distinct, np.bincount(own[:-1], weights=error[1:] * inner, minlength=len(at)), np.bincount(own[1:], weights=error[:-1] * inner, minlength=len(at))]
        gw = np.stack([np.bincount(at, weights=x, minlength=v + 1) for x in sums])
        gs = sum(np.bincount(x, weights=distinct, minlength=k + 1) for x in stems_at)
        gw[:, -1] = 0  # no weight for what is unknown
        gs[-1] = 0
        gradients = [error.sum(), gw + penalty * field.weights, gs + penalty * field.stem_weights, counts - observed + penalty * field.move]
        gradients[3][0, 0] = 0  # the others are measured against it
        steps = []
        for i, g in enumerate(gradients):
            means[i], squares[i] = 0.8 * means[i] + 0.2 * g, 0.95 * squares[i] + 0.05 * g * g
            steps.append(rate * (means[i] / (1 - 0.8**turn)) / (np.sqrt(squares[i] / (1 - 0.95**turn)) + 1e-2))
        field.bias -= float(steps[0])
        field.weights -= steps[1]
        field.stem_weights -= steps[2]
        field.move -= steps[3]
    p = marginals(field.emission(places, first), first, field.move)
    field.document = fit_document(summary(text, p, len(y)), y, sample.weight)
    return field


def fit_document(x: np.ndarray, y: np.ndarray, weight: np.ndarray, turns: int = 50, penalty: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def collect_sample(rows: DataFrame, longest: int) -> Sample:
    """The sample of ``text, y, weight`` rows; the caller bounds the rows, ``longest`` what a text gives. The distinct words of a batch travel
    with their stems, the tokens as their numbers."""

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in groups(offsets, RANGE):
                found = shortened(tokens(data, offsets[a : b + 1]), offsets[a : b + 1], longest)
                known, at, own = np.unique(found.word, return_index=True, return_inverse=True)
                given = {c: batch.column(c).slice(a, b - a).to_pylist() for c in ("y", "weight")}
                parts = {
                    "words": known, **{f"stem{k}": found.stems[i, at] for i, k in enumerate(STEMS)},
                    "own": own.astype(np.int32), "first": found.first, "text": found.text.astype(np.int32), **given,
                }
                lists = [pa.array([v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else v]) for v in parts.values()]
                yield pa.RecordBatch.from_arrays(lists, list(parts))

    bounded_batches(rows.sparkSession)
    longs = ", ".join(f"{c} array<long>" for c in ("words", *(f"stem{k}" for k in STEMS)))
    schema = f"{longs}, own array<int>, first array<boolean>, text array<int>, y array<double>, weight array<double>"
    table = rows.select("text", "y", "weight").mapInArrow(run, schema).toArrow()

    def parts(name: str) -> list[np.ndarray]:
        return [v.values.to_numpy(zero_copy_only=False) for v in table.column(name)]

    def joined(name: str, kind) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *[x.astype(kind, copy=False) for x in parts(name)]])

    each = parts("words")
    shift = np.cumsum([0] + [len(x) for x in parts("y")])
    words_, once = np.unique(joined("words", np.int64).view(np.uint64), return_index=True)
    return Sample(
        np.concatenate([np.zeros(0, np.int64), *[x + d for x, d in zip(parts("text"), shift, strict=False)]]),
        np.concatenate([np.zeros(0, np.int64), *[w[o] for w, o in zip(each, parts("own"), strict=True)]]).view(np.uint64),
        joined("first", bool),
        np.stack([joined(f"stem{k}", np.int64)[once].view(np.uint64) for k in STEMS]),
        joined("y", float),
        joined("weight", float),
    )


def chosen_ids(labels: DataFrame, label: str, most: int, toxic: float = 0.2) -> DataFrame:
    """About ``most`` labelled ids that may be learned from, at most a share of ``toxic`` of them toxic, with
    ``y`` and the ``weight`` that restores the shares of the labels."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = {y: min(1.0, most * (toxic if y else 1 - toxic) / n) for y, n in sizes.items()}
    part = F.when(F.col("y") == 1, F.lit(share.get(1.0, 1.0))).otherwise(F.lit(share.get(0.0, 1.0)))
    chosen = known.filter(unit_hash("doc_id", F.lit(9)) / F.lit(float(1 << 31)) < part)
    return staged(chosen.withColumn("weight", 1 / part))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 2500, longest: int = 50_000) -> Field | None:
    """Train on about ``most`` labelled texts, of those above ``longest`` bytes on about as many, in sentences."""
    ids = chosen_ids(labels, label, most)
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text")
    rows = rows.join(F.broadcast(ids), "doc_id")  # at most about ``most`` ids
    sample = collect_sample(rows, longest)
    return fit_field(sample) if len(set(sample.y)) == 2 else None


SPANS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("p", DoubleType()))


def spans(found: Tokens, p: np.ndarray, body: np.ndarray, bounds: np.ndarray, cut: float) -> list[list[dict]]:
    """Runs of tokens with a marginal of at least ``cut``, in characters of their text."""
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    hit = np.flatnonzero(p >= cut)
    if not len(hit):
        return out
    chars = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | found.first[hit[1:]]
    runs = np.flatnonzero(new)
    last = np.append(runs[1:], len(hit)) - 1
    highest = np.maximum.reduceat(p[hit], runs)
    for a, b, most in zip(hit[runs], hit[last], highest, strict=True):
        t = found.text[a]
        zero = chars[bounds[t]]
        out[t].append({"start": int(chars[found.start[a]] - zero), "end": int(chars[found.end[b]] - zero), "p": float(most)})
    return out


def tag_documents(docs: DataFrame, field: Field | None, columns: list[str], cut: float = 0.5) -> DataFrame:
    """``columns`` of ``docs`` with ``score`` and ``spans`` of ``text``."""
    spark = docs.sparkSession

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            scores, places = np.zeros(len(offsets) - 1), [[] for _ in range(len(offsets) - 1)]
            if field is not None:
                for a, b in groups(offsets, RANGE):
                    own = offsets[a : b + 1]
                    found = tokens(data, own)
                    p = field.tag(found)
                    scores[a:b] = field.score(found.text, p, b - a)
                    places[a:b] = spans(found, p, data[own[0] : own[-1]], own - own[0], cut)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array(places, kind)], [*columns, "score", "spans"])

    bounded_batches(spark, rows=2000, size="8m")
    schema = docs.select(*columns).schema.add("score", "double").add("spans", SPANS)
    return docs.select(*columns, "text").mapInArrow(run, schema)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    cut: float = 0.5,
    most: int = 2500,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = 50_000,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, spans`` (offending offsets in characters).

    Learns from about ``most`` labelled rows whose id's crc32 mod 5 is not 0, of a text above ``longest``
    bytes from about as many, in sentences drawn from all of it; all of every text is scored. Null and empty texts have no token and get
    the score of that; without labels of both kinds, or if nothing tells them apart, every score is 0.
    Repeated rows are scored alike, null ids kept, other columns ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 5, 0).alias("held_out"), F.col(text_col).alias("text"))
    field = fit_toxicity(rows, labels, most=most, longest=longest)
    out = tag_documents(rows, field, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), "spans")
