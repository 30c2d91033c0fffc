"""Language ID by language-bitmask n-gram filters: bit-sliced Bloom filters, one bit per language in each slot."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import bounded_batches, staged, unit_hash
from floorledger.llm.textarrays import CHUNK, column_bytes, groups, mixed

UNDETERMINED = "und"
LENGTHS = (2, 3, 4, 5)
_CODES = np.random.default_rng(20).integers(1, 1 << 63, size=(max(LENGTHS) + 1, max(LENGTHS)), dtype=np.uint64) | np.uint64(1)
_SPACE = 32


def _letters() -> np.ndarray:
    """256 bytes: ASCII letters in lower case, bytes of other characters as they are, the rest a space."""
    out = np.full(256, _SPACE, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


LETTERS = _letters()


def pieces(offsets: np.ndarray, data: np.ndarray, most: int = CHUNK) -> Iterator[np.ndarray]:
    """The offsets of a range of texts; a text of more than ``most`` bytes in parts, cut behind a byte that is no letter.

    No n-gram has such a byte inside, so the parts have the n-grams of the whole text.
    """
    first, end = int(offsets[0]), int(offsets[-1])
    if len(offsets) > 2 or end - first <= most:
        yield offsets
        return
    while first < end:
        last = min(end, first + most)
        if last < end:
            apart = np.flatnonzero(LETTERS[data[first:last]] == _SPACE)
            while not len(apart) and last < end:  # one word
                more = min(end, last + most)
                apart = np.flatnonzero(LETTERS[data[last:more]] == _SPACE)[:1] + (last - first)
                last = more
            last = first + int(apart[-1]) + 1 if len(apart) else end
        yield np.array([first, last])
        first = last


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the byte n-grams of the texts of one range, within words and over their edges.

    Runs of other bytes than letters count as one space, and every text begins and ends with one.
    """
    base, n = int(offsets[0]), len(offsets) - 1
    edges = np.stack([offsets[:-1], offsets[1:]], 1).reshape(-1) - base
    body = np.insert(LETTERS[data[base : int(offsets[-1])]], edges, _SPACE)
    text = np.repeat(np.arange(n), np.diff(offsets) + 2)
    keep = body != _SPACE
    keep[1:] |= (body[:-1] != _SPACE) | (text[1:] != text[:-1])  # the first space of a run
    keep[:1] = True
    body, text = body[keep], text[keep]
    wide = body.astype(np.uint64)
    found = []
    for size in LENGTHS:
        count = len(body) - size + 1
        if count <= 0:
            continue
        value = np.zeros(count, np.uint64)
        for k in range(size):
            value += wide[k : k + count] * _CODES[size, k]
        # inside one text, no space but at either end, and not of spaces alone
        ok = text[:count] == text[size - 1 :]
        for k in range(1, size - 1):
            ok &= body[k : k + count] != _SPACE
        if size == 2:
            ok &= (body[:count] != _SPACE) & (body[1 : 1 + count] != _SPACE)
        found.append((text[:count][ok], mixed(value[ok])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def slots(hashed: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k slots of each n-gram, of 2^bits."""
    step = (hashed >> np.uint64(32)) | np.uint64(1)
    return np.stack([((hashed + np.uint64(j) * step) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) for j in range(k)])


@dataclass
class LanguageFilter:
    """``masks[w, slot]``: bit l of word w says that language 64 w + l has set the slot."""

    languages: list[str]
    common: int
    masks: np.ndarray
    k: int
    bits: int

    def __post_init__(self):
        filled = [float(np.mean((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(self.languages))]
        self.false = np.array(filled) ** self.k
        if len(self.languages) <= 8:
            self.masks = self.masks.astype(np.uint8)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, n-grams that each language's filter holds) per text."""
        n = len(offsets) - 1
        total, held = np.zeros(n, np.int64), np.zeros((n, len(self.languages)))
        for part in pieces(offsets, data):
            text, hashed = grams(data, part)
            total += np.bincount(text, minlength=n)
            if len(text):
                at = slots(hashed, self.k, self.bits)
                for w, mask in enumerate(self.masks):
                    all_of = mask[at[0]]
                    for j in range(1, self.k):
                        all_of &= mask[at[j]]
                    for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                        has = (all_of >> all_of.dtype.type(i % 64)) & all_of.dtype.type(1)
                        held[:, i] += np.bincount(text, weights=has, minlength=n)
        return total, held

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score) per text; the score is the language's part of all corrected counts."""
        total, held = self.counts(data, offsets)
        # of N n-grams, c + (N - c) f are held when c really are
        true = np.maximum(0.0, (held - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9))
        best, all_ = true.argmax(1), true.sum(1)
        best = np.where(all_ > 0, best, self.common)
        score = np.where(all_ > 0, true.max(1) / np.maximum(all_, 1e-300), 0.0)
        return [self.languages[i] for i in best], np.clip(score, 0.0, 1.0)


_COUNTED = "lang string, gram long, n long"


def count_grams(texts: DataFrame) -> DataFrame:
    """``lang, gram, n`` of ``lang, text``; each batch is folded before the shuffle."""

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            names, code = np.unique(langs, return_inverse=True) if len(langs) else (langs, np.zeros(0, int))
            seen = [[] for _ in names]
            for first, last in groups(offsets):
                for part in pieces(offsets[first : last + 1], data):
                    text, hashed = grams(data, part)
                    for i in range(len(names)):
                        seen[i].append(np.unique(hashed[code[first + text] == i], return_counts=True))
            for name, found in zip(names, seen, strict=True):
                gram = np.concatenate([x[0] for x in found])
                n = np.concatenate([x[1] for x in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                )

    bounded_batches(texts.sparkSession)
    return texts.select("lang", "text").mapInArrow(run, _COUNTED).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(
    examples: DataFrame, most: int = 4000, least_rate: float = 4e-6, share: float = 0.25, k: int = 3, bits: int = 21
) -> LanguageFilter | None:
    """Fit on ``lang, text, key`` rows without nulls; None if there are none.

    About ``most`` rows of each language are used, chosen by a hash of ``key``. A language holds the
    n-grams that make up at least ``least_rate`` of its own, hence at most 1 / ``least_rate`` of them,
    at a rate of at least ``share`` of the largest rate of any language. Only the 2^bits slots of the
    filter reach the driver.
    """
    sizes = {r["lang"]: r["count"] for r in examples.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    keep = F.create_map(*[x for s in languages for x in (F.lit(s), F.lit(min(1.0, most / sizes[s])))])
    sample = examples.filter(unit_hash("key", F.lit(5)) / F.lit(float(1 << 31)) < F.element_at(keep, F.col("lang")))
    counted = staged(count_grams(sample))
    whole = counted.groupBy("lang").agg(F.sum("n").alias("whole"))
    rates = counted.join(F.broadcast(whole), "lang").withColumn("rate", F.col("n") / F.col("whole"))  # a row per language
    largest = rates.groupBy("gram").agg(F.max("rate").alias("largest"))
    held = rates.join(largest, "gram").filter((F.col("rate") >= least_rate) & (F.col("rate") >= share * F.col("largest")) & (F.col("n") > 1))

    def place(batches):
        for batch in batches:
            at = slots(batch.column("gram").to_numpy().view(np.uint64), k, bits).astype(np.int64)
            lang = pa.concat_arrays([batch.column("lang").cast(pa.string())] * k)
            yield pa.RecordBatch.from_arrays([lang, pa.array(at.reshape(-1))], ["lang", "slot"])

    set_ = held.select("gram", "lang").mapInArrow(place, "lang string, slot long")
    index = F.create_map(*[x for i, s in enumerate(languages) for x in (F.lit(s), F.lit(i))])
    set_ = set_.withColumn("i", F.element_at(index, F.col("lang")))
    words = (len(languages) + 63) // 64
    masks = np.zeros((words, 1 << bits), np.uint64)
    one = F.expr("shiftleft(1L, i % 64)")
    filled = set_.groupBy(F.floor(F.col("i") / 64).alias("w"), "slot").agg(F.bit_or(one).alias("mask")).toArrow()
    at = filled.column("w").to_numpy(), filled.column("slot").to_numpy()
    masks[at] = filled.column("mask").to_numpy().view(np.uint64)
    common = max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i))
    return LanguageFilter(languages, common, masks, k, bits)


def plain_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has an ASCII letter."""
    out = np.zeros(len(offsets) - 1, bool)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.logical_or.reduceat(_PLAIN[data], offsets[some])
    return out


_PLAIN = (LETTERS != _SPACE) & (np.arange(256) < 128)
_LETTER = re.compile(r"[^\W\d_]")


def predict(docs: DataFrame, model: LanguageFilter | None, text_col: str, columns: list) -> DataFrame:
    """``columns`` (name, Arrow type) of ``docs`` with ``lang_pred`` and ``score``."""
    names = [c for c in columns]
    spark = docs.sparkSession

    def run(batches):
        for batch in batches:
            texts = batch.column("__text")
            data, offsets = column_bytes(texts)
            langs, scores = [], []
            for first, last in groups(offsets):
                if model:
                    lang, score = model.decide(data, offsets[first : last + 1])
                else:
                    lang, score = [UNDETERMINED] * (last - first), np.zeros(last - first)
                langs += lang
                scores.append(score)
            scores = np.concatenate(scores) if scores else np.zeros(0)
            for i in np.flatnonzero(~plain_letter(data, offsets)):
                if not _LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")):
                    langs[i], scores[i] = UNDETERMINED, 0.0
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    bounded_batches(spark)
    given = docs.select(*names, F.col(text_col).alias("__text"))
    schema = given.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return given.mapInArrow(run, schema)


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id's text falls into ``part``; a null id does not."""
    rest = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))
    return F.coalesce(rest == part, F.lit(False))


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options
) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``; ``options`` go to ``learn``.

    Learns from rows with text and language whose id's crc32 mod 3 is not 1. A null text and one without
    a letter are ``und`` with score 0; so is every text if there is nothing to learn from. A text whose
    n-grams no filter holds gets the most frequent learned language with score 0; ties go to the first
    language by name. Repeated rows are judged alike, null ids kept, other columns ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col, 3, 1).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    examples = rows.filter("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL")
    model = learn(examples.select("lang", "text", F.col("doc_id").alias("key")), **options)
    return predict(rows.select("doc_id", "held_out", "text"), model, "text", ["doc_id", "held_out"])
