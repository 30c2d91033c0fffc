"""Substring dedup: suffix automata of reference shards give the matching statistics of what documents may share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import bounded_batches, dropped, staged
from floorledger.llm.textarrays import CHUNK, SPACES, Powers, byte_table, column_bytes, groups, mixed, words

WINDOW, GRAM = 35, 8
SHARD_WORDS = 60_000
#: Contents under one fingerprint that one automaton may hold; beyond, windows are looked up one by one.
MOST_CONTENTS = 1000
#: Words of more bytes are hashed whole.
LONG_WORD = 1 << 16
TABLE = byte_table(SPACES, fold=False)
TABLE[0] = 9  # a separator's byte, which no word holds: NUL stays apart from all others
_ODD = np.random.default_rng(12).integers(1, 1 << 63, size=GRAM, dtype=np.uint64) | np.uint64(1)
_POWERS = Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text, hash, first) of the words of a range of texts: ``first`` is the number of the part's first word.

    Short texts come in one part. A long one comes in parts of about CHUNK bytes, cut between words, each
    of which begins with the last ``overlap`` words of the one before.
    """
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if len(offsets) > 2 or size <= CHUNK:
        text, start, end, hashed = words(data, offsets, TABLE)
        yield text, _whole(data[base:], start, end, hashed), 0
        return
    before, first = np.zeros(0, np.uint64), 0
    for low, high in cuts(data[base : base + size]):
        piece = data[base + low : base + high]
        if high - low > CHUNK:  # one word
            hashed = np.array([_digest(piece)], np.uint64)
        else:
            _, start, end, hashed = words(piece, np.array([0, len(piece)]), TABLE)
            hashed = _whole(piece, start, end, hashed)
        hashed = np.concatenate((before, hashed))
        yield np.zeros(len(hashed), np.int64), hashed, first - len(before)
        first += len(hashed) - len(before)
        before = hashed[max(0, len(hashed) - overlap) :]


def cuts(data: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Parts of one text between words, of at most ``most`` bytes but for a longer word, which is a part of its own."""
    first, n = 0, len(data)
    while first < n:
        if n - first <= most:
            yield first, n
            return
        spaces = np.flatnonzero(TABLE[data[first : first + most]] == 0)
        if len(spaces):
            last = first + int(spaces[-1]) + 1
        else:
            last = first + most
            while last < n and not (found := np.flatnonzero(TABLE[data[last : last + most]] == 0)).size:
                last = min(n, last + most)
            last = last + int(found[0]) if last < n else n
        yield first, last
        first = last


def _digest(word: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")


def _whole(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    for k in np.flatnonzero(end - start > LONG_WORD):
        hashed[k] = _digest(data[start[k] : end[k]])
    return hashed


def runs(text: np.ndarray, word: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first, windows, fingerprint, content): the windows of all texts in runs that share their least gram.

    A window's fingerprint is the least hash of its ``GRAM``-word grams, the first of equal ones: equal
    windows have equal fingerprints. ``content`` is a hash of all words of the run's windows.
    """
    if len(word) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    gram = np.zeros(len(word) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        gram += word[k : k + len(gram)] * _ODD[k]
    gram = mixed(gram)
    best, width, span = np.arange(len(gram)), 1, window - GRAM + 1
    while width < span:
        step = min(width, span - width)
        a, b = best[:-step], best[step:]
        best, width = np.where(gram[b] < gram[a], b, a), width + step
    valid = text[: len(best)] == text[window - 1 :]
    new = np.ones(len(best) + 1, bool)
    new[1:-1] = (best[1:] != best[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & new[:-1])
    last = np.flatnonzero(valid & (new[1:] | ~np.append(valid[1:], False)))
    up, down = _POWERS(len(word))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * up)))
    content = mixed((sums[last + window] - sums[first]) * down[first]) ^ (last - first).astype(np.uint64)
    return first, last - first + 1, gram[best[first]], mixed(content)


RUN = "doc_id long, text_key long, at long, windows int, mark long, content long"


def candidate_runs(docs: DataFrame, window: int) -> DataFrame:
    """The runs of every document of ``doc_id, text_key, text``, ``at`` the number of their first word."""

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for a, b in groups(offsets):
                for text, word, number in word_hashes(data, offsets[a : b + 1], window - 1):
                    first, windows, mark, content = runs(text, word, window)
                    owner = text[first]
                    begin = np.searchsorted(text, np.arange(b - a))
                    rows = pa.array(owner + a)
                    columns = [ids.take(rows), keys.take(rows), pa.array(first - begin[owner] + number), pa.array(windows.astype(np.int32))]
                    columns += [pa.array(x.view(np.int64)) for x in (mark, content)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "at", "windows", "mark", "content"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, RUN)


REFERENCE = "mark long, content long, weight long, hot boolean, words binary"


def reference_runs(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words' hashes of one occurrence of each content in ``wanted``, a list of places per document."""
    places = F.collect_list(F.struct("at", "windows", "mark", "content", "weight", "hot")).alias("places")
    per_doc = wanted.groupBy("doc_id", "text_key").agg(places)
    joined = on_document(docs, per_doc, "inner").select("text", "places")

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in groups(offsets):
                rows = [sorted(x, key=lambda y: y["at"]) for x in batch.column("places").slice(a, b - a).to_pylist()]
                done = [0] * len(rows)
                out = []
                for text, word, number in word_hashes(data, offsets[a : b + 1], window - 1):
                    begin = np.searchsorted(text, np.arange(b - a + 1))
                    for k, places in enumerate(rows):
                        low, high = int(begin[k]) - number, int(begin[k + 1])
                        while done[k] < len(places):
                            p = places[done[k]]
                            first = low + p["at"]
                            last = first + p["windows"] + window - 1
                            if last > high:
                                break
                            out.append((p["mark"], p["content"], p["weight"], p["hot"], word[first:last].tobytes()))
                            done[k] += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                columns = list(zip(*out, strict=True)) or [[]] * 5
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["mark", "content", "weight", "hot", "words"])

    return joined.mapInArrow(run, REFERENCE)


class Automaton:
    """Suffix automaton of weighted word sequences; ``count`` is the weight of all places where a state's sequences end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, onward: dict) -> int:
        self.next.append(onward)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the sequences of ``p`` and ``c``, taken out of ``q`` if that holds longer ones too."""
        onward, link, length = self.next, self.link, self.length
        if length[q] == length[p] + 1:
            return q
        clone = self._state(length[p] + 1, link[q], dict(onward[q]))
        link[q] = clone
        while p >= 0 and onward[p].get(c) == q:
            onward[p][c] = clone
            p = link[p]
        return clone

    def add(self, sequence: list[int], weight: int) -> None:
        onward, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in sequence:
            q = onward[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                new, p = self._state(length[last] + 1, 0, {}), last
                while p >= 0 and c not in onward[p]:
                    onward[p][c] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, c, onward[p][c])
                last = new
            count[last] += weight

    def close(self) -> None:
        """Add up the weights along the links; after that no sequence is added."""
        link, count = self.link, self.count
        for state in np.argsort(-np.array(self.length), kind="stable").tolist()[:-1]:
            count[link[state]] += count[state]

    def matches(self, sequence: list[int], window: int) -> Iterator[tuple[int, int]]:
        """Matching statistics cut off at ``window``: for each place the length matched up to it, and that match's weight."""
        onward, link, length, count = self.next, self.link, self.length, self.count
        state = matched = 0
        for c in sequence:
            while state and c not in onward[state]:
                state = link[state]
                matched = length[state]
            if c in onward[state]:
                state = onward[state][c]
                matched += 1
            while state and length[link[state]] >= window:
                state = link[state]
            matched = min(matched, length[state])
            yield min(matched, window), count[state]


def shard_masks(reference: DataFrame, shards: int, window: int) -> DataFrame:
    """``mark, content, mask``: bit k is set if the k-th window of the content starts in two places or more.

    Contents under the same fingerprint share a shard of about ``SHARD_WORDS`` words. Its automaton
    holds them all, each with the number of its occurrences, and the contents are streamed through it.
    """
    dealt = reference.withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)))

    def run(table):
        automaton = Automaton()
        sequences = [np.frombuffer(x.as_buffer(), np.uint64).tolist() for x in table.column("words")]
        for sequence, weight in zip(sequences, table.column("weight").to_pylist(), strict=True):
            automaton.add(sequence, weight)
        automaton.close()
        masks = []
        for sequence in sequences:
            mask = 0
            for k, (matched, weight) in enumerate(automaton.matches(sequence, window)):
                if matched == window and weight >= 2:
                    mask |= 1 << k - window + 1
            masks.append(mask)
        return table.select(["mark", "content"]).append_column("mask", pa.array(masks, pa.int64()))

    return dealt.groupBy("shard").applyInArrow(run, "mark long, content long, mask long")


def single_masks(reference: DataFrame, window: int) -> DataFrame:
    """The same for fingerprints of very many contents: their windows are counted one by one, spread over all tasks."""

    def run(batches):
        for batch in batches:
            for mark, content, weight, sequence in zip(*(batch.column(c).to_pylist() for c in ("mark", "content", "weight", "words")), strict=True):
                names = [hashlib.blake2b(sequence[8 * k : 8 * (k + window)], digest_size=16).digest() for k in range(len(sequence) // 8 - window + 1)]
                same = lambda x: pa.array([x] * len(names), pa.int64())  # noqa: B023, E731
                columns = [same(mark), same(content), same(weight), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["mark", "content", "weight", "k", "name"])

    singles = reference.select("mark", "content", "weight", "words").mapInArrow(
        run, "mark long, content long, weight long, k int, name binary"
    )
    singles = staged(singles)
    often = singles.groupBy("name").agg(F.sum("weight").alias("total")).filter("total >= 2").select("name")
    bit = F.expr("shiftleft(1L, k)")
    return singles.join(often, "name").groupBy("mark", "content").agg(F.bit_or(bit).alias("mask"))


def on_document(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    found = found.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    same = docs["doc_id"].eqNullSafe(found["__id"]) & (docs["text_key"] == found["__key"])
    return docs.join(found, same, how).drop("__id", "__key")


def repeated_runs(docs: DataFrame, window: int = WINDOW, most: int = MOST_CONTENTS) -> DataFrame:
    """``doc_id, text_key, marks``: the places of each document's windows whose word sequence starts in two places or more.

    1. Windows fall into runs by fingerprint, about one in fourteen words. A fingerprint that occurs once
       holds no repeated window, and all occurrences of a window lie in runs of its fingerprint.
    2. Of the runs of repeated fingerprints each content is read once more, with the number of its
       occurrences, and goes to the shard of its fingerprint.
    3. The automata say which windows of each content repeat; the answers go back to all its occurrences.
    """
    found = staged(candidate_runs(docs, window))
    often = found.groupBy("mark").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("mark")
    often = staged(often)  # counted apart from the join, which can then split a frequent fingerprint
    hits = staged(found.join(often, "mark"))
    dropped(found)
    one = [F.first(c).alias(c) for c in ("doc_id", "text_key", "at", "windows")]
    contents = staged(hits.groupBy("mark", "content").agg(F.count(F.lit(1)).alias("weight"), *one))
    hot = contents.groupBy("mark").agg(F.count(F.lit(1)).alias("contents")).filter(F.col("contents") > most)
    hot = staged(hot.select("mark", F.lit(True).alias("hot")))
    wanted = contents.join(hot, "mark", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    reference = staged(reference_runs(docs, wanted, window))
    dropped(contents)
    total = reference.filter("NOT hot").agg(F.sum(F.octet_length("words")) / 8).first()[0]
    masks = shard_masks(reference.filter("NOT hot"), max(1, ceil((total or 0) / SHARD_WORDS)), window)
    if not hot.isEmpty():
        masks = masks.unionByName(single_masks(reference.filter("hot"), window))
    masks = staged(masks.filter("mask <> 0"))
    dropped(reference)
    marked = hits.join(masks, ["mark", "content"])
    return marked.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "mask")).alias("marks"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, spans, kept_text``.

    A word goes if it lies in ``window`` consecutive words whose sequence also starts anywhere else. ``spans``
    are the maximal removed ranges of words, ``start`` included and ``end`` not; ``kept_text`` is the rest,
    joined by single spaces. Words are unchanged runs of characters other than ASCII white space.

    Null and empty texts have no words and an empty ``kept_text``; texts shorter than the window keep all.
    Repeated rows are copies of each other, so both lose what they share, as do rows with null ids.
    Other columns are ignored; an empty table gives no rows.
    """
    if not GRAM < window <= GRAM + 62:
        raise ValueError("window must be 9 to 70 words")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    bounded_batches(docs.sparkSession)
    marks = staged(repeated_runs(docs, window))

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, marks in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("marks"), strict=True):
                spans = removed_spans(marks, window)
                total, kept = without(np.frombuffer(text.as_buffer(), np.uint8), spans)
                out.append((doc, total, int((spans[:, 1] - spans[:, 0]).sum()), [{"start": a, "end": b} for a, b in spans.tolist()], kept))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    joined = on_document(docs, marks, "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(
        run, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_text string"
    )


def removed_spans(marks: pa.Scalar, window: int) -> np.ndarray:
    """(start, end) of the unions of the windows in ``marks``, in order."""
    if not marks.is_valid:
        return np.zeros((0, 2), np.int64)
    at, mask = (marks.values.field(k).to_numpy() for k in (0, 1))
    bits = np.unpackbits(np.ascontiguousarray(mask).view(np.uint8).reshape(len(mask), 8), axis=1, bitorder="little")
    row, k = np.nonzero(bits)
    start = np.unique(at[row] + k)
    new = np.concatenate(([True], start[1:] > start[:-1] + window))
    first = np.flatnonzero(new)
    return np.stack((start[first], start[np.append(first[1:], len(start)) - 1] + window), 1)


def without(text: np.ndarray, spans: np.ndarray) -> tuple[int, str]:
    """The number of words, and the words outside ``spans``, joined; long texts go part by part."""
    total, kept = 0, []
    for low, high in cuts(text):
        found = text[low:high].tobytes().split()
        inside = spans[(spans[:, 1] > total) & (spans[:, 0] < total + len(found))] - total
        if len(inside):
            ends = np.clip(inside, 0, len(found)).reshape(-1).tolist()
            left = []
            for a, b in zip([0, *ends[1::2]], [*ends[::2], len(found)], strict=True):
                left += found[a:b]
        else:
            left = found
        if left:
            kept.append(b" ".join(left))
        total += len(found)
    return total, b" ".join(kept).decode()
