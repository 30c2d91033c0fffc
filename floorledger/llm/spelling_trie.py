"""Spelling variants: a frontier of (word, position, node, edits) states walks a distributed trie of all words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import bounded_batches, dropped, staged
from floorledger.llm.textarrays import mixed

LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
#: Fixed value: what a run of letters is.
LETTERS = "A-Za-zÀ-ÿ"
PART = 1 << 20
HELD_WORDS = 200_000
WORDS_PER_BATCH = 20_000
_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A long text in parts that end between runs of letters."""
    inside = re.compile(f"[^{LETTERS}]")
    first = 0
    while first < len(text):
        last = first + size
        if last < len(text):
            stop = inside.search(text, last)
            last = stop.start() if stop else len(text)
        yield text[first:last] if first or last < len(text) else text
        first = last


def damaged(word: str, crc: int, every: int) -> str:
    """``word`` without one code point where ``every`` divides the hash."""
    if crc % every:
        return word
    k = crc % len(word)
    return word[:k] + word[k + 1 :]


def vocabulary(docs: DataFrame, every: int = 31) -> DataFrame:
    """``word, n``: how often each word of at least ``LEAST_LENGTH`` code points occurs in ``doc_id, text``.

    A word is a run of letters, A-Z lower-cased, from which a hash of document and run takes a code
    point now and then. Words are counted per document and per task before they are shuffled.
    """
    runs = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if not text:
                    continue
                before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                found: Counter = Counter()
                for part in parts(text):
                    found.update(runs.findall(part))
                for raw, n in found.items():
                    word = raw.lower() if raw.isascii() else raw.translate(_LOWER)
                    word = damaged(word, zlib.crc32(word.encode(), before), every)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    bounded_batches(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def symbols(words: pa.Array, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets): each word, reversed if so wished, and a closing 0."""
    text = words.to_pylist()
    length = np.array([len(w) for w in text], np.int64)
    offsets = np.concatenate(([0], np.cumsum(length + 1)))
    joined = "".join((w[::-1] if reverse else w) + "\0" for w in text)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64), offsets


def symbol_hash(symbol: np.ndarray, depth: np.ndarray, side: int) -> np.ndarray:
    """The share of a symbol at a depth in the name of a node; a node is named by the XOR of its path's."""
    turn = depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03 + side)
    return mixed(mixed(symbol + np.uint64(1)) + turn)


class Walk:
    """Names of nodes along the paths of words, for the positions in the later half of each.

    The edit that parts two words leaves a common beginning or a common end of at least half the
    length, so it is looked for in the later half only, in the words and in the reversed words.
    """

    def __init__(self, words: pa.Array, side: int):
        self.code, offsets = symbols(words, reverse=side == 1)
        start, self.length = offsets[:-1], np.diff(offsets) - 1
        depth = np.arange(len(self.code)) - np.repeat(start, self.length + 1)
        self.own = symbol_hash(self.code, depth, side)
        early = symbol_hash(self.code, np.maximum(depth - 1, 0), side)  # one place earlier: after a deletion
        self.sums, self.early = _running(self.own), _running(early)
        self.first, self.last = start, start + self.length + 1

    def places(self, most: int = 1 << 20) -> Iterator[Places]:
        """The positions of all words, so many at a time: words may be long."""
        rows = self.length - self.length // 2
        ends = np.cumsum(rows)
        for low in range(0, int(ends[-1]) if len(ends) else 0, most):
            k = np.arange(low, min(low + most, int(ends[-1])))
            word = np.searchsorted(ends, k, side="right")
            yield Places(self, word, k - (ends - rows)[word] + (self.length // 2)[word])


class Places:
    """``position`` of ``word``: ``at`` is its place among all symbols, ``end`` the place after the word's closing 0."""

    def __init__(self, walk: Walk, word: np.ndarray, position: np.ndarray):
        self.walk, self.word, self.position = walk, word, position
        self.at, self.end = walk.first[word] + position, walk.last[word]

    def filter(self, keep: np.ndarray) -> Places:
        return Places(self.walk, self.word[keep], self.position[keep])

    def node(self, stop: np.ndarray) -> np.ndarray:
        """The node of the word's own path before place ``stop``, its terminal at the latest."""
        return self.walk.sums[np.minimum(stop, self.end)] ^ self.walk.sums[self.walk.first[self.word]]

    def node_without(self, stop: np.ndarray) -> np.ndarray:
        """The same on the path that leaves out the symbol at the position."""
        rest = self.walk.early[np.minimum(stop, self.end)] ^ self.walk.early[self.at + 1]
        return self.node(self.at) ^ rest

    def stops(self, first: int) -> list[np.ndarray]:
        """Where states stop after ``first`` symbols: 2, 4, 8 ... further on, short of the end."""
        out, ahead = [], 2
        while len(self.at) and (self.at + first + ahead < self.end).any():
            out.append(self.at + first + ahead)
            ahead = ahead * 2 + 2
        return out


def _running(shares: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(shares)))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _ahead(stops: list[np.ndarray], names: list[np.ndarray], end: np.ndarray) -> pa.Array:
    """One list per state: the names at those stops that come before the word's end."""
    if not stops:
        return pa.array([[]] * len(end), pa.list_(pa.int64()))
    use = np.stack([x < end for x in stops], 1)
    values = np.stack(names, 1)[use]
    cuts = np.concatenate(([0], np.cumsum(use.sum(1)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), _longs(values))


def edges(words: DataFrame) -> DataFrame:
    """The trie's edge table, for both directions: ``gap, step, node``, a row per word and position in its later half.

    ``node`` is the node two symbols below the position; ``gap`` names the path to it but for the symbol at
    the position, whose share is ``step``: edges that differ in that symbol alone have the same ``gap``.
    """

    def run(batches):
        for batch in batches:
            for side in (0, 1):
                for at in Walk(batch.column("word"), side).places():
                    node, step = at.node(at.at + 2), at.walk.own[at.at]
                    yield pa.RecordBatch.from_arrays([_longs(node ^ step), _longs(step), _longs(node)], ["gap", "step", "node"])

    return words.select("word").mapInArrow(run, "gap long, step long, node long")


STATE = "word long, position int, node long, last long, ahead array<long>"


def deletions(words: DataFrame) -> DataFrame:
    """States after one deletion: ``node`` two symbols on, ``ahead`` the nodes to come, ``last`` the terminal.

    Of a run of equal code points only the last is deleted.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for side in (0, 1):
                for at in Walk(batch.column("word"), side).places():
                    at = at.filter(at.walk.code[at.at] != at.walk.code[at.at + 1])
                    stops = at.stops(3)
                    columns = [pa.array(ids[at.word]), pa.array(at.position.astype(np.int32))]
                    columns += [_longs(at.node_without(at.at + 3)), _longs(at.node_without(at.end))]
                    columns += [_ahead(stops, [at.node_without(x) for x in stops], at.end)]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "position", "node", "last", "ahead"])

    return words.select("id", "word").mapInArrow(run, STATE)


def untouched(words: DataFrame) -> DataFrame:
    """States without an edit: ``gap`` and ``step`` as in the edge table, ``last`` and ``ahead`` of the word's own path."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for side in (0, 1):
                for at in Walk(batch.column("word"), side).places():
                    step, stops = at.walk.own[at.at], at.stops(2)
                    columns = [pa.array(ids[at.word]), pa.array(at.position.astype(np.int32))]
                    columns += [_longs(at.node(at.at + 2) ^ step), _longs(step), _longs(at.node(at.end))]
                    columns += [_ahead(stops, [at.node(x) for x in stops], at.end)]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "position", "gap", "step", "last", "ahead"])

    return words.select("id", "word").mapInArrow(run, "word long, position int, gap long, step long, last long, ahead array<long>")


def replacements(words: DataFrame, table: DataFrame) -> DataFrame:
    """States after one replacement: the other edges over the same gap. Each pair of edges is taken from one side only."""
    forks = table.groupBy("gap").agg(F.min("step").alias("x"), F.max("step").alias("y")).filter("x < y").select("gap")
    forks = staged(forks)
    others = table.join(forks, "gap").select("gap", F.col("step").alias("other")).distinct()
    both = untouched(words).join(others, "gap").filter("step < other")
    turn = F.col("step").bitwiseXOR(F.col("other"))
    return both.select(
        "word",
        "position",
        F.col("gap").bitwiseXOR(F.col("other")).alias("node"),
        F.col("last").bitwiseXOR(turn).alias("last"),
        F.transform("ahead", lambda x: x.bitwiseXOR(turn)).alias("ahead"),
    )


def neighbours(words: DataFrame) -> DataFrame:
    """``a, b``: the pairs of ``id, word`` that one inserted, deleted or replaced code point parts, each once.

    The states without an edit stand on their word's own path; one edit takes them off it, by deletion
    or over another edge. The frontier then goes down level by level: a state lives on if its node is in
    the table of nodes. Steps double after the first, so words of any length take few rounds. The
    states that reach a terminal name a pair, which the words themselves confirm. Insertions are the
    deletions of the longer word.
    """
    table = staged(edges(words))
    nodes = staged(table.select("node").distinct())
    frontier = deletions(words).join(nodes, "node", "left_semi")
    frontier = staged(frontier.unionByName(replacements(words, table)).select("word", "position", "node", "last", "ahead"))
    dropped(table)
    while True:
        moving = frontier.filter(F.size("ahead") > 0)
        if moving.isEmpty():
            break
        moving = moving.withColumn("node", F.get("ahead", F.lit(0))).join(nodes, "node", "left_semi")
        moving = moving.withColumn("ahead", F.slice("ahead", 2, F.greatest(F.size("ahead") - 1, F.lit(0))))
        arrived = frontier.filter(F.size("ahead") == 0)
        after = staged(moving.select(*frontier.columns).unionByName(arrived))
        dropped(frontier)
        frontier = after
    terminals = terminal_names(words)
    pairs = frontier.select(F.col("word").alias("x"), "last").join(terminals, "last").filter("x <> id")
    pairs = pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
    named = pairs.join(words.select(F.col("id").alias("a"), F.col("word").alias("word_a")), "a")
    named = named.join(words.select(F.col("id").alias("b"), F.col("word").alias("word_b")), "b")
    return named.filter(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def terminal_names(words: DataFrame) -> DataFrame:
    """``last, id``: the terminal of each word, in both directions."""

    def run(batches):
        for batch in batches:
            for side in (0, 1):
                code, offsets = symbols(batch.column("word"), reverse=side == 1)
                depth = np.arange(len(code)) - np.repeat(offsets[:-1], np.diff(offsets))
                sums = _running(symbol_hash(code, depth, side))
                yield pa.RecordBatch.from_arrays([_longs(sums[offsets[1:]] ^ sums[offsets[:-1]]), batch.column("id")], ["last", "id"])

    return words.select("id", "word").mapInArrow(run, "last long, id long")


def spelling_variants(docs: DataFrame, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``n`` counts the word, ``n_near`` the words one edit away. ``form`` is the most frequent of these (of
    equally frequent ones the first in code-point order) if it is ten times as frequent; ``root`` is
    where the forms lead, the word itself if it has none. Forms grow tenfold, so chains are short.

    Null and empty texts hold no words; a null id counts as an empty string in the hash that takes code
    points away. Repeated rows count each time. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = staged(vocabulary(docs, every).withColumn("id", F.monotonically_increasing_id()))
    bounded_batches(docs.sparkSession, rows=WORDS_PER_BATCH, size="1m")
    pairs = staged(neighbours(words))
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = links.join(words.select(F.col("id").alias("b"), F.col("word").alias("other"), F.col("n").alias("m")), "b")
    best = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other", "b")).alias("best"))
    best = best.select("a", "n_near", (-F.col("best.m")).alias("m"), "best.other", "best.b")
    found = words.join(best, words["id"] == best["a"], "left")
    has = F.col("m") >= FORM_FACTOR * F.col("n")
    found = staged(
        found.select(
            "id",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has, F.col("other")).alias("form"),
            F.when(has, F.col("m")).alias("form_n"),
            F.when(has, F.col("b")).alias("to"),
        )
    )
    ends = roots(found)
    named = ends.join(words.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    out = found.join(named, "id", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def roots(found: DataFrame) -> DataFrame:
    """``id, to``: the end of the chain of each ``id`` with a ``to``; the distance covered doubles with each round."""
    now = staged(found.filter("to IS NOT NULL").select("id", "to"))
    while True:
        onward = now.select(F.col("id").alias("to"), F.col("to").alias("next"))
        if now.join(onward, "to", "left_semi").isEmpty():
            return now
        after = staged(now.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        dropped(now)
        now = after
