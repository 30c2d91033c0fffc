"""Best-two-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import bounded_batches, numbered, staged, unit_hash

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLACES = f"{PIECES}, sequence_id long, offset int"
#: Fixed value: how the ``ByteLevel`` step of a tokenizer file cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as ``tokenizers`` gives them without special tokens around.

    Strings of added tokens inside a text become those tokens. If ``path`` is the file of a plain
    byte-level BPE whose ids are in the order of its merges, texts without such strings are run by
    ``tiktoken``, which gives the same ids at several times the speed on the texts of a corpus, where
    most words are rare. It gives up on a run of white space of about a million characters; such texts,
    and all texts of any other kind of file, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.encoding = self._fast() if self._plain() else None

    def _plain(self) -> bool:
        """Whether the vocabulary alone decides the ids of a text without added tokens."""
        whole, step, model = self.tokenizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        if whole.normalizer or whole.truncation or whole.padding or step is None:
            return False
        step = json.loads(step.__getstate__())
        bytewise = step["type"] == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex")
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        return bool(bytewise and type(model).__name__ == "BPE" and not any(getattr(model, k) for k in odd))

    def _fast(self):
        import tiktoken

        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # a byte is written as its own character if that is printable, else as one from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in vocabulary.items() if all(c in byte for c in token)}
        if set(ranks.values()) != set(range(len(vocabulary) - sum(x in vocabulary for x in self.added))):
            return None
        return tiktoken.Encoding("vocabulary", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        ids = None
        if self.encoding and not any(x in text for x in self.added):
            try:
                ids = self.encoding.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        if ids is None:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return ids.astype("<u4").tobytes()


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document; only the first may be shorter than the capacity."""
    total, start = len(ids) // 4, 0
    while start < total:
        length = (total - start) % capacity or capacity
        yield start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start += length


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        encode = Encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(*batch.to_pydict().values(), strict=True):
                ids = encode(text or "") + b"\0\0\0\0"
                rows += [(doc, k, *x) for k, x in enumerate(cut(ids, capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Bins as (how many, lengths) for ``counts[length]`` pieces: as many alike bins at once as the counts allow.

    A bin takes the longest piece left, then ever the longest that fits. Its smallest piece then goes
    back if two others fit the widened gap more tightly. At least one length runs out with each kind
    of bin, so there are at most as many kinds as lengths.
    """
    left, bins = counts.astype(np.int64).copy(), []
    while left.any():
        some = np.flatnonzero(left)
        lengths, gap = [int(some[-1])], capacity - int(some[-1])
        taken = np.zeros_like(left)
        taken[lengths[0]] += 1
        while gap:
            fits = np.flatnonzero(left[: gap + 1] > taken[: gap + 1])
            if not len(fits):
                break
            lengths.append(int(fits[-1]))
            taken[lengths[-1]] += 1
            gap -= lengths[-1]
        if gap and len(lengths) > 1:
            smallest = lengths[-1]
            taken[smallest] -= 1
            best = _pair(left - taken, gap + smallest)
            if best and sum(best) > smallest:
                lengths[-1:] = best
                for x in best:
                    taken[x] += 1
            else:
                taken[smallest] += 1
        used = np.flatnonzero(taken)
        times = int((left[used] // taken[used]).min())
        left[used] -= times * taken[used]
        bins.append((times, sorted(lengths, reverse=True)))
    return bins


def _pair(left: np.ndarray, gap: int) -> list[int] | None:
    """The two pieces left with the largest sum within ``gap``."""
    have = np.flatnonzero(left[: gap + 1] > 0)
    if not len(have):
        return None
    # for each a, the longest b <= gap - a that is there (twice, if it is a itself)
    at = np.searchsorted(have, gap - have, side="right") - 1
    ok = at >= 0
    b = np.where(ok, have[np.maximum(at, 0)], 0)
    single = ok & (b == have) & (left[have] < 2)
    at = np.where(single, at - 1, at)
    ok &= at >= 0
    if not ok.any():
        return None
    b = np.where(ok, have[np.maximum(at, 0)], 0)
    k = int(np.argmax(np.where(ok, have + b, -1)))
    return sorted((int(have[k]), int(b[k])), reverse=True)


class Places:
    """Where the n-th piece of a length goes: intervals of n, each of one kind of bin."""

    def __init__(self, bins: list[tuple[int, list[int]]]):
        self.by: dict[int, list] = {}
        seen: dict[int, int] = {}
        first = 0
        for times, lengths in bins:
            offset = 0
            for length in lengths:
                self.by.setdefault(length, []).append((seen.get(length, 0), first, offset))
                seen[length] = seen.get(length, 0) + times
                offset += length
            first += times
        self.by = {k: np.array(v, np.int64) for k, v in self.by.items()}
        self.sequences = first

    def __call__(self, length: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int32)
        for one in np.unique(length):
            rows, x = np.flatnonzero(length == one), self.by[int(one)]
            k = np.searchsorted(x[:, 0], n[rows], side="right") - 1
            sequence[rows], offset[rows] = x[k, 1] + n[rows] - x[k, 0], x[k, 2]
        return sequence, offset


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and one 0. Only documents above the capacity are cut, the remainder first.
    The plan is made from the number of pieces of each length, at most ``capacity`` numbers whatever
    the size of the corpus; each piece finds its place from its number among the pieces of its length.

    Null and empty texts are documents of the one closing id. Repeated rows and null ids are pieces
    like any other. Other columns are ignored; an empty table gives no rows.
    """
    rows = staged(pieces(docs, tokenizer, capacity, id_col, text_col))
    rows = rows.withColumn("__order", unit_hash("doc_id", "piece"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    places = Places(two_fit(counts, capacity))

    def run(batches):
        for batch in batches:
            n, length = batch.column("n").to_numpy(), batch.column("length").to_numpy()
            sequence, offset = places(length, n)
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    placed = numbered(rows, ["length"], "__order", int(counts.sum()), ties=["doc_id", "piece", "ids_crc32"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "n").mapInArrow(run, PLACES)
