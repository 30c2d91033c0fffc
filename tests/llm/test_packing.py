import random
import zlib
from collections import Counter

import numpy as np
import pytest

from floorledger.llm.packing import Encoder, Places, _pair, pack, two_fit
from floorledger.llm.queries import tokenizer_path

ROWS = [(1, "hello world"), (2, ""), (3, None), (4, "x " * 3000), (4, "x " * 3000), (None, "a b"), (6, "y" * 90), (7, " \n\n  z")]
ROWS += [(100 + k, "word " * (k % 37)) for k in range(200)]


def texts():
    pick = random.Random(11)
    marks = ["<|endoftext|>", "<|endoftext", "|>", " <|endoftext|> ", "<|endoftext|><|endoftext|>"]
    ranges = [(32, 127), (0, 32), (160, 600), (0x3000, 0x3100), (0x1F600, 0x1F650), (0x2028, 0x2030), (0x660, 0x66A)]
    for _ in range(400):
        parts = ["".join(chr(pick.randrange(*pick.choice(ranges))) for _ in range(pick.randrange(1, 12))) for _ in range(pick.randrange(1, 9))]
        yield pick.choice(["", " ", "\n"]).join(pick.choice([x, x, x, pick.choice(marks)]) for x in parts)
    yield from ["", " ", "a  b", "it's I'll  ", "<|endoftext|>", "a <|endoftext|> b", "é ß\t\r\n 日本 😀 ²½ ١", "\x00\x1c\x85　"]
    yield from ["A" * 5000, "\n" * 70, "a" * 100_000, "word <|endoftext|>" * 2000]


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    encode = Encoder(tokenizer_path())
    assert encode.encoding is not None
    assert np.frombuffer(encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    for t in texts():
        assert encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(encode("\n" * 1_000_000)) > 0


def test_other_tokenizer_files_go_through_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    settings = json.loads(Tokenizer.from_file(tokenizer_path()).to_str())
    for change in ({"pre_tokenizer": {**settings["pre_tokenizer"], "add_prefix_space": True}}, {"normalizer": {"type": "Lowercase"}}):
        path = str(tmp_path / "other.json")
        with open(path, "w") as file:
            json.dump({**settings, **change}, file)
        plain, encode = Tokenizer.from_file(path), Encoder(path)
        assert encode.encoding is None
        for t in list(texts())[:60]:
            assert encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_id_is_placed_once_and_sequences_have_no_gap(spark):
    capacity = 64
    got = pack(spark.createDataFrame(ROWS, "doc_id long, text string"), tokenizer_path(), capacity).collect()
    encode = Encoder(tokenizer_path())
    whole = [(d, encode(t or "") + b"\0\0\0\0") for d, t in ROWS]
    want = Counter()
    for doc, ids in whole:
        n, first = len(ids) // 4, (len(ids) // 4) % capacity or capacity
        starts = [0, *range(first, n, capacity)]
        for k, s in enumerate(starts):
            e = starts[k + 1] if k + 1 < len(starts) else n
            want[doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // capacity) + 1


def test_columns_of_the_same_names_are_ignored(spark):
    rows = [(d, t, "q", 7, 8, 9) for d, t in ROWS[:20]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int, n int, before int")
    plain = pack(spark.createDataFrame(ROWS[:20], "doc_id long, text string"), tokenizer_path(), 64)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, pack(frame, tokenizer_path(), 64).select(*key).collect())) == sorted(map(str, plain.select(*key).collect()))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def brute_pair(left, gap):
    items = [x for x in range(len(left)) for _ in range(min(2, left[x]))]
    sums = [(a + b, max(a, b), min(a, b)) for i, a in enumerate(items) for b in items[:i] if a + b <= gap]
    return max(sums)[0] if sums else None


def test_two_replacements_are_the_tightest():
    random = np.random.default_rng(0)
    for _ in range(300):
        left = random.integers(0, 3, 20) * (random.random(20) < 0.3)
        left[0] = 0
        gap = int(random.integers(1, 19))
        found = _pair(left, gap)
        assert (sum(found) if found else None) == brute_pair(left, gap)


def least_bins(counts, capacity):
    """The bound of Martello and Toth: pieces above half cannot share a bin, the others fill what is left."""
    x, best = np.repeat(np.arange(len(counts)), counts), 0
    for k in range(capacity // 2 + 1):
        alone, large = x[x > capacity - k], x[(x <= capacity - k) & (2 * x > capacity)]
        small = x[(2 * x <= capacity) & (x >= k)]
        rest = small.sum() - (len(large) * capacity - large.sum())
        best = max(best, len(alone) + len(large) + max(0, -(-rest // capacity)))
    return best


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_and_few_bins(seed):
    random = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    np.add.at(counts, random.integers(1, 101, 3000), 1)
    bins = two_fit(counts, 100)
    used = np.zeros_like(counts)
    for times, lengths in bins:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += times
    assert (used == counts).all()
    assert sum(t for t, _ in bins) <= 1.003 * least_bins(counts, 100) + 1
    places = Places(bins)
    seen = set()
    for length in np.flatnonzero(counts):
        n = np.arange(counts[length])
        sequence, offset = places(np.full(len(n), length), n)
        seen |= {(s, o + k) for s, o in zip(sequence.tolist(), offset.tolist()) for k in range(length)}
    assert len(seen) == int((counts * np.arange(101)).sum())


def test_the_smallest_piece_goes_back_for_two_that_fit_better():
    # 70 takes 25 first and leaves 5; 25 goes back for 16 and 14
    counts = np.zeros(101, np.int64)
    counts[[70, 25, 16, 14]] = 1
    assert two_fit(counts, 100)[0] == (1, [70, 16, 14])
