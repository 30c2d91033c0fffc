import random
import zlib
from collections import Counter

import pytest

from floorledger.llm.sharding import admission, place, propagate, shard_documents

SCHEMA = "doc_id long, text string, shard string"


def corpus(n=600, hot=0.0):
    pick = random.Random(3)
    rows = [(k, "the hot text" if pick.random() < hot else f"text {k if pick.random() < 0.7 else k // 3}", "clash") for k in range(n)]
    return rows + [(n, None, None), (n + 1, "", None), (n + 2, None, None), (None, "x", None), (0, rows[0][1], None), (n + 3, "é" * 9000, None)]


@pytest.mark.parametrize("hot", [0.0, 0.35])
def test_counts_slots_and_groups(spark, hot):
    rows, shards = corpus(hot=hot), 8
    got = shard_documents(spark.createDataFrame(rows, SCHEMA), shards).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 16, crc(t)) for d, t, _ in rows)
    by = {}
    for r in got:
        assert (r["law"], r["grown_shard"]) == ("rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    texts = {}
    for r in got:
        texts.setdefault(r["text_crc32"], set()).add(r["shard"])
    counts = Counter(crc(t) for _, t, _ in rows)
    cut = sum(len(texts[c]) - -(-n // max(sizes)) for c, n in counts.items() if n > 1)
    linked = sum(1 for n in counts.values() if n > 1)
    assert cut <= 0.1 * linked + 2


def test_fewer_rows_than_shards_and_none(spark):
    got = shard_documents(spark.createDataFrame([(1, "a", None), (2, "a", None)], SCHEMA), 40).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (1, 0)]
    assert shard_documents(spark.createDataFrame([], SCHEMA), 40).count() == 0


def spread(sizes):
    """Rows of groups of these sizes."""
    return [(k, f"text {g}", None) for k, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]


@pytest.mark.parametrize(
    "sizes, cut",
    [
        ([2] * 400, 0),  # every row has a copy and no shard has room
        ([10] * 64 + [1] * 160, 0),
        ([60] * 8 + [2] * 120 + [1] * 80, 0),  # the large ones need the place of small ones
        ([70] * 9 + [2] * 85, 1),  # one large group more than shards
    ],
)
def test_groups_are_whole_when_most_rows_have_copies(spark, sizes, cut):
    got = shard_documents(spark.createDataFrame(spread(sizes), SCHEMA), 8, rounds=8).collect()
    rows = Counter(r["shard"] for r in got)
    assert len(got) == sum(sizes) and set(rows.values()) == {100}
    assert Counter((r["shard"], r["slot"]) for r in got) == Counter((s, k) for s in range(8) for k in range(100))
    texts = {}
    for r in got:
        texts.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(x) > 1 for x in texts.values()) == cut


def test_place_fits_targets_and_moves_each_group_once():
    pick = random.Random(4)
    for _ in range(200):
        pieces = {(pick.randrange(-1, 5), pick.choice([2, 3, 7, 20, 55])): pick.randrange(1, 9) for _ in range(12)}
        total = sum(z * n for (_, z), n in pieces.items())
        targets = [total // 5 + (k < total % 5) for k in range(5)]
        held, seen, cut = Counter(), set(), []
        for (s, z), n in pieces.items():
            held[s] += z * n
        for s, z, first, last, to, broken in place(pieces, targets):
            for k in range(first, last):
                assert (s, z, k) not in seen and k < pieces[s, z]
                seen.add((s, z, k))
            held[s] -= z * (last - first)
            if broken:
                cut.append(z)
            else:
                held[to] += z * (last - first)
        assert held[-1] == 0 and all(held[s] <= targets[s] for s in range(5))
        assert len(cut) <= 5


def test_full_shards_exchange_rows_and_nothing_enters_beyond_that():
    assert admission([[0, 9], [9, 0]], [0, 0]) == [1.0, 1.0]
    assert admission([[0, 6], [12, 0]], [0, 0]) == pytest.approx([0.5, 1.0])
    assert admission([[0, 5], [0, 0]], [0, 0])[1] == 0.0


def started(spark, sizes, shards, seed=0):
    """Rows of groups of these sizes, dealt to shards in equal numbers: the groups' rows and the shards' quota."""
    pick = random.Random(seed)
    places = [k % shards for k in range(sum(sizes))]
    pick.shuffle(places)
    groups = [g for g, n in enumerate(sizes) for _ in range(n)]
    rows = [(g, s) for g, s in zip(groups, places, strict=True) if sizes[g] > 1]
    return spark.createDataFrame(rows, "group long, shard int"), -(-sum(sizes) // shards)


def whole(rows):
    at = {}
    for r in rows.collect():
        at.setdefault(r["group"], set()).add(r["shard"])
    return sum(len(x) == 1 for x in at.values()) / len(at)


@pytest.mark.parametrize("sizes", [[2] * 400, [10] * 64 + [1] * 160])
def test_propagation_alone_makes_groups_whole(spark, sizes):
    rows, quota = started(spark, sizes, 8)
    before = whole(rows)
    out, _ = propagate(rows, [quota] * 8, 40)
    assert before < 0.2 and whole(out) >= 0.95
    load = Counter(r["shard"] for r in out.collect())
    assert max(load.values()) <= quota * 1.15


def test_without_rounds_groups_stay_apart(spark):
    docs = spark.createDataFrame(spread([4] * 60 + [1] * 160), SCHEMA)
    cut = []
    for rounds in (0, 10):
        texts = {}
        for r in shard_documents(docs, 8, rounds=rounds).collect():
            texts.setdefault(r["text_crc32"], set()).add(r["shard"])
        cut.append(sum(len(x) > 1 for x in texts.values()))
    assert cut[0] > 50 and cut[1] == 0


def least_cut(sizes, shards):
    """The smallest number of groups in several shards, over all ways to fill shards of equal sizes."""
    total = sum(sizes)
    targets = tuple(total // shards + (k < total % shards) for k in range(shards))
    linked = sorted((z for z in sizes if z > 1), reverse=True)
    best = len(linked)

    def search(k, free, cut):
        nonlocal best
        if cut >= best:
            return
        if k == len(linked):
            best = cut
            return
        for s in set(free):
            if s >= linked[k]:
                left = list(free)
                left[left.index(s)] -= linked[k]
                search(k + 1, tuple(sorted(left)), cut)
        # a cut group fills what is left: it may go anywhere in parts, so it is placed last
        search(k + 1, free, cut + 1)

    search(0, tuple(sorted(targets)), 0)
    return best


@pytest.mark.parametrize("seed", range(10))
def test_cut_is_near_the_least_on_small_graphs(spark, seed):
    pick = random.Random(seed)
    sizes = [pick.choice([1, 1, 2, 2, 3, 4, 5]) for _ in range(pick.randrange(8, 14))]
    got = shard_documents(spark.createDataFrame(spread(sizes), SCHEMA), 3, rounds=6).collect()
    texts = {}
    for r in got:
        texts.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(x) > 1 for x in texts.values()) <= least_cut(sizes, 3) + 1
