import random
import re

import numpy as np

from floorledger.llm import minhash_dedup
from floorledger.llm.minhash_dedup import Banding, keep_one, near_dedup, shingle_sets, sketches

SCHEMA = "doc_id long, text string, kept string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def corpus():
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randrange(1, 6)))
    common = [word() for _ in range(30)]
    rows, k = [], 0
    for _ in range(60):
        base = [word() for _ in range(pick.randrange(8, 150))] + (common if pick.random() < 0.5 else [])
        for _ in range(pick.choice([1, 1, 2, 3, 12])):
            copy = list(base)
            for _ in range(pick.randrange(0, 4)):
                at = pick.randrange(len(copy))
                copy[at : at + pick.randrange(0, 2)] = [word()]
            sep = pick.choice([" ", "\n", "  "])
            rows.append((k, sep.join(w.upper() if pick.random() < 0.1 else w for w in copy), None))
            k += 1
    rows += [(k, None, None), (k + 1, "", None), (k + 2, " \n", None), (k + 3, "one two", None), (k + 4, "One  two", None), (k + 5, "two one", None)]
    rows += [(7, rows[7][1], None), (7, rows[7][1], None), (None, rows[9][1], None), (None, "only here", None), (k + 6, "w " * 40_000, None), (k + 7, "w w w w w", None)]
    pick.shuffle(rows)
    return rows


def brute(rows, percent=85):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return [(d, len(sets[i]), ids.get(root(i)), d == ids.get(root(i))) for i, (d, _, _) in enumerate(rows)]


def test_components_are_those_of_brute_force(spark):
    rows = corpus()
    got = near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_one_document_of_each_group_is_kept(spark):
    rows = corpus()
    got = keep_one(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "kept"]
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in brute(rows) if r[3]}


def test_the_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    assert sorted(map(tuple, near_dedup(docs).collect())) == sorted(brute(rows))


def test_empty_table(spark):
    assert near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_share_of_equal_bins_estimates_the_similarity():
    pick = np.random.default_rng(5)
    for n, common in ((400, 360), (400, 200), (40, 36), (6, 5)):
        errors = []
        for _ in range(60):
            values = pick.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            a, b = values[:n], values[n - common :]
            owner = np.repeat([0, 1], [n, n])
            table = sketches(owner, np.concatenate((a, b)), 2, Banding().bins)
            errors.append((table[0] == table[1]).mean() - common / (2 * n - common))
        assert abs(np.mean(errors)) < 0.06


def test_shingles_of_short_and_long_texts():
    texts = [b"a b c d e f", b"", b"a b", b"A\tb  c d e"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    owner, hashed = shingle_sets(data, offsets)
    assert np.bincount(owner, minlength=4).tolist() == [2, 0, 1, 1]
    assert hashed[owner == 3][0] in hashed[owner == 0]


def test_a_cluster_of_copies_far_and_near(spark, monkeypatch):
    """Copies between half and wholly alike: stars leave some of them, which the blocks must settle."""
    pick = random.Random(11)
    base = [f"w{pick.randrange(500)}" for _ in range(160)]
    rows = []
    for k in range(120):
        copy = list(base)
        for _ in range(pick.randrange(0, 9)):
            copy[pick.randrange(len(copy))] = f"x{pick.randrange(9999)}"
        rows.append((k, " ".join(copy), None))
    calls = []

    def small(df, percent, bins):
        calls.append(df.count())
        return minhash_dedup.__dict__["_blocks"](df, percent, bins, 8)

    monkeypatch.setattr(minhash_dedup, "_blocks", minhash_dedup.block_links, raising=False)
    monkeypatch.setattr(minhash_dedup, "block_links", small)
    got = near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert calls[0] > 0
    assert sorted(map(tuple, got)) == sorted(brute(rows))
