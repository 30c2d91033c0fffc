import hashlib
import random
import zlib
from collections import defaultdict

from floorledger.llm import prefix_trie
from floorledger.llm.prefix_trie import Forest, common, conversation_trie, end_hashes

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, part string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c // 100 * 100, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, of in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        parent = min(members[p[:-1]]) if p else None
        out.append((min(of), len(p), parent, len(of), len(kids[p]), leaves[p], saved[p], digest))
    return sorted(out, key=str)


def corpus(seed, convs=250):
    pick = random.Random(seed)
    rows = []
    for c in [*range(convs), 1000, 1003, 5017, 5050]:
        if pick.random() < 0.1 and c % 100:
            rows.append((c, 0, "user", "only"))
            continue
        for t in range(pick.choice([1, 2, 3, 3, 5, 9])):
            rows.append((c, t, pick.choice(["user", "user", None]), pick.choice(["a", "a", "a", "bé", "", None, "ccc"])))
    for k in range(60):
        rows += [(200 + 3 * k, 50 + t, "user", f"deep {t}") for t in range(pick.randrange(0, 12))]
    rows += [(7, None, "system", "first"), (None, 1, "user", "nobody"), (None, None, None, None)]
    pick.shuffle(rows)
    return [(*r, "x", "y", "z") for r in rows]


def test_nodes_are_those_of_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = conversation_trie(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_many_ranges_give_the_same_nodes(spark, monkeypatch):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    for turns in (700, 40):
        monkeypatch.setattr(prefix_trie, "RANGE_TURNS", turns)
        assert sorted(map(tuple, conversation_trie(docs).collect()), key=str) == brute(rows)


def test_a_deep_conversation_and_its_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", 500)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 500, 100) for t in range(300 + c % 200)]
    rows += [(100 + k, t, "user", f"t{t}") for k in range(3, 40) for t in range(20)]
    rows = [(*r, "x", "y", "z") for r in rows]
    assert sorted(map(tuple, conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_ends_in_segments(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 20)
    ids = random.Random(1).sample(range(-50, 10**6), 400)
    frame = spark.createDataFrame([(bytearray(b"ab"[k % 3 > 0 : 2]), i) for k, i in enumerate(ids)], "name binary, conv_id long")
    want = {n: hashlib.sha256(",".join(map(str, sorted(i for k, i in enumerate(ids) if b"ab"[k % 3 > 0 : 2] == n))).encode()).hexdigest() for n in (b"ab", b"b")}
    assert {bytes(r["name"]): r["ends_sha256"] for r in end_hashes(frame).collect()} == want


def test_every_merge_makes_the_node_of_the_common_prefix():
    pick = random.Random(2)
    for _ in range(50):
        seqs = sorted({tuple(pick.choice("ab") for _ in range(pick.randrange(0, 7))) for _ in range(12)})
        forest = Forest([len(s) for s in seqs], [common(a, b) for a, b in zip(seqs, seqs[1:], strict=False)])
        branching = {s[:d] for s in seqs for d in range(len(s)) if len({x[: d + 1] for x in seqs if x[:d] == s[:d] and len(x) > d}) > 1}
        nodes = {seqs[f][:d] for f, d in zip(forest.first, forest.depth, strict=True)}
        top = {seqs[0][: common(seqs[0], seqs[-1])]}
        assert nodes - top == (branching | set(seqs)) - top and len(nodes) == len(forest.depth)
        for v, p in enumerate(forest.parent):
            path = seqs[forest.first[v]][: forest.depth[v]]
            assert all(s[: forest.depth[v]] == path for s in seqs[forest.first[v] : forest.last[v] + 1])
            assert p == -1 or forest.depth[p] < forest.depth[v]


def test_no_rows(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
