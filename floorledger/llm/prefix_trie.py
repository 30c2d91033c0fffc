"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours, deepest first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import takewhile
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.common import bounded_batches, staged

SHARED, STRIDE = 6, 100
#: Turns of one range of sorted sequences.
RANGE_TURNS = 100_000
#: Digits of members' ids that travel as one row.
SEGMENT = 1 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of one turn."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, seq``: each conversation's turns in order as (digest, code points of the text); texts stay behind."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).isNotNull().alias("there"),
            F.col(turn_col).alias("turn"),
            turn_digest(role, text).alias("digest"),
            F.length(text).alias("size"),
        ).alias("x"),
    )
    ordered = F.array_sort(F.collect_list("x"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x.digest, x["size"])).alias("seq"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """``conv_id, seq`` with the first turns of the hundred's first conversation in place of as many of one's own."""
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    first = (F.col("conv_id") - F.col("conv_id") % STRIDE).alias("lead_id")
    own = seqs.select("conv_id", "seq", first, head.alias("head"))
    lead = seqs.filter(F.col("conv_id") % STRIDE == 0)
    lead = lead.select(F.col("conv_id").alias("lead_id"), F.slice("seq", 1, SHARED - 1).alias("lead"))
    both = own.join(lead, "lead_id", "left")
    tail = F.slice("seq", F.col("head") + 1, F.greatest(F.size("seq") - F.col("head"), F.lit(0)))
    start = F.slice(F.coalesce("lead", F.slice("seq", 1, 0)), F.lit(1), F.col("head"))
    return both.select("conv_id", F.concat(start, tail).alias("seq"))


def end_hashes(members: DataFrame) -> DataFrame:
    """``name, ends_sha256``: SHA-256 of the comma-joined ascending ids of each group of ``name, conv_id``.

    Ids are sorted over all tasks and joined into segments there, so what meets in the group's last task
    are a few long texts, hashed one after the other.
    """
    spread = members.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")

    def segments(batches):
        name, first, held, size = None, None, [], 0
        for batch in batches:
            out = []
            for one, conv in zip(*(batch.column(c).to_pylist() for c in ("name", "conv_id")), strict=True):
                if one != name or size > SEGMENT:
                    if held:
                        out.append((name, first, ",".join(held)))
                    name, first, held, size = one, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield _batch(out, SEGMENTS)
        if held:
            yield _batch([(name, first, ",".join(held))], SEGMENTS)

    def hashes(batches):
        name, state = None, None
        for batch in batches:
            out = []
            for one, text in zip(batch.column("name").to_pylist(), batch.column("ids"), strict=True):
                if one != name:
                    if state:
                        out.append((name, state.hexdigest()))
                    name, state = one, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_buffer())
            yield _batch(out, HASHES)
        if state:
            yield _batch([(name, state.hexdigest())], HASHES)

    joined = spread.mapInArrow(segments, "name binary, first long, ids string")
    ordered = joined.repartition("name").sortWithinPartitions("name", "first")
    return ordered.select("name", "ids").mapInArrow(hashes, "name binary, ends_sha256 string")


SEGMENTS = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
HASHES = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])
NODES = pa.schema(
    [
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("depth", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
    ]
)
NODE_ROWS = (
    "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def common(a: list, b: list) -> int:
    """Length of the common prefix."""
    return sum(1 for _ in takewhile(lambda pair: pair[0] == pair[1], zip(a, b, strict=False)))


class Forest:
    """Compressed trie of sorted distinct sequences, from union-find over the common prefixes of neighbours.

    Each sequence begins as a component with its own end for a top. Neighbours are united in descending
    order of the length they share, from left to right: the tops become children of a node of that
    depth. The left top may be that node; the right one lies deeper, as it begins with a later sequence.
    ``first[v]`` to ``last[v]`` are the sequences below node v.
    """

    def __init__(self, length: list[int], shared: list[int]):
        """``shared[i]`` is the common prefix of sequences i and i + 1."""
        n = len(length)
        self.depth, self.first, self.last = list(length), list(range(n)), list(range(n))
        self.parent = [-1] * n
        self.root, self.top = list(range(n)), list(range(n))
        for i in sorted(range(n - 1), key=lambda i: -shared[i]):
            self._unite(i, i + 1, shared[i])

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def _unite(self, a: int, b: int, depth: int) -> None:
        a, b = self._find(a), self._find(b)
        left, right = self.top[a], self.top[b]
        if self.depth[left] == depth:  # a sequence that ends here, or an earlier merge of this node
            node = left
        else:
            node = len(self.depth)
            self.depth.append(depth)
            self.first.append(self.first[left])
            self.last.append(0)
            self.parent.append(-1)
            self.parent[left] = node
        self.parent[right] = node
        self.last[node] = self.last[right]
        if self.last[left] - self.first[left] > self.last[right] - self.first[right]:
            a, b = b, a
        self.root[a], self.top[b] = b, node


def range_nodes(rows: list[tuple], before: list | None, after: list | None) -> Iterator[tuple]:
    """Rows of NODES for one range of sorted sequences ``(seq, n, conv_id, ends)``.

    ``before`` and ``after`` are the sequences next to the range. Nodes that lie on the path to one of
    them are open: other ranges hold parts of them, and their rows carry a name to be merged by. What
    counts once, a node's text and its place among the children, counts where its first sequence is.
    """
    n = len(rows)
    seqs = [r[0] for r in rows]
    shared = [common(seqs[i], seqs[i + 1]) for i in range(n - 1)]
    low = common(before, seqs[0]) if before is not None else -1
    high = common(seqs[-1], after) if after is not None else -1
    ended = [shared[i] < len(seqs[i]) for i in range(n - 1)] + [high < len(seqs[-1])]
    forest = Forest([len(s) for s in seqs], shared)
    nodes = sorted(range(len(forest.depth)), key=lambda v: (forest.depth[v], forest.first[v]))
    weight = np.concatenate(([0], np.cumsum([r[1] for r in rows])))
    names = _Names(seqs[0], seqs[-1])

    saved, kids, inner = [0] * len(nodes), [0] * len(nodes), len(nodes) - n
    least = [r[2] for r in rows] + [None] * inner
    leaves = [int(e) for e in ended] + [0] * inner
    out = []

    def is_open(v: int, depth: int) -> bool:
        return forest.first[v] == 0 and depth <= low or forest.last[v] == n - 1 and depth <= high

    def begins(v: int, depth: int) -> bool:
        return not (forest.first[v] == 0 and depth <= low)

    for v in reversed(nodes):  # children before parents
        up = forest.parent[v]
        top = forest.depth[up] + 1 if up >= 0 else 0
        seq, total = seqs[forest.first[v]], int(weight[forest.last[v] + 1] - weight[forest.first[v]])
        sums, children = saved[v], kids[v]
        for depth in range(forest.depth[v], top - 1, -1):
            size = seq[depth - 1][1] if depth else 0
            sums += total * size - (size if begins(v, depth) else 0)
            ends = rows[v][3] if v < n and depth == forest.depth[v] else None
            out.append([v, depth, total, children, leaves[v], sums, ends])
            children = int(begins(v, depth))
        if up >= 0:
            leaves[up] += leaves[v]
            saved[up] += sums
            kids[up] += children
            least[up] = least[v] if least[up] is None else min(least[up], least[v])
    for v, depth, total, children, leaf, sums, ends in out:
        up = v if depth > (forest.depth[forest.parent[v]] + 1 if forest.parent[v] >= 0 else 0) else forest.parent[v]
        node = names(forest.first[v] == 0 and depth <= low, depth) if is_open(v, depth) else None
        parent = parent_conv = None
        if depth:
            if is_open(up, depth - 1):
                parent = names(forest.first[up] == 0 and depth - 1 <= low, depth - 1)
            else:
                parent_conv = least[up]
        yield node, parent, depth, least[v], parent_conv, total, children, leaf, sums, ends


class _Names:
    """Names of the nodes on the paths to a range's first and last sequence."""

    def __init__(self, first: list, last: list):
        self.paths = {True: (first, [b""]), False: (last, [b""])}

    def __call__(self, on_first: bool, depth: int) -> bytes:
        seq, names = self.paths[on_first]
        while len(names) <= depth:
            names.append(hashlib.sha256(names[-1] + seq[len(names) - 1][0]).digest())
        return names[depth]


def trie_nodes(members: DataFrame, turns: int) -> DataFrame:
    """The trie of ``conv_id, seq``: one row per distinct prefix; ``turns`` is the number of all turns or a bound of it."""
    name = F.unhex(F.sha2(F.array_join(F.transform("seq", lambda x: F.hex(x.digest)), ""), 256))
    members = staged(members.withColumn("name", name))
    distinct = members.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("seq").alias("seq"))
    distinct = distinct.join(end_hashes(members), "name").select("seq", "n", "conv_id", "ends_sha256")
    ranges = max(1, ceil(turns / RANGE_TURNS))
    dealt = distinct.repartitionByRange(ranges, "seq").withColumn("part", F.spark_partition_id())
    dealt = staged(dealt)
    # one row per range, each with the last sequence before it and the first one after it
    edges = dealt.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    edges = edges.select("part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    none = {"n": F.lit(0).cast("long"), "conv_id": F.lit(None).cast("long"), "ends_sha256": F.lit(None).cast("string")}
    beside = [
        edges.filter(F.col(c).isNotNull()).select(F.col(c).alias("seq"), *(x.alias(k) for k, x in none.items()), "part", F.lit(side).alias("side"))
        for c, side in (("before", -1), ("after", 1))
    ]
    both = dealt.withColumn("side", F.lit(0)).unionByName(beside[0]).unionByName(beside[1])

    def run(table):
        seqs = [[(x["digest"], x["size"]) for x in s] for s in table.column("seq").to_pylist()]
        side = table.column("side").to_pylist()
        beside = {k: s for k, s in zip(side, seqs, strict=True) if k}
        columns = (table.column(c).to_pylist() for c in ("n", "conv_id", "ends_sha256"))
        rows = sorted(r[:4] for r in zip(seqs, *columns, side, strict=True) if not r[4])
        return pa.Table.from_batches([_batch(list(range_nodes(rows, beside.get(-1), beside.get(1))), NODES)])

    found = staged(both.groupBy("part").applyInArrow(run, NODE_ROWS))
    once = found.filter("node IS NULL").drop("node")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = found.filter("node IS NOT NULL").groupBy("node", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256")
    )
    merged = staged(merged)
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    inner = once.unionByName(merged.drop("node").withColumn("parent_conv_id", F.lit(None).cast("long")))
    joined = inner.filter("parent IS NOT NULL").join(parents, "parent").withColumn("parent_conv_id", F.col("above")).drop("above")
    return inner.filter("parent IS NULL").unionByName(joined.select(*inner.columns)).drop("parent")


def conversation_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations that begin with the same turns (role, text) share the nodes of these turns. Distinct
    sequences are sorted and dealt in ranges; each range builds the forest of its sequences, and
    the nodes on the paths between ranges are merged by name. Copies of a conversation are one sequence
    with a number.

    Null roles and texts are empty; null turn numbers come first, equal ones are ordered by a digest of role
    and text. Rows without ``conv_id`` belong to no conversation and are left out. Repeated rows are turns
    like any other. Other columns are ignored; an empty table has no nodes. A conversation travels as
    20 bytes a turn, whatever its texts hold.
    """
    bounded_batches(turns.sparkSession, rows=10_000)
    seqs = staged(sequences(turns, conv_col, turn_col, role_col, text_col))
    total = seqs.agg(F.sum(F.size("seq")), F.count(F.lit(1))).first()
    nodes = trie_nodes(rebuilt(seqs), (total[0] or 0) + SHARED * total[1])
    ends = F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
