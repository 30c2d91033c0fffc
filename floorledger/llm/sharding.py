"""Balanced label propagation: linked documents move to their neighbours' shards under capacity quotas."""

from __future__ import annotations

from collections import defaultdict
from math import ceil, inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import dropped, numbered, staged, unit_hash

ROW_BYTES = 16


def _per_shard(df: DataFrame, shard: str, value: Column, shards: int) -> list[int]:
    """A total per shard; at most ``shards`` rows reach the driver."""
    out = [0] * shards
    for row in df.groupBy(F.col(shard).alias("s")).agg(value.alias("v")).collect():
        out[row["s"]] = row["v"]
    return out


def _numbers(values: list) -> Column:
    return F.split(F.lit(" ".join(map(str, values)) or "0"), " ").cast("array<double>")


def admission(wanted: list[list[int]], room: list[int]) -> list[float]:
    """The share of its wishes that each shard admits: the largest with which arrivals fit into room and departures.

    ``wanted[s][t]`` rows want to go from s to t.
    """
    n = range(len(room))
    total = [sum(wanted[s][t] for s in n) for t in n]
    share = [1.0] * len(room)
    for _ in range(200):
        leaving = [sum(w * x for w, x in zip(wanted[s], share, strict=True)) for s in n]
        less = [min(share[t], max(0.0, (room[t] + leaving[t]) / total[t])) if total[t] else 1.0 for t in n]
        done = max(a - b for a, b in zip(share, less, strict=True)) < 1e-4
        share = less
        if done:
            break
    return share


def propagate(linked: DataFrame, targets: list[int], rounds: int) -> tuple[DataFrame, bool]:
    """Move the rows of ``linked`` (``group, shard`` and others) towards shards that more of their group is in.

    The rows of a group are neighbours of each other. A round counts each group's rows per shard and
    picks the shard with most of them, less that shard's price. The rest of the group wants to go there, all of
    its rows in a shard together, and is admitted up to the shard's quota: its target less its linked
    rows, as unlinked rows may be anywhere and make way, and the linked rows that leave it in the same
    round, so full shards exchange rows. A shard that had to refuse wishes raises its price, so groups turn
    to others that hold fewer of their rows but have room. Ties are drawn anew in each round. It goes on until no
    group is in several shards, at most ``rounds`` times. Rows are admitted by a hash, so a quota holds on average.
    A group is judged by its counts per shard: the work of a round is one aggregation and one join.

    Returns the rows and whether quotas are not met yet: groups are left apart, or a shard holds too many rows.
    """
    shards = len(targets)
    now, prices = linked, [0.0] * shards
    for turn in range(rounds):
        counts = staged(now.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("here")))
        load = _per_shard(counts, "shard", F.sum("here"), shards)
        tie = unit_hash("group", "shard", F.lit(turn)) / F.lit(float(1 << 31))
        worth = F.col("here") + tie - F.element_at(_numbers(prices), F.col("shard") + 1)
        best = counts.groupBy("group").agg(F.max(F.struct(worth.alias("worth"), "shard")).alias("top"), F.count(F.lit(1)).alias("parts"))
        best = best.filter("parts > 1").select("group", F.col("top.shard").alias("to"))
        wishes = staged(counts.join(best, "group").filter("shard <> to"))
        wanted = [[0] * shards for _ in range(shards)]
        for row in wishes.groupBy("shard", "to").agg(F.sum("here").alias("v")).collect():  # at most shards^2
            wanted[row["shard"]][row["to"]] = row["v"]
        if not any(map(any, wanted)):
            dropped(counts), dropped(wishes)
            return now, any(x > target for x, target in zip(load, targets, strict=True))
        share = admission(wanted, [target - x for x, target in zip(load, targets, strict=True)])
        refused = [(1 - x) * any(row[t] for row in wanted) for t, x in enumerate(share)]
        prices = [p + x for p, x in zip(prices, refused, strict=True)]
        prices = [p - min(prices) for p in prices]
        admitted = unit_hash("group", "shard", F.lit(turn + 1000)) / F.lit(float(1 << 31)) < F.element_at(_numbers(share), F.col("to") + 1)
        moves = wishes.filter(admitted).select("group", "shard", "to")
        out = now.join(moves, ["group", "shard"], "left").withColumn("shard", F.coalesce("to", "shard"))
        out = staged(out.select(*linked.columns))
        dropped(counts), dropped(wishes)
        if turn:
            dropped(now)
        now = out
    return now, rounds > 0


def place(pieces: dict[tuple[int, int], int], targets: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Where groups go so that as many as possible are whole and no shard holds more than its target.

    ``pieces[shard, size]`` is the number of groups of one size that are whole in a shard, those with
    shard -1 are in several. Returns ``(shard, size, first, last, to, cut)``: of these groups, numbered
    from 0, those from ``first`` to before ``last`` go to ``to``; all others stay. Larger groups come first, into free room
    and then into the place of smaller whole ones, which are placed later. A group is ``cut`` if neither
    is left for it in any shard; at most about one group per shard is.
    """
    held: list[dict[int, int]] = [{} for _ in targets]
    waiting: dict[int, list[list[int]]] = defaultdict(list)
    gone: dict[tuple[int, int], int] = defaultdict(int)
    out = []
    for (s, z), n in pieces.items():
        if s < 0:
            waiting[z].append([s, 0, n])
        else:
            held[s][z] = n
    free = [t - sum(z * n for z, n in h.items()) for t, h in zip(targets, held, strict=True)]

    def leave(s: int, z: int, n: int) -> int:
        if n:
            waiting[z].append([s, gone[s, z], gone[s, z] + n])
            gone[s, z] += n
            held[s][z] -= n
            free[s] += n * z
        return n * z

    def make_room(s: int, need: int, below: float) -> None:
        sizes = sorted(z for z, n in held[s].items() if n and z < below)
        for z in reversed(sizes):
            need -= leave(s, z, min(held[s][z], need // z))
        for z in sizes:
            if need > 0:
                need -= leave(s, z, min(held[s][z], -(-need // z)))

    def go(z: int, n: int, to: int, cut: int) -> None:
        while n:
            s, first, last = lot = queue[-1]
            k = min(n, last - first)
            out.append((s, z, first, first + k, to, cut))
            lot[1] += k
            n -= k
            if lot[1] == last:
                queue.pop()

    for s, x in enumerate(free):
        if x < 0:
            make_room(s, -x, inf)
    while waiting:
        z = max(waiting)
        queue = waiting.pop(z)
        left = sum(last - first for _, first, last in queue)
        for s in sorted(range(len(free)), key=lambda s: -free[s]):
            n = max(0, min(left, free[s] // z))
            go(z, n, s, 0)
            free[s] -= n * z
            left -= n
        if left:
            most = [x + sum(y * n for y, n in h.items() if y < z) for x, h in zip(free, held, strict=True)]
            for s in sorted(range(len(free)), key=lambda s: -most[s]):
                n = max(0, min(left, most[s] // z))
                if n:
                    make_room(s, n * z - free[s], z)
                    go(z, n, s, 0)
                    free[s] -= n * z
                    left -= n
        for _ in range(left):
            rest, to = z, max(range(len(free)), key=lambda s: free[s])
            go(z, 1, to, 1)
            while rest > 0 and max(free) > 0:
                s = max(range(len(free)), key=lambda s: free[s])
                taken = min(rest, free[s])
                free[s] -= taken
                rest -= taken
    return out


def gather(linked: DataFrame, targets: list[int]) -> DataFrame:
    """Make the groups of ``linked`` whole that quotas kept apart in propagation, move some out of shards that hold too
    many rows, and mark the rows of those that must be ``cut``; afterwards the whole groups of a shard fit its target.

    Only the number of groups per shard and size reaches the driver. Groups find their place from their
    number among those of one shard and size.
    """
    counts = staged(linked.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("here")))
    groups = counts.groupBy("group").agg(F.count(F.lit(1)).alias("parts"), F.max("shard").alias("own"), F.sum("here").alias("members"))
    groups = groups.select("group", F.when(F.col("parts") > 1, -1).otherwise(F.col("own")).alias("own"), "members")
    groups = staged(groups.withColumn("at", unit_hash("group", F.lit(17))))
    sizes = {(r["own"], r["members"]): r["count"] for r in groups.groupBy("own", "members").count().collect()}
    plan = place(sizes, targets)
    if not plan:
        return linked.withColumn("cut", F.lit(False))
    text = F.lit(";".join(" ".join(map(str, x)) for x in plan))
    ranges = linked.sparkSession.range(1).select(F.explode(F.split(text, ";")).alias("x"))
    ranges = ranges.select(F.split("x", " ").cast("array<long>").alias("x"))
    names = ("own", "members", "first", "last", "to", "cut")
    ranges = ranges.select(*(F.col("x")[i].alias(c) for i, c in enumerate(names)))
    # small buckets, as a size can have most of the groups
    ranked = numbered(groups, ["own", "members"], "at", 10 * sum(sizes.values()), ties=["group"])
    goes = ranked.join(F.broadcast(ranges), ["own", "members"]).filter("n >= first AND n < last").select("group", "to", "cut")
    moves = counts.join(goes, "group").select("group", "shard", "to", "cut")
    out = linked.join(moves, ["group", "shard"], "left")
    return out.withColumns({"shard": F.coalesce(F.col("to").cast("int"), "shard"), "cut": F.coalesce(F.col("cut") == 1, F.lit(False))}).drop("to")


def settle(rows: DataFrame, targets: list[int], shards: int) -> DataFrame:
    """Give every shard exactly its target and its rows gapless slots.

    ``rows`` holds ``shard``, ``order``, ``loose`` and ``cut``. The rows of a shard are numbered, those of
    whole groups first, then those of cut ones; those beyond the target fill the gaps of other shards in turn.
    """
    sizes = _per_shard(rows, "shard", F.count(F.lit(1)), shards)
    # whole groups come in the lower half of the order, cut ones in the next quarter
    late = F.lit(1 << 30) + F.col("loose").cast("long") * (1 << 29) + F.shiftright("order", 2)
    spread = F.when(F.col("loose") | F.col("cut"), late).otherwise(F.shiftright("order", 1)).cast("long")
    placed = numbered(rows.withColumn("__spread", spread), ["shard"], "__spread", sum(sizes), ties=["order"])
    surplus, gap = [0], [0]
    for have, want in zip(sizes, targets, strict=True):
        surplus.append(surplus[-1] + max(0, have - want))
        gap.append(gap[-1] + max(0, want - have))
    at = lambda values, i: F.element_at(_numbers(values), i).cast("long")
    here = F.col("shard") + 1
    mover = at(surplus[:-1], here) + F.col("n") - at(targets, here)
    ends = F.split(F.lit(" ".join(map(str, gap[1:]))), " ").cast("array<long>")
    placed = placed.withColumn("__mover", F.when(F.col("n") >= at(targets, here), mover))
    placed = placed.withColumn("__to", F.when(F.col("__mover").isNotNull(), F.size(F.filter(ends, lambda e: e <= F.col("__mover")))))
    to = F.col("__to") + 1
    slot = at(sizes, to) + F.col("__mover") - at(gap[:-1], to)
    return placed.withColumns(
        {"slot": F.coalesce(slot, F.col("n").cast("long")), "shard": F.coalesce("__to", "shard").cast("int")}
    )


def shard_documents(
    docs: DataFrame, shards: int = 40, rounds: int = 40, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Documents with equal texts are linked. The law is ``rows``: counts are at most one apart, whatever
    the groups are. Documents start in shards by a hash of their id, in equal numbers; propagation
    gathers the groups, in two or three rounds where shards have room for them. If quotas still keep some
    apart after ``rounds`` rounds, these are placed by their sizes, small ones making way for larger ones.
    Groups stay cut only where they fit no shard beside what is placed, at most about one per shard. A group above the capacity of a shard is cut beforehand, by a hash of the id,
    into parts that fit one.

    A null text has 16 bytes, the CRC of the empty text, and is a group with other null texts, apart
    from empty ones. Null ids and repeated rows are documents of their own. Other columns are ignored; with fewer rows than
    shards, the first shards hold one row each; an empty table gives no rows.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("text_key"),
        unit_hash(F.col(id_col), F.lit(11)).alias("order"),
    )
    rows = staged(rows)
    total = rows.count()
    capacity = max(1, ceil(total / shards))
    targets = [total // shards + (k < total % shards) for k in range(shards)]

    start = numbered(rows, [], "order", total, ties=["doc_id", "text_crc32"])
    start = start.withColumn("shard", F.pmod("n", F.lit(shards)).cast("int")).drop("n")
    # numbers of equal order depend on the run, so they are written once
    start = staged(start)
    groups = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    parts = F.ceil(F.col("members") / F.lit(capacity * 0.95))
    start = start.join(groups, "text_key", "left")
    part = F.pmod(F.xxhash64("doc_id", F.lit(13)), parts)
    start = start.withColumn("group", F.when(F.col("members") > 1, F.xxhash64("text_key", part)))
    start = staged(start.drop("text_key", "members").withColumn("loose", F.col("group").isNull()))

    linked, apart = propagate(start.filter("NOT loose"), targets, rounds)
    linked = gather(linked, targets) if apart else linked.withColumn("cut", F.lit(False))
    joined = staged(start.filter("loose").withColumn("cut", F.lit(False)).unionByName(linked))
    out = settle(joined, targets, shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
