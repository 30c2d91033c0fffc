"""Embedding near-dedup by iterative quantisation: balanced binary codes, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import bounded_batches, staged, unit_hash
from floorledger.llm.components import components


@dataclass
class Quantiser:
    """Several learned rotations; the signs of the rotated vector are its code, cut into keys of ``bits`` bits.

    Vectors are not centred: that would widen the angle of a pair, near the mean up to a straight one,
    and the tables are as many as the angle itself calls for. With no bits all rows share the one key.
    """

    rotations: np.ndarray
    tables: int
    bits: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables) integers."""
        code = np.concatenate([(unit @ r) >= 0 for r in self.rotations], 1)[:, : self.tables * self.bits]
        parts = code.reshape(len(unit), self.tables, self.bits)
        return parts.astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))


def itq(x: np.ndarray, turns: int, seed: int) -> np.ndarray:
    """A projection on principal axes, then the rotation that brings the data closest to its signs."""
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    projected = x @ axes.T
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(axes), len(axes))))
    for _ in range(turns):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ projected)
        rotation = (u @ v).T
    return axes.T @ rotation


def tables_for(rows: int, least: float, recall: float, per_bucket: int = 8) -> tuple[int, int]:
    """(tables, bits): keys as long as the number of rows calls for, and as many as find a pair at the
    threshold with probability ``recall``, its bits differing as often as its angle says."""
    bits = min(24, max(6, ceil(log2(max(rows, 2) / per_bucket))))
    same = (1 - acos(least) / pi) ** bits
    return max(1, ceil(log(1 - recall) / log(1 - same))), bits


def learn(sample: np.ndarray, tables: int, bits: int, turns: int = 30) -> Quantiser:
    count = ceil(tables * bits / min(sample.shape))
    return Quantiser(np.stack([itq(sample, turns, seed) for seed in range(count)]), tables, bits)


def comparisons(model: Quantiser, sample: np.ndarray, labels: np.ndarray) -> float:
    """How many times over a pair of one label is compared in the buckets, on average over the pairs of a sample."""
    keys = model.keys(sample)
    pairs = lambda columns: float((np.square(np.unique(columns, axis=0, return_counts=True)[1].astype(float))).sum() - len(labels))
    every = pairs(labels[:, None])
    return sum(pairs(np.stack([labels, k], 1)) for k in keys.T) / every if every else 0.0


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, class, unit``: rows that can link, ``unit`` the vector of length one in doubles as bytes.

    ``class`` names equal vectors of one label and dimension, which are compared once.
    """

    def run(batches):
        from hashlib import blake2b

        for batch in batches:
            ids, labels, classes, units = [], [], [], []
            columns = [batch.column(c) for c in ("vec_id", "label", "embedding")]
            for vec, label, value in zip(*columns, strict=True):
                if not label.is_valid or not value.is_valid or not len(value.values) or value.values.null_count:
                    continue
                x = value.values.to_numpy().astype(np.float64) + 0.0
                top = np.abs(x).max()
                if not np.isfinite(top) or top == 0:
                    continue
                scaled = x / top  # squares of the largest and smallest doubles stay finite
                unit = scaled / np.sqrt(scaled @ scaled)
                ids.append(vec.as_py())
                labels.append(str(label.as_py()))
                classes.append(blake2b(labels[-1].encode() + b"\0" + x.tobytes(), digest_size=16).digest())
                units.append(unit.tobytes())
            arrays = [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(classes, pa.binary()), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "class", "unit"])

    bounded_batches(vectors.sparkSession)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, label string, class binary, unit binary")


def keyed(classes: DataFrame, model: Quantiser) -> DataFrame:
    """``class, unit, n, bucket`` and the row's keys of all tables, a row per table; ``table`` is its number."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = model.keys(_matrix(batch.column("unit")))
            m, rows = model.tables, np.repeat(np.arange(len(keys)), model.tables)
            out = batch.take(pa.array(rows))
            cuts = pa.array(np.arange(0, len(rows) * m + 1, m), pa.int32())
            every = pa.ListArray.from_arrays(cuts, pa.array(np.repeat(keys, m, axis=0).reshape(-1)))
            table = pa.array(np.tile(np.arange(m, dtype=np.int32), len(keys)))
            columns = [out.column(c) for c in ("label", "class", "unit", "n")]
            yield pa.RecordBatch.from_arrays([*columns, table, pa.array(keys.reshape(-1)), every], ["label", "class", "unit", "n", "table", "key", "keys"])

    bounded_batches(classes.sparkSession)
    return classes.select("label", "class", "unit", "n").mapInArrow(
        run, "label string, class binary, unit binary, n long, table int, key long, keys array<long>"
    )


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of the pairs that join two parts: at most n - 1 of them connect what all pairs connect."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            kept.append(k)
    return np.array(kept, np.int64)


def compare(units: np.ndarray, keys: np.ndarray, n: np.ndarray, table: int, split: int | None, least: float):
    """Links of one unit of work: counts per row, and pairs that connect what they connect.

    All rows are compared with one another, or with ``split`` the first ``split`` rows with the others. A
    pair that shares a key of an earlier table as well was compared there.
    """
    a, b = np.nonzero((units if split is None else units[:split]) @ (units if split is None else units[split:]).T >= least)
    if split is None:
        a, b = a[a < b], b[a < b]
    else:
        b = b + split
    if table and len(a):
        new = ~(keys[a, :table] == keys[b, :table]).any(1)
        a, b = a[new], b[new]
    counts = np.bincount(a, weights=n[b], minlength=len(units)) + np.bincount(b, weights=n[a], minlength=len(units))
    kept = _forest(a, b, len(units))
    return counts.astype(np.int64), a[kept], b[kept]


def find_links(rows: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """``a, b, n``: with ``b`` null, ``n`` links of class ``a`` found in one unit; else a pair that connects.

    Rows of a bucket meet in one task as a unit; a large bucket is cut into blocks by a hash, and each
    pair of blocks is a unit of its own, so no task holds more than two blocks.
    """
    sizes = rows.groupBy("label", "table", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    rows = rows.join(sizes, ["label", "table", "key"])
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class", F.lit(3)), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    unit = ["label", "table", "key", "x", "y"]
    rows = rows.repartition(*unit).sortWithinPartitions(*unit, "own", "class")

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            edges = _unit_edges(held)
            if len(edges) > 2:  # the last unit may go on in the next batch
                yield from _units(held.slice(0, edges[-2]), edges[:-1], least)
                held = held.slice(edges[-2])
        if held is not None and held.num_rows:
            yield from _units(held, _unit_edges(held), least)

    columns = [*unit, "own", "class", "unit", "n", "keys"]
    return rows.select(*columns).mapInArrow(run, "a binary, b binary, n long")


def _unit_edges(table: pa.Table) -> np.ndarray:
    """Places where units begin, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in ("label", "table", "key", "x", "y"):
        values = table.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _units(table: pa.Table, edges: np.ndarray, least: float):
    numbers = [table.column(c).to_numpy() for c in ("table", "x", "y", "own", "n")]
    classes = table.column("class").to_pylist()
    units = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in table.column("unit")])
    keys = np.stack([v.values.to_numpy() for v in table.column("keys")])
    out_a, out_b, out_n = [], [], []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if j - i < 2:
            continue
        t, x, y = (int(v[i]) for v in numbers[:3])
        split = None if x == y else int(np.searchsorted(numbers[3][i:j], y))
        if split in (0, j - i):
            continue
        counts, a, b = compare(units[i:j], keys[i:j], numbers[4][i:j], t, split, least)
        some = np.flatnonzero(counts)
        out_a += [classes[i + k] for k in some] + [classes[i + k] for k in a]
        out_b += [None] * len(some) + [classes[i + k] for k in b]
        out_n += counts[some].tolist() + [0] * len(a)
    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary()), pa.array(out_n, pa.int64())], ["a", "b", "n"])


def near_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    recall: float = 0.995,
    sample: int = 10_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of one label and dimension are linked when their cosine, in doubles, is at least ``least``.
    The rotations are learned from about ``sample`` vectors; all are indexed. Key length and number of
    tables follow from the number of vectors, so buckets stay small, and from ``recall``, the wanted
    share of pairs at the threshold itself; closer pairs are found more often. A direction that the
    vectors have in common fills the buckets; where they would compare a pair more than once on average,
    all pairs of a label are compared instead, once and in blocks.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
    have no links and are their own component. Equal vectors are links of each other. Repeated rows are
    vectors of their own, but share the id. Null ids take part; a component of null ids only has a null
    ``component_id``. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    good = staged(usable(rows).withColumn("size", F.octet_length("unit")))
    results = []
    dimensions = [r["size"] for r in good.select("size").distinct().collect()]  # a handful: models, not vectors
    for size in sorted(dimensions):
        own = good.filter(F.col("size") == size)
        classes = staged(own.groupBy("label", "class").agg(F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit")))
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
        tables, bits = tables_for(largest, least, recall)
        total = classes.count()
        share = min(1.0, sample / total)
        some = classes.filter(unit_hash("class") < F.lit(int(share * (1 << 31)))).select("label", "unit").toArrow()
        matrix = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in some.column("unit")]) if some.num_rows else np.zeros((0, size // 8))
        if len(matrix) < 2:
            matrix = np.concatenate([matrix, np.eye(size // 8)[:2], -np.eye(size // 8)[:2]])
        model = learn(matrix, tables, bits)
        of_label = np.unique(some.column("label").to_pylist(), return_inverse=True)[1].astype(np.int64)
        if len(of_label) == len(matrix) and comparisons(model, matrix, of_label) >= 1:
            model = Quantiser(model.rotations, 1, 0)  # all pairs once are fewer, and exact
        results.append((classes, staged(find_links(keyed(classes, model), least))))
    own_id = F.col("vec_id").alias("component_id")
    if not results:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), own_id, F.lit(True).alias("kept"))
    found = results[0][1]
    for _, more in results[1:]:
        found = found.union(more)
    links = found.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labels = staged(components(links).withColumnRenamed("vertex", "class"))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    copies = good.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"))
    names = copies.join(counts, "class", "left").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    names = staged(names.withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("n") - 1))
    smallest = names.groupBy("label").agg(F.min("rep").alias("component_id"))
    names = names.join(smallest, "label").select("class", "n_links", "component_id")
    linked = good.select("vec_id", "class").join(names, "class").select("vec_id", "n_links", "component_id")
    bad = bad_rows(rows).select("vec_id", F.lit(0).cast("long").alias("n_links"), own_id)
    out = linked.unionByName(bad)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def bad_rows(rows: DataFrame) -> DataFrame:
    """The rows that ``usable`` leaves out."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.filter(~(F.col("label").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))))
