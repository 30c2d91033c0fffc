"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorledger.llm.common import bounded_batches, dropped, staged, whole_rows
from floorledger.llm.components import components
from floorledger.llm.textarrays import SPACES, byte_table, column_bytes, groups, mixed, words

TABLE = byte_table(SPACES)
SHINGLE = 5
_ODD = np.random.default_rng(9).integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Banding:
    """``bands`` keys of ``rows`` bins each: a pair of similarity s shares one with probability 1 - (1 - s^rows)^bands."""

    bands: int = 24
    rows: int = 8

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of the texts of a range, sorted by both.

    A shingle is the hash of ``size`` words in a row; a text of fewer words has one of all its words.
    """
    text, _, _, word = words(data, offsets, TABLE)
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n)
    value = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for k in range(size):
        value += word[k : k + len(value)] * _ODD[k]
    inside = text[: len(value)] == text[size - 1 : size - 1 + len(value)] if len(value) else np.zeros(0, bool)
    owner, hashed = text[: len(value)][inside], mixed(value[inside])
    firsts = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < size))
    short = np.array(
        [int((word[firsts[t] : firsts[t] + count[t]] * _ODD[: count[t]]).sum()) ^ int(count[t]) for t in few], np.uint64
    )
    owner, hashed = np.concatenate((owner, few)), np.concatenate((hashed, mixed(short)))
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    return owner[new], hashed[new]


def set_keys(owner: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
    """128 bits per set: sums of two hashes of its members, as bytes."""
    out = np.zeros((n, 2), np.uint64)
    if len(owner):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        for k in range(2):
            out[owner[first], k] = np.add.reduceat(mixed(hashed ^ _ODD[20 + k]), first)
    return out


def sketches(owner: np.ndarray, hashed: np.ndarray, n: int, bins: int) -> np.ndarray:
    """One-permutation minima, (n, bins): one hash per shingle deals it to a bin and gives its value there.

    An empty bin takes the value of a bin drawn by a hash of (bin, attempt), alike for all texts,
    until one is not empty. Rows of empty sets are zero.
    """
    value = mixed(hashed ^ _ODD[30])
    bin_ = ((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    empty = np.uint64(1 << 32)
    table = np.full(n * bins, empty, np.uint64)
    np.minimum.at(table, owner * bins + bin_.astype(np.int64), value & np.uint64(0xFFFFFFFF))
    table = table.reshape(n, bins)
    filled = table != empty
    some = filled.any(1)
    table[~some] = 0
    row, column = np.nonzero(~filled & some[:, None])
    attempt = 1
    while len(row):
        turn = np.uint64(int(_ODD[32]) * attempt & (1 << 64) - 1)
        drawn = mixed(column.astype(np.uint64) * _ODD[31] + turn) % np.uint64(bins)
        drawn = drawn.astype(np.int64)
        ok = filled[row, drawn]
        table[row[ok], column[ok]] = table[row[ok], drawn[ok]]
        row, column = row[~ok], column[~ok]
        attempt += 1
    return table


def band_keys(table: np.ndarray, banding: Banding) -> np.ndarray:
    """(n, bands) keys; the band is part of the key."""
    parts = table.reshape(len(table), banding.bands, banding.rows)
    value = (parts * _ODD[40 : 40 + banding.rows]).sum(2, dtype=np.uint64)
    return mixed(value + np.arange(banding.bands, dtype=np.uint64) * _ODD[33])


def signatures(docs: DataFrame, banding: Banding) -> DataFrame:
    """``key, n, bands, sketch`` of ``text``, beside all other columns; ``key`` names the set, ``sketch`` has a byte per bin."""
    beside = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in groups(offsets):
                n = b - a
                owner, hashed = shingle_sets(data, offsets[a : b + 1])
                table = sketches(owner, hashed, n, banding.bins)
                keys = pa.array([x.tobytes() for x in set_keys(owner, hashed, n)], pa.binary())
                cuts = pa.array(np.arange(0, n * banding.bands + 1, banding.bands), pa.int32())
                bands = pa.ListArray.from_arrays(cuts, pa.array(band_keys(table, banding).view(np.int64).reshape(-1)))
                sketch = pa.array([x.tobytes() for x in mixed(table).astype(np.uint8)], pa.binary())
                size = pa.array(np.bincount(owner, minlength=n))
                others = [batch.column(c).slice(a, n) for c in beside]
                yield pa.RecordBatch.from_arrays([*others, keys, size, bands, sketch], [*beside, "key", "n", "bands", "sketch"])

    bounded_batches(docs.sparkSession)
    schema = docs.select(*beside).schema
    for name, kind in (("key", "binary"), ("n", "long"), ("bands", T.ArrayType(T.LongType())), ("sketch", "binary")):
        schema = schema.add(name, kind)
    return docs.select(*beside, "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame) -> DataFrame:
    """``key, shingles`` of ``text``: the sorted hashes of the whole set as bytes."""

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in groups(offsets):
                owner, hashed = shingle_sets(data, offsets[a : b + 1])
                cuts = np.searchsorted(owner, np.arange(b - a + 1))
                sets = [hashed[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                keys = [x.tobytes() for x in set_keys(owner, hashed, b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "shingles"])

    bounded_batches(docs.sparkSession, size="4m")
    return docs.select("text").mapInArrow(run, "key binary, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` whose full sets have ``100 * intersection >= percent * union``."""
    members = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("of_a")), "a")
    joined = members.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("of_b")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield out

    return joined.select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary")


def sizes_fit(percent: int):
    """Sizes of two sets that can reach the similarity: nothing that fails here could be a link."""
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def star_pairs(bucket: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Each member of a bucket with its hub: as many pairs as members. A pair of several buckets comes once."""
    pairs = bucket.join(hubs, "band").filter(F.col("key") != F.col("hub")).filter(sizes_fit(percent))
    if "hub_label" in hubs.columns:
        pairs = pairs.filter("label <> hub_label")
    return pairs.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def unresolved(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with the component's label."""
    known = components(links).withColumnRenamed("vertex", "key")
    rows = buckets.join(known, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed_ = rows.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    return rows.join(mixed_.select("band"), "band")


BLOCK_ROWS, BLOCK_BYTES = 1024, 32 << 20


def block_links(rows: DataFrame, percent: int, bins: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Links between different components within a bucket, as many as join what all of them join.

    A bucket is cut into blocks by a hash, of about ``block`` rows and ``BLOCK_BYTES`` of sets, and pairs of
    blocks are compared, so a task holds two blocks at a time. A pair goes on to its full sets where its
    sizes fit and its share of equal sketch bytes reaches the similarity less five standard deviations,
    those of a sample of min(n, bins) shingles; a pair of several buckets does in the first of them only,
    and one that links found before connect does not at all.
    """
    need = F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("n") * 8 / F.lit(BLOCK_BYTES))
    rows = rows.join(rows.groupBy("band").agg(F.ceil(need).alias("blocks")), "band")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))
    rows = rows.withColumn("other", F.explode(other))
    low, high = F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    rows = rows.select("band", low, high, "own", "key", "label", "n", "sketch", "bands", "shingles")
    s = percent / 100

    def run(group, table):
        band, x, y = (k.as_py() for k in group)
        own, n = (table.column(c).to_numpy() for c in ("own", "n"))
        sketch = np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in table.column("sketch")])
        bands = np.stack([v.values.to_numpy() for v in table.column("bands")])
        sets, key = table.column("shingles"), table.column("key")
        part = _codes(table.column("label").to_pylist())
        members = lambda k: np.frombuffer(sets[int(k)].as_buffer(), np.uint64)
        left = np.flatnonzero(own == x)
        right = left if x == y else np.flatnonzero(own == y)
        a, b = [], []
        for i in left:
            js = right[(right > i) & (part[right] != part[i])] if x == y else right[part[right] != part[i]]
            js = js[np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * percent]
            if not len(js):
                continue
            margin = 5 * np.sqrt(s * (1 - s) / np.minimum(np.minimum(n[js], n[i]), bins))
            js = js[(sketch[js] == sketch[i]).mean(1) >= s - margin]
            js = js[bands[i, (bands[js] == bands[i]).argmax(1)] == band]
            mine = members(i) if len(js) else None
            for j in js:
                if part[j] == part[i]:
                    continue
                theirs = members(j)
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(theirs) - both):
                    part[part == part[j]] = part[i]
                    one, two = sorted((key[int(i)].as_py(), key[int(j)].as_py()))
                    a.append(one)
                    b.append(two)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.groupBy("band", "x", "y").applyInArrow(run, "a binary, b binary")


def _codes(labels: list) -> np.ndarray:
    codes: dict = {}
    return np.array([codes.setdefault(x, len(codes)) for x in labels])


def near_links(docs: DataFrame, classes: DataFrame, banding: Banding, percent: int) -> DataFrame:
    """Links ``a, b`` between sets that connect every component of the similarity graph.

    1. In each bucket the members are compared with one hub, drawn by a hash: a star.
    2. In buckets that then hold several components, the member with most links is the hub of a second
       star. These two cost as many pairs as the buckets have members and settle nearly all of them.
    3. What is left of the buckets is compared across components in blocks, so no pair is given up
       because its hub was far from one of them. No more links come out than join components.
    """
    rows = classes.select("key", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("band")
    buckets = staged(rows.join(shared, "band"))
    needed = classes.join(buckets.select("key").distinct(), "key", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    some = docs.join(needed, docs["doc_id"].eqNullSafe(needed["doc_id"]), "left_semi")
    sets = staged(full_sets(some).dropDuplicates(["key"]))

    pick = F.min(F.struct(F.xxhash64("key", "band").alias("order"), "key", "n"))
    hubs = buckets.groupBy("band").agg(pick.alias("h")).select("band", F.col("h.key").alias("hub"), F.col("h.n").alias("m"))
    tried = staged(star_pairs(buckets, hubs, percent))
    first = staged(confirmed(tried, sets, percent))

    rest = staged(unresolved(buckets, first))
    degree = first.select(F.col("a").alias("key")).union(first.select("b")).groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
    ranked = rest.join(degree, "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    pick = F.max(F.struct("degree", F.xxhash64("key").alias("order"), "key", "n", "label"))
    hubs = ranked.groupBy("band").agg(pick.alias("h"))
    hubs = hubs.select("band", F.col("h.key").alias("hub"), F.col("h.n").alias("m"), F.col("h.label").alias("hub_label"))
    more = star_pairs(rest, hubs, percent).join(tried, ["a", "b"], "left_anti")
    second = staged(first.union(confirmed(more, sets, percent)))
    dropped(rest)

    rest = unresolved(buckets, second).join(classes.select("key", "sketch", "bands"), "key").join(sets, "key")
    return staged(second.union(block_links(rest, percent, banding.bins)))


def near_classes(docs: DataFrame, percent: int, banding: Banding) -> tuple[DataFrame, DataFrame]:
    """Of ``doc_id, text`` and other columns: each row's ``key, n`` beside the others and, for the keys of sets that are not empty, ``key, label, component_id``.

    ``label`` names the component, ``component_id`` is its smallest id.
    """
    found = staged(signatures(docs, banding))
    first = [F.first(c).alias(c) for c in ("n", "bands", "sketch")]
    classes = staged(found.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), *first))
    labels = staged(components(near_links(docs, classes, banding, percent)).withColumnRenamed("vertex", "key"))
    # classes without links are components of their own; only linked ones are joined with labels
    names = classes.select("key", "rep").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    smallest = names.groupBy("label").agg(F.min("rep").alias("component_id"))
    return found, names.join(smallest, "label").select("key", "label", "component_id")


def near_dedup(
    docs: DataFrame, percent: int = 85, banding: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked when ``100 * intersection >= percent * union`` of their sets of five-word shingles.
    Equal sets are one class and compared once. The set of a text without words is empty and linked
    with nothing, so a null or empty text is its own component. Rows with null ids take part: their
    component has the smallest id there is in it, or null, and they are not kept unless all of it is
    null. Repeated rows fall into one class and get the same answer. Other columns are ignored; an empty
    table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found, names = near_classes(docs, percent, banding)
    some = found.filter("n > 0").select("doc_id", "key", "n").join(names.select("key", "component_id"), "key")
    none = found.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = some.select("doc_id", "n", "component_id").unionByName(none)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame, percent: int = 85, banding: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged, whatever they are called.

    Of each component one row with its smallest id stays, ids and texts repeated or not; rows without
    words are linked with nothing and all stay.
    """
    text_key = F.xxhash64(F.col(text_col)).alias("text_key")
    marked = docs.select(whole_rows(docs), F.col(id_col).cast("long").alias("id"), text_key, F.col(text_col).alias("text"))
    found, names = near_classes(marked.select(F.col("id").alias("doc_id"), "text_key", "text"), percent, banding)
    some = found.filter("n > 0").join(names, "key").filter("doc_id <=> component_id")
    each = some.groupBy("label", "text_key").agg(F.first("doc_id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    one = each.groupBy("label").agg(F.min(F.struct("text_key", "kept_id", "copies")).alias("one"))
    none = found.filter("n = 0").select("text_key", F.col("doc_id").alias("kept_id"), F.lit(1).cast("long").alias("copies"))
    kept = staged(one.select("one.*").unionByName(none.distinct()).withColumnRenamed("text_key", "kept_key"))
    out = marked.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left_semi")
    if not kept.filter("copies > 1").isEmpty():  # rows repeat
        words_ = F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
        out = out.withColumn("apart", F.when(words_, F.lit(-1)).otherwise(F.monotonically_increasing_id()))
        out = out.dropDuplicates(["id", "text_key", "apart"])
    return out.select("row.*")
