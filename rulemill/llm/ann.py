"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned so that the signs of the rotated components are codes close to the vectors, and balanced where these lie all around. Parts of a code are the keys of
several tables. Two vectors become candidates in the first table in which their keys differ by one bit at most; of these, candidates whose whole codes are too far apart for the threshold are left out,
and the rest are compared by cosine on the original vectors, in double precision. Only codes travel to the tables; vectors follow for candidates alone.

The width of the keys follows from the number of vectors, so that a bucket holds a few at any size, and the number of tables from the width: at the threshold itself a pair is missed
in all tables with a probability of at most ``MISSED``; at 0.97 with about a fourth of that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.95
MISSED = 0.05
MOST_FITTED = 20_000
#: Components of all vectors fitted together: fewer vectors of very many dimensions are taken.
MOST_COMPONENTS = 4_000_000
LEAST_FITTED = 64
MOST_BROADCAST_BUCKETS = 200_000
BLOCK = 1024


@dataclass(frozen=True)
class Plan:
    """Tables, bits of their keys, bits of a code, and the largest distance of codes at which vectors are compared."""

    tables: int
    width: int
    bits: int
    most: int


def plan(n: int, threshold: float = THRESHOLD) -> Plan:
    """For n vectors: about four of them in a bucket if they lie all around. A sign differs with the probability angle / pi."""
    width = max(8, math.ceil(math.log2(max(n, 2))) - 2)
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    hit = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    tables = max(1, math.ceil(math.log(MISSED) / math.log(max(1 - hit, 1e-9))))
    bits = -(-max(64, tables * width) // 8) * 8
    return Plan(tables, width, bits, math.ceil(p * bits + 5.5 * math.sqrt(bits * p * (1 - p)) + 1))


@dataclass
class Quantiser:
    """Rotations by dimension. One that was too rare to learn from has random directions."""

    bits: int
    turns: dict[int, np.ndarray] = field(default_factory=dict)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit vectors of one dimension, as rows of bytes."""
        d = x.shape[1]
        turn = self.turns.get(d)
        if turn is None:
            turn = np.random.default_rng([3, d]).normal(size=(d, self.bits))
        return np.packbits(x @ turn > 0, axis=1, bitorder="little")


def learn(x: np.ndarray, bits: int, steps: int = 40, seed: int = 3) -> np.ndarray:
    """Iterative quantisation of unit vectors: codes and rotation are fitted in turn. With fewer dimensions than bits, random directions are added.

    The axes go through the origin, not the mean: then signs of two vectors differ by their angle alone, wherever they lie. Around the mean, a tight group of vectors that
    holds the mean would get random codes, and its links would be missed.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x / max(1, len(x)))
    axes = axes[:, ::-1][:, : min(bits, d)]
    k = axes.shape[1]
    turn = np.linalg.qr(rng.normal(size=(k, k)))[0]
    v = x @ axes
    for _ in range(steps if len(x) else 0):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    full = axes @ turn
    if k < bits:
        full = np.hstack([full, rng.normal(size=(d, bits - k))])
    return full


def _unit(values: list) -> np.ndarray:
    x = np.array(values, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(codes: np.ndarray, p: Plan) -> np.ndarray:
    """Keys of each code in each table: one column for each table."""
    bits = np.unpackbits(codes, axis=1, bitorder="little")[:, : p.tables * p.width].reshape(len(codes), p.tables, p.width)
    return (bits.astype(np.int64) << np.arange(p.width)).sum(2)


def keyed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (doubles, -0.0 as 0.0) and vk, a hash that equal vectors share; vk is null for rows that can't link: a null id or vector, a null or non-finite component, no component but zeros."""
    # Grouping and hashing take -0.0 and 0.0 as different in places, so there is only one of them from here on.
    own = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return own.select("id", "v", F.when(good, F.concat(F.hex(F.xxhash64("v")), F.lit(" "), F.hex(F.xxhash64(F.lit(7), "v")))).alias("vk"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", most_fitted: int = MOST_FITTED) -> DataFrame:
    """Link vectors of cosine >= threshold; one row per row of ``vectors``.

    Returns the id, n_links (other rows linked directly), component_id (the smallest id reachable, its own included) and kept (whether that is its own). The rotation is learned on
    at most about ``most_fitted`` vectors, of MOST_COMPONENTS components together; all rows are indexed and searched. Vectors of different dimensions have no cosine and never link; each dimension is searched by itself. Rows that are null or zero or
    hold a null or non-finite component have no links and are kept; a null id has a null component. Equal vectors are one class of which every row links to the others. An empty table gives an empty
    table; further columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    own = keyed(vectors, id_col, vec_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    classes = common.stored(own.where("vk IS NOT NULL").groupBy("vk").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    n, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    p = plan(n, threshold)
    most_fitted = max(LEAST_FITTED, min(most_fitted, MOST_COMPONENTS // longest))
    fitted: dict[int, list] = {}
    for r in common.bounded_sample(classes.select(F.col("rep").alias("id"), "v"), "id", most_fitted).select("v").collect():
        fitted.setdefault(len(r.v), []).append(r.v)
    model = spark.sparkContext.broadcast(Quantiser(p.bits, {d: learn(_unit(sorted(x)), p.bits) for d, x in fitted.items() if len(x) >= LEAST_FITTED}))  # bounded by the sample

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(0).offsets.to_numpy()) if batch.num_rows else []
            for d in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == d)))
                x = _unit(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(np.full(len(x), d, np.int32)), pa.array([r.tobytes() for r in model.value.codes(x)], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["rep", "copies", "dim", "code", "x"])

    coded = common.stored(classes.select("v", "rep", "copies").mapInArrow(encode, f"rep {kind}, copies long, dim int, code binary, x binary"), "codes")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each code goes as a member (role 0) to its bucket in each table, and as a query (role 1) to the buckets one bit above."""
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys = _keys(_matrix(batch.column(2)), p)
                rows, buckets, roles = [], [], []
                for t in range(p.tables):
                    rows.append(np.arange(len(keys))), buckets.append(keys[:, t] | t << p.width), roles.append(np.zeros(len(keys), np.int8))
                    for bit in range(p.width):
                        i = np.flatnonzero((keys[:, t] >> bit) & 1 == 0)
                        rows.append(i), buckets.append(keys[i, t] | t << p.width | 1 << bit), roles.append(np.ones(len(i), np.int8))
                r = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(r), pa.array(np.concatenate(buckets)), pa.array(np.concatenate(roles)), batch.column(0).take(r), batch.column(2).take(r)], ["dim", "bucket", "role", "rep", "code"])

    routed = coded.select("rep", "dim", "code").mapInArrow(route, f"dim int, bucket long, role byte, rep {kind}, code binary")
    # Buckets of many members are cut into blocks. Their number is at most tables * n / BLOCK.
    keys = coded.select("dim", "code").mapInArrow(_members(p), "dim int, bucket long")
    big = keys.groupBy("dim", "bucket").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("dim", "bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    big = common.stored(big, "big")
    if not big.isEmpty():
        mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        first = F.when(F.col("role") == 0, mine).otherwise(F.lit(0))
        marked = routed.join(F.broadcast(big) if big.count() <= MOST_BROADCAST_BUCKETS else big, ["dim", "bucket"], "left").withColumn("mine", F.when(F.col("blocks").isNull(), 0).otherwise(first))
        # A member meets those of its own block there, and those of later blocks as a query.
        deals = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.col("mine"), F.col("blocks") - 1))
        routed = marked.select("dim", "bucket", "mine", "role", "rep", "code", F.explode(deals).alias("deal"))
        routed = routed.select("dim", "bucket", "deal", F.when((F.col("role") == 0) & (F.col("deal") == F.col("mine")), 0).otherwise(1).cast("byte").alias("role"), "rep", "code")
    else:
        routed = routed.select("dim", "bucket", F.lit(0).alias("deal"), "role", "rep", "code")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each bucket that have a candidate in it."""
        for part in _whole_buckets(batches, 3):
            group, role, codes = _numbered(part, 3), part.column(3).to_numpy(zero_copy_only=False), _matrix(part.column(5))
            keys, near = _keys(codes, p), np.zeros(part.num_rows, bool)
            table = part.column(1).to_numpy(zero_copy_only=False) >> p.width
            for q, m in _pairs(group, role):
                ok = np.bitwise_count(codes[q] ^ codes[m]).sum(1, dtype=np.int64) <= p.most
                q, m = q[ok], m[ok]
                ok = _first(keys[q] ^ keys[m], table[q])
                near[q[ok]] = near[m[ok]] = True
            yield part.select([0, 1, 2, 3, 4]).filter(pa.array(near))

    dealt = routed.repartition("dim", "bucket", "deal").sortWithinPartitions("dim", "bucket", "deal", "role")
    wanted = common.stored(dealt.mapInArrow(sift, f"dim int, bucket long, deal int, role byte, rep {kind}"), "candidates")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each class the number of rows it links to, and edges of a spanning forest of the links found in the bucket."""
        for group in common.sorted_groups(batches, 3):
            yield from _bucket(group, threshold, p)

    full = wanted.join(coded.select("rep", "copies", "code", "x"), "rep").select("dim", "bucket", "deal", "role", "rep", "copies", "code", "x")
    full = full.repartition("dim", "bucket", "deal").sortWithinPartitions("dim", "bucket", "deal", "role")
    found = common.stored(full.mapInArrow(compare, f"rep {kind}, links long, other {kind}"), "found")
    common.drop(wanted, coded)
    counts = found.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    comps = common.components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    by_class = classes.select("vk", "rep", "copies").join(counts, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    by_class = by_class.select("vk", F.struct((F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component_id", "rep").alias("comp")).alias("found"), "copies")
    rows = common.with_lookup(own.select("id", "vk"), "vk", common.stored(by_class, "by-class"), "copies", common.hot_limit(n))
    comp = F.when(F.col("id").isNotNull(), F.coalesce(F.col("found.comp"), F.col("id")))
    links = F.coalesce(F.col("found.links"), F.lit(0))
    return rows.select(F.col("id").alias(id_col), links.cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def _members(p: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(_matrix(batch.column(1)), p) | (np.arange(p.tables) << p.width)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), p.tables))), pa.array(keys.ravel())], ["dim", "bucket"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of bytes of equal length."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def _numbered(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Numbers of the groups of a batch that is sorted by its first columns."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
    fresh = np.zeros(batch.num_rows, bool)
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.cumsum(fresh)


def _whole_buckets(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none ends within a group of their first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        number = _numbered(batch, keys)
        same = bool(held) and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(keys))
        cut = int(np.searchsorted(number, number[-1]))  # where the last group starts
        if held and not (same and cut == 0):
            first = int(np.searchsorted(number, 1)) if same else 0
            yield _merged([*held, batch.slice(0, first)])
            held, batch, cut = [], batch.slice(first), cut - first
        if cut > 0:
            yield batch.slice(0, cut)
        held.append(batch.slice(max(cut, 0)))
    if held:
        yield _merged(held)


def _merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _pairs(group: np.ndarray, role: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (q, m) of one group, m a member before q. Members come first in a group."""
    rows = np.arange(len(group))
    start = np.searchsorted(group, group)
    members = np.concatenate(([0], np.cumsum(role == 0)))
    held = members[rows] - members[start]  # members of the group before each row
    total = np.cumsum(held)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        k = held[at:end]
        q = np.repeat(rows[at:end], k)
        if len(q):
            yield q, np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k) + start[q]
        at = end


def _first(differ: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether no table before ``table`` has keys that differ by one bit at most."""
    near = np.bitwise_count(differ) <= 1
    return ~(near & (np.arange(differ.shape[1])[None, :] < table[:, None])).any(1)


def _bucket(batch: pa.RecordBatch, threshold: float, p: Plan) -> Iterator[pa.RecordBatch]:
    role = batch.column(3).to_numpy(zero_copy_only=False)
    m = int((role == 0).sum())
    if m == 0 or len(role) < 2:
        return
    table = int(batch.column(1)[0].as_py()) >> p.width
    keys, copies = _keys(_matrix(batch.column(6)), p), batch.column(5).to_numpy(zero_copy_only=False)
    x = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.float64).reshape(len(role), -1)
    links, root = np.zeros(len(role), np.int64), np.arange(len(role))
    for a in range(0, len(role), BLOCK):
        near = x[a : a + BLOCK] @ x[:m].T >= threshold
        if a < m:  # members among themselves: each pair once
            k = np.arange(a, min(a + BLOCK, m))
            near[: len(k)] &= np.arange(m)[None, :] < k[:, None]
        q, o = np.nonzero(near)
        q += a
        for at in range(0, len(q), 500_000):
            i, j = q[at : at + 500_000], o[at : at + 500_000]
            ok = _first(keys[i] ^ keys[j], np.full(len(i), table))
            i, j = i[ok], j[ok]
            links += np.bincount(i, copies[j], len(links)).astype(np.int64) + np.bincount(j, copies[i], len(links)).astype(np.int64)
            root = common.connected(root, i, j)
    some, child = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
    if len(some):
        rep = batch.column(4)
        reps = pa.concat_arrays([rep.take(pa.array(some)), rep.take(pa.array(child))])
        others = pa.concat_arrays([pa.nulls(len(some), rep.type), rep.take(pa.array(root[child]))])
        yield pa.RecordBatch.from_arrays([reps, pa.array(np.concatenate([links[some], np.zeros(len(child), np.int64)])), others], ["rep", "links", "other"])
