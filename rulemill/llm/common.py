"""Helpers shared by the training-data operators: shared tables, batches, splits and skew-safe lookups."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_dir

_WRITTEN: list[tuple[SparkSession, str]] = []

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may be gone by now
            return


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, before the driver ends."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            remove(df.sparkSession, path)


def local_path(uri: str) -> str:
    """The POSIX path of a shared folder that all machines mount; model files are memory-mapped from there."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return uri
    raise ValueError(f"memory-mapped models need a mounted shared folder (file:), not {uri}")


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo ``mod``: the split rule of every contract here. A null id counts as remainder -1."""
    return F.coalesce(F.crc32(quoted(column).cast("string")) % mod, F.lit(-1))


def with_lookup(rows: DataFrame, key: str, found: DataFrame, count: str, hot: int) -> DataFrame:
    """Left-join ``found`` (one row per key, with the number of rows of that key in ``count``) to ``rows`` without a hot key in one task.

    Keys of at least ``hot`` rows go by broadcast; since counts add up to at most the rows of the input, there are at most
    rows / hot of them. The caller sets hot to a fixed share of the rows, so the broadcast holds a fixed number of keys.
    All other keys are joined by a shuffle in which rows of hot keys are spread by a random-like hash of the row.
    """
    values = [c for c in found.columns if c not in (key, count)]
    big = found.where(F.col(count) >= hot).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv"))
    small = found.where(F.col(count) < hot).select(F.col(key).alias("_ck"), F.struct(*values).alias("_cv"))
    spread = F.xxhash64(*[c for c in rows.columns]).cast("string")
    marked = rows.join(F.broadcast(big), F.col(key) == F.col("_hk"), "left").withColumn(
        "_jk", F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), F.concat(F.lit("h"), spread)).otherwise(F.concat(F.lit("c"), F.col(key).cast("string")))
    )
    joined = marked.join(small.select(F.concat(F.lit("c"), F.col("_ck").cast("string")).alias("_jk"), "_cv"), "_jk", "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col("_hv")[v], F.col("_cv")[v]).alias(v) for v in values])


def hot_limit(n: int, share: int = 1000, least: int = 64) -> int:
    """A key is hot from this number of rows on; at most ``share`` keys can be."""
    return max(least, math.ceil(n / share))


def texts(batch, column: int = 1) -> list[str]:
    """A text column of an Arrow batch as str, null as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def pieces(batches: Iterator, column: str, most: int = 1 << 25) -> Iterator:
    """Cut Arrow batches so that each holds about ``most`` bytes of ``column``; one row is never cut. Freed memory goes back to the system after each batch."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)
        del batch
        trim()


def trim() -> None:
    """Give freed memory back to the system: workers live on between stages, beside an executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (id, component_id) per vertex, the smallest id it reaches.

    Alternating large-star and small-star passes (Kiveris et al. 2014): each pass rewires every edge towards the smallest
    neighbour, so the graph turns into stars after a number of passes that grows as the logarithm of its size. Both passes only
    group by vertex with a minimum (a partial aggregate) and join that back, so a vertex with many edges never sits in one task. Before the first pass each task turns its own edges into stars, which
    saves most of the passes.
    """
    own = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    own = stored(own.mapInArrow(_stars, own.schema).distinct(), "edges")
    last = None
    for _ in range(rounds):
        total = own.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if total.n == 0 or (total.n, total.s) == last:
            break
        last = (total.n, total.s)
        star = stored(_large_star(own, total.n), "star")
        before, own = own, stored(_small_star(star, total.n), "edges")
        drop(before, star)
    else:
        raise RuntimeError("components did not settle")
    roots = own.select(F.col("v").alias("id")).distinct()
    return own.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots.select("id", F.col("id").alias("component_id")))


def _stars(batches: Iterator) -> Iterator:
    """The edges (u, v) of a task as edges from each vertex to the smallest one that it reaches by them, about a million at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def stars(parts):
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        ids = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        rank = np.empty(len(ids.dictionary), np.int64)
        order = pc.sort_indices(ids.dictionary).to_numpy()
        rank[order] = np.arange(len(order))
        u, v = np.split(rank[ids.indices.to_numpy()], 2)
        root = connected(np.arange(len(order)), u, v)
        child = np.flatnonzero(root != np.arange(len(order)))
        take = lambda at: ids.dictionary.take(pa.array(order[at]))
        for at in range(0, len(child), 100_000):
            part = child[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([take(part), take(root[part])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 1_000_000:
            yield from stars(held)
            held, n = [], 0
    yield from stars(held)


def connected(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number of each number's component, with the edges (i, j) added to the components that ``root`` names: whole arrays at a time, in about log(numbers) rounds."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Join every larger neighbour of a vertex to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
    return with_lookup(both, "u", least, "_n", hot_limit(2 * n)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Join every smaller neighbour of a vertex, and the vertex itself, to its smallest neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    near = with_lookup(edges, "u", least, "_n", hot_limit(n)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


class Memo(dict):
    """Values by key, made when first asked for. Between batches, once it holds ``most`` keys, they become its older half, from which those still asked for come back."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


def bounded_sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """All rows, or about ``most`` of them picked by a hash of the id where there are more. Only for fitting on labelled rows."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 40)) < int((1 << 40) * most / n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts (_text) with labels (_y) of at most about ``most`` documents outside the held-out split.

    A document with several label rows gets the larger label; null labels and ids are left out. Only the bounded sample of ids is broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, mod) != held)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    picked = bounded_sample(stored(known, "labels"), "_id", most)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id").select("_text", "_y")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each session, so that they need no installation or path of their own, and keep Arrow batches of texts small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default: 10,000 long texts are too much for one batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default: a worker holds a batch or two beside what it makes of one row
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16777216b")
    sc = spark.sparkContext
    if getattr(sc, "_rulemill_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp()  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "rulemill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(os.path.join(top, "rulemill")):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), top))
    sc.addPyFile(path)
    sc._rulemill_shipped = True


def sorted_groups(batches: Iterator, keys: int) -> Iterator:
    """Cut a partition that is sorted by its first ``keys`` integer columns into one record batch per key."""
    import pyarrow as pa

    def joined(parts):
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)], 1)
        cuts = np.flatnonzero(np.concatenate(([True], (columns[1:] != columns[:-1]).any(1))))
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            key = tuple(columns[a])
            if held and key != last:
                yield joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield joined(held)


def free(name: str, columns: list[str]) -> str:
    """A column name that differs from all of ``columns``, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_probability(docs: DataFrame, probability, text_col: str, columns: list[str]) -> DataFrame:
    """The named columns as _k0, _k1 and so on, and _score. ``probability()`` gives, in a worker, a function of a list of texts."""
    import pyarrow as pa

    names = [f"_k{i}" for i in range(len(columns))]
    text = names[columns.index(text_col)] if text_col in columns else "_text"

    def run(batches: Iterator) -> Iterator:
        score = probability()
        for batch in pieces(batches, text, 8 << 20):
            p = pa.array(score(batch.column(batch.schema.get_field_index(text)).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), p], [*names, "_score"])

    source = docs.select(*[quoted(c).alias(n) for c, n in zip(columns, names, strict=True)], *([] if text_col in columns else [quoted(text_col).alias("_text")]))
    schema = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for c, n in zip(columns, names, strict=True)), T.StructField("_score", T.DoubleType())])
    return source.mapInArrow(run, schema)


def scored(docs: DataFrame, probability, id_col: str, text_col: str, mod: int, held: int, threshold: float, keep: list[str] | None) -> DataFrame:
    """id, the columns named in ``keep``, held_out, score and predicted. A column of ``keep`` that is named like one of these results is left out."""
    taken = {id_col.lower(), "held_out", "score", "predicted"}
    columns = [id_col, *(c for c in docs.columns if c in (keep or []) and c.lower() not in taken)]
    out = with_probability(docs, probability, text_col, columns)
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(columns)]
    return out.select(*kept, (crc_mod("_k0", mod) == held).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def passing(docs: DataFrame, probability, text_col: str, test) -> DataFrame:
    """Rows of docs whose score passes ``test`` (a function of its column), with all columns of docs, whatever their names, and no other."""
    out = with_probability(docs, probability, text_col, docs.columns).where(test(F.col("_score")))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])


def without(docs: DataFrame, ids: DataFrame, id_col: str, most: int = 500_000) -> DataFrame:
    """Rows of docs whose id is not in ids (one column). Up to ``most`` ids are broadcast; more are joined by a shuffle. Null ids stay. Columns of docs may have any names."""
    gone = free("_gone", docs.columns)
    ids = stored(ids.select(F.col(ids.columns[0]).alias(gone)).where(F.col(gone).isNotNull()).distinct(), "gone")
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, quoted(id_col) == F.col(gone), "left_anti")
