"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each shard holds the term list of a run of documents and, for each term, the ascending
positions of its occurrences. Test windows are answered in each shard by itself: those that lack a term there are set aside; the posting list of the rarest term of each
other one, shifted by the term's offset in the window, is intersected with the lists of its other terms from rare to frequent, each shifted likewise. All windows
of a block are intersected together, array by array, so the work follows the candidates, not the number of windows.
Shards are independent, so neither building nor searching shuffles postings, and a frequent term or a passage shared by many documents
is spread over shards as the documents are. The index is stored as Parquet in the shared folder and can be searched again.

Distinct test windows are gathered by a shuffle into blocks of a fixed number. Blocks are broadcast one after the other, each for one pass over the index, so neither the driver nor a worker holds more than one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
BLOCK_WINDOWS = 250_000
#: How many postings of a shard are unpacked, and how many candidates of windows are looked at, at a time.
POSTINGS, CANDIDATES = 500_000, 200_000
#: Lower-cases A-Z and turns every other ASCII byte that is not a-z or 0-9 into a space; bytes of other characters stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORDS).split() if text else []


def _planes(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their low bytes first, then the next bytes: mostly zeros, which the table's compression removes."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _shard(texts: list[str | None]) -> tuple[bytes, bytes, bytes, bytes]:
    """Term list, posting counts, posting deltas and document lengths. One free position parts neighbouring documents."""
    seen, parts = _Numbers(), []
    for text in texts:
        ws = words(text)
        parts.append(np.fromiter(map(seen.__getitem__, ws), np.int32, len(ws)))
    lengths = np.array([len(x) for x in parts], np.int64)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    del parts
    at = np.arange(len(tokens), dtype=np.int64) + np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(tokens, kind="stable")
    counts = np.bincount(tokens, minlength=len(seen)) if len(tokens) else np.zeros(0, np.int64)
    at = at[order]
    deltas = np.diff(at, prepend=0)
    firsts = np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    deltas[firsts] = at[firsts]
    return b"\n".join(seen), _planes(counts), _planes(deltas), _planes(lengths)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 12 << 20) -> DataFrame:
    """One row per shard of at most ``shard_bytes`` of text (or one longer document): its number, ids, terms, counts, deltas, lengths. Null and empty texts have no words but keep their place."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in common.pieces(batches, "_text", shard_bytes):
            parts = _shard(batch.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, *(pa.array([p], pa.binary()) for p in parts)], ["shard", "ids", "terms", "counts", "deltas", "lengths"])
            number += 1

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"shard long, ids array<{kind}>, terms binary, counts binary, deltas binary, lengths binary")


class Tests:
    """A block of distinct windows: rows of term numbers (-1 beyond a short window), their lengths, and the items of each window."""

    def __init__(self, terms: bytes, rows: bytes, window: int, owners: bytes, ends: bytes, items: list):
        self.number = {t: i for i, t in enumerate(terms.split(b"\n"))}
        self.rows = np.frombuffer(rows, np.int32).reshape(-1, window)
        self.lengths = (self.rows >= 0).sum(1)
        self.owners, self.ends = np.frombuffer(owners, np.int32), np.frombuffer(ends, np.int64)
        self.items = items  # sorted as strings

    def owned(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window given, its place among these and an owner: one row for each owner."""
        first = np.where(windows > 0, self.ends[windows - 1], 0)
        n = self.ends[windows] - first
        at = np.repeat(np.arange(len(windows)), n)
        return at, self.owners[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]


class Shard:
    """A shard in memory with the postings of a block's terms: one sorted array of term number and position."""

    def __init__(self, terms: bytes, counts: bytes, deltas: bytes, lengths: bytes, tests: Tests):
        n, self.lengths = _unplanes(counts), _unplanes(lengths)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)))
        self.tests = tests
        number = np.fromiter((tests.number.get(t, -1) for t in bytes(terms).split(b"\n")) if len(terms) else (), np.int64)
        # Only postings of the block's terms are unpacked, a run of their list at a time.
        known = number >= 0
        edges = np.cumsum(n)
        planes = np.frombuffer(deltas, np.uint8).reshape(4, -1)
        self.keys = np.empty(int(n[known].sum()), np.int64)
        filled = a = 0
        while a < len(n):
            start = int(edges[a] - n[a])
            b = max(a + 1, int(np.searchsorted(edges, start + POSTINGS, side="right")))
            if known[a:b].any():
                d = np.ascontiguousarray(planes[:, start : edges[b - 1]].T).view("<u4").ravel()
                at = np.cumsum(d, dtype=np.int64)
                first = edges[a:b] - n[a:b] - start
                keep = np.repeat(known[a:b], n[a:b])
                keys = (np.repeat(number[a:b][known[a:b]], n[a:b][known[a:b]]) << 32) + at[keep] - np.repeat((at[first] - d[first])[known[a:b]], n[a:b][known[a:b]])
                self.keys[filled : filled + len(keys)] = keys
                filled += len(keys)
            a = b
        self.keys.sort()
        edges = np.searchsorted(self.keys, np.arange(len(tests.number) + 1) << 32)
        self.first, self.count = edges[:-1], np.diff(edges)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def candidates(self, most: int = CANDIDATES):
        """For windows all of whose terms occur here: (window of each candidate, position of its rarest term, columns of the window's terms from rare to frequent), in runs of about ``most``."""
        rows = self.tests.rows
        if not len(self.keys):
            return
        n = np.where(rows >= 0, self.count[rows], np.iinfo(np.int64).max)
        full = np.flatnonzero(n.min(1) > 0)
        order = np.argsort(n[full], axis=1, kind="stable").astype(np.int16)
        anchor = rows[full, order[:, 0]]
        size = self.count[anchor]
        total = np.cumsum(size)
        a = 0
        while a < len(full):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
            k = size[a:b]
            which = np.repeat(np.arange(a, b), k)
            at = self.keys[np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.first[anchor[a:b]], k)] & 0xFFFFFFFF
            yield full[which], at, order[which]
            a = b

    def has(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = terms.astype(np.int64) << 32 | at
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the positions at which their terms stand one after the other."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for w, at, order in self.candidates():
            at = at - order[:, 0]
            ok = at >= 0
            for j in range(1, order.shape[1]):
                w, at, order = w[ok], at[ok], order[ok]
                term = self.tests.rows[w, order[:, j]]
                ok = (term < 0) | self.has(np.maximum(term, 0), at + order[:, j])
            out.append((w[ok], at[ok]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def near(self, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and first positions of spans of their length plus ``slop`` words of one document that hold all their terms, in any order."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        between = lambda term, a, b: np.searchsorted(self.keys, term << 32 | a) < np.searchsorted(self.keys, term << 32 | b)
        for w, at, order in self.candidates():
            span = self.tests.lengths[w] + slop
            ok = np.ones(len(w), bool)
            for j in range(1, order.shape[1]):  # each other term within reach of the rarest one
                w, at, order, span = w[ok], at[ok], order[ok], span[ok]
                term = self.tests.rows[w, order[:, j]].astype(np.int64)
                ok = (term < 0) | between(np.maximum(term, 0), np.maximum(at - span + 1, 0), at + span)
            w, at, order, span = w[ok], at[ok], order[ok], span[ok]
            doc = self.doc_of(at)
            low, high = self.starts[doc], self.starts[doc + 1] - 1
            best = np.full(len(w), -1, np.int64)
            for back in range(int(span.max()) if len(w) else 0):
                a, b = np.maximum(at - back, low), np.minimum(at - back + span, high)
                ok = back < span
                for j in range(1, order.shape[1]):
                    term = self.tests.rows[w, order[:, j]].astype(np.int64)
                    ok &= (term < 0) | between(np.maximum(term, 0), a, b)
                best = np.where(ok, a, best)
            out.append((w[best >= 0], best[best >= 0]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows of all test items: w (its words with a blank between) and the items that hold it."""
    kind = bench.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "_text", 1 << 20):
            out, owner = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ws = words(text)
                found = {b" ".join(ws[k : k + window]) for k in range(max(1, len(ws) - window + 1))} if ws else ()
                out.extend(found)
                owner.extend([i] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(0).take(pa.array(owner, pa.int64()))], ["w", "item"])

    every = bench.select(F.col(item_col).alias("_item"), F.col(text_col).alias("_text")).where("_item IS NOT NULL").mapInArrow(run, f"w binary, item {kind}")
    return every.groupBy("w").agg(F.collect_set("item").alias("items"))


def blocks(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, most: int | None = None) -> DataFrame:
    """The windows as stored blocks of about ``most``: block and the arrays of Tests."""
    found = common.stored(windows(bench, item_col, text_col, window), "windows")
    n = -(-found.count() // (most or BLOCK_WINDOWS))
    kind = found.schema["items"].dataType.simpleString()

    def pack(key, frame):
        import pandas as pd

        number, rows = _Numbers(), np.full((len(frame), window), -1, np.int32)
        for i, w in enumerate(frame.w):
            ws = w.split(b" ")
            rows[i, : len(ws)] = [number[x] for x in ws]
        items = sorted({x for xs in frame["items"] for x in xs}, key=str)
        at = {x: i for i, x in enumerate(items)}
        owners = [np.array([at[x] for x in xs], np.int32) for xs in frame["items"]]
        return pd.DataFrame({"block": [key[0]], "terms": [b"\n".join(number)], "rows": [rows.tobytes()], "owners": [np.concatenate(owners).tobytes()], "ends": [np.cumsum([len(x) for x in owners]).astype(np.int64).tobytes()], "items": [items]})

    return common.stored(found.withColumn("block", F.pmod(F.xxhash64("w"), F.lit(max(1, n))).cast("int")).groupBy("block").applyInPandas(pack, f"block int, terms binary, rows binary, owners binary, ends binary, items {kind}"), "blocks")


def search(index: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int | None = None, matches: bool = True) -> DataFrame:
    """Search every window of the test items in the index; one row per document.

    Returns the id, n_words, n_hit (words inside any occurrence of a window), items (the ids of the items found, distinct, sorted as strings), and on demand
    matches (item, first word from 0, number of words; exact occurrences) and, with ``slop``, near (items whose window's words all stand in some order within
    window + slop words; exact ones are among them). An item of fewer words than a window is one window; without words, or with a null id, it is never found.
    Repeated items are found under each of their ids; repeated documents give repeated rows. Null texts have no words; texts are read whole, however long.
    """
    kind, item_kind = index.schema["ids"].dataType.elementType.simpleString(), bench.schema[item_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    pa_items = to_arrow_type(bench.schema[item_col].dataType)
    pa_match, pa_span = pa.struct([("item", pa_items), ("position", pa.int64()), ("n", pa.int32())]), pa.struct([("a", pa.int64()), ("b", pa.int64())])
    stored = blocks(bench, item_col, text_col, window)
    sc = bench.sparkSession.sparkContext
    found = []
    numbers = sorted(r.block for r in stored.select("block").collect())
    for number in numbers or [None]:
        r = stored.where(F.col("block") == number).first() if number is not None else None
        shared = sc.broadcast((bytes(r.terms), bytes(r["rows"]), window, bytes(r.owners), bytes(r.ends), list(r["items"])) if r else (b"", b"", window, b"", b"", []))  # at most about BLOCK_WINDOWS windows

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = Tests(*shared.value)
            items = pa.array(tests.items, pa_items)
            for batch in batches:
                for row in range(batch.num_rows):
                    get = lambda name: batch.column(batch.schema.get_field_index(name))[row].as_buffer()  # noqa: B023, E731
                    s = Shard(get("terms"), get("counts"), get("deltas"), get("lengths"), tests)
                    n = len(s.lengths)
                    w, at = s.phrases()
                    of, owner = tests.owned(w)
                    doc = s.doc_of(at)
                    columns = [batch.column(1)[row].values, pa.array(np.full(n, batch.column(0)[row].as_py())), pa.array(np.arange(n)), pa.array(s.lengths), _lists(*_spans(at, at + tests.lengths[w], s, doc), n, pa_span), _items(doc[of], owner, items, n)]
                    names = ["_id", "shard", "doc", "n_words", "spans", "items"]
                    if matches:
                        order = np.lexsort((owner, at[of]))
                        of, owner = of[order], owner[order]
                        value = pa.StructArray.from_arrays([items.take(pa.array(owner)), pa.array(at[of] - s.starts[doc[of]]), pa.array(tests.lengths[w[of]].astype(np.int32))], ["item", "position", "n"])
                        columns.append(_lists(doc[of], value, n, pa_match))
                        names.append("matches")
                    if slop is not None:
                        w, at = s.near(slop)
                        of, owner = tests.owned(w)
                        columns.append(_items(s.doc_of(at)[of], owner, items, n))
                        names.append("near")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    del s, columns, w, at, of, owner, doc
                    common.trim()

        schema = f"_id {kind}, shard long, doc long, n_words long, spans array<struct<a:long,b:long>>, items array<{item_kind}>" + f", matches array<struct<item:{item_kind}, position:long, n:int>>" * matches + f", near array<{item_kind}>" * (slop is not None)
        part = index.mapInArrow(run, schema)
        found.append(common.stored(part, "found") if len(numbers) > 1 else part)
        if len(numbers) > 1:
            shared.unpersist()
    out = found[0]
    lists = ["items", *(["near"] if slop is not None else [])]
    if len(found) > 1:
        out = reduce(DataFrame.unionByName, found).groupBy("shard", "doc").agg(F.first("_id").alias("_id"), F.first("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", *lists, *(["matches"] if matches else []))])
        # Spans of all blocks in order, each cut to what lies beyond the ones before.
        out = out.withColumn("spans", F.array_sort("spans")).withColumns({c: F.array_distinct(F.transform(F.array_sort(F.transform(c, lambda x: F.struct(x.cast("string").alias("s"), x.alias("x")))), lambda y: y["x"])) for c in lists})
        if matches:
            out = out.withColumn("matches", F.transform(F.array_sort(F.transform("matches", lambda m: F.struct(m["position"].alias("p"), m["item"].cast("string").alias("s"), m.alias("m")))), lambda y: y["m"]))
    n_hit = F.expr("aggregate(spans, named_struct('n', 0L, 'end', 0L), (s, x) -> named_struct('n', s.n + greatest(0L, x.b - greatest(x.a, s.end)), 'end', greatest(s.end, x.b)), s -> s.n)")
    return out.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", *(["matches"] if matches else []), *(["near"] if slop is not None else []))


def _lists(doc: np.ndarray, values: pa.Array, n: int, kind) -> pa.ListArray:
    """One list for each of n documents; values of a document in the order in which they come."""
    order = np.argsort(doc, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))) if len(doc) else np.zeros(n + 1, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values.take(pa.array(order)).cast(kind))


def _items(doc: np.ndarray, owner: np.ndarray, items: pa.Array, n: int) -> pa.ListArray:
    both = np.unique(doc.astype(np.int64) << 32 | owner)
    return _lists(both >> 32, items.take(pa.array(both & 0xFFFFFFFF)), n, items.type)


def _spans(first: np.ndarray, end: np.ndarray, s: Shard, doc: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The union of stretches of words as disjoint spans: their documents and, counted in these, first words and ends."""
    order = np.lexsort((end, first))
    first, end, doc = first[order], end[order], doc[order]
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.concatenate(([True], first[1:] > reach[:-1])) if len(first) else np.zeros(0, bool)  # spans of two documents never touch
    heads = np.flatnonzero(new)
    tails = np.concatenate((heads[1:], [len(first)])) - 1 if len(heads) else heads
    base = s.starts[doc[heads]]
    return doc[heads], pa.StructArray.from_arrays([pa.array(first[heads] - base), pa.array(reach[tails] - base)], ["a", "b"])


def items_digest(items) -> F.Column:
    return F.sha2(F.array_join(F.transform(items, lambda x: x.cast("string")), ","), 256)


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_items: int = 2, stored_index: DataFrame | None = None) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items, items_sha256 and contaminated (at least ``min_items`` items occur). An empty test set finds nothing; an empty table gives an empty table; further columns, whatever their names, are not read."""
    index = stored_index if stored_index is not None else common.stored(build_index(docs, id_col, text_col), "postings")
    found = search(index, bench, id_col, item_col, text_col, matches=False)
    return found.select(common.quoted(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", items_digest(F.col("items")).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same result by looking at every window of every text; for tests."""
    out = []
    tests = {}
    for i, text in items:
        ws = words(text)
        for k in range(max(1, len(ws) - window + 1)) if ws else ():
            tests.setdefault(tuple(ws[k : k + window]), set()).add(i)
    for d, text in docs:
        ws = words(text)
        hit, got = set(), set()
        for n in {len(w) for w in tests}:
            for k in range(len(ws) - n + 1):
                if (owners := tests.get(tuple(ws[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    got |= owners
        out.append((d, len(ws), len(hit), len(got), hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest(), len(got) >= 2))
    return out
