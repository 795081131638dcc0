"""Interpolated modified Kneser-Ney model of order two or three: counted in Spark, stored as sorted hash arrays, memory-mapped for perplexity.

Three passes over the texts, four at order three, each of which adds up in its tasks with numpy and shuffles packed, sorted arrays, one for each task and shard:

1. words: the 64-bit hashes of all training words with their counts, in shards by the leading bits of the hash. A word's id is its rank among all hashes.
2. pairs: ids of neighbouring words as one number, with counts, in shards by the first word (by both where the first is very frequent), and from
   them how many followers of each count a word has, and how many words precede it, in shards by id.
3. triples (order three): the number of their first two words' pair and the last word's id as one number, in the shard of that pair. From them, how many followers of each
   count a pair has, and how many words precede it, which is the count that the pairs then go by (their own where they start with the begin).
4. scores: each worker maps the arrays from the shared folder and looks up the distinct words, pairs and triples of a batch by binary search.

All arrays are files in the shared folder, which every machine mounts. Each attempt of a task writes files of its own, and only those named by the
successful attempts are used.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BEGIN, END, FIRST = 0, 1, 2
PAIRS_PER_SHARD = 1_500_000
HOT_SHARE = 1000
#: A task deals its sums to at most so many receivers; where there are more shards, each receiver stands for a run of them and deals again.
FAN = 1024
DEALT = "shard int, keys binary, counts binary, docs long"


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each."""
    from xxhash import xxh3_64_intdigest

    parts = []
    for text in texts:
        ws = text.encode().translate(common.LOWER).split() if text else []
        parts.append(np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, len(ws)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and the place of each number among them; by hashing, for numbers that repeat often."""
    d = pa.array(x).dictionary_encode()
    u = d.dictionary.to_numpy()
    order = np.argsort(u)
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return u[order], place[d.indices.to_numpy()]


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    k, c = (keys[0], counts[0]) if len(keys) == 1 else (np.concatenate(keys), np.concatenate(counts))
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c, first)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Differences of sorted keys and the counts, byte plane by byte plane, which compresses well."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


class _Sums:
    """Keys and counts gathered in a task, added up whenever many are pending."""

    def __init__(self, most: int = 2_000_000):
        self.keys, self.counts, self.pending, self.most = [], [], 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.pending += len(keys)
        if self.pending > self.most:
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            k, c = add_up(self.keys, self.counts)
            self.keys, self.counts = [k], [c]
        self.pending = 0
        return (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _save(folder: str, array: np.ndarray) -> str:
    os.makedirs(folder, exist_ok=True)
    name = uuid.uuid4().hex
    with open(f"{folder}/{name}.tmp", "wb") as f:
        array.tofile(f)
    os.replace(f"{folder}/{name}.tmp", f"{folder}/{name}")
    return name


def _map(folder: str, name: str, kind) -> np.ndarray:
    path = f"{folder}/{name}"
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def _save_small(folder: str, array: np.ndarray) -> str:
    """Counts as single bytes; those of 255 or more in a second file with their places."""
    name = _save(folder, np.minimum(array, 255).astype(np.uint8))
    at = np.flatnonzero(array >= 255)
    if len(at):
        os.replace(f"{folder}/{_save(folder, np.concatenate([at, array[at]]).astype(np.int64))}", f"{folder}/{name}.large")
    return name


class _Small:
    """Counts saved by ``_save_small``, mapped."""

    def __init__(self, folder: str, name: str):
        self.bytes = _map(folder, name, np.uint8)
        self.places, self.values = _map(folder, f"{name}.large", np.int64).reshape(2, -1) if os.path.exists(f"{folder}/{name}.large") else np.zeros((2, 0), np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.bytes[at].astype(np.int64)
        large = out == 255
        out[large] = self.values[np.searchsorted(self.places, at[large])]
        return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of items counted once to four times; plain defaults where one of them is missing."""
    if min(n) <= 0:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), k)) for k in (1, 2, 3))


@dataclass
class Model:
    folder: str
    vocab: list[tuple[str, str, int]]  # files of hashes and counts, number of words, by shard
    n_words: int
    n_tokens: int
    n_docs: int
    pairs: list[tuple[str, str]] = field(default_factory=list)
    ids: list[tuple[str, int, int]] = field(default_factory=list)  # file, first id, number of ids
    pair_discounts: tuple = (0.5, 0.75, 0.9)
    single_discounts: tuple = (0.5, 0.75, 0.9)
    single_kinds: tuple = (0, 0, 0)  # words preceded by one, two, more words
    pair_types: int = 0
    order: int = 2
    # Of order three alone, by shard of pairs: first number of a pair, triples with counts, files of a pair's followers counted once, twice, more often, and of its adjusted count.
    pair_starts: list[int] = field(default_factory=list)
    triples: list[tuple[str, str]] = field(default_factory=list)
    kinds: list[tuple[str, str, str]] = field(default_factory=list)
    adjusted: list[str] = field(default_factory=list)
    triple_discounts: tuple = (0.5, 0.75, 0.9)

    @property
    def bits(self) -> int:
        """Bits of a word's id in the number of a triple, which is its pair's number and the last word's id."""
        return (self.n_words + FIRST).bit_length()

    @property
    def distinct(self) -> int:
        """Distinct training tokens, the end among them."""
        return self.n_words + (self.n_docs > 0)


class Arrays:
    """The model's files, mapped."""

    def __init__(self, m: Model):
        self.m = m
        self.words = [(_map(m.folder, k, np.uint64), _map(m.folder, c, np.uint64)) for k, c, _ in m.vocab]
        self.offsets = np.concatenate(([0], np.cumsum([n for _, _, n in m.vocab]))).astype(np.int64) + FIRST
        self.bits = max(0, (len(m.vocab) - 1).bit_length())
        self.pairs = [(_map(m.folder, k, np.uint64), _Small(m.folder, c)) for k, c in m.pairs]
        self.ids = [_map(m.folder, f, np.int64).reshape(-1, 5) for f, _, _ in m.ids]
        self.id_starts = np.array([s for _, s, _ in m.ids], np.int64)
        self.pair_starts = np.array(m.pair_starts, np.int64)
        self.triples = [(_map(m.folder, k, np.uint64), _Small(m.folder, c)) for k, c in m.triples]
        self.kinds = [[_Small(m.folder, f) for f in fs] for fs in m.kinds]
        self.adjusted = [_Small(m.folder, f) for f in m.adjusted]
        small = [x for fs in self.kinds for x in fs] + self.adjusted + [c for _, c in self.pairs] + [c for _, c in self.triples]
        self.maps = [x for pair in self.words for x in pair] + [k for k, _ in self.pairs] + [k for k, _ in self.triples] + self.ids + [x.bytes for x in small]

    def release(self) -> None:
        """Let go of the pages that were read; the files stay mapped. So a worker's memory follows a batch, not the model."""
        import mmap

        for x in self.maps:
            if (held := getattr(x, "_mmap", None)) is not None:
                held.madvise(mmap.MADV_DONTNEED)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(shard, np.arange(len(self.words) + 1))
        for s, (keys, ns) in enumerate(self.words):
            a, b = edges[s], edges[s + 1]
            if a == b or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
            ok = keys[at] == hashes[a:b]
            ids[a:b][ok] = at[ok] + self.offsets[s]
            counts[a:b][ok] = ns[at[ok]]
        return ids, counts

    def pair_counts(self, pairs: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs."""
        out = np.zeros(len(pairs), np.int64)
        if not self.pairs:
            return out
        for s, i in _by_shard(shard_of(pairs, hot, len(self.pairs)), len(self.pairs)):
            keys, ns = self.pairs[s]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pairs[i]), len(keys) - 1)
                ok = keys[at] == pairs[i]
                out[i[ok]] = ns[at[ok]]
        return out

    def pair_numbers(self, pairs: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct pairs among all, shard by shard; -1 for unknown ones."""
        out = np.full(len(pairs), -1, np.int64)
        for s, i in _by_shard(shard_of(pairs, hot, len(self.pairs)), len(self.pairs)):
            keys = self.pairs[s][0]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pairs[i]), len(keys) - 1)
                ok = keys[at] == pairs[i]
                out[i[ok]] = at[ok] + self.pair_starts[s]
        return out

    def of_pairs(self, numbers: np.ndarray, *reads) -> list[np.ndarray]:
        """What each ``read(shard, places)`` has for numbers of known pairs."""
        out = [np.zeros(len(numbers), np.int64) for _ in reads]
        for s, i in _by_shard(self.pair_shard(numbers), len(self.pairs)):
            at = numbers[i] - self.pair_starts[s]
            for x, read in zip(out, reads, strict=True):
                x[i] = read(s, at)
        return out

    def pair_shard(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pair_starts, numbers, side="right") - 1

    def triple_counts(self, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Counts of triples, given as numbers of known pairs and ids of known words."""
        out = np.zeros(len(pairs), np.int64)
        wanted = pairs.astype(np.uint64) << np.uint64(self.m.bits) | words.astype(np.uint64)
        for s, i in _by_shard(self.pair_shard(pairs), len(self.pairs)):
            keys, ns = self.triples[s]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted[i]), len(keys) - 1)
                ok = keys[at] == wanted[i]
                out[i[ok]] = ns[at[ok]]
        return out

    def followers(self, ids: np.ndarray) -> np.ndarray:
        """Numbers for each of the sorted ids: followers seen once, twice, more often, distinct predecessors, sum of the followers' counts; at order three these are of adjusted counts."""
        out = np.zeros((len(ids), 5), np.int64)
        edges = np.searchsorted(ids, [*self.id_starts, 1 << 62])
        for s, rows in enumerate(self.ids):
            a, b = edges[s], edges[s + 1]
            if a < b:
                at = ids[a:b] - self.id_starts[s]
                ok = at < len(rows)
                out[a:b][ok] = rows[at[ok]]
        return out

    def hot(self, counts: np.ndarray) -> np.ndarray:
        return counts * HOT_SHARE >= max(self.m.n_tokens, 1)


def shard_of(pairs: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """By the first word; by both words where the first is very frequent, so that no shard has to hold all pairs of one."""
    key = np.where(hot, pairs, pairs >> np.uint64(32))
    return (_mix(key + np.uint64(1)) >> np.uint64(33)).astype(np.int64) % shards


def _dealt(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their shards, and where each shard's places start."""
    if shards <= 1 << 16:
        shard = shard.astype(np.uint16)  # sorted by radix
    return np.argsort(shard, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=shards))))


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order, edges = _dealt(shard, shards)
    for s in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(s), order[edges[s] : edges[s + 1]]


_OPEN: dict[str, Arrays] = {}


def arrays(m: Model) -> Arrays:
    if m.folder not in _OPEN or len(_OPEN[m.folder].pairs) != len(m.pairs) or len(_OPEN[m.folder].ids) != len(m.ids) or len(_OPEN[m.folder].pair_starts) != len(m.pair_starts):
        _OPEN.clear()
        _OPEN[m.folder] = Arrays(m)
    return _OPEN[m.folder]


def sequence(a: Arrays, texts: list[str | None]):
    """Ids and counts of all tokens with a begin before and an end after each text: (ids, counts, starts of texts, word numbers)."""
    h, n = tokens(texts)
    u, back = _distinct(h)
    ids, counts = a.look_up(u)
    size = int(n.sum()) + 2 * len(n)
    starts = np.concatenate(([0], np.cumsum(n + 2)))[:-1].astype(np.int64)
    seq, cnt = np.empty(size, np.int64), np.empty(size, np.int64)
    inner = np.ones(size, bool)
    inner[starts] = False
    inner[starts + n + 1] = False
    seq[inner], cnt[inner] = ids[back], counts[back]
    seq[starts], cnt[starts] = BEGIN, a.m.n_docs
    seq[starts + n + 1], cnt[starts + n + 1] = END, a.m.n_docs
    return seq, cnt, starts, n


def fit(docs: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """Count all of docs, at order two or three. An empty table gives a model that knows no word."""
    if order not in (2, 3):
        raise ValueError("the order must be 2 or 3")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("_text"))
    uri = common.shared_path(spark, "lm")
    folder = common.local_path(uri)
    shards = 1 << max(3, (texts.rdd.getNumPartitions() // 2).bit_length())
    bits = shards.bit_length() - 1
    words_per = _per(shards)
    word_shard = lambda k: (k >> np.uint64(64 - bits)).astype(np.int64)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n_docs = _Sums(), 0
        for batch in common.pieces(batches, "_text", 4 << 20):
            h, _ = tokens(batch.column(0).to_pylist())
            sums.add(*np.unique(h, return_counts=True))
            n_docs += batch.num_rows
        k, c = sums.result()
        yield from _dealt_out(k, c, word_shard(k), shards, n_docs, words_per)

    def store_words(key, frame):
        import pandas as pd

        k, c = _merge(frame)
        return pd.DataFrame({"shard": [key[0]], "keys": [_save(folder, k)], "counts": [_save(folder, c.astype(np.uint64))], "n": [len(k)], "tokens": [int(c.sum())], "docs": [int(frame.docs.sum())]})

    got = common.stored(_dealt_again(texts.mapInArrow(count_words, DEALT), word_shard, shards).groupBy("shard").applyInPandas(store_words, "shard int, keys string, counts string, n long, tokens long, docs long"), "words").collect()
    by = {r.shard: r for r in got}
    n_docs = sum(r.docs for r in got)
    empty = None
    vocab = []
    for s in range(shards):
        if s in by:
            vocab.append((by[s]["keys"], by[s]["counts"], by[s].n))
        else:
            empty = empty or _save(folder, np.zeros(0, np.uint64))
            vocab.append((empty, empty, 0))
    n_words = sum(v[2] for v in vocab)
    if n_words + FIRST >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    model = Model(folder, vocab, n_words, sum(r.tokens for r in got) + n_docs, n_docs, order=order)
    if not n_docs:
        return model
    first = spark.sparkContext.broadcast(model)  # names of files and a few numbers for each shard
    parts = max(8, -(-model.n_tokens // PAIRS_PER_SHARD))
    ranges = min(FAN, max(1, -(-(n_words + FIRST) // (1 << 18))))
    width = -(-(n_words + FIRST) // ranges)

    pairs_per = _per(parts)

    def pair_shard(k: np.ndarray) -> np.ndarray:
        return shard_of(k, _hot_first(arrays(first.value), k), parts)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, sums = arrays(first.value), _Sums()
        for batch in common.pieces(batches, "_text", 4 << 20):
            seq, _, starts, n = sequence(a, batch.column(0).to_pylist())
            keep = np.ones(len(seq), bool)
            keep[starts + n + 1] = False
            keep = np.flatnonzero(keep)
            sums.add(*np.unique(seq[keep].astype(np.uint64) << np.uint64(32) | seq[keep + 1].astype(np.uint64), return_counts=True))
            a.release()
        k, c = sums.result()
        yield from _dealt_out(k, c, pair_shard(k), parts, 0, pairs_per)

    def profile(k, c):
        """For the words of sorted pairs with counts: rows of followers by count, and of predecessors, by range of ids."""
        rows = []
        one = (k >> np.uint64(32)).astype(np.int64)
        two = (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1]))) if len(one) else np.zeros(0, np.int64)
        firsts = one[heads]
        kinds = [np.add.reduceat((x).astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64) for x in (c == 1, c == 2, c >= 3, c)]
        seconds, before = np.unique(two, return_counts=True)
        for r in range(ranges):
            lo, hi = r * width, (r + 1) * width
            p, q = np.searchsorted(firsts, [lo, hi])
            s, t = np.searchsorted(seconds, [lo, hi])
            if p < q or s < t:
                x = np.stack([firsts[p:q] - lo, *(v[p:q] for v in kinds)]).astype(np.int64)
                y = np.stack([seconds[s:t] - lo, before[s:t]]).astype(np.int64)
                rows.append({"kind": 1, "range": r, "ids": None, "values": None, "stats": None, "a": x.tobytes(), "b": y.tobytes()})
        return rows

    def store_pairs(key, frame):
        import pandas as pd

        k, c = _merge(frame)
        rows = [{"kind": 0, "range": key[0], "ids": _save(folder, k), "values": _save_small(folder, c), "stats": [len(k), *(int((c == i).sum()) for i in (1, 2, 3, 4))], "a": None, "b": None}]
        if order == 2:
            rows += profile(k, c)
        return pd.DataFrame(rows)

    pairs = common.stored(_dealt_again(texts.mapInArrow(count_pairs, DEALT), pair_shard, parts).groupBy("shard").applyInPandas(store_pairs, "kind int, range int, ids string, values string, stats array<long>, a binary, b binary"), "pairs")
    files = {r.range: r for r in pairs.where("kind = 0").select("range", "ids", "values", "stats").collect()}
    none_k, none_c = _save(folder, np.zeros(0, np.uint64)), _save_small(folder, np.zeros(0, np.int64))
    model.pairs = [(files[s].ids, files[s]["values"]) if s in files else (none_k, none_c) for s in range(parts)]
    stats = np.array([r.stats for r in files.values()]).sum(0)
    model.pair_types, model.pair_discounts = int(stats[0]), _discounts([int(x) for x in stats[1:]])

    def store_ids(key, frame):
        import pandas as pd

        lo = key[0] * width
        rows = np.zeros((min(width, n_words + FIRST - lo), 5), np.int64)
        for a, b in zip(frame.a, frame.b, strict=True):
            x, y = np.frombuffer(a, np.int64).reshape(5, -1), np.frombuffer(b, np.int64).reshape(2, -1)
            np.add.at(rows, x[0], x[1:].T[:, [0, 1, 2, 3, 3]] * np.array([1, 1, 1, 0, 1]))
            np.add.at(rows[:, 3], y[0], y[1])
        c = rows[:, 3]
        return pd.DataFrame({"range": [key[0]], "file": [_save(folder, rows)], "n": [len(rows)], "stats": [[*(int((c == i).sum()) for i in (1, 2, 3, 4)), int((c >= 3).sum())]]})

    if order == 3:
        pairs = _fit_triples(model, texts, [int(files[s].stats[0]) if s in files else 0 for s in range(parts)], profile)
    ids = common.stored(pairs.where("kind = 1").select("range", "a", "b").groupBy("range").applyInPandas(store_ids, "range int, file string, n long, stats array<long>"), "ids").collect()
    model.ids = [(r.file, r.range * width, r.n) for r in sorted(ids, key=lambda r: r.range)]
    singles = np.array([r.stats for r in ids]).sum(0)
    model.single_discounts, model.single_kinds = _discounts([int(x) for x in singles[:4]]), (int(singles[0]), int(singles[1]), int(singles[4]))
    return model


def _fit_triples(model: Model, texts: DataFrame, sizes: list[int], profile) -> DataFrame:
    """Count triples in the shard of their first two words; then how many words precede each pair, which is its adjusted count (its own where it starts with the begin).

    Returns the profiles of the adjusted pairs. ``sizes`` are the numbers of pairs by shard.
    """
    spark, folder, parts = texts.sparkSession, model.folder, len(sizes)
    model.pair_starts = [int(x) for x in np.concatenate(([0], np.cumsum(sizes)[:-1]))]
    if sum(sizes).bit_length() + model.bits > 64:
        raise ValueError("too many pairs and words for 64-bit numbers of triples")
    shared, bits, per = spark.sparkContext.broadcast(model), np.uint64(model.bits), _per(parts)

    def triple_shard(k: np.ndarray) -> np.ndarray:
        return arrays(shared.value).pair_shard((k >> bits).astype(np.int64))

    def number_shard(k: np.ndarray) -> np.ndarray:
        return arrays(shared.value).pair_shard(k.astype(np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, sums = arrays(shared.value), _Sums()
        for batch in common.pieces(batches, "_text", 4 << 20):
            seq, _, starts, n = sequence(a, batch.column(0).to_pylist())
            keep = np.ones(len(seq), bool)
            keep[starts + n] = keep[starts + n + 1] = False
            at = np.flatnonzero(keep)
            u, back = np.unique(seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1].astype(np.uint64), return_inverse=True)
            first = a.pair_numbers(u, _hot_first(a, u))[back].astype(np.uint64)
            sums.add(*np.unique(first << bits | seq[at + 2].astype(np.uint64), return_counts=True))
            a.release()
        k, c = sums.result()
        yield from _dealt_out(k, c, triple_shard(k), parts, 0, per)

    def store(key, frame):
        import pandas as pd

        a, s = arrays(shared.value), key[0]
        k, c = _merge(frame)
        pair = (k >> bits).astype(np.int64) - a.pair_starts[s]
        kinds = [_save_small(folder, np.bincount(pair[x], minlength=sizes[s])) for x in (c == 1, c == 2, c >= 3)]
        rows = [{"kind": 0, "shard": s, "files": [_save(folder, k), _save_small(folder, c), *kinds], "stats": [int((c == i).sum()) for i in (1, 2, 3, 4)], "keys": None, "counts": None}]
        ends = a.pairs[s][0][pair] << np.uint64(32) | k & np.uint64((1 << int(bits)) - 1)
        u, n = np.unique(ends, return_counts=True)
        numbers = a.pair_numbers(u, _hot_first(a, u))
        order = np.argsort(numbers)
        numbers, n = numbers[order].astype(np.uint64), n[order]
        for t, keys, counts, _ in _packed(numbers, n, number_shard(numbers) // per, -(-parts // per), 0):
            rows.append({"kind": 1, "shard": t, "files": None, "stats": None, "keys": keys, "counts": counts})
        a.release()
        return pd.DataFrame(rows)

    def adjust(key, frame):
        import pandas as pd

        a, s = arrays(shared.value), key[0]
        k, own = a.pairs[s]
        c = np.zeros(len(k), np.int64)
        numbers, n = _merge(frame)
        c[numbers.astype(np.int64) - a.pair_starts[s]] = n
        begin = np.flatnonzero(k >> np.uint64(32) == BEGIN)
        c[begin] = own[begin]
        return pd.DataFrame([{"kind": 0, "range": s, "ids": _save_small(folder, c), "stats": [int((c == i).sum()) for i in (1, 2, 3, 4)], "a": None, "b": None}, *({x: r[x] for x in ("kind", "range", "ids", "stats", "a", "b")} for r in profile(np.asarray(k), c))])

    triples = common.stored(_dealt_again(texts.mapInArrow(count, DEALT), triple_shard, parts).groupBy("shard").applyInPandas(store, "kind int, shard int, files array<string>, stats array<long>, keys binary, counts binary"), "triples")
    files = {r.shard: r for r in triples.where("kind = 0").select("shard", "files", "stats").collect()}
    none = _save(folder, np.zeros(0, np.uint64))
    zeros = {n: _save_small(folder, np.zeros(n, np.int64)) for n in {sizes[s] for s in range(parts) if s not in files}}
    model.triples = [tuple(files[s].files[:2]) if s in files else (none, none) for s in range(parts)]
    model.kinds = [tuple(files[s].files[2:]) if s in files else (zeros[sizes[s]],) * 3 for s in range(parts)]
    model.triple_discounts = _discounts([int(x) for x in np.array([[0] * 4, *(r.stats for r in files.values())]).sum(0)])
    before = _dealt_again(triples.where("kind = 1").select("shard", "keys", "counts", F.lit(0).cast("long").alias("docs")), number_shard, parts)
    nothing = F.lit(b"")
    every = spark.range(parts).select(F.col("id").cast("int").alias("shard"), nothing.alias("keys"), nothing.alias("counts"), F.lit(0).cast("long").alias("docs"))
    out = common.stored(before.unionByName(every).groupBy("shard").applyInPandas(adjust, "kind int, range int, ids string, stats array<long>, a binary, b binary"), "adjusted")
    done = {r.range: r for r in out.where("kind = 0").select("range", "ids", "stats").collect()}
    model.adjusted = [done[s].ids for s in range(parts)]
    model.pair_discounts = _discounts([int(x) for x in np.array([r.stats for r in done.values()]).sum(0)])
    return out


def _hot_first(a: Arrays, pairs: np.ndarray) -> np.ndarray:
    """Whether the first word of each sorted pair is very frequent; the begin always counts as such."""
    one = (pairs >> np.uint64(32)).astype(np.int64)
    counts = np.zeros(len(one), np.int64)
    edges = np.searchsorted(one, a.offsets)
    for s, (_, ns) in enumerate(a.words):
        x, y = edges[s], edges[s + 1]
        if x < y:
            counts[x:y] = ns[one[x:y] - a.offsets[s]]
    return a.hot(counts) | (one == BEGIN)


def _per(shards: int) -> int:
    """How many shards a receiver stands for. Found on the driver, so that all tasks agree."""
    return -(-shards // FAN)


def _packed(k: np.ndarray, c: np.ndarray, shard: np.ndarray, shards: int, n_docs: int, first: int = 0) -> Iterator[tuple[int, bytes, bytes, int]]:
    order, edges = _dealt(shard, shards)
    for s in range(shards):
        i = order[edges[s] : edges[s + 1]]
        if len(i) or n_docs:
            yield first + s, *_pack(k[i], c[i]), n_docs
            n_docs = 0


def _dealt_out(k: np.ndarray, c: np.ndarray, shard: np.ndarray, shards: int, n_docs: int, per: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys and counts, packed, by run of ``per`` shards."""
    for s, keys, counts, n in _packed(k, c, shard // per, -(-shards // per), n_docs):
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([keys], pa.binary()), pa.array([counts], pa.binary()), pa.array([n], pa.int64())], ["shard", "keys", "counts", "docs"])


def _dealt_again(rows: DataFrame, place, shards: int) -> DataFrame:
    """Rows of runs of shards as rows of shards. A run's rows are split by the task that sent them into as many parts as it has shards, each about as large as a shard, so each part sends no more rows than that."""
    per = _per(shards)
    if per == 1:
        return rows

    def again(key, frame):
        import pandas as pd

        k, c = _merge(frame)
        first = int(key[0]) * per
        return pd.DataFrame(list(_packed(k, c, place(k) - first, per, int(frame.docs.sum()), first)), columns=["shard", "keys", "counts", "docs"])

    return rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(per))).groupBy("shard", "part").applyInPandas(again, DEALT)


def _merge(frame) -> tuple[np.ndarray, np.ndarray]:
    """The sums of a group's rows. Each row is unpacked into its place, so that no second copy of all is held."""
    sizes = [len(x) // 8 for x in frame["keys"]]
    k, c, at = np.empty(sum(sizes), np.uint64), np.empty(sum(sizes), np.int64), 0
    for x, y, n in zip(frame["keys"], frame["counts"], sizes, strict=True):
        np.cumsum(_unpack(x), out=k[at : at + n], dtype=np.uint64)
        c[at : at + n] = _unpack(y)
        at += n
    return add_up([k], [c])


def probabilities(a: Arrays, one: np.ndarray, two: np.ndarray, c_one: np.ndarray) -> np.ndarray:
    """p(second | first) of distinct pairs sorted by first and second id; -1 stands for unknown words, c_one is the first one's count."""
    m = a.m
    d, e = np.array([0.0, *m.pair_discounts]), np.array([0.0, *m.single_discounts])
    u, back = np.unique(two, return_inverse=True)
    before = np.where(u >= 0, a.followers(np.maximum(u, 0))[:, 3], 0)[back]
    uniform = 1.0 / (m.distinct + 1)
    if m.pair_types:
        spare = sum(x * y for x, y in zip(m.single_discounts, m.single_kinds, strict=True))
        lower = (np.maximum(before - e[np.minimum(before, 3)], 0) + spare * uniform) / m.pair_types
    else:
        lower = np.full(len(two), uniform)
    known = (one >= 0) & (two >= 0)
    keys = np.where(known, one, 0).astype(np.uint64) << np.uint64(32) | np.where(known, two, 0).astype(np.uint64)
    hot = a.hot(c_one) | (one == BEGIN)
    c = np.zeros(len(one), np.int64)
    v, back = np.unique(one, return_inverse=True)
    follow = np.where((v >= 0)[:, None], a.followers(np.maximum(v, 0)), 0)[back]
    if m.order == 2:
        c[known] = a.pair_counts(keys[known], hot[known])
    else:
        c_one = follow[:, 4]
        if m.adjusted:
            at = np.full(len(one), -1, np.int64)
            at[known] = a.pair_numbers(keys[known], hot[known])
            c[at >= 0] = a.of_pairs(at[at >= 0], lambda s, i: a.adjusted[s][i])[0]
    spare = follow[:, :3] @ d[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (np.maximum(c - d[np.minimum(c, 3)], 0) + spare * lower) / c_one
    return np.where((one >= 0) & (c_one > 0), p, lower)


def _with_triples(a: Arrays, p: np.ndarray, one: np.ndarray, two: np.ndarray, c_one: np.ndarray, back: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p(third | first, second) of distinct neighbouring pairs, and which of them each token has. The pairs of a text's tokens come one after the other in ``back``; a first token has its pair alone."""
    known = (one >= 0) & (two >= 0)
    number = np.full(len(one), -1, np.int64)
    number[known] = a.pair_numbers(one[known].astype(np.uint64) << np.uint64(32) | two[known].astype(np.uint64), (a.hot(c_one) | (one == BEGIN))[known])
    before = np.concatenate(([-1], back[:-1]))
    before[begins] = -1
    u, out = np.unique((before + 1).astype(np.uint64) << np.uint64(32) | back.astype(np.uint64), return_inverse=True)
    pair, last = (u >> np.uint64(32)).astype(np.int64) - 1, (u & np.uint64(0xFFFFFFFF)).astype(np.int64)
    result = p[last]
    i = np.flatnonzero((pair >= 0) & (number[pair] >= 0))
    context, word = number[pair[i]], two[last[i]]
    d = np.array([0.0, *a.m.triple_discounts])
    c = np.zeros(len(i), np.int64)
    c[word >= 0] = a.triple_counts(context[word >= 0], word[word >= 0])
    *kinds, total = a.of_pairs(context, *(lambda s, x, k=k: a.kinds[s][k][x] for k in range(3)), lambda s, x: a.pairs[s][1][x])
    spare = d[1] * kinds[0] + d[2] * kinds[1] + d[3] * kinds[2]
    result[i] = (np.maximum(c - d[np.minimum(c, 3)], 0) + spare * result[i]) / total
    return result, out


def score_texts(a: Arrays, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score and score of each text."""
    m = a.m
    seq, cnt, starts, n = sequence(a, texts)
    follows = np.ones(len(seq), bool)
    follows[starts] = False
    at = np.flatnonzero(follows)
    one, two, c_two = seq[at - 1], seq[at], cnt[at]
    keys = (one + 1).astype(np.uint64) << np.uint64(32) | (two + 1).astype(np.uint64)
    u, first, back = np.unique(keys, return_index=True, return_inverse=True)
    p = probabilities(a, one[first], two[first], cnt[at - 1][first])
    begins = np.concatenate(([0], np.cumsum(n + 1)))[:-1]
    if m.order == 3 and m.triples:
        p, back = _with_triples(a, p, one[first], two[first], cnt[at - 1][first], back, begins)
    total = lambda x: np.add.reduceat(x, begins) if len(begins) else np.zeros(0)
    base = np.log10((c_two + 1) / (m.n_tokens + m.distinct + 1))
    return n + 1, total((c_two > 0).astype(np.int64)), total(base), total(np.log10(p)[back])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, held: int = 2) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity. A null text is empty: an end alone. A null id is never held out; repeated rows give repeated results."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names of files and a few numbers for each shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = arrays(shared.value)
        for batch in common.pieces(batches, "_text", 4 << 20):
            n, known, base, value = score_texts(a, batch.column(1).to_pylist())
            a.release()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(value, pa.float64())], ["_id", "n_tokens", "n_known", "base_score", "score"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("_id").alias(id_col), (common.crc_mod("_id", mod) == held).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out split and score all."""
    return score(docs, fit(docs.where(common.crc_mod(id_col, mod) != held), text_col, order), id_col, text_col, mod, held)
