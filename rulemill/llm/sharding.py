"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking over global row numbers.

Only DataFrame and SQL functions are used. The permutation of the numbers 0 to N-1 is computed, not stored: from the number of
a row alone follow its place in the shuffle, its shard (place modulo the shard count) and its slot (place divided by it), so
shard sizes differ by one row at most. It works on pairs (l, r) of a grid of a x b >= N places, a and b near the root of N;
each round adds a keyed hash of one half to the other, modulo a or b. Places from N on are walked along their cycle until they fall below N.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

ROUNDS = 6
PRIME = (1 << 31) - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers below the prime for each round, from the seed."""
    out = []
    for i in range(rounds):
        raw = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        out.append(tuple(1 + int.from_bytes(raw[4 * k : 4 * k + 4], "big") % (PRIME - 1) for k in range(3)))
    return out


def grid(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square grid with at least n places."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1) if n > 1 else 1
    return a, max(1, -(-n // a))


def _hash(x, key: tuple[int, int, int], div):
    """A keyed polynomial hash below 2**31; x below 2**31, so nothing passes 2**62. ``div`` is floor division."""
    p, q, r = key
    y = ((x % PRIME) * p + q) % PRIME
    y = (y + div(y, 32768) * 40503) % PRIME  # fold high digits into low ones
    return ((y % PRIME) * ((y + r) % PRIME)) % PRIME


def permute_int(x: int, n: int, seed: int, rounds: int = ROUNDS) -> int:
    """The permutation on Python integers, for callers that compute a place without Spark."""
    a, b = grid(n)
    keys = round_keys(seed, rounds)
    while True:
        left, right = x // b, x % b
        for i, key in enumerate(keys):
            if i % 2:
                right = (right + _hash(left, key, lambda u, v: u // v)) % b
            else:
                left = (left + _hash(right, key, lambda u, v: u // v)) % a
        x = left * b + right
        if x < n:
            return x


def permute(df: DataFrame, x: str, out: str, n: int, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """Add the place ``out`` of the row number ``x`` among n rows. All arithmetic is on longs, exact, inside generated code."""
    a, b = grid(n)
    keys = round_keys(seed, rounds)

    def once(frame: DataFrame, source: str, to: str) -> DataFrame:
        frame = frame.withColumns({"_l": F.expr(f"{source} div {b}L"), "_r": F.expr(f"{source} % {b}L")})
        for i, (p, q, r) in enumerate(keys):
            read, write, side = ("_l", "_r", b) if i % 2 else ("_r", "_l", a)
            frame = frame.withColumn("_y", F.expr(f"(({read} % {PRIME}L) * {p}L + {q}L) % {PRIME}L"))
            frame = frame.withColumn("_y", F.expr(f"(_y + (_y div 32768L) * 40503L) % {PRIME}L"))
            frame = frame.withColumn(write, F.expr(f"({write} + ((_y % {PRIME}L) * ((_y + {r}L) % {PRIME}L)) % {PRIME}L) % {side}L"))
        return frame.withColumn(to, F.expr(f"_l * {b}L + _r")).drop("_l", "_r", "_y")

    df = once(df, x, out)
    if a * b == n:
        return df
    walk = lambda steps: f"aggregate(sequence(1, {steps}), {out}, (acc, i) -> CASE WHEN acc < {n}L THEN acc ELSE {_sql('acc', n, keys)} END)"
    # At most a*b - n < a places lie outside, so no walk is longer; nearly all need one step, and only places outside take any.
    df = df.withColumn(out, F.expr(f"CASE WHEN {out} < {n}L THEN {out} ELSE {walk(8)} END"))
    return df.withColumn(out, F.expr(f"CASE WHEN {out} < {n}L THEN {out} ELSE {walk(a * b - n)} END")) if a * b - n > 8 else df


def _sql(x: str, n: int, keys) -> str:
    """One step of the walk as a single SQL expression: the rounds as a fold over the key table."""
    a, b = grid(n)
    table = "array(" + ", ".join(f"named_struct('p', {p}L, 'q', {q}L, 'r', {r}L, 'odd', {str(bool(i % 2)).lower()})" for i, (p, q, r) in enumerate(keys)) + ")"
    y0 = f"(((CASE WHEN k.odd THEN s.l ELSE s.r END) % {PRIME}L) * k.p + k.q) % {PRIME}L"
    y1 = f"(({y0}) + (({y0}) div 32768L) * 40503L) % {PRIME}L"
    f = f"((({y1}) % {PRIME}L) * ((({y1}) + k.r) % {PRIME}L)) % {PRIME}L"
    fold = f"(s, k) -> named_struct('l', CASE WHEN k.odd THEN s.l ELSE (s.l + {f}) % {a}L END, 'r', CASE WHEN k.odd THEN (s.r + {f}) % {b}L ELSE s.r END)"
    return f"aggregate({table}, named_struct('l', {x} div {b}L, 'r', {x} % {b}L), {fold}, s -> s.l * {b}L + s.r)"


def number_rows(df: DataFrame, keys: list[str], out: str = "row_number", rows_per_bucket: int = 1 << 14) -> tuple[DataFrame, int]:
    """Add a global row number from 0, gapless, that depends on the values of ``keys`` only, and return the row count too.

    Rows are dealt into buckets by crc32 of the keys as text; a bucket's first number is the count of rows in the buckets before it,
    and inside it rows are ordered by the keys. Rows equal in all keys are interchangeable. The bucket table has one row for
    each ``rows_per_bucket`` rows.
    """
    n = df.count()
    buckets = max(256, -(-n // rows_per_bucket))
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    dealt = df.withColumn("_bucket", F.crc32(text) % buckets)
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_size"))
    # Buckets are summed in chunks first, so no window sees more than the square root of them.
    chunk = max(1, math.isqrt(buckets))
    sizes = sizes.withColumn("_chunk", F.expr(f"_bucket div {chunk}"))
    inner = sizes.withColumn("_in", F.coalesce(F.sum("_size").over(W.partitionBy("_chunk").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    whole = sizes.groupBy("_chunk").agg(F.sum("_size").alias("_n"))
    before = whole.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_chunk", "_before")
    starts = inner.join(before, "_chunk").select(F.col("_bucket").alias("_b"), (F.col("_in") + F.col("_before")).alias("_start"))
    placed = dealt.withColumn("_in", F.row_number().over(W.partitionBy("_bucket").orderBy(*keys)) - 1)
    return placed.join(starts, placed["_bucket"] == starts["_b"]).withColumn(out, F.col("_start") + F.col("_in")).drop("_bucket", "_b", "_start", "_in"), n


def shard(docs: DataFrame, shards: int = 16, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows into shards of equal row counts (at most one apart) in a reproducible shuffle.

    Returns id, size (UTF-8 bytes of the text, plus 1; a null text has none), text_crc32 (of those bytes; a null text counts as
    empty: 0), row_number, place, shard and slot. Texts are not shuffled, only ids, sizes and checksums. A null id is a value like others; rows equal in id,
    checksum and size are interchangeable and get different places. An empty table gives an empty table; further columns, whatever their names, are not read. Texts are read whole, however long.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = common.stored(slim, "slim")  # texts are read once, not for each use of their sizes and checksums
    numbered, n = number_rows(slim, [id_col, "text_crc32", "size"])
    placed = permute(numbered, "row_number", "place", n, seed)
    return placed.select(id_col, "size", "text_crc32", "row_number", "place", F.expr(f"cast(place % {shards} as int)").alias("shard"), F.expr(f"place div {shards}").alias("slot"))
