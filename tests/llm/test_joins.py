import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.llm import ann, neardup

SF = "/root/testdata/sf0.01"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_documents(spark, width, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = neardup.near_duplicates(docs, width, percent)
    assert got(found) == neardup.brute_force(docs.select("doc_id", "text").collect(), width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def chains(r):
    """Groups in which each text is a small change of another one: chains, stars and one large group."""
    texts = []
    for size in (2, 3, 5, 40, 150):
        base = [f"w{r.randrange(500)}" for _ in range(120)]
        group = [base]
        for _ in range(size - 1):
            t = list(r.choice(group[-10:]))
            for _ in range(r.randint(1, 4)):
                t[r.randrange(len(t))] = f"w{r.randrange(500)}"
            group.append(t)
        texts += [" ".join(t) for t in group]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"w{r.randrange(500)}" for _ in range(r.randint(1, 90))) for _ in range(150)]
    return texts


@pytest.mark.parametrize("seed,small,depth", [(1, 16, 6), (2, 3, 2), (3, 4, 1)])
def test_chains_and_large_nodes(spark, seed, small, depth):
    r = random.Random(seed)
    texts = chains(r) + ["", None, "  \n ", "one", "One", "one two", "a b c", "A B C", "x " * 4000]
    ids = r.sample(range(10_000), len(texts))
    docs = rows(spark, list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    assert got(neardup.near_duplicates(docs, 3, 85, small=small, depth=depth)) == neardup.brute_force(list(zip(ids, texts, strict=True)), 3, 85)


def test_small_leaf_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup._leaf_links, "__defaults__", (7,))
    r = random.Random(8)
    texts = chains(r)
    docs = rows(spark, list(enumerate(texts)), "doc_id long, text string")
    assert got(neardup.near_duplicates(docs, 3, 85, small=3, depth=1)) == neardup.brute_force(list(enumerate(texts)), 3, 85)


def test_edges(spark, monkeypatch):
    same = "a b c d e f g"
    docs = rows(spark, [(5, same, "x"), (3, same, "x"), (3, same, "x"), (None, same, "x"), (9, None, "x"), (8, "", "x")], "doc_id long, text string, component_id string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 85).collect()), key=str)
    assert out == sorted([(5, 5, 3, False), (3, 5, 3, True), (3, 5, 3, True), (None, 5, None, True), (9, 0, 9, True), (8, 0, 8, True)], key=str)
    assert neardup.near_duplicates(docs.limit(0), 3, 85).count() == 0
    monkeypatch.setattr(neardup, "MOST_BROADCAST_IDS", 0)
    assert {r.component_id for r in neardup.near_duplicates(docs.where("doc_id < 6"), 3, 85).collect()} == {3}


def brute_vectors(data, threshold):
    ids = [i for i, _ in data]
    ok = [v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in data]
    x = np.array([v if k else [0.0] * 8 for k, (_, v) in zip(ok, data, strict=True)], float)
    n = np.linalg.norm(x, axis=1)
    cos = (x @ x.T) / np.maximum(np.outer(n, n), 1e-300)
    link = (cos >= threshold) & np.outer(ok, ok)
    np.fill_diagonal(link, False)
    comp = [i for i in ids]
    for _ in range(len(ids)):
        new = [min([comp[a], *(comp[b] for b in np.flatnonzero(link[a]))]) if ok[a] else comp[a] for a in range(len(ids))]
        if new == comp:
            break
        comp = new
    return [(i, int(link[a].sum()), comp[a]) for a, i in enumerate(ids)]


def test_vectors(spark):
    r = np.random.default_rng(2)
    data = []
    for _ in range(60):
        base = r.normal(size=8)
        for _ in range(r.integers(1, 6)):
            data.append((base + 0.05 * r.normal(size=8)).tolist())
    hot = r.normal(size=8)
    data += [(hot + 0.02 * r.normal(size=8)).tolist() for _ in range(150)]
    data += [data[0], data[0], [0.0] * 8, [float("nan")] * 8, [1.0] * 7 + [float("inf")], None, [1.0] * 7 + [None], [1.0, 2.0], [-x for x in data[0]]]
    data = list(enumerate(data))
    df = rows(spark, data, "vec_id long, embedding array<double>").repartition(4)
    found = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in ann.near_vectors(df).collect()}
    want = {i: (n, c) for i, n, c in brute_vectors(data, 0.95)}
    assert found.keys() == want.keys()
    total, got_ = sum(n for n, _ in want.values()), sum(n for n, _, _ in found.values())
    assert 0.97 * total <= got_ <= total and all(found[i][0] <= want[i][0] for i in want)
    assert sum(found[i][1] != want[i][1] for i in want) <= 2
    assert all(k == (i == c) for i, (_, c, k) in found.items())


def test_blocks_agree(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = r.normal(size=64)
    data = [(i, (base + 0.1 * r.normal(size=64)).tolist()) for i in range(200)]
    df = rows(spark, data, "vec_id long, embedding array<float>")
    want = sorted(map(tuple, ann.near_vectors(df).collect()))
    monkeypatch.setattr(ann, "BLOCK", 16)
    assert sorted(map(tuple, ann.near_vectors(df).collect())) == want and sum(w[1] for w in want) > 1000


def test_recall_at_threshold():
    """Pairs at the cosine 0.95 itself, the worst case, on random vectors of 64 dimensions."""
    r = np.random.default_rng(4)
    a = r.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    for n in (10_000, 50_000, 1_000_000, 1 << 30):
        p = ann.plan(n)
        q = ann.Quantiser(p.bits, {64: ann.learn(a, p.bits)})
        x, y = q.codes(a), q.codes(0.95 * a + np.sqrt(1 - 0.95**2) * b)
        hit = (np.bitwise_count(ann._keys(x, p) ^ ann._keys(y, p)) <= 1).any(1) & (np.bitwise_count(x ^ y).sum(1) <= p.most)
        assert hit.mean() >= 0.9, n
        balance = np.unpackbits(x, axis=1).mean(0)
        assert max(abs(v - 0.5) for v in balance) < 0.06


def test_keys_grow_with_the_table():
    """Rows sent to the tables for each vector grow by less than the fourth root of n, and buckets hold about four vectors, at any size."""
    sent = [ann.plan(n).tables * (1 + ann.plan(n).width / 2) for n in (10**4, 10**6, 10**8, 10**10)]
    assert all(b <= 100**0.25 * a for a, b in zip(sent, sent[1:], strict=False))
    assert all(1 <= n / 2 ** ann.plan(n).width <= 8 for n in (10**4, 10**6, 10**8, 10**10))


def test_vector_edges(spark):
    df = rows(spark, [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>").withColumn("n_links", F.lit("x"))
    out = sorted(map(tuple, ann.near_vectors(df).collect()), key=str)
    assert out == sorted([(None, 0, None, True), (4, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True)], key=str)
    assert ann.near_vectors(df.limit(0)).count() == 0
    assert [tuple(x) for x in ann.near_vectors(rows(spark, [(1, None)], "vec_id long, embedding array<float>")).collect()] == [(1, 0, 1, True)]


def test_negative_zeros_link(spark):
    df = rows(spark, [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [1.0, -0.0]), (4, [-0.0, 1.0]), (5, [-0.0, -0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ann.near_vectors(df).collect())) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True)]


def test_rarer_dimensions_link_among_themselves(spark):
    df = rows(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.0]), (6, [3.0]), (7, [1e-200, 0.0, 0.0, 0.0]), (8, [1e200, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in ann.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6), 7: (1, 7), 8: (1, 7)}


def test_whole_buckets_and_pairs():
    r = random.Random(2)
    keys = sorted((r.randrange(4), r.randrange(4)) for _ in range(60)) + [(9, 9)] * 40
    table = [{"a": a, "b": b, "role": int(i % 3 > 0)} for i, (a, b) in enumerate(keys)]
    import pyarrow as pa

    table = sorted(table, key=lambda x: (x["a"], x["b"], x["role"]))
    cut = [0, 3, 4, 30, 61, 62, 80, 100]
    batches = [pa.RecordBatch.from_pylist(table[i:j], pa.schema([("a", pa.int32()), ("b", pa.int64()), ("role", pa.int8())])) for i, j in zip(cut, cut[1:], strict=False)]
    parts = list(ann._whole_buckets(iter(batches), 2))
    assert [x for part in parts for x in part.to_pylist()] == table
    assert len({(x["a"], x["b"]) for x in table}) == sum(len({(x["a"], x["b"]) for x in part.to_pylist()}) for part in parts)
    group, role = ann._numbered(pa.Table.from_batches(batches).combine_chunks().to_batches()[0], 2), np.array([x["role"] for x in table])
    want = {(i, j) for i in range(100) for j in range(i) if group[i] == group[j] and role[j] == 0}
    assert {(int(i), int(j)) for q, m in ann._pairs(group, role, 7) for i, j in zip(q, m, strict=True)} == want
