import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulemill.llm import common, decontam, sharding, spiece, warc

SF = "/root/testdata/sf0.001"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- SentencePiece -------------------------------------------------------------------------------------------------------------


def library():
    sp = pytest.importorskip("sentencepiece")
    return sp.SentencePieceProcessor(model_file=spiece.default_model())


HARD = ["", " ", "a", "  a b ", "▁a", "\n\n x", "<s> hi</s><0x0A>", "日本語テキスト  x", "a\x00b", "ﬁ fi", "🎉🎉", " " * 50, "a" * 3000, "ab " * 500, "x" * 100 + "é" * 100]


def test_table_equals_library():
    lib, t = library(), spiece.table(spiece.default_model())
    r = random.Random(1)
    cases = HARD + ["".join(r.choice("abcdeth ing  \n▁éßñ日🎉.,|#") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    for text in cases:
        ids, decoded = t.both(text)
        want = lib.encode(text) + [lib.eos_id()]
        assert [int(i) for i in ids.split(" ")] == want == t.encode(text)
        assert decoded == lib.decode(want) == t.decode(want)


def test_decode_of_foreign_ids():
    lib, t = library(), spiece.table(spiece.default_model())
    r = random.Random(2)
    for _ in range(300):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000), 13, 1, 2]) for _ in range(r.randint(0, 12))]
        assert t.decode(ids) == lib.decode(ids)


def test_encode_operator(spark):
    lib = library()
    docs = rows(spark, [(1, "hello world", "x"), (2, None, "y"), (None, "", "z"), (1, "hello world", "x")], "doc_id long, text string, n_tokens string")
    got = spiece.encode(docs, spiece.default_model()).collect()
    assert len(got) == 4 and sorted((g.doc_id or 0, g.n_tokens) for g in got) == [(0, 1), *[(1, len(lib.encode("hello world")) + 1)] * 2, (2, 1)]
    one = next(g for g in got if g.doc_id == 1)
    assert one.ids == [*lib.encode("hello world"), 2] and one.decoded == "hello world"
    assert one.ids_sha256 == hashlib.sha256(" ".join(map(str, one.ids)).encode()).hexdigest()
    assert spiece.encode(docs.limit(0), spiece.default_model()).count() == 0


# --- Sharding ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 97, 1000])
def test_permutation(spark, n):
    got = {r.x: r.y for r in sharding.permute(spark.range(n).withColumnRenamed("id", "x"), "x", "y", n, seed=5).collect()}
    assert got == {x: sharding.permute_int(x, n, 5) for x in range(n)}
    assert sorted(got.values()) == list(range(n))


def test_walk_of_large_domain(spark):
    n = 10**12 - 11
    some = [0, 1, n - 1, n // 2, *range(5000)]
    got = {r.x: r.y for r in sharding.permute(spark.createDataFrame([(x,) for x in some], "x long"), "x", "y", n, seed=9).collect()}
    assert got == {x: sharding.permute_int(x, n, 9) for x in some}


def test_shards(spark):
    data = [(i, f"text {i % 40}" if i % 9 else None, i) for i in range(333)] + [(5, "text 5", 0), (5, "text 5", 0), (None, "é", 1), (None, None, 2)]
    docs = rows(spark, data, "doc_id long, text string, shard int")
    got = sharding.shard(docs, 16).collect()
    again = sharding.shard(docs.repartition(7), 16).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text_crc32, r.place)
    assert sorted(map(tuple, sorted(got, key=key)), key=str) == sorted(map(tuple, sorted(again, key=key)), key=str)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = sorted(len((t or "").encode()) + 1 for _, t, _ in data)
    assert sorted(r.size for r in got) == want
    assert {r.text_crc32 for r in got} == {zlib.crc32((t or "").encode()) for _, t, _ in data}
    assert sorted(r.row_number for r in got) == list(range(len(data)))
    assert sharding.shard(docs.limit(0)).count() == 0


def test_shards_equal_a_full_recomputation(spark):
    """Row number from the order of buckets and keys, place from the permutation on integers, shard and slot from the place."""
    r = random.Random(8)
    data = [(i, "é" * r.randint(0, 40) + "x" * r.randint(0, 3000)) for i in range(700)] + [(None, "n"), (None, None), (5, "again"), (6, "y" * 400_000)]
    docs = rows(spark, [(i, t, 1, 2, 3) for i, t in data], "doc_id long, text string, _bucket int, _size int, place int").repartition(6)
    got = sorted((str(g.doc_id), g.size, g.text_crc32, g.row_number, g.place, g.shard, g.slot) for g in sharding.shard(docs, 16).collect())
    slim = [(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in data]
    bucket = lambda x: zlib.crc32("|".join("null" if v is None else str(v) for v in x).encode()) % 256
    ordered = sorted(slim, key=lambda x: (bucket(x), x[0] is not None, x[0] or 0, x[1], x[2]))
    place = [sharding.permute_int(k, len(ordered), 2024) for k in range(len(ordered))]
    assert got == sorted((str(i), size, crc, k, p, p % 16, p // 16) for k, ((i, crc, size), p) in enumerate(zip(ordered, place, strict=True)))
    assert sorted(place) == list(range(len(data)))


# --- Decontamination -----------------------------------------------------------------------------------------------------------


def test_decontamination_on_tables(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(docs, bench).collect()}
    want = {r[0]: r[1:] for r in decontam.brute_force(docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect())}
    assert got == want and any(v[2] for v in want.values())


def test_decontamination_edges(spark):
    r = random.Random(3)
    word = lambda: r.choice("aa bb cc dd".split())
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "A b"), (100, "aa " * 30), (None, "aa bb"), (103, "aa " * 5000)]
    items = [(i, " ".join(word() for _ in range(r.randint(1, 12)))) for i in range(25)] + [(50, None), (51, "..."), (52, "aa"), (52, "aa"), (53, "AA, aa")]
    d, b = rows(spark, docs, "doc_id long, text string"), rows(spark, items, "item_id long, text string")
    got = sorted(map(str, ((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontam.decontaminate(d, b).collect())))
    assert got == sorted(map(str, decontam.brute_force(docs, items)))
    assert {x.n_items for x in decontam.decontaminate(d, b.limit(0)).collect()} == {0}
    assert decontam.decontaminate(d.limit(0), b).count() == 0


def test_small_blocks_and_shards_agree(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    index = common.stored(decontam.build_index(docs, shard_bytes=5000), "small")
    want = sorted(map(str, decontam.search(index, bench, matches=False).collect()))
    both = sorted(map(str, decontam.search(index, bench, slop=3).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 400)
    assert decontam.blocks(bench).count() > 1
    assert sorted(map(str, decontam.search(index, bench, matches=False).collect())) == want
    assert sorted(map(str, decontam.search(index, bench, slop=3).collect())) == both


def test_exact_and_near_matches(spark):
    docs = rows(spark, [(1, "x one two three four y"), (2, "four x three two one"), (3, "one two"), (4, "one two x x x x x x x x three four")], "doc_id long, text string")
    bench = rows(spark, [(7, "one two three four")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.search(decontam.build_index(docs), bench, slop=2).collect()}
    assert [(m.item, m.position, m.n) for m in got[1].matches] == [(7, 1, 4)] and got[1].n_hit == 4
    assert {d for d, r in got.items() if r.near} == {1, 2} and not got[2].items


def test_near_matches_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(n))
    docs, items = [(i, text(r.randint(0, 80))) for i in range(80)], [(i, text(r.randint(1, 7))) for i in range(30)]

    def near(ws, item, slop):
        n = len(item) + slop
        return any(set(item) <= set(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1)))

    want = {d: {i for i, t in items for k in range(max(1, len(t.split()) - 3)) if near(x.split(), t.split()[k : k + 4], 2)} for d, x in docs}
    exact = {d: sorted((k, str(i), n) for i, t in items for n in [min(4, len(t.split()))] for w in {tuple(t.split()[j : j + n]) for j in range(len(t.split()) - n + 1)} for k in range(len(x.split()) - n + 1) if tuple(x.split()[k : k + n]) == w) for d, x in docs}
    index = common.stored(decontam.build_index(rows(spark, docs, "doc_id long, text string"), shard_bytes=500), "near")
    bench = rows(spark, items, "item_id long, text string")
    for most in (1000, 9):
        monkeypatch.setattr(decontam, "BLOCK_WINDOWS", most)
        got = decontam.search(index, bench, window=4, slop=2).collect()
        assert {g.doc_id: set(g.near) for g in got} == want
        assert {g.doc_id: sorted((m.position, str(m.item), m.n) for m in g.matches) for g in got} == exact


def test_match_queries(spark):
    from rulemill.llm import queries

    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = sorted(map(tuple, queries.decontamination_matches(spark, SF).select("doc_id", "item_id", "first_word", "n").collect()))
    want = c.execute("SELECT doc_id, item_id, first_word, n FROM (" + queries.ORACLE_SQL["decontamination_matches"] + ")").fetchall()
    assert got == sorted(want) and got
    near = {r.doc_id: r for r in queries.decontamination_near(spark, SF).collect()}
    assert all(r.n_near >= r.n_items for r in near.values()) and {d for d, *_ in got} == {d for d, r in near.items() if r.n_items}


def test_decontamination_clashes(spark):
    docs = rows(spark, [(1, "one two three"), (2, "x")], "doc_id long, text string").selectExpr("*", "1 AS _id", "2 AS _text", "3 AS ids", "4 AS n_words", "5 AS shard")
    bench = rows(spark, [(7, "one two"), (None, "x")], "item_id long, text string").selectExpr("*", "1 AS _item", "2 AS _text", "3 AS w", "4 AS items")
    assert sorted((r.doc_id, r.n_items) for r in decontam.decontaminate(docs, bench).collect()) == [(1, 1), (2, 0)]


# --- WARC ----------------------------------------------------------------------------------------------------------------------


def brute_pages(data):
    first = {}
    for i, h in data:
        p = (h or "").encode()
        if len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, h in data:
        p = (h or "").encode()
        again = len(p) >= 100 and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out)


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    data = [(i, "é" * (i % 7) + "<html>" + "x" * (i % 5 * 60)) for i in range(80)] + [(90, None), (91, ""), (92, "a\r\n\r\nb" * 40), (93, "a\r\n\r\nb" * 40), (94, "z" * 3_000_000)]
    pages = rows(spark, [(i, None if i == 3 else f"http://x.org/a b{i}", h, "c") for i, h in data], "page_id long, url string, html string, record string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, version=version).collect())
    assert got == brute_pages(data)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_revisits_name_their_original(spark, tmp_path):
    import os

    pages = rows(spark, [(i, f"http://x.org/{i}", "z" * 200 if i != 3 else "q" * 200) for i in range(5)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    records = common.stored(warc.convert_pages(pages), "records")
    warc.write_archives(records, warc.originals(records), folder).collect()
    heads = [h for name in os.listdir(f"{tmp_path}/w") for h, _ in warc.read_warc(io.BytesIO(b"".join(inflate(open(f"{tmp_path}/w/{name}", "rb").read()))))]
    ids = {h["WARC-Target-URI"]: h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    again = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert set(ids) == {"http://x.org/0", "http://x.org/3"} and len(again) == 3
    assert all((h["WARC-Refers-To"], h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"]) == (ids["http://x.org/0"], "http://x.org/0", "2024-01-01T00:00:00Z") for h in again)


def inflate(raw):
    while raw:
        z = zlib.decompressobj(31)
        yield z.decompress(raw)
        raw = z.unused_data


def test_repeated_rows_and_null_ids(spark):
    pages = rows(spark, [(1, "u", "x" * 200), (1, "u", "x" * 200), (None, "u", "x" * 200), (None, "u", "short")], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert len(got) == 4 and sorted(r.record_type for r in got) == ["response", "response", "revisit", "revisit"]


def test_arc_reader():
    records = [("http://a.b/x y", "1.2.3.4", "19960101000000", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi\n"), ("dns:a.b", "1.2.3.4", "199601010000", "text/dns", b"a.b. 1"), ("ftp://f/g", "-", "19960101000000", "no-type", b"")]
    for version in (1, 2):
        raw = warc.arc_file(records, version)
        got = [warc.convert(f, b) for f, b in warc.read_arc(io.BytesIO(raw))]
        assert [dict(h)["WARC-Type"] for h, _, _ in got] == ["warcinfo", "response", "response", "resource"]
        assert got[1][2] == b"hi\n" and dict(got[2][0])["WARC-Date"] == "1996-01-01T00:00:00Z" and dict(got[1][0])["WARC-Target-URI"] == "http://a.b/x y"
        with pytest.raises(warc.ArcError):
            list(warc.read_arc(io.BytesIO(raw[: -len(b"no-type 0") - 40])))
    with pytest.raises(warc.ArcError):
        list(warc.read_arc(io.BytesIO(b"http://x 1 2 3 4\n")))


# --- Shared helpers ------------------------------------------------------------------------------------------------------------


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(150)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.id: x.component_id for x in common.components(rows(spark, edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def test_lookup_with_hot_keys(spark):
    data = rows(spark, [("h" if i % 3 else f"k{i % 50}", i) for i in range(900)] + [(None, 1)], "k string, v long")
    found = data.where("k IS NOT NULL").groupBy("k").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    got = common.with_lookup(data, "k", found, "n", 100).groupBy("k").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.min("v").alias("v")).collect()
    assert all((g.a == g.b == g.v) if g.k else g.a is None for g in got)


@pytest.mark.parametrize("postings", [1, 5, 1 << 20])
def test_shards_unpack_postings_in_runs(monkeypatch, postings):
    monkeypatch.setattr(decontam, "POSTINGS", postings)
    texts = ["a b c a b", None, "c c d e a", "", "x y z b"]
    tests = decontam.Tests(b"b\nz\nq\na", np.array([[0, 1, 3]], np.int32).tobytes(), 3, np.zeros(1, np.int32).tobytes(), np.ones(1, np.int64).tobytes(), ["i"])
    shard = decontam.Shard(*decontam._shard(texts), tests)
    at, want = 0, []
    for text in texts:
        ws = decontam.words(text)
        want += [tests.number[w] << 32 | at + k for k, w in enumerate(ws) if w in tests.number]
        at += len(ws) + 1
    assert shard.keys.tolist() == sorted(want) and shard.count.tolist() == [3, 1, 0, 3]
    empty = decontam.Shard(*decontam._shard([]), tests)
    assert not len(empty.keys) and not list(empty.candidates())


def test_arrow_batches_of_large_rows_are_small(spark):
    common.ship(spark)
    wide = spark.range(24, numPartitions=1).selectExpr("repeat(chr(97 + id % 26), 4000000) AS x")
    got = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in got) >= 96_000_000 and max(r.n for r in got) < 25_000_000
