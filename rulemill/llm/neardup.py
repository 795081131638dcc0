"""Near-duplicates by a chosen-path set similarity join.

A document is its set of word shingles, a set is embedded as minwise tokens (one value for each of 64 hash functions), and equal sets are one
class from the start. In each of several independent trees, a node holds the classes that agree on the tokens chosen on
its path. A node of few classes is compared exhaustively; a larger one is branched by a further chosen token, or two, so that
similar sets stay together in more than one child each while unlike ones part. Every comparison is confirmed on the full sets.

Only links between classes that aren't connected yet can change a component. So each node first yields the pairs of its smallest
class with the others; the links confirmed among these at the roots connect most groups, however large, with work in
proportion to their size. From then on a node whose classes all lie in one component is dropped: no pair of it can change anything. A node is compared at once, in blocks, if few of its classes lie
outside its largest component, or if it is dense: if its classes are so alike on average that branching would hardly part them. Only the rest is branched on, down to the last depth or until comparing the rest is cheap. Classes that
were compared in one dense root are a group, whose pairs other nodes need not compare again. Before a comparison, pairs that cannot or almost surely do not link are left out: by the sizes of their sets, and by one-bit sketches of their minwise tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKENS = 64
TREES = 10
SMALL_NODE = 16
DEPTH = 6
#: Children of a pair at the threshold below the roots, on average; at the roots it is one.
SURPLUS = 1.2
#: A node of this average similarity is not branched on.
DENSE = 0.5
#: Branching ends where comparing all that is left takes no more comparisons for each class of the input.
CHEAP = 20
#: Sketch bits that may differ. At similarity 0.8 they are 6.4 on average, with a deviation of 2.4.
SKETCH_BITS = 19
MOST_BROADCAST_IDS = 500_000
LEAF_BLOCK = 512
_MASK = (1 << 64) - 1


def _odd(n: int, seed: str) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "little") | 1 for i in range(n)], np.uint64)


_FACTORS = _odd(TOKENS, "tokens")
_PLACES = _odd(64, "places")
#: For each tree, the order in which it chooses tokens.
_CHOICES = np.array([np.random.default_rng([7, t]).permutation(TOKENS) for t in range(64)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh3_64_intdigest

    if not text:
        return np.zeros(0, np.uint64)
    ws = text.encode().translate(common.LOWER).split()
    n = len(ws)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, n)
    k = min(n, width)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total += _mix(h[i : n - k + 1 + i] + _PLACES[i]) * _PLACES[32 + i % 32]
    return np.unique(_mix(total + np.uint64(k)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit minwise tokens of nonempty sets, one row each."""
    values = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), TOKENS), np.uint32)
    for i, f in enumerate(_FACTORS):
        out[:, i] = np.minimum.reduceat(values * f, starts) >> np.uint64(32)
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    bits = (_mix(sig.astype(np.uint64) + np.uint64(1)) & np.uint64(1)).astype(np.uint64)
    return (bits << np.arange(TOKENS, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)


def describe(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, n (set size), fp (fingerprint of the set, null if empty), sig, sk. Texts are read whole."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "_text", 8 << 20):
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            sig = signatures(full) if full else np.zeros((0, TOKENS), np.uint32)
            sk = iter(sketches(sig).tolist())
            raw = iter([r.tobytes() for r in sig])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(raw) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(sk) if len(s) else None for s in sets], pa.int64()),
                ],
                ["id", "n", "fp", "sig", "sk"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).mapInArrow(run, f"id {kind}, n long, fp binary, sig binary, sk long")


def branch(rows: DataFrame, depth: int, trees: int, threshold: float) -> DataFrame:
    """Child nodes of rows (rep, n, sk, comp, sig and, below the root, tree and node): one for each row, and a second one in part of the nodes. Children keep the tokens from the first level on."""
    kind = rows.schema["rep"].dataType.simpleString()
    root = depth == 0
    share = np.uint64(int(min(1.0, (1.0 if root else SURPLUS) / threshold - 1) * 2**32))
    kept = ["rep", "n", "sk", "comp", *([] if root else ["grp", "sig"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            sig = np.frombuffer(b"".join(get("sig").to_pylist()), np.uint32).reshape(-1, TOKENS)
            every = np.arange(batch.num_rows)
            if root:
                which = np.repeat(every, trees)
                tree = np.tile(np.arange(trees), batch.num_rows)
                node = _mix(tree.astype(np.uint64) + np.uint64(1))
            else:
                which, tree = every, get("tree").to_numpy(zero_copy_only=False)
                node = get("node").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            found = []
            twice = (_mix(node + np.uint64(depth + 100)) >> np.uint64(32)) < share
            for second, pick in ((0, slice(None)), (1, twice)):
                w, t, v = which[pick], tree[pick], node[pick]
                token = _CHOICES[t, TOKENS - 1 - depth if second else depth]
                child = _mix(v ^ _mix(sig[w, token].astype(np.uint64) + (token.astype(np.uint64) << np.uint64(32))))
                found.append((w, t, child))
            w, t, child = (np.concatenate(x) for x in zip(*found, strict=True))
            for at in range(0, len(w), 50_000):
                i = pa.array(w[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(t[at : at + 50_000].astype(np.int32)), pa.array(child[at : at + 50_000].view(np.int64)), *(get(c).take(i) for c in kept)], ["tree", "node", *kept])

    return rows.mapInArrow(run, f"tree int, node long, rep {kind}, n long, sk long, comp {kind}" + ("" if root else ", grp long, sig binary"))


def _likely(na, nb, sa, sb, percent: int):
    """Whether two sets may link: sizes allow it, and the sketches don't differ too much."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.bit_count(sa.bitwiseXOR(sb)) <= SKETCH_BITS)


def _sets(docs: DataFrame, need: DataFrame, classes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id and set (its sorted hashes) of the classes named in need (rep, fp), made again from whole texts. These ids are broadcast up to a fixed number and joined by a shuffle beyond it."""
    kind = classes.schema["rep"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "_text", 8 << 20):
            sets = [shingles(t, width).tobytes() for t in batch.column(1).to_pylist()]
            same = pa.array([hashlib.blake2b(s, digest_size=16).digest() == fp for s, fp in zip(sets, batch.column(2).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"]).filter(same)

    if need.count() <= MOST_BROADCAST_IDS:
        need = F.broadcast(need)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(need, F.col("_id") == F.col("rep")).select("_id", "_text", "fp")
    return source.mapInArrow(make, f"id {kind}, set binary")


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) of class representatives whose full sets link: 100 * intersection >= percent * union.

    Sets are made again from the whole texts of the documents that occur in a pair.
    """
    pairs = common.stored(pairs.select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("rep")).distinct().unionByName(pairs.select(F.col("b").alias("rep")).distinct()).distinct()
    need = common.stored(ends.join(classes.select("rep", "fp"), "rep"), "need")
    kind = classes.schema["rep"].dataType.simpleString()
    sets = common.stored(_sets(docs, need, classes, width, id_col, text_col), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    links = common.stored(two.mapInArrow(compare, f"a {kind}, b {kind}"), "links")
    common.drop(pairs, need, sets)
    return links


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of different components within nodes of few classes."""
    grouped = members.groupBy("node").agg(F.collect_list(F.struct("comp", "rep", "n", "sk")).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    each = grouped.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.expr("filter(m, y -> y.rep > x.rep AND y.comp <> x.comp)")).alias("y"))
    return each.where(_likely(F.col("x.n"), F.col("y.n"), F.col("x.sk"), F.col("y.sk"), percent)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _leaf_links(leaves: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, id_col: str, text_col: str, block: int = LEAF_BLOCK) -> DataFrame:
    """Links (a, b) between different components within nodes: each class outside the node's largest component, or group compared elsewhere, against all of the node, on full sets.

    Members and outsiders are dealt into blocks, and each pair of blocks is compared by itself, by counting in lists of the members that
    hold each shingle. Of the links of a class with one component, one is returned.
    """
    main = _mains(leaves).select("node", F.struct("label", F.ceil(F.col("c") / block).cast("int").alias("mb"), F.ceil(F.col("outside") / block).cast("int").alias("rb")).alias("main"), "c")
    mixed = common.with_lookup(leaves, "node", common.stored(main, "mains"), "c", common.hot_limit(leaves.count())).where("main IS NOT NULL")
    mixed = common.stored(mixed.withColumn("out", ~_in_main(F.col("main.label"))), "mixed")
    need = common.stored(mixed.select("rep").distinct().join(classes.select("rep", "fp"), "rep"), "need")
    sets = common.stored(_sets(docs, need, classes, width, id_col, text_col), "leaf-sets")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(f"main.{n}")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"main.{n}") - 1))
    members = mixed.select("node", every("rb").alias("rb"), deal("mb").alias("mb"), F.lit(0).alias("role"), "rep", "comp")
    outside = mixed.where("out").select("node", deal("rb").alias("rb"), every("mb").alias("mb"), F.lit(1).alias("role"), "rep", "comp")
    rows = members.unionByName(outside).join(sets.select(F.col("id").alias("rep"), "set"), "rep").select("node", "rb", "mb", "role", "rep", "comp", "set")
    kind = classes.schema["rep"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.sorted_groups(batches, 3):
            role, comp = group.column(3).to_numpy(zero_copy_only=False), group.column(5).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            held = [np.frombuffer(x, np.uint64) for x in group.column(6).to_pylist()]
            inside, outer = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            if not len(inside) or not len(outer):
                continue
            n = np.array([len(held[i]) for i in inside])
            values, owner = np.concatenate([held[i] for i in inside]), np.repeat(np.arange(len(inside)), n)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            ones, others = [], []
            for x in outer:
                mine = held[x]
                lo, hi = np.searchsorted(values, mine), np.searchsorted(values, mine, side="right")
                count = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                both = np.bincount(owner[at], minlength=len(inside))
                linked = np.flatnonzero((100 * both >= percent * (len(mine) + n - both)) & (comp[inside] != comp[x]))
                _, first = np.unique(comp[inside[linked]], return_index=True)
                ones.extend([x] * len(first))
                others.extend(inside[linked[first]])
            rep = group.column(4)
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(ones, pa.int64())), rep.take(pa.array(others, pa.int64()))], ["a", "b"])

    dealt = rows.repartition("node", "rb", "mb").sortWithinPartitions("node", "rb", "mb")
    links = common.stored(dealt.mapInArrow(compare, f"a {kind}, b {kind}"), "leaf-links")
    common.drop(mixed, need, sets)
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES, small: int = SMALL_NODE, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose word-shingle sets have 100 * intersection >= percent * union; one row per document.

    Returns the id, n_shingles (set size), component_id (the smallest id reachable by links, its own included) and kept (whether that is its own).
    A null, empty or blank text has an empty set and links with nothing; a very long one is read whole and is one set like others. A row with a null id links with nothing, has a null
    component_id and is kept. Repeated rows share a component, which all of them head or none. An empty table gives an empty table; further columns, whatever their names, are not read.
    A pair of similarity s meets in one child with probability s for each token chosen. Where its nodes are small from the root on, ten trees miss a link at the threshold with a probability below 10**-6;
    where they are large down to the last depth, with about 6 * 10**-5 at 80 percent and 10**-5 at 85, and only if no other path of links connects its ends.
    """
    share = percent / 100
    described = common.stored(describe(docs, width, id_col, text_col), "described")
    total = described.count()
    full = described.where("fp IS NOT NULL AND id IS NOT NULL")
    classes = common.stored(full.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sk").alias("sk"), F.first("sig").alias("sig")), "classes")
    n_classes = classes.count()
    rows = common.stored(branch(classes.select("rep", "n", "sk", "sig", F.col("rep").alias("comp")), 0, trees, share), "nodes")
    found, stars = _grouped(rows, percent)
    links = confirm(stars, docs, classes, width, percent, id_col, text_col)
    comps = common.stored(common.components(links), "components")
    smalls, leaves, stars = [found.where(F.col("size") <= small).select("node", "rep", "n", "sk")], [], []
    large = _with_comp(found.where(F.col("size") > small).select("tree", "node", "rep", "n", "sk"), comps)
    large = common.stored(_settled(common.stored(large, "large")), "judged")
    for level in range(1, depth + 1):
        open_ = ~F.col("dense") & (F.col("outside") > small)
        left = large.where(open_).agg(F.coalesce(F.sum("outside"), F.lit(0))).first()[0] if level < depth else 0
        if left <= CHEAP * n_classes:
            leaves.append(large.select("node", "rep", "grp"))
            break
        leaves.append(large.where(~open_).select("node", "rep", "grp"))
        rest = large.where(open_)
        if level == 1:
            rest = rest.join(classes.select("rep", "sig"), "rep")
        found, more = _grouped(common.stored(branch(rest.select("tree", "node", "rep", "n", "sk", "comp", "grp", "sig"), level, trees, share), "nodes"), percent)
        stars.append(more)
        smalls.append(found.where(F.col("size") <= small).select("node", "rep", "n", "sk"))
        large = common.stored(_judged(found.where(F.col("size") > small).select("tree", "node", "rep", "n", "sk", "comp", "grp", "sig")), "judged")
    pairs = common.stored(_union([_across(_with_comp(_union(smalls), comps), percent), *stars]).distinct(), "across")
    if not pairs.isEmpty():
        links, comps = _joined(links, comps, [confirm(pairs, docs, classes, width, percent, id_col, text_col)])
    members = common.stored(_with_comp(_union(leaves), comps), "leaves")
    extra = [] if members.isEmpty() else [_leaf_links(members, docs, classes, width, percent, id_col, text_col)]
    links, comps = _joined(links, comps, extra)
    ids = classes.select("fp", "rep", "copies").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), "copies")
    out = common.with_lookup(described.select("id", "n", "fp"), "fp", ids, "copies", common.hot_limit(total))
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _grouped(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes that hold more than one component, with the node's ``size``; and the likely pairs (a, b) of each node's smallest class with those of other components."""
    groups = rows.groupBy("node").agg(F.count("*").alias("c"), F.min(F.struct("rep", "n", "sk", "comp")).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    groups = groups.select("node", "lead", F.col("c").alias("size"), "c")
    found = common.stored(common.with_lookup(rows, "node", groups, "c", common.hot_limit(rows.count())).where("size IS NOT NULL"), "grouped")
    common.drop(rows)
    others = found.where("comp <> lead.comp").where(_likely(F.col("n"), F.col("lead.n"), F.col("sk"), F.col("lead.sk"), percent))
    return found, others.select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"))


def _with_comp(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(*rows.columns, F.coalesce("component_id", "rep").alias("comp"))


def _in_main(label):
    """Whether a row (node, comp, grp) is one of those that ``label`` stands for: a component, or a group of another node."""
    return (F.xxhash64("comp") == label) | F.coalesce((F.col("grp") != F.col("node")) & (F.xxhash64(F.lit("group"), "grp") == label), F.lit(False))


def _mains(rows: DataFrame) -> DataFrame:
    """For nodes with pairs that are still to be compared: the label of the most classes whose pairs need no comparison (one component, or compared in another node), how many lie outside, and the size."""
    label = F.array_compact(F.array(F.xxhash64("comp"), F.when(F.col("grp") != F.col("node"), F.xxhash64(F.lit("group"), "grp"))))
    total = F.max(F.when(F.col("label").isNull(), F.col("k"))).alias("c")
    counted = rows.select("node", F.explode(F.concat(label, F.array(F.lit(None).cast("long")))).alias("label")).groupBy("node", "label").agg(F.count("*").alias("k"))
    top = counted.groupBy("node").agg(F.max(F.when(F.col("label").isNotNull(), F.struct("k", "label"))).alias("top"), total)
    return top.select("node", F.col("top.label").alias("label"), (F.col("c") - F.col("top.k")).alias("outside"), "c").where("outside > 0")


def _density(rows: DataFrame, bits: int = 32) -> DataFrame:
    """Whether a node is dense, by the average similarity of its pairs, which follows from how many of its sketches have each bit."""
    counted = rows.groupBy("node").agg(F.count("*").alias("m"), *[F.expr(f"sum((sk >> {i}) & 1) AS b{i}") for i in range(bits)])
    differ = " + ".join(f"b{i} * (m - b{i})" for i in range(bits))
    return counted.select("node", F.expr(f"1 - 4 * ({differ}) / ({bits} * m * (m - 1)) >= {DENSE} AS dense"))


def _judged(rows: DataFrame, density: DataFrame | None = None) -> DataFrame:
    """Rows of nodes with pairs that are still to be compared, with ``outside`` (see _mains) and ``dense``."""
    nodes = common.stored(_mains(rows).join(density or _density(rows), "node").select("node", "outside", "dense", "c"), "nodes-judged")
    return common.with_lookup(rows, "node", nodes, "c", common.hot_limit(rows.count())).where("outside IS NOT NULL")


def _settled(rows: DataFrame) -> DataFrame:
    """Rows of large roots, judged, with the group of each class: the first dense root that holds it."""
    density = common.stored(_density(rows), "density")
    dense = density.where("dense").select("node")
    inside = rows.join(F.broadcast(dense) if density.count() <= MOST_BROADCAST_IDS else dense, "node", "left_semi")
    groups = inside.groupBy(F.col("rep").alias("_rep")).agg(F.min(F.struct("tree", "node")).alias("g")).select("_rep", F.col("g.node").alias("grp"))
    return _judged(common.stored(rows.join(groups, F.col("rep") == F.col("_rep"), "left").drop("_rep"), "grouped"), density)


def _joined(links: DataFrame, comps: DataFrame, more: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Links and components with those of ``more``."""
    more = [x for x in more if not x.isEmpty()]
    if not more:
        return links, comps
    known = comps.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    return _union([links, *more]), common.stored(common.components(_union([known, *more])), "components")


def brute_force(docs: list[tuple], width: int, percent: int) -> dict:
    """id -> (n_shingles, component_id), comparing all pairs on word tuples; for tests with distinct ids."""
    sets = {}
    for i, text in docs:
        ws = (text or "").encode().translate(common.LOWER).split()
        sets[i] = {tuple(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))} if ws else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}
