import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.llm import common, langid, lm, quality, toxicity

SF = "/root/testdata/sf0.01"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def remainder(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    s, y = np.asarray(scores)[order], np.asarray(labels)[order]
    ranks = np.array([(np.searchsorted(s, v) + np.searchsorted(s, v, side="right") + 1) / 2 for v in s])
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


# --- Language ID ---------------------------------------------------------------------------------------------------------------


def test_language_accuracy(spark, docs):
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(truth)
    held = [d for d in got if got[d].held_out]
    assert set(held) == {d for d in got if remainder(d, 3) == 1}
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def mixed_model():
    r = random.Random(1)
    text = {"aa": "lorem ipsum dolor sit amet consectetur adipiscing elit", "bb": "quick brown fox jumps over the lazy dog", "cc": "zwölf boxkämpfer jagen viktor quer über den großen sylter deich"}
    counts = Counter((lang, g) for lang, t in text.items() for _ in range(50) for w in t.split() for g in langid.grams(w))
    return langid.build([(lang, g, n) for (lang, g), n in counts.items()]), text, r


def test_mixtures():
    model, text, r = mixed_model()
    words = langid.Words(model)
    pick = lambda lang, n: [r.choice(text[lang].split()) for _ in range(n)]
    a = pick("aa", 60) + pick("bb", 20)
    r.shuffle(a)
    one, two, none, empty = langid.infer([" ".join(pick("cc", 50)), " ".join(a), "12 !! 3", None], words)
    assert list(one > 0) == [False, False, True]
    assert two[0] == pytest.approx(0.75, abs=0.05) and two[1] == pytest.approx(0.25, abs=0.05) and two[2] == 0
    assert none is None and empty is None


def test_likelihood_grows_with_each_step():
    model, text, r = mixed_model()
    words = langid.Words(model)
    ids = words.ids(" ".join(text.values()))
    ll = words.values[ids].astype(float)
    p = np.exp(ll - ll.max(1, keepdims=True))
    doc, starts, n, allowed = np.zeros(len(ids), int), np.array([0]), np.array([len(ids)]), np.ones((1, 3))
    likes = [langid.em(p, doc, starts, n, allowed, k)[1][0] for k in range(6)]
    assert all(b >= a - 1e-9 for a, b in zip(likes, likes[1:], strict=False))


def test_language_edges(spark):
    data = [(1, "the cat and the dog", "en", "x"), (2, "der hund und die katze", "de", "x"), (3, None, "de", "x"), (4, "", "en", "x"), (5, "12 34 ...", "en", "x"), (None, "the dog", "en", "x"), (7, "the cat", None, "x"), (1, "the cat and the dog", "en", "x"), (8, "und der " * 20000, None, "x")]
    df = rows(spark, data, "doc_id long, text string, lang string, score string")
    model = langid.fit(df, mod=1000, held=-5)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(df, model).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (7, "en"), (1, "en"), (8, "de")]))
    nothing = langid.identify(df, langid.fit(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_words_without_letters_stay_bounded():
    model, _, _ = mixed_model()
    words = langid.Words(model, most=50)
    for k in range(20):
        langid.infer([" ".join(str(1000 * k + i) for i in range(40))], words)
    assert len(words.number) <= 90


def test_language_clashes(spark):
    df = rows(spark, [(1, "the cat", "en"), (2, "der hund", "de")], "doc_id long, text string, lang string").selectExpr("*", "1 AS _id", "2 AS _text", "3 AS _lang", "4 AS lang_pred", "5 AS langs", "true AS held_out")
    assert sorted(r.lang_pred for r in langid.identify(df, langid.fit(df, mod=1000, held=-5)).collect()) == ["de", "en"]


def test_long_runs_are_read_whole(spark):
    r = random.Random(6)
    run = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    texts = {"aa": [run("abcdefgh", 700) for _ in range(20)], "bb": [run("stuvwxyz", 700) for _ in range(20)]}
    data = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    new = [(100, run("abcdefgh", 64) + run("stuvwxyz", 1920), None), (101, "-7" * 32 + run("stuvwxyz", 30), None), (102, run("abcdefgh", 1280) + run("stuvwxyz", 640), None), (103, "-7" * 500, None)]
    df = rows(spark, data + new, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(df, langid.fit(df, mod=1000, held=-5)).collect()}
    assert (got[100].lang_pred, got[101].lang_pred, got[102].lang_pred) == ("bb", "bb", "aa")
    assert got[102].langs == ["aa", "bb"] and got[102].shares == pytest.approx([2 / 3, 1 / 3], abs=0.05)
    assert (got[103].lang_pred, got[103].score) == ("und", 0)
    text = "ab" * 500 + " cd " + "1" * 70 + "ef"
    assert "".join(langid.split(text)) == "ab" * 500 + "cdef" and max(map(len, langid.split(text))) == 64


# --- Toxicity and quality ------------------------------------------------------------------------------------------------------


def test_toxicity_ranks_held_out_rows_of_few_labels(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    pairs = [(a > b) + (a == b) / 2 for a, y in held for b, z in held if y == 1 and z == 0]
    assert sum(pairs) / len(pairs) >= 0.7
    # Labels of held-out rows are never learned from.
    blind = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, blind)).collect()} == pytest.approx({k: r.score for k, r in got.items()})


def test_toxicity_held_out(docs, labels):
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc(*zip(*held, strict=True)) > 0.85
    flagged = [y for s, y in held if s >= 0.7]
    assert np.mean(flagged) > 0.8


def test_quality_held_out(docs, labels):
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc(*zip(*held, strict=True)) > 0.85


def test_grammar_matches_clauses():
    g = toxicity.Grammar({"fool": 2.0, "dolt*": 2.0, "x" * 40: 2.0}, np.zeros(toxicity.FEATURES), 0.0)
    memo = common.Memo(g.read)
    x = lambda text: np.expm1(g.features(text, memo)[:16]).round(6)
    plain, aimed, negated, reported, threat = 0, 1, 2, 4, 9
    assert x("what a Fool!")[plain] == 1
    assert x("you absolute fool")[aimed] == 1 and x("you are, well, quite a fool")[plain] == 1
    assert x("he is not a fool")[negated] == 1 and x("you are no fool")[negated | aimed] == 1
    assert x("they said: fool. fool")[plain] == 2  # the clause ends at the colon
    assert x("she said that a man is a fool. fool")[reported] == 1
    assert x("I will kill you")[threat] == 1 and x("kill time")[:16].sum() == 0
    assert x("doltish talk")[plain] == 1 and x("dolt")[:16].sum() == 0
    assert x("X" * 40)[plain] == 1  # long entries match whole
    assert not g.features(None, memo).any() and not g.features("nice day", memo).any()


def by_hand(symbols, w):
    """Matches of one clause and their path weights, from the words around each."""
    out = []
    matched_target = set()  # places of targets and of matched threats
    for i, s in enumerate(symbols):
        near = range(max(0, i - toxicity.REACH), i)
        targets = [j for j in near if symbols[j] == toxicity.TARGET or j in matched_target]
        negated = any(symbols[j] == toxicity.NEGATION for j in near)
        reported = any(x == toxicity.REPORT for x in symbols[:i])
        threat = s == toxicity.TARGET and any(symbols[j] == toxicity.THREAT for j in near) or s == toxicity.THREAT and any(symbols[j] == toxicity.TARGET for j in near)
        if s == toxicity.INSULT or threat:
            bits = negated << 1 | reported << 2 | (1 if threat or targets else 0)
            weight = (w.threat if threat else w.insult) + w.negated * negated + w.reported * reported + w.aimed * bool(targets)
            out.append((i, 8 * bool(threat) + bits, weight))
        if threat:
            matched_target.add(i)
    return out


def test_composition_equals_the_cascade_and_paths_by_hand():
    w = toxicity.Weights(0.1, 1.3, 0.7, -1.1, -0.4)
    machine, cascade = toxicity.composed(w), toxicity.machines(w)
    r = random.Random(3)
    for _ in range(3000):
        symbols = [r.randrange(7) for _ in range(r.randint(1, 25))]
        got = machine.run([8 * s for s in symbols])
        codes, total = [8 * s for s in symbols], np.zeros(len(symbols))
        for m in cascade:
            step = m.run(codes)
            codes, total = [c for c, _ in step], total + [v for _, v in step]
        assert [c for c, _ in got] == codes and [v for _, v in got] == pytest.approx(total)
        at = 0
        for clause in " ".join(map(str, symbols)).split(str(toxicity.END)):
            part = [int(x) for x in clause.split()]
            want = by_hand(part, w)
            found = [(i, c - 8 * toxicity.MATCHED_INSULT, v) for i, (c, v) in enumerate(got[at : at + len(part)]) if c >= 8 * toxicity.MATCHED_INSULT]
            assert [x[:2] for x in found] == [x[:2] for x in want] and [x[2] for x in found] == pytest.approx([x[2] for x in want])
            at += len(part) + 1


def test_no_insult_is_known_beforehand():
    g = toxicity.Grammar({}, np.zeros(toxicity.FEATURES), 0.0)
    assert toxicity.INSULT not in set(g.symbols.values())


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_scoring_edges(spark, module, label):
    texts = ["good words here", "bad fool you", None, "", "x " * 30000]
    df = rows(spark, [(i, texts[i % 5], "s", "en") for i in range(60)] + [(None, "a", "s", "en"), (3, None, "s", "en")], "doc_id long, text string, score string, lang string")
    lab = rows(spark, [(i, int(i % 5 == 1)) for i in range(60)] + [(1, 0), (1, None), (None, 1)], f"doc_id long, {label} int")
    got = module.score(df, module.fit(df, lab), keep=["text", "lang"])
    assert got.columns == ["doc_id", "text", "lang", "held_out", "score", "predicted"]
    back = got.collect()
    assert len(back) == 62 and all(0 <= r.score <= 1 for r in back) and sum(r.text is None for r in back) == 13
    for other in (lab.limit(0), lab.where(f"{label} = 1")):
        assert all(0 <= r.score <= 1 for r in module.score(df, module.fit(df, other)).collect())
    assert module.score(df.limit(0), module.fit(df.limit(0), lab)).count() == 0
    clash = df.selectExpr("doc_id", "text", "'a' AS predicted", "true AS held_out", "1 AS _id", "2 AS _k0", "3 AS `odd. name`", "4 AS _text", "5 AS _score", "lang AS score")
    model = module.fit(clash, lab)
    got = module.score(clash, model, keep=clash.columns)
    assert got.columns == ["doc_id", "text", "_id", "_k0", "odd. name", "_text", "_score", "held_out", "score", "predicted"]
    first = got.where("doc_id = 7").first()
    assert (first["_id"], first["_k0"], first["odd. name"], first["_text"], first["_score"]) == (1, 2, 3, 4, 5)
    passing = (module.good if module is quality else module.harmless)(clash, model)
    assert passing.columns == clash.columns
    test = (lambda p: p >= 0.3) if module is quality else (lambda p: p < 0.7)
    assert sorted(map(str, passing.collect())) == sorted(str(r) for r, s in zip(clash.coalesce(1).collect(), module.score(clash.coalesce(1), model).collect(), strict=True) if test(s.score))


def test_contexts_do_not_depend_on_partitions(spark, docs):
    a, b = quality.count_contexts(docs.repartition(3)), quality.count_contexts(docs.coalesce(1))
    assert (a == b).all() and a.any()
    text = "aa bb aa"
    got = quality.count_contexts(rows(spark, [(text,), ("cc",), (None,)], "text string"))
    places, signs = quality.index_vectors()
    want = np.zeros_like(got)
    ws = text.split()
    for i, j in ((0, 1), (1, 0), (1, 2), (2, 1)):
        np.add.at(want[quality.term(ws[i])], places[quality.term(ws[j])], signs[quality.term(ws[j])])
    assert (got == want).all()


def test_quality_reads_long_runs_whole(spark):
    r = random.Random(7)
    run = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    text = "。".join(["天地玄黄宇宙洪荒"] * 30) + " ab " + "x1-" * 100
    assert "".join(quality.split(text)) == text.replace(" ", "") and max(map(len, quality.split(text))) <= 64
    assert quality.term("aB1-" * 5 + "x" + "!a?" * 8) != quality.term("aB1-" * 5 + "x" + "?!a" * 8)  # the same up to the 24th character of the shape
    front = "，".join(run("甲乙丙丁", 4) for _ in range(60)) + "，"
    data = [(i, front + "，".join(run("春夏秋冬" if i % 2 else "东南西北", 4) for _ in range(200))) for i in range(400)]
    df, lab = rows(spark, data, "doc_id long, text string"), rows(spark, [(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = [x for x in quality.score(df, quality.fit(df, lab)).collect() if x.held_out]
    assert auc([x.score for x in got], [x.doc_id % 2 for x in got]) > 0.95


def test_network_gradient_fits():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.train(x, y, np.zeros((1, 4), np.float32), epochs=80)
    p = net.probability(x)
    assert np.mean((p > 0.5) == (y == 1)) > 0.93
    sure = p > 0.9
    assert abs(y[sure].mean() - p[sure].mean()) < 0.06


# --- Language model ------------------------------------------------------------------------------------------------------------


def brute_lm(train, texts):
    """Base and Kneser-Ney scores with dictionaries."""
    words = lambda t: (t or "").encode().translate(common.LOWER).split()
    c, pairs = Counter(), Counter()
    for t in train:
        ws = words(t)
        c.update([*ws, "</s>"])
        pairs.update(zip(["<s>", *ws], [*ws, "</s>"], strict=True))
    n, v = sum(c.values()), len(c)
    before, after, total = Counter(), defaultdict(Counter), Counter()
    for (a, b), k in pairs.items():
        before[b] += 1
        after[a][min(k, 3)] += 1
        total[a] += k
    d = [0, *lm._discounts([sum(k == i for k in pairs.values()) for i in (1, 2, 3, 4)])]
    e = [0, *lm._discounts([sum(k == i for k in before.values()) for i in (1, 2, 3, 4)])]
    spare = sum(e[min(k, 3)] for k in before.values())

    def p(a, b):
        low = (max(before[b] - e[min(before[b], 3)], 0) + spare / (v + 1)) / len(pairs) if pairs else 1 / (v + 1)
        if not total[a]:
            return low
        k = pairs[a, b]
        return (max(k - d[min(k, 3)], 0) + sum(d[i] * m for i, m in after[a].items()) * low) / total[a]

    out = []
    for t in texts:
        ws = words(t)
        seq = [*ws, "</s>"]
        out.append((len(seq), sum(c[w] > 0 for w in seq), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in seq), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *ws], seq, strict=True))))
    return out, p, c


def test_model_equals_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(vocab[: r.randint(2, 40)]) for _ in range(r.randint(0, 50))) for _ in range(120)] + [None, "", "NEW unseen W1 w1", "é É w2 w3", "w1 " * 3000]
    df = rows(spark, list(enumerate(texts)) + [(None, "w1 w2"), (5, texts[5])], "doc_id long, text string").repartition(5)
    data = [(x.doc_id, x.text) for x in df.collect()]
    train = [t for d, t in data if d is None or remainder(d, 7) != 2]
    got = lm.fit_and_score(df).collect()
    assert len(got) == len(data)
    want, _, _ = brute_lm(train, [t for _, t in data])
    by = defaultdict(list)
    for (d, _), w in zip(data, want, strict=True):
        by[d].append(w)
    for g in got:
        w = by[g.doc_id].pop()
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert g.base_score == pytest.approx(w[3], rel=1e-9) and g.score == pytest.approx(w[4], rel=1e-9)
        assert g.held_out == (g.doc_id is not None and remainder(g.doc_id, 7) == 2)
        assert g.perplexity == pytest.approx(10 ** (-g.score / g.n_tokens))


def test_probabilities_sum_to_one():
    _, p, c = brute_lm(["a b a c", "b a", "c c a b d"], [])
    for context in ("<s>", b"a", b"c", "unseen"):
        assert sum(p(context, w) for w in c) + p(context, "unknown") == pytest.approx(1)


def test_small_shards_and_hot_contexts_agree(spark, docs, monkeypatch):
    few = docs.limit(150)
    want = {r.doc_id: r.score for r in lm.fit_and_score(few).collect()}
    monkeypatch.setattr(lm, "PAIRS_PER_SHARD", 300)
    monkeypatch.setattr(lm, "HOT_SHARE", 20)
    monkeypatch.setattr(lm, "FAN", 7)
    got = {r.doc_id: r.score for r in lm.fit_and_score(few.repartition(9)).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], rel=1e-9) for d in want)


def brute_lm_three(train, texts):
    """Kneser-Ney scores of order three with dictionaries."""
    words = lambda t: (t or "").encode().translate(common.LOWER).split()
    three, raw = Counter(), Counter()
    for t in train:
        ws = ["<s>", *words(t), "</s>"]
        raw.update(zip(ws, ws[1:], strict=False))
        three.update(zip(ws, ws[1:], ws[2:], strict=False))
    two, one = Counter(), Counter(b for _, b in raw)
    for pair, k in raw.items():
        if pair[0] == "<s>":
            two[pair] = k
    two.update((b, c) for _, b, c in three)
    ds = [[0, *lm._discounts([sum(k == i for k in n.values()) for i in (1, 2, 3, 4)])] for n in (one, two, three)]
    after2, after3, total = defaultdict(Counter), defaultdict(Counter), Counter()
    for (a, _), k in two.items():
        after2[a][min(k, 3)] += 1
        total[a] += k
    for (a, b, _), k in three.items():
        after3[a, b][min(k, 3)] += 1
    v, spare = len({w for t in train for w in words(t)}) + 1, sum(ds[0][min(k, 3)] for k in one.values())

    def p(a, b, c):
        low = (max(one[c] - ds[0][min(one[c], 3)], 0) + spare / (v + 1)) / len(raw)
        if total[b]:
            low = (max(two[b, c] - ds[1][min(two[b, c], 3)], 0) + sum(ds[1][i] * m for i, m in after2[b].items()) * low) / total[b]
        if a is None or not raw[a, b]:
            return low
        k = three[a, b, c]
        return (max(k - ds[2][min(k, 3)], 0) + sum(ds[2][i] * m for i, m in after3[a, b].items()) * low) / raw[a, b]

    return [sum(math.log10(p(*x)) for x in zip([None, "<s>", *words(t)], ["<s>", *words(t)], [*words(t), "</s>"], strict=False)) for t in texts], p, one


def test_order_three_equals_brute_force(spark, monkeypatch):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(vocab[: r.randint(2, 40)]) for _ in range(r.randint(0, 50))) for _ in range(120)] + [None, "", "NEW unseen W1 w1", "é É w2 w3", "w1 " * 3000]
    df = rows(spark, list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want, p, one = brute_lm_three([t for d, t in enumerate(texts) if remainder(d, 7) != 2], texts)
    for context in (("<s>", b"w1"), (None, "<s>"), (b"w1", b"w2"), (b"w1", b"unseen")):
        assert sum(p(*context, w) for w in one) + p(*context, b"unknown") == pytest.approx(1)
    got = {x.doc_id: x.score for x in lm.fit_and_score(df, order=3).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)
    monkeypatch.setattr(lm, "PAIRS_PER_SHARD", 300)
    monkeypatch.setattr(lm, "HOT_SHARE", 20)
    monkeypatch.setattr(lm, "FAN", 3)
    again = {x.doc_id: x.score for x in lm.fit_and_score(df, order=3).collect()}
    assert [again[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)
    assert math.isfinite(lm.score(df, lm.fit(df.limit(0), order=3)).first().score)
    with pytest.raises(ValueError):
        lm.fit(df, order=4)


def test_untrained_model(spark):
    df = rows(spark, [(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, lm.fit(df.limit(0))).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0 and math.isfinite(got[1].score)
    assert lm.fit_and_score(df.limit(0)).count() == 0


def test_beats_base_on_held_out(docs):
    held = [r for r in lm.fit_and_score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# --- Whole queries against plain loops ------------------------------------------------------------------------------------------


def plain_mixture(model, text):
    """Shares of the selected languages of a text, one word and one language at a time; None without letters."""
    ws = [w for w in langid.split(text or "") if any(c.isalpha() for c in w)]
    if not ws or not model.langs:
        return None
    lls = []
    for w in ws:
        letters = "".join(c for c in w.lower() if c.isalpha())
        marked, total = f"^{letters}$", [0.0] * len(model.langs)
        for i in range(len(letters)):
            g = marked[i : i + 3]
            row = next((model.rows[k] for k in (g, g[1:], g[2:]) if k in model.rows), -1)
            total = [a + float(b) for a, b in zip(total, model.table[row], strict=True)]
        lls.append(total)
    scaled = [[max(math.exp(v - max(ll)), 1e-30) for v in ll] for ll in lls]

    def fit(allowed):
        pi = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(model.langs))]
        for _ in range(langid.EM_STEPS):
            sums = [0.0] * len(pi)
            for p in scaled:
                z = sum(a * b for a, b in zip(pi, p, strict=True))
                sums = [s + a * b / z for s, a, b in zip(sums, pi, p, strict=True)]
            pi = [max(s / len(scaled), 1e-6) if k in allowed else 0.0 for k, s in enumerate(sums)]
            pi = [x / sum(pi) for x in pi]
        return pi, sum(math.log(sum(a * b for a, b in zip(pi, p, strict=True))) for p in scaled)

    single = [sum(math.log(p[k]) for p in scaled) for k in range(len(model.langs))]
    top = single.index(max(single))
    best, value = [float(k == top) for k in range(len(single))], single[top]
    everything = fit(range(len(single)))[0]
    rank = sorted(range(len(single)), key=lambda k: (-everything[k], k))
    for size in range(2, len(single) + 1):
        if everything[rank[size - 1]] <= langid.LEAST_SHARE:
            break
        pi, like = fit(rank[:size])
        if like - langid.PENALTY * (size - 1) * math.log(len(scaled) + 1) > value:
            best, value = pi, like - langid.PENALTY * (size - 1) * math.log(len(scaled) + 1)
    return best


def test_languages_equal_plain_loops(spark, docs):
    model = langid.fit(docs)
    texts = dict(docs.select("doc_id", "text").orderBy("doc_id").limit(60).collect())
    keys = sorted(texts)
    texts |= {-1: " ".join((texts[a] or "")[:300] + " " + (texts[b] or "")[:200] for a, b in zip(keys[:8], keys[8:16], strict=True)), -2: None, -3: "12 ..", -4: "日本語" * 100}
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    for d, text in texts.items():
        want = plain_mixture(model, text)
        if want is None:
            assert (got[d].lang_pred, got[d].score, got[d].langs) == ("und", 0.0, [])
        else:
            assert got[d].lang_pred == model.langs[want.index(max(want))]
            assert dict(zip(got[d].langs, got[d].shares, strict=True)) == pytest.approx({model.langs[k]: x for k, x in enumerate(want) if x > 0}, rel=1e-3, abs=1e-6)


def test_toxicity_equals_plain_loops(spark, docs, labels):
    g = toxicity.fit(docs, labels)
    toxic = labels.where("toxic = 1").select("doc_id")
    texts = dict(docs.join(toxic, "doc_id").select("doc_id", "text").union(docs.select("doc_id", "text").orderBy("doc_id").limit(60)).collect())
    texts |= {-1: None, -2: "", -3: "you idiot! they said: you are no idiot. I kill you"}
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), g).collect()}
    for d, text in texts.items():
        read = [g.read(w) for w in (text or "").replace("\n", " . ").split()]
        clauses, now = [], []
        for s, w in read:
            now.append((s & 7, w))
            if s & 8 or s & 7 == toxicity.END:
                clauses.append(now)
                now = []
        found = [[(label, weight + c[i][1]) for i, label, weight in by_hand([s for s, _ in c], g.paths)] for c in [*clauses, now]]
        found = [c for c in found if c]
        x = [0.0] * toxicity.FEATURES
        if found:
            for c in found:
                for label, _ in c:
                    x[label] += 1
            hits, paths = sum(x), [max(0.0, sum(w for _, w in c)) for c in found]
            x = [math.log1p(v) for v in x[:16]] + [math.log1p(hits), math.log1p(sum(paths)), math.log1p(max(paths)), math.log1p(sum(p > 0 for p in paths)), math.log1p(100 * sum(paths) / len(read)), math.log1p(len({w for c in found for _, w in c}))]
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, g.weights, strict=True)) + g.bias))), rel=1e-6), d


def test_quality_equals_plain_loops(spark, docs, labels):
    net = quality.fit(docs, labels)
    texts = dict(docs.select("doc_id", "text").orderBy("doc_id").limit(60).collect()) | {-1: None, -2: "", -3: "word " * 30_000}
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), net).collect()}
    for d, text in texts.items():
        terms = [quality.term(w) for w in quality.split(text)]
        x = [sum(float(net.vectors[t][k]) for t in terms) / len(terms) if terms else 0.0 for k in range(quality.DIM)] + [math.log1p(len(terms)) / 10]
        z = [(v - m) / s for v, m, s in zip(x, net.mean, net.scale, strict=True)]
        h = [math.tanh(sum(v * net.w1[i][j] for i, v in enumerate(z)) + net.b1[j]) for j in range(len(net.b1))]
        logit = (sum(v * w for v, w in zip(h, net.w2, strict=True)) + net.b2) / net.temperature
        assert got[d] == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-3, abs=1e-6), d
