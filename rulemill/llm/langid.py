"""Language ID as multilingual mixture inference.

A character trigram model per language, backed off to bigrams and single characters, gives each word a likelihood under each language. A document is a mixture: expectation-maximisation
estimates the language proportions that make its words likeliest. The language set is selected by penalised likelihood: starting from the likeliest single
language, the nested sets of the heaviest languages are fitted, and the set of the highest likelihood less a penalty for each further language is kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_DOCUMENTS = 12_000
EM_STEPS = 8
PENALTY = 3.0
LEAST_SHARE = 0.02
LONGEST = 64
UNDETERMINED = "und"


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(c for c in word.lower() if c.isalpha())


def split(text: str) -> list[str]:
    """The words of a text; of each run longer than LONGEST without white space, all letters, in consecutive pieces of that length."""
    ws = text.split()
    if not ws or max(map(len, ws)) <= LONGEST:
        return ws
    out = []
    for w in ws:
        if len(w) > LONGEST:
            w = letters(w)
            out.extend(w[i : i + LONGEST] for i in range(0, len(w), LONGEST))
        else:
            out.append(w)
    return out


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class Model:
    """Log probabilities of the last character of each trigram, by language; ``backoff`` by bigram and ``single`` by character for unseen ones."""

    langs: list[str]
    rows: dict[str, int]
    table: np.ndarray
    floor: np.ndarray

    def word(self, word: str) -> np.ndarray | None:
        """Log likelihood of a word under each language; None without letters."""
        w = letters(word)
        if not w:
            return None
        rows = self.rows
        found = []
        for g in grams(w):
            i = rows.get(g)
            if i is None:
                i = rows.get(g[1:])
                if i is None:
                    i = rows.get(g[2:], -1)
            found.append(i)
        return self.table[found].sum(0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 3, held: int = 1, most: int = MOST_DOCUMENTS) -> Model:
    """Count n-grams by language over at most about ``most`` documents with a language outside the held-out split."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (common.crc_mod(id_col, mod) != held))
    sample = common.bounded_sample(known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")), "_id", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in common.pieces(batches, "_text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(split(text))
        for lang, counts in words.items():
            n: Counter = Counter()
            for word, k in counts.items():
                w = letters(word)
                if w:
                    for g in grams(w):
                        n[g] += k
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64())], ["lang", "gram", "n"])

    counted = sample.select("_lang", "_text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return build([(r.lang, r.gram, r.n) for r in counted.collect()])


def build(counts: list[tuple[str, str, int]], k: float = 2.0) -> Model:
    langs = sorted({lang for lang, _, _ in counts})
    at = {lang: i for i, lang in enumerate(langs)}
    tri: dict[str, np.ndarray] = {}
    for lang, g, n in counts:
        tri.setdefault(g, np.zeros(len(langs)))[at[lang]] += n
    bi, one = {}, {}
    for g in sorted(tri):
        bi.setdefault(g[1:], np.zeros(len(langs)))
        bi[g[1:]] += tri[g]
        one.setdefault(g[2:], np.zeros(len(langs)))
        one[g[2:]] += tri[g]
    total = sum(one.values(), np.zeros(len(langs)))
    p_one = {c: (n + 0.1) / (total + 0.1 * (len(one) + 200)) for c, n in one.items()}
    contexts: dict[str, np.ndarray] = {}
    for g, n in tri.items():
        contexts.setdefault(g[:2], np.zeros(len(langs)))
        contexts[g[:2]] += n
    befores: dict[str, np.ndarray] = {}
    for g, n in bi.items():
        befores.setdefault(g[0], np.zeros(len(langs)))
        befores[g[0]] += n
    p_two = {g: (n + k * p_one[g[1]]) / (befores[g[0]] + k) for g, n in bi.items()}
    rows, table = {}, []
    for g in sorted(tri):
        rows[g] = len(table)
        table.append(np.log((tri[g] + k * p_two[g[1:]]) / (contexts[g[:2]] + k)))
    for source in (p_two, p_one):
        for g in sorted(source):
            rows[g] = len(table)
            table.append(np.log(source[g]))
    floor = np.log(0.1 / (total + 0.1 * (len(one) + 200))) if langs else np.zeros(0)
    table.append(floor)
    return Model(langs, rows, np.array(table, np.float32).reshape(len(table), len(langs)), floor)


@dataclass
class Words:
    """Likelihood rows of the words seen so far, in one growing array."""

    model: Model
    most: int = 400_000
    number: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.values = np.zeros((1 << 16, len(self.model.langs)), np.float32)
        self.number.clear()
        self.used = 1  # row 0: no letters

    def reset(self) -> None:
        if self.used > self.most or len(self.number) > self.most:  # words without letters get no row
            self.__post_init__()

    def ids(self, text: str) -> np.ndarray:
        number = self.number
        out = []
        for w in split(text):
            i = number.get(w)
            if i is None:
                value = self.model.word(w)
                if value is None:
                    i = 0
                else:
                    if self.used == len(self.values):
                        self.values = np.concatenate([self.values, np.zeros_like(self.values)])
                    i, self.used = self.used, self.used + 1
                    self.values[i] = value
                number[w] = i
            if i:
                out.append(i)
        return np.array(out, np.int32)


def em(p: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray, allowed: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihoods of documents whose words have likelihoods p (largest scaled to 1), within the allowed languages."""
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(steps):
        r = pi[doc] * p
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, starts, axis=0) / n[:, None]
        pi = np.maximum(pi, 1e-6) * allowed
        pi /= pi.sum(1, keepdims=True)
    return pi, np.add.reduceat(np.log((pi[doc] * p).sum(1)), starts)


def infer(texts: list[str | None], words: Words) -> list[np.ndarray | None]:
    """Language proportions of the selected set of each text; None for a text without letters."""
    model = words.model
    words.reset()
    ids = [words.ids(t) if t else np.zeros(0, np.int32) for t in texts]
    out: list[np.ndarray | None] = [None] * len(texts)
    at = [i for i, x in enumerate(ids) if len(x)]
    if not at or not model.langs:
        return out
    n = np.array([len(ids[i]) for i in at])
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    doc = np.repeat(np.arange(len(at)), n)
    ll = words.values[np.concatenate([ids[i] for i in at])].astype(np.float64)
    best = ll.max(1, keepdims=True)
    p = np.maximum(np.exp(ll - best), 1e-30)
    single = np.add.reduceat(np.maximum(ll - best, np.log(1e-30)), starts, axis=0)
    top = single.argmax(1)
    chosen = np.zeros((len(at), len(model.langs)))
    chosen[np.arange(len(at)), top] = 1.0
    value = single[np.arange(len(at)), top] - 0.0
    pi, _ = em(p, doc, starts, n, np.ones_like(chosen))
    for size in range(2, len(model.langs) + 1):
        rank = np.argsort(-pi, axis=1, kind="stable")
        todo = np.flatnonzero(np.take_along_axis(pi, rank[:, size - 1 : size], 1)[:, 0] > LEAST_SHARE)
        if not len(todo):
            break
        allowed = np.zeros((len(todo), len(model.langs)))
        np.put_along_axis(allowed, rank[todo, :size], 1.0, axis=1)
        pick = np.isin(doc, todo)
        fitted, like = em(p[pick], np.searchsorted(todo, doc[pick]), np.concatenate(([0], np.cumsum(n[todo])[:-1])), n[todo], allowed)
        score = like - PENALTY * (size - 1) * np.log(n[todo] + 1)
        better = score > value[todo]
        chosen[todo[better]] = fitted[better]
        value[todo[better]] = score[better]
    for k, i in enumerate(at):
        out[i] = chosen[k]
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", mod: int = 3, held: int = 1) -> DataFrame:
    """Per document: id, held_out, lang_pred (the heaviest language of the selected set, the first by name of equals), score (its proportion), langs and shares (the set).

    A text that is null, empty or without letters is ``und`` with score 0; so is every text if no language was learned. A null id is never held out.
    Repeated rows give repeated results; an empty table gives an empty table; further columns, whatever their names, are not read. Texts are read whole, however long. Words are cut at white space, longer ones than 64 also into pieces of up to 64 letters; every letter counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that the model was counted on
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = Words(m)
        for batch in common.pieces(batches, "_text", 4 << 20):
            names, scores, sets, shares = [], [], [], []
            for pi in infer(batch.column(1).to_pylist(), words):
                if pi is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    sets.append([])
                    shares.append([])
                else:
                    i = int(pi.argmax())
                    order = [j for j in np.argsort(-pi, kind="stable") if pi[j] > 0]
                    names.append(m.langs[i])
                    scores.append(min(1.0, float(pi[i])))
                    sets.append([m.langs[j] for j in order])
                    shares.append([float(pi[j]) for j in order])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["_id", "lang_pred", "score", "langs", "shares"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, lang_pred string, score double, langs array<string>, shares array<double>")
    return out.select(F.col("_id").alias(id_col), (common.crc_mod("_id", mod) == held).alias("held_out"), "lang_pred", "score", "langs", "shares")
