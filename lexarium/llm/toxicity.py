"""Toxicity: a learnt lexicon as a trie, Levenshtein automata over it, context windows, one small logistic model."""

from __future__ import annotations

import re
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, small_batches, without, written

#: Labelled rows that the lexicon and the weights are learnt from, at most about (a uniform sample by hash of the id).
LABELLED = 20_000
#: Words that may pass for terms by chance, about.
CHANCE = 25
#: The least length of a term that may be misspelled: a shorter one has other words one edit away.
FUZZY_FROM = 5
#: Bytes of text whose words a task holds at once.
HELD = 1 << 20
#: Words on either side of a term that belong to its context.
WINDOW = 6
_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile("[\"“”„«»]")
_CITED = re.compile(r"[^\S\n]*>")


class Matcher:
    """Words within one edit of a lexicon: the Levenshtein automaton of distance 1 intersected with the lexicon's trie.

    A state is a set of (trie node, errors so far). States are made deterministic when a word first reaches them, so
    that a word costs one table lookup for each letter, and most words reach the dead state after a few.
    """

    def __init__(self, terms: list[str]):
        self.terms, self.next, self.term = terms, [{}], [-1]
        for t, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                node = self.next[node][c]
            self.term[node] = t
        self.letters = {c for kids in self.next for c in kids}
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.sets: list[frozenset] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, states: set) -> frozenset:
        """With the letters that a word may leave out; (node, 1) goes if (node, 0) is there."""
        for node, errors in list(states):
            if errors == 0:
                states |= {(kid, 1) for kid in self.next[node].values()}
        return frozenset(x for x in states if x[1] == 0 or (x[0], 0) not in states)

    def _state(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.moves)
            self.moves.append({})
            self.sets.append(states)
            ends = [(e, self.term[n]) for n, e in states if self.term[n] >= 0 and (e == 0 or len(self.terms[self.term[n]]) >= FUZZY_FROM)]
            self.ends.append(min(ends) if ends else None)
        return self.ids[states]

    def _move(self, state: int, letter: str) -> int:
        out = set()
        for node, errors in self.sets[state]:
            if letter in self.next[node]:
                out.add((self.next[node][letter], errors))
            if errors == 0:
                out.add((node, 1))
                out |= {(kid, 1) for c, kid in self.next[node].items() if c != letter}
        self.moves[state][letter] = to = self._state(self._closed(out))
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term within one edit, or None; ties go to the earlier term."""
        state = self.start
        for c in word:
            if c not in self.letters:
                c = ""
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == self.dead:
                return None
        return self.ends[state]


FEATURES = 9


def features(text: str, words: list[str], hits: dict[str, tuple[int, int]], weight: np.ndarray) -> np.ndarray:
    """What a document's matches say: weights of bare, misspelled and quoted terms, their density, their neighbours.

    A term counts as quoted if its line opens with > or an odd number of quotation marks stands before it in the line.
    """
    x = np.zeros(FEATURES)
    x[0] = 1
    x[8] = np.log1p(len(words))
    at = [i for i, w in enumerate(words) if w in hits]
    if not at:
        return x
    wanted, spans = set(at), {}
    low = text.lower()
    for i, m in enumerate(_WORD.finditer(low)):
        if i in wanted:
            spans[i] = m.start()
    seen: set = set()
    total, last, marks, cited = 0.0, 0, 0, bool(_CITED.match(low))
    for k, i in enumerate(at):
        edits, term = hits[words[i]]
        line = low.rfind("\n", last, spans[i])  # each character is looked at once, however many terms a line has
        if line >= 0:
            last, marks, cited = line + 1, 0, bool(_CITED.match(low, line + 1))
        marks += len(_QUOTES.findall(low, last, spans[i]))
        last = spans[i]
        quoted = cited or marks % 2 == 1
        near = any(abs(at[j] - i) <= WINDOW for j in (k - 1, k + 1) if 0 <= j < len(at))
        w = weight[term] * (0.7 if edits else 1.0)
        if (term, edits, quoted) not in seen:
            seen.add((term, edits, quoted))
            x[3 if quoted else 2 if edits else 1] += w
        if not quoted:
            total += w
            x[4] = max(x[4], 0 if edits else w)
            x[5] += near
    x[5] = np.log1p(x[5])
    x[6] = np.log1p(100 * total / len(words))
    x[7] = np.log1p(total)
    return x


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(terms: tuple[str, ...]) -> Matcher:
    if terms not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[terms] = Matcher(list(terms))
    return _MATCHERS[terms]


def _rows(batch: pa.RecordBatch, text_col: str, model: dict):
    """Features of each text."""
    m, weight, clean = _matcher(model["terms"]), model["weight"], model["clean"]
    texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
    words = [_WORD.findall(t.lower()) for t in texts]
    hits = {w: got for w in set().union(*words) if w not in clean and (got := m.match(w))} if words else {}
    return [features(t, w, hits, weight) for t, w in zip(texts, words, strict=True)]


def _distinct(batches):
    for batch in batches:
        for part in small_batches(batch, "text", HELD):
            words = [sorted(set(_WORD.findall((t or "").lower()))) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("toxic")), pa.array(words, pa.list_(pa.string()))], ["toxic", "words"])
    release()


def _near_terms(terms: tuple[str, ...]):
    def run(batches):
        m = Matcher(list(terms))
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([w for w in words if (got := m.match(w)) and got[0]], pa.string())], ["w"])
        release()

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> dict:
    """Learn lexicon and weights from the labelled rows (id_col, label_col 0/1) given; null ids and labels are left out.

    Of more than `labelled` rows, those of the smallest hashes are used. Several labels of one id count as the highest.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_lx_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    n = rows.count()
    if n > labelled:
        rows = rows.where(F.pmod(F.xxhash64("_lx_id"), F.lit(1 << 30)) < int((1 << 30) * labelled / n))
    # the sample is bounded by `labelled`, so it may be broadcast
    sample = docs.select(F.col(id_col).alias("_lx_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(rows), "_lx_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = written(sample, "labelled")  # copies of one text count once
    model = {"terms": (), "weight": np.zeros(0), "clean": frozenset(), "beta": None}
    seen = sample.mapInArrow(_distinct, "toxic int, words array<string>")
    split = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    good, bad = split.get(0, 0), split.get(1, 0)
    if not bad or not good:
        return model
    words = seen.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a + b > 1")
    odds = F.log((F.col("a") + 0.5) / (bad - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (good - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    # the bar grows with the number of words tried, so that about CHANCE pass it by chance, whatever that number
    tried = words.where("a > 1").count()
    least = max(2.8, -NormalDist().inv_cdf(min(CHANCE / max(tried, 1), 0.5)))
    top = words.where("a > 1").withColumn("odds", odds).withColumn("z", z).where((F.col("odds") > 1.2) & (F.col("z") > least)).orderBy(F.desc("z"), "w").collect()  # words of the bounded sample
    if not top:
        return model
    model["terms"], model["weight"] = tuple(r["w"] for r in top), np.array([r["odds"] for r in top])
    # clean words that happen to lie one edit from a term: as many as the bounded sample has
    clean = words.where(f"b > 1 and a * {good} <= 1.5 * b * {bad}").select("w").mapInArrow(_near_terms(model["terms"]), "w string").toPandas()
    model["clean"] = frozenset(clean["w"]) - set(model["terms"])

    def rows_out(batches, model=model):
        for batch in batches:
            for part in small_batches(batch, "text", HELD):
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("toxic")), pa.array([x.tolist() for x in _rows(part, "text", model)], pa.list_(pa.float64()))], ["y", "x"])
        release()

    got = sample.mapInArrow(rows_out, "y int, x array<double>").toPandas()
    model["beta"] = logistic(np.array(got["x"].tolist()), got["y"].to_numpy(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Ridge logistic regression by Newton's method; x[:, 0] is 1. Scales are folded into the weights."""
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd[0] = 0, 1
    sd[sd == 0] = 1
    s = (x - mean) / sd
    beta, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(s @ beta, -30, 30)))
        step = np.linalg.solve(s.T @ (s * (p * (1 - p))[:, None]) + keep + 1e-9 * np.eye(len(beta)), s.T @ (y - p) - keep @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    beta = beta / sd
    beta[0] -= (beta[1:] * mean[1:]).sum()
    return beta


def _scores(text_col: str, model: dict):
    def run(batches):
        for batch in batches:
            for part in small_batches(batch, text_col, HELD):
                if model["beta"] is None:
                    score = np.zeros(part.num_rows)
                else:
                    score = 1 / (1 + np.exp(-np.clip(np.array(_rows(part, text_col, model)) @ model["beta"], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "_lx_score"])
        release()

    return run


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with _lx_score, the probability that a text is toxic, and _lx_toxic (score >= 0.5).

    Only the text is used, whole. A null text counts as empty; an empty text gets the score of no match. Without a
    learnt lexicon every score is 0. Ids may repeat or be null; other columns are passed on, those named like an output
    give way to it. No shuffle.
    """
    docs = without(docs, "_lx_score", "_lx_toxic")
    schema = T.StructType([*docs.schema.fields, T.StructField("_lx_score", T.DoubleType())])
    return docs.mapInArrow(_scores(text_col, model), schema).withColumn("_lx_toxic", F.col("_lx_score") >= 0.5)


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels whose crc32(id as text) mod 5 is not 0."""
    return labels.where(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != 0)
