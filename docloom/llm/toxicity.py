"""Toxicity by a weighted finite-state grammar over clauses.

Five weighted transducers are written down as states and arcs and composed into one:

  insult    words of the vocabulary (given or learnt) become insults, each arc with its word's log-odds
  threat    words of violence become threats, aimed if a person is spoken to or about soon after
  negation  an insult or threat within reach behind a negation becomes a negated one
  report    behind a reporting verb or within quotation marks it becomes a reported one, to the clause's end
  target    within reach behind a word for a person it becomes an aimed one

The weight of a match is the product of its arcs' weights: a word's log-odds, little of it where the
word is denied or reported, more where it is aimed. A text scores by the weights of its matches alone, each word
once at its heaviest: by their sum, and by that sum over the root of the text's length. The two
coefficients and the intercept come from a logistic regression on labelled rows.

The vocabulary is learnt from all labelled training texts that differ, counted by Spark: words,
and beginnings of words for languages that inflect, whose log-odds of standing in a toxic
text stay above `LEAST_ODDS` when `ERRORS` standard errors are taken off. This test needs no limit
on the vocabulary's size; with `LEAST_SHARE` of the toxic texts as the least support, the length of texts
bounds it, whatever the size of the corpus. The regression alone is fitted on at most `FIT_ROWS`
labelled rows, taken evenly by a hash of doc_id.

Results: null and empty texts match nothing and get the score of an empty text. Each row is
scored alone and whole, however long, so repeated rows get equal scores and rows without doc_id are scored too.
A doc_id that is labelled more than once counts as toxic if any of its labels says so. Without labelled rows of both kinds the
given words and coefficients are used. Other columns pass `keep_clean` unchanged, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settle

#: Labelled rows that fit the coefficients, at most.
FIT_ROWS = 20_000
#: Labels, or learnt entries, that may be broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
LEAST_ODDS, ERRORS, LEAST_SHARE = 0.5, 3.0, 0.002
BEGINNINGS = (4, 5, 6)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, LINE = SYMBOLS = range(9)
#: What comes out for a match; the weights of the arcs that write them follow.
AIMED_INSULT, NEGATED_INSULT, REPORTED_INSULT, AIMED_THREAT, NEGATED_THREAT, REPORTED_THREAT = range(9, 15)
EVERY = range(15)
AIMED, NEGATED, REPORTED = 1.25, 0.05, 0.1
REACH = 4
WORDS = {
    INSULT: "idiot idiots moron morons stupid dumb loser losers trash garbage scum clown clowns worthless pathetic disgusting fool fools dumm dummkopf stupide imbécile estúpido",
    THREAT: "kill hurt destroy beat stab shoot punch burn töten tuer matar",
    TARGET: "you your yours u he she they him you're her them his their these those people everyone du dich ihr vous tu toi usted tú ellos",
    NEGATION: "not no never neither nor isn't aren't wasn't don't won't can't nicht kein keine nie pas jamais nunca",
    REPORT: "said says wrote claims claimed reported quoted called tweeted according sagte schrieb dit écrit dijo escribió",
}
TAGS = {w: tag for tag, words in WORDS.items() for w in words.split()}
#: Log-odds of given words that no labels speak for.
GIVEN = {INSULT: 5.0, THREAT: 1.0}
PAIRED = {INSULT: (AIMED_INSULT, NEGATED_INSULT, REPORTED_INSULT), THREAT: (AIMED_THREAT, NEGATED_THREAT, REPORTED_THREAT)}
MATCHES = {INSULT, AIMED_INSULT, NEGATED_INSULT, REPORTED_INSULT, THREAT, AIMED_THREAT, NEGATED_THREAT, REPORTED_THREAT}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\n|[.!?;:]+|[\"“”„«»]", re.UNICODE)
_MARKS = {"\n": LINE, **dict.fromkeys("\"“”„«»", QUOTE)}
_WORD = r"[\p{L}]+(?:['’][\p{L}]+)?"
#: Words whose symbol one worker remembers.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] = (next state, symbol written, weight)."""

    start: object
    arcs: dict

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads; weights multiply."""
        start = (self.start, other.start)
        arcs, todo = {}, [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for symbol in EVERY:
                mine, between, w = self.arcs[state[0]][symbol]
                theirs, out, v = other.arcs[state[1]][between]
                arcs[state][symbol] = ((mine, theirs), out, w * v)
                todo.append((mine, theirs))
        return Transducer(start, arcs)


def _machine(start, states, arc) -> Transducer:
    """arc(state, symbol) gives the arcs that differ from passing the symbol on in the same state."""
    return Transducer(start, {s: {a: arc(s, a) or (s, a, 1.0) for a in EVERY} for s in states})


def insult_transducer() -> Transducer:
    """Its arcs read words: each word of the vocabulary is one arc that writes INSULT at the word's log-odds (see Model.symbol);
    over symbols it passes everything on."""
    return _machine(0, [0], lambda s, a: None)


def threat_transducer() -> Transducer:
    """A target within reach behind a threat closes an aimed one. The state counts the reach left."""
    def arc(left, a):
        if a in (END, LINE):
            return 0, a, 1.0
        if a == THREAT:
            return REACH, a, 1.0
        return (0, AIMED_THREAT, AIMED * GIVEN[THREAT] * 2) if a == TARGET and left else (max(left - 1, 0), a, 1.0)

    return _machine(0, range(REACH + 1), arc)


def negation_transducer() -> Transducer:
    def arc(left, a):
        if a in (END, LINE):
            return 0, a, 1.0
        if a == NEGATION:
            return REACH, a, 1.0
        after = max(left - 1, 0)
        if left and a in PAIRED:
            return after, PAIRED[a][1], NEGATED
        return (after, NEGATED_THREAT, NEGATED) if left and a == AIMED_THREAT else (after, a, 1.0)

    return _machine(0, range(REACH + 1), arc)


def report_transducer() -> Transducer:
    """A verb reports to the end of its clause, a quotation to its closing mark or the end of its line."""
    def arc(state, a):
        if a == LINE or (a == END and state == "reported"):
            return "plain", a, 1.0
        if a == QUOTE:
            return ("quoted" if state != "quoted" else "plain"), a, 1.0
        if a == REPORT and state == "plain":
            return "reported", a, 1.0
        if state != "plain" and a in PAIRED:
            return state, PAIRED[a][2], REPORTED
        return (state, REPORTED_THREAT, REPORTED) if state != "plain" and a == AIMED_THREAT else None

    return _machine("plain", ("plain", "reported", "quoted"), arc)


def target_transducer() -> Transducer:
    def arc(left, a):
        if a in (END, LINE):
            return 0, a, 1.0
        if a == TARGET:
            return REACH, a, 1.0
        return (max(left - 1, 0), PAIRED[a][0], AIMED) if left and a in PAIRED else (max(left - 1, 0), a, 1.0)

    return _machine(0, range(REACH + 1), arc)


def grammar() -> Transducer:
    return insult_transducer().then(threat_transducer()).then(negation_transducer()).then(report_transducer()).then(target_transducer())


def _table(machine: Transducer) -> tuple[list[list[tuple[int, int, float]]], int]:
    """The composition with its states as numbers."""
    number = {s: i for i, s in enumerate(machine.arcs)}
    return [[(number[t], out, w) for t, out, w in (arcs[a] for a in EVERY)] for arcs in machine.arcs.values()], number[machine.start]


_ARCS, _START = _table(grammar())


@dataclass
class Model:
    """Log-odds of the learnt words and beginnings, coefficients of the two features, the intercept."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([0.25, 3.2]))
    intercept: float = -5.8
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def symbol(self, token: str) -> tuple[int, float]:
        """The symbol of a token, and for insults and threats the weight of its arc."""
        if token in _MARKS:
            return _MARKS[token], 0.0
        if not token[0].isalpha():
            return END, 0.0
        tag = TAGS.get(token, OTHER)
        weight = self.words.get(token, 0.0)
        if not weight and tag == OTHER and self.beginnings:
            weight = max(self.beginnings.get(token[:k], 0.0) for k in BEGINNINGS)
        if weight and tag in (OTHER, INSULT):
            return INSULT, weight
        return tag, GIVEN.get(tag, 0.0)

    def symbols(self, tokens: list[str]) -> list[tuple[int, float]]:
        known = self.known
        try:
            return [known[t] for t in tokens]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            known.update((t, self.symbol(t)) for t in set(tokens).difference(known))
            return [known[t] for t in tokens]


def matches(text: str | None, model: Model) -> tuple[list[tuple[int, str, float]], int]:
    """What the grammar writes for a text: (symbol, word, weight) of each match; and the number of tokens."""
    tokens = _TOKEN.findall((text or "").lower())
    read = model.symbols(tokens)
    if not any(w for _, w in read):
        return [], len(tokens)
    out, state, arcs = [], _START, _ARCS
    for token, (symbol, weight) in zip(tokens, read):
        state, written, factor = arcs[state][symbol]
        if written in MATCHES:
            out.append((written, token, factor * (weight or 1.0)))
    return out, len(tokens)


def features(text: str | None, model: Model) -> tuple[float, float]:
    """The weights of the matches, each word once, summed; and over the root of the text's length."""
    found, size = matches(text, model)
    if not found:
        return 0.0, 0.0
    best: dict[str, float] = {}
    for _, word, weight in found:
        best[word] = max(best.get(word, 0.0), weight)
    total = sum(best.values())
    return math.log1p(total), math.log1p(10 * total / math.sqrt(size))


def scores(x: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ model.weights + model.intercept)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5: fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _begins(words: str, k: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def _entries(texts: DataFrame) -> DataFrame:
    """w: each word, and each beginning with a star behind it, of each text, once a text."""
    rows = texts.select(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("words"))
    return rows.select(F.explode(F.concat("words", F.array_distinct(F.flatten(F.array(*(_begins("words", k) for k in BEGINNINGS)))))).alias("w"))


def odds(a, b, toxic: int, clean: int, errors: float = ERRORS):
    """Log-odds of an entry in a toxic and b clean texts, and the same less its standard errors."""
    log, root = (F.log, F.sqrt) if isinstance(a, Column) else (math.log, math.sqrt)
    value = log((a + 0.5) / (toxic + 1.0)) - log((b + 0.5) / (clean + 1.0))
    return value, value - errors * root(1 / (a + 0.5) + 1 / (b + 0.5))


def vocabulary(labelled: DataFrame, least_odds: float = LEAST_ODDS, errors: float = ERRORS, least_share: float = LEAST_SHARE) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with their log-odds, from (toxic, text) of which equal ones count once."""
    distinct = settle(labelled.groupBy("text").agg(F.max("toxic").alias("toxic")), "texts")
    n = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}, {}
    # no entry of fewer toxic texts can pass, even if no clean one holds it
    least = next((a for a in range(1, toxic + 1) if odds(a, 0, toxic, clean, errors)[1] > least_odds), toxic + 1)
    in_toxic = settle(_entries(distinct.where("toxic = 1")).groupBy("w").agg(F.count("*").alias("a")).where(F.col("a") >= max(least, least_share * toxic)), "entries")
    few = in_toxic.count() <= BROADCAST_LABELS
    wanted = F.broadcast(in_toxic.select("w")) if few else in_toxic.select("w").hint("merge")
    in_clean = _entries(distinct.where("toxic = 0")).join(wanted, "w", "left_semi").groupBy("w").agg(F.count("*").alias("b"))
    value, lower = odds(F.col("a"), F.coalesce(F.col("b"), F.lit(0)), toxic, clean, errors)
    rows = in_toxic.join(in_clean, "w", "left").select("w", value.alias("odds"), lower.alias("lower")).where(F.col("lower") > least_odds).collect()  # bounded by least_share
    return {r["w"]: r["odds"] for r in rows if r["w"][-1] != "*"}, {r["w"][:-1]: r["odds"] for r in rows if r["w"][-1] == "*"}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options) -> Model:
    """Learn from the labelled rows outside fold 0. Only texts and their labels are used."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known.hint("merge")
    labelled = settle(docs.select("doc_id", "text").where(fold(F.col("doc_id")) != 0).join(known, "doc_id"), "labelled")
    totals = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = Model()
    if not totals[0] or not totals[1]:
        return model
    model.words, model.beginnings = vocabulary(labelled.select("toxic", "text"), **options)
    step = max(1, -(-sum(totals.values()) // (fit_rows // 2)))
    part = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py(), model) for t in batch.column("text")]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["toxic", "total", "dense"])

    rows = part.select("toxic", "text").mapInArrow(run, "toxic int, total double, dense double").groupBy("toxic", "total", "dense").agg(F.count("*").alias("n")).orderBy("toxic", "total", "dense").limit(fit_rows).collect()
    x, y, n = np.array([[r["total"], r["dense"]] for r in rows]).reshape(-1, 2), np.array([r["toxic"] for r in rows], float), np.array([r["n"] for r in rows], float)
    if 0 < y.sum() < len(y):
        model.weights, model.intercept = _logistic(x, y, n)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on the weights."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (n * (y - p)) - keep * w
        curve = (z * (n * p * (1 - p))[:, None]).T @ z + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _scored(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    return scores(np.array([features(t.as_py(), model) for t in batch.column("text")]).reshape(-1, 2), model)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scored(batch, model))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents, in their own columns, that score under the limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch, model) < limit))

    return docs.mapInArrow(run, docs.schema)
