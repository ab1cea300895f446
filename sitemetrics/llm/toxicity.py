"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, other). Small transducers for insults and threats, targets, negation and
reported speech read them side by side; their composition is one machine, built below, that is run over each clause with an insult or a
threat in it. What it emits is a pattern (kind, negated, reported) with the weight of the matched word; a target in the clause makes the
clause directed. A text's score is a logistic function of its clauses' pattern weights. Insult stems, their weights and the patterns'
weights are learned from labelled rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.labelled import labelled_sample
from sitemetrics.llm.texts import _BYTE_VALUE, _POWERS, ALNUM, Words, as_signed, mix, slices, words
from sitemetrics.operators.reuse import written

FIT_ROWS = 20000
LEXICON_ROWS = 4096
LEAST_LOG_ODDS, LEAST_EVIDENCE = 2.0, 16.0
#: Occurrences of a stem that count in one document.
MOST_IN_DOCUMENT = 5
PREFIXES = (3, 4, 5, 6, 7, 8)
NEGATION_REACH = 3

# Closed-class words of the grammar in English, German, French and Spanish.
TARGETS = "you your yours yourself he him his she her they them their du dich dir dein ihr euch er ihn sie tu toi ton vous votre il lui elle ils eux tú usted ustedes él ella ellos vosotros".split()
NEGATIONS = "not no never neither nor cannot dont isnt arent wasnt nicht kein keine keinen nie niemals pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says say saying told tells wrote writes claimed claims called calls quoted quotes reported reports alleged sagte sagt schrieb behauptet dit disait écrit affirme dijo dice escribió afirma".split()
THREATS = "kill hurt destroy murder beat stab shoot attack töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)


@dataclass(frozen=True)
class Transducer:
    """`arcs[state, symbol] = (next state, output)`; state 0 is the start."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, int]]


def _matcher() -> Transducer:
    """Emits 1 for an insult and 2 for a threat."""
    return Transducer(1, {(0, s): (0, {INSULT: 1, THREAT: 2}.get(s, 0)) for s in SYMBOLS})


def _negation() -> Transducer:
    """Emits 1 while a negation is at most NEGATION_REACH words back."""
    arcs = {}
    for state, s in itertools.product(range(NEGATION_REACH + 1), SYMBOLS):
        arcs[state, s] = (NEGATION_REACH if s == NEGATION else max(0, state - 1), int(state > 0))
    return Transducer(NEGATION_REACH + 1, arcs)


def _latched(symbol: int) -> Transducer:
    """Emits 1 from the first such symbol on."""
    return Transducer(2, {(q, s): (int(q or s == symbol), int(q or s == symbol)) for q in (0, 1) for s in SYMBOLS})


def compose(machines: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """Product of machines that read the same symbols: next state and outputs (one column a machine) by state and symbol."""
    spaces = list(itertools.product(*[range(m.states) for m in machines]))
    number = {q: k for k, q in enumerate(spaces)}
    after, output = np.zeros((len(spaces), len(SYMBOLS)), np.int64), np.zeros((len(spaces), len(SYMBOLS), len(machines)), np.int64)
    for k, q in enumerate(spaces):
        for s in SYMBOLS:
            steps = [m.arcs[a, s] for m, a in zip(machines, q, strict=True)]
            after[k, s] = number[tuple(x for x, _ in steps)]
            output[k, s] = [y for _, y in steps]
    return after, output


NEXT, EMIT = compose([_matcher(), _negation(), _latched(REPORT), _latched(TARGET)])
PATTERNS = 16  # kind x negated x reported x directed
FEATURES = PATTERNS + 3


@dataclass
class ToxicityModel:
    """Sorted hashes of insult stems by length in bytes (0: whole words) with weights, and the pattern weights with the bias last."""

    lexicon: dict[int, tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    bias: float


def _prefix(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first `size` bytes of the words that are longer, and these words' numbers."""
    at = np.flatnonzero(w.end - w.start > size)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += _BYTE_VALUE[w.low[w.start[at] + k]] * _POWERS[0][k]
    return mix(total + np.uint64(size)), at


def _stems(w: Words):
    """(length, hashes, numbers of the words) for whole words and each prefix length."""
    yield 0, w.hash, np.arange(len(w.hash))
    for size in PREFIXES:
        if len(w.hash):
            yield size, *_prefix(w, size)


def _hash_of(listed: list[str]) -> np.ndarray:
    return np.sort(words(pa.array(listed), ALNUM).hash)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


_CLOSED = ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS))
_BREAKS = np.zeros(256, np.int64)
_BREAKS[[ord(c) for c in ".!?;:\n|"]] = 1


def _symbols(w: Words, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and weight of each word; an insult stem wins over a closed-class word."""
    symbol, weight = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash))
    for kind, listed in _CLOSED:
        hit = _among(w.hash, _hash_of(listed))
        symbol[hit], weight[hit] = kind, 1.0
    stem = np.zeros(len(w.hash))
    for size, hashes, at in _stems(w):
        if size in model.lexicon:
            known, value = model.lexicon[size]
            hit = _among(hashes, known)
            np.maximum.at(stem, at[hit], value[np.searchsorted(known, hashes[hit])])
    hit = stem > 0
    symbol[hit], weight[hit] = INSULT, stem[hit]
    return symbol, weight


def _clauses(w: Words) -> np.ndarray:
    """Number of each word's clause; clauses end at . ! ? ; : | and line ends, and at the end of the text."""
    total = np.concatenate([[0], np.cumsum(_BREAKS[w.low])])
    new = np.ones(len(w.hash), bool)
    new[1:] = (total[w.start[1:]] > total[w.end[:-1]]) | (w.text[1:] != w.text[:-1])
    return np.cumsum(new) - 1


def _features(column: pa.Array, model: ToxicityModel) -> np.ndarray:
    """Per text: log of the pattern weights of its clauses, share of matched clauses, log of the number of words, weight per word."""
    w = words(column, ALNUM)
    out = np.zeros((len(column), FEATURES))
    if len(w.hash):
        symbol, weight = _symbols(w, model)
        clause = _clauses(w)
        first = np.searchsorted(clause, np.arange(clause[-1] + 2))
        found = np.unique(clause[(symbol == INSULT) | (symbol == THREAT)])
        for c in found.tolist():
            a, b = int(first[c]), int(first[c + 1])
            state, hits = 0, []
            for s, x in zip(symbol[a:b].tolist(), weight[a:b].tolist(), strict=True):
                kind, negated, reported, directed = EMIT[state, s]
                state = NEXT[state, s]
                if kind:
                    hits.append((int(kind) - 1, int(negated), int(reported), x))
            for kind, negated, reported, x in hits:  # the target machine's last output holds for the whole clause
                out[w.text[a], kind * 8 + negated * 4 + reported * 2 + int(directed)] += x
            out[w.text[a], PATTERNS] += 1
        n = np.bincount(w.text[first[:-1]], minlength=len(column))
        out[:, PATTERNS + 2] = np.log1p(1000 * out[:, :PATTERNS].sum(axis=1) / np.maximum(np.diff(w.first), 1))
        out[:, :PATTERNS] = np.log1p(out[:, :PATTERNS])
        out[:, PATTERNS] = np.where(n > 0, out[:, PATTERNS] / np.maximum(n, 1), 0)
    out[:, PATTERNS + 1] = np.log1p(np.diff(w.first)) / 10
    return out


def _counts(batches):
    """Documents with each stem and its occurrences in them, toxic and clean."""
    for batch in slices(batches):
        w = words(batch.column("text"), ALNUM)
        toxic = np.array(batch.column("label").to_pylist(), bool)
        for size, hashes, at in _stems(w):
            order = np.lexsort((w.text[at], hashes))
            h, t = hashes[order], w.text[at][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            at_new = np.flatnonzero(new)
            times = np.minimum(np.diff(np.append(at_new, len(h))), MOST_IN_DOCUMENT)
            value, which = np.unique(h[new], return_inverse=True)
            bad = toxic[t[new]]
            counts = [np.bincount(which, x, len(value)).astype(np.int64) for x in (bad, ~bad, times * bad, times * ~bad)]
            yield pa.record_batch([pa.array(np.full(len(value), size)), as_signed(value), *map(pa.array, counts)], names=["size", "stem", "bad", "good", "bad_n", "good_n"])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps on the L2-penalised log likelihood; x is at most FIT_ROWS x FEATURES."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, 0.3), 1e-3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * b)
    return b[:-1], float(b[-1])


def training_rows(id_name: str):
    """Condition for ids that may be learned from: crc32 of the id as text, modulo 3, isn't 1."""
    return F.crc32(F.coalesce(F.col(id_name).cast("string"), F.lit("")).cast("binary")) % 3 != 1


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, where=None) -> ToxicityModel:
    """Learns from at most `fit_rows` labelled documents, of ids that `where` allows: stems from one half, pattern weights from the other.

    A stem counts if its rate speaks for the label by LEAST_LOG_ODDS and its documents do with a likelihood ratio of LEAST_EVIDENCE; at most
    LEXICON_ROWS stems of the strongest evidence are kept. Without labels of both kinds the lexicon is empty and all weights are 0.
    """
    sample = labelled_sample(docs, labels, label, id_col, text_col, fit_rows, where).select("id", "text", (F.col("label") > 0).cast("long").alias("label"))
    sample = written(sample.withColumn("half", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2))), "sample")
    n = {(r["half"], r["label"]): r["count"] for r in sample.groupBy("half", "label").count().collect()}
    bad, good = n.get((0, 1), 0), n.get((0, 0), 0)
    if not (bad and good and n.get((1, 1)) and n.get((1, 0))):
        return ToxicityModel({}, np.zeros(FEATURES), 0.0)
    share = bad / (bad + good)
    counted = sample.where("half = 0").select("text", "label").mapInArrow(_counts, "size long, stem long, bad long, good long, bad_n long, good_n long").groupBy("size", "stem").agg(*[F.sum(c).alias(c) for c in ("bad", "good", "bad_n", "good_n")])
    odds = F.log((F.col("bad_n") + 0.5) / (bad + 1.0)) - F.log((F.col("good_n") + 1.0) / (good + 1.0))
    rate = F.col("bad") / (F.col("bad") + F.col("good"))
    evidence = 2 * (F.col("bad") * F.log(rate / share) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - rate) / (1 - share))).otherwise(0.0))
    strong = counted.where("bad > 0").withColumns({"weight": odds, "evidence": evidence}).where(f"weight >= {LEAST_LOG_ODDS} AND evidence >= {LEAST_EVIDENCE}")
    lexicon: dict[int, list[tuple[int, float]]] = {}
    for r in strong.where(F.lit(share) < rate).orderBy(F.desc("evidence"), "size", "stem").limit(LEXICON_ROWS).collect():
        lexicon.setdefault(r["size"], []).append((r["stem"], r["weight"]))
    tables = {}
    for size, rows in lexicon.items():
        stems, values = np.array([s for s, _ in rows], np.int64).view(np.uint64), np.array([v for _, v in rows])
        order = np.argsort(stems)
        tables[size] = (stems[order], values[order])
    model = ToxicityModel(tables, np.zeros(FEATURES), 0.0)

    def rows(batches):
        for batch in slices(batches):
            x = _features(batch.column("text"), model)
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), x.ravel())], names=["id", "label", "x"])

    half = sample.where("half = 1").select("id", "text", "label").mapInArrow(rows, "id long, label long, x array<double>").orderBy("id", "label").toArrow()
    x = np.array(half.column("x").to_pylist()).reshape(-1, FEATURES)
    weights, bias = _logistic(x, half.column("label").to_numpy().astype(float))
    return ToxicityModel(tables, weights, bias)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text: a probability of the label, and 1 if it is at least `least`.

    One row for each input row, repeated rows included; null ids pass through. A null or empty text has no clauses and is scored by the
    bias alone. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            score = 1 / (1 + np.exp(-np.clip(_features(batch.column("text"), model) @ model.weights + model.bias, -30, 30)))
            yield pa.record_batch([batch.column("id"), pa.array(score), pa.array((score >= least).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, score double, predicted int").toDF("doc_id", "score", "predicted")

