"""Secret scan: patterns with exact spans, and character Markov models of random strings and ordinary identifiers. Column functions only.

Both models are first-order over ALPHABET, case folded, and trained from labelled strings of the whole corpus: what the patterns found is random, all
other runs of the alphabet are ordinary. A run scores the sum of its transitions' log-likelihood ratios; it is added if that exceeds the
log odds of ordinary against random strings by MARGIN.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions.core import let

# The base patterns, in their listed order, with the least length of what must be long enough.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Cheap tests that a text has any match at all.
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}"}

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
LEAST_TRAINING, LEAST_RUN = 6, 16
MARGIN = 5.0
SMOOTHING = 0.5
#: Parts of a text whose places are counted together; even, as every second part is a match.
BLOCK = 256
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"
_SPANS = "array<struct<start:int,stop:int,value:string>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, hint: str, keep: str) -> Column:
    """(start, stop, value) of the leftmost non-overlapping matches `p` that satisfy `keep`, in code points.

    Matches are put between two marks and the text is split there, so lengths of the parts give the places. The marks' own characters
    are replaced by a third one before, which keeps lengths and is in no pattern. Places are counted in blocks of BLOCK parts, whose
    own offsets are counted then, so that no list that grows with the text is copied for each match.
    """
    plain = f"translate({text}, '{_OPEN}{_CLOSE}', '{_OTHER}{_OTHER}')"
    parts = f"split(regexp_replace({plain}, {_quoted(pattern)}, '{_OPEN}$0{_CLOSE}'), '[{_OPEN}{_CLOSE}]')"
    grown = f"CASE WHEN a.i % 2 = 1 AND ({keep}) THEN array_append(a.found, struct(a.pos AS start, a.pos + length(p) AS stop, p AS value)) ELSE a.found END"
    step = f"struct(a.pos + length(p) AS pos, a.i + 1 AS i, {grown} AS found)"
    blocks = f"transform(sequence(0, (size(l) - 1) DIV {BLOCK}), b -> aggregate(slice(l, CAST(b * {BLOCK} + 1 AS INT), {BLOCK}), struct(0 AS pos, 0 AS i, CAST(array() AS {_SPANS}) AS found), (a, p) -> {step}))"
    moved = "transform(k.found, s -> struct(a.pos + s.start AS start, a.pos + s.stop AS stop, s.value AS value))"
    folded = f"flatten(aggregate({blocks}, struct(0 AS pos, CAST(array() AS array<{_SPANS}>) AS all), (a, k) -> struct(a.pos + k.pos AS pos, array_append(a.all, {moved}) AS all), a -> a.all))"
    once = f"transform(array({parts}), l -> {folded})[0]"
    return F.expr(f"CASE WHEN {text} RLIKE {_quoted(hint)} THEN {once} ELSE CAST(array() AS {_SPANS}) END")


def _touches(kind: str, span: Column) -> Column:
    """Whether a span of `kind` overlaps `span`.

    Spans of one kind are in order and apart, so of those that start before the end of `span` the last one reaches furthest. Their
    number is found by halving steps.
    """
    spans = F.col(kind)
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    before = F.aggregate(steps, F.lit(0), lambda j, w: F.when((w <= F.size(spans) - j) & (F.get(spans, j + w - 1)["start"] < span["stop"]), j + w).otherwise(j))
    return (F.size(spans) > 0) & let(before, lambda j: (j > 0) & (F.get(spans, j - 1)["stop"] > span["start"]))


def _base(kind: str) -> Column:
    pattern, group, least = PATTERNS[kind]
    value = f"regexp_extract(p, {_quoted(pattern)}, {group})" if group else "p"
    return _spans("text", pattern, HINTS[kind], f"length({value}) >= {least}")


def _pairs(strings: DataFrame) -> DataFrame:
    """(a, b, n): transitions in `value`, each counted `n` times."""
    at = F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("i")
    steps = strings.where("length(value) >= 2").select("value", "n", at)
    return steps.select(F.expr("lower(substring(value, i, 1))").alias("a"), F.expr("lower(substring(value, i + 1, 1))").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))


def train_models(scanned: DataFrame) -> tuple[list[float], float]:
    """Log-likelihood ratios of all transitions (row by row of ALPHABET) and the least score, from rows of (text, assign, access, hex).

    Counts cover all rows. The two tables of at most one count for each pair of characters of the runs come to the driver, whatever the size of the corpus.
    """
    found = F.concat(F.transform("assign", lambda s: F.regexp_extract(s["value"], PATTERNS["assign"][0], 2)), F.transform("access", lambda s: s["value"]), F.transform("hex", lambda s: s["value"]))
    random = scanned.where("size(assign) + size(access) + size(hex) > 0").select(F.explode(found).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    rest = "text"
    for pattern, _, _ in PATTERNS.values():
        rest = f"regexp_replace({rest}, {_quoted(pattern)}, ' ')"
    hinted = " OR ".join(f"size({k}) > 0" for k in PATTERNS)
    runs = F.expr(f"regexp_extract_all(CASE WHEN {hinted} THEN {rest} ELSE text END, {_quoted(RUN + '{' + str(LEAST_TRAINING) + ',}')}, 0)")
    ordinary = scanned.select(F.explode(runs).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    place = {c: k for k, c in enumerate(ALPHABET)}
    size = len(ALPHABET)
    tables, totals = [], []
    for strings in (random, ordinary):
        counts = [[SMOOTHING] * size for _ in range(size)]
        total = 0
        for r in _pairs(strings).collect():
            if r["a"] in place and r["b"] in place:
                counts[place[r["a"]]][place[r["b"]]] += r["n"]
                total += r["n"]
        tables.append([[n / sum(row) for n in row] for row in counts])
        totals.append(total)
    ratios = [math.log(p / q) for ps, qs in zip(*tables, strict=True) for p, q in zip(ps, qs, strict=True)]
    return ratios, MARGIN + max(0.0, math.log((totals[1] + 1) / (totals[0] + 1)))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of every whole text; spans are kind:start:end in code points.

    Spans are ordered by start, then kind (assign, access, hex, markov); end is exclusive and a span covers the whole match. markov
    spans are runs of at least LEAST_RUN characters with a letter that score as random and touch no base span; base spans always stay.
    One row for each input row, repeated ones included; a null text is empty and has no spans; null ids pass through; other columns are
    ignored. Nothing but the models' counts is shuffled. A corpus without any base match adds no markov span.
    """
    scanned = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scanned = scanned.withColumns({kind: _base(kind) for kind in PATTERNS})
    ratios, least = train_models(scanned)
    scanned = scanned.withColumn("base", F.expr("array_sort(concat(" + ", ".join(f"transform({kind}, s -> struct(s.start AS start, {k} AS kind, s.stop AS stop))" for k, kind in enumerate(PATTERNS)) + "))"))
    model = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    size, letters = len(ALPHABET), F.lit(ALPHABET)

    def score(span: Column) -> Column:
        code = F.transform(F.split(F.lower(span["value"]), ""), lambda c: F.instr(letters, c))
        steps = F.zip_with(F.slice(code, 1, F.length(span["value"]) - 1), F.slice(code, 2, F.length(span["value"]) - 1), lambda x, y: F.element_at(model, (x - 1) * size + y))
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)

    runs = _spans("text", RUN + "{" + str(LEAST_RUN) + ",}", RUN + "{" + str(LEAST_RUN) + "}", "p RLIKE '[A-Za-z]'")
    apart = F.filter(runs, lambda s: ~(_touches("assign", s) | _touches("access", s) | _touches("hex", s)))
    random = F.filter(apart, lambda s: score(s) > F.lit(least))
    added = F.transform(random, lambda s: F.struct(s["start"].alias("start"), F.lit(len(PATTERNS)).alias("kind"), s["stop"].alias("stop")))
    scanned = scanned.withColumn("added", added)
    names = F.array(*[F.lit(k) for k in (*PATTERNS, "markov")])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    return scanned.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_markov"),
    )
