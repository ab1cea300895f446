"""Every operator against a brute-force version, on odd rows and on empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitemetrics.llm import fingerprint, mixing, near_dedup, pitman_yor, token_output
from sitemetrics.llm.bitpack import Reader, crc32
from sitemetrics.llm.components import components
from sitemetrics.llm.decontaminate import contamination
from sitemetrics.llm.fingerprint import compare_with_next, parse
from sitemetrics.llm.mixing import replicate
from sitemetrics.llm.near_dedup import near_duplicates
from sitemetrics.llm.ordinal_quality import accepted_documents, fit_ordinal, quality_scores
from sitemetrics.llm.pitman_yor import language_model_scores
from sitemetrics.llm.revisits import HEADERS, canonical_url, resolve_revisits
from sitemetrics.llm.secrets import secret_spans
from sitemetrics.llm.toxicity import EMIT, INSULT, NEGATION, NEXT, OTHER, REPORT, TARGET, fit_toxicity, toxicity_scores
from tests.llm.conftest import ODD, documents, prose

LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text, rule=r"[^\x20\x09-\x0D]+"):
    return re.findall(rule, (text or "").translate(LOWER))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# -- near duplicates ------------------------------------------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = []
    for i, text, *_ in rows:
        w = words_of(text)
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i) if i is not None and s else i, i is None or not s or root(i) == i) for i, s in sets]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = list(ODD)
    pick = random.Random(4)
    for family in range(6):  # chains of small edits: ends are linked only through the middle
        now = prose(100 + family, 80).split()
        for k in range(7):
            rows.append((1000 + family * 50 + k, " ".join(now), "f"))
            for _ in range(2):
                now[pick.randrange(len(now))] = f"edit{pick.random()}"
    got = near_duplicates(documents(spark, rows), words_per_shingle=size, percent=80).collect()
    assert ordered(map(tuple, got)) == ordered(brute_components(rows, size, 80))


def test_near_duplicates_verify_few_pairs_below_the_threshold(spark, monkeypatch):
    """In a large group whose members are mostly a little too far from each other, work follows its size and not its square."""
    rng = random.Random(5)
    often, base = [f"w{k}" for k in range(12)], [f"b{k}" for k in range(140)]
    rows = [(i, " ".join(rng.choice(often) if rng.random() < 0.09 else w for w in base), "g") for i in range(400)]
    made, write = {}, near_dedup.written

    def counted(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    got = near_duplicates(documents(spark, rows), words_per_shingle=2).collect()
    assert ordered(map(tuple, got)) == ordered(brute_components(rows, 2, 80))
    assert len({r.component_id for r in got}) > 50 and made["open"] > 0 and made["rest"] < 4 * len(rows)


def test_near_duplicates_of_small_buckets_are_settled_by_pairs(spark, monkeypatch):
    """Few texts that are too far from each other meet in many buckets; all their pairs are known then, so no shingles are read again."""
    rng, rows = random.Random(9), []
    for group in range(60):
        base = [f"g{group}b{k}" for k in range(60)]
        rows += [(10 * group + k, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.08 else w for w in base), "g") for k in range(3 + group % 4)]
    made, write = {}, near_dedup.written

    def counted(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    got = near_duplicates(documents(spark, rows), words_per_shingle=2).collect()
    assert ordered(map(tuple, got)) == ordered(brute_components(rows, 2, 80))
    assert made["buckets"] > 500 and made["pairs"] > 50 and "elements" not in made


def last_execution(spark):
    spark.range(1).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()


def join_rows(spark, executions, keys):
    """Rows that the inner joins on `keys` have made in these executions."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), 0
    for execution in executions:
        metrics, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            if re.search(rf"Join \[{keys}#\d+L?\], \[{keys}#\d+L?\], Inner", node.desc()):
                each = node.metrics().iterator()
                while each.hasNext():
                    metric = each.next()
                    if metric.name() == "number of output rows" and not metrics.get(metric.accumulatorId()).isEmpty():
                        rows += int(metrics.apply(metric.accumulatorId()).replace(",", ""))
    return rows


def test_near_duplicates_join_no_pairs_of_sizes_that_rule_out_a_link(spark):
    """Texts of a bucket that are too long or too short for each other are told apart by their sizes alone, before signatures are joined."""
    base, rows = prose(11, 400).split(), []
    for k in range(200):
        words = base[: (60, 80, 107, 143, 190)[k % 5]]
        words[k % 50] = f"own{k}"
        rows.append((k, " ".join(words), "n"))
    before = last_execution(spark)
    got = near_duplicates(documents(spark, rows), words_per_shingle=2).collect()
    made = join_rows(spark, range(before + 1, last_execution(spark)), "u")
    assert ordered(map(tuple, got)) == ordered(brute_components(rows, 2, 80))
    assert 0 < made < 30 * len(rows)


def test_near_duplicates_of_a_group_around_the_threshold_verify_no_pairs_inside_a_component(spark, monkeypatch):
    """Most pairs that only a shared shingle finds are inside one component as soon as each class is linked with its nearest."""
    rng, base = random.Random(6), [f"b{k}" for k in range(140)]
    rows = [(k, " ".join(rng.choice("often seen words".split()) if rng.random() < 0.036 else w for w in base), "g") for k in range(300)]
    made, write = {}, near_dedup.written

    def counted(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    monkeypatch.setattr(near_dedup, "written", counted)
    got = near_duplicates(documents(spark, rows), words_per_shingle=2).collect()
    assert ordered(map(tuple, got)) == ordered(brute_components(rows, 2, 80))
    assert made["rest"] > 2 * len(rows) and 2 * (made["nearest"] + made["last"]) < made["rest"]


def test_near_duplicates_of_one_large_group(spark):
    base = prose(7, 120).split()
    rows = [(k, " ".join(base[: k % 7] + ["swap"] + base[k % 7 + 1 :]), "h") for k in range(300)] + [(1000 + k, prose(500 + k, 50), "h") for k in range(20)]
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, rows), words_per_shingle=2).collect()}
    assert {got[k] for k in range(300)} == {0} and all(got[1000 + k] == 1000 + k for k in range(20))


def test_tables_find_pairs_at_the_threshold():
    """At similarity 0.8 a pair is missed with a probability of about 1e-4."""
    p, s = 1 - (1 - 0.8**2) ** near_dedup.PAIRS, 1 - (1 - 0.8) ** near_dedup.SINGLES
    assert p * s > 0.9998
    low = sum(math.comb(near_dedup.HASHES, k) * 0.8**k * 0.2 ** (near_dedup.HASHES - k) for k in range(near_dedup.LEAST_AGREEMENT))
    assert low < 1e-4


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(90, 90), (91, 92), (91, 92)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 91: 91, 92: 91}
    assert components(links.limit(0)).count() == 0


# -- benchmark decontamination --------------------------------------------------------------------------------------------------------


def brute_leaks(rows, items, window=10):
    rule = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = []
    for i, text in sorted({(i, t or "") for i, t, *_ in rows}, key=str):
        w, hit, named = words_of(text, rule), set(), set()
        for item, passage in items:
            p = words_of(passage, rule)
            size = min(len(p), window)
            for a in range(len(p) - size + 1 if p else 0):
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == p[a : a + size]:
                        hit |= set(range(b, b + size))
                        named |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark):
    items = [(1, prose(31, 25)), (2, prose(32, 10).upper()), (3, "Short-item!"), (10, prose(31, 25)), (4, None), (5, "..."), (None, prose(33, 12)), (6, "solo"), (7, "again " * 14)]
    rows = [*ODD, (60, prose(50, 20) + " " + prose(31, 25) + " " + prose(51, 5), "a"), (61, prose(32, 10), "a"), (62, "a short ITEM here; solo", "a"), (63, prose(31, 9), "a"), (64, prose(33, 12), "a"), (65, "again " * 30, "a"), (66, prose(31, 10), "a")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(0)).withColumn("item", F.lit(""))
    got = contamination(documents(spark, rows), bench).drop("text_hash").collect()
    assert ordered(map(tuple, got)) == ordered(brute_leaks(rows, items))
    assert contamination(documents(spark, rows), bench.limit(0)).where("contaminated").count() == 0


# -- token files ----------------------------------------------------------------------------------------------------------------------


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*ODD, (70, "don't I'll it's 'quoted' a.b,c <|endoftext|>x é ̈y ÀÉ ΣΑΣ 1234  nbsp em", "a")]
    rows += [(71, "end <|ENDOFTEXT|> x <|endoftext|>", "a"), (72, "X<|EndOfText|>Y İSTANBUL ẞ Ǆ <|STARTOFTEXT|><|startoftext|>", "b")]
    manifest = token_output.write_tokens(documents(spark, rows), spark.conf.get("spark.checkpoint.dir") + "/files", path, 2)
    got = token_output.token_index(manifest).collect()
    want, at = [], 0
    encoded = sorted(((i is not None, i or 0, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t, _ in rows))
    for known, i, ids in encoded:
        want.append((i if known else None, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert ordered(map(tuple, got)) == ordered(want)
    first = manifest.orderBy("shard").first()
    reader = Reader(first.path)
    whole = reader.ids(0, reader.n_ids)
    for k in range(len(reader.keys)):
        assert crc32(reader.document(k)) == crc32(whole[reader.starts[k] : reader.starts[k + 1]])
    assert reader.bits == 16 and reader.ids(3, 3).size == 0


def test_driver_loads_no_tokenizer(spark, tmp_path, monkeypatch):
    """What it takes stays in the driver's memory, again for every run of a session."""
    path = public_tokenizers.path("word_bpe_49k.json")

    class Refused:
        @staticmethod
        def from_file(_):
            raise AssertionError("loaded by the driver")

    monkeypatch.setattr("tokenizers.Tokenizer", Refused)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert token_output.write_tokens(docs, str(tmp_path), path, 2).agg(F.sum("n_docs")).first()[0] == 2


def test_pieces_equal_whole_texts():
    """Random code points and case, words cached by earlier batches, and words that share one hash."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, pick = Tokenizer.from_file(path), random.Random(8)
    encoder = token_output.WordEncoder(path)
    letters = "aAbBzZ09.,'<|>éÉßẞİıΣς\u0301\u00a0\u2028\u200d中あ\U0001f600 \t\n\r"
    for turn in range(3):
        texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(60))) for _ in range(300)] + ["Same same SAME", None]
        if turn == 2:
            real, token_output.words = token_output.words, lambda *a: (lambda w: (w.hash.__imod__(np.uint64(5)), w)[1])(real(*a))
            encoder._clear()
        try:
            ids, offsets = encoder.encode(pa.array(texts), 2)
        finally:
            if turn == 2:
                token_output.words = real
        for k, t in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], t


# -- mixing ---------------------------------------------------------------------------------------------------------------------------


def test_replication_inverts_the_distribution(spark):
    rows = [(k, "t", "big" if k % 3 else "small") for k in range(900)] + [(5000, "t", None)]
    weights = {"big": 1.0, "small": 3.0}
    got = Counter(r.doc_id for r in replicate(documents(spark, rows), weights, rows=1800).collect())
    n = Counter(s for _, _, s in rows)
    for i, _, s in rows:
        rate = weights.get(s, 0.0) / 4 * 1800 / n[s]
        u, term, total, k = int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-rate), math.exp(-rate), 0
        while total <= u and rate:
            k += 1
            term *= rate / k
            total += term
        assert got.get(i, 0) == (k if rate else 0), i
    assert abs(sum(got.values()) - 1800) < 150 and got.get(5000) is None


def test_replication_of_a_source_of_one_row(spark):
    rows = [(k, "t", "a") for k in range(20000)] + [(50000, "t", None)]
    got = Counter(r.doc_id for r in replicate(documents(spark, rows).select("doc_id", "source")).collect())
    for i in (50000, *range(20)):
        rate = 20001 / 2 / (1 if i == 50000 else 20000)
        u, total, k = int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) / 2**52, 0.0, 0
        while (total := total + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))) <= u:
            k += 1
        assert got.get(i, 0) == k, i
    assert abs(got[50000] - 10000) < 500


def test_replication_of_odd_rows(spark):
    docs = documents(spark)
    mixed = replicate(docs, rows=60)
    assert mixed.columns == [*docs.columns, "mix_rate", "mix_copy", "mix_key"]
    copies = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert copies[20, ODD[6][1]] % 2 == 0  # the repeated row has one count
    keys = [r.mix_key for r in mixed.collect()]
    assert keys == sorted(keys)
    assert replicate(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        replicate(docs, {"a": -1.0})


def test_replication_keeps_columns_called_like_its_own(spark):
    names = ["mix_u", "MIX_N", "mix_source", "mix_terms", "mix_block", "mix_block_"]
    docs = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(40)], "doc_id long, source string")
    named = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    got = replicate(named)
    assert got.columns == [*named.columns, "mix_rate", "mix_copy", "mix_key"]
    rows = got.collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert sorted((r.doc_id, r.mix_copy) for r in rows) == sorted((r.doc_id, r.mix_copy) for r in replicate(docs).collect())


def test_replication_of_very_high_rates(spark):
    """One row of a weighty source: its copies are made in blocks over all tasks, and counts beyond 32 bits are counted."""
    docs = spark.createDataFrame([(1, "a"), *[(k, "b") for k in range(2, 12)]], "doc_id long, source string")
    spread = replicate(docs, {"a": 1.0, "b": 1e-4}, rows=300000)
    copies = [r.mix_copy for r in spread.where("doc_id = 1").select("mix_copy").collect()]
    assert sorted(copies) == list(range(1, len(copies) + 1)) and abs(len(copies) - 299970) < 3000
    rate, u = 3e9, 0.5
    count = spark.range(1).select(F.expr(mixing._far_count(f"{rate}D", f"{u}D"))).first()[0]
    assert abs(count - rate) < 3  # the median is within one of the mean


# -- quality --------------------------------------------------------------------------------------------------------------------------


def test_ordinal_grades_are_learned(spark):
    pick = random.Random(9)
    bank = [[f"{c}{k}" for k in range(30)] for c in "wxyz"]
    rows, marks = [], []
    for i in range(800):
        grade = i % 4
        rows.append((i, " ".join(pick.choice(bank[grade] if pick.random() < 0.5 else bank[pick.randrange(4)]) for _ in range(60)), "a"))
        marks.append((i, grade + 1))
    ratings = spark.createDataFrame(marks, "doc_id long, quality int")
    model = fit_ordinal(documents(spark, rows), ratings.where("doc_id % 3 <> 0"))
    assert model.grades == [1, 2, 3, 4] and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality_scores(documents(spark, rows), model, level=3).collect()}
    held = [(got[i], g) for i, g in marks if i % 3 == 0]
    means = [np.mean([r.expected_grade for r, g in held if g == k]) for k in (1, 2, 3, 4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5
    assert np.mean([r.accepted == (g >= 3) for r, g in held]) > 0.8
    assert all(1 <= r.expected_grade <= 4 for r in got.values())


def test_quality_of_odd_rows(spark):
    docs = documents(spark)
    ratings = spark.createDataFrame([(9, 0), (20, 1), (None, 1), (21, None), (12, 0), (12, 1)], "doc_id long, quality int")
    model = fit_ordinal(docs, ratings)
    scores = quality_scores(docs, model)
    assert scores.count() == len(ODD) and scores.where("tail_probability IS NULL OR isnan(tail_probability)").count() == 0
    kept = accepted_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == scores.where("accepted").count()
    empty = fit_ordinal(docs, ratings.limit(0))
    assert quality_scores(docs, empty).where("NOT accepted").count() == 0
    assert quality_scores(docs.limit(0), model).count() == 0


# -- toxicity -------------------------------------------------------------------------------------------------------------------------


def test_composed_machine():
    def read(symbols):
        state, out = 0, []
        for s in symbols:
            out.append(tuple(EMIT[state, s]))
            state = NEXT[state, s]
        return out

    assert read([TARGET, OTHER, INSULT])[-1] == (1, 0, 0, 1)
    assert read([NEGATION, OTHER, INSULT])[-1] == (1, 1, 0, 0)
    assert read([NEGATION, OTHER, OTHER, OTHER, INSULT])[-1] == (1, 0, 0, 0)  # too far back
    assert read([REPORT, OTHER, TARGET, INSULT])[-1] == (1, 0, 1, 1)


def test_toxic_texts_are_found_on_held_out_rows(spark):
    pick = random.Random(2)
    rows, marks = [], []
    for i in range(900):
        w = prose(3000 + i, 50).split()
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w[pick.randrange(len(w))] = pick.choice(["zorgish", "zorgly", "blech"])
        rows.append((i, " ".join(w) + ".", "a"))
        marks.append((i, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    docs = documents(spark, [*rows, *[(10000 + k, t, s) for k, (_, t, s) in enumerate(ODD)]])
    model = fit_toxicity(docs, labels, where=F.col("id") % 2 == 0)
    got = {r.doc_id: r for r in toxicity_scores(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, y in marks if i % 2]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values()) and len(got) == 900 + len(ODD)
    none = fit_toxicity(docs, labels.limit(0))
    assert toxicity_scores(docs, none).where("score <> 0.5").count() == 0
    assert toxicity_scores(docs.limit(0), model).count() == 0


# -- secrets --------------------------------------------------------------------------------------------------------------------------

BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def test_secret_spans(spark):
    pick = random.Random(1)
    secret = lambda n, letters="0123456789abcdef": "".join(pick.choice(letters) for _ in range(n))
    rows = [*ODD, (50, "TOKEN=token= abcdefgh password: 'x' Secret = \"abc.def-9\"", "a"), (51, "é AKIA" + "B3" * 8 + "  api_key:" + secret(40), "a"), (52, "token=ab token = " + secret(12), "a"), (53, "AKIAX " + secret(30) + "AKIA" + "Z" * 16, "a")]
    rows += [(100 + k, prose(k, 40) + f" token = \"{secret(40)}\" " + prose(k + 1, 20), "a") for k in range(40)]
    rows += [(400 + k, "the ordinarylong identifierword of alongidentifier wordsordinary " + prose(k, 5), "a") for k in range(60)]
    hidden = secret(24, "0123456789abcdefABCDEF") + "Q7"
    rows.append((300, prose(5, 10) + " " + hidden + " ordinarylongidentifierword " + prose(6, 10), "a"))
    got = secret_spans(documents(spark, rows)).collect()
    by_row = Counter()
    want = Counter()
    for i, text, _ in rows:
        found = [[(m.start(), k, m.end(), name) for m in p.finditer(text or "") if len(m[g]) >= least] for k, (name, p, g, least) in enumerate(BASE)]
        joined = ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(sum(found, [])))
        want[i, *map(len, found), hashlib.sha256(joined.encode()).hexdigest()] += 1
    for r in got:
        by_row[r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256] += 1
        listed = [s for s in r.spans.split(",") if s]
        base = ",".join(s for s in listed if not s.startswith("markov"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256 and len(listed) == r.n_assign + r.n_access + r.n_hex + r.n_markov
    assert by_row == want
    text = rows[-1][1]
    added = next(r.spans for r in got if r.doc_id == 300)
    assert added == f"markov:{text.index(hidden)}:{text.index(hidden) + len(hidden)}"
    assert secret_spans(documents(spark, rows).limit(0)).count() == 0


def test_secret_spans_of_a_long_text(spark):
    """20,000 assignments, a hex string in every tenth and runs between them: places across many blocks, in time that grows with the text."""
    pick = random.Random(4)
    secret = lambda n: "".join(pick.choice("0123456789abcdef") for _ in range(n))
    text = "".join(f"é password={'x' if k % 3 else secret(9)} {secret(30) if k % 10 == 0 else 'averyordinaryidentifier' if k % 4 else 'AKIA' + 'Q7' * 9} " for k in range(20000))
    rows = [(1, text, "a"), (2, text[: len(text) // 2], "a"), (3, prose(3, 200) + " token=" + secret(20), "b")]
    start = time.monotonic()
    got = {r.doc_id: r for r in secret_spans(documents(spark, rows)).collect()}
    assert time.monotonic() - start < 60
    for i, text, _ in rows:
        found = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= least]
        base = ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(found))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        listed = [s.split(":") for s in got[i].spans.split(",")]
        taken = {at for a, _, b, _ in found for at in range(a, b)}
        assert not any(at in taken for n, a, b in listed if n == "markov" for at in range(int(a), int(b)))


# -- language model -------------------------------------------------------------------------------------------------------------------


def test_language_model_scores(spark):
    pick = random.Random(8)
    rows = [*ODD, *[(200 + i, " ".join(x for _ in range(40) for x in pick.choice([("alpha", "beta"), ("gamma", "delta"), (f"r{pick.randrange(300)}", "omega")])), "a") for i in range(400)]]
    got = language_model_scores(documents(spark, rows)).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter()
    for i, text, _ in rows:
        if not held(i):
            counts.update([*words_of(text), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text, _ in rows:
        w = [*words_of(text), None]
        want.append((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    assert ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == ordered(want)
    assert all(r.score < 0 for r in got)
    apart = [r for r in got if r.held_out and (r.doc_id or 0) >= 200]
    assert apart and sum(r.score for r in apart) > sum(r.base_score for r in apart)
    assert language_model_scores(documents(spark, rows).limit(0)).count() == 0


def test_rare_words_are_contexts(spark):
    """Each a-word stands 24 times in 28,000 tokens, always before the b-word of its number; held-out texts have pairs in and out of order."""
    pick = random.Random(3)
    rows, ids = [], iter(range(1000, 100000))
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    train = [i for i in ids if not held(i)][:600]
    pairs = [k % 60 for k in range(60 * 24)]
    pick.shuffle(pairs)
    for k, i in enumerate(train):
        mine = " ".join(f"a{p} b{p}" for p in pairs[k::600])
        rows.append((i, mine + " " + " ".join(f"f{pick.randrange(3000)}" for _ in range(42)), "a"))
    test = [i for i in range(1000, 3000) if held(i)][:40]
    rows += [(i, f"a{k} b{k if k % 2 else (k + 7) % 60}", "a") for k, i in enumerate(test)]
    got = {r.doc_id: r for r in language_model_scores(documents(spark, rows)).collect()}
    ordered_pairs, others = ([got[i].score for k, i in enumerate(test) if k % 2 == odd] for odd in (1, 0))
    assert min(ordered_pairs) > max(others) + 1
    assert all(got[i].n_known == 3 for i in test)


def test_known_words_of_a_long_text():
    """70,000 known tokens of one document in one part, and 3 of the next one."""
    n = 70003
    part = SimpleNamespace(block=np.zeros(n, np.uint32), said=np.repeat([0, 1], [n - 3, 3]).astype(np.uint16), blocks=np.array([5]))
    said = next(pitman_yor._by_block(part, np.full(n, -1.0), np.ones(n, np.int64), 1e8, 1000)).to_pylist()[0]
    zero = np.zeros(2)
    fields = {"docs": np.array([8, 9]), "flags": np.ones(2, np.uint8), "tokens": np.array([n - 3, 3], np.uint32), "score": zero, "base": zero, "known": zero.astype(np.uint32)}
    own = pa.RecordBatch.from_pylist([{"docs": None, "flags": None, "tokens": None} | {f: v.tobytes() for f, v in fields.items()} | {"said": None}])
    other = pa.RecordBatch.from_pylist([{"docs": None} | said])
    (out,) = pitman_yor._together([own, other])
    assert out.column("n_known").to_pylist() == [70000, 3]


def test_pieces_are_encoded_a_few_at_once():
    """A worker's memory follows neither the batch nor the number of its new pieces."""
    encoder = token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    real, most = encoder.tokenizer, []

    class Seen:
        def encode_batch_fast(self, pieces, **options):
            most.append(len(pieces))
            return real.encode_batch_fast(pieces, **options)

    encoder.tokenizer = Seen()
    text = " ".join(f"word{k}" for k in range(20000))
    ids, offsets = encoder.encode(pa.array([text, None, "a"]), 2)
    assert max(most) <= token_output.ENCODED_AT_ONCE and sum(most) == 20001
    assert ids.tolist() == [*real.encode(text, add_special_tokens=False).ids, 2, 2, *real.encode("a", add_special_tokens=False).ids, 2]
    assert offsets.tolist() == [0, len(ids) - 3, len(ids) - 2, len(ids)]


def test_pieces_without_digits_are_encoded_together():
    """The tokenizer gets a few long texts instead of one for each new piece; marks in the pieces themselves change no id."""
    path, pick = public_tokenizers.path("word_bpe_49k.json"), random.Random(4)
    encoder = token_output.WordEncoder(path)
    real, given = encoder.tokenizer, []

    class Seen:
        def encode_batch_fast(self, pieces, **options):
            given.append(len(pieces))
            return real.encode_batch_fast(pieces, **options)

    encoder.tokenizer = Seen()
    text = " ".join("".join(pick.choice("abcdeé&,'B") for _ in range(pick.randrange(1, 12))) for _ in range(20000))
    ids, offsets = encoder.encode(pa.array([text]), 2)
    assert ids.tolist() == [*real.encode(text, add_special_tokens=False).ids, 2] and offsets.tolist() == [0, len(ids)]
    assert sum(given) < 10
    for text in ("new\x01 \x01 \x01\x01 words \x01old\x01 \u00a0 \u00a0\u00a0 <|endoftext|> é", "\x01", "\u2028 only"):
        assert encoder.encode(pa.array([text]), 2)[0].tolist() == [*real.encode(text, add_special_tokens=False).ids, 2], text


def test_letters_between_parts_are_few_where_contexts_are(spark, monkeypatch):
    """Their number follows the contexts and not the square of the number of parts; scores stay those of one part."""
    rows = [(k, prose(300 + k, 60), "s") for k in range(200)]
    letters, write = [], pitman_yor.written

    def counted(df, name):
        out = write(df, name)
        if name == "letters":
            letters.append(out.where("owner IS NOT NULL").count())
        return out

    monkeypatch.setattr(pitman_yor, "written", counted)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        got = {r.doc_id: r for r in language_model_scores(documents(spark, rows)).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        alone = {r.doc_id: r for r in language_model_scores(documents(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert letters and max(letters) <= 24
    assert all(math.isclose(got[k].base_score, alone[k].base_score, rel_tol=1e-9) and math.isclose(got[k].score, alone[k].score, rel_tol=0.1) for k in alone)
    assert pitman_yor._offices(24 * pitman_yor.LETTER * 5, 24) == 5 and pitman_yor._offices(10**12, 24) == 24


def test_packed_arrays_come_back_and_are_smaller():
    rng = np.random.default_rng(3)
    words, places, flags = np.unique(rng.integers(0, 2**64, 20000, np.uint64)), rng.integers(0, 3000, 20000).astype(np.uint32), (rng.random(5000) < 0.9).astype(np.uint8)
    for a in (words, places, flags, words[:1], words[:0], places[:0].astype(np.uint16)):
        (data,) = pitman_yor._packed(a)
        assert np.array_equal(pitman_yor._unpacked(data, a.dtype.type), a)
        assert len(a) < 100 or len(data) < 0.9 * a.nbytes


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    n, contexts = 50, 4
    word, context = np.divmod(np.arange(n * contexts), contexts)
    customers = rng.integers(0, 20, n * contexts)
    keep = customers > 0
    dishes = pitman_yor.Dishes(n, word[keep], context[keep], customers[keep], 1)
    totals = np.bincount(context, customers, contexts).astype(np.int64)
    totals[0] = 0
    shared = pitman_yor.Restaurants(totals, n, 0.6, 0.7)
    for _ in range(3):
        t = dishes.totals(contexts)
        shared = shared.after(t[:contexts], int(t[-2]), int(t[-1]))
        dishes.sweep(shared)
    t = dishes.totals(contexts)
    shared = shared.after(t[:contexts], int(t[-2]), int(t[-1]))
    parent, cell = dishes.predict(shared)
    unknown = float(shared.parent(np.zeros(1), np.zeros(1))[0])
    assert abs(parent.sum() + unknown - 1) < 1e-9
    for u in range(1, contexts):
        weight = (pitman_yor.STRENGTH + shared.discount * shared.tables[u]) / (pitman_yor.STRENGTH + shared.customers[u])
        chance = weight * np.append(parent, unknown)
        mine = dishes.context == u
        chance[dishes.word[mine]] = cell[mine]
        assert abs(chance.sum() - 1) < 1e-9


# -- fingerprints ---------------------------------------------------------------------------------------------------------------------


def test_fingerprints_of_texts_without_a_clear_winner():
    """Texts of 127 to 141 bytes have at most 15 runs; a period under 16 bytes leaves each window at most 15 votes."""
    ranks = fingerprint.rarity_ranks(np.bincount(fingerprint.entropy_classes(np.frombuffer(prose(7, 2000).encode("ascii", "replace"), np.uint8)), minlength=fingerprint.CLASSES))
    text = lambda seed, n: prose(seed, 60).encode("ascii", "replace").decode()[:n]
    chains = lambda *texts: fingerprint._chains(list(texts), ranks)
    differ = 0
    for n in range(127, 142):
        head = text(n, 64)
        one, other, empty, again = chains(head + text(n + 300, n - 64), head + text(n + 600, n - 64), "", head + text(n + 300, n - 64))
        assert len(one) == 1 and (one == again).all() and not len(empty)
        differ += one.tobytes() != other.tobytes()
    assert differ >= 12  # those with all winners in the common head agree
    junk, shorter, other = chains("junk " * 300, "junk " * 150, "junk " * 13 + "spam " * 287)
    assert (junk == shorter).all() and fingerprint.likeness(junk, other) < 1
    line, short_line = chains("=" * 500, "=" * 200)
    assert (line == short_line).all()


def test_fingerprints_and_edited_texts(spark):
    rows = [*ODD, (80, prose(60, 400), "a"), (81, prose(61, 400), "a"), (82, prose(60, 400), "a")]
    got = compare_with_next(documents(spark, rows)).collect()
    listed = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, text, _) in enumerate(listed):
        text, following = text or "", listed[(k + 1) % len(listed)][1] or ""
        half = len(text) // 2
        want.append((i, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    assert ordered((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == ordered(want)
    by_id = {r.doc_id: r for r in got}
    assert by_id[80].fingerprint == by_id[82].fingerprint != by_id[81].fingerprint
    assert 0.3 < by_id[80].near_edited < 0.8 and by_id[80].near_next < 0.1 and len(parse(by_id[80].fingerprint)) >= 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert compare_with_next(documents(spark, rows).limit(0)).count() == 0
    alone = compare_with_next(documents(spark, rows[-1:])).first()
    assert alone.near_next == 1


# -- revisits -------------------------------------------------------------------------------------------------------------------------

RECORDS = "record_id long, url string, fetched long, kind string, etag string, last_modified string, headers " + HEADERS


def test_revisits(spark):
    h = lambda **x: [(k.replace("_", "-"), v) for k, v in x.items()]
    rows = [
        (1, "http://Site.org/a?b=2&a=1#x", 100, "response", '"v1"', "mon", h(Content_Type="text", ETag="v1", Cache_Control="old", Set_Cookie="s1")),
        (2, "https://www.site.org:443/a/?a=1&b=2&utm_source=q", 100, "response", '"v2"', "tue", None),
        (3, "site.org/a?a=1&b=2", 5000, "revisit", 'W/"v2"', None, h(cache_control="new", Content_Length="0")),
        (3, "site.org/a?a=1&b=2", 5000, "revisit", 'W/"v2"', None, h(cache_control="new", Content_Length="0")),
        (4, "site.org/a?a=1&b=2", 100, "revisit", '"v2"', None, None), (5, "site.org/a?a=1&b=2", 900000, "revisit", '"v1"', None, None),
        (6, "site.org/a?a=1&b=2", 101, "revisit", None, "tue", h(expires="1")), (7, "site.org/a?a=1&b=2", 101, "revisit", None, None, None),
        (8, None, 101, "revisit", "x", None, None), (9, "site.org/other", None, "revisit", "x", None, None), (10, "site.org/a?a=1&b=2", 102, None, "x", None, None),
        (11, "site.org/c", 10, "response", None, "mon", h(vary="x")), (12, "site.org/c", 20, "revisit", "v", "mon", None),
    ]
    df = spark.createDataFrame(rows, RECORDS).withColumn("bucket", F.lit(1)).withColumn("state", F.lit(""))
    got = sorted((r.record_id, r.state, r.response_id, [tuple(x) for x in r.headers]) for r in resolve_revisits(df).collect())
    new = [("cache-control", "new")]
    assert got == [
        (3, "resolved", 2, new), (3, "resolved", 2, new), (4, "no_response", None, []), (5, "mismatch", None, []), (6, "resolved", 2, [("expires", "1")]),
        (7, "no_validator", None, []), (8, "no_key", None, []), (9, "no_key", None, []), (12, "mismatch", None, []),
    ]
    assert resolve_revisits(df.limit(0)).count() == 0


def test_revisits_of_one_hot_page(spark):
    """One URL with all captures, against a walk in time."""
    pick = random.Random(3)
    rows = [(k, "h.org/x", pick.randrange(40000), pick.choice(["response", "revisit", "revisit"]), "e", None, None) for k in range(1500)]
    want, last = {}, None
    for t in sorted({r[2] for r in rows}):
        for r in rows:
            if r[2] == t and r[3] == "revisit":
                want[r[0]] = last
        here = [r[0] for r in rows if r[2] == t and r[3] == "response"]
        last = max(here) if here else last
    got = {r.record_id: r.response_id for r in resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == want


def test_revisits_meet_by_page_and_time_alone(spark):
    """Revisits of one response, without one and without a key: no join deals them by what they found."""
    rows = [(1, "h.org/x", 10, "response", "e", None, None)] + [(k, "h.org/x", 10 + k, "revisit", "e", None, None) for k in range(2, 400)]
    rows += [(1000 + k, f"h.org/{k}", 5, "revisit", "e", None, None) for k in range(300)] + [(2000 + k, None, k, "revisit", "e", None, None) for k in range(300)]
    out = resolve_revisits(spark.createDataFrame(rows, RECORDS))
    assert Counter(r.state for r in out.collect()) == {"resolved": 398, "no_response": 300, "no_key": 300}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("record_id" in line or "found" in line for line in joins)


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.A.com:80/P/?z=1&a=2&gclid=9#f", "a.com/P?a=2&z=1", "https://a.com", "a.com/", " a.com?ref=1 ", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u"))).collect()]
    assert got == ["a.com/P?a=2&z=1", "a.com/P?a=2&z=1", "a.com", "a.com", "a.com", None]


# -- pipeline -------------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "token_files"]
    good = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    single = corpus_pipeline.near_dedup(spark, good, sf_dir)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, _, _, kept in brute_components(rows, 5, 80) if kept)
    clean = corpus_pipeline.decontamination(spark, good, sf_dir)
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in brute_leaks(rows, items) if not r[-1])
    mixed = corpus_pipeline.mixing(spark, good, sf_dir)
    for stage in (good, single, clean, mixed):
        assert stage.columns == docs.columns
    index = corpus_pipeline.token_files(spark, mixed, sf_dir)
    assert index.count() == mixed.count()


