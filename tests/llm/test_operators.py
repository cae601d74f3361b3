"""Each operator against a brute-force version on small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestore.llm import components, decontaminate, iblt, lm, mixing, simhash, substring, tokens, toxicity, urlfilter, warc
from lodestore.llm import queries as Q
from lodestore.llm.common import held_out, scratch_path

DOCS = "doc_id long, text string, source string, extra string"
VOCABULARY = Path(Q.VOCABULARY)


def words_of(text):
    return (text or "").encode().lower().split()


def make(spark, rows, schema=DOCS, n=3):
    return spark.createDataFrame(rows, schema).repartition(n)


def corpus(seed, n, vocabulary=60, most=60):
    """Texts with copies, near copies, shared passages, nulls, empties and repeated rows."""
    rng = random.Random(seed)
    names = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(vocabulary)]
    texts = [" ".join(rng.choices(names, k=rng.randint(0, most))) for _ in range(n)]
    passage = " ".join(rng.choices(names, k=20))
    for i in range(0, n, 4):
        texts[i] = rng.choice(["", texts[i] + " ", "X "]) + passage + rng.choice(["", "\n" + texts[i - 1]])
    for i in range(1, n, 5):
        texts[i] = texts[rng.randrange(n)]
    for i in range(2, n, 9):
        w = texts[i].split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        texts[i] = " \t".join(w)
    texts[3], texts[7 % n] = None, ""
    ids = rng.sample(range(10 * n), n)
    return [(i, t, rng.choice(["a", "b", None]), "e") for i, t in zip(ids, texts)]


# ------------------------------------------------------------------ components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)] + [(None, 3), (4, 4)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.connected_components(make(spark, edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: find(i) for i in parent} and len(got) == len(parent)
    assert components.connected_components(make(spark, [], "a long, b long")).count() == 0


# -------------------------------------------------------------------- toxicity


def test_grammar_composes():
    g = toxicity.Grammar()
    plain, negated, reported = (g.feature(t) for t in ("you are an idiot", "you are not an idiot", 'he said you are an "idiot"'))
    assert plain > negated > 0 and plain > reported > 0
    assert g.feature("what an idiot") < plain
    assert g.feature("i will kill you") > 0 and g.feature("i kill time") == 0 and g.feature("we will kill it") == 0
    assert g.feature("i will kill you. fine") > g.feature("you are fine.") == 0
    assert g.feature("he said i will kill you") < g.feature("i will kill you")
    assert g.feature("you will kill it") == 0  # the target comes before the threat
    assert len(g.arcs) == 9 * len(g.finals) and all(t in g.finals for t, _ in g.arcs.values())
    assert g.feature("you idiot\nyou clown") > g.feature("you idiot")  # clauses are scored one by one


def test_reported_speech_goes_over_clauses():
    g = toxicity.Grammar()
    direct, half = g.clauses("you idiot"), [x * g.gains.reported for x in g.clauses("you idiot")]
    assert g.clauses('"I was there. It was late." you idiot') == direct
    assert g.clauses('"I agree. You idiot. You idiot." he said') == half * 2
    assert g.clauses("he said: you idiot") == half and g.clauses("listen: you idiot") == direct
    assert g.clauses("“I agree. You idiot” … you idiot") != direct * 2
    assert g.clauses('an "open mark. you idiot') == direct and g.clauses('"he left\nyou idiot"') == direct
    assert g.clauses("„gut. you idiot.“ you idiot") == half + direct
    learned = toxicity.Grammar({"idiot": 5.0, "not": 1.0, "you": 1.0})
    assert learned.read("not")[0] == toxicity.NEGATION and learned.read("you")[0] == toxicity.TARGET
    assert learned.feature("you are not an idiot") < learned.feature("you are an idiot")


def cascade(tokens, gains, quoted):
    """Five transducers one after the other over ``(symbol, weight)``; the clause's weight."""
    reported, verb = [], False
    for symbol, _ in tokens:
        mark = symbol in (toxicity.OPEN, toxicity.CLOSE)
        reported.append(not mark and (verb or quoted))
        quoted = symbol == toxicity.OPEN if mark else quoted
        verb = verb or symbol == toxicity.REPORT
    negated = [any(s == toxicity.NEGATION for s, _ in tokens[max(0, i - 3) : i]) for i in range(len(tokens))]
    factor = [(gains.reported if r else 1.0) * (gains.negated if n else 1.0) for r, n in zip(reported, negated)]
    target = any(s == toxicity.TARGET for s, _ in tokens)
    marker = next((i for i, (s, _) in enumerate(tokens) if s == toxicity.MARKER), None)
    verb = next((i for i, (s, _) in enumerate(tokens) if s == toxicity.THREAT and marker is not None and i > marker), None)
    threat = verb is not None and any(s == toxicity.TARGET for s, _ in tokens[verb + 1 :])
    return sum(f * w for f, (_, w) in zip(factor, tokens)) * (gains.targeted if target else 1.0) + (gains.threat * factor[verb] if threat else 0.0)


@pytest.mark.parametrize("seed", range(4))
def test_machine_equals_the_cascade(seed):
    rng = random.Random(seed)
    gains = toxicity.Gains(0.3, 0.7, 1.9, 2.5)
    arcs, finals = toxicity.compose(gains)
    for _ in range(3000):
        quoted = rng.random() < 0.3
        tokens = [(rng.randrange(9), rng.choice([0.0, 0.0, 1.5, 4.0])) for _ in range(rng.randint(0, 14))]
        state, total = toxicity._start(quoted), 0.0
        for symbol, weight in tokens:
            state, factor = arcs[state, symbol]
            total += factor * weight
        factor, bonus = finals[state]
        assert math.isclose(total * factor + bonus, cascade(tokens, gains, quoted), abs_tol=1e-12)


def test_toxicity_of_odd_rows(spark):
    """Invalid UTF-8, clashing names, repeated rows, a text of 20 MB."""
    g = toxicity.Grammar()
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'796F7520FF206964696F74' AS string) AS text, 2.0D AS score, 1 AS label UNION ALL SELECT 1L, cast(X'796F7520FF206964696F74' AS string), 2.0D, 1 UNION ALL SELECT 2L, repeat('fine words. ', 1700000), 1.0D, 0")
    got = sorted(tuple(r) for r in toxicity.score_documents(docs, g).collect())
    assert got[0] == got[1] == (1, g.score("you \ufffd idiot")) and got[2] == (2, g.score("fine words"))
    kept = toxicity.drop_toxic(docs, g).collect()
    assert [(r.doc_id, r.score, len(r.text)) for r in kept] == [(2, 1.0, 12 * 1700000)]


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(5)
    names = ["".join(rng.choices("bcdfghklmnprst", k=5)) for _ in range(300)]
    rows = []
    for i in range(1200):
        w = rng.choices(names, k=rng.randint(5, 80))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(["zugzug", "zugnak", "Idiot"])
        rows.append((i, " ".join(w), int(toxic)))
    docs = make(spark, [(i, t, "s", "e") for i, t, _ in rows] + [(5000, None, None, None), (5001, "", "s", "e"), (None, "you idiot", "s", "e")])
    labels = make(spark, [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 != 1] + [(None, 1), (9, None)], "doc_id long, label int")
    got = toxicity.score_documents(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == 1203 and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    wrong = [i for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1 and (scores[i] >= 0.7) != bool(x)]
    assert len(wrong) <= 4
    assert scores[5000] == scores[5001] < 0.5
    kept = toxicity.drop_toxic(docs, toxicity.learn(docs, labels))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.7}


def test_toxicity_without_labels(spark):
    docs = make(spark, [(1, "you idiot", "s", "e"), (2, "fine", "s", "e")])
    g = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, label int"))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, g).collect()}
    assert got[1] > 0.7 > got[2]
    assert toxicity.score_documents(docs.limit(0), g).count() == 0


# ---------------------------------------------------------------------- mixing


def water_level(sizes, weights=(1, 2, 3), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    open_, left, out = set(order), float(sum(sizes.values())), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s in ["a", "b", "Ä", "zz", None, "tiny"][: 4 + seed]:
        for _ in range(5 if s == "tiny" else rng.randint(100, 300)):
            rows.append((len(rows), " ".join(["w"] * rng.choice([0, 3, 7, rng.randint(1, 200), 12])), s, "e"))
    rows += [(10**6, None, "a", "e"), (10**6, None, "a", "e"), (None, "x y", "b", "e")]
    got = mixing.mix(make(spark, rows), block=20).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(words_of(t))
    want, taken = water_level(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(12, 0.01 * t), (s, taken[s], t)
        # An independent solver: bisection on the tilt over all the source's documents.
        own = Counter(r.size for r in got if r.source == s and r.size)
        scale = sizes[s] / sum(own.values())
        rate = lambda z, tilt: 3 / (1 + 2 * math.exp(-max(-60.0, min(60.0, tilt * z / scale))))
        low, high = -500.0, 500.0
        while high - low > 1e-12 * max(1.0, abs(low)):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(n * z * rate(z, middle) for z, n in own.items()) < t else (low, middle)
        for z, n in own.items():
            copies = sum(r.copies for r in got if r.source == s and r.size == z)
            assert abs(copies - n * rate(z, low)) <= 1 + 0.5 * max(own) / z + 1e-3 * n, (s, z, n, copies)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(make(spark, rows, n=5), block=20).collect()))


def test_mixing_of_odd_rows(spark):
    """A third of the rows without identifier and of one size, clashing names."""
    rows = [(None if i % 3 == 0 else i, "w " * (5 if i % 3 == 0 else i % 9), "ab"[i % 2], 1, 2, 3) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, n int, target int")
    got = mixing.mix(df, block=25).collect()
    assert len(got) == 900
    want = water_level({s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in "ab"})
    for s, t in want.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 12


def test_mixing_counts_beyond_a_long(spark):
    """A class of 4 billion documents of which each is taken three times."""
    n = 4_000_000_000
    row = spark.createDataFrame([(n, 3 * n, n - 1)], "n long, copies long, x long")
    assert row.selectExpr("(cast(x as decimal(19, 0)) * cast(copies as decimal(19, 0))) div cast(n as decimal(19, 0)) AS v").first().v == 3 * (n - 1)


def test_mixing_that_does_not_settle_is_an_error(spark):
    classes = spark.createDataFrame([("a", 5, 10), ("a", 7, 3)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 71, 100.0)], "source string, source_size long, target double")
    with pytest.raises(RuntimeError, match="off after 2"):
        mixing.balance(classes, targets, steps=2, tolerance=1e-12)
    (tilt,) = mixing.balance(classes, targets).collect()
    rate = lambda z: 3 / (1 + 2 * math.exp(-tilt.tilt * z / tilt.scale))
    assert math.isclose(10 * 5 * rate(5) + 3 * 7 * rate(7), 100, rel_tol=1e-6)


def test_mixing_edges(spark):
    assert mixing.mix(make(spark, [])).count() == 0
    got = mixing.mix(make(spark, [(1, "", "a", "e"), (2, None, None, "e")])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


# ------------------------------------------------------------------------ urls


def test_host_and_path(spark):
    urls = ["HTTP://Www.Example.COM/En/x?q=/#f", "https://a.b#c", "a.com/x", None, "", "x://", "s://h?x/y", "s://u@H:80/p/?a", "a://b://c/d"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(*urlfilter.host_and_path(F.col("url")))
    got = [tuple(r) for r in df.collect()]
    assert got == [("www.example.com", "/En/x"), ("a.b", ""), ("", ""), ("", ""), ("", ""), ("", ""), ("h", ""), ("u@h:80", "/p/"), ("b:", "//c/d")]


def test_rules_and_native_plan(spark):
    urls = ["http://example.com/en/1", "http://www.example.com/en/1", "http://x.www.example.com/en/1", "http://www.example.com/fr/1", "http://example.com/fr/", "http://notexample.com/en/", "http://a.net/es/", "http://a.net/en/", "http://badcom/", "http://com/", None, "http://b.net/fr/9"]
    df = make(spark, [(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = urlfilter.judge(df, Q.RULES, order=3)
    got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    ruled = {0: ("example.com/en/", "block"), 1: ("www.example.com/en/", "allow"), 2: ("www.example.com/en/", "allow"), 3: ("com/", "allow"), 4: ("com/", "allow"), 5: ("com/", "allow"), 6: ("net/es/", "block"), 9: ("com/", "allow"), 11: ("net/fr/", "block")}
    assert {k: v for k, v in got.items() if v[0]} == ruled and len(got) == len(urls)
    assert all(v in ("allow", "block") for _, v in got.values())
    assert not any(w in out._jdf.queryExecution().toString() for w in ("Python", "Pandas", "ArrowEval"))
    assert urlfilter.judge(df.limit(0), Q.RULES).count() == 0


def test_rules_of_odd_rows(spark):
    """Equally long rules, equal ratios, repeated rows, clashing names, a long url."""
    rules = [urlfilter.Rule("a.b", "/cc", True), urlfilter.Rule("b", "/ccdd", False)]
    long = "http://x.org/" + "z" * 200_000
    urls = ["http://a.b/ccdd", "http://a.b/ccdd", "http://a.b/cc", "http://c.b/ccdd/1", "http://x.org/", "http://x.org/", None, long]
    df = make(spark, [(i // 2, u, "x", 1, 2.0) for i, u in enumerate(urls)], "page_id long, url string, text string, best int, llr double")
    got = Counter((r.page_id, r.rule, r.path[:9]) for r in urlfilter.judge(df, rules, order=3).collect())
    # a.b/cc and b/ccdd are equally long: the last by text decides.
    assert got == Counter({(0, "b/ccdd", "/ccdd"): 2, (1, "a.b/cc", "/cc"): 1, (1, "b/ccdd", "/ccdd/1"): 1, (2, None, "/"): 2, (3, None, ""): 1, (3, None, "/zzzzzzzz"): 1})
    same = {(r.page_id, r.verdict) for r in urlfilter.judge(df, rules, order=3).where("page_id = 2").collect()}
    assert len(same) == 1


def test_markov_ratio(spark):
    yes, no, order = ["abab", "aab", "b"], ["bbb", "cab"], 3
    texts = [(t, True) for t in yes] + [(t, False) for t in no]
    rows = spark.createDataFrame(texts, "text string, allow boolean")
    counts = urlfilter._counts(urlfilter._grams(rows, order, "allow"), order)
    asked = urlfilter._grams(spark.createDataFrame([("abz",), ("cc",), ("",)], "text string"), order, "text").select("gram").distinct()
    got = {r.gram: r.ratio for r in urlfilter.log_ratios(asked, counts, order).collect()}

    def model(side):
        grams = Counter()
        for t in side:
            line = "\x02" + t + "\x03"
            for i in range(2, len(line) + 1):
                whole = line[max(0, i - order) : i]
                for k in range(1, len(whole) + 1):
                    grams[whole[-k:]] += 1

        def p(g):
            if not g:
                return 1 / urlfilter.ALPHABET
            h = g[:-1]
            below = p(g[1:]) if len(g) > 1 else 1 / urlfilter.ALPHABET
            follow = {x: n for x, n in grams.items() if len(x) == len(g) and x[:-1] == h}
            c, t = sum(follow.values()), len(follow)
            return (grams[g] + t * below) / (c + t) if c else below

        return p

    a, b = model(yes), model(no)
    assert got and all(math.isclose(r, math.log(a(g)) - math.log(b(g)), rel_tol=1e-9, abs_tol=1e-12) for g, r in got.items())


def test_url_filter_separates(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choices(letters, k=8))
    rows = [(i, f"http://{word('abcde')}.com/{word('abcde')}") for i in range(300)] + [(1000 + i, f"http://{word('vwxyz')}.net/fr/{word('vwxyz')}") for i in range(300)]
    rows += [(2000 + i, f"http://{word('abcde')}.org/{word('abcde')}") for i in range(50)] + [(3000 + i, f"http://{word('vwxyz')}.org/{word('vwxyz')}") for i in range(50)]
    got = {r.page_id: r.verdict for r in urlfilter.judge(make(spark, rows, "page_id long, url string"), Q.RULES).collect()}
    assert sum(got[2000 + i] == "allow" for i in range(50)) >= 48 and sum(got[3000 + i] == "block" for i in range(50)) >= 48


# -------------------------------------------------------------- language model


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 5), (5, 3), (1000, 2000), (1000, 10**12), (5000, 2**63), (3000, 100)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    e = lm.EliasFano.of(v)
    assert (e.get(np.arange(n)) == v).all() and (e.all() == v).all()
    q = np.concatenate([v, rng.integers(0, top + top // 3 + 2, 500, dtype=np.uint64)])
    at, equal = e.successor(q)
    assert (at == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()
    if n > 100:
        assert sum(a.nbytes for a in e.arrays()) < n * (9 + max(0, math.log2(top / n))) / 8 + 400


def brute_model(training, order, least=2, discount=0.75):
    counts = [Counter() for _ in range(order + 1)]
    for w in training:
        counts[1].update(w)
        line = [None, *w]
        for k in range(2, order + 1):
            counts[k].update(tuple(line[i : i + k]) for i in range(len(line) - k + 1))
    total, distinct = sum(counts[1].values()), len(counts[1])
    kept = [defaultdict(float) for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            if c >= least:
                kept[k][g[:-1]] += (c - discount) / (counts[k - 1][g[:-1]] if k > 2 else counts[1][g[0]])

    def p(history, w):
        out = (counts[1][w] + 1) / (total + distinct + 1)
        for k in range(2, order + 1):
            h = tuple(history[-(k - 1) :])
            if len(h) < k - 1 or (k > 2 and counts[k - 1][h] < least):
                break
            c = counts[k][(*h, w)]
            of = counts[k - 1][h] if k > 2 else counts[1][h[0]]
            out = ((c - discount) / of if c >= least else 0) + (1 - kept[k][h]) * out
        return out

    return counts[1], total, distinct, p


@pytest.mark.parametrize(("order", "least"), [(1, 1), (2, 2), (3, 1), (3, 2), (4, 1)])
def test_language_model(spark, order, least):
    rows = corpus(order, 150, vocabulary=25) + [(None, "a b", "s", "e")]
    df = make(spark, rows)
    tokens = lm.tokenise(df, learn=~held_out("doc_id", 7, 2), chunk=400)
    plan = lm.train(tokens, order=order, shards=3, least=least)
    got = lm.score(tokens, plan).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    docs = {(i, t): [*words_of(t), None] for i, t, _, _ in rows}
    counts, total, distinct, p = brute_model([w for (i, _), w in docs.items() if not out(i)], order, least)
    want = {}
    for (i, _), w in docs.items():
        s, b, h = 0.0, 0.0, [None]
        for x in w:
            s, b = s + math.log10(p(h, x)), b + math.log10((counts[x] + 1) / (total + distinct + 1))
            h.append(x)
        want[i] = (len(w), sum(x in counts for x in w), b, s)
    assert len(got) == len(rows)
    for r in got:
        n, known, b, s = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, b, rel_tol=1e-9) and math.isclose(r.score, s, rel_tol=2e-3, abs_tol=1e-3 * n)
    # What the model gives adds up to 1 over the vocabulary and one unknown word.
    for h in ([None], [None, None], list(docs.values())[0][:2]):
        assert math.isclose(sum(p(h, w) for w in [*counts, "never seen"]), 1, rel_tol=1e-9)


def test_language_model_splits_hot_contexts(spark):
    rng = random.Random(1)
    texts = [" ".join(x for _ in range(40) for x in ("hot", rng.choice("abcdefghij"))) for _ in range(40)]
    df = make(spark, [(i, t, "s", "e") for i, t in enumerate(texts)])
    tokens = lm.tokenise(df, chunk=200)
    plan = lm.train(tokens, order=3, shards=20)
    assert plan.hot[0] and plan.hot[1]
    _, _, _, p = brute_model([[*words_of(t), None] for t in texts], 3, least=1)
    for r in lm.score(tokens, plan).collect():
        s, h = 0.0, [None]
        for x in [*words_of(texts[r.doc_id]), None]:
            s += math.log10(p(h, x))
            h.append(x)
        assert math.isclose(r.score, s, rel_tol=2e-3)


def test_language_model_of_nothing(spark):
    plan = lm.train(lm.tokenise(make(spark, [])), order=3, shards=2)
    some = make(spark, [(1, "a b", "s", "e"), (2, None, "s", "e"), (2, None, "s", "e")])
    got = lm.score(lm.tokenise(some), plan).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.score) for r in got) == [(1, 3, 0, 0.0), (2, 1, 0, 0.0), (2, 1, 0, 0.0)]
    assert lm.score(lm.tokenise(make(spark, [])), plan).count() == 0


def test_language_model_of_odd_texts(spark):
    """Invalid UTF-8, clashing column names, and a text of many chunks' size."""
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    rows = [(1, "a \ufffd b", 1.0, 2), (2, long, 1.0, 2), (3, long, 1.0, 2)]
    df = make(spark, rows, "doc_id long, text string, score double, n_tokens int")
    odd = df.withColumn("text", F.expr("if(doc_id = 1, cast(X'6120FF2062' as string), text)"))
    scores = []
    for x in (df, odd):
        tokens = lm.tokenise(x, chunk=1000)
        scores.append(sorted(lm.score(tokens, lm.train(tokens, shards=3)).collect()))
    assert scores[0] == scores[1] and [r.n_tokens for r in scores[0]] == [4, 60_001, 60_001]
    assert scores[0][1].score == scores[0][2].score


@pytest.mark.parametrize("seed", [1, 2])
def test_elias_fano_of_uneven_numbers(seed):
    """Long runs of neighbours among wide gaps: directories with drawn out strides."""
    rng = np.random.default_rng(seed)
    v = np.unique(np.concatenate([np.arange(5000) + 10**9, rng.integers(0, 10**12, 3000), np.arange(0, 40_000, 2) + 10**11])).astype(np.uint64)
    e = lm.EliasFano.of(v)
    assert len(e.zeros[1])
    q = np.sort(np.concatenate([v, v + np.uint64(1), rng.integers(0, 10**12 + 10**11, 3000).astype(np.uint64)]))
    at, equal = e.successor(q)
    want = np.searchsorted(v, q)
    assert (at == want).all() and (equal == np.isin(q, v)).all() and (e.get(np.arange(len(v))) == v).all()
    begin, end = np.maximum(want - rng.integers(0, 9, len(q)), 0), np.minimum(want + rng.integers(1, 9, len(q)), len(v))
    at, equal = e.successor(q, begin, end)
    assert (at == want)[want < len(v)].all() and (equal == np.isin(q, v)).all()


def test_op4_uses_every_ngram(spark, tmp_path):
    rows = [(i, t, s, e) for i, t, s, e in corpus(5, 60, vocabulary=25)]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = {i: [*words_of(t), None] for i, t, _, _ in rows}
    p = brute_model([w for i, w in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2], 3, least=1)[3]
    for r in Q.op4_lm_scoring(spark, str(tmp_path)).collect():
        w = docs[r.doc_id]
        s = sum(math.log10(p([None, *w[:k]], x)) for k, x in enumerate(w))
        assert math.isclose(r.score, s, rel_tol=2e-3, abs_tol=1e-3 * len(w))


# --------------------------------------------------------------------- simhash


def brute_fingerprint(text, n=3):
    w = [x.decode() for x in words_of(text)]
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed):
    rows = corpus(seed, 120) + [(9999, "one  two", "a", "e"), (9998, "ONE two", "a", "e"), (None, "only null", "a", "e")]
    fp = [(i, brute_fingerprint(t)) for i, t, _, _ in rows]
    group = list(range(len(fp)))
    for _ in fp:
        for a in range(len(fp)):
            for b in range(len(fp)):
                if (fp[a][1] ^ fp[b][1]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[a] == group[b] for a in range(len(fp)) for b in range(a) if (fp[a][1] ^ fp[b][1]).bit_count() <= 2):
            break
    least = {g: min((i for k, (i, _) in enumerate(fp) if group[k] == g and i is not None), default=None) for g in group}
    want = sorted(str((i, f"{f:016x}", least[group[k]])) for k, (i, f) in enumerate(fp))
    got = simhash.near_duplicates(make(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == want


@pytest.mark.parametrize(("radius", "parts"), [(1, 1), (2, 1), (3, 1), (7, 2), (5, 2)])
def test_masks_cover(radius, parts):
    masks = simhash.tables(radius, parts)
    assert len(masks) == parts * (2 ** (radius // parts + 1) - 1)
    rng = random.Random(radius)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & x for m in masks)


@pytest.mark.parametrize("bucket", [3, 20_000])
def test_links_are_complete_with_split_buckets(spark, bucket):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    points = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(simhash.signed(p), simhash.signed(p)) for p in points], "fp long, node long")
    links = simhash.covering_links(df, 2, bucket=bucket).collect()
    unsigned = lambda x: x % (1 << 64)
    assert all((unsigned(r.a) ^ unsigned(r.b)).bit_count() <= 2 for r in links)
    assert len(links) < 7 * len(points) * (1 if bucket > 3 else 60)
    find = {p: p for p in points}

    def root(p):
        while find[p] != p:
            p = find[p]
        return p

    for r in links:
        find[root(unsigned(r.a))] = root(unsigned(r.b))
    for p in points:
        for q in points:
            if (p ^ q).bit_count() <= 2:
                assert root(p) == root(q)


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, truth = [], []
    for g in range(25):
        base = [word() for _ in range(200)]
        for k in range(rng.randint(1, 4)):
            w = list(base)
            if k:
                for _ in range(rng.randint(1, 3)):
                    w[rng.randrange(200)] = word()
            truth.append((len(rows), g))
            rows.append((len(rows), " ".join(w), "s", "e"))
    rows += [(900, None, "s", "e"), (901, "", "s", "e"), (0, rows[0][1], "s", "e"), (None, rows[0][1], "s", "e")]
    out = simhash.drop_near_duplicates(make(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "extra"]
    got = sorted(r.doc_id for r in out.collect())
    assert got == sorted([min(i for i, h in truth if h == g) for g in range(25)] + [900])
    assert simhash.drop_near_duplicates(make(spark, [])).count() == 0


def shingle_set(text, n=5):
    w = words_of(text)
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stage_finds_appended_and_truncated_copies(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for g in range(40):
        base = [word() for _ in range(400)]
        cut = 400 * rng.randint(90, 93) // 100
        rows += [(2 * g, " ".join(base), "s", "e"), (2 * g + 1, " ".join(base[:cut] if g % 2 else base + [word() for _ in range(400 - cut)]), "s", "e")]
        assert jaccard(shingle_set(rows[-2][1]), shingle_set(rows[-1][1])) >= 0.88
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(make(spark, rows)).collect()) == list(range(0, 80, 2))


@pytest.mark.parametrize("most", [300, simhash.SHINGLES])
def test_stage_links_by_exact_similarity(spark, most):
    rng = random.Random(16)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = ["", " \n", None, "one", "One", "one two three four five six seven", "one two three four five six", word() + " "]
    for g in range(40):
        base = [word() for _ in range(rng.choice([8, 12, 60, 300]))]
        texts.append(" ".join(base))
        for k in range(6 if g else 40):
            w, share = list(base), rng.uniform(0, 0.35)
            if k % 3 == 0:
                w += [word() for _ in range(int(len(w) * share))]
            elif k % 3 == 1:
                w = w[: max(1, int(len(w) * (1 - share)))]
            else:
                for _ in range(int(len(w) * share / 5)):
                    w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    group = list(range(len(texts)))
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8]
    while any(group[a] != group[b] for a, b in pairs):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert 20 < len(pairs) and len(set(group)) > 60
    got = simhash.similar_groups(make(spark, [(i, t, "s", "e") for i, t in enumerate(texts)]), most=most).collect()
    nodes = {simhash.signed(xxhash.xxh64_intdigest((t or "").encode(), 42)): group[i] for i, t in enumerate(texts)}
    assert {r.h: r.keeper for r in got} == nodes and len(got) == len(nodes)


def test_stage_nominates_by_covering_tables(spark):
    """All pairs that agree on a covering mask are joined, whatever the parts; no pair within
    the covering radius lacks one, and pairs with similarity 0.8 have one."""
    rng = np.random.default_rng(17)
    draw = lambda k: rng.integers(0, 1 << 64, k, np.uint64)
    sets = [draw(rng.integers(4, 60)) for _ in range(150)]
    for base in sets[:50]:
        sets += [np.concatenate([base[: len(base) - len(base) // 10], draw(len(base) // 10)]), np.concatenate([base, draw(len(base) // 4)])]
    crowd = draw(60)
    sets += [np.concatenate([crowd[:57], draw(3)]) for _ in range(60)]
    bits = [simhash.long_majority(s) for s in sets]
    x = [int.from_bytes(b, "big") for b in bits]
    masks = [[int(m) << simhash.PART * (simhash.PARTS - 1 - p) for m in simhash.covering_masks(list(range(simhash.PART)), simhash.NEAR, seed=7 + p)] for p in range(simhash.PARTS)]
    low = simhash.PARTS * simhash.PART - 64 * simhash.WORDS
    group, linked = list(range(len(x))), {}
    for b in range(len(x)):
        for a in range(b):
            d = x[a] ^ x[b]
            shares = any(not d & m for part in masks for m in part)
            assert shares or d.bit_count() > simhash.PARTS * (simhash.NEAR + 1) - 1
            linked[a, b] = shares and (d >> low).bit_count() <= simhash.LOOSE
    assert all(linked[i, 150 + 2 * i + k] for i in range(50) for k in (0, 1))
    while any(group[a] != group[b] for (a, b), v in linked.items() if v):
        for (a, b), v in linked.items():
            if v:
                group[a] = group[b] = min(group[a], group[b])
    points = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bits)], "node long, bits binary")
    got = {r.node: r.component for r in simhash.nominated(points).collect()}
    assert [got.get(i, i) for i in range(len(x))] == group
    assert simhash.nominated(points.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [1, 16, 1024])
def test_bucket_stars_against_all_pairs(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(18)
    node = np.sort(rng.integers(0, 250, 300)) * 3
    part = rng.integers(0, 8, 300)
    words = rng.integers(0, 1 << 64, (40, 4), np.uint64)[rng.integers(0, 40, 300)]
    words[::7] ^= np.uint64(0xFFFFFFFFFFFFFFFF)
    words[::5, 0] ^= np.uint64(0xFFFF)
    masks = np.array([6, 5])
    a, b = simhash._bucket_stars(masks, node, part, words)
    want, got = {n: n for n in node.tolist()}, {n: n for n in node.tolist()}

    def join(group, x, y):
        low, high = sorted((group[x], group[y]))
        for n in group:
            group[n] = low if group[n] == high else group[n]

    for i in range(300):
        for j in range(i):
            near = sum(int(u ^ v).bit_count() for u, v in zip(words[i], words[j])) <= simhash.LOOSE
            if near and any((part[i] ^ part[j]) & m == 0 for m in masks):
                join(want, int(node[i]), int(node[j]))
    for x, y in zip(a.tolist(), b.tolist()):
        join(got, x, y)
    assert got == want and len(a) < len(got)


ODD = "SELECT 1L AS doc_id, cast(X'6120FF20622063206420652066' AS string) AS text, {more} UNION ALL SELECT 2L, cast(X'6120FF20622063206420652066' AS string), {more} UNION ALL SELECT 2L, cast(X'6120FF20622063206420652066' AS string), {more} UNION ALL SELECT 3L, repeat('long text of twenty megabytes ', 700000), {more} UNION ALL SELECT 4L, repeat('long text of twenty megabytes ', 700000), {more} UNION ALL SELECT 5L, 'something else', {more} UNION ALL SELECT cast(NULL AS bigint), 'something else', {more}"


def test_near_duplicates_of_odd_rows(spark):
    """Invalid UTF-8, repeated rows, texts of 20 MB, a null identifier, clashing names."""
    df = spark.sql(ODD.format(more="7 AS fp, 8 AS node, 9 AS component, 'x' AS h, 'y' AS check, 'z' AS own"))
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 2, (3, 3): 1, (4, 3): 1, (5, 5): 1, (None, 5): 1})
    kept = simhash.drop_near_duplicates(df).collect()
    assert sorted((r.doc_id, r.fp, r.h) for r in kept) == [(1, 7, "x"), (3, 7, "x"), (5, 7, "x")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.drop_near_duplicates(df.limit(0)).count()


def test_texts_with_one_hash_stay_apart(spark, monkeypatch):
    """Two texts are one only if both their hashes are equal."""
    real = simhash._hashed
    monkeypatch.setattr(simhash, "_hashed", lambda *a: real(*a).withColumn("h", F.lit(5).cast("long")))
    docs = make(spark, [(1, "one two three four five six", "s", "e"), (2, "seven eight nine ten eleven", "s", "e"), (3, "one two three four five six", "s", "e")])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [1, 2]


# ------------------------------------------------------------------- substring


def test_substrings_of_odd_rows(spark):
    df = spark.sql(ODD.format(more="7 AS kept, 8 AS crc, 9 AS at, 'x' AS mark, 1L AS n_chars"))
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.substring_dedup(df, 3).collect())
    assert got == [(0, 2, 0), (1, 7, 0), (2, 7, 7), (2, 7, 7), (3, 3_500_000, 0), (4, 3_500_000, 3_500_000), (5, 2, 0)]
    out = {(r.doc_id, len(r.text.split()), r.n_chars, r.kept) for r in substring.strip_repeats(df, 3).collect()}
    assert {(2, 0, 0, 7), (4, 0, 0, 7), (5, 2, 1, 7)} < out


def brute_substrings(rows, window):
    first = {}
    for i, t, _, _ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t, _, _ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, y in zip(w, gone) if not y).decode()))
    return out


@pytest.mark.parametrize(("seed", "window", "batches"), [(0, 13, 2), (1, 5, 1), (2, 3, 6), (3, 13, 3)])
def test_substring_dedup(spark, seed, window, batches, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", 50)
    rows = corpus(seed, 90, vocabulary=12) + [(None, "a b c " * 9, "s", "e")]
    rows += [(rows[0][0], "other text of the same identifier " * 4, "s", "e"), rows[8], (10**6, " ".join(f"w{i}" for i in range(20)) + "\n" + " ".join(f"w{i}" for i in range(20)), "s", "e")]
    got = substring.substring_dedup(make(spark, rows), window, batches, rejoin=True).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_substrings(rows, window)))
    out = substring.strip_repeats(make(spark, rows).withColumn("n_chars", F.char_length("text").cast("long")), window, batches)
    assert out.columns == ["doc_id", "text", "source", "extra", "n_chars"]
    kept = Counter((r.doc_id, " ".join((r.text or "").split())) for r in out.collect())
    assert kept == Counter((i, " ".join(k.split())) for i, _, _, k in brute_substrings(rows, window))
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_index_compacts(spark):
    index = substring.FingerprintIndex(spark, fan_out=2, buckets=2)
    add = lambda rows: tuple(sorted(tuple(r) for r in df.collect()) if df is not None else [] for df in index.add(spark.createDataFrame(rows, "doc_id long, mark long")))
    assert add([(1, 10), (2, 10), (1, 11)]) == ([(10,)], [])
    assert add([(3, 11), (3, 12)]) == ([(11,)], [(11, 1)])
    assert len(index.marks) == 2
    assert add([(4, 12), (4, 10), (4, 13), (4, 11)]) == ([(10,), (11,), (12,)], [(12, 3)])
    assert len(index.marks) == 1
    assert add([(5, 13), (5, 14), (5, 10)]) == ([(10,), (13,)], [(13, 4)])
    index.drop()
    assert substring.substring_dedup(make(spark, [])).count() == 0


@pytest.mark.parametrize("full", [20, 10**9])
def test_index_is_kept_and_reads_no_history_again(spark, monkeypatch, full):
    """Batches added to a kept index, which is opened anew each time; of the history only
    those texts are given to which a mark points, the others are blank."""
    monkeypatch.setattr(substring.FingerprintIndex, "FULL", full)
    window, rows = 8, [r for r in corpus(8, 200, vocabulary=6, most=25) if r[1]]
    rows.sort(key=lambda r: r[0] * 7919 % 1009)  # identifiers don't follow the batches
    folder = scratch_path(spark, "kept")
    substring.FingerprintIndex(spark, folder, fan_out=2, buckets=3).save()
    marks = {i: set(substring.window_fingerprints(t.encode().split(), window).tolist()) for i, t, *_ in rows}
    cuts = [0, 60, 90, 91, len(rows)]
    blank = 0
    for low, high in zip(cuts, cuts[1:]):
        batch, before = rows[low:high], rows[:low]
        holders = Counter(m for i, *_ in before for m in marks[i])
        new = set().union(*(marks[i] for i, *_ in batch))
        pointed = {i for i, *_ in before if any(holders[m] == 1 and m in new for m in marks[i])}
        blank += len(before) - len(pointed)
        history = make(spark, [(i, t if i in pointed else None, s, e) for i, t, s, e in before])
        index = substring.FingerprintIndex.open(spark, folder)
        got = substring.substring_dedup(make(spark, batch), window, 1, index, history, rejoin=True).collect()
        want = brute_substrings(rows[:high], window)
        ids = {r[0] for r in batch}
        assert sorted(map(tuple, got)) == sorted(w for w in want if w[0] in ids)
    assert blank > 20 and len(index.marks) <= 2 and len(index.verified) <= 2
    assert (index.slots > 3) == (full == 20)
    index.drop()


# ---------------------------------------------------------------------- tokens


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary file")
def test_token_counts(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokens.read_pieces(VOCABULARY.read_bytes())
    reference = Tokenizer(models.Unigram([(p, float(s)) for p, s in pieces], unk_id=0, byte_fallback=True))
    reference.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(3)
    letters = list("ab the \n\t<0x41>éß漢字🙂▁▁s</un>k") + ["ing", " of", "\u0300", "한"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(800)] + ["x" * 3000, "", " ", "🙂" * 500, " ".join(["word"] * 2000)]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(make(spark, [(i, t, "s", "e") for i, t in enumerate(texts)] + [(-1, None, "s", "e")]), pieces).collect()}
    assert got.pop(-1) == 0
    assert got == {i: len(reference.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_tie_rules_and_unknowns():
    counter = tokens.PieceCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("abb", -3.0)])
    assert counter.count("ab") == 2  # ▁a|b and ▁|ab score the same: the longest last piece wins
    assert counter.count("a") == 1
    assert counter.count("a??b") == 3  # a run of unknowns is one
    assert counter.count("") == 0


def test_long_stretches_are_counted_block_by_block(spark, monkeypatch):
    rng = random.Random(12)
    counter = tokens.PieceCounter([("▁", -1.0), ("a", -1.2), ("b", -1.1), ("ab", -2.0), ("▁a", -2.0), ("abbab", -3.0), ("ba", -2.5)])
    texts = ["▁" + "".join(rng.choices("ab", k=k)) for k in (1, 2, 30, 31, 32, 400)] + ["▁" + "".join(rng.choices("ab??é", k=k)) for k in (3, 30, 64, 500)] + ["▁" + "?" * 100]
    whole = [counter.stretch(t) for t in texts]
    for size in (1, 7, 32):
        monkeypatch.setattr(tokens, "BLOCK", size)
        assert [counter.stretch(t) for t in texts] == whole
    monkeypatch.undo()
    pieces = [("▁", -1.0), ("a", -1.2), ("b", -1.1), ("ab", -2.0)]
    df = spark.sql("SELECT 1L AS doc_id, repeat('ab', 3000000) AS text, 7 AS n_tokens UNION ALL SELECT 2L, cast(X'61FF62' AS string), 7 UNION ALL SELECT 2L, cast(X'61FF62' AS string), 7")
    assert sorted(tuple(r) for r in tokens.token_counts(df, pieces).collect()) == [(1, 3_000_001), (2, 4), (2, 4)]
    assert tokens.token_counts(df.limit(0), pieces).count() == 0


# --------------------------------------------------------------- contamination


def edit_distance_within(pattern, text):
    before = [0] * (len(text) + 1)
    for i in range(1, len(pattern) + 1):
        now = [i] + [0] * len(text)
        for j in range(1, len(text) + 1):
            now[j] = min(before[j - 1] + (pattern[i - 1] != text[j - 1]), before[j] + 1, now[j - 1] + 1)
        before = now
    best = min(before)
    return best, before.index(best)


def test_myers():
    rng = random.Random(1)
    for _ in range(1500):
        p, t = ("".join(rng.choices("abc", k=rng.randint(a, b))) for a, b in ((1, 9), (0, 20)))
        assert decontaminate.myers(p, t, 99) == edit_distance_within(p, t)


def test_contamination(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdef  ", k=n)).strip() or "a"
    items = [(i, text(rng.randint(20, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "  "), (53, "short"), (None, text(30))]
    rows = []
    for k in range(150):
        body = list(text(rng.randint(0, 200)))
        if k % 3 == 0:
            item = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(item))
                item[at] = rng.choice(["", "z", item[at] * 2, "Q"])
            cut = rng.randrange(len(body) + 1)
            body[cut:cut] = ["  ", *item, "\n"]
        rows.append((k, "".join(body), "s", "e"))
    rows += [(900, None, "s", "e"), (901, "", "s", "e")]
    norm = lambda t: decontaminate.normal((t or "").encode())
    want = set()
    for d, t, _, _ in rows:
        for i, b in items:
            p = norm(b)
            if p and norm(t):
                got = edit_distance_within(p, norm(t))[0]
                if got <= int(len(p) * 0.1):
                    want.add((d, i, got))
    docs, bench = make(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for chars in (4_000_000, 100):
        found = decontaminate.contaminated(docs, bench, 0.1, chars).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in found} == want
        kept = decontaminate.drop_contaminated(docs, bench, 0.1, chars)
        assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _, _ in want}
    assert len(want) > 15
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 == decontaminate.contaminated(docs.limit(0), bench).count()


def test_contamination_of_odd_rows(spark):
    """Invalid UTF-8, clashing names, repeated rows of both sides, a text of 6 MB."""
    docs = spark.sql("SELECT 1L AS doc_id, concat(repeat('some words here ', 400000), 'the quick brown fox jumps') AS text, 5 AS item_id, 6 AS distance UNION ALL SELECT 2L, cast(X'74686520717569636B2062726F776E20666F78206A756D70FF' AS string), 5, 6 UNION ALL SELECT 2L, cast(X'74686520717569636B2062726F776E20666F78206A756D70FF' AS string), 5, 6 UNION ALL SELECT 3L, 'clean', 5, 6")
    bench = spark.createDataFrame([(7, "The quick brown  fox jumps", 1), (7, "The quick brown  fox jumps", 1), (8, "of another kind", 1)], "item_id long, text string, block int")
    got = decontaminate.contaminated(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id, r.distance) for r in got) == {(1, 7, 0): 2, (2, 7, 1): 4}
    assert [(r.doc_id, r.item_id) for r in decontaminate.drop_contaminated(docs, bench).collect()] == [(3, 5)]


# ------------------------------------------------------------------------ WARC


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = [(1, "http://a/\r\nX: y", "same"), (5, "http://b/", "same"), (2, None, None), (3, "http://c/ü", ""), (4, "", "Grüße\r\n\r\nWARC/1.1\r\n"), (9, "u", "long" * 500_000), (7, "u", "long" * 500_000), (None, "u", "same"), (5, "http://b/", "same"), (-3, "u", "\x00\x1f\x8b" * 9)]
    df = make(spark, pages, "page_id long, url string, html string")
    folder = scratch_path(spark, "test-warc")
    got = warc.archive_round_trip(spark, df, folder, least).collect()
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        top = max((j for j, _, g in pages if (g or "") == (h or "") and j is not None), default=None)
        again = len(raw) >= least and i is not None and top is not None and i < top
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_warc_chunks(spark, tmp_path):
    from pyarrow import fs

    payload = random.Random(1).randbytes(100_000)
    sha = lambda x: hashlib.sha1(x).digest()
    store = fs.LocalFileSystem()
    for plain in (False, True):
        path = str(tmp_path / f"x{plain}.warc")
        with store.open_output_stream(path + ".gz", compression=None) as out:
            writer = warc.Writer(out)
            writer.response(b"1" * 16, 1, "http://a/", sha(payload), len(payload))
            with pytest.raises(ValueError, match="lacks 100000"):
                writer.response(b"2" * 16, 2, "http://b/", sha(b""), 0)
            for at in range(0, len(payload), 30_000):
                writer.add(payload[at : at + 30_000])
            writer.response(b"2" * 16, 2, "http://b/", sha(b""), 0)
            writer.revisit(b"3" * 16, 3, "http://c/", sha(payload), b"1" * 16, 1)
        if plain:
            import gzip

            Path(path + ".gz").write_bytes(gzip.decompress(Path(path + ".gz").read_bytes()))
        df = spark.createDataFrame([(f"file://{path}.gz",)], "path string")
        rows = sorted(warc.read_chunks(df, 1, 4096).collect(), key=lambda r: (r.ordinal, r.chunk_no))
        one = [r for r in rows if r.ordinal == 0]
        assert b"".join(bytes(r.data) for r in one) == payload and len(one) == -(-100_000 // 4096) and max(len(r.data) for r in one) == 4096
        for r in one:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(payload[: r.payload_bytes]).digest()).decode()
        assert [(r.page_id, r.record_type, r.refers_to, len(r.data)) for r in rows[len(one) :]] == [(2, "response", None, 0), (3, "revisit", 1, 0)]
    with pytest.raises(ValueError, match="ends inside"):
        list(list(p) for _, p in warc.Reader(fs.LocalFileSystem().open_input_stream(_cut(path, tmp_path))).records())


def test_warc_of_long_rows(spark):
    """A 2 MiB url that grows when escaped, a payload of many chunks, clashing names,
    repeated rows: all records have names of their own and come back whole."""
    big = spark.range(1).select(F.lit(8).cast("long").alias("page_id"), F.expr("repeat(' ü', 1 << 20)").alias("url"), F.expr("repeat('0123456789abcdef', 1 << 19)").alias("html"))
    some = make(spark, [(5, "u", "same"), (5, "u", "same"), (4, "u", "same"), (4, "u", "same"), (None, "u", "same"), (None, "u", "same"), (5, "v", "other")], "page_id long, url string, html string")
    pages = big.unionAll(some).withColumn("payload", F.lit(1)).withColumn("key", F.lit(2)).withColumn("size", F.lit(3)).withColumn("at", F.lit(4))
    chunks = warc.chunk_table(spark, pages, scratch_path(spark, "test-warc"))
    names = chunks.groupBy("record_id").agg(F.max("payload_bytes").alias("n"), F.count("*").alias("chunks")).collect()
    assert len(names) == 8 and max((r.n, r.chunks) for r in names) == (16 << 19, 8)
    whole = chunks.where("page_id = 8").orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in whole) == b"0123456789abcdef" * (1 << 19)
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_records(chunks).collect())
    assert got == Counter({(8, "response", None): 1, (5, "response", None): 3, (4, "revisit", 5): 2, (None, "response", None): 2})


def _cut(path, tmp_path):
    data = Path(path + ".gz").read_bytes()
    (tmp_path / "cut").write_bytes(data[: len(data) // 2])
    return str(tmp_path / "cut")


def test_warc_of_nothing(spark):
    df = make(spark, [], "page_id long, url string, html string")
    assert warc.archive_round_trip(spark, df, scratch_path(spark, "test-warc")).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_peeling_recovers_differences():
    rng = np.random.default_rng(4)
    first, second = [], []
    for n in (0, 1, 5, 40, 400, 3000):
        for d in (0, 1, 3, n):
            common, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (n, d, d // 2))
            first.append(np.concatenate([common, a]))
            second.append(np.concatenate([common, b]))
    got = iblt.differing(first, second, 48)
    for a, b, (x, y, _) in zip(first, second, got):
        assert set(x) == set(a.tolist()) - set(b.tolist()) and set(y) == set(b.tolist()) - set(a.tolist())
    done, *_ = iblt.peel(iblt.subtract(iblt.sketch([first[-1]], 48), iblt.sketch([second[-1]], 48)))
    assert not done[0]  # too small: the caller tries again with more cells


def test_repeated_short_paragraphs_stay_apart():
    text = b"\n".join(bytes([97 + i % 2, 98, 97 + i % 7]) for i in range(2000))
    keys = iblt.digests(text)
    assert len(keys) == 2000
    only, new, _ = iblt.differing([keys], [keys[:500]], 48)[0]
    assert sorted(only) == keys[500:].tolist() and not new


def test_fingerprint_versions(spark):
    rng = random.Random(9)
    rows = corpus(5, 80, most=300) + [(None, "null id", "s", "e"), (5000, "é🙂x", "s", "e"), (5000, "another", "s", "e")]
    got = iblt.fingerprint_versions(make(spark, rows), per_task=rng.choice([7, 9])).collect()
    key = lambda r: (-(1 << 63) if r[0] is None else r[0])
    h = {t: r.h for t, r in ((r.t, r) for r in spark.createDataFrame([((r[1] or ""),) for r in rows], "t string").selectExpr("t", "xxhash64(t) h").collect())}
    order = sorted(rows, key=lambda r: (key(r), h[r[1] or ""]), reverse=True)
    by = {(r.doc_id, r.edited_sha256): r for r in got}
    prints, subtracted = {}, Counter()
    assert len(got) == len(rows)
    for k, (i, t, _, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = by[i, hashlib.sha256(edited.encode()).hexdigest()]
        assert r.n_chars == len(t)
        mine, new, nxt = (Counter(iblt.digests(x.encode()).tolist()) for x in (t, edited, after))
        share = lambda a, b: 1 - sum(((a - b) + (b - a)).values()) / (sum(a.values()) + sum(b.values())) if a or b else 1.0
        assert math.isclose(r.near_edited, share(mine, new)) and math.isclose(r.near_next, share(mine, nxt))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert (r.edited_fingerprint == r.fingerprint) == (mine == new)
        bits = lambda x: {k - (1 << 64) if k >> 63 else k for k in x}
        assert set(r.gone) == bits(mine - new) and set(r.new) == bits(new - mine)
        subtracted[r.cells_edited == 48] += 1
        if r.cells_edited == 48:
            assert iblt.compare_printed(r.fingerprint, r.edited_fingerprint)[2] == r.near_edited
        theirs = iblt.printed([iblt.digests(after.encode())])[0]
        if r.cells_next == 48:
            assert iblt.compare_printed(r.fingerprint, theirs)[2] == r.near_next
        else:
            wide = [iblt.printed([iblt.digests(x.encode())], r.cells_next)[0] for x in (t, after)]
            assert iblt.compare_printed(r.fingerprint, theirs) is None and iblt.compare_printed(*wide)[2] == r.near_next
    assert min(subtracted.values()) > 5
    assert iblt.fingerprint_versions(make(spark, [])).count() == 0
    (one,) = iblt.fingerprint_versions(make(spark, [(1, "abcd", "s", "e")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def test_fingerprints_split_a_hot_identifier(spark):
    """A third of all rows without identifier, and rows that repeat, go to several tasks."""
    rows = [(None, f"text {i} of nobody", "s", "e") for i in range(300)] + [(i, "same", "s", "e") for i in range(300)] + [(7, "twice", "s", "e")] * 2
    df = make(spark, rows)
    got = iblt.fingerprint_versions(df, per_task=20)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 60
    key = spark.createDataFrame([(i, t) for i, t, *_ in rows], "i long, t string").selectExpr("coalesce(i, -9223372036854775808) i", "xxhash64(t) h", "t").collect()
    order = sorted(key, reverse=True)
    want = Counter()
    for k, r in enumerate(order):
        after = order[(k + 1) % len(order)].t
        want[None if r.i == -(1 << 63) else r.i, hashlib.sha256((r.t[: len(r.t) - len(r.t) // 2] + after[: len(r.t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got.collect()) == want


def test_fingerprints_of_odd_rows(spark):
    df = make(spark, [(1, "a b c", 5, 6), (2, "d", 5, 6)], "doc_id long, text string, part int, at int")
    odd = df.withColumn("text", F.expr("if(doc_id = 1, cast(X'6120FF2062' as string), text)"))
    assert {r.doc_id: r.n_chars for r in iblt.fingerprint_versions(odd).collect()} == {1: 5, 2: 1}
    broken = [np.array([5, 5], np.uint64)], [np.array([6], np.uint64)]  # no set: such a difference never peels
    assert iblt.differing(*broken)[0] == ([5], [6], 0)
