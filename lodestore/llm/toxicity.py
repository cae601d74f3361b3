"""Toxicity by a weighted finite-state pattern grammar.

Each token is first read as one symbol of a small alphabet (insult, threat verb,
future or wish marker, target, negation, reporting verb, opening and closing quotation
mark, other) and a lexical weight. A clause then runs through the composition of five
transducers:

reported   marks what follows a reporting verb or stands inside quotation marks
negation   marks what follows a negation within three tokens
target     remembers whether the clause addresses or names somebody
threat     recognises marker ... threat verb ... target
insult     adds the weight of each weighted word, less if marked by the others

A quotation goes on over the clauses of its line until its closing mark; a mark without
a partner in its line is none. A colon after a reporting verb doesn't end the clause.
What the composition accepts is a clause with a weight; a document's score is a
logistic function of its clauses' weights, fitted on labelled rows together with
the insult lexicon's learned part. Learned words keep their grammatical symbols.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import arrow_pass, filter_texts, materialise, text_rows

# Fixed word lists of the grammar (English); insults in other languages are learned.
INSULTS = "idiot moron stupid pathetic worthless disgusting scum trash loser clown fool imbecile vermin filth bastard jerk".split()
THREAT_VERBS = "kill hurt destroy burn crush stab shoot beat punch murder".split()
MARKERS = "will shall gonna going should must i'll we'll".split()
TARGETS = "you your yours yourself he she him her they them their people he's she's you're they're".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't doesn't didn't won't cannot can't".split()
REPORTS = "said says say wrote writes called calls claimed claims quoted quotes told reported according".split()

INSULT, THREAT, MARKER, TARGET, NEGATION, REPORT, OPEN, CLOSE, OTHER = range(9)
SYMBOLS = {w: s for s, words in ((THREAT, THREAT_VERBS), (MARKER, MARKERS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
#: The marks that close what a mark opened.
CLOSERS = {'"': '"', "“": "”\"", "„": "“”\"", "”": "”", "«": "»", "»": "«"}

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Words, quotation marks, line ends, colons and other ends of clauses.
PART = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»]|[\n\r]|:|[.!?;|。！？]")
PREFIXES = (3, 4, 5, 6)
NEGATION_SPAN = 3


@dataclass(frozen=True)
class Gains:
    """Factors on a weight: marked by the reported or the negation transducer, and in
    a clause without or with a target."""

    reported: float = 0.5
    negated: float = 0.4
    targeted: float = 1.5
    threat: float = 4.0


def _reported(state: int, symbol: int) -> tuple[int, bool]:
    """States: 0 direct, 1 after a reporting verb, 2 in quotation marks, 3 both."""
    if symbol in (OPEN, CLOSE):
        return (state | 2 if symbol == OPEN else state & 1), False
    return (state | 1 if symbol == REPORT else state), state > 0


def _negation(state: int, symbol: int) -> tuple[int, bool]:
    """The state counts down the tokens that a negation still reaches."""
    return (NEGATION_SPAN if symbol == NEGATION else max(0, state - 1)), state > 0


def _target(state: int, symbol: int) -> int:
    return int(state or symbol == TARGET)


def _threat(state: int, symbol: int) -> int:
    """0 nothing, 1 a marker seen, 2 a threat verb after it, 3 a target after that."""
    if state == 2 and symbol == TARGET:
        return 3
    return max(state, 1 if symbol == MARKER else 2 if symbol == THREAT and state else 0)


def compose(gains: Gains) -> tuple[dict, dict]:
    """The composed machine over its reachable states, of the start states of a clause
    outside and inside a quotation.

    ``arcs[state, symbol] = (next, factor)``: ``factor`` times the token's lexical
    weight is added; ``finals[state] = (factor, bonus)``: what the clause's sum is
    multiplied by, and what a completed threat adds, less if its verb was marked.
    """
    arcs, finals, open_ = {}, {}, [_start(False), _start(True)]
    while open_:
        state = open_.pop()
        if state in finals:
            continue
        rep, neg, tar, thr, strength = state
        finals[state] = (gains.targeted if tar else 1.0, gains.threat * strength if thr == 3 else 0.0)
        for symbol in range(9):
            rep2, is_reported = _reported(rep, symbol)
            neg2, is_negated = _negation(neg, symbol)
            factor = (gains.reported if is_reported else 1.0) * (gains.negated if is_negated else 1.0)
            thr2 = _threat(thr, symbol)
            after = (rep2, neg2, _target(tar, symbol), thr2, factor if thr2 == 2 and thr < 2 else strength)
            arcs[state, symbol] = (after, factor)
            open_.append(after)
    return arcs, finals


def _start(quoted: bool) -> tuple:
    return (2 if quoted else 0, 0, 0, 0, 1.0)


def quotations(parts: list[str]) -> dict[int, int]:
    """Which parts open and close a quotation: a mark opens one if a mark that closes it
    follows in its line; others inside it are none."""
    out: dict[int, int] = {}
    line: list[int] = []
    for i, part in enumerate([*parts, "\n"]):
        if part in CLOSERS:
            line.append(i)
        elif part in "\n\r" and line:
            k = 0
            while k < len(line):
                close = next((j for j in range(k + 1, len(line)) if parts[line[j]] in CLOSERS[parts[line[k]]]), None)
                if close is not None:
                    out[line[k]], out[line[close]] = OPEN, CLOSE
                    k = close
                k += 1
            line = []
    return out


@dataclass
class Grammar:
    """The lexicon's weights, by whole word or by ``prefix*``, and the fitted logistic."""

    weights: dict[str, float] = field(default_factory=lambda: {w: 5.0 for w in INSULTS})
    bias: float = -4.0
    slope: float = 3.0
    gains: Gains = Gains()

    def __post_init__(self) -> None:
        self.arcs, self.finals = compose(self.gains)
        self._known: dict[str, tuple[int, float]] = {}

    def read(self, word: str) -> tuple[int, float]:
        """A word's symbol and lexical weight."""
        got = self._known.get(word)
        if got is None:
            if len(self._known) > 100_000:
                self._known.clear()
            weight = max([self.weights.get(word, 0.0), *(self.weights.get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) > k)])
            symbol = SYMBOLS.get(word.replace("’", "'"), INSULT if weight > 0 else OTHER)
            got = self._known[word] = (symbol, weight)
        return got

    def clauses(self, text: str) -> list[float]:
        """The weights of the clauses that the grammar accepts with a weight above 0."""
        parts = PART.findall(text.lower())
        if not any(weight > 0 or symbol == THREAT for symbol, weight in map(self.read, {w for w in set(parts) if w[0].isalpha()})):
            return []
        marks = quotations(parts) if not CLOSERS.keys().isdisjoint(parts) else {}
        found, state, total = [], _start(False), 0.0
        arcs, known, read = self.arcs, self._known, self.read
        for i, part in enumerate([*parts, "\n"]):
            if part[0].isalpha():
                symbol, weight = known.get(part) or read(part)
                state, factor = arcs[state, symbol]
                if weight:
                    total += factor * weight
            elif part in CLOSERS:
                if i in marks:
                    state = arcs[state, marks[i]][0]
            elif part != ":" or not state[0] & 1:  # the end of a clause
                factor, bonus = self.finals[state]
                if total * factor + bonus > 0:
                    found.append(total * factor + bonus)
                state, total = _start(state[0] & 2 and part not in "\n\r"), 0.0
        return found

    def feature(self, text: str) -> float:
        """The log of one plus the clauses' total weight."""
        return math.log1p(math.fsum(self.clauses(text)))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * self.feature(text)))))


def terms(text: str) -> set[str]:
    """The words of a text and their proper prefixes, as lexicon keys."""
    words = set(TOKEN.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def learn(docs: DataFrame, labels: DataFrame, sample: int = 10_000, least: int = 5, share: float = 0.02, strength: float = 3.0, size: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """A grammar whose lexicon and logistic are fitted on ``labels (doc_id, label)``.

    At most ``sample`` labelled rows are used, those with the smallest hash of their
    identifier, a fixed bound on what a fit needs; scoring covers all rows. A term
    enters the lexicon if at least ``least`` toxic rows and a ``share`` of them hold
    it, so that the words of one copied text don't, and the log of the ratio of its
    smoothed shares among toxic and other rows is over ``strength``; the ``size``
    strongest stay, so the model's size is bounded. Rows whose identifier or
    label is null are left out, a repeated identifier counts once with its largest
    label; without both labels the hand-set grammar is returned.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("label").cast("int").alias("label")).where("i is not null and label in (0, 1)")
    ids = ids.groupBy("i").agg(F.max("label").alias("label")).orderBy(F.xxhash64("i"), "i").limit(sample)
    texts = docs.select(*text_rows(id_col, text_col))
    rows = texts.join(F.broadcast(ids), texts.doc_id == ids.i).select(F.col("text").cast("string").alias("text"), "label")
    rows = materialise(rows, "labelled")
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Grammar()
    schema = pa.schema([("term", pa.string()), ("yes", pa.int64()), ("no", pa.int64())])

    def counts(among: set[str] | None):
        def count(batches: Iterator[dict]) -> Iterator[dict]:
            yes, no = Counter(), Counter()
            for b in batches:
                for t, label in zip(b["text"].to_pylist(), b["label"].to_pylist()):
                    (yes if label else no).update(terms(t) if among is None else terms(t) & among)
            keys = list(yes | no)
            yield {"term": keys, "yes": [yes[k] for k in keys], "no": [no[k] for k in keys]}

        return arrow_pass(count, schema)

    # Only terms of toxic rows can enter, so the other rows are counted for these alone.
    seen = rows.where("label = 1").mapInArrow(counts(None), "term string, yes long, no long")
    chosen = seen.groupBy("term").agg(F.sum("yes").alias("yes")).where(F.col("yes") >= max(least, math.ceil(share * totals[1])))
    among = {r.term: r.yes for r in chosen.toLocalIterator()}  # bounded by the sample
    against = rows.where("label = 0").mapInArrow(counts(set(among)), "term string, yes long, no long")
    no = {r.term: r.no for r in against.groupBy("term").agg(F.sum("no").alias("no")).toLocalIterator()}
    logs = {t: math.log((k + 0.5) / (totals[1] + 1)) - math.log((no.get(t, 0) + 0.5) / (totals[0] + 1)) for t, k in among.items()}
    best = sorted((-w, t) for t, w in logs.items() if w > strength)[:size]
    lexicon = {w: 5.0 for w in INSULTS} | {t: -w for w, t in best}
    grammar = Grammar(lexicon)
    weights = dict(grammar.weights)
    out = pa.schema([("x", pa.float64()), ("label", pa.int32())])

    def points(batches: Iterator[dict]) -> Iterator[dict]:
        own = Grammar(weights)
        for b in batches:
            yield {"x": [own.feature(t) for t in b["text"].to_pylist()], "label": b["label"]}

    # At most ``sample`` points, grouped so that only distinct ones travel.
    grouped = rows.mapInArrow(arrow_pass(points, out), "x double, label int").groupBy("x", "label").agg(F.count("*").alias("n"))
    data = np.array(sorted((r.x, r.label, r.n) for r in grouped.collect()))
    return Grammar(lexicon, *fit_logistic(data[:, 0], data[:, 1], data[:, 2]))


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05, steps: int = 100) -> tuple[float, float]:
    """Bias and slope (at least 0) of a ridge-penalised logistic, by damped Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6, ridge])

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float(n @ (np.logaddexp(0, z) - y * z) + beta @ penalty @ beta / 2)

    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (n * (p - y)) + penalty @ beta
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + penalty
        step, part = np.linalg.solve(curve, slope), 1.0
        while part > 1e-6 and loss(beta - part * step) > loss(beta):
            part /= 2
        beta = beta - part * step
        if np.abs(part * step).max() < 1e-9:
            break
    if beta[1] < 0:
        share = float(n @ y / n.sum())
        return math.log(share / (1 - share)), 0.0
    return float(beta[0]), float(beta[1])


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every whole text, however long; clauses of equal weight
    count alike. Null and empty texts have no clause and get the score of none; null
    identifiers and repeated rows stay as they are; invalid UTF-8 is replaced by U+FFFD;
    an empty table gives an empty result; extra columns are ignored."""
    made = (dict(grammar.weights), grammar.bias, grammar.slope, grammar.gains)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own = Grammar(*made)
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": [own.score(t.as_py().decode()) for t in b["text"]]}

    return docs.select(*text_rows(id_col, text_col)).mapInArrow(arrow_pass(run, schema), "doc_id long, score double")


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents that score under ``threshold``, with all their columns and values as
    they are; texts are read as ``score_documents`` does."""
    made = (dict(grammar.weights), grammar.bias, grammar.slope, grammar.gains)

    def make():
        own = Grammar(*made)
        return lambda text: own.score(text.decode("utf-8", "replace")) < threshold

    return filter_texts(docs, text_col, make)
