"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

A text is its sentences (ended by . ! ? or a line feed), a sentence its terms: lower-cased words (without outer punctuation), their letters
alone if something else stands between them, joined runs of three or more single letters, and in scripts without blanks all pairs and triples of
characters. The kernel of two terms compares all subsequences of four characters that span at most seven positions, each
weighted by DECAY to the power of its span, and divides by the norm that a term of that length has; so inserted characters
and gaps only lower a match. Terms of under four characters take their two ends in as characters, so words of any length and script have
subsequences. Subsequences are counted under hashes of BITS bits of their characters; digits are one character and so are all other signs.

Training is multiple-instance: sentences carry their document's label, and only the terms that speak
for a toxic text are positive (`witnesses`); terms of clean sentences are negative, the hardest are added each round, and copies of positive
terms with an inserted character make gaps familiar. Landmarks are positive and negative terms far from each other; the machine is linear in
their Nystroem features. As these are linear in the subsequence weights, the whole decision function folds into one
table of subsequences, and scoring is a gather and a sum. A sentence has the value of its most toxic term; a text is judged by its three
most toxic sentences and how many there are, through logistic curves fitted to the training texts.

Learned from at most `max_rows` labelled documents (those with the smallest hashes of their ids); the sizes of the training problem (BOUNDS) bound what
the driver holds and nothing that is scored. A null or empty text has no terms and
gets the lowest score. Null ids and labels are not learned from, an id labelled twice counts once (the larger label); without both kinds of
labels every score is 0. Very long texts are read whole; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, prepare
from .quality import sampled_labels

MAX_ROWS, FOLDS, THRESHOLD = 3_000, 5, 0.5
ORDER, DECAY, SPAN, BITS, LONGEST = 4, 0.6, 7, 21, 24
LANDMARKS, ROUNDS = 128, 4
#: The training problem: positive terms, common and drawn terms of clean texts, hard terms added a round, hard terms that landmarks are chosen from, gapped copies.
BOUNDS = {"positive": 1_500, "common": 1_000, "drawn": 4_000, "hard": 800, "marks": 2_000, "gapped": 600}
#: Decision value of a sentence without terms.
FLOOR = -4.0
OUTER = ".,;:!?\"'()[]{}<>|*%$&#~_-+=/\\"
#: Ends of a short term, and what ends a sentence beside the marks.
OPEN, CLOSE, BREAK = "\x02", "\x03", "\x00"
_SINGLE = re.compile(r"(?<!\S)(?:[^\W_]\s+){2,}[^\W_](?!\S)")
#: Scripts that are written without blanks.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_MARKS = (".", "!", "?", "\u3002", "\uff01", "\uff1f")
MOST_TERMS = 400_000


def padded(w: str) -> str:
    """A term as its subsequences see it: short ones with their ends, five characters in all."""
    return w if len(w) >= ORDER else OPEN * (ORDER - len(w)) + w + CLOSE


def terms_of(token: str) -> list[str]:
    """The terms of a lower-cased run of characters without blanks."""
    bare = token.strip(OUTER)
    found = {bare}
    if not bare.isalpha():
        found.add("".join(filter(str.isalpha, bare)))
    for run in _UNSPACED.findall(bare):
        found.update(run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1))
    for w in [w for w in found if len(w) > LONGEST]:
        found.remove(w)
        found.update(w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2))
    return sorted(padded(w) for w in found if w)


def tokens(text: str | None) -> list[str]:
    """Runs of characters without blanks, BREAK for line feeds; joined single letters come last, as a sentence of their own."""
    if not text:
        return []
    low = text.lower()
    out = low.replace(BREAK, " ").replace("\n", f" {BREAK} ").split()
    spaced = ["".join(m[0].split()) for m in _SINGLE.finditer(low)]
    return [*out, BREAK, *spaced] if spaced else out


def ends(token: str) -> bool:
    return token == BREAK or token.rstrip("\"')]}\u00bb\u201d").endswith(_MARKS)


def sentences(text: str | None) -> list[set[str]]:
    """The terms of every sentence of a whole text that has any."""
    out: list[set[str]] = [set()]
    for t in tokens(text):
        if t != BREAK:
            out[-1].update(terms_of(t))
        if ends(t):
            out.append(set())
    return [x for x in out if x]


def terms(text: str | None) -> set[str]:
    """The terms of a whole text."""
    return set().union(*sentences(text))


def code(c: str) -> int:
    return 1 if c.isdigit() else ord(c) + 8 if c.isalpha() or c in (OPEN, CLOSE) else 2


#: Odd multipliers of the positions of a subsequence.
_ODD = np.random.default_rng(44).integers(0, 2**63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=64)
def shape(n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Positions and weights of all subsequences of ORDER characters in a term of n characters, and their norm."""
    t = np.array([(i, *rest) for i in range(n) for rest in combinations(range(i + 1, min(n, i + SPAN)), ORDER - 1)])
    w = DECAY ** (t[:, -1] - t[:, 0] + 1.0)
    return t, w, float(np.sqrt((w**2).sum()))


def by_length(words: list[str]):
    """(indices, subsequence numbers, weights / norm) for the terms of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths[lengths >= ORDER]):
        at = np.flatnonzero(lengths == n)
        for part in np.array_split(at, max(1, len(at) * 250 // 500_000)):
            c = np.array([[code(x) for x in words[i]] for i in part.tolist()], np.uint64)
            t, w, norm = shape(int(n))
            ids = np.zeros((len(part), len(t)), np.uint64)
            for k in range(ORDER):
                ids += (c * _ODD[k])[:, t[:, k]]
            ids ^= ids >> np.uint64(29)
            ids *= np.uint64(0x9E3779B97F4A7C15)
            yield part, (ids >> np.uint64(64 - BITS)).astype(np.int64), w / norm


def against(words: list[str], table: np.ndarray) -> np.ndarray:
    """Inner products of the terms with a vector over all subsequences."""
    out = np.zeros(len(words))
    for at, ids, w in by_length(words):
        out[at] = table[ids] @ w
    return out


def vector(word: str) -> np.ndarray:
    v = np.zeros(1 << BITS)
    for _, ids, w in by_length([word]):
        np.add.at(v, ids[0], w)
    return v


def far_apart(words: list[str], most: int, like: float = 0.7) -> list[str]:
    """The first `most` terms, in the order given, that are not much alike any chosen before."""
    chosen, nearest = [], np.zeros(len(words))
    for k, w in enumerate(words):
        if nearest[k] < like:
            chosen.append(w)
            if len(chosen) == most:
                break
            nearest = np.maximum(nearest, against(words, vector(w)))
    return chosen


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 100.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active rows (y is -1 or 1)."""
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.ones(x.shape[1]), 1e-3)
    loss = lambda v: 0.5 * (ridge * v * v).sum() + c * (weight * np.maximum(0, 1 - y * (z @ v)) ** 2).sum()
    for _ in range(40):
        on = y * (z @ w) < 1
        a, s = z[on], 2 * c * weight[on]
        step = np.linalg.solve(np.diag(ridge) + (a * s[:, None]).T @ a, -(ridge * w - (s * y[on] * (1 - y[on] * (a @ w))) @ a))
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        if np.abs(size * step).max() < 1e-6:
            break
        w = w + size * step
    return w[:-1], float(w[-1])


def summary(margins: np.ndarray) -> list[float]:
    """What a text's sentences amount to: the three highest decision values, how many are positive and how many there are."""
    top = np.sort(margins)[::-1][:3].tolist()
    return [*top, *[FLOOR] * (3 - len(top)), float(np.log1p((margins > 0).sum())), float(np.log1p(len(margins)))]


class Machine:
    """table: decision weight of every subsequence; bias; curves: weights of a text's summary and of its highest value alone; landmarks for the record."""

    def __init__(self, table: np.ndarray, bias: float, landmarks: tuple = ()):
        self.table, self.bias, self.landmarks = table, bias, landmarks
        self.curves = [np.array([0.0] * 5 + [-50.0])] * 2

    def margins(self, words: list[str]) -> np.ndarray:
        return against(words, self.table) + self.bias

    def scores(self, summaries: np.ndarray) -> np.ndarray:
        """Several weak terms or a single clear one make a text toxic: the higher of both probabilities."""
        z = np.hstack([summaries, np.ones((len(summaries), 1))])
        return np.max([1 / (1 + np.exp(-np.clip(z @ w, -60, 60))) for w in self.curves], axis=0)


def logistic(z: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    return w


def nystroem(positive: list[str], negative: list[str], noisy: list[str], weights: dict[str, float]) -> Machine:
    """A machine on landmarks of both kinds, the hardest negative terms (by weight) first."""
    hardest = sorted(negative, key=lambda w: (-weights.get(w, 1.0), w))
    marks = [*far_apart(positive, LANDMARKS // 2), *far_apart(hardest[: BOUNDS["marks"]], LANDMARKS // 2)]
    words = [*marks, *positive, *noisy, *negative]
    rows = np.stack([against(words, vector(m)) for m in marks], axis=1)
    kernel = rows[: len(marks)]
    values, basis = np.linalg.eigh((kernel + kernel.T) / 2)
    good = values > 1e-6 * values.max()
    root = basis[:, good] / np.sqrt(values[good])  # kernel row -> Nystroem features
    x = rows[len(marks) :] @ root
    y = np.array([1.0] * (len(positive) + len(noisy)) + [-1.0] * len(negative))
    weight = np.concatenate([np.full(len(positive), 1.0 / max(1, len(positive))), np.full(len(noisy), 0.5 / max(1, len(noisy))), np.array([weights.get(w, 1.0) for w in negative]) * 3.0 / max(1, len(negative))]) * 200
    w, b = svm(x, y, weight)
    table = np.zeros(1 << BITS)
    for share, m in zip((root @ w).tolist(), marks, strict=True):
        table += share * vector(m)
    return Machine(table.astype(np.float32), b, landmarks=tuple(marks))


def grams(word: str) -> set[str]:
    w = "^" + word
    return {w[i : i + n] for n in (3, 4, 5, 6) for i in range(len(w) - n + 1)}


def witnesses(toxic: list[tuple], clean: list[tuple]) -> list[str]:
    """Terms that speak for toxic texts: those with a piece from a greedy cover of the toxic texts by pieces that are rare in clean texts.

    Each round takes the piece that explains most toxic texts not yet explained, less its share of clean texts; so the other words of
    copied toxic texts explain nothing.
    """
    pieces: dict[str, frozenset] = {w: frozenset(grams(w)) for w in sorted({w for t in toxic for w in t})}
    own = [frozenset().union(*(pieces[w] for w in t)) for t in toxic]
    least = max(2, round(0.008 * len(toxic)))
    seen = {g for g, n in Counter(g for t in own for g in t).items() if n >= least}
    own = [t & seen for t in own]
    pieces = {w: g & seen for w, g in pieces.items()}
    of_clean: dict[str, frozenset] = {}
    bad = Counter()
    for t in clean:
        for w in t:
            if w not in of_clean:
                of_clean[w] = frozenset(seen.intersection(grams(w)))
        bad.update(frozenset().union(*(of_clean[w] for w in t)))
    cost = 2 * len(toxic) / len(clean)
    holders: dict[str, set] = {g: set() for g in seen}
    for k, t in enumerate(own):
        for g in seen.intersection(t):
            holders[g].add(k)
    # Pieces of many toxic texts and hardly any clean one speak for themselves, explained already or not.
    chosen = {g for g in seen if len(holders[g]) >= max(least, 0.04 * len(toxic)) and 20 * cost * bad[g] <= len(holders[g])}
    for _ in range(200):
        value = {g: v for g, h in holders.items() if (v := len(h) - cost * bad[g]) >= least}
        if not value:
            break
        best = max(value, key=lambda g: (value[g], -len(g), g))
        chosen.add(best)
        done = holders[best]
        holders = {g: holders[g] - done for g in value}
    in_toxic, in_clean = Counter(w for t in toxic for w in t), Counter(w for t in clean for w in t)
    found = [w for w, g in pieces.items() if not g.isdisjoint(chosen) and in_clean[w] <= in_toxic[w]]
    return sorted(found, key=lambda w: (-in_toxic[w], w))


def fit(texts: list[tuple[int, list[tuple[str, ...]]]], seed: int = 4) -> Machine:
    """texts: (label, terms of each sentence of one labelled text)."""
    texts = sorted({(y, tuple(sorted(t))) for y, t in texts})  # copies count once
    every_term = [(y, sorted(set().union(*t))) for y, t in texts]
    toxic, clean = [t for y, t in every_term if y], [t for y, t in every_term if not y]
    if not toxic or not clean:
        return Machine(np.zeros(1 << BITS), 0.0)
    rng = np.random.default_rng(seed)
    in_toxic, in_clean = Counter(w for t in toxic for w in t), Counter(w for t in clean for w in t)
    positive = witnesses(toxic, clean)[: BOUNDS["positive"]]
    if not positive:
        return Machine(np.zeros(1 << BITS), 0.0)
    common = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))[: BOUNDS["common"]]]
    every = sorted(in_clean)
    negative = [*common, *(every[i] for i in rng.choice(len(every), min(BOUNDS["drawn"], len(every)), replace=False))]
    letters = "abcdefghijklmnopqrstuvwxyz.*-_1"
    noisy = []
    for w in [w for w in positive if w[0] != OPEN][: BOUNDS["gapped"]]:  # a short word with another letter is another word
        k = int(rng.integers(1, len(w)))
        noisy.append(w[:k] + letters[int(rng.integers(len(letters)))] + w[k:])
    noisy = [w for w in noisy if len(w) <= LONGEST]
    weights: dict[str, float] = {}
    for _ in range(ROUNDS):
        m = nystroem(positive, negative, noisy, weights)
        hard = m.margins(every)
        worst = [int(i) for i in np.argsort(-hard, kind="stable")[: BOUNDS["hard"]]]
        negative = list(dict.fromkeys([*negative, *(every[i] for i in worst)]))
        weights.update({every[i]: 4 * weights.get(every[i], 1.0) for i in worst if hard[i] > -0.5})
        # Terms of few toxic texts that look like clean ones were no witnesses.
        own = m.margins(positive)
        positive = [w for w, v in zip(positive, own.tolist(), strict=True) if v > 0 or in_toxic[w] > 2] or positive
    m = nystroem(positive, negative, noisy, weights)
    words = sorted(set(in_toxic) | set(in_clean))
    of = dict(zip(words, m.margins(words).tolist(), strict=True))
    x = np.array([summary(np.array([max(map(of.__getitem__, w)) for w in t])) for _, t in texts])
    y = np.array([float(t[0]) for t in texts])
    z = np.hstack([x, np.ones((len(x), 1))])
    alone = [0, 5]
    m.curves = [logistic(z, y), np.zeros(6)]
    # A single clear term: what witnesses and their gapped copies reach, against the highest values of clean texts.
    one = np.concatenate([m.margins(positive), m.margins(noisy), np.tile(x[y == 0, 0], 3)])
    m.curves[1][alone] = logistic(np.stack([one, np.ones(len(one))], axis=1), (np.arange(len(one)) < len(positive) + len(noisy)).astype(float), 1e-2)
    return m


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = FOLDS) -> Machine:
    prepare(docs.sparkSession)
    sample = sampled_labels(labels, "toxic", max_rows, folds)

    def run(batches):
        for b in batches:
            told = ["\n".join(" ".join(sorted(x)) for x in sentences(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(told, pa.string())], ["label", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "label").mapInArrow(run, "label int, terms string").toPandas()
    return fit([(int(y), [tuple(sys.intern(w) for w in x.split(" ")) for x in t.split("\n") if x]) for y, t in zip(rows["label"], rows["terms"], strict=True)])


class Scorer:
    """A machine with the tokens it has seen: decision value, best term and whether it ends a sentence, for each."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.clear()

    def clear(self) -> None:
        self.number, self.value, self.ends, self.best = {}, np.empty(0), np.empty(0, bool), []

    def learn(self, new: list[str]) -> None:
        own = [terms_of(t) if t != BREAK else [] for t in new]
        words = sorted(set().union(*own)) if own else []
        of = dict(zip(words, self.machine.margins(words).tolist(), strict=True))
        best = [max(t, key=lambda w: (of[w], w), default=None) for t in own]
        self.number.update(zip(new, range(len(self.best), len(self.best) + len(new)), strict=True))
        self.best += best
        self.value = np.append(self.value, [-np.inf if w is None else of[w] for w in best])
        self.ends = np.append(self.ends, np.fromiter(map(ends, new), bool, len(new)))

    def summaries(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """(summary, deciding term) of each text."""
        said = [tokens(t) for t in texts]
        if len(self.number) > MOST_TERMS:
            self.clear()
        self.learn(sorted(set().union(*said).difference(self.number)) if said else [])
        out, deciding = [], []
        for t in said:
            at = np.fromiter(map(self.number.__getitem__, t), np.int64, len(t))
            if not len(at):
                out.append(summary(np.empty(0)))
                deciding.append(None)
                continue
            values, last = self.value[at], self.ends[at]
            starts = np.concatenate(([0], np.flatnonzero(last[:-1]) + 1))
            of_sentence = np.maximum.reduceat(values, starts)
            out.append(summary(of_sentence[of_sentence > -np.inf]))
            term = self.best[int(at[int(values.argmax())])]
            deciding.append(None if term is None else term.strip(OPEN + CLOSE))
        return np.array(out, float).reshape(-1, 5), deciding


def score(docs: DataFrame, machine: Machine, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the term that decided, in the pass over the documents."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(machine)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            found, best = scorer.summaries(b.column(1).to_pylist())
            s = scorer.machine.scores(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(best, pa.string())], ["doc_id", "held_out", "score", "predicted", "term"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(folds).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, term string")
