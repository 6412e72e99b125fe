"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

Voters look at a text's words. Lexicon voters hold words, stem voters beginnings of words: features which labelled
texts show to tell toxic from clean, dealt over several voters of a kind; a voter says toxic (+1) if one of its strong features is
there, clean (-1) if not even a weak one is, and abstains (0) between. Pattern voters hold regular expressions for
insults and say toxic or abstain. That is all that labels do: choose voters, and give the share of toxic texts.

The label model is generative: a hidden class and, for each voter and class, the probabilities of its three votes, fitted by
expectation maximisation to the votes on a bounded sample of documents whose labels it doesn't see, from the majority of
votes on. Voters that agree beyond what the class explains are correlated, and share their weight.
Its posteriors are what the classifier learns: a logistic regression over words and stems
with an L1 penalty, so that few features have weights, and scoring only looks words up.

Bounds: SAMPLE rows of each label, UNLABELLED documents, and the bytes of sample.SAMPLE_BYTES each; the bias is moved from the sample's
mean posterior to the share of label 1 among all labelled rows outside the held-out fold.

Defined cases: null and empty texts score by the bias alone; texts of any length are read whole; rows that
repeat score alike; without labels of both kinds, every score is the share of label 1 (0.5 if there are none);
an empty table gives an empty result; other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellara.llm.common import ship, table
from stellara.llm.sample import held_out, labelled, unlabelled

FOLDS, FOLD = 4, 2
#: Rows of label 0 and of label 1 to fit on, at most.
SAMPLE = (3000, 1500)
#: Documents whose votes the label model is fitted to, at most.
UNLABELLED = 4000
STEMS = (4, 5, 6, 7)
TIMES = (2, 4, 8)
VOTERS, PER_VOTER = 8, 12
LEAST_TEXTS, LEAST_ODDS, VOTER_G, FEATURE_G = 4, 3.0, 20.0, 12.0
WEAK_ODDS, WEAK_G = 1.0, 10.0
#: Rounds of fitting; what a vote's probabilities are worth before any text, in texts of a class.
ROUNDS, PRIOR = 50, 10.0
STEPS, PENALTY = 250, 0.01
THRESHOLD = 0.3
MAX_WORDS = 500_000

WORD = re.compile(r"\w+")
#: Insults in common use, and how they are put.
INSULTS = "idiot moron stupid trash scum loser clown pathetic worthless disgusting dumb fool jerk hate ugly garbage filth vermin".split()
PATTERNS = (r"\b(?:you|he|she|they|it) (?:are|is|was|were)? ?(?:an? )?(?:such )?(?:{insults})\b", r"\b(?:{insults})[!?]+", r"\b(?:{insults})(?:s|es)?\b.{{0,80}}\b(?:{insults})(?:s|es)?\b")


def features(word: str) -> tuple[str, ...]:
    """A word and its stems; stems end with a star."""
    return (word, *(word[:n] + "*" for n in STEMS if len(word) > n))


def counted(found: Iterable[tuple[str, ...]]) -> set[str]:
    """Features of a text from those of its words; what 2, 4 or 8 words or more share is told apart."""
    n = Counter(f for own in found for f in own)
    out = set(n)
    for f, c in n.items():
        out.update(f"{f}{k}" for k in TIMES if c >= k)
    return out


def marked(text: str) -> tuple[list[str], np.ndarray]:
    """A text's words and stems, and the hash of each; a stem comes as often as words have it."""
    words = set(WORD.findall(text.lower()))
    found = [*words, *(w[:n] + "*" for w in words for n in STEMS if len(w) > n)]
    return found, np.fromiter(map(hash, found), np.int64, len(found))


def repeated(mark: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the features that say that k words or more have a stem."""
    return mark + np.array(k) * np.array(0x1E3779B97F4A7C15)


class Bags:
    """Features of texts, numbered: entry k says that text row[k] has feature column[k].

    What fewer than LEAST_TEXTS texts have is left out. Features are hashes of 64 bits; names are looked up for those that are asked for.
    """

    def __init__(self, texts: list[str]):
        self.texts, self.n = texts, len(texts)
        parts = []
        for t in texts:
            own, count = np.unique(marked(t)[1], return_counts=True)
            parts.append(np.concatenate([own, *(repeated(own[count >= k], k) for k in TIMES)]))
        keys, column, count = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_inverse=True, return_counts=True)
        often = count >= LEAST_TEXTS
        kept = often[column]
        self.keys = keys[often]
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(p) for p in parts])[kept]
        self.column = (np.cumsum(often, dtype=np.int32) - 1)[column[kept]]

    def names(self, chosen: np.ndarray) -> dict[str, int]:
        """The chosen features by name."""
        bases: dict[int, list[tuple[int, int]]] = {}
        for k in (0, *TIMES):
            for i, base in zip(chosen.tolist(), repeated(self.keys[chosen], -k).tolist(), strict=True):
                bases.setdefault(base, []).append((i, k))
        out: dict[str, int] = {}
        for t in self.texts:
            if len(out) == len(chosen):
                break
            found, mark = marked(t)
            for f, h in zip(found, mark.tolist(), strict=True):
                if h in bases:
                    out.update((f"{f}{k or ''}", i) for i, k in bases.pop(h))
        return out

    def telling(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log odds, G statistic) of each feature in the first len(y) texts: how far labels depend on it. 0 for a feature of too few."""
        end = int(np.searchsorted(self.row, len(y)))
        row, column = self.row[:end], self.column[:end]
        on, size = y > 0.5, len(self.keys)
        c, d = np.bincount(column[on[row]], minlength=size).astype(float), np.bincount(column[~on[row]], minlength=size).astype(float)
        n1 = max(float(on.sum()), 1.0)
        n0 = max(len(y) - n1, 1.0)
        share = (c + d) / (n1 + n0)
        g = np.zeros(size)
        for k, e in ((c, n1 * share), (d, n0 * share), (n1 - c, n1 * (1 - share)), (n0 - d, n0 * (1 - share))):
            some = (k > 0) & (e > 0)
            g[some] += 2 * k[some] * np.log(k[some] / e[some])
        odds = np.log((c + 0.5) / (n1 + 1)) - np.log((d + 0.5) / (n0 + 1))
        few = c + d < LEAST_TEXTS
        odds[few] = g[few] = 0
        return odds, g

    def have(self, chosen: np.ndarray) -> np.ndarray:
        """Which texts have one of the chosen features."""
        mark = np.zeros(len(self.keys), bool)
        mark[chosen] = True
        out = np.zeros(self.n, bool)
        out[self.row[mark[self.column]]] = True
        return out


def voters(bags: Bags, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(strong features, weak features, whether it may say clean) of lexicon and stem voters: the most telling of each kind, dealt in turn."""
    odds, g = bags.telling(y)
    number = bags.names(np.flatnonzero((odds >= WEAK_ODDS) & (g >= WEAK_G)))
    out = [(np.array([number[w] for w in INSULTS[i::3] if w in number], int), np.zeros(0, int), False) for i in range(3)]
    for stems in (False, True):
        kind = [i for f, i in sorted(number.items(), key=lambda x: (-g[x[1]], x[0])) if ("*" in f) == stems]
        strong = [i for i in kind if odds[i] >= LEAST_ODDS and g[i] >= VOTER_G][: VOTERS * PER_VOTER]
        weak = [i for i in kind if i not in set(strong)]
        out += [(np.array(strong[i::VOTERS], int), np.array(weak[i::VOTERS], int), True) for i in range(VOTERS) if strong[i::VOTERS]]
    return out


def votes(texts: list[str], bags: Bags, held: list[tuple[np.ndarray, np.ndarray, bool]]) -> np.ndarray:
    """A row of 1 (toxic), 0 and -1 (clean) for each text."""
    patterns = [re.compile(p.format(insults="|".join(INSULTS)), re.S) for p in PATTERNS]
    out = np.zeros((len(texts), len(held) + len(patterns)), dtype=np.int8)
    for j, (strong, weak, may) in enumerate(held):
        says = bags.have(strong)
        out[:, j] = np.where(says, 1, np.where(may & ~says & ~bags.have(weak), -1, 0))
    for i, t in enumerate(texts):
        low = t.lower()
        if any(w in low for w in INSULTS):
            out[i, len(held) :] = [bool(p.search(low)) for p in patterns]
    return out


def label_model(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of votes: the posterior of toxic for each; each voter's probabilities of -1, 0, 1 by class (2, voters, 3);
    and the correlations of voters within a class. No label takes part: the classes begin as the majority of votes."""
    n, m = v.shape
    is_ = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(np.float64)
    # before any text: a voter abstains or is right more often than it is wrong
    prior = PRIOR * np.array([[[0.5, 0.45, 0.05]], [[0.15, 0.45, 0.4]]]) * np.ones((2, m, 1))
    plus, minus = (v > 0).sum(axis=1), (v < 0).sum(axis=1)
    post = np.where((plus >= 2) | (plus > minus), 0.9, 0.1)
    for _ in range(ROUNDS):
        weight = np.stack([1 - post, post])
        share = (post.sum() + 1) / (n + 2)
        p = np.einsum("cn,nmx->cmx", weight, is_) + prior
        p /= p.sum(axis=2, keepdims=True)
        mean = p[:, :, 2] - p[:, :, 0]
        rest = v - weight.T @ mean
        scale = np.sqrt((rest * rest).mean(axis=0)) + 1e-6
        together = (rest.T @ rest / max(n, 1)) / np.outer(scale, scale)
        np.fill_diagonal(together, 0)
        w = 1 / (1 + np.where(together > 0.1, together, 0).sum(axis=1))
        z = math.log(share / (1 - share)) + np.einsum("nmx,mx,m->n", is_, np.log(p[1] / p[0]), w)
        now = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(now - post).max(initial=0) < 1e-4
        post = now
        if done:
            break
    return post, p, together


def logistic(bags: Bags, target: np.ndarray) -> tuple[dict[str, float], float]:
    """Weights and bias by proximal AdaGrad over all rows at once; soft targets, telling features only."""
    found = sorted(bags.names(np.flatnonzero(bags.telling(target)[1] >= FEATURE_G)).items())
    number = {f: k for k, (f, _) in enumerate(found)}
    place = np.full(len(bags.keys), -1)
    place[[i for _, i in found]] = np.arange(len(found))
    known = place[bags.column] >= 0
    row, column, n = bags.row[known], place[bags.column[known]], bags.n
    w, square, bias, bias_square = np.zeros(len(number)), np.full(len(number), 1e-8), float(np.log(target.mean() / (1 - target.mean()))), 1e-8
    for _ in range(STEPS):
        z = np.bincount(row, w[column], n) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.bincount(column, g[row], len(number))
        square += grad * grad
        rate = 0.3 / np.sqrt(square)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY / math.sqrt(n), 0)
        bias_square += g.sum() ** 2
        bias -= 0.1 * g.sum() / math.sqrt(bias_square)
    return {f: float(w[i]) for f, i in number.items() if w[i]}, bias


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, fold: int = FOLD, sample: tuple[int, int] = SAMPLE, more: int = UNLABELLED) -> tuple[dict[str, float], float]:
    texts, y, odds = labelled(docs, labels, label, folds, fold, sample)
    if not 0 < y.sum() < len(y):
        return {}, odds
    return fit(texts, y, odds, unlabelled(docs, folds, fold, more))


def fit(texts: list[str], y: np.ndarray, odds: float, others: list[str]) -> tuple[dict[str, float], float]:
    """Labels choose the voters; the label model and the classifier see the texts of both samples without labels."""
    every = texts + others
    bags = Bags(every)
    post = label_model(votes(every, bags, voters(bags, y)))[0]
    weights, bias = logistic(bags, post)
    mean = min(max(float(post.mean()), 1e-6), 1 - 1e-6)
    return weights, bias + odds - math.log(mean / (1 - mean))


class Looked(dict):
    """The weighted features of a word, kept up to a bound."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights
        self.bases = {f[: f.index("*") + 1] if "*" in f else f for f in weights}

    def score(self, text: str) -> float:
        found = [f for w in set(WORD.findall(text.lower())) if (f := self[w])]
        return math.fsum(self.weights.get(f, 0.0) for f in counted(found)) if found else 0.0

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in features(word) if f in self.bases)
        if len(self) < MAX_WORDS and len(word) <= 64:
            self[word] = found
        return found


def score(docs: DataFrame, weights: dict[str, float], bias: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score, the probability of label 1, of every whole text."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((weights, bias))
    rows = docs.select(key, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = held.value
        look = Looked(own)
        for batch in batches:
            out = []
            for x in batch.column(1):
                z = start + look.score(x.as_py() or "")
                out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [key, "score"])

    return rows.mapInArrow(run, f"{key} {rows.schema[0].dataType.simpleString()}, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, *train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
