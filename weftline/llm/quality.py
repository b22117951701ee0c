"""Quality classifier from weak labels (operator 1).

Heuristic labellers vote good, bad or abstain on every document. Their vote patterns are counted over the whole corpus
(at most 3 to the number of labellers rows), and expectation-maximisation on the counts estimates the share of good
texts, each labeller's accuracy and each pattern's posterior. A linear scorer over hashed byte trigrams and binned text statistics is then
trained by logistic regression on the posteriors of a bounded sample of documents, and scores every document.

Defined cases: null text counts as empty; a text without words gets only the short-text votes; repeated rows score alike;
an empty table gives an empty result; other columns pass through in ``keep_good`` and are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import hashed
from weftline.llm.common import slices, table

ABSTAIN, BAD, GOOD = 0, 1, 2
#: Documents that the scorer is fitted on, at most; picked by a hash of their id.
FIT_ROWS = 4000
BITS = 11
BINS = 16
#: Fixed list: common short words of the corpus's languages.
STOP_WORDS = frozenset("the of and to in a is it that for on as with was be by this are or from at an le la les de des et un une que est pour dans sur par au en du qui il elle ne pas plus der die das und in zu den von mit ist im nicht ein eine auf sich des dem es el los las que y se un una por con para del al lo su no".split())
SYMBOL, UPPER, LETTER = re.compile(r"""[^\w\s.,;:'"()-]"""), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_]")


def statistics(text: str) -> np.ndarray:
    """Shares and sizes that the labellers judge by; zeros for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(LABELLERS))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = len(LETTER.findall(text))
    return np.array(
        [
            len(SYMBOL.findall(text)) / len(text),
            len(UPPER.findall(text)) / letters if letters >= 20 else 0.0,
            sum(map(str.__eq__, words, words[1:])) / n,
            sum(w.lower() in STOP_WORDS for w in words) / n if n >= 20 else 0.07,
            words.count("|") / n,
            1 - len(set(lines)) / len(lines) if len(lines) >= 5 else 0.0,
            sum(map(len, words)) / n,
            n,
            sum(len(set(words[i : i + 50])) for i in range(0, n, 50)) / n if n >= 20 else 1.0,
        ]
    )


#: For each statistic: bad if below, bad if above, good between these. Labellers of one kind of fault never vote good.
LABELLERS = (
    ("symbols", None, 0.03, None),
    ("capitals", None, 0.3, None),
    ("repeats", None, 0.15, None),
    ("stop words", 0.03, None, (0.1, 1.0)),
    ("bars", None, 0.05, None),
    ("lines", None, 0.5, None),
    ("word length", 1.5, 14.0, (2.5, 9.0)),
    ("words", None, None, (40, float("inf"))),
    ("variety", 0.45, None, None),
)
#: Labellers that look for repetition; the others look for noise.
REPETITION = ("repeats", "lines", "variety")


def votes(stats: np.ndarray) -> list[int]:
    out = []
    for value, (_, low, high, fine) in zip(stats, LABELLERS, strict=True):
        bad = (low is not None and value < low) or (high is not None and value > high)
        out.append(BAD if bad else GOOD if fine and fine[0] <= value <= fine[1] else ABSTAIN)
    return out


def pattern(stats: np.ndarray) -> int:
    return sum(v * 3**i for i, v in enumerate(votes(stats)))


def unpacked(patterns: np.ndarray, labellers: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(labellers) % 3


def starts() -> np.ndarray:
    """P(vote | class) by class and labeller, from which the rounds start: good text, noise, and repetition.

    Noise and repetition hardly meet in one text, and labellers of one see nothing in the other; a single class of bad texts
    would settle on the larger kind. A labeller starts with half of its own kind's texts found, and few of the others.
    """
    out = np.zeros((3, len(LABELLERS), 3))
    for i, (name, low, high, fine) in enumerate(LABELLERS):
        own = 1 + (name in REPETITION)
        for y in range(3):
            bad = 0.01 if y == 0 or low is high is None else 0.5 if y == own else 0.05
            good = (0.6 if y == 0 else 0.3) * (1 - bad) if fine else 0.001
            out[y, i] = [1 - bad - good, bad, good]
    return out


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of good by pattern, P(vote | class) by class and labeller, priors of the classes), from pattern counts.

    Class 0 is good, the others are kinds of bad. Abstaining is a vote of its own in each class, since which texts a labeller
    is silent on tells the classes apart; priors are estimated along with the votes' chances.
    """
    seen = unpacked(patterns, start.shape[1])
    chance, prior = start, np.full(len(start), 1 / len(start))
    post = np.zeros((len(patterns), len(start)))
    for _ in range(rounds):
        logs = np.log(prior) + sum(np.log(chance[:, i, seen[:, i]]).T for i in range(start.shape[1]))
        post = np.exp(logs - logs.max(axis=1, keepdims=True, initial=-np.inf))
        post /= post.sum(axis=1, keepdims=True)
        weight = post.T * counts
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + len(start))
        new = np.empty_like(chance)
        for y in range(len(start)):
            for i in range(start.shape[1]):
                sums = np.bincount(seen[:, i], weights=weight[y], minlength=3) + 1.0
                new[y, i] = sums / sums.sum()
        change, chance = np.abs(new - chance).max(), new
        if change < 1e-9:
            break
    return post[:, 0], chance, prior


def accuracies(chance: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(the vote is right | a vote is cast) of each labeller, on good and on bad texts."""
    bad = np.tensordot(prior[1:] / prior[1:].sum(), chance[1:], axes=1)
    return np.stack([chance[0, :, GOOD] / (chance[0, :, BAD] + chance[0, :, GOOD]), bad[:, BAD] / (bad[:, BAD] + bad[:, GOOD])], axis=1)


def features(data: bytes, stats: np.ndarray) -> np.ndarray:
    """Roots of trigram shares, then an indicator of each statistic's bin and a constant."""
    out = np.zeros((1 << BITS) + len(LABELLERS) * BINS + 1)
    grams = hashed.counts(data, BITS)
    out[: 1 << BITS] = np.sqrt(grams / max(1, grams.sum()))
    scale = np.array([40, 16, 16, 20, 40, 16, 1, 1, 15.99])
    bins = np.minimum(np.where(np.arange(len(LABELLERS)) == 7, np.log2(1 + stats), stats * scale), BINS - 1).astype(int)
    out[(1 << BITS) + np.arange(len(LABELLERS)) * BINS + bins] = 0.5
    out[-1] = 1
    return out


def logistic(rows: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights by full-batch gradient descent with momentum; both classes weigh equally."""
    w, v = np.zeros((2, rows.shape[1]), np.float32)
    target = target.astype(np.float32)
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3) if len(target) else 0.5
    weight = (target / (2 * share) + (1 - target) / (2 * (1 - share))).astype(np.float32)
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        v = 0.9 * v - np.float32(rate) * ((weight * (p - target)) @ rows / len(rows) + np.float32(decay) * w)
        w += v
    return w


def each(df: DataFrame, ident: str, text: str, extra: str, one: Callable[[str, np.ndarray], tuple]) -> DataFrame:
    """ident and the columns ``extra`` that ``one`` makes of a text and its statistics."""
    names = [x.split()[0] for x in extra.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for x in batch.column(text):
                body = x.as_py() or ""
                found.append(one(body, statistics(body)))
            yield pa.RecordBatch.from_arrays([batch.column(ident), *(pa.array([f[i] for f in found]) for i in range(len(names)))] if found else [batch.column(ident), *(pa.array([], pa.int64()) for _ in names)], [ident, *names])

    return df.select(ident, text).mapInArrow(run, f"`{ident}` {dict(df.dtypes)[ident]}, {extra}")


class Scorer:
    """What the fit gives: labeller parameters, posteriors by pattern and the scorer's weights."""

    def __init__(self, posts: dict[int, float], chance: np.ndarray, prior: np.ndarray, weights: np.ndarray):
        self.posts, self.chance, self.prior, self.weights = posts, chance, prior, weights


def fit(df: DataFrame, ident: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> Scorer:
    seen = each(df, ident, text, "pattern bigint", lambda body, stats: (pattern(stats),))
    found = seen.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()  # at most 3**9 rows
    post, chance, prior = expectation_maximisation(found.pattern.to_numpy(np.int64), found.n.to_numpy(float), starts())
    posts = dict(zip(found.pattern.tolist(), post.tolist(), strict=True))
    total = int(found.n.sum())
    # Every document is sampled if they fit; else each with the same chance, a twentieth below the bound.
    share = min(1.0, 0.95 * fit_rows / max(1, total))
    picked = df.where(F.pmod(F.xxhash64(ident, F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def sampled(body: str, stats: np.ndarray) -> tuple:
        return pattern(stats), zlib.compress(features(body.encode(), stats).astype(np.float32).tobytes(), 1)  # mostly zeros

    sample = each(picked, ident, text, "pattern bigint, x binary", sampled).limit(fit_rows).drop(ident).toArrow()
    width = (1 << BITS) + len(LABELLERS) * BINS + 1
    rows = np.empty((sample.num_rows, width), np.float32)
    for i, x in enumerate(sample.column("x")):
        rows[i] = np.frombuffer(zlib.decompress(x.as_py()), np.float32)
    target = np.array([posts[p] for p in sample.column("pattern").to_pylist()])
    return Scorer(posts, chance, prior, logistic(rows, target))


def score_quality(df: DataFrame, scorer: Scorer, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, pattern, posterior (of the labellers), score (of the linear scorer), good."""
    shared = df.sparkSession.sparkContext.broadcast((scorer.posts, scorer.weights))

    def one(body: str, stats: np.ndarray) -> tuple:
        posts, weights = shared.value
        p = pattern(stats)
        score = 1 / (1 + np.exp(-np.clip(features(body.encode(), stats) @ weights, -30, 30)))
        return p, posts.get(p, 0.5), round(float(score), 6), bool(score >= 0.5)

    return each(df, ident, text, "pattern bigint, posterior double, score double, good boolean", one)


def keep_good(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the documents that the scorer rejects; all columns stay."""
    weights = df.sparkSession.sparkContext.broadcast(fit(df, ident, text).weights)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bodies = (x.as_py() or "" for x in batch.column(text))
            yield batch.filter(pa.array([bool(features(x.encode(), statistics(x)) @ weights.value >= 0) for x in bodies], pa.bool_()))

    return df.mapInArrow(good, df.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_quality": op1_quality}
