"""Quality classifier from weak labels: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer trained on the posterior labels.

Each labeller says good (1), bad (0) or nothing (-1) about a text. How often each combination of votes occurs is counted over
all documents; there are at most 3 ** len(LABELLERS) of them. From these counts alone, expectation-maximisation estimates the
share of good texts and how each labeller votes on good and on bad ones. The posterior of a combination is the soft
label of its texts. A logistic model over hashed features, among them the words themselves, learns these labels from a
bounded sample, and it alone decides, so it also rates texts on which the labellers are silent or split.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameweave.llm.columns import in_batches, text_key

#: Size of the feature space, expected rows of the training sample, least score that keeps a document, and words of a block in which repeats are counted.
FEATURES, SAMPLE, KEEP, BLOCK = 1 << 18, 6000, 0.5, 200

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son mais comme elle aux été "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war "
    "el y los del las por con una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser dos también fue había era muy años hasta desde está".split()
)
_SYMBOL = re.compile(r"[%*#$&@~^=<>{}\\]")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:?!)»”\"]?")
LABELLERS = ("symbols", "shouting", "lists", "repeats", "echoes", "top_word", "function_words", "plain_words")


#: Words whose traits a worker remembers.
MEMORY = 200_000
_traits: dict[str, tuple[int, int]] = {}
_kinds: list[tuple[tuple[str, ...], str]] = []
_kind_of: dict[tuple[tuple[str, ...], str], int] = {}


def _learn(w: str) -> tuple[int, int]:
    """(kind, feature) of a word: the number of what it counts for and its shape in _kinds, and the place of its own feature."""
    counts = []
    if _PLAIN.fullmatch(w):
        counts.append("plain_words")
        shape = "A" if w.isupper() else "Aa" if w[0].isupper() else "a"
        if w.strip(".,;:?!)»”\"").lower() in FUNCTION_WORDS:
            counts.append("function_words")
    else:
        bare = w.rstrip("!?.,;:")
        shape = "|" if w == "|" else "#" if _SYMBOL.search(w) else "0" if bare.isdigit() else "x"
        if shape == "#":
            counts.append("symbols")
        if shape == "|" or w in ("-", "•", "·", "–"):
            counts.append("lists")
    if "!!" in w or (len(w) > 1 and w.isupper()):
        counts.append("shouting")
        shape += "!"
    kind = (tuple(counts), shape if w[-1].isalnum() else shape + w[-1])
    if kind not in _kind_of:
        _kind_of[kind] = len(_kinds)
        _kinds.append(kind)
    if len(_traits) >= MEMORY:
        _traits.clear()
    _traits[w] = out = (_kind_of[kind], zlib.crc32(w.encode("utf-8", "surrogatepass"), 1) % (FEATURES - 1) + 1)
    return out


def measures(text: str | None) -> tuple[int, dict[str, float], dict[str, int], list[int]]:
    """Number of words, a share for each labeller, how often each shape of a word occurs, and the feature of each different word."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return 0, dict.fromkeys(LABELLERS, 0.0), {}, []
    counted = Counter(words)
    of_kind: dict[int, int] = {}
    features = []
    for w, k in counted.items():
        kind, feature = _traits.get(w) or _learn(w)
        of_kind[kind] = of_kind.get(kind, 0) + k
        features.append(feature)
    found = dict.fromkeys(LABELLERS, 0)
    shapes: dict[str, int] = {}
    for kind, k in of_kind.items():
        counts, shape = _kinds[kind]
        for c in counts:
            found[c] += k
        shapes[shape] = shapes.get(shape, 0) + k
    blocks = [words[i : i + BLOCK] for i in range(0, n, BLOCK)]
    shares = {k: v / n for k, v in found.items()}
    shares["echoes"] = sum(map(str.__eq__, words, words[1:])) / n
    shares["top_word"] = max(counted.values()) / n
    shares["repeats"] = 1 - sum(len(set(b)) for b in blocks) / n
    return n, shares, shapes, features


#: A share up to the first number votes for the first side, one from the second number on for the other; between them there is no vote. The last number is the least words for a vote.
_RULES = {"symbols": (0.02, 0.1, 1), "shouting": (0.08, 0.2, 4), "lists": (0.01, 0.1, 4), "repeats": (0.4, 0.5, 20), "echoes": (0.05, 0.15, 4), "top_word": (0.2, 0.3, 20), "function_words": (0.03, 0.06, 20), "plain_words": (0.6, 0.85, 4)}
_MORE_IS_GOOD = ("function_words", "plain_words")


def votes(n: int, shares: dict[str, float]) -> tuple[int, ...]:
    """One vote for each of LABELLERS."""
    out = []
    for k in LABELLERS:
        low, high, least = _RULES[k]
        side = -1 if n < least or low < shares[k] < high else int(shares[k] >= high)
        out.append(side if side < 0 or k in _MORE_IS_GOOD else 1 - side)
    return tuple(out)


def fit_votes(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """The posterior of good for each pattern of votes, from how often each occurs."""
    if not patterns:
        return {}
    v = np.array(sorted(patterns))
    n = np.array([patterns[tuple(x)] for x in v.tolist()], float)
    one_hot = np.stack([v == c for c in (0, 1)], axis=2).astype(float)  # pattern, labeller, vote; silence tells nothing
    bad, good = (v == 0).sum(1), (v == 1).sum(1)
    # one bad vote weighs as much as two good ones at the start: most labellers see only one kind of fault
    post = (good + 1) / (good + 3.0 * bad + 2)
    for _ in range(rounds):
        w = np.stack([(1 - post) * n, post * n])  # class, pattern
        rates = np.einsum("cp,plv->clv", w, one_hot) + 0.5
        rates /= rates.sum(2, keepdims=True)
        prior = (w.sum(1) + 1) / (n.sum() + 2)
        score = np.log(prior)[:, None] + np.einsum("clv,plv->cp", np.log(rates), one_hot)
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return {tuple(x): float(p) for x, p in zip(v.tolist(), post, strict=True)}


def _named(n: int, shares: dict[str, float], shapes: dict[str, int]) -> dict[int, float]:
    """Sparse features of the text as a whole: each shape's share, and which tenth each measure falls into."""
    x: dict[int, float] = {0: 1.0}
    names = {f"shape:{k}": c / n for k, c in shapes.items()} | {f"{k}:{int(min(s, 0.999) * 10) if s else '-'}": 1.0 for k, s in shares.items()} | {f"length:{min(n, 1 << 20).bit_length()}": 1.0}
    for k, c in names.items():
        i = _place(k)
        x[i] = x.get(i, 0.0) + c
    return x


@lru_cache(1 << 16)
def _place(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % (FEATURES - 1) + 1


def hashed(n: int, shares: dict[str, float], shapes: dict[str, int], words: list[int]) -> dict[int, float]:
    """Sparse features: those of the whole text, and the different words, which weigh as much together as one tenth."""
    x = _named(n, shares, shapes)
    each = len(words) ** -0.5
    for i in words:
        x[i] = x.get(i, 0.0) + each
    return x


def logit(weights: np.ndarray, n: int, shares: dict[str, float], shapes: dict[str, int], words: list[int]) -> float:
    """The weighted sum of the features that hashed() gives."""
    x = _named(n, shares, shapes)
    whole = sum(float(weights[i]) * c for i, c in x.items())
    return whole + float(weights[words].sum()) * len(words) ** -0.5


def train(rows: list[dict[int, float]], labels: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model for soft labels, by accelerated full-batch gradients from 0: the same for the same rows."""
    weights = np.zeros(FEATURES)
    if not rows:
        return weights
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    col = np.array([i for x in rows for i in x])
    val = np.array([c for x in rows for c in x.values()])
    speed = np.zeros(FEATURES)
    for _ in range(rounds):
        ahead = weights + 0.9 * speed
        p = 1 / (1 + np.exp(-np.bincount(row, val * ahead[col], len(rows))))
        slope = np.bincount(col, val * (p - labels)[row], FEATURES) / len(rows) + decay * ahead
        speed = 0.9 * speed - rate * slope
        weights = weights + speed
    return weights


def _vote_column(text: Column) -> Column:
    @F.arrow_udf("string")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([",".join(map(str, votes(*measures(x)[:2]))) for x in b.to_pylist()], pa.string())

    return f(text)


class Model:
    """Posteriors by pattern of votes, and the scorer's weights."""

    def __init__(self, posteriors: dict[tuple[int, ...], float], weights: np.ndarray):
        self.posteriors, self.weights = posteriors, weights

    def score(self, text: Column) -> Column:
        """struct(votes, posterior, score). Texts without words score 0."""
        posteriors, weights = self.posteriors, self.weights
        kind = pa.struct([("votes", pa.string()), ("posterior", pa.float64()), ("score", pa.float64())])

        @F.arrow_udf("struct<votes:string,posterior:double,score:double>")
        def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                out = []
                for t in b.to_pylist():
                    m = measures(t)
                    v = votes(*m[:2])
                    z = logit(weights, *m) if m[0] else -np.inf
                    out.append({"votes": ",".join(map(str, v)), "posterior": posteriors.get(v), "score": float(1 / (1 + np.exp(-z)))})
                yield pa.array(out, kind)

        return f(text)


def chosen_texts(docs: DataFrame, sample: int) -> DataFrame:
    """(text): about `sample` different texts of docs, chosen by their hash, or all if there are no more. However often a text is repeated, it is one of them all."""
    keyed = docs.select("text", text_key().alias("key"))
    share = min(1.0, sample / max(1, keyed.select("key").distinct().count()))
    chosen = keyed.where(F.pmod(F.xxhash64(F.lit(SAMPLE), "key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return chosen.dropDuplicates(["key"]).select("text")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts votes over all of docs and trains on about `sample` different texts at most, chosen by their hash.

    Texts without words have no part in it. The sample meets in one task, as features only; copies of a text are one before that,
    so no number of repeats makes it larger.
    """
    docs = in_batches(docs.select("text"))
    counted = docs.select(_vote_column(F.col("text")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    patterns = {tuple(map(int, r.v.split(","))): r.n for r in counted.collect()}  # at most 3 ** len(LABELLERS) rows
    posteriors = fit_votes(patterns)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                m = measures(t)
                if m[0]:
                    x = hashed(*m)
                    out.append({"i": list(x), "x": list(x.values()), "y": posteriors[votes(*m[:2])]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("i", pa.list_(pa.int32())), ("x", pa.list_(pa.float64())), ("y", pa.float64())]))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["y"], r["i"], r["x"]))  # sums then don't depend on the order of arrival
        w = train([dict(zip(r["i"], r["x"], strict=True)) for r in rows], np.array([r["y"] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], names=["w"])

    learnt = chosen_texts(docs, sample).mapInArrow(features, "i array<int>, x array<double>, y double").repartition(1).mapInArrow(learn, "w array<double>").collect()
    return Model(posteriors, np.array(learnt[0].w) if learnt else np.zeros(FEATURES))


def classified(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """One row for each row of docs: doc_id, votes, posterior, score, keep.

    Null, empty and blank texts aren't kept; long ones are measured whole. Equal texts get equal rows, a score on the threshold keeps, and
    an empty table gives none. Other columns aren't read.
    """
    model = fit(docs, sample)
    rows = docs.select("doc_id", model.score(F.col("text")).alias("s"))
    return rows.select("doc_id", "s.votes", "s.posterior", "s.score", (F.col("s.score") >= keep).alias("keep"))


def kept(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """docs without the rows that the classifier rejects, each by its text alone; all columns stay as they are.

    Null, empty and blank texts are rejected, long ones measured whole, a score on the threshold keeps. Equal texts share one fate, so
    repeated rows stay or go together. An empty table stays empty, and no column's name matters but that of text.
    """
    model = fit(docs, sample)
    return docs.where(model.score(F.col("text"))["score"] >= keep)
