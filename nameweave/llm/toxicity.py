"""Toxic wording from weak labels: the second score of the pipeline's quality stage.

Labellers look for words of small lexicons in four languages: names for people, contempt, profanity, and how many
different ones there are. As for quality, expectation-maximisation over the counts of vote patterns gives soft labels. The
scorer is a logistic model over the labellers' findings and over single words: those of the training sample that stand
mostly in texts with toxic labels, so wording that goes along with the lexicons' counts too; insults that never do are
missed. A vote is 0 for toxic, 1 for clean, -1 for none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameweave.llm.columns import in_batches
from nameweave.llm.quality import SAMPLE, chosen_texts, fit_votes, train

#: Least score that is toxic, size of the space of hashed words, most words that the scorer learns, and documents that count as evidence against a word.
TOXIC, SPACE, LEARNT, DOUBT = 0.5, 1 << 20, 256, 10

# Insults and profanity of English, French, German and Spanish. Words that are harmless in another of them are left out.
LEXICONS = tuple(
    frozenset(x.split())
    for x in (
        "idiot idiots moron morons imbecile imbeciles loser losers clown clowns scum scumbag scumbags dumbass jerk jerks bastard bastards vermin freak freaks retard retards "
        "crétin crétins abruti abrutis connard connards connasse salaud salauds ordure ordures idiote idiotes débile débiles "
        "idioten trottel arschloch arschlöcher abschaum dummkopf vollidiot schwachkopf versager miststück idiota idiotas imbécil imbéciles gilipollas cabrón cabrones estúpido estúpidos escoria payaso payasos",
        "stupid pathetic worthless disgusting trash filthy despicable loathsome contemptible repulsive brainless "
        "stupide stupides pathétique minable minables dégoûtant dégoûtante répugnant dumm dämlich erbärmlich widerlich wertlos ekelhaft abstoßend estúpida patético patética asqueroso asquerosa repugnante despreciable",
        "fuck fucking fucked shit shitty bullshit asshole assholes bitch bitches cunt whore slut merde putain enculé pute scheiße scheisse scheiß fick ficken hure mierda puta puto joder coño",
    )
)
KINDS = len(LEXICONS)


def wording(text: str | None) -> set[str]:
    """The different words of a text, in lower case and without the marks around them."""
    return {w.strip(".,;:?!()[]«»“”\"'’*…-—") for w in (text or "").lower().split()} - {""}


def hits(words: set[str]) -> tuple[int, ...]:
    """How many different words of each lexicon there are."""
    return tuple(len(words & x) for x in LEXICONS)


def votes(found: tuple[int, ...]) -> tuple[int, ...]:
    """One vote for each of hits, and one for two or more different words of all."""
    return (*(int(k == 0) for k in found), (1, -1, 0)[min(2, sum(found))])


def _code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % SPACE


def _findings(found: tuple[int, ...]) -> dict[int, float]:
    """Features of the labellers: 0 is the bias, then each lexicon, then how many different words."""
    x = {0: 1.0} | {i: 1.0 for i, k in enumerate(found, 1) if k}
    return x | {len(found) + min(3, sum(found)): 1.0} if any(found) else x


def learn(rows: list[tuple[tuple[int, ...], list[int], float]]) -> tuple[list[float], dict[int, float]]:
    """(weights of the findings, weights by word code) from (hits, codes of the words, probability of toxic)."""
    if not rows:
        return [0.0] * (KINDS + 4), {}
    codes = np.concatenate([np.array(c, np.int64) for _, c, _ in rows])
    y = np.array([p for _, _, p in rows])
    n = np.bincount(codes, minlength=SPACE)
    lean = (np.bincount(codes, np.repeat(y, [len(c) for _, c, _ in rows]), SPACE) + DOUBT * y.mean()) / (n + DOUBT)
    chosen = np.flatnonzero((lean >= 0.5) & (n > 0))
    chosen = chosen[np.lexsort((chosen, -lean[chosen]))][:LEARNT].tolist()
    base = KINDS + 4
    slot = {c: base + i for i, c in enumerate(chosen)}
    w = train([_findings(f) | {slot[c]: 1.0 for c in cs if c in slot} for f, cs, _ in rows], y)
    return w[:base].tolist(), {c: float(w[i]) for c, i in slot.items()}


class Model:
    def __init__(self, weights: list[float], words: dict[int, float]):
        self.weights, self.words = weights, words

    def score_of(self, text: str | None) -> float:
        """Probability of toxic; 0 without words."""
        words = wording(text)
        if not words:
            return 0.0
        z = sum(self.weights[i] * c for i, c in _findings(hits(words)).items())
        z += sum(self.words[c] for c in {_code(w) for w in words} & self.words.keys())
        return float(1 / (1 + np.exp(-z)))

    def score(self, text: Column) -> Column:
        score_of = self.score_of

        @F.arrow_udf("double")
        def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                yield pa.array([score_of(x) for x in b.to_pylist()], pa.float64())

        return f(text)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts votes over all of docs and learns from about `sample` of them, chosen as for quality. Texts without any hit are labelled clean."""
    docs = in_batches(docs.select("text"))

    @F.arrow_udf("string")
    def ballot(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([",".join(map(str, votes(hits(w)))) if (w := wording(x)) else None for x in b.to_pylist()], pa.string())

    counted = docs.select(ballot(F.col("text")).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    patterns = {tuple(map(int, r.v.split(","))): r.n for r in counted.collect()}  # at most 3 ** (KINDS + 1) rows
    posteriors = fit_votes(patterns) | {votes((0,) * KINDS): 1.0}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                if words := wording(t):
                    found = hits(words)
                    out.append({"f": list(found), "c": sorted({_code(w) for w in words}), "y": 1 - posteriors[votes(found)]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("f", pa.list_(pa.int32())), ("c", pa.list_(pa.int32())), ("y", pa.float64())]))

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((tuple(r["f"]), r["c"], r["y"]) for b in batches for r in b.to_pylist())  # sums then don't depend on the order of arrival
        w, words = learn(rows)
        yield pa.RecordBatch.from_pylist([{"w": w, "c": list(words), "x": list(words.values())}], pa.schema([("w", pa.list_(pa.float64())), ("c", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))]))

    rows = chosen_texts(docs, sample).mapInArrow(features, "f array<int>, c array<int>, y double").repartition(1).mapInArrow(learnt, "w array<double>, c array<int>, x array<double>").collect()
    return Model(rows[0].w, dict(zip(rows[0].c, rows[0].x, strict=True))) if rows else Model(*learn([]))


def without_toxic(docs: DataFrame, sample: int = SAMPLE, toxic: float = TOXIC) -> DataFrame:
    """docs without the rows whose wording is toxic; all columns stay as they are.

    Null, empty and blank texts have no wording and stay, long ones are scored whole, a score on the threshold goes. Equal texts share one
    fate. An empty table stays empty, and no column's name matters but that of text. At most LEARNT words beyond the lexicons have a weight.
    """
    model = fit(docs, sample)
    return docs.where(model.score(F.col("text")) < toxic)
