"""Toxicity by gradient-boosted trees over dense features of a text.

The features are densities of lexicon words, how near they stand to the second person,
capitals, punctuation, and signs of obfuscation (digits and symbols within words, drawn-out
letters, lexicon words that appear once such signs are undone). One lexicon is a short list of
insults; the other is learned: words, and beginnings of words of 3 to 8 letters, whose share
of the toxic labelled texts exceeds that of the others, with the logarithm of the two
shares' ratio as their weight. A labelled text's own features count without its own part in
those shares, so that trees do not learn to trust words that only it holds.

Spark counts the units, trains the trees and fits the isotonic calibration, on all labelled
rows that are not held out: trees on three quarters of them, the calibration on the rest.
The learned lexicon, ``units`` entries at most, is all that goes through the driver.

Defined results: null texts count as empty, and texts without words have zeros for features;
each row of a repeated id gives a row and is learned from; of repeated labels the mean
decides, a tie counts as 1; null labels and null ids are not learned from, and rows with
null ids are not held out; with labels of one class, or none, every score is their share
(0.5 for none); other columns are ignored, whatever they are called; an empty table gives no
rows and teaches nothing; texts of any length count whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, slices

# Plain insults, and the second person, of the four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers trash garbage scum pathetic worthless disgusting clown jerk ugly hate"
    " dumm dummkopf idiotin trottel abschaum müll wertlos widerlich hasse idiote stupide imbécile crétin nul minable ordure"
    " dégoûtant idiota estúpido estúpida imbécil basura asqueroso patético inútil".split()
)
SECOND = frozenset("you your yours yourself ya u du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Signs that stand for letters.
UNDONE = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W\d_]+")
INNER = re.compile(r"[\d@$!*](?<=[^\W\d_].)[\d@$!*]*(?=[^\W\d_])")
LONG = re.compile(r"([^\W\d_])\1\1")
LONG_RUN = re.compile(r"(.)\1{2,}")
MARKS = re.compile(r"[!?]{2,}")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$")
REACH = 5
#: Weights from which a word counts as of the lexicon, and as strong.
SOME, STRONG = 2.0, 4.0
FEATURES = (
    "insults", "learned", "learned_words", "strong_words", "weight", "greatest", "second_greatest", "near_second_person", "second_person",
    "upper", "shouted", "bangs", "marks", "inner_signs", "drawn_out", "hidden_insults", "log_words", "symbols", "distinct",
)
#: Rows of labels, of 16 bytes, that are broadcast; of more the join shuffles.
MANY = 2_000_000
MEMORY = 200_000


def units(words: set[str]) -> set[str]:
    """The whole words, marked as such, and their beginnings."""
    return {w + "$" for w in words} | {w[:n] for w in words for n in range(3, min(9, len(w)))}


@dataclass
class Lexicon:
    """Shares of toxic and of other texts as counts: unit -> (toxic texts, other texts)."""

    counts: dict[str, tuple[int, int]]
    n_toxic: int
    n_other: int
    least: int = 3

    def weight(self, toxic: int, other: int) -> float:
        if toxic < self.least:
            return 0.0
        return max(0.0, math.log((toxic + 0.5) / (self.n_toxic + 1)) - math.log((other + 0.5) / (self.n_other + 1)))

    def weigher(self, label: int | None):
        """A word's weight, the greatest of its units; without one text of ``label``."""
        less = {None: (0, 0), 1: (1, 0), 0: (0, 1)}[label]
        weights = {u: self.weight(a - less[0], max(0, b - less[1])) for u, (a, b) in self.counts.items()}
        ways = {u[:n] for u in weights for n in range(1, len(u) + 1)}  # beginnings of units: where none goes on, the search ends

        def weigh(word: str) -> float:
            best = 0.0
            for n in range(3, min(9, len(word))):
                if word[:n] not in ways:
                    return best
                best = max(best, weights.get(word[:n], 0.0))
            return max(best, weights.get(word + "$", 0.0))

        return weigh


def has_triple(text: str) -> bool:
    """Whether any character stands three times in a row; most texts need no closer look."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    same = raw[1:] == raw[:-1]
    return bool((same[1:] & same[:-1]).any())


def features(text: str, weigh, whole) -> list[float]:
    """FEATURES of one text. ``weigh`` leaves the text's own part out, ``whole`` does not: that is
    for words which it does not hold as they are."""
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts: dict[str, int] = {}
    upper = shouted = 0
    for w, k in Counter(words).items():
        if not w.islower():
            upper += k * sum(map(str.isupper, w))
            shouted += k * (len(w) > 1 and w.isupper())
            w = w.lower()
        counts[w] = counts.get(w, 0) + k
    weights = {w: x for w in counts if (x := weigh(w))}
    insults = counts.keys() & INSULTS
    hits = insults | {w for w, x in weights.items() if x >= SOME}
    n_hits = sum(counts[w] for w in hits)
    n_second = sum(counts[w] for w in counts.keys() & SECOND)
    near = 0
    if n_hits and n_second:
        low = [w.lower() for w in words]
        second = [i for i, w in enumerate(low) if w in SECOND]
        for i, w in enumerate(low):
            if w in hits:
                j = bisect_left(second, i)
                near += any(abs(k - i) <= REACH for k in second[max(0, j - 1) : j + 1])
    top = sorted(weights.values(), reverse=True)[:2]
    tokens = text.split()
    signs = [t for t in tokens if INNER.search(t)] if INNER.search(text) else []
    drawn = [t for t in tokens if LONG.search(t)] if has_triple(text) else []
    hidden = sum(any(x in INSULTS or whole(x) >= STRONG for x in uncovered(t)) for t in {*signs, *drawn})
    return [
        100 * sum(counts[w] for w in insults) / n, 100 * n_hits / n,
        math.log1p(sum(x >= SOME for x in weights.values())), math.log1p(sum(x >= STRONG for x in weights.values())),
        sum(x * counts[w] for w, x in weights.items()) / n, *(top + [0.0, 0.0])[:2], near / max(1, n_hits), 100 * n_second / n,
        upper / sum(map(len, words)), shouted / n,
        100 * (text.count("!") + text.count("?")) / len(tokens), 100 * len(MARKS.findall(text)) / len(tokens),
        100 * len(signs) / len(tokens), 100 * len(drawn) / len(tokens), math.log1p(hidden), math.log(n),
        sum(map(text.count, "#*$%&@")) / len(text), len(counts) / n,
    ]


def uncovered(token: str) -> set[str]:
    """What a token may have been, with signs read as letters or left out, and drawn-out letters
    once or twice."""
    core = token.strip(EDGES).lower()
    out = set()
    for x in (core.translate(UNDONE), re.sub(r"[^\w]|[\d_]", "", core)):
        out |= {LONG_RUN.sub(r"\1", x), LONG_RUN.sub(r"\1\1", x)}
    return out


def remainder(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, scratch: Scratch) -> DataFrame:
    """(id, y, text) of every row with a label that may be learned from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("__y"))
    known = broadcast_if_small(scratch.table(known, "toxic-labels"), MANY)
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).join(known, "__id").select("__id", "__y", "__text")


def counted_units(rows: DataFrame) -> DataFrame:
    """unit, toxic, other: how many texts of either kind hold it; the unit '' counts them all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()

        def flushed() -> pa.RecordBatch:
            names = list(found[0] | found[1])
            out = [pa.array(names, pa.string()), *(pa.array([c[u] for u in names], pa.int64()) for c in (found[1], found[0]))]
            return pa.RecordBatch.from_arrays(out, ["unit", "toxic", "other"])

        for batch in slices(batches):
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = {w.lower() for w in WORD.findall(text or "")}
                found[y].update(units(words))
                found[y][""] += 1
            if len(found[0]) + len(found[1]) > 2 * MEMORY:
                yield flushed()
                found = Counter(), Counter()
        yield flushed()

    return rows.mapInArrow(count, "unit string, toxic long, other long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexicon(rows: DataFrame, scratch: Scratch, units: int = 20_000, least: int = 3, share: float = 0.002) -> Lexicon:
    """The ``units`` of the greatest weights; of equal ones those that sort first. Each is in ``least``
    toxic texts, and in that share of them: of very many texts, chance gives rare words to some."""
    counts = scratch.table(counted_units(rows), "toxic-units", small=True)
    total = counts.where("unit = ''").first()
    if total is None:
        return Lexicon({}, 0, 0, least)
    least = max(least, math.ceil(share * total.toxic))
    part = lambda c, n: (F.col(c) + 0.5) / F.lit(n + 1.0)
    ratio = part("toxic", total.toxic) / part("other", total.other)
    found = counts.where((F.col("unit") != "") & (F.col("toxic") >= least) & (ratio >= math.exp(SOME / 2)))
    found = found.orderBy(ratio.desc(), "unit").limit(units).collect()
    return Lexicon({r.unit: (r.toxic, r.other) for r in found}, total.toxic, total.other, least)


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel
    calibration: IsotonicRegressionModel | None


def described(rows: DataFrame, lexicon: Lexicon, kept: str) -> DataFrame:
    """Rows of (columns of ``kept``, y, text) as (kept, y, x): ``x`` has the FEATURES, y null where a
    text had no part in the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lexicon.weigher(None)
        weighers = {y: lexicon.weigher(y) for y in (None, 0, 1)}
        for batch in slices(batches):
            x = [features(t or "", weighers[y], whole) for y, t in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) + 1], pa.array(x, pa.list_(pa.float64()))], [*names, "y", "x"])

    names = [c.split()[0] for c in kept.split(", ")]
    return rows.mapInArrow(run, f"{kept}, y int, x array<double>")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", units: int = 20_000,
    rounds: int = 24, depth: int = 3, rate: float = 0.25, seed: int = 11,
) -> Model | float:
    """The model, or the share of label 1 where there is nothing to tell apart."""
    scratch = Scratch(docs.sparkSession)
    try:
        rows = labelled(docs, labels, id_col, text_col, label_col, scratch)
        lexicon = learn_lexicon(rows, scratch, units)
        n = lexicon.n_toxic + lexicon.n_other
        if not lexicon.n_toxic or not lexicon.n_other:
            return lexicon.n_toxic / n if n else 0.5
        table = scratch.table(described(rows, lexicon, "__id long"), "toxic-features", small=True)
        table = table.select(array_to_vector("x").alias("x"), F.col("y").cast("double").alias("y"), (F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(4)) == 0).alias("later"))
        parts = {(r.later, r.y) for r in table.select("later", "y").distinct().collect()}
        split = len(parts) == 4
        trees = GBTClassifier(
            featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=5 if n > 500 else 2, seed=seed
        ).fit(table.where("not later") if split else table)
        calibration = None
        if split:
            calibration = IsotonicRegression(featuresCol="p", labelCol="y").fit(scored_rows(trees, table.where("later")))
        return Model(lexicon, trees, calibration)
    finally:
        scratch.drop()


def scored_rows(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """rows with ``p``, what the trees say."""
    out = trees.transform(rows)
    return out.withColumn("p", F.get(vector_to_array("probability"), 1)).drop("probability", "rawPrediction", "prediction")


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the features of every row."""
    held = F.coalesce(remainder(F.col(id_col)) == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.lit(None).cast("int").alias("y"), F.col(text_col).cast("string").alias("text"))
    if isinstance(model, float):
        out = described(rows, Lexicon({}, 0, 0), "doc_id long, held_out boolean").withColumn("score", F.lit(model))
    else:
        out = described(rows, model.lexicon, "doc_id long, held_out boolean").withColumnRenamed("x", "values").withColumn("x", array_to_vector("values"))
        out = scored_rows(model.trees, out).drop("x").withColumnRenamed("values", "x")
        out = model.calibration.transform(out) if model.calibration else out.withColumn("prediction", F.col("p"))
        out = out.withColumn("score", F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)))
    named = F.struct(*(F.get("x", i).alias(n) for i, n in enumerate(FEATURES))).alias("features")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), named)
