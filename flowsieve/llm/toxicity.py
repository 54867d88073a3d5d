"""Toxicity scores: gradient-boosted trees over a few dense features of each text, calibrated isotonically.

The labelled rows are dealt to five parts by a hash of their id, the first fifth of each class in its order to
the part for calibration, so that both sides hold both classes if each has two labelled documents. A lexicon holds words, and beginnings of
words, that toxic texts hold much more often than others. Dense features (`FEATURES`) of a labelled row use
the lexicon of the other parts: densities of lexicon hits, how close they stand to second-person words,
capitals, punctuation and disguised words. Four parts train the trees, the fifth fits the isotonic map from
their output to a probability. Every text is then scored whole with the lexicon of all parts; id, language,
source and labels are no inputs of a score.

`labelled_rows` bounds the labelled documents that are read for fitting: beyond it each is drawn with
probability bound / count by a hash of the id. The lexicon is bounded by `LEXICON`. Labels: one per id (the
largest where it repeats), null labels are left out. Null text is the empty text. Without two labelled
documents of each class every score is the share of toxic labels (0 without labels), and `keep_clean` keeps all. Rows that repeat get the same score.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.values import col
from flowsieve.llm.tables import filled, free_names, id_text, id_type, raw_values, sliced, stored

LABELLED_ROWS = 40_000
LEXICON = 5000
COUNTED_TERMS = 250_000
PARTS = 5
LEAST_DOCUMENTS = 4
LEAST_RATIO, LEAST_Z = 6.0, 3.0
BEGINNINGS = (4, 5, 6)
NEAR = 5
THRESHOLD = 0.3

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner euch euer ihr tu te toi ton tes vous votre vos tú ti contigo tuyo usted ustedes vosotros".split()
)
WORD = re.compile(r"\w+")
INSIDE = re.compile(r"[0-9@$!*#.]++(?=[^\W\d_])")
DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!*#.]++[^\W\d_]++)++")
LOUD = re.compile(r"[A-Z]{2,}+(?!\w)")
STRETCHED = re.compile(r"(.)\1{2,}")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": "", ".": ""})
FEATURES = [
    "hits_per_100_words", "weight_per_word", "largest_weight", "log_hits", "distinct_hits", "second_person_rate", "hits_near_second_person",
    "closeness", "capitals", "capital_words", "exclamations", "punctuation", "disguised_rate", "disguised_hits", "log_words",
]


def terms_of(word: str) -> list[str]:
    """The word and its beginnings, which are marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


class Weights(dict):
    """A number per word, remembered while there is room: the largest lexicon weight of its terms, `SECOND` for
    second-person words without one, and `STRETCH` more if a letter is repeated (`DISGUISE` more if only that hides a term)."""

    SECOND, STRETCH, DISGUISE = -1.0, 1000.0, 3000.0

    def __init__(self, lexicon: dict[str, float], room: int = 150_000) -> None:
        super().__init__()
        self.words, self.room = lexicon, room
        self.beginnings = [(n, {t[:-1]: w for t, w in lexicon.items() if t[-1] == "*" and len(t) == n + 1}) for n in BEGINNINGS]

    def of(self, word: str) -> float:
        weight = self.words.get(word, 0.0)
        for n, known in self.beginnings:
            if (w := known.get(word[:n])) and w > weight and len(word) > n:
                weight = w
        return weight

    def __missing__(self, word: str) -> float:
        weight = self.of(word)
        value = weight or (self.SECOND if word in SECOND_PERSON else 0.0)
        if STRETCHED.search(word):
            value += self.DISGUISE if not weight and self.of(STRETCHED.sub(r"\1", word)) else self.STRETCH
        if len(self) >= self.room:
            self.clear()
        self[word] = value
        return value


def byte_rates(texts: pa.Array) -> np.ndarray:
    """Per text: bytes, ASCII capitals, ASCII letters, '!' and '?', ASCII punctuation."""
    codes = np.arange(256)
    capital, small = (codes >= 65) & (codes <= 90), (codes >= 97) & (codes <= 122)
    mark = (codes > 32) & (codes < 127) & ~capital & ~small & ~((codes >= 48) & (codes <= 57))
    kinds = [k.astype(np.uint8) for k in (capital, capital | small, (codes == 33) | (codes == 63), mark)]
    rows = []
    for value in raw_values(texts):
        counts = np.bincount(np.frombuffer(value, dtype=np.uint8), minlength=256)
        rows.append([len(value), *(int(counts @ k) for k in kinds)])
    return np.array(rows, dtype=float).reshape(-1, 5)


def disguises(text: str, weights: Weights) -> tuple[int, int]:
    """Words with signs or digits between their letters, and how many of them are lexicon words underneath."""
    if not any(m.start() and text[m.start() - 1].isalpha() for m in INSIDE.finditer(text)):
        return 0, 0
    found = [STRETCHED.sub(r"\1", m.group().lower().translate(LEET)) for m in DISGUISED.finditer(text)]
    return len(found), sum(weights.of(w) > 0 for w in found)


def word_features(text: str, weights: Weights) -> list[float]:
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    values = np.fromiter(map(weights.__getitem__, words), dtype=float, count=len(words))
    hidden, stretched = values >= Weights.DISGUISE - 1, values >= Weights.STRETCH - 1
    values = values - np.where(hidden, Weights.DISGUISE, np.where(stretched, Weights.STRETCH, 0.0))
    scores = np.maximum(values, 0.0)
    hits, people = np.flatnonzero(scores), np.flatnonzero(values == Weights.SECOND)
    near = closeness = 0.0
    if len(hits) and len(people):
        at = np.searchsorted(people, hits)
        ahead = np.abs(people[np.minimum(at, len(people) - 1)] - hits)
        distance = np.minimum(ahead, np.abs(people[np.maximum(at - 1, 0)] - hits))
        near, closeness = float((distance <= NEAR).mean()), float((1 / (1 + distance)).mean())
    disguised, disguised_hits = disguises(text, weights)
    return [
        100 * len(hits) / n, float(scores.sum()) / n, float(scores.max(initial=0)), math.log1p(len(hits)), float(len({words[i] for i in hits})),
        len(people) / n, near, closeness, len(LOUD.findall(text)) / n, (disguised + int(stretched.sum())) / n,
        100 * (disguised_hits + int(hidden.sum())) / n, math.log1p(len(words)),
    ]


def features_of(texts: pa.Array, weights: list[Weights]) -> list[list[float]]:
    """`FEATURES` of each text, with its own lexicon weights."""
    rates = byte_rates(texts)
    rows = []
    for text, own, (size, capitals, letters, loud, marks) in zip(texts, weights, rates.tolist()):
        f = word_features(text.as_py(), own)
        rows.append([*f[:8], capitals / max(1, letters), f[8], loud / max(1, size), marks / max(1, size), *f[9:]])
    return rows


def with_features(docs: DataFrame, lexicons: list[dict[str, float]], more: str = "") -> DataFrame:
    """doc_id, the columns named in `more` (schema text) and `features`, an array of doubles; `docs` has doc_id and text.

    With several lexicons, that of the row's `part` is used.
    """
    kept = [c.split()[0] for c in more.split(",") if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [Weights(lexicon) for lexicon in lexicons]
        for batch in sliced(batches):
            texts = filled(batch.column("text"))
            parts = batch.column("part").to_pylist() if len(weights) > 1 else [0] * len(texts)
            values = features_of(texts, [weights[p] for p in parts])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["doc_id", *kept]), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", *kept, "features"])

    return docs.select("doc_id", "text", *kept).mapInArrow(run, f"doc_id {id_type(docs)}, " + "".join(c + ", " for c in more.split(",") if c) + "features array<double>")


def lexicon_from(counts: list[tuple[str, float, float]], toxic: int, clean: int) -> dict[str, float]:
    """Terms with their log ratio from (term, toxic documents, clean documents), where it is large and sure enough."""
    chosen = []
    for term, t, c in counts:
        ratio = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        z = ratio / math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= LEAST_DOCUMENTS and ratio >= math.log(LEAST_RATIO) and z >= LEAST_Z:
            chosen.append((-z, term, ratio))
    return {term: ratio for _, term, ratio in sorted(chosen)[:LEXICON]}


def likely_terms(counted: DataFrame, totals: dict[tuple[int, int], int], left_out: int | None) -> DataFrame:
    """The counts of the terms that the lexicon without one part may hold: the surest `LEXICON` by that lexicon's own measure."""
    parts = [p for p in range(PARTS) if p != left_out]
    toxic, clean = (sum(totals.get((y, p), 0) for p in parts) for y in (1, 0))
    t, c = (sum((F.col(f"n{y}{p}") for p in parts), F.lit(0)) for y in (1, 0))
    ratio = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    z = ratio / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    sure = counted.withColumn("z", z).filter((t >= LEAST_DOCUMENTS) & (ratio >= math.log(LEAST_RATIO)) & (F.col("z") >= LEAST_Z))
    return sure.orderBy(F.desc("z"), "term").limit(LEXICON).drop("z")


def learn_lexicons(docs: DataFrame) -> tuple[dict[str, float], list[dict[str, float]]]:
    """The lexicon from all of doc_id, text, toxic, part, and for each part the one from all other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches):
            for text, toxic, part in zip(filled(batch.column("text")), batch.column("toxic").to_pylist(), batch.column("part").to_pylist()):
                words = set(WORD.findall(text.as_py().lower()))
                counts.update({(t, toxic, part) for w in words for t in terms_of(w)})
            if len(counts) > COUNTED_TERMS:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    def out(counts: Counter) -> pa.RecordBatch:
        columns = list(zip(*((t, y, p, n) for (t, y, p), n in counts.items()))) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["term", "toxic", "part", "n"])

    totals = {(r["toxic"], r["part"]): r["n"] for r in docs.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect()}
    sums = [F.sum(F.when((F.col("toxic") == y) & (F.col("part") == p), F.col("n")).otherwise(0)).alias(f"n{y}{p}") for y in (0, 1) for p in range(PARTS)]
    counted = stored(docs.select("text", "toxic", "part").mapInArrow(run, "term string, toxic int, part bigint, n bigint").groupBy("term").agg(*sums), "term-counts")
    nominated = reduce(DataFrame.union, [likely_terms(counted, totals, part) for part in (None, *range(PARTS))]).distinct()
    likely = nominated.collect()  # at most LEXICON terms for each part left out, and for none

    def without(part: int | None) -> dict[str, float]:
        parts = [p for p in range(PARTS) if p != part]
        counts = [(r["term"], sum(r[f"n1{p}"] for p in parts), sum(r[f"n0{p}"] for p in parts)) for r in likely]
        return lexicon_from(counts, sum(totals.get((1, p), 0) for p in parts), sum(totals.get((0, p), 0) for p in parts))

    return without(None), [without(p) for p in range(PARTS)]


@dataclass
class Toxicity:
    """A fitted scorer; without trees every text gets the constant `share`."""

    share: float
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def margins(self, features: DataFrame) -> DataFrame:
        ready = features.withColumn("features", array_to_vector("features"))
        scored = self.trees.transform(ready)
        return scored.withColumn("margin", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def with_score(self, docs: DataFrame, name: str, text_column: str = "text") -> DataFrame:
        """The documents with their score as one more column, for tables of any columns."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.share))
        lexicon = self.lexicon

        def run(texts: pa.Array) -> pa.Array:
            found = filled(texts)
            return pa.array(features_of(found, [Weights(lexicon)] * len(found)), pa.list_(pa.float64()))

        columns = ("features", "rawPrediction", "probability", "prediction", "margin", "calibrated")
        names = dict(zip(columns, free_names(docs.withColumn(name, F.lit(0)), *columns)))
        given = docs.withColumn(names["features"], array_to_vector(F.arrow_udf(run, "array<double>")(col(text_column).cast("string"))))
        trees = self.trees.copy().setFeaturesCol(names["features"]).setRawPredictionCol(names["rawPrediction"]).setProbabilityCol(names["probability"]).setPredictionCol(names["prediction"])
        scored = trees.transform(given).withColumn(names["margin"], vector_to_array(names["probability"])[1])
        mapped = self.calibration.copy().setFeaturesCol(names["margin"]).setPredictionCol(names["calibrated"]).transform(scored)
        return mapped.withColumn(name, F.least(F.greatest(names["calibrated"], F.lit(0.0)), F.lit(1.0))).drop(*names.values())

    def score(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """One row per document: doc_id, score in [0, 1]."""
        return self.with_score(id_text(docs, id_column, text_column), "score").select("doc_id", "score")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
                 labelled_rows: int = LABELLED_ROWS, trees: int = 20, depth: int = 3, seed: int = 11) -> Toxicity:
    """Fit on the documents that `labels` (an id column of the same name, and the label) covers."""
    known = labels.select(col(id_column).alias("doc_id"), col(label_column).cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    one = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / float(1 << 53)
    count = one.count()
    sample = F.broadcast(one.filter(draw < labelled_rows / max(1, count)))  # at most about `labelled_rows` short rows
    dealt = F.xxhash64(F.lit(seed + 1), "doc_id")
    place = F.shiftrightunsigned(dealt, 11).cast("double").alias("place")
    used = stored(id_text(docs, id_column, text_column).join(sample, "doc_id").select("doc_id", "text", "toxic", place, (F.pmod(dealt, F.lit(PARTS - 1)) + 1).alias("part")), "labelled")
    seen = {r["toxic"]: r["n"] for r in used.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # Of n >= 2 distinct places in a class, at least one and never all are below the quantile.
    bounds = {r["toxic"]: r["bound"] for r in used.select("toxic", "place").distinct().groupBy("toxic").agg(F.percentile("place", F.lit(1 / PARTS)).alias("bound")).collect()}
    bound = F.when(F.col("toxic") == 1, F.lit(bounds.get(1, 0.0))).otherwise(F.lit(bounds.get(0, 0.0)))
    used = used.select("doc_id", "text", "toxic", F.when(F.col("place") < bound, F.lit(0)).otherwise(F.col("part")).cast("bigint").alias("part"))
    share = seen.get(1, 0) / max(1, sum(seen.values()))
    lexicon, by_part = learn_lexicons(used)
    rows = stored(with_features(used, by_part, "toxic int,part bigint"), "toxic-features")
    if {(r["held"], r["toxic"]) for r in rows.groupBy((F.col("part") == 0).alias("held"), "toxic").count().collect()} < {(h, y) for h in (False, True) for y in (0, 1)}:
        return Toxicity(share, lexicon)
    label = F.col("toxic").cast("double").alias("label")
    ready = rows.filter("part > 0").select(label, array_to_vector("features").alias("features"))
    fitted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed).fit(ready.coalesce(6))
    model = Toxicity(share, lexicon, fitted)
    held = model.margins(rows.filter("part = 0").select("features", label))
    model.calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="prediction").fit(held.coalesce(1))
    return model


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; the labels of held-out ids are not used."""
    model = fit_toxicity(docs, labels.filter(~held_out(col(id_column))), id_column, text_column, **settings)
    scores = model.score(docs, id_column, text_column)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The documents, all columns as they were, without those scored at or above the threshold; all if no model can be fitted."""
    model = fit_toxicity(docs, labels.filter(~held_out(col(id_column))), id_column, text_column, **settings)
    if model.trees is None:
        return docs
    score = free_names(docs, "score")[0]
    return model.with_score(docs, score, text_column).filter(F.col(score) < THRESHOLD).select(*[col(c) for c in docs.columns])
