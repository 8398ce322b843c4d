"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the distinct lower-case words of a text and their prefixes of 4 and 5 letters. The
model has one weight for each feature, shared by all thresholds: P(grade > k) is the logistic
function of ``weights . x - threshold_k``. It is fitted to a bounded sample of labelled rows; every
row is scored.

Labels give only 0 and 1, so ordered grades are made from them by held-out scores: the sample is
halved by hash, a model with one threshold is fitted to each half and scores the other, and a toxic
row has grade 1, 2 or 3 as its score is in the lowest, middle or highest third of the toxic rows of
its half. Grade 0 is clean. Severity, the expected grade, so says how sure a model that has not
seen the row would be of it; it is not a count of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Bound of the labelled rows that are fitted on.
MAX_TRAIN = 12_000
#: A feature is in so many rows of the sample at least, and its chi-square statistic against the
#: label, with one degree of freedom, reaches this value (one in a thousand by chance).
MIN_ROWS, MIN_CHI2 = 3, 10.83
#: Grades of toxic rows.
GRADES = 3
THRESHOLD = 0.5
ROUNDS = 300
HALF_ROUNDS = 150
#: Words whose features a task remembers.
MAX_KNOWN = 50_000
#: Weight of the squared weights against the whole sample's log likelihood.
L2 = 0.2

_word = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[str, ...]:
    return (word, "^" + word[:4], "^" + word[:5]) if len(word) > 5 else (word,)


def text_features(text: str | None) -> set[str]:
    return {f for w in set(_word.findall((text or "").lower())) for f in word_features(w)}


@dataclass
class OrdinalModel:
    """weights: by feature. thresholds: ascending, one fewer than the grades."""

    weights: dict[str, float]
    thresholds: list[float]

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.thresholds)[None, :], -500, 500)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, rounds: int = ROUNDS, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log likelihood. rows: feature numbers of each."""
    k = int(grades.max()) if len(grades) else 0
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if lengths.sum() else np.zeros(0, int)
    owner = np.repeat(np.arange(len(rows)), lengths)
    w = np.zeros(n_features)
    share = np.array([(grades > j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    # thresholds as a first one and positive steps
    first = np.log((1 - share) / share)
    p = np.concatenate([[first[0]], np.log(np.maximum(np.diff(first), 0.1))])
    m, v = np.zeros(n_features + k), np.zeros(n_features + k)
    for t in range(1, rounds + 1):
        theta = p[0] + np.concatenate([[0], np.cumsum(np.exp(p[1:]))])
        score = np.bincount(owner, w[flat], len(rows))
        upper = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -500, 500)))  # P(y > j)
        padded = np.concatenate([np.ones((len(rows), 1)), upper, np.zeros((len(rows), 1))], 1)
        slope = np.concatenate([np.zeros((len(rows), 1)), upper * (1 - upper), np.zeros((len(rows), 1))], 1)
        at = np.arange(len(rows))
        likely = np.maximum(padded[at, grades] - padded[at, grades + 1], 1e-9)
        lo, hi = slope[at, grades] / likely / len(rows), slope[at, grades + 1] / likely / len(rows)
        d_score = lo - hi
        g_w = np.bincount(flat, d_score[owner], n_features) - l2 / len(rows) * w
        g_theta = np.array([hi[grades == j].sum() - lo[grades == j + 1].sum() for j in range(k)])
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(p[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, p = w + step[:n_features], p + step[n_features:]
    return w, p[0] + np.concatenate([[0], np.cumsum(np.exp(p[1:]))])


def graded_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> pd.DataFrame:
    """At most ``max_train`` labelled rows with their features (arrays of text) and label.

    The sample is the labelled ids with the smallest hashes, so it does not depend on order. An id
    with several labels counts as toxic if one says so. Null labels and ids are left out.
    """
    ids = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    ids = ids.agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = docs.select(F.col(id_col).alias("_id")).distinct().join(ids, "_id")
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"id_hash": x["id_hash"], "label": x["label"], "words": [sorted(text_features(t)) for t in x["text"]]})

    return rows.select(F.xxhash64("_id").alias("id_hash"), "label", "text").mapInPandas(features, "id_hash long, label int, words array<string>")


def _vocabulary(sample: DataFrame) -> list[str]:
    """The features that tell toxic from clean rows, by the counts of the whole sample."""
    toxic = F.sum((F.col("label") > 0).cast("int"))
    of = sample.agg(toxic.alias("t"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_all = of["t"] or 0, of["n"]
    found = sample.select("label", F.explode("words").alias("f")).groupBy("f").agg(toxic.cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("n"))
    off = F.col("t") * n_all - F.col("n") * n_toxic
    spread = F.col("n") * (n_all - F.col("n")) * float(n_toxic * (n_all - n_toxic))
    return [r["f"] for r in found.filter((F.col("n") >= MIN_ROWS) & (n_all * off * off >= MIN_CHI2 * spread)).select("f").orderBy("f").collect()]


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, n_features: int) -> np.ndarray:
    """Grades of the sample's rows, given in the order of their hashes: see the head of the module."""
    grades = np.zeros(len(rows), int)
    half = np.arange(len(rows)) % 2
    for own in (0, 1):
        fit, rest = np.flatnonzero(half != own), np.flatnonzero((half == own) & toxic)
        if not len(rest):
            continue
        grades[rest] = 1
        if toxic[fit].any() and not toxic[fit].all():
            w, _ = fit_ordinal([rows[i] for i in fit], toxic[fit].astype(int), n_features, HALF_ROUNDS)
            score = np.array([w[rows[i]].sum() for i in rest])
            grades[rest] += np.searchsorted(np.quantile(score, np.arange(1, GRADES) / GRADES), score, "left")
    return grades


def train_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN
) -> OrdinalModel | None:
    """Fit on a bounded sample; None if it lacks toxic or clean rows."""
    sample = materialize(graded_sample(docs, labels, id_col, text_col, label_col, max_train), "toxic-sample")
    words = _vocabulary(sample)
    number = {f: i for i, f in enumerate(words)}

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"id_hash": x["id_hash"], "label": x["label"], "x": [[number[w] for w in ws if w in number] for ws in x["words"]]})

    found = sample.mapInPandas(numbered, "id_hash long, label int, x array<int>").toPandas().sort_values("id_hash")
    release(sample)
    toxic = found["label"].to_numpy() > 0
    if not toxic.any() or toxic.all() or not number:
        return None
    rows = [np.asarray(x, int) for x in found["x"]]
    grades = severity_grades(rows, toxic, len(number))
    present = {g: i for i, g in enumerate(sorted(set(grades.tolist())))}
    grades = np.array([present[g] for g in grades.tolist()])
    w, theta = fit_ordinal(rows, grades, len(number))
    return OrdinalModel({f: float(w[i]) for f, i in number.items()}, [float(x) for x in theta])


def score_toxicity(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``p_toxic`` (P(grade > 0)) and ``grade`` (likeliest).

    All rows and columns stay; input columns of these names are replaced. Null and empty texts are
    scored as texts without features. Without a model all three are 0.
    """
    names = ("severity", "p_toxic", "grade")
    docs = docs.drop(*names)
    if model is None:
        return docs.withColumns({"severity": F.lit(0.0), "p_toxic": F.lit(0.0), "grade": F.lit(0)})
    weights = model.weights

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str, ...]] = {}

        def total(text: str | None) -> float:
            hits: set[str] = set()
            for w in set(_word.findall((text or "").lower())):
                own = known.get(w)
                if own is None:
                    if len(known) > MAX_KNOWN:
                        known.clear()
                    own = known[w] = tuple(f for f in word_features(w) if f in weights)
                hits.update(own)
            return sum(weights[f] for f in sorted(hits))

        for texts in frames:
            above = model.above(np.array([total(t) for t in texts], float).reshape(-1))
            each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1), axis=1)
            yield pd.DataFrame({"severity": above.sum(1), "p_toxic": above[:, 0], "grade": each.argmax(1).astype("int32")})

    scored = "_scored"
    while scored in docs.columns:
        scored += "_"
    out = docs.withColumn(scored, score(F.col(text_col)))
    return out.select(*docs.columns, *[F.col(f"{scored}.{n}").alias(n) for n in names])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """Train on the labelled rows of ``docs`` and score all of them.

    Returns ``docs`` with ``severity``, ``p_toxic``, ``grade`` (as ``score_toxicity``) and ``is_toxic``,
    a row for each row of ``docs``; input columns of these names are replaced and all others kept,
    whatever their names. Null and empty texts have no features and are scored by the thresholds
    alone. Rows with equal texts get equal scores. Labels or ids that are null are not trained on,
    and of repeated ids the smallest text is. Without both kinds of labels, as with an empty table,
    nothing is toxic and all scores are 0.
    """
    model = train_toxicity(docs, labels, id_col, text_col, label_col, max_train)
    scored = score_toxicity(docs.drop("is_toxic"), model, text_col)
    return scored.withColumn("is_toxic", F.col("p_toxic") >= THRESHOLD)
