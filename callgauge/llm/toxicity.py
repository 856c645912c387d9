"""Toxicity as ordered severity grades, by cumulative-link (proportional odds) regression.

One weight vector over sparse word features is shared by all thresholds between grades:
P(grade <= k) = sigmoid(threshold_k - w.x). The prediction is the expected severity, the sum
over k of P(grade >= k); a document is rejected if it more likely has a grade above 0.

The model is fitted on a bounded sample of labelled documents (``max_rows``, toxic and
clean by their shares but a tenth of either at least where there are enough, lowest hash of
the id first) and a bounded vocabulary (``max_features``). Its rows count by their side's share
of all labelled documents, so the thresholds are those of the whole. Labels that only tell toxic from
clean are refined: toxic documents are graded by how often they use the words that set
toxic documents of the sample apart, cut at equal shares. Scoring reads whole texts.

Defined results: a text without a word of the vocabulary (null, empty) has severity 0;
documents without label are only scored; of repeated labels the largest
counts, of labelled rows that repeat an id the one with the smallest SHA-256 of its text;
texts of any length are read whole; without labels of both kinds nothing is rejected and the severity is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm.common import stored, utf8

MAX_ROWS = 8_000
MAX_FEATURES = 2_048
LEAST_SHARE = 0.1  # of the fitted rows that the rarer side gets if it has them
GRADES = 3
MIN_DOCS = 3
LIFT = 4.0  # how much more frequent in toxic documents a telling word is
_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    """Weights by word, and the ascending thresholds between grades."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]


def words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def value(count: int) -> float:
    return 1.0 + math.log(count)


# --- the regression -------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: np.ndarray,
    columns: np.ndarray,
    values: np.ndarray,
    grades: np.ndarray,
    n_features: int,
    n_grades: int,
    *,
    steps: int = 400,
    rate: float = 0.1,
    decay: float = 1e-4,
    shares_of: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on sparse features (row, column, value).

    ``shares_of`` is how much each row counts, 1 on average.
    """
    n = len(grades)
    counted = np.ones(n) if shares_of is None else shares_of
    shares = np.cumsum(np.bincount(grades, weights=counted, minlength=n_grades))[:-1] / n
    start = np.log(np.clip(shares, 1e-3, 1 - 1e-3) / (1 - np.clip(shares, 1e-3, 1 - 1e-3)))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    params = np.concatenate([np.zeros(n_features), start[:1], gaps])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, theta = params[:n_features], _thresholds(params[n_features:])
        eta = np.bincount(rows, weights=values * w[columns], minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = _sigmoid(edges[grades + 1] - eta), _sigmoid(edges[grades] - eta)
        upper, lower = np.where(grades == n_grades - 1, 1.0, upper), np.where(grades == 0, 0.0, lower)
        share = np.maximum(upper - lower, 1e-9)
        slope_up = counted * upper * (1 - upper) / share
        slope_low = counted * lower * (1 - lower) / share
        by_row = (slope_up - slope_low) / n
        grad_w = np.bincount(columns, weights=values * by_row[rows], minlength=n_features)
        per_edge = np.bincount(grades + 1, weights=-slope_up, minlength=n_grades + 1)
        per_edge += np.bincount(grades, weights=slope_low, minlength=n_grades + 1)
        grad_theta = per_edge[1:n_grades] / n
        # threshold k is the first one plus the gaps before it
        tail = np.cumsum(grad_theta[::-1])[::-1]
        grad_gaps = tail[1:] * np.exp(params[n_features + 1 :])
        grad = np.concatenate([grad_w + decay * w, tail[:1], grad_gaps])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        params = params - rate * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.999**step)) + 1e-8
        )
    return params[:n_features], _thresholds(params[n_features:])


def _thresholds(params: np.ndarray) -> np.ndarray:
    return params[0] + np.concatenate([[0.0], np.cumsum(np.exp(params[1:]))])


def predict(model: Model, text: str | None) -> tuple[float, int, bool]:
    """Expected severity, likeliest grade, rejected."""
    if not model.thresholds:
        return 0.0, 0, False
    found = words(text or "")
    # the vocabulary is short, so the smaller of the two is looked up in the larger
    hits = found.keys() & model.weights.keys()
    if not hits:
        return 0.0, 0, False
    eta = sum(model.weights[w] * value(found[w]) for w in sorted(hits))
    above = [float(_sigmoid(np.float64(eta - t))) for t in model.thresholds]
    at_least = [1.0, *above, 0.0]
    shares = [a - b for a, b in zip(at_least, at_least[1:], strict=False)]
    return sum(above), int(np.argmax(shares)), above[0] >= 0.5


# --- fitting and scoring with Spark -----------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [words(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([list(c) for c in counts], type=pa.list_(pa.string())),
                pa.array([list(c.values()) for c in counts], type=pa.list_(pa.int32())),
                batch.column(2),
            ],
            names=["toxic", "words", "counts", "counted"],
        )


def sample_labels(
    labels: DataFrame,
    *,
    id_col: str,
    label_col: str,
    max_rows: int = MAX_ROWS,
    docs: DataFrame | None = None,
) -> DataFrame:
    """(id, toxic, counted) of the labelled rows that the model is fitted on.

    At most ``max_rows``, of the labels that meet a document of ``docs``; ``counted`` is how
    many labelled rows of its side a row stands for.
    """
    met = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .filter("id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    if docs is not None:
        met = met.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    met = stored(met, "toxicity-labels")
    sides = [F.col("toxic") != 0, F.col("toxic") == 0]
    of = met.agg(*(F.count_if(side).alias(f"n{i}") for i, side in enumerate(sides))).first()
    least = int(max_rows * LEAST_SHARE)
    toxic = max(round(max_rows * of["n0"] / max(sum(of), 1)), least)
    toxic = min(toxic, of["n0"], max_rows - min(least, of["n1"]))
    taken = [toxic, min(of["n1"], max_rows - toxic)]
    chosen = [
        met.filter(side)
        .orderBy(F.xxhash64("id"), "id")
        .limit(take)
        .withColumn("counted", F.lit(n / max(take, 1)))
        for side, n, take in zip(sides, of, taken, strict=True)
    ]
    return chosen[0].unionByName(chosen[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    grades: int = GRADES,
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
) -> Model:
    """Fit on a bounded sample; what reaches the driver is bounded by the two limits.

    Labels above 1 are taken as grades; 0/1 labels are refined to ``grades`` grades.
    """
    chosen = sample_labels(
        labels, id_col=id_col, label_col=label_col, max_rows=max_rows, docs=docs
    )
    # one row per chosen id, so that ids which many rows repeat don't outgrow the bound
    first = F.min(F.struct(F.sha2(utf8("text"), 256), "toxic", "text", "counted"))
    texts = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id")  # max_rows rows of three numbers
        .groupBy("id")
        .agg(first.alias("row"))
        .select("row.toxic", "row.text", "row.counted")
    )
    sample = stored(
        texts.mapInArrow(
            _counted, "toxic int, words array<string>, counts array<int>, counted double"
        ),
        "toxicity-sample",
    )
    kinds = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean = kinds.get(0, 0)
    n_toxic = sum(kinds.values()) - n_clean
    if not n_clean or not n_toxic:
        return Model({}, ())
    lift_toxic, lift_clean = F.col("t") / n_toxic, F.col("c") / n_clean
    both = (F.col("t") + F.col("c")) / (n_toxic + n_clean)
    vocabulary = (
        sample.select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(
            F.sum((F.col("toxic") > 0).cast("int")).alias("t"),
            F.sum((F.col("toxic") == 0).cast("int")).alias("c"),
        )
        .filter(F.col("t") + F.col("c") >= MIN_DOCS)
        .select(
            "word",
            (lift_toxic > LIFT * lift_clean).alias("telling"),
            ((lift_toxic - lift_clean) ** 2 / both).alias("power"),
            F.log(
                ((F.col("t") + 1) / (n_toxic + 1)) / ((F.col("c") + 1) / (n_clean + 1))
            ).alias("odds"),
        )
        .orderBy(F.desc("power"), "word")
        .limit(max_features)
        .collect()
    )
    index = {r.word: i for i, r in enumerate(vocabulary)}
    if not index:
        return Model({}, ())
    data = _features(sample, index)
    rows = np.repeat(np.arange(len(data)), [len(r.at) for r in data])
    columns = np.array([i for r in data for i in r.at], dtype=np.int64)
    counts = np.array([n for r in data for n in r.n], dtype=np.float64)
    toxic = np.array([r.toxic for r in data], dtype=np.int64)
    telling = np.array([r.telling for r in vocabulary])
    if toxic.max() <= 1:
        use = np.bincount(rows, weights=counts * telling[columns], minlength=len(data))
        cuts = np.quantile(use[toxic > 0], np.arange(1, grades - 1) / (grades - 1))
        toxic = np.where(toxic > 0, 1 + np.searchsorted(cuts, use, side="left"), 0)
    else:
        grades = int(toxic.max()) + 1
    # features are scaled by the word's log odds, so rare words without a side stay weak
    odds = np.array([r.odds for r in vocabulary])
    counted = np.array([r.counted for r in data])
    weights, thresholds = fit_ordinal(
        rows,
        columns,
        (1.0 + np.log(counts)) * odds[columns],
        toxic,
        len(index),
        grades,
        shares_of=counted / counted.mean(),
    )
    weights = weights * odds
    return Model(
        {w: float(weights[i]) for w, i in index.items()}, tuple(float(t) for t in thresholds)
    )


def _features(sample: DataFrame, index: dict[str, int]) -> list:
    """The sample's rows as places in the vocabulary, in a fixed order."""
    shared = sample.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for found, counts in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
            ):
                pairs = sorted(
                    (shared.value[w], c)
                    for w, c in zip(found, counts, strict=True)
                    if w in shared.value
                )
                at.append([i for i, _ in pairs])
                n.append([c for _, c in pairs])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(at, type=pa.list_(pa.int32())),
                    pa.array(n, type=pa.list_(pa.int32())),
                    batch.column(3),
                ],
                names=["toxic", "at", "n", "counted"],
            )

    schema = "toxic int, at array<int>, n array<int>, counted double"
    found = sample.mapInArrow(run, schema).collect()
    return sorted(found, key=lambda r: (r.toxic, r.at, r.n))


def scorer(spark: SparkSession, model: Model):
    """A function from a text column to struct(severity, grade, rejected)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<severity:double,grade:int,rejected:boolean>")
    def score(texts: pa.Array) -> pa.Array:
        found = [predict(shared.value, t) for t in texts.to_pylist()]
        severity, grade, rejected = zip(*found, strict=True) if found else ((), (), ())
        return pa.StructArray.from_arrays(
            [
                pa.array(severity, type=pa.float64()),
                pa.array(grade, type=pa.int32()),
                pa.array(rejected, type=pa.bool_()),
            ],
            names=["severity", "grade", "rejected"],
        )

    return score
