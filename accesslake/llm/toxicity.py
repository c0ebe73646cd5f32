"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.llm.common import slices, written

#: Bounds of the fitted sample: confirmed toxic texts, unlabelled texts, features kept.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 6000, 12000, 3000
PREFIXES = (4, 5, 6)
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»“”‘’…"


def text_features(text: str) -> set[str]:
    """The words of a text (lower-case, without marks around them) and, marked by a star, how longer words begin."""
    found = set()
    for word in set(text.lower().split()):
        word = word.strip(_MARKS)
        if word:
            found.add(word)
            found.update(word[:k] + "*" for k in PREFIXES if len(word) > k)
    return found


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fifth that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """A logistic model of present features; without any it gives the prior."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        weights, total, seen = self.weights, self.bias, set()
        for word in set(text.lower().split()):
            word = word.strip(_MARKS)
            for feature in (word, word[:4] + "*", word[:5] + "*", word[:6] + "*"):
                if feature in weights and feature not in seen and (feature == word or len(word) >= len(feature)):
                    seen.add(feature)
                    total += weights[feature]
        return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))


def fit(rows: list[list[int]], positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of positive and unlabelled rows, each a list of features.

    The risk is ``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` with logistic losses. While the part in brackets is
    negative, the step goes up its gradient instead, so that the fit doesn't make positives of the unlabelled rows. At the
    end the bias is lowered, if need be, until the mean score of the unlabelled rows is no more than the prior, as very
    sure positives would else raise the scores of all rows where the sample is small.
    """
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((f for r in rows for f in r), dtype=np.int64, count=len(row))
    is_p, is_u = positive == 1, positive == 0
    n_p, n_u = max(1, is_p.sum()), max(1, is_u.sum())
    w, b = np.zeros(n_features), np.log(prior / (1 - prior))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row, w[col], len(rows)) if len(col) else np.full(len(rows), b)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        lose = np.logaddexp(0, z)
        rest = lose[is_u].sum() / n_u - prior * lose[is_p].sum() / n_p
        up = np.where(is_u, p / n_u, -prior * p / n_p)  # of the risk on the negative side
        g = np.where(is_p, -prior * (1 - p) / n_p, 0.0) + up if rest >= 0 else -up
        grad = np.concatenate([np.bincount(col, g[row], n_features) + decay * w, [g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    z = (np.bincount(row, w[col], len(rows)) if len(col) else np.zeros(len(rows)))[is_u]
    low, high = -60.0, float(b)
    for _ in range(60 if len(z) else 0):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 / (1 + np.exp(-np.clip(z + middle, -60, 60)))).mean() < prior else (low, middle)
    return w, float(high)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from confirmed toxic texts and unlabelled ones, outside the held-out fifth.

    The class prior is the share of toxic rows among all labels outside that fifth. The fit takes ``max_positive``
    labelled positives and ``max_unlabelled`` texts whose labels it doesn't look at, the first by a hash of the id;
    whole texts are read. Features are screened by how much more often positives have them than unlabelled texts.
    Null labels count as none, several labels of one id as their largest; without positives the model is the prior.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = min(max(toxic / n, 1e-3), 0.5) if n else 1e-3
    if not toxic:
        return Model(float(np.log(prior / (1 - prior))))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    first = [F.xxhash64("id"), F.col("id")]
    picked = known.where("y = 1").select("id", F.lit(1).alias("positive")).orderBy(*first).limit(max_positive)
    picked = picked.union(ids.where(~held_out(F.col("id"))).select("id", F.lit(0)).orderBy(*first).limit(max_unlabelled))
    picked = written(picked, "fit-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = written(texts.join(F.broadcast(picked), "id").select("positive", "text"), "fit-texts")  # bounded by the two limits

    def count(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches):
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update(text_features(text))
        for y in (0, 1):
            names = list(seen[y])
            for low in range(0, len(names), 50000):
                part = names[low : low + 50000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([y] * len(part), pa.int32()), pa.array([seen[y][f] for f in part], pa.int64())], names=["feature", "positive", "n"])

    size = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = size.get(1, 0), max(1, size.get(0, 0))
    if not n_p:
        return Model(float(np.log(prior / (1 - prior))))
    counts = sample.mapInArrow(count, "feature string, positive int, n long").groupBy("feature").agg(F.sum(F.when(F.col("positive") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("positive") == 0, F.col("n")).otherwise(0)).alias("u"))
    p, u = F.col("p") / n_p, F.col("u") / n_u
    pooled = (F.col("p") + F.col("u")) / (n_p + n_u)
    lead = (p - u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-12)
    least = max(2, n_p // 400)
    best = counts.where((F.col("p") >= least) & (p > 1.5 * u)).select("feature", lead.alias("lead")).where("lead > 5").orderBy(F.desc("lead"), "feature").limit(max_features)
    names = [r["feature"] for r in best.collect()]
    place = {f: i for i, f in enumerate(names)}

    def rows(batches):
        for batch in slices(batches):
            found = [sorted(place[f] for f in text_features(x) if f in place) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["positive", "features"])

    fitted = sample.mapInArrow(rows, "positive int, features array<int>").groupBy("positive", "features").agg(F.count("*").alias("n")).collect()
    lists = [list(r["features"]) for r in fitted for _ in range(r["n"])]
    sides = np.array([r["positive"] for r in fitted for _ in range(r["n"])])
    order = sorted(range(len(lists)), key=lambda i: (sides[i], lists[i]))
    w, b = fit([lists[i] for i in order], sides[order], len(names), prior)
    return Model(b, {f: float(x) for f, x in zip(names, w) if x})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text alone.

    Null text is empty and gets the score of no feature; rows with a null id are scored and not held out; repeated rows
    get equal scores; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            scores = [model.score(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns and null texts stay."""
    names, fields = docs.columns, docs.schema

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(names.index(text_col)).to_pylist()
            yield batch.filter(pa.array([model.score(x or "") < threshold for x in texts], pa.bool_()))

    return docs.mapInArrow(run, fields)
