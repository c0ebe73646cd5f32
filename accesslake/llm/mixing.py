"""Mixing documents to target weights of soft domains."""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.llm.common import slices, written

BUCKETS = 1 << 15
#: Labelled documents the domains are learned from, at most.
MAX_LABELLED = 20_000
#: Words whose evidence counts in full; more words weigh as so many, so that long texts keep a soft membership.
EVIDENCE = 20


def _buckets(words: set[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words), dtype=np.int64, count=len(words))


@dataclass
class Domains:
    """A naive Bayes model of the words of each domain: ``weights[d, bucket]`` are log-likelihoods."""

    names: list[str]
    prior: np.ndarray
    weights: np.ndarray

    def posterior(self, text: str) -> np.ndarray:
        words = set(text.lower().split())
        z = self.prior.copy()
        if words:
            z += self.weights[:, _buckets(words)].mean(axis=1) * min(len(words), EVIDENCE)
        z = np.exp(z - z.max())
        return z / z.sum()


def learn_domains(labelled: DataFrame, names: list[str], domain_col: str = "domain", text_col: str = "text") -> Domains:
    """Word counts by domain over all labelled rows; tasks count first, so at most ``BUCKETS`` sums a domain come back.

    Rows with a null text or another domain don't count; a domain without rows has its smoothing only.
    """
    place = {n: i for i, n in enumerate(names)}

    def count(batches):
        seen, docs = np.zeros((len(place), BUCKETS), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        for batch in slices(batches):
            for domain, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                d = place[domain]
                docs[d] += 1
                seen[d] += np.bincount(_buckets(set(text.lower().split())), minlength=BUCKETS)
        for d in range(len(place)):
            at = np.flatnonzero(seen[d])
            yield pa.RecordBatch.from_arrays([pa.array([d] * (len(at) + 1), pa.int32()), pa.array([*at, -1], pa.int32()), pa.array([*seen[d][at], docs[d]], pa.int64())], names=["domain", "bucket", "n"])

    rows = labelled.select(F.col(domain_col).cast("string").alias("domain"), F.col(text_col).cast("string").alias("text")).where(F.col("domain").isin(names) & F.col("text").isNotNull())
    table, docs = np.full((len(names), BUCKETS), 0.1), np.ones(len(names))
    for r in rows.mapInArrow(count, "domain int, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            docs[r["domain"]] += r["n"]
        else:
            table[r["domain"], r["bucket"]] += r["n"]
    return Domains(names, np.log(docs / docs.sum()), np.log(table / table.sum(axis=1, keepdims=True)))


def labelled_rows(docs: DataFrame, ids: DataFrame, domain_col: str, max_rows: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``domain, text`` of the documents that ``ids`` names, of at most ``max_rows`` of those, the first by a hash of the id.

    So the names fit a broadcast of known size and no text is shuffled to learn the domains. Null ids and ids without a
    document name nothing; repeated rows all count; null domains and texts stay as they are; an empty table gives no
    rows; columns of any other name are not read.
    """
    names = ids.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct()
    names = written(names.orderBy(F.xxhash64("_id"), "_id").limit(max_rows), "labelled-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("of"), F.col(domain_col).cast("string").alias("domain"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(names), F.col("of") == F.col("_id"), "left_semi").select("domain", "text")


def memberships(docs: DataFrame, model: Domains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens`` (words between white space of the whole text) and ``p``, the posterior of each domain."""

    def run(batches):
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            p = [model.posterior(x).tolist() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.split()) for x in texts], pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=["doc_id", "tokens", "p"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tokens long, p array<double>")


@dataclass
class Rates:
    """The steps of the fit and whether it met the targets; a document's rate follows from its posterior alone."""

    floor: float
    steps: list[list[float]]
    expected: list[float]
    wanted: list[float]
    met: bool = True

    def column(self, p: str) -> Column:
        rate = F.lit(max(self.floor, 1.0))
        for step in self.steps:
            moved = sum((F.get(p, i) * F.lit(s) for i, s in enumerate(step)), F.lit(0.0))
            rate = F.greatest(F.lit(self.floor), rate - moved)
        return rate

    def of(self, p: np.ndarray) -> float:
        rate = max(self.floor, 1.0)
        for step in self.steps:
            rate = max(self.floor, rate - float(p @ np.array(step)))
        return rate


def fit_rates(members: DataFrame, weights: list[float], total: float | None = None, floor: float = 0.0, rounds: int = 200, tolerance: float = 1e-6) -> Rates:
    """Rates of at least ``floor`` whose expected domain tokens come to ``weights`` of ``total``: least squares by projected gradient.

    What is least is half the squared gap between ``sum(rate * tokens * p)`` and the targets. A document's gradient, by
    tokens, is ``p . gap``, so gradients of all rounds add up to one step for all documents, and a rate is the projection
    of the way so far, ``max(floor, 1 - p . step)``. As the sum is what is projected, the rates tend to those nearest to 1
    that meet the targets. Step lengths follow Barzilai and Borwein's two rules in turn, are never below the reciprocal
    of the Gram matrix's largest eigenvalue, and are cut to it by quarters while the gap exceeds the largest of the last ten.

    It ends when the gap is ``tolerance`` of ``total``, or when a step of the shortest length moves the gap by less than a
    thousandth of that: the projected gradient is nil and the targets are out of reach. Then, or if ``rounds`` don't
    suffice, ``met`` is false and a warning gives the gap.

    Every round is one distributed sum of a few numbers over all documents; rates are never stored, as they follow from
    the step. ``total`` is by default the tokens at hand. With a floor of 1 or more it is free instead, as soft documents
    can't add to one domain alone: the gap is then that to the shares of whatever total the rates come to.
    """
    n, share = len(weights), np.array(weights, dtype=float) / sum(weights)
    start = max(floor, 1.0)
    p = [F.get("p", F.lit(i)) * F.lit(1.0) for i in range(n)]
    tokens = F.col("tokens").cast("double")

    def at(step: np.ndarray) -> np.ndarray:
        rate = F.greatest(F.lit(floor), F.lit(start) - sum((x * F.lit(float(s)) for x, s in zip(p, step)), F.lit(0.0)))
        row = members.agg(*(F.sum(tokens * rate * x).alias(f"s{i}") for i, x in enumerate(p))).first()
        return np.array([row[f"s{i}"] or 0.0 for i in range(n)])

    row = members.agg(*(F.sum(tokens * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i + 1))).first()
    gram = np.array([[row[f"g{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    free = total is None and floor >= 1
    off = np.eye(n) - np.outer(share, np.ones(n)) if free else np.eye(n)  # a free total: what is off the shares
    steepest = float(np.linalg.eigvalsh(off @ gram @ off.T)[-1])
    step, got = np.zeros(n), at(np.zeros(n))
    total = float(got.sum()) if total is None else total
    wanted = share * total
    gap = off @ got if free else got - wanted
    shortest = 1 / steepest if steepest > 0 else 0.0
    length, heights, turn = shortest, [float(gap @ gap)], 0
    for _ in range(rounds):
        if not total or not shortest or np.abs(gap).max() <= tolerance * total:
            break
        slope = off.T @ gap
        tried = step + length * slope
        new = at(tried)
        new_gap = off @ new if free else new - wanted
        if float(new_gap @ new_gap) > (1 - 1e-4) * max(heights[-10:]) and length > shortest:
            length = max(length / 4, shortest)
            continue
        fall = off.T @ (gap - new_gap)
        along, still = length * float(slope @ fall), np.abs(new_gap - gap).max() <= 1e-3 * tolerance * total and length == shortest
        wish = length * length * float(slope @ slope) / along if along > 0 and turn % 2 == 0 else along / max(float(fall @ fall), 1e-300)
        step, got, gap, length, turn = tried, new, new_gap, min(max(wish, shortest), 1e6 * shortest), turn + 1
        heights.append(float(gap @ gap))
        if free:
            total = float(got.sum())
            wanted = share * total
        if still:
            break
    left = float(np.abs(got - wanted).max())
    rates = Rates(floor, [step.tolist()] if step.any() else [], got.tolist(), wanted.tolist(), left <= tolerance * total)
    if not rates.met:
        warnings.warn(f"rates miss the targets by up to {left / total:.2g} of all tokens", stacklevel=2)
    return rates


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], floor: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Domains, Rates]:
    """``doc_id, tokens, p, rate`` of every row, and the fitted model and rates.

    Null text is empty: no tokens and the prior as its posterior; null ids stay; repeated rows have equal rates and all
    count; an empty table gives no rows; other columns are not read.
    """
    names = list(targets)
    model = learn_domains(labelled, names)
    members = written(memberships(docs, model, id_col, text_col), "memberships")
    rates = fit_rates(members, [targets[n] for n in names], floor=floor)
    return members.withColumn("rate", rates.column("p")), model, rates


def resample(docs: DataFrame, model: Domains, rates: Rates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as many times as its rate says: the whole part, and once more by a hash of its id and text.

    Null text is empty and null ids are hashed as such; repeated rows fall alike; texts are read whole, one at a time;
    an empty table gives no rows; all columns stay, whatever their names.
    """
    names, fields = docs.columns, docs.schema

    def run(batches):
        import xxhash

        for batch in slices(batches):
            texts, ids = batch.column(names.index(text_col)).to_pylist(), batch.column(names.index(id_col)).to_pylist()
            times = []
            for i, x in zip(ids, texts):
                rate = rates.of(model.posterior(x or ""))
                chance = xxhash.xxh64_intdigest(f"{i} {x or ''}".encode("utf-8", "surrogatepass")) / 2**64
                times.append(int(rate) + (chance < rate - int(rate)))
            yield batch.take(pa.array(np.repeat(np.arange(len(times)), times)))

    return docs.mapInArrow(run, fields)
