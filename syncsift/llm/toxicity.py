"""Toxicity: weak supervision from lexicon and pattern voters.

Items are whole words and word beginnings of 4 to 6 letters, lower-cased. From a bounded sample of labelled documents
(``most_labels``, those whose crc32(doc_id as text) mod 5 isn't 0) each item's distinct lines are counted by label:
copies of a passage count once. Items that are significantly more frequent in toxic lines are kept (at most
``most_items``, the most significant). Words are dealt by rank to lexicon voters, and beginnings, which match words that no
document of the sample has, to pattern voters; four more pattern voters look at the shape of a text: repeated hits, the
share of words hit, hits of several voters, and no hit at all.

The generative label model has a class and, for each voter, its probabilities to vote toxic, clean or not at all given
the class. It is fitted to the votes alone by expectation-maximisation from a majority vote. Correlations of voters
given the class are then estimated from residuals under the posterior, and a voter's evidence is divided by the sum
of its absolute correlations, so that voters that say the same count once; both steps are repeated. The posterior of
each sampled document is the target of a logistic classifier over item counts and shares, which scores every document.

Defined results: null text is empty text, which has a score like any other; with no usable toxic label every score is 0;
a null doc_id is kept, with held_out null; rows that repeat a doc_id are scored one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncsift.llm.common import crc_fold, only, released, slices, written
from syncsift.llm.labelled import sample

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
N_PATTERNS = 5


def items_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def mine(rows: DataFrame, most_items: int, tasks: int = 12) -> list[str]:
    """The lexicon, most significant first."""

    def emit(batches):
        import xxhash

        for batch in slices(batches, "text"):
            seen: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for line in (text or "").lower().split("\n"):
                    at = xxhash.xxh64_intdigest(line.encode()) >> 1
                    for word in set(WORD.findall(line)):
                        for item in items_of(word):
                            seen[item][y].add(at)
            flat = [(k, y, h) for k, both in seen.items() for y in (0, 1) for h in both[y]]
            if flat:
                kinds = (pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat, strict=True), kinds, strict=True)], ["item", "y", "line"])

    lines = rows.select("y", "text").mapInArrow(released(emit), "item string, y int, line long").distinct()
    counted = lines.groupBy("item").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    totals = rows.agg(F.avg("y")).first()[0] or 0.0
    rate = min(max(totals, 0.001), 0.5)
    # Evidence that lines with the item are toxic more often than by chance, in the Chernoff bound of a binomial tail.
    n, p = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    bits = n * (p * F.log(p / rate) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0))
    best = counted.where("pos >= 4").where(p > 0.7).withColumn("bits", bits).where("bits > 14").orderBy(F.desc("bits"), "item").limit(most_items)
    return [r["item"] for r in best.select("item").collect()]


def hits(text: str, items: dict[str, int], width: int) -> tuple[np.ndarray, int, int]:
    """Hits by voter, words hit, words in all; a word can be hit by a lexicon voter and a pattern voter."""
    by_voter, hit, n = np.zeros(width), 0, 0
    get = items.get
    for word in WORD.findall(text.lower()):
        n += 1
        starts = (get(f"{word[:p]}*") for p in PREFIXES if len(word) > p)
        found = [k for k in (get(word), next((k for k in starts if k is not None), None)) if k is not None]
        for k in found:
            by_voter[k] += 1
        hit += bool(found)
    return by_voter, hit, n


class Counter:
    """Hits of whole texts. The first half of the voters are of words, the others of beginnings."""

    def __init__(self, items: list[str], voters: int):
        self.voters, half = voters, voters // 2
        words, starts = ([x for x in items if x.endswith("*") == of_starts] for of_starts in (False, True))
        self.items = {x: i % half for i, x in enumerate(words)} | {x: half + i % (voters - half) for i, x in enumerate(starts)}
        # A text without any of these beginnings can't have a hit: one pass by a compiled pattern decides.
        heads = sorted({x[:4].rstrip("*") for x in items})
        self.quick = re.compile("|".join(map(re.escape, heads))) if heads else None

    def of(self, text: str) -> np.ndarray:
        """Features: hits by voter (log), then the pattern features."""
        low = text.lower()
        out = np.zeros(self.voters + N_PATTERNS)
        if not (self.quick and self.quick.search(low)):
            return out
        by_voter, hit, n = hits(low, self.items, self.voters)
        out[: self.voters] = np.log1p(by_voter)
        out[self.voters :] = [hit > 0, hit > 1, math.log1p(hit), min(1.0, 20 * hit / max(n, 1)), float((by_voter > 0).sum() > 1)]
        return out


def votes(x: np.ndarray, voters: int) -> np.ndarray:
    """1 toxic, -1 clean, 0 none: voters of items speak when hit, those of shape on repeated hits, their share and their absence."""
    lexicon = (x[:, :voters] > 0).astype(np.int8)
    p = x[:, voters:]
    none, many = p[:, 0] == 0, p[:, 1] > 0
    return np.column_stack([lexicon, np.where(none, -1, 1), np.where(many, 1, 0), np.where(p[:, 3] > 0.05, 1, np.where(none, -1, 0)), np.where(p[:, 4] > 0, 1, 0)]).astype(np.int8)


def label_model(v: np.ndarray, rounds: int = 25) -> np.ndarray:
    """The posterior probability of toxic for each row of votes, with accuracies and correlations of the voters estimated."""
    n, m = v.shape
    kinds = np.stack([v == 1, v == 0, v == -1], axis=2).astype(float)
    up, down = (v == 1).sum(axis=1), (v == -1).sum(axis=1)
    q = np.where(up > 0, 0.5 + 0.45 * (up / (up + down + 1e-9)), 0.02)
    weight = np.ones(m)
    for step in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        on = (np.einsum("n,nmk->mk", q, kinds) + 0.5) / (q.sum() + 1.5)
        off = (np.einsum("n,nmk->mk", 1 - q, kinds) + 0.5) / ((1 - q).sum() + 1.5)
        if step and step % 5 == 0:  # residual correlation given the class
            expected = q[:, None] * (on[:, 0] - on[:, 2]) + (1 - q)[:, None] * (off[:, 0] - off[:, 2])
            r = v - expected
            c = r.T @ r / n
            s = np.sqrt(np.maximum(np.diag(c), 1e-6))
            weight = 1 / np.maximum(1, np.abs(c / np.outer(s, s)).sum(axis=1))
        evidence = np.einsum("nmk,mk->nm", kinds, np.log(on / off)) @ weight
        q = 1 / (1 + np.exp(-np.clip(evidence + np.log(prior / (1 - prior)), -30, 30)))
    return q


def logistic(x: np.ndarray, q: np.ndarray, penalty: float = 0.02, rounds: int = 40) -> np.ndarray:
    """Weights (the last for the constant) of the linear classifier of posterior labels, by Newton steps."""
    f = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(f.shape[1])
    hold = penalty * np.eye(f.shape[1])
    hold[-1, -1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        step = np.linalg.solve((f * (p * (1 - p) + 1e-6)[:, None]).T @ f + hold, f.T @ (q - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: list[str]
    voters: int
    weights: np.ndarray

    def counter(self) -> Counter:
        return Counter(self.lexicon, self.voters)


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, most_items: int = 4_000, voters: int = 24) -> Model:
    rows = written(sample(docs, labels, "toxic", most_labels).select("y", "text"))
    lexicon = mine(rows, most_items)
    none = Model([], voters, np.concatenate([np.zeros(voters + N_PATTERNS), [-30.0]]))
    if not lexicon:
        return none

    def measure(batches):
        counter = Counter(lexicon, voters)
        for batch in slices(batches, "text"):
            x = np.array([counter.of(t or "") for t in batch.column("text").to_pylist()]).reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x])], ["x"])

    got = rows.select("text").mapInArrow(released(measure), "x binary").toPandas()
    x = np.stack([np.frombuffer(r) for r in got.x])
    return Model(lexicon, voters, logistic(x, label_model(votes(x, voters))))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches):
        counter = model.counter()
        for batch in slices(batches, "text", 16 << 20):
            x = np.array([counter.of(t or "") for t in batch.column("text").to_pylist()]).reshape(len(batch), -1)
            z = x @ model.weights[:-1] + model.weights[-1] if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(released(run), "doc_id long, score double").select(
        "doc_id", (crc_fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))
