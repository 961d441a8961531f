"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of a whole text (character classes, word lengths, repetition of words, word pairs and lines) are
standardised and mapped to ``features`` random Fourier features, whose inner products approximate a Gaussian kernel of
width ``width``. Tasks sum the normal equations of their rows; the sums of a fixed number of tasks meet at the driver,
which solves the ridge problem (a square matrix of ``features`` + 1). Rows of one fold are held back from the ridge fit
and calibrate its scores to probabilities with isotonic regression (pooled adjacent violators).

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0, of these at most ``most_labels`` (a bounded
sample by hash of doc_id); folds 2 to 4 fit the ridge, fold 1 the calibration. doc_id, lang, source and labels are no inputs.

Defined results: null text is empty text, which has a score like any other; with no usable label, or one class alone,
every score is the share of label 1 in the sample (0.5 if it is empty); a null doc_id is kept, with held_out null;
rows that repeat a doc_id are scored one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncsift.llm.common import binary_of, crc_fold, only, released, slices, written
from syncsift.llm.labelled import sample

N_STATS = 26


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.float64)
    t[list(chars)] = 1
    return t


UPPER, DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
LETTER = _table(bytes(range(97, 123))) + UPPER + _table(bytes(range(128, 256)))
SPACE, HIGH, NEWLINE = _table(b" \t\r\x0b\x0c\n"), _table(bytes(range(128, 256))), _table(b"\n")
STOP, BANG, BAR, SYMBOL = _table(b".,;:?'\"-()"), _table(b"!"), _table(b"|"), _table(b"#$%&*+/<=>@[\\]^_`{}~")
CLASSES = np.stack([UPPER, DIGIT, LETTER, SPACE, HIGH, NEWLINE, STOP, BANG, BAR, SYMBOL], axis=1)


def statistics(text: bytes) -> list[float]:
    """The N_STATS statistics of one whole text."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    share = (counts @ CLASSES / max(n, 1)).tolist()
    p = counts[counts > 0] / max(n, 1)
    entropy = float(-(p * np.log2(p)).sum())
    words = text.split()
    w = len(words)
    lengths = np.fromiter(map(len, words), np.int64, w)
    distinct = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split(b"\n")
    body = [x.strip() for x in lines if x.strip()]
    ends = sum(x[-1:] in b".!?" for x in words) / max(w, 1)
    titled = sum(x[:1].isupper() for x in words) / max(w, 1)
    plain = sum(x.isalpha() for x in words) / max(w, 1)
    return [
        *share, entropy, np.log1p(n), np.log1p(w), float(lengths.mean()) if w else 0.0, float(lengths.std()) if w else 0.0,
        float(lengths.max()) ** 0.5 if w else 0.0, distinct / max(w, 1), np.log1p(distinct), same / max(w - 1, 1), pairs / max(w - 1, 1),
        np.log1p(len(lines)), len(set(body)) / max(len(body), 1), np.log1p(n / len(lines)), ends, titled, plain,
    ]


def stats_of(batches, keep: list[str]):
    """(the kept columns, a matrix of statistics) for each slice of texts."""
    for batch in slices(batches, "text", 16 << 20):
        raw, at = binary_of(batch.column("text"))
        data, at = raw.tobytes(), at.tolist()
        found = np.array([statistics(data[a:b]) for a, b in zip(at, at[1:], strict=False)], np.float64).reshape(len(batch), N_STATS)
        yield [batch.column(k) for k in keep], found


def pooled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x by pooling adjacent violators: block centres and their non-decreasing values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.turn + self.phase) * (2 / self.turn.shape[1]) ** 0.5
        return np.hstack([f, np.ones((len(f), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.centres, self.values), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, features: int = 256, width: float = 6.0, ridge: float = 1e-3, seed: int = 5, tasks: int = 6) -> Model:
    rows = sample(docs, labels, "quality", most_labels)

    def measure(batches):
        for (fold, y), stats in stats_of(batches, ["fold", "y"]):
            yield pa.RecordBatch.from_arrays([fold, y, pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), N_STATS).cast(pa.list_(pa.float64()))], ["fold", "y", "x"])

    table = written(rows.select("fold", "y", "text").mapInArrow(released(measure), "fold int, y int, x array<double>"))

    def x_of(batch):
        return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)

    def sums(batches):
        total = np.zeros((3, N_STATS))
        ones = 0
        for b in batches:
            x = x_of(b)
            total += np.stack([np.full(N_STATS, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])
            ones += int(b.column("y").to_numpy().sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([ones])], ["sums", "ones"])

    got = table.coalesce(tasks).mapInArrow(released(sums), "sums binary, ones long").collect()
    total = sum((np.frombuffer(r["sums"]).reshape(3, N_STATS) for r in got), np.zeros((3, N_STATS)))
    n, ones = total[0, 0], sum(r["ones"] for r in got)
    mean = total[1] / max(n, 1)
    scale = np.sqrt(np.maximum(total[2] / max(n, 1) - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(seed)
    turn, phase = rng.normal(size=(N_STATS, features)) / width, rng.uniform(0, 2 * np.pi, features)
    prior = ones / n if n else 0.5
    flat = Model(mean, scale, turn, phase, np.zeros(features + 1), np.array([0.0]), np.array([prior]))
    if n == 0 or ones in (0, n):
        return flat
    d = features + 1

    def normal(batches):
        a, c = np.zeros((d, d)), np.zeros(d)
        for b in batches:
            use = b.column("fold").to_numpy() != 1
            f = flat.features(x_of(b)[use])
            a += f.T @ f
            c += f.T @ (b.column("y").to_numpy()[use] - prior)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([c.tobytes()])], ["a", "c"])

    parts = table.coalesce(tasks).mapInArrow(released(normal), "a binary, c binary").collect()
    a, c = sum(np.frombuffer(r["a"]).reshape(d, d) for r in parts), sum(np.frombuffer(r["c"]) for r in parts)
    flat.weights = np.linalg.solve(a + ridge * n / d * np.eye(d), c)

    def scored(batches):
        for b in batches:
            use = b.column("fold").to_numpy() == 1
            yield pa.RecordBatch.from_arrays([pa.array(flat.raw(x_of(b)[use])), pa.array(b.column("y").to_numpy()[use])], ["s", "y"])

    held = table.mapInArrow(released(scored), "s double, y int").toPandas()
    if held.y.nunique() == 2:
        flat.centres, flat.values = pooled(held.s.to_numpy(), held.y.to_numpy(dtype=float))
    else:
        flat.centres, flat.values = np.array([-prior, 1 - prior]), np.array([0.0, 1.0])
    return flat


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches):
        for (ids,), stats in stats_of(batches, ["doc_id"]):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(stats) if len(stats) else np.zeros(0))], ["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(released(run), "doc_id long, score double").select(
        "doc_id", (crc_fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, where they are."""

    def run(batches):
        for batch in slices(batches, "text", 16 << 20):
            for _, stats in stats_of(iter([batch]), []):
                yield batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))
