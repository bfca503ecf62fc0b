"""Quality classifier: naive Bayes support vectors.

N-gram indicators (words, and runs of one to three word shapes) are scaled by
the log-ratio of their counts in the two classes; a linear model with hinge loss
is fitted on the scaled indicators by dual coordinate descent, and a logistic
curve turns its margin into a score. Fitting takes a bounded sample of the
labelled rows (``sample_rows``, those of least hash); scoring reads all rows.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from functools import cached_property
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, utf8

SAMPLE_ROWS = 6000
MAX_FEATURES = 1 << 17
#: A feature counts if so many sampled texts have it.
LEAST_TEXTS = 4
_SHAPE = bytes(65 if 65 <= b < 91 else 48 if 48 <= b < 58 else 97 if 97 <= b < 123 or b >= 128 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
REMEMBERED = 200_000


class Featurizer:
    """Indicators of a text: lower-cased words, and runs of one to three word
    shapes. A shape has A, a and 0 for runs of capitals, other letters and
    digits, and = in front if the word repeats the one before it."""

    def __init__(self) -> None:
        self.shapes: dict[bytes, bytes] = {}

    def _shape(self, word: bytes) -> bytes:
        found = self.shapes.get(word)
        if found is None:
            found = _RUNS.sub(rb"\1", word.translate(_SHAPE))
            if len(self.shapes) > REMEMBERED:
                self.shapes.clear()
            self.shapes[word] = found
        return found

    def __call__(self, text: bytes) -> set:
        words = text.split()
        if not words:
            return set()
        shapes = list(map(self._shape, words))
        for i in [i for i, same in enumerate(map(eq, words, words[1:]), 1) if same]:
            shapes[i] = b"=" + shapes[i]
        return set(text.lower().split()).union(chain(zip(shapes), zip(shapes, shapes[1:]), zip(shapes, shapes[1:], shapes[2:])))


_featurizer = Featurizer()  # one in each worker


def _name(feature) -> bytes:
    """A feature as bytes that no word can be: shapes follow a blank."""
    return feature if isinstance(feature, bytes) else b" " + b" ".join(feature)


def descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, n: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of the linear model with L2 penalty and
    hinge loss, by dual coordinate descent over the texts."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(n + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = labels[i] * (w[rows[i]] @ values[i] + w[n]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * labels[i]
                w[rows[i]] += step * values[i]
                w[n] += step
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def _platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps on smoothed targets."""
    pos, neg = max(1, (label > 0).sum()), max(1, (label <= 0).sum())
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = p - target, p * (1 - p) + 1e-9
        ga, gb = (d * margin).sum() + 1e-3 * (a - 1), d.sum()
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


class Model:
    """Weights by feature name, and the curve from margin to score. A dict of the
    weights is made where texts are scored, never to be sent."""

    def __init__(self, names: pa.Array, weights: np.ndarray, ratios: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.bias, self.slope, self.offset = bias, slope, offset
        self.names, self.weights, self.squares = names, weights * ratios, ratios * ratios

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "both"}

    @cached_property
    def both(self) -> dict:
        keys = (tuple(k[1:].split(b" ")) if k[:1] == b" " else k for k in self.names.to_pylist())
        return dict(zip(keys, zip(self.weights.tolist(), self.squares.tolist())))

    def score(self, features: set) -> float:
        total = norm = 0.0
        for w, s in filter(None, map(self.both.get, features)):
            total += w
            norm += s
        margin = (total / math.sqrt(norm) if norm else 0.0) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * margin + self.offset))))


def _coded(got: pa.Table) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """Labels, sorted feature numbers of each text, and the sorted names that they
    number; texts in order of label and features, whatever the order of rows. Names
    stay Arrow bytes, as Python objects would take ten times their memory."""
    if not got.num_rows:
        return np.empty(0, np.int64), [], pa.array([], pa.binary())
    labels = got.column("label").to_numpy().astype(np.int64)
    ends = np.cumsum(pc.list_value_length(got.column("features")).to_numpy())[:-1]
    coded = pc.list_flatten(got.column("features")).dictionary_encode().unify_dictionaries().chunks
    names = coded[0].dictionary
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    texts = np.split(np.concatenate([rank[c.indices.to_numpy()] for c in coded]), ends)
    for t in texts:
        t.sort()
    by = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i].astype(">u4").tobytes()))
    return labels[by], [texts[i] for i in by], names.take(pa.array(order))


def fit(found: np.ndarray, texts: list[np.ndarray], names: pa.Array, max_features: int = MAX_FEATURES, strength: float = 1.0) -> Model:
    """``found``, ``texts``, ``names``: label 0 or 1 and feature numbers of each
    text, and the feature names in order. Without two classes the score is the
    share of label 1, or one half of nothing."""
    labels = np.where(found != 0, 1, -1)
    count = np.bincount(np.concatenate(texts), minlength=len(names)) if texts else np.zeros(0, dtype=np.int64)
    listed = np.flatnonzero(count >= LEAST_TEXTS)
    listed = listed[np.lexsort((listed, -count[listed]))][:max_features]
    if not len(listed) or len(set(labels.tolist())) < 2:
        share = (float((labels > 0).sum()) + 1) / (len(labels) + 2)
        return Model(names[:0], np.empty(0), np.empty(0), 0.0, 1.0, math.log(share / (1 - share)))
    at = np.full(len(names), -1, dtype=np.int64)
    at[listed] = np.arange(len(listed))
    ends = np.cumsum([np.count_nonzero(at[t] >= 0) for t in texts])
    rows = np.split(np.empty(ends[-1], dtype=np.int64), ends[:-1])  # parts of one array, which goes back to the system whole
    values = np.split(np.empty(ends[-1]), ends[:-1])
    pos = np.ones(len(listed))
    neg = np.ones(len(listed))
    for y, r, t in zip(labels, rows, texts):
        r[:] = np.sort(at[t][at[t] >= 0])
        (pos if y > 0 else neg)[r] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    for r, v in zip(rows, values):
        v[:] = ratio[r] / max(1e-9, float(np.sqrt((ratio[r] ** 2).sum())))
    half = len(labels) / 2
    cost = strength * np.where(labels > 0, half / (labels > 0).sum(), half / (labels < 0).sum())
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i in range(len(labels))])
    train = np.flatnonzero(fold != 0)
    w = descend([rows[i] for i in train], [values[i] for i in train], labels[train], cost[train], len(listed))
    test = np.flatnonzero(fold == 0)
    margin = np.array([w[rows[i]] @ values[i] + w[-1] for i in test])
    slope, offset = _platt(margin, labels[test]) if len(set(labels[test].tolist())) == 2 else (2.0, 0.0)
    return Model(names.take(pa.array(listed)), w[:-1], ratio, float(w[-1]), max(slope, 1e-6), offset)


def _extract(batches):
    get = _featurizer
    for batch in batches:
        found = [list(map(_name, get(t))) for t in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.binary()))], names=["label", "features"])


def _fitted(strength: float):
    def run(batches):
        got = pa.Table.from_batches(batches, pa.schema({"label": pa.int32(), "features": pa.list_(pa.binary())}))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(*_coded(got), strength=strength))], pa.binary())], names=["model"])

    return run


def held_out(key: str) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3: not to be learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS, strength: float = 1.0) -> Model:
    """Fit on ``sample_rows`` labelled rows at most. Held-out rows, null ids and
    labels other than 0 and 1 are left out; of several labels of an id the
    greatest counts, and of several texts the least. One task fits; the driver gets
    the weights only, as the sample's features would stay in its memory."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    chosen = (
        usable.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    source = docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("t"))
    found = source.join(F.broadcast(chosen), "id").select("id", "label", "t")  # sample_rows rows at most
    found = found.groupBy("id").agg(F.min("label").alias("label"), F.min("t").alias("t"))
    sample = found.select("label", "t").mapInArrow(_extract, "label int, features array<binary>").repartition(1)
    fitted = sample.mapInArrow(_fitted(strength), "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else fit(np.empty(0, np.int64), [], pa.array([], pa.binary()), strength=strength)


def _scores(model):
    def run(batches):
        get, m = _featurizer, model.value
        for batch in batches:
            scores = [m.score(get(t)) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def scores(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Null and empty
    texts get the score of the bias alone; a null id counts as not held out;
    repeated rows repeat; other columns are not looked at."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # MAX_FEATURES weights at most
    source = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), utf8(text).alias("t"))
    scored = source.mapInArrow(_scores(sent), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns kept."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: sent.value.score(_featurizer(t)))

    return docs.where(score(utf8(text)) >= least)


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
