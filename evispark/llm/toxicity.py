"""Toxicity grades by cumulative-link (proportional-odds) regression on sparse text features.

P(grade > k) = 1 / (1 + exp(threshold_k - w x)): one weight vector, shared by the ordered thresholds. x has
1 + ln(count) for each lower-cased word and for the beginnings of longer ones, hashed to 2**FEATURE_BITS places; a place weighs
in by how far its log-odds ratio between the classes exceeds EVIDENCE standard errors. Expected
severity is the sum of P(grade > k) over k; a document is toxic if P(grade > 0) >= 0.5.

Grades from 0/1 labels: 0 clean; 1 toxic; 2 toxic with more than the toxic median of words whose smoothed
log-odds are over 2. The model is fitted at the driver on at most ``per_class`` labelled documents of each
class (those of least hash, whole texts of FIT_BYTES or less; of several rows of one id, the one of least hash); so what
the driver gets is bounded in rows and in bytes. Scoring covers all rows and needs no shuffle.

Null and empty texts have no features, severity from the thresholds alone, and are never toxic. Labels that
are null, repeated or of unknown documents do no harm. Without labels of both classes, or without a
feature that tells them apart, nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import bytewords as bw

FEATURE_BITS = 20
#: Bytes of a word's beginning that are features too, so that stems with many endings are learnt.
BEGINNINGS = (4, 5, 6)
#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 2000
#: Bytes of a text that the model may be fitted on, at most; longer ones are scored like all others.
FIT_BYTES = 1 << 20
#: Standard errors from no association at which a feature begins to count.
EVIDENCE = 3.0
#: Bytes of text whose features are held at once.
SLICE = 512 << 10
#: Thresholds of a model that finds nothing toxic.
NEVER = np.array([50.0, 51.0])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the sparse features: the words, and the beginnings of the longer ones."""
    data, offsets = bw.text_bytes(column)
    data = bw.LOWER[data]
    start, end, row = bw.spans(data, offsets)
    keys = []
    for size in (0, *BEGINNINGS):
        some = slice(None) if not size else np.flatnonzero(end - start > size)
        s, of = start[some], row[some].astype(np.uint64)
        h = bw.hash_spans(data, s, s + size if size else end)
        if size:
            h = bw.mix64(h + np.uint64(size))
        keys.append((of << np.uint64(FEATURE_BITS)) | (h >> np.uint64(64 - FEATURE_BITS)))
    key = np.concatenate(keys)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    value = 1 + np.log(np.diff(np.append(first, len(key))))
    return (key[first] >> np.uint64(FEATURE_BITS)).astype(np.int64), (key[first] & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64), value


def fit(row: np.ndarray, place: np.ndarray, value: np.ndarray, toxic: np.ndarray, steps: int = 200, ridge: float = 1e-4) -> Model:
    """The model of these features; ``toxic`` has 0 or 1 for each row."""
    size, rows = 1 << FEATURE_BITS, len(toxic)
    if toxic.min(initial=1) == toxic.max(initial=0) or not len(row):
        return Model(np.zeros(size), NEVER)
    bad = toxic[row] == 1
    # documents with and without each feature, by class; evidence is the log-odds ratio over its standard error
    cells = []
    for n, of in ((toxic.sum(), bad), (rows - toxic.sum(), ~bad)):
        have = np.bincount(place[of], minlength=size) + 0.5
        cells += [have, np.maximum(n + 1 - have, 0.5)]
    odds = np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])
    evidence = np.abs(odds) / np.sqrt(sum(1 / c for c in cells))
    scale = np.clip((evidence - EVIDENCE) / EVIDENCE, 0, 1)  # features without evidence have no say
    strong = np.bincount(row, weights=(odds[place] > 2) * value, minlength=rows)
    grade = toxic + ((toxic == 1) & (strong > np.median(strong[toxic == 1])))
    if not scale.any():
        return Model(np.zeros(size), NEVER)
    keep = scale[place] > 0
    row, place, value = row[keep], place[keep], value[keep] * scale[place[keep]]
    w, cuts, rate = np.zeros(size), np.array([0.0, 1.0]), np.array([0.3, 0.1])
    moments = [np.zeros(size), np.zeros(size), np.zeros(2), np.zeros(2)]
    above = (grade[:, None] > np.arange(2)[None, :]).astype(float)
    weight = np.where(toxic == 1, rows / (2 * toxic.sum()), rows / (2 * (rows - toxic.sum()))) / rows
    for t in range(1, steps + 1):
        # the cumulative links' logistic losses share w; their gradients add up
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - np.bincount(row, weights=w[place] * value, minlength=rows)[:, None], -40, 40)))
        slope = (p - above) * weight[:, None]
        grads = np.bincount(place, weights=slope.sum(1)[row] * value, minlength=size) + ridge * w, -slope.sum(0)
        for k, (g, target) in enumerate(zip(grads, (w, cuts), strict=True)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            target -= rate[k] * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        cuts.sort()
    return Model(w * scale, cuts)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for a, b in bw.slices(batch.column(1), SLICE):
                row, place, value = features(batch.column(1).slice(a, b - a))
                line = np.bincount(row, weights=m.weights[place] * value, minlength=b - a)
                p = 1 / (1 + np.exp(np.clip(m.thresholds[None, :] - line[:, None], -40, 40)))
                toxic = (p[:, 0] >= 0.5) & (np.bincount(row, minlength=b - a) > 0)
                grade = np.where(toxic, (p >= 0.5).sum(1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p.sum(1)), pa.array(grade), pa.array(toxic)], ["doc_id", "expected_severity", "grade", "toxic"])

    return run


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in bw.slices(batch.column(1), SLICE):
            row, place, value = features(batch.column(1).slice(a, b - a))
            counts = np.append(0, np.cumsum(np.bincount(row, minlength=b - a))).astype(np.int32)
            places, values = (pa.ListArray.from_arrays(pa.array(counts), pa.array(x)) for x in (place.astype(np.int32), value.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), places, values], ["toxic", "places", "values"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model fitted on a bounded sample of the labelled rows."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    ordered = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(ordered[0].unionByName(ordered[1]))  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    fit_for = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES)
    one = fit_for.join(sample, "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select("toxic", "text").mapInArrow(_sparse, "toxic int, places array<int>, values array<float>").toArrow()
    if not rows.num_rows:
        none = np.zeros(0, np.int64)
        return fit(none, none, none, none)
    places = rows.column("places").combine_chunks()
    sizes = np.diff(places.offsets.to_numpy())
    flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy()
    return fit(np.repeat(np.arange(len(sizes)), sizes), flat("places").astype(np.int64), flat("values").astype(float), rows.column("toxic").to_numpy())


def grade(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) of each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, expected_severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is toxic; scored in place, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def is_toxic(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], ["id", "text"])
        parts = [out.column(3) for out in _score(shared)(iter([rows]))]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())

    return docs.where(~is_toxic(docs[text_col].cast("string")))
