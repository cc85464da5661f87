"""Language by nearest centroid over TF-IDF vectors of byte n-grams.

A text's vector counts its 2- and 3-grams of lower-cased bytes (anything but letters is a space) in ``BUCKETS`` hash
buckets, as ``log(1 + count) * idf`` at length 1. Document frequencies cover all training rows. Each language has up to
``CENTROIDS`` centroids by spherical k-means over a bounded sample of its training rows (``FIT_ROWS`` a language). A text
goes to the language of the most similar centroid; below the language's own floor of similarity it is also marked as
rejected.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if no training row has
a language. Equal similarities go to the language that sorts first. Rows are independent; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventwarden.llm import words as w
from eventwarden.llm.jobs import BINARY, BOOLEAN, DOUBLE, INT, LONG, STRING, field, held_out, map_texts, prepared, staged

BUCKETS = 4096
SHIFT = 52
CENTROIDS = 4
FIT_ROWS = 300
FLOOR_QUANTILE = 0.005
FLOOR_SHARE = 0.7
UNKNOWN = "und"

_fold = np.full(256, 32, dtype=np.uint64)
_fold[97:123] = np.arange(97, 123)
_fold[65:91] = np.arange(97, 123)
_fold[0x80:] = np.arange(0x80, 0x100)
_ascii_letter = np.zeros(256, dtype=bool)
_ascii_letter[65:91] = _ascii_letter[97:123] = True


def counts(part: w.Slice) -> np.ndarray:
    """n-gram counts by document and bucket."""
    n = part.last - part.first
    data = _fold[part.data]
    doc = np.repeat(np.arange(n), np.diff(part.offsets))
    total = np.zeros(n * BUCKETS)
    code = data
    for size in (2, 3):
        if len(data) < size:
            break
        code = code[:len(data) - size + 1] * np.uint64(257) + data[size - 1:]
        inside = doc[:len(code)] == doc[size - 1:]
        bucket = ((code + np.uint64(size << 32)) * np.uint64(w.BASE)) >> np.uint64(SHIFT)
        total += np.bincount((doc[:len(code)] * BUCKETS + bucket.astype(np.int64))[inside], minlength=n * BUCKETS)
    return total.reshape(n, BUCKETS)


def vectors(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = (np.log1p(counted) * idf).astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def clustered(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far apart, so equal input gives equal output."""
    centres = [rows.mean(axis=0)]
    centres[0] /= max(np.linalg.norm(centres[0]), 1e-9)
    while len(centres) < min(k, len(rows)):
        nearest = np.max(rows @ np.stack(centres).T, axis=1)
        centres.append(rows[int(np.argmin(nearest))])
    centres = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        centres = np.stack([rows[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


class Model(NamedTuple):
    idf: np.ndarray
    centres: np.ndarray
    languages: list[str]
    owner: np.ndarray
    floor: np.ndarray


def _frequencies(rows: DataFrame) -> DataFrame:
    """Documents per bucket, summed within tasks; bucket -1 counts documents."""
    schema = T.StructType([field("bucket", INT), field("n", LONG)])

    def run(batches):
        held = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for part in w.slices(batch.column(0)):
                held[:BUCKETS] += (counts(part) > 0).sum(axis=0)
                held[BUCKETS] += part.last - part.first
        bucket = np.append(np.arange(BUCKETS), -1)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[held > 0].astype(np.int32)), pa.array(held[held > 0])],
                                         names=schema.names)

    return rows.select("text").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from text and language of rows that are not held out."""
    prepared(documents.sparkSession)
    training = documents.filter("text is not null and lang is not null").filter(~held_out())
    idf = np.zeros(BUCKETS)
    found = {r.bucket: r.n for r in _frequencies(training).collect()}  # at most BUCKETS + 1 rows
    total = found.pop(-1, 0)
    for bucket in range(BUCKETS):
        idf[bucket] = np.log((1 + total) / (1 + found.get(bucket, 0))) + 1
    # rows whose id hashes low, about fit_rows a language: no sort, and no language is missed
    sizes = staged(training.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    draw = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20))
    chosen = training.select("doc_id", "lang", "text").join(sizes, "lang").filter(
        draw < F.lit(float(fit_rows)) / F.col("rows")).select("lang", "text")

    def make():
        def compute(part, _):
            rows = np.minimum(counts(part), 65535).astype(np.uint16)
            return [pa.array([r.tobytes() for r in rows], pa.binary())]
        return compute

    sample = map_texts(chosen, "text", [field("counts", BINARY)], make).toPandas().sort_values(["lang", "counts"])
    centres, languages, owner, floor = [], [], [], []
    for language, group in sample.groupby("lang", sort=True):
        rows = vectors(np.stack([np.frombuffer(c, dtype=np.uint16) for c in group["counts"]]).astype(np.float64), idf)
        rows = rows[np.linalg.norm(rows, axis=1) > 0.5]
        if len(rows):
            own = clustered(rows, CENTROIDS)
            centres.append(own)
            owner += [len(languages)] * len(own)
            floor.append(FLOOR_SHARE * float(np.quantile((rows @ own.T).max(axis=1), FLOOR_QUANTILE)))
            languages.append(language)
    return Model(idf, np.concatenate(centres) if centres else np.zeros((0, BUCKETS), dtype=np.float32), languages,
                 np.array(owner, dtype=np.int64), np.array(floor))


def has_letter(part: w.Slice, texts: pa.Array) -> np.ndarray:
    sums = np.zeros(len(part.data) + 1, dtype=np.int64)
    np.cumsum(_ascii_letter[part.data], out=sums[1:])
    some = np.diff(sums[part.offsets]) > 0
    for doc in np.flatnonzero(~some):
        text = texts[int(doc)].as_py()
        some[doc] = text is not None and any(c.isalpha() for c in text)
    return some


PREDICTED = [field("lang_pred", STRING), field("score", DOUBLE), field("rejected", BOOLEAN)]


def predicted(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The other columns of ``df`` with nearest language, cosine similarity and whether it is too far."""

    def make():
        def compute(part, texts):
            n = part.last - part.first
            if not model.languages:
                return [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.array([True] * n)]
            alike = vectors(counts(part), model.idf) @ model.centres.T
            best = np.argmax(alike, axis=1)
            score = np.clip(alike[np.arange(n), best].astype(np.float64), 0, 1)
            language = model.owner[best]
            known = has_letter(part, texts)
            score[~known] = 0.0
            names = [model.languages[i] if k else UNKNOWN for i, k in zip(language, known)]
            return [pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < model.floor[language]))]
        return compute

    return map_texts(df, text, PREDICTED, make)
