"""Quality rules: text statistics, a fixed base rule, and an isolation forest over the statistics.

Statistics come from every whole text. The forest isolates a document by random splits of its statistics; documents
that few splits isolate are anomalous. Forest and threshold are fitted on a bounded sample of labelled rows
(``FIT_ROWS``): trees on ``TREE_ROWS`` random rows each, the threshold from the labels, so that at most
``FALSE_REJECTS`` of the good rows that pass the base rule lie beyond it and good and bad part best.

Defined results: null and empty texts have no words, fail the base rule and are not kept. Rows of one text get one
verdict; repeated rows stay. Without labels of both kinds only the base rule rejects. Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm import words as w
from eventwarden.llm.jobs import BOOLEAN, DOUBLE, LONG, field, map_texts, prepared

FIT_ROWS = 8192
TREES = 200
TREE_ROWS = 64
PRIOR_WORDS = 30
FALSE_REJECTS = 0.002
RULE_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _flags(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)
    table[list(characters)] = 1
    return table


SYMBOLS = _flags(b"#*$%&|<>")
UPPER = _flags(bytes(range(65, 91)))
LETTERS = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC2, 0xF5)))
MARKS = _flags(b"!?;:_~^=+@/\\{}[]()\"")
STARTS = np.ones(256, dtype=np.int32)
STARTS[0x80:0xC0] = 0


def _sum_between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[end] - sums[start]


def _repeat_words(words: w.Words, n: int) -> np.ndarray:
    """Words inside 5-word windows that occur twice or more in their document."""
    code, first = w.window_codes(words.code, words.doc, RULE_WINDOW)
    if not len(code):
        return np.zeros(n, dtype=np.int64)
    key = w.mixed(code ^ (words.doc[first].astype(np.uint64) * np.uint64(w.BASE)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:]
    step = np.zeros(len(words.code) + 1, dtype=np.int64)
    hit = first[order[same]]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + RULE_WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=n)


def _dup_lines(part: w.Slice, words: w.Words, n: int, sums: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    breaks = np.flatnonzero(part.data == 10)
    start = np.concatenate([part.offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, part.offsets[1:]])
    doc = np.concatenate([np.arange(n), np.searchsorted(part.offsets, breaks, side="right") - 1])
    # both lists by document and place, so that starts and ends pair up
    start, doc = start[np.lexsort((start, doc))], np.sort(doc)
    end_doc = np.concatenate([np.searchsorted(part.offsets, breaks, side="right") - 1, np.arange(n)])
    end = end[np.lexsort((end, end_doc))]
    worded = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[worded], end[worded], doc[worded]
    key = w.mixed(w.span_codes(sums, start, end) ^ (doc.astype(np.uint64) * np.uint64(w.BASE))
                  ^ ((end - start).astype(np.uint64) << np.uint64(40)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[1:] = key[order][1:] == key[order][:-1]
    return np.bincount(doc[order[again]], minlength=n)


def measure(part: w.Slice) -> dict[str, np.ndarray]:
    """The base counts and the raw counts behind the statistics, per document of a slice."""
    n = part.last - part.first
    lo, hi = part.offsets[:-1], part.offsets[1:]
    words = w.words_of(part, w.SPACED, w.PLAIN_VALUES)
    sums = w.prefix_codes(part.data, w.PLAIN_VALUES)
    starts = STARTS[part.data]
    order = np.lexsort((words.code, words.doc))
    code, doc = words.code[order], words.doc[order]
    fresh = np.ones(len(code), dtype=bool)
    fresh[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    n_words = w.per_doc(words.doc, n)
    return {
        "n_words": n_words,
        "word_chars": _sum_between(starts * w.SPACED[part.data], lo, hi),
        "n_symbols": _sum_between(SYMBOLS[part.data], lo, hi),
        "n_dup_lines": _dup_lines(part, words, n, sums),
        "n_repeat_words": _repeat_words(words, n),
        "chars": _sum_between(starts, lo, hi),
        "upper": _sum_between(UPPER[part.data], lo, hi),
        "letters": _sum_between(LETTERS[part.data], lo, hi),
        "marks": _sum_between(MARKS[part.data], lo, hi),
        "distinct": w.per_doc(doc[fresh], n),
        "short": np.bincount(words.doc[words.end - words.start <= 3], minlength=n),
    }


class Shares(NamedTuple):
    """What each statistic counts, and what it counts it against; one column per statistic."""

    counts: np.ndarray
    bases: np.ndarray


# a character share rests on about five characters per word
WEIGHTS = PRIOR_WORDS * np.array([1, 1, 1, 5, 5, 1, 1])
N_STATISTICS = len(WEIGHTS)


def shares(m: dict[str, np.ndarray]) -> Shares:
    """Rule statistics: shares, so that length alone never isolates a document."""
    n = np.maximum(m["n_words"], 1)
    return Shares(
        np.column_stack([m["word_chars"], m["n_symbols"], m["marks"], m["upper"], m["letters"], m["distinct"],
                         m["short"]]).astype(np.float64),
        # distinct words against what prose of this length has: Heaps' law with exponent 0.86
        np.column_stack([n, n, n, m["letters"], m["chars"], n ** 0.86, n]).astype(np.float64))


def statistics(s: Shares, prior: np.ndarray) -> np.ndarray:
    """Shares drawn towards the prior by ``PRIOR_WORDS`` words, so that a short text is no outlier by chance."""
    return ((s.counts + WEIGHTS * prior) / (s.bases + WEIGHTS)).astype(np.float32)


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def average_path(n) -> np.ndarray:
    """Mean depth at which an unsuccessful search of a binary tree of n keys ends."""
    n = np.maximum(np.asarray(n, dtype=np.float64), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))


class Forest(NamedTuple):
    """Per tree and node: split feature (-1 at leaves), split value, left child (right is next), path length at leaves."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: int
    normal: float


def grow_forest(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(rows))
    limit = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (limit + 1)
    feature = np.full((trees, nodes), -1, dtype=np.int64)
    value = np.zeros((trees, nodes), dtype=np.float32)
    child = np.zeros((trees, nodes), dtype=np.int64)
    path = np.zeros((trees, nodes), dtype=np.float32)
    for t in range(trees):
        pending = [(0, rng.choice(len(rows), size, replace=False), 0)]
        used = 1
        while pending:
            node, members, depth = pending.pop()
            part = rows[members]
            lo, hi = part.min(axis=0), part.max(axis=0)
            open_features = np.flatnonzero(hi > lo)
            if depth >= limit or len(members) <= 1 or not len(open_features):
                path[t, node] = depth + average_path(len(members))
                continue
            f = int(rng.choice(open_features))
            v = np.float32(rng.uniform(lo[f], hi[f]))
            left = part[:, f] <= v
            feature[t, node], value[t, node], child[t, node] = f, v, used
            pending += [(used, members[left], depth + 1), (used + 1, members[~left], depth + 1)]
            used += 2
    return Forest(feature, value, child, path, limit, float(average_path(size)))


def anomaly_scores(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """2 ** -(mean path / normal path): near 1 is isolated at once, below a half is ordinary."""
    total = np.zeros(len(rows))
    at = np.arange(len(rows))
    for feature, value, child, path in zip(forest.feature, forest.value, forest.child, forest.path):
        node = np.zeros(len(rows), dtype=np.int64)
        for _ in range(forest.depth):
            f = feature[node]
            inner = f >= 0
            step = child[node] + (rows[at, np.maximum(f, 0)] > value[node])
            node = np.where(inner, step, node)
        total += path[node]
    return 2.0 ** -(total / len(forest.feature) / max(forest.normal, 1e-9))


def calibrated(scores: np.ndarray, good: np.ndarray, false_rejects: float = FALSE_REJECTS) -> float:
    """The lowest threshold with few good rows above it, moved to the middle of the gap if nothing lies there."""
    if not good.any() or good.all():
        return np.inf
    floor = np.quantile(scores[good], 1 - false_rejects, method="higher")
    above = scores[~good & (scores > floor)]
    return float((floor + above.min()) / 2) if len(above) else float(np.nextafter(floor, np.inf))


class Model(NamedTuple):
    forest: Forest | None
    prior: np.ndarray
    threshold: float


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Prior, forest and threshold from the labelled documents with the ``fit_rows`` smallest hashes of their id."""
    prepared(documents.sparkSession)
    chosen = (labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)")
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most fit_rows rows
    columns = [f"{kind}{i}" for kind in ("count", "base") for i in range(N_STATISTICS)]

    def make():
        def compute(part, _):
            m = measure(part)
            return [pa.array(base_failed(m)), *(pa.array(np.ascontiguousarray(c)) for side in shares(m) for c in side.T)]
        return compute

    rows = map_texts(texts, "text", [field("failed", BOOLEAN), *(field(c, DOUBLE) for c in columns)], make).toPandas()
    rows = rows[~rows["failed"]].drop_duplicates().sort_values(["doc_id", *columns])
    good = rows["quality"].to_numpy() == 1
    none = np.zeros(N_STATISTICS)
    if len(rows) < 16 or good.all() or not good.any():
        return Model(None, none, np.inf)
    values = rows[columns].to_numpy()
    known = Shares(values[:, :N_STATISTICS], values[:, N_STATISTICS:])
    prior = known.counts[good].sum(axis=0) / np.maximum(known.bases[good].sum(axis=0), 1)
    points = statistics(known, prior)
    forest = grow_forest(points)
    return Model(forest, prior, calibrated(anomaly_scores(forest, points), good))


OUTPUT = [*(field(c, LONG) for c in COUNTS), field("base_failed", BOOLEAN), field("anomaly", DOUBLE),
          field("kept", BOOLEAN)]


def assess(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The other columns of ``df`` with counts, anomaly score and verdict of every row."""

    def make():
        def compute(part, _):
            m = measure(part)
            failed = base_failed(m)
            scores = (anomaly_scores(model.forest, statistics(shares(m), model.prior)) if model.forest
                      else np.zeros(part.last - part.first))
            kept = ~failed & (scores <= model.threshold)
            return [*(pa.array(m[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(scores),
                    pa.array(kept)]
        return compute

    return map_texts(df, text, OUTPUT, make)


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that are kept, with all their columns."""
    rows = documents.select(F.struct(F.col("*")).alias("row"), "text")
    return assess(rows, model).filter("kept").select("row.*")
