"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is its own hashed embedding and the sum of the hashed embeddings of its character 4-grams (with its
borders), squashed. The network reads windows of ``WINDOW`` words that overlap by half, over the whole text; a
document's score is that of its most toxic window. It is trained here, in numpy, on a bounded sample of labelled rows
that are not held out (``FIT_TOXIC`` and ``FIT_CLEAN`` documents, ``FIT_BYTES`` of text): embeddings start from the log
odds of their bucket, and every round trains on the worst window of each document as scored so far.

Defined results: null, empty and wordless texts score as an empty window: the network's answer to nothing, below 0.5.
Without labels of both kinds every score is 0. Rows are independent; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm import gru
from eventwarden.llm import words as w
from eventwarden.llm.jobs import DOUBLE, INT, field, held_out, map_texts, prepared

WINDOW, STRIDE = 24, 12
HIDDEN = 8
WORD_BUCKETS, WORD_SIZE = 1 << 14, 5
GRAM_BUCKETS, GRAM_SIZE, GRAM = 1 << 16, 5, 4
FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 2048, 4096, 16 << 20
ROUNDS, BATCH, LEAST_STEPS = 4, 256, 40
RATE = 0.02
PRIOR, LEAST_DOCS = 3.0, 5
EMBEDDING_RATE = 0.02
WINDOWS_AT_ONCE = 4096


class Vocabulary(NamedTuple):
    """Distinct words of a slice: the bucket of each word, and the buckets of its character grams, flat."""

    word: np.ndarray
    gram: np.ndarray
    gram_start: np.ndarray


def read(part: w.Slice) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The slice's vocabulary, the vocabulary index of each word in order, and where each document's words begin."""
    n = part.last - part.first
    words = w.words_of(part, w.ALNUM, w.FOLDED_VALUES)
    _, first, index = np.unique(words.code, return_index=True, return_inverse=True)
    start, end = words.start[first], words.end[first]
    # grams of border + word + border: a word of b bytes has b - 1 of them at length 4, and one at least
    size = np.maximum(end - start + 2 - GRAM + 1, 1)
    gram_start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(first)), size)
    at = np.arange(gram_start[-1]) - gram_start[owner] - 1
    code = np.zeros(len(owner), dtype=np.uint64)
    for j in range(GRAM):
        place = start[owner] + at + j
        inside = (at + j >= 0) & (place < end[owner])
        value = np.where(inside, w.FOLDED_VALUES[part.data[np.minimum(place, max(len(part.data) - 1, 0))]], np.uint64(1))
        code = code * np.uint64(w.BASE) + value
    gram = (w.mixed(code) & np.uint64(GRAM_BUCKETS - 1)).astype(np.int32)
    word = (words.code[first] & np.uint64(WORD_BUCKETS - 1)).astype(np.int32)
    return Vocabulary(word, gram, gram_start), index, w.word_bounds(words, n)


class Model(NamedTuple):
    params: gru.Params
    word: np.ndarray
    gram: np.ndarray


def inputs(model: Model, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Input vector per distinct word; and the squashed character part, for the backward pass."""
    if not len(v.word):
        return np.zeros((0, WORD_SIZE + GRAM_SIZE), dtype=np.float32), np.zeros((0, GRAM_SIZE), dtype=np.float32)
    squashed = np.tanh(np.add.reduceat(model.gram[v.gram], v.gram_start[:-1], axis=0))
    return np.concatenate([model.word[v.word], squashed], axis=1), squashed


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word (exclusive) and document of all windows; none for documents without words."""
    lengths = np.diff(bounds)
    number = np.where(lengths > 0, np.maximum(-(-(lengths - WINDOW) // STRIDE), 0) + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), number)
    nth = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(number)[:-1]]), number)
    first = bounds[doc] + nth * STRIDE
    return first, np.minimum(first + WINDOW, bounds[doc + 1]), doc


def steps(first: np.ndarray, last: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = first[:, None] + np.arange(WINDOW)
    mask = place < last[:, None]
    return index[np.minimum(place, len(index) - 1)], mask.astype(np.float32)


def window_logits(model: Model, v: Vocabulary, index: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    driven = gru.drive(model.params, inputs(model, v)[0])
    out = np.zeros(len(first), dtype=np.float32)
    for at in range(0, len(first), WINDOWS_AT_ONCE):
        part = slice(at, at + WINDOWS_AT_ONCE)
        word, mask = steps(first[part], last[part], index)
        out[part] = gru.logits(model.params, driven[word], mask)
    return out


def empty_logit(model: Model) -> float:
    """The answer to a window without words: no state, no attention, only the bias; never toxic."""
    return min(float(model.params["bias"][0]), -1.0)


def worst(logits: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest logit per document and the window that has it; -1 where there is none."""
    order = np.lexsort((-np.arange(len(doc)), logits, doc))
    top = order[np.concatenate([doc[order][1:] != doc[order][:-1], [True]])] if len(order) else order
    best, which = np.full(n, -np.inf), np.full(n, -1)
    best[doc[top]], which[doc[top]] = logits[top], top
    return best, which


def _held(buckets: np.ndarray, doc: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """Clean and toxic documents per bucket; a document counts once."""
    pairs = np.unique(doc.astype(np.int64) * size + buckets)
    owner, bucket = pairs // size, pairs % size
    return np.stack([np.bincount(bucket[toxic[owner] == y], minlength=size) for y in (False, True)])


def _log_odds(held: np.ndarray, rate: float) -> np.ndarray:
    """Log odds of a toxic document given the bucket, against all documents; 0 for buckets too rare to tell.

    A word of its own document alone would mark that document, and teach the network to trust rarity.
    """
    odds = np.log((held[1] + PRIOR * rate) / (held[0] + PRIOR * (1 - rate)) * (1 - rate) / rate)
    return np.where(held.sum(axis=0) >= LEAST_DOCS, odds, 0)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each size, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _part_of(v: Vocabulary, used: np.ndarray) -> Vocabulary:
    size = v.gram_start[used + 1] - v.gram_start[used]
    return Vocabulary(v.word[used], v.gram[_ranges(v.gram_start[used], size)], np.concatenate([[0], np.cumsum(size)]))


class _Texts:
    """Training texts in slices, so that only one slice's numbers are worked out at a time."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.toxic, self.slices = toxic, []
        for part in w.slices(pa.array(texts, pa.large_string())):
            v, index, bounds = read(part)
            self.slices.append((v, index, bounds, windows(bounds), part.first))

    def log_odds(self) -> tuple[np.ndarray, np.ndarray]:
        word, gram = np.zeros((2, WORD_BUCKETS), dtype=np.int64), np.zeros((2, GRAM_BUCKETS), dtype=np.int64)
        for v, index, bounds, _, first in self.slices:
            toxic = self.toxic[first:first + len(bounds) - 1]
            doc = np.repeat(np.arange(len(toxic)), np.diff(bounds))
            known = np.unique(doc * len(v.word) + index) if len(index) else doc
            doc, index = known // max(len(v.word), 1), known % max(len(v.word), 1)
            size = np.diff(v.gram_start)[index]
            word += _held(v.word[index], doc, toxic, WORD_BUCKETS)
            gram += _held(v.gram[_ranges(v.gram_start[index], size)], np.repeat(doc, size), toxic, GRAM_BUCKETS)
        rate = self.toxic.mean()
        return _log_odds(word, rate), _log_odds(gram, rate)

    def scored(self, score) -> tuple[np.ndarray, list[np.ndarray]]:
        """Best score per document, and per slice the windows that have it."""
        best, which = np.full(len(self.toxic), -np.inf), []
        for v, index, bounds, (first, last, owner), at in self.slices:
            top, place = worst(score(v, index, first, last) if len(first) else np.zeros(0), owner, len(bounds) - 1)
            best[at:at + len(top)] = top
            which.append(place)
        return best, which

    def chosen(self, which: list[np.ndarray], rng: np.random.Generator):
        """Vocabulary, word matrix, mask and label of the given windows and of one at random per clean document."""
        parts, words, masks, labels, base = [], [], [], [], 0
        for (v, index, bounds, (first, last, owner), at), place in zip(self.slices, which):
            toxic = self.toxic[at:at + len(place)]
            picked, label = place[place >= 0], toxic[place >= 0]
            clean = np.flatnonzero(~toxic[owner])
            extra = rng.choice(clean, min(len(clean), len(picked)), replace=False) if len(clean) else clean
            picked = np.concatenate([picked, extra])
            if not len(picked):
                continue
            word, mask = steps(first[picked], last[picked], index)
            used, inverse = np.unique(word, return_inverse=True)
            parts.append(_part_of(v, used))
            words.append(inverse.reshape(word.shape) + base)
            masks.append(mask)
            labels.append(np.concatenate([label, np.zeros(len(extra), dtype=bool)]))
            base += len(used)
        starts = np.cumsum([0, *(len(p.gram) for p in parts)])
        whole = Vocabulary(np.concatenate([p.word for p in parts]), np.concatenate([p.gram for p in parts]),
                           np.concatenate([*(p.gram_start[:-1] + s for p, s in zip(parts, starts)), starts[-1:]]))
        return whole, np.concatenate(words), np.concatenate(masks), np.concatenate(labels)


class _Step:
    """Adam over named arrays."""

    def __init__(self, rate: float):
        self.rate, self.moments, self.time = rate, {}, 0

    def apply(self, params: gru.Params, grads: gru.Params) -> None:
        self.time += 1
        for name, g in grads.items():
            first, second = self.moments.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            scale = np.sqrt(1 - 0.999 ** self.time) / (1 - 0.9 ** self.time)
            params[name] -= (self.rate * scale) * first / (np.sqrt(second) + 1e-7)


def trained(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Model | None:
    """A model from whole texts and their labels."""
    toxic = np.asarray(toxic, dtype=bool)
    if not len(texts) or toxic.all() or not toxic.any():
        return None
    rng = np.random.default_rng(seed)
    read_ = _Texts(texts, toxic)
    word = (0.1 * rng.standard_normal((WORD_BUCKETS, WORD_SIZE))).astype(np.float32)
    gram = (0.02 * rng.standard_normal((GRAM_BUCKETS, GRAM_SIZE))).astype(np.float32)
    word_odds, gram_odds = read_.log_odds()
    word[:, 0], gram[:, 0] = np.clip(word_odds, -1, 3), 0.3 * np.clip(gram_odds, -1, 3)
    model = Model(gru.initial(WORD_SIZE + GRAM_SIZE, HIDDEN, rng), word, gram)

    def evidence(v, index, first, last):
        x, _ = inputs(model, v)
        sums = np.concatenate([[0], np.cumsum(np.maximum(x[:, 0] + 2 * x[:, WORD_SIZE], 0)[index])])
        return sums[last] - sums[first]

    def answer(v, index, first, last):
        return window_logits(model, v, index, first, last)

    step = _Step(RATE)
    for number in range(rounds):
        # the first choice of windows: most evidence by the starting embeddings
        best, which = read_.scored(answer if number else evidence)
        if not np.isfinite(best).any():
            return None
        v, words, mask, label = read_.chosen(which, rng)
        balance = np.where(label, 0.5 / max(label.sum(), 1), 0.5 / max((~label).sum(), 1)) * len(label) / BATCH
        for _ in range(max(2, -(-LEAST_STEPS * BATCH // len(label)))):
            order = rng.permutation(len(label))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                _learn(model, step, v, words[rows], mask[rows], label[rows].astype(np.float32),
                       balance[rows].astype(np.float32))
    best, _ = read_.scored(answer)
    # the most toxic of many windows: move the bias to where the documents part best
    model.params["bias"][0] -= _parting(best[np.isfinite(best)], toxic[np.isfinite(best)])
    return model


def _parting(score: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold with the fewest errors, a clean document counting five times; in the middle of its gap."""
    order = np.argsort(score, kind="stable")
    ranked, label = score[order], toxic[order]
    # errors when everything from place i on is called toxic
    missed = np.concatenate([[0], np.cumsum(label)])
    wrong = np.concatenate([np.cumsum(~label[::-1])[::-1], [0]])
    cost = missed + 5 * wrong
    best = np.flatnonzero(cost == cost.min())
    at = int(best[len(best) // 2])
    low = ranked[at - 1] if at else ranked[0] - 1
    high = ranked[at] if at < len(ranked) else ranked[-1] + 1
    return float((low + high) / 2)


def _learn(model: Model, step: _Step, v: Vocabulary, word: np.ndarray, mask: np.ndarray, y, weight) -> None:
    used, inverse = np.unique(word, return_inverse=True)
    small = _part_of(v, used)
    size = np.diff(small.gram_start)
    x, squashed = inputs(model, small)
    inverse = inverse.reshape(word.shape)
    _, grads, d_x = gru.loss_gradients(model.params, x[inverse], mask, y, weight)
    for name, g in grads.items():
        np.clip(g, -1, 1, out=g)
    step.apply(model.params, grads)
    d_word = np.zeros_like(x)
    np.add.at(d_word, inverse.ravel(), d_x.reshape(-1, x.shape[1]))
    # the embeddings learn by plain steps: a bucket is seen too rarely for running moments
    np.add.at(model.word, small.word, -EMBEDDING_RATE * np.clip(d_word[:, :WORD_SIZE], -0.1, 0.1))
    d_gram = np.repeat(d_word[:, WORD_SIZE:] * (1 - squashed ** 2), size, axis=0)
    np.add.at(model.gram, small.gram, -EMBEDDING_RATE * np.clip(d_gram, -0.1, 0.1))


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    prepared(documents.sparkSession)
    known = (labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    ranked = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = ranked(1, FIT_TOXIC).union(ranked(0, FIT_CLEAN))
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    # one short row per distinct (document, text), as many as documents are asked for
    drawn = keyed.groupBy("doc_id", "text_key").agg(F.first(F.octet_length("text")).alias("size")).orderBy(
        F.xxhash64("doc_id"), "doc_id", "size", "text_key").limit(FIT_TOXIC + FIT_CLEAN).collect()
    fits, taken = [], 0
    for row in drawn:  # a text that does not fit is left out, and the next ones are taken
        if taken + row["size"] <= FIT_BYTES:
            taken += row["size"]
            fits.append((row.doc_id, row.text_key))
    if not fits:
        return None
    wanted = documents.sparkSession.createDataFrame(fits, "doc_id long, text_key long")
    texts = keyed.join(F.broadcast(wanted), ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = texts.toPandas().sort_values(["doc_id", "text"])  # FIT_BYTES at most
    return trained(sample["text"].tolist(), sample["toxic"].to_numpy() == 1)


SCORED = [field("score", DOUBLE), field("predicted", INT)]


def scored(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The other columns of ``df`` with the score of the most toxic window and the decision at 0.5."""

    def make():
        def compute(part, _):
            n = part.last - part.first
            score = np.zeros(n)
            if model is not None:
                v, index, bounds = read(part)
                first, last, doc = windows(bounds)
                best, which = worst(window_logits(model, v, index, first, last), doc, n)
                best[which < 0] = empty_logit(model)
                score = 1 / (1 + np.exp(-np.clip(best.astype(np.float64), -500, 500)))
            return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
        return compute

    return map_texts(df, text, SCORED, make)
