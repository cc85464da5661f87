"""Target-distribution importance resampling with a head-tail vocabulary.

Every run of one or two consecutive words is a feature; its bucket is the CRC-32 of its bytes modulo ``BUCKETS``. The share
of each bucket in a target table against its share in the documents gives a gain, a document's weight is the mean gain of
its features, and the documents with the highest weight plus a seeded Gumbel draw are taken.

Most words of a corpus are few: the head. Each task keeps mergeable counters (``Frequent``, ``COUNTERS`` of them) of its
words and word pairs, the merged ones name the ``HEAD`` most frequent words and pairs of all documents, and two tables of
fixed size are broadcast: for a frequent word its code and the exact CRC register after its bytes, for a frequent pair its
code and bucket. A feature of the tail takes the direct way, byte by byte, and a pair whose first word is frequent goes on
from that word's register. Head and tail give the same buckets, so the counters decide how fast a feature is counted,
never how. Bucket totals are exact sums over all features: one table of ``BUCKETS`` sums a task, added up by Spark.

Ranks come without one global sort: drawn rows are counted by score (a score is a whole number; weights and draws are
bounded, so there are at most some 110,000 of them), running sums over cells of ``CELL`` scores give the rank at which a
score begins, and ids are ordered inside a score.

Defined results: null texts have no features; without features the weight is 0. A null doc_id draws as the text '' and
comes last among equal scores. Rows that are equal in all results share their ranks in any order. Without a target or
without documents the gains follow from zero totals; an empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventwarden.llm import words as w
from eventwarden.llm.jobs import INT, LONG, field, map_texts, prepared, staged

BUCKETS = 10_000
PERCENT = 25
MIN_WORDS = 20
SEED = 7
HEAD = 1 << 12
COUNTERS = 1 << 14
SLOT_BITS = 16
DIRECT_BYTES = 64
CELL = 256
COPIES = 1 << 16

U32 = np.uint32
FULL = U32(0xFFFFFFFF)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _crc_steps() -> np.ndarray:
    """What each byte does to the register of CRC-32."""
    step = np.arange(256, dtype=U32)
    for _ in range(8):
        step = np.where(step & U32(1), (step >> U32(1)) ^ U32(0xEDB88320), step >> U32(1))
    return step


STEP = _crc_steps()


def crc_over(register: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC registers after the bytes of each span, all spans a byte at a time; very long ones on their own."""
    out, length = register.copy(), end - start
    left = np.flatnonzero(length > 0)
    for j in range(DIRECT_BYTES):
        if not len(left):
            return out
        held = out[left]
        out[left] = STEP[(held ^ data[start[left] + j]) & U32(0xFF)] ^ (held >> U32(8))
        left = left[length[left] > j + 1]
    for i in left.tolist():
        rest = data[start[i] + DIRECT_BYTES:end[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i] ^ FULL)) ^ 0xFFFFFFFF
    return out


class Head(NamedTuple):
    """Frequent words with their registers and frequent pairs with their buckets, by the leading bits of their codes."""

    word_code: np.ndarray
    register: np.ndarray
    pair_code: np.ndarray
    bucket: np.ndarray


def _slots(code: np.ndarray, value: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Tables of 2**SLOT_BITS slots; of codes (most frequent first) that share a slot the first stays."""
    size = 1 << SLOT_BITS
    # an empty slot holds a code that belongs to another one
    codes = (np.arange(size, dtype=np.uint64) ^ np.uint64(1)) << np.uint64(64 - SLOT_BITS)
    values = np.zeros(size, dtype=kind)
    place = (code >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    codes[place[::-1]], values[place[::-1]] = code[::-1], value[::-1]
    return codes, values


def head_of(words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> Head:
    """From (codes, registers) of words and (codes, buckets) of pairs, most frequent first."""
    return Head(*_slots(*words, U32), *_slots(*pairs, np.int32))


def _known(codes: np.ndarray, values: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = (code >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return codes[place] == code, values[place]


class Features:
    """Words and word pairs of a slice, and their buckets."""

    def __init__(self, part: w.Slice):
        self.n = part.last - part.first
        self.words = w.words_of(part, w.ALNUM, w.FOLDED_VALUES)
        self.data = LOWER[part.data]
        self.pair_code, self.pair_first = w.window_codes(self.words.code, self.words.doc, 2)

    def registers(self, which: np.ndarray) -> np.ndarray:
        """Direct registers of words."""
        return crc_over(np.full(len(which), FULL), self.data, self.words.start[which], self.words.end[which])

    def pair_buckets(self, first: np.ndarray, register: np.ndarray) -> np.ndarray:
        """Direct buckets of the pairs that begin with the given words, whose registers are known."""
        spaced = STEP[(register ^ U32(32)) & U32(0xFF)] ^ (register >> U32(8))
        return ((crc_over(spaced, self.data, self.words.start[first + 1], self.words.end[first + 1]) ^ FULL)
                % U32(BUCKETS)).astype(np.int32)

    def buckets(self, head: Head | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words and of the pairs, in text order."""
        code, n = self.words.code, len(self.words.code)
        register, bucket = np.zeros(n, dtype=U32), np.zeros(len(self.pair_code), dtype=np.int32)
        tail, tail_pairs = np.ones(n, dtype=bool), np.ones(len(bucket), dtype=bool)
        if head is not None:
            known, register = _known(head.word_code, head.register, code)
            known_pairs, bucket = _known(head.pair_code, head.bucket, self.pair_code)
            tail, tail_pairs = ~known, ~known_pairs
        tail, tail_pairs = np.flatnonzero(tail), np.flatnonzero(tail_pairs)
        register[tail] = self.registers(tail)
        first = self.pair_first[tail_pairs]
        bucket[tail_pairs] = self.pair_buckets(first, register[first])
        return ((register ^ FULL) % U32(BUCKETS)).astype(np.int32), bucket


class Frequent:
    """Counters of the most frequent codes: what occurs more often than once in ``COUNTERS`` features stays.

    Beyond ``COUNTERS`` codes all counts go down by the first one that has no counter left, which keeps two such tables
    mergeable by adding them.
    """

    def __init__(self):
        self.code, self.count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.value = np.zeros(0, dtype=np.int64)

    def add(self, code: np.ndarray, valued: Callable[[np.ndarray], np.ndarray]) -> None:
        """Count ``code``; ``valued`` computes the values of the codes at the given places."""
        fresh, first, n = np.unique(code, return_index=True, return_counts=True)
        merged, place = np.unique(np.concatenate([self.code, fresh]), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([self.count, n]), minlength=len(merged)).astype(np.int64)
        source = np.full(len(merged), -1)
        source[place[len(self.code):]] = first
        value = np.zeros(len(merged), dtype=np.int64)
        held = np.zeros(len(merged), dtype=bool)
        value[place[:len(self.code)]], held[place[:len(self.code)]] = self.value, True
        if len(merged) > COUNTERS:
            count -= np.partition(count, len(count) - COUNTERS - 1)[len(count) - COUNTERS - 1]
        new = np.flatnonzero((count > 0) & ~held)
        value[new] = valued(source[new])
        stays = count > 0
        self.code, self.count, self.value = merged[stays], count[stays], value[stays]


COUNTED = T.StructType([field("pair", INT), field("code", LONG), field("count", LONG), field("value", LONG)])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _frequent(texts: DataFrame, text: str) -> Head:
    """The head of all words and pairs: 2 * HEAD rows reach the driver."""

    def run(batches):
        kinds = Frequent(), Frequent()
        for batch in batches:
            for part in w.slices(_column(batch, text)):
                found = Features(part)
                if len(found.words.code):
                    kinds[0].add(found.words.code, found.registers)
                if len(found.pair_code):
                    first = found.pair_first
                    kinds[1].add(found.pair_code, lambda at: found.pair_buckets(first[at], found.registers(first[at])))  # noqa: B023
        for pair, counted in enumerate(kinds):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counted.code), pair, dtype=np.int32)), pa.array(w.signed(counted.code)),
                 pa.array(counted.count), pa.array(counted.value)], names=COUNTED.names)

    sums = staged(texts.select(text).mapInArrow(run, COUNTED).groupBy("pair", "code").agg(
        F.sum("count").alias("count"), F.min("value").alias("value")), "frequent")
    tables = []
    for pair in (0, 1):
        rows = sums.filter(F.col("pair") == pair).orderBy(F.desc("count"), "code").limit(HEAD).collect()
        tables.append((np.array([r.code for r in rows], dtype=np.int64).view(np.uint64),
                       np.array([r.value for r in rows], dtype=np.int64)))
    return head_of(*tables)


def _totals(texts: DataFrame, text: str, head) -> np.ndarray:
    """Features of all rows per bucket: BUCKETS sums."""
    schema = T.StructType([field("bucket", INT), field("held", LONG)])

    def run(batches):
        held = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in w.slices(_column(batch, text)):
                for bucket in Features(part).buckets(head.value):
                    held += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used])], names=schema.names)

    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in texts.select(text).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("held").alias("held")).collect():
        out[row.bucket] = row.held
    return out


def gains(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's share of the target against its share of the documents."""
    all_held, all_wanted = int(held.sum()), int(wanted.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (all_held + BUCKETS)) / float((s + 1) * (all_wanted + BUCKETS))))
                     for s, t in zip(held.tolist(), wanted.tolist())], dtype=np.int64)


def weighted(documents: DataFrame, target: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``documents`` but the text, with n_words, n_features and weight."""
    spark = prepared(documents.sparkSession)
    head = spark.sparkContext.broadcast(_frequent(documents, text))  # 4 tables of 2**SLOT_BITS entries
    gain = spark.sparkContext.broadcast(gains(_totals(documents, text, head), _totals(target, text, head)))  # BUCKETS longs

    def make():
        def compute(part, _):
            found = Features(part)
            word, pair = found.buckets(head.value)
            n_words = w.per_doc(found.words.doc, found.n).astype(np.int64)
            n_pairs = w.per_doc(found.words.doc[found.pair_first], found.n).astype(np.int64)
            total = np.zeros(found.n, dtype=np.int64)
            for bucket, n in ((word, n_words), (pair, n_pairs)):
                running = np.concatenate([[0], np.cumsum(gain.value[bucket])])
                last = np.cumsum(n)
                total += running[last] - running[last - n]
            n = n_words + n_pairs
            return [pa.array(n_words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))]
        return compute

    names = ("n_words", "n_features", "weight")
    clear = documents.select(*(c for c in documents.columns if c not in names))
    return map_texts(clear, text, [field(n, LONG) for n in names], make)


def _gumbel(doc_id: str, seed: int):
    """Thousandths of a Gumbel draw that depends on the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
              seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and its rank among the drawn ones (null if not drawn)."""
    rows = weighted(documents.select("doc_id", "text"), target)
    scored = rows.select("doc_id", "n_features", "weight", (F.col("weight") + _gumbel("doc_id", seed)).alias("score"),
                         (F.col("n_words") >= min_words).alias("fit"))
    # rows alike in all results are counted, and come back as so many rows at the end
    same = staged(scored.groupBy(*scored.columns).agg(F.count("*").alias("copies")), "scored")
    fine = same.filter("fit").groupBy("score").agg(F.sum("copies").alias("held")).withColumn(
        "cell", F.floor(F.col("score") / CELL))
    cells = fine.groupBy("cell").agg(F.sum("held").alias("held")).select(
        "cell", F.coalesce(F.sum("held").over(Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("above"))  # some 430 cells at most
    inside = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    begins = staged(fine.join(cells, "cell").select(
        "score", "held", (F.col("above") + F.coalesce(F.sum("held").over(inside), F.lit(0))).alias("above")), "begins")
    all_fit = begins.agg(F.sum("held").alias("n")).first().n or 0
    wanted = percent * all_fit // 100
    least = begins.filter(F.col("above") < wanted).agg(F.min("score").alias("score")).first().score
    if least is None:
        return _each(same.withColumn("before", F.lit(None).cast("long")), wanted)
    drawn = F.col("fit") & (F.col("score") >= least)
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (same.filter(drawn).join(begins.select("score", "above"), "score")
              .withColumn("before", F.col("above") + F.coalesce(F.sum("copies").over(order), F.lit(0))).drop("above"))
    others = same.filter(~drawn).withColumn("before", F.lit(None).cast("long"))
    return _each(placed.unionByName(others), wanted)


def _each(same: DataFrame, wanted: int) -> DataFrame:
    """As many rows as there are copies, numbered on from ``before``; lists of at most COPIES numbers."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
    number = F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + COPIES, F.col("copies")) - 1))
    rank = F.col("before") + F.col("number") + 1
    return same.select("*", chunk.alias("chunk")).select("*", number.alias("number")).select(
        "doc_id", "n_features", "weight", "score", F.when(rank <= wanted, rank).alias("rank"))
