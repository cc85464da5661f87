"""Benchmark decontamination by winnowing.

A text's fingerprints are, for every run of ``w`` consecutive k-word grams, the gram with the smallest hash (the
rightmost of equal ones). Two texts that share ``w + k - 1`` consecutive words select the same gram inside them, so
joining fingerprints finds every shared span of that length, and extending a hit by at most ``w - 1`` words each way
decides it. Items shorter than the span are matched whole, by a scheme of their own length.

A fixed-size bit filter of the benchmark's fingerprints (``FILTER_BITS``, whatever the size of either table) keeps the
documents' other fingerprints out of the join; a fuller filter lets more through and loses nothing. The join is by
fingerprint, left to adaptive execution: a passage in a third of all documents is split over many tasks.

Defined results: null and empty texts have no words and no hits, and items without words never occur. Rows equal in id
and text get equal results; repeated items count once; an item id that repeats with other texts counts once if any of
them occurs. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventwarden.llm import words as w
from eventwarden.llm.jobs import BINARY, INT, KEY, LONG, field, keys, map_texts, prepared, staged, without

SPAN = 13
GRAM = 8
FILTER_BITS = 1 << 22
FILTER_WORD = 32


def scheme(span: int) -> tuple[int, int]:
    """Gram length and window for shared spans of ``span`` words: gram + window - 1 = span."""
    window = min(SPAN - GRAM + 1, span)
    return span - window + 1, window


MARGIN = SPAN - GRAM
WIDTH = GRAM + 2 * MARGIN


def fingerprints(words: w.Words, n_docs: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected grams of every document: key and index of the first word."""
    k, window = scheme(span)
    code, first = w.window_codes(words.code, words.doc, k)
    n = len(code) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    doc = words.doc[first]
    best, offset = code[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, window):
        other = code[j:j + n]
        offset[other <= best] = j
        np.minimum(best, other, out=best)
    inside = doc[:n] == doc[window - 1:]
    place = (np.arange(n) + offset)[inside]  # never decreases: the rightmost of equal minima is taken
    place = place[np.diff(place, prepend=-1) > 0]
    return w.mixed(code[place] + np.uint64(span)), first[place]


def contexts(words: w.Words, at: np.ndarray, outside: int) -> np.ndarray:
    """Codes of the ``WIDTH`` words from ``MARGIN`` before each position; ``outside`` beyond the document."""
    index = at[:, None] + np.arange(-MARGIN, WIDTH - MARGIN)
    valid = (index >= 0) & (index < len(words.code))
    index = np.clip(index, 0, max(len(words.code) - 1, 0))
    valid &= words.doc[index] == words.doc[at][:, None]
    return np.where(valid, words.code[index], np.uint64(outside))


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key & np.uint64(FILTER_BITS - 1)).astype(np.int64), ((key >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


HITS = T.ArrayType(T.StructType([field("fp", LONG), field("pos", INT), field("span", INT), field("ctx", BINARY)]))


def _found(part: w.Slice, spans: list[int], passing: np.ndarray | None, outside: int) -> tuple[np.ndarray, pa.Array]:
    """Word counts, and per document the list of fingerprints that pass the filter."""
    n = part.last - part.first
    words = w.words_of(part, w.ALNUM, w.FOLDED_VALUES)
    bounds = w.word_bounds(words, n)
    lengths = np.diff(bounds)
    keys, places, kinds = [], [], []
    for span in spans:
        key, at = fingerprints(words, n, span)
        if passing is not None:
            a, b = _bits(key)
            ok = passing[a] & passing[b]
            key, at = key[ok], at[ok]
        elif span < SPAN:  # a short item is one window: only items of exactly this length
            ok = lengths[words.doc[at]] == span
            key, at = key[ok], at[ok]
        keys.append(key)
        places.append(at)
        kinds.append(np.full(len(at), span, dtype=np.int32))
    key, at, kind = np.concatenate(keys), np.concatenate(places), np.concatenate(kinds)
    order = np.argsort(at, kind="stable")
    key, at, kind = key[order], at[order], kind[order]
    doc = words.doc[at]
    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    ctx = contexts(words, at, outside) if len(at) else np.zeros((0, WIDTH), dtype=np.uint64)
    struct = pa.StructArray.from_arrays(
        [pa.array(w.signed(key)), pa.array((at - bounds[doc]).astype(np.int32)), pa.array(kind), _binary(ctx)],
        names=["fp", "pos", "span", "ctx"])
    return lengths, pa.ListArray.from_arrays(pa.array(offsets), struct)


def _printed(df: DataFrame, text: str, spans: list[int], passing: np.ndarray | None, outside: int) -> DataFrame:
    def make():
        def compute(part, _):
            lengths, hits = _found(part, spans, passing, outside)
            return [pa.array(lengths.astype(np.int64)), hits]
        return compute

    return map_texts(df, text, [field("n_words", LONG), field("hits", HITS)], make)


def _exploded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode("hits").alias("h")).select(*keep, "h.fp", "h.pos", "h.span", "h.ctx")


def _extended(joined: DataFrame) -> DataFrame:
    """Matching word runs around joined fingerprints that are long enough to hold a whole window."""
    kept = [f for f in joined.schema.fields if f.name not in ("fp", "pos", "span", "ctx", "item_ctx")]
    schema = T.StructType([*kept, field("s", INT), field("e", INT)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            read = lambda c: np.frombuffer(b"".join(get(c).to_pylist()), dtype=np.uint64).reshape(-1, WIDTH)
            same = read("ctx") == read("item_ctx")
            span, pos = get("span").to_numpy(), get("pos").to_numpy()
            window = np.minimum(SPAN - GRAM + 1, span)
            gram = span - window + 1
            column = np.arange(WIDTH)
            core = (column >= MARGIN) & (column < MARGIN + gram[:, None])
            left = np.cumprod(same[:, MARGIN - 1::-1], axis=1).sum(axis=1)
            after = np.where(column < MARGIN + gram[:, None], True, same)
            right = np.cumprod(after[:, MARGIN:], axis=1).sum(axis=1) - gram
            left, right = np.minimum(left, window - 1), np.minimum(right, window - 1)
            good = (same | ~core).all(axis=1) & (gram + left + right >= span)
            rows = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(f.name)) for f in kept]
                + [pa.array((pos - left)[good].astype(np.int32)), pa.array((pos + gram + right)[good].astype(np.int32))],
                names=[f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def hits(documents: DataFrame, benchmark: DataFrame, key: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All documents as (key columns, n_words), and runs of words they share with items as (key, item_id, s, e).

    ``key`` names the columns that tell documents apart; word positions are within the document, end exclusive.
    """
    spark = prepared(documents.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    short = sorted(r.n_words for r in _printed(items, "text", [SPAN], None, 1)
                   .filter(f"n_words between 1 and {SPAN - 1}").select("n_words").distinct().collect())
    spans = [*short, SPAN]  # SPAN values at most
    item_prints = staged(_exploded(_printed(items, "text", spans, None, 1), "item_id").distinct(), "item-prints")

    unsigned = lambda shift: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = item_prints.select(F.explode(F.array(unsigned(0), unsigned(32))).alias("bit"))
    cells = (bit.groupBy((F.col("bit") / FILTER_WORD).cast("long").alias("cell"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(bit % {FILTER_WORD} as int))")).alias("bits")))
    passing = np.zeros(FILTER_BITS, dtype=bool)
    for row in cells.toLocalIterator():  # at most FILTER_BITS / FILTER_WORD rows
        base = row.cell * FILTER_WORD
        passing[base:base + FILTER_WORD] = (row.bits >> np.arange(FILTER_WORD)) & 1 == 1
    packed = spark.sparkContext.broadcast(np.packbits(passing))  # FILTER_BITS bits

    def make():
        allowed = np.unpackbits(packed.value).astype(bool)

        def compute(part, _):
            lengths, found = _found(part, spans, allowed, 0)
            return [pa.array(lengths.astype(np.int64)), found]
        return compute

    read = staged(map_texts(documents, text, [field("n_words", LONG), field("hits", HITS)], make), "doc-prints")
    joined = (_exploded(read.filter(F.size("hits") > 0), *key)
              .join(item_prints.select("fp", "item_id", F.col("ctx").alias("item_ctx")), "fp"))
    return read.select(*key, "n_words"), _extended(joined).distinct()


def judged(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with its key, counts, items and verdict."""
    base, found = hits(documents.select("doc_id", *keys(), "text"), benchmark, ["doc_id", *KEY])
    return base.join(_summed(found, KEY), KEY, "left").select(
        "doc_id", *KEY, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("item_list", F.lit("")), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows, and the verdict."""
    return judged(documents, benchmark).drop(*KEY)


def cleaned(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return without(documents, judged(documents, benchmark).filter("contaminated").select(*KEY).distinct())


def _summed(found: DataFrame, key: list[str]) -> DataFrame:
    """Union length of a document's runs, and its items."""
    ordered = Window.partitionBy(*key).orderBy("s", "e")
    runs = found.select(*key, "s", "e").distinct().withColumn(
        "reached", F.coalesce(F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    covered = runs.groupBy(*key).agg(
        F.sum(F.greatest(F.col("e") - F.greatest("s", "reached"), F.lit(0))).alias("n_hit"))
    named = found.groupBy(*key).agg(
        F.count_distinct("item_id").alias("n_items"),
        F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("item_list"))
    return covered.join(named, key)
