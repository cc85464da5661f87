"""Source divergence audit by count-cell ranking.

How far the word use of a source departs from its language's, and from every other source's of that language. A term's
value depends on two counts alone, so terms are never scored one by one: they are grouped into cells of equal
(group count, language count), or (count here, count there) for a pair of sources, the value is computed once per cell,
and cells are what is ranked, by cumulative multiplicity. Cells of equal value merge; only the cells that begin before
the last wanted rank are expanded into terms, in UTF-8 order.

For pairs of sources, only terms that both have are paired, once for both directions. Cells with a zero on one side or
both follow by inclusion and exclusion from the sources' own count tables and the number of kept terms, so the work does
not grow with terms that a source lacks.

Texts are counted in tasks (``Tally``, at most ``TALLY`` entries at a time), and again by map-side aggregation; a source
with a third of all rows is spread by term. A kept term is one row with its counts by source: as many as its language has
sources, as the result has pairs. All arithmetic is exact: decimals where a product may exceed 64 bits.

Defined results: null text, lang and source are ''. A language without kept terms has value 0 for every pair of its
sources and no terms. Repeated rows are separate documents. Extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventwarden.llm import words as w
from eventwarden.llm.jobs import LONG, STRING, field, prepared, staged
from eventwarden.llm.resample import LOWER
from eventwarden.session import BROADCAST_LIMIT

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
TALLY = 1 << 18
BATCH = 1 << 14
BROADCASTS = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
# [^\x00-\x40\x5B-\x60\x7B-\x7F]+
LETTERS = w.class_table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

COUNTED = T.StructType([field("lang", STRING), field("source", STRING), field("term", STRING),
                        field("held", LONG), field("docs", LONG)])


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The given spans of UTF-8 bytes as a column."""
    length = end - start
    offsets = np.concatenate([[0], np.cumsum(length)])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[index]))


def _slice_counts(part: w.Slice, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, code, term, occurrences and documents of every distinct (group, term) of a slice."""
    found = w.words_of(part, LETTERS, w.FOLDED_VALUES)
    of = group[found.doc]
    order = np.lexsort((found.doc, found.code, of))
    doc, code, of = found.doc[order], found.code[order], of[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
    entry = np.flatnonzero(fresh)
    in_doc = fresh.copy()
    in_doc[1:] |= doc[1:] != doc[:-1]
    held = np.diff(np.append(entry, len(order))).astype(np.int32)  # a slice has fewer words than that
    docs = np.add.reduceat(in_doc, entry, dtype=np.int32) if len(entry) else held
    at = order[entry]
    return of[entry].astype(np.int32), code[entry], _strings(LOWER[part.data], found.start[at], found.end[at]), held, docs


class Tally:
    """Counts of distinct (group, term) over the slices of a task; given out when they are many."""

    def __init__(self):
        self.groups: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self.entries = 0

    def number(self, lang: list, source: list) -> np.ndarray:
        known = self.groups
        return np.array([known.setdefault(g, len(known)) for g in zip(lang, source)], dtype=np.int64)

    def add(self, part: w.Slice, group: np.ndarray) -> None:
        self.parts.append(_slice_counts(part, group))
        self.entries += len(self.parts[-1][0])
        if self.entries >= 2 * TALLY:
            self._merge()

    def _merge(self) -> None:
        of, code, term, held, docs = zip(*self.parts)
        of, code, held, docs = (np.concatenate(x) for x in (of, code, held, docs))
        key = w.mixed(code ^ w.mixed(of.astype(np.uint64) + np.uint64(w.BASE)))
        order = np.argsort(key, kind="stable")
        key = key[order]
        entry = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else [])
        at = order[entry]
        sums = [np.add.reduceat(x[order], entry, dtype=np.int64) if len(entry) else x.astype(np.int64) for x in (held, docs)]
        self.parts = [(of[at], code[at], pa.chunked_array(term, pa.string()).take(pa.array(at)).combine_chunks(), *sums)]
        self.entries = len(at)

    def full(self) -> bool:
        return self.entries >= TALLY

    def rows(self) -> pa.RecordBatch:
        """All counts; the tally is empty after that."""
        if self.parts:
            self._merge()
            (of, _, term, held, docs), = self.parts
        else:
            of, term, held, docs = np.zeros(0, dtype=np.int64), pa.array([], pa.string()), *[np.zeros(0, dtype=np.int64)] * 2
        names = [pa.array([g[i] for g in self.groups], pa.string()).take(pa.array(of)) for i in (0, 1)]
        self.__init__()
        return pa.RecordBatch.from_arrays([*names, term, pa.array(held), pa.array(docs)], names=COUNTED.names)


def _batches(rows: pa.RecordBatch):
    """``rows`` in batches of ``BATCH``: what the engine holds of a task's rows at once, whatever the tally's size."""
    for first in range(0, max(rows.num_rows, 1), BATCH):
        yield rows.slice(first, BATCH)


def _counted(documents: DataFrame) -> DataFrame:
    """(lang, source, term, held, docs): occurrences, and documents that have the term.

    Tasks hand on what is already added up, so it is dealt by term at once: a task's row per source and term, which the
    sums by source and by language after it then find in place.
    """

    def run(batches):
        tally = Tally()
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            lang, source = column("lang").to_pylist(), column("source").to_pylist()
            for part in w.slices(column("text")):
                tally.add(part, tally.number(lang[part.first:part.last], source[part.first:part.last]))
                if tally.full():
                    yield from _batches(tally.rows())
        yield from _batches(tally.rows())

    return documents.mapInArrow(run, COUNTED).repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("held").alias("held"), F.sum("docs").alias("docs"))


def _kept(documents: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, lang_held, spread): the kept terms with their counts, in all and by source."""
    return _counted(documents).groupBy("lang", "term").agg(
        F.sum("held").alias("lang_held"), F.sum("docs").alias("docs"),
        F.array_sort(F.collect_list(F.struct("source", "held"))).alias("spread")).filter(F.col("docs") >= min_docs).drop("docs")


def _by_source(kept: DataFrame) -> DataFrame:
    return kept.select("lang", "term", "lang_held", F.inline("spread"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    below = F.nullif(total + terms, F.lit(0))
    div = lambda x, y: F.call_function("div", x, y)
    wide = div(F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), below.cast("decimal(19,0)"))
    return 1 + F.when(count < (1 << 63) // SCALE - 1, div(F.lit(SCALE).cast("long") * (count + 1), below)).otherwise(wide)


def _departure(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); shares stay below SCALE + 2, so squares fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language.

    With f(a, b) for the value of a term with counts a here and b there, the sum over all kept terms is that of
    f(a, b) - f(a, 0) - f(0, b) + f(0, 0) over the terms of both, of f(a, 0) - f(0, 0) over those here, of
    f(0, b) - f(0, 0) over those there, and of f(0, 0) over all.
    """
    zero, key = F.lit(0).cast("long"), ["lang", "source", "item"]
    paired = F.flatten(F.transform("spread", lambda x, i: F.transform(
        F.slice("spread", i + 2, F.size("spread")),
        lambda y: F.struct(x["source"].alias("source"), y["source"].alias("item"), x["held"].alias("a"), y["held"].alias("b")))))
    cells = kept.filter(F.size("spread") > 1).select("lang", F.inline(paired)).groupBy(*key, "a", "b").agg(
        F.count("*").alias("terms"))
    sized = groups.join(langs.select("lang", F.col("terms").alias("all_terms")), "lang").select(
        "lang", "source", "total", "all_terms", _share(zero, F.col("total"), F.col("all_terms")).alias("none"))
    here = sized.select("lang", "source", F.col("total").alias("here"), "all_terms", F.col("none").alias("p0"))
    there = sized.select("lang", F.col("source").alias("item"), F.col("total").alias("there"), F.col("none").alias("q0"))
    p0, q0, f = F.col("p0"), F.col("q0"), _departure
    p = _share(F.col("a"), F.col("here"), F.col("all_terms")).alias("p")
    q = _share(F.col("b"), F.col("there"), F.col("all_terms")).alias("q")
    p_, q_, n = F.col("p"), F.col("q"), F.col("terms").cast("decimal(19,0)")
    both = cells.join(here, ["lang", "source"]).join(there, ["lang", "item"]).select(*key, "terms", "p0", "q0", p, q)
    forth = F.sum((f(p_, q_) - f(p_, q0) - f(p0, q_) + f(p0, q0)).cast("decimal(19,0)") * n)
    back = F.sum((f(q_, p_) - f(q_, p0) - f(q0, p_) + f(q0, p0)).cast("decimal(19,0)") * n)
    shared = both.groupBy(*key).agg(forth.alias("forth"), back.alias("back")).select("lang", F.inline(F.array(
        F.struct("source", "item", F.col("forth").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))))
    own = _by_source(kept).groupBy("lang", "source", "held").agg(F.count("*").alias("terms"))
    pairs = staged(here.join(there, "lang").filter("source <> item"), "pairs")
    mine = own.withColumnRenamed("held", "a").join(pairs, ["lang", "source"]).select(*key, "terms", "p0", "q0", p)
    theirs = own.select("lang", F.col("source").alias("item"), F.col("held").alias("b"), "terms").join(
        pairs, ["lang", "item"]).select(*key, "terms", "p0", "q0", q)
    summed = lambda rows, x: rows.groupBy(*key).agg(F.sum(x.cast("decimal(19,0)") * n).alias("value"))
    whole = pairs.select(*key, (f(p0, q0).cast("decimal(19,0)") * F.col("all_terms").cast("decimal(19,0)")).alias("value"))
    parts = shared.unionByName(summed(mine, f(p_, q0) - f(p0, q0))).unionByName(summed(theirs, f(p0, q_) - f(p0, q0))).unionByName(whole)
    return parts.groupBy(*key).agg(F.coalesce(F.sum("value").cast("long"), zero).alias("value"))


def _terms(kept: DataFrame, groups: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank) of the terms that a source uses more than its language, to rank ``top``."""
    spread = _by_source(kept)
    cells = (spread.groupBy("lang", "source", "held", "lang_held").agg(F.count("*").alias("terms"))
             .join(groups.select("lang", "source", "total"), ["lang", "source"])
             .join(langs.select("lang", F.col("terms").alias("all_terms"), F.col("total").alias("lang_total")), "lang"))
    shared = cells.withColumn("p", _share(F.col("held"), F.col("total"), F.col("all_terms"))).withColumn(
        "q", _share(F.col("lang_held"), F.col("lang_total"), F.col("all_terms"))).filter("p > q")
    valued = staged(shared.select("lang", "source", "held", "lang_held", "terms",
                                  _departure(F.col("p"), F.col("q")).alias("value")), "cells")
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # a value has one term at least: the first ``top`` values hold every wanted rank
    first = merged.withColumn("place", F.row_number().over(by_value)).filter(F.col("place") <= top)
    before = F.coalesce(F.sum("terms").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = first.withColumn("before", before).filter(F.col("before") < top).select("lang", "source", "value", "before")
    chosen = valued.join(wanted, ["lang", "source", "value"]).select("lang", "source", "held", "lang_held", "value", "before")
    terms = spread.join(chosen, ["lang", "source", "held", "lang_held"])
    by_term = Window.partitionBy("lang", "source", "value").orderBy("term")
    placed = terms.withColumn("place", F.row_number().over(by_term)).filter(F.col("place") <= top)
    rank = (F.col("before") + F.col("place")).cast("int")
    return placed.select("lang", "source", F.col("term").alias("item"), "value", rank.alias("rank")).filter(F.col("rank") <= top)


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language, and the leading terms, per source."""
    spark = prepared(documents.sparkSession)
    for name in BROADCASTS:  # a table of terms takes ten times its compressed size in the driver
        spark.conf.set(name, BROADCAST_LIMIT)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = documents.select(blank("lang"), blank("source"), "text")
    kept = staged(_kept(rows, min_docs), "kept-terms")
    held = _by_source(kept).groupBy("lang", "source").agg(F.sum("held").alias("total"))
    zero = F.lit(0).cast("long")
    groups = staged(rows.select("lang", "source").distinct().join(held, ["lang", "source"], "left").withColumn(
        "total", F.coalesce("total", zero)), "groups")
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_held").alias("total"))
    langs = staged(groups.select("lang").distinct().join(vocabulary, "lang", "left").select(
        "lang", F.coalesce("terms", zero).alias("terms"), F.coalesce("total", zero).alias("total")), "langs")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(kept, groups, langs).withColumn("rank", F.row_number().over(by_value))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(
        _terms(kept, groups, langs, top).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
