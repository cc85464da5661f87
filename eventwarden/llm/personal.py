"""Personal data: base patterns, and terms whose company in the corpus gives a protected entity away.

The method: an entity (one e-mail address, phone number, card or address of a host) has the information content
``log2(N / n_c)``; a term near it reveals ``log2(N * n_ct / (n_c * n_t))`` of that. All four count distinct texts, so
copies of a document change nothing: ``N`` all of them, ``n_t`` those holding the term, ``n_c`` those holding the entity,
``n_ct`` those with the term near it. Terms that reveal the share ``DISCLOSURE`` or more, in ``SUPPORT`` different
surroundings at least, are spans wherever they stand in a document that holds the entity, and are generalised to their
shape. An entity with fewer surroundings than that is judged by all it has: its terms need every one. All counts cover all documents; the second
pass counts only terms near some entity, picked by a bit filter of fixed size which never loses one.

Defined results: null counts as the empty text. Rows equal in id and text share their result and stay separate rows.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from eventwarden.llm import words as w
from eventwarden.llm.jaccard import _filter_of, _fresh, _places
from eventwarden.llm.jobs import BOOLEAN, INT, KEY, LONG, STRING, field, keys, map_texts, prepared, staged
from eventwarden.llm.spans import (Span, code_points_before, digest, docs_with, joined, ordered, replaced, text_of)

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "term"]
DISCLOSURE = 0.9
SUPPORT = 2
NEAR_WORDS = 8
TERM_CHARS = 3
FILTER_BITS = 1 << 22
FILTER_WORD = 32
TERMS_HELD = 1 << 18

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match always ends with its run of digits, so only the first digit of a run can begin one
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [2 * int(d) for d in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from each @ outwards: linear even in runs without spaces."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            found.append(("email", start, free))
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[Span]:
    found: list[Span] = emails(text)
    found += [("ip", *m.span()) for m in IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return ordered(found, KINDS)


_digit = np.zeros(256, dtype=np.int64)
_digit[list(b"0123456789")] = 1
IP_DIGITS = 4


def suspects(part: w.Slice) -> list[int]:
    """Documents with an @, or with as many digits as the shortest number needs."""
    sums = np.zeros(len(part.data) + 1, dtype=np.int64)
    np.cumsum(_digit[part.data], out=sums[1:])
    numbers = np.flatnonzero(np.diff(sums[part.offsets]) >= IP_DIGITS)
    return sorted(docs_with(part, part.data.tobytes(), [b"@"]) | set(numbers.tolist()))


def entity_value(kind: str, text: str) -> str:
    return f"{kind}:{text.lower()}" if kind == "email" else f"{kind}:{_digits(text) if kind != 'ip' else text}"


NEAR = T.ArrayType(T.StructType([field("entity", STRING), field("around", LONG), field("term", LONG),
                                 field("pair", LONG)]))
HITS = T.ArrayType(T.StructType([field("pair", LONG), field("entity", STRING), field("term", LONG), field("s", INT),
                                 field("e", INT)]))
SPANS = T.ArrayType(T.StructType([field("s", INT), field("rank", INT), field("e", INT)]))


def _doc_words(part: w.Slice, doc: int) -> tuple[w.Words, np.ndarray, np.ndarray]:
    """One document's words with their places in code points."""
    lo, hi = part.offsets[doc], part.offsets[doc + 1]
    alone = w.Slice(0, 1, part.data[lo:hi], np.array([0, hi - lo]))
    words = w.words_of(alone, w.ALNUM, w.FOLDED_VALUES)
    points = code_points_before(alone.data)
    return words, points[words.start], points[words.end]


def _free(start: np.ndarray, end: np.ndarray, spans: list[Span]) -> np.ndarray:
    """Words long enough for a term; words inside any entity are none."""
    free = end - start >= TERM_CHARS
    for _, s, e in spans:
        free[np.searchsorted(end, s, side="right"):np.searchsorted(start, e)] = False
    return free


def pair_codes(entity: str, terms: np.ndarray) -> np.ndarray:
    own = int.from_bytes(blake2b(entity.encode(), digest_size=8).digest(), "big")
    return w.signed(w.mixed(terms ^ np.uint64(own)))


def near_terms(words: w.Words, start: np.ndarray, end: np.ndarray, spans: list[Span], text: str) -> list[dict]:
    """Terms within ``NEAR_WORDS`` words of each entity, or one null."""
    free = _free(start, end, spans)
    rows = []
    for kind, s, e in spans:
        entity = entity_value(kind, text[s:e])
        before, after = int(np.searchsorted(end, s, side="right")), int(np.searchsorted(start, e))
        near = np.arange(max(0, before - NEAR_WORDS), min(len(start), after + NEAR_WORDS))
        near = near[free[near]]
        if not len(near):
            rows.append({"entity": entity, "around": 0, "term": None, "pair": None})
            continue
        codes = words.code[near]
        around = int(w.signed(w.mixed(codes * w._SCALES[:len(near)]).sum(keepdims=True))[0])
        rows += [{"entity": entity, "around": around, "term": t, "pair": p}
                 for t, p in zip(w.signed(codes).tolist(), pair_codes(entity, codes).tolist())]
    return rows


def _hits(documents: DataFrame, text: str, passing: np.ndarray) -> DataFrame:
    """Every place of a term in a document that holds its entity, for pairs that pass the filter."""
    packed = documents.sparkSession.sparkContext.broadcast(np.packbits(passing))

    def make():
        allowed = np.unpackbits(packed.value).astype(bool)

        def compute(part, column):
            hits = [[] for _ in range(part.last - part.first)]
            for doc in suspects(part):
                value = text_of(column, doc)
                spans = base_spans(value)
                if not spans:
                    continue
                words, start, end = _doc_words(part, doc)
                places = np.flatnonzero(_free(start, end, spans))
                for entity in {entity_value(k, value[s:e]) for k, s, e in spans}:
                    pairs = pair_codes(entity, words.code[places])
                    a, b = _places(pairs, len(allowed))
                    hit = allowed[a] & allowed[b]
                    at = places[hit]
                    hits[doc] += [{"pair": p, "entity": entity, "term": t, "s": x, "e": y} for p, t, x, y in zip(
                        pairs[hit].tolist(), w.signed(words.code[at]).tolist(), start[at].tolist(), end[at].tolist())]
            return [pa.array(hits, to_arrow_type(HITS))]
        return compute

    return map_texts(documents, text, [field("hits", HITS)], make)


def _read(documents: DataFrame, text: str) -> DataFrame:
    def make():
        def compute(part, column):
            n = part.last - part.first
            found, near = [[] for _ in range(n)], [[] for _ in range(n)]
            for doc in suspects(part):
                value = text_of(column, doc)
                spans = base_spans(value)
                if spans:
                    found[doc] = [{"s": s, "rank": KINDS.index(k), "e": e} for k, s, e in spans]
                    near[doc] = near_terms(*_doc_words(part, doc), spans, value)
            return [pa.array(found, to_arrow_type(SPANS)), pa.array(near, to_arrow_type(NEAR))]
        return compute

    return map_texts(documents, text, [field("found", SPANS), field("near", NEAR)], make)


def _term_documents(texts: DataFrame, packed, copied) -> DataFrame:
    """Distinct texts per term, for terms that pass the filter; counted within tasks before the shuffle.

    Rows (text_key, text); texts that pass the filter ``copied`` may have copies in other tasks and keep their key.
    """
    schema = T.StructType([field("term", LONG), field("text_key", LONG), field("n", LONG)])

    def told(terms, counts):
        return pa.RecordBatch.from_arrays([pa.array(w.signed(terms)), pa.nulls(len(terms), pa.int64()),
                                           pa.array(counts)], names=schema.names)

    def run(batches):
        allowed, again = (np.unpackbits(x.value).astype(bool) for x in (packed, copied))
        terms, counts, seen = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), set()
        for batch in batches:
            keys_ = batch.column(0).to_numpy()
            for part in w.slices(batch.column(1)):
                key = keys_[part.first:part.last]
                a, b = _places(key, len(again))
                many = again[a] & again[b]
                use = ~many
                use[many] = _fresh(seen, key[many])
                words = w.words_of(part, w.ALNUM, w.FOLDED_VALUES)
                hit = allowed[(words.code & np.uint64(FILTER_BITS - 1)).astype(np.int64)] & use[words.doc]
                code, doc = words.code[hit], words.doc[hit]
                order = np.lexsort((doc, code))
                code, doc = code[order], doc[order]
                fresh = np.ones(len(code), dtype=bool)
                fresh[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
                code, doc = code[fresh], doc[fresh]
                shared = many[doc]
                if shared.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w.signed(code[shared])), pa.array(key[doc[shared]]),
                         pa.array(np.ones(int(shared.sum()), dtype=np.int64))], names=schema.names)
                both = np.concatenate([terms, code[~shared]])
                weight = np.concatenate([counts, np.ones(int((~shared).sum()), dtype=np.int64)])
                terms, place = np.unique(both, return_inverse=True)
                counts = np.bincount(place, weights=weight, minlength=len(terms)).astype(np.int64)
                if len(terms) > TERMS_HELD:
                    yield told(terms, counts)
                    terms, counts = terms[:0], counts[:0]
        yield told(terms, counts)

    per_text = texts.mapInArrow(run, schema).groupBy("term", "text_key").agg(F.sum("n").alias("n"))
    once = F.when(F.col("text_key").isNull(), F.col("n")).otherwise(F.lit(1).cast("long"))
    return per_text.groupBy("term").agg(F.sum(once).alias("n_t"))


def disclosing(near: DataFrame, documents: DataFrame, text: str = "text", disclosure: float = DISCLOSURE,
               support: int = SUPPORT) -> DataFrame:
    """(entity, term) pairs beyond the threshold, from rows (key, entity, around, term) and the whole corpus."""
    spark = documents.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = documents.select(F.xxhash64(whole).alias("text_key"), whole.alias("text"))
    copies = staged(texts.groupBy("text_key").agg(F.count("*").alias("n")), "text-copies")
    total = F.lit(float(copies.count()))
    surroundings = near.select("entity", "around", "term").distinct()
    arounds = surroundings.select("entity", "around").distinct().groupBy("entity").agg(F.count("*").alias("arounds"))
    backed = (surroundings.filter("term is not null").groupBy("entity", "term").agg(F.count("*").alias("n_around"))
              .join(arounds, "entity").filter(F.col("n_around") >= F.least(F.lit(support), "arounds"))
              .select("entity", "term"))
    seen = near.select("entity", "term", "text_key").distinct()
    entities = seen.select("entity", "text_key").distinct().groupBy("entity").agg(F.count("*").alias("n_c"))
    together = seen.filter("term is not null").groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    # a term is in as many texts as it is near entities in, at least: what that rules out needs no counting
    least = (seen.filter("term is not null").select("term", "text_key").distinct()
             .groupBy("term").agg(F.count("*").alias("n_near")))
    pairs = staged(
        together.join(backed, ["entity", "term"])
        .join(entities, "entity").join(least, "term").withColumn("content", F.log2(total / F.col("n_c")))
        .withColumn("most", F.log2(total * F.col("n_ct") / (F.col("n_c") * F.col("n_near"))))
        .filter((F.col("content") > 0) & (F.col("most") >= disclosure * F.col("content"))), "term-pairs")
    bit = F.col("term").bitwiseAND(F.lit(FILTER_BITS - 1))
    cells = (pairs.select(bit.alias("bit")).groupBy((F.col("bit") / FILTER_WORD).cast("long").alias("cell"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(bit % {FILTER_WORD} as int))")).alias("bits")))
    passing = np.zeros(FILTER_BITS, dtype=bool)
    for row in cells.toLocalIterator():  # at most FILTER_BITS / FILTER_WORD rows
        base = row.cell * FILTER_WORD
        passing[base:base + FILTER_WORD] = (row.bits >> np.arange(FILTER_WORD)) & 1 == 1
    packed = spark.sparkContext.broadcast(np.packbits(passing))
    copied = spark.sparkContext.broadcast(np.packbits(_filter_of(copies.filter("n > 1").select("text_key"))))
    informed = pairs.join(_term_documents(texts, packed, copied), "term").withColumn(
        "revealed", F.log2(total * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))))
    return informed.filter(F.col("revealed") >= disclosure * F.col("content")).select("entity", "term")


def _told(documents: DataFrame) -> DataFrame:
    """Per document its key, its base spans, and all spans as (s, rank, e)."""
    rows, key = documents.select("doc_id", "text", *keys()), KEY
    read = staged(_read(rows, "text"), "entities")
    near = read.filter(F.size("near") > 0).select(*key, F.explode("near").alias("x")).select(*key, "x.*")
    pairs = staged(near.select("entity", "term", "pair").distinct().join(disclosing(near, rows), ["entity", "term"]),
                   "disclosing")
    hits = (_hits(rows.select(*key, "text"), "text", _filter_of(pairs.select("pair"))).filter(F.size("hits") > 0)
            .select(*key, F.explode("hits").alias("x")).select(*key, "x.*"))
    terms = (hits.join(pairs.select("entity", "term"), ["entity", "term"]).groupBy(*key).agg(F.collect_set(
        F.struct("s", F.lit(KINDS.index("term")).alias("rank"), "e")).alias("terms")))
    whole = F.when(F.col("terms").isNull(), F.col("found")).otherwise(F.array_sort(F.concat("found", "terms")))
    return read.join(terms, key, "left").select("doc_id", *key, "found", whole.alias("whole"))


def _text(spans) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["rank"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(documents: DataFrame) -> DataFrame:
    """One row per document: counts per kind, digest of the base spans, all spans."""
    prepared(documents.sparkSession)
    count = lambda kind: F.size(F.filter("found", lambda x: x["rank"] == KINDS.index(kind))).cast("long")
    return _told(documents).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_text(F.col("found")), 256).alias("base_sha256"), _text(F.col("whole")).alias("spans"))


SHAPES = [(re.compile(r"[0-9]+"), "[NUMBER]"), (re.compile(r"[A-Z].*", re.DOTALL), "[NAME]")]


def generalised(kind: str, old: str) -> str:
    if kind != "term":
        return f"[{kind.upper()}]"
    return next((mark for shape, mark in SHAPES if shape.fullmatch(old)), "[TERM]")


def sanitised(text: str, spans: list[Span]) -> str:
    """The text with entities and disclosing terms generalised."""
    return replaced(text, spans, generalised)


def sanitised_texts(documents: DataFrame) -> DataFrame:
    """The documents with every span generalised, and ``n_chars`` brought up to date where a text changed."""
    prepared(documents.sparkSession)
    found = _told(documents).filter(F.size("whole") > 0).groupBy(*KEY).agg(F.first("whole").alias("whole"))
    others = [F.col(c) for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*others).alias("row"), "text", *keys()).join(found, KEY, "left").select(
        "row", "text", "whole")
    schema = T.StructType([rows.schema["row"], field("new_text", STRING), field("changed", BOOLEAN)])

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            new = [sanitised(t, [(KINDS[x["rank"]], x["s"], x["e"]) for x in f]) if f else t for t, f in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()),
                                              pa.array([bool(f) for f in spans])], names=schema.names)

    count = F.when(F.col("changed"), F.length("new_text")).otherwise(F.col("row.n_chars")) if (
        "n_chars" in documents.columns) else None
    return rows.mapInArrow(run, schema).select(*(
        F.col("new_text").alias("text") if c == "text" else
        count.cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in documents.columns))
