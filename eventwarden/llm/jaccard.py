"""N-gram Jaccard join: linked documents by exact similarity of their word-shingle sets.

1. Documents with equal sets form classes; everything below works on one set per class.
2. Two sets at similarity t or more share one of the first ``n - ceil(t * n) + 1`` of their shingles in any fixed
   order, so those are the candidate entries. The order puts shingles of crowded hash buckets last: shared passages
   then hardly ever make candidates. Buckets are counted over all documents; the table has ``BUCKETS`` rows at most.
   Two sets can share no more than what either has from their first common shingle on, so an entry stays only where that
   is enough with another one of its shingle; groups beyond ``PAIRED`` sets stay whole.
3. Signature trees over bitmaps (``trees.py``) of the sets that meet under a shingle leave out all sets that cannot
   reach the threshold with any other there; bitmaps are a sixteenth of a set's size.
4. The others' sets are compared by signature trees exactly, in two rounds: each set under its most shared shingle,
   once for all sets and once more for those that still meet other components. Both only save work for the last step.
5. Signature trees over the bitmaps of all that still meets across components tell which set has to visit which
   component; there it is compared with the members that it may be linked with, exactly. That covers every pair of sets
   that the rounds before have not joined, without listing pairs.

No group goes to one task whole: groups beyond ``GROUP_SETS`` sets or ``GROUP_TOKENS`` shingles are dealt out in
blocks, and the last step compares all pairs of blocks, members and visitors alike; that is quadratic in a hot group's
blocks, for sets that nothing has joined or ruled out before. Neither pairs nor components pass through the driver.

Defined results: null, empty and wordless texts have the empty set and link with nothing, each its own component. Fewer
than five words are one shingle. Repeated rows and repeated ids stay one row each. A component is named by its smallest
id. Extra columns are ignored. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventwarden.llm import words as w
from eventwarden.llm.components import labelled
from eventwarden.llm.decontaminate import FILTER_WORD
from eventwarden.llm.jobs import BINARY, INT, KEY, LONG, field, keys, prepared, staged, without
from eventwarden.llm.trees import Links, Marks, across, bitmaps, needed, width
from eventwarden.session import release

SHINGLE = 5
NUM, DEN = 80, 100
BUCKETS = 1 << 16
FILTER_BITS = (1 << 16, 1 << 25)
FILTER_SPARE = 16
# tokens of a crowded bucket of 2**(SALTED - 1) shingles or more are spread over so many places
SALTS, SALTED = 64, 17
GROUP_SETS = 2048
GROUP_TOKENS = 1 << 21
SEEN = 1 << 18
# groups of so many entries at most are looked through pair by pair before bitmaps are joined to them
PAIRED = 64


class Sets:
    """Shingle sets of a slice: sorted (document, code), bounds per document, and a hash of each whole set.

    With ``within``, a long per row, sets are told apart and meet only among rows of equal value.
    """

    def __init__(self, part: w.Slice, within: np.ndarray | None = None):
        self.n = part.last - part.first
        words = w.words_of(part, w.SPACED, w.FOLDED_VALUES)
        self.n_words = w.per_doc(words.doc, self.n).astype(np.int64)
        self.doc, self.code = w.shingle_sets(words, self.n, SHINGLE)
        self.bounds = np.searchsorted(self.doc, np.arange(self.n + 1))
        self.sizes = np.diff(self.bounds)
        sums = np.zeros(len(self.code) + 1, dtype=np.uint64)
        np.cumsum(w.mixed(self.code ^ np.uint64(w.BASE)), out=sums[1:])
        total = sums[self.bounds[1:]] - sums[self.bounds[:-1]]
        self.within = None if within is None else w.mixed(within.view(np.uint64) + np.uint64(w.BASE))
        self.ids = w.signed(self._apart(w.mixed(total + self.sizes.astype(np.uint64)), slice(None)))

    def _apart(self, code: np.ndarray, rows) -> np.ndarray:
        return code if self.within is None else w.mixed(code ^ self.within[rows])

    def tokens(self, doc: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What the shingles ``code`` of documents ``doc`` meet under."""
        return w.signed(self._apart(code, doc))

    def maps(self) -> list[bytes | None]:
        """Each set's bitmap at its own width; none for the empty set."""
        return [bitmaps([self.code[lo:hi]], width(hi - lo)).tobytes() if hi > lo else None
                for lo, hi in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())]


WITHIN = "within"


def _sets(batches):
    """(batch, slice, sets) of the rows of texts."""
    for batch in batches:
        at = batch.schema.get_field_index(WITHIN)
        within = None if at < 0 else batch.column(at).to_numpy()
        for part in w.slices(batch.column(batch.schema.get_field_index("text"))):
            yield batch, part, Sets(part, None if within is None else within[part.first:part.last])


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(48)).astype(np.int64)


def _sized(rows: DataFrame) -> DataFrame:
    """The other columns, n_words, set_id, n_shingles and bitmap per row; and (bucket, held) rows for buckets crowded in a task."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*others, field("n_words", LONG), field("set_id", LONG), field("n_shingles", LONG),
                           field("map", BINARY), field("bucket", INT), field("held", LONG)])

    def run(batches):
        held = np.zeros(BUCKETS, dtype=np.int64)
        kept: list[pa.Array] = []
        for batch, part, sets in _sets(batches):
            held += np.bincount(_bucket(sets.code), minlength=BUCKETS)
            kept = [batch.column(batch.schema.get_field_index(f.name)).slice(part.first, sets.n) for f in others]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sets.n_words), pa.array(sets.ids), pa.array(sets.sizes.astype(np.int64)),
                 pa.array(sets.maps(), pa.binary()), pa.nulls(sets.n, pa.int32()),
                 pa.nulls(sets.n, pa.int64())], names=schema.names)
        mean = held.mean()
        crowded = np.flatnonzero(held > mean + 8 * np.sqrt(mean) + 8)
        if len(crowded):
            n = len(crowded)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, c.type) for c in kept), *[pa.nulls(n, pa.int64())] * 3,
                 pa.nulls(n, pa.binary()), pa.array(crowded.astype(np.int32)), pa.array(held[crowded])], names=schema.names)

    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    return rows.mapInArrow(run, nullable)


def _fresh(seen: set, ids: np.ndarray) -> np.ndarray:
    """Sets that this task has not passed on yet; forgets now and then, which only costs repeats."""
    if len(seen) > SEEN:
        seen.clear()
    fresh = np.zeros(len(ids), dtype=bool)
    for i, x in enumerate(ids.tolist()):
        if x not in seen:
            seen.add(x)
            fresh[i] = True
    return fresh


def _entries(documents: DataFrame, crowding: np.ndarray) -> DataFrame:
    """(token, salt, set_id, n, place) for the prefix of every set, n and place as one long; only tokens of the fullest crowded
    buckets are salted."""
    ranks = documents.sparkSession.sparkContext.broadcast(crowding)  # BUCKETS bytes

    def run(batches):
        rank, seen = ranks.value, set()
        for _, _, sets in _sets(batches):
            fresh = _fresh(seen, sets.ids)
            use = fresh[sets.doc]
            doc, code = sets.doc[use], sets.code[use]
            order = w.by_doc(doc, np.argsort(rank[_bucket(code)], kind="stable"))  # codes are in order already
            doc, code = doc[order], code[order]
            place = np.arange(len(doc)) - np.searchsorted(doc, np.arange(sets.n))[doc]
            n = sets.sizes[doc]
            prefix = place < n - -(-NUM * n // DEN) + 1
            doc, code, n, place = doc[prefix], code[prefix], n[prefix], place[prefix]
            ids = sets.ids[doc]
            salt = np.where(rank[_bucket(code)] >= SALTED, 1 + (ids.view(np.uint64) % np.uint64(SALTS)).astype(np.int32), 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets.tokens(doc, code)), pa.array(salt.astype(np.int32)), pa.array(ids),
                 pa.array(n.astype(np.int64) << PLACE_BITS | place)], names=ENTRIES.names)

    return _texts(documents).mapInArrow(run, ENTRIES)


PLACE_BITS = 32
ENTRIES = T.StructType([field("token", LONG), field("salt", INT), field("set_id", LONG), field("spot", LONG)])


def _texts(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select(*(c for c in documents.columns if c in ("text", WITHIN, *more)))


def _matched(table: np.ndarray) -> np.ndarray:
    """Which entries (token, salt, set_id, n and place) of whole groups stay: those that may first meet a similar set here.

    All that two sets share lies at or behind the place of the first shingle they share, in both of them.
    """
    if not len(table):
        return np.zeros(0, dtype=bool)
    starts = np.flatnonzero(np.concatenate([[True], (table[1:, :2] != table[:-1, :2]).any(axis=1)]))
    sizes = np.diff(np.append(starts, len(table)))
    behind = np.repeat(starts + sizes, sizes) - np.arange(len(table))  # entries of the group from here on
    n = table[:, 3] >> PLACE_BITS
    rest = n - (table[:, 3] & ((1 << PLACE_BITS) - 1))
    large = np.repeat(sizes, sizes) > PAIRED
    stay = large | (table[:, 1] > 0)
    here = np.flatnonzero(~large)
    for step in range(1, PAIRED):
        here = here[behind[here] > step]
        if not len(here):
            break
        there = here + step
        alike = np.minimum(rest[here], rest[there]) >= needed(n[here], n[there], NUM, DEN)
        stay[here[alike]] = stay[there[alike]] = True
    return stay


def _meeting(entries: DataFrame) -> DataFrame:
    """Entries (token, set_id, n), without repeats, that may be similar to another one of their token; streams over
    sorted partitions.

    A salted token, which may be in any part of all sets, is spread over ``SALTS`` places; its entries all pass.
    """
    schema = T.StructType([field("token", LONG), field("set_id", LONG), field("n", INT)])

    def run(batches):
        held = np.zeros((0, 4), dtype=np.int64)
        for batch in batches:
            table = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1).astype(np.int64)
            table = np.concatenate([held, table])
            if not len(table):
                continue
            table = table[np.concatenate([[True], (table[1:, :3] != table[:-1, :3]).any(axis=1)])]
            # the last token may go on in the next batch: held back, or as much of it as tells that its group is large
            ending = (table[::-1, :2] == table[-1, :2]).all(axis=1)
            tail = len(table) if ending.all() else int(np.argmin(ending))
            ready, held = table[:-tail], table[-tail:]
            yield _rows(ready[_matched(ready)])
            if tail > PAIRED + 1:
                yield _rows(held[:-PAIRED - 1])
                held = held[-PAIRED - 1:]
        yield _rows(held[_matched(held)])

    def _rows(table):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(table[:, 0])), pa.array(np.ascontiguousarray(table[:, 2])),
             pa.array((table[:, 3] >> PLACE_BITS).astype(np.int32))], names=schema.names)

    return (entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "set_id").mapInArrow(run, schema))


def _without_twins(entries: DataFrame) -> DataFrame:
    """Of tokens held by the very same sets, only the smallest: the others would repeat its comparisons."""
    member = F.xxhash64("set_id")
    groups = entries.groupBy("token").agg(F.count("*").alias("sets"), F.bit_xor(member).alias("x"),
                                          F.sum(F.shiftright(member, 20)).alias("s"), F.sum("n").alias("tokens")).filter("sets > 1")
    kept = groups.groupBy("sets", "x", "s", "tokens").agg(F.min("token").alias("token")).select("token", "sets", "tokens")
    return entries.join(kept, "token")


def _possible(entries: DataFrame, maps: DataFrame) -> DataFrame:
    """(set_id) of the sets that some set they meet may be linked with; of large groups, every pair of blocks meets."""
    groups = entries.select("token", "set_id", "sets", "tokens").join(maps, "set_id")
    found = staged(_marked(_blocks(groups, last=False)), "possible")
    rest = groups.filter(F.greatest(F.col("sets") / GROUP_SETS, F.col("tokens") / GROUP_TOKENS) > 1)
    waiting = rest.join(found, "set_id", "left_anti").select("token").distinct()
    crossed = staged(_marked(_blocks(rest.join(waiting, "token"), last=True)), "possible-crossed")
    both = staged(found.union(crossed).distinct(), "possible-all")
    release(found)
    release(crossed)
    return both


def _marked(groups: DataFrame) -> DataFrame:
    schema = T.StructType([field("set_id", LONG)])

    def solved(rows):
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        maps = [np.frombuffer(r[2], dtype=np.uint64) for r in rows]
        return ids[Marks(np.array([r[1] for r in rows]), maps, NUM, DEN).found()] if len(rows) > 1 else ids[:0]

    def run(batches):
        for found in _solved(batches, 3, solved):
            ids = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids)], names=schema.names)

    return (groups.select("token", "a", "b", "set_id", "n", "map").repartition("token", "a", "b")
            .sortWithinPartitions("token", "a", "b").mapInArrow(run, schema).distinct())


def _solved(batches, columns: int, solve):
    """Streams over rows sorted by (token, a, b): per batch, what ``solve`` makes of the groups that end in it."""
    key, rows = None, []
    for batch in batches:
        out = []
        values = [batch.column(i).to_pylist() for i in range(3 + columns)]
        for token, a, b, *row in zip(*values):
            if (token, a, b) != key:
                if rows:
                    out.append(solve(rows))
                key, rows = (token, a, b), []
            rows.append(row)
        yield out
    if rows:
        yield [solve(rows)]


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    code = w.mixed(ids.view(np.uint64))
    return (code & np.uint64(bits - 1)).astype(np.int64), ((code >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit filter over ids, sized by their number within ``FILTER_BITS``; tasks fold it before it reaches the driver."""
    least, most = FILTER_BITS
    bits = min(max(least, 1 << (FILTER_SPARE * ids.count()).bit_length()), most)
    words = bits // FILTER_WORD
    schema = T.StructType([field("cell", INT), field("bits", LONG)])

    def run(batches):
        marks = np.zeros(bits, dtype=bool)
        for batch in batches:
            for place in _places(batch.column(0).to_numpy(), bits):
                marks[place] = True
        folded = marks.reshape(words, FILTER_WORD) @ (1 << np.arange(FILTER_WORD, dtype=np.int64))
        cell = np.flatnonzero(folded)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(folded[cell])],
                                         names=schema.names)

    folded = np.zeros(words, dtype=np.int64)
    for row in (ids.mapInArrow(run, schema).groupBy("cell").agg(F.bit_or("bits").alias("bits"))
                .toLocalIterator()):  # a row per FILTER_WORD bits at most
        folded[row.cell] = row.bits
    return ((folded[:, None] >> np.arange(FILTER_WORD)) & 1).astype(bool).reshape(-1)


def _chosen_sets(documents: DataFrame, passing: np.ndarray) -> DataFrame:
    """(set_id, codes) of the texts whose key passes the filter, once each; no other text is cut into shingles."""
    packed = documents.sparkSession.sparkContext.broadcast(np.packbits(passing))  # FILTER_BITS bits at most
    schema = T.StructType([field("set_id", LONG), field("codes", BINARY)])

    def run(batches):
        allowed, seen = np.unpackbits(packed.value).astype(bool), set()

        def wanted():
            for batch in batches:
                a, b = _places(batch.column(batch.schema.get_field_index("text_key")).to_numpy(), len(allowed))
                rows = batch.filter(pa.array(allowed[a] & allowed[b]))
                if rows.num_rows:
                    yield rows

        for _, _, sets in _sets(wanted()):
            use = np.flatnonzero(sets.sizes > 0)
            use = use[_fresh(seen, sets.ids[use])]
            codes = [sets.code[sets.bounds[i]:sets.bounds[i + 1]].tobytes() for i in use]
            yield pa.RecordBatch.from_arrays([pa.array(sets.ids[use]), pa.array(codes, pa.binary())],
                                             names=schema.names)

    return _texts(documents, "text_key").mapInArrow(run, schema).groupBy("set_id").agg(F.first("codes").alias("codes"))


def _blocks(groups: DataFrame, last: bool) -> DataFrame:
    """Rows (token, set_id, label, sets, tokens) dealt out to blocks of bounded size, as (a, b) block pairs.

    The rounds compare inside blocks only; with ``last``, every pair of blocks meets.
    """
    count = F.greatest(F.ceil(F.col("sets") / GROUP_SETS), F.ceil(F.col("tokens") / GROUP_TOKENS)).cast("int")
    rows = groups.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    if not last:
        return rows.withColumn("a", F.col("block")).withColumn("b", F.col("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("other", other).withColumn("a", F.least("block", "other")).withColumn(
        "b", F.greatest("block", "other"))


def _links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct (a, b) pairs of component labels that some group's tree joins."""
    schema = T.StructType([field("a", LONG), field("b", LONG)])

    def solved(rows):
        labels, codes = [r[0] for r in rows], [np.frombuffer(r[1], dtype=np.uint64) for r in rows]
        if len(set(labels)) < 2:
            return []
        return [(k, v) for k, v in Links(codes, labels, NUM, DEN).joined().items() if k != v]

    def run(batches):
        for found in _solved(batches, 2, solved):
            pairs = [pair for part in found for pair in part]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in range(2)],
                                             names=schema.names)

    rows = groups.select("set_id", "token", "a", "b", "label").join(sets, "set_id")
    return (rows.select("token", "a", "b", "label", "codes").repartition("token", "a", "b")
            .sortWithinPartitions("token", "a", "b").mapInArrow(run, schema).distinct())


def _visits(groups: DataFrame, maps: DataFrame) -> DataFrame:
    """Distinct (set_id, anchor): the components at which a set meets sets that bitmaps leave open, its own included."""
    schema = T.StructType([field("set_id", LONG), field("anchor", LONG)])

    def solved(rows):
        ids, labels, ranks, sizes = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
        place, anchor = across(sizes, [np.frombuffer(r[4], dtype=np.uint64) for r in rows], labels, ranks, NUM, DEN)
        return np.stack([ids[place], anchor])

    def run(batches):
        for found in _solved(batches, 5, solved):
            rows = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=schema.names)

    ranks = groups.select("label", "set_id").distinct().groupBy("label").agg(F.count("*").alias("rank"))
    rows = groups.select("set_id", "token", "a", "b", "label").join(ranks, "label").join(maps, "set_id")
    return (rows.select("token", "a", "b", "set_id", "label", "rank", "n", "map").repartition("token", "a", "b")
            .sortWithinPartitions("token", "a", "b").mapInArrow(run, schema).distinct())


def _hosted(visits: DataFrame) -> DataFrame:
    """Groups of a component's members and its visitors (set_id, anchor, label, n): both in blocks of bounded size, every
    two blocks once."""
    rows = visits.withColumn("own", F.col("label") == F.col("anchor"))
    number = lambda own: F.greatest(
        F.ceil(F.count_if(own) / GROUP_SETS), F.ceil(F.sum(F.when(own, F.col("n"))) / GROUP_TOKENS)).cast("int")
    blocks = rows.groupBy("anchor").agg(number(F.col("own")).alias("homes"), number(~F.col("own")).alias("guests")).filter(
        "homes > 0 and guests > 0")
    place = lambda n: F.array(F.pmod(F.xxhash64("set_id"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    met = rows.join(blocks, "anchor").withColumn("a", F.explode(F.when(F.col("own"), place("homes")).otherwise(every("homes"))))
    met = met.withColumn("b", F.explode(F.when(F.col("own"), every("guests")).otherwise(place("guests"))))
    return met.select(F.col("anchor").alias("token"), "set_id", "label", "a", "b")


def _relabelled(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    links = staged(links, f"{name}-links")
    if links.isEmpty():
        release(links)
        return labels
    merged = labelled(links).select(F.col("id").alias("label"), F.col("label").alias("to"))
    joined = staged(labels.join(merged, "label", "left").select("set_id", F.coalesce("to", "label").alias("label")), f"{name}-labels")
    release(links)
    release(labels)
    return joined


def _open_groups(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled entries of the tokens whose sets are still in two components or more."""
    labelled = entries.select("token", "set_id", "n").join(labels, "set_id")
    groups = (labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                            F.count("*").alias("sets"), F.sum("n").alias("tokens"))
              .filter("lo <> hi").select("token", "sets", "tokens"))
    return labelled.join(groups, "token").select("token", "set_id", "n", "label", "sets", "tokens")


def linked_sets(documents: DataFrame, sized: DataFrame) -> DataFrame:
    """(set_id, label): sets that meet others, and one label per component of links."""
    crowding = np.zeros(BUCKETS, dtype=np.uint8)
    for row in sized.filter("bucket is not null").groupBy("bucket").agg(F.sum("held").alias("held")).toLocalIterator():
        crowding[row.bucket] = int(row.held).bit_length()  # at most BUCKETS rows
    met = staged(_meeting(_entries(documents, crowding)), "met")
    meeting = staged(_without_twins(met), "meeting")
    release(met)
    maps = sized.filter("n_shingles > 0").groupBy("set_id").agg(F.first("map").alias("map"),
                                                                F.first("n_shingles").alias("n"))
    possible = _possible(meeting, maps)
    entries = staged(_without_twins(meeting.select("token", "set_id", "n").join(possible, "set_id")), "entries")
    release(meeting)
    release(possible)
    labels = staged(entries.select("set_id").distinct().withColumn("label", F.col("set_id")), "labels")
    texts = sized.filter("n_shingles > 0").select("set_id", "text_key").join(labels.select("set_id"), "set_id")
    chosen = staged(texts.select("text_key").distinct(), "chosen-texts")
    passing = _filter_of(chosen)
    release(chosen)
    sets = staged(_chosen_sets(documents, passing).join(labels.select("set_id"), "set_id"), "sets")

    labels = _joined_once(entries, labels, sets, "first")
    labels = _joined_once(entries, labels, sets, "second")
    opened = staged(_blocks(_open_groups(entries, labels), last=True), "open")
    visits = staged(_visits(opened, maps).join(labels, "set_id").join(maps.select("set_id", "n"), "set_id"), "visits")
    hosted = staged(_hosted(visits), "hosted")
    release(visits)
    release(opened)
    release(entries)
    last = _relabelled(labels, _links(hosted, sets), "last")
    release(hosted)
    release(sets)
    return last


def _joined_once(entries: DataFrame, labels: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Labels after comparing each set under the one open token that most sets share."""
    opened = staged(_open_groups(entries, labels), f"{name}-open")
    best = opened.groupBy("set_id").agg(F.max(F.struct("sets", "token")).alias("most")).select("set_id", "most.token")
    dealt = opened.select("token", "set_id", "n", "label").join(best, ["set_id", "token"])
    sizes = dealt.groupBy("token").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).filter("sets > 1")
    joined = _relabelled(labels, _links(_blocks(dealt.join(sizes, "token"), last=False), sets), name)
    release(opened)
    return joined


def _classes(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """(set_id, label): the component of every class of equal sets."""
    classes = sized.filter("n_shingles > 0").select("set_id").distinct()
    return staged(classes.join(linked_sets(rows, sized), "set_id", "left").select(
        "set_id", F.coalesce("label", "set_id").alias("label")), "classes")


def sets_of(rows: DataFrame) -> DataFrame:
    """``rows`` (with a ``text``) without their text, and n_words, set_id, n_shingles and bitmap of each; written once.

    A long column ``within`` keeps sets of different values apart. The table also holds what ``clusters`` has to know
    about all of them, in rows of their own with a ``bucket``.
    """
    prepared(rows.sparkSession)
    return staged(_sized(rows.withColumn("text_key", F.xxhash64("text"))), "sized")


def clusters(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """(set_id, label): the component of every class of equal sets; ``sized`` is what ``sets_of`` made of ``rows``."""
    return _classes(rows.withColumn("text_key", F.xxhash64("text")), sized)


def components(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    prepared(documents.sparkSession)
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sized = staged(_sized(rows), "sized")
    held = sized.filter("bucket is null").select("doc_id", "set_id", "n_shingles")
    classes = _classes(rows, sized)
    least = held.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    names = least.join(classes, "set_id").groupBy("label").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "label").select("set_id", "component_id")
    return held.join(named, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        .alias("component_id"))


def representatives(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns; wordless rows all stay.

    Rows without an id give way to linked rows that have one; of equal rows one stays.
    """
    prepared(documents.sparkSession)
    rows = documents.select("doc_id", *keys(), "text")
    sized = staged(_sized(rows), "sized")
    held = sized.filter("bucket is null and n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *KEY)
    chosen = (held.join(_classes(rows, sized), "set_id").groupBy("label").agg(F.min(order).alias("best"))
              .select("best.id_key", "best.text_key"))
    dropped = held.select(*KEY).distinct().join(chosen, KEY, "left_anti")
    left = without(documents, dropped)
    repeated = held.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").join(chosen, KEY).select(*KEY)
    return _once(left, staged(repeated, "repeated"))


def _once(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    """``documents`` with a single row for each repeated key."""
    if repeated.isEmpty():
        return documents
    tagged = documents.select(F.struct(F.col("*")).alias("row"), *keys())
    again = tagged.join(repeated, KEY).groupBy(*KEY).agg(F.first("row").alias("row")).select("row.*")
    return without(documents, repeated).unionByName(again)
