"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

A token is a word, and every document ends in one marker token. Documents longer than a bin are cut into pieces that
fill bins of their own and a rest; nothing is dropped. Pieces are dealt by hash to shards of about ``SHARD_TOKENS``
tokens; a shard packs in one task, longest piece first. Its bins are kept by residual. A piece looks for the smallest
residual that fits it, and from there on to the successors until a bin without conflict is found; failing that it opens a
bin. Bitmaps over bin numbers say which bins have which residual, and which hold a given source slot or duplicate cluster,
so a residual's bins without conflict are found in one operation, however many bins a cluster is in.

Conflicts: two documents of one duplicate cluster, and two documents of one source slot. A cluster is a component of the
links of the exact n-gram join (``jaccard.py``) over the whole corpus, whatever shards its documents lie in: every pair of
similar documents is in one cluster, and so are documents joined by a chain of similar ones. Documents without a link have
no cluster. A caller who has clusters already gives them as ``clusters``. A source has one slot per document that its share
of the corpus gives it in two bins, so that even a source with a third of all rows cannot fill a bin alone, nor leaves bins
half empty.

Defined results: null and empty texts are one marker token. Pieces of a document follow in order of ``piece``. Rows that
repeat are packed each. Null sources count as one source. Extra columns are ignored; an empty table has no bins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventwarden.llm import jaccard
from eventwarden.llm.jobs import INT, LONG, field, prepared, staged

CAPACITY = 2048
SHARD_TOKENS = 1 << 22
TOKEN_BYTES = 6


def _clustered(sized: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with their duplicate cluster; null for rows that no other row is linked with."""
    held = sized.filter("bucket is null").select(
        "doc_id", "source", "n_words", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id"))
    classes = held.groupBy("set_id").agg(F.count("*").alias("held")).join(jaccard.clusters(rows, sized), "set_id")
    labelled = staged(classes, "set-labels")
    shared = labelled.groupBy("label").agg(F.sum("held").alias("rows")).filter("rows > 1").select("label")
    named = labelled.join(shared, "label").select("set_id", F.col("label").alias("cluster"))
    return held.join(named, "set_id", "left").drop("set_id")


class Bins:
    """Open bins of one shard by residual; what conflicts is kept as bitmaps over bin numbers."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room = [0] * (capacity + 1)  # bit n of entry r: bin n has residual r
        self.levels = 0  # bit r: some bin has residual r
        self.open = 0  # bit n: bin n has room
        self.holders: dict[object, int] = {}  # bit n: bin n holds this source slot or cluster
        self.filled: list[int] = []

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """Bin and offset of a piece; it meets no other of its source or cluster there, where these are not 0 or None."""
        conflicts = [(kind, key) for kind, key in enumerate((source, cluster)) if key]
        blocked = 0
        for key in conflicts:
            blocked |= self.holders.get(key, 0)
        rest = self.levels >> size if self.open & ~blocked else 0
        room = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            room += step
            free = self.by_room[room] & ~blocked
            if free:
                number = (free & -free).bit_length() - 1
                return number, self._put(number, room, size, conflicts)
            rest >>= step + 1
            room += 1
        number = len(self.filled)
        self.filled.append(0)
        return number, self._put(number, self.capacity, size, conflicts)

    def _put(self, number: int, room: int, size: int, conflicts: list[tuple]) -> int:
        bit, start = 1 << number, self.filled[number]
        self.filled[number] += size
        for key in conflicts:
            self.holders[key] = self.holders.get(key, 0) | bit
        if start:
            self.by_room[room] ^= bit
            if not self.by_room[room]:
                self.levels ^= 1 << room
        left = room - size
        if left:
            self.by_room[left] |= bit
            self.levels |= 1 << left
            self.open |= bit
        elif start:
            self.open ^= bit
        return start


PLACED = T.StructType([field("doc_id", LONG), field("piece", INT), field("bin_id", LONG), field("bin_start", INT),
                       field("n_tokens", INT), field("first_token", LONG), field("source_slot", LONG),
                       field("cluster", LONG)])


def _packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """Streams over shards sorted longest piece first."""
    schema = T.StructType([pieces.schema["doc_id"], *PLACED.fields[1:]])

    def run(batches):
        shard, bins = None, None
        for batch in batches:
            out = [[], []]
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist()
                       for c in ("shard", "n_tokens", "source_slot", "cluster", "alone")}
            for number, size, slot, cluster, alone in zip(*columns.values()):
                if number != shard:
                    shard, bins = number, Bins(capacity)
                # a piece with no twin in its shard has no conflict to remember
                bin_, start = bins.place(size, (slot,), None if alone else (cluster,))
                out[0].append((number << 32) | bin_)
                out[1].append(start)
            kept = lambda c: batch.column(batch.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays(
                [kept("doc_id"), kept("piece"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                 kept("n_tokens"), kept("first_token"), kept("source_slot"), kept("cluster")], names=schema.names)

    return pieces.mapInArrow(run, schema)


def _shards(documents: DataFrame, shard_tokens: int) -> int:
    """How many shards hold about ``shard_tokens`` tokens each, by the bytes of all texts; three times that at most."""
    size = documents.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"), F.count("*").alias("held")).first()
    return max(1, -(-((size.bytes or 0) // TOKEN_BYTES + size.held) // shard_tokens))


def pack(documents: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS,
         clusters: DataFrame | None = None) -> DataFrame:
    """One row per piece: document, piece number, bin, start in the bin, tokens, first token in the document.

    ``clusters`` (doc_id, cluster), if given, are taken instead of those found here; one row per doc_id.
    """
    spark = prepared(documents.sparkSession)
    documents = documents.select("doc_id", "source", "text")
    shards = _shards(documents, shard_tokens)
    sized = jaccard.sets_of(documents)
    if clusters is None:
        found = _clustered(sized, documents)
    else:
        found = sized.filter("bucket is null").select("doc_id", "source", "n_words").join(
            clusters.select("doc_id", F.col("cluster").cast("long").alias("cluster")), "doc_id", "left")
    rows = staged(found.withColumn("length", F.col("n_words") + 1), "clustered")
    by_source = staged(rows.groupBy("source").agg(F.count("*").alias("held"), F.sum("length").alias("tokens")), "sources")
    total = by_source.agg(F.sum("held").alias("held"), F.sum("tokens").alias("tokens")).first()
    per_bin = capacity * (total.held or 0) / max(total.tokens or 0, 1)
    slots = by_source.select(
        "source", F.greatest(F.lit(1), F.ceil(2 * per_bin * F.col("held") / F.lit(max(total.held or 0, 1)))).alias("slots"))
    slotted = rows.join(slots, rows["source"].eqNullSafe(slots["source"])).select(
        "doc_id", "length", "cluster",
        F.xxhash64(F.coalesce(rows["source"].cast("string"), F.lit("")), rows["source"].isNull(),
                   F.pmod(F.xxhash64("doc_id"), "slots")).alias("source_slot"))
    number = F.ceil(F.col("length") / capacity)
    pieces = slotted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("piece"), number.alias("pieces")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "cluster", "source_slot",
        F.least(F.lit(capacity), F.col("length") - F.col("piece") * capacity).cast("int").alias("n_tokens"),
        (F.col("piece") * capacity).alias("first_token"),
        # pieces before the last one fill a bin of their own in any shard
        F.pmod(F.when(F.col("piece") < F.col("pieces") - 1, F.xxhash64("doc_id", "piece")).otherwise(F.xxhash64("doc_id")),
               F.lit(shards)).alias("shard"))
    repeated = pieces.filter("cluster is not null").groupBy("shard", "cluster").agg(F.count("*").alias("n")).filter(
        "n > 1").select("shard", "cluster", F.lit(False).alias("alone"))
    known = pieces.join(repeated, ["shard", "cluster"], "left").withColumn("alone", F.coalesce("alone", F.lit(True)))
    width = min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = known.repartition(width, "shard").sortWithinPartitions(
        "shard", F.desc("n_tokens"), "cluster", "source_slot", "doc_id", "piece")
    return _packed(dealt, capacity)
