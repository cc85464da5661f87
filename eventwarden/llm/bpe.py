"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's symbols are the leaves' left ends: leaf i holds the rank of the merge of symbol i with the next one (``NONE``
where the vocabulary has no such merge), and every node the smaller of its two children. The root is then the lowest rank
left in the word, and walking down to the left child wherever it holds that value finds its leftmost place. A merge
updates three leaves (the pair before, the merged one, the one that vanished), each in logarithmic time; the word is done
when the root is ``NONE``.

The vocabulary is a tokenizer file in JSON (BPE with word ends, bytes as letters): the driver reads it and broadcasts it,
so its size is bounded by the file. Texts are cut at added tokens, brought to the file's normal form (NFC, white space to
one space, lower case letter by letter) and split into words, as the file states; ``Vocabulary`` refuses files that
state anything else. No word spans white space, so a text is cut there first, and only chunks not seen before are split into
words. Each worker process keeps the ids of up to ``CACHE_WORDS`` words and ``CACHE_CHUNKS`` chunks of at most ``CACHE_CHARS``
characters. Signs that came into Unicode after Python's tables (15.1) are neither letters nor numbers here.

Defined results: null and empty texts have no ids and decode to the empty text. Ids outside the vocabulary decode to
nothing. Rows are independent of each other, so repeated rows get equal results; the other columns are passed on, and
an empty table has no rows. Words are merged whole, whatever their length.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from eventwarden.llm.jobs import INT, STRING, field, prepared

NONE = 1 << 60
PAIR_BITS = 20
CACHE_WORDS = 1 << 19
CACHE_CHUNKS = 1 << 19
CACHE_CHARS = 64

# Fixed values of the vocabulary file: its normal form, its word pattern, and the letters that stand for bytes.
NORMAL_FORM = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# letters and numbers that came into Unicode after the version of ``unicodedata`` split like other signs
WORD_LATER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[%s]]+|[\p{N}--[%s]]|[[^\s\p{L}\p{N}]||[%s]]+"
PRINTED = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The letter of each byte: itself where it prints, else the next free one from 256 on."""
    letters, free = [], 256
    for byte in range(256):
        prints = any(lo <= byte <= hi for lo, hi in PRINTED)
        letters.append(chr(byte if prints else free))
        free += not prints
    return letters


@functools.cache
def later_signs() -> str:
    """Ranges, as inside a set of a pattern, of the signs that ``regex`` counts as letters or numbers and ``unicodedata`` does not know."""
    counted = regex.compile(r"[\p{L}\p{N}]").match
    places = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn" and counted(chr(c))]
    starts = [c for i, c in enumerate(places) if not i or places[i - 1] != c - 1]
    ends = [c for i, c in enumerate(places) if i + 1 == len(places) or places[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


class PairTree:
    """The smallest of a row of ranks and its leftmost place, under point updates."""

    __slots__ = ("width", "node")

    def __init__(self, ranks: list[int]):
        width = self.width = 1 << max(len(ranks) - 1, 0).bit_length()
        node = self.node = [NONE] * width + ranks + [NONE] * (width - len(ranks))
        for i in range(width - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def least(self) -> int:
        return self.node[1]

    def leftmost(self) -> int:
        node, width, i = self.node, self.width, 1
        root = node[1]
        while i < width:
            i += i
            if node[i] != root:
                i += 1
        return i - width

    def put(self, place: int, rank: int) -> None:
        node, i = self.node, place + self.width
        node[i] = rank
        while i > 1:
            best = node[i ^ 1]  # the sibling
            if best < rank:
                rank = best
            i >>= 1
            if node[i] == rank:
                return
            node[i] = rank


class Vocabulary:
    """Ids, merges and splitting rules of a tokenizer file."""

    def __init__(self, content: bytes, later: str):
        file = json.loads(content)
        model, split = file["model"], file["pre_tokenizer"]["pretokenizers"]
        known = (file["normalizer"] == NORMAL_FORM and split[0]["pattern"] == {"Regex": WORD} and split[0]["invert"]
                 and split[1]["type"] == "ByteLevel" and not split[1]["add_prefix_space"]
                 and model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and file["decoder"] is None
                 and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]))
        if not known:
            raise ValueError("the file's normal form, word pattern or model is none that this operator knows")
        ids = model["vocab"]
        letters = byte_letters()
        self.inner = [ids[x] for x in letters]
        self.last = [ids[x + WORD_END] for x in letters]
        # a pair's key is one number: its left id, then PAIR_BITS bits for its right id
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[ids[a] << PAIR_BITS | ids[b]] = rank
            self.made.append(ids[a + b])
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens: list[str | None] = [None] * (1 + max(*ids.values(), *self.added.values()))
        for token, i in (ids | self.added).items():
            self.tokens[i] = token
        self.cut = regex.compile("(" + "|".join(sorted(map(regex.escape, self.added), key=len, reverse=True)) + ")")
        self.words = regex.compile(WORD).findall
        self.later = regex.compile(f"[{later}]").search if later else None
        self.words_later = regex.compile(WORD_LATER % (later, later, later), regex.V1).findall if later else None
        # ``str.split`` cuts at these four as well, which the file's pattern takes for signs
        self.separators = regex.compile("[\x1c-\x1f]").search
        self.spaced = regex.compile(r"\S+").findall
        # ids as the bytes of 32-bit numbers: the collector has nothing to visit in them
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first, the leftmost of equal ones first."""
        n, rank_of = len(symbols), self.ranks.get
        if n < 2:
            return symbols
        tree = PairTree([rank_of(a << PAIR_BITS | b, NONE) for a, b in zip(symbols, symbols[1:])])
        node, width, put, leftmost, made = tree.node, tree.width, tree.put, tree.leftmost, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while node[1] != NONE:
            i = leftmost()
            j = after[i]
            new = symbols[i] = made[node[1]]
            symbols[j] = -1
            k = after[i] = after[j]
            before[k] = i
            if k < n:
                if node[j + width] != NONE:
                    put(j, NONE)
                put(i, rank_of(new << PAIR_BITS | symbols[k], NONE))
            else:
                put(i, NONE)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] << PAIR_BITS | new, NONE)
                if node[h + width] != rank:
                    put(h, rank)
        return [s for s in symbols if s >= 0]

    def word_ids(self, word: str) -> bytes:
        """The ids of a word, kept for the next time if it is not too long."""
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        found = array("i", self.merged(symbols)).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of the words of a text without white space, kept like those of a word."""
        if chunk.isalpha():  # one word
            words = (chunk,)
        else:
            late = self.later and not chunk.isascii() and self.later(chunk)
            words = (self.words_later if late else self.words)(chunk)
        found = b"".join([self.known.get(word) or self.word_ids(word) for word in words])
        if len(chunk) <= CACHE_CHARS:
            if len(self.chunks) >= CACHE_CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def normal(self, text: str) -> str:
        """NFC, then lower case letter by letter: a capital sigma does not look at its neighbours."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def packed(self, text: str) -> bytes:
        """The ids of a text as the bytes of 32-bit numbers."""
        out: list[bytes] = []
        known = self.chunks.get
        parts = self.cut.split(text) if "<|" in text else [text]
        for part in parts:
            if part in self.added:
                out.append(array("i", [self.added[part]]).tobytes())
                continue
            part = self.normal(part)
            chunks = self.spaced(part) if self.separators(part) else part.split()
            out += [known(chunk) or self.chunk_ids(chunk) for chunk in chunks]
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def vocabulary(content: bytes, later: str) -> Vocabulary:
    """One per worker process, which keeps it with its words from task to task."""
    return Vocabulary(content, later)


def _mapped(rows: DataFrame, dropped: str, made: T.StructField, path: str, make) -> DataFrame:
    """The columns of ``rows`` but ``dropped`` and ``made``, which ``make(vocabulary)`` computes from ``dropped``."""
    spark = prepared(rows.sparkSession)
    with open(path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    later = later_signs()
    kept = [f for f in rows.schema.fields if f.name not in (dropped, made.name)]
    schema = T.StructType([*kept, made])

    def run(batches):
        compute = make(vocabulary(content.value, later))
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            out = compute(column(dropped))
            yield pa.RecordBatch.from_arrays([*(column(f.name) for f in kept), out.cast(to_arrow_type(made.dataType))],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


def _lists(lengths: list[int], values: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encoded(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The columns of ``documents`` but the text, and its token ids as ``ids``."""

    def make(known: Vocabulary):
        def compute(column):
            found = [known.packed(t or "") for t in column.to_pylist()]
            return _lists([len(x) // 4 for x in found], pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))
        return compute

    return _mapped(documents, text, field("ids", T.ArrayType(INT, False)), path, make)


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The columns of ``rows`` but the ids, and the tokens they stand for, joined by one space, as ``decoded``."""

    def make(known: Vocabulary):
        tokens = pa.array(known.tokens, pa.string())

        def compute(column):
            column = pc.fill_null(column, [])
            flat = column.flatten()
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
            named = tokens.take(pc.if_else(inside, flat, pa.scalar(None, flat.type)))
            lists = _lists(pc.list_value_length(column).to_pylist(), named)
            if named.null_count:
                lists = pa.array([[t for t in row if t is not None] for row in lists.to_pylist()], lists.type)
            return pc.binary_join(lists, " ")
        return compute

    return _mapped(rows, ids, field("decoded", STRING), path, make)
