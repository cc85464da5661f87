"""Secret scans with structural confirmation.

Base patterns (assignments, access ids, long hex) are reported as they match. Beyond them, base64 and hex candidates
are decoded and reported only if their bytes parse: DER keys whose nested lengths add up, encrypted ones included, SSH wire
keys, OpenSSH key files, PEM blocks around any of these or around a cipher text with its header lines, and signed tokens
whose header names an algorithm.

Base64 may be wrapped: a run goes on over line breaks, written out or escaped as in JSON, with blanks and quotes around
them. A key states its own length, so a candidate is read at the places its headers name and nowhere else; a run may hold
several keys, at any place, and none is too long. Hex keys may begin at any digit of a run.

Defined results: null counts as the empty text, and a text without findings has the digest of the empty text. Texts
are scanned whole; only documents with a literal or run that a pattern needs are decoded to characters, which cannot
lose a match. Rows are independent, so repeated rows repeat their results; other columns pass through.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventwarden.llm.jobs import BOOLEAN, LONG, STRING, field, map_texts, prepared
from eventwarden.llm.spans import Span, digest, docs_with, docs_with_runs, joined, ordered, replaced, text_of
from eventwarden.llm.words import Slice

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "pem", "token", "key"]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST, ACCESS_LEAST, VALUE_LEAST = 24, 20, 6

# structural candidates
MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*KEY)-----")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
RUN_LEAST = 24
# a line break inside base64, as it is or escaped, with what editors and quoting put around it
BREAK = r"""[\x20\t]*["']?[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*["']?"""
SEGMENT = "[A-Za-z0-9+/_-]+"
RUN = re.compile(f"{SEGMENT}(?:{BREAK}{SEGMENT})*={{0,2}}")
WORDS_OF_RUN = re.compile(f"{BREAK}|{SEGMENT}")
HEX_RUN = re.compile(rf"[0-9A-Fa-f]{{{2 * HEX_LEAST},}}")
KEY_STARTS = re.compile(r"M[A-I]|AAAA|b3BlbnNzaC1rZXkt")
URL_ALPHABET = str.maketrans("-_", "+/")
ESCAPED_BREAK = re.compile(r"(?:\\+r)?\\+n")
CIPHER = re.compile(r"^DEK-Info:\x20*[A-Z0-9-]+,([0-9A-Fa-f]{16,})\s*$", re.MULTILINE)
# fixed values: key types and how many fields follow their name
SSH_FIELDS = {"ssh-rsa": 2, "ssh-dss": 4, "ssh-ed25519": 1, "ecdsa-sha2-nistp256": 2, "ecdsa-sha2-nistp384": 2, "ecdsa-sha2-nistp521": 2}
KEY_VALUES = 10  # no key structure has more at its top
OPENSSH = b"openssh-key-v1\0"


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return found


class Plain:
    """Bytes to be read at places."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at:at + n]


class Base64:
    """The bytes of a base64 text from some place on, decoded where they are read."""

    def __init__(self, text: str, start: int):
        self.text, self.start, self.size = text, start, (len(text) - start) * 3 // 4

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        chunk = self.text[self.start + at // 3 * 4:self.start + -(-(at + n) // 3) * 4]
        return base64.b64decode(chunk + "=" * (-len(chunk) % 4))[at % 3:at % 3 + n]


class Hex:
    """The bytes of a hex text from some place on."""

    def __init__(self, text: str, start: int):
        self.text, self.start, self.size = text, start, (len(text) - start) // 2

    def read(self, at: int, n: int) -> bytes:
        n = max(min(n, self.size - at), 0)
        return bytes.fromhex(self.text[self.start + 2 * at:self.start + 2 * (at + n)])


Source = Plain | Base64 | Hex
DerValue = tuple[int, int, int]


def der_header(data: Source, at: int) -> DerValue | None:
    """Tag, start and end of the value at ``at``; None if the length is not a definite, minimal one."""
    head = data.read(at, 6)
    if len(head) < 2:
        return None
    tag, first = head[0], head[1]
    if first < 0x80:
        return tag, at + 2, at + 2 + first
    count = first & 0x7F
    if not 1 <= count <= 4 or len(head) < 2 + count:
        return None
    size = int.from_bytes(head[2:2 + count], "big")
    if size < 0x80 or head[2] == 0:
        return None
    return tag, at + 2 + count, at + 2 + count + size


def der_values(data: Source, start: int, end: int, most: int | None = None) -> list[DerValue] | None:
    """The values that fill ``start`` to ``end`` exactly, ``most`` of them if given."""
    values = []
    while start < end:
        head = der_header(data, start)
        if head is None or head[2] > end or len(values) == most:
            return None
        values.append(head)
        start = head[2]
    return values


def _key_values(data: Source, values: list[DerValue]) -> bool:
    """Whether the top values are those of a key: PKCS#1, PKCS#8, its encrypted form, SEC1 or subject public key info."""
    tags = [v[0] for v in values]
    named = lambda value: bool(inner := der_values(data, *value[1:], 2)) and inner[0][0] == 0x06
    if tags[0] == 0x02:
        version = data.read(values[0][1], values[0][2] - values[0][1]) if values[0][2] - values[0][1] <= 4 else None
        if len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return version in (b"\0", b"\1")
        if tags[1:3] == [0x30, 0x04]:
            return version in (b"\0", b"\1") and named(values[1])
        return tags[1:2] == [0x04] and version == b"\1" and tags[2:3] in ([], [0xA0], [0xA1])
    if tags == [0x30, 0x03]:
        return named(values[0]) and data.read(values[1][1], 1) == b"\0"
    return tags == [0x30, 0x04] and named(values[0]) and values[1][2] - values[1][1] >= 8


def der_extent(data: Source) -> int | None:
    """The length of the key structure at the beginning, with lengths that nest exactly; None if there is none."""
    head = der_header(data, 0)
    if head is None or head[0] != 0x30 or head[2] > data.size:
        return None
    first = der_header(data, head[1])
    if first is None or first[0] not in (0x02, 0x30):
        return None
    values = der_values(data, head[1], head[2], KEY_VALUES)
    if not values or not _key_values(data, values):
        return None
    pending = [v for v in values if v[0] & 0x20]
    while pending:
        _, start, end = pending.pop()
        inner = der_values(data, start, end)
        if inner is None:
            return None
        pending += [v for v in inner if v[0] & 0x20]
    return head[2]


def der_key(data: bytes) -> bool:
    return der_extent(Plain(data)) == len(data)


def ssh_extent(data: Source) -> int | None:
    """The length of the SSH key at the beginning, as its fields state it; None if there is none.

    Of a key file, the part that is there counts, as long as its header and the type of its first key are.
    """
    def after(at: int) -> int:
        return at + 4 + int.from_bytes(data.read(at, 4), "big")

    if data.read(0, len(OPENSSH)) == OPENSSH:
        at = len(OPENSSH)
        for _ in range(3):  # cipher, key derivation and its options
            at = after(at)
        keys, at = int.from_bytes(data.read(at, 4), "big"), at + 4
        if keys < 1 or at + 8 > data.size or _ssh_name(data, at + 4) is None:
            return None
        for _ in range(keys + 1):  # public keys, then the private part
            if at + 4 > data.size:
                break
            at = after(at)
        return min(at, data.size)
    name = _ssh_name(data, 0)
    if name is None:
        return None
    at = after(0)
    for _ in range(SSH_FIELDS[name]):
        if at + 4 > data.size:
            return None
        at = after(at)
    return at if at <= data.size else None


def _ssh_name(data: Source, at: int) -> str | None:
    size = int.from_bytes(data.read(at, 4), "big")
    name = data.read(at + 4, size).decode("latin-1") if 4 < size < 32 else ""
    return name if name in SSH_FIELDS else None


def ssh_key(data: bytes) -> bool:
    return ssh_extent(Plain(data)) == len(data)


def decoded(text: str) -> bytes | None:
    """Base64 in either alphabet, with or without padding."""
    text = text.rstrip("=").translate(URL_ALPHABET)
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Run:
    """A base64 run of a text from some place on: its signs without line breaks, and where they stand in the text."""

    def __init__(self, text: str, start: int):
        match = RUN.match(text, start)
        self.start, self.end = start, match.end()
        parts = [m for m in WORDS_OF_RUN.finditer(text, start, self.end) if m[0][0] not in " \t\"'\r\n\\"]
        self.places, self.at, held = [], [], 0
        for m in parts:
            self.places.append(m.start())
            self.at.append(held)
            held += len(m[0])
        self.signs = "".join(m[0] for m in parts).translate(URL_ALPHABET)

    def index(self, place: int) -> int:
        """The sign at a place of the text."""
        i = bisect_right(self.places, place) - 1
        return self.at[i] + place - self.places[i]

    def place(self, index: int) -> int:
        """Where the text goes on after ``index`` signs; after all of them, behind the padding."""
        if index >= len(self.signs):
            return self.end
        i = bisect_right(self.at, index - 1) - 1
        return self.places[i] + index - self.at[i]


def key_runs(text: str) -> list[Span]:
    """Keys in base64 runs, wrapped or not."""
    found: list[Span] = []
    run, done = None, 0
    for m in KEY_STARTS.finditer(text):
        if m.start() < done:
            continue
        if run is None or m.start() >= run.end:
            run = Run(text, m.start())
        start = run.index(m.start())
        if len(run.signs) - start < RUN_LEAST:
            continue
        data = Base64(run.signs, start)
        size = der_extent(data) if m[0][0] == "M" else ssh_extent(data)
        if size is not None and size >= HEX_LEAST:
            done = run.place(start + (4 * size + 2) // 3)
            found.append(("key", m.start(), done))
    return found


def hex_keys(text: str) -> list[Span]:
    """DER keys in hex runs, from any digit on."""
    found: list[Span] = []
    for m in HEX_RUN.finditer(text):
        at = m[0].find("30")
        while at >= 0:
            size = der_extent(Hex(m[0], at))
            if size is not None and size >= HEX_LEAST:
                found.append(("key", m.start() + at, m.start() + at + 2 * size))
                at += 2 * size - 1
            at = m[0].find("30", at + 1)
    return found


def pem_blocks(text: str) -> list[Span]:
    """Blocks between two marks of one name that follow each other, around a key or an encrypted one."""
    found: list[Span] = []
    opened = None
    for m in MARK.finditer(text):
        if m[1] == "END" and opened is not None and opened[2] == m[2]:
            if pem_body(ESCAPED_BREAK.sub("\n", text[opened.end():m.start()]), m[2]):
                found.append(("pem", opened.start(), m.end()))
        opened = m if m[1] == "BEGIN" else None
    return found


def pem_body(body: str, name: str) -> bool:
    lines = [x.strip(" \t\r\"',\\") for x in body.split("\n")]
    data = decoded("".join(x for x in lines if ":" not in x))  # lines with a colon are headers of the block
    if not data:
        return False
    if der_extent(Plain(data)) == len(data) or ssh_extent(Plain(data)) is not None:
        return True
    # under the older scheme of encryption the header names the cipher, and the rest is whole cipher blocks
    header = "\n".join(x for x in lines if ":" in x)
    return name.endswith("PRIVATE KEY") and "4,ENCRYPTED" in header and bool(CIPHER.search(header)) and len(data) % 8 == 0


def signed_token(header: str, payload: str) -> bool:
    try:
        head, body = json.loads(decoded(header) or b""), json.loads(decoded(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def confirmed_spans(text: str) -> list[Span]:
    found = pem_blocks(text)
    blocks = list(found)
    for m in SIGNED.finditer(text):
        if signed_token(m[1], m[2]):
            found.append(("token", *m.span()))
    starts = [b[1] for b in blocks]
    for span in key_runs(text) + hex_keys(text):
        before = bisect_right(starts, span[1])
        if not before or span[1] >= blocks[before - 1][2]:  # a block stands for the key in it
            found.append(span)
    return found


def spans_of(text: str) -> list[Span]:
    return ordered(base_spans(text) + confirmed_spans(text), KINDS)


LITERALS = [b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia", b"-----begin "]
SIGNED_LITERALS = [b"eyJ", b"eyA", b"eyI", b"ewo", b"ew0", b"ewk"]
_hex = np.zeros(256, dtype=bool)
_hex[list(b"0123456789abcdef")] = True
_run = np.zeros(256, dtype=bool)
_run[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True


def suspects(part: Slice) -> list[int]:
    """Documents that hold something a pattern needs."""
    raw = part.data.tobytes()
    found = docs_with(part, raw.lower(), LITERALS) | docs_with(part, raw, SIGNED_LITERALS)
    found |= docs_with_runs(part, _hex[part.data], HEX_LEAST) | docs_with_runs(part, _run[part.data], RUN_LEAST)
    return sorted(found)


FIELDS = [field("n_assign", LONG), field("n_access", LONG), field("n_hex", LONG), field("base_sha256", STRING),
          field("spans", STRING)]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``df`` with counts, digest and spans of every row."""
    prepared(df.sparkSession)

    def make():
        nothing = digest("")

        def compute(part, column):
            n = part.last - part.first
            counts = np.zeros((3, n), dtype=np.int64)
            digests, spans = [nothing] * n, [""] * n
            for doc in suspects(part):
                found = spans_of(text_of(column, doc))
                if found:
                    base = [s for s in found if s[0] in BASE_KINDS]
                    for kind, _, _ in base:
                        counts[BASE_KINDS.index(kind), doc] += 1
                    digests[doc], spans[doc] = digest(joined(base)), joined(found)
            return [*(pa.array(c) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return compute

    return map_texts(df, text, FIELDS, make)


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with every secret replaced by its kind, and ``n_chars`` brought up to date where a text changed."""
    prepared(documents.sparkSession)

    def make():
        def compute(part, column):
            out, changed = column.to_pylist(), np.zeros(part.last - part.first, dtype=bool)
            for doc in suspects(part):
                found = spans_of(out[doc] or "")
                if found:
                    out[doc] = replaced(out[doc], found, lambda kind, _: f"[{kind.upper()}]")
                    changed[doc] = True
            return [pa.array(out, pa.string()), pa.array(changed)]
        return compute

    others = [F.col(c) for c in documents.columns if c != "text"]
    rows = map_texts(documents.select(F.struct(*others).alias("row"), "text"), "text",
                     [field("new_text", STRING), field("changed", BOOLEAN)], make)
    count = F.when(F.col("changed"), F.length("new_text")).otherwise(F.col("row.n_chars")) if (
        "n_chars" in documents.columns) else None
    return rows.select(*(
        F.col("new_text").alias("text") if c == "text" else
        count.cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`")
        for c in documents.columns))
