"""IP parsing and classification as column expressions, v4 and v6."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_V6_CHARS = r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*(%[^%]+)?$"

# v4 ranges routed inside the organisation, and documentation ranges, which count as external.
INTERNAL_V4 = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10"]
DOCUMENTATION_V4 = ["192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24"]


def _prefixes(cidrs: list[str]) -> str:
    """One pattern for the dotted texts inside the ranges; a range ends inside at most one octet."""
    options = []
    for cidr in cidrs:
        base, bits = cidr.split("/")
        octets, full, rest = base.split("."), int(bits) // 8, int(bits) % 8
        pieces = [octets[i] for i in range(full)]
        if rest:
            low = int(octets[full])
            pieces.append("(?:" + "|".join(str(n) for n in range(low, low + 2 ** (8 - rest))) + ")")
        options.append(r"\.".join(pieces) + r"\.")
    return "^(?:" + "|".join(options) + ")"


_INTERNAL = _prefixes(INTERNAL_V4)
_DOCUMENTATION = _prefixes(DOCUMENTATION_V4)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_v4(ip: Column) -> Column:
    return F.coalesce(F.trim(ip).rlike(V4_PATTERN), F.lit(False))


def _hextets_of(text: Column) -> Column:
    """Eight hextets of a lower-case address without zone or dotted tail, or null."""
    def joined(halves: Column) -> Column:
        side = lambda i: F.filter(F.split(F.get(halves, F.lit(i)), ":"), lambda g: g != "")
        # an empty group next to a single colon makes the text invalid, so it is kept for the check below
        whole = F.split(F.get(halves, F.lit(0)), ":")
        clean = F.forall(halves, lambda h: (h == "") | ~h.rlike("^:|:$|::"))
        left, right = side(0), side(1)
        missing = F.lit(8) - F.size(left) - F.size(right)
        filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        return F.when(F.size(halves) == 1, whole).when((F.size(halves) == 2) & clean & (missing >= 1), filled)

    def checked(groups: Column) -> Column:
        valid = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(valid, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int")))

    return let(joined(F.split(text, "::")), checked)


def _v6_hextets(ip: Column) -> Column:
    """Eight hextets as integers, or null when the text is not a v6 address."""
    def plain(bare: Column) -> Column:
        tail = F.regexp_extract(bare, r":((?:[0-9]+\.){3}[0-9]+)$", 1)
        octet = lambda i: F.get(F.split(tail, r"\."), F.lit(i)).try_cast("int")
        hextets = F.concat(F.lower(F.hex(octet(0) * 256 + octet(1))), F.lit(":"), F.lower(F.hex(octet(2) * 256 + octet(3))))
        head = F.regexp_replace(bare, r"((?:[0-9]+\.){3}[0-9]+)$", "")
        return F.when(tail == "", bare).when(tail.rlike(V4_PATTERN), F.concat(head, hextets))

    bare = F.regexp_replace(F.lower(F.trim(ip)), r"%.*$", "")
    return F.when(F.trim(ip).rlike(_V6_CHARS), let(let(bare, plain), _hextets_of))


def _decide(ip: Column, v4: Callable[[Column], Column], v6: Callable[[Column], Column], default) -> Column:
    """``v4`` on a dotted address, ``v6`` on the hextets of a colon address, else ``default``.

    The v6 branch runs only on text holding a colon.
    """
    text = F.trim(ip)
    fallback = F.lit(default)
    return (
        F.when(is_v4(ip), v4(text))
        .when(text.contains(":"), F.coalesce(let(_v6_hextets(ip), lambda h: F.when(h.isNotNull(), v6(h))), fallback))
        .otherwise(fallback)
    )


def _internal_hextets(h: Column) -> Column:
    first = F.get(h, F.lit(0))
    loopback = (F.aggregate(F.slice(h, 1, 7), F.lit(0), lambda a, x: a + x) == 0) & (F.get(h, F.lit(7)) == 1)
    return loopback | first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF)


def is_valid(ip: Column) -> Column:
    return _decide(ip, lambda t: F.lit(True), lambda h: F.lit(True), False)


def is_internal(ip: Column) -> Column:
    """Inside the organisation: private, loopback, link-local, carrier NAT, v6 unique local."""
    return _decide(ip, lambda t: t.rlike(_INTERNAL), _internal_hextets, False)


def is_external(ip: Column) -> Column:
    """Valid and not internal; a missing or malformed address is not external."""
    return _decide(ip, lambda t: ~t.rlike(_INTERNAL), lambda h: ~_internal_hextets(h), False)


def is_documentation(ip: Column) -> Column:
    return _decide(
        ip, lambda t: t.rlike(_DOCUMENTATION),
        lambda h: (F.get(h, F.lit(0)) == 0x2001) & (F.get(h, F.lit(1)) == 0x0DB8), False,
    )


def classify(ip: Column) -> Column:
    name = lambda internal: F.when(internal, "internal").otherwise("external")
    return _decide(ip, lambda t: name(t.rlike(_INTERNAL)), lambda h: name(_internal_hextets(h)), "unknown")


def canonical_ip(ip: Column) -> Column:
    """Canonical text of an address, null when it does not parse.

    v6 is lower-cased, leading zeros dropped and the longest run of zero groups (two or more, leftmost on
    a tie) written as ``::``.
    """
    def shorten(joined: Column) -> Column:
        out = joined
        for run in range(2, 9):  # the longest run is tested first, so it is wrapped last
            pattern = "(?::0){%d}:" % run
            out = F.when(joined.rlike(pattern), F.regexp_replace(joined, rf"^(.*?){pattern}(.*)$", "$1::$2")).otherwise(out)
        return out

    def written(h: Column) -> Column:
        joined = F.concat(F.lit(":"), F.array_join(F.transform(h, lambda n: F.lower(F.hex(n))), ":"), F.lit(":"))
        body = F.regexp_replace(F.regexp_replace(let(joined, shorten), r"^:(?!:)", ""), r"(?<!:):$", "")
        return F.concat(body, F.regexp_extract(F.trim(ip), r"(%[^%]+)$", 1))

    return _decide(ip, lambda t: t, written, None)
