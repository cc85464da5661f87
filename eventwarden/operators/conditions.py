"""Rule selections and hunt filters compiled to one boolean ``Column``.

Two languages with different null rules share the field lookup:

* rule selections: positive tests on a missing value fail, negations hold. A failing test may be null
  instead of false, so that plain comparisons reach the scan; every negation closes the null first, and
  filters and ``when`` read null as false;
* hunt filters follow SQL, so negations drop missing values, except in the step matcher of ordered hunts
  (``null_negation=True``), where they keep them.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventwarden.model import EVENT_TYPES_BY_COLUMN, FIELD_ALIASES, METADATA_TYPES

RULE_OPERATORS = [
    "eq", "not_eq", "in", "not_in", "contains", "not_contains", "startswith", "endswith",
    "regex", "not_regex", "gt", "gte", "lt", "lte", "exists", "is_null",
]
HUNT_OPERATORS = [
    "eq", "ne", "in", "not_in", "contains", "not_contains", "startswith", "endswith",
    "gt", "gte", "lt", "lte", "exists",
]
_RESERVED = ("any_of", "all_of", "not", "case_sensitive")
_NUMERIC = ("int", "bigint", "double")
# Validated vocabularies, always stored in lower case: compared as they are, so the test reaches the scan
# as a pushed filter or a pruned partition.
_FOLDED = ("event_type", "source")


def field(name: str) -> tuple[Column, str]:
    """The column behind a rule or hunt field name, with its type."""
    if name.startswith("metadata."):
        key = name.split(".", 1)[1]
        if key in METADATA_TYPES:
            return F.col(f"metadata.`{key}`"), METADATA_TYPES[key]
        return F.element_at(F.col("metadata.extra"), key), "string"
    if name.startswith("raw."):
        return F.get_json_object("raw", "$." + name.split(".", 1)[1]), "string"
    column = FIELD_ALIASES.get(name, name)
    if column not in EVENT_TYPES_BY_COLUMN:
        raise KeyError(f"unknown field '{name}'")
    return F.col(f"`{column}`"), EVENT_TYPES_BY_COLUMN[column]


def _listed(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def _false(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def _truthy(column: Column, kind: str) -> Column:
    if kind == "boolean":
        return column
    if kind in _NUMERIC:
        return column != 0
    if kind.startswith("array") or kind.startswith("map"):
        return F.size(column) > 0
    if kind == "string":
        return column != ""
    return column.isNotNull()


def _equals(column: Column, kind: str, value: Any, exact: bool, folded: bool = False) -> Column:
    """Equality as the rule language has it; null only where the field is null."""
    if isinstance(value, bool) or kind == "boolean":
        return _truthy(column, kind) == F.lit(bool(value))
    if kind == "string":
        if not isinstance(value, str):
            return F.lit(False)
        if exact:
            return column == value
        return (column if folded else F.lower(column)) == value.lower()
    if kind in _NUMERIC:
        return column == F.lit(value) if isinstance(value, (int, float)) else F.lit(False)
    return F.lit(False)


def _as_text(column: Column, kind: str) -> Column:
    return F.initcap(column.cast("string")) if kind == "boolean" else column.cast("string")


def _contains(column: Column, kind: str, value: Any, exact: bool) -> Column:
    needles = [str(v) if exact or not isinstance(v, str) else v.lower() for v in _listed(value)]
    if kind == "array<string>":
        folded = column if exact else F.transform(column, F.lower)
        return F.arrays_overlap(folded, F.array(*[F.lit(n) for n in needles]))
    text = _as_text(column, kind)
    if kind == "string" and not exact:
        text = F.lower(text)
    return reduce(or_, [text.contains(n) for n in needles])


def _edge(column: Column, kind: str, value: Any, exact: bool, method: str) -> Column:
    text = _as_text(column, kind)
    if kind == "string" and not exact:
        text = F.lower(text)
    needles = [str(v) if exact or not isinstance(v, str) else v.lower() for v in _listed(value)]
    return reduce(or_, [getattr(text, method)(n) for n in needles])


# parts of a pattern: escapes and classes, which stay, and what the engine writes in another way
_PARTS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{,(?P<most>\d+)\}|\(\?P<(?P<group>\w+)>|\(\?P=(?P<back>\w+)\)", re.S)


def engine_pattern(pattern: str) -> str:
    """A rule's pattern as the engine writes it: named groups, back references to them, counts without a lower bound."""
    def written(m: re.Match) -> str:
        if m["most"]:
            return f"{{0,{m['most']}}}"
        name = (m["group"] or m["back"] or "").replace("_", "0")  # names of letters and digits only
        return f"(?<{name}>" if m["group"] else f"\\k<{name}>" if m["back"] else m[0]

    return _PARTS.sub(written, pattern)


def _regex(column: Column, kind: str, value: Any, exact: bool) -> Column:
    subject = _as_text(column, kind)
    prefix = "" if exact else "(?i)"
    return reduce(or_, [subject.rlike(prefix + engine_pattern(str(p))) for p in _listed(value)])


def single_tests(selection: dict[str, Any] | None) -> list[Column]:
    """Every single test of a selection by itself, so that none hides behind another one's outcome."""
    selection = selection or {}
    nested = [*selection.get("any_of", []), *selection.get("all_of", []), *([selection["not"]] if "not" in selection else [])]
    return [*_level_tests(selection), *(test for part in nested for test in single_tests(part))]


def _number(column: Column, kind: str) -> Column:
    if kind == "timestamp" or kind.startswith("array") or kind.startswith("map"):
        return F.lit(None).cast("double")
    if kind == "boolean":
        return column.cast("int").cast("double")
    return column.try_cast("double")


def _compare(column: Column, operator: str, value: Any) -> Column:
    return {
        "gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value,
    }[operator]


def rule_test(name: str, operator: str, value: Any, exact: bool = False) -> Column:
    """One rule-language test; a positive test may be null where it fails."""
    column, kind = field(name)
    if operator == "exists":
        return column.isNotNull() if value else column.isNull()
    if operator == "is_null":
        return column.isNull() if value else column.isNotNull()
    if operator in ("gt", "gte", "lt", "lte"):
        try:
            bound = float(value)
        except (TypeError, ValueError):
            return F.lit(False)
        if kind in _NUMERIC:
            return _compare(column, operator, bound)
        return _compare(_number(column, kind), operator, bound)
    positive = {"not_eq": "eq", "not_in": "in", "not_contains": "contains", "not_regex": "regex"}
    base = positive.get(operator, operator)
    folded = name in _FOLDED
    if base == "eq":
        hit = _equals(column, kind, value, exact, folded)
    elif base == "in":
        hit = _member(column, kind, _listed(value), exact, folded)
    elif base == "contains":
        hit = _contains(column, kind, value, exact)
    elif base in ("startswith", "endswith"):
        hit = _edge(column, kind, value, exact, base)
    elif base == "regex":
        hit = _regex(column, kind, value, exact)
    else:
        raise ValueError(f"unsupported operator '{operator}'")
    return ~_false(hit) if operator in positive else hit


def _member(column: Column, kind: str, values: list, exact: bool, folded: bool) -> Column:
    if kind == "string" and values and all(isinstance(v, str) for v in values):
        if exact:
            return column.isin(values)
        return (column if folded else F.lower(column)).isin([v.lower() for v in values])
    return reduce(or_, [_equals(column, kind, v, exact, folded) for v in values], F.lit(False))


def compile_selection(selection: dict[str, Any] | None) -> Column:
    """A rule selection as one column: entries are ANDed, ``any_of``/``all_of``/``not`` nest.

    ``case_sensitive`` applies to the level it is written on; nested selections read their own.
    """
    if not selection:
        return F.lit(True)
    tests: list[Column] = []
    if "any_of" in selection:
        tests.append(reduce(or_, [compile_selection(s) for s in selection["any_of"]], F.lit(False)))
    if "all_of" in selection:
        tests.append(reduce(and_, [compile_selection(s) for s in selection["all_of"]], F.lit(True)))
    if "not" in selection:
        tests.append(~_false(compile_selection(selection["not"])))
    tests += _level_tests(selection)
    return reduce(and_, tests) if tests else F.lit(True)


def _level_tests(selection: dict[str, Any]) -> list[Column]:
    """The tests on fields that a selection states itself."""
    exact = bool(selection.get("case_sensitive", False))
    tests: list[Column] = []
    for name, constraint in selection.items():
        if name in _RESERVED:
            continue
        if isinstance(constraint, dict):
            tests += [rule_test(name, op, value, exact) for op, value in constraint.items()]
        elif isinstance(constraint, (list, tuple)):
            tests.append(rule_test(name, "in", constraint, exact))
        else:
            tests.append(rule_test(name, "eq", constraint, exact))
    return tests


# ---- hunt filters ---------------------------------------------------------------------------------
_BOOLEAN_TEXT = {"true": True, "false": False}


def _boolean_like(value: Any) -> bool:
    return isinstance(value, bool) or (isinstance(value, str) and value.strip().lower() in _BOOLEAN_TEXT)


def _hunt_bound(value: Any, kind: str) -> Column:
    return F.lit(value).cast("timestamp") if kind == "timestamp" else F.lit(value)


def hunt_test(name: str, operator: str, value: Any, *, null_negation: bool = False,
              columns: dict[str, str] | None = None, arrays: dict[str, str] | None = None) -> Column:
    """One hunt filter under SQL null rules.

    ``columns`` maps hunt fields to ``column:type`` for datasets other than events; ``arrays`` names the
    fields stored as arrays of text. ``null_negation`` keeps rows with a missing value under a negation.
    """
    if arrays and name in arrays:
        return _hunt_array(F.col(arrays[name]), operator, value)
    if columns is not None:
        column_name, kind = columns[name].split(":")
        column = F.col(column_name)
    else:
        column, kind = field(name)

    if operator == "exists":
        return column.isNotNull() if value else column.isNull()
    negations = {"ne": "eq", "not_in": "in", "not_contains": "contains"}
    base = negations.get(operator, operator)
    metadata = name.startswith("metadata.")
    text = F.lower(column.cast("string"))

    if base == "eq" and metadata and _boolean_like(value):
        wanted = value if isinstance(value, bool) else _BOOLEAN_TEXT[value.strip().lower()]
        hit = text.isin(["true", "1"] if wanted else ["false", "0"])
    elif base == "eq":
        hit = text == value.lower() if isinstance(value, str) else column == F.lit(value)
    elif base == "in":
        values = _listed(value)
        if all(isinstance(v, str) for v in values):
            hit = text.isin([v.lower() for v in values])
        else:
            hit = column.isin(values)
    elif base == "contains":
        hit = text.contains(str(value).lower())
    elif base in ("startswith", "endswith"):
        hit = getattr(text, base)(str(value).lower())
    elif base in ("gt", "gte", "lt", "lte"):
        side = column.try_cast("double") if kind == "string" and isinstance(value, (int, float)) else column
        hit = _compare(side, base, _hunt_bound(value, kind))
    else:
        raise ValueError(f"unsupported operator '{operator}'")

    result = ~hit if operator in negations else hit
    if operator in negations and null_negation:
        return F.coalesce(result, F.lit(True))
    return result


def _hunt_array(column: Column, operator: str, value: Any) -> Column:
    folded = F.transform(column, F.lower)
    wanted = F.array(*[F.lit(str(v).lower()) for v in _listed(value)])
    hit = F.arrays_overlap(folded, wanted)
    if operator in ("eq", "in", "contains"):
        return hit
    if operator in ("ne", "not_in", "not_contains"):
        return ~hit
    raise ValueError(f"operator '{operator}' is not supported on list field")


def compile_filters(filters: list[tuple], logic: str = "and", **options) -> Column:
    """Hunt filters ``(field, operator, value)`` combined with AND or OR."""
    tests = [hunt_test(*f, **options) for f in filters]
    return reduce(and_ if logic == "and" else or_, tests) if tests else F.lit(True)
