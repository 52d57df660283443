"""Predicate verbs as Columns.

One null rule holds throughout: a row whose field is null or missing satisfies neither a verb nor its negation.
Only ``is_null`` finds such rows. A value of another family than the literal matches no verb, and so every negation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.operators import fts
from folio.operators.fields import STRING, Value, family


def _compared(v: Value, value: object, test: Callable[[Column, Column], Column]) -> Column:
    return v.test(family(value), lambda c: test(c, v.like(value)))


def equals(v: Value, value: object) -> Column:
    return _compared(v, value, lambda c, x: c == x)


def between(v: Value, low: object, high: object) -> Column:
    """Both ends included; ends of two families have nothing between them."""
    if family(low) != family(high):
        return F.lit(False)
    return _compared(v, low, lambda c, x: c.between(x, v.like(high)))


def greater_than(v: Value, value: object) -> Column:
    return _compared(v, value, lambda c, x: c > x)


def greater_or_equal_to(v: Value, value: object) -> Column:
    return _compared(v, value, lambda c, x: c >= x)


def less_than(v: Value, value: object) -> Column:
    return _compared(v, value, lambda c, x: c < x)


def less_than_or_equal_to(v: Value, value: object) -> Column:
    return _compared(v, value, lambda c, x: c <= x)


def contains(v: Value, part: object, ignore_case: bool = False) -> Column:
    """Substring of a string; the empty string is in no value."""
    if not isinstance(part, str) or part == "":
        return F.lit(False)
    return v.test(STRING, lambda c: F.lower(c).contains(part.lower()) if ignore_case else c.contains(part))


def starts_with(v: Value, part: object, ignore_case: bool = False) -> Column:
    """Prefix of a string; the empty string starts every string."""
    if not isinstance(part, str):
        return F.lit(False)
    return v.test(STRING, lambda c: F.lower(c).startswith(part.lower()) if ignore_case else c.startswith(part))


def is_in(v: Value, values: Iterable[object]) -> Column:
    """Membership; nulls in the list match nothing."""
    known: dict[str, list[object]] = {}
    for x in values:
        if (f := family(x)) is not None:
            known.setdefault(f, []).append(x)
    parts = [v.test(f, lambda c, xs=xs: c.isin([v.like(x) for x in xs])) for f, xs in known.items()]
    return reduce(or_, [F.coalesce(p, F.lit(False)) for p in parts] if len(parts) > 1 else parts) if parts else F.lit(False)


def always_true(v: Value) -> Column:
    return v.known


def is_null(v: Value) -> Column:
    return ~v.known


def _text(test: Callable[..., Column]) -> Callable[..., Column]:
    return lambda v, text: test(v.text(), text) if isinstance(text, str) else F.lit(False)


VERBS: dict[str, Callable[..., Column]] = {
    "equals": equals,
    "between": between,
    "greater_than": greater_than,
    "greater_or_equal_to": greater_or_equal_to,
    "less_than": less_than,
    "less_than_or_equal_to": less_than_or_equal_to,
    "contains": contains,
    "starts_with": starts_with,
    "is_in": is_in,
    "fts": _text(fts.matches),
    "fts_prefix": _text(fts.prefix_matches),
    "search_prefix": _text(fts.search_prefix),
    "fts_contains": _text(fts.part_matches),
}
#: Verbs that a negation before them does not touch.
UNNEGATED = {"always_true": always_true, "is_not_null": always_true, "is_null": is_null}


def condition(value: Value, verb: str, args: tuple, negated: bool = False) -> Column:
    if verb in UNNEGATED:
        return UNNEGATED[verb](value)
    found = VERBS[verb](value, *args)
    if not negated:
        return found
    # a text without tokens is not indexed, so it is in no complement either
    known = F.coalesce(fts.has_tokens(value.text()), F.lit(False)) if verb.startswith(("fts", "search")) else value.known
    return known & ~F.coalesce(found, F.lit(False))


def disjunction(groups: list[list[Column]]) -> Column | None:
    """OR of ANDs. Empty groups do not count; None if none is left."""
    parts = [reduce(and_, group) for group in groups if group]
    return reduce(or_, parts) if parts else None
