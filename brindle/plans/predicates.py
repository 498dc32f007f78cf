"""The filter language: exact and presence terms, unit matches and OR groups, compiled to one boolean Column.

Batch queries and live subscriptions use the same builder. Errors are kept and raised by check(), so that calls
chain; after an error further terms are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Self

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import fields
from brindle.plans.model import InvalidQuery, Limits

#: The fields of a unit match.
UNIT_FIELDS = ("_SYSTEMD_UNIT", "UNIT", "OBJECT_SYSTEMD_UNIT")

#: (field, value); None asks for presence.
Term = tuple[str, bytes | None]


def _name_error(name: str, limits: Limits) -> str | None:
    if len(name.encode("utf-8")) > limits.max_field_name_len:
        return "field name too long"
    if not name.isascii() or "=" in name or "\0" in name:
        return "invalid field name"
    return None


class Group:
    """Terms of one OR branch; they are ANDed."""

    def __init__(self, budget: Callable[[], bool], limits: Limits, fail: Callable[[str], None], failed: Callable[[], bool]) -> None:
        self.terms: list[Term] = []
        self._budget, self._limits, self._fail, self._failed = budget, limits, fail, failed

    def _add(self, name: str, value: bytes | None) -> Self:
        if self._failed():
            return self
        if reason := _name_error(name, self._limits):
            self._fail(f"invalid query: {reason}")
        elif self._budget():
            self.terms.append((name, value))
        return self

    def match_exact(self, name: str, value: bytes | str) -> Self:
        return self._add(name, value.encode() if isinstance(value, str) else bytes(value))

    def match_present(self, name: str) -> Self:
        return self._add(name, None)


class Filter:
    """Global terms, and OR groups: globals AND (g1 OR g2 OR ...). Without groups the globals alone."""

    def __init__(self, limits: Limits | None = None) -> None:
        self.limits = limits or Limits()
        self.globals: list[Term] = []
        self.groups: list[list[Term]] = []
        self.reason: str | None = None
        self.too_many = False

    # building

    def _fail(self, reason: str) -> None:
        self.reason = self.reason or reason

    def _failed(self) -> bool:
        return self.reason is not None or self.too_many

    def n_terms(self) -> int:
        return len(self.globals) + sum(map(len, self.groups))

    def _fits(self, pending: Callable[[], int] = lambda: 0) -> bool:
        if self.n_terms() + pending() + 1 > self.limits.max_query_terms:
            self.too_many = True
        return not self.too_many

    def _add(self, name: str, value: bytes | None) -> Self:
        if self._failed():
            return self
        if reason := _name_error(name, self.limits):
            self._fail(f"invalid query: {reason}")
        elif self._fits():
            self.globals.append((name, value))
        return self

    def match_exact(self, name: str, value: bytes | str) -> Self:
        """A field `name` with exactly these bytes; any duplicate counts."""
        return self._add(name, value.encode() if isinstance(value, str) else bytes(value))

    def match_present(self, name: str) -> Self:
        """A field `name`, whatever its value, empty included."""
        return self._add(name, None)

    def match_unit(self, unit: str | bytes) -> Self:
        """Any of the three unit fields, distributed over the OR groups that exist now: a later group widens it."""
        if self._failed():
            return self
        value = unit.encode() if isinstance(unit, str) else bytes(unit)
        old = self.groups or [[]]
        n_old = sum(map(len, self.groups))
        if len(self.globals) + 3 * n_old + 3 * len(old) > self.limits.max_query_terms:
            self.too_many = True
            return self
        self.groups = [[*g, (name, value)] for g in old for name in UNIT_FIELDS]
        return self

    def or_group(self, build: Callable[[Group], object]) -> Self:
        """One more OR branch; what build adds to the group is ANDed. An empty group is ignored."""
        if self._failed():
            return self
        group: Group
        group = Group(lambda: self._fits(lambda: len(group.terms)), self.limits, self._fail, self._failed)
        build(group)
        if group.terms and not self._failed():
            self.groups.append(group.terms)
        return self

    # using

    def check(self) -> None:
        if self.reason is not None:
            raise InvalidQuery(self.reason)
        if self.too_many:
            raise InvalidQuery("too many query terms")

    def column(self, exact: Callable[[str, bytes], Column] = fields.exact, present: Callable[[str], Column] = fields.present) -> Column | None:
        """The filter as a Column, None if it holds for every row. exact and present may read a source's own columns.

        The form isn't expanded: Catalyst normalises globals AND (g1 OR g2 OR ...). Equal terms become one.
        """
        self.check()
        term = lambda t: present(t[0]) if t[1] is None else exact(*t)
        every = lambda ts: reduce(lambda a, b: a & b, map(term, dict.fromkeys(ts)))
        parts = [every(self.globals)] if self.globals else []
        if self.groups:
            distinct = list(dict.fromkeys(tuple(dict.fromkeys(g)) for g in self.groups))
            parts.append(reduce(lambda a, b: a | b, map(every, distinct)))
        return reduce(lambda a, b: a & b, parts) if parts else None

    def matches(self, entry: list[tuple[str, bytes]]) -> bool:
        """The same in Python, for one entry's (name, value) pairs: tests and small live batches."""
        self.check()
        names, pairs = {n for n, _ in entry}, set(entry)
        term = lambda t: t[0] in names if t[1] is None else t in pairs
        return all(map(term, self.globals)) and (not self.groups or any(all(map(term, g)) for g in self.groups))

    def always(self) -> Column:
        c = self.column()
        return F.lit(True) if c is None else c
