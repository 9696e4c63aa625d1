"""Rule lists, small by contract, compiled into Column expressions.

A rule is plain data: a predicate description and a result.  Compiling it to a
``CASE`` keeps classification a narrow projection: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``result`` if every given condition on ``column`` holds."""

    result: str
    column: str
    contains: Sequence[str] = ()
    equals: Sequence = ()
    regex: str | None = None
    unless: Sequence[str] = ()
    review: bool = False

    def test(self) -> Column:
        c = F.col(self.column)
        low = F.lower(c)
        hit = F.lit(False)
        for w in self.contains:
            hit = hit | low.contains(w.lower())
        if self.equals:
            hit = hit | c.isin(list(self.equals))
        if self.regex:
            hit = hit | c.rlike(self.regex)
        for w in self.unless:
            hit = hit & ~low.contains(w.lower())
        return F.coalesce(hit, F.lit(False))


def first_match(rules: Sequence[Rule], default: str | None = None, pick=lambda r: r.result) -> Column:
    """Result of the first rule that holds, in list order."""
    if not rules:
        return F.lit(default)
    out = None
    for r in rules:
        value = F.lit(pick(r))
        out = F.when(r.test(), value) if out is None else out.when(r.test(), value)
    return out.otherwise(F.lit(default))


def all_results(rules: Sequence[Rule]) -> Column:
    """Sorted distinct results of all rules that hold (at most one per rule)."""
    hits = F.array_compact(F.array(*[F.when(r.test(), F.lit(r.result)) for r in rules]))
    return F.array_sort(F.array_distinct(hits))


@dataclass(frozen=True)
class Tiers:
    """Ranked groups of title phrases, most senior first."""

    groups: Sequence[Sequence[str]] = field(default_factory=tuple)

    def phrases(self) -> list[tuple[int, str]]:
        """(tier, phrase), longest first; equal lengths keep tier order."""
        flat = [(i, p.lower()) for i, g in enumerate(self.groups) for p in g]
        return sorted(flat, key=lambda t: -len(t[1]))

    @property
    def unranked(self) -> int:
        return len(self.groups)

    def _position(self, c: Column) -> Column:
        # One pass: the longest phrase starting at each word, then the best of them.
        phrases = [p for _, p in self.phrases()]
        pattern = rf"\b(?=({'|'.join(_escaped(p) for p in phrases)})\b)"
        found = F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(1))
        listed = F.array(*[F.lit(p) for p in phrases])
        return F.array_min(F.transform(found, lambda m: F.array_position(listed, m))).cast("int")

    def rank(self, c: Column) -> Column:
        tiers = F.array(*[F.lit(i) for i, _ in self.phrases()])
        return F.coalesce(F.get(tiers, self._position(c) - 1), F.lit(self.unranked)).cast("int")

    def phrase(self, c: Column) -> Column:
        return F.get(F.array(*[F.lit(p) for _, p in self.phrases()]), self._position(c) - 1)


def _escaped(phrase: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in phrase)
