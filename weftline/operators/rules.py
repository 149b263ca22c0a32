"""Declarative classification rules over maps of features, with three truth values.

A feature that is absent or UNKNOWN is null: it satisfies no condition, but it contradicts none either.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

UNKNOWN = "UNKNOWN"


@dataclass(frozen=True)
class Condition:
    """One required condition; of its parts those that are set must all hold. ``any_of`` needs one of its own."""

    feature: str = ""
    equals: str | None = None
    one_of: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    any_of: tuple["Condition", ...] = ()

    def column(self, features: Column) -> Column:
        """True, false, or null where the feature isn't known."""
        if self.any_of:
            out = self.any_of[0].column(features)
            for c in self.any_of[1:]:
                out = out | c.column(features)
            return out
        raw = F.try_element_at(features, F.lit(self.feature))
        v = F.when(raw != UNKNOWN, raw)
        out = F.lit(True) if self.equals is None and not self.one_of and self.least is None and self.most is None else None
        parts = []
        if self.equals is not None:
            parts.append(F.lower(v) == self.equals.lower())
        if self.one_of:
            parts.append(F.lower(v).isin([x.lower() for x in self.one_of]))
        number = v.try_cast("double")
        if self.least is not None:
            parts.append(number >= self.least)
        if self.most is not None:
            parts.append(number <= self.most)
        for p in parts:
            out = p if out is None else out & p
        return out


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: tuple[Condition, ...] = field(default_factory=tuple)

    def truth(self, features: Column) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(features)
        return out


def satisfied(rules: list[Rule], features: Column) -> Column:
    """Names of all rules that hold, in the rules' order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(r.truth(features), F.lit(False)), F.lit(r.name)) for r in rules]))


def first_satisfied(rules: list[Rule], features: Column) -> Column:
    """Name of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(r.truth(features), F.lit(False)), F.lit(r.name)) for r in rules])


def contradicted(rule: Rule, features: Column) -> Column:
    """True if a condition is known and false."""
    out = F.lit(False)
    for c in rule.conditions:
        out = out | ~F.coalesce(c.column(features), F.lit(True))
    return out


def remaining(rules: list[Rule], features: Column) -> Column:
    """Names of the rules that nothing known contradicts."""
    return F.array_compact(F.array(*[F.when(~contradicted(r, features), F.lit(r.name)) for r in rules]))


def settled(rules: list[Rule], features: Column, provisional: Column) -> Column:
    """The first rule that holds, else the provisional name if it is still in the pool, else null."""
    pool = remaining(rules, features)
    return F.coalesce(first_satisfied(rules, features), F.when(F.array_contains(pool, provisional), provisional))


def feature_map(summary: Column) -> Column:
    """A text of name=value pairs between semicolons as a map."""
    return F.when(summary.rlike("="), F.str_to_map(summary, F.lit(";"), F.lit("=")))
