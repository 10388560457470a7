"""The steps of a fluent query, as recorded for explanation, caching and replay."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from snapquery.functions.aggregates import Aggregate
from snapquery.functions.predicates import Fallback, Predicate


@dataclass(frozen=True)
class Step:
    """A kind (where, select, order, skip, take, distinct, group, join) and what it takes."""

    kind: str
    details: Any = None

    def key(self) -> str:
        """Text that tells steps apart, literals included."""
        return f"{self.kind}:{self.details!r}"


@dataclass(frozen=True)
class Steps:
    items: tuple[Step, ...] = field(default_factory=tuple)

    def then(self, kind: str, details: Any = None) -> Steps:
        return Steps((*self.items, Step(kind, details)))

    def key(self) -> str:
        return " | ".join(s.key() for s in self.items)

    def of(self, kind: str) -> list[Any]:
        return [s.details for s in self.items if s.kind == kind]

    def predicates(self) -> list[Predicate]:
        return [p for d in self.of("where") for p in d.conjuncts()]

    def explain(self) -> str:
        """What runs on columns and what doesn't, in a few lines; their headings are fixed output."""
        predicates = self.predicates()
        fallback = [p for p in predicates if isinstance(p, Fallback)]
        columns = list(dict.fromkeys(c for p in predicates for c in p.columns()))
        lines = [f"Query Plan (Optimized: {not fallback})"]
        if columns:
            lines.append(f"  Columns: {', '.join(columns)}")
        if pushed := len(predicates) - len(fallback):
            lines.append(f"  Predicates: {pushed} column-level filter(s)")
        if fallback:
            lines.append(f"  Fallback: {len(fallback)} row-level predicate(s), run in Python")
        for keys, aggregates in self.of("group"):
            lines.append(f"  GroupBy: {', '.join(keys)}")
            lines.append(f"  Aggregations: {_listed(aggregates)}")
        lines += [f"  Join: {d}" for d in self.of("join")]
        lines += [f"  OrderBy: {', '.join(f'{k} desc' if falling else k for k, falling in d)}" for d in self.of("order")]
        lines += ["  Distinct" for _ in self.of("distinct")]
        lines += [f"  {s.kind.title()}: {s.details}" for s in self.items if s.kind in ("skip", "take")]
        share = 1.0
        for p in predicates:
            share *= p.selectivity
        lines.append(f"  Est. Selectivity: {share:.0%}")
        lines += [f"  Warning: {w}" for w in dict.fromkeys(w for p in predicates for w in p.warnings())]
        return "\n".join(lines)


def _listed(aggregates: Mapping[str, Aggregate]) -> str:
    return ", ".join(a.text() for a in aggregates.values())
