"""Join order: the most selective pattern first, then always a connected one, components last."""

from __future__ import annotations

from collections import Counter

from .sparql import Pattern, Var


def estimate(p: Pattern, subjects: dict[str, int] | None) -> float:
    """Triples that a pattern is thought to match: its predicate's, much fewer with a constant subject or object."""
    total = float(sum(subjects.values())) if subjects else 1e9
    n = total if isinstance(p.p, Var) else float(subjects.get(p.p, 0)) if subjects is not None else 1e6
    if not isinstance(p.s, Var):
        n = min(n, 10.0) / (1 if isinstance(p.o, Var) else 10)
    elif not isinstance(p.o, Var):
        n /= 50 if not isinstance(p.p, Var) else 1e4
    elif p.s == p.o:
        n /= 100
    return n


def order(patterns: list[Pattern], subjects: dict[str, int] | None = None) -> list[Pattern]:
    """A greedy order of one component's patterns. Of connected ones a star's are preferred: they share its key. Without
    statistics the largest star comes first, as joins on objects may multiply what joins on a subject don't."""
    rest = list(patterns)
    stars = Counter(str(p.s) for p in patterns if isinstance(p.s, Var) and isinstance(p.p, str)) if subjects is None else Counter()
    out: list[Pattern] = []
    bound: set[str] = set()
    while rest:
        near = [p for p in rest if set(p.variables()) & bound] or rest
        best = min(near, key=lambda p: (estimate(p, subjects) / (10 if isinstance(p.s, Var) and any(p.s == q.s for q in out) else 1), -stars[str(p.s)] if not out else 0, patterns.index(p)))
        rest.remove(best)
        out.append(best)
        bound |= set(best.variables())
    return out
