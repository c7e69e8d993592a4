"""What a query's graph tells: components, stars and pipelines, and whether partitions can answer it alone.

Two graphs differ in how they treat constants. For joins, a constant never connects patterns (each occurrence is a
vertex of its own). For locality, equal constants are one vertex, as they are one vertex of the data. Each pattern is
an edge of its own, even where two share subject and object or predicate.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from enum import Enum

from .sparql import Pattern, Query, Var


class Connection(Enum):
    """Where two patterns hold a shared variable."""

    SUB_SUB = "subject-subject"
    OBJ_SUB = "object-subject"
    SUB_OBJ = "subject-object"
    OBJ_OBJ = "object-object"
    PRED = "with a predicate"


def connections(a: Pattern, b: Pattern) -> list[tuple[str, Connection]]:
    """(variable, position) for each way in which a and b share a variable."""
    out = []
    for x, t in (("s", a.s), ("p", a.p), ("o", a.o)):
        for y, u in (("s", b.s), ("p", b.p), ("o", b.o)):
            if isinstance(t, Var) and t == u:
                kind = {"ss": Connection.SUB_SUB, "os": Connection.OBJ_SUB, "so": Connection.SUB_OBJ, "oo": Connection.OBJ_OBJ}.get(x + y, Connection.PRED)
                out.append((t.name, kind))
    return out


def components(patterns: list[Pattern]) -> list[list[Pattern]]:
    """Patterns grouped by shared variables, in order of first appearance; one without variables stands alone."""
    groups: list[tuple[set[str], list[int]]] = []
    for i, p in enumerate(patterns):
        names, members, rest = set(p.variables()), [i], []
        for g in groups:
            if g[0] & names:
                names |= g[0]
                members = g[1] + members
            else:
                rest.append(g)
        groups = [*rest, (names, sorted(members))]
    return [[patterns[i] for i in g[1]] for g in sorted(groups, key=lambda g: g[1][0])]


# --- stars and pipelines ------------------------------------------------------------------------------


@dataclass
class Star:
    """Patterns of one subject, and the links from them to other stars: (variable, connection, subject)."""

    subject: str
    patterns: list[Pattern]
    links: list[tuple[str, Connection, str]] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return "star" if len(self.patterns) > 1 else "pipeline" if self.links else "triple"


def decompose(patterns: list[Pattern]) -> list[Star]:
    """Stars by subject, each linked to those that its objects lead to (object-subject) or share (object-object)."""
    stars: dict[str, Star] = {}
    for p in patterns:
        stars.setdefault(str(p.s), Star(str(p.s), [])).patterns.append(p)
    for a in stars.values():
        for b in stars.values():
            if a is not b:
                found = {(v, k) for p in a.patterns for q in b.patterns for v, k in connections(p, q)}
                a.links += sorted(((v, k, b.subject) for v, k in found if k is Connection.OBJ_SUB or (k is not Connection.SUB_OBJ and a.subject < b.subject)), key=str)
    return list(stars.values())


def articulation_points(patterns: list[Pattern]) -> set[str]:
    """Variables whose removal would part their component (subjects and objects as vertices, patterns as edges)."""
    near = _neighbours(patterns, merge=False)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    cut: set[str] = set()
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, children = [(root, None, iter(sorted(near[root])))], 0
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = len(order)
                    children += v == root
                    stack.append((w, v, iter(sorted(near[w]))))
                    break
                if w != parent:
                    low[v] = min(low[v], order[w])
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if u != root and low[v] >= order[u]:
                        cut.add(u)
        if children > 1:
            cut.add(root)
    return {v for v in cut if v.startswith(("?", "_:"))}


# --- locality -----------------------------------------------------------------------------------------


def _neighbours(patterns: list[Pattern], merge: bool) -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for i, p in enumerate(patterns):
        s, o = (str(t) if merge or isinstance(t, Var) else f"{t} #{i}{x}" for x, t in (("s", p.s), ("o", p.o)))
        near.setdefault(s, set()).add(o)
        near.setdefault(o, set()).add(s)
    return near


def _distances(near: dict[str, set[str]], start: str, through=lambda v: True) -> dict[str, int]:
    found, todo = {start: 0}, deque([start])
    while todo:
        v = todo.popleft()
        if v != start and not through(v):
            continue
        for w in near[v]:
            if w not in found:
                found[w] = found[v] + 1
                todo.append(w)
    return found


def edge_distances(patterns: list[Pattern], stops: frozenset[str] = frozenset()) -> dict[str, int | None]:
    """Distance of each vertex to the farthest one; None for what it can't reach. Paths may end at but not pass through
    stops, the vertices whose data neighbourhoods aren't replicated (high-degree ones)."""
    near = _neighbours(patterns, merge=True)
    out: dict[str, int | None] = {}
    for v in near:
        d = _distances(near, v, lambda w: w not in stops)
        out[v] = max(d.values()) if len(d) == len(near) else None
    return out


@dataclass(frozen=True)
class Locality:
    connected: bool
    radius: int | None
    cores: tuple[str, ...]

    def answerable(self, hops: int) -> bool:
        """Whether partitions with all edges within so many hops answer the query without exchanging rows."""
        return self.connected and self.radius is not None and self.radius <= hops


def locality(patterns: list[Pattern], stops: frozenset[str] = frozenset()) -> Locality:
    near = _neighbours(patterns, merge=True)
    connected = len(_distances(near, next(iter(near)))) == len(near) if near else False
    far = {v: d for v, d in edge_distances(patterns, stops).items() if d is not None}
    if not connected or not far:
        return Locality(connected, None, ())
    radius = min(far.values())
    return Locality(True, radius, tuple(sorted(v for v, d in far.items() if d == radius)))


def covering_cores(patterns: list[Pattern], hops: int, stops: frozenset[str] = frozenset()) -> list[str]:
    """Vertices whose n-hop neighbourhoods hold all patterns' triples: each has an end within less than n hops. Variables
    first."""
    near = _neighbours(patterns, merge=True)
    out = []
    for v in sorted(near, key=lambda v: (not v.startswith("?"), v)):
        d = _distances(near, v, lambda w: w not in stops)
        if all(min(d.get(str(p.s), hops), d.get(str(p.o), hops)) < hops for p in patterns):
            out.append(v)
    return out


def split(query: Query, hops: int, stops: frozenset[str] = frozenset()) -> list[Query]:
    """Sub-queries that n-hop partitions answer alone; joining them on shared variables gives the query.

    A query that isn't local gives off the patterns within hops of its best core; the rest is split in turn. Filters go
    where all their variables are, others stay for after the join.
    """
    out, rest = [], list(query.patterns)
    while rest:
        near = _neighbours(rest, merge=True)
        far = edge_distances(rest, stops)
        known = {v: d for v, d in far.items() if d is not None}
        # the core that reaches most within hops; on ties the most central, then by name
        reach = {v: {w for w, d in _distances(near, v, lambda w: w not in stops).items() if d <= hops} for v in near}
        core = max(sorted(near), key=lambda v: (sum(str(p.s) in reach[v] and str(p.o) in reach[v] for p in rest), v.startswith("?"), -known.get(v, 1 << 30)))
        inside = [p for p in rest if str(p.s) in reach[core] and str(p.o) in reach[core] and min(_distances(near, core, lambda w: w not in stops)[str(t)] for t in (p.s, p.o)) < hops]
        inside = inside or rest[:1]
        rest = [p for p in rest if p not in inside]
        names = {v for p in inside for v in p.variables()}
        elsewhere = {v for p in query.patterns if p not in inside for v in p.variables()} | set(query.select) | {v for f in query.filters for v in f.variables()}
        own = [f for f in query.filters if f.variables() <= names]
        out.append(Query([v for v in dict.fromkeys(v for p in inside for v in p.variables()) if v in elsewhere], inside, own))
    return out
