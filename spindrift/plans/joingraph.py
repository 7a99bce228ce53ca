"""Multi-join queries as graphs: join order, co-located joins, and predicate transfer before the joins.

Predicate transfer reduces every relation by its neighbours' keys, forward along an order of the relations and then back,
before any join runs: by Bloom filters, or exactly by semi-joins (which on the tree of the breadth-first order is the full
reduction of acyclic joins). An outer join's preserved side is never reduced by the other side.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.config import EngineConfig, Prefilter, TransferOrder
from spindrift.operators.bloom import build, probe
from spindrift.sources.shared import scratch_path


@dataclass(frozen=True)
class Edge:
    """An equi-join of two relations; how: inner, left, right, full, left_semi or left_anti, seen from ``left``."""

    left: str
    right: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    how: str = "inner"

    def keys(self, name: str) -> tuple[str, ...]:
        return self.left_keys if name == self.left else self.right_keys

    def other(self, name: str) -> str:
        return self.right if name == self.left else self.left

    def may_reduce(self, target: str) -> bool:
        """Whether rows of ``target`` without a partner are never in the result."""
        if self.how == "full":
            return False
        preserved = {"left": self.left, "left_anti": self.left, "right": self.right}.get(self.how)
        return target != preserved


#: Estimates of distinct keys are off by a fiftieth; a key of which a relation has more rows than this on average repeats.
KEY_ERROR, REPEATS = 0.02, 1.1


@dataclass
class Reduction:
    """What one transfer did, for reports."""

    source: str
    target: str
    how: str
    phase: str


def _written(df: DataFrame, name: str) -> DataFrame:
    """A filter or a key set written before it is used, so that plans hold it as a scan and don't grow with each transfer."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class JoinGraph:
    relations: dict[str, DataFrame]
    rows: dict[str, int]
    edges: list[Edge]
    done: list[Reduction] = field(default_factory=list)
    #: Relations that are whole tables; until something reduces them, their keys are not sent.
    whole: set[str] = field(default_factory=set)
    hash_keys: dict[str, str] = field(default_factory=dict)
    #: Mean rows of a key, by relation and key, as far as ``count_keys`` had to look.
    per_key: dict[tuple[str, tuple[str, ...]], float] = field(default_factory=dict)

    def size(self, name: str) -> tuple[int, str]:
        return self.rows[name], name

    def between(self, a: str, b: str) -> list[Edge]:
        return [e for e in self.edges if {e.left, e.right} == {a, b}]

    def small_to_large(self) -> list[tuple[str, str, Edge]]:
        """Edges from the smaller to the larger relation, by rising size of both: acyclic also for cyclic joins."""
        directed = [(*sorted((e.left, e.right), key=self.size), e) for e in self.edges]
        return sorted(directed, key=lambda x: (self.size(x[0]), self.size(x[1])))

    def breadth_first(self) -> list[tuple[str, str, Edge]]:
        """Edges of a breadth-first spanning tree from the largest relation, the leaves' first."""
        found: list[tuple[str, str, Edge]] = []
        left = set(self.relations)
        while left:
            root = max(left, key=self.size)
            left.discard(root)
            waiting = deque([root])
            while waiting:
                parent = waiting.popleft()
                for e in sorted((e for e in self.edges if parent in (e.left, e.right)), key=lambda e: self.size(e.other(parent))):
                    if (child := e.other(parent)) in left:
                        left.discard(child)
                        found.append((child, parent, e))
                        waiting.append(child)
        return found[::-1]

    def _sent(self, name: str, df: DataFrame) -> DataFrame:
        """The columns that a reduced relation's edges join on, written: its scan and reductions run once for all of them."""
        columns = sorted({k for e in self.edges if name in (e.left, e.right) for k in e.keys(name)})
        return _written(df.select(*columns).distinct(), "sent")

    def transfer(self, config: EngineConfig) -> JoinGraph:
        """The graph with reduced relations. Filters and key sets are made now, a job for each edge and direction; a relation
        that sends keys over several edges is read once for them. ``Prefilter.JOIN`` only goes forward, from the smaller to
        the larger side of each join."""
        if config.prefilter is Prefilter.NONE:
            return self
        order = self.small_to_large() if config.transfer_order is TransferOrder.SMALL_TO_LARGE or config.prefilter is Prefilter.JOIN else self.breadth_first()
        reduced, done, sent = dict(self.relations), [], {}
        untouched = set(self.whole)
        phases = [("forward", order)] + ([("backward", [(b, a, e) for a, b, e in reversed(order)])] if config.prefilter is not Prefilter.JOIN else [])
        for phase, steps in phases:
            for source, target, e in steps:
                if not e.may_reduce(target) or source in untouched:
                    continue
                exact = config.prefilter is Prefilter.SEMI
                if not exact and self.rows[source] > config.bloom_max_rows:
                    continue
                a, b = reduced[source], reduced[target]
                if exact or sum(source in (x.left, x.right) for x in self.edges) > 1:
                    a = sent[source] = sent[source] if source in sent else self._sent(source, a)
                    mine = dict.fromkeys(e.keys(source))
                    if len(a.columns) > len(mine):  # else a key that many rows have would go to one task with all of them
                        a = a.select(*mine).distinct()
                if exact:
                    keys = a.select(*(a[k].alias(f"_k{i}") for i, k in enumerate(e.keys(source))))
                    reduced[target] = b.join(keys, [b[k] == keys[f"_k{i}"] for i, k in enumerate(e.keys(target))], "left_semi")
                else:
                    bloom = _written(build(a, e.keys(source), self.rows[source], config.bloom_rate), "bloom")
                    reduced[target] = probe(b, e.keys(target), bloom, self.rows[source], config.bloom_rate)
                untouched.discard(target)
                sent.pop(target, None)
                done.append(Reduction(source, target, config.prefilter.value, phase))
        return JoinGraph(reduced, self.rows, self.edges, done, self.whole, self.hash_keys, self.per_key)

    def count_keys(self) -> JoinGraph:
        """Estimates how often keys repeat in the smaller relation of each edge, and in the larger one where they do in the
        smaller: a job for each of the two, linear in the rows."""
        smaller = {(n, e.keys(n)) for e in self.edges for n in [min(e.left, e.right, key=self.size)]}
        self._count(smaller)
        self._count({(n, e.keys(n)) for e in self.edges for o, n in [sorted((e.left, e.right), key=self.size)] if self.per_key[o, e.keys(o)] > REPEATS} - smaller)
        return self

    def _count(self, wanted: set[tuple[str, tuple[str, ...]]]) -> None:
        counts, listed = [], sorted(wanted)
        for name in dict.fromkeys(n for n, _ in listed):
            values = []
            for i, keys in ((i, keys) for i, (n, keys) in enumerate(listed) if n == name):
                there = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
                distinct = F.approx_count_distinct(F.when(there, F.xxhash64(*keys)), KEY_ERROR)
                values.append(F.struct(F.lit(i).alias("i"), (F.count(F.when(there, 1)) / F.greatest(distinct, F.lit(1))).alias("n")))
            counts.append(self.relations[name].agg(F.array(*values).alias("found")))
        for r in reduce(DataFrame.union, counts).collect() if counts else []:
            self.per_key |= {listed[x["i"]]: x["n"] for x in r["found"]}

    def times(self, edge: Edge) -> float:
        """How many times the rows of one side a join has: the rows of a key in the side where keys repeat less; 1 where that
        is next to none, or not known."""
        least = min((self.per_key[k] for n in (edge.left, edge.right) if (k := (n, edge.keys(n))) in self.per_key), default=1.0)
        return least if least > REPEATS else 1.0

    def order(self) -> list[str]:
        """Left-deep: the smallest relation, then always the one whose join with what is joined is estimated smallest;
        co-located joins count half. Joins that multiply rows (keys repeat on both sides) grow with the product of the sides
        and come last, so that such an edge is a further condition wherever its relations have another way to each other."""
        names = sorted(self.relations, key=self.size)
        order = [names[0]]
        while len(order) < len(names):
            rest = [n for n in names if n not in order]
            linked = {n: min((self.times(e), estimated_rows(e, self.rows, self.hash_keys) if co_located([e], self.hash_keys) else float(self.rows[n])) for o in order for e in self.between(n, o)) for n in rest if any(self.between(n, o) for o in order)}
            order.append(min(linked, key=lambda n: (linked[n], self.size(n))) if linked else rest[0])
        return order

    def join(self, order: Sequence[str] | None = None) -> DataFrame:
        """All relations joined in an order, each by all of its edges to those before. Column names must differ. An edge that
        isn't inner must join a relation by itself."""
        order = list(order or self.relations)
        joined = self.relations[order[0]]
        for i, name in enumerate(order[1:], 1):
            r = self.relations[name]
            mine = [e for o in order[:i] for e in self.between(name, o)]
            if not mine:
                raise ValueError(f"{name} has no join with {order[:i]}: a product must be asked for by nested_loop_join")
            on = [joined[a] == r[b] for e in mine for a, b in zip(e.keys(e.other(name)), e.keys(name), strict=True)]
            how = mine[0].how if len(mine) == 1 else "inner"
            if how in ("left", "right") and name == mine[0].left:
                how = {"left": "right", "right": "left"}[how]
            if how == "left_semi" and name == mine[0].left:
                raise ValueError(f"{name} must come before {mine[0].right}")
            joined = joined.join(r, on, how)
        return joined

    def row_counts(self) -> dict[str, int]:
        """Rows of each relation now; one job each."""
        return {n: df.count() for n, df in self.relations.items()}


def co_located(edges: Sequence[Edge], hash_keys: dict[str, str]) -> list[Edge]:
    """Joins whose keys are the partitioning keys of both tables, so that equal keys lie together."""
    return [e for e in edges if len(e.left_keys) == 1 and hash_keys.get(e.left) == e.left_keys[0] and hash_keys.get(e.right) == e.right_keys[0]]


def estimated_rows(edge: Edge, rows: dict[str, int], hash_keys: dict[str, str]) -> float:
    """A join's rows by the larger side; half of it if co-located, which makes an orderer prefer it."""
    n = max(rows[edge.left], rows[edge.right])
    return n / 2 if co_located([edge], hash_keys) else float(n)
