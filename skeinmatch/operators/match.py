"""Embeddings of a query graph: injective, label-preserving, not induced; each mapping counts.

Strategies: `join` extends partial matches by an equi-join on one back edge, drops used vertices and verifies the other back edges by
left-semi joins; `arrays` intersects adjacency arrays; `smallest` picks for each partial match the back edge with the
fewest neighbours and drives by that one. All give the same matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import may_pass, pair_filters
from ..plans.planner import Step, frugal_order, matching_order, steps
from ..plans.query import QueryGraph
from .graph import LabeledGraph


def _v(k: int) -> str:
    return f"v{k}"


def _plan(graph: LabeledGraph, query: QueryGraph, order: str) -> tuple[list[int], list[Step]]:
    sizes = graph.sizes()
    chosen = matching_order(query) if order == "degree" else frugal_order(query, sizes)
    return chosen, steps(query, chosen, sizes)


def start_candidates(graph: LabeledGraph, query: QueryGraph, first: int) -> DataFrame:
    """Distinct vertices with the first label in the smallest table that leads from it to a neighbour's label; without edges, by label."""
    label = query.labels[first]
    near = {query.labels[n] for n in query.neighbours(first)}
    if not near:
        return graph.vertices.where(F.col("label") == label).select("id")
    other = min(near, key=lambda n: (graph.sizes().get((label, n), (0, 0))[0], n))
    return graph.pair(label, other).select(F.col("src").alias("id")).distinct()


def _distinct_from(query: QueryGraph, v: int, bound: list[int]):
    """The new vertex differs from the bound ones of its label; vertices of other labels differ anyway."""
    tests = [F.col(_v(v)) != F.col(_v(b)) for b in bound if query.labels[b] == query.labels[v]]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _edge(graph: LabeledGraph, query: QueryGraph, b: int, v: int) -> DataFrame:
    return graph.pair(query.labels[b], query.labels[v]).toDF(_v(b), _v(v))


class Prefiltered(LabeledGraph):
    """A graph whose edges keep only vertices that may have a neighbour of each label that some query vertex of their label needs.

    The test is a Bloom filter for each label pair, so it lets some others through; embeddings do not change."""

    @classmethod
    def of(cls, graph: LabeledGraph, query: QueryGraph) -> Prefiltered:
        needs = candidate_needs(query)
        filters = pair_filters(graph.edges, {(a, b) for a, sets in needs.items() for s in sets for b in s})

        def kept(label: str, vertex: str):
            tests = F.lit(False)
            for a, sets in needs.items():
                some = reduce(lambda x, y: x | y, (may_pass(vertex, [filters[a, b] for b in sorted(s)]) for s in sets))
                tests = tests | ((F.col(label) == a) & some)
            return tests

        return cls(graph.vertices, graph.edges.where(kept("ls", "src") & kept("ld", "dst")))


def candidate_needs(query: QueryGraph) -> dict[int, set[frozenset[int]]]:
    """For each label, the sets of neighbours' labels of the query vertices that bear it."""
    needs: dict[int, set[frozenset[int]]] = {}
    for v, label in enumerate(query.labels):
        near = frozenset(query.labels[n] for n in query.neighbours(v))
        if near:
            needs.setdefault(label, set()).add(near)
    return needs


def filter_candidates(graph: LabeledGraph, query: QueryGraph) -> DataFrame:
    """(vertex, n): how many data vertices of its label pass the AND of the filters that each query vertex asks for."""
    needs = {(v, query.labels[v]): sorted({query.labels[n] for n in query.neighbours(v)}) for v in range(len(query.labels))}
    filters = pair_filters(graph.edges, {(label, b) for (_, label), near in needs.items() for b in near})
    passes = [F.count_if((F.col("label") == label) & may_pass("id", [filters[label, b] for b in near])).alias(str(v)) for (v, label), near in needs.items()]
    return graph.vertices.agg(*passes).unpivot([], [str(v) for v, _ in needs], "vertex", "n").select(F.col("vertex").cast("int").alias("vertex"), "n")


def _extend_join(graph, query, frontier, step, bound):
    out = frontier.join(_edge(graph, query, step.back[0], step.vertex), _v(step.back[0])).where(_distinct_from(query, step.vertex, bound))
    for b in step.back[1:]:
        out = out.join(_edge(graph, query, b, step.vertex), [_v(b), _v(step.vertex)], "left_semi")
    return out


def adjacency(graph: LabeledGraph, a: int, b: int) -> DataFrame:
    """(src, near): the sorted neighbours of label b of each vertex of label a."""
    return graph.pair(a, b).groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("near"))


def _candidates(graph, query, frontier, step, bound):
    """The frontier with an array of candidates for the step's vertex."""
    sets = []
    for b in step.back:
        near = adjacency(graph, query.labels[b], query.labels[step.vertex]).toDF(_v(b), f"near{b}")
        frontier = frontier.join(near, _v(b))
        sets.append(F.col(f"near{b}"))
    used = [F.col(_v(b)) for b in bound if query.labels[b] == query.labels[step.vertex]]
    found = reduce(F.array_intersect, sets)
    return frontier.select(*map(_v, bound), (F.array_except(found, F.array(*used)) if used else found).alias("candidates"))


def _extend_arrays(graph, query, frontier, step, bound):
    return _candidates(graph, query, frontier, step, bound).select(*map(_v, bound), F.explode("candidates").alias(_v(step.vertex)))


def with_degrees(graph: LabeledGraph, query: QueryGraph, frontier: DataFrame, step: Step) -> DataFrame:
    """The frontier with n<b>, how many neighbours of the new label the bound vertex b has, for each back edge."""
    for b in step.back:
        n = graph.pair(query.labels[b], query.labels[step.vertex]).groupBy(F.col("src").alias(_v(b))).agg(F.count("*").alias(f"n{b}"))
        frontier = frontier.join(n, _v(b))
    return frontier


def _extend_smallest(graph, query, frontier, step, bound):
    if len(step.back) == 1:
        return _extend_join(graph, query, frontier, step, bound)
    sized = with_degrees(graph, query, frontier, step)
    least = F.array_min(F.array(*(F.struct(F.col(f"n{b}").alias("n"), F.lit(b).alias("b")) for b in step.back)))["b"]
    sized = sized.withColumn("least", least)
    out = None
    for b in step.back:
        part = sized.where(F.col("least") == b).select(*map(_v, bound))
        grown = _extend_join(graph, query, part, Step(step.vertex, (b, *(x for x in step.back if x != b))), bound).select(*map(_v, [*bound, step.vertex]))
        out = grown if out is None else out.unionByName(grown)
    return out


_EXTEND = {"join": _extend_join, "arrays": _extend_arrays, "smallest": _extend_smallest}


def _levels(graph: LabeledGraph, query: QueryGraph, strategy: str, order: str, start: DataFrame | None = None):
    """(bound vertices, frontier) after each vertex of the order."""
    chosen, todo = _plan(graph, query, order)
    frontier = (start_candidates(graph, query, chosen[0]) if start is None else start).select(F.col("id").alias(_v(chosen[0])))
    yield chosen[:1], frontier, None
    for i, step in enumerate(todo, 1):
        frontier = _EXTEND[strategy](graph, query, frontier, step, chosen[:i])
        yield chosen[: i + 1], frontier, step


def match(graph: LabeledGraph, query: QueryGraph, strategy: str = "join", order: str = "degree") -> DataFrame:
    """One row an embedding: v0, v1, ... by query vertex."""
    *_, (_, frontier, _) = _levels(graph, query, strategy, order)
    return frontier.select(*(_v(k) for k in range(len(query.labels))))


def count(graph: LabeledGraph, query: QueryGraph, strategy: str = "join", order: str = "degree", start: DataFrame | None = None) -> DataFrame:
    """One row: n, the number of embeddings. With arrays the last vertex is counted, not listed."""
    if strategy == "arrays" and len(query.labels) > 1:
        chosen, todo = _plan(graph, query, order)
        *_, (bound, frontier, _) = list(_levels(graph, query, strategy, order, start))[:-1]
        return _candidates(graph, query, frontier, todo[-1], bound).agg(F.coalesce(F.sum(F.size("candidates")), F.lit(0)).cast("bigint").alias("n"))
    *_, (_, frontier, _) = _levels(graph, query, strategy, order, start)
    return frontier.agg(F.count("*").alias("n"))


def exists(graph: LabeledGraph, query: QueryGraph) -> bool:
    return not match(graph, query).isEmpty()


def count_many(graph: LabeledGraph, queries: dict[str, QueryGraph], strategy: str = "join") -> DataFrame:
    """(query, n) over one prepared graph, one query after another, so that a plan holds one query's joins."""
    rows = [(name, count(graph, q, strategy).first()["n"]) for name, q in queries.items()]
    return graph.edges.sparkSession.createDataFrame(rows, "query string, n bigint")


def frontier_sizes(graph: LabeledGraph, query: QueryGraph, strategy: str = "join") -> DataFrame:
    """(level, n): partial matches after each bound vertex."""
    frames = [f.agg(F.count("*").alias("n")).select(F.lit(i).alias("level"), "n") for i, (_, f, _) in enumerate(_levels(graph, query, strategy, "degree"))]
    return reduce(DataFrame.unionByName, frames)


def match_stats(graph: LabeledGraph, query: QueryGraph) -> DataFrame:
    """(level, candidates, rejected_used, rejected_edge, kept): what each step's join finds and its tests drop."""
    frames, before = [], None
    for i, (bound, frontier, step) in enumerate(_levels(graph, query, "join", "degree")):
        if step is not None:
            b, v = step.back[0], step.vertex
            found = before.join(_edge(graph, query, b, v), _v(b))
            free = _distinct_from(query, v, bound[:-1])
            both = found.agg(F.count("*").alias("candidates"), F.count_if(~free).alias("rejected_used"))
            kept = frontier.agg(F.count("*").alias("kept"))
            frames.append(both.crossJoin(kept).select(F.lit(i).alias("level"), "candidates", "rejected_used", (F.col("candidates") - F.col("rejected_used") - F.col("kept")).alias("rejected_edge"), "kept"))  # two rows of one line
        before = frontier
    return reduce(DataFrame.unionByName, frames)


def common_neighbours(graph: LabeledGraph, a: int, b: int, c: int) -> DataFrame:
    """(src, dst, common): for each edge of labels (a, b), how many vertices of label c are next to both ends."""
    edges = graph.pair(a, b)
    wedge = edges.join(graph.pair(a, c).toDF("src", "c"), "src").where("c != dst").join(graph.pair(b, c).toDF("dst", "c"), ["dst", "c"], "left_semi")
    n = wedge.groupBy("src", "dst").agg(F.count("*").alias("common"))
    return edges.join(n, ["src", "dst"], "left").select("src", "dst", F.coalesce("common", F.lit(0)).cast("bigint").alias("common"))
