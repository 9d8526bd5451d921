"""Query graphs: small connected patterns with a label on each vertex. They are input of the planner, not data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class QueryGraph:
    """labels[v] is the label of vertex v; edges are undirected, without loops or repeats."""

    labels: tuple[int, ...]
    edges: tuple[tuple[int, int], ...]

    @classmethod
    def of(cls, labels, edges) -> QueryGraph:
        labels, kept = tuple(int(x) for x in labels), {}
        if not labels:
            raise ValueError("query graph has no vertices")
        for a, b in edges:
            if a == b:
                raise ValueError(f"query graph has a loop at vertex {a}")
            if not (0 <= a < len(labels) and 0 <= b < len(labels)):
                raise ValueError(f"edge ({a}, {b}) has an unknown vertex")
            kept.setdefault((min(a, b), max(a, b)), (a, b))
        graph = cls(labels, tuple(kept.values()))
        seen, todo = {0}, [0]
        while todo:
            for n in graph.neighbours(todo.pop()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        if len(seen) < len(labels):
            raise ValueError("query graph is not connected")
        return graph

    @classmethod
    def parse(cls, text: str) -> QueryGraph:
        """Lines `t N M`, `v id label [degree]`, `e a b`; the degree is not read."""
        labels, edges = {}, []
        for line in text.splitlines():
            f = line.split()
            if f and f[0] == "v":
                labels[int(f[1])] = int(f[2])
            elif f and f[0] == "e":
                edges.append((int(f[1]), int(f[2])))
        if sorted(labels) != list(range(len(labels))):
            raise ValueError("vertex ids must run from 0 without gaps")
        return cls.of([labels[v] for v in range(len(labels))], edges)

    def neighbours(self, v: int) -> list[int]:
        return sorted([b for a, b in self.edges if a == v] + [a for a, b in self.edges if b == v])

    def degree(self, v: int) -> int:
        return len(self.neighbours(v))
