"""The queries of the driver contract and the SQL that says the same."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import FILTER_BITS, bucket_fill, mixed_sql
from .operators import export, prep
from .operators.graph import LabeledGraph
from .operators.match import Prefiltered, common_neighbours, count, count_many, filter_candidates, frontier_sizes, match, match_stats, start_candidates, with_degrees
from .plans.planner import Step, matching_order, used_tables
from .plans.query import QueryGraph
from .sources.tables import CUSTOMER, NATION, ORDER, PART, SUPPLIER, event_edges, event_graph, order_edges, order_graph
from .sources.text import edge_list, graph_from_lines, run_list
from .streaming.batches import batch_counts

# Labels and edges of the sample patterns.
PATTERNS = {
    "q0": QueryGraph.of([2, 0, 3], [(0, 1), (0, 2), (1, 2)]),
    "q1": QueryGraph.of([4, 4, 4, 2], [(0, 1), (0, 2), (1, 2), (3, 2)]),
    "q2": QueryGraph.of([3, 4, 4, 1], [(0, 1), (0, 2), (0, 3), (1, 3)]),
    "q3": QueryGraph.of([2, 2, 1, 3, 1], [(0, 1), (0, 2), (0, 3), (0, 4), (1, 3), (2, 3), (2, 4), (3, 4)]),
    "q8": QueryGraph.of([0, 0, 1, 4, 2], [(0, 1), (0, 2), (1, 2), (3, 2), (3, 4), (2, 4)]),
}
ORDER_PATTERNS = {
    "order_triangle": QueryGraph.of([ORDER, PART, SUPPLIER], [(0, 1), (0, 2), (1, 2)]),
    "order_square": QueryGraph.of([CUSTOMER, NATION, SUPPLIER, ORDER], [(0, 1), (1, 2), (2, 3), (3, 0)]),
    "tailed_triangle": QueryGraph.of([ORDER, PART, SUPPLIER, NATION], [(0, 1), (0, 2), (1, 2), (2, 3)]),
}
PATH = QueryGraph.of([4, 4, 4], [(0, 1), (1, 2)])


def rule_patterns(n: int = 30, labels: int = 5, seed: int = 1) -> dict[str, QueryGraph]:
    """n connected patterns of 3 to 8 vertices: a random tree and further random edges, up to 26 in the densest."""
    rng, out = random.Random(seed), {}
    for k in range(n):
        size = 3 + 6 * k // n
        edges = {(rng.randrange(v), v) for v in range(1, size)}
        rest = [(a, b) for b in range(size) for a in range(b) if (a, b) not in edges]
        rng.shuffle(rest)
        edges |= set(rest[: min(len(rest), 26 - len(edges)) * (k % 5) // 4])
        out[f"p{k:02d}"] = QueryGraph.of([rng.randrange(labels) for _ in range(size)], sorted(edges))
    return out

EVENTS_SQL = """
    ev AS (SELECT user_id::BIGINT AS a, lead(user_id::BIGINT) OVER (ORDER BY ts, event_id) AS b FROM events),
    und AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM ev WHERE a <> b),
    e AS (SELECT src, dst, (src % 5)::INT AS ls, (dst % 5)::INT AS ld FROM (SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und))"""
ORDERS_SQL = """
    und AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (
        SELECT c_custkey::BIGINT * 5 AS a, c_nationkey::BIGINT * 5 + 4 AS b FROM customer
        UNION ALL SELECT o_orderkey::BIGINT * 5 + 1, o_custkey::BIGINT * 5 FROM orders
        UNION ALL SELECT l_orderkey::BIGINT * 5 + 1, l_partkey::BIGINT * 5 + 2 FROM lineitem
        UNION ALL SELECT l_orderkey::BIGINT * 5 + 1, l_suppkey::BIGINT * 5 + 3 FROM lineitem
        UNION ALL SELECT l_partkey::BIGINT * 5 + 2, l_suppkey::BIGINT * 5 + 3 FROM lineitem
        UNION ALL SELECT s_suppkey::BIGINT * 5 + 3, s_nationkey::BIGINT * 5 + 4 FROM supplier)),
    e AS (SELECT src, dst, (src % 5)::INT AS ls, (dst % 5)::INT AS ld FROM (SELECT src, dst FROM und UNION ALL SELECT dst, src FROM und))"""


def match_sql(query: QueryGraph, graph: str, select: str = "count(*) AS n") -> str:
    """The match as one join of the edge table for each query edge."""
    home: dict[int, str] = {}
    tests = []
    for k, (a, b) in enumerate(query.edges):
        tests += [f"e{k}.ls = {query.labels[a]}", f"e{k}.ld = {query.labels[b]}"]
        for v, c in ((a, f"e{k}.src"), (b, f"e{k}.dst")):
            if v in home:
                tests.append(f"{c} = {home[v]}")
            home.setdefault(v, c)
    tests += [f"{home[a]} <> {home[b]}" for a in home for b in home if a < b and query.labels[a] == query.labels[b]]
    out = ", ".join(f"{home[v]} AS v{v}" for v in sorted(home)) if select == "*" else select
    return f"WITH {graph} SELECT {out} FROM {', '.join(f'e AS e{k}' for k in range(len(query.edges)))} WHERE {' AND '.join(tests)}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _events(sql: str) -> str:
    return f"WITH {EVENTS_SQL} {sql}"


for _name, _pattern in PATTERNS.items():
    QUERIES[f"match_count_{_name}"] = lambda spark, d, q=_pattern: count(event_graph(spark, d).prepare(), q)
    ORACLE_SQL[f"match_count_{_name}"] = match_sql(_pattern, EVENTS_SQL)
for _name, _pattern in ORDER_PATTERNS.items():
    QUERIES[f"match_count_{_name}"] = lambda spark, d, q=_pattern: count(order_graph(spark, d).prepare(), q, order="frugal")
    ORACLE_SQL[f"match_count_{_name}"] = match_sql(_pattern, ORDERS_SQL)
for _name, _strategy in (("q3", "arrays"), ("q0", "smallest")):
    QUERIES[f"match_count_{_name}_{_strategy}"] = lambda spark, d, q=PATTERNS[_name], s=_strategy: count(event_graph(spark, d).prepare(), q, s)
    ORACLE_SQL[f"match_count_{_name}_{_strategy}"] = match_sql(PATTERNS[_name], EVENTS_SQL)


@_query(_events("SELECT src, dst FROM und"))
def graph_events_edges(spark, d):
    return event_edges(spark, d)


@_query(f"WITH {ORDERS_SQL} SELECT src, dst FROM und")
def graph_orders_edges(spark, d):
    return order_edges(spark, d)


@_query(_events("SELECT src, dst, ls, ld FROM e"))
def labeled_edges(spark, d):
    return event_graph(spark, d).edges


@_query(_events("SELECT ls, ld, count(*) AS n_edges FROM e GROUP BY ALL"))
def label_pair_stats(spark, d):
    return event_graph(spark, d).pair_stats()


@_query(_events("SELECT ls, ld, n_edges, coalesce(sum(n_edges) OVER (ORDER BY ls, ld ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_edge FROM (SELECT ls, ld, count(*) AS n_edges FROM e GROUP BY ALL)"))
def edge_histogram_offsets(spark, d):
    return event_graph(spark, d).histogram_offsets()


@_query(_events("SELECT src, dst, ls, ld FROM e WHERE (ls, ld) IN ({})".format(", ".join(map(str, used_tables(PATTERNS["q0"], matching_order(PATTERNS["q0"])))))))
def used_tables_filter(spark, d):
    return prep.used_edges(event_graph(spark, d).edges, used_tables(PATTERNS["q0"], matching_order(PATTERNS["q0"])))


@_query(_events("SELECT DISTINCT src AS id FROM e WHERE ls = 2 AND ld = (SELECT ld FROM (SELECT l.ld, count(src) AS n FROM (VALUES (0), (3)) l(ld) LEFT JOIN e ON e.ls = 2 AND e.ld = l.ld GROUP BY 1) ORDER BY n, ld LIMIT 1)"))
def start_vertices(spark, d):
    return start_candidates(event_graph(spark, d), PATTERNS["q0"], 0)


@_query(_events("SELECT src AS id, count(*) AS degree FROM e GROUP BY 1"))
def vertex_degree(spark, d):
    return event_graph(spark, d).degrees()


@_query(_events("SELECT max(degree)::BIGINT AS degree, min_by(id, (-degree, id)) AS id FROM (SELECT src AS id, count(*) AS degree FROM e GROUP BY 1)"))
def max_degree_vertex(spark, d):
    return event_graph(spark, d).degrees().agg(F.max("degree").alias("degree"), F.min_by("id", F.struct(-F.col("degree"), "id")).alias("id"))


@_query("""WITH ends AS (SELECT l_orderkey * 8 + l_linenumber AS pos, 0 AS side, l_partkey * 2 AS old_id FROM lineitem
    UNION ALL SELECT l_orderkey * 8 + l_linenumber, 1, l_suppkey * 2 + 1 FROM lineitem)
    SELECT old_id::BIGINT AS old_id, (row_number() OVER (ORDER BY min(pos * 2 + side), old_id) - 1)::BIGINT AS new_id FROM ends GROUP BY old_id""")
def remap_dense_ids(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("at"), (F.col("l_partkey") * 2).cast("bigint").alias("src"), (F.col("l_suppkey") * 2 + 1).cast("bigint").alias("dst"))
    return prep.remap_dense(lines, "at")


@_query(_events("SELECT src AS v0, dst AS v1 FROM e WHERE ls = 2 AND ld = 0"))
def extend_one_edge(spark, d):
    return match(event_graph(spark, d).prepare(), QueryGraph.of([2, 0], [(0, 1)]))


@_query(match_sql(PATH, EVENTS_SQL, "*"))
def injective_paths(spark, d):
    return match(event_graph(spark, d).prepare(), PATH)


@_query(match_sql(PATTERNS["q0"], EVENTS_SQL, "*"))
def triangle_enumerate(spark, d):
    return match(event_graph(spark, d).prepare(), PATTERNS["q0"])


@_query(_events("""SELECT v0, v1, least(n0, n1) AS least_n, CASE WHEN n0 <= n1 THEN 0 ELSE 1 END AS least_vertex FROM
    (SELECT src AS v0, dst AS v1 FROM e WHERE ls = 2 AND ld = 0)
    JOIN (SELECT src AS v0, count(*) AS n0 FROM e WHERE ls = 2 AND ld = 3 GROUP BY 1) USING (v0)
    JOIN (SELECT src AS v1, count(*) AS n1 FROM e WHERE ls = 0 AND ld = 3 GROUP BY 1) USING (v1)"""))
def min_set_sizes(spark, d):
    graph = event_graph(spark, d).prepare()
    sized = with_degrees(graph, PATTERNS["q0"], graph.pair(2, 0).toDF("v0", "v1"), Step(2, (0, 1)))
    return sized.select("v0", "v1", F.least("n0", "n1").alias("least_n"), F.when(F.col("n0") <= F.col("n1"), 0).otherwise(1).alias("least_vertex"))


@_query(_events("""SELECT a.src, a.dst, (SELECT count(*) FROM e b JOIN e c ON b.dst = c.dst WHERE b.src = a.src AND c.src = a.dst AND b.ld = 3)::BIGINT AS common
    FROM e a WHERE a.ls = 2 AND a.ld = 0"""))
def adjacency_intersection(spark, d):
    return common_neighbours(event_graph(spark, d).prepare(), 2, 0, 3)


@_query(_events("""SELECT 0 AS level, count(DISTINCT src) AS n FROM e WHERE ls = 2 AND ld = (SELECT ld FROM (SELECT l.ld, count(src) AS n FROM (VALUES (0), (3)) l(ld) LEFT JOIN e ON e.ls = 2 AND e.ld = l.ld GROUP BY 1) ORDER BY n, ld LIMIT 1)
    UNION ALL SELECT 1, count(*) FROM e WHERE ls = 2 AND ld = 0 AND src IN (SELECT src FROM e WHERE ls = 2 AND ld = (SELECT ld FROM (SELECT l.ld, count(src) AS n FROM (VALUES (0), (3)) l(ld) LEFT JOIN e ON e.ls = 2 AND e.ld = l.ld GROUP BY 1) ORDER BY n, ld LIMIT 1))
    UNION ALL SELECT 2, count(*) FROM e a, e b, e c WHERE a.ls = 2 AND a.ld = 0 AND b.ls = 2 AND b.ld = 3 AND c.ls = 0 AND c.ld = 3 AND b.src = a.src AND c.src = a.dst AND b.dst = c.dst"""))
def frontier_sizes_q0(spark, d):
    return frontier_sizes(event_graph(spark, d).prepare(), PATTERNS["q0"])


_START_Q1 = "e0.src IN (SELECT src FROM e WHERE ls = 4 AND ld = (SELECT ld FROM (SELECT l.ld, count(src) AS n FROM (VALUES (2), (4)) l(ld) LEFT JOIN e ON e.ls = 4 AND e.ld = l.ld GROUP BY 1) ORDER BY n, ld LIMIT 1))"


@_query(f"""WITH {EVENTS_SQL},
    one AS (SELECT src AS v2, dst AS v0 FROM e AS e0 WHERE ls = 4 AND ld = 4 AND {_START_Q1}),
    two AS (SELECT v2, v0, dst AS v1, (dst = v0)::INT AS used, EXISTS (SELECT 1 FROM e f WHERE f.src = v0 AND f.dst = e.dst) AS edge FROM one JOIN e ON src = v2 WHERE ls = 4 AND ld = 4),
    three AS (SELECT 1 FROM two JOIN e ON src = v2 WHERE ld = 2 AND used = 0 AND edge)
    SELECT 1 AS level, count(*) AS candidates, 0::BIGINT AS rejected_used, 0::BIGINT AS rejected_edge, count(*) AS kept FROM one
    UNION ALL SELECT 2, count(*), coalesce(sum(used), 0)::BIGINT, count(*) FILTER (WHERE used = 0 AND NOT edge), count(*) FILTER (WHERE used = 0 AND edge) FROM two
    UNION ALL SELECT 3, count(*), 0, 0, count(*) FROM three""")
def reject_stats_q1(spark, d):
    return match_stats(event_graph(spark, d).prepare(), PATTERNS["q1"])


@_query(_events("SELECT round(avg(degree), 6) AS mean, round(stddev_pop(degree), 6) AS deviation, count(*) AS n FROM (SELECT src, count(*) AS degree FROM e GROUP BY 1)"))
def degree_spread(spark, d):
    return event_graph(spark, d).degrees().agg(F.round(F.avg("degree"), 6).alias("mean"), F.round(F.stddev_pop("degree"), 6).alias("deviation"), F.count("*").alias("n"))


@_query(_events(f"SELECT ls, ld, {mixed_sql('src')} & 15 AS bucket1, count(*) AS n_edges, count(DISTINCT {mixed_sql('dst')} & 7) AS used_buckets, count(DISTINCT {mixed_sql('dst', 1)} % 128) AS set_bits FROM e GROUP BY ALL"))
def index_bucket_fill(spark, d):
    return bucket_fill(event_graph(spark, d).edges, 4, 3)


@_query(_events(f"SELECT src AS id, ({mixed_sql('src', 7)} % 5)::INT AS label FROM (SELECT DISTINCT src FROM e)"))
def pseudo_random_labels(spark, d):
    return prep.random_labels(event_graph(spark, d).vertices, 5, 7)


@_query(_events(f"SELECT src, dst, ({mixed_sql('a * 31 + b', 7)} % 3)::INT AS label FROM (SELECT src, dst, {mixed_sql('least(src, dst)', 7)} AS a, {mixed_sql('greatest(src, dst)', 7)} AS b FROM e)"))
def pseudo_random_edge_labels(spark, d):
    return prep.random_edge_labels(event_graph(spark, d).edges.select("src", "dst"), 3, 7)


@_query(match_sql(PATTERNS["q3"], EVENTS_SQL))
def match_count_q3_prefilter(spark, d):
    return count(Prefiltered.of(event_graph(spark, d).prepare(), PATTERNS["q3"]), PATTERNS["q3"])


def _candidates_sql(query: QueryGraph) -> str:
    """For each query vertex, the data vertices whose filter place some vertex holds for each label that is asked for."""
    parts = []
    for v, label in enumerate(query.labels):
        tests = [f"h IN (SELECT {mixed_sql('src', 2)} % {FILTER_BITS} FROM e WHERE ls = {label} AND ld = {query.labels[n]})" for n in query.neighbours(v)]
        parts.append(f"SELECT {v} AS vertex, count(*) AS n FROM v WHERE label = {label} AND {' AND '.join(tests)}")
    return _events(f", v AS (SELECT DISTINCT src AS id, ls AS label, {mixed_sql('src', 2)} % {FILTER_BITS} AS h FROM e) " + " UNION ALL ".join(parts))


@_query(_candidates_sql(PATTERNS["q3"]))
def filter_candidates_q3(spark, d):
    return filter_candidates(event_graph(spark, d), PATTERNS["q3"])


@_query(_events(f"""SELECT b AS batch, count(a.src) AS n FROM range(4) r(b) LEFT JOIN
    (SELECT a.src FROM e a, e b, e c WHERE a.ls = 2 AND a.ld = 0 AND b.ls = 2 AND b.ld = 3 AND c.ls = 0 AND c.ld = 3 AND b.src = a.src AND c.src = a.dst AND b.dst = c.dst) a
    ON {mixed_sql('a.src', 3)} % 4 = r.b GROUP BY 1"""))
def batched_count_q0(spark, d):
    graph = event_graph(spark, d).prepare()
    return spark.createDataFrame(list(enumerate(batch_counts(graph, PATTERNS["q0"], 4))), "batch bigint, n bigint")


@_query(match_sql(PATTERNS["q0"], EVENTS_SQL))
def rm_text_count_q0(spark, d):
    """The events graph as lines of graph text and back, and a query that is text too."""
    lines = export.rm(*_to_write(spark, d)).select(F.col("text").alias("value"))
    noise = spark.createDataFrame([("# a comment",), ("v x 1 0",), ("e 1",), ("",)], "value string")
    return count(graph_from_lines(lines.union(noise)).prepare(), QueryGraph.parse("t 3 3\nv 0 2 2\nv 1 0 2\nv 2 3 2\ne 0 1\ne 0 2\ne 1 2"))


@_query("SELECT 'g' || r_regionkey AS datagraph, r_name AS querygraph, r_regionkey::BIGINT AS golden, 13 AS h1, 5 AS h2 FROM region")
def run_list_rows(spark, d):
    rows = spark.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("g"), "r_regionkey", F.lit("  "), F.translate("r_name", " ", "_"), F.lit("\t"), "r_regionkey", F.lit(" 13 5")).alias("value"))
    read = run_list(rows.union(spark.createDataFrame([("#off q 0 1 2",), ("",)], "value string")))
    return read.withColumn("querygraph", F.translate("querygraph", "_", " "))


def union_graph(spark: SparkSession, patterns: dict[str, QueryGraph] | None = None) -> LabeledGraph:
    """Patterns (those of the rule, unless given) side by side, as a data graph."""
    vertices, edges = [], []
    for q in (patterns or rule_patterns()).values():
        at = len(vertices)
        vertices += [(at + v, label) for v, label in enumerate(q.labels)]
        edges += [(at + a, at + b) for a, b in q.edges]
    return LabeledGraph.from_frames(spark.createDataFrame(vertices, "id bigint, label int"), spark.createDataFrame(edges, "src bigint, dst bigint"))


def _union_sql() -> str:
    labels, edges = [], []
    patterns = rule_patterns()
    for q in patterns.values():
        at = len(labels)
        edges += [(at + a, at + b) for a, b in q.edges]
        labels += q.labels
    both = [x for a, b in edges for x in ((a, b, labels[a], labels[b]), (b, a, labels[b], labels[a]))]
    graph = f"e(src, dst, ls, ld) AS (VALUES {', '.join(map(str, both))})"
    return " UNION ALL ".join(f"SELECT '{k}' AS query, n FROM ({match_sql(q, graph)})" for k, q in patterns.items())


@_query(_union_sql())
def union_fixture_counts(spark, d):
    return count_many(union_graph(spark).prepare(), rule_patterns())


@_query("SELECT o_orderkey::BIGINT AS u, o_custkey::BIGINT AS v FROM orders")
def edge_list_parse(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    lines = orders.select(F.concat_ws("\t ", "o_orderkey", "o_custkey").alias("value"))
    return edge_list(lines.union(orders.limit(1).select(F.lit("three fields here").alias("value"))))


def _to_write(spark, d) -> tuple[DataFrame, DataFrame]:
    """The events graph with dense ids, as the writers take it."""
    edges = event_edges(spark, d)
    ids = prep.remap_sorted(edges.select(F.explode(F.array("src", "dst")).alias("id")))
    vertices = ids.select(F.col("new_id").alias("id"), F.pmod("old_id", F.lit(5)).cast("int").alias("label"))
    new = edges.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return vertices, new


_WRITE_SQL = f"""WITH {EVENTS_SQL},
    ids AS (SELECT id AS old_id, row_number() OVER (ORDER BY id) - 1 AS id FROM (SELECT src AS id FROM und UNION SELECT dst FROM und)),
    v AS (SELECT id, (old_id % 5)::INT AS label FROM ids),
    x AS (SELECT a.id AS src, b.id AS dst FROM und JOIN ids a ON a.old_id = und.src JOIN ids b ON b.old_id = und.dst),
    ne AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS k FROM x),
    c AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM x) AS m),
    dv AS (SELECT v.id, v.label, count(y.src) AS degree, list(y.dst ORDER BY y.dst) AS near FROM v LEFT JOIN (SELECT src, dst FROM x UNION ALL SELECT dst, src FROM x) y ON y.src = v.id GROUP BY 1, 2)
"""


def _writer(name: str, f, sql: str) -> None:
    QUERIES[f"export_{name}"] = lambda spark, d: f(*_to_write(spark, d))
    ORACLE_SQL[f"export_{name}"] = f"{_WRITE_SQL} SELECT line::BIGINT AS line, text FROM ({sql})"


def _plain(head: list[str], vertex: str, edge: str, tail: str | None = None) -> str:
    parts = [f"SELECT {i} AS line, {t} AS text FROM c" for i, t in enumerate(head)]
    parts.append(f"SELECT id + {len(head)}, {vertex} FROM dv")
    if edge:
        parts.append(f"SELECT k + c.n + {len(head)}, {edge} FROM ne, c")
    if tail:
        parts.append(f"SELECT n + m + {len(head)}, {tail} FROM c")
    return " UNION ALL ".join(parts)


_writer("rm", export.rm, _plain(["concat_ws(' ', 't', n, m)"], "concat_ws(' ', 'v', id, label, degree)", "concat_ws(' ', 'e', src, dst)"))
_writer("daf_data", export.daf_data, _plain(["concat_ws(' ', 't 1', n)"], "concat_ws(' ', 'v', id, label)", "concat_ws(' ', 'e', src, dst, 0)"))
_writer("daf_query", export.daf_query, _plain(["concat_ws(' ', 't 0', n, 2 * m)"], "concat_ws(' ', id, label, degree, array_to_string(near, ' '))", ""))
_writer("stmatch_edges", lambda v, e: export.stmatch_data(v, e)[0], "SELECT k AS line, concat_ws(' ', src, dst) AS text FROM ne")
_writer("stmatch_labels", lambda v, e: export.stmatch_data(v, e)[1], "SELECT id AS line, label::VARCHAR AS text FROM v")
_writer("stmatch_query", export.stmatch_query, _plain(["'# t 0'"], "concat_ws(' ', 'v', id, label)", "concat_ws(' ', 'e', src, dst, 1)"))
_writer("gsi", lambda v, e: export.gsi(v, e, 5, 1), _plain(["'t # 0'", "concat_ws(' ', n, m, 6, 2)"], "concat_ws(' ', 'v', id, label)", "concat_ws(' ', 'e', src, dst)", "'t # -1'"))
_writer("gf_edges", export.gf_edges, "SELECT k AS line, concat_ws(',', src, dst, 0) AS text FROM ne")
_writer("gf_vertices", export.gf_vertices, "SELECT id AS line, concat_ws(',', id, label) AS text FROM v")


@_query(f"""SELECT 0::BIGINT AS line, string_agg('(' || src || ':' || a.label || ')-[0]->(' || dst || ':' || b.label || ')', ', ' ORDER BY src, dst) AS text
    FROM (VALUES {', '.join(map(str, PATTERNS['q3'].edges))}) x(src, dst) JOIN (VALUES {', '.join(map(str, enumerate(PATTERNS['q3'].labels)))}) a(id, label) ON a.id = x.src
    JOIN (VALUES {', '.join(map(str, enumerate(PATTERNS['q3'].labels)))}) b(id, label) ON b.id = x.dst""")
def export_gf_query(spark, d):
    """A query graph, which is small, on one line."""
    q = PATTERNS["q3"]
    return export.gf_query(spark.createDataFrame(list(enumerate(q.labels)), "id bigint, label int"), spark.createDataFrame(list(q.edges), "src bigint, dst bigint"))


_writer("ceci", export.ceci, _plain(["'t # 0'"], "concat_ws(' ', 'v', id, label)", "concat_ws(' ', 'e', src, dst, 0)"))
_writer("vf3", export.vf3, """SELECT 0 AS line, '#Number of nodes' AS text UNION ALL SELECT 1, n::VARCHAR FROM c UNION ALL SELECT 2, '' UNION ALL SELECT 3, '#Node attributes'
    UNION ALL SELECT id + 4, concat_ws(' ', id, label) FROM v
    UNION ALL SELECT begin + n + 4, '' FROM (SELECT id, coalesce(sum(degree + 3) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM dv), c
    UNION ALL SELECT begin + n + 5, '#edges of node ' || id FROM (SELECT id, coalesce(sum(degree + 3) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM dv), c
    UNION ALL SELECT begin + n + 6, degree::VARCHAR FROM (SELECT id, degree, coalesce(sum(degree + 3) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM dv), c
    UNION ALL SELECT begin + n + 6 + pos, concat_ws(' ', id, dst, 0) FROM (SELECT id, begin, unnest(near) AS dst, unnest(range(1, degree + 1)) AS pos FROM (SELECT id, degree, near, coalesce(sum(degree + 3) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM dv)), c""")
