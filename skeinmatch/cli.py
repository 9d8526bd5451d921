"""Run lists: python -m skeinmatch.cli RUN_LIST RESULTS_CSV. Each row of the list is a data graph, a query graph and an expected count."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession

from .operators.limits import within
from .operators.match import Prefiltered, count, match_stats
from .plans.estimate import estimate, index_widths
from .plans.query import QueryGraph
from .sources.text import read_graph, run_list


log = logging.getLogger("skeinmatch")

#: The columns of a results row. Counters of hardware stages that Spark does not have stay null.
RESULTS = (
    "query string, datagraph string, h1 int, h2 int, power double, time double, preproc double, hit_findmin bigint, req_findmin bigint, hit_readmin_counter bigint, req_readmin_counter bigint, "
    "hit_readmin_edge bigint, req_readmin_edge bigint, hit_intersect bigint, req_intersect bigint, hit_verify bigint, req_verify bigint, req_dynfifo bigint, bloom_filtered bigint, matches bigint"
)


def run(spark: SparkSession, path: str, strategy: str = "join", seconds: float = 2400, stats: bool = False, prefilter: bool = False) -> DataFrame:
    """RESULTS, golden and passed for each row of a run list. Rows of one data graph share its preparation; golden 0 means unknown; h1 and
    h2 of 0 are estimated. A query past the time limit has no matches and fails.

    stats fills what the join strategy can count: candidates asked for and found by the steps' joins (intersect) and
    those tested and kept by further edges (verify). prefilter drops edges by Bloom filters first and counts them."""
    rows, graphs = [], {}
    names = [f.split()[0] for f in RESULTS.split(", ")]
    for r in run_list(spark.read.text(path)).collect():  # a list of runs
        began = time.time()
        if r["datagraph"] not in graphs:
            for graph, _ in graphs.values():
                graph.release()
            graph = read_graph(spark, r["datagraph"]).prepare()
            graphs = {r["datagraph"]: (graph, graph.degrees().agg({"degree": "max"}).first()[0] or 0)}
            graph.sizes()
        graph, degree = graphs[r["datagraph"]]
        ready = time.time()
        query = QueryGraph.parse("\n".join(x["value"] for x in spark.read.text(r["querygraph"]).collect()))
        labels = {x["label"]: x["count"] for x in graph.vertices.groupBy("label").count().collect()}
        need = estimate(query, graph.sizes(), labels, degree)
        log.info("%s on %s: order %s, %d tables of %d bytes, expected matches after each vertex %s", r["querygraph"], r["datagraph"], need.order, len(need.tables), need.table_bytes, need.frontier)
        h1, h2 = (r["h1"], r["h2"]) if r["h1"] or r["h2"] else index_widths(max(1, sum(n for n, _ in graph.sizes().values()) // 2), degree, max(1, len(need.tables)))
        held = dict.fromkeys(names) | {"query": r["querygraph"], "datagraph": r["datagraph"], "h1": h1, "h2": h2, "preproc": ready - began}
        used = Prefiltered.of(graph, query) if prefilter else graph
        if prefilter:
            held["bloom_filtered"] = graph.edges.count() - used.edges.count()
        try:
            held["matches"] = within(spark, seconds, lambda: count(used, query, strategy).first()["n"])
        except TimeoutError as e:
            log.warning("%s: %s", r["querygraph"], e)
        held["time"] = time.time() - ready
        if stats and len(query.labels) > 1:
            found = match_stats(used, query).collect()
            held |= {"req_intersect": sum(x["candidates"] for x in found), "hit_intersect": sum(x["candidates"] - x["rejected_used"] for x in found)}
            held |= {"req_verify": held["hit_intersect"], "hit_verify": sum(x["kept"] for x in found)}
        rows.append((*held.values(), r["golden"], held["matches"] is not None and r["golden"] in (0, held["matches"])))
    return spark.createDataFrame(rows, f"{RESULTS}, golden bigint, passed boolean")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("run_list")
    parser.add_argument("results")
    parser.add_argument("--strategy", choices=["join", "arrays", "smallest"], default="join")
    parser.add_argument("--seconds", type=float, default=2400, help="time limit of a query")
    parser.add_argument("--stats", action="store_true")
    parser.add_argument("--prefilter", action="store_true")
    parser.add_argument("--verbose", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    spark = SparkSession.builder.getOrCreate()
    results = run(spark, args.run_list, args.strategy, args.seconds, args.stats, args.prefilter)
    results.write.csv(args.results, header=True)
    return int(not all(r["passed"] for r in results.select("passed").collect()))


if __name__ == "__main__":
    raise SystemExit(main())
