"""Ranks over edges in buckets."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillweave.operators import graph
from quillweave.tables import setting, workspace

def test_hot_sources_and_plan(spark):
    rng = random.Random(8)
    links = [("hub", f"n{i}") for i in range(400)] + [(f"n{rng.randint(0, 399)}", f"n{rng.randint(0, 399)}") for _ in range(300)] + [("n1", "hub"), ("n1", "hub"), ("n2", "n2")]
    frame = spark.createDataFrame(links, "src string, dst string")
    out = defaultdict(set)
    for a, b in links:
        out[a].add(b)
    nodes = {x for pair in links for x in pair}
    ranks = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(5):
        into, lost = defaultdict(float), sum(r for v, r in ranks.items() if v not in out)
        for a, ends in out.items():
            for b in ends:
                into[b] += ranks[a] / len(ends)
        ranks = {v: 0.2 + 0.8 * lost / len(nodes) + 0.8 * into[v] for v in nodes}
    got = {x.url: x.rank for x in graph.page_rank(frame).collect()}
    assert got.keys() == ranks.keys() and all(abs(got[v] - ranks[v]) < 1e-9 for v in nodes)
    assert graph.page_rank(frame.limit(0)).count() == 0

    edges = graph.distinct_edges(frame)
    held = graph.vertices(edges).join(graph.out_degree(edges), "url", "left")
    name, held = graph._bucketed(edges, held, workspace(spark, "rank"), 8)
    assert held.where("url = 'hub' and splits > 8").count() == 1 and held.where("splits > 1").count() <= 32
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        table = spark.table(name)
        assert {x.salt for x in table.where("src = 'hub'").collect()} == set(range(held.where("url = 'hub'").first().splits))
        plan = graph._passed(table, held.withColumn("rank", F.lit(1.0)))
        plan.collect()

        final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        join = final[final.index("SortMergeJoin") :]
        side = join[: join.index("parquet")]  # the first side below the join: the edges
        assert "Bucketed: true" in join and "Exchange" not in side
    spark.sql(f"DROP TABLE {name}")
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("quillweave")]
