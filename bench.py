"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

index_stats is the first to ask for the index of the pages: it builds and stores it, searches and lookups read it.
"""

from __future__ import annotations

import json
import os
import time

from quillweave.queries import QUERIES
from quillweave.session import session

HEADLINE = ["word_count", "hits_pages", "tf", "df", "tfidf", "links_distinct", "graph_counts", "pagerank_pages", "pagerank_supply_graph", "index_stats", "search_single_term", "search_topk", "lookup_idf", "content_dedupe", "url_normalize", "map_reduce_generic"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", master=f"local[{cpus}]", **{"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
