"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from lodestar.plans import catalogue
from lodestar.session import build

HEADLINE = [
    "top_projects_per_group", "funding_breakdown", "partners_breakdown", "top_coordinators", "person_group_shares", "attribution_coverage", "partner_thesis_coverage", "collab_co_project", "collab_normalized",
    "collab_graph_nodes", "bib_per_thesis", "tfidf_affinity", "attribution_tiers", "knn_topk", "multi_facet_match", "name_match", "chunk_text", "reference_parse",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build(f"local[{cpus}]", partitions=cpus, memory="8g", **{"spark.local.dir": top, "spark.checkpoint.dir": f"file://{top}/checkpoints", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run(HEADLINE[0])  # the session's own start-up
    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = round(min(run(name) for _ in range(2)), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
