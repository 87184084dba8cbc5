"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the number of cores, ``BENCH_QUERIES`` a comma list.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textlens.plans import PLANS  # noqa: E402
from textlens.session import build_session, release_scratch, scratch_path  # noqa: E402

FILES = 16

HEADLINE = [
    "scan_posts",
    "clean_posts",
    "processing_summary",
    "sample_proportion",
    "corpus",
    "tokenize",
    "word_count",
    "vocabulary",
    "negative_distribution",
    "encode",
    "skipgram_pairs",
    "subsample",
    "training_pairs",
    "negative_samples",
    "sgns_loss",
    "term_frequency",
    "term_proportion",
    "event_overlay",
    "most_similar",
    "most_similar_batch",
    "pca_covariance",
    "infinity_hop",
    "k_hop_edges",
    "graph_nodes",
    "modularity",
    "weighted_stance",
    "evaluate",
    "stream_word_counts",
]


def spark_tables(sf_dir: str) -> list[str]:
    return sorted(name for name in os.listdir(sf_dir) if name.endswith(".parquet"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    conf = {
        "spark.sql.shuffle.partitions": max(8, int(cpus)) if cpus.isdigit() else 8,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        "spark.log.level": "ERROR",
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    # A given table is one file of one row group, which one task reads. Work on a copy in as many files as a large table would
    # have; neither this nor the warming up is timed.
    parts = scratch_path(spark, "bench")
    for table in spark_tables(sf_dir):
        spark.read.parquet(f"{sf_dir}/{table}").repartition(FILES).write.parquet(f"{parts}/{table}")
    scale, sf_dir = os.path.basename(sf_dir.rstrip("/")), parts
    PLANS["term_proportion"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    seconds = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        begin = time.perf_counter()
        PLANS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    release_scratch(spark)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
