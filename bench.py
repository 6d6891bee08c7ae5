"""Benchmark: run the headline queries on $BENCH_SF_DIR (default
/root/testdata/sf0.1) with local[$BENCH_CPUS] and print ONE JSON line.

Each query is executed in full through the ``noop`` sink (no collect to the
driver). The relational council/theme/taxonomy queries share stored
derived stages; building them is timed once as ``derived_stages``. For queries whose
registered form reads its result from such a stage, the operator itself is run on its stored inputs."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sentence_table", "corpus_stats", "clean_seq", "clean_audit", "embed", "reduce_dims", "knn_graph",
    "ward_cluster", "topic_summary", "top_evidence", "chart_similarity",
    "merge_council", "consolidate", "merge_taxonomy", "comparison", "paper_results",
]


def operators(spark, sf: str) -> dict:
    """Operators on their stored inputs, by the name of the query."""
    from litspark.functions.vec import dim_of
    from litspark.operators import council, taxonomy, themes, topics
    from litspark.plans import derived as D

    members, vectors, _, papers, _, ranked = D.emb_topics(spark, sf)
    labels, _, collected, decisions, _, _ = D.labelled_topics(spark, sf)
    th, tmap, _, _ = D.emb_themes(spark, sf)
    dim = dim_of(D.emb_vectors(spark, sf), "embedding")
    return {
        "top_evidence": lambda: topics.top_evidence(vectors, None, topics.centroids(vectors, None), dim=dim),
        "merge_council": lambda: council.merge_council(ranked, decisions, collected),
        "consolidate": lambda: themes.themes_ranked(themes.consolidate(tmap, labels, papers)),
        "merge_taxonomy": lambda: taxonomy.merge_taxonomy(th, taxonomy.taxonomy_from_responses(D.taxonomy_responses(th))),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from litspark.plans import derived as D
    from litspark.plans.queries import QUERIES
    from litspark.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    # JVM warm-up (class loading, parquet reader, shuffle), not timed.
    spark.read.parquet(os.path.join(sf, "labels.parquet")).groupBy("quality").count() \
        .write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}

    t0 = time.time()
    D.emb_taxonomy(spark, sf)
    times["derived_stages"] = round(time.time() - t0, 3)
    direct = operators(spark, sf)
    for name in HEADLINE:
        t0 = time.time()
        (direct[name]() if name in direct else QUERIES[name](spark, sf)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": sf_name, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
