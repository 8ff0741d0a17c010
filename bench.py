"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import sys
import tempfile
import time

HEADLINE = [
    "tokenize_documents", "term_frequency", "doc_frequency", "inverse_tfidf_edges", "min_count_filter", "short_document_filter", "stopword_removal", "clean_text", "phrase_mining",
    "weighted_centroid", "topic_centroid", "knn_exact_l2", "knn_approximate", "relation_min_edges", "network_union", "shortest_path_len", "nearest_nodes", "paper_cloud",
    "connected_components", "clustering_coefficient", "cloud_bag", "metric_topic_word", "papers_per_topic", "roc_points", "auc", "hypothesis_path",
]


def main() -> None:
    from lodestone.queries import QUERIES
    from lodestone.session import session

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as shared:
        spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"{shared}/warehouse"})
        spark.sparkContext.setLogLevel("ERROR")
        spark.range(1000).selectExpr("sum(id)").collect()
        took = {}
        for name in sys.argv[1:] or HEADLINE:
            runs = []
            for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
                began = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - began)
            took[name] = round(statistics.median(runs), 3)
            spark.catalog.clearCache()
        spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
