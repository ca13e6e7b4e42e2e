"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores, and
``BENCH_QUERIES=all`` runs every registered query. Each query is written to the
``noop`` sink, so that all of its rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from taleloom.plans import QUERIES  # noqa: E402
from taleloom.session import local_session  # noqa: E402

HEADLINE = [
    "a13_pages_once",
    "b2_new_links",
    "b3_page_stories",
    "c1_code_category",
    "c3d_common_schema",
    "c14_clean_text",
    "d2_attach_vectors",
    "d4_text_in_split",
    "d7_similar_pairs",
    "e1_most_frequent_codes",
    "e2_groups_at_least",
    "e3_category_share",
    "e6_mean_vector_per_group",
    "e8_sample_per_code",
    "f1_stratified_split",
    "f4_dataset_build",
    "f5_pair_samples",
    "f8_batch_numbers",
    "g2_nearest_to_several",
    "g4_seeded_shuffle",
    "h6_contrastive_loss",
    "i5_one_vs_one_auc",
    "i8_metric_bundle",
    "m4_nearest_vote",
    "s1_stacked_catalogues",
    "t2_vocabulary_ids",
    "t3_sentence_mean_vectors",
    "t6_tfidf",
    "t9_hashed_vectors",
    "t11_attention_pool",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(1).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
