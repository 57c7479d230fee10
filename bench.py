"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Every query runs once to warm up and three times for the median.
"""

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from vacantia.session import get_session

HEADLINE = (
    "consolidate_postings",
    "dedup_keep_first",
    "union_of_sources",
    "infer_category",
    "keyword_search_page",
    "join_chunks_budget",
    "top_sources",
    "missing_profile",
    "age_histogram",
    "exact_quantiles",
    "trimmed_salaries",
    "recommend_in_cluster",
    "semantic_search_page",
    "similarity_to_centroids",
    "assign_nearest",
    "tech_skills",
    "general_skills",
    "general_sections",
    "cv_context",
    "search_stats",
    "latest_state",
    "collect_pages",
    "search_documents_by_text",
    "salary_density",
    "missing_skill_rows",
    "multi_view_embeddings",
    "consolidate_landed",
    "stream_search_stats",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = get_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": scratch,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vacantia.plans.catalog import QUERIES

    times = {}
    for name in names:
        runs = []
        for attempt in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 4)
    total = round(sum(times.values()), 4)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder)}
        )
    )
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)


if __name__ == "__main__":
    main()
