"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_QUERIES`` (names, or ``all``).
Every query is written to the noop sink twice; ``queries`` has the second, warm time, ``cold`` the first.
"""

from __future__ import annotations

import json
import os
import time

from awardtrace.sources.tables import clear_staging
from checks.registry import QUERIES
from checks.session import local_session

HEADLINE = [
    "build_grants", "table_profile", "funder_profile_all", "top_funders", "input_profile", "absent_from_corpus",
    "dois_not_in_input", "structured_match", "pair_lcs", "pair_ratio", "pair_match_type", "pair_score",
    "matched_strict", "matched_structured", "matched", "award_differs", "candidate_pairs", "best_overlap_match",
    "corpus_only", "consolidated_report", "recon_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split() or HEADLINE
    spark = local_session(cpus, partitions=cpus)
    times: dict[str, list[float]] = {}
    for name in names:
        for _ in range(2):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.setdefault(name, []).append(round(time.perf_counter() - begin, 3))
    warm = {name: t[1] for name, t in times.items()}
    print(json.dumps({
        "metric": "warm time of all headline queries", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": {name: t[0] for name, t in times.items()}, "sf": os.path.basename(sf_dir),
        "cpus": cpus,
    }))
    clear_staging(spark)
    spark.stop()


if __name__ == "__main__":
    main()
