"""Headline timings. Prints one JSON line; results are computed in full and discarded."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cloakwork.plans.queries import REGISTRY  # noqa: E402
from cloakwork.session import local_session  # noqa: E402

HEADLINE = [
    "d6_mask_table",
    "d3_mask_pages",
    "d6_mask_with_model",
    "b1_regex_detect",
    "b10_distinct_texts",
    "e1_demask",
    "e2_demask_session",
    "e7_llm_flow",
    "c2_resolve_overlaps",
    "f4_extended_maps",
    "f4_extend",
    "f9_dual_store",
    "g4_decrypt",
    "h5_entity_counts",
    "i1_stream_mask",
    "i2_stream_session",
    "i3_stream_demask",
    "i5_audit_tumbling",
    "i7_stream_vault",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, "16g")
    # one small run, so that start-up is not charged to the first query
    REGISTRY["d6_mask_table"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    texts = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "masked_texts_per_second": round(texts / seconds["d6_mask_table"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
