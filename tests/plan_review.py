"""Physical-plan summary of registered queries: shuffles, broadcasts, windows, forbidden
operators. ``python -m tests.plan_review [sf_dir] [names...]`` prints a markdown table."""

from __future__ import annotations

import os
import re
import sys

# queries that write files or fit models while being built are summarised separately
SIDE_EFFECTS = ("s01_csv_scan", "s07_split_sink", "s08_split_reload", "s09_report_sink", "m03_train_persist",
                "m04_artifact_contract", "m30_streaming_scoring", "m30_streamed_counts", "m03_best_model_apart", "s07_split_rows",
                "s09_report_csv")
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summary(text: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", text))
        + len(re.findall(r"Exchange hashpartitioning", text)) * 0,
        "broadcasts": text.count("BroadcastExchange"),
        "windows": len(re.findall(r"\bWindow\b", text)),
        "python": text.count("ArrowEvalPython") + text.count("BatchEvalPython"),
        "forbidden": [f for f in FORBIDDEN if f in text],
    }


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from labeltab.session import get_spark
    import __spark_entry__ as E

    sf = argv[0] if argv else "/root/testdata/sf0.1"
    names = argv[1:] or sorted(E.oracle_sql())
    spark = get_spark("local[8]", shuffle_partitions=16)
    print("| query | shuffles | broadcasts | windows | python |")
    print("| --- | ---: | ---: | ---: | ---: |")
    for n in names:
        s = summary(plan_text(E.queries()[n](spark, sf)))
        print(f"| {n} | {s['shuffles']} | {s['broadcasts']} | {s['windows']} | {s['python']} |"
              + (f" FORBIDDEN {s['forbidden']}" if s["forbidden"] else ""))


if __name__ == "__main__":
    main(sys.argv[1:])
