"""Benchmark the headline queries.

Runs each query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line.  Each query is executed in
full with the ``noop`` sink (every row computed, nothing collected), again and
again at the timed scale until two runs in a row agree within 10 % (at most
``$BENCH_REPS``, default 5): the earlier ones warm up code and Python workers.
Reported are the median of the two last runs, the best run and all runs; for
queries over a derived table also the time to derive it alone (``fixture``).
"""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "g8_gather",          # flagship: parse -> score -> group advantage -> step report
    "g3_advantage",
    "b8_accuracy",
    "l4_select",
    "x11a_r1_multibox",
    "x11c_r1_referred",
    "x9_match",
    "t1_process",
    "t5_remove_sentences",
    "t4_remove_class_names",
    "p8a_emotion_prompt",
    "p14_attach",
    "g6_loss",
    "g7_token_metrics",
]


def fixtures():
    from rollscope.plans import fixtures as X
    return {**dict.fromkeys(["g8_gather", "g3_advantage", "b8_accuracy", "l4_select"], X.f1_rollouts),
            **dict.fromkeys(["x11a_r1_multibox", "x11c_r1_referred", "x9_match"], X.f2_box_rollouts),
            **dict.fromkeys(["g6_loss", "g7_token_metrics"], X.f3_tokens)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from rollscope.plans.catalog import QUERIES, load_all
    from rollscope.session import get_spark
    load_all()
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    names = sys.argv[1:] or HEADLINE
    most = int(os.environ.get("BENCH_REPS", "5"))

    def timed(make) -> list[float]:
        runs = []
        while len(runs) < 2 or (len(runs) < most and abs(runs[-1] - runs[-2]) > 0.1 * min(runs[-2:])):
            t = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - t, 3))
        return runs

    derived, runs, alone = fixtures(), {}, {}
    for name in names:
        runs[name] = timed(lambda: QUERIES[name](spark, sf_dir))
    for f in {derived[n] for n in names if n in derived}:
        alone[f] = round(sum(timed(lambda: f(spark, sf_dir))[-2:]) / 2, 3)
    times = {n: round(sum(r[-2:]) / 2, 3) for n, r in runs.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "best": {n: min(r) for n, r in runs.items()}, "runs": runs,
                      "fixture": {n: alone[derived[n]] for n in names if n in derived}}))


if __name__ == "__main__":
    main()
