"""Times every registered query once and prints one JSON line.

``BENCH_SF_DIR`` picks the data, ``BENCH_CPUS`` the local threads. Results go to Spark's noop sink,
so every row is computed and none is collected. ``events_per_sec`` is the rate of the chain
decode, parse, react, append, fold over the whole event table.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from eventflow.operators import changelog, parsers, reactors, state  # noqa: E402
from eventflow.plans import all_queries  # noqa: E402
from eventflow.plans.ingest import wire_records  # noqa: E402
from eventflow.session import build_session, load  # noqa: E402
from eventflow.sources import rawlog  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def chain(spark, folder):
    """Wire text to open state, every stage of the pipeline in one plan."""
    raw = rawlog.decode_wire(wire_records(spark, folder)).where("decoded")
    raw = raw.withColumn("ts", raw["sent_at"])
    paid = parsers.parse_payment(rawlog.scan(raw, parsers.CHARGE_PATTERN))
    return state.fold(changelog.append(reactors.changes(reactors.on_payment(paid)), "event_id"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = sys.argv[1:]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    n_events = load(spark, folder, "events").count()
    times: dict[str, float] = {}
    for name, query in all_queries.QUERIES.items():
        if picked and name not in picked:
            continue
        start = time.perf_counter()
        run(query(spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
    run(chain(spark, folder))
    start = time.perf_counter()
    run(chain(spark, folder))
    rate = n_events / (time.perf_counter() - start)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rsplit("sf", 1)[-1].strip("/"),
                "events": n_events,
                "events_per_sec": round(rate),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
