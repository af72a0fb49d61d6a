"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from covspark.operators.mutate import Mutation  # noqa: E402
from covspark.session import configure, shared_folder  # noqa: E402
from covspark.sources.revisions import Dataset  # noqa: E402
from oracle_queries import QUERIES, data  # noqa: E402

HEADLINE = """
query_keys_range query_in_notin_nulls query_key_table sql_guarded_groupby sql_guarded_window
pk_duplicates required_violations scope_violations coverage_from_facts coverage_gaps
coverage_report continuity_missing coverage_merge_hull coverage_merge_keep_left
calendar_pretrade open_dates_in_jobs month_starts parse_ranges publication_daily due_clamp
upsert_pk replace_ranges apply_sequence merge_last_wins envelope_explode provider_rows
snapshot_latest_in_month members_latest members_range_union members_asof selector_expand
work_shape by_date_filter absent_cells market_ingest saturated_requests index_months
checkpoint_batches checkpoint_batches_by_size coalesce_requests unread_events log_runs
newest_per_group retain_top_n diagnostics_top10 resolve_prefixes activity_window
activity_bursts export_csv export_parquet export_jsonl stream_activity stream_coverage
""".split()


def timed(action) -> float:
    began = time.perf_counter()
    action()
    return round(time.perf_counter() - began, 3)


def publishing(spark: SparkSession, sf: str) -> dict[str, float]:
    """First publication, one-percent upsert, range replacement and a keyed read."""
    dataset = Dataset(spark, shared_folder(spark, "bench"), data.EVENT_DAYS)
    base, held = data.event_days(spark, sf), data.hull(spark, sf)
    change = base.where("event_type = 'error' and day = '2024-01-15'")
    bought = base.where("event_type = 'purchase'")
    keys = [str(i) for i in range(100)]
    return {
        "publish_initial": timed(lambda: dataset.publish([Mutation.complete(base)], held)),
        "publish_upsert": timed(
            lambda: dataset.publish(
                [Mutation.primary_keys(change.withColumn("value", F.lit(0.0)))], held
            )
        ),
        "publish_ranges": timed(
            lambda: dataset.publish(
                [Mutation.ranges(bought, data.hull(spark, sf, "purchase"))], held
            )
        ),
        "published_keyed_read": timed(
            lambda: dataset.query(keys=keys, time_range=("2024-01-08", "2024-01-15"))
            .write.format("noop")
            .mode("overwrite")
            .save()
        ),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine: one small job per table, one shuffle join
    for name in ("lineitem", "events", "orders"):
        spark.read.parquet(f"{sf}/{name}.parquet").groupBy().count().collect()
    QUERIES["status_by_group"](spark, sf).collect()
    QUERIES["query_key_table"](spark, sf).collect()
    times = {}
    for name in HEADLINE:
        run = QUERIES[name]
        times[name] = timed(
            lambda: run(spark, sf).write.format("noop").mode("overwrite").save()
        )
    times |= publishing(spark, sf)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
