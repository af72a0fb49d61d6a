"""Landed responses as a stream: every micro-batch is one idempotent publication."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from covspark.errors import ContractError
from covspark.operators import validate
from covspark.plans import ingest
from covspark.sources import envelope
from covspark.session import shared_folder
from covspark.sources.revisions import Dataset
from covspark.spec import DatasetSpec
from covspark.streaming import sinks

LANDED = (
    "request_id string, key string, start date, end date, response string, "
    "arrival bigint, part int, parts int"
)
RANGE = ("key", "start", "end")
COMPLETE, LATE, INCOMPLETE = "complete", "late", "incomplete"
_PENDING, _KNOWN = "pending", "known"
ANSWERS = f"{LANDED}, status string"
_STATE = "done bigint, arrival bigint, parts int, held array<int>, ids array<string>, texts array<string>"
#: The state table of ``settled``: the last complete answer of each request and the parts so far of a newer one.
REQUESTS = (
    "key string, start date, end date, done bigint, arrival bigint, parts int, seen bigint, "
    "held array<struct<part:int,request_id:string,response:string>>"
)
HOUR_MS = 3_600_000


def read_landed(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON lines of one part of an answer each, as they arrive.

    ``arrival`` numbers the answers to one request (key and range), a later one being newer;
    ``part`` of ``parts`` numbers an answer's parts. Without them an answer is one part of arrival 0.
    """
    reader = spark.readStream.schema(LANDED)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return numbered(reader.json(path))


def numbered(landed: DataFrame) -> DataFrame:
    defaults = {"arrival": 0, "part": 0, "parts": 1}
    return landed.withColumns({c: F.coalesce(c, F.lit(v).cast(landed.schema[c].dataType)) for c, v in defaults.items()})


def newest_answers(landed: DataFrame) -> DataFrame:
    """All parts of the newest answer to each request of a finished table; a part sent twice counts once.

    ``missing`` counts the parts that are not there.
    """
    sent = F.max(F.struct("parts", "response", "request_id")).alias("_sent")
    each = numbered(landed).groupBy(*RANGE, "arrival", "part").agg(sent)
    request = Window.partitionBy(*RANGE)
    newest = each.withColumn("_newest", F.max("arrival").over(request)).where("arrival = _newest")
    whole = newest.select(*RANGE, "arrival", "part", "_sent.*")
    return whole.withColumn("missing", F.max("parts").over(request) - F.count("*").over(request))


def settle(landed: DataFrame, patience_ms: int = HOUR_MS, forget_ms: int = 7 * 24 * HOUR_MS) -> DataFrame:
    """A stream of answers that can be published: all parts of the newest one, once they are there.

    State per request holds the number of the last complete answer and the parts so far of a newer
    one. Parts of an older or an already complete answer come out as ``late`` without their text. An
    answer whose parts don't arrive within ``patience_ms`` of its last one comes out as one
    ``incomplete`` row; a request nobody answers again is forgotten after ``forget_ms``.
    """
    names = [f.name for f in T.StructType.fromDDL(ANSWERS)]

    def run(request, frames, state):
        done, arrival, parts, held, ids, texts = state.get if state.exists else (None, None, None, [], [], [])
        held, ids, texts = list(held or []), list(ids or []), list(texts or [])
        out, whole = [], []
        if state.hasTimedOut:
            if arrival is not None:
                out.append((ids[0], *request, None, arrival, None, parts, INCOMPLETE))
            if arrival is None or done is None:
                state.remove()
            else:
                state.update((done, None, None, [], [], []))
                state.setTimeoutDuration(forget_ms)
            yield pd.DataFrame(out, columns=names)
            return
        got = pd.concat(frames, ignore_index=True)
        columns = [got[c].tolist() for c in ("arrival", "part", "response", "request_id", "parts")]
        # the same text whatever order a repeated part came in
        rows = sorted(zip(*columns, strict=True), key=lambda r: (r[0], r[1], r[2] or "", r[3] or ""), reverse=True)
        for number in sorted({r[0] for r in rows}):
            for at, part, text, name, of in (r for r in rows if r[0] == number):
                if (done is not None and at <= done) or (arrival is not None and at < arrival):
                    out.append((name, *request, None, at, part, of, LATE))
                    continue
                if arrival is None or at > arrival:
                    out += [(i, *request, None, arrival, p, parts, LATE) for i, p in zip(ids, held)]
                    arrival, parts, held, ids, texts = at, of, [], [], []
                if part not in held:
                    parts = max(parts, of)
                    held.append(part)
                    ids.append(name)
                    texts.append(text)
            if arrival is not None and len(held) >= parts:
                out += [(*r[:4], None, *r[5:8], LATE) for r in whole]
                whole = [(i, *request, t, arrival, p, parts, COMPLETE) for i, p, t in zip(ids, held, texts)]
                done, arrival, parts, held, ids, texts = arrival, None, None, [], [], []
        state.update((done, arrival, parts, held, ids, texts))
        state.setTimeoutDuration(forget_ms if arrival is None else patience_ms)
        yield pd.DataFrame(out + whole, columns=names)

    return landed.groupBy(*RANGE).applyInPandasWithState(run, ANSWERS, _STATE, "append", "ProcessingTimeTimeout")


def settled(batch: DataFrame, state: DataFrame, now_ms: int, patience_ms: int = HOUR_MS, forget_ms: int = 7 * 24 * HOUR_MS) -> tuple[DataFrame, DataFrame]:
    """What ``settle`` gives for a batch of parts and a table of REQUESTS, and the table after it: a few windows instead of a call per request.

    All windows lie within a request, so each part is moved once.
    """
    known = state.select(*RANGE, "done", F.col("arrival").alias("pending"), F.col("parts").alias("of"), "seen", "held")
    held = known.select(*RANGE, F.col("pending").alias("arrival"), F.col("of").alias("parts"), F.inline("held")).withColumn("old", F.lit(True))
    rows = batch.select(*RANGE, "arrival", "part", "parts", "request_id", "response").withColumn("old", F.lit(False))
    rows = rows.unionByName(held).unionByName(known.drop("of", "held"), allowMissingColumns=True)
    request = Window.partitionBy(*RANGE)
    rows = rows.withColumns({c: F.max(c).over(request) for c in ("done", "pending", "seen")} | {"touched": F.max(~F.col("old")).over(request)})
    stale = (F.col("arrival") <= F.coalesce("done", F.lit(-(2**63)))) | (F.col("arrival") < F.coalesce("pending", F.lit(-(2**63))))
    # of a part that comes again the held one stays, then the largest text
    order = [F.col("old").desc(), F.coalesce("response", F.lit("")).desc(), F.coalesce("request_id", F.lit("")).desc(), F.col("parts").desc()]
    again = F.row_number().over(Window.partitionBy(*RANGE, "arrival", "part").orderBy(*order)) > 1
    rows = rows.withColumns({"stale": stale, "again": again}).where(F.col("arrival").isNull() | F.col("stale") | ~F.col("again"))
    fresh = F.col("arrival").isNotNull() & ~F.col("stale")
    answer = Window.partitionBy(*RANGE, "arrival")
    rows = rows.withColumns({"n": F.count_if(fresh).over(answer), "of": F.max(F.when(fresh, F.col("parts"))).over(answer)})
    rows = rows.withColumn("best", F.max(F.when(fresh & (F.col("n") >= F.col("of")), F.col("arrival"))).over(request))
    rows = rows.withColumn("last", F.max(F.when(fresh, F.col("arrival"))).over(request))
    status = (
        F.when(F.col("arrival").isNull(), _KNOWN)
        .when(F.col("stale"), LATE)
        .when(F.col("arrival") == F.col("best"), COMPLETE)
        .when(F.col("arrival") == F.col("last"), _PENDING)
        .otherwise(LATE)
    )
    rows = rows.withColumn("status", status).withColumn("parts", F.when(fresh, F.col("of")).otherwise(F.col("parts")))
    rows = rows.withColumn("response", F.when(F.col("status").isin(COMPLETE, _PENDING), F.col("response")))
    rows = rows.select(*[f.name for f in T.StructType.fromDDL(ANSWERS)], "done", "best", "seen", "touched")
    path = shared_folder(batch.sparkSession, "answers")
    rows.write.parquet(path)  # both results are read from it
    rows = batch.sparkSession.read.schema(rows.schema).parquet(path)

    pending = F.col("status") == _PENDING
    part = F.struct("part", "request_id", "response")
    after = rows.where(F.col("status") != LATE).withColumn("response", F.when(pending, F.col("response"))).groupBy(*RANGE).agg(
        F.coalesce(F.max("best"), F.max("done")).alias("done"),
        F.max(F.when(pending, F.col("arrival"))).alias("arrival"),
        F.max(F.when(pending, F.col("parts"))).alias("parts"),
        F.when(F.max("touched"), F.lit(now_ms)).otherwise(F.max("seen")).alias("seen"),
        F.sort_array(F.collect_list(F.when(pending, part)), False).alias("held"),
        F.coalesce(F.max("touched"), F.lit(False)).alias("touched"),
    )
    waits = F.when(F.col("arrival").isNull(), F.lit(forget_ms)).otherwise(F.lit(patience_ms))
    after = after.withColumn("over", ~F.col("touched") & (F.col("seen") + waits <= now_ms))
    given_up = after.where(F.col("over") & F.col("arrival").isNotNull()).select(
        F.get("held", F.lit(0))["request_id"].alias("request_id"), *RANGE, "arrival", "parts", F.lit(INCOMPLETE).alias("status")
    )
    answers = rows.where(F.col("status").isin(COMPLETE, LATE)).drop("done", "best", "seen", "touched")
    answers = answers.unionByName(given_up, allowMissingColumns=True)
    after = after.where(~F.col("over") | (F.col("arrival").isNotNull() & F.col("done").isNotNull()))
    cleared = {c: F.when(~F.col("over"), F.col(c)) for c in ("arrival", "parts")}
    cleared |= {"held": F.when(F.col("over"), F.array().cast(after.schema["held"].dataType)).otherwise(F.col("held"))}
    after = after.withColumns(cleared | {"seen": F.when(F.col("over"), F.lit(now_ms)).otherwise(F.col("seen"))})
    return answers, after.select(*[f.name for f in T.StructType.fromDDL(REQUESTS)])


def staged_rows(responses: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Normalised rows of classified responses with what each was asked for, written once.

    What is checked is then what is published, and no text is parsed twice.
    """
    asked = responses.withColumnsRenamed({c: f"_asked_{c}" for c in ("key", "start", "end")})
    keep = ["request_id", "_asked_key", "_asked_start", "_asked_end"]
    rows = envelope.normalize(envelope.explode_items(asked, spec, keep), spec)
    spark = responses.sparkSession
    path = shared_folder(spark, "incoming")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def foreign_rows(staged: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Rows that their own request didn't ask for, whatever other requests did."""
    day = F.col(spec.time_field)
    own = (
        (F.col(spec.partition_key).cast("string") == F.col("_asked_key"))
        & (day >= F.col("_asked_start"))
        & (day < F.col("_asked_end"))
    )
    return staged.where(~F.coalesce(own, F.lit(False)))


def publish_batch(
    batch: DataFrame,
    batch_id: int,
    dataset: Dataset,
    stream_id: str,
    now: datetime,
    on_gap: str = "error",
) -> str:
    """Validate one micro-batch and publish it; a batch already published changes nothing.

    Of several answers to one request (key and range) the newest arrival wins, with all its parts.
    Any bad response, bad row, missing part or row that its own request didn't ask for fails the
    whole batch.
    """
    spec = dataset.refresh().spec
    if dataset.manifest and dataset.manifest.batches.get(stream_id, -1) >= batch_id:
        return dataset.manifest.publication_id
    responses = envelope.classify(newest_answers(batch)).persist(StorageLevel.DISK_ONLY)
    try:
        validate.require_none(responses.where("missing > 0").select("request_id", *RANGE, "missing"), f"{spec.name}: parts missing")
        validate.require_none(
            envelope.response_problems(responses, spec, "request_id"), f"{spec.name}: bad responses"
        )
        rows = staged_rows(responses, spec)
        validate.require_none(
            rows.where(F.size("violations") > 0), f"{spec.name}: bad response rows"
        )
        validate.require_none(foreign_rows(rows, spec), f"{spec.name}: rows outside their request")
        jobs = responses.select(*RANGE).distinct()
        held = dataset.coverage() if dataset.manifest else jobs.limit(0)
        plan = ingest.by_key(
            envelope.typed_rows(rows, spec), jobs, spec, held, now, on_gap
        )
        return plan.publish(dataset, (stream_id, batch_id))
    finally:
        responses.unpersist()


def start(
    landed: DataFrame,
    dataset: Dataset,
    checkpoint: str,
    stream_id: str,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    on_gap: str = "error",
    unused: str | None = None,
    patience_ms: int = HOUR_MS,
    forget_ms: int = 7 * 24 * HOUR_MS,
    **trigger,
) -> StreamingQuery:
    """Publish every request's newest complete answer.

    Late parts and incomplete answers land below ``unused``, one folder per micro-batch; without
    it an incomplete answer stops the stream. What is known of the requests lies in a table below the
    checkpoint, which each batch writes anew: a repeated batch finds the table before it. Answers are
    given up and requests forgotten with the next landed files.
    """
    if dataset.spec.time_field is None:
        raise ContractError("streamed ingest needs a dataset with a time field")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        slots = [f"{checkpoint}/requests/{n % 2}" for n in (batch_id - 1, batch_id)]
        state = spark.read.schema(REQUESTS).parquet(slots[0]) if batch_id else spark.createDataFrame([], REQUESTS)
        answers, state = settled(batch, state, int(time.time() * 1000), patience_ms, forget_ms)
        left = answers.where(F.col("status") != COMPLETE).drop("response")
        if unused:
            left.write.mode("overwrite").parquet(f"{unused}/{sinks.BATCH}={batch_id}")
        else:
            validate.require_none(left.where(F.col("status") == INCOMPLETE), f"{dataset.spec.name}: incomplete answers")
        whole = answers.where(F.col("status") == COMPLETE).drop("status")
        if not whole.isEmpty():
            publish_batch(whole, batch_id, dataset, stream_id, clock(), on_gap)
        state.write.mode("overwrite").parquet(slots[1])

    return (
        landed.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(run)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
