"""Published revisions of a dataset.

Layout under ``<root>/<namespace>/<name>``::

    rev=<n>-<publication>/data/[_month=YYYY-MM/]part-*.parquet
    rev=<n>-<publication>/coverage/part-*.parquet
    manifests/<n>.json

A manifest pins one revision: where each month of data lives, the coverage folder and the
publication id. Data folders are never changed after they are written, so a reader that
holds a manifest sees one revision for as long as it likes. A writer stores only the months
its mutations touch and points at older folders for the rest. The manifest is written last
under a name no other writer can take as well, which makes data and coverage visible
together and turns a lost race into ``PublishConflictError``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import date
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from covspark.errors import (
    ContractError,
    DatasetNotFoundError,
    DatasetNotReadyError,
    PublishConflictError,
)
from covspark.operators import coverage as cov
from covspark.operators import mutate, validate
from covspark.operators import query as relation
from covspark.operators import sql as guarded
from covspark.operators.mutate import COMPLETE, PRIMARY_KEYS, RANGE, Mutation
from covspark.spec import COVERAGE_SCHEMA, DatasetSpec, check_name

WHOLE = ""
MONTH = "_month"
LAYOUT = 1


class _Files:
    """The few file-system calls a manifest needs, through Hadoop's own client."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self.path(path))]

    def read(self, path: str) -> str:
        stream = self._fs.open(self.path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> bool:
        """Write a whole file under a free name; False when the name is taken."""
        parent = path.rsplit("/", 1)[0]
        draft = f"{parent}/_draft-{uuid.uuid4().hex}"
        stream = self._fs.create(self.path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kind = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self._conf
        )
        try:
            context.rename(self.path(draft), self.path(path), options)
        except Py4JJavaError as exc:
            self._fs.delete(self.path(draft), False)
            if "FileAlreadyExistsException" in str(exc.java_exception):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        """Drop a folder no manifest has ever named."""
        self._fs.delete(self.path(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self.path(path))

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self.path(path)).getLength()


@dataclass(frozen=True)
class Manifest:
    """What one revision consists of. ``parts`` maps a month (or "" for all) to a folder."""

    revision: int
    publication_id: str
    dataset: str
    schema: str
    primary_key: list[str]
    partition_key: str | None
    time_field: str | None
    policy: str
    parts: dict[str, str]
    coverage: str | None
    batches: dict[str, int] = field(default_factory=dict)
    metrics: dict[str, int] = field(default_factory=dict)
    layout: int = LAYOUT


class Dataset:
    """One dataset under a root folder, pinned to the revision it was opened at."""

    def __init__(self, spark: SparkSession, root: str, spec: DatasetSpec):
        self.spark = spark
        self.spec = spec
        self.path = f"{root.rstrip('/')}/{check_name(spec.name)}"
        self._files = _Files(spark, root)
        self.manifest: Manifest | None = None
        self.refresh()

    # reading

    def refresh(self) -> "Dataset":
        """Pin the newest revision."""
        found = [
            int(name.removesuffix(".json"))
            for name in self._files.names(f"{self.path}/manifests")
            if name.endswith(".json") and name.removesuffix(".json").isdigit()
        ]
        self.manifest = self._load(max(found)) if found else None
        return self

    def _load(self, revision: int) -> Manifest:
        raw = json.loads(self._files.read(f"{self.path}/manifests/{revision}.json"))
        manifest = Manifest(**raw)
        if manifest.layout != LAYOUT:
            raise DatasetNotReadyError(f"{self.spec.name}: unknown layout {manifest.layout}")
        expected = self._contract()
        if {k: getattr(manifest, k) for k in expected} != expected:
            raise ContractError(f"{self.spec.name} was published under another contract")
        return manifest

    def _contract(self) -> dict[str, Any]:
        spec = self.spec
        return {
            "dataset": spec.name,
            "schema": spec.schema.json(),
            "primary_key": list(spec.primary_key),
            "partition_key": spec.partition_key,
            "time_field": spec.time_field,
            "policy": spec.policy,
        }

    def _ready(self) -> Manifest:
        if self.manifest is None:
            raise DatasetNotReadyError(f"{self.spec.name} has no published revision")
        return self.manifest

    def _read(self, folders: Sequence[str], schema) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def scan(self, months: Sequence[str] | None = None) -> DataFrame:
        """The pinned revision, or only some of its months."""
        parts = self._ready().parts
        chosen = parts if months is None else {m: parts[m] for m in months if m in parts}
        return self._read(sorted(set(chosen.values())), self.spec.schema)

    def coverage(self, keys: Sequence[str] | DataFrame | None = None) -> DataFrame:
        manifest = self._ready()
        cov.require_time(self.spec)
        held = self._read([manifest.coverage] if manifest.coverage else [], COVERAGE_SCHEMA)
        return cov.read(held, keys)

    def query(self, **options: Any) -> DataFrame:
        """See ``operators.query.query``. Months outside the time range are not opened."""
        bounds = relation.time_bounds(options.get("time_range"))
        months = None
        if bounds and self.spec.time_field and WHOLE not in self._ready().parts:
            first, last = f"{bounds[0]:%Y-%m}", f"{date.fromordinal(bounds[1].toordinal() - 1):%Y-%m}"
            months = [m for m in self._ready().parts if first <= m <= last]
        held = None
        if options.get("require_coverage") and self.spec.time_field:
            held = self.coverage()
        return relation.query(self.scan(months), self.spec, coverage=held, **options)

    def preview(self, limit: int = relation.PREVIEW_ROWS, **options: Any) -> DataFrame:
        return self.query(limit=limit, **relation.data_view_arguments(self.spec, **options))

    def sql(self, text: str, limit: int | None = None) -> DataFrame:
        return guarded.run(self.scan(), text, limit)

    def history(self) -> DataFrame:
        """One row per publication: revision, id, mutations and rows written."""
        self._ready()
        kept = (
            "revision bigint, publication_id string, "
            "metrics struct<mutations: bigint, rows_written: bigint>"
        )
        read = self.spark.read.schema(kept).option("multiLine", True).option(
            "pathGlobFilter", "[0-9]*.json"
        )
        return read.json(f"{self.path}/manifests").select("revision", "publication_id", "metrics.*")

    def storage_bytes(self) -> int:
        """Bytes the pinned revision refers to."""
        manifest = self._ready()
        folders = {*manifest.parts.values(), *filter(None, [manifest.coverage])}
        return sum(self._files.size(f"{self.path}/{f}") for f in folders)

    # writing

    def publish(
        self,
        mutations: Sequence[Mutation],
        coverage: DataFrame | None = None,
        batch: tuple[str, int] | None = None,
    ) -> str:
        """Apply mutations to the pinned revision and publish data and coverage together.

        ``coverage`` replaces the whole coverage table and is required for datasets with a
        time field. ``batch`` = (stream id, batch number) makes a repeated batch a no-op.
        """
        spec, old = self.spec, self.manifest
        if batch and old and old.batches.get(batch[0], -1) >= batch[1]:
            return old.publication_id
        if spec.time_field and coverage is None:
            raise ContractError(f"{spec.name} has a time field; its commits need coverage")
        if not spec.time_field and coverage is not None and not coverage.isEmpty():
            raise ContractError(f"{spec.name} has no time field and takes no coverage")
        for mutation in mutations:
            mutate.check(mutation, spec)
        if coverage is not None and spec.time_field:
            validate.require_none(
                validate.coverage(coverage.select("key", "start", "end")),
                f"{spec.name}: invalid coverage",
            )

        publication = uuid.uuid4().hex
        revision = (old.revision if old else 0) + 1
        home = f"rev={revision}-{publication}"
        written = Observation()
        held = f"{home}/coverage" if spec.time_field else None
        try:
            parts = self._write_data(mutations, home, dict(old.parts) if old else {}, written)
            if held:
                coverage.select(
                    *[F.col(f.name).cast(f.dataType) for f in COVERAGE_SCHEMA]
                ).write.parquet(f"{self.path}/{held}")
        except BaseException:
            self._files.remove(f"{self.path}/{home}")
            raise
        batches = dict(old.batches) if old else {}
        if batch:
            batches[batch[0]] = batch[1]
        manifest = Manifest(
            revision=revision,
            publication_id=publication,
            parts=parts,
            coverage=held,
            batches=batches,
            metrics={
                "mutations": len(mutations),
                "rows_written": written.get["rows"] if mutations else 0,
            },
            **self._contract(),
        )
        target = f"{self.path}/manifests/{revision}.json"
        self._files.make(f"{self.path}/manifests")
        if not self._files.put_new(target, json.dumps(asdict(manifest), indent=1)):
            self._files.remove(f"{self.path}/{home}")
            raise PublishConflictError(f"{spec.name}: revision {revision} was published meanwhile")
        self.manifest = manifest
        return publication

    def _write_data(
        self,
        mutations: Sequence[Mutation],
        home: str,
        parts: dict[str, str],
        written: Observation,
    ) -> dict[str, str]:
        if not mutations:
            return parts
        spec, target = self.spec, f"{home}/data"
        by_month = spec.time_field is not None and spec.time_field in spec.primary_key
        replaced = any(m.kind == COMPLETE for m in mutations)
        if not by_month:
            base = None if self.manifest is None or replaced else self.scan()
            result = mutate.apply(base, mutations, spec)
            result = result.observe(written, F.count(F.lit(1)).alias("rows"))
            result.write.parquet(f"{self.path}/{target}")
            self._check_written(mutations, [target])
            return {WHOLE: target}

        touched = None if replaced else self._touched(mutations)
        kept = {} if touched is None else {m: f for m, f in parts.items() if m not in touched}
        base = None
        if self.manifest is not None and not replaced:
            base = self.scan(sorted(touched))
        result = mutate.apply(base, mutations, spec)
        # AQE merges small months into one task and splits big ones over many; sorted files
        # let a keyed query skip row groups
        order = [MONTH, *[c for c in (spec.partition_key, spec.time_field) if c]]
        (
            result.withColumn(MONTH, F.date_format(spec.time_field, "yyyy-MM"))
            .hint("rebalance", MONTH)
            .sortWithinPartitions(*order)
            .observe(written, F.count(F.lit(1)).alias("rows"))
            .write.partitionBy(MONTH)
            .parquet(f"{self.path}/{target}")
        )
        folders = {
            name.split("=", 1)[1]: f"{target}/{name}"
            for name in self._files.names(f"{self.path}/{target}")
            if name.startswith(f"{MONTH}=")
        }
        self._check_written(mutations, sorted(folders.values()))
        return {**kept, **folders}

    def _touched(self, mutations: Sequence[Mutation]) -> set[str]:
        """Months any mutation can change; civil time bounds how many there are."""
        from covspark.functions.dates import month_starts

        found: set[str] = set()
        for mutation in mutations:
            days = mutation.rows.select(F.date_format(self.spec.time_field, "yyyy-MM").alias("m"))
            if mutation.kind == RANGE:
                spans = mutation.scopes.select(
                    F.explode(month_starts(F.col("start"), F.col("end"))).alias("d")
                ).select(F.date_format("d", "yyyy-MM").alias("m"))
                days = days.union(spans)
            found |= {row["m"] for row in days.distinct().collect() if row["m"] is not None}
        return found

    def _check_written(self, mutations: Sequence[Mutation], folders: Sequence[str]) -> None:
        """Keys must be unique and non-null before the manifest shows them.

        The base revision was checked when it was written and one mutation deletes every
        base row its rows could collide with, so then only its own rows need the check.
        """
        spec, key = self.spec, list(self.spec.primary_key)
        rows = self._read(folders, spec.schema)
        own = {spec.partition_key, spec.time_field} <= set(key)
        if len(mutations) == 1 and (
            mutations[0].kind == PRIMARY_KEYS or (mutations[0].kind == RANGE and own)
        ):
            rows = mutations[0].rows
        validate.require_none(
            validate.keys(rows.select(*key), key),
            f"{spec.name}: primary keys must be unique and non-null",
        )

    def export_snapshot(self, destination: str) -> str:
        """A self-contained copy of the pinned revision: data, coverage, manifest."""
        manifest = self._ready()
        there = destination.rstrip("/")
        if there == self.path or there.startswith(f"{self.path}/"):
            raise ValueError("the snapshot destination is inside the live dataset")
        if self._files.exists(there):
            raise FileExistsError(there)
        self.scan().write.parquet(f"{there}/data")
        if self.spec.time_field:
            self.coverage().write.parquet(f"{there}/coverage")
        self._files.make(there)
        self._files.put_new(f"{there}/manifest.json", json.dumps(asdict(manifest), indent=1))
        return there


def open_dataset(
    spark: SparkSession, root: str, name: str, specs: dict[str, DatasetSpec]
) -> Dataset:
    """Open a registered dataset by name; nothing is created."""
    check_name(name)
    if name not in specs:
        raise DatasetNotFoundError(name)
    return Dataset(spark, root, specs[name])
