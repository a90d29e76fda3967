"""The example store: Parquet batches partitioned by split and round, unique by normalized text, and a log of commits.

``_commits`` holds a numbered manifest for each version: the batch that it adds, the next free id and the segments of the
index of norms (``norms``) as of that version, by which an insert finds stored texts without reading them. A manifest is
written beside and then takes its number in one step that fails where the number is taken (a rename of the file
system; a link on local disks), so versions have one writer each, and a batch is seen whole or not at all. A writer that
finds its number taken drops what the new versions already hold, takes new ids and tries the next number. Readers read
the batches up to a version, whatever is written meanwhile. Batches that no manifest names are never read.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.dedup import not_seen, with_norm
from textloom.operators.verify import agreement
from textloom.session import ensure_checkpoint_dir
from textloom.sources.norms import NormIndex
from textloom.types import LABELS, NONE_KEY, SPANS, Split

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("norm", T.StringType()),
        T.StructField("labels", LABELS),
        T.StructField("spans", SPANS),
        T.StructField("source", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("written_labels", LABELS),
        T.StructField("written_spans", SPANS),
        T.StructField("split", T.StringType()),
        T.StructField("round", T.IntegerType()),
    ]
)


def label_counts(rows: DataFrame, splits: list[str] | None = None) -> DataFrame:
    """``split, label, count``: labels once each, span labels once a span, nothing for rows with neither.

    Given ``splits`` without rows appear with a null label and count 0.
    """
    each = F.concat("labels", F.transform("spans", lambda s: s["label"]))
    named = F.when(F.size(each) == 0, F.array(F.lit(NONE_KEY))).otherwise(each)
    counts = rows.select("split", F.explode(named).alias("label")).groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("count")
    )
    if splits is None:
        return counts
    dim = rows.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return dim.join(counts, "split", "left").select("split", "label", F.coalesce("count", F.lit(0)).alias("count"))


class StoreConflict(RuntimeError):
    """Other writers took every version that this one tried for."""


#: Versions that a writer tries for.
TRIES = 20


class ExampleStore:
    """Labeled examples of a run, for several writers and readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.index = NormIndex(spark, f"{path}/_norms")

    def _file(self, *names: str):
        """A Hadoop path in the store and its file system."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """How many commits there are."""
        folder, system = self._file("_commits")
        if not system.exists(folder):
            return 0
        numbers = [f.getPath().getName() for f in system.listStatus(folder)]
        return max((int(n) for n in numbers if n.isdigit()), default=0)

    def manifests(self, version: int, after: int = 0) -> list[dict]:
        """What the versions after ``after`` up to ``version`` committed."""
        if version <= after:
            return []
        paths = [f"{self.path}/_commits/{n:012d}" for n in range(after + 1, version + 1)]
        lines = self.spark.read.text(paths, wholetext=True).collect()  # a line for each commit
        return sorted((json.loads(r["value"]) for r in lines), key=lambda m: m["version"])

    def _last(self, version: int) -> dict:
        """The manifest of a version; version 0 has the first id and no segments."""
        return self.manifests(version, version - 1)[0] if version else {"next_id": 0, "segments": []}

    def _batches(self, manifests: list[dict]) -> DataFrame:
        folders = [f"{self.path}/batch={m['batch']}" for m in manifests if m["rows"]]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*folders).select(*SCHEMA.names)

    def rows(self, version: int | None = None) -> DataFrame:
        """All stored rows as of a version (the last one); columns that older files lack are null."""
        return self._batches(self.manifests(self.version() if version is None else version))

    def segments(self) -> list[dict]:
        """The index's segments as of the last version."""
        return self._last(self.version())["segments"]

    def _publish(self, manifest: dict) -> bool:
        """Give a manifest its number; false if another writer has it."""
        made, system = self._file("_commits", f"_{uuid.uuid4().hex}")
        named, _ = self._file("_commits", f"{manifest['version']:012d}")
        out = system.create(made, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if system.getUri().getScheme() == "file":  # its rename would replace the other writer's manifest
                os.link(made.toUri().getPath(), named.toUri().getPath())
                return True
            return not system.exists(named) and system.rename(made, named)
        except FileExistsError:
            return False
        finally:
            system.delete(made, False)

    def load(self, split: Split, round_: int | None = None) -> DataFrame:
        """Examples of a split (and round) in insertion order; partitions are pruned."""
        found = self.rows().filter(F.col("split") == split.value)
        if round_ is not None:
            found = found.filter(F.col("round") == round_)
        return found.orderBy("id")

    def texts(self, *splits: Split) -> DataFrame:
        """Texts of the splits, or of all, in insertion order."""
        found = self.rows()
        if splits:
            found = found.filter(F.col("split").isin([s.value for s in splits]))
        return found.orderBy("id").select("text")

    def add(self, drafts: DataFrame, round_: int, source: str) -> int:
        """Insert drafts (``seq, text, labels, spans, split`` and audit columns) that no stored text equals.

        The first of equal texts wins. Returns how many rows were inserted.
        """
        given = drafts if "norm" in drafts.columns else with_norm(drafts)
        columns = {c: F.lit(None).cast(SCHEMA[c].dataType) for c in ("outcome", "written_labels", "written_spans")}
        columns = {c: e for c, e in columns.items() if c not in given.columns}
        columns |= {"source": F.lit(source), "created_at": F.lit(datetime.now(UTC)), "round": F.lit(round_)}
        ensure_checkpoint_dir(self.spark)
        given, known = given.checkpoint(), self.version()
        batch = self.index.insertable(given, self._last(known)["segments"]).withColumns(columns)
        for _ in range(TRIES):
            last = self._last(known)
            base = last["next_id"]
            name = uuid.uuid4().hex
            folder = f"{self.path}/batch={name}"
            placed = batch.withColumn("id", F.col("seq") + base)
            placed.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields]).write.partitionBy("split", "round").parquet(folder)
            written = self._batches([{"batch": name, "rows": 1}]) if self._any(folder) else self.spark.createDataFrame([], SCHEMA)
            told = written.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).first()
            if not told["n"]:
                self._drop(folder)
                return 0
            segments = self.index.extended(last["segments"], written, told["n"])
            manifest = {"version": known + 1, "batch": name, "rows": told["n"], "next_id": told["last"] + 1}
            if self._publish(manifest | {"segments": segments}):
                return told["n"]
            # what the other writers added since counts as stored; ids move behind theirs
            now = self.version()
            fresh = not_seen(written, self._batches(self.manifests(now, known))).withColumn("seq", F.col("id") - base)
            batch, known = fresh.checkpoint(), now
            self._drop(folder)
            self._drop(f"{self.path}/_norms/{segments[-1]['name']}")
        raise StoreConflict(f"{self.path}: {TRIES} versions were taken by other writers")

    def _any(self, folder: str) -> bool:
        path, system = self._file(folder.removeprefix(f"{self.path}/"))
        return any(f.isDirectory() for f in system.listStatus(path))

    def _drop(self, folder: str) -> None:
        path, system = self._file(folder.removeprefix(f"{self.path}/"))
        system.delete(path, True)

    def counts(self) -> dict[str, dict[str, int]]:
        """Label counts of every split."""
        found: dict[str, dict[str, int]] = {s.value: {} for s in Split}
        for r in label_counts(self.rows()).collect():
            found[r["split"]][r["label"]] = r["count"]
        return found

    def agreement(self) -> DataFrame:
        """How written labels compared with the labeler's, by split."""
        return agreement(self.rows().filter("outcome is not null"), "split")
