"""Scoring runs that stop, continue and reset, with the scored ids as keyed state.

A run is a folder with a checkpoint and a result table. The ids already scored are the state of
``dropDuplicates`` in a RocksDB state store: a micro-batch looks up its own ids only, whatever the
number of results, and no result is read back. Only ids are state; the store keeps them on the
executors' disks and its changes in the checkpoint, from where a lost executor restores them. The file
sink's log commits each micro-batch once, so a replayed batch adds nothing.

Stop ends the query; starting it again continues from the checkpoint. Reset begins a new run: earlier
results are no longer read (the folder stays until it is deleted) and every ticket is scored again.

Defined results: a null id is a key like any other, so one such ticket is scored; of tickets with equal
ids in one micro-batch any one is scored; no tickets give an empty result table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbiter.streaming.tickets import DECISION_COLS, decide

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class TicketRun:
    """The newest run under ``root``; ``score`` maps unscored tickets to result rows with an id."""

    def __init__(self, spark: SparkSession, root: str, score: Callable[[DataFrame], DataFrame] = decide):
        # A session of its own: the state store's settings do not reach the caller's queries.
        self.session = spark.newSession()
        for k, v in STATE_CONF.items():
            self.session.conf.set(k, v)
        self.root, self.score = root.rstrip("/"), score

    def _fs(self):
        jvm, conf = self.session.sparkContext._jvm, self.session.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(conf), path, jvm.org.apache.hadoop.fs.Path

    @property
    def number(self) -> int:
        """Number of the newest run; 0 before the first."""
        fs, path, _ = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n[4:]) for n in names if n.startswith("run-")), default=0)

    def _folder(self) -> str:
        return f"{self.root}/run-{self.number:05d}"

    @property
    def results_dir(self) -> str:
        return f"{self._folder()}/results"

    @property
    def checkpoint_dir(self) -> str:
        return f"{self._folder()}/checkpoint"

    def reset(self) -> None:
        """Begin a new run without results. Stop the running query first."""
        fs, _, path = self._fs()
        fs.mkdirs(path(f"{self.root}/run-{self.number + 1:05d}"))

    def plan(self, source_dir: str, schema, files_per_trigger: int | None = None) -> DataFrame:
        """The streaming plan: arriving tickets whose id has no result yet, scored."""
        reader = self.session.readStream.schema(schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return self.score(reader.parquet(source_dir).dropDuplicates(["id"]))

    def start(self, source_dir: str, schema, available_now: bool = True, files_per_trigger: int | None = None):
        """Start or continue the run; with ``available_now`` it ends when all that is there is scored."""
        writer = (
            self.plan(source_dir, schema, files_per_trigger)
            .writeStream.format("parquet")
            .option("path", self.results_dir)
            .option("checkpointLocation", self.checkpoint_dir)
            .outputMode("append")
        )
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
        return writer.start()

    def results(self) -> DataFrame:
        """Committed results of the newest run."""
        fs, _, path = self._fs()
        if not fs.exists(path(f"{self.results_dir}/_spark_metadata")):
            return self.session.createDataFrame([], ", ".join(f"{c} string" for c in DECISION_COLS))
        return self.session.read.parquet(self.results_dir)

    def state(self) -> DataFrame:
        """The ids that the run's state holds (one row an id), from the checkpoint."""
        return self.session.read.format("statestore").load(self.checkpoint_dir).select("key.*")
