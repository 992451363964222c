"""One JSON document of any size, written by all tasks and put in place at once.

The document is a folder whose files, joined in name order, are one JSON text: a head, one file per
non-empty task with its lines in order, and a tail. Tasks write under a staging folder beside the target. The
commit names the files of the attempts that count and renames the folder to the target; an abort
deletes it. So the target is absent or whole, whatever fails, and no task or driver holds the document.

Files are reached through Arrow's file systems, chosen by the path's scheme.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "json_document"


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _exists(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its number and its file, None without rows."""

    part: int
    name: str | None


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, head: str, tail: str, overwrite: bool):
        self.path, self.head, self.tail, self.overwrite = path.rstrip("/"), head, tail, overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        files, at = _open(self.path)
        if _exists(files, at) and not overwrite:
            raise FileExistsError(self.path)

    def write(self, iterator) -> Written:
        """The task's lines, as they come, in a file of this attempt."""
        task = TaskContext.get()
        part, name, out = task.partitionId(), f"task-{task.partitionId()}-{task.taskAttemptId()}", None
        files, at = _open(self.staging)
        try:
            for batch in iterator:
                lines = batch.column(0).to_pylist()
                if lines:
                    if out is None:
                        files.create_dir(at, recursive=True)
                        out = files.open_output_stream(f"{at}/{name}")
                    out.write(("\n".join(lines) + "\n").encode("utf-8", "surrogatepass"))
        finally:
            if out is not None:
                out.close()
        return Written(part, name if out is not None else None)

    def commit(self, messages) -> None:
        files, at = _open(self.staging)
        files.create_dir(f"{at}/doc", recursive=True)
        done = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part)
        for i, m in enumerate(done):
            files.move(f"{at}/{m.name}", f"{at}/doc/part-{i + 1:08d}.json")
        for i, text in ((0, self.head), (len(done) + 1, self.tail)):
            with files.open_output_stream(f"{at}/doc/part-{i:08d}.json") as out:
                out.write((text + "\n").encode("utf-8", "surrogatepass"))
        target = _open(self.path)[1]
        old = f"{at}/old"
        if _exists(files, target):
            if not self.overwrite:
                files.delete_dir(at)
                raise FileExistsError(self.path)
            files.move(target, old)
        files.move(f"{at}/doc", target)
        files.delete_dir(at)

    def abort(self, messages) -> None:
        files, at = _open(self.staging)
        if _exists(files, at):
            files.delete_dir(at)


class JsonDocument(DataSource):
    """Sink of lines (one string column) between options ``head`` and ``tail``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options.get("head", "["), self.options.get("tail", "]"), overwrite)


def write_document(
    rows: DataFrame, order: list[str], value: str, path: str, head: str, tail: str, overwrite: bool = False
) -> None:
    """Write ``head``, the JSON texts of column ``value`` in the order of ``order``, and ``tail``.

    ``order`` must identify a row. Rows are range-partitioned by it, so each task holds a run of them; the first row
    of all is known by its key, every other one begins with the comma that parts it from the one before.
    """
    spark = rows.sparkSession
    spark.dataSource.register(JsonDocument)
    key = F.struct(*order)
    first = rows.agg(F.min(key)).scalar()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    text = F.when(key == first, F.col(value)).otherwise(F.concat(F.lit(","), F.col(value)))
    out = ordered.select(text.alias("value")).write.format(FORMAT).options(head=head, tail=tail)
    out.mode("overwrite" if overwrite else "append").save(path)


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the document's lines as rows."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
