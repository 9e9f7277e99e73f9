"""Writers of detections, cleanup results, review sheets and reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.parse import clip_name


STAGED = "_staged"


def named_files() -> type[DataSource]:
    """A sink of files with given names: rows ``(file, content)``, the rows of a file side by side, go to ``<root>/<file>``.

    A task attempt writes below a folder of its own, ``<root>/_staged-<job>/<attempt>``, and reports its files.  Only the driver's commit, which gets
    one report a partition, moves files to their names and then writes ``_SUCCESS`` with their number; files of other attempts and
    of failed jobs go with the staging folder.  Readers skip names that begin with an underscore, so nothing is seen before.
    """

    # Defined in here so that it is sent to the planner and to workers by value.
    @dataclass
    class Written(WriterCommitMessage):
        folder: str
        files: list

    class Writer(DataSourceArrowWriter):
        def __init__(self, root: str, header: str | None):
            self.root, self.header, self.staged = root.rstrip("/"), header, f"{STAGED}-{uuid.uuid4().hex}"

        def _store(self) -> tuple:
            fs, base = pa_fs.FileSystem.from_uri(self.root)
            return fs, base, f"{base}/{self.staged}"

        def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
            fs, _, staged = self._store()
            folder, files, name, out = f"{staged}/{uuid.uuid4().hex}", [], None, None
            for batch in iterator:
                for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    if file != name:
                        if out:
                            out.close()
                        name = file
                        files.append(file)
                        fs.create_dir(f"{folder}/{file}".rsplit("/", 1)[0], recursive=True)
                        out = fs.open_output_stream(f"{folder}/{file}")
                        if self.header is not None:
                            out.write(f"{self.header}\n".encode())
                    if content is not None:
                        out.write(content)
            if out:
                out.close()
            return Written(folder, files)

        def commit(self, messages: list) -> None:
            fs, base, staged = self._store()
            fs.create_dir(base, recursive=True)
            made = set()
            for message in messages:
                for file in message.files:
                    folder = f"{base}/{file}".rsplit("/", 1)[0]
                    if folder not in made:
                        fs.create_dir(folder, recursive=True)
                        made.add(folder)
                    fs.move(f"{message.folder}/{file}", f"{base}/{file}")
            self._clear(fs, staged)
            with fs.open_output_stream(f"{base}/_SUCCESS") as out:
                out.write(str(sum(len(m.files) for m in messages)).encode())

        def abort(self, messages: list) -> None:
            fs, _, staged = self._store()
            self._clear(fs, staged)

        def _clear(self, fs: pa_fs.FileSystem, staged: str) -> None:
            if fs.get_file_info(staged).type == pa_fs.FileType.Directory:
                fs.delete_dir(staged)

    class NamedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "named_files"

        def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
            return Writer(self.options["root"], self.options.get("header"))

    return NamedFiles


def save_named(rows: DataFrame, root: str, header: str | None = None) -> int:
    """Write ``rows(file, content)``, of which a file's rows lie side by side in one partition, by named_files; gives the number of files."""
    rows.sparkSession.dataSource.register(named_files())
    out = rows.select("file", F.col("content").cast("binary").alias("content")).write.format("named_files").mode("append").option("root", root)
    (out if header is None else out.option("header", header)).save()
    fs, base = pa_fs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{base.rstrip('/')}/_SUCCESS") as done:
        return int(done.read())


def write_files(rows: DataFrame, root: str, file: str, order: Sequence[str], header: Sequence[str]) -> int:
    """CSV files of given names below ``root`` (the column ``file``), each with a header line and the columns ``header`` of its rows in order.

    A row whose columns are all null only makes its file.  All files appear when the job commits, none if it fails.  Gives the number of files.
    """
    cells = F.when(F.coalesce(*(F.col(c).cast("string") for c in header)).isNotNull(), F.concat(F.to_csv(F.struct(*header)), F.lit("\n")))
    lines = rows.select(F.col(file).alias("file"), cells.alias("content"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(order)))
    return save_named(lines.repartition("file").sortWithinPartitions("file", *(f"_{i}" for i in range(len(order)))), root, ",".join(header))


DETECTION_HEADER = ("start_time", "end_time", "species", "confidence")


def write_detection_files(det: DataFrame, recordings: DataFrame, root: str, suffix: str = "_detections.csv") -> int:
    """``<station>/<recording>_detections.csv`` for every recording, with a header alone where nothing was detected."""
    name = F.concat("station", F.lit("/"), "recording", F.lit(suffix)).alias("file")
    rows = det.select(name, F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time"), "species", "confidence")
    none = recordings.select(name).distinct()
    return write_files(rows.unionByName(none, allowMissingColumns=True), root, "file", ["start_time", "confidence"], DETECTION_HEADER)


def write_cleanup_files(det: DataFrame, root: str) -> int:
    """``<station>/clean_detections.csv`` and ``suspicious_detections.csv``, the layout that read_cleanup takes."""
    kind = F.when(F.col("n_flags") == 0, "clean").otherwise("suspicious")
    rows = det.withColumn("file", F.concat("station", F.lit("/"), kind, F.lit("_detections.csv"))).withColumn("source_file", F.concat("recording", F.lit(".wav"))).withColumn("start_time", F.col("start_s"))
    header = [c for c in ("station", "det_id", "species", "source_file", "start_time", "confidence", "n_neighbours", "n_flags", "flag_reason", "flag_isolated") if c in rows.columns]
    return write_files(rows, root, "file", ["start_time", "det_id"], header)


def write_detections(det: DataFrame, recordings: DataFrame, path: str) -> None:
    """CSV files by station and recording, and a table of all recordings with their counts, so that empty ones are on record."""
    out = det.select("station", "recording", "start_s", "end_s", "species", "confidence")
    out.repartition("station", "recording").sortWithinPartitions("station", "recording", "start_s").write.partitionBy("station", "recording").option("header", True).csv(f"{path}/detections")
    n = det.groupBy("recording").agg(F.count("*").alias("detections"))
    recordings.select("recording").distinct().join(n, "recording", "left").na.fill(0).write.parquet(f"{path}/recordings")


def write_cleanup(det: DataFrame, path: str, drop: tuple[str, ...] = ("probs",)) -> None:
    """Clean and suspicious detections in folders of their own, without the score vectors."""
    det.drop(*drop).withColumn("cleanup", F.when(F.col("n_flags") == 0, "clean").otherwise("suspicious")).write.partitionBy("cleanup").parquet(path)


def review_sheet(queue: DataFrame) -> DataFrame:
    """The queue as a sheet for reviewers: folder, clip and a blank verdict first."""
    return queue.select(
        F.concat_ws("/", "species", "station").alias("INDIR"), clip_name(F.col("recording"), F.col("start_s"), F.col("confidence")).alias("IN FILE"), F.lit("").alias("MANUAL ID"),
        "queue_no", "episode_no", "episode_size", "listen_first", "rank_score",
    )


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One table a report."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys ``path`` does not have yet; a first run writes all."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(conf).exists(at):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(*keys).distinct(), keys, "left_anti")
    rows.write.mode("append").parquet(path)


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")
