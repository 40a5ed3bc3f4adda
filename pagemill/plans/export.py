"""Article rows as stored, as exported, and the CSV files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from itertools import groupby
from operator import itemgetter
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import get_domain
from pagemill.operators.joins import lookup
from pagemill.operators.ordering import number_rows
from pagemill.session import cut_lineage

# Columns and labels of the article export and of the failure export.
EXPORT_COLUMNS = {
    "id": "ID", "website": "Website", "blog_url": "Blog URL", "canonical_url": "Canonical URL",
    "blog_title": "Blog Title", "meta_title": "Meta Title", "meta_description": "Meta Description",
    "author": "Author", "author_url": "Author URL", "publication_date": "Publication Date",
    "last_updated_date": "Last Updated Date", "category": "Category", "subcategory": "Subcategory", "tags": "Tags",
    "featured_image_url": "Featured Image URL", "word_count": "Word Count", "h1": "H1", "h2_headings": "H2 Headings",
    "h3_headings": "H3 Headings", "main_content": "Main Content", "introduction": "Introduction",
    "conclusion": "Conclusion", "faq_content": "FAQ Content", "extraction_status": "Extraction Status",
    "http_status": "HTTP Status", "extraction_date": "Extraction Date", "error_message": "Error Message",
}
FAILURE_COLUMNS = {
    "url": "URL", "error": "Error", "http_status": "HTTP Status", "retry_count": "Retry Count", "timestamp": "Timestamp",
}
# Read from a file at a time, and held of a table by a task: bytes, rows.
PIECE, ROWS = 1 << 22, 10_000
SUMMARY_COLUMNS = ["id", "blog_url", "blog_title", "author", "publication_date", "word_count", "extraction_status"]


def article_rows(extracted: DataFrame) -> DataFrame:
    """Stored article rows from extracted pages.

    Needs job_id, domain, raw_url, url (after redirects), http_status and extraction_date
    besides the extracted fields.
    """
    joined = lambda c, sep: F.concat_ws(sep, F.col(c))
    return extracted.select(
        F.sha2(F.concat_ws("\x1f", "job_id", "raw_url"), 256).alias("id"),
        "job_id", "raw_url", F.concat(F.lit("https://"), F.col("domain")).alias("website"),
        F.col("url").alias("blog_url"), "canonical_url", F.col("title").alias("blog_title"), "meta_title", "meta_description",
        "author", "author_url", F.col("published_date").alias("publication_date"),
        F.col("modified_date").alias("last_updated_date"), "category", F.lit(None).cast("string").alias("subcategory"),
        F.when(F.size("tags") > 0, joined("tags", ", ")).alias("tags"),
        F.col("featured_image").alias("featured_image_url"), "word_count", "h1",
        joined("h2_headings", "\n").alias("h2_headings"), joined("h3_headings", "\n").alias("h3_headings"),
        F.col("structured_content").alias("main_content"), "introduction", "conclusion", "faq_content",
        F.when(F.col("quality_ok"), "Success").otherwise("Partial").alias("extraction_status"), "http_status",
        "extraction_date", F.when(F.size("warnings") > 0, joined("warnings", "; ")).alias("error_message"),
    )


def article_summary(articles: DataFrame) -> DataFrame:
    return articles.select(*SUMMARY_COLUMNS)


def _iso(ts: Column) -> Column:
    """ISO text; the fraction is written only when there is one."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def export_rows(articles: DataFrame) -> DataFrame:
    """The 27 export columns in order, numbered by extraction date (then URL) within each job."""
    numbered = number_rows(articles.drop("id"), ["extraction_date", "blog_url"], "id", ["job_id"])
    shaped = numbered.withColumn("extraction_date", _iso(F.col("extraction_date")))
    return shaped.select("job_id", *EXPORT_COLUMNS)


def failure_export_rows(failures: DataFrame) -> DataFrame:
    return failures.orderBy("timestamp", "url").select(
        "url", "error", "http_status", "retry_count", _iso(F.col("timestamp")).alias("timestamp")
    )


def failure_summary(failures: DataFrame) -> DataFrame:
    return failures.select(*FAILURE_COLUMNS)


def export_name(website_url: Column, day: datetime) -> Column:
    """Folder name of an article export; ``day`` is the UTC clock of the run."""
    return F.concat_ws("_", get_domain(website_url), F.lit("blog_extraction"), F.lit(day.strftime("%Y-%m-%d")))


def failure_export_name(job_id: Column) -> Column:
    return F.concat(job_id, F.lit("_failed_urls"))


def _write_csv(df: DataFrame, labels: dict[str, str], path: str) -> None:
    named = df.select(*[F.col(c).alias(label) for c, label in labels.items()])
    named.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", encoding="UTF-8", lineSep="\n")


def write_articles_csv(articles: DataFrame, path: str) -> None:
    """One folder of CSV parts; parts follow the row numbers."""
    rows = export_rows(articles)
    n = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _write_csv(rows.repartitionByRange(n, "job_id", "id").sortWithinPartitions("job_id", "id"), EXPORT_COLUMNS, path)


def write_failures_csv(failures: DataFrame, path: str) -> None:
    _write_csv(failure_export_rows(failures), FAILURE_COLUMNS, path)


def write_job_exports(articles: DataFrame, names: DataFrame, folder: str) -> None:
    """One folder of CSV parts for each job, named by ``names`` (job_id, name); jobs that are not in ``articles`` keep theirs.

    ``folder/export=<name>``: rows numbered and in order, within and across parts. Only the folders of these jobs are replaced.
    """
    rows = lookup(export_rows(articles), names.select("job_id", F.col("name").alias("export")), "job_id")
    _write_folders(rows, ["export", "id"], EXPORT_COLUMNS, folder)


def write_job_failures(failures: DataFrame, folder: str) -> None:
    """One folder of failure rows for each job, in order of time, named after the job."""
    rows = failures.select(
        failure_export_name(F.col("job_id")).alias("export"), "url", "error", "http_status", "retry_count", _iso(F.col("timestamp")).alias("timestamp"))
    _write_folders(rows, ["export", "timestamp", "url"], FAILURE_COLUMNS, folder)


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:") or ":" not in folder:
        return fs.LocalFileSystem(), urlparse(folder).path if folder.startswith("file:") else folder
    return fs.FileSystem.from_uri(folder)


def _records(stream: Iterator[bytes]) -> Iterator[str]:
    """Records of a CSV file as ``_write_folders`` writes it, read piece by piece: lines, and those that a quoted value runs over together."""
    held, tail, quotes = [], b"", 0
    for piece in stream:
        *lines, tail = (tail + piece).split(b"\n")
        for line in lines:
            held.append(line)
            quotes += line.count(b'"')
            if quotes % 2 == 0:
                yield b"\n".join(held).decode()
                held = []
    if tail or held:
        yield b"\n".join([*held, tail]).decode()


def read_job_exports(spark: SparkSession, folder: str, labels: dict[str, str]) -> DataFrame:
    """The rows of all folders ``export=<name>``: a string column for each of ``labels``, and ``export``.

    There is a folder for each job, and Spark's own reader lists all files of all folders in the driver. Here tasks list the folders and their files,
    deal them out and cut files into records, piece by piece; Spark parses these.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    system, root = _file_system(folder.rstrip("/"))

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names = [x.base_name for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory and x.base_name.startswith("export=")]
                for at in range(0, len(names), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(names[at : at + ROWS], pa.string())], ["name"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = [x.base_name for x in system.get_file_info(fs.FileSelector(f"{root}/{name}")) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.string())], ["name", "file"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exports, lines, held = [], [], 0
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(exports, pa.string()), pa.array(lines, pa.string())], ["export", "line"])
        for batch in batches:
            for name, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = name.removeprefix("export=")
                export = None if value == "__HIVE_DEFAULT_PARTITION__" else re.sub(r"%([0-9A-Fa-f]{2})", lambda c: chr(int(c[1], 16)), value)
                with system.open_input_stream(f"{root}/{name}/{file}") as stream:
                    rows = (x for x in _records(iter(lambda: stream.read(PIECE), b"")) if x)  # as a CSV reader, without empty lines
                    next(rows, None)  # the header
                    for line in rows:
                        exports.append(export)
                        lines.append(line)
                        held += len(line)
                        if held >= PIECE or len(lines) >= ROWS:
                            yield packed()
                            exports, lines, held = [], [], 0
        yield packed()

    names = spark.range(0, 1, 1, 1).mapInArrow(folders, "name string").repartition(n)
    lines = names.mapInArrow(files, "name string, file string").repartition(n).mapInArrow(records, "export string, line string")
    schema = ", ".join(f"`{label}` string" for label in labels.values())
    return lines.select(F.from_csv("line", schema, {"escape": '"', "lineSep": "\n"}).alias("_r"), "export").select("_r.*", "export")


def _write_folders(rows: DataFrame, order: list[str], labels: dict[str, str], folder: str) -> None:
    """Write ``rows`` by ``order``, which begins with ``export``, and put them in place of the folders ``export=<name>`` they are of.

    There is a small file for each job, so tasks make the files, and tasks put them in place: Hadoop's local file system starts a process or
    more for each file it makes, and Spark's commit moves one folder after the other in the driver. Rows become lines in Spark. The files of a task's
    attempt lie in a staging folder; only those of attempts that counted are put in place, after all are written. Doing that again does no harm.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    system, root = _file_system(folder.rstrip("/"))
    run, special = uuid.uuid4().hex, re.compile(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]")
    staging, header = f"{root}/.staging-{run}", (",".join(labels.values()) + "\n").encode()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, part = f"{staging}/{uuid.uuid4().hex}", f"part-{TaskContext.get().partitionId():05d}-{run}.csv"
        system.create_dir(place, recursive=True)
        name, out, made = None, None, 0
        for batch in batches:
            closed = []
            # Names as Spark and Hive write them into paths.
            names = ["export=" + (special.sub(lambda c: f"%{ord(c[0]):02X}", x) if x else "__HIVE_DEFAULT_PARTITION__") for x in batch.column(0).to_pylist()]
            for here, lines in groupby(zip(names, batch.column(1).to_pylist(), strict=True), itemgetter(0)):
                if here != name:
                    if out is not None:
                        out.close()
                        closed.append((name, f"{place}/{made}", part))
                    name, made = here, made + 1
                    out = system.open_output_stream(f"{place}/{made}")
                    out.write(header)
                out.write("".join(line + "\n" for _, line in lines).encode())
            yield pa.RecordBatch.from_pylist([{"name": a, "file": b, "part": c} for a, b, c in closed], files)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "file": f"{place}/{made}", "part": part}], files)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                target, parts = f"{root}/{row['name']}", {f["part"] for f in row["files"]}
                system.create_dir(target, recursive=True)
                for old in system.get_file_info(fs.FileSelector(target)):
                    if old.base_name not in parts:
                        system.delete_dir(old.path) if old.type == fs.FileType.Directory else system.delete_file(old.path)
                for f in row["files"]:
                    if system.get_file_info(f["file"]).type != fs.FileType.NotFound:  # else an attempt before this one moved it
                        system.move(f["file"], f"{target}/{f['part']}")
            yield batch.select(["name"])

    files = pa.schema([("name", pa.string()), ("file", pa.string()), ("part", pa.string())])
    line = F.to_csv(F.struct(*[F.col(c).alias(label) for c, label in labels.items()]), {"escape": '"', "emptyValue": "", "lineSep": "\n"})
    lines = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("export", line.alias("line"))
    system.create_dir(root, recursive=True)
    written = cut_lineage(lines.mapInArrow(write, "name string, file string, part string"))
    of_jobs = written.repartition(n, "name").groupBy("name").agg(F.collect_list(F.struct("file", "part")).alias("files"))
    of_jobs.mapInArrow(replace, "name string").write.format("noop").mode("overwrite").save()
    if system.get_file_info(staging).type != fs.FileType.NotFound:
        system.delete_dir(staging)
