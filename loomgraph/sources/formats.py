"""Files of any supported format as chunks: each file is routed by its extension to the chunker of its format, and what cannot be
read goes to a table of rejects with the reason."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources import documents as D

# Extensions of each format.
FORMATS = {"md": "markdown", "txt": "text", "text": "text", "html": "html", "htm": "html", "eml": "mail"}
#: Largest file that is read whole, in bytes.
LARGEST = 256 << 20
#: Most files of a folder that write_folders makes, and bytes after which it begins another; batches of files that are read are as large.
FILES, BATCH = 500, 4 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route(path: Column, length: Column, largest: int = LARGEST) -> Column:
    """struct<format, reason>: the format of a file's extension, or why the file is not read."""
    names = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    found = F.try_element_at(names, extension(path))
    reason = F.when(found.isNull(), F.concat(F.lit("unsupported type: "), F.coalesce(F.nullif(extension(path), F.lit("")), F.lit("none")))).when(length > largest, F.lit("too large"))
    return F.struct(F.when(reason.isNull(), found).alias("format"), reason.alias("reason"))


def _listed_once(paths: str | list[str]) -> bool:
    """Paths without patterns, none of which lies under another: no file is found twice."""
    every = sorted(p.rstrip("/") + "/" for p in ([paths] if isinstance(paths, str) else paths))
    return not any(re.search(r"[*?\[\]{}\\]", p) for p in every) and not any(b.startswith(a) for a, b in itertools.pairwise(every))


def files(spark: SparkSession, paths: str | list[str], largest: int = LARGEST, tasks: int | None = None) -> DataFrame:
    """path, format, reason, content of every file under paths; contents are read of files with a format alone. A file under several of
    the paths counts once; contents are shuffled for that only where paths can overlap.

    tasks: the most that read. Spark makes one for every 32 small files or so; they are put together, the largest files first."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    found = found.coalesce(tasks) if tasks else found
    found = found if _listed_once(paths) else found.dropDuplicates(["path"])
    routed = found.withColumn("r", route(F.col("path"), F.col("length"), largest))
    return routed.select("path", "r.format", "r.reason", F.when(F.col("r.format").isNotNull(), F.col("content")).alias("content"))


def folders(folder: str) -> list[str]:
    """The folders right in a folder that write_files wrote: of more than 32 of them Spark lists the files in a job."""
    store, root = fs.FileSystem.from_uri(folder)
    return sorted(f"{folder}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory)


def folder_files(folders: DataFrame, largest: int = LARGEST, tasks: int | None = None) -> DataFrame:
    """As `files`, of a table of distinct folders (folder): a task lists its folders and reads their files, so the driver holds no list of
    them. Folders in these folders are passed over; a file of no bytes has a row. The folders are in a store that pyarrow opens, and hold
    about equally much, as those of write_folders do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, root = fs.FileSystem.from_uri(folder)
                for f in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda f: f.base_name):
                    if f.type != fs.FileType.File:
                        continue
                    content = None
                    if f.extension.lower() in FORMATS and f.size <= largest:
                        with store.open_input_stream(f.path) as stream:
                            content = stream.read()
                    rows.append((f"{folder}/{f.base_name}", f.size, content))
                    held += len(content or b"")
                    if held >= BATCH or len(rows) >= FILES:
                        yield _found(rows)
                        rows, held = [], 0
        if rows:
            yield _found(rows)

    listed = folders.select("folder")
    found = (listed.repartition(tasks) if tasks else listed).mapInArrow(run, "path string, length long, content binary")
    return found.withColumn("r", route(F.col("path"), F.col("length"), largest)).select("path", "r.format", "r.reason", F.when(F.col("r.format").isNotNull(), F.col("content")).alias("content"))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], ["path", "length", "content"])


def chunked(found: DataFrame) -> DataFrame:
    """A row for each file (path, format, reason, parts, text): the chunks of a file that was read, in order, and its text, or the reason
    why it was not. A file that is no UTF-8 is a reject; one of white space is a chunk without text, as the chunkers have it; one of no
    bytes is passed over by Spark's scan (`files`)."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = found.select("path", "format", "reason", F.when(F.col("format").isNotNull(), text).alias("text"))
    broken = F.when(F.col("format").isNotNull() & F.col("text").isNull(), F.lit("not UTF-8")).otherwise(F.col("reason"))
    is_ = lambda name: F.col("format") == name
    seen = read.withColumns({"reason": broken, "shown": D.visible(F.when(is_("html"), F.col("text"))), "mail": D.mail_parts(F.when(is_("mail"), F.col("text")))})
    packed = D.paragraph_chunks(F.when(is_("html"), F.col("shown")).otherwise(F.col("text")))
    parts = F.when(is_("markdown"), D.markdown_chunks(F.col("text"))).when(is_("mail"), D.packed_mail(F.col("mail.head"), F.col("mail.text"))).otherwise(packed)
    return seen.select("path", F.when(F.col("reason").isNull(), F.col("format")).alias("format"), "reason", F.when(F.col("reason").isNull(), parts).alias("parts"), "text")


def chunks(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, format, page_no, text) and the rejects (path, reason) of files, as `chunked` has them. doc_id is the path."""
    read = chunked(found)
    out = read.select(F.col("path").alias("doc_id"), "format", F.posexplode("parts").alias("at", "text"))
    return out.select("doc_id", "format", (F.col("at") + 1).alias("page_no"), "text"), read.where("reason is not null").select("path", "reason")


def write_folders(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, text) as one file each when its result (folder, n: number of files) is asked for: folders of at most FILES files.
    Rows of the same name go to different folders, and each attempt at a task has its own, so a name is never written over; only folders
    in the result count, and it is to be kept, not asked for twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task, made, names, size = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", [], set(), 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not names or len(names) >= FILES or size >= BATCH or name in names:
                    at, names, size = f"{task}/{len(made):06d}", set(), 0
                    store.create_dir(f"{root}/{at}", recursive=True)
                    made.append([f"{folder}/{at}", 0])
                content = text.as_py() or b""
                with store.open_output_stream(f"{root}/{at}/{name}") as out:
                    out.write(content)
                names.add(name)
                size += len(content)
                made[-1][1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["folder", "n"])

    return rows.select("name", F.col("text").cast("binary")).mapInArrow(run, "folder string, n long")


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes rows (name, text) as one file each, in folders of the task that wrote it; how many."""
    return write_folders(rows, folder).agg(F.sum("n")).first()[0] or 0
