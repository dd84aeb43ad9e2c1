"""File listings and whole-file text: A7."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 16 << 20
# File systems that Arrow opens by itself; the name it knows them by.
ARROW_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` (base name), ``path``, ``size`` of all files below a folder.

    Only names and sizes are read; the content column is pruned from the scan.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(
        F.substring_index("path", "/", -1).alias("file"), "path", F.col("length").alias("size")
    )


def read_text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, path, content, reason`` of whole text files; a file that is not UTF-8 has no row.

    Each file is one value, so a file must fit a task; many files spread over tasks.  A file above
    the reader's limit (``spark.sql.sources.binaryFile.maxLength``) is never opened, so it may be text
    or not: it has a row of null content and a reason.
    """
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name, small = F.substring_index("path", "/", -1).alias("file"), F.col("length") <= limit
    text, none = F.decode(F.col("content"), "UTF-8"), F.lit(None).cast("string")
    read = found.where(small).where(F.is_valid_utf8(F.col("content").cast("string"))).select(name, "path", text.alias("content"), none.alias("reason"))
    why = F.concat(F.col("length").cast("string"), F.lit(f" bytes, more than the limit of {limit}"))
    return read.unionByName(found.where(~small).select(name, "path", none.alias("content"), why.alias("reason")))


def text_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``file, path, chunk, content``: the text of the files that are rows of ``files``, and of no other file.

    ``files`` has ``file``, ``path`` and ``size``, as :func:`list_files` gives them, cut down to what is wanted
    before anything is opened.  Files spread over tasks; each is read as a stream, a chunk at a time,
    so a text of any length is as many rows.  Characters stay whole.  An empty file is one empty
    chunk; a file that is not UTF-8 has no row (one of several chunks is read twice, as that may show late).
    """
    schemes = dict(ARROW_SCHEMES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Everything is within this function, so that executors need not have the library.
        import codecs

        from pyarrow import fs

        systems: dict[str, tuple] = {}

        def opened(path: str):
            scheme, colon, rest = path.partition(":")
            host, slash, below = rest.lstrip("/").partition("/") if rest.startswith("//") and not rest.startswith("///") else ("", "/", rest.lstrip("/"))
            root = f"{schemes[scheme]}://{host}/"
            if root not in systems:
                systems[root] = (fs.LocalFileSystem(), "") if scheme == "file" else fs.FileSystem.from_uri(root)
            system, base = systems[root]
            return system.open_input_stream(f"{base.rstrip('/')}/{below}", compression=None)

        def chunks(path: str) -> Iterator[str]:
            decoder = codecs.getincrementaldecoder("utf-8")()
            with opened(path) as stream:
                block = stream.read(chunk_bytes)
                while True:
                    following = stream.read(chunk_bytes) if len(block) == chunk_bytes else b""
                    yield decoder.decode(block, not following)
                    if not following:
                        return
                    block = following

        def is_text(path: str) -> bool:
            try:
                return all(True for _ in chunks(path))
            except UnicodeDecodeError:
                return False

        for batch in batches:
            for file, path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > chunk_bytes and not is_text(path):
                    continue
                try:
                    for i, content in enumerate(chunks(path)):
                        yield pa.RecordBatch.from_pydict({"file": [file], "path": [path], "chunk": pa.array([i], pa.int32()), "content": [content]})
                except UnicodeDecodeError:
                    if size > chunk_bytes:
                        raise

    wanted = files.select("file", "path", "size").repartition(F.col("path"))
    return wanted.mapInArrow(read, "file string, path string, chunk int, content string")


def read_chosen_texts(files: DataFrame) -> DataFrame:
    """``file, path, content, reason`` like :func:`read_text_files`, of the files that are rows of ``files`` only.

    A file above the limit of one value is a row of null content and a reason; :func:`text_chunks` reads it.
    """
    limit = int(files.sparkSession.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    files, none = files.select("file", "path", "size"), F.lit(None).cast("string")
    # Within the limit a file is one chunk: its text goes into one value anyway.
    read = text_chunks(files.where(F.col("size") <= limit), limit).select("file", "path", "content", none.alias("reason"))
    why = F.concat(F.col("size").cast("string"), F.lit(f" bytes, more than the limit of {limit}"))
    return read.unionByName(files.where(F.col("size") > limit).select("file", "path", none.alias("content"), why.alias("reason")))


def arrow_opens(path: str) -> bool:
    """Whether :func:`text_chunks` can open files at a path."""
    scheme, colon, _ = path.partition("://")
    return not colon or scheme in ARROW_SCHEMES
