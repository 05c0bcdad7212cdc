"""Logs that are still written, as a streaming source: each snapshot block once, as soon as it is over.

The offset of a stream is the size of each log; a batch is what was added since. A
block is over where the next heading, or the footer of a run, ends; the batch that
has this place emits it, so an unfinished last block waits. Tasks look back
from where they start to the block's own heading. The driver lists sizes and reads nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from . import logheader, logtext
from .binary import Ranges, dealt

#: Bytes added to a log that one task reads (it reads what is added to several logs, if these are many), and of one step back.
RANGE, STEP = 64 << 20, 1 << 20
#: Bytes of a batch of texts.
BATCH = 4 << 20
#: A line that ends with the heading's fixed words or is a footer; both count from where the match ends.
_HEADING = re.compile(rb"^[^\S\n]*Cycle[^\S\n]+Time[^\S\n]+\(s\)", re.MULTILINE)
_FOOTER = re.compile(rb"#\s*Simulation (?:completed|aborted|terminated|stopped|ended)[^\n]*\n", re.IGNORECASE)
_HEADER_END = re.compile(re.escape(logtext.HEADER_END.encode()) + rb"[^\n]*\n")
SCHEMA = "file string, start long, text string"


def header_end(file, size: int) -> int | None:
    """Where the header of a log ends, if the log has come that far."""
    held = b""
    while len(held) < size:
        held += file.read_at(min(STEP, size - len(held)), len(held))
        if found := _HEADER_END.search(held):
            return found.end()
    return None


def finished(file, a: int, b: int) -> Iterator[tuple[int, bytes]]:
    """Start and text of the header (start 0) and the blocks that are over at a place after ``a`` and up to ``b``."""
    head = header_end(file, b)
    if head is None:
        return
    if a < head:
        yield 0, file.read_at(head, 0)
    at = max(head, a)  # look back for the heading of the block in which the batch begins
    text, low = b"", at
    while low > head and not any(low + m.end() <= at for m in _HEADING.finditer(text)):
        step = min(STEP, low - head)
        low -= step
        text = file.read_at(step, low) + text
    text += file.read_at(b - at, at)
    marks = list(_HEADING.finditer(text))
    for this, after in zip(marks, marks[1:]):
        if a < low + after.end() <= b:
            yield low + this.start(), text[this.start() : after.start()]
    if marks and (end := _FOOTER.search(text, marks[-1].end())) and a < low + end.end() <= b:
        yield low + marks[-1].start(), text[marks[-1].start() : end.end()]


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", ".log")
        self.range = int(options.get("range", RANGE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = fs.FileSystem.from_uri(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {x.path: x.size for x in found if x.is_file and x.path.endswith(self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return dealt((path, a, min(a + self.range, size)) for path, size in sorted(end.items()) for a in range(start.get(path, 0), size, self.range))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.root)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["file", "start", "text"])
        held, size = [], 0
        for path, a, b in partition.pieces:
            with store.open_input_file(path) as file:
                for start, text in finished(file, a, b):
                    held.append((path, start, text.decode("utf-8", "replace")))
                    size += len(text)
                    if size >= BATCH:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)


class GrowingLogs(DataSource):
    """``spark.readStream.format("growing_logs")``: options path (a folder's URI), suffix, range."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Reader(self.options)


def arriving(spark: SparkSession, folder: str, suffix: str = ".log") -> DataFrame:
    """A stream of file, start, text: headers (start 0) and finished blocks of the logs under a folder."""
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("growing_logs").option("path", folder).option("suffix", suffix).load()


def arriving_blocks(spark: SparkSession, folder: str, suffix: str = ".log") -> DataFrame:
    """A stream of finished blocks taken apart as in ``logtext.blocks``, by file and the byte at which each starts."""
    texts = arriving(spark, folder, suffix).filter("start > 0").select("file", F.col("start").alias("number"), "text")
    return logtext.taken_apart(texts).withColumnRenamed("number", "start")


def arriving_facts(spark: SparkSession, folder: str, suffix: str = ".log") -> DataFrame:
    """A stream of the facts of headers, as soon as they are whole."""
    return logheader.facts(arriving(spark, folder, suffix).filter("start = 0"))
