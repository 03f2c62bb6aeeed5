"""A streaming source that fetches line-oriented URLs once per micro-batch."""

from __future__ import annotations

import codecs
import itertools
import logging
import time
import urllib.request
from collections.abc import Iterable, Iterator
from http.client import HTTPException

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source_file string, _block long, raw_text string, line_no long"
_CHUNK = 1 << 16
_BATCH_LINES = 1 << 13


def decoded_lines(chunks: Iterable[bytes]) -> Iterator[str]:
    """Stripped, non-empty lines of a byte stream, whatever the chunk borders."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    rest = ""
    for chunk in chunks:
        pieces = (rest + decoder.decode(chunk)).splitlines(keepends=True)
        # The last piece may go on in the next chunk, also after a carriage return.
        rest = pieces.pop() if pieces else ""
        yield from filter(None, (piece.strip() for piece in pieces))
    yield from filter(None, (piece.strip() for piece in (rest + decoder.decode(b"", True)).splitlines()))


class UrlPoll(InputPartition):
    def __init__(self, url: str, poll: int):
        super().__init__(url)
        self.url = url
        self.poll = poll


class PollReader(DataSourceStreamReader):
    """One task per URL and poll. Every poll reads the whole body again.

    Offsets are poll times: the body has no positions of its own, and a
    restarted query only has to find a later offset than the one it stored.
    """

    def __init__(self, urls: list[str], timeout: float, opener):
        self.urls = urls
        self.timeout = timeout
        self.opener = opener

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        return {"poll": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["poll"] >= end["poll"]:
            return []
        return [UrlPoll(url, end["poll"]) for url in self.urls]

    def lines(self, partition: UrlPoll) -> Iterator[str]:
        """A failed request ends the poll; lines read before it are kept."""
        try:
            with self.opener(partition.url, self.timeout) as body:
                yield from decoded_lines(iter(lambda: body.read(_CHUNK), b""))
        except (OSError, HTTPException) as failure:
            logging.getLogger(__name__).warning(
                "read of %s failed, next poll tries again: %s", partition.url, failure
            )

    def read(self, partition: UrlPoll) -> Iterator[tuple]:
        for number, line in enumerate(self.lines(partition)):
            yield partition.url, partition.poll, line, number


class ArrowPollReader(PollReader):
    """The same rows as Arrow batches, without a tuple per line."""

    def read(self, partition: UrlPoll) -> Iterator[pa.RecordBatch]:
        found, first = self.lines(partition), 0
        while lines := list(itertools.islice(found, _BATCH_LINES)):
            n = len(lines)
            yield pa.record_batch(
                [pa.repeat(partition.url, n), pa.repeat(pa.scalar(partition.poll, pa.int64()), n), pa.array(lines, pa.string()), pa.array(range(first, first + n), pa.int64())],
                ["source_file", "_block", "raw_text", "line_no"],
            )
            first += n


def open_url(url: str, timeout: float):
    """``urllib`` raises an ``OSError`` for every status other than success."""
    return urllib.request.urlopen(url, timeout=timeout)


class PolledLines(DataSource):
    """``spark.readStream.format("polled_lines").option("urls", "http://a http://b")``."""

    opener = staticmethod(open_url)

    @classmethod
    def name(cls) -> str:
        return "polled_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        urls = sorted(self.options["urls"].split())
        return ArrowPollReader(urls, float(self.options.get("timeout", "30")), self.opener)


def lines_once(lines: DataFrame, keep_for: str = "1 hour", same_place: bool = True) -> DataFrame:
    """A polled stream without the lines that an earlier poll has given already.

    A poll reads the whole body again. What was seen is kept in the stream's state and
    expires ``keep_for`` after the last poll that gave it anew, so state does not grow with the age of the stream. With ``same_place`` a
    line is known by its source, text and number in the body, which suits bodies that only grow: equal lines
    of one body all stay. Without it source and text suffice, for bodies that drop their oldest lines; a line
    that really comes again within ``keep_for`` is then left out as well. The state holds a digest of 32 bytes
    in place of a line.
    """
    timed = lines.withColumn("_polled", F.timestamp_millis("_block")).withWatermark("_polled", keep_for)
    key = ["source_file", *(["line_no"] if same_place else []), "raw_text"]
    # Neither a URL nor a line holds a line feed, and lines may come from people who would like to hide others.
    name = F.unhex(F.sha2(F.concat_ws("\n", *key), 256))
    once = timed.withColumn("_name", name).dropDuplicatesWithinWatermark(["_name"])
    # The removal moves lines; ``_line_no`` tells the epoch to put them in order again.
    return once.withColumnRenamed("line_no", "_line_no").drop("_polled", "_name")


def poll_urls(spark: SparkSession, *urls: str, timeout: float = 30.0, source=PolledLines) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.readStream.format(source.name()).option("urls", " ".join(urls))
    return reader.option("timeout", str(timeout)).load()
