"""Unbounded sources: ticks, files, sockets, and HTTP sources by Spark's Python data source interface.

`register(spark)` makes the formats `tidemark-events` (server-sent events), `tidemark-poll` (one response,
or one for each interval) and `tidemark-websocket` known to readStream. They read on the driver, one
batch at a time, and keep what was read until it is committed, so a batch can be read again.
"""

from __future__ import annotations

import base64
import hashlib
import os
import socket
import struct
import threading
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def interval(spark: SparkSession, ms: int, partitions: int = 1) -> DataFrame:
    """0, 1, 2, ... one each ms, as (timestamp, value). Stop the query to stop the ticks."""
    if ms <= 0:
        raise ValueError("an interval needs a length")
    if 1000 % ms == 0:
        return spark.readStream.format("rate").option("rowsPerSecond", 1000 // ms).option("numPartitions", partitions).load()
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", partitions).load()
    # Lengths that do not divide a second: a row for each multiple of ms within its second.
    first, last = F.ceil(F.col("value") * 1000 / ms), F.ceil((F.col("value") + 1) * 1000 / ms) - 1
    return ticks.filter(first <= last).select((F.col("timestamp")).alias("timestamp"), F.explode(F.sequence(first, last)).alias("value"))


def files(spark: SparkSession, path: str, schema: str, form: str = "parquet", most_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(path)


def lines_from_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


class _Buffered(SimpleDataSourceStreamReader):
    """Messages from a thread of the driver's; offsets count them. An end or an error closes the source for good."""

    def __init__(self, options: dict):
        self.options, self.lock = options, threading.Lock()
        self.base, self.items, self.error, self.ended, self.started = 0, [], None, False, False

    def __getstate__(self) -> dict:
        return {"options": self.options}  # copies in tasks are given their rows; they do not listen

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["options"])

    def messages(self) -> Iterator[tuple]:
        raise NotImplementedError

    def _pump(self) -> None:
        try:
            for item in self.messages():
                with self.lock:
                    self.items.append(item)
        except Exception as err:
            self.error = str(err)
        finally:
            self.ended = True

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not self.started:
            self.started = True
            threading.Thread(target=self._pump, daemon=True).start()
            deadline = time.time() + float(self.options.get("firstwaitseconds", 1))
            while not self.items and not self.ended and time.time() < deadline:
                time.sleep(0.02)
        with self.lock:
            got = self.items[start["n"] - self.base :]
        return iter(got), {"n": start["n"] + len(got)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        with self.lock:
            return iter(self.items[start["n"] - self.base : end["n"] - self.base])

    def commit(self, end: dict) -> None:
        with self.lock:
            del self.items[: end["n"] - self.base]
            self.base = end["n"]


class _Events(_Buffered):
    def messages(self):
        wanted, n = self.options.get("event", "message"), 0
        request = urllib.request.Request(self.options["url"], headers={"Accept": "text/event-stream"})
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeoutseconds", 60))) as answer:
            kind, data, ident = "message", [], None
            for raw in answer:
                line = raw.decode("utf-8").rstrip("\r\n")
                if not line:
                    if data and kind == wanted:
                        yield n, ident, "\n".join(data)
                        n += 1
                    kind, data = "message", []
                elif not line.startswith(":"):
                    name, _, text = line.partition(":")
                    text = text.removeprefix(" ")
                    if name == "event":
                        kind = text
                    elif name == "data":
                        data.append(text)
                    elif name == "id":
                        ident = text


class _Poll(_Buffered):
    def messages(self):
        wait, n = float(self.options.get("intervalms", 0)) / 1000, 0
        while True:
            with urllib.request.urlopen(self.options["url"], timeout=float(self.options.get("timeoutseconds", 60))) as answer:
                yield n, str(answer.status), answer.read().decode("utf-8", "replace")
            n += 1
            if not wait:
                return
            time.sleep(wait)


class _WebSocket(_Buffered):
    """A plain client (ws://): text and binary messages; binary ones come as base64."""

    def messages(self):
        url = urllib.parse.urlsplit(self.options["url"])
        sock = socket.create_connection((url.hostname, url.port or 80), timeout=float(self.options.get("timeoutseconds", 60)))
        try:
            key = base64.b64encode(os.urandom(16)).decode()
            path = (url.path or "/") + (f"?{url.query}" if url.query else "")
            sock.sendall(f"GET {path} HTTP/1.1\r\nHost: {url.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
            stream = sock.makefile("rb")
            head = [stream.readline()]
            while (line := stream.readline()) not in (b"\r\n", b""):
                head.append(line)
            expected = base64.b64encode(hashlib.sha1((key + "258EAFA5-E914-47DA-95CA-C5AB0DC85B11").encode()).digest())
            if b" 101 " not in head[0] or not any(expected in x for x in head):
                raise OSError("the server refused the upgrade")
            n, parts, first = 0, [], 1
            while True:
                a, b = stream.read(2)
                size = b & 127
                size = struct.unpack(">H", stream.read(2))[0] if size == 126 else struct.unpack(">Q", stream.read(8))[0] if size == 127 else size
                body, code = stream.read(size), a & 15
                if code == 8:
                    return
                if code == 9:  # ping: answer with the same body, masked with zeros
                    sock.sendall(bytes([0x8A, 0x80 | len(body)]) + bytes(4) + body)
                elif code in (0, 1, 2):
                    first = code or first
                    parts.append(body)
                    if a & 128:
                        whole = b"".join(parts)
                        parts = []
                        yield n, "text" if first == 1 else "binary", whole.decode("utf-8", "replace") if first == 1 else base64.b64encode(whole).decode()
                        n += 1
        finally:
            sock.close()


def _source(form: str, reader: type, note: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return form

        def schema(self):
            return f"ord long, {note} string, data string"

        def simpleStreamReader(self, schema):  # noqa: N802
            if "url" not in self.options:
                raise ValueError(f"{form} needs the option url")
            return reader({k.lower(): v for k, v in self.options.items()})

    Source.__name__ = reader.__name__.strip("_")
    return Source


SOURCES = {
    "tidemark-events": _source("tidemark-events", _Events, "id"),
    "tidemark-poll": _source("tidemark-poll", _Poll, "status"),
    "tidemark-websocket": _source("tidemark-websocket", _WebSocket, "kind"),
}


def register(spark: SparkSession) -> None:
    for source in SOURCES.values():
        spark.dataSource.register(source)


def server_sent_events(spark: SparkSession, url: str, event: str = "message") -> DataFrame:
    register(spark)
    return spark.readStream.format("tidemark-events").option("url", url).option("event", event).load()


def polled(spark: SparkSession, url: str, interval_ms: int = 0) -> DataFrame:
    register(spark)
    return spark.readStream.format("tidemark-poll").option("url", url).option("intervalMs", interval_ms).load()


def websocket(spark: SparkSession, url: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("tidemark-websocket").option("url", url).load()
