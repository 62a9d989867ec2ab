"""Sources: what comes over a socket, a queue, a process or a timer goes to a spool folder; streams read the folder.

A driver-side thread writes events as numbered JSON-lines files through Hadoop's file system, each file at once, so
that the folder may lie on any store the cluster shares. The file source then gives replay and exactly-once progress
with a checkpoint. A bounded read of the same folder gives a table.
"""

from __future__ import annotations

import glob
import http.server
import itertools
import json
import math
import os
import queue
import random
import socketserver
import subprocess
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import seconds
from ..operators.flow import Flow


class Spool:
    """Events of a producer as rows (seq, value)."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "seq long, value string", flush: float = 0.1, most: int = 10_000):
        self.spark, self.path, self.schema, self.flush, self.most = spark, path.rstrip("/"), schema, flush, most
        self.buffer: queue.Queue = queue.Queue(maxsize=10 * most)  # a full one holds the producer back
        self.seq = self.files = 0
        self.stopped = threading.Event()
        self.threads: list[threading.Thread] = []
        self.lock = threading.Lock()
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(self.path))

    def emit(self, value, **fields) -> None:
        self.buffer.put({"value": value, **fields})

    def write(self) -> int:
        """Move what has come to a new file; the number of events."""
        with self.lock:
            rows = []
            while len(rows) < self.most and not self.buffer.empty():
                rows.append(self.buffer.get_nowait() | {"seq": self.seq})
                self.seq += 1
            if rows:
                p = self.spark._jvm.org.apache.hadoop.fs.Path
                hidden, final = p(f"{self.path}/_{self.files:09d}"), p(f"{self.path}/{self.files:09d}.json")
                out = self._fs.create(hidden, True)
                out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows).encode()))
                out.close()
                self._fs.rename(hidden, final)
                self.files += 1
            return len(rows)

    def start(self, run: Callable[[], None] | None = None) -> Spool:
        def writer():
            while not self.stopped.wait(self.flush):
                self.write()

        for target in filter(None, (run, writer)):
            t = threading.Thread(target=target, daemon=True)
            t.start()
            self.threads.append(t)
        return self

    def stop(self) -> None:
        self.stopped.set()
        while self.write():
            pass

    def stream(self, files_per_trigger: int = 1) -> Flow:
        df = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_trigger).json(self.path)
        return Flow(df, "seq", name="spool")

    def table(self) -> Flow:
        return Flow(self.spark.read.schema(self.schema).json(self.path), "seq", name="spool")


def from_iterable(spark: SparkSession, items: Iterable, schema: str = "string") -> Flow:
    rows = list(enumerate(items))
    return Flow(spark.createDataFrame(rows, f"seq long, value {schema}"), "seq", name="from_iterable")


def from_periodic(spool: Spool, callback: Callable[[], object], poll_interval: float | str = 0.1) -> Spool:
    def run():
        while not spool.stopped.wait(seconds(poll_interval)):
            spool.emit(callback())

    return spool.start(run)


def from_q(spool: Spool, q: queue.Queue, sleep_time: float = 0.01) -> Spool:
    def run():
        while not spool.stopped.is_set():
            try:
                spool.emit(q.get(timeout=sleep_time))
            except queue.Empty:
                pass

    return spool.start(run)


def from_textfile(spool: Spool, path: str, poll_interval: float | str = 0.1, delimiter: str = "\n", from_end: bool = False) -> Spool:
    """Tail one growing file; elements keep the delimiter, an unfinished last piece waits."""

    def run():
        with open(path, encoding="utf-8", newline="") as f:
            if from_end:
                f.seek(0, os.SEEK_END)
            rest = ""
            while not spool.stopped.is_set():
                new = f.read()
                if not new:
                    spool.stopped.wait(seconds(poll_interval))
                    continue
                *done, rest = (rest + new).split(delimiter)
                for x in done:
                    spool.emit(x + delimiter)

    return spool.start(run)


def filenames(spool: Spool, path: str, poll_interval: float | str = 0.1) -> Spool:
    """Each new path of a folder or pattern once, sorted within a poll."""
    pattern = os.path.join(path, "*") if os.path.isdir(path) else path

    def run():
        seen: set[str] = set()
        while not spool.stopped.is_set():
            for x in sorted(set(glob.glob(pattern)) - seen):
                seen.add(x)
                spool.emit(x)
            spool.stopped.wait(seconds(poll_interval))

    return spool.start(run)


def from_tcp(spool: Spool, port: int, delimiter: bytes = b"\n", host: str = "127.0.0.1") -> Spool:
    """Listen for any number of clients; elements keep the delimiter. A full buffer holds the clients back."""

    class Handler(socketserver.BaseRequestHandler):
        def handle(self):
            rest = b""
            while not spool.stopped.is_set() and (new := self.request.recv(65536)):
                *done, rest = (rest + new).split(delimiter)
                for x in done:
                    spool.emit((x + delimiter).decode("utf-8", "replace"))

    socketserver.ThreadingTCPServer.allow_reuse_address = True
    spool.server = socketserver.ThreadingTCPServer((host, port), Handler)
    spool.server.daemon_threads = True
    return spool.start(spool.server.serve_forever)


def from_http_server(spool: Spool, port: int, path: str = "/.*", host: str = "127.0.0.1") -> Spool:
    """An event for each POST body to a path that matches; OK once it is taken."""
    import re

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            fits = re.fullmatch(path, self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            if fits:
                spool.emit(body.decode("utf-8", "replace"))
            self.send_response(200 if fits else 404)
            self.end_headers()
            self.wfile.write(b"OK" if fits else b"")

        def log_message(self, *args):
            pass

    spool.server = http.server.ThreadingHTTPServer((host, port), Handler)
    return spool.start(spool.server.serve_forever)


def from_process(spool: Spool, cmd: list[str] | str, with_stderr: bool = False, with_end: bool = True) -> Spool:
    """Lines of a process; an unfinished last one too if ``with_end``."""

    def run():
        p = subprocess.Popen(cmd, shell=isinstance(cmd, str), stdout=subprocess.PIPE, stderr=subprocess.STDOUT if with_stderr else subprocess.DEVNULL)
        for line in p.stdout:
            if spool.stopped.is_set():
                p.kill()
                break
            if line.endswith(b"\n") or with_end:
                spool.emit(line.decode("utf-8", "replace"))
        p.wait()

    return spool.start(run)


def from_websocket(spool: Spool, host: str, port: int) -> Spool:
    """An event for each frame; needs the websockets package."""
    from websockets.sync.server import serve

    def handle(socket):
        for x in socket:
            spool.emit(x if isinstance(x, str) else x.decode("utf-8", "replace"))

    spool.server = serve(handle, host, port)
    return spool.start(spool.server.serve_forever)


def from_mqtt(spool: Spool, host: str, port: int, topic: str, keepalive: int = 60, user: str | None = None, pw: str | None = None) -> Spool:
    """An event for each message of a topic; needs the paho-mqtt package."""
    import paho.mqtt.client as mqtt

    client = mqtt.Client()
    if user:
        client.username_pw_set(user, pw)
    client.on_connect = lambda c, *a: c.subscribe(topic)
    client.on_message = lambda c, u, m: spool.emit(m.payload.decode("utf-8", "replace"))
    client.connect(host, port, keepalive)
    return spool.start(client.loop_forever)


def periodic_frame(spool: Spool, datafn: Callable, interval: str = "500ms", **options) -> Spool:
    """Rows of datafn(last=, now=, **options), each a dict, at each interval."""

    def run():
        last = time.time()
        while not spool.stopped.wait(seconds(interval)):
            now = time.time()
            for row in datafn(last=last, now=now, **options):
                spool.emit(None, **row)
            last = now

    return spool.start(run)


def random_datablock(last: float, now: float, freq: str = "100ms", rng: random.Random | None = None) -> list[dict]:
    """x uniform, y Poisson of mean 1, z normal, one row each ``freq``."""
    rng, step = rng or random.Random(), seconds(freq)
    n = int((now - last) / step)
    return [random_datapoint(last + k * step, rng) for k in range(1, n + 1)]


#: Distribution function of the Poisson variable of mean 1.
POISSON = tuple(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(18)))


def random_datapoint(now: float, rng: random.Random | None = None) -> dict:
    rng = rng or random.Random()
    u = rng.random()
    return {"ts": now, "x": rng.random(), "y": sum(u > p for p in POISSON), "z": rng.gauss(0, 1)}


def random_stream(spark: SparkSession, rows_per_second: int = 10, seed: int = 0) -> DataFrame:
    """The same columns from the rate source, made on the executors."""
    u = F.rand(seed + 1)
    y = F.aggregate(F.array(*map(F.lit, POISSON)), F.struct(u.alias("u"), F.lit(0).alias("n")), lambda a, p: F.struct(a["u"].alias("u"), (a["n"] + (a["u"] > p).cast("int")).alias("n")), lambda a: a["n"])
    df = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return df.select(F.col("value").alias("seq"), F.col("timestamp").alias("ts"), F.rand(seed).alias("x"), y.alias("y"), F.randn(seed + 2).alias("z"))


def kafka_options(topics: str | list[str], consumer: dict[str, str], max_batch_size: int | None = 10_000, start: str | None = None, npartitions: int | None = None) -> dict[str, str]:
    """Options of the Kafka source for a consumer's settings."""
    if npartitions is not None and npartitions <= 0:
        raise ValueError("npartitions must be above 0")
    out = {"subscribe": topics if isinstance(topics, str) else ",".join(topics)}
    out |= {f"kafka.{k}": str(v) for k, v in consumer.items() if k not in ("auto.offset.reset", "group.id")}
    if "group.id" in consumer:
        out["kafka.group.id"] = consumer["group.id"]
    out["startingOffsets"] = start or consumer.get("auto.offset.reset", "latest")
    if max_batch_size:
        out["maxOffsetsPerTrigger"] = str(max_batch_size * (npartitions or 1))
    if npartitions:
        out["minPartitions"] = str(npartitions)
    return out


def from_kafka(spark: SparkSession, topics, consumer: dict[str, str], keys: bool = False, **options) -> Flow:
    """A stream of message values (and keys); null and empty values are left out. Needs Spark's Kafka connector."""
    df = spark.readStream.format("kafka").options(**kafka_options(topics, consumer, **options)).load().where("length(value) > 0")
    # A number, as ordered operators take it: offsets first, partitions within.
    return Flow(df.select((F.col("offset") * 65_536 + F.col("partition")).alias("seq"), *(["key"] if keys else []), "value"), "seq", name="from_kafka")
