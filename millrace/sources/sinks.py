"""Sinks besides those that flows have themselves. Each runs as a micro-batch writer and is idempotent by batch id
where the target is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.flow import Flow


def kafka_sink_options(topic: str, producer: dict[str, str]) -> dict[str, str]:
    return {"topic": topic} | {f"kafka.{k}": str(v) for k, v in producer.items()}


def to_kafka(flow: Flow, topic: str, producer: dict[str, str], checkpoint: str, column: str = "value"):
    """Send values; the flow itself can be used on. Needs Spark's Kafka connector."""
    out = flow.df.select(F.col(column).cast("binary").alias("value"))
    options = kafka_sink_options(topic, producer)
    if flow.df.isStreaming:
        return out.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    return out.write.format("kafka").options(**options).save()


def _each_partition(send_all: Callable, column: str):
    def write(df: DataFrame, _: int) -> None:
        df.select(column).foreachPartition(lambda rows: send_all(r[0] for r in rows))

    return write


def to_websocket(flow: Flow, uri: str, column: str = "value"):
    """A frame for each element; needs the websockets package on the executors."""

    def send(values):
        from websockets.sync.client import connect

        with connect(uri) as socket:
            for v in values:
                socket.send(v)

    return flow.sink(_each_partition(send, column))


def to_mqtt(flow: Flow, host: str, port: int, topic: str, keepalive: int = 60, column: str = "value"):
    """Publish each element; needs the paho-mqtt package on the executors."""

    def send(values):
        import paho.mqtt.client as mqtt

        client = mqtt.Client()
        client.connect(host, port, keepalive)
        for v in values:
            client.publish(topic, v)

    return flow.sink(_each_partition(send, column))
