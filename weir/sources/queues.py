"""Kinesis and SQS as Python data sources and sinks.

The service is reached through a client made on the machine that needs it: boto3
where it is installed, or whatever ``module:function`` the option ``client`` names
(the tests' fakes). Records come as ``partition, offset, key, value``.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

from ..errors import ConfigError, DataError
from ..functions.units import duration_ms

SCHEMA = "partition string, offset string, key string, value binary"
TRIES = 3


def make_client(service: str, options: dict):
    if options.get("client"):
        module, _, name = options["client"].partition(":")
        return getattr(importlib.import_module(module), name)(service, dict(options))
    try:
        import boto3
    except ImportError:
        raise ConfigError(f"reading or writing {service} needs boto3") from None
    return boto3.client(service, region_name=options.get("region"), endpoint_url=options.get("endpoint"))


class ShardRange(InputPartition):
    def __init__(self, shard: str, after: str | None, until: str | None, start: str):
        super().__init__((shard, after, until))
        self.shard, self.after, self.until, self.start = shard, after, until, start


class KinesisReader(DataSourceStreamReader):
    """All shards in parallel; an offset is the last sequence number taken of each shard.

    A shard that appears later (a child of a split or merge) is read from its
    beginning; one known from the start as ``start_from`` says. Shards are listed
    anew for every micro-batch; one that is closed and read through stays in the
    offset and gives nothing more.
    """

    def __init__(self, options: dict):
        self.options = dict(options)
        self.stream, self.start = options["stream"], options.get("start_from", "latest")
        if self.start not in ("latest", "trim_horizon"):
            raise ConfigError("start_from is latest or trim_horizon")
        self.limit = int(options.get("limit", 10_000))

    def _client(self):
        return make_client("kinesis", self.options)

    def _shards(self, client) -> list[str]:
        out, token = [], None
        while True:
            page = client.list_shards(**({"NextToken": token} if token else {"StreamName": self.stream}))
            out += [s["ShardId"] for s in page["Shards"]]
            token = page.get("NextToken")
            if not token:
                return sorted(out)

    def initialOffset(self) -> dict:
        client = self._client()
        ends = {s: self._newest(client, s) if self.start == "latest" else "" for s in self._shards(client)}
        return {"shards": ends}

    def _newest(self, client, shard: str) -> str:
        last = ""
        for r in _records(client, self.stream, shard, None, None):
            last = r["SequenceNumber"]
        return last

    def latestOffset(self) -> dict:
        client = self._client()
        return {"shards": {s: self._newest(client, s) for s in self._shards(client)}}

    def partitions(self, start: dict, end: dict) -> list[ShardRange]:
        return [ShardRange(s, start["shards"].get(s) or None, until, self.start) for s, until in end["shards"].items() if until and until != start["shards"].get(s)]

    def read(self, partition: ShardRange) -> Iterator[tuple]:
        for r in _records(self._client(), self.stream, partition.shard, partition.after, partition.until):
            yield partition.shard, r["SequenceNumber"], r.get("PartitionKey"), bytes(r["Data"])

    def commit(self, end: dict) -> None:
        pass


def _records(client, stream: str, shard: str, after: str | None, until: str | None) -> Iterator[dict]:
    """Records of a shard behind ``after`` (or from its beginning) up to ``until`` (or what is there now)."""
    kind = {"ShardIteratorType": "AFTER_SEQUENCE_NUMBER", "StartingSequenceNumber": after} if after else {"ShardIteratorType": "TRIM_HORIZON"}
    at = client.get_shard_iterator(StreamName=stream, ShardId=shard, **kind)["ShardIterator"]
    while at:
        page = client.get_records(ShardIterator=at, Limit=10_000)
        for r in page["Records"]:
            if until is not None and int(r["SequenceNumber"]) > int(until):
                return
            yield r
            if r["SequenceNumber"] == until:
                return
        if not page["Records"] and not page.get("MillisBehindLatest"):
            return
        at = page.get("NextShardIterator")


class SqsReader(SimpleDataSourceStreamReader):
    """Messages by long polls; they are deleted when their micro-batch is committed (at least once)."""

    def __init__(self, options: dict):
        self.options, self.queue = dict(options), options["queue"]
        self.wait = min(20, max(1, duration_ms(options.get("receive_wait", "1s")) // 1000))
        self.visibility = (duration_ms(options.get("commit_interval", "10s")) + 60_000) // 1000
        self.polls, self.taken = int(options.get("polls", 10)), {}

    def initialOffset(self) -> dict:
        return {"count": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        client, rows, receipts, at = make_client("sqs", self.options), [], [], start["count"]
        for _ in range(self.polls):
            page = client.receive_message(QueueUrl=self.queue, MaxNumberOfMessages=10, WaitTimeSeconds=self.wait, VisibilityTimeout=self.visibility)
            found = page.get("Messages", [])
            if not found:
                break
            for m in found:
                at += 1
                rows.append(("0", m["MessageId"], None, m["Body"].encode("utf-8")))
                receipts.append(m["ReceiptHandle"])
        self.taken[at] = (start["count"], rows, receipts)
        return iter(rows), {"count": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for k, (begin, rows, _) in sorted(self.taken.items()) if start["count"] <= begin and k <= end["count"] for r in rows])

    def commit(self, end: dict) -> None:
        client = make_client("sqs", self.options)
        for k in [k for k in self.taken if k <= end["count"]]:
            receipts = self.taken.pop(k)[2]
            for i in range(0, len(receipts), 10):
                client.delete_message_batch(QueueUrl=self.queue, Entries=[{"Id": str(n), "ReceiptHandle": r} for n, r in enumerate(receipts[i : i + 10])])


def send(rows: list[tuple[str, str]], size: int, put) -> None:
    """Send ``(key, value)`` rows in batches of ``size``; what a try leaves over goes again, three times at most.

    ``put`` sends a batch and gives back the places in it that failed.
    """
    for i in range(0, len(rows), size):
        left = rows[i : i + size]
        for n in range(TRIES):
            failed = put(left)
            left = [left[k] for k in failed]
            if not left:
                break
            if n + 1 < TRIES:
                time.sleep(0.05 * 2**n)
        if left:
            raise DataError(f"{len(left)} records were refused {TRIES} times")


class QueueWriter(DataSourceStreamWriter):
    """Rows ``key, value`` to a Kinesis stream (500 a call) or an SQS queue (10 a call), at least once."""

    def __init__(self, service: str, options: dict):
        self.service, self.options = service, dict(options)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        client, target = make_client(self.service, self.options), self.options["stream" if self.service == "kinesis" else "queue"]

        def to_kinesis(batch: list[tuple[str, str]]) -> list[int]:
            answer = client.put_records(StreamName=target, Records=[{"Data": v.encode(), "PartitionKey": k} for k, v in batch])
            return [i for i, r in enumerate(answer["Records"]) if r.get("ErrorCode")]

        def to_sqs(batch: list[tuple[str, str]]) -> list[int]:
            answer = client.send_message_batch(QueueUrl=target, Entries=[{"Id": str(i), "MessageBody": v} for i, (_, v) in enumerate(batch)])
            return [int(f["Id"]) for f in answer.get("Failed", [])]

        size, put, held = (500, to_kinesis, []) if self.service == "kinesis" else (10, to_sqs, [])
        for row in rows:
            held.append((row["key"], row["value"]))
            if len(held) == size:
                send(held, size, put)
                held = []
        send(held, size, put)
        return WriterCommitMessage()

    def commit(self, messages, batchId: int) -> None:
        pass

    def abort(self, messages, batchId: int) -> None:
        pass


class KinesisSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weir_kinesis"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> KinesisReader:
        return KinesisReader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> QueueWriter:
        return QueueWriter("kinesis", self.options)


class SqsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weir_sqs"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SqsReader:
        return SqsReader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> QueueWriter:
        return QueueWriter("sqs", self.options)


def register(spark) -> None:
    """Make ``weir_kinesis`` and ``weir_sqs`` known to a session."""
    spark.dataSource.register(KinesisSource)
    spark.dataSource.register(SqsSource)


__all__ = ["KinesisReader", "KinesisSource", "QueueWriter", "SqsReader", "SqsSource", "register", "send"]
