"""Stand-ins for the AWS clients; their state is a folder, since workers are processes of their own."""

from __future__ import annotations

import json
import os


def _load(path):
    return json.loads(open(path).read()) if os.path.exists(path) else None


class Kinesis:
    def __init__(self, root):
        self.root = root

    def list_shards(self, StreamName=None, NextToken=None):
        return {"Shards": [{"ShardId": n.removesuffix(".json")} for n in sorted(os.listdir(self.root)) if n.startswith("shard")]}

    def get_shard_iterator(self, StreamName, ShardId, ShardIteratorType, StartingSequenceNumber=None):
        at = int(StartingSequenceNumber) + 1 if StartingSequenceNumber else 0
        return {"ShardIterator": f"{ShardId}:{at}"}

    def get_records(self, ShardIterator, Limit):
        shard, _, at = ShardIterator.partition(":")
        rows = _load(f"{self.root}/{shard}.json")
        part = [(i, r) for i, r in enumerate(rows) if i >= int(at)][:2]
        records = [{"SequenceNumber": str(i), "PartitionKey": "k", "Data": r.encode()} for i, r in part]
        return {"Records": records, "NextShardIterator": f"{shard}:{int(at) + len(part)}", "MillisBehindLatest": 0}

    def put_records(self, StreamName, Records):
        count = len(_load(f"{self.root}/tries.json") or [])
        answer, kept = [], _load(f"{self.root}/sent.json") or []
        for i, r in enumerate(Records):
            bad = count == 0 and i == 0
            answer.append({"ErrorCode": "busy"} if bad else {})
            if not bad:
                kept.append([r["PartitionKey"], r["Data"].decode()])
        open(f"{self.root}/sent.json", "w").write(json.dumps(kept))
        open(f"{self.root}/tries.json", "w").write(json.dumps([0] * (count + 1)))
        return {"Records": answer}


class Sqs:
    def __init__(self, root):
        self.root = root

    def receive_message(self, QueueUrl, MaxNumberOfMessages, WaitTimeSeconds, VisibilityTimeout):
        rows, seen = _load(f"{self.root}/queue.json"), _load(f"{self.root}/seen.json") or []
        part = [(i, r) for i, r in enumerate(rows) if i not in seen][:MaxNumberOfMessages]
        open(f"{self.root}/seen.json", "w").write(json.dumps(seen + [i for i, _ in part]))
        return {"Messages": [{"MessageId": str(i), "ReceiptHandle": str(i), "Body": r} for i, r in part]}

    def delete_message_batch(self, QueueUrl, Entries):
        gone = _load(f"{self.root}/deleted.json") or []
        open(f"{self.root}/deleted.json", "w").write(json.dumps(gone + [e["ReceiptHandle"] for e in Entries]))

    def send_message_batch(self, QueueUrl, Entries):
        kept = _load(f"{self.root}/sent.json") or []
        open(f"{self.root}/sent.json", "w").write(json.dumps(kept + [e["MessageBody"] for e in Entries]))
        return {"Failed": []}


def client(service, options):
    return (Kinesis if service == "kinesis" else Sqs)(options["endpoint"])
