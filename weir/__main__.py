"""``python -m weir --config pipeline.yaml --sql pipeline.sql [--schemas-dir DIR] [--check | --compact]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import load_config
from .errors import WeirError
from .plans.pipeline import Pipeline
from .sources.tables import KeyedTable
from .streaming.metrics import Listener, Metrics, serve
from .streaming.runner import Runner


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weir", description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--sql")
    p.add_argument("--schemas-dir")
    p.add_argument("--checkpoint", help="folder of progress and state, shared by all machines")
    p.add_argument("--clock", choices=("strict", "native"), default="strict")
    p.add_argument("--once", action="store_true", help="end when what is there has been read")
    p.add_argument("--check", action="store_true", help="only read and bind the two files")
    p.add_argument("--compact", action="store_true", help="merge the output table's files and end")
    p.add_argument("--compact-min-files", type=int, default=8)
    a = p.parse_args(argv)
    try:
        return _run(a)
    except (WeirError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace) -> int:
    if a.compact:
        config = load_config(a.config)
        if config.output.table is None:
            raise WeirError("compaction is for a table output")
        if a.compact_min_files < 2:
            raise WeirError("--compact-min-files is 2 or more")
        spark = SparkSession.builder.appName("weir-compact").getOrCreate()
        database, _, table = config.output.table.rpartition(".")
        done = KeyedTable(spark, f"{config.connectors.paimon.warehouse.rstrip('/')}/{database or 'default'}.db/{table}").compact(a.compact_min_files)
        print(f"snapshot {done.id}" if done else f"no bucket has {a.compact_min_files} files")
        return 0
    if not a.sql:
        raise WeirError("--sql is missing")
    pipeline = Pipeline.from_files(a.config, a.sql, a.schemas_dir)
    if a.check:
        print(f"{pipeline.statement.kind}: {', '.join(pipeline.statement.source_tables)} -> {pipeline.statement.target}")
        return 0
    if not a.checkpoint:
        raise WeirError("--checkpoint is missing")
    spark = SparkSession.builder.appName(pipeline.config.pipeline.name).getOrCreate()
    metrics = Metrics(pipeline.config.pipeline.name)
    spark.streams.addListener(Listener(metrics))
    if pipeline.config.deployment.metrics:
        serve(metrics, pipeline.config.deployment.metrics.bind_addr)
    runner = Runner(spark, pipeline, a.checkpoint, clock=a.clock, metrics=metrics)
    if all(i.kind == "table" for i in pipeline.config.inputs):
        runner.run_snapshots()
    else:
        runner.start(available_now=a.once).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
