"""Which plans may run on a stream, judged by the nodes that Catalyst made of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..errors import SqlError

PASS = frozenset(
    "Project Filter SubqueryAlias StreamingRelation StreamingRelationV2 StreamingExecutionRelation StreamingDataSourceV2Relation "
    "StreamingDataSourceV2ScanRelation GlobalLimit LocalLimit View LogicalRelation Relation LocalRelation LogicalRDD "
    "DeserializeToObject SerializeFromObject MapElements EventTimeWatermark ArrowEvalPython Generate ResolvedHint".split()
)
MORE = {"plain": frozenset(), "union": frozenset({"Union"}), "window": frozenset({"Aggregate", "Expand", "Union"}), "interval": frozenset({"Join"})}


def nodes(df: DataFrame) -> list[str]:
    """Names of the analyzed plan's nodes."""
    text = df._jdf.queryExecution().analyzed().treeString()
    return [m[1] for line in text.splitlines() if (m := re.match(r"[\s:+|-]*'?~?([A-Z]\w+)", line))]


def admit(df: DataFrame, kind: str) -> None:
    """Raise if the plan has a node that a stream of this kind of statement can't have."""
    for name in nodes(df):
        if name not in PASS | MORE[kind]:
            raise SqlError(f"a stream can't run {name}: only filters and projections pass{', beside ' + ', '.join(sorted(MORE[kind])) if MORE[kind] else ''}")
