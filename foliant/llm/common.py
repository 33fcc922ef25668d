"""What the training-data operators share: tables in the cluster's scratch folder, cut lineage, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from foliant.operators import graph
from foliant.operators.graph import shared_dir, written


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest node of its component."""
    return graph.components(edges)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a batch that are Python objects at the same time.
SLICE_ROWS = 128


def sliced(batches) -> Iterator:
    """The batches in slices of a few rows: whole texts are held as Python objects only so many at a time."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


__all__ = ["connected_components", "scratch_path", "shared_dir", "sliced", "unused", "written"]
