"""Hashes of multisets of rows that are kept up: what is added is added to the state, what goes is taken from it.

A row's canonical JSON is expanded by SHAKE-128 to ``LANES`` numbers of 16 bits, and a scope's state is their
sum, lane by lane, modulo 2^16 (a hash on a lattice, which no one can make collide for
this many lanes). States of parts add up to the state of the whole, whatever the order and the
partitioning, so neither an append nor a replacement reads the rows that were there before. Rows that
repeat count as often as they occur. Texts, integers, dates and the like only: floats are written
differently by other writers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = 1024


def state(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``(by, n_rows, lanes)`` of every scope: partial states of a task, then sums of lanes."""
    row = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    rows = df.select(*by, row.alias("_row"))
    scopes = rows.drop("_row").schema
    lanes, limit = LANES, 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            keys, values = list(held), list(held.values())
            made = [pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)]
            held.clear()
            return pa.RecordBatch.from_arrays([*made, pa.array([v[0] for v in values], pa.int64()), pa.array([v[1].tolist() for v in values], pa.list_(pa.int32()))], [*by, "n_rows", "lanes"])

        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            scope = zip(*(batch.column(c).to_pylist() for c in by), strict=True) if by else iter([()] * batch.num_rows)
            for key, text in zip(scope, batch.column("_row").to_pylist(), strict=True):
                one = held.get(key)
                if one is None:
                    if len(held) >= limit:
                        yield out()
                    one = held[key] = [0, np.zeros(lanes, np.uint16)]
                one[0] += 1
                one[1] += np.frombuffer(hashlib.shake_128(text.encode()).digest(2 * lanes), "<u2")
        if held:
            yield out()

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in scopes) + "n_rows bigint, lanes array<int>"
    return _summed(rows.mapInArrow(run, schema), by)


def _summed(parts: DataFrame, by: list[str]) -> DataFrame:
    """States of one scope as one. Lanes are added up on their own, so no task holds all parts of a scope."""
    each = parts.select(*by, "n_rows", F.posexplode("lanes").alias("_lane", "_value"))
    lanes = each.groupBy(*by, "_lane").agg(F.sum("_value").alias("_value"), F.sum("n_rows").alias("n_rows"))
    value = F.pmod("_value", F.lit(1 << 16)).cast("int").alias("v")
    whole = F.array_sort(F.collect_list(F.struct("_lane", value)))  # LANES values
    return lanes.groupBy(*by).agg(F.max("n_rows").alias("n_rows"), whole.alias("_whole")).select(*by, "n_rows", F.col("_whole.v").alias("lanes"))


def combined(a: DataFrame, b: DataFrame, by: list[str], minus: bool = False) -> DataFrame:
    """The state of what two states stand for together, or with ``minus`` of the first less the second."""
    sign = -1 if minus else 1
    other = b.select(*by, (sign * F.col("n_rows")).cast("bigint").alias("n_rows"), F.transform("lanes", lambda x: (sign * x).cast("int")).alias("lanes"))
    return _summed(a.select(*by, "n_rows", "lanes").unionByName(other), by)


def digest(states: DataFrame, by: list[str]) -> DataFrame:
    """``(by, n_rows, content_hash)``: SHA-256 of a state's lanes and number of rows."""
    text = F.concat_ws(",", F.transform("lanes", lambda x: x.cast("string")))
    return states.select(*by, "n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), text), 256).alias("content_hash"))
