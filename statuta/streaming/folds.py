"""State machines over keyed, ordered rows: one step function for tables and for streams.

A machine is a function ``step(state, row) -> (state, outputs)`` over plain values.  Over a table the rows of a key pass through a
task in order, sorted by Spark, and only the state of the open key is held; over a stream the state is kept by Spark between batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

State = dict | None
Step = Callable[[State, dict], tuple[State, list[tuple]]]
BATCH = 1000


@dataclass(frozen=True)
class Machine:
    """``step`` takes the state (null at first) and a row's columns, and gives the next state, which must be JSON, and output rows of ``outputs``."""

    step: Step
    outputs: str


def _packed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The key and the order as longs, and each row as JSON; nulls are left out of it."""
    return rows.select(F.col(key).cast("string").alias("_key"), F.col(order).cast("long").alias("_at"), F.to_json(F.struct(*rows.columns)).alias("_row"))


def _schema(key: str, outputs: str) -> StructType:
    return StructType([StructField(key, StringType()), *StructType.fromDDL(outputs)])


def fold(rows: DataFrame, machine: Machine, key: str, order: str) -> DataFrame:
    """``key`` (as a string) and the machine's outputs, for all rows of each key by ``order`` (whole numbers, ties by the row's JSON).

    One shuffle by key.  A key's rows are streamed, so only its state and a batch of outputs are in memory.
    """
    schema = _schema(key, machine.outputs)
    arrow, step = to_arrow_schema(schema), machine.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = object(), None, []
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != at:
                    at, state = k, None
                state, told = step(state, json.loads(raw))
                out += [(k, *t) for t in told]
                if len(out) >= BATCH:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    return _packed(rows, key, order).repartition("_key").sortWithinPartitions("_key", "_at", "_row").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def fold_stream(rows: DataFrame, machine: Machine, key: str, order: str) -> DataFrame:
    """As ``fold`` over a stream: rows of one batch pass in order, batches as they come, and state stays in Spark's state store.

    A machine that must not take late rows has to tell them by what it keeps itself.
    """
    schema, step = _schema(key, machine.outputs), machine.step
    names = [f.name for f in schema]

    def run(k: tuple, parts: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else None
        found = pd.concat(list(parts)).sort_values(["_at", "_row"])
        out = []
        for raw in found["_row"]:
            state, told = step(state, json.loads(raw))
            out += [(k[0], *t) for t in told]
        kept.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    held = StructType([StructField("state", StringType())])
    return _packed(rows, key, order).groupBy("_key").applyInPandasWithState(run, schema, held, "append", "NoTimeout")
