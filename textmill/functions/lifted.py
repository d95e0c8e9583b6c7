"""Python functions over Arrow arrays as columns, also over arrays of values.

Spark can't call a Python function inside the lambda of an array expression, so a function that is to work on all
texts of an array gets the whole array: ``many`` lays arrays end to end, calls the function once and
cuts its results like the input. A large batch is given in slices of bounded size.

The functions are declared non-deterministic, whatever they do: then Spark neither computes them twice nor puts them into
expressions over the results of others, where it couldn't take them out again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Run = Callable[[pa.Array], pa.Array]
SLICE, EACH = 1 << 21, 8  # bytes, and what a text counts beside its own


def listed(lists: pa.Array, run: Run) -> pa.Array:
    """``run`` over the values of all lists at once; a null list gives an empty one."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), run(lists.flatten()))


def sizes_of(values: pa.Array, each: int = 0) -> np.ndarray:
    """Bytes of the texts in each value, nested ones too, and ``each`` more for a text; one for what holds no text."""
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(sizes_of(values.flatten(), each))])
        ends = np.cumsum(lengths)
        return sums[ends] - sums[ends - lengths]
    if pa.types.is_struct(values.type):
        return sum((sizes_of(x, each) for x in values.flatten()), np.zeros(len(values), dtype=np.int64))
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) + each
    return np.ones(len(values), dtype=np.int64)


def sliced(values: pa.Array, run: Run) -> pa.Array:
    """The results of ``run``, which gets about ``SLICE`` bytes of texts at a time (one value at least): what it holds beside a batch and its results does not
    grow with the batch."""
    upto = np.cumsum(sizes_of(values, EACH))
    if not len(values) or upto[-1] <= SLICE:
        return run(values)
    begins = np.flatnonzero(np.diff(upto // SLICE, prepend=-1)).tolist()
    return pa.concat_arrays([run(values.slice(a, b - a)) for a, b in zip(begins, [*begins[1:], len(values)])])


def clocked(values: pa.Array, run: Run) -> pa.Array:
    """The results of ``run`` as ``v``, and as ``ns`` the nanoseconds of the whole call, shared out by the sizes of the values."""
    began = time.perf_counter_ns()
    found = run(values)
    took = time.perf_counter_ns() - began
    sizes = sizes_of(values) + 1
    shares = np.diff(np.floor(np.concatenate([[0], np.cumsum(sizes)]) * (took / max(sizes.sum(), 1))).astype(np.int64))
    return pa.StructArray.from_arrays([found, pa.array(shares)], ["v", "ns"])


class PerValue:
    """A function from an Arrow array to one of the same length and of the Spark type ``result``."""

    def __init__(self, run: Run, result: str):
        self.run, self.result = run, result

    def timed(self) -> PerValue:
        """The same function, with a struct of its result ``v`` and its share ``ns`` of the time of its batch."""
        run = self.run
        return PerValue(lambda values: clocked(values, run), f"struct<v {self.result}, ns bigint>")

    def over_lists(self) -> PerValue:
        """The same function for arrays of its values."""
        run = self.run
        return PerValue(lambda lists: listed(lists, run), f"array<{self.result}>")

    def one(self, values: Column) -> Column:
        run = self.run

        @F.arrow_udf(self.result)
        def of(batch: pa.Array) -> pa.Array:
            return sliced(batch, run)

        return of.asNondeterministic()(values)

    def many(self, lists: Column) -> Column:
        return self.over_lists().one(lists)

    def add(self, df: DataFrame, value: Column, out: str) -> DataFrame:
        """``df`` with the results as a column."""
        return df.withColumn(out, self.one(value))

    def add_timed(self, df: DataFrame, value: Column, out: str, spent: str) -> DataFrame:
        """``add``, with the time in the worker added to the column ``spent`` (nanoseconds)."""
        df = df.withColumn(out, self.timed().one(value))
        return df.withColumns({spent: F.col(spent) + F.col(out)["ns"], out: F.col(out)["v"]})
