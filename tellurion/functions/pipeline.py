"""Pipelines as dictionaries of named steps. Each step makes a DataFrame from its inputs; Spark's laziness orders the work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def build(steps: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]], wanted: str) -> DataFrame:
    """steps: name -> (function, names of inputs). Steps that `wanted` does not need are not made; a cycle is an error."""
    made: dict[str, DataFrame] = {}

    def make(name: str, path: tuple[str, ...] = ()) -> DataFrame:
        if name in path:
            raise ValueError("cycle: " + " -> ".join((*path, name)))
        if name not in made:
            f, inputs = steps[name]
            made[name] = f(*(make(i, (*path, name)) for i in inputs))
        return made[name]

    return make(wanted)


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's transform, a batch of rows in and a batch out, with a declared schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield f(b)

    return df.mapInPandas(run, schema)


def aggregate_batches(df: DataFrame, keys: list[str], add: Callable[[pd.DataFrame], dict], state: str, merge: Callable[[pd.DataFrame], dict], result: str) -> DataFrame:
    """A user's own aggregate. add: the rows of one group in a batch to one row of state columns; merge: the states of a group
    to its result. Both get pandas frames and return dictionaries; state and result declare their columns.

    Rows become states where they lie, so a group sends a row a batch to the task that merges it, however large it is.
    """
    kinds = dict(df.select(*keys).dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{**dict(zip(keys, k)), **add(g)} for k, g in b.groupby(keys, dropna=False, sort=False)]
            if rows:
                yield pd.DataFrame(rows)

    def whole(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(keys, key)), **merge(states)}])

    return df.mapInPandas(partial, f"{head}, {state}").groupBy(*keys).applyInPandas(whole, f"{head}, {result}")
