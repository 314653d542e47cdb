"""Ordered groups streamed through plain Python.

For steps whose decisions depend on earlier ones. Rows are dealt by key, sorted, and pass a task in
batches; only the rows of one key are held. Unlike a grouped pandas function there is no frame for
each key, so many small groups are cheap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


def dealt(df: DataFrame, *keys: str, size: int = 0) -> DataFrame:
    """df by keys, in a number of tasks that the engine keeps: few bytes mean much work here, so it must not merge small partitions. size: bytes read, if known; the engine's own estimates of joined rows are products, so of no use."""
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(2000, size >> 23))
    return df.repartition(tasks, *keys)


def by_key(df: DataFrame, keys: list[str], order: list[Column], step: Callable[[list[tuple]], list[tuple]], schema: str, placed: bool = False) -> DataFrame:
    """placed: the rows of a key lie in one partition already. step takes the rows of one key, in order, as tuples of df's columns without the keys, and returns rows of `schema`; the keys go before them."""
    rest = [c for c in df.columns if c not in keys]
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [schema])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def done() -> list[tuple]:
            return [(*now, *row) for row in step(held)] if held else []

        for b in batches:
            out: list[tuple] = []
            b = b.astype(object).where(b.notna(), None)
            for key, row in zip(zip(*(b[k] for k in keys), strict=True), zip(*(b[c] for c in rest), strict=True), strict=True):
                if key != now:
                    out += done()
                    now, held = key, []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=[*keys, *names])
        if out := done():
            yield pd.DataFrame(out, columns=[*keys, *names])

    rows = df.select(*keys, *rest)
    return (rows if placed else rows.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, kinds)
