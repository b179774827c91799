"""Python over groups of rows, without a call from Spark for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_group(df: DataFrame, key: str, order: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on the rows of each value of ``key``, in ``order``; the results of many small groups go back in one batch.

    Rows are parted by the key and sorted in their partitions, so memory holds
    a batch and the group that runs over its end. Null keys are one group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            code = pd.factorize(pdf[key], use_na_sentinel=False)[0]
            cuts = np.flatnonzero(np.diff(code)) + 1
            parts = [pdf.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(pdf)])]
            if held and not _same(held[-1][key].iloc[-1], parts[0][key].iloc[0]):
                done = [work(_one(held))]
                held = []
            else:
                done = []
            held.append(parts[0])
            if len(parts) > 1:
                done += [work(_one(held)), *[work(p.reset_index(drop=True)) for p in parts[1:-1]]]
                held = [parts[-1]]
            done = [d for d in done if len(d)]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held:
            yield work(_one(held))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _same(a, b) -> bool:
    return bool(a == b) or bool(pd.isna(a) and pd.isna(b))


def _one(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
