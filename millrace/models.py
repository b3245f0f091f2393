"""Predictions over tables: input expressions, a predictor called in batches, output expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime
from millrace.spec import ModelTransforms

Predictor = Callable[[pd.DataFrame], pd.DataFrame]


def predict(df: DataFrame, model: ModelTransforms, predictor: Predictor, schema: str) -> DataFrame:
    """Passthrough columns and the outputs. predictor gets frames of at most batch_size rows with the inputs and returns
    one row each, with the columns of `schema`, which the output expressions may use."""
    runtime.send_package(df.sparkSession)
    inputs, keep, size = list(model.inputs), list(model.passthrough), model.batch_size
    given = df.select(*keep, *[F.expr(e).alias(f"_in_{n}") for n, e in model.inputs.items()])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for k in range(0, len(frame), size):
                part = frame.iloc[k : k + size].reset_index(drop=True)
                made = predictor(part[[f"_in_{n}" for n in inputs]].rename(columns=lambda c: c[4:])).reset_index(drop=True)
                yield pd.concat([part[keep], made], axis=1)

    out = given.mapInPandas(run, ", ".join(x for x in (kept, schema) if x))
    return out.select(*keep, *[F.expr(e).alias(n) for n, e in model.outputs.items()])
