"""Hooks for a user's models (embedding, pair scoring), activations of sparse models, and phases with hysteresis."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import round_to


def _mapped(df: DataFrame, columns: Sequence[str], load: Callable[[], Callable], out: StructField, kind: pa.DataType, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                if model is None:
                    model = load()
                args = [[x or "" for x in b.column(b.schema.get_field_index(c)).to_pylist()] for c in columns]
                new = pa.array(list(model(*args)), kind)
                if len(new) != b.num_rows:
                    raise ValueError(f"the model gave {len(new)} results for {b.num_rows} rows")
                yield pa.RecordBatch.from_arrays([*b.columns, new], schema=b.schema.append(pa.field(out.name, kind)))

    return df.mapInArrow(run, StructType([*df.schema.fields, out]))


def embedded(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[Sequence[float]]]], vector: str = "v", rows: int = 256) -> DataFrame:
    """``df`` with a vector of each text, by the model that ``load`` gives once in a task, ``rows`` texts at a time; a null text is embedded as an empty one."""
    return _mapped(df, [text], load, StructField(vector, ArrayType(DoubleType())), pa.list_(pa.float64()), rows)


def reranked_pairs(pairs: DataFrame, query: str, text: str, load: Callable[[], Callable[[list[str], list[str]], list[float]]], group: str, key: str, most: int, rows: int = 64) -> DataFrame:
    """The ``most`` pairs of each group with the highest scores by a cross-encoder, which sees query and text side by side; ties to the smaller key."""
    d = _mapped(pairs, [query, text], load, StructField("pair_score", DoubleType()), pa.float64(), rows)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("pair_score"), key))).filter(F.col("rank") <= most)


def activations(logits: DataFrame, key: str, term: str, logit: str, least: float = 0.001) -> DataFrame:
    """(key, term, weight): ln(1 + relu(x)) of a term's largest logit over all positions, where it is above ``least``, to three places."""
    w = F.log1p(F.greatest(F.lit(0.0), F.max(logit)))
    return logits.groupBy(key, term).agg(w.alias("_w")).filter(F.col("_w") > least).select(key, term, round_to(F.col("_w"), 3).alias("weight"))


def held_phase(ratio: Column, key: str, *order: str, enter: float = 0.30, leave: float = 0.25) -> Column:
    """Whether a key is active: from a ratio of ``enter`` or more until one below ``leave``; between the two it stays as it was, at first inactive. A null ratio changes nothing."""
    mark = F.when(ratio >= enter, True).when(ratio < leave, False)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False))
