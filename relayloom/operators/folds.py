"""Ordered folds over a key's rows with bounded memory, and such folds in parallel pieces of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relayloom.operators.shared import kept


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Callable[[tuple], tuple | None]], schema: str) -> DataFrame:
    """Rows of ``schema``: what a fold makes of each row (or None) of a group of ``keys``, in ``order``.

    Groups are dealt by key and sorted by Spark, so a task holds one batch and one group's state, however
    large the group is.  ``make`` gives a new group's fold.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, step = None, None
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                if step is None or now != group:
                    group, step = now, make()
                out = step(row)
                if out is not None:
                    made.append(out)
            yield pd.DataFrame(made, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class Fold(Protocol):
    """A fold over times whose whole state is a list of longs."""

    def step(self, us: int, ok: bool) -> tuple[bool, bool]: ...

    def state(self, at: int) -> list[int]:
        """What still counts at ``at`` or later."""

    def start(self, state: list[int]) -> None: ...


_PIECE = "key string, run long, piece long, begin array<long>, end array<long>"


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def _pieces(rows: DataFrame, make: Callable[[], Fold], length: int) -> DataFrame:
    """(key, run, piece, begin, end): the state in which a piece's own rows begin, and the one they leave.

    A fold starts with the state in ``begin``, and without one empty, before the rows that a piece has from the one
    before (not ``own``); with these it comes near the true state.  ``length`` is a piece's, in microseconds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fold, begun = None, None, None
        done: list[tuple] = []

        def finish() -> None:
            if group is not None:
                done.append((*group, begun, fold.state(group[1] + (group[2] + 1) * length)))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "run", "piece", "begin", "end"])

        for key, number, piece, us, ok, own, begin in _groups(batches, ["key", "run", "piece", "us", "ok", "own", "begin"]):
            if group != (key, number, piece):
                finish()
                group, fold, begun = (key, number, piece), make(), None
                if begin is not None:
                    fold.start(begin)
                if len(done) >= 4096:
                    yield out()
                    done.clear()
            if own and begun is None:
                begun = fold.state(number + piece * length)
            fold.step(us, ok)
        finish()
        yield out()

    dealt = rows.repartition("key", "run", "piece").sortWithinPartitions("key", "run", "piece", "us", "tie")
    return dealt.select("key", "run", "piece", "us", "ok", "own", "begin").mapInArrow(run, _PIECE)


def begin_states(rows: DataFrame, make: Callable[[], Fold], length: int, halo: int) -> DataFrame:
    """(key, run, piece, begin): the true state at the begin of each piece of (key, run, us, tie, ok) but a run's first.

    A run (a long, its first time) is cut to pieces of ``length`` microseconds, which are folded side by side, each
    from a guess: the state after the ``halo`` before it, folded from nothing.  Where the piece before leaves another
    state, the piece is folded again from that, until all agree; a piece whose predecessors agree is right for good,
    so this ends, mostly after a round or two.  One row a piece is looked at between rounds, on Spark as well.
    """
    number = lambda us: F.floor((us - F.col("run")) / F.lit(length)).cast("long")
    cut = rows.withColumn("piece", F.explode(F.sequence(number(F.col("us")), number(F.col("us") + halo)))).withColumn("own", F.col("piece") == number(F.col("us")))
    last = rows.groupBy("key", "run").agg(F.max(number(F.col("us"))).alias("most"))
    cut = cut.join(last, ["key", "run"]).where("piece <= most").drop("most")
    light = kept(cut.select("key", "run", "piece", "us", "tie", "ok", "own"), "pieces")
    known = kept(_pieces(light.withColumn("begin", F.lit(None).cast("array<long>")), make, length), "states")
    one = ["key", "run", "piece"]
    while True:
        arrives = F.lag("end").over(Window.partitionBy("key", "run").orderBy("piece"))
        wrong = known.withColumn("arrives", arrives).where("arrives is not null and arrives <> begin").select(*one, F.col("arrives").alias("begin"))
        if wrong.isEmpty():
            return known.where("piece > 0").select(*one, "begin")
        again = _pieces(light.where("own").join(wrong, one), make, length)
        known = kept(known.join(wrong, one, "left_anti").unionByName(again), "states")
