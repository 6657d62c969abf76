"""Packing token documents into fixed windows with almost no padding.

Bounded-space online packing.  Each partition keeps a fixed number of open windows.  A document
gives full windows while it has enough ids; its remainder goes to the open window that it fits
best.  Where none fits, a new window opens, or, with all of them open, the fullest one is filled
with the head of the remainder and emitted; the rest is placed anew.  At the end of a partition
its open windows are merged into full ones and a single leftover.  The leftovers of up to
``fan_in`` partitions meet in one task, and so on until one is left, so no task sees more than a
bounded number of them.

Only the last window of all has padding, and none if its length is a power of two: it is then
emitted at its own length.

Null and empty texts are documents of the end id alone.  Rows with equal ``doc_id`` are packed
as documents of their own.  An empty table gives no pieces.  Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayloom.llm.common import documents, pieces, written
from relayloom.llm.tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_HELD = "doc_id long, start long, length long, doc_tokens long, ids binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64())])
_ALL = PIECE + ", ids binary, part long"


class Packer:
    """The open windows of one task.  A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, size: int, spaces: int):
        self.size, self.spaces = size, spaces
        self.open: list[list[tuple]] = []
        self.used: list[int] = []

    def _close(self, i: int) -> list[tuple]:
        self.used.pop(i)
        return self.open.pop(i)

    def add(self, doc_id: int, start: int, total: int, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Places a piece; gives the windows that it filled."""
        while len(ids) >= self.size:
            yield [(doc_id, start, total, ids[: self.size])]
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            room = [(self.size - u, i) for i, u in enumerate(self.used) if self.size - u >= len(ids)]
            if room:
                i = min(room)[1]
            elif len(self.open) < self.spaces:
                self.open.append([])
                self.used.append(0)
                i = len(self.open) - 1
            else:
                i = max(range(len(self.used)), key=lambda k: (self.used[k], -k))
            n = min(len(ids), self.size - self.used[i])
            self.open[i].append((doc_id, start, total, ids[:n]))
            self.used[i] += n
            start, ids = start + n, ids[n:]
            if self.used[i] == self.size:
                yield self._close(i)

    def end(self) -> Iterator[list[tuple]]:
        """Merges the open windows: full ones first, the leftover last (never empty)."""
        rest = [p for _, w in sorted(zip(self.used, self.open, strict=True), key=lambda x: -x[0]) for p in w]
        window, used = [], 0
        for doc_id, start, total, ids in rest:
            while len(ids):
                n = min(len(ids), self.size - used)
                window.append((doc_id, start, total, ids[:n]))
                start, ids, used = start + n, ids[n:], used + n
                if used == self.size:
                    yield window
                    window, used = [], 0
        if window:
            yield window


def _batch(windows: list[tuple[int, list[tuple], bool]], with_ids: bool, part: int) -> pa.RecordBatch:
    rows = []
    for sequence, window, left in windows:
        at = 0
        for doc_id, start, total, ids in window:
            raw = ids.tobytes()
            rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, -1 if left else sequence, at, raw if left or with_ids else None, part if left else None))
            at += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _run(packer: Packer, source: Iterator[tuple], base: int, part: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Sequence ids count up from ``base``; the leftover has -1 and keeps its ids."""
    done: list[tuple[int, list[tuple], bool]] = []
    sequence = base
    for piece in source:
        for window in packer.add(*piece):
            done.append((sequence, window, False))
            sequence += 1
        if len(done) >= 1000:
            yield _batch(done, with_ids, part)
            done = []
    for window in packer.end():
        left = sum(len(p[3]) for p in window) < packer.size
        done.append((sequence, window, left))
        sequence += 1
    if done:
        yield _batch(done, with_ids, part)


def _first(tokenizer: str, end_id: int, size: int, spaces: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), encoder(tokenizer), int(end_id).to_bytes(4, "little")

        def docs() -> Iterator[tuple]:
            for batch in pieces(batches, "text"):
                for key, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                    ids = np.frombuffer(raw + end, "<u4")
                    yield key, 0, len(ids), ids

        yield from _run(Packer(size, spaces), docs(), part << 36, part, with_ids)

    return run


def _merge(level: int, size: int, spaces: int, with_ids: bool) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([("part", "ascending"), ("offset", "ascending")])
        columns = [table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")]
        source = ((d, s, t, np.frombuffer(i, "<u4")) for d, s, t, i in zip(*columns, strict=True))
        out = list(_run(Packer(size, spaces), source, (level << 56) | (group << 20), group, with_ids))
        return pa.Table.from_batches(out, schema=_SCHEMA)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, spaces: int = 16, fan_in: int = 256, with_ids: bool = False) -> DataFrame:
    """PIECE rows: where each run of a document's ids lies.  With ``with_ids`` also the ids of each piece.

    Texts are not shuffled: packing runs where they are read, and only leftovers (one window a
    partition) move.
    """
    first = written(documents(docs).mapInArrow(_first(tokenizer, end_id, size, spaces, with_ids), _ALL), "pack")
    keep = [c.split()[0] for c in PIECE.split(", ")] + (["ids"] if with_ids else [])
    result = first.where("part is null").select(keep)
    left, level = first.where("part is not null"), 1
    while True:
        parts = left.agg(F.countDistinct("part").alias("n"), F.max("part").alias("most")).first()
        if parts.n <= 1:
            break
        order = left.select("part").distinct().select("part", (F.expr("row_number() over (order by part)") - 1).alias("rank"))  # a row a partition of the level below
        grouped = left.join(F.broadcast(order), "part").withColumn("group", F.expr(f"cast(rank div {fan_in} as long)"))
        merged = written(grouped.groupBy("group").applyInArrow(_merge(level, size, spaces, with_ids), _ALL), "pack")
        result = result.unionByName(merged.where("part is null").select(keep))
        left, level = merged.where("part is not null"), level + 1
    last = left.withColumn("sequence_id", F.lit(1 << 62).cast("long"))
    return result.unionByName(last.select(keep))
