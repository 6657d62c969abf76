"""Hard-negative mining by exact inner products behind segment summaries.

A vector's components become integers, floor(scale * x), and it is cut to segments of SEGMENT components, each kept as
its mean and deviation (the length of what differs from the mean).  The inner product of two segments is their length
times the product of the means, give or take the product of the deviations; summed over segments this bounds the score
of two vectors from both sides.  Segments merge four to one into coarser ones, up to one or a few a vector.  A pair is
bounded by the coarsest segments first, by finer ones only while it may still matter, and scored exactly last.

A row with a null id, label, vector or component, or with a component that is not finite, takes no part.  A shorter
vector counts as followed by zeros.  A row with an anchor's own id is never its positive.  A repeated row counts as often
as it stands in the table, and a repeated anchor's result is repeated.  Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayloom.llm.common import written

#: Components of the finest segment, and how many segments make one of the next level.
SEGMENT, MERGED = 4, 4
#: Anchors that a task holds, about; rows that meet them at once; pairs refined at once.
GROUP, ROWS, PAIRS = 2048, 512, 1 << 16
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
VECTOR = "no long, id long, label long, vector array<long>, means array<double>, deviations array<double>"


def vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(id, label, vector, means, deviations) of the rows of (vec_id, label, embedding) that take part."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~bad)
    rows = rows.select("id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                means, deviations = summaries(matrix(batch.column("vector")))
                n = means.shape[1]
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (means, deviations)]], ["id", "label", "vector", "means", "deviations"])

    return rows.mapInArrow(run, VECTOR.removeprefix("no long, "))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists as rows, shorter ones filled up with zeros."""
    flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=flat.dtype)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(offsets[:-1], size)] = flat
    return out


def wider(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def summaries(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of SEGMENT components."""
    n = -(-m.shape[1] // SEGMENT)
    cut = wider(m, n * SEGMENT).reshape(len(m), n, SEGMENT).astype(np.float64)
    means = cut.mean(axis=2)
    return means, np.sqrt(((cut - means[:, :, None]) ** 2).sum(axis=2))


def coarser(means: np.ndarray, deviations: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of MERGED neighbouring segments of ``length`` components each."""
    n = -(-means.shape[1] // MERGED)
    means, deviations = (wider(x, n * MERGED).reshape(len(x), n, MERGED) for x in (means, deviations))
    merged = means.mean(axis=2)
    return merged, np.sqrt((deviations**2).sum(axis=2) + length * ((means - merged[:, :, None]) ** 2).sum(axis=2))


class Level(NamedTuple):
    means: np.ndarray  # times the square root of a segment's length, so that products need no factor
    deviations: np.ndarray


class Side(NamedTuple):
    """Vectors with their summaries, from the coarsest level to the finest."""

    no: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    levels: list[Level]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Side:
        means, deviations = matrix(batch.column("means")), matrix(batch.column("deviations"))
        levels, length = [], SEGMENT
        while True:
            levels.append(Level(means * np.sqrt(length), deviations))
            if means.shape[1] <= 1:
                break
            means, deviations = coarser(means, deviations, length)
            length *= MERGED
        return cls(*[batch.column(c).to_numpy() for c in ("no", "id", "label")], matrix(batch.column("vector")), levels[::-1])

    def take(self, at: np.ndarray | slice) -> Side:
        return Side(self.no[at], self.ids[at], self.labels[at], self.vectors[at], [Level(x.means[at], x.deviations[at]) for x in self.levels])

    def deep(self, levels: int, width: int) -> Side:
        """As many levels and components as another side of longer vectors has."""
        more = [Level(*_merged(self.levels[0], i)) for i in range(levels - len(self.levels), 0, -1)]
        return self._replace(vectors=wider(self.vectors, width), levels=more + self.levels)


def _merged(level: Level, times: int) -> tuple[np.ndarray, np.ndarray]:
    """One segment a vector, in one of MERGED ** times the length: the rest are zeros."""
    scaled, deviations = level
    mean, spread = scaled / MERGED ** (times / 2), scaled**2 * (1 - MERGED**-times)
    return mean, np.sqrt(deviations**2 + spread)


def candidates(a: Side, b: Side, least: np.ndarray, most: np.ndarray, other_label: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of pairs of labels that agree (or differ) whose score may be from least[i] to most[i], in pieces.

    All pairs meet the coarsest summaries as one product; those that are left meet the finer ones, then the vectors.
    """
    width, levels = max(a.vectors.shape[1], b.vectors.shape[1]), max(len(a.levels), len(b.levels))
    a, b = a.deep(levels, width), b.deep(levels, width)
    top_a, top_b = a.levels[0], b.levels[0]
    middle, give = top_a.means @ top_b.means.T, top_a.deviations @ top_b.deviations.T
    slack = 1e-9 * (np.abs(middle) + give) + 1e-3
    keep = (middle + give + slack >= least[:, None]) & (middle - give - slack <= most[:, None])
    keep &= (a.labels[:, None] != b.labels[None, :]) if other_label else (a.labels[:, None] == b.labels[None, :])
    rows, columns = np.nonzero(keep)
    for at in range(0, len(rows), PAIRS):
        i, j = rows[at : at + PAIRS], columns[at : at + PAIRS]
        for x, y in zip(a.levels[1:], b.levels[1:], strict=True):
            n = min(x.means.shape[1], y.means.shape[1])
            middle = np.einsum("ij,ij->i", x.means[i, :n], y.means[j, :n])
            give = np.einsum("ij,ij->i", x.deviations[i, :n], y.deviations[j, :n])
            slack = 1e-9 * (np.abs(middle) + give) + 1e-3 + 1e-12 * np.sqrt(np.einsum("ij,ij->i", x.means[i, :n], x.means[i, :n]) * np.einsum("ij,ij->i", y.means[j, :n], y.means[j, :n]))
            good = (middle + give + slack >= least[i]) & (middle - give - slack <= most[i])
            i, j = i[good], j[good]
        yield i, j, np.einsum("ij,ij->i", a.vectors[i], b.vectors[j])


class Best:
    """The first k of each of n lists, by descending score and then id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), _LOW), np.full((n, k), _HIGH)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.scores[at, -1]
        at, score, ids = at[good], score[good], ids[good]
        if not len(at):
            return
        touched = np.unique(at)
        held = np.repeat(touched, self.k)
        at, score, ids = np.concatenate([held, at]), np.concatenate([self.scores[touched].ravel(), score]), np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, -1 - score, at))  # -1 - score keeps the least long in range
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, at)
        place = np.arange(len(at)) - first
        good = place < self.k
        self.scores[at[good], place[good]], self.ids[at[good], place[good]] = score[good], ids[good]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.ids != _HIGH)
        return at, self.ids[at, place], self.scores[at, place]


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int) -> DataFrame:
    """Groups of about GROUP anchors beside parts of the rows: every anchor meets every row in one cell.

    As many cells as shuffle partitions, or a cell a group if there are more groups.  A row is sent once a group and an
    anchor once a part; in a cell the anchors come first.
    """
    groups = max(1, -(-n_anchors // GROUP))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups)
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = F.col("part") * groups + F.col("group")
    held = anchors.withColumns({"kind": F.lit(0), "group": spread("no", groups), "part": many(parts)}).withColumn("cell", cell)
    met = rows.withColumns({"kind": F.lit(1), "part": spread("no", parts), "group": many(groups)}).withColumn("cell", cell)
    both = held.unionByName(met, allowMissingColumns=True)
    return both.repartitionById(groups * parts, "cell").sortWithinPartitions("kind", "no")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(kind, batch): all anchors of the cell as one batch, then its rows, ROWS at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = int((batch.column("kind").to_numpy() == 0).sum())
        if n:
            held.append(batch.slice(0, n))
        if n < batch.num_rows:
            if held:
                yield 0, pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]
                held = []
            for at in range(n, batch.num_rows, ROWS):
                yield 1, batch.slice(at, ROWS)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(anchors: DataFrame, rows: DataFrame, n_anchors: int, k: int) -> DataFrame:
    """(no, positives): the first k other rows of each anchor's label, as (rank, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = None, None
        for kind, batch in _cut(batches):
            side = Side.of(batch)
            if kind == 0:
                held, best = side, Best(len(side.no), k)
            elif held is not None:
                for i, j, score in candidates(held, side, best.scores[:, -1], np.full(len(held.no), _HIGH), other_label=False):
                    other = held.ids[i] != side.ids[j]
                    best.add(i[other], score[other], side.ids[j][other])
        if best is not None:
            at, ids, scores = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(held.no[at]), pa.array(ids), pa.array(scores)], ["no", "found", "score"])

    met = _cells(anchors, rows, n_anchors)
    best = _first(met.mapInArrow(run, "no long, found long, score long"), ["no"], k)
    return best.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("found").alias("id"), "score"))).alias("positives"))


def _negatives(anchors: DataFrame, rows: DataFrame, n_anchors: int, k: int, n_positives: int, least: int, most: int) -> DataFrame:
    """(no, place, found, score, rank): for each positive (by place) of an anchor, the first k rows of another label in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = None, None
        for kind, batch in _cut(batches):
            side = Side.of(batch)
            if kind == 0:
                held, best = side, Best(len(side.no) * n_positives, k)
                low, high = np.full((len(side.no), n_positives), _HIGH), np.full((len(side.no), n_positives), _LOW)
                for i, positives in enumerate(batch.column("positives").to_pylist()):
                    for p in positives:
                        low[i, p["rank"] - 1], high[i, p["rank"] - 1] = -(-least * p["score"] // 100), most * p["score"] // 100
                empty = low > high
            elif held is not None:
                need = np.where(empty, _HIGH, np.maximum(low, best.scores[:, -1].reshape(low.shape)))
                for i, j, score in candidates(held, side, need.min(axis=1), np.where(empty, _LOW, high).max(axis=1), other_label=True):
                    pair, place = np.nonzero(~empty[i] & (low[i] <= score[:, None]) & (score[:, None] <= high[i]))
                    best.add(i[pair] * n_positives + place, score[pair], side.ids[j][pair])
        if best is not None:
            at, ids, scores = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(held.no[at // n_positives]), pa.array((at % n_positives).astype(np.int32)), pa.array(ids), pa.array(scores)], ["no", "place", "found", "score"])

    met = _cells(anchors, rows, n_anchors)
    return _first(met.mapInArrow(run, "no long, place int, found long, score long"), ["no", "place"], k)


def hard_negatives(embeddings: DataFrame, is_anchor: Column | str, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition over ``id`` (vec_id) and ``label``.  An anchor's positives are its best rows of the same label; for each, the
    negatives are the best rows of other labels that score from ``least`` to ``most`` percent of the positive.  Both
    passes deal anchors and rows to cells of a bounded group of anchors and a part of the rows, which streams past
    them; a cell sends on no more than a list an anchor (or positive), and lists merge by anchor.
    """
    rows = written(vectors(embeddings, scale).withColumn("no", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where(F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor)
    n = anchors.count()
    found = _positives(anchors, rows, n, positives)
    known = written(anchors.join(found, "no"), "anchors")
    best = _negatives(known, rows, n, negatives, positives, least, most)
    asked = known.select("no", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("place", "p"))
    return best.join(asked, ["no", "place"]).select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("found").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
