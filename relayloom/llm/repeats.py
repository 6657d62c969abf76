"""Substring deduplication by level-wise doubling of repeated windows.

A window of ``window`` words goes if its words also start at another place, in any document.
Levels: ``window`` is halved (rounding up) until it is short; the shortest windows are counted
first, and only those that are repeated are extended to about twice their length, until the wanted
length is reached or no candidate survives.

At the first level not all short windows are counted but, of each window of the second length, the
one with the least hash (a minimizer).  Equal windows have equal minimizers at equal places, so a
window whose minimizer occurs once is not repeated.  This leaves about one row for nine words.
At each level the windows are counted by a partially aggregated sum over their hashes, and the
candidates join the repeated hashes; a very common passage is split by the skewed join.

Texts that are the same word sequence are found first.  All but one of each such group skip the
levels; where they hold a window at all, every word of every copy goes.

Words are runs of bytes other than ASCII white space, unchanged.  Hashes of windows have 64 bits
(a chance of 2 ** -57 or less for two windows to be mistaken for one); word sequences 128.  Null
and empty texts have no words.  Rows with equal ``doc_id`` are marked together: a place that is
repeated in one of them goes from all that have it.  A row without an id counts for the others but loses
nothing itself.  Input columns stay, but for those that the result names itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayloom.llm.common import documents, drop_written, fewer, pieces, quoted, written
from relayloom.llm.wordhash import MULTIPLIER, inside_texts, mix, window_minima, windows, words

_FOUND = "doc_id long, n_words long, s1 long, s2 long, places array<int>, hashes array<long>"
_RUNS = "doc_id long, places array<int>, hashes array<long>"
_PACKED = "doc_id long, blob binary"
RESULT = "struct<kept_text: string, n_words: long, n_removed: long>"


def levels(window: int, shortest: int = 12) -> list[int]:
    """Window lengths, each at most twice the one before."""
    out = [window]
    while (out[0] + 1) // 2 >= shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64 if kind == pa.int64() else np.int32), kind))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _sequence_hashes(w) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's word sequence."""
    place = np.arange(len(w.hashes), dtype=np.uint64) - np.repeat(w.first[:-1], np.diff(w.first)).astype(np.uint64)
    out = []
    for salt in (1, 2):
        key = mix((place + np.uint64(1)) * np.uint64(MULTIPLIER) + np.uint64(salt)) | np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hashes ^ np.uint64(salt * 77)) * key, dtype=np.uint64)])
        out.append(_signed(mix(sums[w.first[1:]] - sums[w.first[:-1]])))
    return out[0], out[1]


def _first_level(second: int, short: int):
    """Word counts, sequence hashes, and of each window of the second length the minimizer of ``short`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            w = words(batch.column("text"), lower=False)
            h = windows(w.hashes, short)
            spread = second - short + 1
            places, hashes, offsets = [], [], [0]
            for a, b in zip(w.first, w.first[1:], strict=False):
                n = b - a - short + 1
                at = window_minima(h[a : a + n], spread) if n >= spread else np.zeros(0, np.int64)
                places.append(at)
                hashes.append(h[a + at])
                offsets.append(offsets[-1] + len(at))
            s1, s2 = _sequence_hashes(w)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), pa.array(s1), pa.array(s2), _lists(np.concatenate(places), np.array(offsets), pa.int32()), _lists(_signed(np.concatenate(hashes)), np.array(offsets), pa.int64())],
                ["doc_id", "n_words", "s1", "s2", "places", "hashes"],
            )

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames: less to shuffle."""
    import zstandard

    for batch in pieces(batches, "text"):
        c = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "blob"])


def _texts(blobs: list[bytes]) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(b) for b in blobs]


def _second_level(length: int, before: int):
    """Windows of ``length`` around repeated ones of ``before`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "blob", 1 << 20):
            w = words(pa.array(_texts(batch.column("blob").to_pylist()), pa.binary()), lower=False)
            h = windows(w.hashes, length)
            places, hashes, offsets = [], [], [0]
            for a, b, repeated in zip(w.first, w.first[1:], batch.column("repeated").to_pylist(), strict=False):
                near = np.zeros(max(0, b - a - length + 1) + 1, dtype=np.int64)
                at = np.asarray(repeated, dtype=np.int64)
                np.add.at(near, np.clip(at - (length - before), 0, len(near) - 1), 1)
                np.add.at(near, np.clip(at + 1, 0, len(near) - 1), -1)
                near[-1] = 0
                at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                places.append(at)
                hashes.append(h[a + at])
                offsets.append(offsets[-1] + len(at))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(np.concatenate(places), np.array(offsets), pa.int32()), _lists(_signed(np.concatenate(hashes)), np.array(offsets), pa.int64())], ["doc_id", "places", "hashes"])

    return run


def _doubled(step: int):
    """Windows made of two repeated ones, ``step`` words apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": [], "places": [], "hashes": []}
            for row in batch.to_pylist():
                order = np.argsort(row["places"])
                at = np.asarray(row["places"], dtype=np.int64)[order]
                h = np.asarray(row["hashes"], dtype=np.int64)[order].view(np.uint64)
                i = np.searchsorted(at, at + step)
                i[i == len(at)] = 0
                good = at[i] == at + step
                out["doc_id"].append(row["doc_id"])
                out["places"].append(at[good].astype(np.int32))
                out["hashes"].append(_signed(mix(h[good] * np.uint64(MULTIPLIER) + mix(h[i[good]]))))
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["places"], pa.list_(pa.int32())), pa.array(out["hashes"], pa.list_(pa.int64()))], ["doc_id", "places", "hashes"])

    return run


def _repeated(runs: DataFrame) -> DataFrame:
    """(doc_id, place, hash) of the windows whose hash occurs more than once."""
    rows = runs.select("doc_id", F.explode(F.arrays_zip("places", "hashes")).alias("w")).select("doc_id", F.col("w.places").alias("place"), F.col("w.hashes").alias("hash"))
    often = written(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeated")
    return rows.join(often, "hash")


def repeated_windows(docs: DataFrame, window: int = 35) -> tuple[DataFrame, DataFrame]:
    """(doc_id, repeated array<int>) of repeated windows' first words, and (doc_id, copied array) of texts that have a copy.

    ``copied`` has the lengths in words of an id's texts that are in a group of equal word sequences.
    """
    lengths = levels(window)
    docs = documents(docs)
    found = written(docs.mapInArrow(_first_level(lengths[min(1, len(lengths) - 1)], lengths[0]), _FOUND), "windows")
    groups = found.where(F.col("n_words") >= window).groupBy("s1", "s2", "n_words").agg(F.min("doc_id").alias("one"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = written(fewer(groups), "copies")
    member = found.select("doc_id", "s1", "s2", "n_words").join(groups, ["s1", "s2", "n_words"]).select("doc_id", "one", "n_words")
    member = written(fewer(member), "members")
    others = member.where("doc_id != one").select("doc_id")
    runs = found.select("doc_id", "places", "hashes").join(others, "doc_id", "left_anti")
    hits = _repeated(runs)
    for before, length in zip(lengths, lengths[1:], strict=False):
        if before == lengths[0]:
            by_doc = hits.groupBy("doc_id").agg(F.collect_list("place").alias("repeated"))
            text = docs.mapInArrow(_compressed, _PACKED).join(by_doc, "doc_id")
            runs = written(text.mapInArrow(_second_level(length, before), _RUNS), "windows")
            drop_written(found)
        else:
            by_doc = hits.groupBy("doc_id").agg(F.collect_list("place").alias("places"), F.collect_list("hash").alias("hashes"))
            runs = written(by_doc.mapInArrow(_doubled(length - before), _RUNS), "windows")
        hits = _repeated(runs)
    return hits.groupBy("doc_id").agg(F.collect_list("place").alias("repeated")), member.groupBy("doc_id").agg(F.collect_set("n_words").alias("copied"))


def _remover(window: int):
    def rewrite(text: pd.Series, copied: pd.Series, repeated: pd.Series) -> pd.DataFrame:
        out = []
        for t, whole, r in zip(text, copied, repeated, strict=True):
            w = t.encode().split()
            gone = np.zeros(len(w) + 1, dtype=np.int64)
            if whole is not None and len(w) in whole:
                gone[:] = 1
                gone = gone[:-1] > 0
            else:
                at = np.asarray(() if r is None else r, dtype=np.int64)
                at = at[at + window <= len(w)]  # places of another text with the same id may lie beyond this one
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
            kept = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
            out.append((kept.decode(), len(w), int(gone.sum())))
        return pd.DataFrame(out, columns=["kept_text", "n_words", "n_removed"])

    return F.pandas_udf(rewrite, RESULT)


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with ``kept_text`` (kept words, one space between), ``n_words`` and ``n_removed``."""
    repeated, copied = repeated_windows(docs, window)
    marks = repeated.join(copied, "doc_id", "full_outer")
    own = {"kept_text", "n_words", "n_removed"}
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    done = whole.join(marks, "doc_id", "left").withColumn("new", _remover(window)(F.coalesce(F.col("row.text"), F.lit("")), "copied", "repeated"))
    return done.select(*[F.col(f"row.{quoted(c)}") for c in docs.columns if c.lower() not in own], "new.kept_text", "new.n_words", "new.n_removed")
