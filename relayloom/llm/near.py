"""MinHash near-duplicate groups, with links confirmed on full shingle sets.

1. Texts with equal shingle sets form a class; its least ``doc_id`` stands for it.  Only these
   representatives go on, so a large group of copies costs one row a copy.
2. A representative's one-permutation sketch (see ``sketch``) is cut into bands; each band is a
   bucket key.  Buckets with one member are dropped.
3. Star-shaped candidates: in each bucket a center, the member of least hash, is paired with the
   other members, so a bucket gives no more pairs than it has members; as the hash is the same in all
   buckets, a document meets few centers.  The pairs are confirmed on full sets.
4. A round's links join labels: the links between labels, each once, are a small graph, and its
   components (by alternating large and small stars) give the new labels.  Older links are never
   read again; at the end the labels are the components.
5. A star can miss a link between two members that are no center.  So the centers leave their
   buckets, and buckets whose members share one label are done.  The documents in the rest get
   finer buckets: of n shingles, the n - ceil(n * percent / 100) + 1 that are rarest among these documents.
   Linked sets share one of them, and a set of mostly own shingles shares none and is done.  A
   shingle's place also bounds the intersection of a pair that has none in common before it, so
   most pairs that can't link are never made.
6. These buckets get larger and larger lots of centers (each paired with members of other labels
   only) until no bucket is left.  No pair is confirmed twice, none is left out, and no bucket has a cap.
   Joins of rows with their bucket's center or count are salted, so a hot bucket's rows are spread.

With 42 bands of 6 values a pair at a similarity of 0.85 shares no bucket with a chance of about
2e-9, one at 0.8 of about 3e-6.  Words are runs without ASCII white space, A-Z lower-cased; sets hold runs
of five words, or the whole of a shorter text.  Null texts and texts without words have an empty set,
link with nothing and stand for themselves.  Rows with equal ``doc_id`` count as one document of the
larger set.  A row without an id is a document that links with nothing; its component is null and it is
kept.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayloom.llm import tokens
from relayloom.llm.common import documents, drop_written, fewer, pieces, written
from relayloom.llm.sketch import one_permutation, shingles
from relayloom.llm.wordhash import MULTIPLIER, mix, words

_SETS = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
RESULT = "doc_id long, n_shingles long, component_id long, kept boolean"
#: Into how many parts the rows of a bucket are spread.
SALTS = 8


def _sketched(k: int, bands: int, rows: int):
    bins = 1 << (bands * rows - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in pieces(batches, "text", 2 << 20):
            sets = shingles(words(batch.column("text")), k)
            text = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            sketch = one_permutation(np.concatenate(sets), text, len(sets), bins)[:, : bands * rows].reshape(len(sets), bands, rows)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(sets), bands))
            for i in range(rows):
                key = mix(key * np.uint64(MULTIPLIER) + sketch[:, :, i])
            n = np.array([len(s) for s in sets], dtype=np.int64)
            total = np.array([[np.add.reduce(mix(s + np.uint64(salt))) for salt in (1, 2)] for s in sets], dtype=np.uint64).view(np.int64)
            lists = pa.array([x if m else [] for x, m in zip(key.view(np.int64), n, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total[:, 0].copy()), pa.array(total[:, 1].copy()), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return run


def _confirmed(k: int, percent: int):
    """Pairs whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        held: dict[int, np.ndarray] = {}
        for batch in pieces(batches, "blob_a", 1 << 19):
            ids = [batch.column(c).to_pylist() for c in ("a", "b")]
            new = {}
            for side, column in zip(ids, ("blob_a", "blob_b"), strict=True):
                for i, x in enumerate(side):
                    if x not in held and x not in new:
                        new[x] = batch.column(column)[i].as_py()
            if len(held) > 20_000:
                held.clear()
                new = {x: batch.column(c)[i].as_py() for side, c in zip(ids, ("blob_a", "blob_b"), strict=True) for i, x in enumerate(side)}
            if new:
                held.update(zip(new, shingles(words(pa.array([decompress(t) for t in new.values()], pa.binary())), k), strict=True))
            good = []
            for a, b in zip(*ids, strict=True):
                x, y = held[a], held[b]
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    c = zstandard.ZstdCompressor(level=1)
    for batch in pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())], ["rep", "blob"])


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of (a, b) links reaches, by alternating stars."""
    edges = written(fewer(links.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m"))).toDF("u", "n")
        least = both.groupBy("u").agg(F.least(F.min("n"), F.col("u")).alias("least"))
        large = both.where("n > u").join(least, "u").select(F.col("n").alias("v"), F.col("least").alias("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("least"))
        joined = large.join(low, "v")
        star = joined.where("m != least").select(F.col("m").alias("v"), F.col("least").alias("m")).unionByName(low.select("v", F.col("least").alias("m")))
        before, edges = edges, written(fewer(star.where("v != m").distinct()), "edges")
        drop_written(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("v").alias("id"), F.col("m").alias("component")).unionByName(edges.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())


def _salted(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows joined with the rows of their bucket (few a bucket), which are repeated for each salt."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(buckets.withColumn("salt", salt), ["bucket", "salt"]).drop("salt")


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels joined by new (a, b) links: the least label that each reaches."""
    ends = links.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").where("la != lb")
    top = components(ends.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    return label.join(top.toDF("label", "top"), "label", "left").select("rep", F.coalesce("top", "label").alias("label"))


def near_labels(docs: DataFrame, k: int = 5, percent: int = 85, bands: int = 42, rows: int = 6, growth: int = 4) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, rep) of all documents with an id, and (rep, label): the least representative of its component.

    Representatives without a label share no bucket with another one.
    """
    docs = documents(docs).where("doc_id is not null")
    sets = written(docs.mapInArrow(_sketched(k, bands, rows), _SETS), "sketches")
    full = sets.where("n_shingles > 0")
    classes = written(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    member = sets.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left")
    member = written(member.groupBy("doc_id").agg(F.max_by(F.struct("n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "n_shingles").alias("x")).select("doc_id", "x.n_shingles", "x.rep"), "members")
    others = member.where("doc_id != rep").select("doc_id")
    keys = full.join(others, "doc_id", "left_anti").select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("bands").alias("bucket"))
    shared = written(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared-buckets")
    live = written(_salted(keys, shared).select("bucket", "rep", "n_shingles", F.col("n_shingles").alias("n_shared")), "buckets")
    label = written(live.select("rep").distinct().select("rep", F.col("rep").alias("label")), "labels")
    drop_written(sets, classes, shared)
    blobs = written(docs.mapInArrow(_compressed, "rep long, blob binary").join(label, "rep", "left_semi"), "blobs")
    tested: list[DataFrame] = []
    centers, number = 1, 0
    while live.limit(1).count():
        now = live.join(label, "rep").select("bucket", "rep", "n_shingles", "n_shared", "label")
        chance = F.xxhash64(F.lit(number), "rep")
        center = now.groupBy("bucket", F.pmod(F.xxhash64("rep", F.lit(number)), F.lit(centers)).alias("slot")).agg(F.min(F.struct(chance.alias("chance"), F.col("rep").alias("c"), F.col("n_shingles").alias("cn"), F.col("n_shared").alias("cs"), F.col("label").alias("cl"))).alias("x"))
        center = written(fewer(center.select("bucket", "x.c", "x.cn", "x.cs", "x.cl")), "centers")
        most = F.least("n_shared", "cs")  # no larger intersection is possible
        alike = (F.col("label") != F.col("cl")) & (100 * most >= percent * (F.col("n_shingles") + F.col("cn") - most))
        pairs = _salted(now, center).where(alike).select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
        for before in tested:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        both = pairs.join(blobs.toDF("a", "blob_a"), "a").join(blobs.toDF("b", "blob_b"), "b").select("a", "b", "blob_a", "blob_b")
        found = written(both.mapInArrow(_confirmed(k, percent), "a long, b long"), "links")
        tested.append(pairs)
        old = [live, center, found]
        rest = live.join(center.select("bucket", F.col("c").alias("rep")), ["bucket", "rep"], "left_anti")
        if found.limit(1).count():
            old.append(label)
            label = written(_relabelled(label, found), "labels")
        open_ = rest.join(label, "rep").groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("bucket")
        live = written(_salted(rest, open_).select(live.columns), "buckets")
        if number == 0:
            old.append(live)
            live = written(_rarest(live.select("rep").distinct(), blobs, k, percent), "buckets")
        else:
            centers *= growth
        drop_written(*old)
        number += 1
    drop_written(blobs, *tested)
    return member, label


def without_copies(docs: DataFrame, within: str, k: int = 5, percent: int = 85, bands: int = 42, rows: int = 6) -> DataFrame:
    """(doc_id) of a table of bounded size without near copies that have the same ``within``, in a few jobs.

    One document of each class of equal sets goes on, and one round of stars finds its links.  A document with a
    confirmed link to one of lesser hash goes.  So each group keeps one document at least; it may keep more, where no
    star meets two of them.  Empty texts are one class.  Rows with equal ``doc_id`` count as one of the larger set.
    """
    named = docs.where("doc_id is not null")
    sets = documents(named).mapInArrow(_sketched(k, bands, rows), _SETS)
    sets = sets.groupBy("doc_id").agg(F.max_by(F.struct("n_shingles", "s1", "s2", "bands"), F.struct("n_shingles", "s1", "s2")).alias("x")).select("doc_id", "x.*")
    sets = sets.join(named.groupBy("doc_id").agg(F.min(within).alias("within")), "doc_id")
    order = F.struct(F.xxhash64("doc_id"), F.col("doc_id"))
    first = written(sets.groupBy("within", "s1", "s2", "n_shingles").agg(F.min_by(F.struct("doc_id", "bands"), order).alias("x")).select("within", "n_shingles", "x.*"), "sample-sets")
    keys = first.where("n_shingles > 0").select("within", "doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    center = keys.groupBy("within", "bucket").agg(F.min_by(F.struct(F.col("doc_id").alias("a"), F.col("n_shingles").alias("an")), order).alias("x"), F.count("*").alias("n")).where("n > 1").select("within", "bucket", "x.*")
    alike = 100 * F.least("n_shingles", "an") >= percent * F.greatest("n_shingles", "an")
    pairs = written(keys.join(center, ["within", "bucket"]).where((F.col("doc_id") != F.col("a")) & alike).select("a", F.col("doc_id").alias("b")).distinct(), "sample-pairs")
    blobs = documents(named).mapInArrow(_compressed, "rep long, blob binary")
    both = pairs.join(blobs.toDF("a", "blob_a"), "a").join(blobs.toDF("b", "blob_b"), "b").select("a", "b", "blob_a", "blob_b")
    gone = both.mapInArrow(_confirmed(k, percent), "a long, b long").select(F.col("b").alias("doc_id"))
    kept = written(first.select("doc_id").join(gone, "doc_id", "left_anti"), "sample-kept")
    drop_written(first, pairs)
    return kept


def _rarest(reps: DataFrame, blobs: DataFrame, k: int, percent: int) -> DataFrame:
    """(bucket, rep, n_shingles, n_shared): each set's rarest shingles, enough of them for linked sets to share one.

    ``n_shared`` is what two sets may have in common if this shingle is the first, in the order of
    rarity, that they share: the shingles from it on.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        for batch in pieces(batches, "blob", 1 << 19):
            found = shingles(words(pa.array([decompress(b) for b in batch.column("blob").to_pylist()], pa.binary())), k)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["rep", "shingles"])

    rows = written(blobs.join(reps, "rep", "left_semi").select("rep", "blob").mapInArrow(sets, "rep long, shingles array<long>"), "shingles")
    rows = rows.select("rep", F.size("shingles").cast("long").alias("n_shingles"), F.explode("shingles").alias("bucket"))
    often = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    own = _salted(rows, written(fewer(often), "often")).groupBy("rep", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n", "bucket"))).alias("shared"))
    # Shingles that occur once come first in the order; they are no buckets but use up places.
    places = F.expr(f"cast(n_shingles - (n_shingles * {percent} + 99) div 100 + 1 - (n_shingles - size(shared)) as int)")
    each = own.select("rep", "n_shingles", F.size("shared").cast("long").alias("all"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(places, F.lit(0)))).alias("before", "s"))
    return each.select("s.bucket", "rep", "n_shingles", (F.col("all") - F.col("before")).alias("n_shared"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 85, bands: int = 42, rows: int = 6) -> DataFrame:
    """RESULT rows: ``component_id`` is the least ``doc_id`` that a document reaches over links."""
    member, label = near_labels(docs, k, percent, bands, rows)
    joined = member.join(label, "rep", "left")
    component = F.coalesce("label", "rep")
    named = joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    nameless = documents(docs).where("doc_id is null").mapInArrow(_sketched(k, bands, rows), _SETS)
    return named.unionByName(nameless.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, bands: int = 42, rows: int = 6) -> DataFrame:
    """The documents that are the least ``doc_id`` of their group, all columns as they were.

    A document without an id is in no group and stays; so do all rows of a kept ``doc_id``.
    """
    named = docs.where("doc_id is not null")
    kept = near_groups(named, k, percent, bands, rows).where("kept").select("doc_id")
    return named.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
