"""Hard negatives, with exact inner products by Four-Russians tables.

Components become whole numbers, ``floor(scale * x)``. For each anchor its positives are the best ``positives`` other rows
of its label; for each positive, its negatives are the best ``negatives`` rows of other labels whose score lies between
``low`` percent of the positive's score and that score. Best is the higher score, then the smaller id.

*Scoring.* A candidate's numbers, as two's complement, are packed into bit planes: for every bit and every group of eight
dimensions one byte. An anchor has, for every group, a table of the 256 sums of subsets of its eight numbers. The inner
product is the sum over planes of the tables' entries at the candidate's bytes, shifted by the plane's bit (the sign plane
counts negative): no multiplication, and exact in 64 bits.

*Scale.* Candidates are packed into blocks of at most ``block`` rows, a checkpointed table. The anchors, a stated set of
queries, are grouped into chunks of about ``chunk``. Every chunk meets every block in a grid of tasks: a band of at most
`BAND` blocks by a band of at most `BEAM` chunks, no row copied for a pair before it is met. A task reads its blocks one by one,
holds one beside its chunks, keeps each anchor's (or each positive's) best few over all its blocks and sends those only.
Scoring is done twice: first against rows of an anchor's own label, then, when its positives are known, against the rest.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no part; vectors of unequal
length are compared as if the shorter ended in zeros. A row without an id is no anchor, and comes after all ids. Rows that
share an id are rows of their own: each is another row to the others, and each that is an anchor has its own results.
Whole numbers beyond plus or minus 2**24 count as that bound. A positive of negative score has no negatives. An empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .codes import finite, whole_numbers
from .common import settle, small_batches, tidy

SCALE = 256
BOUND = 1 << 24
BLOCK, CHUNK = 4096, 256
#: Blocks, and chunks of anchors, that one task meets at most.
BAND, BEAM = 256, 16
#: Anchors scored at a time.
STRIP = 32
GROUP = 8


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Planes x groups x rows: the bytes of every bit of the numbers (rows x dimensions, a multiple of eight)."""
    n, dims = x.shape
    width = int(max(x.max(initial=0), -x.min(initial=0) - 1, 0)).bit_length() + 1
    out = np.empty((width, dims // GROUP, n), np.uint8)
    for b in range(width):
        bits = ((x >> b) & 1).astype(np.uint8).reshape(n, dims // GROUP, GROUP)
        out[b] = np.packbits(bits, axis=2, bitorder="little")[:, :, 0].T
    return out


def subset_sums(x: np.ndarray) -> np.ndarray:
    """Groups x 256 x rows: for every group of eight dimensions, the sums of all subsets of a row's numbers."""
    v = x.reshape(len(x), -1, GROUP).transpose(1, 2, 0)
    sums = np.zeros((v.shape[0], 1, v.shape[2]), x.dtype)
    for k in range(GROUP):
        sums = np.concatenate([sums, sums + v[:, k : k + 1]], axis=1)
    return sums


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Rows (of the planes) x anchors (of the tables): their inner products."""
    width, groups, n = planes.shape
    # No sum exceeds the largest one of a row's numbers at the planes' largest number: half as wide where that fits.
    reach = int(np.abs(tables).max(axis=1, initial=0).sum(axis=0).max(initial=0)) << width
    tables = tables.astype(np.int32 if reach < 1 << 30 else np.int64, copy=False)
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    for b in range(width - 1, -1, -1):  # from the sign plane down: double, and add the next plane
        plane = np.zeros_like(total)
        for g in range(min(groups, len(tables))):
            plane += tables[g].take(planes[b, g], axis=0)
        total = -plane if b == width - 1 else (total << 1) + plane
    return total


def padded(rows: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


BLOCKS = "ids array<long>, labels array<long>, planes binary, groups int, anchors array<int>, numbers array<array<int>>"


def packed(rows: DataFrame, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """A row for each block of ``rows`` (id, label, embedding, anchor): ids, labels, bit planes; the places of its anchors
    and their numbers."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        each: list[np.ndarray] = []
        for chunk in table["embedding"].chunks:
            flat = whole_numbers(chunk.flatten().to_numpy(zero_copy_only=False), scale, BOUND)
            offsets = np.asarray(chunk.offsets) - chunk.offsets[0].as_py()
            each += [flat[a:b] for a, b in zip(offsets, offsets[1:])]
        dims = -(-max(len(v) for v in each) // GROUP) * GROUP
        planes = bit_planes(padded(each, dims))
        at = np.flatnonzero(table["anchor"].to_numpy()).tolist()
        columns = [[table["id"].to_pylist()], [table["label"].to_pylist()], [planes.tobytes()], [dims // GROUP], [at], [[each[k].tolist() for k in at]]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, block - rows)
                held.append(take)
                rows, batch = rows + take.num_rows, batch.slice(take.num_rows)
                if rows == block:
                    yield close(held)
                    held, rows = [], 0
        if rows:
            yield close(held)

    return rows.mapInArrow(tidy(run), BLOCKS)


def numbered(blocks: DataFrame) -> DataFrame:
    """Settled blocks with ``block``, dense from 0: a rank among the numbers of blocks, of which there are few."""
    named = blocks.withColumn("_b", F.monotonically_increasing_id())
    ranks = named.select("_b").withColumn("block", F.row_number().over(Window.orderBy("_b")) - 1)
    return settle(named.join(ranks, "_b").drop("_b"))


class Block:
    """A block's arrays, in a task."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        ids = batch.column("ids")[i].values
        self.none = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        self.labels = np.asarray(batch.column("labels")[i].values)
        groups = batch.column("groups")[i].as_py()
        raw = np.frombuffer(batch.column("planes")[i].as_buffer(), np.uint8)
        self.planes = raw.reshape(-1, groups, len(self.labels)) if len(raw) else np.zeros((1, 1, len(self.labels)), np.uint8)
        self.number = batch.column("block")[i].as_py()

    def best_first(self, some: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Places ``some`` by falling score (``score[k]`` is that of ``some[k]``), rising id, null ids last."""
        return np.lexsort((self.ids[some], self.none[some], -score))

    def told(self, place: int, score: int) -> tuple[int, bool, int]:
        """What orders a row, first the best."""
        return -int(score), bool(self.none[place]), int(self.ids[place])


def _met(blocks: DataFrame, anchors: DataFrame, chunk: int, count: int) -> DataFrame:
    """A row for each block and each chunk of anchors (``anchors``, a list of structs): a grid of bands, without a copy of
    either side for every row of the other."""
    context = blocks.sparkSession.sparkContext
    chunks = max(1, -(-anchors.count() // chunk))
    beams = min(chunks, max(-(-chunks // BEAM), context.defaultParallelism))
    bands = min(count, max(-(-count // BAND), -(-2 * context.defaultParallelism // beams)))
    grouped = anchors.groupBy(F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("_chunk")).agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
    some = blocks.select("block", "ids", "labels", "planes", "groups").repartition(bands)
    return some.crossJoin(grouped.select("anchors").repartition(beams).hint("shuffle_replicate_nl"))


ROW = 1 << 20  # a row's number: its block's number times this, and its place in the block


def _own(blocks: DataFrame) -> DataFrame:
    """row, id, label, numbers of every anchor."""
    each = blocks.select("block", "ids", "labels", F.explode(F.arrays_zip("anchors", "numbers")).alias("a"))
    return each.select((F.col("block") * F.lit(ROW).cast("long") + F.col("a.anchors")).alias("row"), F.get("ids", F.col("a.anchors")).alias("id"), F.get("labels", F.col("a.anchors")).alias("label"), F.col("a.numbers").alias("numbers"))


def _strips(anchors: list[dict]) -> Iterator[tuple[list[dict], np.ndarray]]:
    for k in range(0, len(anchors), STRIP):
        strip = anchors[k : k + STRIP]
        dims = -(-max(1, *(len(a["numbers"]) for a in strip)) // GROUP) * GROUP
        yield strip, subset_sums(padded([np.array(a["numbers"], np.int64) for a in strip], dims))


def _positives(met: DataFrame, positives: int) -> DataFrame:
    """row, positive_id, positive_score: each task's best of an anchor's label, itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, by_label = Block(batch, i), {}
                for a in batch.column("anchors")[i].as_py():
                    by_label.setdefault(a["label"], []).append(a)
                for label, own in by_label.items():
                    alike = np.flatnonzero(block.labels == label)
                    planes = block.planes[:, :, alike]
                    for strip, tables in _strips(own) if len(alike) else ():
                        found = scores(tables, planes)
                        for k, a in enumerate(strip):
                            other = alike != a["row"] - block.number * ROW
                            some, s = alike[other], found[other, k]
                            if len(s) > positives:  # all that reach the last place, ties included
                                high = s >= np.partition(s, len(s) - positives)[len(s) - positives]
                                some, s = some[high], s[high]
                            _merge(best, a["row"], positives, [block.told(some[j], s[j]) for j in block.best_first(some, s)[:positives]])
        rows = [(row, None if none else id, -s) for row, held in best.items() for s, none, id in held]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["row", "positive_id", "positive_score"])

    return met.mapInArrow(tidy(run), "row long, positive_id long, positive_score long")


def _merge(best: dict, key: object, most: int, new: list[tuple]) -> None:
    """The first of what is held for a key and what is new (falling score, whether the id is null, id)."""
    if new:
        best[key] = sorted(best[key] + new)[:most] if key in best else new


def least_negative(positive: int, low: int) -> int:
    """The least whole number n with ``100 * n >= low * positive``."""
    return -(-low * positive // 100)


def _negatives(met: DataFrame, negatives: int, low: int) -> DataFrame:
    """row, place (of the positive), negative_id, negative_score: each task's best of other labels between the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple]] = {}

        def bounds_of(a: dict) -> list[tuple[int, int]]:
            """Least and most of each place; where it is full, nothing below its last is looked for."""
            bounds = []
            for place, p in enumerate(a["positives"]):
                held = best.get((a["row"], place), ())
                bounds.append((-held[-1][0] if len(held) == negatives else least_negative(p, low), p))
            return bounds

        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                for strip, tables in _strips(batch.column("anchors")[i].as_py()):
                    found = np.ascontiguousarray(scores(tables, block.planes).T)
                    for a, s in zip(strip, found, strict=True):
                        bounds = bounds_of(a)
                        some = np.flatnonzero((s >= min(b[0] for b in bounds)) & (s <= max(b[1] for b in bounds)) & (block.labels != a["label"]))
                        if not len(some):
                            continue
                        some = some[block.best_first(some, s[some])]
                        falling = -s[some]
                        for place, (least, most) in enumerate(bounds):
                            begin, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                            _merge(best, (a["row"], place), negatives, [block.told(k, s[k]) for k in some[begin : min(end, begin + negatives)]])
        rows = [(row, place, None if none else id, -s) for (row, place), held in best.items() for s, none, id in held]
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["row", "place", "negative_id", "negative_score"])

    return met.mapInArrow(tidy(run), "row long, place int, negative_id long, negative_score long")


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``rows`` (vec_id, label, embedding).

    ``anchor`` tells of a row whether it is an anchor."""
    spark = rows.sparkSession
    small_batches(spark)  # a row of the grid holds a block and a chunk
    taken = rows.filter(F.col("label").isNotNull() & finite("embedding"))
    narrow = taken.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding", F.coalesce(anchor & F.col("vec_id").isNotNull(), F.lit(False)).alias("anchor"))
    blocks = numbered(settle(packed(narrow, scale, block)))
    count = blocks.count()
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    own = _own(blocks)
    best = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    ranked = settle(_positives(_met(blocks, own, chunk, count), positives).withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < positives))
    # A positive of negative score has bounds that nothing meets; those of an anchor stand last.
    sought = ranked.filter("positive_score >= 0").groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    found = _negatives(_met(blocks, own.join(sought, "row"), chunk, count), negatives, low)
    hardest = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    kept = found.withColumn("rank", F.row_number().over(hardest)).filter(F.col("rank") <= negatives)
    return kept.join(ranked, ["row", "place"]).join(own.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
