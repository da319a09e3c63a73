"""Vector codes: parts of vectors coded by codebooks, with distances from per-dimension value dictionaries.

A vector's components become whole numbers, ``floor(scale * x)``, and the vector is cut into ``parts`` equal consecutive
parts. Each part position has a codebook of ``entries`` entries, which starts as that part of the vectors with the
smallest ids; each of ``rounds`` rounds assigns every part to its nearest entry (squared distance, ties to the lower
index) and moves every entry to the floor of the mean of its parts. An entry without parts stays.

*Dictionaries.* Vectors are packed once into blocks of at most `BLOCK`. A block holds, for every dimension, the sorted
distinct whole numbers that occur in it, and for every component its place among them (two bytes). A round tabulates, for
every dimension, the squared differences of every distinct number to all entries; the distances of a part are then
gathered from those tables by the components' places and added up. No difference is computed twice for equal numbers, and
no dictionary grows with the corpus: it is bounded by its block.

*Scale.* The blocks are a checkpointed table, written once; a round is one pass over it that sends, from each task, one
sum for each component of each entry (1,152 numbers with 64 dimensions), and only their totals reach the driver. A lost
executor costs a pass over its blocks.

Defined cases: rows whose vector is null or has a null or non-finite component are dropped; so are vectors of another
length than most (the most frequent length that ``parts`` divides; of equally frequent ones the greatest), which cannot be
cut alike, and if no length can be cut, a ValueError says so. With fewer rows than ``entries``, the codebooks have as many
entries as there are rows. Rows that share an id are ordered by their numbers, null ids come last; repeated rows are
coded alike, each for itself. Whole numbers beyond plus or minus 2**27 count as that bound, so that all sums are exact.
An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 16_384
BOUND = 1 << 27


def finite(vector: Column | str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    x = lambda c: c.cast("double")
    return F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf"))), F.lit(False))


def whole_numbers(flat: np.ndarray, scale: int, bound: int) -> np.ndarray:
    return np.clip(np.floor(flat.astype(np.float64) * scale), -bound, bound).astype(np.int64)


def dense(vectors: pa.Array, dims: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``: whole numbers."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def vector(self, code: str) -> np.ndarray:
        """The vector that a code stands for: the middle of what rounds down to its entries."""
        index = bytes.fromhex(code)
        return (np.concatenate([self.entries[p, k] for p, k in enumerate(index)]) + 0.5) / self.scale


def length_of(vectors: DataFrame, parts: int) -> int | None:
    """The most frequent length that ``parts`` divides; None if there is no vector at all."""
    counted = vectors.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("rows"))
    best = counted.agg(F.max(F.when((F.col("length") > 0) & (F.col("length") % parts == 0), F.struct("rows", "length")))["length"], F.sum("rows")).first()
    if best[0] is None and best[1]:
        raise ValueError(f"no vector can be cut into {parts} equal parts")
    return best[0]


def packed(vectors: DataFrame, dims: int, scale: int, block: int = BLOCK) -> DataFrame:
    """A row for each block of vectors: ``vec_id, label`` (lists), ``numbers`` (each dimension's distinct numbers, one
    after the other), ``upto`` (where each dimension's end), ``places`` (two bytes for each component, by dimension)."""
    kinds = dict(vectors.dtypes)

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        x = whole_numbers(dense(table["embedding"].combine_chunks(), dims), scale, BOUND)
        numbers, places = zip(*(np.unique(x[:, d], return_inverse=True) for d in range(dims)), strict=True)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        column = lambda c: one(pa.concat_arrays(table[c].chunks) if table[c].num_chunks else pa.array([], table.schema.field(c).type))
        return pa.RecordBatch.from_arrays(
            [column("vec_id"), column("label"), one(pa.array(np.concatenate(numbers))), one(pa.array(np.cumsum([len(v) for v in numbers]).astype(np.int32))), pa.array([np.stack(places).astype("<u2").tobytes()], pa.binary()), pa.array([n], pa.int32())],
            ["vec_id", "label", "numbers", "upto", "places", "n"],
        )

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

    return vectors.select("vec_id", "label", "embedding").mapInArrow(tidy(run), f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, numbers array<long>, upto array<int>, places binary, n int")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], np.ndarray, int]]:
    """Of every block in a batch: each dimension's numbers, the places by dimension, and the row in the batch."""
    for i in range(batch.num_rows):
        numbers = np.asarray(batch.column("numbers")[i].values)
        upto = np.asarray(batch.column("upto")[i].values)
        places = np.frombuffer(batch.column("places")[i].as_buffer(), "<u2").reshape(len(upto), -1)
        yield np.split(numbers, upto[:-1]), places, i


def assigned(numbers: list[np.ndarray], places: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every part (parts x vectors), and every vector's squared distance."""
    parts, entries, width = books.shape
    n = places.shape[1]
    nearest, error = np.empty((parts, n), np.int64), np.zeros(n, np.int64)
    for p in range(parts):
        distance = np.zeros((n, entries), np.int64)
        for j in range(width):
            table = (numbers[p * width + j][:, None] - books[p, :, j]) ** 2
            distance += table[places[p * width + j]]
        nearest[p] = distance.argmin(axis=1)
        error += distance[np.arange(n), nearest[p]]
    return nearest, error


def _totals(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Sums of the parts assigned to every entry, and in the last place their number."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for numbers, places, _ in _blocks(batch):
                nearest, _ = assigned(numbers, places, books)
                for p in range(parts):
                    total[p, :, width] += np.bincount(nearest[p], minlength=entries)
                    for j in range(width):
                        d = p * width + j
                        # How often each number is with each entry, then the numbers' sums: whole numbers throughout.
                        met = np.bincount(nearest[p] * len(numbers[d]) + places[d], minlength=entries * len(numbers[d])).reshape(entries, -1)
                        total[p, :, j] += met @ numbers[d]
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], ["slot", "total"])

    sums = blocks.mapInArrow(tidy(run), "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total"))
    out = np.zeros(books.size // width * (width + 1), np.int64)
    for slot, total in sums.collect():  # a number for each component of each entry
        out[slot] = total
    return out.reshape(parts, entries, width + 1)


def fit(blocks: DataFrame, first: np.ndarray, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after ``rounds`` rounds over the packed blocks, from the entries that they start with."""
    books = first
    for _ in range(rounds):
        total = _totals(blocks, books)
        count = total[:, :, -1:]
        books = np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)
    return Codebooks(books, scale)


def coded(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of every packed vector."""
    kinds = dict(blocks.dtypes)
    entries = books.entries
    inner = lambda c: kinds[c][len("array<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, places, i in _blocks(batch):
                nearest, error = assigned(numbers, places, entries)
                digits = nearest.T.astype(np.uint8).tobytes().hex()
                step = 2 * len(nearest)
                codes = [digits[k : k + step] for k in range(0, len(digits), step)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[i].values, batch.column("label")[i].values, pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.select("vec_id", "label", "numbers", "upto", "places").mapInArrow(tidy(run), f"vec_id {inner('vec_id')}, label {inner('label')}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all vectors (vec_id, label, code, error) of ``vectors`` (vec_id, label, embedding), and the codebooks.

    ``entries`` is at most 256, two hex digits of a code."""
    good = vectors.select("vec_id", "label", "embedding").filter(finite("embedding"))
    dims = length_of(good, parts)
    if dims is None:
        kinds = dict(good.dtypes)
        return good.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), None
    good = good.filter(F.size("embedding") == dims)
    numbers = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(BOUND))), F.lit(float(BOUND)))))
    smallest = good.select("vec_id", numbers.alias("numbers")).orderBy(F.asc_nulls_last("vec_id"), "numbers").limit(entries).collect()
    first = np.array([r["numbers"] for r in smallest], np.int64).reshape(len(smallest), parts, dims // parts).transpose(1, 0, 2)
    blocks = settle(packed(good, dims, scale, block))
    books = fit(blocks, np.ascontiguousarray(first), rounds, scale)
    return coded(blocks, books), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``: the errors summed over equal labels, nulls together."""
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
