"""Encoding into and decoding from pieces; giant documents by a max-plus parallel scan.

A text's encoding is the segmentation into pieces whose scores have the greatest sum (the Viterbi path). Read as
matrices over (max, +), the path's score over any stretch of text is a *transfer matrix* between boundary states: the
state at a cut is by how many characters the piece that crosses it reaches beyond it. Matrices of neighbouring
stretches combine by an associative product, so a giant document need not be walked in order:

1. split it into chunks, each with the few characters of look-ahead a crossing piece may need;
2. compute each chunk's transfer matrix, in parallel (`transfer`);
3. combine a document's matrices, block by block, into the best score of each state at every cut (`prefixes`);
4. walk each chunk once more from those scores, in parallel: which entry state leads to which exit state (`entries`);
5. follow those small tables from a document's end to its beginning (`choose_states`);
6. backtrace each chunk to its exit state, in parallel (`backtrace`).

Of equally good segmentations the one counts that has the longest last piece, then the longest before it, and so on. Steps
3 to 6 keep to that rule as one walk over the whole text does, so ids do not depend on where chunks end or whether a text
is cut into chunks at all.

Everywhere, a text is first cut where no piece has the two neighbouring characters side by side, since no piece spans such
a place: the best path is that of the parts, one after another. Parts are mostly words, which recur; new ones are walked
many at a time (`Encoder.walk`), as arrays. Within a chunk, everything between the first and last such place is encoded
once for all states, so the matrix is an outer sum; only a chunk without such a place needs one pass for each entry state.
Ordinary documents are a single chunk and are encoded where they are read.

The round trip is exact for every text: a space is put before the text (a word piece begins with one) and taken away on
decoding, characters without a piece are spelled in bytes, and nothing is normalised.

Defined cases: null text: null ids, 0 tokens; empty text: one token, the leading space; repeated rows are encoded alike;
very long texts take the chunked path and get the ids that one walk would give; other columns are kept out of the way by
name.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, settle, small_batches, tidy
from .pieces import BYTE_SCORE, DEFAULT_MODEL, NEVER, PieceTable, Vocabulary, load

CHUNK = 8192
#: Chunk matrices combined in one step; a document's blocks of chunks are combined in a second.
BLOCK = 256


class Encoder:
    """Encodes texts and chunks of texts; parts seen before are remembered."""

    #: Parts up to this long are walked many at a time; pairs of characters are looked up in a table of 2 ** BITS places.
    TOGETHER, BITS = 48, 22

    def __init__(self, vocabulary: Vocabulary, remember: int = 60_000):
        self.v, self.remember = vocabulary, remember
        self.pieces = PieceTable(vocabulary.ids)
        self.scores = np.array([*vocabulary.scores, NEVER], np.int64)
        pairs = np.array(sorted(vocabulary.pairs), "<U2").view(np.uint32).reshape(-1, 2)
        self.side_by_side = np.zeros(1 << self.BITS, bool)
        self.side_by_side[self._pair(pairs[:, 0], pairs[:, 1])] = True
        self.known: dict[str, int] = {}  # remembered parts, by number
        # Ids of all remembered parts, one part after another; where each begins, its length and its score.
        self.flat, self.begin, self.size, self.sums = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        first = vocabulary.first_byte
        spelled = [bytes([k - first]) if first <= k < first + 256 else s.encode("utf-8", "surrogatepass") for k, s in enumerate(vocabulary.surfaces)]
        self.letters, self.width = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled])
        self.where = np.cumsum(self.width) - self.width

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(32 - self.BITS)

    def places(self, text: str) -> np.ndarray:
        """Places within a text that no piece spans. (Two pairs may share a place of the table: a cut less, never one too many.)"""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.flatnonzero(~self.side_by_side[self._pair(codes[:-1], codes[1:])]) + 1

    def path(self, steps: list[tuple[int, tuple[int, ...]]], start: int, end: int) -> tuple[int, ...]:
        parts = []
        while end > start:
            end, ids = steps[end]
            parts.append(ids)
        return tuple(k for ids in reversed(parts) for k in ids)

    def part(self, text: str) -> tuple[list[int], int]:
        """Ids and score of one part."""
        scores, steps = self._steps(text, 0, len(text))
        return list(self.path(steps, 0, len(text))), scores[-1]

    def walk(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (one part after another), numbers of ids and scores of parts of one length."""
        n, m = len(parts[0]), len(parts)
        codes = np.array(parts, f"<U{n}").view(np.uint32).reshape(m, n)
        size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        best, back, piece = np.full((n + 1, m), NEVER), np.zeros((n + 1, m), np.int64), np.full((n + 1, m), -1)
        best[0] = 0
        for i in range(n):
            hashes = self.pieces.seed(m)
            for j in range(i + 1, min(n, i + self.v.longest) + 1):
                hashes = self.pieces.extend(hashes, codes[:, j - 1])
                k = self.pieces.look_up(hashes)
                score = self.scores[k]
                if j == i + 1:
                    score = np.where(k < 0, BYTE_SCORE * size[:, i], score)
                elif (k < 0).all():
                    continue
                score = best[i] + score
                better = np.flatnonzero(score > best[j])
                best[j, better], back[j, better], piece[j, better] = score[better], i, k[better]
        ids, at, rows = np.full((m, n), -1, np.int32), np.full(m, n), np.arange(m)
        counts = np.zeros(m, np.int64)
        spelled = np.zeros(m, bool)
        while len(rows):  # backwards; ids fill each row from its end
            here = at[rows]
            k = piece[here, rows]
            counts[rows] += 1
            ids[rows, n - counts[rows]] = k
            spelled[rows[k < 0]] = True
            at[rows] = back[here, rows]
            rows = rows[at[rows] > 0]
        flat = ids[np.arange(n)[None, :] >= (n - counts)[:, None]]
        if spelled.any():  # few: a character that has no piece of its own
            pieces = np.split(flat, np.cumsum(counts)[:-1])
            for r in np.flatnonzero(spelled):
                pieces[r] = np.array(self.part(parts[r])[0], np.int32)
            flat, counts = np.concatenate(pieces), np.array([len(x) for x in pieces])
        return flat, counts, best[n]

    def _learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, numbers of ids and scores of new parts, in their order."""
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(fresh):
            by_length.setdefault(len(p), []).append(i)
        order, flats, counts, sums = [], [], [], []
        for n, places in by_length.items():
            step = 4096 if n <= self.TOGETHER else 1
            for k in range(0, len(places), step):
                some = places[k : k + step]
                if n <= self.TOGETHER:
                    flat, count, total = self.walk([fresh[i] for i in some])
                else:
                    ids, score = self.part(fresh[some[0]])
                    flat, count, total = np.array(ids, np.int32), np.array([len(ids)]), np.array([score])
                order += some
                flats.append(flat)
                counts.append(count)
                sums.append(total)
        if not order:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        flat, count, total, at = np.concatenate(flats), np.concatenate(counts), np.concatenate(sums), np.argsort(order)
        begin = np.cumsum(count) - count
        return self._gather(flat, begin[at], count[at]), count[at], total[at]

    @staticmethod
    def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Stretches of an array, one after another."""
        ends = np.cumsum(size)
        return flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (one text after another), numbers of ids and scores of texts that begin and end where no piece spans."""
        lengths = np.array([len(t) for t in texts], np.int64)
        joined, ends = "".join(texts), np.cumsum(lengths)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        mask = np.zeros(len(joined) + 1, bool)
        mask[self.places(joined)] = mask[0] = True
        mask[ends] = True
        cuts = np.flatnonzero(mask)
        bounds = cuts.tolist()
        parts = [joined[i:j] for i, j in itertools.pairwise(bounds)]
        known = self.known.get
        own = np.array([known(p, -1) for p in parts])
        new = np.flatnonzero(own < 0).tolist()
        fresh = {p: k for k, p in enumerate(dict.fromkeys([parts[i] for i in new]), len(self.begin))}
        flat, size, sums = self._learn(list(fresh))
        begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        flat, size, sums = np.concatenate([self.flat, flat]), np.concatenate([self.size, size]), np.concatenate([self.sums, sums])
        own[new] = [fresh[parts[i]] for i in new]
        keep = min(len(fresh), self.remember - len(self.known))
        if keep > 0:  # frequent parts come early
            self.known |= dict(itertools.islice(fresh.items(), keep))
            n = len(self.begin) + keep
            self.begin, self.size, self.sums = begin[:n], size[:n], sums[:n]
            self.flat = flat[: self.begin[-1] + self.size[-1]]
        of_text = np.searchsorted(ends, cuts[:-1], "right")
        return self._gather(flat, begin[own], size[own]), np.bincount(of_text, size[own], len(texts)).astype(np.int64), self._sums(of_text, sums[own], len(texts))

    @staticmethod
    def _sums(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        np.add.at(out, places, values)
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts, _ = self.stretches([" " + t for t in texts])
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decoded(self, ids: np.ndarray) -> bytes:
        """Bytes of the text."""
        return self._gather(self.letters, self.where[ids], self.width[ids])[1:].tobytes()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.decoded(np.asarray(ids, np.int64)).decode("utf-8", "surrogatepass")

    # Chunks. ``text`` is the chunk and its look-ahead, ``size`` the chunk's own length.

    def cuts(self, text: str, size: int) -> tuple[int, int]:
        """First and last place, from 1 to size, that no piece spans; 0, 0 if there is none."""
        places = self.places(text[: size + 1])
        return (int(places[0]), int(places[-1])) if len(places) else (0, 0)

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Best scores from each entry state to each exit state; a state counts characters beyond the cut."""
        n = self.v.longest
        out = np.full((n, n), NEVER, np.int64)
        reach = range(min(n, len(text) - size + 1))
        first, last = self.cuts(text, size)
        if not first:
            for a in range(min(n, len(text) + 1)):
                if a >= size:
                    if a - size < n:
                        out[a, a - size] = 0
                    continue
                scores = self._ending(text, a, size)
                for b in reach:
                    out[a, b] = scores[size + b]
            return out
        middle = int(self.stretches([text[first:last]])[2][0])
        tail = self._ending(text, last, size) if last < size else [0 if i == size else NEVER for i in range(len(text) + 1)]
        for a in range(min(n, first + 1)):
            head = self._ending(text[:first], a, first)[first] if a < first else 0
            for b in reach:
                if head > NEVER and tail[size + b] > NEVER:
                    out[a, b] = head + middle + tail[size + b]
        return out

    def _ending(self, text: str, start: int, size: int) -> list[int]:
        """Scores of paths from ``start`` whose last piece begins before ``size``."""
        return self._steps(text, start, size)[0]

    def _steps(self, text: str, start: int, size: int) -> tuple[list[int], list[tuple[int, tuple[int, ...]] | None]]:
        return self._onward(text, {start: 0}, start, size)

    def _onward(self, text: str, sources: dict[int, int], start: int, size: int) -> tuple[list[int], list[tuple[int, tuple[int, ...]] | None]]:
        """Best scores at all places, and the last step to each, of paths that begin at any of the sources with its score
        and whose pieces begin before ``size``. Of equally good steps the longest counts: the one that begins first. A
        source that nothing betters has no step."""
        scores: list[int] = [NEVER] * (len(text) + 1)
        steps: list[tuple[int, tuple[int, ...]] | None] = [None] * (len(text) + 1)
        for place, score in sources.items():
            if place <= len(text):
                scores[place] = score
        for i in range(start, min(size, len(text))):
            if scores[i] > NEVER:
                for j, ids, s in self.v.edges(text, i):
                    if scores[i] + s > scores[j]:
                        scores[j], steps[j] = scores[i] + s, (i, ids)
        return scores, steps

    def _back(self, steps: list[tuple[int, tuple[int, ...]] | None], end: int) -> tuple[int, list[int]]:
        """The source that the path to ``end`` begins at, and its ids."""
        parts = []
        while steps[end] is not None:
            end, ids = steps[end]
            parts.append(ids)
        return end, [k for ids in reversed(parts) for k in ids]

    def _known(self, forward: np.ndarray) -> dict[int, int]:
        return {a: int(x) for a, x in enumerate(forward) if x > NEVER}

    def entries(self, text: str, size: int, forward: np.ndarray) -> bytes:
        """For every exit state, the entry state of the best path to it; ``forward`` has the best score of each entry state."""
        first, _ = self.cuts(text, size)
        if first:  # all paths meet there
            return bytes([self._back(self._onward(text[:first], self._known(forward), 0, first)[1], first)[0]] * len(forward))
        scores, steps = self._onward(text, self._known(forward), 0, size)
        return bytes(self._back(steps, size + b)[0] if size + b < len(scores) and scores[size + b] > NEVER else 0 for b in range(len(forward)))

    def backtrace(self, text: str, size: int, forward: np.ndarray, exit_: int) -> list[int]:
        """Ids of the pieces that begin in the chunk, on the best path to an exit state."""
        first, last = self.cuts(text, size)
        if not first:
            return self._back(self._onward(text, self._known(forward), 0, size)[1], size + exit_)[1]
        out = self._back(self._onward(text[:first], self._known(forward), 0, first)[1], first)[1]
        out += self.stretches([text[first:last]])[0].tolist()
        return out + list(self.path(self._steps(text, last, size)[1], last, size + exit_))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product over (max, +); associative."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def prefixes(matrices: list[np.ndarray], forward: np.ndarray) -> list[np.ndarray]:
    """Best score of each state at the beginning of every one of consecutive chunks, from those at the first."""
    out = [forward]
    for m in matrices[:-1]:
        out.append(np.maximum((out[-1][:, None] + m).max(axis=0), NEVER))
    return out


def choose_states(entries: list[bytes]) -> list[int]:
    """Exit states of consecutive chunks, of which the last ends the text: each is the entry state that the next chunk's
    best path has."""
    exits = [0]
    for table in reversed(entries[1:]):
        exits.append(table[exits[-1]])
    return exits[::-1]


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder a worker process and vocabulary, so that what it remembers serves later batches."""
    return kept((Encoder, len(vocabulary.surfaces), sum(vocabulary.scores)), lambda: Encoder(vocabulary))


def _map(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(tidy(run), schema)


def encode(docs: DataFrame, key: str = "doc_id", model: str = DEFAULT_MODEL, digest: bool = False, giant: int = 8 * CHUNK) -> DataFrame:
    """``key, ids`` (array of int) of every document; with ``digest`` ``key, n_tokens, ids_crc32, round_trip`` instead.

    ``key`` should be unique: chunks of giant documents (over ``giant`` characters) meet by it. Rows with equal keys
    are told apart by their text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load(model))
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("key"), "text")
    out = f"key {kind}, " + ("n_tokens long, ids_crc32 long, round_trip boolean" if digest else "ids array<int>")

    def answer(e: Encoder, ids: np.ndarray | None, text: str | None) -> tuple:
        if not digest:
            return (ids,)
        if ids is None:
            return 0, None, None
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), e.decoded(ids) == text.encode("utf-8", "surrogatepass")

    names = ["n_tokens", "ids_crc32", "round_trip"] if digest else ["ids"]

    def small(batch: pd.DataFrame) -> pd.DataFrame:
        e = encoder(shared.value)
        texts = [t for t in batch["text"] if t is not None]
        ids = iter(e.encode_all(texts))
        found = [answer(e, None if t is None else next(ids), t) for t in batch["text"]]
        frame = {n: pd.Series([f[i] for f in found], dtype=object) for i, n in enumerate(names)}
        return pd.DataFrame({"key": batch["key"]} | frame)

    is_giant = F.coalesce(F.length("text") > giant, F.lit(False))
    done = _map(narrow.filter(~is_giant), small, out)

    # Giant documents: a row for each chunk, told apart by key and a hash of the text.
    reach = shared.value.longest
    giants = narrow.filter(is_giant).withColumn("text_hash", F.sha2("text", 256)).withColumn("text", F.concat(F.lit(" "), "text"))
    counted = giants.groupBy("key", "text_hash").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    where = f"key {kind}, text_hash string, chunk int"

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key_, digest_, copies, text in zip(batch["key"], batch["text_hash"], batch["copies"], batch["text"], strict=True):
                starts = range(0, len(text), CHUNK)
                for some in (starts[k : k + BLOCK] for k in range(0, len(starts), BLOCK)):
                    parts = [text[i : i + CHUNK + reach] for i in some]
                    yield pd.DataFrame({"chunk": [i // CHUNK for i in some], "copies": copies, "text": parts, "size": [min(CHUNK, len(text) - i) for i in some]}).assign(key=pd.Series([key_] * len(some), dtype=batch["key"].dtype), text_hash=digest_)[["key", "text_hash", "chunk", "copies", "text", "size"]]

    # Met three times below: cut once, and read again from the shared folder.
    chunks = settle(counted.mapInPandas(tidy(split), where + ", copies long, text string, size int"))

    def matrices(batch: pd.DataFrame) -> pd.DataFrame:
        e = encoder(shared.value)
        rows = [e.transfer(t, s).tobytes() for t, s in zip(batch["text"], batch["size"], strict=True)]
        return batch[["key", "text_hash", "chunk"]].assign(block=batch["chunk"] // BLOCK, matrix=rows)

    def shape(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.int64).reshape(reach, reach)

    def in_order(frame: pd.DataFrame, by: str) -> pd.DataFrame:
        return frame.sort_values(by)

    # The chunk rows (a chunk and a matrix each) are shuffled by document and block: BLOCK matrices in a group at most.
    made = _map(chunks.select("key", "text_hash", "chunk", "text", "size"), matrices, where + ", block int, matrix binary")

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for raw in in_order(group, "chunk")["matrix"]:
            total = shape(raw) if total is None else product(total, shape(raw))
        return group.head(1)[["key", "text_hash", "block"]].assign(matrix=[total.tobytes()])

    blocks = made.groupBy("key", "text_hash", "block").applyInPandas(combine, f"key {kind}, text_hash string, block int, matrix binary")

    def between_blocks(group: pd.DataFrame) -> pd.DataFrame:
        group = in_order(group, "block")
        begin = np.where(np.arange(reach) == 0, 0, NEVER)
        return group[["key", "text_hash", "block"]].assign(forward=[x.tobytes() for x in prefixes([shape(raw) for raw in group["matrix"]], begin)])

    edges = blocks.groupBy("key", "text_hash").applyInPandas(between_blocks, f"key {kind}, text_hash string, block int, forward binary")

    def within_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = in_order(left, "chunk")
        begin = np.frombuffer(right["forward"].iloc[0], np.int64)
        return left[["key", "text_hash", "chunk"]].assign(forward=[x.tobytes() for x in prefixes([shape(raw) for raw in left["matrix"]], begin)])

    by = ("key", "text_hash", "block")
    forward = made.groupBy(*by).cogroup(edges.groupBy(*by)).applyInPandas(within_block, where + ", forward binary")

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash")) & (F.col(f"{a}.chunk") == F.col(f"{b}.chunk"))

    known = chunks.alias("c").join(forward.alias("f"), same("c", "f")).select("c.key", "c.text_hash", "c.chunk", "c.text", "c.size", "c.copies", "f.forward")

    def enter(batch: pd.DataFrame) -> pd.DataFrame:
        e = encoder(shared.value)
        tables = [e.entries(t, s, np.frombuffer(f, np.int64)) for t, s, f in zip(batch["text"], batch["size"], batch["forward"], strict=True)]
        return batch[["key", "text_hash", "chunk"]].assign(entries=tables)

    def leave(group: pd.DataFrame) -> pd.DataFrame:
        group = in_order(group, "chunk")
        return group[["key", "text_hash", "chunk"]].assign(exit=choose_states(list(group["entries"])))

    # A table has a byte for each state, so a document's are far smaller than its text.
    tables = _map(known.select("key", "text_hash", "chunk", "text", "size", "forward"), enter, where + ", entries binary")
    exits = tables.groupBy("key", "text_hash").applyInPandas(leave, where + ", exit int")
    placed = known.alias("c").join(exits.alias("s"), same("c", "s")).select("c.key", "c.text_hash", "c.chunk", "c.text", "c.size", "c.copies", "c.forward", "s.exit")

    def trace(batch: pd.DataFrame) -> pd.DataFrame:
        e = encoder(shared.value)
        ids = [e.backtrace(t, s, np.frombuffer(f, np.int64), b) for t, s, f, b in zip(batch["text"], batch["size"], batch["forward"], batch["exit"], strict=True)]
        return batch[["key", "text_hash", "chunk", "copies"]].assign(text=[t[:s] for t, s in zip(batch["text"], batch["size"], strict=True)], ids=ids)

    traced = _map(placed, trace, where + ", copies long, text string, ids array<int>")

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = in_order(group, "chunk")
        ids = np.concatenate([np.asarray(part, np.int32) for part in group["ids"]])
        found = answer(encoder(shared.value), ids, "".join(group["text"])[1:])
        return group.head(1)[["key", "copies"]].assign(**{n: pd.Series([found[i]], dtype=object, index=group.index[:1]) for i, n in enumerate(names)})

    # A group here is one document, whose ids the result holds in one row in any case.
    big = traced.groupBy("key", "text_hash").applyInPandas(whole, out + ", copies long")
    big = big.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    return done.unionByName(big).withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", model: str = DEFAULT_MODEL) -> DataFrame:
    """``key, text`` from ``key, ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        e = encoder(shared.value)
        return batch[[key]].assign(text=[None if ids is None else e.decode(list(ids)) for ids in batch["ids"]])

    return _map(encoded.select(key, "ids"), run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")
