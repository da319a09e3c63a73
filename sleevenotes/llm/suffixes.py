"""Removing long repeated passages with a logarithmic family of suffix indexes.

A byte goes if it lies in a string of ``window`` (50) bytes that also starts in a document with a smaller id. Which
windows those are is decided by an index of suffixes that grows batch by batch, in order of document id: a batch's
suffixes are sorted into an array of their own, merge-scanned against all existing levels (a hit means that the string
occurs in an earlier document), and what is new becomes a level; levels of about equal size are merged, so their sizes
grow geometrically and there are few (`LevelIndex`). Only the first ``window`` bytes of a suffix matter, so arrays are
sorted by a 64-bit hash of them and not alphabetically.

*Sparse suffixes.* Indexing the suffix at every byte would move eight times the corpus. Each window has a minimizer, the
20-byte gram in it with the least hash. Neighbouring windows share it; a maximal run of windows with one minimizer
covers a *stretch* of 50 to 80 bytes, and equal stretches hold the same windows. So

1. stretches are indexed, one entry for some 16 windows, dealt out to ``buckets`` by their minimizer;
2. a stretch found in an earlier document is removed as a whole;
3. where stretches with the same minimizer differ (at the ends of repeats), their windows are indexed one by one by the
   same kind of index, in a second pass over those few.

Equal windows have equal minimizers, so both passes see every repeat.

*Shuffles.* Texts are grouped once, by a hash of the id; entries travel as packed arrays. A group of documents first
settles what repeats inside the group, and sends a string once, so a passage that a third of all documents share
reaches its bucket once from each group. Documents without open windows are finished in the first pass.

Defined cases: a null text is empty; texts shorter than the window, and repeats within one document (or between rows of
the same id), are left alone; a null id comes after all others; an empty table gives an empty result; very long texts
are indexed in segments (a stretch cut in two at a segment's end is settled window by window); other columns play no
part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shuffle_partitions, tidy

WINDOW, GRAM = 50, 20
SPAN = WINDOW - GRAM + 1
#: Bytes handled by numpy at once; text bytes aimed at for a group of documents and for a bucket; batches of the index.
BLOCK, GROUP_BYTES, BUCKET_BYTES, BATCHES = 1 << 20, 8 << 20, 32 << 20, 4
LAST = np.iinfo(np.int64).max
U = np.uint64
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def _stir(h: np.ndarray, x: np.ndarray, c: np.uint64) -> np.ndarray:
    h = (h ^ x) * c
    return h ^ (h >> U(29))


def _words(raw: bytes) -> np.ndarray:
    """The 64-bit number that starts at each byte."""
    padded = np.frombuffer(raw + bytes(64), np.uint8)
    return np.ndarray((len(raw) + 56,), "<u8", buffer=padded, strides=(1,)).astype(np.uint64)


def _window_hashes(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = v[at] * _C1
    for k, offset in enumerate((8, 16, 24, 32, 40, WINDOW - 8)):
        h = _stir(h, v[at + offset], (_C2, _C3, _C1)[k % 3])
    return h ^ (h >> U(32))


def stretches(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers at each byte; first and last window, minimizer hash and hash of every stretch) of texts joined in raw."""
    n = len(raw)
    v = _words(raw)
    none = np.empty(0, np.int64)
    if n < WINDOW:
        return v, none, none, none.view(U), none.view(U)
    g = n - GRAM + 1
    h = _stir(_stir(v[:g] * _C1, v[8 : 8 + g], _C2), v[GRAM - 8 : GRAM - 8 + g], _C3)
    h ^= h >> U(32)
    least = (h & U(0xFFFFFFFF00000000)) | np.arange(g, dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    windows = n - WINDOW + 1
    where = (np.minimum(least[:windows], least[SPAN - size : SPAN - size + windows]) & U(0xFFFFFFFF)).astype(np.int64)
    inside = np.arange(windows) + WINDOW <= np.repeat(ends, np.diff(ends, prepend=0))[:windows]
    turns = np.flatnonzero((where[1:] != where[:-1]) | (inside[1:] != inside[:-1])) + 1
    first, stop = np.concatenate([[0], turns]), np.concatenate([turns, [windows]])
    keep = inside[first]
    first, last = first[keep], stop[keep] - 1
    key = _stir(_stir(_window_hashes(v, first) * _C1, _window_hashes(v, last), _C2), (last - first).astype(np.uint64), _C3)
    return v, first, last, h[where[first]], key ^ (key >> U(32))


def segments(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int]], bytes, np.ndarray]]:
    """Blocks of texts: (row and offset of each segment, the bytes, the segments' ends). Long texts take several."""
    rows: list[tuple[int, int]] = []
    parts: list[bytes] = []
    size = 0
    for r, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), BLOCK):
            part = text[at : at + BLOCK + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            rows.append((r, at))
            parts.append(part)
            size += len(part)
            if size >= BLOCK:
                yield rows, b"".join(parts), np.cumsum([len(p) for p in parts])
                rows, parts, size = [], [], 0
    if parts:
        yield rows, b"".join(parts), np.cumsum([len(p) for p in parts])


class LevelIndex:
    """Sorted arrays of strings' hashes, each with the smallest id that has it; sizes grow geometrically."""

    def __init__(self) -> None:
        self.levels: list[dict[str, np.ndarray]] = []

    def add(self, batch: dict[str, np.ndarray]) -> np.ndarray:
        """Index a batch whose ids are not below those of earlier batches; mask of entries found in a smaller id.

        batch: ``key``, ``doc`` and what else is to be kept with an entry.
        """
        order = np.lexsort((batch["doc"], batch["key"]))
        key, doc = batch["key"][order], batch["doc"][order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        group = np.cumsum(fresh) - 1
        least = doc[fresh]
        for level in self.levels:  # merge-scan
            at = np.minimum(np.searchsorted(level["key"], key[fresh]), len(level["key"]) - 1)
            hit = level["key"][at] == key[fresh]
            least = np.where(hit, np.minimum(least, level["doc"][at]), least)
        found = np.empty(len(key), bool)
        found[order] = doc > least[group]
        new = order[fresh][doc[fresh] == least]
        known = np.zeros(len(new), bool)
        for level in self.levels:  # the same id may have come with the batch before
            at = np.minimum(np.searchsorted(level["key"], batch["key"][new]), len(level["key"]) - 1)
            known |= level["key"][at] == batch["key"][new]
        new = new[~known]
        if len(new):
            self.levels.append({name: column[new] for name, column in batch.items()})
        while len(self.levels) > 1 and 2 * len(self.levels[-1]["key"]) > len(self.levels[-2]["key"]):
            self._merge()
        return found

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        order = np.argsort(np.concatenate([a["key"], b["key"]]), kind="stable")
        self.levels.append({name: np.concatenate([a[name], b[name]])[order] for name in a})

    def whole(self) -> dict[str, np.ndarray] | None:
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else None


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(LAST).to_numpy()


def _raw(table: pa.Table) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]


ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _table(rows: list, schema: str) -> pa.Table:
    """Rows (tuples, or dicts that may lack columns) as a table."""
    names = _names(schema)
    get = (lambda r, i: r.get(names[i])) if rows and isinstance(rows[0], dict) else (lambda r, i: r[i])
    return pa.table({n: pa.array([get(r, i) for r in rows], ARROW[c.split()[1]]) for i, (n, c) in enumerate(zip(names, schema.split(", "), strict=True))})


def _keys(answers: pa.Table, kind: int | None = None) -> np.ndarray:
    """The keys of some answers, in order."""
    some = [np.frombuffer(r["keys"], np.uint64) for r in answers.to_pylist() if kind is None or r["kind"] == kind]
    return np.sort(np.concatenate(some)) if some else np.empty(0, np.uint64)


def _in(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether values are among some, a sorted array."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _windows_in(text: bytes, known: np.ndarray) -> np.ndarray:
    """Where the text's windows are among the known ones.

    A window that is found in a smaller id than the group's smallest is found in a smaller id for all of the group.
    """
    places = [np.empty(0, np.int64)]
    for at in range(0, len(text) - WINDOW + 1 if len(known) else 0, BLOCK):
        part = text[at : at + BLOCK + WINDOW - 1]
        places.append(at + np.flatnonzero(_in(_window_hashes(_words(part), np.arange(len(part) - WINDOW + 1)), known)))
    return np.concatenate(places)


def _least_by_key(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key's first entry of the smallest id, and that id for every entry."""
    order = np.lexsort((doc, key))
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.empty(0, bool)
    least = np.empty(len(key), np.int64)
    least[order] = doc[order][fresh][np.cumsum(fresh) - 1]
    return order[fresh], least


ENTRIES = "bucket int, batch int, g int, docs binary, counts binary, keys binary, marks binary"


def _packed(g: int, buckets: int, cuts: np.ndarray, bucket_of: np.ndarray, doc: np.ndarray, key: np.ndarray, mark: np.ndarray) -> list[tuple]:
    """Entries as rows by bucket and batch; ids are given once for a run of entries."""
    batch = np.searchsorted(cuts, doc, "left")
    order = np.lexsort((doc, batch, bucket_of))
    place = bucket_of[order].astype(np.int64) * (len(cuts) + 1) + batch[order]
    rows = []
    bounds = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else [0]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        o = order[lo:hi]
        docs, counts = np.unique(doc[o], return_counts=True)
        rows.append((int(bucket_of[o[0]]), int(batch[o[0]]), g, docs.tobytes(), counts.astype(np.uint32).tobytes(), key[o].tobytes(), mark[o].tobytes()))
    return rows


def _unpacked(rows: list[dict]) -> dict[str, np.ndarray]:
    docs = [np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32)) for r in rows]
    return {
        "key": np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows]),
        "doc": np.concatenate(docs),
        "mark": np.concatenate([np.frombuffer(r["marks"], np.uint32) for r in rows]),
        "g": np.concatenate([np.full(len(d), r["g"], np.int32) for d, r in zip(docs, rows, strict=True)]),
    }


HITS = "g int, kind int, keys binary"
FOUND, OPEN = 0, 1


def _answers(kind: int, g: np.ndarray, key: np.ndarray) -> list[tuple]:
    order = np.argsort(g, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1], [True]])) if len(g) else [0]
    return [(int(g[order[lo]]), kind, key[order[lo:hi]].tobytes()) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def _look_up(entries: DataFrame, partitions: int, open_too: bool) -> DataFrame:
    """Entries found in a smaller id, sent back to their groups; ``open_too``: also first entries whose mark others share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(HITS)
        types = [pa.int32(), pa.int32(), pa.binary()]
        index, at, held = LevelIndex(), None, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        def take() -> list[tuple]:
            if not held:
                return []
            batch = _unpacked(held)
            held.clear()
            found = index.add(batch)
            return _answers(FOUND, batch["g"][found], batch["key"][found])

        def close() -> list[tuple]:
            whole = index.whole()
            if not open_too or whole is None:
                return []
            marks, counts = np.unique(whole["mark"], return_counts=True)
            several = _in(whole["mark"], marks[counts > 1])
            return _answers(OPEN, whole["g"][several], whole["key"][several])

        for batch in batches:
            for row in batch.to_pylist():  # packed arrays: a row for each group and bucket
                here = (row["bucket"], row["batch"])
                if at is not None and here != at:
                    yield out(take())
                    if here[0] != at[0]:
                        yield out(close())
                        index = LevelIndex()
                at = here
                held.append(row)
        yield out(take())
        yield out(close())

    return entries.repartition(partitions, "bucket").sortWithinPartitions("bucket", "batch", "g").mapInArrow(tidy(run), HITS)


def _finish(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left) for spans of a text."""
    if not len(starts):
        return 0, 0, text
    edge = np.bincount(starts, minlength=len(text) + 1)[: len(text) + 1] - np.bincount(stops, minlength=len(text) + 1)[: len(text) + 1]
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, extra string"


def _result(doc: int, text: bytes, spans: list[np.ndarray], keep: bool, extra: str | None) -> tuple:
    starts, stops = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (spans[::2], spans[1::2]))
    removed, runs, left = _finish(text, starts, stops)
    return (None if doc == LAST else int(doc), len(text), removed, runs, hashlib.sha256(left).hexdigest(), left if keep else None, extra)


def remove_repeats(docs: DataFrame, keep: bool = False, carry: tuple[str, ...] = (), batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, if ``keep``; else null), and the columns to ``carry``."""
    spark = docs.sparkSession
    extra = F.to_json(F.struct(*carry)) if carry else F.lit(None).cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", extra.alias("extra"))
    facts = narrow.agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("doc_id", F.array(*[F.lit(i / batches) for i in range(1, batches)]), F.lit(1000)).alias("cuts")
    ).first()
    parts = shuffle_partitions(spark)
    # Packed rows number groups times buckets: both follow the input's bytes, so that rows stay worth their overhead.
    groups, buckets = ((facts["bytes"] or 0) // size + 1 for size in (GROUP_BYTES, BUCKET_BYTES))
    cuts = np.array(sorted(set(facts["cuts"] or [])), np.int64)
    grouped = narrow.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))

    def index(frame: pa.Table) -> pa.Table:
        g, doc, rows = frame.column("g")[0].as_py(), _ids(frame), []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for owners, raw, ends in segments(_raw(frame)):
            _, first, _, minimizer, key = stretches(raw, ends)
            owner = np.array([r for r, _ in owners])[np.searchsorted(ends, first, "right")]
            found.append((doc[owner], minimizer, key))
        if found:
            doc, minimizer, key = (np.concatenate(x) for x in zip(*found, strict=True))
            one, _ = _least_by_key(key, doc)
            mark = (minimizer[one] >> U(32)).astype(np.uint32)
            rows = _packed(g, buckets, cuts, (minimizer[one] % U(buckets)).astype(np.int64), doc[one], key[one], mark)
        return _table(rows, ENTRIES)

    # Settled, so that the entries' files are gone before the texts are grouped for the answers.
    hits = settle(_look_up(grouped.groupBy("g").applyInArrow(tidy(index), ENTRIES), parts, True))

    # Rows of four kinds: finished documents, entries of open windows, and documents with open windows.
    kinds = f"what int, {RESULT}, {ENTRIES}, spans binary"
    done, entry, pending = 0, 1, 2

    def first_pass(frame: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[dict] = []
        if not len(frame):
            return _table(out, kinds)
        g, doc, texts, extras = frame.column("g")[0].as_py(), _ids(frame), _raw(frame), frame.column("extra").to_pylist()
        known = [_keys(answers, kind) for kind in (FOUND, OPEN)]
        found = []
        for owners, raw, ends in segments(texts):
            v, first, last, minimizer, key = stretches(raw, ends)
            seg = np.searchsorted(ends, first, "right")
            base = np.array([at for _, at in owners]) - np.concatenate([[0], ends[:-1]])
            owner = np.array([r for r, _ in owners])[seg]
            open_ = np.flatnonzero(_in(key, known[OPEN]))
            count = last[open_] - first[open_] + 1
            at = np.repeat(first[open_], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append((owner, first + base[seg], last + base[seg] + WINDOW, key, np.repeat(open_, count), at + np.repeat(base[seg][open_], count), _window_hashes(v, at), np.repeat(minimizer[open_] % U(buckets), count).astype(np.int64)))
        spans: dict[int, list[np.ndarray]] = {}
        waiting_rows: set[int] = set()

        def cover(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
            order = np.argsort(owner, kind="stable")
            o = owner[order]
            bounds = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1], [True]])) if len(o) else [0]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                spans.setdefault(int(o[lo]), []).extend((start[order[lo:hi]], stop[order[lo:hi]]))

        if found:
            offset = np.cumsum([0] + [len(f[0]) for f in found])
            owner, start, stop, key = (np.concatenate([f[i] for f in found]) for i in range(4))
            within, place, window, bucket = (np.concatenate([f[i] + (offset[k] if i == 4 else 0) for k, f in enumerate(found)]) for i in range(4, 8))
            del found
            _, least = _least_by_key(key, doc[owner])
            covered = (doc[owner] > least) | _in(key, known[FOUND])
            cover(owner[covered], start[covered], stop[covered])
            still = ~covered[within]
            place, window, bucket, by = place[still], window[still], bucket[still], owner[within[still]]
            one, least = _least_by_key(window, doc[by])
            here = doc[by] > least
            cover(by[here], place[here], place[here] + WINDOW)
            mark = np.zeros(len(one), np.uint32)
            out += [dict(zip(_names(ENTRIES), r, strict=True)) | {"what": entry} for r in _packed(g, buckets, cuts, bucket[one], doc[by][one], window[one], mark)]
            waiting_rows.update(by[~here].tolist())
        names = _names(RESULT)
        for r, text in enumerate(texts):
            own = spans.get(r, [])
            if r not in waiting_rows:
                out.append(dict(zip(names, _result(doc[r], text, own, keep, extras[r]), strict=True)) | {"what": done})
                continue
            flat = np.array([np.concatenate(own[::2]), np.concatenate(own[1::2])], np.int64) if own else np.empty((2, 0), np.int64)
            out.append({"what": pending, "g": g, "doc_id": None if doc[r] == LAST else int(doc[r]), "kept": zlib.compress(text, 1), "extra": extras[r], "spans": flat.astype(np.int32).tobytes()})
        return _table(out, kinds)

    passed = settle(grouped.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(tidy(first_pass), kinds))
    entries = passed.filter(F.col("what") == entry).select(*_names(ENTRIES))
    second = _look_up(entries, parts, False)
    waiting = passed.filter(F.col("what") == pending).select("g", "doc_id", "kept", "extra", "spans")

    def second_pass(frame: pa.Table, answers: pa.Table) -> pa.Table:
        known = _keys(answers)
        out = []
        for doc, row in zip(_ids(frame), frame.to_pylist(), strict=True):
            text = zlib.decompress(row["kept"])
            before = np.frombuffer(row["spans"], np.int32).reshape(2, -1).astype(np.int64)
            at = _windows_in(text, known)
            out.append(_result(doc, text, [before[0], before[1], at, at + WINDOW], keep, row["extra"]))
        return _table(out, RESULT)

    finished = waiting.groupBy("g").cogroup(second.groupBy("g")).applyInArrow(tidy(second_pass), RESULT)
    names = _names(RESULT)
    result = passed.filter(F.col("what") == done).select(*names).unionByName(finished)
    if not carry:
        return result.drop("extra")
    carried = F.from_json("extra", docs.select(*carry).schema)
    return result.withColumn("extra", carried).select(*names[:-1], *[F.col("extra")[c].alias(c) for c in carry])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and others) with the repeats taken out of the texts.

    A character of several bytes goes with any of its bytes. Documents of which no word is left, though they had one,
    go; documents without repeats stay as they are.
    """
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    narrow = docs.select("doc_id", "text", F.struct(*others, F.col("text").isNull().alias("_text_null")).alias("_others"))
    left = remove_repeats(narrow, True, ("_others",))
    kept = left.filter((F.col("n_removed") == 0) | F.decode("kept", "ISO-8859-1").rlike(r"[^\x20\x09-\x0D]"))
    # Bytes that are no whole character any more would be read as replacement characters: those are taken out.
    text = F.when(F.is_valid_utf8(F.col("kept").cast("string")), F.col("kept").cast("string")).otherwise(F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", ""))
    whole = F.when(~F.col("_others._text_null"), text)
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": whole, "n_chars": F.length(whole).cast("long")}
    return kept.select(*[made.get(c, F.col("_others")[c]).alias(c) for c in docs.columns])
