"""Language identification by segmentation-marginalised unigrams.

For each language, every piece of a fixed public vocabulary has a probability. The likelihood of a word is the sum, over
all ways to cut it into pieces, of the products of its pieces' probabilities, by the forward algorithm; no single
segmentation is chosen. A text's log likelihood is the sum over its words, and the language with the highest posterior
(equal priors) is predicted; the score is that posterior.

*Learning.* Words are counted by language over all training documents (Python counts a batch, Spark adds up). Expected
piece counts given all segmentations (forward-backward) are summed by language over those word counts, for ``rounds``
rounds of expectation-maximisation from a Zipf prior. The model has one number for each piece and language. A language
is one of the ``lang`` values of the training rows.

A word is a space and a run of letters, lower-cased; what is not a letter plays no part. Words are cut where no piece has
the two neighbouring characters side by side: no segmentation crosses such a place, so the sum over all segmentations is
the product of the parts' sums. Parts of up to ``LONG`` characters are summed many at a time, longer ones each for itself,
by logarithms; neither way leaves a segmentation out.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with nothing to learn from, every text is
``und``; ties go to the language that comes first; training rows with a null language or text are passed over; repeated
rows count each time.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, settle, small_batches, tidy
from .pieces import DEFAULT_MODEL, PieceTable, Vocabulary, load

RUN = re.compile(r"[^\W\d_]+")
#: Words up to this long are not cut, and parts up to that long are summed many at a time.
WHOLE, LONG = 24, 64
UND = "und"


def words(text: str) -> list[str]:
    """Runs of letters. The pattern lets some numerals pass (fractions, circled digits), which end a run like a digit does."""
    found = RUN.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for w in found for letters, run in itertools.groupby(w, str.isalpha) if letters]


def parts(word: str, pairs: frozenset[str]) -> list[str]:
    """A space and the word, cut (if it is long) where no piece has the two characters side by side."""
    whole = " " + word
    if len(whole) <= WHOLE:
        return [whole]
    cuts = [0, *(i for i in range(1, len(whole)) if whole[i - 1 : i + 1] not in pairs), len(whole)]
    return [whole[i:j] for i, j in itertools.pairwise(cuts)]


class Forward:
    """Sums over segmentations, for many parts of words at a time.

    ``table`` has the probabilities by piece id and language. A character without a piece counts as its bytes, each of
    probability ``BYTE``.
    """

    BYTE = math.exp(-14)
    #: Sums below this are scaled up, and the scale is kept apart.
    SMALL = 1e-120

    def __init__(self, vocabulary: Vocabulary, table: np.ndarray):
        spare = np.array([[0.0]] + [[self.BYTE**k] for k in range(1, 5)]).repeat(table.shape[1], axis=1)
        self.v, self.none, self.pieces = vocabulary, len(table), PieceTable(vocabulary.ids)
        self.table = np.concatenate([table, spare])  # rows after the pieces: nothing, then characters of 1 to 4 bytes

    def _codes(self, words: list[str]) -> np.ndarray:
        n = max(map(len, words))
        return np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n)

    def edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, row of each word's piece there), by start. Shorter words are filled up with zeros, which have no piece."""
        codes = self._codes(words)
        n = codes.shape[1]
        size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        for i in range(n):
            hashes = self.pieces.seed(len(words))
            for j in range(i + 1, min(n, i + self.v.longest) + 1):
                hashes = self.pieces.extend(hashes, codes[:, j - 1])
                found = self.pieces.look_up(hashes)
                rows = np.where(found >= 0, found, self.none + size[:, i] if j == i + 1 else self.none)
                if j == i + 1 or (found >= 0).any():
                    yield i, j, rows

    def log_sums(self, words: list[str]) -> np.ndarray:
        """Log of the sum over all segmentations, by word and language."""
        if len(words) == 1 and len(words[0]) > LONG:
            return np.array([[self._logs(words[0], c)[0][-1] for c in range(self.table.shape[1])]])
        sizes = np.array([len(w) for w in words])
        n = int(sizes.max())
        alpha = np.zeros((n + 1 + self.v.longest, len(words), self.table.shape[1]))
        alpha[0] = 1.0
        scale, out, at = np.zeros(alpha.shape[1:]), np.zeros(alpha.shape[1:]), 0
        for i, j, rows in self.edges(words):
            if i != at:
                at = i
                ended = np.flatnonzero(sizes == i)
                out[ended] = np.log(np.maximum(alpha[i, ended], 1e-300)) + scale[ended]
                if i % 4 == 0:
                    ahead = alpha[i : i + self.v.longest]
                    most = ahead.max(axis=0)
                    low = (most < self.SMALL) & (most > 0)
                    if low.any():
                        factor = np.where(low, 1 / np.where(low, most, 1.0), 1.0)
                        ahead *= factor
                        scale -= np.log(factor)
            alpha[j] += alpha[i] * self.table[rows]
        ended = np.flatnonzero(sizes == n)
        out[ended] = np.log(np.maximum(alpha[n, ended], 1e-300)) + scale[ended]
        return out

    def _logs(self, word: str, language: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A long word: logs of the sums up to each place and from each place on, and (by length, start) rows of pieces."""
        codes = self._codes([word])[0]
        n, most = len(codes), self.v.longest
        size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        rows = np.full((most + 1, n), self.none)
        hashes = self.pieces.seed(n)
        for k in range(1, min(most, n) + 1):
            hashes = self.pieces.extend(hashes[: n - k + 1], codes[k - 1 :])
            found = self.pieces.look_up(hashes)
            rows[k, : n - k + 1] = np.where(found >= 0, found, self.none + size if k == 1 else self.none)
        with np.errstate(divide="ignore"):
            logs = np.log(self.table[:, language])[rows]
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        for j in range(1, n + 1):
            k = np.arange(1, min(most, j) + 1)
            forward[j] = np.logaddexp.reduce(forward[j - k] + logs[k, j - k])
        for i in range(n - 1, -1, -1):
            k = np.arange(1, min(most, n - i) + 1)
            backward[i] = np.logaddexp.reduce(backward[i + k] + logs[k, i])
        return forward, backward, rows

    def expected(self, words: list[str], times: np.ndarray, language: int) -> np.ndarray:
        """Expected number of each piece, given all segmentations of words of one length that occur so many times."""
        table, sums = self.table[:, language], np.zeros(len(self.table))
        if len(words) == 1 and len(words[0]) > LONG:
            forward, backward, rows = self._logs(words[0], language)
            with np.errstate(divide="ignore"):
                logs = np.log(table)
            for k in range(1, len(rows)):
                here = rows[k, : len(forward) - k]
                sums += np.bincount(here, np.exp(forward[:-k] + logs[here] + backward[k:] - forward[-1]) * times[0], len(table))
            return sums[: self.none]
        edges = list(self.edges(words))
        alpha, beta = np.zeros((2, len(words[0]) + 1, len(words)))
        alpha[0], beta[-1] = 1.0, 1.0
        for i, j, rows in edges:
            alpha[j] += alpha[i] * table[rows]
        for i, j, rows in reversed(edges):
            beta[i] += beta[j] * table[rows]
        share = times / np.maximum(alpha[-1], 1e-300)
        for i, j, rows in edges:
            sums += np.bincount(rows, alpha[i] * table[rows] * beta[j] * share, len(table))
        return sums[: self.none]


def by_length(words: list[str], most: int = 4096, together: bool = False) -> Iterator[list[int]]:
    """Places of words of one length (``together``: of neighbouring lengths, beyond the usual ones), ``most`` at a time
    or fewer if they are long; words over ``LONG`` characters one at a time."""
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        n = len(w)
        places.setdefault(n if not together or n <= WHOLE or n > LONG else -(-n // 16) * 16, []).append(i)
    for n, found in places.items():
        step = 1 if n > LONG else max(1, min(most, most * WHOLE // n))
        for k in range(0, len(found), step):
            yield found[k : k + step]


def zipf(v: Vocabulary) -> np.ndarray:
    p = np.exp(np.array(v.scores) / 1e6)
    p[: v.first_byte + 256] = 0
    return (p / p.sum())[:, None]


def learn(docs: DataFrame, model: str = DEFAULT_MODEL, rounds: int = 2, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order, and probabilities by piece and language. docs: ``text, lang``."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(load(model))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Counts are kept over batches and given out before they grow large.
        seen: dict[str, Counter] = {}
        flush = lambda: pd.DataFrame([(g, w, n) for g, c in seen.items() for w, n in c.items()], columns=["lang", "word", "n"])
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, seen.values())) > 200_000:
                yield flush()
                seen = {}
        yield flush()

    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = settle(train.mapInPandas(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()]  # the classes of the model
    size = len(vocabulary.value.surfaces)
    table = np.repeat(zipf(vocabulary.value), max(1, len(langs)), axis=1)
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast((langs, table))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, probabilities = shared.value
            forward = Forward(vocabulary.value, probabilities)
            sums = np.zeros(probabilities.shape)
            held: dict[str, list[tuple[str, int]]] = {name: [] for name in names}

            def add(least: int) -> None:
                for c, name in enumerate(names):
                    if len(held[name]) > least:
                        cut = [(part, n) for word, n in held[name] for part in parts(word, vocabulary.value.pairs)]
                        held[name].clear()
                        for places in by_length([part for part, _ in cut]):
                            sums[:, c] += forward.expected([cut[i][0] for i in places], np.array([cut[i][1] for i in places], float), c)

            for batch in batches:
                for lang, word, n in zip(batch["lang"], batch["word"], batch["n"], strict=True):
                    held[lang].append((word, n))
                add(20_000)
            add(0)
            ks, cs = np.nonzero(sums)
            yield pd.DataFrame({"piece": ks, "lang": cs, "n": np.round(sums[ks, cs], 6)})

        # One row for each piece and language at most.
        totals = counted.mapInPandas(tidy(expect), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum(F.col("n").cast("decimal(30,6)")).cast("double").alias("n")).toPandas()
        fresh = np.zeros((size, len(langs)))
        fresh[totals["piece"].astype(int), totals["lang"].astype(int)] = totals["n"]
        fresh += smoothing * zipf(vocabulary.value) * np.count_nonzero(zipf(vocabulary.value)) / 10
        table = fresh / fresh.sum(axis=0)
    return langs, table


class Scorer:
    """Log likelihoods of texts. Words that were met early, the frequent ones, are remembered for later batches."""

    def __init__(self, vocabulary: Vocabulary, table: np.ndarray, remember: int = 100_000):
        self.forward, self.remember = Forward(vocabulary, table), remember
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, table.shape[1]))

    def words(self, fresh: list[str]) -> np.ndarray:
        cut = [(k, part) for k, w in enumerate(fresh) for part in parts(w, self.forward.v.pairs)]
        out = np.zeros((len(fresh), self.rows.shape[1]))
        for places in by_length([part for _, part in cut], together=True):
            np.add.at(out, [cut[i][0] for i in places], self.forward.log_sums([cut[i][1] for i in places]))
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[np.ndarray | None, int]]:
        """Log likelihoods by language, and the number of characters that they are of (words with a space before each)."""
        found = [[] if t is None else words(t) for t in texts]
        fresh = list(dict.fromkeys(w for ws in found for w in ws if w not in self.index))
        rows = np.concatenate([self.rows, self.words(fresh)])
        index = {w: len(self.rows) + k for k, w in enumerate(fresh)}
        room = max(0, self.remember - len(self.index))
        known = self.index
        out = [(rows[[known[w] if w in known else index[w] for w in ws]].sum(axis=0) if ws else None, len(ws) + sum(map(len, ws))) for ws in found]
        if room and fresh:
            self.index |= {w: len(self.rows) + k for k, w in enumerate(fresh[:room])}
            self.rows = rows[: len(self.rows) + min(room, len(fresh))]
        return out


#: A text whose likelihood in its best language is no greater than that of as many characters drawn evenly from 32 is in no
#: language that was learned (natural logarithm, for a character).
NO_LANGUAGE = -math.log(32)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, model: str = DEFAULT_MODEL, names: tuple[str, str, str] = ("lang_pred", "score", "fit")) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``fit`` (or other ``names``); other columns are kept as they are.

    ``fit`` is the mean log likelihood of a character (letters, and the space before each word) in the predicted language:
    unlike the score, it does not go to certainty with the length of a text. It is null for ``und``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((load(model), langs, table))
    key = hash((tuple(langs), table.tobytes()))

    def one(logs: np.ndarray | None, length: int) -> tuple[str, float, float | None]:
        if logs is None or not langs:
            return UND, 0.0, None
        best = int(np.argmax(logs))
        return langs[best], float(1.0 / np.exp(logs - logs[best]).sum()), float(logs[best] / length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = kept((Scorer, key), lambda: Scorer(shared.value[0], shared.value[2]))
        for batch in batches:
            found = [one(logs, n) for logs, n in s.scores(list(batch["text"]))]
            yield batch.assign(**{name: [f[k] for f in found] for k, name in enumerate(names)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(tidy(run), schema + f", {names[0]} string, {names[1]} double, {names[2]} double")
