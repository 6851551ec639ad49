"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

One stage a level, from the longest n-grams to words. A stage's parts are ranges of the n-grams' hash, so no context or word is
hot. Counts are summed in each task before they are shuffled, packed by part with a dictionary of their words. A part becomes one file of
sorted hashes and their numbers in the shared folder, and hands on what its n-grams say of the next shorter ones: how many
distinct words stand before each (suffix), and how often and by what each is followed (prefix). Only the counts of counts
reach the driver, summed by Spark. Files are written under a temporary name and renamed, so a repeated task does no harm.

That is fit, for a model that scores any texts (scored). Where the table that is learned from is scored itself (held_out_scores), only words, hot
words' n-grams and one shuffle of the tokens are on disk: a part counts and scores all tokens that follow the same word.
"""

from __future__ import annotations

import functools
import os
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from facetflow.llm.common import U64, chunks, fold, mix64, posix_dir

ORDER = 3
BEGIN, END = xxhash.xxh3_64_intdigest(b" begin"), xxhash.xxh3_64_intdigest(b" end")  # no token has a space
WINDOW, GRAMS, PART_BYTES, OPEN = 1 << 20, 3_000_000, 12_000_000, 512
PIECE = 4_000_000  # characters whose words are held as Python objects at a time
GRAM, CONTEXT, WORD, STATS = 0, 1, 2, 3  # kinds of rows: counts, numbers of followers, occurrences of words, counts of counts
ROWS = "level int, part int, kind int, data binary"
SUMS = ("n1", "n2", "n3", "n4", "more", "total", "kinds", "words", "occurrences")
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def pieces(text: str) -> Iterator[str]:
    """text cut at ASCII white space after about PIECE characters each."""
    at = 0
    while len(text) - at > PIECE:
        ends = [e for e in (text.find(s, at + PIECE) for s in SPACES) if e >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:]


def tokens(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's order - 1 begin marks, words (A-Z lowered, split at ASCII white space) and end, one after the other; and each text's number of words and end."""
    parts: list[np.ndarray] = []
    flat: list[bytes] = []
    sizes = np.empty(len(texts), dtype=np.int64)

    def flush() -> None:
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, flat), dtype=U64, count=len(flat)))
        flat.clear()

    for i, text in enumerate(texts):
        flat += [b" begin"] * (order - 1)
        n = 1
        for piece in pieces(text):
            words = piece.encode("utf-8", "surrogatepass").lower().split()
            n += len(words)
            flat += words
            if len(text) > PIECE:
                flush()
        flat.append(b" end")
        sizes[i] = n
    flush()
    return np.concatenate(parts), sizes


def longer(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, from those of all but their last word and of that word."""
    with np.errstate(over="ignore"):
        return mix64(h * U64(0x9E3779B97F4A7C15) + words)


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams from those of their words, or from their words' numbers (32 bits)."""
    return functools.reduce(longer, [mix64(c) if c.dtype == np.uint32 else c for c in columns])


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hash."""
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def summed(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(hashes, columns, sums of the values) of the distinct n-grams, by hash."""
    h = hashed(columns)
    order = np.argsort(h)
    h = h[order]
    starts = runs(h)
    first = order[starts]
    return h[starts], [c[first] for c in columns], [np.add.reduceat(v[order], starts, dtype=np.int64) if len(starts) else v.astype(np.int64) for v in values]


def planes(x: np.ndarray) -> bytes:
    """Integers as bytes, all first bytes before all second ones, which compress better."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def joined(data: bytes, kind: np.dtype) -> np.ndarray:
    """What planes() took apart."""
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(x: np.ndarray) -> tuple[bytes, np.dtype]:
    """Ascending integers as their differences."""
    d = np.diff(x, prepend=x.dtype.type(0))
    d = d.astype(np.min_scalar_type(int(d.max())) if len(d) else np.uint8)
    return planes(d), d.dtype


def climbed(data: bytes, kind: np.dtype, to: np.dtype) -> np.ndarray:
    """What steps() took apart."""
    return np.cumsum(joined(data, kind), dtype=to)


def binary_rows(level: int, kind: int, parts: int, h: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of ROWS for n-grams sorted by hash: the words of each part's once, the n-grams in their words' order."""
    part = part_of(h, parts)
    starts = runs(part)
    for a, b in zip(starts, np.append(starts, len(part))[1:], strict=True):
        words, index = np.unique(np.concatenate([c[a:b] for c in columns]), return_inverse=True)
        index = index.reshape(len(columns), -1).astype(np.min_scalar_type(len(words)))
        order = np.lexsort(index[::-1])
        own = [v[a:b][order] for v in values]
        first, *rest = index[:, order]
        data = pickle.dumps((words.dtype, steps(words), steps(first), [(planes(x), x.dtype) for x in rest], index.dtype, [v.astype(np.min_scalar_type(int(v.max()))) for v in own]), protocol=5)
        yield level, int(part[a]), kind, zstandard.compress(data, 1)


def unpacked(rows: list[bytes], columns: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    words, numbers = [], []
    for kind, own, first, rest, small, values_ in (pickle.loads(zstandard.decompress(r)) for r in rows):
        own = climbed(*own, kind)
        words.append([own[i] for i in (climbed(*first, small), *(joined(*x) for x in rest))])
        numbers.append(values_)
    return [np.concatenate([w[c] for w in words]) for c in range(columns)], [np.concatenate([v[c].astype(np.int64) for v in numbers]) for c in range(values)]


def batches_of(rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for level, part, kind, data in rows:
        yield pa.record_batch([pa.array([level], pa.int32()), pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["level", "part", "kind", "data"])


def counted(order: int, parts: int):
    """Texts -> counts of n-grams, and of words, summed over GRAMS tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            ones = np.ones(len(columns[0]), dtype=np.uint8)
            h, own, values = summed(columns, [ones])
            yield from batches_of(binary_rows(order, GRAM, parts, h, own, values))
            h, own, values = summed(columns[-1:], [ones])
            yield from batches_of(binary_rows(1, WORD, parts, h, own, values))

        for batch in batches:
            for _, texts in chunks(batch.column(0).to_pylist()):
                h, _ = tokens(texts, order)
                for start in range(0, len(h), WINDOW):
                    at = np.flatnonzero(h[start : start + WINDOW] != U64(BEGIN)) + start
                    held.append([h[at - k] for k in range(order - 1, -1, -1)])
                    size += len(at)
                    if size >= GRAMS:
                        yield from out()
                        held.clear()
                        size = 0
        if size:
            yield from out()

    return run


def save(path: str, h: np.ndarray, values: np.ndarray) -> None:
    """One file: how many rows, columns and exceptions; the sorted hashes; rows with a number of 255 and more, and their numbers; all numbers as bytes."""
    many = np.flatnonzero((values >= 255).any(axis=1))
    temporary = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(temporary, "wb") as file:
        for x in (np.array([*values.shape, len(many)]), h, many, values[many], np.where(np.isin(np.arange(len(h)), many)[:, None], 255, values).astype(np.uint8)):
            file.write(np.ascontiguousarray(x).tobytes())
    os.replace(temporary, path)


def level_files(folder: str, order: int, level: int, parts: int):
    """Writes a part's file; hands on rows of shorter n-grams, and a row of counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[int, list[bytes]]] = {}
        for batch in batches:
            for own, part, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own == level and kind != STATS:
                    found.setdefault(part, {}).setdefault(kind, []).append(data)
                else:
                    yield from batches_of(iter([(own, part, kind, data)]))
        for part in sorted(found):
            own = found.pop(part)
            sides = {kind: summed(*unpacked(rows, level, 4 if kind == CONTEXT else 1)) for kind, rows in own.items()}
            h = np.unique(np.concatenate([s[0] for s in sides.values()]))
            values = np.zeros((len(h), 1 + 4 * (level < order) + (level == 1)), dtype=np.int64)
            for kind, (keys, _, numbers) in sides.items():
                at = np.searchsorted(h, keys)
                for column, x in zip({GRAM: (0,), CONTEXT: (1, 2, 3, 4), WORD: (-1,)}[kind], numbers, strict=True):
                    values[at, column] = x
            save(f"{folder}/{level}/{part}", h, values)
            n = values[:, 0]
            words = values[:, -1] if level == 1 else np.zeros(0, dtype=np.int64)
            yield from batches_of(iter([(level, part, STATS, pickle.dumps([*[int((n == k).sum()) for k in (1, 2, 3, 4)], int((n > 2).sum()), int(n.sum()), int((n > 0).sum()), int((words > 0).sum()), int(words.sum())]))]))
            if level > 1:
                _, columns, (n,) = sides[GRAM] if GRAM in sides else (None, [np.zeros(0, dtype=U64)] * level, (np.zeros(0, dtype=np.int64),))
                keys, grams, numbers = summed(columns[1:], [np.ones(len(n), dtype=np.uint8)])
                yield from batches_of(binary_rows(level - 1, GRAM, parts, keys, grams, numbers))
                keys, grams, numbers = summed(columns[:-1], [n, n == 1, n == 2, n > 2])
                yield from batches_of(binary_rows(level - 1, CONTEXT, parts, keys, grams, numbers))

    return run


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [pickle.loads(d) for d in batch.column("data").to_pylist()]
        yield pa.record_batch([batch.column("level"), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(SUMS))]], names=["level", *SUMS])


def discounts(n: list[int]) -> tuple[float, ...]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from how many counts are 1, 2, 3 and 4; half the count where a number is missing or the discount is not above 0."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return (0.0, *[d if d > 0 else k / 2 for k, d in enumerate(found, 1)])


@dataclass(frozen=True)
class Model:
    """Where the files are, and the few numbers of the whole corpus."""

    folder: str
    order: int
    parts: int
    n: int  # training tokens
    v: int  # distinct ones
    total: int  # of the words' counts at level 1: distinct words before them, summed
    discounts: tuple[tuple[float, ...], ...]  # by level, from 1
    floor: float  # probability of a word not seen, and what each word gets of the discounts of level 1


def fit(docs: DataFrame, text: str = "text", order: int = ORDER, part_bytes: int = PART_BYTES) -> Model:
    """Count all rows of docs (null texts as empty). Parts are of about part_bytes of text, each of which a task sorts in memory, and grow in number with the input."""
    if order < 1:
        raise ValueError("order is 1 or more")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    folder = posix_dir(spark, "ngrams")
    rows = docs.select(F.col(text).alias("text")).mapInArrow(counted(order, parts), ROWS)
    for level in range(order, 0, -1):
        rows = rows.repartitionById(parts, F.col("part")).mapInArrow(level_files(folder, order, level, parts), ROWS)
    return model_of(rows, folder, order, parts)


def model_of(rows: DataFrame, folder: str, order: int, parts: int, n: int = 0, v: int = 0) -> Model:
    """The model of the files that rows' tasks write, and of the sums they hand on; n and v are given where words are counted before."""
    names = "level int, " + ", ".join(f"{s} bigint" for s in SUMS)
    found = {r["level"]: r for r in rows.mapInArrow(sums, names).groupBy("level").agg(*[F.sum(s).alias(s) for s in SUMS]).collect()}
    empty = dict.fromkeys(SUMS, 0)
    by_level = [found.get(k, empty) for k in range(1, order + 1)]
    reduced = tuple(discounts([s["n1"], s["n2"], s["n3"], s["n4"]]) for s in by_level)
    words, d = by_level[0], reduced[0]
    left = (d[1] * words["n1"] + d[2] * words["n2"] + d[3] * words["more"]) / words["total"] if words["total"] else 1.0
    n, v = n or words["occurrences"], v or words["words"]
    return Model(folder, order, parts, n, v, words["total"], reduced, left / (v + 1))


@functools.lru_cache(maxsize=OPEN)
def mapped(path: str) -> tuple[np.ndarray, ...] | None:
    """(hashes, rows of exceptions, their numbers, numbers as bytes) of a part's file; the least recently used are unmapped."""
    if not os.path.exists(path):
        return None
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    rows, columns, many = raw[:24].view(np.int64).tolist()
    ends = np.cumsum([24, 8 * rows, 8 * many, 8 * many * columns, rows * columns]).tolist()
    h, at, big, low = (raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
    return h.view(U64), at.view(np.int64), big.view(np.int64).reshape(many, columns), low.reshape(rows, columns)


def numbers(model: Model, level: int, keys: np.ndarray) -> np.ndarray:
    """The numbers of n-grams by their sorted distinct hashes; zeros for those not seen."""
    out = np.zeros((len(keys), 1 + 4 * (level < model.order) + (level == 1)), dtype=np.int64)
    part = part_of(keys, model.parts)
    starts = runs(part)
    for a, b in zip(starts, np.append(starts, len(part))[1:], strict=True):
        found = mapped(f"{model.folder}/{level}/{part[a]}")
        if found is not None and len(found[0]):
            h, rows, big, low = found
            at = np.searchsorted(h, keys[a:b])
            at[at == len(h)] = 0
            good = np.flatnonzero(h[at] == keys[a:b])
            at = at[good]
            values = low[at].astype(np.int64)
            full = np.flatnonzero((values == 255).any(axis=1))
            if len(full):
                values[full] = big[np.searchsorted(rows, at[full])]
            out[a + good] = values
    return out


def probabilities(model: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrences, base probability, probability) of each token of h from the order-th on, given those before it; meaningless for begin marks."""
    first = model.order - 1
    grams, p, occurrences, context = h, None, None, None
    for level in range(1, model.order + 1):
        if level > 1:
            grams = longer(grams[:-1], h[level - 1 :])  # of the n-grams that end at each token from the level-th on
        keys, index = np.unique(grams, return_inverse=True)
        found = numbers(model, level, keys)
        n, d = found[:, 0][index][first - level + 1 :], np.array(model.discounts[level - 1])
        less = np.maximum(n - d[np.minimum(n, 3)], 0)
        if level == 1:
            occurrences = found[:, -1][index][first:]
            p = (less / model.total if model.total else 0.0) + model.floor
        else:
            total = context[:, 0]
            under = np.where(total > 0, total, 1)
            p = np.where(total > 0, less / under + context[:, 1:] @ d[1:] / under * p, p)
        if level < model.order:
            context = found[:, 1:5][index][first - level : -1]
    return occurrences, (occurrences + 0.5) / (model.n + 0.5 * (model.v + 1)), p


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """(n_tokens, n_known, base_score, score) of each text."""
    h, sizes = tokens(texts, model.order)
    known, base, score = (np.zeros(len(texts)) for _ in range(3))
    ends = np.cumsum(sizes + model.order - 1)
    for start in range(0, len(h), WINDOW):
        own = h[max(start - model.order + 1, 0) : start + WINDOW]
        if len(own) < model.order:
            continue
        at = np.arange(max(start, model.order - 1), min(start + WINDOW, len(h)))
        some = h[at] != U64(BEGIN)
        c, q, p = (x[some] for x in probabilities(model, own))
        text = np.searchsorted(ends, at[some], "right")
        for total, x in ((known, c > 0), (base, np.log10(q)), (score, np.log10(p))):
            total += np.bincount(text, weights=x, minlength=len(texts))
    return sizes, known.astype(np.int64), base, score


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                n, known, base, score = scores(model, texts)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.n)), pa.array(base), pa.array(score), pa.array(10.0 ** (-score / n))], names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


# Scoring the training table itself needs no model of all its n-grams: tokens travel once, by the word before them, to a part that
# holds all n-grams with it; a word that is often in that place ("hot") is dealt out by the word before, and so on, and only
# n-grams of which parts see a share are summed in files.

UNKNOWN, MARK, FIRST = 0, 1, 2  # numbers of words not in the training rows, of the begin mark, and of the first word
DEALT_BYTES, BLOCK, SLICE = 20_000_000, 1_000_000, 1 << 18  # of text in a part; tokens that a task deals out at a time, and that it takes at a time out of a part
HOT = 24  # a word is hot if a HOT-th of a part's bytes is less than its occurrences, so parts have at most HOT / 2 hot words each on average


def some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller batches, as the texts of one become Python objects at a time."""
    return (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000))


def word_counts(parts: int):
    """Texts -> their words' occurrences, summed over GRAMS tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            yield from batches_of(binary_rows(1, WORD, parts, h, [h], [n]))

        for batch in some_rows(batches):
            for _, texts in chunks(batch.column(0).to_pylist(), 2_000_000):
                held.append(tokens(texts, 1)[0])
                size += len(held[-1])
                if size >= GRAMS:
                    yield from out()
                    held.clear()
                    size = 0
        if size:
            yield from out()

    return run


def word_files(folder: str, parts: int, often: float):
    """Writes a part's words: sorted hashes, numbers, occurrences; hands on (words, occurrences, numbers of hot words). Frequent words have low numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                found.setdefault(part, []).append(data)
        for part in sorted(found):
            h, _, (n,) = summed(*unpacked(found.pop(part), 1, 1))
            rank = np.empty(len(h), dtype=np.int64)
            rank[np.argsort(-n, kind="stable")] = np.arange(len(h))
            ids = rank * parts + part + FIRST
            if ids.max() >= 1 << 32:
                raise ValueError("more distinct words than numbers of 32 bits")
            temporary = f"{folder}/words/{part}.{os.getpid()}.{os.urandom(4).hex()}"
            os.makedirs(os.path.dirname(temporary), exist_ok=True)
            with open(temporary, "wb") as file:
                for x in (np.array([len(h)]), h, n, ids.astype(np.uint32)):
                    file.write(x.tobytes())
            os.replace(temporary, f"{folder}/words/{part}")
            yield pa.record_batch([pa.array([len(h)]), pa.array([int(n.sum())]), pa.array([ids[n > often].tolist()], pa.list_(pa.int64()))], names=["words", "occurrences", "hot"])

    return run


@functools.lru_cache(maxsize=OPEN)
def mapped_words(path: str) -> tuple[np.ndarray, ...] | None:
    if not os.path.exists(path):
        return None
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    n = int(raw[:8].view(np.int64)[0])
    return raw[8 : 8 + 8 * n].view(U64), raw[8 + 8 * n : 8 + 16 * n].view(np.int64), raw[8 + 16 * n :].view(np.uint32)


def numbered(folder: str, parts: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and occurrences of words by their sorted distinct hashes."""
    ids, seen = np.full(len(words), UNKNOWN, dtype=np.uint32), np.zeros(len(words), dtype=np.int64)
    part = part_of(words, parts)
    starts = runs(part)
    for a, b in zip(starts, np.append(starts, len(part))[1:], strict=True):
        found = mapped_words(f"{folder}/words/{part[a]}")
        if found is not None:
            h, n, own = found
            at = np.searchsorted(h, words[a:b])
            at[at == len(h)] = 0
            good = np.flatnonzero(h[at] == words[a:b])
            ids[a + good], seen[a + good] = own[at[good]], n[at[good]]
    ids[words == U64(BEGIN)] = MARK
    return ids, seen


def are_hot(ids: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """hot: flags by number, as far as there are any."""
    return hot[np.minimum(ids, len(hot) - 1)]


def hot_flags(ids: list[int]) -> np.ndarray:
    """Unknown words and marks are hot, and the last flag stands for all higher numbers."""
    flags = np.zeros(max([MARK, *ids]) + 2, dtype=bool)
    flags[[UNKNOWN, MARK, *ids]] = True
    return flags


def home(columns: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    """Hashes that deal tokens out: of the word before, and as long as words are hot of the one before that too, at last of the token's own word and place."""
    *before, word = columns
    key, left = mix64(before[-1]), are_hot(before[-1], hot)
    for x in (*before[-2::-1], word):
        key[left] = longer(key[left], mix64(x[left]))
        left = left & are_hot(x, hot)
    key[left] = longer(key[left], mix64(np.flatnonzero(left)))
    return key


def dealt_tokens(folder: str, order: int, parts: int, hot: np.ndarray, n: int, v: int):
    """(key, text, train) -> by part, blocks of tokens with the words before them; and for each group of texts a row of what needs no n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 32
        held: list[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]] = []
        about: list[pa.RecordBatch] = []
        size = texts_held = 0

        def out() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*(x[0] for x in held), strict=True)]
            text, train, part = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            by_part = np.argsort(part, kind="stable")
            starts = runs(part[by_part])
            for a, b in zip(starts, np.append(starts, len(part))[1:], strict=True):
                at = by_part[a:b]
                data = zstandard.compress(pickle.dumps((group, [planes(c[at]) for c in columns], steps(text[at]), np.packbits(train[at])), protocol=5), 3)
                yield pa.record_batch([pa.array([int(part[at[0]])], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

        def close() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(about).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as file:
                file.write_table(table)
            data = zstandard.compress(pickle.dumps((group, sink.getvalue().to_pybytes()), protocol=5), 1)
            yield pa.record_batch([pa.array([zlib.crc32(b"%d" % group) % parts], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

        for batch in some_rows(batches):
            for first, texts in chunks(batch.column(1).to_pylist(), 2_000_000):
                h, sizes = tokens(texts, order)
                words, index = np.unique(h, return_inverse=True)
                ids, seen = numbered(folder, parts, words)
                base = np.log10((seen + 0.5) / (n + 0.5 * (v + 1)))
                own = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes + order - 1)
                counted_ = words[index] != U64(BEGIN)
                rows = batch.slice(first, len(texts))
                train = np.array(rows.column(2).to_pylist(), dtype=bool)
                about.append(pa.record_batch([rows.column(0), pa.array(sizes), *(pa.array(np.bincount(own[counted_], weights=x[index[counted_]], minlength=len(texts))) for x in (seen > 0, base))], names=["key", "n", "known", "base"]))
                for start in range(0, len(h), WINDOW):
                    at = np.flatnonzero(counted_[start : start + WINDOW]) + start
                    columns = [ids[index[at - k]] for k in range(order - 1, -1, -1)]
                    part = part_of(home(columns, hot), parts).astype(np.min_scalar_type(parts))
                    held.append((columns, own[at] + np.uint32(texts_held), train[own[at]], part))
                    size += len(at)
                    if size >= BLOCK:
                        yield from out()
                        held.clear()
                        size = 0
                texts_held += len(texts)
                if not held or texts_held >= 1 << 16:
                    if held:
                        yield from out()
                    yield from close()
                    held.clear()
                    about.clear()
                    size = texts_held = 0
                    group += 1
        if held:
            yield from out()
        if about:
            yield from close()

    return run


def block(data: bytes) -> tuple | None:
    """(group, columns, text, train) of a block; of a group's row (group, its table)."""
    group, *rest = pickle.loads(zstandard.decompress(bytes(data)))
    if len(rest) == 1:
        return group, *rest
    columns = [joined(c, np.uint32) for c in rest[0]]
    return group, columns, climbed(*rest[1], np.uint32), np.unpackbits(rest[2], count=len(columns[0])).astype(bool)


def slices(columns: list[np.ndarray], hot: np.ndarray) -> Iterator[np.ndarray]:
    """Places of a part's tokens, about SLICE at a time; n-grams that are not shared between parts are not shared between slices."""
    n = len(columns[0]) // SLICE + 1
    some = np.concatenate([(home([c[at : at + SLICE] for c in columns], hot) % U64(1 << 32) * U64(n) >> U64(32)).astype(np.min_scalar_type(n)) for at in range(0, len(columns[0]), SLICE)])
    for k in range(n):
        yield np.flatnonzero(some == k)


def levels(columns: list[np.ndarray], train: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the longest n-grams to pairs: level, each token's n-gram, and by n-gram a token of it, its context, its count, whether parts see a share of it and of its context.

    Counts are this part's: of tokens, or of the distinct words before; those of which parts see a share leave out what level_files hands on.
    """
    order, word = len(columns), columns[-1].astype(U64)
    flags = [are_hot(c, hot) for c in columns]
    by_level, context, far = [], np.zeros(len(word), dtype=np.int64), np.ones(len(word), dtype=bool)
    for level in range(2, order + 1):
        context = np.unique(context.astype(U64) << U64(32) | columns[order - level], return_inverse=True)[1]
        keys, gram = np.unique(context.astype(U64) << U64(32) | word, return_inverse=True)
        one = np.empty(len(keys), dtype=np.int64)
        one[gram] = np.arange(len(gram))
        far = far & flags[order - level]
        by_level.append((level, gram, one, context[one], far[one] & flags[-1][one] if level == order else far[one], far[one]))
    longest = None
    for level, gram, one, context, shared, shared_context in reversed(by_level):
        n = np.bincount(gram[train] if longest is None else gram[longest], minlength=len(one))
        longest = one[(n > 0) & ~shared]
        yield level, gram, one, context, n, shared, shared_context


def counts_of(order: int, parts: int, hot: np.ndarray):
    """A part's blocks -> rows of ROWS: counts of counts of the n-grams that it holds alone, counts of others, and of words."""

    def run(rows: Iterator[Row]) -> Iterator[tuple[int, int, int, bytes]]:
        held: list[list[np.ndarray]] = []
        for _, data in rows:
            if len(x := block(data)) > 2:
                held.append([c[x[3]] for c in x[1]])
        if not held:
            return
        columns = [np.concatenate([x.pop() for x in held]) for _ in range(order)][::-1]
        held.clear()
        shares: dict[tuple[int, int], list[tuple[list[np.ndarray], list[np.ndarray]]]] = {}

        def add(level: int, kind: int, at: np.ndarray, words: list[np.ndarray], values: list[np.ndarray]) -> None:
            if at.any():
                shares.setdefault((level, kind), []).append(summed([c[at] for c in words], [x[at] for x in values])[1:])

        for at in slices(columns, hot):
            for level, _, one, _, n, shared, shared_context in levels(some := [c[at] for c in columns], np.ones(len(at), dtype=bool), hot):
                own = [c[one] for c in some[order - level :]]
                add(level, GRAM, shared & (n > 0), own, [n])
                alone = ~shared & (n > 0)
                m = n[alone]
                yield level, 0, STATS, pickle.dumps([*[int((m == k).sum()) for k in (1, 2, 3, 4)], int((m > 2).sum()), int(m.sum()), len(m), 0, 0])
                add(level - 1, CONTEXT, alone & shared_context, own[:-1], [n, n == 1, n == 2, n > 2])
                if level == 2:
                    add(1, GRAM, alone, own[1:], [np.ones(len(n), dtype=np.uint8)])
        for (level, kind), found in shares.items():
            words, values = ([np.concatenate(x) for x in zip(*y, strict=True)] for y in zip(*found, strict=True))
            yield from binary_rows(level, kind, parts, *summed(words, values))

    return run


def looked_up(model: Model, columns: list[np.ndarray]) -> np.ndarray:
    """The numbers of n-grams in any order."""
    keys, index = np.unique(hashed(columns), return_inverse=True)
    return numbers(model, len(columns), keys)[index]


def dealt_probabilities(model: Model, columns: list[np.ndarray], train: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Probability of each token of a slice."""
    words, before = np.unique(columns[-1], return_inverse=True)
    d = np.array(model.discounts)
    n = looked_up(model, [words])[:, 0]
    p = (np.maximum(n - d[0][np.minimum(n, 3)], 0) / model.total if model.total else 0.0) + model.floor
    for level, gram, one, context, n, shared, shared_context in reversed(list(levels(columns, train, hot))):
        own = [c[one] for c in columns[model.order - level :]]
        if shared.any():
            n[shared] = looked_up(model, [c[shared] for c in own])[:, 0]
        sums_ = [np.bincount(context, weights=x) for x in (n, n == 1, n == 2, n > 2)]
        some = np.empty(len(sums_[0]), dtype=np.int64)
        some[context] = np.arange(len(context))
        if shared_context.any():
            far = shared_context[some]
            for x, y in zip(sums_, looked_up(model, [c[some[far]] for c in own[:-1]])[:, 1:5].T, strict=True):
                x[far] = y
        total, (_, d1, d2, d3) = sums_[0], d[level - 1]
        under = np.where(total > 0, total, 1)
        left = np.where(total > 0, (sums_[1] * d1 + sums_[2] * d2 + sums_[3] * d3) / under, 1.0)  # a context not seen leaves all to the shorter one
        p = np.maximum(n - d[level - 1][np.minimum(n, 3)], 0) / under[context] + left[context] * p[before[one]]
        before = gram
    return p[before]


def scores_of(model: Model, hot: np.ndarray):
    """A part's blocks -> for each the sums of its texts' scores; and the groups' rows as they are."""
    order = model.order

    def run(rows: Iterator[Row]) -> Iterator[tuple[int, bool, bytes]]:
        found = []
        for _, data in rows:
            x = block(data)
            if len(x) > 2:
                found.append(x)
            else:
                yield x[0], True, x[1]
        if not found:
            return
        train = np.concatenate([x[3] for x in found])
        columns = [np.concatenate([x[1].pop() for x in found]) for _ in range(order)][::-1]
        found = [(group, text) for group, _, text, _ in found]
        score = np.empty(len(train))
        for at in slices(columns, hot):
            score[at] = np.log10(dealt_probabilities(model, [c[at] for c in columns], train[at], hot))
        start = 0
        for group, text in found:
            own, index = np.unique(text, return_inverse=True)
            x = np.bincount(index, weights=score[start : start + len(text)])
            start += len(text)
            yield group, False, zstandard.compress(pickle.dumps((steps(own), planes(x)), protocol=5), 1)

    return run


def texts_of(model: Model, key: str):
    """Groups' rows and sums -> a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, bytes] = {}
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, whole, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if whole:
                    groups[group] = data
                    continue
                texts, x = pickle.loads(zstandard.decompress(data))
                texts = climbed(*texts, np.int64)
                had = found.get(group, np.zeros(0))
                if len(had) <= texts[-1]:
                    had = np.concatenate([had, np.zeros(int(texts[-1]) + 1 - len(had))])
                had[texts] += joined(x, np.float64)
                found[group] = had
        for group, data in groups.items():
            table = pa.ipc.open_stream(data).read_all().combine_chunks()
            n, known, base = (table.column(c).to_numpy() for c in ("n", "known", "base"))
            score = found.pop(group)
            for rows in pa.Table.from_arrays([table.column("key"), *map(pa.array, (n, known.astype(np.int64), np.full(len(n), model.n), base, score, 10.0 ** (-score / n)))], names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]).to_batches():
                yield rows

    return run


def scored_by_some(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, part_bytes: int = DEALT_BYTES) -> DataFrame:
    """scored(docs, fit(docs.where(train))) for an order of 2 or more, without files of all n-grams: what is stored are words and n-grams of hot words.

    A text is known by its task and place there, so a repeated task must read its rows in the same order. A part of part_bytes of text is held in memory by a task.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // part_bytes))
    folder = posix_dir(spark, "ngrams")
    known = docs.where(train).select(F.col(text).alias("text")).mapInArrow(word_counts(parts), ROWS)
    known = known.repartitionById(parts, F.col("part")).mapInArrow(word_files(folder, parts, size / parts / HOT), "words bigint, occurrences bigint, hot array<bigint>")
    found = known.agg(F.sum("words").alias("v"), F.sum("occurrences").alias("n"), F.flatten(F.collect_list("hot")).alias("hot")).first()
    hot, n, v = hot_flags(found["hot"]), found["n"] or 0, found["v"] or 0
    rows = docs.select(key, text, F.coalesce(train, F.lit(False))).mapInArrow(dealt_tokens(folder, order, parts, hot, n, v), "part int, data binary")
    dealt = rows.repartitionById(parts, F.col("part")).rdd  # as an RDD it is shuffled once, for both jobs
    counts = spark.createDataFrame(dealt.mapPartitions(counts_of(order, parts, hot)), ROWS, verifySchema=False)
    for level in range(order, 0, -1):
        counts = counts.repartitionById(parts, F.col("part")).mapInArrow(level_files(folder, order, level, parts), ROWS)
    model = model_of(counts, folder, order, parts, n, v)
    sums_ = spark.createDataFrame(dealt.mapPartitions(scores_of(model, hot)), "group bigint, whole boolean, data binary", verifySchema=False)
    kind = docs.schema[key].dataType.simpleString()
    return sums_.repartition(parts, "group").mapInArrow(texts_of(model, key), f"`{key}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def held_out_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Every row of docs scored by a model of the rows whose crc32 of the key modulo 5 is not 1 (held_out: it is).

    A null or empty text is one end token. Words are runs of characters other than ASCII white space, A-Z lowered; a
    text's words and its end are predicted, each from the order - 1 before, with as many begin marks before the first. Repeated rows
    count and are scored each; no training rows: probabilities are those of an unseen word. Texts of any length are read whole, a
    window of tokens at a time. Other columns are ignored. An empty table gives an empty result.
    """
    held_out = fold(key, 5) == 1
    if order == 1:
        found = scored(docs, fit(docs.where(~held_out), text, order), key, text)
    else:
        found = scored_by_some(docs, ~held_out, key, text, order)
    return found.select(key, held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
