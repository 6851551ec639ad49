"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import U64, chunks, fold, mix64

BUCKETS, SWITCH, SCALE = 1 << 14, 8.0, 0.6
MOST_LANGUAGES = 1000
WORD = re.compile(r"[^\W\d_]+")
# First code points of ranges, and the script that begins there (0: any other).
SCRIPTS = ("other", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "tamil", "thai", "georgian", "hangul", "kana", "han")
RANGES = ((0x0, 0), (0x41, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0), (0x900, 7), (0x980, 8), (0xA00, 0), (0xB80, 9), (0xC00, 0), (0xE00, 10), (0xE80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3040, 13), (0x3100, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 14), (0xFB00, 1), (0xFB07, 0), (0x20000, 14))
STARTS, KINDS = np.array([a for a, _ in RANGES]), np.array([b for _, b in RANGES])
WIDTH = BUCKETS + len(SCRIPTS)  # of a row of counts: n-grams, then words by script


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, index of its word) of each 1- to 4-gram of the words between marks, and each word's script."""
    code = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64)
    mark = code == 10
    word = np.cumsum(mark) - 1
    first = np.flatnonzero(mark)[:-1] + 1
    script = KINDS[np.searchsorted(STARTS, code[first], "right") - 1]
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        hashed = code
        for n in range(1, 5):
            if n > 1:
                hashed = hashed[:-1] * U64(0x100000001B3) + code[n - 1 :]
            if len(hashed) <= 0:
                break
            at = np.arange(len(hashed))
            # a mark may stand first or last in a gram, not inside it; a mark alone is none
            inside = np.concatenate([[0], np.cumsum(mark)])
            good = (inside[at + n - 1] - inside[at + 1] == 0 if n > 2 else np.ones(len(at), dtype=bool)) & (word[at] < len(words))
            if n == 1:
                good &= ~mark
            if n == 2:
                good &= ~(mark[:-1] & mark[1:])
            buckets.append((mix64(hashed[good] + U64(n)) % U64(BUCKETS)).astype(np.int64))
            owners.append(word[at[good]])
    return np.concatenate(buckets), np.concatenate(owners), script


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the words of all texts as indices, number of words of each text)."""
    seen: dict[str, int] = defaultdict(count().__next__)
    found = [[w for w in WORD.findall(t.lower()) if w.isalpha() or any(map(str.isalpha, w))] for t in texts]  # not bare fractions and the like
    sizes = np.array([len(w) for w in found], dtype=np.int64)
    ids = np.fromiter((seen[w] for words in found for w in words), dtype=np.int64, count=int(sizes.sum()))
    return list(seen), ids, sizes


@dataclass
class Model:
    """languages in order; scores (languages x BUCKETS, float32); allowed (scripts x languages): the candidates of each script."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log probability of each language for each distinct word by its n-grams, floored for languages that don't use its script."""
        n = len(self.languages)
        out = np.zeros((len(words), n), dtype=np.float32)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            buckets, owners, script = grams(part)
            weight = SCALE * np.ones(len(part))
            for j in range(n):
                out[at : at + len(part), j] = np.bincount(owners, weights=self.scores[j, buckets], minlength=len(part)) * weight
            out[at : at + len(part)] = np.where(self.allowed[script], out[at : at + len(part)], -1e9)
        out -= out.max(axis=1, keepdims=True)
        np.maximum(out, -20, out=out)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))

    def labels(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The language of each word by Viterbi over each text; words: emissions of all texts' words, one after the other."""
        n = words.shape[1]
        order = np.argsort(-sizes, kind="stable")
        length, offset = sizes[order], (np.cumsum(sizes) - sizes)[order]
        active = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if len(length) else 1), "right")
        switched = np.zeros(words.shape, dtype=bool)
        best = np.zeros(len(words), dtype=np.int32)
        state = np.zeros((len(sizes), n), dtype=np.float32)
        for t, k in enumerate(active):
            at = offset[:k] + t
            s = state[:k]
            if t:
                top = s.argmax(axis=1)
                jump = np.take_along_axis(s, top[:, None], axis=1) - np.float32(SWITCH)
                switched[at] = jump > s
                best[at] = top
                np.maximum(s, jump, out=s)
            s += words[at]
            if t and t % 256 == 0:  # only differences count
                s -= s.max(axis=1, keepdims=True)
        label = np.zeros(len(words), dtype=np.int32)
        now = state.argmax(axis=1).astype(np.int32)
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            at = offset[:k] + t
            label[at] = now[:k]
            if t:
                now[:k] = np.where(switched[at, now[:k]], best[at], now[:k])
        return label

    def read(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """For each text its words' languages as (languages' indices); texts without letters or a model without languages give an empty array."""
        distinct, ids, sizes = numbered(texts)
        if not len(ids) or not self.languages:
            yield from (np.zeros(0, dtype=np.int32) for _ in texts)
            return
        label = self.labels(self.emissions(distinct)[ids], sizes)
        yield from np.split(label, np.cumsum(sizes)[:-1])

    def verdicts(self, texts: list[str]) -> tuple[list[str], list[float], list[int]]:
        """Of each text the language of most words (ties: the first by name), their share, and the number of spans; und, 0 and 0 without letters."""
        names, shares, spans = [], [], []
        for label in self.read(texts):
            if len(label):
                n = np.bincount(label, minlength=len(self.languages))
                names.append(self.languages[int(n.argmax())])
                shares.append(float(n.max() / len(label)))
                spans.append(1 + int((label[1:] != label[:-1]).sum()))
            else:
                names.append("und")
                shares.append(0.0)
                spans.append(0)
        return names, shares, spans


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Counts of n-grams and scripts by language over all rows with a language. Each task sums its own, so a row of the shuffle is a bucket of a language and task; the driver gets WIDTH numbers a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for at, texts in chunks(batch.column(1).to_pylist()):
                for name in dict.fromkeys(names[at : at + len(texts)]):
                    words, ids, _ = numbered([t for t, own in zip(texts, names[at : at + len(texts)], strict=True) if own == name])
                    total = sums.setdefault(name, np.zeros(WIDTH))
                    if words:
                        n = np.bincount(ids, minlength=len(words)).astype(np.float64)
                        buckets, owners, script = grams(words)
                        total[:BUCKETS] += np.bincount(buckets, weights=n[owners], minlength=BUCKETS)
                        total[BUCKETS:] += np.bincount(script, weights=n, minlength=len(SCRIPTS))
        for name, total in sums.items():
            cells = np.flatnonzero(total)
            yield pa.record_batch([pa.array([name] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(total[cells].astype(np.int64), pa.int64())], names=["lang", "cell", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    by = rows.groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("n"))  # at most WIDTH of each
    found = sorted(by.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(found), WIDTH))
    for i, r in enumerate(found):
        counts[i, r["cells"]] = r["n"]
    own, script = counts[:, :BUCKETS], counts[:, BUCKETS:]
    scores = np.log((own + 0.5) / (own.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)) if len(found) else np.zeros((0, BUCKETS))
    allowed = (script >= 0.01 * script.sum(axis=1, keepdims=True)).T & (script.T > 0) if len(found) else np.zeros((len(SCRIPTS), 0), dtype=bool)
    allowed[~allowed.any(axis=1)] = True  # nobody writes it: all stay candidates
    return Model([r["lang"] for r in found], scores.astype(np.float32), allowed)


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, lang_pred, score (share of the words in that language), n_spans (of one language each). und and 0 where the text is null or has no letter. Repeated rows give repeated rows; other columns are ignored. Narrow."""
    kind, shared = docs.schema[key].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                names, shares, spans = shared.value.verdicts(texts)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, pa.int32())], names=[key, "lang_pred", "score", "n_spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, n_spans int")


def spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span of neighbouring words of one language: key, span (from 0), lang, first_word, n_words. Texts without letters have none."""
    kind, shared = docs.schema[key].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                rows: list[tuple[int, int, str, int, int]] = []
                for i, label in enumerate(shared.value.read(texts)):
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [len(label)]]) if len(label) else []
                    rows += [(at + i, j, shared.value.languages[label[a]], int(a), int(b - a)) for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.record_batch([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True))], names=[key, "span", "lang", "first_word", "n_words"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, span int, lang string, first_word bigint, n_words bigint")


def kept(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs with a language whose share of the words is at least `least`; all columns as they are. Null texts, and those without a letter, have none and go; repeated rows stay repeated; an empty table stays empty."""
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(column).to_pylist()):
                names, shares, _ = shared.value.verdicts(texts)
                yield batch.slice(at, len(texts)).filter(pa.array([n != "und" and s >= least for n, s in zip(names, shares, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out (crc32 of the key modulo 4 is 2), lang_pred, score, n_spans for every row of docs, learned from text and lang of the rows of other folds.

    Ties go to the first language by name. Texts of any length are read whole; see predicted for null and empty ones. Rows of a null
    language are not learned from; without any to learn from all are und. An empty table gives an empty result; other columns are ignored.
    """
    model = fit(docs.where(fold(key, 4) != 2), lang, text)
    return predicted(docs, model, key, text).select(key, (fold(key, 4) == 2).alias("held_out"), "lang_pred", "score", "n_spans")
