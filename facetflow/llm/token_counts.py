"""Token counts of sections and fields: a whole document is encoded once and its tokens' character spans are attributed."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

RULES = ("most", "start")


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a rank file, and each id's length in bytes."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    sizes[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token; a token with part of a character's bytes has that character."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if not text.isascii():
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts, ends = character[starts], character[ends - 1] + 1
    return starts, ends


def attributed(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary). bounds: ascending first characters of the sections, the first 0.

    rule "start": the section of the token's first character. "most": the one with most of the token's
    characters; ties go to the earlier section.
    """
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = last > first
    if rule == "most":
        for i in np.flatnonzero(crossing):
            edges = np.concatenate([[starts[i]], bounds[first[i] + 1 : last[i] + 1], [ends[i]]])
            first[i] += int(np.argmax(np.diff(edges)))
    return first, crossing


def lines_of(separator: str) -> Callable[[tuple], tuple[str, list[int]]]:
    """Sections of one text: each separator ends a section and belongs to it; an empty text has one empty section."""

    def split(values: tuple) -> tuple[str, list[int]]:
        text = values[0] or ""
        bounds, at = [0], text.find(separator)
        while at >= 0 and at + len(separator) < len(text):
            bounds.append(at + len(separator))
            at = text.find(separator, at + len(separator))
        return text, bounds

    return split


def fields_of(joiner: str) -> Callable[[tuple], tuple[str, list[int]]]:
    """Fields joined to one text; a joiner belongs to the field before it, a null field is empty."""

    def join(values: tuple) -> tuple[str, list[int]]:
        parts = [v or "" for v in values]
        bounds, at = [], 0
        for p in parts:
            bounds.append(at)
            at += len(p) + len(joiner)
        return joiner.join(parts), bounds

    return join


def counted(docs: DataFrame, key: str, columns: list[str], cut: Callable[[tuple], tuple[str, list[int]]], path: str, pattern: str, rule: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, sections, chars, tokens, crossed = [], [], [], [], []
                for row, values in enumerate(zip(*[c.to_pylist() for c in part.columns[1:]], strict=True)):
                    text, bounds = cut(values)
                    ids = np.array(encode.encode_ordinary(text), dtype=np.int64)
                    n = len(bounds)
                    if len(ids):
                        # fields may be empty: equal bounds, of which the last has the characters
                        own, crossing = attributed(*spans(text, sizes[ids]), np.array(bounds), rule)
                        tokens.append(np.bincount(own, minlength=n))
                        crossed.append(np.bincount(own[crossing], minlength=n))
                    else:
                        tokens.append(np.zeros(n, dtype=np.int64))
                        crossed.append(np.zeros(n, dtype=np.int64))
                    rows.append(np.full(n, row))
                    sections.append(np.arange(n))
                    chars.append(np.diff([*bounds, max(len(text), bounds[-1])]))
                take = pa.array(np.concatenate(rows))
                yield pa.record_batch([part.column(0).take(take), *(pa.array(np.concatenate(x), pa.int64()) for x in (sections, chars, tokens, crossed))], names=[key, "section", "n_chars", "n_tokens", "n_crossing"])

    return docs.select(key, *columns).mapInArrow(run, f"`{key}` {kind}, section bigint, n_chars bigint, n_tokens bigint, n_crossing bigint")


def section_tokens(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", separator: str = "\n", rule: str = "most") -> DataFrame:
    """One row per section of every document: key, section (from 0), n_chars, n_tokens, n_crossing (those of n_tokens that reach into another section).

    The whole text is encoded once, so a document's n_tokens sum to those of its encoding. Null or empty text: one
    section of 0 characters and 0 tokens. Repeated rows give repeated rows, other columns are ignored. Texts of any length are encoded whole; an
    empty table gives an empty result. Narrow.
    """
    return counted(docs, key, [text], lines_of(separator), path, pattern, rule)


def field_tokens(docs: DataFrame, fields: list[str], path: str, pattern: str, key: str, joiner: str = "\n", rule: str = "most") -> DataFrame:
    """As section_tokens, with the given text columns, joined in order, as the sections."""
    return counted(docs, key, fields, fields_of(joiner), path, pattern, rule)
