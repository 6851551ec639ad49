"""Texts of prompts and settings: canonical forms, pre-tokens, byte pairs, small formats."""

from __future__ import annotations

import functools
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
CHANNELS = ("normal_x", "normal_y", "normal_z", "matte", "sdf", "curvature", "feature_edges", "mask", "face_id")


def canonical(text: Column, keep: str = "") -> Column:
    """Lower case, _ as a space, ASCII punctuation but `keep` gone, white space collapsed and trimmed."""
    gone = "".join(c for c in PUNCTUATION if c != keep)
    plain = F.translate(F.translate(text, "_", " "), gone, "")
    return F.trim(F.regexp_replace(F.lower(plain), "[ \\t\\n\\r\\f\\x0B]+", " "))


def unescaped(text: Column) -> Column:
    """HTML entities resolved twice, white space collapsed and trimmed."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else " ".join(html.unescape(html.unescape(t)).split()))

    return run(text)


# Fixed value: contractions, letters, single digits, runs of other signs. White space is spelt out, as regular expression engines differ in it.
PIECES = "(?i)'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}\\p{L}\\p{N}]+"


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """A visible character for each byte: printable Latin-1 ones stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merged(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The word's letters merged by rank; its last letter is marked as the end of a word."""
    parts = [*word[:-1], word[-1] + "</w>"]
    while len(parts) > 1:
        best = min(zip(parts, parts[1:], strict=False), key=lambda p: ranks.get(p, 1 << 60))
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def merges_of(path: str) -> list[tuple[str, str]]:
    """The merges of a tokenizer file (JSON with model.merges, as pairs or as `left right`) in order of rank."""
    with open(path, encoding="utf-8") as file:
        return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.load(file)["model"]["merges"]]


@functools.lru_cache(maxsize=2)
def _vocabulary(merges: str | tuple[tuple[str, str], ...]) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """(ids, ranks): ids of the byte letters, the same at a word's end, and the merges."""
    own = merges_of(merges) if isinstance(merges, str) else merges
    letters = list(byte_letters().values())
    vocabulary = [*letters, *[c + "</w>" for c in letters], *["".join(m) for m in own]]
    return {t: i for i, t in enumerate(vocabulary)}, {m: i for i, m in enumerate(own)}


def byte_pairs(merges: str | list[tuple[str, str]], length: int | None = 77):
    """Pandas UDF: an array of pre-tokens -> ids of their byte pairs between a start and an end id, cut to `length` with the end kept, padded with 0; whole with None.

    Ids: the byte letters, the same at a word's end, the merges, start, end. merges: the pairs, or the path of a tokenizer file that every machine has.
    """
    merges = merges if isinstance(merges, str) else tuple(merges)

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, ranks = _vocabulary(merges)
        start, end = 512 + len(ranks), 513 + len(ranks)
        known = functools.lru_cache(maxsize=50_000)(lambda w: [ids[t] for t in merged("".join(byte_letters()[b] for b in w.encode()), ranks)])
        for part in parts:
            rows = []
            for words in part:
                own = [start, *[i for w in (words if words is not None else ()) for i in known(w)], end]
                if length is not None:
                    own = own if len(own) <= length else [*own[: length - 1], end]
                    own += [0] * (length - len(own))
                rows.append(own)
            yield pd.Series(rows)

    return encode


def decoded(ids: list[int], merges: str | list[tuple[str, str]]) -> str:
    merges = merges_of(merges) if isinstance(merges, str) else merges
    letters = list(byte_letters().values())
    vocabulary = [*letters, *[c + "</w>" for c in letters], *["".join(m) for m in merges]]
    back = {c: b for b, c in byte_letters().items()}
    text = "".join(vocabulary[i] for i in ids if i < len(vocabulary))
    return bytes(back[c] for c in text.replace("</w>", " ").replace(" ", "Ġ") if c in back).decode("utf-8", "replace").strip()


def channel_sets(config: str, known: tuple[str, ...] = CHANNELS) -> list[list[str]]:
    """The sets of three channels that a setting's lines, starting with -, name."""
    out = []
    for line in config.splitlines():
        line = line.strip()
        if line.startswith("-"):
            names = [n.strip() for n in line[1:].split(",")]
            if len(names) != 3:
                raise ValueError(f"three channels are needed: {line}")
            if unknown := [n for n in names if n not in known]:
                raise ValueError(f"no such channel: {unknown[0]}")
            out.append(names)
    if not out:
        raise ValueError("no set of channels")
    return out


def options_in_source(text: Column, option: str) -> Column:
    """Quoted values that a source text compares an option with."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(re.escape(option) + "\\s*==\\s*[\"']([^\"']+)[\"']"), F.lit(1)))


def colour(text: Column, default: tuple[float, ...] = (1.0, 1.0, 1.0)) -> Column:
    """A JSON list of three or four numbers as shares; numbers above 1 are of 255. Anything else is the default."""
    own = F.from_json(text, "array<double>")
    fine = own.isNotNull() & F.size(own).between(3, 4) & F.forall(own, lambda x: x.isNotNull())
    scale = F.when(F.array_max(own) > 1, 255.0).otherwise(1.0)
    return F.when(fine, F.transform(F.slice(own, 1, 3), lambda x: x / scale)).otherwise(F.array(*[F.lit(v) for v in default]))
