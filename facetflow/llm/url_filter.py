"""URL filter: host and path rules first, then a weighted vocabulary counted with Aho-Corasick."""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMS = str(Path(__file__).with_name("url_terms.txt"))
MOST_TERMS = 1_000_000  # of a vocabulary: its automaton is built in each worker


# The contract's rules, as host, path and verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@functools.lru_cache(maxsize=8)
def vocabulary(path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict terms, soft terms) of a file of lines `kind term`, read on the driver; lines that start with # are remarks. Another kind, or more than MOST_TERMS terms, raise ValueError."""
    found: dict[str, list[str]] = {"strict": [], "soft": []}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            kind, _, term = line.strip().partition(" ")
            if line.startswith("#") or not line.strip():
                continue
            if kind not in found:
                raise ValueError(f"neither strict nor soft: {line!r}")
            found[kind].append(term.lower())
    if sum(map(len, found.values())) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple(found["strict"]), tuple(found["soft"])


@functools.lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (0, strict)):  # a term in both lists is strict
        for term in terms:
            found.add_word(term, (kind, term))
    found.make_automaton()
    return found


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def term_counts(strict: tuple[str, ...], soft: tuple[str, ...]):
    """Pandas UDF: url with A-Z lowered -> struct(strict, soft), the distinct terms of each kind that stand between characters other than a-z and 0-9."""

    @F.pandas_udf("strict int, soft int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, inside = automaton(strict, soft), frozenset(string.ascii_lowercase + string.digits)
        for urls in parts:
            rows = []
            for url in urls:
                hits = set()
                for end, (kind, term) in words.iter(url) if url else ():
                    before, after = end - len(term), end + 1
                    if (before < 0 or url[before] not in inside) and (after >= len(url) or url[after] not in inside):
                        hits.add((kind, term))
                n = sum(kind == 0 for kind, _ in hits)
                rows.append((n, len(hits) - n))
            yield pd.DataFrame(rows, columns=["strict", "soft"])

    return count


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def url_verdicts(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, terms: str = TERMS, min_soft: int = 2) -> DataFrame:
    """One row per input row: key, host, path, rule, verdict, strict_terms, soft_terms.

    The longest fitting rule decides (ties: the smaller text). Without one, a url is blocked on one strict
    term or `min_soft` distinct soft terms of the file `terms`; a term in both lists is strict. Urls of any length are read whole. Null url or one without `://`: host and path are empty; the terms of
    the text still count, null has none. Repeated rows give repeated rows; other columns are ignored;
    an empty table gives an empty table. Narrow: no shuffle.
    """
    strict, soft = vocabulary(terms)
    base = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).select("_key", "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    ordered = sorted(((h + p, h, p, v) for h, p, v in rules), key=lambda r: (-len(r[0]), r[0]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p, _ in ordered]
    rule = F.coalesce(*[F.when(f, F.lit(name)) for f, (name, *_) in zip(fits, ordered, strict=True)], F.lit(None).cast("string"))
    ruled = F.coalesce(*[F.when(f, F.lit(v)) for f, (*_, v) in zip(fits, ordered, strict=True)], F.lit(None).cast("string"))
    found = F.col("_terms")
    method = F.when((found["strict"] > 0) | (found["soft"] >= min_soft), F.lit("block")).otherwise(F.lit("allow"))
    return (
        base.withColumn("_terms", term_counts(strict, soft)(ascii_lower(F.coalesce("_url", F.lit("")))))
        .select(F.col("_key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(ruled, method).alias("verdict"), found["strict"].alias("strict_terms"), found["soft"].alias("soft_terms"))
    )


def verdict_sql() -> str:
    """The same rows as DuckDB SQL over the view pages."""
    strict, soft = vocabulary(TERMS)
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    count = lambda terms: " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t in terms)
    ordered = sorted(((h + p, h, p, v) for h, p, v in RULES), key=lambda r: (-len(r[0]), r[0]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((n, h, p, v))}'" for n, h, p, v in ordered) + " END"
    return f"""
    WITH a AS (SELECT page_id, {low} AS low, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    b AS (SELECT page_id, low, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
    c AS (SELECT *, {case(lambda r: r[0])} AS rule, {case(lambda r: r[3])} AS ruled, ({count(strict)})::INT AS strict_terms, ({count(soft)})::INT AS soft_terms FROM b)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict_terms > 0 OR soft_terms >= 2 THEN 'block' ELSE 'allow' END) AS verdict, strict_terms, soft_terms FROM c
    """
