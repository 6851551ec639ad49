"""Ranked lexical search over dual-sorted wavelet trees: a shard's postings stand by impact, and its tree leads to them by document."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetflow.session import stored

TOP = 10
POSTINGS = 1 << 19  # of a shard; a document with more of them has a shard of its own
WIDE = 64  # nodes that a search opens at once
TERMS = 1_000_000  # of the items that are searched for at once; more items are searched in several rounds
SAMPLED = 16  # a share of the shards is searched first, for bounds that the search of all starts from
PATTERN = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
# bytes that are no part of a term become a space, A-Z small letters
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


Level = tuple[np.ndarray, np.ndarray]  # bits in 64-bit words, and the ones before each word


def packed(bits: np.ndarray) -> np.ndarray:
    words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
    found = np.packbits(bits, bitorder="little")
    words.view(np.uint8)[: len(found)] = found
    return words


def ones_before(level: Level, at: np.ndarray) -> np.ndarray:
    words, before = level
    word = at >> 6
    mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[word] + np.bitwise_count(words[word] & mask)


class Shard:
    """The wavelet tree (a bit vector a level, all of a level's left children first) of one sequence of documents: the terms' lists one after another, each by falling impact.

    A node is a range of documents. Of each list it has one range, still by falling impact, so that the first entry of it bounds what the
    list gives to any document of the node. The ones before a range's ends lead to the ranges of both children; at the leaves bounds are scores.
    """

    def __init__(self, terms: bytes, starts: bytes, impacts: bytes, bits: bytes, ids: bytes):
        self.lists = {t: i for i, t in enumerate(terms.split(b"\n"))}
        self.starts, self.ids = np.frombuffer(starts, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)
        self.impacts, size = [np.frombuffer(impacts, dtype=np.int32)], len(impacts) // 4
        words = np.frombuffer(bits, dtype=np.uint64).reshape(-1, size // 64 + 1)
        self.levels: list[Level] = []
        self.zeros = []
        for own in words:
            before = np.zeros(len(own), dtype=np.int64)
            np.cumsum(np.bitwise_count(own[:-1]), out=before[1:])
            self.levels.append((own, before))
            right = np.unpackbits(own.view(np.uint8), count=size, bitorder="little").astype(bool)
            self.zeros.append(size - int(right.sum()))
            self.impacts.append(np.concatenate([self.impacts[-1][~right], self.impacts[-1][right]]))

    @staticmethod
    def packed(lists: list[bytes], term: np.ndarray, place: np.ndarray, impact: np.ndarray, ids: np.ndarray) -> tuple[bytes, ...]:
        """What a shard is made from, of postings in any order: term (of lists), place (of ids, which ascend), impact."""
        order = np.lexsort((place, -impact, term))
        place, depth, levels = place[order], max(1, (len(ids) - 1).bit_length()), []
        impacts = impact[order].astype(np.int32)
        for bit in range(depth - 1, -1, -1):
            right = (place >> bit & 1).astype(bool)
            levels.append(packed(right))
            place = np.concatenate([place[~right], place[right]])
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(lists)))])
        return b"\n".join(lists), starts.astype(np.int64).tobytes(), impacts.tobytes(), np.concatenate(levels).tobytes(), ids.astype(np.int64).tobytes()

    def best(self, weights: dict[bytes, int], least: int = 1, top: int = TOP) -> list[tuple[int, int]]:
        """(score, place) of the `top` documents of highest score among those of score `least` (above 0) and more, ties to the smaller place; exact.

        Nodes wait in packets of one level. The packet of the best bound is opened next, of a large one its WIDE best nodes; what is bounded
        below the top-th score found so far is never opened.
        """
        own = [(self.lists[t], w) for t, w in weights.items() if w > 0 and t in self.lists]
        if not own:
            return []
        at, w = np.array([i for i, _ in own]), np.array([w for _, w in own], dtype=np.int64)
        low, high = self.starts[at], self.starts[at + 1]
        scores, places = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        bounds = np.array([(self.impacts[0][low] * w).sum()])
        tie, waiting = 0, [(-int(bounds[0]), 0, 0, np.zeros(1, dtype=np.int64), bounds, np.array([len(w)]), low, high, w)]
        while waiting and -waiting[0][0] >= least:
            _, _, level, nodes, bounds, sizes, low, high, w = heapq.heappop(waiting)
            keep = bounds >= least
            if len(nodes) > WIDE:
                taken = np.zeros(len(nodes), dtype=bool)
                taken[np.argpartition(-bounds, WIDE)[:WIDE]] = True
                rest = keep & ~taken
                if rest.any():
                    tie += 1
                    ranges = np.repeat(rest, sizes)
                    heapq.heappush(waiting, (-int(bounds[rest].max()), tie, level, nodes[rest], bounds[rest], sizes[rest], low[ranges], high[ranges], w[ranges]))
                keep &= taken
            if not keep.all():
                ranges = np.repeat(keep, sizes)
                nodes, sizes, low, high, w = nodes[keep], sizes[keep], low[ranges], high[ranges], w[ranges]
            ones, split = ones_before(self.levels[level], np.concatenate([low, high])), len(low)
            zeros, owner = self.zeros[level], np.repeat(nodes * 2, sizes)
            low = np.concatenate([low - ones[:split], zeros + ones[:split]])
            high = np.concatenate([high - ones[split:], zeros + ones[split:]])
            some = np.flatnonzero(high > low)
            low, high = low[some], high[some]
            owner, w = np.concatenate([owner, owner + 1])[some], np.concatenate([w, w])[some]
            level += 1
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            nodes, sizes = owner[first], np.diff(np.append(first, len(owner)))
            bounds = np.add.reduceat(self.impacts[level][low] * w, first)
            keep = bounds >= least
            if not keep.any():
                continue
            if level == len(self.levels):
                scores, places = np.concatenate([scores, bounds[keep]]), np.concatenate([places, nodes[keep]])
                order = np.lexsort((places, -scores))[:top]
                scores, places = scores[order], places[order]
                if len(scores) == top:
                    least = max(least, int(scores[-1]))
                continue
            tie += 1
            ranges = np.repeat(keep, sizes)
            heapq.heappush(waiting, (-int(bounds.max()), tie, level, nodes[keep], bounds[keep], sizes[keep], low[ranges], high[ranges], w[ranges]))
        return list(zip(scores.tolist(), places.tolist(), strict=True))


INDEX = "terms binary, starts binary, impacts binary, bits binary, ids binary, unknown bigint"


def indexed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """A row a shard of docs (as Shard takes it; unknown: how many of the first ids are null), and the number of documents that have terms. Tasks index what they read; nothing is shuffled."""
    n = F.regexp_count(text, F.lit(PATTERN))
    documents, length = docs.agg(F.count(F.when(n > 0, 1)), F.coalesce(F.sum(n), F.lit(0))).first()

    def shard(keys: list, lengths: list[int], lists: dict[bytes, int], term: list[int], count: list[int], sizes: list[int]) -> list[pa.Array]:
        order = np.lexsort((np.array([k or 0 for k in keys]), np.array([k is not None for k in keys])))
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        m = np.repeat([10 + 90 * n * documents // length for n in lengths], sizes)
        tf = np.array(count, dtype=np.int64)
        ids = np.array([k or 0 for k in keys], dtype=np.int64)[order]
        made = Shard.packed(list(lists), np.array(term), np.repeat(place, sizes), 1_000_000_000 * tf // (1000 * tf + 8 * m), ids)
        return [*(pa.array([x], pa.binary()) for x in made), pa.array([sum(k is None for k in keys)], pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        fresh = lambda: ([], [], defaultdict(), [], [], [])
        keys, lengths, lists, term, count, sizes = fresh()
        lists.default_factory = lists.__len__
        for batch in batches:
            for k, value in zip(*batch.columns, strict=True):
                own = terms_of(value.as_py())
                if not own:
                    continue
                counts = Counter(own)
                if keys and len(term) + len(counts) > POSTINGS:
                    yield pa.record_batch(shard(keys, lengths, lists, term, count, sizes), names=names)
                    keys, lengths, lists, term, count, sizes = fresh()
                    lists.default_factory = lists.__len__
                keys.append(k.as_py())
                lengths.append(len(own))
                term.extend(map(lists.__getitem__, counts))
                count.extend(counts.values())
                sizes.append(len(counts))
        if keys:
            yield pa.record_batch(shard(keys, lengths, lists, term, count, sizes), names=names)

    return docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInArrow(run, INDEX), documents


def holders(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How many documents of the index hold each of the wanted terms."""
    told = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(*batch.columns, strict=True):
                sizes = np.diff(np.frombuffer(starts.as_buffer(), dtype=np.int64))
                own = [(t, int(n)) for t, n in zip(terms.as_py().split(b"\n"), sizes, strict=True) if t in told.value]
                yield pa.record_batch([pa.array([t for t, _ in own], pa.binary()), pa.array([n for _, n in own], pa.int64())], names=["term", "n"])

    found = index.select("terms", "starts").mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in found.toLocalIterator()}


def searched(index: DataFrame, items: list[dict[bytes, int]], least: list[int], top: int) -> DataFrame:
    """(item, score, doc_id): for each item (weights of its terms), a number, the best documents of every task that score least[item] and more; among them the best of all."""
    told = index.sparkSession.sparkContext.broadcast((items, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, bounds = told.value
        bounds, found = list(bounds), [[] for _ in wanted]
        for batch in batches:
            for *parts, unknown in zip(*batch.columns, strict=True):
                shard, unknown = Shard(*(p.as_py() for p in parts)), unknown.as_py()
                for i, weights in enumerate(wanted):
                    if own := shard.best(weights, bounds[i], top):
                        known = [(-score, place >= unknown, int(shard.ids[place])) for score, place in own]
                        found[i] = sorted(found[i] + known)[:top]
                        if len(found[i]) == top:
                            bounds[i] = max(bounds[i], -found[i][-1][0])
        rows = [(i, -score, doc if known else None) for i, own in enumerate(found) for score, known, doc in own]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "score", "doc_id"])

    return index.drop("shard").mapInArrow(run, "item int, score bigint, doc_id bigint")


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of highest score above 0 of each item, equal scores by ascending key (null first).

    Terms are runs of letters and digits of ASCII and of all other characters, A-Z lower-cased. A document's score sums over the item's terms, once each,
    w * ((10^9 * tf) div (1000 * tf + 8 * m)): w falls with the number of documents that hold the term, m grows with the document's length.
    All documents are indexed, in shards of about POSTINGS postings that tasks make of what they read. A share of the shards is searched first; the
    scores found there bound the search of all. Items are searched in rounds of about TERMS terms, of which each is broadcast.

    Null texts have no terms; texts of any length are read whole. Rows that repeat a key are documents of their own; an item whose
    id repeats has the terms of all its rows, and a null id is an item. Empty tables give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind, name = items.schema[item].dataType.simpleString(), "item"
    index, documents = indexed(docs, key, text)
    index = stored(index.withColumn("shard", F.xxhash64("ids", "impacts")))
    total = items.agg(F.sum(F.regexp_count(item_text, F.lit(PATTERN)))).first()[0] or 0
    rounds, results = -(-total // TERMS), []
    for turn in range(rounds):
        own: dict = defaultdict(set)
        for r in items.where(F.pmod(F.xxhash64(item), F.lit(rounds)) == turn).select(F.col(item).alias("i"), F.col(item_text).alias("t")).toLocalIterator():
            own[r["i"]] |= set(terms_of(r["t"]))
        df = holders(index, set().union(*own.values()))
        weights = [{t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in sorted(terms) if t in df} for terms in own.values()]
        some = searched(index.where(F.pmod("shard", F.lit(SAMPLED)) == 0), weights, [1] * len(weights), top)
        nth = Window.partitionBy(name).orderBy(F.desc("score"))
        bounds = {r[name]: r["score"] for r in some.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") == top).select(name, "score").toLocalIterator()}
        found = searched(index, weights, [bounds.get(i, 1) for i in range(len(weights))], top)
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy(name).orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(own)), f"item int, id {kind}")
        results.append(stored(best.join(names, name).select(F.col("id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(key), "score")))
    if not results:
        return spark.createDataFrame([], f"`{item}` {kind}, rank int, `{key}` bigint, score bigint")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


RANKED_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS whole FROM d WHERE len(terms) > 0),
i AS (SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark),
p0 AS (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM p0 GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // whole))))::BIGINT AS score FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""
