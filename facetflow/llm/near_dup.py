"""Near duplicates by Order MinHash, verified by banded alignment of word shingles."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import U64, mix64
from facetflow.operators.graph import components
from facetflow.operators.skew import copied, dealt, met, parts_of
from facetflow.session import discard, shared_dir, stored

WORDS, SIMILARITY = 5, 0.8
SKETCHES, PICKED, AT_ONCE = 12, 2, 1 << 16
SAMPLED, COMMON = 8, 1 << 17  # a share of the texts, and a number of shingles, that the order of least_first() is made from
HOT = 10_000  # rows of a key (of texts: a tenth of it) from which a join deals it out in parts
Keep = Callable[[DataFrame], DataFrame]  # cuts the lineage of a table that is read several times
SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64))[:, None]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the runs of five words; of a shorter text the one run that it is."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))
    k = min(WORDS, len(h))
    out = np.zeros(len(h) - k + 1, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        return mix64(out + U64(k))


def occurrences(h: np.ndarray) -> np.ndarray:
    """How many times each shingle came before."""
    order = np.argsort(h, kind="stable")
    own = h[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out = np.empty(len(h), dtype=np.int64)
    out[order] = np.arange(len(h)) - np.repeat(starts, np.diff([*starts, len(h)]))
    return out


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles with the number of times that each came before mixed in, so that all of a text are distinct."""
    before = occurrences(h).astype(U64)
    again = before > 0
    if not again.any():
        return h
    out = h.copy()
    with np.errstate(over="ignore"):
        out[again] = mix64(h[again] + before[again] * U64(0xD6E8FEB86659FD93))
    return out


def sketch(own: np.ndarray) -> np.ndarray:
    """For each of SKETCHES orders the hash of the PICKED least labelled shingles, in text order, and the order's number."""
    k, found = min(PICKED, len(own)), []
    for start in range(0, len(own), AT_ONCE):
        rank = mix64(own[None, start : start + AT_ONCE] ^ SEEDS)
        found.append(start + (np.argpartition(rank, k - 1, axis=1)[:, :k] if k < rank.shape[1] else np.tile(np.arange(rank.shape[1]), (SKETCHES, 1))))
    at = found[0]
    if len(found) > 1:
        at = np.concatenate(found, axis=1)
        at = np.take_along_axis(at, np.argpartition(mix64(own[at] ^ SEEDS), k - 1, axis=1)[:, :k], axis=1)
    at.sort(axis=1)
    out = SEEDS[:, 0].copy()
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * U64(0x100000001B3) + own[at[:, i]])
    return out.view(np.int64)


def raw_digest(text: str) -> Column:
    """Tells rows of one key with different texts apart."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of docs: id, raw (digest of the text), text_key (digest of the lower-cased words; null without words), n (shingles), sketch."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, sizes, sketches = [], [], []
                for value in part.column(2):
                    words = words_of(value.as_py())
                    h = shingles(words) if words else ()
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                    sizes.append(len(h))
                    sketches.append(sketch(labelled(h)) if words else [])
                yield pa.record_batch([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "raw", "text_key", "n", "sketch"])

    rows = docs.select(F.col(key).alias("id"), raw_digest(text).alias("raw"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, raw string, text_key binary, n bigint, sketch array<bigint>")


def banded(x: list[int], y: list[int], left: int, right: int) -> int:
    """The most shingles of x and y that match in order with x[i] against y[i - left] to y[i + right] only (or a little more, never more than without a band).

    Row by row a bit vector as wide as the band: a zero stands where one more match than in the column before is possible.
    """
    width = left + right + 1
    full, block = (1 << width) - 1, max(width, 1024)
    row, behind, places = full, 0, {}
    for i, s in enumerate(x):
        at = i % block  # of the window's first column, y[i - left], in the two blocks of columns at hand
        if at == 0:
            places = {}
            for p, t in enumerate(y[max(i - left, 0) : i - left + 2 * block], max(left - i, 0)):
                places[t] = places.get(t, 0) | 1 << p
        if i:
            behind += ~row & 1
            row = row >> 1 | 1 << (width - 1)
        here = places.get(s, 0) >> at & full
        if here:
            up = row & here
            row = (row + up | row - up) & full
    return behind + width - row.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Shingles matched in order, over all shingles of both less these; 0 where that is less than `similarity`.

    What texts of that similarity must have in common, with multiplicity, is looked at first. What begins and ends
    alike matches; between, the band is widened until what doesn't match fits in it, or until any alignment of that
    similarity would. Work is the texts' length times the band's width in machine words.
    """
    least = math.ceil(similarity * (len(a) + len(b)) / (1 + similarity) - 1e-9)
    short = min(len(a), len(b))
    if least > short or len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < least:
        return 0.0
    head = (np.flatnonzero(a[:short] != b[:short]).tolist() or [short])[0]
    rest = short - head
    tail = (np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1]).tolist() or [rest])[0]
    x, y = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    matched = head + tail
    if x and y:
        left, right, width = len(a) - least, len(b) - least, 32
        while True:
            found = banded(x, y, min(left, width), min(right, width))
            if width >= max(left, right) or (len(x) - found <= width and len(y) - found <= width):
                break
            width *= 4
        matched += found
    return matched / (len(a) + len(b) - matched) if matched >= least else 0.0


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, similarity: float, keep: Keep = stored) -> DataFrame:
    """pairs (a, a_id, b, b_id) with `similar`: whether the texts of the two keys align. Texts are fetched by id and held to their key; a hub of many pairs is dealt out in parts. Texts are always shuffled, so that the plan is the same at every size."""
    pairs = keep(pairs)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    hot = parts_of(pairs.groupBy("a_id").count(), "a_id", "count", HOT // 10)
    pairs = dealt(pairs, hot, "a_id", "b")
    hubs = pairs.select("a_id", "part").distinct().join(texts.select(F.col("id").alias("a_id"), F.col("text").alias("a_text")).hint("merge"), "a_id")
    joined = pairs.join(texts.select(F.col("id").alias("b_id"), F.col("text").alias("b_text")).hint("merge"), "b_id").join(hubs.hint("merge"), ["a_id", "part"]).select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, dtype=U64))
        for batch in batches:
            rows = ([], [], [])
            for a, b, a_text, b_text in zip(*batch.columns, strict=True):
                a, b = a.as_py(), b.as_py()
                if last[0] != a:
                    words = words_of(a_text.as_py())
                    if xxhash.xxh3_128_digest(b" ".join(words)) != a:
                        continue
                    last = (a, shingles(words))
                words = words_of(b_text.as_py())
                if xxhash.xxh3_128_digest(b" ".join(words)) == b:
                    for column, value in zip(rows, (a, b, aligned(last[1], shingles(words), similarity) > 0), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.bool_())], names=["a", "b", "similar"])

    return joined.mapInArrow(run, "a binary, b binary, similar boolean").distinct()


def starred(members: DataFrame, keep: Keep = stored) -> DataFrame:
    """members (bucket, text_key, id, n, class, weight) of buckets of two texts and more, with their bucket's hub, how many they are and whether they are of one class.

    The hub is the text of the greatest weight (ties: the least id): the texts that share its buckets with it,
    counted by bucket. The text that a group of copies stems from agrees with most of them, and so is the hub of all.
    Members of a hot bucket meet its hub in several parts.
    """
    own = F.struct((-F.col("weight")).alias("less"), "id", "text_key", "n", "class")
    hubs = keep(members.groupBy("bucket").agg(F.min(own).alias("hub"), F.count("*").alias("texts"), (F.min("class") == F.max("class")).alias("one")).where("texts > 1"))
    return met(members, hubs, parts_of(hubs, "bucket", "texts", HOT), "bucket", "text_key")


def weighed(members: DataFrame, keep: Keep = stored) -> DataFrame:
    """members of buckets of two texts and more, with weight: the sizes of a text's buckets together."""
    sizes = keep(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    shared = keep(met(members, sizes, parts_of(sizes, "bucket", "size", HOT), "bucket", "text_key"))
    return shared.drop("size").join(shared.groupBy("text_key").agg(F.sum("size").alias("weight")), "text_key")


def paired(stars: DataFrame, similarity: float) -> DataFrame:
    """Pairs of hub and member of different classes, that sizes allow to be similar; each once."""
    near = (F.least("n", "hub.n") >= similarity * F.greatest("n", "hub.n") - 1e-9) & (F.col("class") != F.col("hub.class"))
    return stars.where(near).select(F.col("hub.text_key").alias("a"), F.col("hub.id").alias("a_id"), F.col("text_key").alias("b"), F.col("id").alias("b_id")).distinct()


def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    known = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(known, ["a", "b"], "left_anti")


def classed(members: DataFrame, tested: DataFrame) -> DataFrame:
    """members with the class that the links found so far give within two steps: the hub that took a text in, or that hub's own. Texts of one component may still differ here; they are then tested once more, no link is lost."""
    parent = tested.where("similar").groupBy(F.col("b").alias("text_key")).agg(F.min("a").alias("parent"))
    second = parent.select(F.col("text_key").alias("parent"), F.col("parent").alias("second"))
    found = parent.join(second, "parent", "left").select("text_key", F.coalesce("second", "parent").alias("found"))
    return members.drop("class").join(found, "text_key", "left").withColumn("class", F.coalesce("found", "text_key")).drop("found")


def links(texts: DataFrame, docs: DataFrame, key: str, text: str, similarity: float, keep: Keep = stored) -> DataFrame:
    """Tested pairs (a, b, similar) of texts (text_key, id, n, sketch) that span the classes of similar ones.

    Texts that share a sketch share a bucket. Each is aligned with its bucket's hub. Buckets of three and more
    texts that this leaves in several classes are split by each of the other sketches, and again aligned with a hub. Where a
    bucket still has several classes, its texts of different classes are aligned with each other if they share one of the shingles that similar texts must share.
    """
    members = weighed(texts.select("text_key", "id", "n", F.explode("sketch").alias("bucket"), F.col("text_key").alias("class")), keep)
    members = keep(starred(members, keep))
    tested = keep(verified(paired(members, similarity), docs, key, text, similarity, keep))
    columns = ["bucket", "text_key", "id", "n", "class", "weight"]
    open_ = keep(starred(classed(members.where("texts > 2").select(*columns), tested), keep).where("not one").select(*columns))
    if open_.isEmpty():
        return tested
    # the texts that their hub did not take in, each bucket split by the other sketches
    split = open_.join(texts.select("text_key", "sketch"), "text_key").select("text_key", "id", "n", "class", F.col("bucket").alias("outer"), F.explode("sketch").alias("inner")).where(F.col("inner") > F.col("outer"))
    split = keep(starred(weighed(split.withColumn("bucket", F.xxhash64("outer", "inner")).drop("outer", "inner"), keep), keep).where("not one"))
    more = keep(verified(untested(paired(split, similarity), tested), docs, key, text, similarity, keep))
    tested = keep(tested.unionByName(more))
    open_ = keep(starred(classed(open_, tested), keep).where("not one AND texts > 2").select(*columns))
    if open_.isEmpty():
        return tested
    return keep(tested.unionByName(verified(untested(crossed(open_, docs, key, text, similarity, keep), tested), docs, key, text, similarity, keep)))


def with_shingles(keys: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """keys (text_key, id, n, class) with the labelled shingles of their texts."""
    names = ["text_key", "id", "n", "class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (own, value) in enumerate(zip(batch.column("text_key"), batch.column("text"), strict=True)):
                words = words_of(value.as_py())
                if xxhash.xxh3_128_digest(b" ".join(words)) == own.as_py():
                    at.append(i)
                    found.append(labelled(shingles(words)).view(np.int64))
            rows = batch.select(names).take(pa.array(at, pa.int64()))
            yield pa.record_batch([*rows.columns, pa.array(found, pa.list_(pa.int64()))], names=[*names, "shingles"])

    kind = keys.schema["id"].dataType.simpleString()
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(keys.hint("merge"), "id").select(*names, "text")
    return texts.mapInArrow(run, f"text_key binary, id {kind}, n bigint, class binary, shingles array<bigint>").dropDuplicates(["text_key"])


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several of a sample of texts (text_key, shingles), the COMMON most frequent ones at most, by value; and their places, the least frequent first."""
    sample = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLED)) == 0).select(F.explode("shingles").alias("shingle"))
    counts = sample.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(COMMON)
    found = np.array([r["shingle"] for r in counts.select("shingle").collect()], dtype=np.int64)
    order = np.argsort(found)
    return found[order], len(found) - order


def least_first(h: np.ndarray, common: np.ndarray, places: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a text's labelled shingles that each similar text has one of them among its own: all but the share they must have in common, and one more.

    The order, in which these are the first, is the same for all texts: what is not in `common` by hash, then `common` by its
    places. It decides how many pairs meet and not whether similar ones do.
    """
    h, place = h.view(np.int64), np.zeros(len(h), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        place = np.where(common[at] == h, places[at], 0)
    return h[np.lexsort((h, place))[: len(h) - math.ceil(similarity * len(h) - 1e-8) + 1]]


def firsts(texts: DataFrame, similarity: float) -> DataFrame:
    """texts (text_key, id, n, class, shingles), a row for each shingle of least_first(), with its place."""
    common, places = common_shingles(texts)
    names = ["text_key", "id", "n", "class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [least_first(np.array(x.as_py(), dtype=np.int64), common, places, similarity) for x in batch.column("shingles")]
            yield pa.record_batch([*batch.select(names).columns, pa.array(first, pa.list_(pa.int64()))], names=[*names, "first"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select(*names, "shingles").mapInArrow(run, f"text_key binary, id {kind}, n bigint, class binary, first array<bigint>").select(*names, F.posexplode("first").alias("place", "shingle"))


def crossed(open_: DataFrame, docs: DataFrame, key: str, text: str, similarity: float, keep: Keep = stored) -> DataFrame:
    """Pairs of texts of open_ of different classes that sizes, and the places of a shared shingle in least_first(), allow to be similar; each once. No similar pair is left out."""
    columns = ["text_key", "id", "n", "class", "place"]
    own = firsts(keep(with_shingles(open_.select("text_key", "id", "n", "class").distinct(), docs, key, text)), similarity)
    several = keep(own.groupBy("shingle").agg(F.count("*").alias("texts"), (F.min("class") < F.max("class")).alias("several")).where("several").select("shingle", "texts"))
    hot = parts_of(several, "shingle", "texts", HOT)
    own = keep(met(own, several.select("shingle"), hot, "shingle", "text_key"))
    other = copied(own.select("shingle", *[F.col(c).alias(f"{c}_b") for c in columns]), hot, "shingle")
    own = dealt(own, hot, "shingle", "text_key")
    near = F.least("n", "n_b") >= similarity * F.greatest("n", "n_b") - 1e-8
    enough = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) >= similarity * (F.col("n") + F.col("n_b")) / (1 + similarity) - 1e-8
    pairs = own.join(other, ["shingle", "part"]).where((F.col("text_key") < F.col("text_key_b")) & (F.col("class") != F.col("class_b")) & near & enough)
    return pairs.select(F.col("text_key").alias("a"), F.col("id").alias("a_id"), F.col("text_key_b").alias("b"), F.col("id_b").alias("b_id")).distinct()


def signed_classes(docs: DataFrame, key: str, text: str, similarity: float, within: str | None = None) -> DataFrame:
    """id, raw, text_key and class_id of every row of docs, and `stays`: whether its text is the one of its class that is kept. What the result reads is stored in the folder `within`."""
    keep = lambda df: stored(df, within)
    rows = keep(signed(docs, key, text))
    some = rows.where(F.col("text_key").isNotNull())
    texts = keep(some.groupBy("text_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "raw"))).alias("least")))
    folder = f"{shared_dir(docs.sparkSession)}/links-{uuid.uuid4().hex}"
    tested = links(texts.where(F.col("id").isNotNull()), docs, key, text, similarity, lambda df: stored(df, folder))
    found = components(tested.where("similar"), "a", "b").withColumnRenamed("node", "text_key")
    discard(docs.sparkSession, folder)  # the components are checkpointed
    own = keep(texts.select("text_key", "id", "least", "copies").join(found, "text_key", "left").withColumn("component", F.coalesce("component", "text_key")))
    least = keep(own.groupBy("component").agg(F.min("id").alias("class_id"), F.min("least").alias("kept"), F.count("*").alias("texts")))
    own = met(own, least, parts_of(least, "component", "texts", HOT), "component", "text_key")
    by_text = own.select("text_key", "class_id", "kept", "copies")
    hot = parts_of(texts, "text_key", "copies", HOT)
    known = met(some.select("id", "raw", "text_key"), by_text, hot, "text_key", "id").select("id", "raw", "text_key", F.coalesce("class_id", "id").alias("class_id"), (F.struct("id", "raw") == F.col("kept")).alias("stays"))
    return known.unionByName(rows.where(F.col("text_key").isNull()).select("id", "raw", "text_key", F.col("id").alias("class_id"), F.lit(True).alias("stays")))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: key, class_id, the least key of the row's class of copies and near copies.

    Two texts are linked if, as runs of five lower-cased words (of shorter texts the whole), what aligns in order, repeats with
    their number, is at least `similarity` of all runs of both. Classes are the components of the links. Candidates share at
    least one of 12 sketches of two least occurrence-labelled runs each in text order; a pair of similarity 0.8 shares none with a probability of
    about 5 in a million, where no run repeats.
    Null texts and texts without words are classes of their own. Rows without a key are grouped with exact copies
    only. Repeated rows are copies. Texts of any length are compared whole; alignment takes their length times the band's width.
    An empty table gives an empty result; other columns are ignored.
    """
    return signed_classes(docs, key, text, similarity).select(F.col("id").alias(key), "class_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class, that of the least key (ties: of the least digest of the text), all columns as they are; repeated rows once.

    Rows without a key and rows without words stay.
    """
    folder = f"{shared_dir(docs.sparkSession)}/classes-{uuid.uuid4().hex}"
    rows = stored(signed_classes(docs, key, text, similarity, folder).where(F.col("id").isNotNull() & F.col("text_key").isNotNull()), folder + "-rows")
    discard(docs.sparkSession, folder)
    gone = rows.where("not stays").select("id", "raw").distinct()
    again = rows.where("stays").groupBy("id", "raw").count().where("count > 1").drop("count")
    # a row travels whole, so that none of its columns can be taken for one of ours
    own = docs.select(F.col(key).alias("id"), raw_digest(text).alias("raw"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = own.join(gone.hint("merge"), ["id", "raw"], "left_anti")
    if not again.isEmpty():
        first = out.join(again, ["id", "raw"], "left_semi").dropDuplicates(["id", "raw"])
        out = out.join(again, ["id", "raw"], "left_anti").unionByName(first)
    return out.select("row.*")
