"""Repeated passages: every byte that a long string covers which also starts earlier, by sorting suffixes deep-shallow.

Of all strings of LONG bytes only those can repeat that share an anchor with another: the least of the hashed grams in it, so that
equal strings have the same one at the same place. A run of strings of one document with one anchor is a segment. Equal segments are told by
their digests; of different segments about the same gram the suffixes are sorted, and strings of equal first LONG bytes found side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetflow.llm.common import U64, mix64
from facetflow.operators.skew import parts_of
from facetflow.session import discard, shared_dir, stored

LONG, GRAM = 100, 32
SHALLOW = 48  # bytes that multikey quicksort looks at; what is equal up to there goes into a blind trie
SAMPLED = 16  # a share of the texts that hot grams are looked for in
FLUSH = 1 << 20  # segments of a task that are held together
SORTED = 1 << 24  # bytes of segments that are sorted at once
HOT = 10_000  # different segments about one gram from which their strings are dealt out one by one
TEXT = 1 << 24  # bytes of a text that are hashed at once


# --- deep-shallow sorting


def words_at(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at `depth` of each suffix as one big-endian number; data is padded."""
    out = np.zeros(len(starts), dtype=U64)
    for i in range(8):
        out = out << U64(8) | data[starts + (depth + i)].astype(U64)
    return out


def blind(data: bytes, starts: list[int], depth: int, end: int) -> Iterator[list[int]]:
    """Suffixes that are equal up to `depth`, in groups of those equal up to `end`, the groups in order: by a blind trie.

    A node (depth, branches by the byte there) holds no more of the strings than where they part. A suffix goes down blindly by its bytes at the nodes'
    depths, is compared once with the leaf it comes to, and its new branch is put where they differ. Leaves are lists of equal suffixes.
    """
    root: list | dict = [starts[0]]
    for start in starts[1:]:
        path, node = [], root
        while isinstance(node, dict):
            path.append(node)
            branches = node["next"]
            node = branches.get(data[start + node["at"]]) or next(iter(branches.values()))
        other = node[0]
        a, b = data[start + depth : start + end], data[other + depth : other + end]
        if a == b:
            node.append(start)
            continue
        low, high = 0, len(a)
        while high - low > 1:  # the first byte that differs
            middle = (low + high) // 2
            low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
        at = depth + low
        above = [n for n in path if n["at"] < at]
        below = path[len(above)] if len(above) < len(path) else node
        if len(above) < len(path) and below["at"] == at:
            below["next"][data[start + at]] = [start]
            continue
        fresh = {"at": at, "next": {data[other + at]: below, data[start + at]: [start]}}
        if above:
            above[-1]["next"][data[start + above[-1]["at"]]] = fresh
        else:
            root = fresh
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            waiting += [node["next"][b] for b in sorted(node["next"], reverse=True)]
        else:
            yield node


def equal_groups(data: bytes, starts: np.ndarray, end: int = LONG) -> np.ndarray:
    """For each suffix of data that starts there the number of its group: suffixes are in one group if their first `end` bytes are equal, and groups are numbered in the order of the suffixes. Each suffix has that many bytes.

    Deep-shallow: multikey quicksort, a word of eight bytes at a time and all open ranges at once, to SHALLOW bytes; pairs that are
    then still equal are compared, larger groups put in order by a blind trie.
    """
    n = len(starts)
    padded = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(8, dtype=np.uint8)])
    order = np.arange(n)
    head = np.zeros(n, dtype=np.int64)  # of each place in the order the first place of its range
    open_ = np.arange(n if n > 1 else 0)  # places in ranges of two and more
    shallow = min(SHALLOW, end // 8 * 8)
    for depth in range(0, shallow, 8):
        if not len(open_):
            break
        own = order[open_]
        word, range_ = words_at(padded, starts[own], depth), head[open_]
        by = np.lexsort((word, range_)) if depth else np.argsort(word, kind="stable")
        order[open_], word = own[by], word[by]
        first = np.ones(len(open_), dtype=bool)
        first[1:] = (word[1:] != word[:-1]) | (range_[1:] != range_[:-1])
        head[open_] = open_[np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))]
        last = np.append(first[1:], True)
        open_ = open_[~(first & last)]
    if len(open_) and shallow < end:
        first = np.flatnonzero(np.append(True, head[open_][1:] != head[open_][:-1]))
        sizes = np.diff(np.append(first, len(open_)))
        # pairs part at one place: which of them is less is all there is to find
        at = open_[first[sizes == 2]]
        if len(at):
            a, b = starts[order[at]], starts[order[at + 1]]
            same, less = np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
            for depth in range(shallow, end, 4):
                x, y = (sum(padded[s + (depth + i)].astype(np.int64) << (8 * (3 - i)) for i in range(min(4, end - depth))) for s in (a, b))
                less |= same & (x < y)
                same &= x == y
            parted = at[~same]
            swap = parted[~less[~same]]
            order[swap], order[swap + 1] = order[swap + 1], order[swap].copy()
            head[parted + 1] = parted + 1
        for f, size in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            at = int(open_[f])
            own = order[at : at + size]
            by_start = dict(zip(starts[own].tolist(), own.tolist(), strict=True))
            for group in blind(data, list(by_start), shallow, end):
                order[at : at + len(group)] = [by_start[s] for s in group]
                head[at : at + len(group)] = at
                at += len(group)
    out = np.empty(n, dtype=np.int64)
    out[order] = np.cumsum(np.append(False, head[1:] != head[:-1])) if n else 0
    return out


# --- anchors and segments


def grams(raw: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM bytes, by doubling."""
    h, factor, size = raw.astype(U64) + U64(1), U64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * factor + h[size:]
            factor, size = factor * factor, size * 2
    return mix64(h)


def anchored(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, last string, anchor, gram) of the segments of a text of LONG bytes or more: every string of LONG bytes is in the segment of its anchor, the first of the least grams in it."""
    h = grams(raw)
    low = (h >> U64(32) << U64(32)) | np.arange(len(h), dtype=U64)
    wide, size = LONG - GRAM + 1, 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :]) & U64(0xFFFFFFFF)
    change = np.flatnonzero(low[1:] != low[:-1])
    first, last = np.append(0, change + 1), np.append(change, len(low) - 1)
    anchor = low[first].astype(np.int64)
    return first, last, anchor, h[anchor].view(np.int64)


def segments(raw: bytes) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, gram, digest) of the segments of a text, which is taken in pieces of TEXT bytes. A digest is of a segment's bytes and its anchor's place."""
    parts = []
    for at in range(0, max(len(raw) - LONG + 1, 0), TEXT):
        piece = np.frombuffer(raw, dtype=np.uint8)[at : at + TEXT + LONG - 1]
        first, last, anchor, gram = anchored(piece)
        parts.append((first + at, last + at, anchor + at, gram))
    first, last, anchor, gram = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 4
    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    found = np.fromiter((digest(view[a : b + LONG], seed=c - a) for a, b, c in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)), dtype=U64, count=len(first))
    return first, last, anchor, gram, found.view(np.int64)


ROW = "id bigint, sub bigint, gram bigint, digest bigint, first bigint, size bigint, again boolean"


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def singles(raw: bytes, first: np.ndarray, last: np.ndarray, gram: np.ndarray, digest: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """The segments (first, last, gram, digest), those about a hot gram as segments of one string each, with two hashes of the string in place of gram and digest."""
    at = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
    own = hot[at] == gram
    if not own.any():
        return first, last, gram, digest
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[own].tolist(), last[own].tolist(), strict=True)])
    view = memoryview(raw)
    two = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[p : p + LONG]) for p in starts.tolist()), dtype=np.int64).reshape(-1, 2)
    keep = ~own
    return np.append(first[keep], starts), np.append(last[keep], starts), np.append(gram[keep], two[:, 0]), np.append(digest[keep], two[:, 1])


def merged(id_: np.ndarray, sub: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings of one text, in order, as few as there can be where one begins right after another ends."""
    order = np.lexsort((first, sub, id_))
    id_, sub, first, size = (x[order] for x in (id_, sub, first, size))
    if not len(first):
        return id_, sub, first, size
    fresh = np.append(True, (id_[1:] != id_[:-1]) | (sub[1:] != sub[:-1]) | (first[1:] != first[:-1] + size[:-1]))
    at = np.flatnonzero(fresh)
    return id_[at], sub[at], first[at], np.add.reduceat(size, at)


def candidates(texts: DataFrame, hot: list[int]) -> DataFrame:
    """(id, sub, gram, digest, first, size, again) of the segments of texts (id, sub, text): strings first to first + size - 1. again: an equal segment of the same task comes earlier.

    Of equal segments that a task holds together only the earliest has to meet those of other tasks; the others go as
    merged runs. So what many texts share is sent once a flush of a task.
    """
    known = np.array(sorted(hot), dtype=np.int64)

    def out(own: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        id_, sub, gram, digest, first, size = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.lexsort((first, sub, id_, digest, gram))
        id_, sub, gram, digest, first, size = (x[order] for x in (id_, sub, gram, digest, first, size))
        again = np.append(False, (gram[1:] == gram[:-1]) & (digest[1:] == digest[:-1]) & (size[1:] == size[:-1]))
        again[1:] &= (id_[1:] != id_[:-1]) | (sub[1:] != sub[:-1]) | (first[1:] != first[:-1])
        runs = merged(id_[again], sub[again], first[again], size[again])
        keep, none = ~again, np.zeros(len(runs[0]), dtype=np.int64)
        spread = mix64((runs[0] ^ runs[2]).view(U64)).view(np.int64)  # so that they don't meet
        columns = [(id_[keep], runs[0]), (sub[keep], runs[1]), (gram[keep], spread), (digest[keep], none), (first[keep], runs[2]), (size[keep], runs[3])]
        return pa.record_batch([*(pa.array(np.concatenate(c)) for c in columns), pa.array(np.arange(len(none) + keep.sum()) >= keep.sum())], names=["id", "sub", "gram", "digest", "first", "size", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = [], 0
        for batch in batches:
            for id_, sub, text in zip(*batch.columns, strict=True):
                raw = bytes_of(text.as_py())
                first, last, _, gram, digest = segments(raw)
                if len(known) and len(first):
                    first, last, gram, digest = singles(raw, first, last, gram, digest, known)
                if n := len(first):
                    own.append((np.full(n, id_.as_py()), np.full(n, sub.as_py()), gram, digest, first, last - first + 1))
                    held += n
                if held >= FLUSH:
                    yield out(own)
                    own, held = [], 0
        if own:
            yield out(own)

    return texts.mapInArrow(run, ROW)


def hot_grams(texts: DataFrame) -> list[int]:
    """Grams about which a sample of the texts has so many different segments that all have more than HOT and the HOT_KEYS-th part of all, roughly; fewer than HOT_KEYS. They change how strings are dealt out, not which are found."""
    sample = candidates(texts.where(F.pmod(F.xxhash64("id", "sub"), F.lit(SAMPLED)) == 0), []).where("not again").groupBy("gram").agg(F.count("*").alias("size"))
    parts = parts_of(stored(sample), "gram", "size", HOT // SAMPLED)
    return [r["gram"] for r in parts.toLocalIterator()] if parts is not None else []


def met(rows: DataFrame) -> DataFrame:
    """candidates() that an earlier one covers, and (open) those about a gram that has different segments."""
    known = Window.partitionBy("gram", "again")
    earlier = known.orderBy("digest", "id", "sub", "first")
    own, last = F.struct("id", "sub", "first"), lambda c: F.lag(c).over(earlier)
    equal = (last("digest") == F.col("digest")) & (last("size") == F.col("size")) & (last(own) != own)
    told = rows.withColumn("covered", F.col("again") | F.coalesce(equal, F.lit(False))).withColumn("open", ~F.col("again") & (F.min("digest").over(known) < F.max("digest").over(known)))
    return told.where("covered or open").select("id", "sub", "gram", "first", "size", "covered")


def beside(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Each text (id, sub, text) before its rows (id, sub, first, size and others), those by first: in a sort that may spill, so that a task holds one text. Rows that repeat a text follow it."""
    both = texts.unionByName(rows, allowMissingColumns=True)
    return both.repartition("id", "sub").sortWithinPartitions("id", "sub", F.col("text").isNull(), "first")


def contents(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """open_ (id, sub, gram, first, size) with the bytes of its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = b""
        for batch in batches:
            at, found = [], []
            for i, (text, first, size) in enumerate(zip(batch.column("text"), batch.column("first"), batch.column("size"), strict=True)):
                if text.is_valid:
                    raw = text.as_py()
                else:
                    at.append(i)
                    found.append(raw[first.as_py() : first.as_py() + size.as_py() + LONG - 1])
            rows = batch.select(["id", "sub", "gram", "first", "size"]).take(pa.array(at, pa.int64()))
            yield pa.record_batch([*rows.columns, pa.array(found, pa.binary())], names=[*rows.schema.names, "raw"])

    binary = texts.withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    return beside(binary, open_).select("id", "sub", "text", "gram", "first", "size").mapInArrow(run, "id bigint, sub bigint, gram bigint, first bigint, size bigint, raw binary")


def compared(rows: DataFrame) -> DataFrame:
    """(id, sub, first, size): runs of strings of contents() that start earlier about the same gram. The suffixes of whole grams are sorted, about SORTED bytes at once."""

    def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        id_, sub, first, size = (whole.column(c).to_numpy() for c in ("id", "sub", "first", "size"))
        texts = whole.column("raw").to_pylist()
        base = np.append(0, np.cumsum([len(t) for t in texts]))[:-1]
        row = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        group = equal_groups(b"".join(texts), base[row] + step)
        id_, sub, first = id_[row], sub[row], first[row] + step
        order = np.lexsort((first, sub, id_, group))
        id_, sub, first, group = (x[order] for x in (id_, sub, first, group))
        later = np.append(False, (group[1:] == group[:-1]) & ((id_[1:] != id_[:-1]) | (sub[1:] != sub[:-1]) | (first[1:] != first[:-1])))
        return pa.record_batch([pa.array(x) for x in merged(id_[later], sub[later], first[later], np.ones(later.sum(), dtype=np.int64))], names=["id", "sub", "first", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            grams_ = batch.column("gram").to_numpy()
            change = np.flatnonzero(np.append(last is not None and grams_[0] != last, grams_[1:] != grams_[:-1])) if len(grams_) else []
            at = 0
            for c in [*change, len(grams_)]:  # whole grams only
                if at < c:
                    held.append(batch.slice(at, c - at))
                    size += held[-1].column("raw").nbytes
                    at = c
                if c < len(grams_) and size >= SORTED:
                    yield out(held)
                    held, size = [], 0
            last = grams_[-1] if len(grams_) else last
        if held:
            yield out(held)

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "id bigint, sub bigint, first bigint, size bigint")


def trimmed(texts: DataFrame, covered: DataFrame) -> DataFrame:
    """A row a text (id, sub, text): id, n_bytes, spans (start, end) removed, and the bytes kept. covered: (id, sub, first, size). Of texts that repeat an id and text the first is trimmed, the others are what it is already."""
    kind = "id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def kept(raw: bytes, runs: list[tuple[int, int]]) -> tuple[list[dict], bytes]:
        spans, at, parts = [], 0, []
        for first, size in runs:
            end = first + size + LONG - 1
            if spans and first <= spans[-1]["end"]:
                spans[-1]["end"] = max(end, spans[-1]["end"])
            else:
                spans.append({"start": first, "end": end})
        for s in spans:
            parts.append(raw[at : s["start"]])
            at = s["end"]
        return spans, b"".join([*parts, raw[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, raw, runs = None, b"", []
        rows: list[tuple] = []

        def done() -> pa.RecordBatch:
            ids, sizes, spans, texts_ = zip(*rows, strict=True) if rows else ([], [], [], [])
            rows.clear()
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(texts_, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

        held = 0
        for batch in batches:
            for id_, sub, text, first, size in zip(*batch.columns, strict=True):
                if not text.is_valid:
                    runs.append((first.as_py(), size.as_py()))
                    continue
                key = (id_.as_py(), sub.as_py())
                if key == own:  # a repeated row
                    whole = len(raw) >= LONG
                    rows.append((key[0], len(raw), [{"start": 0, "end": len(raw)}] if whole else [], b"" if whole else raw))
                else:
                    if own:
                        rows.append((own[0], len(raw), *kept(raw, runs)))
                    own, raw, runs = key, text.as_py(), []
                    held += len(raw)
                if held > SORTED:
                    yield done()
                    held = 0
        if own:
            rows.append((own[0], len(raw), *kept(raw, runs)))
        yield done()

    binary = texts.withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    return beside(binary, covered).select("id", "sub", "text", "first", "size").mapInArrow(run, kind)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: key, n_bytes, spans (array of start, end: the maximal runs of bytes removed), kept (binary: the other bytes).

    A byte is removed if a string of LONG bytes that covers it also starts earlier: in a text of a smaller key, or in the same text further left.
    Strings are those of the whole texts as UTF-8, and never reach over a text's end. A null text is empty. A null key counts as the smallest; texts of one key come in the order of a
    hash of theirs; rows that repeat a key and text come one after another. An empty table gives an empty result; other columns are ignored.
    """
    spark, least = docs.sparkSession, -(1 << 63)
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(least)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("sub"), F.col(text).alias("text"))
    unlike = rows.groupBy("id").agg((F.min("sub") < F.max("sub")).alias("unlike")).where("unlike")
    if unlike.isEmpty():
        rows = rows.withColumn("sub", F.lit(0).cast("bigint"))
    folder = f"{shared_dir(spark)}/repeats-{uuid.uuid4().hex}"
    told = stored(met(candidates(rows, hot_grams(rows))), folder)
    open_ = told.where("not covered").select("id", "sub", "gram", "first", "size")
    covered = stored(told.where("covered").select("id", "sub", "first", "size").unionByName(compared(contents(rows, open_))), f"{folder}-covered")
    discard(spark, folder)
    return trimmed(rows, covered).select(F.when(F.col("id") != least, F.col("id")).alias(key), "n_bytes", "spans", "kept")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of without_repeats()."""
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(docs).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same by the plain way: every string of 100 bytes, as 200 hexadecimal digits, by its digest.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(greatest(length(h) // 2 - 99, 0)), lambda p: md5_number(substr(h, 2 * p + 1, 200)))) AS m, generate_subscripts(range(greatest(length(h) // 2 - 99, 0)), 1) - 1 AS p FROM d),
s AS (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id NULLS FIRST, p) AS r FROM w),
c AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS fresh FROM s WHERE r > 1),
g AS (SELECT doc_id, p, sum(coalesce(fresh, false)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM c),
sp AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, k),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS n, max(b) AS last FROM sp GROUP BY doc_id),
kp AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM sp UNION ALL SELECT d.doc_id, coalesce(last, 0), length(h) // 2 FROM d LEFT JOIN t ON t.doc_id IS NOT DISTINCT FROM d.doc_id),
k AS (SELECT kp.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM kp JOIN d ON d.doc_id IS NOT DISTINCT FROM kp.doc_id GROUP BY kp.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id IS NOT DISTINCT FROM d.doc_id JOIN k ON k.doc_id IS NOT DISTINCT FROM d.doc_id
"""
