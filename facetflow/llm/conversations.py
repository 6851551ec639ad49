"""Conversation structure repair: a signature of roles and faults a conversation, each distinct one solved once, edits replayed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetflow.operators.skew import met, parts_of
from facetflow.session import stored

BLANKS = " \t\n\x0b\x0c\r"
RUN = 256  # turns whose rows are gathered to one piece of a signature
HOT = 10_000  # rows of a signature from which the join deals it out in parts
BLOCK = 128  # letters that are solved at once
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 62
# states of what is written so far: nothing, a system row, an open user row, a closed pair
START, SYSTEM, USER, PAIR = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, PAIR: USER}, "a": {USER: PAIR}, "x": {}}


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of every row after the damage that its id and turn call for; copies is 0 for a dropped row, 2 for a repeated one."""
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = text_of("text")
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """rows with row_key, a digest of role and text: equal rows have equal ones, and rows of one turn are taken in its order."""
    return rows.withColumn("row_key", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text")).cast("binary"))))


def signatures(rows: DataFrame) -> DataFrame:
    """One row a conversation of rows (conv_id, turn, role, text, copies): signature, gaps, blank, duplicate, truncated, illegal.

    A signature has a letter a row: its role's initial (x: none of s, u and a), a capital if the text is truncated, or d if the row must go.
    Texts don't travel, only their digests do. Rows are gathered in pieces of RUN turns, those without a turn by the first byte of their digest;
    of a conversation's pieces only the letters meet.
    """
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", "b").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    slim = keyed(rows).select("conv_id", "turn", "row_key", "copies", fault.alias("fault"), initial.alias("initial"))
    there = slim.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    before = F.row_number().over(Window.partitionBy("conv_id", "row_key").orderBy(F.asc_nulls_first("turn"), "copy"))
    there = there.withColumn("nth", before).withColumn("fault", F.when(F.col("fault") == "b", "b").when(F.col("nth") > 1, "d").otherwise(F.col("fault")))
    code = F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    piece = F.struct(F.floor(F.col("turn") / RUN).alias("run"), F.when(F.col("turn").isNull(), F.substring(F.hex("row_key"), 1, 2)).alias("first"))
    count = lambda f: F.sum((F.col("fault") == f).cast("long"))
    letters = lambda rows, c: F.array_join(F.transform(rows, lambda r: r[c]), "")
    in_order = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "row_key", "nth", code.alias("code"), "initial")))
    pieces = there.groupBy("conv_id", piece.alias("piece")).agg(
        in_order.alias("own"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"),
    )
    pieces = pieces.select("*", letters(F.col("own"), "code").alias("codes"), letters(F.col("own"), "initial").alias("initials")).drop("own")
    # a conversation whose rows are all dropped stays, with an empty piece
    gone = slim.where("copies = 0").select("conv_id").distinct()
    pieces = pieces.unionByName(gone, allowMissingColumns=True)
    whole = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("codes").isNotNull(), F.struct(F.col("piece.run").isNotNull().alias("known"), F.coalesce("piece.run", F.lit(0)).alias("run"), "piece.first", "codes", "initials")))).alias("own"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "turns")], F.min("low").alias("low"), F.max("high").alias("high"),
    )
    initials = letters(F.col("own"), "initials")
    gaps = F.coalesce(F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("turns"), F.lit(0))
    illegal = F.greatest(F.length(initials) - 1, F.lit(0)) - F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    return whole.select("conv_id", letters(F.col("own"), "codes").alias("signature"), gaps.try_cast("long").alias("gaps"), "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"))


def solver(codes: str, after: tuple[int, ...] | None) -> Callable[[int, int, int], tuple[int, str, int]]:
    """best(at, state, inserts left) for a block of a signature: least cost from there to the signature's end, the least letter that leads to it, and the state after it. after: least costs behind the block by state, None if it is the last."""

    @cache
    def best(at: int, state: int, inserts: int) -> tuple[int, str, int]:
        if at == len(codes) and after:
            return after[state], "", state
        following = PAIR if state == USER else USER
        options = []
        if at == len(codes):
            options.append((0 if state in (START, PAIR) else NEVER, "", state))
        else:
            role = codes[at].lower()
            options.append((DELETE + best(at + 1, state, 2)[0], "D", state))
            if role != "d":
                more = TRUNCATED if codes[at].isupper() else 0
                options.append((more + REROLE + best(at + 1, following, 2)[0], "R", following))
                if state in NEXT[role]:
                    options.append((more + best(at + 1, NEXT[role][state], 2)[0], "K", NEXT[role][state]))
        if inserts:
            options.append((INSERT + best(at, following, inserts - 1)[0], "I", following))
        return min(options)

    return best


def solved(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits that give a signature the form (s?(ua)+)?; of equal ones the ASCII-least audit.

    By memoised recursion over the rest of the signature and the state of what is written, block by block from the end. No two edits of one
    letter are open in one state, so the least letter of those that lead to the least cost gives the least audit. Two inserts in a row are as many as can help.
    """
    blocks = [signature[i : i + BLOCK] for i in range(0, len(signature), BLOCK)] or [""]
    after: list[tuple[int, ...] | None] = [None]
    for codes in reversed(blocks):
        best = solver(codes, after[-1])
        after.append(tuple(best(0, state, 2)[0] for state in range(4)))
    cost, state, audit = after.pop()[START], START, []
    for i, codes in enumerate(blocks):
        behind = after.pop()
        best = best if i == 0 else solver(codes, behind)
        at, inserts = 0, 2
        while letter := best(at, state, inserts)[1]:
            audit.append(letter)
            state = best(at, state, inserts)[2]
            at, inserts = (at, inserts - 1) if letter == "I" else (at + 1, 2)
    return cost, "".join(audit)


def solutions(found: DataFrame) -> DataFrame:
    """found (signature) with cost and audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                own = batch.column(0).slice(start, 1000)
                costs, audits = zip(*(solved(s) for s in own.to_pylist()), strict=True)
                yield pa.record_batch([own, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["signature", "cost", "audit"])

    return found.select("signature").mapInArrow(run, "signature string, cost bigint, audit string")


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of the repaired conversations: conv_id, at (from 0), role, text. rows: conv_id, turn, role, text, copies; audits: conv_id, audit.

    An audit comes before its conversation's rows in a sort that may spill; a task holds one audit, a letter a row, and one batch of rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    texts = keyed(rows.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))).withColumn("audit", F.lit(None).cast("string"))
    both = texts.unionByName(audits.select("conv_id", "audit"), allowMissingColumns=True)
    order = [F.col("conv_id"), F.col("audit").isNull(), F.asc_nulls_first("turn"), F.col("row_key")]
    both = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, place, written, own = "", 0, 0, None
        out: tuple[list, ...] = ([], [], [], [])

        def put(role: str, text: str) -> None:
            nonlocal written
            for column, value in zip(out, (own, written, role, text), strict=True):
                column.append(value)
            written += 1

        def inserts() -> None:
            nonlocal place
            while place < len(audit) and audit[place] == "I":
                put(turn_of(), "")
                place += 1

        def turn_of() -> str:
            return "user" if (written - system) % 2 == 0 else "assistant"

        system = 0
        for batch in batches:
            for own_id, plan, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if plan is not None:
                    audit, place, written, own, system = plan, 0, 0, own_id, 0
                else:
                    letter = audit[place]
                    place += 1
                    if letter == "K":
                        system += written == 0 and role.startswith("s")
                        put(role, text)
                    elif letter == "R":
                        put(turn_of(), text)
                inserts()
            yield pa.record_batch([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["conv_id", "at", "role", "text"])
            out = ([], [], [], [])

    return both.mapInArrow(run, f"conv_id {kind}, at bigint, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of what replayed() gives: its rows come conversation by conversation and in order, so no shuffle is needed and a hash is fed as they come. Conversations without rows are not there."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, type_ = None, None, pa.null()
        for batch in batches:
            ids, found, type_ = [], [], batch.schema.field(0).type
            for conv, at, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == 0:
                    if digest:
                        ids.append(own)
                        found.append(digest.hexdigest())
                    own, digest = conv, hashlib.sha256()
                digest.update((b"\n" if at else b"") + f"{role}:{text}".encode())
            yield pa.record_batch([pa.array(ids, type_), pa.array(found, pa.string())], names=["conv_id", "repaired_sha256"])
        if digest:
            yield pa.record_batch([pa.array([own], type_), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def planned(rows: DataFrame) -> DataFrame:
    """signatures() of rows with cost and audit of each conversation. A signature of many conversations is dealt out in parts."""
    own = stored(signatures(rows))
    sizes = stored(own.groupBy("signature").count())
    return met(own, solutions(sizes), parts_of(sizes, "signature", "count", HOT), "signature", "conv_id")


def repaired(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, those without one first, those of one turn by a digest of role and text. A row's first fault counts: blank,
    duplicate of an earlier row's role and text, truncated. Null roles and texts are one space. A null conv_id is a conversation of its own; repeated rows are
    repeated turns. An empty role has no legal neighbour. gaps beyond 64 bits are null. An empty table gives an empty
    result; other columns are ignored. Texts of any length are read whole; the hash of a conversation is fed by one task, as it must be, with bounded memory.
    damage=True first damages rows by their id and turn.
    """
    rows = damaged(conversations) if damage else conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), F.lit(1).alias("copies"))
    plans = stored(planned(rows))
    hashes = digests(replayed(rows, plans))
    nothing = hashlib.sha256().hexdigest()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    joined = plans.join(hashes.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return joined.select(*names, F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


#: The same by another way: crc32 byte by byte, then for each conversation from its last row back the least (cost, audit) of each state.
REPAIR_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS c FROM bits WHERE k = 8),
r0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, c[1 + (xor(a, b) & 255)])), 4294967295) % 20 AS fate FROM conversations, crc),
r1 AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM r0),
r2 AS (SELECT *, md5(length(role) || ':' || role || ':' || text) AS k, rtrim(text, E' \t\n\x0b\x0c\r') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM r1),
r3 AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS i,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k, nth) AS pos FROM r2),
r4 AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM r3),
totals AS (SELECT conv_id, coalesce(max(turn)::HUGEINT - min(turn)::HUGEINT + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pos > 1 AND (before || i) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r4 GROUP BY conv_id),
-- a state's way on: cost and audit; s0 nothing written, s1 a system row, s2 an open user row, s3 a closed pair
ways AS (SELECT conv_id, n AS pos, {'c': 0, 'a': ''} AS s0, {'c': 10, 'a': 'II'} AS s1, {'c': 5, 'a': 'I'} AS s2, {'c': 0, 'a': ''} AS s3 FROM totals
  UNION ALL SELECT conv_id, pos - 1, least(b0, {'c': 5 + u.c, 'a': 'I' || u.a}), least(b1, {'c': 5 + u.c, 'a': 'I' || u.a}), u, least(b3, {'c': 5 + b2.c, 'a': 'I' || b2.a}) FROM (
    SELECT *, least(b2, {'c': 5 + b3.c, 'a': 'I' || b3.a}) AS u FROM (
      SELECT w.conv_id, w.pos,
        least({'c': 2 + s0.c, 'a': 'D' || s0.a}, CASE WHEN go THEN {'c': 999999999, 'a': ''} WHEN i IN ('s', 'u') THEN least({'c': t + CASE i WHEN 's' THEN s1.c ELSE s2.c END, 'a': 'K' || CASE i WHEN 's' THEN s1.a ELSE s2.a END}, {'c': t + 1 + s2.c, 'a': 'R' || s2.a}) ELSE {'c': t + 1 + s2.c, 'a': 'R' || s2.a} END) AS b0,
        least({'c': 2 + s1.c, 'a': 'D' || s1.a}, CASE WHEN go THEN {'c': 999999999, 'a': ''} WHEN i = 'u' THEN {'c': t + s2.c, 'a': 'K' || s2.a} ELSE {'c': t + 1 + s2.c, 'a': 'R' || s2.a} END) AS b1,
        least({'c': 2 + s2.c, 'a': 'D' || s2.a}, CASE WHEN go THEN {'c': 999999999, 'a': ''} WHEN i = 'a' THEN {'c': t + s3.c, 'a': 'K' || s3.a} ELSE {'c': t + 1 + s3.c, 'a': 'R' || s3.a} END) AS b2,
        least({'c': 2 + s3.c, 'a': 'D' || s3.a}, CASE WHEN go THEN {'c': 999999999, 'a': ''} WHEN i = 'u' THEN {'c': t + s2.c, 'a': 'K' || s2.a} ELSE {'c': t + 1 + s2.c, 'a': 'R' || s2.a} END) AS b3
      FROM ways w JOIN (SELECT conv_id, pos, i, fault IN ('b', 'd') AS go, CASE fault WHEN 't' THEN 5 ELSE 0 END AS t FROM r4) x ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND w.pos = x.pos))),
plans AS (SELECT t.*, s0.c::BIGINT AS cost, s0.a AS audit FROM totals t JOIN ways w ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = 0),
-- edits: the letter's row is as many letters in as there were no inserts
e0 AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS step, audit FROM plans),
e1 AS (SELECT conv_id, step, audit[step] AS letter, length(replace(left(audit, step), 'I', '')) AS pos FROM e0),
e2 AS (SELECT e.*, r.role, r.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY step) AS written FROM e1 e LEFT JOIN r4 r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.pos = r.pos AND letter <> 'I' WHERE letter <> 'D'),
e3 AS (SELECT *, max(CASE WHEN written = 1 AND letter = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM e2),
e4 AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (written - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY step) AS whole FROM e3 GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN plans p ON c.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN e4 ON c.conv_id IS NOT DISTINCT FROM e4.conv_id
"""
