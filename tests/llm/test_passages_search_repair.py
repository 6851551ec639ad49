"""Conversation repair, repeated passages and ranked search against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import time

import duckdb
import numpy as np
import pytest

from facetflow.llm import conversations, ranked, repeats, url_filter

# --- conversation repair


def plain_repair(signature):
    """Every sequence of edits with at most two inserts in a row."""
    best = None

    def go(at, roles, cost, audit, inserts):
        nonlocal best
        if best and (cost, audit) > best and cost > best[0]:
            return
        if at == len(signature) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserts < 2:
            for r in "ua":
                go(at, roles + r, cost + 5, audit + "I", inserts + 1)
        if at < len(signature):
            code = signature[at]
            go(at + 1, roles, cost + 2, audit + "D", 0)
            if code != "d":
                more = 5 * code.isupper()
                go(at + 1, roles + code.lower(), cost + more, audit + "K", 0)
                for r in "ua":
                    go(at + 1, roles + r, cost + more + 1, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def test_signatures_are_solved_as_by_brute_force():
    for n in range(3):
        for letters in itertools.product("suaxSUAXd", repeat=n):
            assert conversations.solved("".join(letters)) == plain_repair("".join(letters))
    rnd = random.Random(1)
    for _ in range(15):
        signature = "".join(rnd.choice("suaxSUAXd") for _ in range(4))
        assert conversations.solved(signature) == plain_repair(signature)


def test_long_signature_in_blocks(monkeypatch):
    rnd = random.Random(2)
    signature = "".join(rnd.choice("suaxSUAXd") for _ in range(3000))
    small = conversations.solved(signature)
    monkeypatch.setattr(conversations, "BLOCK", 7)
    assert conversations.solved(signature) == small


def odd_conversations(spark):
    long = "wort " * 60_000 + "."
    rows = [(1, 0, "system", "Be good."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 5, "user", "cut"), (2, None, "user", "A."), (2, None, "user", "A."), (2, 3, None, "B."), (2, 9, "assistant", None), (3, 1, "", "C."), (None, 1, "user", "D."), (None, 2, "assistant", "E."), (4, 1, "user", long), (4, 2, "assistant", long), (5, 7, "tool", "F!"), (6, 2**62, "user", "a."), (6, -(2**62), "assistant", "b."), (7, 0, "unit", "K."), (7, 1, "agent", "L.")]
    rows += [(100 + i // 9, i % 9, ["system", "user", "assistant", "tool"][i * i % 4], ["x.", "y", " ", "z?\n"][i % 4]) for i in range(900)]
    return spark.createDataFrame([(a, b, c, d, "x", 1) for a, b, c, d in rows], "conv_id bigint, turn bigint, role string, text string, audit string, signature int")


def test_repair_agrees_with_its_sql(spark):
    table = odd_conversations(spark)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r)[:4] for r in table.collect()])
    expected = con.execute(conversations.REPAIR_SQL).fetchall()
    found = conversations.repaired(table)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert conversations.repaired(table.limit(0)).count() == 0


def test_repair_without_damage(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "No."), (3, 4, "user", "   ")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {r["conv_id"]: r for r in conversations.repaired(table, damage=False).collect()}
    assert (found[1]["audit"], found[1]["cost"], found[1]["duplicate"], found[1]["illegal"]) == ("KDK", 2, 1, 1)
    assert found[1]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert (found[2]["audit"], found[2]["cost"]) == ("D", 2) and (found[3]["audit"], found[3]["blank"]) == ("D", 1)
    assert found[2]["repaired_sha256"] == found[3]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    texts = conversations.replayed(conversations.damaged(table), conversations.planned(conversations.damaged(table))).collect()
    assert {r["role"] for r in texts} <= {"user", "assistant", "system"}


# --- repeated passages


def plain_repeats(texts):
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            string = raw[p : p + 100]
            if string in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(string)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffixes_are_sorted():
    rnd = random.Random(3)
    for trial in range(60):
        data = bytes(rnd.randrange(rnd.choice([1, 2, 4])) + 97 for _ in range(rnd.randint(110, 500)))
        data = data[:150] * 6 + data if trial % 3 == 0 else data
        starts = np.array([i for i in range(len(data) - 100) if rnd.random() < 0.5], dtype=np.int64)
        keys = [data[s : s + 100] for s in starts]
        rank = {k: i for i, k in enumerate(sorted(set(keys)))}
        assert repeats.equal_groups(data, starts).tolist() == [rank[k] for k in keys]
        assert repeats.equal_groups(data, starts[:0]).tolist() == []


def passages():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    common, line = text(40), text(30)
    texts = [None, "", "short", "x" * 99, "x" * 100, "x" * 100, "x" * 1000, "ab" * 400, common, common]
    texts += [text(rnd.randint(5, 60)) + rnd.choice(["", common, line, common[: rnd.randint(1, len(common))]]) + text(rnd.randint(0, 60)) for _ in range(120)]
    base = text(300)
    texts += [base] + [base[: (k := rnd.randrange(len(base)))] + "#" + base[k:] for _ in range(20)]
    return texts


@pytest.mark.parametrize("change", [{}, {"HOT": 16}, {"FLUSH": 50, "SORTED": 3000}, {"TEXT": 128}])
def test_passages_as_by_brute_force(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(repeats, name, value)
    texts = passages()
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    table = spark.createDataFrame([(i, texts[i], 1, "x") for i in order], "doc_id bigint, text string, sub int, first string").repartition(5)
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats.digests(table).collect()}
    assert [found[i] for i in range(len(texts))] == plain_repeats(texts)
    assert repeats.digests(table.limit(0)).count() == 0


def test_passages_of_null_and_repeated_keys(spark):
    a, b = "".join(map(str, range(100))), "".join(map(str, range(1000, 1100)))
    table = spark.createDataFrame([(1, a), (1, a), (1, a + b), (2, b), (None, a), (3, None), (None, b), (4, "wort " * 60_000)], "doc_id bigint, text string")
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.digests(table).collect()), key=repr)
    assert found == sorted([(1, 190, 190), (1, 190, 190), (1, 590, 590), (2, 400, 400), (None, 190, 0), (3, 0, 0), (None, 400, 0), (4, 300_000, 299_995)], key=repr)


# --- ranked search


def plain_ranked(docs, items, top=10):
    terms = [re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    n, whole = sum(map(bool, terms)), sum(map(len, terms))
    df = {}
    for own in terms:
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        wanted = set(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scores = []
        for (doc, _), own in zip(docs, terms, strict=True):
            if own:
                m = 10 + 90 * len(own) * n // whole
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * own.count(t) // (1000 * own.count(t) + 8 * m)) for t in wanted if t in own)
                if score > 0:
                    scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize("change", [{}, {"POSTINGS": 40, "WIDE": 2}, {"POSTINGS": 300, "WIDE": 5, "SAMPLED": 2, "TERMS": 20}])
def test_search_as_by_brute_force(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(ranked, name, value)
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["É", "ça", "ÄB", "İ", "\U0001f600x"]
    text = lambda n: rnd.choice([" ", "-", "_"]).join(rnd.choice(words[: rnd.randint(1, 65)]) for _ in range(n))
    docs = [(i, text(rnd.randint(1, 40))) for i in range(300)] + [(400, "W1 w1"), (401, "w1 w1"), (402, None), (403, " .. "), (None, "w1 w1"), (401, "w1 w1"), (404, "w3 " * 100_000)]
    items = [(i, text(rnd.randint(1, 12))) for i in range(20)] + [(50, None), (51, "w1"), (52, "unknown"), (53, "w2 w2 W2")]
    table = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id bigint, text string, item int, score string").repartition(3)
    asked = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id bigint, text string, rank int")
    found = sorted(map(tuple, ranked.ranked(table, asked).collect()), key=repr)
    assert found == sorted(plain_ranked(docs, items), key=repr)
    assert ranked.ranked(table.limit(0), asked).count() == 0 and ranked.ranked(table, asked.limit(0)).count() == 0


# --- a large url vocabulary


def test_a_hundred_thousand_url_terms(spark, tmp_path):
    """Verdicts as by a set of every url's words, and no slower for a thousand times the terms."""
    rnd = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    terms = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(3, 9))) for _ in range(100_000)})
    kinds = {t: rnd.choice(["strict", "soft", "soft"]) for t in terms}
    urls = [(i, "http://x" + str(i) + ".org/" + "/".join(rnd.choice(terms) if rnd.random() < 0.03 else "".join(rnd.choice(letters) for _ in range(10)) for _ in range(20))) for i in range(3000)]
    table = spark.createDataFrame(urls, "page_id bigint, url string").repartition(4).cache()
    table.count()
    seconds = {}
    for n in (100, len(terms)):
        some = rnd.sample(terms, n)
        path = tmp_path / f"terms{n}.txt"
        path.write_text("".join(f"{kinds[t]} {t}\n" for t in some))
        url_filter.url_verdicts(table, terms=str(path)).count()
        began = time.time()
        found = {r["page_id"]: (r["verdict"], r["strict_terms"], r["soft_terms"]) for r in url_filter.url_verdicts(table, terms=str(path)).collect()}
        seconds[n] = time.time() - began
        known = set(some)
        for i, url in urls:
            words = {w for w in re.findall("[a-z0-9]+", url) if w in known}
            strict, soft = (sum(kinds[w] == k for w in words) for k in ("strict", "soft"))
            assert found[i] == ("block" if strict or soft >= 2 else "allow", strict, soft)
    table.unpersist()
    assert seconds[len(terms)] < 5 * seconds[100] + 3  # building the automaton is all that grows
