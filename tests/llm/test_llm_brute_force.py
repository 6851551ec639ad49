"""Operators against plain versions of themselves, held-out accuracy, or other libraries."""

import base64
import bisect
import functools
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from facetflow.llm import bpe, langid, lm, mixing, near_dup, quality, queries, token_counts
from facetflow.llm.common import table
from facetflow.llm.queries import RANKS
from public_tokenizers import PATTERN


@pytest.fixture(scope="module")
def docs(spark, small):
    return table(spark, small, "documents")


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def crc(i, k):
    return zlib.crc32(str(i).encode()) % k


def plain_kneser_ney(texts, order):
    """(probability of a word after a tuple of words, counts of words) by dictionaries."""
    raw, words = Counter(), Counter()
    for t in texts:
        a = ["<s>"] * (order - 1) + (t or "").encode().lower().split() + ["</s>"]
        words.update(a[order - 1 :])
        raw.update(tuple(a[i - order + 1 : i + 1]) for i in range(order - 1, len(a)))
    counts = {order: raw}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    followers, reduced = defaultdict(Counter), {}
    for k, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2])
        reduced[k] = [0] + [j - (j + 1) * y * of[j + 1] / of[j] for j in (1, 2, 3)]
        for g, n in c.items():
            followers[k, g[:-1]][g[-1]] = n

    left = {(k, g): (sum(own.values()), sum(reduced[k][min(x, 3)] for x in own.values())) for (k, g), own in followers.items()}

    def p(context, w):
        k = len(context) + 1
        lower = p(context[1:], w) if context else 1 / (len(words) + 1)
        if (k, context) not in left:
            return lower
        n = followers[k, context].get(w, 0)
        return (max(n - reduced[k][min(n, 3)], 0) + left[k, context][1] * lower) / left[k, context][0]

    return p, words


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kneser_ney(spark, small, docs, order):
    rows = docs.select("doc_id", "text").collect()
    p, words = plain_kneser_ney([r["text"] for r in rows if crc(r["doc_id"], 5) != 1], order)
    n, v = sum(words.values()), len(words)
    if order <= 3:
        for context in ((b"the",), (b"of", b"the"), (b"unseen", b"the"), ("<s>",) * 2):
            assert abs(sum(p(context[:order - 1], w) for w in words) + p(context[:order - 1], b"never seen") - 1) < 1e-9
    found = {r["doc_id"]: r for r in (queries.op1_kneser_ney(spark, small) if order == 3 else lm.held_out_scores(docs, order=order)).collect()}
    assert len(found) == len(rows)
    for r in rows:
        a, own = ["<s>"] * (order - 1) + r["text"].encode().lower().split() + ["</s>"], found[r["doc_id"]]
        mine = a[order - 1 :]
        assert (own["held_out"], own["n_tokens"], own["n_known"], own["train_tokens"]) == (crc(r["doc_id"], 5) == 1, len(mine), sum(w in words for w in mine), n)
        assert math.isclose(own["base_score"], sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in mine), rel_tol=1e-9)
        assert math.isclose(own["score"], sum(math.log10(p(tuple(a[i - order + 1 : i]), a[i])) for i in range(order - 1, len(a))), rel_tol=1e-9)
    held = [r for r in found.values() if r["held_out"]]
    assert order == 1 or sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_many_counts_and_small_windows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b " * 200) for i in range(3)], "doc_id bigint, text string")
    model = lm.fit(docs, order=2)
    h, _ = lm.tokens(["a b"], 2)
    assert lm.numbers(model, 2, lm.longer(h[1:2], h[2:3])).tolist() == [[600]]
    texts = [r["text"] for r in docs.collect()] + ["", "b a  c\x0bd", "x" * 50]
    whole = lm.scores(model, texts)
    monkeypatch.setattr(lm, "WINDOW", 7)
    monkeypatch.setattr(lm, "PIECE", 5)
    for a, b in zip(whole, lm.scores(model, texts), strict=True):
        assert np.allclose(a, b, rtol=1e-12)


def test_quality_held_out(spark):
    big = "/root/testdata/sf0.01"
    found = queries.op2_neighbour_quality(spark, big).join(table(spark, big, "labels"), "doc_id").where("held_out")
    assert found.where("predicted = quality").count() >= 0.98 * found.count() > 0
    assert queries.op2_neighbour_quality(spark, big).count() == 1000


def test_votes_are_those_of_all_cosines(docs, spark, small):
    model = quality.fit(docs, table(spark, small, "labels"))
    texts = [r["text"] for r in docs.limit(20).collect()]
    size, shapes = quality.DIMENSIONS, quality.SHAPES

    def kind(c):
        if c.isdecimal():
            return "9"
        if "A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ":
            return "A"
        return "a" if c.isalnum() else c

    def plain(text):
        counts, last = np.zeros(size), None
        for word in text.split():
            form = "".join(k if k in "aA9" else k * len(list(g)) for k, g in itertools.groupby(word, kind))[:8]
            own, form = zlib.crc32(word.lower().encode()), zlib.crc32(b"s" + form.encode()) % 2**20
            counts[form % (shapes - 1)] += 1
            counts[own % (size - shapes) + shapes] += 1
            if last:
                counts[(last[0] * 1000003 + form) % (shapes - 1)] += 1
                counts[shapes - 1] += 2 * (own == last[1])
            last = form, own
        x = np.where(np.arange(size) < shapes, np.sqrt(counts), np.log1p(counts) * model.rarity)
        for part, much in ((slice(0, shapes), 1), (slice(shapes, None), 0.33)):
            x[part] *= much / (math.sqrt(sum(v * v for v in x[part])) or 1)
        latent = [float(np.dot(x, axis)) for axis in model.axes.T]
        return np.array(latent) / math.sqrt(sum(v * v for v in latent))

    for text, score in zip(texts, model.scores(texts, quality.Words()), strict=True):
        cosine = [float(np.dot(plain(text), x)) for x in model.vectors]
        near = sorted(range(len(cosine)), key=lambda i: (-round(cosine[i], 6), i))[: quality.NEIGHBOURS]
        w = [min(max(cosine[i], 0), 1) ** 8 for i in near]
        assert abs(score - sum(a * model.labels[i] for a, i in zip(w, near, strict=True)) / sum(w)) < 1e-4, text[:40]


def test_votes_on_ties():
    """Of equal cosines the first vectors vote; a text's score does not hang on its batch."""
    texts = ["alpha beta", "alpha beta gamma", "delta"]
    axes = np.random.default_rng(1).standard_normal((quality.DIMENSIONS, 4))
    rarity = np.ones(quality.DIMENSIONS, dtype=np.float32)
    one = quality.unit(quality.weighted(quality.features(texts[:1], quality.Words()), rarity).astype(float) @ axes)
    labels = np.array([1.0] * quality.NEIGHBOURS + [0.0] * 10)
    model = quality.Model(rarity, axes, np.repeat(one, len(labels), axis=0), labels)
    together = model.scores(texts * 50, quality.Words())
    assert together[0] == 1.0 and np.allclose(together[:3], [model.scores([t], quality.Words())[0] for t in texts], atol=1e-7)
    assert abs(quality.Model(rarity, axes, model.vectors, labels[::-1]).scores(texts[:1], quality.Words())[0] - 5 / 15) < 1e-9


def test_language_held_out(spark):
    big = "/root/testdata/sf0.01"
    found = queries.op3_language_spans(spark, big).join(table(spark, big, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang_pred = lang").count() >= 0.98 * found.count() > 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], np.zeros((3, 1)), np.ones((15, 3), dtype=bool))
    sizes = np.array([5, 0, 1, 6])
    words = (rng.random((12, 3)) * -12).astype(np.float32)
    label = model.labels(words, sizes)
    for start, size in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        value = lambda path: sum(words[start + i, s] for i, s in enumerate(path)) - langid.SWITCH * sum(x != y for x, y in itertools.pairwise(path))  # noqa: B023, E731
        if size:
            assert math.isclose(value(label[start : start + size]), max(value(p) for p in itertools.product(range(3), repeat=int(size))), rel_tol=1e-5)


def test_spans_of_mixed_text(spark, docs):
    model = langid.fit(docs)
    one = {r["lang"]: r["text"] for r in docs.where("lang in ('en', 'de') and n_chars > 500").collect()}
    mixed = spark.createDataFrame([(1, one["en"][:400] + " " + one["de"][:400])], "doc_id bigint, text string")
    found = [r["lang"] for r in langid.spans(mixed, model).orderBy("span").collect()]
    assert found[0] == "en" and found[-1] == "de"


def test_mixing_keeps_to_its_budget(spark, docs):
    skewed = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "big").otherwise(F.col("source")))
    words = dict(skewed.groupBy("source").agg(F.sum(mixing.words(F.col("text")))).collect())
    rows = mixing.mixed(skewed, repetition=2.0).collect()
    used = Counter()
    for r in rows:
        used[r["source"]] += r["tokens"]
    longest = max(r["tokens"] for r in rows)
    assert max(used[s] - 2 * words[s] for s in words) <= longest  # the last row may pass the limit
    assert abs(sum(used.values()) - sum(words.values())) <= longest * len(words)
    cover = mixing.repeated(skewed).groupBy("doc_id").count()
    assert cover.count() == docs.count() and cover.agg(F.max("count")).first()[0] <= 3
    flat = Counter()
    for r in mixing.mixed(skewed, repetition=None, entropy=math.log(len(words))).collect():
        flat[r["source"]] += r["tokens"]
    assert max(flat.values()) - min(flat.values()) <= 2 * longest


def longest_common(a, b):
    """By the least ends of common sequences of each length."""
    places = defaultdict(list)
    for j, y in enumerate(b):
        places[y].insert(0, j)
    ends = []
    for x in a:
        for j in places.get(x, ()):
            at = bisect.bisect_left(ends, j)
            ends[at : at + 1] = [j]
    return len(ends)


def runs_of_five(text):
    words = (text or "").lower().split()
    return tuple(" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else ()


counted = functools.lru_cache(maxsize=10_000)(Counter)


def alike(a, b):
    if a == b:
        return bool(a)
    if not a or not b or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)) or 9 * sum((counted(a) & counted(b)).values()) < 4 * (len(a) + len(b)):
        return False
    n = longest_common(a, b)
    return 5 * n >= 4 * (len(a) + len(b) - n)


def test_banded_alignment():
    r = random.Random(3)
    for _ in range(300):
        a = [r.randrange(30) for _ in range(r.randint(1, 40))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 2)] = [r.randrange(30) for _ in range(r.randint(0, 2))]
        if b:
            n = longest_common(a, b)
            share = n / (len(a) + len(b) - n)
            assert near_dup.aligned(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == (share if share >= 0.8 else 0.0)


def test_alignment_of_long_texts():
    r = np.random.default_rng(8)
    a = r.integers(0, 1 << 60, 100_000).astype(np.uint64)
    for edits in (10, 3000):
        b = np.delete(np.insert(a, r.integers(0, len(a), edits), r.integers(0, 1 << 60, edits).astype(np.uint64)), r.integers(0, len(a), edits))
        n = longest_common(a.tolist(), b.tolist())
        assert near_dup.aligned(a, b) == n / (len(a) + len(b) - n)
    assert near_dup.aligned(a, np.roll(a, len(a) // 2)) == 0.0


def test_near_duplicates_by_all_pairs(spark, docs):
    r = random.Random(5)
    rows = [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()]
    vocabulary = [f"w{i}" for i in range(500)]
    base = [r.choice(vocabulary) for _ in range(120)]
    for i in range(60):  # a group of near copies, some of which are linked only by way of others
        copy = list(base)
        for _ in range(i % 4):
            copy[r.randrange(len(copy))] = f"x{r.randrange(9)}"
        rows.append((10_000 + i, " ".join(copy)))
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows += [(20_000 + i, " ".join(passage + [f"y{r.randrange(10**6)}" for _ in range(30)])) for i in range(60)]
    paragraph = " ".join(r.choice(vocabulary) for _ in range(60))
    rows += [(30_000 + i, " ".join([paragraph] * n)) for i, n in enumerate((1, 100, 2, 95, 3))]
    parts = [runs_of_five(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = parts[i], parts[j]
        if alike(a, b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    expected = {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
    found = near_dup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = {x["doc_id"]: x["class_id"] for x in found.collect()}
    assert found == expected
    assert [found[30_000 + i] for i in range(5)] == [30_000, 30_001, 30_002, 30_001, 30_004]


def test_near_copies_by_edit_rate(spark):
    """Of pairs that are alike by a plain alignment nearly all are found, at any rate of edits; others are not linked."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, pairs = [], []
    for i in range(1200):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 300))]
        copy = list(base)
        for _ in range(max(1, round(len(base) * r.choice((0.005, 0.01, 0.02, 0.03, 0.05))))):
            at = r.randrange(len(copy))
            copy[at : at + r.randint(0, 1)] = [r.choice(vocabulary)] if r.random() < 0.8 else []
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        pairs.append(alike(runs_of_five(rows[-2][1]), runs_of_five(rows[-1][1])))
    found = {x["doc_id"]: x["class_id"] for x in near_dup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    linked = [found[2 * i + 1] == 2 * i for i in range(len(pairs))]
    assert sum(a and b for a, b in zip(linked, pairs, strict=True)) >= 0.999 * sum(pairs) > 300
    assert not any(a and not b for a, b in zip(linked, pairs, strict=True)) and not all(pairs)


def test_neighbours_and_top_k(spark, small):
    rows = table(spark, small, "embeddings").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    size = np.sqrt((x * x).sum(axis=1))
    whole = np.floor(256 * x).astype(np.int64)
    near, exact = defaultdict(list), defaultdict(list)
    for r in queries.op7_one_bit_neighbours(spark, small).orderBy("query_id", "rank").collect():
        near[r["query_id"]].append((r["vec_id"], r["score"]))
    for r in queries.op6_bit_sliced_top_k(spark, small).orderBy("query_id", "rank").collect():
        exact[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        others = ids != ids[i]
        cosine = np.where(others, x @ x[i] / size / size[i], -9)
        best = [int(ids[j]) for j in np.lexsort((ids, -cosine))[:5]]
        hits += len(set(best) & {v for v, _ in near[ids[i]]})
        assert all(abs(s - cosine[list(ids).index(v)]) < 1e-12 for v, s in near[ids[i]])
        score = np.where(others, whole @ whole[i], -(1 << 60))
        assert exact[ids[i]] == [(int(ids[j]), int(score[j])) for j in np.lexsort((ids, -score))[:5]]
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_section_tokens(docs, plain, spark):
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(40).collect()] + [(-1, "a\n\n\nb  \n"), (-2, "日本\n語のé\n\U0001f600\U0001f600"), (-3, "\n"), (-4, None)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    for rule in token_counts.RULES:
        found = defaultdict(dict)
        for r in token_counts.section_tokens(made, RANKS, PATTERN, rule=rule).collect():
            found[r["doc_id"]][r["section"]] = (r["n_chars"], r["n_tokens"], r["n_crossing"])
        for i, text in rows:
            text = text or ""
            lines = text.splitlines(keepends=True) if "\x0b" not in text and "\x85" not in text else None
            lines = [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] or text == "" else [])
            own = [n for n, line in enumerate(lines) for _ in line]
            n, crossing, at = [0] * len(lines), [0] * len(lines), 0
            raw = text.encode()
            character = [k for k, c in enumerate(text) for _ in c.encode()]
            for token in plain.encode_ordinary(text):
                size = len(plain.decode_single_token_bytes(token))
                sections = [own[k] for k in range(character[at], character[at + size - 1] + 1)]
                to = sections[0] if rule == "start" else max(dict.fromkeys(sections), key=lambda s: (sections.count(s), -s))
                n[to] += 1
                crossing[to] += len(set(sections)) > 1
                at += size
            assert at == len(raw) and [found[i][k] for k in range(len(lines))] == list(zip(map(len, lines), n, crossing, strict=True)), (i, rule)
    fields = spark.createDataFrame([(1, "ab", None, "cd ef")], "k bigint, a string, b string, c string")
    got = token_counts.field_tokens(fields, ["a", "b", "c"], RANKS, PATTERN, "k").orderBy("section").collect()
    assert [r["n_chars"] for r in got] == [3, 1, 5] and sum(r["n_tokens"] for r in got) == len(plain.encode_ordinary("ab\n\ncd ef"))


def test_byte_bpe(spark, small, docs, plain):
    for r in queries.op10_byte_bpe(spark, small).join(docs, "doc_id").collect():
        ids = plain.encode_ordinary(r["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    row = bpe.encoded(docs.limit(1), RANKS, PATTERN).join(docs, "doc_id").first()
    assert row["ids"] == plain.encode_ordinary(row["text"]) and bytes(row["decoded"]).decode() == row["text"]


def test_byte_bpe_on_odd_texts(plain):
    own, r = bpe.Encoder.load(RANKS, PATTERN), random.Random(2)
    alphabet = list("abcdeinrstthe  '.,\n\t019ABZéßñü中日あ") + ["\U0001f642", "́", "\x1c", "\x85"]
    tokens = list(own.rank)
    for _ in range(5000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        assert own.encode(text) == plain.encode_ordinary(text)
        piece = "".join(r.choice(tokens) for _ in range(3))
        assert own.piece(piece) == plain._core_bpe.encode_single_piece(piece.encode("latin-1"))
    for text in ("ab" * 5000, "a" * 20_000, "z9" * 3000):
        assert own.encode(text) == plain.encode_ordinary(text)


def test_pipeline_is_its_stages(spark, small, docs, plain):
    labels = table(spark, small, "labels")
    model = quality.fit(docs, labels, held_out=False)
    rows = docs.collect()
    rows = [r for r, s in zip(rows, model.scores([r["text"] for r in rows], quality.Words()), strict=True) if s >= 0.5]
    good = spark.createDataFrame(rows, docs.schema)
    languages = langid.fit(good)
    verdicts = zip(rows, *languages.verdicts([r["text"] for r in rows]), strict=True)
    rows = [r for r, name, share, _ in verdicts if name != "und" and share >= 0.3]
    kept, parts = [], []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        own = runs_of_five(r["text"])
        if not any(alike(own, other) for other in parts):
            kept.append(r)
        parts.append(own)  # a chain of links leads to the first of its class
    found = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in kept}
    assert max(Counter(r["doc_id"] for r in found).values()) <= 3
    texts = {r["doc_id"]: r["text"] for r in kept}
    for r in found:
        assert r["n_tokens"] == len(plain.encode_ordinary(texts[r["doc_id"]]))
