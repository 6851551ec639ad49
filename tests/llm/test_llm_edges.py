"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facetflow.llm import ann, bpe, langid, lm, mixing, near_dup, quality, token_counts, topk, url_filter
from facetflow.llm.queries import RANKS
from public_tokenizers import PATTERN

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, section string, _key int, row int, id string, class_id int, held_out int, label int, name int, block int, _id int, _raw string"
LONG = "wort " * 50_000 + "x" * 100_000

OPERATORS = {
    "lm": lambda d, labels: lm.held_out_scores(d),
    "quality": lambda d, labels: quality.classified(d, labels),
    "langid": lambda d, labels: langid.identified(d),
    "mixing": lambda d, labels: mixing.mixed(d),
    "near_dup": lambda d, labels: near_dup.classes(d),
    "token_counts": lambda d, labels: token_counts.section_tokens(d, RANKS, PATTERN),
    "bpe": lambda d, labels: bpe.digests(d, RANKS, PATTERN),
}


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "   \n", "the cat sat on the mat and looked at the dog", "the cat sat on the mat and looked at the dog", LONG, "12 ½ ² 34 !!", "é", "der hund und die katze", "the cat\x1c sat� \U0001f600"]
    rows = [(i, t, "en" if i % 2 else "de", "a" if i % 3 else None) + (1, 0.5, "s") + (1, 1, "i") + (0,) * 5 + (7, "r") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None) + (None,) * 13]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0, "x") for i in range(9)] + [(None, 1, 0, "x"), (3, None, 1, "x"), (3, 0, 1, "x")], "doc_id bigint, quality int, toxic int, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_survive(docs, labels, name):
    found = OPERATORS[name](docs, labels).collect()
    if name in ("lm", "quality", "langid", "near_dup", "bpe"):
        assert len(found) == docs.count()
    assert found


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_no_labels_and_no_training_rows(docs, labels):
    assert {r["score"] for r in quality.classified(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["lang_pred"] for r in langid.predicted(docs, langid.fit(docs.limit(0))).collect()} == {"und"}
    row = lm.scored(docs.where("doc_id = 0"), lm.fit(docs.limit(0))).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (1, 0, 0, 0.0, 0.0)


def test_defined_results(docs, labels):
    ids = {r["doc_id"]: r["lang_pred"] for r in langid.identified(docs).collect()}
    assert ids[0] == ids[1] == ids[2] == ids[6] == "und"
    classes = [(r["doc_id"], r["class_id"]) for r in near_dup.classes(docs).collect()]
    assert [c for d, c in classes if d in (3, 4)] == [3] * 4
    assert all(d == c for d, c in classes if d not in (3, 4))
    empty = bpe.digests(docs.where("doc_id = 0"), RANKS, PATTERN).first()
    assert empty["n_tokens"] == 0 and empty["ids_sha256"].startswith("e3b0c442")


def test_stages_keep_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns
            out.collect()
    kept = corpus_pipeline.one_of_each(spark, docs, str(tmp_path))
    assert kept.where("doc_id in (3, 4)").count() == 1
    assert kept.where("doc_id is null or doc_id in (0, 1, 2)").count() == 4
    twice = spark.createDataFrame([(1, "a b c d e f g h"), (7, "x y z u v w q r"), (7, "a b c d e f g h"), (9, "x y z u v w q r"), (9, "x y z u v w q r")], "doc_id bigint, text string")
    rows = near_dup.deduplicated(twice).collect()
    assert sorted((r["doc_id"], r["text"][0]) for r in rows) == [(1, "a"), (7, "x")]  # one of each class, though an id repeats
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not found & {0, 1, 2, 6} and 4 not in found


def test_pipeline_of_empty_tables(spark, docs, labels, tmp_path):
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.5]), (9, [1.0, 1.0])]
    table = spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "vec_id bigint, embedding array<double>, rank int, score double")
    exact = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table).collect()]
    assert sorted(x for x in exact if x[0] == 0) == [(0, 1, 6, 65536), (0, 2, 6, 65536), (0, 3, 9, 65536), (0, 4, 5, 0), (0, 5, 50, 0)]
    near = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(table).collect()]
    assert sorted(x for x in near if x[0] == 0) == [(0, 1, 6), (0, 2, 6), (0, 3, 9), (0, 4, 50), (0, 5, 50)]
    assert sorted(x[1:] for x in exact if x[0] == 50)[:2] == [(1, 6, 131072), (2, 6, 131072)]  # the second row of 50 asks too
    for search in (topk.top_k, ann.nearest):
        assert search(table.limit(0)).count() == 0
        assert search(table.where("vec_id = 0")).count() == 0


def test_top_k_agrees_with_its_sql(spark):
    """Large components, mixed lengths, repeated keys and ties."""
    rows = [(0, [1.0, 1.0]), (1, [2e6, 0.0]), (2, [1.0, 0.0]), (3, [-3e9, 2.5]), (50, [-1.5, 0.25]), (50, [4.0, 0.0]), (50, [4.0, 0.0]), (4, [1.0]), (100, [2.0]), (5, [0.5, 7.0, 1.0]), (150, [0.1, 0.2, -0.3]), (6, [-1e-300, 0.0]), (200, [3.0, 1.0, 1.0, 1.0])]
    rows += [(7 + i, [float(i % 3), 1.0]) for i in range(40)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", [list(r) for r in rows])
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(topk.TOP_K_SQL).fetchall())
    wide = spark.createDataFrame([(0, [1e300, -1e300]), (1, [2e300, 2e300]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    exact = topk.searcher(5)(topk.pack_index(np.array([1]), np.array([[2e300, 2e300]])), topk.pack_query(np.array([0]), np.array([[1e300, -1e300]])))
    assert [x.tolist() for x in exact] == [[0], [1], [0]]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(wide).collect()


def test_popcount_estimates():
    r = np.random.default_rng(2)
    v, q = r.standard_normal((300, 100)), r.standard_normal((5, 100))
    ids, codes, ones, correction, _ = ann.packer(7)(np.arange(300), v)
    _, _, planes, low, step, whole = ann.query_packer(7)(np.arange(5), q)
    turn = lambda x: x / ann.norms(x)[:, None] @ ann.rotation(100, 7)
    plain = np.where(turn(v) > 0, 1, -1) @ turn(q).T / 10 / correction[:, None]
    for i in range(5):
        steps = sum(np.bitwise_count(codes[w] & planes[i, j, w]).astype(int) << j for j in range(8) for w in range(len(codes)))
        guess = (2 * (low[i] * ones + step[i] * steps) - whole[i]) / (10 * correction)
        assert np.abs(guess - plain[:, i]).max() <= (step[i] * 10 / 2 / correction).max()


def test_urls(spark):
    rows = [(1, None), (2, "no scheme casino"), (3, "HTTP://A.Example.NET/en/x?q#f"), (4, "http://example.net"), (5, "http://x.org/fr/casino"), (6, "http://x.org/y-casino.html"), (7, "http://x.org/spam-farm"), (8, "http://x.org/spamfarm"), (9, "http://notexample.com/de/"), (10, "http://w.example.com/de/a"), (None, ""), (3, "HTTP://A.Example.NET/en/x?q#f"), (11, "http://b.net/")]
    table = spark.createDataFrame([(a, b, "h", "r") for a, b in rows], "page_id bigint, url string, host string, rule string")
    found = {r["page_id"]: tuple(r[1:5]) for r in url_filter.url_verdicts(table).collect()}
    assert found[1] == ("", "", None, "allow") and found[2] == ("", "", None, "block")
    assert found[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert found[4] == ("example.net", "", None, "allow") and found[11][2:] == ("net/", "block")
    assert found[5][2:] == ("org/fr/", "allow") and found[6][3] == "block" and found[7][3] == "block" and found[8][3] == "allow"
    assert found[9][2] is None and found[10][2:] == ("example.com/de/", "block")
    assert url_filter.url_verdicts(table.limit(0)).count() == 0 and url_filter.url_verdicts(table).count() == len(rows)
    long = spark.createDataFrame([(1, "http://x.org/" + "a/" * 200_000 + "casino"), (2, "http://x.org/" + "casinos" * 100_000), (3, "http://x.org/free-free-free"), (4, "http://x.org/free?win")], "page_id bigint, url string")
    assert [(r["verdict"], r["strict_terms"], r["soft_terms"]) for r in url_filter.url_verdicts(long).orderBy("page_id").collect()] == [("block", 1, 0), ("allow", 0, 0), ("allow", 0, 1), ("block", 0, 2)]
    strict, soft = url_filter.vocabulary(url_filter.TERMS)
    assert len(strict) + len(soft) > 130 and not set(strict) & set(soft)
