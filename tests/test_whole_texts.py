"""Byte pairs of whole texts."""

from pyspark.sql import functions as F

from facetflow.operators import text
from facetflow.plans import catalog

MERGES = [("t", "h"), ("th", "e</w>"), ("i", "n"), ("e", "r"), ("a", "n"), ("an", "d</w>"), ("in", "g</w>")]


def test_byte_pairs_hold_whole_texts(spark, small):
    letters = list(text.byte_letters().values())
    vocabulary = [*letters, *[c + "</w>" for c in letters], *["".join(m) for m in MERGES]]
    back = {c: b for b, c in text.byte_letters().items()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", text.pre_tokens(F.lower("text")).alias("words"))
    longest = 0
    for r in catalog.QUERIES["byte_pairs"](spark, small).join(docs, "doc_id").collect():
        assert r["ids"][0] == len(vocabulary) and r["ids"][-1] == len(vocabulary) + 1
        joined = "".join(vocabulary[i] for i in r["ids"][1:-1])
        words = [bytes(back[c] for c in w).decode() for w in joined.split("</w>")[:-1]]
        assert words == list(r["words"] or ())
        longest = max(longest, len(r["ids"]))
    assert longest > 1000
