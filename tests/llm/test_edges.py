"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.llm.chat_format import conversation_digests, format_conversations
from barloom.llm.common import word_count
from barloom.llm.exact_dedup import drop_exact_copies, exact_dedup
from barloom.llm.html_extract import extract_text
from barloom.llm.license_scan import scan_licenses
from barloom.llm.minhash_dedup import minhash_dedup
from barloom.llm.packing import pack_documents
from barloom.llm.queries import tokenizer_file
from barloom.llm.source_mix import mix_sources
from barloom.llm.topk_search import topk_search
from barloom.llm.toxicity import drop_toxic, toxicity_scores
from barloom.llm.url_templates import judge_urls

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, n long, component_id string, key string, size string, mix_copies string, node string"
ROWS = [
    (1, "a b c d e f", "en", "s", 11, *"xyzxyzxy"),
    (1, "a b c d e f", "en", "s", 11, *"xyzxyzxy"),
    (2, "a b c d e f", None, None, None, *"xyzxyzxy"),
    (3, None, "en", "s", 0, *"xyzxyzxy"),
    (4, "", "en", "t", 0, *"xyzxyzxy"),
    (None, "a b c d e f", "en", "s", 11, *"xyzxyzxy"),
    (5, LONG, "en", "t", len(LONG), *"xyzxyzxy"),
    (6, LONG + " more", "en", "t", len(LONG) + 5, *"xyzxyzxy"),
    (7, "x" * 200_000, "en", "t", 200_000, *"xyzxyzxy"),
    (8, " \t\n ", "en", "t", 4, *"xyzxyzxy"),
    (9, "Released under the MIT License.", "en", "s", 31, *"xyzxyzxy"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(1 if i == 7 else v for i, v in enumerate(r)) for r in ROWS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, None), (None, 0, 1), (5, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_minhash(docs):
    made = minhash_dedup(docs, shingle_words=4)
    assert made.count() == len(ROWS)
    got = by_id(made, "n_shingles", "component_id", "kept")
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[None] == (3, 1, False)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[8] == (0, 8, True)
    assert got[5][1] == got[6][1] == 5 and got[7] == (1, 7, True)
    assert minhash_dedup(docs.limit(0)).count() == 0


def test_licenses(docs):
    got = {(r["doc_id"], r["license"], r["containment"]) for r in scan_licenses(docs).collect()}
    assert got == {(9, "MIT", 1.0)}
    assert scan_licenses(docs.limit(0)).count() == 0 and scan_licenses(docs, {"none": "one two"}).count() == 0


def test_html(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p>Hi &amp; " + LONG, "x"), (3, "u", "<" * 5000, "x"), (4, "u", "<div>" * 3000 + "deep", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(pages).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == "" and texts[None] == "" and texts[2] == "Hi & " + LONG and texts[4] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_text(pages.limit(0)).count() == 0


def test_mix(docs):
    made = mix_sources(docs, word_count(F.col("text")))
    rows = made.collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[3] == 0
    assert mix_sources(docs.limit(0), word_count(F.col("text"))).count() == 0


def test_toxicity(docs, labels):
    rows = toxicity_scores(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"]: r["score"] for r in rows}[4] == 0 and {r["doc_id"]: r["held_out"] for r in rows}[None] is False
    assert toxicity_scores(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0
    assert toxicity_scores(docs.limit(0), labels).count() == 0
    assert drop_toxic(docs, labels.limit(0)).columns == docs.columns


def test_chat(spark):
    rows = [(1, 0, "user", "a", "x"), (1, 1, "user", None, "x"), (1, 1, "user", None, "x"), (1, None, None, "b\\<|im_end|>", "x"), (None, 0, "assistant", "c" * 100_000, "x"), (2, 0, "assis\ntant<\\n", "", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    made = conversation_digests(format_conversations(turns))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in made.collect()}
    assert got == {1: (4, 0), None: (1, 100_000), 2: (1, 0)}
    assert format_conversations(turns.limit(0)).count() == 0


def test_exact(docs):
    rows = exact_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    same = [r for r in rows if r["keep_id"] == 1]
    assert len(same) == 4 and sum(r["kept"] for r in same) == 1 and {r["group_size"] for r in same} == {4}
    assert {r["doc_id"]: r["keep_id"] for r in rows}[4] == 3
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9]
    assert exact_dedup(docs.limit(0)).count() == 0 and drop_exact_copies(docs.limit(0)).count() == 0


def test_packing(docs):
    rows = pack_documents(docs, tokenizer_file(), window=64, quantum=16).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 1
    seen = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in rows)
    place = 0
    for at, length in seen:
        assert at == place
        place += length
    assert pack_documents(docs.limit(0), tokenizer_file()).count() == 0


def test_urls(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "no host", "x"), (2, "http://A.Com/en/1?x#y", "x"), (3, "://", "x"), (4, "http://h" + "/p" * 5000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    made = judge_urls(pages, [("block", "com", "/")])
    assert made.count() == len(rows)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in made.collect()}
    assert got[1] == ("", "", None, "allow") and got[2] == ("a.com", "/en/1", "com/", "block") and got[4][0] == "h"
    assert judge_urls(pages.limit(0), []).count() == 0


def test_topk(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [None, 1.0], 1), (None, [1.0, 1.0], 1), (5, [], 1), (6, [1.0], 1), (100, [1e30, 1e30], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk_search(vectors, vectors.where("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100), (0, 2, 1), (0, 3, 1), (100, 1, 0), (100, 2, 1), (100, 3, 1)]
    assert topk_search(vectors.limit(0), vectors.limit(0)).count() == 0
