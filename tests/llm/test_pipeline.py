"""The pipeline's stages against brute force on a small corpus."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from barloom.llm.common import table, written

from .test_brute_force import linked_components, near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = near_copies(rng, n_groups=6, size=8, words=50)
    texts += [texts[3], texts[3]]
    texts += [" ".join(f"clean{rng.randrange(300)}" for _ in range(40)) for _ in range(120)]
    toxic = [" ".join(rng.choice(["vile", "nasty"]) + rng.choice(["an", "er", "st"]) if rng.random() < 0.2 else f"clean{rng.randrange(300)}" for _ in range(40)) for _ in range(80)]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts + toxic)]
    first_toxic = len(texts)
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{where}/documents.parquet")
    marks = [(i, 1, int(i >= first_toxic)) for i, *_ in rows if i % 4]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows, first_toxic


def test_stages(spark, corpus):
    where, rows, first_toxic = corpus
    text = {r[0]: r[1] for r in rows}
    docs = table(spark, where, "documents")
    made = []
    for name, stage in P.STAGES:
        out = written(stage(spark, docs, where), f"test-{name}")
        if name != "pack":
            assert out.columns == docs.columns
        made.append(out)
        docs = out
    ids = [sorted(r["doc_id"] for r in m.select("doc_id").collect()) for m in made[:4]]
    clean = [i for i in text if i < first_toxic]
    assert len(set(clean) - set(ids[0])) <= 2 and len([i for i in ids[0] if i >= first_toxic]) <= 4
    seen, unique = set(), []
    for i in ids[0]:
        if text[i] not in seen:
            seen.add(text[i])
            unique.append(i)
    assert ids[1] == unique
    roots = linked_components([text[i] for i in ids[1]], 5, 80)
    assert ids[2] == [i for k, i in enumerate(ids[1]) if roots[k][1] == k]
    assert set(ids[3]) <= set(ids[2]) and max(map(ids[3].count, ids[3])) <= 2
    words = lambda some: sum(len(text[i].split()) for i in some)
    assert abs(words(ids[3]) - 1.5 * words(ids[2])) <= 3 * 200
    pieces = made[4]
    assert pieces.agg(F.sum("length")).first()[0] == pieces.groupBy("doc_id").agg((F.max("doc_tokens") * F.count_if(F.col("start") == 0)).alias("n")).agg(F.sum("n")).first()[0]
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n < 2048").count()
    assert full <= 1


def test_run_is_the_stages(spark, corpus):
    where, *_ = corpus
    assert P.run(spark, where).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_copies_are_gone_whatever_the_order(spark, corpus):
    where, rows, _ = corpus
    docs = table(spark, where, "documents").repartition(7)
    kept = P.unique(spark, docs, where)
    assert kept.count() == len({r[1] for r in rows})


CLASHES = "mix_id long, mix_copy long, mix_copies long, doc string, score double, node long, kept boolean"


@pytest.mark.parametrize("rows", ["some", "none"])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    """Null texts, ids and sources, repeated rows, long texts and clashing columns, or no rows at all."""
    extra = (1, 2, 3, "d", 0.5, 4, True)
    long_text = " ".join(f"w{i % 700}" for i in range(20_000))
    made = [(1, "a b c", "en", "s", 5, *extra), (1, "a b c", "en", "s", 5, *extra), (None, "a b d", "en", None, 5, *extra), (2, None, None, "t", None, *extra), (3, "", "en", "t", 0, *extra), (4, long_text, "en", "s", 9, *extra), (5, long_text + " x", "en", "s", 9, *extra)]
    spark.createDataFrame(made if rows == "some" else [], f"{COLUMNS}, {CLASHES}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    ids = {}
    for name, stage in P.STAGES:
        out = written(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        if name != "pack":
            assert out.columns == docs.columns
            assert all(tuple(r)[5:] == extra for r in out.collect())
            docs = out
        ids[name] = sorted({str(r["doc_id"]) for r in out.collect()})
    if rows == "none":
        assert not any(ids.values())
    else:
        assert ids["toxicity"] == ["1", "2", "3", "4", "5", "None"]
        assert len(set(ids["exact_dedup"]) & {"2", "3"}) == 1 and ids["near_dedup"][-1] == "None" and "5" not in ids["near_dedup"]
        assert not {"2", "3"} & set(ids["mix"]) and ids["pack"] == ids["mix"]
