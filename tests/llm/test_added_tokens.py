"""Added tokens in texts, as the packing query and the pipeline's last stage have them."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from barloom.llm.queries import op8_packing, tokenizer_file


@pytest.mark.parametrize("stage", ["query", "pipeline"])
def test_added_tokens_are_one_id(spark, stage, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(14)
    parts = ["The ", "quick", "  ", "\n", "don't ", "<|endoftext|>", "<|endoftext", "|>", "<|ENDOFTEXT|>", "é"]
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", *("".join(rng.choices(parts, k=rng.randrange(0, 80))) for _ in range(60))]
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    assert want[0].tolist() == [64, 50256, 65, 1]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    if stage == "query":
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        rows = op8_packing(spark, str(tmp_path)).collect()
    else:
        rows = corpus_pipeline.packed(spark, docs, "").collect()
    at = dict.fromkeys(want, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        x = want[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(x)
        at[r["doc_id"]] += r["length"]
        assert zlib.crc32(x[r["start"] : at[r["doc_id"]]].tobytes()) == r["ids_crc32"]
    assert at == {i: len(x) for i, x in want.items()}
