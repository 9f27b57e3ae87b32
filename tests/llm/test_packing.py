import math
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortkit.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string"


def _ids(text):
    return [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, limit=packing.LIMIT):
    """Pieces rebuild every document; sequences have no gap, overlap or overflow."""
    for doc, part in rows.groupby("doc_id"):
        ids = _ids(texts[doc])
        part = part.sort_values("piece")
        assert part["length"].sum() == len(ids)
        assert list(part["piece"]) == list(range(len(part)))
        at = 0
        for k, r in enumerate(part.itertuples()):
            assert r.start == at and (r.length == limit or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert len(part) == math.ceil(len(ids) / limit)
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert list(part["offset"]) == list(part["length"].cumsum() - part["length"])
        assert part["length"].sum() <= limit


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "word " * 3000, 4: "y<|endoftext|><|endoftext|> x <|endoftext|", 5: "é ü 漢字", 6: "a" * 5000, 7: "x", 8: "x",
             9: " " * 1_000_000 + "x", 10: "\n" * 400_000 + "é", 11: "a" * 300_000, 12: "<|endoftext|>" + " " * 400_000 + "z"}
    docs = spark.createDataFrame([(k, v, None, None, None, "clash") for k, v in texts.items()], SCHEMA)
    check(packing.pack(docs).toPandas(), texts)
    assert packing.pack(docs.limit(0)).count() == 0
    again = packing.pack(docs.filter("doc_id = 7").unionAll(docs.filter("doc_id = 7"))).toPandas()
    assert len(again) == 2 and again["sequence_id"].nunique() == 1 and sorted(again["offset"]) == [0, 2]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs).toPandas()
    check(rows, dict(docs.select("doc_id", "text").toPandas().values))
    assert rows["sequence_id"].nunique() <= math.ceil(rows["length"].sum() / packing.LIMIT) + 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1))
def test_patterns_use_every_piece_once(counts):
    found = packing.patterns(counts, 50)
    used = pd.Series([x for times, bin_ in found for x in bin_ * times]).value_counts().to_dict()
    assert used == counts
    assert all(sum(b) <= 50 for _, b in found)


def test_two_replace_the_smallest():
    # greedy fills 60 + 30 (gap 10); 21 + 19 fit the widened gap of 40 exactly
    assert packing.patterns({60: 1, 30: 1, 21: 1, 19: 1}, 100)[0] == (1, [60, 21, 19])


@pytest.mark.parametrize("limit", [1, 2])
def test_tiny_limits(limit):
    assert sum(t * len(b) for t, b in packing.patterns({1: 5}, limit)) == 5
