import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortkit.llm import queries
from cohortkit.llm.token_counts import TokenStore

DOCS = "doc_id long, text string, source string, lang string, tokenizer string, n_tokens string"


def bpe(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return len(t.encode(text or "", add_special_tokens=False).ids)


COUNT = {"words-1": lambda t: len((t or "").split()), "byte_bpe_50k": bpe}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)


def brute(rows, versions):
    docs, toks = Counter(), Counter()
    for _, text, source, lang in rows:
        for v in versions:
            docs[source, lang, v] += 1
            toks[source, lang, v] += COUNT[v](text)
    return {k: (docs[k], toks[k]) for k in docs}


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


ROWS = [(1, "a b c", "s", "en"), (2, None, "s", "en"), (3, "", None, None), (4, "x " * 5000, "t", "de"),
        (4, "again", "t", "de"), (None, "no id", "s", "en"), (5, "<|endoftext|> é", "s", "fr")]


def test_signed_batches(spark, tmp_path):
    store, both = TokenStore(spark, f"file://{tmp_path}/store"), ["words-1", "byte_bpe_50k"]
    assert totals(store) == {} and store.batches() == []
    assert store.commit("1", frame(spark, ROWS))
    assert totals(store) == brute(ROWS, both)
    assert not store.commit("1", frame(spark, ROWS)) and totals(store) == brute(ROWS, both)  # the same batch again
    # a revision moves a document to another source; the repeated id is taken back twice
    new = [(1, "a b c d", "u", "en"), (4, "short", "t", "de"), (9, "nine", "s", "en")]
    assert store.commit("2", frame(spark, new))
    rest = [r for r in ROWS if r[0] not in (1, 4)]
    assert totals(store) == brute(rest + new, both)
    # deletes, unknown ones too, and an id that is deleted and upserted
    gone = spark.createDataFrame([(3,), (77,), (9,), (None,), (3,)], "doc_id long")
    assert store.commit("3", frame(spark, [(9, "nine again", "s", "en")]), gone)
    now = [r for r in rest + new if r[0] not in (3, 9)] + [(9, "nine again", "s", "en")]
    assert totals(store) == brute(now, both)
    # one version alone is recounted
    assert store.commit("4", frame(spark, [(5, "five", "s", "fr")]), versions=["words-1"])
    want = brute([r for r in now if r[0] != 5] + [(5, "five", "s", "fr")], ["words-1"])
    want |= brute(now, ["byte_bpe_50k"])
    assert totals(store) == want
    assert store.commit("5", frame(spark, []), gone.limit(0)) and totals(store) == want
    assert store.batches() == ["1", "2", "3", "4", "5"]


def test_broken_batch_is_not_counted_and_can_be_repeated(spark, tmp_path):
    store = TokenStore(spark, f"file://{tmp_path}/store")
    store.commit("1", frame(spark, ROWS))
    before = totals(store)
    half = tmp_path / "store/deltas/batch=2"   # as a lost driver leaves it: files, no marker
    frame(spark, ROWS).select("source", "lang", "tokenizer").write.parquet(f"file://{half}")
    (half / "_SUCCESS").unlink()
    assert totals(store) == before and store.batches() == ["1"]
    assert store.commit("2", frame(spark, [(50, "z", "s", "en")]))
    assert totals(store)["s", "en", "words-1"] == (before["s", "en", "words-1"][0] + 1, before["s", "en", "words-1"][1] + 1)


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]
    first = {}
    for r in sorted(rows):
        first.setdefault(r[1] or "", r[0])
    kept = [r for r in rows if first[r[1] or ""] == r[0]]
    plain = [(i, t and re.sub(r"[ \t-\r]+", " ", t).strip(" "), *rest) for i, t, *rest in kept]
    assert plain != kept  # the query revises counts
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens)
           for r in queries.QUERIES["op7_token_counts"](spark, sf).collect()}
    assert got == brute(plain, list(COUNT))


@pytest.mark.parametrize("text", ["a  b\tc\nd\x0be", "a b", ""])
def test_words(text):
    from cohortkit.llm.token_counts import TOKENIZERS
    assert TOKENIZERS["words-1"](text) == len([w for w in __import__("re").split(r"[ \t-\r]+", text) if w])
