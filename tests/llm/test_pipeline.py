import importlib.util
import sys
from pathlib import Path

import corpus_pipeline
from cohortkit.llm import decontaminate as dc
from cohortkit.llm import secrets as sc

HERE = Path(__file__).parent
SF = "/root/testdata/sf0.001"


def _other(name):
    """Brute-force versions live beside the operators' tests."""
    spec = importlib.util.spec_from_file_location(f"llm_{name}", HERE / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = module
    spec.loader.exec_module(module)
    return module


def run_stages(spark, docs, sf, path):
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        df = f(spark, out[-1], sf)
        df.write.parquet(f"file://{path}/{k}")
        out.append(spark.read.parquet(f"file://{path}/{k}"))
    return out


def test_stages_against_brute_force(spark, tmp_path):
    quality, near, packing = _other("test_quality_rules"), _other("test_near_dedup"), _other("test_packing")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tables = run_stages(spark, docs, SF, tmp_path)
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:-1]]
    for t in tables[1:-1]:
        assert t.columns == docs.columns and t.dtypes == docs.dtypes
    # quality: every rejected text breaks a rule, every text that breaks a base rule is rejected
    for i, r in rows[0].items():
        n, _, symbols, dup, repeat = quality.brute(r.text)
        base = n < 50 or 100 * repeat > 50 * n
        assert not (base and i in rows[1])
        assert i in rows[1] or base or symbols or dup or repeat
    # near-dedup: the smallest id of each component
    comp = near.brute([(i, r.text) for i, r in rows[1].items()])
    assert set(rows[2]) == {i for i in rows[1] if comp[i][1] == i}
    # decontamination: hit passages are gone, other texts untouched
    hit = dc_brute(rows[2], items)
    for i, r in rows[2].items():
        want = dc.cut_words(r.text, hit[i]) if hit[i] else r.text
        assert rows[3][i].text == want and rows[3][i].n_chars == (len(want) if hit[i] else r.n_chars)
    # secrets: no base match but masks; texts without any span are untouched
    for i, r in rows[3].items():
        text = rows[4][i].text
        assert not [s for s in sc.base_spans(text) if "SECRET" not in text[s[0]:s[2] + 8]]
        if text != r.text:
            assert "[SECRET]" in text and rows[4][i].n_chars == len(text)
    packing.check(tables[-1].toPandas(), {i: r.text for i, r in rows[4].items()})
    got = corpus_pipeline.run(spark, SF).toPandas()
    packing.check(got, {i: r.text for i, r in rows[4].items()})


def dc_brute(rows, items):
    """doc_id -> merged word spans of all windows, by plain comparison."""
    windows = set()
    for _, text in items:
        w = dc.words(text)
        k = min(10, len(w))
        windows |= {tuple(w[i:i + k]) for i in range(len(w) - k + 1) if k}
    out = {}
    for i, r in rows.items():
        w = dc.words(r.text)
        out[i] = dc.merge([[j, j + k] for k in {len(x) for x in windows} for j in range(len(w) - k + 1)
                           if tuple(w[j:j + k]) in windows])
    return out


def test_edge_documents_pass_through(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(120))
    rows = [(1, good, "en", None, 5, "x"), (2, None, None, None, None, "x"), (3, "", "en", "s", 0, None),
            (4, good, "en", "s", 5, "x"), (5, good.replace("word", "other") + " password=abcdefgh1", None, "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")
    bench = spark.createDataFrame([(1, " ".join(f"other{i}" for i in range(20)))], "item_id long, text string")
    bench.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    tables = run_stages(spark, docs, f"file://{tmp_path}", tmp_path / "run")
    assert [sorted(r.doc_id for r in t.collect()) for t in tables[1:5]] == [[1, 4, 5], [1, 5], [1, 5], [1, 5]]
    last = {r.doc_id: r for r in tables[4].collect()}
    assert last[1].text == good and last[1].spans == "x"
    assert "other19 " not in last[5].text and last[5].text.endswith("password=[SECRET]")
    empty = run_stages(spark, docs.limit(0), f"file://{tmp_path}", tmp_path / "empty")
    assert [t.count() for t in empty] == [0] * 6


