"""The pipeline against a brute-force version of each stage, and what registration promises."""

import hashlib
import re

import numpy as np
import pytest
from test_operators import brute_components, brute_leaks

import corpus_pipeline
from plumbline.llm import registry, secrets

P = pytest.importorskip("public_tokenizers")


def test_pipeline_equals_brute_force(spark, fixture_rows, tmp_path):
    import tiktoken

    from plumbline.llm import byte_bpe

    rows = [r for r in fixture_rows if r[0] is not None]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    items = [(1, " ".join(rows[11][1].split(" ")[5:55])), (2, "short one")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = []
    for i, t, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        cover = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 5)} if len(grams) < 3000 else set(range(len(w)))
        if len(w) >= 10 and 100 * len(cover) <= 20 * len(w):
            left.append((i, t))
    kept = brute_components(left)
    left = [(i, t) for i, t in dict(left).items() if kept[i][2]]
    leaks = {i for i, _ in brute_leaks(left, items)}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expect = {}
    for i, t in left:
        if i not in leaks:
            ids = np.array(ref.encode_ordinary(secrets.redact(t)), "<u4")
            expect[i] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in out} == expect and len(out) == len(expect)
    assert leaks and 11 in leaks


def test_stages_keep_the_columns(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, f"file://{tmp_path}").columns == table.columns


def test_registered_queries():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in registry.QUERIES if q != "pipeline"}
    assert set(registry.ORACLES) <= set(registry.QUERIES)
