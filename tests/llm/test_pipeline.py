"""The pipeline's stages against brute force, each on its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from tests.llm.brute import WORD, components
from tests.llm.test_blocks_operators import brute_bpe
from tests.llm.test_native_operators import brute_quality, brute_spans


@pytest.mark.parametrize("which", ["odd", "table"])
def test_stages(spark, odd_docs, sf_dir, tmp_path, which):
    docs = odd_docs if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, results = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(i))
        df = stage(spark, docs, sf_dir)
        df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"}).write.parquet(out)
        results[name] = (docs.collect(), spark.read.parquet(out).collect(), spark.read.parquet(out).columns)
        docs = spark.read.parquet(out)
    assert all(results[name][2] == columns for name, _ in corpus_pipeline.STAGES[:-1])
    before, after, _ = results["quality"]
    assert all(not brute_quality(r.text or "")[-1] for r in after) and len(after) >= 0.8 * sum(not brute_quality(r.text or "")[-1] for r in before)
    before, after, _ = results["near_dedup"]
    groups = components([(r.doc_id, r.text) for r in before])
    assert Counter(r.doc_id for r in after) == Counter({c: 1 for c in {c for _, _, c, _ in groups}})
    before, after, _ = results["personal_data"]
    spans = {(r.doc_id, r.text): brute_spans(r.text or "") for r in before}
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after) and not any(brute_spans(r.text or "") for r in after)
    clean = {r.doc_id: r.text for r in after}
    assert all(clean[i] == t for (i, t), found in spans.items() if not found)
    before, after, _ = results["mixture"]
    words = lambda rows: sum(len(WORD.findall(r.text or "")) for r in rows)
    assert set(r.text for r in after) <= set(r.text for r in before) and max(Counter(r.doc_id for r in after).values()) <= 3
    assert abs(words(after) - words(before)) <= sum(sorted(len(WORD.findall(r.text or "")) for r in before)[-40:])
    before, after, _ = results["token_ids"]
    want = brute_bpe([(r.doc_id, r.text) for r in before])
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == want
    assert all(hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 for r in after)
