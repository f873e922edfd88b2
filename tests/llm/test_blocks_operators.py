"""Operators on blocks (LM scoring, suffix-array dedup, BPE) against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def docs_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def brute_base(rows):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    count = Counter(w for i, ws in tokens if not fold(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return Counter((i, fold(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)


@pytest.mark.parametrize("broadcast", [1 << 28, 0])
def test_lm_base_scores(spark, odd_docs, sf_dir, broadcast):
    from tilequarry.llm import lm

    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = lm.score(docs, broadcast).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_base(docs_of(docs))
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_scores_do_not_depend_on_the_route(spark, odd_docs):
    from tilequarry.llm import lm

    a, b = (sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score(odd_docs, m).collect()) for m in (1 << 28, 0))
    assert a == b


def test_lm_filter_counts():
    import numpy as np

    from tilequarry.llm import lm, textnum

    keys = np.sort(textnum.mixed(np.arange(1, 20001, dtype=np.uint64)))
    counts = np.arange(1, 20001) % 90 + 1
    model = lm.Filter({0: lm.segment((keys, counts), (keys[:0], counts[:0]))}, 1)
    got = model.levels(keys, 0)
    assert (got >= lm.level(counts)).all() and (got == lm.level(counts)).mean() > 0.98
    assert (model.levels(textnum.mixed(np.arange(30000, 60000, dtype=np.uint64)), 0) > 0).mean() < 0.02


def test_lm_learns(spark, sf_dir):
    """On held-out texts the bigram model beats the unigrams, which know nothing of what comes before."""
    from tilequarry.llm import lm

    text = " ".join(f"a{i % 7} b{i % 7}" for i in range(200))
    rows = [(i, text) for i in range(60)]
    got = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def brute_dedup(rows):
    first: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            key = math.inf if i is None else i
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], math.inf), key)
    out = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < (math.inf if i is None else i):
                mark[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        out[i, len(raw), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup(spark, odd_docs, sf_dir):
    from tilequarry.llm import suffix

    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = suffix.dedup(docs, ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_dedup(docs_of(docs))
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed for r in got)


def test_suffix_array_is_sorted():
    import numpy as np

    from tilequarry.llm import suffix

    rng = np.random.default_rng(3)
    for trial in range(150):
        text = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 150)))
        if trial % 3 == 0:
            text = np.tile(text[: max(1, len(text) // 5)], 6)
        plain = text.tolist()
        want = sorted(range(len(plain)), key=lambda i: plain[i:])
        assert suffix.suffix_array(text, 5).tolist() == want
        assert suffix.suffix_array(text, suffix.WIDE + 1).tolist() == want


def brute_bpe(rows):
    import base64

    import public_tokenizers as tokenizers
    import tiktoken

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for i, t in rows:
        ids = whole.encode_ordinary(t or "")
        out[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def test_bpe(spark, odd_docs, sf_dir):
    import public_tokenizers as tokenizers

    from tilequarry.llm import bpe

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = bpe.encode(docs, path, tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256")).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == brute_bpe(docs_of(docs))
    back = bpe.decode(bpe.encode(odd_docs, path, tokenizers.PATTERN, ("ids",)), path, tokenizers.PATTERN)
    want = Counter((r.doc_id, bytes((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == want


def test_empty_tables(no_docs):
    import public_tokenizers as tokenizers

    from tilequarry.llm import bpe, lm, suffix

    assert lm.score(no_docs).count() == 0
    assert suffix.dedup(no_docs).count() == 0
    assert bpe.encode(no_docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).count() == 0
    assert F is not None
