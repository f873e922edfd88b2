"""Near duplicates against all pairs, neighbours against all products, toxicity against held-out labels."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.brute import components


@pytest.mark.parametrize("which", ["odd", "table"])
def test_near_duplicates(spark, odd_docs, sf_dir, which):
    from tilequarry.llm import neardup

    docs = odd_docs if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = neardup.dedup(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(components(rows))
    left = neardup.survivors(docs)
    assert left.columns == docs.columns
    sizes = Counter((r.component_id, r.n_shingles > 0) for r in got)
    empty = sum(n for (_, worded), n in sizes.items() if not worded)
    assert left.count() == empty + len([1 for (_, worded) in sizes if worded])


def test_near_duplicates_of_an_empty_table(no_docs):
    from tilequarry.llm import neardup

    assert neardup.dedup(no_docs).count() == neardup.survivors(no_docs).count() == 0


def brute_neighbours(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        other = ids != ids[i]
        order = np.lexsort((ids[other], -s[other]))[:k]
        out[int(ids[i])] = [(int(a), float(b)) for a, b in zip(ids[other][order], s[other][order])]
    return out


def recall(got, want):
    found = defaultdict(dict)
    for r in got:
        found[r.query_id][r.vec_id] = r.score
    return np.mean([len({a for a, _ in v} & set(found[q])) / len(v) for q, v in want.items()]), found


def test_neighbours(spark, sf_dir):
    from tilequarry.llm import ann

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = ann.search(table).collect()
    want = brute_neighbours(ids, x)
    share, found = recall(got, want)
    assert share >= 0.9 and set(found) == set(want) and all(len(v) == 20 for v in found.values())
    place = {i: k for k, i in enumerate(ids.tolist())}
    assert all(abs(s - float((x[place[q]] * x[place[v]]).sum())) < 1e-12 for q, vs in found.items() for v, s in vs.items())
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r["rank"], -r.score, r.vec_id))
    assert all([a[0] for a in sorted(v)] == list(range(1, 21)) and sorted(v) == sorted(v, key=lambda a: (a[1], a[2])) for v in by.values())


def test_neighbours_in_many_cells(spark, monkeypatch):
    from tilequarry.llm import ann

    monkeypatch.setattr(ann, "SLAB", 200)
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.standard_normal((900, 16)), np.tile(rng.standard_normal(16), (300, 1)), rng.standard_normal((300, 16)) * 3))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    share, _ = recall(ann.search(table).collect(), brute_neighbours(np.arange(1500), x))
    assert share >= 0.9


def test_copies_of_one_row(spark, monkeypatch):
    """A third of all rows one row, and an id with two vectors: its query is the smaller one, copies are candidates each."""
    from tilequarry.llm import ann

    monkeypatch.setattr(ann, "SLAB", 100)
    monkeypatch.setattr(ann, "LEAF", 16)
    x = np.random.default_rng(8).standard_normal((400, 8))
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(1000, [9.0] * 8)] * 200 + [(20, [-5.0] * 8)]
    shape = "vec_id bigint, embedding array<double>"
    got = ann.search(spark.createDataFrame(rows, shape).repartition(7)).collect()
    of = lambda q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
    smaller = min([x[19].tolist(), [-5.0] * 8])
    want = sorted(((-float(np.dot(v, smaller)), i) for i, v in rows if i != 20))[:20]
    assert [i for i, _ in of(20)] == [i for _, i in want]
    aligned = next(q for q in range(40, 401, 20) if sum(x[q - 1]) > 2)
    assert of(aligned) == [(1000, pytest.approx(9 * sum(x[aligned - 1])))] * 20
    assert len(of(1000)) == 20 and 1000 not in dict(of(1000))


def test_neighbours_of_awkward_rows(spark):
    from tilequarry.llm import ann

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 1.0], 1), (1, [0.5, 0.0], None), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (None, [1.0, 2.0], 1), (8, [0.5, 0.0], 2), (8, [0.5, 0.0], 2)]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cell int")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [(1, 20, 1.0), (2, 1, 0.5), (3, 8, 0.5), (4, 8, 0.5)]
    assert {r.query_id for r in got} == {0, 20}
    assert ann.search(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    from tilequarry.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert area > 0.75
    again = toxicity.score(docs.repartition(5), labels.repartition(3)).collect()
    assert sorted((r.doc_id, r.score) for r in got) == sorted((r.doc_id, r.score) for r in again)


def test_toxicity_of_awkward_rows(spark, odd_docs, no_docs):
    from tilequarry.llm import toxicity

    labels = spark.createDataFrame([(4, None, 1), (5, 1, 0), (5, 1, 0), (None, 1, 1), (101, 1, None), (102, 0, 1), (103, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.score(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.score(odd_docs, labels.limit(0)).collect()} <= {x for x in [0.0, *[r.score for r in toxicity.score(odd_docs, labels.limit(0)).limit(1).collect()]]}


def test_isotonic_fit():
    from tilequarry.llm import toxicity

    rng = np.random.default_rng(0)
    m = rng.normal(size=500)
    x, y = toxicity.isotonic(m, (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n]


def test_long_words_of_two_letters_differ(spark):
    """Words that a polynomial hash modulo 2**64 cannot tell apart are two words, and their texts no duplicates."""
    from tilequarry.llm import lm, neardup

    one = thue_morse(2048)
    docs = spark.createDataFrame([(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one.upper())], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in neardup.dedup(docs).collect()) == [(1, 1, True), (2, 2, True), (3, 1, False)]
    known = {r.doc_id: (r.train_tokens, r.base_score) for r in lm.score(docs).collect()}
    assert known[1] == known[3] != known[2]


@pytest.mark.parametrize("sizes", [{"FAMILY": 8192, "BLOCK": 256, "SMALL": 200_000}, {"FAMILY": 8192, "BLOCK": 8, "SMALL": 0}, {"FAMILY": 2, "BLOCK": 8, "FEW": 3}])
def test_dense_near_duplicates(spark, monkeypatch, sizes):
    """A group whose members lie on both sides of the threshold, by every route that sizes can choose."""
    import random

    from tilequarry.llm import neardup

    for name, value in sizes.items():
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = base.copy()
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = f"x{rng.randrange(8)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"y{rng.randrange(40)}" for _ in range(30))) for i in range(20)]
    got = neardup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(components(rows))


def chain(seed):
    """Two linked texts (2 and 3), each with another, heavier partner below the threshold that draws it away in the first turn."""
    import random

    pick = random.Random(seed)
    fresh = lambda n: [f"w{pick.randrange(10**9)}" for _ in range(n)]
    new = lambda of, at, size: of[:at] + fresh(size) + of[at + size :]
    one = fresh(200)
    two = new(one, 0, 42)
    three = new(two, 60, 22)
    four = new(three, 100, 42)
    docs = [one, two, three, four] + [new(one, at, 42) for at in range(50, 150, 12)] + [new(four, at, 42) for at in (*range(0, 60, 12), *range(142, 160, 5))]
    return [(i + 1, " ".join(words)) for i, words in enumerate(docs)]


@pytest.mark.parametrize("seed", [12, 26])
def test_buckets_of_two_that_no_turn_compared(spark, seed):
    """A link is found although both ends' best hubs are others and no larger bucket holds them."""
    from tilequarry.llm import neardup

    rows = chain(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = components(rows)
    assert want[2][2:] == (2, False)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.dedup(docs).collect()) == Counter(want)
    assert sorted(r.doc_id for r in neardup.survivors(docs).collect()) == sorted(r[0] for r in want if r[3])


def plain_margin(tree, row):
    at = 0
    while not isinstance(tree[at], float):
        feature, value, left, right = tree[at]
        at = left if row[feature] <= value else right
    return tree[at]


def plain_isotonic(margins, truth):
    """Means of the largest blocks by the max-min formula, at every distinct margin."""
    places = sorted(set(margins))
    at = [[t for m, t in zip(margins, truth, strict=True) if m == p] for p in places]
    out = []
    for i in range(len(places)):
        best = 0.0
        for j in range(i + 1):
            means = []
            for k in range(i, len(places)):
                pool = [t for some in at[j : k + 1] for t in some]
                means.append(sum(pool) / len(pool))
            best = max(best, min(means))
        out.append(best)
    return places, out


def test_toxicity_against_a_plain_version():
    """Leaf sums row by row, and the max-min form of the isotonic fit, give the same scores."""
    from tilequarry.llm import toxicity

    rng = np.random.default_rng(8)
    x = rng.random((200, len(toxicity.NAMES))).round(2)
    y = (rng.random(200) < 0.2 + 0.6 * (x[:, 3] > 0.6)).astype(float)
    part = rng.integers(2, 6, 200)
    model = toxicity.calibrated(x, y, part)
    assert model.knots is not None
    margin = np.array([model.prior + sum(plain_margin(t, r) for t in model.trees) for r in x])
    assert np.allclose(margin, model.margin(x))
    crossed = np.empty(200)
    for k in range(2, 6):
        fold = toxicity.boosted(x[part != k], y[part != k])
        crossed[part == k] = [fold.prior + sum(plain_margin(t, r) for t in fold.trees) for r in x[part == k]]
    places, want = plain_isotonic(crossed.tolist(), y.tolist())
    got = np.interp(places, *toxicity.isotonic(crossed, y))
    pools = toxicity.isotonic(crossed, y)[1]
    assert (np.diff(pools) > 0).all() and all(min(abs(pools - w)) < 1e-9 for w in want) and (np.diff(got) >= -1e-12).all()
    first = toxicity.boosted(x, y).trees[0][0]
    p = y.mean()
    gain = lambda mask: ((p - y)[mask].sum()) ** 2 / (mask.sum() * p * (1 - p) + toxicity.RIDGE)
    edges = [(f, v) for f in range(x.shape[1]) for v in np.unique(np.quantile(x[:, f], np.linspace(0, 1, toxicity.BINS + 1)[1:-1]))]
    best = max(gain(x[:, f] <= v) + gain(x[:, f] > v) for f, v in edges)
    assert abs(gain(x[:, first[0]] <= first[1]) + gain(x[:, first[0]] > first[1]) - best) < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_toxicity_is_calibrated_at_every_size(spark, sf):
    from tilequarry.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    _, model = toxicity.fit(docs, labels)
    assert model.knots is not None


def test_pipeline_stage_finds_links_of_buckets_of_two(spark, tmp_path):
    """The pipeline's near_dedup keeps one text of a group whose only link no turn compares."""
    import corpus_pipeline

    rows = chain(12)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows} - {3}
