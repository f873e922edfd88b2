"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.llm import blocks, scratch, textnum

#: Labelled rows of folds other than 0 of FOLDS teach; at most SAMPLE of them, by the hash of their id.
FOLDS, SAMPLE = 5, 20_000
#: Learned words, and toxic documents that each must be in (or this share of them).
LEARNED, MIN_DOCS, MIN_SHARE = 256, 3, 0.005
#: Trees, their depth, step and regularisation; bins of a feature.
TREES, DEPTH, STEP, RIDGE, LEAST, BINS = 80, 3, 0.12, 1.0, 5.0, 32
#: Words on either side of a second-person word in which an insult is near.
REACH = 5
#: Insults of four languages, and words for the second person.
INSULTS = """idiot idiots stupid moron morons loser losers trash scum clown pathetic worthless disgusting dumb fool garbage jerk imbecile coward liar ugly filthy
dumm idiotin trottel depp abschaum wertlos widerlich versager arschloch dreckig
imbecile connard crétin minable salaud pathétique dégoûtant nul débile ordure
estúpido estúpida imbécil basura escoria patético payaso inútil asqueroso perdedor""".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros eres".split()
#: Characters that stand for letters, and what they stand for.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
NAMES = ("words", "capitals", "shouted", "exclaims", "questions", "marks", "symbols", "digits", "wide", "stretched", "insults", "insult_rate", "learned", "learned_rate", "hidden", "hidden_rate", "person_rate", "near", "near_rate")

_U = np.uint64
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)


def hashes(words: list[str]) -> np.ndarray:
    """Ascending distinct hashes of the words, as textnum has them."""
    return np.unique(textnum.words(textnum.joined([w.lower().encode() for w in words])[0])[2])


def _in(keys: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon) or not len(keys):
        return np.zeros(len(keys), bool)
    return lexicon[np.minimum(np.searchsorted(lexicon, keys), len(lexicon) - 1)] == keys


def _kept(data: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], place[starts]


def plain_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word, without ASCII punctuation."""
    own, at = _kept(data, starts, ~_PUNCT[data])
    s, _, h = textnum.words(own)
    return h, np.searchsorted(at, s, "right") - 1


def features(texts: list[bytes], learned: np.ndarray) -> np.ndarray:
    """NAMES of every text; all 0 for an empty one."""
    n = len(texts)
    data, starts = textnum.joined(texts)
    tally = lambda mask: np.add.reduceat(mask, starts[:-1], dtype=np.int64).astype(float)
    size = np.maximum(1.0, np.diff(starts) - 1)
    upper = (data >= 65) & (data <= 90)
    letters = np.maximum(1.0, tally(_LETTER[data]))
    s, e, _ = textnum.words(data)
    doc = np.searchsorted(starts, s, "right") - 1
    ups = np.concatenate(([0], np.cumsum(upper)))
    shouted = (e - s >= 3) & (ups[e] - ups[s] >= 0.8 * (e - s))
    words = np.bincount(doc, minlength=n).astype(float)
    per = np.maximum(1.0, words)
    lower = textnum.LOWER[data]
    thrice = np.zeros(len(data), bool)
    thrice[2:] = (lower[2:] == lower[1:-1]) & (lower[1:-1] == lower[:-2]) & _LETTER[data[2:]]
    keys, of = plain_words(data, starts)
    insults, people = hashes(INSULTS), hashes(SECOND_PERSON)
    bad, own, person = _in(keys, insults), _in(keys, learned), _in(keys, people)
    mapped = _LEET[lower]
    hid, at = _kept(mapped, starts, ~(_PUNCT[mapped] | thrice | ((mapped >= 48) & (mapped <= 57))))
    hs, _, hidden = textnum.words(hid)
    hidden_of = np.searchsorted(at, hs, "right") - 1
    both = np.union1d(insults, learned)
    near_any = bad | own
    sums = np.concatenate(([0], np.cumsum(near_any)))
    where = np.flatnonzero(person)
    first = np.searchsorted(of, np.arange(n + 1))
    low = np.maximum(where - REACH, first[of[where]])
    high = np.minimum(where + REACH + 1, first[of[where] + 1])
    close = np.bincount(of[where], weights=(sums[high] - sums[low] > 0).astype(float), minlength=n)
    by = lambda mask, d: np.bincount(d[mask], minlength=n).astype(float)
    n_bad, n_own, n_hidden = by(bad, of), by(own, of), np.maximum(0, by(_in(hidden, both), hidden_of) - by(_in(keys, both), of))
    marks = [tally(data == ord(c)) for c in "!?"]
    columns = [
        np.log1p(words), tally(upper) / letters, by(shouted, doc) / per, marks[0] / size, marks[1] / size, tally(_PUNCT[data]) / size, tally(np.isin(data, np.frombuffer(b"#*$%&|<>@^~", np.uint8))) / size,
        tally((data >= 48) & (data <= 57)) / size, tally(data >= 128) / size, tally(thrice) / size, np.log1p(n_bad), n_bad / per, np.log1p(n_own), n_own / per, np.log1p(n_hidden), n_hidden / per, by(person, of) / per, np.log1p(close), close / per,
    ]
    return np.column_stack(columns) * (np.diff(starts) > 1)[:, None]


# -- the model -------------------------------------------------------------------------------------


@dataclass
class Model:
    """Trees as (feature, value, left, right) or leaf weights; margins to probabilities by knots."""

    prior: float
    trees: list
    knots: tuple[np.ndarray, np.ndarray] | None

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for tree in self.trees:
            todo = [(0, np.arange(len(x)))]
            while todo:
                at, rows = todo.pop()
                node = tree[at]
                if isinstance(node, float):
                    out[rows] += node
                elif len(rows):
                    below = x[rows, node[0]] <= node[1]
                    todo += [(node[2], rows[below]), (node[3], rows[~below])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.margin(x)
        if self.knots is None:
            return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return np.clip(np.interp(margin, *self.knots), 0.0, 1.0)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit: pooled adjacent violators, each pool at its mean margin."""
    place, which = np.unique(margin, return_inverse=True)
    count = np.bincount(which).astype(float)
    pools: list[list[float]] = []
    for m, v, n in zip((place * count).tolist(), np.bincount(which, y).tolist(), count.tolist(), strict=True):
        pools.append([m, v, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    n = np.array([p[2] for p in pools])
    return np.array([p[0] for p in pools]) / n, np.array([p[1] for p in pools]) / n


def boosted(x: np.ndarray, y: np.ndarray) -> Model:
    """Trees on the logistic loss, split at the best of BINS quantiles of a feature."""
    rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(float(np.log(rate / (1 - rate))) if len(y) else -30.0, [], None)
    model = Model(float(np.log(rate / (1 - rate))), [], None)
    edges = [np.unique(np.quantile(f, np.linspace(0, 1, BINS + 1)[1:-1])) for f in x.T]
    binned = np.column_stack([np.searchsorted(e, f, "left") for e, f in zip(edges, x.T, strict=True)])
    margin = np.full(len(y), model.prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        tree: list = [None]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            if depth < DEPTH:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + RIDGE) + (gs - left_g) ** 2 / (hs - left_h + RIDGE) - gs**2 / (hs + RIDGE)
                    gain[(left_h < LEAST * 0.05) | (hs - left_h < LEAST * 0.05)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            if best[1] is None:
                tree[at] = float(-STEP * gs / (hs + RIDGE))
                margin[rows] += tree[at]
                continue
            _, f, k = best
            below = binned[rows, f] <= k
            tree[at] = (f, float(edges[f][k]), len(tree), len(tree) + 1)
            todo += [(len(tree), rows[below], depth + 1), (len(tree) + 1, rows[~below], depth + 1)]
            tree += [None, None]
        model.trees.append(tree)
    return model


def calibrated(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> Model:
    """Trees of all rows, calibrated by the margins that trees of the other parts give each part.

    So every row calibrates, at every size, and none by trees that have seen it. Without rows the
    model is constant and needs no calibration.
    """
    model = boosted(x, y)
    if len(y):
        margin = np.empty(len(y))
        for k in np.unique(part):
            other = part != k
            margin[~other] = (boosted(x[other], y[other]) if other.any() else model).margin(x[~other])
        model.knots = isotonic(margin, y)
    return model


# -- Spark -----------------------------------------------------------------------------------------


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % FOLDS == 0


def _distinct(block: int, ids: list, texts: list[bytes]) -> Iterator[tuple]:
    data, starts = textnum.joined(texts)
    keys, of = plain_words(data, starts)
    cuts = np.searchsorted(of, np.arange(len(ids) + 1))
    for i, doc_id in enumerate(ids):
        yield doc_id, np.unique(keys[cuts[i] : cuts[i + 1]]).view(np.int64)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Model]:
    """The learned lexicon and the model, from at most SAMPLE labelled rows outside fold 0.

    A third of the sample chooses the words, the rest grows and calibrates the trees, so that no
    word is judged by the rows that chose it. Of documents that share an id the one of the smallest
    text hash counts, so the driver gets at most a row of features an id. Without telling words
    the features of the learned lexicon are 0.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold % FOLDS != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toPandas()
    if not len(chosen):
        return np.zeros(0, _U), boosted(np.zeros((0, len(NAMES))), np.zeros(0))
    role = np.array([zlib.crc32(b"role%d" % i) % 6 for i in chosen["doc_id"].tolist()])
    truth = dict(zip(chosen["doc_id"].tolist(), chosen["toxic"].tolist(), strict=True))
    table = F.broadcast(docs.sparkSession.createDataFrame([(int(i), int(t), int(r)) for (i, t), r in zip(truth.items(), role, strict=True)], "_id bigint, _toxic int, _role int"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(table, F.col("doc_id") == F.col("_id"))
    own = scratch.store(own.groupBy("doc_id", "_role").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")
    words = blocks.scanned(own.where("_role < 2").select("doc_id", "text"), _distinct, "doc_id bigint, words array<bigint>")
    n_toxic = sum(t for t, r in zip(truth.values(), role, strict=True) if r < 2)
    n_clean = int((role < 2).sum()) - n_toxic
    counted = words.join(table, F.col("doc_id") == F.col("_id")).select(F.explode("words").alias("w"), "_toxic").groupBy("w").agg(F.sum("_toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    lift = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (n_clean + 1.0))
    telling = counted.where(F.col("t") >= max(MIN_DOCS, MIN_SHARE * n_toxic)).withColumn("lift", lift).where(F.col("lift") > 2.0)
    learned = np.sort(np.array([r["w"] for r in telling.orderBy(F.desc("lift"), F.desc("t"), "w").limit(LEARNED).collect()], np.int64).view(_U))

    def rows(block: int, ids: list, texts: list[bytes]) -> Iterator[tuple]:
        yield block, blocks.shut((ids, features(texts, learned)))

    parts = [blocks.opened(bytes(r["data"])) for r in blocks.scanned(own.where("_role >= 2").select("doc_id", "text"), rows, "block bigint, data binary").collect()]
    ids = np.array([i for p in parts for i in p[0]], np.int64)
    if not len(ids):
        return learned, boosted(np.zeros((0, len(NAMES))), np.zeros(0))
    x = np.concatenate([p[1] for p in parts])
    order = np.lexsort((*x.T, ids))
    ids, x = ids[order], x[order]
    y = np.array([truth[i] for i in ids.tolist()], float)
    return learned, calibrated(x, y, np.array([zlib.crc32(b"role%d" % i) % 6 for i in ids.tolist()]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.

    Only labels of rows outside fold 0 (crc32 of the id as text, modulo 5) teach; labels, lang,
    source and id are no inputs of a score. An empty or null text is scored by its features, all
    0. Null ids are held out and teach nothing; of a repeated label the largest counts; without
    usable labels every score is 0; an empty table gives an empty result.
    """
    learned, model = fit(docs, labels)

    def rows(block: int, ids: list, texts: list[bytes]) -> Iterator[tuple]:
        for at in range(0, len(ids), 1024):
            some = texts[at : at + 1024]
            for doc_id, p in zip(ids[at : at + 1024], model.score(features(some, learned)).tolist(), strict=True):
                yield doc_id, held_out(doc_id), p, int(p >= 0.5)

    return blocks.scanned(docs.select("doc_id", "text"), rows, "doc_id bigint, held_out boolean, score double, predicted int")
