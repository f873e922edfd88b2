"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.llm import blocks, scratch, textnum

_U = np.uint64
#: Hashes of the end of a text, which is a token, and of its start, which is only a context.
END, START = _U(0xE1D), _U(0x57A)
#: One fold in TEN of the documents is held out.
FOLDS = 10
#: Constant added to every count, and words that the unigram model is worth in a context.
ADDED, PRIOR = 0.1, 10.0
#: Counts are held as powers of RATIO; bits and probes for each entry.
RATIO, BITS, PROBES = 1.6, 12, 5
#: Segments of the filter, by the upper bits of the keys; at least as many as there can be hash ranges.
SEGMENTS, SEGMENT_SHIFT = blocks.MOST_RANGES, _U(64 - (blocks.MOST_RANGES.bit_length() - 1))
#: Bytes of text in a block.
BLOCK = 6 << 20
#: Largest filter that is broadcast; beyond it, probes travel to the filter's segments.
MAX_BROADCAST = 256 << 20


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % FOLDS == 0


def sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token keys of all texts, where each text starts (with the end), and the keys of the token before each."""
    data, starts = textnum.joined(texts)
    s, _, h = textnum.words(data)
    doc = np.searchsorted(starts, s, "right") - 1
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(doc, minlength=len(texts)) + 1, out=at[1:])
    keys = np.empty(at[-1], _U)
    keys[np.arange(len(h)) + doc] = h
    keys[at[1:] - 1] = END
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[at[:-1]] = START
    return keys, at, before


def pairs(before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """48-bit keys of bigrams, in the upper bits."""
    return textnum.mixed(before * _U(textnum.BASE) + keys) & ~_U(0xFFFF)


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log(count)) to the base RATIO."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(RATIO) + 1e-9).astype(np.int64)


def _decoded(most: int = 160) -> np.ndarray:
    """The mean of the counts of each level; 0 for level 0."""
    out = np.zeros(most)
    for q in range(1, most):
        low, high = RATIO ** (q - 1), RATIO**q
        whole = np.arange(np.ceil(low - 1e-9), np.ceil(high - 1e-9)) if high < 1e4 else np.zeros(0)
        out[q] = whole.mean() if len(whole) else (low * high) ** 0.5
    return out


DECODED = _decoded()


def _spots(keys: np.ndarray, q: int, tag: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    first = textnum.mixed(keys ^ _U(q * 0x9E3779B1 + tag))
    second = textnum.mixed(first ^ _U(0xA5A5A5A5)) | _U(1)
    for i in range(PROBES):
        yield (first + _U(i) * second) % np.asarray(bits, _U)


def segment(words: tuple[np.ndarray, np.ndarray], grams: tuple[np.ndarray, np.ndarray], part: int = 0, parts: int = 1) -> bytes:
    """The filter's bits for a hash range: an entry (n-gram, j) for every j up to the level of its count.

    The filter has SEGMENTS segments, each sized by its own entries, whatever the ranges are; so
    its false positives depend on the n-grams alone. A range's are its sizes, in bits, and then
    its bits.
    """
    n = SEGMENTS // parts
    levels = [(keys, level(counts), (keys >> SEGMENT_SHIFT).astype(np.int64) - part * n) for keys, counts in (words, grams)]
    entries = sum(np.bincount(of, q, n) for _, q, of in levels).astype(np.int64)
    sizes = np.maximum(64, BITS * entries + -(BITS * entries) % 8)
    starts = np.cumsum(sizes) - sizes
    flags = np.zeros(int(sizes.sum()), bool)
    for tag, (keys, q, of) in enumerate(levels):
        for j in range(1, int(q.max(initial=0)) + 1):
            some = q >= j
            for spot in _spots(keys[some], j, tag, sizes[of[some]]):
                flags[spot.astype(np.int64) + starts[of[some]]] = True
    return sizes.astype("<u4").tobytes() + np.packbits(flags, bitorder="little").tobytes()


class Filter:
    """The filter's segments, from the ranges at hand; n-grams of other ranges count as absent."""

    def __init__(self, segments: dict[int, bytes] | tuple, parts: int):
        """``segments`` by range, or all of them as (bytes, range -> start and length), which are used in place."""
        if isinstance(segments, dict):
            data, places = bytearray(), {}
            for part, bits in segments.items():
                places[part] = (len(data), len(bits))
                data += bits
        else:
            data, places = segments
        n = SEGMENTS // parts
        self.data = np.frombuffer(data, np.uint8) if len(data) else np.zeros(8, np.uint8)
        self.start, self.bits = np.zeros(SEGMENTS, np.int64), np.zeros(SEGMENTS, _U)
        for part, (start, size) in places.items():
            if size:
                own, sizes = slice(part * n, (part + 1) * n), np.frombuffer(data, "<u4", n, start).astype(np.int64)
                self.bits[own] = sizes
                self.start[own] = (start + 4 * n) * 8 + np.cumsum(sizes) - sizes
        self.there = self.bits > 0
        self.bits[~self.there] = 1

    def levels(self, keys: np.ndarray, tag: int) -> np.ndarray:
        """The level of each key: probes for level 1, 2, ... until one misses."""
        out = np.zeros(len(keys), np.int64)
        part = (keys >> SEGMENT_SHIFT).astype(np.int64)
        live, q = np.flatnonzero(self.there[part]), 1
        while len(live) and q < len(DECODED):
            there = part[live]
            on = np.ones(len(live), bool)
            for spot in _spots(keys[live], q, tag, self.bits[there]):
                at = spot.astype(np.int64) + self.start[there]
                on &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live = live[on]
            out[live] = q
            q += 1
        return out


def slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[slice]:
    """Runs of texts of about ``limit`` bytes, which bound the arrays of a worker."""
    low = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield slice(low, i + 1)
            low, size = i + 1, 0
    if low < len(texts):
        yield slice(low, len(texts))


def _merged(tallies: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*tallies, strict=True))
    return textnum.tally(keys, counts)


def _gathered(parts: int):
    def gather(block: int, ids: list, texts: list[bytes]) -> Iterator[tuple]:
        train = np.array([not held_out(i) for i in ids])
        some_words, some_grams = [], []
        for run in slices(texts):
            keys, at, before = sequence(texts[run])
            of = np.repeat(train[run], np.diff(at))
            some_words.append(textnum.tally(keys, of.astype(np.int64)))
            some_grams.append(textnum.tally(pairs(before[of], keys[of])))
        words, n = _merged(some_words)
        grams, times = _merged(some_grams)
        del some_words, some_grams
        wb, gb = textnum.bounds(words, parts).tolist() + [len(words)], textnum.bounds(grams, parts).tolist() + [len(grams)]
        for p in range(parts):
            w, g = slice(wb[p], wb[p + 1]), slice(gb[p], gb[p + 1])
            if w.stop > w.start or g.stop > g.start:
                yield block, p, blocks.shut((blocks.steps(words[w], 8), blocks.planes(n[w], 4), blocks.steps(grams[g] >> _U(16), 6), blocks.planes(times[g], 4))), 0
        yield block, -1, blocks.shut((ids, texts)), int(train.sum())

    return gather


def _counted(parts: int):
    """Counts of a hash range: an answer to every block, and the range's segments of the filter."""

    def count(part: int, table: pa.Table) -> Iterator[tuple]:
        asked = [blocks.opened(x.as_py()) for x in table.column("data")]
        of = table.column("block").to_pylist()
        words = [blocks.unsteps(a[0], 8) for a in asked]
        known, n = textnum.tally(np.concatenate(words), np.concatenate([blocks.unplanes(a[1], 4) for a in asked]).astype(np.int64))
        grams, times = textnum.tally(np.concatenate([blocks.unsteps(a[2], 6) for a in asked]) << _U(16), np.concatenate([blocks.unplanes(a[3], 4) for a in asked]).astype(np.int64))
        for block, own in zip(of, words, strict=True):
            yield block, part, blocks.shut(blocks.planes(n[np.searchsorted(known, own)], 6)), 0, 0
        seen = n > 0
        yield -1, part, segment((known[seen], n[seen]), (grams, times), part, parts), int(n.sum()), int(seen.sum())

    return count


def _asked(parts: int):
    def ask(block: int, part: int, data: bytes) -> Iterator[tuple]:
        texts = blocks.opened(data)[1]
        own: tuple[list, list] = ([], [])
        for run in slices(texts):
            keys, _, before = sequence(texts[run])
            own[0].append(textnum.tally(keys)[0])
            own[1].append(textnum.tally(pairs(before, keys))[0])
        found = [textnum.tally(np.concatenate(x))[0] for x in own]
        cuts = [textnum.bounds(x, parts).tolist() + [len(x)] for x in found]
        for p in range(parts):
            yield block, p, blocks.shut([x[c[p] : c[p + 1]] for x, c in zip(found, cuts, strict=True)])

    return ask


def _probed(parts: int):
    def probe(part: int, table: pa.Table) -> Iterator[tuple]:
        rows = list(zip(table.column("block").to_pylist(), table.column("data"), strict=True))
        own = Filter({part: next((d.as_py() for b, d in rows if b < 0), b"")}, parts)
        for block, data in rows:
            if block >= 0:
                yield block, parts + part, blocks.shut([own.levels(x, tag) for tag, x in enumerate(blocks.opened(data.as_py()))])

    return probe


def _scored(parts: int, total: int, types: int, texts_n: int, sent):
    def score(block: int, table: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        rows = dict(zip(answers.column("part").to_pylist(), answers.column("data"), strict=True))
        ids, texts = blocks.opened(table.column("data")[0].as_py())
        known = textnum.tally(np.concatenate([textnum.tally(sequence(texts[run])[0])[0] for run in slices(texts)]))[0]
        exact = np.concatenate([blocks.unplanes(blocks.opened(rows[p].as_py()), 6) for p in sorted(rows) if p < parts]).astype(np.float64)
        if sent is None:
            all_grams = textnum.tally(np.concatenate([textnum.tally(pairs(*sequence(texts[run])[2::-2]))[0] for run in slices(texts)]))[0]
            probed = [blocks.opened(rows[p].as_py()) for p in sorted(rows) if p >= parts]
            word_level, gram_level = (np.concatenate([x[tag] for x in probed]) for tag in (0, 1))
        else:
            model = Filter(sent.value, parts)
            word_level = model.levels(known, 0)
        mass = total + ADDED * (types + 1)
        base, seen, count = np.log10((exact + ADDED) / mass), (exact > 0).astype(np.int64), DECODED[word_level]
        for run in slices(texts):
            keys, at, before = sequence(texts[run])
            place = np.searchsorted(known, keys)
            grams, gram_place = np.unique(pairs(before, keys), return_inverse=True)
            level = model.levels(grams, 1) if sent is not None else gram_level[np.searchsorted(all_grams, grams)]
            context = np.empty(len(keys))
            context[1:] = count[place[:-1]]
            context[at[:-1]] = texts_n
            alone = ((count + ADDED) / mass)[place]
            p = (np.minimum(DECODED[level][gram_place], context) + PRIOR * alone) / (context + PRIOR)
            sums = [np.add.reduceat(x, at[:-1]).tolist() for x in (base[place], np.log10(p), seen[place])]
            for i, (doc_id, n) in enumerate(zip(ids[run], np.diff(at).tolist(), strict=True)):
                yield doc_id, held_out(doc_id), n, sums[2][i], total, sums[0][i], sums[1][i]

    return score


def score(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Score every whole text by models of the documents that are not held out.

    Tokens are words (A-Z lowered, told apart by 64-bit hashes) and one end for each text. base_score
    is exact: add-0.1 unigrams from counts that each hash range returns to the blocks. score is the
    bigram model p(w|v) = (c(vw) + PRIOR * p(w)) / (c(v) + PRIOR), whose counts all come from the
    filter's quantised ones. The filter grows with the corpus: up to ``max_broadcast`` bytes it is
    broadcast; a larger one stays in its hash ranges and the blocks' distinct n-grams are probed there.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null or empty
    text is one end token; null ids are held out; repeated rows count each; an empty table gives
    an empty result; other columns are ignored.
    """
    parts = blocks.ranges(docs)
    rows = "block bigint, part int, data binary"
    stored = scratch.dealt(blocks.scanned(docs, _gathered(parts), rows + ", texts bigint", BLOCK), "block", parts)
    counted = scratch.store(blocks.grouped(stored.where(F.col("part") >= 0), "part", _counted(parts), rows + ", tokens bigint, types bigint"), "counts")
    texts = stored.where(F.col("part") < 0)
    segments = counted.where(F.col("block") < 0)
    total, types, size = segments.agg(F.sum("tokens"), F.sum("types"), F.sum(F.octet_length("data"))).first()
    texts_n = texts.agg(F.sum("texts")).first()[0] or 0
    answers = counted.where(F.col("block") >= 0).select("block", "part", "data")
    if (size or 0) <= max_broadcast:
        data, places = bytearray(), {}
        for part, bits in segments.select("part", "data").toLocalIterator():
            places[part] = (len(data), len(bits))
            data += bits
        sent = docs.sparkSession.sparkContext.broadcast((data, places))
        del data
    else:
        sent = None
        probes = blocks.mapped(texts.select("block", "part", "data"), _asked(parts), rows).unionByName(segments.select("block", "part", "data"))
        answers = answers.unionByName(blocks.grouped(probes, "part", _probed(parts), rows))
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.met(texts.select("block", "part", "data"), answers, "block", _scored(parts, total or 0, types or 0, texts_n, sent), schema)
