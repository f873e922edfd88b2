"""Removal of repeated 50-byte strings with suffix arrays of shards, built by induced sorting.

Every 50-byte window has one anchor: its smallest 20-byte hash. Neighbouring windows with one
anchor form a passage of at most 80 bytes, so equal windows always lie in passages of one anchor.
Blocks first learn which anchors come in two or more documents, and send the distinct passages of
those to the shard (hash range) of the anchor, with the smallest doc_id that has each. A shard
sorts the suffixes of its distinct passages, computes the permuted common prefixes, and tells
every block the smallest doc_id that has each window. All steps are exact in the sense that a
window goes only where its own 50 bytes were seen; a passage copied into a third of all documents
costs one entry a block.
"""

from __future__ import annotations

import hashlib
from itertools import islice
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.llm import blocks, scratch, textnum

_U = np.uint64
LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: Bytes that every window has before its anchor or behind it.
SIDE = (LENGTH - GRAM) // 2
#: Up to this alphabet, induction runs over whole buckets at once; above it, suffix by suffix.
WIDE = 1024
#: Bytes of text in a block.
BLOCK = 8 << 20
#: Bytes of passages whose suffixes are sorted together, unless an anchor alone has more; shards for each range of input.
SHARD, SHARDS = 1 << 20, 4
_LAST = np.iinfo(np.int64).max
OUTPUTS = {"kept": "binary", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "spans": "array<bigint>", "kept_sha256": "string"}


# -- suffix arrays ---------------------------------------------------------------------------------


def _types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the end of the text is smaller than anything."""
    step = np.sign(np.diff(text.astype(np.int64), append=-1))
    at = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _place(sa: np.ndarray, edge: np.ndarray, text: np.ndarray, who: np.ndarray, down: bool) -> None:
    """Put suffixes into their buckets in the order given, at the moving edge of each."""
    if not len(who):
        return
    chars = text[who]
    order = np.argsort(chars, kind="stable")
    chars, who = chars[order], who[order]
    first = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
    sizes = np.diff(np.append(first, len(chars)))
    rank = np.arange(len(chars)) - np.repeat(first, sizes)
    sa[edge[chars] - 1 - rank if down else edge[chars] + rank] = who
    edge[chars[first]] += -sizes if down else sizes


def _induced_wide(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Order all suffixes from the order of the leftmost smaller ones, a bucket at a time."""
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=size))
    starts = ends - np.bincount(text, minlength=size)
    sa = np.full(n, -1, np.int64)
    by = np.argsort(text[lms], kind="stable")
    grouped = lms[by]
    cut = np.searchsorted(text[grouped], np.arange(size + 1))
    head = starts.copy()
    present = np.flatnonzero(ends > starts)
    _place(sa, head, text, np.array([n - 1])[~small[n - 1 :]], False)
    for c in present.tolist():
        low = starts[c]
        while low < head[c]:
            before = sa[low : head[c]] - 1
            low = head[c]
            before = before[before >= 0]
            _place(sa, head, text, before[~small[before]], False)
        _place(sa, head, text, grouped[cut[c] : cut[c + 1]] - 1, False)
    tail = ends.copy()
    for c in present[::-1].tolist():
        high = ends[c]
        while high > tail[c]:
            before = sa[tail[c] : high][::-1] - 1
            high = tail[c]
            before = before[before >= 0]
            _place(sa, tail, text, before[small[before]], True)
        before = sa[starts[c] : head[c]][::-1] - 1
        before = before[before >= 0]
        _place(sa, tail, text, before[small[before]], True)
    return sa


def _induced_deep(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The same, one suffix after another, for the large alphabets of deeper levels."""
    n, counts = len(text), np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    head, tail = (ends - counts).tolist(), ends.tolist()
    # the letter before each suffix, if that suffix is larger (smaller) than this one, else -1
    before, falls = np.concatenate(([-1], text[:-1])), np.concatenate(([False], ~small[:-1]))
    larger, smaller = np.where(falls, before, -1).tolist(), np.where(falls, -1, before).tolist()
    sa = [0] * (n + 1)  # suffix 0 has none before it, so 0 also stands for an empty place
    sa[n] = n
    chars = text[lms]
    by = np.argsort(chars, kind="stable")
    first = np.searchsorted(chars[by], chars[by], "left")
    many = np.bincount(chars, minlength=size)
    for k, i in zip((ends[chars[by]] - many[chars[by]] + np.arange(len(by)) - first).tolist(), lms[by].tolist(), strict=True):
        sa[k] = i
    if not small[n - 1]:
        c = int(text[n - 1])
        sa[head[c]] = n - 1
        head[c] += 1
    for i in islice(sa, n):  # which grows as it is read
        c = larger[i]
        if c >= 0:
            sa[head[c]] = i - 1
            head[c] += 1
    for k in range(n - 1, -1, -1):
        i = sa[k]
        c = smaller[i]
        if c >= 0:
            k = tail[c] - 1
            tail[c] = k
            sa[k] = i - 1
    sa.pop()
    return np.array(sa, np.int64)


def _alike(text: np.ndarray, at: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether each substring (start and length given) has the letters of the one before it."""
    same = long[1:] == long[:-1]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = text[at[live] + k] == text[at[live + 1] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[long[live] > k]
    return same


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """The suffixes of ``text`` (integers below ``size``) in order, by induced sorting.

    Suffixes are classified; the substrings between leftmost smaller ones are sorted by induction
    and named; their string of names is sorted recursively unless all names differ; the order of
    all suffixes is induced from it in time linear in the text.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induced_wide if size <= WIDE else _induced_deep
    if not len(lms):
        return induce(text, small, lms, size)
    rough = induce(text, small, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = rough[is_lms[rough]]
    long = np.zeros(n, np.int64)
    long[lms] = np.append(lms[1:] + 1, n) - lms
    new = np.concatenate(([True], ~_alike(text, rough, long[rough])))
    last = np.flatnonzero(rough == lms[-1])[0]  # it ends with the text, which is a letter of its own
    new[last : last + 2] = True
    names = np.cumsum(new) - 1
    if names[-1] + 1 == len(lms):
        ordered = rough
    else:
        name_of = np.zeros(n, np.int64)
        name_of[rough] = names
        ordered = lms[suffix_array(name_of[lms], int(names[-1]) + 1)]
    return induce(text, small, ordered, size)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, whole: np.ndarray | None = None) -> np.ndarray:
    """Permuted common prefixes: for every position, what it shares with the suffix before it in order, up to ``most``.

    With ``whole``, 0 unless both suffixes are marked in it. Letters are compared eight bytes at a time, so ``text`` may be bytes or wider integers.
    """
    n, step = len(text), 8 // text.dtype.itemsize
    raw = np.concatenate((text, np.zeros(step, text.dtype))).tobytes()
    words = np.ndarray((n,), "<u8", raw, strides=(text.dtype.itemsize,))
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(phi >= 0 if whole is None else (phi >= 0) & whole & whole[phi])
    other = phi[live]
    for k in range(0, most, step):
        room = n - np.maximum(live, other) - k
        inside = room > 0
        live, other, room = live[inside], other[inside], room[inside]
        differ = words[live + k] ^ words[other + k]
        equal = np.full(len(live), step)
        some = np.flatnonzero(differ)
        low = differ[some] & (~differ[some] + _U(1))  # the lowest bit that differs
        equal[some] = np.log2(low.astype(np.float64)).astype(np.int64) // (8 * text.dtype.itemsize)
        out[live] = np.minimum(k + np.minimum(equal, room), most)
        whole = (equal == step) & (room > step)
        live, other = live[whole], other[whole]
    return out


def smallest(passages: list[bytes], owner: np.ndarray) -> np.ndarray:
    """For every window of every passage, in order, the smallest owner of a passage that has that window."""
    sizes = np.fromiter(map(len, passages), np.int64, len(passages))
    starts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 1, out=starts[1:])
    text = np.frombuffer(b"\0".join(passages) + b"\0", np.uint8).astype(np.uint16)
    text[starts[1:] - 1] = 256
    whole = np.zeros(len(text), bool)
    runs = sizes - LENGTH + 1
    at = np.repeat(starts[:-1], runs) + (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    whole[at] = True
    sa = suffix_array(text, 257)
    same = common_prefixes(text, sa, LENGTH, whole) >= LENGTH
    ordered = sa[whole[sa]]
    of = np.full(len(text), _LAST, np.int64)
    of[at] = np.repeat(owner, runs)
    first = np.flatnonzero(~same[ordered])
    if len(first) == 0 or first[0] != 0:
        first = np.concatenate(([0], first))
    low = np.minimum.reduceat(of[ordered], first)
    of[ordered] = np.repeat(low, np.diff(np.append(first, len(ordered))))
    return of[at]


# -- passages of a block ---------------------------------------------------------------------------


class Passages:
    """The passages of a block's texts: start, runs (windows), anchor, key (of the whole passage), doc, offset (of the anchor)."""

    def __init__(self, texts: list[bytes]):
        self.data, self.starts = textnum.joined(texts)
        data, found, n = self.data, [], len(self.data)
        step = textnum.CHUNK - 4096
        low = _U((1 << 22) - 1)
        ends = np.zeros(n + 1, np.int8)  # windows start anywhere but in the last bytes of a text
        np.add.at(ends, self.starts[:-1], 1)
        np.add.at(ends, np.maximum(self.starts[:-1], self.starts[1:] - LENGTH), -1)
        inside = np.cumsum(ends[:-1], dtype=np.int8) > 0
        slots = np.arange(step + SPAN, dtype=_U)
        for base in range(0, max(0, n - LENGTH), step):
            part = data[base : base + step + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            sums, (_, down) = textnum.prefix(part), textnum.powers(len(part) + 1)
            grams = sums[GRAM:] - sums[:-GRAM]
            grams *= down[: len(grams)]
            grams = textnum.mixed(grams)
            v = grams & ~low
            v |= slots[: len(v)]
            width = 1
            while 2 * width <= SPAN:
                v = np.minimum(v[:-width], v[width:])
                width *= 2
            if width < SPAN:
                v = np.minimum(v[: len(v) - (SPAN - width)], v[SPAN - width :])
            valid = inside[base : base + len(v)]
            change = np.flatnonzero((v[1:] != v[:-1]) | (valid[1:] != valid[:-1])) + 1
            first = np.concatenate(([0], change))
            runs = np.diff(first, append=len(v))
            first, runs = first[valid[first]], runs[valid[first]]
            if not len(first):
                continue
            least = (v[first] & low).astype(np.int64)
            end = first + runs - 1 + LENGTH
            key = textnum.mixed((sums[end] - sums[first]) * down[first] + runs.astype(_U))
            # smallest hashes start with zeros; mixed again, they fall evenly into hash ranges
            found.append((first + base, runs, textnum.mixed(grams[least] ^ _U(textnum.BASE)), key, np.searchsorted(self.starts, first + base, "right") - 1, least - first))
        if found:
            self.start, self.runs, self.anchor, self.key, self.doc, self.offset = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            self.start = self.runs = self.doc = self.offset = np.zeros(0, np.int64)
            self.anchor = self.key = np.zeros(0, _U)

    def anchors(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors (48 bits, ascending), and whether each comes in documents of different ids."""
        keys = self.anchor >> _U(16)
        order = np.argsort(keys, kind="stable")
        ordered, of = keys[order], ids[self.doc[order]]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
        if not len(first):
            return keys, np.zeros(0, bool)
        return ordered[first], np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)

    def distinct(self, shared: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Passages of shared anchors (48 bits, ascending): all of them, the number of its distinct one for each, and of the distinct ones a member and the smallest id."""
        keys = self.anchor >> _U(16)
        at = np.searchsorted(shared, keys)
        mine = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == keys) if len(shared) else np.zeros(0, np.int64)
        order = mine[np.lexsort((self.key[mine], keys[mine]))]
        if not len(order):
            return order, order, order, order
        head = np.concatenate(([True], (self.key[order][1:] != self.key[order][:-1]) | (keys[order][1:] != keys[order][:-1])))
        first = np.flatnonzero(head)
        return order, np.cumsum(head) - 1, order[first], np.minimum.reduceat(ids[self.doc[order]], first)


def _ids(ids: list) -> np.ndarray:
    return np.array([_LAST if i is None else i for i in ids], np.int64)


def _found(parts: int):
    def find(block: int, ids: list, texts: list[bytes]) -> Iterator[tuple]:
        keys, multi = Passages(texts).anchors(_ids(ids))
        cuts = textnum.bounds(keys << _U(16), parts).tolist() + [len(keys)]
        for p in range(parts):
            own = slice(cuts[p], cuts[p + 1])
            if own.stop > own.start:
                yield block, p, blocks.shut((blocks.steps(keys[own], 6), np.packbits(multi[own]), own.stop - own.start))
        yield block, -1, blocks.shut((ids, texts))

    return find


def _met(part: int, table: pa.Table) -> Iterator[tuple]:
    """Tell every block which of its anchors come in two or more documents."""
    asked = [blocks.opened(x.as_py()) for x in table.column("data")]
    keys = [blocks.unsteps(a[0], 6) for a in asked]
    multi = [np.unpackbits(a[1], count=a[2]) for a in asked]
    known, n = textnum.tally(np.concatenate(keys), 1 + np.concatenate(multi).astype(np.int64))
    for block, own in zip(table.column("block").to_pylist(), keys, strict=True):
        yield block, part, blocks.shut(own[n[np.searchsorted(known, own)] > 1])


def _shared(rows: dict) -> np.ndarray:
    own = [blocks.opened(rows[p].as_py()) for p in sorted(rows) if p >= 0]
    return np.concatenate(own) if own else np.zeros(0, _U)


def _sent(parts: int):
    def send(block: int, table: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        rows = dict(zip(answers.column("part").to_pylist(), answers.column("data"), strict=True))
        ids, texts = blocks.opened(table.column("data")[0].as_py())
        own, shared = Passages(texts), _shared(rows)
        order, which, members, least = own.distinct(shared, _ids(ids))
        data = own.data.tobytes()
        cuts = textnum.bounds((own.anchor[members] >> _U(16)) << _U(16), parts).tolist() + [len(members)]
        for p in range(parts):
            some = members[cuts[p] : cuts[p + 1]]
            if len(some):
                sizes = own.runs[some] + LENGTH - 1
                text = b"".join([data[s : s + n] for s, n in zip(own.start[some].tolist(), sizes.tolist(), strict=True)])
                fine = own.anchor[some] << _U(parts.bit_length() - 1) >> _U(24)  # the 40 bits of the anchor after those of the shard
                yield block, p, blocks.shut((sizes.astype(np.uint8), own.offset[some].astype(np.uint8), blocks.planes(fine, 5), blocks.planes(least[cuts[p] : cuts[p + 1]].view(_U), 8), text))
        yield block, -1, blocks.shut((blocks.planes(own.start[order], 4), own.runs[order].astype(np.uint8), np.packbits(np.diff(which, prepend=-1).astype(bool))))

    return send


def meeting(passages: list[bytes], offset: np.ndarray) -> np.ndarray:
    """Whether each distinct passage can share a window with another one.

    A window reaches SIDE bytes before its anchor or as many behind it. So passages that share one
    have in common the anchor with the SIDE bytes on one of its sides; hashes of these tell.
    """
    lengths = np.fromiter(map(len, passages), np.int64, len(passages))
    data, starts = np.frombuffer(b"".join(passages), np.uint8), np.cumsum(lengths) - lengths
    up = textnum.powers(SIDE + GRAM)[0][: SIDE + GRAM]
    sides = []
    for tag, low, fits in ((1, starts + offset - SIDE, offset >= SIDE), (2, starts + offset, offset + GRAM + SIDE <= lengths)):
        who = np.flatnonzero(fits)
        keys = np.empty(len(who), _U)
        for k in range(0, len(who), 1 << 14):
            at = low[who[k : k + (1 << 14)], None] + np.arange(SIDE + GRAM)
            keys[k : k + (1 << 14)] = ((data[at].astype(_U) + _U(tag)) * up).sum(axis=1, dtype=_U)
        sides.append((who, textnum.mixed(keys ^ _U(tag))))
    who, keys = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(passages), bool)
    out[who[order[1:][equal]]] = out[who[order[:-1][equal]]] = True
    return out


def _owned(part: int, table: pa.Table) -> Iterator[tuple]:
    """Answer every block with the smallest id for each window of its passages.

    Passages that share a window share the anchor and the bytes on one side of it. Those that meet
    no other passage so need no sorting; the others are sorted in runs of anchors, each with a
    suffix array of its own, which bounds a worker's memory.
    """
    number: dict[bytes, int] = {}
    least: list[int] = []
    fine: list[int] = []
    offset: list[int] = []
    asked = []
    for block, blob in zip(table.column("block").to_pylist(), table.column("data"), strict=True):
        sizes, spots, bits, ids, text = blocks.opened(blob.as_py())
        ids, bits, at, mine = blocks.unplanes(ids, 8).view(np.int64).tolist(), blocks.unplanes(bits, 5), 0, []
        for size, spot, bit, doc_id in zip(sizes.tolist(), spots.tolist(), bits.tolist(), ids, strict=True):
            passage = text[at : at + size]
            at += size
            k = number.setdefault(passage, len(least))
            if k == len(least):
                least.append(doc_id)
                fine.append(bit)
                offset.append(spot)
            elif doc_id < least[k]:
                least[k] = doc_id
            mine.append(k)
        asked.append((block, np.array(mine, np.int64)))
    passages = list(number)
    del number
    owner, of = np.array(least, np.int64), np.array(fine, np.int64)
    lengths = np.fromiter(map(len, passages), np.int64, len(passages))
    runs = lengths - LENGTH + 1
    first = np.cumsum(runs) - runs
    low = np.repeat(owner, runs)
    order = np.argsort(of, kind="stable")
    order = order[meeting(passages, np.array(offset, np.int64))[order]]
    edge = np.flatnonzero(np.concatenate((of[order][1:] != of[order][:-1], [True]))) + 1 if len(order) else np.zeros(0, np.int64)
    start, total = 0, np.cumsum(lengths[order])
    for stop, after in zip(edge.tolist(), [*edge[1:].tolist(), None], strict=False):
        if after is None or total[after - 1] - (total[start - 1] if start else 0) > SHARD:
            some = order[start:stop]
            own_runs = runs[some]
            to = np.repeat(first[some], own_runs) + (np.arange(own_runs.sum()) - np.repeat(np.cumsum(own_runs) - own_runs, own_runs))
            low[to] = smallest([passages[i] for i in some.tolist()], owner[some])
            start = stop
    for block, mine in asked:
        mine_runs = runs[mine]
        at = np.repeat(first[mine], mine_runs) + (np.arange(mine_runs.sum()) - np.repeat(np.cumsum(mine_runs) - mine_runs, mine_runs))
        yield block, part, blocks.shut(blocks.planes(low[at].view(_U), 8))


def _removed(outputs: tuple[str, ...]):
    def remove(block: int, table: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        rows = dict(zip(answers.column("part").to_pylist(), answers.column("data"), strict=True))
        ids, texts = blocks.opened(table.column("data")[0].as_py())
        start, runs, head = blocks.opened(rows.pop(-1).as_py())
        start, runs = blocks.unplanes(start, 4).astype(np.int64), runs.astype(np.int64)
        head = np.unpackbits(head, count=len(runs)).astype(bool)
        (data, starts), numbers = textnum.joined(texts), _ids(ids)
        gone = np.zeros(len(data) + 1, np.int8)  # windows that start here less windows that ended: a sum of at most 50
        if len(start):
            low = np.concatenate([blocks.unplanes(blocks.opened(rows[p].as_py()), 8) for p in sorted(rows)]).view(np.int64)
            first = np.cumsum(runs[head]) - runs[head]
            nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            doc = np.searchsorted(starts, start, "right") - 1
            hit = low[np.repeat(first[np.cumsum(head) - 1], runs) + nth] < np.repeat(numbers[doc], runs)
            at = (np.repeat(start, runs) + nth)[hit]
            gone[at] += 1
            gone[at + LENGTH] -= 1
        mask = np.cumsum(gone[:-1], dtype=np.int8) > 0
        edge = mask & ~np.concatenate(([False], mask[:-1]))
        n_removed, n_spans = (np.add.reduceat(x, starts[:-1], dtype=np.int64) if len(ids) else [] for x in (mask, edge))
        for i, doc_id in enumerate(ids):
            low, high = starts[i], starts[i + 1] - 1
            row: list = [doc_id]
            kept = texts[i] if not n_removed[i] else data[low:high][~mask[low:high]].tobytes()
            for name in outputs:
                if name == "spans":
                    change = np.flatnonzero(np.diff(np.concatenate(([0], mask[low:high].astype(np.int8), [0]))))
                    row.append(change.tolist())
                else:
                    row.append({"kept": lambda: kept, "n_bytes": lambda: int(high - low), "n_removed": lambda: int(n_removed[i]), "n_spans": lambda: int(n_spans[i]), "kept_sha256": lambda: hashlib.sha256(kept).hexdigest()}[name]())
            yield tuple(row)

    return remove


def dedup(docs: DataFrame, outputs: Iterable[str] = ("kept", "n_bytes", "n_removed", "n_spans")) -> DataFrame:
    """Remove every byte of a text that lies in a 50-byte string which starts in a document of smaller doc_id too.

    Strings are those of the whole input texts as UTF-8 bytes. Returns doc_id and the ``outputs``
    asked for, of OUTPUTS: the bytes kept, counts, spans (start and end of each run removed, in
    turn) or a digest. A null text is empty; a null id is larger than all others; documents of
    one id take nothing from each other; texts under 50 bytes keep all; an empty table gives an
    empty result; other columns are ignored.
    """
    outputs = tuple(outputs)
    parts = SHARDS * blocks.ranges(docs)
    rows = "block bigint, part int, data binary"
    first = scratch.dealt(blocks.scanned(docs, _found(parts), rows, BLOCK), "block", parts // SHARDS)
    texts = first.where(F.col("part") < 0)
    met = blocks.grouped(first.where(F.col("part") >= 0), "part", _met, rows)
    second = scratch.store(blocks.met(texts, met, "block", _sent(parts), rows), "passages")
    owned = blocks.grouped(second.where(F.col("part") >= 0).repartition(parts, "part"), "part", _owned, rows)  # sorting costs more than its bytes tell
    schema = ", ".join(["doc_id bigint", *(f"{name} {OUTPUTS[name]}" for name in outputs)])
    return blocks.met(texts, second.where(F.col("part") < 0).unionByName(owned), "block", _removed(outputs), schema)
