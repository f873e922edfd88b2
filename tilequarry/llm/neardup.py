"""Near-duplicate documents by SetSketch registers: bands, a likelihood estimate, then full sets.

A document's set is its distinct word 5-grams. Register i of its sketch holds the smallest of
exponential numbers that the set's members draw for it, on a logarithmic scale of base 1.001 and
truncated to 16 bits, so registers of two sets agree with about their Jaccard similarity and the
sketch of a union is the maximum. Bands of registers propose pairs, the joint likelihood of the
registers' order discards what is far from similar, and full sets decide.

Documents of equal sets form one class, which is one node. A bucket's hub is the member that meets
most others in all its buckets, the likely original of a group. In each of TURNS turns a node is
compared with one hub: the best of its buckets' hubs that it is not linked with yet. What is
still apart afterwards is compared whatever the turns left out: the two nodes of a bucket of two
directly, members of larger buckets through their rarest shingles, which is exact: families of nodes
that such shingles tie together are compared in place, block by block, and return a forest of
links. So no stage makes a row for each pair of a dense group. A pair at the threshold meets in
none of the 72 buckets with a probability of 1e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.llm import blocks, scratch, textnum

_U = np.uint64
WORDS, ROWS, BANDS = 5, 6, 72
REGISTERS = ROWS * BANDS
#: Base of the registers' scale, and what is added to keep them positive.
BASE, OFFSET = 1.001, 5000
#: Links have 100 * intersection >= SHARE * union; estimates this far below are not verified (six standard errors).
SHARE, DOUBT = 75, 0.14
#: Hubs that a node is compared with, one after another.
TURNS = 3
#: Nodes of a block; families up to FAMILY nodes are compared block by block. In larger ones pairs
#: are joined by prefix shingles of up to FEW nodes, and blocks meet by those of more.
BLOCK, FAMILY, FEW = 256, 8192, 16
#: Rows of a few numbers up to which a side of a join is broadcast (some 10 MB); beyond, both are shuffled.
SMALL = 200_000
#: Members hashed at once.
MEMBERS = 1 << 14


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every text: 5 words each; all words if there are fewer; none without words."""
    data, starts = textnum.joined(texts)
    s, _, h = textnum.words(data)
    doc = np.searchsorted(starts, s, "right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    step = _U(textnum.BASE)
    if len(h) >= WORDS:
        rolled = h[: len(h) - WORDS + 1].copy()
        for k in range(1, WORDS):
            rolled = rolled * step + h[k : len(h) - WORDS + 1 + k]
        rolled = textnum.mixed(rolled)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= WORDS:
            own = np.sort(rolled[low : high - WORDS + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif high > low:
            short = np.array([high - low], _U)
            for x in h[low:high]:
                short = textnum.mixed(short * step + x)
            out.append(short)
        else:
            out.append(h[:0])
    return out


def _group(members: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Register minima of n sets, members and their set's number given.

    A member's draws are the points of a Poisson process of rate REGISTERS, each for a random
    register: the first point for a register is exponential. Points come in ascending order, so a
    member stops at the first beyond the largest minimum of its set.
    """
    reg = np.full(n * REGISTERS, np.inf)
    limit = np.full(n, np.inf)
    smallest = max(1, int(np.bincount(doc, minlength=n).min()))
    width = int(np.clip(REGISTERS * 7 // (4 * smallest), 1, 64))
    seed, at, where, turn = members, np.zeros(len(members)), doc, 0
    while len(seed):
        draw = textnum.mixed(seed[:, None] + _U(0x9E3779B97F4A7C15) * (np.arange(width, dtype=_U) + _U(1 + turn * width)))
        times = at[:, None] + np.cumsum(-np.log(((draw >> _U(11)).astype(float) + 0.5) * 2.0**-53), axis=1) / REGISTERS
        to = (((textnum.mixed(draw) >> _U(32)) * _U(REGISTERS)) >> _U(32)).astype(np.int64) + where[:, None] * REGISTERS
        near = times < limit[where][:, None]
        np.minimum.at(reg, to[near], times[near])
        limit = reg.reshape(n, REGISTERS).max(axis=1)
        at = times[:, -1]
        live = at < limit[where]
        seed, at, where, turn = seed[live], at[live], where[live], turn + 1
    return reg.reshape(n, REGISTERS)


def sketches(own: list[np.ndarray]) -> np.ndarray:
    """16-bit registers of every set; sets of like size are drawn together."""
    out = np.zeros((len(own), REGISTERS), np.uint16)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    low = 0
    while low < len(order):
        total = np.cumsum(np.maximum(sizes[order[low:]], 64))
        high = low + max(1, int(np.searchsorted(total, MEMBERS, "right")))
        some = order[low:high]
        minima = _group(np.concatenate([own[i] for i in some]), np.repeat(np.arange(len(some)), sizes[some]), len(some))
        out[some] = np.clip(np.floor(OFFSET - np.log(minima) / np.log(BASE)), 0, 65535).astype(np.uint16)
        low = high
    return out


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from registers (rows of a and b) and set sizes.

    The counts of registers above, below and equal have probabilities that depend on the
    similarity and the sizes; the best of a grid of similarities is returned.
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = REGISTERS - above - below
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * top[:, None]
    part = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = part(u[:, None] - v[:, None] * grid), part(v[:, None] - u[:, None] * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    value = above[:, None] * log(p) + below[:, None] * log(q) + equal[:, None] * log(1 - p - q)
    return grid[np.arange(len(grid)), np.argmax(value, axis=1)]


# -- Spark -----------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), text_key(F.col("text")).alias("tkey"))


def text_key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _node(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketched(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, tkey, shingles, node, sketch of every row of doc_id, text, tkey."""
    for batch in stream:
        for low in range(0, batch.num_rows, 2048):
            part = batch.slice(low, 2048)
            own = sets([(x.as_py() or "").encode() for x in part.column(1)])
            nodes = [_node(x) for x in own]
            first = {node: i for i, node in reversed(list(enumerate(nodes)))}
            drawn = sketches([x if first[node] == i else x[:0] for i, (x, node) in enumerate(zip(own, nodes, strict=True))])
            blobs = [drawn[first[node]].tobytes() if len(x) else None for x, node in zip(own, nodes, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(map(len, own), pa.int64()), pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "tkey", "n", "node", "sketch"])


def _set_rows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for low in range(0, batch.num_rows, 2048):
            own = sets([(x.as_py() or "").encode() for x in batch.column(0).slice(low, 2048)])
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in own], pa.int64()), pa.array([blocks.steps(np.unique(x >> _U(16)), 6) for x in own], pa.binary())], names=["node", "members"])


def _plausible(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("xa", "xb"))
            na, nb = (part.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            yield part.select(["a", "b", "na", "nb"]).filter(pa.array(likely(a, b, na, nb) >= SHARE / 100 - DOUBT))


def _linked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        hold = []
        for x, y, na, nb in zip(*(batch.column(c).to_pylist() for c in ("xa", "xb", "na", "nb")), strict=True):
            both = len(np.intersect1d(blocks.unsteps(x, 6), blocks.unsteps(y, 6), assume_unique=True))
            hold.append(100 * both >= SHARE * (na + nb - both))
        yield batch.select(["a", "b"]).filter(pa.array(hold, pa.bool_()))


def _small(rows: DataFrame) -> DataFrame:
    """Stored rows of a few numbers, marked to be broadcast if they are at most SMALL; beyond, joins shuffle."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def _with_ends(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """The stored pairs(a, b, na, nb) with ``column`` of both nodes, as xa and xb.

    What is shuffled is the pairs' own ends, not the whole of ``of``, as long as the pairs are few enough to be sent to it.
    """
    one = of.select(F.col("node").alias("_a"), F.col(column).alias("xa")).join(_small(pairs), F.col("_a") == F.col("a"))
    ends = _small(scratch.store(pairs.select(F.col("b").alias("_e")).distinct(), "ends"))
    other = of.join(ends, F.col("node") == F.col("_e"), "left_semi").select(F.col("node").alias("_b"), F.col(column).alias("xb"))
    return one.join(other, F.col("b") == F.col("_b")).select("a", "b", "na", "nb", "xa", "xb")


def screened(pairs: DataFrame, cands: DataFrame, label: str) -> DataFrame:
    """The pairs that are likely similar by their sketches, as a stored table."""
    return scratch.store(_with_ends(pairs, cands, "sketch").mapInArrow(_plausible, "a bigint, b bigint, na bigint, nb bigint"), f"{label}-likely")


def full_sets(cands: DataFrame, docs: DataFrame) -> DataFrame:
    """node, members (a blob of 48-bit hashes) of all candidates, from the texts of their representatives."""
    picked = _small(cands.select(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_tkey")))
    texts = docs.join(picked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tkey") == F.col("_tkey")), "left_semi").select(F.col("text").cast("string"))
    return scratch.store(texts.mapInArrow(_set_rows, "node bigint, members binary").dropDuplicates(["node"]), "sets")


def compared(pairs: DataFrame, full: DataFrame, label: str) -> DataFrame:
    """The pairs whose full sets are similar enough, as a stored table of a, b."""
    return scratch.store(_with_ends(pairs, full, "members").mapInArrow(_linked, "a bigint, b bigint"), f"{label}-links")


def _exploded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            own = [blocks.unsteps(x, 6).view(np.int64) for x in part.column("members").to_pylist()]
            sizes = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), sizes)), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], names=["node", "h"])


def prefixes(nodes: DataFrame, full: DataFrame) -> DataFrame:
    """The rarest quarter of the shingles of nodes(node, n, comp): node, n, comp, h, place, others (nodes with h in it).

    Shingles are ordered by how many of the nodes have them, rare ones first. If the smaller set x
    and y are linked, they share 6/7 of x and 3/4 of y, so the rarest seventh of x meets the
    rarest quarter of y. Shingles of one node only count toward the places, but cannot meet.
    """
    rows = scratch.store(full.mapInArrow(_exploded, "node bigint, h bigint"), "postings")
    rows = _counted(rows, "h", "df")
    sized = nodes.select(F.col("node").alias("_node"), "n", "comp")
    rows = rows.join(sized, F.col("node") == F.col("_node")).drop("_node")
    own = Window.partitionBy("node")
    placed = rows.withColumn("m", F.count(F.lit(1)).over(own)).withColumn("place", F.col("n") - F.col("m") + F.row_number().over(own.orderBy("df", "h")))
    placed = scratch.store(placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1).select("node", "n", "comp", "h", "place"), "placed")
    return scratch.store(_counted(placed, "h", "others"), "prefixes")


def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows whose key comes twice or more, with how often. Counts combine before the shuffle, and the join splits hot keys."""
    n = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)
    return rows.join(n, F.col(key) == F.col("_key")).drop("_key")


def prefix_pairs(placed: DataFrame) -> DataFrame:
    """Pairs a, b, na, nb in different components that meet in a prefix shingle of at most FEW nodes."""
    few = placed.where(F.col("others") <= FEW)
    x = few.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 6 / 7) + 1).select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), "h")
    y = few.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), "h")
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    return x.join(y, "h").where(smaller & (F.col("ca") != F.col("cb")) & _size_fits(F.col("na"), F.col("nb"))).select("a", "b", "na", "nb").distinct()


def _met_in_block(table: pa.Table) -> pa.Table:
    """A forest of the links between nodes of one or two blocks, by full sets: a product of their incidence matrices."""
    node, n, comp = (table.column(c).to_numpy() for c in ("node", "n", "comp"))
    sets = [blocks.unsteps(x, 6) for x in table.column("members").to_pylist()]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        part = slice(np.searchsorted(column, low), np.searchsorted(column, low + 4096))
        held = np.zeros((len(sets), 4096), np.float32)
        held[row[part], column[part] - low] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    linked = (100 * both >= SHARE * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
    label = np.arange(len(sets))  # a forest of the links does: its edges join what they connect
    edges = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        if label[i] != label[j]:
            edges.append((i, j))
            label[label == label[j]] = label[i]
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(np.minimum(node[a], node[b]), pa.int64()), "b": pa.array(np.maximum(node[a], node[b]), pa.int64())})


def families(placed: DataFrame) -> DataFrame:
    """family, node, n, comp, size of all nodes that prefix shingles tie together, directly or through others."""
    tied = placed.groupBy("h").agg(F.min("node").alias("first"))
    ties = placed.join(tied.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h")).where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    of = components(scratch.store(ties, "ties")).select(F.col("node").alias("_node"), F.col("comp").alias("family"))
    own = placed.groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp"))
    rows = scratch.store(own.join(of, F.col("node") == F.col("_node")).select("family", "node", "n", "comp"), "families")
    return rows.join(rows.groupBy(F.col("family").alias("_family")).agg(F.count(F.lit(1)).alias("size")), F.col("family") == F.col("_family")).drop("_family")


def family_links(members: DataFrame, full: DataFrame) -> DataFrame:
    """A forest of the links a, b inside each family of members(family, node, n, comp, size): every two of its blocks meet in one task."""
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), count).cast("int"))
    return _met(dealt, count, "family", full)


def _met(dealt: DataFrame, count, key: str, full: DataFrame) -> DataFrame:
    """Links between the nodes of every two blocks of a key, of rows (key, node, n, comp, block)."""
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    held = sent.join(full.select(F.col("node").alias("_node"), "members"), F.col("node") == F.col("_node"))
    return held.select(key, "low", "high", "node", "n", "comp", "members").groupBy(key, "low", "high").applyInArrow(_met_in_block, "a bigint, b bigint").distinct()


def prefix_links(placed: DataFrame, full: DataFrame) -> DataFrame:
    """Links a, b between nodes that meet in a prefix shingle of more than FEW nodes.

    Such a shingle's nodes are dealt to blocks of about BLOCK, and every two blocks are compared in
    one task, which returns a forest of links: pairs are never rows.
    """
    many = placed.where(F.col("others") > FEW)
    count = F.ceil(F.col("others") / BLOCK).cast("int")
    return _met(many.withColumn("block", F.pmod(F.xxhash64("node"), count).cast("int")), count, "h", full)


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of links(a, b).

    Labels spread along links and jump to their label's label, until a round changes none; each
    round is a stored table.
    """
    ways = scratch.store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ways")
    labels = scratch.store(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    while True:
        of = lambda key, name: labels.select(F.col("node").alias(f"_{key}"), F.col("comp").alias(name))
        near = ways.join(of("b", "near"), F.col("b") == F.col("_b")).groupBy(F.col("a").alias("_n")).agg(F.min("near").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("_n")).select("node", "comp", F.least("comp", "near").alias("to"))
        jumped = moved.join(of("to", "far"), F.col("to") == F.col("_to"), "left").select("node", F.col("comp").alias("was"), F.least("to", F.coalesce("far", "to")).alias("comp"))
        now = scratch.store(jumped, "labels")
        changed = now.where(F.col("was") != F.col("comp")).limit(1).count()
        labels = now.select("node", "comp")
        if not changed:
            return labels


def pairs_left(buckets: DataFrame, tried: DataFrame | None) -> DataFrame:
    """Pairs a, b, na, nb of the buckets of two that are apart and whose pair no turn has compared."""
    two = buckets.where((F.col("size") == 2) & _size_fits(F.col("na"), F.col("nb"))).select("a", "b", "na", "nb").distinct()
    if tried is None:
        return two
    known = tried.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return two.join(known, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")


def _size_fits(a, b):
    return F.least(a, b) * 100 >= F.greatest(a, b) * SHARE


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows doc_id, tkey, n, node of all documents, and node, comp of the nodes that have a link."""
    keyed = _keyed(docs)
    rows = scratch.store(keyed.selectExpr("doc_id", "cast(text as string) text", "tkey").mapInArrow(_sketched, "doc_id bigint, tkey bigint, n bigint, node bigint, sketch binary"), "sketches")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey"))
    classes = scratch.store(rows.where(F.col("n") > 0).groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), one.alias("one")), "classes")
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * width + 1, F.lit(width))))
    members = classes.select("node", F.explode(keys).alias("key"))
    met = scratch.store(_counted(members, "key", "size"), "buckets")
    weights = scratch.store(met.groupBy(F.col("node").alias("_node")).agg(F.sum("size").alias("weight")), "weights")
    cands = classes.join(_small(weights), F.col("node") == F.col("_node")).select("node", "n", "weight", "sketch", "one.doc_id", "one.tkey")
    cands = scratch.store(cands, "candidates")
    full = full_sets(cands, keyed)
    sized = scratch.store(cands.select(F.col("node").alias("_node"), "n", "weight"), "sized")
    met = scratch.store(met.join(_small(sized), F.col("node") == F.col("_node")).select("key", "node", "n", "weight"), "weighted")
    links = pairs = comps = tried = None
    now = met.withColumn("comp", F.col("node"))
    for turn in range(TURNS):
        hub = F.max_by(F.struct(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"), F.col("weight").alias("hub_weight")), F.struct("weight", -F.col("node")))
        hubs = now.groupBy(F.col("key").alias("_key")).agg(hub.alias("x"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("_key", "x.*")
        spokes = now.join(hubs, F.col("key") == F.col("_key")).where((F.col("comp") != F.col("hub_comp")) & _size_fits(F.col("n"), F.col("hub_n")))
        if pairs is not None:
            spokes = spokes.join(pairs.select(F.col("node").alias("_n"), F.col("hub").alias("_h")).hint("shuffle_hash"), (F.col("node") == F.col("_n")) & (F.col("hub") == F.col("_h")), "left_anti")
        best = F.max_by(F.struct("hub", "hub_n", "n"), F.struct("hub_weight", -F.col("hub")))
        fresh = scratch.store(spokes.groupBy("node").agg(best.alias("x")).select("node", "x.*"), "spokes")
        if not fresh.limit(1).count():
            break
        first = F.col("node") < F.col("hub")
        pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))  # noqa: B023, E731
        ordered = fresh.select(pick("node", "hub").alias("a"), pick("hub", "node").alias("b"), pick("n", "hub_n").alias("na"), pick("hub_n", "n").alias("nb")).distinct()
        ordered = scratch.store(ordered, "pairs")
        more = compared(screened(ordered, cands, "spokes"), full, "spokes")
        tried = ordered if tried is None else tried.unionByName(ordered)
        pairs = fresh if pairs is None else pairs.unionByName(fresh)
        links = more if links is None else links.unionByName(more)
        if not more.limit(1).count():
            break
        comps = components(links)
        of = comps.select(F.col("node").alias("_node"), "comp")
        now = met.join(of, F.col("node") == F.col("_node"), "left").withColumn("comp", F.coalesce("comp", "node")).drop("_node")
    ends = {"a": F.min("node"), "b": F.max("node"), "na": F.min_by("n", "node"), "nb": F.max_by("n", "node")}
    span = now.groupBy(F.col("key").alias("_key")).agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("size"), *[c.alias(name) for name, c in ends.items()])
    span = scratch.store(span.where("least < most").drop("least", "most"), "span")
    found = []
    left = scratch.store(pairs_left(span, tried), "left")
    if left.limit(1).count():
        found.append(compared(screened(left, cands, "left"), full, "left"))
    wide = span.where("size > 2").select("_key")
    apart = scratch.store(now.join(wide, F.col("key") == F.col("_key")).groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), "apart")
    if apart.limit(1).count():
        placed = prefixes(apart, full.join(apart.select("node"), "node", "left_semi"))
        of = scratch.store(families(placed), "families")
        more = family_links(of.where(F.col("size") <= FAMILY), full)
        large = of.where(F.col("size") > FAMILY)
        if large.limit(1).count():
            rest = scratch.store(placed.join(large.select("node"), "node", "left_semi"), "large")
            more = more.unionByName(compared(scratch.store(prefix_pairs(rest), "chords"), full, "chords")).unionByName(prefix_links(rest, full))
        found.append(scratch.store(more, "more-links"))
    found = [more for more in found if more.limit(1).count()]
    if found:
        for more in found:
            links = more if links is None else links.unionByName(more)
        comps = components(links)
    if comps is None:
        comps = components(classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    return rows.drop("sketch"), comps


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links lead to, its own included; kept marks the
    document of that id. Texts without words have no set, no link, and stay. Null ids count as
    larger than all; a component of null ids alone has a null id and keeps its rows. Repeated rows
    are copies; an empty table gives an empty result; other columns are ignored.
    """
    rows, comps = grouped(docs)
    of = comps.select(F.col("node").alias("_node"), "comp")
    placed = rows.join(of, F.col("node") == F.col("_node"), "left").withColumn("comp", F.coalesce("comp", "node")).withColumn("n_shingles", F.col("n"))
    lowest = placed.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("low")).select(F.col("comp").alias("_comp"), "low")
    out = placed.join(lowest, (F.col("comp") == F.col("_comp")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def survivors(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group (the smallest doc_id) and all rows without words; columns as they were."""
    rows, comps = grouped(docs)
    of = comps.select(F.col("node").alias("_node"), "comp")
    placed = rows.join(of, F.col("node") == F.col("_node"), "left").withColumn("comp", F.coalesce("comp", "node"))
    heads = placed.where("n > 0").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey")).alias("one"))
    heads = heads.select(F.col("one.doc_id").alias("__d"), F.col("one.tkey").alias("__t"))
    keyed = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tkey"), F.col("text").cast("string").alias("text"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    some = keyed.where(worded).join(heads, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("tkey") == F.col("__t")), "left_semi")
    # of rows that repeat an id and a text one stays, the same at every run; copies combine before the shuffle
    once = some.groupBy("doc_id", "tkey").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.select("row.*").unionByName(keyed.where(~worded).select("row.*"))
