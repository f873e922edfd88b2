"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Pre-tokens are exploded with their positions inside blocks; a block's distinct words travel to
their hash range, where each distinct word of the corpus is encoded once; the ids are joined back
to the blocks and put together by position. Decoding joins the table of the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.llm import blocks, scratch

#: White space as Unicode's property of that name has it: a fixed list.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
OUTPUTS = {"ids": "array<int>", "decoded": "binary", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
_STATE: dict = {}


def splitter(pattern: str):
    """The pattern compiled so that \\s is Unicode's white space, as in the reference encoder."""
    import regex

    return regex.compile(pattern.replace("[^\\s", "[^" + _SPACE).replace("\\S", f"[^{_SPACE}]").replace("\\s", f"[{_SPACE}]"))


def _tools(path: str, pattern: str):
    """The compiled pattern, the encoder and the tokens' bytes, once for each worker."""
    if (path, pattern) not in _STATE:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        import regex

        odd = regex.compile(f"[{_SPACE}][{_SPACE}]")
        cut = regex.compile(f"(?<=[^{_SPACE}])(?= [^{_SPACE}])")
        _STATE[path, pattern] = splitter(pattern), encoding._core_bpe.encode_single_piece, {rank: token for token, rank in ranks.items()}, odd, cut
    return _STATE[path, pattern]


def _chunks(text: str, odd, cut) -> list[str]:
    """The text cut before single spaces between words: no match crosses such a place, or looks across."""
    if " " not in text:
        return [text] if text else []
    if odd.search(text):
        return cut.split(text)
    head, *rest = text.split(" ")
    return ([head] if head else []) + [" " + part for part in rest]


def _packed(path: str, pattern: str, parts: int):
    def pack(block: int, ids: list, texts: list[bytes]) -> Iterator[tuple]:
        split, _, _, odd, cut = _tools(path, pattern)
        known: dict[str, list[int]] = {}
        codes_of: dict[str, int] = {}
        codes, sizes = [], []
        for raw in texts:
            own: list[int] = []
            for chunk in _chunks(raw.decode("utf-8", "replace"), odd, cut):
                got = known.get(chunk)
                if got is None:
                    got = [codes_of.setdefault(w, len(codes_of)) for w in split.findall(chunk)]
                    if len(chunk) <= 64:
                        known[chunk] = got
                own += got
            codes.append(np.array(own, np.uint32))
            sizes.append(len(own))
        del known
        stream = np.concatenate(codes)
        rank = np.empty(len(codes_of), np.uint32)
        rank[np.argsort(-np.bincount(stream, minlength=len(codes_of)), kind="stable")] = np.arange(len(codes_of), dtype=np.uint32)
        width = 1 + (max(len(codes_of), 2) - 1).bit_length() // 8
        by_part: list[list[bytes]] = [[] for _ in range(parts)]
        place: dict[bytes, int] = {}
        for word, code in codes_of.items():
            raw = word.encode()
            place[raw] = code
            by_part[zlib.crc32(raw) % parts].append(raw)
        order: list[np.ndarray] = []
        for part, some in enumerate(by_part):
            if some:
                some.sort()
                order.append(np.fromiter((rank[place[w]] for w in some), np.uint32, len(some)))
                yield block, part, blocks.shut((np.fromiter(map(len, some), np.uint32, len(some)), b"".join(some)))
        payload = {"ids": ids, "sizes": np.array(sizes, np.int64), "width": width, "codes": blocks.planes(rank[stream], width), "order": blocks.planes(np.concatenate(order) if order else np.zeros(0, np.uint32), width)}
        yield block, -1, blocks.shut(payload)

    return pack


def _encoded(path: str, pattern: str):
    def encode(part: int, table: pa.Table) -> Iterator[tuple]:
        one = _tools(path, pattern)[1]
        known: dict[bytes, list[int]] = {}
        for block, blob in zip(table.column("block").to_pylist(), table.column("data"), strict=True):
            lengths, data = blocks.opened(blob.as_py())
            ends = np.cumsum(lengths, dtype=np.int64).tolist()
            ids: list[int] = []
            counts = np.empty(len(ends), np.uint32)
            at = 0
            for i, end in enumerate(ends):
                word = data[at:end]
                got = known.get(word)
                if got is None:
                    got = known[word] = one(word)
                ids += got
                counts[i] = len(got)
                at = end
            yield block, part, blocks.shut((counts, blocks.planes(np.array(ids, np.uint32), 4)))

    return encode


def _assembled(path: str, pattern: str, outputs: tuple[str, ...]):
    def assemble(block: int, table: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        token_bytes = _tools(path, pattern)[2]
        rows = dict(zip(answers.column("part").to_pylist(), answers.column("data"), strict=True))
        payload = blocks.opened(table.column("data")[0].as_py())
        order = blocks.unplanes(payload["order"], payload["width"]).astype(np.int64)
        words: list[list[int]] = [[]] * len(order)
        at = 0
        for part in sorted(rows):
            counts, ids = blocks.opened(rows[part].as_py())
            ids = blocks.unplanes(ids, 4).tolist()
            low = 0
            for code, n in zip(order[at : at + len(counts)].tolist(), counts.tolist(), strict=True):
                words[code] = ids[low : low + n]
                low += n
            at += len(counts)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        as_text = [b" ".join(b"%d" % i for i in w) for w in words] if "ids_sha256" in outputs else []
        as_bytes = [b"".join([token_bytes[i] for i in w]) for w in words] if {"decoded", "decoded_sha256"} & {*outputs} else []
        stream, low = blocks.unplanes(payload["codes"], payload["width"]).astype(np.int64), 0
        for doc_id, size in zip(payload["ids"], payload["sizes"].tolist(), strict=True):
            own = stream[low : low + size]
            codes = own.tolist()
            low += size
            row: list = [doc_id]
            decoded = b"".join([as_bytes[c] for c in codes]) if as_bytes else b""
            for name in outputs:
                if name == "ids":
                    row.append([i for c in codes for i in words[c]])
                elif name == "n_tokens":
                    row.append(int(lengths[own].sum()))
                elif name == "ids_sha256":
                    row.append(hashlib.sha256(b" ".join([as_text[c] for c in codes])).hexdigest())
                else:
                    row.append(decoded if name == "decoded" else hashlib.sha256(decoded).hexdigest())
            yield tuple(row)

    return assemble


def encode(docs: DataFrame, path: str, pattern: str, outputs: Iterable[str] = ("ids", "n_tokens")) -> DataFrame:
    """Encode every whole text by the ranks in the file ``path``, matches of ``pattern`` separately.

    Returns doc_id and the ``outputs`` asked for, of OUTPUTS: the ids, the text decoded from them,
    or their digests. A null or empty text has no tokens; null ids and repeated rows pass; an
    empty table gives an empty result; other columns are ignored. ``path`` must exist on workers.
    """
    outputs = tuple(outputs)
    parts = blocks.ranges(docs)
    stored = scratch.dealt(blocks.scanned(docs, _packed(path, pattern, parts), "block bigint, part int, data binary"), "block", parts)
    answers = blocks.grouped(stored.where(F.col("part") >= 0), "part", _encoded(path, pattern), "block bigint, part int, data binary")
    schema = ", ".join(["doc_id bigint", *(f"{name} {OUTPUTS[name]}" for name in outputs)])
    return blocks.met(stored.where(F.col("part") < 0), answers, "block", _assembled(path, pattern, outputs), schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add decoded (binary) to encoded(doc_id, ids): the ids' bytes by the table of ``path``; null ids give null."""

    def run(doc_id, ids):
        table = _tools(path, pattern)[2]
        yield doc_id, ids, None if ids is None else b"".join(table[i] for i in ids)

    return blocks.mapped(encoded.select("doc_id", "ids"), run, "doc_id bigint, ids array<int>, decoded binary")
