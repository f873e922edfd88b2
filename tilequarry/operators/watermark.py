"""Buyer marks in packed files: a readable header and an encrypted payload in the first 4 KiB."""

from __future__ import annotations

import hashlib
import hmac
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilequarry.functions import scalars

#: The patched part of a file, the room of the readable header at its start, marks, flags and longest texts.
START, END, HEADER_ROOM = 0x400, 0x1000, 128
HEADER_MAGIC, HEADER_FLAGS, LONGEST_HEADER = b"CH", 1, 120
PAYLOAD_MAGIC, PAYLOAD_FLAGS, LONGEST_PAYLOAD = b"CW", 0, 252
#: Bytes of mark, length and flags, of a nonce and of a tag.
FRAME, NONCE, TAG = 6, 12, 16


def key_of(secret: str | bytes) -> bytes:
    """A 32-byte key of any secret."""
    return hashlib.sha256(secret.encode() if isinstance(secret, str) else secret).digest()


def nonce_of(key: bytes, plain: bytes) -> bytes:
    """Twelve bytes that follow from key and payload, so that a rerun writes the same file."""
    return hmac.new(key, plain, hashlib.sha256).digest()[:12]


def place_of(key: bytes, map_id: int) -> int:
    """Where the payload of a map goes: a place that only the key tells, with room for the longest payload."""
    room = END - START - HEADER_ROOM - (FRAME + NONCE + LONGEST_PAYLOAD + TAG)
    return START + HEADER_ROOM + int.from_bytes(hmac.new(key, b"%08X" % map_id, hashlib.sha256).digest()[:4], "little") % room


def header(text: str) -> bytes:
    """The readable header's bytes: mark, length of all of it, flags, text."""
    raw = text.encode()
    if len(raw) > LONGEST_HEADER:
        raise ValueError(f"a header has at most {LONGEST_HEADER} bytes")
    return HEADER_MAGIC + struct.pack("<HH", FRAME + len(raw), HEADER_FLAGS) + raw


def framed(sealed_payload: Column) -> Column:
    """The payload's bytes: mark, length of the sealed payload, flags, sealed payload."""
    size = F.octet_length(sealed_payload)
    return F.concat(F.lit(PAYLOAD_MAGIC), F.unhex(scalars.little(size, 2)), F.lit(struct.pack("<H", PAYLOAD_FLAGS)), sealed_payload)


def _framed_at(data: Column | str, at: int, magic: bytes, less: int) -> Column:
    """What a frame at ``at`` holds; null without its mark, or if it does not fit before END."""
    data = F.col(data) if isinstance(data, str) else data
    size = scalars.little_value(F.hex(F.substring(data, at + 3, 2)), 0, 2) - less
    end = F.least(F.octet_length(data), F.lit(END))
    return F.when((F.substring(data, at + 1, 2) == F.lit(magic)) & (size >= 0) & (F.lit(at + FRAME) + size <= end), F.substring(data, F.lit(at + FRAME + 1), size.cast("int")))


def header_text(data: Column | str) -> Column:
    """The readable header of a file's first bytes; null if there is none, it is too long, or no UTF-8."""
    raw = _framed_at(data, START, HEADER_MAGIC, FRAME)
    return F.try_validate_utf8(F.when(F.octet_length(raw) <= HEADER_ROOM - FRAME, raw).cast("string"))


def payload(data: Column, key: bytes, map_id: int) -> Column:
    """The payload of a map's first bytes; null if there is none or the key is another."""
    return opened(_framed_at(data, place_of(key, map_id), PAYLOAD_MAGIC, 0), key).cast("string")


def marked(data: Column, key: bytes, map_id: int, plain: str, readable: str | None = None) -> Column:
    """A file's first bytes with its marks; the same for the same input, so that a rerun writes the same file."""
    raw = plain.encode()
    if len(raw) > LONGEST_PAYLOAD:
        raise ValueError(f"a payload has at most {LONGEST_PAYLOAD} bytes")
    own = framed(sealed(F.lit(raw), key, F.lit(nonce_of(key, raw))))
    out = patched(data, place_of(key, map_id), own)
    return patched(out, START, F.lit(header(readable))) if readable is not None else out


def sealed(plain: Column, key: bytes, nonce: Column) -> Column:
    """nonce, ciphertext and tag by the engine's own AES-GCM."""
    return F.aes_encrypt(plain, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce)


def opened(data: Column, key: bytes) -> Column:
    """The payload, or null if it was not sealed with this key."""
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM"))


def patched(data: Column, at: int, patch: Column) -> Column:
    """Bytes with those from ``at`` replaced by a patch."""
    return F.concat(F.substring(data, 1, at), patch, F.substring(data, F.lit(at + 1) + F.octet_length(patch), F.octet_length(data)))
