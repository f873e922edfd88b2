"""Packed map files: image records, offset arrays, headers and directory entries as columns of hex, and their parsers.

Bytes are hex strings until they are written, so every field is a built-in expression. A file's
layout follows from sizes alone; payload bytes join it last, where the file is written in order.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.functions import scalars, tile
from tilequarry.operators import layout

#: Fixed values of the format: physical blocks, where the directory starts, largest file, unused block numbers.
PHYSICAL, DIRECTORY_AT, LARGEST_FILE, UNUSED = 512, 0x1000, 4_294_967_296, 0xFFFF
#: Fixed values of a record: type and subtype, length of the bit stream, class flags, bytes besides the image number.
RECORD_TYPE, STREAM_BYTES, CLASS_FLAGS, RECORD_FIXED = "06B3", 8, "E0", 40
#: Fixed values of the file header, by offset.
MAGIC, CREATOR, BOOT = "DSKIMG", "GARMIN", 0xAA55


# -- records ---------------------------------------------------------------------------------------


def _width_bits(size: Column) -> Column:
    """Bits of one extent of a stream whose base size is ``size``."""
    return F.when(size <= 9, size + 3).otherwise(size * 2 - 6)


def bit_stream(level: Column, lat_min: Column, lon_min: Column, lat_max: Column, lon_max: Column) -> Column:
    """Eight bytes, as hex: base sizes, then three clear bits, the width and the height of a tile at a level, lowest bits first."""
    shift = F.greatest(F.lit(0), 24 - level).cast("int")
    unit = F.pow(F.lit(2.0), shift).cast("long")
    span = lambda low, high: F.floor((tile.fixed24(high) - tile.fixed24(low) + unit - 1) / unit).cast("long") + 1
    width, height = span(lon_min, lon_max), span(lat_min, lat_max)
    need = F.ceil(F.log2(F.greatest(width, height).cast("double") + 1.0)) + 1
    small = F.greatest(F.lit(1), need - 3)
    base = F.when(F.greatest(width, height) <= 0, F.lit(1)).when(small <= 9, small).otherwise(F.least(F.lit(15), F.greatest(F.lit(10), F.ceil((need + 6) / 2)))).cast("int")
    bits = _width_bits(base)
    most = F.pow(F.lit(2.0), bits - 1).cast("long") - 1
    value = F.least(most, width) * 8 + F.least(most, height) * F.pow(F.lit(2.0), bits + 3).cast("long")
    return F.concat(F.lpad(F.hex((base * 17).cast("long")), 2, "0"), scalars.little(value, 7))


def record(id_bytes: Column) -> Column:
    """An image record, as hex, of 40 bytes and the image number.

    From columns centre_lat and centre_lon (of the subdivision), lat_min, lon_min, lat_max, lon_max,
    size, image and level. 180 degrees east is the largest number that four bytes hold.
    """
    c = F.col
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), 24 - c("level")))
    delta = lambda low, centre: F.greatest(F.lit(-32768).cast("long"), F.least(F.lit(32767).cast("long"), F.floor((tile.fixed24(c(low)) - tile.fixed24(c(centre))) / unit).cast("long")))
    stream = bit_stream(c("level"), c("lat_min"), c("lon_min"), c("lat_max"), c("lon_max"))
    bounds = [scalars.little(F.least(tile.fixed32(c(name)), F.lit(0x7FFFFFFF).cast("long")), 4) for name in ("lat_max", "lon_max", "lat_min", "lon_min")]
    head = [F.lit(RECORD_TYPE), scalars.little(delta("lon_min", "centre_lon"), 2), scalars.little(delta("lat_min", "centre_lat"), 2), scalars.varint(F.lit(STREAM_BYTES)), stream, F.lit("000000" + CLASS_FLAGS), scalars.varint(id_bytes + 20)]
    return F.concat(*head, scalars.little(c("image"), id_bytes), *bounds, scalars.little(c("size"), 4))


def records_of(data: Column) -> dict[str, Column]:
    """The fields of a record in hex: lon_delta, lat_delta, image, lat_max, lon_max, lat_min, lon_min, size; null for another type."""
    here = F.substring(data, 1, 4) == RECORD_TYPE
    # the length behind the flags counts the image number, bounds and size
    ids = scalars.varint_value(F.substring(data, 39, 8)).cast("int") - 20
    at = lambda i: F.lit(20) + ids + 4 * i
    degrees = lambda i: tile.degrees32(scalars.little_value(data, at(i), 4, True))
    fields = {"lon_delta": scalars.little_value(data, 2, 2, True), "lat_delta": scalars.little_value(data, 4, 2, True), "image": scalars.little_value(data, F.lit(20), ids), "lat_max": degrees(0), "lon_max": degrees(1), "lat_min": degrees(2), "lon_min": degrees(3), "size": scalars.little_value(data, at(4), 4)}
    return {name: F.when(here, value) for name, value in fields.items()}


def image_table(images: DataFrame, group: list[str], order: list[str], size: str) -> DataFrame:
    """Add image (from 0), offset and entry (the offset's four bytes, as hex) to the images of each group, in order."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = layout.offsets(images.withColumn("image", (F.row_number().over(w) - 1).cast("long")), group, order, size)
    return out.withColumn("entry", scalars.little(F.col("offset"), 4))


# -- headers and directory -------------------------------------------------------------------------


def file_layout(subfiles: DataFrame) -> DataFrame:
    """Blocks of subfiles(file, ord, name, kind, size): block, start_block, n_blocks, parts, data_start, total_blocks.

    Header and directory come first: 4096 bytes and an entry of 512 bytes for each 240 blocks of
    each subfile, and one for themselves. The block size is the smallest with which 16-bit numbers
    reach every block of the file.
    """
    own = Window.partitionBy("file")
    e2 = scalars.block_exponent(F.sum("size").over(own) + DIRECTORY_AT + 1024 * 1024)
    df = subfiles.withColumn("e2", e2).withColumn("block", F.lit(512).cast("long") * F.pow(F.lit(2.0), F.col("e2")).cast("long"))
    df = df.withColumn("n_blocks", scalars.blocks(F.col("size"), F.col("block")))
    df = df.withColumn("parts", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_blocks") / layout.CHAIN)))
    df = df.withColumn("data_start", scalars.aligned(DIRECTORY_AT + (1 + F.sum("parts").over(own)) * PHYSICAL, F.col("block")))
    before = own.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.floor(F.col("data_start") / F.col("block")).cast("long") + F.coalesce(F.sum("n_blocks").over(before), F.lit(0))
    return df.withColumn("start_block", start.cast("long")).withColumn("total_blocks", (F.floor(F.col("data_start") / F.col("block")) + F.sum("n_blocks").over(own)).cast("long"))


def _padded(text: Column, size: int) -> Column:
    return F.hex(F.rpad(F.substring(text, 1, size), size, " ").cast("binary"))


def _numbers(first: Column, count: Column) -> Column:
    """240 block numbers of two bytes from ``first`` on, ``count`` of them used."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(layout.CHAIN - 1)), lambda i: F.when(i < count, scalars.little(first + i, 2)).otherwise(F.lit(f"{UNUSED:04X}"))), "")


def directory(placed: DataFrame, clamp: bool = True) -> DataFrame:
    """Directory entries of files laid out: file, ord, part, entry (512 bytes, as hex); ord -1 is the entry of header and directory itself.

    A subfile of 4 GiB or more shows the largest number that four bytes hold or, without ``clamp``, its size's lowest four bytes.
    """
    part = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    used = F.col("part") * layout.CHAIN
    size = F.least(F.col("size"), F.lit(0xFFFFFFFF)) if clamp else F.col("size")
    shown = F.when(F.col("part") == 0, size).otherwise(F.lit(0).cast("long"))
    entry = F.concat(F.lit("01"), _padded(F.col("name"), 8), _padded(F.col("kind"), 3), scalars.little(shown, 4), F.lit("00"), scalars.little(F.col("part"), 1), F.lit("00" * 14), _numbers(F.col("start_block") + used, F.col("n_blocks") - used))
    rows = part.select("file", "ord", "part", entry.alias("entry"))
    heads = placed.groupBy("file").agg(F.first("data_start").alias("data_start"), F.first("block").alias("block"))
    own = F.concat(F.lit("01"), F.lit("20" * 11), scalars.little(F.col("data_start"), 4), F.lit("0300" + "00" * 14), _numbers(F.lit(0).cast("long"), F.floor(F.col("data_start") / F.col("block"))))
    return rows.unionByName(heads.select("file", F.lit(-1).cast(dict(placed.dtypes)["ord"]).alias("ord"), F.lit(0).cast("long").alias("part"), own.alias("entry")))


def header(name: Column, date6: Column, e2: Column, total_blocks: Column) -> Column:
    """The 512 bytes of a file's header, as hex: mark, date (six bytes, as hex), name, block size and a partition of the file's size."""
    sectors = total_blocks * F.pow(F.lit(2.0), e2).cast("long")
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    text = lambda s, size: s.encode().ljust(size, b"\0").hex().upper()
    fields = [
        (0x0A, F.lit("047A")), (0x10, F.lit(text(MAGIC, 7))), (0x17, F.lit("02")), (0x18, F.lit("2000")), (0x1A, F.lit("0001")), (0x39, date6), (0x40, F.lit("08")), (0x41, F.lit(text(CREATOR, 8))), (0x49, _padded(name, 20)),
        (0x5D, F.lit("0001")), (0x5F, F.lit("2000")), (0x61, F.lit("09")), (0x62, byte(e2)), (0x63, scalars.little(F.least(total_blocks, F.lit(0xFFFF)), 2)), (0x1BE, F.lit("010000FF60")),
        (0x1C3, byte(F.least(F.lit(0xFE).cast("long"), F.floor(F.floor(sectors / 63) / 255).cast("long")))), (0x1C6, F.lit("00000000")), (0x1CA, scalars.little(sectors, 4)), (0x1FE, scalars.little(F.lit(BOOT), 2)),
    ]
    sizes = {0x39: 6, 0x49: 20, 0x62: 1, 0x63: 2, 0x1C3: 1, 0x1CA: 4, 0x1FE: 2, 0x10: 7, 0x41: 8, 0x17: 1, 0x40: 1, 0x61: 1, 0x1BE: 5, 0x1C6: 4}
    out, at = [], 0
    for start, value in fields:
        out += [F.lit("00" * (start - at)), value]
        at = start + sizes.get(start, 2)
    return F.concat(*out)


def parsed_header(content: Column) -> dict[str, Column]:
    """Name, e2 and total_blocks of a file's first bytes; null where the mark is missing."""
    here = F.substring(content, 0x11, 6) == F.lit(MAGIC.encode())
    data = F.hex(F.substring(content, 1, 512))
    return {"name": F.when(here, F.rtrim(F.substring(content, 0x4A, 20).cast("string"))), "e2": F.when(here, scalars.little_value(data, 0x62, 1)), "total_blocks": F.when(here, scalars.little_value(data, 0x63, 2))}


def parsed_directory(files: DataFrame) -> DataFrame:
    """Subfiles of files(path, content), which may be cut behind the directory: path, name, kind, size, blocks (in order).

    Entries are read up to the first that is not active, as many as the entry of the directory itself tells.
    """
    region = scalars.little_value(F.hex(F.substring("content", DIRECTORY_AT + 0x0D, 4)), 0, 4)
    count = F.greatest(F.lit(0), F.floor((F.least(region, F.octet_length("content")) - DIRECTORY_AT) / PHYSICAL) - 1).cast("int")
    entries = files.where(F.octet_length("content") >= DIRECTORY_AT + PHYSICAL).select("path", F.explode(F.when(count > 0, F.sequence(F.lit(1), count))).alias("i"), "content")
    entries = entries.select("path", F.hex(F.substring("content", F.lit(DIRECTORY_AT + 1) + F.col("i") * PHYSICAL, F.lit(PHYSICAL))).alias("e")).where(F.substring("e", 1, 2) == "01")
    text = lambda start, size: F.rtrim(F.unhex(F.substring("e", 2 * start + 1, 2 * size)).cast("string"))
    numbers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(layout.CHAIN - 1)), lambda i: scalars.little_value(F.col("e"), i * 2 + 0x20, 2)), lambda b: b != UNUSED)
    rows = entries.select("path", text(1, 8).alias("name"), text(9, 3).alias("kind"), scalars.little_value(F.col("e"), 0x0C, 4).alias("size"), scalars.little_value(F.col("e"), 0x11, 1).alias("part"), numbers.alias("blocks"))
    chained = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "blocks"))), lambda p: p["blocks"]))
    return rows.groupBy("path", "name", "kind").agg(F.max("size").alias("size"), chained.alias("blocks"))


# -- writing ---------------------------------------------------------------------------------------


def written(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunks(file, ord, data) in order to files of ``folder``, which all workers reach: file, path, bytes.

    A file, at most 4 GiB, is one task that streams its sorted chunks; it appears under its name
    only when it is whole, so a lost task leaves nothing behind but a hidden part that a rerun replaces.
    """

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        name = out = None
        size, done = 0, []

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, os.path.join(folder, name))
                done.append((name, os.path.join(folder, name), size))

        for part in stream:
            for file, data in zip(part["file"], part["data"], strict=True):
                if file != name:
                    close()
                    name, size = file, 0
                    out = open(os.path.join(folder, f".{file}.{os.getpid()}.part"), "wb")
                out.write(data)
                size += len(data)
                if size >= LARGEST_FILE:
                    raise ValueError(f"{file}: a file stays below 4 GiB")
        close()
        yield pd.DataFrame(done, columns=["file", "path", "bytes"])

    ordered = chunks.select("file", "ord", "data").repartition("file").sortWithinPartitions("file", "ord")
    return ordered.mapInPandas(run, "file string, path string, bytes bigint")
