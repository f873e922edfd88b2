"""Scalar functions over names, addresses, sizes, colours and dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colour names with their red, green and blue.
COLOURS = {
    "white": (255, 255, 255),
    "black": (0, 0, 0),
    "red": (255, 0, 0),
    "green": (0, 128, 0),
    "blue": (0, 0, 255),
    "yellow": (255, 255, 0),
    "cyan": (0, 255, 255),
    "magenta": (255, 0, 255),
    "orange": (255, 165, 0),
    "gray": (128, 128, 128),
    "grey": (128, 128, 128),
    "transparent": (0, 0, 0),
}
#: Names of the placeholders that stand for a tile's address, and longest cache key.
TILE_VARIABLES, LONGEST_KEY = ("x", "y", "z", "zoom"), 200
#: Smallest scale denominators of the zooms 0, 1, 2, ...; what is below all of them has the zoom after the last.
SCALES = (500000000, 200000000, 100000000, 50000000, 20000000, 10000000, 5000000, 2000000, 1000000, 500000, 200000, 100000, 50000, 20000, 10000, 5000, 2000, 1000, 500, 200, 100)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with ${name} and {name} replaced by columns; other placeholders stay."""
    for name, value in values.items():
        text = value.cast("string")
        template = F.replace(F.replace(template, F.lit("${" + name + "}"), text), F.lit("{" + name + "}"), text)
    return template


def unresolved(text: Column) -> Column:
    """The ${...} placeholders that are left."""
    return F.regexp_extract_all(text, F.lit(r"(\$\{[^}]*\})"), 1)


def cache_key(url: Column, extra: Column | None = None) -> Column:
    """A folder name for an address: its path and query without tile placeholders, joined by '-', percent-encoded, of 200 characters at most.

    Placeholders are ${x}, {x} and $x. Parts that are empty go, dots around a part go, ``extra`` is
    one more part unless null or empty; '?' becomes '-', '=' and '&' become '_'.
    """
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", ""), r"^//[^/?#]*", "")
    path = F.regexp_replace(F.regexp_replace(path, "#.*$", ""), r"\?$", "")
    path = F.regexp_replace(path, "|".join(rf"\$?\{{{v}\}}|\${v}" for v in TILE_VARIABLES), "")
    parts = F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: F.regexp_replace(p, r"^\.+|\.+$", ""))
    if extra is not None:
        parts = F.when(F.coalesce(extra, F.lit("")) != "", F.concat(parts, F.array(extra))).otherwise(parts)
    joined = F.translate(F.array_join(parts, "-"), "?=&", "-__")
    quoted = F.replace(F.url_encode(joined), F.lit("+"), F.lit("%20"))  # spaces; a plus itself is %2B by now
    quoted = F.replace(F.replace(quoted, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.substring(quoted, 1, LONGEST_KEY)


def is_hash_name(name: Column) -> Column:
    """Whether a folder has the older kind of name: 12 lower-case hexadecimal digits."""
    return name.rlike("^[0-9a-f]{12}$")


def epsg(urn: Column) -> Column:
    """The code in a name such as urn:ogc:def:crs:EPSG::3857; null without one."""
    code = F.regexp_extract(urn, r"(?i)EPSG.*?([0-9]+)[^0-9]*$", 1)
    return F.when(code != "", code.cast("int"))


def map_id(name: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """31 bits from the MD5 of "id:north,south,west,east", bounds to six places: its first four bytes, lowest first."""
    bounds = F.concat_ws(",", *[F.format_string("%.6f", F.coalesce(b.cast("double"), F.lit(0.0))) for b in (north, south, west, east)])
    digest = F.md5(F.concat(name, F.lit(":"), bounds).cast("binary"))
    swapped = F.concat(*[F.substring(digest, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)


def group_map_id(base: Column, group: Column) -> Column:
    """The id of a file's group, counted from 0."""
    return (base.cast("long") + group + 1).bitwiseAND(0x7FFFFFFF)


def colour(value: Column) -> Column:
    """Red, green and blue of a name, #RRGGBB, #RGB, RRGGBB or 'r,g,b[,a]' (clamped); null if it is none."""
    low = F.lower(F.trim(value))
    names = F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for pair in COLOURS.items() for v in pair])
    digits = F.regexp_replace(low, "^#", "")
    long = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    from_hex = F.array(*[F.conv(F.substring(long, i, 2), 16, 10).cast("int") for i in (1, 3, 5)])
    parts = F.transform(F.slice(F.split(low, r"\s*,\s*"), 1, 3), lambda p: F.greatest(F.lit(0), F.least(F.lit(255), p.cast("int"))))
    return F.when(names[low].isNotNull(), names[low]).when(low.rlike("^(#[0-9a-f]{3}|#?[0-9a-f]{6})$"), from_hex).when(low.rlike(r"^-?\d{1,9}(\s*,\s*-?\d{1,9}){2,3}$"), parts)


def zoom_of_scale(denominator: Column) -> Column:
    """The zoom of a scale denominator, by the thresholds of SCALES."""
    zoom = F.lit(len(SCALES))
    for z, least in reversed(list(enumerate(SCALES))):
        zoom = F.when(denominator >= least, F.lit(z)).otherwise(zoom)
    return zoom


def opacity(default: Column, by_zoom: Column, zoom: Column) -> Column:
    """A layer's opacity at a zoom: its map's entry, 1 where the map lacks the zoom, else the plain value."""
    return F.when(by_zoom.isNotNull(), F.coalesce(F.try_element_at(by_zoom, zoom), F.lit(1.0))).otherwise(F.coalesce(default, F.lit(1.0)))


def alpha(share: Column) -> Column:
    """An opacity from 0 to 1 as 0 to 255, halves to even."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(share * 255.0, 0).cast("int")))


def human_size(size: Column) -> Column:
    """A size in bytes with a unit of 1024s, two places at most, trailing zeros cut."""
    unit = F.when(size < 1024, 0).when(size < 1024**2, 1).when(size < 1024**3, 2).when(size < 1024**4, 3).otherwise(4)
    text = F.format_string("%.2f", size / F.pow(F.lit(1024.0), unit))
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), unit + 1))


def blocks(size: Column, block: Column) -> Column:
    """Blocks that hold ``size`` bytes."""
    return F.ceil(size / block).cast("long")


def aligned(size: Column, block: Column) -> Column:
    return blocks(size, block) * block


def block_exponent(size: Column) -> Column:
    """The exponent over 512 bytes of the smallest block with which 65,535 blocks hold a file: 6 to 12."""
    need = F.ceil(F.log2(F.greatest(size, F.lit(1)) / 33553920.0)).cast("int")
    return F.greatest(F.lit(6), F.least(F.lit(12), need))


def id_bytes(count: Column) -> Column:
    """Bytes that number ``count`` images."""
    return F.when(count <= 1 << 8, 1).when(count <= 1 << 16, 2).when(count <= 1 << 24, 3).otherwise(4)


def signed24(value: Column) -> Column:
    """An unsigned 24-bit number read as a signed one."""
    return F.when(value >= 1 << 23, value - (1 << 24)).otherwise(value)


def varint(value: Column) -> Column:
    """One or two bytes, as hex: a set low bit marks 7 bits in one byte, low bits 10 mark 13 bits in two; null for what neither holds."""
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    two = F.concat(byte(F.shiftleft(value.cast("long").bitwiseAND(0x3F), 2).bitwiseOR(2)), byte(F.shiftright(value.cast("long"), 6)))
    return F.when(value.between(0, (1 << 7) - 1), byte(value * 2 + 1)).when(value.between(1 << 7, (1 << 13) - 1), two)


def varint_value(data: Column) -> Column:
    """The number in the first bytes (hex) of a varint, of one to four bytes; null if bytes are missing.

    Low bits 1, 10, 100 and 000 of the first byte mark one to four bytes; the rest of it and the
    bytes behind it are the number, lowest first.
    """
    at = lambda i: F.conv(F.substring(data, 2 * i + 1, 2), 16, 10).cast("long")
    first = at(0)
    two = F.shiftright(first, 2) + F.shiftleft(at(1), 6)
    three = F.shiftright(first, 3) + F.shiftleft(at(1), 5) + F.shiftleft(at(2), 13)
    four = F.shiftright(first, 4) + F.shiftleft(at(1), 4) + F.shiftleft(at(2), 12) + F.shiftleft(at(3), 20)
    marked = lambda bit: first.bitwiseAND(bit) == bit
    whole = lambda n, value: F.when(F.length(data) >= 2 * n, value)
    return F.when(marked(1), F.shiftright(first, 1)).when(marked(2), whole(2, two)).when(marked(4), whole(3, three)).otherwise(whole(4, four))


def little(value: Column, size: int | Column) -> Column:
    """The lowest ``size`` bytes of a whole number, lowest first, as hex; negative ones as two's complement."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    turned = F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])
    return F.substring(turned, F.lit(1), (size if isinstance(size, Column) else F.lit(size)) * 2)


def little_value(data: Column, start: int | Column, size: int | Column, signed: bool = False) -> Column:
    """The number in ``size`` bytes of hex ``data`` from byte ``start``, lowest byte first."""
    start, size = (F.lit(x) if isinstance(x, int) else x for x in (start, size))
    part = F.substring(data, start * 2 + 1, size * 2)
    turned = F.array_join(F.transform(F.sequence(size - 1, F.lit(0), F.lit(-1)), lambda i: F.substring(part, i * 2 + 1, F.lit(2))), "")
    value = F.conv(turned, 16, 10).cast("long")
    return F.when(value >= F.pow(F.lit(2.0), size * 8 - 1), value - F.pow(F.lit(2.0), size * 8).cast("long")).otherwise(value) if signed else value


def date7(moment: Column) -> Column:
    """Year (two bytes, lowest first), month, day, hour, minute, second and a zero, as hex."""
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    return F.concat(little(F.year(moment), 2), *[byte(f(moment)) for f in (F.month, F.dayofmonth, F.hour, F.minute, F.second)], F.lit("00"))


def extent_units(extent: Column, shift: Column) -> Column:
    """An extent in units of 2**shift, one more for the rest, at most 0x7FFF."""
    return F.least(F.lit(0x7FFF).cast("long"), F.expr("0L") + F.floor(extent / F.pow(F.lit(2.0), shift)).cast("long") + 1)


def older_than(date: Column, now: Column, days: int) -> Column:
    """Whether a download date lies ``days`` before now; a missing or unreadable one counts as old."""
    return F.coalesce(F.try_to_timestamp(date) < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(True))


def fresh(etag: Column, remote_etag: Column, modified: Column, remote_modified: Column) -> Column:
    """Three-valued: entity tags decide (quotes and a weak mark aside), else the dates, else null."""
    bare = lambda c: F.regexp_replace(c, '^(W/)?"|"$', "")
    return F.when(etag.isNotNull() & remote_etag.isNotNull(), bare(etag) == bare(remote_etag)).when(modified.isNotNull() & remote_modified.isNotNull(), modified == remote_modified)


def filter_name(items: Column) -> Column:
    """A map as 'k=v,k=v' by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(items)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def source_type(explicit: Column, url: Column) -> Column:
    """A source's type: the given one, else by its address; null if neither tells."""
    return F.coalesce(
        F.when(explicit != "", explicit),
        F.when(url.rlike(r"\{(" + "|".join(TILE_VARIABLES) + r")\}"), "wmts").when(url.rlike("/(collections|stac)/"), "stac").when(url.rlike(r"^(\./|\.\./|/)") | ~url.contains("://"), "path"),
    )


def hex_dump(data: Column, width: int = 16) -> Column:
    """Bytes as lines of an offset, ``width`` bytes in hexadecimal and the same as text, '.' for what cannot be printed; '' without bytes."""
    digits, text = F.lower(F.hex(data)), F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^ -~]", ".")

    def line(i: Column) -> Column:
        own = F.regexp_replace(F.substring(digits, i * (2 * width) + 1, F.lit(2 * width)), "(..)(?=.)", "$1 ")
        return F.concat(F.lpad(F.lower(F.hex(i * width)), 4, "0"), F.lit("  "), F.rpad(own, 3 * width, " "), F.lit("  "), F.substring(text, i * width + 1, F.lit(width)))

    last = F.ceil(F.octet_length(data) / width).cast("int") - 1
    return F.when(last < 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), line), "\n"))


def type_code(text: Column) -> Column:
    """A type's number, written in decimal or with 0x in hexadecimal; null if it is neither."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(low, F.lit(3), F.length(low)), 16, 10).cast("int")).when(low.rlike("^[0-9]+$"), low.try_cast("int"))


def item_folder(source: Column, url: Column, item: Column, asset_filter: Column | None = None) -> Column:
    """The folder of a catalog's item in the cache: its source, the address's key with the filter, and the item without slashes."""
    extra = None if asset_filter is None else filter_name(asset_filter)
    return F.concat_ws("/", F.lit("cache"), source, cache_key(url, extra), F.translate(item, "/\\", "__"))


def needs_warp(exists: Column, code: Column, target: Column, paletted: Column, bands: Column, fresh_copy: Column) -> Column:
    """Whether a raster has to be warped: it is there, has no fresh warped copy, and differs from the target, has a palette or too few bands."""
    ready = F.coalesce((code == target) & ~paletted & (bands >= 3), F.lit(False))
    return exists & ~ready & ~F.coalesce(fresh_copy, F.lit(False))
