"""Text and metadata: colours, sizes, band descriptions, patches, small encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bands import rgba

#: Fixed values of the archive format: number of a tile type, its name.
TILE_TYPES = ((0, "unknown"), (1, "mvt"), (2, "png"), (3, "jpeg"), (4, "webp"), (5, "avif"))


def tile_type_name(kind: Column) -> Column:
    out = F.lit("unknown")
    for number, name in TILE_TYPES:
        out = F.when(kind == number, name).otherwise(out)
    return out


def tile_type_number(name: Column) -> Column:
    out = F.lit(0)
    for number, known in TILE_TYPES:
        out = F.when(F.lower(name) == known, number).otherwise(out)
    return F.when(F.lower(name) == "jpg", 3).when(F.lower(name) == "terrarium", 2).otherwise(out)


def e7(degrees: Column) -> Column:
    """Degrees as the header stores them: single precision, ten millionths."""
    return F.round(degrees.cast("float").cast("double") * 1e7).cast("long")


def parse_colour(words: Column) -> Column:
    """Struct (r, g, b, a) of "R,G,B[,A]" or "#RRGGBB[AA]"."""
    parts = F.split(F.trim(words), ",")

    def at(i: int, default: int | None = None) -> Column:
        digits = F.substring(F.trim(words), 2 + 2 * i, 2)
        coded = F.conv(digits, 16, 10).cast("int")
        plain = F.try_element_at(parts, F.lit(i + 1)).try_cast("int")
        got = F.when(F.startswith(F.trim(words), F.lit("#")), F.when(digits != "", coded)).otherwise(plain)
        return got if default is None else F.coalesce(got, F.lit(default))

    return rgba(at(0), at(1), at(2), at(3, 255))


def human_size(n: Column) -> Column:
    """Bytes with one decimal, half up."""

    def tenths(unit: int, name: str) -> Column:
        t = F.floor((n * 10 + unit // 2) / unit)
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(name))

    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, tenths(1 << 10, " KB")).when(n < 1 << 30, tenths(1 << 20, " MB")).otherwise(tenths(1 << 30, " GB"))


def human_duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s / 60) % 60))


def patch_metadata(have: Column, put: dict[str, str], remove: list[str]) -> Column:
    """The map with keys set, then keys removed."""
    if put:
        names = F.array(*map(F.lit, put))
        have = F.map_concat(F.map_filter(have, lambda k, _: ~F.array_contains(names, k)), F.create_map(*(F.lit(x) for pair in put.items() for x in pair)))
    if remove:
        names = F.array(*map(F.lit, remove))
        have = F.map_filter(have, lambda k, _: ~F.array_contains(names, k))
    return have


#: Words that name a band's role; asked in this order.
ROLES = (("nir", r"\bnir\b|infrared"), ("swir", r"\bswir"), ("red", r"\bred\b"), ("green", r"\bgreen\b"), ("blue", r"\bblue\b"), ("alpha", r"\balpha\b"))


def band_role(description: Column) -> Column:
    """What a band's description says it holds; null if nothing known."""
    words = F.lower(F.trim(description))
    out = F.lit(None).cast("string")
    for role, pattern in reversed(ROLES):
        out = F.when(words.rlike(pattern), role).otherwise(out)
    return out


#: "Band", its number, a colon, the band's id, and its role in brackets.
BAND_LINE = r"Band[ \t]+([0-9]+):[ \t]+[^ \t\n(]+[ \t]+\(([A-Za-z0-9_]+)\)"


def band_lines(words: Column) -> Column:
    """Array of (band, role) from text such as "Band 4: B08 (NIR)"."""
    found = F.regexp_extract_all(words, F.lit(BAND_LINE), F.lit(0))
    return F.transform(found, lambda line: F.struct(F.regexp_extract(line, BAND_LINE, 1).cast("int").alias("band"), F.regexp_extract(line, BAND_LINE, 2).alias("role")))


def xml_items(xml: Column) -> Column:
    """Array of (name, sample, value) of the Item elements of band metadata; sample is null for items of the whole file, and an
    empty item's value is empty. Each element is read by itself."""
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<Item\b(?:[^>]*/>|.*?</Item\s*>)"), F.lit(0))
    sample = lambda item: F.nullif(F.xpath_string(item, F.lit("Item/@sample")), F.lit("")).cast("int")
    return F.transform(found, lambda item: F.struct(F.xpath_string(item, F.lit("Item/@name")).alias("name"), sample(item).alias("sample"), F.xpath_string(item, F.lit("Item")).alias("value")))
