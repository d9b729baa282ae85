"""Column expressions for text and colours. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow.conventions import DIGIT, SPACE


def rx(column, pattern: str) -> Column:
    return F.regexp_like(column, F.lit(pattern))


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounding to the even neighbour, as doubles."""
    if digits == 0:
        return F.rint(value)
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def strip(column) -> Column:
    """Removes Unicode white space from both ends."""
    return F.regexp_replace(column, rf"^{SPACE}+|{SPACE}+$", "")


# The white space characters of Unicode.
SPACES = [chr(k) for k in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def is_space(c: Column) -> Column:
    """Whether a single character is white space: a set look-up, for glyph tables."""
    return c.isin(*SPACES, "")


def collapse(column) -> Column:
    return strip(F.regexp_replace(column, rf"{SPACE}+", " "))


def norm_repeat(column) -> Column:
    """Key of a repeated line: no white space, digit runs as one '#'."""
    return F.regexp_replace(F.regexp_replace(column, rf"{SPACE}+", ""), rf"{DIGIT}+", "#")


def compact(column, numbers: bool = True) -> Column:
    """Text without white space and blank-box marks; digit runs may be masked."""
    out = F.regexp_replace(column, rf"(?:{SPACE}|\x{{F8F0}})+", "")
    return out if numbers else F.regexp_replace(out, rf"{DIGIT}+", "#")


def shingles(column, n: int = 6) -> Column:
    """All overlapping n-character pieces, in one pass over the text; none if the text is shorter."""
    return F.regexp_extract_all(column, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))


def is_bold(font: Column, flags: Column, char_flags: Column) -> Column:
    """Bold by font name, by flag, or by being both filled and stroked; semi-bold faces count only when stroked."""
    name = F.lower(font)
    stroked = char_flags.bitwiseAND(48) == 48
    semi = name.contains("semibold") | name.contains("demibold")
    face = name.contains("bold") | (flags.bitwiseAND(16) != 0) | rx(font, r"[a-z](?:EB|XB|B)$")
    return F.when(semi, stroked).otherwise(face | stroked)


def ink(rgb: Column) -> Column:
    """Ink colour: null for near black, #FFFFFF for near white, else #RRGGBB."""
    parts = [F.shiftright(rgb, shift).bitwiseAND(255) for shift in (16, 8, 0)]
    return (F.when(F.greatest(*parts) < 40, F.lit(None).cast("string")).when(F.least(*parts) > 235, "#FFFFFF")
            .otherwise(F.format_string("#%02X%02X%02X", *parts)))


def is_dark(hex_colour: Column) -> Column:
    r, g, b = [F.conv(F.substring(hex_colour, start, 2), 16, 10).cast("int") for start in (2, 4, 6)]
    return F.coalesce(299 * r + 587 * g + 114 * b < 110000, F.lit(False))


# Widths of punctuation in thousandths of the font size.
NARROW = {
    " ": 260, ".": 250, ",": 250, "‘": 250, "’": 250, "'": 220, "·": 250, "(": 346, ")": 346, "[": 360, "]": 360,
    ":": 286, ";": 286, "-": 310, "!": 330, "?": 470, '"': 410, "“": 410, "”": 410,
}
# Code point ranges of full-width characters.
FULL_WIDTH = [(0x1100, 0x11FF), (0x2E80, 0x9FFF), (0xAC00, 0xD7A3), (0xE000, 0xFAFF), (0xFF00, 0xFF60)]


def natural_milli_em(text) -> Column:
    """Natural width of a text in thousandths of an em; whole numbers, so the sum does not depend on its order.

    Counts characters per width class instead of walking an array of characters.
    """
    column = F.col(text) if isinstance(text, str) else text

    def count(pattern: str) -> Column:
        return F.length(column) - F.length(F.regexp_replace(column, pattern, ""))

    by_width: dict[int, str] = {}
    for char, width in NARROW.items():
        by_width[width] = by_width.get(width, "") + char
    classes = {width: "[" + "".join(rf"\x{{{ord(c):X}}}" for c in chars) + "]" for width, chars in by_width.items()}
    narrow_all = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in NARROW) + "]"
    full = "[" + "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in FULL_WIDTH) + "]"
    ascii_rest = count(r"[\x{0}-\x{7F}]") - count(
        "[" + "".join(rf"\x{{{ord(c):X}}}" for c in NARROW if ord(c) < 128) + "]")
    total = F.lit(0)
    for width, pattern in classes.items():
        total = total + count(pattern) * width
    rest = F.length(column) - count(narrow_all) - count(full) - ascii_rest
    return (total + count(full) * 1000 + ascii_rest * 560 + rest * 800).cast("long")


def norm_title(column) -> Column:
    """One spelling for the brackets of a box title."""
    out = collapse(column)
    out = F.regexp_replace(out, rf"^[<〈＜《]{SPACE}*", "<")
    return F.regexp_replace(out, rf"{SPACE}*[>〉＞》]$", ">")


QUOTES = "“\"'‘’”`"


def repair_text(column) -> Column:
    """Usual misreadings of recognised text, and quotes that alternate between opening and closing."""
    out = F.translate(column, "，．？", ",.?")
    out = F.regexp_replace(out, r"^(.{1,2}?\.)[。,·.]", "$1")
    out = F.regexp_replace(out, rf"^({DIGIT}{{1,2}}\.)[워원윈왼웟웠윘]글", "$1윗글")
    out = F.regexp_replace(out, r"[기거]장(적절|유사|가까운|큰|중요)", "가장$1")
    out = F.regexp_replace(out, r"^으\?", "은?")
    out = F.regexp_replace(out, rf"[{QUOTES}](보기[^>]{{0,2}}>)", "<$1")
    pieces = F.split(out, f"[{QUOTES}]")
    marked = F.transform(pieces, lambda x, i: F.when(i == 0, x).when(i % 2 == 1, F.concat(F.lit("‘"), x))
                         .otherwise(F.concat(F.lit("’"), x)))
    return F.array_join(marked, "")


def safe_name(column, default: str) -> Column:
    """A file name: last path part, reserved characters as '_', at most 120 characters, `default` if nothing is left."""
    last = F.substring_index(F.regexp_replace(column, "/+$", ""), "/", -1)
    clean = F.regexp_replace(last, r'[\\/:*?"<>|\x00-\x1f]', "_")
    trimmed = F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(F.substring(trimmed, 1, 120), F.lit("")), F.lit(default))


def device_of(agent) -> Column:
    ua = F.lower(F.coalesce(agent, F.lit("")))
    return (F.when(ua.contains("iphone") | ua.contains("ipad"), "iPhone/iPad").when(ua.contains("android"), "Android")
            .when(ua.contains("windows"), "Windows").when(ua.contains("mac os") | ua.contains("macintosh"), "Mac")
            .when(ua.contains("linux"), "Linux").otherwise("기타"))


def redact_causes(causes) -> Column:
    """Causes without quoted source text: at most four, at most 80 characters each."""
    return F.slice(F.transform(causes, lambda c: F.substring(
        F.regexp_replace(c, rf"{SPACE}*\(누락 줄 예:[^\n]*$", ""), 1, 80)), 1, 4)


DETAIL_KEYS = ("endnotes", "auto_number", "font", "size", "preset")


def scrub_detail(detail) -> Column:
    return F.map_filter(detail, lambda k, v: k.isin(*DETAIL_KEYS))
