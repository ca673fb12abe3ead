"""Scalar expressions: measures, units, colours, text and metadata typing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Millimetres in each unit, symbols and shown decimals; unknown units count as raw.
MILLIMETRES = {"raw": 1.0, "um": 0.001, "mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4}
SYMBOLS = {"raw": "", "um": "μm", "mm": "mm", "cm": "cm", "m": "m", "in": "in"}
DECIMALS = {"raw": 2, "um": 1, "mm": 2, "cm": 3, "m": 4, "in": 3}
# The stops of the colour maps, evenly spaced; an unknown name is the first map.
COLOUR_STOPS = {
    "blueRed": [(0.23, 0.30, 0.75), (0.13, 0.70, 0.80), (0.55, 0.83, 0.35), (0.95, 0.85, 0.20), (0.84, 0.19, 0.15)],
    "viridis": [(0.27, 0.00, 0.33), (0.28, 0.22, 0.55), (0.13, 0.40, 0.55), (0.15, 0.58, 0.43), (0.48, 0.73, 0.22), (0.99, 0.91, 0.14)],
    "plasma": [(0.05, 0.03, 0.53), (0.42, 0.00, 0.66), (0.72, 0.10, 0.54), (0.95, 0.35, 0.24), (0.98, 0.72, 0.08), (0.94, 0.97, 0.13)],
    "coolwarm": [(0.23, 0.30, 0.75), (0.55, 0.60, 0.88), (0.87, 0.87, 0.87), (0.88, 0.55, 0.50), (0.75, 0.15, 0.15)],
    "turbo": [(0.19, 0.07, 0.23), (0.14, 0.40, 0.82), (0.06, 0.72, 0.65), (0.35, 0.88, 0.30), (0.78, 0.87, 0.14), (0.98, 0.58, 0.07), (0.84, 0.19, 0.15)],
}
# Keys whose values are times, and parts of other keys that hint at one.
TIME_KEYS = ("createdAt", "modifiedAt", "timestamp", "computedAt", "created_at", "modified_at", "updated_at", "savedAt", "uploaded_at", "exportedAt", "processedAt")
TIME_HINTS = ("time", "date", "at")
YEAR_2000_MS, YEAR_2100_MS = 946684800000, 4102444800000
#: White space that a name is trimmed of.
BLANK = "[\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum((p - q) ** 2 for p, q in zip(a, b, strict=True)))


def angle_at(a: tuple[Column, ...], b: tuple[Column, ...], c: tuple[Column, ...]) -> Column:
    """The angle at b of a-b-c, in radians; null where a side has no length."""
    dot = sum((p - q) * (r - q) for p, q, r in zip(a, b, c, strict=True))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.nullif(distance(a, b) * distance(c, b), F.lit(0.0)))))


def _of_unit(unit: Column, values: dict, other) -> Column:
    out = F.lit(other)
    for name, v in values.items():
        out = F.when(unit == name, F.lit(v)).otherwise(out)
    return out


def converted(value: Column, source: Column, target: Column, power: int = 1) -> Column:
    """A length (power 1) or area (2) in another unit; unknown and null units are raw, which counts as millimetres."""
    known = lambda unit: _of_unit(unit, MILLIMETRES, MILLIMETRES["raw"])
    factor = known(source) / known(target)
    scaled = value * known(source) / known(target) if power == 1 else value * factor * factor
    return F.when(source.eqNullSafe(target), value).otherwise(scaled)


def fixed(value: Column, decimals: int) -> Column:
    """The value with so many decimals: the nearest to its exact binary value, of two the one away from zero."""
    pattern = "0." + "0" * decimals if decimals else "0"
    doubled = value * float(2 ** (decimals + 1))
    halfway = (doubled == F.rint(doubled)) & (F.abs(doubled) < 2.0**53) & (F.pmod(doubled, F.lit(2.0)) == 1)
    return F.when(halfway, F.format_string(f"%.{decimals}f", value)).otherwise(F.call_function("format_number", value, F.lit(pattern)))


def with_symbol(value: Column, unit: Column, power: int = 1) -> Column:
    """The value with its unit's decimals and symbol, squared for an area (power 2)."""
    text = fixed(value, DECIMALS["raw"])
    for name, d in DECIMALS.items():
        text = F.when(unit == name, fixed(value, d)).otherwise(text)
    symbol = _of_unit(unit, SYMBOLS, "")
    return F.when(symbol == "", text).otherwise(F.concat(text, F.lit(" "), symbol, F.lit("²" if power == 2 else "")))


def effective_unit(display: Column, mesh_unit: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(display, F.lit("auto")), mesh_unit, default, F.lit("mm"))


def edge_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def colour(name: str, t: Column) -> Column:
    """red, green, blue (0 to 1) of a map at t, linear between its stops, clamped."""
    stops = COLOUR_STOPS.get(name, COLOUR_STOPS["blueRed"])
    last = len(stops) - 1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    i = F.least(F.floor(t * last), F.lit(last - 1)).cast("int")
    f = t * last - i

    def channel(k: int) -> Column:
        at = F.array(*(F.lit(s[k]) for s in stops))
        return F.get(at, i) + (F.get(at, i + 1) - F.get(at, i)) * f

    return F.struct(channel(0).alias("red"), channel(1).alias("green"), channel(2).alias("blue"))


def hex_colour(rgb: Column) -> Column:
    """#rrggbb of red, green, blue in 0 to 1."""
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(F.floor(rgb[c] * 255 + 0.5)), 2, "0") for c in ("red", "green", "blue"))))


def hue(t: Column) -> Column:
    return (1 - t) * 0.667


def score_label(v: Column) -> Column:
    """1 where the score is over one half."""
    return F.when(v > 0.5, 1).otherwise(0)


def typed_value(text: Column) -> Column:
    """A metadata text as (kind, boolean, number, text): booleans and numbers where it reads as one; blank stays text; null is true."""
    blank = F.trim(text) == ""
    as_number = F.when(~blank & text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))
    flag = F.when(text.isNull() | (text == "true"), True).when(text == "false", False)
    kind = F.when(flag.isNotNull(), "boolean").when(as_number.isNotNull(), "number").otherwise("string")
    return F.struct(kind.alias("kind"), flag.alias("flag"), as_number.alias("number"), text.alias("text"))


def parsed_value(text: Column) -> Column:
    """A typed-in text as a variant: a bracketed JSON object or array, true or false, a number, else the text.

    Numbers may have white space around them, be hexadecimal, octal or binary; white
    space alone is zero and an empty text stays text.
    """
    bracketed = (text.startswith("{") & text.endswith("}")) | (text.startswith("[") & text.endswith("]"))
    bare = F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")
    # 16, 8 and 2 as bases; conv() takes digits of any of them
    based = [F.when(bare.rlike(f"^0[{c}{c.upper()}][{digits}]+$"), F.conv(F.substring(bare, 3, 1_000_000), base, 10).cast("double")) for c, digits, base in (("x", "0-9A-Fa-f", 16), ("o", "0-7", 8), ("b", "01", 2))]
    plain = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double")).when(bare.rlike(r"^[+-]?Infinity$"), bare.try_cast("double"))
    number = F.when((text != "") & (bare == ""), F.lit(0.0)).otherwise(F.coalesce(plain, *based))
    return F.coalesce(
        F.when(bracketed, F.try_parse_json(text)),
        F.when(text.isin("true", "false"), F.try_parse_json(text)),
        number.cast("variant"),
        text.cast("variant"),
    )


def is_time(key: Column, value: Column) -> Column:
    """A number of milliseconds between 2000 and 2100 under a known key."""
    return key.isin(*TIME_KEYS) & value.between(YEAR_2000_MS, YEAR_2100_MS)


def shows_time(key: Column, value: Column) -> Column:
    """is_time(), or such a number under a key that hints at a time."""
    hint = F.lit(False)
    for part in TIME_HINTS:
        hint = hint | F.contains(F.lower(key), F.lit(part))
    return (key.isin(*TIME_KEYS) | hint) & value.between(YEAR_2000_MS, YEAR_2100_MS)


def clean_name(text: Column, most: int = 200) -> Column:
    """The text trimmed of white space, then without control characters, then cut (at characters); null is empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANK}|{BLANK}$", "")
    return F.substring(F.regexp_replace(bare, r"[\x00-\x1F\x7F]", ""), 1, most)


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.coalesce(text, F.lit(""))


def html_escape(text: Column) -> Column:
    """The text inside an element; quotes stay, null is empty."""
    return _replaced(text, ("&", "&amp;"), ("\u00a0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;"))


def attribute_escape(text: Column) -> Column:
    """The text inside a quoted attribute; null is empty."""
    return _replaced(text, ("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"))


def csv_escape(text: Column) -> Column:
    return F.when(text.rlike(r'[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def preview(text: Column, most: int = 80) -> Column:
    """The text, or its beginning and three dots: ``most`` characters at most (60 are used for JSON)."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
