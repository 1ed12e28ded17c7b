"""Colours as column arithmetic: parsing, Oklab, differences, contrast."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bind

#: Names that pages use.
NAMES = {"black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "gray": "#808080", "grey": "#808080", "purple": "#800080", "orange": "#ffa500", "yellow": "#ffff00", "indigo": "#4b0082", "violet": "#ee82ee"}


def parse(text: Column) -> Column:
    """r, g, b from 0 to 255 and a from 0 to 1 of a name, a hexadecimal or an rgb() colour; null for others and for clear ones."""
    names = F.from_json(F.lit(json.dumps(NAMES)), "map<string,string>")

    def of_hex(x: Column) -> Column:
        channel = lambda i: F.conv(F.substring(x, i, 2), 16, 10).cast("double")
        alpha = F.when(F.length(x) == 9, channel(8) / 255).otherwise(1.0)
        return F.struct(channel(2).alias("r"), channel(4).alias("g"), channel(6).alias("b"), alpha.alias("a"))

    def of_rgb(n: Column) -> Column:
        return F.struct(n[0].alias("r"), n[1].alias("g"), n[2].alias("b"), F.coalesce(F.get(n, F.lit(3)), F.lit(1.0)).alias("a"))

    def of(t: Column) -> Column:
        numbers = F.transform(
            F.regexp_extract_all(t, F.lit(r"([0-9.]+)(%?)"), F.lit(0)),
            lambda x: F.when(x.endswith("%"), F.regexp_replace(x, "%", "").try_cast("double") / 100).otherwise(x.try_cast("double")),
        )
        full = F.when(t.rlike("^#[0-9a-f]{3,4}$"), F.concat(F.lit("#"), F.regexp_replace(F.substring(t, 2, 4), "(.)", "$1$1"))).otherwise(t)
        hexed = bind(full, lambda x: F.when(x.rlike("^#(?:[0-9a-f]{6}|[0-9a-f]{8})$"), of_hex(x)))
        return F.when(t.rlike(r"^rgba?\([^)]*\)$"), bind(numbers, of_rgb)).otherwise(hexed)

    low = F.lower(F.trim(text))
    return bind(bind(F.coalesce(F.element_at(names, low), low), of), lambda c: F.when(c["a"] > 0, c))


def linear(channel: Column) -> Column:
    return bind(channel / 255, lambda x: F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4))))


def oklab(c: Column) -> Column:
    """L, a, b of a colour with r, g, b."""

    def of(rgb: Column) -> Column:
        r, g, b = rgb["r"], rgb["g"], rgb["b"]
        l = F.cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b)  # noqa: E741
        m = F.cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b)
        s = F.cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b)
        return bind(F.struct(l.alias("l"), m.alias("m"), s.alias("s")), lambda x: F.struct(
            (0.2104542553 * x["l"] + 0.7936177850 * x["m"] - 0.0040720468 * x["s"]).alias("L"),
            (1.9779984951 * x["l"] - 2.4285922050 * x["m"] + 0.4505937099 * x["s"]).alias("a"),
            (0.0259040371 * x["l"] + 0.7827717662 * x["m"] - 0.8086757660 * x["s"]).alias("b"),
        ))

    return bind(c, lambda c: F.when(c.isNotNull(), bind(F.struct(linear(c["r"]).alias("r"), linear(c["g"]).alias("g"), linear(c["b"]).alias("b")), of)))


def difference(x: Column, y: Column) -> Column:
    return F.sqrt(F.pow(x["L"] - y["L"], 2) + F.pow(x["a"] - y["a"], 2) + F.pow(x["b"] - y["b"], 2))


def luminance(c: Column) -> Column:
    return bind(c, lambda c: 0.2126 * linear(c["r"]) + 0.7152 * linear(c["g"]) + 0.0722 * linear(c["b"]))


def contrast(x: Column, y: Column) -> Column:
    both = F.struct(luminance(x).alias("a"), luminance(y).alias("b"))
    known = lambda p: p["a"].isNotNull() & p["b"].isNotNull()
    return bind(both, lambda p: F.when(known(p), (F.greatest(p["a"], p["b"]) + 0.05) / (F.least(p["a"], p["b"]) + 0.05)))


def chroma(lab: Column) -> Column:
    return F.sqrt(lab["a"] * lab["a"] + lab["b"] * lab["b"])


def hue(lab: Column) -> Column:
    h = F.atan2(lab["b"], lab["a"]) * (180 / math.pi)
    return F.when(h < 0, h + 360).otherwise(h)


def is_purple(c: Column) -> Column:
    """By lightness, chroma and hue in Oklab; colours that are nearly clear don't count."""
    both = F.struct(oklab(c).alias("x"), c["a"].alias("alpha"))
    return bind(both, lambda p: (p["alpha"] >= 0.25) & p["x"]["L"].between(0.35, 0.80) & (chroma(p["x"]) >= 0.1) & hue(p["x"]).between(268, 310))


def spread(c: Column) -> Column:
    return F.greatest(c["r"], c["g"], c["b"]) - F.least(c["r"], c["g"], c["b"])


def is_cream(c: Column) -> Column:
    """Light and warm: all channels at 209 or more, r >= g >= b, and 6 to 48 between red and blue."""
    return (F.least(c["r"], c["g"], c["b"]) >= 209) & (c["r"] >= c["g"]) & (c["g"] >= c["b"]) & (c["r"] - c["b"]).between(6, 48)
