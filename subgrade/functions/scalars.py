"""Scalar functions, as expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from subgrade.functions.dims import CLASS_BOUNDS, DEVIATION_COLOURS, OPEN_CLASS_WIDTH, SUPPLY_COLOURS, SUPPLY_TO_LINE, TRACE_LAYER, UTILITY_TYPES


def chain(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    first, *rest = cases
    out = reduce(lambda acc, c: acc.when(c[0], c[1]), rest, F.when(*first))
    return out.otherwise(otherwise)


def given(text: Column) -> Column:
    """Text, or null where it is null, blank or 'nan'."""
    t = F.trim(text)
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def shown(text: Column) -> Column:
    return F.coalesce(F.when(F.lower(text) != "nan", text), F.lit("—"))


def number(text: Column) -> Column:
    return given(text).try_cast("double")


def accuracy_class(text: Column) -> Column:
    """struct(half_width, class) of a registered accuracy such as '<= 0,50 m': the nearest bound, the lower on ties; null
    where there is no number. Only '>' with at least the last bound is the open class."""
    found = F.regexp_extract(given(text), r"(\d+(?:[.,]\d+)?)", 1)
    n = F.when(found != "", F.replace(found, F.lit(","), F.lit(".")).cast("double"))
    halves = [(a + b) / 2 for a, b in zip(CLASS_BOUNDS, CLASS_BOUNDS[1:])]
    nearest = chain([(n <= h, F.lit(i + 1)) for i, h in enumerate(halves)], F.lit(len(CLASS_BOUNDS)))
    opened = text.contains(">") & (n >= CLASS_BOUNDS[-1] - 1e-9)
    cls = F.when(opened, F.lit(len(CLASS_BOUNDS) + 1)).otherwise(nearest)
    width = chain([(cls == i + 1, F.lit(b)) for i, b in enumerate(CLASS_BOUNDS)], F.lit(OPEN_CLASS_WIDTH))
    return F.when(n.isNotNull(), F.struct(width.alias("half_width"), cls.cast("int").alias("class")))


def deviation_class(d: Column) -> Column:
    """1 to 5 by upper bounds that belong to the better class; 0 for NaN."""
    return F.when(F.isnan(d), 0).otherwise(chain([(d <= b, F.lit(i + 1)) for i, b in enumerate(CLASS_BOUNDS)], F.lit(5))).cast("int")


def _rgb(r: object, g: object, b: object) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).alias(n) for n, x in zip("rgb", (r, g, b))])


def deviation_colour(d: Column) -> Column:
    """The class's colour; NaN has the colour of class 5."""
    return chain([(~F.isnan(d) & (d <= b), _rgb(*DEVIATION_COLOURS[i])) for i, b in enumerate(CLASS_BOUNDS)], _rgb(*DEVIATION_COLOURS[4]))


def deviation_gradient(d: Column) -> Column:
    """Colours in between linearly from 0 to 2 m; the last above; black for NaN and below 0."""
    edges = (0.0, *CLASS_BOUNDS)
    cases = [(F.isnan(d) | (d < 0), _rgb(0, 0, 0)), (d >= edges[-1], _rgb(*DEVIATION_COLOURS[4]))]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        t = (d - lo) / (hi - lo)
        mixed = [F.lit(a) + t * (b - a) for a, b in zip(DEVIATION_COLOURS[i], DEVIATION_COLOURS[i + 1])]
        cases.append(((d >= lo) & (d < hi), _rgb(*mixed)))
    return chain(cases)


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def supply_colour(value: Column, fallback: Column) -> Column:
    v = F.lower(value)
    return F.coalesce(chain([(v.contains(k), _rgb(*c)) for k, c in SUPPLY_COLOURS]), fallback)


def supply_line(value: Column) -> Column:
    """The line layer of a supply value, by exact match in lower case."""
    v = F.lower(value)
    return chain([(v == k, F.lit(layer)) for k, layer in SUPPLY_TO_LINE.items()])


def storage_key(layer: Column, supply: Column) -> Column:
    """'Ledningstrace (supply)' for traces that name a supply, else the layer."""
    return F.when((layer == TRACE_LAYER) & given(supply).isNotNull(), F.concat(layer, F.lit(" ("), F.trim(supply), F.lit(")"))).otherwise(layer)


def width_metres(text: Column) -> Column:
    """Millimetres as text to metres; null where there is no positive number."""
    n = number(text)
    return F.when(n > 0, n / 1000)


def is_active(status: Column) -> Column:
    """False for 'ude af drift' in any case; a null status is active."""
    return F.coalesce(~F.lower(F.trim(status)).contains("ude af drift"), F.lit(True))


def type_of_file(name: Column) -> Column:
    """The utility type in '..._type_<id or name>.ply', 0 where there is none."""
    tag = F.regexp_extract(name, r"_type_(\w+)\.ply$", 1)
    named = chain([(tag == n, F.lit(i)) for i, n in UTILITY_TYPES.items()])
    return F.coalesce(F.when(tag.rlike(r"^\d+$"), tag.try_cast("int")), named, F.lit(0)).cast("int")


def base_name(stem: Column) -> Column:
    return F.regexp_replace(stem, r"^Area_\d+_", "")


def area_number(parent: Column, name: Column) -> Column:
    """From the folder's name first, then the file's."""
    pattern = r"(?i)Area[_\s]*(\d+)"
    of = lambda c: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return F.coalesce(of(parent), of(name)).cast("int")


def package_label(folder: Column) -> Column:
    """'Ledningspakke <number>' of a package's folder."""
    n = F.regexp_extract(folder, r"(?i)(Ledningspakke)[_\s]*(\d+)", 2)
    return F.when(n != "", F.concat(F.lit("Ledningspakke "), n))


def las_intensity(metres: Column) -> Column:
    """Millimetres, half to even, within 0 to 65535."""
    return F.least(F.greatest(F.rint(metres * 1000), F.lit(0.0)), F.lit(65535.0)).cast("int")


def table_byte(share: Column) -> Column:
    """A colour share as a byte, half to even, from linear light."""
    return F.rint(linear_to_srgb(share) * 255).cast("int")


def label_byte(share: Column) -> Column:
    """A colour share as a byte, cut off."""
    return F.floor(share * 255).cast("int")
