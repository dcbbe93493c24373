"""GML read once for all layers, rings kept.

The file is a text scan whose lines end with a member's end tag, so it is split like any text, and each row is one member.
A member is parsed by itself; layers that are not asked for are told by their tag and not parsed. Layers that a file lacks
give no rows.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subgrade.sources.stores import store_of

SCHEMA = """layer string, feature_id string, geom_type string, parts array<array<struct<x:double,y:double,z:double>>>, roles array<string>,
            polygons array<int>, attrs map<string,string>, place long"""
# The format's elements.
MEMBERS = ("featureMember", "member")
GEOMETRIES = ("Point", "MultiPoint", "LineString", "Curve", "MultiLineString", "MultiCurve", "Polygon", "Surface", "MultiPolygon", "MultiSurface", "CompositeCurve", "MultiGeometry")
# End of the fixed values.
_PREFIX = re.compile(r"(</?|\s)[A-Za-z_][\w.-]*:(?=[A-Za-z_])")
_FIRST_TAG = re.compile(r"<(?![?!/])([^\s/>]+)")
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
_ARROW = pa.schema([
    ("layer", pa.string()), ("feature_id", pa.string()), ("geom_type", pa.string()), ("parts", pa.list_(pa.list_(_POINT))), ("roles", pa.list_(pa.string())),
    ("polygons", pa.list_(pa.int32())), ("attrs", pa.map_(pa.string(), pa.string())), ("place", pa.int64()),
])


def member_end(path: str) -> str:
    """The end tag of a file's members, from its first tags: of a member element, or else of the root's first child."""
    store, at = store_of(path)
    with store.open_input_stream(at) as f:
        tags = [t for t in _FIRST_TAG.findall(f.read(1 << 20).decode("utf-8", "replace"))]
    found = next((t for t in tags if t.rpartition(":")[2] in MEMBERS), tags[1] if len(tags) > 1 else "featureMember")
    return f"</{found}>"


def _numbers(text: str | None, size: int) -> list[dict]:
    n = [float(v) for v in (text or "").split()]
    return [{"x": n[i], "y": n[i + 1], "z": n[i + 2] if size == 3 else 0.0} for i in range(0, len(n) - size + 1, size)]


def _rings(element: ET.Element, size: int, role: str, polygon: int | None, out: list[tuple]) -> None:
    """The parts below a geometry element in order: vertices, role, number of the polygon."""
    size = int(element.get("srsDimension", size))
    name = element.tag
    if name in ("Polygon", "PolygonPatch"):
        polygon = max((p for _, _, p in out if p is not None), default=-1) + 1
    role = {"exterior": "exterior", "outerBoundaryIs": "exterior", "interior": "interior", "innerBoundaryIs": "interior", "Point": "point"}.get(name, role)
    own = [c for c in element if c.tag in ("pos", "posList", "coordinates")]
    if own:
        vertices = [v for c in own for v in _numbers((c.text or "").replace(",", " "), int(c.get("srsDimension", size)))]
        out.append((vertices, role, polygon))
    for child in element:
        if child.tag not in ("pos", "posList", "coordinates"):
            _rings(child, size, role, polygon, out)


def parse_member(text: str, layers: set[str], geometry: str) -> tuple | None:
    """A feature of a member's markup without its end tag: layer, id, type, parts, roles, polygons, attributes. None if its
    layer is not asked for; markup that is cut or broken raises."""
    tags = list(_FIRST_TAG.finditer(text))
    at = next((i for i in range(len(tags) - 1, -1, -1) if tags[i][1].rpartition(":")[2] in layers), None)
    if at is None:
        return None
    # the outermost element of a layer's name
    at = next(i for i in range(len(tags)) if tags[i][1].rpartition(":")[2] in layers)
    feature = ET.fromstring(_PREFIX.sub(r"\1", text[tags[at].start() :].rstrip()))
    parts: list[tuple] = []
    kind, attrs = None, {}
    for child in feature:
        if child.tag == geometry or (child.tag != geometry and any(c.tag in GEOMETRIES for c in child)):
            if child.tag == geometry:
                shape = next((c for c in child if c.tag in GEOMETRIES), None)
                if shape is not None:
                    kind = shape.tag
                    _rings(shape, int(child.get("srsDimension", 3)), "line", None, parts)
            continue
        value = "".join(child.itertext()).strip()
        if value:
            attrs[child.tag] = value
    id_ = feature.get("id") or feature.get("fid") or attrs.get("id")
    return feature.tag, id_, kind, [p for p, _, _ in parts] if kind else None, [r for _, r, _ in parts] if kind else None, [p for _, _, p in parts] if kind else None, attrs


def read_features(spark: SparkSession, path: str, layers: list[str] | tuple[str, ...], geometry: str = "geometri", end: str | None = None) -> DataFrame:
    """The features of all layers, from one scan: FEATURE_SCHEMA and, beside each part, its role (point, line, exterior,
    interior) and the number of its polygon; place tells the order in the file. A feature without geometry has no parts;
    one without an id has its layer and place; a height that is not given is 0. end: the members' end tag, else found in the
    file, which path then names."""
    end = end or member_end(path)
    wanted = set(layers)
    rows = spark.read.option("lineSep", end).text(path).select("value", F.monotonically_increasing_id().alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = parse_member(text, wanted, geometry)
                if got:
                    layer, id_, kind, parts, roles, polygons, attrs = got
                    found.append((layer, id_ or f"{layer}.{place}", kind, parts, roles, polygons, list(attrs.items()), place))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _ARROW)], schema=_ARROW)

    return rows.mapInArrow(run, SCHEMA)


def dig_polygon(features: DataFrame, layer: str = "Graveforesp") -> list[tuple[float, float]]:
    """The exterior ring of the layer's first feature in the file, as plain corners; LookupError where there is none."""
    rings = features.filter((F.col("layer") == layer) & F.col("parts").isNotNull())
    first = rings.agg(F.min_by(F.struct("parts", "roles"), "place").alias("f")).first()["f"]
    ring = next((p for p, r in zip(first["parts"], first["roles"]) if r == "exterior"), None) if first else None
    if not ring:
        raise LookupError(f"no polygon in layer {layer!r}")
    return [(v["x"], v["y"]) for v in ring]


def member_lines(features: DataFrame, geometry: str = "geometri") -> DataFrame:
    """value: each feature as a line of markup, a gml:featureMember; polygons with their rings, else lines and points."""
    text = lambda v: F.concat_ws(" ", F.transform(v, lambda p: F.concat_ws(" ", p["x"], p["y"], p["z"])))
    zipped = F.arrays_zip("parts", "roles", "polygons")
    ring = lambda p: F.concat(F.lit("<gml:"), p["roles"], F.lit("><gml:LinearRing><gml:posList>"), text(p["parts"]), F.lit("</gml:posList></gml:LinearRing></gml:"), p["roles"], F.lit(">"))
    of = lambda i: F.concat(F.lit("<gml:surfaceMember><gml:Polygon>"), F.array_join(F.transform(F.filter(zipped, lambda p: p["polygons"] == i), ring), ""), F.lit("</gml:Polygon></gml:surfaceMember>"))
    surface = F.concat(F.lit("<gml:MultiSurface srsDimension=\"3\">"), F.array_join(F.transform(F.array_distinct("polygons"), of), ""), F.lit("</gml:MultiSurface>"))
    line = F.concat(F.lit("<gml:LineString srsDimension=\"3\"><gml:posList>"), text(F.col("parts")[0]), F.lit("</gml:posList></gml:LineString>"))
    point = F.concat(F.lit("<gml:Point srsDimension=\"3\"><gml:pos>"), text(F.col("parts")[0]), F.lit("</gml:pos></gml:Point>"))
    shape = F.when(F.array_contains("roles", "exterior"), surface).when(F.array_contains("roles", "point"), point).otherwise(line)
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit("<ler:"), e["key"], F.lit(">"), _escaped(e["value"]), F.lit("</ler:"), e["key"], F.lit(">"))), "")
    body = [F.lit('<gml:featureMember><ler:'), F.col("layer"), F.lit(' gml:id="'), _escaped(F.col("feature_id")), F.lit('">'), attrs]
    body += [F.concat(F.lit(f"<ler:{geometry}>"), shape, F.lit(f"</ler:{geometry}>")), F.lit("</ler:"), F.col("layer"), F.lit("></gml:featureMember>")]
    return features.select(F.concat(*body).alias("value"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
