"""Registered accuracy: coverage, buffer membership, draped heights."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from subgrade.functions import scalars as S
from subgrade.functions.geometry import Seg, clamp, offsets
from subgrade.operators import packed
from subgrade.operators.nearest import nearest_segment
from subgrade.tables import small_batches, written

FIELD = "noejagtighedsklasse"
#: Places of a block, which each of its tasks holds, and of a leaf of its tree.
BLOCK_POINTS, LEAF = 131_072, 16
#: Parts of a task that is aimed at, and tasks at most, if the blocks aren't more; parts from which a name's are dealt over tasks.
TASK_PARTS, MOST_TASKS, MANY_PARTS = 16_384, 192, 4096
#: Parts that go down a tree together.
MEETING = 64


def coverage(features: DataFrame, by: str = "layer") -> DataFrame:
    """By layer: whether any feature has the attribute, how many parse, how many there are."""
    return features.groupBy(by).agg(
        F.coalesce(F.max(F.map_contains_key("attrs", F.lit(FIELD))), F.lit(False)).alias("has_column"),
        F.count(S.accuracy_class(F.col("attrs")[FIELD])).alias("n_parseable"), F.count("*").alias("n_total"),
    )


def buffer_hits(points: DataFrame, segments: DataFrame) -> DataFrame:
    """pid, feature_id, distance of the points within a feature's buffer: no farther in the plane from any of its parts
    than half_width. The buffers' union is implied and not drawn. Points and segments meet in cells as wide as the
    widest class, so a point is compared with what is near it only."""
    cell = 4.0
    s = segments.filter("half_width > 0").withColumns({"x1_": F.least("x1", "x2"), "x2_": F.greatest("x1", "x2"), "y1_": F.least("y1", "y2"), "y2_": F.greatest("y1", "y2")})
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - F.col("half_width")) / cell), F.floor((F.col(b) + F.col("half_width")) / cell)))
    s = s.withColumn("cx", span("x1_", "x2_")).withColumn("cy", span("y1_", "y2_")).withColumn("hw", F.lit(0.0)).withColumnsRenamed({"z1": "sz1", "z2": "sz2"}).withColumns({"z1": F.lit(0.0), "z2": F.lit(0.0)})
    p = points.select("pid", F.col("x"), F.col("y"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    xy2, _ = offsets(Seg.of(F.col), F.col("x"), F.col("y"), F.lit(0.0))
    near = p.join(s, ["cx", "cy"]).withColumn("d2", xy2).filter(F.sqrt("d2") <= F.col("half_width"))
    return near.groupBy("pid", "feature_id").agg(F.sqrt(F.min("d2")).alias("distance"))


def buffer_counts(points: DataFrame, segments: DataFrame, by: str = "feature_id", nearest: bool = True) -> DataFrame:
    """by, n_points, nearest: how many points lie in the united buffers of each `by`, and the least distance of these to its
    parts (null if not asked for); values whose buffers hold no point have no row.

    Points at the same place are one place with their number. Places lie in blocks along a curve, each a tree of boxes, and a
    block is dealt as often as the parts want tasks, so that a part travels once to each block that it meets. A task holds its
    block and streams its parts by `by`: a box that lies wholly in a buffer is counted as it is, only boxes at its rim are
    opened. A `by` of many parts is many tasks' work, of which each tells the places that it hit as bits.
    """
    kinds = dict(segments.dtypes)
    known = lambda *names: reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in names])
    places = written(points.filter(known("x", "y")).groupBy("x", "y").agg(F.count("*").alias("n")), "buffer-places")
    ends = ("x1", "y1", "x2", "y2")
    parts = written(segments.filter("half_width > 0").filter(known(*ends)).select(F.col(by).alias("name"), *ends, "half_width"), "buffer-parts")
    flat = places.select(F.col("n").alias("pid"), "x", "y", F.lit(0.0).alias("z"), F.lit("").alias("g"))
    frame = packed.Frame.around(flat, parts.select("x1", "y1", F.lit(0.0).alias("z1"), "x2", "y2", F.lit(0.0).alias("z2")))
    slack = frame.extent * packed.SLACK
    with small_batches(points.sparkSession, 10_000):
        blocks = written(packed.point_blocks(flat, frame, BLOCK_POINTS).withColumnRenamed("pids", "numbers"), "buffer-blocks")
        # a row for each BLOCK_POINTS places
        boxes = blocks.select("block", *[F.col(f"p{c}_{e}") + frame.centre[c] for c in "xy" for e in ("lo", "hi")]).collect()
        share = max(1, -(-min(MOST_TASKS, -(-frame.n_segs // TASK_PARTS)) // max(1, len(boxes))))
        tasks = max(1, len(boxes) * share)
        at = points.sparkSession.createDataFrame([(i, *map(float, b[1:])) for i, b in enumerate(boxes)], "nth int, x_lo double, x_hi double, y_lo double, y_hi double")
        number = points.sparkSession.createDataFrame([(b[0], i) for i, b in enumerate(boxes)], "block long, nth int")
        many = parts.groupBy("name").agg(F.count("*").alias("of")).filter(F.col("of") > MANY_PARTS).select(F.col("name").alias("many"))
        sized = parts.join(many, F.col("name").eqNullSafe(F.col("many")), "left") if share > 1 else parts.withColumn("many", F.lit(None).cast(kinds[by]))
        # a null name is dealt whole, with the others of its kind
        spread = F.col("many").isNotNull()
        low, high = ({c: f(f"{c}1", f"{c}2") for c in "xy"} for f in (F.least, F.greatest))
        wide = F.col("half_width") + slack
        meets = [(low[c] - wide <= F.col(f"{c}_hi")) & (high[c] + wide >= F.col(f"{c}_lo")) for c in "xy"]
        salt = F.when(spread, F.pmod(F.xxhash64(*ends), F.lit(share))).otherwise(F.pmod(F.xxhash64("name"), F.lit(share)))
        content = sized.join(F.broadcast(at), meets[0] & meets[1]).select((F.col("nth") * share + salt).cast("int").alias("task"), "nth", F.lit(1).alias("turn"), "name", spread.alias("spread"), *ends, "half_width")
        empty = {"name": kinds[by], "spread": "boolean", **dict.fromkeys((*ends, "half_width"), "double")}
        own = blocks.join(F.broadcast(number), "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(share - 1))))
        own = own.select((F.col("nth") * share + F.col("salt")).cast("int").alias("task"), "nth", F.lit(0).alias("turn"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], "xyz", "numbers")
        content = content.withColumns({"xyz": F.lit(None).cast("binary"), "numbers": F.lit(None).cast("array<long>")})
        dealt = own.unionByName(content).repartitionById(tasks, "task").sortWithinPartitions("task", "turn", "name")
        partial = written(dealt.mapInArrow(_hit_counter(slack, nearest), f"nth int, name {kinds[by]}, n long, nearest double, bits binary"), "buffer-counts")
        bits = partial.filter("bits IS NOT NULL").groupBy("nth", "name").agg(F.collect_list("bits").alias("bits"), F.min("nearest").alias("nearest"))
        united = bits.join(number, "nth").join(blocks.select("block", "numbers"), "block").select("name", "nearest", "bits", "numbers")
        united = united.mapInArrow(_united, f"name {kinds[by]}, n long, nearest double")
    told = partial.filter("bits IS NULL").select("name", "n", "nearest").unionByName(united)
    return told.groupBy(F.col("name").alias(by)).agg(F.sum("n").alias("n_points"), F.min("nearest").alias("nearest"))


class _Places:
    """A block's places in order of the curve, in leaves of LEAF, and these in boxes of LEAF."""

    def __init__(self, xyz: np.ndarray, numbers: np.ndarray, slack: float):
        self.n, self.slack = len(numbers), slack
        # the last leaf and box are filled with the last place, which counts once
        fill = -self.n % LEAF**2
        self.x, self.y = (np.pad(v, (0, fill), mode="edge") for v in xyz[:2])
        self.numbers = np.pad(numbers, (0, fill))
        self.levels = []
        for size in (LEAF**2, LEAF):
            x, y = self.x.reshape(-1, size), self.y.reshape(-1, size)
            lx, hx, ly, hy = x.min(axis=1), x.max(axis=1), y.min(axis=1), y.max(axis=1)
            self.levels.append(((lx + hx) / 2, (ly + hy) / 2, np.sqrt((hx - lx) ** 2 + (hy - ly) ** 2) / 2))


class _Hits:
    """The places that some parts' buffers hold, and the least distance of these to the parts."""

    def __init__(self, places: _Places, nearest: bool):
        self.places, self.wanted = places, nearest
        self.hit = np.zeros((len(places.x) // LEAF, LEAF), dtype=bool)
        # what the nearest can't exceed, and the least distance told
        self.nearest = self.exact = np.inf

    def meet(self, parts: tuple[np.ndarray, ...]) -> None:
        x1, y1, x2, y2, w = parts
        full = self.hit.all(axis=1)
        which = np.flatnonzero(~full.reshape(-1, LEAF).all(axis=1)) if not self.wanted else np.arange(len(full) // LEAF)
        for level, (cx, cy, r) in enumerate(self.places.levels):
            if not len(which):
                return
            d = _distances(cx[which, None], cy[which, None], x1, y1, x2, y2)
            around = r[which, None] + self.places.slack
            near = d - around
            reach = near <= w
            inside = d + around <= w
            held = inside.any(axis=1)
            if held.any():
                if self.wanted:
                    self.nearest = min(self.nearest, float((d + around)[inside].min()))
                self.hit.reshape(len(self.places.levels[level][0]), -1)[which[held]] = True
            left = ~(full.reshape(-1, LEAF).all(axis=1) if not level else full)[which] & ~held
            open_ = reach & left[:, None]
            if self.wanted:
                open_ |= reach & (near <= self.nearest)
            if level:
                break
            kept = np.flatnonzero(open_.any(axis=1))
            which = (which[kept, None] * LEAF + np.arange(LEAF)).ravel()
        leaf, part = np.nonzero(open_)
        x, y = self.places.x.reshape(-1, LEAF), self.places.y.reshape(-1, LEAF)
        # so few at a time that what is made meanwhile stays in the cache
        for begin in range(0, len(leaf), 4096):
            i, j = which[leaf[begin : begin + 4096]], part[begin : begin + 4096]
            d = _distances(x[i], y[i], *(v[j, None] for v in (x1, y1, x2, y2)))
            ok = d <= w[j, None]
            row, column = np.nonzero(ok)
            if len(row):
                self.hit[i[row], column] = True
                if self.wanted:
                    self.exact = min(self.exact, float(d[row, column].min()))


def _distances(x: np.ndarray, y: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = ((x - x1) * dx + (y - y1) * dy) / np.where(length2 > 1e-12, length2, np.inf)
    t = np.minimum(np.maximum(t, 0.0), 1.0)
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return np.sqrt(ex * ex + ey * ey)


def _hit_counter(slack: float, nearest: bool):
    """Of each block and name the number of points within a part's half width, or the places as bits, and their least distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = hits = nth = name = spread = None
        out: list[tuple] = []
        kind: pa.DataType | None = None

        def flush() -> None:
            nonlocal hits
            if hits is not None and hits.hit.any():
                hit = hits.hit.ravel()[: places.n]
                least = float(hits.exact) if nearest else None
                out.append((nth, name, None, least, np.packbits(hit).tobytes()) if spread else (nth, name, int(places.numbers[: places.n] @ hit), least, None))
            hits = None

        def emit() -> pa.RecordBatch:
            types = (pa.int32(), kind, pa.int64(), pa.float64(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["nth", "name", "n", "nearest", "bits"])
            out.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field("name").type
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            turn = column["turn"].to_numpy()
            codes = column["name"].dictionary_encode()
            values = codes.dictionary.to_pylist()
            code = codes.indices.fill_null(-1).to_numpy()
            ends = [column[c].fill_null(0.0).to_numpy() for c in ("x1", "y1", "x2", "y2", "half_width")]
            starts = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (turn[1:] == 0) | (turn[:-1] == 0)]) if len(turn) else []
            for begin, end in zip(starts, [*starts[1:], len(turn)]):
                if not turn[begin]:
                    flush()
                    nth = column["nth"][begin].as_py()
                    places = _Places(np.frombuffer(column["xyz"][begin].as_py()).reshape(3, -1), column["numbers"][begin].values.to_numpy(), slack)
                    continue
                value = values[code[begin]] if code[begin] >= 0 else None
                if hits is None or value != name:
                    flush()
                    name, spread, hits = value, column["spread"][begin].as_py(), _Hits(places, nearest)
                for k in range(begin, end, MEETING):
                    hits.meet(tuple(v[k : min(k + MEETING, end)] for v in ends))
            if len(out) >= 1000:
                yield emit()
        flush()
        if out:
            yield emit()

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many points the places have that any of a row's bits tell."""
    for batch in batches:
        name, nearest, bits, numbers = (batch.column(i) for i in range(4))
        n = []
        for told, each in zip(bits, numbers):
            each = each.values.to_numpy()
            every = reduce(np.bitwise_or, [np.frombuffer(b, np.uint8) for b in told.as_py()])
            n.append(int(each @ np.unpackbits(every, count=len(each))))
        yield pa.RecordBatch.from_arrays([name, pa.array(n, pa.int64()), nearest], names=["name", "n", "nearest"])


def drape(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """queries (pid, x, y, ...) with draped_z, the height of the nearest point in the plane of any segment (seg_id), the smaller
    seg_id on ties; 0 where there are none."""
    flat = segments.withColumns({"z1": F.lit(0.0), "z2": F.lit(0.0), "hw": F.lit(0.0)})
    # a place is searched for once, however many queries lie there
    places = written(queries.select("x", "y").distinct().withColumn("place", F.monotonically_increasing_id()), "draped-places")
    found = nearest_segment(places.select(F.col("place").alias("pid"), "x", "y", F.lit(0.0).alias("z")), flat).select(F.col("pid").alias("place"), "seg_id")
    lines = segments.select("seg_id", *[F.col(f"{c}{i}").alias(f"s{c}{i}") for i in (1, 2) for c in "xyz"])
    dx, dy = F.col("sx2") - F.col("sx1"), F.col("sy2") - F.col("sy1")
    length2 = dx * dx + dy * dy
    t = clamp(((F.col("x") - F.col("sx1")) * dx + (F.col("y") - F.col("sy1")) * dy) / F.when(length2 > 1e-12, length2), F.lit(0.0), F.lit(1.0))
    height = F.col("sz1") + F.when(length2 > 1e-12, t).otherwise(F.lit(0.0)) * (F.col("sz2") - F.col("sz1"))
    heights = places.join(found, "place").join(lines, "seg_id").select("x", "y", height.alias("draped_z"))
    joined = queries.join(heights, ["x", "y"], "left")
    return joined.select(*queries.columns, F.coalesce("draped_z", F.lit(0.0)).alias("draped_z"))


def hits_by_name(points: DataFrame, segments: DataFrame, clip: Column) -> DataFrame:
    """By storage_key: the points within the united buffers of its features, as far as these lie in the clip, which holds a
    point or doesn't. A name whose buffers hold no point has 0."""
    names = segments.filter("half_width > 0").select("storage_key").distinct()
    counted = buffer_counts(points.filter(clip), segments, "storage_key", nearest=False).select("storage_key", "n_points")
    return names.join(counted, "storage_key", "left").select("storage_key", F.coalesce("n_points", F.lit(0)).alias("n_points"))


def in_view(features: DataFrame, seen: DataFrame) -> DataFrame:
    """By storage_key: features with a part in view (seen: feature_id), and those of them with a registered accuracy."""
    registered = S.accuracy_class(F.col("attrs")[FIELD]).isNotNull()
    rows = features.join(seen.select("feature_id").distinct(), "feature_id", "left_semi")
    return rows.groupBy("storage_key").agg(F.count_if(registered).alias("n_registered"), F.count("*").alias("n_in_view"))
