"""The nearest segment: points in blocks along a space-filling curve, and the segments that each block needs.

A bounded sample of the segments gives each point a distance that its nearest segment can't exceed. Boxes of neighbouring
points with that distance, 16,384 at most, form a tree; a segment goes down it and travels to the blocks of which a box lies
near enough, and then only if it meets the box around what is within reach of that box's points: each point's own distance
tells that, so that far points, whose box is wide beside what they lack of their nearest segment, need few segments. A block's task holds its points, streams its segments in runs, and goes down the block's own tree with them: a
node keeps the segments that can be as near to one of its points as what is known. What is left is compared in the
arithmetic of geometry.offsets. The distance to a segment changes no faster than the point moves, so a node's centre tells;
that of ribbons, which ignores what lies beyond their ends, somewhat faster (see _Lines.stretch).

Points travel once, segments a few times; the blocks, the boxes and the sample are bounded in number, whatever the input.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from subgrade.tables import small_batches, written

#: Blocks of points that are aimed at, and the least and most points of one.
BLOCKS, POINTS, MOST_POINTS = 256, 256, 262_144
#: Boxes of neighbouring points that all tasks get, and segments of the sample, at most.
BOXES, BEAM = 16_384, 16_384
#: Segments of a run; bits of a place among a node's nodes; rows of a task that packs.
PIECES, FAN, PACKED = 262_144, 3, 65_536
#: Points and segments that are compared in the arithmetic of geometry.offsets together, about.
PAIRS = 2**20
#: Segments that go down the tree of boxes together.
DEALT = 100_000
#: Segments in a row of those that travel together, at most.
ROW = 8_192
#: What bounds give way for rounding, relative to the extent.
SLACK = 1e-9
BOX = tuple(f"p{c}_{e}" for c in "xyz" for e in ("lo", "hi"))
AROUND = tuple(f"r{c}_{e}" for c in "xyz" for e in ("lo", "hi"))
ENDS = ("x1", "y1", "z1", "x2", "y2", "z2", "hw")


@dataclass
class Frame:
    """The box around all coordinates; bounds are relative to its centre."""

    centre: dict[str, float]
    extent: float
    n_points: int
    n_segs: int

    @classmethod
    def around(cls, points: DataFrame, segs: DataFrame) -> "Frame":
        def box(df: DataFrame, names: list[list[str]]):
            ends = [f(*[g(n) for n in ns]) for ns in names for f, g in ((F.least, F.min), (F.greatest, F.max))] if len(names[0]) > 1 else [g(ns[0]) for ns in names for g in (F.min, F.max)]
            return df.agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)], F.count("*").alias("n")).first()

        a, b = box(points, [[c] for c in "xyz"]), box(segs, [[f"{c}1", f"{c}2"] for c in "xyz"])
        low = [min((v for v in (a[2 * i], b[2 * i]) if v is not None), default=0.0) for i in range(3)]
        high = [max((v for v in (a[2 * i + 1], b[2 * i + 1]) if v is not None), default=0.0) for i in range(3)]
        extent = max(max(h - n for n, h in zip(low, high)), 1e-6)
        return cls({c: (n + h) / 2 for c, n, h in zip("xyz", low, high)}, extent, a["n"], b["n"])

    def relative(self, c: str, v: Column) -> Column:
        return v - self.centre[c]

    def curve(self, *at: tuple[Column, float]) -> Column:
        """The Morton code of three coordinates, each with the width of the range around 0 that it lies in."""
        out = None
        for i, (v, width) in enumerate(at):
            n = F.least(F.greatest(F.floor((v / width + 0.5) * 2**16), F.lit(0)), F.lit(2**16 - 1)).cast("long")
            for shift, mask in ((16, 0xFF0000FF), (8, 0xF00F00F00F), (4, 0xC30C30C30C3), (2, 0x249249249249)):
                n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
            n = F.shiftleft(n, i)
            out = n if out is None else out.bitwiseOR(n)
        return out


def _floats(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, dtype=np.float64).tobytes()


def _of(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(rows, -1)


def _packed(df: DataFrame, keys: list[str], order: str, most: int, rows: int, make, schema: str) -> DataFrame:
    """df in order of keys and curve, cut into blocks of at most `most` rows of equal keys; make(table, key values) gives a
    block's columns after block, part, nth and the keys."""
    dealt = df.repartitionByRange(max(1, -(-rows // max(PACKED, most))), *keys, order).sortWithinPartitions(*keys, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        nth, held, out = 0, None, []
        names = [c.split()[0] for c in schema.split(", ")]

        def blocks(table: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            nonlocal nth
            values = list(zip(*(table[k].to_pylist() for k in keys)))
            found, start = [], 0
            for key, run_ in itertools.groupby(values):
                end = start + sum(1 for _ in run_)
                while end - start >= most or (end > start and (last or end < len(values))):
                    size = min(most, end - start)
                    found.append((part << 40 | nth, part, nth, *key, *make(table.slice(start, size))))
                    nth, start = nth + 1, start + size
            # what is held is joined anew, so that it doesn't keep the batches it came with
            return found, table.slice(start).combine_chunks() if start < len(values) else None

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c[0], pa.Array) else _lists(c) for c in zip(*out)], names=names)
            out.clear()
            return batch

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            found, held = blocks(table, False)
            out += found
            if len(out) * most >= 25_600:
                yield emit()
        if held is not None and len(held):
            out += blocks(held, True)[0]
        if out:
            yield emit()

    return dealt.mapInArrow(run, schema)


def _lists(arrays: list[pa.Array]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(arrays))


def point_blocks(points: DataFrame, frame: Frame, most: int) -> DataFrame:
    """points (pid, x, y, z, g) in blocks of at most `most` along the curve: block, g, pids, xyz, and its box."""
    kind = dict(points.dtypes)["pid"]
    at = points.select("g", "pid", "x", "y", "z", frame.curve(*[(frame.relative(c, F.col(c)), frame.extent) for c in "xyz"]).alias("curve"))
    centre = [frame.centre[c] for c in "xyz"]

    def make(t: pa.Table) -> tuple:
        xyz = np.stack([t[c].to_numpy() for c in "xyz"])
        near = xyz - np.array(centre)[:, None]
        return t["pid"].combine_chunks(), _floats(xyz), *(float(f(v)) for v in near for f in (np.min, np.max))

    schema = f"block long, part long, nth long, g string, pids array<{kind}>, xyz binary, " + ", ".join(f"{c} double" for c in BOX)
    return _packed(at, ["g"], "curve", most, frame.n_points, make, schema).drop("part", "nth")


class _Lines:
    """Segments, ends (7, m), relative to a centre: what their distances from many places need. Solid ones come first, then
    ribbons; order tells which is which."""

    def __init__(self, ends: np.ndarray, centre: np.ndarray):
        ribbon = ends[6] > 1e-9
        self.order = np.argsort(ribbon, kind="stable")
        # row by row, as what is taken of a row of another layout copies all of it
        self.ends = np.ascontiguousarray(ends[:, self.order])
        self.solid = int((~ribbon).sum())
        a, d = self.ends[:3] - centre[:, None], self.ends[3:6] - self.ends[:3]
        length2 = (d * d).sum(axis=0)
        self.length = np.where(length2 > 1e-12, np.sqrt(length2), 0.0)
        u = d / np.where(length2 > 1e-12, np.sqrt(length2), np.inf)
        flat = np.sqrt(d[0] ** 2 + d[1] ** 2)
        across = np.stack([-d[1], d[0]]) / np.where(flat > 1e-12, flat, np.inf)
        # rows that (x, y, z, x^2 + y^2 + z^2, 1) is multiplied by
        one, zero = np.ones(len(flat)), np.zeros(len(flat))
        self.square = np.stack([*(-2 * a), one, (a * a).sum(axis=0)])
        self.place = np.stack([*u, zero, -(a * u).sum(axis=0)])
        self.aside = np.stack([*across, zero, zero, -(across * a[:2]).sum(axis=0)])
        self.low, self.rise, self.half = a[2], u[2], self.ends[6]
        self.begin, self.along = a, u
        # the boxes of lines; a ribbon's has no ends in the plane, as what lies beyond its ends along it doesn't count
        self.least, self.most = np.minimum(a, a + d), np.maximum(a, a + d)
        self.least[:2, self.solid :], self.most[:2, self.solid :] = -np.inf, np.inf
        self.scale2 = float(self.square[4].max(initial=0.0) + length2.max(initial=0.0))

    def __len__(self) -> int:
        return len(self.low)

    def near2(self, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances, up to rounding, of places (n, 3) and the lines `which` (sorted): (n, m)."""
        k = int(np.searchsorted(which, self.solid))
        p = np.column_stack([at, (at * at).sum(axis=1), np.ones(len(at))])
        out = np.empty((len(at), len(which)))
        # so few at a time that what is made meanwhile stays in the cache
        for begin in range(0, k, 1024):
            some = which[begin : min(begin + 1024, k)]
            q = p @ self.place.take(some, axis=1)
            s = np.minimum(np.maximum(q, 0.0), self.length[some])
            out[:, begin : begin + len(some)] = p @ self.square.take(some, axis=1) + s * (s - 2 * q)
        for begin in range(k, len(which), 1024):
            some = which[begin : begin + 1024]
            s = np.minimum(np.maximum(p @ self.place.take(some, axis=1), 0.0), self.length[some])
            beside = np.maximum(np.abs(p @ self.aside.take(some, axis=1)) - self.half[some], 0.0)
            dz = at[:, 2, None] - (self.low[some] + self.rise[some] * s)
            out[:, begin : begin + len(some)] = beside * beside + dz * dz
        return out

    def beside(self, low: np.ndarray, high: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Those of the lines `which` whose boxes meet the box from low to high."""
        for k in (2, 1, 0):
            which = which[(self.least[k].take(which) <= high[k]) & (self.most[k].take(which) >= low[k])]
        return which

    def kept(self, centre: np.ndarray, half: np.ndarray, reach: np.ndarray, near2: np.ndarray, which: np.ndarray, slack: float, give2: float) -> np.ndarray:
        """Which lines may be as near as reach, and as near as the nearest solid line here, to a place of each box: (n, m).

        Seen from afar, what lies behind the foot f of the centre's nearest line, in the direction w from the centre to it, is
        nearer for no place of the box: a place's distance to f is at most its part along w, D, and h^2 / 2D, h half of the
        box's diagonal, while that to what lies before a plane across w is at least the part along w."""
        limit = reach[:, None] + self.stretch(half, which) + slack
        out = near2 <= limit * limit + give2
        k = int(np.searchsorted(which, self.solid))
        if not k:
            return out
        best = near2[:, :k].argmin(axis=1)
        apart, diagonal = np.sqrt(np.maximum(near2[np.arange(len(best)), best], 0.0)), np.sqrt((half * half).sum(axis=1))
        # worth its while for many lines only
        for i in np.flatnonzero((apart > 1.5 * diagonal + slack) & (np.count_nonzero(out[:, :k], axis=1) > 64)):
            j = which[best[i]]
            s = min(max(float((centre[i] - self.begin[:, j]) @ self.along[:, j]), 0.0), float(self.length[j]))
            foot = self.begin[:, j] + s * self.along[:, j]
            far = float(np.sqrt(((centre[i] - foot) ** 2).sum()))
            if far <= 1.5 * diagonal[i]:
                continue
            w = (centre[i] - foot) / far
            mine = np.flatnonzero(out[i, :k])
            lines = which[mine]
            top = w @ self.begin[:, lines] + np.maximum(w @ self.along[:, lines] * self.length[lines], 0.0)
            out[i, mine[top < foot @ w - diagonal[i] ** 2 / (2 * (far - diagonal[i])) - slack - np.sqrt(give2) * 1e-3]] = False
        return out

    def stretch(self, half: np.ndarray, which: np.ndarray) -> np.ndarray:
        """How much less than at their centres the distance can be within boxes with half widths (n, 3): (n, m). A ribbon's
        height follows the place along it, so its vertical part may change by the box's height and its diagonal."""
        across2, diagonal = half[:, 0] ** 2 + half[:, 1] ** 2, np.sqrt((half * half).sum(axis=1))
        ribbon = np.sqrt(across2 + (half[:, 2] + diagonal) ** 2)
        return np.where(which[None, :] < self.solid, diagonal[:, None], ribbon[:, None])


class _Boxes:
    """Boxes of neighbours in order, and above them, 2**FAN by 2**FAN, the boxes around them."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.levels, self.fan = [], 2**FAN
        self.low, self.high = low, high
        while True:
            self.levels.append(((low + high) / 2, (high - low) / 2))
            if len(low) <= 1:
                break
            starts = np.arange(0, len(low), self.fan)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
        self.scale2 = float((np.maximum(np.abs(low), np.abs(high)) ** 2).sum()) if len(low) else 0.0

    def meet(self, lines: _Lines, reach: np.ndarray, slack: float, narrow: bool, found, left=None, around=None) -> int:
        """found(items, near2, lines) for groups of items and the lines that may lie within reach of one of them; how
        many distances were told. narrow: reach is of points, each of which wants its nearest line only, and is narrowed.
        left(first, last, lines): those of the lines that are still looked for at the items. around: the boxes, low and high,
        around what is within reach of each item, if they are told better than by the item's box and its reach."""
        give2 = 1e-13 * (lines.scale2 + self.scale2)
        # whole boxes first, then what they hold
        stack = [(len(self.levels) - 1, 0, np.arange(len(lines)))] if len(lines) and len(reach) else []
        made = 0
        while stack:
            level, node, which = stack.pop()
            size = self.fan**level
            # a line within reach of an item meets the box around what is within reach of all
            items = slice(node * size, min((node + 1) * size, len(reach)))
            low, high = (around[0][items], around[1][items]) if around else (self.low[items] - reach[items, None], self.high[items] + reach[items, None])
            which = lines.beside(low.min(axis=0) - slack, high.max(axis=0) + slack, which)
            if left is not None:
                which = left(items.start, items.stop, which)
            if not len(which):
                continue
            begin, end = (node * self.fan, min((node + 1) * self.fan, len(self.levels[level - 1][0]))) if level else (node, node + 1)
            centre, half = (v[begin:end] for v in self.levels[max(level - 1, 0)])
            near2 = lines.near2(centre, which)
            made += near2.size
            if level <= 1:
                found(begin, near2, which, (centre, half), give2)
                continue
            below = size // self.fan
            first, last = begin * below, min(end * below, len(reach))
            starts = np.arange(0, last - first, below)
            if narrow:
                most = (np.sqrt(np.maximum(near2, 0.0) + give2) + lines.stretch(half, which)).min(axis=1)
                np.minimum(reach[first:last], np.repeat(most, below)[: last - first], out=reach[first:last])
            widest = np.maximum.reduceat(reach[first:last], starts)
            for i, kept in enumerate(lines.kept(centre, half, widest, near2, which, slack, give2)):
                if kept.any():
                    stack.append((level - 1, begin + i, which[kept]))
        return made


def _apart(x, y, z, ends: np.ndarray, ribbon: bool) -> tuple[np.ndarray, np.ndarray]:
    x1, y1, z1, x2, y2, z2, hw = ends
    dx, dy, dz = x2 - x1, y2 - y1, z2 - z1
    length2 = dx * dx + dy * dy + dz * dz
    t = ((x - x1) * dx + (y - y1) * dy + (z - z1) * dz) / np.where(length2 > 1e-12, length2, np.inf)
    t = np.minimum(np.maximum(t, 0.0), 1.0)
    ex, ey, ez = x - (x1 + t * dx), y - (y1 + t * dy), z - (z1 + t * dz)
    if not ribbon:
        return ex * ex + ey * ey, np.abs(ez)
    flat = np.sqrt(dx * dx + dy * dy)
    lateral = np.maximum(np.where(flat > 1e-12, np.abs(ey * dx - ex * dy) / np.where(flat > 1e-12, flat, 1.0), 0.0) - hw, 0.0)
    return lateral * lateral, np.abs(ez)


class _Block:
    """A block's points, xyz (3, n), and the nearest of the segments that they met: d2, seg, xy2, dz."""

    def __init__(self, xyz: np.ndarray, slack: float, reach: np.ndarray | None = None):
        self.xyz, self.slack, n = xyz, slack, xyz.shape[1]
        self.centre = (xyz.min(axis=1) + xyz.max(axis=1)) / 2
        self.at = (xyz - self.centre[:, None]).T.copy()
        self.boxes = _Boxes(self.at, self.at)
        self.reach = np.full(n, np.inf) if reach is None else reach.copy()
        self.d2, self.seg, self.xy2, self.dz = np.full(n, np.inf), np.full(n, -1, dtype=np.int64), np.full(n, np.inf), np.full(n, np.inf)
        self.made = 0

    def meet(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """ids and ends (7, m) of further segments."""
        lines = _Lines(ends, self.centre)
        points, others, held = [], [], 0

        def compared() -> None:
            nonlocal held
            held = 0
            if points:
                self._compare(np.concatenate(points), np.concatenate(others), ids, lines)
            points.clear()
            others.clear()

        def found(begin: int, near2: np.ndarray, which: np.ndarray, box: tuple, give2: float) -> None:
            nonlocal held
            reach = self.reach[begin : begin + len(near2)]
            np.minimum(reach, np.sqrt(np.maximum(near2.min(axis=1), 0.0) + give2), out=reach)
            r, c = np.nonzero(near2 <= ((reach + self.slack) ** 2 + give2)[:, None])
            points.append(begin + r)
            others.append(which[c])
            held += len(r)
            if held >= PAIRS:
                compared()

        self.made += self.boxes.meet(lines, self.reach, self.slack, True, found)
        compared()

    def _compare(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, lines: _Lines) -> None:
        """Points i with lines j, as they are paired."""
        xy2, dz = np.empty(len(i)), np.empty(len(i))
        for ribbon in (False, True):
            k = np.flatnonzero((j >= lines.solid) == ribbon)
            xy2[k], dz[k] = _apart(*self.xyz[:, i[k]], lines.ends[:, j[k]], ribbon)
        d2, seg = xy2 + dz * dz, ids[lines.order[j]]
        # the nearest of each point, the smaller seg_id on ties
        order = np.lexsort((seg, d2, i))
        order = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        i = i[order]
        better = (d2[order] < self.d2[i]) | ((d2[order] == self.d2[i]) & (seg[order] < self.seg[i]))
        i, order = i[better], order[better]
        self.d2[i], self.seg[i], self.xy2[i], self.dz[i] = d2[order], seg[order], xy2[order], dz[order]


def _bounded(blocks: DataFrame, segs: DataFrame, frame: Frame) -> DataFrame:
    """blocks with reach, an upper bound of each point's distance to its nearest segment, from a sample of the segments; where
    the sample has none of its g, infinite. The bounds cost or spare work and leave the result as it is."""
    taken = segs.sample(min(1.0, BEAM / max(frame.n_segs, 1)), seed=1).limit(2 * BEAM).select("g", "seg_id", *ENDS).toPandas()
    known = {g: (t["seg_id"].to_numpy(np.int64), t[list(ENDS)].to_numpy(np.float64).T.copy()) for g, t in taken.groupby("g")}
    slack = frame.extent * SLACK
    kind = dict(blocks.dtypes)["pids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                g = row.column(1)[0].as_py()
                block = _Block(_of(row.column(3)[0].as_py(), 3), slack)
                if g in known:
                    block.meet(*known[g])
                yield pa.RecordBatch.from_arrays([*(row.column(k) for k in range(4)), pa.array([_floats(block.reach)])], names=["block", "g", "pids", "xyz", "reach"])

    return blocks.select("block", "g", "pids", "xyz").mapInArrow(run, f"block long, g string, pids {kind}, xyz binary, reach binary")


def _boxes(blocks: DataFrame, size: int) -> DataFrame:
    """block, nth, g, BOX and reach of each `size` neighbours of each block, and AROUND, the box around what is within reach of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, g, raw, reach in zip(*(batch.column(i).to_pylist() for i in range(4))):
                xyz, reach = _of(raw, 3), np.frombuffer(reach)
                starts = np.arange(0, xyz.shape[1], size)
                bounds = [pa.array(f.reduceat(v, starts)) for v in xyz for f in (np.minimum, np.maximum)]
                around = [pa.array(f.reduceat(v + sign * reach, starts)) for v in xyz for f, sign in ((np.minimum, -1.0), (np.maximum, 1.0))]
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n)), pa.array([g] * n), *bounds, pa.array(np.maximum.reduceat(reach, starts)), *around], names=["block", "nth", "g", *BOX, "reach", *AROUND])

    return blocks.select("block", "g", "xyz", "reach").mapInArrow(run, "block long, nth long, g string, " + ", ".join(f"{c} double" for c in (*BOX, "reach", *AROUND)))


def _rows(block: np.ndarray, line: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for each block, with the segments that go there: lines of ids and ends. A batch has about 8 * ROW segments."""
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    groups = [k[i : i + ROW] for k in np.split(order, cuts) for i in range(0, len(k), ROW)]
    held, some = 0, []
    for n, k in enumerate(groups):
        some.append(k)
        held += len(k)
        if held >= 8 * ROW or n + 1 == len(groups):
            arrays = [pa.array([int(block[k[0]]) for k in some], pa.int64()), pa.array([ids[line[k]].tobytes() for k in some], pa.binary()), pa.array([_floats(ends[:, line[k]]) for k in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "ends"])
            held, some = 0, []


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    names = batch.schema.names
    return batch.column(names.index("seg_id")).to_numpy(), np.stack([batch.column(names.index(c)).to_numpy() for c in ENDS])


def _dealt(segs: DataFrame, blocks: DataFrame, n_blocks: int, frame: Frame) -> DataFrame:
    """block, ids, ends: the segments that the nearest of a block's points may be among, many in a row."""
    wanted = segs.select("g", "seg_id", *[F.coalesce(c, F.lit(0.0)).alias(c) if c == "hw" else F.col(c) for c in ENDS])
    size = max(1, -(-frame.n_points // BOXES))
    schema = "block long, ids binary, ends binary"
    if n_blocks > BOXES:
        # so many g that a block is mostly all of one: all segments of a g go to its blocks
        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from _rows(batch.column(0).to_numpy(), np.arange(batch.num_rows), *_columns(batch))

        return blocks.select("block", "g").join(wanted, "g").select("block", "seg_id", *ENDS).mapInArrow(gather, schema)
    with small_batches(segs.sparkSession, 8):
        told = _boxes(blocks, size).toPandas().sort_values(["g", "block", "nth"])
    centre, slack = np.array([frame.centre[c] for c in "xyz"]), frame.extent * SLACK
    trees = {}
    for g, t in told.groupby("g", sort=False):
        low, high, *around = (t[[f"{n}{c}_{e}" for c in "xyz"]].to_numpy() - centre for n in "pr" for e in ("lo", "hi"))
        trees[g] = (_Boxes(low, high), t["reach"].to_numpy(), t["block"].to_numpy(), around)

    def goes(g: str, ids: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        boxes, reach, block, around = trees[g]
        lines = _Lines(ends, centre)
        blocks_of, nth = np.unique(block, return_inverse=True)
        goes_to = np.zeros((len(blocks_of), len(lines)), dtype=bool)

        def found(begin: int, near2: np.ndarray, which: np.ndarray, box: tuple, give2: float) -> None:
            kept = lines.kept(*box, reach[begin : begin + len(near2)], near2, which, slack, give2)
            for i, row in enumerate(kept, begin):
                goes_to[nth[i], lines.beside(around[0][i] - slack, around[1][i] + slack, which[row])] = True

        def left(first: int, last: int, which: np.ndarray) -> np.ndarray:
            return which[~goes_to[nth[first]].take(which)] if nth[first] == nth[last - 1] else which

        boxes.meet(lines, reach, slack, False, found, left, around)
        to, line = np.nonzero(goes_to)
        del goes_to
        yield from _rows(blocks_of[to], lines.order[line], ids, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ends = _columns(batch)
            codes = batch.column(batch.schema.names.index("g")).dictionary_encode()
            for k, g in enumerate(codes.dictionary.to_pylist()):
                if g in trees:
                    mine = np.flatnonzero(codes.indices.to_numpy() == k)
                    held.setdefault(g, []).append((ids[mine], ends[:, mine]))
            for g in [g for g, parts in held.items() if sum(len(i) for i, _ in parts) >= DEALT]:
                parts = held.pop(g)
                yield from goes(g, np.concatenate([i for i, _ in parts]), np.concatenate([e for _, e in parts], axis=1))
        for g, parts in held.items():
            yield from goes(g, np.concatenate([i for i, _ in parts]), np.concatenate([e for _, e in parts], axis=1))

    # a small table has few files
    return wanted.repartition(min(BLOCKS, max(1, -(-frame.n_segs // 20_000)))).mapInArrow(run, schema)


def _answered(blocks: DataFrame, tasks: int, dealt: DataFrame, frame: Frame) -> DataFrame:
    """block, g, pids and, in the same order, d2, seg, xy2, dz of the points' nearest segments; made: how many distances were told."""
    kind = dict(blocks.dtypes)["pids"]
    own = blocks.withColumn("turn", F.lit(0)).withColumns({c: F.lit(None).cast("binary") for c in ("ids", "ends")})
    names = ["block", "turn", "g", "pids", "xyz", "reach", "ids", "ends"]
    content = dealt.select("block", F.lit(1).alias("turn"), F.lit(None).cast("string").alias("g"), F.lit(None).cast(kind).alias("pids"), *[F.lit(None).cast("binary").alias(c) for c in ("xyz", "reach")], "ids", "ends")
    rows = own.select(*names).unionByName(content).repartition(tasks, "block").sortWithinPartitions("block", "turn")
    slack = frame.extent * SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = me = g = pids = None
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []

        def settle() -> None:
            if block is not None and ids:
                block.meet(np.concatenate(ids), np.concatenate(ends, axis=1))
            ids.clear()
            ends.clear()

        def told() -> pa.RecordBatch:
            lists = [_lists([pa.array(v)]) for v in (block.d2, block.seg, block.xy2, block.dz)]
            return pa.RecordBatch.from_arrays([pa.array([me]), pa.array([g]), pids, *lists, pa.array([block.made])], names=["block", "g", "pids", "d2", "seg", "xy2", "dz", "made"])

        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i, turn in enumerate(column["turn"].to_pylist()):
                if not turn:
                    settle()
                    if block is not None:
                        yield told()
                    me, g, pids = column["block"][i].as_py(), column["g"][i].as_py(), column["pids"].slice(i, 1)
                    block = _Block(_of(column["xyz"][i].as_py(), 3), slack, np.frombuffer(column["reach"][i].as_py()))
                    continue
                ids.append(np.frombuffer(column["ids"][i].as_py(), np.int64))
                ends.append(_of(column["ends"][i].as_py(), len(ENDS)))
                if sum(map(len, ids)) >= PIECES:
                    settle()
        settle()
        if block is not None:
            yield told()

    return rows.mapInArrow(run, f"block long, g string, pids {kind}, d2 array<double>, seg array<long>, xy2 array<double>, dz array<double>, made long")


def search(points: DataFrame, segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pid, g, d2, seg_id, xy2, dz of the nearest segment of equal g, a row for each row of points (pid, x, y, z, g) whose
    g some of segs (seg_id, ENDS, g) has; and made, by block, of the distances told."""
    told = lambda df, names: df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in names]))
    points, segs = told(points, "xyz"), told(segs, ENDS[:6])
    frame = Frame.around(points, segs)
    most = min(max(POINTS, -(-frame.n_points // BLOCKS)), MOST_POINTS)
    spark = points.sparkSession
    with small_batches(spark, 10_000):
        blocks = written(point_blocks(points, frame, most), "nearest-points")
    with small_batches(spark, 8):
        n_blocks = blocks.count()
        tasks = max(1, min(n_blocks, BLOCKS, max(32, frame.n_points // 8192)))
        blocks = written(_bounded(blocks.repartition(tasks), segs, frame), "nearest-bounds")
    with small_batches(spark, 16):
        answers = written(_answered(blocks, tasks, _dealt(segs, blocks, n_blocks, frame), frame), "nearest-found")
    each = answers.select("g", F.inline(F.arrays_zip(F.col("pids").alias("pid"), "d2", F.col("seg").alias("seg_id"), "xy2", "dz"))).filter("d2 < double('inf')")
    return each.select("pid", "g", "d2", "seg_id", "xy2", "dz"), answers.select("block", "made")


def least(each: DataFrame) -> DataFrame:
    """One row for each pid and g of search()'s, the nearest."""
    best = each.groupBy("pid", "g").agg(F.min(F.struct("d2", "seg_id", "xy2", "dz")).alias("best"))
    return best.select("pid", "g", "best.d2", "best.seg_id", "best.xy2", "best.dz")
