"""Sums along a linked list, by pointer jumping to rulers: parallel list ranking with written rounds.

Every link has one successor, so each join of a round is on keys that occur once and no key is hot. About one link in EVERY,
chosen by hash, is a ruler. Links jump, doubling their reach, until they stand before a ruler or the list's end; those that
do are settled and only looked up from then on. The rulers are a list of their own, ranked likewise, and what a link has
gathered up to its ruler and the ruler's own sum make the link's. A list of at most SMALL links is ranked in one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from subgrade.llm.common import map_batches, written

EVERY, SMALL = 16, 20_000


def _rank_small(links: DataFrame, sums: list[str]) -> DataFrame:
    schema = pa.schema([("link", pa.int64()), *((c, pa.int64()) for c in sums)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        link = whole["link"].to_numpy()
        order = np.argsort(link)
        link = link[order]
        to = whole["next"].fill_null(-1).to_numpy()[order]
        # the place past the last stands for the end
        at = np.append(np.where(to < 0, len(link), np.searchsorted(link, to)), len(link))
        values = np.stack([np.append(whole[c].to_numpy()[order], 0) for c in sums])
        while (at < len(link)).any():
            values = values + values[:, at]
            at = at[at]
        yield pa.RecordBatch.from_arrays([pa.array(link), *map(pa.array, values[:, :-1])], schema=schema)

    return map_batches(links.select("link", "next", *sums).coalesce(1), run, ", ".join(f"{c} long" for c in ("link", *sums)))


def sums_to_end(links: DataFrame, sums: list[str], small: int = SMALL, every: int = EVERY, level: int = 0) -> DataFrame:
    """link, and for each column of sums its total from the link on to the list's end, the link's own included.

    links: link (long, not negative, unique), next (null at an end) and the columns of sums, all long and not null. Several
    lists may be in one table; each ends in a null. No links give no rows.
    """
    n = links.count()
    if n <= small:
        return written(_rank_small(links, sums), "list-small")

    def is_ruler(c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(level), F.col(c)), F.lit(every)) == 0

    settled = F.col("next").isNull() | is_ruler("next")
    now = written(links.select("link", "next", *sums, settled.alias("settled")), "list-round")
    done = [now.filter("settled")]
    moving = now.filter("not settled")
    while not moving.isEmpty():
        there = functools.reduce(DataFrame.unionByName, [*done, moving])
        there = there.select(F.col("link").alias("next"), F.col("next").alias("after"), F.col("settled").alias("then"), *[F.col(c).alias(f"{c}_there") for c in sums])
        jumped = moving.drop("settled").join(there, "next")
        jumped = jumped.select("link", F.col("after").alias("next"), *[(F.col(c) + F.col(f"{c}_there")).alias(c) for c in sums], F.col("then").alias("settled"))
        now = written(jumped, "list-round")
        done.append(now.filter("settled"))
        moving = now.filter("not settled")
    whole = functools.reduce(DataFrame.unionByName, done).drop("settled")
    rulers = sums_to_end(whole.filter(is_ruler("link")), sums, small, every, level + 1)
    there = rulers.select(F.col("link").alias("next"), *[F.col(c).alias(f"{c}_there") for c in sums])
    rest = whole.filter(~is_ruler("link")).join(there, "next", "left")
    rest = rest.select("link", *[(F.col(c) + F.coalesce(f"{c}_there", F.lit(0))).alias(c) for c in sums])
    return rest.unionByName(rulers)
