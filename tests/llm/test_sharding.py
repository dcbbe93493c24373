import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from subgrade.llm import sharding
from tests.conftest import DATA
from tests.llm.fixtures import ODD, prose, table_of


def check(rows, texts, shards, slack):
    """texts: list of (doc_id, text). Every row once, sizes right and near equal, slots gapless."""
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    even = sum(sizes.values()) / shards
    assert all(abs(sizes[i] - even) <= slack + 0.01 * even for i in range(shards)), sizes


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = sharding.op10_sharding(spark, str(DATA)).collect()
    check(rows, texts, 40, max(len((t or "").encode()) + 16 for _, t in texts))
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_a_third_of_all_rows_is_one_text(spark):
    texts = [prose(1, 40) if i % 3 == 0 else prose(i, 30 + i % 20) for i in range(3000)]
    rows = sharding.shard_documents(table_of(spark, texts), 8, 0.002, rows_per_part=20).collect()
    check(rows, list(enumerate(texts)), 8, 2 * max(map(len, texts)))


def test_odd_texts_repeated_rows_null_ids_and_an_empty_table(spark):
    ids = [3, 3, None, None, *range(4, len(ODD))]
    rows = sharding.shard_documents(table_of(spark, ODD, ids), 4).collect()
    check(rows, list(zip(ids, ODD)), 4, 1e9)
    assert sharding.shard_documents(table_of(spark, []), 4).count() == 0


def test_no_python_on_the_main_path(spark):
    rows = sharding.keyed_rows(table_of(spark, ODD))
    plan = rows.withColumn("shard", sharding.shard_of([2**126, 2**127]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_boundaries_against_a_sorted_list(spark):
    """Each boundary is within the tolerance of its place, or at the nearer end of the row or group there; groups stay whole."""
    texts = [prose(i % 150 if i % 4 else i, 20 + i % 61) for i in range(800)] + [prose(1, 3)] * 50
    docs = table_of(spark, texts)
    shard = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 7, 0.002).collect()}
    keys = sharding.keyed_rows(docs).collect()
    groups = {}
    for r in keys:
        groups.setdefault(r.key_hi, []).append(r)
    order = [groups[k] for k in sorted(groups)]
    assert all(len({shard[r.doc_id] for r in g}) == 1 for g in order)
    ends, total = [0], sum(r.size for r in keys)
    for g in order:
        ends.append(ends[-1] + sum(r.size for r in g))
    for i in range(1, 7):
        goal = total * i / 7
        at = sum(r.size for r in keys if shard[r.doc_id] < i)
        assert at in ends
        assert abs(at - goal) <= max(0.002 * total / 7, min(abs(e - goal) for e in ends))


def test_a_group_larger_than_a_shard_is_split(spark):
    texts = [prose(1, 40)] * 300 + [prose(i, 40) for i in range(300)]
    rows = sharding.shard_documents(table_of(spark, texts), 8).collect()
    check(rows, list(enumerate(texts)), 8, 2 * max(map(len, texts)))
    assert len({r.shard for r in rows if r.doc_id < 300}) >= 4


def test_many_rows_that_repeat_id_and_text_are_dealt_over_parts(spark):
    rows = sharding.shard_documents(table_of(spark, ["a b c"] * 500, [7] * 500), 2, rows_per_part=20).collect()
    check(rows, [(7, "a b c")] * 500, 2, 100)


def test_written_shards_hold_every_row_and_column_once(spark, tmp_path):
    docs = table_of(spark, ODD).withColumn("key_hi", F.lit("mine"))
    assert sharding.write_shards(docs, str(tmp_path / "out"), 4) == "shard_"
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "shard_"}
    assert sorted(r.doc_id for r in back.filter("shard = 'x' and key_hi = 'mine'").collect()) == list(range(len(ODD)))
