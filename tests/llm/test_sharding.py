"""Shards against a plain computation over all rows in memory."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from velomart.llm import sharding
from velomart.llm.common import stage


def md5(*parts):
    return hashlib.md5("|".join([str(sharding.SEED), *parts]).encode()).hexdigest()[:16]


def plain(rows, shards):
    ranked, out = [], []
    by_source = {}
    for doc_id, text, source in rows:
        crc = zlib.crc32((text or "").encode())
        key = md5(*([] if doc_id is None else [str(doc_id)]), str(crc))
        by_source.setdefault(source, []).append((key, doc_id, text or ""))
    by_size = {}
    for source, own in by_source.items():
        by_size.setdefault(len(own), []).append((md5("" if source is None else "=" + source), source is not None, source or "", source))
    u = {x[3]: (2 * k + 1) / (2 * len(own)) for own in by_size.values() for k, x in enumerate(sorted(own, key=lambda x: x[:3]))}
    for source, own in by_source.items():
        for k, (_, doc_id, text) in enumerate(sorted(own, key=lambda x: (x[0], x[1] is not None, x[1] or 0, zlib.crc32(x[2].encode())))):
            ranked.append(((k + u[source]) / len(own), source is not None, source or "", k, doc_id, text))
    for position, (*_, doc_id, text) in enumerate(sorted(ranked)):
        shard = position * shards // len(rows)
        out.append((doc_id, len(text.encode()) + 16, zlib.crc32(text.encode()), shard, position - (shard * len(rows) + shards - 1) // shards))
    return Counter(out)


@pytest.mark.parametrize("group_rows", [5000, 20])
def test_equals_the_plain_computation(spark, monkeypatch, group_rows):
    monkeypatch.setattr(sharding, "GROUP_ROWS", group_rows)
    rows = [(k, "copy" if k % 4 == 0 else f"text {k} é", "big" if k % 3 else f"s{k % 7}") for k in range(700)]
    rows += [(701, None, None), (702, "", ""), (703, "x", None), (5, "f", "big"), (5, "f", "big"), (None, "n", "s1")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, shard string, slot int")
    got = sharding.assign(docs, shards=9).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == plain(rows, 9)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    mixture = Counter(r.shard for r in got if r.source == "big")
    assert max(mixture.values()) - min(mixture.values()) <= 5  # seven small sources move at like fractions
    for shard in range(9):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))


def test_fewer_rows_than_shards_and_none(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], "doc_id long, text string, source string")
    got = sharding.assign(docs, shards=40).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (20, 0)]
    assert sharding.assign(docs.where("false")).count() == 0


def test_many_sources_of_one_row_keep_the_mixture(spark):
    """A third of the rows in sources of their own: every shard has its share of them and of the large sources, and so has every window."""
    docs = spark.range(60_000).selectExpr(
        "if(id % 50 = 0, NULL, id) AS doc_id", "concat('t', id) AS text", "CASE id % 3 WHEN 0 THEN concat('host', id) WHEN 1 THEN 'a' ELSE concat('b', id % 2) END AS source"
    )
    got = sharding.assign(docs).selectExpr("shard", "if(source LIKE 'host%', 'one', source) AS kind")
    for kind, total in (("one", 20_000), ("a", 20_000), ("b0", 10_000), ("b1", 10_000)):
        counts = [r["n"] for r in got.where(f"kind = '{kind}'").groupBy("shard").agg(F.count("*").alias("n")).collect()]
        assert len(counts) == 40 and all(abs(n - total / 40) <= 2 for n in counts)
    rows = stage(sharding.described(docs), "described")
    steps = sharding.offsets(rows, sharding.SEED)
    placed = sharding.ranked(rows, 60_000, "source", ["doc_id"]).join(steps, F.col("source").eqNullSafe(F.col("u_source")))
    cells = placed.groupBy(F.floor((F.col("place") - 1 + F.col("u")) / F.col("of") * 12)).count().collect()
    assert len(cells) == 12 and max(r["count"] for r in cells) <= 2 * sharding.GROUP_ROWS
    assert rows.groupBy("shuffled").count().agg(F.max("count")).first()[0] == 1  # rows without a doc_id are apart
