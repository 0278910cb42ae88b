"""Sharding: the permutation against its definition, shards against their laws, edges."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import op12_sharding as S
from quillon.llm.ordered import in_order
from tests.llm.texts import texts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4096, 4097])
def test_permutation(n):
    p = S.Feistel(n, seed=5)
    out = p.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert p.inverse(out).tolist() == list(range(n))
    if n > 90:
        assert out.tolist() != S.Feistel(n, seed=6).forward(np.arange(n)).tolist()
        assert np.mean(np.abs(np.diff(out))) > n / 5  # neighbours part


def test_numbers_near_the_largest():
    p = S.Feistel((1 << 62) + 3)
    x = np.array([0, 1, (1 << 62) + 2, 1 << 61])
    assert p.inverse(p.forward(x)).tolist() == x.tolist()
    with pytest.raises(ValueError):
        p.forward(np.array([(1 << 62) + 3]))


def test_places_are_computable(spark):
    rows = S.shard_rows(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("shard")), ["k"], 7).collect()
    assert Counter(Counter(r["shard"] for r in rows).values()) == {142: 1, 143: 6}
    for r in rows:
        assert r["row_number"] == r["k"]
        assert S.place_of(r["k"], 1000, 7) == (r["shard"], r["slot"])
        assert S.row_of(r["shard"], r["slot"], 1000, 7) == r["k"]
    with pytest.raises(ValueError):
        S.row_of(7, 0, 1000, 7)


def test_numbers_with_ties_and_nulls(spark):
    rows = [(None,)] * 300 + [(5,)] * 700 + [(i,) for i in range(100)]
    out = in_order(spark.createDataFrame(rows, "k int").repartition(5), ["k"], "n").orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(1100))
    keys = [r["k"] for r in out]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_edges(spark):
    given = [(i if i % 5 else None, t) for i, t in enumerate(texts())] * 2
    d = spark.createDataFrame(given, "doc_id long, text string")
    d.repartition(3).write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/sharded/documents.parquet")
    out = S.op12_sharding(spark, f"{spark.conf.get('spark.checkpoint.dir')}/sharded").collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert S.shard_rows(d.where("false"), ["doc_id"]).collect() == []


def test_same_however_split(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (sorted(map(tuple, S.shard_rows(d.repartition(k).select("doc_id", F.col("lang").alias("slot")), ["doc_id"]).collect())) for k in (1, 6))
    assert a == b


def test_written_shards_read_back_in_order(spark, tmp_path):
    d = spark.range(500).select("id", F.concat(F.lit("t"), "id").alias("text"))
    out = S.write_shards(d, str(tmp_path / "shards"), ["id"], 4)
    rows = out.select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    assert sorted(r["id"] for r in rows) == list(range(500))
    for shard in range(4):
        own = sorted((r["f"], r["i"], r["slot"]) for r in rows if r["shard"] == shard)
        assert [s for _, _, s in own] == list(range(125))


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = S.op12_sharding(spark, SF)
    want = sorted(con.execute(S.ORACLE_SQL).fetchall())
    assert sorted(map(tuple, out.collect())) == want and len(want) >= 200
    assert out.columns == [c[0] for c in con.description]
