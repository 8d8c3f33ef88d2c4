import zlib

from tessera.llm import sharding
from tests.llm.helpers import odd_documents, table


def check(docs, n=8):
    rows = sharding.shard_digest(docs, n).collect()
    texts = sorted((r.text or "" for r in docs.select("text").collect()), key=str)
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts)
    total, shards = sum(r.size for r in rows), {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for k, members in shards.items():
        assert 0 <= k < n and sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r.size for r in members) - total / n) <= max(r.size for r in rows)
    order = [r.doc_id for k in sorted(shards) for r in sorted(shards[k], key=lambda r: r.slot)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_balance_and_slots(spark):
    check(table(spark, "documents"))


def test_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    check(docs)
    check(docs, 3)
    assert sharding.shard_digest(docs.limit(0)).collect() == []
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("row.*").columns == docs.columns
