from tessera.llm import mixing
from tests.compare import assert_same, connect
from tests.llm.helpers import SF, odd_documents, table


def test_against_sql(spark):
    assert_same(mixing.mixed_sizes(table(spark, "documents")), connect(SF), mixing.ORACLE)


def test_targets_and_copies(spark):
    docs = table(spark, "documents")
    rows = mixing.mixed_sizes(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken: dict = {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.target <= 3 * r.source_size + 1e-6
        taken.setdefault(r.source, [0, r.target])[0] += r.taken
    for got, target in taken.values():
        assert abs(got - target) <= 0.25 * target
    assert sum(t for _, t in taken.values()) <= sum(r.size for r in rows) * (1 + 1e-9)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    per_id = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert per_id == {r.doc_id: r.taken // r.size for r in rows if r.size and r.taken}


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert mixing.mixed_sizes(docs).count() == docs.count()
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == mixing.mix(docs).count()
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed_sizes(docs.limit(0)).collect() == []
