import catalog
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_documents_grow_in_number_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(catalog, "DOCUMENT_ENTRIES", 20)
    entries = spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("value"))
    documents = catalog.document_of(spark, entries, "market_caps")
    sizes = [r.n for r in documents.select(F.size(F.map_keys(F.from_json(F.get_json_object("document", "$.market_caps"), "map<string,string>"))).alias("n")).collect()]
    assert len(sizes) > 5 and sum(sizes) == 200 and max(sizes) < 60
    assert catalog.document_of(spark, entries.limit(0), "market_caps").count() == 0


def test_queries_agree_for_one_and_many_documents(spark, monkeypatch):
    queries = (catalog.ticker_map_document, catalog.market_cap_document, catalog.sector_document)
    one = [sorted(map(tuple, q(spark, FOLDER).collect())) for q in queries]
    monkeypatch.setattr(catalog, "DOCUMENT_ENTRIES", 10)
    many = [sorted(map(tuple, q(spark, FOLDER).collect())) for q in queries]
    assert one == many and all(one)
