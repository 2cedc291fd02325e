import duckdb

from conftest import plain_words
from tallyhold.llm import mixing


def twin(folder):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    return sorted(tuple(map(str, r)) for r in duckdb.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall())


def test_agrees_with_sql(spark):
    rows = mixing.op8_mixing(spark, "/root/testdata/sf0.01")
    duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = duckdb.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall()
    assert sorted(tuple(r) for r in rows.select("doc_id", "size", "source_size", "target", "taken").collect()) == sorted(want)


def test_many_buckets_give_the_same(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    once = sorted(map(tuple, mixing.op8_mixing(spark, folder).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    assert sorted(map(tuple, mixing.op8_mixing(spark, folder).collect())) == once


def test_edges(spark, edges, no_documents, edge_rows, folder):
    rows = mixing.op8_mixing(spark, folder(documents=edges)).collect()
    sizes = {}
    for _, text, _, source in edge_rows:
        sizes[source] = sizes.get(source, 0) + len(plain_words(text))
    assert len(rows) == len(edge_rows)
    assert sorted(r.size for r in rows) == sorted(len(plain_words(t)) for _, t, _, _ in edge_rows)
    assert {r.source_size for r in rows} == set(sizes.values())
    assert abs(sum({r.source_size: r.target for r in rows}.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert all(0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    assert sum(r.taken for r in rows) <= sum(sizes.values())
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed(no_documents).count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    # Weights 5, 2, 1: of 1,000 words a may give 30, then b 60; c takes the rest.
    sizes = spark.createDataFrame([("a", 10), ("b", 20), ("c", 970)], "source string, source_size long")
    assert {r.source: r.target for r in mixing.targets(sizes).collect()} == {"a": 30.0, "b": 60.0, "c": 910.0}


def test_taken_words_come_near_the_target(spark):
    docs = spark.createDataFrame([(i, f"s{i % 4}", "w " * (1 + i % 7)) for i in range(2000)], "doc_id long, source string, text string")
    rows = mixing.mix(docs).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 14 for r in rows)


def test_rows_are_repeated_as_taken(spark, edges):
    taken = {r.row_key: r.taken for r in mixing.mix(edges).collect()}
    rows = mixing.mixed(edges).collect()
    assert sum(len(plain_words(r.text)) for r in rows) <= sum(taken.values()) * 2 and all(r.text and r.row == "r" for r in rows)
    assert set(rows[0].asDict()) == set(edges.columns)
