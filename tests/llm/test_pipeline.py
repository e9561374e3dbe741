"""The pipeline's stages one by one, on tables with everything odd."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_mixing import slow_blend
from test_simhash import groups, slow_fingerprint
from texts import words

from patronage.llm import decontaminate, language, mixing, queries, sharding


@pytest.fixture(scope="module")
def folder(testdata):
    return f"{testdata}/sf0.001"


def test_stages_feed_each_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder).collect()
        assert found, name
        docs = spark.createDataFrame([tuple(row[c] for c in columns) for row in found], docs.select(*columns).schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert list(found[0].asDict()) == columns, name


@pytest.mark.parametrize("place", range(5))
def test_odd_rows_and_empty_tables(spark, folder, odd, make, place):
    _, stage = corpus_pipeline.STAGES[place]
    assert set(odd.columns) <= set(stage(spark, odd, folder).columns)
    assert stage(spark, odd, folder).count() <= 3 * odd.count()
    assert stage(spark, make([]), folder).count() == 0


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.count() > 100 and {"doc_id", "text", "shard"} <= set(found.columns)


def test_only_documents_without_a_language_go(spark, folder, make):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    junk = make([(-1, "12 34 !!"), (-2, None), (-3, "")])
    kept = corpus_pipeline.in_a_language(spark, docs.unionByName(junk.select(*docs.columns)), folder)
    assert {row.doc_id for row in kept.collect()} == {row.doc_id for row in docs.collect()}
    assert language.identify(docs, language.learn(docs)).where(F.col("lang") != F.col("lang_pred")).count() == 0


def one_of_each_group(rows):
    """Of the documents whose fingerprints hang together, the one of the smallest id."""
    prints = {row.doc_id: slow_fingerprint(row.text) for row in rows}
    together = groups(prints.values(), 2)
    least = {}
    for id, value in prints.items():
        least[together[value]] = min(id, least.get(together[value], id))
    return [row for row in rows if row.doc_id in set(least.values())]


def bare(text):
    return [w for w in (decontaminate.EDGE.sub("", w).lower() for w in words(text)) if w]


def without_items(rows, items, length=10):
    """Documents that share no run of ten bare words with an item."""
    runs = {tuple(own[i : i + length]) for item in items for own in [bare(item)] for i in range(len(own) - length + 1)}
    return [row for row in rows if not any(tuple(own[i : i + length]) in runs for own in [bare(row.text)] for i in range(len(own) - length + 1))]


def test_run_equals_plain_python_after_the_language_stage(spark, testdata):
    """Stage by stage on the whole table: what each is given, and what it must keep."""
    folder = f"{testdata}/sf0.01"
    docs = corpus_pipeline.in_a_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    rows = docs.select("doc_id", "text", "source").collect()
    single = one_of_each_group(rows)
    assert ids(corpus_pipeline.without_near_copies(spark, docs, folder)) == sorted(row.doc_id for row in single)
    items = [row.text for row in queries.table(spark, folder, "benchmark").collect()]
    clean = without_items(single, items)
    assert len(clean) < len(single) < len(rows)
    left = docs.where(F.col("doc_id").isin([row.doc_id for row in clean]))
    times = slow_blend(mixing.mix(left).collect())
    expected = sorted(id for (_, _, id), n in times.items() for _ in range(n))
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted(row.doc_id for row in found) == expected
    table = sharding.fill_table(queries.SHARDS)
    assert all(row.shard == table[row.slot] and row.shard_name == queries.SHARDS[row.shard] for row in found)


def ids(docs):
    return sorted(row.doc_id for row in docs.select("doc_id").collect())


def test_a_one_word_item_removes_only_its_own_line(spark, make, tmp_path):
    spark.createDataFrame([(0, "the")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make([(1, "the cat and the dog sat there"), (2, "first line\nThe\nlast line"), (3, "nothing here")])
    assert ids(corpus_pipeline.without_benchmarks(spark, docs, str(tmp_path))) == [1, 3]
