"""Language identification on held-out documents."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from patronage.llm import language


def test_held_out_accuracy(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/sf0.01/documents.parquet")
    found = language.identify(docs, language.learn(docs)).withColumn("held_out", language.held_out(F.col("doc_id"))).collect()
    held = [row for row in found if row.held_out]
    assert {row.doc_id for row in held} == {row.doc_id for row in found if zlib.crc32(str(row.doc_id).encode()) % 4 == 2}
    assert np.mean([row.lang == row.lang_pred for row in held]) > 0.99
    assert all(0 <= row.score <= 1 for row in found)


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 40):
        code = language.code_matrix(n).astype(int)
        assert len({tuple(row) for row in code}) == n
        assert (np.abs(code.sum(axis=0)) < n).all()
        columns = [tuple(column) for column in code.T]
        if n <= 6:
            assert len(set(columns) | {tuple(-x for x in column) for column in columns}) == 2 * len(columns)


def test_two_wrong_bits_of_seven_are_corrected():
    code = language.code_matrix(4)
    model = language.Model(["a", "b", "c", "d"], code, np.zeros((language.FEATURES, 7)), np.ones((4, 7)))
    for i in range(4):
        margin = 5.0 * code[i].astype(float)
        margin[0] *= -0.2
        assert language.decode(margin, model)[0] == i


def test_ambiguous_and_unknown(make):
    train = make([(i, t, l) for i, (t, l) in enumerate([("aaa aab aba", "x"), ("zzz zzy zyz", "y")] * 20)])
    model = language.learn(train)
    texts = [(1, "aab aaa"), (2, "zzy zyz"), (3, None), (4, ""), (5, "12 .. 3"), (6, "кириллица"), (7, "AAB aaB")]
    found = {row.doc_id: row for row in language.identify(make(texts), model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, 5, 7)] == ["x", "y", "und", "und", "und", "x"]
    assert found[6].score < 0.6 < found[1].score
    assert [found[i].score for i in (3, 4, 5)] == [0, 0, 0]


def test_nothing_or_one_language_learned(make, odd):
    nothing = language.learn(make([(1, "a", None), (None, "b", "x")]))
    assert {row.lang_pred for row in language.identify(odd, nothing).collect()} == {"und"}
    one = language.learn(make([(i, "some text", "x") for i in range(8)]))
    assert {row.lang_pred for row in language.identify(odd, one).collect()} == {"und", "x"}


def test_odd_rows_and_empty_table(make, odd):
    model = language.learn(odd)
    assert language.identify(odd, model).count() == odd.count()
    assert language.identify(make([]), language.learn(make([]))).collect() == []


def test_blocks_of_long_texts(monkeypatch):
    """Whatever the blocks, the same n-grams, also where one begins or ends with what is no letter."""
    known = language.letters()
    for text in ("the quick, brown fox " * 50, " ,.a", "ab", "  ", "a" * 301, ("x" * 99 + " ") * 3):
        whole = np.sort(np.concatenate(list(language.gram_features(text, known))))
        for block in (1, 2, 7, 100):
            monkeypatch.setattr(language, "BLOCK_CHARS", block)
            assert np.array_equal(whole, np.sort(np.concatenate(list(language.gram_features(text, known)))))
        monkeypatch.undo()


def test_prediction_ignores_other_columns(sample):
    model = language.learn(sample)
    plain = language.identify(sample.select("doc_id", "text"), model)
    other = language.identify(sample.withColumn("lang", F.lit("zz")).withColumn("score", F.lit("clash")), model)
    assert sorted(plain.select("doc_id", "lang_pred", "score").collect()) == sorted(other.select("doc_id", "lang_pred", "score").collect())
