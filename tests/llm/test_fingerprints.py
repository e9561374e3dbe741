"""Sketches against plain Python; likeness against the true share of shingles."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F
from texts import words

from patronage.llm import fingerprints, queries


def shingles(text, k=5):
    found = words(text)
    return {tuple(found[i : i + k]) for i in range(max(len(found) - k + 1, 1))} if found else set()


def following(rows):
    """Each row's next text by descending id, null ids left out."""
    ordered = sorted(rows, key=lambda r: -r.doc_id)
    return {r.doc_id: ordered[(i + 1) % len(ordered)].text or "" for i, r in enumerate(ordered)}


def test_whole_table(sample, monkeypatch):
    for range_rows in (7, 1024):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", range_rows)
        found = {row.doc_id: row for row in fingerprints.edited_likeness(sample).collect()}
        rows = sample.collect()
        after = following(rows)
        assert len(found) == len(rows)
        off = []
        for row in rows:
            half = len(row.text) // 2
            edited = row.text[: len(row.text) - half] + after[row.doc_id][:half]
            ours = found[row.doc_id]
            assert ours.n_chars == len(row.text)
            assert ours.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = shingles(row.text), shingles(edited), shingles(after[row.doc_id])
            if a and b and min(len(a), len(b)) >= 50:
                off.append((ours.near_edited - len(a & b) / min(len(a), len(b)), min(len(a), len(b))))
            assert 0 <= ours.near_edited <= 1 and (ours.near_next == 1 if a == c else ours.near_next <= 1)
        assert max(abs(x) * n**0.5 for x, n in off) < 2.5 and abs(sum(x for x, _ in off) / len(off)) < 0.02  # five standard deviations


def read_back(fingerprint):
    """(digest, hashes) of a written fingerprint."""
    digest, digits = fingerprint.split(":")
    return digest, {digits[i : i + 12] for i in range(0, len(digits), 12)}


def likeness(one, other):
    (digest, a), (other_digest, b) = read_back(one), read_back(other)
    return 1.0 if digest == other_digest else len(a & b) / min(len(a), len(b)) if a and b else 0.0


def test_likeness_is_that_of_the_written_fingerprints(spark, sf_dir):
    """Rebuilt from the strings of the query, for every row of the table."""
    found = {row.doc_id: row for row in queries.op10_fingerprints(spark, sf_dir).collect()}
    order = sorted(found, reverse=True)
    for id, below in zip(order, [*order[1:], order[0]]):
        row = found[id]
        assert abs(row.near_edited - likeness(row.fingerprint, row.edited_fingerprint)) < 1e-12
        assert abs(row.near_next - likeness(row.fingerprint, found[below].fingerprint)) < 1e-12


def test_ranges_hold_about_as_many_rows_whatever_the_ids(spark, monkeypatch):
    """Dense ids, one far away, one that a third of the rows share, and null ids."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 8)
    rows = spark.range(20_000).selectExpr("id", "cast(id as string) as text")
    hot = spark.range(12_000).selectExpr("1234567 as id", "cast(id as string) as text")
    odd = spark.createDataFrame([(2**62, "far"), (-(2**62), "far")], "id long, text string")
    nulls = spark.range(4000).selectExpr("cast(null as long) as id", "cast(id as string) as text")
    found = fingerprints.in_ranges(rows.unionAll(hot).unionAll(odd).unionAll(nulls), "id", ["text"]).collect()
    sizes = Counter(row.range__ for row in found)
    assert max(sizes.values()) <= 80 and len(sizes) > 3000
    told = [(row.id is not None, row.id or 0, row.tie__) for row in sorted(found, key=lambda r: (r.id is not None, r.id or 0, r.tie__))]
    by_range = [(row.id is not None, row.id or 0, row.tie__) for row in sorted(found, key=lambda r: (r.range__, r.id or 0, r.tie__))]
    assert told == by_range


def test_gaps_and_ties_in_ids(make, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    ids = [-(2**62), -5, 0, 1, 2, 1000, 10**12, 2**62]
    docs = make([(i, f"text of {i} and more words") for i in ids])
    found = {row.doc_id: row.edited_sha256 for row in fingerprints.edited_likeness(docs).collect()}
    after = following(docs.collect())
    for row in docs.collect():
        half = len(row.text) // 2
        edited = row.text[: len(row.text) - half] + after[row.doc_id][:half]
        assert found[row.doc_id] == hashlib.sha256(edited.encode()).hexdigest()


def test_equal_texts_have_equal_fingerprints(make):
    docs = make([(i, t) for i, t in enumerate(["a b c d e f", "a b c d e f", None, "", "x", "y"])])
    found = [row for row in sorted(fingerprints.edited_likeness(docs).collect())]
    assert found[0].fingerprint == found[1].fingerprint and found[1].near_next == 1
    assert found[2].fingerprint == found[3].fingerprint != found[4].fingerprint != found[5].fingerprint
    assert found[5].near_next == 0


def test_sketch_keeps_hashes_below_the_threshold_and_merges(make):
    docs = make([(1, " ".join(f"w{i}" for i in range(3000))), (2, " ".join(f"w{i}" for i in range(2000, 4000)))])
    found = fingerprints.fingerprint(docs)
    one, two = (set(row.sketch) for row in found.orderBy("doc_id").collect())
    assert 1350 < len(one) < 1650 and max(one) < 2**47
    assert abs(len(one & two) / min(len(one), len(two)) - 0.5) < 0.05
    merged = fingerprints.merged(found.withColumn("group", F.lit(0)), ["group"])
    assert {row.hash for row in merged.collect()} == one | two


def test_odd_rows(odd, make):
    assert fingerprints.edited_likeness(odd.withColumnRenamed("lang", "next").withColumnRenamed("source", "sketch")).count() == odd.count()
    assert fingerprints.edited_likeness(make([])).collect() == []
    single = fingerprints.edited_likeness(make([(5, "ab")])).collect()[0]
    assert single.edited_sha256 == hashlib.sha256(b"aa").hexdigest() and single.near_next == 1


def test_likeness_of_short_texts(make):
    """Off by no more than the number of shingles allows, and right on average."""
    texts = [" ".join(f"w{(7 * n + i) % 400}" for i in range(n % 60 + 6)) for n in range(1500)]
    docs = make(list(enumerate(texts)))
    after = following(docs.collect())
    off = []
    for row in fingerprints.edited_likeness(docs).collect():
        text = texts[row.doc_id]
        half = len(text) // 2
        a, b = shingles(text), shingles(text[: len(text) - half] + after[row.doc_id][:half])
        off.append((row.near_edited - len(a & b) / min(len(a), len(b)), min(len(a), len(b))))
    long = [x for x, n in off if n >= 12]
    assert max(abs(x) * n**0.5 for x, n in off if n >= 12) < 2.5 and abs(sum(long) / len(long)) < 0.02
    assert sum(x * x for x in long) / len(long) < 0.25 / 12
