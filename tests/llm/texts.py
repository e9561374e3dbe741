"""Odd texts, and words as the contracts define them."""

import re

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

#: Null, empty, blank, one word, repeated rows, ties in every column, a long text.
ODD_TEXTS = [None, "", " \n\t ", "one", "a b", "a b", "a b c d e f g", "A B C D E F G", "x" * 3000, "word " * 3000, "é漢字 ñandú ümlaut"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
