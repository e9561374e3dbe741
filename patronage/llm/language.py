"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit, a binary classifier over hashed character
n-grams tells the languages with a 1 from those with a 0. A text's language is the one whose
codeword the classifiers' margins lose least against, each bit weighed by how well its classifier
knows that language. A text whose best language hardly beats the others is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the n-grams, and the number of features they are hashed to.
GRAMS = (1, 2, 3)
FEATURES = 1 << 14
#: Texts of a language that the classifiers are fitted on, about, if it has more.
TEXTS_PER_LANGUAGE = 1000
#: A text counts as evidence of so many n-grams at most, so that long texts stay comparable.
MOST_EVIDENCE = 25
#: Below this score the language is ambiguous.
CLEAR_SCORE = 0.5
UNKNOWN = "und"
#: Characters handled at once.
BLOCK_CHARS = 1 << 18


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, 1 or -1
    weights: np.ndarray  # features x bits
    trust: np.ndarray  # languages x bits


def letters() -> np.ndarray:
    """For each code point, whether it is a letter. Tasks get the table from the driver."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_matrix(languages: int) -> np.ndarray:
    """Codewords as rows of 1 and -1.

    Up to six languages have all bits that differ (no bit twice, none the opposite of another,
    none constant); more languages have the best of some fixed random codes.
    """
    if languages < 2:
        return np.zeros((languages, 0), dtype=np.int8)
    if languages <= 6:
        bits = [[1] + [1 if n >> k & 1 else -1 for k in range(languages - 1)] for n in range(2 ** (languages - 1) - 1)]
        return np.array(bits, dtype=np.int8).T
    length = int(np.ceil(10 * np.log2(languages)))
    rng, best, most = np.random.default_rng(1), None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(languages, length))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        apart = (code.shape[1] - code.astype(int) @ code.T) // 2
        nearest = int(apart[~np.eye(languages, dtype=bool)].min())
        if nearest > most:
            best, most = code, nearest
    return best


def gram_features(text: str, known: np.ndarray) -> Iterator[np.ndarray]:
    """The features of a text's n-grams, in blocks; ``known`` is the table of letters. Anything but letters counts as one
    space, also in front and behind. How a text falls into blocks makes no difference."""
    text = text.lower()
    tail = np.zeros(1, dtype=np.uint64)
    for start in range(0, len(text), BLOCK_CHARS):
        points = np.frombuffer(text[start : start + BLOCK_CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(known[points], points, 0).astype(np.uint64)
        points = points[(points > 0) | (np.concatenate((tail[-1:], points[:-1])) > 0)]
        if start + BLOCK_CHARS >= len(text) and (points[-1] if len(points) else tail[-1]):
            points = np.append(points, np.uint64(0))
        joined = np.concatenate((tail, points))
        for n in GRAMS:
            own = joined[max(0, len(tail) - n + 1) :]  # what ends in the new points
            code = np.full(max(0, len(own) - n + 1), n, dtype=np.uint64)
            for k in range(n):
                code = (code + own[k : len(own) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            yield (code >> np.uint64(20)).astype(np.int64) % FEATURES
        tail = joined[-(max(GRAMS) - 1) :]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def margins(text: str, model: Model, known: np.ndarray) -> np.ndarray:
    """For each bit, how much the n-grams speak for 1."""
    total, n = np.zeros(model.code.shape[1]), 0
    for features in gram_features(text, known):
        total += model.weights[features].sum(axis=0, dtype=np.float64)
        n += len(features)
    return total / max(n, 1) * min(n, MOST_EVIDENCE)


def decode(margin: np.ndarray, model: Model) -> tuple[int, float]:
    """The language that loses least against the margins, and its share of the softened losses."""
    loss = np.logaddexp(0, -model.code * margin)
    total = (model.trust * loss).sum(axis=1)
    odds = np.exp(total.min() - total)
    best = int(np.argmin(total))
    return best, float(odds[best] / odds.sum())


def predict_text(text: str | None, model: Model, known: np.ndarray) -> tuple[str, float]:
    if not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    best, score = decode(margins(text, model, known), model)
    return model.languages[best], round(score, 6)


def training_sample(docs: DataFrame, id: str, lang: str, most: int) -> DataFrame:
    """About ``most`` texts of each language (all, if it has fewer): those whose id has a hash in the
    part of all hashes that holds so many. The same texts whatever the partitioning; texts of equal
    id are in or out together."""
    counts = docs.groupBy(lang).agg(F.count("*").alias("n")).collect()  # one row a language
    if not counts:
        return docs.limit(0)
    last = {row[lang]: -(1 << 63) + ((1 << 64) - 1) * min(most, row["n"]) // row["n"] for row in counts}
    limit = F.create_map(*(F.lit(x) for pair in last.items() for x in pair))[F.col(lang)]
    return docs.where(F.xxhash64(id) <= limit)


def fit(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TEXTS_PER_LANGUAGE) -> Model:
    """Classifiers from labelled texts, of which about ``most`` of each language are used.

    Feature counts and training accuracies are summed up by Spark; the driver gets one number for each
    feature and language, however many texts there are.
    """
    sample = training_sample(labelled.where(F.col(lang).isNotNull()), id, lang, most).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    table = sample.sparkSession.sparkContext.broadcast(letters())  # one byte a code point

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                into = sums.setdefault(name, np.zeros(FEATURES, dtype=np.int64))
                for features in gram_features(value or "", table.value):
                    into += np.bincount(features, minlength=FEATURES)
        for name, into in sums.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(into[at])], ["lang", "feature", "n"])

    rows = sample.mapInArrow(counted, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    code = code_matrix(len(languages))
    counts = np.zeros((len(languages), FEATURES))
    index = {name: i for i, name in enumerate(languages)}
    counts[[index[name] for name in rows["lang"].to_pylist()], rows["feature"].to_numpy()] = rows["n"].to_numpy()
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    weights = np.zeros((FEATURES, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):
        weights[:, bit] = np.log(shares[code[:, bit] > 0].mean(axis=0)) - np.log(shares[code[:, bit] < 0].mean(axis=0))
    model = Model(languages, code, weights.clip(-4, 4), np.ones(code.shape))
    return model._replace(trust=trusted(sample, model)) if code.size else model


def trusted(sample: DataFrame, model: Model) -> np.ndarray:
    """For each language, the weights of the bits: how often the bit's classifier is right on its texts."""
    sent = sample.sparkSession.sparkContext.broadcast((letters(), *model))  # features x bits numbers; plain arrays, which need no package to be read

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = sent.value[0], Model(*sent.value[1:])
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                row = own.code[own.languages.index(name)]
                good = margins(value or "", own, known) * row > 0
                sums.setdefault(name, np.zeros(len(row) + 1))[:] += np.append(good, 1)
        for name, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(range(len(found)), pa.int32()), pa.array(found)], ["lang", "bit", "n"])

    rows = sample.mapInArrow(right, "lang string, bit int, n double").groupBy("lang", "bit").agg(F.sum("n").alias("n")).collect()
    found = np.zeros((len(model.languages), model.code.shape[1] + 1))
    for row in rows:
        found[model.languages.index(row["lang"]), row["bit"]] = row["n"]
    accuracy = (found[:, :-1] + 1) / (found[:, -1:] + 2)
    return accuracy / accuracy.mean(axis=1, keepdims=True)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous.

    A null text, one without a letter, and any text if nothing was learned is ``und`` with score 0 and
    not ambiguous. The text alone decides. Columns of these names already in ``docs`` are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((letters(), *model))  # features x bits numbers

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, own = sent.value[0], Model(*sent.value[1:])
        for batch in batches:
            found = [predict_text(value.as_py(), own, known) for value in batch]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang", "score"])

    found = F.col("language__")
    return (
        docs.withColumn("language__", predicted(F.col(text)))
        .withColumn("lang_pred", found["lang"])
        .withColumn("score", found["score"])
        .withColumn("ambiguous", (found["lang"] != UNKNOWN) & (found["score"] < CLEAR_SCORE))
        .drop("language__")
    )


def held_out(id: Column) -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 2 when divided by 4.
    A null id leaves nothing, and is neither learned from nor held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from the labelled documents that are not held out."""
    return fit(docs.where(F.col(id).isNotNull() & ~held_out(F.col(id))), id, text, lang)
