"""Language identification by hierarchical discrimination.

Languages are grouped into families. A one-versus-rest linear support vector machine over the families is asked first;
within the family that it names, one-versus-one linear machines vote between its languages, and margins break ties.
Features are shares of hashed byte trigrams of the whole text, lower-cased in ASCII, with digits as one symbol; as they
are linear, a text's margin is the mean weight of its trigrams and no feature vector is built to predict.

The machines are fitted on at most `per_language` labelled rows of each language (the documented bound), the ones with the
least hash of their id, by dual coordinate descent with a bias feature. Language labels without a family in
FAMILIES are families of their own. With fewer than two learned languages the only one, if any, is predicted.

A null text, and one without letters (number signs are none), is `und` with score 0. Empty tables give no rows. Texts of
any length are read whole. Repeated rows get equal
predictions. Other columns, whatever their names, are passed through by `predict`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, mapped, slices, utf8

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk ug uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIMENSIONS = 1 << 14
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[9:14] = 32


def family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter (of a category L*; number signs aren't)."""
    return re.search(rb"[A-Za-z]", text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace")))


def trigrams(data: np.ndarray) -> np.ndarray:
    """The feature number of each trigram."""
    b = _FOLD[data]
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]).astype(np.uint32)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int32)


def shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their shares, scaled to length 1."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    own, n = np.unique(trigrams(data), return_counts=True)
    return own, (n / n.sum()).astype(np.float32)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float = 1.0, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with hinge loss, by dual coordinate descent on unit vectors."""
    w, bias = np.zeros(DIMENSIONS), 0.0
    alpha = np.zeros(len(rows))
    unit = [(i, v / np.sqrt((v * v).sum())) for i, v in rows]
    rng = np.random.default_rng(seed)
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(rows)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, v = unit[r]
            gap = 1 - sign[r] * (w[i] @ v + bias)
            new = min(max(alpha[r] + gap / 2, 0.0), cost * share[r])
            if new != alpha[r]:
                step = (new - alpha[r]) * sign[r]
                w[i] += step * v
                bias += step
                alpha[r] = new
    return w, bias


class Model:
    """machines: (families or languages for, against, column); weights has a column for each."""

    def __init__(self, langs: list[str], rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        label = np.array(labels)
        of = np.array([family(x) for x in labels])
        tasks: list[tuple[str, str]] = []
        weights, biases = [], []

        def fit(key: tuple[str, str], keep: np.ndarray, positive: np.ndarray) -> None:
            at = np.flatnonzero(keep)
            w, b = svm([rows[i] for i in at], np.where(positive[at], 1.0, -1.0))
            tasks.append(key)
            weights.append(w)
            biases.append(b)

        if len(self.families) > 1:
            for f in self.families:
                fit(("", f), np.ones(len(rows), bool), of == f)
        for f in self.families:
            for a, b in combinations([x for x in self.langs if family(x) == f], 2):
                fit((a, b), (label == a) | (label == b), label == a)
        self.tasks = tasks
        self.weights = np.array(weights, np.float32).T.copy() if weights else np.zeros((DIMENSIONS, 0), np.float32)
        self.biases = np.array(biases)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        # texts apart by spaces, so that no trigram spans two of them
        at = offsets[:-1] + 2 * np.arange(n) + 1
        padded = np.full(len(data) + 2 * n + 2, 32, np.uint8)
        padded[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, sizes)] = data
        grams = trigrams(padded)
        first, count = at - 1, sizes  # as many trigrams as bytes
        margin = np.zeros((n, len(self.tasks)))
        norm = np.zeros(n)
        full = np.flatnonzero(count > 0)
        for i in full:
            own, c = np.unique(grams[first[i] : first[i] + count[i]], return_counts=True)
            norm[i] = np.sqrt((c.astype(float) ** 2).sum())
            margin[i] = c @ self.weights[own]
        margin[full] = margin[full] / norm[full, None] + self.biases
        column = {t: j for j, t in enumerate(self.tasks)}
        out, score = [], np.zeros(n)
        squash = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -50, 50)))
        for i in range(n):
            if not has_letter(data[offsets[i] : offsets[i + 1]].tobytes()):
                out.append("und")
                continue
            top, sure = self.families[0], 1.0
            if len(self.families) > 1:
                m = [margin[i, column["", f]] for f in self.families]
                j = int(np.argmax(m))
                top, sure = self.families[j], float(squash(m[j]))
            langs = [x for x in self.langs if family(x) == top]
            votes = {x: [0, 0.0] for x in langs}
            for a, b in combinations(langs, 2):
                m = margin[i, column[a, b]]
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
            best = max(langs, key=lambda x: (votes[x], x))
            out.append(best)
            score[i] = sure * float(squash(votes[best][1] / max(1, len(langs) - 1)) if len(langs) > 1 else 1.0)
        return out, score


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400) -> Model:
    """A model from labelled documents that aren't held out."""
    turn = F.xxhash64(F.lit(11), "id").bitwiseAND((1 << 63) - 1)
    named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null and id is not null").filter(~held_out(F.col("id")))
    # how many binary digits the hashes of a language's least `per_language` rows have; a row for each language and digit
    digits = F.ceil(F.log2(turn + 1)).cast("int")
    counts: dict[str, list[int]] = {}
    for r in named.groupBy("lang", digits.alias("digits")).count().collect():
        counts.setdefault(r["lang"], [0] * 65)[r["digits"]] = r["count"]
    most = [(x, int(np.searchsorted(np.cumsum(c), min(per_language, sum(c))))) for x, c in counts.items()]
    spark = docs.sparkSession
    few = named.join(F.broadcast(spark.createDataFrame(most, "lang string, most int")), "lang").filter(digits <= F.col("most"))
    order = Window.partitionBy("lang").orderBy(turn, "id", F.xxhash64("text"), "text")
    sample = few.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= per_language)
    schema = "lang string, at binary, value binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [(x, *shares(t)) for x, t in ((x, t.encode()) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.string()), pa.array([i.astype("<i4").tobytes() for _, i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, _, v in found], pa.binary())], names=["lang", "at", "value"])

    # at most per_language rows of each language, each of a bounded size
    got = mapped(sample.select("lang", "text"), run, schema).collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["value"])))
    rows = [(np.frombuffer(bytes(r["at"]), "<i4"), np.frombuffer(bytes(r["value"]), "<f4")) for r in got]
    labels = [r["lang"] for r in got]
    return Model(labels, rows, labels)


def held_out(id_: Column) -> Column:
    """Documents that no model may learn from."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def predict(df: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the predicted language and its score of each whole text (renamed if df has such columns)."""
    a, b = fresh(df, lang_out), fresh(df, score_out)
    schema = T.StructType([*df.schema.fields, T.StructField(a, T.StringType()), T.StructField(b, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            langs, score = shared.value.predict(*utf8(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], names=schema.names)

    return mapped(df, run, schema)
