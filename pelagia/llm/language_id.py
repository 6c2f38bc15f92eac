"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character n-grams. Each language has several centroids, from spherical
k-means over a bounded sample of labelled documents; a text gets the language of the centroid with the highest cosine.
It is rejected if that cosine is below what the sample's own documents of that length reach, less a margin.

The classifier is fitted on at most ``SAMPLE`` documents of each language, those with the smallest hash of id and text;
every whole text is classified.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and rejected; ties go to the language
first in order; without labelled documents everything is ``und``; repeated rows get repeated results; an empty table
gives an empty result; the label, source and id are no inputs of a prediction and other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.shared import bounded, crc_mod, fresh, table

DIMS, GRAMS, CENTROIDS, SAMPLE = 1 << 12, (1, 2, 3), 4, 500
#: Share of the cosine that the sample's documents of a length reach at least, below which a text is rejected. Set by fits
#: that leave one language out (README).
MARGIN = 0.8
UNKNOWN = "und"
SLICE = 1 << 18  # characters whose n-grams are held at once


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, taken slice by slice; None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    whole, out = " " + text.lower() + " ", np.zeros(DIMS, np.int64)
    for a in range(0, len(whole), SLICE):
        chars = np.frombuffer(whole[a : a + SLICE + max(GRAMS) - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        chars = np.where(chars < 65, np.uint64(32), chars)  # digits, signs and white space separate words alike
        mixed = np.zeros_like(chars)
        for n in range(1, max(GRAMS) + 1):
            mixed = (mixed[: len(chars) - n + 1] + chars[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            if n in GRAMS:  # those that begin in this slice
                out += np.bincount(((mixed[:SLICE] ^ np.uint64(n)) >> np.uint64(64 - 12)).astype(np.int64), minlength=DIMS)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(c) * idf)


def size_class(c: np.ndarray) -> np.ndarray:
    """Length classes: powers of two of the number of n-grams."""
    return np.minimum(np.log2(c.sum(-1) + 1).astype(int), 20)


def centroids(m: np.ndarray, k: int = CENTROIDS, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from the points farthest from each other, the first being nearest the mean."""
    at = [int(np.argmax(m @ _unit(m.mean(0))))]
    for _ in range(min(k, len(m)) - 1):
        at.append(int(np.argmin((m @ m[at].T).max(1))))
    c = m[at]
    for _ in range(rounds):
        near = np.argmax(m @ c.T, 1)
        c = _unit(np.stack([m[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c


def _packed(text: pd.Series) -> pd.Series:
    """Counts as compressed bytes; null without a letter."""
    got = [counts(t) for t in text]
    return pd.Series([None if c is None else zlib.compress(c.astype("<i8").tobytes(), 1) for c in got])


def fit(found: list[np.ndarray], langs: list[str]) -> dict | None:
    """found: counts of the sample's texts."""
    got = list(zip(found, langs, strict=True))
    if not got:
        return None
    c, y = np.stack([c for c, _ in got]), np.array([x for _, x in got])
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(0))) + 1
    m = vectors(c, idf)
    names = sorted(set(y.tolist()))
    per = [centroids(m[y == x]) for x in names]
    own = [x for x, p in zip(names, per, strict=True) for _ in p]
    cents = np.concatenate(per).astype(np.float32)
    best, sizes = (m @ cents.T).max(1), size_class(c)
    # from short to long the least cosine can only grow, so an empty class takes the one below
    low = np.array([np.quantile(best[sizes == s], 0.02) if (sizes == s).any() else np.nan for s in range(21)])
    low = pd.Series(low).ffill().bfill().to_numpy()
    return {"idf": idf, "centroids": cents, "langs": own, "least": np.minimum.accumulate(low[::-1])[::-1] * MARGIN}


def predict(model: dict | None, text: list[str | None]) -> pd.DataFrame:
    out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(text), "score": np.zeros(len(text)), "rejected": True})
    if model is None:
        return out
    names = np.array(model["langs"], object)
    for a in range(0, len(text), 256):
        got = [(i, counts(t)) for i, t in enumerate(text[a : a + 256], a)]
        got = [(i, c) for i, c in got if c is not None]
        if not got:
            continue
        at, c = np.array([i for i, _ in got]), np.stack([c for _, c in got])
        cos = vectors(c, model["idf"]).astype(np.float32) @ model["centroids"].T
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(at)), best].astype(float), 0, 1)
        out.loc[at, "lang_pred"] = names[best]
        out.loc[at, "score"] = score
        out.loc[at, "rejected"] = score < model["least"][size_class(c)]
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> dict | None:
    """Fit on documents outside the held-out fold with a label: at most ``sample`` of each language.

    Hashes choose them without moving a text; what comes to the driver is the chosen texts' counts, DIMS numbers each."""
    bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{doc_id}`").alias("id"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod("id", 3) != 1)).withColumn("h", F.xxhash64("id", "text"))
    sizes = rows.groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return None
    # a share of the hash range holds twice the sample of each language; then the smallest hashes are taken
    limit = None
    for r in sizes:
        share = min(1.0, 2 * sample / r["count"])
        cut = int(-(2**63) + share * (2**64 - 1))
        test = (F.col("lang") == r["lang"]) & (F.col("h") <= F.lit(min(cut, 2**63 - 1)))
        limit = test if limit is None else limit | test
    order = Window.partitionBy("lang").orderBy("h", "text")
    chosen = rows.filter(limit).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)
    packed = chosen.select("lang", "n", F.pandas_udf(_packed, "binary")(F.col("text")).alias("c")).filter("c is not null")
    found = sorted((r["lang"], r["n"], bytes(r["c"])) for r in packed.toLocalIterator())
    return fit([np.frombuffer(zlib.decompress(c), "<i8") for _, _, c in found], [x for x, _, _ in found])


def _predicted(spark, model: dict | None):
    sent = bounded(spark).sparkContext.broadcast(model)  # DIMS * CENTROIDS floats a language

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield predict(sent.value, b.tolist())

    apply.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(apply, "lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns of docs under ``row``, lang_pred, score and rejected."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    return docs.select(row.alias("row"), _predicted(docs.sparkSession, model)(F.col(f"`{text}`")).alias("p")).select("row", "p.*")


def near(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    p = fresh(docs, "_predicted")
    return docs.withColumn(p, _predicted(docs.sparkSession, model)(F.col(f"`{text}`"))).filter(~F.col(f"{p}.rejected")).drop(p)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs), keep=["doc_id"])
    return out.select("row.doc_id", (crc_mod("row.doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a learned language, with their own columns."""
    return near(docs, train(docs))
