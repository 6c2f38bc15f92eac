"""Quality rules under weak supervision.

Each rule votes good, bad or abstains on a document. Vote patterns are counted over the whole
corpus (at most ``3 ** len(RULES)`` of them, whatever its size), expectation-maximisation over those
counts estimates every rule's class-conditional accuracy and the prior, and a document is kept by its
posterior probability of being good.

Defined cases: null or blank text has no words, every count 0, ``base_failed`` true and ``kept`` false;
repeated rows get repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.shared import bounded, drop, fresh, materialise, segments, table

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_bangs", "n_bars"]
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def word_numbers(raw: bytes) -> tuple[np.ndarray, dict[bytes, int]]:
    """A number for each word in order, and the different words with theirs."""
    known: dict[bytes, int] = {}
    out = []
    for part in segments(raw):
        words = part.split()
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
    return (np.concatenate(out) if out else np.empty(0, np.int64)), known


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words, given by numbers, that stand in some window found at least twice."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    code, wide = numbers[:n], int(numbers.max()) + 1
    for i in range(1, window):
        # numbers for the windows of i + 1 words: exact, and small enough to be multiplied again
        seen, code = np.unique(code * wide + numbers[i : i + n], return_inverse=True)
        if len(seen) == n:
            return 0
    again = np.bincount(code)[code] > 1
    ends = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(ends, np.flatnonzero(again), 1)
    np.add.at(ends, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(ends) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS, of a whole text. What a long text needs besides itself is about 40 bytes a word."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    numbers, known = word_numbers(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(map(str.isupper, text)) if not raw.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = sum(map(str.isalpha, text)) if not raw.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    n_spaces = len(raw) - len(raw.translate(None, _SPACES))
    return (
        len(numbers),
        len(text) - n_spaces,
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(numbers),
        len(lines),
        len(known),
        upper,
        letters,
        raw.count(b"!"),
        int((numbers == known[b"|"]).sum()) if b"|" in known else 0,
    )


def _measured(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=COUNTS, dtype="int64")


def measured(text: Column) -> Column:
    """COUNTS as a struct."""
    return F.pandas_udf(_measured, ", ".join(f"{c} long" for c in COUNTS))(text)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules(c: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Votes (-1 bad, 0 abstains, 1 good) on the counts; each is a ratio, so length alone decides only the first."""
    n = c("n_words")
    return {
        "length": _vote(n < 5, n >= 50),
        "repeats": _vote(c("n_repeat_words") > 0.3 * n, c("n_repeat_words") < 0.05 * n),
        "symbols": _vote(c("n_symbols") > 0.25 * n, c("n_symbols") < 0.05 * n),
        "case": _vote(c("n_upper") > 0.5 * c("n_letters"), c("n_upper") < 0.2 * c("n_letters")),
        "variety": _vote((n >= 20) & (c("n_distinct") < 0.12 * n), (n < 5000) & (c("n_distinct") > 0.35 * n)),
        "lines": _vote((c("n_lines") >= 3) & (c("n_dup_lines") > 0.5 * c("n_lines")), (c("n_lines") >= 3) & (c("n_dup_lines") == 0)),
        "bangs": _vote(c("n_bangs") > 0.3 * n, c("n_bangs") < 0.05 * n),
        "bars": _vote(c("n_bars") > 0.15 * n, c("n_bars") < 0.02 * n),
        "letters": _vote(c("n_letters") < 0.6 * c("word_chars"), c("n_letters") > 0.85 * c("word_chars")),
    }


RULES = ("length", "repeats", "symbols", "case", "variety", "lines", "bangs", "bars", "letters")


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 0.5) -> dict:
    """EM for two classes over vote patterns (rows of -1, 0, 1) and their counts: the prior of being good and
    p[class][rule] = (bad, good, abstains). A rule may abstain more often on one class, so an abstention is evidence too.

    Starts from a soft reading of the votes: documents without a bad vote are good, one bad vote leans to bad,
    more lean further. Nothing observed gives an even prior and flat rules.
    """
    k = patterns.shape[1] if patterns.size else len(RULES)
    prior, p = 0.5, np.full((2, k, 3), 1 / 3)
    if not counts.sum():
        return {"prior": prior, "p": p}
    n_bad = (patterns == -1).sum(1)
    q = np.where(n_bad == 0, 0.98, np.where(n_bad == 1, 0.3, 0.05))
    onehot = np.stack([patterns == v for v in (-1, 1, 0)], 2).astype(float)
    for _ in range(rounds):
        for y, w in ((1, q * counts), (0, (1 - q) * counts)):
            cast = np.einsum("n,nkv->kv", w, onehot) + smooth
            p[y] = cast / cast.sum(1, keepdims=True)
        prior = float(np.clip((q * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        odds = log(prior / (1 - prior)) + np.einsum("nkv,kv->n", onehot, np.log(p[1]) - np.log(p[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-9:
            break
    return {"prior": prior, "p": p}


def posterior(model: dict, votes: dict[str, Column]) -> Column:
    """P(good | votes) of the fitted model, as a column expression."""
    odds = F.lit(log(model["prior"] / (1 - model["prior"])))
    for j, v in enumerate(votes.values()):
        w = np.log(model["p"][1][j]) - np.log(model["p"][0][j])
        odds = odds + F.when(v == -1, float(w[0])).when(v == 1, float(w[1])).otherwise(float(w[2]))
    return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-500.0)), F.lit(500.0))))


def model_of(counted: DataFrame) -> dict:
    """The model fitted to the vote patterns of documents with COUNTS."""
    votes = counted.select(*[v.alias(k) for k, v in rules().items()])
    found = votes.groupBy(*RULES).count().collect()  # at most 3 ** 9 rows
    found.sort(key=lambda r: [r[k] for k in RULES])
    return fit(np.array([[r[k] for k in RULES] for r in found], dtype=int).reshape(-1, len(RULES)), np.array([r["count"] for r in found], dtype=float))


def base_failed(c: Callable[[str], Column] = F.col) -> Column:
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """keep columns of docs (all by default) under ``row``, the counts, ``base_failed``, ``posterior`` and ``kept``.

    Texts are measured once; the counts and what is kept are written."""
    bounded(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    counted, _ = materialise(docs.select(row.alias("row"), measured(F.col(f"`{text}`")).alias("m")).select("row", "m.*"), "measured")
    out = counted.withColumn("base_failed", base_failed()).withColumn("posterior", posterior(model_of(counted), rules()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def kept(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep. Their texts are measured again, which costs less than another copy of them."""
    spark = bounded(docs.sparkSession)
    counted, at = materialise(docs.select(measured(F.col(f"`{text}`")).alias("m")).select("m.*"), "measured")
    model = model_of(counted)
    drop(spark, at)
    # beside the row, not in a struct with it: so the text goes through Python's queue once
    m = fresh(docs, "_measured")
    c = lambda name: F.col(f"{m}.{name}")
    return docs.withColumn(m, measured(F.col(f"`{text}`"))).filter(~base_failed(c) & (posterior(model, rules(c)) >= threshold)).drop(m)


def op2(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", *COUNTS[:5], "base_failed", "kept", "posterior")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their own columns."""
    return kept(docs)
