"""Language ID by multilingual mixture inference.

Each language is a distribution over hashed character n-grams (one to four letters inside words). A document
is a mixture: expectation-maximisation estimates the languages' proportions from n-gram likelihoods. The
language set is chosen by penalised likelihood: sets grow in order of proportion while the gain in log
likelihood exceeds ``PENALTY`` * log(number of n-grams) per language. The predicted language is the one of largest
proportion, the score that proportion. ``gain`` is by how many nats an n-gram is likelier, on average, under the mixture
than if all buckets were equally likely: about 0 or less where no learnt language explains the text.

The model is fitted on labelled rows outside the held-out fold, ``PER_LANGUAGE`` per language in expectation, drawn by a
hash of the id; its size is languages x buckets. Null texts and texts without a letter are ``und`` with
score 0, as is everything if no row is labelled. Equal proportions go to the smaller name. Repeated rows
and ids are rows of their own; an empty table gives an empty result; very long texts are counted whole, in memory
linear in the text; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkernel import held_out, over_text

BUCKETS = 1 << 15
#: Labelled documents per language that the model is fitted on, in expectation.
PER_LANGUAGE = 1500
ORDERS = (1, 2, 3, 4)
#: In units of log(n) per language; neighbouring n-grams overlap, so it is larger than the usual one half.
PENALTY = 3.0
SMOOTHING = 0.5
ROUNDS = 40


def ngrams(text: str, words: re.Pattern) -> np.ndarray:
    """Buckets of all character n-grams of the text's words; empty if it has no letter."""
    found = words.findall(text.lower())
    if not any(c.isalpha() for w in found for c in w):
        return np.zeros(0, np.int64)
    codes = np.frombuffer((" " + " ".join(found) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n == 1:
            out.append(h[h != 32])
        elif n in ORDERS:
            out.append(h + np.uint64(n << 40))
    h = np.concatenate(out) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - int(math.log2(BUCKETS)))).astype(np.int64)


def fit(docs: DataFrame, lang: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Names and log probabilities (languages x buckets). ``docs`` are the rows that may be learnt from."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, BUCKETS), np.float32)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    sample = rows.filter(draw < rates[F.col("lang")])

    def kernel(batches):
        words, sums = re.compile(r"[^\W\d_]+"), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(ngrams(text, words), minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    table = sample.select("text", "lang").mapInArrow(kernel, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = table.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("t")).collect()
    names = sorted(r["lang"] for r in table)
    model = np.full((len(names), BUCKETS), SMOOTHING)
    for r in table:
        model[names.index(r["lang"]), [x["bucket"] for x in r["t"]]] += [x["n"] for x in r["t"]]
    return names, np.log(model / model.sum(axis=1, keepdims=True)).astype(np.float32)


def _mixture(like: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log likelihood. like: n-grams x languages."""
    k, total = like.shape[1], weight.sum()
    share = np.full(k, 1.0 / k)
    if k > 1:
        for _ in range(rounds):
            new = share * ((weight / (like @ share)) @ like) / total
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
    return share, float(weight @ np.log(like @ share))


def gain(grams: np.ndarray, model: np.ndarray, found: list[tuple[int, float]]) -> float:
    """Mean log of how much likelier the n-grams are under a mixture than spread evenly."""
    bucket, weight = np.unique(grams, return_counts=True)
    at, share = [k for k, _ in found], np.array([p for _, p in found])
    like = np.exp(model[at][:, bucket].astype(np.float64)).T @ share
    return float(weight @ np.log(like * model.shape[1] + 1e-12) / weight.sum())


def infer(grams: np.ndarray, model: np.ndarray) -> list[tuple[int, float]]:
    """(language, proportion) of the chosen set, largest first."""
    bucket, weight = np.unique(grams, return_counts=True)
    logs = model[:, bucket].T.astype(np.float64)
    like = np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-12
    weight = weight.astype(np.float64)
    share, _ = _mixture(like, weight)
    order = np.argsort(-share, kind="stable")
    price = PENALTY * math.log(max(len(grams), 2))
    best = (-math.inf, order[:1], np.ones(1))
    for k in range(1, len(order) + 1):
        own, value = _mixture(like[:, order[:k]], weight)
        value -= price * k
        if value <= best[0]:
            break
        best = (value, order[:k], own)
    return sorted(zip(best[1].tolist(), best[2].tolist()), key=lambda x: (-x[1], x[0]))


def predict(docs: DataFrame, names: list[str], model: np.ndarray, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns ``keep`` (doc_id by default), then lang_pred, score, mixture (``name:proportion``, largest first), gain, each with ``prefix``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets, however many rows there are

    def make():
        words, own = re.compile(r"[^\W\d_]+"), shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            preds, scores, mixtures, gains = [], [], [], []
            for text in texts:
                text = text.as_py()
                grams = ngrams(text, words) if text and names else ()
                if not len(grams):
                    preds.append("und"), scores.append(0.0), mixtures.append(""), gains.append(0.0)
                    continue
                found = infer(grams, own)
                preds.append(names[found[0][0]])
                scores.append(min(1.0, max(0.0, found[0][1])))
                mixtures.append(",".join(f"{names[i]}:{p:.3f}" for i, p in found))
                gains.append(gain(grams, own, found))
            return [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.string()), pa.array(gains, pa.float64())]

        return work

    return over_text(docs, make, f"{prefix}lang_pred string, {prefix}score double, {prefix}mixture string, {prefix}gain double", keep or ["doc_id"])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture; fitted on the rows whose crc32(doc_id) mod 5 is not 0."""
    fold = F.coalesce(held_out("doc_id", 5, 0), F.lit(True))
    names, model = fit(docs.filter(~fold))
    out = predict(docs.select(F.col("doc_id").cast("long"), fold.alias("held_out"), "text"), names, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "mixture")
