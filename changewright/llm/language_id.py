"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all learning documents.  Weights are fitted by follow-the-regularised-leader
(FTRL-proximal) with elastic-net penalties on a bounded sample, then a temperature is fitted on sample rows that the
weights have not seen.  Every document is scored where it lies; nothing but counts is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changewright.llm.common import KEY, keyed

UNKNOWN = "und"
GRAMS, BITS = (1, 2, 3), 15
#: Most rows fitted on, over all languages together; each language gets an equal part, of the least hashes of its ids.
SAMPLE = 2000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 0.0005, 0.0005
#: Rows of this remainder are never learned from; rows of CALIBRATE fit the temperature, all others the weights.
FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3
#: A document below this probability is rejected by ``language_filter``.
LEAST_SCORE = 0.5
_STEP = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of the whole lower-cased text, read in steps."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros(1 << BITS, dtype=np.int64)
    for at in range(0, len(code), _STEP):
        own = code[max(0, at - max(GRAMS) + 1) : at + _STEP]
        skip = min(at, max(GRAMS) - 1)  # already read: only grams that end beyond them are new
        h = np.zeros(len(own), dtype=np.uint32)
        for n in range(1, max(GRAMS) + 1):
            h = own.astype(np.uint32) * _MIX[0] if n == 1 else (h[1:] ^ (h[1:] >> np.uint32(15))) * _MIX[1] + own[: len(h) - 1].astype(np.uint32) * _MIX[2] + np.uint32(n)
            if n in GRAMS:
                new = h[max(0, skip - n + 1) :]
                mixed = (new ^ (new >> np.uint32(16))) * _MIX[0]
                out += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages."""
        at = np.flatnonzero(counts)
        x = counts[at] * self.idf[at]
        x = x / max(np.sqrt(x @ x), 1e-12)
        z = (x @ self.weights[at]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _fit(rows: list[tuple[str, np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray) -> np.ndarray:
    """FTRL-proximal over (lang, feature numbers, counts); L1 leaves weights at exactly zero."""
    z, n = np.zeros((len(idf), len(langs))), np.zeros((len(idf), len(langs)))

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    number = {x: i for i, x in enumerate(langs)}
    for _ in range(EPOCHS):
        for lang, at, counts in rows:
            x = counts * idf[at]
            x = x / max(np.sqrt(x @ x), 1e-12)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[number[lang]] -= 1
            g = np.outer(x, p)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(slice(None))


def _temperature(model: Model, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> float:
    """The temperature of least log loss, by golden section on its logarithm; 1 without rows."""
    if not rows:
        return 1.0
    number, logits, y = {x: i for i, x in enumerate(model.langs)}, [], []
    for lang, at, counts in rows:
        x = counts * model.idf[at]
        logits.append((x / max(np.sqrt(x @ x), 1e-12)) @ model.weights[at])
        y.append(number[lang])
    s, y = np.array(logits), np.array(y)

    def loss(t: float) -> float:
        z = s / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))

    low, high, gold = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit_language_model(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from text and lang of rows outside the held-out fold; rows without id, lang or a letter teach nothing."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold_of(F.col(id_col)).alias("fold"))
    rows = rows.where(f"fold <> {HELD_OUT} and lang is not null and text is not null and text rlike '\\\\p{{L}}'")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(1 << BITS, dtype=np.int64), 0
        for b in batches:
            for t in b.column("text"):
                df += gram_counts(t.as_py()) > 0
                seen += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], seen))], names=["at", "df"])

    counted = rows.select("text").mapInArrow(frequencies, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()  # at most 2**BITS + 1 rows
    df = np.zeros(1 << BITS)
    total = 0
    for at, n in counted:
        if at < 0:
            total = n or 0
        else:
            df[at] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    by_lang = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(by_lang)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), idf, 1.0)
    part = max(1, sample // len(langs))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(1.0)
    for x in langs:  # twice the rows wanted, so that the window below sorts few
        rate = F.when(F.col("lang") == x, min(1.0, (2.0 * part + 100) / by_lang[x])).otherwise(rate)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    chosen = rows.where(draw < rate).select("lang", "fold", "id", "text", F.row_number().over(order).alias("n")).where(F.col("n") <= part)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [gram_counts(t.as_py()) for t in b.column("text")]
            at = [np.flatnonzero(c).astype(np.int32) for c in found]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), b.column("fold"), b.column("n"), pa.array(at, kind), pa.array([c[i].astype(np.int32) for c, i in zip(found, at, strict=True)], kind)],
                names=["lang", "fold", "n", "at", "counts"])

    got = chosen.select("lang", "fold", "n", "text").mapInArrow(features, "lang string, fold long, n int, at array<int>, counts array<int>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["n"], r["lang"]))  # languages take turns
    known = [(r["fold"], (r["lang"], np.array(r["at"]), np.array(r["counts"], dtype=float))) for r in got]
    fit = [r for fold, r in known if fold != CALIBRATE]
    model = Model(langs, _fit(fit, langs, idf), idf, 1.0)
    model.temperature = _temperature(model, [r for fold, r in known if fold == CALIBRATE])
    return model


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """(keys, doc_id, text) -> keys, doc_id, lang_pred, score.

    Texts that are null or have no letter are ``und`` with score 0, and so is everything if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores = [], []
            for t in b.column("text"):
                text = t.as_py()
                p = m.score(gram_counts(text)) if m.langs and has_letter(text) else None
                langs.append(UNKNOWN if p is None else m.langs[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEY), b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*KEY, "doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*KEY, "doc_id", "text").mapInArrow(run, f"_id long, _t long, _s long, doc_id {kind}, lang_pred string, score double")


def identify_languages(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: keys, doc_id, held_out, lang_pred, score.  A null id is not held out and not learned from."""
    model = fit_language_model(docs, sample, id_col, text_col, lang_col)
    found = predict_language(keyed(docs, id_col, text_col), model)
    return found.select(*KEY, "doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def language_filter(docs: DataFrame, least_score: float = LEAST_SCORE, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose language is told with ``least_score`` or more; ``und`` rows go.  Columns stay as they are.

    The decision is taken where the row lies, so texts are not shuffled.
    """
    model = fit_language_model(docs, sample, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = (t.as_py() for t in b.column(text_col))
            yield b.filter(pa.array([bool(m.langs) and has_letter(t) and float(m.score(gram_counts(t)).max()) >= least_score for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
