"""Cumulative-link ordinal regression over hashed text features, for graded labels.

For grades 0 < 1 < ... < K - 1 the model is P(y <= k) = sigmoid(theta_k - w.x): one weight vector shared by ordered
thresholds. It gives the expected grade, sum of P(y >= k) over k >= 1, and the tail probability P(y >= g).

Two feature extractors: ToxicFeatures (distinct words with their prefixes) and QualityFeatures (shapes of tokens with
their density). Both read whole texts. Features are hashed to 2**BITS slots. Fitting takes the labelled documents with
the LABELLED lowest hashes of their ids (a bounded sample of labelled rows). A feature gets a weight only if its
log-likelihood ratio against the grades is at least 2 ln(n), n being the number of features that LEAST_DOCS documents or
more have: of words without a bearing on the grade, fewer than one passes on average. Scoring covers all rows.

Defined results: a null or empty text has no features and gets the model's base score. Rows are independent: repeated
rows and null ids don't matter. Labels with a null grade or doc_id are ignored; equal labels for a repeated doc_id count
once for each document row. Without labels, or with one grade only, nothing is learned: the expected grade is that grade
(0 without labels) for all rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.llm.common import materialize, release

BITS, LABELLED, LEAST_DOCS = 24, 12_000, 4
CACHE = 200_000
_WORD = re.compile(r"\w+")


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) >> (32 - BITS)


class ToxicFeatures:
    """The distinct words of a text in lower case, and the prefixes of four and five characters of longer ones.

    Each word gives three slots, -1 for a prefix that it is too short for. A fitted model knows the starts of four
    characters that words with a weight have, so most words are passed over after a look at their start.
    """

    def of_word(self, word: str) -> tuple[int, int, int]:
        return slot(word), slot(f"^{word[:4]}") if len(word) > 4 else -1, slot(f"^{word[:5]}") if len(word) > 5 else -1

    def __call__(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.of_word, set(_WORD.findall(text.lower())))))

    @staticmethod
    def starts(slots: np.ndarray, weighted: np.ndarray) -> np.ndarray:
        """The four-character slots of the words of a document that have a slot with a weight."""
        triples = slots.reshape(-1, 3)
        return triples[(np.isin(triples, weighted) & (triples >= 0)).any(1), 1]

    def scorer(self, model: Model):
        """The score is a sum over distinct words."""
        weights, starts = model.weights, model.starts

        class Gate(dict):
            def __missing__(gate, start: str) -> bool:
                if len(gate) > CACHE:
                    gate.clear()
                gate[start] = found = slot(start) in weights or slot(f"^{start}") in starts
                return found

        gate = Gate()

        def score(text: str) -> float:
            own = [w for w in set(_WORD.findall(text.lower())) if gate[w[:4]]]
            return sum(weights.get(s, 0.0) for w in sorted(own) for s in self.of_word(w))

        return score


class QualityFeatures:
    """Shapes of the white-space tokens, the share of tokens that repeat the one before, and the size, each with its density in powers of two.

    A shape has a for lower-case and other letters, A for upper-case ASCII letters and 0 for digits, with runs of these as
    one and of other characters as three at most. All tokens of a text get their shapes at once, over its bytes.
    """

    classes = np.arange(256, dtype=np.uint8)
    classes[97:123], classes[128:], classes[65:91], classes[48:58] = 97, 97, 65, 48
    merged = np.isin(np.arange(256), [97, 65, 48])

    def shapes(self, text: str) -> list[bytes]:
        raw = self.classes[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        if not raw.size:
            return []
        same = np.zeros(raw.size, bool)
        same[1:] = raw[1:] == raw[:-1]
        long = same.copy()
        long[2:] &= same[1:-1]
        long[3:] &= same[1:-2]
        long[:3] = False
        return raw[~(same & (self.merged[raw] | long))].tobytes().split()

    def __call__(self, text: str) -> list[int]:
        tokens, counts = text.split(), Counter(self.shapes(text))
        counts[b"=previous"] = sum(map(eq, tokens, tokens[1:]))
        n = len(tokens)
        return sorted({slot(f"{s!r}@{(n // c).bit_length()}") for s, c in counts.items() if c} | {slot(f"size@{n.bit_length()}")})

    @staticmethod
    def starts(slots: np.ndarray, weighted: np.ndarray) -> np.ndarray:
        return slots[:0]

    def scorer(self, model: Model):
        return lambda text: sum(model.weights.get(s, 0.0) for s in self(text))


EXTRACTORS = {"toxic": ToxicFeatures, "quality": QualityFeatures}


class Model:
    """Weights by slot and ordered thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float], grades: list[int], starts: frozenset[int] = frozenset()):
        self.weights, self.thresholds, self.grades, self.starts = weights, thresholds, grades, starts

    def tails(self, z: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): P(y >= grades[k + 1])."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - np.asarray(z)[:, None], -500, 500)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades).astype(float)


def fit(found: list[np.ndarray], grades: np.ndarray, chosen: np.ndarray, rounds: int = 400, penalty: float = 1e-4) -> Model:
    """Maximum likelihood with a small ridge penalty, by Adam over the whole sample; deterministic. found: each document's chosen slots."""
    levels, y = np.unique(grades, return_inverse=True)
    n, total = len(y), np.bincount(y, minlength=levels.size)
    place = np.searchsorted(chosen, np.concatenate(found)) if found else np.zeros(0, int)
    cells, value = np.unique(np.repeat(np.arange(n) << BITS, [f.size for f in found]) | place, return_counts=True)
    row, col, value = cells >> BITS, cells & ((1 << BITS) - 1), value.astype(float)
    w, k = np.zeros(chosen.size), levels.size - 1
    share = np.clip(np.cumsum(total)[:-1] / n, 1e-6, 1 - 1e-6)
    theta = np.log(share / (1 - share))
    raw = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    step, m, v = 0.05, np.zeros(w.size + k), np.zeros(w.size + k)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        z = np.bincount(row, value * w[col], n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sig(edge[y + 1] - z), sig(edge[y] - z)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gw = np.bincount(col, value * (dhi - dlo)[row], w.size) / n + penalty * w
        gt = np.array([(-dhi[y == j].sum() + dlo[y == j + 1].sum()) / n for j in range(k)])
        tail = np.cumsum(gt[::-1])[::-1]
        grad = np.concatenate([gw, tail[:1], tail[1:] * np.exp(raw[1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, raw = w - move[: w.size], raw - move[w.size :]
    theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
    return Model({int(s): float(x) for s, x in zip(chosen, w)}, theta.tolist(), levels.tolist())


def _extract(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    features = EXTRACTORS[kind]()
    for batch in batches:
        out = [np.array(features(t), np.int32).tobytes() for t in batch.column("text").fill_null("").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(out, pa.binary())], ["doc_id", "grade", "slots"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, grade, n): the documents of a batch that have a slot, by grade."""
    for batch in batches:
        own = [np.unique(np.frombuffer(s.as_py(), np.int32)) for s in batch.column("slots")]
        grades = np.repeat(batch.column("grade").to_numpy(zero_copy_only=False).astype(np.int64), [s.size for s in own])
        keys, n = np.unique(grades << 32 | np.concatenate([s.astype(np.int64) & 0xFFFFFFFF for s in own]) if own else np.zeros(0, np.int64), return_counts=True)
        slots = (keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        there = slots >= 0
        yield pa.RecordBatch.from_arrays([pa.array(slots[there]), pa.array((keys >> 32).astype(np.int32)[there]), pa.array(n[there].astype(np.int64))], ["slot", "grade", "n"])


def _choose(batches: Iterator[pa.RecordBatch], kind: str, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The chosen slots of each document, and the starts of the words that have one."""
    for batch in batches:
        slots = [np.frombuffer(s.as_py(), np.int32) for s in batch.column("slots")]
        own = [s[np.isin(s, chosen)].tobytes() for s in slots]
        starts = [np.unique(EXTRACTORS[kind].starts(s, chosen)).tobytes() for s in slots]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(own, pa.binary()), pa.array(starts, pa.binary())], ["doc_id", "grade", "slots", "starts"])


def _ratio(levels: list[int], total: dict[int, int]) -> str:
    """The log-likelihood ratio of a slot, that o0, o1, ... documents of each grade have, of all `of`, against the grades."""
    n = sum(total.values())
    part = lambda o, e: f"if({o} > 0, {o} * ln({o} / ({e})), 0D)"
    return "2 * (" + " + ".join(f"{part(f'o{i}', f'of * {total[g]}D / {n}')} + {part(f'({total[g]} - o{i})', f'({n} - of) * {total[g]}D / {n}')}" for i, g in enumerate(levels)) + ")"


def train(docs: DataFrame, labels: DataFrame, grade: str, kind: str, labelled: int = LABELLED) -> Model:
    """Fit on the labelled documents (labels: doc_id and the column `grade`), at most `labelled` labels.

    Slots are counted and chosen on the executors; the driver gets the chosen ones only.
    """
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    sample = rated.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = materialize(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text").mapInArrow(lambda it: _extract(it, kind), "doc_id long, grade int, slots binary"), "labelled")
    total = {r.grade: r["count"] for r in found.groupBy("grade").count().collect()}
    levels = sorted(total)
    if len(levels) < 2:
        return Model({}, [], [levels[0] if levels else 0])
    counted = found.mapInArrow(_count, "slot int, grade int, n long").groupBy("slot").agg(*[F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).alias(f"o{i}") for i, g in enumerate(levels)])
    counted = counted.withColumn("of", sum((F.col(f"o{i}") for i in range(1, len(levels))), F.col("o0"))).where(F.col("of") >= LEAST_DOCS)
    judged = materialize(counted.select("slot", F.expr(_ratio(levels, total)).alias("ratio")), "judged")
    least = 2 * math.log(max(2, judged.count()))
    chosen = np.array(sorted(r.slot for r in judged.where(F.col("ratio") >= least).select("slot").collect()), np.int32)
    rows = sorted(map(tuple, found.mapInArrow(lambda it: _choose(it, kind, chosen), "doc_id long, grade int, slots binary, starts binary").collect()))
    model = fit([np.frombuffer(s, np.int32) for _, _, s, _ in rows], np.array([g for _, g, *_ in rows], np.int64), chosen)
    model.starts = frozenset(x for *_, s in rows for x in np.frombuffer(s, np.int32).tolist())
    release(found)
    release(judged)
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model, kind: str) -> Iterator[pa.RecordBatch]:
    score = EXTRACTORS[kind]().scorer(model)
    for batch in batches:
        z = np.array([score(t) for t in batch.column("text").fill_null("").to_pylist()], float)
        tails = model.tails(z) if model.thresholds else np.zeros((len(z), 0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.expected(tails)), lists], [*batch.schema.names, "_expected", "_tails"])


def score(docs: DataFrame, model: Model, kind: str) -> DataFrame:
    """docs with _expected (double, the expected grade) and _tails (array<double>, P(y >= k) for each grade but the lowest)."""
    docs = docs.drop("_expected", "_tails")
    return docs.mapInArrow(lambda it: _score(it, model, kind), T.StructType([*docs.schema, T.StructField("_expected", T.DoubleType()), T.StructField("_tails", T.ArrayType(T.DoubleType()))]))


def tail(level: int, model: Model):
    """P(y >= level) of scored rows, for the lowest learned grade that is at least `level`; 0 if there is none."""
    at = [i for i, g in enumerate(model.grades[1:]) if g >= level]
    if at:
        return F.col("_tails")[at[0]]
    return F.lit(1.0 if model.grades[0] >= level else 0.0)


def graded(docs: DataFrame, labels: DataFrame, grade: str, kind: str, level: int = 1, labelled: int = LABELLED) -> DataFrame:
    """docs with expected_grade and tail_probability, P(grade >= level); columns of these names that docs has are replaced."""
    model = train(docs, labels, grade, kind, labelled)
    out = score(docs.drop("expected_grade", "tail_probability"), model, kind)
    return out.withColumns({"expected_grade": F.col("_expected"), "tail_probability": tail(level, model)}).drop("_expected", "_tails")


def toxicity(docs: DataFrame, labels: DataFrame, reject: float = 0.5) -> DataFrame:
    """docs with expected_severity, toxic_probability and toxic (whether that is `reject` or more)."""
    out = graded(docs.drop("expected_severity", "toxic_probability", "toxic"), labels, "toxic", "toxic")
    return out.withColumnsRenamed({"expected_grade": "expected_severity", "tail_probability": "toxic_probability"}).withColumn("toxic", F.col("toxic_probability") >= reject)


def quality(docs: DataFrame, labels: DataFrame, keep: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail_probability of a quality of 1 or more, and kept (whether that is `keep` or more)."""
    return graded(docs.drop("kept"), labels, "quality", "quality").withColumn("kept", F.col("tail_probability") >= keep)


