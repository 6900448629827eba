"""Language identification: sparse multinomial logistic regression on TF-IDF of
character n-grams, trained by follow-the-regularised-leader with an elastic
net, then calibrated by a temperature.

Document frequencies come from all rows that may be learned from. The weights
are fitted on a sample of those rows whose size is a parameter; sample and
model are bounded by it and by the number of n-gram slots, and only they pass
the driver. Every text is scored whole, in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.graph import own_columns, unused_name

SLOT_BITS = 15
ORDERS = (1, 2, 3)
CHUNK = 1 << 18
CUT_CHARS = 60  # of the short texts a model is calibrated for
UNKNOWN = "und"
_SEEDS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))


@dataclass(frozen=True)
class Settings:
    """``sample``: most rows the weights are fitted on, shared alike by the
    languages. The others are those of the optimiser: step size, L1, L2, passes."""

    sample: int = 4000
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    passes: int = 3
    seed: int = 0


@cache
def _letters() -> np.ndarray:
    """For each code point its small letter if it is a letter, else a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def slots(text: str) -> np.ndarray:
    """Counts of the text's n-grams by slot. Runs of other characters than
    letters are one blank; texts begin and end with one."""
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    shift = np.uint32(32 - SLOT_BITS)
    carry = np.array([32], np.uint32)
    for a in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[a : a + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.concatenate([carry, _letters()[codes]])
        if a + CHUNK >= len(text):
            letters = np.append(letters, np.uint32(32))
        kept = np.ones(len(letters), bool)
        kept[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
        # what the chunk before has counted already
        old = len(carry) if a else 0
        ends = np.flatnonzero(kept)
        letters, fresh = letters[ends], ends >= old
        rolled = np.zeros(len(letters), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            rolled = rolled[: len(letters) - n + 1] * _SEEDS[0] + letters[n - 1 :] * _SEEDS[1]
            if n in ORDERS and len(rolled):
                mixed = (rolled ^ (rolled >> np.uint32(15))) * _SEEDS[2] + _SEEDS[3] * np.uint32(n)
                mixed = (mixed ^ (mixed >> np.uint32(13))) * _SEEDS[4]
                new = fresh[n - 1 :]
                counts += np.bincount((mixed >> shift)[new], minlength=len(counts))
        carry = letters[-(max(ORDERS) - 1) :]
    return counts


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def rarity(counts: np.ndarray, idf: np.ndarray) -> tuple[float, int]:
    """How rare a text's n-grams are on the whole: their mean IDF, and how many
    they are."""
    n = int(counts.sum())
    return (float(counts @ idf) / n if n else 0.0), n


@dataclass(frozen=True)
class Usual:
    """How rare the n-grams of texts in the learned languages are: mean, spread
    between texts, spread of a single n-gram, and how many spreads over the mean
    the rarest known text is. ``flat`` is the rarity of a text whose n-grams have
    nothing to do with the learned ones."""

    mean: float
    between: float
    within: float
    widest: float
    flat: float

    def spread(self, n):
        return np.sqrt(self.between**2 + self.within**2 / np.maximum(n, 1))

    def evidence(self, rare: float, n: int) -> float:
        """1 up to half as far again from the mean as any known text of that
        length, then falling to 0 where n-grams are as rare as any."""
        limit = self.mean + 1.5 * self.widest * float(self.spread(n))
        if rare <= limit or limit >= self.flat:
            return 1.0
        return max(0.0, (self.flat - rare) / (self.flat - limit))


def usual(whole: np.ndarray, cuts: np.ndarray, idf: np.ndarray) -> Usual:
    """From ``(rarity, n-grams)`` of known texts and of short cuts of them."""
    mean, between = float(whole[:, 0].mean()), float(whole[:, 0].std()) + 1e-6
    rest = ((cuts[:, 0] - mean) ** 2 - between**2) * cuts[:, 1] if len(cuts) else np.zeros(1)
    first = Usual(mean, between, float(np.sqrt(max(rest.mean(), 1e-6))), 0.0, float(idf.mean()))
    every = np.concatenate([whole, cuts]) if len(cuts) else whole
    widest = float(((every[:, 0] - mean) / first.spread(every[:, 1])).max())
    return replace(first, widest=max(widest, 2.0))


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text and their TF-IDF, of length one."""
    return weighted(slots(text), idf)


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    values = counts[at] * idf[at]
    norm = np.sqrt(values @ values)
    return at, values / norm if norm else values


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray  # by slot
    weights: np.ndarray  # slot x label
    bias: np.ndarray
    temperature: float = 1.0
    usual: Usual | None = None

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[at] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        counts = slots(text)
        z = self.logits(*weighted(counts, self.idf)) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        known = self.usual.evidence(*rarity(counts, self.idf)) if self.usual else 1.0
        return self.labels[best], float(p[best] / p.sum()) * known


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, s: Settings):
    """Weights and bias by follow-the-regularised-leader: per weight the sum of
    adjusted gradients ``z`` and of squared ones ``n`` give it in closed form,
    zero where ``|z|`` is within the L1 penalty."""
    size = 1 << SLOT_BITS
    z, n = np.zeros((size + 1, n_labels)), np.zeros((size + 1, n_labels))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - s.l1, 0.0)
        return -shrunk / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)

    order = np.random.default_rng(s.seed)
    for _ in range(s.passes):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(at)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / s.alpha * w
    w = weights(np.arange(size + 1))
    return w[:size], w[size]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which the given labels are likeliest, with a prior
    around 1 that weighs as much as one row: rows that are told apart without
    any error would else ask for a temperature of zero."""

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        miss = -(z[np.arange(len(z)), labels] - np.log(np.exp(z).sum(1)))
        return float(miss.sum() + log_t**2 / 2)

    low, high, golden = -5.0, 5.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per slot of a task's texts: in how many of them it occurs."""
    found, rows = np.zeros(1 << SLOT_BITS, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            found += slots(text.as_py()) > 0
            rows += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(found[at], rows), pa.int64())],
        names=["slot", "n"],
    )


def _features_of(idf):
    """Slots and values as the bytes of small numbers: the sample comes to the
    driver and is never spelled out there as Python objects."""

    @F.arrow_udf(_FEATURES)
    def featured(texts: pa.Array) -> pa.Array:
        columns = [[] for _ in range(8)]
        for t in texts:
            text = t.as_py()
            middle = len(text) // 2
            for k, part in ((0, text), (4, text[middle : middle + CUT_CHARS])):
                counts = slots(part)
                at, x = weighted(counts, idf.value)
                rare, n = rarity(counts, idf.value)
                values = (at.astype("<u2").tobytes(), x.astype("<f4").tobytes(), rare, n)
                for column, value in zip(columns[k : k + 4], values, strict=True):
                    column.append(value)
        kinds = [pa.binary(), pa.binary(), pa.float64(), pa.int64()] * 2
        names = [f.split()[0] for f in _FEATURES.split(", ")]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return featured


_FEATURES = "at binary, x binary, rare double, n bigint, cut_at binary, cut_x binary, cut_rare double, cut_n bigint"


def _pair(at: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, "<u2").astype(np.int32), np.frombuffer(x, "<f4")


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from a table ``(key, text, lang)``.

    Rows without a letter or a language teach nothing. Of each language the
    rows with the smallest hashes of ``key`` and text are the sample, one in
    five of them, and a short cut of each, for the temperature. All of them and
    their cuts show how rare the n-grams of known texts are. Without any row the model has no labels
    and every text is unknown.
    """
    spark = labelled.sparkSession
    rows = labelled.where(has_letter(F.col("text")) & F.col("lang").isNotNull()).select("key", "text", "lang")
    found = rows.select("text").mapInArrow(_frequencies, "slot bigint, n bigint")
    counted = {r["slot"]: r["n"] for r in found.groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    total = counted.pop(-1, 0) or 0
    frequency = np.zeros(1 << SLOT_BITS)
    if counted:
        frequency[list(counted)] = list(counted.values())
    idf = np.log((1 + total) / (1 + frequency)) + 1
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], idf, np.zeros((1 << SLOT_BITS, 0)), np.zeros(0))
    each = max(1, settings.sample // len(labels))
    draw = F.xxhash64("key", "text")
    # a hash below the limit in about twice the rows that are wanted, of which
    # the smallest are taken: no language is sorted as a whole
    limit = F.lit(None).cast("double")
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, min(1.0, (2 * each + 50) / n)).otherwise(limit)
    place = (F.shiftrightunsigned(draw, 11).cast("double") / float(1 << 53)).alias("place")
    near = rows.select("text", "lang", place, limit.alias("limit")).where("place <= limit").select("text", "lang", "place")
    by_place = Window.partitionBy("lang").orderBy("place", "text")
    ranked = near.withColumn("r", F.row_number().over(by_place)).where(F.col("r") <= each)
    known = spark.sparkContext.broadcast(idf)
    made = ranked.select("lang", "r", _features_of(known)("text").alias("f")).select("lang", "r", "f.*")
    sample = sorted(made.collect(), key=lambda r: (r["lang"], r["r"]))
    number = {lang: i for i, lang in enumerate(labels)}
    data = [(*_pair(r["at"], r["x"]), number[r["lang"]]) for r in sample]
    held = [i for i in range(len(data)) if i % 5 == 0]
    learned = [d for i, d in enumerate(data) if i % 5] or data
    weights, bias = fit_weights(learned, len(labels), settings)
    model = Model(labels, idf, weights, bias)
    # short texts are what a temperature has to be right for, too
    cuts = [(*_pair(sample[i]["cut_at"], sample[i]["cut_x"]), data[i][2]) for i in held if sample[i]["cut_n"] > 2]
    judged = [data[i] for i in held] + cuts
    logits = np.array([model.logits(at, x) for at, x, _ in judged])
    model.temperature = fit_temperature(logits, np.array([y for _, _, y in judged]))
    whole = np.array([(r["rare"], r["n"]) for r in sample])
    short = np.array([(r["cut_rare"], r["cut_n"]) for r in sample if r["cut_n"] > 2]).reshape(-1, 2)
    model.usual = usual(whole, short, idf)
    return model


def _predict(model):
    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        m, found, scores = model.value, [], []
        for text in texts:
            t = text.as_py()
            lang, score = m.predict(t) if t is not None and m.labels else (UNKNOWN, 0.0)
            found.append(lang)
            scores.append(score)
        return pa.StructArray.from_arrays(
            [pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"]
        )

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (underscored where taken).

    The score is the calibrated probability, less where the text's n-grams are
    rarer than in any text of a learned language (``Usual``). A text that is null
    or has no letter is ``und`` with score 0. Nothing but the text is looked at;
    equal texts get equal results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lang, score = unused_name(docs, "lang_pred"), unused_name(docs, "score")
    both = unused_name(docs, "found")
    # texts without a letter reach the model as null
    told = F.when(has_letter(F.col(text_col)), F.col(text_col))
    found = docs.withColumn(both, _predict(sent)(told))
    return found.select(*own_columns(docs), F.col(f"{both}.lang_pred").alias(lang), F.col(f"{both}.score").alias(score))


def is_held_out(id_: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from the rows of ``documents`` that are not held out."""
    known = docs.where(~is_held_out(F.col("doc_id")))
    return fit(known.select(F.col("doc_id").alias("key"), "text", "lang"), settings)


def accepted(docs: DataFrame, least: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without rows of no language: no letter, or a score below ``least``."""
    told = identify(docs, learn(docs, settings))
    lang, score = told.columns[-2:]
    return told.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*own_columns(docs))
