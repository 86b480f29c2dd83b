"""Language identification by interpolated Kneser-Ney models of characters, one a language.

A text becomes symbols: its letters and marks, lower-cased, as UTF-16 units, each run of anything else as one blank,
with blanks before and one after.  A language's model gives each symbol its probability after the three before: the
highest order has counts of use, lower orders count the different symbols that stood before, each order discounts its
own counts and passes what that frees to the next, the last to all symbols alike.  Four units fill 64 bits, so an
n-gram is its own hash, without collisions; a model is a sorted array of such hashes an order, with their shares, and
one of contexts with what they pass on.  The language of the lowest cross-entropy a symbol is predicted.

Cross-entropies become probabilities by a temperature that is fitted on labelled rows the counts have not seen; on
the same rows each language's usual cross-entropies are measured, and a text beyond its language's limit is rejected
(accepted is false), as one in none of the languages would be.

Models are fitted on a bounded sample of the labelled rows: SAMPLE_CHARS characters of all languages together, at
most LANGUAGE_CHARS of one.  Prediction reads every text whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import ready, written

ORDER = 4
#: Characters of labelled text, about, that one language is learnt from at most, and all together.
LANGUAGE_CHARS = 3_000_000
SAMPLE_CHARS = 24_000_000
#: Languages up to which a table of them is broadcast.
BROADCAST_LANGUAGES = 100_000
#: Rows that calibrate at most, those of the smallest hashes.
CALIBRATION_ROWS = 20_000
#: Share of a language's calibrating rows whose cross-entropy stays under its limit, and the bits a symbol added to it.
INSIDE, MARGIN = 0.995, 0.25
#: Different n-grams that a task holds before it hands them on, and that are scored at once.
HOLD = 500_000

_BLANK = np.uint64(0x20)


def fold(doc_id: Column, n: int = 4) -> Column:
    """crc32 of the id as text modulo n; a null id has 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


@cache
def _units() -> np.ndarray:
    """By UTF-16 unit: the symbol that it stands for, a blank where it is no letter or mark."""
    out = np.full(1 << 16, 0x20, np.uint16)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            out[c] = c
        elif unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of each symbol with the three before, its text) of the texts data[offsets[t]:offsets[t + 1]]."""
    n = len(offsets) - 1
    # A line break between texts keeps them apart; in UTF-8 a unit or pair of units begins at each byte that is no continuation.
    sizes = np.diff(offsets)
    body = np.full(len(data) + n, 0x0A, np.uint8)
    body[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = data
    units = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-16-le", "surrogatepass"), "<u2")
    begins = np.where((body & 0xC0) != 0x80, 1, 0) + (body >= 0xF0)
    ends = np.cumsum(begins)[offsets[1:] + np.arange(n)]  # after each text's line break
    symbol = _units()[units]
    blank = symbol == 0x20
    first = np.zeros(len(symbol), bool)
    first[0] = True
    first[ends[:-1]] = True
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep &= ~(first & blank)  # blanks at the beginning are given below
    owner = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))[keep]
    # The line break after a text that does not end in a letter is a blank already dropped.
    symbol, own = symbol[keep].astype(np.uint64), np.flatnonzero(keep)
    key, place = symbol.copy(), np.arange(len(symbol)) - np.searchsorted(owner, owner, "left")
    for back in range(1, ORDER):
        before = np.full(len(symbol), _BLANK)
        before[back:] = np.where(place[back:] >= back, symbol[:-back], _BLANK)
        key |= before << np.uint64(16 * back)
    return key, owner


def _counts(rows: DataFrame) -> DataFrame:
    """(g, text) -> (g, gram, n): how often the language of number g uses each n-gram; tasks add up what they read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            g, gram, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.lexsort((gram, g))
            g, gram, n = g[order], gram[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(gram) != 0) | (np.diff(g) != 0)])) if len(g) else np.zeros(0, int)
            return g[new], gram[new], np.add.reduceat(n, new) if len(new) else n

        def out(part: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1].view(np.int64)), pa.array(part[2])], ["g", "gram", "n"])

        for batch in batches:
            for own, data, offsets in _text.slices(batch, "text"):
                key, owner = grams(data, offsets)
                held.append((np.asarray(own.column(0))[owner].astype(np.int32), key, np.ones(len(key), np.int64)))
                held[:] = [merged()] if sum(len(h[0]) for h in held) > HOLD else held
                if len(held[0][0]) > HOLD:
                    yield out(held.pop())
        if held:
            yield out(merged())

    return rows.select("g", "text").mapInArrow(run, "g int, gram long, n long").groupBy("g", "gram").agg(F.sum("n").alias("n"))


class Model:
    """One language: by order the sorted n-grams with their discounted shares, and the sorted contexts with what they pass on."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, symbols: int):
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(gram)
        gram, n = gram[order], n[order].astype(float)
        for k in range(ORDER, 0, -1):
            ones, twos = float((n == 1).sum()), float((n == 2).sum())
            discount = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
            context, first, kinds = np.unique(gram >> np.uint64(16), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first)
            self.orders.append((gram, ((n - discount).clip(0) / np.repeat(total, kinds)).astype(np.float32), context, (discount * kinds / total).astype(np.float32)))
            # The next order counts the different symbols that stood before.
            gram, n = np.unique(gram & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
            n = n.astype(float)
        self.orders.reverse()
        self.uniform = 1 / symbols

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each n-gram's last symbol after the others."""
        p = np.full(len(gram), self.uniform)
        for k, (keys, share, contexts, pass_on) in enumerate(self.orders, 1):
            key = gram & np.uint64((1 << 16 * k) - 1) if k < ORDER else gram
            context = key >> np.uint64(16)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            p = np.where(known, pass_on[at] * p, p)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            p += np.where(keys[at] == key, share[at], 0)
        return -np.log2(p)


def _sample(known: DataFrame) -> DataFrame:
    """The labelled rows to learn from: all of a language within its budget, else each with one and the same chance."""
    sizes = known.groupBy("lang").agg(F.sum("chars").alias("all"))
    one = sizes.agg(F.count("*")).first()[0]
    budget = float(min(LANGUAGE_CHARS, SAMPLE_CHARS / max(1, one)))
    # A row a language: sent to all tasks while they are few, so that no text is shuffled by its language.
    rates = sizes.select(F.col("lang").alias("__lang"), F.least(F.lit(1.0), F.lit(budget) / F.col("all")).alias("__rate"))
    rates = F.broadcast(rates) if one <= BROADCAST_LANGUAGES else rates
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "chars"), F.lit(1 << 30)) / float(1 << 30)
    # A long text may not make up the sample by itself, where not all can be taken.
    fits = (F.col("__rate") >= 1) | (F.col("chars") <= budget / 8)
    return known.join(rates, known["lang"] == rates["__lang"]).filter((draw < F.col("__rate")) & fits).drop("__lang", "__rate")


class Models:
    """The models of all learnt languages, by name, with their calibration."""

    def __init__(self, names: list[str], models: list[Model]):
        self.names, self.models = names, models
        self.temperature, self.power = 1.0, 0.5
        self.limits = np.full(len(names), np.inf)

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits a symbol by text and language, symbols of each text)."""
        key, owner = grams(data, offsets)
        n = np.bincount(owner, minlength=len(offsets) - 1)
        found, back = np.unique(key, return_inverse=True)
        out = np.zeros((len(n), len(self.models)))
        for g, model in enumerate(self.models):
            each = np.concatenate([model.bits(found[k : k + HOLD]) for k in range(0, len(found), HOLD)]) if len(found) else np.zeros(0)
            out[:, g] = np.bincount(owner, each[back], len(n)) / np.maximum(n, 1)
        return out, n

    def confidence(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The probability of the lowest cross-entropy's language."""
        more = (bits - bits.min(axis=1, keepdims=True)) * (np.maximum(n, 1) ** self.power * self.temperature)[:, None]
        return 1 / np.exp2(-np.minimum(more, 1000)).sum(axis=1)

    def calibrate(self, bits: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """The temperature and power of the least log loss, and by language the limit of usual cross-entropies."""
        best = np.inf
        for power in (0.0, 0.25, 0.5, 0.75, 1.0):
            for temperature in 2.0 ** np.arange(-6, 4.5, 0.5):
                scaled = -bits * (np.maximum(n, 1) ** power * temperature)[:, None] * np.log(2)
                scaled -= scaled.max(axis=1, keepdims=True)
                loss = np.mean(np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(n)), truth])
                if loss < best - 1e-9:
                    best, self.power, self.temperature = loss, power, float(temperature)
        for g in range(len(self.names)):
            own = bits[truth == g, g]
            if len(own):
                self.limits[g] = np.quantile(own, INSIDE) + MARGIN


def _built(names: list[str], g: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Models:
    symbols = len(np.unique(gram & np.uint64(0xFFFF))) + 1
    own = [k for k in range(len(names)) if (g == k).any()]
    return Models([names[k] for k in own], [Model(*_added(gram[g == k], n[g == k]), symbols) for k in own])


def _added(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(gram, return_inverse=True)
    return found, np.bincount(back, n, len(found))


def fit(known: DataFrame) -> Models:
    """known (doc_id, text, lang), no nulls -> models of the sample, calibrated on a tenth of it under models of the rest.

    A language without rows in that tenth, or with no others, is learnt but has no part in the temperature; its limit is the
    highest of the other languages.
    """
    spark = ready(known.sparkSession)
    chars = known.withColumn("chars", F.length("text").cast("long"))
    sample = written(_sample(chars), "language-sample")
    names = [r[0] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not names:
        return Models([], [])
    numbers = spark.createDataFrame([(name, k) for k, name in enumerate(names)], "name string, g int")
    tenth = (F.pmod(F.xxhash64(F.lit("calibrates"), "doc_id", "chars"), F.lit(10)) == 0).cast("int")
    numbers = F.broadcast(numbers) if len(names) <= BROADCAST_LANGUAGES else numbers
    of = sample.join(numbers, F.col("lang") == F.col("name")).withColumn("g", 2 * F.col("g") + tenth)
    # At most the sample's characters; in practice a few hundred thousand n-grams a language.
    found = written(_counts(of), "language-grams").toArrow()
    g, gram, n = (found[c].to_numpy() for c in ("g", "gram", "n"))
    gram, rest = gram.view(np.uint64), g & 1 == 0
    models, fewer = _built(names, g >> 1, gram, n), _built(names, g[rest] >> 1, gram[rest], n[rest])
    if not fewer.names:
        return models
    shared = spark.sparkContext.broadcast(fewer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, offsets in _text.slices(batch, "text"):
                bits, size = shared.value.entropies(data, offsets)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(list(bits), pa.list_(pa.float64())), pa.array(size)], ["lang", "bits", "n"])

    few = of.filter((F.col("g") % 2 == 1) & F.col("lang").isin(fewer.names))
    # The rows are chosen by hash alone; their texts stay where they are.
    hashed = few.select(F.xxhash64("doc_id", "chars").alias("h")).orderBy("h").limit(CALIBRATION_ROWS).distinct()
    few = few.withColumn("h", F.xxhash64("doc_id", "chars")).join(F.broadcast(hashed), "h", "left_semi").select("lang", "text")
    rows = few.mapInArrow(run, "lang string, bits array<double>, n long").toPandas()
    if len(rows):
        fewer.calibrate(np.array(rows["bits"].tolist()), rows["n"].to_numpy(), rows["lang"].map(fewer.names.index).to_numpy())
    models.temperature, models.power = fewer.temperature, fewer.power
    limits = dict(zip(fewer.names, fewer.limits, strict=True))
    most = max((x for x in limits.values() if np.isfinite(x)), default=np.inf)
    models.limits = np.array([limits[name] if np.isfinite(limits.get(name, np.inf)) else most for name in models.names])
    return models


def identify(docs: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score, bits (cross-entropy a symbol), accepted.

    A null text, one without a letter, and any text where nothing was learnt, is `und` with score 0, null bits and not
    accepted.  Equal cross-entropies go to the first name.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(models)
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.when(letter, F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Models = shared.value
        names = pa.array(["und", *known.names])
        for batch in batches:
            for own, data, offsets in _text.slices(batch, "text"):
                none = np.asarray(own.column(1).is_null()) if known.names else np.ones(len(own), bool)
                best, score, low, inside = np.full(len(own), -1), np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own), bool)
                if not none.all():
                    bits, n = known.entropies(data, offsets)
                    best = np.where(none, -1, bits.argmin(axis=1))
                    score = np.where(none, 0, known.confidence(bits, n))
                    low = bits.min(axis=1)
                    inside = ~none & (low <= known.limits[best])
                columns = [own.column(0), names.take(pa.array(best + 1)), pa.array(score), pa.array(low, mask=none), pa.array(inside)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "bits", "accepted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, bits double, accepted boolean")


def predict(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """identify() of all rows of docs, with held_out, learnt from text and lang of the rows outside fold held.

    Null texts and labels teach nothing; a null id is in fold 0; repeated rows are predicted alike; further columns are not read.
    """
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = known.filter((fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found = identify(docs, fit(known), doc_id, text)
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score", "bits", "accepted")


def op11(spark, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))
