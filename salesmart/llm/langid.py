"""Language identification by character models with interpolated Kneser-Ney smoothing.

One model per language over letters and word boundaries of lower-cased text. All
languages share one sorted array of gram hashes per order, with a row of interpolated
log-probabilities per gram, so a text is looked up once for all of them. The language
with the lowest cross-entropy per symbol wins; a text whose cross-entropy is beyond what
labelled texts of its length show is marked as rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.bpe import slices

ORDER = 4
SAMPLE = 400  # labelled documents per language that a model is learned from
LANGUAGES = 500  # most languages that can be learned at once
START, SPACE = 1, 32
SPREADS, LEAST = 8.0, 0.5  # of the calibrated limit: times from the median to the 90 % quantile, and nats at least
CLASSES = 40  # of lengths, each twice as long as the one before
ENOUGH = 20  # labelled texts from which on a class of lengths has a limit of its own
STEP = 0.01  # nats, of the calibration's histograms
UNKNOWN = "und"
SLICE = 1 << 20  # bytes of text that are looked up together, one text at least
CELLS = 1 << 20  # symbols times languages that are scored at once, also within a text


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts and the number of the text each belongs to; every text begins with START marks."""
    lowered = [t.lower() for t in texts]
    pad = "\x01" * (ORDER - 1)
    codes = np.frombuffer((pad + (" " + pad).join(lowered) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    text = np.repeat(np.arange(len(texts)), [len(t) + ORDER for t in lowered])
    position = np.arange(len(codes)) - np.repeat(np.cumsum([0, *[len(t) + ORDER for t in lowered]])[:-1], [len(t) + ORDER for t in lowered])
    mark = position < ORDER - 1
    letter = _letters()[codes] & ~mark
    symbols = np.where(letter, codes, np.where(mark, START, SPACE)).astype("u4")
    keep = letter | mark
    keep[1:] |= letter[:-1]  # a boundary follows a letter; other signs vanish
    return symbols[keep], text[keep]


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], "u8")


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of grams whose symbols stand in columns, the last symbol last."""
    out = np.full(len(columns[0]), len(columns), "u8")
    for symbols, factor in zip(reversed(columns), _FACTORS):
        out += (symbols.astype("u8") + np.uint64(1)) * factor
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Model:
    """Sorted hashes per order with a row of values per hash and a column per language."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # hashes, log-probabilities; order 1 first
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # hashes, log of what is left for lower orders
    unseen: np.ndarray | None = None  # log-probability of a symbol that no language has
    limits: np.ndarray | None = None  # per language and class of lengths: most nats per symbol

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol, a row per text and a column per language; and the number of symbols."""
        symbols, text = _symbols(texts)
        scored = np.flatnonzero(symbols != START)
        count = np.bincount(text[scored], minlength=len(texts))
        sums = np.zeros((len(texts), len(self.languages)))
        step = max(1, CELLS // len(self.languages))
        for start in range(0, len(scored), step):
            some = scored[start : start + step]
            first, last = text[some[0]], text[some[-1]]
            scores, own = self._log_probabilities(symbols, some), text[some] - first
            for k in range(len(self.languages)):
                sums[first : last + 1, k] += np.bincount(own, scores[:, k], minlength=last - first + 1)
        return -sums / np.maximum(count, 1)[:, None], count

    def _log_probabilities(self, symbols: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """A row per place in ``scored``, a column per language."""
        total = np.zeros((len(scored), len(self.languages)), "f4")
        todo = np.arange(len(scored))
        for order in range(ORDER, 0, -1):
            columns = [symbols[scored[todo] - back] for back in range(order - 1, -1, -1)]
            keys, values = self.grams[order - 1]
            at, hit = _find(keys, _hash(columns))
            total[todo[hit]] += values[at[hit]]
            missed = ~hit
            todo = todo[missed]
            if not len(todo):
                break
            if order > 1:
                keys, values = self.contexts[order - 1]
                at, known = _find(keys, _hash([c[missed] for c in columns[:-1]]))
                total[todo[known]] += values[at[known]]
        total[todo] += self.unseen
        return total


def learn(counts: pd.DataFrame) -> Model:
    """A model from rows of language, gram of the highest order, count."""
    languages = sorted(counts["lang"].unique())
    model = Model(languages)
    symbols = np.frombuffer("".join(counts["gram"]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)
    lang = np.searchsorted(languages, counts["lang"])
    number = counts["n"].to_numpy("f8")
    by_order = []
    for order in range(ORDER, 0, -1):
        by_order.append((symbols, lang, number))
        # Lower orders count in how many different contexts a gram occurs.
        table = pd.DataFrame(symbols[:, 1:], columns=range(order - 1)).assign(lang=lang)
        grouped = table.groupby([*range(order - 1), "lang"], sort=False).size().reset_index(name="n")
        symbols, lang, number = grouped[[*range(order - 1)]].to_numpy("u4"), grouped["lang"].to_numpy(), grouped["n"].to_numpy("f8")
    lower = np.zeros((0, len(languages)))
    known = len(np.unique(by_order[-1][0]))
    for order, (symbols, lang, number) in enumerate(reversed(by_order), start=1):
        n = len(languages)
        keys, first, gram = np.unique(_hash([*symbols.T]), return_index=True, return_inverse=True)
        count = np.zeros((len(keys), n))
        np.add.at(count, (gram, lang), number)
        if order == 1:
            context_keys, context, owner = np.zeros(1, "u8"), np.zeros(len(symbols), "i8"), np.zeros(len(keys), "i8")
            below = np.full((len(keys), n), 1 / (known + 1))
        else:
            context_keys, context = np.unique(_hash([*symbols[:, :-1].T]), return_inverse=True)
            owner = context[first]
            below = lower[_find(model.grams[-1][0], _hash([*symbols[first, 1:].T]))[0]]
        total, types = np.zeros((len(context_keys), n)), np.zeros((len(context_keys), n))
        np.add.at(total, (context, lang), number)
        np.add.at(types, (context, lang), 1)
        ones = np.array([max(1, (number[lang == k] == 1).sum()) for k in range(n)])
        twos = np.array([(number[lang == k] == 2).sum() for k in range(n)])
        discount = np.minimum(ones / (ones + 2 * twos), 0.95)
        left = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        if order == 1:
            model.unseen = (np.log(left[0]) - np.log(known + 1)).astype("f4")
        lower = np.maximum(count - discount, 0) / np.maximum(total, 1)[owner] + left[owner] * below
        model.grams.append((keys, np.log(lower).astype("f4")))
        model.contexts.append((context_keys, np.log(left).astype("f4")))
    return model


def held_out(key: str) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, key: str, salt: int, size: int) -> DataFrame:
    """Up to ``size`` learnable documents of each language, by the order of a hash; a bounded table."""
    chosen = (
        docs.where(~held_out(key) & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select(key, "lang", F.xxhash64(key, F.lit(salt)).alias("_h"))
        .withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("_h", key)))
        .where(F.col("_n") <= size)
        .select(key)
    )
    return docs.where(~held_out(key) & F.col("lang").isNotNull()).join(F.broadcast(chosen.distinct()), key, "left_semi").select("lang", "text")


def fit(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Learn from the labelled documents that are not held out; None where there are none.

    The model uses up to ``sample`` documents per language, whole texts, whose gram counts the
    driver gets; the limits follow from quantiles over all of them, from histograms that
    add up, so that some wrongly labelled texts move no limit.
    """
    if docs.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1):
            found: dict[str, Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in some.columns)):
                symbols, _ = _symbols([text or ""])
                data = symbols.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                if len(data) >= ORDER:
                    found.setdefault(lang, Counter()).update(data[i : i + ORDER] for i in range(len(data) - ORDER + 1))
            rows = [(lang, gram, n) for lang, grams in found.items() for gram, n in grams.items()]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "gram": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})

    counts = _sample(docs, key, 1, sample).mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    model = learn(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1, SLICE):
            entropy, n = shared.value.cross_entropy([x or "" for x in some.column(1).to_pylist()])
            told = pd.DataFrame({"lang": some.column(0).to_pylist(), "class": length_class(n), "bin": (entropy.min(axis=1) / STEP).astype("i8"), "n": n})
            told = told[told["n"] > 0].groupby(["lang", "class", "bin"]).size().reset_index(name="n")
            yield pa.RecordBatch.from_arrays([pa.array(told["lang"], pa.string()), *(pa.array(told[c].astype("i8")) for c in ("class", "bin", "n"))], ["lang", "class", "bin", "n"])

    labelled = docs.where(~held_out(key) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    seen = labelled.mapInArrow(measure, "lang string, class bigint, bin bigint, n bigint").groupBy("lang", "class", "bin").agg(F.sum("n").alias("n")).toPandas()
    shared.unpersist()
    model.limits = np.stack([_limits(own if len(own := seen[seen["lang"] == lang]) else seen) for lang in model.languages])
    return model


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, np.log2(np.maximum(n, 1)).astype("i8"))


def _limits(seen: pd.DataFrame) -> np.ndarray:
    """The limit of each class of lengths from rows of class, bin of the histogram, count.

    A class of too few texts has the limit of the nearest shorter one, and if there is none
    that of the nearest longer one, with the distance from the median growing as the root
    of the lengths' ratio; without any class of enough texts all lengths are one.
    """

    def quantiles(rows: pd.DataFrame) -> tuple[float, float]:
        rows = rows.groupby("bin")["n"].sum().sort_index()
        reached = rows.cumsum().to_numpy() / rows.sum()
        middle, high = (STEP * (rows.index[np.searchsorted(reached, q - 1e-12)] + 1) for q in (0.5, 0.9))
        return middle, max(SPREADS * (high - middle), LEAST)

    if seen.empty:
        return np.full(CLASSES, np.inf)
    enough = {int(c): quantiles(rows) for c, rows in seen.groupby("class") if rows["n"].sum() >= ENOUGH}
    enough = enough or {int(np.average(seen["class"], weights=seen["n"])): quantiles(seen)}
    out = np.zeros(CLASSES)
    for c in range(CLASSES):
        near = max((k for k in enough if k <= c), default=min(enough))
        middle, more = enough[near]
        out[c] = middle + more * 2 ** (max(0, near - c) / 2)
    return out


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``, from nothing but the whole text.

    ``lang_pred`` is a learned language, or ``und`` with score 0 for a text that is null or
    has no letter (and for all texts if nothing was learned). ``score`` is the posterior of
    that language under equal priors. ``rejected`` marks ``und`` and texts whose
    cross-entropy per symbol exceeds the calibrated limit for their length. Repeated rows
    stay; existing columns of these names are replaced. No shuffle.
    """
    added = ["lang_pred", "score", "rejected"]
    kept = [c for c in docs.columns if c not in added]
    docs = docs.select(*kept)
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.languages, object)
        for some in slices(batches, at, SLICE):
            entropy, n = shared.value.cross_entropy([x or "" for x in some.column(at).to_pylist()])
            best = entropy.argmin(axis=1)
            lowest = entropy.min(axis=1)
            score = 1 / np.exp(-n[:, None] * (entropy - lowest[:, None])).sum(axis=1)
            rejected = (n == 0) | (lowest > shared.value.limits[best, length_class(n)])
            lang = np.where(n > 0, names[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lang, pa.string()), pa.array(np.where(n > 0, score, 0.0)), pa.array(rejected)], [*kept, *added])

    return docs.mapInArrow(run, schema)
