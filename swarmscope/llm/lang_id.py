"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes, with counts frozen after training. A byte's probability
is taken in the longest context known to the language; a byte not seen there pays the escape probability of that
context (distinct symbols over total plus distinct) and is looked for in the next shorter one; below the empty context
all 256 bytes are equally likely. A text's code length is the exact sum over its bytes. The language with the least
code length plus the price of its frequency wins; the score is its posterior probability.

Training takes about ``per_language`` documents of each language, those whose id hashes fall under a threshold; their
whole texts are counted on the executors, and the trees collected are bounded by that sample.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if no language was
learnt; null languages and texts teach nothing; ties go to the first language by code point; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmscope.llm import words as W
from swarmscope.llm.memory import lean

ORDER = 3
UNKNOWN = "und"


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the three before it (zeros before a text), as one number; and the texts' offsets."""
    n = np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    padded = np.zeros(at[-1] + ORDER * len(n), np.uint32)
    place = np.arange(at[-1]) + ORDER * (owner + 1)
    padded[place] = data[int(offsets[0]) : int(offsets[-1])]
    code = padded[place]
    for k in range(1, ORDER + 1):
        code = code | (padded[place - k] << np.uint32(8 * k))
    return code, at


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in sorted ``keys``, and whether they hold what was wanted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Trees:
    """Prices in bits of all languages side by side, by context length."""

    def __init__(self, languages: list[str], documents: np.ndarray, counted: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.prior = -np.log2(documents / documents.sum()) if languages else np.zeros(0)
        n_lang = len(languages)
        self.seen: list[np.ndarray] = []  # grams of order + 1 bytes known to any language
        self.price: list[np.ndarray] = []  # of their last byte, escapes included
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []  # nothing where a language does not know the context
        for order in range(ORDER + 1):
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            folded = [np.unique(codes & mask, return_inverse=True) for codes, _ in counted]
            sums = [np.bincount(inverse, n, len(keys)) for (keys, inverse), (_, n) in zip(folded, counted, strict=True)]
            seen = np.unique(np.concatenate([k for k, _ in folded])) if folded else np.zeros(0, np.uint32)
            contexts = np.unique(seen >> np.uint32(8))
            escape = np.zeros((len(contexts), n_lang))
            for_last = seen & np.uint32(0xFF if order == 0 else (1 << (8 * order)) - 1)
            shorter = self.below(for_last, order) if order else np.full((len(seen), n_lang), 8.0)
            price = shorter.copy()
            for lang, ((keys, _), n) in enumerate(zip(folded, sums, strict=True)):
                context = np.searchsorted(contexts, keys >> np.uint32(8))
                total = np.bincount(context, n, len(contexts))
                distinct = np.bincount(context, minlength=len(contexts))
                known = total > 0
                escape[known, lang] = -np.log2(distinct[known] / (total[known] + distinct[known]))
                price[:, lang] += escape[np.searchsorted(contexts, seen >> np.uint32(8)), lang]
                price[np.searchsorted(seen, keys), lang] = -np.log2(n / (total[context] + distinct[context]))
            self.seen.append(seen)
            self.price.append(price.astype(np.float32))
            self.contexts.append(contexts)
            self.escape.append(escape.astype(np.float32))

    def below(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Prices of grams of ``order`` bytes."""
        at, hit = find(self.seen[order - 1], codes)
        if len(self.seen[order - 1]):
            out = self.price[order - 1][at].astype(np.float64)
        else:
            out = np.zeros((len(codes), len(self.languages)))
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] = self.missing(codes[miss], order - 1)
        return out

    def missing(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Prices of grams of ``order`` + 1 bytes that no language knows."""
        at, hit = find(self.contexts[order], codes >> np.uint32(8))
        out = np.where(hit[:, None], self.escape[order][at] if len(self.contexts[order]) else 0.0, 0.0)
        if order == 0:
            return out + 8.0
        return out + self.below(codes & np.uint32((1 << (8 * order)) - 1), order)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        codes, at = grams(data, offsets)
        step = max(1 << 14, (1 << 20) // max(1, len(self.languages)))
        sums = np.zeros((len(offsets) - 1, len(self.languages)))
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for i in range(0, len(codes), step):
            priced = self.below(codes[i : i + step], ORDER + 1)
            own = owner[i : i + step]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums[own[heads]] += np.add.reduceat(priced, heads, axis=0)
        return sums


def fit(docs: DataFrame, learns: Column, per_language: int = 400) -> Trees:
    taught = docs.where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["count"] for r in taught.groupBy("lang").count().collect()}  # one number for each language
    languages = sorted(totals)
    if not languages:
        return Trees([], np.zeros(0), [])
    limit = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / totals[lang]))])
    place = (F.xxhash64("doc_id", F.lit(9)).cast("double") / F.lit(2.0**64)) + 0.5
    sample = taught.where(place <= limit[F.col("lang")]).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                texts = batch.filter(pc.equal(batch.column(0), lang)).column(1)
                for data, offsets in W.buffers(texts):
                    for i, j in W.runs(offsets):
                        codes, n = np.unique(grams(data, offsets[i : j + 1])[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    found = sample.mapInArrow(lean(counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    trees = []
    for lang in languages:
        own = found[found["lang"] == lang].sort_values("gram")
        trees.append((own["gram"].to_numpy(np.uint32), own["n"].to_numpy(np.float64)))
    return Trees(languages, np.array([float(totals[x]) for x in languages]), trees)


def predict(docs: DataFrame, trees: Trees, predicted: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the likeliest language and its posterior probability, in place of any columns of those names."""
    docs = docs.drop(predicted, score)
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    names = docs.columns
    at = names.index("text")
    schema = docs.select("*", F.lit("").alias(predicted), F.lit(0.0).alias(score)).schema
    marked = docs.select("*", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(predicted))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(at)
            letters = batch.column(len(names)).to_numpy(zero_copy_only=False)
            best, sure = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if model.languages:
                parts = [model.bits(data, offsets[i : j + 1]) for data, offsets in W.buffers(texts) for i, j in W.runs(offsets)]
                bits = (np.concatenate(parts) if parts else np.zeros((0, len(model.languages)))) + model.prior
                best = bits.argmin(axis=1)
                sure = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
            known = letters & bool(model.languages)
            langs = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(np.where(known, sure, 0.0))], [*names, predicted, score])

    return marked.mapInArrow(lean(named), schema)
