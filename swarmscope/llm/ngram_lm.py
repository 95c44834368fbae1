"""Language-model scores from an Elias-Fano n-gram trie.

All training documents are counted, up to three words. Word ids are ranks of word hashes. The trie is cut into shards
by ranges of (first word, second word), at quantiles of a sample, so that no frequent first word makes a large shard.

A shard's files hold, for its bigrams in order: second words, packed; quantised probabilities and back-off weights; and
monotone pointers in Elias-Fano form, from first words to their bigrams and from bigrams to their trigrams. A trigram's
third word is stored by its place among the successors of its second word, in few bits, and found by searching only the
successors of its context. Scoring tasks memory-map the files and look up each batch's distinct bigrams and trigrams.

Probabilities are interpolated by absolute discounting, down to a uniform share for unknown words; log10 values of
bigrams and trigrams are quantised to 8 bits, of words to 16.

Defined results: a null text is empty, and an empty text is just its end token; rows whose ``learns`` is null do not
teach; without training documents every word has probability 1; repeated rows count each; a text of any length is one
sequence; more than 2^31 different words are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmscope.llm import words as W
from swarmscope.llm.elias_fano import EliasFano, pack_bits, small, unpack_bits, unsmall
from swarmscope.llm.files import map_arrays, write_arrays
from swarmscope.llm.memory import lean, lean_group
from swarmscope.llm.storage import discard, drop, new_path, save

END = int(W.mix(np.array([0xE4D], np.uint64))[0])
DISCOUNT = 0.75
STEP = 28.0  # quantised: -log10(p) in steps of 1 / 28, in 8 bits; of words in steps of 1 / 4096, in 16 bits
WORD_STEP = 4096.0
SAMPLE = 64
COUNTED_WORDS, SCORED_WORDS = 2_000_000, 1_000_000  # in memory at once


def token_batches(texts: pa.Array, batch_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes of consecutive documents, an end after each, and the documents' offsets; about so many words at once."""
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    total = 0
    for _, _, words, at in W.documents(texts):
        n = np.diff(at) + 1
        to = np.concatenate([[0], np.cumsum(n)])
        tokens = np.full(to[-1], END, np.uint64)
        tokens[np.arange(len(words)) + np.repeat(np.arange(len(n)), n - 1)] = words
        held.append(tokens)
        sizes.append(n)
        total += len(tokens)
        if total >= batch_words:
            yield np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            held, sizes, total = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEP), 0, 255).astype(np.uint8)


@dataclass
class Model:
    """Where the files are; numbers of the whole; and a few numbers for each shard."""

    folder: str
    tokens: int
    words: int
    word_bounds: np.ndarray  # least hash of each vocabulary shard but the first
    word_base: np.ndarray  # first id of each vocabulary shard, and the number of words
    cuts: np.ndarray  # least (first word, second word) of each trie shard but the first, as hashes: n x 2
    first_keys: np.ndarray | None = None  # the cuts as ids: n x 2
    bigram_base: np.ndarray | None = None  # number of each trie shard's first bigram

    @property
    def shards(self) -> int:
        return len(self.cuts) + 1

    def vocabulary(self, shard: int) -> dict:
        return map_arrays(f"{self.folder}/words-{shard:06d}")

    def bigrams(self, shard: int) -> dict:
        return map_arrays(f"{self.folder}/bigrams-{shard:06d}")

    def trigrams(self, shard: int) -> dict:
        return map_arrays(f"{self.folder}/trigrams-{shard:06d}")

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; the number of words for unknown ones."""
        out = np.full(len(hashes), self.words, np.int64)
        ends = np.concatenate([[0], np.searchsorted(hashes, self.word_bounds), [len(hashes)]])
        for shard in np.flatnonzero(np.diff(ends)).tolist():
            known = self.vocabulary(shard)["hashes"]
            if len(known):
                some = hashes[ends[shard] : ends[shard + 1]]
                at = np.minimum(np.searchsorted(known, some), len(known) - 1)
                out[ends[shard] : ends[shard + 1]] = np.where(known[at] == some, at + self.word_base[shard], self.words)
        return out

    def of_words(self, name: str, ids: np.ndarray) -> np.ndarray:
        """An array of the vocabulary at ids that are in order save for unknown words, for which it is 0."""
        known = ids < self.words
        if not known.all():
            out = np.zeros(len(ids))
            out[known] = self.of_words(name, ids[known])
            return out
        out = np.zeros(len(ids))
        ends = np.searchsorted(ids, self.word_base)
        for shard in np.flatnonzero(np.diff(ends)).tolist():
            out[ends[shard] : ends[shard + 1]] = self.vocabulary(shard)[name][ids[ends[shard] : ends[shard + 1]] - self.word_base[shard]]
        return out

    def unknown(self) -> float:
        """log10 probability of a word that was not learnt."""
        return float(np.log10(DISCOUNT * self.words / self.tokens / (self.words + 1))) if self.tokens else 0.0

    def shard_of(self, key: np.ndarray) -> np.ndarray:
        cuts = (self.first_keys[:, 0] << 32) | self.first_keys[:, 1]
        return np.searchsorted(cuts, key, side="right")

    def find_bigrams(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs in order: the bigram's number or -1, its log10 probability, and log10 of its back-off weight."""
        node, price, weight = np.full(len(first), -1, np.int64), np.zeros(len(first)), np.zeros(len(first))
        ends = np.searchsorted(self.shard_of((first << 32) | second), np.arange(self.shards + 1))
        for shard in np.flatnonzero(np.diff(ends)).tolist():
            here = slice(ends[shard], ends[shard + 1])
            level = self.bigrams(shard)
            at = search(level["pointers"], first[here] - level["first"], level["seconds"], level["width"], second[here])
            hit = np.flatnonzero(at >= 0)
            node[here][hit] = at[hit] + self.bigram_base[shard]
            price[here][hit] = level["price"][at[hit]] / -STEP
            weight[here][hit] = level["weight"][at[hit]] / -STEP
        return node, price, weight

    def starts(self, words: np.ndarray) -> np.ndarray:
        """The number of the first bigram of each word that begins one; words in order."""
        out = np.zeros(len(words), np.int64)
        shard = np.searchsorted(self.first_keys[:, 0], words, side="left")  # where (word, 0) lies
        for s in np.unique(shard).tolist():
            here = shard == s
            level = self.bigrams(s)
            local = words[here] - level["first"]
            out[here] = level["pointers"].get(np.clip(local, 0, level["pointers"].n - 1)).astype(np.int64) + self.bigram_base[s]
        return out

    def find_trigrams(self, context: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of contexts (bigram numbers, in order) and places among the successors of their last word: found, log10 p."""
        found, price = np.zeros(len(context), bool), np.zeros(len(context))
        ends = np.searchsorted(context, np.append(self.bigram_base, np.int64(2**62)))
        for shard in np.flatnonzero(np.diff(ends)).tolist():
            here = slice(ends[shard], ends[shard + 1])
            level = self.trigrams(shard)
            at = search(level["pointers"], context[here] - self.bigram_base[shard], level["places"], level["width"], place[here])
            found[here] = at >= 0
            price[here] = np.where(at >= 0, level["price"][np.maximum(at, 0)] / -STEP, 0.0) if len(level["price"]) else 0.0
        return found, price


def search(pointers: EliasFano, context: np.ndarray, packed: np.ndarray, width: int, wanted: np.ndarray) -> np.ndarray:
    """Where in its context's successors each wanted value stands, or -1; contexts in order, some perhaps out of range."""
    out = np.full(len(context), -1, np.int64)
    step = 1 << 16
    for i in range(0, len(context), step):
        own, want = context[i : i + step], wanted[i : i + step].astype(np.uint64)
        distinct, which = np.unique(own, return_inverse=True)
        inside = (distinct >= 0) & (distinct < pointers.n - 1)
        bounds = np.zeros((2, len(distinct)), np.int64)
        some = distinct[inside]
        bounds[:, inside] = pointers.get(np.concatenate([some, some + 1])).astype(np.int64).reshape(2, -1)
        low, end = bounds[0][which], bounds[1][which]
        high = end.copy()
        on = np.flatnonzero(low < high)
        while len(on):
            middle = (low[on] + high[on]) >> 1
            less = unpack_bits(packed, width, middle) < want[on]
            low[on] = np.where(less, middle + 1, low[on])
            high[on] = np.where(less, high[on], middle)
            on = on[low[on] < high[on]]
        good = np.flatnonzero(low < end)
        good = good[unpack_bits(packed, width, low[good]) == want[good]]
        out[i + good] = low[good]
    return out


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[heads], np.add.reduceat(count, heads) if len(key) else count


def count_words(train: DataFrame, folder: str, tokens_per_shard: int) -> Model:
    """Write the vocabulary and choose where to cut the trie."""
    documents = train.count()
    shards = max(1, -(-documents * 512 // tokens_per_shard))
    bounds = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, _ in token_batches(batch.column(0), COUNTED_WORDS):
                key, count = np.unique(tokens, return_counts=True)
                ends = np.concatenate([[0], np.searchsorted(key, bounds), [len(key)]])
                made = [(s, key[ends[s] : ends[s + 1]].tobytes() + count[ends[s] : ends[s + 1]].astype(np.int64).tobytes()) for s in np.flatnonzero(np.diff(ends)).tolist()]
                # about one pair of neighbours in 1024, by the hash of the pair and its place
                some = np.flatnonzero(W.mix(tokens[:-1] * np.uint64(3) + tokens[1:] + np.arange(len(tokens) - 1).astype(np.uint64)) < np.uint64(2**54))
                made.append((-1, tokens[some].tobytes() + tokens[some + 1].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], ["shard", "packed"])

    parts = save(train.select("text").mapInArrow(lean(counted), "shard long, packed binary"), "lm-words")

    def written(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        both = [np.frombuffer(b.as_buffer(), np.uint64).reshape(2, -1) for b in rows["packed"]]
        key, count = merged([b[0] for b in both], [b[1].view(np.int64) for b in both])
        write_arrays(f"{folder}/counts-{shard:06d}", {"hashes": key, "counts": count})
        return pa.table({"shard": [shard], "words": [len(key)], "tokens": [int(count.sum())]})

    done = save(parts.where("shard >= 0").groupBy("shard").applyInArrow(lean_group(written), "shard long, words long, tokens long"), "lm-vocabulary")
    about = {r["shard"]: r for r in done.collect()}  # one row for each shard
    for s in set(range(shards)) - set(about):
        write_arrays(f"{folder}/counts-{s:06d}", {"hashes": np.zeros(0, np.uint64), "counts": np.zeros(0, np.int64)})
    n_words = [about[s]["words"] if s in about else 0 for s in range(shards)]
    tokens, words = sum(r["tokens"] for r in about.values()), sum(n_words)
    if words >= 2**31:
        raise ValueError("more than 2^31 different words")
    # quantiles of the sampled pairs: every so many of them, at most 200,000 in all
    sampled = parts.where("shard < 0")
    keep = min(1.0, 200_000 / max(1, tokens / 1024))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(1):
                pair = np.frombuffer(b.as_buffer(), np.uint64).reshape(2, -1)
                some = (W.mix(pair[0] ^ (pair[1] * np.uint64(5))) >> np.uint64(11)) <= keep * 2.0**53
                yield pa.RecordBatch.from_arrays([pa.array(pair[0][some].view(np.int64)), pa.array(pair[1][some].view(np.int64))], ["a", "b"])

    pairs = sampled.mapInArrow(lean(thinned), "a long, b long").toPandas().to_numpy(np.int64).reshape(-1, 2).view(np.uint64)
    drop(parts)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pieces = max(1, -(-tokens // tokens_per_shard))
    cuts = np.unique(pairs[[len(pairs) * i // pieces for i in range(1, pieces)]], axis=0) if len(pairs) and pieces > 1 else np.zeros((0, 2), np.uint64)
    return Model(folder, tokens, words, bounds, np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64), cuts)


def probabilities_of_words(model: Model, spark) -> None:
    """Add each word's probability to the vocabulary files."""
    folder, tokens, words = model.folder, model.tokens, model.words

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["shard"].tolist():
                known = map_arrays(f"{folder}/counts-{shard:06d}")
                p = (known["counts"] - DISCOUNT) / tokens + DISCOUNT * words / tokens / (words + 1)
                price = np.minimum(np.rint(-np.log10(p) * WORD_STEP), 65535).astype(np.uint16)
                write_arrays(f"{folder}/words-{shard:06d}", {"hashes": known["hashes"], "counts": known["counts"], "price": price})
            yield batch

    n = len(model.word_base) - 1
    spark.range(n, numPartitions=min(n, 1024)).select(F.col("id").alias("shard")).mapInPandas(lean(written), "shard long").agg(F.count("*")).collect()


def halves(x: np.ndarray) -> list[bytes]:
    return [(x & 0xFFFF).astype(np.uint16).tobytes(), (x >> 16).astype(np.uint16).tobytes()]


def count_ngrams(train: DataFrame, model: Model) -> DataFrame:
    """shard, packed: each batch's trigrams, from (first, second) on; the word number ``words`` stands after an end."""
    sent = train.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for tokens, at in token_batches(batch.column(0), COUNTED_WORDS):
                distinct, which = np.unique(tokens, return_inverse=True)
                del tokens
                ids = own.ids(distinct).astype(np.uint32)[which]
                del distinct, which
                last = np.zeros(len(ids), bool)
                last[at[1:] - 1] = True
                first = np.flatnonzero(~last).astype(np.int32)
                pair = ids[first].astype(np.int64) << 32
                pair |= ids[first + 1]
                third = np.where(last[first + 1], np.uint32(own.words), ids[np.minimum(first + 2, len(ids) - 1)])
                del ids, last, first
                pairs, code = np.unique(pair, return_inverse=True)
                del pair
                code = (code << 32) | third
                del third
                code, count = np.unique(code, return_counts=True)
                owner, third = code >> 32, code & 0xFFFFFFFF
                begins = np.searchsorted(owner, np.arange(len(pairs) + 1))
                ends = np.searchsorted(own.shard_of(pairs), np.arange(own.shards + 1))
                made = []
                for s in np.flatnonzero(np.diff(ends)).tolist():
                    p = slice(ends[s], ends[s + 1])
                    t = slice(begins[ends[s]], begins[ends[s + 1]])
                    firsts, n_seconds = np.unique(pairs[p] >> 32, return_counts=True)
                    head = np.array([len(firsts), ends[s + 1] - ends[s], t.stop - t.start], np.int64)
                    parts = [head.tobytes(), firsts.astype(np.uint32).tobytes(), n_seconds.astype(np.uint32).tobytes(), *halves(pairs[p] & 0xFFFFFFFF)]
                    parts += [np.diff(begins[ends[s] : ends[s + 1] + 1]).astype(np.uint32).tobytes(), *halves(third[t]), count[t].astype(np.uint32).tobytes()]
                    body = b"".join(parts)
                    made.append((s, len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], ["shard", "packed"])

    return train.select("text").mapInArrow(lean(counted), "shard long, packed binary")


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first << 32 | second), third and count of packed trigrams."""
    blob = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n1, n2, n3 = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    at = 24

    def take(kind, n):
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out.astype(np.int64)

    first = np.repeat(take(np.uint32, n1), take(np.uint32, n1))
    second = take(np.uint16, n2) | (take(np.uint16, n2) << 16)
    many = take(np.uint32, n2)
    third = take(np.uint16, n3) | (take(np.uint16, n3) << 16)
    return np.repeat((first << 32) | second, many), third, take(np.uint32, n3)


def build(train: DataFrame, model: Model) -> Model:
    """Write both levels of the trie; the model with what scoring needs of them."""
    spark, folder, words, tokens = train.sparkSession, model.folder, model.words, model.tokens
    flat = np.unique(model.cuts.ravel())
    ids = np.array([int(i) for i in model.ids(flat)], np.int64)
    model.first_keys = ids[np.searchsorted(flat, model.cuts)] if len(model.cuts) else np.zeros((0, 2), np.int64)
    sent = spark.sparkContext.broadcast(model)

    wide = int(words).bit_length()

    def write_raw(shard: int, owner: np.ndarray, third: np.ndarray, count: np.ndarray, n: int) -> None:
        offsets = EliasFano.of(np.searchsorted(owner, np.arange(n + 1)), SAMPLE)
        write_arrays(f"{folder}/raw-{shard:06d}", {"pointers": offsets, "thirds": pack_bits(third, wide)} | {f"count.{k}": v for k, v in small(count).items()})

    def bigrams(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        parts = [unpacked(b.as_buffer().to_pybytes()) for b in rows["packed"]]
        pair, third, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
        del parts
        pairs, rank = np.unique(pair, return_inverse=True)
        del pair
        code, count = merged([(rank.astype(np.int64) << 32) | third], [count])
        owner, third = code >> 32, code & 0xFFFFFFFF
        seen = np.bincount(owner, count, len(pairs)).astype(np.int64)
        real = third != words
        followed = np.bincount(owner[real], count[real], len(pairs))
        distinct = np.bincount(owner[real], minlength=len(pairs))
        weight = quantised(np.log10(np.where(followed > 0, DISCOUNT * distinct / np.maximum(followed, 1), 1.0)))
        first, second = pairs >> 32, pairs & 0xFFFFFFFF
        base = int(first[0]) if len(first) else 0
        offsets = np.searchsorted(first, np.arange(base, (int(first[-1]) if len(first) else base) + 2))
        width = wide
        write_arrays(f"{folder}/bigrams-{shard:06d}", {"pointers": EliasFano.of(offsets, SAMPLE), "seconds": pack_bits(second, width), "weight": weight} | {f"seen.{k}": v for k, v in small(seen).items()}, first=base, width=width)
        write_raw(shard, owner[real], third[real], count[real], len(pairs))
        used = np.unique(first)
        totals = np.add.reduceat(seen, np.searchsorted(first, used)) if len(used) else np.zeros(0)
        n = np.diff(np.append(np.searchsorted(first, used), len(first)))
        # words cut by a shard's border are finished with their other parts
        return pa.table({"shard": [shard], "bigrams": [len(pairs)], "words": [used.astype(np.uint32).tobytes()], "totals": [totals.astype(np.float64).tobytes()], "kinds": [n.astype(np.int64).tobytes()]})

    made = count_ngrams(train, model).groupBy("shard").applyInArrow(lean_group(bigrams), "shard long, bigrams long, words binary, totals binary, kinds binary")
    made = save(made, "lm-bigrams")
    sizes = {r["shard"]: r["bigrams"] for r in made.select("shard", "bigrams").collect()}  # one row for each shard
    for s in set(range(model.shards)) - set(sizes):
        nothing = EliasFano.of(np.zeros(1, np.int64), SAMPLE)
        write_arrays(f"{folder}/bigrams-{s:06d}", {"pointers": nothing, "seconds": pack_bits(np.zeros(0, np.int64), 1), "weight": np.zeros(0, np.uint8)} | {f"seen.{k}": v for k, v in small(np.zeros(0, np.int64)).items()}, first=0, width=1)
        write_raw(s, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    model.bigram_base = np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(model.shards)])])[:-1].astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                used, totals, n = np.frombuffer(row["words"], np.uint32).astype(np.int64), np.frombuffer(row["totals"]), np.frombuffer(row["kinds"], np.int64)
                ends = np.searchsorted(used, own.word_base)
                made = [(s, used[a:b].tobytes() + totals[a:b].tobytes() + n[a:b].tobytes()) for s, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], ["shard", "packed"])

    def weights(rows: pa.Table) -> pa.Table:
        own = sent.value
        shard = rows["shard"][0].as_py()
        base, n = int(own.word_base[shard]), int(own.word_base[shard + 1] - own.word_base[shard])
        totals, kinds = np.zeros(n), np.zeros(n)
        for b in rows["packed"]:
            data = np.frombuffer(b.as_buffer(), np.int64).reshape(3, -1)
            np.add.at(totals, data[0] - base, data[1].view(np.float64))
            np.add.at(kinds, data[0] - base, data[2])
        known = map_arrays(f"{folder}/words-{shard:06d}")
        weight = quantised(np.log10(np.where(totals > 0, DISCOUNT * kinds / np.maximum(totals, 1), 1.0)))
        write_arrays(f"{folder}/contexts-{shard:06d}", {"weight": weight, "totals": totals, "price": known["price"], "counts": known["counts"], "hashes": known["hashes"]})
        return pa.table({"shard": [shard]})

    packed = made.select("words", "totals", "kinds").mapInArrow(lean(spread), "shard long, packed binary")
    done = {r["shard"] for r in packed.groupBy("shard").applyInArrow(lean_group(weights), "shard long").collect()}
    for s in set(range(len(model.word_base) - 1)) - done:
        known = map_arrays(f"{folder}/words-{s:06d}")
        n = len(known["counts"])
        write_arrays(f"{folder}/contexts-{s:06d}", {"weight": np.zeros(n, np.uint8), "totals": np.zeros(n), "price": known["price"], "counts": known["counts"], "hashes": known["hashes"]})

    model = Trie(**vars(model))
    again = spark.sparkContext.broadcast(model)

    def priced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = again.value
        for batch in batches:
            for shard in batch["shard"].tolist():
                level = map_arrays(f"{folder}/bigrams-{shard:06d}")
                n = len(level["weight"])
                firsts = np.repeat(np.arange(level["pointers"].n - 1) + level["first"], np.diff(level["pointers"].all().astype(np.int64)))
                seconds = unpack_bits(level["seconds"], level["width"], np.arange(n)).astype(np.int64)
                order = np.argsort(seconds, kind="stable")
                lower = np.zeros(n)
                lower[order] = own.of_words("price", seconds[order]) / -WORD_STEP
                total = own.of_words("totals", firsts)
                weight = own.of_words("weight", firsts) / -STEP
                p = np.maximum(unsmall(level, "seen") - DISCOUNT, 0) / np.maximum(total, 1) + 10.0 ** (weight + lower)
                write_arrays(f"{folder}/priced-{shard:06d}", {k: level[k] for k in ("pointers", "seconds", "weight")} | {"price": quantised(np.log10(p))}, first=level["first"], width=level["width"])
            yield batch

    shards = spark.range(model.shards, numPartitions=min(model.shards, 4096)).select(F.col("id").alias("shard"))
    shards.mapInPandas(lean(priced), "shard long").agg(F.count("*")).collect()
    discard(spark, f"{folder}/words-*")
    discard(spark, f"{folder}/bigrams-*")

    def trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = again.value
        for batch in batches:
            for shard in batch["shard"].tolist():
                raw, level = map_arrays(f"{folder}/raw-{shard:06d}"), own.bigrams(shard)
                n = len(level["weight"])
                offsets = raw["pointers"].all().astype(np.int64)
                owner = np.repeat(np.arange(n), np.diff(offsets))
                third, count = unpack_bits(raw["thirds"], wide, np.arange(len(owner))).astype(np.int64), unsmall(raw, "count")
                second = unpack_bits(level["seconds"], level["width"], owner).astype(np.int64)
                order = np.lexsort((third, second))
                node, lower, _ = own.find_bigrams(second[order], third[order])
                place, below = np.zeros(len(owner), np.int64), np.zeros(len(owner))
                distinct, which = np.unique(second[order], return_inverse=True)
                place[order], below[order] = node - own.starts(distinct)[which], lower
                followed = np.bincount(owner, count, n)
                p = (count - DISCOUNT) / np.maximum(followed[owner], 1) + 10.0 ** (level["weight"][owner] / -STEP + below)
                width = int(place.max()).bit_length() if len(place) else 0
                write_arrays(f"{folder}/trigrams-{shard:06d}", {"pointers": raw["pointers"], "places": pack_bits(place, width), "price": quantised(np.log10(p))}, width=width)
            yield batch

    shards.mapInPandas(lean(trigrams), "shard long").agg(F.count("*")).collect()
    discard(spark, f"{folder}/raw-*")
    return model


class Trie(Model):
    """A finished model."""

    def vocabulary(self, shard: int) -> dict:
        return map_arrays(f"{self.folder}/contexts-{shard:06d}")

    def bigrams(self, shard: int) -> dict:
        return map_arrays(f"{self.folder}/priced-{shard:06d}")


def fit(docs: DataFrame, learns: Column, tokens_per_shard: int = 2_000_000) -> Trie:
    """Learn from the texts of ``docs`` for which ``learns`` holds."""
    train = docs.where(learns).select("text")
    folder = new_path(docs.sparkSession, "ngrams")
    model = count_words(train, folder, tokens_per_shard)
    if not model.tokens:
        return Trie(**vars(model))
    probabilities_of_words(model, docs.sparkSession)
    discard(docs.sparkSession, f"{folder}/counts-*")
    return build(train, model)


def log_probabilities(own: Trie, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents: tokens that were learnt, and log10 probabilities by add-one unigrams and by the model."""
    distinct, which = np.unique(tokens, return_inverse=True)
    which = which.astype(np.int32)
    of_distinct = own.ids(distinct)
    del distinct
    sums = lambda x: np.add.reduceat(x, at[:-1])
    known = of_distinct < own.words
    n_known = sums(known.astype(np.int64)[which])
    base = sums(np.log10((own.of_words("counts", of_distinct) + 1) / (own.tokens + own.words + 1))[which])
    out = np.where(known, own.of_words("price", of_distinct) / -WORD_STEP, own.unknown())[which]
    weight = own.of_words("weight", of_distinct) / -STEP
    start = np.zeros(len(which), bool)
    start[at[:-1]] = True
    second = np.flatnonzero(~start).astype(np.int32)
    pair = of_distinct[which[second - 1]] << 32
    pair |= of_distinct[which[second]]
    pair, rank = np.unique(pair, return_inverse=True)
    rank_at = np.full(len(which), len(pair), np.int32)  # of the pair that a token ends; tokens without one have none's number
    rank_at[second] = rank
    del rank
    node, price, back = (np.append(x, last) for x, last in zip(own.find_bigrams(pair >> 32, pair & 0xFFFFFFFF), (-1, 0.0, 0.0), strict=True))
    del pair
    pairs = rank_at[second]
    out[second] = np.where(node[pairs] >= 0, price[pairs], weight[which[second - 1]] + out[second])
    del pairs, price
    third = second[~start[second - 1]]
    del second, start
    third = third[node[rank_at[third - 1]] >= 0]
    plain = out[third] + back[rank_at[third - 1]]
    full = np.flatnonzero(node[rank_at[third]] >= 0)
    if len(full):
        context, last = rank_at[third[full] - 1], rank_at[third[full]]
        middle = of_distinct[which[third[full] - 1]]
        words, at_word = np.unique(middle, return_inverse=True)
        place = node[last] - own.starts(words)[at_word]
        del middle, words, at_word, last
        context = node[context]
        order = np.lexsort((place, context))
        found, price = own.find_trigrams(context[order], place[order])
        plain[full[order]] = np.where(found, price, plain[full[order]])
    out[third] = plain
    return n_known, base, sums(out)


def score(docs: DataFrame, model: Trie) -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score (log10 probability of the text), in place of any of those names."""
    more = ["n_tokens", "n_known", "base_score", "score"]
    docs = docs.drop(*more)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    place = names.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for tokens, at in token_batches(batch.column(place), SCORED_WORDS):
                nothing = np.zeros(len(at) - 1)
                parts.append([np.diff(at), *(log_probabilities(sent.value, tokens, at) if sent.value.tokens else (nothing.astype(np.int64), nothing, nothing))])
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)] if parts else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *more])

    shape = docs.select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    return docs.mapInArrow(lean(scored), shape.schema)
