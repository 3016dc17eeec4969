"""Language identification with a bit-sliced Bloom filter of n-grams.

The filter is one array of slots; a slot's bit ``l`` belongs to language
``l``, and a slot has as many words of 64 bits as the languages need. The AND of an n-gram's slots is the mask of all languages that contain
it (or seem to). A text's score per language is the number of its n-grams with
that bit, less the number that false positives would give.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.llm.common import table

#: n-gram lengths, in characters of a word between two spaces.
NGRAMS = (2, 3, 4)
#: Slots of the filter (a power of two) and hashes per n-gram.
SLOTS, HASHES = 1 << 20, 3
#: Documents of each language that are learnt from: those with the smallest hashes of their text, this many at most.
FIT_DOCS = 2000
#: An n-gram belongs to a language if this share of the learnt words has it.
MIN_SHARE = 2e-5
#: Words that a worker remembers.
CACHE = 500_000
#: Bits of a count.
FIELD = 40
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text leaves 1 when divided by 3; not for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1)]


def letters(text: str) -> list[str]:
    """Words of a text in lower case, anything but letters taken out of them."""
    return [x for w in text.lower().split() if (x := w if w.isalpha() else "".join(filter(str.isalpha, w)))]


def slots_of(gram: str) -> list[int]:
    h = xxhash.xxh3_128_intdigest(gram.encode("utf-8", "surrogatepass"))
    return [(h >> (40 * k)) % SLOTS for k in range(HASHES)]


class Filter:
    """The fitted filter: ``langs``, ``slots`` (rows of uint64 words of a mask) and the false-positive rate of each language."""

    def __init__(self, langs: list[str], grams: dict[str, int]):
        words = max(1, -(-len(langs) // 64))
        self.langs, self.slots = langs, np.zeros((SLOTS, words), "<u8")
        for gram, mask in grams.items():
            own = np.frombuffer(mask.to_bytes(8 * words, "little"), "<u8")
            for s in slots_of(gram):
                self.slots[s] |= own
        fill = [float(((self.slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))]
        self.false_rate = np.array([f**HASHES for f in fill])

    def languages(self, gram: str) -> int:
        """Mask of the languages that contain the n-gram, or seem to."""
        mask = ~0
        for s in slots_of(gram):
            mask &= int.from_bytes(self.slots[s].tobytes(), "little")
        return mask


class Counter:
    """Popcounts of words: fields of ``FIELD`` bits in one number, of all n-grams and then of each language's."""

    def __init__(self, model: Filter):
        self.model, self.grams, self.words = model, {}, {}

    def gram(self, gram: str) -> int:
        mask = self.model.languages(gram)
        return 1 + sum(1 << (FIELD * (i + 1)) for i in range(len(self.model.langs)) if mask >> i & 1)

    def word(self, word: str) -> int:
        total = 0
        for g in word_grams(word):
            if (x := self.grams.get(g)) is None:
                x = self.grams[g] = self.gram(g)
            total += x
        return total

    def text(self, words: list[str]) -> np.ndarray:
        """n-grams of the words, and how many of them each language has."""
        known = self.words
        if len(known) > CACHE or len(self.grams) > CACHE:
            known.clear()
            self.grams.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.word(w)
        total = sum(map(known.__getitem__, words))
        return np.array([total >> (FIELD * i) & ((1 << FIELD) - 1) for i in range(len(self.model.langs) + 1)], float)


def fit(docs: DataFrame, limit: int = FIT_DOCS) -> Filter:
    """Learn the n-grams of each language from rows with text and ``lang``.

    Learns from at most about ``limit`` documents of each language: those
    whose text has a hash below a threshold set from the language's count, so
    neither order nor partitioning matters. Any number of languages.
    """
    known = docs.where("text is not null and lang is not null").select("lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Filter([], {})
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, limit / counts[k]))])
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(place < share[F.col("lang")])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], int] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for word in letters(text):
                    seen[lang, word] = seen.get((lang, word), 0) + 1
        out: dict[tuple[str, str], int] = {}
        for (lang, word), n in seen.items():
            for g in word_grams(word):
                out[lang, g] = out.get((lang, g), 0) + n
            out[lang, ""] = out.get((lang, ""), 0) + n
        yield pd.DataFrame([(k, g, n) for (k, g), n in out.items()], columns=["lang", "gram", "n"])

    total = sample.mapInPandas(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    words = {r["lang"]: r["n"] for r in total.where("gram = ''").collect()}
    if not words:
        return Filter(langs, {})
    least = F.create_map(*[F.lit(x) for k, n in words.items() for x in (k, max(2.0, MIN_SHARE * n))])
    own = [langs[i : i + 64] for i in range(0, len(langs), 64)]
    bits = [F.create_map(*[F.lit(x) for i, k in enumerate(some) for x in (k, 1 << i if i < 63 else -(1 << 63))]) for some in own]
    # at most 1 / MIN_SHARE n-grams of each length and language pass
    passing = total.where((F.col("gram") != "") & (F.col("n") >= least[F.col("lang")]))
    masks = passing.groupBy("gram").agg(*[F.coalesce(F.bit_or(bit[F.col("lang")]), F.lit(0)).alias(f"m{j}") for j, bit in enumerate(bits)])
    return Filter(langs, {r["gram"]: sum((r[f"m{j}"] & (2**64 - 1)) << (64 * j) for j in range(len(bits))) for r in masks.collect()})


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """``doc_id, lang_pred, score`` for every whole text of ``docs``.

    Null texts, texts without letters and all texts under a model that learnt
    nothing are ``und`` with the score 0. Ties go to the first language by
    name. Only ``text`` is looked at; repeated rows give a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.slots, model.false_rate))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Filter.__new__(Filter)
        m.langs, m.slots, m.false_rate = shared.value
        counter = Counter(m)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = letters(text) if isinstance(text, str) and m.langs else []
                hits = counter.text(words)
                true = np.maximum(0.0, (hits[1:] - hits[0] * m.false_rate) / np.maximum(1e-9, 1 - m.false_rate))
                if not words or not true.sum():
                    out.append((UNKNOWN if not words else m.langs[0], 0.0))
                else:
                    out.append((m.langs[int(true.argmax())], min(1.0, float(true.max() / true.sum()))))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [x for x, _ in out], "score": [s for _, s in out]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def in_fold(doc_id: int) -> bool:
    """The same fold rule outside Spark."""
    return crc32(str(doc_id).encode()) % 3 == 1
