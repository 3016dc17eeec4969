"""Quality rules from repeated substrings, found with suffix arrays.

A narrow pass: texts are taken in batches, the words of a batch become one
integer sequence in which words of different documents never compare equal,
and prefix doubling sorts all its suffixes at once. Longest common prefixes of
neighbours give, for every start, the longest repeated substring there; the
spans of the maximal repeats are united per document. No row leaves its task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from silkgraph.llm.common import table

#: Base rules: least words, largest share (in hundredths) of words in repeated windows of so many words.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Verdict: repeats of at least so many words count; they may cover this share, and be so long.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 16, 0.25, 400
#: Words whose suffixes are sorted together (one document at least).
BATCH_WORDS = 200_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def longest_repeats(seq: np.ndarray) -> np.ndarray:
    """For each position of ``seq`` the length of the longest substring that starts there and occurs again."""
    n = len(seq)
    if n < 2:
        return np.zeros(n, np.int64)
    ranks = [np.unique(seq, return_inverse=True)[1].astype(np.int64)]
    k = 1
    while ranks[-1].max() < n - 1:
        r = ranks[-1]
        after = np.zeros(n, np.int64)
        after[: n - k] = r[k:] + 1
        ranks.append(np.unique(r * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        k *= 2
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 2, -1, -1):
        r = np.append(ranks[level], -1)  # past the end nothing is equal
        x, y = np.minimum(a + lcp, n), np.minimum(b + lcp, n)
        equal = (r[x] == r[y]) & (x < n) & (y < n)
        lcp += equal.astype(np.int64) << level
    best = np.zeros(n, np.int64)
    best[order[:-1]] = lcp
    best[order[1:]] = np.maximum(best[order[1:]], lcp)
    return best


def spans_union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions in ``[start, start + length)`` of any span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def rules_of(texts: list[str | None]) -> list[tuple]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest."""
    out, held, size = [], [], 0
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        held.append((text or "", words))
        size += len(words)
        if size >= BATCH_WORDS:
            out += batch_rules(held)
            held, size = [], 0
    return out + batch_rules(held)


def batch_rules(held: list[tuple[str, list[bytes]]]) -> list[tuple]:
    ids: defaultdict = defaultdict(count().__next__)
    lengths = np.array([len(w) for _, w in held], np.int64)
    codes = np.fromiter((i for _, w in held for i in map(ids.__getitem__, w)), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(len(held)), lengths)
    best = longest_repeats(doc * (len(ids) + 1) + codes)
    n = len(codes)
    begin = np.concatenate([[0], np.cumsum(lengths)])

    def covered(least: int) -> np.ndarray:
        at = np.flatnonzero(best >= least)
        total = np.concatenate([[0], np.cumsum(spans_union(at, best[at], n))])
        return total[begin[1:]] - total[begin[:-1]]

    repeat, cover = covered(WINDOW), covered(MIN_REPEAT)
    out = []
    for i, (text, words) in enumerate(held):
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        own = best[begin[i] : begin[i + 1]]
        out.append((
            len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            int(repeat[i]), int(cover[i]), int(own.max()) if len(own) else 0,
        ))
    return out


def quality_rules(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Counts and verdict per row of ``docs``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_covered, longest_repeat, base_failed, kept``. Null and
    empty texts have zero counts and fail the base rules. Rows stay as they
    are: repeated ones give a row each. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]
        for pdf in batches:
            texts = [x if isinstance(x, str) else None for x in pdf["text"]]
            out = pd.DataFrame(rules_of(texts), columns=names, index=pdf.index, dtype="int64")
            out.insert(0, "doc_id", pdf["doc_id"])
            out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
            out["kept"] = ~out["base_failed"] & (out["n_covered"] <= max_covered * out["n_words"]) & (out["longest_repeat"] <= max_longest)
            yield out

    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
