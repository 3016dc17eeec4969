"""Operators that SQL can't express, against plain Python on small inputs."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from silkgraph.llm import jaccard_join, language_id, license_scan, packing, quality_classifier, quality_rules, substring
from tests.helpers import SMALL, duck

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents():
    return {r[0]: r[1:] for r in duck(SMALL).execute("select doc_id, text, lang from documents").fetchall()}


def test_longest_repeats():
    rnd = random.Random(1)
    for n in (0, 1, 2, 7, 40):
        seq = np.array([rnd.randrange(3) for _ in range(n)], np.int64)
        want = [max((k for j in range(n) if j != i for k in range(n + 1) if max(i, j) + k <= n and (seq[i : i + k] == seq[j : j + k]).all()), default=0) for i in range(n)]
        assert quality_rules.longest_repeats(seq).tolist() == want


def repeated(w, least):
    """Words in repeats of ``least`` words or more, and the longest repeat, by growing windows."""
    spots, size, longest, hit = list(range(len(w))), 0, 0, set()
    while spots:
        size += 1
        seen = collections.defaultdict(list)
        for k in spots:
            if k + size <= len(w):
                seen[tuple(w[k : k + size])].append(k)
        spots = [k for ks in seen.values() if len(ks) > 1 for k in ks]
        longest = size if spots else longest
        if size == least:
            hit = {p for k in spots for p in range(k, k + size)}
        if size > 60 and spots:  # long repeats by their tail: a longer one covers no more than its windows do
            best = 0
            for ks in seen.values():
                for a, b in zip(ks, ks[1:], strict=False):
                    n = size
                    while b + n < len(w) and w[a + n] == w[b + n]:
                        n += 1
                    best = max(best, n)
            return len(hit), max(best, longest)
    return len(hit), longest


def test_quality_rules(spark, documents):
    got = {r["doc_id"]: r for r in quality_rules.op9_quality_rules(spark, SMALL).collect()}
    for i, (text, _) in documents.items():
        w = text.encode().split()
        runs = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {p for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in text.split("\n") if x.split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert (r["n_covered"], r["longest_repeat"]) == repeated(w, quality_rules.MIN_REPEAT)
        assert r["kept"] == (not r["base_failed"] and r["n_covered"] <= 0.25 * len(w) and r["longest_repeat"] <= 400)


def test_license_places(spark, documents):
    got = {r["doc_id"]: r for r in license_scan.op8_license_scan(spark, SMALL).collect()}
    for i, (text, _) in documents.items():
        w = WORD.findall(text.translate(LOWER))
        places = sorted((k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        templates = {label for label, _, t in license_scan.TEMPLATES for k in range(len(w)) if w[k : k + len(t.split())] == t.split()}
        assert templates <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_key_phrase_decides_on_a_license(spark, documents):
    texts = [
        "Licensed under the MIT License", "Released in May. This package is licensed under the MIT License.", "MIT License, see the file.", "GNU General Public License, version 3", "Covered by the Mozilla Public License.",
        "the MIT has no license", "License MIT", "Permission is hereby granted, free of charge, to all. Released under the MIT License. MIT License", "Apache License Version 2.1", "this is free and unencumbered software", None, "",
    ]
    rows = dict(enumerate([*texts, *[text for text, _ in documents.values()]]))
    words = {i: WORD.findall((t or "").translate(LOWER)) for i, t in rows.items()}
    df = collections.Counter(w for x in words.values() for w in set(x))
    weight = lambda w: np.log((len(rows) + 1) / (df[w] + 1)) + 1e-6
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(12)] == ["mit", "mit", "mit", "gpl,gpl-3.0", "mpl-2.0", "", "", "mit", "", "unlicense", "", ""]
    for i, x in words.items():
        labels, shares = {label for p, label in license_scan.PHRASES.items() if f" {p} " in f" {' '.join(x)} "}, [0.0]
        base = bool(labels)
        for label, text, phrase in license_scan.TEMPLATES:
            t, key = text.split(), phrase.split()
            at = next(k for k in range(len(t)) if t[k : k + len(key)] == key)
            rare = sorted({w for w in t if w in x}, key=lambda w: (-weight(w), w))[: license_scan.RARE_WORDS]
            for k in (k for k in range(len(x)) if x[k : k + len(key)] == key):
                labels.add(label)
                meet = {w for j, w in enumerate(t) if 0 <= k - at + j < len(x) and x[k - at + j] == w}
                shares.append(sum(weight(w) for w in rare if w in meet) / sum(map(weight, rare)))
        assert got[i]["labels"] == ",".join(sorted(labels))
        assert got[i]["score"] == pytest.approx(1.0 if base else max(shares), abs=1e-8)


def test_more_languages_than_a_mask_word(spark):
    names = [f"l{i:02d}" for i in range(70)]
    letter = lambda i, j: chr(0x4E00 + 40 * i + j)
    texts = {(n, v): " ".join("".join(letter(i, (v + x + y) % 30) for y in range(4)) for x in range(40)) for i, n in enumerate(names) for v in range(3)}
    df = spark.createDataFrame([(i, t, n) for i, ((n, _), t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.slots.shape[1] == 2
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, model).collect()}
    assert [got[i] for i in range(len(got))] == [n for n, _ in texts]


def test_masks_counts_and_votes_of_language_filters(documents):
    words = collections.defaultdict(collections.Counter)
    for text, lang in documents.values():
        if text and lang:
            words[lang].update(language_id.letters(text))
    langs = sorted(words)
    grams = collections.defaultdict(int)
    for i, lang in enumerate(langs):
        own = collections.Counter()
        for w, n in words[lang].items():
            for g in language_id.word_grams(w):
                own[g] += n
        for g, n in own.items():
            grams[g] |= (1 << i) if n >= max(2.0, language_id.MIN_SHARE * words[lang].total()) else 0
    model = language_id.Filter(langs, {g: m for g, m in grams.items() if m})
    for g, m in list(grams.items())[::7]:
        assert model.languages(g) & m == m  # a filter has no false negatives
    counter = language_id.Counter(model)
    for text, _ in list(documents.values())[:40]:
        own = [g for w in language_id.letters(text or "") for g in language_id.word_grams(w)]
        assert counter.text(language_id.letters(text or "")).tolist() == [len(own), *[sum(model.languages(g) >> i & 1 for g in own) for i in range(len(langs))]]


def test_edited_license_bodies(spark):
    """Wordings with words changed outside the key phrase keep their label; texts without a licence get none."""
    rnd = random.Random(12)
    rows, want = [], []
    for label, text, phrase in license_scan.TEMPLATES:
        w, key = text.split(), phrase.split()
        at = next(i for i in range(len(w)) if w[i : i + len(key)] == key)
        for edits in (0, 2, 4):
            x = list(w)
            for _ in range(edits):
                i = rnd.choice([*range(at), *range(at + len(key), len(w))] or [-1])
                if i >= 0:
                    x[i] = "changed"
            rows.append(" ".join([*(f"word{rnd.randrange(99)}" for _ in range(20)), *x, "Then more."]))
            want.append(label)
    clean = ["The public must be granted a license by any person, free of use and with all rights to copy, redistribute or modify this work.", "Software in binary forms; version 2, 0 or 3 of the GNU project. A boost, an eclipse, an artistic license."] * 3
    got = spark.createDataFrame(list(enumerate([*rows, *clean])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(got).collect()}
    for i, label in enumerate(want):
        assert label in got[i]["labels"].split(",") and 0 < got[i]["score"] <= 1
        assert set(got[i]["labels"].split(",")) - {label} <= {"gpl", "cc-by", "reserved"}
    assert all(got[len(rows) + i]["labels"] == "" and got[len(rows) + i]["score"] == 0 for i in range(len(clean)))


def test_language_of_held_out_documents(spark, documents):
    got = language_id.op6_language_id(spark, SMALL).collect()
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in documents if language_id.in_fold(i)}
    assert sum(r["lang_pred"] == documents[r["doc_id"]][1] for r in out) >= 0.95 * len(out)


def test_tokens_and_packing(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for i, (text, _) in documents.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    rows = packing.op5_best_fit_packing(spark, SMALL).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    check_places(rows, 4096)
    assert len({r["sequence_id"] for r in rows}) <= 1 + 1.05 * sum(r["length"] for r in rows) / 4096


def check_places(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("text", ["Don't <|endoftext|> İstanbul ΣΑΣ naïve, éa b x—, 3.14   tail...", "l'été; 'tis ###|| ÀÉÎ× ÷,", "\x1c\x85 a\x0bb ﻿", "", None])
def test_word_by_word_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = [text, "a plain one, twice", None, text, "A PLAIN one,", ""]
    ids, begin = packing.WordIds(packing.tokenizer_path()).of(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(begin)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_of_other_tokenizers_and_of_forgotten_words(monkeypatch, documents):
    from tokenizers import Tokenizer

    known = packing.WordIds(packing.tokenizer_path())
    known.ends[:] = False  # as with a tokenizer that doesn't mark the ends of words
    monkeypatch.setattr(packing, "CACHE", 50)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = [t for t, _ in documents.values()][:40]
    for some in (texts[:10], texts[10:], texts[:20]):
        ids, begin = known.of(pa.array(some))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(begin)] == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]


def best_fit_decreasing(lengths, capacity):
    """Number of sequences, one document at a time."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(capacity - x)
        else:
            gaps[gaps.index(fit)] -= x
    return len(gaps)


def draws():
    rnd = random.Random(2)
    for top in (64, 40, 24, 12, 3):
        for _ in range(6):
            yield [rnd.randrange(1, top + 1) for _ in range(rnd.randrange(1, 200))]


def test_a_sweep_that_opens_sequences_is_best_fit_decreasing():
    for lengths in draws():
        places, waiting, _ = packing.sweep([(x, n, 0) for x, n in collections.Counter(lengths).items()], [], 64, 0)
        assert not waiting and max(first for _, first, _ in places) < best_fit_decreasing(lengths, 64)
        used = collections.Counter()
        for _, first, offset in places:
            used[first] += offset == 0
        assert max(used.values()) == 1


def test_sweep_uses_gaps_by_rank_and_leaves_the_rest():
    places, waiting, gaps = packing.sweep([(10, 3, 5), (7, 2, 0)], [(11, 2, 100), (8, 1, 200)], 64, None)
    key = lambda length, rank: ((64 - length) << packing.RANK_BITS) | rank
    assert places == [(key(10, 5), 100, 53), (key(7, 0), 200, 56)]
    assert (waiting, gaps) == ([(10, 1, 7), (7, 1, 1)], [(1, 2, 100), (1, 1, 200)])


def test_packing_of_lengths(spark):
    for lengths in [*list(draws())[::7], [64] * 5, [33] * 9 + [31] * 4 + [1] * 300, [2] * 1000]:
        rows = [(i if i % 5 else None, 0, x, "mine", 7) for i, x in enumerate(lengths)]
        df = spark.createDataFrame(rows, "doc_id long, piece int, length long, __at string, offset int").repartition(3)
        out = packing.pack(df, 64)
        assert out.columns == ["doc_id", "piece", "length", "__at", "sequence_id", "offset"]
        placed = out.collect()
        assert sorted(r["length"] for r in placed) == sorted(lengths) and {r["__at"] for r in placed} == {"mine"}
        check_places(placed, 64)
        best = best_fit_decreasing(lengths, 64)
        assert len({r["sequence_id"] for r in placed}) <= best + max(1, best // 50)


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = (t or "").translate(LOWER).encode().split()
        sets[i] = {tuple(w[j : j + min(k, len(w))]) for j in range(max(1, len(w) - k + 1))} if w else set()
    low = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if a < b and sets[a] and sets[b] and low[a] != low[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    linked = lambda a, b: a != b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    return {i: (len(sets[i]), low[i], sum(bool(linked(i, j)) for j in texts)) for i in texts}


def near_copies(n, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.choice([2, 5, 40, 60, 300]))) for _ in range(6)]
    out = {}
    for i in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        out[i] = " ".join(w)
    return out | {n: "", n + 1: None, n + 2: "one", n + 3: "ONE", n + 4: " "}


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("block,run", [(250_000, 512), (700, 7)])
def test_jaccard_components(spark, monkeypatch, k, num, den, block, run):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard_join, "RUN", run)
    texts = near_copies(90)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_components(df, k, num, den).collect()}
    assert got == brute_components(texts, k, num, den)


def test_compared_sets():
    rnd = random.Random(9)
    for m in (2, 3, 30):
        base = set(range(100))
        bag = [(base - {rnd.randrange(100) for _ in range(rnd.randrange(9))}) | {rnd.randrange(100, 110) for _ in range(rnd.randrange(5))} for _ in range(m)]
        bag += [{rnd.randrange(40) for _ in range(5)} for _ in range(4)]
        for blocks in ([0] * len(bag), [i % 2 for i in range(len(bag))]):
            weight = np.array([rnd.randrange(1, 4) for _ in bag])
            cross = len(set(blocks)) > 1
            sets, n = [np.array(sorted(s), np.uint64) for s in bag], np.array([len(s) for s in bag])
            component, links = jaccard_join.compared(sets, n, np.array(blocks), weight, 90, 100, cross)
            apart = jaccard_join.compared([np.setxor1d(s, sets[0]) for s in sets], n, np.array(blocks), weight, 90, 100, cross)
            assert apart[0].tolist() == component.tolist() and apart[1].tolist() == links.tolist()
            linked = [[j for j in range(len(bag)) if i != j and not (cross and blocks[i] == blocks[j]) and 100 * len(bag[i] & bag[j]) >= 90 * len(bag[i] | bag[j])] for i in range(len(bag))]
            low = list(range(len(bag)))
            for _ in bag:
                low = [min([low[i], *[low[j] for j in js]]) for i, js in enumerate(linked)]
            assert component.tolist() == low and links.tolist() == [int(weight[js].sum()) for js in linked]


def test_filter_of_a_hot_shingle_is_not_dropping_links():
    rnd = random.Random(10)
    sizes = np.sort(np.array([rnd.randrange(20, 60) for _ in range(60)]))
    sets = [np.unique(np.array([rnd.randrange(70) for _ in range(n)], np.uint64)) for n in sizes]
    sets = sorted([*sets, *[s[:-1] for s in sets[:20]]], key=len)
    k = np.array([jaccard_join.sketch(s, 256).view(np.uint64) for s in sets])
    n = np.array([len(s) for s in sets])
    some = jaccard_join.partnered(np.zeros(len(sets), np.int64), n, k, np.ones(len(sets), np.int64), 90, 100)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
                assert some[i] == some[j] >= 0


def brute_repeats(texts, w=50):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - w + 1):
            first.setdefault(tuple(words[i][s : s + w]), i)
    out = {}
    for i, x in words.items():
        hit = {p for s in range(len(x) - w + 1) if first[tuple(x[s : s + w])] < i for p in range(s, s + w)}
        out[i] = b" ".join(v for p, v in enumerate(x) if p not in hit).decode()
    return out


def test_substring_dedup(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    draw = lambda n: [rnd.choice(words) for _ in range(n)]
    shared = [draw(n) for n in (49, 50, 51, 70, 200)]
    texts = {}
    for i in range(40):
        parts = []
        for _ in range(rnd.randrange(4)):
            parts += draw(rnd.randrange(30)) + (s := rnd.choice(shared))[: rnd.choice([len(s), max(1, len(s) - 10)])]
        texts[i] = " ".join(parts)
    texts |= {40: "a " * 120, 41: "a " * 60, 42: None, 43: ""}
    df = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, n long").repartition(3)
    want = brute_repeats(texts)
    got = {r["doc_id"]: r["text"] for r in substring.dedup(df).collect()}
    for i, t in texts.items():
        kept = want[i]
        if kept == " ".join((t or "").split()):
            assert got[i] == t
        elif kept:
            assert got[i] == kept
        else:
            assert i not in got


@pytest.mark.parametrize("batch", [10_000, 1, 3])
def test_passages_repeated_inside_a_document(spark, batch):
    rnd = random.Random(5)
    draw = lambda n: [f"v{rnd.randrange(10**9)}" for _ in range(n)]
    p, q, line, loop = draw(60), draw(60), draw(10), draw(10)
    passage = [*draw(40), *p, *draw(40)]
    texts = {
        3: [*draw(30), *p, *draw(30)], 5: [*passage, *draw(25), *passage, *draw(25), *passage],
        13: [*draw(20), *line * 6, *draw(20)], 15: [*draw(20), *line * 20, *draw(20)],
        23: [*draw(9), *q], 25: [*q, *draw(70), *q, *draw(70), *q], 26: [*loop * 9], 27: [*draw(60), *loop * 30, *draw(60), *loop * 7],
    }
    texts = {i: " ".join(w) for i, w in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["doc_id"]: r for r in substring.dedup_digest(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_repeats(texts)
    assert got[5]["n_removed"] == 180 and got[15]["n_removed"] == 200
    assert {i: r["kept_sha256"] for i, r in got.items()} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in want.items()}


def test_most_common_word_of_the_whole_text():
    rnd = random.Random(6)
    top = lambda words: quality_classifier.features(" ".join(words), quality_classifier.Lexicon({}))[0][quality_classifier.FEATURES.index("top_word")]
    assert top([*map(str, range(4000)), *["same"] * 16000]) == 0.8
    assert top([*["same"] * 3000, *map(str, range(9000))]) == 0.25
    words = [*["same"] * 80, *map(str, range(320))]
    for _ in range(100):
        rnd.shuffle(words)
        assert top(words) == 0.2
    assert top(["one"]) == 1.0 and top([]) == 0.0


def test_site_posteriors_in_plain_python(spark):
    rnd = random.Random(11)
    rows = [(f"h{h}", f"p{p}", rnd.gauss(h - 2, 1), rnd.gauss(-3, 1)) for h in range(5) for p in range(1 + h % 3) for _ in range((40, 3, 1, 25, 2)[h])]
    got = {(r["host"], r["path"]): r for r in quality_classifier.site_posteriors(spark.createDataFrame(rows, "host string, path string, low double, toxic double").repartition(3)).collect()}
    clip = lambda x: min(max(x, quality_classifier.STRENGTH[0]), quality_classifier.STRENGTH[1])
    logit = lambda p: np.log(p / (1 - p))

    def strength(sites):  # rate, n, mean
        total = sum(n for _, n, _ in sites)
        spread = sum(n * (r - m) ** 2 for r, n, m in sites) / total
        noise = sum(m * (1 - m) for _, n, m in sites) / total
        return clip(max(m * (1 - m) for _, _, m in sites) / max(spread - noise, 1e-9) - 1)

    for col, head in ((2, "low"), (3, "toxic")):
        sums = collections.defaultdict(lambda: [0, 0.0])
        for r in rows:
            for key in ((), (r[0],), (r[0], r[1])):
                sums[key][0] += 1
                sums[key][1] += 1 / (1 + np.exp(-r[col]))
        mean = (sums[()][1] + 0.5) / (sums[()][0] + 1)
        hosts = {k[0]: v for k, v in sums.items() if len(k) == 1}
        paths = {k: v for k, v in sums.items() if len(k) == 2}
        kh = strength([(s / n, n, mean) for n, s in hosts.values()])
        host = {h: (kh * mean + s) / (kh + n) for h, (n, s) in hosts.items()}
        kp = strength([(s / n, n, host[k[0]]) for k, (n, s) in paths.items()])
        for k, (n, s) in paths.items():
            p = (kp * host[k[0]] + s) / (kp + n)
            assert got[k][f"site_{head}"] == pytest.approx(p, rel=1e-6) and got[k][f"shift_{head}"] == pytest.approx(logit(p) - logit(mean), rel=1e-6, abs=1e-9)
            if head == "low" and n <= 3:  # a sparse site stays near what is above it
                assert abs(p - host[k[0]]) < abs(s / n - host[k[0]]) / 2


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = duck(sf).execute("select doc_id, quality, toxic from labels").fetchall()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fitted = spark.createDataFrame([r for r in labels if r[0] % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, fitted).collect()}
    unseen = [r for r in labels if not r[0] % 2]
    assert sum((got[i]["p_low"] >= 0.5) == (q == 0) for i, q, _ in unseen) >= 0.9 * len(unseen)
    assert sum((got[i]["p_toxic"] >= 0.5) == (t == 1) for i, _, t in unseen) >= 0.9 * len(unseen)


def test_classifier_on_labels(spark):
    got = {r["doc_id"]: r for r in quality_classifier.op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = duck("/root/testdata/sf0.01").execute("select doc_id, quality, toxic from labels").fetchall()
    right = sum((got[i]["p_low"] >= 0.5) == (q == 0) for i, q, _ in labels)
    assert right >= 0.93 * len(labels)
    clean = [i for i, q, t in labels if q == 1 and t == 0]
    assert sum(got[i]["kept"] for i in clean) >= 0.97 * len(clean)


def test_runs_of_near_copies_are_filtered_a_few_at_a_time():
    """Ten full runs in one frame: the pairs of all of them would take over 100 MB."""
    import tracemalloc

    key = np.repeat(np.arange(10), 2 * jaccard_join.RUN)
    tracemalloc.start()
    first = jaccard_join.partnered(key, np.full(len(key), 100), np.zeros((len(key), jaccard_join.SKETCH), np.uint64), np.ones(len(key), np.int64), 90, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (first == key * 2 * jaccard_join.RUN).all()
    assert peak < 60e6
