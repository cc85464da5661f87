"""Resampling, BPE and source divergence against plain statements of their contracts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventwarden.llm import bpe, divergence, resample
from eventwarden.llm import words as w
from tests.llm import brute
from tests.llm.conftest import DOCUMENTS, PROSE, prose

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
HARD = ["x<|endoftext|>A <|startoftext|><|endoftext|", "ΣΟΦΟΣ İstanbul é é ½ ٣ 42nd don't WE'LL", "a b\x85c\x1cd e",
        "<|endoftext|>", "'s't're", "​﻿", "ab" * 4000, "日本語テキスト 😀👍🏽", "ﬁne ǅ ß ẞ"]


def features(text):
    words = brute.ALNUM.findall((text or "").translate(brute.LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def resampled(rows, target):
    """[(doc_id, n_features, weight, score)] in row order, and the ranks of drawn rows as a list of such tuples."""
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out, fit = [], []
    for doc_id, text in rows:
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(found), weight, score))
        if len(words) >= 20:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    return Counter(out), Counter((*r, i + 1) for i, r in enumerate(fit[:25 * len(fit) // 100]))


@pytest.mark.parametrize("seed", [1, 2])
def test_buckets_are_crc_with_and_without_a_head(seed):
    texts = [prose(seed, 400) + " É日本 x" + "y" * 300 + " " + "z" * 64 + " " + "Q" * 65, "", "one", "A b\x00c"]
    for part in w.slices(pa.array(texts)):
        found = resample.Features(part)
        counters = resample.Frequent(), resample.Frequent()
        for _ in range(2):
            counters[0].add(found.words.code, found.registers)
            counters[1].add(found.pair_code, lambda at: found.pair_buckets(
                found.pair_first[at], found.registers(found.pair_first[at])))
        half = [(c.code[::2], c.value[::2]) for c in counters]
        words = [x for t in texts for x in features(t)[0]]
        pairs = [x for t in texts for x in features(t)[1][len(features(t)[0]):]]
        for head in (None, resample.head_of(*half)):
            got = found.buckets(head)
            assert got[0].tolist() == [bucket(x) for x in words] and got[1].tolist() == [bucket(x) for x in pairs]


def test_counters_keep_what_is_frequent(monkeypatch):
    monkeypatch.setattr(resample, "COUNTERS", 50)
    rng, counted, exact = random.Random(3), resample.Frequent(), Counter()
    for _ in range(40):
        codes = [rng.choice((1, 2, 3)) if rng.random() < 0.5 else rng.randrange(10, 10_000) for _ in range(200)]
        exact.update(codes)
        counted.add(np.array(codes, dtype=np.uint64), lambda at: at)
    held = dict(zip(counted.code.tolist(), counted.count.tolist()))
    assert len(held) <= 50 and all(0 < n <= exact[c] for c, n in held.items())
    assert all(exact[c] - held.get(c, 0) <= exact.total() / 50 for c in exact)


def test_resampling(spark, messy, messy_rows, benchmark, none):
    rows = [(r[0], r[1]) for r in messy_rows] + [(100 + i, prose(40 + i, 25)) for i in range(30)]
    rows += [(7, prose(50, 30))] * 9 + [(None, prose(51, 30))] * 3
    df = messy.unionByName(spark.createDataFrame([(*r, *[None] * 8) for r in rows[len(messy_rows):]], DOCUMENTS))
    all_rows, ranks = resampled(rows, [r.text for r in benchmark.collect()])
    got = resample.resampled(df.repartition(3), benchmark).collect()
    assert Counter(tuple(r)[:4] for r in got) == all_rows
    assert Counter(tuple(r) for r in got if r.rank) == ranks and ranks
    assert resample.resampled(none, benchmark).count() == 0
    bare = resample.resampled(messy, benchmark.limit(0))
    assert bare.count() == len(messy_rows)
    few = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert {r.rank for r in resample.resampled(few, benchmark).collect()} == {None}


def test_copies_come_back_one_by_one(spark, benchmark, monkeypatch):
    monkeypatch.setattr(resample, "COPIES", 4)
    rows = [(1, prose(1, 30))] * 11 + [(2, prose(2, 30))] * 9
    got = resample.resampled(spark.createDataFrame(rows, "doc_id long, text string"), benchmark, percent=60).collect()
    assert Counter(r.doc_id for r in got) == {1: 11, 2: 9}
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 13))


def test_pair_tree_finds_the_leftmost_least():
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 8, 33):
        ranks = [rng.randrange(6) for _ in range(n)]
        tree = bpe.PairTree(list(ranks))
        for _ in range(60):
            assert tree.least() == min(ranks) and tree.leftmost() == ranks.index(min(ranks))
            i = rng.randrange(n)
            ranks[i] = rng.choice((rng.randrange(6), bpe.NONE))
            tree.put(i, ranks[i])


def test_bpe_is_the_library(spark, messy, messy_rows, none):
    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(7)
    noise = ["".join(rng.choice("ab'sS Σσ éİ\x85​٣½ tT'll\n<|endoftext|>") for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = [(r[0], r[1]) for r in messy_rows] + [(1000 + i, t) for i, t in enumerate(HARD + noise)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, ids array<int>").repartition(3)
    ids = bpe.encoded(df, VOCABULARY)
    assert ids.columns == ["doc_id", "ids"]
    want = Counter()
    for i, t in rows:
        found = library.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(found), library.decode(found, skip_special_tokens=False)] += 1
    got = bpe.decoded(ids.selectExpr("*", "ids as kept"), VOCABULARY).collect()
    assert Counter((r.doc_id, tuple(r.kept), r.decoded) for r in got) == want
    assert bpe.decoded(bpe.encoded(none.select("doc_id", "text"), VOCABULARY), VOCABULARY).count() == 0
    odd = spark.createDataFrame([([0, 99999, -1, 49407],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decoded(odd, VOCABULARY).collect()] == ["! <|endoftext|>", ""]


def test_long_words_merge_in_little_time():
    vocabulary = bpe.Vocabulary(open(VOCABULARY, "rb").read(), bpe.later_signs())
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(100_000))
    assert vocabulary.ids(word) == Tokenizer.from_file(VOCABULARY).encode(word, add_special_tokens=False).ids


def test_only_new_chunks_are_split_into_words():
    vocabulary = bpe.Vocabulary(open(VOCABULARY, "rb").read(), bpe.later_signs())
    library, split, given = Tokenizer.from_file(VOCABULARY), vocabulary.words, []
    vocabulary.words = lambda chunk: given.append(chunk) or split(chunk)
    text = "don't stop, plain don't\u2003STOP,\x1cstop, \x1f don't\x85stop,"
    for _ in range(3):
        assert vocabulary.ids(text) == library.encode(text, add_special_tokens=False).ids
    assert sorted(given) == sorted({"don't", "stop,", "stop,\x1cstop,", "\x1f"})


def audited(rows, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER)))
            for lang, source, t in rows]
    spread, per = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        spread[lang].update(set(terms))
        per[lang, source].update(terms)
        per[lang, None].update(terms)
    share = {}
    for (lang, source), counts in per.items():
        kept = [t for t, n in spread[lang].items() if n >= 3]
        total = sum(counts[t] for t in kept)
        share[lang, source] = {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}
    f = lambda p, q: (p - q) ** 2 // q
    out = set()
    for (lang, source), p in share.items():
        if source is None:
            continue
        pairs = [(other, sum(f(p[t], q[t]) for t in p)) for (lng, other), q in share.items()
                 if lng == lang and other not in (None, source)]
        q = share[lang, None]
        terms = [(t, f(p[t], q[t])) for t in p if per[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])}
    return out


def test_tally_counts_over_slices(monkeypatch):
    monkeypatch.setattr(divergence, "TALLY", 40)
    rng, tally, want, got = random.Random(2), divergence.Tally(), Counter(), Counter()
    for _ in range(30):
        texts = [" ".join(rng.choice(PROSE) for _ in range(rng.randrange(9))) for _ in range(6)]
        lang, source = [rng.choice("xy") for _ in texts], [rng.choice("ab") for _ in texts]
        for part in w.slices(pa.array(texts), rows=4):
            tally.add(part, tally.number(lang[part.first:part.last], source[part.first:part.last]))
            rows = tally.rows().to_pylist() if tally.full() else []
            for r in rows:
                got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
                got[r["lang"], r["source"], r["term"], "held"] += r["held"]
        for a, b, t in zip(lang, source, texts):
            for term, n in Counter(t.split()).items():
                want[a, b, term, "docs"] += 1
                want[a, b, term, "held"] += n
    for r in tally.rows().to_pylist():
        got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        got[r["lang"], r["source"], r["term"], "held"] += r["held"]
    assert got == want and tally.rows().num_rows == 0


@pytest.mark.parametrize("top", [3, 200])
def test_divergence(spark, messy, messy_rows, none, top):
    rng = random.Random(11)
    extra = [(rng.choice(["en", "de", None, ""]), rng.choice(["web", "a", "b", None]), " ".join(
        rng.choice(PROSE + ["Éa", "éa", "zz1zz", "日本"]) for _ in range(rng.randrange(12)))) for _ in range(150)]
    extra += [("xx", "web", "rare"), ("xx", "a", None), ("xx", None, "")] + [("en", "hot", "the fox the fox")] * 60
    df = messy.unionByName(spark.createDataFrame(
        [(i, t, lang, source, *[None] * 6) for i, (lang, source, t) in enumerate(extra)], DOCUMENTS)).repartition(4)
    got = [tuple(r) for r in divergence.audit(df, top=top).collect()]
    want = audited([(r[2], r[3], r[1]) for r in messy_rows] + extra, top)
    assert len(got) == len(set(got)) and set(got) == want
    assert divergence.audit(none).count() == 0
