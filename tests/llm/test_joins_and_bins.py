"""The n-gram join under hot shingles, components by contraction, and packing within shards."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np

from eventwarden.llm import components, jaccard, packing
from tests.llm import brute
from tests.llm.conftest import prose


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(4)
    names = rng.sample(range(10**9), 3000)
    links = [(a, b) for a, b in zip(names[:1500], names[1:1500])]  # one path
    links += [(names[1500], n) for n in names[1501:2000]]  # one star
    links += [(names[i], names[i + 1]) for i in range(2000, 2999, 2)] + [(5, 5), links[0], (links[1][1], links[1][0])]
    got = {r.id: r.label for r in components.labelled(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    want = {n: min(names[:1500]) for n in names[:1500]} | {n: min(names[1500:2000]) for n in names[1500:2000]}
    want |= {n: min(names[i:i + 2]) for i in range(2000, 2999, 2) for n in names[i:i + 2]}
    assert got == want
    assert components.labelled(spark.createDataFrame([], "a long, b long")).count() == 0


def crowd(n: int, seed: int = 0) -> list[str]:
    """Texts that share one passage, some of them near copies of each other."""
    rng, passage, texts = random.Random(seed), prose(900, 40), []
    for i in range(n):
        words = prose(1000 + i % (2 * n // 3), 90).split()
        words[rng.randrange(90)] = f"edit{i}"
        texts.append(" ".join(words) + " " + passage)
    return texts + [passage] * 9 + [passage + f" and {i}" for i in range(20)]


def test_hot_shingles_lose_no_link(spark):
    texts = crowd(90)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = Counter(tuple(r) for r in jaccard.components(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter(brute.components(list(range(len(texts))), texts))


def test_only_entries_that_may_be_similar_meet(spark):
    spot = lambda n, place: n << jaccard.PLACE_BITS | place
    rows = [(1, 0, 10, spot(100, 0)), (1, 0, 11, spot(130, 0)),  # sizes too far apart
            (2, 0, 10, spot(100, 11)), (2, 0, 12, spot(100, 11)),  # 89 shingles from here on
            (3, 0, 10, spot(100, 11)), (3, 0, 12, spot(100, 12)),  # 88
            (4, 0, 10, spot(100, 3)), (4, 0, 11, spot(130, 3)), (4, 0, 13, spot(100, 2)), (4, 0, 13, spot(100, 2)),
            (5, 0, 10, spot(100, 0)), (6, 7, 10, spot(100, 20))]
    rows += [(7, 0, i, spot(1 + 9 * i, 0)) for i in range(jaccard.PAIRED + 1500)]  # more than a batch, looked through by trees
    df = spark.createDataFrame(rows, jaccard.ENTRIES)
    got = Counter(tuple(r) for r in jaccard._meeting(df).collect())
    want = [(2, 10, 100), (2, 12, 100), (4, 10, 100), (4, 13, 100), (6, 10, 100)]
    assert got == Counter(want + [(t, i, s >> jaccard.PLACE_BITS) for t, _, i, s in rows if t == 7])


def test_the_first_common_shingle_of_similar_sets_stays():
    rng = random.Random(8)
    for _ in range(200):
        base = rng.sample(range(1000), rng.randrange(5, 60))
        sets = [sorted(set(base) - set(rng.sample(base, rng.randrange(4))) | set(rng.sample(range(1000), rng.randrange(5))))
                for _ in range(rng.randrange(2, 9))]
        rows = sorted((code, 0, i, len(held) << jaccard.PLACE_BITS | place) for i, held in enumerate(sets)
                      for place, code in enumerate(held) if place < len(held) - -(-80 * len(held) // 100) + 1)
        left = {(r[0], r[2]) for r, stays in zip(rows, jaccard._matched(np.array(rows, dtype=np.int64))) if stays}
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = set(a) & set(b)
                if 100 * len(both) >= 80 * len({*a, *b}):
                    assert {(min(both), i), (min(both), j)} <= left


def test_sets_meet_only_within(spark):
    texts = crowd(60)
    rows = [(i, t, i % 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {jaccard.WITHIN} long").repartition(3)
    sized = jaccard.sets_of(df)
    label = jaccard.clusters(df, sized)
    got = {}
    for r in sized.filter("bucket is null").join(label, "set_id").select("doc_id", "label").collect():
        got.setdefault(r.label, set()).add(r.doc_id)
    want = []
    for part in range(3):
        mine = [i for i in range(len(texts)) if i % 3 == part]
        groups: dict[int, set] = {}
        for i, _, c in brute.components(mine, [texts[i] for i in mine]):
            groups.setdefault(c, set()).add(i)
        want += groups.values()
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_similar_documents_share_no_bin_in_any_shard(spark):
    texts = crowd(120, 3)
    df = spark.createDataFrame([(i, f"s{i % 50}", t) for i, t in enumerate(texts)],
                               "doc_id long, source string, text string").repartition(3)
    got = packing.pack(df, capacity=512, shard_tokens=4000).collect()
    assert len({r.bin_id >> 32 for r in got}) > 2 and {r.doc_id for r in got} == set(range(len(texts)))
    bins: dict[int, list[int]] = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    sets = [brute.shingles(t) for t in texts]
    for held in bins.values():
        for i, a in enumerate(held):
            for b in held[i + 1:]:
                both = len(sets[a] & sets[b])
                assert 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)


def test_clusters_hold_links_across_shards(spark):
    texts = crowd(120, 3)
    df = spark.createDataFrame([(i, f"s{i % 50}", t) for i, t in enumerate(texts)],
                               "doc_id long, source string, text string").repartition(3)
    rows = packing.pack(df, capacity=512, shard_tokens=4000).collect()
    assert len({r.bin_id >> 32 for r in rows}) > 2
    got: dict = {}
    for r in rows:
        if r.cluster is not None:
            got.setdefault(r.cluster, set()).add(r.doc_id)
    want: dict = {}
    for doc, _, component in brute.components(list(range(len(texts))), texts):
        want.setdefault(component, set()).add(doc)
    assert sorted(map(sorted, got.values())) == sorted(sorted(held) for held in want.values() if len(held) > 1)


def test_given_clusters_are_kept_apart(spark):
    df = spark.createDataFrame([(i, f"s{i}", prose(i, 20)) for i in range(12)], "doc_id long, source string, text string")
    given = spark.createDataFrame([(i, i % 3 if i < 9 else None) for i in range(12)], "doc_id long, cluster int")
    bins: dict[int, list] = {}
    for r in packing.pack(df, clusters=given).collect():
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    assert sum(map(len, bins.values())) == 12
    assert all(len({i % 3 for i in held if i < 9}) == len([i for i in held if i < 9]) for held in bins.values())


def test_a_hot_cluster_packs_in_little_time():
    began, bins = time.time(), packing.Bins(2048)
    for i in range(200_000):
        bins.place(21, (i % 977,), (1,))
    assert len(bins.filled) == 200_000
    for i in range(50_000):
        bins.place(20, (i % 977,), None)
    assert len(bins.filled) == 200_000 and time.time() - began < 30
