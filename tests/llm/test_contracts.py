"""Each operator on awkward rows (nulls, empty, long, repeated, clashing columns) against plain statements of its contract."""

from __future__ import annotations

from collections import Counter

import pytest

from eventwarden.llm import decontaminate, jaccard, language, packing, personal, quality, secrets, toxicity
from eventwarden.llm.jobs import held_out
from tests.llm import brute


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality_base(messy, messy_rows, labels):
    got = quality.assess(messy.select("doc_id", "text"), quality.fit(messy, labels))
    want = Counter((r[0], *brute.quality_base(r[1])) for r in messy_rows)
    assert rows_of(got, "doc_id", *quality.COUNTS, "base_failed") == want
    assert not got.filter("kept is null or (base_failed and kept)").count()


def test_quality_without_labels_and_without_rows(messy, labels, none):
    model = quality.fit(messy, labels.limit(0))
    assert model.forest is None
    assert quality.assess(messy.select("doc_id", "text"), model).filter("kept = base_failed").count() == 0
    assert quality.assess(none.select("doc_id", "text"), quality.fit(none, labels)).count() == 0
    assert quality.accepted(messy, model).columns == messy.columns


def test_secrets(messy, messy_rows, none):
    got = secrets.scan(messy.select("doc_id", "text"))
    want = Counter()
    for r in messy_rows:
        spans = brute.secret_base(r[1])
        want[(r[0], *(sum(s[0] == k for s in spans) for k in secrets.BASE_KINDS), brute.sha(brute.told(spans)))] += 1
    assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    by_id = {r.doc_id: r.spans for r in got.collect()}
    assert "key:4:" in by_id[15] and "token:" in by_id[15] and by_id[15].count(":") == 4
    assert secrets.scan(none.select("doc_id", "text")).count() == 0


def test_redaction_keeps_columns_and_clean_rows(messy, messy_rows):
    got = secrets.redacted(messy)
    assert got.columns == messy.columns and got.count() == len(messy_rows)
    texts = {r.doc_id: r for r in got.collect()}
    assert texts[0].text == messy_rows[0][1] and texts[4].text is None
    assert "hunter2x" not in texts[14].text and "[ASSIGN]" in texts[14].text and texts[14].n_chars == len(texts[14].text)


def test_personal_data(messy, messy_rows, none):
    got = personal.find(messy)
    want = Counter()
    for r in messy_rows:
        spans = brute.personal_base(r[1])
        want[(r[0], *(sum(s[0] == k for s in spans) for k in personal.BASE_KINDS), brute.sha(brute.told(spans)))] += 1
    assert rows_of(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    assert personal.find(none).count() == 0


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"call zyxomat{'' if i else ''} at mail@corp.example.com on day {w}") for i, w in enumerate(("one", "two", "six"))]
    rows += [(10 + i, "we call at noon on day five and meet") for i in range(40)]
    got = {r.doc_id: r.spans for r in personal.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(3):
        assert "term:5:12" in got[i] and "email:" in got[i]
        assert "term:0:4" not in got[i], "a word of clean documents reveals nothing"
    assert all(not got[10 + i] for i in range(40))


def test_contamination(messy, messy_rows, benchmark, none):
    got = decontaminate.contamination(messy, benchmark)
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    want = Counter((r[0], *v) for r, v in zip(messy_rows, brute.contamination([r[1] for r in messy_rows], items)))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert any(v[-1] and v[3] > 1 for v in want)
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(messy, benchmark.limit(0)).filter("contaminated").count() == 0
    clean = decontaminate.cleaned(messy, benchmark)
    assert clean.columns == messy.columns and clean.count() == sum(n for v, n in want.items() if not v[-1])


def test_jaccard(messy, messy_rows, none):
    got = jaccard.components(messy.filter("doc_id is not null"))
    known = [r for r in messy_rows if r[0] is not None]
    want = Counter(brute.components([r[0] for r in known], [r[1] for r in known]))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
    assert jaccard.components(none).count() == 0
    kept = jaccard.representatives(messy)
    assert kept.columns == messy.columns
    rows = Counter(r.doc_id for r in kept.collect())
    worded = {c for _, n, c in want if n}
    assert {i for i in rows if i is not None} == worded | {i for i, n, _ in want if not n}
    assert all(rows[c] == 1 for c in worded) and rows[None] == 1


def test_language(messy, messy_rows, none):
    model = language.fit(messy.select("doc_id", "text", "lang"))
    got = language.predicted(messy.select("doc_id", held_out().alias("held_out"), "text"), model).collect()
    assert len(got) == len(messy_rows)
    letters = {r[0]: r[1] is not None and any(c.isalpha() for c in r[1]) for r in messy_rows}
    for r in got:
        assert 0 <= r.score <= 1 and (r.doc_id is None or (r.lang_pred == "und") == (not letters[r.doc_id]))
    empty = language.fit(none.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language.predicted(messy.select("doc_id", "text"), empty).collect()} == {"und"}


def test_toxicity_on_awkward_rows(messy, messy_rows, labels, none):
    model = toxicity.fit(messy.select("doc_id", "text"), labels)
    got = toxicity.scored(messy.select("doc_id", "text"), model).collect()
    assert len(got) == len(messy_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (4, 5, 6))
    assert toxicity.fit(none.select("doc_id", "text"), labels) is None
    assert toxicity.scored(none.select("doc_id", "text"), None).count() == 0


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(messy, messy_rows, none, capacity):
    got = packing.pack(messy, capacity=capacity, shard_tokens=8000).collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.n_tokens
    want = Counter()
    for r in messy_rows:
        want[r[0]] += len(brute.SPACED.findall(r[1] or "")) + 1
    assert tokens == want
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.bin_start)
        at = 0
        for r in held:
            assert r.bin_start == at
            at += r.n_tokens
        assert at <= capacity
        clusters = [r.cluster for r in held if r.cluster is not None]
        assert len(clusters) == len(set(clusters)) and len(held) == len({r.source_slot for r in held})
    assert packing.pack(none, capacity=capacity).count() == 0
