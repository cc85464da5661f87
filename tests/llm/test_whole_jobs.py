"""Whole jobs where a shortcut would lose rows, copies, terms or keys."""

from __future__ import annotations

from eventwarden.llm import packing, personal
from tests.llm import brute
from tests.llm.conftest import prose


def test_bins_hold_one_document_of_each_near_copy_group(spark):
    families = [prose(100 + f, 60).split() for f in range(12)]
    rows = []
    for f, base in enumerate(families):
        for k in range(5):
            words = list(base)
            words[9 + 12 * k % 60:10 + 12 * k % 60] = [f"edit{f}x{k}"]
            rows.append((len(rows), f"s{len(rows)}", " ".join(base if k == 0 else words)))
    texts = {i: t for i, _, t in rows}
    component = {i: c for i, _, c in brute.components(list(texts), list(texts.values()))}
    assert len(set(component.values())) < len(texts)
    alone = (len(rows), "alone", prose(7, 40))
    df = spark.createDataFrame([*rows, alone], "doc_id long, source string, text string").repartition(3)
    got = packing.pack(df).collect()
    cluster = {r.doc_id: r.cluster for r in got}
    lonely = cluster.pop(alone[0])
    for i in texts:
        for j in texts:
            assert (component[i] == component[j]) == (cluster[i] is not None and cluster[i] == cluster[j] or i == j)
    bins: dict[int, list] = {}
    for r in got:
        if r.doc_id in component:
            bins.setdefault(r.bin_id, []).append(component[r.doc_id])
    assert all(len(held) == len(set(held)) for held in bins.values())
    assert lonely is None


def test_copies_leave_disclosing_terms_as_they_were(spark):
    days = "one two six ten".split()
    rows = [(i, f"call zyxomat at mail@corp.example.com on day {d}") for i, d in enumerate(days)]
    rows += [(10 + i, f"we call at noon on day five and meet {'a' * i}") for i in range(40)]
    schema = "doc_id long, text string"
    want = {r.doc_id: r.spans for r in personal.find(spark.createDataFrame(rows, schema)).collect()}
    assert all("term:5:12" in want[i] for i in range(len(days)))
    copies = rows + [(100 + i, rows[0][1]) for i in range(200)] + [rows[1]] * 3 + [(400 + i, rows[20][1]) for i in range(50)]
    got = personal.find(spark.createDataFrame(copies, schema).repartition(5)).collect()
    assert len(got) == len(copies)
    assert all(r.spans == want[r.doc_id if r.doc_id < 100 else 0 if r.doc_id < 400 else 20] for r in got)


def test_disclosing_terms_are_marked_and_generalised_in_whole_documents(spark):
    far = " ".join(["we call at noon on day five and meet"] * 3)
    rows = [(i, f"call zyxomat at mail@corp.example.com on day {d} {far} Zyxomat") for i, d in enumerate(("one", "two", "six"))]
    rows += [(5, f"{far} quillon asks lone@corp.example.org {far} quillon")]
    rows += [(10 + i, f"{far} {'a' * i}") for i in range(60)]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows] + [(99, None, None)], "doc_id long, text string, n_chars long")
    texts = {r.doc_id: r for r in personal.sanitised_texts(df.repartition(3)).collect()}
    assert len(texts) == len(rows) + 1 and texts[99].text is None
    for i in range(3):
        assert "zyxomat" not in texts[i].text.lower() and "mail@" not in texts[i].text
        assert "[TERM]" in texts[i].text and texts[i].text.endswith(f"{far} [NAME]") and "[EMAIL]" in texts[i].text
    assert "quillon" not in texts[5].text and texts[5].text.endswith("[TERM]") and "lone@" not in texts[5].text
    assert all(texts[10 + i].text == rows[4 + i][1] for i in range(60))
    assert all(r.n_chars == len(r.text) for r in texts.values() if r.text is not None)
