"""Main text of hand-written pages with and without ``<article>``, awkward class names and missing end tags."""

from __future__ import annotations

import pytest
from pyspark.sql import Row

from eventwarden.llm import html
from tests.llm.conftest import prose

# what belongs to the article starts with K, everything else with D
K = [f"K{i} " + prose(300 + i, n) for i, n in enumerate((48, 9, 75, 31, 120, 22))]
TITLE, NAV = "K a title of some words", "".join(f'<li><a href="/{i}">D{i} menu entry</a></li>' for i in range(6))
COMMENTS = "".join(f"<div class=comment><p>D{i} {prose(700 + i, 26)}</p></div>" for i in range(4))


def marked(tag: str, texts=K) -> str:
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


HEAD = f"<html><head><title>D title</title><script>D x</script></head><body><nav><ul>{NAV}</ul></nav>"
FOOT = f"<footer><p>D copyright notice of the site and its owner</p></footer></body></html>"
SIDE = f'<div class="sidebar"><h3>D popular</h3><ul>{NAV}</ul></div>'
FORM = '<form><label>D your name</label><input><p>D subscribe to our letter</p><button>D go</button></form>'

SHELLS = {
    "article": "<article{c}><h1>{t}</h1>{p}</article>{side}", "main": "<main{c}><h1>{t}</h1>{p}{form}</main>{side}",
    "div": "<div{c}><h1>{t}</h1>{p}</div>{side}", "nested": "<div id=wrapper><div{c}><div><h1>{t}</h1>{p}</div></div></div>{side}",
    "comments": "<div{c}><h1>{t}</h1>{p}</div><div id=comments><h3>D comments</h3>{com}</div>",
    "open ends": "<div{c}><h1>{t}</h1>{open}</div>{side}", "form around": "<form action=x><div{c}><h1>{t}</h1>{p}</div></form>{side}",
    "header": "<div{c}><header><h1>{t}</h1></header>{p}</div>{side}", "table": "<table{c}><tr><td>{p}</td><td>{side}</td></tr></table>",
}
CLASSES = ["", "content has-sidebar", "no-sidebar", "article has-comments", "post-related", "ad-free", "entry no-ads", "notice",
           "with-comments story", "siteContent"]


def blocks(text: str) -> list[str]:
    return [b for b in text.split("\n\n") if b]


@pytest.mark.parametrize("shell", SHELLS)
def test_articles_in_every_shell(shell):
    hit = found = wanted = 0
    for name in CLASSES:
        page = HEAD + SHELLS[shell].format(
            c=f' class="{name}"' if name else "", t=TITLE, p=marked("p"), side=SIDE, form=FORM, com=COMMENTS,
            open="".join(f"<p>{t}" for t in K)) + FOOT
        got = blocks(html.main_text(page))
        want = ([] if shell == "table" else [TITLE]) + K
        assert sum(g in K for g in got) >= len(K) - 1, (name, got)
        hit, found, wanted = hit + sum(g in want for g in got), found + len(got), wanted + len(want)
    f1 = 2 * hit / (found + wanted)
    assert f1 >= 0.95, f1


@pytest.mark.parametrize("opening", [
    "<datalist><option value=x></datalist>", "<video src=x>", "<object data=x>", "<map name=m>", "<svg viewBox=x>", "<button>",
    "<iframe src=x>", "<canvas>", "<math>", "<audio>", "<noscript>", "<select><option>", "<template>"])
def test_elements_without_an_end_hide_nothing(opening):
    got = blocks(html.main_text(f"<body>{opening}<article>{marked('p')}</article></body>"))
    assert got[-len(K):] == K


def test_scripts_run_to_the_end_and_formulas_stay():
    page = f"<article><p>{K[0]} where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p>{K[2]}</p><style>p {{}}"
    assert html.main_text(page + "<p>D rest") == f"{K[0]} where x=2 holds\n\n{K[2]}"
    many = "<svg>" * 20_000 + "<button>" * 20_000 + f"<article>{marked('p')}</article>"
    assert blocks(html.main_text(many))[-len(K):] == K


def test_long_comment_threads_are_no_article():
    thread = "".join(f"<li class=comment><p>D{i} {prose(800 + i, 60)}</p></li>" for i in range(30))
    for shell in ("<div class=post><h1>{t}</h1>{p}</div><section class=comments><ol>{com}</ol></section>",
                  "<article><h1>{t}</h1>{p}</article><section class=comments><ol>{com}</ol></section>"):
        got = blocks(html.main_text(HEAD + shell.format(t=TITLE, p=marked("p", K * 2), com=thread) + FOOT))
        assert not [b for b in got if b.startswith("D")] and set(K) <= set(got)


def test_table_of_awkward_pages(spark):
    page = f"<article>{marked('p')}</article>"
    rows = [Row(page_id=1, url="u", html=page, text="mine", n_chars="x"), Row(page_id=1, url="u", html=page, text="mine", n_chars="x"),
            Row(page_id=None, url=None, html=None, text=None, n_chars=None), Row(page_id=2, url="", html="", text="", n_chars=""),
            Row(page_id=3, url="v", html="<p>" + "<div>" * 5000 + "x" * 300_000, text="t", n_chars="n")]
    schema = "page_id long, url string, html string, text string, n_chars string"
    got = html.extracted(spark.createDataFrame(rows, schema).repartition(2))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect())
    body = "\n\n".join(K)
    assert found[0] == (0, "", 0) and found[1] == found[2] == (1, body, len(body)) and found[3] == (2, "", 0)
    assert html.extracted(spark.createDataFrame([], schema)).count() == 0
