"""HTML trees: implied end tags, scopes, escapes, quotes."""

import time

import pytest

from quirespark.sources.html import to_markdown


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<ul><li>a<li>b</ul>", "* a\n* b"),
        ("<ul><li>a<ul><li>x<li>y</ul><li>b</ul>", "* a\n  * x\n  * y\n* b"),
        ("<ol><li><p>a<p>b<li>c</ol>d", "1. a\n\nb\n2. c\n\nd"),
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\n\nd"),
        ("<p>a<h2>b</h2>c", "a\n\n## b\n\nc"),
        ("<p>a</b></i></td></li>b</p>", "ab"),
        ("<b>x<i>y</b>z</i>w", "**x*y***zw"),
        ("<b>x<strong>y</strong></b>", "**xy**"),
        ("<s>x</s> <del></del>", "~~x~~"),
        ("<blockquote><p>a<p>b<blockquote>c</blockquote></blockquote>d", "> a\n>\n> b\n>\n> > c\n\nd"),
        ("<table><tr><th>h<th>k<tr><td>1<td>2|3<tbody><tr><td>x</table>", "| h | k |\n| --- | --- |\n| 1 | 2\\|3 |\n| x |  |"),
        ("<table><tr><td>a<table><tr><td>b<td>c</table>d</td><td>e</table>", "| a b c d | e |\n| --- | --- |"),
        ("<table><tr><td>a</p></table><p>b", "| a |\n| --- |\n\nb"),
        ("<table><caption>t</caption><tr><td>a</table>", "t\n\n| a |\n| --- |"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "a\n\nb\n\nc"),
        ("<code>a`b</code> <kbd>k</kbd>", "``a`b`` `k`"),
        ("<pre>\na\n b ``` c</pre>", "````\na\n b ``` c\n````"),
        ("a<br>b<hr>c<img alt=x src=y>", "a\nb\n\n---\n\nc![x](y)"),
        ("<li>alone", "* alone"),
        ("<td>alone", "alone"),
        ("<p/>x<script>no</script><style>no", "x"),
        ("", ""),
    ],
)
def test_trees(page, want):
    assert to_markdown(page)[0] == want


def test_escapes():
    page = "<p>2*3 a_b [x] <code>a_b*c</code> <a href='u_v*w'>t_u</a> <img src='a_b.png'></p><pre>a_b</pre><table><tr><td>*|*</table>"
    text, _ = to_markdown(page, escape=True)
    assert text == "2\\*3 a\\_b [x] `a_b*c` [t\\_u](u_v*w) ![](a_b.png)\n\n```\na_b\n```\n\n| \\*\\|\\* |\n| --- |"
    assert "2*3 a_b" in to_markdown(page)[0]


def test_linear_time():
    start = time.process_time()
    to_markdown("<b>" * 8000 + "</i>" * 8000 + "x")
    to_markdown("<ul><li>" * 400 + "x")
    to_markdown("<table><tr><td>" * 300 + "x")
    to_markdown("<p>a" * 20_000 + "</b>" * 20_000)
    assert time.process_time() - start < 20


def test_titles():
    assert to_markdown("<title>T &amp; U</title>x") == ("x", "T & U") and to_markdown(None) == ("", None)
