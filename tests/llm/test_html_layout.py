import random
import re
import time

import pytest

from tidemark.llm import html_layout as H


@pytest.mark.parametrize("source,text", [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>c", "a\nb\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<h1>T</h1>x", "T\n\nx"), ("<b>bo</b>ld <i> it</i>", "bold it"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
    ("<table><tr><th>k<th>value<tr><td>long key<td>1</table>after", "k        | value\nlong key | 1\n\nafter"),
    ("<table><tr><td colspan=2>x<td>y<tr><td>1<td>2<td>3</table>", "x |   | y\n1 | 2 | 3"),
    ("<pre> a\n   b</pre>c", " a\n   b\n\nc"),
    ("x<script>var t='</p>';</script><style>p{}</style><!-- no -->y", "xy"),
    ("<head><title>T</title></head><body>b", "b"), ("<title>T</title><p>b", "b"),
    ("<p style='display:none'>no</p><p hidden>no</p><span aria-hidden=true>drawn</span><div style='VISIBILITY : hidden'>no</div>yes", "drawn\nyes"),
    ("&lt;b&gt; &amp;amp; &copy;&#233;&#x41;", "<b> &amp; ©éA"), ("a &lt b", "a < b"),
    ("<img alt='pic'> <input value=shown><input type=password value=no><textarea>t</textarea>", "pic shown\n\nt"),
    ("a<3 and b>c", "a<3 and b>c"), ("<p class=it's>x</p>y", "x\n\ny"), ("<a href=\"q>r\">l</a>", "l"),
    ("</div>x</p>y", "x\n\ny"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<p>a<table><tr><td>b</table>", "a\n\nb"), ("x<!-- open", "x"), ("x<b", "x"), ("<noscript>n</noscript>z", "z"),
    ("<blockquote>q</blockquote>r", "  q\n\nr"), ("a<hr>b", "a\n\nb"), ("<td>c</td>", "c"), ("<p>日本<p>x", "日本\n\nx"),
])
def test_rendering(source, text):
    assert H.extract(source) == text


@pytest.mark.parametrize("source,text", [
    ("Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold", "Let x=1 hold"), ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>", "1/2"),
    ("<math><semantics><mi>y</mi><annotation encoding=tex>no</annotation></semantics><mphantom>no</mphantom></math>z", "yz"),
    ("<math><mtable><mtr><mtd>a</mtd><mtd>b</mtd></mtr><mtr><mtd>c</mtd></mtr></mtable></math>", "a b c"),
    ("a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><style>no</style><g><text x=1>one</text><text>t<tspan>wo</tspan></text></g><path d='M0'/></svg>b", "a one two b"),
    ("in <select><option>a<option selected>b &amp; c<option>d</select> now", "in b & c now"), ("<select><option disabled>no<optgroup label=no><option>a<option>b</select>", "a"),
    ("<select><option label=shown>no</select>", "shown"), ("<select><option selected disabled>a<option>b</select>", "a"), ("x<select></select>y", "xy"), ("<select hidden><option>no</select>y", "y"),
    ("<select multiple><optgroup label=G><option>a<option>b</optgroup></select>", "G\na\nb"), ("<select size=2><option>a<option hidden>no<option>b</select>", "a\nb"),
    ("<input type=submit value='Send it'> <input type=BUTTON value=Go><input type=image alt=pic> <input type=hidden value=no><input type=checkbox value=no>", "Send it Gopic"),
    ("<table><tr><td><select><option>a<option>b</select><td><math><mi>x</mi></math></table>", "a | x"), ("<table><select><option>a<option>b</select><tr><td>c</table>", "a\nc"),
    ("<pre>p <select><option>a<option>b</select></pre>", "p a"),
])
def test_what_browsers_draw(source, text):
    assert H.extract(source) == text


@pytest.mark.parametrize("source,text", [
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A | b\n  | c"), ("<table><tr><td>a<td rowspan=2>B<td>c<tr><td>d<td>e</table>", "a | B | c\nd |   | e"),
    ("<table><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d<tbody><tr><td>e<td>f</table>", "A | b\n  | c\n  | d\ne | f"), ("<table><tr><td rowspan=9 colspan=2>A<td>b<tr><td>c<tbody><tr><td>x<td>y<td>z</table>", "A |   | b\n  |   | c\nx | y | z"),
    ("<table><tr><td colspan=500>A<tr><td>b</table>", "A\nb"), ("<table><tr><td colspan=junk rowspan=-1>A<td>b</table>", "A | b"), ("<table><tr><td rowspan=2>l1<br>l2<td>x<tr><td>y</table>", "l1 | x\nl2 |\n   | y"),
    ("<style>.h{display:none}#k, p.q {visibility:hidden} i{font-size:0}</style><div class='a h'>no</div><div id=k>no</div><p class=q>no</p><p>yes<i>no<b style='font-size:9px'>big</b><u style='font-size:2em'>no</u></i>", "yesbig"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>", "yes"), ("<div hidden>no<p style='visibility:visible;display:block'>no</p></div>x", "x"),
    ("<style>p{display:none}</style><p style='display:block'>yes</p><style>p{display:none !important}</style>", ""), ("<style>p{display:none}p.x{display:block}</style><p>no</p><p class=x>yes", "yes"),
    ("<style>[hidden]{display:none} div p{display:none} p:hover{display:none} /* p{display:none} */ @media print{p{display:none} q{display:none}} @media screen{b{display:none}}</style><p>yes <q>too</q><b>no</b>", "yes too"),
    ("<style>.f{opacity:0} .t{opacity:0.5}</style><p class=f>no<b style='opacity:1'>no</b></p><p class=t>yes", "yes"), ("<div hidden style='display:block'>yes</div>", "yes"),
    ("<details><summary>s</summary>no<p>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<input placeholder=hint> <input value=v placeholder=no><textarea placeholder=more></textarea>", "hint v\n\nmore"), ("<ol start=4><li>a<li value=9>b<li>c</ol>", "4. a\n9. b\n10. c"), ("<span style='display:block'>a</span><div style='display:inline'>b</div> c", "a\nb c"),
    ("<div>" * 250 + "<p hidden>no</p><table><tr><td>ab<td>cd</table>", "ab | cd"), ("<p>a<noscript>no</noscript>b", "ab"),
])
def test_visibility_and_spans(source, text):
    assert H.extract(source) == text


HIDES = ("hidden", "style='display:none'", "class='n'", "id=gone", "style='visibility:hidden'", "style='visibility:visible'", "class=v", "style='opacity:0'", "style='font-size:0'", "style='font-size:12px'", "aria-hidden=true", "class='other'")
SHEET = "<style>.n{display:none} #gone{display:none} .v{visibility:visible}</style>"


def tree(r, depth, words):
    """(source, visible words) of a random tree, judged by an own walk."""
    def node(depth, seen, size):
        out, got = [], []
        for _ in range(r.randint(1, 4)):
            if depth and r.random() < 0.7:
                a = r.choice(HIDES) if r.random() < 0.4 else ""
                gone = a in HIDES[:4] or "opacity" in a
                vis = False if a == HIDES[4] else True if a in (HIDES[5], HIDES[6]) else seen
                big = False if a == HIDES[8] else True if a == HIDES[9] else size
                tag = r.choice(["div", "p", "span", "ul><li", "table><tr><td", "b", "section"])
                inner, kept = node(depth - 1, vis, big)
                first, _, rest = tag.partition(">")
                closing = "".join(f"</{x}>" for x in reversed(tag.split("><")))
                out.append(f"<{first} {a}>" + (f"<{tag.split('>', 1)[1]}>" if rest else "") + inner + closing)
                got += [] if gone else kept
            else:
                words.append(f"w{len(words)}")
                out.append(f" {words[-1]} ")
                got += [words[-1]] if seen and size else []
        return "".join(out), got

    return node(depth, True, True)


def test_visible_words_of_random_trees():
    for seed in range(150):
        r = random.Random(seed)
        source, want = tree(r, 6, [])
        source = re.sub(r"<p ([^>]*)>", r"<article \1>", source).replace("</p>", "</article>").replace("<p>", "<article>")  # a p ends where a block begins
        assert re.findall(r"w\d+", H.extract(SHEET + source)) == want, source


def test_depth_has_no_limit():
    deep = "<div>" * 20_000 + "<p hidden>no</p>yes" + "</div>" * 20_000
    assert H.extract(deep) == "yes"
    assert H.extract("<ul><li>" * 3000 + "end").split() == ["-", "end"] and H.title("<div>" * 5000 + "<title>t</title>") == "t"
    assert H.extract("<select>" + "<optgroup>" * 3000 + "<option>o") == "o" and "end" in H.extract("<pre>" + "<b>" * 5000 + "end")


def test_wide_characters_align():
    lines = H.extract("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>").split("\n")
    assert lines == ["日本 | x", "abcd | y"]


def test_every_visible_word_stays_whatever_the_nesting():
    deep = "".join(f"<div>w{i}" for i in range(3000)) + "</div>" * 3000 + "<table><tr><td>" * 100 + "end"
    words = H.extract(deep).replace("|", " ").split()
    assert [w for w in words if w.startswith("w")] == [f"w{i}" for i in range(3000)] and words[-1] == "end"


def test_long_and_hostile_input_is_quick():
    start = time.time()
    for bad in ("<style>" + ".a{display:none}" * 30_000 + "</style><p class=a>" * 5, "<table><tr>" + "<td rowspan=99>" * 5000 + "<tr><td>x" * 5000, "<b><table><tr><td>" + "<div>" * 20_000 + "</b>" * 20_000, "<table><tr><td>a<td>" * 5000, "<td colspan=1000>x" * 20_000, "<a \"" * 50_000, "<" * 100_000, "<!--" * 30_000, "&" * 100_000, "<p>" * 50_000, "<b class='" * 30_000):
        H.extract(bad)
        assert time.time() - start < 60


def test_pages(spark):
    rows = [(1, "<p>a</p><p>b</p>", "x", 1), (2, None, None, 2), (2, None, None, 2), (None, "", "", 3)]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, html string, text string, n_lines int")).collect()
    assert sorted((str(r.page_id), r.text, r.n_lines) for r in got) == [("1", "a\n\nb", 3), ("2", "", 0), ("2", "", 0), ("None", "", 0)]
    assert H.extract_pages(spark.createDataFrame([], "page_id long, html string")).collect() == []
