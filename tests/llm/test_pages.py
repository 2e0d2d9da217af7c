"""Laid-out page text."""

import pytest

from driftlens.llm.pages import extract_pages, visible_text

CASES = [
    ("<p>a<p>b<br>c<div>d</div>e", "a\n\nb\nc\n\nd\ne"),
    ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol><li>three</ul>after", "- one\n- two\n  3. x\n  4. y\n- three\n\nafter"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>fig &amp; plum<td>12</table>tail", "Name        Qty\napple       3\nfig & plum  12\n\ntail"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide     z\na     b  c"),
    ("<table><tr><td>x<table><tr><td>in<td>ner</table>y<td>z</table>", "x in ner y  z"),
    ("<pre>a\n  b\n\nc</pre>x", "a\n  b\n\nc\n\nx"),
    ("<p hidden>no</p><div style='display: none'>no<b>n</b></div><span>yes</span> <i>it</i> is", "yes it is"),
    ("<head><title>t</title><style>p{}</style></head><body>body<script>var a='</p>';</script> text<!-- c > d --> end", "body text end"),
    ("<b>x<p>y</b>z", "x\n\ny\n\nz"),
    ("a &lt;b&gt; &copy; 5 < 6 && 7", "a <b> © 5 < 6 && 7"),
    ("<h1>T</h1>\n\n<p>one   two\nthree</p>  ", "T\n\none two three"),
    ("</div></td>text</p>", "text"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\nb\nc\nd"),
    ("<select><option>one<option>two</select>", "one\ntwo"),
    ("a&nbsp;&nbsp;b", "a  b"),
    ("x<br><br>y", "x\n\ny"),
    ("<a title='1 > 0'>link</a>", "link"),
    (None, ""), ("", ""), ("plain", "plain"), ("<!-- open", ""), ("<p", ""),
]


@pytest.mark.parametrize("page, want", CASES)
def test_layout(page, want):
    assert visible_text(page) == want


def test_only_the_attributes_hidden_and_style_hide():
    shown = ['class="nav hidden md:flex"', "title='a hidden gem'", 'data-style="display:none"', 'data-x="style=display:none"', "alt=x data-hidden", 'style="--display: none"',
             'style="display:none;display:block"', 'style="/* display:none */"', 'aria-hidden="false"']
    for attrs in shown:
        assert visible_text(f"<div {attrs}>a<b>b</b></div>c") == "ab\nc", attrs
    for attrs in ["hidden", 'HIDDEN=""', "hidden=until-found id=x", 'id="x"hidden', "class='a' Style='color:red; DISPLAY : none'", "style=visibility:hidden", 'style="display&#58;none"',
                  'style="display:none !important;display:block"']:
        assert visible_text(f"<div {attrs}>a<b>b</b></div>c") == "c", attrs
    assert visible_text('<ol data-start=7 title="start=9"><li>x</ol>') == "1. x"


def test_text_of_drawings_and_formulas():
    chart = '<svg viewBox="0 0 9 9">loose<title>t</title><defs><text>no</text></defs><path d="M0"/><text x="1">North <tspan>12</tspan></text><text>South<![CDATA[ <9]]></text></svg>'
    assert visible_text(f"<p>Sales</p>{chart}<p>end</p>") == "Sales\n\nNorth 12\nSouth <9\n\nend"
    assert visible_text("a <svg><foreignObject><p>in</p></foreignObject></svg> b").split() == ["a", "in", "b"]
    assert visible_text("<p>if <math><semantics><mrow><mi>x</mi><mo>&lt;</mo><mn>3</mn></mrow><annotation>x<3</annotation></semantics></math> then") == "if x<3 then"
    assert visible_text("x<svg/>y<svg><path d='M0'><p>z") == "xy\n\nz"
    assert visible_text("<svg display=none><text>no</text></svg>yes") == "yes"


def test_depth_and_length():
    assert visible_text("<div>" * 30_000 + "deep") == "deep"
    assert visible_text("<ul><li>" * 2_000 + "item").endswith("- item")
    assert len(visible_text("<p>" + "word " * 300_000).split()) == 300_000


def test_all_text_is_kept():
    page = "<nav><a>n1</a></nav><article><h2>t1</h2>x1<ul><li>l1</ul><table><tr><td>c1<td>c2</table></article><footer>f1</footer>"
    assert visible_text(page).split() == ["n1", "t1", "x1", "-", "l1", "c1", "c2", "f1"]


def test_query(spark):
    rows = [(i, p, "t") for i, (p, _) in enumerate(CASES)] + [(0, CASES[0][0], "t")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted([(i, w) for i, (_, w) in enumerate(CASES)] + [(0, CASES[0][1])])
