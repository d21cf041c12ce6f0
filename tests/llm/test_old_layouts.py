"""Main text of pages laid out by cells, fonts and line breaks; layouts written by hand, not by the templates."""

import re

import pytest

from tallyspark.llm import op8_html

A = "The committee met on Tuesday to discuss the plan for the new harbour, which has been delayed twice. Members said that the cost had risen sharply since last year."
B = "A second vote is expected in the spring, when the engineers are to give their report on the sea wall. Until then no work will begin on the eastern side of the bay."
MENU = "<a href=/>Home</a><br><a href=/n>News</a><br><a href=/c>Contact</a>"
#: Main text stands between [ and ].
OLD = [
    f'<table><tr><td width=120>{MENU}</td><td width=480>[{A}<br><br>{B}]</td></tr></table>',
    f'<table><tr><td>{MENU}</td><td><font face=arial>[{A}<br><br>{B}]</font></td></tr></table>',
    f'<table width=100%><tr><td bgcolor=#eee>{MENU}</td><td>[{A}<br><br>{B}]</td></tr></table>',
    f'<center><h1>[Harbour plan delayed]</h1><font size=2>[{A}<br><br>{B}]</font></center>',
    f'<body bgcolor=white>{MENU}<hr><font size=3>[{A}<br><br>{B}]</font><hr>Copyright 2001 x',
    f'<table><tr><td colspan=2>My home page</td></tr><tr><td>{MENU}</td><td><b>[Harbour plan</b><br>{A}<br><br>{B}]</td></tr><tr><td colspan=2>(c) 2002 by me</td></tr></table>',
    f'<div align=center><table><tr><td><h2>[Harbour news]</h2></td></tr><tr><td>[{A}<br>{B}<br><br>{A}]</td></tr></table></div>',
    f'<div>{MENU}</div><div>[{A}<br><br>{B}]</div><div><a href=/p>Privacy</a> <a href=/t>Terms</a></div>',
    f'<center>{MENU}</center><blockquote>[{A}<br><br>{B}<br><br>{A}]</blockquote>',
    f'<table><tr><td><img src=l.gif></td><td><a href=/>Site name</a></td></tr></table><table><tr><td valign=top>{MENU}</td><td valign=top>[{A}]<p>[{B}]</td></tr></table>',
    f'<table><tr><td><table><tr><td>{MENU}</td></tr></table></td><td><table><tr><td><font size=4>[Harbour plan delayed again]</font></td></tr><tr><td>[{A}<br><br>{B}]</td></tr></table></td></tr></table>',
    f'<span>{MENU}</span><h3>[Harbour plan]</h3><span>[{A}<br><br>{B}]</span>',
    f'<section><div><a href=/>Start</a> / <a href=/h>Harbour</a></div><div><div>[{A}<br /><br />{B}]</div></div></section>',
    f'<table><tr><th><a href=/>Index</a></th><th><a href=/2>Next</a></th></tr></table><h1>[Chapter two]</h1>[{A}<br><br>{B}<br><br>{A}]<table><tr><td><a href=/1>Previous</a></td><td><a href=/3>Next</a></td></tr></table>',
    f'<font face=verdana><center><b>[Harbour plan]</b></center>[{A}<br><br>{B}]</font>',
    f'<td>[{A}<br><br>{B}]</td>',
    f'<table><tr><td>[{A}<br><br>{B}]</td><td>{MENU}<br><br>Sponsored: buy boats</td></tr></table>',
    f'<div><font size=1><a href=/>Home</a> - <a href=/a>Archive</a></font></div><div><font>[{A}<br><br>{B}]</font></div>',
    f'<table><tr><td><font size=1><a href=a>Start</a><br><a href=b>Maps</a></font></td><td><font face=times size=3>[{A}<br><br>{B}]</font></td><td><a href=c>Buy our book</a></td></tr></table>',
    f'<center><a href=/>Home</a> | <a href=/b>Books</a></center><hr><h2>[Bridge closed]</h2>[{A}<br><br>{B}]<hr><center>Copyright 1999 John</center>',
    f'<center><table><tr><td>[{A}<br><br>{B}<br><br>{A}]</td></tr></table></center>',
    f'<center><h2>[Bridge closed until June]</h2></center><p><font>[{A}<br>{B}]</font>',
    f'<div class=x1><div class=x2><a href=/>Home</a></div><div class=x3>[{A}<br><br>{B}]<br></div><div class=x4>(c) 2010 Town Herald</div></div>',
    f'<dl><dt>[Bridge]</dt><dd>[{A}<br><br>{B}]</dd></dl>',
    f'<table><tr><td><a href=1>One</a></td><td><a href=2>Two</a></td></tr><tr><td colspan=2>[{A}<br><br>{B}]</td></tr></table>',
    f'<pre>[{A} {B}]</pre>',
    f'<table><tr><td>Town Herald</td></tr><tr><td><a href=1>One</a><br><a href=2>Two</a></td><td><h1>[Bridge closed]</h1><p>[{A}]<p>[{B}]</td></tr></table>',
    f'<h1>[Bridge closed]</h1>[{A}]<p>[{B}]</p><a href=/>Back</a>',
]


@pytest.mark.parametrize("page", OLD)
def test_main_text_of_old_layouts(page):
    want = [" ".join(re.sub("<[^>]*>", " ", w).split()) for w in re.findall(r"\[(.*?)\]", page)]
    assert op8_html.main_text(f"<html><body>{re.sub('[][]', '', page)}</body></html>", op8_html.trained()).split("\n\n") == want


def test_breaks_and_links_of_blocks():
    one, two, three = op8_html.blocks("<p>a<br>b<br/><br>c</p><p><a>x</a> | <a>y</a></p><p>***</p>")
    assert (one.text, one.breaks, one.linked) == ("a b c", 3, 0)
    assert (two.text, two.breaks, two.linked) == ("x | y", 0, 5)
    assert three.linked == 0


@pytest.mark.parametrize("page", ["<div class='" + "ab cd " * 200_000 + "'>" + "<p>x" * 100_000, "".join(f"<div class=w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}>x" for i in range(60_000))])
def test_long_class_lists_and_deep_paths(page):
    """All class words of all elements above a block count; time stays linear in the page."""
    import time

    field, begun = op8_html.trained(), time.process_time()
    found = field.blocks(page)
    field.main(found)
    assert time.process_time() - begun < 20 and len(found) == page.count(">x")


def test_features_of_a_path_are_those_of_all_elements_above():
    def of(words):
        return set(op8_html.blocks("".join(f"<div class='{w}'>" for w in words) + "x")[0].path.features())

    many = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    assert of(many) >= {op8_html._dim("word " + w.rstrip('s')) for w in many}
    assert of([" ".join(many)]) >= {op8_html._dim("word " + w.rstrip('s')) for w in many}
