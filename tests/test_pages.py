"""Hand-derived pages and rules."""

import pytest

from leafpress.operators import sentences, xpath
from leafpress.operators.htmltree import address, parse, serialise
from leafpress.operators.page import Page, Rule, clean, denoised_title, kept_style, raw_text


def tree(html):
    root = parse(html)
    address(root)
    return root


def test_repairs_unclosed_elements():
    root = tree("<p><b>one<p>two")
    assert serialise(root) == "<html><head></head><body><p><b>one</b></p><p><b>two</b></p></body></html>"
    assert [n.pid for n in root.all()] == list(range(1, 8))


def test_lists_and_tables_close_themselves():
    root = tree("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>x")
    body = serialise(root).partition("<body>")[2]
    assert body.startswith("<ul><li>a</li><li>b</li></ul><table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>x")


def test_prune_keeps_svg_and_empties_iframes():
    page = Page("<div aria-hidden='true'>x</div><svg aria-hidden='true'><g/></svg><div style='display:none'>y</div><iframe>z</iframe><div class='header big'>k</div><div class='header'>g</div><!-- c --><p 12='a' :x='b' ok='c'>t</p>", "http://h/")
    html = serialise(page.root)
    assert "svg" in html and "x</div>" not in html and "y" not in html.replace("body", "") and "z" not in html and "k</div>" in html and ">g<" not in html
    assert page.find("//p")[0].attrs == {"ok": "c"}


def test_raw_text_skips_by_xpath_prefix():
    assert raw_text(tree("<body><p style='display:none'>no</p><p>a</p><div class='a hidden'>b</div><div class='h idden'>c</div></body>")) == "a\nb"


@pytest.mark.parametrize("n,alone", [(59, False), (60, False), (62, True)])
def test_article_share(n, alone):
    page = Page(f"<div>{'d' * (99 - n)}</div><article>{'a' * n}</article>", "http://h/")
    page.centroid()
    assert ("d" not in raw_text(page.root)) == alone


def test_link_bundles_go():
    nav = "<ul>" + "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(4)) + "</ul>"
    page = Page(f"<body><div>{nav}</div><p>text with <a href='/x'>one link</a> in a long sentence of words</p></body>", "http://h/")
    page.link_bundles()
    assert "link 1" not in raw_text(page.root) and "one link" in raw_text(page.root)


def test_adjacent_equal_images_are_dropped():
    page = Page("<body><p>t</p><img src='/a'><img src='/a'><img src='/b'><img src='/a'></body>", "http://h/")
    assert [s["url"] for s in page.sentences() if s["url"]] == ["http://h/a", "http://h/b", "http://h/a"]


def test_atoms_get_elements_of_their_own():
    page = Page("<body><p>One. <b>Two</b> tail</p></body>", "http://h/")
    sents = page.sentences()
    page.mark_atoms(sents)
    html = page.to_html()
    assert html.count("<leaf-pos ") == sum(len(s["atoms"]) for s in sents)
    assert raw_text(page.root).replace("\n", " ").split() == "One. Two tail".split()


def test_rules():
    rule = Rule(bodies=["//div[@id='main']"], noises=["//i"], title="//h2", author="empty", pub_time="//time/@datetime")
    page = Page("<title>no</title><body><h2>Yes - it is</h2><div id='main'>in<i>x</i></div><p>out</p><time datetime='2024-03-06 10:00'></time></body>", "http://h/", rule)
    meta = page.meta()
    assert (meta["title"], meta["author"], meta["publish_time"]) == ("Yes - it is", "", "2024-03-06 10:00")
    page.pre_clean()
    assert raw_text(page.root) == "in"


def test_sentences():
    cut = lambda t: [t[a:b].strip() for a, b in sentences.cut(t)]
    assert cut("He said so. Then he left! Why? No.") == ["He said so.", "Then he left!", "Why?", "No."]
    assert cut("第一句。第二句！“第三句。”") == ["第一句。", "第二句！", "“第三句。”"]
    assert cut("See https://a.b/c now") == ["See https://a.b/c now"]
    assert cut("Mr. Smith (who left. He did) came") == ["Mr. Smith (who left. He did) came"]
    assert cut("at 2024-01-02 10:20:30 it began") == ["at 2024-01-02 10:20:30 it began"]
    assert "".join("a b.\n c"[x:y] for x, y in sentences.cut("a b.\n c")) == "a b.\n c"


def test_xpath():
    root = tree("<body><div class='a' id='k'><p>x</p><p title='t'>y</p></div><p>z</p></body>")
    texts = lambda p: [n.text for n in xpath.select(root, p)]
    assert texts("//p") == ["x", "y", "z"] and texts("//div/p[2]") == ["y"] and texts("//p[@title='t' or contains(text(),'z')]") == ["y", "z"]
    assert texts("//div[@*='k']//p[not(@title)] | //body/p") == ["x", "z"]
    with pytest.raises(xpath.XPathError):
        xpath.select(root, "//p[")


def test_small_functions():
    assert clean("a\t\tb  \n  c “d” …") == 'a  b\nc "d" ....'
    assert denoised_title("【[A long enough title]】") == "A long enough title" and denoised_title("A long enough title-x") == "A long enough title" and denoised_title("a-bcd") == "a-bcd"
    assert kept_style("img", "width:100%;height: 3px;color:#fff;background:black;position:fixed") == "height: 3px"
