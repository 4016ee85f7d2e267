"""Gold texts of hand-made layouts, none of which the labeller was trained on."""

from __future__ import annotations

import pytest

from sparkloom.llm import htmltext

A = "The river rose again on Tuesday, and the town that had waited for it all week went out to look."
B = "Nobody could say when the bridge would open, but the mayor promised a new timetable by the end of the month."
C = "Engineers measured the piers twice, wrote down what they found and drove back before dark."
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul></nav>"

LAYOUTS = {
    "plain article": (f"{NAV}<article><h1>High water</h1><p>{A}</p><p>{B}</p></article><footer>&copy; 2024 The Paper</footer>", f"High water {A} {B}"),
    "comments inside the article": (f"{NAV}<article><h1>High water</h1><p>{A}</p><p>{B}</p><div class='comments'><h3>2 comments</h3><p>Nice text, I was there too.</p><p>Well said.</p></div></article>", f"High water {A} {B}"),
    "comments after the article": (f"<article><h1>High water</h1><p>{A}</p></article><section id='comments'><p>I do not believe a word of this story.</p></section>", f"High water {A}"),
    "comments as articles": (f"<main><h1>High water</h1><p>{A}</p><p>{C}</p></main><div id='disqus_thread'><article><header>Anna</header><p>What a long and lovely text about the river.</p></article></div>", f"High water {A} {C}"),
    "a form inside the article": (f"<article><p>{A}</p><form action='/n'><p>Subscribe to our newsletter and never miss a story.</p><label>E-mail</label><input></form><p>{B}</p></article>", f"{A} {B}"),
    "a foot without the word": (f"<article><h1>High water</h1><p>{A}</p><p>{C}</p></article><div class='foot'>All rights reserved</div>", f"High water {A} {C}"),
    "nameless divisions": (f"<div>{NAV}</div><div><h1>High water</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div><p>Copyright 2019 The Paper</p></div>", f"High water {A} {B} {C}"),
    "a named division": (f"<div class='topnav'><a href=a>Home</a> <a href=b>About</a></div><div class='post-content'><p>{A}</p><p>{B}</p></div><div class='sidebar'><h4>Most read</h4><a href=c>Ten ways to cross a river</a></div>", f"{A} {B}"),
    "cookie notice first": (f"<div class='cookie-banner'><p>We use cookies to improve your experience on this site.</p><button>OK</button></div><article><p>{A}</p><p>{B}</p></article>", f"{A} {B}"),
    "advert between paragraphs": (f"<article><p>{A}</p><div class='ad-slot'><p>Buy now: rubber boots, two pairs for the price of one.</p></div><p>{B}</p></article>", f"{A} {B}"),
    "share bar and tags": (f"<article><h1>High water</h1><ul class='share-buttons'><li><a href=f>Facebook</a></li><li><a href=t>Tweet</a></li></ul><p>{A}</p><p>{C}</p><div class='tags'><a href=r>rivers</a></div></article>", f"High water {A} {C}"),
    "aside in the middle": (f"<main><p>{A}</p><aside><h3>Related articles</h3><p><a href=x>The flood of 1954</a></p></aside><p>{B}</p></main>", f"{A} {B}"),
    "lists and quotes": (f"<article><h2>What we know</h2><ul><li>{A}</li><li>{B}</li></ul><blockquote>{C}</blockquote></article><footer><p>Imprint</p></footer>", f"What we know {A} {B} {C}"),
    "a page-wide form": (f"<form id='aspnetForm'><div class='header'><a href=h>Home</a></div><main><p>{A}</p><p>{B}</p></main></form>", f"{A} {B}"),
    "a table of layout": (f"<table><tr><td class='menu'><a href=1>One</a><br><a href=2>Two</a></td><td class='content'><p>{A}</p><p>{B}</p></td></tr></table>", f"{A} {B}"),
    "old style names": (f"<div id='masthead'><h2>The Paper</h2></div><div id='story'><h1>High water</h1><p>{A}<p>{B}<p>{C}</div><div id='copyright'>The Paper</div>", f"High water {A} {B} {C}"),
    "related after": (f"<article><p>{A}</p><p>{C}</p></article><div class='related-stories'><h3>You may also like</h3><ul><li><a href=1>The flood of 1954</a></li><li><a href=2>A new bridge</a></li></ul></div>", f"{A} {C}"),
    "a style inside a script": (f"<article><script>document.write(\"<style>p{{}}</style>\"); var leaked = 1;</script><p>{A}</p><style>/* </script> */ p{{}}</style><p>{B}</p></article>", f"{A} {B}"),
    "references and white space": ("<article><p>Fish &amp; chips\n\n  cost &lt;5&nbsp;&euro; &#x2014; \t cheap, said the owner of the only open shop.</p></article>", "Fish & chips cost <5 € — cheap, said the owner of the only open shop."),
    "newsletter box": (f"<article><p>{A}</p><section class='newsletter-signup'><h3>Sign up for updates</h3><p>Get the best stories in your inbox every morning.</p></section><p>{B}</p></article>", f"{A} {B}"),
    "replies in a list": (f"<div class='article-body'><p>{A}</p><p>{B}</p></div><ol class='commentlist'><li><div>Tom says:</div><p>I have lived there for thirty years and never saw such water.</p></li><li><p>Me neither.</p></li></ol>", f"{A} {B}"),
    "nested wrappers": (f"<div class='page'><div class='wrap'><div class='navbar'><ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul></div><div class='col'><div class='entry'><h1>High water</h1><p>{A}</p><p>{B}</p></div></div></div></div>", f"High water {A} {B}"),
}


@pytest.fixture(scope="module")
def labeller(spark):
    return htmltext.train(spark.createDataFrame([], "page_id long, url string, html string"))


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layout(labeller, name):
    body, want = LAYOUTS[name]
    assert htmltext.main_texts([f"<!DOCTYPE html><html><head><title>The Paper</title></head><body>{body}</body></html>"], labeller) == [want]


def test_long_pages_are_read_whole(labeller):
    """Longer than what is weighted at a time; the last paragraph counts as the first does."""
    many = [f"{A} Part {k}." for k in range(htmltext.STEPS + 500)]
    page = f"<body>{NAV}<article>" + "".join(f"<p>{x}</p>" for x in many) + "</article><footer>&copy; 2024 The Paper</footer></body>"
    assert htmltext.main_texts([page], labeller) == [" ".join(many)]


@pytest.mark.parametrize("shown", [htmltext.SHOWN, htmltext.NAMELESS, htmltext.PLAIN])
def test_agrees_with_the_labels_of_layouts_not_seen(labeller, shown):
    """Against what the blocks are, as what elements tell is wrong in some of these pages."""
    agree = 0
    pages = htmltext.invented(80, seed=99)
    own = [htmltext.blocks(p, shown) for p, _ in pages]
    for blocks, found, (_, y) in zip(own, labeller.label(htmltext.vectors(own)), pages, strict=True):
        want, got = ({w for b, k in zip(blocks, ks, strict=True) if k for w in b.text.split()} for ks in (y, found))
        agree += len(want & got) >= 0.8 * len(want)
    assert agree >= (70 if shown == htmltext.PLAIN else 76)  # without any name or telling element, some layouts are a guess


def test_elements_whose_ends_are_left_out_keep_what_follows():
    texts = lambda page: [b.text for b in htmltext.blocks(page)]
    assert texts("<head><title>T</title><p>Hello world, main text.</p>") == ["Hello world, main text."]
    assert texts("<html><head><meta charset=x><title>T</title><link rel=a>Bare text<p>more") == ["Bare text", "more"]
    assert texts("<div><p>a<button>x</p><p>b</p></div><p>c</p>") == ["a", "b", "c"]
    for tag in ("object", "map", "select", "svg", "video"):
        assert texts(f"<div><{tag}><p>fallback</p> <b>x</div><p>after</p>") == ["after"]
        assert texts(f"<p>a</p><div><{tag}><div>in</div>in</{tag}>b</div>") == ["a", "b"]
    assert texts("<svg><svg>x</svg>y</svg>z") == ["z"] and texts("<div><textarea></div><p>typed</textarea>b") == ["b"]
    assert texts("<button/>a<body><p>b") == ["a", "b"]


def test_names_can_be_hidden():
    page = "<nav class='menu'><a href=x>Home</a></nav><article id='story'><p>Text.</p></article>"
    shown, nameless, plain = ([b.place.path for b in htmltext.blocks(page, s)] for s in (htmltext.SHOWN, htmltext.NAMELESS, htmltext.PLAIN))
    same = [b.place.path for b in htmltext.blocks("<div><a href=x>Home</a></div><div><p>Text.</p></div>")]
    assert all((a == b).all() for a, b in zip(plain, same, strict=True))
    assert all((a != b).any() and (b != c).any() for a, b, c in zip(shown, nameless, plain, strict=True))
    assert [b.inside for b in htmltext.blocks(page, htmltext.PLAIN)] == ["around", "main"]  # a label, and no input
    assert (htmltext.vectors([htmltext.blocks(page, htmltext.PLAIN)])[0] == htmltext.vectors([htmltext.blocks("<div><a href=x>Home</a></div><div><p>Text.</p></div>")])[0]).all()
