"""Markup read from tag to tag, and element trees."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scan


class Reader(HTMLParser):
    def __init__(self, text):
        super().__init__()
        self.found = []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, attrs))

    handle_startendtag = handle_starttag


def test_all_pages_equal_the_standard_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html]
    assert all(list(scan.tags(p)) == Reader(p).found for p in pages) and len(pages) > 200


def test_random_markup_equals_the_standard_parser():
    rng = random.Random(3)
    pieces = ['<a href="x>y">', "<b c='&amp;\"' d>", "<i e=f/g h = j>", "<!-- <u v=w> -->", "<script k=l>var s = '<q r=s>';</script>", "<style>a > b {} <z y=x></style>", "</p t=u>", "text < 3 > 2 ", "<!DOCTYPE html>", "<br/>", "<IMG SRC=A ALT>", "&lt;m n=o&gt;", "<?php <x y=z> ?>", "<td\nwidth=1\t\nheight='2'\n>"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert list(scan.tags(text)) == Reader(text).found, text


@pytest.mark.parametrize(
    "markup, want",
    [
        ("""<!-- <a href="x.css"> --><script>var s = "<img src='y.png'>";</script><p title="ok">t</p>""", [("script", []), ("p", [("title", "ok")])]),
        ("<!--><u v=1><!---><w x=1><!-- a --!><y z=1>", [("u", [("v", "1")]), ("w", [("x", "1")]), ("y", [("z", "1")])]),
        ("<a b c=d e=\"f g\" h='i' j=>", [("a", [("b", None), ("c", "d"), ("e", "f g"), ("h", "i"), ("j", "")])]),
        ('<p a="1"b="2">', [("p", [("a", "1"), ("b", "2")])]),
        ('<a href="never closed > <b c=d>', []),
        ("<a href=x", []),
        ("<!-- never closed <b c=d>", []),
        ("<script>never closed <b c=d>", [("script", [])]),
        ("<SCRIPT>x</ScRiPt ><b c=d>", [("script", []), ("b", [("c", "d")])]),
        ("", []),
    ],
)
def test_states(markup, want):
    assert list(scan.tags(markup)) == want


def test_odd_texts_stay_linear():
    for text in ("<a " + "x " * 200_000, "<a b='" * 50_000, "<!-" * 100_000, "<script>" * 50_000, "<" * 300_000, "<a" + " b" * 100_000 + ">"):
        assert sum(len(a) for _, a in scan.tags(text)) in (0, 100_000)


XML = """<?xml version="1.0"?><!-- <script/> --><svg xmlns="http://www.w3.org/2000/svg" xmlns:x="http://www.w3.org/1999/xlink"><g><x:a x:href="#b"/><g><text>a &lt; b</text></g></g><title/></svg>"""


def test_element_tree(spark):
    rows = spark.createDataFrame([(1, XML), (2, "<a><b></a>"), (3, None), (4, ""), (5, '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>')], "id int, text string")
    found = scan.elements(rows, "id", "text").cache()
    tree = [(r.pre, r.last, r.depth, r.name) for r in found.where("id = 1").orderBy("pre").collect()]
    assert tree == [(0, 5, 0, "svg"), (1, 4, 1, "g"), (2, 2, 2, "a"), (3, 4, 2, "g"), (4, 4, 3, "text"), (5, 5, 1, "title")]
    a = found.where("id = 1 and name = 'a'").first()
    assert a.namespace == "http://www.w3.org/1999/xlink" and a.attributes == {"http://www.w3.org/1999/xlink href": "#b"}
    assert sorted((r.id, r.error is None) for r in found.where("id > 1").collect()) == [(2, False), (4, False), (5, False)]
    assert "entity" in found.where("id = 5").first().error
    inside = scan.within(found.where("name = 'text'"), found.where("name = 'g'"), "id")
    assert sorted(r.in_pre for r in inside.collect()) == [1, 3]


def test_drawings(spark):
    rows = [(1, "<s:svg xmlns:s='http://www.w3.org/2000/svg'><s:script>x</s:script></s:svg>"), (2, '<svg xmlns:q="http://www.w3.org/1999/xlink"><use q:href=" HTTPS://h/x"/></svg>'), (3, '<svg><!-- <script/> --><use href="#a"/><text>href="//h"</text></svg>'), (4, "<svg><use></svg>"), (5, None)]
    got = scan.svg_violations(spark.createDataFrame(rows, "id int, svg string"), "id", "svg")
    assert {(r.id, r.reason) for r in got.collect()} == {(1, "script"), (2, "remote reference"), (4, "malformed")}


def test_attributes_of_no_rows(spark):
    empty = spark.createDataFrame([], "id int, html string")
    assert scan.attributes(empty, "id", "html").isEmpty() and scan.elements(empty, "id", "html").isEmpty()
    assert scan.attributes(empty.unionAll(spark.range(1).select(F.lit(1), F.lit(None))), "id", "html").isEmpty()
