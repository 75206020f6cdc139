"""The block labeller on pages written and labelled by hand, and what the parser reads as text."""

import numpy as np
import pytest
from hand_pages import PAGES

from tallyframe.llm import html_blocks, html_extract


@pytest.fixture(scope="module")
def labeller(spark):
    return html_extract.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_labeller_on_pages_by_hand(labeller):
    hit = let = lost = 0
    for page in PAGES:
        want = np.array([b.text.startswith("¶") for b in html_blocks.blocks(page)])
        got = labeller.predict([html_blocks.vectors(html_blocks.blocks(page.replace("¶", "")))])[0]
        assert len(got) == len(want)
        hit, let, lost = hit + (got & want).sum(), let + (got & ~want).sum(), lost + (~got & want).sum()
    assert len(PAGES) == 30 and hit + lost >= 110
    assert hit / (hit + let) > 0.9 and hit / (hit + lost) > 0.85


def test_labeller_on_the_given_pages(spark, labeller):
    """The given pages keep their text in an article element; every block of it is main, and no other."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r["html"]]
    found = [html_blocks.blocks(p) for p in pages]
    got = labeller.predict([html_blocks.vectors(f) for f in found])
    wrong = sum((np.array([any(x.split()[0] == "article" for x in b.path) for b in f], bool) != g).sum() for f, g in zip(found, got, strict=True))
    assert wrong <= 0.002 * sum(map(len, found))


def test_formulas_and_stand_ins_are_text():
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert texts("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='t'>x = 2</annotation></math> then</p>") == ["If x=2 then"]
    assert texts("<p>a</p><noscript><p>shown without scripts</p></noscript>b") == ["a", "shown without scripts", "b"]
    assert texts("<object data='x.svg'><p>instead</p></object><p>next</p>") == ["instead", "next"]
    assert texts("<math/><p>a</p><annotation-xml><p>no</p></annotation-xml>c<styled>d</styled>") == ["a", "cd"]
