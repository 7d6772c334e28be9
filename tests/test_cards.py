"""Listing cards by hand, broken markup, and time that grows with the page."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.functions.cards import cards, rent

PAGE = """<!doctype html><title>x</title><body><nav>at /login <a href="/123">Login</a></nav><main>
<div class="card"><a href="/2156789/"><h2>2 Bed Flat in Town</h2><p class="price">&pound;1,450 pcm</p><span>BS1</span></a></div>
<div><a href='/2156790-studio-town'><span>Studio Apartment</span><strong>£950 pcm</strong></a></div>
<li><a href=/2156791/><span>3 Bed House Share</span><span>£250 pw</span></a></li>
<div><a href="/2156792"><h3>4 Bedroom House in B</h3><p>£2,200 per month</p></a></div>
<div><a href="/2156789/">again £1 pcm</a></div>
<div><a href="/2156793/"><span>1 Bed Flat, coming soon</span></a></div>
<section><div><p><a href="/2156794/"><span>2 bed bungalow</span></a></p></div> from £1,200 to £1,400 pcm<br>now</section>
<div><a href="/2156795/"><span>1 Bed Flat</span> <span>£500 deposit</span></a></div>
</main><footer>""" + "words " * 200 + "</footer>"
WANT = [(2156789, 1450, 2, "flat"), (2156790, 950, 0, "studio"), (2156791, 1083, 3, "room"), (2156792, 2200, 4, "house"), (2156794, 1200, 2, "bungalow")]


def test_cards_of_a_page():
    assert list(cards(PAGE)) == WANT
    assert list(cards(None)) == list(cards("")) == list(cards("<a href=/login>Login</a>")) == []


def test_a_card_without_a_price_takes_none_from_its_neighbours():
    card = lambda i, price: f'<div><a href="/{10000 + i}"><h2>{i % 9 + 1} bed flat with some words about it</h2></a>{price}</div>'
    page = "<main>" + "".join(card(i, "" if i % 3 == 0 else f"<p>£{i}00 pcm</p>") for i in range(1, 31)) + "</main>"
    assert [c[:2] for c in cards(page)] == [(10000 + i, i * 100) for i in range(1, 31) if i % 3]
    assert len(list(cards("".join(card(i, f"£{i} pcm") for i in range(1, 100))))) == 60


def test_broken_markup():
    assert list(cards('<div><a href="/54321/"><b>2 bed flat < 3 £700 pcm')) == [(54321, 700, 2, "flat")]
    assert list(cards("</div></a><p><a href='/54321'>house £9 pw</p></a></i><script><a href='/99999'>£1 pcm</a></script>")) == [(54321, 39, None, "house")]
    assert list(cards("<!-- <a href='/54321'>£9 pcm</a> --><a href='/54322'>£8 pcm<!-- ")) == [(54322, 8, None, None)]


def test_rents():
    assert [rent(t) for t in ("£1,000 pcm or £200 pw", "£500 deposit", "£ , pcm", "£0 pcm", "£10 to £20 pcm", "")] == [867, None, None, None, 10, None]


@pytest.mark.parametrize("piece", ["<", "<a ", "<a href='/12345'>", "<div><a href='/12345'>x", "<div>", "</div>", "<!--", "£1", "<script>", "<a href='/54321' ", " "])
def test_time_is_linear(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    assert len(list(cards(page + ">"))) <= 1
    assert time.process_time() - began < 5


def test_query_reads_markup_that_it_did_not_write(spark):
    from quarry.operators.feeds import card_rows

    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none"), (1, PAGE)], "page_id long, html string").withColumn("rent", F.lit("x"))
    got = card_rows(pages).collect()
    assert sorted(tuple(r) for r in got) == sorted([(1, *w) for w in WANT] * 2, key=str)
