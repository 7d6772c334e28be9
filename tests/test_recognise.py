"""Recognisers by hand: cards of four houses, noise, and time that grows with the page."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.plans.recognise import RULES, links, lots

BOND = "[\n\n![photo](https://cdn.x/ams/{i}_web)\n\n##### {address}\n\n{tag}\n\n{price}\n\nAuction: 9th Jul 2026\n\n](https://www.bondwolfe.com/auctions/properties/{i}-property-auction-town/)"
PATT = "[![](https://i.x/property-images/7/a.jpg)\n\n{badge}\n\n{price}\n\n12 High St\\, Town\\, NE1 4AB\n\n{beds}\n\n](https://www.pattinson.co.uk/property/{i})"
MCH = "![](https://cdn.eigpropertyauctions.co.uk/{i}/web_medium)\n](https://www.mchughandco.com/lot/details/{i})\n\n[Watch](https://www.mchughandco.com/account/login)\n\n### Lot {n} \\|   End Time - **01/05/2026 12:00**\n\n#### {address}\n\n{tag}\n\n* * *\n\nGuide Price\\* **£{price}+**\n\n[\n"


def test_links_within_links_and_stray_brackets():
    text = "a [b ![c](d) e](f) ] [g [h](i) (j) [k] (l)"
    assert [(text[a:b], url) for a, b, url, _ in links(text)] == [("c", "d"), ("b ![c](d) e", "f"), ("h", "i")]


def test_cards_that_are_a_link():
    page = BOND.format(i=11, address="1 Oxford Street & 17 Stockton Road , Town, TS25 1SL", tag="Mixed use property\n\nResidential Investment", price="Guide price\n\n#### £39,000+")
    page += "text [Home](/) " + BOND.format(i=12, address="22 West Terrace, Stoke, ST6 6QZ", tag="3 bedroom terraced house\n\nSold prior", price="#### £20,000+") * 2
    page += BOND.format(i=13, address="Land at New Road, DY1 4SB", tag="Land in Dudley\n\nWithdrawn", price="") + BOND.format(i=14, address="x", tag="", price="")
    assert [(r[0], r[2], r[3], r[4], r[5], r[7], r[8]) for r in lots("bondwolfe", page)] == [
        ("11", "1 Oxford Street & 17 Stockton Road, Town, TS25 1SL", 39000, "commercial", None, "https://cdn.x/ams/11_web", "available"),
        ("12", "22 West Terrace, Stoke, ST6 6QZ", 20000, "residential", 3, "https://cdn.x/ams/12_web", "available"),
        ("13", "Land at New Road, DY1 4SB", None, "residential", None, "https://cdn.x/ams/13_web", "withdrawn"),
    ]
    page = PATT.format(i=5, badge="Unsold", price="£85,000", beds="2 bed apartment") + PATT.format(i=6, badge="", price="from £1,000 or £2,000", beds="Land") + PATT.format(i=5, badge="", price="£1", beds="")
    assert [(r[0], r[2], r[3], r[4], r[5], r[7], r[8]) for r in lots("pattinson", page)] == [
        ("5", "12 High St, Town, NE1 4AB", 85000, "flat", 2, "https://i.x/property-images/7/a.jpg", "unsold"),
        ("6", "12 High St, Town, NE1 4AB", 1000, None, None, "https://i.x/property-images/7/a.jpg", "available"),
    ]


def test_cards_that_follow_their_link():
    page = "[" + MCH.format(i=101, n=1, address="Flat 2, 9 Road, E1 1AA", tag="Leasehold Flat Vacant", price="250,000") + MCH.format(i=102, n=2, address="10 Road, E1 1AB", tag="Freehold House Sold Prior", price="1") + MCH.format(i=103, n=3, address="x", tag="", price="1")
    assert list(lots("mchugh", page)) == [
        ("101", 1, "Flat 2, 9 Road, E1 1AA", 250000, "flat", None, "leasehold", "https://cdn.eigpropertyauctions.co.uk/101/web_medium", "available"),
        ("102", 2, "10 Road, E1 1AB", 1, "house", None, "freehold", "https://cdn.eigpropertyauctions.co.uk/102/web_medium", "sold"),
    ]


def test_addresses_from_a_links_words():
    page = "[![](https://x/i.jpg)](/property/villiers-road-southsea-po5-2hg/77/) [All](/property/for-sale/) [![](https://x/j.jpg)](https://www.nesbits.co.uk/property/a-b1-1aa/8)"
    assert [(r[0], r[2], r[7]) for r in lots("nesbits", page)] == [("villiers-road-southsea-po5-2hg/77", "Villiers Road Southsea, PO5 2HG", "https://x/i.jpg"), ("a-b1-1aa/8", "A, B1 1AA", "https://x/j.jpg")]


@pytest.mark.parametrize("house", [*RULES, "unknown", None])
def test_noise_has_no_lots(house):
    pages = [None, "", "no links", "[](", "[x](https://www.pattinson.co.uk/property/12/photos)", "[a](https://evil.x/?u=https://www.bondwolfe.com/auctions/properties/1-a/)", "]" * 50 + "[" * 50]
    assert [list(lots(house, p)) for p in pages] == [[]] * len(pages)


@pytest.mark.parametrize("piece", ["[", "]", "![", "[x](", "[](https://www.pattinson.co.uk/property/1)", "[a](https://www.mchughandco.com/lot/details/1)", "### ", "\\", " ,"])
def test_time_is_linear(piece):
    page = piece * (1_000_000 // len(piece))
    for house in RULES:
        began = time.process_time()
        assert len(list(lots(house, page))) == 0
        assert time.process_time() - began < 8


def test_rows_of_pages(spark):
    from quarry.operators.feeds import lot_rows

    page = BOND.format(i=11, address="1 Oxford Street, TS25 1SL", tag="", price="£5")
    pages = spark.createDataFrame([(1, "bondwolfe", page), (2, None, page), (3, "pattinson", page), (4, "bondwolfe", None)], "page_id long, house string, text string").withColumn("state", F.lit(1))
    assert [(r.page_id, r.house, r.lot_id, r.price, r.state) for r in lot_rows(pages).collect()] == [(1, "bondwolfe", "11", 5, "available")]
