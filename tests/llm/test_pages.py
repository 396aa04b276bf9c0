"""Main text of pages: the tree model's marginals by brute force, and extraction of made-up pages."""

import itertools
import random

import numpy as np
import pytest

from schemaloom.llm import html_extract, html_pages


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_marginals_equal_sums_over_labellings():
    tree = html_extract.parse("<div class='a'><p>one two</p><ul><li>x</li><li><a>y</a></li></ul></div>")
    r = np.random.RandomState(1)
    m = html_extract.Model(r.randn(html_extract.N_FEATURES) * 0.1, r.randn(len(html_extract.BLOCKS), 2, 2))
    f = html_extract.forest([tree])
    found, _ = html_extract.marginals(m, f)
    unary = np.bincount(f.node, m.weights[f.feature], len(f.parent))
    total, yes = 0.0, np.zeros(len(f.parent))
    for labels in itertools.product((0, 1), repeat=len(f.parent)):
        weight = np.exp(sum(unary[k] * x for k, x in enumerate(labels)) + sum(m.pairs[f.tag[k], labels[p], labels[k]] for k, p in enumerate(f.parent) if p >= 0))
        total += weight
        yes += weight * np.array(labels)
    assert np.allclose(found, yes / total)


OPEN = {
    "buttons": "<button>" * 100_000, "selects": "<select><p>" * 50_000, "quotes": "<a x " * 100_000 + '">', "odd quotes": '<a "' * 100_001 + ">", "mixed": "<a '\"" * 50_000 + "x>", "ends": '</a "' * 100_000 + "'>",
    "blocks": "<div>" * 100_000, "stray ends": "<div>" * 50_000 + "</p>" * 50_000, "drawings": "<svg>" * 60_000 + "</svg>" * 20_000, "marks": "<!" * 100_000, "names": "<p " + "a" * 200_000 + ">", "cells": "<td><tr>" * 50_000, "signs": "<" * 200_000 + ">",
}


@pytest.mark.parametrize("name", OPEN)
def test_pages_that_leave_all_open_take_linear_time(model, name):
    import time

    began = time.perf_counter()
    html_extract.extract(model, [OPEN[name]])
    assert time.perf_counter() - began < 4  # under 2 seconds on a free machine


def test_elements_that_never_end():
    texts = lambda page: [t for _, t in html_extract.parse(page).texts]
    assert texts("<p>a<button>b<button>c</button>d</p>") == ["abd"]
    assert texts('<p>a<b "c>d</p>e') == ['a<b "c>d', "e"]
    assert texts("<p>a</p><script>b</p>c") == ["a"]
    assert texts("<svg><svg>x</svg></svg><p>a") == ["a"]
    assert texts("a < b > c") == ["a < b > c"]
    deep = html_extract.parse("<div>" * 2000 + "text" + "</div>" * 2000 + "<p>after</p>")
    assert max(deep.depths) == html_extract.MOST_DEPTH and [t for _, t in deep.texts] == ["text", "after"] and deep.parents[-1] == 0


def test_a_paragraph_ends_however_deep_it_is_open():
    tree = html_extract.parse("<p><span><section>" + "<b>" * 5 + "<p>x<p>y")
    assert [html_extract.BLOCKS[t] for t in tree.tags] == ["html", "p", "section", "p", "p"]
    assert html_extract.parse("<p>a<table><tr><td>b<div>c</div></td></tr></table>").parents == [-1, 0, 0, 2, 3, 4]


def test_held_out_layouts(model):
    pages = [(html_pages._Writer(seed).page(), html_pages.MARK) for seed in range(10_000, 10_060)]
    right = total = 0
    for page, mark in pages:
        tree = html_extract.parse(page)
        labels = html_extract.label_of(tree, mark)
        found, _ = html_extract.marginals(model, html_extract.forest([tree]))
        for node, text in tree.texts:
            if text.strip():
                total += 1
                right += (found[node] > 0.5) == bool(labels[node])
    assert right / total > 0.97


def test_texts(model):
    page = "<html><head><title>T</title><script>var a = '<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav><article><h1>A  title</h1><p>Fish &amp; chips cost &#163;5,\n and caf&eacute;s sell them all day long.</p><p>Another paragraph of the same article, with more words.</p></article><footer>&copy; 2020 Site</footer></body></html>"
    assert html_extract.extract(model, [page, None, "", "no tags at all <", "<p>"])[0] == "A title Fish & chips cost £5, and cafés sell them all day long. Another paragraph of the same article, with more words."


def test_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<div>" * 3000 + "deep", "x"), (3, "u", "<p>a</p>", "x"), (3, "u", "<p>a</p>", "x")], "page_id long, url string, html string, main_text string")
    found = html_extract.main_texts(odd).collect()
    assert len(found) == 5 and all(r.n_chars == len(r.text) for r in found) and [r.text for r in found if r.page_id < 3] == ["", ""]
    assert html_extract.main_texts(pages).filter("n_chars > 0").count() > 0.9 * pages.count()
    assert html_extract.main_texts(pages.limit(0)).count() == 0
