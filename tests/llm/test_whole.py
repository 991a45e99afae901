"""Whole inputs: what no earlier test held, since generated examples or a first filter left it out."""

import pytest

from queuelens.llm import html_text, licenses, pii

OLD_ANCHORS = ("under", "spdx-license-identifier", "this", "license", "provided", "2020")


def test_every_line_is_scanned_for_licences(spark, sf_dir):
    """Against the plain version over all lines, and notices without any common word."""
    notices = {
        "All rights reserved.": "proprietary",
        "Copyright 2019 X. All rights reserved.": "proprietary",
        "MIT licence": "mit",
        "CC BY-SA 4.0": "cc-by-sa",
        "Apache-2.0": "apache-2.0",
        "Permission is hereby granted, free of charge, to any person": "mit",
    }
    assert not any(a in n.lower() for n in notices for a in OLD_ANCHORS)
    made = [(-1 - k, f"Some words of ordinary text here.\n\n{n}\n---") for k, n in enumerate(notices)]
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = licenses.train(given)
    docs = given.unionByName(spark.createDataFrame(made, "doc_id bigint, text string"))
    want = {}
    for row in docs.collect():
        for k, line in enumerate((row["text"] or "").split("\n")):
            p = model.probabilities(line)
            if licenses.words_of(line) and model.families[p.argmax()] != licenses.NONE:
                want[row["doc_id"], k] = p.max()
    found = {(r["doc_id"], r["paragraph"]): r for r in licenses.scan(docs, model).collect()}
    assert found.keys() == want.keys() and all(abs(found[k]["probability"] - want[k]) < 1e-9 for k in want)
    for k, (line, family) in enumerate(notices.items()):
        assert (-1 - k, 2) in found, line
    texts = {r["doc_id"]: r["text"].split("\n") for r in given.filter("text IS NOT NULL").collect()}
    plain = [(i, k) for i, lines in texts.items() for k, line in enumerate(lines) if line == "All rights reserved."]
    assert plain and all(found[x]["family"] == "proprietary" and found[x]["confirmed"] for x in plain)


def test_the_licence_model_is_fitted_to_whole_lines(spark, monkeypatch):
    """Lines with former anchors among them; those that match a template are left out."""
    taken = []
    monkeypatch.setattr(licenses, "fit", lambda ordinary: taken.extend(ordinary))
    long = "word " * 1_000 + "end"
    text = f"{long}\nthis is told under a tree, provided it rains\nReleased under the MIT License."
    licenses.train(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    assert sorted(taken) == sorted(text.split("\n")[:2])


def said(page):
    return " ".join(b.text for b in html_text.blocks_of(page))


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><body><article><p>One</p><p>Two</p></article>", "One Two"),
        ("<html><head><title>t</title><article><p>One</p></article>", "One"),
        ("<head><meta charset=x><title>t</title><span>One</span> two", "One two"),
        ("<head><title>t</title>One two", "One two"),
        ("<head><title>t<body><p>One</p>", "One"),
        ("<head><template><p>no</p></template><title>t</title></head><p>One</p>", "One"),
        *((f"<div><{n}>no<p>One</p><div>Two</div></div><p>Three", "One Two Three") for n in ("select", "button", "svg", "textarea", "canvas")),
        *((f"<div><{n}><div>no</div></{n}><p>One</p></div>", "One") for n in ("select", "button", "svg", "template")),
        ("<div><button>no<p>One</p><button><div>no</div></button><p>Two</p></div>", "One Two"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p></article>", "Let x=2 be."),
        *((f"<p>One</p><{n}>Two</{n}><p>Three", "One Two Three") for n in ("object", "audio", "video")),
        ("<div><object><p>One</p></div><p>Two", "One Two"),
        ("<p>One<script>no<p>no", "One"),
        ("<article><p title=\"x>One</p></article>", "One"),
        ("<article><p>One</p><p title=\"x", "One"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ],
)
def test_pages_that_leave_out_end_tags(page, text):
    assert said(page) == text


def test_many_unclosed_elements_stay_linear():
    assert said("<svg><p>x" * 5_000) == " ".join("x" * 5_000)
    html_text.blocks_of("<div>" * 5_000 + "<svg><p>x</svg>" * 2_000)


@pytest.mark.parametrize("address", ["jane (at) example (dot) org", "jane.doe(at)example.com", "jane.doe [at] example.net", "jane.doeATexample.org"])
def test_addresses_without_digit_or_sign_are_found(tagger, address):
    text = "the letter is long and old " * 6 + f"write to {address} for more of it " + "so we met at noon and sat at home " * 6
    (_, spans), = pii.all_spans(tagger, [text])
    assert [k for k, _, _ in spans] == [0]
    start = text.index(address)
    assert spans[0][1] < start + 8 and spans[0][2] > start + len(address) - 8
    (_, beside), = pii.all_spans(tagger, ["In 2019 " + text])
    assert any(k == 0 and a < start + 16 and b > start + len(address) for k, a, b in beside)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.createDataFrame([], "doc_id bigint, text string"))


def test_prose_with_at_is_no_address(tagger):
    for text in ("we met at noon and sat at home. they look at data all day", "at the end, at last. meet me (at night) or at work"):
        assert pii.all_spans(tagger, [text])[0][1] == []
