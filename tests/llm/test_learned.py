"""Learned operators: held-out accuracy, exact parts against plain versions, recall against brute force."""

import re
import zlib

import numpy as np
import pytest

from queuelens.llm import hashing_search, html_text, licenses, pii, quality, toxicity
from queuelens.llm.tagger import Tagger


def test_base_spans_equal_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")

    def plain(t):
        out = [(0, *m.span()) for m in email.finditer(t)]
        out += [(1, *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in pii.CARD.finditer(t):
            digits = re.sub("[^0-9]", "", m.group())
            out += [(2, *m.span())] if 16 <= len(digits) <= 19 and pii.luhn(digits) else []
        return out + [(3, *m.span()) for m in pii.PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]

    r = np.random.default_rng(2)
    for _ in range(20_000):
        text = "".join(r.choice(list("0123@@..+- ()ab%_é25"), r.integers(0, 30)))
        assert pii.base_spans(text) == plain(text), repr(text)
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)]
    for hostile in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1 (" * 50_000):
        pii.base_spans(hostile)


def test_gradients_of_the_tagger():
    tagger = Tagger(3, hidden=3)
    r = np.random.default_rng(0)
    codes, gold = r.integers(97, 103, (2, 5)), r.integers(0, 3, (2, 5))
    _, g = tagger._gradients(codes, gold)
    for name, where in (("rec_f", (1, 4)), ("rec_b", (0, 7)), ("in_f", (98, 2)), ("out", (2, 1)), ("move", (1, 2)), ("begin", (0,)), ("bias", (2,))):
        x = tagger.w[name]
        sides = []
        for step in (1e-5, -2e-5):
            x[where] += step
            sides.append(tagger._gradients(codes, gold)[0])
        x[where] += 1e-5
        assert abs((sides[0] - sides[1]) / 2e-5 - g[name][where]) < 1e-4, name


def test_tagger_on_held_out_windows(spark):
    """Spellings the patterns miss are found; base spans stay; overlapping windows give one span."""
    tagger = pii.train(spark.createDataFrame([], "doc_id bigint, text string"))
    cases = pii._generated(np.random.default_rng(77))
    found = pii.tagged_spans(tagger, [t for t, _ in cases])
    hit = sum(any(k == kind and x < b and a < y for k, x, y in f) for (_, spans), f in zip(cases, found) for kind, a, b in spans)
    wrong = sum(bool(f) for (_, spans), f in zip(cases, found) if not spans)
    assert hit > 0.9 * sum(len(s) for _, s in cases) and wrong < 0.1 * pii.MADE
    text = "so " * 40 + "write to bob.12@mail3.example.org or (312) 555-0175 soon " + "so " * 40
    (base, every), = pii.all_spans(tagger, [text])
    assert [pii.KINDS[k] for k, _, _ in base] == ["email"] and set(base) <= set(every)
    assert ["phone"] == [pii.KINDS[k] for k, a, b in every if (k, a, b) not in base]


def test_toxicity_probabilities_sum_to_one():
    counts = toxicity.Counts()
    counts.add(0, toxicity.grams_of("a quiet day by the sea " * 20))
    counts.add(1, toxicity.grams_of("you are a fool and a liar " * 5))
    model = counts.likelihoods((0,))
    context = toxicity.grams_of("the se")[-1] >> 6 << 6
    grams = context + np.arange(64)
    shared = np.full(64, 1 / 64)
    for order, (own, rest) in enumerate(model.lower, 1):
        cells = toxicity.cells_of(grams, order)
        shared = own[cells] + rest[cells >> 6] * shared
        assert abs(shared.sum() - 1) < 1e-5
    cells = toxicity.cells_of(grams, toxicity.ORDER)
    for own, rest in (model.ordinary, model.toxic):
        assert abs((own[cells] + rest[cells >> 6] * shared).sum() - 1) < 1e-5


def test_toxicity_held_out(spark):
    r = np.random.default_rng(6)
    calm, rude = ["river", "stone", "morning", "window", "garden", "letter"], ["blockhead", "nitwit", "scumbag"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [*r.choice(calm, 30), *(r.choice(rude, 2) if toxic else [])]
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    scored = {x["doc_id"]: x["score"] for x in toxicity.with_score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scored[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in scored.values())


def test_search_against_brute_force(spark):
    r = np.random.default_rng(8)
    centers = r.normal(size=(12, 24))
    x = (centers[r.integers(0, 12, 1_500)] + 0.6 * r.normal(size=(1_500, 24))) * r.uniform(0.5, 2, (1_500, 1))
    x[300:700] = x[300]  # one vector holds more than a quarter of the rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5_000, None), (5_001, [0.0] * 24), (5_020, [float("nan")] * 24), (5_040, [1.0, None] * 12), (5_060, [1.0, 2.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").repartition(4)
    got = {}
    for q in hashing_search.nearest(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    assert set(got) == {i for i in range(0, 1_500, 20)}
    hits = 0
    for i, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21)) and i not in [v for _, v, _ in found]
        assert all(abs(s - x[i] @ x[v]) < 1e-9 for _, v, s in found)
        scores = x @ x[i]
        scores[300:700] = scores[300]  # equal vectors have equal scores
        scores[i] = -np.inf
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(1_500), -scores))[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9
    assert hashing_search.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id < 3")
    assert hashing_search.nearest(few, few.filter("vec_id = 0")).count() == 2


def test_every_code_within_the_radius_is_found():
    r = np.random.default_rng(9)
    codes = r.integers(0, 256, (800, 8), np.uint8)
    index = hashing_search.MultiIndex(codes)
    for radius in (0, 7, 20, 29):
        for code in codes[:20]:
            away = np.bitwise_count(codes ^ code).sum(1)
            assert index.within(code, radius).tolist() == np.flatnonzero(away <= radius).tolist()


def test_queries_far_from_all_others_find_as_many(spark, monkeypatch):
    monkeypatch.setattr(hashing_search, "FIT_VECTORS", 600)
    monkeypatch.setattr(hashing_search, "INDEX_ROWS", 150)
    monkeypatch.setattr(hashing_search, "QUERY_ROWS", 20)
    monkeypatch.setattr(hashing_search, "BLOCKS", 4)
    r = np.random.default_rng(10)
    near = r.normal(size=24) + 0.05 * r.normal(size=(2_000, 24))
    spread = r.normal(size=(120, 24)) * 0.4
    second = 2 * r.normal(size=24) + 0.2 * r.normal(size=(400, 24))
    x = np.concatenate((near, spread, second))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    asked = [*range(0, 2_000, 100), *range(2_000, 2_120, 2), *range(2_120, 2_520, 20)]
    got = {}
    for q in hashing_search.nearest(df, df.filter(df.vec_id.isin(asked))).collect():
        got.setdefault(q["query_id"], set()).add(q["vec_id"])
    assert {i: len(v) for i, v in got.items()} == dict.fromkeys(asked, 20)
    for kind in (range(2_000), range(2_000, 2_120), range(2_120, 2_520)):
        hits = [len(got[i] & set((np.argsort(-(x @ x[i] - 1e9 * (np.arange(len(x)) == i)), kind="stable")[:20]).tolist())) for i in asked if i in kind]
        assert np.mean(hits) >= 0.9 * 20


def test_blocks_left_out_hold_no_code_within_the_radius():
    r = np.random.default_rng(11)
    blocks = [r.integers(0, 256, 8) ^ (r.random((40, 8, 8)) < 0.06) @ (1 << np.arange(8)) for _ in range(30)]
    codes = np.concatenate([b[:2] for b in blocks]) ^ (r.random((60, 8, 8)) < 0.05) @ (1 << np.arange(8))
    radii = r.integers(0, 24, 60)
    present = [[np.unique(b[:, p]) for b in blocks] for p in range(8)]
    met = set(zip(*(v.tolist() for v in hashing_search.may_hold(present, codes, radii))))
    holding = {(i, j) for i, c in enumerate(codes) for j, b in enumerate(blocks) if (np.bitwise_count(b ^ c).sum(1) <= radii[i]).any()}
    assert holding <= met and len(met) < 60 * 30 / 2


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header>
<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Fish &amp; chips</h1><p>First <b>bold</b>
  text&nbsp;here.<script>var x = "</p>";</script><p>Second paragraph, with more words than the first one has.
<div class="ad">Buy now!</div><form><input><label>Search</label></form></article>
<section class="comments"><p>I like this page very much, and so does everyone I know.</p></section>
<aside><p>Related: another story.</p></aside><footer>&copy; 2024 Example</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>Only a paragraph of plain text, cut in a tag <b"), (5, "u", "<<>>&&;</x></article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    model = html_text.train(pages)
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages, model).collect()}
    assert got[1] == "Fish & chips First bold text here. Second paragraph, with more words than the first one has."
    assert got[2] == got[3] == "" and got[4] == "Only a paragraph of plain text, cut in a tag"
    assert html_text.extract(pages.limit(0), html_text.train(pages.limit(0))).count() == 0
    r = np.random.default_rng(99)
    right = n = 0
    for _ in range(150):
        page, labels = html_text.generated(r)
        blocks = html_text.blocks_of(page)
        assert len(blocks) == len(labels)
        right += sum(a == b for a, b in zip(model.decode(html_text.page_features(blocks)), labels))
        n += len(labels)
    assert right / n > 0.97
    html_text.blocks_of("<div>" * 20_000 + "x")


def test_given_pages(spark, sf_dir):
    """The article of every page, cut out by its tags, is what the field finds."""
    import html as markup

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_text.extract(pages, html_text.train(pages)).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", row["html"], re.S).group(1)
        parts = (" ".join(markup.unescape(x).split()) for x in re.split(r"<[^>]*>", re.sub(r"</?b>", "", article)))
        assert found[row["page_id"]] == " ".join(p for p in parts if p)


def test_expectation_maximisation_recovers_the_labellers():
    r = np.random.default_rng(3)
    truth = r.random(20_000) < 0.7
    counts: dict[int, int] = {}
    rights = [0.95, 0.9, 0.9, 0.85, 0.8, 0.8, 0.7, 0.6]
    votes = []
    for right in rights:
        vote = np.where(r.random(len(truth)) < right, truth, ~truth)
        votes.append(np.where(r.random(len(truth)) < 0.3, 0, np.where(vote, 2, 1)))
    for row in np.column_stack(votes):
        number = int("".join(map(str, row)), 3)
        counts[number] = counts.get(number, 0) + 1
    trust = quality.estimate(counts)
    assert abs(trust.good - 0.7) < 0.03
    for k, right in enumerate(rights):
        assert abs(trust.table[k, 1, quality.GOOD] - right) < 0.05 and abs(trust.table[k, 0, quality.BAD] - right) < 0.05


def test_quality_against_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = quality.with_quality(docs, quality.train(docs)).select("doc_id", "quality.score")
    rows = scored.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.85


def test_licence_scan_against_the_plain_version(spark, sf_dir):
    """Every line and every family: scores by the model's own plain version, similarity by sets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = licenses.train(docs)
    own = licenses._own()
    want = {}
    for row in docs.collect():
        for k, line in enumerate((row["text"] or "").split("\n")):
            words = licenses.words_of(line)
            p = model.probabilities(line)
            family = model.families[p.argmax()]
            if not words or family == licenses.NONE:
                continue
            grams, similar = licenses.grams_of(words), 0.0
            if family != licenses.UNKNOWN and not grams.isdisjoint(own[family]):
                for template in (licenses.grams_of(licenses.words_of(t)) for t in licenses.TEMPLATES[family]):
                    similar = max(similar, len(grams & template) / min(len(grams), len(template)))
            sure = family != licenses.UNKNOWN and p.max() >= model.least and similar >= licenses.CONFIRMED
            want[row["doc_id"], k] = (family if sure else licenses.UNKNOWN, p.max(), similar, sure)
    found = {(r["doc_id"], r["paragraph"]): r for r in licenses.scan(docs, model).collect()}
    assert found.keys() == want.keys()
    for place, (family, probability, similarity, sure) in want.items():
        r = found[place]
        assert (r["family"], r["confirmed"]) == (family, sure)
        assert r["probability"] == pytest.approx(probability, abs=1e-9) and r["similarity"] == pytest.approx(similarity, abs=1e-9)
    stated = {
        "Apache License": "apache-2.0", "MIT License": "mit", "General Public License": "gpl-3.0", "CC BY-NC": "cc-by-nc",
        "All rights reserved": "proprietary",
    }
    texts = {r["doc_id"]: (r["text"] or "").split("\n") for r in docs.collect()}
    named = 0
    for doc, lines in texts.items():
        for k, line in enumerate(lines):
            if family := next((f for w, f in stated.items() if w in line), None):
                assert found[doc, k]["family"] == family and found[doc, k]["confirmed"]
                named += 1
    assert named


@pytest.mark.parametrize("line", ["Licensed under the Fancy Owl Public Licence, version 12.", "This work is licensed under terms nobody knows."])
def test_unknown_licences_are_not_named(spark, line):
    docs = spark.createDataFrame([(1, line)], "doc_id bigint, text string")
    assert {r["family"] for r in licenses.scan(docs, licenses.train(docs)).collect()} <= {"unknown"}


STATED = {
    "MIT licence": "mit",
    "Permission is hereby granted, free of charge, to any person": "mit",
    "CC Attribution-NoDerivatives 4.0": "cc-by-nd",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "CC BY-SA 4.0": "cc-by-sa",
    "Redistributions in binary form must reproduce the above copyright notice": "bsd",
    "Copyright 2019 X. All rights reserved.": "proprietary",
    "This file is licensed under the Apache License, Version 2.0": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Licensed under the Foo Bar License 2.1.": "unknown",
    "Released under the EUPL, version 1.2": "unknown",
}
UNSTATED = ["Of.", "The.", "To.", "As.", "Was.", "Mit und.", "This is.", "You may.", "A driver needs a license to drive.", "Under the bridge.", "Any person.", ""]


def test_licence_lines_by_hand(spark, sf_dir):
    """Lines by hand, one text each, and all in one text. Several are templates or ordinary examples themselves, so this is no held-out precision."""
    model = licenses.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lines = [*STATED, *UNSTATED]
    docs = spark.createDataFrame([*enumerate(lines), (100, "\n".join(lines))], "doc_id bigint, text string")
    found = {(r["doc_id"], r["paragraph"]): r["family"] for r in licenses.scan(docs, model).collect()}
    want = dict(enumerate(STATED.values()))
    assert found == {(i, 0): f for i, f in want.items()} | {(100, i): f for i, f in want.items()}
