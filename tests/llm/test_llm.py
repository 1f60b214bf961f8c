"""Training-data operators against brute force and edge cases."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from lamina.llm import ann, html, jaccard, langid, mixing, packing, quality, topk, toxicity, urls
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 0, "x", "y") for i, t, l, s in rows], DOCS)


def _prose(rng, words):
    return " ".join("".join(rng.choice(["ba", "ke", "ti", "lo"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for size in (0, 1, 3, 4, 5, 8, 9, 12, 20, 40, 90):
        base = _prose(rng, size).split()
        for _ in range(6):
            copy = [w if rng.random() > 0.03 else "zz" for w in base] + (["tail"] if rng.random() < 0.3 else [])
            rows.append((len(rows), " ".join(copy), "en", "s"))
    rows += [(900, None, None, None), (901, "", "en", None), (None, "a b c d e f", "en", "s"), (5, "again", "en", "s"), (5, "again", "en", "s")]
    got = [tuple(r) for r in jaccard.jaccard_components(_docs(spark, rows)).collect()]
    sets = [jaccard.shingles(t.encode() if t else None) for _, t, _, _ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            if jaccard.linked(sets[a], sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    names = {}
    for at, (i, *_) in enumerate(rows):
        names[root[at]] = min((x for x in (names.get(root[at]), i) if x is not None), default=None)
    want = [(i, len(sets[at]), names[root[at]] if len(sets[at]) else i) for at, (i, *_) in enumerate(rows)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_searches(spark):
    rng = np.random.default_rng(1)
    matrix = np.concatenate([rng.normal(size=(120, 8)), np.tile(rng.normal(size=8), (12, 1))]).round(2)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(matrix)] + [(500, None, "x"), (501, [None] * 8, "x"), (502, [float("nan")] * 8, "x"), (None, [1.0] * 8, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    query = F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))
    whole = topk.impacts(matrix)
    got = topk.exact_top_k(table, "vec_id", "embedding", query).collect()
    near = ann.nearest(table, "vec_id", "embedding", query).collect()
    for q in (0, 50, 100):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(len(score)), -score)) if i != q][:5]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, score[i]) for i in order]
        assert len([r for r in near if r["query_id"] == q]) == 5
    assert topk.exact_top_k(table.limit(0), "vec_id", "embedding", query).count() == 0


def test_packing_round_trip(spark):
    rng = random.Random(2)
    texts = [_prose(rng, rng.choice([0, 3, 500, 9000])) + "." for _ in range(12)] + [None, "", "żółć 漢字"]
    rows = _docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    pieces = packing.pack(rows, with_ids=True).collect()
    public = packing.Tokenizer().public
    for i, text in enumerate(texts):
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert list(itertools.chain(*(p["ids"] for p in own))) == [*public.encode(text or "", add_special_tokens=False).ids, 2]
    for _, group in itertools.groupby(sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])), key=lambda p: p["sequence_id"]):
        at = 0
        for p in group:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    assert packing.pack(rows.limit(0)).count() == 0


def test_mixing_edges(spark):
    rows = [(i, "w " * (i % 9), "en", f"s{i % 4}") for i in range(80)] + [(None, None, None, None), (1, "w w", "en", None), (1, "w w", "en", None)]
    got = mixing.mix_sources(_docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_sources(_docs(spark, rows).limit(0)).count() == 0
    again = mixing.mix_sources(_docs(spark, rows[::-1])).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"], str(r["source"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_classifiers_edges(spark):
    rows = [(i, "der und das " * 9 if i % 2 else "the and of " * 9, "de" if i % 2 else "en", "s") for i in range(60)] + [(None, None, None, None), (99, "", "en", "s"), (100, "123 !", "en", "s")]
    docs = _docs(spark, rows)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert all(found[i] == ("de" if i % 2 else "en") for i in range(60)) and found[99] == found[100] == found[None] == "und"
    assert langid.keep_identified(docs).columns == docs.columns
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    for out in (toxicity.score_toxicity(docs, labels), toxicity.score_toxicity(docs, labels.limit(0)), quality.rate_quality(docs, quality.grades_of(labels)), quality.rate_quality(docs, quality.grades_of(labels.limit(0)))):
        assert out.count() == len(rows)
    assert toxicity.keep_harmless(docs, labels.limit(0)).count() == len(rows)


def test_segments_follow_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        scores = rng.normal(-0.3, 1, 30)
        best = max((scores[a:b].sum() for a in range(30) for b in range(a + 1, 31)), default=0)
        found = toxicity.segments(scores)
        assert (not found and best <= 0) or np.isclose(max(s for *_, s in found), best)


@pytest.mark.parametrize("size", [400, 2000])
def test_rare_toxic_terms_count_at_every_size(spark, size):
    ids = [i for i in range(2 * size) if zlib.crc32(str(i).encode()) % 5][:size]
    words = lambda at: f"plain words number {'abcdefghij'[at % 10]} and {'klmnopqrst'[at // 10 % 10]} of text {'x' * (at % 97)} {'y' * (at // 97)}"
    extra = lambda at: (" zugzwang" if at < 60 else "") + (" quixotry" if at < 60 or at == 61 else "")
    rows = [(i, words(at) + (extra(at) if at % 10 == 0 or at == 61 else ""), "en", "s") for at, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, 1, int(at % 10 == 0)) for at, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(_docs(spark, rows), labels).lexicon
    assert b"=zugzwang" in lexicon and lexicon[b"=zugzwang"] >= lexicon.get(b"=quixotry", 0)  # in 6 toxic texts; the other also in one harmless text


def test_lexicon_keeps_every_significant_term(spark):
    letters = "abcdefghijklmnopqrst"
    many = " ".join("".join(x) + "uvwxyzabcd" for x in itertools.islice(itertools.product(letters, repeat=4), 6000))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:60]
    rows = [(i, f"{many} {'x' * at}" if at < 6 else f"plain {'y' * at}", "en", "s") for at, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, 1, int(at < 6)) for at, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    assert len(toxicity.fit(_docs(spark, rows), labels).lexicon) >= 9 * 6000


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<nav>a</nav><article><h1>T</h1><p>x &amp; y<p>z</article><footer>f", "T\n\nx & y\n\nz"), ("<div class='cookie-notice'>c</div><p>one</p>", "one")])
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "https://A.Example.com/en/1?x"), (2, "http://www.example.com/en/2"), (3, "x://b.net/fr/"), (4, None), (5, "nothing")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(pages, urls.labelled_urls(pages, labels)).collect()}
    assert got == {1: ("a.example.com", "/en/1", "example.com/en/"), 2: ("www.example.com", "/en/2", "www.example.com/en/"), 3: ("b.net", "/fr/", "net/fr/"), 4: ("", "", None), 5: ("", "", None)}


def _texts(spark, pages):
    rows = [(i, f"http://a.net/{i}", x) for i, x in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_templates_of_hosts_with_many_copies(spark):
    rng = random.Random(5)
    pages = [f"<article><p>{_prose(rng, 40)}</p><div>Read our other pages</div></article>" for _ in range(5)]
    texts = _texts(spark, [pages[i % 5] for i in range(700)])
    assert not any("other pages" in x for x in texts.values())


def test_shared_parts_of_near_copies_are_text(spark):
    rng = random.Random(6)
    base, box = _prose(rng, 60), "<table><tr><td>shared table of figures</table>"
    near = [f"<article><p>{base}</p>{box}<p>{_prose(rng, 8)}</p></article>" for _ in range(4)]
    other = [f"<article><p>{_prose(rng, 60)}</p><div>Read our other pages</div></article>" for _ in range(8)]
    texts = _texts(spark, near + other)
    assert all("shared table of figures" in texts[i] for i in range(4)) and not any("other pages" in x for x in texts.values())


@pytest.mark.parametrize(
    "part", ["<h2 id='related-work'>kept</h2>", "<section id='search-trees'>kept</section>", "<section id='social-impact'><p>kept</p></section>", "<p class='notice-period'>kept</p>"]
)
def test_slugs_in_articles_are_text(part):
    page = f"<article><p>A paragraph of the article, long enough to be most of it.</p>{part}<div class='share-buttons'>gone</div><div id='comments'>gone</div></article>"
    assert "kept" in html.main_text(page) and "gone" not in html.main_text(page)


def test_repeated_query_ids_leave_the_search_exact(spark):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([np.tile([4.0] * 4, (6, 1)), rng.normal(size=(80, 4)).round(2)])
    ids = [50] * 6 + list(range(101, 181))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>").coalesce(1)
    whole = topk.impacts(vectors)
    scores = whole[6:] @ whole[0]
    want = [ids[6 + i] for i in np.lexsort((np.arange(80), -scores))[:5]]
    query = F.col("vec_id") == 50
    assert [r["vec_id"] for r in topk.exact_top_k(table, "vec_id", "embedding", query).orderBy("rank").collect()] == want
    assert len(ann.nearest(table, "vec_id", "embedding", query).collect()) == 5
