"""Every method against a brute-force version, and every operator on hard tables."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import ann, components, html, jaccard, langid, mixing, packing, quality, topk, toxicity, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __keep_id string, __mix_id string, __row_h string, __lang string, __toxic string, TARGET string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 0, *"abcdef") for i, t, l, s in rows], DOCS)


def _prose(rng, words, parts=("ba", "ke", "ti", "lo", "mu", "ra")):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


# searches


def _table(spark, matrix, ids=None):
    return spark.createDataFrame([(int(i), v.tolist(), 1, "x") for i, v in zip(range(len(matrix)) if ids is None else ids, matrix, strict=True)], "vec_id long, embedding array<double>, q int, v string")


@pytest.mark.parametrize(("shard", "kind"), [(topk.ImpactIndex, np.int64), (ann.GraphIndex, np.float64)])
def test_many_chunks_and_shards_find_the_same(spark, shard, kind):
    rng = np.random.default_rng(2)
    table = _table(spark, rng.normal(size=(300, 6)).round(2))
    query = F.col("vec_id") % 5 == 0
    rows = lambda **sizes: sorted(map(tuple, vectors.search(table, "vec_id", "embedding", query, shard, 5, kind, **sizes).collect()))
    assert rows(chunk_cells=60, shard_cells=400) == rows() and len(rows()) == 60 * 5


def test_recall_on_several_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    matrix = centres[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 24))
    table = _table(spark, matrix)
    found = vectors.search(table, "vec_id", "embedding", F.col("vec_id") % 40 == 0, ann.GraphIndex, 5, np.float64, shard_cells=24 * 1000).collect()
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    hits = 0
    for q in range(0, 4000, 40):
        cosine = unit @ unit[q]
        cosine[q] = -2
        least = np.sort(cosine)[-5]
        own = [r for r in found if r["query_id"] == q]
        assert all(abs(r["score"] - cosine[r["vec_id"]]) < 1e-12 for r in own)
        hits += sum(r["score"] >= least - 1e-12 for r in own)
    assert hits >= 0.9 * 500


def test_huge_and_tiny_components(spark):
    matrix = np.array([[1.0, 1.0], [1e-200, 0], [0, 1e-200], [1e200, 1], [3e300, 3e300], [-3e300, 1]])
    got = {r["vec_id"]: r["score"] for r in ann.nearest(_table(spark, matrix), "vec_id", "embedding", F.col("vec_id") == 0, 9).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {1: 0.707106781, 2: 0.707106781, 3: 0.707106781, 4: 1.0, 5: -0.707106781}
    got = {r["vec_id"]: r["score"] for r in topk.exact_top_k(_table(spark, matrix), "vec_id", "embedding", F.col("vec_id") == 4, 9).collect()}
    assert got[3] == (1 << 63) - 1 and got[5] == -(1 << 63) and got[1] == 0 and got[0] == (1 << 63) - 1
    matrix = np.random.default_rng(1).normal(size=(50, 4)) * 1e6  # products beyond 2^53, sums within 64 bits
    whole = topk.impacts(matrix).astype(object)
    score = [int(x) for x in whole @ whole[0]]
    want = sorted((-score[i], i) for i in range(1, 50))[:5]
    assert [(-r["score"], r["vec_id"]) for r in topk.exact_top_k(_table(spark, matrix), "vec_id", "embedding", F.col("vec_id") == 0).orderBy("rank").collect()] == want


# HTML


def test_counts_alone_remove_boilerplate(spark):
    rng = random.Random(1)
    pages = [f"<div><div>Start page and map</div><div><p>{_prose(rng, 30)}</p><p>{_prose(rng, 20)}</p></div><section>Small print of the house</section></div>" for _ in range(8)]
    rows = [(i, f"http://b.net/{i}", x, "c", "d") for i, x in enumerate(pages + pages[:1])] + [(90, None, None, "c", "d"), (91, "http://b.net/", "", "c", "d"), (92, "x", "a < b and c", "c", "d"), (None, "http://c.net/", "<!-- c --> hello", "c", "d")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, hash string")
    sent, joined = (sorted(map(str, html.extract(table, most).collect())) for most in (1000, -1))
    assert sent == joined and len(sent) == len(rows)
    texts = {r["page_id"]: r for r in html.extract(table).collect()}
    for i in range(8):
        whole = html.main_text(pages[i])
        assert "Start page" in whole and "Small print" in whole
        assert texts[i]["text"] == "\n\n".join(whole.split("\n\n")[1:3]) and texts[i]["n_chars"] == len(texts[i]["text"])
    assert [texts[i]["text"] for i in (90, 91, 92, None)] == ["", "", "a < b and c", "hello"]
    assert html.extract(table.limit(0)).count() == 0


def test_passages_that_pages_share_stay(spark):
    rng = random.Random(2)
    shared = _prose(rng, 60)
    rows = [(i, "http://a.org/", f"<body><p>{_prose(rng, 30)}</p><p>{shared}</p></body>") for i in range(9)]
    assert all(shared in r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())


@pytest.mark.parametrize("page", ["<div>" * 30000 + "x", "<article>x</article>" * 20000, "<b>" * 20000 + "<div>x</div>" * 20000, "<div>" * 20000 + "<li>a" * 20000, "<a href='" * 20000, "<header>" * 20000, "<a>" * 20000, "<div>" * 20000 + "<nav><article>" * 2000, "<" * 50000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 15


def test_classes_that_only_hold_a_name_stay():
    page = "<article><p>A paragraph that is most of the article, by far.</p><div class='comment-policy'>kept</div><div class='related-posts'>gone</div></article>"
    assert "kept" in html.main_text(page) and "gone" not in html.main_text(page)


# Jaccard


def _roots(sets):
    root = list(range(len(sets)))
    for _ in sets:
        for a, b in itertools.combinations(range(len(sets)), 2):
            if jaccard.linked(sets[a], sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return root


def test_alike_texts_that_do_not_link(spark):
    rng = random.Random(4)
    common = _prose(rng, 60)
    rows = [(i, f"{common} {_prose(rng, 40)}", "en", "s") for i in range(60)]  # share 56 of 96 shingles
    rows += [(100 + i, rows[i][1] + " tail", "en", "s") for i in range(20)]
    rows += [(200 + i, " ".join(w if rng.random() > 0.02 else "zz" for w in common.split()), "en", "s") for i in range(40)]
    sets = [jaccard.shingles(t.encode()) for _, t, *_ in rows]
    root = _roots(sets)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(_docs(spark, rows)).collect()}
    assert got == {i: rows[root[at]][0] for at, (i, *_) in enumerate(rows)}
    kept = jaccard.one_of_each(_docs(spark, [*rows, rows[0], (None, "", "en", "s"), (None, None, None, None)]))
    assert kept.columns == _docs(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({rows[x][0] for x in root}) and kept.where("doc_id is null").count() == 2
    assert jaccard.jaccard_components(_docs(spark, rows).limit(0)).count() == jaccard.one_of_each(_docs(spark, rows).limit(0)).count() == 0


def test_very_long_texts_join(spark):
    rng = random.Random(5)
    words = _prose(rng, 30000).split()
    other = [w if rng.random() > 0.01 else "zz" for w in words]
    rows = [(7, " ".join(words), "en", "s"), (3, " ".join(other), "en", "s"), (9, " ".join(words[:20000]), "en", "s")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(_docs(spark, rows)).collect()}
    assert got == {7: 3, 3: 3, 9: 9}


def test_components_follow_union_find(spark):
    rng = random.Random(6)
    chain = list(range(1000, 1200))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(0, x) for x in range(1, 90)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(5000, 5000)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == root
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# classifiers


def test_toxic_passages_are_found_in_held_out_texts(spark):
    rng = random.Random(7)
    bad = ["vorgul", "snarfle", "grimzor", "blathox", "wretchum"]
    rows, labels = [], []
    for i in range(600):
        words = _prose(rng, 80).split()
        if i % 5 == 0:
            for _ in range(6):
                words.insert(rng.randrange(20, 40), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(i % 5 == 0), "x"))
    docs = _docs(spark, rows + [(9000, None, None, None), (9001, "", "en", "s"), (None, "vorgul snarfle", "en", "s"), rows[5], (9002, "plain " * 50000 + "vorgul snarfle grimzor blathox wretchum", "en", "s")])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    out = toxicity.score_toxicity(docs, known).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert len(out) == 605 and len(held) > 80 and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == 0 for r in out if r["doc_id"] in (9000, 9001))
    model = toxicity.fit(docs, known)
    found = toxicity.passages(rows[0][1], model)
    assert found and all(any(w in text for w in bad) for text, _ in found)
    assert sum(t.startswith(b"=") for t in model.lexicon) == len(bad)
    assert model.rate > 0


def test_maximal_segments_by_definition():
    def brute(scores, low, high):
        best = max(((scores[a:b].sum(), -(b - a), a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-9:
            return []
        _, _, a, b = best
        return [*brute(scores, low, a), (a, b), *brute(scores, b, high)]

    rng = np.random.default_rng(0)
    for _ in range(60):
        scores = rng.normal(-0.2, 1, 18)
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == brute(scores, 0, 18)


def test_grades_follow_planted_order(spark):
    rng = random.Random(8)
    parts = {0: "spam buy now cheap", 1: "some plain words here", 2: "careful thorough argument proof"}
    rows = [(i, " ".join(rng.choice(parts[i % 3].split()) for _ in range(30)), "en", "s") for i in range(450)]
    docs = _docs(spark, rows + [(900, None, None, None), (None, "x", "en", "s"), rows[0]])
    ratings = spark.createDataFrame([(i, i % 3) for i in range(450)] + [(901, None)], "doc_id long, grade int")
    out = quality.rate_quality(docs, ratings).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 450]
    assert len(out) == 453 and sum(round(r["expected_grade"]) == r["doc_id"] % 3 for r in held) >= 0.9 * len(held)
    assert all(r["selected"] == (r["doc_id"] % 3 > 0) for r in held)
    model = quality.fit(docs, ratings)
    assert np.all(np.diff(model.thresholds) > 0)
    tails = model.tails(np.linspace(-9, 9, 50))
    assert np.all(np.diff(tails, axis=1) <= 0)  # P(grade > 0) >= P(grade > 1)
    by_hand = tails.sum(axis=1)
    assert np.allclose(model.expected(np.linspace(-9, 9, 50)), by_hand)
    assert quality.keep_good(docs, ratings).columns == docs.columns


def test_kernel_regression_equals_the_dense_solution():
    rng = random.Random(9)
    texts = [_prose(rng, 30, ("un", "que", "le")) if i % 2 else _prose(rng, 30, ("der", "sch", "ng")) for i in range(40)]
    spectra = np.stack([langid.presence(t) for t in texts])
    labels = np.array(["fr" if i % 2 else "de" for i in range(40)])
    model = langid.solve(spectra, labels)
    unit = spectra / np.sqrt(spectra.sum(axis=1, keepdims=True))
    kernel = unit @ unit.T  # all rows are landmarks: plain kernel ridge regression
    goal = np.where(labels[:, None] == np.array(["de", "fr"])[None, :], 1.0, -1.0)
    system = kernel.T @ kernel + langid.RIDGE * 40 * kernel / langid.LANDMARKS + 1e-6 * np.eye(40)
    assert np.allclose(unit @ model.weights, kernel @ np.linalg.solve(system, kernel.T @ goal), atol=1e-2)
    assert (langid.presence("ПРИВЕТ ΛΌΓΟΙ") == langid.presence("привет λόγοι")).all()


def test_languages_of_held_out_texts(spark):
    rng = random.Random(10)
    parts = {"de": ("der", "sch", "ung"), "fr": ("eau", "que", "les"), "en": ("the", "ing", "wh")}
    rows = [(i, _prose(rng, 12, parts[[*parts][i % 3]]), [*parts][i % 3], "s") for i in range(300)] + [(900, "q" * 300000, None, "s")]
    out = langid.identify(_docs(spark, rows)).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["lang_pred"] == [*parts][r["doc_id"] % 3] for r in held) >= 0.97 * len(held)
    many = spark.createDataFrame([(i, "text", f"l{i}") for i in range(2 * langid.MOST_LANGUAGES)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.identify(many)


def test_first_split_by_brute_force():
    rng = np.random.default_rng(11)
    x = rng.integers(0, 20, (400, 3)).astype(float)
    y = ((x[:, 1] > 11) ^ (rng.random(400) < 0.1)).astype(float)
    trees = urls.boost(x, y)
    p = 1 / (1 + np.exp(-trees.base))
    g, h = p - y, np.full(400, p * (1 - p))
    part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + urls.L2)
    gains = {(j, t): part(x[:, j] <= t) + part(x[:, j] > t) for j in range(3) for t in range(20) if min((x[:, j] <= t).sum(), (x[:, j] > t).sum()) >= urls.LEAF}
    best = max(gains, key=gains.get)
    assert trees.feature[0][0] == best[0] and (x[:, best[0]] > trees.threshold[0][0]).tolist() == (x[:, best[0]] > best[1]).tolist()
    assert ((trees.margin(x) > 0) == (x[:, 1] > 11)).all()


def test_planted_url_pattern_is_learned(spark):
    rng = random.Random(12)
    name = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    bad = lambda i: f"http://{name(4)}-{name(4)}-{rng.randrange(10**6)}.org/x/{name(3)}/{i}?a=1&b=2"
    good = lambda i: f"http://{name(8)}.org/x/{i}"
    rows = [(i, bad(i) if i % 4 == 0 else good(i), "v", "w") for i in range(1200)]
    pages = spark.createDataFrame(rows + [(None, None, "v", "w"), (5000, "nothing", "v", "w"), (5001, "http://" + "a" * 200000 + ".org/", "v", "w")], "page_id long, url string, verdict string, score string")
    known = pages.where("page_id < 800").select("url", (F.col("page_id") % 4 == 0).alias("blocked"))
    got = urls.judge(pages, known).collect()
    fresh = [r for r in got if r["page_id"] is not None and 800 <= r["page_id"] < 1200]
    assert len(got) == 1203 and sum((r["verdict"] == "block") == (r["page_id"] % 4 == 0) for r in fresh) >= 0.95 * len(fresh)
    model = urls.fit(known)
    assert model.area > 0.95 and model.gain > 0.2
    noise = spark.createDataFrame([(good(i), rng.random() < 0.25) for i in range(600)], "url string, blocked boolean")
    assert urls.fit(noise).cut == float("inf")
    assert urls.judge(pages.limit(0), known).count() == 0


# packing and mixing


def test_windows_at_least_cost():
    rng = random.Random(13)
    for _ in range(300):
        size = 16
        where = sorted({0, *(rng.randrange(1, 60) for _ in range(14))})
        where = np.array([where[0], *(p for a, p in zip(where, where[1:], strict=False) if p - a <= size)])
        while np.diff(where).max(initial=0) > size:
            where = np.sort(np.append(where, where[np.diff(where).argmax()] + 8))
        price = np.array([rng.choice([0, 1, 5]) for _ in where])
        pad = lambda n: 0 if n & (n - 1) == 0 else size - n
        best = [0.0] * len(where)
        for i in range(1, len(where)):
            best[i] = min(best[j] + pad(int(where[i] - where[j])) for j in range(i) if where[i] - where[j] <= size) + int(price[i])
        cuts = packing.windows(where, price, size)
        at = {int(p): i for i, p in enumerate(where)}
        cost = sum(pad(b - a) + int(price[at[b]]) for a, b in zip([int(where[0]), *cuts], cuts, strict=False))
        assert cost == best[-1] and (cuts[-1] if cuts else where[0]) == where[-1]


def test_buckets_do_not_change_the_draw(spark, monkeypatch):
    rows = [(i, "w " * (i % 9 + 1), "en", f"s{i % 4}") for i in range(400)]
    took = lambda: sorted((r["doc_id"], r["taken"]) for r in mixing.mix_sources(_docs(spark, rows)).collect())
    fine = took()
    monkeypatch.setattr(mixing, "BUCKETS", 2)
    assert took() == fine
    again = mixing.mixed_documents(_docs(spark, rows))
    counts = {r["doc_id"]: r["count"] for r in again.groupBy("doc_id").count().collect()}
    assert again.columns == _docs(spark, rows).columns and all(counts.get(i, 0) * (i % 9 + 1) == taken for i, taken in fine)


# the pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(14)
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = []
    for i in range(400):
        words = _prose(rng, 60, ("the", "ing", "wh", "er", "on")).split()
        if i % 6 == 0:
            words[30:30] = ["vorgul", "snarfle", "grimzor", "blathox"] * 2
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
    rows += [(1000 + i, rows[i][1], "en", "s0") for i in range(1, 30)] + [(1100 + i, rows[i][1] + " end", "en", "s1") for i in range(1, 30)]
    rows += [(2000, None, None, None), (2001, "", "en", "s0"), (2002, "12 34", "en", "s0"), (None, rows[7][1] + " own id missing", None, None), rows[8]]
    _docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_pipeline_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids[name] = [r["doc_id"] for r in docs.collect()]
    assert set(ids["language"]) == {i for i, *_ in rows} - {2000, 2001, 2002}
    toxic = {i for i, t, *_ in rows if t and "vorgul" in t}
    assert not toxic & set(ids["toxicity"]) and set(ids["language"]) - toxic == set(ids["toxicity"])
    kept = [(i, t) for i, t, *_ in rows if i in set(ids["toxicity"])]
    sets = [jaccard.shingles(t.encode()) for _, t in kept]
    root = _roots(sets)
    least = {}
    for at, (i, _) in enumerate(kept):
        least[root[at]] = min((x for x in (least.get(root[at]), i) if x is not None), default=None)
    assert sorted(map(str, ids["near_copies"])) == sorted(map(str, least.values()))
    assert set(ids["mixing"]) <= set(ids["near_copies"]) and max(ids["mixing"].count(i) for i in ids["mixing"]) <= 2
    copies, pieces = {i: ids["mixing"].count(i) for i in ids["mixing"]}, docs.collect()
    for i, n in copies.items():
        own = [p for p in pieces if p["doc_id"] == i]
        assert sum(p["length"] for p in own) == n * own[0]["doc_tokens"]


def test_pipeline_runs_whole_and_on_an_empty_table(spark, corpus, tmp_path):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

