import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casario.llm import additive_ann, license_scan, ngram_lm, quality_classifier, quality_rules


def kneser_ney(texts):
    """P(w|u) of a plain bigram model, for comparison."""
    c, bi = Counter(), Counter()
    for t in texts:
        c.update(t)
        bi.update(zip(["<"] + t[:-1], t, strict=True))
    k, total, follow = Counter(w for _, w in bi), Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, _), n in bi.items():
        total[u] += bi[u, _]
        follow[u][min(n, 3) - 1] += 1
    counts = lambda v: [Counter(v.values())[i] for i in (1, 2, 3, 4)]
    d2, d1 = ngram_lm.discounts(counts(bi)), ngram_lm.discounts(counts(k))
    rest = sum(d1[min(n, 3)] for n in k.values()) / max(len(bi), 1) if bi else 1.0

    def p(u, w):
        low = max(k[w] - d1[min(k[w], 3)], 0) / max(len(bi), 1) + rest / (len(c) + 1)
        if not total[u]:
            return low
        return max(bi[u, w] - d2[min(bi[u, w], 3)], 0) / total[u] + sum(a * b for a, b in zip(follow[u], d2[1:], strict=True)) / total[u] * low

    return p, c


def test_language_model_against_brute_force(docs, corpus, monkeypatch):
    monkeypatch.setattr(ngram_lm, "FLUSH", 500)
    monkeypatch.setattr(ngram_lm, "SHARD", 400)
    tokens = lambda t: (t or "").encode().lower().split() + ["end"]
    train = [tokens(t) for i, t, *_ in corpus if i % 3]
    p, c = kneser_ney(train)
    model = ngram_lm.train(docs.where("doc_id % 3 <> 0"))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.vocabulary) == (n, v)
    rows = ngram_lm.score(docs, model).collect()
    assert len(rows) == len(corpus)
    text = {i: tokens(t) for i, t, *_ in corpus}
    for r in rows:
        t = text[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(t), sum(c[w] > 0 for w in t))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["<"] + t[:-1], t, strict=True)))
    seen = ["<", *list(c)[:5]]
    assert all(sum(p(u, w) for w in c) + p(u, "unknown") == pytest.approx(1) for u in seen)


def test_language_model_of_nothing(docs, nothing):
    model = ngram_lm.train(nothing)
    assert model.tokens == 0
    assert all(r.score == 0 and r.n_known == 0 for r in ngram_lm.score(docs.where("doc_id < 3"), model).collect())
    assert ngram_lm.score(nothing, model).count() == 0


def test_rules_count_as_defined():
    assert quality_rules.counts(b"a b c a b c d\n\nx#y\nx#y\n \n") == (9, 13, 2, 1, 6, 0, 3)
    assert quality_rules.counts(None) == quality_rules.counts(b" \n") == (0, 0, 0, 0, 0, 0, 0)
    assert quality_rules.counts("É Ünï".encode())[:2] == (2, 4)


def test_rules_reject_outliers_of_their_group(spark):
    rng = np.random.default_rng(1)
    plain = lambda n: " ".join("w" + "".join(map(str, rng.integers(0, 9, 4))) for _ in range(n))
    rows = [(i, plain(80), "en", "s0" if i % 3 else None) for i in range(300)]
    rows += [(300, plain(80).replace(" ", " # "), "en", "s0"), (301, plain(10), "en", "s0"), (302, (plain(4) + " ") * 30, "en", "s0"), (303, None, None, "s0"), (304, "", "xx", "rare"), (305, plain(70), "xx", "rare"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("clash"))
    out = {r.doc_id: r for r in quality_rules.judge(*quality_rules.rules(df)).collect()}
    assert len(out) == 306 and {i for i, r in out.items() if not r.kept} == {300, 301, 302, 303, 304}
    assert {i for i, r in out.items() if r.base_failed} == {301, 302, 303, 304}
    kept = quality_rules.filter_quality(df)
    assert kept.columns == df.columns and kept.count() == 302


def test_sketch_quantiles_are_within_their_error(spark):
    values = np.random.default_rng(4).lognormal(0, 2, 3000)
    f = spark.createDataFrame([("en", "s", False, float(v), *[0.0] * (len(quality_rules.RATIOS) - 1)) for v in values], "lang string, source string, base_failed boolean, " + ", ".join(f"{r} double" for r in quality_rules.RATIOS))
    for r in quality_rules.quartiles(quality_rules.sketches(f)).where(f"ratio = '{next(iter(quality_rules.RATIOS))}'").collect():
        for q, got in ((0.25, r.q1), (0.75, r.q3)):
            assert abs(got / np.quantile(values, q, method="inverted_cdf") - 1) <= quality_rules.ACCURACY * 1.01


def test_no_size_of_a_group_makes_a_step(spark):
    """Groups of one distribution and of n and n + 1 documents in a wider language: their fences lie close together, between their own and the language's."""
    rng = np.random.default_rng(9)
    sizes = (1, 2, 50, 51, 99, 100, 101, 400)
    rows = [("en", "wide", False, float(v)) for v in rng.uniform(2, 12, 800)] + [("en", f"s{n}", False, 6.0 + 0.001 * (i % 5)) for n in sizes for i in range(n)]
    names = list(quality_rules.RATIOS)
    f = spark.createDataFrame([(*r[:3], *[r[3] if x == "word_length" else 0.0 for x in names]) for r in rows], "lang string, source string, base_failed boolean, " + ", ".join(f"{x} double" for x in names))
    hi = {r.source: r.word_length_hi for r in quality_rules.thresholds(f).collect()}
    for a, b in ((1, 2), (50, 51), (99, 100), (100, 101)):
        assert abs(hi[f"s{a}"] - hi[f"s{b}"]) < 0.05 * hi[f"s{a}"]
    assert [hi[f"s{n}"] for n in sizes] == sorted((hi[f"s{n}"] for n in sizes), reverse=True) and hi["s400"] < hi["s1"]


def test_rules_on_nothing(nothing):
    assert quality_rules.filter_quality(nothing).count() == 0


def test_classifier_on_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, quality_classifier.training_labels(labels))
    held = quality_classifier.with_scores(docs, model).join(labels, "doc_id").where(quality_classifier.crc_mod(F.col("doc_id"), 5) == 0).select("score", "quality").toPandas()
    assert ((held.score >= 0.3) == (held.quality == 1)).mean() > 0.95
    assert 0 <= held.score.min() and held.score.max() <= 1
    assert abs(held.score.mean() - held.quality.mean()) < 0.1


def test_classifier_edge_cases(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(5, 40)] + [(None, 1), (6, None), (7, 9)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    out = quality_classifier.with_scores(docs, model)
    assert out.count() == docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality_classifier.filter_quality(docs, model, 0.0).columns == docs.columns
    empty = quality_classifier.train(nothing, labels)
    assert quality_classifier.with_scores(nothing, empty).count() == 0
    assert quality_classifier.train(docs, labels.where("quality = 1"))[1] == {"share": 1.0}


@pytest.mark.parametrize("window", [300, 2_000_000])
def test_word_vectors_against_brute_force(docs, corpus, monkeypatch, window):
    """One vector a token, whatever the windows, steps and partitions."""
    monkeypatch.setattr(quality_classifier, "WINDOW", window)
    monkeypatch.setattr(quality_classifier, "STEP", 170)
    monkeypatch.setattr(quality_classifier, "SHARD", 500)
    sums, counts = defaultdict(lambda: np.zeros(quality_classifier.DIM)), Counter()
    for _, text, *_ in corpus:
        found = quality_classifier.tokens((text or "").encode())
        index = quality_classifier.index_vectors(found).astype(float)
        for i, t in enumerate(found.tolist()):
            counts[t] += 1
            for j in range(max(0, i - 2), min(len(found), i + 3)):
                if i != j:
                    sums[t] += index[j]
    own = np.array(sorted(counts), np.uint64)
    for df in (docs, docs.repartition(7)):
        values, has = quality_classifier.word_vectors(df).of(own)
        for t, v, h in zip(own.tolist(), values, has, strict=True):
            norm = np.sqrt((sums[t] ** 2).sum())
            assert h == (counts[t] >= quality_classifier.MIN_COUNT)
            assert np.allclose(v, sums[t] / norm if h and norm else 0, atol=1e-3)


def test_labels_without_documents_take_no_place_in_the_sample(spark, docs, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SAMPLE", 30)
    good = [(i, i % 2) for i in range(5, 35)]
    one = quality_classifier.train(docs, spark.createDataFrame(good, "doc_id long, quality int"))[1]
    # without documents, of both kinds, of neither kind
    many = good + [(i, i % 2) for i in range(1000, 3000)] + [(50, 0), (50, 1), (51, 5)]
    two = quality_classifier.train(docs, spark.createDataFrame(many, "doc_id long, quality int"))[1]
    assert all((a == b).all() for a, b in zip(one["p"], two["p"], strict=True))


def test_null_ids_are_not_held_out(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(quality_classifier.held_out(F.col("doc_id"))).first()[0] is False


def neighbours(rows, k=10, every=100):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            out[i] = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i)[:k]
    return out


@pytest.mark.parametrize("kind", ["random", "tight", "few"])
def test_vector_search(spark, kind):
    rng = np.random.default_rng(5)
    n = 7 if kind == "few" else 1500
    x = rng.normal(size=(n, 16))
    if kind == "tight":
        x[:600] = x[0] + rng.normal(size=(600, 16)) * 0.01
        x[700:740] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None] * 8), (2003, [float("nan")] * 16), (2004, [float("inf")] * 16), (2005, [1.0] * 3), (2006, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("codes", F.lit("clash"))
    out = additive_ann.search(df, F.col("id") % 100 == 0).collect()
    want = neighbours(rows)
    assert {r.query_id for r in out} == set(want)
    hits = 0
    for i, found in want.items():
        mine = sorted((r for r in out if r.query_id == i), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(found) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += sum(abs(a.score - b[0]) < 1e-12 for a, b in zip(mine, found, strict=True))
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_vector_search_keeps_large_ids_beside_null_ones(spark):
    far = 1 << 60
    rows = [(None, [1.0, 1.0]), (0, [1.0, 1.0]), (far + 1, [1.0, 1.5]), (far + 3, [1.0, 2.5]), (far + 3, [1.0, 3.0]), (None, [0.0, 0.0])]
    out = additive_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1), F.col("id") == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 1, far + 1, 0.5), (0, 2, far + 3, 1.5), (0, 3, far + 3, 2.0)]


def test_vector_search_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert additive_ann.search(df, F.col("id") % 100 == 0).count() == 0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_increasing_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(50):
        v = rng.permutation(12).tolist()
        got = [v[i] for i in license_scan.increasing(v)]
        best = max((m for m in range(1 << 12) if [v[i] for i in range(12) if m >> i & 1] == sorted(v[i] for i in range(12) if m >> i & 1)), key=lambda m: m.bit_count())
        assert got == sorted(got) and len(got) == best.bit_count()


def test_alignment_is_a_common_subsequence_and_close_to_the_longest():
    words = license_scan.license_words(license_scan.TEMPLATES["MIT"])
    rng = np.random.default_rng(7)
    for _ in range(20):
        text = [w if rng.random() > 0.1 else "other" for w in words]
        pairs = license_scan.align(text, words)
        assert all(text[i] == words[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) >= 0.95 * longest_common(text, words)


def test_license_scan(spark, docs, nothing):
    mit, line = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["GPL-3.0-line"]
    rows = [(1, "word " * 300 + mit + " tail" * 50 + "\n" + mit), (2, f"before {line.upper()} after"), (3, "the license of this work"), (4, None), (5, ""), (6, mit.replace("Software", "Program")), (6, "x")]
    out = sorted(((r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(1, "MIT"), (2, "GPL-3.0-line"), (3, None), (4, None), (5, None), (6, "MIT"), (6, None)], key=str)
    assert license_scan.scan_licenses(docs).where("license IS NOT NULL").count() == 0
    assert license_scan.scan_licenses(nothing).count() == 0


def planted(rng, template, words):
    """A text with copies of the template, some words lost and some fillers put between, and where they are."""
    text, at = [f"f{i}" for i in rng.integers(0, 50, rng.integers(0, 30))], []
    for _ in range(rng.integers(1, 4)):
        fillers, lost = rng.integers(0, 6), rng.choice([0, 0.05, 0.15])
        copy = [x for w in template if rng.random() >= lost for x in (w, *[f"f{i}" for i in rng.integers(0, 50, rng.integers(0, fillers + 1))])]
        at.append((len(text), len(text) + len(copy)))
        text += copy + [f"f{i}" for i in rng.integers(0, 50, rng.integers(20, 60))]
    return text, at


def test_license_places_against_alignment_of_planted_copies():
    """Alignment is the judge: what a copy's own range aligns is found there, and whatever is reported has that many aligned words."""
    rng = np.random.default_rng(8)
    for name in ("MIT", "BSD-2-Clause", "Apache-2.0", "GPL-3.0"):
        template = license_scan.license_words(license_scan.TEMPLATES[name])
        need = 0.75 * len(template)
        for _ in range(15):
            text, at = planted(rng, template, 0)
            got = license_scan.places(text, template)
            assert all(z <= a for (_, z, _), (a, _, _) in zip(got, got[1:], strict=False))
            for a, z, n in got:
                assert need <= n <= longest_common(text[a:z], template) and any(x < z and a < y for x, y in at)
            for x, y in at:
                own = len(license_scan.align(text[x:y], template))
                if own >= need:
                    assert max((n for a, z, n in got if a < y and x < z), default=0) >= 0.9 * own


@pytest.mark.parametrize("fillers", [1, 2, 3, 4, 6])
def test_license_with_words_between_its_words(fillers):
    words = license_scan.license_words(license_scan.TEMPLATES["MIT"])
    copy = [x for w in words for x in (w, *["filler"] * fillers)]
    (one,) = license_scan.places(["before"] * 50 + copy + ["after"] * 50, words)
    assert one == (50, 50 + len(copy) - fillers, len(words))
    assert [n for _, _, n in license_scan.places(copy + ["x"] * 30 + copy, words)] == [len(words)] * 2


def test_license_words_scattered_over_a_long_text_are_none():
    words = license_scan.license_words(license_scan.TEMPLATES["MIT"])
    assert license_scan.places([x for w in words for x in (w, *["filler"] * 40)], words) == []


def test_alignment_alone_decides():
    """Without a word or a run that occurs once, nothing but equal ends is aligned, and the copy is none."""
    template = [f"w{i}" for i in range(8)] * 3
    text = ["q", *template[1:9], "r", *template[10:20], "s", *template[21:]]
    assert longest_common(text, template) >= 0.75 * len(template) > len(license_scan.align(text, template))
    assert license_scan.places(["x", *text, "y"], template) == []
    assert license_scan.places(["x", *template, "y"], template) == [(1, 25, 24)]


def test_runs_anchor_where_no_word_is_single():
    template = "a b c d a c b d b a d c".split()
    text = [*template[:4], "x", *template[4:8], "y", *template[8:]]
    assert [j for _, j in license_scan.align(["z", *text, "z"], template)] == list(range(12))


@pytest.mark.parametrize("between", ["\n", " and so on ", " x" * 30 + " "])
def test_license_repeated_close_together(between):
    for name, notice in license_scan.TEMPLATES.items():
        words = license_scan.license_words(notice)
        for copies in (2, 3):
            text = "some text " * 40 + between.join([notice] * copies) + " more text" * 40
            step = len(words) + len(license_scan.license_words(between))
            assert license_scan.places(license_scan.license_words(text), words) == [(80 + i * step, 80 + i * step + len(words), len(words)) for i in range(copies)]
            assert license_scan.scan(text, {name: words})[0] == (name, len(words), 1.0, 80, 79 + len(words))


def test_license_copy_beside_a_stray_word_in_a_long_text():
    words = license_scan.license_words(license_scan.TEMPLATES["BSD-2-Clause"])
    copy = [w for w in words if w != "disclaimer"]
    text = copy + ["filler"] * 400 + copy + ["filler"] * 400 + ["disclaimer"]
    assert [(a, z) for a, z, _ in license_scan.places(text, words)] == [(0, 66), (466, 532)]
    assert license_scan.scan(" ".join(text), {"BSD-2-Clause": words})[0][1] >= 0.9 * len(words)


def test_license_copy_without_many_single_words():
    words = license_scan.license_words(license_scan.TEMPLATES["BSD-2-Clause"])
    single = {w for w in words if words.count(w) == 1}
    for k in (10, 13, len(single)):
        copy = [w for w in words if w not in sorted(single)[:k]]
        assert license_scan.scan(" ".join(copy), {"BSD-2-Clause": words})[0][:2] == ("BSD-2-Clause", len(copy))


def test_license_scan_reports_every_template_and_place(spark):
    t = license_scan.TEMPLATES
    texts = [" some text ".join((t["MIT"], t["GPL-3.0-line"], t["MIT"])), f"{t['Apache-2.0']}\n{t['CC-BY-NC-4.0-line']}", "nothing here", None]
    out = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    exact = {i: [m.license for m in r.matches if m.coverage == 1] for i, r in out.items()}
    assert exact == {0: ["MIT", "GPL-3.0-line", "MIT"], 1: ["Apache-2.0-line", "Apache-2.0", "CC-BY-NC-4.0-line"], 2: [], 3: []}
    assert [out[i].license for i in range(4)] == ["MIT", "Apache-2.0", None, None]
    for i, r in out.items():
        words = license_scan.license_words(texts[i] or "")
        assert all(m.coverage < 1 or words[m.first_word : m.last_word + 1] == license_scan.license_words(t[m.license]) for m in r.matches)
    assert out[0].first_word == 0 and out[1].matches[-1].last_word == out[1].n_words - 1


def kneser_ney_of_order(texts, order):
    """P(w|context) of a plain model of any order, for comparison."""
    levels = [Counter(tuple((["<"] * (order - 1) + t)[i : i + order]) for t in texts for i in range(len(t)))]
    for _ in range(order - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    d = [ngram_lm.discounts([Counter(c.values())[i] for i in (1, 2, 3, 4)]) for c in levels]
    total, rest = defaultdict(int), defaultdict(float)
    for c, e in zip(levels, d, strict=True):
        for g, n in c.items():
            total[g[:-1]] += n
            rest[g[:-1]] += e[min(n, 3)]
    size = len(levels[0])

    def p(context, w):
        lower = p(context[1:], w) if context else 1 / (size + 1)
        if not total[context]:
            return lower
        n = levels[len(context)][(*context, w)]
        return max(n - d[len(context)][min(n, 3)], 0) / total[context] + rest[context] / total[context] * lower

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_of_any_order_against_brute_force(docs, corpus, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "FLUSH", 500)
    monkeypatch.setattr(ngram_lm, "SHARD", 400)
    monkeypatch.setattr(ngram_lm, "HOT", 300)
    tokens = lambda t: (t or "").encode().lower().split() + ["end"]
    train = [tokens(t) for i, t, *_ in corpus if i % 3]
    p = kneser_ney_of_order(train, order)
    model = ngram_lm.train(docs.where("doc_id % 3 <> 0"), order)
    assert len(model.discounts) == order - 1 and all(len(u) for u in model.hots)
    text = {i: (["<"] * (order - 1), tokens(t)) for i, t, *_ in corpus}
    for r in ngram_lm.score(docs, model).collect():
        marks, t = text[r.doc_id]
        padded = marks + t
        assert r.score == pytest.approx(sum(math.log10(p(tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(t)))


def test_ngrams_that_share_a_fingerprint_keep_their_counts(docs, corpus, monkeypatch):
    """With eight bits for a fingerprint nearly all share one; scores stay those of brute force for texts of training."""
    monkeypatch.setattr(ngram_lm, "fingerprint", lambda keys: (keys >> np.uint64(56)).astype(np.uint32))
    tokens = lambda t: (t or "").encode().lower().split() + ["end"]
    p = kneser_ney_of_order([tokens(t) for _, t, *_ in corpus], 3)
    model = ngram_lm.train(docs, 3)
    for _, text, *_ in corpus:  # here, as workers would score with the module's own fingerprint
        t, (of, sizes) = ["<", "<", *tokens(text)], ngram_lm.token_hashes([(text or "").encode()])
        score = model.score(of, ngram_lm.priors_of(of, sizes, 3))[0].sum()
        assert score == pytest.approx(sum(math.log10(p(tuple(t[i : i + 2]), w)) for i, w in enumerate(t[2:])))


def test_language_model_query_has_order_three():
    assert ngram_lm.ORDER == 3
