"""Ids beside nulls, clashing columns, repeated rows, empty tables, long input, ties; exact methods against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.llm import common, embedding_dedup, exact_dedup, html_extract, language_id, line_dedup, lm_scoring, mixing, ngram_join, packing, passage_dedup

BIG = [2**53 + 1, 2**53 + 3, None, 2**53 + 5]
TEXTS = ["alpha beta gamma delta epsilon zeta eta", "one two three four five six", None, "alpha beta gamma delta epsilon zeta eta theta iota"]
CLASH = "spans string, n_removed string, score string, lang_pred string, _probability string, _source string, n_lines string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, *"abcdefg") for i, t in zip(BIG, TEXTS, strict=True)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=lambda x: (x is None, x))


WANT = sorted(BIG, key=lambda x: (x is None, x or 0))


def test_ids_beside_a_null_and_clashing_columns(spark, docs):
    assert ids(ngram_join.jaccard_join(docs)) == WANT
    assert ids(exact_dedup.exact_dedup(docs)) == WANT
    assert ids(packing.pack(docs, window=64)) == WANT
    assert ids(lm_scoring.score(docs)) == WANT
    cut = line_dedup.line_dedup(docs)
    assert ids(cut) == WANT and cut.columns.count("n_removed") == 1 and {r.spans for r in cut.collect()} == {"a"}
    model = language_id.fit(docs)
    named = language_id.predict(docs, model)
    assert ids(named) == WANT and named.columns.count("score") == 1 and "spans" in named.columns
    assert ids(mixing.decide(docs)) == WANT
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and set(ids(kept)) <= set(WANT)
    gone = passage_dedup.remove_passages(docs, passage_dedup.repeated_passages(docs))
    assert ids(gone) == WANT and {r.spans for r in gone.collect()} == {"a"}
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.when(F.col("text").isNotNull(), F.lit(2**53 + 1)).alias("label"), F.lit(1).alias("v"))
    assert ids(embedding_dedup.near_duplicates(vectors), "vec_id") == WANT
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), F.lit(1).alias("nodes"))
    assert ids(html_extract.extract(pages), "page_id") == WANT


def test_empty_tables(docs):
    none = docs.where("false")
    assert line_dedup.line_dedup(none).count() == 0
    assert language_id.predict(none, language_id.fit(docs)).count() == 0
    assert html_extract.extract(none.selectExpr("doc_id AS page_id", "text AS url", "text AS html")).count() == 0
    import corpus_pipeline as cp

    for _, stage in cp.STAGES:
        assert stage(docs.sparkSession, none.select(*cp.COLUMNS), "").count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f g\nx\ny"), (1, "a b c d e f g\nx\ny"), (2, "a b c d e f g\nx\ny"), (2, "other words stand here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(ids(line_dedup.line_dedup(docs))) == 4
    assert len(ids(lm_scoring.score(docs))) == 4
    assert {r.doc_id for r in passage_dedup.repeated_passages(docs).where("removed").collect()} == {2}
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0)] * 2 + [(2, [1.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    assert {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vectors).collect()} == {(1, 2, 1), (2, 2, 1)}
    page = "<article><p>same</p></article>"
    pages = spark.createDataFrame([(1, "http://h/1", page)] * 3, "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(pages).collect()] == ["same"] * 3


def test_one_row_of_a_doc_id_stays_in_the_pipeline(spark):
    import corpus_pipeline as cp

    rows = [(1, "b c d", "en", "s", 5), (1, "a c d", "en", "s", 5), (2, "e f", "en", "s", 3), (None, "g", "en", "s", 1), (None, "g", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text) for r in cp.near_duplicates(spark, docs, "").collect()))
    assert got == [(0, "g"), (0, "g"), (1, "a c d"), (2, "e f")]


def test_ties(spark):
    docs = spark.createDataFrame([(k, t, la) for k, (t, la) in enumerate([("kk kk", "b"), ("kk kk", "a")] * 20)], "doc_id long, text string, lang string")
    got = {(r.lang_pred, round(r.score, 3)) for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert len(got) == 1  # equal texts, one answer
    counts = spark.createDataFrame([(b"y", 3), (b"x", 3), (b"z", 3)], "word binary, n long").withColumn("code", F.lit(0))
    s = lm_scoring.Settings(classes=2, shared=2, most_classes=2)
    assert lm_scoring.vocabulary(counts, s, counts) == [b"x", b"y"]


def test_rounds_of_the_tree_merge(spark):
    assert [exact_dedup.rounds(n, 2) for n in (1, 2, 8, 33)] == [1, 1, 3, 6]
    assert [exact_dedup.rounds(n) for n in (2, 8, 33, 800_000)] == [1, 2, 3, 10]
    rows = spark.range(0, 400, 1, 33).selectExpr("id AS doc_id", "concat('t ', id % 57) AS text")
    entries = common.materialize(exact_dedup.digests(rows))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = exact_dedup.tree_merge(entries)
        runs = entries.select("run").distinct().count()
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == exact_dedup.rounds(entries.agg(F.max("run")).first()[0] + 1) and runs >= 1
    assert {(r.head.doc_id, r.group_size) for r in merged.collect()} == {(k, len(range(k, 400, 57))) for k in range(57)}


def test_targets(spark):
    rows = [(k, "w " * (5 + k % 3), ("en", "de", "fr")[k % 3], f"s{k % 2}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.lang: r.probability for r in mixing.decide(docs, {"lang": {"en": 1.0, "fr": 0.0, "zz": 0.4}}).select("lang", "probability").distinct().collect()}
    assert got["de"] == got["fr"] == 0.0 and got["en"] > 0
    assert {r.probability for r in mixing.decide(docs, {"lang": {"zz": 1.0}}).collect()} == {0.0}
    cells = docs.groupBy("source", "lang").agg(F.sum(F.length("text")).alias("tokens")).withColumn("topic", F.lit("t")).select("source", "lang", "topic", "tokens")
    goals = mixing.goals(cells, {"lang": {"en": 0.6, "de": 0.1, "fr": 0.3}}, mixing.TEMPER)
    here, there = (sorted((r.source, r.lang, round(r.weight, 9)) for r in mixing.rake(cells, goals, most_local=n).collect()) for n in (100, 0))
    assert here == there and sum(w for _, la, w in here if la == "en") == pytest.approx(0.6)


@pytest.mark.parametrize("kind", ["isotropic", "common direction", "low rank"])
def test_every_link_at_the_threshold(spark, kind):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 32))
    if kind == "common direction":
        base = base * 0.15 + 0.5
    elif kind == "low rank":
        base = rng.standard_normal((400, 6)) @ rng.standard_normal((6, 32)) + 0.05 * base
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    step = rng.standard_normal(u.shape)
    step -= (step * u).sum(axis=1, keepdims=True) * u
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    c = rng.uniform(0.980, 0.985, (400, 1))
    x = np.concatenate([u, c * u + np.sqrt(1 - c * c) * step])
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(x))] == want.tolist()


def test_sure_budget_holds_every_pair():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre, projection = embedding_dedup.learn_rotation(x, 16, 32)
    step = rng.standard_normal(x.shape)
    step -= (step * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * step / np.linalg.norm(step, axis=1, keepdims=True)
    need = embedding_dedup.least_budgets((x - centre) @ projection, (y - centre) @ projection, 4)
    assert need.max() <= embedding_dedup.sure_budget(16, 32, 4, 0.98)
    squares, budget = rng.random(8), 0.9
    brute = {sum(1 << b for b in s) for k in range(9) for s in itertools.combinations(range(8), k) if sum(squares[list(s)]) <= budget}
    assert set(embedding_dedup.turned(squares, budget)) == brute


def test_likelihood_by_hand():
    s = lm_scoring.Settings(classes=3, shared=2, dims=4)
    rng = np.random.default_rng(9)
    w = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in lm_scoring.initial(s).items()}
    seq = np.array([4, 0, 8, 8, 3, 1], dtype=np.int32)

    def probabilities(at):
        total = w["bias"].astype(float).copy()
        for k, o in enumerate((-2, -1, 1, 2)):
            total += w["emb"][k][seq[at + o] if 0 <= at + o < len(seq) else s.size]
        h, out = np.tanh(total), []
        a = np.exp(h @ w["major"] + w["major_bias"])
        for entry in range(s.size):
            b = np.exp(h @ w["minor"] + w["minor_bias"][entry // 3])
            out.append(a[entry // 3] / a.sum() * b[entry % 3] / b.sum())
        return out

    want = 0.0
    for at, entry in enumerate(seq):
        p = probabilities(at)
        assert sum(p) == pytest.approx(1.0, abs=1e-5)
        want += math.log(p[entry])
    assert lm_scoring.log_likelihood(w, seq, s) == pytest.approx(want, rel=1e-4)


def test_held_out_text_is_likelier_than_by_counts(spark):
    rng = np.random.default_rng(2)
    follow = {k: [(3 * k + 1) % 40, (5 * k + 2) % 40] for k in range(40)}

    def text(n):
        at, out = int(rng.integers(40)), []
        for _ in range(n):
            out.append(f"w{at}")
            at = follow[at][int(rng.integers(2))]
        return " ".join(out)

    train, held = [text(400) for _ in range(300)], [text(400) for _ in range(20)]
    s = lm_scoring.Settings(classes=8, shared=4)
    source = spark.createDataFrame([(k, t) for k, t in enumerate(train)], "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text"))
    words = lm_scoring.vocabulary(source.select("text"), s)
    weights = lm_scoring.fit(common.materialize(lm_scoring.encode(source, words, s)), s)
    vocab = lm_scoring.Vocabulary(words, s)
    encoded = [vocab.ids(vocab.codes(t.encode())).astype(np.int32) for t in train + held]
    counts = np.bincount(np.concatenate(encoded[:300]), minlength=s.size) + 1.0
    by_counts = sum(np.log(counts / counts.sum())[e].sum() for e in encoded[300:])
    assert sum(lm_scoring.log_likelihood(weights, e, s) for e in encoded[300:]) > by_counts + 0.3 * 20 * 400


def test_pages(spark):
    pages = {
        1: ('<body><article><p>Main words</p><p class="share">keep share</p><div class="related work">keep related</div><figure class="side-by-side">cap</figure><div class="comments">bad</div></article></body>', "Main words keep share keep related cap"),
        2: (f"<body><article>teaser</article><main><h1>Head</h1><p>{'long text ' * 20}</p></main></body>", ("Head " + "long text " * 20).strip()),
        3: ("<p data-a=it's>Hello world</p><p>don't stop</p>", "Hello world don't stop"),
        4: ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        5: ("<nav>only menu</nav>", ""),
    }
    rows = [(k, f"http://h{k}/", p) for k, (p, _) in pages.items()]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: t for k, (_, t) in pages.items()}


def test_the_tree_decides_doubtful_names(spark):
    """Inside the articles of a site a block named "share" goes where the site repeats it, and stays where it doesn't."""
    body = '<body><article><p>story %s</p><div class="share">%s</div></article></body>'
    rows = [(k, f"http://same/{k}", body % (k * 7919, "Share this on all networks")) for k in range(12)] + [(100 + k, f"http://own/{k}", body % (k * 7919, f"shares of firm {k * 31}")) for k in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"story {k * 7919}" for k in range(12)}, **{100 + k: f"story {k * 7919} shares of firm {k * 31}" for k in range(12)}}


def test_importances_by_hand(spark):
    rows = [(k, "http://h/", f"<div>menu</div><div><p>t{k}</p></div>") for k in range(4)]
    hosted = spark.createDataFrame(rows, "page_id long, url string, html string").select("html", F.lit("h").alias("host"), F.col("page_id").alias("key"))
    tree = {r.path: (r.pages, round(r.importance, 6)) for r in html_extract.style_tree(html_extract.gathered(hosted)).collect()}
    root = html_extract.parse(rows[0][2])
    menu, holder = root.children
    # Both <div> share a path, shown eight times in two layouts: the entropy of halves, to the base 8. <p> has four runs, one a page.
    assert tree[html_extract._signed(menu.path)] == (8, round(math.log(2) / math.log(8), 6)) and menu.path == holder.path
    assert tree[html_extract._signed(holder.children[0].path)] == (4, 1.0)


def test_passages_do_not_depend_on_order(spark):
    rng = np.random.default_rng(12)
    words = [f"q{k}" for k in range(300)]
    p, far = " ".join(rng.choice(words, 60)), " ".join(rng.choice(words, 40))
    near = " ".join(f"e{k}" if k == 30 else w for k, w in enumerate(p.split()))
    rows = [(1, f"{far} {p}"), (2, f"{p} {near} tail of it"), (3, f"x y z {near}"), (4, "short text here"), (5, "short text here"), (6, "short text there is")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = [sorted(map(tuple, passage_dedup.repeated_passages(d).collect())) for d in (df.coalesce(1), df.orderBy(F.desc("doc_id")).coalesce(1), df.repartition(5))]
    assert results[0] == results[1] == results[2]
    assert {r[0] for r in results[0] if r[5]} == {2, 3, 5}


def test_long_texts(spark):
    long = " ".join(f"l{k % 9001}" for k in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "\n".join(long.split()))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_join(docs).collect()} == {1: 1, 2: 1, 3: 1}
    spans = [r for r in passage_dedup.repeated_passages(docs).collect() if r.removed]
    assert {r.doc_id for r in spans} == {2, 3}
    assert {r.doc_id: r.n_lines for r in line_dedup.line_dedup(docs).collect()}[3] == 60_000
    assert sum(r.n_tokens for r in lm_scoring.score(docs).collect()) == 180_001


def test_a_shared_folder_is_needed_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
