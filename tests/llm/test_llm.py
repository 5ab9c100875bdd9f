"""Small fixtures against brute force: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylog.llm import common, embedding_dedup, exact_dedup, html_extract, language_id, line_dedup, lm_scoring, mixing, ngram_join, packing, passage_dedup, shingles
from quarrylog.llm.queries import ORACLES, QUERIES

WORDS = [f"w{k}" for k in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def edited(text, seed, every):
    rng = np.random.default_rng(seed)
    return " ".join(f"x{rng.integers(99)}" if rng.random() < 1 / every else w for w in text.split())


BASE = [prose(k, 60 + 7 * k) for k in range(8)]
TEXTS = [
    *BASE, *[edited(BASE[k % 8], 50 + k, 60) for k in range(16)], *[edited(BASE[k % 8], 90 + k, 25) for k in range(8)], BASE[0], BASE[0] + " ", BASE[0].upper(), None, "", " \t\n", "one two", "One  two", "one two three",
    prose(5, 20_000), BASE[1] + " " + prose(77, 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, 1, True) for k, t in enumerate(TEXTS)]
    rows += [(None, "no id at all", None, None, None, None), (0, BASE[0], "en", "s0", 1, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean")


def empty(docs):
    return docs.where("false")


def linked_classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(5, 40), (100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 5 for k in [5, *range(10, 41)]}, 90: 90, 95: 90, 100: 90}


def test_ngram_join(docs):
    sets = {}
    for k, t in enumerate(TEXTS):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    classes = linked_classes(sets, linked)
    assert len(set(classes.values())) < len(classes) - 15
    rows = ngram_join.jaccard_join(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == {(k, len(s), classes[k]) for k, s in sets.items()}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert ngram_join.jaccard_join(empty(docs)).count() == 0


def test_ngram_join_of_large_tiles(spark):
    """Near copies of one text whose first row is far from most: stars leave them open, later rounds join them."""
    rng = np.random.default_rng(4)
    base, rows = prose(3, 120).split(), []
    for k in range(90):
        words = list(base)
        for at in rng.choice(len(words), 6 if k == 0 else int(rng.integers(0, 4)), replace=False):
            words[at] = f"y{rng.integers(9999)}"
        rows.append((k, " ".join(words)))
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in rows)}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == linked_classes(sets, linked)


def test_dealt_neighbours(spark):
    """Only rows of different components, in room for a link, meet; each row meets a bounded number."""
    words = ", ".join(f"0L AS w{k}" for k in range(8))
    tile = spark.range(200).selectExpr("7L AS token", "200L AS size", "id AS doc_id", "id % 2 AS component", "100 AS n", "100 AS m", "0L AS b0", "0L AS b1", *words.split(", "))
    pairs = ngram_join._few_of_tile(tile, 75).collect()
    assert 0 < len(pairs) <= 200 * ngram_join._NEIGHBOURS
    assert all(p.a < p.b and (p.a - p.b) % 2 for p in pairs)
    far = tile.withColumn("b0", F.when(F.col("component") == 0, F.lit(0)).otherwise(F.lit(-1)).cast("long"))
    assert ngram_join._few_of_tile(far, 75).count() == 0
    assert ngram_join._few_of_tile(tile.where("false"), 75).count() == 0


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(1)
    for n in (5, 60, 700):
        x = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
        for shift in range(0, n, max(1, n // 20)):
            a, b = x[:n], x[shift : shift + n]
            common_n = len(np.intersect1d(a, b))
            if 100 * common_n >= 75 * (len(a) + len(b) - common_n):
                assert ngram_join.may_link(len(a), ngram_join.parity_bitmap(a), len(b), ngram_join.parity_bitmap(b), 75)


def test_exact_dedup(docs):
    rows = exact_dedup.exact_dedup(docs, fan_in=2).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in [*enumerate(TEXTS), (0, BASE[0]), (None, "no id at all")]:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((str(i), str(min(g, key=lambda x: (x is None, x))), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)  # of a repeated row one stays
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0


def test_word_hashes_tell_words_apart():
    rng = np.random.default_rng(5)
    pieces = [bytes(rng.choice(list(b"aAbB\xc3\xa9\x00\x85 \t\n\x0b\x0c\r"), n).tolist()) for n in (1, 7, 400, 40_000)]
    long = [b"x" * n + end for n in (63, 64, 65, 17_000, 40_000) for end in (b"", b"y", b"Y")]
    for text in (*pieces, b" ".join([*long, *pieces, *long]), b"w " * 30_000, b"v" * 16_383 + b" end " + b"V" * 16_383, b"", None, b" \n "):
        words = text.lower().split() if text else []
        got = shingles.word_hashes(text).tolist()
        assert len(got) == len(words)
        assert len(set(zip(words, got, strict=True))) == len(set(words)) == len(set(got))


def test_passages(spark):
    passage = prose(1000, 60)
    rows = [(k, prose(k + 200, 30 + k) + " " + passage + " " + prose(k + 300, 40)) for k in range(4)] + [(10, prose(400, 300)), (11, None), (12, ""), (13, "short text"), (None, passage), (14, prose(401, 50) + "\n" + "other start " + passage.split(" ", 2)[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passage_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 14}
    assert {r.doc_id for r in got if r.removed} == {1, 2, 3, 14} and {r.component_id for r in got} == {0}
    spans = passage_dedup.repeated_passages(docs)
    cut = {r.doc_id: r.text for r in passage_dedup.remove_passages(docs, spans).collect()}
    assert cut[0] == rows[0][1] and cut[11] is None and len(cut[1].split()) < len(rows[1][1].split()) - 20
    assert passage_dedup.repeated_passages(docs.where("false")).count() == 0
    assert passage_dedup.cut_words("a b\nc d e", [(1, 3)]) == "a d e"


def test_passages_go_whole(spark):
    rng = np.random.default_rng(77)
    passages = [" ".join(f"p{k}x{i}" for i in range(n)) for k, n in enumerate([50, 60, 60, 100, 500])]
    rows, want = [], {}
    for k, p in enumerate(passages):
        for copy in range(3):
            before, after = (" ".join(f"u{k}y{copy}z{rng.integers(10**9)}" for _ in range(30 + 7 * copy)) for _ in range(2))
            rows.append((10 * copy + k, f"{before} {p} {after}"))
            want[10 * copy + k] = f"{before} {p} {after}" if copy == 0 else f"{before} {after}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = common.materialize(passage_dedup.repeated_passages(docs))
    assert {r.doc_id: r.text for r in passage_dedup.remove_passages(docs, spans).collect()} == want
    kept = {r.doc_id: r.end_word - r.start_word for r in spans.where("NOT removed AND doc_id < 10").collect()}
    assert kept == {k: len(p.split()) for k, p in enumerate(passages)}


def test_edited_passages_go(spark):
    rows, want, edits = [], {}, [(55, [27]), (55, [20]), (60, [30]), (60, [9]), (60, [24]), (80, [26, 53]), (80, [23, 50]), (110, [28, 55, 82])] * 4
    for k, (n, at) in enumerate(edits):
        words = [f"p{k}x{i}" for i in range(n)]
        near = [f"e{k}y{i}" if i in at else w for i, w in enumerate(words)]
        a, b = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (words, near))
        assert len(a & b) >= 0.75 * len(a | b)  # brute force
        for copy, passage in enumerate((words, near)):
            around = [" ".join(f"{s}{k}u{copy}z{i}" for i in range(40 + 9 * copy)) for s in "bc"]
            rows.append((100 * copy + k, f"{around[0]} {' '.join(passage)} {around[1]}"))
            want[100 * copy + k] = " ".join(around) if copy else rows[-1][1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = common.materialize(passage_dedup.repeated_passages(docs))
    assert {r.doc_id: r.text for r in passage_dedup.remove_passages(docs, spans).collect()} == want


def test_anchors_are_dense_and_follow_content():
    h = np.random.default_rng(2).integers(0, 1 << 63, 500).astype(np.uint64)
    at = passage_dedup.anchors(h, 24, 26, 5)
    assert max(np.diff(at)) <= 26
    moved = passage_dedup.anchors(np.concatenate([np.arange(33, dtype=np.uint64), h]), 24, 26, 5) - 33
    assert set(at[at > 60]) <= set(moved)


def test_paragraphs_of_many_texts_at_once():
    texts = [t if t is None else t.encode() for t in [*TEXTS, *[prose(900 + n, n) for n in range(40)], "a b " * 30, "x" * 100 + " y" * 30]]
    signer = passage_dedup._Signer(2, 3)
    run = passage_dedup._paragraphs(12, 15, 5, signer)
    frame = pd.concat(run([pd.DataFrame({"doc_id": np.arange(len(texts)), "text": texts})]))
    want = []
    for k, text in enumerate(texts):
        words = shingles.word_hashes(text)
        s = shingles.shingle_hashes(words, 5)
        if len(words) >= passage_dedup.LEAST:
            want += [(k, a, passage_dedup._digests(s[None, a : a + 8])[0]) for a in passage_dedup.anchors(s, 12, 15, 5).tolist()]
        elif len(words):
            want.append((k, -len(words), passage_dedup._digests(s[None, :])[0]))
    assert sorted(zip(frame["doc_id"], frame["place"], frame["digest"], strict=True)) == sorted(want)
    least = frame.groupby("digest")["doc_id"].min()
    carriers = frame[frame["carrier"]]
    assert dict(zip(carriers["digest"], carriers["doc_id"], strict=True)) == least.to_dict() and len(carriers) == len(least)


def test_equal_passages_are_aligned_at_once(monkeypatch):
    """Seed by seed with ``passage``, over few words (equal by chance, beside edits and ends) and many."""
    calls, one_by_one = [], passage_dedup.passage
    monkeypatch.setattr(passage_dedup, "passage", lambda *a: calls.append(1) or one_by_one(*a))
    hash_of = lambda text: (shingles.word_hashes(text) >> np.uint64(32)).astype("<u4")
    for vocabulary, edits in ((3, 0.1), (400, 0.05), (400, 0)):
        rng = np.random.default_rng(vocabulary)
        first = [str(x) for x in rng.integers(vocabulary, size=300)]
        texts, chains, want, n_seeds = [], [], set(), 0
        for doc_id in range(30):
            low, high = sorted(rng.integers(300, size=2).tolist())
            copy = [w if rng.random() >= edits else rng.choice(["e", "e e", ""]) for w in first[low:high]]
            before = [f"b{doc_id}"] * int(rng.integers(4))
            texts.append(" ".join([*before, *copy, *["z"] * int(rng.integers(4))]).encode())
            chains.append([])
            d = hash_of(texts[-1])
            for f_from in (max(0, low - 64), low + 3):
                f = hash_of(" ".join(first[f_from : high + 64]).encode())
                seeds = [(at - low + len(before), at, 12, passage_dedup.CUT) for at in sorted(rng.integers(max(low, f_from), 300, size=6).tolist()) if at + 12 <= min(high, f_from + len(f)) and at - low + len(before) + 12 <= len(d)]
                chains[-1].append({"first": 7000 + f_from, "f_from": f_from, "seeds": [x for seed in seeds for x in seed], "words": f.tobytes(), "n_documents": 2})
                (d_shingles, f_shingles), done = (shingles.shingle_hashes(x.astype(np.uint64), 5) for x in (d, f)), 0
                for start, at, size, _ in seeds:
                    if start + size > done:
                        n_seeds += 1
                        a, b, fa, fb = one_by_one(d, d_shingles, f, f_shingles, start, at - f_from, size, 5, 75)
                        if b - a >= passage_dedup.LEAST:
                            done = b
                            want |= {(doc_id, a, b, 7000 + f_from, 2), (7000 + f_from, fa + f_from, fb + f_from, 7000 + f_from, 2)}
        kind = pa.struct([("first", pa.int64()), ("f_from", pa.int64()), ("seeds", pa.list_(pa.int64())), ("words", pa.binary()), ("n_documents", pa.int64())])
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(30), pa.int64()), "text": pa.array(texts, pa.binary()), "chains": pa.array(chains, pa.list_(kind))})
        calls.clear()
        got = {tuple(r.values()) for out in passage_dedup._aligned(5, 75)([batch]) for r in out.to_pylist()}
        assert got == want and n_seeds > 30
        if not edits:
            assert len(got) > 30 and not calls


def test_passages_without_a_sort_of_all_paragraphs(spark, monkeypatch):
    plans, write = {}, common.materialize

    def planned(df, label="t"):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(passage_dedup, "materialize", planned)
    docs = spark.createDataFrame([(k, prose(k % 3, 60) + " " + prose(100 + k, 30)) for k in range(9)], "doc_id long, text string")
    assert passage_dedup.repeated_passages(docs).where("removed").count() == 6
    assert "ShuffledHashJoin" in plans["hits"] and "SortMergeJoin" not in plans["hits"] and "SortAggregate" not in plans["digests"]


def test_mixing(docs):
    rows = mixing.decide(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r.probability <= 1 for r in rows)
    assert max(r.probability for r in rows) == 1.0
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.decide(empty(docs)).count() == 0


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([(s, la, t, 10 + 7 * s + 3 * la + t) for s in range(3) for la in range(2) for t in range(2)], "source int, lang int, topic int, tokens long")
    share = lambda m, shares: spark.createDataFrame(list(enumerate(shares)), f"{m} int, share double")
    targets = {"source": share("source", [0.5, 0.3, 0.2]), "lang": share("lang", [0.6, 0.4]), "topic": share("topic", [0.25, 0.75])}
    raked = mixing.rake(cells, targets, rounds=12)
    for m, shares in (("source", [0.5, 0.3, 0.2]), ("lang", [0.6, 0.4]), ("topic", [0.25, 0.75])):
        got = [r.w for r in raked.groupBy(m).agg(F.sum("weight").alias("w")).orderBy(m).collect()]
        assert np.allclose(got, shares, atol=1e-6)


def test_language_id(spark):
    syllables = {"aa": ["ka", "mo", "ti", "lu"], "bb": ["sch", "ung", "ein", "tz"]}
    rng = np.random.default_rng(4)
    make = lambda la, n: " ".join("".join(rng.choice(syllables[la], rng.integers(1, 4))) for _ in range(n))
    rows = [(k, make("ab"[k % 2] * 2, 12), "ab"[k % 2] * 2, 1) for k in range(300)] + [(900, None, "aa", 1), (901, "123 !!", "aa", 1), (902, "", None, 1), (None, make("bb", 9), None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.fit(docs.where(~language_id.held_out()))
    got = language_id.predict(docs.select("doc_id", "lang", language_id.held_out().alias("held_out"), "text"), model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out and r.doc_id < 900]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    none = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 16))
    vectors = [v.tolist() for v in x] + [(v + rng.standard_normal(16) * 0.04).tolist() for v in x] + [x[0].tolist(), (2 * x[0]).tolist()]
    rows = [(k, v, k % 3 if k < 80 else 0) for k, v in enumerate(vectors)]
    odd = [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, vectors[0], None), (204, [1.0, None], 0), (205, [], 0), (None, vectors[0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    linked = [(a, b) for (a, va, la), (b, vb, lb) in itertools.combinations(rows, 2) if la == lb and cos(va, vb) >= 0.98]
    classes = linked_classes([r[0] for r in rows], linked)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert {k: got[k].component_id for k in classes} == classes
    assert {k: got[k].n_links for k in classes} == {k: sum(k in p for p in linked) for k in classes}
    assert all(got[k].n_links == 0 and got[k].kept for k in range(200, 206)) and got[None].component_id is None
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd", 7), (2, "x\na\nb\nc\ny", 7), (3, "a\nb", 7), (4, None, 7), (5, "", 7), (6, "q\nq\nq\nq\nq", 7), (7, "\n\n\n\n", 7), (None, "a\nb\nc", 7), (8, "b\nc\nd", 7)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_rows int")).collect()}
    assert got == {
        1: ("a\nb\nc\nd", 4, 0), 2: ("x\ny", 5, 3), 3: ("a\nb", 2, 0), 4: (None, 0, 0), 5: ("", 1, 0), 6: ("q\nq\nq", 5, 2), 7: ("\n\n\n\n", 5, 0), None: ("a\nb\nc", 3, 0), 8: ("", 3, 3),
    }


def test_packing(docs):
    rows = packing.pack(docs, window=64).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    tokenizer.encode_special_tokens = True
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(TEXTS)}
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
            assert (len(part), zlib.crc32(part.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
    for pieces in spans.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(pieces)) and sum(pieces[-1]) <= 64
    assert sum(r.length for r in rows if r.doc_id == 38) == len(ids[38])
    assert packing.pack(empty(docs)).count() == 0


def test_engines_agree():
    t = packing.ByteTokenizer(packing.vocabulary_path())
    for text in ("Hello  wörld's\n\n çé 12345 ###", "<|endoftext|> x", "日本語 テスト", "a b \t\n c", "", "x" * 5000):
        assert t.ids(text) == t._full.encode(text, add_special_tokens=False).ids


def test_best_fit_is_tight():
    counts = {n: int(c) for n, c in zip(range(1, 101), np.random.default_rng(8).integers(0, 40, 100), strict=True)}
    placed, windows = packing.best_fit_decreasing(counts, 100)
    assert sum(p[2] - p[1] for p in placed) == sum(counts.values())
    open_room = []  # the plain algorithm, piece by piece
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [r for r in open_room if r >= n]
        if fits:
            open_room.remove(min(fits))
        open_room.append((min(fits) if fits else 100) - n)
    assert windows == len(open_room)


def test_lm_scores(spark, docs):
    plain = [(k, "the cat sat on the mat and the dog lay by the door") for k in range(200)]
    odd = [(900, "door mat the dog the the by sat lay and cat on the"), (901, None), (902, " "), (None, "the cat")]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(plain + odd, "doc_id long, text string"), lm_scoring.Settings(stride=2, rounds=6)).collect()}
    assert got[0].n_tokens == 13
    assert got[0].mean_score > got[900].mean_score
    assert (got[901].n_tokens, got[901].score, got[901].mean_score) == (0, 0.0, None) and got[902].n_tokens == 0
    assert lm_scoring.score(empty(docs)).count() == 0


def test_lm_scores_tell_unknown_words_from_common_ones(spark):
    rng = np.random.default_rng(4)
    usual = [(k, " ".join(rng.choice([f"c{i}" for i in range(12)], 40))) for k in range(60)]
    junk = [(100 + k, " ".join(f"j{k}x{i}" for i in range(40))) for k in range(60)]
    s = lm_scoring.Settings(classes=4, shared=4, stride=1)
    rows = spark.createDataFrame(usual + junk + junk[:1], "doc_id long, text string")
    got = lm_scoring.score(rows, s).collect()
    means = {r.doc_id: r.mean_score for r in got}
    assert len(got) == 121 and max(means[100 + k] for k in range(60)) < min(means[k] for k in range(60))
    # The words of an entry have probabilities that add up to one.
    source = rows.selectExpr("doc_id", "cast(text as binary) text")
    encoded = lm_scoring.encode(source, lm_scoring.vocabulary(source.select("text"), s), s).withColumn("tag", F.col("doc_id"))
    shares = {r.tag: r.rare_score for r in lm_scoring.rare_shares(encoded, s).collect()}
    words = [w for _, t in junk + junk[:1] for w in t.split()]
    entry = lambda w: (lm_scoring.xxhash.xxh3_64_intdigest(w.encode()) >> 1) % s.shared
    whole = [sum(entry(w) == e for w in words) for e in range(s.shared)]
    assert shares[101] == pytest.approx(sum(np.log(1 / whole[entry(w)]) for w in junk[1][1].split()))


def test_lm_learns_from_every_position(spark):
    import pandas as pd

    s = lm_scoring.Settings()  # as in production
    texts = [np.random.default_rng(k).integers(0, s.size, n).astype("<u2").tobytes() for k, n in enumerate([1, 3, 15, 16, 40, 3000])]

    class Shipped:
        value = lm_scoring.initial(s)

    got = pd.concat(lm_scoring._learn(Shipped, s)(iter([pd.DataFrame({"ids": texts})])))
    assert set(got["tokens"]) == {1 + 3 + 15 + 16 + 40 + 3000}
    sentence = "the cat sat on the mat and the dog lay by the door".split()
    mixed = list(np.random.default_rng(1).permutation(sentence))
    rows = [(k, " ".join(sentence * 20)) for k in range(600)] + [(900, " ".join(mixed * 20))]
    scores = {r.doc_id: r.mean_score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert scores[0] > scores[900]


def test_rows_are_subtracted_as_one_by_one():
    rng = np.random.default_rng(6)
    table, rows, values = rng.random((9, 4)), rng.integers(0, 9, 50), rng.random((50, 4))
    want = table.copy()
    np.subtract.at(want, rows, values)
    lm_scoring._subtract_rows(table, rows, values)
    assert np.allclose(table, want)


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav>Menu</nav><div class="cookie-notice">We use</div><article><header><h1>A &amp; B</h1></header><p>one<b>two</b> &nbsp; three<br>four<p>five<aside>Ad</aside><form>f</form><script>x="</p>"</script></article><div id="comments">c</div><footer>&copy;</footer></body>'
    rows = [(1, "http://h/1", page), (2, None, None), (3, "http://h/3", ""), (4, "http://h/4", "no markup at all"), (5, "http://h/5", "<p>a < b <i>c"), (None, "u", page)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[None] == ("A & B onetwo three four five", 28)
    assert got[2] == got[3] == ("", 0) and got[4][0] == "no markup at all" and got[5][0] == "a < b c"


def test_style_tree_drops_what_a_site_repeats(spark):
    body = "<html><body><div>Home About Contact</div><div><p>story %s of %s</p></div><div>All rights reserved</div></body></html>"
    rows = [(k, f"http://h/{k}", body % (k * 7919, "q" * (k + 1))) for k in range(20)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"story {r.page_id * 7919} of {'q' * (r.page_id + 1)}" for r in got)


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_pipeline(spark):
    import corpus_pipeline as cp

    rows = [(k, f"{prose(k, 40)}\n{prose(k + 50, 30)}\n{prose(k + 90, 30)}", "en", f"s{k % 2}", 1) for k in range(20)]
    rows += [(30, rows[0][1], "en", "s0", 1), (31, rows[1][1] + " tail", "en", "s0", 1), (32, "!!! 123", "en", "s1", 1), (33, None, "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for _, stage in cp.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, ""))
        assert docs.columns == list(cp.COLUMNS)
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == {*range(20), 30, 31} and seen[1] == {*range(20), 31} and seen[2] == {*range(20)}
    assert seen[3] <= seen[2] and {r.doc_id for r in cp.STAGES[-1][1](spark, docs, "").collect()} == seen[3]
