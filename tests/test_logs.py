import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.functions import fingerprint as fp
from quarrylog.functions import parsing
from quarrylog.functions.severity import classify_severity
from quarrylog.operators import clusters, issues, logs, report
from quarrylog.sources import logs as source


def files(spark, *contents, name="a.log"):
    return spark.createDataFrame([(str(k), name, len(c), c) for k, c in enumerate(contents)], "source_id string, file_name string, length long, content string")


def entries(spark, *raws):
    return logs.parse_lines(source.lines(files(spark, "\n".join(raws)))).orderBy("line_number").collect()


def test_lines_end_at_line_feeds_only(spark):
    rows = source.lines(files(spark, "a\r\nb\rc\n")).orderBy("line_number").collect()
    assert [(r.line_number, r.raw) for r in rows] == [(1, "a"), (2, "b\rc"), (3, "")]


def test_rejections(spark):
    rows = source.rejection(files(spark, "x", " \t "), max_size=10).orderBy("source_id").collect()
    assert [r.status for r in rows] == [None, 400]
    assert source.rejection(files(spark, "x", name="A.CSV")).first().status == 400
    assert source.rejection(files(spark, "x" * 11, name="A.LOG"), max_size=10).first().status == 413


@pytest.mark.parametrize(
    ("raw", "fmt", "level", "message"),
    [
        ("2026-03-04 08:15:00 ERROR Store write failed", "text", "ERROR", "Store write failed"),
        ('{"ts":"2026-03-04T08:15:00Z","lvl":"critical","msg":"Lost"}', "json", "FATAL", "Lost"),
        ('10.1.1.9 - - [04/Mar/2026:08:15:00 +0000] "PUT /v1/cart HTTP/1.1" 502 91 "-" "agent"', "nginx", "ERROR", "PUT /v1/cart — 502"),
        ('10.1.1.9 - amy [04/Mar/2026:08:15:00 +0000] "GET /x HTTP/1.1" 404 5', "nginx", "WARN", "GET /x — 404"),
        ("<12>Mar 04 08:15:00 box cron[77]: job skipped", "syslog", "INFO", "job skipped"),
        ("2026-03-04 08:15:00,007 - svc - WARNING - heap", "text", "WARN", "heap"),
        ("08:15:00 ERROR code 12345 x", None, "ERROR", "code # x"),
        ("an error in lower case", None, "UNKNOWN", "an error in lower case"),
        ("{broken", None, "UNKNOWN", "{broken"),
    ],
)
def test_formats(spark, raw, fmt, level, message):
    row = entries(spark, raw)[0]
    assert (row.format, row.level, row.message) == (fmt, level, message)


def test_groups_frequency_and_buckets(spark):
    raws = [f"2026-03-04 08:{m:02}:00 ERROR Link failed for user {70000 + m}" for m in range(4)] + ["2026-03-04 09:00:00 FATAL gone", "10:00:00 ERROR bare", "", "2026-03-04 09:61:00 WARN bad time"]
    parsed = logs.parse_lines(source.lines(files(spark, "\n".join(raws))))
    groups = logs.error_groups(parsed)
    top = logs.error_frequency(groups).orderBy("rank").collect()
    assert [(r["rank"], r["count"], r["percentage"]) for r in top] == [(1, 4, 66.7), (2, 1, 16.7), (3, 1, 16.7)]
    buckets = logs.time_buckets(parsed).orderBy("start").collect()
    assert [(r.start, r.error_count, r.total_count) for r in buckets] == [("2026-03-04T08:00:00.000Z", 4, 4), ("2026-03-04T09:00:00.000Z", 1, 1)]
    total = logs.summary(source.lines(files(spark, "\n".join(raws)))).first()
    assert (total.total_lines, total.blank_lines, total.error_count, total.critical_count, total.warning_count, total.unique_error_count, total.detected_format) == (7, 1, 6, 1, 1, 3, "text")


def test_empty_log(spark):
    total = logs.summary(source.lines(files(spark, ""))).first()
    assert (total.total_lines, total.blank_lines, total.error_count, total.detected_format) == (0, 1, 0, "unknown")


@pytest.mark.parametrize(("level", "message", "severity"), [("ERROR", "x", "High"), ("ERROR", "Deadlock", "Critical"), ("WARN", "x", "Medium"), ("INFO", "x", "Low"), ("INFO", "an error", "High")])
def test_severity(spark, level, message, severity):
    assert spark.range(1).select(classify_severity(F.lit(level), F.lit(message))).first()[0] == severity


@pytest.mark.parametrize(
    ("message", "clean", "category"),
    [
        ("at 2026-03-04 08:15:00 x", "at 2026-03-04 <ip> x", "General"), ("at 2026-03-04T08:15:00Z x", "at <ts> x", "General"),
        ("read /var/lib/x failed", "read <path> failed", "General"), ("status: 404 on host:8080", "status: <n> on host:<port>", "Not Found"),
        ("a disk full", "a disk full", "Disk"), ("disk full", "disk full", "General"), ("Failed to connect to redis", "Failed to connect to redis", "Failure"),
    ],
)
def test_fingerprint(spark, message, clean, category):
    row = spark.range(1).select(fp.clean_message(F.lit(message)).alias("c"), fp.category(F.lit(message)).alias("k")).first()
    assert (row.c, row.k) == (clean, category)


def test_services_in_table_order_with_ascii_edges(spark):
    row = spark.range(1).select(fp.services(F.lit("API user of postgresql: éredis"))).first()[0]
    assert row == ["PostgreSQL", "Redis", "User", "API"]


def test_clusters_and_centroids(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, 0.4358898943540674], 0), (3, [0.0, 1.0], 0), (4, [0.44, 0.898], 0)]
    items = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    named = {r.id: (r.cluster, r.size) for r in clusters.cluster(items, 0.9).collect()}
    assert named == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}
    axes = spark.createDataFrame([(1, [2.0, 0.0], 0), (2, [0.0, 2.0], 0)], items.schema)
    assert [round(r.value, 6) for r in clusters.centroids(axes, "label").orderBy("pos").collect()] == [0.707107, 0.707107]
    assert spark.range(1).select(clusters.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).first()[0] == 0.0


ODD = "id string, embedding array<double>, g int"


def odd_items(spark):
    rng, nan, inf = np.random.default_rng(5), float("nan"), float("inf")
    centres = rng.standard_normal((40, 8))
    near = centres[rng.integers(0, 40, 300)] + 0.25 * rng.standard_normal((300, 8))
    rows = [(f"v{k % 290}", (v / np.linalg.norm(v)).tolist(), int(k % 3)) for k, v in enumerate(near)]  # ten ids stand twice
    odd = [[1.0, 0.0], [0.8, 0.6], [nan, 1.0], [inf, 0.0], [-inf, inf], [1e200, 1e200], [-1e200, 1e200], [None, 1.0], [], None, [0.0, 0.0], [3e-9, 4e8], [1e9, 0.7]]
    rows += [(f"o{k}", v, 1) for k, v in enumerate(odd)] + [(None, [1.0, 0.0], 1), ("w1", [1.0, 0.0], None), ("w2", [1.0, 0.0], None)]
    return spark.createDataFrame(rows, ODD)


def linked(pairs):
    """Every linked id with the smallest id it leads to, by plain search."""
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
        to.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(to):
        todo = [] if start in out else [start]
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = start
                todo += to[x]
    return out


@pytest.mark.parametrize("block_bytes", [1, clusters.BLOCK_BYTES])
def test_clusters_of_odd_vectors_over_many_blocks(spark, block_bytes):
    items = odd_items(spark).cache()
    want = linked((r.a, r.b) for r in clusters._joined_pairs(items, 0.7, ("g",)).collect())
    links = clusters.similar_links(items, 0.7, ("g",), block_bytes)
    assert want and linked((r.a, r.b) for r in links.collect()) == want
    named = {r.id: r.cluster for r in clusters.components(items, links).collect()}
    assert named == {r.id: want.get(r.id, r.id) for r in items.collect()}


def test_links_of_copies_are_fewer_than_rows(spark):
    items = spark.range(3000).select("id", F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"))
    links = clusters.similar_links(items, 0.9)
    assert links.count() < 3000 and {(r.cluster, r.size) for r in clusters.cluster(items, 0.9).collect()} == {(0, 3000)}


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    rounds, real = [], clusters.checkpointed
    monkeypatch.setattr(clusters, "checkpointed", lambda df: rounds.append(1) or real(df))
    order = np.random.default_rng(3).permutation(2000).tolist()
    pairs = spark.createDataFrame([(min(p), max(p)) for p in zip(order[:-1], order[1:], strict=True)], "a long, b long")
    assert {r.cluster for r in clusters.components(spark.range(2000), pairs).collect()} == {0}
    assert len(rounds) <= 2 + 11  # about the logarithm of its length


def test_clusters_of_many_vectors_in_time(spark):
    rows = np.random.default_rng(1).standard_normal((12000, 64))
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).tolist()
    items = clusters.checkpointed(spark.createDataFrame(list(enumerate(rows)), "id long, embedding array<float>"))
    began = time.monotonic()
    assert clusters.cluster(items, 0.99).count() == 12000
    assert time.monotonic() - began < 90  # 72 million comparisons


@pytest.mark.parametrize("block_bytes", [1, clusters.BLOCK_BYTES])
def test_pairs_of_odd_vectors_over_many_blocks(spark, block_bytes):
    items = odd_items(spark).cache()
    rows = lambda df: sorted((r.a, r.b, str(r.similarity)) for r in df.collect())
    for within in (("g",), ()):
        assert rows(clusters.similar_pairs(items, 0.7, within, block_bytes)) == rows(clusters._joined_pairs(items, 0.7, within))


def test_pairs_of_many_vectors_in_time(spark):
    rows = np.random.default_rng(2).standard_normal((12000, 64))
    rows[11999] = rows[0] + 0.01 * rows[1]
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).tolist()
    items = clusters.checkpointed(spark.createDataFrame(list(enumerate(rows)), "id long, embedding array<float>"))
    began = time.monotonic()
    assert [(r.a, r.b) for r in clusters.similar_pairs(items, 0.99).collect()] == [(0, 11999)]
    assert time.monotonic() - began < 90  # 72 million comparisons


def test_issues(spark):
    raws = ["2026-03-04 08:00:00 ERROR Redis timeout for user 12345"] * 3 + ["2026-03-04 08:00:01 ERROR Redis timeout for user 99999 now", "2026-03-04 08:00:02 FATAL deadlock"]
    groups = logs.error_groups(logs.parse_lines(source.lines(files(spark, "\n".join(raws)))))
    plain = issues.issues(groups).orderBy("severity_rank", F.desc("occurrences")).collect()
    assert [(r.title, r.severity, r.occurrences, r.confidence) for r in plain] == [("Deadlock Detected", "Critical", 1, 1.0), ("Redis Timeout [Redis, User]", "High", 3, 1.0), ("Redis Timeout [Redis, User]", "High", 1, 1.0)]
    joined = issues.issues(groups, issues.hashed_embedder()).where("category = 'Timeout'").collect()
    assert [(r.occurrences, r.fingerprints, 0.72 <= r.confidence <= 1) for r in joined] == [(4, 2, True)]
    assert issues.issues(groups, issues.hashed_embedder(), compat_confidence_zero=True).where("fingerprints = 2").first().confidence == 0.0
    assert report.funnel(groups, issues.issues(groups)).first().issues == 3


def test_normalised_time_needs_a_date(spark):
    assert spark.range(1).select(parsing.event_time(F.lit("10:00:00"))).first()[0] is None
    assert str(spark.range(1).select(parsing.event_time(F.lit("04/Mar/2026:08:15:00 +0000"))).first()[0]) == "2026-03-04 08:15:00"


def test_issue_ranking_and_representative(spark):
    raws = ["2026-03-04 08:00:00 ERROR Redis timeout for user 12345"] * 2 + ["2026-03-04 08:00:02 FATAL deadlock", "2026-03-04 08:00:03 ERROR zzz broke", "2026-03-04 08:00:03 ERROR zzz broke"]
    groups = logs.error_groups(logs.parse_lines(source.lines(files(spark, "\n".join(raws)))))
    rows = issues.ranked(issues.issues(groups)).orderBy("position").collect()
    assert [(r.position, r.severity, r.representative.message, r.representative.first_line) for r in rows] == [
        (1, "Critical", "deadlock", 3), (2, "High", "Redis timeout for user 12345", 1), (3, "High", "zzz broke", 4),
    ]
    assert not rows[0].embedding_available and issues.issues(groups, issues.hashed_embedder()).first().embedding_available
    detail = {r.fingerprint: r.services for r in report.issue_detail(issues.issues(groups)).collect()}
    assert detail["deadlock"] == "No service named" and detail["redis timeout for user <n>"] == "Redis, User"


def test_embedders(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            calls.add(len(texts))
            return [[3.0 * len(t), 4.0 * len(t)] for t in texts]

        return model

    cached = issues.CachedEmbedder(issues.model_embedder(load), str(tmp_path))
    texts = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    assert sorted((r.text, r.embedding) for r in cached(texts).collect()) == [("a", [0.6, 0.8]), ("bb", [0.6, 0.8])]
    assert cached(spark.createDataFrame([("bb",), ("c",)], "text string")).count() == 2 and calls.value == 3
    cached.clear()
    assert cached.parts == []
    assert issues.embedder_or_none(lambda: 1 / 0) is None


def test_mean_similarity_and_order(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.6, 0.8]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "cluster int, embedding array<double>")
    assert [(r.cluster, round(r["mean"], 6)) for r in clusters.mean_similarity(items).collect()] == [(1, round((0.6 + 0.0 + 0.8) / 3, 6))]
    named = spark.createDataFrame([(5, 5), (1, 1), (7, 5), (2, 2), (9, 2)], "id int, cluster int")
    assert [(r.position, r.cluster, r.members) for r in clusters.ordered(named).orderBy("position").collect()] == [(1, 2, [2, 9]), (2, 5, [5, 7]), (3, 1, [1])]


def test_positions_over_many_partitions(spark):
    clustered = [(k, k % 700 if k < 2000 else k) for k in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = clusters.positions(spark.createDataFrame(clustered, "id long, cluster long"))
        assert found.rdd.getNumPartitions() > 1
        got = sorted((r.position, r.cluster, r.size) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = {}
    for _, c in clustered:
        sizes[c] = sizes.get(c, 0) + 1
    assert got == [(k + 1, c, n) for k, (c, n) in enumerate(sorted(sizes.items(), key=lambda x: (-x[1], x[0])))]


def test_json_bodies_and_sample(spark):
    bodies = spark.createDataFrame([(1, '{"text": "x\\ny"}'), (2, "{no"), (3, '{"text": 7}'), (4, None)], "source_id int, body string")
    assert {r.source_id: r.content for r in source.json_bodies(bodies).collect()} == {1: "x\ny", 2: "", 3: "", 4: ""}
    total = logs.summary(source.lines(source.sample(spark))).first()
    assert (total.total_lines, total.error_count, total.unique_error_count) == (7, 4, 3)


def test_streamed_buckets(spark, tmp_path):
    from quarrylog.streaming.buckets import streaming_buckets

    rows = [("s", k, f"2026-03-04 0{8 + k // 3}:10:0{k % 3} {'ERROR' if k % 2 else 'INFO'} x") for k in range(6)]
    spark.createDataFrame(rows, "source_id string, line_number long, raw string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id string, line_number long, raw string").parquet(str(tmp_path / "in"))
    run = streaming_buckets(stream).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((str(r.start), r.error_count, r.total_count) for r in spark.table("streamed").collect()) == [("2026-03-04 08:00:00", 1, 3), ("2026-03-04 09:00:00", 2, 3)]
