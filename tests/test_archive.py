"""From files to an index and back: scans, answers, sidecars, logs, streams."""

import json

import pytest
from pyspark.sql import functions as F

from sidelight.functions.images import data_url, largest_preview, thumbnail_key
from sidelight.operators import index, logs
from sidelight.schemas import FIX_LOG_DDL, RECORD_DDL, RUN_LOG_DDL, RUN_STATUSES
from sidelight.sources import describer, files, settings, writers
from sidelight.streaming import index_stream


@pytest.fixture
def archive(tmp_path):
    root = tmp_path / "photos"
    for name in ["a.jpg", "b.JPEG", "c.txt", "d.xmp", "2017 May/e.orf", "2017 May/f.heic", "2017 May b/g.png"]:
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"bytes of " + name.encode())
    return files.Collection("photos", str(root))


def names(df, root):
    return [r.path[len(root) + 1 :] for r in df.collect()]


def test_scan_finds_images_in_path_order(spark, archive):
    got = files.in_order(files.images(spark, archive).select("path"))
    assert names(got, archive.root) == ["2017 May/e.orf", "2017 May/f.heic", "2017 May b/g.png", "a.jpg", "b.JPEG"]
    some = files.Collection("photos", archive.root, ("2017 May", "missing"))
    assert sorted(names(files.images(spark, some), archive.root)) == ["2017 May/e.orf", "2017 May/f.heic"]
    assert files.images(spark, files.Collection("x", archive.root + "/none")).collect() == []
    assert [c.name for c in files.configured(spark, [files.Collection("x", archive.root + "/none"), archive])] == ["photos"]


def answers(path, *_):
    name = path.rsplit("/", 1)[-1]
    if name == "b.JPEG":
        return {"error": "HTTP 413: too large"}
    if name == "f.heic":
        return {"text": None}
    if name == "g.png":
        return {"text": "no keywords here"}
    return {"text": f"A picture & {name}.\n\none, two", "cost": 0.25}


def test_tag_index_and_append(spark, archive, tmp_path):
    (tmp_path / "photos/a.xmp").write_text('<rdf:RDF xmlns:rdf="r"><rdf:Description rdf:about=""/></rdf:RDF>')

    def cards():
        return files.with_sidecars(spark, archive)

    todo = index.pending(cards())
    assert names(todo, archive.root) == ["2017 May/e.orf", "2017 May/f.heic", "2017 May b/g.png", "a.jpg", "b.JPEG"]
    pixels = files.images(spark, archive).select("path", F.col("content").alias("image"))
    asked = writers.asked(todo.join(pixels, "path"), archive.root, "photos")
    first = asked.where("path like '%e.orf'").first()
    assert first.context == "2017 May" and '"2017 May"' in first.prompt
    said = describer.describe(asked, answers, str(tmp_path / "answers"), tasks=2)
    again = describer.describe(asked, lambda *_: 1 / 0, str(tmp_path / "answers"), tasks=2)  # nothing is asked twice
    assert said.count() == again.count() == 5

    texts = cards().select("path", "sidecar", F.col("content").cast("string").alias("content"))
    plan = writers.planned(said.select("path", "context", "answer"), texts, "some/model")
    plan.write.parquet(str(tmp_path / "plan"))
    plan = spark.read.parquet(str(tmp_path / "plan"))
    by = {r.path.rsplit("/", 1)[-1]: r for r in plan.collect()}
    assert {k: v.status for k, v in by.items()} == {"a.jpg": "merged", "e.orf": "created", "b.JPEG": "error", "f.heic": "error", "g.png": "error"}
    assert by["b.JPEG"].error == "HTTP 413: too large" and by["a.jpg"].cost == 0.25 and by["a.jpg"].backup.startswith("a__")
    writers.write_sidecars(plan, str(tmp_path / "backup"))
    writers.append_log(plan, str(tmp_path / "log"))
    assert [p.name for p in (tmp_path / "backup").iterdir()] == [by["a.jpg"].backup]
    log = files.read_log(spark, str(tmp_path / "log"), RUN_LOG_DDL)
    stats = {r.status: (r.n, r.cost) for r in logs.run_stats(log, RUN_STATUSES).collect()}
    assert stats == {"created": (1, 0.25), "merged": (1, 0.25), "error": (3, 0.0), "skipped_done": (0, 0.0), "skipped_has_subject": (0, 0.0)}
    assert names(index.pending(cards(), 2), archive.root) == ["2017 May/f.heic", "2017 May b/g.png"]

    found = index.records(cards(), archive.root, "photos")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in found.collect()}
    assert set(rows) == {"a.jpg", "e.orf"} and rows["e.orf"].description == "A picture & e.orf." and rows["e.orf"].keywords == ["one", "two"]
    assert tuple(rows["e.orf"].date) == (2017, 5, None, "folder")
    out, odd = str(tmp_path / "index"), str(tmp_path / "odd")
    for _ in range(2):
        index.append_index(found, out, odd, index.HashingEmbedder(16))
    long = found.limit(1).withColumns({"path": F.lit("/new.jpg"), "description": F.repeat(F.lit("x"), 1501)})
    index.append_index(long, out, odd, index.HashingEmbedder(16))
    held = spark.read.parquet(out)
    assert held.count() == 2 and held.select("seq").distinct().count() == 2 and len(held.first().vector) == 16
    assert [(r.path, r.description_len) for r in spark.read.json(odd).collect()] == [("/new.jpg", 1501)]

    # repair: a glitched answer is not written, a good one is, without a backup
    texts = files.with_sidecars(spark, archive, "inner").select("path", "sidecar", F.col("content").cast("string").alias("content"))
    fixed = spark.createDataFrame([(f"{archive.root}/a.jpg", "New.\n\nx, y"), (f"{archive.root}/2017 May/e.orf", "猫.\n\nx, y")], "path string, text string")
    fixed = fixed.select("path", F.struct("text", F.lit(0.5).alias("cost"), F.lit(None).cast("string").alias("error")).alias("answer"))
    repaired = {r.path.rsplit("/", 1)[-1]: r for r in writers.repairs(fixed, texts).collect()}
    assert repaired["a.jpg"].status == "fixed" and "New." in repaired["a.jpg"].content and repaired["a.jpg"].backup is None
    assert repaired["e.orf"].status == "still_glitched" and repaired["e.orf"].content is None


def test_hidden_files_on_demand(spark, tmp_path):
    for name in ("a.jpg", ".b.jpg", "_edited/c #1.jpg", "d/.e/f.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "_edited/c #1.xmp").write_bytes(b"card")
    seen = lambda hidden: {r.path.removeprefix(f"{tmp_path}/"): bytes(r.content) for r in files.images(spark, files.Collection("x", str(tmp_path), hidden=hidden)).collect()}
    assert list(seen(False)) == ["a.jpg"]
    assert seen(True) == {n: n.encode() for n in ("a.jpg", ".b.jpg", "_edited/c #1.jpg", "d/.e/f.jpg")}
    cards = files.with_sidecars(spark, files.Collection("x", str(tmp_path), hidden=True), "inner").collect()
    assert [(r.path.endswith("c #1.jpg"), bytes(r.content)) for r in cards] == [(True, b"card")]


def test_the_model_sees_each_new_record_once(spark, tmp_path):
    class Counting(index.HashingEmbedder):
        def load(self):
            run, log = super().load(), str(tmp_path / "calls")

            def told(texts):
                with open(log, "a") as f:
                    f.write("".join(f"{t}\n" for t in texts))
                return run(texts)

            return told

    rows = [(f"/p/{i % 7}/{i}.jpg", f"told {i}", ["k"], ["Anna"], ("Austria", "", "", ""), None, "photos", None) for i in range(300)]
    found = spark.createDataFrame(rows, RECORD_DDL)
    for _ in range(2):
        index.append_index(found, str(tmp_path / "ix"), str(tmp_path / "odd"), Counting(8))
    calls = (tmp_path / "calls").read_text().splitlines()
    assert len(calls) == len(set(calls)) == 300
    kept = spark.read.parquet(str(tmp_path / "ix"))
    assert kept.count() == 300 and kept.select("people_keys", "place_keys").distinct().collect() == [([["anna"]], ["aust"])]


def test_images_of_one_stem_share_a_sidecar(spark, tmp_path):
    said = spark.createDataFrame([("/x/a.jpg", "c", ("T.\n\na, b", 1.0, None)), ("/x/a.png", "c", ("T.\n\na, b", 1.0, None))], "path string, context string, answer struct<text:string,cost:double,error:string>")
    none = spark.createDataFrame([], "path string, sidecar string, content string")
    assert {r.path: r.status for r in writers.planned(said, none, "m").collect()} == {"/x/a.jpg": "created", "/x/a.png": "skipped_has_subject"}


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_logs(spark, tmp_path):
    run = lines(tmp_path / "run.jsonl", *({"path": p, "status": s} for p, s in [("a", "error"), ("b", "created"), ("a", "error"), ("c", "error"), ("d", "skipped_has_subject")]), "", '{"path": "x", "sta')
    log = files.read_log(spark, run, RUN_LOG_DDL)
    assert [r.path for r in logs.failed_paths(log).collect()] == ["a", "c"]
    assert [r.path for r in logs.to_retry(log, spark.createDataFrame([("a",)], "path string")).collect()] == ["c"]
    ix = lines(tmp_path / "ix.jsonl", {"path": "a", "description": "clean"}, {"path": "b", "description": "猫"}, {"path": "c", "description": "x", "keywords": ["犬"]}, {"description": "no path"}, {"path": "b", "description": "猫"}, '{"pa')
    table = files.read_index(spark, ix)
    assert [r.path for r in logs.glitched_paths(table).collect()] == ["b", "c", "b"]
    fix = lines(tmp_path / "fix.jsonl", {"path": "c", "status": "error"}, "junk", {"status": "fixed"})
    tried = files.read_log(spark, fix, FIX_LOG_DDL)
    assert [r.path for r in logs.attempted_paths(tried).collect()] == ["c"]
    assert [r.path for r in logs.to_repair(table, tried).collect()] == ["b", "b"]
    assert files.read_log(spark, str(tmp_path / "none"), RUN_LOG_DDL).collect() == []
    assert [r.seq for r in files.lined_up(table).orderBy("seq").collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("n, limit", [(10, 3), (10, 10), (10, 20), (10, None), (7, 5), (1000, 48)])
def test_even_sample(spark, n, limit):
    rows = spark.range(n).repartition(4)
    want = list(range(n)) if limit is None or limit >= n else [int(i * (n / limit)) for i in range(limit)]
    assert [r.id for r in logs.even_sample(rows, ["id"], limit).collect()] == want


def test_even_sample_of_nothing(spark):
    with pytest.raises(ValueError):
        logs.even_sample(spark.range(3), ["id"], 0)


@pytest.mark.parametrize("replies, calls, error", [
    ([{"error": "HTTP 429: x"}, {"text": "t"}], 2, None), ([{"error": "HTTP 413: x"}], 1, "HTTP 413: x"), ([{"error": "HTTP 429: x"}] * 3, 3, "HTTP 429: x"),
    ([{"error": "data_inspection_failed"}] * 3, 3, "data_inspection_failed"), ([{"error": "request failed: x"}], 1, "request failed: x"), ([{"text": None}], 1, None),
])
def test_retries(replies, calls, error):
    waits, left = [], list(replies)
    got = describer.with_retries(lambda *_: left.pop(0), sleep=waits.append)("p", "q", b"")
    assert len(replies) - len(left) == calls and got.get("error") == error
    assert waits == [3 * (k + 1) for k in range(calls if error and describer.is_transient(error) else calls - 1)]


@pytest.mark.parametrize("status, body, want", [
    (200, '{"choices": [{"message": {"content": "t"}}], "usage": {"cost": 0.1}}', {"text": "t", "cost": 0.1}), (200, '{"choices": [{"message": {"content": null}}], "usage": null}', {"text": None, "cost": None}),
    (500, "x" * 600, {"error": "HTTP 500: " + "x" * 500}), (200, "<html>", {"error": "a reply that is no JSON: <html>"}), (200, '{"choices": []}', {"error": 'a reply without an answer: {"choices": []}'}),
])
def test_answers(status, body, want):
    assert describer.answer_of(status, body) == want


def test_previews_and_data_urls(spark):
    jpeg = lambda n: b"\xff\xd8\xff" + b"x" * n + b"\xff\xd9"
    assert largest_preview(b"raw" + jpeg(3) + b"-" + jpeg(30) + jpeg(30)[:-2]) == jpeg(30)
    assert largest_preview(b"none") is None and largest_preview(b"\xff\xd8\xff never ends") is None
    assert data_url("/a/b.JPG", b"hi") == "data:image/jpeg;base64,aGk=" and data_url("/a/b.png", b"hi") == "data:image/png;base64,aGk="
    assert data_url("/a/b.orf", b"raw" + jpeg(3)).startswith("data:image/jpeg;base64,/9j/")
    keys = spark.createDataFrame([("p", 1, 10), ("p", 1, 64), ("p", 2, 64), ("p", 1, 5000)], "p string, m long, s int").select(thumbnail_key(F.col("p"), F.col("m"), F.col("s")).alias("k"))
    k = [r.k for r in keys.collect()]
    assert k[0] == k[1] and len({k[1], k[2], k[3]}) == 3


def test_settings(tmp_path):
    (tmp_path / "env").write_text('# c\nPHOTO_ROOT=/p # photos\nTAG_LANGUAGE="Ger # man"\nMEDIA_ROOT=\'/m\'\nMEDIA_SUBDIRS=a, b,\nOPENROUTER_MODEL=x\t# y\nbroken\n')
    s = settings.Settings.load({"PHOTO_ROOT": "/env", "OPENROUTER_MODEL": ""}, str(tmp_path / "env"))
    assert (s.photo_root, s.language, s.media_subdirs, s.model, s.workers) == ("/env", "Ger # man", ("a", "b"), "x", 8)
    assert [c.name for c in s.collections()] == ["photos", "media"] and s.collections()[1].bases == ["/m/a", "/m/b"]
    with pytest.raises(ValueError):
        s.require_api_key()


def test_streams_append_each_path_once(spark, tmp_path):
    ddl = "path string, description string"

    def deliver(k, *rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        index_stream.append_new(index_stream.arriving(spark, str(tmp_path / "in"), ddl), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect())

    deliver(1, ("a", "x"), ("b", "x"))
    assert run() == ["a", "b"]
    deliver(2, ("b", "y"), ("c", "z"))
    assert run() == ["a", "b", "c"] and run() == ["a", "b", "c"]


def test_stream_puts_anomalies_aside(spark, tmp_path):
    ddl = "path string, description string"
    spark.createDataFrame([("a", "x"), ("b", "y" * 1501), ("a", "x")], ddl).write.parquet(str(tmp_path / "in"))
    rows = index_stream.arriving(spark, str(tmp_path / "in"), ddl)
    index_stream.append_described(rows, str(tmp_path / "out"), str(tmp_path / "odd"), str(tmp_path / "state")).awaitTermination()
    assert [r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
    assert [(r.path, r.description_len) for r in spark.read.json(str(tmp_path / "odd")).collect()] == [("b", 1501)]


def test_stream_counts(spark, tmp_path):
    ddl = "status string, cost double"
    spark.createDataFrame([("created", 1.0), ("created", None), ("error", 2.0)], ddl).write.parquet(str(tmp_path / "in"))
    index_stream.status_counts(index_stream.arriving(spark, str(tmp_path / "in"), ddl), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {(r.status, r.n, r.cost) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("created", 2, 1.0), ("error", 1, 2.0)}


def test_probe_asks_an_even_sample(spark, tmp_path):
    rows = [(f"/r/{k}.jpg", "c", "p", b"x") for k in range(10)]
    asked = spark.createDataFrame(rows, "path string, context string, prompt string, content binary")
    said, total = describer.probe(asked, lambda path, *_: {"text": path, "cost": 0.5} if "4" not in path else {"error": "e"}, str(tmp_path / "probe"), 5)
    assert sorted(r.path for r in said.collect()) == [f"/r/{k}.jpg" for k in (0, 2, 4, 6, 8)] and total == 2.0


def test_an_interrupt_cancels_what_is_queued(spark):
    from sidelight.session import cancellable

    with pytest.raises(KeyboardInterrupt), cancellable(spark, "test"):
        assert spark.range(3).count() == 3
        raise KeyboardInterrupt
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None and spark.range(3).count() == 3


def test_snapshot_follows_its_files(spark, tmp_path):
    import time

    spark.range(3).write.parquet(str(tmp_path / "t"))
    kept = files.Snapshot(spark, str(tmp_path / "t"), lambda s, p: s.read.parquet(p))
    first = kept.get()
    assert first.count() == 3 and kept.get() is first
    time.sleep(1.1)
    spark.range(2).write.mode("append").parquet(str(tmp_path / "t"))
    assert kept.get().count() == 5 and kept.get() is not first


def test_embedders(tmp_path):
    e = index.HashingEmbedder(8)
    assert e.embed([]) == [] and e.width() == 8
    many = e.embed([f"text {k}" for k in range(20)])
    assert len(many) == 20 and many[3] == e.embed(["text 3"])[0] and all(len(v) == 8 for v in many)
    with pytest.raises(FileNotFoundError):
        index.OnnxEmbedder(str(tmp_path)).width()
