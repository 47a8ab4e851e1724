import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge import cli, staging
from folioforge.functions import paths
from folioforge.operators import labels
from folioforge.plans import trees
from folioforge.schemas import INVENTORY, LABELS
from folioforge.sources import archives, files, tables
from folioforge.streaming import ingest


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / "VOL00001" / "sub dir").mkdir(parents=True)
    (root / "VOL00001" / "keep.txt").write_text("hello")
    (root / "VOL00001" / "sub dir" / "b+1.PDF").write_text("x" * 30)
    (root / "ignore.tmp").write_text("no")
    with zipfile.ZipFile(root / "a.zip", "w") as z:
        z.writestr("inner/doc.pdf", "pdf")
        z.writestr("/lead.txt", "t")
    (root / "bad.zip").write_text("no archive")
    return root


def test_scan(spark, tree):
    rows = {r.rel_path: r for r in files.scan_files(spark, str(tree), ignore=("*.tmp",), algorithm="sha256", sample_bytes=2).collect()}
    assert set(rows) == {"VOL00001/keep.txt", "VOL00001/sub dir/b+1.PDF", "a.zip", "bad.zip"}
    keep = rows["VOL00001/keep.txt"]
    assert (keep.size_bytes, keep.top_level_folder, keep.extension, keep.detected_mime, len(keep.hash_value), len(keep.file_id)) == (5, "VOL00001", "txt", "text/plain", 64, 64)
    assert rows["VOL00001/sub dir/b+1.PDF"].extension == "pdf"
    assert files.scan_files(spark, str(tree), max_files=2).count() == 2
    with pytest.raises(ValueError):
        files.scan_files(spark, str(tree), max_files=0)


def test_archive_members(spark, tree):
    found = files.archive_members(spark, str(tree))
    assert {r.member for r in found.filter("error is null").collect()} == {"inner/doc.pdf", "lead.txt"}
    assert [(r.archive, r.error.split(":")[0]) for r in found.filter("error is not null").collect()] == [("bad.zip", "zip read error")]
    assert {(r.rel_path, r.top_level_folder) for r in files.member_rows(found).collect()} == {("a.zip::inner/doc.pdf", "a.zip"), ("a.zip::lead.txt", "a.zip")}


def test_odd_names_empty_files_and_links(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("100% a%20b+c é.txt", "d/empty.pdf"):
        (tmp_path / name).write_text("" if "empty" in name else "x")
    (tmp_path / "link").symlink_to(tmp_path / "d")
    found = {r.rel_path: r.size_bytes for r in files.scan_files(spark, str(tmp_path), algorithm="md5").collect()}
    assert found == {"100% a%20b+c é.txt": 1, "d/empty.pdf": 0}
    rows, errors = files.scan_inventory(spark, str(tmp_path), max_files=1)
    assert [r.rel_path for r in rows.collect()] == ["100% a%20b+c é.txt"] and errors.count() == 0
    with pytest.raises(ValueError):
        files.scan_inventory(spark, str(tmp_path), max_files=0)


def test_hidden_names_links_and_failures(spark, tmp_path):
    (tmp_path / "in/_sub/.deep").mkdir(parents=True)
    (tmp_path / "in/~$skip/deep").mkdir(parents=True)
    for name in ("_notes.pdf", ".env", "ok.pdf", "_sub/in.pdf", "_sub/.deep/x", "~$skip/deep/no.pdf", "Thumbs.db"):
        (tmp_path / "in" / name).write_text("x")
    root = tmp_path / "in"
    (root / "lost").symlink_to("nowhere")
    (root / "again").symlink_to(root / "_sub")
    (root / "_sub/up").symlink_to(root)
    (root / "file link").symlink_to(root / "ok.pdf")
    plain = {"_notes.pdf", ".env", "ok.pdf", "_sub/in.pdf", "_sub/.deep/x", "file link"}
    rows, errors = files.scan_inventory(spark, str(root), algorithm="md5")
    assert {r.rel_path for r in rows.collect()} == plain
    assert [(r.path, r.error.split(":")[0]) for r in errors.collect()] == [("lost", "FileNotFoundError")]
    rows, errors = files.scan_inventory(spark, f"file://{root}", follow_symlinks=True)
    assert {r.rel_path for r in rows.collect()} == plain | {"again/in.pdf", "again/.deep/x"}
    assert {r.path: r.error for r in errors.collect()}["_sub/up"] == "link to a folder it stands in"
    assert [(r.rel_path, r.kind) for r in files.walk(spark, str(tmp_path / "none")).collect()] == [("", "error")]
    assert files.walk(spark, str(root), ignore=("_sub/*.pdf", ".*")).filter("kind = 'file'").count() == 5


def test_patterns_agree_in_both_forms(spark):
    names = ["a/b.tmp", "b.tmp", "x/a/b.tmp", "a/c/b.tmp", "A/b.tmp", "a/~$x", "a/b.tmpx", "Thumbs.db"]
    for patterns in (("*.tmp",), ("a/*.tmp",), ("~$*", "Thumbs.db"), ("x/*",), ("a/?.tmp",), ("[ab]/*",)):
        kept = spark.createDataFrame([(n,) for n in names], "n string").filter(paths.ignored(F.col("n"), patterns)).collect()
        assert {r.n for r in kept} == {n for n in names if files.is_ignored(n, patterns)}, patterns


def test_digests_need_no_memory(spark, tmp_path):
    """A file beyond what a row can hold; its blocks are never written."""
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((2 << 30) + 5)
    (row,) = files.scan_files(spark, str(tmp_path), algorithm="md5", sample_bytes=10).collect()
    assert (row.size_bytes, row.sample_hash) == ((2 << 30) + 5, hashlib.md5(bytes(10)).hexdigest())
    whole = hashlib.md5()
    for _ in range(2048):
        whole.update(bytes(1 << 20))
    whole.update(bytes(5))
    assert row.hash_value == whole.hexdigest()


def test_unreadable_content_is_an_error(spark, tmp_path):
    found = files.file_digests(spark.createDataFrame([("gone",)], "rel_path string"), str(tmp_path)).collect()
    assert [(r.rel_path, r.hash_value, r.error) for r in found] == [("gone", None, "FileNotFoundError: No such file or directory")]


@pytest.fixture
def packed(tmp_path):
    rng = random.Random(2)
    made = {}
    for k in range(6):
        for m in range(8):
            made[f"d{k % 2}/a{k}.zip", f"m{m}.txt"] = "".join(rng.choice("ab ") for _ in range(rng.randrange(3000)))
    for name in {a for a, _ in made}:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        content = trees.archive([(m, t.encode()) for (a, m), t in made.items() if a == name], packed=name != "d0/a0.zip")
        (tmp_path / name).write_bytes(b"a program before the archive" + content if name == "d1/a1.zip" else content)
    (tmp_path / "bad.zip").write_bytes(b"none")
    return str(tmp_path), made


def test_archives_as_a_source(spark, packed):
    root, made = packed
    rows = archives.read_archives(spark, root, partition_bytes=6000)
    found = rows.filter("error is null").collect()
    assert {(r.archive, r.member): bytes(r.content).decode() for r in found} == made and len(found) == len(made)
    assert [(r.archive, r.error.split(":")[0]) for r in rows.filter("error is not null").collect()] == [("bad.zip", "zip read error")]
    assert rows.rdd.getNumPartitions() > 6
    bare = archives.read_archives(spark, root, content=False)
    assert {r.content for r in bare.collect()} == {None} and bare.filter("size_bytes > 100").count() > 0


def test_archive_filters_are_pushed_down(spark, packed):
    root, made = packed
    rows = archives.read_archives(spark, root).filter("archive = 'd1/a3.zip' and member like 'm%' and member in ('m1.txt', 'm2.txt', 'zz')")
    assert {(r.archive, r.member) for r in rows.collect()} == {("d1/a3.zip", "m1.txt"), ("d1/a3.zip", "m2.txt")}
    reader = archives.ArchiveReader(root, True, 1 << 20)
    left = list(reader.pushFilters([archives.EqualTo(("archive",), "d1/a3.zip"), archives.In(("member",), ("m1.txt",)), archives.EqualTo(("size_bytes",), 3)]))
    assert [f.attribute for f in left] == [("size_bytes",)]
    assert [row[:2] for part in reader.partitions() for row in part.rows] == [("d1/a3.zip", "m1.txt")]


def test_members_are_read_from_their_place(spark, packed):
    root, made = packed
    asked = [f"{a}::{m}" for a, m in made] + ["d0/a0.zip::none", "bad.zip::x", "gone.zip::x"]
    read = files.read_contents(spark.createDataFrame([(n,) for n in asked], "rel_path string"), root).collect()
    assert {r.path: bytes(r.content).decode() for r in read if r.error is None} == {f"{a}::{m}": t for (a, m), t in made.items()}
    assert {r.path: r.error.split(":")[0] for r in read if r.error} == {"d0/a0.zip::none": "KeyError", "bad.zip::x": "zip read error", "gone.zip::x": "zip read error"}
    found = files.archive_members(spark, root).filter("member = 'm1.txt' and archive = 'd0/a2.zip'").first()
    with pytest.raises(ValueError), open(f"{root}/d0/a2.zip", "rb") as f:
        files.read_member(f, found.place, found.packed, found["method"], found.size_bytes, found.crc + 1)


def test_odd_dates_cost_the_date_only(spark, tmp_path):
    (tmp_path / "odd.zip").write_bytes(trees.archive([("good.txt", b"1"), ("late.txt", b"22")], bad_date="late.txt"))
    rows = files.scan_inventory(spark, str(tmp_path))[0].filter("rel_path like '%::%'").collect()
    assert {r.rel_path: (r.size_bytes, r.modified_time) for r in rows} == {"odd.zip::good.txt": (1, "2024-05-06T07:08:10+00:00"), "odd.zip::late.txt": (2, None)}


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), {"spark.sql.warehouse.dir": "file:/here/spark-warehouse"}  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.working_folder(Session())


def test_cli_checks_and_writes(spark, tree, tmp_path, capsys):
    with pytest.raises(SystemExit):
        cli.main(["inventory", "run", "--root", str(tmp_path / "none"), "--out", str(tmp_path / "out")])
    with pytest.raises(SystemExit):
        cli.main(["inventory", "run", "--root", str(tree), "--out", str(tmp_path / "out"), "--max-files", "0"])
    out = str(tmp_path / "out")
    cli.main(["inventory", "run", "--root", str(tree), "--out", out, "--label", "t"])
    assert tables.read_run(spark, out, "inventory", INVENTORY).count() == 7
    latest = tables.read_json(spark, f"{out}/inventory/LATEST.json")
    _, summary, log = tables.load_run(spark, out, "inventory", latest["run_id"])
    assert summary["source_root_name"] == "in" and log["errors"] == 1 and [r.path for r in spark.read.parquet(log["errors_path"]).collect()] == ["bad.zip"]
    cli.main(["public-index", "run", "--probe", "NONE", "--out", out, "--dest", str(tmp_path / "catalog")])
    items = {r.rel_path: r.doc_type_final for r in spark.read.json(str(tmp_path / "catalog" / "items")).collect()}
    assert len(items) == 7 and items["a.zip::inner/doc.pdf"] == "PDF (unprobed)" and items["VOL00001/keep.txt"] == "NON_PDF (txt)"
    cli.main(["self-check", "--out", out])
    assert cli.repair_path(str(tree).lstrip("/")) == str(tree)


def test_runs(spark, tmp_path):
    root = str(tmp_path)
    for k, name in enumerate(("a", "b")):
        tables.write_run(spark.range(k + 1).selectExpr("cast(id as string) as rel_path"), root, "probe", name, "/r", f"2024-01-0{k + 1}")
    assert tables.read_run(spark, root, "probe", INVENTORY).count() == 2
    assert tables.read_run(spark, root, "probe", INVENTORY, "a").count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_run(spark, root, "other", INVENTORY)


def test_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "l.csv").write_text('rel_path,label_raw,extra\n"a,b",IMAGE_PDF,1\n')
    assert [(r.rel_path, r.label_raw, r.notes) for r in tables.read_csv(spark, str(tmp_path / "l.csv"), LABELS).collect()] == [("a,b", "IMAGE_PDF", None)]
    (tmp_path / "l.jsonl").write_text('{"rel_path": "a"}\nbroken\n')
    assert [r.rel_path for r in tables.read_jsonl(spark, str(tmp_path / "l.jsonl"), LABELS).collect()] == ["a"]


def test_stream_reads_each_file_once(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("s", "o", "p"))
    for k in (1, 2):
        spark.range(k, k + 1).write.mode("append").parquet(source)
        ingest.run_available(ingest.new_files(spark, source, spark.range(1).schema), out, progress)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_pages_of_text_and_unreadable_files(spark):
    from folioforge.sources import pages

    def picky(content):
        if content == b"bad":
            raise ValueError("no")
        return pages.plain_text(content)

    files_ = spark.createDataFrame([("a", bytearray(b"one\ftwo\fthree")), ("b", bytearray(b"bad"))], "path string, content binary")
    found = pages.extract_pages(files_, picky, max_pages=2)
    assert sorted((r.path, r.page_num, r.text) for r in found.filter("error is null").collect()) == [("a", 1, "one"), ("a", 2, "two")]
    assert [(r.path, r.error) for r in pages.errors(found).collect()] == [("b", "ValueError: no")]


def test_exports_hold_no_text(spark, tmp_path):
    from folioforge.sources import export

    export.write_json(spark.createDataFrame([("a",)], "title string"), str(tmp_path / "j"))
    export.write_csv(spark.createDataFrame([("a",)], "title string"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    with pytest.raises(ValueError):
        export.write_json(spark.createDataFrame([("x" * 301,)], "title string"), str(tmp_path / "k"))


def test_selection_by_path_or_id(spark):
    from folioforge.operators import probe

    rows = spark.createDataFrame([(1, "A/x.pdf"), (2, "B/y.pdf")], "doc_id long, rel_path string")
    assert [r.doc_id for r in probe.select_listed(rows, spark.createDataFrame([("A\\x.pdf",)], "rel_path string")).collect()] == [1]
    assert [r.doc_id for r in probe.select_listed(rows, spark.createDataFrame([(2,)], "doc_id long")).collect()] == [2]
    with pytest.raises(ValueError):
        probe.select_listed(rows, spark.createDataFrame([(2,)], "other long"))


def test_label_and_model_commands(spark, tmp_path):
    out, given = str(tmp_path / "o"), str(tmp_path / "labels")
    inv = [(f"VOL0000{k % 2 + 1}/f{k}.pdf", f"VOL0000{k % 2 + 1}", "pdf", k, "2024") for k in range(12)]
    tables.write_run(spark.createDataFrame(inv, "rel_path string, top_level_folder string, extension string, size_bytes long, modified_time string"), out, "inventory", "i1", "/r", "2024-01-01")
    label = ["pdf-type", "label", "--labels", given, "--out", out]
    cli.main([*label, "--rel-path", "VOL00001\\f0.pdf", "--label", "text_pdf"])
    with pytest.raises(SystemExit):
        cli.main([*label, "--rel-path", "VOL00001/f0.pdf", "--label", "IMAGE_PDF"])
    cli.main([*label, "--rel-path", "VOL00001/f0.pdf", "--label", "IMAGE_PDF", "--overwrite"])
    cli.main([*label, "--rel-path", "VOL00002/f1.pdf", "--label", "TEXT_PDF"])
    assert {(r.rel_path, r.label_norm) for r in spark.read.parquet(given).collect()} == {("VOL00001/f0.pdf", "IMAGE_PDF"), ("VOL00002/f1.pdf", "IMAGE_OF_TEXT_PDF")}
    cli.main(["pdf-type", "train", "--labels", given, "--out", out, "--exclude-mixed"])
    assert spark.read.parquet(tables.resolve_run(spark, out, "pdf-type-training")).count() == 2
    docs = spark.createDataFrame([("VOL00001/f2.pdf", "Scanned")], "rel_path string, classification string")
    tables.write_run(docs, out, "probe", "p1", "/r", "2024-01-01")
    cli.main(["pdf-type", "predict", "--labels", given, "--out", out])
    found = {r.rel_path: (r.predicted_label, r.prediction_source) for r in spark.read.parquet(tables.resolve_run(spark, out, "pdf-type-predictions")).collect()}
    assert len(found) == 10 and found["VOL00001/f2.pdf"] == ("IMAGE_PDF", "probe_classification") and found["VOL00002/f3.pdf"] == ("", "missing_probe_classification")
    cli.main(["pdf-type", "migrate", "--labels", given, "--out", out, "--write"])
    assert spark.read.parquet(given).count() == 2
    features = [(f"VOL0000{k % 2 + 1}/f{k}.pdf", str(k), f"VOL0000{k % 2 + 1}", None if k > 8 else ("IMAGE_PDF", "MIXED_PDF")[k % 2], float(k % 2)) for k in range(12)]
    spark.createDataFrame(features, "rel_path string, doc_id string, top_level_folder string, label string, x double").write.parquet(str(tmp_path / "f"))
    cli.main(["doc-type", "train", "--features", str(tmp_path / "f"), "--out", out])
    (tmp_path / "s.csv").write_text("doc_id\n10\n11\n3\n")
    cli.main(["doc-type", "predict", "--features", str(tmp_path / "f"), "--out", out, "--selection", str(tmp_path / "s.csv")])
    assert {r.rel_path: r.predicted_label for r in spark.read.parquet(tables.resolve_run(spark, out, "doc-type-predictions")).collect()} == {"VOL00001/f10.pdf": "IMAGE_PDF", "VOL00002/f11.pdf": "MIXED_PDF", "VOL00002/f3.pdf": "MIXED_PDF"}
    cli.main(["doc-type", "queue", "--features", str(tmp_path / "f"), "--out", out, "--k", "2"])
    assert spark.read.parquet(tables.resolve_run(spark, out, "label-queue")).count() == 2


@pytest.fixture
def server():
    """Serves a few addresses: HEAD is refused for one, an etag is honoured, one fails."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            if self.path == "/gone.pdf":
                self.send_response(404)
            elif self.path == "/shy.zip" and self.command == "HEAD":
                self.send_response(405)
            elif self.headers.get("If-None-Match") == "v1":
                self.send_response(304)
            else:
                self.send_response(200)
                self.send_header("ETag", "v1")
                self.send_header("Content-Length", "4")
                self.end_headers()
                if body:
                    self.wfile.write(b"data")
                return
            self.send_header("Content-Length", "0")
            self.end_headers()

        def do_HEAD(self):  # noqa: N802
            self.answer(False)

        def do_GET(self):  # noqa: N802
            self.answer(True)

        def log_message(self, *args):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def test_links_are_fetched_once(spark, server, tmp_path):
    html = '<div class="usa-accordion usa-accordion--bordered"><h4><button class="usa-accordion__button">H</button></h4><div class="usa-accordion__content">' + "".join(f'<a href="/{n}">Data Set 3</a>' for n in ("a.pdf", "shy.zip", "gone.pdf", "page.html")) + "</div></div>"
    spark.createDataFrame([(1, f"{server}/index", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    run = ["links", "run", "--pages", str(tmp_path / "p"), "--out", str(tmp_path / "o")]

    def states():
        return {r.url.rpartition("/")[2]: r.status for r in spark.read.parquet(str(tmp_path / "o/links/manifest")).collect()}

    cli.main([*run, "--dry-run"])
    assert states() == {"a.pdf": "dry-run", "shy.zip": "dry-run", "gone.pdf": "dry-run"} and not (tmp_path / "o/links/files").exists()
    spark.createDataFrame([], spark.read.parquet(str(tmp_path / "o/links/manifest")).schema).write.mode("overwrite").parquet(str(tmp_path / "o/links/manifest"))
    cli.main(run)
    assert states() == {"a.pdf": "downloaded", "shy.zip": "downloaded", "gone.pdf": "failed"}
    assert (tmp_path / "o/links/files/H/VOL00003/a.pdf").read_bytes() == b"data"
    cli.main(run)
    assert states()["a.pdf"] == "skipped" == states()["shy.zip"]


def test_recordings_are_indexed_once(spark, tmp_path):
    from folioforge.plans.trees import wav

    (tmp_path / "in").mkdir()
    for name in ("a.wav", "b.wav"):
        (tmp_path / "in" / name).write_bytes(wav(250))
    (tmp_path / "s.jsonl").write_text('{"file_path": "a.wav", "start": 1, "end": 2, "speaker": "S1", "text": "call 555-123-4567 now"}\nbroken\n')
    run = ["media", "run", "--root", str(tmp_path / "in"), "--segments", str(tmp_path / "s.jsonl"), "--out", str(tmp_path / "o")]
    for _ in range(2):
        cli.main(run)
    rows = [(r.file_path, r.status, r.duration_sec, r.phone_count) for r in spark.read.parquet(str(tmp_path / "o/media/index")).collect()]
    assert rows.count(("a.wav", "processed", 0.25, 1)) == 1 and rows.count(("b.wav", "failed", 0.25, None)) == 2


def test_tables_of_any_kind(spark, tmp_path):
    base = str(tmp_path)
    assert tables.load_table(spark, f"{base}/none", LABELS).count() == 0
    (tmp_path / "t.csv").write_text("rel_path,label_raw\na,X\n")
    assert [r.rel_path for r in tables.load_table(spark, f"{base}/t", LABELS).collect()] == ["a"]
    spark.createDataFrame([("p",)], "rel_path string").write.parquet(f"{base}/t.parquet")
    assert [r.rel_path for r in tables.load_table(spark, f"{base}/t", LABELS).collect()] == ["p"]
    assert [r.rel_path for r in tables.read_csv_bytes(spark, b"rel_path,size_bytes\nx,7\n", INVENTORY).collect()] == ["x"] and tables.read_csv_bytes(spark, b"", INVENTORY).count() == 0
    assert tables.read_json(spark, f"{base}/none.json") == {} == tables.read_json(spark, f"{base}/t.csv")
    assert tables.inventory_identity(spark, f"{base}/t.csv").startswith("hash:") and tables.inventory_identity(spark, "/x/inventory/run7/inventory.csv") == "run7"
    tables.write_json(spark, f"{base}/run_log.json", {"inventory_run_id": "r1", "root": "/data/src"})
    assert tables.inventory_identity(spark, f"{base}/t.csv") == "r1" and tables.infer_source_root(spark, f"{base}/t.csv") == ("/data/src", "src")
    assert set(tables.prepare_folders(spark, f"{base}/made")) == {"outputs", "inventory", "probe", "labels", "models", "classification"} and (tmp_path / "made/models/doc_type").is_dir()


def test_labels_of_an_old_file(spark):
    inv = spark.createDataFrame([("7", "A/f.pdf", "A", "abc", 1, "t")], "doc_id string, rel_path string, top_level_folder string, hash_value string, size_bytes long, modified_time string")
    old = spark.createDataFrame([("A\\f.pdf", "text_pdf", ""), ("", "IMAGE_PDF", "7")], "rel_path string, label string, doc_id_at_label_time string")
    found = sorted((r.rel_path, r.label_raw, r.label_norm, r.notes) for r in tables.load_labels(old, inv).collect())
    assert found == [("A/f.pdf", "IMAGE_PDF", "IMAGE_PDF", ""), ("A/f.pdf", "text_pdf", "IMAGE_OF_TEXT_PDF", "")]
    assert [(r.rel_path, r.top_level_folder, r.extension) for r in tables.load_inventory(spark.createDataFrame([("B\\x.PDF", None, ".PDF")], "rel_path string, top_level_folder string, extension string")).collect()] == [("B/x.PDF", "B", "pdf")]


def test_catalog_export(spark, tmp_path):
    from folioforge.sources import export

    export.catalog_json(spark.createDataFrame([("a",)], "title string"), {"probe": "p"}, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c/meta")).first().item_count == 1
    with pytest.raises(ValueError):
        export.catalog_json(spark.createDataFrame([("x" * 301,)], "title string"), {}, str(tmp_path / "d"))
    export.write_manifest(spark.createDataFrame([("b", None), ("a", "x")], "url string, etag string"), str(tmp_path / "m"))
    assert [r.url for r in spark.read.json(str(tmp_path / "m")).collect()] == ["a", "b"]


def test_transcripts_are_written_whole(spark, tmp_path):
    from folioforge.sources import transcripts

    (tmp_path / "s.jsonl").write_text('{"file_path": "a", "start": 2, "end": 3, "text": "two"}\n{"file_path": "a", "start": 1, "end": 2, "speaker": "S1", "text": "one"}\n{"start": 1}\n')
    segments = transcripts.read_segments(spark, str(tmp_path / "s.jsonl"))
    transcripts.write_transcripts(segments, str(tmp_path / "t"))
    rows = spark.read.json(str(tmp_path / "t")).collect()
    assert [(r.file_path, r.transcript, [s.turn for s in r.segments]) for r in rows] == [("a", "one two", [1, 2])]


def test_files_need_their_backend(spark):
    """Without PyMuPDF or pypdf a PDF is a row with its error, like any file that cannot be read."""
    from folioforge.sources import pages

    pdf = spark.createDataFrame([("a.pdf", bytearray(b"no pdf"))], "path string, content binary")
    assert [r.path for r in pages.errors(pages.extract_rasters(pdf, pages.pdf_rasters)).collect()] == ["a.pdf"]
    assert [r.path for r in pages.errors(pages.extract_pages(pdf, pages.pdf_text)).collect()] == ["a.pdf"]


def test_stream_without_repeats_and_known_rows(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1), ("2024-01-01 00:01:00", 1), ("2024-01-01 00:02:00", 2), ("2024-01-01 00:03:00", 3)]
    spark.createDataFrame(rows, "t string, k long").selectExpr("cast(t as timestamp) as ts", "k").write.parquet(str(tmp_path / "s"))
    stream = ingest.deduplicated(ingest.new_files(spark, str(tmp_path / "s"), spark.read.parquet(str(tmp_path / "s")).schema), ["k"])
    stream = ingest.unseen(stream, spark.createDataFrame([(3,)], "k long"), "k")
    ingest.run_available(stream, str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2]


def test_probe_and_name_commands(spark, tmp_path):
    out, pages, good = str(tmp_path / "o"), str(tmp_path / "pages"), "Mr. John Smith wrote to the town about the road near the river and its bridge. " * 6
    rows = [("1", "V1/a.pdf", 1, good), ("1", "V1/a.pdf", 2, good), ("2", "V1/b.pdf", 1, "Mary Jones"), ("3", "V2/c.pdf", 1, good.replace("John Smith", "Anna Brown")), ("4", "V2/d.pdf", 1, "x")]
    spark.createDataFrame(rows, "doc_id string, rel_path string, page_num int, text string").write.parquet(pages)
    inv = [(f"{f}.pdf", f[:2], "pdf", 1, "2024") for f in ("V1/a", "V1/b", "V2/c", "V2/d")] + [("V2/n.txt", "V2", "txt", 1, "2024")]
    tables.write_run(spark.createDataFrame(inv, "rel_path string, top_level_folder string, extension string, size_bytes long, modified_time string"), out, "inventory", "i1", "/r", "2024-01-01")
    spark.createDataFrame([("V1\\a.pdf", "MIXED_PDF"), ("gone.pdf", "IMAGE_PDF")], "rel_path string, label_raw string").write.parquet(str(tmp_path / "labels"))
    with pytest.raises(SystemExit):
        cli.main(["probe", "run", "--pages", pages, "--out", out, "--labels", str(tmp_path / "labels")])
    cli.main(["probe", "run", "--pages", pages, "--out", out, "--inventory", "LATEST", "--labels", str(tmp_path / "labels"), "--text-scan", "--name-index"])
    where = tables.resolve_run(spark, out, "probe")
    found = {r.doc_id: (r.doc_type_final, r.doc_type_source, r.text_quality_label) for r in spark.read.parquet(where).collect()}
    assert found == {"1": ("MIXED_PDF", "TRUTH", "GOOD"), "2": ("IMAGE_PDF", "HEURISTIC", None), "3": ("TEXT_PDF", "HEURISTIC", "GOOD"), "4": ("IMAGE_PDF", "HEURISTIC", None)}
    _, _, log = tables.load_run(spark, out, "probe", where.rpartition("=")[2])
    assert log["label_reconciliation"] == {"labels": 2, "matched": 1, "orphaned": 1, "unmatched": 3} and {"level": "extension", "value": "txt", "files": 1} in log["ignored"]
    index = {r.canonical_key: r.internal_docs for r in spark.read.parquet(tables.resolve_run(spark, out, "name-index")).collect()}
    assert {"smith|john", "brown|anna"} <= set(index) and "jones|mary" not in index
    assert index["smith|john"][0].doc_type_final == "MIXED_PDF" and index["smith|john"][0].page_count == 2 and index["smith|john"][0].total_count == 12
    cli.main(["name-index", "run", "--pages", pages, "--out", out, "--inventory", "LATEST", "--all-documents", "--min-total-count", "7", "--label", "all"])
    again = spark.read.parquet(tables.resolve_run(spark, out, "name-index"))
    assert {r.canonical_key for r in again.collect()} == {"smith|john"}
    cli.main(["name-index", "run", "--pages", pages, "--out", out, "--probe", "NONE", "--max-names-per-doc", "1", "--label", "few"])
    assert "jones|mary" in {r.canonical_key for r in spark.read.parquet(tables.resolve_run(spark, out, "name-index")).collect()}


def test_decision_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a/x.pdf", "Scanned", "old"), (2, "./a/y.pdf", None, "old"), (3, None, "Mixed", "old")], "doc_id long, rel_path string, classification string, doc_type_final string")
    truth = spark.createDataFrame([("a/x.pdf", "text_pdf", "2024"), ("a\\x.pdf", "IMAGE_PDF", None), ("a/y.pdf", "nonsense", "2024"), (None, "MIXED_PDF", "2024")], "rel_path string, label_raw string, labeled_at string")
    guesses = spark.createDataFrame([("a/y.pdf", "MIXED_PDF", 0.9), ("a/y.pdf", "IMAGE_PDF", None), ("a/x.pdf", "IMAGE_PDF", 0.99)], "rel_path string, predicted_label string, confidence double")
    of = lambda *a: {r.doc_id: (r.doc_type_truth, r.doc_type_model_pred, r.doc_type_final, r.doc_type_source) for r in labels.with_decision(docs, *a).collect()}
    found = of(truth, guesses)
    assert found[1] == ("IMAGE_OF_TEXT_PDF", "IMAGE_PDF", "IMAGE_OF_TEXT_PDF", "TRUTH") and found[2] == ("", "MIXED_PDF", "MIXED_PDF", "MODEL")
    assert found[3] == ("", "", "MIXED_PDF", "HEURISTIC") and of()[2] == ("", "", "", "HEURISTIC") and of()[1][2] == "IMAGE_PDF"


def test_pages_are_handed_on_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    from folioforge.sources import pages

    monkeypatch.setattr(pages, "HELD", 100)
    files = pa.RecordBatch.from_pydict({"path": ["a", "b", "c"], "content": [b"\f".join([b"x" * 30] * 20), None, b"y\fz"]}, pa.schema([("path", pa.string()), ("content", pa.binary())]))
    found = list(pages._run(pages.plain_text, None)(iter([files])))
    assert max(sum(len(t or "") for t in batch.column("text").to_pylist()) for batch in found) <= 130
    rows = [r for batch in found for r in batch.to_pylist()]
    assert [(r["path"], r["page_num"]) for r in rows] == [("a", k) for k in range(1, 21)] + [("b", None), ("c", 1), ("c", 2)] and rows[20]["error"].startswith("TypeError")
