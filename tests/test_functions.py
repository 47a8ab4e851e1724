import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.cli import run_id
from folioforge.functions import formats, paths, text
from folioforge.operators import catalogue_views, incremental, inventory, labels, names, raster, readiness, textscan
from folioforge.plans import reference_sql
from folioforge.schemas import INVENTORY, ensure_columns


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "folder"),
    [("VOL00007/file.pdf", "VOL00007"), ("prefix/VOL00012/sub/file.pdf", "VOL00012"), ("VOL00003/archive.zip::doc.pdf", "VOL00003"), ("Sets_12.23.25/file.pdf", "Sets_12.23.25"), ("file.pdf", "file.pdf"), (None, "")],
)
def test_top_level_folder(spark, path, folder):
    assert one(spark, paths.top_level_folder(F.col("p")), p=path) == folder


@pytest.mark.parametrize(("path", "normal"), [("Folder\\Sub\\file.pdf", "Folder/Sub/file.pdf"), (" ./a//b/./c ", "a/b/c"), ("x.zip::in\\a.pdf", "x.zip::in/a.pdf"), ("a/../B", "a/../B"), (None, "")])
def test_normalize_rel_path(spark, path, normal):
    assert one(spark, paths.normalize_rel_path(F.col("p")), p=path) == normal


@pytest.mark.parametrize(("name", "out"), [("a/keep.txt", False), ("a/x.DS_Store", True), ("Thumbs.db", True), ("d/~$draft.doc", True)])
def test_ignored(spark, name, out):
    assert one(spark, paths.ignored(F.col("p")), p=name) is out


def test_file_id(spark):
    def of(mtime, content):
        return one(spark, paths.file_id(F.col("p"), F.col("s"), F.col("m"), F.col("h")), p="a", s=3, m=mtime, h=content)

    assert of(1.0, "") == of(1.0, "") != of(2.0, "")
    assert of(1.0, "abc") == of(2.0, "abc")


@pytest.mark.parametrize(("ext", "mime", "kind"), [("pdf", None, "pdf"), ("txt", "text/plain", "text"), ("csv", "text/csv", "csv"), ("jpg", "image/jpeg", "image"), ("bin", "application/octet-stream", "other")])
def test_file_category(spark, ext, mime, kind):
    assert one(spark, paths.file_category(F.col("e"), F.col("m")), e=ext, m=mime) == kind


@pytest.mark.parametrize(("share", "average", "kind"), [(0.95, 250.0, "Text-based"), (0.95, 100.0, "Mixed"), (0.05, 10.0, "Scanned"), (0.5, 250.0, "Text-based"), (0.3, 250.0, "Mixed")])
def test_classify(spark, share, average, kind):
    assert one(spark, readiness.classify(F.col("s"), F.col("a"), F.lit(3)), s=share, a=average) == kind
    assert one(spark, readiness.classify(F.col("s"), F.col("a"), F.lit(0)), s=share, a=average) == "Unknown"


@pytest.mark.parametrize(("size", "shown"), [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (-2048, "-2.0 KB"), (5 * 1024**5, "5.0 PB"), (None, "unknown")])
def test_human_bytes(spark, size, shown):
    frame = spark.createDataFrame([(size,)], "s long")
    assert frame.select(formats.human_bytes(F.col("s"))).first()[0] == shown


def test_numbers_from_anything(spark):
    frame = spark.createDataFrame([("7",), ("x",), (None,), ("NaN",), (" 2.5 ",)], "v string")
    assert [r[0] for r in frame.select(formats.number(F.col("v"), -1)).collect()] == [7.0, -1.0, -1.0, -1.0, 2.5]


def test_notes_of_documents(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    errors = spark.createDataFrame([(1, "b"), (1, "a")], "doc_id long, error string")
    assert {r.doc_id: r.notes for r in readiness.with_notes(docs, errors).collect()} == {1: "a; b", 2: ""}


@pytest.mark.parametrize(("value", "n"), [("", 0), ("a", 1), ("a\n", 1), ("a\r\nb", 2), ("a\n\nb", 3), ("a\x0bb\x0cc d", 4), ("\n", 1)])
def test_lines(spark, value, n):
    assert one(spark, F.size(text.lines(F.col("t"))), t=value) == n == len(value.splitlines())


def test_snippet_hides_addresses_and_numbers(spark):
    assert one(spark, text.snippet(F.col("t")), t="  mail  a.b@example.com\nnow 123456 or 1234 ") == "mail [email] now [number] or 1234"
    assert one(spark, F.length(text.snippet(F.col("t"))), t="x" * 300) == 201


@pytest.mark.parametrize(("value", "label"), [("", None), ("#### " * 40 + "�" * 10, "LOW"), ("From: a@example.com\nTo: b@example.com\nSubject: meeting\n\n" + "plain words follow here " * 10, "GOOD"), ("too short", "EMPTY")])
def test_quality_label(spark, value, label):
    pages = spark.createDataFrame([(1, "p", 1, value)], "doc_id long, rel_path string, page_num int, text string")
    found = textscan.text_quality(pages).collect()
    assert [r.text_quality_label for r in found] == ([label] if label else [])


@pytest.mark.parametrize("width", [3, 4, 5])
def test_runs_end_with_the_page(spark, width):
    pages = spark.createDataFrame([(1, "p", 1, "a" + "#" * width), (1, "p", 2, "#" * width + "a")], "doc_id long, rel_path string, page_num int, text string")
    assert textscan.text_quality(pages).first().repeated_run_score == round((2 * width if width >= 4 else 0) / (2 * width + 2), 6)


@pytest.mark.parametrize(("line", "keys"), [("we met John Smith today", ["smith|john"]), ("see Smith, John", ["smith|john"]), ("SMITH, JOHN", ["smith|john"]), ("with O'Neil, Shaun", ["o'neil|shaun"]), ("Anne-Marie Jones", ["jones|anne-marie"]), ("ANNUAL REPORT OF PROGRESS", []), ("last March Friday", [])])
def test_names(spark, line, keys):
    pages = spark.createDataFrame([(1, "p", 1, line)], "doc_id long, rel_path string, page_num int, text string")
    assert [r.canonical_key for r in names.mentions_of(pages).collect()] == keys


def test_scans_of_every_page(spark):
    page = "call 212-555-0147 or write to a@example.com today "
    pages = spark.createDataFrame([(1, "p.pdf", 1, page * 3), (1, "p.pdf", 2, "x@example.com"), (1, "p.pdf", 3, "")], "doc_id long, rel_path string, page_num int, text string")
    few, every = (textscan.document_signals(pages, every_page=e).first() for e in (False, True))
    assert (few.total_chars, few.total_words) == (150, 21) and (every.total_chars, every.total_words) == (163, 22)
    assert few.pages_with_text == every.pages_with_text == 1 and few.page_count == every.page_count == 3 and few.text_coverage_pct == every.text_coverage_pct
    few, every = (textscan.rule_hits(pages, e).first() for e in (False, True))
    assert (few.line_count, few.CONTACT_LIST__email_address) == (1, 3) and (every.line_count, every.CONTACT_LIST__email_address) == (2, 4)


@pytest.mark.parametrize(("line", "every", "plain"), [("QUEREEUX,SGSD!! DE.!! R\xc9IER", [], ["quereeux|sgsd"]), ("SMITH, JOHN A_B C", [], ["smith|john", "john|a"]), ("SMITH, JOHN’S OWN BOOK", [], []), ("SMITH, JOHN AND CO", [], [])])
def test_names_in_lines_of_capitals(spark, duck, tmp_path, line, every, plain):
    pages = spark.createDataFrame([(1, "p", 1, line)], "doc_id long, rel_path string, page_num int, text string")
    assert [r.canonical_key for r in names.mentions_of(pages).collect()] == every
    found = sorted(r.canonical_key for r in names.mentions_of(pages, plain_headings=True).collect())
    text = line.replace("'", "''")
    con = duck.cursor()
    con.sql(f"create temp view documents as select 1 as doc_id, '{text}' as text, 'en' as lang, 'src1' as source")
    sql = sorted(r[0] for r in con.sql(reference_sql.NAMES + "select canonical_key from mentions").fetchall())
    assert found == sql and ("quereeux|sgsd" in found) == ("quereeux|sgsd" in plain)


@pytest.mark.parametrize(("line", "keys"), [("John Smith—and Ann Lee, Mary’s", ["lee|ann", "lee|mary's"]), ("John\xa0Smith met Ann Lee", ["lee|ann"]), ("½John Smith, Ann 中", ["smith|ann"]), ("Ann Lee\U0001f600", [])])
def test_signs_outside_ascii_are_parts_of_words_as_in_the_sql(spark, duck, line, keys):
    pages = spark.createDataFrame([(1, "p", 1, line)], "doc_id long, rel_path string, page_num int, text string")
    found = sorted(r.canonical_key for r in names.mentions_of(pages, plain_headings=True).collect())
    text = line.replace("'", "''")
    con = duck.cursor()
    con.sql(f"create temp view documents as select 1 as doc_id, '{text}' as text, 'en' as lang, 'src1' as source")
    assert found == keys == sorted(r[0] for r in con.sql(reference_sql.NAMES + "select canonical_key from mentions").fetchall())


def test_name_index_counts_pages_and_prefers_mixed_case(spark):
    rows = [(1, "b", 1, "JOHN SMITH"), (1, "b", 2, "John Smith and John Q. Smith"), (2, "a", 1, "JOHN SMITH")]
    docs = names.name_documents(names.mentions_of(spark.createDataFrame(rows, "doc_id long, rel_path string, page_num int, text string")))
    index = names.name_index(docs).collect()
    assert [(r.canonical_key, r.display_name, r.total_count) for r in index] == [("smith|john", "John Smith", 4)]
    assert [(d.rel_path, [(p.page_num, p["count"]) for p in d.pages]) for d in index[0].internal_docs] == [("a", [(1, 1)]), ("b", [(1, 1), (2, 2)])]


def test_lookup_goes_on_only_without_an_answer(spark):
    docs = names.name_documents(names.mentions_of(spark.createDataFrame([(1, "a", 1, "John Smith\nJane Q. Smithers\nAl Bo"), (2, "b", 1, "John Smith")], "doc_id long, rel_path string, page_num int, text string")))
    queries = spark.createDataFrame([(q,) for q in ("Smith, John", "jane q smithers", "mith", "b", "bo, al", "nobody", " ", "SMITH  JOHN")], "query string")
    found = sorted((r.query, r.stage, r.canonical_key) for r in names.lookup(names.name_records(docs), queries).collect())
    assert found == [("SMITH  JOHN", 2, "smith|john"), ("Smith, John", 1, "smith|john"), ("b", 3, "bo|al"), ("bo, al", 1, "bo|al"), ("jane q smithers", 1, "smithers|jane"), ("mith", 3, "smithers|jane"), ("mith", 3, "smith|john")]
    assert [r.canonical_key for r in names.search(names.name_records(docs), "JO", least=2).collect()] == ["smith|john"]


def test_name_cap_drops_the_whole_document(spark):
    rows = [(1, "a", 1, "John Smith"), (1, "a", 2, "Jane Roe"), (2, "b", 1, "John Smith")]
    mentions = names.mentions_of(spark.createDataFrame(rows, "doc_id long, rel_path string, page_num int, text string"))
    assert {r.doc_id for r in names.name_documents(mentions, 1).collect()} == {2}
    assert {r.doc_id for r in names.name_documents(mentions, 2).collect()} == {1, 2} == {r.doc_id for r in names.name_documents(mentions, 0).collect()}
    assert [tuple(r) for r in names.crowded_documents(mentions, 1).collect()] == [("a", 1, "exceeded max_names_per_doc=1")]


def test_duplicates_and_issues(spark):
    inv = spark.createDataFrame([("a.txt", "abc", 10), ("b.txt", "abc", 10), ("c.txt", "xyz", 5)], "rel_path string, hash_value string, size_bytes long")
    assert [tuple(r) for r in inventory.duplicate_groups(inv).collect()] == [("abc", 2, 20, "a.txt|b.txt")]
    rows = [("zero.bin", 0, "bin", "", "2024-01-01"), ("future.dat", 5, "dat", "x/y", "2024-01-03"), ("large.bin", 1000, "bin", "application/octet-stream", "2024-01-01"), ("ok.txt", 5, "txt", "text/plain", "2024-01-01")]
    found = inventory.potential_issues(spark.createDataFrame(rows, "rel_path string, size_bytes long, extension string, detected_mime string, modified_time string"), F.lit("2024-01-02").cast("timestamp"), large=100)
    assert {r.rel_path: r.issues for r in found.collect()} == {
        "zero.bin": "zero_size, missing_mime, uncommon_extension", "future.dat": "uncommon_extension, future_modified_time", "large.bin": "missing_mime, very_large, uncommon_extension",
    }


@pytest.mark.parametrize(("truth", "pred", "confidence", "final", "source"), [("IMAGE_PDF", "MIXED_PDF", 0.2, "IMAGE_PDF", "TRUTH"), ("", "IMAGE_PDF", 0.8, "IMAGE_PDF", "MODEL"), ("", "IMAGE_PDF", 0.5, "TEXT_PDF", "HEURISTIC"), (None, None, 0.9, "TEXT_PDF", "HEURISTIC")])
def test_decision(spark, truth, pred, confidence, final, source):
    columns = labels.decide(F.col("t"), F.col("p"), F.col("c"), F.lit("TEXT_PDF"))
    assert tuple(one(spark, F.struct(*columns), t=truth, p=pred, c=confidence)) == (final, source)


def test_ambiguous_and_repeated_labels(spark):
    schema = "doc_id long, rel_path string, top_level_folder string, hash_value string"
    inv = spark.createDataFrame([(1, "A/f.pdf", "A", ""), (2, "./A/f.pdf", ".", ""), (3, "B/h.pdf", "B", ""), (4, "B\\h.pdf", "B", ""), (5, "C/i.pdf", "C", "")], schema)
    rows = [("A\\f.pdf", "IMAGE_PDF", "t"), ("B/g.pdf", "IMAGE_PDF", "t"), ("B/h.pdf", "IMAGE_PDF", "t"), ("C/i.pdf", "IMAGE_PDF", "t"), ("C/i.pdf", "IMAGE_PDF", "t"), ("", "IMAGE_PDF", "t")]
    given = spark.createDataFrame(rows, "rel_path string, label_raw string, labeled_at string")
    assert sorted(r.file_path for r in labels.match(given, inv).collect()) == ["A/f.pdf", "C/i.pdf", "C/i.pdf"]
    assert sorted((r.rel_path, r.reason) for r in labels.orphaned(given, inv).collect()) == [("", "blank path"), ("B/g.pdf", "no file"), ("B/h.pdf", "several files")]
    assert sorted(r.rel_path for r in labels.unmatched(given, inv).collect()) == ["B/h.pdf", "B\\h.pdf"]


def test_labels_are_replaced_only_if_told_to(spark):
    schema = "rel_path string, label_raw string, labeled_at string"
    old, fresh = spark.createDataFrame([("a.pdf", "IMAGE_PDF", "1")], schema), spark.createDataFrame([("./a.pdf", "TEXT_PDF", "2")], schema)
    with pytest.raises(ValueError, match="overwrite"):
        labels.add_label(old, fresh)
    assert [(r.norm_path, r.label_raw, r.label_norm) for r in labels.add_label(old, fresh, overwrite=True).collect()] == [("a.pdf", "TEXT_PDF", "IMAGE_OF_TEXT_PDF")]
    with pytest.raises(ValueError, match="one of"):
        labels.add_label(old, spark.createDataFrame([("b.pdf", "WHAT", "2")], schema))


@pytest.mark.parametrize(("k", "n"), [(0, 0), (3, 3), (100, 5)])
def test_queue_takes_folders_in_turn(spark, k, n):
    rows = [("a/1", "a", 0.1), ("a/2", "a", 0.2), ("a/3", "a", 0.3), ("b/1", "b", 0.9), (None, None, 0.5)]
    found = labels.label_queue(spark.createDataFrame(rows, "rel_path string, top_level_folder string, confidence double").withColumn("suggested_label", F.lit("x")), k).collect()
    assert [r.rel_path for r in found] == ["a/1", "b/1", None, "a/2", "a/3"][:n]


def test_compare_fills_what_is_absent(spark):
    schema = "doc_id long, classification string, page_count long, pages_with_text long, total_text_chars long"
    a, b = spark.createDataFrame([(1, "Mixed", 2, 1, 10), (2, None, None, None, None)], schema), spark.createDataFrame([(2, "Scanned", 1, 0, 0), (3, "Mixed", 5, 5, 50)], schema)
    found = {r.doc_id: (r.status, r.class_a, r.class_b, r.delta_page_count) for r in catalogue_views.compare(a, b).collect()}
    assert found == {1: ("only_a", "Mixed", "Unknown", -2), 2: ("both", "Unknown", "Scanned", 1), 3: ("only_b", "Unknown", "Mixed", 5)}


def test_links_are_absolute(spark):
    html = '<a href="/x.pdf">x</a> <A class="c" HREF=\'y.zip\'>y</A> <a href="https://o.example/z">z</a>'
    found = incremental.links(spark.createDataFrame([(1, "http://h.example/d/p.html?q=/1", html)], "page_id long, url string, html string"))
    assert [r.link for r in found.collect()] == ["http://h.example/x.pdf", "http://h.example/d/y.zip", "https://o.example/z"]


def test_row_projection_of_ruled_page_varies_more_than_noise():
    ruled = np.full((100, 200), 255, np.uint8)
    ruled[10::10] = 0
    noise = np.random.default_rng(1).integers(0, 256, (100, 200), dtype=np.uint8)
    assert raster.page_features(ruled)["projection_var_row"] > raster.page_features(noise)["projection_var_row"]
    assert raster.darkness(np.zeros((20, 20), np.uint8))["is_mostly_black"]
    assert np.isnan(raster.edge_density(np.zeros((2, 9), np.uint8)))
    assert raster.otsu_threshold(np.full((4, 4), 7, np.uint8)) == 0 and raster.otsu_threshold(np.array([[10, 10, 200, 201]], np.uint8)) == 10


def test_centre_takes_seven_tenths_rounded_down():
    page = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert raster.centre(page, 0.7).tolist() == page[1:6, 1:6].tolist()
    assert raster.centre(np.zeros((1, 3), np.uint8), 0.7).shape == (1, 2)


def test_pages_that_were_not_rendered(spark):
    rows = [(1, 1, bytearray(b"\x00" * 16), 4, 2, 0), (1, 2, None, None, 1, 3), (1, 3, bytearray(b"\x01" * 7), 4, None, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_num int, pixels binary, width int, font_count int, image_count int")
    dark = {r.page_num: (r.black_ratio_fixed, r.is_mostly_black) for r in raster.page_darkness(pages).collect()}
    assert dark == {1: (1.0, True), 2: (None, None), 3: (None, None)}
    rolled = raster.darkness_docs(raster.page_darkness(pages)).first()
    assert (rolled.page_count, rolled.pages_black_checked, rolled.mostly_black_pct) == (3, 1, 1.0)
    features = raster.doc_features(raster.page_feature_table(pages)).first()
    assert (features.pages_sampled, features.font_count_mean, features.image_present_pct, features.gray_mean_mean) == (3, 1.0, 1 / 3, 0.0)


def test_model_rows_are_computed_once(spark):
    from folioforge.operators import doctype
    from folioforge.queries import models

    seen = spark.sparkContext.accumulator(0)

    def measured(i: int) -> float:
        seen.add(1)
        return float(i % 7)

    rows = spark.range(40).select(F.concat(F.lit("p"), "id").alias("rel_path"), F.when(F.col("id") % 2 == 0, "TEXT_PDF").otherwise("IMAGE_PDF").alias("label"), F.udf(measured, "double")("id").alias("x"))
    trained = doctype.train(rows, ["x"], share=0.25, seed=1, iterations=3)
    assert trained.snapshot.count() == trained.card["training_rows"] == 40
    assert seen.value <= 80  # not once for each stage of the pipeline, its evaluation and its card
    read = models._trained(spark, "/root/testdata/sf0.001")[1].inputFiles()
    assert read and not any("/testdata/" in f for f in read)


def test_feature_columns_and_predictions(spark):
    from folioforge.operators import doctype

    rows = [(f"f{k}", "a", "IMAGE_PDF" if k % 2 else "MIXED_PDF", float(k % 2) + k / 1000, None if k % 5 == 0 else float(k)) for k in range(40)]
    table = spark.createDataFrame(rows, "rel_path string, top_level_folder string, label string, x double, y double")
    assert doctype.feature_columns(table) == ["x", "y"]
    trained = doctype.train(table, ["x", "y"], share=0.25, seed=3, iterations=30)
    assert trained.card["eval"]["accuracy"] == 1.0 and trained.card["label_distribution"] == {"IMAGE_PDF": 20, "MIXED_PDF": 20}
    found = doctype.predict(trained.model, table, ["rel_path", "label"], reasons=1).collect()
    assert all(r.predicted_label == r.label and r.proba_TEXT_PDF == 0 and abs(r.proba_IMAGE_PDF + r.proba_MIXED_PDF - 1) < 1e-9 and r.reason_features.startswith('{"x":') for r in found)


def test_models_are_found_by_id_path_and_latest(spark, tmp_path):
    from folioforge.operators import doctype

    table = spark.createDataFrame([(f"f{k}", "AB"[k % 2], float(k % 2)) for k in range(12)], "rel_path string, label string, x double")
    root = str(tmp_path)
    paths_ = [doctype.save(doctype.train(table, ["x"], share=0.2, seed=s, iterations=5), root, f"m{s}") for s in (1, 2)]
    assert doctype.load(spark, root)[1]["hyperparams"]["random_state"] == 2
    assert doctype.load(spark, root, "m1")[1]["hyperparams"]["random_state"] == 1 == doctype.load(spark, root, paths_[0])[1]["hyperparams"]["random_state"]
    with pytest.raises(FileNotFoundError):
        doctype.load(spark, root, "m3")
    assert spark.read.parquet(f"{paths_[0]}/training_snapshot").count() == 12


@pytest.mark.parametrize("share", [0.1, 0.25, 0.5])
def test_split_holds_out_the_smallest_hashes(spark, share):
    import hashlib
    import math

    from folioforge.operators import doctype

    rows = [(k, "ab"[k % 3 == 0]) for k in range(300)] + [(900, "lone")]
    found = {r.k: r.held_out for r in doctype.split(spark.createDataFrame(rows, "k long, label string"), "label", "k", share, 5).collect()}
    for label in ("a", "b"):
        own = sorted((k for k, x in rows if x == label), key=lambda k: hashlib.sha256(f"{k}|5".encode()).hexdigest())
        assert [found[k] for k in own] == [i < math.ceil(len(own) * share) for i in range(len(own))]
    assert found[900] is False


def test_keywords_are_listed_in_given_order(spark):
    from folioforge.operators import media

    rows = [(1, 1, "a", "Red red blue. C++ c++ green"), (1, 2, "b", "blue from:me"), (2, 1, None, "")]
    segments = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in media.features(segments, {"x": ("green", "blue"), "y": ("red", "none")}).collect()}
    assert (found[1].top_keywords, found[1].category_x, found[1].category_y, found[1].structure_hints) == (["blue", "red", "green"], 3, 2, ["email_headers"])
    assert (found[2].top_keywords, found[2].word_count, found[2].num_speakers) == ([], 0, 0)
    assert media.features(segments).columns[-2:] == ["structure_hints", "top_keywords"]


def test_run_status_and_manifest(spark):
    now = spark.createDataFrame([("a", "e", None, 1, 304), ("b", "e2", None, 5, 200), ("c", None, None, None, 200)], "url string, etag string, last_modified string, content_length long, status_code int")
    held = spark.createDataFrame([("a", "e", None, 1), ("b", "e1", "Mon", 5)], "url string, etag string, last_modified string, content_length long")
    assert {r.url: r.status for r in incremental.change_status(now, held).collect()} == {"a": "skipped_304", "b": "skipped_length", "c": "new"}
    states = spark.createDataFrame([("skipped_304", False, True), ("skipped_etag", False, False), ("new", False, None), ("changed", True, None)], "s string, f boolean, p boolean")
    shown = states.select(incremental.run_status(F.col("s"), failed=F.col("f"), pages_changed=F.col("p")).alias("x"), incremental.run_status(F.col("s"), dry_run=True).alias("y")).collect()
    assert [tuple(r) for r in shown] == [("page-count-changed", "skipped"), ("skipped", "skipped"), ("downloaded", "dry-run"), ("failed", "dry-run")]


def test_views_of_documents(spark):
    docs = spark.createDataFrame([("b", 2, 0.5, "Mixed"), ("a", 2, 0.1, None), ("c", 9, 0.2, "Text-based")], "rel_path string, page_count int, size_mb double, classification string")
    assert [r.rel_path for r in catalogue_views.sort_documents(docs, "pages", ascending=False).collect()] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        catalogue_views.sort_documents(docs, "colour")
    assert sorted(r.rel_path for r in catalogue_views.needing_attention(docs).collect()) == ["a", "b"]
    assert {(r.facet, r.value, r.n) for r in catalogue_views.facets(docs, ("classification",)).collect()} == {("classification", "Mixed", 1), ("classification", "Text-based", 1)}
    pages = spark.createDataFrame([(1, 1, "a <b> B")], "doc_id long, page_num int, text string")
    assert [r.marked for r in catalogue_views.highlight(pages, "b").collect()] == ["a &lt;<mark>b</mark>&gt; <mark>B</mark>"]


def test_catalog_fallbacks(spark):
    schema = "file_id string, rel_path string, extension string, detected_mime string, top_level_folder string, size_bytes string"
    inv = spark.createDataFrame([("1", "A\\x.PDF", "PDF", "application/pdf", "A", "12"), (None, "y", None, " ", " ", "many"), ("3", None, "txt", "text/plain", None, None)], schema)
    docs = spark.createDataFrame([("9", "A/x.PDF", 3, " ", "http://u")], "doc_id string, rel_path string, page_count int, doc_type_final string, source_url string")
    found = {r.id: r for r in catalogue_views.public_index(inv, docs, "root").collect()}
    assert (found["1"].doc_type_final, found["1"].page_count, found["1"].document_url, found["1"].title, found["1"].size_bytes) == ("PDF (unprobed)", 3, "http://u", "A\\x.PDF", 12)
    assert (found["y"].doc_type_final, found["y"].content_type, found["y"].dataset, found["y"].size_bytes) == ("NON_PDF", None, "root", 0)
    assert (found["3"].doc_type_final, found["3"].content_type, found["3"].title) == ("NON_PDF (txt)", "text/plain", "Untitled document")


@pytest.mark.parametrize(("path", "mime"), [("a.pdf", "application/pdf"), ("x/b.tar.gz", "application/x-tar"), ("c.tgz", "application/x-tar"), ("d.gz", "application/octet-stream"), ("e.avi", "video/x-msvideo"), ("f.bmp", "image/bmp"), ("g.eml", "message/rfc822"), ("h.xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"), ("none", "application/octet-stream")])
def test_mime_of_path(spark, path, mime):
    assert one(spark, paths.mime_of_path(F.col("p")), p=path) == mime


def test_missing_columns_are_null(spark):
    row = ensure_columns(spark.createDataFrame([("a", "x")], "rel_path string, size_bytes string"), INVENTORY).first()
    assert (row.rel_path, row.size_bytes, row.hash_value) == ("a", None, None)


def test_run_id():
    from datetime import datetime

    assert run_id("My run!", "probe", datetime(2024, 1, 2, 3, 4, 5)) == "My_run_probe_20240102_030405"


def test_a_scan_reads_text_pages_or_all(spark):
    from folioforge.operators import textscan

    long = "A page of text with words enough to count as one."
    rows = [(1, "a", 1, "short"), (1, "a", 2, long), (1, "a", 3, ""), (2, "b", 1, "brief"), (2, "b", 2, "   "), (3, "c", 1, None), *((4, "d", k, f"{long} {k}") for k in range(1, 9))]
    pages = spark.createDataFrame(rows, "doc_id long, rel_path string, page_num int, text string")
    found = {r.doc_id: (r.text_pages, r.total_chars) for r in textscan.text_quality(pages).collect()}
    assert found == {1: (1, len(long)), 2: (2, 8), 4: (8, 8 * len(long) + 16)}
    both = {r.doc_id: (r.total_chars, r.page_count) for r in textscan.document_signals(pages).collect()}
    assert both == {1: (len(long), 3), 2: (8, 2), 3: (None, 1), 4: (8 * len(long) + 16, 8)}
    assert {r.doc_id: r.line_count for r in textscan.rule_hits(pages).collect()} == {1: 1, 2: 2, 4: 8}
    assert {r.doc_id: r.text_snippet for r in textscan.snippets(pages).collect()} == {1: long, 2: "brief", 4: f"{long} 1"}
    picked = [{r.page_num for r in textscan.scanned_pages(pages, max_pages=3, seed=s).filter("doc_id = 4").collect()} for s in (1, 1, 2, 3)]
    assert all(len(p) == 3 for p in picked) and picked[0] == picked[1] and len(set(map(frozenset, picked))) > 1
    assert {(r.doc_id, r.page_num) for r in textscan.scanned_pages(pages).filter("doc_id < 4").collect()} == {(1, 2), (2, 1), (2, 2), (3, 1)}


def test_labeling_queue_by_focus_and_folder(spark):
    from folioforge.operators import catalogue_views as views

    docs = spark.createDataFrame([(1, "A/1.pdf", 3), (2, "A/2.pdf", 1), (3, "B/3.pdf", 2), (4, "A/4.pdf", 9), (5, "A/5.pdf", 1), (6, "B/6.pdf", 1)], "doc_id long, rel_path string, page_count long")
    quality = spark.createDataFrame([(1, "EMPTY"), (2, "LOW"), (3, "LOW"), (4, "LOW"), (5, "GOOD")], "doc_id long, text_quality_label string")
    labels = spark.createDataFrame([(3,)], "doc_id long")

    def queue(**options):
        return [r.doc_id for r in views.labeling_queue(docs, quality, labels, **options).collect()]

    assert queue() == [2, 6, 1] and queue(focus=("LOW",)) == [2] and queue(focus=("EMPTY",)) == [6, 1] and queue(folder="A") == [2, 1]
