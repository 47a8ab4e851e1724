"""Command line: stages of the engine over a folder of files or of tables.

    python -m folioforge.cli inventory run --root DIR --out DIR [--hash sha256] [--ignore GLOB ...] [--max-files N]
    python -m folioforge.cli probe run --pages PARQUET [--inventory REF] [--labels TABLE] [--model REF --features PARQUET]
        [--only-top-folder F] [--min-model-confidence X] [--text-scan] [--name-index] --out DIR
    python -m folioforge.cli text-scan run --pages PARQUET --out DIR
    python -m folioforge.cli name-index run --pages PARQUET --probe REF --text-scan REF --inventory REF --out DIR
        [--all-documents] [--min-total-count N] [--max-names-per-doc N]
    python -m folioforge.cli public-index run --inventory REF --probe REF --out DIR --dest DIR
    python -m folioforge.cli pdf-type label | train | predict | migrate --inventory REF --labels PARQUET --out DIR ...
    python -m folioforge.cli doc-type train | predict | queue --features PARQUET --out DIR ...
    python -m folioforge.cli labels reconcile --labels CSV --inventory PARQUET
    python -m folioforge.cli media run --root DIR --segments JSON --out DIR
    python -m folioforge.cli links run --pages PARQUET --out DIR [--dry-run]
    python -m folioforge.cli self-check | query NAME --tables DIR

A REF is a run's id, a path, LATEST, or NONE where a table may be missing. The output folder is --out, else FOLIOFORGE_OUT, else ./outputs.
"""

from __future__ import annotations

import argparse
import os
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge import staging
from folioforge.functions import paths
from folioforge.operators import catalogue_views as views
from folioforge.operators import doctype, incremental, inventory, labels, media, names, probe, readiness, textscan
from folioforge.schemas import INVENTORY, LABELS, MANIFEST, ensure_columns
from folioforge.sources import export, fetch, files, tables, transcripts


def run_id(label: str, stage: str, now: datetime | None = None) -> str:
    """label_stage_time, with anything but letters, digits, dots and hyphens in the label replaced."""
    clean = re.sub(r"[^A-Za-z0-9.-]+", "_", label.strip()).strip("_") or "run"
    return f"{clean}_{stage}_{(now or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S')}"


def repair_path(path: str) -> str:
    """A path that lost its leading slash, if the one with it exists."""
    return f"/{path}" if not os.path.isabs(path) and not os.path.exists(path) and os.path.exists(f"/{path}") else path


def session() -> SparkSession:
    return SparkSession.builder.appName("folioforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def out_folder(given: str | None) -> str:
    """Where runs go: as given, else as the environment says, else ./outputs."""
    return repair_path(given or os.environ.get("FOLIOFORGE_OUT") or "./outputs").rstrip("/")


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _inventory(a: argparse.Namespace) -> None:
    root = repair_path(a.root)
    if not os.path.isdir(root):
        raise SystemExit(f"not a folder: {root}")
    if a.max_files is not None and a.max_files <= 0:
        raise SystemExit("--max-files must be positive")
    spark, label = session(), os.path.basename(root.rstrip("/"))
    found, errors = files.scan_inventory(spark, root, ignore=(*paths.DEFAULT_IGNORES, *a.ignore), algorithm=a.hash, sample_bytes=a.sample_bytes, max_files=a.max_files)
    rows, name, out, now = ensure_columns(found, INVENTORY), run_id(a.label or label, "inventory"), out_folder(a.out), _now()
    failed = f"{out}/inventory/errors/run_id={name}"
    errors.write.mode("errorifexists").parquet(failed)
    log = {"root": root, "source_root_name": label, "errors": spark.read.schema(errors.schema).parquet(failed).count(), "errors_path": failed, "config": {"hash": a.hash, "ignore": a.ignore, "max_files": a.max_files}}
    where = tables.write_run(rows, out, "inventory", name, root, now, log=log, flat_copy=True)
    summary = inventory.summary(spark.read.schema(INVENTORY).parquet(where))
    counts = [r.asDict() for r in summary.collect()]  # a row for each extension, type and folder
    tables.write_json(spark, f"{out}/inventory/{name}.summary.json", {"run_id": name, "source_root": root, "source_root_name": label, "counts": counts})
    summary.show(100, truncate=False)


def _text_scan_rows(pages: DataFrame) -> DataFrame:
    return textscan.scanned(textscan.document_signals(pages))


def _text_scan(a: argparse.Namespace) -> None:
    rows = _text_scan_rows(session().read.parquet(a.pages))
    print(tables.write_run(rows, out_folder(a.out), "text-scan", run_id(a.label or "text-scan", "text-scan"), a.pages, _now(), log={"pages": a.pages}))


def _named(reference: str) -> bool:
    return reference.upper() != "NONE"


def _probe(a: argparse.Namespace) -> None:
    """Pages rolled up to documents, with the human label, the model's type and the decision of each."""
    spark, out = session(), out_folder(a.out)
    at = readiness.Thresholds(a.text_threshold, a.doc_text_pct_text, a.doc_text_pct_scanned, a.doc_text_min_chars_per_page)
    pages, log = spark.read.parquet(a.pages), {"pages": a.pages, "thresholds": vars(at), "min_model_confidence": a.min_model_confidence}
    if a.only_top_folder:
        pages = pages.filter(paths.top_level_folder(paths.normalize_rel_path(F.col("rel_path"))) == a.only_top_folder)
    docs, matched, predicted = readiness.docs(readiness.pages(pages, at), at), None, None
    if _named(a.inventory):
        files = _files(spark, out, a.inventory)
        log["ignored"] = [r.asDict() for r in probe.ignored_counts(ensure_columns(_run_table(spark, out, "inventory", a.inventory), INVENTORY)).collect()]  # a row for each extension and type
        if a.labels:
            given = _labels_of(spark, a.labels, files)
            matched = labels.match(given, files)
            log["label_reconciliation"] = {r["what"]: r["n"] for r in labels.reconcile_counts(given, files).collect()}  # four rows
    elif a.labels:
        raise SystemExit("labels are matched to an inventory: --inventory")
    if a.model and _named(a.model):
        if not a.features:
            raise SystemExit("a model reads --features")
        a.selection, a.only_unlabeled, log["model"] = "", False, a.model
        predicted = _predicted(a, spark, 5)
    name = run_id(a.label or "probe", "probe")
    rows = labels.with_decision(docs, matched, predicted, a.min_model_confidence)
    scan = None
    if a.text_scan:
        scan = tables.write_run(_text_scan_rows(pages), out, "text-scan", run_id(a.label or "probe", "text-scan"), a.pages, _now(), log={"pages": a.pages, "probe": name})
        rows, log["text_scan"] = textscan.merge_signals(rows, spark.read.parquet(scan)), scan
    where = tables.write_run(rows, out, "probe", name, a.pages, _now(), log=log)
    print(where)
    if a.name_index:
        if scan is None:
            raise SystemExit("the name index takes documents of good text: --text-scan")
        a.probe, a.text_scan, a.all_documents = where, scan, False
        _name_index(a)


def _name_index(a: argparse.Namespace) -> None:
    """Names of the probed documents whose text is good (or of all), with what is known of each document."""
    spark, out = session(), out_folder(a.out)
    mentions, meta, log = names.mentions_of(spark.read.parquet(a.pages)), None, {"pages": a.pages, "probe": a.probe, "text_scan": a.text_scan}
    name = run_id(a.label or "name-index", "name-index")
    if _named(a.probe):
        docs = _run_table(spark, out, "probe", a.probe)
        signals = _run_table(spark, out, "text-scan", a.text_scan) if _named(a.text_scan) else spark.createDataFrame([], "rel_path string")
        files = _files(spark, out, a.inventory) if _named(a.inventory) else spark.createDataFrame([], "rel_path string, doc_id string, top_level_folder string")
        meta = staging.staged(names.document_metadata(docs, signals, files, not a.all_documents), "metadata")
        if meta.isEmpty():
            raise SystemExit("no document of good text: run text-scan first, or --all-documents")
        mentions = mentions.withColumn("doc_id", F.col("doc_id").cast("string")).join(meta.select("doc_id"), "doc_id", "left_semi")
    mentions = staging.staged(mentions, "mentions")  # read for the names and for what is left out
    most = a.max_names_per_doc
    if most:
        log["errors_path"] = f"{out}/name-index/errors/run_id={name}"
        names.crowded_documents(mentions, most).write.mode("errorifexists").parquet(log["errors_path"])
    found = names.name_documents(mentions, most)
    print(tables.write_run(names.name_index(found, meta, a.min_total_count), out, "name-index", name, a.pages, _now(), log=log))


def _run_table(spark: SparkSession, out: str, stage: str, reference: str):
    return spark.read.parquet(tables.resolve_run(spark, out, stage, reference))


def _files(spark: SparkSession, out: str, reference: str):
    """PDFs of an inventory, fit for labelling, with their document id."""
    rows = tables.load_inventory(_run_table(spark, out, "inventory", reference)).filter("extension = 'pdf'")
    return rows.withColumn("doc_id", paths.stable_doc_id(F.lit(""), F.col("rel_path"), F.col("size_bytes"), F.col("modified_time")))


def _public_index(a: argparse.Namespace) -> None:
    spark, out = session(), out_folder(a.out)
    inv = _run_table(spark, out, "inventory", a.inventory)
    docs = _run_table(spark, out, "probe", a.probe) if a.probe.upper() != "NONE" else spark.createDataFrame([], "rel_path string, doc_id string")
    if a.text_scan.upper() != "NONE":
        docs = textscan.merge_signals(docs, _run_table(spark, out, "text-scan", a.text_scan))
    index = views.catalog_order(views.public_index(inv, docs))
    export.catalog_json(index, {"inventory": a.inventory, "probe": a.probe, "last_updated": _now()[:10]}, a.dest)
    print(a.dest)


def _labels_of(spark: SparkSession, path: str, inv):
    given = tables.load_table(spark, path, LABELS)
    return tables.load_labels(given, inv)


def _label(a: argparse.Namespace) -> None:
    spark, out = session(), out_folder(a.out)
    inv = _files(spark, out, a.inventory)
    path = paths.normalize_rel_path(F.lit(a.rel_path))
    same = inv.filter(F.col("rel_path") == path).select("doc_id", "hash_value").first()
    fresh = spark.createDataFrame(
        [(a.rel_path, a.label.upper(), _now(), a.notes, a.inventory, same["doc_id"] if same else "", same["hash_value"] if same and len(same["hash_value"] or "") == 64 else "")],
        "rel_path string, label_raw string, labeled_at string, notes string, source_inventory_run string, doc_id_at_label_time string, sha256_at_label_time string",
    )
    fresh = tables.load_labels(fresh, inv)
    old = _labels_of(spark, a.labels, inv)
    try:
        labels.add_label(old, fresh, a.overwrite)
    except ValueError as e:
        raise SystemExit(str(e)) from e
    kept = old.join(fresh.select("rel_path"), "rel_path", "left_anti").unionByName(fresh)
    tables.upgrade_labels(kept, a.labels, f"{a.labels}_backups/{run_id('labels', 'label')}")
    labels.reconcile_counts(spark.read.parquet(a.labels), inv).show(truncate=False)


def _train_labels(a: argparse.Namespace) -> None:
    spark, out = session(), out_folder(a.out)
    inv = _files(spark, out, a.inventory)
    matched = labels.match(_labels_of(spark, a.labels, inv), inv)
    print(tables.write_run(labels.training_rows(matched, a.exclude_mixed), out, "pdf-type-training", run_id("labels", "training"), a.labels, _now()))


def _predict_labels(a: argparse.Namespace) -> None:
    spark, out = session(), out_folder(a.out)
    inv = _files(spark, out, a.inventory)
    left = labels.unmatched(_labels_of(spark, a.labels, inv), inv)
    rows = labels.heuristic_predictions(left, _run_table(spark, out, "probe", a.probe))
    print(tables.write_run(rows, out, "pdf-type-predictions", run_id("probe", "predictions"), a.labels, _now()))


def _migrate(a: argparse.Namespace) -> None:
    spark, out = session(), out_folder(a.out)
    inv = _files(spark, out, a.inventory)
    rows = _labels_of(spark, a.labels, inv)
    report = labels.migration_report(rows).first().asDict() | {"sample_rel_paths_to_change": [r["rel_path"] for r in labels.migration_samples(rows).collect()]}
    name = run_id("labels", "migration")
    tables.write_json(spark, f"{out}/labels/{name}.json", report | {"timestamp": _now(), "inventory": a.inventory})
    print(f"{out}/labels/{name}.json")
    if a.write and not a.dry_run:
        tables.upgrade_labels(rows, a.labels, f"{out}/labels/backups/{name}")


def _train_model(a: argparse.Namespace) -> None:
    spark, out = session(), out_folder(a.out)
    rows = spark.read.parquet(a.features).filter("label is not null")
    trained = doctype.train(rows, doctype.feature_columns(rows), share=a.eval_split, seed=a.seed, about={"features_path": a.features})
    print(doctype.save(trained, out, run_id("model", "doc_type")), trained.card["eval"], sep="\n")


def _predicted(a: argparse.Namespace, spark: SparkSession, reasons: int):
    model, card = doctype.load(spark, out_folder(a.out), a.model)
    rows = spark.read.parquet(a.features)
    if a.selection:
        listed = tables.read_csv(spark, a.selection, T.StructType([T.StructField("rel_path", T.StringType()), T.StructField("doc_id", T.StringType())]))
        by_path = not listed.filter("rel_path is not null").isEmpty()
        rows = probe.select_listed(rows, listed.select("rel_path" if by_path else "doc_id"))
    if a.only_unlabeled and "label" in rows.columns:
        rows = rows.filter("label is null")
    keep = [c for c in ("rel_path", "doc_id", "top_level_folder") if c in rows.columns]
    return doctype.predict(model, rows.select(*keep, *card["features"]), keep, reasons=reasons)


def _predict_model(a: argparse.Namespace) -> None:
    spark = session()
    print(tables.write_run(_predicted(a, spark, 5), out_folder(a.out), "doc-type-predictions", run_id("model", "doc_type_predict"), a.features, _now()))


def _queue(a: argparse.Namespace) -> None:
    a.only_unlabeled = True
    spark = session()
    rows = _predicted(a, spark, 0).withColumnRenamed("predicted_label", "suggested_label")
    print(tables.write_run(labels.label_queue(rows, a.k), out_folder(a.out), "label-queue", run_id("model", "queue"), a.features, _now()))


def _media(a: argparse.Namespace) -> None:
    spark, out = session(), out_folder(a.out)
    root = repair_path(a.root)
    found = files.discover_media(files.scan_inventory(spark, root)[0]).withColumnRenamed("rel_path", "file_path").withColumnRenamed("display_name", "file_name")
    index = f"{out}/media/index"
    if tables.exists(spark, index):
        found = transcripts.unprocessed(found, spark.read.parquet(index))
    segments = transcripts.read_segments(spark, a.segments)
    facts = media.features(segments.withColumnRenamed("file_path", "conv_id")).withColumnRenamed("conv_id", "file_path")
    lengths = transcripts.durations(files.read_contents(found.withColumnRenamed("file_path", "rel_path"), root).select("path", "content"))
    rows = found.join(facts, "file_path", "left").join(lengths, "file_path", "left")
    rows = rows.withColumn("status", F.when(F.col("word_count").isNull(), "failed").otherwise("processed")).withColumn("error_message", F.when(F.col("word_count").isNull(), "no transcript"))
    transcripts.append_index(rows, index)
    incremental.status_counts(spark.read.parquet(index)).show()


def _links(a: argparse.Namespace) -> None:
    spark, out = session(), out_folder(a.out)
    found = incremental.accordion_links(spark.read.parquet(a.pages))
    wanted = incremental.download_links(found)
    placed = incremental.local_path(wanted.join(found, ["link", "page_id", "position"])).withColumnRenamed("link", "url")
    held = tables.load_table(spark, f"{out}/links/manifest", MANIFEST)
    now = fetch.check(placed, held)
    status = incremental.change_status(now.filter("error is null"), held)
    get = status.filter("status in ('new', 'changed')").join(placed, "url").select("url", "local_path")
    done = fetch.download(get, f"{out}/links/files") if not a.dry_run else get.selectExpr("url", "local_path", "cast(null as string) as sha256", "cast(null as string) as error")
    errors = now.select("url", F.col("error").alias("ask_error")).join(done.select("url", "sha256", F.col("error").alias("get_error")), "url", "left")
    state = incremental.run_status(F.coalesce("status", F.lit("changed")), dry_run=a.dry_run, failed=F.coalesce("ask_error", "get_error").isNotNull())
    seen = placed.select("url", "local_path").join(now.select("url", "etag", "last_modified", "content_length"), "url").join(status, "url", "left").join(errors, "url")
    seen = seen.withColumn("status", state).withColumn("last_seen_utc", F.lit(_now()))
    # written beside the old one and read again, so that each address is asked and fetched once
    fresh = ensure_columns(incremental.update_manifest(held, seen), MANIFEST)
    fresh.write.mode("overwrite").parquet(f"{out}/links/manifest_new")
    spark.read.schema(MANIFEST).parquet(f"{out}/links/manifest_new").write.mode("overwrite").parquet(f"{out}/links/manifest")
    incremental.status_counts(spark.read.parquet(f"{out}/links/manifest")).show()


def _self_check(a: argparse.Namespace) -> None:
    for name, path in tables.prepare_folders(session(), out_folder(a.out)).items():
        print(f"{name}: {path}")


def _reconcile(a: argparse.Namespace) -> None:
    spark = session()
    inv = spark.read.parquet(a.inventory)
    inv = inv if "doc_id" in inv.columns else inv.withColumn("doc_id", paths.stable_doc_id(F.col("hash_value"), F.col("rel_path"), F.col("size_bytes"), F.col("modified_time")))
    labels.reconcile_counts(tables.read_csv(spark, a.labels, LABELS), inv).show(truncate=False)


def _query(a: argparse.Namespace) -> None:
    from folioforge.catalogue import QUERIES

    if a.name not in QUERIES:
        raise SystemExit(f"one of: {', '.join(sorted(QUERIES))}")
    QUERIES[a.name](session(), a.tables).show(a.rows, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioforge")
    stages = top.add_subparsers(required=True)
    one = stages.add_parser("inventory").add_subparsers(required=True).add_parser("run")
    one.add_argument("--root", required=True)
    one.add_argument("--out")
    one.add_argument("--hash", choices=files.HASHES, default="none")
    one.add_argument("--sample-bytes", type=int, default=0)
    one.add_argument("--ignore", nargs="*", default=[])
    one.add_argument("--max-files", type=int)
    one.add_argument("--label", default="")
    one.set_defaults(run=_inventory)
    for stage, run in (("probe", _probe), ("text-scan", _text_scan), ("name-index", _name_index)):
        one = stages.add_parser(stage).add_subparsers(required=True).add_parser("run")
        one.add_argument("--pages", required=True)
        one.add_argument("--out")
        one.add_argument("--label", default="")
        if stage != "text-scan":
            one.add_argument("--inventory", default="NONE")
            one.add_argument("--min-total-count", type=int, default=1)
            one.add_argument("--max-names-per-doc", type=int, default=0)
        if stage == "probe":
            at = readiness.Thresholds()
            one.add_argument("--text-threshold", type=int, default=at.page_chars)
            one.add_argument("--doc-text-pct-text", type=float, default=at.text_share)
            one.add_argument("--doc-text-pct-scanned", type=float, default=at.scanned_share)
            one.add_argument("--doc-text-min-chars-per-page", type=float, default=at.average_chars)
            one.add_argument("--only-top-folder", default="")
            one.add_argument("--labels", default="")
            one.add_argument("--model", default="")
            one.add_argument("--features", default="")
            one.add_argument("--min-model-confidence", type=float, default=0.70)
            one.add_argument("--text-scan", action="store_true")
            one.add_argument("--name-index", action="store_true")
        elif stage == "name-index":
            one.add_argument("--probe", default="LATEST")
            one.add_argument("--text-scan", default="LATEST")
            one.add_argument("--all-documents", action="store_true")
        one.set_defaults(run=run)
    one = stages.add_parser("labels").add_subparsers(required=True).add_parser("reconcile")
    one.add_argument("--labels", required=True)
    one.add_argument("--inventory", required=True)
    one.set_defaults(run=_reconcile)
    one = stages.add_parser("public-index").add_subparsers(required=True).add_parser("run")
    for name, given in (("inventory", "LATEST"), ("probe", "LATEST"), ("text-scan", "NONE"), ("out", None)):
        one.add_argument(f"--{name}", default=given)
    one.add_argument("--dest", required=True)
    one.set_defaults(run=_public_index)
    group = stages.add_parser("pdf-type").add_subparsers(required=True)
    for name, run in (("label", _label), ("train", _train_labels), ("predict", _predict_labels), ("migrate", _migrate)):
        one = group.add_parser(name)
        one.add_argument("--inventory", default="LATEST")
        one.add_argument("--labels", required=True)
        one.add_argument("--out")
        one.set_defaults(run=run)
        if name == "label":
            one.add_argument("--rel-path", required=True)
            one.add_argument("--label", required=True)
            one.add_argument("--notes", default="")
            one.add_argument("--overwrite", action="store_true")
        elif name == "train":
            one.add_argument("--exclude-mixed", action="store_true")
        elif name == "predict":
            one.add_argument("--probe", default="LATEST")
        else:
            one.add_argument("--write", action="store_true")
            one.add_argument("--dry-run", action="store_true")
    group = stages.add_parser("doc-type").add_subparsers(required=True)
    for name, run in (("train", _train_model), ("predict", _predict_model), ("queue", _queue)):
        one = group.add_parser(name)
        one.add_argument("--features", required=True)
        one.add_argument("--out")
        one.set_defaults(run=run)
        if name == "train":
            one.add_argument("--eval-split", type=float, default=0.2)
            one.add_argument("--seed", type=int, default=42)
        else:
            one.add_argument("--model", default="LATEST")
            one.add_argument("--selection", default="")
            one.add_argument("--only-unlabeled", action="store_true")
            one.add_argument("--k", type=int, default=50)
    one = stages.add_parser("media").add_subparsers(required=True).add_parser("run")
    one.add_argument("--root", required=True)
    one.add_argument("--segments", required=True)
    one.add_argument("--out")
    one.set_defaults(run=_media)
    one = stages.add_parser("links").add_subparsers(required=True).add_parser("run")
    one.add_argument("--pages", required=True)
    one.add_argument("--out")
    one.add_argument("--dry-run", action="store_true")
    one.set_defaults(run=_links)
    one = stages.add_parser("self-check")
    one.add_argument("--out")
    one.set_defaults(run=_self_check)
    one = stages.add_parser("query")
    one.add_argument("name")
    one.add_argument("--tables", required=True)
    one.add_argument("--rows", type=int, default=20)
    one.set_defaults(run=_query)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
