"""Fixed table schemas; missing columns are added as nulls instead of being inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    out = T.StructType()
    for part in spec.split(","):
        name, kind = part.split()
        out.add(name, {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}[kind])
    return out


INVENTORY = _schema(
    "file_id string, rel_path string, abs_path string, top_level_folder string, extension string, detected_mime string, "
    "size_bytes long, created_time string, modified_time string, hash_value string, sample_hash string"
)
PAGES = _schema("probe_run_id string, doc_id string, rel_path string, abs_path string, top_level_folder string, page_num int, text_char_count int, has_text boolean")
LABELS = _schema(
    "rel_path string, label_raw string, label_norm string, labeled_at string, notes string, source_inventory_run string, source_probe_run string, "
    "sha256_at_label_time string, doc_id_at_label_time string, labeling_version string"
)
RUNS = _schema("stage string, run_id string, source_root string, ts timestamp, path string")
MANIFEST = _schema("url string, local_path string, last_seen_utc string, etag string, last_modified string, content_length long, sha256 string, page_count long, status string")


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with every column of the schema, cast to its type (what cannot be cast is null); extra columns stay behind."""
    have = {c.lower(): c for c in df.columns}
    columns = []
    for field in schema:
        if field.name.lower() in have:
            columns.append(F.col(f"`{have[field.name.lower()]}`").try_cast(field.dataType).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*columns)
