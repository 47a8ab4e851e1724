"""File trees made of the tables: a file, or a member of an archive, for each document or recording.

Names and folders are of all kinds that an inventory meets: hidden ones, ones with signs, ones that are ignored,
archives good and broken, links that lead nowhere. Where everything lies follows from ids alone, so that SQL knows it too.
"""

from __future__ import annotations

import io
import struct
import uuid
import wave
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import staging
from folioforge.sources.storage import store

from .adapters import table

_TREES: dict[tuple[str, str, str], str] = {}


def archive(members: list[tuple[str, bytes]], *, bad_date: str = "", packed: bool = True) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED) as z:
        for name, content in members:
            info = zipfile.ZipInfo(name, (2024, 5, 6, 7, 8, 10))
            info.compress_type = z.compression
            z.writestr(info, content)
    data = out.getvalue()
    if bad_date:  # month 15 of the member's entry in the central directory
        at = data.rindex(bad_date.encode()) - 46
        data = data[: at + 14] + struct.pack("<H", (44 << 9) | (15 << 5) | 1) + data[at + 16 :]
    return data


def wav(frames: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(1000)
        w.writeframes(bytes(frames))
    return out.getvalue()


def _written(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, content in zip(*batch.columns, strict=True):  # one by one: of a batch's files a second copy is never held
                if content.is_valid:
                    store(root).write(rel.as_py(), content.as_py())
                else:
                    store(root).link(rel.as_py(), "nowhere")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return run


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    """One archive of its members, in order of name."""
    ordered = group.sort_values("member")
    content = archive([(m, bytes(c)) for m, c in zip(ordered["member"], ordered["content"], strict=True)])
    return pd.DataFrame({"rel_path": [group["archive"].iloc[0]], "content": [content]})


def write_tree(files: DataFrame, root: str) -> None:
    """files: rel_path, archive (null for a plain file), member and content (null for a link that leads nowhere)."""
    packed = files.filter("archive is not null").groupBy("archive").applyInPandas(_packed, "rel_path string, content binary")
    files.filter("archive is null").select("rel_path", "content").unionByName(packed).mapInArrow(_written(root), "n long").agg(F.sum("n")).collect()


def _made(spark: SparkSession, sf_dir: str, kind: str, files) -> str:
    """The root of a tree, which is written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _TREES:
        root = f"{staging.working_folder(spark)}/trees/{uuid.uuid4().hex}"
        write_tree(files(spark, sf_dir), root)
        _TREES[key] = root
    return _TREES[key]


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "coalesce(text, '') as text", "doc_id % 10 as k", "concat('VOL0000', doc_id % 3 + 1) as volume",
        "element_at(array('', '_sub/deep/', '.hidden/', 'sub dir é/', '~$cache/', 'a/b/c/', ''), cast(doc_id % 7 as int) + 1) as folder", "sha2(coalesce(text, ''), 256) as sha",
    )
    name = F.expr("element_at(array(concat('_notes', doc_id, '.txt'), concat('.env', doc_id), concat('100% a%20b+c ', doc_id, '.TXT'), concat('[x]', doc_id, '.md'), concat('~$lock', doc_id, '.docx'), concat(doc_id, '.csv'), concat(doc_id, '.pgm'), '', '', concat(doc_id, '.zip')), cast(k as int) + 1)")
    image = F.concat(F.encode(F.lit("P5\n# a page\n4 3\n255\n"), "UTF-8"), F.unhex(F.substring("sha", 1, 24)), F.encode(F.lit("P5\n2 2\n255\n"), "UTF-8"), F.unhex(F.substring("sha", 25, 8)))
    content = F.when(F.col("k") == 6, image).when(F.col("k") == 2, F.encode(F.translate("text", "\n", "\f"), "UTF-8")).otherwise(F.encode("text", "UTF-8"))
    inside = F.col("k").isin(7, 8)
    files = docs.select(
        F.when(~inside, F.concat("volume", F.lit("/"), "folder", name)).alias("rel_path"), F.when(inside, F.expr("concat(volume, '/pack', doc_id div 60, '.zip')")).alias("archive"),
        F.when(inside, F.expr("concat('inner', k, '/', doc_id, '.txt')")).alias("member"), content.alias("content"),
    )
    gone = docs.filter("doc_id % 50 = 49").select(F.expr("concat(volume, '/lost', doc_id)").alias("rel_path"), *(F.lit(None).cast("string").alias(c) for c in ("archive", "member")), F.lit(None).cast("binary").alias("content"))
    return files.unionByName(gone)


def document_tree(spark: SparkSession, sf_dir: str) -> str:
    """A tree of all documents; returns its root."""
    return _made(spark, sf_dir, "documents", _document_files)


#: Where each document lies: ``path`` of the file, archive or member, ``k`` its kind, ``content`` as text.
DOCUMENT_TREE = """WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, doc_id % 10 AS k, 'VOL0000' || (doc_id % 3 + 1) AS volume, ['', '_sub/deep/', '.hidden/', 'sub dir é/', '~$cache/', 'a/b/c/', ''][doc_id % 7 + 1] AS folder FROM documents),
plain AS (
  SELECT *, volume || '/' || folder || ['_notes' || doc_id || '.txt', '.env' || doc_id, '100% a%20b+c ' || doc_id || '.TXT', '[x]' || doc_id || '.md', '~$lock' || doc_id || '.docx', doc_id || '.csv', doc_id || '.pgm', '', '', doc_id || '.zip'][k + 1] AS path,
    ['txt', '', 'txt', 'md', 'docx', 'csv', 'pgm', '', '', 'zip'][k + 1] AS ext, CASE k WHEN 2 THEN replace(text, chr(10), chr(12)) ELSE text END AS content
  FROM d WHERE k NOT IN (7, 8)),
files AS (SELECT * FROM plain WHERE k <> 4 AND folder <> '~$cache/'),
members AS (SELECT *, volume || '/pack' || doc_id // 60 || '.zip' AS archive, 'inner' || k || '/' || doc_id || '.txt' AS member FROM d WHERE k IN (7, 8)),
inventory AS (
  SELECT path, volume, ext, CASE k WHEN 6 THEN 47 ELSE octet_length(encode(content)) END AS size, NULL AS member_time FROM files
  UNION ALL SELECT DISTINCT archive, volume, 'zip', NULL, NULL FROM members
  UNION ALL SELECT archive || '::' || member, volume, 'txt', octet_length(encode(text)), '2024-05-06T07:08:10+00:00' FROM members)
"""


def _call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "length(coalesce(text, '')) as frames", "turn % 2 = 1 as inside")
    recorded = F.pandas_udf(lambda frames: frames.map(wav), "binary")
    return calls.select(
        F.expr("if(inside, null, concat('calls/', conv_id, '/turn ', turn, '.wav'))").alias("rel_path"), F.expr("if(inside, concat('calls/more', conv_id, '.zip'), null)").alias("archive"),
        F.expr("if(inside, concat('t', turn, '.wav'), null)").alias("member"), recorded("frames").alias("content"),
    )


def call_tree(spark: SparkSession, sf_dir: str) -> str:
    """A tree of recordings: one for each turn of a conversation, a millisecond for each character of it."""
    return _made(spark, sf_dir, "conversations", _call_files)
