"""Transcripts of recordings as tables: segments, speaker turns, durations; and the index of recordings."""

from __future__ import annotations

import io
import shutil
import subprocess
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENTS = "file_path string, turn long, start double, end double, role string, text string"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments as a transcriber writes them: JSON lines with file_path, start, end, speaker and text."""
    rows = spark.read.schema("file_path string, start double, end double, speaker string, text string").option("mode", "DROPMALFORMED").json(path)
    order = F.row_number().over(Window.partitionBy("file_path").orderBy("start", "end", "text"))
    return rows.filter("file_path is not null").select("file_path", order.cast("long").alias("turn"), "start", "end", F.col("speaker").alias("role"), "text")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """Speaker turns of RTTM files: recording, start, duration, speaker; lines of other kinds are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter((F.col("p")[0] == "SPEAKER") & (F.size("p") >= 8))
    return rows.select(F.col("p")[1].alias("file_path"), F.col("p")[3].try_cast("double").alias("start"), F.col("p")[4].try_cast("double").alias("duration"), F.col("p")[7].alias("speaker"))


def to_rttm(turns: DataFrame) -> DataFrame:
    """RTTM lines of speaker turns, in order."""
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "file_path", "start", "duration", "speaker")
    return turns.orderBy("file_path", "start", "speaker").select(line.alias("value"))


def speakers(turns: DataFrame) -> DataFrame:
    return turns.groupBy("file_path").agg(F.countDistinct("speaker").alias("num_speakers"), F.round(F.sum("duration"), 3).alias("speech_sec"))


def _seconds(path: str, content: bytes) -> float | None:
    if path.lower().endswith(".wav"):
        try:
            with wave.open(io.BytesIO(content)) as w:
                return w.getnframes() / w.getframerate()
        except (wave.Error, EOFError, ZeroDivisionError):
            return None
    if shutil.which("ffprobe"):
        command = ["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "default=noprint_wrappers=1:nokey=1", "-"]
        found = subprocess.run(command, input=content, capture_output=True, check=False).stdout.strip()
        try:
            return float(found)
        except ValueError:
            return None
    return None


def _durations(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        seconds = [None if c is None else _seconds(p, bytes(c)) for p, c in zip(part["path"], part["content"], strict=True)]
        yield pd.DataFrame({"file_path": part["path"], "duration_sec": pd.Series(seconds, dtype="float64")})


def durations(files: DataFrame) -> DataFrame:
    """files: path and content -> seconds of each recording: of WAV from its header, of others by ffprobe where it
    is installed; null where nothing tells.
    """
    return files.select("path", "content").mapInPandas(_durations, "file_path string, duration_sec double")


#: Columns of the index of recordings.
INDEX = (
    "file_path", "file_name", "sha256", "duration_sec", "language", "word_count", "num_segments", "num_speakers", "top_keywords", "email_count", "phone_count", "date_like_count",
    "transcript_path", "segments_path", "meta_path", "status", "error_message",
)


def append_index(rows: DataFrame, path: str) -> None:
    """Append recordings to the index; columns that they lack are null, others stay behind."""
    texts = {"top_keywords"} & {c for c, kind in rows.dtypes if kind.startswith("array")}
    shown = [F.array_join(c, ", ").alias(c) if c in texts else F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in INDEX]
    rows.select(*shown).write.mode("append").parquet(path)


def unprocessed(found: DataFrame, done: DataFrame, key: str = "file_path") -> DataFrame:
    """What no successful entry of the index covers yet."""
    good = done.filter(F.col("status") == "processed") if "status" in done.columns else done
    return found.join(good.select(key).distinct(), key, "left_anti")


def write_transcripts(segments: DataFrame, path: str) -> None:
    """One row of text and one array of segments for each recording, as JSON lines."""
    each = F.array_sort(F.collect_list(F.struct("turn", "start", "end", "role", "text")))
    segments.groupBy("file_path").agg(F.array_join(F.transform(each, lambda s: F.coalesce(s["text"], F.lit(""))), " ").alias("transcript"), each.alias("segments")).write.mode("overwrite").json(path)
