"""Links of pages, downloads, and what changed since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import incremental
from folioforge.plans.adapters import table

from .registry import query


_ANCHOR = """(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a\\s*>"""
# the pages' links are rooted, absolute or plain; other forms are in url_resolution
_LINKS = f"""WITH h AS (
  SELECT page_id, url, unnest(range(len(l)))::INT AS position, unnest(l) AS a FROM (SELECT page_id, url, regexp_extract_all(html, '{_ANCHOR}', 0) AS l FROM pages)),
parts AS (
  SELECT page_id, url, position, trim(regexp_extract(a, '{_ANCHOR}', 1)) AS href, trim(regexp_replace(regexp_replace(regexp_extract(a, '{_ANCHOR}', 2), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM h),
links AS (
  SELECT page_id, position, text, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href
    ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || href END AS link
  FROM parts WHERE href <> '')
"""
query("html_links", _LINKS + "SELECT * FROM links")(lambda s, d: incremental.links(table(s, d, "pages")))
_FORMS = ("x{id}.pdf?q=a/../b", "../up{id}.pdf", "//o.example/z{id}", "?b={id}", "#part{id}", "/a/./b/../c{id}.pdf#x", "HTTPS://o.example/Z{id}", "./s{id}/..")


def _given(spark: SparkSession, d: str) -> DataFrame:
    """Every page with a link of one of the forms."""
    forms = F.array(*(F.regexp_replace(F.lit(f), r"\{id\}", F.col("page_id").cast("string")) for f in _FORMS))
    return table(spark, d, "pages").select("page_id", "url", F.element_at(forms, (F.col("page_id") % len(_FORMS) + 1).cast("int")).alias("href"))


query(
    "url_resolution",
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS host, regexp_replace(url, '[?#].*$', '') AS doc FROM pages),
f AS (SELECT *, CASE WHEN doc = host THEN '/' ELSE regexp_replace(substr(doc, length(host) + 1), '[^/]*$', '') END AS folder FROM p)
SELECT page_id, CASE page_id % 8 WHEN 0 THEN host || folder || 'x' || page_id || '.pdf?q=a/../b' WHEN 1 THEN host || regexp_replace(folder, '[^/]+/$', '') || 'up' || page_id || '.pdf'
  WHEN 2 THEN split_part(url, ':', 1) || '://o.example/z' || page_id WHEN 3 THEN doc || '?b=' || page_id WHEN 4 THEN regexp_replace(url, '#.*$', '') || '#part' || page_id
  WHEN 5 THEN host || '/a/c' || page_id || '.pdf#x' WHEN 6 THEN 'HTTPS://o.example/Z' || page_id ELSE host || folder END AS link
FROM f""",
)(lambda s, d: _given(s, d).select("page_id", incremental.absolute_url(F.col("href"), F.col("url")).alias("link")))


def _download_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page with an accordion of downloads before what it has, and a plain box that is none."""
    rows = table(spark, d, "pages")
    made = F.format_string(
        """<div class="usa-accordion usa-accordion--bordered"><h4><button class="usa-accordion__button" type="button">Set\n %d</button></h4><div class="usa-accordion__content"><p><a href="/f/%d.pdf?v=1"> Data  Set %d </a><a href="">none</a>
<a name="x">no link</a></p><ul><li><a href="//o.example/a%%20b%d.zip">A <b>plain</b> file</a></ul></div><h4><button class="usa-accordion__button">More / other</button></h4><div class="usa-accordion__content"><a href="https://o.example/d%d.mp4">film</a></div></div>
<div class="usa-accordion"><h4><button class="usa-accordion__button">Plain</button></h4><div class="usa-accordion__content"><a href="e.pdf">e</a></div></div>""",
        "page_id", "page_id", F.col("page_id") % 30, "page_id", "page_id",
    )
    return rows.select("page_id", "url", F.concat(made, F.coalesce("html", F.lit(""))).alias("html"))


query(
    "accordion_links",
    """WITH p AS (SELECT page_id, page_id::VARCHAR AS id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS host, split_part(url, ':', 1) AS scheme, lpad((page_id % 30)::VARCHAR, 5, '0') AS volume, page_id % 30 AS n FROM pages)
SELECT page_id, 0::INT AS position, 'Set ' || id AS heading, 'Data Set ' || n AS text, host || '/f/' || id || '.pdf?v=1' AS link, 'Set ' || id || '/VOL' || volume || '/' || id || '.pdf' AS local_path FROM p
UNION ALL SELECT page_id, 1, 'Set ' || id, 'Aplainfile', scheme || '://o.example/a%20b' || id || '.zip', 'Set ' || id || '/a b' || id || '.zip' FROM p
UNION ALL SELECT page_id, 2, 'More / other', 'film', 'https://o.example/d' || id || '.mp4', 'More _ other/d' || id || '.mp4' FROM p""",
)(lambda s, d: incremental.local_path(incremental.accordion_links(_download_pages(s, d))))


def _typed_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the pages, made downloads by the length of their text."""
    kind = F.pmod(F.length("text"), F.lit(3))
    ending = F.when(kind == 0, ".PDF").when(kind == 1, ".zip?x=1").otherwise(".htm")
    return incremental.links(table(spark, d, "pages")).withColumn("link", F.concat("link", ending))


query(
    "link_filter",
    _LINKS
    + """, t AS (
  SELECT page_id, position, link || CASE length(text) % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.zip?x=1' ELSE '.htm' END AS link FROM links)
SELECT link, arg_min(page_id, (page_id, position)) AS page_id, arg_min(position, (page_id, position)) AS position FROM t WHERE NOT ends_with(link, '.htm') GROUP BY 1""",
)(lambda s, d: incremental.download_links(_typed_links(s, d)))


def current(spark: SparkSession, d: str) -> DataFrame:
    """What the server says of each address: some have no etag, some no date, some answer that nothing changed."""
    size = F.length("html").cast("long")
    rows = table(spark, d, "pages").groupBy("url").agg(F.max("page_id").alias("page_id"), F.max(size).alias("n"))
    return rows.select(
        "url", F.when(F.col("page_id") % 5 != 0, F.md5(F.col("n").cast("string").cast("binary"))).alias("etag"), F.when(F.col("page_id") % 3 != 0, F.lit("Mon")).alias("last_modified"),
        F.col("n").alias("content_length"), F.when(F.col("page_id") % 13 == 0, 304).otherwise(200).alias("status_code"), "page_id",
    )


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """What was known of them: secure addresses only, with other etags, dates and lengths for some."""
    rows = current(spark, d).filter("url like 'https:%'")
    return rows.select(
        "url", F.when(F.col("page_id") % 4 == 0, "old").otherwise(F.col("etag")).alias("etag"), F.when(F.col("page_id") % 2 == 0, "Mon").otherwise("Tue").alias("last_modified"),
        (F.col("content_length") + F.when(F.col("page_id") % 9 < 5, 1).otherwise(0)).alias("content_length"), F.lit("old/place").alias("local_path"), F.lit("downloaded").alias("status"),
    )


DIFF = """WITH c AS (
  SELECT url, CASE WHEN p % 5 <> 0 THEN md5(n::VARCHAR) END AS etag, CASE WHEN p % 3 <> 0 THEN 'Mon' END AS lm, n, p, CASE WHEN p % 13 = 0 THEN 304 ELSE 200 END AS code
  FROM (SELECT url, max(page_id) AS p, max(length(html)) AS n FROM pages GROUP BY 1)),
m AS (
  SELECT url, CASE WHEN p % 4 = 0 THEN 'old' ELSE etag END AS e2, CASE WHEN p % 2 = 0 THEN 'Mon' ELSE 'Tue' END AS l2, n + CASE WHEN p % 9 < 5 THEN 1 ELSE 0 END AS n2, true AS known FROM c WHERE url LIKE 'https:%'),
diff AS (
  SELECT *, CASE WHEN code = 304 THEN 'skipped_304' WHEN known IS NULL THEN 'new' WHEN etag = e2 THEN 'skipped_etag' WHEN lm = l2 THEN 'skipped_last_modified' WHEN n = n2 THEN 'skipped_length'
    ELSE 'changed' END AS status
  FROM c LEFT JOIN m USING (url))
"""


def _status(spark: SparkSession, d: str) -> DataFrame:
    return incremental.change_status(current(spark, d), manifest(spark, d))


def _updated(spark: SparkSession, d: str) -> DataFrame:
    seen = current(spark, d).drop("page_id", "status_code").join(_status(spark, d), "url").withColumn("status", incremental.run_status(F.col("status")))
    return incremental.update_manifest(manifest(spark, d), seen)


query("manifest_diff", DIFF + "SELECT url, status FROM diff")(_status)
query("manifest_status_counts", DIFF + "SELECT status, count(*) AS n FROM diff GROUP BY 1")(lambda s, d: incremental.status_counts(_status(s, d)))
query(
    "manifest_update",
    DIFF
    + """SELECT url, coalesce(etag, e2) AS etag, coalesce(lm, l2) AS last_modified, n AS content_length, CASE WHEN known THEN 'old/place' END AS local_path,
    CASE WHEN starts_with(status, 'skipped') THEN 'skipped' ELSE 'downloaded' END AS status
  FROM diff""",
)(_updated)


def _archives(s: SparkSession, d: str, shift: int) -> DataFrame:
    members = table(s, d, "pages").select((F.col("page_id") % 20).cast("string").alias("archive"), F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 6, "0")).alias("member"), (F.length("html") % 7 + 1 + F.when(F.col("page_id") % 50 == 0, shift).otherwise(0)).cast("long").alias("pages"))
    return incremental.archive_pages(members)


_ARCH = """WITH mem AS (SELECT (page_id % 20)::VARCHAR AS archive, 'p' || lpad(page_id::VARCHAR, 6, '0') AS member, length(html) % 7 + 1 AS pg, CASE WHEN page_id % 50 = 0 THEN 3 ELSE 0 END AS add
  FROM pages),
arch AS (SELECT archive, count(*) AS pdf_count, sum(pg)::BIGINT AS total_pages, string_agg(member || '=' || pg, ','
  ORDER BY member) AS per_pdf, sum(pg + add)::BIGINT AS new_pages, sum(add) AS added
  FROM mem
  GROUP BY 1) """
query("archive_pages", _ARCH + "SELECT archive, pdf_count, total_pages, per_pdf FROM arch")(
    lambda s, d: _archives(s, d, 0),
)
query("page_count_changes", _ARCH + "SELECT archive, total_pages AS old_pages, new_pages FROM arch WHERE added > 0")(
    lambda s, d: incremental.page_count_changes(_archives(s, d, 3), _archives(s, d, 0)),
)
