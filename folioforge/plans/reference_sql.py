"""DuckDB SQL for the engine's queries, written apart from the DataFrame code."""

from __future__ import annotations

from folioforge.functions.rules import CATEGORIES, RULES

from .adapters import with_tables

W = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\p{Z}"
B = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A[{W}]+|[{W}]+\\z', '', 'g')"


_LINES = f"CASE WHEN text = '' THEN [] WHEN regexp_matches(text, '({B})\\z') THEN regexp_split_to_array(text, '{B}')[:-2] ELSE regexp_split_to_array(text, '{B}') END"

READY = (
    with_tables("docs", "pages")
    + f""", rpages AS (SELECT doc_id, rel_path, page_num, length({_strip("text")})::INT AS text_char_count, length({_strip("text")}) >= 25 AS has_text FROM pages),
rdocs AS (SELECT doc_id, rel_path, count(*) AS page_count, count(*) FILTER (WHERE has_text) AS pages_with_text, sum(text_char_count)::BIGINT AS total_text_chars,
  round(sum(text_char_count) / count(*), 6) AS avg_text_chars_per_page, round(count(*) FILTER (WHERE has_text) / count(*), 6) AS text_coverage_pct,
  CASE WHEN count(*) FILTER (WHERE has_text) / count(*) >= 0.5 AND sum(text_char_count) / count(*) >= 200 THEN 'Text-based' WHEN count(*) FILTER (WHERE has_text) / count(*) < 0.1 THEN 'Scanned' ELSE 'Mixed' END AS classification
  FROM rpages GROUP BY ALL)
"""
)


#: The pages that a scan reads: those with text, or all of a document without such a page.
SCAN = f""", scan AS (SELECT * FROM (SELECT *, length({_strip("text")}) >= 25 AS has_text, bool_or(length({_strip("text")}) >= 25) OVER (PARTITION BY doc_id) AS any_text FROM pages) WHERE text <> '' AND (has_text OR NOT any_text))"""


#: All pages that are not empty, for scans of every page.
EVERY_PAGE = ", scan AS (SELECT * FROM pages WHERE text <> '')"


def quality(run: int, scan: str = SCAN) -> str:
    marks = "!@#$%^&*()_+-=[]{}|;:,.<>?/~`\"\\"
    patterns = "|".join("".join(["[", "\\" if c in "\\]^-[" else "", c, "]"]) + f"{{{run},}}" for c in marks)
    return (
        with_tables("docs", "pages")
        + scan
        + f""", p AS (SELECT doc_id, length(text) AS chars, {_n(f"[^{W}]+")} AS words, {_n(chr(92) + "p{L}")} AS letters, {_n("[" + chr(92) + "p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]")} AS digits,
  {_n(f"[^{W}]")} AS solid, {_n(r"[^\p{C}\p{Z}]|\x20")} AS printable, {_n(r"\x{fffd}")} AS replaced, {_n(f"[^{W}]")} - {_n(r"[^\p{C}\p{Z}]")} AS control,
  list_sum(list_transform(regexp_extract_all(text, '{patterns}'), lambda r: length(r))) AS runs, list_transform({_LINES}, lambda l: length({_strip("l")})) AS lens, list_distinct(string_split(text, '')) AS kinds FROM scan),
s AS (SELECT doc_id, count(*) AS pages, sum(chars) AS chars, sum(words) AS words, sum(letters) AS letters, sum(digits) AS digits, sum(solid) AS solid, sum(printable) AS printable, sum(replaced) AS replaced,
  sum(control) AS control, coalesce(sum(runs), 0) AS runs, sum(len(lens)) AS lines, coalesce(sum(list_sum(lens)), 0) AS line_chars, coalesce(sum(list_sum(list_transform(lens, lambda l: l * l))), 0) AS line_squares,
  len(list_distinct(flatten(list(kinds)))) AS kinds FROM p GROUP BY doc_id),
r AS (SELECT *, coalesce(letters / nullif(solid, 0), 0) AS a, coalesce(digits / nullif(solid, 0), 0) AS d, printable / chars AS pr, runs / chars AS rr, line_chars / lines AS ml FROM s),
g AS (SELECT *, least((CASE WHEN a < 0.45 THEN 0.35::DOUBLE ELSE 0 END) + (CASE WHEN pr < 0.95 THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN words < 30 AND chars >= 50 THEN 0.15::DOUBLE ELSE 0 END)
  + (CASE WHEN coalesce(greatest(solid - trunc(a * solid) - trunc(d * solid), 0) / nullif(solid, 0), 0) > 0.45 THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN replaced > 0 THEN 0.1::DOUBLE ELSE 0 END)
  + (CASE WHEN control > 0 THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN rr >= 0.12 THEN 0.15::DOUBLE ELSE 0 END), 1) AS gib FROM r),
quality AS (SELECT doc_id, pages AS text_pages, chars::BIGINT AS total_chars, words::BIGINT AS total_words, round(chars / pages, 6) AS avg_chars_per_text_page, round(words / pages, 6) AS avg_words_per_text_page,
  round(a, 6) AS alpha_ratio, round(d, 6) AS digit_ratio, round(pr, 6) AS printable_ratio, round(kinds / chars, 6) AS unique_char_ratio, round(ml, 6) AS avg_line_len,
  round(sqrt(greatest(line_squares / lines - ml * ml, 0)), 6) AS std_line_len, round(rr, 6) AS repeated_run_score, round(gib, 6) AS gibberish_score,
  round(least(greatest((0.5::DOUBLE * a + 0.3::DOUBLE * pr + 0.2::DOUBLE * least(words / 200, 1)) * (1 - gib), 0), 1), 6) AS text_quality_score, control::BIGINT AS control_char_count, replaced::BIGINT AS replacement_char_count,
  CASE WHEN chars < 50 OR words < 10 THEN 'EMPTY' WHEN gib >= 0.6 OR a < 0.45 OR pr < 0.95 THEN 'LOW' ELSE 'GOOD' END AS text_quality_label FROM g)
"""
    )


def _re2(pattern: str) -> str:
    """A rule's pattern in RE2: Unicode digits, spaces and word edges are spelled out or ASCII (the test texts' rules meet ASCII only)."""
    return pattern.replace("'", "''")


_HIT_COLUMNS = ",\n".join(f"sum(len(regexp_extract_all(text, '{_re2(p)}')))::BIGINT AS {c}__{r}" for c, r, p in RULES)


def hits(scan: str = SCAN) -> str:
    return f"""{scan.replace("scan AS", "hit_pages AS", 1)}, src AS (SELECT doc_id, text FROM hit_pages UNION ALL SELECT * FROM fixture), hits AS (SELECT doc_id, sum(len({_LINES}))::BIGINT AS line_count, {_HIT_COLUMNS} FROM src GROUP BY doc_id)"""


HITS = hits()


def _total(category: str) -> str:
    return " + ".join(f"{c}__{r}" for c, r, _ in RULES if c == category)


_DENSITY = "greatest(CONTACT_LIST__email_address / line_count, CONTACT_LIST__phone_number / line_count)"
_SCORES = {k: f"({_total(k)})::DOUBLE" for k in CATEGORIES}
_SCORES["CONTACT_LIST"] += f" + CASE WHEN {_DENSITY} > 0.3 THEN 3 WHEN {_DENSITY} > 0.15 THEN 1.5 ELSE 0 END"
_SCORES["FORM_TEMPLATE"] += " + CASE WHEN FORM_TEMPLATE__underscore_blank >= 5 THEN 2 WHEN FORM_TEMPLATE__underscore_blank > 0 THEN 0.5 ELSE 0 END"
TYPES = f""", scored AS (SELECT doc_id, {", ".join(f"{e} AS {k}" for k, e in _SCORES.items())} FROM hits),
types AS (SELECT doc_id, CASE WHEN greatest({", ".join(CATEGORIES)}) = 0 THEN 'OTHER_TEXT' {" ".join(f"WHEN {k} = greatest({', '.join(CATEGORIES)}) THEN '{k}'" for k in CATEGORIES)} END AS content_type_pred,
  CASE WHEN greatest({", ".join(CATEGORIES)}) = 0 THEN 0 ELSE round(greatest({", ".join(CATEGORIES)}) / ({" + ".join(CATEGORIES)}), 6) END AS content_type_confidence FROM scored)"""

_BY_CATEGORY = ", ".join("'" + k + "': {" + ", ".join(f"'{r}': {k}__{r}" for r in sorted(r for c, r, _ in RULES if c == k)) + "}" for k in sorted(CATEGORIES))
SIGNALS_JSON = f"""SELECT doc_id, to_json({{'rule_hits': {{{_BY_CATEGORY}}}, 'stats': {{'email_address_count': CONTACT_LIST__email_address, 'line_count': line_count,
  'phone_number_count': CONTACT_LIST__phone_number, 'underscore_runs': FORM_TEMPLATE__underscore_blank}}}})::VARCHAR AS content_type_signals FROM hits"""

NO_FIXTURE = ", fixture(doc_id, text) AS (SELECT 0::BIGINT, '' WHERE false)"

_TOKEN = "[A-Z][A-Za-z]*(?:[''’\\-][A-Za-z]+)*"
_MIDDLE = "[A-Z](?:\\.)?"
_SUFFIX = "(?:Jr|Sr|II|III)\\.?"
_FIRST = f"\\b({_TOKEN})\\s+(?:({_MIDDLE})\\s+)?({_TOKEN})(?:,?\\s+({_SUFFIX}))?\\b"
_LAST = f"\\b({_TOKEN})\\s*,\\s*({_TOKEN})(?:\\s+({_MIDDLE}))?(?:\\s+({_SUFFIX}))?\\b"
_STOP = "('january','february','march','april','may','june','july','august','september','october','november','december','monday','tuesday','wednesday','thursday','friday','saturday','sunday','united','states','state','department','court')"


def _clean(x: str) -> str:
    return f"lower(regexp_replace(translate({x}, '’‘‛“”–—', '''''''\"\"--'), '[^A-Za-z''-]', '', 'g'))"


# RE2's word edges are ASCII: other letters become "_", which is a word character without case.
NAMES = (
    with_tables("docs", "pages")
    + f""", ln AS (SELECT doc_id, rel_path, page_num, unnest(range(len({_LINES}))) AS line_no, regexp_replace(unnest({_LINES}), '[^\\x00-\\x7F’]', '_', 'g') AS line FROM pages),
ok AS (SELECT * FROM ln WHERE {_strip("line")} <> '' AND NOT (len(regexp_split_to_array({_strip("line")}, '[{W}]+')) > 2 AND NOT regexp_matches(line, '[a-z_]'))),
mm AS (SELECT *, 0 AS pat, regexp_extract_all(line, '{_LAST}') AS ms FROM ok UNION ALL SELECT *, 1, regexp_extract_all(line, '{_FIRST}') FROM ok),
m1 AS (SELECT doc_id, rel_path, page_num, line_no, pat, unnest(range(len(ms))) AS place, unnest(ms) AS m FROM mm),
m2 AS (SELECT *, CASE pat WHEN 0 THEN regexp_extract(m, '^{_LAST}', 2) ELSE regexp_extract(m, '^{_FIRST}', 1) END AS fi, CASE pat WHEN 0 THEN regexp_extract(m, '^{_LAST}', 1) ELSE regexp_extract(m, '^{_FIRST}', 3) END AS la,
  CASE pat WHEN 0 THEN regexp_extract(m, '^{_LAST}', 3) ELSE regexp_extract(m, '^{_FIRST}', 2) END AS mi, CASE pat WHEN 0 THEN regexp_extract(m, '^{_LAST}', 4) ELSE regexp_extract(m, '^{_FIRST}', 4) END AS su FROM m1),
m3 AS (SELECT *, {_clean("fi")} AS f, {_clean("la")} AS l, {_clean("mi")}[1] AS md FROM m2),
mentions AS (SELECT doc_id, rel_path, page_num, (page_num, line_no, pat, place) AS pos, l || '|' || f AS canonical_key,
  array_to_string(list_filter([fi, CASE WHEN rtrim(mi, '.') <> '' THEN rtrim(mi, '.') || '.' END, la, nullif(rtrim(su, '.'), '')], lambda x: x IS NOT NULL), ' ') AS display,
  list_sort(list_distinct(list_filter([f || ' ' || l, l || ' ' || f, l || ', ' || f, CASE WHEN md <> '' THEN f || ' ' || md || ' ' || l END], lambda x: x IS NOT NULL))) AS variants
  FROM m3 WHERE length(f) >= 2 AND length(l) >= 2 AND f NOT IN {_STOP} AND l NOT IN {_STOP}),
dd AS (SELECT canonical_key, doc_id, rel_path, count(*) AS n, coalesce(arg_min(display, pos) FILTER (WHERE display <> upper(display)), arg_min(display, pos)) AS display, coalesce(arg_min(variants, pos) FILTER (WHERE display <> upper(display)), arg_min(variants, pos)) AS variants FROM mentions GROUP BY ALL),
idx AS (SELECT canonical_key, coalesce(arg_min(display, (rel_path, doc_id, display)) FILTER (WHERE display <> upper(display)), arg_min(display, (rel_path, doc_id, display))) AS display_name, list_sort(list_distinct(flatten(list(variants)))) AS variants, sum(n)::BIGINT AS total_count, count(*) AS docs FROM dd GROUP BY 1)
"""
)
