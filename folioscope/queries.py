"""The queries over the catalogue's tables and their SQL.

Rows delivered again count once: of the rows of one file the one loaded last (:func:`latest`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import catalog as c

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: The catalogue, extracts and labels with each delivery counted once.
_WITH = (
    "WITH cat AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC NULLS LAST, scanned_at DESC NULLS LAST) AS rn FROM file_catalog) WHERE rn = 1),"
    " ext AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY extracted_at DESC NULLS LAST) AS rn FROM file_extract) WHERE rn = 1) "
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.latest(table(spark, sf_dir, "file_catalog"))


def ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.latest(table(spark, sf_dir, "file_extract"), by=("extracted_at",))


def query(sql: str | None = None, plain: bool = False) -> Callable:
    """Registers a query under its function's name.  sql: over cat and ext where not plain."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql if plain else _WITH + sql
        return f

    return put


def on_catalog(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """Registers a query that is one function of the catalogue."""
    _QUERIES[name] = lambda spark, sf_dir: f(cat(spark, sf_dir))
    _SQL[name] = _WITH + sql


# ---- deliveries and exact duplicates

on_catalog("latest_catalog", lambda d: d.select("file_id", "path", "department", "size"), "SELECT file_id, path, department, size FROM cat")
on_catalog("dup_groups", lambda d: d.filter("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n")).filter("n > 1"), "SELECT sha256, count(*) AS n FROM cat WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
_SCORE = "(CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)\\b(copy|kopie|duplicate)\\b|\\([0-9]+\\)') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(path, '(?i)(^|/)(downloads?|desktop|tmp|temp|old[^/]*|misc|archive|backup|unsorted)(/|$)') THEN 2 ELSE 0 END)"
on_catalog("copy_scores", lambda d: d.select("file_id", c.copy_score("path").alias("score")), f"SELECT file_id, {_SCORE} AS score FROM cat")
_RANKED = f"ranked AS (SELECT *, first_value(file_id) OVER w AS original_id, first_value(path) OVER w AS original_path FROM cat WINDOW w AS (PARTITION BY coalesce(sha256, 'none' || file_id) ORDER BY {_SCORE}, path, file_id))"
_WITH_RANKED = _WITH.rstrip() + ", " + _RANKED + " "
on_catalog("dup_originals", lambda d: c.with_original(d).select("file_id", "original_id", "original_path"), "")
_SQL["dup_originals"] = _WITH_RANKED + "SELECT file_id, original_id, original_path FROM ranked"
on_catalog("dup_split", lambda d: c.with_original(d).groupBy((F.col("file_id") == F.col("original_id")).alias("original")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "")
_SQL["dup_split"] = _WITH_RANKED + "SELECT file_id = original_id AS original, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ranked GROUP BY 1"
on_catalog("dup_records", lambda d: c.with_original_record(d, ["department", "doc_type", "sensitivity"]).select("file_id", "original_id", "duplicate_of", "department", "doc_type", "sensitivity", "review"), "")
_SQL["dup_records"] = _WITH_RANKED + "SELECT r.file_id, r.original_id, r.original_path AS duplicate_of, o.department, o.doc_type, o.sensitivity, false AS review FROM ranked r JOIN cat o ON o.file_id = r.original_id WHERE r.file_id <> r.original_id"

# ---- predicates

_LIVE = "duplicate_of IS NULL AND NOT coalesce(noise, false)"
_PII = "(coalesce(flags.personal_data, 0) >= 0.5 OR coalesce(len(pii_columns), 0) > 0)"
for _name, _args, _where in (
    ("query_department", {"department": "finance"}, "department = 'finance'"),
    ("query_type", {"doc_type": "dataset"}, "doc_type = 'dataset'"),
    ("query_sensitivity", {"sensitivity": "restricted"}, "sensitivity = 'restricted'"),
    ("query_tag", {"tag": "pricing"}, "coalesce(list_contains(tags, 'pricing'), false)"),
    ("query_year", {"year": 2025}, "starts_with(coalesce(doc_date, ''), '2025')"),
    ("query_month", {"year": "2025-03"}, "starts_with(coalesce(doc_date, ''), '2025-03')"),
    ("query_counterparty", {"counterparty": "MASCHINENBAU"}, "contains(lower(coalesce(counterparty, '')), 'maschinenbau')"),
    ("query_text", {"text": "Minutes"}, "contains(lower(coalesce(path, '') || ' ' || coalesce(title, '') || ' ' || coalesce(counterparty, '')), 'minutes')"),
    ("query_review", {"review": True}, "coalesce(review, false)"),
    ("query_pii", {"pii": True}, _PII),
    ("query_combined", {"department": "hr", "sensitivity": "restricted", "pii": True, "year": "202"}, f"department = 'hr' AND sensitivity = 'restricted' AND {_PII} AND starts_with(coalesce(doc_date, ''), '202')"),
    ("query_default", {}, "true"),
):
    on_catalog(_name, lambda d, a=_args: c.selected(d, **a).select("file_id", "path"), f"SELECT file_id, path FROM cat WHERE {_LIVE} AND {_where}")
on_catalog("query_with_duplicates", lambda d: c.selected(d, include_duplicates=True).select("file_id", "path"), "SELECT file_id, path FROM cat WHERE NOT coalesce(noise, false)")
on_catalog("query_with_noise", lambda d: c.selected(d, include_noise=True).select("file_id", "path"), "SELECT file_id, path FROM cat WHERE duplicate_of IS NULL")
on_catalog("query_first_50", lambda d: c.selected(d, limit=50).select("file_id", "path"), f"SELECT file_id, path FROM cat WHERE {_LIVE} ORDER BY path LIMIT 50")
on_catalog("live_files", lambda d: d.filter(c.live()).select("file_id"), f"SELECT file_id FROM cat WHERE {_LIVE}")
on_catalog("sorted_paths", lambda d: d.select("path").orderBy(F.collate("path", "UNICODE")), "SELECT path FROM cat")

# ---- summaries, listings, report

on_catalog(
    "summary_counts", c.summary,
    f"SELECT count(*) AS files, count(*) FILTER ({_LIVE} AND NOT coalesce(review, false)) AS filed, count(*) FILTER ({_LIVE} AND coalesce(review, false)) AS needs_review, count(*) FILTER ({_LIVE} AND sensitivity = 'restricted') AS restricted,"
    " count(*) FILTER (duplicate_of IS NOT NULL) AS duplicates, count(*) FILTER (duplicate_of IS NULL AND coalesce(noise, false)) AS noise, count(*) FILTER (extract_error IS NOT NULL) AS failed FROM cat",
)
on_catalog("dept_overview", lambda d: c.grouped(d.filter(c.live()), "department"), f"SELECT coalesce(department, 'unclassified') AS value, count(*) AS n FROM cat WHERE {_LIVE} GROUP BY 1")
on_catalog("type_overview", lambda d: c.grouped(d.filter(c.live()), "doc_type"), f"SELECT coalesce(doc_type, 'unclassified') AS value, count(*) AS n FROM cat WHERE {_LIVE} GROUP BY 1")
on_catalog(
    "dept_top_types", lambda d: c.top_types(d.filter(c.live())),
    f"SELECT department, CAST(sum(n) AS BIGINT) AS n, string_agg(doc_type || ' (' || n || ')', ', ' ORDER BY n DESC, doc_type) FILTER (k <= 4) AS types FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY n DESC, doc_type) AS k FROM"
    f" (SELECT coalesce(department, 'unclassified') AS department, coalesce(doc_type, 'other') AS doc_type, count(*) AS n FROM cat WHERE {_LIVE} GROUP BY 1, 2)) GROUP BY 1",
)
on_catalog(
    "listing_top60", lambda d: c.listing(d.filter(c.live())),
    "SELECT department, doc_type, doc_date, file_name, file_id, CAST(place AS INT) AS place, greatest(n - 60, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY department, doc_type ORDER BY doc_date DESC, file_name, file_id) AS place, count(*) OVER (PARTITION BY department, doc_type) AS n FROM"
    f" (SELECT coalesce(department, 'unclassified') AS department, coalesce(doc_type, 'other') AS doc_type, coalesce(doc_date, '') AS doc_date, file_name, file_id FROM cat WHERE {_LIVE})) WHERE place <= 60",
)
for _name, _where in (("review", f"{_LIVE} AND coalesce(review, false)"), ("restricted", f"{_LIVE} AND sensitivity = 'restricted'"), ("duplicates", "duplicate_of IS NOT NULL"), ("noise", "duplicate_of IS NULL AND coalesce(noise, false)")):
    on_catalog(f"section_{_name}", lambda d, n=_name: c.section(d, n).select("file_id", "path"), f"SELECT file_id, path FROM cat WHERE {_where} ORDER BY path, file_id LIMIT 200")
on_catalog(
    "report_tiles", c.tiles,
    f"SELECT count(*) AS files, count(*) FILTER ({_LIVE}) AS live, count(DISTINCT department) + max(CASE WHEN department IS NULL THEN 1 ELSE 0 END) AS departments, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER ({_PII}) AS with_pii, count(counterparty) AS with_counterparty FROM cat",
)
on_catalog(
    "report_facets", c.facets,
    "SELECT 'type' AS facet, doc_type AS value, count(*) AS n FROM cat WHERE doc_type IS NOT NULL GROUP BY 2 UNION ALL SELECT 'sensitivity', sensitivity, count(*) FROM cat WHERE sensitivity IS NOT NULL GROUP BY 2 UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest(list_distinct(tags)) AS tag FROM cat) GROUP BY 2",
)
on_catalog("report_rollup", lambda d: c.by_folder(d.filter(c.live())), f"SELECT department, doc_type, count(*) AS n FROM (SELECT coalesce(department, 'unclassified') AS department, coalesce(doc_type, 'other') AS doc_type FROM cat WHERE {_LIVE}) GROUP BY ROLLUP (department, doc_type)")
on_catalog("report_rows", c.confidence, "SELECT file_id, floor(least(department_confidence, type_confidence, sensitivity_confidence) * 1000 + 0.5) / 1000 AS confidence FROM cat")
on_catalog(
    "run_aggregates", lambda d: d.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_distinct("extract_method").alias("methods"), F.count_distinct("sha256").alias("contents"), F.min("scanned_at").cast("string").alias("first_scan")),
    "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT extract_method) AS methods, count(DISTINCT sha256) AS contents, CAST(CAST(min(scanned_at) AS TIMESTAMP) AS VARCHAR) AS first_scan FROM cat",
)
on_catalog("size_median", lambda d: c.upper_median(d, "kind", "size"), "SELECT kind, count(*) AS n, list_sort(list(size))[count(*) // 2 + 1] AS median FROM cat WHERE size IS NOT NULL GROUP BY 1")
on_catalog("csv_projection", lambda d: c.flat(d).select("path", "tags", "pii_columns", "detected", "personal_data"), "SELECT path, array_to_string(tags, '; ') AS tags, array_to_string(list_transform(pii_columns, lambda p: p.name || '=' || p.data), '; ') AS pii_columns, CASE WHEN detected IS NOT NULL THEN array_to_string(list_sort(list_transform(map_entries(detected), lambda e: e.key || ':' || e.value)), '; ') END AS detected, flags.personal_data AS personal_data FROM cat")
on_catalog(
    "why_restricted", lambda d: d.filter("sensitivity = 'restricted'").select("file_id", c.why_restricted().alias("why")),
    "SELECT file_id, CASE WHEN why = '' THEN 'judged by its content' ELSE why END AS why FROM (SELECT file_id, concat_ws('; ', CASE WHEN coalesce(detected['secret'], 0) > 0 THEN 'secrets' END, CASE WHEN coalesce(detected['card'], 0) > 0 THEN 'card numbers' END, CASE WHEN coalesce(detected['national_id'], 0) > 0 THEN 'national ID numbers' END,"
    " CASE WHEN coalesce(flags.credentials, 0) >= 0.5 THEN 'credentials' END, CASE WHEN coalesce(flags.payment_details, 0) >= 0.5 THEN 'payment details' END, CASE WHEN coalesce(flags.personal_data, 0) >= 0.5 THEN 'personal data' END,"
    " CASE WHEN len(pii_columns) > 0 THEN 'columns with ' || array_to_string(list_filter(list_transform(pii_columns, lambda p, i: CASE WHEN list_position(list_transform(pii_columns, lambda q: q.data), p.data) = i THEN replace(p.data, '_', ' ') END), lambda x: x IS NOT NULL), ', ') END) AS why FROM cat WHERE sensitivity = 'restricted')",
)

# ---- layout

_CLEAN = "coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace({0}, '[/\\\\:*?\"<>|\\x00-\\x1f]', '-', 'g'), '[\\s\\x{{a0}}]+', ' ', 'g'), '^[.\\s\\x{{a0}}]+|[.\\s\\x{{a0}}]+$', '', 'g'), 1, 80), ''), '_')"
_RES = "CASE WHEN sensitivity = 'restricted' THEN '_Restricted/' ELSE '' END"
on_catalog(
    "target_layout", lambda d: d.select("file_id", c.target().alias("target")),
    f"SELECT file_id, CASE WHEN duplicate_of IS NOT NULL THEN {_RES} || '_Duplicates/' || file_name WHEN coalesce(noise, false) THEN '_Noise/' || file_name WHEN coalesce(review, false) THEN {_RES} || '_Needs review/' || {_CLEAN.format("coalesce(department, 'Unclassified')")} || '/' || file_name"
    f" ELSE {_RES} || {_CLEAN.format("coalesce(department, '')")} || '/' || {_CLEAN.format("coalesce(doc_type, '')")} || '/' || {_CLEAN.format("coalesce(split_part(doc_date, '-', 1), 'Undated')")} || '/' || regexp_replace(file_name, '[/\\\\:*?\"<>|]', '-', 'g') END AS target FROM cat",
)
_LAYOUT = "{sensitivity}/{counterparty}/{quarter} {date}/{stem}{ext}"
on_catalog(
    "target_tokens", lambda d: d.filter(c.live() & ~F.coalesce("review", F.lit(False))).select("file_id", c.target(_LAYOUT, apart=False).alias("target")),
    f"SELECT file_id, {_CLEAN.format("coalesce(sensitivity, '')")} || '/' || {_CLEAN.format("coalesce(counterparty, 'No counterparty')")} || '/' || {_CLEAN.format("coalesce('Q' || CAST(ceil(CAST(split_part(doc_date, '-', 2) AS INT) / 3.0) AS INT), 'Undated') || ' ' || coalesce(doc_date, 'Undated')")} || '/' || regexp_replace(file_name, '[/\\\\:*?\"<>|]', '-', 'g') AS target FROM cat WHERE {_LIVE} AND NOT coalesce(review, false)",
)


@query()
def unique_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout's targets made different, case ignored."""
    return c.unique_targets(cat(spark, sf_dir).select("file_id", "path", "file_name", c.target().alias("target"))).select("file_id", "target")


# ---- evaluation


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.compared(cat(spark, sf_dir), table(spark, sf_dir, "file_labels"))


_EQ = "IS NOT DISTINCT FROM"
_ORG = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_SAME = "(c.counterparty IS NULL AND l.counterparty IS NULL) OR coalesce(({a} = {b}) OR (length({a}) > 4 AND length({b}) > 4 AND (contains({a}, {b}) OR contains({b}, {a}))), false)".format(a=_ORG.format("c.counterparty"), b=_ORG.format("l.counterparty"))
_LEVEL = "list_position(['public', 'internal', 'confidential', 'restricted'], {0})"
_COMPARED = _WITH.rstrip() + (
    f", cmp AS (SELECT c.*, l.department AS l_department, l.doc_type AS l_doc_type, l.sensitivity AS l_sensitivity, l.doc_date AS l_doc_date, l.counterparty AS l_counterparty, l.noise AS l_noise, l.duplicate_of AS l_duplicate_of,"
    f" c.department {_EQ} l.department AS ok_department, c.doc_type {_EQ} l.doc_type AS ok_type, c.sensitivity {_EQ} l.sensitivity AS ok_sensitivity, coalesce(abs({_LEVEL.format('c.sensitivity')} - {_LEVEL.format('l.sensitivity')}) <= 1, false) AS near_sensitivity,"
    f" c.doc_date {_EQ} l.doc_date AS ok_date, {_SAME} AS ok_counterparty, l.duplicate_of IS NULL AND NOT coalesce(l.noise, false) AS base FROM cat c JOIN file_labels l USING (path)) "
)


@query()
def eval_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("file_id", "ok_department", "ok_type", "ok_sensitivity", "near_sensitivity", "ok_date", "ok_counterparty", "base")


@query()
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.metrics(_compared(spark, sf_dir))


@query()
def eval_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.misses(_compared(spark, sf_dir))


@query("SELECT c.file_id FROM cat c ANTI JOIN file_labels l ON c.path = l.path")
def eval_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.unlabelled(cat(spark, sf_dir), table(spark, sf_dir, "file_labels")).select("file_id")


@query("SELECT l.path FROM file_labels l ANTI JOIN cat c ON c.path = l.path")
def eval_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.missing(cat(spark, sf_dir), table(spark, sf_dir, "file_labels")).select("path")


_SQL["eval_compared"] = _COMPARED + "SELECT file_id, ok_department, ok_type, ok_sensitivity, near_sensitivity, ok_date, ok_counterparty, base FROM cmp"
_M = {
    "department": ("ok_department", "base"), "department, not in review": ("ok_department", "base AND NOT coalesce(review, false)"), "type": ("ok_type", "base"), "type, not in review": ("ok_type", "base AND NOT coalesce(review, false)"), "sensitivity": ("ok_sensitivity", "base"), "sensitivity within one level": ("near_sensitivity", "base"),
    "restricted recall": (f"sensitivity {_EQ} 'restricted'", f"base AND l_sensitivity {_EQ} 'restricted'"), "restricted precision": (f"l_sensitivity {_EQ} 'restricted'", f"base AND sensitivity {_EQ} 'restricted'"), "date": ("ok_date", "base"), "date, when labelled": ("ok_date", "base AND l_doc_date IS NOT NULL"), "counterparty": ("ok_counterparty", "base"), "counterparty, when labelled": ("ok_counterparty", "base AND l_counterparty IS NOT NULL"),
    "noise found": ("coalesce(noise, false)", "coalesce(l_noise, false)"), "duplicates found": ("duplicate_of IS NOT NULL", "l_duplicate_of IS NOT NULL"), "sent to review": ("coalesce(review, false)", "base"),
}
_SQL["eval_metrics"] = _COMPARED + "SELECT metric, correct, of, CASE WHEN of > 0 THEN floor(1000.0 * correct / of + 0.5) / 10 END AS pct FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) FILTER (({o}) AND ({k})) AS correct, count(*) FILTER ({o}) AS of FROM cmp" for n, (k, o) in _M.items()) + ")"
_SQL["eval_misses"] = _COMPARED + "SELECT file_id, path, miss FROM (" + " UNION ALL ".join(
    f"SELECT file_id, path, '{n} ' || coalesce({f}, 'none') || ', not ' || coalesce(l_{f}, 'none') AS miss FROM cmp WHERE base AND NOT {ok}" for n, ok, f in (("department", "ok_department", "department"), ("type", "ok_type", "doc_type"), ("sensitivity", "ok_sensitivity", "sensitivity"), ("date", "ok_date", "doc_date"), ("counterparty", "ok_counterparty", "counterparty"))
) + ")"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
