"""The queries over texts: detectors, dates, names, the lexical model and its rules; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import candidates as k
from folioscope.operators import catalog as c
from folioscope.operators import detect as d
from folioscope.operators import model as m
from folioscope.queries import _SQL, _WITH, cat, ext, on_catalog, query, table
from folioscope.sources.extract import extracted


def on_extracts(name: str, f, sql: str | None) -> None:
    """Registers a query that is one function of the extracts."""
    query(sql)(_named(name, lambda spark, sf_dir: f(ext(spark, sf_dir))))


def _named(name: str, f):
    f.__name__ = name
    return f


# ---- detectors

_RE2_B = r"\b"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * CAST(c AS INT) > 9 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END ELSE CAST(c AS INT) END)) % 10 = 0"
_CARD_OK = f"length({_DIGITS}) BETWEEN 13 AND 19 AND regexp_matches(x, '^[3-6]') AND len(list_distinct(string_split({_DIGITS}, ''))) > 1 AND {_LUHN}"
_MOVED = "(substr(regexp_replace(x, '\\s+', '', 'g'), 5) || substr(regexp_replace(x, '\\s+', '', 'g'), 1, 4))"
_IBAN_OK = f"length(regexp_replace(x, '\\s+', '', 'g')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split({_MOVED}, ''), lambda c: CAST(CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE CAST(c AS INT) END AS BIGINT)), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97, 0) = 1"
_BL = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_NAMED = rf"(?i)(?:^|[^A-Za-z0-9])(?:{d.SECRET_WORDS})[\"'']?[{_BL}]*[:=][{_BL}]*[\"'']?([^{_BL}\"'',;]{{6,}})"
_FOUND = {
    "block": f"regexp_extract_all(text, '{d.BLOCK}')",
    "vendor": f"regexp_extract_all(text, '{_RE2_B}{d.TOKENS}{_RE2_B}')",
    "named": f"list_filter(regexp_extract_all(text, '{_NAMED}', 1), lambda x: NOT regexp_matches(x, '(?i){d.PLACEHOLDER}') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]'))",
    "iban": rf"list_filter(regexp_extract_all(text, '\b[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b'), lambda x: {_IBAN_OK})",
    "card": rf"list_filter(regexp_extract_all(text, '\b(?:\d[ -]?){{12,18}}\d\b'), lambda x: {_CARD_OK})",
    "ssn": r"list_filter(regexp_extract_all(text, '\b\d{3}-\d{2}-\d{4}\b'), lambda x: NOT regexp_matches(x, '^(000|666|9)|^...-00|0000$'))",
    "nino": r"list_filter(regexp_extract_all(text, '\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b'), lambda x: NOT regexp_matches(x, '^(BG|GB|NK|KN|TN|NT|ZZ)'))",
    "email": r"regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@(?:[A-Z0-9-]+\.)+[A-Z]{2,}\b')",
    "phone": rf"list_filter(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_+])((?:\+\d{{1,3}}[ .-]?|\(0\d{{1,4}}\)[ .-]?|0)\d{{1,4}}(?:[ .-]?\d{{2,4}}){{2,4}})(?:[^A-Za-z0-9_]|$)', 1), lambda x: length({_DIGITS}) BETWEEN 9 AND 15)",
}
for _name, _sql in _FOUND.items():
    on_extracts(f"detect_{_name}", lambda e, n=_name: e.select("file_id", F.size(d.found("text", n)).alias("n")).filter("n > 0"), f"SELECT file_id, CAST(len({_sql}) AS INT) AS n FROM ext WHERE len({_sql}) > 0")
on_extracts("email_domains", lambda e: e.select("file_id", F.array_join(F.array_sort(d.domains("text")), " ").alias("domains")).filter("domains != ''"), r"SELECT file_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@((?:[A-Z0-9-]+\.)+[A-Z]{2,})\b', 1), lambda x: lower(x)))), ' ') AS domains FROM ext WHERE regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@((?:[A-Z0-9-]+\.)+[A-Z]{2,})\b')")
on_extracts("mask_block", lambda e: e.filter("kind = 'code'").select("file_id", d.masked("text", "block").alias("masked")), f"SELECT file_id, regexp_replace(text, '{d.BLOCK}', '[PRIVATE KEY]', 'g') AS masked FROM ext WHERE kind = 'code'")
on_extracts("mask_vendor", lambda e: e.filter("kind = 'code'").select("file_id", d.masked("text", "vendor").alias("masked")), f"SELECT file_id, regexp_replace(text, '{_RE2_B}{d.TOKENS}{_RE2_B}', '[SECRET]', 'g') AS masked FROM ext WHERE kind = 'code'")


def _counts(e: DataFrame) -> DataFrame:
    n = lambda x: F.size(d.found("text", x))
    return e.select("file_id", (n("block") + n("vendor") + n("named")).alias("secret"), n("card").alias("card"), (n("ssn") + n("nino")).alias("national_id"), n("iban").alias("iban"))


_N = lambda *names: " + ".join(f"coalesce(len({_FOUND[x]}), 0)" for x in names)
_FLOORS = f"fl AS (SELECT file_id, {_N('block', 'vendor', 'named')} AS secret, {_N('card')} AS card, {_N('ssn', 'nino')} AS national_id, {_N('iban')} AS iban FROM ext), lv AS (SELECT *, CASE WHEN secret > 0 OR card > 0 OR national_id > 0 THEN 'restricted' WHEN iban > 0 THEN 'confidential' END AS level, CASE WHEN secret > 0 OR card > 0 OR national_id > 0 THEN concat_ws(', ', CASE WHEN secret > 0 THEN 'secrets' END, CASE WHEN card > 0 THEN 'card numbers' END, CASE WHEN national_id > 0 THEN 'national ID numbers' END) WHEN iban > 0 THEN 'bank account numbers' END AS reason FROM fl)"
_ARGS = ("secret", "card", "national_id", "iban")


def _floors(e: DataFrame) -> DataFrame:
    args = [F.col(x) for x in _ARGS]
    return _counts(e).select("file_id", d.floor_level(*args).alias("level"), d.floor_reason(*args).alias("reason"))


on_extracts("sensitivity_floor", lambda e: _floors(e).filter("level is not null"), None)
_SQL["sensitivity_floor"] = _WITH.rstrip() + f", {_FLOORS} SELECT file_id, level, reason FROM lv WHERE level IS NOT NULL"
on_extracts("floor_summary", lambda e: _floors(e).groupBy(F.coalesce("level", F.lit("none")).alias("level")).agg(F.count("*").alias("n")), None)
_SQL["floor_summary"] = _WITH.rstrip() + f", {_FLOORS} SELECT coalesce(level, 'none') AS level, count(*) AS n FROM lv GROUP BY 1"


@query()
def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors in turn: counts, domains and the masked text."""
    return ext(spark, sf_dir).select("file_id", d.scan("text").alias("s")).select("file_id", *(f"s.{x}" for x in d.TYPES), F.array_join("s.domains", " ").alias("domains"), "s.masked")


# ---- texts

on_extracts("html_to_text", lambda e: e.filter("kind = 'web'").select("file_id", t.html_to_text("text").alias("plain")), None)
on_extracts("first_line_title", lambda e: e.select("file_id", t.first_line("text").alias("title")).filter("title is not null"), rf"SELECT file_id, substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[#>*\-{_BL}]+', ''), '[{_BL}]+$', '')), lambda x: length(x) > 2)[1], 1, 120) AS title FROM ext WHERE len(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[#>*\-{_BL}]+', ''), '[{_BL}]+$', '')), lambda x: length(x) > 2)) > 0")
on_extracts("clip_text", lambda e: e.select("file_id", t.clipped("text", 2000).alias("clipped")), "SELECT file_id, CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 1500) || chr(10) || '[... ' || format('{:,}', length(text) - 2000) || ' characters skipped ...]' || chr(10) || right(text, 500) END AS clipped FROM ext")
on_extracts("token_estimate", lambda e: c.estimate(e.select(F.length("text").alias("chars"))), "SELECT count(*) AS files, CAST(floor(sum(length(text)) / 3.2 + 0.5) AS BIGINT) AS tokens FROM ext")
on_extracts("delimiter_sniff", lambda e: e.filter("kind = 'table'").select("file_id", t.delimiter("text").alias("delimiter")), None)
_HEAD = "array_to_string(string_split(text, chr(10))[1:5], chr(10))"
_CNT = lambda ch: f"(length({_HEAD}) - length(replace({_HEAD}, {ch}, '')))"
_SQL["delimiter_sniff"] = _WITH + f"SELECT file_id, CASE WHEN a >= b AND a >= t AND a >= p THEN ',' WHEN b >= t AND b >= p THEN ';' WHEN t >= p THEN chr(9) ELSE '|' END AS delimiter FROM (SELECT file_id, {_CNT("','")} AS a, {_CNT("';'")} AS b, {_CNT('chr(9)')} AS t, {_CNT("'|'")} AS p FROM ext WHERE kind = 'table' AND text IS NOT NULL) UNION ALL " + "SELECT file_id, NULL FROM ext WHERE kind = 'table' AND text IS NULL"
on_extracts("table_profile", lambda e: e.filter("table_profile is not null").select("file_id", "table_profile.sheet", "table_profile.n_rows", F.explode("table_profile.cols").alias("col")).select("file_id", "sheet", "n_rows", F.col("col.name").alias("name"), F.array_join("col.samples", "; ").alias("samples")), "SELECT file_id, sheet, n_rows, col.name AS name, array_to_string(col.samples, '; ') AS samples FROM (SELECT file_id, table_profile.sheet AS sheet, table_profile.n_rows AS n_rows, unnest(table_profile.cols) AS col FROM ext WHERE table_profile IS NOT NULL)")
on_catalog("human_size", lambda e: e.select("file_id", t.human_size("size").alias("text")), "SELECT file_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', round(size / 1024.0, 1)) ELSE printf('%.1f MB', round(size / 1048576.0, 1)) END AS text FROM cat")
on_extracts("kinds", lambda e: e.groupBy("kind", "ext").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), "SELECT kind, ext, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM ext GROUP BY 1, 2")

# ---- dates and names

_MON = "CASE WHEN w LIKE 'juil%' THEN 7 WHEN w LIKE 'juin%' THEN 6 " + " ".join(f"WHEN substr(w, 1, 4) = '{x}' THEN {n}" for n, ws in k.MONTHS.items() for x in ws.split() if len(x) == 4) + " " + " ".join(f"WHEN substr(w, 1, 3) = '{x}' THEN {n}" for n, ws in k.MONTHS.items() for x in ws.split() if len(x) == 3) + " END"


def _finder(pattern: str, y: int, mo: int, dd: int, named: bool) -> str:
    pattern = pattern.replace(k._B, r"\b").replace("À-ÿ", r"\x{c0}-\x{ff}")
    g = lambda n: f"unnest(regexp_extract_all(text, '{pattern}', {n}))"
    month = _MON.replace("w ", "lower(m) ").replace("(w,", "(lower(m),") if named else "CAST(m AS INT)"
    return f"SELECT file_id, CAST(y AS INT) AS y, {month} AS m, CAST(d AS INT) AS d FROM (SELECT file_id, {g(y)} AS y, {g(mo)} AS m, {g(dd)} AS d FROM ext)"


_DATES = "dates AS (SELECT DISTINCT file_id, printf('%d-%02d-%02d', y, m, d) AS value FROM (" + " UNION ALL ".join(_finder(p, *g, n) for p, g, n in k.FINDERS) + ") WHERE y BETWEEN 1980 AND 2100 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31)"
on_extracts("date_values", lambda e: e.select("file_id", F.explode(k.date_values("text")).alias("value")), None)
_SQL["date_values"] = _WITH.rstrip() + f", {_DATES} SELECT file_id, value FROM dates"
on_extracts("date_years", lambda e: e.select("file_id", F.explode(k.date_values("text")).alias("value")).groupBy(F.substring("value", 1, 4).alias("year")).agg(F.count("*").alias("n")), None)
_SQL["date_years"] = _WITH.rstrip() + f", {_DATES} SELECT substr(value, 1, 4) AS year, count(*) AS n FROM dates GROUP BY 1"


@query()
def date_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's date candidates with the words around them, as choices."""
    return ext(spark, sf_dir).select("file_id", F.explode(k.as_options(k.date_candidates("text"), "None of these")).alias("o")).select("file_id", "o.id", "o.description")


@query()
def org_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's organisations with the words around them, as choices; names of the whole corpus are known."""
    names = [r["name"] for r in k.entities(ext(spark, sf_dir)).collect()]  # at most 1,000
    return ext(spark, sf_dir).select("file_id", F.explode(k.as_options(k.org_candidates("text", names), "None of these")).alias("o")).select("file_id", "o.id", "o.description")


@query()
def org_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.mentions(ext(spark, sf_dir))


@query()
def company_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.company(ext(spark, sf_dir), share=0.1)


@query()
def corpus_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.entities(ext(spark, sf_dir))


# ---- the model

_WORDS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}'))"


def _ranked_sql(tax: m.Taxonomy) -> str:
    rows = ", ".join(f"{{'id': '{o}', 'ord': {n}, 's': len(list_intersect(w, {m.option_words(o, x)!r})) - {0.5 if o in ('other', 'none') else 0.0}}}" for n, (o, x) in enumerate(tax))
    return _WITH.rstrip() + f", sc AS (SELECT file_id, unnest([{rows}]) AS o FROM (SELECT file_id, {_WORDS} AS w FROM ext)), rk AS (SELECT file_id, o.id AS id, o.s AS s, row_number() OVER (PARTITION BY file_id ORDER BY o.s DESC, o.ord) AS k, sum(greatest(o.s, 0) + 1) OVER (PARTITION BY file_id) AS total FROM sc) "


def _choice_sql(tax: m.Taxonomy) -> str:
    return _ranked_sql(tax) + "SELECT a.file_id, a.id AS choice, floor(least(0.99, 0.5 + a.s / 10) * 1000 + 0.5) / 1000 AS confidence, b.id AS runner_up FROM rk a JOIN rk b ON a.file_id = b.file_id AND b.k = 2 WHERE a.k = 1"


for _name, _tax in (("department", m.DEPARTMENTS), ("sensitivity", m.SENSITIVITY)):
    on_extracts(f"lexical_{_name}", lambda e, tax=_tax: e.select("file_id", m.answer(m.words_of("text"), tax).alias("a")).select("file_id", "a.choice", "a.confidence", "a.runner_up"), None)
    _SQL[f"lexical_{_name}"] = _choice_sql(_tax)
on_extracts("lexical_probabilities", lambda e: e.select("file_id", F.explode(m.answer(m.words_of("text"), m.SENSITIVITY)["probabilities"]).alias("p")).select("file_id", "p.id", "p.p"), None)
_SQL["lexical_probabilities"] = _ranked_sql(m.SENSITIVITY) + "SELECT file_id, id, floor((greatest(s, 0) + 1) / total * 1000 + 0.5) / 1000 AS p FROM rk"
on_extracts("lexical_tags", lambda e: e.select("file_id", F.explode(m.tag_scores(m.words_of("text"))).alias("tag")), None)
_SQL["lexical_tags"] = _WITH + "SELECT file_id, tag FROM (SELECT file_id, unnest([" + ", ".join(f"CASE WHEN least(1.0, 0.3 + 0.2 * len(list_intersect(w, {m.option_words(o, x)!r}))) >= 0.7 THEN '{o}' END" for o, x in m.TAGS) + f"]) AS tag FROM (SELECT file_id, {_WORDS} AS w FROM ext)) WHERE tag IS NOT NULL"


def _request(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = c.latest(table(spark, sf_dir, "request_state"), "request_id", ("built_at",))
    body = m.request({"company": F.col("company_name"), "path": F.col("file_info.path"), "kind": F.col("file_info.kind"), "content": F.col("content")})
    return q.select("request_id", "file_id", F.length("content").alias("chars"), m.request_key(body).alias("key"))


@query()
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _request(spark, sf_dir)


@query(
    "SELECT count(*) AS files, CAST(floor(sum(length(content)) / 3.2 + 0.5) AS BIGINT) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY built_at DESC) AS rn FROM request_state) WHERE rn = 1 AND file_id NOT IN (SELECT file_id FROM file_labels WHERE file_id IS NOT NULL)"
)
def cache_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the requests would take that no answer is kept for; here the labelled files count as answered."""
    left = c.cache_misses(_request(spark, sf_dir), table(spark, sf_dir, "file_labels"), "file_id")
    return c.estimate(left)


_HOT = "list_filter(coalesce(pii_columns, []), lambda p: p.data IN ('national_id', 'bank_card', 'salary', 'health', 'credentials') AND p.confidence >= 0.6)"


@query()
def rules_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of each file after the rules, what it was raised from, and why."""
    n = lambda x: F.coalesce(F.try_element_at("detected", F.lit(x)), F.lit(0))
    args = [n("secret"), n("card"), n("national_id"), n("iban")]
    s = m.settled(F.col("sensitivity"), F.col("sensitivity_confidence"), d.floor_level(*args), d.floor_reason(*args), F.col("flags"), F.col("pii_columns"))
    return cat(spark, sf_dir).select("file_id", s.alias("s")).select("file_id", "s.level", "s.raised_from", F.array_join("s.reasons", "; ").alias("reasons"))


_RK = lambda x: f"coalesce(list_position(['public', 'internal', 'confidential', 'restricted'], {x}), 0)"
_SQL["rules_settled"] = _WITH.rstrip() + (
    f", a AS (SELECT *, coalesce(flags.credentials, 0) AS cr, greatest(coalesce(flags.personal_data, 0), coalesce(flags.credentials, 0), coalesce(flags.payment_details, 0)) AS mx, {_HOT} AS hot, coalesce(detected['secret'], 0) AS s, coalesce(detected['card'], 0) AS cd, coalesce(detected['national_id'], 0) AS ni, coalesce(detected['iban'], 0) AS ib FROM cat),"
    " b AS (SELECT *, CASE WHEN s > 0 OR cd > 0 OR ni > 0 THEN 'restricted' WHEN ib > 0 THEN 'confidential' END AS fl, CASE WHEN s > 0 OR cd > 0 OR ni > 0 THEN concat_ws(', ', CASE WHEN s > 0 THEN 'secrets' END, CASE WHEN cd > 0 THEN 'card numbers' END, CASE WHEN ni > 0 THEN 'national ID numbers' END) ELSE 'bank account numbers' END AS fr FROM a),"
    " c AS (SELECT *, coalesce(sensitivity = 'restricted' AND fl IS NULL AND len(hot) = 0 AND mx < 0.5 AND sensitivity_confidence < 0.8, false) AS low FROM b), d0 AS (SELECT *, CASE WHEN low THEN 'confidential' ELSE sensitivity END AS l0 FROM c),"
    f" d1 AS (SELECT *, fl IS NOT NULL AND {_RK('fl')} > {_RK('l0')} AS u1 FROM d0), e1 AS (SELECT *, CASE WHEN u1 THEN fl ELSE l0 END AS l1 FROM d1), d2 AS (SELECT *, cr >= 0.5 AND {_RK('l1')} < 4 AS u2 FROM e1), e2 AS (SELECT *, CASE WHEN u2 THEN 'restricted' ELSE l1 END AS l2 FROM d2), d3 AS (SELECT *, len(hot) > 0 AND {_RK('l2')} < 4 AS u3 FROM e2)"
    " SELECT file_id, CASE WHEN u3 THEN 'restricted' ELSE l2 END AS level, CASE WHEN u1 OR u2 OR u3 THEN CASE WHEN u1 THEN l0 WHEN u2 THEN l1 ELSE l2 END END AS raised_from, concat_ws('; ', CASE WHEN low THEN 'lowered from restricted: no evidence found' END, CASE WHEN u1 THEN 'detected ' || fr END, CASE WHEN u2 THEN 'contains credentials' END,"
    " CASE WHEN u3 THEN 'columns with ' || array_to_string(list_filter(list_transform(hot, lambda p, i: CASE WHEN list_position(list_transform(hot, lambda q: q.data), p.data) = i THEN replace(p.data, '_', ' ') END), lambda x: x IS NOT NULL), ', ') END) AS reasons FROM d3"
)

# ---- extractors over the texts' bytes


@query("SELECT file_id, ext, octet_length(encode(text)) AS size, CASE WHEN kind = 'code' THEN 'code' ELSE 'text' END AS kind, 'text' AS extract_method, text FROM ext WHERE ext IN ('txt', 'md', 'log', 'py', 'js', 'ts', 'sql', 'java', 'sh', 'php', 'json', 'yaml', 'toml', 'ini', 'conf', 'properties', 'xml') AND length(text) > 0")
def extract_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and code as bytes, through the extractor and back."""
    plain = ("txt", "md", "log", "py", "js", "ts", "sql", "java", "sh", "php", "json", "yaml", "toml", "ini", "conf", "properties", "xml")
    files = ext(spark, sf_dir).filter(F.col("ext").isin(*plain) & (F.length("text") > 0)).select("file_id", F.concat(F.lit("f."), "ext").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return extracted(files).select("file_id", "ext", "size", "kind", "extract_method", "text")


@query()
def extract_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails as bytes through the extractor: title and text."""
    files = ext(spark, sf_dir).filter("kind = 'email'").select("file_id", F.lit("m.eml").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return extracted(files).select("file_id", "title", "text")


@query("SELECT file_id, table_profile.cols[1].name AS name, len(table_profile.cols) AS columns, coalesce(array_to_string(table_profile.cols[1].samples, '; '), '') AS samples FROM ext WHERE len(table_profile.cols) > 0 AND len(list_filter(table_profile.cols, lambda c: len(c.samples) > 0)) > 0")
def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table's profile written as a delimited file and read again: first column, number of columns, samples."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    cols = F.col("table_profile.cols")
    header = F.array_join(F.transform(cols, lambda c: cell(c["name"])), ";")
    rows = F.transform(F.sequence(F.lit(0), F.array_max(F.transform(cols, lambda c: F.size(c["samples"]))) - 1), lambda k: F.array_join(F.transform(cols, lambda c: cell(F.get(c["samples"], k))), ";"))
    files = ext(spark, sf_dir).filter((F.size(cols) > 0) & F.exists(cols, lambda c: F.size(c["samples"]) > 0)).select("file_id", F.lit("t.csv").alias("path"), F.encode(F.concat(header, F.lit("\r\n"), F.array_join(rows, "\r\n")), "UTF-8").alias("content"))
    first = F.col("table_profile.cols")[0]
    return extracted(files).select("file_id", first["name"].alias("name"), F.size("table_profile.cols").cast("bigint").alias("columns"), F.array_join(first["samples"], "; ").alias("samples"))
