"""The catalogue as a table: deliveries, exact duplicates, predicates, listings, summaries, layout, evaluation.

Every function takes and gives DataFrames with the columns of the file catalogue.  Predicates are
null-safe: a null never makes a row appear or vanish by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import extension, file_name, rounded, stem
from folioscope.operators.graph import cut

LEVELS = ("public", "internal", "confidential", "restricted")


def latest(df: DataFrame, key: str = "file_id", by: Sequence[str] = ("loaded_at", "scanned_at")) -> DataFrame:
    """One row for each key: of rows delivered again the one with the last times; nulls count as the earliest."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in by))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


# ---- exact duplicates


def copy_score(path: Column | str) -> Column:
    """Lower for what is more likely the original: names that say copy, and scratch folders, score."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.substring_index(p, "/", -1)
    copy = r"(?i)(?<![A-Za-z0-9_])(?:copy|kopie|duplicate)(?![A-Za-z0-9_])|\([0-9]+\)"
    scratch = r"(?i)(?:^|/)(?:downloads?|desktop|tmp|temp|old[^/]*|misc|archive|backup|unsorted)(?:/|\z)"
    return F.when(name.rlike(copy), 3).otherwise(0) + F.when(p.rlike(scratch), 2).otherwise(0)


def with_original(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Adds copy_rank (1 for the original of its content) and original_id, original_path.

    The least (copy score, path) of a content is an aggregate, so a content with any share of all rows needs no
    window: rows only meet its one result.  Rows without a hash are originals.
    """
    path = F.col("path") if order is None else order
    best = F.min_by(F.struct(F.col("file_id").alias("original_id"), F.col("path").alias("original_path")), F.struct(copy_score("path"), path, "file_id"))
    first = df.filter("sha256 is not null").groupBy("sha256").agg(best.alias("_best")).select("sha256", "_best.*")
    out = df.join(first, "sha256", "left")
    return out.withColumns({"original_id": F.coalesce("original_id", "file_id"), "original_path": F.coalesce("original_path", "path")})


def originals(df: DataFrame) -> DataFrame:
    return with_original(df).filter("file_id = original_id").drop("original_id", "original_path")


def with_original_record(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The duplicates with the fields of their original's record in place of their own; they are never in review."""
    ranked = with_original(df)
    source = ranked.filter("file_id = original_id").select(F.col("file_id").alias("original_id"), *(F.col(c).alias(f"_{c}") for c in fields))
    out = ranked.filter("file_id != original_id").join(source, "original_id")
    return out.withColumns({c: F.col(f"_{c}") for c in fields} | {"review": F.lit(False), "duplicate_of": F.col("original_path")}).drop(*(f"_{c}" for c in fields))


# ---- predicates


def has_pii(at_least: float = 0.5) -> Column:
    return (F.coalesce(F.col("flags.personal_data"), F.lit(0.0)) >= at_least) | (F.coalesce(F.size("pii_columns"), F.lit(0)) > 0)


def live() -> Column:
    """Neither a duplicate nor noise."""
    return F.col("duplicate_of").isNull() & ~F.coalesce("noise", F.lit(False))


def selected(
    df: DataFrame, department: str | None = None, doc_type: str | None = None, sensitivity: str | None = None, tag: str | None = None, year: str | int | None = None, counterparty: str | None = None,
    text: str | None = None, review: bool = False, pii: bool = False, include_duplicates: bool = False, include_noise: bool = False, limit: int | None = None,
) -> DataFrame:
    """The rows that meet all conditions given; a condition that is None, empty or False is none.

    year: a prefix of the date, so 2026-03 selects a month.  counterparty and text: parts, case ignored.
    """
    keep = F.lit(True)
    for column, value in (("department", department), ("doc_type", doc_type), ("sensitivity", sensitivity)):
        if value:
            keep &= F.col(column).eqNullSafe(value)
    if tag:
        keep &= F.coalesce(F.array_contains("tags", tag), F.lit(False))
    if year:
        keep &= F.coalesce(F.col("doc_date"), F.lit("")).startswith(str(year))
    if counterparty:
        keep &= F.contains(F.lower(F.coalesce("counterparty", F.lit(""))), F.lit(counterparty.lower()))
    if text:
        parts = [F.coalesce(c, F.lit("")) for c in ("path", "title", "counterparty")]
        keep &= F.contains(F.lower(F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2])), F.lit(text.lower()))
    if review:
        keep &= F.coalesce("review", F.lit(False))
    if pii:
        keep &= has_pii()
    if not include_duplicates:
        keep &= F.col("duplicate_of").isNull()
    if not include_noise:
        keep &= ~F.coalesce("noise", F.lit(False))
    out = df.filter(keep)
    return out.orderBy("path").limit(limit) if limit else out


# ---- summaries and listings


def summary(df: DataFrame) -> DataFrame:
    """One row of counts."""
    dup, noise, review = F.col("duplicate_of").isNotNull(), F.coalesce("noise", F.lit(False)), F.coalesce("review", F.lit(False))
    return df.agg(
        F.count("*").alias("files"), F.count_if(live() & ~review).alias("filed"), F.count_if(live() & review).alias("needs_review"), F.count_if(live() & (F.col("sensitivity") == "restricted")).alias("restricted"),
        F.count_if(dup).alias("duplicates"), F.count_if(~dup & noise).alias("noise"), F.count_if(F.col("extract_error").isNotNull()).alias("failed"),
    )


def grouped(df: DataFrame, column: str, other: str = "unclassified") -> DataFrame:
    """(value, n), most first, then by name; nulls under a name of their own."""
    return df.groupBy(F.coalesce(column, F.lit(other)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def top_types(df: DataFrame, k: int = 4) -> DataFrame:
    """(department, n, types): the k most frequent types of each department as ``type (n), ...``."""
    per = df.groupBy(F.coalesce("department", F.lit("unclassified")).alias("department"), F.coalesce("doc_type", F.lit("other")).alias("doc_type")).agg(F.count("*").alias("n"))
    text = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "doc_type"))), 1, k), lambda x: F.concat(x["doc_type"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")")))
    return per.groupBy("department").agg(F.sum("n").alias("n"), F.array_join(text, ", ").alias("types"))


def listing(df: DataFrame, most: int = 60) -> DataFrame:
    """The first rows of each department and type, newest date first and undated last, with their place and how many more there are.

    The window keeps only the first rows of a group, which Spark cuts before the shuffle (a rank limit).
    """
    keys = [F.coalesce("department", F.lit("unclassified")).alias("department"), F.coalesce("doc_type", F.lit("other")).alias("doc_type")]
    rows = df.select(*keys, F.coalesce("doc_date", F.lit("")).alias("doc_date"), "file_name", "file_id")
    w = Window.partitionBy("department", "doc_type").orderBy(F.desc("doc_date"), "file_name", "file_id")
    first = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    sizes = rows.groupBy("department", "doc_type").agg(F.count("*").alias("_n"))
    return first.join(F.broadcast(sizes), ["department", "doc_type"]).withColumn("more", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


def section(df: DataFrame, name: str, most: int = 200) -> DataFrame:
    """The first rows, by path, of one of the report's sections."""
    noise = F.coalesce("noise", F.lit(False))
    keep = {"review": live() & F.coalesce("review", F.lit(False)), "restricted": live() & (F.col("sensitivity") == "restricted"), "duplicates": F.col("duplicate_of").isNotNull(), "noise": F.col("duplicate_of").isNull() & noise}[name]
    return df.filter(keep).orderBy("path", "file_id").limit(most)


def tiles(df: DataFrame) -> DataFrame:
    """Counts for the head of a report; a missing department is one of the departments."""
    return df.agg(
        F.count("*").alias("files"), F.count_if(live()).alias("live"), (F.count_distinct("department") + F.max(F.when(F.col("department").isNull(), 1).otherwise(0))).alias("departments"), F.sum("size").alias("bytes"),
        F.count_if(has_pii()).alias("with_pii"), F.count_if(F.col("counterparty").isNotNull()).alias("with_counterparty"),
    )


def facets(df: DataFrame) -> DataFrame:
    """(facet, value, n) of types, levels and tags."""
    one = lambda name, col: df.filter(F.col(col).isNotNull()).groupBy(F.lit(name).alias("facet"), F.col(col).alias("value")).agg(F.count("*").alias("n"))
    tags = df.select(F.explode(F.array_distinct("tags")).alias("value")).groupBy(F.lit("tag").alias("facet"), "value").agg(F.count("*").alias("n"))
    return one("type", "doc_type").unionByName(one("sensitivity", "sensitivity")).unionByName(tags)


def by_folder(df: DataFrame) -> DataFrame:
    """(department, doc_type, n) with subtotals: the report's two levels as a rollup; nulls mark the totals."""
    d, t = F.coalesce("department", F.lit("unclassified")), F.coalesce("doc_type", F.lit("other"))
    return df.rollup(d.alias("department"), t.alias("doc_type")).agg(F.count("*").alias("n"))


def upper_median(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, n, median): of the sorted values the one at place n div 2, from 0.

    Values are counted first; what is sorted are distinct values of a group with their running counts.
    """
    per = df.filter(F.col(column).isNotNull()).groupBy(group, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("_v")
    placed = per.withColumn("_upto", F.sum("_n").over(w)).join(per.groupBy(group).agg(F.sum("_n").alias("n")), group)
    return placed.filter((F.col("_upto") > F.floor(F.col("n") / 2)) & (F.col("_upto") - F.col("_n") <= F.floor(F.col("n") / 2))).select(group, "n", F.col("_v").alias("median"))


# ---- layout


def tokens(name: Column, labels: dict[str, dict[str, str]] | None = None) -> dict[str, Column]:
    """The columns that a layout's tokens stand for."""
    label = lambda kind, c: F.coalesce(*([F.create_map(*(F.lit(x) for kv in labels[kind].items() for x in kv))[F.col(c)]] if labels and labels.get(kind) else []), F.col(c))
    part = lambda k: F.get(F.split("doc_date", "-"), F.lit(k))
    undated = F.lit("Undated")
    return {
        "department": label("departments", "department"), "department_id": F.col("department"), "type": label("types", "doc_type"), "type_id": F.col("doc_type"), "sensitivity": label("sensitivity", "sensitivity"),
        "year": F.coalesce(part(0), undated), "month": F.coalesce(part(1), undated), "quarter": F.coalesce(F.concat(F.lit("Q"), F.ceil(F.try_to_number(part(1), F.lit("99")) / 3).cast("string")), undated),
        "date": F.coalesce("doc_date", undated), "counterparty": F.coalesce("counterparty", F.lit("No counterparty")), "name": name, "stem": stem(name), "ext": extension(name),
    }


def target(layout: str = "{department}/{type}/{year}/{name}", folders: dict[str, str] | None = None, apart: bool = True, labels: dict[str, dict[str, str]] | None = None) -> Column:
    """The destination of each row: a duplicate, noise, in review, or by the layout; restricted rows but noise under a folder of their own."""
    import re

    at = {"review": "_Needs review", "restricted": "_Restricted", "noise": "_Noise", "duplicates": "_Duplicates"} | (folders or {})
    name = F.col("file_name")
    tok = tokens(name, labels)

    def filled(segment: str) -> Column:
        parts = re.split(r"\{(\w+)\}", segment)
        cols = [F.lit(p) if k % 2 == 0 else F.coalesce(tok.get(p, F.lit("")), F.lit("")) for k, p in enumerate(parts) if k % 2 or p]
        return F.concat(*cols)

    *head, last = layout.split("/")
    leaf = F.regexp_replace(filled(last), r"[/\\:*?\"<>|]", "-")
    laid = F.concat_ws("/", *(file_name(filled(s)) for s in head), F.when(leaf == "", name).otherwise(leaf))
    department = F.coalesce(tok["department"], F.lit("Unclassified"))
    inside = lambda c: F.when(F.lit(apart) & F.col("sensitivity").eqNullSafe("restricted"), F.concat(F.lit(at["restricted"] + "/"), c)).otherwise(c)
    return (
        F.when(F.col("duplicate_of").isNotNull(), inside(F.concat(F.lit(at["duplicates"] + "/"), name)))
        .when(F.coalesce("noise", F.lit(False)), F.concat(F.lit(at["noise"] + "/"), name))
        .when(F.coalesce("review", F.lit(False)), inside(F.concat(F.lit(at["review"] + "/"), file_name(department), F.lit("/"), name)))
        .otherwise(inside(laid))
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "n") -> DataFrame:
    """Adds each row's place (from 1) among the rows with equal keys, for keys with any share of all rows.

    Rows are split by ranges of (keys, order); inside a range places come from a window over the range and the
    keys, and the rows of a key in earlier ranges are added from counts.
    """
    split = cut(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    counts = split.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return split.withColumn("_inside", inside).join(before, [*keys, "_range"]).withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_range")


def unique_targets(df: DataFrame, column: str = "target", order: Sequence[str] = ("path", "file_id")) -> DataFrame:
    """The rows with targets that differ, case ignored: of equal ones the first in order keeps its name, the others get `` (n)`` before the extension.

    A name made up here that another row has is given another number, until none is left twice.
    """
    base = df.withColumn("_base", F.col(column)).withColumn("_key", F.lower(F.col(column)))
    now = numbered(base, ["_key"], list(order), "_n")
    while True:
        suffix = F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))
        leaf = F.substring_index("_base", "/", -1)
        folder = F.substring(F.col("_base"), F.lit(1), F.length("_base") - F.length(leaf))
        name = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat(folder, stem(leaf), suffix, extension(leaf)))
        named = cut(now.withColumn(column, name).withColumn("_made", F.lower(F.col(column))))
        # of rows with one name the one that has it by nature keeps it, then the least number, then the order
        keep = F.min(F.struct((F.col("_n") > 1).alias("made"), "_n", "_key", *order)).alias("_keep")
        twice = named.groupBy("_made").agg(F.count("*").alias("_c"), keep).filter("_c > 1").select("_made", "_keep")
        again = named.join(twice, "_made").filter((F.col("_n") > 1) & (F.struct((F.col("_n") > 1).alias("made"), "_n", "_key", *order) != F.col("_keep"))).select("_key", F.col("_n").alias("_taken")).distinct()
        again = cut(again)
        if again.isEmpty():
            return named.drop("_base", "_key", "_n", "_made")
        # skip the numbers that are taken: everything from there on moves up by one
        first = again.groupBy("_key").agg(F.min("_taken").alias("_taken"))
        now = named.join(first, "_key", "left").withColumn("_n", F.when(F.col("_n") >= F.col("_taken"), F.col("_n") + 1).otherwise(F.col("_n"))).drop("_taken", "_made").withColumn(column, F.col("_base"))


def why_restricted() -> Column:
    """The reasons, as text, for which a restricted file is restricted."""
    n = lambda k: F.coalesce(F.try_element_at("detected", F.lit(k)), F.lit(0))
    kinds = F.array_distinct(F.transform("pii_columns", lambda p: F.replace(p["data"], F.lit("_"), F.lit(" "))))
    reasons = F.concat_ws(
        "; ", F.when(n("secret") > 0, "secrets"), F.when(n("card") > 0, "card numbers"), F.when(n("national_id") > 0, "national ID numbers"), F.when(F.coalesce(F.col("flags.credentials"), F.lit(0.0)) >= 0.5, "credentials"),
        F.when(F.coalesce(F.col("flags.payment_details"), F.lit(0.0)) >= 0.5, "payment details"), F.when(F.coalesce(F.col("flags.personal_data"), F.lit(0.0)) >= 0.5, "personal data"), F.when(F.size(kinds) > 0, F.concat(F.lit("columns with "), F.array_join(kinds, ", "))),
    )
    return F.when(reasons == "", "judged by its content").otherwise(reasons)


CSV_COLUMNS = ("path", "target_path", "department", "doc_type", "sensitivity", "doc_date", "counterparty", "tags", "title", "department_confidence", "type_confidence", "sensitivity_confidence", "review", "noise", "duplicate_of", "personal_data", "credentials", "payment_details", "pii_columns", "detected", "kind", "size", "sha256", "extract_error")


def flat(df: DataFrame) -> DataFrame:
    """The catalogue's 24 columns for a spreadsheet: lists and maps as text."""
    made = {
        "tags": F.array_join("tags", "; "), "personal_data": F.col("flags.personal_data"), "credentials": F.col("flags.credentials"), "payment_details": F.col("flags.payment_details"),
        "pii_columns": F.array_join(F.transform("pii_columns", lambda p: F.concat(p["name"], F.lit("="), p["data"])), "; "),
        "detected": F.array_join(F.transform(F.array_sort(F.map_entries("detected")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), "; "),
    }
    return df.select(*(made.get(c, F.col(c)).alias(c) for c in CSV_COLUMNS))


# ---- evaluation against labels


def same_org(a: Column, b: Column) -> Column:
    """Both missing, equal after letters and digits only, or (both longer than four) one inside the other."""
    x, y = (F.regexp_replace(F.lower(c), "[^a-z0-9]+", "") for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    return (a.isNull() & b.isNull()) | F.coalesce(both & ((x == y) | ((F.length(x) > 4) & (F.length(y) > 4) & (F.contains(x, y) | F.contains(y, x)))), F.lit(False))


def compared(catalog: DataFrame, labels: DataFrame) -> DataFrame:
    """The catalogue's rows with a label, label fields prefixed by l_, and what is right of each."""
    l = labels.select("path", *(F.col(c).alias(f"l_{c}") for c in ("department", "doc_type", "sensitivity", "doc_date", "counterparty", "noise", "duplicate_of")))  # noqa: E741
    level = lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), F.col(c))
    eq = lambda c: F.col(c).eqNullSafe(F.col(f"l_{c}"))
    return catalog.join(l, "path").withColumns({
        "ok_department": eq("department"), "ok_type": eq("doc_type"), "ok_sensitivity": eq("sensitivity"), "near_sensitivity": F.coalesce(F.abs(level("sensitivity") - level("l_sensitivity")) <= 1, F.lit(False)),
        "ok_date": eq("doc_date"), "ok_counterparty": same_org(F.col("counterparty"), F.col("l_counterparty")), "base": F.col("l_duplicate_of").isNull() & ~F.coalesce("l_noise", F.lit(False)),
    })


def metrics(rows: DataFrame) -> DataFrame:
    """(metric, correct, of, pct) from one pass over compared rows."""
    base, review = F.col("base"), F.coalesce("review", F.lit(False))
    r, lr = F.col("sensitivity").eqNullSafe("restricted"), F.col("l_sensitivity").eqNullSafe("restricted")
    noise, lnoise = F.coalesce("noise", F.lit(False)), F.coalesce("l_noise", F.lit(False))
    sets = {
        "department": ("ok_department", base), "department, not in review": ("ok_department", base & ~review), "type": ("ok_type", base), "type, not in review": ("ok_type", base & ~review), "sensitivity": ("ok_sensitivity", base), "sensitivity within one level": ("near_sensitivity", base),
        "restricted recall": (r, base & lr), "restricted precision": (lr, base & r), "date": ("ok_date", base), "date, when labelled": ("ok_date", base & F.col("l_doc_date").isNotNull()), "counterparty": ("ok_counterparty", base), "counterparty, when labelled": ("ok_counterparty", base & F.col("l_counterparty").isNotNull()),
        "noise found": (noise, lnoise), "duplicates found": (F.col("duplicate_of").isNotNull(), F.col("l_duplicate_of").isNotNull()), "sent to review": (review, base),
    }
    aggs = [x for k, (ok, of) in enumerate(sets.values()) for x in (F.count_if(of & (F.col(ok) if isinstance(ok, str) else ok)).alias(f"c{k}"), F.count_if(of).alias(f"o{k}"))]
    one = rows.agg(*aggs)
    long = one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), F.col(f"c{k}").alias("correct"), F.col(f"o{k}").alias("of")) for k, name in enumerate(sets)))).alias("m")).select("m.*")
    return long.withColumn("pct", F.when(F.col("of") > 0, F.floor(1000.0 * F.col("correct") / F.col("of") + 0.5) / 10))


def misses(rows: DataFrame) -> DataFrame:
    """(file_id, path, miss): one row for each field of a compared row that is wrong."""
    said = lambda name, ok, c: F.when(~F.col(ok), F.concat(F.lit(f"{name} "), F.coalesce(c, F.lit("none")), F.lit(", not "), F.coalesce(f"l_{c}", F.lit("none"))))
    all_of = F.array(said("department", "ok_department", "department"), said("type", "ok_type", "doc_type"), said("sensitivity", "ok_sensitivity", "sensitivity"), said("date", "ok_date", "doc_date"), said("counterparty", "ok_counterparty", "counterparty"))
    return rows.filter("base").select("file_id", "path", F.explode(F.filter(all_of, lambda x: x.isNotNull())).alias("miss"))


def unlabelled(catalog: DataFrame, labels: DataFrame) -> DataFrame:
    return catalog.join(labels.select("path").distinct(), "path", "left_anti")


def missing(catalog: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels without a row in the catalogue."""
    return labels.join(catalog.select("path").distinct(), "path", "left_anti")


# ---- cache and estimate


def cache_misses(work: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return work.join(cache.select(key).distinct(), key, "left_anti")


def estimate(work: DataFrame, chars: str = "chars") -> DataFrame:
    """(files, tokens): what asking about all rows would take, by rule of thumb on the sum of characters."""
    return work.agg(F.count("*").alias("files"), F.floor(F.coalesce(F.sum(chars), F.lit(0)) / 3.2 + 0.5).cast("bigint").alias("tokens"))


def confidence(df: DataFrame) -> DataFrame:
    """(file_id, confidence): the least of the three confidences, to three decimals."""
    return df.select("file_id", rounded(F.least("department_confidence", "type_confidence", "sensitivity_confidence")).alias("confidence"))
