"""Text functions on columns: ASCII word bounds, blanks, titles, clipping, sizes, markup, delimiters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts count it (also no-break and typographic blanks), for use inside a character class.
BLANKS = r"\s" + "".join(map(chr, (0xA0, 0x1680))) + f"{chr(0x2000)}-{chr(0x200A)}" + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: A word's bound by ASCII letters, digits and the underscore; Java's own \b also counts other letters.
BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, or of one of its groups, in their order; empty for a null text."""
    t = _col(text)
    # the test spares texts without a match the work of the list
    return F.when(t.rlike(pattern), F.regexp_extract_all(t, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def replaced(text: Column | str, pattern: str, new, valid=None) -> Column:
    """The text with each match m replaced by new(m) where valid(m); a null text stays null."""
    t = _col(text)
    keep = (lambda m: new(m)) if valid is None else (lambda m: F.when(valid(m), new(m)).otherwise(m))
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    parts = F.split(t, pattern, -1)
    joined = F.array_join(F.zip_with(parts, F.transform(found, keep), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(t.rlike(pattern), joined).otherwise(t)


def squeezed(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(text), f"[{BLANKS}]+", " "), r"^ | \z", "")


def first_line(text: Column | str, most: int = 120) -> Column:
    """The first line with more than two characters after its list or heading marks, cut; null if there is none."""
    lines = F.transform(F.split(_col(text), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, rf"^[#>*\-{BLANKS}]+", ""), rf"[{BLANKS}]+\z", ""))
    return F.substring(F.get(F.filter(lines, lambda x: F.length(x) > 2), F.lit(0)), 1, most)


def clipped(text: Column | str, most: int = 6000) -> Column:
    """A longer text's first three quarters and its end, with a note of what was left out between."""
    t, head = _col(text), most * 3 // 4
    note = F.concat(F.lit("\n[... "), F.format_number(F.length(t) - most, 0), F.lit(" characters skipped ...]\n"))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, head), note, F.right(t, F.lit(most - head))))


def human_size(n: Column | str) -> Column:
    x = _col(n)
    return F.when(x < 1024, F.format_string("%d B", x.cast("bigint"))).when(x < 1048576, F.format_string("%.1f KB", x / 1024)).otherwise(F.format_string("%.1f MB", x / 1048576))


def rounded(x: Column | str) -> Column:
    """To three decimals, halves up."""
    return F.floor(_col(x) * 1000 + 0.5) / 1000


def tokens_estimated(chars: Column | str) -> Column:
    """Tokens by rule of thumb: characters by 3.2, rounded."""
    return F.floor(_col(chars) / 3.2 + 0.5).cast("bigint")


def html_to_text(html: Column | str) -> Column:
    """Readable text of markup: without scripts and comments, a line's end for each closed block, the common entities decoded."""
    t = _col(html)
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript|svg)\b.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|section|article|li|tr|h[1-6]|table|ul|ol|header|footer|blockquote)>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("amp", "&")):
        t = F.regexp_replace(t, f"&{name};", char)
    t = F.regexp_replace(t, r"[ \t\f\u00a0]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" ?\r?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, rf"^[{BLANKS}]+|[{BLANKS}]+\z", "")


def html_title(html: Column | str) -> Column:
    """The first title element's text, null if there is none."""
    t = F.regexp_extract(_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(squeezed(t), F.lit(""))


def delimiter(text: Column | str) -> Column:
    """Which of , ; tab | stands most often in the first five lines; at a tie the earlier of these."""
    head = F.array_join(F.slice(F.split(_col(text), "\n"), 1, 5), "\n")
    counts = [F.struct(F.regexp_count(head, F.lit(rx)).alias("n"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, (c, rx) in enumerate(((",", ","), (";", ";"), ("\t", "\t"), ("|", r"\|")))]
    return F.array_max(F.array(*counts))["c"]


def glob_pattern(glob: str) -> str:
    """A pattern for a whole name: * for any characters, ? for one, case ignored."""
    return "(?i)\\A" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".+^${}()|[]\\" else c for c in glob) + "\\z"


def file_name(name: Column | str) -> Column:
    """A name that every file system takes: forbidden characters as a hyphen, no blanks or dots at the ends, at most 80 characters."""
    t = F.regexp_replace(_col(name), "[/\\\\:*?\"<>|\\x00-\\x1f]", "-")
    t = F.regexp_replace(F.regexp_replace(t, f"[{BLANKS}]+", " "), rf"^[.{BLANKS}]+|[.{BLANKS}]+\z", "")
    t = F.substring(t, 1, 80)
    return F.when(F.coalesce(t, F.lit("")) == "", "_").otherwise(t)


def extension(name: Column | str) -> Column:
    """From the last dot on, but not if that is the first character; else empty."""
    return F.regexp_extract(_col(name), r"(?s)^.+(\.[^./]*)\z", 1)


def stem(name: Column | str) -> Column:
    n = _col(name)
    return F.substring(n, F.lit(1), F.length(n) - F.length(extension(n)))
