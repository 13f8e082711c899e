"""Values that a text offers for its date and its counterparty, with the words around them; and what the corpus says about names.

Nothing is invented: every candidate is a stretch of the text.  Null texts offer nothing.
"""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The months by the first letters of their names in English, German, Dutch, French, Spanish, Italian.
MONTHS = {
    1: "jan gen ene jän janv", 2: "feb fév fev", 3: "mar mär mrt maa", 4: "apr avr abr", 5: "may mai mei mag", 6: "jun jui giu", 7: "jul lug", 8: "aug aoû aou ago", 9: "sep set", 10: "oct okt ott", 11: "nov", 12: "dec dez déc dic",
}
_MONTH = {w: m for m, ws in MONTHS.items() for w in ws.split()}
_WORD = "([A-Za-zÀ-ÿ]{3,10})"
_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: The finders in their order: (pattern, groups of year, month, day, whether the month is a word).
FINDERS = (
    (_B + r"(\d{4})-(\d{2})-(\d{2})(?:[T ]\d{2}:\d{2})?", (1, 2, 3), False),
    (_B + r"(\d{1,2})(?:st|nd|rd|th)?\.?\s+(?:of\s+)?" + _WORD + r"\.?,?\s+(\d{4})" + _B, (3, 2, 1), True),
    (_B + _WORD + r"\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _B, (3, 1, 2), True),
    (_B + r"(\d{1,2})[/.](\d{1,2})[/.](\d{4})" + _B, (3, 2, 1), False),
    (_B + r"(\d{4})[/.](\d{1,2})[/.](\d{1,2})" + _B, (1, 2, 3), False),
)


def month_of(word: Column) -> Column:
    """The number of a month's name by its first four or three letters; null for none."""
    w = F.lower(word)
    months = F.create_map(*(F.lit(x) for kv in sorted(_MONTH.items()) for x in kv))
    return F.when(w.startswith("juil"), 7).when(w.startswith("juin"), 6).otherwise(F.coalesce(F.try_element_at(months, F.substring(w, 1, 4)), F.try_element_at(months, F.substring(w, 1, 3))))


def iso(y: Column, m: Column, d: Column) -> Column:
    """An ISO date as text, only its parts' ranges checked; null beyond them."""
    y, m, d = (x.cast("int") for x in (y, m, d))
    return F.when(y.between(1980, 2100) & m.between(1, 12) & d.between(1, 31), F.format_string("%d-%02d-%02d", y, m, d))


def date_values(text: Column | str, order: str = "dmy") -> Column:
    """The distinct dates of a text as ISO text, finder by finder."""
    t = F.col(text) if isinstance(text, str) else text
    found = []
    for k, (pattern, (y, m, d), named) in enumerate(FINDERS):
        if k == 3 and order == "mdy":
            m, d = d, m
        parts = F.arrays_zip(*(F.regexp_extract_all(t, F.lit(pattern), F.lit(g)).alias(n) for n, g in (("y", y), ("m", m), ("d", d))))
        by_word = (lambda x: iso(x["y"], month_of(x["m"]), x["d"])) if named else (lambda x: iso(x["y"], x["m"], x["d"]))
        values = F.transform(parts, by_word)
        found.append(F.when(t.rlike(pattern), values).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.concat(*found), lambda x: x.isNotNull()))


# ---- with contexts, as Arrow functions

_RX = [re.compile(p, re.ASCII) for p, _, _ in FINDERS]


def _iso(y: str, m: int | str | None, d: str) -> str | None:
    if m is None:
        return None
    y, m, d = int(y), int(m), int(d)
    return f"{y}-{m:02}-{d:02}" if 1980 <= y <= 2100 and 1 <= m <= 12 and 1 <= d <= 31 else None


def _month(w: str) -> int | None:
    w = w.lower()
    return 7 if w.startswith("juil") else 6 if w.startswith("juin") else _MONTH.get(w[:4]) or _MONTH.get(w[:3])


def _context(text: str, s: int, e: int, before: int) -> str:
    return re.sub(r"\s+", " ", text[max(0, s - before) : e + 25]).strip()


def dates_in(text: str | None, order: str = "dmy", most: int = 25) -> list[tuple[str, str]]:
    """(date, words around its first place).  Each finder stops once so many are found, so later ones may still add one each."""
    found: dict[str, str] = {}
    for k, (rx, (_, (y, m, d), named)) in enumerate(zip(_RX, FINDERS)):
        if k == 3 and order == "mdy":
            m, d = d, m
        for x in rx.finditer(text or ""):
            value = _iso(x[y], _month(x[m]) if named else x[m], x[d])
            if not value or value in found:
                continue
            found[value] = _context(text, x.start(), x.end(), 50)
            if len(found) >= most:
                break
    return list(found.items())


#: Legal forms; words that stand before a name without being part of it; what a company's name may end in.
SUFFIX = r"(?:Ltd\.?|Limited|LLP|LLC|L\.L\.C\.|Inc\.?|Incorporated|Corp\.?|Corporation|Co\.|Company|GmbH|AG|KG|B\.?V\.?|N\.?V\.?|S\.A\.S\.?|SAS|S\.L\.|S\.A\.?|SA|SARL|S\.?r\.?l\.?|S\.?p\.?A\.?|PLC|plc|Pty(?:\.? Ltd\.?)?|Oy|AB|ApS|AS|A/S|Group|Holdings|Partners)"
LEAD = "The From To Between And Dear Attn Re Invoice Bill Ship Sold Supplier Customer Client Vendor Buyer Seller Party Parties Page Our Your This For Order Quote Purchase Payment Agreement Contract Statement Receipt"
TRADES = "Logistics Services Textiles Packaging Supplies Solutions Systems Consulting Trading Studio Printing Media Technologies Labs Bank Insurance Properties Associates Accountants Recruitment Agency Foods Freight Couriers Cleaning Stores Manufacturing Industries Distribution Wholesale Networks Software Analytics Ventures Capital Investments Architects Engineering Construction Energy Healthcare Travel Hotels Motors Interiors Laboratories Transport Haulage Brothers Maschinenbau Spedition Verpackungen Handelsgesellschaft"
COMMON = "the our your their this that a an and for from to of in on at by with customer customers client clients business professional financial support it technical cloud digital data online field product sales marketing account accounts shared internal external general other all new key total monthly annual additional logistics delivery shipping payment security legal hr people team staff employee company head main regional local national global website email office warehouse retail wholesale print media travel energy health property insurance software systems services solutions supplies trading distribution transport"
_NAME = r"(?:[A-Z][\w'’.-]*|&|and|of|de|van|der|den|la|le|du)"
_ORG = re.compile(rf"{_B}([A-Z][\w'’.-]*(?: {{1,2}}{_NAME}){{0,5}}?) {{1,2}}({SUFFIX})(?!\w)")
_AMP = re.compile(rf"(?<!&)(?<!& )(?<!&  ){_B}([A-Z][A-Za-z'’-]+(?: {{1,2}}[A-Z][A-Za-z'’-]+){{0,3}} {{1,2}}& {{1,2}}(?:Co{_B}\.?|Sons{_B}|Partners{_B}|Associates{_B}|[A-Z][A-Za-z'’-]+)(?: {{1,2}}[A-Z][A-Za-z'’-]+){{0,2}})", re.ASCII)
_TRADE = re.compile(rf"(?<!&)(?<!& )(?<!&  ){_B}((?:[A-Z][A-Za-z'’-]+ {{1,2}}){{1,4}}(?:{TRADES.replace(' ', '|')})){_B}", re.ASCII)
_LEAD = re.compile(rf"(?:{LEAD.replace(' ', '|')})\s+", re.I)
_TITLE = re.compile(_B + r"(?:Manager|Director|Officer|Lead|Head|Assistant|Coordinator|Executive|Engineer|Analyst|Specialist|Administrator|Controller|Partner|Buyer|Planner|Supervisor|Associate|Intern|CEO|CFO|CTO|COO)\Z")
_END = re.compile(rf"[ \t]+{SUFFIX}\Z", re.I)
_COMMON = frozenset(COMMON.split())


def org_key(name: str) -> str:
    """One key for the spellings of a name with and without its legal form."""
    return re.sub(r"[^a-z0-9]+", " ", _END.sub("", name).lower().replace("&", " and ")).strip()


def without_suffix(name: str) -> str:
    s = _END.sub("", name).strip()
    return s if len(s.split(" ")) >= 2 or len(s) >= 6 else name


def orgs_in(text: str | None, known: list[str] | None = None, exclude: list[str] | None = None, most: int = 20) -> list[tuple[str, str]]:
    """(name, words around its first place), in the order of the text: fullest form of each key, fragments of longer names left out."""
    text = text or ""
    barred = [k for k in map(org_key, exclude or []) if k]
    found: dict[str, list] = {}

    def add(name: str, at: int, length: int) -> None:
        name = re.sub(r"[.,;:]\Z", "", re.sub(r"\s+", " ", name).strip())
        while m := _LEAD.match(name):
            name = name[m.end() :]
        words, key = name.split(" "), org_key(name)
        if len(words) < 2 or len(name) > 70 or not key or any(key == x or x in key or key in x for x in barred):
            return
        if all(w == "&" or re.sub("[^a-z]", "", w.lower()) in _COMMON for w in words) or _TITLE.search(name):
            return
        old = found.get(key)
        if old is None:
            found[key] = [name, _context(text, at, at + length, 40), at]
        elif len(name) > len(old[0]) or (len(name) == len(old[0]) and old[0].isupper() and not name.isupper()):
            old[0] = name

    low = text.lower()
    for name in known or []:
        if (at := low.find(name.lower())) >= 0:
            add(text[at : at + len(name)], at, len(name))
    for m in _ORG.finditer(text):
        add(f"{m[1]} {m[2]}", m.start(), len(m[0]))
    for rx in (_AMP, _TRADE):
        for m in rx.finditer(text):
            add(m[1], m.start(), len(m[0]))
    kept = [v for k, v in found.items() if not any(o != k and f" {k} " in f" {o} " for o in found)]
    return [(n, c) for n, c, _ in sorted(kept, key=lambda v: v[2])[:most]]


_CANDIDATES = "array<struct<value:string,context:string>>"


def _udf(find):  # noqa: ANN001, ANN202
    def scan(s: pd.Series) -> pd.Series:
        return pd.Series([[{"value": v, "context": c} for v, c in find(t)] for t in s], dtype=object)

    return F.pandas_udf(scan, _CANDIDATES)


def date_candidates(text: Column | str, order: str = "dmy", most: int = 25) -> Column:
    return _udf(lambda t: dates_in(t, order, most))(F.col(text) if isinstance(text, str) else text)


def org_candidates(text: Column | str, known: list[str] | None = None, exclude: list[str] | None = None, most: int = 20) -> Column:
    return _udf(lambda t: orgs_in(t, known, exclude, most))(F.col(text) if isinstance(text, str) else text)


def as_options(candidates: Column | str, none: str) -> Column:
    """Candidates as choices (id, description): c0, c1, ... and one for none of them."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    own = F.transform(c, lambda x, k: F.struct(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.concat(x["value"], F.lit('   (in: "...'), x["context"], F.lit('...")')).alias("description")))
    return F.concat(own, F.array(F.struct(F.lit("none").alias("id"), F.lit(none).alias("description"))))


# ---- the corpus


def mentions(df: DataFrame, id_col: str = "file_id", text_col: str = "text", most: int = 50, exclude: list[str] | None = None) -> DataFrame:
    """(id, name, key): the organisations that each text names."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, org_key(n)) for i, t in zip(b["id"], b["text"]) for n, _ in orgs_in(t, exclude=exclude, most=most)]
            yield pd.DataFrame(rows, columns=["id", "name", "key"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(scan, f"id {kind}, name string, key string").withColumnRenamed("id", id_col)


def company(df: DataFrame, share: float = 0.2, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(name, files, of) of the organisation that most texts name, if at least three and the share of them do; else no row."""
    m = mentions(df, id_col, text_col, most=30)
    per = m.groupBy(F.lower(F.regexp_replace("name", "[.,]", "")).alias("key")).agg(F.count_distinct(id_col).alias("files"), F.min("name").alias("name"))
    of = df.filter(F.length(F.trim(text_col)) > 0).agg(F.count_distinct(id_col).alias("of"))
    best = per.orderBy(F.desc("files"), "key").limit(1)
    return best.join(F.broadcast(of)).filter((F.col("files") >= 3) & (F.col("files") >= share * F.col("of"))).select("name", "files", "of")  # one row with one row


def entities(df: DataFrame, own: list[str] | None = None, most: int = 1000, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(name, n): the names that most texts hold, each also without its legal form, our own left out."""
    m = mentions(df, id_col, text_col, exclude=own)

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, x, org_key(x) + ("" if x == n else " ~")) for i, n in zip(b[id_col], b["name"]) for x in dict.fromkeys((n, without_suffix(n)))], columns=["id", "name", "key"])

    kind = m.schema[id_col].dataType.simpleString()
    forms = m.mapInPandas(both, f"id {kind}, name string, key string")
    return forms.groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("name").alias("name")).orderBy(F.desc("n"), "key").limit(most).select("name", "n")
