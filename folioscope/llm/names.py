"""Spellings of the names of organisations and people that mean the same party.

Each distinct spelling becomes a form: proper words, initials and line of business, without legal
form, titles, remarks and punctuation.  Spellings of one form are one class.

Classes at an edit distance of at most :data:`RADIUS` are linked by partitions of the metric space
(unrestricted Damerau-Levenshtein, a true metric).  A shard holds the classes with one proper word
in common.  In a shard with more than :data:`CELL` points, a square root of them become pivots;
every point goes to the cell of its nearest pivot and, by the triangle inequality, to each cell
whose pivot is at most twice the radius further away, so that any two points within the radius
meet in a cell.  Inside a cell the join is exact.

A form with one proper word, with or without an initial, is linked to the full forms that have this
word and the same line of business if all of those are one party; so is a short given name that may
stand for several given names.  Linked classes are one party.

Defined cases: null and blank names are in no class; a name without any letter or digit is a class
of its own; repeated rows count once; extra columns are ignored; an ambiguous short form is linked
to nothing.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.graph import components, cut

RADIUS, CELL = 1, 400

#: Legal forms without dots and blanks.
LEGAL = {"inc", "incorporated", "llc", "llp", "lp", "ltd", "limited", "plc", "corp", "corporation", "gmbh", "mbh", "gesellschaftmbh", "ag", "kg", "ohg", "ug", "ev", "gbr", "sa", "sas", "sarl", "sasu", "snc", "sl", "slu", "sociedadlimitada", "sociedadanonima", "spa", "srl", "bv", "nv", "oy", "ab", "as", "aps"}
#: Lines of business and the short forms that do not begin like them.
BUSINESS = {
    "associates": "", "brothers": "bros", "company": "co", "consulting": "", "distribution": "", "engineering": "", "group": "grp", "holdings": "hldgs", "industries": "", "international": "intl", "logistics": "", "manufacturing": "mfg", "marine": "", "packaging": "pkg", "partners": "", "services": "svcs", "solutions": "", "supplies": "", "systems": "", "technologies": "", "textiles": "", "trading": "",
    "gebruder": "", "handelsgesellschaft": "", "maschinenbau": "", "spedition": "", "verpackungen": "",
    "compagnie": "cie", "etablissements": "ets", "freres": "", "materiaux": "", "transports": "",
    "compania": "cia", "distribuciones": "", "hermanos": "hnos", "suministros": "",
}
#: Titles and words that announce a name.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "herrn", "frau", "m", "mme", "mlle", "monsieur", "madame", "sr", "sra", "srta", "don", "dona", "senor", "senora", "messrs", "the", "fa", "firma", "attn", "z hd"}
#: Given names and what people call their bearers.
SHORT = {
    "alexander": "alex sandy al", "andrew": "andy drew", "anthony": "tony", "antonia": "toni", "benjamin": "ben", "catherine": "kate cathy kitty", "charles": "charlie chuck chas", "christopher": "chris kit", "daniel": "dan danny", "dorothy": "dot dottie dolly", "edward": "ed eddie ned ted", "elizabeth": "liz beth betty eliza lizzie", "francis": "frank", "francisco": "paco pancho curro", "frederick": "fred freddie", "friedrich": "fritz", "henry": "hal harry hank", "james": "jim jimmy jamie", "johannes": "hannes hans", "john": "jack johnny", "jose": "pepe", "joseph": "joe joey", "katherine": "kate kathy kitty katie", "lawrence": "larry", "ludwig": "lutz", "manuel": "manolo", "margaret": "maggie meg peggy greta", "matthew": "matt", "michael": "mike mick", "nicholas": "nick", "patricia": "pat patty", "richard": "dick rick rich", "robert": "bob rob bobby", "samuel": "sam", "stephen": "steve", "susanna": "sue susie sanna", "theodore": "theo ted teddy", "thomas": "tom tommy", "william": "will bill billy willy",
}
_BY_SHORT: dict[str, set[str]] = defaultdict(set)
for _full, _shorts in SHORT.items():
    for _s in _shorts.split():
        _BY_SHORT[_s].add(_full)
_ABBREVIATED = {s: w for w, s in BUSINESS.items() if s}
_TWO_WORDS = {("gesellschaft", "mbh"), ("sociedad", "limitada"), ("sociedad", "anonima")}
_FIGURES = str.maketrans("0135", "oles")
_LINK = {"and", "und", "et", "y", "e", "en"}


def _plain(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x.lower().replace("ß", "ss")) if not unicodedata.combining(c))


def _business(word: str, dotted: bool) -> str | None:
    """The line of business that a word or its short form names."""
    if word in BUSINESS:
        return word
    if word in _ABBREVIATED:
        return _ABBREVIATED[word]
    bare = word.replace(".", "")
    if dotted and len(bare) >= 3:
        head, _, tail = word.partition(".")
        for w in BUSINESS:
            if w.startswith(head) and (not tail or w.endswith(tail)) and len(w) > len(bare):
                return w
    if len(word) >= 3 and not dotted:
        found = [w for w in BUSINESS if w.startswith(word) and len(w) > len(word) + 1]
        if found and word in ("dist", "eng", "log", "sup", "sped", "tech", "text", "verp", "transp", "distrib", "gebr", "mat", "sum", "assoc", "handelsges"):
            return found[0]
    if "ue" in word or "ae" in word or "oe" in word:
        flat = word.replace("ue", "u").replace("ae", "a").replace("oe", "o")
        if flat in BUSINESS:
            return flat
    return None


def form(name: str | None) -> tuple[list[str], list[str], str]:
    """(proper words, initials, line of business) of one spelling; the words in their order, the lines of business sorted."""
    x = html.unescape(html.unescape(name or "")).replace(" ", " ")
    x = _plain(x)
    x = re.sub(r"\bc\s?/\s?o\b", " ", x)
    x = re.split(r"\b(?:t/a|d/?b/?a|trading as|formerly)\b", x)[0]
    x = re.sub(r"[\[{*<][^\]}*>]*[\]}*>]", " ", x)
    x = re.sub(r"\(([^()]*)\)", lambda m: f" {m[1]} " if re.sub(r"[\s.]", "", m[1]) in LEGAL else " ", x)
    x = re.sub(r"\s[-–]\s+(?:[a-z]+ ?){1,2}\s*$", " ", x)
    # the dots and blanks inside a legal form's letters
    x = re.sub(r"(?<![\w.])(?:[a-z]\.\s?){2,}[a-z]?\.?(?!\w)", lambda m: " " + re.sub(r"[\s.]", "", m[0]) + " " if re.sub(r"[\s.]", "", m[0]) in LEGAL else m[0], x)
    out: list[tuple[str, bool]] = []
    for k, part in enumerate(x.split(",")):
        if k and out and out[-1][0] in LEGAL and not any(w in LEGAL for w in re.findall(r"[a-z]+", part)):
            break  # a town after the legal form
        for w in re.findall(r"[^\W_]+(?:[.'’][^\W_]+)*\.?", part):
            dotted = "." in w
            w = w.rstrip(".") if w.count(".") == 1 and w.endswith(".") else w
            out.append((w.replace("'", "").replace("’", ""), dotted))
    words, initials, lines = [], [], []
    k = 0
    while k < len(out):
        w, dotted = out[k]
        if k + 1 < len(out) and (w, out[k + 1][0]) in _TWO_WORDS:
            k += 2
            continue
        k += 1
        bare = w.replace(".", "")
        if bare in LEGAL or (w in _LINK and not dotted and 1 < k < len(out)):
            continue
        if line := _business(w, dotted):
            lines.append("distribution" if line == "distribuciones" else line)
        elif len(bare) == 1:
            if bare.isalpha():
                initials.append(bare)
        elif w in TITLES and (dotted or w not in ("m",)):
            continue
        else:
            if re.search(r"[a-z]", bare):  # figures read for letters
                bare = bare.translate(_FIGURES)
            full = _BY_SHORT.get(bare)
            words.append(next(iter(full)) if full and len(full) == 1 and not lines else bare)
    if not words and initials and lines:
        words, initials = initials, []
    return words, initials, " ".join(sorted(lines))


def class_key(name: str | None) -> str:
    """The class of a spelling: its words sorted, an initial only where it stands for a missing word, its line of business."""
    words, initials, line = form(name)
    if not words and not line:
        return "\t".join(["", "", "".join(sorted((name or "").split()))])
    return "\t".join([" ".join(sorted(words)), initials[0] if len(words) == 1 and initials else "", line])


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insertions, deletions, substitutions and swaps, a metric."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2), [top, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        d.append([top, i] + [0] * len(b))
        hit = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), hit
            cost = x != y
            if not cost:
                hit = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


def within_one(a: str, b: str) -> bool:
    """distance(a, b) <= 1."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def near(points: list[str]) -> set[tuple[int, int]]:
    """Index pairs (i < j) of the points of one cell within the radius 1, exactly: two such strings have a deletion of one character in common."""
    by: dict[str, list[int]] = defaultdict(list)
    for k, p in enumerate(points):
        for x in {p, *(p[:i] + p[i + 1 :] for i in range(len(p)))}:
            by[x].append(k)
    out = set()
    for ks in by.values():
        for n, i in enumerate(ks):
            for j in ks[n + 1 :]:
                if (i, j) not in out and within_one(points[i], points[j]):
                    out.add((i, j))
    return out


def _points(key: str) -> list[tuple[str, str]]:
    """(shared word, rest) for each proper word of a class; the rest in each order that its words can take."""
    words, initial, line = key.split("\t")
    parts = words.split()
    out = []
    for w in set(parts):
        rest = list(parts)
        rest.remove(w)
        orders = [rest] if len(rest) < 2 else [rest[k:] + rest[:k] for k in range(len(rest))]
        for o in orders:
            if o or line:
                out.append((w, " ".join([*o, *([initial] if initial else []), line]).strip()))
    return out


def _classes(names: DataFrame) -> DataFrame:
    """Rows (name, key) of the distinct names."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([class_key(x) for x in b.column(0).to_pylist()], pa.string())], names=["name", "key"])

    return names.mapInArrow(scan, "name string, key string")


def _exploded(keys: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, r, k) for k in b.column(0).to_pylist() for w, r in _points(k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], pa.string()) for x in range(3)], names=["word", "point", "key"])

    return keys.mapInArrow(scan, "word string, point string, key string")


def _cells(points: DataFrame) -> DataFrame:
    """Rows (word, cell, point, key): the cells of the shards that are larger than CELL; a smaller shard is one cell."""
    sizes = points.groupBy("word").agg(F.count("*").alias("n"), F.min("point").alias("least"))
    small = points.join(sizes.filter(F.col("n") <= CELL).select("word"), "word").select("word", F.lit("").alias("cell"), "point", "key")
    large = points.join(sizes.filter(F.col("n") > CELL), "word")
    # about a square root of the shard's points, chosen by their hash, and at least one
    chosen = (F.pmod(F.xxhash64("point"), F.col("n")) < F.ceil(F.sqrt("n"))) | (F.col("point") == F.col("least"))
    pivots = large.filter(chosen).groupBy("word").agg(F.collect_set("point").alias("pivots"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, p, k, pivots in zip(*(b.column(x).to_pylist() for x in range(4))):
                d = [distance(p, v) for v in pivots]
                limit = min(d) + 2 * RADIUS
                rows += [(w, v, p, k) for v, x in zip(pivots, d) if x <= limit]
            yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], pa.string()) for x in range(4)], names=["word", "cell", "point", "key"])

    split = large.select("word", "point", "key").join(pivots, "word").mapInArrow(assign, "word string, cell string, point string, key string")
    return small.unionByName(split)


def _near_links(cells: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: classes within the radius."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        at: tuple[str, str] | None = None

        def links(rows: list[tuple[str, str]]) -> pa.RecordBatch:
            pairs = {(min(x, y), max(x, y)) for i, j in near([p for p, _ in rows]) for x, y in [(rows[i][1], rows[j][1])] if x != y}
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in sorted(pairs)], pa.string()) for k in range(2)], names=["a", "b"])

        for b in batches:
            for w, c, p, k in zip(*(b.column(x).to_pylist() for x in range(4))):
                if (w, c) != at:
                    if len(held) > 1:
                        yield links(held)
                    held, at = [], (w, c)
                held.append((p, k))
        if len(held) > 1:
            yield links(held)

    return cells.distinct().repartition("word", "cell").sortWithinPartitions("word", "cell").mapInArrow(join, "a string, b string").distinct()


def _short_links(keys: DataFrame, parties: DataFrame) -> DataFrame:
    """(a, b): classes with one proper word, or an ambiguous short given name, and the least class of the only party they can mean."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key in b.column(0).to_pylist():
                words, initial, line = key.split("\t")
                parts = words.split()
                if len(parts) == 1 and (initial or line):
                    rows.append((parts[0], line, key, initial))
                elif len(parts) == 2 and not line:
                    rows += [(parts[1 - k], line, key, w) for k, w in enumerate(parts) if w in _BY_SHORT]
            yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], pa.string()) for x in range(4)], names=["word", "line", "key", "short"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, party in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, _, line = key.split("\t")
                parts = words.split()
                if len(parts) >= 2:
                    rows += [(w, line, o, party) for w in set(parts) for o in parts if o != w and (line or o not in _BY_SHORT)]
            yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], pa.string()) for x in range(4)], names=["word", "line", "other", "party"])

    short = keys.mapInArrow(scan, "word string, line string, key string, short string")
    full = parties.mapInArrow(others, "word string, line string, other string, party string").distinct()
    given = F.create_map(*(x for s, f in sorted(_BY_SHORT.items()) for x in (F.lit(s), F.array(*map(F.lit, sorted(f))))))
    bearers = F.coalesce(F.try_element_at(given, F.col("short")), F.array().cast("array<string>"))
    stands = F.when(F.col("short") == "", True).when(F.length("short") == 1, F.col("other").startswith(F.col("short"))).otherwise(F.array_contains(bearers, F.col("other")))
    meant = short.join(full, ["word", "line"]).filter(F.col("party") != F.col("key")).filter(stands)
    return meant.groupBy("key").agg(F.min("party").alias("a"), F.max("party").alias("z")).filter("a = z").select(F.col("key").alias("a"), F.col("a").alias("b"))


def parties(names: DataFrame) -> DataFrame:
    """Rows (name, party), one for each distinct non-null name of the one-column table: all spellings of a party have the same value."""
    spelled = cut(_classes(names.toDF("name").filter(F.trim("name") != "").distinct()))
    keys = spelled.select("key").distinct()
    links = cut(_near_links(_cells(_exploded(keys))))
    linked = components(links)
    first = cut(keys.join(linked.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("party")))
    # a short form's party joins the party it can only mean
    more = _short_links(keys, first).withColumnRenamed("a", "key").join(first, "key").select(F.col("party").alias("a"), "b").distinct()
    joined = components(more).toDF("party", "merged")
    final = first.join(joined, "party", "left").select("key", F.coalesce("merged", "party").alias("party"))
    return spelled.join(final, "key").select("name", "party")


def same_party(names: DataFrame) -> DataFrame:
    """Distinct pairs (name_a, name_b), name_a < name_b by UTF-8 bytes, of the spellings of one party."""
    p = cut(parties(names))
    return p.select(F.col("name").alias("name_a"), "party").join(p.select(F.col("name").alias("name_b"), "party"), "party").filter("name_a < name_b").select("name_a", "name_b")
