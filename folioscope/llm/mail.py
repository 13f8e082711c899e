"""Mail texts reduced to what their sender newly wrote.

Two sources of inherited text are removed.  *Earlier mails in the same text*: marked quotes, the
lines that introduce a quote, and header blocks with all that follows them.  *Earlier mails of the
same thread*: threads are rebuilt from reference headers (``In-Reply-To``, ``References``,
``Message-ID``) where a text has them, else from the subject without reply marks and the set of
participants; every run of :data:`SHINGLE` words of a mail is looked up, by a rolling hash, in the
earliest mail of its thread that holds it, the shared runs are chained in the order of both texts
(a sequence alignment), and lines that such a chain covers are taken out.  What is left of the
sender's own lines ends where the closing formula, the signature, a note of the mail program or a
disclaimer begins.

A thread may hold any share of all mails: the lookup is one aggregate per thread and run of words
(the earliest holder), never a comparison of all mails of a thread with each other.

Defined cases: a null or empty text, a text of headers only, and a forwarded mail without own words
give no line; repeated rows give their lines once; a mail without date is older than any other of
its thread only by its id; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a shingle, and the least words of an inherited run.
SHINGLE, LEAST_RUN = 8, 12

_MARK = re.compile(r"\s*[>»|](?!\w)|\s*[>»]")
_LABEL = re.compile(r"\s*\*?[^\W\d_][\w\-]*(?: [\w\-]+){0,2}\s?:(?:\s|\*|$)")
_FROM = re.compile(r"\s*\*?(?:from|von|de|da|van|od)\s?:", re.I)
_DASHED = re.compile(r"\s*-{3,}\s*[^\W\d_].{0,60}?\s*-{3,}\s*$")
_RULE = re.compile(r"\s*[-_=*~#—–]{1,}\s*$")
_DATE = r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,2}\.? (?:de )?[^\W\d_]{3,12}\.? (?:de )?\d{4}|[^\W\d_]{3,12}\.? \d{1,2}(?:st|nd|rd|th)?,? \d{4})"
_SAID = r"(?:wrote|writes|schrieb|a écrit|écrivait|escribió|ha scritto|schreef|escreveu)"
_INTRO = re.compile(
    rf"(?is)\s*(?:(?=.*{_DATE}).{{0,220}}?\b{_SAID}\b(?: (?:am|on|le|el)\b.{{0,60}})?\s?:|{_DATE},? \d{{1,2}}:\d{{2}} [-–] .{{2,160}}:|.{{2,160}} {_SAID} (?:am|on|le|el) {_DATE}\s?:)\s*\Z"
)
_INTRO_START = re.compile(rf"(?i)\s*(?:on|am|le|el|op|il|em)\s.*\d|\s*{_DATE},? \d{{1,2}}:\d{{2}} [-–] |.*\b{_SAID}\b|.*<[^<>\s]+@[^<>\s]+>")
_CLOSE = re.compile(
    r"(?i)(?:(?:kind(?:est)?|best|warm(?:est)?|with (?:kind|best))? ?regards|(?:all the )?best(?: wishes)?|(?:many|with)? ?thanks(?: (?:again|in advance|a lot|and (?:best|kind) regards))?|thank you(?: very much)?|cheers|(?:yours )?(?:sincerely|faithfully|truly)(?: yours)?|respectfully|take care"
    r"|(?:mit )?(?:freundliche[nr]?|beste[nr]?|viele[nr]?|herzliche[nr]?|liebe[nr]?|schöne[nr]?) gr(?:ü|ue)(?:ß|ss)en?|gru(?:ß|ss)|[mvlb]f?g|(?:vielen |besten |herzlichen )?dank(?: im voraus)?|danke(?: schön| im voraus)?|hochachtungsvoll"
    r"|(?:bien )?cordialement|bien (?:à|a) (?:vous|toi)|cdlt|(?:avec (?:mes )?)?(?:meilleures|sincères|cordiales) salutations|salutations(?: distinguées)?|(?:un grand )?merci(?: (?:d['’]avance|beaucoup|par avance))?|bonne (?:journée|soirée|semaine)|sincèrement|amicalement|respectueusement"
    r"|(?:un )?(?:(?:cordial|afectuoso) )?saludos?(?: cordial(?:es)?)?|(?:muchas |mil )?gracias(?: (?:de antemano|por todo|por adelantado))?|atentamente|atte|cordialmente|un abrazo|quedo a la espera)"
    r"[ \t]*[,.!;:–-]?[ \t]*(?P<rest>.*?)[ \t]*[,.]?\Z"
)
_NOTE = re.compile(
    r"(?i)(?:(?:sent|gesendet|envoyé|enviado|verstuurd|inviato)\b(?=.{0,50}\Z)\s(?:(?:from|via|with|using|by|von|mit|über|depuis|de|avec|desde|con|por)\s)?(?:my|a|an|mobile|unterwegs|meine[mnr]?|mein|mon|ma|mi|un|une|una|the \w+ app|[\w]+ mail|outlook|iphone|ipad|android)\b.*"
    r"|(?:get|hol(?:en)?|téléchargez|obtén|descarga)\b.{0,30}\b(?:app|mail|outlook)\b.{0,40}|von meine[mr] .{1,30} gesendet|diese nachricht wurde von .{1,40} gesendet)\Z"
)
#: How a disclaimer's paragraph begins.
_LEGAL = re.compile(
    r"(?i)(?:(?:this|these|the) (?:(?:contents? of (?:this|the) )?(?:e-?mail|message|communication|transmission)|information (?:above|contained|in this))\b"
    r"|(?:confidentiality|legal|privacy|important|disclaimer)\b(?: notice| note)?\s?[:.–-]|disclaimer\b|notice\s?:"
    r"|(?:diese|der inhalt dieser) (?:e-?mail|nachricht|mitteilung)\b|(?:vertraulichkeits|rechtlicher )\s?hinweis|hinweis\s?:"
    r"|(?:le contenu de )?(?:ce|cet|cette) (?:message|courriel|e-?mail|communication)\b|avis de confidentialité|les informations (?:contenues|ci-dessus)"
    r"|(?:el contenido de )?est[ea] (?:mensaje|correo|comunicación|e-?mail)\b|aviso (?:legal|de confidencialidad)|la información (?:contenida|anterior))"
)
_LEGAL_WORD = re.compile(
    r"(?i)confiden|privileg|intended|addressee|recipient|protected|liabil|disclos|vertraulich|geschützt|bestimmt|empfänger|haftung|weitergabe|destinat|réservé|protégé|responsabilité|divulga|protegid|destinad|responsabilidad|borr|registered in|legal"
)
_REPLY = re.compile(r"(?i)\A(?:(?:re|fwd?|aw|wg|tr|rv|sv|antw)(?:\[\d+\])?\s?:\s*)+")
_ADDRESS = re.compile(r"[\w.+\-]+@[\w.\-]+")
_WORD = re.compile(r"[^\W_]+")


def _plain(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x.lower().replace("ß", "ss")) if not unicodedata.combining(c))


def header(text: str | None) -> tuple[dict[str, str], int]:
    """The header fields by lower-case name, folded lines joined, and the number of lines they take."""
    fields: dict[str, str] = {}
    last, n = "", 0
    for line in (text or "").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and last and line.strip():
            fields[last] += " " + line.strip()
        elif m := re.match(r"([A-Za-z][A-Za-z\-]*)\s?:[ \t]*(.*)\Z", line):
            fields[last := m[1].lower()] = m[2]
        else:
            break
        n += 1
    return fields, n


def _sender(field: str) -> tuple[set[str], set[str]]:
    """Name parts of a From field, in plain lower case, and the parts of its address."""
    name = re.sub(r"<[^>]*>|\([^)]*\)|\"|(?<!\w)'|'(?!\w)", " ", field)
    parts = set() if "@" in name else {_plain(w) for w in re.findall(r"[^\W\d_][\w’'\-]*", name)}
    local = (_ADDRESS.search(field) or [""])[0].split("@")[0]
    return parts, {_plain(p) for p in re.split(r"[.\-_+\d]+", local) if len(p) > 2}


def _is_name(line: str, parts: set[str], local: set[str]) -> bool:
    """Whether a line holds the sender's name and nothing else."""
    words = re.findall(r"[^\W\d_][\w’'.\-]*", line)
    if not 1 <= len(words) <= 5 or not all(w[:1].isupper() or w.lower() in ("von", "van", "de", "del", "la", "der", "zu", "da", "di", "le", "du") for w in words):
        return False
    plain = [_plain(w).rstrip(".") for w in words]
    if parts and any(p in parts for p in plain) and all(p in parts or len(p) == 1 for p in plain):
        return True
    if not parts and local:
        joined = [re.sub(r"\W", "", p) for p in plain]
        return len(words) <= 3 and any(len(p) > 3 and any(p in x or x == p for x in local) for p in joined)
    return False


def _starts_block(lines: list[str], k: int) -> int:
    """Number of lines of a header block that begins at line k, 0 if none does."""
    if not _FROM.match(lines[k]):
        return 0
    n, at = 0, 0
    for line in lines[k : k + 12]:
        if not line.strip():
            break
        if _LABEL.match(line):
            n += 1
            at += "@" in line
        elif n == 0 or not (line[:1] in " \t" or "@" in line or len(line) < 120):
            break
    return n if n >= 3 and at else 0


def _intro(lines: list[str], k: int) -> int:
    """Number of lines (1 to 3) of an introduction of a quote that begins at line k, 0 if none does."""
    if not _INTRO_START.match(lines[k]):
        return 0
    for n in (1, 2, 3):
        if k + n > len(lines) or not lines[k + n - 1].strip() or (n > 1 and _MARK.match(lines[k + n - 1])):
            return 0
        if lines[k + n - 1].rstrip().endswith(":") and _INTRO.match(" ".join(x.strip() for x in lines[k : k + n])):
            return n
    return 0


def _first_of_signature(lines: list[str], parts: set[str], local: set[str]) -> int:
    """Index of the first line that is no text any more: closing, name, rule, note or disclaimer; len(lines) if none."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    for at, k in enumerate(full):
        s = lines[k].strip()
        after = [lines[x].strip() for x in full[at + 1 :]]
        m = _CLOSE.match(s) if len(s) <= 70 else None
        if m and len(m["rest"].split()) <= 4 and (not m["rest"] or _is_name(m["rest"], parts, local) or (not parts and re.fullmatch(r"(?:[A-ZÀ-Þ][\w’'.\-]*[ ]?){1,3}", m["rest"]))):
            # a formula above more of the text is a sentence of its own, unless what follows is a signature
            if not after or len(after) <= 12 or _is_name(after[0], parts, local):
                return k
        if _is_name(s, parts, local) and len(s) <= 60 and (at > 0 or not s.endswith(",")):
            return k
        if " | " in s and _is_name(s.split(" | ")[0], parts, local):
            return k
        if _NOTE.match(s):
            return k
        if _RULE.match(s) and after and (s in ("--", "—", "–") or _is_name(after[0], parts, local) or _is_name(after[0].split(" | ")[0], parts, local) or _LEGAL.match(after[0])):
            return k
        if _LEGAL.match(s) and (at == 0 or full[at - 1] < k - 1 or _RULE.match(lines[k - 1])):
            stop = next((x for x in range(k, len(lines)) if not lines[x].strip()), len(lines))
            if _LEGAL_WORD.search(" ".join(lines[k:stop])):
                return k
    return len(lines)


def own_lines(text: str | None) -> list[int]:
    """Numbers (from 1) of the non-blank lines that the text itself shows to be newly written by its sender."""
    fields, n = header(text)
    lines = [x.rstrip("\r") for x in (text or "").split("\n")]
    if not n:
        return []
    parts, local = _sender(fields.get("from", ""))
    stop = len(lines)
    while stop > n and not lines[stop - 1].strip():
        stop -= 1
    if stop > n and re.match(r"Attachments: ", lines[stop - 1]):
        stop -= 1
    body, k = lines[:stop], n
    regions: list[list[int]] = [[]]
    while k < stop:
        line = body[k]
        if _MARK.match(line):
            # a line above a quoted header block introduces it
            own = regions[-1]
            last = next((x for x in reversed(own) if body[x].strip()), None)
            if last is not None and last >= k - 3 and _FROM.match(re.sub(r"^\s*(?:[>»|]\s?)+", "", line)) and (_DASHED.match(body[last]) or re.match(r".{3,60}:\s*\Z", body[last])):
                own[:] = [x for x in own if x < last]
            regions.append([])
            k += 1
            continue
        if _starts_block(body, k):
            # the line that introduces the block belongs to it; all below it is the earlier mail
            at = next((x for x in range(len(regions) - 1, -1, -1) if regions[x] or x == 0), 0)
            own = regions[at]
            while own and not body[own[-1]].strip():
                own.pop()
            if own and own[-1] >= k - 3 and (_DASHED.match(body[own[-1]]) or _RULE.match(body[own[-1]]) or re.match(r".{3,60}:\s*\Z", body[own[-1]])):
                own.pop()
            break
        if taken := _intro(body, k):
            nxt = next((x for x in range(k + taken, stop) if body[x].strip()), None)
            regions.append([])
            k += taken
            if nxt is None or not _MARK.match(body[nxt]):
                break
            continue
        regions[-1].append(k)
        k += 1
    out: list[int] = []
    for own in regions:
        if own:
            cut = _first_of_signature([body[x] for x in own], parts, local)
            out += [x + 1 for x in own[:cut] if body[x].strip()]
    return [x for x in out if not _DASHED.match(lines[x - 1]) and not _RULE.match(lines[x - 1])]


def _key(fields: dict[str, str]) -> tuple[str, str, float, str]:
    """(thread by reference, thread by subject and participants, seconds since 1970, sender's address)."""
    refs = re.findall(r"<[^<>\s]+>", fields.get("references", "") + " " + fields.get("in-reply-to", "")) or re.findall(r"<[^<>\s]+>", fields.get("message-id", ""))
    who = [a.lower() for f in ("from", "to", "cc") for a in _ADDRESS.findall(fields.get(f, ""))]
    subject = " ".join(_WORD.findall(_REPLY.sub("", fields.get("subject", "")).lower()))
    try:
        when = parsedate_to_datetime(fields.get("date", "")).timestamp()
    except (TypeError, ValueError, IndexError):
        when = 0.0
    return refs[0] if refs else "", subject and subject + "\n" + "\n".join(sorted(set(who))), when, who[0] if who else ""


def _words(lines: list[str], numbers: list[int]) -> tuple[list[str], list[int]]:
    """Words in lower case, and the line of each."""
    words, at = [], []
    for n in numbers:
        for w in _WORD.findall(re.sub(r"^\s*(?:[>»|]\s?)+", "", lines[n - 1]).lower()):
            words.append(w)
            at.append(n)
    return words, at


def _rolling(words: list[str]) -> np.ndarray:
    """64-bit codes of all runs of SHINGLE words: a polynomial rolled over the words' codes."""
    if len(words) < SHINGLE:
        return np.empty(0, np.int64)
    codes = pa.array([hash_of(w) for w in words], pa.uint64()).to_numpy()
    out = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(out)]
    return out.view(np.int64)


_hashes: dict[str, int] = {}


def hash_of(word: str) -> int:
    """A word's 64-bit code, the same in every process."""
    h = _hashes.get(word)
    if h is None:
        h = 0xCBF29CE484222325
        for b in word.encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        if len(_hashes) > 500_000:
            _hashes.clear()
        _hashes[word] = h
    return h


def aligned(own: list[int], theirs: list[int]) -> list[int]:
    """Indexes of the longest chain whose places rise in both texts.  own: rising places; theirs: the places they match."""
    tails: list[int] = []
    tail_at: list[int] = []
    back = [-1] * len(own)
    for k, x in enumerate(theirs):
        lo, hi = 0, len(tails)
        while lo < hi:
            mid = (lo + hi) // 2
            if tails[mid] < x:
                lo = mid + 1
            else:
                hi = mid
        tails[lo : lo + 1] = [x]
        tail_at[lo : lo + 1] = [k]
        back[k] = tail_at[lo - 1] if lo else -1
    out, k = [], tail_at[-1] if tail_at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def inherited(places: list[int], sources: list[int], ends: list[int]) -> set[int]:
    """Places of the words that stand in an earlier mail of the thread.

    places, sources, ends: for each shared run of SHINGLE words its place here, the mail that holds it, its place there.
    """
    covered: set[int] = set()
    for source in set(sources):
        pick = sorted((p, e) for p, s, e in zip(places, sources, ends) if s == source)
        chain = [pick[k] for k in aligned([p for p, _ in pick], [e for _, e in pick])]
        run: list[int] = []
        for p, e in [*chain, (1 << 60, 0)]:
            if run and p > run[-1] + SHINGLE:
                if run[-1] + SHINGLE - run[0] >= LEAST_RUN:
                    covered.update(x for q in run for x in range(q, q + SHINGLE))
                run = []
            run.append(p)
    return covered


def _distinct_mails(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)


def _threads(mails: DataFrame) -> DataFrame:
    """(id, thread, sent, sender) of the mails whose thread holds other mails; once for each kind of key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, when, who) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for a, c, when, who in [_key(header(t)[0])] for k in (a, c) if k]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.float64(), pa.string()))], names=["id", "thread", "sent", "sender"])

    keys = mails.mapInArrow(scan, "id bigint, thread string, sent double, sender string").select("id", F.xxhash64("thread").alias("thread"), "sent", F.xxhash64("sender").alias("sender"))
    shared = keys.groupBy("thread").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("thread")
    return keys.join(shared, "thread").distinct()


def _shingles(mails: DataFrame) -> DataFrame:
    """(id, code, place, own): all runs of words of the bodies; own: whether the run lies in lines that seem newly written."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = [x.rstrip("\r") for x in t.split("\n")]
                own = own_lines(t)
                other = sorted(set(range(header(t)[1] + 1, len(lines) + 1)) - set(own))
                for numbers, mine in ((own, True), (other, False)):
                    codes = _rolling(_words(lines, numbers)[0])
                    for to, x in zip(out, (np.full(len(codes), i), codes, np.arange(len(codes)), np.full(len(codes), mine))):
                        to.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, d), *x]).astype(d)) for x, d in zip(out, (np.int64, np.int64, np.int32, bool))], names=["id", "code", "place", "own"]
            )

    return mails.mapInArrow(scan, "id bigint, code bigint, place int, own boolean")


def new_lines(df: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """Distinct rows (id, line_no) of the non-blank lines that each mail's sender newly wrote."""
    mails = _distinct_mails(df, id_col, text_col)
    threads = _threads(mails)
    members = mails.join(threads.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    runs = threads.join(_shingles(members), "id")
    first = F.min(F.struct("sent", "id", "sender", "place"))
    # one row for each run of words of a thread, however many mails of the thread hold it
    earliest = runs.groupBy("thread", "code").agg(first.alias("first")).select("thread", "code", F.col("first.*")).toDF("thread", "code", "f_sent", "f_id", "f_sender", "f_place")
    shared = runs.filter("own").join(earliest, ["thread", "code"]).filter("f_id != id and f_sent < sent and f_sender != sender")
    per_mail = shared.groupBy("id").agg(F.collect_set(F.struct("place", "f_id", "f_place")).alias("shared"))  # bounded by the mail's own words
    kind = mails.schema["id"].dataType.simpleString()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, own_lines(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield _lines(rows, b.schema.field(0).type)

    def taken_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                _, at = _words([x.rstrip("\r") for x in t.split("\n")], own_lines(t))
                gone = inherited([r["place"] for r in found], [r["f_id"] for r in found], [r["f_place"] for r in found])
                rows.append((i, sorted({n for p, n in enumerate(at) if p in gone} - {n for p, n in enumerate(at) if p not in gone})))
            yield _lines(rows, b.schema.field(0).type)

    schema = f"id {kind}, line_no int"
    gone = members.join(per_mail, "id").select("id", "text", "shared").mapInArrow(taken_over, schema)
    return mails.mapInArrow(own, schema).distinct().join(gone, ["id", "line_no"], "left_anti").withColumnRenamed("id", id_col)


def _lines(rows: list[tuple[int, list[int]]], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, x in rows for _ in x], kind), pa.array([n for _, x in rows for n in x], pa.int32())], names=["id", "line_no"])


def own_texts(df: DataFrame, id_col: str = "file_id", text_col: str = "text", out_col: str = "own_text") -> DataFrame:
    """One row (id, out_col) for each mail: the text that is left, its paragraphs kept apart; empty where nothing is."""
    mails = _distinct_mails(df, id_col, text_col).dropDuplicates(["id"])
    kept = new_lines(df, id_col, text_col).groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list("line_no")).alias("kept"))
    text = F.transform(F.split("text", "\r?\n"), lambda x, k: F.struct((k + 1).alias("n"), x.alias("x")))
    own = F.filter(text, lambda x: F.array_contains("kept", x["n"]) | ((F.trim(x["x"]) == "") & (x["n"] > F.try_element_at("kept", F.lit(1))) & (x["n"] < F.try_element_at("kept", F.lit(-1)))))
    joined = F.array_join(F.transform(own, lambda x: x["x"]), "\n")
    return mails.join(kept, "id", "left").select(F.col("id").alias(id_col), F.coalesce(F.regexp_replace(joined, r"\n{3,}", "\n\n"), F.lit("")).alias(out_col))
