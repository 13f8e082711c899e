"""Credentials in code and configuration texts: find, blank out, keep the file usable.

All grammars (token formats, key armour, connection strings, command-line forms, ``key = value``
forms, sentences that tell a password) go into one deterministic automaton, which reports every
place where one of them can be complete.  It scans a text once, in chunks of any size; its state is
carried over a chunk's end, so no chunk has to overlap the next and none changes the result.  What
an automaton can't tell (what stands before and after a match, whether the quotes are alike, where
the value is) is checked by the grammar's own pattern on the line of the report.  Overlapping spans
are joined, and placeholders are spliced into the original text, leaving every other character
(quotes, keys, line ends) as it was.

Defined cases: null or empty text gives no span and is returned as it is; repeated rows give
the same spans; a key's armour without a line of key in it is no key, and an unclosed one ends with
the last line that can belong to a key; extra columns are ignored by :func:`secret_spans` and kept
by :func:`redact_secrets`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.automaton import Automaton

PLACEHOLDER = "[SECRET]"

_VENDOR = (
    r"(?<![A-Za-z0-9_\-])(?:AKIA[0-9A-Z]{12,20}|ASIA[0-9A-Z]{16}|AIza[0-9A-Za-z_\-]{20,40}|gh[pousr]_[A-Za-z0-9]{20,255}"
    r"|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_\-]{16,}|xox[abeoprs]-[A-Za-z0-9\-]{10,}"
    r"|(?:sk|rk|pk)_(?:live|test|prod)_[A-Za-z0-9]{12,}|sk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}|npm_[A-Za-z0-9]{30,}"
    r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|[a-z]{2,8}_(?:pat|live|prod|test|key|tok|secret)_[A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{6,})(?![A-Za-z0-9])"
)
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: What a line of a key can hold besides marks of quoting: Base64, header fields, nothing.
_BODY = re.compile(r"[ \t>#*|\"'`+,;/\\]*(?:[A-Za-z0-9+/=\\_\-]{8,}|[A-Za-z0-9+/]{1,7}={0,2}|[A-Za-z][A-Za-z\-]+: [^\n]*|(?:\\n)?)[ \t\"'`+,;\\)\r]*\Z")
_URL = r"\b[a-zA-Z][a-zA-Z0-9+.\-]{1,30}://[^\s:/@'\"<>]*:(?P<url>[^\s/'\"<>]+?)@(?=[A-Za-z0-9\[])"
#: Names whose value is a credential; the name must end with one of them.
_NAME = (
    r"(?:pass(?:word|wd|phrase|code|wort)?|pwd|pw|secret|tokens?(?<!s)|apikey|credentials?|cred|auth|clave|contrase(?:ñ|n)a|kennwort|schl(?:ü|ue)ssel"
    r"|mot[_\- ]?de[_\- ]?passe|(?:api|secret|signing|private|access|auth|encryption|master|account|storage|shared|service)[_\-. ]?key)"
)
#: Before the name may stand anything but a digit (letters, separators, nothing), which :func:`_matches` looks at; no prefix is consumed.
_KEY = r"(?P<key>" + _NAME + r")(?![A-Za-z0-9_\-.])"
_VALUE = r"(?:\"(?P<{0}d>(?:[^\"\\\n]|\\.)*)\"|'(?P<{0}s>(?:[^'\\\n]|\\.)*)'|`(?P<{0}b>[^`\n]*)`|(?P<{0}r>{1}))"
_ASSIGN = (
    _KEY + r"(?P<sep>[\"'`]?\]?[ \t]*(?:=>|:=|=|:|,)[ \t]*|[\"'][ \t]+value[ \t]*=[ \t]*|>[ \t]*(?=[^<\s]))"
    + _VALUE.format("a", r"[^\s\"'`<>,;(){}\[\]][^\s\"'`<>]*")
)
_BASIC = r"(?i:\b(?:authorization|auth_header|auth[_\-]?header|x-api-key|x-auth-token)\b)[\"'`]?[ \t]*(?:=>|[:=,>])[ \t]*[\"'`]?(?:(?i:basic|bearer|token)[ \t]+)?(?P<hdr>[A-Za-z0-9+/=_\-.]{12,})"
_BEARER = r"\b(?:Bearer|Basic)[ \t]+(?P<bear>[A-Za-z0-9+/=_\-.]{12,})"
_OPTION = r"--(?i:password|passwd|pass|token|secret|api-key)(?:=|[ \t]+)(?P<q2>[\"']?)(?P<opt>[^\s\"']+)(?P=q2)"
_PGPASS = r"(?<![\w.\-])(?:[\w.\-]+|\*):(?:\d+|\*):[^\s:]+:[^\s:]+:(?P<pgp>[^\s\"':]+)(?=[\"'\s]|$)"
#: Commands and the options that carry their password, looked for in what follows the command on its line.
_COMMANDS = [
    (re.compile(r"\bcurl\b"), re.compile(r"[ \t](?:-u|--user)[ =]?[\"']?[^\s:\"']+:(?P<v>[^\s\"']+)")),
    (re.compile(r"\b(?:mysql(?:dump)?|mariadb)\b"), re.compile(r"[ \t]-p(?P<q>[\"']?)(?P<v>[^\s\"']+)(?P=q)")),
    (re.compile(r"\bsshpass\b"), re.compile(r"[ \t]-p[ ]?(?P<q>[\"']?)(?P<v>[^\s\"']+)(?P=q)")),
    (re.compile(r"\bsqlcmd\b"), re.compile(r"[ \t]-P[ ]?(?P<q>[\"']?)(?P<v>[^\s\"']+)(?P=q)")),
    (re.compile(r"\bredis-cli\b"), re.compile(r"[ \t]-a[ ]?(?P<q>[\"']?)(?P<v>[^\s\"']+)(?P=q)")),
    (re.compile(r"\bldapsearch\b"), re.compile(r"[ \t]-w[ ]?(?P<q>[\"']?)(?P<v>[^\s\"']+)(?P=q)")),
]
_PROSE = (
    r"(?i:\b(?:wi-?fi|wlan|vpn)(?:[ \t]+(?:password|passphrase|key|passwort|pw|clave|code))?[ \t]*[:=][ \t]*)(?P<wifi>\S+)"
    r"|(?i:\b(?:pw|pwd|passw(?:or)?d|password|passphrase|passwort|kennwort|mot de passe|contrase(?:ñ|n)a|clave|pin|secret|token)\b(?:[ \t]+(?:is|ist|est|es|lautet|was|for[ \t]+\S+[ \t]+is))?[ \t]*:?[ \t]+)(?P<prose>[^\s,;]+)"
    r"|(?i:\b(?:login|zugang|acceso|acc(?:è|e)s|account|user)\b)[^\n/]{0,40}?[ \t]/[ \t](?P<login>\S+)"
)

#: Names that tell nothing: their value must look like a credential by itself.  Separated by a comma only where both are quoted.
_PLAIN = re.compile(
    r"(?i)(?<![\w.\-])(?:process\.env\.)?(?P<n>[a-z]{1,2}\d{0,2}|conn|login|value|val|tmp|data|foo)(?:[\"'`]?\]?\)?[ \t]*(?:=>|:=|=|:)[ \t]*|[\"'`][ \t]*,[ \t]*(?=[\"'`])|[\"'][ \t]+value[ \t]*=[ \t]*)"
    r"(?:\"(?P<d>[^\"\s]*)\"|'(?P<s>[^'\s]*)'|`(?P<b>[^`\s]*)`|(?P<r>[^\s\"'`,;<>(){}\[\]]+))"
)
_LEFT_OVER = re.compile(r"(?i)\b(?:todo|fixme)\b[ \t]+(?:remove|delete|drop|rotate|revoke|replace)\b[^\n:]*:[ \t]*(?P<v>[^\s\"'`]+)")
#: One string written as two, over a line's end.
_SPLIT = re.compile(r"(?P<n>[A-Za-z_]\w*)[\"'`]?[ \t]*(?:=>|:=|=|:)[ \t]*\(?[ \t]*(?P<q>[\"'`])(?P<a>[^\"'`\s]+)(?P=q)[ \t]*(?:\+|\.|&|\\)[ \t]*\\?[ \t]*\r?\n[ \t]*(?:\+[ \t]*)?(?P=q)(?P<z>[^\"'`\s]+)(?P=q)")
_HARMLESS = re.compile(r"(?i)hash|digest|uuid|url|path|dir|color|version|checksum|sum|sha|_id$|^id$")
_UUID = re.compile(r"(?i)\A[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z")
#: The grammars' own patterns, each run on the lines on which the automaton reports it.
_GRAMMARS = {k: re.compile(p, re.M) for k, p in (("url", _URL), ("basic", _BASIC), ("bearer", _BEARER), ("option", _OPTION), ("pgpass", _PGPASS), ("vendor", _VENDOR), ("prose", _PROSE))}
#: Run on the text in lower case, which spares the engine the case-insensitive search at each character.
_ASSIGNED = re.compile(_ASSIGN)
#: What each grammar cannot do without, for the automaton: (pattern, whether case is ignored).
_NAMES_ONLY = _NAME.replace("(?<!s)", "")
_PATTERNS = {
    "armour": (r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", False),
    "url": (r"://[^\s:/@'\"<>]*:[^\s/'\"<>]+@", False),
    "basic": (r"(?:authorization|auth_header|auth[_\-]?header|x-api-key|x-auth-token)[\"'`]?[ \t]*(?:=>|[:=,>])", True),
    "bearer": (r"(?:Bearer|Basic)[ \t]+[A-Za-z0-9+/=_\-.]{12}", False),
    "option": (r"--(?:password|passwd|pass|token|secret|api-key)[= \t]", True),
    "pgpass": (r"[\w.*\-]:(?:\d+|\*):[^\s:]+:[^\s:]+:[^\s\"':]", False),
    "vendor": (
        r"AKIA[0-9A-Z]{12}|ASIA[0-9A-Z]{16}|AIza[0-9A-Za-z_\-]{20}|gh[pousr]_[A-Za-z0-9]{20}|github_pat_[A-Za-z0-9_]{20}|glpat-[A-Za-z0-9_\-]{16}|xox[abeoprs]-[A-Za-z0-9\-]{10}"
        r"|(?:sk|rk|pk)_(?:live|test|prod)_[A-Za-z0-9]{12}|sk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20}|npm_[A-Za-z0-9]{30}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16}"
        r"|[a-z]{2}_(?:pat|live|prod|test|key|tok|secret)_[A-Za-z0-9]{16}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{6}",
        False,
    ),
    "prose": (
        r"(?:wi-?fi|wlan|vpn)(?:[ \t]+(?:password|passphrase|key|passwort|pw|clave|code))?[ \t]*[:=]"
        r"|(?:pw|pwd|passw(?:or)?d|password|passphrase|passwort|kennwort|mot de passe|contrase(?:ñ|n)a|clave|pin|secret|token)[ \t:]|[ \t]/[ \t]",
        True,
    ),
    "command": (r"curl|mysql|mysqldump|mariadb|sshpass|sqlcmd|redis-cli|ldapsearch", False),
    "plain": (r"[^\w.\-](?:process\.env\.)?(?:[a-z][a-z]?\d?\d?|conn|login|value|val|tmp|data|foo)(?:[\"'`]?\]?\)?[ \t]*[:=]|[\"'`][ \t]*,|[\"'][ \t]+value)", True),
    "left_over": (r"(?:todo|fixme)[ \t]+(?:remove|delete|drop|rotate|revoke|replace)[^\n:]*:", True),
    "split": (r"[\"'`][ \t]*(?:\+|\.|&|\\)[ \t]*\\?[ \t]*\r?\n", False),
    "assign": (_NAMES_ONLY + r"[\"'`]?\]?[ \t]*(?:=>|:=|=|:|,|>)|" + _NAMES_ONLY + r"[\"'][ \t]+value[ \t]*=", True),
}
_built: list[Automaton] = []


def automaton() -> Automaton:
    """The automaton of all grammars, built once in each process."""
    if not _built:
        _built.append(Automaton(_PATTERNS))
    return _built[0]


_PLACE = re.compile(
    r"(?ix)\A(?:|[x*•.\-_#?]{3,}|x+|<[^<>]*>|\[[^\[\]]*\]|\$\{[^{}]*\}?|\$\([^()]*\)?|\$[A-Za-z_]\w*|%\([^()]*\)s?|%\w+%|%[sd]|\{+[^{}]*\}+|@\w+@|@\w+\.\w+\(.*|.*\{\{.*|none|null|nil|undefined|true|false|yes|no|n/?a|tbd|todo|unset|empty|debug|info|example.*|sample.*|dummy.*|placeholder.*"
    r"|change[_\-]?(?:me|it|this).*|replace[_\-]?(?:me|this|it)?.*|insert.*|enter.*|redacted.*|your[_\-. ].*|my[_\-](?:password|secret|token|key).*|(?:password|passwd|secret|token|pass|apikey|api[_\-]key|test)"
    r"|required|optional|hidden|string|str|text|boolean|bytes|int|varchar.*|(?:process\.)?env\b.*|os\.environ.*|os\.getenv.*|getenv.*|getpass.*|sys\.argv.*|config[.\[].*|settings[.\[].*|self\..*|this\..*|args\..*|vault[:.].*|arn:.*|ssm:.*|ref\+.*|secret[:/]{1,3}.*|file:.*|https?://[^:@]*|[\w./\-]*\.(?:pass|pem|key|crt|txt|json|ya?ml))\Z"
)
_CALL = re.compile(r"\A[A-Za-z_][\w.]*\(")
#: A path has no segment that mixes upper case, lower case and digits as a Base64 secret does.
_PATH = re.compile(r"\A/[\w./\-]*\Z")
_MIXED = re.compile(r"(?=[^/]*[a-z])(?=[^/]*[A-Z])(?=[^/]*\d)[^/]{12,}")
_PASSWORD = re.compile(r"(?i)\A(?:pass(?:word|wd|phrase|code|wort)?|pwd|pw|clave|contrase(?:ñ|n)a|kennwort|mot[_\- ]?de[_\- ]?passe)\Z")
_WORDS = re.compile(r"\A[^\W\d_]+\Z")


def _good(group: str | None, value: str, rest: str, key: str = "", sep: str = "") -> bool:
    """Whether a matched value can be a live credential.  rest: what follows it on its line."""
    if group is None:
        return True
    named = bool(_PASSWORD.match(key))
    short = 3 if named and (group != "ar" or re.search(r"\d", value) and not value.isdigit()) else 5
    if _PLACE.match(value) or _CALL.match(value) or len(value) < short or _PATH.match(value) and not _MIXED.search(value):
        return False
    if group == "ar":  # a bare word followed by more prose is a sentence, not a setting
        if _WORDS.match(value) and (value.islower() or value.istitle()) and not (named and sep.strip() in ("=", ":") and re.match(r"[ \t\r]*(?:#.*)?\Z", rest)):
            return False
        if re.match(r"[ \t]+[a-z]{2,}\b[ \t]+\S", rest) and not re.search(r"\d", value):
            return False
        return not re.match(r"\A[\d.]+\Z", value) or len(value) >= 8
    if group in ("wifi", "prose", "login"):
        v = value.rstrip(".,;:!?)\"'")
        if re.match(r"\A[\d.,\-/]+\Z", v) and len(v) < 8:
            return False
        kinds = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
        return (bool(re.search(r"\d", v)) and kinds >= 2) or len(re.findall("-", v)) >= 2 or (kinds >= 3 and len(v) >= 8)
    return True


def _strong(v: str) -> bool:
    """Whether a value looks like a credential, whatever it is called."""
    if len(v) < 7 or v[0] in "#/.<$@{[(" or "://" in v or _UUID.match(v) or _PLACE.match(v) or re.match(r"(?i)sha\d|\d+[.,\d]*\Z|[\w.\-]+\.[a-z]{2,}\Z|[\w.\-]+@", v):
        return False
    if re.fullmatch(r"[0-9a-f]{32,}", v):
        return bool(re.search(r"\d", v) and re.search(r"[a-f]", v))
    if re.fullmatch(r"[a-z]{3,}(?:-[a-z]{2,}){3,}", v):
        return True
    if not (re.search(r"\d", v) and re.search(r"[A-Za-z]", v)):
        return False
    return bool(re.search(r"[a-z]", v) and re.search(r"[A-Z]", v)) or bool(re.search(r"[!#$%&*+/=?@^~]", v))


def _lower(text: str) -> str:
    """In lower case, with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def _armoured(text: str, m: re.Match) -> int | None:
    """Where the key ends whose armour begins with m; None if it holds no key."""
    stop = text.find("\n", m.end())
    stop = stop if stop >= 0 else len(text)
    if e := _END.search(text, m.end(), stop):
        return e.end()
    at, body = stop, bool(re.search(r"[A-Za-z0-9+/=]{16}", text[m.end() : stop]))
    end = stop if body else None
    while at < len(text):
        nxt = text.find("\n", at + 1)
        nxt = nxt if nxt >= 0 else len(text)
        line = text[at + 1 : nxt]
        if e := _END.search(line):
            return at + 1 + e.end() if body else None
        if not _BODY.match(line):
            break
        if ": " not in line:
            body = body or bool(re.search(r"[A-Za-z0-9+/]", line))
            if re.search(r"[A-Za-z0-9+/=]{8}|[A-Za-z0-9+/]=+\r?\Z", line):
                end = nxt
        at = nxt
    return end


def _matches(text: str, chunk: int = 1 << 16) -> Iterator[tuple[str | None, int, int]]:
    """(group, start, end) of all that the grammars match and :func:`_good` accepts."""

    def rest(e: int) -> str:
        stop = text.find("\n", e)
        return text[e : stop if stop >= 0 else len(text)][:200]

    reported: dict[str, dict[int, int]] = {}
    # a line's end before the text gives every name a character on its left
    for name, end in automaton().scan("\n" + text, chunk):
        end -= 1
        lines = reported.setdefault(name, {})
        start = text.rfind("\n", 0, end - 1) + 1
        if start not in lines:
            stop = text.find("\n", end - 1)
            lines[start] = stop if stop >= 0 else len(text)
    for start, stop in reported.get("armour", {}).items():
        for m in _BEGIN.finditer(text, start, stop):
            if (e := _armoured(text, m)) is not None:
                yield None, m.start(), e
    for name, rx in _GRAMMARS.items():
        groups = [g for g in rx.groupindex if g != "q2"]
        for pos, stop in reported.get(name, {}).items():
            while (m := rx.search(text, pos, stop)) is not None:
                g = next((x for x in groups if m.group(x) is not None), None)
                s, e = m.span(g) if g else m.span()
                if g in ("wifi", "prose", "login"):
                    e -= len(m.group(g)) - len(m.group(g).rstrip(".,;:!?)\"'`"))
                    s += len(m.group(g)) - len(m.group(g).lstrip("(\"'`"))
                if e > s and _good(g, text[s:e], rest(e)):
                    yield g, s, e
                    pos = m.end()
                else:  # what was refused may hold the start of another match
                    pos = m.start() + 1
    for start, stop in reported.get("command", {}).items():
        for command, option in _COMMANDS:
            c = command.search(text, start, stop)
            at = c.end() if c else stop
            while c and (m := option.search(text, at, stop)) is not None:
                s, e = m.span("v")
                if _good("cli", text[s:e], rest(e)):
                    yield "cli", s, e
                    at = m.end()
                else:
                    at = m.start() + 1
    for start, stop in reported.get("plain", {}).items():
        for m in _PLAIN.finditer(text, start, stop):
            g = next(x for x in "dsbr" if m[x] is not None)
            if _strong(m[g]) and not (g == "r" and text[m.start(g) - 1] == ":") and not (m["n"].lower() == "value" and "key=" in text[start : m.start()].lower()):
                yield None, *m.span(g)
    for start, stop in reported.get("left_over", {}).items():
        for m in _LEFT_OVER.finditer(text, start, stop):
            if _strong(m["v"]):
                yield None, *m.span("v")
    for start in reported.get("split", {}):
        for m in _SPLIT.finditer(text, start, min(len(text), start + 4000)):
            if (_strong(m["a"] + m["z"]) or _GRAMMARS["vendor"].fullmatch(m["a"] + m["z"])) and not _HARMLESS.search(m["n"]):
                yield None, *m.span("a")
                yield None, *m.span("z")
    assigned = reported.get("assign", {})
    low = _lower(text) if assigned else ""
    for pos, stop in assigned.items():
        while (m := _ASSIGNED.search(low, pos, stop)) is not None:
            pos = m.start() + 1
            if text[m.start() - 1 : m.start()].isdigit():
                continue
            g = next(x for x in ("ad", "as", "ab", "ar") if m.group(x) is not None)
            s, e = m.span(g)
            if e > s and _good(g, text[s:e], rest(e), m.group("key"), m.group("sep")):
                yield g, s, e
                pos = m.end()


def find_secrets(text: str | None, chunk: int = 1 << 16) -> list[tuple[int, int]]:
    """Absolute spans (start, end) of credential values in one text, sorted, without overlaps."""
    out: list[tuple[int, int]] = []
    for s, e in sorted({(s, e) for _, s, e in _matches(text or "", chunk)}, key=lambda x: (x[0], -x[1])):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def splice(text: str, spans: list[tuple[int, int]], placeholder: str = PLACEHOLDER) -> str:
    """The text with each span replaced; a span over several lines keeps its line ends."""
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], placeholder, "".join(re.findall(r"\r?\n", text[s:e]))]
        at = e
    return "".join([*out, text[at:]])


def secret_spans(df: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """Rows (id, line_no, start, end), one for each line that a credential touches.

    ``start`` and ``end`` are the credential's character offsets in the whole text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines, starts, ends = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, e in find_secrets(t):
                    first = t.count("\n", 0, s) + 1
                    for k in range(first, first + t.count("\n", s, e) + 1):
                        ids.append(i), lines.append(k), starts.append(s), ends.append(e)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), pa.array(lines, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                names=["id", "line_no", "start", "end"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col), F.col(text_col)).filter(F.length(text_col) > 0)
    return src.mapInArrow(scan, f"id {kind}, line_no int, start int, end int").withColumnRenamed("id", id_col)


def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([t if not t else splice(t, find_secrets(t)) for t in texts], dtype=object)


def redacted(text: Column) -> Column:
    return F.pandas_udf(_redacted, T.StringType())(text)


def redact_secrets(df: DataFrame, text_col: str = "text", out_col: str = "redacted_text") -> DataFrame:
    """All rows and columns of df plus the text with each credential blanked out."""
    return df.withColumn(out_col, redacted(F.col(text_col)))


def sensitivity_raised(catalog: DataFrame, spans: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Distinct (id, sensitivity, raised_to) of the catalogue's rows below restricted whose file holds a credential; a missing level counts as below."""
    below = catalog.filter(~F.coalesce(F.col("sensitivity") == "restricted", F.lit(False))).select(id_col, "sensitivity")
    return below.join(spans.select(id_col).distinct(), id_col, "left_semi").select(id_col, "sensitivity", F.lit("restricted").alias("raised_to")).distinct()
