"""Detectors of sensitive values: count them, mask them, derive the least sensitivity.

Each detector is native: all matches of a pattern, validators on each.  :func:`scan` runs all of
them one after the other over the text as the ones before left it, so a value that one detector
masked can't be another's; it is one Arrow function, which measures faster than nine native steps.
Null texts hold nothing and stay null.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import BLANKS, BOUND, all_matches, replaced

TYPES = ("secret", "card", "iban", "national_id", "email", "phone")
#: The published shapes of tokens, the words that name a secret, and what is no secret.
BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)"
TOKENS = r"(?:sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|sk_live_[A-Za-z0-9]{16,}|rk_live_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
SECRET_WORDS = r"password|passwd|pwd|pass|secret|api[_-]?key|apikey|access[_-]?key|secret[_-]?key|client[_-]?secret|auth[_-]?token|access[_-]?token|token|private[_-]?key|credentials?"
PLACEHOLDER = r"^(?:\$|<|\{|%|\*{3,}|x{3,}|\.{3,}|changeme|password|secret|your[_-]|example|none|null|true|false|redacted)"
NAMED = rf"(?i)(?<![A-Za-z0-9])({SECRET_WORDS})([\"']?[{BLANKS}]*[:=][{BLANKS}]*[\"']?)([^{BLANKS}\"',;]{{6,}})"
VENDOR = BOUND + TOKENS + BOUND
IBAN = BOUND + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + BOUND
CARD = BOUND + r"(?:\d[ -]?){12,18}\d" + BOUND
SSN = BOUND + r"(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}" + BOUND
NINO = BOUND + r"(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]" + BOUND
EMAIL = r"(?i)" + BOUND + r"[A-Z0-9._%+-]+@((?:[A-Z0-9-]+\.)+[A-Z]{2,})" + BOUND
PHONE = r"(?<![A-Za-z0-9_+])(?:\+\d{1,3}[ .-]?|\(0\d{1,4}\)[ .-]?|0)\d{1,4}(?:[ .-]?\d{2,4}){2,4}(?![A-Za-z0-9_])"


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of figures is right."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda c, k: c.cast("int") * F.when(k % 2 == 1, 2).otherwise(1))
    return F.aggregate(F.transform(at, lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def card_ok(match: Column) -> Column:
    d = F.regexp_replace(match, r"\D", "")
    return F.length(d).between(13, 19) & d.rlike("^[3-6]") & ~d.rlike(r"^(\d)\1+\z") & luhn(d)


def iban_ok(match: Column) -> Column:
    s = F.upper(F.regexp_replace(match, r"\s+", ""))
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    digits = F.array_join(F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.length(s).between(15, 34) & (F.aggregate(F.split(digits, ""), F.lit(0).cast("bigint"), lambda r, c: (r * 10 + c.cast("int")) % 97) == 1)


def phone_ok(match: Column) -> Column:
    return F.length(F.regexp_replace(match, r"\D", "")).between(9, 15)


def named_ok(match: Column) -> Column:
    value = F.regexp_extract(match, NAMED, 3)
    return ~value.rlike("(?i)" + PLACEHOLDER) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


#: (name, type, pattern, validator or None, mask)
DETECTORS = (
    ("block", "secret", BLOCK, None, lambda m: F.lit("[PRIVATE KEY]")),
    ("vendor", "secret", VENDOR, None, lambda m: F.lit("[SECRET]")),
    ("named", "secret", NAMED, named_ok, lambda m: F.concat(F.regexp_extract(m, NAMED, 1), F.regexp_extract(m, NAMED, 2), F.lit("[SECRET]"))),
    ("iban", "iban", IBAN, iban_ok, lambda m: F.lit("[IBAN]")),
    ("card", "card", CARD, card_ok, lambda m: F.lit("[CARD NUMBER]")),
    ("ssn", "national_id", SSN, None, lambda m: F.lit("[NATIONAL ID]")),
    ("nino", "national_id", NINO, None, lambda m: F.lit("[NATIONAL ID]")),
    ("email", "email", EMAIL, None, lambda m: F.concat(F.lit("[email at "), F.lower(F.regexp_extract(m, EMAIL, 1)), F.lit("]"))),
    ("phone", "phone", PHONE, phone_ok, lambda m: F.lit("[PHONE]")),
)
_BY_NAME = {d[0]: d for d in DETECTORS}


def found(text: Column | str, name: str) -> Column:
    """The valid matches of one detector on the text as it is."""
    _, _, pattern, valid, _ = _BY_NAME[name]
    m = all_matches(text, pattern)
    return m if valid is None else F.filter(m, valid)


def masked(text: Column | str, name: str) -> Column:
    """The text with the valid matches of one detector masked."""
    _, _, pattern, valid, mask = _BY_NAME[name]
    return replaced(text, pattern, mask, valid)


def domains(text: Column | str) -> Column:
    """The distinct domains of e-mail addresses, in the order of their first use."""
    return F.array_distinct(F.transform(all_matches(text, EMAIL, 1), F.lower))


# ---- all detectors in turn, as one Arrow function


def _luhn(d: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _card(m: re.Match) -> bool:
    d = re.sub(r"\D", "", m[0])
    return 13 <= len(d) <= 19 and d[0] in "3456" and len(set(d)) > 1 and _luhn(d)


def _iban(m: re.Match) -> bool:
    s = re.sub(r"\s+", "", m[0]).upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _named(m: re.Match) -> bool:
    return not _PLACE.match(m[3]) and bool(re.search("[0-9]", m[3])) and bool(re.search("[A-Za-z]", m[3]))


_PLACE = re.compile(PLACEHOLDER, re.I)
_CHECKS = {"named": _named, "iban": _iban, "card": _card, "phone": lambda m: 9 <= len(re.sub(r"\D", "", m[0])) <= 15}
_MASKS = {"block": "[PRIVATE KEY]", "vendor": "[SECRET]", "iban": "[IBAN]", "card": "[CARD NUMBER]", "ssn": "[NATIONAL ID]", "nino": "[NATIONAL ID]", "phone": "[PHONE]"}
_STEPS = [(name, kind, re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)) for name, kind, pattern, _, _ in DETECTORS]


def scan_text(text: str | None, redact: bool = True) -> tuple[dict[str, int], list[str], str | None]:
    """(counts by type, e-mail domains, the text with masks) of one text."""
    counts, seen = dict.fromkeys(TYPES, 0), {}
    if text is None:
        return counts, [], None
    for name, kind, rx in _STEPS:

        def one(m: re.Match, name: str = name, kind: str = kind) -> str:
            if name in _CHECKS and not _CHECKS[name](m):
                return m[0]
            counts[kind] += 1
            if name == "email":
                seen[m[1].lower()] = None
            if not redact:
                return m[0]
            return f"{m[1]}{m[2]}[SECRET]" if name == "named" else f"[email at {m[1].lower()}]" if name == "email" else _MASKS[name]

        text = rx.sub(one, text)
    return counts, list(seen), text


def _scanned(texts: pd.Series) -> pd.DataFrame:
    rows = [scan_text(None if t is None else t) for t in texts]
    return pd.DataFrame({**{k: [r[0][k] for r in rows] for k in TYPES}, "domains": [r[1] for r in rows], "masked": [r[2] for r in rows]})


def scan(text: Column | str) -> Column:
    """Struct of the counts of all types, the e-mail domains and the masked text."""
    schema = ", ".join(f"{k} int" for k in TYPES) + ", domains array<string>, masked string"
    return F.pandas_udf(_scanned, schema)(F.col(text) if isinstance(text, str) else text)


def floor_level(secret: Column, card: Column, national_id: Column, iban: Column) -> Column:
    """The least sensitivity that counts of findings ask for; null for none."""
    return F.when((secret > 0) | (card > 0) | (national_id > 0), "restricted").when(iban > 0, "confidential")


def floor_reason(secret: Column, card: Column, national_id: Column, iban: Column) -> Column:
    parts = F.concat_ws(", ", F.when(secret > 0, "secrets"), F.when(card > 0, "card numbers"), F.when(national_id > 0, "national ID numbers"))
    return F.when(parts != "", parts).when(iban > 0, "bank account numbers")
