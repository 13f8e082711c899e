"""Personal data in texts of all kinds: find it, put typed placeholders or surrogates in its place.

E-mail addresses, telephone numbers, identity numbers and addresses are found by their grammars,
in tables also by columns whose cells mostly hold identity numbers or that the catalogue announces.
Names are found in two steps: every pair of words that can be a name is a candidate; candidates
whose given name (or, beside an initial, family name) stands in the *lexicon* are names.  The lexicon
is counted over all texts: the words that stand as given and as family names in the display names
of mail addresses and in the name columns of tables, besides :data:`GIVEN`.

Surrogates are keyed: the same person, number or address gets the same replacement wherever it
stands and in whatever form (``Nora Ruddwick``, ``RUDDWICK, N.``); given names keep their gender where it
is known, every replacement keeps script, case, punctuation and the number of figures.  Values of one
type never share a surrogate: collisions are counted over the whole corpus and drawn again.

Defined cases: null and empty texts hold nothing and stay as they are; repeated rows give their
values once; overlapping findings are settled by the order of :data:`TYPES`, then by length; extra
columns are kept by :func:`redact_pii` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import hmac
import hashlib
import hmac
import re
from collections.abc import Container, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.graph import cut

TYPES = ("email", "identity", "phone", "address", "name")
#: Given names known beforehand, with the gender they are mostly given to.
GIVEN = {
    "f": "Ada Adela Agnes Alice Amelia Anke Anna Anne Antonia Aurélie Bärbel Beatrice Begoña Beryl Birgit Bridget Carmen Caroline Catherine Célestine Chantal Christa Claire Clara Concha Daphne Dilys Dolores Dorothy Edith Élodie Eleanor Elena Elisabeth Elizabeth Elke Elvira Emily Emma Esther Eva Fiona Frances Gaëlle Gertrud Grace Gudrun Hannah Hazel Heike Helen Herminia Ilse Imogen Inès Isabel Jane Julia Karin Kate Käthe Katherine Laura Léa Leticia Lorna Louise Lucía Margaret Margit María Marie Martha Mary Mathilde Mercedes Monika Nadine Nathalie Nicole Noémie Nora Nuria Odile Olga Petra Phoebe Pilar Rocío Rosa Rosalind Ruth Sabine Sarah Simone Solène Sophie Susan Susanne Sylvie Tessa Una Úrsula Ursula Véronique Victoria Wiebke Winifred Ximena Yvonne Zoé",
    "m": "Adam Aidan Albert Alexander Andreas Andrew Antonio Arthur Beltrán Benoît Bernd Carlos Cedric Charles Christian Colin Damien Daniel Darío David Detlef Edward Edwin Fabrice Fermín Francisco François Frank Frederick Frieder Friedrich Gareth George Gonzalo Götz Hans Heiko Henry Hervé Íñigo Jacques James Jasper Javier Jean Jérôme Joaquín Johannes John Jörg José Joseph Juan Jürgen Keith Klaus Lothar Luis Manuel Marcelo Marcus Mark Michael Michel Norbert Oscar Óscar Ottmar Pablo Pascal Patrick Paul Pedro Peter Philippe Pierre Quentin Rafael Régis Richard Robert Rüdiger Samuel Saúl Stefan Stephen Stuart Teodoro Theodore Thibault Thomas Torsten Uwe Victor Víctor Walter William Wolfgang Yves",
}
_STATIC = {n.lower() for g in GIVEN.values() for n in g.split()}

# one blank, or the end of a wrapped line with the marks of a quote
_S = r"(?:[ \t\u00a0]|[ \t]*\r?\n(?:[ \t]*[>»|])*[ \t]?)"
_ONE = r"[ \t\u00a0]"


def _both(pattern: str, flags: int = 0) -> tuple[re.Pattern, re.Pattern]:
    """The pattern over wrapped lines, and within one line."""
    return re.compile(pattern, flags), re.compile(pattern.replace(_S, _ONE), flags)


_AT = r"(?:@|\s?[\[({<]\s?(?:at|ät|arroba|arobase|a)\s?[\])}>]\s?|\s(?:AT|at)\s(?=[\w\-]+\s?(?:[\[(]?\s?(?:dot|DOT|punkt|punto|point)\b)))"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|punto|point|\.)\s?[\])}]\s?|\s(?:dot|DOT|punkt|punto|point)\s)"
_EMAIL = re.compile(rf"(?<![\w.+\-@/:])[A-Za-z0-9À-ÿ][\w.+\-'’]*{_AT}[\w\-]+(?:{_DOT}[A-Za-z][\w\-]*)+", re.I)

_P = rf"(?:[.\-/]|{_S})"
_PHONE = _both(
    rf"(?<![\w+/.\-€£$#])(?:"
    rf"\(?\+\d{{1,3}}\)?(?:{_P}?\(0\){_P}?)?(?:{_P}?\(?\d{{1,9}}\)?){{1,6}}"
    rf"|00[1-9]\d{{0,2}}{_P}(?:\(0\))?\d{{1,9}}(?:{_P}?\d{{1,9}}){{0,5}}"
    rf"|\(0\d{{1,4}}\){_S}?\d{{2,8}}(?:{_P}\d{{2,5}}){{0,3}}|0\d{{1,4}}(?:{_P}?\d{{2,8}}){{1,4}}"
    rf"|(?:\(\d{{3}}\){_S}?|\d{{3}}[.\-]|\d{{3}} (?=\d{{3}}-))\d{{3}}[.\- ]\d{{4}}"
    rf"|[6-9]\d\d{_S}\d{{3}}{_S}\d{{3}}|[89]\d{_S}\d{{3}}{_S}\d\d{_S}\d\d"
    rf")(?![\w]|[.\-,/]\d)"
)
_BARE_PHONE = re.compile(r"(?<![\w.\-/])[6-9]\d{8}(?![\w]|[.\-,/]\d)")
_PHONE_BEFORE = re.compile(r"(?i)(?:\b(?:tel|tél|teléfono|telefon|phone|mobile|mobil|móvil|portable|fax|cell|call|on|unter|au|al|en el|m|t|or|oder|ou|o)\b[.:]?|☎|📞)[\s>]*\Z")
_NO_PHONE = re.compile(r"(?i)(?:\b(?:GB|EAN|SKU|SO|PO|PO box|tracking|part no\.?|VAT no\.?|company number|ref\.?|order|invoice|HRB|IBAN|n°|nr\.?|no\.)[\s>]*|[A-Z]-)\Z")
_PART = re.compile(r"\d{3}-\d{3}-\d{5}\Z|\d{3}-\d{4}\Z")
_DATE = re.compile(r"(?:[0-3]?\d[./\-][0-3]?\d[./\-](?:\d{4}|\d\d)|\d{4}[./\-]\d{1,2}[./\-]\d{1,2})(?![.\-/]?\d)")

#: Identity numbers whose form tells them apart.
_ID = (
    r"(?!000|666|9)\d{3}(?P<s1>[- ])\d{2}(?P=s1)\d{4}"  # United States, social security
    r"|[A-Z]{2}(?P<s2>[- ]?)\d{2}(?P=s2)\d{2}(?P=s2)\d{2}(?P=s2)[A-D]"  # United Kingdom, national insurance
    r"|[A-Z9]{5}\d{6}[A-Z9]{2}\d[A-Z]{2}"  # United Kingdom, driving licence
    r"|[12](?P<s3> ?)\d{2}(?P=s3)(?:0[1-9]|1[0-2]|[2-4]\d|5[0-9]|9\d)(?P=s3)\d[\dAB](?P=s3)\d{3}(?P=s3)\d{3}(?P=s3)\d{2}"  # France, social security
    r"|\d{2}[A-Z]{2}\d{5}"  # France, passport and identity card
    r"|[CFGHJKLMNPRTVWXYZ]\d{2}[A-Z]\d{2}[A-Z]\d{2}|[CFGHJK]\d{2}[A-Z]\d{5}"  # Germany, identity card, passport
    r"|[1-9]\d \d{3} \d{3} \d{3}|\d{2} \d{6} [A-Z] \d{3}"  # Germany, tax, pension
    r"|\d{8}-?[A-HJ-NP-TV-Z]|\d{2}\.\d{3}\.\d{3}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-HJ-NP-TV-Z]"  # Spain, DNI and NIE
)
_IDENTITY = _both(rf"(?<![\w.\-/+€£$])(?:{_ID.replace('[- ]', '(?:-|' + _S + ')').replace(' ?)', '(?:' + _S + ')?)').replace('(?P<s2>[- ]?)', '(?P<s2>-|' + _S + '|)')})(?![\w]|[-./]\w)")
_IDENTITY_CELL = re.compile(rf"(?:{_ID})\Z")
#: Forms that only their surroundings tell from other numbers.
_WEAK = r"[1-9]\d{8}|\d{11}|[A-Z]{3}\d{6}|[A-Z]\d{8}|[A-Z]{2}\d{7}|\d{2} ?\d{8} ?\d{2}|\d{2}/\d{8}-?\d{2}|\d{8}"
_WEAK_CELL = re.compile(rf"(?:{_WEAK})\Z")
_LABEL = (
    r"(?i:\b(?:SSN|social\s+security(?:\s+(?:no\.?|number))?|national\s+insurance(?:\s+(?:no\.?|number))?|NI\s+(?:number|no\.?)|NINO|passport(?:\s+(?:no\.?|number))?|driv(?:ing|er['’]?s)\s+licen[cs]e(?:\s+(?:no\.?|number))?|(?:tax|identity(?:\s+card)?)\s+(?:id|number|no\.?)|ITIN|TIN"
    r"|Steuer-?(?:ID|Id|nummer|nr\.?)|IdNr\.?|Steueridentifikationsnummer|Personalausweis(?:nr\.?|nummer)?|Ausweis(?:nr\.?|nummer)?|Reisepass(?:nr\.?|nummer)?|Führerschein(?:nr\.?|nummer)?|(?:Sozial|Renten)versicherungs(?:nr\.?|nummer)|SV-?Nr\.?"
    r"|NIR|(?:n[°ºo]\.?|numéro)\s+(?:de\s+)?(?:sécurité\s+sociale|sécu|fiscal|passeport)|carte\s+d['’]identité|CNI|passeport|permis(?:\s+de\s+conduire)?|numéro\s+fiscal|SPI"
    r"|DNI|NIE|NIF|pasaporte|(?:n\.?[º°]\s+de\s+)?(?:la\s+)?seguridad\s+social|NSS|permiso\s+de\s+conducir|carn[eé]\s+de\s+conducir))[\s:>]*"
)
_LABELLED = _both(rf"{_LABEL}(?P<id>[A-Z0-9][A-Z0-9.\-/]*(?:{_S}(?=[A-Z0-9.\-/]*\d|[A-Z]\b)[A-Z0-9.\-/]+){{0,7}})")
_PERSON_NEAR = _both(rf"(?<![\w.\-/+€£$])(?:(?P<a>(?<=\()(?:{_WEAK})(?=\)))|(?P<b>{_WEAK})(?={_S}(?:of|de|for|pour|von|für|del?){_S}(?:\w+\.{_S})?[A-ZÀ-Þ])|(?P<c>{_WEAK})(?=,{_S}(?:von{_S})?[A-ZÀ-Þ][\w’'.\-]*,?{_S}[A-ZÀ-Þ])|(?<=, )(?P<d>{_WEAK})(?=\.(?:\s|$)))(?![\w-])")
#: One of these stands in every label, in lower case.
_LABEL_PARTS = ("ssn", "social", "insurance", "ni number", "ni no", "ni\n", "nino", "passport", "licen", "tax id", "tax number", "tax no", "identity", "itin", "tin ", "steuer", "idnr", "ausweis", "reisepass", "führerschein", "versicherungsn", "sv-nr", "svnr", "nir", "sécu", "identité", "cni", "passeport", "permis", "fiscal", "spi ", "dni", "nie ", "nif", "pasaporte", "seguridad", "nss", "carn")
_NAME_BEFORE = re.compile(r"[A-ZÀ-Þ][\w’'.\-]+,?[\s>]+(?:(?:de|von|van|del)[\s>]+)?[A-ZÀ-Þ][\w’'.\-]+,?[\s>]*\(?\Z|[A-ZÀ-Þ]\.,?[\s>]*\(?\Z")
_NO_ID = re.compile(r"(?i)(?:\b(?:GB|EAN|SKU|SO|PO|RMA|GRN|INV|box|tracking|part no\.?|VAT no\.?|company number|invoice|order|Rechnung|factura|facture|item|unit)[\s>]*)\Z")

_N = r"[A-ZÀ-Þ][\w’'\-]*"
_OLD = rf"(?:Old{_S}|Upper{_S}|Lower{_S}|Great{_S}|New{_S}|The{_S})?"
_NUMBER_FIRST = _both(
    rf"(?:"
    rf"\d{{1,4}}[A-Za-z]?(?:[-–/]\d{{1,4}}[A-Za-z]?)?{_S}{_OLD}{_N}(?:{_S}{_N})?{_S}(?:Street|St|Road|Rd|Lane|Ln|Ave|Avenue|Close|Quay|Crescent|Cres|Terrace|Drive|Dr|Court|Ct|Way|Walk|Hill|Place|Pl|Square|Sq|Gardens|Grove|Row|Mews|Park|Parade|Boulevard|Blvd)\b\.?"
    rf"|\d{{1,4}}(?:{_S}?(?:bis|ter|quater))?,?{_S}(?:rue|avenue|av\.|boulevard|bd|blvd|impasse|chemin|place|quai|allée|allee|cours|route|ruelle|sentier|square|passage)(?:{_S}(?:de{_S}la|de{_S}l['’]|des|du|de|d['’]))?{_S}?{_N}(?:{_S}{_N})?"
    rf")(?![\w])"
)
_STREET_FIRST = _both(
    rf"(?<![\w/.\-€£$])(?:(?:Calle|C/|Avda\.|Avenida|Av\.|Paseo|P\.º|Plaza|Pza\.|Camino|Carretera|Ctra\.|Ronda|Travesía|Callejón|Glorieta){_S}?(?:(?:de{_S}las?|de{_S}los|del|de){_S})?{_N}(?:{_S}{_N})?,?{_S}(?:n\.?[º°]{_S}?)?\d{{1,4}}(?:-\d{{1,4}}|{_S}?[A-Z]\b)?"
    rf"|(?:{_N}(?:straße|strasse|str\.|weg|allee|platz|gasse|damm|ring|ufer|steig|stieg|chaussee|berg|hof|kamp|markt)|(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Unter den|Hinter der|Alte|Alter|Neue|Neuer){_S}{_N}|{_N}er{_S}(?:Straße|Str\.|Weg|Allee|Platz|Damm|Ring|Ufer)){_S}\d{{1,4}}{_S}?(?:[a-z]\b)?(?:[-–]\d{{1,4}}[a-z]?)?"
    rf")(?![\w])"
)
#: One of these stands in every address that begins with its street, in lower case.
_STREET_PARTS = ("calle", "c/", "avda", "avenida", "av.", "paseo", "p.º", "plaza", "pza", "camino", "carretera", "ctra", "ronda", "travesía", "glorieta", "straße", "strasse", "str.", "weg ", "weg\n", "allee", "platz", "gasse", "damm", "ring ", "ufer", "steig", "stieg", "chaussee", "berg ", "hof ", "kamp ", "markt")
#: The same for those that begin with a capital.
_STREET_HEADS = ("Am ", "An de", "Im ", "In der", "Auf de", "Zum ", "Zur ", "Unter den", "Hinter der", "Alte", "Neue")
#: Where a number can begin that is an identity, a telephone number or a house.
_START = re.compile(r"(?<![\w.\-/+€£$#])(?=[+(]{0,2}\d|[A-Z9]{1,5}[- ]?\d|[A-Z]{2}\r?\n)")
_BY_NUMBER = (("identity", _IDENTITY), ("phone", _PHONE), ("near", _PERSON_NEAR), ("bare", (_BARE_PHONE, _BARE_PHONE)), ("address", _NUMBER_FIRST))
_PHONES = [x for x in _BY_NUMBER if x[0] == "phone"]
_LETTERS = [x for x in _BY_NUMBER if x[0] in ("identity", "near")]
_RUN = re.compile(r"\d+")
_TRIED: dict[tuple[int, bool], list] = {}
_MONTH = re.compile(r"(?i)(?:Am|Im|Zum|Auf)\s+(?:jan|feb|mär|apr|mai|jun|jul|aug|sep|okt|nov|dez|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|quartal|jahr)")

_G = r"[A-ZÀ-Þ][a-zß-ÿ]+(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?"
_F = r"(?:[OD]['’])?(?:Mc|Mac)?[A-ZÀ-Þ][a-zß-ÿ]+(?:[A-ZÀ-Þ][a-zß-ÿ]+)?(?:-(?:\r?\n)?(?:[OD]['’])?[A-ZÀ-Þ][a-zß-ÿ]+)*"
_GU = r"[A-ZÀ-Þ]{2,}(?:-[A-ZÀ-Þ]{2,})?"
_FU = r"(?:[OD]['’])?[A-ZÀ-Þß]{2,}(?:-(?:\r?\n)?(?:[OD]['’])?[A-ZÀ-Þß]{2,})*"
_PART_OF = rf"(?:(?:de{_S}la|de{_S}los|de|del|von{_S}der|von|van{_S}der|van|zu|du|di|da|le|DE|VON|VAN|DEL){_S})?"
_NAMES = [
    # (pattern, what is the given name)
    re.compile(rf"(?<![\w’'\-@.])(?P<g>{_G})(?:{_S}(?:[A-ZÀ-Þ]\.{_S}?){{1,2}})?{_S}(?P<f>{_PART_OF}{_F})(?![\w@]|[’'\-][A-Za-z])"),
    re.compile(rf"(?<![\w’'\-@.])(?P<g>{_GU})(?:{_S}(?:[A-ZÀ-Þ]\.{_S}?){{1,2}})?{_S}(?P<f>{_PART_OF}{_FU})(?![\w@]|[’'\-][A-Za-z])"),
    re.compile(rf"(?<![\w’'\-@.])(?P<f>{_PART_OF}{_F}),{_S}(?P<g>{_G})(?:{_S}[A-ZÀ-Þ]\.)?(?![\w@]|[’'\-][A-Za-z]|{_S}(?:de{_S}|von{_S})?[A-ZÀ-Þ][a-z])"),
    re.compile(rf"(?<![\w’'\-@.])(?P<f>{_PART_OF}{_FU}),{_S}(?P<g>{_GU})(?:{_S}[A-ZÀ-Þ]\.)?(?![\w@]|[’'\-][A-Za-z]|{_S}[A-ZÀ-Þ]{{3}})"),
    re.compile(rf"(?<![\w’'\-@.])(?P<i>(?:[A-ZÀ-Þ]\.{_S}?){{1,3}})(?P<f>{_PART_OF}(?:{_F}|{_FU}))(?![\w@]|[’'\-][A-Za-z])"),
    re.compile(rf"(?<![\w’'\-@.])(?P<f>{_PART_OF}(?:{_F}|{_FU})),{_S}(?P<i>(?:[A-ZÀ-Þ]\.{_S}?){{1,3}})(?![\w@])"),
    re.compile(rf"(?<![\w’'\-@.])(?P<f>{_FU}|{_F}){_S}(?P<g>{_G})(?![\w@]|[’'\-][A-Za-z])"),
]
_LEGAL = re.compile(rf"{_S}(?:&|(?:Ltd|LLP|LLC|plc|PLC|Inc|GmbH|AG|KG|SARL|SAS|SA|S\.A\.|S\.L\.|Group|Holdings|Co)(?!\w))")
_NO_FAMILY = {"ltd", "llp", "llc", "plc", "inc", "gmbh", "ag", "kg", "sarl", "sas", "sa", "group", "holdings", "company"}
_PARTICLES = {"de", "del", "von", "van", "zu", "du", "di", "da", "le", "la", "der", "los"}
#: Words that begin sentences or name things, and so are no given names.
_NO_GIVEN = set("der die das den dem des ein eine einen im am zum zur vor nach auf mit für gemäß trotz während wie bitte unser unsere the this that these our we with on in at by from for after before despite during following once late as please if no any contact le la les un une des du au aux à selon malgré après avant depuis pour comme notre el los las del al según tras antes durante pese conforme con por para mr mrs ms dr herr frau monsieur madame sr sra dear hello hi hola bonjour hallo guten liebe estimado estimada cher chers".split())
_BEFORE = re.compile(r"(?<![\w.])([A-ZÀ-Þ][\w\-]+)[ \n>]+\Z")
_ADDRESS_MARK = re.compile(r"[ \t]<[^<>\s]+@[^<>\s]+>")
_REMARK = re.compile(r"[ \t]*\([^()\n]*\)[ \t]*\Z")
_CAPITAL = re.compile(r"(?<![\w’'.@])[A-ZÀ-Þ][a-zß-ÿA-ZÀ-Þ]*(?:-[A-ZÀ-Þ][a-zß-ÿA-ZÀ-Þ]+)?")
_COMMA_BEFORE = re.compile(rf"(?<![\w’'\-@.])({_PART_OF}(?:{_F}|{_FU})),{_S}\Z")
_WORD_BEFORE = re.compile(rf"(?<![\w’'\-@.])({_FU}|{_F}){_S}\Z")
_WRITTEN_OUT = re.compile(r"(?i)[\[({<]\s?(?:at|ät|arroba|arobase|a)\s?[\])}>]|\sat\s[\w\-]+\s?(?:dot|punkt|punto|point)\s")
_FIGURES = re.compile(r"\d")
_WRAPPED_LINE = re.compile(r"(?m)^.{40,100}\n(?:[ \t]*[>»|])*[ \t]?\S")
_PARTICLE = re.compile(rf"(?:de|von|del|di|da|du){_S}(?=[A-ZÀ-Þ])")
_NUMBER_BEFORE = re.compile(r"\d[\w\-]*[ \t\r\n>]+\Z")
_NAME_COLUMN = re.compile(r"(?i)\A(?:full[ _]?name|contact[ _]?name|employee|employee[ _]?name|person|vorname.*|nom.*|nombre.*|mitarbeiter|ansprechpartner)\Z")
_ID_COLUMN = re.compile(r"(?i)\A(?:id|tax ?id|ni[ _]?(?:number|no)|national[ _]?(?:id|insurance).*|ssn|social[ _]?security.*|passport.*|dni|nie|nif|steuer.*|ausweis.*|nir|identity.*)\Z")
_PHONE_COLUMN = re.compile(r"(?i)\A(?:phone|tel|telephone|telefon|teléfono|téléphone|mobile|móvil|cell|handy)[ _]?\w*\Z")


def _wrapped(text: str, s: int, e: int) -> bool:
    """Whether each line break inside text[s:e] comes from wrapping: the line is long, and the next word had no room on it."""
    at = text.find("\n", s, e)
    while at >= 0:
        begin = text.rfind("\n", 0, at) + 1
        rest = re.match(r"(?:[ \t]*[>»|])*[ \t]?(\S*)", text[at + 1 : at + 60])
        line = re.sub(r"\A(?:[ \t]*[>»|])+[ \t]?", "", text[begin:at].rstrip("\r"))
        if not 40 <= len(line) <= 100 or len(line) + 1 + len(rest[1] if rest else "") < 66:
            return False
        at = text.find("\n", at + 1, e)
    return True


def _digits(x: str) -> int:
    return sum(c.isdigit() for c in x)


def _columns(text: str) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """(name, cells as (place, value)) of each column of the sheets of a table's text."""
    at, header, cells = 0, None, []
    for line in text.split("\n"):
        if line.startswith('Sheet "') and " rows x " in line:
            if header:
                yield from zip(header, cells)
            header, cells = None, []
        elif " | " in line or header is None:
            if header is None:
                header = [x.strip() for x in line.rstrip("\r").split(" | ")]
                cells = [[] for _ in header]
            else:
                pos = at
                for k, x in enumerate(line.rstrip("\r").split(" | ")):
                    if k < len(cells):
                        cells[k].append((pos + len(x) - len(x.lstrip()), x.strip()))
                    pos += len(x) + 3
        at += len(line) + 1
    if header:
        yield from zip(header, cells)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    for m in _EMAIL.finditer(text):
        before = text[max(0, m.start() - 60) : m.start()]
        e = m.end()
        while text[e - 1] in ".-'’_":
            e -= 1
        if not re.search(r"://[^\s/]*\Z", before) and ("." in m[0] or re.search(r"(?i)dot|punkt|punto|point", m[0])):
            yield m.start(), e


def _matches(both: tuple[re.Pattern, re.Pattern], text: str, wrapped: bool, start: int, stop: int) -> Iterator[re.Match]:
    """Matches over lines that were wrapped, then those within one line."""
    if wrapped:
        for m in both[0].finditer(text, start, stop):
            if "\n" in m[0] and _wrapped(text, *m.span()):
                yield m
    yield from both[1].finditer(text, start, stop)


def _at(both: tuple[re.Pattern, re.Pattern], text: str, at: int, wrapped: bool) -> re.Match | None:
    """The match at one place: over wrapped lines if there is one, else within its line."""
    if wrapped and (m := both[0].match(text, at)) and "\n" in m[0] and _wrapped(text, *m.span()):
        return m
    return both[1].match(text, at)


def _is_phone(v: str, before: str) -> bool:
    n = _digits(v)
    if not 9 <= n <= 15 or _PART.match(v) or _DATE.match(v) or _NO_PHONE.search(before):
        return False
    return (v[0] in "+(" or v.startswith("00") or n <= 12) and v.count("(") == v.count(")")


def _is_identity(m: re.Match, before: str) -> bool:
    """Whether a number that only its surroundings can explain stands beside a name."""
    g = next(k for k in "abcd" if m[k])
    v = m[g]
    if _NO_ID.search(before) or (v[:3] in ("RMA", "GRN", "INV") and g != "a"):
        return False
    if g in "ad":
        return bool(_NAME_BEFORE.search(before)) and (g == "a" or len(v) >= 9)
    return not (len(v) == 8 and v.isdigit())


def _tried(text: str, at: int) -> list[tuple[str, tuple[re.Pattern, re.Pattern]]]:
    """The patterns that can match at a place, by its first character and, for a figure, how many follow each other there."""
    c = text[at]
    if c in "+(":
        return _PHONES
    if c.isalpha():
        return _LETTERS
    run = _RUN.match(text, at).end() - at
    key = (min(run, 16), c == "0" or run == 3 or (run == 2 and c in "89"))
    out = _TRIED.get(key)
    if out is None:
        want = {"identity": run in (1, 2, 3, 8, 15), "phone": key[1], "near": run >= 8 or run == 2, "bare": run == 9, "address": run <= 4}
        out = _TRIED[key] = [x for x in _BY_NUMBER if want[x[0]]]
    return out


def _numbers(text: str, wrapped: bool) -> Iterator[tuple[int, int, str]]:
    """Identity numbers, telephone numbers and addresses that begin with a number, and bare numbers after a label."""
    done = 0
    for s0 in _START.finditer(text):
        s = s0.start()
        if s < done:
            continue
        before = None
        for what, both in _tried(text, s):
            if not (m := _at(both, text, s, wrapped)):
                continue
            before = text[max(0, s - 60) : s] if before is None else before
            if what == "identity":
                good = not _NO_ID.search(before[-20:])
            elif what == "phone":
                good = _is_phone(m[0], before[-20:])
            elif what == "bare":
                good = bool(_PHONE_BEFORE.search(before[-20:]))
            elif what == "near":
                good = _is_identity(m, before)
            else:
                good = True
            if good:
                yield m.start(), m.end(), {"bare": "phone", "near": "identity"}.get(what, what)
                done = m.end()
                break
    low = text.lower()
    for part in _LABEL_PARTS:
        at = low.find(part)
        while at >= 0:
            for m in _matches(_LABELLED, text, wrapped, max(0, at - 30), min(len(text), at + 110)):
                v = m["id"].rstrip(".-/> \n\r")
                if not re.search(r"\d(?:[- ]|[\s>]+)?[A-Z]\Z", v):
                    v = re.sub(r"(?:[\s>]+[A-Z])+\Z", "", v)
                if _digits(v) >= 5 and len(re.sub(r"\W", "", v)) >= 7:
                    yield m.start("id"), m.start("id") + len(v), "identity"
            at = low.find(part, at + len(part))


def find(text: str | None, kind: str | None = None, announced: dict[str, str] | None = None, given: Container[str] = frozenset(_STATIC)) -> list[tuple[int, int, str, str | None, str | None]]:
    """(start, end, type, given, family): all findings of one text, overlaps between types settled.

    Names are candidates: ``given`` and ``family`` are the words to look up, ``given`` is "" for initials;
    both are None for the other types and for names that a column vouches for.  announced: type by
    column name, as the catalogue has it; it only counts where the cells do not speak against it.
    given: the given names, of which only those that stand in the text matter.
    """
    text = text or ""
    table = kind in ("table", "spreadsheet")
    wrapped = not table and "\n" in text and _WRAPPED_LINE.search(text) is not None
    found: list[tuple[int, int, str, str | None, str | None]] = []
    if "@" in text or _WRITTEN_OUT.search(text):
        found += [(s, e, "email", None, None) for s, e in _emails(text)]
    if _FIGURES.search(text):
        found += [(s, e, t, None, None) for s, e, t in dict.fromkeys(_numbers(text, wrapped))]
        low = text.lower()
        if any(p in low for p in _STREET_PARTS) or any(p in text for p in _STREET_HEADS):
            found += [(*m.span(), "address", None, None) for m in _matches(_STREET_FIRST, text, wrapped, 0, len(text)) if not _MONTH.match(m[0])]
    if table:
        for name, cells in _columns(text):
            full = [(s, v) for s, v in cells if v]
            said = (announced or {}).get(name, "")
            strict = sum(bool(_IDENTITY_CELL.match(v)) for _, v in full)
            weak = [(s, v) for s, v in full if _WEAK_CELL.match(v)]
            if full and (strict + len(weak)) >= 0.5 * len(full) and (strict >= 0.2 * len(full) or _ID_COLUMN.match(name) or said == "national_id"):
                found += [(s, s + len(v), "identity", None, None) for s, v in weak]
            if _PHONE_COLUMN.match(name) or said == "phone":
                found += [(s, s + len(v), "phone", None, None) for s, v in full if re.fullmatch(r"[+(]?\d[\d ().\-/]{7,18}\d", v) and 9 <= _digits(v) <= 15]
            if _NAME_COLUMN.match(name) or (said == "person_name" and sum(any(w.lower() in given for w in _WORDS.findall(v)) for _, v in full) >= 0.3 * len(full)):
                for s, v in full:
                    x = re.match(r"(?:(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme|mlle|sr|sra|srta|dña|doña|don)\.?\s+|[MD]\.\s+(?=[A-ZÀ-Þ][\w’'\-]+\s+\S))?", v, re.I).end()
                    w = v[x:].strip()
                    if re.fullmatch(r"[^\W\d_][\w’'.\-]*(?:,? [^\W\d_][\w’'.\-]*){1,4}", w) and not _LEGAL.search(" " + w):
                        found.append((s + x, s + x + len(w), "name", None, None))
    taken = bytearray(len(text) + 1)
    out = []
    for s, e, t, g, f in sorted(found, key=lambda r: (TYPES.index(r[2]), -(r[1] - r[0]), r[0])):
        if not any(taken[s:e]):
            taken[s:e] = b"\1" * (e - s)
            out.append((s, e, t, g, f))
    for n, m in _name_matches(text, given):
        s, e = m.span()
        g, f = m.groupdict().get("g") or "", m["f"]
        if n in (2, 3, 5) and (x := _PARTICLE.match(text, s)) and _NUMBER_BEFORE.search(text, max(0, s - 30), s):
            s = x.end()  # "passport CSB803342 de Gormby, Nora": no part of the name
        if g.lower() in _NO_GIVEN or f.lower() in _NO_GIVEN or f.lower() in _NO_FAMILY or any(taken[s:e]):
            continue
        if "\n" in m[0] and (table or not _wrapped(text, s, e)):
            continue
        if _LEGAL.match(text, e):
            continue
        if n == 4 and (w := _BEFORE.search(text[max(0, s - 40) : s])) and w[1].lower() not in _NO_GIVEN:
            continue  # the initials between a given and a family name
        while text[e - 1] in " \n\r\t>":
            e -= 1
        # a tab marks the orders of words that only a known family name bears out
        out.append((s, e, "name", g.lower() + ("\t" if n in (2, 3, 6) else ""), _family(re.split(r"[\s>]+", f)[-1])))
    return out


def _name_matches(text: str, given: Container[str]) -> Iterator[tuple[int, re.Match]]:
    """(number of the pattern, match) of all that can be a name, around given names and around initials."""
    for w in _CAPITAL.finditer(text):
        v = w[0]
        if len(v) == 1:
            if text[w.end() : w.end() + 1] == "." and w.start() == w.end() - 1:
                for n in (4, 5):
                    at = w.start() if n == 4 else _comma_before(text, w.start())
                    if at is not None and (m := _NAMES[n].match(text, at)):
                        yield n, m
        elif v.lower() in given:
            for n in (0, 1):
                if m := _NAMES[n].match(text, w.start()):
                    yield n, m
            if (at := _comma_before(text, w.start())) is not None:
                for n in (2, 3):
                    if (m := _NAMES[n].match(text, at)) and m.start("g") == w.start():
                        yield n, m
            if (b := _WORD_BEFORE.search(text, max(0, w.start() - 50), w.start())) and (m := _NAMES[6].match(text, b.start(1))) and m.start("g") == w.start():
                yield 6, m


class _Every:
    """All words."""

    def __contains__(self, word: str) -> bool:
        return True


def looked_up(text: str, kind: str | None) -> set[str]:
    """All words of a text that :func:`find` and :func:`_bears` can look up, whatever the lexicon holds."""
    out = {w[0].lower() for w in _CAPITAL.finditer(text)}
    for _, m in _name_matches(text, _Every()):
        out |= {(m.groupdict().get("g") or "").lower(), _family(re.split(r"[\s>]+", m["f"])[-1])}
    if kind in ("table", "spreadsheet"):
        out.update(w.lower() for _, cells in _columns(text) for _, v in cells for w in _WORDS.findall(v))
    return out


def _comma_before(text: str, at: int) -> int | None:
    """Where the family name before a comma before this place begins."""
    m = _COMMA_BEFORE.search(text, max(0, at - 70), at)
    return m.start(1) if m else None


def _family(word: str) -> str:
    """The first part of a family name without O' or d', in lower case."""
    return re.sub(r"\A[od]['’]", "", word.split("-")[0].lower())


def _shown(before: str) -> str:
    """The display name at the end of what stands before an address."""
    x = _REMARK.sub("", before[before.rfind("\n") + 1 :]).rstrip()
    if x.endswith('"'):
        return x[x.rfind('"', 0, -1) + 1 : -1]
    return re.split(r"[,;:<>|\"]", x)[-1].strip().strip("'")


def _names_of(text: str, kind: str | None) -> Iterator[tuple[str, str]]:
    """(word, role): the words of names whose place shows them to be names."""
    names = [_shown(text[max(0, m.start() - 90) : m.start()]) for m in _ADDRESS_MARK.finditer(text)]
    if kind in ("table", "spreadsheet"):
        names += [v for name, cells in _columns(text) if _NAME_COLUMN.match(name) for _, v in cells if v]
    for n in names:
        n = re.sub(r"(?i)\A(?:(?:from|to|cc|von|an|de|para|à|a)\s?:\s*|\*)+", "", n.strip()).strip("\"' *")
        n = re.sub(r"(?i)\A(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme|mlle|sr|sra|srta)\.?\s+", "", n)
        head, comma, tail = n.partition(", ")
        words = (tail + " " + head if comma else n).split()
        words = [w for w in words if not re.fullmatch(r"[A-ZÀ-Þ]\.?", w)]
        words = [w for w in words if w.lower() not in _PARTICLES]
        if 2 <= len(words) <= 3 and all(re.fullmatch(r"[^\W\d_][\w’'\-]*", w) for w in words):
            yield words[0].lower(), "g"
            yield _family(words[-1]), "f"
        elif len(words) == 1 and re.search(r"(?<!\w)[A-ZÀ-Þ]\.", n):
            yield _family(words[0]), "f"


def lexicon(df: DataFrame, kind_col: str = "kind", text_col: str = "text") -> DataFrame:
    """(word, role): given ("g") and family ("f") names counted over all texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in set(_names_of(t, k))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["word", "role"])

    named = df.filter(F.col(text_col).contains("@") | F.col(kind_col).isin("table", "spreadsheet")).select(kind_col, text_col).filter(F.length(text_col) > 0)
    n = named.mapInArrow(scan, "word string, role string").groupBy("word").agg(F.count_if(F.col("role") == "g").alias("g"), F.count_if(F.col("role") == "f").alias("f"))
    counted = n.select("word", F.when((F.col("g") >= 2) & (F.col("g") >= F.col("f")), "g").when(F.col("f") >= 1, "f").alias("role")).filter("role is not null")
    fixed = df.sparkSession.createDataFrame([(w, "g") for w in sorted(_STATIC)], "word string, role string")
    return fixed.unionByName(counted.join(F.broadcast(fixed.select("word")), "word", "left_anti"))


#: A lexicon of at most so many words is sent to every executor; of a larger one each text gets the words that stand in it.
BROADCAST_WORDS = 300_000


def _bears(given: str, family: str, is_given, is_family) -> bool:
    """Whether a candidate is a name: its given name is known, or stands as an initial or behind the family name and the family name is known."""
    if is_given(family):
        return False
    if given == "" or given.endswith("\t"):
        return is_family(family) and (given == "" or is_given(given[:-1]))
    return is_given(given)


def pii_spans(df: DataFrame, announced: DataFrame | None = None, id_col: str = "file_id", kind_col: str = "kind", text_col: str = "text") -> DataFrame:
    """Rows (id, start, end, pii_type, pii_value), for each row of df.  announced: (id, pii_columns) of the catalogue; the largest list of an id counts."""
    src = df.select(F.col(id_col).alias("id"), F.col(kind_col).alias("kind"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    words = lexicon(src)
    first = words.limit(BROADCAST_WORDS + 1).collect()
    small = len(first) <= BROADCAST_WORDS
    known = df.sparkSession.sparkContext.broadcast({r: frozenset(x["word"] for x in first if x["role"] == r) if small else None for r in "gf"})
    kind_of = src.schema["id"].dataType.simpleString()
    names = ["id", "start", "end", "pii_type", "pii_value"]
    schema = f"id {kind_of}, start int, end int, pii_type string, pii_value string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, families = known.value["g"], known.value["f"]
        for b in batches:
            rows = []
            column = dict(zip(b.schema.names, b.columns))
            told, own_given, own_families = (column[c].to_pylist() if c in column else [None] * b.num_rows for c in ("pii_columns", "given", "families"))
            for i, k, t, cols, g_own, f_own in zip(column["id"].to_pylist(), column["kind"].to_pylist(), column["text"].to_pylist(), told, own_given, own_families):
                if not small:
                    given, families = frozenset(g_own or ()), frozenset(f_own or ())
                for s, e, y, g, f in find(t, k, {c["name"]: c["data"] for c in cols or [] if c}, given):
                    if f is None or _bears(g, f, given.__contains__, families.__contains__):
                        rows.append((i, s, e, y, t[s:e]))
            types = (column["id"].type, pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    if announced is None:
        parts = [src]
    else:
        tables = F.coalesce(F.col("kind").isin("table", "spreadsheet"), F.lit(False))
        told = announced.toDF("id", "pii_columns").filter("size(pii_columns) > 0").groupBy("id").agg(F.max_by("pii_columns", F.size("pii_columns")).alias("pii_columns"))
        parts = [src.filter(~tables), src.filter(tables).join(told, "id", "left").select("id", "kind", "text", "pii_columns")]
    if not small:
        words = cut(words)
        parts = [_with_words(p, words) for p in parts]
    rows = [p.mapInArrow(scan, schema) for p in parts]
    return reduce(DataFrame.unionByName, rows).withColumnRenamed("id", id_col)


def _with_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The rows (kind, text ..) with the given names and the families of the lexicon that stand in each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, w) for i, k, t in zip(*(c.to_pylist() for c in b.columns)) for w in looked_up(t, k)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["_text", "word"])

    # by the text itself: ids may be null, and words of another text, should two coincide, are never looked up
    rows = rows.withColumn("_text", F.xxhash64("text"))
    held = rows.select("_text", "kind", "text").mapInArrow(scan, "_text bigint, word string").join(words, "word")
    own = held.groupBy("_text").agg(*(F.collect_set(F.when(F.col("role") == r, F.col("word"))).alias(c) for r, c in (("g", "given"), ("f", "families"))))  # bounded by the text
    return rows.join(own, "_text", "left").drop("_text")


def pii_values(df: DataFrame, announced: DataFrame | None = None, id_col: str = "file_id") -> DataFrame:
    """Distinct rows (id, pii_type, pii_value)."""
    return pii_spans(df, announced, id_col).select(id_col, "pii_type", "pii_value").distinct()


# ---- replacements

_VOWELS, _CONSONANTS = "aeiou", "bdfgklmnprstvz"


def _stream(key: bytes, *parts: object) -> Iterator[int]:
    """Bytes that the key and the parts determine."""
    n = 0
    while True:
        yield from hmac.new(key, "\0".join(map(str, (*parts, n))).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        n += 1


def _like(value: str, rnd: Iterator[int], letters_too: bool = True) -> str:
    """The value with its figures and letters drawn anew; case, script, length and all other characters stay."""
    out = []
    for c in value:
        if c.isdigit():
            out.append("0123456789"[next(rnd) % 10])
        elif c.isalpha() and letters_too:
            low = c.lower()
            if "\u0370" <= low <= "\u03ff":
                new = "αβγδεζηθικλμνξοπρστυφχψω"[next(rnd) % 24]
            elif "\u0400" <= low <= "\u04ff":
                new = "абвгдежзиклмнопрстуфхцчшыэюя"[next(rnd) % 28]
            else:
                new = (_VOWELS if low in "aeiouáéíóúàèìòùâêîôûäëïöüãõåæœøy" else _CONSONANTS)[next(rnd) % (5 if low in "aeiouáéíóúàèìòùâêîôûäëïöüãõåæœøy" else 14)]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


_WORDS = re.compile(r"[^\W\d_ºª]+(?:['’][^\W\d_ºª]+)*")
_STREET_WORD = re.compile(r"(?i)\A(?:old|upper|lower|great|new|the|street|st|road|rd|lane|ln|ave|avenue|close|quay|cres(?:cent)?|terrace|drive|dr|court|ct|way|walk|hill|place|pl|square|sq|gardens|grove|row|mews|park|parade|boulevard|blvd|bd|bis|ter|quater|rue|impasse|chemin|quai|allée|cours|route|ruelle|sentier|passage|de|la|l|des|du|d|calle|c|avda|avenida|av|paseo|plaza|camino|carretera|ronda|travesía|n|am|an|der|im|in|auf|dem|zum|zur|unter|den|hinter|alte[rs]?|neue[rs]?|straße|str|weg|platz|damm|ring|ufer|[a-z])\Z")
_STREET_END = re.compile(r"(?i)(?:straße|strasse|str|weg|allee|platz|gasse|damm|ring|ufer|steig|stieg|chaussee|berg|hof|kamp|markt)\Z")


def _national(value: str) -> str:
    """A telephone number's figures without country code and leading zeros: the same however it is written."""
    d = re.sub(r"\D", "", re.sub(r"\(0\)", "", value))
    if re.match(r"\(?\+|00", value):
        d = re.sub(r"\A(?:00)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", "", d)
    return d.lstrip("0")


def units(kind: str, value: str) -> list[tuple[str, str]]:
    """(kind of unit, unit): the parts of a value that are replaced alike wherever they stand."""
    if kind == "phone":
        return [("phone", _national(value))]
    if kind == "identity":
        return [("identity", re.sub(r"\W", "", value).upper())]
    if kind == "email":
        plain = re.sub(r"\s?[\[({<]?\s?\b(?:at|ät|arroba|arobase)\b\s?[\])}>]?\s?", "@", value, count=1, flags=re.I) if "@" not in value else value
        plain = re.sub(r"\s?[\[({<]?\s?\b(?:dot|punkt|punto|point)\b\s?[\])}>]?\s?", ".", plain, flags=re.I)
        return [("email", re.sub(r"\s", "", plain).lower())]
    if kind == "address":
        return [("street", _STREET_END.sub("", w.lower())) for w in _WORDS.findall(value) if not _STREET_WORD.match(w)] + [("house", re.sub(r"\W", "", "".join(re.findall(r"\d+\w?", value))).lower())]
    words = [w for w in _WORDS.findall(value) if w.lower() not in _PARTICLES]
    if "," in value:
        words = words[-1:] + words[:-1] if len(words) > 1 else words
    out = []
    for n, w in enumerate(words):
        if len(w) == 1:
            out.append(("initial", w.lower()))
        else:
            out.append(("given" if n == 0 and len(words) > 1 else "family", w.lower()))
    return out


def draw(key: bytes, kind: str, unit: str, attempt: int) -> str:
    """The surrogate of a unit, in lower case; given names of a known gender are permuted among those of their gender."""
    if kind == "given" and attempt == 0:
        for gender, pool in GIVEN.items():
            own = sorted(dict.fromkeys(x.lower() for x in pool.split()))
            if unit in own:
                drawn = sorted(own, key=lambda x: hmac.new(key, f"{gender}\0{x}".encode(), hashlib.sha256).digest())
                # a cycle through the drawn order: everyone moves, no two to the same name
                return drawn[(drawn.index(unit) + 1) % len(drawn)]
    rnd = _stream(key, kind, unit, attempt)
    if kind == "initial":
        order = sorted("abcdefghijklmnopqrstuvwxyz", key=lambda x: hmac.new(key, f"initial\0{x}".encode(), hashlib.sha256).digest())
        return order[(order.index(unit) + 1) % 26] if unit in order else unit
    if kind == "email":
        local, _, domain = unit.partition("@")
        head, dot, top = domain.rpartition(".")
        return f"{_like(local, rnd)}@{_like(head, rnd)}{dot}{top}"
    return _like(unit, rnd)


def _cased(new: str, like: str) -> str:
    if like.isupper() and len(like) > 1:
        return new.upper()
    if like[:1].isupper():
        return "".join(w[:1].upper() + w[1:] for w in re.split(r"(['’])", new))
    return new


def render(kind: str, value: str, drawn: dict[tuple[str, str], str]) -> str:
    """The value with its units replaced, in the value's own format."""
    if kind in ("phone", "identity"):
        new = [c for c in drawn[units(kind, value)[0]] if c.isalnum()]
        out = []
        for c in reversed(value):  # from the end, so that country code and zeros stay
            out.append((new.pop().upper() if c.isupper() else new.pop().lower()) if c.isalnum() and new and not (kind == "phone" and not c.isdigit()) else c)
        return "".join(reversed(out))
    if kind == "email":
        new = drawn[units(kind, value)[0]]
        local, _, domain = new.partition("@")
        m = re.search(_AT, value, re.I)
        tail = re.split(f"({_DOT})", value[m.end() :], flags=re.I)
        parts = domain.split(".")
        tail[0::2] = [_cased(p, o) for p, o in zip(parts, tail[0::2])] + tail[0::2][len(parts) :]
        left = value[: m.start()]
        return (local.upper() if left.isupper() else local) + m[0] + "".join(tail)
    if kind == "address":
        house = iter(drawn[units(kind, value)[-1]])
        done = re.sub(r"\d+", lambda m: "".join(next((c for c in house if c.isdigit()), "1") for _ in m[0]), value)
        return _WORDS.sub(lambda m: m[0] if _STREET_WORD.match(m[0]) else _cased(drawn[("street", _STREET_END.sub("", m[0].lower()))], m[0]) + (_STREET_END.search(m[0]) or [""])[0], done)
    by_word = {u: drawn[(k, u)] for k, u in units(kind, value)}
    return _WORDS.sub(lambda m: _cased(by_word[m[0].lower()], m[0]) if m[0].lower() in by_word else m[0], value)


def surrogates(values: DataFrame, key: bytes) -> DataFrame:
    """(pii_type, pii_value, surrogate) for the distinct rows (pii_type, pii_value).

    Units whose surrogates coincide with another unit's surrogate, or with a unit that exists, are
    drawn again until all differ; the least unit keeps the surrogate.
    """
    distinct = cut(values.select("pii_type", "pii_value").distinct())

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, v, k, u) for t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, u in units(t, v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], pa.string()) for x in range(4)], names=["pii_type", "pii_value", "kind", "unit"])

    def drawing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, u, n = (b.column(x).to_pylist() for x in range(3))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in range(3)), pa.array([draw(key, *x) for x in zip(k, u, n)], pa.string())], names=["kind", "unit", "attempt", "drawn"])

    used = distinct.mapInArrow(parts, "pii_type string, pii_value string, kind string, unit string")
    all_units = cut(used.select("kind", "unit").distinct())
    schema = "kind string, unit string, attempt int, drawn string"
    taken = cut(all_units.withColumn("attempt", F.lit(0)).mapInArrow(drawing, schema))
    free = F.col("kind").isin("initial", "house")  # too few of them to differ; what they stand beside does
    while True:
        twice = taken.filter(~free).groupBy("kind", "drawn").agg(F.min("unit").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        again = taken.join(twice, ["kind", "drawn"]).filter("unit != first").select("kind", "unit", "attempt")
        # given names of a known gender change places among themselves; no other surrogate may be a unit that exists
        exists = taken.filter(~free & ~((F.col("kind") == "given") & (F.col("attempt") == 0) & F.col("unit").isin(sorted(_STATIC)))).join(all_units.select("kind", F.col("unit").alias("drawn")), ["kind", "drawn"], "left_semi").select("kind", "unit", "attempt")
        again = cut(again.unionByName(exists).distinct().withColumn("attempt", F.col("attempt") + 1))
        if again.isEmpty():
            break
        taken = cut(taken.join(again.select("kind", "unit"), ["kind", "unit"], "left_anti").unionByName(again.mapInArrow(drawing, schema)))

    def rendering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, v, d = (b.column(x).to_pylist() for x in range(3))
            out = [render(x, y, {(r["kind"], r["unit"]): r["drawn"] for r in z}) for x, y, z in zip(t, v, d)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["pii_type", "pii_value", "surrogate"])

    joined = used.join(taken, ["kind", "unit"]).groupBy("pii_type", "pii_value").agg(F.collect_set(F.struct("kind", "unit", "drawn")).alias("drawn"))
    return joined.mapInArrow(rendering, "pii_type string, pii_value string, surrogate string")


def redact_pii(df: DataFrame, announced: DataFrame | None = None, key: bytes | None = None, id_col: str = "file_id", kind_col: str = "kind", text_col: str = "text", out_col: str = "redacted_text") -> DataFrame:
    """All rows and columns of df plus the text without personal data: typed placeholders such as [PHONE], or, with a key, surrogates."""
    spans = pii_spans(df, announced, id_col, kind_col, text_col)  # the rows of one id have one text; its findings are a set
    if key is None:
        new = spans.withColumn("new", F.concat(F.lit("["), F.upper("pii_type"), F.lit("]")))
    else:
        spans = cut(spans)
        new = spans.join(surrogates(spans, key).withColumnRenamed("surrogate", "new"), ["pii_type", "pii_value"])
    per_text = new.groupBy(F.col(id_col).alias("_pii_id")).agg(F.sort_array(F.collect_set(F.struct("start", "end", "new"))).alias("_pii_spans"))  # bounded by the text
    text = F.col(text_col)
    # the pieces between the findings and what stands for these, joined in order; of overlapping ones the first counts
    step = F.aggregate(
        F.coalesce("_pii_spans", F.array().cast("array<struct<start:int,end:int,new:string>>")),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), x["new"]).alias("out"), x["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return df.join(per_text, F.col(id_col) == F.col("_pii_id"), "left").withColumn(out_col, step).drop("_pii_id", "_pii_spans")
