"""Personal information in free text, by a semi-Markov conditional random field.

Candidate segments with features of the whole span (its form, digit grouping, words before and after, dictionary and ending of its
parts) are scored by learned weights. Text outside segments scores zero. A dynamic programme over the segments' ends chooses
boundaries and kinds together: best(end) = max(best(before), best(start) + score(segment)), with segments of bounded length.
Weights are learned in pii_train.py by the gradient of the conditional likelihood over the same lattice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

#: Spaces and hyphens of other widths, and the plain ones they are read as; one for one, so positions hold.
_ODD, _PLAIN = "\u00a0\u2007\u2009\u202f\u2010\u2011\u2012\u2013\u2212", "    -----"
_EVEN = str.maketrans(_ODD, _PLAIN)

KINDS = ("email", "phone", "person_id", "address", "name")
#: Longest segment in characters (a mail address has at most 320) and longest name in tokens: the bounds of the dynamic programme.
LONGEST, NAME_TOKENS = 320, 5

# Words that stand before a name and are no part of its core.
TITLES = set("mr mrs ms miss dr prof sir herr herrn frau fräulein г-н г-на г-ну г-жа г-жи г-же гр господин госпожа mr. mrs. ms. dr. prof.".split())
# Log levels and abbreviations that are written in capitals.
CAPITALS = set("trace trc debug dbg info inf notice warn warning wrn error err severe fatal critical crit panic alert emerg sms kyc ssn инн снилс id http "
               "https json url api sql get put post delete order by select from where null z utc msk cest cet est edt qq qv xj zx jvm cpu io db".split())
#: Shorter and longer bounds tried for one pattern match, besides the match itself.
MOST_CUTS = 6
#: Forms of numbers of which a worker keeps the cuts and scores.
MOST_FORMS = 65_536
_NINES = bytes.maketrans(b"012345678", b"999999999")

_LOCAL = r"[\p{L}\p{N}](?:[\p{L}\p{N}._+-]*[\p{L}\p{N}])?"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
_EMAIL = [
    ("@", rf"(?<![\p{{L}}\p{{N}}@]){_LOCAL}@{_LABEL}(?:\.{_LABEL})*"),
    (" @ ", rf"(?<![\p{{L}}\p{{N}}@]){_LOCAL} @ {_LABEL}(?:\.{_LABEL})+"),
    ("%40", rf"(?<![\p{{L}}\p{{N}}@]){_LOCAL}%40{_LABEL}(?:\.{_LABEL})+"),
    ("(at)", rf"(?<![\p{{L}}\p{{N}}@]){_LOCAL} ?(?:\((?i:at|собака)\)|\[(?i:at)\]|\{{(?i:at)\}}) ?{_LABEL}(?: ?(?:\((?i:dot|punkt|точка)\)|\[(?i:dot)\]|\.) ?{_LABEL})+"),
    ("at", rf"(?<![\p{{L}}\p{{N}}@]){_LOCAL} (?i:at) {_LABEL}(?: (?i:dot) {_LABEL})+"),
]
_DIGITS = regex.compile(r"(?<![\p{L}\p{N}_.+/:#-])(?:\+ ?|\()?\d[\d ()./-]{5,24}\d(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_.+-])\d{7,12}(?![\p{L}\p{N}_])")
_DATE = regex.compile(r"(?<!\d)(?:\d\d\.\d\d\.(?:19|20)\d\d|(?:19|20)\d\d[-/.]\d\d[-/.]\d\d)(?!\d)|^\d{1,3}(?:\.\d{1,3}){3}$")
_WORD_ID = (r"(?i:(?:passport|pass|паспорт\w*|снилс|инн|ssn|social security|tax id|nino|national insurance|steuer-?(?:id|nummer)|steuernummer|sozialversicherungsnummer|"
            r"personalausweis\w*|ausweis(?:-?nr\.?|nummer|es)?|reisepass\w*|identity card|id card|удостоверени\w+)(?: (?:no\.?|nr\.?|number|nummer|№|номер|серия))?)")
_LABELLED_ID = regex.compile(_WORD_ID + r"\s?[:=#№]?\s?(?=[\p{L}\d-]*\d)[\p{Lu}\d][\p{Lu}\d-]*(?: [\d-]{2,7}){0,5}(?: [A-D]\b)?")
_FORM = (r"(?<![\p{L}\p{N}_.+-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}-\d{3}-\d{3}[ -]\d{2}|\d{2} ?\d{2} \d{6}|\d{4} №? ?\d{6})(?![\p{L}\p{N}_-])")
_FORM_ID = re.compile(_FORM.replace(r"\p{L}\p{N}_", r"\w"))
_CAP = r"\p{Lu}[\p{L}’'-]*"
# Words for streets.
_STREET_EN = r"(?:Street|St\b\.?|Lane|Ln\b\.?|Road|Rd\b\.?|Avenue|Ave\b\.?|Drive|Dr\b\.|Close|Court|Ct\b\.?|Crescent|Cres\b\.?|Way|Square|Sq\b\.?|Place|Pl\b\.|Terrace|Boulevard|Blvd\b\.?|Row|Walk|Gardens|Grove|Hill|Mews|Parade|Park|Quay)"
_STREET_DE = r"(?:straße|strasse|str\.|weg|platz|allee|ufer|gasse|ring|damm|steig|chaussee|stieg|markt|pfad|graben|hof)"
_STREET_RU = r"(?:ул\.|улица|улице|улицы|пер\.|переулок|пр-т|просп\.|проспект|пр\.|наб\.|набережная|б-р|бульвар|ш\.|шоссе|пл\.|площадь|проезд|пр-д|аллея|тупик)"
_TOWN = r"(?:\p{Lu}\p{Ll}[\p{L}-]*(?: \p{Lu}\p{Ll}[\p{L}-]*){0,2})"
_POST_UK = r"[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}"
_UNIT_EN = r"(?:Flat|Unit|Apt\.?|Apartment|Suite|Room)"
_NUM_RU = r"(?:д\.? ?|дом )?\d{1,4}(?: ?[а-яА-Я]\b)?(?:/\d+)?(?: ?(?:к|корп\.?|стр\.?) ?\d+)?"
_ADDRESS = {
    "en": regex.compile(
        rf"(?<![\p{{L}}\p{{N}}_/*#-])(?:{_UNIT_EN} \d+[A-Z]?, )?\d{{1,4}}[A-Za-z]? (?:{_CAP} ){{1,3}}?{_STREET_EN}(?:,? {_UNIT_EN} \d+[A-Z]?)?"
        rf"(?:, (?!(?:to|and)\b){_TOWN})?(?:,? {_POST_UK}|,? [A-Z]{{2}} \d{{5}})?"),
    "de": regex.compile(
        rf"(?<![\p{{L}}\p{{N}}_/-])(?:\d{{5}} {_TOWN}, )?(?:\p{{Lu}}[\p{{L}}-]*{_STREET_DE}|\p{{Lu}}[\p{{L}}-]+(?:er|e)? (?:Straße|Str\.|Weg|Platz|Allee|Ufer|Gasse|Ring|Damm)) \d{{1,4}} ?(?:[a-z]\b)?"
        rf"(?:, (?:(?:Whg\.?|Wohnung|App\.?|Apartment) \d+))?(?:, \d{{5}} {_TOWN}|, (?!\d){_TOWN})?"),
    "ru": regex.compile(
        rf"(?<![\p{{L}}\p{{N}}_/-])(?:\d{{6}}, )?(?:(?:г\.|город|с\.|пос\.|д\.) ?{_TOWN}, ?)?"
        rf"(?:{_STREET_RU} ?\p{{Lu}}[\p{{L}}-]+(?: \p{{L}}[\p{{L}}-]+){{0,2}},? {_NUM_RU}|\p{{Lu}}[\p{{L}}-]+ (?:улица|переулок|проспект|набережная|площадь|шоссе|бульвар|аллея),? {_NUM_RU})"
        rf"(?:, ?(?:кв\.?|квартира|оф\.?|офис) ?\d+)?(?:, (?:\d{{6}},? )?(?:г\.|город) ?{_TOWN})?"),
}
_EMAIL_RE = [(form, regex.compile(p)) for form, p in _EMAIL]
_NAME_TOKEN = regex.compile(r"(?<![\p{L}\p{N}_/.@%-])(?:\p{Lu}\p{Ll}+(?:[-’']\p{Lu}\p{Ll}+)*(?![\p{L}\p{N}_@%=/\\-])(?!\.\p{L}{2})(?!\(\)))|(?<![\p{L}\p{N}_/.@%-])\p{Lu}{2,}(?:-\p{Lu}{2,})*(?![\p{L}\p{N}_@%=/\\-])|(?<![\p{L}\p{N}_@%-])\p{Lu}\.(?=[ \p{Lu},])|(?<![\p{L}\p{N}_@%-])\p{Lu}\.(?![\p{L}\p{N}])")
# Allowed orders in a name. W word, U word in capitals, I initial, a comma stands for itself.
_NAME_ORDERS = set("WW WWW WIW IW IIW WI WII W,W W,WI W,I W,II WW,W W,WW UU UUU UIU IU IIU UI UII U,U U,UI U,I U,II U,UU".split())
_PATRONYMIC = regex.compile(r"(?i)(?:вич|вна|ична|вича|вны|вичу|вне)$")
_PREV = regex.compile(r"(?:^|[^\p{L}\p{N}-])([\p{L}][\p{L}-]*)[\s:;,.«»„“\"'‘(\[=]*$")
_NEXT = regex.compile(r"^[\s»“”\"'’)\],;:.]*([\p{L}][\p{L}-]*|\d)?")

_TLD = regex.compile(r"(?i)(?:\.|dot[)\]]? ?|\(punkt\) ?)\p{L}{2,}$")
_AT = regex.compile(r"(?i)@|%40|[(\[{]at[)\]}]| at ")
_RUN, _LATIN, _LETTERS = regex.compile(r"\d+"), regex.compile(r"[A-Z]+"), regex.compile(r"[\p{L}-]+")
_LABEL_SEAM, _DIGIT_SEAM, _COMMA_SEAM = regex.compile(r"\. ?(?=\p{L})"), regex.compile(r"(?<=\d)[ ./-]+(?=[\d(+])"), regex.compile(r", ?")
_PHONE_PART = regex.compile(r"(?:\+ ?|\()?\d[\d ()./-]{5,24}\d")
_ENDS, _GOES_ON = regex.compile(r"[\d)][ ./-]?$"), regex.compile(r"[ ./-]?[\d(]|, ?[\p{Lu}\d]")
_LAST_WORD = regex.compile(r"([\p{L}-]+)\.? ?[«„'\"‘]?$")
# Letters that a text must hold, in lower case, before a pattern is tried on it.
_EMAIL_SIGNS = {"@": ["@"], " @ ": [" @ "], "%40": ["%40"], "(at)": ["at)", "at]", "at}", "собака)"], "at": [" dot "]}
_ID_SIGNS = "pass паспорт снилс инн ssn social tax nino insurance steuer sozial ausweis card удостоверени".split()
_STREET_SIGNS = {"en": "street st lane ln road rd av dr close court ct cres way sq pl terrace boulevard blvd row walk gardens grove hill mews parade park quay".split(),
                 "de": "straße strasse str. weg platz allee ufer gasse ring damm steig chaussee stieg markt pfad graben hof".split(),
                 "ru": "ул. улиц пер. переул пр-т просп пр. наб б-р бульвар ш. шоссе пл. площадь проезд пр-д аллея тупик".split()}

# What a text may hold. A pattern is tried on a text only if the form of the same bit stands in it.
EMAIL, PHONE, FORM, LABELLED, STREET_EN, STREET_DE, STREET_RU, NAME = (1 << i for i in range(8))
_STREETS = {"en": STREET_EN, "de": STREET_DE, "ru": STREET_RU}
EVERYTHING = 255
# The candidates' own patterns, or wider ones, in the language of RE2: no look around (the sign beside is part of the match), no word bounds, digits and spaces
# of any script by name.
_LN, _SPACE = r"[\p{L}\p{N}]", r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]?"
_re2 = lambda p: p.replace(r"\b", "").replace(r"\d", r"\p{Nd}").replace(r"\w", r"[\p{L}\p{M}\p{N}\p{Pc}]")
_SIGNS = {
    EMAIL: rf"{_LN}(?: ?@ ?|%40){_LN}|{_LN} ?(?:\((?i:at|собака)\)|\[(?i:at)\]|\{{(?i:at)\}}) ?{_LN}|{_LN} (?i:at) {_LN}[\p{{L}}\p{{N}}-]* (?i:dot) ",
    PHONE: r"(?:^|[^\p{L}\p{N}_.+/:#-])(?:\+ ?|\()?\p{Nd}(?:[ ()./-]*\p{Nd}){6,}(?:$|[^\p{L}\p{N}_])|(?:^|[^\p{L}\p{N}_.+-])\p{Nd}{7,12}(?:$|[^\p{L}\p{N}_])",
    FORM: _re2(_FORM.replace(r"(?<![\p{L}\p{N}_.+-])", r"(?:^|[^\p{L}\p{N}_.+-])").replace(r"(?![\p{L}\p{N}_-])", r"(?:$|[^\p{L}\p{N}_-])")),
    LABELLED: _re2(_WORD_ID) + _SPACE + "[:=#№]?" + _SPACE + r"(?:\p{Nd}|\p{Lu}[\p{L}\p{Nd}-]*\p{Nd})",
    STREET_EN: r"\p{Nd}[A-Za-z]? (?:" + _CAP + " ){1,3}" + _re2(_STREET_EN),
    STREET_DE: r"[\p{L}-](?:" + _STREET_DE[3:-1] + r"| (?:Straße|Str\.|Weg|Platz|Allee|Ufer|Gasse|Ring|Damm)) \p{Nd}",
    STREET_RU: r"(?:^|[^\p{L}\p{N}_/-])" + _STREET_RU + r" ?\p{Lu}|[\p{L}-] (?:улица|переулок|проспект|набережная|площадь|шоссе|бульвар|аллея),? (?:д|\p{Nd})",
    NAME: (r"(?:^|[^\p{L}\p{N}_/.@%-])\p{Lu}\p{Ll}+(?:[-’']\p{Lu}\p{Ll}+)*,? \p{Lu}[\p{Ll}.]|\p{Lu}{2},? \p{Lu}[\p{Lu}.]|"
           r"(?:^|[^\p{L}\p{N}_@%-])\p{Lu}\. ?\p{Lu}[\p{Lu}\p{Ll}]"),
}
# A date and hour that a match of _DIGITS begins and ends with, as nothing before or after can be part of it: such a match is never a candidate.
_DAY_HOUR = r"""(^|["'\[\]=,;<>{}|])(?:(?:19|20)[0-9][0-9][-/.][0-9][0-9][-/.][0-9][0-9]|[0-9][0-9]\.[0-9][0-9]\.(?:19|20)[0-9][0-9]) [0-9][0-9]:"""
# Signs that are read as others (_ODD), that match others when case is ignored, or of scripts of which RE2 may know fewer letters: such texts may hold everything.
_UNSURE = r"[^\x{00}-\x{9F}\x{A1}-\x{12F}\x{132}-\x{17E}\x{180}-\x{52F}\x{2014}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{2116}]"


def _match(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).fill_null(False).to_numpy(zero_copy_only=False)


def signs(texts: pa.Array) -> np.ndarray:
    """For each text the bits of the candidates that it may hold, wider than the candidates themselves, by one pass of RE2 for each bit; 0 for null."""
    out = np.zeros(len(texts), np.uint8)
    for bit, pattern in _SIGNS.items():
        if bit not in (PHONE, STREET_RU):
            out[_match(texts, pattern)] |= bit
    numbers = np.flatnonzero(_match(texts, _SIGNS[PHONE]))
    rest = pc.replace_substring_regex(texts.take(pa.array(numbers)), _DAY_HOUR, r"\1~:")
    out[numbers[_match(rest, _SIGNS[PHONE])]] |= PHONE
    wide = np.flatnonzero(pc.not_equal(pc.binary_length(texts), pc.utf8_length(texts)).fill_null(False).to_numpy(zero_copy_only=False))  # with signs beyond ASCII
    rest = texts.take(pa.array(wide))
    out[wide[_match(rest, _SIGNS[STREET_RU])]] |= STREET_RU
    out[wide[_match(rest, _UNSURE)]] = EVERYTHING
    return out


def may_hold(text: str = "text") -> Column:
    """Whether a text can hold a candidate at all; false for null. The operators below take the bits of signs() where they read the texts."""
    return F.arrow_udf(lambda x: pa.array(signs(x) > 0), "boolean")(F.col(text))


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """The learned weights."""
    path = Path(__file__).with_name("pii_model.json")
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except OSError:  # inside an archive
        import pkgutil

        return json.loads(pkgutil.get_data(__package__, "pii_model.json").decode("utf-8"))


class Lexicon:
    """Words known as parts of names. No word proves a name; membership is one feature among others."""

    def __init__(self, given: set[str] = frozenset(), family: set[str] = frozenset()):
        self.given, self.family = {x.casefold() for x in given}, {x.casefold() for x in family}

    def role(self, word: str) -> str:
        w = word.casefold()
        for x in (w, *w.split("-")):
            if x in self.family or x[-1:] == "а" and x[:-1] in self.family:
                return "f"
        return "g" if w in self.given else "-"


def _around(text: str, a: int, b: int) -> list[str]:
    p = _PREV.search(text, max(0, a - 40), a) if a else None
    n = _NEXT.match(text[b:b + 40])
    return [f"prev={p.group(1).casefold() if p else ''}", f"next={(n.group(1) or '').casefold() if n else ''}"]


def _grouping(span: str) -> str:
    """Digit runs as lengths, everything else as written."""
    return _RUN.sub(lambda m: str(len(m.group())), span)


def _plain(text: str) -> str:
    """The text with spaces and hyphens of other widths made plain; positions hold."""
    return text if text.isascii() else text.translate(_EVEN)


def _has(low: str, signs: list[str]) -> bool:
    for x in signs:
        if x in low:
            return True
    return False


def _cuts(text: str, a: int, b: int, at: regex.Pattern, fits) -> list[tuple[int, int]]:
    """The span a..b and the shorter ones that begin or end at a separator matched by `at` and for which `fits` holds, at most MOST_CUTS: which of them is
    the segment is left to the scores."""
    out = [(a, b)]
    if b - a < 13 and text[a:b].isdigit():
        return out
    seams = [(m.start(), m.end()) for m in at.finditer(text, a, b)]
    for x, y in [(a, s) for s, _ in reversed(seams)] + [(e, b) for _, e in seams]:
        if len(out) > MOST_CUTS:
            break
        if x < y and fits(text[x:y]):
            out.append((x, y))
    return out


def _edge(text: str, a: int, b: int) -> str:
    """Whether what stands next to a segment would go on with it."""
    before, after = text[max(0, a - 2):a], text[b:b + 3]
    return f"edge={bool(_ENDS.search(before))}{bool(_GOES_ON.match(after))}"


def _form(span: str) -> str:
    """A number with 9 for every digit from 0 to 9."""
    return span.encode().translate(_NINES).decode()


@lru_cache(maxsize=MOST_FORMS)
def _number_cuts(form: str) -> list[tuple[int, int, int]]:
    """(start, end, digits) of the spans of a number that may be a phone's; which they are does not depend on what the digits are."""
    unopened = form[0] == "(" and form.count("(") > form.count(")")  # the bracket belongs to the text around
    out = []
    for a, b in _cuts(form, unopened, len(form), _DIGIT_SEAM, _PHONE_PART.fullmatch):
        digits = sum(map(str.isdigit, form[a:b]))
        if 7 <= digits <= 16 and form.count("(", a, b) == form.count(")", a, b):
            out.append((a, b, digits))
    return out


def _number(span: str, digits: int) -> list[str]:
    """Features of a number itself."""
    start = span.lstrip("( ")
    return [f"digits={digits}", f"group={_grouping(span)}", f"lead={start[:2] if start[:1] in '+08' else 'd'}", f"plus={span[0] == '+'}", f"bare={span.isdigit()}"]


class NumberBounds:
    """Whether a number can score above zero at all: by its own features, which depend on its form and first signs only, and the most that what stands around can add."""

    def __init__(self, w: dict[str, float]):
        most = lambda f: max([0.0, *(x for k, x in w.items() if k.startswith(f"phone {f}="))])
        self.w, self.known = w, {}
        self.around = most("prev") + most("next") + 1e-6  # sums in another order differ by less than that
        self.any_edge = most("edge")

    def hopeless(self, text: str, a: int, b: int, digits: int) -> bool:
        span = text[a:b]
        form = span[:3] + _form(span[3:]) if span[0] in "+08(" else _form(span)
        own = self.known.get(form)
        if own is None:
            if len(self.known) >= MOST_FORMS:
                self.known.clear()
            own = self.known[form] = score("phone", _number(span, digits), self.w)
        s = own + self.around
        return s + self.any_edge <= 0 or s + self.w.get(f"phone {_edge(text, a, b)}", 0.0) <= 0


def candidates(text: str, lexicon: Lexicon, may: int = EVERYTHING, bounds: NumberBounds | None = None) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of every segment considered. Matches of the patterns are cut at their separators in several ways, so that bounds, too, are
    chosen by the scores. may: bits of the patterns to try (signs()). bounds: numbers that cannot score above zero are left out."""
    out: list[tuple[int, int, str, list[str]]] = []
    low = text.lower() if may & ~(PHONE | FORM | NAME) else ""
    for form, pattern in _EMAIL_RE if may & EMAIL else ():
        if _has(low, _EMAIL_SIGNS[form]):
            for m in pattern.finditer(text):
                for a, b in _cuts(text, *m.span(), _LABEL_SEAM, pattern.fullmatch):
                    tld = _TLD.search(_AT.split(text[a:b])[-1])
                    out.append((a, b, "email", [f"form={form}", f"tld={bool(tld)}", f"whole={(a, b) == m.span()}", f"gap={'. ' in text[a:b]}", "then=:" if text[b:b + 1] == ":" and text[b + 1:b + 2].strip() else "then="]))
    for m in _DIGITS.finditer(text) if may & PHONE else ():
        spans = [(m.start() + a, m.start() + b, digits) for a, b, digits in _number_cuts(_form(m.group()))]
        if bounds:
            spans = [x for x in spans if not bounds.hopeless(text, *x)]
        if spans and not _DATE.search(m.group()):
            out += [(a, b, "phone", [*_number(text[a:b], digits), _edge(text, a, b), *_around(text, a, b)]) for a, b, digits in spans]
    for m in _FORM_ID.finditer(text) if may & FORM else ():
        g = _LATIN.sub("L", _grouping(m.group()))
        out.append((*m.span(), "person_id", [f"group={g}", *_around(text, *m.span())]))
    if may & LABELLED and _has(low, _ID_SIGNS):
        for m in _LABELLED_ID.finditer(text):
            word = _LETTERS.match(m.group()).group().casefold()
            for a, b in _cuts(text, *m.span(), _DIGIT_SEAM, _LABELLED_ID.fullmatch):
                digits = sum(c.isdigit() for c in text[a:b])
                out.append((a, b, "person_id", [f"word={word}", f"enough={7 <= digits <= 14}", _edge(text, a, b)]))
    latin = text.isascii()
    for lang, pattern in _ADDRESS.items():
        if may & _STREETS[lang] and not (latin and lang == "ru") and _has(low, _STREET_SIGNS[lang]):
            for m in pattern.finditer(text):
                for a, b in _cuts(text, *m.span(), _COMMA_SEAM, pattern.fullmatch):
                    out.append((a, b, "address", [f"lang={lang}", f"whole={(a, b) == m.span()}", _edge(text, a, b), *_around(text, a, b)]))
    if may & NAME:
        _name_candidates(text, lexicon, out)
    return out


def _name_candidates(text: str, lexicon: Lexicon, out: list) -> None:
    tokens = [m for m in _NAME_TOKEN.finditer(text) if m.group().casefold() not in TITLES and m.group().casefold() not in CAPITALS]
    n = len(tokens)
    shape = ["I" if t.group().endswith(".") else "W" if t.group()[1].islower() else "U" for t in tokens]
    for i in range(n):
        order, j = shape[i], i
        while j + 1 < n and j - i + 1 < NAME_TOKENS:
            gap = text[tokens[j].end():tokens[j + 1].start()]
            if gap == ", ":
                order += ","
            elif gap not in (" ", "") or gap == "" and shape[j] != "I":
                break
            j += 1
            order += shape[j]
            if order not in _NAME_ORDERS:
                continue
            a, b = tokens[i].start(), tokens[j].end()
            words = [t.group() for t, s in zip(tokens[i:j + 1], shape[i:j + 1]) if s != "I"]
            roles = [lexicon.role(w) for w in words]
            before = text[max(0, a - 12):a]
            title = _LAST_WORD.search(before)
            feats = [f"order={order}", f"roles={''.join(sorted(roles))}", *_around(text, a, b),
                     f"title={bool(title and title.group(1).casefold() in TITLES)}", f"known={sum(r != '-' for r in roles)}"]
            for w in words:
                w = w.casefold()
                feats.append(f"w={w}")
                feats.append(f"end={w[-3:]}")
                if _PATRONYMIC.search(w):
                    feats.append("patronymic")
            out.append((a, b, "name", feats))


def score(kind: str, feats: list[str], w: dict[str, float]) -> float:
    s = w.get(f"{kind}", 0.0)
    for f in feats:
        s += w.get(f"{kind} {f}", 0.0)
    return s


def best_segments(text: str, lexicon: Lexicon, w: dict[str, float], may: int = EVERYTHING, bounds: NumberBounds | None = None) -> list[tuple[int, int, str]]:
    """The highest-scoring set of segments that do not overlap, in order."""
    found = [(b, a, k, s) for a, b, k, f in candidates(text, lexicon, may, bounds) if b - a <= LONGEST and (s := score(k, f, w)) > 0]
    if not found:
        return []
    found.sort()
    ends, best, choice = [0], [0.0], [None]
    for b, a, k, s in found:
        lo, hi = 0, len(ends)
        while lo < hi:  # the last end not after the start
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ends[mid] <= a else (lo, mid)
        total = best[lo - 1] + s
        if total > best[-1]:
            ends.append(b)
            best.append(total)
            choice.append((a, b, k, lo - 1))
    out, i = [], len(choice) - 1
    while i > 0:
        a, b, k, i = choice[i]
        out.append((a, b, k))
    return out[::-1]


@lru_cache(maxsize=1)
def _bounds() -> NumberBounds:
    return NumberBounds(weights())


def find(text: str | None, lexicon: Lexicon, may: int = EVERYTHING) -> list[tuple[int, int, str]]:
    """Segments of one text, by the patterns that its signs() name. Null, empty and blank texts have none."""
    return best_segments(_plain(text), lexicon, weights(), may, _bounds()) if text and text.strip() else []


def redact(text: str | None, lexicon: Lexicon, may: int = EVERYTHING) -> str | None:
    """The text with <kind> in place of each segment and everything else as it was."""
    if not text:
        return text
    out, at = [], 0
    for a, b, k in find(text, lexicon, may):
        out += [text[at:a], f"<{k}>"]
        at = b
    return "".join(out) + text[at:]


def read_lexicon(name_parts: DataFrame, most: int = 100_000) -> Lexicon:
    """The name parts as a lexicon; the table has a proven bound of `most` rows."""
    rows = name_parts.select("part_text", "part_role").where("part_text is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("name_parts is no small table")
    return Lexicon({r[0] for r in rows if r[1] == "given"}, {r[0] for r in rows if r[1] == "family"})


def fields(log_lines: DataFrame, kb: DataFrame) -> DataFrame:
    """(field_name, rec_id, text) of every free text."""
    return log_lines.select(F.lit("raw").alias("field_name"), F.col("line_id").alias("rec_id"), F.col("raw").alias("text")).unionByName(
        kb.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col("kb_id").alias("rec_id"), F.col(c).alias("text"))
                                      for c in ("symptoms", "root_cause")])).alias("x")).select("x.*"))


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 65_536, size: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Batches put together up to `rows` rows and `size` bytes, as RE2 translates its patterns anew for each; a larger one stays alone."""
    kept, n, held = [], 0, 0
    for b in batches:
        if kept and (n + b.num_rows > rows or held + b.nbytes > size):
            yield pa.concat_batches(kept)
            kept, n, held = [], 0, 0
        kept.append(b)
        n, held = n + b.num_rows, held + b.nbytes
    if kept:
        yield pa.concat_batches(kept)


def _held(texts: pa.Array) -> Iterator[tuple[int, str, int]]:
    """(row, text, bits) of the texts that may hold a candidate."""
    bits = signs(texts)
    at = np.flatnonzero(bits)
    return zip(at.tolist(), texts.take(pa.array(at)).to_pylist(), bits[at].tolist())


def occurrences(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """field_name, rec_id, kind, occ_no of each occurrence. Texts that cannot hold a candidate never become Python strings; no shuffle.

    Null, empty and blank texts have none; repeated rows count each; an empty table gives none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _larger(batches):
            at, kinds, numbers = [], [], []
            for i, text, may in _held(b.column(2)):
                seen: dict[str, int] = {}
                for _, _, k in find(text, lexicon, may):
                    seen[k] = seen.get(k, 0) + 1
                    at.append(i)
                    kinds.append(k)
                    numbers.append(seen[k])
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(kinds, pa.string()), pa.array(numbers, pa.int32())], names=["field_name", "rec_id", "kind", "occ_no"])

    return texts.select("field_name", "rec_id", "text").mapInArrow(run, "field_name string, rec_id bigint, kind string, occ_no int")


def masked(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """field_name, rec_id, text with typed placeholders, of every row; null and empty texts as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _larger(batches):
            new = {i: redact(text, lexicon, may) for i, text, may in _held(b.column(2))}
            there = np.zeros(b.num_rows, bool)
            there[list(new)] = True
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.replace_with_mask(b.column(2), pa.array(there), pa.array(new.values(), b.column(2).type))], names=["field_name", "rec_id", "text"])

    return texts.select("field_name", "rec_id", "text").mapInArrow(run, "field_name string, rec_id bigint, text string")
