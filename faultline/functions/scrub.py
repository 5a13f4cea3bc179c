"""Secrets and personal data in one pass: what an earlier kind takes no later one sees again."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Names after which a value is a secret, and schemes that may stand before it.
SECRET_NAMES = ["password", "passwd", "secret", "token", "api[_-]?key", "authorization", "bearer", "private[_-]?key", "access[_-]?key"]
SCHEMES = ["bearer", "basic", "token", "key"]
#: Published forms of access tokens: fixed start, alphabet, least number of letters after it.
TOKENS = [("sk-", "A-Za-z0-9", 16), ("gh[oprsu]_", "A-Za-z0-9", 20), ("AKIA", "0-9A-Z", 16), ("xox[abprs]-", "A-Za-z0-9-", 10)]
#: Layouts of telephone numbers: lead, then groups of digits; and whether brackets may enclose the first group.
PHONES = [(r"(?:\+7|8)", [3, 3, 2, 2], r"[\s-]?"), (r"\+?1", [3, 3, 4], r"[\s.-]")]


def _either(xs) -> str:
    return "(?:" + "|".join(xs) + ")"


def _secret() -> str:
    return rf"\b({'|'.join(SECRET_NAMES)})\b\s*[:=]\s*(?:{_either(SCHEMES)}\s+)?(\S+)"


def _credentials() -> str:
    """scheme://user:password@, of which the scheme is kept."""
    return r"\b([a-z][a-z0-9+.-]*://)[^\s/:@]+:[^\s/@]+@"


def _token() -> str:
    part = r"[\w-]+"
    return "(" + "|".join([rf"eyJ{part}\.{part}\.{part}", *[f"{start}[{letters}]{{{n},}}" for start, letters, n in TOKENS]]) + ")"


def _digits(*groups: int, between: str) -> str:
    return between.join(rf"\d{{{n}}}" for n in groups)


def _phone() -> str:
    forms = [rf"{lead}{gap}\(?\d{{{groups[0]}}}\)?{gap}{_digits(*groups[1:], between=gap)}" if "?" in gap else rf"{lead}{gap}{_digits(*groups, between=gap)}" for lead, groups, gap in PHONES]
    forms.append(r"\(\d{3}\)[\s.-]?" + _digits(3, 4, between=r"[\s.-]?"))
    return rf"((?<!\d){_either(forms)}(?!\d))"


#: (kind, pattern, number of groups) in order of priority. SNILS and passport are personal numbers; 20 digits are an account; 13 to 19 digits may be a card.
RULES = [
    ("secret", _secret(), 2), ("urlcred", _credentials(), 1), ("token", _token(), 1), ("email", r"([\w.+-]+@[\w-]+\.[\w.-]+)", 1),
    ("person_id", f"({_digits(3, 3, 3, between='-')} {_digits(2, between='')}|{_digits(2, 2, 6, between=' ')})", 1), ("account", rf"(\b{_digits(20, between='')}\b)", 1),
    ("card", rf"({_either(['(?:' + _digits(4, between='') + '[ -]){3}' + _digits(4, between='')])}\b|\b\d{{13,19}}\b)", 1), ("phone", _phone(), 1),
]
KINDS = [kind for kind, *_ in RULES]
PATTERN = "(?i)" + "|".join(pattern for _, pattern, _ in RULES)
#: First group of each kind in PATTERN.
_GROUP = {kind: 1 + sum(n for *_, n in RULES[:i]) for i, (kind, *_) in enumerate(RULES)}


def hits(text: Column) -> Column:
    """Array of (match, kind, label) in order; a card number that fails its check digit has kind null and stays as it is."""
    all_ = lambda g: F.regexp_extract_all(text, F.lit(PATTERN), g)
    z = F.arrays_zip(all_(0).alias("all"), *[all_(g).alias(kind) for kind, g in _GROUP.items()])

    def one(x: Column) -> Column:
        digits = F.regexp_replace(x["card"], r"\D", "")
        is_card = F.call_function("luhn_check", digits)
        kind, label = F.lit(None).cast("string"), x["all"]
        for k in reversed(KINDS):
            found = F.coalesce(x[k], F.lit("")) != ""
            shown = {"secret": F.concat(x[k], F.lit("=<redacted>")), "urlcred": F.concat(x[k], F.lit("<redacted>@")),
                     "card": F.when(is_card, F.concat(F.lit("<card:…"), F.right(digits, F.lit(4)), F.lit(">"))).otherwise(x["all"])}.get(k, F.lit(f"<{k}>"))
            kind = F.when(found, F.when(is_card, k) if k == "card" else F.lit(k)).otherwise(kind)
            label = F.when(found, shown).otherwise(label)
        return F.struct(x["all"].alias("match"), kind.alias("kind"), label.alias("label"))

    return F.transform(z, one)


def scrub(text: Column) -> Column:
    """The text with labels in place of what was found; null stays null."""
    gaps = F.split(text, PATTERN, -1)
    labels = F.transform(hits(text), lambda h: h["label"])
    return F.array_join(F.flatten(F.zip_with(gaps, labels, lambda g, x: F.array(g, F.coalesce(x, F.lit(""))))), "")


def scrub_counts(text: Column) -> Column:
    """Map from kind to how often it was found."""
    found = F.filter(F.transform(hits(text), lambda h: h["kind"]), lambda k: k.isNotNull())
    return F.map_from_entries(F.transform(F.array_distinct(found), lambda k: F.struct(k, F.size(F.filter(found, lambda x: x == k)))))
