"""Patterns of the detectors, written once and rendered for the JVM, for Python and for SQL engines with RE2.

All three are meant to read letters, digits and spaces as Unicode does, and to ignore case by simple folding, in which
i and I are the only forms of i: neither the dotted capital nor the dotless small letter folds to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from veilframe.kinds import PREFIXES, Settings

#: What each detector looks for.
LABELS = ("password", "passwd", "pwd", "parola", "şifre", "sifre", "pass", "key", "anahtar", "secret", "token", "pin")
LABEL_VALUE = r"""("[^"\n]+"|'[^'\n]+'|\S+)"""
CREDENTIAL = r"""[^\s:=,;|"'<>]{6,}"""
CREDENTIAL_SPECIALS = "@!#$%^&*?+=~"
IBAN = r"\bTR\d{2}(?: ?\d{4}){5} ?\d{2}\b"
CARD = r"\b(?:\d[ \-]?){12,18}\d\b"
NATIONAL_ID = r"\b[1-9]\d{10}\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+90[ \-]?|0)?\(?[2-5]\d{2}\)?[ \-]?\d{3}[ \-]?\d{2}[ \-]?\d{2}"
PHONE_INTERNATIONAL = r"\+\d{1,3}(?:[ \-]?\d{2,4}){2,4}"
PERSON_NAME = r"\b[A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}(?:[ \t]+[A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}){1,2}\b"
PLACEHOLDER = rf"(?:{'|'.join(PREFIXES)})_\d+"
#: Trimmed from a credential before it is judged, though not before it is masked.
TRIM_END, TRIM_START = ".,;:!?)»”’", "(«„“‘"

#: White_Space, for engines whose \s is another set.
SPACE_CLASS = r"\t-\r \x85\xa0  -     　"
_META = set(r"\.+*?()|[]{}^$#&-~/")


def folded(word: str) -> str:
    """A literal for a case-insensitive pattern, in which forms of i keep to simple folding."""
    out = []
    for c in word:
        if c in "iI":
            out.append("(?-i:[iI])")
        elif c in "İı":
            out.append(f"(?-i:{c})")
        else:
            out.append("\\" + c if c in _META else c)
    return "".join(out)


def labelled_password() -> str:
    return rf"\b({'|'.join(map(folded, LABELS))})\b\s*[:=\-]\s*{LABEL_VALUE}"


def custom_words(words: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(map(folded, words))})"


@dataclass(frozen=True)
class Detector:
    """A pattern of one kind; ignore_case and the emitted group belong to it, validators are in `validators`."""

    name: str
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    #: What the first character of a match must be; asked before a word boundary, which costs the JVM far more.
    first: str = ""

    def java(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + (f"(?={self.first})" if self.first else "") + self.pattern

    def python(self) -> str:
        spelled = self.pattern.replace(r"[^\s", "[^" + SPACE_CLASS).replace(r"\S", f"[^{SPACE_CLASS}]").replace(r"\s", f"[{SPACE_CLASS}]")
        return ("(?i)" if self.ignore_case else "") + spelled


def detectors(settings: Settings) -> list[Detector]:
    """The detectors that run under these settings."""
    found = [
        Detector("custom_word", "custom_word", custom_words(settings.words), ignore_case=True) if settings.words else None,
        Detector("labelled_password", "password", labelled_password(), ignore_case=True, group=2, first=f"[{''.join(sorted({w[0] for w in LABELS}))}]"),
        Detector("credential", "password", CREDENTIAL),
        Detector("iban", "iban", IBAN, first="T"),
        Detector("credit_card", "credit_card", CARD, first=r"\d"),
        Detector("national_id", "national_id", NATIONAL_ID, first="[1-9]"),
        Detector("email", "email", EMAIL),
        Detector("phone_international", "phone", PHONE_INTERNATIONAL),
        Detector("phone", "phone", PHONE, first="[+0(2-5]"),
        Detector("person_name", "person_name", PERSON_NAME, first="[A-ZÇĞİÖŞÜ]"),
    ]
    return [d for d in found if d and settings.on(d.kind)]
