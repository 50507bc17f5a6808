"""Kinds of sensitive values, in the order that breaks ties, and which of them run."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Kind:
    order: int
    name: str
    prefix: str
    aliases: tuple[str, ...]


#: The placeholder prefixes, their order and the names a configuration may use.
KINDS = (
    Kind(0, "password", "SIFRE", ("password", "sifre", "şifre")),
    Kind(1, "national_id", "TCKN", ("national_id", "tckn")),
    Kind(2, "iban", "IBAN", ("iban",)),
    Kind(3, "credit_card", "KART", ("credit_card", "card", "kart")),
    Kind(4, "email", "EPOSTA", ("email", "eposta")),
    Kind(5, "phone", "TEL", ("phone", "tel", "telefon")),
    Kind(6, "person_name", "KISI", ("person_name", "person", "kisi", "kişi")),
    Kind(7, "custom_word", "OZEL", ("custom_word", "custom", "ozel", "özel")),
)
PREFIXES = tuple(k.prefix for k in KINDS)
BY_NAME = {k.name: k for k in KINDS}
#: Person names are loose guesses and stay off unless asked for.
DEFAULT_ENABLED = tuple(k.name for k in KINDS if k.name != "person_name")


def kind_from_name(name: str) -> Kind | None:
    """The kind a configuration means by a name; case, blanks around it and - for _ don't matter."""
    wanted = "".join(c.lower() if c.isascii() else c for c in name.strip()).replace("-", "_")
    return next((k for k in KINDS if wanted in k.aliases), None)


def kind_from_prefix(prefix: str) -> Kind | None:
    return next((k for k in KINDS if k.prefix == prefix), None)


def split_placeholder(placeholder: str) -> tuple[Kind, int] | None:
    prefix, mark, index = placeholder.rpartition("_")
    kind = kind_from_prefix(prefix) if mark else None
    return (kind, int(index)) if kind and index.isascii() and index.isdigit() else None


@dataclass(frozen=True)
class Settings:
    """Which kinds run, and words of the user's own."""

    enabled: tuple[str, ...] = DEFAULT_ENABLED
    custom_words: tuple[str, ...] = field(default=())

    def __post_init__(self):
        unknown = set(self.enabled) - set(BY_NAME)
        if unknown:
            raise ValueError(f"unknown kinds: {', '.join(sorted(unknown))}")

    def on(self, name: str) -> bool:
        return name in self.enabled

    @property
    def words(self) -> tuple[str, ...]:
        """The words to look for, longest first, so that a phrase wins over its own beginning."""
        return tuple(sorted((w.strip() for w in self.custom_words if w.strip()), key=len, reverse=True))

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """VEILFRAME_WORDS and VEILFRAME_DETECTORS, comma-separated. A detector list of unknown names alone changes nothing; a valid one replaces the defaults."""
        words = tuple(w.strip() for w in env.get("VEILFRAME_WORDS", "").split(",") if w.strip())
        named = tuple(dict.fromkeys(k.name for k in map(kind_from_name, env.get("VEILFRAME_DETECTORS", "").split(",")) if k))
        return cls(named or DEFAULT_ENABLED, words)
