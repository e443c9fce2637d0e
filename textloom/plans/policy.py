"""Text policies: a frozen record of switches, read from an INI file or taken from the built-in six."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, field, replace

from ..functions import vocabulary as v

APOSTROPHES = ("split", "possessive")
REDUCTIONS = ("none", "lemma", "stem")
NAMES = ("none", "entity")
DATE_FORMATS = ("YYYY-MM-DD", "YYYYMMDD")
TRUE, FALSE = ("1", "yes", "true", "on"), ("0", "no", "false", "off")


def read_lines(text: str) -> list[str]:
    """Lines of a list file, trimmed, without blank ones and comments."""
    return [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]


def synonym_map(lines: list[str]) -> dict[str, str]:
    out = {}
    for line in lines:
        head, *others = (w.strip() for w in line.split(","))
        out.update({w: head for w in others if w})
    return out


def entity_map(lines: list[str]) -> dict[str, str]:
    """phrase (lower case, single blanks) → canonical term."""
    out = {}
    for line in lines:
        head, *phrases = (w.strip() for w in line.split("|"))
        out.update({" ".join(p.lower().split()): head for p in phrases if p})
    return out


def lemma_map(lines: list[str]) -> dict[str, str]:
    return dict(line.split("\t", 1) for line in lines if "\t" in line)


@dataclass(frozen=True)
class Policy:
    name: str = "A"
    lowercase: bool = True
    apostrophes: str = "split"
    accents: bool = False
    dates: bool = False
    date_format: str = "YYYY-MM-DD"
    numbers: bool = False
    names: str = "none"
    reduction: str = "none"
    stopwords: tuple[str, ...] = ()
    synonyms: dict[str, str] = field(default_factory=dict)
    entities: dict[str, str] = field(default_factory=dict)
    lemmas: dict[str, str] = field(default_factory=dict)
    min_topic_hits: int = 0
    cleaning: bool = True

    def __post_init__(self):
        for value, allowed in ((self.apostrophes, APOSTROPHES), (self.reduction, REDUCTIONS), (self.names, NAMES), (self.date_format, DATE_FORMATS)):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")


_A = Policy()
_B = replace(_A, name="B", apostrophes="possessive", accents=True, dates=True, numbers=True, stopwords=tuple(v.STOPWORDS))
_F = replace(_B, name="F", synonyms=synonym_map(v.SYNONYM_LINES))
_E = replace(_F, name="E", entities=entity_map(v.ENTITY_LINES), reduction="stem")
POLICIES = {
    "A": _A,
    "B": _B,
    "C": replace(_E, name="C", reduction="lemma", lemmas=v.LEMMAS),
    "D": replace(_A, name="D", stopwords=tuple(v.STOPWORDS)),
    "E": _E,
    "F": _F,
    "topic": replace(_B, name="topic", min_topic_hits=8, cleaning=False),
    "uncleaned": replace(_A, name="uncleaned", cleaning=False),
}


def load(path: str) -> Policy:
    """A policy from an INI file (any section). List keys name files beside it; inline comments start with #."""
    parser = configparser.ConfigParser(inline_comment_prefixes=("#",))
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    keys = {k: value for section in parser.sections() for k, value in parser.items(section)}

    def flag(k: str, default: bool) -> bool:
        value = keys.get(k, str(default)).lower()
        if value not in TRUE + FALSE:
            raise ValueError(f"{k}: {value!r} is no yes or no")
        return value in TRUE

    def lines(k: str) -> list[str]:
        if not keys.get(k):
            return []
        with open(os.path.join(os.path.dirname(path), keys[k]), encoding="utf-8") as f:
            return read_lines(f.read())

    return Policy(
        keys.get("name", os.path.splitext(os.path.basename(path))[0]), flag("lowercase", True), keys.get("apostrophes", "split"), flag("accents", False), flag("dates", False),
        keys.get("date_format", "YYYY-MM-DD"), flag("numbers", False), keys.get("names", "none"), keys.get("reduction", "none"), tuple(lines("stopwords")),
        synonym_map(lines("synonyms")), entity_map(lines("entities")), lemma_map(lines("lemmas")), int(keys.get("min_topic_hits", 0)), flag("cleaning", True),
    )
