"""Index and query options, with their textual form."""

from __future__ import annotations

from dataclasses import dataclass, fields


class OptionError(ValueError):
    """The text is too short to be an option string."""


def _names_inside(kind: str, text: str) -> list[str]:
    """The names between `Kind(` and the last character, cut at commas; blanks count."""
    head = len(kind) + 1
    if len(text) < head + 1:
        raise OptionError(f"{text!r} is no {kind}(...)")
    return text[head:-1].split(",")


@dataclass(frozen=True)
class IndexOptions:
    """What happens to words before they are indexed (and to query words of that index)."""

    case_folding: bool = False
    remove_stop_words: bool = False
    do_stemming: bool = False

    NAMES = {"CaseFolding": "case_folding", "RemoveStopWords": "remove_stop_words", "DoStemming": "do_stemming"}

    @classmethod
    def parse(cls, text: str) -> IndexOptions:
        """`IndexOptions(CaseFolding,DoStemming)`: unknown names, also names with blanks around them, are ignored."""
        return cls(**{cls.NAMES[n]: True for n in _names_inside("IndexOptions", text) if n in cls.NAMES})

    def __str__(self) -> str:
        return "Index options:\n" + "".join(f"\t{f.name}: {getattr(self, f.name)}\n" for f in fields(self))


@dataclass(frozen=True)
class QueryOptions:
    """Which sections of a topic give query words."""

    use_headline: bool = False
    use_description: bool = False
    use_narrative: bool = False

    NAMES = {"UseHeadline": "use_headline", "UseDescription": "use_description", "UseNarrative": "use_narrative"}

    @classmethod
    def parse(cls, text: str) -> QueryOptions:
        return cls(**{cls.NAMES[n]: True for n in _names_inside("QueryOptions", text) if n in cls.NAMES})

    def __str__(self) -> str:
        return "Query options:\n" + "".join(f"\t{f.name}: {getattr(self, f.name)}\n" for f in fields(self))
