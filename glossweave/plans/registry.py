"""Named extension points: what users plug in by name."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("reader", "tokenizer", "tagger", "parser", "disambiguator", "similarity", "sink")
_found: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, what: Callable | None = None):
    """Register ``what`` under a kind and a name; without ``what``, a decorator."""
    if kind not in KINDS:
        raise KeyError(f"{kind} is none of {', '.join(KINDS)}")
    if what is None:
        return lambda f: register(kind, name, f)
    _found[kind, name] = what
    return what


def get(kind: str, name: str) -> Callable:
    try:
        return _found[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} named {name}; there are {', '.join(names(kind)) or 'none'}") from None


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _found if k == kind)


def _defaults() -> None:
    from glossweave.functions import text
    from glossweave.operators import annotate, similarity, wsd
    from glossweave.sources import readers

    for name in ("ukwac", "wackypedia", "pubmed", "semeval2010", "senseeval2007", "news"):
        register("reader", name, getattr(readers, name))
    register("tokenizer", "words", text.words)
    register("tokenizer", "space", text.space_tokens)
    register("tokenizer", "stem", annotate.stem_tokens)
    register("tagger", "rule", text.rule_pos)
    register("parser", "chain", annotate.chain_heads)
    register("disambiguator", "fsd", wsd.most_frequent)
    register("disambiguator", "ld", wsd.window_lesk)
    for name in ("path", "leacock_chodorow", "leacock_chodorow_scaled", "wu_palmer", "jiang_conrath", "lin"):
        register("similarity", name, getattr(similarity, name))


_defaults()
