"""Case variants of query terms: for one query on the driver, and as an expression over a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _camel(text: str) -> str:
    """Underscores go, and the ASCII letter after each is raised."""
    head, *rest = text.split("_")
    return head + "".join(p[:1].upper() + p[1:] if p[:1].isascii() else p for p in rest)


def _snake(text: str) -> str:
    return "".join(("_" if i else "") + (c.lower() if c.isascii() else c) if c.isupper() else c for i, c in enumerate(text))


def is_camel(text: str) -> bool:
    return text[:1].islower() and any(map(str.isupper, text[1:]))


def is_pascal(text: str) -> bool:
    """A first capital, and later a capital somewhere after a small letter."""
    small = next((i for i, c in enumerate(text[1:]) if c.islower()), None)
    return text[:1].isupper() and small is not None and any(map(str.isupper, text[small + 2 :]))


def variants(term: str) -> list[str]:
    """All rules that apply, in their order; repeats are left in."""
    out = []
    if "_" in term:
        camel = _camel(term)
        out += [camel, camel[:1].upper() + camel[1:]]
    if is_camel(term):
        out.append(_snake(term))
    if is_pascal(term):
        out += [_snake(term), term[:1].lower() + term[1:]]
    if "-" in term:
        flat = term.replace("-", "_")
        out += [flat, _camel(flat)]
    return out


def expand(query: str) -> list[str]:
    """Variants of the first tokens, without what only repeats in another case."""
    seen, out = {query.lower()}, []
    for token in query.split()[: C.MAX_EXPANDED_TOKENS]:
        for v in variants(token):
            if v.lower() not in seen:
                seen.add(v.lower())
                out.append(v)
    return out


def all_terms(query: str) -> list[str]:
    return [query, *expand(query)]


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _camel_col(text: Column) -> Column:
    parts = F.split(text, "_", -1)
    raised = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.translate(F.substring(p, 1, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(p, 2, 1 << 20)))
    return F.concat(parts[0], F.array_join(raised, ""))


def _snake_col(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "(?<!^)([A-Z])", "_$1"))


def variants_col(term: Column) -> Column:
    """``variants`` over a column; terms are taken to be ASCII where letters change case."""
    none = F.array().cast("array<string>")
    rest = lambda x: F.substring(x, 2, 1 << 20)
    snake = _let(_camel_col(term), lambda c: F.array(c, F.concat(F.upper(F.substring(c, 1, 1)), rest(c))))
    flat = F.replace(term, F.lit("-"), F.lit("_"))
    return F.concat(
        F.when(term.contains("_"), snake).otherwise(none),
        F.when(term.rlike(r"^\p{Ll}.*\p{Lu}"), F.array(_snake_col(term))).otherwise(none),
        F.when(term.rlike(r"^\p{Lu}.*\p{Ll}.*\p{Lu}"), F.array(_snake_col(term), F.concat(F.lower(F.substring(term, 1, 1)), rest(term)))).otherwise(none),
        F.when(term.contains("-"), F.array(flat, _camel_col(flat))).otherwise(none),
    )


def expand_col(query: Column) -> Column:
    tokens = F.slice(F.filter(F.split(query, r"\s+"), lambda t: t != ""), 1, C.MAX_EXPANDED_TOKENS)
    found = F.flatten(F.transform(tokens, variants_col))
    fresh = F.filter(found, lambda v: F.lower(v) != F.lower(query))
    return F.aggregate(fresh, F.array().cast("array<string>"), lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.array_append(acc, v)))
