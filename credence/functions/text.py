"""Small keyword tests in text; `automaton` searches for large dictionaries.  Matching is by
substring unless `whole_words` is asked for.

Functions over whole dictionaries take the text as a SQL expression, usually a column name, and
hand Spark one SQL string: a dictionary makes hundreds of small expressions, and building them
one call at a time would take the driver longer than planning the query.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from credence.functions.coerce import strip


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _whole_word(keyword: str) -> str:
    # Java pattern syntax: \\Q..\\E keeps the keyword literal.
    return sql_text(rf"(?<!\w)\Q{keyword}\E(?!\w)")


def _occurs(text: str, keyword: str, whole_words: bool) -> str:
    if whole_words:
        return f"rlike({text}, {_whole_word(keyword)})"
    return f"contains({text}, {sql_text(keyword)})"


def nested_keywords(keywords: Iterable[str]) -> dict[str, list[str]]:
    """Keywords by the shortest listed keyword they contain, which stands for them in a test."""
    groups: dict[str, list[str]] = {}
    for word in sorted(set(keywords), key=lambda k: (len(k), k)):
        root = next((r for r in groups if r in word), None)
        if root is None:
            groups[word] = []
        else:
            groups[root].append(word)
    return groups


def any_of(text: str, keywords: Iterable[str], whole_words: bool = False) -> str:
    """SQL condition: any of the keywords occurs.

    A keyword that contains another listed keyword needs no test of its own.
    """
    tested = sorted(set(keywords)) if whole_words else nested_keywords(keywords)
    return f"coalesce({' OR '.join(_occurs(text, k, whole_words) for k in tested)}, false)"


def contains_any(text: str, keywords: Iterable[str], whole_words: bool = False) -> Column:
    return F.expr(any_of(text, keywords, whole_words))


def matched_share(conditions: Iterable[str]) -> Column:
    """Share of the given SQL conditions that hold."""
    conditions = list(conditions)
    if not conditions:
        return F.lit(0.0)
    held = " + ".join(f"int({c})" for c in conditions)
    return F.expr(f"({held}) / double({len(conditions)})")


def sql_array(values: Iterable[str]) -> str:
    return f"array({', '.join(sql_text(v) for v in values)})"


def literal_list(values: Iterable[str]) -> Column:
    return F.expr(sql_array(values))


def keyword_table(groups: Mapping[str, Iterable[str]]) -> Column:
    """A keyword dictionary as an array<struct<domain, keyword>> literal."""
    return F.expr("array(" + ", ".join(
        f"named_struct('domain', {sql_text(g)}, 'keyword', {sql_text(k)})"
        for g, keywords in groups.items() for k in keywords) + ")")


def snippet(text: Column, keyword: Column, window: int = 40) -> Column:
    """The keyword's first occurrence (any case) with `window` characters on both sides."""
    at = F.position(F.lower(keyword), F.lower(text))
    first = F.greatest(F.lit(1), at - F.lit(window))
    last = F.least(F.length(text), at + F.length(keyword) - 1 + F.lit(window))
    middle = strip(F.replace(F.substring(text, first, last - first + 1), F.lit("\n"), F.lit(" ")))
    return (F.when(at == 0, F.lit(""))
            .otherwise(F.concat(F.when(first > 1, F.lit("...")).otherwise(F.lit("")), middle,
                                F.when(last < F.length(text), F.lit("...")).otherwise(F.lit("")))))


def truncated(text: Column, limit: int, keep: int | None = None) -> Column:
    """At most `limit` characters: longer text keeps `keep` (default `limit`) and gets dots."""
    keep = limit if keep is None else keep
    return F.when(F.length(text) > limit,
                  F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def title_case(name: str) -> str:
    return name.replace("_", " ").title()

