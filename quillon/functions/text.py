"""Text functions as Spark column expressions, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.constants import STOPWORDS

HEADING = r"(?md)^ {0,3}#{1,6}[ \t]+(.+)$"


def stem(token: Column) -> Column:
    """ies -> y and sses -> ss in words of over 4 letters, else a final s (not ss, us, is) of over 3; the first that fits."""
    size = F.length(token)
    ends = lambda *tails: F.substring(token, -2, 2).isin(*tails)
    return (
        F.when((size > 4) & token.endswith("ies"), F.concat(token.substr(F.lit(1), size - 3), F.lit("y")))
        .when((size > 4) & token.endswith("sses"), token.substr(F.lit(1), size - 2))
        .when((size > 3) & token.endswith("s") & ~ends("ss", "us", "is"), token.substr(F.lit(1), size - 1))
        .otherwise(token)
    )


def runs(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    """Stemmed tokens in order; stopwords go before stemming."""
    found = runs(text)
    return F.transform(found if keep_stopwords else F.filter(found, lambda w: ~w.isin(*STOPWORDS)), stem)


def query_tokens(query: Column) -> Column:
    """Tokens of a query; of a query of stopwords only, those."""
    plain = tokens(query)
    return F.when(F.size(plain) > 0, plain).otherwise(tokens(query, True))


def headings(text: Column) -> Column:
    """Texts of the lines that look like ATX headings, in fences too."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HEADING), 1)


def truncate(text: Column, limit: int) -> Column:
    """The text, or as many of its words as fit in limit characters, without a loose end, and '...'."""
    head = F.left(text, F.lit(limit))
    words = F.rtrim(F.regexp_replace(head, r"(?s) [^ ]*\z", ""), F.lit(" ,;:."))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(words == "", head).otherwise(words), F.lit("...")))


def plain_snippet(text: Column, terms: list[str], limit: int) -> Column:
    """A window of markup-free text (single spaces) around the earliest term, or its beginning."""
    places = [F.when(F.contains(F.lower(text), F.lit(t)), F.locate(t, F.lower(text)) - 1) for t in terms]
    at = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(-1))
    lead = at - limit // 3
    back = F.length(F.regexp_extract(F.left(text, lead), r"(?s)\A(.* )", 1))
    start = F.when(back > 0, back).otherwise(lead)
    window = text.substr(start + 1, F.lit(limit))
    tail = F.when(F.length(text) > start + limit, F.concat(F.regexp_replace(window, r"(?s) [^ ]*\z", ""), F.lit("..."))).otherwise(window)
    return F.when(at <= limit // 3, truncate(text, limit)).otherwise(F.concat(F.lit("..."), tail))


def strip_closed_comments(text: Column) -> Column:
    """Comments that close go; one that does not stays as text."""
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


# --- the same in DuckDB SQL ---

SQL_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def sql_stem(x: str) -> str:
    return (
        f"CASE WHEN length({x}) > 4 AND {x} LIKE '%ies' THEN left({x}, length({x}) - 3) || 'y' WHEN length({x}) > 4 AND {x} LIKE '%sses' THEN left({x}, length({x}) - 2) "
        f"WHEN length({x}) > 3 AND {x} LIKE '%s' AND right({x}, 2) NOT IN ('ss', 'us', 'is') THEN left({x}, length({x}) - 1) ELSE {x} END"
    )


def sql_tokens(text: str, keep_stopwords: bool = False) -> str:
    found = f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    kept = found if keep_stopwords else f"list_filter({found}, lambda w: NOT list_contains({SQL_STOP}, w))"
    return f"list_transform({kept}, lambda w: {sql_stem('w')})"


def sql_query_tokens(text: str) -> str:
    return f"CASE WHEN len({sql_tokens(text)}) > 0 THEN {sql_tokens(text)} ELSE {sql_tokens(text, True)} END"


def sql_headings(text: str) -> str:
    return rf"array_to_string(regexp_extract_all({text}, '(?m)^ {{0,3}}#{{1,6}}[ \t]+(.+)$', 1), chr(10))"


def sql_truncate(text: str, limit: int) -> str:
    words = f"rtrim(regexp_replace(left({text}, {limit}), '(?s) [^ ]*$', ''), ' ,;:.')"
    return f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE (CASE WHEN {words} = '' THEN left({text}, {limit}) ELSE {words} END) || '...' END"
