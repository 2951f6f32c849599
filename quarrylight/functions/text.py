"""Expressions over query texts: terms, weights, identifier aliases, counts and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ascii_lower, lower_sql

# Terms without weight, and terms that name a language or a node.
STOP_WORDS = ["a", "an", "and", "are", "as", "be", "by", "change", "changed", "changes", "default", "fix", "fixed", "fixes", "for", "from", "handle", "improve", "improved", "improvement", "improvements", "in", "is", "of", "on", "or", "support", "supports", "the", "to", "with"]
LANGUAGE_WORDS = ["csharp", "go", "java", "javascript", "js", "kotlin", "python", "rust", "scala", "typescript", "ts"]
NODE_WORDS = ["node", "nodes"]


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, repeated ones kept."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+"), lambda x: x != "")


def aliases(text: Column) -> Column:
    """``a_b`` for every hyphenated run of 2 to 5 parts of two or more characters that carry weight."""
    runs = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9_]+(?:-[a-z0-9_]+)+)"), 1)
    fit = F.filter(F.transform(runs, lambda r: F.split(r, "-")), lambda p: (F.size(p) <= 5) & F.forall(p, lambda x: (F.length(x) >= 2) & (weight(x) > 0)))
    return F.transform(fit, lambda p: F.array_join(p, "_"))


def weight(term: Column) -> Column:
    return F.when(term.isin(*STOP_WORDS), 0.0).when(term.isin(*LANGUAGE_WORDS), 0.25).when(term.isin(*NODE_WORDS), 0.1).otherwise(1.0)


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")).otherwise(0)


def parts(term: Column) -> Column:
    """The pieces of an identifier at case, digit and underscore boundaries, lower-case."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(term, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([A-Za-z])([0-9])", "$1 $2"), r"([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(ascii_lower(cut), "[^a-z0-9]+"), lambda x: x != "")


def token_estimate(text: Column) -> Column:
    """ceil(words * 4 / 3)."""
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))
    return F.ceil(n * 4 / 3)


def escaped(text: Column) -> Column:
    """Text for HTML."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def percent_encoded(text: Column) -> Column:
    """RFC 3986 encoding: what form encoding writes otherwise is put right."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def percent_decoded(text: Column) -> Column:
    """What ``percent_encoded`` was made from: a plus sign is itself."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def shell_quoted(text: Column) -> Column:
    """A word of a shell: as it is if it has safe characters only, else in single quotes."""
    return F.when(text.rlike("^[A-Za-z0-9_./@%+=:,-]+$"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def name_uuid(name: Column) -> Column:
    """The version 5 UUID of a name in the URL name space, from the built-in SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    high = F.substring(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)), -1, 1)
    return F.lower(F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), high, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)))


def line_range(uri: Column) -> Column:
    """first and last of a ``#Lfirst-Llast`` or ``#Lfirst`` mark, null without one or if it is none."""
    first, last = F.regexp_extract(uri, r"#L(\d+)(?:-L?\d+)?$", 1), F.regexp_extract(uri, r"#L\d+-L?(\d+)$", 1)
    a = F.when(first != "", first.cast("int"))
    b = F.when(last != "", last.cast("int")).otherwise(a)
    return F.when((a >= 1) & (b >= a), F.struct(a.alias("first"), b.alias("last")))


def lines_between(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` of a text, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def information(text: Column) -> Column:
    """1 for each word with weight, 2 if it looks like an identifier; a task below 2 says too little."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_]+"), lambda x: (F.length(x) >= 2) & ~x.rlike("^[0-9]+$") & (weight(ascii_lower(x)) > 0))
    return F.aggregate(F.transform(tokens, lambda x: F.when(x.rlike("[a-z][A-Z]|_|[A-Za-z][0-9]"), 2).otherwise(1)), F.lit(0), lambda a, b: a + b)


# -- the same as SQL text


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({lower_sql(f'coalesce({text}, {chr(39)}{chr(39)})')}, '[^a-z0-9_]+'), lambda x: x <> '')"


def _in(term: str, values: list[str]) -> str:
    return f"{term} IN ({', '.join(repr(v) for v in values)})"


def weight_sql(term: str) -> str:
    return f"CASE WHEN {_in(term, STOP_WORDS)} THEN 0.0::DOUBLE WHEN {_in(term, LANGUAGE_WORDS)} THEN 0.25::DOUBLE WHEN {_in(term, NODE_WORDS)} THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END"


def occurrences_sql(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, {term}, ''))) // length({term}))"
