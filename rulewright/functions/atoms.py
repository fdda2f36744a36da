"""Atoms, rules and names as string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are neither a predicate nor a constant of a problem.
RESERVED = ("not", "dom")

# What an answer text is cleaned of, in this order: code fences with their language, back-ticks, back-slashes at
# the end of a line, typographic dashes, quotes and spaces, all other non-ASCII characters, and more than one blank line.
CLEANING = (
    (r"```[a-zA-Z]*\s*\n?", ""),
    (r"`", ""),
    (r"\\\s*\n", "\n"),
    (r"(?m)\\$", ""),
    ("[\u2014\u2013]", "-"),
    ("[\u2018\u2019]", "'"),
    ("[\u201c\u201d]", '"'),
    ("\u00a0", " "),
    (r"[^\x00-\x7F]", ""),
    (r"\n{3,}", "\n\n"),
)


def predicate(atom: Column) -> Column:
    """Predicate symbol of an atom without a leading `not`; null for an equality or a reserved word."""
    name = F.regexp_extract(F.regexp_replace(atom, r"^\s*not\s+", ""), r"^\s*([a-z]\w*)", 1)
    return F.when(atom.contains("=") | name.isin("", *RESERVED), F.lit(None)).otherwise(name)


def arguments(atom: Column) -> Column:
    """Argument texts of an atom."""
    inside = F.regexp_extract(atom, r"\(([^()]*)\)", 1)
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inside, ","), lambda x: F.trim(x)))


def constants(rule: Column) -> Column:
    """Sorted distinct constants of a rule text: lower-case or numeric arguments, and either side of an equality."""
    args = F.flatten(F.transform(F.regexp_extract_all(rule, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.split(x, r"\s*,\s*")))
    sides = F.concat(F.regexp_extract_all(rule, F.lit(r"(\w+)\s*="), F.lit(1)), F.regexp_extract_all(rule, F.lit(r"=\s*(\w+)"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(args, sides), lambda x: F.trim(x)), lambda x: x.rlike("^[a-z0-9]") & ~x.isin(*RESERVED))))


def is_intensional(rule: Column) -> Column:
    """No constant anywhere in the rule."""
    return F.size(constants(rule)) == 0


def is_ground(rule: Column) -> Column:
    """No variable (upper-case argument or equality side) in the rule."""
    return ~rule.rlike(r"[(,=]\s*[A-Z]\w*|[A-Z]\w*\s*=")


def clause(head: Column, body: Column) -> Column:
    """head :- body. as text; a fact has no body."""
    return F.when(F.size(body) > 0, F.concat(head, F.lit(" :- "), F.array_join(body, ", "), F.lit("."))).otherwise(F.concat(head, F.lit(".")))


def split_top_level(body: Column) -> Column:
    """Parts between commas outside parentheses."""
    return F.filter(F.transform(F.split(body, r",(?![^()]*\))"), lambda x: F.trim(x)), lambda x: x != "")


def squeeze(atom: Column) -> Column:
    """Spelling key of an atom: no white space."""
    return F.regexp_replace(atom, r"\s+", "")


def generated_name(i: Column, letters: str) -> Column:
    """i-th generated name: one of the letters, then with a numeric suffix."""
    k = len(letters)
    letter = F.substring(F.lit(letters), (i % k + 1).cast("int"), F.lit(1))
    return F.when(i < k, letter).otherwise(F.concat(letter, (i / k).cast("long").cast("string")))


def derived_seed(text: Column) -> Column:
    """A 31-bit seed from the SHA-256 of a text."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), F.lit(2147483648))


def canonical_body(body: Column) -> Column:
    """Body order and spelling removed."""
    return F.array_sort(F.transform(body, squeeze))


def clean_answer(text: Column) -> Column:
    """Answer text after every replacement of CLEANING."""
    for pattern, new in CLEANING:
        text = F.regexp_replace(text, pattern, new)
    return text
