"""Scalar text functions: hashes, ids, lines, keywords, names, estimates. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the two keyword extractors.
HISTORY_STOP_WORDS = "add remove fix update create delete implement build make the a an to for in on with from and or".split()
PATTERN_STOP_WORDS = "add create implement build make the a an".split()

#: File suffix -> language.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "md": "markdown", "sh": "shell", "bash": "shell", "sql": "sql",
    "proto": "protobuf", "tf": "terraform", "hcl": "hcl", "dockerfile": "dockerfile",
}
#: Lower-cased names without suffix -> language.
NAMED = {"dockerfile": "dockerfile", "containerfile": "dockerfile", "justfile": "makefile", "makefile": "makefile"}


def content_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256 over UTF-8."""
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_id(path: Column, line_start: Column, symbol: Column) -> Column:
    """First 20 hex digits of SHA-256 over path:line:symbol."""
    return F.substring(F.sha2(F.concat_ws(":", path, line_start.cast("string"), symbol), 256), 1, 20)


def span_chunk_id(path: Column, start: Column, end: Column) -> Column:
    """Variant over path:start:end with zero-based lines, 16 hex digits."""
    return F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string")), 256), 1, 16)


def lines(text: Column) -> Column:
    """Lines between newlines; one empty line at the end does not count."""
    parts = F.split(text, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    """How many lines() there are, without splitting the text."""
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return newlines + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def keywords(text: Column, stop_words: list[str], most: int) -> Column:
    """The first words longer than three characters that are no stop words, lower-cased; punctuation and repeats stay."""
    stop = F.array(*(F.lit(w) for w in stop_words))
    return F.slice(F.filter(words(F.lower(text)), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w)), 1, most)


def history_keywords(text: Column) -> Column:
    return keywords(text, HISTORY_STOP_WORDS, 4)


def pattern_keywords(text: Column) -> Column:
    return keywords(text, PATTERN_STOP_WORDS, 3)


def search_keywords(description: str) -> list[str]:
    """history_keywords() of a description at hand."""
    return [w for w in description.lower().split() if len(w) > 3 and w not in HISTORY_STOP_WORDS][:4]


def contains_any(text: Column, needles: Column) -> Column:
    """Whether one of an array's strings stands in the lower-cased text; false for an empty array."""
    return F.exists(needles, lambda k: F.contains(F.lower(text), k))


def contains_all_words(text: Column, query: str) -> Column:
    """The first word as written, every other word in any case; a blank query matches nothing."""
    parts = query.split()
    if not parts:
        return F.lit(False)
    found = F.contains(text, F.lit(parts[0]))
    for w in parts[1:]:
        found &= F.contains(F.lower(text), F.lit(w.lower()))
    return found


def language(path: Column) -> Column:
    """Language of a path by suffix, else by name, else unknown."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)
    by_suffix = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    by_name = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))
    return F.coalesce(F.try_element_at(by_suffix, suffix), F.try_element_at(by_name, name), F.lit("unknown"))


def requirement_name(requirement: Column) -> Column:
    """Package name of a requirement: cut at >=, <=, ==, ~=, [ and @ (not at >, <, != or ;)."""
    return F.trim(F.regexp_replace(requirement, r"(>=|<=|==|~=|\[|@).*$", ""))


def slug(name: Column) -> Column:
    """Slashes, backslashes and spaces become dashes; empty becomes unnamed."""
    return F.coalesce(F.nullif(F.translate(name, "/\\ ", "---"), F.lit("")), F.lit("unnamed"))


def token_estimate(chars: Column) -> Column:
    """Four characters a token."""
    return chars / 4


def truncate(text: Column, most: int, suffix: str = "") -> Column:
    """The first `most` characters, with the suffix only if something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)


def document_text(path: Column, content: Column, language_: Column, service: Column, symbol: Column, symbol_type: Column, parent: Column, definitions: bool = False) -> Column:
    """The text of a chunk as it is embedded: header lines, a blank line, the content.

    definitions=True is the variant of definition chunks: the label has a capital and there is no language line.
    """
    label = F.coalesce(F.nullif(symbol_type, F.lit("")), F.lit("symbol"))
    label = F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 1000))) if definitions else label
    full = F.when(F.coalesce(parent, F.lit("")) != "", F.concat(parent, F.lit("."), symbol)).otherwise(symbol)
    return F.concat_ws(
        "\n",
        F.when(F.coalesce(service, F.lit("")) != "", F.concat(F.lit("Service: "), service)),
        F.concat(F.lit("File: "), path),
        F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(label, F.lit(": "), full)),
        *([] if definitions else [F.concat(F.lit("Language: "), language_)]),
        F.lit(""),
        content,
    )


def snippet(document: Column, most: int = 5) -> Column:
    """The first lines after the first blank line that is not the first line, with a marker if lines were cut."""
    parts = F.split(document, "\n")
    blank = F.array_position(F.slice(parts, 2, F.size(parts)), "")
    body = F.when(blank > 0, F.slice(parts, (blank + 2).cast("int"), F.size(parts))).otherwise(parts)
    return F.concat(F.array_join(F.slice(body, 1, most), "\n"), F.when(F.size(body) > most, F.lit("\n... (truncated)")).otherwise(F.lit("")))
