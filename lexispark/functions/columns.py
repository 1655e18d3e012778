"""Predicates and small expressions on columns; all run inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that mark a token as a pattern; media suffixes by format (first that fits counts).
PATTERN_CHARACTERS = r"[$*^.\[|]"
FORMATS = {
    "ARCHIVE": ["zip", "tar", "gz", "tgz", "bz2", "7z", "rar", "xz"],
    "RDF": ["rdf", "ttl", "nt", "nq", "owl", "n3", "trig", "trix", "jsonld"],
    "CONLL": ["conll", "conllu", "conllx", "tsv"],
    "XML": ["xml", "tei", "tmx"],
    "HTML": ["html", "htm", "xhtml"],
    "JSON": ["json"],
    "TEXT": ["txt", "csv"],
    "PDF": ["pdf"],
}


def full_match(value: Column, pattern: Column | str) -> Column:
    """True if all of value matches (rlike alone finds the pattern anywhere)."""
    body = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp(value, F.concat(F.lit("^(?:"), body, F.lit(r")\z")))


def has_quotes(value: Column) -> Column:
    return value.contains("'") | value.contains(",") | value.contains(";")


def without_quotes(value: Column) -> Column:
    """Tokens as they are matched: apostrophes, commas and semicolons taken out."""
    return F.when(has_quotes(value), F.translate(value, "',;", "")).otherwise(value)


def is_pattern(token: Column) -> Column:
    return token.rlike(PATTERN_CHARACTERS)


def last_segment(uri: Column) -> Column:
    """What follows the last / or #."""
    return F.regexp_extract(uri, r"([^/#]*)$", 1)


def path_of(url: Column) -> Column:
    """A URL's path, without query and fragment; null if it is no URL."""
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def extension_of(url: Column) -> Column:
    """The path's last suffix in small letters, empty if there is none."""
    return F.lower(F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)$", 1))


def format_of(url: Column) -> Column:
    """The format by suffix: the first list that has it; NOEXT without suffix, UNKNOWN for others."""
    ext = extension_of(url)
    out = F.when(ext == "", F.lit("NOEXT"))
    for name, suffixes in FORMATS.items():
        out = out.when(ext.isin(suffixes), F.lit(name))
    return out.otherwise(F.lit("UNKNOWN"))


def first_lines(text: Column, n: int, most_chars: int = 3000) -> Column:
    """The first n lines, cut to so many characters: a display sample."""
    return F.substring(F.array_join(F.slice(F.split(text, "\n", -1), 1, n), "\n"), 1, most_chars)


def iso_language(code: Column) -> Column:
    """Two-letter codes of the tables' languages as ISO 639-3; three-letter codes stay, others are empty."""
    return F.when(code == "en", "eng").when(code == "de", "deu").when(code == "fr", "fra").when(code == "es", "spa").when(F.length(code) == 3, code).otherwise("")


def valid_url(url: Column) -> Column:
    return url.rlike(r"^(https?|ftp|file)://[^\s/?#]+")


def normalised_url(url: Column) -> Column:
    """Scheme and host in small letters, / for an empty path, no fragment."""
    origin = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = path_of(url)
    return F.concat(origin, F.when(path == "", "/").otherwise(path), F.regexp_extract(url, r"(\?[^#]*)", 1))


#: Media types by format.
MEDIA_TYPES = {
    "RDF": ["application/rdf+xml", "text/turtle", "application/n-triples", "application/n-quads", "application/trig", "application/trix", "application/ld+json", "text/n3"],
    "XML": ["application/xml", "text/xml", "application/tei+xml"],
    "HTML": ["text/html", "application/xhtml+xml"],
    "JSON": ["application/json"],
    "ARCHIVE": ["application/zip", "application/gzip", "application/x-tar", "application/x-bzip2", "application/x-7z-compressed", "application/x-rar-compressed", "application/x-xz"],
    "PDF": ["application/pdf"],
}


def format_by_media_type(media_type: Column, url: Column) -> Column:
    """The format that the media type says; where it says nothing, that of the URL's suffix."""
    plain = F.lower(F.trim(F.regexp_extract(media_type, "^[^;]*", 0)))
    out = F.when(plain.isin(MEDIA_TYPES["RDF"]), "RDF")
    for name, types in list(MEDIA_TYPES.items())[1:]:
        out = out.when(plain.isin(types), name)
    return out.otherwise(format_of(url))


#: The bytes that packed files and PDF begin with.
SIGNATURES = {"ARCHIVE": ["504B0304", "504B0506", "1F8B", "425A68", "377ABCAF271C", "526172211A07", "FD377A585A00"], "PDF": ["255044462D"]}
#: Bytes and lines of a file's head that decide on its format.
HEAD, HEAD_LINES = 1 << 16, 200


def format_by_content(content: Column) -> Column:
    """The format that the head of a file (binary) shows: signatures; then markup by its root element, statements, JSON, and lines with
    equally many tabs (three at least); else TEXT. UNKNOWN for empty files and other binary ones; null for null."""
    raw = F.substring(content, 1, HEAD)
    code = F.hex(F.substring(raw, 1, 8))
    out = F.when(F.length(raw) == 0, "UNKNOWN")
    for name, marks in SIGNATURES.items():
        for mark in marks:
            out = out.when(code.startswith(mark), name)
    out = out.when(F.hex(F.substring(raw, 258, 5)) == "7573746172", "ARCHIVE")  # ustar
    text = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"^﻿?\s*+", "")
    binary = text.rlike(r"[\x00-\x08\x0E-\x1A]")
    root = F.regexp_extract(text, r"^(?:<\?[^>]*+>\s*+|<!--(?s:.*?)-->\s*+|<!DOCTYPE[^>\[]*+(?:\[[^\]]*+\])?+\s*+>\s*+){0,50}<([A-Za-z_][\w.-]*+(?::[A-Za-z_][\w.-]*+)?+(?=[\s/>])[^>]*+)", 1)
    name = F.lower(F.regexp_extract(root, r"^[^\s/>]*+", 0))
    html = F.lower(F.substring(text, 1, 200)).rlike(r"^<!doctype\s++html\b") | name.isin("html", "head", "body")
    rdf_root = name.rlike("^(?:[^:]*+:)?rdf$") | (name == "trix")
    bare = F.regexp_replace(text, r"^(?:#[^\n]*+\n\s*+)*+", "")
    statements = bare.rlike(r"(?i)^(?:@prefix|@base|prefix|base)\s") | bare.rlike(r"^(?:<[^<>\s]*+>|_:\S++)\s++<[^<>\s]*+>\s++[^\n]*+(?<=[.\r])(?:\n|$)")
    linked = text.rlike(r'"@(?:context|id|graph|type)"\s*+:')
    lines = F.slice(F.split(text, r"\r?\n", HEAD_LINES + 2), 1, HEAD_LINES)
    # the last line of a cut head may be a part of one
    lines = F.when(F.length(raw) == HEAD, F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(lines)
    filled = F.filter(lines, lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    tabs = F.transform(filled, lambda x: F.length(x) - F.length(F.translate(x, "\t", "")))
    regular = (F.size(filled) >= 3) & (F.array_min(tabs) >= 1) & (F.size(F.array_distinct(tabs)) == 1)
    out = out.when(binary, "UNKNOWN").when(text == "", "UNKNOWN").when(html, "HTML").when(rdf_root, "RDF").when(statements, "RDF").when(root != "", "XML")
    return F.when(content.isNotNull(), out.when(text.rlike(r"^[\[{]"), F.when(linked, "RDF").otherwise("JSON")).when(regular, "CONLL").otherwise("TEXT"))


def format_of_file(content: Column, media_type: Column, url: Column) -> Column:
    """The format by media type, else by name, else by content."""
    known = format_by_media_type(F.coalesce(media_type, F.lit("")), url)
    return F.when(known.isin("UNKNOWN", "NOEXT") | known.isNull(), F.coalesce(format_by_content(content), known)).otherwise(known)
