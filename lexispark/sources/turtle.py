"""Turtle and TriG, read in splits.

What a line means depends on what stands before it: it may lie in a long string, its names on prefixes bound far above. So a file is
read in two passes. In the first, each split tells for every state that it may begin in (no string, a long string of either quote) the
state that it ends in and how many statements end in it; composed in file order, these give each split's true state and the number of
its first statement. The second pass cuts the splits into statements at full stops (and braces) outside strings, addresses, names
and remarks; only statements that cross a border are put together from several splits. Statements are parsed one by one, with the
prefixes that are bound at their place: each split knows what holds at its begin, and reads its own bindings in order. Graphs of
TriG hold from their brace on, carried over splits in the same way.

No step holds more of a file than a split, but for a row per split and one per changed binding. Blank nodes
without label are named by a hash of file, statement and place, the same in each run. A statement that isn't understood gives one row
with its text in `corrupt`, and the others stay whole. Empty files give nothing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
NORMAL, QUOTES = 0, ('"""', "'''")
#: What a line is made of outside long strings. A full stop is part of a name or number if more of it follows.
NAME = r"[^\s<>\"'()\[\]{};,#.\\^@]|\\."
WORD = rf"(?:{NAME}|\.(?=\d))(?:{NAME}|\.(?=\.*(?:{NAME})))*"
PIECE = re.compile(rf"""(?P<remark>\#[^\n]*)|(?P<iri><[^<>\s"{{}}|^`]*>)|(?P<long>\"\"\"|''')|(?P<string>"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])*')|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<word>{WORD})|(?P<cut>[.{{}}])|(?P<mark>\^\^|[()\[\];,])|(?P<space>\s+)|(?P<other>.)""", re.S)
REST = tuple(re.compile(rf"(?:[^{q}\\]++|\\.|{q}(?!{q}{q}))*+{q}{q}{q}", re.S) for q in "\"'")
STRING = re.compile(r"\"\"\"(.*)\"\"\"|'''(.*)'''|\"(.*)\"|'(.*)'", re.S)
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)", re.S)
SCHEME = re.compile("[A-Za-z][A-Za-z0-9+.-]*:")
CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
SHAPE = "file_id string, block long, no long, at int, s string, p string, o string, o_kind string, o_lang string, o_type string, corrupt string, opened string, closed boolean"


def cut(line: str, state: int) -> tuple[int, list[int]]:
    """The state after a line, and the places after the marks that end a statement."""
    ends, at = [], 0
    while True:
        if state != NORMAL:
            if QUOTES[state - 1] not in line[at:] or not (rest := REST[state - 1].match(line, at)):
                return state, ends
            state, at = NORMAL, rest.end()
        for m in PIECE.finditer(line, at):
            if m.lastgroup == "cut":
                ends.append(m.end())
            elif m.lastgroup == "long":
                state, at = QUOTES.index(m[0]) + 1, m.end()
                break
        else:
            return NORMAL, ends


def _lines(spark: SparkSession, path: str) -> DataFrame:
    where = [F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return spark.read.option("lineSep", "\n").text(path).select(*where, "value")


def _blocks(lines: DataFrame) -> DataFrame:
    """(file_id, block, state, first): each split's state at its begin and the number of its first statement."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict[tuple[str, int], list[list[int]]] = {}
        for x in batches:
            for file, block, line in zip(x["file_id"], x["block"], x["value"], strict=True):
                paths = now.setdefault((file, block), [[0, 0], [1, 0], [2, 0]])
                known = {state: cut(line, state) for state in {p[0] for p in paths}}
                for p in paths:
                    p[0], ends = known[p[0]]
                    p[1] += len(ends)
        yield pd.DataFrame([(*k, [p[0] for p in v], [p[1] for p in v]) for k, v in now.items()], columns=["file_id", "block", "ends", "cuts"])

    def compose(x: pd.DataFrame) -> pd.DataFrame:
        state = first = 0
        rows = []
        for file, block, ends, cuts in x.sort_values("block").itertuples(index=False):
            rows.append((file, block, state, first))
            state, first = int(ends[state]), first + int(cuts[state])
        return pd.DataFrame(rows, columns=["file_id", "block", "state", "first"])

    each = lines.mapInPandas(run, "file_id string, block long, ends array<int>, cuts array<long>")
    return each.groupBy("file_id").applyInPandas(compose, "file_id string, block long, state int, first long")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, block, no, text): statements with the mark that ends them, numbered by file; block is the split in which they end."""
    from lexispark.plans.durable import written

    lines = _lines(spark, path)
    starts = written(_blocks(lines))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        state, no, open_, border, rows = 0, 0, [], True, []
        for x in batches:
            for file, block, line, start, first in zip(x["file_id"], x["block"], x["value"], x["state"], x["first"], strict=True):
                if at != (file, block):
                    if at is not None:
                        rows.append((*at, no, "".join(open_), True))
                    at, state, no, open_, border = (file, block), start, first, [], True
                state, ends = cut(line, state)
                line, begin = line + "\n", 0
                for end in ends:
                    rows.append((*at, no, "".join([*open_, line[begin:end]]), border))
                    open_, border, begin, no = [], False, end, no + 1
                open_.append(line[begin:])
            yield pd.DataFrame(rows, columns=["file_id", "block", "no", "text", "border"])
            rows = []
        if at is not None:
            yield pd.DataFrame([(*at, no, "".join(open_), True)], columns=["file_id", "block", "no", "text", "border"])

    dealt = lines.join(starts, ["file_id", "block"]).repartition("file_id", "block").sortWithinPartitions("file_id", "block", "at")
    pieces = written(dealt.select("file_id", "block", "value", "state", "first").mapInPandas(run, "file_id string, block long, no long, text string, border boolean"))
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    crossing = pieces.where("border").groupBy("file_id", "no").agg(F.max("block").alias("block"), parts.alias("x"))
    whole = crossing.select("file_id", "block", "no", F.array_join(F.transform("x", lambda p: p["text"]), "").alias("text"))
    return pieces.where("NOT border").select("file_id", "block", "no", "text").union(whole).where(F.col("text").rlike(r"\S"))


class Bad(Exception):
    """A statement that isn't understood."""


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) without blanks and remarks; long strings are one token."""
    out, at = [], 0
    while at < len(text):
        m = PIECE.match(text, at)
        at, kind = m.end(), m.lastgroup
        if kind == "long":
            rest = REST[QUOTES.index(m[0])].match(text, at)
            if not rest:
                raise Bad
            out.append(("string", m[0] + rest[0]))
            at = rest.end()
        elif kind == "other":
            raise Bad
        elif kind not in ("space", "remark"):
            out.append((kind, m[0]))
    return out


def unescaped(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else CONTROL.get(m[3], m[3]), text) if "\\" in text else text


def directives(found: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(bindings, tokens behind them) of a statement: @prefix, @base, and PREFIX and BASE, which need no full stop."""
    bound, at = [], 0
    while at < len(found):
        name = found[at][1].lower().removeprefix("@") if found[at][0] in ("at", "word") else ""
        size = {"prefix": 3, "base": 2}.get(name, 0)
        part = found[at : at + size]
        if not size or len(part) < size or part[-1][0] != "iri" or (size == 3 and not part[1][1].endswith(":")):
            break
        bound.append((part[1][1] if size == 3 else "", unescaped(part[-1][1][1:-1])))
        at += size
        if found[at - size][0] == "at" and at < len(found) and found[at][1] == ".":
            at += 1
    return bound, found[at:]


def resolved(base: str, address: str) -> str:
    if SCHEME.match(address):
        return address
    return urljoin(base, address) if address else base.partition("#")[0]


class Statement:
    """The triples of one statement."""

    def __init__(self, found: list[tuple[str, str]], prefixes: dict[str, str], name: str):
        self.found, self.prefixes, self.name = found, prefixes, name
        self.at, self.fresh = 0, 0
        self.rows: list[tuple] = []

    def peek(self) -> tuple[str, str]:
        return self.found[self.at] if self.at < len(self.found) else ("end", "")

    def next(self) -> tuple[str, str]:
        out = self.peek()
        self.at += 1
        return out

    def blank(self) -> tuple[str, str]:
        self.fresh += 1
        return "_:" + hashlib.sha256(f"{self.name}:{self.fresh}".encode()).hexdigest()[:24], "blank"

    def add(self, s: tuple, p: str, o: tuple) -> None:
        self.rows.append((s[0], p, o[0], o[1], o[2] if len(o) > 2 else "", o[3] if len(o) > 3 else ""))


    def address(self, kind: str, text: str) -> str:
        if kind == "iri":
            return resolved(self.prefixes[""], unescaped(text[1:-1]))
        prefix, colon, local = text.partition(":")
        if kind != "word" or not colon or prefix + ":" not in self.prefixes:
            raise Bad
        return self.prefixes[prefix + ":"] + re.sub(r"\\(.)", r"\1", local)

    def node(self, as_object: bool = True) -> tuple:
        kind, text = self.next()
        if text == "[" and kind == "mark":
            own = self.blank()
            if self.peek()[1] != "]":
                self.properties(own)
            self.expect("]")
            return own
        if text == "(" and kind == "mark":
            return self.collection()
        if kind == "word" and text.startswith("_:"):
            return text, "blank"
        if not as_object or kind == "iri":
            return self.address(kind, text), "uri"
        if kind == "string":
            return self.literal(text)
        if kind == "word":
            if text in ("true", "false"):
                return text, "literal", "", XSD + "boolean"
            if re.fullmatch(r"[+-]?\d+", text):
                return text, "literal", "", XSD + "integer"
            if re.fullmatch(r"[+-]?\d*\.\d+", text):
                return text, "literal", "", XSD + "decimal"
            if re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+", text):
                return text, "literal", "", XSD + "double"
        return self.address(kind, text), "uri"

    def literal(self, text: str) -> tuple:
        m = STRING.fullmatch(text)
        body = unescaped(next(g for g in m.groups() if g is not None))
        if self.peek()[0] == "at":
            return body, "literal", self.next()[1][1:], ""
        if self.peek()[1] == "^^":
            self.next()
            return body, "literal", "", self.address(*self.next())
        return body, "literal", "", ""

    def collection(self) -> tuple:
        first = last = None
        while self.peek()[1] != ")" or self.peek()[0] != "mark":
            if self.peek()[0] == "end":
                raise Bad
            own, item = self.blank(), self.node()
            if last is None:
                first = own
            else:
                self.add(last, RDF + "rest", own)
            self.add(own, RDF + "first", item)
            last = own
        self.next()
        if last is None:
            return RDF + "nil", "uri"
        self.add(last, RDF + "rest", (RDF + "nil", "uri"))
        return first

    def properties(self, s: tuple) -> None:
        while True:
            kind, text = self.next()
            p = RDF + "type" if (kind, text) == ("word", "a") else self.address(kind, text)
            while True:
                self.add(s, p, self.node())
                if self.peek()[1] != ",":
                    break
                self.next()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.next()
            if self.peek()[1] in (".", "]", "}", "") and self.peek()[0] in ("cut", "mark", "end"):
                return

    def expect(self, text: str) -> None:
        if self.next()[1] != text:
            raise Bad

    def parse(self) -> tuple[list[tuple], str | None, bool]:
        """(triples, graph that it opens, whether it closes one)."""
        if not self.found or self.found[-1][0] != "cut":
            raise Bad
        end = self.found[-1][1]
        if end == "{":
            body = self.found[:-1]
            if body and body[0][1].upper() == "GRAPH":
                body = body[1:]
            self.found, self.at = body, 0
            graph = self.node(as_object=False)[0] if body else ""
            if self.at != len(body):
                raise Bad
            return [], graph, False
        if len(self.found) > 1:
            bracket = self.peek()[1] == "["
            s = self.node(as_object=False)
            if not (bracket and self.peek()[0] == "cut"):
                self.properties(s)
        self.expect(end)
        return self.rows, None, end == "}"


def scopes(found: DataFrame) -> DataFrame:
    """(file_id, block, first, bound): the prefixes that hold where a split's first statement begins ("" is the base). Bindings that
    only repeat one are left out before a file's are put in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for file, no, text in zip(x["file_id"], x["no"], x["text"], strict=True):
                try:
                    rows += [(file, no, i, *b) for i, b in enumerate(directives(tokens(text))[0])]
                except Bad:
                    pass
            yield pd.DataFrame(rows, columns=["file_id", "no", "i", "prefix", "iri"])

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        rows, own = [], None
        for file, no, i, prefix, iri, block in x.sort_values(["no", "i"]).itertuples(index=False):
            own = {"": file} if own is None else own
            if i < 0:
                rows.append((file, int(block), no, list(own.items())))
            else:
                own[prefix] = resolved(own[""], iri)
        return pd.DataFrame(rows, columns=["file_id", "block", "first", "bound"])

    likely = found.where(F.col("text").rlike(r"(?i)^(?:\s|#[^\n]*\n)*+@?(?:prefix|base)\b"))
    every = likely.mapInPandas(run, "file_id string, no long, i int, prefix string, iri string")
    before = F.lag("iri").over(Window.partitionBy("file_id", "prefix").orderBy("no", "i"))
    # a relative address means another one when the base has changed
    changed = every.withColumn("before", before).where(f"before IS NULL OR before <> iri OR NOT iri RLIKE '^{SCHEME.pattern}'")
    begins = found.groupBy("file_id", "block").agg(F.min("no").alias("no"))
    none = F.lit(None).cast("string")
    both = changed.select("file_id", "no", "i", "prefix", "iri", F.lit(0).cast("long").alias("block")).union(begins.select("file_id", "no", F.lit(-1), none, none, "block"))
    return both.groupBy("file_id").applyInPandas(fold, "file_id string, block long, first long, bound array<struct<prefix: string, iri: string>>")


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, s, p, o, o_kind, o_lang, o_type, g, corrupt) of Turtle or TriG files; g is null outside named graphs."""
    from lexispark.plans.durable import written

    found = written(statements(spark, path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, str] = {}
        for x in batches:
            rows: list[tuple] = []
            for file, block, no, text, bound in zip(x["file_id"], x["block"], x["no"], x["text"], x["bound"], strict=True):
                own = own if bound is None else {b["prefix"]: b["iri"] for b in bound}
                try:
                    new, rest = directives(tokens(text))
                    for prefix, iri in new:
                        own[prefix] = resolved(own[""], iri)
                    if not rest:
                        continue
                    triples, opened, closed = Statement(rest, own, f"{file}:{no}").parse()
                    rows += [(file, block, no, i, *t, None, None, None) for i, t in enumerate(triples)]
                    if opened is not None or closed:
                        rows.append((file, block, no, len(triples), *[None] * 7, opened, closed))
                except (Bad, RecursionError):
                    rows.append((file, block, no, 0, *[None] * 6, text, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SHAPE.split(", ")])

    # a split's statements in order, its first with what is bound there
    dealt = found.join(scopes(found), ["file_id", "block"]).withColumn("bound", F.when(F.col("no") == F.col("first"), F.col("bound")))
    dealt = dealt.repartition("file_id", "block").sortWithinPartitions("file_id", "block", "no")
    parsed = written(dealt.select("file_id", "block", "no", "text", "bound").mapInPandas(run, SHAPE))
    # the graph that holds: the last brace before, in the split or else in an earlier one
    event = F.when(F.col("opened").isNotNull() | F.col("closed"), F.struct("opened"))
    in_block = F.last(event, ignorenulls=True).over(Window.partitionBy("file_id", "block").orderBy("no").rangeBetween(Window.unboundedPreceding, -1))
    last = parsed.where(event.isNotNull()).groupBy("file_id", "block").agg(F.max_by(event, F.struct("no", "at")).alias("last"))
    every = parsed.select("file_id", "block").distinct().join(last, ["file_id", "block"], "left")
    carried = every.select("file_id", "block", F.last("last", ignorenulls=True).over(Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    graph = F.coalesce("event", "carried")["opened"]
    rows = parsed.withColumn("event", in_block).join(carried, ["file_id", "block"]).where("p IS NOT NULL OR corrupt IS NOT NULL")
    return rows.select("file_id", "s", "p", "o", "o_kind", "o_lang", "o_type", F.when(graph != "", graph).alias("g"), "corrupt")
