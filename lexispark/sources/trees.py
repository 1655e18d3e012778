"""RDF that comes as a tree per file: RDF/XML and JSON-LD documents of any nesting.

A file is one row and one task's, walked once from its begin; large corpora are many such files. Blank nodes without a name of their
own are named by a hash of the file and their place in it, so a repeated task names them alike. What isn't understood gives a row with
a message in `corrupt`; statements before (XML) or beside it (JSON) stay. Empty files give nothing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.sources.turtle import RDF, SCHEME, XSD, resolved

SHAPE = "file_id string, s string, p string, o string, o_kind string, o_lang string, o_type string, g string, corrupt string"
NAMES = [c.split()[0] for c in SHAPE.split(", ")]
XML = "http://www.w3.org/XML/1998/namespace"


class Statements:
    """Rows of a file, and names for its blank nodes."""

    def __init__(self, file: str):
        self.file, self.rows = file, []

    def blank(self, place: str) -> tuple[str, str]:
        return "_:" + hashlib.sha256(f"{self.file}:{place}".encode()).hexdigest()[:24], "blank"

    def add(self, s: str, p: str, o: str, kind: str, lang: str = "", type_: str = "", graph: str | None = None) -> None:
        self.rows.append((self.file, s, p, o, kind, lang, type_, graph, None))

    def bad(self, message: str) -> None:
        self.rows.append((self.file, *[None] * 7, message))

    def collection(self, s: str, p: str, items: list[tuple], place: str, graph: str | None = None) -> None:
        """The list s p (items), an item being what comes after the predicate of a statement."""
        for i, item in enumerate(items):
            cell = self.blank(f"{place}:cell {i}")
            self.add(s, p, *cell, graph=graph)
            self.add(cell[0], RDF + "first", *item, graph=graph)
            s, p = cell[0], RDF + "rest"
        self.add(s, p, RDF + "nil", "uri", graph=graph)


class XmlWalk:
    """Node elements and property elements by turns; a frame per open element."""

    def __init__(self, out: Statements, content: bytes):
        self.out, self.content, self.count = out, content, 0
        self.frames: list[dict] = [{"is": "top", "lang": "", "base": out.file}]
        self.parser = p = expat.ParserCreate(namespace_separator=" ")
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.text
        p.CommentHandler = p.ProcessingInstructionHandler = lambda *_: self.mark()

    def run(self) -> None:
        try:
            self.parser.Parse(self.content, True)
        except (expat.ExpatError, ValueError) as e:
            self.out.bad(f"{type(e).__name__}: {e}")

    def mark(self) -> None:
        """A literal of XML begins where the first thing after its tag does."""
        top = self.frames[-1]
        if top["is"] == "xml" and top["begin"] is None:
            top["begin"] = self.parser.CurrentByteIndex

    def address(self, frame: dict, text: str) -> str:
        return resolved(frame["base"], text)

    def start(self, name: str, given: dict[str, str]) -> None:
        self.mark()
        self.count += 1
        above = self.frames[-1]
        full = name.replace(" ", "", 1)
        own = {k.replace(" ", "", 1): v for k, v in given.items()}
        frame = {"lang": own.pop(XML + "lang", above["lang"]), "base": resolved(above["base"], own.pop(XML + "base", above["base"])), "no": self.count}
        own = {k: v for k, v in own.items() if not k.startswith(XML)}
        if above["is"] == "xml":
            frame |= {"is": "xml", "begin": -1}
        elif above["is"] == "top" and full == RDF + "RDF":
            frame |= {"is": "top"}
        elif above["is"] in ("top", "property", "list"):
            self.node(frame, above, full, own)
        elif above["is"] == "node":
            self.property(frame, above, full, own)
        else:
            raise ValueError(f"element {full} inside an empty property")
        self.frames.append(frame)

    def subject(self, frame: dict, own: dict[str, str]) -> tuple[str, str]:
        if RDF + "about" in own:
            return self.address(frame, own.pop(RDF + "about")), "uri"
        if RDF + "ID" in own:
            return self.address(frame, "#" + own.pop(RDF + "ID")), "uri"
        if RDF + "nodeID" in own:
            return "_:" + own.pop(RDF + "nodeID"), "blank"
        return self.out.blank(str(self.count))

    def node(self, frame: dict, above: dict, full: str, own: dict[str, str]) -> None:
        me = self.subject(frame, own)
        frame |= {"is": "node", "me": me, "items": 0}
        if full != RDF + "Description":
            self.out.add(me[0], RDF + "type", full, "uri")
        self.attributes(frame, me, own)
        if above["is"] == "property":
            if above["filled"]:
                raise ValueError("two nodes in one property")
            above["filled"] = True
            self.state(above, *me)
        elif above["is"] == "list":
            above["items"].append(me)

    def attributes(self, frame: dict, me: tuple[str, str], own: dict[str, str]) -> None:
        for name, value in own.items():
            if name == RDF + "type":
                self.out.add(me[0], name, self.address(frame, value), "uri")
            elif SCHEME.match(name):  # names without a namespace say nothing
                self.out.add(me[0], name, value, "literal", frame["lang"])

    def state(self, frame: dict, *o: str) -> None:
        s, p = frame["of"], frame["p"]
        self.out.add(s, p, *o)
        if frame["id"]:
            for part, value in (("subject", (s, "blank" if s.startswith("_:") else "uri")), ("predicate", (p, "uri")), ("object", o)):
                self.out.add(frame["id"], RDF + part, *value)
            self.out.add(frame["id"], RDF + "type", RDF + "Statement", "uri")

    def property(self, frame: dict, above: dict, full: str, own: dict[str, str]) -> None:
        if full == RDF + "li":
            above["items"] += 1
            full = f"{RDF}_{above['items']}"
        named = own.pop(RDF + "ID", None)
        frame |= {"of": above["me"][0], "p": full, "id": named and self.address(frame, "#" + named)}
        parse, kind = own.pop(RDF + "parseType", None), own.pop(RDF + "datatype", "")
        if parse == "Resource":
            me = self.out.blank(str(self.count))
            self.state(frame, *me)
            frame |= {"is": "node", "me": me, "items": 0}
        elif parse == "Collection":
            frame |= {"is": "list", "items": []}
        elif parse is not None:
            frame |= {"is": "xml", "begin": None, "property": True}
        elif RDF + "resource" in own or RDF + "nodeID" in own or any(SCHEME.match(k) for k in own):
            me = (self.address(frame, own.pop(RDF + "resource")), "uri") if RDF + "resource" in own else self.subject(frame, own)
            self.state(frame, *me)
            self.attributes(frame, me, own)
            frame |= {"is": "empty"}
        else:
            frame |= {"is": "property", "text": [], "filled": False, "type": kind and self.address(frame, kind)}

    def text(self, data: str) -> None:
        self.mark()
        top = self.frames[-1]
        if top["is"] == "property":
            top["text"].append(data)
        elif top["is"] != "xml" and data.strip():
            raise ValueError(f"text in a place of elements: {data.strip()[:40]}")

    def end(self, name: str) -> None:
        self.mark()
        frame = self.frames.pop()
        if frame["is"] == "property":
            text = "".join(frame["text"])
            if not frame["filled"]:
                self.state(frame, text, "literal", "" if frame["type"] else frame["lang"], frame["type"])
            elif text.strip():
                raise ValueError("text beside a node")
        elif frame["is"] == "list":
            self.out.collection(frame["of"], frame["p"], frame["items"], str(frame["no"]))
        elif frame["is"] == "xml" and frame.get("property"):
            raw = self.content[frame["begin"] : self.parser.CurrentByteIndex]
            self.state(frame, raw.decode("utf-8"), "literal", "", RDF + "XMLLiteral")


class JsonWalk:
    """Nodes, values and lists under the contexts that hold for them."""

    def __init__(self, out: Statements):
        self.out = out

    def run(self, text: str) -> None:
        try:
            found = json.loads(text)
        except (ValueError, RecursionError) as e:
            self.out.bad(f"{type(e).__name__}: {e}")
            return
        for i, x in enumerate(found if isinstance(found, list) else [found]):
            before = len(self.out.rows)
            try:
                self.node(x, {"@base": self.out.file}, str(i), None)
            except (ValueError, TypeError, AttributeError, KeyError, RecursionError) as e:
                del self.out.rows[before:]
                self.out.bad(f"{type(e).__name__}: {e}"[:500])

    def context(self, given, now: dict) -> dict:
        now = dict(now)
        for part in given if isinstance(given, list) else [given]:
            if part is None:
                now = {"@base": self.out.file}
            elif isinstance(part, str):
                raise ValueError(f"remote context {part}")
            else:
                now |= {k: v if isinstance(v, dict) or v is None else {"@id": v} if not k.startswith("@") else v for k, v in part.items()}
                if "@base" in part:
                    now["@base"] = resolved(self.out.file, part["@base"] or "")
        return now

    def expand(self, name: str, c: dict, vocab: bool = True, deep: int = 0) -> str:
        term = c.get(name) if vocab and not name.startswith("@") else None
        if name.startswith("@") or deep > 20:
            return name
        if isinstance(term, dict) and term.get("@id", name) != name:
            return self.expand(term["@id"], c, True, deep + 1)
        prefix, colon, rest = name.partition(":")
        if colon:
            known = c.get(prefix)
            if prefix == "_" or rest.startswith("//") or not isinstance(known, dict) or "@id" not in known:
                return name
            return self.expand(known["@id"], c, True, deep + 1) + rest
        return self.expand(c["@vocab"], c, False, deep + 1) + name if vocab and c.get("@vocab") is not None else name

    def address(self, text: str, c: dict, vocab: bool = False) -> tuple[str, str]:
        full = self.expand(text, c, vocab)
        return (full, "blank") if full.startswith("_:") else (resolved(c["@base"], full), "uri")

    def alias(self, x: dict, c: dict) -> dict:
        """x with keywords instead of the terms that stand for them."""
        return {(k if k.startswith("@") else e if (e := self.expand(k, c)).startswith("@") else k): v for k, v in x.items()}

    def node(self, x: dict, c: dict, place: str, graph: str | None) -> tuple[str, str]:
        if not isinstance(x, dict):
            raise ValueError("a node must be an object")
        c = self.context(x["@context"], c) if "@context" in x else c
        x = self.alias(x, c)
        me = self.address(x["@id"], c) if "@id" in x else self.out.blank(place)
        for kind in self.many(x.get("@type", [])):
            self.out.add(me[0], RDF + "type", *self.address(kind, c, True), graph=graph)
        for key, value in x.items():
            where = f"{place}/{key}"
            if key == "@graph":
                inner = me[0] if set(x) - {"@context", "@graph"} else graph
                for i, n in enumerate(self.many(value)):
                    self.node(n, c, f"{where}.{i}", inner)
            elif key == "@reverse":
                for name, ends in value.items():
                    for i, n in enumerate(self.many(ends)):
                        self.out.add(self.node(n, c, f"{where}/{name}.{i}", graph)[0], self.expand(name, c), *me, graph=graph)
            elif not key.startswith("@"):
                self.values(me, key, value, c, where, graph)
        return me

    @staticmethod
    def many(x) -> list:
        return x if isinstance(x, list) else [x]

    def values(self, me: tuple, key: str, value, c: dict, place: str, graph: str | None) -> None:
        p, term = self.expand(key, c), c.get(key) if isinstance(c.get(key), dict) else {}
        if not SCHEME.match(p) or key in c and c[key] is None:
            return  # names that no context knows say nothing
        if "@reverse" in term:
            for i, n in enumerate(self.many(value)):
                self.out.add(self.node({"@id": n} if isinstance(n, str) else n, c, f"{place}.{i}", graph)[0], self.expand(term["@reverse"], c), *me, graph=graph)
            return
        holds = term.get("@container")
        if holds == "@language" and isinstance(value, dict):
            value = [{"@value": v, "@language": lang} for lang, own in value.items() for v in self.many(own)]
        elif holds in ("@index", "@id") and isinstance(value, dict):
            value = [(v | {"@id": k} if holds == "@id" else v) for k, own in value.items() for v in self.many(own)]
        if holds == "@list":
            value = {"@list": value}
        for i, v in enumerate(self.many(value)):
            listed = v.get("@list") if isinstance(v, dict) else None
            if isinstance(v, dict) and "@set" in v:
                self.values(me, key, v["@set"], c, f"{place}.{i}", graph)
            elif listed is not None:
                items = [o for j, n in enumerate(self.many(listed)) if (o := self.thing(n, term, c, f"{place}.{i}.{j}", graph))]
                self.out.collection(me[0], p, items, f"{place}.{i}", graph)
            elif o := self.thing(v, term, c, f"{place}.{i}", graph):
                self.out.add(me[0], p, *o, graph=graph)

    def thing(self, v, term: dict, c: dict, place: str, graph: str | None) -> tuple | None:
        """What comes after the predicate; None for null."""
        if isinstance(v, list):
            raise ValueError("a list of lists")
        kind, lang = term.get("@type", ""), term.get("@language", c.get("@language"))
        if isinstance(v, dict):
            v = self.alias(v, c)
            if "@value" not in v:
                return self.node(v, c, place, graph)
            kind, lang, v = v.get("@type", ""), v.get("@language"), v["@value"]
        elif isinstance(v, str) and kind in ("@id", "@vocab"):
            return self.address(v, c, kind == "@vocab")
        kind = "" if kind in ("@id", "@vocab", "@none") else kind and self.address(kind, c, True)[0]
        if v is None:
            return None
        if isinstance(v, bool):
            return str(v).lower(), "literal", "", kind or XSD + "boolean"
        if isinstance(v, int) or isinstance(v, float) and v.is_integer() and abs(v) < 1e21 and kind != XSD + "double":
            return str(int(v)), "literal", "", kind or XSD + "integer"
        if isinstance(v, float):
            digits, _, power = f"{v:.15E}".partition("E")
            return f"{digits.rstrip('0')}{'0' if digits.rstrip('0').endswith('.') else ''}E{int(power)}", "literal", "", kind or XSD + "double"
        if not isinstance(v, str):
            raise ValueError("a value must be plain")
        return v, "literal", "" if kind else lang or "", kind


def _read(files: DataFrame, walk: Callable[[Statements, bytes], None]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for file, content in zip(x["path"], x["content"], strict=True):
                out = Statements(file)
                walk(out, content)
                for at in range(0, len(out.rows), 50_000):
                    yield pd.DataFrame(out.rows[at : at + 50_000], columns=NAMES)

    return files.select("path", "content").mapInPandas(run, SHAPE)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """RDF/XML documents: nested nodes, typed nodes, attributes as properties, parseType, containers, collections, reification."""
    return rdf_xml_documents(_files(spark, path))


def rdf_xml_documents(files: DataFrame) -> DataFrame:
    """The same of files(path, content); the path is the file's id."""
    return _read(files, lambda out, content: XmlWalk(out, content).run())


def json_ld(spark: SparkSession, path: str) -> DataFrame:
    """JSON-LD documents with their own contexts: terms, prefixes, typed terms, containers, graphs, lists, reverse properties. Remote
    contexts are not fetched: such a document is corrupt."""
    return json_ld_documents(_files(spark, path))


def json_ld_documents(files: DataFrame) -> DataFrame:
    """The same of files(path, content); the path is the file's id."""
    return _read(files, lambda out, content: JsonWalk(out).run(content.decode("utf-8", "replace")))
