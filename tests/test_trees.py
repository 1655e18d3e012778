"""RDF/XML and JSON-LD documents, and words in order, by hand-written statements."""

import json

import pytest

from lexispark.sources import rdf, trees

R, V, X = trees.RDF, "http://v/", trees.XSD


def read(spark, tmp_path, name, text, reader):
    (tmp_path / name).write_bytes(text.encode())
    rows = reader(spark, f"file://{tmp_path}/{name}").collect()
    good = [tuple(r[c] for c in trees.NAMES[1:8]) for r in rows if r["corrupt"] is None]
    return good, [r["corrupt"] for r in rows if r["corrupt"] is not None]


def tree(rows, x):
    """What hangs on a node, blank ones replaced by what hangs on them."""
    return {(p, tree(rows, o) if kind == "blank" else o, lang or type_) for s, p, o, kind, lang, type_, _ in rows if s == x} if not x.startswith("_:") else frozenset((p, tree(rows, o) if kind == "blank" else o, lang or type_) for s, p, o, kind, lang, type_, _ in rows if s == x)


def cells(*items):
    out = R + "nil"
    for item, mark in reversed(items):
        out = frozenset({(R + "first", item, mark), (R + "rest", out, "")})
    return out


XML = f"""<?xml version="1.0"?><!DOCTYPE rdf:RDF [<!ENTITY v "{V}">]><rdf:RDF xmlns:rdf="{R}" xmlns:v="&v;" xml:base="http://b/" xml:lang="en">
<rdf:Description rdf:about="a"><v:p><v:T rdf:ID="n" v:q="att"><v:r rdf:resource="#z"/></v:T></v:p><v:after>text <![CDATA[<&]]> &amp;</v:after>
 <v:res rdf:parseType="Resource"><v:x rdf:datatype="&v;t">1</v:x></v:res>
 <v:l rdf:parseType="Collection"><rdf:Description rdf:about="1"/><v:U/></v:l><v:none rdf:parseType="Collection"/>
 <v:lit rdf:parseType="Literal">a <b c="d">c</b> <!-- x --></v:lit><v:e/><v:id rdf:ID="st" xml:lang="">v</v:id><v:at v:q="w"/></rdf:Description>
<rdf:Seq rdf:about="s"><rdf:li>one</rdf:li><rdf:li rdf:nodeID="k"/></rdf:Seq><v:W rdf:nodeID="k" plain="x"/>"""


def test_rdf_xml_of_all_forms(spark, tmp_path):
    got, bad = read(spark, tmp_path, "x.rdf", XML + "</rdf:RDF>", trees.rdf_xml)
    assert not bad and len(got) == len(set(got))
    assert tree(got, "http://b/a") == {
        (V + "p", "http://b/#n", ""), (V + "after", "text <& &", "en"), (V + "res", frozenset({(V + "x", "1", V + "t")}), ""),
        (V + "l", cells(("http://b/1", ""), (frozenset({(R + "type", V + "U", "")}), "")), ""), (V + "none", R + "nil", ""),
        (V + "lit", 'a <b c="d">c</b> <!-- x -->', R + "XMLLiteral"), (V + "e", "", "en"), (V + "id", "v", ""), (V + "at", frozenset({(V + "q", "w", "en")}), ""),
    }
    assert tree(got, "http://b/#n") == {(R + "type", V + "T", ""), (V + "q", "att", "en"), (V + "r", "http://b/#z", "")}
    assert tree(got, "http://b/#st") == {(R + "subject", "http://b/a", ""), (R + "predicate", V + "id", ""), (R + "object", "v", ""), (R + "type", R + "Statement", "")}
    assert tree(got, "http://b/s") == {(R + "type", R + "Seq", ""), (R + "_1", "one", "en"), (R + "_2", frozenset({(R + "type", V + "W", "")}), "")}
    assert got == read(spark, tmp_path, "x.rdf", XML + "</rdf:RDF>", trees.rdf_xml)[0]


@pytest.mark.parametrize("end", ["<rdf:Description rdf:about='q'>text</rdf:Description></rdf:RDF>", "<v:p", "", "<v:N><v:p>x<v:M/></v:p></v:N></rdf:RDF>", "<v:N><v:p><v:M/><v:M/></v:p></v:N></rdf:RDF>", "<v:N><v:p rdf:resource='x'><v:M/></v:p></v:N></rdf:RDF>"])
def test_damaged_xml_says_so_and_keeps_what_stands_before(spark, tmp_path, end):
    got, bad = read(spark, tmp_path, "x.rdf", XML + end, trees.rdf_xml)
    assert len(bad) == 1 and tree(got, "http://b/s")


def test_json_ld_of_all_forms(spark, tmp_path):
    context = {
        "@vocab": V, "ex": "http://e/", "id": "@id", "kind": "@type", "knows": {"@id": "ex:knows", "@type": "@id"}, "l": {"@container": "@list"}, "lab": {"@id": "ex:l", "@container": "@language"}, "@language": "de",
        "day": {"@type": "ex:date"}, "of": {"@reverse": "ex:of"}, "gone": None, "by": {"@container": "@index"},
    }
    doc = {
        "@context": context, "id": "ex:a", "kind": ["T", "ex:S"], "name": "N", "knows": ["ex:b", "http://abs/c", "_:n"], "l": [1, 2.5, True, {"x": "y"}, None], "lab": {"en": "E", "fr": ["F", "G"]}, "day": "today", "gone": 1, "http://full/p": {"@value": "z", "@type": "ex:t"},
        "n": {"m": None, "o": {"@set": [{"@value": "v", "@language": "it"}, 1e30]}}, "@reverse": {"ex:r": [{"id": "ex:c"}]}, "of": {"id": "ex:d"}, "empty": {"@list": []}, "by": {"i": {"id": "ex:i"}},
    }
    graph = {"@context": {"@base": "http://base/x/"}, "@id": "g", "@graph": [{"@id": "s", "http://v/p": {"@id": "../o"}}, {"@context": "http://remote/", "@id": "t"}]}
    plain = {"@context": [context, {"ex": "http://other/"}], "@graph": [{"id": "ex:z", "ex:p": 1}]}
    got, bad = read(spark, tmp_path, "x.jsonld", json.dumps([doc, graph, plain, 5]), trees.json_ld)
    assert len(bad) == 2 and "remote" in bad[0]  # the graph with it goes as a whole
    assert tree(got, "http://e/a") == {
        (R + "type", V + "T", ""), (R + "type", "http://e/S", ""), (V + "name", "N", "de"), ("http://e/knows", "http://e/b", ""), ("http://e/knows", "http://abs/c", ""), ("http://e/knows", frozenset(), ""),
        (V + "l", cells(("1", X + "integer"), ("2.5E0", X + "double"), ("true", X + "boolean"), (frozenset({(V + "x", "y", "de")}), "")), ""), ("http://e/l", "E", "en"), ("http://e/l", "F", "fr"), ("http://e/l", "G", "fr"),
        (V + "day", "today", "http://e/date"), ("http://full/p", "z", "http://e/t"), (V + "n", frozenset({(V + "o", "v", "it"), (V + "o", "1.0E30", X + "double")}), ""), (V + "empty", R + "nil", ""), (V + "by", "http://e/i", ""),
    }
    assert tree(got, "http://e/c") == {("http://e/r", "http://e/a", "")} and tree(got, "http://e/d") == {("http://e/of", "http://e/a", "")}
    assert tree(got, "http://other/z") == {("http://other/p", "1", X + "integer")}
    del graph["@graph"][1]
    got, bad = read(spark, tmp_path, "y.jsonld", json.dumps(graph), trees.json_ld)
    assert bad == [] and got == [("http://base/x/s", "http://v/p", "http://base/o", "uri", "", "", "http://base/x/g")]
    for text in (" ", "{", "[" * 100_000):
        assert len(read(spark, tmp_path, "z.jsonld", text, trees.json_ld)[1]) == 1
    assert read(spark, tmp_path, "z.jsonld", "", trees.json_ld) == ([], [])


def test_syntax_by_name_and_mime():
    assert [rdf.syntax_of(x) for x in ("a/b.TTL.gz", "x.owl", "y.nq", "z.jsonld", "none")] == ["ttl", "rdf", "nq", "jsonld", None]
    assert rdf.syntax_of("x.rdf", "text/turtle; charset=utf-8") == "ttl"


def test_words_of_long_sentences_and_cycles(spark):
    chain = [(f"w{i:05}", "next", f"w{i + 1:05}") for i in range(3000)] + [("c1", "next", "c2"), ("c2", "next", "c1"), ("c2", "next", "c3")] + [("x", "pos", "N"), ("a", "next", "b"), ("a2", "next", "b"), ("b", "next", "c")]
    got = rdf.words_in_order(spark.createDataFrame(chain, "s string, p string, o string"), "next", {"pos": "pos"}).collect()
    by = {}
    for r in got:
        by.setdefault(r["head"], []).append((r["row_no"], r["word"]))
    assert sorted(by["w00000"]) == [(i, f"w{i:05}") for i in range(3001)]
    assert set(by) == {"w00000", "x", "a", "a2"} and sorted(by["a2"]) == [(0, "a2"), (1, "b"), (2, "c")] and [r["pos"] for r in got if r["word"] == "x"] == ["N"]
