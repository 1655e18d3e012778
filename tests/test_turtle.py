"""Turtle and TriG in many splits against the statements that they were made of."""

import random

import pytest

from lexispark.sources import turtle

XSD = turtle.XSD


@pytest.fixture
def splits(spark):
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def read(spark, tmp_path, text, name="x.ttl"):
    (tmp_path / name).write_bytes(text.encode())
    rows = turtle.turtle(spark, f"file://{tmp_path}/{name}").collect()
    return sorted((tuple(r[c] for c in ("s", "p", "o", "o_kind", "o_lang", "o_type", "g")) for r in rows if r["corrupt"] is None), key=str), [r["corrupt"].strip() for r in rows if r["corrupt"] is not None]


def made(rng, n):
    """Turtle of n subjects in all its ways of writing, and its statements; spaces change with the place."""
    text, want, space = [], [], "http://one/"
    text.append(f"@prefix p: <{space}> . # . \"\"\" remark\n@base <http://base/dir/x> .\n")
    strings = ["plain", "a . b ; \"quoted\" , # [ ] ( ) { } @prefix p: <no> .", "two\nlines . \n\n'''", "\\ back \t", "é日本😀", "", 'ends in "x', "<http://x> ."]

    def literal():
        body = rng.choice(strings)
        plain = body.replace("\\", "\\\\").replace('"', '\\"').replace("\t", "\\t")
        form = rng.choice(["short", "long", "single"])
        if form == "short":
            out = '"' + plain.replace("\n", "\\n") + '"'
        elif form == "long":
            out = '"""' + plain.replace('\\"quoted', '"quoted') + '"""'
        else:
            out = "'''" + body.replace("\\", "\\\\").replace("'", "\\'") + "'''"
        kind = rng.randrange(3)
        return (out, (body, "literal", "", "")) if kind == 0 else (out + "@en-GB", (body, "literal", "en-GB", "")) if kind == 1 else (out + "^^p:t", (body, "literal", "", space + "t"))

    def thing():
        k = rng.randrange(9)
        if k == 0:
            return "<rel>", ("http://base/dir/rel", "uri", "", "")
        if k == 1:
            return "p:a.b-c", (space + "a.b-c", "uri", "", "")
        if k == 2:
            return "_:n.1", ("_:n.1", "blank", "", "")
        if k == 3:
            number, kind = rng.choice([("5", "integer"), ("-1.50", "decimal"), ("1.e5", "double"), (".5", "decimal")])
            return number, (number, "literal", "", XSD + kind)
        if k == 4:
            return "true", ("true", "literal", "", XSD + "boolean")
        if k == 5:
            return r"p:x\.y\#z", (space + "x.y#z", "uri", "", "")
        return literal()

    for i in range(n):
        if rng.random() < 0.2:
            space = rng.choice(["http://one/", "http://two#"])
            text.append(rng.choice([f"@prefix p: <{space}>.\n", f"PREFIX p: <{space}>\n", f"@prefix\n p:\n <{space}>\n.\n"]))
        s = rng.choice([f"<http://s/{i}>", f"p:s{i}"])
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p, full = rng.choice([("a", turtle.RDF + "type"), ("p:p", space + "p"), ("<q>", "http://base/dir/q")])
            objects = [thing() for _ in range(rng.randrange(1, 3))]
            parts.append(p + " " + " ,\n ".join(o for o, _ in objects))
            want += [(f"http://s/{i}" if s[0] == "<" else f"{space}s{i}", full, *o) for _, o in objects]
        text.append(s + "  " + " ;;\n\t".join(parts) + rng.choice([" .", ".", " ;\n ."]) + rng.choice(["\n", " # end .\n", " "]) + (" \n" if parts[-1].endswith("p:a.b-c") else " "))
    return "".join(text), want


@pytest.mark.parametrize("seed,size", [(0, 40), (1, 97), (2, 1000), (3, 1 << 20)])
def test_splits_change_nothing(spark, tmp_path, splits, seed, size):
    text, want = made(random.Random(seed), 40)
    splits(size)
    got, bad = read(spark, tmp_path, text)
    assert not bad and got == sorted([(*w, None) for w in want], key=str)


def shape(rows):
    """Statements with blank nodes replaced by what hangs on them."""
    by = {}
    for s, p, o, kind, *_ in rows:
        by.setdefault(s, []).append((p, o, kind))

    def tree(x, kind):
        return tuple(sorted((p, tree(o, k)) for p, o, k in by.get(x, []))) if kind == "blank" else x

    return [(s, p, tree(o, kind)) for s, p, o, kind, *_ in rows if not s.startswith("_:")]


def test_nested_nodes_and_lists(spark, tmp_path, splits):
    splits(30)
    text = '@prefix : <http://x/> .\n:s :p [ :q [ ] ; :r ( 1 "two"@en ( ) ) ;\n ] , () .\n[ :a :b ] .\n[] :c :d .\n( :e ) :f :g .:h :i :j.k .\n'
    got, bad = read(spark, tmp_path, text)
    x, r = "http://x/", turtle.RDF
    nil = r + "nil"
    lists = ((r + "first", "1"), (r + "rest", ((r + "first", "two"), (r + "rest", ((r + "first", nil), (r + "rest", nil))))))
    assert sum(y[0].startswith("_:") for y in got) == 2 + 6 + 1 + 1 + 3 and bad == [] and (x + "h", x + "i", x + "j.k") in [y[:3] for y in got]
    assert (x + "s", x + "p", ((x + "q", ()), (x + "r", lists))) in shape(got) and (x + "s", x + "p", nil) in shape(got)
    assert read(spark, tmp_path, text)[0] == got  # the same names in each run


def test_named_graphs(spark, tmp_path, splits):
    text = '@prefix : <http://x/> .\n:a :p 1 .\n:g1 { :b :p """}\n.{""" . :c :p 2 }\n{ :d :p 3 . }\nGRAPH <http://g2>\n{\n' + "".join(f":e{i} :p {i} .\n" for i in range(30)) + "}\n:f :p 4 .\n:empty { }\n:h :p 5 ."
    want = [("a", "1", None), ("b", "}\n.{", "http://x/g1"), ("c", "2", "http://x/g1"), ("d", "3", None), *[(f"e{i}", str(i), "http://g2") for i in range(30)], ("f", "4", None), ("h", "5", None)]
    for size in (25, 60, 1 << 20):
        splits(size)
        got, bad = read(spark, tmp_path, text, "x.trig")
        assert not bad and sorted((r[0].removeprefix("http://x/"), r[2], r[6]) for r in got) == sorted(want)


def test_damage_stays_where_it_is(spark, tmp_path, splits):
    splits(50)
    text = '<http://a> <http://b> "x" .\n<http://a> unknown:p 1 .\n<http://a> "no" 1 .\n<http://a> <http://b> (1 .\n<http://a> <http://b> "y" .\n<http://a> <http://b> "never ends\n'
    got, bad = read(spark, tmp_path, text)
    assert [r[2] for r in got] == ["x", "y"] and len(bad) == 4
    splits(100_000)
    deep = "<http://a> <http://b> " + "[ <http://c> " * 50_000 + "1" + " ]" * 50_000 + " .\n<http://a> <http://b> 2 .\n"
    got, bad = read(spark, tmp_path, deep)
    assert [r[2] for r in got] == ["2"] and len(bad) == 1
    assert read(spark, tmp_path, "") == ([], []) and read(spark, tmp_path, "# only\n\n") == ([], [])


def test_a_literal_over_many_splits(spark, tmp_path, splits):
    splits(100_000)
    body = "line . ; \" ' \n" * 200_000
    got, bad = read(spark, tmp_path, f'<http://a> <http://b> """{body}""" , 2 .\n')
    assert not bad and sorted(len(r[2]) for r in got) == [1, len(body)]
