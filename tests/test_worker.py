"""Files told apart by name and content, and handed to the handler of their format."""

import json

from lexispark.operators import worker
from lexispark.plans.durable import written

TAGS = [("M", c, c, False, "") for c in ("NOUN", "VERB", "DET")] + [("L", "Latin", "verbum", False, "")]
P = "http://x.example/pos"
VALUES = ["NOUN", "VERB", "DET", "NOUN"]
NT = "".join(f'<http://x.example/{i}> <{P}> "{v}" .\n' for i, v in enumerate(VALUES))
RDF_XML = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x.example/">' + "".join(f'<rdf:Description rdf:about="http://x.example/{i}"><x:pos>{v}</x:pos></rdf:Description>' for i, v in enumerate(VALUES)) + "</rdf:RDF>"
JSON_LD = json.dumps({"@graph": [{"@id": f"http://x.example/{i}", P: v} for i, v in enumerate(VALUES)]})
TABLE = "# a remark\n" + "".join(f"{i}\tw{i}\t{v}\n" for i, v in enumerate(VALUES)) + "\n"
XML = "<t>" + "<s>" + "".join(f'<w pos="{v}">w</w>' for v in VALUES) + "</s></t>"
KINDS = "file_id long, folder string, path string, media_type string, content binary"


def files(spark, contents):
    rows = [(i, folder, f"file:///a/{path}", mime, None if c is None else bytearray(c if isinstance(c, bytes) else c.encode())) for i, (folder, path, mime, c) in enumerate(contents)]
    return spark.createDataFrame(rows, KINDS), spark.createDataFrame(TAGS, "model string, class string, tag string, is_regex boolean, lang string")


def test_each_file_goes_to_its_handler(spark):
    contents = [("a", "x.nt", "", NT), ("a", "noname", "", NT), ("a", "x.rdf", "", RDF_XML), ("a", "y", "", JSON_LD), ("a", "x", "application/ld+json", JSON_LD), ("a", "x.conllu", "", TABLE), ("a", "t", "", TABLE)]
    contents += [("a", "x.xml", "", XML), ("a", "z", "", XML), ("a", "p", "", "<html><p>NOUN</p></html>"), ("a", "n", "", None), ("a", "e", "", ""), ("a", "b", "", b"\x00\xff\x01"), ("a", "d.nt", "", "nothing here\n" + NT), ("a", "w.nt", "", b"\xff\xfe"), ("a", "s.tsv", "", "1\ta\tNOUN\n"), ("a", "x2.xml", "", "<t><w pos='NOUN'>")]
    d, tag = files(spark, contents)
    got = {}
    for r in worker.results(d, tag, written, least_rows=3).collect():
        assert r.file_id not in got
        got[r.file_id] = (r.format, r.state, r.unit, r.model, r.coverage)
    ok = lambda form, unit: (form, "SUCCESS", unit, "M", 1.0)
    for i in (0, 1, 2, 3, 4, 13):
        assert got[i] == ok("RDF", P), i
    assert got[5] == got[6] == ok("CONLL", "2") and got[7] == got[8] == ok("XML", "pos")
    assert got[9][:3] == ("HTML", "ERROR", None) and got[10][1] == got[11][1] == got[12][1] == "ERROR"
    assert got[14] == ("RDF", "NONE", None, None, None) and got[15][:2] == ("CONLL", "NONE") and got[16][:2] == ("XML", "NONE")
    assert len(got) == len(contents)


def test_folders_stop_by_their_results(spark):
    contents = [("good", f"{i:03}.nt", "", NT) for i in range(12)] + [("bad", f"{i:03}.nt", "", "x") for i in range(12)] + [("small", f"{i}.nt", "", "x") for i in range(3)]
    d, tag = files(spark, contents)
    got = worker.archive(d, tag, written, good=4, bad=5, most=9, least=5, least_rows=3).collect()
    n = {f: sorted(r.file_id for r in got if r.folder == f) for f in ("good", "bad", "small")}
    assert n == {"good": [0, 1, 2, 3], "bad": list(range(12, 18)), "small": [24, 25, 26]}
    assert worker.first_files(d, 5).count() == 13
