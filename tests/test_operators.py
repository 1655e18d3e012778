"""Edge rows that the tables don't hold."""

import pytest

from pyspark.sql import functions as F

from lexispark.functions.columns import full_match
from lexispark.operators import graph, languages, lifecycle, matching, metadata, models, observations, registry, roles, scoring, search, xmltools
from lexispark.plans.durable import written
from lexispark.sources import rdf, readers
from lexispark.streaming import queue


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_full_match_is_anchored(spark):
    df = spark.createDataFrame([("NN",), ("NNS",), ("",)], "t string")
    assert rows(df.where(full_match(df.t, "N+")), "t") == [("NN",)]


def test_matching_strips_quotes_and_survives_bad_patterns(spark):
    hit = spark.createDataFrame([(1, "it's", 2), (1, "a.b", 1), (1, "", 1), (1, "NN,", 3)], "file_id int, token string, cnt int")
    tag = spark.createDataFrame([("M", "C", "its", False, ""), ("M", "C", "N(", True, ""), ("M", "C", "N+", True, "")], "model string, class string, tag string, is_regex boolean, lang string")
    found = matching.matches(hit, tag)
    assert rows(found.select("token", "tag"), "token") == [("NN,", "N+"), ("it's", "its")]


def test_scores_count_a_node_once_by_its_largest_hit(spark):
    hit = spark.createDataFrame([(1, "x", 5), (1, "y", 3), (1, "z", 1)], "file_id int, token string, cnt int")
    found = spark.createDataFrame([(1, "x", 5, "M", "C", "n1"), (1, "y", 3, "M", "C", "n1"), (1, "y", 3, "N", "C", "n2")], "file_id int, token string, cnt int, model string, class string, tag string")
    got = rows(scoring.scores(hit, found), "model")
    assert got == [(1, "M", 1, 1, 5, 5, 0.333333), (1, "N", 1, 0, 3, 0, 0.333333)]


def test_best_prefers_manual_selection_and_breaks_ties_by_name(spark):
    columns = "file_id int, model string, coverage double, exclusive_hit_types int, hit_count_total int, exclusive_hit_count_total int, method string, selected boolean, trivial boolean"
    m = spark.createDataFrame(
        [(1, "B", 0.5, 1, 1, 1, "AUTO", True, False), (1, "A", 0.5, 1, 1, 1, "AUTO", True, False), (2, "A", 0.9, 1, 1, 1, "AUTO", True, False), (2, "M", 0.0, 0, 0, 0, "MANUAL", True, True), (3, "X", 0.9, 1, 1, 1, "MANUAL", False, False), (4, "T", 0.9, 1, 1, 1, "AUTO", True, True)],
        columns,
    )
    assert rows(scoring.best_per(m, ["file_id"]).select("file_id", "model"), "file_id") == [(1, "A"), (2, "M")]


def test_sentences_start_where_the_index_falls(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, None), (1, 3, 1), (1, 4, 1)], "file_id int, row_no int, idx int")
    assert rows(roles.sentences(df).select("row_no", "sent_no"), "row_no") == [(0, 0), (1, 0), (3, 1), (4, 2)]


def test_pools_of_sentences_take_whole_ones_and_none_twice(spark):
    df = spark.createDataFrame([(1, s, s * 10 + i) for s, n in enumerate([2, 3, 1, 5, 1]) for i in range(n)], "file_id int, sent_no long, row_no int")
    assert rows(roles.sentence_pools(df, 4).select("sent_no", "pool"), "sent_no") == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]


def test_feature_counts_drop_blanks_and_second_values(spark):
    df = spark.createDataFrame([("Case=Nom|Number=Sing=x|bad|Gloss=No|e=",), ("_",)], "feats string")
    assert rows(roles.feature_counts(df), "name") == [("Case", "Nom", 1), ("Number", "Sing", 1)]


def test_numeric_columns_are_left_out(spark):
    df = spark.createDataFrame([(1, 0, str(i)) for i in range(101)] + [(1, 1, "a: b ::")], "file_id int, col int, value string")
    assert rows(roles.column_tokens(df), "token") == [(1, 1, "a", 1), (1, 1, "b", 1)]


def test_triples(spark):
    lines = [("<a> <p> <b> .",), ('_:x <p> "q\\"t\\n"@en-GB <g> .',), ('<a> <p> "1"^^<int> . # c',), ("# remark",), ("",), ("nonsense",)]
    got = readers.parse_triples(spark.createDataFrame(lines, "value string")).collect()
    assert [(r.s, r.o, r.o_kind, r.o_lang, r.o_type, r.corrupt) for r in got] == [("a", "b", "uri", None, None, None), ("_:x", 'q"t\n', "literal", "en-GB", "", None), ("a", "1", "literal", "", "int", None), (None, None, None, None, None, "nonsense")]


def test_conll_reader_needs_and_cuts_rows(spark, tmp_path):
    (tmp_path / "a.conll").write_text("# c\n" + "\n".join(f"{i}\tw{i}" for i in range(5)) + "\n\n")
    (tmp_path / "b.conll").write_text("1\tx\n")
    got = readers.conll(spark, str(tmp_path), least=3, most=4)
    assert rows(got.select("row_no", "col", "value"), "row_no", "col")[-1] == (3, 1, "w3") and got.count() == 8


def test_seeds_and_listing(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("@http://a.example/x\thttp://m.example\nhttp://b.example\nnot a url\n")
    assert rows(readers.url_seeds(spark, str(tmp_path)), "url") == [("http://a.example/x", "http://m.example", False), ("http://b.example", "", True)]
    assert readers.file_listing(spark, str(tmp_path)).first().name == "s.tsv"


def test_damaged_xml_keeps_what_is_before(spark):
    df = spark.createDataFrame([(1, "<a x='1'><b>t</b><c"), (2, None), (3, "<n:a xmlns:n='u'/>")], "file_id long, xml string")
    got = [(r.file_id, r.path, r.attr, r.value) for r in readers.xml_overview(df).where("attr <> 'xmlns:n'").orderBy("file_id", "node_no", "attr").collect()]
    assert got == [(1, "/a", "", ""), (1, "/a", "x", "1"), (1, "/a/b", "", ""), (1, "/a/b", "text()", "t"), (3, "/a", "", "")]


def test_sampling_stops_counting(spark):
    df = spark.createDataFrame([(0, "p", "a"), (1, "p", "b"), (2, "p", "a"), (3, "p", "c")], "at int, p string, o string")
    assert rows(observations.sampled_object_counts(df, 2, "at"), "o") == [("p", "a", 1), ("p", "b", 1)]


def test_reconciled_states(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k int, v string")
    assert rows(lifecycle.reconciled(old, new, ["k"], ["v"]), "k") == [(1, "a", "dropped"), (2, "x", "changed"), (3, None, "same"), (4, "d", "added")]


def test_empty_tables(spark):
    facet = spark.createDataFrame([], "url string, value string, selected boolean")
    assert search.all_of(facet, ["a"]).count() == 0 and search.inverted_index(facet, "value", "url").count() == 0


def test_stream_of_requests(spark, tmp_path):
    rows_ = spark.createDataFrame([(1, 1, "view"), (2, 1, "view"), (3, 2, "error")], "event_id int, user_id int, event_type string")
    rows_.write.parquet(str(tmp_path / "in"))
    q = queue.run(queue.intake(spark, str(tmp_path / "in"), rows_.schema), queue.first_requests, str(tmp_path / "out"), str(tmp_path / "check"))
    assert q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("user_id", "event_id"), "user_id") == [(1, 1), (2, 3)]


def test_literals_are_unescaped_once_from_left_to_right(spark):
    body = r'"C:\\new\t\u00e9\U0001F600\"q\""'
    got = readers.parse_triples(spark.createDataFrame([(f"<a> <p> {body} <g> .",)], "value string")).first()
    assert (got.o, got.g) == ('C:\\new\té\U0001F600"q"', "g")


@pytest.mark.parametrize(
    ("page", "href", "url"),
    [
        ("http://a.b/c/d.html?x#y", "e.txt", "http://a.b/c/e.txt"), ("http://a.b/c/d", "../e", "http://a.b/e"), ("http://a.b/c/d", "./e/../f/", "http://a.b/c/f/"), ("http://a.b", "e", "http://a.b/e"),
        ("https://a.b/c", "//x.y/z", "https://x.y/z"), ("http://a.b/c/d", "/e?q=/../", "http://a.b/e?q=/../"), ("http://a.b/c/d", "?q", "http://a.b/c/d?q"), ("http://a.b/c/d", "#f", "http://a.b/c/#f"),
        ("http://a.b/c", "mailto:x@y", "mailto:x@y"), ("http://a.b/c/d/", "../../../e", "http://a.b/e"),
    ],
)
def test_links_are_resolved(spark, page, href, url):
    df = spark.createDataFrame([(page, href)], "page string, href string")
    assert df.select(readers.resolved(df.href, df.page).alias("u")).first().u == url


def test_links_of_any_quotes_and_references(spark):
    html = "<a href=x.html>1</a><A class='k' HREF = \"y?a=1&amp;b=2\">2</A><a name=z>"
    got = readers.html_links(spark.createDataFrame([(1, "http://a.b/c/", html)], "page_id int, url string, html string"))
    assert rows(got.select("url", "is_file"), "url") == [("http://a.b/c/x.html", True), ("http://a.b/c/y?a=1&b=2", False)]


def test_patterns_meet_tokens_by_their_plain_ends(spark):
    patterns = ["ab.*", "abc?d", ".*ing", "x|yz", "(a|b)c", "a(b|c)", r"\d", r"v\w+s", "[ab]c", "a{2}b", "(?i)QED", "abcdefgh.", ".", "q*", "un.*ly"]
    tokens = ["abz", "abd", "abcd", "sing", "x", "yz", "ac", "ab", "7", "d", "vows", "bc", "aab", "qed", "abcdefghi", "", "qq", "unduly"]
    hit = spark.createDataFrame([(1, x, 1) for x in tokens], "file_id int, token string, cnt int")
    tag = spark.createDataFrame([("M", "C", p, True, "") for p in patterns], "model string, class string, tag string, is_regex boolean, lang string")
    import re

    want = sorted((x, p) for x in tokens for p in patterns if re.fullmatch(p, x))
    assert rows(matching.regex_matches(hit, tag).select("token", "tag"), "token", "tag") == want


def test_patterns_found_by_their_texts_are_those_of_a_plain_full_match(spark, monkeypatch):
    import random

    monkeypatch.setattr(matching, "LONG", 6)

    rng = random.Random(5)
    pieces = ["a", "b", "ab", "cab", ".", ".*", "[ab]", "[^a]", r"\(", r"\.", r"[(|]", "a?", "b+", "c{2}", "(?:b{0,2})", r"\w", r"\d*", "(?=c)", "^", "$", r"\Qa.b\E", "[a-c]", "[a-z]", "(?i)", "(?<n>b)", r"\x61", "é", "[a-c&&[b]]", "[]a]", "\\p{L}", "{", "}", "x{1}", "(ab|c){2}", r"(a)\1"]

    def made(depth):
        out = "".join(rng.choice(pieces) if depth == 0 or rng.random() < 0.7 else f"({made(depth - 1)})" + rng.choice(["", "*", "?", "+", "{2}", "{0,1}", "??"]) for _ in range(rng.randrange(1, 5)))
        return out + ("|" + made(depth) if rng.random() < 0.25 else "")

    patterns = sorted({made(2) for _ in range(1500)} | {r"N\(x|V", "(", "a**", "", "|"})
    tokens = sorted({"".join(rng.choice("abc(.|éxV1") for _ in range(rng.randrange(7))) for _ in range(400)} | {"N(x", "V", "a.b", "cab" * 3})
    hit = spark.createDataFrame([(x,) for x in tokens], "token string")
    tag = written(matching.valid_patterns(spark.createDataFrame([(p, True) for p in patterns], "tag string, is_regex boolean")))
    want = written(hit.join(tag.select("tag")).where(full_match(F.col("token"), F.col("tag"))).select("token", "tag"))
    got = written(matching.pattern_tokens(hit, tag))
    assert got.count() > 2000 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    kinds = dict(matching.pattern_index(tag).groupBy("kind").agg(F.countDistinct("tag")).collect())
    assert min(kinds["whole"], kinds["part"]) > 50


def test_long_texts_do_not_overflow_the_stack(spark):
    n = 1_000_000
    line = '<http://a> <http://b> "' + "x\\n" * n + '" .'
    got = readers.parse_triples(spark.createDataFrame([(line,), ('<http://a> <http://b> "' + "x" * 10 * n + '"@en .',)], "value string"))
    assert sorted(r[0] for r in got.select(F.length("o")).collect()) == [2 * n, 10 * n]
    cells = spark.createDataFrame([(1, i, 0, "a-" * n + "a") for i in range(3)], "file_id int, row_no int, col int, value string")
    assert roles.pattern_columns(cells).select("delimiter").collect() == [("-",)]
    page = spark.createDataFrame([(1, "http://a.b/", f"<a href='http://x{'/y' * n}/z.txt'>")], "page_id int, url string, html string")
    assert [r[0] for r in readers.html_links(page).select("is_file").collect()] == [True]
    hit = spark.createDataFrame([("ab" * n,), ("ab",)], "token string")
    tag = spark.createDataFrame([("(ab)*+", True), ("a.*b", True), ("ab|x", True)], "tag string, is_regex boolean")
    assert matching.pattern_tokens(hit, tag).groupBy("tag").count().collect().__len__() == 3


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    (tmp_path / "b.txt").write_text("# no\nx\t1\n\ny\t2\n" * 60)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = readers.numbered_lines(spark, f"{tmp_path}/a.txt").collect()
        assert sorted((r["line_no"], r["value"]) for r in got) == [(i, f"line {i}") for i in range(500)]
        for most, n in ((-1, 120), (50, 50)):
            cells = readers.conll(spark, f"{tmp_path}/b.txt", least=100, most=most).collect()
            assert sorted((r["row_no"], r["col"], r["value"]) for r in cells) == sorted((i, c, ("x", "1", "y", "2")[i % 2 * 2 + c]) for i in range(n) for c in (0, 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("limits", [(3, 4, 6, 5), (50, 2, 90, 1), (1, 0, 1, 0), (500, 500, 500, 1)])
def test_folders_stop_as_if_read_file_by_file(spark, limits):
    import random

    rng = random.Random(4)
    good, bad, most, least = limits
    files = [(f, f"{i:04}", rng.random() < 0.7) for f, n in (("big", 300), ("small", 4), ("mid", 20)) for i in range(n)]
    want = []
    for folder in ("big", "small", "mid"):
        own, g, b = [x for x in files if x[0] == folder], 0, 0
        for x in own:
            if len(own) < least or not (g >= good or b > bad or g + b >= most):
                want.append(x)
            g, b = g + x[2], b + (not x[2])
    got = observations.folder_sample(spark.createDataFrame(files, "folder string, path string, good boolean").repartition(3), good, bad, most, least).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_posting_lists_are_of_bounded_size_and_meet(spark):
    pairs = spark.range(1000).selectExpr("explode(array('all', if(id % 3 = 0, 'third', 'all'), if(id % 5 = 0, 'fifth', 'all'))) AS tag", "id")
    lists = search.posting_lists(pairs, "tag", "id", 64)
    assert lists.where("key = 'all'").count() == 16 and lists.agg(F.max("n")).first()[0] == 64
    assert rows(search.holding(lists, ["all", "third", "fifth"], 64), "value") == [(i,) for i in range(0, 1000, 15)]
    assert search.holding(lists, ["all", "none"], 64).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_scores_from_changes_are_those_of_all_matches(spark, seed):
    import random

    rng = random.Random(seed)
    hits = [(f, f"t{i}", rng.randrange(1, 9)) for f in range(6) for i in range(8)]
    schema = "file_id int, token string, cnt int, model string, class string, tag string"
    every = sorted({(*rng.choice(hits), rng.choice("MN"), "c", rng.choice("xyz")) for _ in range(90)})
    before = {m for m in every if rng.random() < 0.7}
    dropped = {m for m in before if rng.random() < 0.2 and m[0] < 4} | {m for m in before if m[0] == 0}
    added = {m for m in every if m not in before and m[0] in (1, 2, 5)}
    frame = lambda x: spark.createDataFrame(sorted(x), schema)
    hit = spark.createDataFrame(hits, "file_id int, token string, cnt int")
    got = scoring.rescored(scoring.scores(hit, frame(before)), hit, frame(before), frame(dropped), frame(added))
    want = scoring.scores(hit, frame((before - dropped) | added)).select(*got.columns)
    assert rows(got, "file_id", "model") == rows(want, "file_id", "model") and want.count() > 5
    same = scoring.rescored(want, hit, frame(before), frame(before).limit(0), frame(before).limit(0))
    assert rows(same, "file_id", "model") == rows(want, "file_id", "model")


def test_formats_by_content(spark):
    from lexispark.functions.columns import format_by_content

    n = 300_000
    want = [
        (b"", "UNKNOWN"), (b" \n", "UNKNOWN"), (b"PK\x03\x04xx", "ARCHIVE"), (b"\x1f\x8b\x08", "ARCHIVE"), (b"a" * 257 + b"ustar\x00", "ARCHIVE"), (b"%PDF-1.7", "PDF"), (b"\x00\x01\x02", "UNKNOWN"),
        (b"\xef\xbb\xbf<?xml version='1.0'?><a/>", "XML"), (b"<a b='c'>" + b"x" * n, "XML"), (b"<!DOCTYPE x [<!ENTITY a 'b'>]><x>", "XML"), (b"<html>", "HTML"), (b"<!doctype HTML>", "HTML"), (b"<!-- " + b"- " * n, "TEXT"), (b"<TriX xmlns='x'>", "RDF"),
        (b"<http://a> <http://b> <http://c> .\n", "RDF"), (b"_:a <http://b> \"" + b"x" * 1000 + b"\" .", "RDF"), (b"#c\n\n#d\nPREFIX a: <b>", "RDF"), (b"<RDF xmlns='x'>", "RDF"), (b"{\"@id\": 1}", "RDF"), (b"[1, 2]", "JSON"),
        (b"1\ta\n2\tb\n3\tc\n", "CONLL"), (b"1\ta\tb\n" * n, "CONLL"), (b"1\ta\n2\tb\tc\n3\tc\n", "TEXT"), (b"1\ta\n2\tb\n", "TEXT"), ("été".encode() * n, "TEXT"), (b"caf\xe9 latin", "TEXT"), (b"a < b", "TEXT"), (b"[" * n, "JSON"), (b"#" * n, "TEXT"), (b"\n" * n, "UNKNOWN"),
    ]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(want)] + [(99, None)], "i int, c binary")
    got = {r["i"]: r["f"] for r in df.select("i", format_by_content(df.c).alias("f")).collect()}
    assert got == {i: f for i, (_, f) in enumerate(want)} | {99: None}


def test_shortest_paths_have_an_edge_and_pass_no_node_twice(spark):
    edge = spark.createDataFrame([("a", "b"), ("b", "t"), ("a", "c"), ("c", "t"), ("t", "u"), ("u", "t"), ("t", "a"), ("z", "z")], "src string, dst string")
    got = rows(graph.shortest(edge, spark.createDataFrame([("t",), ("b",)], "node string")), "src")
    assert got == [("a", "b", ["a", "b"]), ("b", "t", ["b", "t"]), ("c", "t", ["c", "t"]), ("t", "b", ["t", "a", "b"]), ("u", "t", ["u", "t"])]


def test_nodes_of_one_tag_and_two_classes_count_twice(spark):
    hit = spark.createDataFrame([(1, "x", 5)], "file_id int, token string, cnt int")
    found = spark.createDataFrame([(1, "x", 5, "M", "C", "x"), (1, "x", 5, "M", "D", "x")], "file_id int, token string, cnt int, model string, class string, tag string")
    assert rows(scoring.scores(hit, found), "model") == [(1, "M", 2, 0, 10, 0, 2.0)]


def test_elements_are_chosen_greedily(spark):
    values = {("/a", "x"): "123456", ("/b", "x"): "56789", ("/c", "x"): "12", ("/b", "y"): "z", ("/d", "u"): ["http://a/1", "http://a/2"], ("/e", "k"): ["long", "one"]}
    overview = [(1, 0, p, a, v + "v" if a == "x" else v) for (p, a), vs in values.items() for v in vs]
    df = spark.createDataFrame(overview, "file_id long, node_no int, path string, attr string, value string")
    assert rows(xmltools.chosen_elements(df, written), "path", "attr") == [("/a", "x"), ("/b", "x"), ("/b", "y"), ("/e", "k")]
    assert xmltools.chosen_elements(df.limit(0), written).count() == 0


def test_languages_of_mixed_texts(spark):
    texts = spark.createDataFrame([("eng", "the thing that they think " * 9), ("deu", "der die das und nicht ungen " * 9)], "lang string, text string")
    profile = languages.profiles(texts)
    df = spark.createDataFrame([(1, "they think"), (2, "und nicht das"), (3, "12 ..."), (4, None)], "id int, text string")
    assert rows(languages.best(languages.detected(df, ["id"], profile), ["id"]), "id") == [(1, "eng"), (2, "deu")]


def test_language_strings(spark):
    df = spark.createDataFrame([('"en",de',), ("http://lexvo.org/id/iso639-3/fra; ES-mx",), (None,), ("Old English, x",)], "t string")
    assert [r.c for r in df.select(metadata.language_codes(df.t).alias("c")).collect()] == [["en", "de"], ["fra", "es"], None, []]


def test_headers_without_fields_have_defaults(spark):
    df = spark.createDataFrame([("HTTP/1.0 404 Not Found\r\ncontent-length: x\r\n",), ("",)], "t string")
    assert [tuple(r) for r in df.select(*registry.header(F.col("t")).values()).collect()] == [(404, 0, "", "", ""), (0, 0, "", "", "")]


def test_selections_are_left_where_none_would_stay(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "a", True), (2, "b", False)], "g int, k string, selected boolean")
    wish = spark.createDataFrame([(1, "a"), (2, "a")], "g int, k string")
    assert rows(registry.deselected(df, wish, ["g"], "k"), "g", "k") == [(1, "a", False), (1, "b", True), (2, "a", True), (2, "b", False)]


def test_updated_dictionaries_match_only_what_is_new(spark):
    form = "model string, class string, tag string, is_regex boolean, lang string"
    hit = spark.createDataFrame([(1, "x", 2), (1, "y", 1)], "file_id int, token string, cnt int")
    old, new = spark.createDataFrame([("M", "C", "x", False, ""), ("M", "C", "y", False, "")], form), spark.createDataFrame([("M", "C", "x", False, ""), ("N", "D", "y", False, "")], form)
    got = models.updated(hit, matching.matches(hit, old), old, new)
    assert rows(got.select("token", "model"), "token") == [("x", "M"), ("y", "N")]


def test_json_ld_names_and_rdf_xml_spaces(spark, tmp_path):
    (tmp_path / "a.jsonld").write_text('{"@context": {"@vocab": "http://v/", "n": "http://n/name"}, "@id": "http://s", "@type": "T", "n": ["x", {"@value": "y", "@language": "de"}], "k": {"@id": "http://o"}}\nbroken\n')
    got = rows(rdf.read(spark, str(tmp_path / "a.jsonld"), "jsonl").select("p", "o", "o_kind", "o_lang"), "p", "o")
    assert got == [("http://n/name", "x", "literal", ""), ("http://n/name", "y", "literal", "de"), ("http://v/k", "http://o", "uri", ""), (rdf.RDF + "type", "http://v/T", "uri", "")]
    (tmp_path / "b.rdf").write_text('<rdf:RDF xmlns:rdf="r#" xmlns:d="http://d/">\n<rdf:Description rdf:about="s1"><d:t>a &amp; b</d:t></rdf:Description>\n<rdf:Description rdf:nodeID="n"><d:u rdf:resource="o"/></rdf:Description></rdf:RDF>')
    assert rows(rdf.read(spark, str(tmp_path / "b.rdf"), "rdf-records").select("s", "p", "o", "o_kind"), "s") == [("_:n", "http://d/u", "o", "uri"), ("s1", "http://d/t", "a & b", "literal")]


def test_stream_of_commands_keeps_states_across_batches(spark, tmp_path):
    form = "request string, action string, ts int"
    parts = [[("a", "queue", 1), ("b", "queue", 1), ("c", "start", 1)], [("a", "cancel", 2), ("b", "start", 2), ("b", "cancel", 3)], [("b", "done", 4), ("a", "queue", 5), ("d", "queue", 5)]]
    checkpoint = str(tmp_path / "check")
    for part in parts:
        spark.createDataFrame(part, form).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = queue.tracked(spark.readStream.schema(form).parquet(str(tmp_path / "in")))
        seen = []
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n, seen=seen: seen.extend(df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    assert sorted((r.request, r.state, r.changes) for r in seen) == [("a", "QUEUED", 3), ("b", "DONE", 3), ("d", "QUEUED", 1)]
    whole = queue.tracked_all(spark.createDataFrame([x for p in parts for x in p], form), ["ts"])
    assert rows(whole, "request") == [("a", "QUEUED", 3), ("b", "DONE", 3), ("c", "", 0), ("d", "QUEUED", 1)]


@pytest.mark.parametrize("hidden", ["lexispark.llm", "corpus_pipeline"])
def test_nothing_else_imports_the_corpus_operators(hidden):
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for f in [*root.glob("lexispark/**/*.py"), root / "bench.py"]:
        if "llm" not in f.parts:
            assert hidden not in f.read_text()
