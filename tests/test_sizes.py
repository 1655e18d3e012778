"""Steps whose work must grow no faster than their input: what they read once, and what they join on."""

import re
import string

import pytest
from pyspark.sql import functions as F

from lexispark.functions import patterns
from lexispark.operators import handlers, matching, roles, tokens
from lexispark.plans import catalogue
from lexispark.plans import derived as t

TAG = "model string, class string, tag string, is_regex boolean, lang string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_begins_and_ends_of_patterns():
    want = {"na[a-z]ion": ("na", "ion"), ".*tion": ("", "tion"), "ab.*": ("ab", ""), "a(b|c)d": ("a", "d"), "ab|cd": ("", ""), "abc*": ("ab", ""), "a+b": ("", "b"), "(?i)ab.*": ("", ""), r"^x\.y.$": ("x.y", ""), "a{2}b.c": ("", "c")}
    assert {p: patterns.known(p)[2:] for p in want} == want


def test_patterns_with_ends_meet_only_tokens_of_these(spark):
    words = [a + b + c for a in ("na", "sta", "x") for b in string.ascii_lowercase for c in ("ion", "ions", "l" * 7)] + ["na", "ion", "naion", "n" * 300 + "ion", "a'b;ion", ""]
    tags = ["na[a-z]ion", "sta.*lllllll", ".*ions", "x.*", ".{2}q.*", "(na|x)[^a]ion", "na.?ion", "ab[a-z]?ion|xaion", "[a-z]+"]
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    tag = spark.createDataFrame([(x, True) for x in tags], "tag string, is_regex boolean")
    index = matching.pattern_index(tag)
    got = {tuple(r) for r in matching._indexed(tokens, index).collect()}
    assert got == {(w, p) for w in words for p in tags if re.fullmatch(p, re.sub("[',;]", "", w))}
    plain = tokens.withColumn("_t", F.col("token"))
    met = matching._by_ends(plain, index.where("tag = 'na[a-z]ion'").select("tag", "begin", "end"))
    assert {r.token for r in met.collect()} == {w for w in words if w.startswith("na") and w.endswith("ion")}


def test_few_tags_meet_the_hits_in_one_pass(spark, tmp_path):
    spark.createDataFrame([(f, w, 1) for f in range(9) for w in ("the", "nation", "x'ung", "la", "this")], "file_id long, token string, cnt long").write.parquet(f"{tmp_path}/hit")
    hit = spark.read.parquet(f"{tmp_path}/hit")
    tag = t.tag_dict(spark)
    found = matching.matches(hit, tag)
    assert len(re.findall(r"FileScan parquet \[file_id", plan(found))) == 1
    both = matching.literal_matches(hit, tag).unionByName(matching.regex_matches(hit, tag)).select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, both.collect())) and found.count() == 9 * 6
    literal = spark.createDataFrame([("M", "c", "la", False, ""), ("M", "c", None, False, ""), ("M", "d", "(", True, "")], TAG)
    assert {(r.token, r.kind) for r in matching.matches(hit, literal).collect()} == {("la", "tag")}
    assert matching.matches(hit, literal.limit(0)).count() == 0


def test_roles_count_a_columns_values_once(spark, tmp_path):
    rows = [(1, i, c, v) for i in range(120) for c, v in enumerate((str(i + 1), "NOUN" if i % 3 else "VERB", "a=b|c" if i < 100 else "x", "p-q-r", "w%d" % i, "a+b" if i < 3 else "z", None))]
    spark.createDataFrame(rows, "file_id long, row_no int, col int, value string").write.parquet(f"{tmp_path}/cell")
    cell = spark.read.parquet(f"{tmp_path}/cell")
    tag = spark.createDataFrame([("M", "N", "NOUN", False, ""), ("M", "V", "VERB", False, "")], TAG)
    found = handlers.column_roles(cell, cell.where("col = 0").groupBy("file_id").agg(F.count("*").alias("rows")), tag)
    text = plan(found)
    assert {r.col: r.role for r in found.collect()} == {0: "index", 1: "pos", 2: "feature", 3: "pattern", 4: "text", 5: "pattern", 6: "free"}
    # a column's distinct values are read for three roles; cells only for the index and the patterns
    assert len(re.findall(r"FileScan parquet \[[^\]]*row_no", text)) <= 2
    assert "NestedLoop" not in plan(roles.pattern_columns(cell))
    parts = {(r.col, r.delimiter, r.n) for r in roles.pattern_columns(cell).collect()}
    assert parts == {(3, "-", 120), (5, "+", 3)}


def test_tokens_are_told_apart_before_they_are_counted(spark, tmp_path):
    texts = [(1, "The nation, the THE station on la"), (1, "la la xung"), (2, "on on"), (3, ""), (4, None), (None, "die 12 die, hoffnung")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tag, d = t.tag_dict(spark), str(tmp_path)
    some = t.token_count(spark, d, tag)
    # what goes is gone before the first exchange and before the counts, and each text is split once
    assert plan(some).count("split(") == 1 and "_words" not in plan(some)
    got = {(r.file_id, r.token): r.cnt for r in some.collect()}
    assert got == {(1, "the"): 3, (1, "nation"): 1, (1, "station"): 1, (1, "la"): 3, (1, "xung"): 1, (None, "die"): 2, (None, "hoffnung"): 1}
    every = matching.matches(t.token_count(spark, d), tag)
    assert sorted(map(repr, matching.matches(some, tag).collect())) == sorted(map(repr, every.select(*matching.matches(some, tag).columns).collect()))


def test_dictionaries_whose_tokens_all_need_a_look(spark):
    hit = spark.createDataFrame([(1, "l'a;", 1), (1, "xyz", 1), (1, "nation", 1), (1, None, 1)], "file_id int, token string, cnt int")
    tags = lambda *rows: spark.createDataFrame([("M", "c", x, r, "") for x, r in rows], TAG)
    assert matching.may_match(tags(("[a-z]+", True))) is None
    assert matching.may_match(tags(*((f"w{i}", False) for i in range(matching.FEW + 1)))) is None
    kept = lambda tag: [r.token for r in hit.where(matching.may_match(tag)).collect()]
    assert kept(tags(("la", False), (".*tion", True))) == ["l'a;", "nation"]
    assert kept(tags(("la", False)).limit(0)) == [] and kept(tags((None, False), ("(", True))) == []


@pytest.mark.parametrize("name", ["model_updated", "new_matches_only", "rescored_models"])
def test_only_tokens_that_may_match_are_counted(spark, monkeypatch, name):
    monkeypatch.setattr(tokens, "counted", None)
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
