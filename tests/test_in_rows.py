"""What is counted and matched where it stands: same results as the longer way, and nothing shuffled or broadcast for it."""

import re
from collections import Counter

from pyspark.sql import functions as F

from lexispark.operators import languages, matching, models, scoring, tokens
from lexispark.plans import derived as t

TAG = "model string, class string, tag string, is_regex boolean, lang string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_counted_in_their_row(spark, tmp_path):
    texts = [(1, "B a b, a A"), (2, ""), (3, None), (4, "one"), (4, "One two"), (5, "12 --")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.file_id, r.token): r.cnt for r in t.token_count(spark, str(tmp_path)).collect()}
    assert got == {(1, "a"): 3, (1, "b"): 2, (4, "one"): 2, (4, "two"): 1}
    each = tokens.counted(df, ["doc_id"], F.split(F.lower("text"), "[^a-z]+", -1))
    assert Counter((r.doc_id, r.token, r.cnt) for r in each.collect()) == {(1, "a", 3): 1, (1, "b", 2): 1, (4, "one", 1): 2, (4, "two", 1): 1}
    df.where("doc_id <> 4").write.parquet(f"{tmp_path}/once/documents.parquet")
    assert "hashpartitioning" not in plan(t.token_count(spark, f"{tmp_path}/once"))


def test_few_patterns_match_as_many_do(spark, monkeypatch):
    words = ["nation", "station", "xtion", "th'er", "that", "this", "keit", "a;bung", "abkeit", "(", "on", "", "zz", "l" * 201 + "ing"]
    hit = spark.createDataFrame([(i % 3, w, i) for i, w in enumerate(words)], "file_id int, token string, cnt int")
    patterns = [".{3,9}tion", "th(er|is|at)", ".{2,8}(ung|keit)", ".*ing", "[a-z]{2}", "(", r"\(|zz"]
    tag = spark.createDataFrame([("M", str(i), p, True, "" if i % 2 else "eng") for i, p in enumerate(patterns)] + [("M", "x", "on", False, ""), ("N", "y", "this", False, "eng")], TAG)
    lang = spark.createDataFrame([(0, "eng"), (1, "deu"), (1, "eng"), (2, "")], "file_id int, lang string")
    few = matching.matches(hit, tag, lang)
    assert "Exchange hashpartitioning(token" not in plan(matching.matches(hit, tag))
    few = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(matching, "FEW", 0)
    assert few == sorted(map(tuple, matching.matches(hit, tag, lang).collect())) and len(few) > 8


def test_grams_are_weighed_where_they_stand(spark, tmp_path):
    profile = spark.createDataFrame([("eng", " th", 9), ("eng", "the", 8), ("deu", "der", 9), (None, "xyz", 3)], "lang string, gram string, freq long")
    profile.write.parquet(f"{tmp_path}/profile")
    profile = spark.read.parquet(f"{tmp_path}/profile")
    texts = spark.createDataFrame([(1, "the the"), (2, "der"), (3, "xyz"), (4, None)], "id int, text string")
    found = languages.detected(texts, ["id"], profile)
    assert [(r.id, r.lang) for r in found.where("prob > 0.5").orderBy("id").collect()] == [(1, "eng"), (2, "deu")]
    assert not re.search(r"hashpartitioning\(id#\d+L?, gram#|SortMergeJoin \[gram#", plan(found))
    assert [tuple(r) for r in languages.most_probable(found, ["id"]).orderBy("id").select("id", "lang").collect()] == [(1, "eng"), (2, "deu")]


def test_changed_matches_are_not_broadcast(spark, tmp_path):
    """Their files are small and their rows large: a broadcast by the files' sizes would fill the driver."""
    hit = spark.createDataFrame([(f, w, 1) for f in range(20) for w in ("the", "la", "der")], "file_id int, token string, cnt int")
    old = spark.createDataFrame([("A", "x", "the", False, ""), ("B", "x", "la", False, ""), ("B", "y", "la", False, "")], TAG)
    new = spark.createDataFrame([("A", "x", "the", False, ""), ("C", "x", "der", False, "")], TAG)
    kept = lambda df, name: (df.write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    hit = kept(hit, "hit")
    found = kept(matching.matches(hit, old), "found")
    dropped, added = (kept(x, n) for x, n in zip(models.changed_matches(hit, found, old, new), ("dropped", "added"), strict=True))
    scored = kept(scoring.scores(hit, found), "scored")
    now = scoring.rescored(scored, hit, found, dropped, added)
    text = plan(now)
    assert not [x for x in text.split("\n") if "BroadcastHashJoin" in x and "token" in x]
    whole = scoring.scores(hit, matching.matches(hit, new)).select(*now.columns)
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, whole.collect()))
