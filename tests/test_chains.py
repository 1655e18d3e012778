"""XML turned into rows and read on as tables; models told by sequences of tags."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexispark.operators import conversion, sequences
from lexispark.plans.durable import written
from lexispark.sources import readers

TAGS = [("M", c, c, False, "") for c in ("NOUN", "VERB", "DET")] + [("M", "Any", "AD[JV]", True, "")]


def files(spark, texts):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "file_id long, xml string")
    tag = spark.createDataFrame(TAGS, "model string, class string, tag string, is_regex boolean, lang string")
    return readers.xml_overview(docs), docs.select("file_id", F.coalesce(F.octet_length("xml"), F.lit(0)).alias("bytes")), tag


def sentence(words, element="w", attr="pos"):
    return "<s>" + "".join(f'<{element} {attr}="{p}">{t}</{element}>' for t, p in words) + "</s>"


PAIRS = [("a", "DET"), ("b", "NOUN"), ("c", "VERB")]


def test_each_file_is_converted_as_its_markup_is(spark):
    texts = [
        "<t>" + sentence(PAIRS) * 2 + "</t>",  # regular
        "<t><s><w>a</w><w>b</w></s></t>",  # no attributes
        '<t><s><w id="NOUN">a</w><w id="VERB">b</w></s></t>',  # all values once
        "<t>" + (sentence(PAIRS) + sentence([(".", "ADJ")], "pc")) * 2 + "</t>",  # two word elements
        "<t>" + (sentence(PAIRS) + sentence([("z", "NOUN")], "pc")) * 2 + "</t>",  # one of them adds no value
        "<t>" + sentence([("a", "X1"), ("b", "X2")]) * 2 + "</t>",  # not in the dictionary
        '<t><s><w pos="NOUN" f="DET">a</w><w pos="NOUN" f="DET"/><w>c</w></s><s><w pos="VERB" f="">d</w></s></t>',  # values that lack
        '<w pos="NOUN"><w pos="NOUN">in</w><w pos="NOUN">out</w></w>',  # words in a word
        "<t>" + sentence(PAIRS) * 2,  # damaged
        "",
        None,
    ]
    how, cells = conversion.converted(*files(spark, texts), written)
    assert {r.file_id: (r.mode, r.converter, r.path) for r in how.collect()} == {
        0: ("FULL", "TEMPLATE", "/t/s/w"), 1: ("FULL", "NONE", None), 2: ("FULL", "NONE", None), 3: ("FULL", "GENERIC", None), 4: ("FULL", "TEMPLATE", "/t/s/w"), 5: ("FULL", "NONE", None),
        6: ("FULL", "TEMPLATE", "/t/s/w"), 7: ("FULL", "TEMPLATE", "/w/w"), 8: ("FULL", "TEMPLATE", "/t/s/w"), 9: ("FULL", "NONE", None), 10: ("FULL", "NONE", None),
    }
    got = collections.defaultdict(dict)
    for r in cells.collect():
        assert (r.row_no, r.col) not in got[r.file_id]
        got[r.file_id][r.row_no, r.col] = r.value
    table = lambda i: [[got[i][r, c] for c in sorted({c for _, c in got[i]})] for r in sorted({r for r, _ in got[i]})]
    regular = [[str(k + 1), t, p] for k, (t, p) in enumerate(PAIRS)]
    assert table(0) == regular * 2 and table(4) == regular * 2 and table(8) == regular * 2
    assert table(3) == (regular + [["1", ".", "ADJ"]]) * 2
    assert table(6) == [["1", "a", "DET", "NOUN"], ["2", "_", "DET", "NOUN"], ["3", "c", "_", "_"], ["1", "d", "_", "VERB"]]
    assert table(7) == [["1", "in", "NOUN"], ["2", "out", "NOUN"]]
    assert sorted(got) == [0, 3, 4, 6, 7, 8]


def test_large_files_give_whole_sentences_of_a_sample(spark):
    texts = ["<t>" + "".join(sentence([(f"w{i}", "NOUN"), (f"v{i}", "VERB")]) for i in range(30)) + "</t>", "<t>" + sentence(PAIRS) * 2 + "</t>"]
    overview, sizes, tag = files(spark, texts)
    how, cells = conversion.converted(overview, sizes, tag, written, most_bytes=500, sentences=7)
    assert {r.file_id: r.mode for r in how.collect()} == {0: "SAMPLE", 1: "FULL"}
    rows = sorted((r.row_no, r.value) for r in cells.where("file_id = 0 AND col = 1").collect())
    assert len(rows) == 14 and [n for n, _ in rows] == list(range(14))
    assert all(a[1] == "w" + b[1][1:] for a, b in zip(rows[::2], rows[1::2], strict=True))
    again = conversion.converted(overview.repartition(5), sizes, tag, written, most_bytes=500, sentences=7)[1]
    assert sorted(map(str, again.collect())) == sorted(map(str, cells.collect()))


def test_the_chain_names_the_attribute_of_each_model(spark):
    texts = ["<t>" + (sentence(PAIRS) + sentence([(".", "ADJ")], "pc")) * 4 + "</t>", "<t><s><w>a</w></s></t>"]
    overview, sizes, tag = files(spark, texts)
    _, cells = conversion.converted(overview, sizes, tag, written)
    assert [tuple(r) for r in conversion.chain(cells, tag, written).collect()] == [(0, 2, "pos", "M", 1.0)]
    _, none = conversion.converted(*files(spark, texts[1:]), written)
    assert conversion.chain(none, tag, written).count() == 0
    _, none = conversion.converted(overview.limit(0), sizes.limit(0), tag, written)
    assert none.count() == 0


def plain_ratings(rows, train):
    """{row: {model: score}} by going through each sequence with each model."""
    n, ends = collections.defaultdict(collections.Counter), set()
    for model, tags in train:
        if model is not None and tags:
            for a, b in zip([sequences.START, *tags], [*tags, sequences.END], strict=True):
                n[model][a, b] += 1
                ends.add(b)
    out = {}
    for key, tags in rows:
        if not tags:
            continue
        out[key] = {}
        for model, seen in n.items():
            sums = collections.Counter()
            for (a, _), c in seen.items():
                sums[a] += c
            path = list(zip([sequences.START, *tags], [*tags, sequences.END], strict=True))
            out[key][model] = sum(math.log((seen[p] + 0.1) / (sums[p[0]] + 0.1 * len(ends))) if sums[p[0]] else -math.log(len(ends)) for p in path)
    return out


def test_sequences_are_rated_as_a_plain_walk_rates_them(spark):
    rng = random.Random(3)
    train = [(m, [rng.choice(tags) for _ in range(rng.randrange(6))]) for m, tags in (("a", "xyz"), ("b", "xxw"), ("c", "q")) for _ in range(20)] + [(None, ["x"]), ("a", None)]
    rows = [(i, [rng.choice("xyzwq?") for _ in range(rng.randrange(7))]) for i in range(60)] + [(90, None), (91, ["?"] * 3000)]
    model = sequences.trained(spark.createDataFrame(train, "model string, tags array<string>"))
    seqs = spark.createDataFrame(rows, "id long, tags array<string>")
    got = collections.defaultdict(dict)
    for r in sequences.rated(seqs, ["id"], model).collect():
        got[r.id][r.model] = r.score
    want = plain_ratings(rows, train)
    assert set(got) == set(want)
    for key, scores in want.items():
        for m, score in got[key].items():
            assert score == pytest.approx(scores[m], abs=1e-4)
        assert set(got[key]) == set(scores)  # every model begins some sequence
    best = {r.id: r.model for r in sequences.best(sequences.rated(seqs, ["id"], model), ["id"]).collect()}
    assert all(want[k][m] >= max(want[k].values()) - 1e-4 for k, m in best.items())
    assert sequences.rated(seqs.limit(0), ["id"], model).count() == 0 and sequences.rated(seqs, ["id"], model.limit(0)).count() == 0


def test_held_out_documents_are_told_by_the_sequences_of_others(spark):
    d = "/root/testdata/sf0.01"
    found = __spark_entry__.queries()["sequence_detection"](spark, d)
    top = found.groupBy("doc_id").agg(F.max_by("model", F.struct("coverage", "model")).alias("model"))
    right = top.join(spark.read.parquet(f"{d}/documents.parquet").where("lang IS NOT NULL"), "doc_id").select((F.col("model") == F.col("lang")).alias("ok")).collect()
    assert len(right) > 100 and sum(r.ok for r in right) >= 0.95 * len(right)
