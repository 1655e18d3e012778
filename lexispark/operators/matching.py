"""Tokens against annotation dictionaries.

hit(file_id, token, cnt) holds a file's distinct tokens; tag(model, tag, class, is_regex, lang) the dictionary. A match is a
hit and a node (model, class, tag). Literal tags are an equi join. Patterns meet the distinct tokens only, through an index of the
texts that their syntax tree says a match must hold (`functions.patterns`): joined on what a match begins and ends with, where that is
known, else on the rarest gram of such a text, and then verified.
Patterns without any such text meet every token in a nested loop; `pattern_index` tells which. What matches is joined back by token.
A few patterns need no join at all: they are expressions on the hits; with a few literals, too, all matches come of one pass, which
reads hits once, so that these need not be written for it. `may_match` tells such dictionaries' tokens before they are counted.
Malformed patterns are left out (`valid_patterns`), as one of them would fail the whole job."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.columns import full_match, has_quotes, is_pattern, without_quotes
from lexispark.functions.patterns import known
from lexispark.plans.durable import written

#: Characters of the parts of texts that are joined on, at most.
GRAM = 3
#: Characters of a match's begin and of its end that are joined on, at most; together GRAM at least.
END = 6
#: Rows of the index up to which patterns are expressions on the tokens, in one pass without a join.
FEW = 64
#: Tokens of more characters aren't cut into grams but meet every pattern; there are hardly any.
LONG = 200


def valid_patterns(tag: DataFrame) -> DataFrame:
    """tag without rows whose pattern does not compile."""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit("^(?:"), F.col("tag"), F.lit(")$")))
    return tag.where(~F.col("is_regex") | compiled.isNotNull())


def pattern_index(tag: DataFrame) -> DataFrame:
    """(tag, kind, text, begin, end) of the different valid patterns: "whole" and each text that the pattern matches, where these are
    few; "part" and texts of which every match holds one; "none" (text null) where neither is known. begin, end: what every match
    begins and ends with, as far as known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(p, kind, text, begin, end) for p in x["tag"] for kind, texts, begin, end in [known(p)] for text in (texts or [None])]
            yield pd.DataFrame(rows, columns=["tag", "kind", "text", "begin", "end"])

    return valid_patterns(tag.where("is_regex")).select("tag").distinct().mapInPandas(run, "tag string, kind string, text string, begin string, end string")


def _grams(text: Column) -> Column:
    """All parts of 1 .. GRAM characters."""
    ends = F.sequence(F.lit(1), F.least(F.length(text), F.lit(GRAM)))
    every = F.transform(ends, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))
    return F.when(F.length(text) > 0, F.array_distinct(F.flatten(every))).otherwise(F.array().cast("array<string>"))


def _few(index: DataFrame) -> dict[str, tuple[str, list[str]]] | None:
    """What each pattern needs, if the whole index has FEW rows at most."""
    rows = index.limit(FEW + 1).collect()
    if len(rows) > FEW:
        return None
    needs: dict[str, tuple[str, list[str]]] = {}
    for x in rows:
        needs.setdefault(x["tag"], (x["kind"], []))[1].append(x["text"])
    return needs


def _hope(text: Column, kind: str, texts: list[str]) -> Column:
    """False where text can't match a pattern of these needs."""
    if kind == "none":
        return text.isNotNull()
    return text.isin(texts) if kind == "whole" else reduce(or_, [F.contains(text, F.lit(x)) for x in texts])


def _hopeful(needs: dict[str, tuple[str, list[str]]], literals: list[str]) -> Column:
    """A condition on `token`, false where none of the patterns and literals can match."""
    whole = sorted({*literals, *(x for kind, texts in needs.values() if kind == "whole" for x in texts)})
    kinds = {(kind, *texts) for kind, texts in needs.values() if kind != "whole"}

    def any_of(text: Column) -> Column:
        return reduce(or_, [text.isin(whole)] * bool(whole) + [_hope(text, kind, texts) for kind, *texts in sorted(kinds, key=str)], F.lit(False))

    # hardly any token has quotes; with them taken out in each of the tests, all tokens would pay for it as often
    token = F.col("token")
    return F.when(has_quotes(token), any_of(without_quotes(token))).otherwise(any_of(token))


def _needed(tag: DataFrame) -> tuple[dict[str, tuple[str, list[str]]], list[str]] | None:
    """What the patterns of the written tag need and its literals, if both are few."""
    literals = [x["tag"] for x in tag.where("NOT is_regex AND tag IS NOT NULL").select("tag").distinct().limit(FEW + 1).collect()]
    needs = _few(written(pattern_index(tag))) if len(literals) <= FEW else None
    return None if needs is None else (needs, literals)


def may_match(tag: DataFrame) -> Column | None:
    """A condition on `token`, false for tokens that no tag matches, so that only what is left needs to be counted and written. None
    where tags are many or a pattern needs no text: then all tokens are to be looked at."""
    known = _needed(written(tag))
    if known is None or any(kind == "none" for kind, _ in known[0].values()):
        return None
    return _hopeful(*known)


def _fitting(rows: DataFrame, needs: dict[str, tuple[str, list[str]]], literals: list[str] | None = None) -> DataFrame:
    """rows(token, ...) with each pattern that matches the token in full, as `tag`, and, if literals are given, `is_regex` with each of
    these that equals it; an expression is tried where a text that it needs stands."""
    tests = []
    row = lambda tag, is_regex: F.struct(tag.alias("tag"), F.lit(is_regex).alias("is_regex"))
    for pattern, (kind, texts) in sorted(needs.items()):
        tests.append(F.when(_hope(F.col("_t"), kind, texts) & full_match(F.col("_t"), pattern), row(F.lit(pattern), True)))
    if literals:
        tests.append(F.when(F.col("_t").isin(literals), row(F.col("_t"), False)))
    tests.append(F.lit(None).cast("struct<tag:string,is_regex:boolean>"))
    plain = rows.where(_hopeful(needs, literals or [])).withColumn("_t", without_quotes(F.col("token")))
    # nulls go as rows, since a filter on the array would have all of the tests interpreted
    found = plain.select(*rows.columns, F.inline(F.array(*tests))).where("tag IS NOT NULL")
    return found.drop("is_regex") if literals is None else found


def pattern_tokens(tokens: DataFrame, tag: DataFrame) -> DataFrame:
    """(token, tag): the different tokens that patterns match in full. Each text that a pattern needs is looked up by that one of its
    longest grams that the fewest tokens have; only patterns that need none meet every token. Few patterns are tried where tokens stand."""
    index = written(pattern_index(tag))
    needs = _few(index)
    return _indexed(tokens, index) if needs is None else _fitting(tokens.select("token"), needs).distinct()


def _by_ends(plain: DataFrame, anchored: DataFrame) -> DataFrame:
    """(token, _t, tag): tokens that begin and end as the patterns anchored(tag, begin, end) do. A token has a row per pair of lengths
    that patterns know, so few tokens but those that match meet a pattern."""
    sized = anchored.select("*", F.least(F.length("begin"), F.lit(END)).alias("p"), F.least(F.length("end"), F.lit(END)).alias("q"))
    key = lambda x, y, p, q: F.concat_ws("\0", F.lit(f"{p} {q}"), F.left(x, F.lit(p)), F.right(y, F.lit(q)))
    shapes = [tuple(x) for x in sized.select("p", "q").distinct().collect()]
    keys = lambda x, y, fits: F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(fits(p, q), key(x, y, p, q)) for p, q in shapes]))
    tokens = plain.select("token", "_t", F.explode(keys(F.col("_t"), F.col("_t"), lambda p, q: F.length("_t") >= max(p, q))).alias("key"))
    known = sized.select("tag", "begin", "end", F.explode(keys(F.col("begin"), F.col("end"), lambda p, q: (F.col("p") == p) & (F.col("q") == q))).alias("key"))
    found = tokens.join(known, "key").where(F.startswith("_t", "begin") & F.endswith("_t", "end"))
    return found.select("token", "_t", "tag")


def _by_grams(plain: DataFrame, index: DataFrame) -> DataFrame:
    """(token, _t, tag): tokens that hold a text that the patterns of the index need."""
    size = F.least(F.length("text"), F.lit(GRAM))
    longest = F.filter(_grams(F.col("text")), lambda g: F.length(g) == size)
    needs = index.select("tag", "text", F.explode(longest).alias("gram"))
    held = plain.where(F.length("_t") <= LONG).select("token", "_t", F.explode(_grams(F.col("_t"))).alias("gram"))
    held = written(held.join(needs.select("gram").distinct(), "gram", "left_semi"))
    counted = needs.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    # a gram that no token has is as rare as can be: its pattern meets nothing
    rarest = counted.groupBy("tag", "text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    part = held.join(rarest.select("tag", "text", F.col("m.gram").alias("gram")), "gram").where(F.contains("_t", "text")).select("token", "_t", "tag")
    return part.union(plain.where(F.length("_t") > LONG).join(index.select("tag").distinct()).select("token", "_t", "tag"))


def _indexed(tokens: DataFrame, index: DataFrame) -> DataFrame:
    plain = tokens.select("token").distinct().withColumn("_t", without_quotes(F.col("token")))
    found = plain.join(index.where("kind = 'whole'").select("tag", F.col("text").alias("_t")), "_t").select("token", "_t", "tag")
    part, anchors = index.where("kind = 'part'"), F.length("begin") + F.length("end")
    # with anchors, the texts in between are left to the verification
    found = found.union(_by_ends(plain, part.where(anchors >= GRAM).select("tag", "begin", "end").distinct()))
    if not (rest := part.where(anchors < GRAM)).isEmpty():
        found = found.union(_by_grams(plain, rest))
    found = found.union(plain.join(index.where("kind = 'none'").select("tag")).select("token", "_t", "tag"))
    return found.where(full_match(F.col("_t"), F.col("tag"))).select("token", "tag").distinct()


def prefilter(hit: DataFrame, tag: DataFrame) -> DataFrame:
    """Hits whose token equals a known tag or looks like a pattern; plain tokens that only a pattern would match go."""
    known = tag.select(F.col("tag").alias("token")).distinct()
    return hit.where(is_pattern(F.col("token"))).union(hit.where(~is_pattern(F.col("token"))).join(known, "token", "left_semi").select(*hit.columns))


def literal_matches(hit: DataFrame, tag: DataFrame) -> DataFrame:
    return _literal_matches(hit, written(tag))


def _literal_matches(hit: DataFrame, tag: DataFrame) -> DataFrame:
    """tag is written: its true size tells whether the hits need to be shuffled for it."""
    literal = tag.where("NOT is_regex").select("model", "class", "tag", "lang")
    return hit.withColumn("_t", without_quotes(F.col("token"))).join(literal, F.col("_t") == F.col("tag")).drop("_t").withColumn("kind", F.lit("tag"))


def regex_matches(hit: DataFrame, tag: DataFrame) -> DataFrame:
    return _regex_matches(hit, written(tag))


def _regex_matches(hit: DataFrame, tag: DataFrame) -> DataFrame:
    index = written(pattern_index(tag))
    needs, node = _few(index), tag.where("is_regex").select("model", "class", "tag", "lang")
    if needs is not None:
        found = _fitting(hit, needs).join(node, "tag")
    else:
        found = hit.join(written(_indexed(hit, index)).join(node, "tag"), "token")
    return found.select(*hit.columns, "model", "class", "tag", "lang").withColumn("kind", F.lit("pattern"))


def _matches(hit: DataFrame, tag: DataFrame) -> DataFrame:
    """All matches of the written tag, in one pass over the hits where patterns and literals are few."""
    known = _needed(tag)
    if known is None:
        return _literal_matches(hit, tag).unionByName(_regex_matches(hit, tag))
    found = _fitting(hit, *known).join(tag, ["tag", "is_regex"])
    return found.select(*hit.columns, "model", "class", "tag", "lang", F.when(F.col("is_regex"), "pattern").otherwise("tag").alias("kind"))


def matches(hit: DataFrame, tag: DataFrame, file_language: DataFrame | None = None) -> DataFrame:
    """All matches, those of language-bound tags only in files of that language."""
    found = _matches(hit, written(tag))
    if file_language is None:
        return found
    # written, so each match is made once, and only those of bound tags are shuffled to the files' languages
    found = written(found)
    bound = found.where("lang <> ''").join(file_language.select("file_id", "lang"), ["file_id", "lang"], "left_semi")
    return found.where("lang = ''").union(bound.select(*found.columns))


def without_known(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Matches that are not in known yet."""
    return found.join(known.select(*keys), keys, "left_anti")


def unmatched(hit: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, n, tokens): per file the tokens without match, as one row, tokens sorted."""
    rest = hit.join(found.select("file_id", "token").distinct(), ["file_id", "token"], "left_anti")
    return rest.groupBy("file_id").agg(F.count("*").alias("n"), F.sum("cnt").cast("long").alias("cnt"), F.sort_array(F.collect_list("token")).alias("tokens"))


def feature_matches(feature: DataFrame, label: DataFrame, closure: DataFrame, tier: DataFrame) -> DataFrame:
    """Features (row, name, value) and classes: the value is a label of the class, and the class or one above it ends in the
    feature's name or is of tier FEATS. closure(src, dst) need not be reflexive."""
    above = closure.select("src", "dst").union(label.select(F.col("class").alias("src"), F.col("class").alias("dst"))).distinct()
    fits = above.join(tier.select(F.col("class").alias("dst"), "tier"), "dst", "left")
    hit = feature.join(label, feature["value"] == label["label"]).select("row", "name", "value", "class")
    return hit.join(fits, hit["class"] == fits["src"]).where(F.expr("endswith(dst, name)") | (F.col("tier") == "FEATS")).select("row", "name", "value", "class").distinct()
