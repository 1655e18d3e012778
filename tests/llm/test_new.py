"""Ball k-means, phrase collocations and URL rules against plain versions, with odd rows."""

import hashlib
import random
import re
from collections import Counter
from fnmatch import translate

import numpy as np
import pytest

from lexispark.llm import balls, phrases, pii, registry, urls

ARRAYS = "vec_id long, embedding array<float>, n long, cluster string, v string"


def lloyd(rows, k, rounds):
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    x = np.array([v for _, v in kept], dtype=object).reshape(-1, 64)
    centres = [list(v) for v in x[:k]]
    for i in range(rounds + 1):
        d = [[int(sum((a - b) ** 2 for a, b in zip(v, c, strict=True))) for c in centres] for v in x]
        own = [min(range(len(centres)), key=lambda j: (r[j], j)) for r in d]
        if i < rounds:
            for c in range(len(centres)):
                if mine := [v for v, o in zip(x, own, strict=True) if o == c]:
                    centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(kept[i][0], own[i], d[i][own[i]], sum(d[j][own[j]] for j in range(len(x)) if own[j] == own[i]), sum(d[j][own[j]] for j in range(len(x))), hashlib.sha256(",".join(map(str, centres[own[i]])).encode()).hexdigest()) for i in range(len(x))]


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "v") for i, v in rows], ARRAYS).repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_balls_are_exact(spark, seed):
    rng = random.Random(seed)
    points = [[rng.choice([-0.5, 0.0, 0.25]) * rng.random() ** seed for _ in range(64)] for _ in range(12)]
    rows = [(i, [c + rng.choice([0, 0.001]) for c in rng.choice(points)]) for i in range(70)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (200, None), (201, [0.1] * 63), (202, [None] * 64), (203, [float("nan")] * 64), (204, [float("inf")] + [0.0] * 63), (205, [])]
    got = balls.digests(balls.cluster(embeddings(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(lloyd(rows, 8, 10), key=str)


def test_balls_skip_comparisons_but_keep_ties():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, centres = rng.integers(-4, 5, (200, 3)), rng.integers(-4, 5, (6, 3))
        own = rng.integers(0, 6, 200)
        all_ = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        now, d = balls.assigned(x, own, centres)
        assert (now == all_.argmin(axis=1)).all() and (d == all_.min(axis=1)).all()


def test_balls_of_few_none_and_huge_vectors(spark):
    assert balls.digests(balls.cluster(embeddings(spark, [(1, None)]))).collect() == []
    assert balls.digests(balls.cluster(embeddings(spark, []))).collect() == []
    few = [(1, [0.0] * 64), (2, [1.0] * 64)]
    assert sorted(map(tuple, balls.digests(balls.cluster(embeddings(spark, few))).collect())) == sorted(lloyd(few, 8, 10))
    huge = balls.cluster(embeddings(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [3e38] * 64)]), k=1)[0].collect()
    assert all(0 <= r["distance"] < 2**63 for r in huge)


def plain_phrases(rows, least, longest, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    found = {(lang, p): a for (lang, p), a in f.items() if len(p) >= 2 and a >= least}
    for (lang, p), a in found.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in found.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, at = [], Counter()
    for r in out:
        at[r[0]] += 1
        if at[r[0]] <= top:
            ranked.append((r[0], at[r[0]], *r[1:]))
    return ranked


@pytest.mark.parametrize("seed", range(3))
def test_phrases_are_those_of_a_plain_count(spark, seed, monkeypatch):
    rng = random.Random(seed)
    words = ["a", "B", "b", "été", "Ä", "x\x00y", "-", "日本", "c's", "\x1c", "zz"] + [f"w{i}" for i in range(6)]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ","]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", "en"), (" . ", None), ("a b " * 3000, "en")] + [rows[0]] * 5
    d = spark.createDataFrame([(t, x, 1, "s", "w") for t, x in rows], "text string, lang string, a long, slots string, words string").repartition(3)
    if seed:  # several dictionaries, shards and rounds, few buckets
        for name, value in {"WORDS": 8, "SHARD": 16, "SLOTS": 4096, "ROUND": 2, "ARRAY": 64, "HELD_KEYS": 50, "HELD_WORDS": 5}.items():
            monkeypatch.setattr(phrases, name, value)
    got = phrases.collocations(d, least=3, longest=5, top=40).collect()
    want = plain_phrases(rows, 3, 5, 40)
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_phrases_read_few_rows_at_once(spark):
    """A row of the walk has up to 20 bytes a word: what a task reads at once stays within 64 MB; the session's setting comes back."""
    setting = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(setting)
    with phrases.small_batches(spark):
        assert int(spark.conf.get(setting)) * phrases.ARRAY * 20 <= 64 << 20
    assert spark.conf.get(setting) == before


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 50_000))
    parts = {s: keys[phrases.shard_of(keys, 4) == s] for s in range(4)}
    own = {}
    for s in (0, 1, 3):
        levels = phrases.bit_levels(parts[s])
        by_slot = np.empty_like(parts[s])
        by_slot[phrases.Slots({0: (levels, parts[s])}, 1).rank(parts[s])] = parts[s]
        own[s] = (levels, by_slot)
    table = phrases.Slots(own, 4)
    inside = np.concatenate([parts[s] for s in (0, 1, 3)])
    assert sorted(table.find(inside)) == list(range(len(inside)))
    others = np.setdiff1d(np.concatenate([rng.integers(0, 1 << 60, 50_000), parts[2]]), inside)
    assert (table.find(others) == -1).all()
    index = np.unique(rng.integers(0, 1 << 20, 1000))
    a, b = phrases.unpacked(phrases.packed(index, index * 3 + 1))
    assert (a == index).all() and (b == index * 3 + 1).all()


def plain_verdict(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    best = None
    for rule, verdict in rules:
        own, _, rest = rule.partition("/")
        host_at = lambda glob: re.fullmatch(re.escape(glob).replace(r"\*", "[^/]*"), host, re.S)
        if (host_at(own) or host_at("*." + own)) and re.fullmatch(translate("/" + rest + "*").replace("[", "["), path) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best and best[0], best[1] if best else default


URLS = [
    "http://example.com/en/a", "https://www.Example.COM/en/", "http://a.www.example.com/en/x?y#z", "http://notexample.com/en/", "http://example.com/EN/", "http://example.com", "http://com/", "http://x.net/es/1", "http://net/fr/",
    "http://internet/fr/", "http://user@a.com:80/", "ftp://a.com?b=/en/", "x://y://z.com/en/", "no scheme", "", None, "http://", "http:///en/", "http://exämple.com/é/", "http://" + "a." * 40_000 + "com/" + "b" * 100_000, "http://x.com#/", "http://é.net/es/é", "http://a\nb.com/", "http://example.com/en/a",
]


@pytest.mark.parametrize("rules", [urls.RULES, (("e*e.com/*n/", "block"), ("com/", "allow"), ("a.com/", "block"), ("*/en/", "allow")), tuple((f"{c}{d}.com/{p}", "block") for c in "abcdefgh" for d in "aexw" for p in ("", "en/")) + (("example.com/", "block"),)])
def test_rules_are_those_of_plain_globs(spark, rules):
    d = spark.createDataFrame([(i, u, "h", "p", "r", "w") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule string, which string").repartition(2)
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in urls.judge(d, rules, "unknown").collect()}
    assert got == {i: plain_verdict(u, rules, "unknown") for i, u in enumerate(URLS)}
    assert urls.judge(d.limit(0), rules).collect() == [] and {r["verdict"] for r in urls.judge(d, ()).collect()} == {"allow"}


def test_rules_need_a_path(spark):
    with pytest.raises(ValueError):
        urls.judge(spark.createDataFrame([(1, "")], "page_id long, url string"), (("com", "allow"),))


def test_every_dealt_operator_has_its_query():
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in registry.queries() if x.startswith("op")}


def test_long_domains_do_not_overflow_the_stack(spark):
    texts = ["x@" + "a." * 50_000, "y@" + "b." * 20 + "com ", "x@" + "a." * 9000 + "com", "z@ok.org"]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert got[0]["text"] == texts[0] and got[1]["text"] != texts[1] and got[3]["text"] != texts[3]
