"""Class graphs: edge(src, dst, relation), src standing below dst.

Paths are walked by a recursive query (`paths`) that carries the nodes passed, so cycles end; what it returns can be exponential
in the graph. Where only reachability counts, `closure` joins and deduplicates to a fixpoint instead, and `shortest` keeps one
path per node."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands between class and class in OWL, and the relation it becomes.
RELATIONS = {"subClassOf": "SUB", "equivalentClass": "EQUIV", "unionOf": "UNION", "intersectionOf": "INTER", "first": "COLL", "rest": "COLL", "complementOf": "COMPL", "type": "A"}
DEPTH = 100


def build(triples: DataFrame) -> DataFrame:
    """Edges from triples(s, p, o), by the last segment of the predicate; others are left out, doubles too."""
    name = F.regexp_extract("p", r"([^/#]*)$", 1)
    relation = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    return triples.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.try_element_at(relation, name).alias("relation")).where("relation IS NOT NULL").distinct()


def paths(edge: DataFrame, start: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """(src, dst, path): every simple path of at least one edge and at most `depth`, from start(src) if given."""
    spark = edge.sparkSession
    edges, first = (f"lexispark_{uuid.uuid4().hex}" for _ in range(2))
    pairs = edge.select("src", "dst").distinct()
    pairs.createOrReplaceTempView(edges)
    (pairs if start is None else pairs.join(start.select("src").distinct(), "src", "left_semi")).createOrReplaceTempView(first)
    found = spark.sql(f"""
        WITH RECURSIVE p(src, dst, path) MAX RECURSION LEVEL {depth} AS (
          SELECT src, dst, array(src, dst) FROM {first} WHERE src <> dst
          UNION ALL SELECT p.src, e.dst, concat(p.path, array(e.dst)) FROM p JOIN {edges} e ON p.dst = e.src WHERE NOT array_contains(p.path, e.dst)
        ) SELECT src, dst, path FROM p""")
    for name in (edges, first):
        spark.catalog.dropTempView(name)
    return found


def closure(edge: DataFrame, rounds: int = 30) -> DataFrame:
    """(src, dst): what can be reached; path lengths double each round. Each round is written out, so lineage stays short."""
    from lexispark.plans.durable import written

    known = written(edge.select("src", "dst").where("src <> dst").distinct())
    size = known.count()
    for _ in range(rounds):
        step = known.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").where("src <> dst")
        known = written(known.union(step).distinct())
        if (now := known.count()) == size:
            return known
        size = now
    raise RuntimeError(f"the closure did not settle in {rounds} rounds")


def lowest(members: DataFrame, closed: DataFrame, group: str, node: str) -> DataFrame:
    """Of each group's classes those that no other of the group stands below."""
    below = members.select(group, F.col(node).alias("src")).join(closed, "src").select(group, F.col("dst").alias(node)).distinct()
    return members.select(group, node).distinct().join(below, [group, node], "left_anti")


def shortest(edge: DataFrame, targets: DataFrame, rounds: int = 1000) -> DataFrame:
    """(src, dst, path): the shortest path of one edge or more from each src to a target, the least by its nodes among equals;
    anonymous nodes hidden. Breadth first, back from the targets: a round keeps the least path per node and target, so diamonds
    cost nothing extra; each round is written out."""
    from lexispark.plans.durable import written

    pairs = written(edge.select("src", "dst").where("src <> dst").distinct())
    front = pairs.join(targets.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", F.array("src", "dst").alias("path"))
    front = known = written(front)
    for _ in range(rounds):
        step = pairs.select(F.col("src").alias("before"), F.col("dst").alias("src")).join(front, "src").where("before <> dst")
        best = step.groupBy(F.col("before").alias("src"), "dst").agg(F.min("path").alias("path"))
        front = written(best.select("src", "dst", F.concat(F.array("src"), "path").alias("path")).join(known.select("src", "dst"), ["src", "dst"], "left_anti"))
        if front.isEmpty():
            break
        known = written(known.union(front))
    else:
        raise RuntimeError(f"paths of more than {rounds} edges are left")
    one = known.groupBy("src").agg(F.min(F.struct(F.size("path").alias("n"), "path", "dst")).alias("m"))
    return one.select("src", F.col("m.dst").alias("dst"), visible(F.col("m.path")).alias("path"))


def visible(path):
    return F.filter(path, lambda x: ~x.startswith("#"))


def cycles(edge: DataFrame) -> DataFrame:
    """(node, component): the classes that lie on cycles, with the largest class of their strongly connected component.

    Edges that can't be on a cycle are trimmed from the ends; in what is left the largest name that reaches a class is its colour, and
    the classes of a colour from which its name is reached are a component. Found ones go, and the rest is searched again."""
    from lexispark.plans.durable import written

    edges = written(edge.select("src", "dst").where("src <> dst").distinct())
    found = None
    while True:
        size = -1
        while (now := edges.count()) not in (size, 0):
            size = now
            ends = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
            edges = written(edges.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select("src", "dst"))
        if not now:
            break
        colour = front = written(edges.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct())
        while not front.isEmpty():
            reached = edges.join(front, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("now"))
            front = written(colour.join(reached, "node").where("now > colour").select("node", F.col("now").alias("colour")))
            colour = written(colour.union(front).groupBy("node").agg(F.max("colour").alias("colour")))
        inside = edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        inside = written(inside.select("src", "dst"))
        member = front = written(colour.where("node = colour"))
        while not front.isEmpty():
            before = inside.join(front, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "colour").distinct()
            front = written(before.join(member, ["node", "colour"], "left_anti"))
            member = written(member.union(front))
        found = member if found is None else found.union(member)
        gone = member.select(F.col("node").alias("src"))
        edges = written(edges.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    several = found.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
    return written(found.join(several, "colour").select("node", F.col("colour").alias("component")))


def longest(edge: DataFrame, node: str) -> DataFrame:
    """The longest simple path of one edge or more per start (node = src) or end (node = dst), the least by its nodes among equals;
    anonymous nodes hidden.

    Simple paths are listed only inside strongly connected components, where nothing shorter than listing is known; one that is left
    isn't met again. So over all other edges each class keeps its best path, and a round hands on the paths that got better."""
    from lexispark.plans.durable import written

    up = node == "src"
    end, other = ("src", "dst") if up else ("dst", "src")
    pairs = edge.select("src", "dst").where("src <> dst").distinct()
    part = cycles(edge)
    of = lambda name: part.select(F.col("node").alias(name), F.col("component").alias(name + "_in"))
    both = written(pairs.join(of("src"), "src", "left").join(of("dst"), "dst", "left"))
    inner = both.where("src_in = dst_in").select("src", "dst")
    outer = written(both.where("src_in IS NULL OR dst_in IS NULL OR src_in <> dst_in").select(F.col(end).alias("x"), F.col(other).alias("w")))
    every = both.select(F.col("src").alias("v")).union(both.select("dst")).distinct()
    own = every.select("v", F.col("v").alias("x"), F.array("v").alias("path"))
    if not inner.isEmpty():
        own = own.union(paths(inner).select(F.col(end).alias("v"), F.col(other).alias("x"), "path"))
    own = written(own)
    best_of = F.min(F.struct((-F.size("path")).alias("n"), "path")).alias("m")
    best = front = written(own.groupBy("v").agg(best_of))
    # from each way through a component and out of it
    ways = written(own.join(outer, "x").select("v", "w", F.col("path").alias("way")))
    while not front.isEmpty():
        joined = F.concat("way", "m.path") if up else F.concat("m.path", "way")
        got = ways.join(front.withColumnRenamed("v", "w"), "w").select("v", joined.alias("path")).groupBy("v").agg(best_of.alias("now"))
        front = written(got.join(best, "v").where("now < m").select("v", F.col("now").alias("m")))
        best = written(best.union(front).groupBy("v").agg(F.min("m").alias("m")))
    return best.where("m.n < -1").select(F.col("v").alias(node), visible(F.col("m.path")).alias("path"))


def reach_suffix(edge: DataFrame, closed: DataFrame, suffix: str, tier: DataFrame | None = None) -> DataFrame:
    """Nodes that end in suffix or are of tier(node, tier) FEATS, and those from which such a node is reached."""
    nodes = edge.select(F.col("src").alias("node")).union(edge.select("dst")).distinct()
    goal = nodes.where(F.col("node").endswith(suffix))
    if tier is not None:
        goal = goal.union(nodes.join(tier.where("tier = 'FEATS'"), "node", "left_semi")).distinct()
    below = closed.join(goal.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    return below.union(goal).distinct()


def concepts(tags: DataFrame, closed: DataFrame, top: DataFrame) -> DataFrame:
    """(tag, class, concept): tags with the target concepts above their classes; anonymous nodes are passed, not named."""
    return tags.select("tag", "class").distinct().join(closed, F.col("class") == F.col("src")).join(top.select(F.col("node").alias("dst")), "dst", "left_semi").select("tag", "class", F.col("dst").alias("concept")).distinct()


def named_models(classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(class, model): the model whose namespace pattern matches the class; the later namespace (ordinal) overrides."""
    hit = classes.join(namespaces, F.expr("class RLIKE concat('^(?:', namespace, ')')"))
    return hit.groupBy("class").agg(F.max_by("model", "ordinal").alias("model"))


def orphans(hit: DataFrame, edge: DataFrame, exempt: str, key: tuple[str, ...] = ("hit_id",)) -> DataFrame:
    """Hits without match, but for those of the exempt kind; key: the columns that tell a hit."""
    return hit.where(F.col("kind") != exempt).join(edge.select(*key), list(key), "left_anti")
