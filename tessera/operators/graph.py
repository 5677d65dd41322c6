"""Graph traversal by frontier joins: ``edges(src, dst[, prop, pos])``, entity sets as ``idx``.

Every round is one equi-join of the frontier with the edges, a ``distinct`` and an anti-join
with what was visited, ended by a table in the shared folder (lineage does not grow, and a
lost executor costs one round).  A closure writes its edges once, dealt by source.  A bad pair (child, ancestor) removes the edge between
them; a bad node is never entered, though a seed that is bad is still expanded.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import bucketed, materialize

from . import aggregates, relations


def blacklist(names: DataFrame, entities: DataFrame) -> DataFrame:
    """``names(qid)`` to bad nodes (idx); unknown names are skipped."""
    return entities.join(names, "qid", "left_semi").select("idx")


def blacklist_pairs(names: DataFrame, entities: DataFrame) -> DataFrame:
    """``names(child_qid, ancestor_qid)`` to (child, ancestor); pairs with an unknown name are skipped."""
    child = entities.select(F.col("idx").alias("child"), F.col("qid").alias("child_qid"))
    ancestor = entities.select(F.col("idx").alias("ancestor"), F.col("qid").alias("ancestor_qid"))
    return names.join(child, "child_qid").join(ancestor, "ancestor_qid").select("child", "ancestor")


def successors(edges: DataFrame, active: DataFrame, bad_pairs: DataFrame | None = None) -> DataFrame:
    """One hop: the targets of active nodes.  A bad pair (left, right) keeps ``right`` from activating ``left``."""
    hop = edges.join(active.select(F.col("idx").alias("src")), "src", "left_semi")
    if bad_pairs is not None:
        hop = hop.join(bad_pairs.select(F.col("child").alias("dst"), F.col("ancestor").alias("src")), ["src", "dst"], "left_anti")
    return hop.select(F.col("dst").alias("idx")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, max_steps: int | None = None, bad_nodes: DataFrame | None = None, bad_pairs: DataFrame | None = None) -> DataFrame:
    """Closure: (idx, step) of all nodes reached from the seeds (step 0, unless bad) in at most ``max_steps`` hops.

    Edges into bad nodes and of bad pairs go first, once.  What is left is written bucketed by source, so that a
    round deals its frontier and what that finds, not the edges; nodes found before are left out by an anti-join.
    """
    hops = edges.select("src", "dst").distinct()
    if bad_pairs is not None:
        hops = hops.join(bad_pairs.select(F.col("child").alias("dst"), F.col("ancestor").alias("src")), ["src", "dst"], "left_anti")
    if bad_nodes is not None:
        hops = hops.join(bad_nodes.select(F.col("idx").alias("dst")), "dst", "left_anti")
    frontier = materialize(seeds.select(F.col("idx").cast("long").alias("idx")).distinct(), "frontier")
    visited, parts = frontier, [frontier.withColumn("step", F.lit(0))]

    def go(hops: DataFrame) -> None:
        nonlocal frontier, visited
        while (max_steps is None or max_steps < 0 or len(parts) <= max_steps) and not frontier.isEmpty():
            frontier = materialize(successors(hops, frontier).join(visited, "idx", "left_anti"), "frontier")
            visited = visited.union(frontier)
            parts.append(frontier.withColumn("step", F.lit(len(parts))))

    if max_steps is not None and 0 <= max_steps <= 1:
        go(hops)
    else:
        with bucketed(hops, "hops", "src") as table:
            go(table)
    out = parts[0] if bad_nodes is None else parts[0].join(bad_nodes, "idx", "left_anti")
    for part in parts[1:]:
        out = out.union(part)
    return out


class Graph:
    """Relations by name over one edge table, with a memo of closures."""

    def __init__(self, edges: DataFrame, bad_nodes: DataFrame | None = None, bad_pairs: DataFrame | None = None):
        self.edges, self.bad_nodes, self.bad_pairs, self._memo = edges, bad_nodes, bad_pairs, {}

    def relation(self, *names: str) -> DataFrame:
        return self.edges.where(F.col("prop").isin(*names))

    def set_bad(self, bad_nodes: DataFrame | None, bad_pairs: DataFrame | None = None) -> None:
        """A new blacklist; what was remembered no longer holds."""
        self.bad_nodes, self.bad_pairs, self._memo = bad_nodes, bad_pairs, {}

    def satisfy(self, names: list[str], seeds: list[int] | DataFrame, max_steps: int | None = None) -> DataFrame:
        """All entities that reach a seed through the relations (seeds included): closure over inverted edges.

        Remembered for up to 99 listed seeds, by relations, seeds and steps.
        """
        key = (tuple(sorted(names)), tuple(sorted(seeds)), max_steps) if isinstance(seeds, list) and len(seeds) < 100 else None
        if key in self._memo:
            return self._memo[key]
        start = self.edges.sparkSession.createDataFrame([(s,) for s in seeds], "idx long") if isinstance(seeds, list) else seeds
        turned = self.relation(*names).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = reach(turned, start, max_steps, self.bad_nodes, self.bad_pairs).select("idx")
        if key is not None:
            self._memo[key] = found
        return found


def neighborhood(edges: DataFrame, roots: DataFrame, max_steps: int, dictionary: DataFrame | None = None) -> DataFrame:
    """(root, node): nodes within ``max_steps`` hops of each root; the root itself only through a cycle.

    ``dictionary(idx[, code])`` restricts the nodes; with ``code`` they are given as codes.
    """
    hop = edges.select("src", "dst").distinct()
    frontier = materialize(roots.select(F.col("idx").alias("root"), F.col("idx").alias("node")).distinct(), "walk")
    seen = None
    for _ in range(max_steps):
        found = frontier.join(hop, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        if seen is not None:
            found = found.join(seen, ["root", "node"], "left_anti")
        frontier = materialize(found, "walk")
        seen = frontier if seen is None else seen.union(frontier)
        if frontier.isEmpty():
            break
    if dictionary is None:
        return seen
    listed = seen.join(dictionary, F.col("node") == F.col("idx"))
    return listed.select("root", (F.col("code") if "code" in dictionary.columns else F.col("node")).alias("node"))


def dictionary_positions(dictionary: DataFrame) -> DataFrame:
    """(idx, code): dense positions of the dictionary's ids in rising order."""
    return aggregates.recode(dictionary, dictionary.select("idx").distinct())


def codes_to_ids(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(root, node) with dictionary positions back to ids."""
    return found.join(dictionary, F.col("node") == F.col("code")).select("root", F.col("idx").alias("node"))


def find_dictionary(edges: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """(idx, n): how often each node is a target, over ``steps`` rounds; a round starts from the last one's targets only."""
    active, counts = start.select("idx").distinct(), None
    for _ in range(steps):
        hop = edges.join(active.select(F.col("idx").alias("src")), "src", "left_semi")
        one = materialize(hop.groupBy(F.col("dst").alias("idx")).agg(F.count(F.lit(1)).alias("n")), "round")
        counts = one if counts is None else counts.union(one)
        active = one.select("idx")
    return counts.groupBy("idx").agg(F.sum("n").alias("n"))


def project(graph: Graph, roots: DataFrame, spec: dict) -> DataFrame:
    """A named projection: ``relations``, ``max_steps``, and either ``min_count`` (strictly more
    occurrences make a dictionary word) or ``condition`` (an entity set): (root, node)."""
    edges = graph.relation(*spec["relations"])
    if spec.get("condition") is not None:
        words = spec["condition"].select("idx")
    else:
        words = find_dictionary(edges, roots, spec["max_steps"]).where(F.col("n") > spec["min_count"]).select("idx")
    return neighborhood(edges, roots, spec["max_steps"], words)


#: The nine projections (relations by property name, steps, least count).
PROJECTIONS = (
    ("instance_subclass", ("P31", "P279"), 2, 5),
    ("occupation", ("P106",), 1, 10),
    ("country", ("P17", "P27", "P495"), 1, 3),
    ("admin_territorial_entity", ("P131",), 2, 10),
    ("us_state", ("P131",), 4, None),
    ("sport_occupation", ("P641", "P106", "P425"), 4, None),
    ("en_category_link", ("category_link",), 1, 53),
    ("sport_industry_work", ("P101", "P425", "P1995", "P641", "P2578", "P452"), 1, 10),
    ("league_part_of", ("P118", "P361"), 3, None),
)


def shortest_paths(edges: DataFrame, root: int, members: DataFrame, max_steps: int | None = None, bad_nodes: DataFrame | None = None, bad_pairs: DataFrame | None = None) -> DataFrame:
    """(idx, hops, path) for each member reached from ``root``: fewest hops, then relation order
    ``rel``, then place ``pos`` of each step; ``path`` alternates nodes and relation names.

    ``edges(src, dst, rel, prop, pos)``.
    """
    spark = edges.sparkSession
    start = spark.createDataFrame([(root, [str(root)], [])], "idx long, path array<string>, rank array<int>")
    frontier = materialize(start, "paths")
    visited = frontier
    for step in count():
        if max_steps is not None and step >= max_steps:
            break
        hop = frontier.join(edges, F.col("idx") == F.col("src")).select(
            F.col("src"), F.col("dst"), F.concat("path", F.array("prop", F.col("dst").cast("string"))).alias("path"), F.concat("rank", F.array(F.col("rel").cast("int"), F.col("pos").cast("int"))).alias("rank")
        )
        if bad_pairs is not None:
            hop = hop.join(bad_pairs.select(F.col("child").alias("src"), F.col("ancestor").alias("dst")), ["src", "dst"], "left_anti")
        if bad_nodes is not None:
            hop = hop.join(bad_nodes.select(F.col("idx").alias("dst")), "dst", "left_anti")
        best = hop.groupBy(F.col("dst").alias("idx")).agg(F.min_by(F.struct("path", "rank"), F.struct("rank", "path")).alias("_b")).select("idx", "_b.path", "_b.rank")
        frontier = materialize(best.join(visited, "idx", "left_anti"), "paths")
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return visited.join(members, "idx", "left_semi").select("idx", ((F.size("path") - 1) / 2).cast("int").alias("hops"), "path")


def describe(paths: DataFrame, names: DataFrame) -> DataFrame:
    """(idx, text): each path with the nodes' names where ``names(idx, name)`` has one."""
    steps = paths.select(F.col("idx").alias("_to"), F.posexplode("path").alias("n", "step"))
    named = steps.join(names.select(F.col("idx").cast("string").alias("step"), "name"), "step", "left")
    shown = F.when(F.col("n") % 2 == 0, F.coalesce("name", "step")).otherwise(F.concat(F.lit("--"), F.col("step"), F.lit("->")))
    return named.groupBy(F.col("_to").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("n", shown.alias("s")))).alias("_s")).select("idx", F.array_join(F.transform("_s", lambda x: x["s"]), " ").alias("text"))


def extend_cursor(edges: DataFrame, cursor: DataFrame, usage: int = 1) -> DataFrame:
    """One path step: usage 1 replaces the cursor by its targets; more uses give the union of what up to ``usage`` rounds find."""
    found = successors(edges, cursor)
    everything = found
    for _ in range(usage - 1):
        found = materialize(successors(edges, found).join(everything, "idx", "left_anti"), "cursor")
        if found.isEmpty():
            break
        everything = everything.union(found)
    return everything


def classify(entities: DataFrame, classes: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(idx, class_id) and the classes (class_id, name): the highest class, by sorted name, that
    holds the entity; "other" comes last and exists only if some entity has no class."""
    names = sorted(classes)
    held = None
    for i, name in enumerate(names):
        one = classes[name].select("idx", F.lit(i).alias("class_id"))
        held = one if held is None else held.union(one)
    top = held.groupBy("idx").agg(F.max("class_id").alias("class_id"))
    found = entities.join(top, "idx", "left").select("idx", F.coalesce("class_id", F.lit(len(names))).alias("class_id"))
    rest = [] if found.where(F.col("class_id") == len(names)).isEmpty() else ["other"]
    return found, entities.sparkSession.createDataFrame(list(enumerate(names + rest)), "class_id int, name string")


def fixed_points(titles: DataFrame, wiki: str) -> DataFrame:
    """(category, article): each ``Category:<name>`` title to the first title among the name and its
    alternate: without a closing "(...)", -ses to -sis, -ies to -y, or without the final s."""
    own = titles.where(F.col("wiki") == wiki)
    name = F.expr("substring(title, 10)")
    cut = F.regexp_replace("name", r"\s*\([^(]*\)$", "")
    other = F.when(F.col("name").endswith(")"), cut).when(F.col("name").endswith("ses"), F.regexp_replace("name", "es$", "is")).when(F.col("name").endswith("ies"), F.regexp_replace("name", "ies$", "y")).when(F.col("name").endswith("s"), F.regexp_replace("name", "s$", ""))
    tried = own.where(F.col("title").startswith("Category:")).select(F.col("idx").alias("category"), name.alias("name"))
    tried = tried.select("category", F.posexplode(F.filter(F.array("name", other), lambda x: x.isNotNull())).alias("n", "title"))
    return tried.join(own.select("title", "idx"), "title").groupBy("category").agg(F.min_by("idx", F.struct("n", "idx")).alias("article"))


def relation_degree_positive(edges: DataFrame) -> DataFrame:
    """Entities that are the target of some edge: the nodes whose inverted degree is not 0."""
    return relations.invert(edges).select(F.col("src").alias("idx")).distinct()

