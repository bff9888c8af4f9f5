"""One- and two-hop answers over an undirected adjacency, and mining of question pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators.components import connected_components


def graph_store(edges: DataFrame, combine: str = "max") -> DataFrame:
    """a, b, weight with a < b: one row per unordered pair, the larger (or summed) weight of both directions."""
    pair = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pair.agg((F.max if combine == "max" else F.sum)("weight").alias("weight"))


def adjacency(store: DataFrame) -> DataFrame:
    """node, other, weight in both directions."""
    return store.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(store.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def direct_edges(adjacent: DataFrame, node, limit: int = fixed.NEIGHBOUR_LIMIT) -> DataFrame:
    """The strongest neighbours of a node."""
    return adjacent.filter(F.col("node") == F.lit(node)).orderBy(F.col("weight").desc(), "other").limit(limit).select("other", "weight")


def find_connection(adjacent: DataFrame, a, b) -> DataFrame:
    """One row (via, strength, hops): the direct edge, else the common neighbour with the largest product; else none."""
    direct = adjacent.filter((F.col("node") == F.lit(a)) & (F.col("other") == F.lit(b))).select(F.lit(None).cast(adjacent.schema["node"].dataType).alias("via"), F.col("weight").cast("double").alias("strength"), F.lit(1).alias("hops"))
    left = adjacent.filter(F.col("node") == F.lit(a)).select("other", F.col("weight").alias("wa"))
    right = adjacent.filter(F.col("node") == F.lit(b)).select("other", F.col("weight").alias("wb"))
    two = left.join(right, "other").select(F.col("other").alias("via"), (F.col("wa") * F.col("wb")).cast("double").alias("strength"), F.lit(2).alias("hops"))
    return direct.unionByName(two).orderBy("hops", F.col("strength").desc(), "via").limit(1)


def connections(adjacent: DataFrame, pairs: DataFrame) -> DataFrame:
    """find_connection for every row of pairs(a, b): a, b, via, strength, hops (missing pairs are not connected)."""
    direct = pairs.join(adjacent, (F.col("a") == F.col("node")) & (F.col("b") == F.col("other"))).select("a", "b", F.lit(None).cast(adjacent.schema["node"].dataType).alias("via"), F.col("weight").cast("double").alias("strength"), F.lit(1).alias("hops"))
    rest = pairs.join(direct, ["a", "b"], "left_anti")
    left = rest.join(adjacent.select(F.col("node").alias("a"), F.col("other").alias("via"), F.col("weight").alias("wa")), "a")
    two = left.join(adjacent.select(F.col("node").alias("b"), F.col("other").alias("via"), F.col("weight").alias("wb")), ["b", "via"]).withColumn("strength", (F.col("wa") * F.col("wb")).cast("double"))
    best = two.groupBy("a", "b").agg(F.min(F.struct((-F.col("strength")).alias("s"), "via")).alias("t")).select("a", "b", "t.via", (-F.col("t.s")).alias("strength"), F.lit(2).alias("hops"))
    return direct.unionByName(best)


def connections_in(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """connections for a store(a, b, weight) with a < b: its rows are looked up as they lie, and only the way from a node to its
    neighbours needs them in both directions."""
    edge = store.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "weight")
    between = lambda x, y: (F.least(x, y) == F.col("_a")) & (F.greatest(x, y) == F.col("_b"))
    direct = pairs.join(edge, between("a", "b")).select("a", "b", F.lit(None).cast(store.schema["a"].dataType).alias("via"), F.col("weight").cast("double").alias("strength"), F.lit(1).alias("hops"))
    rest = pairs.join(direct, ["a", "b"], "left_anti")
    left = rest.join(adjacency(store).select(F.col("node").alias("a"), F.col("other").alias("via"), F.col("weight").alias("wa")), "a")
    two = left.join(edge, between("b", "via")).withColumn("strength", (F.col("wa") * F.col("weight")).cast("double"))
    best = two.groupBy("a", "b").agg(F.min(F.struct((-F.col("strength")).alias("s"), "via")).alias("t")).select("a", "b", "t.via", (-F.col("t.s")).alias("strength"), F.lit(2).alias("hops"))
    return direct.unionByName(best)


def explore(adjacent: DataFrame, seed, limit: int = fixed.EXPLORE_LIMIT, second: int = fixed.SECOND_HOP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(direct neighbours, two-hop nodes by product): per neighbour the best few, without the seed and its neighbours."""
    near = direct_edges(adjacent, seed, limit)
    onward = adjacent.join(F.broadcast(near.select(F.col("other").alias("node"), F.col("weight").alias("first"))), "node")  # at most `limit` rows
    all_near = adjacent.filter(F.col("node") == F.lit(seed)).select("other")
    onward = onward.filter(F.col("other") != F.lit(seed)).join(all_near, "other", "left_anti")
    ranked = onward.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy(F.col("weight").desc(), "other"))).filter(F.col("_n") <= second)
    far = ranked.select(F.col("node").alias("via"), "other", (F.col("first") * F.col("weight")).alias("strength")).orderBy(F.col("strength").desc(), "via", "other").limit(limit)
    return near, far


def mine_one_hop(store: DataFrame, n: int, seed: str = "one") -> DataFrame:
    """n edges in the order of a seeded hash."""
    return store.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "a", "b")), "a", "b").limit(n)


def mine_two_hop(store: DataFrame, hub_degree: int = fixed.HUB_DEGREE, seed: str = "two") -> DataFrame:
    """via, a, b: for each middle node of 2 to hub_degree - 1 neighbours one pair of them without an edge; a pair once."""
    adjacent = adjacency(store)
    middle = adjacent.groupBy("node").agg(F.count("*").alias("d")).filter((F.col("d") >= 2) & (F.col("d") < hub_degree)).select("node")
    arms = adjacent.join(middle, "node", "left_semi")
    pairs = arms.select("node", F.col("other").alias("a")).join(arms.select("node", F.col("other").alias("b")), "node").filter("a < b")
    open_pairs = pairs.join(store.select("a", "b"), ["a", "b"], "left_anti")
    key = F.md5(F.concat_ws("|", F.lit(seed), "node", "a", "b"))
    one = open_pairs.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("_k", "a", "b"))).filter("_n = 1")
    return one.withColumn("_m", F.row_number().over(Window.partitionBy("a", "b").orderBy("node"))).filter("_m = 1").select(F.col("node").alias("via"), "a", "b")


def mine_no_path(store: DataFrame, n: int) -> DataFrame:
    """a from the largest component, b from any other, paired by rank."""
    nodes = adjacency(store).select("node").distinct()
    found = connected_components(nodes, store.select("a", "b"))
    sized = found.withColumn("size", F.count("*").over(Window.partitionBy("root")))
    largest = sized.orderBy(F.col("size").desc(), "root").limit(1).select(F.col("root").alias("_r"))
    marked = sized.join(F.broadcast(largest), F.col("root") == F.col("_r"), "left")  # one row
    inside = marked.filter(F.col("_r").isNotNull()).orderBy("node").limit(n).select("node", F.row_number().over(Window.orderBy("node")).alias("i"))
    outside = marked.filter(F.col("_r").isNull()).orderBy("node").limit(n).select("node", F.row_number().over(Window.orderBy("node")).alias("i"))
    return inside.select(F.col("node").alias("a"), "i").join(outside.select(F.col("node").alias("b"), "i"), "i").select("a", "b")


def cited_facts(edges: DataFrame) -> DataFrame:
    """edges(src, dst, relation, weight, first_sent, last_sent, doc_ids) to src, dst and one sentence with dates and documents."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    span = F.when(F.col("first_sent").isNotNull(), F.concat(F.lit(", "), day("first_sent"), F.lit(" to "), day("last_sent"))).otherwise("")
    cited = F.when(F.col("doc_ids") != "", F.concat(F.lit(", documents "), "doc_ids")).otherwise("")
    return edges.select("src", "dst", F.concat(F.concat_ws(" ", "src", "relation", "dst"), F.lit(" (weight "), F.col("weight").cast("string"), span, cited, F.lit(")")).alias("fact"))
