"""Entity graph: nodes (name, labels, ticker, sector), edges (id, src, dst, name, fact), episodes with edge ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab
from ..sources.tables import written
from .relational import first_per, samples


def khop(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """J-11: distinct edges on undirected paths of up to `hops` edges from start; no edge twice on one path."""
    return khop_of(edges, edges.sparkSession.createDataFrame([(start,)], f"a {edges.schema['src'].dataType.simpleString()}"), hops)


def khop_of(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """J-11 from several nodes (a).

    A shortest path repeats no edge, so an edge is on such a path exactly if one end is fewer than `hops` away.
    Each step joins the frontier's nodes, not its paths, so rows don't multiply; edges and every frontier are written once.
    """
    edges = written(edges, "khop-edges")
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    near = seen = written(starts.distinct(), "khop-near")
    for _ in range(hops - 1):
        near = written(both.join(near, "a", "left_semi").select(F.col("b").alias("a")).distinct().join(seen, "a", "left_anti"), "khop-near")
        seen = seen.union(near)
    ends = seen.distinct()
    by = lambda c: edges.join(ends.withColumnRenamed("a", c), c, "left_semi")
    other = by("dst").join(ends.withColumnRenamed("a", "src"), "src", "left_anti")
    return by("src").unionByName(other).select(*edges.columns)


def distinct_graph(edges: DataFrame) -> DataFrame:
    """A-12: first edge of each (src, dst, upper type)."""
    return first_per(edges.withColumn("_t", F.upper("name")), ["src", "dst", "_t"], ["id"]).drop("_t")


def edge_episodes(episodes: DataFrame, edges: DataFrame) -> DataFrame:
    """J-08: (episode, edge ends) by the edge ids of an episode."""
    e = episodes.select("episode_id", F.explode("entity_edges").alias("id"))
    return e.join(edges.select("id", "src", "dst"), "id")


def episode_entities(episodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A-05, U-02: distinct entities of an episode (quirk Q4: each once)."""
    j = edge_episodes(episodes, edges)
    return j.select("episode_id", F.explode(F.array("src", "dst")).alias("entity")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame, key: str = "name") -> DataFrame:
    """J-12: nodes without edges."""
    ends = edges.select(F.col("src").alias(key)).union(edges.select(F.col("dst").alias(key)))
    return nodes.join(ends, key, "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "name") -> DataFrame:
    """J-17: every node with how many edges it has, 0 too; a loop counts at both ends."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(key)).groupBy(key).agg(F.count("*").alias("degree"))
    return nodes.join(ends, key, "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def bidirectional(edges: DataFrame) -> DataFrame:
    """J-15: pairs of opposite edges of one type, each pair once."""
    f = edges.where("src < dst").select("name", "src", "dst", F.col("id").alias("forward"))
    b = edges.where("src > dst").select("name", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("id").alias("backward"))
    return f.join(b, ["name", "src", "dst"])


def renormalize(edges: DataFrame) -> DataFrame:
    """X-13, X-14: generic and retired names from the fact, if it tells, else from the name; running it again changes nothing.

    An INVOLVES edge whose fact holds one of the loose words that once made it one is judged again by its fact.
    """
    core = S.edge_type(F.col("name"))
    named = F.when(core == "RELATES_TO", F.coalesce(S.edge_type_of_fact(F.col("fact")), core)).otherwise(core)
    return edges.withColumn("name", F.coalesce(_rechecked(), named))


def _rechecked() -> Column:
    """What the fact of an INVOLVES edge with a loose word tells; null for all other edges."""
    loose = (F.col("name") == "INVOLVES") & F.coalesce(F.rlike(F.lower("fact"), F.lit(vocab.LOOSE_FACT)), F.lit(False))
    return F.when(loose, F.coalesce(S.edge_type_of_fact(F.col("fact")), F.lit("RELATES_TO")))


def renormalization_plan(edges: DataFrame) -> DataFrame:
    """X-14: (id, stage, legacy, from_name, name) of edges (id, name, fact): 1 generic names that the fact tells, with what it was once called, 2 loose
    INVOLVES edges, 3 retired names. Edges that stay as they are have no row.
    """
    told = S.edge_type_of_fact(F.col("fact"))
    generic, retired = F.col("name") == "RELATES_TO", F.col("name").isin(*vocab.RETIRED)
    stage = F.when(generic, 1).when(F.col("name") == "INVOLVES", 2).when(retired, 3)
    new = F.when(generic, told).when(retired, F.coalesce(told, F.lit("RELATES_TO"))).otherwise(_rechecked())
    d = edges.select("id", stage.alias("stage"), F.when(generic, S.legacy_edge_type(F.col("fact"))).alias("legacy"), F.col("name").alias("from_name"), new.alias("name"))
    return d.where("name is not null and name <> from_name")


def migration_counts(edges: DataFrame, k: int = 3) -> DataFrame:
    """A-16: (legacy, core, n, samples) of the generic edges' plan, `id: fact` samples by core, and a row without names for the edges kept."""
    d = edges.where("name = 'RELATES_TO'").select("id", "fact", S.edge_type_of_fact(F.col("fact")).alias("core"), S.legacy_edge_type(F.col("fact")).alias("legacy"))
    sample = F.concat(F.left(F.col("id").cast("string"), F.lit(12)), F.lit(": "), F.left(F.coalesce("fact", F.lit("")), F.lit(90)))
    few = samples(d.where("core is not null").select("core", sample.alias("sample")), ["core"], "sample", k)
    return d.groupBy("legacy", "core").agg(F.count("*").alias("n")).join(few, "core", "left").select("legacy", "core", "n", "samples")


def expire(episodes: DataFrame, now, scope: str = "content_scope", at: str = "created_at") -> DataFrame:
    """X-11: what outlives its scope's days goes; other scopes stay."""
    days = F.create_map(*[F.lit(x) for kv in vocab.TTL_DAYS.items() for x in kv])[F.col(scope)]
    return episodes.where(days.isNull() | (F.col(at) >= now - F.make_dt_interval(days)))
