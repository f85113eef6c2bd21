"""The audits of the graph, each over one scan of its table (API-9, A-13 to A-15).

nodes: name, labels, ticker.  edges: id, src, dst, name, fact.  episodes: name.
Checks are rows (check, key, n): every input row names the counts that it belongs to, and one grouped count adds them all up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph as G
from .filters import is_medium
from .relational import samples

# Words of which several nodes are suspected to be one.
ALIAS_WORDS = ["茅台", "Moutai", "腾讯", "Tencent"]


def _counted(df: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """checks: (name, key, condition)."""
    one = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("check"), F.coalesce(k.cast("string"), F.lit("")).alias("key"))) for n, k, c in checks]
    return df.select(F.inline(F.array_compact(F.array(*one)))).groupBy("check", "key").agg(F.count("*").alias("n"))


def audit_nodes(nodes: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Checks 1, 3, 4 and 8: nodes by first label, tickers of stocks, names of media, and suspected aliases by word and name."""
    label, always = F.get("labels", F.lit(0)), F.lit(True)
    stock, listed = F.array_contains("labels", "Stock"), F.coalesce(F.col("ticker"), F.lit("")) != ""
    checks = [("nodes", F.lit("*"), always), ("nodes by label", label, always), ("ticker", F.when(listed, "with").otherwise("without"), stock), ("media", F.col("name"), is_medium(F.col("name")))]
    checks += [(f"alias {w}", F.col("name"), F.contains(F.lower("name"), F.lit(w.lower()))) for w in (ALIAS_WORDS if words is None else words)]
    return _counted(nodes, checks)


def audit_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Checks 2 and 5: edges by name, PART_OF by the label of its target, labels at both ends."""
    label = F.coalesce(F.get("labels", F.lit(0)), F.lit(""))
    to = nodes.groupBy(F.col("name").alias("dst")).agg(F.min(label).alias("to_label"))  # of nodes of one name the least label
    d = edges.select("name", "src", "dst").join(to, "dst", "left").join(to.toDF("src", "from_label"), "src", "left")
    always, core = F.lit(True), F.upper("name")
    return _counted(d, [("edges", F.lit("*"), always), ("edges by name", core, always), ("PART_OF by target", F.col("to_label"), core == "PART_OF"), ("edges by labels", F.concat_ws("→", F.coalesce("from_label", F.lit("")), F.coalesce("to_label", F.lit(""))), always)])


def audit_pairs(edges: DataFrame) -> DataFrame:
    """Check 6: opposite edges of one name, by name."""
    return G.bidirectional(edges).groupBy(F.col("name").alias("key")).agg(F.count("*").alias("n")).select(F.lit("opposite edges").alias("check"), "key", "n")


def audit_episodes(episodes: DataFrame) -> DataFrame:
    """Check 7: episodes, and how many groups of one hash there are and how many episodes are in them."""
    g = episodes.groupBy(suffix(F.col("name")).alias("s")).agg(F.count("*").alias("n"))
    dup = F.col("n") > 1
    t = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count_if(dup).alias("groups"), F.coalesce(F.sum(F.when(dup, F.col("n"))), F.lit(0)).alias("rows"))
    one = lambda k, c: F.struct(F.lit("episodes").alias("check"), F.lit(k).alias("key"), F.col(c).cast("long").alias("n"))
    return t.select(F.inline(F.array(one("*", "all"), one("groups", "groups"), one("in groups", "rows"))))


def audit(nodes: DataFrame, edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """API-9: all eight checks."""
    return audit_nodes(nodes).unionByName(audit_edges(edges, nodes)).unionByName(audit_pairs(edges)).unionByName(audit_episodes(episodes))


def suffix(name: Column) -> Column:
    """The 12 characters of the content hash that end an episode's name (quirk Q9)."""
    return F.right(name, F.lit(12))


def duplicate_names(episodes: DataFrame, top: int = 20, k: int = 3) -> DataFrame:
    """A-15: (suffix, n, names): the `top` largest groups of episodes of one hash, each with its k least names."""
    d = episodes.select(suffix(F.col("name")).alias("suffix"), "name")
    g = d.groupBy("suffix").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "suffix").limit(top)
    few = samples(d.join(F.broadcast(g.select("suffix")), "suffix", "left_semi"), ["suffix"], "name", k, "names")  # top rows
    return g.join(few, "suffix")
