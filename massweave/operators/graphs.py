"""Operators on node and edge tables of many molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.operators.joins import spread


def wl_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Node labels after Weisfeiler-Lehman rounds: a hash of the label and the sorted labels around; ``mol_id, node, label``."""
    both = edges.select("mol_id", "src", "dst").unionByName(edges.select("mol_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    out = nodes.select("mol_id", "node", F.col("label").cast("string").alias("label"))
    for _ in range(rounds):
        near = spread(both).join(spread(out.withColumnsRenamed({"node": "dst", "label": "_l"})), ["mol_id", "dst"]).groupBy("mol_id", F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("_l")), ",").alias("_n"))
        out = out.join(spread(near), ["mol_id", "node"], "left").select("mol_id", "node", F.md5(F.concat_ws("|", "label", F.coalesce("_n", F.lit("")))).alias("label"))
    return out


def wl_hash(nodes: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """One hash for each molecule: of its sorted node labels."""
    return wl_labels(nodes, edges, rounds).groupBy("mol_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list("label")), ",")).alias("graph_hash"))


def boundary(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of each fragment with a neighbour outside, and the cut bonds: ``frag_id, node, outside``."""
    both = edges.select("mol_id", F.col("src").alias("node"), F.col("dst").alias("outside")).unionByName(edges.select("mol_id", F.col("dst").alias("node"), F.col("src").alias("outside")))
    own = members.select("mol_id", "frag_id", F.col("node").alias("outside"))
    return spread(members).join(spread(both), ["mol_id", "node"]).join(spread(own), ["mol_id", "frag_id", "outside"], "left_anti")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, sparsity, redundancy of labels and moments of in- and out-degree for each molecule."""
    n = nodes.groupBy("mol_id").agg(F.count("*").alias("num_nodes"), F.countDistinct("label").alias("num_labels"))
    one = edges.select("mol_id", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select("mol_id", F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    deg = nodes.select("mol_id", "node", F.lit(0).alias("o"), F.lit(0).alias("i")).unionByName(one).groupBy("mol_id", "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    d = deg.groupBy("mol_id").agg(F.sum("o").alias("num_edges"), F.avg("o").alias("out_mean"), F.stddev_pop("o").alias("out_std"), F.avg("i").alias("in_mean"), F.stddev_pop("i").alias("in_std"))
    pairs = F.col("num_nodes") * (F.col("num_nodes") - 1)
    return n.join(d, "mol_id").select("mol_id", "num_nodes", "num_edges", F.when(pairs > 0, 2 * F.col("num_edges") / pairs).otherwise(0.0).alias("sparsity"), (F.col("num_nodes") / F.col("num_labels")).alias("redundancy"), "out_mean", "out_std", "in_mean", "in_std")


def mask_atoms(low: str = "mask_low", high: str = "mask_high"):
    """Atom indices set in two 64-bit halves of a mask."""
    bit = lambda c, i: F.bit_get(F.col(c), i)
    low_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: bit(low, i) == 1)
    high_bits = F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: bit(high, i) == 1), lambda i: i + 64)
    return F.concat(low_bits, high_bits)


def fragment_elements(members: DataFrame, atoms: DataFrame) -> DataFrame:
    """Element counts of each fragment."""
    return members.join(atoms, ["mol_id", "node"]).groupBy("mol_id", "frag_id", "element").agg(F.count("*").alias("n"))
