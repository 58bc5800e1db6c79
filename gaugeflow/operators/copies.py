"""Groups of copies: components of links, and the one row of each group that stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import discard, spill
from gaugeflow.streaming.seen import ARCHIVE, LATE, LINK


def components(links: DataFrame, left: str = "r1", right: str = "r2", max_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node of each connected component, for the nodes that occur in links.

    Rounds of smallest-neighbour labels with pointer jumping, each written to the shared folder; ends when no label
    changes. Only minima are shuffled, combined on the map side, so a node with any number of links is no burden.
    """
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v"))
    edges = spill(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = spill(edges.groupBy("u").agg(F.min("v").alias("near")).select(F.col("u").alias("node"), F.least("u", "near").alias("comp")), "labels")
    spilled = [labels]
    for _ in range(max_rounds):
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        target = lower.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        nxt = spill(lower.join(target, "comp", "left").select("node", F.least("comp", F.coalesce("jump", "comp")).alias("comp"), "old"), "labels")
        labels = nxt.select("node", "comp")
        settled = nxt.where(F.col("comp") != F.col("old")).isEmpty()
        for gone in spilled:
            discard(gone)
        spilled = [nxt]
        if settled:
            discard(edges)
            return labels
    raise RuntimeError("components did not settle")


def late_links(output: DataFrame) -> DataFrame:
    """Look late deliveries up in the archive (and among themselves): links to the first delivery of their identifier."""
    ident = ["kind", "space", "a", "b"]
    own = output.where(F.col("tag").isin(LATE, ARCHIVE)).select(*ident, F.col("tag"), F.struct((F.col("tag") == LATE).alias("late"), F.col("r1"), F.col("i1"), F.col("o1")).alias("d"))
    first = own.groupBy(*ident).agg(F.min("d").alias("f"), F.max((F.col("tag") == LATE).cast("int")).alias("any")).where("any = 1")
    late = own.where(F.col("tag") == LATE).drop("tag")
    return late.join(first, ident).where(F.col("d.r1") != F.col("f.r1")).select(F.col("f.r1").alias("r1"), F.col("f.i1").alias("i1"), F.col("f.o1").alias("o1"), F.col("d.r1").alias("r2"), F.col("d.i1").alias("i2"), F.col("d.o1").alias("o2"))


def copies(output: DataFrame) -> DataFrame:
    """(row_id, message_id, stays) of every delivery whose message came more than once.

    ``output`` is the table of the seen-identifier stream. The copy with the latest ingest time stays, then the highest
    offset, then the highest row_id. Deliveries that share no identifier with another are in no group and stay.

    Defined cases: an identifier with a NULL part groups nothing; exact repetitions are told apart by row_id; NULL
    ingest times or offsets rank lowest; an empty table gives an empty result.
    """
    links = output.where(F.col("tag") == LINK).select("r1", "i1", "o1", "r2", "i2", "o2")
    links = spill(links.unionByName(late_links(output)), "links")
    comp = components(links)
    ranks = links.select(F.explode(F.array(F.struct(F.col("i1").alias("i"), F.col("o1").alias("o"), F.col("r1").alias("r")), F.struct(F.col("i2").alias("i"), F.col("o2").alias("o"), F.col("r2").alias("r")))).alias("x")).distinct()
    ranked = ranks.join(comp, F.col("x.r") == F.col("node")).select("comp", "x")
    best = ranked.groupBy("comp").agg(F.max("x").alias("best"))
    return ranked.join(best, "comp").select(F.col("x.r").alias("row_id"), F.col("comp").alias("message_id"), (F.col("x") == F.col("best")).alias("stays"))
