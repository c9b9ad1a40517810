"""Shards of near-equal bytes by a distributed k-d tree over metadata of the texts.

All nodes of a level are split together.  A node is split at a weighted median along
its widest axis (range against the range of all rows).  The median is found by
histograms of sums, refined until a bin is light enough; only the histograms reach the
driver, ``BINS`` numbers per node.  Within a value of the axis rows are ordered by a
hash of the text and then by row, so a split exists for any data.  A cut through equal
texts is made only where no axis offers another cut that is balanced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.tables import stored

BINS = 2048
#: Weight by which a cut may miss its target, as a share of a leaf.
TOLERANCE = 0.005
_TOP = (1 << 63) - 1


@dataclass
class Node:
    """A node that is being split: rows of ``id`` whose leading keys equal ``fixed`` and whose next key lies in [low, high]."""

    id: int
    leaves: int
    weight: int
    order: list[int]
    ranges: list[tuple[int, int]]
    axis: int = 0
    fixed: list[int] = field(default_factory=list)
    low: int = 0
    high: int = 0
    target: int = 0
    part_equal: bool = False
    cut: list[int] | None = None

    def begin(self, position: int) -> None:
        self.axis, self.fixed, self.cut = position, [], None
        self.low, self.high = self.ranges[self.order[position]]
        self.target = self.weight * (self.leaves // 2) // self.leaves

    @property
    def step(self) -> int:
        return -(-(self.high - self.low + 1) // BINS)

    def refine(self, sums: dict[int, int], slack: float) -> None:
        """Narrow the range by the sums of its bins, or settle the cut."""
        before = 0
        for b in sorted(sums):
            if before + sums[b] > self.target or b == max(sums):
                break
            before += sums[b]
        start, width, inside, step = self.low + b * self.step, self.step, sums[b], self.step
        rest = self.target - before
        nearer_end = rest * 2 >= inside
        if min(rest, inside - rest) <= slack or (step == 1 and len(self.fixed) == 2):
            self.cut = [*self.fixed, start + width if nearer_end else start]
        elif step > 1:
            self.low, self.high, self.target = start, min(self.high, start + width - 1), rest
        elif len(self.fixed) == 1 and not self.part_equal:
            # The texts of this value are equal: take another axis, the last resort is to part them.
            if self.axis + 1 < len(self.order):
                self.begin(self.axis + 1)
            else:
                self.part_equal = True
                self.begin(0)
        else:
            self.fixed.append(start)
            self.low, self.high, self.target = 0, _TOP, rest


def _cuts(nodes: list[Node], rows: DataFrame, slack: float) -> None:
    spark = rows.sparkSession
    # There is one row of state, and one cut, per node.
    while todo := [n for n in nodes if n.cut is None]:
        state = spark.createDataFrame(
            [(n.id, n.order[n.axis], len(n.fixed), *[*n.fixed, 0, 0][:2], n.low, n.high, n.step) for n in todo],
            "node int, axis int, depth int, f0 long, f1 long, low long, high long, step long",
        )
        keyed = rows.join(F.broadcast(state), "node").withColumn("k0", F.element_at("axes", F.col("axis") + 1))
        key = F.when(F.col("depth") == 0, F.col("k0")).when(F.col("depth") == 1, F.col("text_key")).otherwise(F.col("row"))
        same = ((F.col("depth") < 1) | (F.col("k0") == F.col("f0"))) & ((F.col("depth") < 2) | (F.col("text_key") == F.col("f1")))
        sums: dict[int, dict[int, int]] = {n.id: {} for n in todo}
        binned = keyed.withColumn("key", key).where(same & F.col("key").between(F.col("low"), F.col("high")))
        for r in binned.groupBy("node", F.expr("(key - low) div step").alias("bin")).agg(F.sum("weight").alias("sum")).collect():
            sums[r["node"]][r["bin"]] = r["sum"]
        for n in todo:
            n.refine(sums[n.id], slack)


def kd_leaves(rows: DataFrame, leaves: int, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` (row, text_key, weight, axes array<long>) with their leaf in column ``node``, 0 to leaves - 1 at most."""
    spark = rows.sparkSession
    rows = rows.withColumn("node", F.lit(0))
    open_, numbers = {0: leaves}, {0: 0}
    widths: list[float] | None = None
    slack = 0.0
    next_id = 1
    while any(n > 1 for n in open_.values()):
        axes = len(rows.first()["axes"]) if widths is None else len(widths)
        ends = [f(F.element_at("axes", i + 1)).alias(f"{n}{i}") for i in range(axes) for f, n in ((F.min, "low"), (F.max, "high"))]
        facts = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), *ends).collect()}
        if widths is None:
            widths = [max(facts[0][f"high{i}"] - facts[0][f"low{i}"], 1) for i in range(axes)]
            slack = tolerance * facts[0]["w"] / leaves
        nodes = []
        for number, r in facts.items():
            if open_[number] > 1 and r["n"] > 1:
                ranges = [(r[f"low{i}"], r[f"high{i}"]) for i in range(axes)]
                order = sorted(range(axes), key=lambda i: -(ranges[i][1] - ranges[i][0]) / widths[i])
                nodes.append(Node(number, open_[number], r["w"], order, ranges))
                nodes[-1].begin(0)
            else:
                open_[number] = 1
        if not nodes:
            break
        _cuts(nodes, rows, slack)
        made = []
        for n in nodes:
            made.append((n.id, n.order[n.axis], *[*n.cut, None, None][:3], next_id))
            open_[n.id], open_[next_id] = n.leaves // 2, n.leaves - n.leaves // 2
            next_id += 1
        cuts = spark.createDataFrame(made, "node int, axis int, c0 long, c1 long, c2 long, right int")
        k0 = F.element_at("axes", F.col("axis") + 1)
        below = (k0 < F.col("c0")) | (
            (k0 == F.col("c0")) & ((F.col("text_key") < F.col("c1")) | ((F.col("text_key") == F.col("c1")) & (F.col("row") < F.col("c2"))))
        )
        stays = F.coalesce(below, F.lit(False)) | F.col("right").isNull()
        rows = stored(
            rows.join(F.broadcast(cuts), "node", "left").withColumn("node", F.when(stays, F.col("node")).otherwise(F.col("right")))
            .select("row", "text_key", "weight", "axes", "node"), "leaves",
        )
    return rows


def _positive(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 1)


def shards(docs: DataFrame, target_bytes: int | None = None, count: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text).

    Give the bytes a shard should have, or the number of shards.  ``size`` is the text's
    bytes plus one; a null text has none.  Axes are the size, the bytes beyond one a
    character, and hashes of the text, so equal texts lie together.  ``slot`` counts
    from 0 within a shard.  Repeated rows and null doc_ids are rows like others.  With
    fewer rows than shards some shards are empty; no rows give no rows.  Other columns
    are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    extra = (F.octet_length(text) - F.char_length(text)).cast("long")
    base = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", size.alias("weight"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            _positive(F.xxhash64(text)).alias("text_key"), F.array(size, extra, *[_positive(F.xxhash64(text, F.lit(i))) for i in (1, 2, 3)]).alias("axes"),
        ),
        "sizes",
    )
    total = base.agg(F.sum("weight")).first()[0] or 0
    leaves = count or max(1, math.ceil(total / target_bytes))
    placed = kd_leaves(base.select("row", "text_key", "weight", "axes"), leaves, tolerance) if total else base.withColumn("node", F.lit(0))
    part = F.shiftright("row", 33)
    told = base.select("row", "doc_id", "weight", "text_crc32").join(placed.select("row", "node"), "row").withColumn("part", part)
    before = W.partitionBy("node").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("node", part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("node", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("node", "part").orderBy("row")) - 1
    return told.withColumn("inside", inside).join(offsets, ["node", "part"]).select(
        "doc_id", F.col("weight").alias("size"), "text_crc32", F.col("node").alias("shard"), (F.col("inside") + F.col("before")).cast("long").alias("slot")
    )
