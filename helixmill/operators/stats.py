"""Counts, distributions and entropies of reads and qualities."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.quality import error_probability, phred
from helixmill.functions.seq import xlog2x

LOG2_3 = math.log2(3)
#: Fixed value: bits for the kind of a substitution that is of the frequent kind with probability 0.7.
KIND_BITS = -(0.3 * math.log2(0.15) + 0.7 * math.log2(0.7))


def read_stats(reads: DataFrame) -> DataFrame:
    n = F.length("seq")
    return reads.groupBy("mate").agg(
        F.count("*").alias("reads"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.sum(n).alias("bases"), F.count_if(F.contains("seq", F.lit("N"))).alias("n_reads"), F.count_if(~F.contains("seq", F.lit("N"))).alias("clean_reads")
    )


def length_histogram(reads: DataFrame, longest: int = 511) -> DataFrame:
    return reads.where(F.length("seq") <= longest).groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("reads"))


def quality_cells(reads: DataFrame, qual: str = "qual") -> DataFrame:
    """One row per quality symbol: ``col`` from 0, ``q``, and the next two values ``q1``, ``q2`` (null past the end)."""
    cells = reads.where(F.col(qual).isNotNull()).select("read_idx", phred(qual).alias("qs"))
    per = cells.select("read_idx", "qs", F.posexplode("qs").alias("col", "q"))
    return per.select("read_idx", "col", "q", F.get("qs", F.col("col") + 1).alias("q1"), F.get("qs", F.col("col") + 2).alias("q2"))


def markov_counts(reads: DataFrame) -> DataFrame:
    """Counts of (column, previous value, value); the previous of column 0 is 0."""
    cells = reads.where("qual is not null").select(phred("qual").alias("qs")).select("qs", F.posexplode("qs").alias("col", "cur"))
    prev = F.when(F.col("col") > 0, F.get("qs", F.col("col") - 1)).otherwise(0)
    return cells.groupBy("col", prev.alias("prev"), "cur").agg(F.count("*").alias("cnt"))


def marginal_entropy(counts: DataFrame) -> DataFrame:
    """Entropy of the values in each column, from ``markov_counts``."""
    per = counts.groupBy("col", "cur").agg(F.sum("cnt").alias("c"))
    # entropy = log2 n - sum(c log2 c) / n: one pass, no window
    return per.groupBy("col").agg(F.sum("c").alias("n"), F.sum(xlog2x(F.col("c").cast("double"))).alias("s")).select("col", (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def order_entropies(reads: DataFrame) -> DataFrame:
    """Entropy per read of qualities at order 0, 1, 2 (one row), from joint counts of one, two and three symbols.

    l_k(col) is the joint entropy of k + 1 symbols from a column on. Order 0 is the sum of l0; order 1 is the sum of l1
    less l0 plus the first l0; order 2 the sum of l2 less l1 plus the first l1, each over the columns that have both.
    One aggregate of the symbols by three serves all orders.
    """
    three = quality_cells(reads).groupBy("col", "q", "q1", "q2").agg(F.count("*").alias("c"))
    two = three.groupBy("col", "q", "q1").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("q2").isNotNull(), xlog2x(F.col("c").cast("double")))).alias("s2"), F.sum(F.when(F.col("q2").isNotNull(), F.col("c"))).alias("n2"))
    known = F.col("q1").isNotNull()
    one = two.groupBy("col", "q").agg(F.sum("c").alias("c"), F.sum("s2").alias("s2"), F.sum("n2").alias("n2"), F.sum(F.when(known, xlog2x(F.col("c").cast("double")))).alias("s1"), F.sum(F.when(known, F.col("c"))).alias("n1"))
    per = one.groupBy("col").agg(F.sum("c").alias("n0"), F.sum(xlog2x(F.col("c").cast("double"))).alias("s0"), *[F.sum(x).alias(x) for x in ("n1", "s1", "n2", "s2")])
    joint = per.select("col", *[(F.log2(f"n{k}") - F.col(f"s{k}") / F.col(f"n{k}")).alias(f"l{k}") for k in range(3)])
    first = lambda c: F.max(F.when(F.col("col") == 0, F.col(c)))
    step = lambda a, b: F.sum(F.when(F.col(a).isNotNull(), F.col(a) - F.col(b)))
    return joint.agg(F.sum("l0").alias("order0"), (step("l1", "l0") + first("l0")).alias("order1"), (step("l2", "l1") + first("l1")).alias("order2"))


def order_counts(reads: DataFrame, group: str, order: int) -> DataFrame:
    """Counts of ``order`` + 1 neighbouring values per group and column: ``q``, ``q1``, ``q2`` as far as the order goes."""
    names = ["q", "q1", "q2"][: order + 1]
    cells = reads.where("qual is not null").select(group, phred("qual").alias("qs")).select(group, "qs", F.posexplode("qs").alias("col", "q"))
    cells = cells.select(group, "col", "q", F.get("qs", F.col("col") + 1).alias("q1"), F.get("qs", F.col("col") + 2).alias("q2"))
    return cells.where(F.col(names[-1]).isNotNull()).groupBy(group, "col", *names).agg(F.count("*").alias("cnt"))


def error_by_position(reads: DataFrame) -> DataFrame:
    """Mean error probability of each position."""
    cells = reads.where("qual is not null").select(F.posexplode(phred("qual")).alias("col", "q"))
    counts = cells.groupBy("col", "q").agg(F.count("*").alias("c"))
    return counts.groupBy("col").agg((F.sum(F.col("c") * error_probability(F.col("q"))) / F.sum("c")).alias("p"))


def binary_bits(p: Column) -> Column:
    return -xlog2x(p) - xlog2x(1 - p)


def noise_entropy(by_position: DataFrame) -> DataFrame:
    """Bits of substitution noise per position: three forms of the same sum.

    ``uniform`` adds p * log2 3 for the kind of substitution, ``skewed`` adds the bits of a kind of probability 0.7
    against two of 0.15, ``subtracted`` takes p * log2 3 away (the form of the lower bound).
    """
    h, p = binary_bits(F.col("p")), F.col("p")
    return by_position.select("col", (h + p * LOG2_3).alias("uniform"), (h + p * KIND_BITS).alias("skewed"), (h - p * LOG2_3).alias("subtracted"))


def joint_noise_entropy(reads: DataFrame, group: str | None = None) -> DataFrame:
    """Bits per read of substitution noise at order 0, 1 and 2, with the skewed kind: one row, or one per ``group``.

    The joint probability that neighbours are wrong is the mean over the reads of the product of their probabilities.
    h_k(col) are the bits of k + 1 neighbours from a column on; order k is the first h_(k-1) plus the sum of the steps
    from h_(k-1) to h_k over the columns that have both.
    """
    by = [group] if group else []
    cells = reads.where("qual is not null").select(*by, phred("qual").alias("qs")).select(*by, "qs", F.posexplode("qs").alias("col", "q"))
    cells = cells.select(*by, "col", "q", *[F.get("qs", F.col("col") + k).alias(f"q{k}") for k in (1, 2)])
    # symbols first: the probabilities are then those of a bounded number of rows per column
    counts = cells.groupBy(*by, "col", "q", "q1", "q2").agg(F.count("*").alias("c"))
    names = ["q", "q1", "q2"]
    sums = []
    for k in range(3):
        full = F.col(names[k]).isNotNull()
        sums.append(F.sum(F.when(full, F.col("c"))).alias(f"n{k}"))
        for wrong in product((0, 1), repeat=k + 1):
            p = F.col("c").cast("double")
            for name, w in zip(names, wrong):
                e = error_probability(F.col(name))
                p = p * (e if w else 1 - e)
            sums.append(F.sum(F.when(full, p)).alias(f"p{k}_" + "".join(map(str, wrong))))
    per = counts.groupBy(*by, "col").agg(*sums)
    bits = []
    for k in range(3):
        h = F.lit(0.0)
        for wrong in product((0, 1), repeat=k + 1):
            p = F.col(f"p{k}_" + "".join(map(str, wrong))) / F.col(f"n{k}")
            h = h - xlog2x(p) + sum(wrong) * p * KIND_BITS
        bits.append(h.alias(f"h{k}"))
    per = per.select(*by, "col", *bits)
    first = lambda c: F.max(F.when(F.col("col") == 0, F.col(c)))
    step = lambda a, b: F.coalesce(F.sum(F.when(F.col(a).isNotNull(), F.col(a) - F.col(b))), F.lit(0.0))
    return per.groupBy(*by).agg(F.sum("h0").alias("order0"), (first("h0") + step("h1", "h0")).alias("order1"), (first("h1") + step("h2", "h1")).alias("order2"))


def noise_of_mixture(reads: DataFrame, group: str) -> DataFrame:
    """Bits per read when each group of reads has its own noise (one row): bits of the group's name, and the groups'
    noise weighted by their reads."""
    share = reads.where("qual <> ''").groupBy(group).agg(F.count("*").alias("n"))
    both = joint_noise_entropy(reads.where("qual <> ''"), group).join(share, group)
    label = F.log2(F.sum("n")) - F.sum(xlog2x(F.col("n").cast("double"))) / F.sum("n")
    return both.agg(label.alias("label_bits"), *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in ("order0", "order1", "order2")])


def mix_distributions(a: DataFrame, b: DataFrame, weight_a: float, weight_b: float, key: str, value: str) -> DataFrame:
    """Weighted sum of two distributions, scaled to a total of 1; a value that one lacks has probability 0 there."""
    both = a.select(key, (F.col(value) * weight_a).alias("_p")).unionByName(b.select(key, (F.col(value) * weight_b).alias("_p")))
    mixed = both.groupBy(key).agg(F.sum("_p").alias(value))
    return renormalise(mixed, key, value)


def renormalise(p: DataFrame, key: str, value: str) -> DataFrame:
    """A distribution scaled to a total of 1; one row of a total of 0 stays."""
    total = p.agg(F.sum(value)).first()[0] or 1.0
    return p.select(key, (F.col(value) / F.lit(float(total))).alias(value))


def read_lower_bound(reads: DataFrame, genome_size: int, genome_bits: float = 2.0) -> DataFrame:
    """Least bits for the reads (one row): noise, genome, and the positions (a multinomial of reads and places)."""
    m_, n_ = F.lit(float(reads.count())), F.lit(float(genome_size))
    noise = noise_entropy(error_by_position(reads)).agg(F.sum("subtracted").alias("noise_bits_per_read"))
    return noise.select(
        m_.alias("m"), n_.alias("n"), "noise_bits_per_read", (F.col("noise_bits_per_read") * m_).alias("noise_bits"), (n_ * genome_bits).alias("genome_bits"), (xlog2x(m_ + n_) - xlog2x(m_) - xlog2x(n_)).alias("position_bits")
    )


def quality_clusters(reads: DataFrame, bounds: list[float]) -> DataFrame:
    """Group of each read by mean quality: the number of the last bound above the mean, or the number of bounds."""
    mean = F.aggregate(phred("qual"), F.lit(0), lambda a, q: a + q) / F.length("qual")
    group = F.lit(len(bounds))
    for i, b in enumerate(bounds):
        group = F.when(F.col("mean_q") < b, i).otherwise(group)
    return reads.where(F.length("qual") > 0).withColumn("mean_q", mean).withColumn("grp", group)


def kl_divergence(p: DataFrame, q: DataFrame, key: str, value: str) -> DataFrame:
    """Divergence of two distributions in bits (one row); null if p has a value that q lacks."""
    both = p.select(key, F.col(value).alias("_p")).join(q.select(key, F.col(value).alias("_q")), key, "left").where("_p > 0")
    return both.agg(F.when(F.count("*") == F.count("_q"), F.sum(F.col("_p") * F.log2(F.col("_p") / F.col("_q")))).alias("bits"))


def stream_sizes(reads: DataFrame) -> DataFrame:
    """Bytes of each stream of the reads before storage."""
    n = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    one = reads.agg(n("id").alias("id"), n("seq").alias("read"), n("qual").alias("quality"))
    return one.select(F.explode(F.map_from_arrays(F.array(F.lit("id"), F.lit("read"), F.lit("quality")), F.array("id", "read", "quality"))).alias("stream", "bytes"))
