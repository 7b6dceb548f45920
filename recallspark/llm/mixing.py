"""Mixing sources to target weights.

Method: hierarchical budgeting. Weights go down a tree domain - language - source; what a node cannot supply
is taken over by its siblings, and only what they cannot supply by the ancestors' siblings. Each leaf then
yields the token-prefix of its records in seeded order, epoch after epoch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.shared import materialize

#: Domain of each source of this store; sources not named are a domain of their own.
DOMAINS = {
    "session_log": "dialogue", "qa_pair": "dialogue", "chunk_dump": "dialogue",
    "memory_note": "notes", "reflection": "notes", "fact_card": "notes",
    "paper_note": "papers",
}
#: Records per bucket of the seeded order, on average; only one bucket per leaf is summed up record by record.
BUCKET_ROWS = 5_000
MAX_BUCKETS = 65_536


def language(lang: Column) -> Column:
    """The primary language tag in lower case, or ``und``: at most 26^2 + 26^3 + 1 values."""
    tag = F.regexp_extract(F.lower(F.coalesce(lang, F.lit(""))), "^([a-z]{2,3})(?:[-_]|$)", 1)
    return F.when(tag == "", "und").otherwise(tag)


Path = tuple[str, ...]


def share_out(amount: float, weight: Mapping[Path, float], supply: Mapping[Path, float]) -> dict[Path, float]:
    """Budget of each leaf path: ``amount`` by weight, no leaf above its supply.

    A shortage is redistributed among siblings by weight; a parent is only given what its leaves can
    supply together, so what siblings cannot take reaches the next level up.
    """

    def down(leaves: list[Path], depth: int, amount: float) -> dict[Path, float]:
        if len(leaves) == 1:
            return {leaves[0]: min(amount, supply[leaves[0]])}
        groups: dict[str, list[Path]] = defaultdict(list)
        for x in leaves:
            groups[x[depth]].append(x)
        w = {g: sum(weight[x] for x in xs) for g, xs in groups.items()}
        cap = {g: sum(supply[x] for x in xs) for g, xs in groups.items()}
        given: dict[str, float] = {}
        left, still = min(amount, sum(cap.values())), set(groups)
        while still:
            total = sum(w[g] for g in still)
            part = {g: left * (w[g] / total if total > 0 else 1 / len(still)) for g in still}
            short = {g for g in still if part[g] > cap[g]}
            if not short:
                given |= part
                break
            for g in short:
                given[g] = cap[g]
                left -= cap[g]
            still -= short
        out: dict[Path, float] = {}
        for g, xs in groups.items():
            out |= down(xs, depth + 1, given.get(g, 0.0))
        return out

    return down(sorted(weight), 0, amount) if weight else {}


def largest_exact(weight: Mapping[Path, float], supply: Mapping[Path, float]) -> float:
    """The largest amount at which every leaf that has any supply still gets its full share."""
    tiny = share_out(1e-6, weight, {x: float("inf") if s > 0 else 0.0 for x, s in supply.items()})
    bounds = [supply[x] * 1e-6 / b for x, b in tiny.items() if b > 0]
    return min(bounds, default=0.0)


def mixture(
    sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, domains: Mapping[str, str] = DOMAINS, seed: int = 17, of_supply: float | None = None
) -> DataFrame:
    """source, lang, doc_id, n_tokens, n_uses: the records of the mixture and how often each is used.

    ``sizes`` has doc_id, source, lang, n_tokens; ``targets`` has source, target_share, max_repeats. Shares are of
    tokens, and within a source its languages keep their natural proportions. Without ``total_tokens`` the mixture is as large
    as it can be with every source that has records at its share; with it, or with ``of_supply`` (the total as a multiple of
    the tokens of the usable records), sources too small give up to ``max_repeats``
    uses of each record, and the shortage goes to siblings, then further up. A source without records
    counts as a shortage too. The prefix of a leaf ends at the record boundary nearest to its budget. Records of other or null sources and of
    0 or null tokens are not used; a doc_id given twice counts once. Null or non-positive shares and
    repeats count as 0; shares need not sum to 1. No records or no targets give no rows.
    """
    spark = sizes.sparkSession
    want = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    rows = want.collect()  # the configuration: one row per source to be mixed
    share = {r["source"]: max(0.0, r["share"] or 0.0) for r in rows}
    repeats = {r["source"]: max(0, r["repeats"] or 0) for r in rows}
    docs = materialize(
        sizes.select("doc_id", "source", language(F.col("lang")).alias("lang"), F.col("n_tokens").cast("long").alias("n_tokens"))
        .where("doc_id IS NOT NULL AND n_tokens > 0")
        .join(F.broadcast(want.select("source")), "source", "left_semi")
        .groupBy("doc_id")
        .agg(F.min(F.struct("source", "lang", "n_tokens")).alias("r"))
        .select("doc_id", "r.*"),
        "mixture",
    )
    leaves = docs.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()  # sources x languages

    of_source: dict[str, float] = defaultdict(float)
    for r in leaves:
        of_source[r["source"]] += r["tokens"]
    weight: dict[Path, float] = {}
    once: dict[Path, float] = {}
    for s in share:
        if s not in of_source:
            path = (domains.get(s, s), "", s)
            weight[path], once[path] = share[s], 0.0
    for r in leaves:
        path = (domains.get(r["source"], r["source"]), r["lang"], r["source"])
        weight[path], once[path] = share[r["source"]] * r["tokens"] / of_source[r["source"]], float(r["tokens"])
    supply = {x: once[x] * repeats[x[2]] for x in weight}
    if of_supply is not None:
        total_tokens = of_supply * sum(once.values())
    amount = largest_exact(weight, supply) if total_tokens is None else float(total_tokens)
    budget = share_out(amount, weight, supply)

    plan = []
    for (_, lang, source), b in budget.items():
        tokens = once[(domains.get(source, source), lang, source)]
        if tokens > 0:
            epochs = min(int((b + 1e-6) // tokens), repeats[source])
            rest = b - epochs * tokens if epochs < repeats[source] else 0.0
            plan.append((source, lang, epochs, float(rest) + 1e-6))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, lang string, epochs int, rest double"))

    n = sum(r["n"] for r in leaves)
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    draw = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))  # another order in every epoch
    dealt = docs.join(plan_df, ["source", "lang"]).withColumn("draw", draw).withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    leaf = ["source", "lang"]
    sums = dealt.where("rest >= 1").groupBy(*leaf, "bucket", "rest").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).where("before + t > rest").groupBy(*leaf).agg(F.min(F.struct("bucket", "before")).alias("edge"))
    cut = dealt.join(F.broadcast(edge), leaf, "left")  # one row per leaf
    running = F.sum("n_tokens").over(Window.partitionBy(*leaf).orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    at_edge = cut.where("bucket = edge.bucket").withColumn("more", (F.col("edge.before") + running - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    others = cut.where("edge IS NULL OR bucket <> edge.bucket").withColumn(
        "more", F.when((F.col("rest") >= 1) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge.bucket"))), 1).otherwise(0)
    )
    uses = at_edge.unionByName(others).withColumn("n_uses", F.col("epochs") + F.col("more"))
    return uses.where("n_uses > 0").select("source", "lang", "doc_id", "n_tokens", "n_uses")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, reached_share, n_tokens, n_records, n_uses, most_uses: one row for each target."""
    got = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("n_uses")).alias("t"), F.count("*").alias("r"), F.sum("n_uses").alias("u"), F.max("n_uses").alias("m")
    )
    want = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
    both = want.join(got, "source", "left")  # one row per source
    total = F.sum("t").over(Window.partitionBy())
    return both.select(
        "source", "target_share", F.round(F.coalesce(F.col("t"), F.lit(0)) / F.nullif(total, F.lit(0)), 6).alias("reached_share"),
        F.coalesce("t", F.lit(0)).alias("n_tokens"), F.coalesce("r", F.lit(0)).alias("n_records"),
        F.coalesce("u", F.lit(0)).alias("n_uses"), F.coalesce("m", F.lit(0)).alias("most_uses"),
    )
