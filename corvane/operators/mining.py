"""Mining of change history: churn, coupling, owners, ranking by integer PageRank, stops, ledgers.

baskets: commit, author, is_fix, path (a row for each file of a commit), position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..plans.scratch import Tables
from .territory import mode

LEAST_CHURN = LEAST_COUPLING = 2
SCALE, DAMPING, ROUNDS = 1_000_000_000, (85, 100), 64
THIN_COMMITS, THIN_CONCENTRATION = 2, 0.9
CEILING, LOOK_BACK, LEAST_ADMITS = 200, 20, 4


def frontier(baskets: DataFrame) -> DataFrame:
    """path, churn (commits that touch it), coupling (those that touch others too) of the files worth a look."""
    files = baskets.select("commit", "path").distinct()
    wide = files.groupBy("commit").agg(F.count("*").alias("n"))
    rows = files.join(wide, "commit").groupBy("path").agg(F.count("*").alias("churn"), F.count_if(F.col("n") >= 2).alias("coupling"))
    return rows.where((F.col("churn") >= LEAST_CHURN) | (F.col("coupling") >= LEAST_COUPLING))


def signals(baskets: DataFrame) -> DataFrame:
    """path, churn, fixes, owner (most frequent author), authors."""
    rows = baskets.select("commit", "path", "author", "is_fix").distinct()
    n = rows.groupBy("path").agg(F.countDistinct("commit").alias("churn"), F.countDistinct(F.when(F.col("is_fix"), F.col("commit"))).alias("fixes"), F.countDistinct("author").alias("authors"))
    return n.join(mode(rows, "path", "author").withColumnRenamed("author", "owner"), "path", "left")


def co_changed(baskets: DataFrame, paths: DataFrame | None = None, support: int = 2) -> DataFrame:
    """path, other, support: files that change together with the given ones (all if None), from `support` commits on.

    For all files a pair is counted once, path before other, and turned round after the count.
    """
    files = baskets.select("commit", "path").distinct()
    if paths is None:
        pairs = files.join(files.withColumnRenamed("path", "other"), "commit").where("path < other")
        pairs = pairs.groupBy("path", "other").agg(F.count("*").alias("support")).where(F.col("support") >= support)
        both = F.explode(F.array(F.struct("path", "other"), F.struct(F.col("other").alias("path"), F.col("path").alias("other"))))
        return pairs.select(both.alias("p"), "support").select("p.path", "p.other", "support")
    asked = files.join(paths.select("path").distinct(), "path", "left_semi")
    pairs = asked.join(files.withColumnRenamed("path", "other"), "commit").where("path <> other")
    return pairs.groupBy("path", "other").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def concentration(lines: DataFrame) -> DataFrame:
    """One row, concentration: the largest part of all lines (commit) that one commit wrote; 0 without lines."""
    n = lines.groupBy("commit").agg(F.count("*").alias("n")).agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    return n.select(F.coalesce(F.col("m") / F.col("s"), F.lit(0.0)).alias("concentration"))


def probe(commits: int, shallow: bool, concentrated: float) -> str:
    """Why a history is too thin to be mined; '' if it isn't."""
    if commits < THIN_COMMITS:
        return "low-commit-count"
    if shallow:
        return "shallow-clone"
    return "blame-concentrated" if concentrated >= THIN_CONCENTRATION else ""


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, rounds: int = ROUNDS, scratch=None) -> DataFrame:  # noqa: ANN001
    """node, score: integer personalised PageRank in units of 1 / SCALE.

    Every division rounds down, so the result doesn't depend on the order of additions; what nodes
    without targets hold goes to the seeds (all nodes if there are none).  Nodes that nothing leads to
    have one score if they are seeds and one if not, so those are two numbers, and a target has a count
    of such sources by their kind and number of targets; rounds go over the other nodes and the edges
    between them.  A round is one join and one aggregation; its scores are written, so that no plan
    holds more than one round, and the one number that all nodes need, what nodes without targets hold,
    is observed by the tasks that write, with how many scores moved: where none did, all later rounds
    would give the same, and none is run.  The edges stay dealt by source between rounds.
    """
    scratch = scratch or Tables(nodes.sparkSession)
    out = scratch.table(edges.select("src", "dst").distinct())
    ends = out.select(F.col("src").alias("node"), F.lit(1).alias("n"), F.lit(False).alias("fed")).unionByName(out.select(F.col("dst").alias("node"), F.lit(0).alias("n"), F.lit(True).alias("fed")))
    ends = ends.groupBy("node").agg(F.sum("n").alias("n"), F.bool_or("fed").alias("fed"))
    all_ = nodes.select("node").distinct().join(ends, "node", "left").select("node", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("fed", F.lit(False)).alias("fed"))
    if seeds is not None:
        all_ = all_.join(seeds.select("node").distinct().withColumn("seed", F.lit(True)), "node", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    else:
        all_ = all_.withColumn("seed", F.lit(True))
    all_ = scratch.table(all_)
    total, seeded = all_.agg(F.count("*"), F.count_if("seed")).first()
    if not seeded:
        all_, seeded = all_.withColumn("seed", F.lit(True)), total
    if not total:
        return all_.select("node", F.lit(0).cast("long").alias("score"))
    teleport = SCALE // seeded
    base = (DAMPING[1] - DAMPING[0]) * teleport // DAMPING[1]
    ending, bare_seeds, bare = all_.where("n = 0").agg(F.count("*"), F.count_if(~F.col("fed") & F.col("seed")), F.count_if(~F.col("fed") & ~F.col("seed"))).first()
    of = out.join(all_.withColumnRenamed("node", "src"), "src")
    feeds = of.where("not fed").groupBy("dst", "seed", "n").agg(F.count("*").alias("c"))
    feeds = feeds.groupBy(F.col("dst").alias("node")).agg(F.collect_list(F.struct("seed", "n", "c")).alias("feeds"))
    first = SCALE // total
    scores = scratch.table(all_.where("fed").select("node", "seed", "n", F.lit(first).cast("long").alias("score")).join(feeds, "node", "left"))
    dealt = of.where("fed").select("src", "dst").repartition("src").persist()
    seed, plain, loose = first, first, ending * first  # the scores of a seed and of another node that nothing leads to
    for _ in range(rounds):
        seen = Observation()
        inflow = scores.where("n > 0").select("node", F.expr("score div n").alias("part")).join(dealt, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("inflow"))
        fed = F.expr(f"aggregate(feeds, 0L, (s, f) -> s + f.c * (if(f.seed, {seed}L, {plain}L) div f.n))")
        walk = F.coalesce("inflow", F.lit(0).cast("long")) + F.coalesce(fed, F.lit(0).cast("long")) + F.when(F.col("seed"), loose // seeded).otherwise(0)
        made = scores.join(inflow, "node", "left").withColumn("walk", walk).withColumn("was", F.col("score"))
        made = made.withColumn("score", (F.when(F.col("seed"), base).otherwise(0) + F.expr(f"({DAMPING[0]} * walk) div {DAMPING[1]}")).cast("long"))
        made = made.observe(seen, F.sum(F.when(F.col("n") == 0, F.col("score"))).alias("loose"), F.count_if(F.col("score") != F.col("was")).alias("moved"))
        made = scratch.table(made.select("node", "seed", "n", "score", "feeds"))
        was, seed, plain = (seed, plain), base + DAMPING[0] * (loose // seeded) // DAMPING[1], 0
        loose = (seen.get["loose"] or 0) + bare_seeds * seed + bare * plain
        scratch.drop(scores)
        scores = made
        if not seen.get["moved"] and was == (seed, plain):
            break
    dealt.unpersist()
    unfed = all_.where("not fed").select("node", F.when(F.col("seed"), seed).otherwise(plain).cast("long").alias("score"))
    return scores.select("node", "score").unionByName(unfed)


def marginal_stop(visits: DataFrame, run: str, ceiling: int = CEILING, back: int = LOOK_BACK, least: int = LEAST_ADMITS) -> DataFrame:
    """visits (run, rank, admitted) with visited: ranks before the first stop.

    A run stops at the ceiling, or where the last `back` visits admitted fewer than `least`.
    """
    by = Window.partitionBy(run).orderBy("rank")
    last = F.sum(F.col("admitted").cast("int")).over(by.rowsBetween(-back, -1))
    stop = (F.col("rank") > ceiling) | ((F.col("rank") > back) & (last < least))
    rows = visits.withColumn("_stop", stop)
    first = F.min(F.when(F.col("_stop"), F.col("rank"))).over(Window.partitionBy(run))
    return rows.withColumn("visited", F.coalesce(F.col("rank") < first, F.lit(True))).drop("_stop")


def drive(sites: DataFrame, run: str, ceiling: int = CEILING) -> DataFrame:
    """sites (run, rank, outcome) with state: outcome up to the first fault by rank, then unvisited."""
    first = F.min(F.when(F.col("outcome") == "fault", F.col("rank"))).over(Window.partitionBy(run))
    seen = (F.col("rank") <= F.coalesce(first, F.col("rank"))) & (F.col("rank") <= ceiling)
    return sites.withColumn("state", F.when(seen, F.col("outcome")).otherwise("unvisited"))


def coverage_ledger(planned: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row: planned, recorded, missing, unplanned, duplicates, closes."""
    p = planned.select("site").distinct().withColumn("_p", F.lit(1))
    r = recorded.groupBy("site").agg(F.count("*").alias("n"))
    rows = p.join(r, "site", "full_outer")
    n = rows.agg(
        F.count("_p").alias("planned"), F.coalesce(F.sum("n"), F.lit(0)).alias("recorded"),
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("_p").isNull()).alias("unplanned"),
        F.count_if(F.col("n") > 1).alias("duplicates"),
    )
    return n.withColumn("closes", (F.col("missing") == 0) & (F.col("unplanned") == 0) & (F.col("duplicates") == 0))
