"""Leave-one-case-out evaluation."""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import count, islice

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.constants import LABEL
from tapewatch.operators.curves import accumulate, split_by_range, with_rank
from tapewatch.operators.iforest import TREES, distinct_forests, fit_turns, score_turns
from tapewatch.operators.joins import counted_join, is_small
from tapewatch.operators.metrics import top_k
from tapewatch.operators.sampling import SEED, sample_controls
from tapewatch.operators.scaling import model_input
from tapewatch.operators.searched import Wallets
from tapewatch.session import drop_tables, new_path, stage

logger = logging.getLogger(__name__)

# Cases whose scores are written and evaluated together when each is trained by itself, and how many such batches at a time.
TURNS = 16
BATCHES = 8
# Batches that read the same copy of the controls, with the wallets of their cases only, and rows per file of it.
SHARED = 8
FILE_ROWS = 250_000
# Most wallets that the driver holds to count controls against.
SEARCHED = 200_000
# Scores that a double holds exactly.
PLAIN = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)


def leaked_cases(profiles: DataFrame) -> DataFrame:
    """Cases that have wallets with the positive label; wallets without a case do not make one."""
    return profiles.where((F.col(LABEL) == 1) & (F.coalesce("case_id", F.lit("")) != "")).select("case_id").distinct()


def evaluate_cases(scores: DataFrame, score: str, k: int = 20, sample: int | None = None,
                   seed: int = SEED, by: list[str] | None = None, place: str | None = None) -> DataFrame:
    """Precision@k and ROC-AUC of each case's wallets against all controls, or the same `sample` of them.

    With `by`, wallets of a group meet the controls of their group only. The controls are not repeated per case. For ROC-AUC a wallet needs to know how many controls score
    below it, which one running count over all scores tells. For precision@k it needs the controls
    ahead of it, of which only the k best matter.

    `place` names a column of whole numbers in the order of the wallets' names. With it, a single whole number in `by`, both never
    NULL, and few enough wallets with a case, these go to the tasks, which count the controls between them: one pass.
    """
    by = by or []
    known = scores.where(F.col(score).isNotNull())
    named = F.col(place or "taker").alias("taker")
    controls = sample_controls(known, sample, seed, by).select(*by, named, F.col(score).alias("score"))
    wallets = known.where((F.col(LABEL) == 1) & (F.coalesce("case_id", F.lit("")) != "")).select(
        *by, "case_id", named, F.col(score).alias("score"))
    if place is not None and len(by) == 1 and isinstance(controls.schema["score"].dataType, PLAIN):
        few = wallets.limit(SEARCHED + 1).toArrow()
        if few.num_rows <= SEARCHED:
            return _evaluate_searched(controls, few, wallets.schema, k, by[0])
    controls = stage(controls, "controls")

    both = wallets.select(*by, "score", F.lit(0).alias("is_control"), F.lit(1).alias("is_wallet")).unionByName(
        controls.select(*by, "score", F.lit(1).alias("is_control"), F.lit(0).alias("is_wallet")))
    steps = both.groupBy(*by, "score").agg(F.sum("is_control").alias("c"), F.sum("is_wallet").alias("w"))
    parts = split_by_range(steps, "score", by, descending=True)
    below = accumulate(parts, "score", ["c", "w"], by, descending=True).where("w > 0").select(
        *by, "score", "w", "total_c", (2 * (F.col("total_c") - F.col("cum_c")) + F.col("c")).cast("decimal(20,0)").alias("beaten"))
    placed = counted_join(wallets, below, [*by, "score"], parts.where("w > 0").select(*by, "score", "w"), "w")
    # Whole numbers, twice the controls beaten, so that the order of rows does not change the sum.
    pairs = F.nullif(F.max("total_c") * 2.0 * F.count("*"), F.lit(0.0))
    auc = placed.groupBy(*by, "case_id").agg(
        (F.sum("beaten").cast("double") / pairs).alias("roc_auc"), F.count("*").alias("n_wallets"), F.max("total_c").alias("n_controls"))

    best = top_k(controls, "score", k, by).groupBy(*by).agg(F.collect_list(F.struct("score", "taker")).alias("best"))
    window = Window.partitionBy(*by, "case_id").orderBy(F.desc("score"), F.asc("taker"))
    ahead = F.when(F.col("best").isNull(), 0).otherwise(F.size(F.filter("best", lambda c: (c["score"] > F.col("score")) | (
        (c["score"] == F.col("score")) & (c["taker"] < F.col("taker"))))))
    top = wallets.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)
    met = top.join(best, by, "left") if by else top.withColumn("best", best.scalar())
    hits = met.where(F.col("place") + ahead <= k).groupBy(*by, "case_id").agg(F.count("*").alias("hits"))
    size = F.least(F.lit(k), F.col("n_wallets") + F.col("n_controls"))
    return auc.join(hits, [*by, "case_id"], "left").select(
        *by, "case_id", (F.coalesce("hits", F.lit(0)) / size.cast("double")).alias(f"precision_at_{k}"), "roc_auc")


def _evaluate_searched(controls: DataFrame, table: pa.Table, schema: T.StructType, k: int, by: str) -> DataFrame:
    """The metrics of `evaluate_cases` for the wallets of `table`; only counts of controls come back from the tasks."""
    wallets = Wallets(*[table[c].to_numpy() for c in (by, "taker", "score")])
    found = controls.select(by, "taker", F.col("score").cast("double")).mapInArrow(wallets.count, "slot long, n long")
    counts = found.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    metrics = wallets.metrics(counts["slot"].to_numpy(), counts["n"].to_numpy(), table["case_id"].to_pylist(), k)
    columns = T.StructType([
        schema[by], schema["case_id"], T.StructField(f"precision_at_{k}", T.DoubleType()), T.StructField("roc_auc", T.DoubleType())])
    return controls.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array(c) for c in metrics], columns.names), columns)


def _union(parts: list[DataFrame]) -> DataFrame:
    """All parts as one table, halves before wholes, as each union is planned together with what it holds."""
    half = len(parts) // 2
    return _union(parts[:half]).union(_union(parts[half:])) if half else parts[0]


def leave_one_case_out(profiles: DataFrame, train_fn: Callable[[DataFrame], DataFrame], score: str, k: int = 20,
                       refit: bool = False, sample: int | None = None,
                       on_error: Callable[[str, Exception], None] | None = None) -> DataFrame:
    """Train without each case in turn and score its wallets against the controls.

    Models train on control wallets only, which belong to no case, so every turn has the same training
    rows and one training serves all cases. `refit=True` calls `train_fn` per case all the same, with the
    other cases' leaked wallets left out. The scores of `TURNS` cases are written and evaluated together, some such batches
    side by side while the next cases are trained, and dropped once their metrics are written. A case whose training fails is
    logged, passed to `on_error`, and has a row with `error` and no metrics. Each turn scores all controls, so scores to
    evaluate are cases x controls; a score is written with the number of its wallet's place among the names.
    `train_fn` gets profiles and returns (taker, score); labels are taken from the profiles. It is called by one thread.
    """
    spark, labels = profiles.sparkSession, ["taker", LABEL, "case_id"]
    schema = f"case_id string, precision_at_{k} double, roc_auc double, error string"
    if not refit:
        scored = profiles.select(*labels).join(stage(train_fn(profiles).select("taker", score), "scored"), "taker")
        return evaluate_cases(scored, score, k, sample).withColumn("error", F.lit(None).cast("string"))

    # Each turn reads all controls and one case: in this order others are left out, in files that are not too small.
    table, order = stage(profiles, "profiles"), [LABEL, "case_id", "taker"]
    table = stage(table.repartitionByRange(table.count() // FILE_ROWS + 1, *order).sortWithinPartitions(*order), "profiles")
    numbered = with_rank(table.select(*labels), "taker", "place").withColumn("place", -F.col("place"))
    numbered = stage(numbered.where("taker IS NOT NULL"), "numbered")
    small = is_small(numbered)
    path, part, of_case, is_control = new_path(spark, "turns"), count(), F.col("case_id"), F.col(LABEL) == 0
    tags = [F.lit(i).alias("turn") for i in range(TURNS)]
    spark.createDataFrame([], schema).write.parquet(f"{path}/{next(part)}")

    def failed(case: str, error: Exception) -> None:
        logger.warning("case %s: training failed: %s", case, error)
        if on_error is not None:
            on_error(case, error)
        spark.createDataFrame([(case, None, None, str(error)[:1000])], schema).write.parquet(f"{path}/{next(part)}")

    def evaluate(turns: list[tuple[str, DataFrame]], out: str) -> None:
        """Metrics of cases from the scores of their turns."""
        held = F.array(*[F.lit(case) for case, _ in turns])[F.col("turn")]
        wanted = numbered.where(is_control | of_case.isin([case for case, _ in turns]))
        tagged = _union([df.select(tag, "taker", score) for tag, (_, df) in zip(tags, turns)])
        met = tagged.join(F.broadcast(wanted) if small else wanted, "taker").where(is_control | (of_case == held))
        names = ["taker"] if sample is not None else []  # samples are drawn by name
        named = F.when(~is_control, of_case).alias("case_id")  # controls have none
        own, scored = met.select("turn", *names, "place", LABEL, named, score), new_path(spark, "scored")
        try:
            own.write.parquet(scored)
            metrics = evaluate_cases(spark.read.schema(own.schema).parquet(scored), score, k, sample, by=["turn"], place="place")
            metrics.drop("turn").withColumn("error", F.lit(None).cast("string")).write.parquet(out)
        finally:
            drop_tables(spark, [scored])

    def evaluate_batch(turns: list[tuple[str, DataFrame]], outs: list[str]) -> list[tuple[str, Exception]]:
        errors = []
        try:
            evaluate(turns, outs[0])
        except Exception:  # one of them fails when it runs: each by itself
            for turn, out in zip(turns, outs[1:]):
                try:
                    evaluate([turn], out)
                except Exception as error:
                    errors.append((turn[0], error))
        return errors

    def settle(batch: Future) -> None:
        for case, error in batch.result():
            failed(case, error)

    cases = (row.case_id for row in leaked_cases(table).orderBy("case_id").toLocalIterator())
    running: deque[Future] = deque()
    with ThreadPoolExecutor(BATCHES) as pool:
        while together := list(islice(cases, TURNS * SHARED)):
            rows = stage(table.where(is_control | of_case.isin(together)), "profiles")
            for batch in (together[i:i + TURNS] for i in range(0, len(together), TURNS)):
                turns = []
                for case in batch:
                    try:
                        turns.append((case, train_fn(rows.where(is_control | (of_case == case)))))
                    except Exception as error:  # a trainer may fail in any way; the other cases go on
                        failed(case, error)
                if turns:
                    outs = [f"{path}/{next(part)}" for _ in range(len(turns) + 1)]
                    running.append(pool.submit(inheritable_thread_target(spark)(evaluate_batch), turns, outs))
                if len(running) > BATCHES:
                    settle(running.popleft())
        while running:
            settle(running.popleft())
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def leave_one_case_out_forests(profiles: DataFrame, k: int = 20, trees: int = TREES, sample: int | None = None,
                               seed: int = SEED) -> DataFrame:
    """The same with a forest trained anew for each case: all forests are grown by one job and scored by one.

    Equals `leave_one_case_out` with the forest as trainer and `refit=True`. Controls are scored once per forest that
    differs from the others: cases whose forests came out the same share the scores of their controls.
    """
    scaled = model_input(profiles)
    turns = stage(leaked_cases(scaled).select(F.col("case_id").alias("turn")), "turns")
    schema = f"case_id string, precision_at_{k} double, roc_auc double"
    if turns.isEmpty():
        return profiles.sparkSession.createDataFrame([], schema)
    forests, nodes = distinct_forests(stage(fit_turns(scaled, turns, trees=trees), "grown"))
    # Without controls there is no forest, and all cases are scored alike.
    models = turns.join(forests, "turn", "left").select("turn", F.coalesce("forest", F.lit("")).alias("forest"))
    each = models.agg(F.collect_set("forest").alias("each"))
    controls = sample_controls(scaled, sample, seed).withColumn("each", each.scalar()).withColumn(
        "forest", F.explode("each")).drop("each")
    own = scaled.where(F.col(LABEL) == 1).join(models, F.col("case_id") == F.col("turn")).drop("turn")
    rows = controls.unionByName(own).withColumnRenamed("forest", "turn")
    scored = stage(score_turns(rows, nodes.withColumnRenamed("forest", "turn"), keep=("case_id",)), "scored")
    return evaluate_cases(scored, "if_raw", k, by=["turn"]).drop("turn")


def loco_means(results: DataFrame, k: int = 20) -> DataFrame:
    """Mean of the per-case metrics; undefined ones do not count."""
    return results.agg(F.avg(f"precision_at_{k}").alias("mean_precision"), F.avg("roc_auc").alias("mean_roc_auc"))
