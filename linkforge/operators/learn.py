"""Learned operators: voting dictionaries, logistic and boosted models, two stages out of fold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkforge.operators.blocking import cut
from linkforge.operators.features import featurize, label_pairs
from linkforge.operators.windows import P_CONTEXT, filter_features, p_context, target_side


def vote(pairs: DataFrame, key: str, value: str, least: int, share: float) -> DataFrame:
    """(key, value, n): the most frequent value of a key, if it has ``least`` votes and ``share`` of all."""
    counts = pairs.groupBy(key, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(key)
    ranked = counts.withColumns({"total": F.sum("n").over(own), "rn": F.row_number().over(own.orderBy(F.desc("n"), value))})
    return ranked.where((F.col("rn") == 1) & (F.col("n") >= least) & (F.col("n") / F.col("total") >= share)).select(key, value, "n")


def aligned_tokens(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) tokens at the same place of two token arrays of one length."""
    return pairs.where(F.size(a) == F.size(b)).select(F.explode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("z")).select("z.a", "z.b")


def fit(df: DataFrame, features: list[str], kind: str = "logreg", label: str = "label", trees: int = 400, depth: int = 6, least: int = 40, rate: float = 0.08) -> PipelineModel:
    """A logistic model (``logreg``) or boosted trees (``gbt``) that stop early on a tenth of the rows, by hash of their features."""
    assembled = VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep")
    if kind == "logreg":
        scaled = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
        return Pipeline(stages=[assembled, scaled, LogisticRegression(featuresCol="features", labelCol=label, regParam=1 / max(1, df.count()))]).fit(df)
    boosted = GBTClassifier(featuresCol="raw_features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=least, seed=7, validationIndicatorCol="held", validationTol=0.01)
    return Pipeline(stages=[assembled, boosted]).fit(df.withColumn("held", F.pmod(F.xxhash64(*features), F.lit(10)) == 0))


def predict(model: PipelineModel, df: DataFrame, column: str) -> DataFrame:
    return model.transform(df).withColumn(column, vector_to_array("probability")[1]).drop("raw_features", "features", "rawPrediction", "probability", "prediction")


@dataclass
class TwoStage:
    """A first model of pairs, and a second that also sees the first's probabilities of a query's other candidates."""

    columns: list[str]
    first: PipelineModel
    second: PipelineModel

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` (s1, src, t, features) with p1, its context and p; ``df`` holds all candidates of its queries."""
        return predict(self.second, p_context(predict(self.first, df, "p1")), "p")

    def save(self, path: str) -> None:
        self.first.write().overwrite().save(f"{path}/first")
        self.second.write().overwrite().save(f"{path}/second")
        spark = SparkSession.active()
        spark.createDataFrame([(i, c) for i, c in enumerate(self.columns)], "place int, name string").write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, path: str) -> TwoStage:
        names = SparkSession.active().read.parquet(f"{path}/columns").orderBy("place").collect()
        return cls([r["name"] for r in names], PipelineModel.load(f"{path}/first"), PipelineModel.load(f"{path}/second"))


def fit_two_stage(df: DataFrame, columns: list[str], kind: str = "gbt", folds: int = 2, **settings) -> TwoStage:
    """From labelled pairs (s1, src, t, label, columns): the first stage out of fold by query for the second, then refitted on all rows."""
    fold = df.withColumn("fold", F.pmod(F.xxhash64("s1"), F.lit(folds))).persist()  # each fit reads it
    parts = [predict(fit(fold.where(F.col("fold") != k), columns, kind, **settings), fold.where(F.col("fold") == k), "p1") for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    second = fit(p_context(out.drop("fold")), [*columns, "p1", *P_CONTEXT], "gbt", **{"trees": 300, "depth": 5, "least": 80, "rate": 0.06, **settings})
    first = fit(fold, columns, kind, **settings)
    fold.unpersist()
    return TwoStage(columns, first, second)


#: Columns of the learned blocking filter.
FILTER = ["s_name", "s_addr", "s_cross", "s_tot", "rank", "rank_name", "rank_addr", "g_tot", "g_name", "g_addr", "m_tot", "n_pool", "t_n", "t_margin", "t_rank"]


def fit_filter(pool: DataFrame, truth: DataFrame, kind: str = "gbt", sample: float = 1.0, seed: int = 42, **settings) -> PipelineModel:
    """The filter from the pool pairs of a share of the queries, taken by the hash of their id."""
    own = F.pmod(F.xxhash64("s1", F.lit(seed)), F.lit(10_000)) < sample * 10_000
    return fit(label_pairs(filter_features(pool.where(own)), truth), FILTER, kind, **{"trees": 300, **settings})


def filter_sweep(pool: DataFrame, model: PipelineModel, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, recall, pairs, per_query) of the filter, all thresholds in one job."""
    kept = label_pairs(predict(model, filter_features(pool), "q"), truth)
    passed = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("q"))
    counts = kept.select("label", F.explode(passed).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("pairs"), F.sum("label").alias("hits"))
    totals = truth.select("s1", "tgt").distinct().agg(F.count("*").alias("true_pairs")).join(pool.agg(F.countDistinct("s1").alias("queries")))  # one row each
    return counts.join(totals).select("threshold", (F.col("hits") / F.greatest("true_pairs", F.lit(1))).alias("recall"), "pairs", (F.col("pairs") / F.greatest("queries", F.lit(1))).alias("per_query"))


def build_candidates(pool: DataFrame, model: PipelineModel | None = None, least: float = 0.002, depths: tuple[int, int, int] = (10, 3, 3)) -> DataFrame:
    """The final candidates: pool pairs with q of ``least`` or more, or without a model the fixed cut; with the competition of a target's queries."""
    kept = predict(model, filter_features(pool), "q").where(F.col("q") >= least) if model else cut(filter_features(pool), *depths)
    return target_side(kept)


def score_split(candidates: DataFrame, records: DataFrame, model: TwoStage) -> DataFrame:
    """(s1, src, t, p) of all candidates of a split."""
    return model.predict(featurize(candidates, records)).select("s1", "src", "t", "p")


def compare_models(train: DataFrame, test: DataFrame, columns: list[str], kinds: list[str], **settings) -> DataFrame:
    """(kind, log_loss, accuracy, n): each kind of model, fitted on one table and judged on the other."""
    out = None
    for kind in kinds:
        judged = predict(fit(train, columns, kind, **settings), test, "p")
        p = F.least(F.greatest("p", F.lit(1e-9)), F.lit(1 - 1e-9))
        lost = -(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))
        one = judged.agg(F.lit(kind).alias("kind"), F.avg(lost).alias("log_loss"), F.avg(((F.col("p") >= 0.5).cast("double") == F.col("label")).cast("int")).alias("accuracy"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
