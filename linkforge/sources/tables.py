"""Scans and sinks: tab-separated entity files, truth lists, caches, pools and results."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.functions.text import address_parts, fold, name_parts
from linkforge.operators import blocking

ENTITY = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def raw_path(folder: str, split: str, source: int) -> str:
    return f"{folder}/{split}_source{source}.tsv"


def read_tsv(spark: SparkSession, path: str, schema: str = ENTITY) -> DataFrame:
    """All strings, no quoting, empty fields as empty strings."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", escape="", encoding="UTF-8")
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in df.columns])


def write_cache(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet with zstd; partitions that are written anew replace their like."""
    writer = df.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_cache(spark: SparkSession, path: str, columns: list[str] | None = None, country: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(F.col("country") == country) if country else df
    return df.select(*columns) if columns else df


def explode_truth(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s1, tgt) pairs, and all s1."""
    ids = wide.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split("matched_entity_ids", ",")).alias("tgt"))
    return ids.where("tgt <> ''"), wide.select(F.col("source1_entity_id").alias("s1"))


def id_lists(pairs: DataFrame, all_s1: DataFrame, column: str) -> DataFrame:
    """One row for each s1: its distinct targets, sorted, comma-joined, else empty."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("tgt")), ",").alias(column))
    return all_s1.join(lists, "s1", "left").select("s1", F.coalesce(column, F.lit("")).alias(column))


def write_id_lists(lists: DataFrame, path: str, position: Column) -> None:
    """One file: header, one row for each s1 in order, no quoting. One task writes it, as the format has one file."""
    lists.orderBy(position).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_samples(df: DataFrame, path: str) -> None:
    """A small report as one tab-separated file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, added to what is there."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def cache_path(folder: str, split: str, source: int) -> str:
    return f"{folder}/{split}_source{source}"


def normalized(raw: DataFrame) -> DataFrame:
    """Normalised records of raw entities (entity_id, business_name, business_address, country)."""
    folded = raw.select("entity_id", "country", fold("business_name").alias("n"), fold("business_address").alias("a"))
    name, addr = name_parts(F.col("n")), address_parts(F.col("a"), F.col("country"))
    return folded.select(
        "entity_id", "country", name["norm"].alias("name_norm"), name["core"].alias("name_core"), name["alt"].alias("name_alt"), name["is_dom"].alias("is_dom"), name["script"].alias("script"),
        addr["addr"].alias("addr_norm"), addr["nums"].alias("addr_nums"), addr["state"].alias("state"),
    )


def preprocess(spark: SparkSession, source: str, target: str) -> None:
    """A raw file, normalised, as zstd Parquet; the commit at the end makes it whole or absent."""
    write_cache(normalized(read_tsv(spark, source)), target)


def load_records(spark: SparkSession, path: str, source: int, country: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Cached records in the engine's columns, of one country or of the given ids (id) only; ``operators.enrich`` turns native names into Latin."""
    df = read_cache(spark, path, country=country)
    df = df.select(
        F.col("entity_id").alias("id"), F.lit(source).alias("src"), "country", F.col("name_norm").alias("name"), F.col("name_core").alias("core"), F.col("name_alt").alias("alt"),
        "is_dom", "script", F.col("addr_norm").alias("addr"), F.col("addr_nums").alias("nums"), "state",
    )
    return df.join(ids, "id", "left_semi") if ids is not None else df


def of_script(records: DataFrame, latin: bool) -> DataFrame:
    """Records whose name is all Latin, or those whose is not."""
    return records.where(F.col("script") == "L" if latin else F.col("script") != "L")


def sample_entities(entities: DataFrame, n: int, seed: int, without: DataFrame | None = None) -> DataFrame:
    """``n`` entities (s1) by the hash of their id, without replacement, none of ``without``."""
    rest = entities.select("s1").distinct()
    rest = rest.join(without.select("s1"), "s1", "left_anti") if without is not None else rest
    return rest.orderBy(F.xxhash64("s1", F.lit(seed)), "s1").limit(n)


def pool_path(folder: str, split: str, depths: tuple[int, int, int]) -> str:
    return f"{folder}/pool_{split}_" + "_".join(map(str, depths))


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_done(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, f"{path}/_DONE")
    return fs.exists(p)


def write_pool(spark: SparkSession, records: DataFrame, path: str, cap: int = 3000, depths: tuple[int, int, int] = (30, 15, 15)) -> list[str]:
    """The pool country by country, each written whole or not at all; countries that are there already are not made again.

    Gives the countries made. A mark says that all are there.
    """
    made = []
    for r in records.select("country").distinct().orderBy("country").collect():  # a row for each country
        own = f"{path}/country={quote(r['country'] or '__none__', safe='')}"
        fs, done = _filesystem(spark, f"{own}/_SUCCESS")
        if not fs.exists(done):
            pool = blocking.retrieve(records.where(F.col("country").eqNullSafe(F.lit(r["country"]))), cap, *depths)
            pool.drop("country").write.mode("overwrite").option("compression", "zstd").partitionBy("src").parquet(own)
            made.append(r["country"])
    fs, mark = _filesystem(spark, f"{path}/_DONE")
    fs.create(mark, True).close()
    return made


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """The whole pool; country and src are its folders."""
    if not is_done(spark, path):
        raise FileNotFoundError(f"{path} is not finished")
    return spark.read.option("basePath", path).parquet(f"{path}/country=*")


@dataclass
class Config:
    """Folders and settings of a run; ``load`` takes JSON over these defaults."""

    data_dir: str = "data"
    cache_dir: str = "cache"
    model_dir: str = "models"
    output_dir: str = "output"
    seed: int = 42
    valid_share: float = 0.2
    df_cap: int = 3000
    pool_depths: tuple[int, int, int] = (30, 15, 15)
    cut_depths: tuple[int, int, int] = (10, 3, 3)
    filter_least: float = 0.002
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Config:
        """From a JSON file that Spark can read; unknown names go to ``extra``."""
        read = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        known = {f.name for f in fields(cls)} - {"extra"}
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in read.items() if k in known}
        return cls(**own, extra={k: v for k, v in read.items() if k not in known} | read.get("extra", {}))

    def path(self, name: str) -> str:
        return f"{self.cache_dir}/{name}"

    def to_dict(self) -> dict:
        return asdict(self)

    def make_folders(self, spark: SparkSession) -> None:
        for folder in (self.cache_dir, self.model_dir, self.output_dir):
            fs, p = _filesystem(spark, folder)
            fs.mkdirs(p)
