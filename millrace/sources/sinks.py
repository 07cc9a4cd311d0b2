"""Result emission and model storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import clean_number, is_date, quoted, rounded


def presentable(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round floating columns, print dates as ISO text, leave the rest."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(rounded(clean_number(f), digits).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.date_format(quoted(f.name), "yyyy-MM-dd").alias(f.name))
        elif is_date(f):
            out.append(F.date_format(quoted(f.name), "yyyy-MM-dd'T'HH:mm:ss").alias(f.name))
        else:
            out.append(quoted(f.name))
    return df.select(*out)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    presentable(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def save_model(model, path: str) -> None:
    """Any MLlib model, wrapped as a pipeline so that one loader reads all of them."""
    (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_linear(models, path: str, spark) -> None:
    """Linear models (name -> RidgeModel) as a small Parquet table."""
    rows = [(name, list(m.features), list(m.coefficients), m.intercept) for name, m in models.items()]
    schema = "name string, features array<string>, coefficients array<double>, intercept double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_linear(path: str, spark):
    from millrace.operators.matrix import RidgeModel

    return {
        r["name"]: RidgeModel(tuple(r["features"]), tuple(r["coefficients"]), r["intercept"])
        for r in spark.read.parquet(path).collect()
    }


def save_centres(model, path: str, spark) -> None:
    """Cluster centres as a small Parquet table."""
    rows = [(i, list(c), model.cost) for i, c in enumerate(model.points)]
    spark.createDataFrame(rows, "cluster int, centre array<double>, cost double").coalesce(1).write.mode("overwrite").parquet(path)


def load_centres(path: str, spark):
    from millrace.operators.clusters import Centres

    rows = spark.read.parquet(path).orderBy("cluster").collect()
    return Centres(tuple(tuple(r["centre"]) for r in rows), rows[0]["cost"])


def save_forest(forest, path: str, spark) -> None:
    """The node table of an isolation forest with its feature names, as Parquet."""
    from millrace.operators.forest import _NODES

    nodes = spark.createDataFrame(forest.nodes, _NODES)
    nodes.withColumn("features", F.array(*[F.lit(f) for f in forest.features])).withColumn(
        "sample_rows", F.lit(forest.sample_rows)
    ).coalesce(1).write.mode("overwrite").parquet(path)


def load_forest(path: str, spark):
    from millrace.operators.forest import IsolationForest

    table = spark.read.parquet(path).toPandas()
    return IsolationForest(
        tuple(table["features"].iloc[0]), int(table["sample_rows"].iloc[0]),
        table.drop(columns=["features", "sample_rows"]),
    )
