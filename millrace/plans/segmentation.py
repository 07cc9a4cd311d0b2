"""Segmentation of any table: features, correlations, K-Means, projection, isolation forest, report frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import clean_number, is_number, quoted
from millrace.operators import clusters, forest, frames, matrix, retail, roles
from millrace.operators.order_stats import medians

CONTAMINATION = 0.03
TREES = 10
FIXED_FEATURES = ("promo_flag", "customer_rating", "units_sold")
_VARIANCE_MIN = 1e-12


@dataclass
class SegmentFeatures:
    """Context columns beside prefixed model features, so that neither hides the other."""

    frame: DataFrame
    names: list[str]
    transformed: list[str]
    id_col: str | None

    @property
    def columns(self) -> list[str]:
        return [f"feature:{n}" for n in self.names]


def segment_features(df: DataFrame, id_col: str | None = None) -> SegmentFeatures:
    """Customer RFM for a transaction log with customers, else the numeric columns that vary.

    Skewed columns are log-transformed; NULLs are filled with the exact median.
    """
    cols = retail.rfm_columns(df)
    if cols:
        # One row per customer, read by every later pass; the log itself is scanned once.
        base = retail.customer_rfm(df, cols).persist()
        names = ["Recency", "Frequency", "log1p(Monetary)", "Return Ratio"]
        facts = matrix.column_facts(base, ["Recency", "Frequency", "Return Ratio"])
        logged = [c for c, f in facts.items() if f.skew is not None and f.skew > matrix.SKEW_LIMIT]
        values = {n: quoted(n) for n in names}
        id_col = "CustomerID"
    else:
        base = df
        numbers = [f for f in df.schema.fields if is_number(f)]
        ids = set(roles.id_columns(df))
        chosen = [f for f in numbers if f.name not in ids] or numbers
        if not chosen:
            raise ValueError("No numeric columns available for segmentation.")
        facts = matrix.column_facts(df.select(*[clean_number(f).alias(f.name) for f in chosen]), [f.name for f in chosen])
        total = df.count()
        gappy = {f.name: clean_number(f) for f in chosen if facts[f.name].n < total}
        middle = medians(df, gappy)
        values = {
            f.name: F.coalesce(clean_number(f).cast("double"), F.lit(middle[f.name])) if f.name in gappy else clean_number(f).cast("double")
            for f in chosen
        }
        if gappy:
            filled = df.select(*[v.alias(c) for c, v in values.items()])
            facts = matrix.column_facts(filled, list(values))
        names = [c for c in values if facts[c].variance > _VARIANCE_MIN] or list(values)
        logged = [c for c in matrix.skewed_columns(facts) if c in names]
        if id_col is None:
            id_col = next((c for c in df.columns if c in ids and df.schema[c].dataType.typeName() in ("long", "integer", "string")), None)
    shown = [
        (F.log1p(F.greatest(F.lit(0.0), values[n].cast("double"))) if n in logged else values[n].cast("double")).alias(f"feature:{n}")
        for n in names
    ]
    return SegmentFeatures(base.select(*[quoted(c) for c in base.columns], *shown), names, logged, id_col)


@dataclass
class SegmentReport:
    k: int
    method: str
    silhouettes: dict[int, float]
    features: list[str]
    transformed: list[str]
    correlation: DataFrame
    correlation_truncated: bool
    scored: DataFrame
    cut: float
    explained: list[float]
    model: clusters.Centres
    forest: forest.IsolationForest
    id_col: str | None
    intervals: dict[int, clusters.Silhouette] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    def outlier_records(self, n: int = frames.MAX_RECORDS, keys: Sequence[str] = ()) -> DataFrame:
        """The strangest records; ``keys`` are the columns that name a record where no column does alone."""
        return frames.top_outliers(self.scored.drop("pca_x", "pca_y", "is_outlier"), n=n, fallback_id=self.id_col, keys=keys)

    def points(self, cap: int = frames.MAX_POINTS, seed: int = 42) -> DataFrame:
        picked = frames.scatter_points(self.scored, cap=cap, id_col=self.id_col, seed=seed)
        return picked.select(
            F.round("pca_x", 4).alias("x"), F.round("pca_y", 4).alias("y"), F.col("cluster").alias("cluster_id"), "is_outlier"
        )


def run_segmentation(
    df: DataFrame,
    id_col: str | None = None,
    seed: int = 42,
    trees: int = TREES,
    contamination: float = CONTAMINATION,
    fit_cap: int | None = None,
    sample_rows: int | None = None,
) -> SegmentReport:
    """Every row is assigned, projected and scored. All rows are fitted unless ``fit_cap`` asks for a sample, and all rows decide K
    unless ``sample_rows`` does."""
    feats = segment_features(df, id_col)
    keep = list(dict.fromkeys([*feats.columns, *([feats.id_col] if feats.id_col else [])]))
    # Only the features (and the id) are kept for the passes that follow, not the context columns.
    narrow = feats.frame.select(*[quoted(c) for c in keep]).persist()
    correlation, truncated = matrix.correlation_frame(
        narrow.select(*[quoted(c).alias(n) for c, n in zip(feats.columns, feats.names)]), feats.names
    )
    rows = narrow.count()
    sampled = bool(fit_cap and rows > fit_cap)
    fit_rows = clusters.hash_sample(narrow, fit_cap, feats.id_col, seed).persist() if sampled else narrow
    facts = matrix.column_facts(fit_rows, feats.columns)
    # Only the plain columns are held; what is standardised or assembled from them is computed where it is read.
    ready = matrix.standardise(fit_rows, facts)
    counted = clusters.weighed_vectors(ready, feats.columns, fit_cap if sampled else rows)
    fit = clusters.assemble(ready, feats.columns)
    k, method, scores, model, spans = clusters.choose_k(fit, fit_cap if sampled else rows, feats.id_col, seed, sample_rows, counted)
    grown = forest.fit_forest(ready, feats.columns, trees, seed, feats.id_col)
    fit_scores = grown.score(ready).select("anomaly_score").persist()
    _, cut = forest.flag_outliers(fit_scores, contamination)
    wide = clusters.assemble(matrix.standardise(feats.frame, facts), feats.columns)
    flat, explained = clusters.project_2d(fit, wide, clusters.vector_moments(counted))
    assigned = model.transform(flat).withColumn("cluster", clusters.centroid_order(model))
    # One narrow pass from the source: assigned, projected and scored when the caller reads it.
    scored = grown.score(assigned).drop("features", *feats.columns).withColumn("is_outlier", F.col("anomaly_score") > cut)
    for frame in (fit_scores, narrow, fit_rows, counted):
        frame.unpersist()
    return SegmentReport(
        k, method, scores, feats.names, feats.transformed, correlation, truncated, scored, cut, explained, model, grown, feats.id_col, spans
    )


@dataclass
class ClusterJob:
    clustered: DataFrame
    report: DataFrame
    model: clusters.Centres


def cluster_job(
    df: DataFrame, features: Sequence[str] = FIXED_FEATURES, k: int = 4, seed: int = 42, starts: int = 10,
    silhouette_gate: float = 0.50, variance_gate: float = 0.60, id_col: str | None = None, sample_rows: int | None = None,
) -> ClusterJob:
    """Fixed-feature K-Means (the best of ten starts) and projection with a quality report.

    The gate uses the Euclidean silhouette of all rows, whose samples are doubled until its interval leaves the gate out, or that of
    ``sample_rows`` rows when asked for (then without an interval). The squared one of all rows is reported beside it.
    """
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"Feature columns are missing: {missing}")
    odd = [c for c in features if not is_number(df.schema[c])]
    if odd:
        raise TypeError(f"Feature columns are not numeric: {odd}")
    gappy = {c: clean_number(df.schema[c]) for c in features}
    held = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(v).alias(f"c{i}") for i, v in enumerate(gappy.values())]).first()
    middle = medians(df, {c: v for i, (c, v) in enumerate(gappy.items()) if held[f"c{i}"] < held["n"]})
    filled = df.withColumns({c: F.coalesce(gappy[c].cast("double"), F.lit(m)) for c, m in middle.items()})
    facts = matrix.column_facts(filled, features)
    raw = filled.withColumns({f"_z{i}": quoted(c).cast("double") for i, c in enumerate(features)})
    columns = [f"_z{i}" for i in range(len(features))]
    scaled = matrix.standardise(raw, {f"_z{i}": facts[c] for i, c in enumerate(features)})
    # The runs, the silhouettes and the projection see the features alone, not a row's other columns; few distinct rows are held with their copies.
    counted = clusters.weighed_vectors(scaled, columns, held["n"])
    model = clusters.kmeans_of_starts(scaled, [k], starts, seed, max_iter=300, tol=1e-4, counted=counted)[k]
    flat, explained = clusters.project_2d(scaled, clusters.assemble(scaled, columns), clusters.vector_moments(counted))
    assigned = model.transform(flat)
    placed = model.nearest(counted, "x")
    squared = clusters.squared_silhouette(placed)
    if sample_rows:
        value = clusters.euclidean_silhouette(clusters.hash_sample(assigned, sample_rows, id_col, seed))
        found = None if value is None else clusters.Silhouette(value, None, None)
    else:
        found = clusters.counted_silhouette(placed, silhouette_gate, seed=seed)
    counted.unpersist()
    value, low, high = (None, None, None) if found is None else (found.value, found.low, found.high)
    first, second = explained[0], explained[1] if len(explained) > 1 else 0.0
    report = df.sparkSession.createDataFrame(
        [(k, value, low, high, squared, first, second, first + second, value is not None and value >= silhouette_gate, bool(first + second >= variance_gate))],
        "k int, silhouette double, silhouette_low double, silhouette_high double, silhouette_squared double, variance_1 double, variance_2 double, variance_2d double,"
        " silhouette_ok boolean, variance_ok boolean",
    )
    out = assigned.withColumn("cluster", clusters.centroid_order(model)).drop("features", *columns)
    return ClusterJob(out, report, model)
