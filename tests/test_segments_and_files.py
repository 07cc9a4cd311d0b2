import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import clusters, forest
from millrace.plans import anomaly
from millrace.plans import segmentation as sg
from millrace.sources import landing, sinks, tables


def blobs(spark, n=200):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.5, size=(n, 4)) for c in (0, 6, 12)])
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf.insert(0, "id", np.arange(len(pdf)))
    return spark.createDataFrame(pdf).repartition(5)


def test_three_blobs(spark):
    report = sg.run_segmentation(blobs(spark))
    assert report.k == 3 and report.method == "data_driven_silhouette"
    assert sorted(r["count"] for r in report.scored.groupBy("cluster").count().collect()) == [200, 200, 200]
    assert report.scored.where("is_outlier").count() == 18 and report.points().count() == 600
    assert sum(report.explained) > 0.9 and report.correlation.count() == 16


@pytest.mark.parametrize("rows, k", [(2, 2), (4, 3), (15, 4)])
def test_small_tables_clamp_k(spark, rows, k):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(rows, 2)), columns=["p", "q"]))
    fit = clusters.assemble(df, ["p", "q"]).persist()
    assert clusters.choose_k(fit, rows)[:2] == (k, "fallback_default")


def test_planted_outlier_is_first(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(3000, 4)), columns=list("wxyz"))
    pdf.insert(0, "id", np.arange(3000) + 5)
    pdf.iloc[1500, 1:] = 60.0
    df = spark.createDataFrame(pdf)
    report = sg.run_segmentation(df.repartition(6), id_col="id", fit_cap=1000)
    top = report.outlier_records()
    assert top.count() == 100 and top.first()["record_id"] == "1505"
    again = sg.run_segmentation(df.repartition(3), id_col="id", fit_cap=1000)
    assert [r["anomaly_score"] for r in again.outlier_records(5).collect()] == [r["anomaly_score"] for r in report.outlier_records(5).collect()]


def test_forest_has_bounded_trees(spark):
    df = blobs(spark, 2000)
    grown = forest.fit_forest(df, list("abcd"), 7, id_col="id")
    sizes = grown.nodes.groupby("tree").size()
    assert len(sizes) == 7 and sizes.max() <= 511 and grown.sample_rows == 256
    assert forest.average_path(256) == pytest.approx(10.2448, abs=1e-3) and forest.average_path(2) == 1.0
    s = grown.score(df).agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0 < s[0] < s[1] < 1


def test_silhouette_equals_brute_force(spark):
    pdf = blobs(spark, 20).orderBy("id").toPandas()
    labels = np.repeat([0, 1, 1], 20)
    df = clusters.assemble(spark.createDataFrame(pdf.assign(cluster=labels)), list("abcd"))
    x = pdf[list("abcd")].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    widths = []
    for i in range(len(x)):
        own = (labels == labels[i]) & (np.arange(len(x)) != i)
        a, b = d[i, own].mean(), d[i, labels != labels[i]].mean()
        widths.append((b - a) / max(a, b))
    assert clusters.euclidean_silhouette(df.select("features", "cluster")) == pytest.approx(np.mean(widths))


def test_no_numeric_columns(spark):
    with pytest.raises(ValueError):
        sg.segment_features(spark.createDataFrame([("a",)], "s string"))


def test_cluster_job_checks(spark):
    df = blobs(spark, 60).withColumn("word", F.lit("w"))
    with pytest.raises(ValueError):
        sg.cluster_job(df, ["a", "nope"])
    with pytest.raises(TypeError):
        sg.cluster_job(df, ["a", "word"])
    report = sg.cluster_job(df, ["a", "b"], 3).report.first()
    assert report["silhouette_squared"] > 0.7 and report["silhouette_ok"] and report["variance_2d"] == pytest.approx(1.0)


def test_contextual_detector(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 1500
    pdf = pd.DataFrame({"row_index": np.arange(n), "store_type": rng.choice(["Mall", "Strip", "Street"], n), "promo_flag": rng.integers(0, 2, n),
                        "temperature": rng.normal(20, 3, n)})
    base = 100 + 50 * (pdf.store_type == "Mall") + 30 * pdf.promo_flag
    truth = rng.random(n) < 0.05
    pdf["units_sold"] = np.where(truth, base * 4, base + rng.normal(0, 3, n))
    df = spark.createDataFrame(pdf)
    labels = spark.createDataFrame(pd.DataFrame({"row_index": np.arange(n), "is_anomaly": truth})).repartition(4)
    tables.check_label_guard(df, labels)
    found = anomaly.detect(df, id_col="row_index", trees=60, max_iter=10)
    got = anomaly.evaluate(found.scored, labels).first()
    assert got["recall"] >= 0.85
    with pytest.raises(ValueError):
        tables.check_label_guard(labels, labels)
    path = str(tmp_path / "forest")
    sinks.save_forest(found.forest, path, spark)
    back = sinks.load_forest(path, spark)
    features = found.scored.drop("anomaly_score", "is_outlier")
    assert back.score(features).agg(F.sum("anomaly_score")).first()[0] == pytest.approx(found.scored.agg(F.sum("anomaly_score")).first()[0])


def test_model_store(spark, tmp_path):
    df = clusters.assemble(blobs(spark, 50), list("abcd"))
    model = clusters.kmeans(df, 3)
    sinks.save_model(model, str(tmp_path / "km"))
    back = sinks.load_model(str(tmp_path / "km"))
    assert sorted(map(tuple, back.stages[0].clusterCenters())) == sorted(map(tuple, model.clusterCenters()))


# ---------------------------------------------------------------- files


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_readers(spark, tmp_path):
    latin = put(tmp_path, "latin.csv", "name,n\nZürich,1\n".encode("latin-1"))
    assert tables.probe_encoding(spark, latin) == "ISO-8859-1"
    assert tuple(tables.read_table(spark, latin).first()) == ("Zürich", 1)
    semi = put(tmp_path, "semi.csv", 'a;b\n"x;y";2\nz;3\n')
    assert tables.sniff_delimiter(spark, semi) == ";" and tables.read_table(spark, semi).columns == ["a", "b"]
    tabs = put(tmp_path, "t.tsv", "a\tb\n1\t2\n")
    assert tuple(tables.read_table(spark, tabs).first()) == (1, 2)
    with pytest.raises(tables.UnsupportedFormat):
        tables.read_table(spark, "x.xlsx")


def test_json_sink(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([(1.23456789, pd.Timestamp("2024-01-02").date())], "v double, d date"), str(tmp_path / "out"))
    assert tuple(spark.read.json(str(tmp_path / "out")).select("d", "v").first()) == ("2024-01-02", 1.2346)


def test_landing_audit(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    files = {
        "good.csv": "a,b\n1,2\n", "empty.csv": "", "big.csv": "a\n" + "x" * 5000, "noext": "a", "bad.exe": "a", "pe.csv": b"MZ\x90", "elf.txt": b"\x7fELF",
        "script.tsv": "#!/bin/sh\n", "png.csv": b"\x89PNG\r\n\x1a\nrest", "mach.csv": b"\xca\xfe\xba\xbe0", "nul.csv": b"a,b\n1,\x00\n", "fake.parquet": "abc",
        "fake.xlsx": "abc", "book.xls": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "wide.csv": ",".join(f'"c,{i}"' for i in range(30)) + "\n1\n", "long.csv": "a,b\n" + "y" * 700 + "\n",
        "open.csv": '"a,b\n1,2\n', "bom.csv": b"\xef\xbb\xbfa,b\n1,2\n", "%00.csv": "a", "typed.csv": "a\n1\n", "torn.parquet": b"PAR1xxxx",
    }
    for name, content in files.items():
        put(land, name, content)
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = next((tmp_path / "p").glob("*.parquet")).read_bytes()
    put(land, "rows.parquet", rows)
    manifest = spark.createDataFrame([("typed.csv", "application/pdf"), ("good.csv", "text/csv; charset=utf-8")], "name string, mime string")
    limits = landing.Limits(file_bytes=4000, line_bytes=600, columns=20, parquet_rows=40)
    got = {r["name"]: (r["status"], r["reason"]) for r in landing.audit(spark, str(land), manifest, limits).collect()}
    ok = (200, "ok")
    assert got == {
        "good.csv": ok, "empty.csv": (422, "empty file"), "big.csv": (413, "file too large"), "noext": (415, "no extension"), "bad.exe": (415, "extension not allowed"),
        "pe.csv": (415, "signature of Windows executable"), "elf.txt": (415, "signature of Linux ELF"), "script.tsv": (415, "signature of script"),
        "png.csv": (415, "signature of PNG image"), "mach.csv": (415, "signature of Mach-O executable"), "nul.csv": (415, "null byte in text"),
        "fake.parquet": (415, "not a parquet file"), "fake.xlsx": (415, "not a xlsx file"), "book.xls": ok, "wide.csv": (422, "too many columns"),
        "long.csv": (413, "line too long"), "open.csv": (422, "malformed header"), "bom.csv": ok, "%00.csv": (415, "null byte in file name"),
        "typed.csv": (415, "declared type disagrees with extension"), "torn.parquet": (422, "corrupted Parquet file"), "rows.parquet": (413, "too many Parquet rows"),
    }


def test_landing_audit_takes_a_table_in_parts_as_one(spark, tmp_path):
    land = tmp_path / "a.parquet" / "land"  # only folders under the landing zone are tables
    land.mkdir(parents=True)
    spark.range(50).repartition(3).write.parquet(str(land / "many.parquet"))
    spark.range(30).withColumn("k", F.col("id") % 2).repartition(2).write.partitionBy("k").parquet(str(land / "few.parquet"))
    spark.range(9).repartition(2).write.parquet(str(land / "torn.parquet"))
    put(land / "torn.parquet", "part-9.parquet", b"PAR1xxxx")
    put(land / "few.parquet", "note.csv", "a\n1\n")
    spark.range(60).coalesce(1).write.parquet(str(tmp_path / "p"))
    put(land, "heavy.parquet", next((tmp_path / "p").glob("*.parquet")).read_bytes())
    put(land, "z.csv", "a\n1\n")
    limits = landing.Limits(file_bytes=2000, parquet_rows=40)
    put(land, "wide.csv", "a" * 2001)
    found = landing.audit(spark, str(land), limits=limits).collect()
    assert {r["name"]: (r["status"], r["reason"], r["parquet_rows"]) for r in found} == {
        "many.parquet": (413, "too many Parquet rows", 50), "few.parquet": (200, "ok", 30), "torn.parquet": (422, "corrupted Parquet file", 9),
        "note.csv": (200, "ok", None), "heavy.parquet": (413, "too many Parquet rows", 60), "z.csv": (200, "ok", None), "wide.csv": (413, "file too large", None),
    }
    assert len(found) == 7
    assert {r["name"] for r in landing.audit(spark, f"file://{land}/", limits=limits).collect()} == {r["name"] for r in found}


def test_scatter_cap_has_a_row_for_both_kinds(spark, tmp_path):
    import oracle
    from millrace.catalog import QUERIES

    query = QUERIES["scatter_cap"]
    for name, rows in (("many", 200_000), ("one", 1), ("none", 0)):
        folder = str(tmp_path / name)
        spark.range(rows).select(F.col("id").alias("event_id"), F.col("id").cast("double").alias("value")).write.parquet(f"{folder}/events.parquet")
        con = oracle.connect("")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        assert oracle.compare(query.run(spark, str(folder)), con, query.sql) is None
