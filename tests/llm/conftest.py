import pytest


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    """A checkpoint folder of the test run's own, where the session names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture()
def records(spark):
    """Uploaded document records (``fileId``, ``raw_text``) with a column whose name the operators use inside."""

    def make(rows, id_type="bigint"):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], f"fileId {id_type}, raw_text string, id string")

    return make
