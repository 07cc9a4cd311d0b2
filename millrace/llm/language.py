"""Language identification by fusing text evidence with declared language, address suffix and host priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.values import quoted
from millrace.llm import common
from millrace.llm.common import blocks, column
from millrace.session import durable

UNDETERMINED = "und"
BUCKETS = 1 << 16
_SMOOTHING = 0.5

# Letters A-Z fold to lower case, bytes of other scripts stay, everything else separates words.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and weight of the byte trigram at each position of the joined texts, and the bounds of each text."""
    parts = [(" " + t.lower() + " ").encode("utf-8", "surrogatepass") if t else b"  " for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    data = _FOLD[np.frombuffer(b"".join(parts) + b"  ", np.uint8)].astype(np.uint32)
    key = ((data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]) * np.uint32(0x9E3779B1)
    # Trigrams without a letter in the middle say nothing about the language; nor do those across texts.
    told = data[1:-1] != 32
    told[bounds[1:] - 1] = False
    return (key >> np.uint32(16)).astype(np.uint16), told, bounds


def _counts(batches):
    """(language, bucket, count) of the trigrams in each partition."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for first, texts in blocks(batch):
            names = column(batch, "label", first, len(texts)).to_pylist()
            bucket, told, bounds = _trigrams(texts)
            for i, name in enumerate(names):
                if name not in held:
                    held[name] = np.zeros(BUCKETS, np.int64)
                span = slice(bounds[i], bounds[i + 1])
                held[name] += np.bincount(bucket[span][told[span]], minlength=BUCKETS)
    for name, n in held.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"label": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})


class LanguageModels:
    """Trigram log probabilities of each language, and a uniform one for text of no known language."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + _SMOOTHING
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(languages) else np.zeros((0, BUCKETS))
        self.logs = np.vstack([logs, np.full((1, BUCKETS), -np.log(BUCKETS))]).astype(np.float32)

    @property
    def names(self) -> list[str]:
        return [*self.languages, UNDETERMINED]


def learn_languages(
    labelled: DataFrame, raw_text: str = "raw_text", language: str = "language", file_id: str = "fileId",
    texts_per_language: int = 400,
) -> LanguageModels:
    """Trigram models from a sample of labelled document records.

    About ``texts_per_language`` texts of every language are drawn by a hash of the id (the bound is a parameter; the sample is the only
    part that is bounded), so the draw does not depend on the partitioning. Rows without a language, text or id are not drawn. Without
    any labelled row there are no languages, and every text is undetermined.
    """
    rows = common.records(labelled, file_id, raw_text, label=language).filter(F.col("label").isNotNull() & (F.col("label") != ""))
    found = rows.groupBy("label").count().collect()  # one row per language
    names = sorted(r["label"] for r in found)
    totals = {r["label"]: r["count"] for r in found}
    if not names:
        return LanguageModels([], np.zeros((0, BUCKETS)))
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    shares = {name: min(1.0, 1.25 * texts_per_language / totals[name]) for name in names}
    limit = F.create_map(*[F.lit(x) for name in names for x in (name, int(shares[name] * 1_000_000))])[F.col("label")]
    sample = rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull() & (draw < limit))
    counted = sample.select("text", "label").mapInArrow(_counts, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), BUCKETS))
    at = {name: i for i, name in enumerate(names)}
    for batch in counted.toArrow().to_batches():  # at most languages x buckets rows
        label, bucket, n = (batch.column(i) for i in range(3))
        counts[[at[x] for x in label.to_pylist()], bucket.to_numpy()] += n.to_numpy()
    return LanguageModels(names, counts)


def text_evidence(documents: DataFrame, models: LanguageModels, temper: float = 3.0) -> DataFrame:
    """``id``, ``digest``, the other columns, and ``evidence``: log likelihood of the whole text under each model.

    ``temper`` divides the sums, because overlapping trigrams are not independent.
    """
    logs = documents.sparkSession.sparkContext.broadcast(models.logs)  # models x buckets, a fixed size
    rest = [f for f in documents.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, T.StructField("evidence", T.ArrayType(T.DoubleType()))])

    def score(batches):
        tables = logs.value
        for batch in batches:
            for first, texts in blocks(batch):
                bucket, told, bounds = _trigrams(texts)
                sums = np.empty((len(texts), len(tables)))
                for k, table in enumerate(tables):
                    at = np.where(told, table[bucket], np.float32(0))
                    sums[:, k] = np.add.reduceat(at, bounds[:-1], dtype=np.float64) / temper
                columns = [column(batch, f.name, first, len(texts)) for f in rest]
                values = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*columns, values], names=[f.name for f in schema.fields])

    return documents.mapInArrow(score, schema)


def _best(scores: Column, names: list[str]) -> Column:
    """Name of the highest score; ties go to the first name. Without any language it is undetermined."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(scores, F.array_max(scores)).cast("int"))


def _shares(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row per key with the number of its texts in each language."""
    counts = [F.sum((F.col("text_language") == n).cast("double")) for n in names]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*counts).alias(f"{key}_counts"))


def _blend(counts: Column, above: Column, weight: float) -> Column:
    """Shares of a level, pulled towards the level above with the weight of ``weight`` texts; NULL counts take that level."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(counts.isNull(), above).otherwise(F.zip_with(counts, above, lambda n, p: (n + weight * p) / (total + weight)))


def identify_language(
    documents: DataFrame, models: LanguageModels, raw_text: str = "raw_text", file_id: str = "fileId", host: str | None = None,
    url: str | None = None, declared: str | None = None, least_posterior: float = 0.5, prior_weight: float = 20.0,
) -> DataFrame:
    """Language of every document record by Bayesian fusion.

    The log posterior of a language is the sum of the text's tempered log likelihood (byte trigrams), of what the declared markup
    language says (``declared``, e.g. an ``html lang``), of what the address suffix says (last label of the host in ``url``), and
    of a prior of the host. The last three are learnt by grouped aggregation over all records from the languages that the texts
    alone show: declarations and suffixes as smoothed conditional shares; priors as shares of the host, smoothed towards its site
    (last two labels), which is smoothed towards all records.

    Returns one row per record: ``id``, ``digest`` (of the text), ``language``, ``text_language``, ``posterior`` and ``kept``.
    ``kept`` is false when the language is undetermined (``und``) or the posterior is under ``least_posterior``. NULL and empty
    texts and texts without letters have no evidence and are undetermined with posterior 0. NULL hosts take the overall prior. NULL
    ids and repeated rows stay as they are. An empty table gives an empty result. Ties go to the first language name. The records
    of the source project carry no markup language or address, so these columns are optional.
    """
    names = models.names
    host_of = F.lit(None).cast("string")
    if url is not None:
        host_of = F.lower(F.parse_url(quoted(url), F.lit("HOST")))
    if host is not None:
        host_of = F.coalesce(host_of, quoted(host).cast("string")) if url is not None else quoted(host).cast("string")
    parts = F.split(host_of, r"\.")
    site = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    suffix = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    spoken = F.lower(F.regexp_extract(quoted(declared).cast("string"), "^[A-Za-z]{2,3}", 0)) if declared is not None else F.lit(None).cast("string")
    rows = documents.select(
        quoted(file_id).alias("id"), quoted(raw_text).cast("string").alias("text"),
        common.digest(quoted(raw_text).cast("string")).alias("digest"), host_of.alias("host"), site.alias("site"), suffix.alias("suffix"),
        F.when(spoken != "", spoken).alias("declared"),
    )
    scored = durable(text_evidence(rows, models)).withColumn("text_language", _best(F.col("evidence"), names))
    scored = scored.withColumn("told", F.element_at("evidence", -1) < 0)
    known = scored.filter("told")
    totals = {r["text_language"]: r["count"] for r in known.groupBy("text_language").count().collect()}  # one row per language
    n = sum(totals.values())
    overall = F.array(*[F.lit((totals.get(x, 0) + 1.0) / (n + len(names))) for x in names])
    joined = scored
    for key, used in (("host", host or url), ("site", host or url), ("suffix", url), ("declared", declared)):
        if used is not None:
            joined = joined.join(_shares(known, key, names), key, "left")
        else:
            joined = joined.withColumn(f"{key}_counts", F.lit(None).cast("array<double>"))
    prior = _blend(F.col("host_counts"), _blend(F.col("site_counts"), overall, prior_weight), prior_weight)
    logs = F.zip_with("evidence", prior, lambda a, p: a + F.log(p))
    for key in ("suffix", "declared"):  # P(sign | language) is in proportion to P(language | sign) / P(language)
        sign = F.zip_with(_blend(F.col(f"{key}_counts"), overall, prior_weight), overall, lambda p, o: F.log(p / o))
        logs = F.zip_with(logs, sign, lambda a, s: a + s)
    ranked = joined.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    posterior = 1.0 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    language = F.when(F.col("told"), _best(F.col("logs"), names)).otherwise(UNDETERMINED)
    decided = ranked.select(
        "id", "digest", language.alias("language"), F.when(F.col("told"), F.col("text_language")).otherwise(UNDETERMINED).alias("text_language"),
        F.when(F.col("told"), posterior).otherwise(0.0).alias("posterior"),
    )
    return decided.withColumn("kept", (F.col("language") != UNDETERMINED) & (F.col("posterior") >= least_posterior))


def keep_identified(documents: DataFrame, models: LanguageModels, raw_text: str = "raw_text", file_id: str = "fileId", **options) -> DataFrame:
    """The document records whose language was identified, all columns unchanged; see :func:`identify_language`."""
    decided = identify_language(documents, models, raw_text, file_id, **options)
    return common.drop_rows(documents, decided.filter(~F.col("kept")).select("id", "digest").distinct(), file_id, raw_text)
