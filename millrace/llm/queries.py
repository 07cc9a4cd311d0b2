"""Registered queries of the text operators: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chunks, decontaminate, language, pages, periodic, pieces, prefixes, quality, simhash, suffixes, surrogates, toxicity

# The key under which surrogates are drawn; a user sets a secret one.
SURROGATE_KEY = "millrace"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op4_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(documents_of(spark, sf_dir), raw_text="text", file_id="doc_id")
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op6_bpe(spark, sf_dir):
    coded = bpe.encode_documents(documents_of(spark, sf_dir), tokenizer_file(), raw_text="text", file_id="doc_id", ids=False, decoded=False)
    return coded.withColumnRenamed("id", "doc_id")


@query
def op8_pii_surrogates(spark, sf_dir):
    docs = documents_of(spark, sf_dir).select("doc_id", "text")
    return surrogates.replace_private_data(docs, SURROGATE_KEY, raw_text="text", file_id="doc_id", count="n_replaced")


def language_models(documents: DataFrame) -> language.LanguageModels:
    return language.learn_languages(documents, raw_text="text", language="lang", file_id="doc_id")


@query
def op9_language_id(spark, sf_dir):
    docs = documents_of(spark, sf_dir)
    found = language.identify_language(docs, language_models(docs), raw_text="text", file_id="doc_id", host="source")
    return found.select(F.col("id").alias("doc_id"), "language", "text_language", F.round("posterior", 6).alias("posterior"), "kept")


@query
def op10_decontamination(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(documents_of(spark, sf_dir), benchmark, raw_text="text", file_id="doc_id", item_id="item_id", item_text="text")
    return found.select(F.col("id").alias("doc_id"), "item_id", "distance", F.round("similarity", 6).alias("similarity"))


@query
def op1_substring_dedup(spark, sf_dir):
    found = chunks.drop_repeated_substrings(documents_of(spark, sf_dir), raw_text="text", file_id="doc_id", texts=False)
    return found.drop("digest").withColumnRenamed("id", "doc_id")


@query
def op3_suffix_array_dedup(spark, sf_dir):
    found = suffixes.drop_repeated_spans(documents_of(spark, sf_dir), raw_text="text", file_id="doc_id", texts=False)
    return found.withColumnRenamed("id", "doc_id")


@query
def op5_toxicity(spark, sf_dir):
    docs = documents_of(spark, sf_dir)
    # Learnt from rows outside the fold that is held out.
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    model = toxicity.learn_toxicity(docs, labels, raw_text="text", file_id="doc_id", label="toxic")
    scored = toxicity.score_toxicity(docs, model, raw_text="text", file_id="doc_id").withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_html_extraction(spark, sf_dir):
    found = pages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), html="html", url="url", page_id="page_id")
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op2_quality_rules(spark, sf_dir):
    judged = quality.judge_quality(documents_of(spark, sf_dir), raw_text="text", file_id="doc_id")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(F.col("id").alias("doc_id"), *base, F.round("posterior", 6).alias("posterior"), "kept")


@query
def op13_sentencepiece(spark, sf_dir):
    import public_tokenizers

    coded = pieces.encode_pieces(documents_of(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), raw_text="text", file_id="doc_id")
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """Documents of which a tenth has its words from some place on repeated with some period, both drawn from the id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    drawn = documents.select("doc_id", "text", (F.floor(h / 10)).alias("g"), (h % 10 == 0).alias("planted"))
    words = F.when(F.col("planted"), F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    cut = drawn.withColumn("words", words).withColumn("n", F.size("words"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    moved = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    text = F.when(F.col("planted") & (F.col("n") > 0), F.array_join(moved, " ")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"))


@query
def op11_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(with_planted_periods(documents_of(spark, sf_dir)), raw_text="text", file_id="doc_id")
    # Runs are in order of start, then period; the first of the greatest exponents is taken.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(told, "\n"), F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def rebuilt_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns in which every conversation begins with the first turns of the one that opens its hundred, and all ids."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("opens"))
    openers = sizes.select(F.col("conv_id").alias("opens"), F.col("n").alias("held"))
    plan = plan.join(openers, "opens", "left").withColumn("given", F.least("h", F.coalesce("held", F.lit(0))))
    first = turns.filter("position < 5").withColumnRenamed("conv_id", "opens")
    given = plan.join(first, "opens").filter(F.col("position") < F.col("given")).select("conv_id", "position", "turn_id")
    own = turns.join(plan, "conv_id").filter(F.col("position") >= F.col("h"))
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("given")).alias("position"), "turn_id")
    return given.unionByName(own), sizes.select("conv_id")


@query
def op12_prefix_trie(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = prefixes.prefix_trie(*rebuilt_conversations(prefixes.number_turns(conversations)))
    return found.withColumnRenamed("saved_chars", "saved_tokens").withColumnRenamed("ends", "ends_sha256")


SQL["op12_prefix_trie"] = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, count(*) AS n,
    -- CRC-32 of the decimal id: every byte is followed by eight steps of one bit.
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
      lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 6 AS h
  FROM turns GROUP BY conv_id
), planned AS (
  SELECT s.conv_id, s.h, s.conv_id - s.conv_id % 100 AS opens, least(s.h, coalesce(o.n, 0)) AS given
  FROM sizes s LEFT JOIN sizes o ON o.conv_id = s.conv_id - s.conv_id % 100
), rebuilt AS (
  SELECT p.conv_id, t.place, t.role, t.text FROM planned p JOIN turns t ON t.conv_id = p.opens AND t.place < p.given
  UNION ALL
  SELECT p.conv_id, t.place - p.h + p.given, t.role, t.text FROM planned p JOIN turns t ON t.conv_id = p.conv_id AND t.place >= p.h
), whole AS (
  SELECT p.conv_id, coalesce(r.ids, []) AS ids, coalesce(r.chars, []) AS chars, len(coalesce(r.ids, [])) AS n
  FROM planned p LEFT JOIN (
    SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY place) AS ids, list(length(text) ORDER BY place) AS chars FROM rebuilt GROUP BY conv_id
  ) r USING (conv_id)
), steps AS (
  SELECT conv_id, n, d AS depth, sha256(array_to_string(ids[1:d], '')) AS path, CASE WHEN d > 0 THEN sha256(array_to_string(ids[1:d - 1], '')) END AS above,
    CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM whole)
), nodes AS (
  SELECT depth, path, above, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS leaf, (count(*) - 1) * max(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends
  FROM steps GROUP BY depth, path, above
), below AS (
  -- Every node under every node on the path of its smallest member.
  SELECT s.depth, s.path, sum(x.saved) AS saved, sum(x.leaf::INT) AS leaves
  FROM nodes x JOIN steps s ON s.conv_id = x.conv_id AND s.depth <= x.depth GROUP BY s.depth, s.path
), children AS (
  SELECT depth - 1 AS depth, above AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.above
LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path
"""
