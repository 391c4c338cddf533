"""Query inputs derived from the benchmark tables, always from whole tables.

Variants of a shape are assigned by the remainder of an id; every row keeps one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.constants import CHAT_ROUTE, COMPLETION_ROUTE, TASKS, Task
from tuneloom.operators.chat import chat_lines
from tuneloom.operators.normalize import drop_unusable, normalize_records
from tuneloom.operators.ranks import dense_seq, prefix_aggregates
from tuneloom.operators.splits import train_val_split
from tuneloom.session import stage_table

QUALITY = Task(name="quality", source="documents", train_split="train", test_split="val",
               text_key="text", label_key="quality", labels=("low", "high"),
               template=TASKS["emotion"].template)
LANGUAGE = Task(name="language", source="documents", train_split="train", test_split="val",
                text_key="text", label_text_key="lang", template=TASKS["banking77"].template)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn, the assistant turn right after it, and the system text, if any.

    Pairs are numbered from 0 by conversation and turn, whatever these keys are.
    """
    conv = table(spark, sf_dir, "conversations")
    user = conv.where("role = 'user'").selectExpr("conv_id", "turn", "text AS q",
                                                  "turn + 1 AS next")
    answer = conv.where("role = 'assistant'").selectExpr("conv_id", "turn AS next", "text AS a")
    system = conv.where("role = 'system' AND turn = 0").selectExpr("conv_id", "text AS ctx")
    pairs = user.join(answer, ["conv_id", "next"]).join(system, "conv_id", "left")
    return dense_seq(pairs, ["conv_id", "turn"], "record_id").select("record_id", "q", "a", "ctx")


def sft_raw(spark: SparkSession, sf_dir: str, usable: bool = False) -> DataFrame:
    """The pairs in five loose shapes with all their texts; the last one has no answer and is
    unusable, unless ``usable`` asks for it."""
    shaped = sft_pairs(spark, sf_dir).selectExpr("*", "record_id % 5 AS shape",
                                                 f"shape < 4 OR {usable} AS whole")
    return shaped.selectExpr(
        "record_id", "record_id AS seq",
        "CASE WHEN shape IN (0, 4) THEN q END AS prompt",
        "CASE WHEN shape = 1 THEN q END AS instruction",
        "CASE WHEN shape = 2 THEN q END AS question", "CASE WHEN shape = 1 THEN ctx END AS input",
        "CASE WHEN shape = 0 THEN a END AS completion",
        "CASE WHEN shape = 4 AND whole THEN a END AS response",
        "CASE WHEN shape = 1 THEN a END AS output",
        "CASE WHEN shape = 2 THEN a END AS answer",
        "CASE WHEN shape IN (0, 2, 4) AND whole THEN ctx END AS context",
        "CASE WHEN shape = 3 THEN concat_ws('\\n', ctx, q, a) END AS text")


def training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised conversations and all documents as plain text; documents count below 0."""
    number = -1 - F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        number.alias("record_id"), number.alias("seq"), "text")
    pairs = normalize_records(sft_raw(spark, sf_dir, usable=True))
    return drop_unusable(pairs.unionByName(normalize_records(docs)))


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations as message arrays."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    return (table(spark, sf_dir, "conversations").groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(message)).alias("m"))
            .select(F.col("conv_id").alias("record_id"), "conv_id",
                    F.transform("m", lambda x: F.struct(
                        x["role"].alias("role"), x["content"].alias("content")))
                    .alias("messages")))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stored training log: a run per user, errors are validation rows, some of
    them with a loss that is missing, no number or infinite."""
    events = table(spark, sf_dir, "events")
    counted = prefix_aggregates(events, ["user_id"], "event_id",
                                {"iter": ("sum", F.lit(1).cast("bigint"))})
    val = F.col("event_type") == "error"
    return stage_table(counted.select(
        F.col("user_id").alias("run_id"), F.floor((F.col("iter") - 1) / 5).alias("epoch"),
        "iter", F.when(val, "val").otherwise("train").alias("kind"),
        F.when(val & (F.col("event_id") % 41 == 1), F.lit(None).cast("double"))
        .when(val & (F.col("event_id") % 41 == 2), F.lit(float("nan")))
        .when(val & (F.col("event_id") % 41 == 3), F.lit(float("inf")))
        .otherwise(F.col("value") * F.when(val, 0.5).otherwise(0.02)).alias("loss"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), "ts"), "metrics")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated answers of a base and a tuned run that name a customer's nation.

    Answers are exact, restyled, ambiguous, empty of labels or wrong.
    """
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("gold"))
    other = F.concat(F.lit("NATION_"), ((F.col("c_nationkey") + 1) % 25).cast("string"))
    named = customer.join(nation, "c_nationkey").withColumn("_other", other)

    def run(name: str, kind: Column) -> DataFrame:
        raw = (F.when(kind == 0, F.col("gold"))
               .when(kind == 1, F.concat(F.lower(F.translate("gold", "_", "-")), F.lit(".")))
               .when(kind == 2, F.concat("gold", F.lit(" or "), "_other"))
               .when(kind == 3, F.lit("no idea")).otherwise(F.col("_other")))
        return named.select(
            F.lit(name).alias("run_id"), F.col("c_custkey").alias("seq"), "gold",
            raw.alias("raw"), F.col("c_mktsegment").alias("model"),
            ((F.col("c_custkey") % 10 + 1) / 100).alias("seconds"))

    rest = F.col("c_custkey") % 5
    better = F.when(F.col("c_custkey") % 7 < 4, 0).otherwise(rest)
    return run("base", rest).unionByName(run("fine-tuned", better)).withColumn(
        "row_id", F.concat("run_id", F.lit(":"), F.col("seq").cast("string")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a fixed held-out part, written out as the official splits."""
    rows = (table(spark, sf_dir, "documents")
            .join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
            .select(F.col("doc_id").alias("seq"), "text", "lang", "quality"))
    return stage_table(train_val_split(rows, 0.25, seed=1), "labelled")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as request rows with defaults left out, empty and bad bodies, a truthy
    flag that is no boolean, and unknown routes."""
    conv = F.col("conv_id")
    plain = conv % 5 == 0
    body = F.to_json(F.struct(
        F.when(~plain, F.col("messages")).alias("messages"),
        F.when(plain, chat_lines(F.col("messages"))).alias("prompt"),
        F.when(conv % 3 != 0, conv % 40 + 1).alias("max_tokens"),
        F.when(conv % 3 != 0, (conv % 3 - 1).cast("double")).alias("temperature"),
        F.when(conv % 4 == 0, True).alias("stream")))
    return chat_records(spark, sf_dir).select(
        F.concat(F.lit("r"), F.col("record_id").cast("string")).alias("request_id"),
        F.when(conv % 17 == 0, "/v1/embeddings").when(plain, COMPLETION_ROUTE)
        .otherwise(CHAT_ROUTE).alias("route"),
        F.when(conv % 19 == 0, "").when(conv % 23 == 1, "{")
        .when(conv % 23 == 2, '{"max_tokens": "x"}')
        .when(conv % 23 == 3, '{"prompt": "p", "stream": 1}').otherwise(body).alias("body"))


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model names built from parts: a known alias, or a path that may hint at a size."""
    key = F.col("p_partkey")
    alias = F.element_at(F.array(*[F.lit(a) for a in (
        "phi-3", "llama-3-1b", "llama-3-3b", "qwen-1.5b", "gpt2")]),
        (key % 5 + 1).cast("int"))
    path = F.concat(F.lit("hub/"), F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string"),
                    F.when(key % 2 == 0, "B").otherwise("k"), F.when(key % 3 == 0, "/")
                    .otherwise(""))
    return table(spark, sf_dir, "part").select(
        key.alias("p_partkey"), F.when(key % 10 < 3, alias).otherwise(path).alias("name"))


def context_wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested context lengths per part name."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey"), F.col("p_partkey").cast("string").alias("model"),
        (F.col("p_size") * 100).cast("bigint").alias("requested_len"))


def model_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context limits under either name, zero or missing for some parts."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("model"),
        F.when(key % 3 == 0, F.lit(2048)).when(key % 3 == 1, F.lit(0))
        .cast("bigint").alias("max_position_embeddings"),
        F.when(key % 4 < 2, F.lit(1024)).cast("bigint").alias("n_positions"))
