"""The registered queries: one per operator, over the whole benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.constants import IGNORE_LABEL
from tuneloom.functions.text import last_segment, word_count
from tuneloom.functions.tokens import ByteTokenizer, PluginTokenizer, WordTokenizer
from tuneloom.functions.tokens import cut_completion as cut_tokens
from tuneloom.functions.tokens import mask_outside, word_spans
from tuneloom.operators import (batching, chat, evalset, generate, lengths, models, normalize,
                                packing, runs, scoring, splits, vocabulary)
from tuneloom.operators import requests as req
from tuneloom.plans import inputs, jobs
from tuneloom.session import stage_path, stage_table
from tuneloom.sources import manifests, records, writers
from tuneloom.streaming import metrics as live
from tuneloom.streaming import prepare as live_prepare
from tuneloom.streaming import requests as live_requests
from tuneloom.streaming import sinks

WORDS = WordTokenizer()
MAX_LEN = 512
BATCH = 4
CREATED = 1_700_000_000
MODEL = "demo"
#: Files of a micro-batch; their number grows with the input, their size does not.
MAX_FILES = 64
#: A vocabulary file; any of its format will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- records -------------------------------------------------------------------

@query
def normalize_sft(spark, sf):
    return normalize.drop_unusable(normalize.normalize_records(inputs.sft_raw(spark, sf))).select(
        "record_id", "kind", "prompt", "completion", "text")


@query
def load_sft_jsonl(spark, sf):
    """The loose rows through a JSON-lines folder and back, numbered in file order."""
    path = stage_path(spark, "landing") + ".jsonl"
    (inputs.sft_raw(spark, sf).repartitionByRange("record_id").sortWithinPartitions("record_id")
     .drop("record_id", "seq").write.json(path))
    return records.load_records(spark, path).select("seq", "kind", "prompt", "completion", "text")


@query
def load_parquet_records(spark, sf):
    loaded = records.load_records(spark, f"{sf}/documents.parquet")
    return loaded.select("seq", "kind", F.md5("text").alias("text_md5"))


@query
def render_sft(spark, sf):
    return normalize.render(inputs.training_records(spark, sf)).select(
        "record_id", "kind", F.md5("rendered").alias("rendered_md5"),
        *_big_of(F.length("rendered"), "n_chars"))


def _big_of(column, name: str) -> list:
    return [column.cast("bigint").alias(name)]


@query
def render_chat_plain(spark, sf):
    return chat.render_chat(inputs.chat_records(spark, sf), "plain").select(
        "record_id", "rendered")


@query
def render_chat_instruct(spark, sf):
    return chat.render_chat(inputs.chat_records(spark, sf), "instruct").select(
        "record_id", "rendered")


@query
def coerce_shape(spark, sf):
    mixed = inputs.sft_raw(spark, sf).drop("seq")
    shaped = normalize.coerce_shape(mixed)
    return shaped.select("record_id", "shape", F.when(F.col("shape") != "json", F.col("text"))
                         .alias("text"))


@query
def coerce_lines(spark, sf):
    """Raw lines with keys that no schema names, next to lines of the known shapes."""
    key = F.col("p_partkey")
    line = F.to_json(F.struct(
        key.alias("p_partkey"), F.col("p_brand").alias("brand"),
        F.when(key % 4 == 1, F.col("p_name")).alias("text"),
        F.when(key % 4 > 1, F.col("p_name")).alias("prompt"),
        F.when(key % 4 == 2, F.col("p_type")).alias("completion"),
        F.struct(F.col("p_size").alias("size"), F.array("p_size", key).alias("ids")).alias("extra")))
    parts = inputs.table(spark, sf, "part").select(
        "p_partkey", F.when(key % 10 == 0, F.lit("no json {")).otherwise(line).alias("value"))
    return normalize.coerce_lines(parts).select("p_partkey", "shape", "text")


@query
def messages_to_pairs(spark, sf):
    return normalize.messages_to_pairs(inputs.chat_records(spark, sf)).select(
        "record_id", "prompt", "completion")


@query
def chat_training_records(spark, sf):
    """Conversations as training records: the loss is on the last answer."""
    rows = inputs.chat_records(spark, sf).withColumn("seq", F.col("record_id"))
    return normalize.drop_unusable(normalize.normalize_records(rows, chat=True)).select(
        "record_id", "kind", "prompt", "completion")


# --- lengths -------------------------------------------------------------------

def _filtered(spark, sf):
    return lengths.filter_for_training(inputs.training_records(spark, sf), WORDS, MAX_LEN)


def _kept_lengths(spark, sf):
    return lengths.with_lengths(lengths.kept(_filtered(spark, sf)), WORDS, MAX_LEN).select(
        "record_id", "seq", "length")


def _document_lengths(spark, sf):
    """Layouts read the lengths several times; the texts are only counted once."""
    docs = inputs.table(spark, sf, "documents")
    return stage_table(docs.select(
        F.col("doc_id").alias("record_id"), F.col("doc_id").alias("seq"),
        F.least(WORDS.count(F.col("text")), F.lit(MAX_LEN)).alias("length")), "lengths")


def _tokens(spark, sf):
    """Token arrays are needed by several passes, so they are staged once."""
    usable = lengths.kept(_filtered(spark, sf))
    return stage_table(batching.tokenize_records(usable, WORDS, MAX_LEN), "tokens")


@query
def filter_for_training(spark, sf):
    return _filtered(spark, sf).select(
        "record_id", "kind", *_big("prompt_tokens", "completion_tokens"), "drop_reason",
        "eos_truncated")


@query
def filter_stats(spark, sf):
    return lengths.filter_stats(_filtered(spark, sf))


@query
def observed_filter(spark, sf):
    """The filter's counts, observed while the kept records are written."""
    observed, observation = lengths.observe_filter(_filtered(spark, sf))
    lengths.kept(observed).write.parquet(stage_path(spark, "kept"))
    counts = observation.get
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} bigint" for c in counts))


@query
def cut_completion(spark, sf):
    """Token rows of the documents cut to what each may have."""
    wish = F.col("doc_id") % 40 - 1
    ids = cut_tokens(WORDS.ids(F.col("text")), wish.cast("int"))
    return inputs.table(spark, sf, "documents").select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"))


@query
def count_tokens(spark, sf):
    return lengths.count_tokens(inputs.training_records(spark, sf), WORDS)


@query
def count_bytes(spark, sf):
    return lengths.count_tokens(inputs.training_records(spark, sf), ByteTokenizer())


@query
def word_counts(spark, sf):
    return inputs.table(spark, sf, "documents").select(
        "doc_id", word_count(F.replace("text", F.lit("e"), F.lit("\u00a0"))).cast("bigint")
        .alias("n_words"))


@query
def plugin_token_counts(spark, sf):
    """A tokenizer of one's own, a callable built once per task: ids of words without regard to
    their case."""
    plugin = PluginTokenizer(lambda: lambda text: [len(w) for w in text.lower().split()], eos_id=2)
    ids = plugin.ids(F.col("text"))
    return inputs.table(spark, sf, "documents").select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"),
        F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@query
def vocabulary_token_counts(spark, sf):
    """Tokens of a learned vocabulary, each distinct piece of the texts encoded once."""
    docs = inputs.table(spark, sf, "documents").select("doc_id", "text")
    return vocabulary.count_by_pieces(docs, vocabulary.RankVocabulary(VOCABULARY), "doc_id")


@query
def packing_stats(spark, sf):
    return lengths.packing_stats(_kept_lengths(spark, sf), MAX_LEN).select(
        "examples", "real_tokens", "naive_padded_tokens", "packed_tokens",
        F.round("waste_naive_pct", 6).alias("waste_naive_pct"),
        F.round("waste_packed_pct", 6).alias("waste_packed_pct"),
        F.round("speedup_vs_naive", 6).alias("speedup_vs_naive"))


@query
def analyze_lengths(spark, sf):
    return lengths.analyze_lengths(_kept_lengths(spark, sf), MAX_LEN, BATCH).select(
        "examples", "real_tokens", *_big("p50_len", "p90_len", "max_len_seen", "naive_tokens"),
        "bucket_tokens", "pack_tokens", F.round("useful_naive", 6).alias("useful_naive"),
        F.round("useful_bucket", 6).alias("useful_bucket"),
        F.round("useful_pack", 6).alias("useful_pack"),
        F.round("pack_gain_over_bucket", 6).alias("pack_gain_over_bucket"), "strategy")


# --- batches -------------------------------------------------------------------

def _count_of(column: str, value: int):
    return F.size(F.filter(column, lambda x: x == value)).cast("bigint")


@query
def mask_labels(spark, sf):
    usable = lengths.kept(_filtered(spark, sf))
    tokens = batching.tokenize_records(usable, WORDS, MAX_LEN)
    return tokens.select(
        "record_id", *_big("prompt_len", "length"),
        _count_of("labels", IGNORE_LABEL).alias("n_masked"),
        F.size("labels").cast("bigint").alias("n_labels"),
        (F.element_at("input_ids", -1) == WORDS.eos_id).alias("ends_with_eos"))


@query
def mask_by_offsets(spark, sf):
    """Whole conversations with the loss on what every assistant turn says."""
    chats = inputs.chat_records(spark, sf)
    rendered = chat.render_chat(chats, "plain").select("record_id", "messages", "rendered")
    ids, spans = WORDS.ids(F.col("rendered")), word_spans(F.col("rendered"))
    labels = mask_outside(ids, spans, chat.answer_spans(F.col("messages")))
    return rendered.select(
        "record_id", labels.alias("labels")).select(
        "record_id", F.size("labels").cast("bigint").alias("n_tokens"),
        (F.size("labels") - _count_of("labels", IGNORE_LABEL)).cast("bigint").alias("n_loss"))


@query
def plain_batches(spark, sf):
    return batching.plain_batches(_document_lengths(spark, sf), BATCH).select(
        "record_id", "batch_id", *_big("pos_in_batch", "length", "width"))


@query
def plain_batches_shuffled(spark, sf):
    return batching.plain_batches(_document_lengths(spark, sf), BATCH, shuffle=True, seed=3) \
        .select("record_id", "batch_id", *_big("pos_in_batch", "length", "width"))


@query
def bucket_batches(spark, sf):
    return batching.bucket_batches(_document_lengths(spark, sf), BATCH).select(
        "record_id", "batch_id", *_big("pos_in_batch", "length", "width"))


@query
def shuffled_batches(spark, sf):
    return batching.bucket_batches(_document_lengths(spark, sf), BATCH, shuffle=True, seed=5) \
        .select("record_id", "batch_id", "batch_order", *_big("pos_in_batch", "width"))


def _padded_columns():
    return ["record_id", "batch_id", *_big("pos_in_batch"),
            F.size("input_ids").cast("bigint").alias("width"),
            F.size("labels").cast("bigint").alias("n_labels"),
            _count_of("attention_mask", 1).alias("n_real"),
            _count_of("labels", IGNORE_LABEL).alias("n_ignored")]


@query
def pad_batches(spark, sf):
    batches = batching.plain_batches(_tokens(spark, sf), BATCH)
    return batching.pad_right(batches, WORDS.pad_id).select(*_padded_columns())


@query
def batch_files(spark, sf):
    """Bucketed, shuffled, padded batches written in order and read back."""
    path = stage_path(spark, "batches")
    batches = batching.bucket_batches(_tokens(spark, sf), BATCH, shuffle=True, seed=5)
    writers.write_batches(batches, path, WORDS.pad_id)
    return spark.read.parquet(path).select("batch_order", *_padded_columns())


@query
def batches_from(spark, sf):
    """A written set opened at its middle batch, as a job that resumes does."""
    path = stage_path(spark, "batches")
    batches = batching.bucket_batches(_tokens(spark, sf), BATCH, shuffle=True, seed=5)
    writers.write_batches(batches, path, WORDS.pad_id, per_file=16)
    middle = spark.read.parquet(path).agg(F.max("batch_order")).first()[0] // 2
    return writers.read_batches(spark, path, middle).select("batch_order", *_padded_columns())


@query
def pad_left_batches(spark, sf):
    prompts = inputs.sft_pairs(spark, sf).select(
        "record_id", F.col("record_id").alias("seq"), WORDS.ids(F.col("q")).alias("input_ids"))
    batches = batching.plain_batches(prompts.withColumn("length", F.size("input_ids")), 8)
    return batching.pad_left(batches, WORDS.pad_id, 128).select(
        "record_id", "batch_id", F.size("input_ids").cast("bigint").alias("width"),
        _count_of("attention_mask", 0).alias("n_pad"),
        (F.element_at("attention_mask", -1) == 1).alias("ends_real"))


@query
def pack_sequences(spark, sf):
    return packing.block_segments(_document_lengths(spark, sf), MAX_LEN).select(
        *_big("block_id", "record_id", "offset", "len"))


@query
def packed_blocks(spark, sf):
    blocks = packing.packed_blocks(_tokens(spark, sf), MAX_LEN)
    total = F.aggregate("position_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return blocks.select(
        *_big("block_id"), F.size("input_ids").cast("bigint").alias("n_tokens"),
        F.size("segments").cast("bigint").alias("n_examples"),
        total.alias("position_sum"), _count_of("labels", IGNORE_LABEL).alias("n_masked"),
        F.array_join(F.transform("segments", lambda s: F.concat_ws(
            ":", s["record_id"].cast("string"), s["offset"].cast("string"),
            s["len"].cast("string"))), ",").alias("layout"))


@query
def packed_blocks_masked(spark, sf):
    """Blocks in which no example is predicted from its neighbour."""
    blocks = packing.packed_blocks(_tokens(spark, sf), MAX_LEN, mask_boundaries=True)
    return blocks.select(*_big("block_id"), _count_of("labels", IGNORE_LABEL).alias("n_masked"))


@query
def forced_packing(spark, sf):
    batches, _ = batching.adaptive_batches(_tokens(spark, sf), BATCH, MAX_LEN, "pack")
    return batches.select("batch_id", *_big("pos_in_batch", "length", "width"))


@query
def forced_padding(spark, sf):
    batches, _ = batching.adaptive_batches(_tokens(spark, sf), BATCH, MAX_LEN, "pad")
    return batches.select("record_id", "batch_id", *_big("pos_in_batch", "length", "width"))


@query
def packing_info(spark, sf):
    return packing.packing_info(packing.packed_blocks(_tokens(spark, sf), MAX_LEN), MAX_LEN)


@query
def adaptive_batches(spark, sf):
    batches, info = batching.adaptive_batches(_tokens(spark, sf), BATCH, MAX_LEN)
    return batches.select(F.lit(info["strategy"]).alias("strategy"), "batch_id",
                          *_big("pos_in_batch", "length", "width"))


@query
def prepare_training(spark, sf):
    """The whole preparation job; what was written is counted per side."""
    out = stage_path(spark, "prepared")
    jobs.prepare_training(inputs.training_records(spark, sf), WORDS, out, MAX_LEN, BATCH)
    return reduce(DataFrame.unionByName, [_written_side(spark, out, side)
                                          for side in ("train", "val")])


def _written_side(spark, out: str, side: str) -> DataFrame:
    batches = spark.read.parquet(f"{out}/{side}")
    # a packed row holds several examples
    members = F.size("segments") if "segments" in batches.columns else F.lit(1)
    return batches.agg(F.lit(side).alias("side"), F.sum(members).cast("bigint").alias("examples"),
                       F.sum(_count_of("attention_mask", 1)).alias("real_tokens"))


# --- caps, samples, splits -----------------------------------------------------

def _documents(spark, sf):
    return inputs.table(spark, sf, "documents").withColumn("seq", F.col("doc_id"))


@query
def head_cap(spark, sf):
    return splits.head_cap(_documents(spark, sf), 250).select("doc_id", "source")


@query
def sample_exact(spark, sf):
    return splits.sample_exact(_documents(spark, sf), 300, seed=7).select("doc_id", "lang")


@query
def train_val_split(spark, sf):
    return splits.train_val_split(_documents(spark, sf)).select("doc_id", "in_val", "in_train")


@query
def shuffle(spark, sf):
    return splits.shuffle(_documents(spark, sf), seed=2).select("doc_id", "position")


@query
def amplify(spark, sf):
    return splits.amplify(_documents(spark, sf).select("doc_id"), 50_000)


# --- classification tasks ------------------------------------------------------

def _task_rows(spark, sf, task):
    rows = inputs.labelled(spark, sf)
    return evalset.build_task(rows.where("in_train").drop("in_train", "in_val"),
                              rows.where("in_val").drop("in_train", "in_val"), task,
                              n_train=200, n_test=80, seed=0)


@query
def build_task(spark, sf):
    return _task_rows(spark, sf, inputs.QUALITY)


@query
def build_task_named_labels(spark, sf):
    return _task_rows(spark, sf, inputs.LANGUAGE)


@query
def task_split_files(spark, sf):
    """The task written as train and test JSON lines, the test side read back."""
    paths = writers.write_split_jsonl(_task_rows(spark, sf, inputs.QUALITY),
                                      stage_path(spark, "task"), "quality")
    return records.read_eval_jsonl(spark, paths["test"]).select(
        "gold", F.md5("prompt").alias("prompt_md5"))


@query
def label_distribution(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id")
    rows = docs.join(inputs.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    gold = rows.select(evalset.task_label(rows, inputs.QUALITY).alias("gold"))
    return evalset.label_distribution(gold)


@query
def majority_baseline(spark, sf):
    report = evalset.majority_baseline(inputs.table(spark, sf, "documents"), "lang")
    return report.select("n", "majority_n", F.round("majority_baseline", 6)
                         .alias("majority_baseline"))


@query
def label_vocabulary(spark, sf):
    return evalset.label_vocabulary(inputs.outputs(spark, sf))


# --- scoring -------------------------------------------------------------------

def _scored(spark, sf):
    answers = inputs.outputs(spark, sf)
    return scoring.match_labels(answers, evalset.label_vocabulary(answers), key="row_id")


@query
def match_labels(spark, sf):
    return _scored(spark, sf).select("run_id", "seq", "gold", "pred")


@query
def match_labels_large_vocabulary(spark, sf):
    """The customers' nations among as many labels again that no answer names."""
    answers = inputs.outputs(spark, sf)
    more = inputs.table(spark, sf, "part").select(F.concat(F.lit("part "), "p_name", F.lit(" #"),
                                                           "p_partkey").alias("label"))
    labels = evalset.label_vocabulary(answers).unionByName(more.distinct())
    return scoring.match_labels(answers, labels, key="row_id", automaton_labels=256).select(
        "run_id", "seq", "gold", "pred")


@query
def ambiguous_labels(spark, sf):
    """Brands in two spellings, of which some share a normal form."""
    parts = inputs.table(spark, sf, "part")
    labels = parts.select(F.col("p_brand").alias("label")).unionByName(parts.where(
        "p_partkey % 2 = 0").select(F.lower("p_brand").alias("label"))).distinct()
    return scoring.ambiguous_labels(labels)


@query
def evaluate_run(spark, sf):
    report = scoring.evaluate(_scored(spark, sf), seconds="seconds")
    return report.select(
        "run_id", *_big("n", "correct", "unparseable"), F.round("accuracy", 6).alias("accuracy"),
        F.round("majority_baseline", 6).alias("majority_baseline"),
        F.round("seconds", 6).alias("seconds"),
        F.round("examples_per_s", 6).alias("examples_per_s"))


@query
def eval_report(spark, sf):
    """The report and its predictions written and read back."""
    path = stage_path(spark, "report")
    scored = _scored(spark, sf)
    writers.write_eval_report(scoring.evaluate(scored), scoring.predictions(scored), path)
    preds = spark.read.parquet(f"{path}/predictions")
    summary = spark.read.schema("run_id string, correct bigint, n bigint").json(f"{path}/summary")
    return summary.join(preds.groupBy("run_id").agg(
        F.count_if(F.col("pred").isNull()).alias("nulls"),
        F.sum(F.length("raw")).cast("bigint").alias("raw_chars")), "run_id")


@query
def nested_report(spark, sf):
    """One JSON document a run with its predictions in order, written and read back."""
    path = stage_path(spark, "documents")
    scored = _scored(spark, sf)
    documents = writers.nested_reports(scoring.evaluate(scored), scoring.predictions(scored))
    documents.write.option("ignoreNullFields", "false").json(path)
    back = spark.read.schema("run_id string, n bigint, predictions array<struct<gold:string, "
                             "pred:string, raw:string>>").json(path)
    lines = F.transform("predictions", lambda p: F.concat_ws(
        "|", p["gold"], F.coalesce(p["pred"], F.lit("-")), p["raw"]))
    return back.select("run_id", "n", F.md5(F.array_join(lines, ";").cast("binary")).alias("digest"))


@query
def prediction_distribution(spark, sf):
    return scoring.prediction_distribution(_scored(spark, sf))


@query
def prediction_counts(spark, sf):
    counted = scoring.counter_map(scoring.prediction_distribution(_scored(spark, sf)),
                                  ["run_id"], "pred")
    return counted.select("run_id", F.array_join(F.transform(
        F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))),
        ",").alias("counts"))


@query
def running_accuracy(spark, sf):
    return scoring.running_accuracy(_scored(spark, sf)).select(
        "run_id", "i", "correct", F.round("accuracy", 6).alias("accuracy"))


@query
def compare_runs(spark, sf):
    scored = _scored(spark, sf).withColumn("tag", F.col("run_id")).withColumn(
        "task", F.lit("nation"))
    wide = scoring.compare_runs(scoring.evaluate(scored, by=("model", "task", "tag")))
    return wide.select("model", "task", *[F.round(c, 6).alias(c)
                                          for c in ("base", "tuned", "gain")],
                       "base_below_majority", "tuned_below_majority")


# --- training runs -------------------------------------------------------------

@query
def training_plan(spark, sf):
    sizes = runs.split_sizes(splits.train_val_split(_documents(spark, sf)))
    return runs.training_plan(sizes, batch_size=BATCH, epochs=3, accum=4)


@query
def epoch_summary(spark, sf):
    return runs.epoch_summary(inputs.metrics(spark, sf)).select(
        "run_id", "epoch", F.round("mean_loss", 6).alias("mean_loss"), "tokens",
        "micro_batches", F.round("tokens_per_s", 9).alias("tokens_per_s"))


@query
def running_training_metrics(spark, sf):
    # epochs of the simulated runs are short, so report every optimiser step
    rows = runs.running_training_metrics(inputs.metrics(spark, sf), accum=2, every=1)
    return rows.select("run_id", "epoch", "step", "iter", F.round("loss", 6).alias("loss"),
                       "seen_tokens", F.round("tokens_per_s", 9).alias("tokens_per_s"))


@query
def new_best_flag(spark, sf):
    return runs.new_best_flag(inputs.metrics(spark, sf)).select(
        "run_id", "iter", F.when(runs.usable_loss(), F.round("loss", 6)).alias("loss"), "is_best")


@query
def best_checkpoint(spark, sf):
    return runs.best_checkpoint(inputs.metrics(spark, sf)).select(
        "run_id", F.round("best_val", 6).alias("best_val"), "best_iter")


@query
def overfit_verdict(spark, sf):
    rows = runs.overfit_verdict(inputs.metrics(spark, sf))
    return rows.select("run_id", "best_iter", F.round("best_val", 6).alias("best_val"),
                       F.round("train_loss", 6).alias("train_loss"),
                       F.round("gap", 6).alias("gap"), "verdict")


@query
def resume_point(spark, sf):
    saved = inputs.metrics(spark, sf).select(
        "run_id", F.concat(F.lit("epoch-"), F.col("epoch").cast("string")).alias("name"))
    return runs.resume_point(saved)


@query
def speedup_vs_baseline(spark, sf):
    """One benchmark per user, one configuration per event type."""
    events = inputs.table(spark, sf, "events")
    bench = events.groupBy(F.col("user_id").alias("bench"), F.col("event_type").alias("name")).agg(
        F.min("event_id").alias("pos"),
        (F.sum(F.get_json_object("props", "$.k").cast("bigint")) / F.count("*"))
        .alias("tokens_per_s"))
    return runs.speedup_vs_baseline(bench).select(
        "bench", "name", "pos", F.round("tokens_per_s", 6).alias("tokens_per_s"),
        F.round("speedup", 6).alias("speedup"))


@query
def run_manifests(spark, sf):
    """Two manifest variants appended to one folder and read back with defaults.

    The loss history holds report points only, a few per run, as it is logged.
    """
    log = inputs.metrics(spark, sf)
    size = log.groupBy("run_id").agg(F.count("*").alias("rows"), F.max("epoch").alias("last"))
    name = F.concat(F.lit("run-"), F.col("run_id").cast("string"))
    points = log.join(size, "run_id").where(
        F.col("iter") % F.greatest(F.lit(1), F.floor(F.col("rows") / 10)) == 0)
    pair = F.array(F.col("iter").cast("double"), F.col("loss"))
    history = points.groupBy("run_id").agg(F.struct(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "train", pair))).alias("train"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "val", pair))).alias("val"))
        .alias("loss_history"))
    verdict = runs.overfit_verdict(log).join(size, "run_id").join(history, "run_id", "left")
    created = F.to_timestamp(F.lit("2024-01-02 03:04:05")).alias("created")
    adapters = verdict.where(F.col("verdict") == "healthy").select(
        name.alias("adapter_path"), F.lit("base").alias("base_model"),
        F.lit("adapter").alias("format"), created, F.col("rows").alias("n_train"),
        (F.col("last") + 1).cast("int").alias("epochs"), F.col("best_val").alias("final_val_loss"),
        F.col("verdict").alias("overfit_verdict"), "loss_history")
    full = verdict.where(F.col("verdict") == "watch").select(
        name.alias("adapter_path"), F.lit("base").alias("base_model"), name.alias("alias"),
        F.lit("4bit").alias("quant"), F.lit("single").alias("strategy"),
        F.lit("checkpoint").alias("format"), created)
    path = stage_path(spark, "manifests")
    both = manifests.union_manifests(adapters, full)
    for _ in range(2):  # a retried append adds nothing
        manifests.append_run_manifest(both, path, once=True)
    found = manifests.read_run_manifests(spark, path, multi_line=False, name="*.json")
    joined = manifests.manifests_for(
        size.select(name.alias("model")),
        found.withColumnRenamed("adapter_path", "model"))
    history_points = F.coalesce(F.size("loss_history.train"), F.lit(0)) + F.coalesce(
        F.size("loss_history.val"), F.lit(0))
    return joined.select(
        "model", "base_model", "quant", "format", "created", "n_train", "overfit_verdict",
        F.round("final_val_loss", 6).alias("final_val_loss"),
        history_points.cast("bigint").alias("points"))


# --- models --------------------------------------------------------------------

@query
def enrich_models(spark, sf):
    return models.enrich_models(inputs.model_names(spark, sf))


@query
def last_segments(spark, sf):
    return inputs.model_names(spark, sf).select("p_partkey", last_segment("name").alias("tail"))


@query
def clamp_context(spark, sf):
    return models.clamp_context(inputs.context_wishes(spark, sf), inputs.model_configs(spark, sf))


# --- requests ------------------------------------------------------------------

@query
def parse_requests(spark, sf):
    return req.accepted(req.parse_requests(inputs.requests(spark, sf))).select(
        "request_id", "kind", "prompt", *_big("max_tokens"), "temperature", "stream")


@query
def rejected_requests(spark, sf):
    return req.rejected(req.parse_requests(inputs.requests(spark, sf))).select(
        "request_id", "route", "reason", *_big("status"))


def _envelope_fields(answers):
    doc = F.col("response")
    return answers.select(
        "request_id", F.get_json_object(doc, "$.id").alias("id"),
        F.get_json_object(doc, "$.object").alias("object"),
        F.get_json_object(doc, "$.created").cast("bigint").alias("created"),
        F.coalesce(F.get_json_object(doc, "$.choices[0].message.content"),
                   F.get_json_object(doc, "$.choices[0].text")).alias("answer"),
        F.get_json_object(doc, "$.usage.completion_tokens").cast("bigint")
        .alias("completion_tokens"))


@query
def response_envelope(spark, sf):
    """Requests to documents: parsed, answered by the words that mostly follow in all
    conversations, each as long as it asked for."""
    model = generate.learn_successors(inputs.table(spark, sf, "conversations"))
    return _envelope_fields(live_requests.answer_requests(
        inputs.requests(spark, sf), model, MODEL, created=CREATED))


# --- streams -------------------------------------------------------------------

def _landed(spark, df: DataFrame, name: str, files_per_trigger: int = 4) -> DataFrame:
    """``df`` as a file stream, some files at a time."""
    path = stage_path(spark, name)
    df.write.parquet(path)
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def _landed_by_iter(spark, df: DataFrame, name: str, files_per_trigger: int = 2) -> DataFrame:
    """A log as it lands: earlier iterations in earlier files, a run's rows of a write together."""
    path = stage_path(spark, name)
    cuts = [F.col("iter") <= 20, (F.col("iter") > 20) & (F.col("iter") <= 40), F.col("iter") > 40]
    for cut in cuts:
        df.where(cut).repartition("run_id").write.mode("append").parquet(path)
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def _files_per_trigger(spark, landing: str) -> int:
    """A third of the files that have landed, MAX_FILES at most."""
    files = len(spark.read.format("binaryFile").load(landing).inputFiles())
    return max(1, min(MAX_FILES, -(-files // 3)))


def _finish(stream_query) -> None:
    stream_query.awaitTermination()


@query
def stream_best_checkpoint(spark, sf):
    out = stage_path(spark, "best")
    stream = _landed(spark, inputs.metrics(spark, sf), "metrics")
    _finish(live.stream_best_checkpoint(stream, out, f"{out}-checkpoint"))
    latest = live.read_latest(spark, out, live.best_checkpoint_view(stream).schema, ["run_id"])
    return latest.select("run_id", F.round("best_val", 6).alias("best_val"), "best_iter")


@query
def stream_new_best_events(spark, sf):
    out = stage_path(spark, "events")
    stream = _landed_by_iter(spark, inputs.metrics(spark, sf), "metrics")
    _finish(live.stream_new_best_events(stream, out, f"{out}-checkpoint", f"{out}-state"))
    return spark.read.schema("run_id bigint, iter bigint, val_loss double, late boolean") \
        .parquet(out).select("run_id", "iter", F.round("val_loss", 6).alias("val_loss"))


@query
def stream_progress(spark, sf):
    out = stage_path(spark, "progress")
    stream = _landed(spark, inputs.metrics(spark, sf), "metrics")
    _finish(live.stream_progress(stream, out, f"{out}-checkpoint"))
    latest = live.read_latest(spark, out, live.progress_view(stream).schema, ["run_id", "epoch"])
    return latest.select("run_id", "epoch", F.round("mean_loss", 6).alias("mean_loss"), "tokens",
                         F.round("tokens_per_s", 9).alias("tokens_per_s"))


@query
def stream_running_accuracy(spark, sf):
    out = stage_path(spark, "accuracy")
    preds = _scored(spark, sf).select("run_id", "seq", "gold", "pred")
    stream = _landed(spark, preds, "predictions")
    _finish(live.stream_running_accuracy(stream, out, f"{out}-checkpoint"))
    latest = live.read_latest(spark, out, live.accuracy_view(stream).schema, ["run_id"])
    return latest.select("run_id", "n", "correct", F.round("accuracy", 6).alias("accuracy"))


@query
def stream_prepare(spark, sf):
    landing, out = stage_path(spark, "landing"), stage_path(spark, "prepared")
    inputs.sft_raw(spark, sf, usable=True).drop("seq").write.json(landing)
    raw = live_prepare.read_landing(spark, landing, files_per_trigger=4)
    _finish(live_prepare.stream_prepare(raw, WORDS, MAX_LEN, out, f"{out}-checkpoint"))
    schema = live_prepare.prepare_view(raw, WORDS, MAX_LEN).schema
    return spark.read.schema(schema).parquet(out).select(
        "record_id", *_big("prompt_len", "length"),
        _count_of("labels", IGNORE_LABEL).alias("n_masked"))


def _prepared_lines(spark, sf) -> tuple[str, str]:
    """A landing folder in which some lines are cut off, prepared in micro-batches."""
    landing, out = stage_path(spark, "landing"), stage_path(spark, "prepared")
    raw = inputs.sft_raw(spark, sf, usable=True).drop("seq")
    line = F.to_json(F.struct(*raw.columns))
    cut = F.when(F.col("record_id") % 7 == 3, F.expr("left(line, length(line) - 1)")).otherwise(
        F.col("line"))
    raw.select("record_id", line.alias("line")).select(cut.alias("value")).write.text(landing)
    _finish(live_prepare.stream_prepare_lines(
        live_prepare.read_landing_lines(spark, landing, _files_per_trigger(spark, landing)), WORDS, MAX_LEN, out, f"{out}-rejects",
        f"{out}-ledger", f"{out}-checkpoint"))
    return out, f"{out}-rejects"


@query
def stream_prepare_lines(spark, sf):
    rows = spark.read.parquet(_prepared_lines(spark, sf)[0])
    return rows.select("record_id", *_big("prompt_len", "length"),
                       _count_of("labels", IGNORE_LABEL).alias("n_masked"))


@query
def stream_prepare_rejects(spark, sf):
    rows = spark.read.parquet(_prepared_lines(spark, sf)[1])
    return rows.select(F.regexp_extract("value", '"record_id":([0-9]+)', 1).cast("bigint")
                       .alias("record_id"), (F.col("line") > 0).alias("has_line"))


@query
def stream_observed_filter(spark, sf):
    """The filter's counts, observed batch by batch while the kept records are written."""
    landing, out = stage_path(spark, "records"), stage_path(spark, "kept")
    records = inputs.training_records(spark, sf)
    records.write.parquet(landing)
    stream = (spark.readStream.schema(records.schema)
              .option("maxFilesPerTrigger", _files_per_trigger(spark, landing)).parquet(landing))
    counts = lengths.filter_counts()
    _finish(sinks.write_observed(
        lengths.filter_for_training(stream, WORDS, MAX_LEN), out, f"{out}-counts",
        f"{out}-checkpoint", counts, lengths.kept))
    seen = spark.read.parquet(f"{out}-counts")
    return seen.agg(*[F.sum(c).alias(c) for c in seen.columns if c != "batch"])
