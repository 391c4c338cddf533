"""Declared schemas. Loose JSON is read with these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
MESSAGES = T.ArrayType(MESSAGE)

# Objects and numbers arrive in the string fields as their JSON text.
SFT_FIELDS = ["prompt", "instruction", "question", "input", "completion", "response",
              "output", "answer", "context", "text", "content"]
SFT_RAW = T.StructType([T.StructField(name, T.StringType()) for name in SFT_FIELDS]
                       + [T.StructField("messages", MESSAGES)])

EVAL_ROW = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("gold", T.StringType()),
])

LOSS_HISTORY = T.StructType([
    T.StructField("train", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("val", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("verdict", T.StringType()),
    T.StructField("final_train", T.DoubleType()),
    T.StructField("final_val", T.DoubleType()),
    T.StructField("best_iter", T.LongType()),
])

# Union of the two manifest variants (full checkpoint, adapter checkpoint).
MANIFEST = T.StructType([
    T.StructField("base_model", T.StringType()),
    T.StructField("alias", T.StringType()),
    T.StructField("quant", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("adapter_path", T.StringType()),
    T.StructField("n_train", T.LongType()),
    T.StructField("n_val", T.LongType()),
    T.StructField("epochs", T.IntegerType()),
    T.StructField("lora_layers", T.IntegerType()),
    T.StructField("lora_rank", T.IntegerType()),
    T.StructField("final_train_loss", T.DoubleType()),
    T.StructField("final_val_loss", T.DoubleType()),
    T.StructField("overfit_verdict", T.StringType()),
    T.StructField("loss_history", LOSS_HISTORY),
])

# Numbers may come quoted, so they are read as text and cast afterwards.
REQUEST_BODY = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("messages", MESSAGES),
    T.StructField("max_tokens", T.StringType()),
    T.StructField("temperature", T.StringType()),
    T.StructField("stream", T.StringType()),
])
