"""Fixed schemas of the records, logs and results that move between operators."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
MESSAGES = T.ArrayType(MESSAGE)

# One wide nullable row for every kind of training record.
CANONICAL = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("messages", MESSAGES),
    T.StructField("prompt", T.StringType()),
    T.StructField("chosen", T.StringType()),
    T.StructField("rejected", T.StringType()),
    T.StructField("completion", T.StringType()),
    T.StructField("label", T.BooleanType()),
    T.StructField("text", T.StringType()),
    T.StructField("chosen_messages", MESSAGES),
    T.StructField("rejected_messages", MESSAGES),
    T.StructField("score_chosen", T.DoubleType()),
    T.StructField("score_rejected", T.DoubleType()),
])

PREF_TEXT = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("chosen", T.StringType()),
    T.StructField("rejected", T.StringType()),
    T.StructField("score_chosen", T.DoubleType()),
    T.StructField("score_rejected", T.DoubleType()),
])

PREF_CHAT = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("chosen", MESSAGES),
    T.StructField("rejected", MESSAGES),
    T.StructField("score_chosen", T.DoubleType()),
    T.StructField("score_rejected", T.DoubleType()),
])

KTO_ROW = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("completion", T.StringType()),
    T.StructField("label", T.BooleanType()),
])

LOG_ROW = T.StructType([
    T.StructField("step", T.DoubleType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
    T.StructField("train_loss", T.DoubleType()),
    T.StructField("train_runtime", T.DoubleType()),
])

TRAINER_STATE = T.StructType([
    T.StructField("global_step", T.LongType()),
    T.StructField("best_model_checkpoint", T.StringType()),
    T.StructField("log_history", T.ArrayType(LOG_ROW)),
])

SAMPLE = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("response", T.StringType()),
])

# Metrics of one evaluated run, in the order the result file lists them.
RESULT = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("initial_train_loss", T.DoubleType()),
    T.StructField("final_train_loss", T.DoubleType()),
    T.StructField("best_eval_loss", T.DoubleType()),
    T.StructField("final_eval_loss", T.DoubleType()),
    T.StructField("total_steps", T.LongType()),
    T.StructField("best_checkpoint", T.StringType()),
    T.StructField("training_time_seconds", T.DoubleType()),
    T.StructField("training_time_hours", T.DoubleType()),
    T.StructField("perplexity", T.DoubleType()),
    T.StructField("test_loss", T.DoubleType()),
    T.StructField("preference_accuracy", T.DoubleType()),
    T.StructField("preference_correct", T.LongType()),
    T.StructField("preference_total", T.LongType()),
    T.StructField("avg_chosen_loss", T.DoubleType()),
    T.StructField("avg_rejected_loss", T.DoubleType()),
    T.StructField("loss_margin", T.DoubleType()),
    T.StructField("generation_samples", T.ArrayType(SAMPLE)),
])
