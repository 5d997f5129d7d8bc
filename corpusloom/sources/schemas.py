"""Explicit schemas: nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T

LONG_TEXT_MULTI_LABEL = T.StructType(
    [
        T.StructField("text", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
        T.StructField("split", T.StringType()),
    ]
)
TEXT_MULTI_LABEL = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
        T.StructField("split", T.StringType()),
    ]
)
TEXT_MULTI_CLASS = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)
MULTIPLE_CHOICE = T.StructType(
    [
        T.StructField("context", T.StringType()),
        T.StructField("endings", T.ArrayType(T.StringType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)

# The seven tasks, their table shape, number of classes and
# whether examples without a label form an extra class.
TASKS = {
    "ecthr_a": (LONG_TEXT_MULTI_LABEL, 10, True),
    "ecthr_b": (LONG_TEXT_MULTI_LABEL, 10, True),
    "scotus": (TEXT_MULTI_CLASS, 14, False),
    "eurlex": (TEXT_MULTI_LABEL, 100, False),
    "ledgar": (TEXT_MULTI_CLASS, 100, False),
    "unfair_tos": (TEXT_MULTI_LABEL, 8, True),
    "case_hold": (MULTIPLE_CHOICE, 5, False),
}

RUN_RESULTS = T.StructType(
    [
        T.StructField("eval_micro-f1", T.DoubleType()),
        T.StructField("eval_macro-f1", T.DoubleType()),
        T.StructField("predict_micro-f1", T.DoubleType()),
        T.StructField("predict_macro-f1", T.DoubleType()),
        T.StructField("epoch", T.DoubleType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
TRAINER_STATE = T.StructType(
    [
        T.StructField(
            "log_history",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("epoch", T.DoubleType()),
                        T.StructField("train_runtime", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
CHOICE_RECORD = T.StructType(
    [T.StructField("record_id", T.StringType()), T.StructField("context", T.StringType())]
    + [T.StructField(f"option_{i}", T.StringType()) for i in range(1, 6)]
    + [T.StructField("label", T.StringType())]
)
