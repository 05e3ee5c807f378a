"""The sample and scored-row schemas, and canonical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import flat_letter_options

TEXT, TEXTS = T.StringType(), T.ArrayType(T.StringType())
OPTION = T.StructType([T.StructField("letter", TEXT), T.StructField("text", TEXT)])
MESSAGE = T.StructType(
    [
        T.StructField("role", TEXT), T.StructField("question", TEXT), T.StructField("answer", TEXTS), T.StructField("options", T.ArrayType(OPTION)), T.StructField("choices", TEXTS),
        T.StructField("hint", TEXT), T.StructField("prompt", TEXT), T.StructField("response", TEXTS), T.StructField("extra", T.MapType(TEXT, TEXT)),
    ]
)
SAMPLE = T.StructType(
    [
        T.StructField("eval_id", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("media", T.ArrayType(T.StringType())),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("answer", T.ArrayType(T.StringType())),
        T.StructField("answer_is_list", T.BooleanType()),
        T.StructField("reference_response", T.ArrayType(T.StringType())),
        T.StructField("question_type", T.StringType()),
        T.StructField("dataset_meta", T.StringType()),
    ]
)
STAGE = "struct<outcome:string,score:double,matched:string,reason:string,judge_prob:double>"
SCORED = T.StructType(
    [
        T.StructField("eval_id", TEXT), T.StructField("question_type", TEXT), T.StructField("gt", TEXTS), T.StructField("pred", TEXTS), T.StructField("decided_by", TEXT), T.StructField("matched", TEXT),
        T.StructField("score", T.DoubleType()), T.StructField("is_correct", T.IntegerType()), T.StructField("status", TEXT), T.StructField("reason", TEXT), T.StructField("judge_prob", T.DoubleType()),
    ]
)


def first_message(name: str) -> Column:
    """A render input: inside messages[0]."""
    return F.try_element_at("messages", F.lit(1))[name]


def last_response() -> Column:
    return F.try_element_at("messages", F.lit(-1))["response"]


def blank(values: Column, is_list: Column) -> Column:
    """Null, or a single string without ink; an empty list is not blank."""
    single = ~F.coalesce(is_list, F.lit(False))
    return values.isNull() | single & (F.regexp_replace(F.coalesce(F.try_element_at(values, F.lit(1)), F.lit("")), r"(?U)\s+", "") == "")


def hoist(samples: DataFrame) -> DataFrame:
    """Promote an answer that stands in messages[0] when there is none at the top level."""
    return samples.withColumn("answer", F.coalesce("answer", first_message("answer")))


def layout_errors(samples: DataFrame, field: str = "answer") -> DataFrame:
    """Rows whose ground truth stands in messages[0] but not at the top level."""
    return samples.where(F.col(field).isNull() & first_message(field).isNotNull())


def check_layout(samples: DataFrame, field: str = "answer") -> DataFrame:
    """The samples; a row with a misplaced ground truth raises when it is read."""
    bad = F.col(field).isNull() & first_message(field).isNotNull()
    return samples.where(F.when(bad, F.raise_error(F.lit(f"{field} stands in messages[0], not at the top level"))).otherwise(True).cast("boolean"))


def eval_key() -> Column:
    """eval_id, else id, else the row's position."""
    return F.coalesce(F.col("eval_id").cast("string"), F.col("id"), F.col("position").cast("string"))


def scoring_input(samples: DataFrame, gt_field: str = "answer", pred: Column | None = None) -> DataFrame:
    """Adds gt, gt_is_list, pred, question, options, choices, prompt: the columns that stages read.

    A blank `answer` falls back to reference_response; another field never does.
    """
    is_list = F.coalesce(F.col("answer_is_list"), F.lit(False)) if gt_field == "answer" else F.size(gt_field) > 1
    gt, out_list = F.col(gt_field), is_list
    if gt_field == "answer":
        fall = blank(gt, is_list)
        gt, out_list = F.when(fall, F.col("reference_response")).otherwise(gt), F.when(fall, False).otherwise(is_list)
    flat = flat_letter_options((k, F.element_at(first_message("extra"), k)) for k in "ABCDEFGH")
    return samples.select(
        "*", gt.alias("gt"), out_list.alias("gt_is_list"), (last_response() if pred is None else pred).alias("pred"), F.coalesce(first_message("question"), F.lit("")).alias("question"),
        first_message("options").alias("options"), first_message("choices").alias("choices"), flat.alias("flat_options"), first_message("prompt").alias("prompt"),
    )
