"""Schemas, label ranks and the order of label quality."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The quality vocabulary, its aliases and ranks.
QUALITY_RANK = {"failure": 1, "suboptimal": 2, "successful": 3}
QUALITY_ALIAS = {"failed": "failure", "optimal": "successful", "success": "successful", "fail": "failure", "GT": "successful", "all_fail": "failure", "close_succ": "suboptimal"}
#: Length of a task's text vector.
TEXT_VECTOR = 384

TRAJECTORY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("task", T.StringType()),
        T.StructField("lang_vector", T.ArrayType(T.FloatType())),
        T.StructField("data_source", T.StringType()),
        T.StructField("frames", T.StringType()),
        T.StructField("is_robot", T.BooleanType()),
        T.StructField("quality_label", T.StringType()),
        T.StructField("partial_success", T.FloatType()),
    ]
)


def normalize_quality(label: Column) -> Column:
    """One vocabulary: aliases are replaced, null is successful."""
    table = F.create_map(*[F.lit(x) for kv in QUALITY_ALIAS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), label, F.lit("successful"))


def quality_rank(label: Column) -> Column:
    """failure 1, suboptimal 2, successful 3, any other 0."""
    out = F.lit(0)
    for name, rank in QUALITY_RANK.items():
        out = F.when(label == name, rank).otherwise(out)
    return out
