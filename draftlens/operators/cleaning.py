"""What becomes of a generated text: limit, sentence cut and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.functions.text import let, trim_to_limit, trim_to_sentence

MAX_LENGTH = 250
UNIT = "words"


def clean_suggestions(responses: DataFrame, unit: str = UNIT, limit: int = MAX_LENGTH) -> DataFrame:
    """Clean model responses.

    Input: previous and response text, and whether the model called it complete.
    An unchanged text is a failure. Text beyond the limit is cut; complete or
    cut text then loses a trailing fragment and is done, the rest goes on.
    """
    response = F.col("response")

    def outcome(cut):
        ended = F.col("complete") | (cut != response)
        return F.struct(
            F.when(ended, "done").otherwise("executing").alias("status"),
            F.when(ended, trim_to_sentence(cut)).otherwise(cut).alias("text"),
        )

    unchanged = F.struct(F.lit("failed").alias("status"), F.col("previous").alias("text"))
    result = F.when(F.col("previous") == response, unchanged).otherwise(let(trim_to_limit(response, unit, limit), outcome))
    rest = [c for c in responses.columns if c not in ("status", "text")]
    return responses.withColumn("_r", result).select(*rest, "_r.status", "_r.text")
