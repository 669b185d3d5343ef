"""The prompt variants as a table; a request's prompts are a join and a formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ANSWER = 'Answer with JSON: {"events": [{"start_s": <seconds>, "end_s": <seconds>, "confidence": <0-1>, "evidence": "<short phrase>"}]}, or {"events": []} if it does not happen.'

#: name, system prompt, user template; {query}, {start} and {end} are filled in.
VARIANTS = (
    ("overlay", "You locate events in frames that carry their time. Report only what is visible.", 'Find every moment matching "{query}" between {start} s and {end} s, by the times printed on the frames. ' + _ANSWER),
    ("native", "You locate events in a video segment, in seconds from the start of the video.", 'Find every moment matching "{query}". The segment runs from {start} s to {end} s. ' + _ANSWER),
    ("terse", "Answer with JSON only.", 'From {start} s to {end} s: when does "{query}" happen? ' + _ANSWER),
    ("localize", "You place the bounds of an event that does happen in the segment.", 'When does "{query}" begin and end between {start} s and {end} s? ' + _ANSWER),
    ("detect", "Answer yes or no.", 'Does "{query}" happen between {start} s and {end} s?'),
)


def variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIANTS, "prompt_variant STRING, system STRING, template STRING")


def filled(template: Column, query: Column, start: Column, end: Column) -> Column:
    out = F.replace(template, F.lit("{query}"), query)
    for name, value in (("{start}", start), ("{end}", end)):
        out = F.replace(out, F.lit(name), F.format_string("%.3f", value))
    return out


def with_prompts(requests: DataFrame) -> DataFrame:
    """requests (prompt_variant, query, start_s, end_s) with system_prompt and user_prompt; the variants are five rows."""
    told = requests.join(F.broadcast(variants(requests.sparkSession)), "prompt_variant")
    return told.withColumn("user_prompt", filled(F.col("template"), F.col("query"), F.col("start_s"), F.col("end_s"))).withColumnRenamed("system", "system_prompt").drop("template")
