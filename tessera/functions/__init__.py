"""Column functions that give one result in Spark and in standard SQL engines, and vectorised Python ones."""
from tessera.functions.portable import day_of_week, json_long, ntz_trunc, time_bucket
from tessera.functions.vectorised import geometric_means, vowel_share, words

__all__ = ["day_of_week", "geometric_means", "json_long", "ntz_trunc", "time_bucket", "vowel_share", "words"]
