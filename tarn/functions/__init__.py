from tarn.functions.scalars import (
    bucket,
    canonical,
    compiles,
    digest,
    epoch_millis,
    from_value_json,
    has_tokens,
    hour_of,
    hour_of_week,
    salted,
    search_tokens,
    value_json,
    week_of,
    whole_match,
)

__all__ = [
    "bucket", "canonical", "compiles", "digest", "epoch_millis", "from_value_json", "has_tokens", "hour_of", "hour_of_week", "salted",
    "search_tokens", "value_json", "week_of", "whole_match",
]
