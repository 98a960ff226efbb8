"""What the engine refuses, and why. Each error has a code and the names it is about."""

from __future__ import annotations


class TarnError(Exception):
    codes: tuple[str, ...] = ()

    def __init__(self, code: str, **about):
        if code not in self.codes:
            raise ValueError(f"{type(self).__name__} has no code {code!r}")
        self.code, self.about = code, about
        super().__init__(f"{code}: " + ", ".join(f"{k}={v!r}" for k, v in about.items()))


class SchemaError(TarnError):
    codes = ("unknown_entity", "unknown_field", "type_mismatch", "missing_field", "invalid_value", "stale_schema", "invalid_definition", "unsupported_query", "malformed_record")


class ValueFault(SchemaError):
    codes = ("outside_domain", "pattern_mismatch", "below_minimum", "above_maximum")


class DefinitionFault(SchemaError):
    codes = (
        "reserved_entity", "shared_slot", "exhausted_pool", "exhausted_payload", "unsupported_pattern", "malformed_pattern", "unsupported_allowed", "unsupported_bounds",
        "narrowed_bounds", "duplicate_aggregate", "unknown_grouping", "unknown_date", "non_temporal_date", "non_numeric_metric",
        "invalid_shards", "grouped_histogram", "invalid_bounds",
    )


class QueryFault(SchemaError):
    codes = (
        "single_sort_required", "unsortable_field", "unsearchable_field", "unpageable_field", "non_numeric_field", "disjunction_unsupported",
        "equality_only", "no_aggregate", "average_of_optional", "no_histogram", "filtered_histogram", "rank_out_of_range",
    )
