"""What to extract, as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from ..operators.dom import FLOW_KEYWORDS
from ..operators.heuristic import HeuristicSpec


@dataclass(frozen=True)
class ExtractSpec:
    url: str | None = None
    url_list: list[str] = field(default_factory=list)
    page_template: str | None = None
    pages: str | None = None
    max_pages_limit: int = 10_000
    extractor: str = "heuristic"
    selectors: dict[str, str] = field(default_factory=dict)
    row_selector: str | None = None
    attribute: str | None = None
    threshold: int = 10
    min_text_length: int = 1
    max_text_length: int = 4000
    skip_class_keywords: list[str] = field(default_factory=lambda: list(FLOW_KEYWORDS))
    near_dup_ratio: float = 0.85
    prefer_records: bool = True
    max_fields_per_record: int = 30
    max_columns: int = 2000
    auto_paginate: bool = False
    max_auto_pages: int = 100
    follow_field: str | None = None
    follow_selectors: dict[str, str] = field(default_factory=dict)
    follow_row_selector: str | None = None
    follow_skip_on_error: bool = True
    follow_url_prefix: str | None = None
    trim_cells: bool = True
    keep_columns: list[str] = field(default_factory=list)
    drop_columns: list[str] = field(default_factory=list)
    rename_columns: dict[str, str] = field(default_factory=dict)
    required_columns: list[str] = field(default_factory=list)
    schema_lock_after: int = 0
    deduplicate: bool = False
    typed: bool = False
    null_policy: str = "empty"
    csv_safe: bool = False
    drop_empty: bool = True
    sort_columns: bool = False
    normalize_keys: bool = False
    provenance: bool = False
    quality_report: bool = False

    def heuristic(self) -> HeuristicSpec:
        from ..operators.dom import ALL_KEYWORDS

        return HeuristicSpec(
            threshold=self.threshold,
            min_text_length=self.min_text_length,
            max_text_length=self.max_text_length,
            keywords=tuple(self.skip_class_keywords or ALL_KEYWORDS),
            near_dup_ratio=self.near_dup_ratio,
            prefer_records=self.prefer_records,
            max_fields=self.max_fields_per_record,
        )

    def merge(self, other: ExtractSpec) -> ExtractSpec:
        """``other`` over ``self``: maps merge, lists replace, scalars override unless
        they equal their default, so a merge cannot reset a setting."""
        defaults, changed = ExtractSpec(), {}
        for f in fields(self):
            value = getattr(other, f.name)
            if isinstance(value, dict):
                changed[f.name] = {**getattr(self, f.name), **value}
            elif isinstance(value, list):
                # The default keyword list counts as given, like any filled list.
                changed[f.name] = list(value) if value else getattr(self, f.name)
            elif value is not None and value != getattr(defaults, f.name):
                changed[f.name] = value
        return replace(self, **changed)
