from tabsieve.functions.columns import (  # noqa: F401
    NULL_MARKERS,
    DATE_FORMATS,
    genuine_missing,
    is_numeric_type,
    is_text_type,
    is_datetime_type,
    missing,
    norm,
    numeric_columns,
    strip,
    text_columns,
    textual_null,
    to_number,
    to_timestamp_any,
)
