from harborbook.functions.jsonfields import JsonField, decimal_field, guarded_number, json_fields, json_text
from harborbook.functions.scalars import (
    as_col,
    blank_to_null,
    capped,
    days_between,
    first_part,
    flag,
    fraction_of,
    nz,
    text_like_zero,
    yyyymm,
    zip5,
)

__all__ = [
    "as_col",
    "JsonField",
    "blank_to_null",
    "capped",
    "days_between",
    "decimal_field",
    "first_part",
    "flag",
    "fraction_of",
    "guarded_number",
    "json_fields",
    "json_text",
    "nz",
    "text_like_zero",
    "yyyymm",
    "zip5",
]
