from supplyscope.functions.oracle import (  # noqa: F401
    DISPLAY_FORMAT,
    as_of_day,
    blank,
    code_number,
    code_text,
    day_range,
    decode_number,
    digits_to_number,
    ends_after,
    oracle_concat,
    parse_report_date,
    safe_number,
    strip_controls,
    substr_from,
    to_char,
    typed_null,
    valid_on,
    yes_no,
)
