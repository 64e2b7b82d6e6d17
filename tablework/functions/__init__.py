from tablework.functions.columns import (  # noqa: F401
    blank_eq,
    branch_slug,
    clamp_pct,
    drop_lines,
    fmt_utc,
    from_epoch_ms,
    full_match,
    guarded_ratio,
    join_pair,
    json_field,
    load_time,
    metric_label,
    newest,
    nonneg_diff,
    split_first,
    split_list,
    string_array,
    string_map,
    trailing_days,
    tstz_text,
)
