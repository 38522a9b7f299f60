from .exprs import (  # noqa: F401
    bin_edge,
    add_equal_width_bin,
    left_closed_bucket,
    round_half_even,
    weekday_monday0,
    whole_days,
)
