"""Column expressions. All of them stay on the JVM; none is a Python UDF."""

from .bucketing import bucketize  # noqa: F401
from .numeric import (  # noqa: F401
    clip,
    floor_zero,
    pct_of,
    round_float,
    round_scaled,
    safe_div,
    total_over_groups,
)
from .parsing import (  # noqa: F401
    age_years,
    duration_minutes,
    lenient_double,
    lenient_long,
    parse_count,
    parse_currency,
    parse_date,
    parse_rate,
    parse_views,
    strip,
)
