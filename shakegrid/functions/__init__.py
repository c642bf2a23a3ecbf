from .geo import (  # noqa: F401
    cell_id,
    error_ellipse,
    geodesic,
    haversine_km,
    km_errors,
    look_around,
    with_geodesic,
    with_haversine,
)
from .measure import clamp_depth, residual_weight, round6, scaled  # noqa: F401
from .times import (  # noqa: F401
    minute_key,
    mode_code,
    mode_name,
    time_from_filename,
    to_compact,
    to_iso,
)
