"""Table schemas."""

from pyspark.sql import types as T

_str, _int, _long, _dbl = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Log records are read as text and converted by the canonical projection.
CANONICAL_LOG = _struct(
    ip=_str, timestamp=_str, useragent=_str, path=_str, method=_str,
    status_code=_str, bytes_sent=_str, is_robot=_str,
)
RAW_LOG = _struct(
    ip=_str, timestamp=_str, useragent=_str, resource=_str, method=_str,
    response=_str, bytes=_str,
)

MODEL_FEATURES = [
    "req_count", "avg_interval", "std_interval", "min_interval", "requests_per_hour",
    "session_count", "avg_session_length", "unique_paths_ratio", "error_rate", "rate_404",
    "avg_bytes", "ua_is_known_bot", "ua_is_browser", "ua_entropy",
]

FEATURES = _struct(
    ip=_str, req_count=_long, avg_interval=_dbl, std_interval=_dbl, min_interval=_dbl,
    requests_per_hour=_dbl, session_count=_long, avg_session_length=_dbl,
    unique_paths_ratio=_dbl, error_rate=_dbl, rate_404=_dbl, avg_bytes=_dbl,
    ua_is_known_bot=_int, ua_is_browser=_int, ua_entropy=_dbl, first_seen=_str,
    last_seen=_str, date=T.DateType(), is_robot=_int,
)

# Profile cells by family.
PROFILE_FAMILIES = {
    "stats": ["req_count", "avg_interval", "std_interval", "min_interval", "requests_per_hour",
              "session_count", "avg_session_length", "unique_paths_ratio", "error_rate",
              "rate_404", "avg_bytes", "ua_entropy"],
    "meta": ["first_seen", "last_seen", "ua_is_known_bot", "ua_is_browser"],
    "score": ["risk_score", "is_bot", "threshold_used", "model_version"],
}
PROFILE_CELLS = [c for cells in PROFILE_FAMILIES.values() for c in cells]
_PROFILE_TYPES = {
    **{f.name: f.dataType for f in FEATURES.fields},
    "risk_score": _dbl, "is_bot": _int, "threshold_used": _dbl, "model_version": _str,
}
PROFILE = _struct(ip=_str, **{c: _PROFILE_TYPES[c] for c in PROFILE_CELLS})

_MODEL_RESULT = _struct(
    model=_str, threshold=_dbl, precision=_dbl, recall=_dbl, f1=_dbl, auc_roc=_dbl,
    threshold_search=_struct(threshold=_dbl, precision=_dbl, recall=_dbl, f1=_dbl),
)
METRICS = _struct(
    model_version=_str, label=_str, dataset=_str, best_model=_str, chosen_threshold=_dbl,
    feature_columns=T.ArrayType(_str), n_samples=_long, n_robots=_long,
    models=T.MapType(_str, _MODEL_RESULT), feature_importances=T.MapType(_str, _dbl),
)
