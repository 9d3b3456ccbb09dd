"""Independent SQL for the registered queries, on the plain test tables.

Written the direct way (one window per client, one join per question) and not the way the
jobs compute.
"""

from __future__ import annotations

from ..functions.useragent import BROWSER_TOKENS, KNOWN_BOT_TOKENS
from ..sources.sample_log import USER_AGENTS

_BOT = "(?i)(" + "|".join(KNOWN_BOT_TOKENS) + ")"
_WEB = "(?i)(" + "|".join(BROWSER_TOKENS) + ")"


def _is_bot(ua: str) -> str:
    return f"coalesce(regexp_matches({ua}, '{_BOT}'), false)"


def _is_web(ua: str) -> str:
    return f"(coalesce(regexp_matches({ua}, '{_WEB}'), false) AND NOT {_is_bot(ua)})"


def _entropy(ua: str) -> str:
    return (f"CASE WHEN coalesce({ua}, '') = '' THEN 0.0 "
            f"ELSE list_aggregate(string_split({ua}, ''), 'entropy') END")


_AGENTS = " ".join(f"WHEN {slot} THEN '{name}'" for slot, name in USER_AGENTS.items())

LOG = f"""access_log AS (
  SELECT event_id, user_id, event_type, value, ts AS raw_ts,
    CASE WHEN event_id % 997 = 996 THEN NULL
         WHEN user_id % 29 = 28 THEN '2001:db8::' || user_id
         WHEN user_id % 11 = 10 THEN '216.244.' || (50000 + user_id % 15000)
         ELSE '10.' || (user_id % 3) || '.' || (user_id % 7) || '.' || (user_id % 250) END AS ip,
    1704067200 + (epoch_us(ts) - 1704067200000000) // (CAST(1000000 AS BIGINT) *
      CASE WHEN user_id % 17 = 3 THEN 30000 WHEN user_id % 5 = 1 THEN 6000 ELSE 30 END) AS epoch_s,
    CASE user_id % 8 {_AGENTS} END AS useragent,
    CASE WHEN event_id % 101 = 100 THEN NULL WHEN user_id % 13 = 4 THEN '/robots.txt'
         ELSE '/' || event_type || '/' || json_extract_string(props, '$.k') END AS path,
    CASE event_type WHEN 'signup' THEN 'POST' WHEN 'error' THEN 'HEAD' ELSE 'GET' END AS method,
    CASE WHEN event_type = 'error' AND value > 30 THEN 500 WHEN event_type = 'error' THEN 404
         WHEN user_id % 13 = 0 AND event_type IN ('view', 'click', 'signup') THEN 404
         ELSE 200 END AS status_code,
    CASE WHEN event_id % 103 = 102 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS bytes_sent,
    CASE user_id % 23 WHEN 5 THEN 1 WHEN 6 THEN 0 END AS truth,
    CASE WHEN event_id % 107 <> 106 THEN round(least(value / 100, 1.0), 4) END AS risk_score,
    CASE WHEN event_id % 107 <> 106 THEN CASE WHEN value >= 50 THEN 1 ELSE 0 END END AS is_bot
  FROM events)"""

GAPS = """gaps AS (
  SELECT *, epoch_s - lag(epoch_s) OVER (PARTITION BY ip ORDER BY epoch_s, event_id) AS gap
  FROM access_log WHERE ip <> ''),
sessioned AS (
  SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (
      PARTITION BY ip ORDER BY epoch_s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_index
  FROM gaps)"""

FEATS = f"""raw_feats AS (
  SELECT ip, count(*) AS req_count,
    coalesce(avg(gap), 0) AS avg_interval, coalesce(stddev_samp(gap), 0) AS std_interval,
    CAST(coalesce(min(gap), 0) AS DOUBLE) AS min_interval,
    count(*) / greatest((max(epoch_s) - min(epoch_s)) / CAST(3600 AS DOUBLE),
                        CAST(1 AS DOUBLE) / CAST(3600 AS DOUBLE)) AS requests_per_hour,
    max(session_index) AS session_count, count(*) / max(session_index) AS avg_session_length,
    count(DISTINCT path) / count(*) AS unique_paths_ratio,
    count(*) FILTER (status_code >= 400) / count(*) AS error_rate,
    count(*) FILTER (status_code = 404) / count(*) AS rate_404,
    coalesce(avg(bytes_sent), 0) AS avg_bytes,
    max(CASE WHEN {_is_bot("useragent")} THEN 1 ELSE 0 END) AS ua_is_known_bot,
    max(CASE WHEN {_is_web("useragent")} THEN 1 ELSE 0 END) AS ua_is_browser,
    arg_min(useragent, (epoch_s, useragent)) FILTER (useragent NOT IN ('', '-')) AS sample,
    min(epoch_s) AS first_s, max(epoch_s) AS last_s, max(truth) AS truth
  FROM sessioned GROUP BY ip),
feats AS (
  SELECT ip, req_count, avg_interval, std_interval, min_interval, requests_per_hour, session_count,
    avg_session_length, unique_paths_ratio, error_rate, rate_404, avg_bytes,
    CAST(ua_is_known_bot AS BIGINT) AS ua_is_known_bot, CAST(ua_is_browser AS BIGINT) AS ua_is_browser,
    {_entropy("sample")} AS ua_entropy,
    strftime(make_timestamp(first_s * 1000000), '%Y-%m-%dT%H:%M:%S') AS first_seen,
    strftime(make_timestamp(last_s * 1000000), '%Y-%m-%dT%H:%M:%S') AS last_seen,
    strftime(make_timestamp(last_s * 1000000), '%Y-%m-%d') AS date,
    CAST(CASE WHEN ua_is_known_bot = 1 OR rate_404 > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS is_robot,
    truth
  FROM raw_feats)"""

BE = """bot_events AS (
  SELECT event_id, ip, CAST(epoch_s AS DOUBLE) AS timestamp, epoch_us(raw_ts) / 1e6 AS raw_timestamp,
    raw_ts, epoch_s, path, useragent, risk_score, CAST(is_bot AS BIGINT) AS is_bot,
    CAST(status_code AS BIGINT) AS status_code, bytes_sent,
    md5(ip || CAST(floor(epoch_s / CAST(1800 AS DOUBLE)) AS BIGINT)) AS session_id,
    CASE WHEN regexp_matches(ip, '^\\d+\\.\\d+\\.\\d+(\\.|$)')
         THEN regexp_extract(ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.0/24' ELSE '' END AS cidr_block
  FROM access_log WHERE ip IS NOT NULL)"""

FWD = """requests AS (
  SELECT *, CASE WHEN event_id % 4 = 1 THEN '198.51.100.' || (user_id % 200)
                 ELSE coalesce(ip, 'unknown') END AS cip FROM access_log)"""

_TRUSTED = "({0} IN ('127.0.0.1', '::1') OR regexp_matches({0}, '^10\\.0\\.0\\.\\d+$'))"

SCORED = f"""scored AS (
  SELECT r.*, f.req_count, f.session_count, f.last_seen,
    CASE WHEN r.useragent IS NULL THEN f.ua_is_known_bot
         ELSE CAST({_is_bot("r.useragent")} AS BIGINT) END AS known,
    CASE WHEN r.useragent IS NULL THEN f.ua_is_browser
         ELSE CAST({_is_web("r.useragent")} AS BIGINT) END AS web,
    coalesce(f.rate_404, 0) AS r404
  FROM (SELECT * EXCLUDE (ip), {{ip}} AS ip FROM {{source}}) r LEFT JOIN feats f ON r.ip = f.ip),
verdicts AS (
  SELECT *, CASE WHEN coalesce(known, 0) <> 0 OR r404 > 0.5 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS risk
  FROM scored)"""

_REASON = "'heuristic: known-bot UA or rate_404>0.5'"
_FEAT_COLS = """ip, req_count, round(avg_interval, 6) AS avg_interval,
  round(std_interval, 6) AS std_interval, round(min_interval, 6) AS min_interval,
  round(requests_per_hour, 6) AS requests_per_hour, session_count,
  round(avg_session_length, 6) AS avg_session_length,
  round(unique_paths_ratio, 6) AS unique_paths_ratio, round(error_rate, 6) AS error_rate,
  round(rate_404, 6) AS rate_404, round(avg_bytes, 6) AS avg_bytes, ua_is_known_bot, ua_is_browser,
  round(ua_entropy, 6) AS ua_entropy, first_seen, last_seen, date, is_robot"""
_PROFILE_COLS = """ip, req_count, round(avg_interval, 6) AS avg_interval,
  round(std_interval, 6) AS std_interval, round(min_interval, 6) AS min_interval,
  round(requests_per_hour, 6) AS requests_per_hour, session_count,
  round(avg_session_length, 6) AS avg_session_length,
  round(unique_paths_ratio, 6) AS unique_paths_ratio, round(error_rate, 6) AS error_rate,
  round(rate_404, 6) AS rate_404, round(avg_bytes, 6) AS avg_bytes,
  round(ua_entropy, 6) AS ua_entropy, first_seen, last_seen, ua_is_known_bot, ua_is_browser"""
_RISK = "CASE WHEN ua_is_known_bot <> 0 OR rate_404 > 0.5 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END"
_SEED = f"""SELECT {_PROFILE_COLS}, {_RISK} AS risk_score,
  CAST({_RISK} >= 0.5 AS BIGINT) AS is_bot, 0.5::DOUBLE AS threshold_used,
  'heuristic' AS model_version FROM feats"""

_RATIO = "coalesce(CAST(format('{{:.4f}}', {0}::DOUBLE / nullif({1}, 0)) AS DOUBLE), 0)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_L, _F, _B = _with(LOG), _with(LOG, GAPS, FEATS), _with(LOG, BE)
_VERDICTS = """, judged AS (
  SELECT *, CASE WHEN event_id % 200 = 7 THEN 'malformed' WHEN coalesce(ip, '') = '' THEN 'no_ip'
                 WHEN event_id % 50 = 13 THEN 'no_time' ELSE 'accepted' END AS verdict
  FROM access_log WHERE event_id % 200 <> 57)
"""
_MIDDLE = """, days AS (SELECT *, CAST(raw_ts AS DATE) AS day FROM bot_events),
middle AS (SELECT * FROM days WHERE day > (SELECT min(day) FROM days) AND day < (SELECT max(day) FROM days))
"""
_HUMANS = "count(*) FILTER (is_bot = 0)"
_BOTS = "count(*) FILTER (is_bot = 1)"


def _scored(source: str = "access_log", ip: str = "ip", *extra: str) -> str:
    return _with(LOG, GAPS, FEATS, *extra, SCORED.format(source=source, ip=ip))


# -- evaluation ---------------------------------------------------------------

LABELLED = """labelled AS (
  SELECT event_id, risk_score AS score,
    CASE WHEN value + (event_id % 7) * 8 > 70 THEN 1 ELSE 0 END AS label
  FROM access_log WHERE risk_score IS NOT NULL)"""
ONE = "models AS (SELECT 'm' AS model, score, label FROM labelled)"
TWO = """models AS (
  SELECT 'random_forest' AS model, score, label FROM labelled UNION ALL
  SELECT 'gradient_boosting', round(least(score * 1.3, 1.0), 4), label FROM labelled)"""
UNRELATED = """models AS (
  SELECT 'm' AS model, risk_score AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
  FROM access_log WHERE risk_score IS NOT NULL)"""
SWEEP = """grid AS (SELECT i / CAST(100 AS DOUBLE) AS threshold FROM range(30, 71) t(i)),
counts AS (
  SELECT model, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp,
    count(*) FILTER (score >= threshold AND label = 0) AS fp,
    count(*) FILTER (score < threshold AND label = 1) AS fn
  FROM models, grid GROUP BY model, threshold),
sweep AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM counts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY precision >= 0.8 DESC,
      CASE WHEN precision >= 0.8 THEN recall ELSE f1 END DESC,
      CASE WHEN precision >= 0.8 THEN precision ELSE 0 END DESC, threshold) AS rn
  FROM sweep WHERE tp + fp > 0),
chosen AS (SELECT * FROM ranked WHERE rn = 1)"""
AUC = """by_score AS (
  SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM models GROUP BY model, score),
cumulated AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_score),
auc AS (
  SELECT model, sum(CAST(pos AS DOUBLE) * (below + neg / CAST(2 AS DOUBLE)))
      / (sum(pos) * CAST(sum(neg) AS DOUBLE)) AS auc_roc FROM cumulated GROUP BY model)"""
RESULTS = """results AS (
  SELECT c.model, c.threshold, c.precision, c.recall, c.f1, a.auc_roc
  FROM chosen c JOIN auc a ON c.model = a.model),
best AS (SELECT * FROM results ORDER BY recall DESC, precision DESC, model LIMIT 1)"""
_EVAL = _with(LOG, LABELLED, TWO, SWEEP, AUC, RESULTS)
_QUALITY = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"

_MODEL_FEATURES = ["req_count", "avg_interval", "std_interval", "min_interval", "requests_per_hour",
                   "session_count", "avg_session_length", "unique_paths_ratio", "error_rate",
                   "rate_404", "avg_bytes", "ua_is_known_bot", "ua_is_browser", "ua_entropy"]
_CORRELATIONS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT CASE WHEN isfinite(corr({c}::DOUBLE, is_robot::DOUBLE)) THEN "
    f"abs(corr({c}::DOUBLE, is_robot::DOUBLE)) ELSE 0 END FROM feats) AS importance"
    for c in _MODEL_FEATURES)

_MATRIX = [c for c in _MODEL_FEATURES]
_DIRTY = {"requests_per_hour": "CASE WHEN requests_per_hour > 1000 OR ua_is_browser = 1 THEN 0 "
                               "ELSE requests_per_hour END"}
_CLEAN = ", ".join(f"CAST({_DIRTY.get(c, c)} AS DOUBLE) AS {c}" for c in _MATRIX)
_SCALED = ", ".join(
    f"round(coalesce(({c} - (SELECT avg({c}) FROM clean)) / nullif((SELECT stddev_pop({c}) FROM clean), 0), 0), 6)"
    f" AS {c}" for c in _MATRIX)


# -- signals ------------------------------------------------------------------

def _levels(c: str, danger: float, warn: float) -> str:
    return f"CASE WHEN {c} > {danger} THEN 'danger' WHEN {c} > {warn} THEN 'warn' ELSE 'ok' END"


_SIGNALS = [
    # history needed (None = always), position with / without history, key, label, value, severity, note
    (None, 0, 0, "ua", "User-Agent",
     "CASE WHEN known = 1 THEN 'known bot' WHEN web = 1 THEN 'browser' ELSE 'unrecognized' END",
     "CASE WHEN known = 1 THEN 'danger' WHEN web = 1 THEN 'ok' ELSE 'warn' END",
     "CASE WHEN known = 1 THEN 'Matches a crawler/bot signature' WHEN web = 1 THEN "
     "'Recognized browser fingerprint' ELSE 'Neither a known browser nor a known bot' END"),
    (True, 1, None, "rate_404", "404 rate", "format('{:.0f}', r404 * 100) || '%'", _levels("r404", .5, .2),
     "CASE WHEN r404 > 0.2 THEN 'Scanning for endpoints' ELSE 'Normal not-found rate' END"),
    (True, 2, None, "rph", "Request rate", "format('{:,.0f}', rph) || '/hr'", _levels("rph", 1000, 200),
     "CASE WHEN rph > 200 THEN 'Automated-level throughput' ELSE 'Human-level pace' END"),
    (True, 3, None, "upr", "Path diversity", "format('{:.2f}', upr)",
     "CASE WHEN upr < 0.05 THEN 'danger' WHEN upr < 0.2 THEN 'warn' ELSE 'ok' END",
     "CASE WHEN upr < 0.2 THEN 'Highly repetitive paths' ELSE 'Varied browsing' END"),
    (True, 4, None, "err", "Error rate", "format('{:.0f}', err * 100) || '%'",
     "CASE WHEN err > 0.5 THEN 'warn' ELSE 'ok' END",
     "CASE WHEN err > 0.5 THEN 'Many failed requests' ELSE 'Mostly successful' END"),
    (True, 5, None, "vol", "Volume",
     "format('{:,.0f}', req::DOUBLE) || ' reqs / ' || format('{:,.0f}', sess::DOUBLE) || ' sess'",
     "'info'", "'Observed in the dataset'"),
    (False, None, 1, "history", "Behavioural history", "'none'", "'info'",
     "'Unseen IP — scored on User-Agent only'"),
    (None, 6, 2, "entropy", "UA entropy", "format('{:.2f}', entropy) || ' bits'", "'info'",
     "'Character randomness of the User-Agent'"),
]


def _signals_sql() -> str:
    parts = []
    for needs, with_pos, without_pos, key, label, value, severity, note in _SIGNALS:
        pos = {None: f"CASE WHEN req > 0 THEN {with_pos} ELSE {without_pos} END",
               True: str(with_pos), False: str(without_pos)}[needs]
        where = {None: "", True: "WHERE req > 0", False: "WHERE req = 0"}[needs]
        parts.append(f"SELECT ip, useragent, CAST({pos} AS BIGINT) AS pos, '{key}' AS key, "
                     f"'{label}' AS label, {value} AS value, {severity} AS severity, {note} AS note "
                     f"FROM base {where}")
    return " UNION ALL ".join(parts)


ORACLE: dict[str, str] = {
    "read_access_log": _L + """SELECT ip,
        strftime(make_timestamp(epoch_s * 1000000), '%Y-%m-%d %H:%M:%S') AS ts,
        coalesce(useragent, '') AS useragent, path, method,
        CASE WHEN event_id % 50 <> 9 THEN CAST(status_code AS BIGINT) END AS status_code,
        CASE WHEN event_id % 50 <> 11 THEN bytes_sent END AS bytes_sent
        FROM access_log WHERE ip IS NOT NULL AND event_id % 50 <> 13""",
    "rejected_records": _L + _VERDICTS + """SELECT source, verdict, count(found) AS records,
        CASE WHEN verdict = 'accepted' THEN 0 ELSE count(found) END AS lines_kept
        FROM (VALUES ('ndjson'), ('dump')) s(source)
        CROSS JOIN (VALUES ('accepted'), ('malformed'), ('no_ip'), ('no_time')) v(verdict)
        LEFT JOIN (SELECT verdict AS found FROM judged) j ON j.found = v.verdict GROUP BY source, verdict""",
    "stream_access_log": _L + _VERDICTS + """SELECT ip,
        strftime(make_timestamp(epoch_s * 1000000), '%Y-%m-%d %H:%M:%S') AS ts,
        coalesce(useragent, '') AS useragent, path, method, CAST(status_code AS BIGINT) AS status_code, bytes_sent
        FROM judged WHERE verdict = 'accepted'""",
    "stream_rejected_records": _L + _VERDICTS + """SELECT verdict, count(*) AS records, count(*) AS lines_kept,
        CAST(verdict = 'malformed' AS BIGINT) AS all_cut FROM judged WHERE verdict <> 'accepted' GROUP BY verdict""",
    "normalize_raw_dump": _L + """SELECT ip,
        strftime(make_timestamp(epoch_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
        useragent, path, method,
        CASE WHEN event_id % 50 <> 9 THEN CAST(status_code AS BIGINT) END AS status_code, bytes_sent
        FROM access_log WHERE event_id % 50 NOT IN (7, 17, 27, 37)""",
    "load_features": _F + f"SELECT {_FEAT_COLS} FROM feats",
    "gt_join": """SELECT d.doc_id AS "ID", CAST(d.n_chars AS BIGINT) AS n_chars,
        length(text) - length(replace(text, ' ', '')) + 1 AS n_words,
        CAST(l.toxic AS BIGINT) AS toxic, CAST(1 - l.quality AS BIGINT) AS "ROBOT"
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "model_comparison": _EVAL + f"""SELECT (SELECT model FROM best) AS best_model,
        (SELECT threshold FROM best) AS chosen_threshold, (SELECT count(*) FROM labelled) AS n_samples,
        (SELECT CAST(sum(label) AS BIGINT) FROM labelled) AS n_robots, 'heuristic' AS label, model,
        threshold, {_QUALITY}, round(auc_roc, 6) AS auc_roc FROM results""",
    "feature_importances": _F + f"""SELECT feature, round(importance, 6) AS importance
        FROM ({_CORRELATIONS}) ORDER BY importance DESC, feature LIMIT 15""",
    "headline_model": _EVAL + """SELECT model AS best_model, round(auc_roc, 6) AS model_auc,
        '1.0.0' AS model_version, 'heuristic' AS label_kind FROM best""",
    "append_events": _B + """SELECT event_id, ip, timestamp, path, useragent, risk_score, is_bot,
        status_code, bytes_sent, session_id, cidr_block FROM bot_events""",
    "seed_profiles": _F + _SEED,
    "profile_lookup": _F + _SEED,
    "profile_upsert": _scored() + f""", newest AS (
        SELECT ip, arg_max(useragent, event_id) FILTER (useragent IS NOT NULL) AS _u,
          max(event_id) AS event_id FROM verdicts WHERE ip IS NOT NULL GROUP BY ip),
      last AS (SELECT v.* FROM verdicts v JOIN newest n ON v.event_id = n.event_id),
      merged AS (
        SELECT f.* REPLACE (CAST({_is_bot("l.useragent")} AS BIGINT) AS ua_is_known_bot,
            CAST({_is_web("l.useragent")} AS BIGINT) AS ua_is_browser,
            {_entropy("l.useragent")} AS ua_entropy), l.risk
        FROM feats f JOIN last l ON f.ip = l.ip)
      SELECT {_PROFILE_COLS}, risk AS risk_score, CAST(risk >= 0.5 AS BIGINT) AS is_bot,
        0.5::DOUBLE AS threshold_used, 'heuristic' AS model_version FROM merged""",
    "active_alerts": _scored() + f""", alerts AS (
        SELECT ip, epoch_s AS flagged_at, {_REASON} AS reason,
          CASE WHEN event_id % 2 = 0 THEN event_id ELSE req_count END AS n
        FROM verdicts WHERE ip IS NOT NULL AND risk >= 0.5),
      live AS (SELECT * FROM alerts WHERE flagged_at > (SELECT max(epoch_s) FROM access_log) - 3600)
      SELECT ip, flagged_at, reason, n AS request_count_at_flag FROM live
      QUALIFY row_number() OVER (PARTITION BY ip ORDER BY flagged_at DESC, n DESC) = 1""",
    "allowlist_parse": _L + """, hosts AS (
        SELECT event_id, user_id, ip, '10.' || (user_id % 3) || '.' || (user_id % 7) || '.' || (user_id % 250) AS host,
          167772160 + (user_id % 3) * 65536 + (user_id % 7) * 256 + user_id % 250 AS num FROM access_log),
      entries AS (
        SELECT DISTINCT ip AS entry, 'exact' AS kind, CAST(NULL AS BIGINT) AS prefix_len,
          '=' || ip AS match_key FROM hosts WHERE event_id % 6 IN (0, 1) AND ip IS NOT NULL
        UNION SELECT host || '/' || len, 'cidr', len,
          '4/' || len || '/' || (num // CAST(pow(2, 32 - len) AS BIGINT)) FROM (
            SELECT *, CASE event_id % 6 WHEN 3 THEN 8 + user_id % 25 ELSE 30 + user_id % 6 END AS len
            FROM hosts WHERE event_id % 6 IN (3, 4)) WHERE len <= 32)
      SELECT entry, kind, prefix_len, match_key FROM entries""",
    "flagged_ips": _F + f"SELECT ip FROM feats WHERE {_RISK} >= 0.5",
    "cidr_blocklist": _B + f"""SELECT cidr_block FROM bot_events WHERE cidr_block <> ''
        GROUP BY cidr_block HAVING {_RATIO.format(_BOTS, "count(*)")} > 0.5""",
    "validate_requests": _L + """, messy AS (
        SELECT event_id, CASE event_id % 10 WHEN 1 THEN ' ' || ip WHEN 2 THEN 'bad host' WHEN 4 THEN '  '
            ELSE ip END AS ip,
          CASE event_id % 10 WHEN 3 THEN substr(path, 2) WHEN 6 THEN '/' || repeat('p', 2048) ELSE path END AS path,
          CASE event_id % 10 WHEN 5 THEN repeat('u', 1025) ELSE useragent END AS useragent
        FROM access_log)
      SELECT event_id, trim(ip) AS ip,
        CASE WHEN coalesce(trim(ip), '') = '' THEN 'ip must not be empty'
             WHEN trim(ip) = 'bad host' THEN 'ip is not an address'
             WHEN length(useragent) > 1024 THEN 'useragent too long'
             WHEN length(path) > 2048 THEN 'path too long'
             WHEN path <> '' AND path NOT LIKE '/%' THEN 'path must start with ''/''' END AS reject_reason
      FROM messy""",
    "allowlist_split": _with(LOG, FWD) + f"""SELECT event_id, cip AS ip,
        CAST({_TRUSTED.format("cip")} AS BIGINT) AS allowlisted FROM requests""",
    "model_matrix": _F + f""", clean AS (SELECT ip, is_robot AS label, {_CLEAN} FROM feats)
        SELECT ip, label, {_SCALED} FROM clean""",
    "recent_events": _B + """SELECT event_id, ip, timestamp, path, risk_score,
        coalesce(is_bot, 0) AS is_bot, cidr_block FROM bot_events WHERE coalesce(is_bot, 0) = 0
        ORDER BY event_id DESC LIMIT 40 OFFSET 5""",
    "events_page": _B + """, humans AS (
        SELECT *, row_number() OVER (ORDER BY event_id DESC) AS place FROM bot_events
        WHERE coalesce(is_bot, 0) = 0 AND event_id < (SELECT max(event_id) // 2 FROM bot_events))
      SELECT event_id, ip, timestamp, path, risk_score, coalesce(is_bot, 0) AS is_bot, cidr_block
        FROM humans WHERE place BETWEEN 61 AND 90""",
    "events_page_compacted": _B + """SELECT event_id, ip, timestamp, path, risk_score, is_bot, cidr_block
        FROM bot_events WHERE is_bot = 1 ORDER BY event_id DESC LIMIT 25""",
    "summary_by_range": _B + _MIDDLE + f"""SELECT count(*) AS total_events, {_BOTS} AS bot_events,
        count(*) - {_BOTS} AS human_events, {_RATIO.format(_BOTS, "count(*)")} AS bot_ratio,
        count(DISTINCT ip) AS unique_ips, count(DISTINCT path) AS unique_paths,
        round(max(raw_timestamp), 6) AS last_event_at, 1 AS sketches_near FROM middle""",
    "top_paths_by_range": _B + _MIDDLE + f"""SELECT coalesce(path, '—') AS path, count(*) AS total, {_BOTS} AS bots,
        {_HUMANS} AS humans FROM middle GROUP BY coalesce(path, '—') ORDER BY total DESC, 1 LIMIT 20""",
    "sql_expressions": _L + f"""SELECT event_id, CAST({_is_bot("useragent")} AS BIGINT) AS known,
        CAST({_is_web("useragent")} AS BIGINT) AS web, round({_entropy("useragent")}, 6) AS entropy,
        CASE WHEN regexp_matches(ip, '^\\d+\\.\\d+\\.\\d+(\\.|$)')
             THEN regexp_extract(ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.0/24' ELSE '' END AS subnet,
        CASE WHEN subnet = '' THEN ip ELSE subnet END AS rate_key,
        md5(ip || CAST(floor(epoch_s / CAST(1800 AS DOUBLE)) AS BIGINT)) AS session_id,
        epoch_s // 600 * 600 AS bucket, {_RATIO.format("(event_id % 7)", "(event_id % 11)")} AS share,
        CASE WHEN {_is_bot("useragent")} THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS risk,
        CASE WHEN event_id % 29 = 0 OR event_id % 10 > 7 THEN 'CRITICAL' WHEN event_id % 10 > 4 THEN 'HIGH'
             WHEN event_id % 10 > 2 THEN 'MEDIUM' ELSE 'SAFE' END AS tier,
        CASE WHEN event_id % 10 > 5 THEN 'bot' WHEN event_id % 10 > 2 THEN 'warn' ELSE 'human' END AS band
        FROM access_log WHERE ip IS NOT NULL""",
    "sql_over_limit": _B + """SELECT ip AS client, CAST(floor(timestamp / 60) * 60 AS BIGINT) AS minute,
        count(*) AS requests FROM bot_events GROUP BY 1, 2 HAVING count(*) > 30""",
    "sql_recent": _B + """SELECT event_id, ip, timestamp, path, risk_score, coalesce(is_bot, 0) AS is_bot, cidr_block
        FROM bot_events WHERE event_id < 700 ORDER BY event_id DESC LIMIT 40""",
    "events_since": _B + """SELECT event_id, ip, timestamp, path, risk_score, is_bot
        FROM bot_events WHERE event_id > 500""",
    "score_requests": _scored("requests", "cip", FWD) + f"""SELECT event_id, ip, risk AS risk_score,
        CAST(risk >= 0.5 AS BIGINT) AS is_bot, {_REASON} AS reason,
        coalesce(session_count, 0) AS session_count, coalesce(req_count, 0) AS req_count, last_seen,
        known AS ua_is_known_bot, web AS ua_is_browser FROM verdicts""",
    "bulk_score": _with(LOG, GAPS, FEATS, FWD) + f"""SELECT r.event_id AS pos, r.cip AS ip,
        CASE WHEN {_TRUSTED.format("r.cip")} THEN 0 WHEN coalesce(f.is_robot, 0) = 1 THEN 0.9
             ELSE 0.1 END::DOUBLE AS risk_score,
        CAST(NOT {_TRUSTED.format("r.cip")} AND coalesce(f.is_robot, 0) = 1 AS BIGINT) AS is_bot
        FROM requests r LEFT JOIN feats f ON r.cip = f.ip""",
    "batch_score_heuristic": _F + f"""SELECT ip, {_RISK} AS risk_score,
        CAST({_RISK} >= 0.5 AS BIGINT) AS is_bot, {_REASON} AS reason FROM feats""",
    "explain_verdicts": _F + f"""SELECT ip, {_RISK} AS risk_score,
        coalesce(nullif(concat_ws('; ', CASE WHEN ua_is_known_bot = 1 THEN 'known-bot user-agent' END,
          CASE WHEN rate_404 > 0.5 THEN 'high 404 rate' END,
          CASE WHEN requests_per_hour > 1000 THEN 'high request rate' END,
          CASE WHEN unique_paths_ratio > 0 AND unique_paths_ratio < 0.05 THEN 'repetitive paths' END), ''),
          CASE WHEN {_RISK} >= 0.5 THEN 'model score above threshold'
               ELSE 'model score below threshold' END) AS reason FROM feats""",
    "signal_breakdown": _with(LOG, GAPS, FEATS, FWD) + f""", base AS (
        SELECT s.cip AS ip, s.ua AS useragent, CAST({_is_bot("s.ua")} AS BIGINT) AS known,
          CAST({_is_web("s.ua")} AS BIGINT) AS web, coalesce(f.rate_404, 0)::DOUBLE AS r404,
          coalesce(f.requests_per_hour, 0)::DOUBLE AS rph, coalesce(f.unique_paths_ratio, 0)::DOUBLE AS upr,
          coalesce(f.error_rate, 0)::DOUBLE AS err, ({_entropy("s.ua")})::DOUBLE AS entropy,
          coalesce(f.req_count, 0) AS req, coalesce(f.session_count, 0) AS sess
        FROM (SELECT DISTINCT cip, coalesce(useragent, '') AS ua FROM requests) s
        LEFT JOIN feats f ON s.cip = f.ip)
      {_signals_sql()}""",
    "signals_allowlisted": _with(LOG, GAPS, FEATS, FWD) + f""", base AS (
        SELECT s.cip AS ip, s.ua AS useragent, CAST({_is_bot("s.ua")} AS BIGINT) AS known,
          CAST({_is_web("s.ua")} AS BIGINT) AS web, coalesce(f.rate_404, 0)::DOUBLE AS r404,
          coalesce(f.requests_per_hour, 0)::DOUBLE AS rph, coalesce(f.unique_paths_ratio, 0)::DOUBLE AS upr,
          coalesce(f.error_rate, 0)::DOUBLE AS err, ({_entropy("s.ua")})::DOUBLE AS entropy,
          coalesce(f.req_count, 0) AS req, coalesce(f.session_count, 0) AS sess
        FROM (SELECT DISTINCT cip, coalesce(useragent, '') AS ua FROM requests) s
        LEFT JOIN feats f ON s.cip = f.ip)
      SELECT * FROM ({_signals_sql()}) WHERE NOT {_TRUSTED.format("ip")}
      UNION ALL SELECT ip, useragent, CAST(0 AS BIGINT), 'allow', 'Allowlist', 'trusted', 'ok',
        'IP is on the allowlist — scoring skipped' FROM base WHERE {_TRUSTED.format("ip")}""",
    "decisions": _L + f""", judged AS (
        SELECT event_id, ip, coalesce({_TRUSTED.format("ip")}, false) AS ok,
          coalesce(risk_score, 0) AS risk, coalesce(is_bot, 0) = 1 AS bot FROM access_log)
      SELECT event_id, ip, CASE WHEN ok THEN 0 ELSE risk END AS risk_score,
        CAST(bot AND NOT ok AS BIGINT) AS is_bot, CASE WHEN ok THEN 'allowlisted' ELSE 'given' END AS reason,
        CAST(ok AS BIGINT) AS allowlisted,
        CASE WHEN ok OR NOT bot THEN 'allow' WHEN risk >= 0.85 THEN 'block' ELSE 'throttle' END AS decision,
        CAST(CASE WHEN ok OR NOT bot THEN 200 ELSE 429 END AS BIGINT) AS http_status,
        CASE WHEN ok THEN 'Allowlisted — normal flow' WHEN NOT bot THEN 'Human traffic — normal flow'
             WHEN risk >= 0.85 THEN 'High-confidence bot — request blocked'
             ELSE 'Bot detected — rate-limited (HTTP 429)' END AS action,
        CASE WHEN ok THEN 'SAFE' WHEN bot OR risk > 0.7 THEN 'CRITICAL' WHEN risk > 0.4 THEN 'HIGH'
             WHEN risk > 0.2 THEN 'MEDIUM' ELSE 'SAFE' END AS threat
      FROM judged""",
    "client_ip": _with(LOG, FWD) + "SELECT event_id, cip AS client_ip FROM requests",
    "ip_features": _F + f"SELECT {_FEAT_COLS} FROM feats",
    "ip_features_two_level": _F + f"SELECT {_FEAT_COLS} FROM feats",
    "ip_labels": _F + """SELECT ip, ua_is_known_bot, round(rate_404, 6) AS rate_404,
        CAST(coalesce(truth, is_robot) AS BIGINT) AS is_robot FROM feats""",
    "ua_features": _L + f"""SELECT DISTINCT coalesce(useragent, '') AS useragent,
        CAST({_is_bot("useragent")} AS BIGINT) AS ua_is_known_bot,
        CAST({_is_web("useragent")} AS BIGINT) AS ua_is_browser,
        round({_entropy("useragent")}, 6) AS ua_entropy FROM access_log""",
    "event_session_ids": _B + "SELECT event_id, session_id, cidr_block FROM bot_events",
    "request_intervals": _with(LOG, GAPS) + "SELECT event_id, ip, CAST(gap AS DOUBLE) AS interval FROM gaps",
    "sessionize": _with(LOG, GAPS) + """SELECT event_id, ip, CAST(gap AS DOUBLE) AS interval,
        session_index FROM sessioned""",
    "session_summary": _with(LOG, GAPS) + """SELECT ip, session_index, min(epoch_s) AS start_s,
        max(epoch_s) AS end_s, count(*) AS requests FROM sessioned GROUP BY ip, session_index""",
    "overview": _F + f"""SELECT count(*) AS total_ips, CAST(sum(is_robot) AS BIGINT) AS bots,
        CAST(count(*) - sum(is_robot) AS BIGINT) AS humans, {_RATIO.format("sum(is_robot)", "count(*)")} AS bot_ratio,
        CAST(sum(req_count) AS BIGINT) AS total_requests,
        CAST(format('{{:.2f}}', avg(requests_per_hour)) AS DOUBLE) AS avg_requests_per_hour FROM feats""",
    "top_bots": _F + """SELECT ip, req_count, round(requests_per_hour, 6) AS requests_per_hour,
        round(rate_404, 6) AS rate_404, round(ua_entropy, 6) AS ua_entropy,
        round(error_rate, 6) AS error_rate, session_count FROM feats WHERE is_robot = 1
        ORDER BY req_count DESC, ip LIMIT 20""",
    "rate_histogram": _F + """SELECT CAST(least(CAST(requests_per_hour / 50 AS BIGINT), 20) * 50 AS BIGINT)
        AS requests_per_hour_bucket, count(*) FILTER (is_robot = 1) AS bots,
        count(*) FILTER (is_robot = 0) AS humans FROM feats GROUP BY 1""",
    "class_balance": _F + "SELECT count(*) AS n_samples, CAST(sum(is_robot) AS BIGINT) AS n_robots FROM feats",
    "scatter_sample": _F + """SELECT ip, round(requests_per_hour, 6) AS requests_per_hour,
        round(error_rate, 6) AS error_rate, round(unique_paths_ratio, 6) AS unique_paths_ratio,
        round(ua_entropy, 6) AS ua_entropy, req_count, is_robot FROM feats
        ORDER BY md5(ip || ':42'), ip LIMIT 600""",
    "rescore_sample": _F + f"SELECT {_FEAT_COLS} FROM feats ORDER BY md5(ip || ':7'), ip LIMIT 200",
    "event_stats": _B + f"""SELECT count(*) AS total_events, count(DISTINCT ip) AS total_ips,
        {_BOTS} AS bot_events, {_RATIO.format(_BOTS, "count(*)")} AS bot_ratio FROM bot_events""",
    "events_summary": _B + f"""SELECT count(*) AS total_events, {_BOTS} AS bot_events,
        count(*) - {_BOTS} AS human_events, {_RATIO.format(_BOTS, "count(*)")} AS bot_ratio,
        count(DISTINCT ip) AS unique_ips, count(DISTINCT path) AS unique_paths,
        max(timestamp) AS last_event_at FROM bot_events""",
    "kpis": _B + """SELECT round(avg(is_bot) * 100, 6) AS bot_pct, count(*) AS total_events,
        round(avg(risk_score), 6) AS avg_risk FROM bot_events""",
    "class_share": _B + "SELECT is_bot, count(*) AS n FROM bot_events GROUP BY is_bot",
    "top_paths": _B + f"""SELECT coalesce(path, '—') AS path, count(*) AS total, {_BOTS} AS bots,
        {_HUMANS} AS humans FROM bot_events GROUP BY coalesce(path, '—')
        ORDER BY total DESC, 1 LIMIT 20""",
    "cidr_activity": _B + f""", nets AS (SELECT cidr_block, count(*) AS total, {_BOTS} AS bots,
        {_HUMANS} AS humans, {_RATIO.format(_BOTS, "count(*)")} AS bot_ratio
        FROM bot_events WHERE cidr_block <> '' GROUP BY cidr_block)
      SELECT *, CASE WHEN bot_ratio > 0.5 THEN 'bot' WHEN bot_ratio > 0.2 THEN 'warn' ELSE 'human' END AS band
      FROM nets ORDER BY total DESC, cidr_block LIMIT 15""",
    "top_flagged_ips": _B + """SELECT ip, count(*) AS req_count, max(risk_score) AS max_risk
        FROM bot_events WHERE is_bot = 1 GROUP BY ip ORDER BY req_count DESC, ip LIMIT 20""",
    "top_flagged_avg_risk": _B + """SELECT ip, count(*) AS req_count, CAST(sum(is_bot) AS BIGINT) AS bot_hits,
        round(avg(risk_score), 6) AS avg_risk FROM bot_events WHERE is_bot = 1
        GROUP BY ip ORDER BY req_count DESC, ip LIMIT 20""",
    "top_flagged_stats": _B + """SELECT ip, count(*) AS req_count, max(risk_score) AS max_risk,
        max(is_bot) AS flagged FROM bot_events GROUP BY ip
        ORDER BY flagged DESC NULLS LAST, req_count DESC, ip LIMIT 10""",
    "alert_timeline": _B + """SELECT strftime(make_timestamp(epoch_s * 1000000), '%Y-%m-%d %H:%M:%S') AS ts,
        ip, risk_score, is_bot, path FROM bot_events WHERE is_bot = 1""",
    "events_timeseries": _B + f"""SELECT CAST(floor(timestamp / 300) * 300 AS BIGINT) AS t, {_BOTS} AS bots,
        {_HUMANS} AS humans FROM bot_events GROUP BY 1""",
    "timeseries_share": _B + f""", s AS (SELECT CAST(floor(timestamp / 300) * 300 AS BIGINT) AS t, {_BOTS} AS bots,
        {_HUMANS} AS humans FROM bot_events GROUP BY 1)
      SELECT t, bots, humans, bots + humans AS total,
        round(CASE WHEN bots + humans > 0 THEN bots / (bots + humans) * 100 ELSE 0 END, 6) AS bot_pct,
        round((SELECT avg(bots + humans) FROM s), 6) AS mean_total FROM s""",
    "throughput_5m": _B + """SELECT strftime(make_timestamp(CAST(floor(timestamp / 300) * 300 AS BIGINT) * 1000000),
        '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS requests FROM bot_events GROUP BY 1""",
    "throughput_10m_by_class": _B + """SELECT strftime(make_timestamp(
        CAST(floor(timestamp / 600) * 600 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS bucket, is_bot,
        count(*) AS requests FROM bot_events GROUP BY 1, 2""",
    "dow_hour_heatmap": _B + """SELECT dayofweek(raw_ts) AS dow, hour(raw_ts) AS hour, count(*) AS requests
        FROM bot_events GROUP BY 1, 2""",
    "dow_hour_dense": _B + """, h AS (SELECT dayofweek(raw_ts) AS dow, hour(raw_ts) AS hour,
        count(*) AS requests FROM bot_events GROUP BY 1, 2)
      SELECT d.i AS dow, o.i AS hour, coalesce(requests, 0) AS requests,
        round(coalesce(requests, 0) / greatest((SELECT max(requests) FROM h), 1), 6) AS intensity
      FROM range(7) d(i) CROSS JOIN range(24) o(i) LEFT JOIN h ON h.dow = d.i AND h.hour = o.i""",
    "risk_histogram": _B + """SELECT floor(risk_score * 20) / 20 AS risk_bin, count(*) AS n
        FROM bot_events WHERE risk_score IS NOT NULL GROUP BY 1""",
    "sliding_rate": _B + """, w AS (SELECT ip, CAST(floor(raw_timestamp / 300) AS BIGINT) * 300 - k * 300 AS s
        FROM bot_events, range(12) r(k))
      SELECT ip, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start,
        count(*) AS requests FROM w GROUP BY ip, s""",
    "feed_merge": _B + """, shown AS (SELECT * FROM bot_events WHERE is_bot = 1 ORDER BY event_id DESC LIMIT 50),
      both_feeds AS (SELECT 0 AS r, * FROM bot_events WHERE event_id NOT IN (SELECT event_id FROM shown)
        UNION ALL SELECT 1, * FROM shown)
      SELECT event_id, ip, path, is_bot FROM both_feeds ORDER BY r, event_id DESC LIMIT 50""",
    "rate_limit_ip": _B + f"""SELECT ip AS client, CAST(floor(timestamp / 60) * 60 AS BIGINT) AS minute,
        count(*) AS requests FROM bot_events WHERE NOT {_TRUSTED.format("ip")}
        GROUP BY 1, 2 HAVING count(*) > 30""",
    "rate_limit_cidr": _B + f"""SELECT coalesce(nullif(cidr_block, ''), ip) AS client,
        CAST(floor(timestamp / 60) * 60 AS BIGINT) AS minute, count(*) AS requests FROM bot_events
        WHERE NOT {_TRUSTED.format("ip")} GROUP BY 1, 2 HAVING count(*) > 50""",
    "threshold_sweep": _with(LOG, LABELLED, ONE, SWEEP) + f"SELECT threshold, tp, fp, fn, {_QUALITY} FROM sweep",
    "choose_threshold": _with(LOG, LABELLED, ONE, SWEEP) + f"SELECT threshold, {_QUALITY} FROM chosen",
    "choose_threshold_fallback": _with(LOG, UNRELATED, SWEEP) + f"SELECT threshold, {_QUALITY} FROM chosen",
    "auc_roc": _with(LOG, LABELLED, ONE, AUC) + "SELECT round(auc_roc, 6) AS auc_roc FROM auc",
    "choose_model": _EVAL + f"SELECT model, threshold, {_QUALITY}, round(auc_roc, 6) AS auc_roc FROM best",
    "cv_folds": _F + """SELECT ip, is_robot, (row_number() OVER (PARTITION BY is_robot
        ORDER BY md5(ip || ':42'), ip) - 1) % least(5, (SELECT min(n) FROM (
          SELECT count(*) AS n FROM feats GROUP BY is_robot))) AS fold FROM feats""",
    # a request far in the future takes the watermark past the whole stream
    "stream_throughput": _B + f"""SELECT strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS bucket,
        count(*) AS requests, {_BOTS} AS bots, {_HUMANS} AS humans
        FROM (SELECT *, CAST(floor(timestamp / 300) * 300 AS BIGINT) AS s FROM bot_events) GROUP BY s""",
    "stream_rate_limit": _B + f"""SELECT ip AS client,
        strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS requests
        FROM (SELECT *, CAST(floor(timestamp / 60) * 60 AS BIGINT) AS s FROM bot_events)
        WHERE NOT {_TRUSTED.format("ip")} GROUP BY ip, s HAVING count(*) > 30""",
    "stream_rate_limit_cidr": _B + f"""SELECT coalesce(nullif(cidr_block, ''), ip) AS client,
        strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS requests
        FROM (SELECT *, CAST(floor(timestamp / 60) * 60 AS BIGINT) AS s FROM bot_events)
        WHERE NOT {_TRUSTED.format("ip")} GROUP BY 1, s HAVING count(*) > 50""",
    "stream_summary": _B + f"""SELECT count(*) AS total_events, {_BOTS} AS bot_events,
        count(DISTINCT ip) AS unique_ips, count(DISTINCT path) AS unique_paths,
        strftime(make_timestamp(max(epoch_s) * 1000000), '%Y-%m-%d %H:%M:%S') AS last_event_at,
        1 AS sketches_near FROM bot_events""",
    "stream_sessions": _with(LOG, GAPS) + """SELECT ip,
        strftime(make_timestamp(min(epoch_s) * 1000000), '%Y-%m-%d %H:%M:%S') AS start_ts,
        strftime(make_timestamp(max(epoch_s) * 1000000), '%Y-%m-%d %H:%M:%S') AS end_ts,
        count(*) AS requests FROM sessioned GROUP BY ip, session_index""",
    "stream_dedup": _B + """SELECT event_id,
        strftime(make_timestamp(epoch_s * 1000000), '%Y-%m-%d %H:%M:%S') AS ts, ip, path, is_bot
        FROM bot_events""",
    "stream_alerts": _B + """, f AS (SELECT ip, event_id, epoch_s, CASE WHEN epoch_s - lag(epoch_s) OVER (
          PARTITION BY ip ORDER BY epoch_s, event_id) <= 3600 THEN 0 ELSE 1 END AS fresh
        FROM bot_events WHERE is_bot = 1),
      p AS (SELECT *, sum(fresh) OVER (PARTITION BY ip ORDER BY epoch_s, event_id ROWS UNBOUNDED PRECEDING) AS k
        FROM f)
      SELECT ip, strftime(make_timestamp(min(epoch_s) * 1000000), '%Y-%m-%d %H:%M:%S') AS first_flagged_at,
        strftime(make_timestamp(max(epoch_s) * 1000000), '%Y-%m-%d %H:%M:%S') AS flagged_at, count(*) AS hits,
        strftime(make_timestamp((max(epoch_s) + 3600) * 1000000), '%Y-%m-%d %H:%M:%S') AS expires_at
      FROM p GROUP BY ip, k""",
    "stream_alert_transitions": _B + """, m AS (SELECT ip, epoch_s // 60 AS minute, min(epoch_s) AS f, max(epoch_s) AS l,
          count(*) AS n FROM bot_events WHERE is_bot = 1 AND ip IS NOT NULL GROUP BY ALL),
      g AS (SELECT *, CASE WHEN f - lag(l) OVER (PARTITION BY ip ORDER BY minute) <= 3600 THEN 0 ELSE 1 END AS fresh FROM m),
      p AS (SELECT *, sum(fresh) OVER (PARTITION BY ip ORDER BY minute ROWS UNBOUNDED PRECEDING) AS k FROM g),
      h AS (SELECT *, CAST(sum(n) OVER (PARTITION BY ip, k ORDER BY minute ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hits FROM p),
      t AS (SELECT ip, CASE fresh WHEN 1 THEN 'raised' ELSE 'extended' END AS transition,
          CASE fresh WHEN 1 THEN f ELSE l END AS at_s, hits, l + 3600 AS end_s FROM h
        UNION ALL SELECT ip, 'expired', max(l) + 3600, CAST(sum(n) AS BIGINT), max(l) + 3600 FROM p GROUP BY ip, k)
      SELECT ip, transition, strftime(make_timestamp(at_s * 1000000), '%Y-%m-%d %H:%M:%S') AS at, hits,
        strftime(make_timestamp(end_s * 1000000), '%Y-%m-%d %H:%M:%S') AS expires_at FROM t""",
    "stream_sliding_rate": _B + """, w AS (SELECT ip, (epoch_s // 300 - k) * 300 AS s
        FROM bot_events, range(12) r(k) WHERE ip IS NOT NULL)
      SELECT ip, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start,
        count(*) AS requests FROM w GROUP BY ip, s""",
    "stream_score": _scored() + f""", judged AS (
        SELECT *, {_TRUSTED.format("ip")} AS ok FROM verdicts WHERE ip IS NOT NULL)
      SELECT event_id, ip, CASE WHEN ok THEN 0 ELSE risk END AS risk_score,
        CAST(NOT ok AND risk >= 0.5 AS BIGINT) AS is_bot,
        CASE WHEN ok THEN 'allowlisted' ELSE {_REASON} END AS reason,
        CASE WHEN ok OR risk < 0.5 THEN 'allow' ELSE 'block' END AS decision,
        CAST(CASE WHEN ok OR risk < 0.5 THEN 200 ELSE 429 END AS BIGINT) AS http_status,
        CASE WHEN NOT ok AND risk >= 0.5 THEN 'CRITICAL' ELSE 'SAFE' END AS threat FROM judged""",
    "stream_persist": _scored() + f""", seen AS (
        SELECT * FROM verdicts WHERE ip IS NOT NULL AND NOT {_TRUSTED.format("ip")}),
      per_ip AS (SELECT ip, count(*) AS events, CAST(max(epoch_s) AS DOUBLE) AS last_event,
          max(epoch_s) FILTER (risk >= 0.5) AS flagged_at, max(req_count) AS n,
          arg_max(risk, epoch_s) AS risk_score,
          arg_max(CAST({_is_bot("useragent")} AS BIGINT), epoch_s) AS ua_is_known_bot
        FROM seen GROUP BY ip)
      SELECT ip, events, last_event, risk_score, CAST(risk_score >= 0.5 AS BIGINT) AS is_bot,
        ua_is_known_bot,
        CASE WHEN flagged_at > (SELECT max(epoch_s) FROM seen) - 3600 THEN flagged_at END AS flagged_at,
        CASE WHEN flagged_at > (SELECT max(epoch_s) FROM seen) - 3600 THEN n END AS request_count_at_flag
      FROM per_ip""",
    "stream_features": _F + f"SELECT {_FEAT_COLS} FROM feats",
    # the features determine the label, so a fitted model repeats it
    "train_rf": _F + "SELECT ip, is_robot AS label, is_robot AS verdict FROM feats",
    "train_gbt": _F + "SELECT ip, is_robot AS label, is_robot AS verdict FROM feats",
    "rf_importances": "SELECT unnest([" + ", ".join(f"'{c}'" for c in _MODEL_FEATURES)
                      + "]) AS feature, 1 AS valid, 1.0::DOUBLE AS total",
    "oof_scores": _F + """SELECT ip, is_robot AS label, (row_number() OVER (PARTITION BY is_robot
        ORDER BY md5(ip || ':42'), ip) - 1) % least(5, (SELECT min(n) FROM (
          SELECT count(*) AS n FROM feats GROUP BY is_robot))) AS fold, 1 AS valid, 1 AS mostly_right FROM feats""",
    "oof_sweep": _F + """SELECT percent, 1 AS same, (SELECT count(*) FROM feats WHERE is_robot = 1) AS positives
        FROM range(30, 71) r(percent)""",
    "train_groundtruth": """SELECT unnest(['random_forest', 'gradient_boosting']) AS model,
        1 AS threshold_in_grid, 1 AS better_than_chance""",
    "score_requests_model": _scored("requests", "cip", FWD) + """SELECT event_id, ip,
        coalesce(req_count, 0) AS req_count, coalesce(session_count, 0) AS session_count, last_seen,
        known AS ua_is_known_bot, web AS ua_is_browser, 1 AS valid, 1 AS by_threshold FROM verdicts""",
}
ORACLE.update({mine: ORACLE[same] for mine, same in {
    "sql_top_paths": "top_paths", "sql_subnets": "cidr_activity", "sql_flagged": "top_flagged_ips",
    "sql_timeseries": "events_timeseries", "sql_throughput": "throughput_5m",
    "sql_risk_bins": "risk_histogram"}.items()})
ORACLE["batch_score_model"] = ORACLE["explain_verdicts"].replace(
    f"SELECT ip, {_RISK} AS risk_score,", "SELECT ip, 1 AS valid, is_robot AS is_bot,")

# alerts stored by a stream are those of the whole log
ORACLE["stream_alerts_live"] = ORACLE["active_alerts"]
ORACLE["prepare_twice"] = _B + """, d AS (
    SELECT event_id, CAST(raw_ts AS DATE) AS day FROM access_log WHERE ip IS NOT NULL),
  kept AS (SELECT * FROM d WHERE event_id = 1
    UNION ALL SELECT * FROM d WHERE event_id % 2 = 0 AND day <> (SELECT max(day) FROM d))
  SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS requests, count(*) AS ids,
    count(DISTINCT event_id % 2) AS batches FROM kept GROUP BY day"""
ORACLE["stream_persist_versioned"] = ORACLE["stream_persist"]
ORACLE["stream_features_tiered"] = ORACLE["stream_features"]
ORACLE["profiles_at_version"] = _F + """SELECT ip, req_count AS first_req_count, CAST(is_robot AS DOUBLE) AS first_risk_score,
    CASE WHEN is_robot = 1 THEN -1 ELSE req_count END AS newest_req_count,
    CASE WHEN req_count > 50 THEN 0.5 ELSE CAST(is_robot AS DOUBLE) END AS newest_risk_score FROM feats"""
