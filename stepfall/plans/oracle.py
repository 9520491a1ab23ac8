"""The catalog's queries as plain SQL over the retail tables, for checking by another engine."""

from __future__ import annotations

from stepfall.constants import NAIVE_PATTERNS, STAGES

# --- shared table expressions -------------------------------------------------------------

_STAGE_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(STAGES))

BASE = f"""
WITH cases(instance_id, base_date, window_days, changepoint_day, trap, simpson, target,
           has_fault, fault_type, predicate) AS (VALUES
  ('case_0', DATE '2024-01-01', 30, 15, false, false, CAST(8 AS DOUBLE), true, 'dead_screen',
   'os = ''HOUSEHOLD'''),
  ('case_1', DATE '2024-01-01', 30, 15, false, true, CAST(4 AS DOUBLE), true,
   'crash_concentration', 'os = ''BUILDING'' AND device_age_months > 24'),
  ('case_2', DATE '2024-01-01', 30, 15, true, false, CAST(0 AS DOUBLE), false, 'none', '')),
stages(stage_idx, stage) AS (VALUES {_STAGE_VALUES}),
steps AS (
  SELECT a.stage_idx AS k, a.stage AS from_stage, b.stage AS to_stage
  FROM stages a JOIN stages b ON b.stage_idx = a.stage_idx + 1),
metrics AS (SELECT * FROM steps UNION ALL SELECT 99, 'session', 'crash'),
usr AS (
  SELECT 'case_' || (c_custkey % 3) AS instance_id, CAST(c_custkey AS VARCHAR) AS user_id,
         c_mktsegment AS os,
         CASE c_nationkey % 3 WHEN 0 THEN 'flagship' WHEN 1 THEN 'mid' ELSE 'budget' END
           AS device_type,
         CAST(floor((c_acctbal + 1000) / 200) AS INTEGER) AS device_age_months,
         r_name AS geo,
         CASE c_custkey % 3 WHEN 0 THEN 'organic' WHEN 1 THEN 'paid' ELSE 'referral' END
           AS channel,
         c_custkey % 2 = 0 AS is_returning
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
                LEFT JOIN region ON n_regionkey = r_regionkey),
named AS (
  SELECT e.*, CASE event_type
      WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'app_open' ELSE 'home_view' END
      WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'product_browse'
                            ELSE 'product_detail_view' END
      WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'add_to_cart' ELSE 'checkout_start' END
      WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'payment_submit'
                                ELSE 'order_confirmed' END
      WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'crash' ELSE 'api_error' END END
    AS canonical
  FROM events e),
ev AS (
  SELECT 'case_' || (user_id % 3) AS instance_id, CAST(user_id AS VARCHAR) AS user_id,
    user_id || '_' || (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3) AS session_id,
    ts AS event_ts,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day,
    CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 'post' ELSE 'pre' END AS period,
    CASE (event_id // 2) % 4 WHEN 0 THEN canonical
      WHEN 1 THEN array_to_string(list_transform(string_split(canonical, '_'),
                  lambda w: concat(upper(w[1]), lower(w[2:]))), '')
      WHEN 2 THEN 'evt_' || canonical ELSE replace(canonical, '_', '-') END AS event_name,
    canonical,
    CASE canonical WHEN 'app_open' THEN 'app' WHEN 'home_view' THEN 'home'
      WHEN 'product_browse' THEN 'browse' WHEN 'product_detail_view' THEN 'product_detail'
      WHEN 'add_to_cart' THEN 'product_detail' WHEN 'payment_submit' THEN 'payment'
      WHEN 'order_confirmed' THEN 'confirmation' ELSE 'checkout' END AS screen,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value * 20) AS INTEGER) END
      AS latency_ms,
    canonical = 'crash' AS is_crash,
    CASE WHEN canonical IN ('payment_submit', 'order_confirmed') THEN
      CASE (event_id % 8) // 2 WHEN 0 THEN 'card' WHEN 1 THEN 'upi' WHEN 2 THEN 'wallet'
      ELSE 'cod' END END AS payment_method
  FROM named),
evu AS (
  SELECT ev.*, os, device_type, device_age_months, geo, channel, is_returning
  FROM ev LEFT JOIN usr USING (instance_id, user_id)),
acq AS (SELECT CAST(user_id AS VARCHAR) AS user_id, min(ts) AS acquired_ts FROM events
        GROUP BY 1),
sess AS (
  SELECT instance_id, session_id, min(user_id) AS user_id,
    CAST(min(day) AS INTEGER) AS day,
    list_sort(list(DISTINCT canonical)) AS canon,
    bool_or(is_crash) AS has_crash,
    arg_min(payment_method, (event_ts, payment_method))
      FILTER (WHERE payment_method IS NOT NULL) AS pay_method,
    CASE WHEN min(day) >= 15 THEN 'post' ELSE 'pre' END AS period
  FROM ev GROUP BY instance_id, session_id),
su AS (
  SELECT sess.*, os, device_type, device_age_months, geo, channel, is_returning,
    CASE WHEN device_age_months <= 12 THEN '0-12'
         ELSE (((device_age_months + 11) // 12 - 1) * 12 + 1) || '-' ||
              (((device_age_months + 11) // 12) * 12) END AS age_band
  FROM sess LEFT JOIN usr USING (instance_id, user_id)),
attrs AS (
  SELECT s.*, attr, value FROM su s, LATERAL (VALUES
    ('os', os), ('device_type', device_type), ('device_age_months', age_band), ('geo', geo),
    ('channel', channel), ('is_returning', CAST(is_returning AS VARCHAR))) t(attr, value)),
planted AS (
  SELECT DISTINCT instance_id, user_id FROM su
  WHERE period = 'post' AND (
    (instance_id = 'case_0' AND os = 'HOUSEHOLD') OR
    (instance_id = 'case_1' AND os = 'BUILDING' AND device_age_months > 24)))
"""


def _counts(table: str, keys: str, metrics: str = "metrics") -> str:
    """n and k of every metric per key and side of the changepoint."""
    return f"""
  SELECT {keys}, from_stage, to_stage,
    count(*) FILTER (WHERE period = 'pre' AND base) AS n_pre,
    count(*) FILTER (WHERE period = 'pre' AND hit) AS k_pre,
    count(*) FILTER (WHERE period = 'post' AND base) AS n_post,
    count(*) FILTER (WHERE period = 'post' AND hit) AS k_post
  FROM (SELECT t.*, from_stage, to_stage,
          to_stage = 'crash' OR list_contains(canon, from_stage) AS base,
          CASE WHEN to_stage = 'crash' THEN has_crash
               ELSE list_contains(canon, from_stage) AND list_contains(canon, to_stage) END
            AS hit
        FROM {table} t CROSS JOIN {metrics} m)
  GROUP BY {keys}, from_stage, to_stage"""


_RATES = """SELECT *, 100.0 * CASE WHEN to_stage = 'crash' THEN rate_post - rate_pre
                    ELSE rate_pre - rate_post END AS delta_pp
  FROM (SELECT *, CAST(k_pre AS DOUBLE) / nullif(n_pre, 0) AS rate_pre,
               CAST(k_post AS DOUBLE) / nullif(n_post, 0) AS rate_post FROM ({counts}))"""


def _scan(table: str = "attrs") -> str:
    rated = _RATES.format(counts=_counts(table, "instance_id, attr, value"))
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY instance_id
      ORDER BY delta_pp DESC NULLS LAST, attr, value, from_stage) AS INTEGER) AS rnk
    FROM ({rated})"""


def _severity(cohort: str, label: str, step: tuple[str, str] | None) -> str:
    label = label.replace("'", "''")
    if step:
        base = f"list_contains(canon, '{step[0]}')"
        hit = f"{base} AND list_contains(canon, '{step[1]}')"
        metric = f"P({step[1]}|{step[0]})"
        drop = "coalesce(round(100 * (pre - post), 2), 0)"
    else:
        base, hit, metric = "true", "has_crash", "crash_rate_increase"
        drop = "round(100 * (coalesce(post, 0) - coalesce(pre, 0)), 2)"
    return f"""{BASE}
SELECT instance_id, '{label}' AS cohort, '{metric}' AS metric, cohort_sessions,
  round(100 * coalesce(pre, 0), 1) AS pre, round(100 * coalesce(post, 0), 1) AS post,
  CAST({drop} AS DOUBLE) AS realised_pp
FROM (SELECT instance_id, count(*) FILTER (WHERE inside) AS cohort_sessions,
        CAST(count(*) FILTER (WHERE inside AND period = 'pre' AND {hit}) AS DOUBLE)
          / nullif(count(*) FILTER (WHERE inside AND period = 'pre' AND {base}), 0) AS pre,
        CAST(count(*) FILTER (WHERE inside AND period = 'post' AND {hit}) AS DOUBLE)
          / nullif(count(*) FILTER (WHERE inside AND period = 'post' AND {base}), 0) AS post
      FROM (SELECT *, coalesce({cohort}, false) AS inside FROM su) GROUP BY instance_id)"""


_HIST = """, recent AS (SELECT * FROM evu WHERE event_ts >= TIMESTAMP '2024-01-01'
            + INTERVAL 15 DAY),
crash_os AS (
  SELECT instance_id, os, CAST(count(*) FILTER (WHERE is_crash) AS DOUBLE) / count(*) AS rate,
         count(*) AS n
  FROM recent GROUP BY instance_id, os HAVING count(*) > 200),
slow_os AS (
  SELECT instance_id, os, quantile_cont(latency_ms, 0.95) AS p95, count(*) AS n
  FROM recent WHERE screen = 'checkout' GROUP BY instance_id, os HAVING count(*) > 50),
crash_med AS (SELECT instance_id, median(rate) AS m FROM crash_os GROUP BY 1),
slow_med AS (SELECT instance_id, coalesce(median(p95) FILTER (WHERE p95 <> 0), 0) AS m
             FROM slow_os GROUP BY 1),
crash_top AS (
  SELECT * FROM crash_os QUALIFY row_number() OVER (PARTITION BY instance_id
    ORDER BY rate DESC, os) = 1),
slow_top AS (
  SELECT * FROM slow_os WHERE p95 IS NOT NULL QUALIFY row_number() OVER (
    PARTITION BY instance_id ORDER BY p95 DESC, os) = 1),
crash_hit AS (
  SELECT t.*, m FROM crash_top t JOIN crash_med USING (instance_id) WHERE rate > 0.01),
slow_hit AS (
  SELECT t.*, m FROM slow_top t JOIN slow_med USING (instance_id) WHERE p95 > 3000)
"""

_SYSTEMS = _HIST + f""", found AS (
  SELECT instance_id, 0 AS place, 'crash_concentration' AS mechanism_type, 'os' AS attr,
         os AS value, CAST(0.55 AS DOUBLE) AS confidence
  FROM crash_hit WHERE rate > CAST(1.05 AS DOUBLE) * m
  UNION ALL
  SELECT instance_id, 1, 'checkout_latency', 'os', os, CAST(0.5 AS DOUBLE)
  FROM slow_hit WHERE p95 > CAST(1.02 AS DOUBLE) * m),
base_h AS (
  SELECT 'baseline' AS system, instance_id,
         row_number() OVER (PARTITION BY instance_id ORDER BY place) AS rank,
         mechanism_type, attr, value, confidence FROM found
  UNION ALL
  SELECT 'baseline', instance_id, 1, 'innocent_dropoff', NULL, NULL, CAST(0.4 AS DOUBLE)
  FROM cases WHERE instance_id NOT IN (SELECT instance_id FROM found)),
scan_rows AS ({_scan()}),
scan_named AS (
  SELECT *, CASE WHEN to_stage = 'crash' THEN 'crash_concentration'
      WHEN from_stage = 'product_browse' THEN 'dead_screen'
      WHEN from_stage = 'checkout_start' THEN 'checkout_latency'
      WHEN from_stage = 'app_open' THEN 'cold_start'
      WHEN from_stage = 'payment_submit' THEN 'payment_failure' END AS mechanism_type
  FROM scan_rows),
scan_found AS (
  SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY rnk) AS rank
  FROM scan_named WHERE mechanism_type IS NOT NULL AND delta_pp > 0
  QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY rnk) <= 3),
scan_h AS (
  SELECT 'scan' AS system, instance_id, rank, mechanism_type, attr, value,
         least(1.0, delta_pp / 100) AS confidence FROM scan_found
  UNION ALL
  SELECT 'scan', instance_id, 1, 'innocent_dropoff', NULL, NULL, CAST(0.4 AS DOUBLE)
  FROM cases WHERE instance_id NOT IN (SELECT instance_id FROM scan_found)),
hyp AS (
  SELECT *, CASE WHEN attr IS NULL THEN ''
    WHEN attr = 'device_age_months' THEN
      CASE WHEN value LIKE '0-%' THEN '' ELSE 'device_age_months >= ' ||
        string_split(value, '-')[1] || ' AND ' END || 'device_age_months <= ' ||
        string_split(value, '-')[2]
    WHEN attr = 'is_returning' THEN 'is_returning = ' || upper(value)
    ELSE attr || ' = ''' || value || '''' END AS affected_cohort
  FROM (SELECT * FROM base_h UNION ALL SELECT * FROM scan_h))
"""

_PRF = """round(CASE WHEN n_claimed = 0 AND n_planted = 0 THEN 1 ELSE coalesce(
    CAST(n_both AS DOUBLE) / nullif(n_claimed, 0), 0) END, 3) AS precision,
  round(CASE WHEN n_claimed = 0 AND n_planted = 0 THEN 1 ELSE coalesce(
    CAST(n_both AS DOUBLE) / nullif(n_planted, 0), 0) END, 3) AS recall,
  round(CASE WHEN n_claimed = 0 AND n_planted = 0 THEN 1 ELSE coalesce(
    2 * (CAST(n_both AS DOUBLE) / nullif(n_claimed, 0))
      * (CAST(n_both AS DOUBLE) / nullif(n_planted, 0))
      / nullif(CAST(n_both AS DOUBLE) / nullif(n_claimed, 0)
             + CAST(n_both AS DOUBLE) / nullif(n_planted, 0), 0), 0) END, 3) AS f1"""

_JUDGED = _SYSTEMS + f""", banded AS (
  SELECT DISTINCT instance_id, user_id, attr, value FROM (
    SELECT u.*, CASE WHEN device_age_months <= 12 THEN '0-12'
         ELSE (((device_age_months + 11) // 12 - 1) * 12 + 1) || '-' ||
              (((device_age_months + 11) // 12) * 12) END AS age_band FROM usr u), LATERAL (VALUES
    ('os', os), ('device_type', device_type), ('device_age_months', age_band), ('geo', geo),
    ('channel', channel), ('is_returning', CAST(is_returning AS VARCHAR))) t(attr, value)),
n_gold AS (SELECT instance_id, count(p.user_id) AS n_planted
           FROM cases LEFT JOIN planted p USING (instance_id) GROUP BY 1),
claim_counts AS (
  SELECT h.instance_id, h.affected_cohort, count(b.user_id) AS n_claimed,
         count(p.user_id) AS n_both
  FROM (SELECT DISTINCT instance_id, affected_cohort, attr, value FROM hyp) h
  LEFT JOIN banded b USING (instance_id, attr, value)
  LEFT JOIN planted p ON p.instance_id = b.instance_id AND p.user_id = b.user_id
  GROUP BY 1, 2),
claim_prf AS (SELECT *, {_PRF} FROM claim_counts JOIN n_gold USING (instance_id)),
judged AS (
  SELECT h.*, has_fault, fault_type, precision, recall, f1,
    h.mechanism_type = CASE WHEN has_fault THEN fault_type ELSE 'innocent_dropoff' END AS ok
  FROM hyp h JOIN cases USING (instance_id) JOIN claim_prf USING (instance_id, affected_cohort)),
best AS (
  SELECT * FROM judged QUALIFY row_number() OVER (
    PARTITION BY system, instance_id ORDER BY ok DESC, rank) = 1),
scores AS (
  SELECT j.system, j.instance_id, any_value(j.has_fault) AS has_fault,
    any_value(CASE WHEN j.has_fault THEN j.fault_type END) AS gold_fault,
    max(CASE WHEN j.has_fault AND j.rank = 1 THEN j.mechanism_type END) AS top_pred,
    bool_or(CASE WHEN j.has_fault THEN j.rank = 1 AND j.ok AND j.f1 >= 0.5
                 ELSE j.rank = 1 AND j.ok END) AS top1_correct,
    bool_or(CASE WHEN j.has_fault THEN j.rank <= 3 AND j.ok AND j.f1 >= 0.5
                 ELSE j.rank <= 3 AND j.ok END) AS recall_at_3,
    any_value(CASE WHEN j.has_fault THEN b.f1 END) AS cohort_f1,
    any_value(CASE WHEN j.has_fault THEN b.precision END) AS cohort_precision,
    any_value(CASE WHEN j.has_fault THEN b.recall END) AS cohort_recall,
    bool_or(NOT j.has_fault AND j.rank = 1 AND NOT j.ok) AS false_positive
  FROM judged j JOIN best b USING (system, instance_id) GROUP BY 1, 2)
"""

_FORMS = """, forms AS (
  SELECT event_name AS name, canonical, true AS fires,
    NOT (contains(event_name, '-') AND contains(canonical, 'view')) AS documented,
    CASE WHEN event_name LIKE 'evt\\_%' ESCAPE '\\' THEN 'deprecated' ELSE 'active' END AS status,
    CASE WHEN event_name LIKE 'evt\\_%' ESCAPE '\\' OR contains(event_name, '-')
         THEN CAST(0.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight
  FROM (SELECT DISTINCT event_name, canonical FROM ev)
  UNION ALL
  SELECT DISTINCT 'legacy_' || lower(source), 'cart_view', false, true, 'deprecated',
    CAST(0 AS DOUBLE) FROM documents),
dict AS (
  SELECT name AS event_name, status, upper(left(replace(canonical, '_', ' '), 1)) ||
    lower(substr(replace(canonical, '_', ' '), 2)) || ' event.' AS description
  FROM forms WHERE documented)
"""


def _skeleton(name: str) -> str:
    split = (f"string_split(lower(regexp_replace(replace(regexp_replace({name}, "
             r"'^(evt_|track_)', ''), '-', '_'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '_')")
    return (f"array_to_string(list_transform({split}, lambda w: CASE WHEN length(w) > 3 THEN "
            "w[1] || regexp_replace(w[2:], '[aeiou]', '', 'g') ELSE w END), '_')")


_RESOLVED = _FORMS + f""", skel AS (
  SELECT {_skeleton('event_name')} AS skeleton, min(description) AS d FROM dict
  GROUP BY 1 HAVING min(description) = max(description)),
exact AS (SELECT event_name, min(description) AS d FROM dict GROUP BY 1),
resolved AS (
  SELECT n.event_name, coalesce(e.d, s.d) AS logical_key,
    CASE WHEN e.d IS NOT NULL THEN 'exact' WHEN s.d IS NOT NULL THEN 'skeleton'
         ELSE 'none' END AS how
  FROM (SELECT DISTINCT event_name FROM ev) n LEFT JOIN exact e USING (event_name)
  LEFT JOIN skel s ON s.skeleton = {_skeleton('n.event_name')})
"""


def _variants(bases: str) -> str:
    words = "string_split(base, '_')"
    cap = "lambda w: concat(upper(w[1]), lower(w[2:]))"
    pascal = f"array_to_string(list_transform({words}, {cap}), '')"
    camel = f"{words}[1] || array_to_string(list_transform({words}[2:], {cap}), '')"
    abbrev = (f"array_to_string(list_transform({words}, lambda w: CASE WHEN length(w) > 3 THEN "
              "w[1] || regexp_replace(w[2:], '[aeiou]', '', 'g') ELSE w END), '_')")
    made = {"snake": "base", "camel": camel, "pascal": pascal,
            "kebab": "replace(base, '_', '-')", "evt": "'evt_' || base",
            "track": "'track_' || base", "abbrev": abbrev}
    return " UNION ALL ".join(
        f"SELECT base, '{t}' AS transform, {x} AS variant FROM ({bases})"
        for t, x in made.items())


def _naive(period: str, where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT c.instance_id, '{period}' AS period, {i} AS stage_idx, '{stage}' AS stage, "
        f"count(DISTINCT user_id) FILTER (WHERE ({likes}) AND {where}) AS users "
        f"FROM cases c JOIN ev USING (instance_id) GROUP BY c.instance_id"
        for i, (stage, likes) in enumerate(_LIKES.items()))


_LIKES = {s: " OR ".join(f"lower(event_name) LIKE '{p}'" for p in patterns)
          for s, patterns in NAIVE_PATTERNS.items()}

_CLAIMS = """, pairs AS (SELECT DISTINCT instance_id, os, device_type FROM usr),
claims AS (
  SELECT instance_id, os, device_type, 'both' AS shape,
    'os = ''' || os || ''' AND device_type = ''' || device_type || '''' AS claim_id FROM pairs
  UNION ALL
  SELECT instance_id, os, device_type, 'either',
    'os IN (''' || os || ''') AND device_age_months > 24 OR device_type <> ''' || device_type
    || ''' AND is_returning = TRUE' FROM pairs),
claimed AS (
  SELECT claim_id, c.instance_id, user_id FROM claims c JOIN usr u USING (instance_id)
  WHERE CASE shape WHEN 'both' THEN u.os = c.os AND u.device_type = c.device_type
    ELSE (u.os = c.os AND u.device_age_months > 24)
      OR (u.device_type <> c.device_type AND u.is_returning) END)
"""

_GOLD = """, measured AS (
  SELECT instance_id,
    count(*) FILTER (WHERE period = 'pre' AND base) AS n_pre,
    count(*) FILTER (WHERE period = 'pre' AND hit) AS k_pre,
    count(*) FILTER (WHERE period = 'post' AND base) AS n_post,
    count(*) FILTER (WHERE period = 'post' AND hit) AS k_post
  FROM (SELECT instance_id, period,
          instance_id = 'case_1' OR list_contains(canon, 'product_browse') AS base,
          CASE WHEN instance_id = 'case_1' THEN has_crash
               ELSE list_contains(canon, 'product_browse')
                    AND list_contains(canon, 'product_detail_view') END AS hit
        FROM su WHERE (instance_id = 'case_0' AND os = 'HOUSEHOLD')
          OR (instance_id = 'case_1' AND os = 'BUILDING' AND device_age_months > 24))
  GROUP BY 1),
gold AS (
  SELECT c.instance_id, has_fault, fault_type, coalesce(n, 0) AS n_affected,
    predicate AS affected_cohort_predicate, target AS severity_pp_target,
    CASE WHEN NOT has_fault THEN CAST(0 AS DOUBLE)
      WHEN fault_type = 'dead_screen' THEN coalesce(round(100 * (
        CAST(k_pre AS DOUBLE) / nullif(n_pre, 0) - CAST(k_post AS DOUBLE) / nullif(n_post, 0)),
        2), 0)
      ELSE coalesce(round(100 * (coalesce(CAST(k_post AS DOUBLE) / nullif(n_post, 0), 0)
        - coalesce(CAST(k_pre AS DOUBLE) / nullif(n_pre, 0), 0)), 2), 0) END
      AS severity_pp_realised,
    CASE WHEN trap THEN 'low_intent' WHEN simpson THEN 'simpson' ELSE 'none' END
      AS confounder_type,
    trap AS is_confounder_trap, simpson AS is_simpson,
    CASE WHEN has_fault THEN fault_type ELSE 'innocent_dropoff' END AS acceptable_mechanisms,
    changepoint_day
  FROM cases c LEFT JOIN measured USING (instance_id)
  LEFT JOIN (SELECT instance_id, count(*) AS n FROM planted GROUP BY 1) USING (instance_id))
"""

_SEP = """, total AS (SELECT instance_id, count(*) AS n_affected FROM planted GROUP BY 1),
pairs AS (
  SELECT instance_id, idx, col, value, count(*) AS n, count(p.user_id) AS k
  FROM (SELECT u.instance_id, u.user_id, idx, col, value FROM usr u, LATERAL (VALUES
      (0, 'os', os), (1, 'device_type', device_type),
      (2, 'device_age_months', CAST(device_age_months AS VARCHAR)), (3, 'geo', geo),
      (4, 'channel', channel), (5, 'is_returning', CAST(is_returning AS VARCHAR)))
      t(idx, col, value)) LEFT JOIN planted p USING (instance_id, user_id)
  GROUP BY 1, 2, 3, 4),
sep AS (
  SELECT instance_id, n_affected, idx, col, value,
    (CAST(k AS DOUBLE) / n) * (CAST(k AS DOUBLE) / n_affected) AS pr,
    round(CAST(k AS DOUBLE) / n, 3) AS precision,
    round(CAST(k AS DOUBLE) / n_affected, 3) AS recall,
    round(round(CAST(k AS DOUBLE) / n, 3) * round(CAST(k AS DOUBLE) / n_affected, 3), 3)
      AS product
  FROM pairs JOIN total USING (instance_id)),
sep_best AS (
  SELECT * FROM sep WHERE pr > 0 QUALIFY row_number() OVER (PARTITION BY instance_id
    ORDER BY pr DESC, idx,
    CASE WHEN col = 'device_age_months' THEN CAST(value AS INTEGER) END, value) = 1)
"""

_WHOLE = "(SELECT 0 AS k, 'app_open' AS from_stage, 'order_confirmed' AS to_stage)"

ORDERS = """
WITH usr AS (
  SELECT 'case_' || (c_custkey % 3) AS instance_id, CAST(c_custkey AS VARCHAR) AS user_id,
         c_mktsegment AS os,
         CASE c_nationkey % 3 WHEN 0 THEN 'flagship' WHEN 1 THEN 'mid' ELSE 'budget' END
           AS device_type,
         CAST(floor((c_acctbal + 1000) / 200) AS INTEGER) AS device_age_months, r_name AS geo,
         CASE c_custkey % 3 WHEN 0 THEN 'organic' WHEN 1 THEN 'paid' ELSE 'referral' END
           AS channel,
         c_custkey % 2 = 0 AS is_returning
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
                LEFT JOIN region ON n_regionkey = r_regionkey),
stages(stage_idx, stage) AS (VALUES """ + _STAGE_VALUES + """),
metrics AS (
  SELECT a.stage AS from_stage, b.stage AS to_stage
  FROM stages a JOIN stages b ON b.stage_idx = a.stage_idx + 1
  UNION ALL SELECT 'session', 'crash'),
ev AS (
  SELECT 'case_' || (o_custkey % 3) AS instance_id, CAST(o_custkey AS VARCHAR) AS user_id,
    CAST(l_orderkey AS VARCHAR) AS session_id, o_orderdate + to_minutes(l_linenumber) AS event_ts,
    stage AS canonical,
    CASE l_linenumber WHEN 7 THEN 'checkout' ELSE 'other' END AS screen,
    CAST(floor(l_extendedprice / 20) AS INTEGER) AS latency_ms,
    l_returnflag = 'R' AND l_linestatus = 'F' AS is_crash
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN stages ON stage_idx = l_linenumber - 1),
sess AS (
  SELECT instance_id, session_id, min(user_id) AS user_id, list(DISTINCT canonical) AS canon,
    bool_or(is_crash) AS has_crash,
    CASE WHEN date_diff('day', DATE '1995-01-01', CAST(min(event_ts) AS DATE)) >= 1200
         THEN 'post' ELSE 'pre' END AS period
  FROM ev GROUP BY 1, 2),
attrs AS (
  SELECT s.*, attr, value FROM sess s JOIN (
    SELECT *, CASE WHEN device_age_months <= 12 THEN '0-12'
         ELSE (((device_age_months + 11) // 12 - 1) * 12 + 1) || '-' ||
              (((device_age_months + 11) // 12) * 12) END AS age_band FROM usr)
    USING (instance_id, user_id), LATERAL (VALUES
    ('os', os), ('device_type', device_type), ('device_age_months', age_band), ('geo', geo),
    ('channel', channel), ('is_returning', CAST(is_returning AS VARCHAR))) t(attr, value))
"""


def _funnel(keys: str, table: str) -> str:
    own = ", ".join("t." + k.strip() for k in keys.split(","))
    same = " AND ".join(f"t.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT {own}, s.stage_idx, s.stage,
  count(*) FILTER (WHERE list_contains(canon, s.stage)) AS sessions,
  count(DISTINCT user_id) FILTER (WHERE list_contains(canon, s.stage)) AS users,
  CASE WHEN s.stage_idx > 0 THEN CAST(count(*) FILTER (WHERE list_contains(canon, s.stage)
      AND list_contains(canon, p.stage)) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE list_contains(canon, p.stage)), 0) END AS step_rate,
  CAST(count(*) FILTER (WHERE list_contains(canon, s.stage) AND list_contains(canon, 'app_open'))
    AS DOUBLE) / nullif(count(*) FILTER (WHERE list_contains(canon, 'app_open')), 0)
    AS overall_rate
FROM {table} t CROSS JOIN stages s LEFT JOIN stages p ON p.stage_idx = s.stage_idx - 1
GROUP BY {own}, s.stage_idx, s.stage""".replace("{same}", same)


SQL: dict[str, str] = {}


def _add(name: str, body: str, extra: str = "", base: str = BASE) -> None:
    SQL[name] = base + extra + body


_add("scan_case", """SELECT instance_id, count(*) AS n_events, min(event_ts) AS first_ts,
  max(event_ts) AS last_ts FROM ev GROUP BY 1""")
_add("case_index", "SELECT DISTINCT instance_id FROM ev")
_add("publish_events", """SELECT user_id, session_id, event_ts, event_name, screen, os, device_type,
  device_age_months, geo, channel, is_returning, latency_ms, is_crash, payment_method, instance_id
  FROM evu""")
_add("publish_users", """SELECT user_id, os, device_type, device_age_months, geo, channel,
  is_returning, acquired_ts, instance_id FROM usr LEFT JOIN acq USING (user_id)""")
_add("day_index", """SELECT instance_id, CAST(day AS INTEGER) AS day, count(*) AS n_events FROM ev
  GROUP BY 1, 2""")
_add("period_label", """SELECT instance_id, period, count(*) AS n_events,
  CAST(min(day) AS INTEGER) AS first_day, CAST(max(day) AS INTEGER) AS last_day
  FROM ev GROUP BY 1, 2""")
_add("recent_window", """SELECT instance_id, user_id, session_id, event_ts, event_name FROM ev
  WHERE event_ts >= TIMESTAMP '2024-01-01' + INTERVAL 15 DAY""")
_add("naive_stage_match", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT instance_id, '{s}' AS stage, event_name, count(*) AS n_events FROM ev WHERE {likes} "
    "GROUP BY 1, 2, 3" for s, likes in _LIKES.items()) + ")")
_add("cohort_eq", "SELECT instance_id, user_id, os FROM usr WHERE os = 'HOUSEHOLD'")
_add("cohort_in", """SELECT instance_id, user_id, os FROM usr
  WHERE os IN ('FURNITURE', 'AUTOMOBILE')""")
_add("cohort_and", """SELECT instance_id, user_id, os, device_age_months FROM usr
  WHERE os = 'BUILDING' AND device_age_months > 24""")
_add("cohort_payment", """SELECT instance_id, session_id, user_id, pay_method FROM sess
  WHERE pay_method = 'upi'""")
_add("active_in_regression", """SELECT instance_id, session_id,
  day >= 15 AND coalesce(os = 'BUILDING' AND device_age_months > 24, false) AS active FROM su""")
_add("compile_cohort", """SELECT DISTINCT instance_id, user_id FROM usr
  WHERE (os = 'BUILDING' OR geo LIKE 'A%') AND NOT device_age_months BETWEEN 10 AND 30""")
_add("compile_cohort_events", """SELECT DISTINCT instance_id, user_id FROM evu
  WHERE payment_method = 'upi' AND is_returning""")
SQL["predicate_guard"] = """
SELECT doc_id AS claim, trim(text) = '' OR contains(t, ';') OR contains(t, '--')
  OR contains(t, 'select') OR contains(t, 'insert') OR contains(t, 'update')
  OR contains(t, 'delete') OR contains(t, 'drop') OR contains(t, 'persona')
  OR contains(t, 'canonical') AS refused
FROM (SELECT doc_id, text, lower(text) AS t FROM documents)"""
SQL["leak_guard"] = """
SELECT 'raw_events' AS table_name, count(*) AS n_rows, 'canonical' AS forbidden FROM events
UNION ALL SELECT 'events', count(*), '' FROM events
UNION ALL SELECT 'users', count(*), '' FROM customer"""
_add("dictionary_entries", "SELECT * FROM dict", _FORMS)
_add("canonical_map", "SELECT name AS event_name, canonical FROM forms WHERE fires", _FORMS)
SQL["valid_hypotheses"] = """
SELECT doc_id AS claim, m AS mechanism_type, coalesce(m IN ('dead_screen', 'checkout_latency',
  'cold_start', 'crash_concentration', 'payment_failure', 'innocent_dropoff')
  AND n_chars / 2000.0 BETWEEN 0 AND 1, false) AS accepted
FROM (SELECT *, CASE lang WHEN 'en' THEN 'dead_screen' WHEN 'fr' THEN 'cold_start'
        ELSE source END AS m FROM documents)"""
_add("case_labels", """SELECT c.instance_id, CASE WHEN trap THEN 'low_intent' WHEN simpson
  THEN 'simpson' ELSE 'none' END AS confounder_type, count(*) AS n_events
  FROM cases c JOIN ev USING (instance_id) GROUP BY 1, 2""")
_add("denormalise_events", """SELECT instance_id, os, device_type, device_age_months, geo, channel,
  is_returning, count(*) AS n_events FROM evu GROUP BY ALL""")
_add("affected_users", """SELECT instance_id, user_id FROM usr u
  WHERE os = 'BUILDING' AND device_age_months > 24 AND EXISTS (SELECT 1 FROM sess s
    WHERE s.instance_id = u.instance_id AND s.user_id = u.user_id AND s.day >= 15)""")
_add("affected_users_payment", """SELECT DISTINCT instance_id, user_id FROM sess
  WHERE day >= 15 AND pay_method = 'upi'""")
_add("methods_used", """SELECT instance_id, user_id,
  array_to_string(list_sort(list(DISTINCT pay_method)), ',') AS methods FROM sess
  WHERE day >= 15 AND pay_method IS NOT NULL GROUP BY 1, 2""")
_add("affected_flag", """SELECT u.instance_id, u.user_id, p.user_id IS NOT NULL AS affected
  FROM usr u LEFT JOIN planted p USING (instance_id, user_id)""")
_add("resolve_exact", """SELECT instance_id, event_name, canonical, count(*) AS n_events FROM ev
  GROUP BY 1, 2, 3""")
_add("case_volume", """SELECT instance_id, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
  count(DISTINCT event_name) AS n_names FROM ev GROUP BY 1""")
_add("session_rollup", """SELECT instance_id, session_id, user_id, day,
  array_to_string(canon, ',') AS canon, has_crash, pay_method, period FROM sess""")
_add("session_flags", """SELECT instance_id, session_id, user_id, day, CAST((SELECT
  coalesce(sum(1 << stage_idx), 0) FROM stages WHERE list_contains(canon, stage)) AS BIGINT)
  AS stage_mask, has_crash, pay_method, period FROM sess""")
_add("step_conversion", """SELECT instance_id, period, from_stage, to_stage,
  count(*) FILTER (WHERE list_contains(canon, from_stage)) AS n_from,
  count(*) FILTER (WHERE list_contains(canon, from_stage) AND list_contains(canon, to_stage))
    AS n_both,
  CAST(count(*) FILTER (WHERE list_contains(canon, from_stage)
    AND list_contains(canon, to_stage)) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE list_contains(canon, from_stage)), 0) AS rate
  FROM sess CROSS JOIN steps GROUP BY 1, 2, 3, 4""")
SQL["severity_dead_screen"] = _severity(
    "os = 'HOUSEHOLD'", "os = 'HOUSEHOLD'", ("product_browse", "product_detail_view"))
SQL["severity_checkout"] = _severity(
    "os = 'MACHINERY'", "os = 'MACHINERY'", ("checkout_start", "payment_submit"))
SQL["severity_cold_start"] = _severity(
    "os IN ('FURNITURE', 'AUTOMOBILE')", "os IN ('FURNITURE', 'AUTOMOBILE')",
    ("app_open", "home_view"))
SQL["severity_payment"] = _severity(
    "pay_method = 'upi'", "payment_method = 'upi'", ("payment_submit", "order_confirmed"))
SQL["severity_crash"] = _severity(
    "os = 'BUILDING' AND device_age_months > 24",
    "os = 'BUILDING' AND device_age_months > 24", None)
_add("aggregate_shift", f"""SELECT instance_id, CAST(0 AS DOUBLE) AS realised_pp,
  round(100 * (coalesce(rate_pre, 0) - coalesce(rate_post, 0)), 2) AS aggregate_pp_shift
  FROM ({_RATES.format(counts=_counts('sess', 'instance_id', _WHOLE))})""")
_add("crash_rate_by_os", "SELECT * FROM crash_os", _HIST)
_add("latency_p95_by_os", "SELECT instance_id, os, round(p95, 4) AS p95, n FROM slow_os", _HIST)
_add("symptom_by_os", """SELECT instance_id, os,
  round(100.0 * count(*) FILTER (WHERE is_crash) / count(*), 2) AS crash_pct,
  round(quantile_cont(latency_ms, 0.95) FILTER (WHERE screen = 'checkout'), 0) AS chk_p95
  FROM evu GROUP BY 1, 2""")
_add("group_median", """SELECT c.instance_id, c.m AS crash_median, round(s.m, 4) AS p95_median
  FROM crash_med c JOIN slow_med s USING (instance_id)""", _HIST)
_add("top_suspect", "SELECT instance_id, os, rate FROM crash_top", _HIST)
_add("naive_funnel", _naive("all", "true"))
_add("naive_funnel_periods", " UNION ALL ".join(
    [_naive("all", "true"), _naive("pre", "period = 'pre'"), _naive("post", "period = 'post'")]))
_add("cohort_separability", """SELECT c.instance_id, coalesce(n_affected, 0) AS n_affected, col,
  value, precision, recall, product FROM cases c LEFT JOIN sep_best USING (instance_id)""", _SEP)
_add("separability_pairs", """SELECT instance_id, n_affected, col, value, precision, recall,
  product FROM sep""", _SEP)
_add("cohort_prf", f"""SELECT *, {_PRF} FROM (
  SELECT c.instance_id, c.claim_id, count(k.user_id) AS n_claimed,
    (SELECT count(*) FROM planted p WHERE p.instance_id = c.instance_id) AS n_planted,
    count(p.user_id) AS n_both
  FROM claims c LEFT JOIN claimed k USING (instance_id, claim_id)
  LEFT JOIN planted p ON p.instance_id = k.instance_id AND p.user_id = k.user_id
  GROUP BY 1, 2)""", _CLAIMS)
_add("id_set_prf", f"""SELECT *, {_PRF} FROM (
  SELECT u.instance_id, u.pay_method AS claim_id, count(*) AS n_claimed,
    (SELECT count(*) FROM planted p WHERE p.instance_id = u.instance_id) AS n_planted,
    count(p.user_id) AS n_both
  FROM (SELECT DISTINCT instance_id, pay_method, user_id FROM sess
        WHERE period = 'post' AND pay_method IS NOT NULL) u
  LEFT JOIN planted p USING (instance_id, user_id) GROUP BY 1, 2)""")
_add("dictionary_stats", """SELECT count(*) AS n_surface_forms,
  count(*) FILTER (WHERE documented) AS n_dictionary_entries,
  count(*) FILTER (WHERE fires) AS n_firing_names,
  count(*) FILTER (WHERE fires AND NOT documented) AS n_undocumented_firing,
  count(*) FILTER (WHERE documented AND NOT fires) AS n_stale_documented FROM forms""", _FORMS)
_add("forms_by_canonical", """SELECT canonical, name, status, documented, weight,
  count(*) OVER (PARTITION BY canonical) AS n_forms,
  weight / sum(weight) OVER (PARTITION BY canonical) AS weight_share
  FROM forms WHERE fires""", _FORMS)
_add("gold_record", "SELECT * FROM gold", _GOLD)
_add("gold_users", "SELECT * FROM planted")
_add("answer_index", """SELECT instance_id, fault_type, has_fault, severity_pp_target,
  severity_pp_realised, is_confounder_trap, is_simpson, gold.n_affected,
  coalesce(product, 0) AS worst_single_col_leak
  FROM gold LEFT JOIN sep_best USING (instance_id)""", _GOLD + _SEP)
_add("detect_crash", """SELECT instance_id, 'crash_concentration' AS mechanism_type,
  'os = ''' || os || '''' AS affected_cohort, round(rate, 6) AS score,
  CAST(0.55 AS DOUBLE) AS confidence
  FROM crash_hit WHERE rate > CAST(1.05 AS DOUBLE) * m""", _HIST)
_add("detect_latency", """SELECT instance_id, 'checkout_latency' AS mechanism_type,
  'os = ''' || os || '''' AS affected_cohort, round(p95, 6) AS score,
  CAST(0.5 AS DOUBLE) AS confidence
  FROM slow_hit WHERE p95 > CAST(1.02 AS DOUBLE) * m""", _HIST)
_add("detect_none", """SELECT instance_id, 'innocent_dropoff' AS mechanism_type,
  '' AS affected_cohort, CAST(0.4 AS DOUBLE) AS confidence FROM cases
  WHERE instance_id NOT IN (SELECT instance_id FROM crash_hit
    WHERE rate > CAST(1.2 AS DOUBLE) * m)""", _HIST)
_RANKED = """SELECT system, instance_id, CAST(rank AS INTEGER) AS rank, mechanism_type,
  affected_cohort, round(confidence, 6) AS confidence FROM hyp WHERE system = '{}'"""
_add("rank_hypotheses", _RANKED.format("baseline"), _SYSTEMS)
_add("scan_hypotheses", _RANKED.format("scan"), _SYSTEMS)
_add("best_hypothesis", """SELECT system, instance_id, CAST(rank AS INTEGER) AS rank,
  mechanism_type, affected_cohort, ok, precision, recall, f1 FROM best""", _JUDGED)
_add("compile_cohort_bulk", "SELECT claim_id, instance_id, user_id FROM claimed", _CLAIMS)
_MIXED = """, mixed(claim_id) AS (VALUES ('(os = ''MACHINERY'')'), ('os == ''BUILDING'''),
  ('NOT (os = ''HOUSEHOLD'' OR geo = ''ASIA'')'), ('device_age_months BETWEEN 10 AND 20'),
  ('os LIKE ''A%'' AND device_type NOT IN (''mid'')'), ('geo IS NULL OR is_returning = FALSE'),
  ('payment_method = ''upi'''), ('all users'), ('os = ''X'' AND'), ('')),
claims AS (SELECT instance_id, claim_id FROM (SELECT DISTINCT instance_id FROM usr), mixed),
claimed AS (
  SELECT claim_id, c.instance_id, user_id FROM claims c JOIN usr u USING (instance_id)
  WHERE CASE claim_id WHEN '(os = ''MACHINERY'')' THEN os = 'MACHINERY'
    WHEN 'os == ''BUILDING''' THEN os = 'BUILDING'
    WHEN 'NOT (os = ''HOUSEHOLD'' OR geo = ''ASIA'')' THEN NOT (os = 'HOUSEHOLD' OR geo = 'ASIA')
    WHEN 'device_age_months BETWEEN 10 AND 20' THEN device_age_months BETWEEN 10 AND 20
    WHEN 'os LIKE ''A%'' AND device_type NOT IN (''mid'')' THEN os LIKE 'A%' AND device_type <> 'mid'
    WHEN 'geo IS NULL OR is_returning = FALSE' THEN geo IS NULL OR NOT is_returning
    ELSE false END)
"""
_add("compile_mixed_claims", "SELECT claim_id, instance_id, user_id FROM claimed", _MIXED)
_add("score_mixed_claims", SQL["cohort_prf"].removeprefix(BASE + _CLAIMS), _MIXED)
_add("cohort_clauses", """
SELECT instance_id, claim_id, 0 AS disjunct_id, 0 AS clause_id, 'os' AS column,
  CASE shape WHEN 'both' THEN 'eq' ELSE 'in' END AS op, os AS str_value,
  CAST(NULL AS DOUBLE) AS num_value FROM claims
UNION ALL
SELECT instance_id, claim_id, 0, 1, CASE shape WHEN 'both' THEN 'device_type'
  ELSE 'device_age_months' END, CASE shape WHEN 'both' THEN 'eq' ELSE 'gt' END,
  CASE shape WHEN 'both' THEN device_type END, CASE shape WHEN 'either' THEN 24 END FROM claims
UNION ALL
SELECT instance_id, claim_id, 1, 2, 'device_type', 'ne', device_type, NULL FROM claims
WHERE shape = 'either'
UNION ALL
SELECT instance_id, claim_id, 1, 3, 'is_returning', 'eq', 'true', NULL FROM claims
WHERE shape = 'either'""", _CLAIMS)
_add("score_cases", "SELECT * FROM scores", _JUDGED)
_add("suite_summary", """SELECT system, count(*) AS n_cases,
  count(*) FILTER (WHERE has_fault) AS n_fault,
  count(*) FILTER (WHERE has_fault AND top1_correct) AS top1,
  coalesce(round(avg(cohort_f1), 3), 0) AS mean_f1,
  count(*) FILTER (WHERE false_positive) AS false_positives FROM scores GROUP BY 1""", _JUDGED)
SQL["name_variants"] = _variants(
    "SELECT DISTINCT replace(lower(p_name), ' ', '_') || '_' || lower(p_type) AS base FROM part")
SQL["owned_variants"] = f"""
WITH bases AS (SELECT replace(lower(p_name), ' ', '_') AS base, min(p_partkey) AS position
  FROM part GROUP BY 1)
SELECT variant, arg_min(base, position) AS base
FROM ({_variants('SELECT base FROM bases')}) JOIN bases USING (base) GROUP BY 1"""
_add("resolve_names", "SELECT * FROM resolved", _RESOLVED)
_add("resolve_events", """SELECT instance_id, logical_key, count(*) AS n_events
  FROM ev JOIN resolved USING (event_name) GROUP BY 1, 2""", _RESOLVED)
_add("dictionary_audit", """SELECT event_name, d.status IS NOT NULL AS documented, d.status,
  coalesce(n, 0) AS n_events, CASE WHEN d.status IS NULL THEN 'undocumented'
    WHEN n IS NULL THEN 'silent' WHEN d.status = 'deprecated' THEN 'deprecated_firing'
    ELSE 'ok' END AS class
  FROM (SELECT event_name, count(*) AS n FROM ev GROUP BY 1) e
  FULL OUTER JOIN (SELECT event_name, min(status) AS status FROM dict GROUP BY 1) d
  USING (event_name)""", _FORMS)
_add("resolution_pr", """SELECT count(*) AS n_names, count(logical_key) AS n_resolved,
  count(*) FILTER (WHERE claimed = canonical) AS n_right,
  CAST(count(*) FILTER (WHERE claimed = canonical) AS DOUBLE) / nullif(count(logical_key), 0)
    AS precision,
  CAST(count(*) FILTER (WHERE claimed = canonical) AS DOUBLE) / nullif(count(*), 0) AS recall
  FROM (SELECT name AS event_name, canonical FROM forms WHERE fires) m
  LEFT JOIN resolved USING (event_name)
  LEFT JOIN (SELECT d.description AS logical_key, min(f.canonical) AS claimed
    FROM dict d JOIN forms f ON f.name = d.event_name WHERE f.fires GROUP BY 1)
    USING (logical_key)""", _RESOLVED)
_add("funnel_report", _funnel("instance_id, period", "sess"))
_add("funnel_by_segment", _funnel("instance_id, device_type, period", "su"))
_add("severity_scan", _scan())
_PAIRS = """, both_attrs AS (
  SELECT * FROM attrs UNION ALL BY NAME
  SELECT s.*, attr, value FROM su s, LATERAL (VALUES
    ('os&device_type', os || '&' || device_type),
    ('os&device_age_months', os || '&' || age_band), ('os&geo', os || '&' || geo),
    ('os&channel', os || '&' || channel), ('os&is_returning', os || '&' || is_returning),
    ('device_type&device_age_months', device_type || '&' || age_band),
    ('device_type&geo', device_type || '&' || geo),
    ('device_type&channel', device_type || '&' || channel),
    ('device_type&is_returning', device_type || '&' || is_returning),
    ('device_age_months&geo', age_band || '&' || geo),
    ('device_age_months&channel', age_band || '&' || channel),
    ('device_age_months&is_returning', age_band || '&' || is_returning),
    ('geo&channel', geo || '&' || channel), ('geo&is_returning', geo || '&' || is_returning),
    ('channel&is_returning', channel || '&' || is_returning)) t(attr, value))
"""
_add("severity_scan_pairs", _scan("both_attrs"), _PAIRS)


def _ztest(scan: str) -> str:
    return f"""SELECT * EXCLUDE (p), CASE WHEN to_stage = 'crash' THEN -1 ELSE 1
  END * (rate_pre - rate_post) / nullif(sqrt(p * (1 - p) * (1 / CAST(nullif(n_pre, 0) AS DOUBLE)
  + 1 / CAST(nullif(n_post, 0) AS DOUBLE))), 0) AS z
  FROM (SELECT *, CAST(k_pre + k_post AS DOUBLE) / nullif(n_pre + n_post, 0) AS p
        FROM ({scan}))"""


_add("severity_ztest", f"SELECT * REPLACE (round(z, 6) AS z) FROM ({_ztest(_scan())})")
_add("severity_discoveries", f"""SELECT instance_id, attr, value, from_stage, to_stage,
  round(p, 9) AS p, round(q, 9) AS q, coalesce(q <= 0.05, false) AS discovery
  FROM (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(raw) OVER (PARTITION BY instance_id
      ORDER BY p DESC NULLS LAST RANGE UNBOUNDED PRECEDING)) END AS q
  FROM (SELECT *, p * count(p) OVER (PARTITION BY instance_id) / nullif(count(p) OVER (
      PARTITION BY instance_id ORDER BY p NULLS LAST RANGE UNBOUNDED PRECEDING), 0) AS raw
  FROM (SELECT *, CASE WHEN z >= 0 THEN half ELSE 1 - half END AS p
  FROM (SELECT *, t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418
      + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587
      + t * (-0.82215223 + t * 0.17087277))))))))) / 2 AS half
  FROM (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + abs(z) / sqrt(2.0) / 2) AS t
  FROM ({_ztest(_scan("both_attrs"))}))))))""", _PAIRS)
_add("slo_audit", """SELECT *, p95 >= limit_ms AS breach FROM (
  SELECT instance_id, os, period, signal, round(quantile_cont(latency_ms, 0.95), 4) AS p95,
    CASE signal WHEN 'screen_load' THEN 1500 ELSE 2000 END AS limit_ms
  FROM evu, LATERAL (VALUES ('screen_load'), (CASE screen WHEN 'app' THEN 'cold_start'
    WHEN 'checkout' THEN 'checkout_screen' END)) t(signal)
  WHERE latency_ms IS NOT NULL AND signal IS NOT NULL GROUP BY 1, 2, 3, 4)""")
_add("payment_parity", """SELECT *, max(rate) OVER (PARTITION BY instance_id, period) - rate
    AS gap_to_best FROM (
  SELECT instance_id, pay_method, period,
    count(*) FILTER (WHERE list_contains(canon, 'payment_submit')) AS n_pay,
    count(*) FILTER (WHERE list_contains(canon, 'payment_submit')
      AND list_contains(canon, 'order_confirmed')) AS n_order,
    CAST(count(*) FILTER (WHERE list_contains(canon, 'payment_submit')
      AND list_contains(canon, 'order_confirmed')) AS DOUBLE)
      / nullif(count(*) FILTER (WHERE list_contains(canon, 'payment_submit')), 0) AS rate
  FROM sess WHERE pay_method IS NOT NULL GROUP BY 1, 2, 3)""")
_add("decoy_report", """SELECT *, CAST(sessions_exited AS DOUBLE) / nullif(sessions_seen, 0)
    AS exit_rate FROM (
  SELECT instance_id, 'home' AS screen, period,
    count(*) FILTER (WHERE list_contains(canon, 'home_view')) AS sessions_seen,
    count(*) FILTER (WHERE list_contains(canon, 'home_view')
      AND NOT list_contains(canon, 'product_browse')) AS sessions_exited
  FROM sess GROUP BY 1, 2, 3 UNION ALL
  SELECT instance_id, 'product_detail', period,
    count(*) FILTER (WHERE list_contains(canon, 'product_detail_view')),
    count(*) FILTER (WHERE list_contains(canon, 'product_detail_view') AND NOT list_has_any(canon,
      ['add_to_cart', 'cart_view', 'checkout_start', 'payment_submit', 'order_confirmed']))
  FROM sess GROUP BY 1, 2, 3)""")
_add("cohort_stats", _RATES.format(counts=_counts(
    "(SELECT *, CASE WHEN os = 'BUILDING' AND device_age_months > 24 THEN 'cohort' ELSE 'rest' "
    "END AS side FROM su)", "instance_id, side",
    f"(SELECT * FROM {_WHOLE} UNION ALL SELECT 9, 'session', 'crash')")))
_add("confounder_check", """SELECT instance_id, age_band,
  count(*) FILTER (WHERE crashed) AS n_crashers,
  count(*) FILTER (WHERE crashed AND NOT back) AS churned_crashers,
  count(*) FILTER (WHERE NOT crashed) AS n_others,
  count(*) FILTER (WHERE NOT crashed AND NOT back) AS churned_others,
  CAST(count(*) FILTER (WHERE crashed AND NOT back) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE crashed), 0) AS churn_crashers,
  CAST(count(*) FILTER (WHERE NOT crashed AND NOT back) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE NOT crashed), 0) AS churn_others
  FROM (SELECT instance_id, user_id, age_band, bool_or(period = 'pre') AS seen,
          bool_or(period = 'post') AS back, bool_or(period = 'pre' AND has_crash) AS crashed
        FROM su GROUP BY 1, 2, 3) WHERE seen GROUP BY 1, 2""")
_add("simpson_check", f"""SELECT instance_id, attr,
  coalesce(abs(total) < 2 AND hi > 2 AND lo < -2, false) AS flag, round(total, 6) AS total_delta,
  round(hi, 6) AS max_seg_delta, round(lo, 6) AS min_seg_delta
  FROM (SELECT instance_id, attr, max(delta_pp) AS hi, min(delta_pp) AS lo,
      100 * (CAST(sum(k_pre) AS DOUBLE) / nullif(sum(n_pre), 0)
           - CAST(sum(k_post) AS DOUBLE) / nullif(sum(n_post), 0)) AS total
    FROM ({_RATES.format(counts=_counts('attrs', 'instance_id, attr, value', _WHOLE))})
    GROUP BY 1, 2)""")
_add("mix_shift", f"""SELECT instance_id, segment, round(w_post * (r_post - r_pre), 9) AS within,
  round((w_post - w_pre) * r_pre, 9) AS mix,
  round(w_post * (r_post - r_pre) + (w_post - w_pre) * r_pre, 9) AS total
  FROM (SELECT instance_id, os AS segment,
      coalesce(n_pre / CAST(nullif(sum(n_pre) OVER w, 0) AS DOUBLE), 0) AS w_pre,
      coalesce(n_post / CAST(nullif(sum(n_post) OVER w, 0) AS DOUBLE), 0) AS w_post,
      coalesce(rate_pre, CAST(sum(k_pre) OVER w AS DOUBLE) / nullif(sum(n_pre) OVER w, 0), 0)
        AS r_pre,
      coalesce(rate_post, 0) AS r_post
    FROM ({_RATES.format(counts=_counts('su', 'instance_id, os', _WHOLE))})
    WINDOW w AS (PARTITION BY instance_id))""")
_add("detection_curve", """SELECT system, target AS severity_pp_target, count(*) AS n_cases,
  count(*) FILTER (WHERE top1_correct) AS top1,
  CAST(count(*) FILTER (WHERE top1_correct) AS DOUBLE) / count(*) AS detected
  FROM scores s JOIN cases c USING (instance_id) WHERE s.has_fault GROUP BY 1, 2""", _JUDGED)
_add("credit_bands", """SELECT *, CAST(n_full AS DOUBLE) / (n_full + n_partial + n_miss) AS strict,
  (n_full + n_partial * CAST(0.5 AS DOUBLE)) / (n_full + n_partial + n_miss) AS lenient FROM (
  SELECT system, count(*) FILTER (WHERE top1_correct AND cohort_f1 >= 0.8) AS n_full,
    count(*) FILTER (WHERE top1_correct AND cohort_f1 >= 0.5 AND cohort_f1 < 0.8) AS n_partial,
    count(*) FILTER (WHERE NOT top1_correct OR cohort_f1 < 0.5) AS n_miss
  FROM scores WHERE has_fault GROUP BY 1)""", _JUDGED)
_add("fp_and_resistance", """SELECT system, CASE WHEN trap THEN 'low_intent' WHEN simpson
    THEN 'simpson' ELSE 'none' END AS confounder_type, count(*) AS n_cases,
  avg(CAST(false_positive AS DOUBLE)) AS fp_rate, avg(CAST(top1_correct AS DOUBLE)) AS top1_rate
  FROM scores JOIN cases USING (instance_id) GROUP BY 1, 2""", _JUDGED)
_add("system_comparison", """SELECT 'baseline' AS first_system, 'scan' AS second_system, first_rate,
  second_rate, 100 * (second_rate - first_rate) AS gap_pp,
  100 * (second_rate - first_rate) >= 30 AS reached FROM (
  SELECT CAST(count(*) FILTER (WHERE system = 'baseline' AND top1_correct) AS DOUBLE)
      / nullif(count(*) FILTER (WHERE system = 'baseline'), 0) AS first_rate,
    CAST(count(*) FILTER (WHERE system = 'scan' AND top1_correct) AS DOUBLE)
      / nullif(count(*) FILTER (WHERE system = 'scan'), 0) AS second_rate
  FROM scores WHERE has_fault)""", _JUDGED)
_add("severity_calibration", """SELECT instance_id, severity_pp_target, severity_pp_realised,
  abs(severity_pp_target - severity_pp_realised) AS gap_pp,
  abs(severity_pp_target - severity_pp_realised) <= 1 AS calibrated
  FROM gold WHERE has_fault""", _GOLD)
SQL["label_agreement"] = """
SELECT n, n_agree, n_agree / CAST(n AS DOUBLE) AS agreement,
  (n_agree / CAST(n AS DOUBLE) - e) / nullif(1 - e, 0) AS kappa
FROM (SELECT *, (CAST(n_a AS DOUBLE) * n_b + CAST(n - n_a AS DOUBLE) * (n - n_b))
          / (CAST(n AS DOUBLE) * n) AS e
      FROM (SELECT count(*) AS n, count(*) FILTER (WHERE (quality = 1) = (n_chars >= 500))
              AS n_agree, count(*) FILTER (WHERE quality = 1) AS n_a,
              count(*) FILTER (WHERE n_chars >= 500) AS n_b
            FROM labels JOIN documents USING (doc_id)))"""
_BM25 = r"""
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
size AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM docs),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text),
  '[\p{L}\p{N}]+')) AS term FROM benchmark),
found AS (SELECT doc_id, dl, term, count(*) AS tf FROM (
    SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
weights AS (SELECT term, ln((n_docs - n + 0.5) / (n + 0.5)) AS w FROM (
  SELECT term, count(*) AS n FROM found GROUP BY 1), size)"""


def _bm25_ranks(name: str, k1: float, b: float) -> str:
    return f""",
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)
    AS rank FROM (
    SELECT query_id, doc_id,
      sum(w * tf * CAST({k1 + 1} AS DOUBLE) / (tf + CAST({k1} AS DOUBLE) * (
          CAST({1 - b} AS DOUBLE) + CAST({b} AS DOUBLE) * dl / mean))) AS score
    FROM found JOIN asked USING (term) JOIN weights USING (term), size
    WHERE w > 0 GROUP BY 1, 2)
  QUALIFY rank <= 10)"""


_DENSE = """
mean AS (SELECT label, list(x ORDER BY i) AS v FROM (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) GROUP BY 1, 2)
  GROUP BY 1),
dense AS (
  SELECT CAST(m.label AS BIGINT) AS query_id, vec_id AS doc_id,
    list_cosine_similarity(m.v, CAST(embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY m.label
      ORDER BY round(list_cosine_similarity(m.v, CAST(embedding AS DOUBLE[])), 9) DESC, vec_id)
      AS rank
  FROM embeddings CROSS JOIN mean m QUALIFY rank <= 10)"""
_RANKS = """
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank,
  round(round(score, 9), 6) AS score FROM {}"""
SQL["bm25_topk"] = "WITH" + _BM25 + _bm25_ranks("bm25", 1.2, 0.75) + _RANKS.format("bm25")
SQL["dense_topk"] = "WITH" + _DENSE + _RANKS.format("dense")
SQL["hybrid_topk"] = "WITH" + _BM25 + _bm25_ranks("bm25", 1.2, 0.75) + _bm25_ranks(
    "flat", 0.4, 0.0) + _RANKS.format("""(
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)
    AS rank FROM (
    SELECT query_id, doc_id, sum(CAST(1 AS DOUBLE) / (rank + 60)) AS score
    FROM (SELECT query_id, doc_id, rank FROM bm25 UNION ALL
          SELECT query_id, doc_id, rank FROM flat) GROUP BY 1, 2) QUALIFY rank <= 10)""")
_add("order_severity_scan", _scan(), base=ORDERS)
_add("order_funnel_report", _funnel("instance_id, period", "sess"), base=ORDERS)
_add("order_symptom_by_os", """SELECT instance_id, os,
  round(100.0 * count(*) FILTER (WHERE is_crash) / count(*), 2) AS crash_pct,
  round(quantile_cont(latency_ms, 0.95) FILTER (WHERE screen = 'checkout'), 0) AS chk_p95
  FROM ev JOIN usr USING (instance_id, user_id) GROUP BY 1, 2""", base=ORDERS)
