"""DuckDB SQL that says the same as the registered queries, written apart from them."""

from __future__ import annotations

REF, START, END, NOW = "2024-01-20 00:00:00", "2024-01-02 00:00:00", "2024-01-30 00:00:00", "2024-01-20 06:00:00"

EV = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, user_id, ts, k, value,
    CASE event_type WHEN 'view' THEN 'item_view' WHEN 'click' THEN 'add_to_cart' WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'rating' WHEN 'signup' THEN 'page_view' END AS event_type,
    CASE WHEN event_type <> 'signup' THEN k END AS item_id,
    CASE WHEN event_type <> 'signup' THEN 'cat' || CAST(k % 10 AS VARCHAR) END AS category,
    CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS amount,
    CASE WHEN event_type = 'error' THEN CAST(k % 5 + 1 AS DOUBLE) END AS rating,
    CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def _within(hours: int | None, at: str) -> str:
    return f"ts < {at}" if hours is None else f"ts >= {at} - INTERVAL {hours} HOUR AND ts < {at}"


def _n(kind: str, hours: int | None, at: str) -> str:
    return f"count(*) FILTER (WHERE event_type = '{kind}' AND {_within(hours, at)})"


def _sum(hours: int, at: str) -> str:
    return f"round(CAST(coalesce(sum(amount) FILTER (WHERE event_type = 'purchase' AND {_within(hours, at)}), 0) AS DOUBLE), 4)"


def _rate(hours: int, at: str) -> str:
    return f"coalesce(round(CAST({_n('purchase', hours, at)} AS DOUBLE) / nullif({_n('item_view', hours, at)}, 0), 6), 0.0)"


def _user(at: str) -> str:
    """Columns of the users' features over rows before ``at``."""
    return f"""{_n('purchase', 1, at)} AS purchase_count_1h, {_n('purchase', 24, at)} AS purchase_count_24h,
      {_n('item_view', 1, at)} AS item_view_count_1h, {_n('item_view', 24, at)} AS item_view_count_24h, {_n('add_to_cart', 1, at)} AS cart_count_1h,
      {_sum(24, at)} AS total_spend_24h, {_rate(168, at)} AS conversion_rate_7d,
      coalesce(round(CAST(epoch_us({at}) - epoch_us(max(ts) FILTER (WHERE event_type = 'purchase')) AS DOUBLE) / 86400000000.0, 4), CAST('inf' AS DOUBLE)) AS days_since_last_purchase"""


def _item(at: str) -> str:
    return f"""{_n('item_view', 1, at)} AS view_count_1h, {_n('item_view', 24, at)} AS view_count_24h, {_n('purchase', 24, at)} AS purchase_count_24h,
      {_n('add_to_cart', 1, at)} AS cart_add_count_1h, coalesce(round(avg(rating) FILTER (WHERE event_type = 'rating'), 4), 0.0) AS avg_rating,
      {_rate(24, at)} AS conversion_rate_24h, {_sum(24, at)} AS revenue_24h"""


def _sessions(key: str, source: str) -> str:
    return f"""(SELECT {key}, coalesce(round(CAST(sum(us) FILTER (WHERE n > 1) AS DOUBLE) / 60000000.0 / count(*) FILTER (WHERE n > 1), 4), 0.0) AS avg_session_duration
      FROM (SELECT {key}, session_id, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM {source} GROUP BY {key}, session_id) GROUP BY {key})"""


AT = f"TIMESTAMP '{REF}'"
GRID = f"grid AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 6 HOUR)) AS gt)"
PAST = "past AS (SELECT g.gt, e.* FROM grid g JOIN ev e ON e.ts < g.gt)"
USER_SNAPS = f"""user_snaps AS (
  SELECT u.user_id, u.gt AS feature_timestamp, u.* EXCLUDE (user_id, gt), s.avg_session_duration
  FROM (SELECT user_id, gt, {_user('gt')} FROM past GROUP BY user_id, gt) u JOIN {_sessions('user_id, gt', 'past')} s ON u.user_id = s.user_id AND u.gt = s.gt)"""
ITEM_SNAPS = f"""item_snaps AS (
  SELECT item_id, gt AS feature_timestamp, * EXCLUDE (item_id, gt), CASE WHEN max(view_count_1h) OVER (PARTITION BY gt) > 0 THEN round(CAST(view_count_1h AS DOUBLE) / max(view_count_1h) OVER (PARTITION BY gt), 6) ELSE 0.0 END AS popularity_rank_1h
  FROM (SELECT item_id, gt, {_item('gt')} FROM past WHERE item_id IS NOT NULL GROUP BY item_id, gt))"""
BOUGHT = "bought AS (SELECT user_id, item_id, min(ts) AS bought_at FROM ev WHERE event_type = 'purchase' AND item_id IS NOT NULL GROUP BY ALL)"


def _labels(cap: int | None, point_in_time: bool = False) -> str:
    miss = "(b.user_id IS NULL OR b.bought_at >= e.ts)" if point_in_time else "b.user_id IS NULL"
    limit = "" if cap is None else f"QUALIFY row_number() OVER (ORDER BY e.ts, e.event_id) <= greatest(1, {cap} - (SELECT count(*) FROM ev WHERE event_type = 'purchase' AND item_id IS NOT NULL))"
    return f"""{BOUGHT}, labels_ AS (
      SELECT user_id, item_id, min(ts) AS timestamp, CAST(label AS INTEGER) AS label FROM (
        SELECT user_id, item_id, ts, 1 AS label FROM ev WHERE event_type = 'purchase' AND item_id IS NOT NULL
        UNION ALL
        SELECT * FROM (SELECT e.user_id, e.item_id, e.ts, 0 AS label FROM ev e LEFT JOIN bought b ON e.user_id = b.user_id AND e.item_id = b.item_id
        WHERE e.event_type = 'item_view' AND e.item_id IS NOT NULL AND {miss} {limit})
      ) GROUP BY user_id, item_id, label)"""


USER_JOIN = """user_join AS (
  SELECT l.user_id, l.label, l.timestamp AS label_timestamp, s.feature_timestamp AS feature_timestamp_used, l.item_id,
    s.purchase_count_24h AS user_purchase_count_24h, s.item_view_count_24h AS user_item_view_count_24h, s.conversion_rate_7d AS user_conversion_rate_7d
  FROM labels_ l ASOF JOIN user_snaps s ON l.user_id = s.user_id AND l.timestamp > s.feature_timestamp
  WHERE s.feature_timestamp >= l.timestamp - INTERVAL 30 DAY)"""
FULL_JOIN = """full_join AS (
  SELECT u.*, i.feature_timestamp AS item_feature_timestamp_used, i.view_count_24h AS item_view_count_24h, i.purchase_count_24h AS item_purchase_count_24h, i.avg_rating AS item_avg_rating
  FROM user_join u ASOF LEFT JOIN item_snaps i ON u.item_id = i.item_id AND u.label_timestamp > i.feature_timestamp)"""
TO_USER_JOIN = f"{EV}, {GRID}, {PAST}, {USER_SNAPS}, {_labels(None)}, {USER_JOIN}"
TO_FULL_JOIN = f"{EV}, {GRID}, {PAST}, {USER_SNAPS}, {ITEM_SNAPS}, {_labels(None)}, {USER_JOIN}, {FULL_JOIN}"

NULLABLE = f"""{EV}, {GRID}, {PAST}, {USER_SNAPS}, nullable AS (
  SELECT user_id, feature_timestamp, purchase_count_24h, nullif(conversion_rate_7d, 0.0) AS conversion_rate_7d, CASE WHEN total_spend_24h > 0 THEN total_spend_24h END AS total_spend_24h
  FROM user_snaps WHERE feature_timestamp < {AT})"""


def _long(entity: str, source: str, features: dict[str, int]) -> str:
    return " UNION ALL ".join(f"SELECT '{entity}' AS entity, {entity}_id AS entity_id, '{n}' AS feature_name, CAST({n} AS VARCHAR) AS value_json, {AT} AS written_at, {AT} + INTERVAL {ttl} SECOND AS expires_at FROM {source}" for n, ttl in features.items())


ONLINE = f"""{EV}, u AS (SELECT user_id, {_user(AT)} FROM ev WHERE ts < {AT} GROUP BY user_id), i AS (SELECT item_id, {_item(AT)} FROM ev WHERE ts < {AT} AND item_id IS NOT NULL GROUP BY item_id),
online AS ({_long('user', 'u', {'purchase_count_1h': 3600, 'purchase_count_24h': 86400, 'item_view_count_24h': 86400})} UNION ALL {_long('item', 'i', {'view_count_1h': 3600, 'view_count_24h': 86400, 'purchase_count_24h': 86400})})"""
VECTORS = f"""{ONLINE}, live AS (SELECT * FROM online WHERE expires_at > TIMESTAMP '{NOW}'), vectors AS (
  SELECT p.user_id, p.item_id, a.value_json AS user_purchase_count_1h, b.value_json AS user_purchase_count_24h, c.value_json AS item_view_count_24h,
    concat_ws(',', CASE WHEN a.value_json IS NULL THEN 'user_purchase_count_1h' END, CASE WHEN b.value_json IS NULL THEN 'user_purchase_count_24h' END, CASE WHEN c.value_json IS NULL THEN 'item_view_count_24h' END) AS missing
  FROM (SELECT DISTINCT user_id, item_id FROM ev WHERE item_id IS NOT NULL) p
  LEFT JOIN live a ON a.entity = 'user' AND a.entity_id = p.user_id AND a.feature_name = 'purchase_count_1h'
  LEFT JOIN live b ON b.entity = 'user' AND b.entity_id = p.user_id AND b.feature_name = 'purchase_count_24h'
  LEFT JOIN live c ON c.entity = 'item' AND c.entity_id = p.item_id AND c.feature_name = 'view_count_24h')"""

_TOP = """SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first, category) AS rank FROM (
  SELECT {key}, category, count(*) AS n, min((epoch_us(ts), event_id)) AS first FROM {source}
  WHERE event_type = 'item_view' AND {within} AND category <> '' GROUP BY {key}, category)"""

STATS = f"""{EV}, off AS (SELECT user_id, {_user(AT)} FROM ev WHERE ts < {AT} GROUP BY user_id), pairs AS (
  SELECT 'purchase_count_24h' AS feature_name, 0.0 AS diff FROM off UNION ALL SELECT 'days_since_last_purchase', 0.0 FROM off UNION ALL SELECT 'category_affinity', 0.0 FROM off
  UNION ALL SELECT 'item_view_count_24h', CASE WHEN user_id % 3 = 0 THEN abs(item_view_count_24h * 2.0 - item_view_count_24h) / greatest(item_view_count_24h, 1e-9) ELSE 0.0 END FROM off
  UNION ALL SELECT 'total_spend_24h', CASE WHEN user_id % 40 = 0 THEN abs(total_spend_24h * 3.0 - total_spend_24h) / greatest(total_spend_24h, 1e-9) ELSE 0.0 END FROM off
  UNION ALL SELECT 'conversion_rate_7d', CASE WHEN user_id % 5 = 0 THEN abs(conversion_rate_7d * CAST(1.01 AS DOUBLE) - conversion_rate_7d) / greatest(conversion_rate_7d, 1e-9) ELSE 0.0 END FROM off
), stats AS (
  SELECT feature_name, count(*) AS n_compared, count(*) FILTER (WHERE diff > 0.05) AS n_inconsistent, round(count(*) FILTER (WHERE diff > 0.05) / count(*), 4) AS inconsistency_rate,
    round(avg(diff), 4) AS mean_relative_diff, round(max(CAST(diff AS DOUBLE)), 4) AS max_relative_diff, count(*) FILTER (WHERE diff > 0.05) / count(*) > 0.05 AS flagged
  FROM pairs GROUP BY feature_name)"""

# What each run of a stream sees: the days of the longest window before the last event of its part, for those with an event in it.
STREAMED = f"""{EV}, cut AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS part FROM ev),
parts AS (SELECT part, max(ts) + INTERVAL 1 MICROSECOND AS gt FROM cut GROUP BY part),
seen AS (SELECT p.part, p.gt, e.* EXCLUDE (part) FROM parts p JOIN cut e ON e.ts >= p.gt - INTERVAL 168 HOUR AND e.ts < p.gt)"""
_STREAMED_ITEMS = f"""items AS (SELECT item_id, gt, {_item('gt')} FROM (SELECT DISTINCT part, item_id, gt FROM cut JOIN parts USING (part) WHERE item_id IS NOT NULL) LEFT JOIN seen USING (part, item_id, gt) GROUP BY item_id, gt),
last_ AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY gt DESC) = 1)"""


def _streamed_item(name: str, ttl: int) -> str:
    return f"SELECT 'item' AS entity, item_id AS entity_id, '{name}' AS feature_name, CAST({name} AS VARCHAR) AS value_json, gt AS written_at, gt + INTERVAL {ttl} SECOND AS expires_at FROM last_"


_LATEST = f"""WITH {NULLABLE} SELECT user_id, max(feature_timestamp) AS feature_timestamp, arg_max(purchase_count_24h, feature_timestamp) AS purchase_count_24h,
  arg_max(conversion_rate_7d, feature_timestamp) FILTER (WHERE conversion_rate_7d IS NOT NULL) AS conversion_rate_7d,
  arg_max(total_spend_24h, feature_timestamp) FILTER (WHERE total_spend_24h IS NOT NULL) AS total_spend_24h FROM nullable GROUP BY user_id"""
_HISTORY = f"WITH {EV}, {GRID}, {PAST}, {USER_SNAPS} SELECT user_id, feature_timestamp, purchase_count_24h, item_view_count_24h FROM user_snaps WHERE user_id = 7 AND feature_timestamp >= TIMESTAMP '2024-01-10' AND feature_timestamp < TIMESTAMP '2024-01-17'"
_AFFINITY = f"WITH {EV}, {GRID}, {PAST} SELECT user_id, gt AS feature_timestamp, rank, category FROM ({_TOP.format(key='user_id, gt', source='past', within=_within(24, 'gt'))}) WHERE rank <= 3"

ORACLES: dict[str, str] = {
    "user_features_asof": f"WITH {EV} SELECT user_id, {AT} AS feature_timestamp, {_user(AT)} FROM ev WHERE ts < {AT} GROUP BY user_id",
    "user_session_duration": f"WITH {EV}, past AS (SELECT * FROM ev WHERE ts < {AT}) SELECT * FROM {_sessions('user_id', 'past')}",
    "user_category_affinity": f"WITH {EV} SELECT user_id, rank, category FROM ({_TOP.format(key='user_id', source='ev', within=_within(24, AT))}) WHERE rank <= 3",
    "item_features_asof": f"WITH {EV} SELECT item_id, {AT} AS feature_timestamp, {_item(AT)} FROM ev WHERE ts < {AT} AND item_id IS NOT NULL GROUP BY item_id",
    "item_popularity": f"""WITH {EV}, v AS (SELECT item_id, {_n('item_view', 1, "TIMESTAMP '2024-01-19 13:00:00'")} AS view_count_1h FROM ev WHERE item_id IS NOT NULL AND ts < TIMESTAMP '2024-01-19 13:00:00' GROUP BY item_id)
        SELECT item_id, view_count_1h, CASE WHEN max(view_count_1h) OVER () > 0 THEN round(CAST(view_count_1h AS DOUBLE) / max(view_count_1h) OVER (), 6) ELSE 0.0 END AS popularity_rank_1h FROM v""",
    "user_snapshots_6h": f"WITH {EV}, {GRID}, {PAST}, {USER_SNAPS} SELECT * FROM user_snaps",
    "user_affinity_6h": _AFFINITY,
    "item_snapshots_6h": f"WITH {EV}, {GRID}, {PAST}, {ITEM_SNAPS} SELECT * FROM item_snaps",
    "rolling_counts_per_event": f"""WITH {EV} SELECT CAST(event_id AS BIGINT) AS event_id, user_id,
          count(*) FILTER (WHERE event_type = 'item_view') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS views_1h,
          count(*) FILTER (WHERE event_type = 'item_view') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS views_24h,
          count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS purchases_7d FROM ev""",
    "entity_history_range": f"WITH {EV}, {GRID}, {PAST}, {USER_SNAPS} SELECT user_id, feature_timestamp, purchase_count_24h, item_view_count_24h FROM user_snaps WHERE user_id = 7 AND feature_timestamp >= TIMESTAMP '2024-01-10' AND feature_timestamp < TIMESTAMP '2024-01-17'",
    "latest_as_of": f"WITH {NULLABLE} SELECT * FROM nullable QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY feature_timestamp DESC) = 1",
    "latest_as_of_nonnull": _LATEST,
    "stored_latest_as_of": _LATEST,
    "label_events": f"WITH {EV}, {_labels(5000)} SELECT * FROM labels_",
    "label_events_point_in_time": f"WITH {EV}, {_labels(None, True)} SELECT * FROM labels_",
    "label_balance": f"WITH {EV}, {_labels(None)} SELECT label, count(*) AS n FROM labels_ GROUP BY label",
    "pit_join_user": f"WITH {TO_USER_JOIN} SELECT * FROM user_join",
    "pit_join_user_range": f"WITH {TO_USER_JOIN} SELECT * FROM user_join",
    "pit_join_user_grid": f"WITH {TO_USER_JOIN} SELECT * FROM user_join",
    "training_set": f"WITH {TO_FULL_JOIN} SELECT * FROM full_join",
    "asof_orders_lineitem": """WITH o AS (SELECT o_orderkey, l_suppkey, o_orderdate AS at FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1),
        s AS (SELECT l_suppkey, l_shipdate AS shipped, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL)
        SELECT o.o_orderkey, o.l_suppkey, o.at, CASE WHEN s.shipped >= o.at - INTERVAL 30 DAY THEN s.shipped END AS shipped, CASE WHEN s.shipped >= o.at - INTERVAL 30 DAY THEN s.quantity END AS quantity
        FROM o ASOF LEFT JOIN s ON o.l_suppkey = s.l_suppkey AND o.at > s.shipped""",
    "leakage_report": f"WITH {TO_FULL_JOIN} SELECT count(*) AS total_rows, count(*) FILTER (WHERE feature_timestamp_used >= label_timestamp) AS violations, count(*) FILTER (WHERE item_feature_timestamp_used >= label_timestamp) AS item_violations FROM full_join",
    "leakage_report_injected": f"WITH {TO_FULL_JOIN} SELECT count(*) AS total_rows, count(*) FILTER (WHERE user_id % 10 = 0) AS violations, CAST(0 AS BIGINT) AS item_violations FROM full_join",
    "online_ttl_visible": f"WITH {ONLINE} SELECT *, CAST(epoch(expires_at) - epoch(TIMESTAMP '{NOW}') AS BIGINT) AS ttl_seconds FROM online WHERE expires_at > TIMESTAMP '{NOW}'",
    "online_after_delete": f"WITH {ONLINE} SELECT entity, count(*) AS n, count(DISTINCT entity_id) AS n_entities FROM online WHERE NOT (entity = 'user' AND entity_id % 2 = 0) GROUP BY entity",
    "feature_vector_lookup": f"WITH {VECTORS} SELECT * FROM vectors",
    "missing_features": f"WITH {VECTORS} SELECT missing, count(*) AS n FROM vectors GROUP BY missing",
    "batch_lookup": f"""WITH {ONLINE}, r AS (SELECT event_id AS pos, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'item' END AS entity, event_id % 200 AS entity_id FROM events)
        SELECT r.pos, r.entity, r.entity_id, o.value_json AS value, CAST(CASE WHEN r.entity = 'user' THEN 2 ELSE 1 END AS BIGINT) AS n
        FROM r LEFT JOIN online o ON o.entity = r.entity AND o.entity_id = r.entity_id AND o.feature_name = CASE WHEN r.entity = 'user' THEN 'purchase_count_24h' ELSE 'view_count_24h' END""",
    "consistency_stats": f"WITH {STATS} SELECT * FROM stats",
    "consistency_flags": f"WITH {STATS} SELECT feature_name, n_inconsistent FROM stats WHERE flagged",
    "event_type_counts": f"WITH {EV} SELECT event_type, count(*) AS n, count(item_id) AS n_items FROM ev GROUP BY event_type",
    "dedup_events": "SELECT event_id, user_id, ts FROM events",
    "parse_events_json": """SELECT CASE WHEN event_id % 7 < 4 THEN 'dead' ELSE 'good' END AS kind,
          CASE event_id % 7 WHEN 0 THEN 'not an event' WHEN 1 THEN 'unknown event_type' WHEN 2 THEN 'no user_id' WHEN 3 THEN 'no ts' ELSE '' END AS reason, count(*) AS n FROM events GROUP BY ALL""",
    "label_events_capped": f"WITH {EV}, {_labels(2500)} SELECT * FROM labels_",
    "stored_history_range": _HISTORY,
    "tolerant_history": _HISTORY,
    "stored_evolving_columns": f"""WITH {EV}, {GRID}, {PAST}, {USER_SNAPS}, s AS (SELECT *, feature_timestamp >= TIMESTAMP '2024-01-14 12:00:00' AS later FROM user_snaps)
        SELECT CAST(CAST(feature_timestamp AS DATE) AS VARCHAR) AS date, count(*) AS n, CAST(sum(purchase_count_24h) AS BIGINT) AS purchases, count(*) FILTER (WHERE later) AS n_views,
          CAST(sum(item_view_count_24h) FILTER (WHERE later) AS BIGINT) AS views, min(feature_timestamp) AS first, max(feature_timestamp) AS last FROM s GROUP BY ALL""",
    "exported_training_set": f"WITH {TO_FULL_JOIN} SELECT * FROM full_join",
    "exported_affinity": _AFFINITY,
    "leakage_details": f"""WITH {TO_FULL_JOIN} SELECT label_timestamp, user_id, 'user' AS entity, label_timestamp + INTERVAL 1 SECOND AS feature_timestamp_used
        FROM full_join WHERE user_id % 10 = 0 ORDER BY label_timestamp, user_id LIMIT 10""",
    "observed_lookups": f"""WITH {VECTORS} SELECT count(*) AS rows, 3 * count(*) AS values,
          3 * count(*) - count(user_purchase_count_1h) - count(user_purchase_count_24h) - count(item_view_count_24h) AS misses FROM vectors""",
    "generated_batch": f"""SELECT count(*) AS n, CAST(0 AS BIGINT) AS off_beat, count(*) AS n_times, count(*) AS n_ids, TIMESTAMP '{START}' AS first,
          TIMESTAMP '{START}' + to_microseconds(125000 * (count(*) - 1)) AS last FROM events""",
    "streamed_user_features": f"""WITH {STREAMED} SELECT user_id, gt AS feature_timestamp, {_user('gt')} FROM (SELECT DISTINCT part, user_id, gt FROM cut JOIN parts USING (part)) LEFT JOIN seen USING (part, user_id, gt) GROUP BY user_id, gt""",
    "streamed_online_items": f"WITH {STREAMED}, {_STREAMED_ITEMS} " + " UNION ALL ".join(_streamed_item(n, ttl) for n, ttl in (("view_count_24h", 86400), ("purchase_count_24h", 86400), ("cart_add_count_1h", 3600))),
    "streamed_dead_letters": """SELECT CASE event_id % 7 WHEN 0 THEN 'not an event' WHEN 1 THEN 'unknown event_type' WHEN 2 THEN 'no user_id' ELSE 'no ts' END AS reason, count(*) AS n
        FROM events WHERE event_id % 7 < 4 GROUP BY ALL""",
    "online_upserted": f"WITH {ONLINE} SELECT *, CAST(epoch(expires_at) - epoch(TIMESTAMP '{NOW}') AS BIGINT) AS ttl_seconds FROM online WHERE expires_at > TIMESTAMP '{NOW}'",
    "generated_events": """SELECT event_type, (SELECT count(*) FROM events) AS total, CAST(weight AS DOUBLE) AS weight, true AS as_weighted, CAST(0 AS BIGINT) AS broken
        FROM (VALUES ('page_view', 0.4), ('item_view', 0.3), ('add_to_cart', 0.15), ('purchase', 0.1), ('search', 0.04), ('rating', 0.01)) w(event_type, weight)""",
    "catalog": """SELECT entity, name, dtype, CAST(hours * 3600 AS BIGINT) AS ttl_seconds, "window", description FROM (VALUES
        ('user', 'purchase_count_1h', 'int', 1, '1h', 'Purchases in the last hour'), ('user', 'purchase_count_24h', 'int', 24, '24h', 'Purchases in the last day'),
        ('user', 'item_view_count_1h', 'int', 1, '1h', 'Item views in the last hour'), ('user', 'item_view_count_24h', 'int', 24, '24h', 'Item views in the last day'),
        ('user', 'cart_count_1h', 'int', 1, '1h', 'Additions to the cart in the last hour'), ('user', 'total_spend_24h', 'float', 24, '24h', 'Money spent in the last day'),
        ('user', 'avg_session_duration', 'float', 24, NULL, 'Mean length of sessions, in minutes'), ('user', 'conversion_rate_7d', 'float', 168, '7d', 'Purchases for each item view in the last week'),
        ('user', 'category_affinity', 'list', 24, '24h', 'The three categories viewed most in the last day'), ('user', 'days_since_last_purchase', 'float', 24, NULL, 'Days since the last purchase, infinite if none'),
        ('item', 'view_count_1h', 'int', 1, '1h', 'Views in the last hour'), ('item', 'view_count_24h', 'int', 24, '24h', 'Views in the last day'),
        ('item', 'purchase_count_24h', 'int', 24, '24h', 'Purchases in the last day'), ('item', 'cart_add_count_1h', 'int', 1, '1h', 'Additions to carts in the last hour'),
        ('item', 'avg_rating', 'float', 24, NULL, 'Mean rating, 0 if none'), ('item', 'conversion_rate_24h', 'float', 24, '24h', 'Purchases for each view in the last day'),
        ('item', 'revenue_24h', 'float', 24, '24h', 'Money taken in the last day'), ('item', 'popularity_rank_1h', 'float', 1, '1h', 'Views in the last hour as a share of the most viewed item''s')
        ) c(entity, name, dtype, hours, "window", description)""",
    "parsed_events": f"WITH {EV} SELECT CAST(event_id AS BIGINT) AS event_id, user_id, event_type, item_id, ts, session_id, category, CAST(amount AS DOUBLE) AS total_amount FROM ev",
    "tumbling_window": f"WITH {EV} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM ev GROUP BY ALL",
    "sliding_window": f"WITH {EV} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL (6 * d) HOUR AS start, user_id, count(*) AS n FROM ev, range(4) r(d) GROUP BY ALL",
    "gap_sessions": f"""WITH {EV}, marked AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true) AS begins FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        numbered AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
        SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM numbered GROUP BY user_id, session""",
    "windowed_measures": f"WITH {EV} SELECT user_id, {_n('item_view', 1, AT)} AS views_1, {_n('item_view', 24, AT)} AS views_24, {_n('item_view', 168, AT)} AS views_168, {_n('item_view', None, AT)} AS views_all FROM ev GROUP BY user_id",
}


def _hours(key: str, steps: tuple[int, ...]) -> str:
    """The hours up to the watermark, an hour before the last event, at which an event of a key begins or ceases to count."""
    return f"""points AS (SELECT DISTINCT {key}, date_trunc('hour', ts) + INTERVAL 1 HOUR * (1 + step) AS gt FROM ev, (SELECT unnest([{', '.join(map(str, steps))}]) AS step)
      WHERE {key} IS NOT NULL AND date_trunc('hour', ts) + INTERVAL 1 HOUR * (1 + step) <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev)),
    known AS (SELECT p.gt, e.* FROM points p JOIN ev e ON e.{key} = p.{key} AND e.ts < p.gt)"""


ORACLES["streamed_hourly_users"] = f"WITH {EV}, {_hours('user_id', (0, 1, 24, 168))} SELECT user_id, gt AS feature_timestamp, {_user('gt')} FROM known GROUP BY user_id, gt"
ORACLES["streamed_hourly_items"] = f"""WITH {EV}, {_hours('item_id', (0, 1, 24))}, made AS (SELECT item_id, gt, {_item('gt')} FROM known GROUP BY item_id, gt)
    SELECT * EXCLUDE (gt), gt AS feature_timestamp, CASE WHEN max(view_count_1h) OVER (PARTITION BY gt) > 0 THEN round(CAST(view_count_1h AS DOUBLE) / max(view_count_1h) OVER (PARTITION BY gt), 6) ELSE 0.0 END AS popularity_rank_1h FROM made"""
ORACLES["asof_orders_any_age"] = """WITH o AS (SELECT o_orderkey, c_mktsegment AS segment, o_orderdate AS "at" FROM orders JOIN customer ON o_custkey = c_custkey),
    daily AS (SELECT segment, "at" AS ordered, count(*) AS n FROM o WHERE o_orderkey % 7 = 0 GROUP BY ALL)
    SELECT o.o_orderkey, o.segment, o."at", d.ordered, d.n FROM o ASOF LEFT JOIN daily d ON o.segment = d.segment AND o."at" > d.ordered"""
ORACLES["streamed_rejected"] = f"""WITH made AS ({ORACLES['streamed_user_features']})
    SELECT user_id, feature_timestamp, CASE WHEN NOT bad THEN purchase_count_24h END AS purchase_count_24h, CASE WHEN NOT bad THEN total_spend_24h END AS total_spend_24h,
      CASE WHEN bad THEN 'total_spend_24h is not finite' END AS reason FROM (SELECT *, user_id % 7 = 3 AND purchase_count_24h > 0 AS bad FROM made)"""
ORACLES["streamed_lookups"] = f"""WITH {ONLINE}, live AS (SELECT * FROM online WHERE expires_at > TIMESTAMP '{NOW}'),
    asked AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events),
    named(feature, entity, feature_name) AS (VALUES ('user_purchase_count_1h', 'user', 'purchase_count_1h'), ('user_purchase_count_24h', 'user', 'purchase_count_24h'), ('item_view_count_24h', 'item', 'view_count_24h'))
    SELECT feature, count(*) AS rows, count(*) FILTER (WHERE l.value_json IS NULL) AS misses, true AS quartiles_good
    FROM named n CROSS JOIN asked a LEFT JOIN live l ON l.entity = n.entity AND l.feature_name = n.feature_name AND l.entity_id = CASE n.entity WHEN 'user' THEN a.user_id ELSE a.item_id END GROUP BY feature"""
ORACLES["generated_live"] = f"SELECT n, off_beat, n_ids, first, last, CAST(0 AS BIGINT) AS missing FROM ({ORACLES['generated_batch']})"
ORACLES["generated_profiles"] = """SELECT moment, true AS good, (SELECT count(*) FROM events) AS n FROM (VALUES ('popularity_mean'), ('popularity_variance'), ('affinity_mean'), ('affinity_variance'),
    ('affinity_sum'), ('chosen_popularity'), ('chosen_affinity')) m(moment)"""
ORACLES["catalog"] = f"""WITH {EV} SELECT c.*, CASE entity WHEN 'user' THEN (SELECT count(DISTINCT user_id) FROM ev WHERE ts < {AT}) ELSE (SELECT count(DISTINCT item_id) FROM ev WHERE ts < {AT}) END AS n_entities
    FROM ({ORACLES['catalog']}) c"""
