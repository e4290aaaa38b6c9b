"""The same results as plain SQL over the driver's tables."""

from __future__ import annotations

from tapewatch.constants import (
    CATEGORY_TAGS, DEFAULT_TAGS, K_VALUES, MODEL_FEATURES, PROFILE_FEATURES)


def parse_sql(s: str, full: bool = True) -> str:
    t = f"rtrim(trim({s}), 'Z')"
    number = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    numeric = f"""
      WHEN regexp_full_match({t}, '[0-9]+') THEN CAST({t} AS BIGINT)
      WHEN regexp_matches({t}, '{number}') AND TRY_CAST({t} AS DOUBLE) > 1e8
        THEN CAST(trunc(CAST({t} AS DOUBLE)) AS BIGINT)""" if full else ""
    formats = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d"] + (["%Y-%m-%d %H:%M:%S"] if full else [])
    tries = ", ".join(f"CAST(floor(epoch(try_strptime({t}, '{f}'))) AS BIGINT)" for f in formats)
    return f"CASE WHEN {s} IS NULL OR {s} = '' THEN 0 {numeric} ELSE coalesce({tries}, 0) END"


def _tags_cases() -> str:
    whens = " ".join(
        f"WHEN '{c}' THEN [{', '.join(repr(t) for t in tags)}]" for c, tags in CATEGORY_TAGS.items())
    return f"CASE category {whens} ELSE [{', '.join(repr(t) for t in DEFAULT_TAGS)}] END"


def _tag_category() -> str:
    whens = " ".join(
        f"WHEN category IN ({', '.join(repr(t) for t in tags)}) THEN '{c}'" for c, tags in CATEGORY_TAGS.items())
    return f"CASE {whens} END"


ROUNDED = {
    "total_volume_usdc": 6, "avg_bet_usdc": 6, "max_bet_usdc": 6, "bet_size_ratio": 6, "direction_bias": 6,
    "market_concentration_hhi": 6, "time_to_news_min": 6, "time_span_hours": 6, "log_total_volume": 6,
    "log_max_bet": 6, "log_trade_count": 6,
}


# A small forest over (score_a, score_b): tree, node, feature (-1: leaf), cut, left, right, rows, depth.
FIXED_FOREST = [
    (0, 0, 0, 8.0, 1, 2, 16, 0), (0, 1, 1, 2.5, 3, 4, 10, 1), (0, 2, -1, 0.0, -1, -1, 6, 1), (0, 3, -1, 0.0, -1, -1, 9, 2),
    (0, 4, -1, 0.0, -1, -1, 1, 2), (1, 0, 1, 6.5, 1, 2, 16, 0), (1, 1, -1, 0.0, -1, -1, 14, 1), (1, 2, -1, 0.0, -1, -1, 2, 1)]
FIXED_LAYERS = [3, 2, 3]


def _path(node: int, x: tuple[str, str], tree: int) -> str:
    """The path length below a node as nested cases."""
    _, _, feature, cut, left, right, rows, depth = next(n for n in FIXED_FOREST if n[:2] == (tree, node))
    if feature >= 0:
        return f"CASE WHEN {x[feature]} > {cut} THEN {_path(right, x, tree)} ELSE {_path(left, x, tree)} END"
    more = f"2 * (ln({rows - 1}) + 0.5772156649015329) - 2 * ({rows} - 1.0::DOUBLE) / {rows}" if rows > 2 else str(rows // 2)
    return f"({depth} + {more})"


def _layers_sql() -> str:
    """The forward pass of the fixed network, a subquery per layer; ReLU but at code and output."""
    widths, at, source = [2, *FIXED_LAYERS, 2], 0, "SELECT taker, score_a / 10 AS x0, score_b / 10 AS x1, score_a / 10 AS h0, score_b / 10 AS h1 FROM fx_scores"
    for i, (a, b) in enumerate(zip(widths, widths[1:])):
        w = [f"({(k * 7919 % 101 - 50)} / 250.0::DOUBLE)" for k in range(at, at + a * b + b)]
        sums = [" + ".join([w[a * b + j], *[f"h{n} * {w[n * b + j]}" for n in range(a)]]) for j in range(b)]
        relu = i not in (len(FIXED_LAYERS) // 2, len(widths) - 2)
        cols = ", ".join(f"{f'greatest({t}, 0.0::DOUBLE)' if relu else t} AS h{j}" for j, t in enumerate(sums))
        source, at = f"SELECT taker, x0, x1, {cols} FROM ({source}) l{i}", at + a * b + b
    return source


#: Training rows of the fixed network, and those held back for validation.
HELD_BACK = "CAST('0x' || substr(md5(concat('42-', taker)), 1, 7) AS BIGINT) < CAST(floor(0.2::DOUBLE * 268435456) AS BIGINT)"


def _step_sql() -> str:
    """Gradient of the fixed network by the chain rule, mean over the training rows, and one Adam step from it."""
    widths = [2, *FIXED_LAYERS, 2]
    last = len(widths) - 2
    sizes = [a * b + b for a, b in zip(widths, widths[1:])]
    start = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    w = [f"({(k * 7919 % 101 - 50)} / 250.0::DOUBLE)" for k in range(start[-1])]
    source = f"""SELECT score_a / 10 AS h0_0, score_b / 10 AS h0_1 FROM fx_scores
WHERE is_leaked_market = 0 AND NOT {HELD_BACK}"""
    active = [i not in (len(FIXED_LAYERS) // 2, last) for i in range(last + 1)]
    for i, (a, b) in enumerate(zip(widths, widths[1:])):
        sums = [" + ".join([w[start[i] + a * b + j], *[f"h{i}_{n} * {w[start[i] + n * b + j]}" for n in range(a)]]) for j in range(b)]
        cols = ", ".join(f"{f'greatest({t}, 0.0::DOUBLE)' if active[i] else t} AS h{i + 1}_{j}" for j, t in enumerate(sums))
        source = f"SELECT *, {cols} FROM ({source}) f{i}"
    grads = []
    for i in reversed(range(last + 1)):
        a, b = widths[i], widths[i + 1]
        if i == last:
            back = [f"h{i + 1}_{j} - h0_{j}" for j in range(b)]
        else:
            back = [" + ".join(f"d{i + 1}_{n} * {w[start[i + 1] + j * widths[i + 2] + n]}" for n in range(widths[i + 2])) for j in range(b)]
        cols = ", ".join(f"{f'CASE WHEN h{i + 1}_{j} > 0 THEN {t} ELSE 0.0 END' if active[i] else t} AS d{i}_{j}" for j, t in enumerate(back))
        source = f"SELECT *, {cols} FROM ({source}) b{i}"
        grads = [f"avg(h{i}_{n} * d{i}_{j})" for n in range(a) for j in range(b)] + [f"avg(d{i}_{j})" for j in range(b)] + grads
    values = ", ".join(f"{g} + 1e-5::DOUBLE * {k}" for g, k in zip(grads, w))
    return f"""SELECT tasks, CAST(position AS INT) AS position, round(g, 9) AS gradient,
  CASE WHEN tasks = 1 THEN round(w - 0.01::DOUBLE * g / (abs(g) + 1e-8::DOUBLE), 9) END AS weight
FROM (SELECT unnest(range({len(w)})) AS position, unnest([{values}]) AS g, unnest([{", ".join(w)}]) AS w FROM ({source}) s) z,
  (VALUES (1), (4)) t(tasks)"""


def feature_list(prefix: str = "") -> str:
    return ", ".join(
        f"round({prefix}{f}, {ROUNDED[f]}) AS {f}" if f in ROUNDED else f"{prefix}{f}" for f in PROFILE_FEATURES)


CTES = {
    "fx_markets": """
SELECT m,
  concat('0x', md5(concat('mkt-', CAST(m AS VARCHAR(10))))) AS condition_id,
  substr(concat('0x', md5(concat('mkt-', CAST(m AS VARCHAR(10))))), 1, 10) AS market_id_prefix,
  CASE WHEN m % 97 < 32 THEN 1 ELSE 0 END AS is_leaked,
  CASE WHEN m % 97 < 32 THEN concat('case-', CAST(m % 97 % 8 + 8 * (m // 97) AS VARCHAR(10))) ELSE '' END AS case_id,
  CASE m % 97 % 8 % 3 WHEN 0 THEN 'regulatory_decision' WHEN 1 THEN 'military_geopolitics'
                 ELSE 'corporate_disclosure' END AS category,
  CASE m % 97 % 8 % 3 WHEN 0 THEN 'Politics' WHEN 1 THEN 'World' ELSE 'Business' END AS tag,
  1704412800 + m % 97 * 21600 AS news_timestamp,
  1704412800 + m % 97 * 21600 - 86400 AS window_start_24h,
  1704412800 + m % 97 * 21600 - 172800 AS window_start_48h
FROM (SELECT DISTINCT event_id % 97 + 97 * (event_id // 5000) AS m FROM events) z""",
    "fx_trades": """
SELECT e.event_id AS trade_id,
  CASE WHEN k.m % 2 = 0 THEN upper(k.condition_id) ELSE k.condition_id END AS condition_id,
  concat('0x', md5(concat('usr-', CAST(user_id AS VARCHAR(10)), '-',
                          CAST(event_id % 2 AS VARCHAR(10))))) AS taker,
  CASE WHEN event_id % 53 = 0 THEN NULL ELSE value END AS usdc_amount,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END AS "D",
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'BUY' ELSE 'SELL' END AS taker_direction,
  CAST(floor(epoch(ts)) AS BIGINT) AS block_timestamp,
  CAST(ts AS DATE) AS trade_date,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE k.tag END AS category,
  concat('market-', CAST(k.m AS VARCHAR(10))) AS market_slug,
  CASE WHEN k.m % 10 = 7 THEN NULL
       WHEN k.m % 10 = 3 THEN CAST(DATE '2024-01-05' + CAST(k.m % 97 // 4 AS INT) AS VARCHAR(10))
       ELSE CAST(k.news_timestamp AS VARCHAR(10)) END AS resolved_at
FROM events e JOIN fx_markets k ON e.event_id % 97 + 97 * (e.event_id // 5000) = k.m""",
    "fx_inventory": """
SELECT m, CAST(m % 97 // 8 AS INT) AS ordinal, case_id,
  concat('Case ', CAST(m % 97 % 8 + 8 * (m // 97) AS VARCHAR(10))) AS title, '2024-01-09' AS date, category,
  CASE WHEN m % 2 = 0 THEN upper(market_id_prefix) ELSE market_id_prefix END AS market_id_prefix,
  concat('Market ', CAST(m AS VARCHAR(10))) AS label,
  CASE m % 4 WHEN 0 THEN CAST(news_timestamp AS VARCHAR(10)) WHEN 1 THEN '2024-01-08T12:00:00Z'
             WHEN 2 THEN '2024-01-08' ELSE '' END AS resolution_date,
  CASE m % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE 'INVALID' END AS resolution_outcome,
  CASE m % 5 WHEN 0 THEN 'false' WHEN 1 THEN 'partial' ELSE 'true' END AS trade_history_available
FROM fx_markets WHERE m % 97 < 32""",
    "fx_flat": f"""
SELECT case_id, ordinal, title AS case_title, category, lower(market_id_prefix) AS market_id_prefix, label,
  coalesce(nullif({parse_sql('resolution_date')}, 0), {parse_sql('date')}) AS news_timestamp,
  resolution_outcome, trade_history_available IN ('true', 'partial') AS trade_available
FROM fx_inventory""",
    "fx_resolutions": """
SELECT CASE WHEN m % 3 = 0 THEN upper(condition_id) ELSE condition_id END AS condition_id,
  CASE WHEN m % 5 = 0 THEN NULL WHEN m % 2 = 0 THEN list_value(1, 0) ELSE list_value(0, 1) END AS payout_numerators,
  concat('q-', CAST(m AS VARCHAR(10))) AS question_id, 'oracle-a' AS oracle
FROM fx_markets WHERE m % 7 <> 0""",
    "fx_resolved": "SELECT market_id_prefix, condition_id FROM fx_markets WHERE m % 97 < 32 AND m % 2 = 0",
    "fx_index": """
SELECT market_id_prefix, condition_id, is_leaked, case_id,
  CASE WHEN m % 97 < 32 THEN concat('Case ', CAST(m % 97 % 8 + 8 * (m // 97) AS VARCHAR(10))) ELSE '' END AS case_title, category,
  news_timestamp, window_start_24h, window_start_48h,
  CASE WHEN m % 97 >= 32 THEN '' WHEN m % 3 = 0 THEN 'YES' WHEN m % 3 = 1 THEN 'NO' ELSE 'INVALID' END AS resolution_outcome,
  (m % 97 >= 32 OR m % 5 <> 0) AS trade_available
FROM fx_markets""",
    "fx_scores": """
SELECT taker, max(is_leaked) AS is_leaked_market, min(case_id) AS case_id,
  round(ln(1 + sum(coalesce(usdc_amount, 0))), 6) AS score_a,
  CAST(count(*) AS DOUBLE) AS score_b
FROM fx_trades t JOIN fx_markets k ON substr(lower(t.condition_id), 1, 10) = k.market_id_prefix
 AND t.block_timestamp >= k.window_start_48h AND t.block_timestamp < k.news_timestamp
GROUP BY taker""",
    "windowed": """
SELECT t.trade_id, t.condition_id, t.taker, t.usdc_amount, t."D", t.taker_direction, t.block_timestamp, t.trade_date,
  t.market_slug, m.is_leaked, m.case_id, m.case_title, m.news_timestamp, m.market_id_prefix,
  m.window_start_48h AS window_start
FROM fx_trades t JOIN fx_index m ON lower(t.condition_id) LIKE m.market_id_prefix || '%'
WHERE t.block_timestamp >= m.window_start_48h AND t.block_timestamp < m.news_timestamp""",
    "wallet_markets": """
SELECT taker, lower(condition_id) AS condition_id, sum(coalesce(usdc_amount, 0)) AS volume
FROM windowed WHERE taker IS NOT NULL GROUP BY 1, 2""",
    "wallet_hhi": """
SELECT taker, count(condition_id) AS unique_markets,
  CASE WHEN sum(volume) = 0 THEN 0 ELSE sum(volume * volume) / (sum(volume) * sum(volume)) END AS hhi
FROM wallet_markets GROUP BY taker""",
    "wallet_first": """
SELECT taker, case_id, news_timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY taker
    ORDER BY block_timestamp, lower(condition_id), news_timestamp, case_id) AS rn FROM windowed) z WHERE rn = 1""",
    "raw_profiles": """
SELECT w.taker, max(w.is_leaked) AS is_leaked_market, any_value(f.case_id) AS case_id,
  sum(coalesce(usdc_amount, 0)) AS total_volume_usdc, avg(coalesce(usdc_amount, 0)) AS avg_bet_usdc,
  max(coalesce(usdc_amount, 0)) AS max_bet_usdc,
  max(coalesce(usdc_amount, 0)) / (avg(coalesce(usdc_amount, 0)) + 1e-9) AS bet_size_ratio,
  avg(CASE WHEN "D" = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS direction_bias,
  any_value(h.unique_markets) AS unique_markets, any_value(h.hhi) AS market_concentration_hhi,
  count(*) AS trade_count,
  (any_value(f.news_timestamp) - max(block_timestamp)) / 60.0::DOUBLE AS time_to_news_min,
  (max(block_timestamp) - min(block_timestamp)) / 3600.0::DOUBLE AS time_span_hours,
  ln(1 + sum(coalesce(usdc_amount, 0))) AS log_total_volume, ln(1 + max(coalesce(usdc_amount, 0))) AS log_max_bet,
  ln(1 + CAST(count(*) AS DOUBLE)) AS log_trade_count
FROM windowed w JOIN wallet_hhi h USING (taker) JOIN wallet_first f USING (taker)
GROUP BY w.taker""",
    "profiles": f"SELECT taker, is_leaked_market, case_id, {feature_list()} FROM raw_profiles",
    "metadata": f"""
SELECT condition_id, {_tag_category()} AS category, resolved_at FROM (
  SELECT lower(condition_id) AS condition_id, min(category) AS category, min(resolved_at) AS resolved_at
  FROM fx_trades GROUP BY 1) z""",
    "leaked": """
SELECT f.market_id_prefix, coalesce(r.condition_id, f.market_id_prefix) AS condition_id, 1 AS is_leaked, case_id,
  case_title, category, news_timestamp, news_timestamp - 86400 AS window_start_24h,
  news_timestamp - 172800 AS window_start_48h, resolution_outcome, trade_available, ordinal
FROM fx_flat f LEFT JOIN fx_resolved r ON f.market_id_prefix = r.market_id_prefix""",
}
DEPENDS = {
    "fx_trades": ["fx_markets"], "fx_inventory": ["fx_markets"], "fx_flat": ["fx_inventory"],
    "fx_resolutions": ["fx_markets"], "fx_resolved": ["fx_markets"], "fx_index": ["fx_markets"],
    "fx_scores": ["fx_trades"], "windowed": ["fx_trades", "fx_index"], "wallet_markets": ["windowed"],
    "wallet_hhi": ["wallet_markets"], "wallet_first": ["windowed"], "raw_profiles": ["wallet_hhi", "wallet_first"],
    "profiles": ["raw_profiles"], "metadata": ["fx_trades"], "leaked": ["fx_flat", "fx_resolved"],
    "controls": ["metadata", "leaked"], "controls_1d": ["metadata", "leaked"], "index_built": ["controls"],
    "clusters": ["fx_flat"], "offers": ["clusters", "fx_trades"], "turns": ["offers"], "chosen": ["turns"], "candidates": ["offers", "chosen"], "curve_a": ["fx_scores"],
    "curve_b": ["fx_scores"], "both_scores": ["fx_scores"], "report": ["fx_index", "fx_resolutions"],
    "scaled": ["profiles"], "curve_models": ["both_scores"], "metrics_models": ["curve_models"],
}


def _controls(days: int) -> str:
    res = parse_sql("resolved_at")
    return f"""
SELECT substr(condition_id, 1, 10) AS market_id_prefix, condition_id, 0 AS is_leaked, '' AS case_id, '' AS case_title,
  category, res AS news_timestamp, res - 86400 AS window_start_24h, res - 172800 AS window_start_48h,
  '' AS resolution_outcome, true AS trade_available
FROM (SELECT *, {res} AS res FROM metadata WHERE resolved_at IS NOT NULL AND resolved_at <> '') k
WHERE res <> 0
  AND NOT EXISTS (SELECT 1 FROM leaked l WHERE l.trade_available AND l.condition_id = k.condition_id)
  AND NOT EXISTS (SELECT 1 FROM leaked l WHERE k.condition_id LIKE l.market_id_prefix || '%')
  AND EXISTS (SELECT 1 FROM leaked l WHERE l.trade_available AND l.category = k.category
              AND abs(k.res - l.news_timestamp) <= {days} * 86400)
ORDER BY condition_id LIMIT (SELECT 3 * count(*) FROM leaked WHERE trade_available)"""


CTES["controls"] = _controls(30)
CTES["controls_1d"] = _controls(1)
INDEX = ("market_id_prefix, condition_id, is_leaked, case_id, case_title, category, news_timestamp, window_start_24h, "
         "window_start_48h, resolution_outcome, trade_available")
CTES["index_built"] = f"""
SELECT {INDEX} FROM (
  SELECT *, row_number() OVER (PARTITION BY market_id_prefix, is_leaked ORDER BY case_id, ordinal, condition_id) AS rn
  FROM (SELECT {INDEX}, ordinal FROM leaked UNION ALL SELECT {INDEX}, 0 AS ordinal FROM controls) u) z WHERE rn = 1"""
CTES["clusters"] = """
SELECT row_number() OVER (ORDER BY place_case, place_ordinal) AS cluster_no, category, cluster_date, n_markets,
  3 * n_markets AS n_needed, cluster_news
FROM (
  SELECT category, cluster_date, count(*) OVER w AS n_markets, case_id AS place_case, ordinal AS place_ordinal,
    news_timestamp AS cluster_news,
    row_number() OVER (PARTITION BY category, cluster_date ORDER BY case_id, ordinal) AS rn
  FROM (SELECT *, CAST(make_timestamp(news_timestamp * 1000000) AS DATE) AS cluster_date FROM fx_flat WHERE trade_available) f
  WINDOW w AS (PARTITION BY category, cluster_date)) z WHERE rn = 1"""
CTES["offers"] = f"""
SELECT cluster_no, market_id_prefix, min(days_ago) AS days_ago, arg_min(z, (days_ago, condition_id)) AS z FROM (
  SELECT *, substr(condition_id, 1, 10) AS market_id_prefix, struct_pack(n_needed, cluster_news, cluster_date, category,
    condition_id, market_category, slug, resolved_at) AS z FROM (
      SELECT c.cluster_no, c.category, c.n_needed, c.cluster_news, c.cluster_date, d.days_ago,
        lower(t.condition_id) AS condition_id, min(t.category) AS market_category, min(t.market_slug) AS slug,
        min(t.resolved_at) AS resolved_at
      FROM (SELECT *, {_tags_cases()} AS tags FROM clusters) c CROSS JOIN (VALUES (0), (7)) d(days_ago)
      JOIN fx_trades t ON list_contains(c.tags, t.category) AND t.trade_date = c.cluster_date - d.days_ago
      GROUP BY ALL) a) e
WHERE NOT EXISTS (SELECT 1 FROM fx_flat l WHERE l.market_id_prefix = e.market_id_prefix)
GROUP BY cluster_no, market_id_prefix"""
# Clusters choose in turn: the recursion carries what earlier ones have taken.
CTES["turns"] = """
SELECT c.cluster_no, c.n_needed, coalesce(list(o.market_id_prefix ORDER BY o.days_ago, o.z.condition_id)
  FILTER (WHERE o.market_id_prefix IS NOT NULL), []) AS offered
FROM clusters c LEFT JOIN offers o ON c.cluster_no = o.cluster_no GROUP BY c.cluster_no, c.n_needed"""
CTES["chosen"] = """
SELECT CAST(0 AS BIGINT) AS cluster_no, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS mine
UNION ALL
SELECT t.cluster_no, list_concat(r.taken, list_slice(list_filter(t.offered, lambda p: NOT list_contains(r.taken, p)), 1, t.n_needed)),
  list_slice(list_filter(t.offered, lambda p: NOT list_contains(r.taken, p)), 1, t.n_needed)
FROM chosen r JOIN turns t ON t.cluster_no = r.cluster_no + 1"""
CTES["candidates"] = f"""
SELECT o.cluster_no, o.market_id_prefix, z.condition_id AS condition_id, z.category AS category,
  z.market_category AS market_category, z.slug AS slug,
  coalesce(nullif({parse_sql('z.resolved_at')}, 0), z.cluster_news) AS resolved_at, z.cluster_date AS cluster_date
FROM offers o JOIN (SELECT cluster_no, unnest(mine) AS market_id_prefix FROM chosen) m
  ON o.cluster_no = m.cluster_no AND o.market_id_prefix = m.market_id_prefix"""


def _curve(source: str, score: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"{by}, score" if by else "score"
    return f"""
SELECT *, lead(n) OVER w AS next_n, lead(pos) OVER w AS next_pos, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos,
  sum(n) OVER ({part}) AS total_n, sum(pos) OVER ({part}) AS total_pos
FROM (SELECT {keys}{score} AS score, CAST(count(*) AS BIGINT) AS n, CAST(sum(is_leaked_market) AS BIGINT) AS pos
      FROM {source} GROUP BY {group}) z WINDOW w AS ({part} ORDER BY score DESC)"""


CTES["curve_a"] = _curve("fx_scores", "score_a")
CTES["curve_b"] = _curve("fx_scores", "score_b")
CTES["both_scores"] = """
SELECT 'a' AS model, taker, is_leaked_market, score_a AS score FROM fx_scores
UNION ALL SELECT 'b', taker, is_leaked_market, score_b FROM fx_scores"""
CTES["curve_models"] = _curve("both_scores", "score", "model")
ON_ROC = "(cum_n = n OR cum_n = total_n OR next_pos <> pos OR next_n - next_pos <> n - pos)"
FPR = "(cum_n - cum_pos) / nullif(CAST(total_n - total_pos AS DOUBLE), 0)"
TPR = "cum_pos / nullif(CAST(total_pos AS DOUBLE), 0)"
_PRECISIONS = ", ".join(
    f"avg(CASE WHEN rn <= {k} THEN CAST(is_leaked_market AS DOUBLE) END) AS precision_at_{k}" for k in K_VALUES)
CTES["metrics_models"] = f"""
SELECT c.model, n_positive, n_total, n_positive / n_total AS base_rate, roc_auc, pr_auc, recall_at_1pct_fpr,
  {", ".join(f"precision_at_{k}" for k in K_VALUES)}
FROM (
  SELECT model, CAST(max(total_pos) AS DOUBLE) AS n_positive, CAST(max(total_n) AS DOUBLE) AS n_total,
    sum((n - pos) * (cum_pos - pos / 2.0::DOUBLE)) / max(total_pos * (total_n - total_pos)) AS roc_auc,
    sum(pos * cum_pos / CAST(cum_n AS DOUBLE)) / max(total_pos) AS pr_auc
  FROM curve_models GROUP BY model) c
JOIN (
  SELECT model, tpr AS recall_at_1pct_fpr FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(fpr - 0.01::DOUBLE), fpr, tpr) AS rn FROM (
      SELECT model, {FPR} AS fpr, {TPR} AS tpr FROM curve_models WHERE {ON_ROC}
      UNION ALL SELECT DISTINCT model, 0.0::DOUBLE, 0.0::DOUBLE FROM curve_models) p) q WHERE rn = 1) r USING (model)
JOIN (
  SELECT model, {_PRECISIONS} FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, taker) AS rn FROM both_scores) t
  GROUP BY model) p USING (model)"""
CTES["report"] = """
SELECT m.market_id_prefix, m.condition_id, m.is_leaked, m.case_id, m.case_title, m.category, m.news_timestamp,
  m.resolution_outcome AS inventory_outcome, array_to_string(c.payout_numerators, ',') AS payout_numerators,
  c.question_id, c.oracle, coalesce(len(c.payout_numerators) > 0, false) AS ctf_resolved,
  c.payout_numerators[1] AS yes, c.payout_numerators[2] AS no
FROM fx_index m LEFT JOIN fx_resolutions c
  ON lower(m.condition_id) = lower(c.condition_id) OR lower(c.condition_id) LIKE lower(m.market_id_prefix) || '%'"""
REPORT = ("market_id_prefix, condition_id, is_leaked, case_id, case_title, category, news_timestamp, "
          "inventory_outcome, payout_numerators, question_id, oracle, ctf_resolved")
CTES["scaled"] = f"""
SELECT taker, is_leaked_market, case_id, {", ".join(
    f"round((CAST({f} AS DOUBLE) - s.mean_{f}) / s.std_{f}, 6) AS {f}" for f in MODEL_FEATURES)}
FROM profiles CROSS JOIN (SELECT {", ".join(
    f"avg({f}) AS mean_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) AS std_{f}" for f in MODEL_FEATURES)}
  FROM profiles WHERE is_leaked_market = 0) s"""


def with_ctes(body: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for d in DEPENDS.get(name, []):
            add(d)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


TRADES = ('trade_id, condition_id, taker, usdc_amount, "D", taker_direction, block_timestamp, trade_date, category, '
          "market_slug, resolved_at")
WINDOWED = ('trade_id, condition_id, taker, usdc_amount, "D", taker_direction, block_timestamp, trade_date, market_slug, '
            "is_leaked, case_id, case_title, news_timestamp, market_id_prefix, window_start")
PARSE_TEXT = """CASE event_id % 11
  WHEN 0 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  WHEN 2 THEN concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'Z') WHEN 3 THEN strftime(ts, '%Y-%m-%d')
  WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 5 THEN concat(CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR), '.75')
  WHEN 6 THEN concat('2024-1-', CAST(day(ts) AS VARCHAR)) WHEN 7 THEN concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '.5')
  WHEN 8 THEN event_type WHEN 9 THEN '' ELSE NULL END"""
HIST = """
  SELECT keys, lo, hi, total, (hi - lo) / {bins}.0::DOUBLE AS width FROM (
    SELECT keys, count(*) AS total, CASE WHEN min(v) = max(v) THEN min(v) - 0.5::DOUBLE ELSE min(v) END AS lo,
      CASE WHEN min(v) = max(v) THEN max(v) + 0.5::DOUBLE ELSE max(v) END AS hi FROM src GROUP BY keys) z"""


def histogram_sql(rows: str, keys: list[str], bins: int, needs: list[str], head: str = "") -> str:
    """Histogram of (keys, v) rows."""
    k = ", ".join(keys)
    span = HIST.format(bins=bins).replace("keys", k)
    on = " AND ".join(f"s.{x} = r.{x}" for x in keys)
    join = " AND ".join(f"g.{x} = c.{x}" for x in keys)
    gk = ", ".join(f"g.{x}" for x in keys)
    sk = ", ".join(f"s.{x}" for x in keys)
    return with_ctes(f"""{'' if needs else 'WITH'}, src AS ({rows}), span AS ({span}),
counts AS (SELECT {sk}, CAST(least(floor((r.v - s.lo) / s.width), {bins - 1}) AS INT) AS bin, count(*) AS n
  FROM src r JOIN span s ON {on} GROUP BY ALL)
SELECT {head}{gk}, CAST(g.bin AS INT) AS bin, round(lo + g.bin * width, 9) AS lo, round(lo + (g.bin + 1) * width, 9) AS hi,
  coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (total * width), 9) AS density
FROM (SELECT s.*, unnest(range({bins})) AS bin FROM span s) g LEFT JOIN counts c ON {join} AND g.bin = c.bin""", *needs)


def _metric_columns() -> str:
    return ", ".join([
        "model", "CAST(n_positive AS BIGINT) AS n_positive", "CAST(n_total AS BIGINT) AS n_total",
        "round(base_rate, 9) AS base_rate", "round(roc_auc, 9) AS roc_auc", "round(pr_auc, 9) AS pr_auc",
        "round(recall_at_1pct_fpr, 9) AS recall_at_1pct_fpr",
        *[f"round(precision_at_{k}, 9) AS precision_at_{k}" for k in K_VALUES],
        *[f"round(precision_at_{k} / base_rate, 9) AS lift_at_{k}" for k in K_VALUES]])


def _describe(source: str, cols: list[str], digits: int, quartile_digits: int) -> str:
    parts = []
    for c in cols:
        v = f'CAST("{c}" AS DOUBLE)'
        parts.append(f"""SELECT '{c}' AS feature, count("{c}") AS n, round(avg({v}), {digits}) AS mean,
  round(stddev_samp({v}), {digits}) AS std, min({v}) AS min, round(quantile_cont({v}, 0.25), {quartile_digits}) AS q25,
  round(quantile_cont({v}, 0.5), {quartile_digits}) AS q50, round(quantile_cont({v}, 0.75), {quartile_digits}) AS q75, max({v}) AS max FROM {source}""")
    return " UNION ALL ".join(parts)


def _corr() -> str:
    parts = []
    for a in PROFILE_FEATURES:
        for b in PROFILE_FEATURES:
            x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            parts.append(f"SELECT '{a}' AS f1, '{b}' AS f2, round(covar_pop({x}, {y}) / "
                         f"nullif(stddev_pop({x}) * stddev_pop({y}), 0), 6) AS r FROM stored")
    return ", stored AS MATERIALIZED (SELECT * FROM profiles) " + " UNION ALL ".join(parts)


def _unpivot(columns: str, cols: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {columns}'{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {source}" for c in cols)


def _quantiles() -> str:
    parts = [f"SELECT '{f}' AS feature, CAST({p} AS DOUBLE) AS prob, round(quantile_cont(CAST({f} AS DOUBLE), {p}), 9) "
             f"AS quantile FROM stored" for f in PROFILE_FEATURES for p in (0.01, 0.99)]
    return ", stored AS MATERIALIZED (SELECT * FROM profiles) " + " UNION ALL ".join(parts)


SAMPLE = "SELECT * FROM {src} WHERE is_leaked_market = 0 ORDER BY md5(concat('42-', taker)), taker LIMIT 5000"


def oracles() -> dict[str, str]:
    sql: dict[str, str] = {}

    def put(key: str, body: str, *needs: str) -> None:
        sql[key] = with_ctes(body, *needs)

    # Sources and sinks
    put("scan_trades", f"SELECT {TRADES} FROM fx_trades", "fx_trades")
    put("scan_date_window", """
SELECT 'discovery' AS part, trade_id, trade_date FROM fx_trades
WHERE trade_date IN (DATE '2024-01-16', DATE '2024-01-09')
UNION ALL SELECT 'trading', trade_id, trade_date FROM fx_trades
WHERE trade_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-15'""", "fx_trades")
    put("inventory_flatten", """SELECT case_id, ordinal, case_title, category, market_id_prefix, label,
  news_timestamp, resolution_outcome, trade_available FROM fx_flat""", "fx_flat")
    put("resolved_ids", "SELECT market_id_prefix, condition_id FROM fx_resolved", "fx_resolved")
    put("stage_sink", f"SELECT taker, is_leaked_market, case_id, {feature_list()} FROM raw_profiles", "raw_profiles")
    put("report_csv", """SELECT market_id_prefix, condition_id, CAST(is_leaked AS VARCHAR) AS is_leaked,
  nullif(case_id, '') AS case_id, CASE WHEN payout_numerators IS NULL THEN NULL ELSE '[' || payout_numerators || ']' END
  AS payout_numerators, question_id, CAST(ctf_resolved AS VARCHAR) AS ctf_resolved FROM report""", "report")
    put("prefix_json", """SELECT l.market_id_prefix, r.condition_id FROM (
  SELECT DISTINCT lower(market_id_prefix) AS market_id_prefix FROM fx_inventory) l
LEFT JOIN fx_resolved r ON l.market_id_prefix = r.market_id_prefix""", "fx_inventory", "fx_resolved")
    put("partitioned_append", """SELECT trade_id, condition_id, taker, usdc_amount, block_timestamp,
  substr(lower(condition_id), 1, 10) AS market_id_prefix FROM fx_trades t
WHERE EXISTS (SELECT 1 FROM fx_inventory i WHERE lower(t.condition_id) LIKE lower(i.market_id_prefix) || '%')""",
        "fx_trades", "fx_inventory")
    put("union_by_name", """SELECT trade_id, taker, CASE WHEN taker_direction = 'BUY' THEN "D" END AS "D",
  CASE WHEN taker_direction = 'SELL' THEN taker_direction END AS taker_direction FROM fx_trades""", "fx_trades")
    put("tolerant_scan", "SELECT trade_id, taker, usdc_amount, CAST(NULL AS VARCHAR) AS category_refined FROM fx_trades",
        "fx_trades")

    # Projection and predicates
    put("norm_ids", """SELECT trade_id, lower(condition_id) AS condition_id,
  substr(lower(condition_id), 1, 10) AS market_id_prefix FROM fx_trades""", "fx_trades")
    put("parse_ts", f"""SELECT event_id, {parse_sql('s')} AS unix_seconds, {parse_sql('s', False)} AS unix_seconds_short
FROM (SELECT event_id, {PARSE_TEXT} AS s FROM events) z""")
    put("market_filter", f"""SELECT {TRADES} FROM fx_trades t
WHERE lower(condition_id) IN (SELECT lower(condition_id) FROM fx_resolved)
   OR EXISTS (SELECT 1 FROM fx_inventory i WHERE lower(t.condition_id) LIKE lower(i.market_id_prefix) || '%')""",
        "fx_trades", "fx_resolved", "fx_inventory")
    put("route_prefix", """, listed AS (
  SELECT market_id_prefix AS p, 2 * m + 1 AS ord FROM fx_markets WHERE m % 97 < 32
  UNION ALL SELECT substr(market_id_prefix, 1, 6), 2 * m FROM fx_markets WHERE m % 97 < 32 AND m % 2 = 0)
SELECT t.trade_id, coalesce((SELECT min_by(p, ord) FROM listed WHERE lower(t.condition_id) LIKE p || '%'),
  substr(lower(t.condition_id), 1, 10)) AS routed_prefix FROM fx_trades t""", "fx_trades")
    put("mins_before_news", """SELECT trade_id, market_id_prefix,
  round((news_timestamp - block_timestamp) / 60.0::DOUBLE, 6) AS mins_before_news FROM windowed""", "windowed")

    # Joins
    put("prenews_trades", f"SELECT {WINDOWED} FROM windowed", "windowed")
    put("prenews_trades_24h", f"""SELECT {WINDOWED.replace('window_start', 'window_start + 86400 AS window_start')}
FROM windowed WHERE block_timestamp >= window_start + 86400""", "windowed")
    put("validate_resolutions", f"SELECT {REPORT} FROM report", "report")
    put("resolution_consistency", """SELECT market_id_prefix, question_id, inventory_outcome, CASE
  WHEN yes IS NULL OR no IS NULL OR yes = no OR inventory_outcome NOT IN ('YES', 'NO') THEN 'unknown'
  WHEN (inventory_outcome = 'YES') = (yes > no) THEN 'consistent' ELSE 'inconsistent' END AS consistency
FROM report""", "report")
    put("leaked_sample", """SELECT market_id_prefix, case_id, inventory_outcome, payout_numerators, ctf_resolved
FROM report WHERE is_leaked = 1 ORDER BY case_id, market_id_prefix, question_id LIMIT 15""", "report")
    put("resolve_ids", """SELECT i.market_id_prefix, min(t.condition_id) AS condition_id FROM (
  SELECT DISTINCT lower(market_id_prefix) AS market_id_prefix FROM fx_inventory) i JOIN (
  SELECT DISTINCT lower(condition_id) AS condition_id FROM fx_trades) t ON t.condition_id LIKE i.market_id_prefix || '%'
GROUP BY 1""", "fx_inventory", "fx_trades")

    # Index and controls
    put("market_metadata", """SELECT lower(condition_id) AS condition_id, min(category) AS category,
  CAST(NULL AS VARCHAR) AS category_refined, min(resolved_at) AS resolved_at, min(market_slug) AS market_slug
FROM fx_trades GROUP BY 1""", "fx_trades")
    put("select_controls", f"SELECT {INDEX} FROM controls", "controls")
    put("select_controls_1d", f"SELECT {INDEX} FROM controls_1d", "controls_1d")
    put("market_index", f"SELECT {INDEX} FROM index_built", "index_built")
    put("case_clusters", """SELECT CAST(cluster_no AS INT) AS cluster_no, category, cluster_date, n_markets, n_needed,
  cluster_news FROM clusters""", "clusters")
    put("control_candidates", """SELECT CAST(cluster_no AS INT) AS cluster_no, market_id_prefix, condition_id, category,
  market_category, slug, resolved_at FROM candidates""", "candidates")
    put("control_trades", """SELECT t.trade_id, t.condition_id, t.taker, t.usdc_amount, t.block_timestamp, t.trade_date,
  c.market_id_prefix, c.category, c.resolved_at
FROM fx_trades t JOIN candidates c ON lower(t.condition_id) LIKE c.market_id_prefix || '%'
  AND t.trade_date BETWEEN c.cluster_date - 5 AND c.cluster_date - 1""", "fx_trades", "candidates")

    # Aggregations
    put("trader_profiles", f"SELECT taker, is_leaked_market, case_id, {feature_list()} FROM raw_profiles", "raw_profiles")
    put("volume_by_market", "SELECT taker, condition_id, round(volume, 6) AS volume FROM wallet_markets", "wallet_markets")
    put("trader_hhi", "SELECT taker, round(hhi, 9) AS market_concentration_hhi FROM wallet_hhi", "wallet_hhi")
    put("unique_markets", "SELECT taker, unique_markets FROM wallet_hhi", "wallet_hhi")
    put("direction_bias", """SELECT taker, round(avg(CASE WHEN "D" = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS by_number,
  round(avg(CASE WHEN taker_direction = 'BUY' THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS by_text,
  0.5::DOUBLE AS by_nothing FROM windowed GROUP BY taker""", "windowed")
    put("buy_fraction", """SELECT taker, is_leaked, round(avg(CASE WHEN "D" = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 9)
  AS buy_fraction FROM windowed GROUP BY 1, 2""", "windowed")
    put("inventory_summary", """SELECT case_id, date, category, title, count(DISTINCT case_id) AS cases, count(*) AS markets,
  count(*) FILTER (WHERE trade_history_available = 'true') AS available FROM fx_inventory
GROUP BY GROUPING SETS ((case_id, date, category, title), ())""", "fx_inventory")
    put("category_crosstab", """SELECT category, count(*) FILTER (WHERE is_leaked = 0) AS n_control,
  count(*) FILTER (WHERE is_leaked = 1) AS n_leaked FROM fx_index GROUP BY 1""", "fx_index")
    put("market_date_range", """SELECT strftime(make_timestamp(min(news_timestamp) * 1000000), '%Y-%m-%d %H:%M:%S') AS first_news,
  strftime(make_timestamp(max(news_timestamp) * 1000000), '%Y-%m-%d %H:%M:%S') AS last_news FROM fx_index""", "fx_index")
    put("stage_counts", """SELECT count(*) AS n_trades, count(DISTINCT taker) AS n_takers,
  CAST(sum(is_leaked) AS BIGINT) AS n_leaked_trades FROM windowed""", "windowed")
    put("label_counts", """SELECT 'market_index' AS stage, count(*) FILTER (WHERE is_leaked = 1) AS n_leaked,
  count(*) FILTER (WHERE is_leaked = 0) AS n_control, count(*) AS n_total FROM fx_index
UNION ALL SELECT 'profiles', count(*) FILTER (WHERE is_leaked_market = 1), count(*) FILTER (WHERE is_leaked_market = 0),
  count(*) FROM raw_profiles""", "fx_index", "raw_profiles")
    put("profile_quality", f"""SELECT count(*) AS row_count, {", ".join(
        f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in ["taker", "is_leaked_market", "case_id", *PROFILE_FEATURES])}
FROM raw_profiles""", "raw_profiles")
    put("describe_trades", _describe("windowed", ["trade_id", "usdc_amount", "D", "block_timestamp", "is_leaked",
                                                  "news_timestamp", "window_start"], 3, 6), "windowed")
    put("describe_profiles", ", stored AS MATERIALIZED (SELECT * FROM profiles) "
        + _describe("stored", ["is_leaked_market", *PROFILE_FEATURES], 6, 9), "profiles")
    put("feature_corr", _corr(), "profiles")
    put("feature_quantiles", _quantiles(), "profiles")
    sql["histogram_clip"] = histogram_sql("""
SELECT 'amount' AS plot, is_leaked, least(usdc_amount, 5000.0::DOUBLE) AS v FROM windowed WHERE usdc_amount IS NOT NULL""",
                                          ["plot", "is_leaked"], 50, ["windowed"])
    sql["histogram_timing"] = histogram_sql("""
SELECT is_leaked, least(greatest((news_timestamp - block_timestamp) / 60.0::DOUBLE, 0), 2880) AS v FROM windowed""",
                                            ["is_leaked"], 48, ["windowed"])
    sql["histogram_buy_share"] = histogram_sql("""
SELECT is_leaked, avg(CASE WHEN "D" = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS v FROM windowed GROUP BY taker, is_leaked""",
                                               ["is_leaked"], 30, ["windowed"])
    sql["score_histogram"] = histogram_sql(
        "SELECT is_leaked_market, score_a AS v FROM fx_scores", ["is_leaked_market"], 50, ["fx_scores"])
    clipped = " UNION ALL ".join(f"""
SELECT '{f}' AS feature, is_leaked_market, least(greatest(CAST({f} AS DOUBLE),
  (SELECT quantile_cont(CAST({f} AS DOUBLE), 0.01) FROM profiles)),
  (SELECT quantile_cont(CAST({f} AS DOUBLE), 0.99) FROM profiles)) AS v FROM profiles""" for f in PROFILE_FEATURES)
    sql["feature_histogram"] = histogram_sql(clipped, ["feature", "is_leaked_market"], 30, ["profiles"]).replace(
        "profiles AS (", "profiles AS MATERIALIZED (")

    # Ranks, samples, models
    put("score_rank", """SELECT taker, score_b, rank() OVER (ORDER BY score_b DESC) AS rank_b,
  rank() OVER (ORDER BY score_a DESC) AS rank_a FROM fx_scores""", "fx_scores")
    put("top_anomalies", """SELECT taker, is_leaked_market, case_id, score_a FROM fx_scores
ORDER BY score_a DESC, taker LIMIT 20""", "fx_scores")
    put("loco_cases", "SELECT DISTINCT case_id FROM fx_scores WHERE is_leaked_market = 1 AND case_id <> ''", "fx_scores")
    put("sample_controls", f"SELECT taker, case_id FROM ({SAMPLE.format(src='profiles')}) z", "profiles")
    put("train_val_split", """SELECT taker, CAST('0x' || substr(md5(concat('42-', taker)), 1, 7) AS BIGINT)
  < CAST(floor(0.2::DOUBLE * 268435456) AS BIGINT) AS is_validation FROM profiles WHERE is_leaked_market = 0""", "profiles")
    put("scale_features", "SELECT * FROM scaled", "scaled")
    put("ensemble_scores", """SELECT taker, is_leaked_market, case_id, anomaly_score_if, anomaly_score_ae,
  round(a, 9) AS score_if_norm, round(b, 9) AS score_ae_norm, round((a + b) / 2, 9) AS anomaly_score_ensemble,
  rank() OVER (ORDER BY (a + b) / 2 DESC) AS rank_ensemble
FROM (SELECT taker, is_leaked_market, case_id, score_a AS anomaly_score_if, score_b AS anomaly_score_ae,
    (score_a - lo_a) / (hi_a - lo_a) AS a, (score_b - lo_b) / (hi_b - lo_b) AS b
  FROM fx_scores CROSS JOIN (SELECT min(score_a) AS lo_a, max(score_a) AS hi_a, min(score_b) AS lo_b,
    max(score_b) AS hi_b FROM fx_scores) e) z""", "fx_scores")

    # Metrics
    put("precision_at_k", " UNION ALL ".join(
        f"SELECT {k} AS k, round(avg(CAST(is_leaked_market AS DOUBLE)), 9) AS precision FROM "
        f"(SELECT * FROM fx_scores ORDER BY score_a DESC, taker LIMIT {k}) z" for k in K_VALUES), "fx_scores")
    put("precision_rank_cut", """SELECT CAST(sum(is_leaked_market) AS BIGINT) AS hits,
  round(sum(is_leaked_market) / 100.0::DOUBLE, 9) AS precision
FROM (SELECT *, rank() OVER (ORDER BY score_a DESC) AS r FROM fx_scores) z WHERE r <= 100""", "fx_scores")
    put("roc_auc", """SELECT 'a' AS score, round(sum((n - pos) * (cum_pos - pos / 2.0::DOUBLE))
  / max(total_pos * (total_n - total_pos)), 9) AS roc_auc FROM curve_a
UNION ALL SELECT 'b', round(sum((n - pos) * (cum_pos - pos / 2.0::DOUBLE))
  / max(total_pos * (total_n - total_pos)), 9) FROM curve_b""", "curve_a", "curve_b")
    put("pr_auc", """SELECT 'a' AS score, round(sum(pos * cum_pos / CAST(cum_n AS DOUBLE)) / max(total_pos), 9) AS pr_auc
FROM curve_a UNION ALL SELECT 'b', round(sum(pos * cum_pos / CAST(cum_n AS DOUBLE)) / max(total_pos), 9) FROM curve_b""",
        "curve_a", "curve_b")
    put("recall_at_fpr", f"""SELECT round(tpr, 9) AS recall_at_fpr FROM (
  SELECT {FPR} AS fpr, {TPR} AS tpr FROM curve_a WHERE {ON_ROC} UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE) z
ORDER BY abs(fpr - 0.01::DOUBLE), fpr, tpr LIMIT 1""", "curve_a")
    put("roc_points", f"""SELECT score AS threshold, round({FPR}, 9) AS fpr, round({TPR}, 9) AS tpr FROM curve_a
WHERE {ON_ROC} UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE""", "curve_a")
    put("roc_points_models", f"""SELECT model, score AS threshold, round({FPR}, 9) AS fpr, round({TPR}, 9) AS tpr
FROM curve_models WHERE {ON_ROC} UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE
FROM curve_models""", "curve_models")
    put("pr_points", f"""SELECT score AS threshold, round(cum_pos / CAST(cum_n AS DOUBLE), 9) AS precision,
  round({TPR}, 9) AS recall FROM curve_a UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""", "curve_a")
    put("pr_points_models", f"""SELECT model, score AS threshold, round(cum_pos / CAST(cum_n AS DOUBLE), 9) AS precision,
  round({TPR}, 9) AS recall FROM curve_models UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE
FROM curve_models""", "curve_models")
    put("skipped_files", "SELECT DISTINCT event_type FROM events")
    put("damaged_files", """SELECT event_type, n AS rows_promised, CASE WHEN bad THEN 0 ELSE n END AS rows_read,
  CASE WHEN bad THEN n ELSE 0 END AS rows_lost
FROM (SELECT event_type, count(*) AS n, event_type IN ('purchase', 'click') AS bad FROM events GROUP BY 1) z""")
    put("evaluate_model", f"SELECT {_metric_columns()} FROM metrics_models WHERE model = 'a'", "metrics_models")
    put("model_summary", f"SELECT {_metric_columns()} FROM metrics_models", "metrics_models")
    put("loco_eval", f""", ctrl AS ({SAMPLE.format(src='fx_scores')}),
cases AS (SELECT DISTINCT case_id FROM fx_scores WHERE is_leaked_market = 1 AND case_id <> ''),
universe AS (
  SELECT case_id AS c, taker, is_leaked_market, score_a FROM fx_scores WHERE is_leaked_market = 1 AND case_id <> ''
  UNION ALL SELECT k.case_id, taker, is_leaked_market, score_a FROM ctrl CROSS JOIN cases k),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score_a DESC, taker) AS rn FROM universe)
SELECT c AS case_id, round(avg(CAST(is_leaked_market AS DOUBLE)) FILTER (WHERE rn <= 20), 9) AS precision_at_20,
  round((SELECT avg(CASE WHEN p.score_a > n.score_a THEN 1.0::DOUBLE WHEN p.score_a = n.score_a THEN 0.5 ELSE 0.0 END)
   FROM universe p JOIN universe n ON p.c = n.c WHERE p.c = placed.c AND p.is_leaked_market = 1 AND n.is_leaked_market = 0), 9)
  AS roc_auc
FROM placed GROUP BY c""", "fx_scores")

    put("loco_hook", """, cases AS (SELECT DISTINCT case_id FROM fx_scores WHERE is_leaked_market = 1 AND case_id <> ''),
universe AS (
  SELECT case_id AS c, taker, is_leaked_market, score_a FROM fx_scores WHERE is_leaked_market = 1 AND case_id <> ''
  UNION ALL SELECT k.case_id, taker, is_leaked_market, score_a FROM fx_scores CROSS JOIN cases k WHERE is_leaked_market = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score_a DESC, taker) AS rn FROM universe),
per_case AS (
  SELECT c AS case_id, avg(CAST(is_leaked_market AS DOUBLE)) FILTER (WHERE rn <= 20) AS p,
    (SELECT avg(CASE WHEN p.score_a > n.score_a THEN 1.0::DOUBLE WHEN p.score_a = n.score_a THEN 0.5 ELSE 0.0 END)
     FROM universe p JOIN universe n ON p.c = n.c WHERE p.c = placed.c AND p.is_leaked_market = 1 AND n.is_leaked_market = 0) AS a
  FROM placed GROUP BY c),
both_rows AS (SELECT * FROM per_case UNION ALL SELECT '(mean)', avg(p), avg(a) FROM per_case)
SELECT turns, case_id, round(p, 9) AS precision_at_20, round(a, 9) AS roc_auc
FROM both_rows CROSS JOIN (VALUES ('once'), ('each')) t(turns)""", "fx_scores")

    # Fixed models, and what any fit must satisfy
    x = ("score_a", "score_b")
    norm = "(2 * (ln(15) + 0.5772156649015329) - 2 * 15.0::DOUBLE / 16)"
    put("iforest_score_fixed", f"SELECT taker, round(pow(2.0::DOUBLE, -({_path(0, x, 0)} + {_path(0, x, 1)}) / (2 * {norm})), 9) "
        "AS if_raw FROM fx_scores", "fx_scores")
    put("iforest_threshold", "SELECT round(quantile_cont(score_a, 0.99), 9) AS threshold FROM fx_scores WHERE is_leaked_market = 0",
        "fx_scores")
    put("autoencoder_error_fixed", f"SELECT taker, round(((x0 - h0) * (x0 - h0) + (x1 - h1) * (x1 - h1)) / 2, 9) AS anomaly_score_ae "
        f"FROM ({_layers_sql()}) z", "fx_scores")
    put("iforest_shape", """SELECT CAST(300 AS BIGINT) AS trees, least(n, 256) AS least_rows, least(n, 256) AS most_rows,
  CAST(0 AS BIGINT) AS broken FROM (SELECT count(*) AS n FROM profiles WHERE is_leaked_market = 0) z""", "profiles")
    put("saved_models", """SELECT unnest(['forest', 'autoencoder', 'linear']) AS model, count(*) AS wallets, CAST(0 AS BIGINT) AS differing
FROM raw_profiles""", "raw_profiles")
    put("linear_error_fixed", """SELECT taker, round((power(x0 - 0.6::DOUBLE * p, 2) + power(x1 - 0.8::DOUBLE * p, 2)) / 2, 9) AS anomaly_score_linear
FROM (SELECT taker, score_a / 10 AS x0, score_b / 10 AS x1, 0.6::DOUBLE * score_a / 10 + 0.8::DOUBLE * score_b / 10 AS p FROM fx_scores) z""",
        "fx_scores")
    squares = " + ".join(f"avg(power(({f}) , 2))" for f in MODEL_FEATURES)
    put("linear_directions", f"""SELECT 'trace' AS measure, round({squares}, 6) AS value FROM scaled WHERE is_leaked_market = 0
UNION ALL SELECT unnest(['not orthogonal', 'left over']), 0.0::DOUBLE""", "scaled")
    put("loco_forests", """SELECT DISTINCT case_id, true AS has_precision, true AS has_auc FROM raw_profiles
WHERE is_leaked_market = 1 AND case_id <> ''""", "raw_profiles")
    put("autoencoder_step_fixed", _step_sql(), "fx_scores")
    put("autoencoder_history_fixed", f"""SELECT CAST(unnest([1, 2, 3]) AS INT) AS epoch, round(avg(e), 9) AS val_loss, 0.0::DOUBLE AS learning_rate
FROM (SELECT l.taker, ((x0 - h0) * (x0 - h0) + (x1 - h1) * (x1 - h1)) / 2 AS e
  FROM ({_layers_sql()}) l JOIN fx_scores s ON l.taker = s.taker WHERE is_leaked_market = 0) z WHERE {HELD_BACK}""", "fx_scores")
    put("autoencoder_shape", "SELECT CAST(6618 AS BIGINT) AS weights, CAST(6617 AS INTEGER) AS last, CAST(0 AS BIGINT) AS undefined "
        "FROM (SELECT count(*) AS n FROM events) z")

    # Streaming
    for key in ("stream_ingest", "compacted_markets"):
        put(key, """SELECT trade_id, condition_id, taker, usdc_amount, block_timestamp,
  substr(lower(condition_id), 1, 10) AS market_id_prefix FROM fx_trades t
WHERE EXISTS (SELECT 1 FROM fx_inventory i WHERE lower(t.condition_id) LIKE lower(i.market_id_prefix) || '%')""",
            "fx_trades", "fx_inventory")
    hours = """SELECT substr(lower(condition_id), 1, 10) AS market_id_prefix, block_timestamp // 3600 * 3600 AS window_start,
  block_timestamp // 3600 * 3600 + 3600 AS window_end, count(*) AS trades,
  round(sum(coalesce(usdc_amount, 0)), 6) AS volume, max(coalesce(usdc_amount, 0)) AS largest FROM {} GROUP BY 1, 2, 3"""
    put("market_volume", hours.format("fx_trades"), "fx_trades")
    # The second batch meets the watermark of the first; the last watermark closes the hours that come out.
    put("stream_market_volume", f""", arrivals AS (
  SELECT *, trade_date < DATE '2024-01-20' AND trade_id % 7 <> 0 AS early FROM fx_trades),
kept AS (SELECT * FROM arrivals WHERE early
  OR block_timestamp // 3600 * 3600 + 3600 > (SELECT max(block_timestamp) - 3600 FROM arrivals WHERE early))
SELECT * FROM ({hours.format("kept")}) z WHERE window_end <= (SELECT max(block_timestamp) - 3600 FROM arrivals)""",
        "fx_trades")
    return sql
