"""DuckDB SQL of the queries, built from shared common table expressions."""

from __future__ import annotations

OFFER = "retailer_id, store_id, retailer_product_id"
ROW = f"{OFFER}, date"

CTES = {
    "obs": """SELECT cast(event_id AS VARCHAR) AS observation_id, ts AS observed_at, event_type AS retailer_id, event_type || '_c' || (user_id % 3) AS store_id,
      'c' || (user_id % 3) AS city_id, event_type || ':' || p AS retailer_product_id, 'KZT' AS currency, value AS price, k >= 3 AS is_available, k BETWEEN 3 AND 17 AS is_promotion,
      'p' || p AS canonical_product_id, CASE WHEN p % 5 <> 4 THEN 'k' || (p % 5) END AS category_id, CASE WHEN k BETWEEN 3 AND 17 THEN value * 1.1 END AS regular_price,
      'g' AS unit, 1000.0 AS quantity, 1 AS pack_count, CASE WHEN p % 2 = 1 THEN ['b' || p, 'x' || event_type] ELSE ['b' || p] END AS barcodes,
      CASE WHEN p % 4 = 0 THEN 'manual' ELSE 'auto' END AS match_method, CASE WHEN p % 7 = 0 THEN 0.5 ELSE 0.95 END AS match_confidence, 'approved' AS match_status,
      TIMESTAMP '2023-12-22' AS link_valid_from, CASE WHEN p % 11 = 0 THEN TIMESTAMP '2024-01-20' END AS link_valid_to
      FROM (SELECT *, user_id // 3 AS p, cast(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
    "tied": f"SELECT *, count(*) OVER (PARTITION BY {OFFER}, observed_at) AS ties FROM obs WHERE observed_at < DATE '2024-01-31'",
    "lastday": f"""SELECT *, cast(observed_at AS DATE) AS event_date FROM tied
      QUALIFY row_number() OVER (PARTITION BY {OFFER}, cast(observed_at AS DATE) ORDER BY observed_at DESC, cast(observation_id AS BIGINT) DESC) = 1""",
    "spans": f"SELECT *, coalesce(lead(event_date) OVER (PARTITION BY {OFFER} ORDER BY event_date), DATE '2024-01-31') AS upto FROM lastday",
    "states": """SELECT s.*, cast(g.d AS DATE) AS date, date_diff('day', event_date, cast(g.d AS DATE)) AS age, event_date = cast(g.d AS DATE) AS today
      FROM spans s, LATERAL (SELECT unnest(generate_series(greatest(event_date, DATE '2024-01-02'), upto - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d) g""",
    "flagged": """SELECT *, retailer_id = 'error' AND day(date) % 11 = 0 AND date >= DATE '2024-01-03' AS problem,
      (match_method = 'manual' OR match_confidence >= 0.9) AS trusted, link_valid_from <= date AND (link_valid_to IS NULL OR link_valid_to > date) AS valid FROM states""",
    "panel0": """SELECT *, price > 0 AND is_available AND ties = 1 AND NOT problem AS state_ok, trusted AND valid AS match_ok,
      CASE WHEN problem THEN 'collection_problem' WHEN today THEN 'event_evidence' ELSE 'assumed_continuous_observation' END AS evidence FROM flagged""",
    "lagged": f"""SELECT *, lag(price) OVER w AS pprice, lag(date) OVER w AS pdate, lag(state_ok) OVER w AS pstate, lag(is_promotion) OVER w AS ppromo, lag(canonical_product_id) OVER w AS pcanon,
      lag(match_ok) OVER w AS pmatch, lag(age) OVER w AS page FROM panel0 WINDOW w AS (PARTITION BY {OFFER} ORDER BY date)""",
    "out0": "SELECT *, coalesce(state_ok AND pstate AND pdate = date - 1, false) AS outcome_ok FROM lagged",
    "out1": "SELECT *, CASE WHEN outcome_ok THEN ln(price / pprice) END AS r, is_promotion IS DISTINCT FROM ppromo AS promo_switch FROM out0",
    "panel": f"SELECT * FROM (SELECT *, lag(r) OVER (PARTITION BY {OFFER} ORDER BY date) AS pr FROM out1) WHERE date >= DATE '2024-01-03'",
    "base": """SELECT *, retailer_id AS family, CASE WHEN prior THEN ppromo ELSE false END AS lag_promotion, CASE WHEN prior THEN pr END AS lag_return, CASE WHEN prior THEN page END AS lag_age, CASE WHEN prior THEN pdate END AS lag_date
      FROM (SELECT *, coalesce(pmatch AND pdate = date - 1 AND pdate >= DATE '2024-01-03', false) AS prior FROM panel WHERE match_ok AND outcome_ok)""",
    "kept": "SELECT * FROM base WHERE pmatch AND canonical_product_id = pcanon",
    "targets": "SELECT * FROM kept WHERE lag_date = date - 1",
    "shocks": "SELECT * FROM kept WHERE abs(r) > 1e-10",
    "peers": """SELECT t.retailer_id, t.store_id, t.retailer_product_id, t.date, s.retailer_id AS source_retailer, s.date AS source_date, date_diff('day', s.date, t.date) AS lag_days, avg(s.r) AS mark
      FROM targets t JOIN shocks s ON s.canonical_product_id = t.canonical_product_id AND s.city_id = t.city_id AND s.family <> t.family AND s.unit = t.unit AND s.quantity = t.quantity AND s.pack_count = t.pack_count
       AND s.date BETWEEN t.date - 14 AND t.date - 1 WHERE t.quantity > 0 AND t.pack_count > 0 {extra} GROUP BY ALL""",
    "exposures": f"SELECT {ROW}, source_retailer, count(*) AS active_days, avg(mark) AS mean_mark, sum(exp(-lag_days)) AS decayed_count, avg(lag_days) AS mean_lag_days FROM peers WHERE lag_days <= 3 GROUP BY ALL",
    "prices": "SELECT date, canonical_product_id, city_id, family, unit, quantity, pack_count, min(price) AS low, avg(price) AS mean, count(*) AS offers FROM base WHERE price > 0 GROUP BY ALL",
    "rivals": """SELECT t.retailer_id, t.store_id, t.retailer_product_id, t.date, min(low) AS cheapest, sum(mean * offers) / sum(offers) AS average, count(*) AS families
      FROM targets t JOIN prices s ON s.date = t.date - 1 AND s.canonical_product_id = t.canonical_product_id AND s.city_id = t.city_id AND s.family <> t.family AND s.unit = t.unit AND s.quantity = t.quantity AND s.pack_count = t.pack_count GROUP BY ALL""",
    "history": f"""SELECT {ROW}, date_diff('day', max(CASE WHEN abs(r) > 1e-10 THEN date END) OVER (PARTITION BY {OFFER} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), date) AS since,
      {", ".join(f"avg(cast(abs(r) > 1e-10 AS DOUBLE)) OVER (PARTITION BY {OFFER} ORDER BY date RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS rate{n}" for n in (7, 30, 90))} FROM targets""",
    "groups": "SELECT DISTINCT date, retailer_id, family, city_id, category_id, canonical_product_id, unit, quantity, pack_count FROM shocks",
    "activity": "SELECT date, city_id, category_id, count(*) AS n FROM groups GROUP BY ALL",
    "product": """SELECT t.retailer_id, t.store_id, t.retailer_product_id, t.date,
      count(*) FILTER (WHERE s.city_id <> t.city_id AND s.retailer_id = t.retailer_id AND s.unit = t.unit AND s.quantity = t.quantity AND s.pack_count = t.pack_count) AS cross_city, count(*) FILTER (WHERE s.city_id = t.city_id AND s.category_id = t.category_id) AS same_product
      FROM targets t JOIN groups s ON s.canonical_product_id = t.canonical_product_id AND s.date BETWEEN t.date - 3 AND t.date - 1 GROUP BY ALL""",
    "rolling": "SELECT cast(a.date + cast(g.k AS INT) AS DATE) AS date, city_id, category_id, sum(n) AS n FROM activity a, range(1, 4) g(k) WHERE category_id IS NOT NULL GROUP BY ALL",
    "context": f"""SELECT {", ".join("t." + c for c in ROW.split(", "))}, coalesce(cross_city, 0) AS cross_city_count, greatest(coalesce(c.n, 0) - coalesce(same_product, 0), 0) AS category_count,
      CASE WHEN t.category_id IS NULL THEN 0 ELSE coalesce(a.n, 0) - coalesce(c.n, 0) END AS cross_category_count FROM targets t LEFT JOIN product USING ({ROW})
      LEFT JOIN rolling c ON c.date = t.date AND c.city_id = t.city_id AND c.category_id = t.category_id LEFT JOIN (SELECT date, city_id, sum(n) AS n FROM rolling GROUP BY ALL) a ON a.date = t.date AND a.city_id = t.city_id""",
    "features": f"""SELECT {", ".join("t." + c for c in ROW.split(", "))}, canonical_product_id, city_id, category_id, cast(abs(r) > 1e-10 AS INT) AS changed, r AS magnitude, lag_promotion, coalesce(lag_return, 0) AS lag_return, lag_age AS lag_state_age,
      cast(dayofweek(t.date) AS INT) AS day_of_week, coalesce(e.days, 0) AS peer_active_days, coalesce(e.mark, 0) AS peer_mark, coalesce(e.decay, 0) AS peer_decay, {", ".join(f"coalesce(w.n{n}, 0) AS peer_active_{n}d" for n in (1, 3, 7, 14))},
      coalesce(since, 3650) AS days_since_own_change, {", ".join(f"coalesce(rate{n}, 0) AS own_change_rate_{n}d" for n in (7, 30, 90))},
      CASE WHEN cheapest > 0 THEN ln(pprice / cheapest) ELSE 0 END AS cheapest_peer_log_gap, CASE WHEN average > 0 THEN ln(pprice / average) ELSE 0 END AS mean_peer_log_gap,
      CASE WHEN pprice <= cheapest THEN 1 ELSE 0 END AS was_cheapest, coalesce(families, 0) AS priced_peer_families, cross_city_count, category_count, cross_category_count
      FROM targets t LEFT JOIN (SELECT {ROW}, sum(active_days) AS days, avg(mean_mark) AS mark, sum(decayed_count) AS decay FROM exposures GROUP BY ALL) e USING ({ROW})
      LEFT JOIN (SELECT {ROW}, {", ".join(f"count(*) FILTER (WHERE lag_days <= {n}) AS n{n}" for n in (1, 3, 7, 14))} FROM peers GROUP BY ALL) w USING ({ROW})
      LEFT JOIN rivals USING ({ROW}) LEFT JOIN history USING ({ROW}) LEFT JOIN context USING ({ROW})""",
    "basket": f"""SELECT {OFFER}, price AS base_price, w / sum(w) OVER () AS weight FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY coalesce(canonical_product_id, concat_ws('|', {OFFER}))) AS w
      FROM panel WHERE state_ok AND date = DATE '2024-01-03')""",
    "index_days": f"""SELECT date, count(*) AS basket_quotes, coalesce(sum(weight) FILTER (WHERE state_ok), 0) AS weight_coverage, sum(weight * ln(price / base_price)) FILTER (WHERE state_ok) AS relative,
      count(*) FILTER (WHERE state_ok) AS eligible_quotes, coalesce(sum(weight) FILTER (WHERE state_ok AND is_promotion), 0) AS promotion_weight FROM panel JOIN basket USING ({OFFER}) GROUP BY date""",
    "response": f"""SELECT *, changed - avg(cast(changed AS DOUBLE)) OVER (PARTITION BY date, retailer_id, category_id) AS residual, cast(changed = 1 AND sign(r) = sign(peer_mark) AS INT) AS agrees FROM
      (SELECT l.*, t.category_id, t.r, cast(abs(t.r) > 1e-10 AS INT) AS changed FROM (SELECT {ROW}, lag_days, count(*) AS source_events, avg(mark) AS peer_mark FROM peers WHERE lag_days <= 14 GROUP BY ALL) l JOIN targets t USING ({ROW}))""",
    "pilot": f"""SELECT *, price - pprice AS price_change, coalesce(pprice > 0 AND price > 0 AND price <> pprice AND is_available AND pavail AND ties = 1 AND pties = 1, false) AS clean, canonical_product_id IS NOT NULL AND (match_method = 'manual' OR match_confidence >= 0.9) AS trusted
      FROM (SELECT *, lag(price) OVER w AS pprice, lag(is_available) OVER w AS pavail, lag(ties) OVER w AS pties, lag(observed_at) OVER w AS pat, lag(observation_id) OVER w IS NOT NULL AS has,
        lag(regular_price) OVER w AS pregular, lag(is_promotion) OVER w AS ppromo FROM (SELECT *, count(*) OVER (PARTITION BY {OFFER}, observed_at) AS ties FROM obs)
        WINDOW w AS (PARTITION BY {OFFER} ORDER BY observed_at, cast(observation_id AS BIGINT)))""",
}


def sql(query: str, extra: str = "", **replace: str) -> str:
    """``query`` after the expressions it needs, directly or through others."""
    import re

    bodies = {k: v.replace("{extra}", extra) for k, v in CTES.items()} | replace
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in bodies:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                need(bodies[name])

    need(query)
    order = [n for n in bodies if n in needed]
    return "WITH " + ",\n".join(f"{n} AS ({bodies[n]})" for n in order) + "\n" + query
