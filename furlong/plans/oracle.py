"""The same results in plain SQL, written against the raw tables.

Every statement runs over whole tables in DuckDB. The common part of a
statement is picked from ``PARTS``; each part only uses earlier ones.
"""

from __future__ import annotations

import math

def _ranked(c: str) -> str:
    """The first 33 binary digits of a column."""
    spread = f"{c} * CAST(1048577 AS DOUBLE)"
    return f"({spread} - ({spread} - {c}))"


PARTS = {
    "run": """
        SELECT l_orderkey AS race_id, l_extendedprice AS price, l_quantity AS qty,
               lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS hrNo,
               lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS jkNo,
               l_linenumber AS gate, l_discount AS discount, l_tax AS tax
        FROM lineitem""",
    "ent": """
        SELECT *, 0.8E0 * sum(price) OVER r / price AS odds, count(*) OVER r AS runners,
               CASE WHEN row_number() OVER (PARTITION BY race_id ORDER BY qty DESC, price) = 1
                    THEN 1 ELSE 0 END AS win
        FROM run WINDOW r AS (PARTITION BY race_id)""",
    "mkt": """
        SELECT *, (1 / odds) / sum(1 / odds) OVER (PARTITION BY race_id) AS p FROM ent""",
    "dat": """
        SELECT ent.*, CAST(o_orderdate AS DATE) AS race_date
        FROM ent JOIN orders ON race_id = o_orderkey""",
    "fin": """
        SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY qty DESC, price) AS finish
        FROM dat""",
    "days": """
        SELECT hrNo, race_date, min(finish) AS result, count(*) AS starts, sum(qty) AS qty_sum
        FROM fin GROUP BY hrNo, race_date""",
    "form": """
        SELECT hrNo, race_date,
               lag(result) OVER h AS prev_result,
               date_diff('day', lag(race_date) OVER h, race_date) AS rest_days,
               row_number() OVER h - 1 AS prior_starts,
               coalesce(sum(qty_sum) OVER b / sum(starts) OVER b, 25.5E0) AS prior_qty
        FROM days
        WINDOW h AS (PARTITION BY hrNo ORDER BY race_date),
               b AS (PARTITION BY hrNo ORDER BY race_date
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "mod": """
        SELECT dat.*, prior_qty, prev_result, rest_days, prior_starts,
               (1 / odds) / sum(1 / odds) OVER r AS market,
               prior_qty / sum(prior_qty) OVER r AS model
        FROM dat JOIN form USING (hrNo, race_date)
        WINDOW r AS (PARTITION BY race_id)""",
    "spl": """
        SELECT race_date, n,
               CASE WHEN upto <= 0.6E0 * total THEN 'train'
                    WHEN upto <= 0.8E0 * total THEN 'valid' ELSE 'test' END AS split
        FROM (SELECT race_date, n, sum(n) OVER (ORDER BY race_date) AS upto, sum(n) OVER () AS total
              FROM (SELECT race_date, count(*) AS n FROM dat GROUP BY race_date))""",
    "gap": """
        SELECT dat.* REPLACE (CASE WHEN gate <> 3 THEN tax END AS tax), split
        FROM dat JOIN spl USING (race_date)""",
    "two": f"SELECT *, {_ranked('model')} AS score FROM mod",
    "cho": """
        SELECT * FROM two WHERE odds BETWEEN 10 AND 50
        QUALIFY row_number() OVER (ORDER BY score DESC, race_id, price)
                <= ceil(round(0.1E0 * count(*) OVER (), 9))""",
    "cal": """
        SELECT race_id, win, market,
               b / sum(b) OVER (PARTITION BY race_id) AS p
        FROM (SELECT race_id, win, market, pow(0.7E0 * market + 0.3E0 * model, 1 / 1.5E0) AS b
              FROM mod)""",
    "gain": """
        SELECT race_id, max(CASE WHEN win = 1 THEN ln(p) - ln(market) END) AS gain
        FROM cal GROUP BY race_id HAVING count(*) >= 2 AND sum(win) = 1""",
    "ups": """
        SELECT *, CASE WHEN win = 1 AND odds >= 10 THEN 1 ELSE 0 END AS upset
        FROM ent""",
    "ven": """
        SELECT run.*, CAST(o_orderdate AS DATE) AS race_date, r_name AS venue
        FROM run JOIN orders ON race_id = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}

# what each part needs before it
NEEDS = {
    "run": (), "ent": ("run",), "mkt": ("ent",), "dat": ("ent",), "fin": ("dat",),
    "days": ("fin",), "form": ("days",), "mod": ("form",), "spl": ("dat",), "gap": ("spl",),
    "two": ("mod",), "cho": ("two",), "cal": ("mod",), "gain": ("cal",), "ups": ("ent",),
    "ven": ("run",),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    wanted: set[str] = set()
    queue = list(names)
    while queue:
        n = queue.pop()
        if n not in wanted:
            wanted.add(n)
            queue += NEEDS[n]
    return [n for n in PARTS if n in wanted]


def _with(names: str, body: str, extra: str = "") -> str:
    ctes = ", ".join(f"{n} AS ({PARTS[n]})" for n in _closure(tuple(names.split())))
    return f"WITH {ctes}{', ' + extra if extra else ''} {body}"


def _day(c: str = "race_date") -> str:
    return f"CAST({c} AS VARCHAR) AS {c}"


def _auc(score: str, y: str, source: str) -> str:
    return f"""(SELECT sum(pos * (below + neg / 2.0E0)) / (sum(pos) * sum(neg)) FROM (
        SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg AS below FROM (
            SELECT {score} AS s, CAST(sum({y}) AS DOUBLE) AS pos,
                   CAST(count(*) - sum({y}) AS DOUBLE) AS neg
            FROM {source} GROUP BY 1)))"""


def _loss(p: str, source: str) -> str:
    return f"""(SELECT avg(l) FROM (
        SELECT max(CASE WHEN win = 1 THEN -ln(greatest({p}, 1E-15)) END) AS l
        FROM {source} GROUP BY race_id HAVING count(*) >= 2 AND sum(win) = 1))"""


def _top1(p: str, source: str) -> str:
    return f"""(SELECT avg(win) FROM (
        SELECT win FROM {source} WHERE runners >= 2
        QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY {p} DESC, price) = 1))"""


def _poisson_counts(u: str) -> str:
    """Weight of a 32-bit uniform draw: how many values of the Poisson(1)
    distribution function it reaches."""
    cum, mass, k, cases = 0.0, math.exp(-1.0), 0, []
    while round((cum + mass) * 2**32) < 2**32:
        cum += mass
        cases.append(f"CASE WHEN {u} >= {round(cum * 2**32)} THEN 1 ELSE 0 END")
        k += 1
        mass /= k
    return " + ".join(cases)


def _replicates(unit: str, sums: str, count: int) -> str:
    """CTEs ``drawn`` and ``rep``: weighted sums per replicate."""
    draw = "('0x' || substr(md5(race_id || ':' || (b // 4)), 1 + 8 * (b % 4)::BIGINT, 8))::BIGINT"
    weighted = ", ".join(f"sum(w * {c}) AS {c}" for c in sums.split())
    return f"""drawn AS (SELECT *, {_poisson_counts('u')} AS w FROM (
            SELECT {unit}.*, b, {draw} AS u FROM {unit}, range({count}) AS g(b))),
        rep AS (SELECT b, {weighted} FROM drawn GROUP BY b)"""


def _interval(stat: str) -> str:
    return f"""(SELECT round(quantile_cont({stat}, 0.025), 6) FROM rep) AS lo,
        (SELECT round(quantile_cont({stat}, 0.975), 6) FROM rep) AS hi"""


def _vif(a: str, b: str, c: str) -> str:
    """VIF of the column whose correlations to the others are ``a`` and ``b``."""
    return f"1 / (1 - ({a}*{a} + {b}*{b} - 2*{a}*{b}*{c}) / (1 - {c}*{c}))"


_GRID = """grid AS (SELECT w, t FROM (VALUES (0.0E0), (0.1E0), (0.3E0)) a(w),
                (VALUES (0.8E0), (1.0E0), (1.5E0)) b(t))"""


def _grid_loss(source: str) -> str:
    return f"""SELECT w, t, avg(l) AS log_loss FROM (
        SELECT w, t, race_id, -ln(max(CASE WHEN win = 1 THEN b END) / sum(b)) AS l FROM (
            SELECT w, t, race_id, win, pow((1 - w) * market + w * model, 1 / t) AS b
            FROM {source}, grid)
        GROUP BY w, t, race_id HAVING count(*) >= 2 AND sum(win) = 1) GROUP BY w, t"""


def _numeric_pairs() -> str:
    cols = ("price", "qty", "discount", "tax")
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM run"
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    )


def _corr_rows(cols: tuple[str, ...], y: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, {y}) AS score FROM {source}" for c in cols
    )


_NET = """n AS (SELECT price, price * (1 - discount) AS net, qty FROM run),
    r AS (SELECT corr(price, net) pn, corr(price, qty) pq, corr(net, qty) nq FROM n),
    v AS (SELECT 'price' AS feature, {0} AS vif FROM r UNION ALL
          SELECT 'net', {1} FROM r UNION ALL SELECT 'qty', {2} FROM r)""".format(
    _vif("pn", "pq", "nq"), _vif("pn", "nq", "pq"), _vif("pq", "nq", "pn")
)


def _effect(cols: tuple[str, ...]) -> str:
    parts = []
    for c in cols:
        edges = ", ".join(f"quantile_cont({c}, {i / 5})" for i in range(1, 5))
        names = ", ".join(f"e{i}" for i in range(1, 5))
        hits = f"""list_count(list_filter(list_distinct([{names}]), lambda e: e <= {c}))"""
        parts.append(
            f"SELECT '{c}' AS feature, {hits} AS bin, upset FROM ups, "
            f"(SELECT {edges} FROM ups) q({names})"
        )
    return " UNION ALL ".join(parts)


_CLIP = "greatest(least({c}, (SELECT quantile_cont({c}, 0.99) FROM gap WHERE split = 'train')), " \
    "(SELECT quantile_cont({c}, 0.01) FROM gap WHERE split = 'train'))"
_TAX = "coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM gap WHERE split = 'train'))"
_V1 = f"""imp AS (SELECT * REPLACE ({_TAX} AS tax), CASE WHEN tax IS NULL THEN 1 ELSE 0 END AS tax_missing FROM gap),
    v1 AS (SELECT race_id, price, split, tax_missing,
        greatest(least(tax, hi_t), lo_t) AS tax, greatest(least(qty, hi_q), lo_q) AS qty
        FROM imp, (SELECT quantile_cont(tax, 0.01) lo_t, quantile_cont(tax, 0.99) hi_t,
                          quantile_cont(qty, 0.01) lo_q, quantile_cont(qty, 0.99) hi_q
                   FROM gap WHERE split = 'train'))"""

ORACLE = {
    "market_prob": _with("mkt", "SELECT race_id, price, round(p, 6) AS p FROM mkt"),
    "overround": _with(
        "ent", "SELECT race_id, round(sum(1 / odds), 6) AS overround FROM ent GROUP BY race_id"
    ),
    "payout_rate": _with(
        "ent",
        """SELECT round(avg(1 / o), 6) AS payout_rate, round(avg(o), 6) AS mean_overround,
           count(*) AS races FROM (SELECT sum(1 / odds) AS o FROM ent GROUP BY race_id)""",
    ),
    "race_log_loss": _with(
        "mkt",
        """SELECT round(avg(l), 6) AS log_loss, count(l) AS races, count(*) - count(l) AS excluded
           FROM (SELECT CASE WHEN count(*) >= 2 AND sum(win) = 1
                        THEN max(CASE WHEN win = 1 THEN -ln(p) END) END AS l
                 FROM mkt GROUP BY race_id)""",
    ),
    "top1_rate": _with(
        "mkt",
        f"""SELECT round({_top1('p', 'mkt')}, 6) AS top1_rate,
            (SELECT count(DISTINCT race_id) FROM mkt WHERE runners >= 2) AS races""",
    ),
    "race_rank": _with(
        "mkt",
        """SELECT race_id, price,
           row_number() OVER (PARTITION BY race_id ORDER BY p DESC, price) AS rk FROM mkt""",
    ),
    "race_favourites": _with(
        "mkt",
        """SELECT race_id, price, round(p, 6) AS p, CAST(win AS BIGINT) AS win FROM mkt
           QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY p DESC, price) = 1""",
    ),
    "roc_auc": _with(
        "mkt",
        f"""SELECT round({_auc('p', 'win', 'e')}, 6) AS auc,
            CAST(sum(win) AS BIGINT) AS positives, CAST(count(*) - sum(win) AS BIGINT) AS negatives
            FROM e""",
        "e AS (SELECT * FROM mkt)",
    ),
    "base_rate": _with(
        "ent", "SELECT round(avg(win), 6) AS base_rate, count(*) AS entries FROM ent"
    ),
    "lift_top10": _with(
        "two",
        """SELECT round(h / a, 6) AS lift, round(h, 6) AS top_rate, round(a, 6) AS base_rate, k FROM (
             SELECT avg(CASE WHEN rn <= k THEN win END) AS h, avg(win) AS a, max(k) AS k FROM (
               SELECT win, row_number() OVER (ORDER BY score DESC, race_id, price) AS rn,
                      CAST(ceil(round(0.1E0 * count(*) OVER (), 9)) AS BIGINT) AS k FROM two))""",
    ),
    "top_fraction": _with(
        "mkt",
        f"""SELECT race_id, price FROM mkt
           QUALIFY row_number() OVER (ORDER BY {_ranked('p')} DESC, race_id, price)
                   <= ceil(round(0.1E0 * count(*) OVER (), 9))""",
    ),
    "previous_result": _with("form", f"SELECT hrNo, {_day()}, prev_result FROM form"),
    "rest_days": _with("form", f"SELECT hrNo, {_day()}, rest_days FROM form"),
    "prior_starts": _with("form", f"SELECT hrNo, {_day()}, prior_starts FROM form"),
    "entry_history": _with(
        "mod", "SELECT race_id, price, prev_result, rest_days, prior_starts FROM mod"
    ),
    "rolling_training": """
        SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
               RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING), 6) AS recent FROM events""",
    "recent_training_pit": """
        SELECT s.event_id, round(coalesce(sum(l.value), 0), 6) AS training, count(l.value) AS sessions
        FROM events s LEFT JOIN events l ON l.user_id = s.user_id AND l.event_type = 'click'
             AND l.ts < s.ts AND l.ts >= s.ts - INTERVAL 7 DAY
        WHERE s.event_type = 'purchase' GROUP BY s.event_id""",
    "time_split": _with("spl", f"SELECT split, {_day()}, n AS entries FROM spl"),
    "dataset_profile": _with(
        "dat",
        """SELECT count(*) AS entries, count(DISTINCT race_id) AS races, CAST(6 AS BIGINT) AS columns,
           CAST(min(race_date) AS VARCHAR) AS first_date, CAST(max(race_date) AS VARCHAR) AS last_date
           FROM dat""",
    ),
    "impute_median": _with(
        "gap",
        f"""SELECT race_id, price, round({_TAX}, 6) AS tax,
            CAST(CASE WHEN tax IS NULL THEN 1 ELSE 0 END AS BIGINT) AS tax_missing FROM gap""",
    ),
    "winsorize": _with(
        "gap",
        f"""SELECT race_id, price AS raw, round({_CLIP.format(c='price')}, 6) AS clipped_price,
            round({_CLIP.format(c='qty')}, 6) AS clipped_qty FROM gap""",
    ),
    "standardize": _with(
        "gap",
        """SELECT race_id, price, round((qty - mq) / sq, 6) AS z_qty,
           round((discount - md) / sd, 6) AS z_discount
           FROM gap, (SELECT avg(qty) mq, stddev_pop(qty) sq, avg(discount) md,
                             stddev_pop(discount) sd FROM gap WHERE split = 'train')""",
    ),
    "version_v1_base": _with(
        "gap",
        """SELECT race_id, price, split, round(tax, 6) AS tax, round(qty, 6) AS qty,
           CAST(tax_missing AS BIGINT) AS tax_missing FROM v1""",
        _V1,
    ),
    "version_v2_standard": _with(
        "gap",
        """SELECT race_id, price, split, round((tax - mt) / st, 6) AS tax,
           round((qty - mq) / sq, 6) AS qty
           FROM v1, (SELECT avg(tax) mt, stddev_pop(tax) st, avg(qty) mq, stddev_pop(qty) sq
                     FROM v1 WHERE split = 'train')""",
        _V1,
    ),
    "correlation_pairs": _with("run", _numeric_pairs()),
    "vif": _with("run", "SELECT feature, round(vif, 4) AS vif FROM v", _NET),
    "drop_collinear": _with(
        "run",
        """SELECT feature, round(mean, 4) AS mean FROM (
             SELECT 'price' AS feature, avg(price) AS mean FROM n UNION ALL
             SELECT 'net', avg(net) FROM n UNION ALL SELECT 'qty', avg(qty) FROM n)
           WHERE feature <> (SELECT arg_max(feature, vif) FROM v WHERE vif > 5)""",
        _NET,
    ),
    "venue_entries": _with(
        "ven", f"SELECT race_id, price, venue, {_day()} FROM ven WHERE venue = 'ASIA'"
    ),
    "union_venues": _with(
        "ven",
        """SELECT race_id, price, venue, tax, CAST(NULL AS DOUBLE) AS discount FROM ven
           WHERE venue = 'ASIA' UNION ALL
           SELECT race_id, price, venue, NULL, discount FROM ven WHERE venue = 'EUROPE'""",
    ),
    "period_entries": _with(
        "dat",
        f"""SELECT race_id, price, {_day()} FROM dat
            WHERE race_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""",
    ),
    "join_entity": _with(
        "run",
        """SELECT race_id, price, jkNo, s_name AS jockey FROM run
           LEFT JOIN supplier ON jkNo = lpad(CAST(s_suppkey AS VARCHAR), 6, '0')""",
    ),
    "leak_free_features": _with(
        "ent", "SELECT CAST(gate AS BIGINT) AS gate, discount, tax, runners FROM ent"
    ),
    "feature_subset": _with(
        "ent",
        f"""SELECT feature, round(score, 6) AS score FROM
            ({_corr_rows(('gate', 'discount', 'tax', 'runners'), 'win', 'e')})
            ORDER BY abs(score) DESC, feature LIMIT 2""",
        "e AS (SELECT * FROM ent)",
    ),
    "temperature": _with(
        "mkt",
        """SELECT race_id, price,
           round(pow(p, 0.5E0) / sum(pow(p, 0.5E0)) OVER (PARTITION BY race_id), 6) AS p_t FROM mkt""",
    ),
    "blend": _with(
        "mod",
        """SELECT race_id, price, round(b / sum(b) OVER (PARTITION BY race_id), 6) AS p_blend
           FROM (SELECT *, 0.9E0 * market + 0.1E0 * model AS b FROM mod)""",
    ),
    "race_normalize": _with("mod", "SELECT race_id, price, round(model, 9) AS model FROM mod"),
    "race_softmax": _with(
        "run",
        """SELECT race_id, price, round(e / sum(e) OVER (PARTITION BY race_id), 6) AS p FROM (
             SELECT race_id, price, exp(qty / 10 - max(qty / 10) OVER (PARTITION BY race_id)) AS e
             FROM run)""",
    ),
    "calibration_grid": _with(
        "mod", f"SELECT w, t, round(log_loss, 6) AS log_loss FROM ({_grid_loss('mod')})", _GRID
    ),
    "parameter_grid": _with(
        "mod",
        """SELECT w, t, count(*) AS entries,
           round(avg(pow((1 - w) * market + w * model, 1 / t)), 6) AS mean
           FROM mod, grid GROUP BY w, t""",
        _GRID,
    ),
    "calibrated_holdout": _with(
        "mod spl",
        """SELECT w, t, round(best.log_loss, 6) AS valid_loss, round(tested.log_loss, 6) AS test_loss
           FROM best JOIN tested USING (w, t)""",
        f"""{_GRID}, m AS (SELECT mod.*, split FROM mod JOIN spl USING (race_date)),
            va AS (SELECT * FROM m WHERE split = 'valid'), te AS (SELECT * FROM m WHERE split = 'test'),
            best AS ({_grid_loss('va')} ORDER BY log_loss, w, t LIMIT 1),
            tested AS ({_grid_loss('te')})""",
    ),
    "paired_gain": _with(
        "gain", "SELECT round(avg(gain), 6) AS gain, count(*) AS races FROM gain"
    ),
    "paired_join": _with("gain", "SELECT race_id, round(gain, 6) AS gain FROM gain"),
    "bootstrap_ci": _with(
        "gain",
        f"SELECT round(avg(gain), 6) AS value, {_interval('gain / one')} FROM u",
        "u AS (SELECT race_id, gain, 1.0E0 AS one FROM gain), " + _replicates("u", "gain one", 1000),
    ),
    "prob_profit": _with(
        "cho",
        """SELECT round(avg(CASE WHEN back / stake > 1 THEN 1.0E0 ELSE 0 END), 6) AS profitable,
           round(avg(back / stake - 1), 6) AS mean_roi, count(*) AS replicates FROM rep WHERE stake > 0""",
        """u AS (SELECT race_id, sum(win * odds) AS back, count(*) AS stake FROM cho GROUP BY race_id), """
        + _replicates("u", "back stake", 1000),
    ),
    "roi_ci": _with(
        "cho",
        f"""SELECT round(sum(back) / sum(stake) - 1, 6) AS value,
            {_interval('back / nullif(stake, 0) - 1')} FROM u""",
        """u AS (SELECT race_id, sum(win * odds) AS back, count(*) AS stake FROM cho GROUP BY race_id), """
        + _replicates("u", "back stake", 1000),
    ),
    "lift_ci": _with(
        "two",
        f"""SELECT round((sum(top_hits) / sum(top)) / (sum(hits) / sum(n)), 6) AS value,
            {_interval('(top_hits / nullif(top, 0)) / (nullif(hits, 0) / n)')} FROM u""",
        """f AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY score DESC, race_id, price)
                 <= ceil(round(0.1E0 * count(*) OVER (), 9)) THEN 1 ELSE 0 END AS chosen FROM two),
           u AS (SELECT race_id, sum(chosen * win) AS top_hits, sum(chosen) AS top, sum(win) AS hits,
                 count(*) AS n FROM f GROUP BY race_id), """
        + _replicates("u", "top_hits top hits n", 1000),
    ),
    "odds_band_roi": _with(
        "ent",
        """SELECT count(*) AS bets, round(sum(win * odds) / count(*) - 1, 6) AS roi
           FROM ent WHERE odds BETWEEN 10 AND 50""",
    ),
    "roi_by_band": _with(
        "ent",
        """SELECT CAST(coalesce(band, -1) AS BIGINT) AS band, count(*) AS bets,
           CAST(sum(win) AS BIGINT) AS hits, round(sum(win * odds) / count(*) - 1, 6) AS roi
           FROM (SELECT *, CASE WHEN odds < 2 THEN 0 WHEN odds < 5 THEN 1 WHEN odds < 10 THEN 2
                 WHEN odds < 20 THEN 3 WHEN odds < 50 THEN 4 ELSE 5 END AS band FROM ent)
           GROUP BY ROLLUP (band)""",
    ),
    "select_bets": _with(
        "cho", "SELECT race_id, price, round(odds, 6) AS odds, CAST(win AS BIGINT) AS win FROM cho"
    ),
    "expected_return": _with(
        "mod", "SELECT race_id, price, round(model * odds - 1, 6) AS expected_return FROM mod"
    ),
    "positive_return": _with(
        "mod", "SELECT race_id, price, round(odds, 6) AS odds FROM mod WHERE model * odds - 1 > 0"
    ),
    "bet_gate": _with(
        "mod",
        """SELECT probability, count(*) FILTER (v > 0) AS candidates, round(max(v), 6) AS best,
           CASE WHEN count(*) FILTER (v > 0) = 0 THEN 'no_bet' ELSE 'bet' END AS policy
           FROM (SELECT 'market' AS probability, market * odds - 1 AS v FROM mod UNION ALL
                 SELECT 'model', model * odds - 1 FROM mod) GROUP BY probability""",
    ),
    "compare_strategies": _with(
        "cho",
        " UNION ALL ".join(
            f"SELECT '{name}' AS strategy, count(*) AS bets, "
            f"round(sum(win * odds) / count(*) - 1, 6) AS roi FROM {source} WHERE {rule}"
            for name, source, rule in (
                ("all", "mod", "true"),
                ("odds_band", "mod", "odds BETWEEN 10 AND 50"),
                ("favourites", "mod", "odds < 3"),
                ("long_shots", "mod", "odds > 50"),
                ("model_above_market", "mod", "model > market"),
                ("small_fields", "mod", "runners <= 4"),
                ("band_then_top", "cho", "true"),
            )
        ),
    ),
    "allocate": _with(
        "two",
        """SELECT race_id, price, round(CASE WHEN odds > 1
           THEN least(greatest((model * odds - 1) / (odds - 1), 0), 0.05E0) ELSE 0 END, 6) AS stake
           FROM two""",
    ),
    "upset_label": _with("ups", "SELECT race_id, price, CAST(upset AS BIGINT) AS upset FROM ups"),
    "upset_type_profile": _with(
        "two",
        """SELECT type, count(*) AS n, round(avg(odds), 6) AS mean_odds,
           round(avg(rest_days), 6) AS mean_rest_days, round(avg(prior_starts), 6) AS mean_prior_starts,
           round(quantile_cont(odds, 0.5), 6) AS median_odds,
           round(quantile_cont(CAST(rest_days AS DOUBLE), 0.5), 6) AS median_rest_days,
           round(quantile_cont(CAST(prior_starts AS DOUBLE), 0.5), 6) AS median_prior_starts
           FROM (SELECT *, CASE WHEN prior_starts = 0 THEN 'debut'
                   WHEN prior_starts >= 10 AND rest_days >= 60 THEN 'veteran_return'
                   WHEN prior_starts BETWEEN 1 AND 9 THEN 'rookie' ELSE 'other' END AS type
                 FROM two WHERE win = 1 AND odds >= 10) GROUP BY type""",
    ),
    "feature_effect": _with(
        "ups",
        f"""SELECT feature, bin, count(*) AS n, round(avg(upset), 6) AS rate
            FROM ({_effect(('price', 'discount', 'tax'))}) GROUP BY feature, bin""",
    ),
    "feature_correlation": _with(
        "ups",
        f"""SELECT feature, round(score, 6) AS score FROM
            ({_corr_rows(('gate', 'discount', 'tax', 'runners', 'price'), 'upset', 'ups')})""",
    ),
    "market_gap": _with(
        "two",
        f"""SELECT round(am, 6) AS auc_model, round(ak, 6) AS auc_market, round(am - ak, 6) AS auc_gap,
            round(lm, 6) AS log_loss_model, round(lk, 6) AS log_loss_market,
            round(lm - lk, 6) AS log_loss_gap, round(tm, 6) AS top1_model, round(tk, 6) AS top1_market,
            round(tm - tk, 6) AS top1_gap
            FROM (SELECT {_auc('model', 'win', 'two')} AS am, {_auc('market', 'win', 'two')} AS ak,
                  {_loss('model', 'two')} AS lm, {_loss('market', 'two')} AS lk,
                  {_top1('model', 'two')} AS tm, {_top1('market', 'two')} AS tk)""",
    ),
    "entry_gap": _with("mod", "SELECT race_id, price, round(model - market, 6) AS gap FROM mod"),
    "align": _with(
        "mod",
        """SELECT race_id, price, round(model, 9) AS model, round(market, 6) AS market,
           CAST(win AS BIGINT) AS win FROM mod""",
    ),
    "leaderboard": _with(
        "two",
        " UNION ALL ".join(
            f"""SELECT '{name}' AS model, round({_auc(p, 'win', 'm')}, 6) AS auc,
                round({_loss(p, 'm')}, 6) AS log_loss, round({_top1(p, 'm')}, 6) AS top1_rate"""
            for name, p in (("market", "market"), ("model", "model"), ("blend", "mixed"))
        ),
        """m AS (SELECT *, (0.9E0 * market + 0.1E0 * model)
                 / sum(0.9E0 * market + 0.1E0 * model) OVER (PARTITION BY race_id) AS mixed FROM two)""",
    ),
    "kfold": _with(
        "run",
        """SELECT ('0x' || substr(md5(CAST(race_id AS VARCHAR)), 1, 8))::BIGINT % 5 AS fold,
           count(DISTINCT race_id) AS races, count(*) AS entries FROM run GROUP BY 1""",
    ),
}
