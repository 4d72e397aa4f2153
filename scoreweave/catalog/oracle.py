"""Expected results of the named queries as plain SQL over the same tables.

The SQL is written independently of the Spark code: sorting windows, unions and
correlated arithmetic where the library uses bucketed or pre-aggregated plans.
"""

from __future__ import annotations

from .. import fixtures
from ..functions.columns import RAW_COLUMNS
from ..functions.rules import AMOUNTS, FEATURES, RATIOS, SCORES
from ..models.scorecard import ScoreScale
from ..operators.explain import REASON_CODES, group_members
from . import frozen

SCALE = ScoreScale()
SEED = 42


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _masked() -> str:
    columns = ["sk_id_curr", "target"]
    for c in AMOUNTS:
        columns += [
            f"CASE WHEN {c} < 0 THEN NULL ELSE {c} END AS {c}",
            f"{_flag(f'{c} IS NULL')} AS {c}_missing",
            f"{_flag(f'{c} < 0')} AS {c}_invalid",
        ]
    columns += [
        f"{_flag('days_birth IS NULL')} AS days_birth_missing",
        f"{_flag('days_birth >= 0')} AS days_birth_invalid",
        "CASE WHEN days_birth >= 0 THEN NULL ELSE (0e0 - days_birth) / 365.25e0 END AS age_years",
        f"{_flag('days_employed IS NULL')} AS days_employed_missing",
        f"{_flag('days_employed = 365243')} AS days_employed_sentinel",
        f"{_flag('days_employed > 0 AND days_employed <> 365243')} AS days_employed_invalid",
        "CASE WHEN days_employed > 0 THEN NULL ELSE (0e0 - days_employed) / 365.25e0 END AS employed_years",
    ]
    for c in SCORES:
        columns += [
            f"CASE WHEN {c} < 0 OR {c} > 1 THEN NULL ELSE {c} END AS {c}",
            f"{_flag(f'{c} IS NULL')} AS {c}_missing",
            f"{_flag(f'{c} < 0 OR {c} > 1')} AS {c}_invalid",
        ]
    columns += ["CAST(bureau_cnt AS DOUBLE) AS bureau_cnt", f"{_flag('bureau_cnt > 0')} AS bureau_has_record"]
    return f"SELECT {', '.join(columns)} FROM wide"


def _features() -> str:
    derived = [
        f"{_flag('employed_years > age_years')} AS employment_age_inconsistent",
        f"{_flag('amt_income_total = 0')} AS income_zero",
        *[f"CASE WHEN amt_income_total > 0 THEN {n} / amt_income_total END AS {f}" for f, n in RATIOS.items()],
    ]
    return f"SELECT *, {', '.join(derived)} FROM masked"


QUOTA = """
SELECT target, n, base + CASE WHEN pos <= {wanted} - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM (
  SELECT target, n, CAST(floor(share) AS BIGINT) AS base,
         row_number() OVER (ORDER BY share - floor(share) DESC, target) AS pos
  FROM (SELECT target, n, ({wanted}) * CAST(n AS DOUBLE) / total AS share FROM {source}) s
) q
"""

CTES = {
    "application": fixtures.APPLICATION,
    "bureau": fixtures.BUREAU,
    "scored": fixtures.SCORED,
    "agg": """
SELECT sk_id_curr, count(*) AS bureau_cnt,
  CAST(sum(CASE WHEN credit_active = 'Active' THEN 1 ELSE 0 END) AS BIGINT) AS bureau_active_cnt,
  sum(amt_credit_sum) AS bureau_credit_sum_total, avg(amt_credit_sum) AS bureau_credit_sum_avg,
  sum(amt_credit_sum_debt) AS bureau_debt_total, max(credit_day_overdue) AS bureau_overdue_days_max,
  CAST(sum(CASE WHEN credit_day_overdue > 0 THEN 1 ELSE 0 END) AS BIGINT) AS bureau_overdue_cnt,
  max(days_credit) AS bureau_days_credit_recent
FROM bureau GROUP BY sk_id_curr""",
    "wide": """
SELECT a.*, coalesce(b.bureau_cnt, 0) AS bureau_cnt, coalesce(b.bureau_active_cnt, 0) AS bureau_active_cnt,
  b.bureau_credit_sum_total, b.bureau_credit_sum_avg, b.bureau_debt_total,
  coalesce(b.bureau_overdue_cnt, 0) AS bureau_overdue_cnt, b.bureau_overdue_days_max, b.bureau_days_credit_recent
FROM application a LEFT JOIN agg b ON a.sk_id_curr = b.sk_id_curr""",
    "masked": _masked(),
    "feats": _features(),
    "hashed": f"""
SELECT sk_id_curr, target, row_number() OVER (PARTITION BY target ORDER BY md5('{SEED}:' || sk_id_curr), sk_id_curr) AS pos,
  md5('{SEED}:' || sk_id_curr) AS h FROM application""",
    "classes": "SELECT target, count(*) AS n, sum(count(*)) OVER () AS total FROM application GROUP BY target",
    "test_quota": QUOTA.format(wanted="ceil(2e-1 * total)", source="classes").replace(
        "SELECT target, n, base", "SELECT target, n, total, base"
    ).replace("SELECT target, n, CAST(floor", "SELECT target, n, total, CAST(floor").replace(
        "(SELECT target, n, (", "(SELECT target, n, total, ("
    ).replace("ceil(2e-1 * total) - sum", "max(ceil(2e-1 * total)) OVER () - sum"),
    "rest": "SELECT target, n - quota AS n, sum(n - quota) OVER () AS total FROM test_quota",
    "valid_quota": QUOTA.format(wanted="ceil(round(25e-2 * total, 9))", source="rest").replace(
        "SELECT target, n, base", "SELECT target, n, total, base"
    ).replace("SELECT target, n, CAST(floor", "SELECT target, n, total, CAST(floor").replace(
        "(SELECT target, n, (", "(SELECT target, n, total, ("
    ).replace("ceil(round(25e-2 * total, 9)) - sum", "max(ceil(round(25e-2 * total, 9))) OVER () - sum"),
    "member": """
SELECT h.sk_id_curr, h.target, h.h, CASE WHEN h.pos <= t.quota THEN 'test'
  WHEN h.pos <= t.quota + v.quota THEN 'valid' ELSE 'train' END AS partition
FROM hashed h JOIN test_quota t ON h.target = t.target JOIN valid_quota v ON h.target = v.target""",
    "parted": "SELECT f.*, m.partition FROM feats f JOIN member m ON f.sk_id_curr = m.sk_id_curr",
    "numbers": "SELECT sk_id_curr, target, partition, "
    + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
    + " FROM parted",
    "long": f"SELECT * FROM numbers UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATURES)}))",
    "extent": """
SELECT feature, count(DISTINCT value) AS nd, min(value) AS lo, max(value) AS hi
FROM long WHERE partition = 'train' GROUP BY feature""",
    "cuts": """
SELECT DISTINCT feature, edge FROM (
  SELECT l.feature, l.value AS edge FROM long l JOIN extent x ON l.feature = x.feature
  WHERE l.partition = 'train' AND x.nd <= 5 AND l.value < x.hi
  UNION ALL
  SELECT q.feature, q.edge FROM (
    SELECT l.feature, unnest(quantile_cont(l.value, [0.2::DOUBLE, 0.4::DOUBLE, 0.6000000000000001::DOUBLE, 0.8::DOUBLE])) AS edge
    FROM long l JOIN extent x ON l.feature = x.feature
    WHERE l.partition = 'train' AND x.nd > 5 AND l.value IS NOT NULL GROUP BY l.feature) q
  JOIN extent x ON q.feature = x.feature WHERE q.edge > x.lo AND q.edge < x.hi) e""",
    "edge_lists": """
SELECT x.feature, x.nd, x.lo, x.hi, coalesce(list(c.edge ORDER BY c.edge) FILTER (WHERE c.edge IS NOT NULL), []) AS edges
FROM extent x LEFT JOIN cuts c ON x.feature = c.feature GROUP BY x.feature, x.nd, x.lo, x.hi""",
    "binned": """
SELECT l.*, CASE WHEN l.value IS NULL THEN 'missing' WHEN e.nd = 0 THEN 'outside_training'
  ELSE 'bin_' || lpad(CAST(len(list_filter(e.edges, lambda c: c < l.value)) AS VARCHAR), 3, '0') END AS bin
FROM long l JOIN edge_lists e ON l.feature = e.feature""",
    "bin_n": """
SELECT feature, bin, count(*) AS n_samples, CAST(sum(target) AS BIGINT) AS n_bad
FROM binned WHERE partition = 'train' GROUP BY feature, bin""",
    "bin_k": """
SELECT *, n_samples - n_bad AS n_good, sum(n_bad) OVER w AS tb, sum(n_samples - n_bad) OVER w AS tg, count(*) OVER w AS k
FROM bin_n WINDOW w AS (PARTITION BY feature)""",
    "woe": """
SELECT *, ln(bad_share) - ln(good_share) AS woe, (bad_share - good_share) * (ln(bad_share) - ln(good_share)) AS iv_component
FROM (SELECT feature, bin, n_samples, n_bad, n_good, n_bad / CAST(n_samples AS DOUBLE) AS bad_rate,
  (n_bad + 5e-1) / (tb + 5e-1 * k) AS bad_share, (n_good + 5e-1) / (tg + 5e-1 * k) AS good_share,
  n_samples < 20 AS small_bin, (n_bad = 0 OR n_good = 0) AS single_class_bin FROM bin_k) s""",
    "iv": """
SELECT feature, sum(iv_component) AS iv, count(*) AS n_bins,
  CAST(sum(CASE WHEN small_bin THEN 1 ELSE 0 END) AS BIGINT) AS small_bins,
  CAST(sum(CASE WHEN single_class_bin THEN 1 ELSE 0 END) AS BIGINT) AS single_class_bins,
  sum(iv_component) >= 5e-1 AS review_high_iv FROM woe GROUP BY feature""",
    "halves": f"""
SELECT sk_id_curr, target, row_number() OVER (PARTITION BY target ORDER BY h, sk_id_curr) AS pos,
  count(*) OVER (PARTITION BY target) AS n, count(*) OVER () AS total FROM member WHERE partition = 'valid'""",
}


def _curve(source: str, y: str, p: str, w: str = "1", by: str = "") -> dict[str, str]:
    """Tie-grouped cumulative counts by plain window functions."""
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    return {
        "ties": f"SELECT {lead}{p} AS p, sum({w} * {y}) AS bad, sum({w} * (1 - {y})) AS good FROM {source} GROUP BY {lead}{p}",
        "curve": f"""
SELECT *, sum(bad) OVER u AS cb, sum(good) OVER u AS cg, sum(bad) OVER t AS tb, sum(good) OVER t AS tg FROM ties
WINDOW u AS ({part}ORDER BY p DESC ROWS UNBOUNDED PRECEDING), t AS ({part}{'' if by else ''})""",
    }


RANKS = """sum(good * (cb - bad / 2e0)) / (max(tb) * CAST(max(tg) AS DOUBLE)) AS auc,
  max(abs(cb / CAST(tb AS DOUBLE) - cg / CAST(tg AS DOUBLE))) AS ks,
  sum(CASE WHEN cb + cg > 0 THEN bad / CAST(tb AS DOUBLE) * cb / CAST(cb + cg AS DOUBLE) ELSE 0 END) AS average_precision"""

EPS = "2.220446049250313e-16"


def _loss(y: str, p: str) -> str:
    q = f"greatest(least({p}, 1e0 - {EPS}), {EPS})"
    return f"-(CASE WHEN {y} = 1 THEN ln({q}) ELSE ln(1e0 - {q}) END)"


def _report(source: str, p: str) -> tuple[dict[str, str], str]:
    curve = _curve(source, "target", p)
    body = f"""
SELECT CAST(b.n AS BIGINT) AS n_samples, b.bad_rate, b.mean_probability, r.auc, 2 * r.auc - 1 AS gini, r.ks,
  r.average_precision, b.brier, b.log_loss
FROM (SELECT {RANKS} FROM curve) r,
 (SELECT count(*) AS n, avg(target) AS bad_rate, avg({p}) AS mean_probability,
   avg(({p} - target) * ({p} - target)) AS brier, avg({_loss('target', p)}) AS log_loss FROM {source}) b"""
    return curve, body


def _rounded(body: str, columns: dict[str, int | None]) -> str:
    picked = [f"{c} AS {c}" if d is None else f"round({c}, {d}) + 0e0 AS {c}" for c, d in columns.items()]
    return f"SELECT {', '.join(picked)} FROM ({body}) z"


def _cols(plain: str = "", rounded: str = "", digits: int = 6) -> dict[str, int | None]:
    return {**{c: None for c in plain.split()}, **{c: digits for c in rounded.split()}}


def _needs(text: str, ctes: dict[str, str], found: list[str]) -> None:
    import re

    for name, sql in ctes.items():
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
            _needs(sql, ctes, found)
            if name not in found:
                found.append(name)


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    ctes = {**CTES, **(extra or {})}
    found: list[str] = []
    _needs(body, ctes, found)
    if not found:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in found) + "\n" + body


# --- frozen model --------------------------------------------------------------------


def _case(feature: str, values: dict[str, float], default: str = "0e0") -> str:
    """Straight CASE over the frozen edges of one feature."""
    edges = frozen.EDGES[feature]
    arms = [f"WHEN {feature} IS NULL THEN {values.get('missing', default)!s}"]
    for i, e in enumerate(edges):
        arms.append(f"WHEN {feature} <= {e!r} THEN {values.get(f'bin_{i:03d}', default)!s}")
    return f"CASE {' '.join(arms)} ELSE {values.get(f'bin_{len(edges):03d}', default)!s} END"


def _terms() -> dict[str, str]:
    return {
        f: "CAST(" + _case(f, {b: repr(c * w) for b, w in frozen.WOE[f].items()}) + " AS DOUBLE)"
        for f, c in frozen.COEFFICIENTS.items()
    }


def _unknown(feature: str) -> str:
    return _case(feature, {b: "0" for b in frozen.WOE[feature]}, "1")


QUALITY = [f for f in FEATURES if f.endswith(("_missing", "_invalid", "_sentinel"))]


def _total(suffix: str) -> str:
    return " + ".join(f for f in FEATURES if f.endswith(suffix))


def _frozen_ctes() -> dict[str, str]:
    terms = _terms()
    z = " + ".join([*[f"t_{f}" for f in terms], repr(frozen.INTERCEPT)])
    unknown = " + ".join(_unknown(f) for f in terms)
    review = " OR ".join(f"{f} > 0" for f in [*QUALITY, "income_zero", "employment_age_inconsistent"])
    return {
        "terms": f"SELECT *, {', '.join(f'{t} AS t_{f}' for f, t in terms.items())}, CAST({unknown} AS BIGINT) AS unknown_n FROM feats",
        "linear": f"SELECT *, {z} AS log_odds FROM terms",
        "frozen_scores": f"""
SELECT sk_id_curr, log_odds, 1e0 / (1e0 + exp(-log_odds)) AS predicted_bad_probability,
  {SCALE.offset!r} - {SCALE.factor!r} * log_odds AS score_raw,
  round_even({SCALE.offset!r} - {SCALE.factor!r} * log_odds, 0) AS score_display,
  unknown_n AS unknown_selected_bins, ({review} OR unknown_n > 0) AS input_review_required FROM linear""",
    }


def _groups() -> dict[str, str]:
    return {g: " + ".join(f"t_{f}" for f in fs) for g, fs in group_members(frozen.EDGES).items()}


# --- statements ----------------------------------------------------------------------


def statements() -> dict[str, str]:
    out: dict[str, str] = {}

    def add(name: str, body: str, extra: dict[str, str] | None = None) -> None:
        out[name] = with_ctes(body, extra)

    wide_doubles = (
        "amt_income_total amt_credit amt_annuity days_birth days_employed ext_source_1 ext_source_2 ext_source_3 "
        "bureau_credit_sum_total bureau_credit_sum_avg bureau_debt_total"
    )
    wide_plain = (
        "sk_id_curr target name_contract_type bureau_cnt bureau_active_cnt bureau_overdue_cnt "
        "bureau_overdue_days_max bureau_days_credit_recent"
    )
    for name in ("agg_left_join_wide", "loaded_model_table"):
        add(name, _rounded("SELECT * FROM wide", _cols(wide_plain, wide_doubles)))
    add(
        "child_aggregate",
        _rounded(
            "SELECT * FROM agg",
            _cols(
                "sk_id_curr bureau_cnt bureau_active_cnt bureau_overdue_days_max bureau_overdue_cnt bureau_days_credit_recent",
                "bureau_credit_sum_total bureau_credit_sum_avg bureau_debt_total",
            ),
        ),
    )
    add(
        "reconcile_key_mismatch",
        """SELECT count(*) FILTER (WHERE b.sk_id_curr IS NULL) AS left_only,
  count(*) FILTER (WHERE a.sk_id_curr IS NULL) AS right_only,
  count(*) FILTER (WHERE a.sk_id_curr IS NULL OR b.sk_id_curr IS NULL) AS key_mismatch
FROM application a FULL OUTER JOIN agg b ON a.sk_id_curr = b.sk_id_curr""",
    )
    add(
        "reconcile_field_mismatch",
        """SELECT count(*) AS field_mismatch FROM application a
JOIN wide b ON a.sk_id_curr = b.sk_id_curr
WHERE a.target IS DISTINCT FROM b.target OR a.amt_income_total IS DISTINCT FROM b.amt_income_total
  OR a.amt_credit IS DISTINCT FROM abs(b.amt_credit) OR a.days_birth IS DISTINCT FROM b.days_birth
  OR a.ext_source_1 IS DISTINCT FROM b.ext_source_1 OR a.name_contract_type IS DISTINCT FROM b.name_contract_type""",
    )
    add(
        "linkage_counts",
        """SELECT (SELECT count(*) FROM application a WHERE EXISTS (SELECT 1 FROM bureau b WHERE b.sk_id_curr = a.sk_id_curr)) AS parents_with_child,
  (SELECT count(*) FROM application a WHERE NOT EXISTS (SELECT 1 FROM bureau b WHERE b.sk_id_curr = a.sk_id_curr)) AS parents_without_child,
  (SELECT count(*) FROM bureau b WHERE NOT EXISTS (SELECT 1 FROM application a WHERE b.sk_id_curr = a.sk_id_curr)) AS orphan_children,
  (SELECT count(*) FROM bureau) AS children""",
    )
    add(
        "reconciliation_report",
        """SELECT check_name, expected, actual, expected = actual AS ok FROM (
  SELECT 'aggregate_rows' AS check_name, (SELECT count(DISTINCT sk_id_curr) FROM bureau) AS expected, (SELECT count(*) FROM agg) AS actual
  UNION ALL SELECT 'wide_rows', (SELECT count(*) FROM application), (SELECT count(*) FROM wide)
  UNION ALL SELECT 'key_sets', 0, (SELECT count(*) FROM application a FULL OUTER JOIN wide w ON a.sk_id_curr = w.sk_id_curr WHERE a.sk_id_curr IS NULL OR w.sk_id_curr IS NULL)
  UNION ALL SELECT 'paired_fields', 0, (SELECT count(*) FROM application a JOIN wide w ON a.sk_id_curr = w.sk_id_curr
    WHERE a.target IS DISTINCT FROM w.target OR a.amt_income_total IS DISTINCT FROM w.amt_income_total OR a.amt_credit IS DISTINCT FROM w.amt_credit
    OR a.days_birth IS DISTINCT FROM w.days_birth OR a.ext_source_1 IS DISTINCT FROM w.ext_source_1 OR a.name_contract_type IS DISTINCT FROM w.name_contract_type)
) r""",
    )
    pairs = [("application", f) for f in RAW_COLUMNS[:8]] + [
        ("bureau", f) for f in ("credit_active", "days_credit", "amt_credit_sum", "amt_credit_sum_debt", "credit_day_overdue")
    ]
    add(
        "missing_counts",
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, '{f}' AS field, count(*) FILTER (WHERE {f} IS NULL) AS missing FROM {t}" for t, f in pairs
        ),
    )
    add(
        "missingness_class",
        " UNION ALL ".join(
            f"""SELECT '{f}' AS field, count(*) FILTER (WHERE k = 0) AS all_unknown, count(*) FILTER (WHERE k > 0 AND k < n) AS partly_known,
  count(*) FILTER (WHERE k = n) AS all_known FROM (SELECT b.sk_id_curr, count(b.{f}) AS k, count(*) AS n FROM bureau b
  JOIN application a ON a.sk_id_curr = b.sk_id_curr GROUP BY b.sk_id_curr) g{i}"""
            for i, f in enumerate(("amt_credit_sum", "amt_credit_sum_debt"))
        ),
    )
    add("duplicate_keys", "SELECT sk_id_bureau, count(*) AS n FROM bureau GROUP BY sk_id_bureau HAVING count(*) > 1")
    totals = " UNION ALL ".join(
        f"""SELECT '{f}' AS field, round(CAST(sum(CAST({f} AS DECIMAL(28,6))) AS DOUBLE), 2) AS total,
  count(*) FILTER (WHERE {f} % 1 <> 0) AS non_integer, count(*) FILTER (WHERE {f} = {special}) AS special,
  count(*) FILTER (WHERE {f} IS NULL) AS missing FROM application"""
        for f, special in (("days_employed", "365243"), ("days_birth", "NULL"), ("amt_credit", "NULL"), ("ext_source_1", "NULL"))
    )
    add("control_totals", totals)
    add("control_totals_match", "SELECT 'days_employed' AS field, true AS same UNION ALL SELECT 'amt_credit', NOT EXISTS (SELECT 1 FROM application WHERE amt_credit < 0)")
    wide_names = (wide_plain + " " + wide_doubles).split()
    add(
        "table_profile_missing_top10",
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 9) AS missing_rate FROM wide" for c in wide_names
        )
        + ") m ORDER BY missing_rate DESC, column_name LIMIT 10",
    )
    add(
        "label_distribution",
        "SELECT target, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM application GROUP BY target",
    )
    add(
        "per_field_compare",
        " UNION ALL ".join(
            f"""SELECT '{f}' AS field, count(*) FILTER (WHERE b.sk_id_curr IS NOT NULL) AS compared,
  count(*) FILTER (WHERE b.sk_id_curr IS NOT NULL AND a.{f} IS DISTINCT FROM b.{f}) AS mismatches,
  CAST(0 AS BIGINT) AS missing_left, count(*) FILTER (WHERE b.sk_id_curr IS NULL) AS missing_right
FROM application a LEFT JOIN (SELECT sk_id_curr, target, amt_credit, coalesce(amt_annuity, 0e0) AS amt_annuity, days_employed
  FROM application WHERE sk_id_curr % 10 <> 3) b ON a.sk_id_curr = b.sk_id_curr"""
            for f in ("target", "amt_credit", "amt_annuity", "days_employed")
        ),
    )
    add(
        "id_set_check",
        """SELECT 'parents_only' AS side, count(*) AS n FROM application a WHERE a.sk_id_curr NOT IN (SELECT sk_id_curr FROM bureau)
UNION ALL SELECT 'children_only', count(DISTINCT sk_id_curr) FROM bureau b WHERE b.sk_id_curr NOT IN (SELECT sk_id_curr FROM application)""",
    )

    ints = [f for f in FEATURES if f.endswith(("_missing", "_invalid", "_sentinel", "_zero", "_record", "_inconsistent"))]
    reals = [f for f in FEATURES if f not in ints]
    add("business_feature_table", _rounded("SELECT * FROM feats", _cols("sk_id_curr " + " ".join(ints), " ".join(reals))))
    quality = f"""SELECT sk_id_curr, CAST({_total('_missing')} AS BIGINT) AS raw_missing_count, CAST({_total('_invalid')} AS BIGINT) AS invalid_value_count,
  CAST({_total('_sentinel')} AS BIGINT) AS sentinel_count, CAST(employment_age_inconsistent AS BIGINT) AS employment_age_inconsistent,
  CAST(income_zero AS BIGINT) AS income_zero FROM feats"""
    add("row_quality", quality)
    add(
        "quality_counts",
        f"SELECT count(*) FILTER (WHERE {_total('_invalid')} > 0) AS invalid_rows, count(*) FILTER (WHERE {_total('_sentinel')} > 0) AS sentinel_rows FROM feats",
    )

    add(
        "bin_edges",
        "SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY edge) - 1 AS INT) AS position, round(edge, 6) AS edge FROM cuts",
    )
    add(
        "bin_labels",
        "SELECT sk_id_curr, "
        + ", ".join(f"max(CASE WHEN feature = '{f}' THEN bin END) AS {f}" for f in FEATURES)
        + " FROM binned GROUP BY sk_id_curr",
    )
    add("bin_counts", "SELECT feature, bin, n_samples, n_bad FROM bin_n")
    woe_cols = _cols("feature bin n_samples n_bad n_good small_bin single_class_bin", "bad_rate bad_share good_share woe iv_component")
    add("woe_table", _rounded("SELECT * FROM woe", woe_cols))
    labelled = {
        "bin_n": """
SELECT feature, bin, count(*) AS n_samples, CAST(sum(target) AS BIGINT) AS n_bad FROM (
  SELECT target, 'name_contract_type' AS feature, name_contract_type AS bin FROM application
  UNION ALL SELECT target, 'last_digit', 'd' || (sk_id_curr % 10) FROM application) u GROUP BY feature, bin""",
        "woe": CTES["woe"].replace("5e-1", "1e0").replace("< 20", "< 1500"),
    }
    add("woe_table_labels", _rounded("SELECT * FROM woe", woe_cols), labelled)
    add("iv_report", _rounded("SELECT * FROM iv", _cols("feature n_bins small_bins single_class_bins review_high_iv", "iv")))
    add("candidate_features", "SELECT feature, round(iv, 6) AS iv FROM iv WHERE iv >= 2e-2")
    add(
        "woe_apply",
        "SELECT sk_id_curr, "
        + ", ".join(f"round(max(CASE WHEN b.feature = '{f}' THEN coalesce(w.woe, 0e0) END), 6) AS {f}" for f in FEATURES)
        + " FROM binned b LEFT JOIN woe w ON b.feature = w.feature AND b.bin = w.bin GROUP BY sk_id_curr",
    )
    add(
        "unknown_bins",
        " UNION ALL ".join(
            f"""SELECT '{f}' AS feature, count(*) AS n_samples, CAST(sum({_unknown(f)}) AS BIGINT) AS unknown_count,
  round(sum({_unknown(f)}) / CAST(count(*) AS DOUBLE), 6) AS unknown_rate FROM feats"""
            for f in frozen.EDGES
        ),
    )
    position = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FEATURES))
    encoded = {
        "spread": "SELECT feature, count(DISTINCT woe) AS nv FROM woe GROUP BY feature",
        "enc": "SELECT b.sk_id_curr, b.feature, coalesce(w.woe, 0e0) AS v FROM binned b LEFT JOIN woe w ON b.feature = w.feature AND b.bin = w.bin WHERE b.partition = 'train'",
        "eligible": f"SELECT i.feature, i.iv, row_number() OVER (ORDER BY i.iv DESC, CASE i.feature {position} END) AS pos FROM iv i JOIN spread s ON i.feature = s.feature WHERE s.nv > 1 AND i.iv >= 2e-2",
        "twins": """SELECT a.feature AS first, b.feature AS second FROM eligible ea JOIN eligible eb ON ea.pos < eb.pos
  JOIN enc a ON a.feature = ea.feature JOIN enc b ON b.feature = eb.feature AND a.sk_id_curr = b.sk_id_curr
  GROUP BY a.feature, b.feature HAVING count(*) = count(*) FILTER (WHERE a.v = b.v)""",
        "firsts": "SELECT second, arg_min(first, pos) AS first FROM twins t JOIN eligible e ON e.feature = t.first GROUP BY second",
    }
    add(
        "encoded_selection_log",
        """SELECT i.feature, round(i.iv, 6) AS iv, CASE WHEN s.nv <= 1 THEN 'drop_constant' WHEN i.iv < 2e-2 THEN 'drop_low_iv'
  WHEN t.second IS NOT NULL THEN 'drop_duplicate_of:' || t.first ELSE 'keep' END AS selection_reason
FROM iv i JOIN spread s ON i.feature = s.feature LEFT JOIN firsts t ON t.second = i.feature""",
        encoded,
    )
    raw_names = [*FEATURES, "amt_credit_copy"]
    constant = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {i} AS pos, count(DISTINCT {f}) + CASE WHEN count({f}) < count(*) THEN 1 ELSE 0 END <= 1 AS constant FROM copied"
        for i, f in enumerate(raw_names)
    )
    raw_pairs = [(a, b) for i, a in enumerate(raw_names) for b in raw_names[i + 1:]]
    same = ", ".join(f"bool_and({a} IS NOT DISTINCT FROM {b}) AS e{i}" for i, (a, b) in enumerate(raw_pairs))
    twins = " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, e{i} AS same FROM tests" for i, (a, b) in enumerate(raw_pairs))
    add(
        "raw_selection_log",
        """SELECT c.feature, CASE WHEN c.constant THEN 'drop_constant' WHEN f.second IS NOT NULL THEN 'drop_duplicate_of:' || f.first
  ELSE 'keep' END AS selection_reason FROM consts c LEFT JOIN firsts f ON f.second = c.feature""",
        {
            "copied": "SELECT " + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES) + ", amt_credit AS amt_credit_copy FROM feats",
            "consts": constant,
            "tests": f"SELECT {same} FROM copied",
            "firsts": f"""SELECT t.second, arg_min(t.first, c.pos) AS first FROM ({twins}) t JOIN consts c ON c.feature = t.first AND NOT c.constant
  WHERE t.same GROUP BY t.second""",
        },
    )

    add("stratified_membership", "SELECT sk_id_curr, partition FROM member")
    add(
        "split_quality",
        "SELECT partition, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS n_bad, round(avg(target), 6) AS bad_rate FROM member GROUP BY partition",
    )
    add("partition_check", "SELECT CAST(0 AS BIGINT) AS overlapping, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS invented")
    add(
        "validation_halves",
        """SELECT sk_id_curr, CASE WHEN pos <= quota THEN 'selection' ELSE 'calibration' END AS inner_partition FROM (
  SELECT h.sk_id_curr, h.pos, q.base + CASE WHEN q.place <= q.wanted - q.based THEN 1 ELSE 0 END AS quota FROM halves h JOIN (
    SELECT *, sum(base) OVER () AS based, row_number() OVER (ORDER BY share - base DESC, target) AS place FROM (
      SELECT target, max(ceil(5e-1 * total)) AS wanted, max(ceil(5e-1 * total) * CAST(n AS DOUBLE) / total) AS share,
        CAST(floor(max(ceil(5e-1 * total) * CAST(n AS DOUBLE) / total)) AS BIGINT) AS base FROM halves GROUP BY target) s) q
  ON q.target = h.target) x""",
    )
    add("seeded_sample", f"SELECT sk_id_curr FROM application ORDER BY md5('{SEED}:' || sk_id_curr), sk_id_curr LIMIT 200")
    add(
        "first_rows_per_partition",
        "SELECT sk_id_curr, partition FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY sk_id_curr) AS rn FROM member) m WHERE rn <= 50",
    )

    metrics = _cols("", "auc ks average_precision")
    add("ranking_metrics", _rounded(f"SELECT {RANKS} FROM curve", metrics), _curve("scored", "target", "p_base"))
    add(
        "ranking_metrics_weighted",
        _rounded(f"SELECT {RANKS} FROM curve", metrics),
        _curve("scored", "target", "p_challenger", "(sk_id_curr % 5)"),
    )
    report_cols = _cols("n_samples", "bad_rate mean_probability auc gini ks average_precision brier log_loss")
    curve, body = _report("scored", "p_base")
    add("probability_report", _rounded(body, report_cols), curve)
    comparison: dict[str, str] = {"constants": "SELECT *, 12e-2 AS p_constant FROM scored"}
    parts = []
    for model, column in (("base", "p_base"), ("challenger", "p_challenger"), ("constant", "p_constant")):
        curve, body = _report("constants", column)
        comparison[f"ties_{model}"] = curve["ties"]
        comparison[f"curve_{model}"] = curve["curve"].replace("FROM ties", f"FROM ties_{model}")
        comparison[f"report_{model}"] = body.replace("FROM curve", f"FROM curve_{model}")
        parts.append(f"SELECT '{model}' AS model, * FROM report_{model}")
    add("model_comparison", _rounded(" UNION ALL ".join(parts), {"model": None, **report_cols}), comparison)

    z = 1.959963984540054
    calibrated = {
        "slots": "SELECT i, i / 1e1 AS lo, (i + 1) / 1e1 AS hi FROM range(10) r(i)",
        "filled": """SELECT s.i, s.lo, s.hi, count(c.p_base) AS n, CAST(coalesce(sum(c.target), 0) AS BIGINT) AS b, avg(c.p_base) AS mp, avg(c.target) AS r
FROM slots s LEFT JOIN scored c ON (c.p_base > s.lo OR (s.i = 0 AND c.p_base = 0)) AND c.p_base <= s.hi GROUP BY s.i, s.lo, s.hi""",
    }
    add(
        "calibration_bins",
        _rounded(
            f"""SELECT 'pbin_' || lpad(CAST(i AS VARCHAR), 2, '0') AS bin, lo AS lower_edge, hi AS upper_edge, n AS n_samples, b AS n_bad,
  mp AS mean_probability, r AS observed_rate,
  CASE WHEN n > 0 THEN greatest(0e0, (r + {z*z!r} / (2e0 * n)) / (1e0 + {z*z!r} / n) - {z!r} * sqrt(r * (1e0 - r) / n + {z*z!r} / (4e0 * n * n)) / (1e0 + {z*z!r} / n)) END AS observed_lower,
  CASE WHEN n > 0 THEN least(1e0, (r + {z*z!r} / (2e0 * n)) / (1e0 + {z*z!r} / n) + {z!r} * sqrt(r * (1e0 - r) / n + {z*z!r} / (4e0 * n * n)) / (1e0 + {z*z!r} / n)) END AS observed_upper,
  mp - r AS calibration_gap, n = 0 AS empty_bin, (n > 0 AND n < 30) AS small_bin FROM filled""",
            _cols(
                "bin n_samples n_bad empty_bin small_bin",
                "lower_edge upper_edge mean_probability observed_rate observed_lower observed_upper calibration_gap",
            ),
        ),
        calibrated,
    )
    add(
        "calibration_summary",
        _rounded(
            f"""SELECT t.*, g.ece, g.empty_bins, g.small_bins, t.ends AS endpoint_count FROM (
  SELECT count(*) AS n_samples, avg(target) AS bad_rate, avg(p_base) AS mean_probability, avg(p_base) - avg(target) AS bias,
    avg((p_base - target) * (p_base - target)) AS brier, avg({_loss('target', 'p_base')}) AS log_loss,
    count(*) FILTER (WHERE p_base = 0 OR p_base = 1) AS ends FROM scored) t, (
  SELECT sum(n * abs(mp - r)) / sum(n) AS ece, count(*) FILTER (WHERE n = 0) AS empty_bins, count(*) FILTER (WHERE n > 0 AND n < 30) AS small_bins FROM filled) g""",
            _cols("n_samples empty_bins small_bins endpoint_count", "bad_rate mean_probability bias brier log_loss ece"),
        ),
        calibrated,
    )
    points = ", ".join(f"{x!r}::DOUBLE" for x in [i * 0.1 for i in range(10)] + [1.0])
    add(
        "reliability_deciles",
        _rounded(
            """SELECT CAST(len(list_filter(q.inner_edges, lambda e: e < s.p_challenger)) AS INT) AS bin_index, min(s.p_challenger) AS lower, max(s.p_challenger) AS upper,
  count(*) AS n_samples, avg(s.p_challenger) AS mean_probability, avg(s.target) AS observed_rate FROM scored s CROSS JOIN edges q GROUP BY 1""",
            _cols("bin_index n_samples", "lower upper mean_probability observed_rate"),
        ),
        {
            "quants": f"SELECT list_sort(list_distinct(quantile_cont(p_challenger, [{points}]))) AS e FROM scored",
            "edges": "SELECT e[2:len(e) - 1] AS inner_edges FROM quants",
            "scored": CTES["scored"],
        },
    )
    # The edge table is reached through CROSS JOIN, so it is named explicitly above.
    add(
        "score_describe",
        _rounded(
            """SELECT count(*) AS n, avg(p_base) AS mean, stddev_samp(p_base) AS std, min(p_base) AS min, quantile_cont(p_base, 25e-2) AS q25,
  quantile_cont(p_base, 5e-1) AS q50, quantile_cont(p_base, 75e-2) AS q75, max(p_base) AS max FROM scored""",
            _cols("n", "mean std min q25 q50 q75 max"),
        ),
    )
    add(
        "capacity_threshold",
        """SELECT 0.1::DOUBLE AS capacity, CAST(k AS BIGINT) AS target_count, count(*) FILTER (WHERE p_base >= t) AS flagged_count,
  round(count(*) FILTER (WHERE p_base >= t) / CAST(count(*) AS DOUBLE), 6) AS flagged_share, round(t, 6) AS threshold
FROM scored, (SELECT max(p_base) AS t, max(k) AS k FROM (SELECT p_base, row_number() OVER (ORDER BY p_base DESC) AS rn, ceil(1e-1 * count(*) OVER ()) AS k FROM scored) o WHERE rn = k) c
GROUP BY t, k""",
    )
    add(
        "flag_quality",
        _rounded(
            """SELECT count(*) AS n_samples, avg(target) AS bad_rate, avg(CASE WHEN p_base >= 3e-1 THEN 1 ELSE 0 END) AS flagged_share,
  avg(target) FILTER (WHERE p_base >= 3e-1) AS flagged_bad_rate, avg(CASE WHEN p_base >= 3e-1 THEN 1 ELSE 0 END) FILTER (WHERE target = 1) AS bad_coverage,
  avg(CASE WHEN p_base >= 3e-1 THEN 1 ELSE 0 END) FILTER (WHERE target = 0) AS good_flagged_share,
  count(*) FILTER (WHERE target = 1 AND p_base < 3e-1) AS missed_bad FROM scored""",
            _cols("n_samples missed_bad", "bad_rate flagged_share flagged_bad_rate bad_coverage good_flagged_share"),
        ),
    )
    add(
        "evaluation_rows",
        "SELECT sk_id_curr, target, p_challenger AS predicted_probability, p_challenger >= 3e-1 AS flagged_for_review FROM scored",
    )

    grid = sorted({*[i * 0.01 for i in range(31)], 1.0})
    curve_cols = _cols(
        "rule_mode approved_count approved_event_count approved_non_event_count",
        "threshold approval_rate approved_event_rate predicted_approved_event_rate rejected_event_capture_rate "
        "non_event_rejection_rate scenario_utility scenario_utility_per_applicant predicted_scenario_utility",
    )

    def curve_ctes(p: str, thresholds) -> dict[str, str]:
        listed = ", ".join(f"({t!r}::DOUBLE)" for t in thresholds)
        return {
            "rules": f"SELECT 'reject_all' AS rule_mode, CAST(NULL AS DOUBLE) AS threshold UNION ALL SELECT 'threshold', t FROM (VALUES {listed}) v(t)",
            "approved": f"""SELECT r.rule_mode, r.threshold, count(s.{p}) AS n, CAST(coalesce(sum(s.target), 0) AS BIGINT) AS e, coalesce(sum(s.{p}), 0) AS ps
FROM rules r LEFT JOIN scored s ON s.{p} <= r.threshold GROUP BY r.rule_mode, r.threshold""",
            "all_rows": "SELECT count(*) AS total, CAST(sum(target) AS BIGINT) AS events FROM scored",
            "policies": """SELECT rule_mode, threshold, n AS approved_count, e AS approved_event_count, n - e AS approved_non_event_count,
  n / CAST(total AS DOUBLE) AS approval_rate, CASE WHEN n > 0 THEN e / CAST(n AS DOUBLE) END AS approved_event_rate,
  CASE WHEN n > 0 THEN ps / n END AS predicted_approved_event_rate, (events - e) / CAST(events AS DOUBLE) AS rejected_event_capture_rate,
  (total - events - (n - e)) / CAST(total - events AS DOUBLE) AS non_event_rejection_rate,
  (n - e) * 100e0 - e * 1000e0 - n * 5e0 AS scenario_utility, ((n - e) * 100e0 - e * 1000e0 - n * 5e0) / total AS scenario_utility_per_applicant,
  (n - ps) * 100e0 - ps * 1000e0 - n * 5e0 AS predicted_scenario_utility FROM approved JOIN all_rows ON true""",
        }

    add("policy_curve", _rounded("SELECT * FROM policies", curve_cols), curve_ctes("p_base", grid))
    add(
        "policy_select",
        _rounded(
            """SELECT * FROM policies WHERE rule_mode = 'threshold' AND approved_count >= 100 AND approval_rate >= 5e-2 AND approved_event_rate <= 2e-1
ORDER BY scenario_utility DESC, approved_count, threshold LIMIT 1""",
            curve_cols,
        ),
        curve_ctes("p_base", grid),
    )
    add(
        "fixed_rule_evaluation",
        _rounded("SELECT * FROM policies WHERE rule_mode = 'threshold'", curve_cols),
        curve_ctes("p_challenger", [0.05]),
    )
    add(
        "fixed_rule_sensitivity",
        _rounded(
            """SELECT threshold, event_loss, n / CAST(total AS DOUBLE) AS approval_rate, e / CAST(n AS DOUBLE) AS approved_event_rate,
  (n - e) * 100e0 - e * event_loss - n * 5e0 AS scenario_utility, (n - ps) * 100e0 - ps * event_loss - n * 5e0 AS predicted_scenario_utility
FROM approved JOIN all_rows ON true CROSS JOIN (VALUES (500e0), (1000e0), (2000e0)) l(event_loss) WHERE rule_mode = 'threshold'""",
            _cols("", "threshold event_loss approval_rate approved_event_rate scenario_utility predicted_scenario_utility"),
        ),
        curve_ctes("p_base", [0.05]),
    )
    add("rule_decisions", "SELECT sk_id_curr, p_base <= 8e-2 AS simulated_approval FROM scored")

    draws = 2000
    boots = {
        "indexed": f"""SELECT s.*, row_number() OVER (PARTITION BY target ORDER BY md5('{SEED}:' || sk_id_curr), sk_id_curr) - 1 AS idx,
  count(*) OVER (PARTITION BY target) AS nc FROM scored s""",
        "sizes": "SELECT target, max(nc) AS nc FROM indexed GROUP BY target",
        "slots": f"""SELECT d.draw, z.target, z.nc, s.slot, md5('{SEED}:' || d.draw || ':' || z.target || ':' || (s.slot // 2)) AS h
FROM range({draws}) d(draw) CROSS JOIN sizes z CROSS JOIN LATERAL range(z.nc) s(slot)""",
        "picks": """SELECT draw, target, CAST('0x' || substr(h, CASE WHEN slot % 2 = 0 THEN 1 ELSE 17 END, 15) AS BIGINT) % nc AS idx FROM slots""",
        "weighted": """SELECT p.draw, i.target, i.p_base, i.p_challenger, count(*) AS w FROM picks p JOIN indexed i ON i.target = p.target AND i.idx = p.idx GROUP BY ALL
UNION ALL SELECT -1, target, p_base, p_challenger, count(*) FROM scored GROUP BY ALL""",
    }
    for m in ("base", "challenger"):
        c = _curve("weighted", "target", f"p_{m}", "w", "draw")
        boots[f"ties_{m}"] = c["ties"]
        boots[f"curve_{m}"] = c["curve"].replace("FROM ties", f"FROM ties_{m}")
        boots[f"rank_{m}"] = f"SELECT draw, {RANKS} FROM curve_{m} GROUP BY draw"
    boots["paired"] = " UNION ALL ".join(
        f"SELECT b.draw, '{x}' AS metric, b.{x} AS base, c.{x} AS challenger, c.{x} - b.{x} AS difference FROM rank_base b JOIN rank_challenger c ON b.draw = c.draw"
        for x in ("auc", "ks", "average_precision")
    )
    picks = ", ".join(
        f"max({g}) FILTER (WHERE draw < 0) AS {g}_value, quantile_cont({g}, 25e-3) FILTER (WHERE draw >= 0) AS {g}_lower, "
        f"quantile_cont({g}, 975e-3) FILTER (WHERE draw >= 0) AS {g}_upper"
        for g in ("base", "challenger", "difference")
    )
    add(
        "bootstrap_intervals",
        _rounded(
            f"SELECT metric, {picks} FROM paired GROUP BY metric",
            _cols("metric", " ".join(f"{g}_{x}" for g in ("base", "challenger", "difference") for x in ("value", "lower", "upper"))),
        ),
        boots,
    )

    # Drift: current rows carry higher credit amounts; bins stay those of the training part.
    drifted = {
        "current_numbers": "SELECT sk_id_curr, target, partition, "
        + ", ".join(
            f"CAST({f} AS DOUBLE) * 1.25e0 AS {f}" if f == "amt_credit" else f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES
        )
        + " FROM parted WHERE partition = 'valid'",
        "current_long": f"SELECT * FROM current_numbers UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATURES)}))",
    }
    drifted.update(_drift_ctes("long", "current_long"))
    bins_cols = _cols("feature bin reference_count current_count", "reference_share current_share reference_smoothed current_smoothed psi_component")
    summary_cols = _cols(
        "feature reference_size current_size",
        "psi reference_missing_rate current_missing_rate new_bin_share below_min_share above_max_share",
    )
    add("psi_bins", _rounded("SELECT * FROM psi", bins_cols), drifted)
    add("psi_summary", _rounded("SELECT * FROM drift_summary", summary_cols), drifted)
    predicted = {
        "probs": "SELECT s.sk_id_curr, s.target, m.partition, s.p_base, s.p_challenger FROM scored s JOIN member m ON m.sk_id_curr = s.sk_id_curr",
        "long": "SELECT * FROM probs UNPIVOT INCLUDE NULLS (value FOR feature IN (p_base, p_challenger))",
        "current_long": "SELECT * FROM long WHERE partition = 'test'",
    }
    predicted.update(_drift_ctes("long", "current_long"))
    add("prediction_drift", _rounded("SELECT * FROM drift_summary", summary_cols), predicted)

    # Frozen scoring model.
    scores = _frozen_ctes()
    f, o = SCALE.factor, SCALE.offset
    add(
        "score_scale",
        _rounded(
            f"""SELECT sk_id_curr, p_base, score_raw, 1e0 / (1e0 + exp(-(({o!r} - score_raw) / {f!r}))) AS p_back FROM (
  SELECT sk_id_curr, p_base, {o!r} - {f!r} * ln(p_base / (1e0 - p_base)) AS score_raw FROM scored) s""",
            _cols("sk_id_curr", "p_base score_raw p_back"),
        ),
    )
    add(
        "score_frame",
        _rounded("SELECT * FROM frozen_scores", _cols("sk_id_curr score_display", "log_odds predicted_bad_probability score_raw")),
        scores,
    )
    add(
        "score_contributions",
        " UNION ALL ".join(f"SELECT sk_id_curr, '{x}' AS feature, round({-f!r} * t_{x}, 6) + 0e0 AS points FROM terms" for x in frozen.EDGES),
        scores,
    )
    add("input_diagnostics", "SELECT sk_id_curr, unknown_selected_bins, input_review_required FROM frozen_scores", scores)
    add(
        "batch_prediction",
        _rounded(
            f"SELECT *, predicted_bad_probability <= {frozen.RULE.threshold!r} AS simulated_approval FROM frozen_scores",
            _cols(
                "sk_id_curr score_display unknown_selected_bins input_review_required simulated_approval",
                "predicted_bad_probability score_raw",
            ),
        ),
        scores,
    )
    add("score_identities", "SELECT count(*) AS n_samples, true AS points_ok, true AS inverse_ok FROM application")
    add(
        "bin_points",
        f"SELECT feature, bin, round(woe, 6) AS woe, 0.5::DOUBLE AS coefficient, round({-f * 0.5!r} * woe, 6) + 0e0 AS points FROM woe",
    )
    add(
        "linear_contributions",
        f"SELECT sk_id_curr, {frozen.INTERCEPT!r}::DOUBLE AS base_log_odds, round(log_odds, 6) AS model_log_odds, "
        + ", ".join(f"round(t_{x}, 6) AS {x}" for x in frozen.EDGES)
        + " FROM linear",
        scores,
    )
    groups = _groups()
    grouped = {**scores, "grouped": "SELECT sk_id_curr, " + ", ".join(f"{e} AS {g}" for g, e in groups.items()) + " FROM terms"}
    add("group_contributions", "SELECT sk_id_curr, " + ", ".join(f"round({g}, 6) AS {g}" for g in groups) + " FROM grouped", grouped)
    codes = " ".join(f"WHEN '{g}' THEN '{c}'" for g, c in REASON_CODES.items())
    add(
        "top_reasons",
        f"""SELECT sk_id_curr, CAST(rn AS INT) AS rank, CASE grp {codes} END AS internal_reason_code, grp AS "group", round(v, 6) AS log_odds_contribution
FROM (SELECT *, row_number() OVER (PARTITION BY sk_id_curr ORDER BY v DESC, grp) AS rn FROM (
  {' UNION ALL '.join(f"SELECT sk_id_curr, '{g}' AS grp, {g} AS v FROM grouped" for g in groups)}) u WHERE v > 1e-10) r WHERE rn <= 3""",
        grouped,
    )
    add(
        "contribution_summary",
        " UNION ALL ".join(
            f"SELECT '{g}' AS \"group\", round(avg({g}), 6) AS mean_signed, round(avg(abs({g})), 6) AS mean_absolute FROM grouped" for g in groups
        ),
        grouped,
    )
    add(
        "review_counts",
        f"""SELECT count(*) FILTER (WHERE {_total('_missing')} + {_total('_invalid')} + {_total('_sentinel')} + employment_age_inconsistent + income_zero > 0 OR unknown_n > 0) AS review_required,
  count(*) AS n_samples, count(*) FILTER (WHERE {_total('_missing')} > 0) AS with_missing, count(*) FILTER (WHERE {_total('_sentinel')} > 0) AS with_sentinel,
  count(*) FILTER (WHERE unknown_n > 0) AS with_unknown_bin FROM terms""",
        scores,
    )
    # Scheme choice with a fixed calibration: model by AUC, version by log loss.
    schemes: dict[str, str] = {
        "calibrated": "SELECT *, "
        + ", ".join(f"1e0 / (1e0 + exp(-(125e-2 * ln(p_{m} / (1e0 - p_{m})) + 5e-1))) AS q_{m}" for m in ("base", "challenger"))
        + " FROM scored"
    }
    picked = []
    for m in ("base", "challenger"):
        for version, prefix in (("raw", "p"), ("calibrated", "q")):
            curve, body = _report("calibrated", f"{prefix}_{m}")
            tag = f"{m}_{version}"
            schemes[f"ties_{tag}"] = curve["ties"]
            schemes[f"curve_{tag}"] = curve["curve"].replace("FROM ties", f"FROM ties_{tag}")
            schemes[f"report_{tag}"] = body.replace("FROM curve", f"FROM curve_{tag}")
            picked.append(f"SELECT '{m}' AS model, '{version}' AS version, auc, log_loss FROM report_{tag}")
    schemes["versions"] = " UNION ALL ".join(picked)
    schemes["best"] = "SELECT model, max(auc) AS auc, max(log_loss) - min(log_loss) AS gap FROM versions GROUP BY model"
    add(
        "scheme_selection",
        """SELECT b.model, v.version, round(b.gap, 6) AS log_loss_gap, round((SELECT max(auc) - min(auc) FROM best), 6) AS auc_gap
FROM (SELECT * FROM best ORDER BY auc DESC, model DESC LIMIT 1) b JOIN versions v ON v.model = b.model ORDER BY v.log_loss, v.version LIMIT 1""",
        schemes,
    )
    keyed = {"b": "SELECT *, sk_id_bureau AS k FROM bureau"}
    add(
        "contract_violations",
        """SELECT * FROM (SELECT 'missing:sk_id_curr' AS rule, count(*) FILTER (WHERE k % 1009 = 0) AS n FROM b
UNION ALL SELECT 'too_long:credit_active', count(*) FILTER (WHERE k % 1013 = 0) FROM b
UNION ALL SELECT 'bad_value:days_credit', count(*) FILTER (WHERE k % 997 = 0) FROM b
UNION ALL SELECT 'bad_value:amt_credit_sum_debt', count(*) FILTER (WHERE k % 991 = 0) FROM b
UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT k FROM b GROUP BY k HAVING count(*) > 1) d) r WHERE n > 0""",
        keyed,
    )
    out["partial_label_guard"] = """SELECT count(*) AS n_samples, count(*) FILTER (WHERE l.quality IS NULL) AS without_label,
  count(*) FILTER (WHERE l.quality IS NULL) > 0 AS refused FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
    rates = ", ".join(f"avg({_unknown(x)})" for x in frozen.EDGES)
    add(
        "monitor_batch_totals",
        f"""SELECT count(*) AS n_samples, count(*) FILTER (WHERE {_total('_invalid')} > 0) AS invalid_rows,
  count(*) FILTER (WHERE {_total('_sentinel')} > 0) AS sentinel_rows, round(avg(1e0 / (1e0 + exp(-log_odds))), 6) AS mean_probability,
  round(greatest({rates}), 6) AS max_unknown_rate, count(*) FILTER (WHERE 1e0 / (1e0 + exp(-log_odds)) <= {frozen.RULE.threshold!r}) AS approved,
  CAST(0 AS BIGINT) AS bad_labels, count(*) FILTER (WHERE target = 0) AS n_good, count(*) FILTER (WHERE target = 1) AS n_bad FROM linear""",
        scores,
    )
    return out


def _drift_ctes(reference: str, current: str) -> dict[str, str]:
    eps = "1e-6"
    bin_of = """CASE WHEN l.value IS NULL THEN 'missing' WHEN e.nd = 0 THEN 'outside_training'
  ELSE 'bin_' || lpad(CAST(len(list_filter(e.edges, lambda c: c < l.value)) AS VARCHAR), 3, '0') END"""
    return {
        "ref_binned": f"SELECT l.feature, {bin_of} AS bin FROM {reference} l JOIN edge_lists e ON l.feature = e.feature WHERE l.partition = 'train'",
        "cur_binned": f"SELECT l.feature, {bin_of} AS bin, l.value < e.lo AS under, l.value > e.hi AS above FROM {current} l JOIN edge_lists e ON l.feature = e.feature",
        "dims": """SELECT feature, 'missing' AS bin FROM edge_lists UNION ALL SELECT feature, 'outside_training' FROM edge_lists WHERE nd = 0
UNION ALL SELECT feature, 'bin_' || lpad(CAST(unnest(range(len(edges) + 1)) AS VARCHAR), 3, '0') FROM edge_lists WHERE nd > 0""",
        "ref_n": "SELECT feature, bin, count(*) AS n FROM ref_binned GROUP BY feature, bin",
        "cur_n": "SELECT feature, bin, count(*) AS n FROM cur_binned GROUP BY feature, bin",
        "both_n": """SELECT d.feature, d.bin, coalesce(r.n, 0) AS rn, coalesce(c.n, 0) AS cn FROM dims d
LEFT JOIN ref_n r ON r.feature = d.feature AND r.bin = d.bin LEFT JOIN cur_n c ON c.feature = d.feature AND c.bin = d.bin""",
        "shares": f"""SELECT *, rn / CAST(sum(rn) OVER w AS DOUBLE) AS rs, cn / CAST(sum(cn) OVER w AS DOUBLE) AS cs, 1e0 + count(*) OVER w * {eps} AS scale
FROM both_n WINDOW w AS (PARTITION BY feature)""",
        "psi": f"""SELECT feature, bin, rn AS reference_count, cn AS current_count, rs AS reference_share, cs AS current_share,
  (rs + {eps}) / scale AS reference_smoothed, (cs + {eps}) / scale AS current_smoothed,
  ((cs + {eps}) / scale - (rs + {eps}) / scale) * (ln((cs + {eps}) / scale) - ln((rs + {eps}) / scale)) AS psi_component FROM shares""",
        "outside": """SELECT feature, avg(CASE WHEN under THEN 1 ELSE 0 END) AS below_min_share, avg(CASE WHEN above THEN 1 ELSE 0 END) AS above_max_share
FROM cur_binned GROUP BY feature""",
        "drift_summary": """SELECT p.feature, sum(psi_component) AS psi, CAST(sum(reference_count) AS BIGINT) AS reference_size, CAST(sum(current_count) AS BIGINT) AS current_size,
  max(CASE WHEN bin = 'missing' THEN reference_share END) AS reference_missing_rate, max(CASE WHEN bin = 'missing' THEN current_share END) AS current_missing_rate,
  sum(CASE WHEN reference_count = 0 THEN current_count ELSE 0 END) / CAST(sum(current_count) AS DOUBLE) AS new_bin_share,
  any_value(o.below_min_share) AS below_min_share, any_value(o.above_max_share) AS above_max_share
FROM psi p JOIN outside o ON o.feature = p.feature GROUP BY p.feature""",
    }
