"""What every query has to return, as plain SQL over the given tables.

Written from the definitions, not from the jobs: ranks over whole tables, pair joins and unbounded
windows are fine here.
"""

from __future__ import annotations

EVENTS = ("click", "error", "purchase", "signup", "view")


def _draw(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296e0)"


RISK = f"""risk AS (
  SELECT event_id AS row_id, value AS x_num, event_type AS x_cat, CAST(user_id % 2 AS INTEGER) AS x_bin,
    CAST({_draw("'42|t|' || event_id")} <
      1e-2 + least(value, 2e2) / 2e2 * 12e-2 + CASE WHEN event_type = 'error' THEN 5e-2 ELSE 0e0 END
    AS INTEGER) AS target
  FROM events)"""

DOCS = """docs AS (
  SELECT doc_id, n_chars, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id))"""

ORD = f"""ord AS (
  SELECT o_orderkey, o_totalprice, c_acctbal, o_orderpriority, c_mktsegment,
    CAST(year(o_orderdate) >= 1997 AS INTEGER) AS late_year,
    CAST({_draw("'42|t|' || o_orderkey")} <
      1e-2 + least(o_totalprice, 4e5) / 4e5 * 3e-2 + CASE WHEN c_acctbal < 0 THEN 4e-2 ELSE 0e0 END
    AS INTEGER) AS target
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

DIRTY = """dirty AS (
  SELECT event_id, event_type,
    CASE WHEN event_id % 25 = 0 THEN NULL WHEN event_id % 40 = 1 THEN -value ELSE value END AS value,
    CASE WHEN event_id % 50 = 2 THEN 5 WHEN event_id % 50 = 3 THEN NULL
      ELSE CAST(user_id % 2 AS INTEGER) END AS flag
  FROM events, (VALUES (1), (2)) copies(copy)
  WHERE copy = 1 OR event_id % 100 = 4)"""

SCORED = f"""{RISK}, scored AS (
  SELECT row_id, x_cat, x_bin, target AS label,
    CAST(('0x' || substr(md5('42|g|' || row_id), 1, 4))::BIGINT % 5 AS INTEGER) AS fold,
    round(5e-1 * {_draw("'42|s|' || row_id")} + 5e-1 * least(x_num, 2e2) / 2e2, 2) AS score
  FROM risk)"""


def _split(rows: str, key: str, target: str) -> str:
    """Test part: the first rows of each class in digest order, up to the class's share."""
    return f"""
  classes AS (SELECT {target} AS label, count(*) AS n FROM {rows} GROUP BY 1),
  sizes AS (SELECT sum(n) AS total, sum(n) - ceil(2e-1 * sum(n) - 1e-9) AS n_train FROM classes),
  shares AS (
    SELECT label, n, floor(n * n_train / total) AS base, n * n_train / total - floor(n * n_train / total) AS rest,
      n_train FROM classes, sizes),
  quotas AS (
    SELECT label, n - (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
      <= n_train - (SELECT sum(base) FROM shares) THEN 1 ELSE 0 END) AS n_test FROM shares),
  parted AS (
    SELECT r.*, CASE WHEN row_number() OVER (
        PARTITION BY {target} ORDER BY md5('42|split|' || {key}) || '|' || {key}) <= n_test
      THEN 'test' ELSE 'train' END AS split
    FROM {rows} r JOIN quotas ON {target} = label)"""


RISK_SPLIT = f"{RISK}, {_split('risk', 'row_id', 'target')}"

RATES = """
  round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1_score,
  round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity,
  round(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END, 6) AS npv"""


def _counts(threshold: str, op: str = ">=") -> str:
    return f"""
  count(*) FILTER (label = 0 AND NOT score {op} {threshold}) AS tn,
  count(*) FILTER (label = 0 AND score {op} {threshold}) AS fp,
  count(*) FILTER (label = 1 AND NOT score {op} {threshold}) AS fn,
  count(*) FILTER (label = 1 AND score {op} {threshold}) AS tp"""


SWEEP = f"""{SCORED}, thresholds(threshold) AS (
    VALUES (10e-2), (15e-2), (20e-2), (25e-2), (30e-2), (35e-2), (40e-2), (45e-2), (50e-2), (55e-2), (60e-2),
      (65e-2), (70e-2)),
  swept AS (SELECT threshold, {_counts('threshold')} FROM scored, thresholds GROUP BY threshold),
  sweep AS (SELECT threshold, tn, fp, fn, tp, {RATES} FROM swept)"""

# The proposed threshold, from the unrounded rates.
PROPOSED = """proposed AS (
  SELECT threshold FROM swept ORDER BY (tp / (tp + fn) >= 6e-1) DESC,
    CASE WHEN tp / (tp + fn) >= 6e-1 THEN 2 * tp / (2 * tp + fp + fn) ELSE tp / (tp + fn) END DESC, threshold
  LIMIT 1)"""

ABOVE = """steps AS (
    SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY score),
  totals AS (
    SELECT score, pos, neg, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
      sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
    FROM steps WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""

RANKING = f"""{ABOVE}, ranking AS (
    SELECT sum(neg * (cum_pos - pos / 2)) / (max(all_pos) * max(all_neg)) AS roc_auc,
      sum(pos * cum_pos / (cum_pos + cum_neg)) / max(all_pos) AS average_precision FROM totals)"""


def _group_auc(by: str) -> str:
    """ROC-AUC per group as the share of (positive, negative) pairs in the right order."""
    return f"""
  group_steps AS (
    SELECT {by}, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
    FROM scored GROUP BY ALL),
  group_cum AS (
    SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
      sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg FROM group_steps),
  group_auc AS (
    SELECT {by},
      CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
        sum(neg * (cum_pos - pos / 2)) / (sum(pos) * sum(neg)) END AS roc_auc,
      CASE WHEN sum(pos) > 0 THEN sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos) ELSE 0 END AS average_precision
    FROM group_cum GROUP BY {by})"""


FOLDS = f"""{SCORED}, {_group_auc('x_cat, x_bin, fold')},
  fold_counts AS (SELECT x_cat, x_bin, fold, {_counts('5e-1', '>')} FROM scored GROUP BY ALL),
  folds AS (
    SELECT x_cat AS model, 's' || x_bin AS strategy, fold,
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
      CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
      CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, roc_auc
    FROM fold_counts JOIN group_auc USING (x_cat, x_bin, fold)),
  cv AS (
    SELECT model, strategy, avg(recall) AS mean_recall, stddev_pop(recall) AS std_recall,
      avg(precision) AS mean_precision, avg(f1) AS mean_f1, avg(roc_auc) AS mean_roc_auc
    FROM folds GROUP BY ALL)"""

CV_COLUMNS = """model, strategy, round(mean_recall, 6) AS mean_recall, round(std_recall, 6) AS std_recall,
  round(mean_precision, 6) AS mean_precision, round(mean_f1, 6) AS mean_f1, round(mean_roc_auc, 6) AS mean_roc_auc"""


def _select(floor: str) -> str:
    return f"""WITH {FOLDS}, numbered AS (
    SELECT *, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], model) * 2
      + CAST(substr(strategy, 2, 1) AS INTEGER) AS INTEGER) AS seq, mean_recall >= {floor} AS usable FROM cv)
  SELECT {CV_COLUMNS}, seq, CASE WHEN usable
    THEN 'selected from CV rows with mean_recall >= {floor}, ranked by mean F1'
    ELSE 'no strategy reached mean_recall >= {floor} in CV, so the highest-recall row was used as a fallback' END
    AS selection_note
  FROM numbered ORDER BY usable DESC, CASE WHEN usable THEN mean_f1 ELSE mean_recall END DESC, mean_roc_auc DESC, seq
  LIMIT 1"""


def _neighbours(rows: str, key: str, numeric: list[str], nominal: list[str]) -> str:
    """All pairs of minority rows, the five closest kept."""
    spreads = ", ".join(f"(stddev_pop({c}))" for c in numeric)
    square = " + ".join(f"(a.{c}::DOUBLE - b.{c}::DOUBLE) * (a.{c}::DOUBLE - b.{c}::DOUBLE)" for c in numeric)
    wrong = " + ".join(f"CAST(a.{c} <> b.{c} AS INTEGER)" for c in nominal)
    near = ", ".join(f"b.{c} AS near_{c}" for c in (*numeric, *nominal))
    return f"""
  minority AS (SELECT * FROM {rows}),
  spread AS (SELECT round(list_aggregate([{spreads}], 'median'), 6) AS s FROM minority),
  pairs AS (
    SELECT a.{key} AS base_key, b.{key} AS near_key, {near}, ({square}) + s * s * ({wrong}) AS dist
    FROM minority a, minority b, spread WHERE a.{key} <> b.{key}),
  nearest AS (
    SELECT *, row_number() OVER (PARTITION BY base_key ORDER BY dist, near_key) AS nth FROM pairs
    QUALIFY nth <= 5)"""


def _smotenc(rows: str, majority: str, key: str, numeric: list[str], nominal: list[str]) -> str:
    modes = "".join(
        f""",
  mode_{c} AS (
    SELECT base_key, near_{c} AS {c} FROM (
      SELECT base_key, near_{c}, row_number() OVER (PARTITION BY base_key ORDER BY count(*) DESC, near_{c}) AS r
      FROM nearest GROUP BY base_key, near_{c}) WHERE r = 1)"""
        for c in nominal
    )
    joins = " ".join(f"JOIN mode_{c} USING (base_key)" for c in nominal)
    gap = _draw("'42|gap|' || d.base_key || '|' || d.copy")
    values = ", ".join(
        f"round(m.{c} + {gap} * (n.near_{c}::DOUBLE - m.{c}), 6) AS {c}" for c in numeric
    )
    return f"""{_neighbours(rows, key, numeric, nominal)},
  amount AS (
    SELECT n_min, CAST(floor(5e-1 * n_maj - n_min) AS BIGINT) AS n_new FROM
      (SELECT count(*) AS n_min FROM minority), (SELECT count(*) AS n_maj FROM {majority})),
  copies AS (
    SELECT {key} AS base_key, n_new // n_min + CASE WHEN row_number() OVER (
      ORDER BY md5('42|base|' || {key}) || '|' || {key}) <= n_new % n_min THEN 1 ELSE 0 END AS copies
    FROM minority, amount),
  drawn AS (SELECT base_key, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM copies){modes}
  SELECT d.base_key, d.copy, {values}, {", ".join(f"mode_{c}.{c}" for c in nominal)}
  FROM drawn d JOIN minority m ON m.{key} = d.base_key
    JOIN nearest n ON n.base_key = d.base_key
      AND n.nth = floor({_draw("'42|nbr|' || d.base_key || '|' || d.copy")} * 5) + 1
    {" ".join(f"JOIN mode_{c} ON mode_{c}.base_key = d.base_key" for c in nominal)}"""


def _describe(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS column, count({column}) AS count, round(avg({column}), 6) AS mean,
    round(stddev_samp({column}), 6) AS std, round(min({column})::DOUBLE, 6) AS min,
    round(quantile_cont({column}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({column}::DOUBLE, 0.5), 6) AS q50,
    round(quantile_cont({column}::DOUBLE, 0.75), 6) AS q75, round(max({column})::DOUBLE, 6) AS max FROM {source}"""


def _describe_mixed(source: str, column: str) -> str:
    return f"""SELECT "column", count, NULL::BIGINT AS n_unique, NULL::VARCHAR AS top, NULL::BIGINT AS freq,
    mean, std, min, q25, q50, q75, max FROM ({_describe(source, column)})"""


def _value_counts(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, {c}::VARCHAR AS value, count(*) AS n FROM {source} GROUP BY {c}" for c in columns
    )


def _nulls(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count(*) - count({c}) AS n_missing,
        round((count(*) - count({c})) / count(*) * 100, 2) AS pct_missing FROM {source}""" for c in columns
    )


def _schema(source: str, columns, types) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column, '{t}' AS dtype, count({c}) AS non_null,
        (SELECT {c}::VARCHAR FROM {source} WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 1) AS example FROM {source}"""
        for c, t in zip(columns, types, strict=True)
    )


def _histogram(source: str, column: str) -> str:
    return f"""lim AS (SELECT min({column}) AS lo, max({column}) AS hi, (max({column}) - min({column})) / 30 AS w
    FROM {source}),
  bins AS (SELECT CAST(unnest(range(0, 30)) AS INTEGER) AS bin),
  hit AS (SELECT least(CAST(floor(({column} - lo) / w) AS INTEGER), 29) AS bin, count(*) AS n
    FROM {source}, lim WHERE {column} IS NOT NULL GROUP BY 1)
  SELECT bin, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi, coalesce(n, 0) AS n
  FROM bins LEFT JOIN hit USING (bin), lim"""


DIRTY_CHECKS = (
    ("value", "at_most", "value <= 0", "'value <= 0 found in ' || n || ' rows'"),
    ("value", "below", "value < 0", "'negative value found in ' || n || ' rows'"),
    ("flag", "not_in", "flag IS NULL OR flag NOT IN (0, 1)", "'flag has ' || n || ' values outside {0,1}'"),
    (
        "event_type", "not_in",
        "event_type IS NULL OR event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view')",
        "'event_type has ' || n || ' values outside {click,error,purchase,signup,view}'",
    ),
)
ORDER_CHECKS = (
    ("o_totalprice", "at_most", "o_totalprice <= 0", "'o_totalprice <= 0 found in ' || n || ' rows'"),
    ("c_acctbal", "below", "c_acctbal < 0", "'negative c_acctbal found in ' || n || ' rows'"),
    ("late_year", "not_in", "late_year NOT IN (0, 1)", "'late_year has ' || n || ' values outside {0,1}'"),
)


def _rules(source: str, checks) -> str:
    counted = " UNION ALL ".join(
        f"""SELECT {i} AS seq, '{c}' AS column, '{kind}' AS rule, n, {message} AS message
        FROM (SELECT count(*) FILTER ({cond}) AS n FROM {source})"""
        for i, (c, kind, cond, message) in enumerate(checks)
    )
    return f"counted AS ({counted})"


VIOLATIONS = """SELECT seq, "column", n, message FROM counted WHERE n > 0
  UNION ALL SELECT -1, NULL, 0, 'No invalid/impossible values detected in the checked columns.'
  WHERE NOT EXISTS (SELECT 1 FROM counted WHERE n > 0)"""

LINES = """lines AS (
  SELECT event_id AS row_id, CASE event_id % 20
    WHEN 0 THEN '{"x_cat":' || t || ',"x_bin":' || f || '}'
    WHEN 1 THEN '{"x_num":' || v || ',"x_cat":"","x_bin":' || f || '}'
    WHEN 2 THEN '{"x_num":"' || v || '","x_cat":' || t || ',"x_bin":' || f || '}'
    WHEN 3 THEN '{"x_num":' || v || ',"x_cat":' || t || ',"x_bin":'
      || CASE WHEN user_id % 2 = 1 THEN 'true' ELSE 'false' END || '}'
    WHEN 4 THEN '{"x_num":-5,"x_cat":"vapes","x_bin":7}'
    WHEN 5 THEN '{"x_num":' || v || ',"x_cat":"Unknown123","x_bin":' || f || '}'
    WHEN 6 THEN '{bad'
    WHEN 7 THEN '[1]'
    WHEN 8 THEN 'null'
    WHEN 9 THEN '"x"'
    WHEN 10 THEN '{"x_num":' || v || ',"x_cat":' || t || ',"x_bin":' || f || ',"extra":[1,2]}'
    WHEN 11 THEN '{"x_num":"abc","x_cat":' || t || ',"x_bin":"yes"}'
    WHEN 12 THEN '{"x_num":null,"x_cat":null,"x_bin":' || f || '}'
    ELSE '{"x_num":' || v || ',"x_cat":' || t || ',"x_bin":' || f || '}' END AS body
  FROM (SELECT *, value::VARCHAR AS v, (user_id % 2)::VARCHAR AS f, '"' || event_type || '"' AS t FROM events))"""

CHECKED = LINES + """, shaped AS (
  SELECT row_id, body, CASE WHEN json_valid(body) THEN json_type(body) END AS kind FROM lines),
fields AS (
  SELECT *, CASE WHEN kind = 'OBJECT' THEN body->>'$.x_num' END AS num, CASE WHEN kind = 'OBJECT' THEN
    body->>'$.x_cat' END AS cat, CASE WHEN kind = 'OBJECT' THEN body->>'$.x_bin' END AS bin FROM shaped),
typed AS (
  SELECT *, TRY_CAST(num AS DOUBLE) AS x_num, cat AS x_cat,
    CASE bin WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE TRY_CAST(bin AS INTEGER) END AS x_bin FROM fields),
messages AS (
  SELECT *,
      CASE WHEN coalesce(num, '') = '' THEN 'Missing required field: ''x_num''' END AS m1,
      CASE WHEN coalesce(cat, '') = '' THEN 'Missing required field: ''x_cat''' END AS m2,
      CASE WHEN coalesce(bin, '') = '' THEN 'Missing required field: ''x_bin''' END AS m3,
      CASE WHEN x_num IS NULL THEN 'Invalid x_num: ' || num || '. Must be a number.'
        WHEN x_num NOT BETWEEN 0 AND 400 THEN 'Invalid x_num: ' || num || '. Must be between 0 and 400.' END AS w1,
      CASE WHEN x_bin IS NULL OR x_bin NOT IN (0, 1) THEN 'Invalid x_bin: ' || bin || '. Must be 0 or 1.' END AS w2,
      CASE WHEN cat NOT IN ('click', 'error', 'purchase', 'signup', 'view') THEN 'Invalid x_cat: ''' || cat
        || '''. Must be one of: [''click'', ''error'', ''purchase'', ''signup'', ''view'']' END AS w3
  FROM typed),
checked AS (
  SELECT row_id, body, x_num, x_cat, x_bin,
    CASE WHEN kind IS NULL OR kind = 'NULL' THEN 'Request body must be valid JSON.'
      WHEN kind <> 'OBJECT' THEN 'Request body must be a JSON object.'
      WHEN coalesce(m1, m2, m3) IS NOT NULL THEN concat_ws(' | ', m1, m2, m3)
      ELSE concat_ws(' | ', w1, w2, w3) END AS errors,
    CASE WHEN kind IS NULL OR kind = 'NULL' THEN 'Request body must be valid JSON.'
      WHEN kind <> 'OBJECT' THEN 'Request body must be a JSON object.'
      ELSE coalesce(m1, m2, m3, w1, w2, w3) END AS first_error
  FROM messages),
weighed AS (
  SELECT *, 1 / (1 + exp(-(-8e-1 + (x_num - 5e1) / 6e1 * 45e-2
    + CASE x_cat WHEN 'click' THEN -1e-1 WHEN 'error' THEN 55e-2 WHEN 'purchase' THEN 2e-1 WHEN 'signup' THEN -25e-2
      WHEN 'view' THEN 5e-2 ELSE 0 END + x_bin * 3e-1))) AS p, errors = '' AS valid
  FROM checked),
outputs AS (
  SELECT row_id, body, CASE WHEN valid THEN round(p, 4) END AS risk_score,
    CASE WHEN valid THEN CAST(p >= 5e-1 AS INTEGER) END AS prediction,
    CASE WHEN valid THEN CASE WHEN p < 3e-1 THEN 'LOW' WHEN p < 5e-1 THEN 'MODERATE' ELSE 'HIGH' END END
      AS risk_category,
    CASE WHEN valid THEN 5e-1 END AS threshold_used, valid, errors, first_error FROM weighed)"""


# The response record of a checked and scored row.
RESPONSE = """CASE WHEN valid THEN '{"success":true,"data":{"risk_score":'
              || risk_score || ',"risk_percentage":' || round(risk_score * 100, 2) || ',"prediction":' || prediction
              || ',"predicted_class":"' || CASE prediction WHEN 1 THEN 'Higher risk' ELSE 'Lower risk' END
              || '","risk_category":"' || risk_category || '","threshold":0.5},"disclaimer":"'
              || 'This is an educational risk screening prediction and not a medical diagnosis."}'
            ELSE '{"success":false,"error":{"code":"VALIDATION_ERROR","message":"' || first_error || '"}}' END
           """


# Training rows with their fold, dealt out as kfold_assignment does.
TRAIN_FOLDS = f"""{RISK_SPLIT}, train AS (SELECT row_id, target FROM parted WHERE split = 'train'),
  dealt AS (SELECT target, (row_number() OVER (ORDER BY target) - 1) % 5 AS fold FROM train),
  fold_sizes AS (SELECT target, fold, count(*) AS n FROM dealt GROUP BY ALL),
  ends AS (SELECT target, fold, sum(n) OVER w AS upto, sum(n) OVER w - n AS after FROM fold_sizes
    WINDOW w AS (PARTITION BY target ORDER BY fold ROWS UNBOUNDED PRECEDING)),
  ranked AS (SELECT row_id, target, row_number() OVER (PARTITION BY target
    ORDER BY md5('42|fold|' || row_id) || '|' || row_id) AS r FROM train),
  folded AS (SELECT row_id, CAST(fold AS INTEGER) AS fold, r.target
    FROM ranked r JOIN ends e ON r.target = e.target AND r.r > e.after AND r.r <= e.upto)"""


def _newton(steps: int = 10) -> str:
    """Out-of-fold scores of logistic regressions: Newton's method, its systems solved by elimination."""
    cells = ["1e0", "(x_num - mean) / dev", *[f"CAST(x_cat = '{v}' AS DOUBLE)" for v in EVENTS], "CAST(x_bin AS DOUBLE)"]
    d = range(len(cells))
    linear = " + ".join(f"b{i} * c{i}" for i in d)
    parts = [f"""scaled AS (
    SELECT held.fold, avg(x_num) AS mean, stddev_pop(x_num) AS dev, count(*) FILTER (target = 0) AS n0,
      count(*) FILTER (target = 1) AS n1
    FROM (SELECT DISTINCT fold FROM folded) held, folded f JOIN risk r USING (row_id, target)
    WHERE f.fold <> held.fold GROUP BY 1),
  kinds(strategy) AS (VALUES ('baseline'), ('class_weight')),
  design AS MATERIALIZED (
    SELECT s.fold, strategy, row_id, f.fold AS own, r.target AS y,
      CASE strategy WHEN 'baseline' THEN 1e0 ELSE (n0 + n1) / (2e0 * CASE r.target WHEN 1 THEN n1 ELSE n0 END) END AS w,
      {", ".join(f"{c} AS c{i}" for i, c in enumerate(cells))}
    FROM folded f JOIN risk r USING (row_id) CROSS JOIN scaled s CROSS JOIN kinds),
  at0 AS (SELECT DISTINCT fold, strategy, {", ".join(f"0e0 AS b{i}" for i in d)} FROM design)"""]
    n = len(cells)
    for k in range(steps):
        gram = [
            f"sum(w * p * (1 - p) * c{i} * c{j})" + " + 1" * (i == j > 0) + f" AS a{i}_{j}" for i in d for j in d
        ]
        gradient = [f"sum(w * (p - y) * c{i})" + f" + any_value(b{i})" * (i > 0) + f" AS a{i}_{n}" for i in d]
        kept = ", ".join(["fold", "strategy", *[f"b{i}" for i in d]])
        parts.append(f"""sums{k}_0 AS MATERIALIZED (
    SELECT fold, strategy, {", ".join(f"any_value(b{i}) AS b{i}" for i in d)}, {", ".join(gram + gradient)}
    FROM (SELECT *, 1 / (1 + exp(-({linear}))) AS p FROM design JOIN at{k} USING (fold, strategy) WHERE own <> fold)
    GROUP BY ALL)""")
        for e in d:
            cleared = [
                f"a{e}_{j} / a{e}_{e} AS a{e}_{j}" if i == e else f"a{i}_{j} - a{i}_{e} * a{e}_{j} / a{e}_{e} AS a{i}_{j}"
                for i in d for j in range(e + 1, n + 1)
            ]
            parts.append(f"sums{k}_{e + 1} AS MATERIALIZED (SELECT {kept}, {', '.join(cleared)} FROM sums{k}_{e})")
        parts.append(f"""at{k + 1} AS MATERIALIZED (
    SELECT fold, strategy, {", ".join(f"b{i} - a{i}_{n} AS b{i}" for i in d)} FROM sums{k}_{n})""")
    parts.append(f"""scored_folds AS (
    SELECT row_id, fold, strategy, y AS label, 1 / (1 + exp(-({linear}))) AS score
    FROM design JOIN at{steps} USING (fold, strategy) WHERE own = fold)""")
    return ",\n  ".join(parts)


def oracle_sql() -> dict[str, str]:
    scored_counts = f"SELECT {_counts('5e-1')} FROM scored"
    dirty_columns = ["event_id", "event_type", "value", "flag"]
    sql = {
        "null_report": f"WITH {DIRTY} {_nulls('dirty', dirty_columns)}",
        "null_report_documents": _nulls("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
        "dup_report": f"""WITH {DIRTY} SELECT count(*) AS n_rows,
            count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS row_duplicates,
            count(*) - count(DISTINCT event_id) AS key_duplicates FROM dirty""",
        "dup_documents": """SELECT count(*) AS n_rows,
            count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS row_duplicates,
            count(*) - count(DISTINCT text) AS key_duplicates FROM documents""",
        "value_counts": f"WITH {DIRTY} {_value_counts('dirty', ['event_type', 'flag'])}",
        "value_counts_orders": _value_counts("orders", ["o_orderstatus", "o_orderpriority"]),
        "describe_numeric": f"WITH {DIRTY} {_describe('dirty', 'value')}",
        "describe_orders": f"WITH {ORD} {_describe('ord', 'o_totalprice')} UNION ALL {_describe('ord', 'c_acctbal')}",
        "describe_mixed": f"""WITH {DIRTY}, types AS (SELECT event_type AS v, count(*) AS n FROM dirty GROUP BY 1)
            {" UNION ALL ".join(_describe_mixed('dirty', c) for c in ('event_id', 'value', 'flag'))}
            UNION ALL SELECT 'event_type', CAST(sum(n) AS BIGINT), count(*),
              (SELECT v FROM types ORDER BY n DESC, v LIMIT 1), max(n), NULL, NULL, NULL, NULL, NULL, NULL, NULL
            FROM types""",
        "schema_report": f"WITH {DIRTY} {_schema('dirty', dirty_columns, ('bigint', 'string', 'double', 'int'))}",
        # Whole numbers with missing cells are read as doubles.
        "csv_inferred": f"""WITH {DIRTY}, typed AS (SELECT * REPLACE (flag::DOUBLE AS flag) FROM dirty)
            {_schema('typed', dirty_columns, ('bigint', 'string', 'double', 'double'))}""",
        "table_shape": f"""WITH {DIRTY} SELECT count(*) AS n_rows, 4 AS n_columns,
            'event_id,event_type,value,flag' AS columns FROM dirty""",
        "role_inference": f"""WITH {DIRTY} {" UNION ALL ".join(
            f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_unique, CASE WHEN {num} AND count(DISTINCT {c}) > 2 "
            f"THEN 'numeric' WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE 'categorical' END AS role FROM dirty"
            for c, num in (('value', 'true'), ('flag', 'true'), ('event_type', 'false')))}""",
        "quality_summary": f"""WITH {DIRTY}, {_rules('dirty', DIRTY_CHECKS)} SELECT count(*) AS n_rows, 4 AS n_columns,
            count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS row_duplicates,
            4 * count(*) - count(event_id) - count(event_type) - count(value) - count(flag) AS missing_cells,
            CAST((SELECT count(*) FROM counted WHERE n > 0) AS INTEGER) AS failing_rules,
            count(*) FILTER (flag = 0) AS class_0, count(*) FILTER (flag = 1) AS class_1,
            round(count(*) FILTER (flag = 1) / count(*) * 100, 2) AS class_1_pct FROM dirty""",
        "rule_counts": f"WITH {DIRTY}, {_rules('dirty', DIRTY_CHECKS)} SELECT * FROM counted",
        "rule_violations": f"WITH {DIRTY}, {_rules('dirty', DIRTY_CHECKS)} {VIOLATIONS}",
        "rule_violations_orders": f"WITH {ORD}, {_rules('ord', ORDER_CHECKS)} {VIOLATIONS}",
        "domain_violations": f"""WITH {DIRTY} SELECT *, 'flag' AS broken_column FROM dirty
            WHERE flag IS NULL OR flag NOT IN (0, 1)""",
        "numeric_extremes": f"""WITH {DIRTY} SELECT 'value' AS column, min(value) AS min, max(value) AS max FROM dirty
            UNION ALL SELECT 'flag', min(flag)::DOUBLE, max(flag)::DOUBLE FROM dirty""",
        "head_tail": f"""WITH {DIRTY}
            SELECT * FROM (SELECT *, 'head' AS part FROM dirty ORDER BY event_id LIMIT 5)
            UNION ALL SELECT * FROM (SELECT *, 'tail' AS part FROM dirty ORDER BY event_id DESC LIMIT 5)""",
        "domain_discovery": f"""WITH {DIRTY} SELECT DISTINCT 'event_type' AS column, event_type AS value FROM dirty
            UNION ALL SELECT DISTINCT 'flag', flag::VARCHAR FROM dirty WHERE flag IS NOT NULL""",
        "histogram": f"WITH {DIRTY}, {_histogram('dirty', 'value')}",
        "histogram_orders": f"WITH {_histogram('orders', 'o_totalprice')}",
        "csv_roundtrip": f"WITH {DIRTY} SELECT * FROM dirty",
        "clean_table": f"WITH {DIRTY} SELECT event_id, event_type, value FROM (SELECT DISTINCT * FROM dirty)",
        "clean_report": f"""WITH {DIRTY}
            SELECT 'value' AS column, NULL AS value, count(*) FILTER (value IS NULL) AS n FROM dirty
            UNION ALL SELECT 'event_type', 'error', count(*) FILTER (event_type = 'error') FROM dirty
            UNION ALL SELECT 'event_type', 'view', count(*) FILTER (event_type = 'view') FROM dirty
            UNION ALL SELECT 'flag', '5', count(*) FILTER (flag = 5) FROM dirty""",
        "rows_with_value": f"""WITH {DIRTY} SELECT event_type, count(*) AS n, count(flag) AS n_flag FROM dirty
            WHERE value IS NOT NULL GROUP BY 1""",
        "class_distribution": f"""WITH {RISK} {" UNION ALL ".join(
            f"SELECT {c} AS label, count(*) FILTER (target = {c}) AS n, "
            f"round(count(*) FILTER (target = {c}) / count(*) * 100, 2) AS pct FROM risk" for c in (0, 1))}""",
        "majority_baseline": f"""WITH {RISK} SELECT CASE WHEN sum(target) * 2 > count(*) THEN 1 ELSE 0 END
            AS majority_class, round(greatest(sum(target), count(*) - sum(target)) / count(*), 6) AS accuracy,
            CASE WHEN sum(target) * 2 > count(*) THEN 1e0 ELSE 0e0 END AS recall,
            round(greatest(sum(target), count(*) - sum(target)) / count(*) * 100, 2) AS accuracy_pct FROM risk""",
        "class_weights": f"""WITH {RISK}, c AS (SELECT target AS label, count(*) AS n FROM risk GROUP BY 1),
            w AS (SELECT label, n, sum(n) OVER () / (2 * n) AS weight FROM c)
            SELECT label, n, round(weight, 6) AS weight, round(weight / min(weight) OVER (), 6) AS ratio FROM w""",
        "class_weight_map": f"""WITH {RISK} SELECT round(count(*) / (2 * count(*) FILTER (target = 0)), 6) AS weight_0,
            round(count(*) / (2 * count(*) FILTER (target = 1)), 6) AS weight_1 FROM risk""",
        "positive_weight": f"""WITH {RISK} SELECT count(*) FILTER (target = 0) AS negatives,
            count(*) FILTER (target = 1) AS positives,
            round(count(*) FILTER (target = 0) / count(*) FILTER (target = 1), 6) AS positive_weight FROM risk""",
        "sample_weights": f"""WITH {RISK}, c AS (SELECT target, count(*) AS n FROM risk GROUP BY 1)
            SELECT row_id, target, round((SELECT count(*) FROM risk) / (2 * n), 6) AS weight
            FROM risk JOIN c USING (target)""",
        "sample_weights_positive": f"""WITH {DOCS} SELECT doc_id, toxic, CASE WHEN toxic = 1 THEN round(
            (SELECT count(*) FILTER (toxic = 0) / count(*) FILTER (toxic = 1) FROM docs), 6) ELSE 1e0 END AS weight
            FROM docs""",
        "stratified_split": f"WITH {RISK_SPLIT} SELECT row_id, target, split FROM parted",
        "split_documents": f"WITH {DOCS}, {_split('docs', 'doc_id', 'toxic')} SELECT doc_id, toxic, split FROM parted",
        "split_distribution": f"""WITH {RISK_SPLIT} SELECT split, target AS label, count(*) AS n,
            round(count(*) / sum(count(*)) OVER (PARTITION BY split) * 100, 2) AS pct FROM parted GROUP BY 1, 2""",
        "split_integrity": f"""WITH {RISK_SPLIT} SELECT count(*) FILTER (split = 'train') AS train_rows,
            count(*) FILTER (split = 'test') AS test_rows,
            count(*) FILTER (split = 'train' AND target = 1) AS train_positives,
            count(*) FILTER (split = 'test' AND target = 1) AS test_positives,
            (SELECT count(*) FROM risk) AS rows_before, (SELECT count(*) FILTER (target = 1) FROM risk)
            AS positives_before, 0::BIGINT AS shared_keys, 0::BIGINT AS bad_keys, true AS ok FROM parted""",
        "kfold_assignment": f"""WITH {RISK}, dealt AS (
              SELECT target, (row_number() OVER (ORDER BY target) - 1) % 5 AS fold FROM risk),
            sizes AS (SELECT target, fold, count(*) AS n FROM dealt GROUP BY ALL),
            ends AS (SELECT target, fold, sum(n) OVER w AS upto, sum(n) OVER w - n AS after FROM sizes
              WINDOW w AS (PARTITION BY target ORDER BY fold ROWS UNBOUNDED PRECEDING)),
            ranked AS (SELECT row_id, target, row_number() OVER (PARTITION BY target
              ORDER BY md5('42|fold|' || row_id) || '|' || row_id) AS r FROM risk)
            SELECT row_id, r.target, CAST(fold AS INTEGER) AS fold FROM ranked r JOIN ends e
              ON r.target = e.target AND r.r > e.after AND r.r <= e.upto""",
        "smotenc_rows": f"""WITH {RISK}, {_smotenc("risk WHERE target = 1", "risk WHERE target = 0", "row_id",
            ["x_num"], ["x_cat", "x_bin"])}""",
        "smotenc_documents": f"""WITH {DOCS}, {_smotenc("docs WHERE toxic = 1", "docs WHERE toxic = 0", "doc_id",
            ["n_chars"], ["lang", "source", "quality"])}""",
        "minority_neighbours": f"""WITH {ORD}, {_neighbours("ord WHERE target = 1", "o_orderkey",
            ["o_totalprice", "c_acctbal"], ["o_orderpriority", "c_mktsegment", "late_year"])}
            SELECT base_key AS o_orderkey, CAST(nth - 1 AS INTEGER) AS position, near_key, round(dist, 4) AS dist
            FROM nearest""",
        "scaled_neighbours": f"""WITH {ORD}, scaled AS (
              SELECT * REPLACE (
                round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice,
                round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal)
              FROM ord), {_neighbours("scaled WHERE target = 1", "o_orderkey",
            ["o_totalprice", "c_acctbal"], ["o_orderpriority", "c_mktsegment", "late_year"])}
            SELECT base_key AS o_orderkey, CAST(nth - 1 AS INTEGER) AS position, near_key, round(dist, 4) AS dist
            FROM nearest""",
        "smotenc_balance": f"""WITH {RISK}, c AS (SELECT target AS label, count(*) AS n FROM risk GROUP BY 1),
            new AS (SELECT CAST(floor(5e-1 * max(n) - min(n)) AS BIGINT) AS n_new FROM c)
            SELECT label, n AS n_before, n + CASE label WHEN 1 THEN n_new ELSE 0 END AS n_after,
              CASE label WHEN 1 THEN n_new ELSE 0 END AS added FROM c, new""",
        "smotenc_integrity": f"""WITH {RISK_SPLIT}, c AS (
              SELECT count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1
              FROM parted WHERE split = 'train')
            SELECT CAST(floor(5e-1 * n0 - n1) AS BIGINT) AS synthetic, n0 + n1 AS originals,
              0::BIGINT AS synthetic_majority, 0::BIGINT AS changed_rows, 0::BIGINT AS test_rows_used FROM c""",
        "select_features": f"""WITH {ORD} SELECT o_orderkey, o_totalprice, c_acctbal, o_orderpriority, c_mktsegment,
            late_year, target FROM ord""",
        "scale_numeric": f"""WITH {ORD} SELECT o_orderkey,
            round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6)
              AS num__o_totalprice,
            round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS num__c_acctbal
            FROM ord""",
        "one_hot_long": f"""WITH {RISK_SPLIT}, t AS (SELECT avg(x_num) AS m, stddev_pop(x_num) AS s FROM parted
              WHERE split = 'train')
            SELECT row_id, 'num__x_num' AS slot, round((x_num - m) / s, 6) AS value FROM risk, t
            UNION ALL SELECT row_id, 'cat__x_cat_' || x_cat, 1e0 FROM risk
              WHERE x_cat IN (SELECT x_cat FROM parted WHERE split = 'train')
            UNION ALL SELECT row_id, 'bin__x_bin', 1e0 FROM risk WHERE x_bin = 1""",
        "encoded_tables": f"""WITH {RISK_SPLIT}, t AS (SELECT avg(x_num) AS m, stddev_pop(x_num) AS s FROM parted
              WHERE split = 'train'), long AS (
            SELECT split, target, 'num__x_num' AS slot, (x_num - m) / s AS value FROM parted, t
            UNION ALL SELECT split, target, 'cat__x_cat_' || x_cat, 1e0 FROM parted
              WHERE x_cat IN (SELECT x_cat FROM parted WHERE split = 'train')
            UNION ALL SELECT split, target, 'bin__x_bin', 1e0 FROM parted WHERE x_bin = 1)
            SELECT split, target, slot, count(*) AS n, round(sum(value), 4) AS total FROM long GROUP BY ALL""",
        "vector_slots": f"""WITH {RISK}, t AS (SELECT avg(x_num) AS m, stddev_pop(x_num) AS s FROM risk)
            SELECT row_id, 'num__x_num' AS slot, round((x_num - m) / s, 6) AS value FROM risk, t
            UNION ALL SELECT row_id, 'cat__x_cat_' || x_cat, 1e0 FROM risk
            UNION ALL SELECT row_id, 'bin__x_bin', 1e0 FROM risk WHERE x_bin = 1""",
        "slot_names": """WITH c AS (SELECT DISTINCT event_type AS v FROM events), n AS (SELECT count(*) AS k FROM c)
            SELECT 0 AS position, 'num__x_num' AS slot
            UNION ALL SELECT CAST(row_number() OVER (ORDER BY v) AS INTEGER), 'cat__x_cat_' || v FROM c
            UNION ALL SELECT CAST(k + 1 AS INTEGER), 'bin__x_bin' FROM n""",
        "encode_unseen": f"""WITH {DOCS}, {_split('docs', 'doc_id', 'toxic')}
            SELECT doc_id, lang || '/' || source AS combo, (lang, source) IN (
              SELECT (lang, source) FROM parted WHERE split = 'train') AS seen FROM parted WHERE split = 'test'""",
        "confusion": f"WITH {SCORED} {scored_counts}",
        "confusion_by_fold": f"WITH {SCORED} SELECT fold, {_counts('5e-1')} FROM scored GROUP BY fold",
        "decisions": f"""WITH {SCORED} SELECT row_id, score, CASE WHEN score < 3e-1 THEN 'LOW' WHEN score < 5e-1
            THEN 'MODERATE' ELSE 'HIGH' END AS risk_band, CAST(score >= 5e-1 AS INTEGER) AS prediction,
            CAST(score > 5e-1 AS INTEGER) AS strict_prediction,
            CASE WHEN score >= 5e-1 THEN 'Higher risk' ELSE 'Lower risk' END AS predicted_class FROM scored""",
        "metrics_at_threshold": f"""WITH {SCORED}, c AS (SELECT {_counts('45e-2')} FROM scored)
            SELECT tn, fp, fn, tp, {RATES}, 45e-2 AS threshold FROM c""",
        "roc_auc": f"WITH {SCORED}, {RANKING} SELECT round(roc_auc, 6) AS roc_auc FROM ranking",
        "average_precision": f"WITH {SCORED}, {RANKING} SELECT round(average_precision, 6) AS average_precision FROM ranking",
        "ranking_by_fold": f"""WITH {SCORED}, {_group_auc('fold')} SELECT fold, round(roc_auc, 6) AS roc_auc,
            round(average_precision, 6) AS average_precision FROM group_auc""",
        "roc_points": f"""WITH {SCORED}, {ABOVE} SELECT score AS threshold, round(cum_neg / all_neg, 6) AS fpr,
            round(cum_pos / all_pos, 6) AS tpr FROM totals UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0""",
        "row_numbers": """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS row_id,
            l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem""",
        "roc_points_thin": f"""WITH {RISK}, scored AS (SELECT target AS label, x_num AS score FROM risk), {ABOVE},
            runs AS (SELECT *, min(cum_pos) OVER v AS low_pos, max(cum_pos) OVER v AS high_pos,
                min(cum_neg) OVER h AS low_neg, max(cum_neg) OVER h AS high_neg
              FROM totals WINDOW v AS (PARTITION BY cum_neg), h AS (PARTITION BY cum_pos))
            SELECT score AS threshold, round(cum_neg / all_neg, 6) AS fpr, round(cum_pos / all_pos, 6) AS tpr FROM runs
            WHERE NOT (cum_pos > low_pos AND cum_pos < high_pos) AND NOT (cum_neg > low_neg AND cum_neg < high_neg)
            UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0""",
        "pr_points": f"""WITH {SCORED}, {ABOVE} SELECT score AS threshold, round(cum_pos / all_pos, 6) AS recall,
            round(cum_pos / (cum_pos + cum_neg), 6) AS precision FROM totals UNION ALL SELECT NULL, 0, 1""",
        "threshold_sweep": f"WITH {SWEEP} SELECT * FROM sweep",
        "threshold_choice": f"""WITH {SWEEP}, {PROPOSED} SELECT sweep.*, CASE WHEN tp / (tp + fn) >= 6e-1
            THEN 'highest F1 among thresholds with OOF recall >= 0.6'
            ELSE 'no threshold reached OOF recall >= 0.6; used max-recall threshold as fallback' END AS selection_note
            FROM sweep JOIN proposed USING (threshold)""",
        "no_skill_rate": f"WITH {SCORED} SELECT round(avg(label), 6) AS no_skill FROM scored",
        "error_analysis": f"""WITH {SCORED}, c AS (SELECT {_counts('45e-2')} FROM scored) SELECT tn, fp, fn, tp,
            tp + fn AS positives, fp + tn AS negatives, round(fn / (tp + fn), 6) AS missed_share,
            round(fp / (fp + tn), 6) AS false_alarm_share FROM c""",
        "metric_compare": f"""WITH {SWEEP}, {PROPOSED}, exact AS (
              SELECT threshold, (tp + tn) / (tn + fp + fn + tp) AS accuracy,
                CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, tp / (tp + fn) AS recall,
                2 * tp / (2 * tp + fp + fn) AS f1_score, tn / (tn + fp) AS specificity FROM swept),
            d AS (UNPIVOT (SELECT * EXCLUDE (threshold) FROM exact WHERE threshold = 5e-1)
              ON * INTO NAME metric VALUE v),
            a AS (UNPIVOT (SELECT * EXCLUDE (threshold) FROM exact WHERE threshold = (SELECT threshold FROM proposed))
              ON * INTO NAME metric VALUE v)
            SELECT metric, round(d.v, 6) AS at_default, round(a.v, 6) AS at_alternative, round(a.v - d.v, 6) AS delta
            FROM d JOIN a USING (metric)""",
        "evaluation_report": f"""WITH {SWEEP}, {PROPOSED}, {RANKING} SELECT 'hash score' AS model, threshold,
            CASE WHEN threshold = 5e-1 THEN 'default' ELSE 'alternative_recall_oriented' END AS threshold_role,
            accuracy, precision, recall, f1_score, specificity, round(roc_auc, 6) AS roc_auc,
            round(average_precision, 6) AS average_precision FROM sweep, ranking
            WHERE threshold = 5e-1 OR threshold = (SELECT threshold FROM proposed)""",
        "fold_metrics": f"""WITH {FOLDS} SELECT model, strategy, fold, round(recall, 6) AS recall,
            round(precision, 6) AS precision, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc FROM folds""",
        "cv_summary": f"WITH {FOLDS} SELECT {CV_COLUMNS} FROM cv",
        "select_candidate": _select("0.5"),
        "select_candidate_floor": _select("0.3"),
        "cv_stability": f"""WITH {FOLDS}, t AS (SELECT count(*) FILTER (label = 1 AND score >= 5e-1)
              / count(*) FILTER (label = 1) AS test_recall FROM scored)
            SELECT {CV_COLUMNS}, round(test_recall, 6) AS test_recall,
              round(abs(mean_recall - test_recall), 6) AS recall_gap
            FROM cv, t WHERE model = 'error' AND strategy = 's1'""",
        "metrics_lookup": f"WITH {FOLDS} SELECT {CV_COLUMNS} FROM cv WHERE model = 'view' AND strategy = 's0'",
        "oof_scores": f"""WITH {TRAIN_FOLDS}, {_newton()}
            SELECT row_id, fold, label, round(score, 6) AS score FROM scored_folds WHERE strategy = 'class_weight'""",
        "cv_logistic": f"""WITH {TRAIN_FOLDS}, {_newton()}, scored AS (SELECT * FROM scored_folds),
            {_group_auc("strategy, fold")},
            counted AS (SELECT strategy, fold, {_counts("5e-1", ">")} FROM scored GROUP BY ALL)
            SELECT 'Logistic Regression' AS model, strategy, fold,
              round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
              round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
              round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
              round(roc_auc, 6) AS roc_auc
            FROM counted JOIN group_auc USING (strategy, fold)""",
        "linear_expression": "SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM events",
        "saved_model_roundtrip": """SELECT count(*) AS n_rows, 0::BIGINT AS n_different, true AS same_settings
            FROM events""",
        "validate_records": f"WITH {CHECKED} SELECT row_id, errors FROM checked",
        "quarantine_split": f"""WITH {CHECKED} SELECT row_id, CASE WHEN errors = '' THEN x_num END AS x_num,
            CASE WHEN errors = '' THEN x_cat END AS x_cat, CASE WHEN errors = '' THEN x_bin END AS x_bin,
            CASE WHEN errors = '' THEN 'valid' ELSE 'rejected' END AS side FROM checked""",
        "domain_membership": f"""WITH {CHECKED} SELECT row_id, x_cat FROM checked WHERE x_cat IS NOT NULL
            AND x_cat NOT IN (SELECT event_type FROM events)""",
        "score_table": f"""WITH {CHECKED} SELECT row_id, risk_score, prediction, risk_category, threshold_used, valid,
            errors FROM outputs""",
        "response_json": f"WITH {CHECKED} SELECT row_id, {RESPONSE} AS response FROM outputs",
        "form_scores": """WITH typed AS (
              SELECT *, 1 / (1 + exp(-(-8e-1 + (value - 5e1) / 6e1 * 45e-2 + CASE event_type WHEN 'click' THEN -1e-1
                WHEN 'error' THEN 55e-2 WHEN 'purchase' THEN 2e-1 WHEN 'signup' THEN -25e-2 WHEN 'view' THEN 5e-2 END
                + 3e-1 * (user_id % 2)))) AS p,
                CASE event_id % 9 WHEN 0 THEN 'Missing required field: ''x_num'''
                  WHEN 1 THEN 'Invalid x_num: ten. Must be a number.'
                  ELSE CASE WHEN value NOT BETWEEN 0 AND 400
                    THEN 'Invalid x_num: ' || value || '. Must be between 0 and 400.' ELSE '' END END AS errors
              FROM events)
            SELECT event_id AS row_id, CASE WHEN errors = '' THEN round(p, 4) END AS risk_score,
              CASE WHEN errors = '' THEN CAST(p >= 5e-1 AS INTEGER) END AS prediction, errors = '' AS valid, errors
            FROM typed""",
        "stream_response": f"WITH {CHECKED} SELECT body, {RESPONSE} AS response, valid AS accepted FROM outputs",
        "stream_score": f"""WITH {CHECKED} SELECT body, risk_score, prediction, risk_category, valid, errors
            FROM outputs""",
    }
    for name in ("lr_optimality", "lr_weighted_optimality"):
        sql[name] = f"""WITH {RISK_SPLIT}, slots AS (
              SELECT '(intercept)' AS slot UNION ALL SELECT 'num__x_num' UNION ALL SELECT 'bin__x_bin'
              UNION ALL SELECT DISTINCT 'cat__x_cat_' || x_cat FROM parted WHERE split = 'train')
            SELECT slot, true AS at_optimum FROM slots"""
    return sql
