"""The same results in plain SQL (DuckDB), written without any of the engine's shortcuts.

Thresholds and bins are tried one by one against the rows, AUC comes from average ranks,
and slices are one query per predicate.
"""

from __future__ import annotations

import math

from evalspark.functions.stopwords import ENGLISH

# Fixed values, written out here once more so that a wrong one on the other side shows.
COST_TABLE = {"default": (-1.0, 0.0, 2.0, 5.0), "low_fp": (-1.0, 0.0, 10.0, 3.0), "low_fn": (-1.0, 0.0, 2.0, 20.0)}  # TP, TN, FP, FN
ECE_BINS = 10
TEXT_BINS = [0, 30, 80, 160, 1000000]
CONFIDENCE_BINS = [0.0, 0.5, 0.7, 0.85, 1.01]
FREQUENCY_BINS = [0.0, 0.01, 0.05, 0.2, 1.01]
MIN_COUNT, HEATMAP_SLICES, TOP_ERRORS, MIN_ERRORS = 50, 25, 25, 20
MAX_TERMS, MAX_CLUSTERS = 5000, 6


def num(x: float) -> str:
    """A double literal with all its digits."""
    return f"CAST('{x!r}' AS DOUBLE)"


def r6(expr: str, name: str) -> str:
    return f"round(({expr}) + 1e-10, 6) AS {name}"


STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
GRID = "[" + ", ".join(f"CAST('{t // 100}.{t % 100:02d}' AS DOUBLE)" for t in range(5, 96)) + "]"  # 0.05 to 0.95


def u(key: str, tag) -> str:
    return f"CAST(CAST('0x' || substr(md5({key} || ':{tag}'), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE)"


def score(weight: float, label: str, noise: str) -> str:
    return f"round({num(weight)} * ({label}) + {num(round(1 - weight, 2))} * ({noise}), 4)"


# Length over 20,000, at most 1, to four places, half a place rounded up.
LENGTH_SCORE = "least((d.n_chars + 1) // 2, 10000) / CAST(10000 AS DOUBLE)"

SPLIT = f"""CASE WHEN {u('CAST(o_orderkey AS VARCHAR)', 42)} < 0.2 THEN 'test'
     WHEN {u('CAST(o_orderkey AS VARCHAR)', 42)} < {num(0.2 + 0.1)} THEN 'val' ELSE 'train' END"""

# One row per order and model.
ORDERS = f"""
base AS (
  SELECT o_orderkey AS id, {SPLIT} AS split, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders
),
wide AS (
  SELECT *, {score(0.35, 'label', u('CAST(id AS VARCHAR)', 'a'))} AS a,
            {score(0.25, 'label', u('CAST(id AS VARCHAR)', 'b'))} AS b FROM base
),
preds AS (
  SELECT 'model_a' AS model_name, 0 AS model_order, split, id, label, a AS y_score FROM wide
  UNION ALL
  SELECT 'model_b', 1, split, id, label, b FROM wide
)"""

LABELLED = "SELECT doc_id, 1 - quality AS label FROM labels"
DOCS = f"""
wide AS (
  SELECT d.doc_id AS id, 'all' AS split, CAST(l.label AS INTEGER) AS label, d.text,
         {score(0.4, 'l.label', u('CAST(d.doc_id AS VARCHAR)', 'a'))} AS a,
         {LENGTH_SCORE} AS b
  FROM documents d JOIN ({LABELLED}) l ON d.doc_id = l.doc_id
),
preds AS (
  SELECT 'model_a' AS model_name, 0 AS model_order, split, id, label, a AS y_score FROM wide
  UNION ALL
  SELECT 'model_b', 1, split, id, label, b FROM wide
)"""

LINE_KEY = """concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT),
  CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y-%m-%d'))"""
LINES = f"""
base AS (SELECT {LINE_KEY} AS k, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem),
preds AS (
  SELECT 'model_a' AS model_name, 0 AS model_order, 'all' AS split, label, {score(0.35, 'label', u('k', 'a'))} AS y_score FROM base
  UNION ALL
  SELECT 'model_b', 1, 'all', label, {score(0.25, 'label', u('k', 'b'))} FROM base
)"""



def value_text(column: str, kind: str) -> str:
    """A value as tag, length in bytes and text; ``n`` for null. Only the kinds that the tables have."""
    if kind == "f":
        whole, rest = f"floor({column})", f"(({column} - floor({column})) * {num(2.0**62)})"
        digits = [whole, f"floor({rest})", f"floor(({rest} - floor({rest})) * {num(2.0**62)})"]
        text = " || '.' || ".join(f"CAST(CAST({d} AS BIGINT) AS VARCHAR)" for d in digits)
    elif kind == "t":
        text = f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
    else:
        text = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN 'n' ELSE '{kind}:' || octet_length(encode({text})) || ':' || {text} END"


def row_text(columns: dict[str, str]) -> str:
    return " || ".join(value_text(c, columns[c]) for c in sorted(columns))


LINE_KINDS = dict.fromkeys(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "label"), "i") | dict.fromkeys(
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "f") | {"l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t"}
ORDER_KINDS = {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "f", "o_orderdate": "t", "o_orderpriority": "s"}
LABEL_KINDS = {"doc_id": "i", "quality": "i", "toxic": "i"}


def fingerprint(table: str, kinds: dict[str, str]) -> str:
    parts = ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {p}, 15) AS HUGEINT)), 0) AS s{p}" for p in (1, 16))
    return f"""SELECT '{table}' AS table_name, n_rows, substr(sha256(n_rows || ':' || CAST(s1 AS VARCHAR) || ':' || CAST(s16 AS VARCHAR)), 1, 32) AS fingerprint
      FROM (SELECT count(*) AS n_rows, {parts} FROM (SELECT sha256({row_text(kinds)}) AS h FROM {table}))"""


COSTS = "costs(use_case, c_tp, c_tn, c_fp, c_fn) AS (VALUES " + ", ".join(
    f"('{name}', {num(tp)}, {num(tn)}, {num(fp)}, {num(fn)})" for name, (tp, tn, fp, fn) in COST_TABLE.items()
) + ")"

COUNTS = """count(*) AS n,
  count(*) FILTER (WHERE label = 0 AND y_score < t) AS tn, count(*) FILTER (WHERE label = 0 AND y_score >= t) AS fp,
  count(*) FILTER (WHERE label = 1 AND y_score < t) AS fn, count(*) FILTER (WHERE label = 1 AND y_score >= t) AS tp"""
COUNTS_HALF = COUNTS.replace("< t)", "< 0.5)").replace(">= t)", ">= 0.5)")
COST = "(tp * c_tp + tn * c_tn + fp * c_fp + fn * c_fn) / n"
ACC = "CAST(tp + tn AS DOUBLE) / n"
PREC = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END"
REC = "CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END"
F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END"
BRIER = "avg((y_score - label) * (y_score - label))"
CONF = "greatest(y_score, 1 - y_score)"
BIN = "CASE " + " ".join(
    f"WHEN y_score >= {i} * {num(0.1)} AND y_score {'<= 1.0' if i == ECE_BINS - 1 else f'< {i + 1} * {num(0.1)}'} THEN {i}" for i in range(ECE_BINS)
) + " END"


def curve(source: str, by: str) -> str:
    """CTEs: confusion and cost at every threshold for each group of ``source``."""
    return f"""
grid AS (SELECT unnest({GRID}) AS t),
conf AS (SELECT {by}, t, {COUNTS} FROM {source}, grid GROUP BY {by}, t),
{COSTS},
curve AS (SELECT conf.*, use_case, {COST} AS expected_cost FROM conf, costs),
best AS (
  SELECT * FROM curve QUALIFY row_number() OVER (PARTITION BY {by}, use_case ORDER BY expected_cost, t) = 1
)"""


def ece_cte(source: str, by: str) -> str:
    return f"""
bins AS (
  SELECT {by}, {BIN} AS ece_bin, count(*) AS n,
         avg(CAST(CAST(y_score >= 0.5 AS INTEGER) = label AS INTEGER)) AS accuracy, avg(y_score) AS mean_score
  FROM {source} GROUP BY ALL
),
ece AS (
  SELECT {by}, sum(CASE WHEN ece_bin IS NOT NULL THEN abs(accuracy - mean_score) * n ELSE 0 END) / sum(n) AS ece
  FROM bins GROUP BY {by}
)"""


def rank_cte(source: str, by: str) -> str:
    """AUC by the sum of average ranks of the positives; average precision step by step."""
    return f"""
tied AS (
  SELECT {by}, y_score, count(*) AS c, sum(label) AS pos FROM {source} GROUP BY {by}, y_score
),
cum AS (
  SELECT *, sum(c) OVER (PARTITION BY {by} ORDER BY y_score) AS upto,
         sum(c) OVER (PARTITION BY {by} ORDER BY y_score DESC) AS above,
         sum(pos) OVER (PARTITION BY {by} ORDER BY y_score DESC) AS hits FROM tied
),
tot AS (SELECT {by}, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(c) - sum(pos) AS DOUBLE) AS q FROM tied GROUP BY {by}),
auc AS (
  SELECT {', '.join('cum.' + c.strip() for c in by.split(','))},
         CASE WHEN any_value(p) > 0 AND any_value(q) > 0 THEN
           (sum(pos * (upto - (c - 1) / 2.0)) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)) END AS roc_auc,
         CASE WHEN any_value(p) > 0 AND any_value(q) > 0 THEN
           sum(CAST(pos AS DOUBLE) * hits / above) / any_value(p) END AS pr_auc
  FROM cum JOIN tot USING ({by}) GROUP BY ALL
)"""


BY = "model_name, model_order, split"


def poisson_cuts(mean: int) -> list[str]:
    """Cuts of the distribution: the cumulated probabilities in 20 binary places, as five digits."""
    out, k = [], 0
    while (cut := math.floor(math.fsum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(k + 1)) * (1 << 20))) < (1 << 20) - 1:
        out.append(f"{cut:05x}")
        k += 1
    return out


def drawn_times(n: str, h: str) -> str:
    """How often the ``n`` rows of a cell are drawn, from the 40 digits ``h``."""
    parts = []
    for k in range(5):
        cuts = poisson_cuts(1 << k)
        case = " ".join(f"WHEN substr({h}, {1 + 5 * k}, 5) < '{c}' THEN {j}" for j, c in enumerate(cuts))
        parts.append(f"CASE WHEN ({n} & {1 << k}) <> 0 THEN CASE {case} ELSE {len(cuts)} END ELSE 0 END")
    a, b = (f"CAST(CAST('0x' || substr({h}, {p}, 7) AS BIGINT) AS DOUBLE)" for p in (26, 33))
    z = f"(sqrt({num(-2.0)} * ln(({a} + 1) / {num(2.0**28)})) * cos({num(2 * math.pi)} * {b} / {num(2.0**28)}))"
    m = f"CAST({n} - ({n} & 31) AS DOUBLE)"
    parts.append(f"CASE WHEN {n} >= 32 THEN greatest(CAST(floor({m} + sqrt({m}) * {z} + ({z} * {z} - 1) / 6 + {num(0.5)}) AS BIGINT), 0) ELSE 0 END")
    return " + ".join(parts)


SCORE_TEXT = f"CAST(CAST(floor(y_score) AS BIGINT) AS VARCHAR) || '.' || CAST(CAST(floor((y_score - floor(y_score)) * {num(2.0**62)}) AS BIGINT) AS VARCHAR)"
# Every distinct score and label of a model and split in 200 draws.
DRAWN = f"""
tags AS (
  SELECT {BY}, y_score, label, count(*) AS c, md5(concat_ws('|', '42', model_name, model_order, split, label, {SCORE_TEXT})) AS tag FROM preds GROUP BY ALL
),
hashes AS (SELECT tags.*, draw, sha1(tag || '|' || draw) AS h FROM tags, (SELECT unnest(range(200)) AS draw)),
drawn AS (SELECT {BY}, draw, y_score, label, {drawn_times('c', 'h')} AS w FROM hashes)"""


def interval_cte(name: str, values: str) -> str:
    """CTE of the interval of ``v`` per model and split."""
    return f"""{name} AS (
  SELECT {BY}, quantile_cont(v, {num(0.025)}) AS ci_low, quantile_cont(v, {num(1 - 0.025)}) AS ci_high FROM ({values}) GROUP BY ALL)"""


BRIER_DRAWS = f"SELECT {BY}, draw, sum(w * ((y_score - label) * (y_score - label))) / sum(w) AS v FROM drawn GROUP BY {BY}, draw HAVING sum(w) > 0"
AUC_DRAWS = f"""SELECT {BY}, draw, sum(p * (upto - q / 2.0)) / (sum(p) * sum(q)) AS v FROM (
    SELECT *, sum(q) OVER (PARTITION BY {BY}, draw ORDER BY y_score) AS upto FROM (
      SELECT {BY}, draw, y_score, sum(w) FILTER (label = 1) AS p1, coalesce(p1, 0) AS p, coalesce(sum(w) FILTER (label = 0), 0) AS q FROM drawn GROUP BY {BY}, draw, y_score))
  GROUP BY {BY}, draw HAVING sum(p) > 0 AND sum(q) > 0"""
MEDIAN_DRAWS = f"""SELECT {BY}, draw, min(y_score) FILTER (2 * upto >= whole) AS v FROM (
    SELECT *, sum(w) OVER (PARTITION BY {BY}, draw ORDER BY y_score) AS upto, sum(w) OVER (PARTITION BY {BY}, draw) AS whole FROM drawn WHERE label = 1 AND w > 0)
  GROUP BY {BY}, draw"""
ECE_DRAWS = f"""SELECT {BY}, draw, sum(CASE WHEN ece_bin IS NOT NULL THEN abs(g) ELSE 0 END) / sum(n) AS v FROM (
    SELECT {BY}, draw, ece_bin, sum(w) AS n, sum(w * (CAST(CAST(y_score >= 0.5 AS INTEGER) = label AS INTEGER) - y_score)) AS g
    FROM (SELECT *, {BIN} AS ece_bin FROM drawn) GROUP BY {BY}, draw, ece_bin) GROUP BY {BY}, draw HAVING sum(n) > 0"""
CI = f"{r6('ci_low', 'ci_low')}, {r6('ci_high', 'ci_high')}, {r6('ci_high - ci_low', 'ci_width')}"

EXAMPLES = f"""
examples AS (
  SELECT o_orderkey AS id, {SPLIT} AS split, CAST(o_orderstatus = 'F' AS INTEGER) AS label, r_name AS region,
         o_totalprice AS amount,
         c_mktsegment || ' ' || o_orderpriority || repeat(' detail', CAST(o_orderkey % 30 AS INTEGER)) AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""


def _members(rules: list[tuple[str, str]], hard: str, partial: bool = False) -> str:
    """CTEs from ``preds`` and ``examples`` to ``sl``: one row per prediction and slice.

    ``partial``: some predictions have no example; they are in no slice by text.
    """
    lens = list(zip(TEXT_BINS[:-1], TEXT_BINS[1:]))
    confs = list(zip(CONFIDENCE_BINS[:-1], CONFIDENCE_BINS[1:]))
    freqs = list(zip(FREQUENCY_BINS[:-1], FREQUENCY_BINS[1:]))
    named = list(rules)
    named += [(f"text_len[{a},{b})", f"length(coalesce(text, '')) >= {a} AND length(coalesce(text, '')) < {b}{' AND matched' if partial else ''}") for a, b in lens]
    named += [(f"confidence[{a},{b})", f"{CONF} >= {num(a)} AND {CONF} < {num(b)}") for a, b in confs]
    named += [(f"label_freq[{a},{b})", f"freq >= {num(a)} AND freq < {num(b)}") for a, b in freqs]
    named += [("easy_examples", f"NOT ({hard})"), ("hard_examples", hard)]
    parts = "\n  UNION ALL ".join(f"SELECT '{n}' AS slice_name, * FROM rows_ WHERE {p}" for n, p in named)
    return f"""
votes AS (
  SELECT split, id, min(CAST(y_score >= 0.5 AS INTEGER)) <> max(CAST(y_score >= 0.5 AS INTEGER)) AS disagree
  FROM preds GROUP BY split, id
),
freq AS (
  SELECT model_name, split, label, count(*) / sum(count(*)) OVER (PARTITION BY model_name, split) AS freq
  FROM preds GROUP BY model_name, split, label
),
rows_ AS (
  SELECT p.*, e.* EXCLUDE (id, split, label), {"e.id IS NOT NULL AS matched, " if partial else ""}v.disagree, f.freq
  FROM preds p {"LEFT " if partial else ""}JOIN examples e ON p.id = e.id AND p.split = e.split
  JOIN votes v ON v.id = p.id AND v.split = p.split
  JOIN freq f ON f.model_name = p.model_name AND f.split = p.split AND f.label = p.label
),
sl AS MATERIALIZED ({parts})"""


ORDER_RULES = [
    ("label_positive", "label = 1"),
    ("label_negative", "label = 0"),
    ("region_america", "region = 'AMERICA'"),
    ("high_value", "amount >= 300000"),
]
ORDERS_SLICED = f"{ORDERS}, {EXAMPLES}, {_members(ORDER_RULES, 'disagree')}"
DOCS_EXAMPLES = "examples AS (SELECT id, split, label, text FROM wide)"
DOCS_SLICED = f"{DOCS}, {DOCS_EXAMPLES}, {_members(ORDER_RULES[:2], 'disagree')}"
SBY = "slice_name, model_name, model_order, split"
# Examples of one language only: scores of the other documents have none.
PARTIAL = f"""{DOCS},
examples AS (SELECT w.id, w.split, w.label, w.text FROM wide w JOIN documents d ON d.doc_id = w.id WHERE d.lang = 'en'),
{_members(ORDER_RULES[:2], 'disagree', True)}"""

ERRORS = """
wrong AS (
  SELECT p.*, use_case, CASE WHEN p.label = 0 THEN 'FP' ELSE 'FN' END AS error_type,
         greatest(y_score, 1 - y_score) AS confidence
  FROM preds p JOIN best b ON p.model_name = b.model_name AND p.split = b.split
  WHERE (y_score >= t AND p.label = 0) OR (y_score < t AND p.label = 1)
)"""

TOKENS = f"""
ws AS (
  SELECT *, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                        lambda w: w NOT IN ({STOP})) AS w FROM src
),
toks AS (
  SELECT * EXCLUDE (w), len(w) AS n_words,
    list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS tokens
  FROM ws
)"""

# Term weights of the errors of models that have enough of them.
TFIDF = f"""
groups_ AS (SELECT model_name, split, use_case, count(*) AS n FROM wrong WHERE use_case = 'default' GROUP BY ALL HAVING count(*) >= {MIN_ERRORS}),
src AS (SELECT g.model_name, g.split, g.use_case, g.n, w.id, t.text FROM wrong w JOIN groups_ g USING (model_name, split, use_case) JOIN wide t ON t.id = w.id), {TOKENS},
cells AS (SELECT model_name, split, use_case, n, id, term, count(*) AS c FROM (SELECT * EXCLUDE (tokens), unnest(tokens) AS term FROM toks) GROUP BY ALL),
terms AS (
  SELECT model_name, split, use_case, term, any_value(n) AS n, count(*) AS df FROM cells GROUP BY model_name, split, use_case, term
  QUALIFY row_number() OVER (PARTITION BY model_name, split, use_case ORDER BY sum(c) DESC, term) <= {MAX_TERMS}
),
weighted AS (SELECT cells.* EXCLUDE (n), c * (ln(CAST(terms.n + 1 AS DOUBLE) / (df + 1)) + 1) AS raw FROM cells JOIN terms USING (model_name, split, use_case, term))"""

CONF_NAME = "CASE " + " ".join(
    f"WHEN confidence >= {num(a)} AND confidence < {num(b)} THEN 'confidence[{a},{b})'"
    for a, b in zip(CONFIDENCE_BINS[:-1], CONFIDENCE_BINS[1:])
) + " END"

HALF = f"half AS (SELECT {BY}, {COUNTS_HALF}, {BRIER} AS brier, avg({CONF}) AS avg_confidence FROM preds GROUP BY {BY})"
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _scored(label: str) -> str:
    return f"""SELECT d.doc_id AS id, 'model_b' AS model_name, {LENGTH_SCORE} AS y_score
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE {label}"""


# Ten class scores from 64 components: the sum of every tenth.
CLASS_SCORES = "[" + ", ".join(" + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(k, 64, 10)) for k in range(10)) + "]"
CLASSES = f"classes_ AS (SELECT vec_id, label, {CLASS_SCORES} AS s FROM embeddings)"


ORACLE = {
    "confusion_overall": f"WITH {ORDERS} SELECT model_name, split, {COUNTS_HALF} FROM preds GROUP BY model_name, split",
    "binary_metrics": f"""WITH {ORDERS}, {HALF}
      SELECT model_name, split, n, {r6(ACC, 'accuracy')}, {r6(PREC, 'precision')}, {r6(REC, 'recall')}, {r6(F1, 'f1')} FROM half""",
    "brier_avgconf": f"""WITH {ORDERS}, {HALF}
      SELECT model_name, split, {r6('brier', 'brier')}, {r6('avg_confidence', 'avg_confidence')} FROM half""",
    "high_confidence": f"""WITH {ORDERS}, h AS (
        SELECT model_name, split, count(*) AS n, count(*) FILTER (WHERE {CONF} >= 0.8) AS n_high,
               avg(CAST(CAST(y_score >= 0.5 AS INTEGER) = label AS INTEGER)) FILTER (WHERE {CONF} >= 0.8) AS acc
        FROM preds GROUP BY model_name, split)
      SELECT model_name, split, n, n_high, {r6('n_high / CAST(n AS DOUBLE)', 'high_confidence_share')},
             {r6('acc', 'high_confidence_accuracy')} FROM h""",
    "ece": f"WITH {ORDERS}, {ece_cte('preds', BY)} SELECT model_name, split, {r6('ece', 'ece')} FROM ece",
    "reliability_bins": f"""WITH {ORDERS}, {ece_cte('preds', BY)}
      SELECT model_name, split, ece_bin, n, {r6('accuracy', 'accuracy')}, {r6('mean_score', 'mean_score')}
      FROM bins WHERE ece_bin IS NOT NULL""",
    "roc_auc": f"WITH {ORDERS}, {rank_cte('preds', BY)} SELECT model_name, split, {r6('roc_auc', 'roc_auc')} FROM auc",
    "average_precision": f"WITH {ORDERS}, {rank_cte('preds', BY)} SELECT model_name, split, {r6('pr_auc', 'pr_auc')} FROM auc",
    "multiclass_metrics": f"""WITH {CLASSES}, base AS (SELECT label AS y, list_position(s, list_max(s)) - 1 AS y_hat FROM classes_),
      classes AS (SELECT y AS c FROM base UNION SELECT y_hat FROM base),
      per AS (SELECT c, count(*) FILTER (WHERE y = c AND y_hat = c) AS hit, count(*) FILTER (WHERE y = c) AS actual,
                     count(*) FILTER (WHERE y_hat = c) AS guessed FROM classes, base GROUP BY c)
      SELECT 'argmax' AS model_name, (SELECT count(*) FROM base) AS n,
        {r6('(SELECT avg(CAST(y = y_hat AS INTEGER)) FROM base)', 'accuracy')},
        {r6('avg(CASE WHEN guessed = 0 THEN 0.0 ELSE CAST(hit AS DOUBLE) / guessed END)', 'precision_macro')},
        {r6('avg(CASE WHEN actual = 0 THEN 0.0 ELSE CAST(hit AS DOUBLE) / actual END)', 'recall_macro')},
        {r6('avg(CASE WHEN actual + guessed = 0 THEN 0.0 ELSE CAST(2 * hit AS DOUBLE) / (actual + guessed) END)', 'f1_macro')}
      FROM per""",
    "class_decisions": f"""WITH {CLASSES} SELECT vec_id AS id, label, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS y_pred,
        {r6('list_max(s)', 'y_score')} FROM classes_""",
    "expected_cost": f"""WITH {ORDERS}, {HALF}, {COSTS}
      SELECT model_name, split, use_case, {r6(COST, 'expected_cost')} FROM half, costs""",
    "cost_curve": f"""WITH {ORDERS}, {curve('preds', BY)}
      SELECT model_name, split, use_case, t AS threshold, tn, fp, fn, tp, {r6('expected_cost', 'expected_cost')} FROM curve""",
    "best_threshold": f"""WITH {ORDERS}, {curve('preds', BY)}
      SELECT model_name, split, use_case, t AS best_threshold, {r6('expected_cost', 'expected_cost')} FROM best""",
    "metrics_at_best": f"""WITH {ORDERS}, {curve('preds', BY)}, {ece_cte('preds', BY)}, {rank_cte('preds', BY)}, {HALF}
      SELECT b.model_name, b.split, use_case, t AS best_threshold, {r6('expected_cost', 'expected_cost')}, b.n, b.tn, b.fp, b.fn, b.tp,
        {r6('CAST(b.tp + b.tn AS DOUBLE) / b.n', 'accuracy')},
        {r6('CASE WHEN b.tp + b.fp = 0 THEN 0.0 ELSE CAST(b.tp AS DOUBLE) / (b.tp + b.fp) END', 'precision')},
        {r6('CASE WHEN b.tp + b.fn = 0 THEN 0.0 ELSE CAST(b.tp AS DOUBLE) / (b.tp + b.fn) END', 'recall')},
        {r6('CASE WHEN 2 * b.tp + b.fp + b.fn = 0 THEN 0.0 ELSE CAST(2 * b.tp AS DOUBLE) / (2 * b.tp + b.fp + b.fn) END', 'f1')},
        {r6('brier', 'brier')}, {r6('ece', 'ece')}, {r6('avg_confidence', 'avg_confidence')}, {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')}
      FROM best b JOIN half h USING (model_name, split) JOIN ece USING (model_name, split) JOIN auc USING (model_name, split)""",
    "model_ranking": f"""WITH {ORDERS}, {curve('preds', BY)}, {ece_cte('preds', BY)}, {rank_cte('preds', BY)}, {HALF}
      SELECT CAST(row_number() OVER (PARTITION BY b.split ORDER BY b.expected_cost, b.model_order) AS INTEGER) AS rank,
        b.model_name, b.split, t AS best_threshold, b.n, {r6('expected_cost', 'expected_cost')},
        {r6('CASE WHEN 2 * b.tp + b.fp + b.fn = 0 THEN 0.0 ELSE CAST(2 * b.tp AS DOUBLE) / (2 * b.tp + b.fp + b.fn) END', 'f1_at_best')},
        {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')}, {r6('brier', 'brier')}, {r6('ece', 'ece')}
      FROM best b JOIN half h USING (model_name, split) JOIN ece USING (model_name, split) JOIN auc USING (model_name, split)
      WHERE use_case = 'default'""",
    "winner_by_use_case": f"""WITH {ORDERS}, {curve('preds', BY)}
      SELECT use_case, model_name, split, t AS best_threshold, {r6('expected_cost', 'expected_cost')} FROM best
      QUALIFY row_number() OVER (PARTITION BY use_case, split ORDER BY best.expected_cost, model_order) = 1""",
    "operating_threshold": f"""WITH {ORDERS}, own AS (SELECT *, CASE WHEN model_name = 'model_b' THEN {num(0.26)} ELSE {num(0.5)} END AS t FROM preds),
      c AS (SELECT model_name, split, t, {COUNTS} FROM own GROUP BY model_name, split, t)
      SELECT model_name, split, t AS threshold, tn, fp, fn, tp, {r6(ACC, 'accuracy')}, {r6(F1, 'f1')} FROM c""",
    "recommendation": f"""WITH {ORDERS}, {curve('preds', BY)},
      r AS (SELECT *, row_number() OVER (PARTITION BY use_case, split ORDER BY expected_cost, model_order) AS rk FROM best)
      SELECT a.use_case, a.split, 'min_expected_cost' AS objective, a.model_name AS recommended_model, a.t AS recommended_threshold,
        CAST((SELECT count(*) FROM r z WHERE z.use_case = a.use_case AND z.split = a.split AND rk <= 5) AS INTEGER) AS ranked_models,
        b.model_name AS second_model, {r6('b.expected_cost', 'second_cost')}
      FROM r a JOIN r b ON a.use_case = b.use_case AND a.split = b.split AND a.rk = 1 AND b.rk = 2""",
    "slice_membership": f"""WITH {ORDERS_SLICED}
      SELECT model_name, split, id, slice_name FROM sl UNION ALL SELECT model_name, split, id, '__all__' FROM rows_""",
    "slice_sizes": f"""WITH {ORDERS_SLICED}
      SELECT model_name, split, slice_name, count(*) AS n FROM sl GROUP BY ALL
      UNION ALL SELECT model_name, split, '__all__', count(*) FROM rows_ GROUP BY ALL""",
    "slice_metrics": f"""WITH {ORDERS_SLICED}, {curve('sl', SBY)}, {ece_cte('sl', SBY)}, {rank_cte('sl', SBY)},
      half AS (SELECT {SBY}, {COUNTS_HALF}, {BRIER} AS brier, avg({CONF}) AS avg_confidence FROM sl GROUP BY {SBY})
      SELECT h.model_name, h.split, h.slice_name, h.n, h.tn, h.fp, h.fn, h.tp, b.t AS best_threshold,
        {r6(ACC.replace('tp', 'h.tp').replace('tn', 'h.tn').replace('/ n', '/ h.n'), 'accuracy')},
        {r6('CASE WHEN h.tp + h.fp = 0 THEN 0.0 ELSE CAST(h.tp AS DOUBLE) / (h.tp + h.fp) END', 'precision')},
        {r6('CASE WHEN h.tp + h.fn = 0 THEN 0.0 ELSE CAST(h.tp AS DOUBLE) / (h.tp + h.fn) END', 'recall')},
        {r6('CASE WHEN 2 * h.tp + h.fp + h.fn = 0 THEN 0.0 ELSE CAST(2 * h.tp AS DOUBLE) / (2 * h.tp + h.fp + h.fn) END', 'f1')},
        {r6('brier', 'brier')}, {r6('ece', 'ece')}, {r6('avg_confidence', 'avg_confidence')},
        {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')}, {r6('expected_cost', 'expected_cost')}
      FROM half h JOIN best b USING (slice_name, model_name, split) JOIN ece USING (slice_name, model_name, split)
      JOIN auc USING (slice_name, model_name, split) WHERE use_case = 'default'""",
    "slice_costs": f"""WITH {ORDERS_SLICED}, everything AS (SELECT * FROM sl UNION ALL SELECT '__all__', * FROM rows_), {curve('everything', SBY)}
      SELECT model_name, split, slice_name, use_case, n, t AS best_threshold, {r6('expected_cost', 'expected_cost')} FROM best""",
    "slice_recommendation": f"""WITH {ORDERS_SLICED}, {curve('sl', SBY)}
      SELECT use_case, split, slice_name, model_name AS recommended_model, t AS recommended_threshold,
             {r6('expected_cost', 'expected_cost')}, n, n < {MIN_COUNT} AS unstable FROM best
      QUALIFY row_number() OVER (PARTITION BY use_case, split, slice_name ORDER BY best.expected_cost, model_order) = 1""",
    "instability_flags": f"""WITH {DOCS_SLICED}, everything AS (SELECT * FROM sl UNION ALL SELECT '__all__', * FROM rows_),
      c AS (SELECT model_name, split, slice_name, count(*) AS n FROM everything GROUP BY ALL)
      SELECT *, n < {MIN_COUNT} AS unstable, CASE WHEN n < {MIN_COUNT} THEN 'low_sample_count' ELSE 'stable' END AS reason FROM c""",
    "text_length_slices": f"""WITH {DOCS_SLICED}, tl AS (SELECT * FROM sl WHERE slice_name LIKE 'text_len%'), {curve('tl', SBY)}, {ece_cte('tl', SBY)},
      half AS (SELECT {SBY}, {COUNTS_HALF}, {BRIER} AS brier FROM tl GROUP BY {SBY})
      SELECT h.model_name, h.split, h.slice_name, h.n, b.t AS best_threshold,
        {r6('CAST(h.tp + h.tn AS DOUBLE) / h.n', 'accuracy')},
        {r6('CASE WHEN 2 * h.tp + h.fp + h.fn = 0 THEN 0.0 ELSE CAST(2 * h.tp AS DOUBLE) / (2 * h.tp + h.fp + h.fn) END', 'f1')},
        {r6('brier', 'brier')}, {r6('ece', 'ece')}, {r6('expected_cost', 'expected_cost')}
      FROM half h JOIN best b USING (slice_name, model_name, split) JOIN ece USING (slice_name, model_name, split) WHERE use_case = 'default'""",
    "difficulty_disagreement": f"""WITH {ORDERS}
      SELECT split, id, min(CAST(y_score >= 0.5 AS INTEGER)) <> max(CAST(y_score >= 0.5 AS INTEGER)) AS difficulty_hard
      FROM preds GROUP BY split, id""",
    "label_frequency": f"""WITH {ORDERS}, c AS (SELECT model_name, split, label, count(*) AS n FROM preds GROUP BY ALL)
      SELECT *, {r6('n / CAST(sum(n) OVER (PARTITION BY model_name, split) AS DOUBLE)', 'label_freq')} FROM c""",
    "single_model_slices": f"""WITH {ORDERS},
      sl AS (SELECT *, CASE WHEN abs(y_score - {num(0.5)}) < {num(0.15)} THEN 'hard_examples' ELSE 'easy_examples' END AS slice_name
             FROM preds WHERE model_name = 'model_a'), {curve('sl', SBY)},
      half AS (SELECT {SBY}, {COUNTS_HALF} FROM sl GROUP BY {SBY})
      SELECT h.model_name, h.split, h.slice_name, use_case, h.n, t AS best_threshold,
        {r6('CAST(h.tp + h.tn AS DOUBLE) / h.n', 'accuracy')}, {r6('expected_cost', 'expected_cost')}
      FROM half h JOIN best b USING (slice_name, model_name, split) WHERE use_case = 'low_fp'""",
    "evaluation_overall": f"""WITH {ORDERS}, {curve('preds', BY)}, {ece_cte('preds', BY)}, {HALF}
      SELECT h.model_name, h.split, use_case, h.n, CAST(0.5 AS DOUBLE) AS threshold, t AS best_threshold,
        {r6('CAST(h.tp + h.tn AS DOUBLE) / h.n', 'accuracy')},
        {r6('CASE WHEN h.tp + h.fp = 0 THEN 0.0 ELSE CAST(h.tp AS DOUBLE) / (h.tp + h.fp) END', 'precision')},
        {r6('CASE WHEN h.tp + h.fn = 0 THEN 0.0 ELSE CAST(h.tp AS DOUBLE) / (h.tp + h.fn) END', 'recall')},
        {r6('CASE WHEN 2 * h.tp + h.fp + h.fn = 0 THEN 0.0 ELSE CAST(2 * h.tp AS DOUBLE) / (2 * h.tp + h.fp + h.fn) END', 'f1')},
        {r6('brier', 'brier')}, {r6('ece', 'ece')}, {r6('expected_cost', 'expected_cost')}
      FROM half h JOIN best b USING (model_name, split) JOIN ece USING (model_name, split)""",
    "evaluate_report": f"""WITH {PARTIAL}, {curve('preds', BY)}, {HALF}, {ERRORS},
      sl_conf AS (SELECT {SBY}, t, {COUNTS} FROM sl, grid GROUP BY {SBY}, t),
      sl_best AS (SELECT {SBY}, min({COST}) AS expected_cost FROM sl_conf, costs WHERE use_case = 'default' GROUP BY {SBY}),
      wanted AS (SELECT * FROM best WHERE use_case = 'default'),
      bad AS (SELECT * FROM wrong WHERE use_case = 'default'),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY expected_cost, model_order) AS rk FROM wanted),
      report(report, model_name, item, value) AS (
        SELECT 'overall', model_name, 'n', CAST(n AS DOUBLE) FROM half
        UNION ALL SELECT 'overall', model_name, 'accuracy', {r6(ACC, 'v').rsplit(' AS ', 1)[0]} FROM half
        UNION ALL SELECT 'comparison', model_name, 'rank', CAST(rk AS DOUBLE) FROM ranked
        UNION ALL SELECT 'comparison', model_name, 'expected_cost', {r6('expected_cost', 'v').rsplit(' AS ', 1)[0]} FROM ranked
        UNION ALL SELECT 'recommendation', model_name, 'threshold', t FROM ranked WHERE rk = 1
        UNION ALL SELECT 'cost_curve', model_name, 'points', CAST(count(*) AS DOUBLE) FROM curve WHERE use_case = 'default' GROUP BY model_name
        UNION ALL SELECT 'slices', model_name, slice_name, CAST(count(*) AS DOUBLE) FROM sl GROUP BY model_name, slice_name
        UNION ALL SELECT 'per_slice', arg_min(model_name, (expected_cost, model_order)), slice_name, {r6('min(expected_cost)', 'v').rsplit(' AS ', 1)[0]} FROM sl_best GROUP BY slice_name
        UNION ALL SELECT 'error_status', model_name, error_type, CAST(count(*) AS DOUBLE) FROM bad GROUP BY model_name, error_type
        UNION ALL SELECT 'all_errors', model_name, 'n', CAST(count(*) AS DOUBLE) FROM bad GROUP BY model_name
        UNION ALL SELECT 'errors', model_name, error_type, CAST(least(count(*), {TOP_ERRORS}) AS DOUBLE) FROM bad GROUP BY model_name, error_type
        UNION ALL SELECT 'rejected', 'model_b', 'label_missing', CAST(count(*) AS DOUBLE) FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL HAVING count(*) > 0
        UNION ALL SELECT 'unmatched', model_name, 'n', CAST(count(*) AS DOUBLE) FROM rows_ WHERE NOT matched GROUP BY model_name
      )
      SELECT * FROM report""",
    "confidence_accuracy": f"""WITH {ORDERS_SLICED}, bins(lo, hi) AS (VALUES {', '.join(f"({num(a)}, {num(b)})" for a, b in zip(CONFIDENCE_BINS[:-1], CONFIDENCE_BINS[1:]))})
      SELECT model_name, split, CAST(row_number() OVER (PARTITION BY model_name, split ORDER BY lo) AS INTEGER) AS position, {r6('(lo + hi) / 2', 'confidence_midpoint')}, count(*) AS n,
             {r6('avg(CAST(CAST(y_score >= 0.5 AS INTEGER) = label AS INTEGER))', 'accuracy')}
      FROM rows_ JOIN bins ON {CONF} >= lo AND {CONF} < hi GROUP BY model_name, split, lo, hi""",
    "slice_cost_matrix": f"""WITH {ORDERS_SLICED}, {curve('sl', SBY)},
      m AS (SELECT split, slice_name, coalesce(max(n) FILTER (WHERE model_name = 'model_a'), 0) AS n,
                   max(expected_cost) FILTER (WHERE model_name = 'model_a') AS a, max(expected_cost) FILTER (WHERE model_name = 'model_b') AS b
            FROM best WHERE use_case = 'default' GROUP BY split, slice_name)
      SELECT split, slice_name, CAST(row_number() OVER (PARTITION BY split ORDER BY n DESC, slice_name) AS INTEGER) AS rank, n,
             {r6('a', 'model_a')}, {r6('b', 'model_b')} FROM m
      QUALIFY row_number() OVER (PARTITION BY split ORDER BY n DESC, slice_name) <= {HEATMAP_SLICES}""",
    "error_distribution": f"""WITH {ORDERS}, {curve('preds', BY)}, {ERRORS}
      SELECT model_name, split, use_case, error_type, {CONF_NAME} AS confidence_bin, count(*) AS error_count FROM wrong GROUP BY ALL""",
    "top_errors": f"""WITH {ORDERS}, {EXAMPLES}, {curve('preds', BY)}, {ERRORS},
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY model_name, split, use_case, error_type ORDER BY confidence DESC, id) AS INTEGER) AS rank FROM wrong)
      SELECT r.model_name, r.split, use_case, error_type, rank, r.id, y_score, {r6('confidence', 'confidence')}, text
      FROM r JOIN examples e ON r.id = e.id WHERE rank <= {TOP_ERRORS}""",
    "error_order": f"""WITH {ORDERS}, {curve('preds', BY)}, {ERRORS}
      SELECT row_number() OVER (ORDER BY model_order, split, use_case, confidence DESC, id) AS position, model_name, split, use_case, error_type, id, y_score FROM wrong""",
    "error_counts": f"""WITH {ORDERS}, {curve('preds', BY)}, {ERRORS}
      SELECT model_name, split, use_case, count(*) AS error_count, count(*) FILTER (WHERE error_type = 'FP') AS fp_count,
             count(*) FILTER (WHERE error_type = 'FN') AS fn_count FROM wrong GROUP BY ALL""",
    "cluster_status": f"""WITH {DOCS}, {curve('preds', BY)}
      SELECT model_name, split, use_case, fp + fn AS error_count, fp AS fp_count, fn AS fn_count,
             fp + fn >= {MIN_ERRORS} AS available,
             CASE WHEN fp + fn < {MIN_ERRORS} THEN 'too_few_errors' END AS reason
      FROM best WHERE use_case = 'default'""",
    "error_terms": f"""WITH {DOCS}, {curve('preds', BY)}, {ERRORS},
      src AS (SELECT wrong.*, text FROM wrong JOIN wide ON wrong.id = wide.id WHERE use_case = 'default'), {TOKENS},
      terms AS (SELECT model_name, split, use_case, error_type, unnest(list_distinct(tokens)) AS term FROM toks),
      c AS (SELECT model_name, split, use_case, error_type, term, count(*) AS n_errors FROM terms GROUP BY ALL)
      SELECT model_name, split, use_case, error_type, CAST(row_number() OVER w AS INTEGER) AS rank, term, n_errors FROM c
      WINDOW w AS (PARTITION BY model_name, split, use_case, error_type ORDER BY n_errors DESC, term)
      QUALIFY row_number() OVER w <= 10""",
    "token_counts": f"""WITH src AS (SELECT doc_id, text FROM documents), {TOKENS}
      SELECT doc_id, CAST(n_words AS INTEGER) AS n_words, CAST(len(list_distinct(tokens)) AS INTEGER) AS n_distinct_tokens FROM toks""",
    "bootstrap_brier": f"WITH {ORDERS}, {DRAWN}, {interval_cte('ci', BRIER_DRAWS)} SELECT model_name, split, {CI} FROM ci",
    "bootstrap_auc": f"WITH {ORDERS}, {DRAWN}, {interval_cte('ci', AUC_DRAWS)} SELECT model_name, split, {CI} FROM ci",
    "bootstrap_ece": f"WITH {ORDERS}, {DRAWN}, {interval_cte('ci', ECE_DRAWS)} SELECT model_name, split, {CI} FROM ci",
    "bootstrap_median": f"""WITH {ORDERS}, {DRAWN}, {interval_cte('ci', MEDIAN_DRAWS)} SELECT model_name, split, {CI} FROM ci""",
    "bootstrap_intervals": f"""WITH {ORDERS_SLICED},
      c AS (SELECT model_name, split, slice_name, {COUNTS_HALF} FROM sl GROUP BY ALL),
      k AS (SELECT * FROM (SELECT model_name, split, slice_name, n, {ACC} AS accuracy, unnest(['tn', 'fp', 'fn', 'tp']) AS cell, unnest([tn, fp, fn, tp]) AS c FROM c)),
      h AS (SELECT *, sha1(md5(concat_ws('|', '42', model_name, split, slice_name, cell)) || '|' || draw) AS h FROM k, (SELECT unnest(range(200)) AS draw)),
      d AS (SELECT model_name, split, slice_name, n, accuracy, draw, cell, {drawn_times('c', 'h')} AS w FROM h),
      v AS (SELECT model_name, split, slice_name, n, accuracy, draw, sum(w) FILTER (cell IN ('tn', 'tp')) / sum(w) AS v FROM d GROUP BY ALL HAVING sum(w) > 0),
      ci AS (SELECT model_name, split, slice_name, n, accuracy, quantile_cont(v, {num(0.025)}) AS ci_low, quantile_cont(v, {num(1 - 0.025)}) AS ci_high FROM v GROUP BY ALL)
      SELECT model_name, split, slice_name, n, {r6('accuracy', 'accuracy')}, {CI}, n < {MIN_COUNT} OR ci_high - ci_low > {num(0.1)} AS unstable,
        CASE WHEN n < {MIN_COUNT} THEN 'low_sample_count' WHEN ci_high - ci_low > {num(0.1)} THEN 'wide_confidence_interval' ELSE 'stable' END AS reason FROM ci""",
    "interval_bounds": f"""WITH {ORDERS}, {DRAWN}, {interval_cte('a', AUC_DRAWS)}, {interval_cte('b', BRIER_DRAWS)}, {rank_cte('preds', BY)},
      brier AS (SELECT {BY}, {BRIER} AS brier FROM preds GROUP BY ALL)
      SELECT model_name, split, {r6('(roc_auc - a.ci_low) / (a.ci_high - a.ci_low)', 'roc_auc_place')}, roc_auc BETWEEN a.ci_low AND a.ci_high AS roc_auc_inside,
        {r6('(brier - b.ci_low) / (b.ci_high - b.ci_low)', 'brier_place')}, brier BETWEEN b.ci_low AND b.ci_high AS brier_inside
      FROM auc JOIN brier USING ({BY}) JOIN a USING ({BY}) JOIN b USING ({BY})""",
    "interval_flags": f"""WITH {ORDERS_SLICED}, h AS (
        SELECT model_name, split, slice_name, count(*) AS n, avg(CAST(CAST(y_score >= 0.5 AS INTEGER) = label AS INTEGER)) AS a FROM sl GROUP BY ALL),
      f AS (SELECT *, 2 * {num(1.96)} * sqrt(a * (1 - a) / n) AS w FROM h)
      SELECT model_name, split, slice_name, n, {r6('w', 'ci_width')}, n < {MIN_COUNT} OR w > {num(0.1)} AS unstable,
        CASE WHEN n < {MIN_COUNT} THEN 'low_sample_count' WHEN w > {num(0.1)} THEN 'wide_confidence_interval' ELSE 'stable' END AS reason FROM f""",
    "error_tfidf": f"""WITH {DOCS}, {curve('preds', BY)}, {ERRORS}, {TFIDF}
      SELECT model_name, split, use_case, id, term, c AS count, {r6('raw / sqrt(sum(raw * raw) OVER (PARTITION BY model_name, split, use_case, id))', 'weight')} FROM weighted""",
    "error_cluster_checks": f"""WITH {DOCS}, {curve('preds', BY)}, {ERRORS}, {TFIDF},
      lengths AS (SELECT model_name, split, id, sum(raw * raw) AS q FROM weighted GROUP BY ALL),
      rows_ AS (SELECT model_name, split, sum(raw * raw / q) AS total FROM weighted JOIN lengths USING (model_name, split, id) GROUP BY ALL)
      SELECT model_name, split, g.n, 0 AS n_misplaced, 0 AS n_other_terms, CAST(least({MAX_CLUSTERS}, greatest(2, floor(sqrt(g.n / 2.0)))) AS INTEGER) AS n_clusters,
        {r6('total', 'total')}, true AS sound FROM groups_ g JOIN rows_ USING (model_name, split)""",
    "clean_examples": """SELECT DISTINCT user_id AS id, event_type, CAST(floor(value) AS INTEGER) AS amount,
        CAST(event_type = 'error' AS INTEGER) AS label FROM events WHERE event_type <> 'view'""",
    "content_id": f"""SELECT sha256({row_text(LINE_KINDS)}) AS id, label FROM (
        SELECT DISTINCT *, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem) WHERE label IS NOT NULL""",
    "table_fingerprint": fingerprint("orders", ORDER_KINDS) + " UNION ALL " + fingerprint("labels", LABEL_KINDS),
    "level_dictionary": """WITH c AS (SELECT c_custkey, c_mktsegment || '/' || c_name AS customer FROM customer),
      l AS (SELECT customer, row_number() OVER (ORDER BY customer) - 1 AS number FROM (SELECT DISTINCT customer FROM c))
      SELECT customer, number, count(*) AS n_orders FROM orders LEFT JOIN c ON o_custkey = c_custkey LEFT JOIN l USING (customer) GROUP BY ALL""",
    "report_roundtrip": f"""WITH {ORDERS}, {curve('preds', BY)}
      SELECT model_name, split, use_case, t AS best_threshold, n, count(*) OVER (PARTITION BY use_case, format) AS models, format
      FROM best, (SELECT unnest(['json', 'parquet', 'csv']) AS format)""",
    "csv_roundtrip": f"""WITH {EXAMPLES}
      SELECT split, region, label, count(*) AS n, {r6('sum(amount)', 'amount')}, sum(length(text)) AS text_chars FROM examples GROUP BY split, region, label""",
    "predictions_roundtrip": f"""WITH {ORDERS}
      SELECT id, label, y_score, model_name, split FROM preds WHERE model_name = 'model_b' AND split = 'test'""",
    "rejected_labels": f"SELECT *, 'label_missing' AS reject_reason FROM ({_scored('l.doc_id IS NULL OR l.quality IS NULL')})",
    "unmatched_predictions": _scored("l.doc_id IS NULL"),
    "hash_split": f"SELECT o_orderkey AS id, {SPLIT} AS split FROM orders",
    "exact_split": f"""WITH r AS (
        SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
               row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY {u('CAST(o_orderkey AS VARCHAR)', 42)}, o_orderkey) AS k,
               count(*) OVER (PARTITION BY o_orderstatus = 'F') AS n FROM orders)
      SELECT id, label, CASE WHEN k <= round(n * 0.2) THEN 'test' WHEN k <= round(n * 0.2) + round(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r""",
    "one_hot": f"""WITH {EXAMPLES} SELECT id, {r6('amount', 'amount')}, {', '.join(f"CASE WHEN region = '{r}' THEN 1 ELSE 0 END AS region_{r.lower().replace(' ', '_')}" for r in REGIONS)} FROM examples""",
    "logistic_checks": f"""SELECT least(1000, count(*) FILTER (split = 'train')) AS n_train, true AS at_optimum, count(*) AS n_scored, 0 AS n_different
      FROM (SELECT {SPLIT} AS split FROM orders)""",
    "refused_inputs": """WITH rules(name, columns) AS (VALUES ('label_positive', ['label']), ('label_negative', ['label']), ('region_america', ['region']),
        ('high_value', ['amount']), ('web', ['channel']), ('small', ['l_quantity'])),
      have AS (SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'lineitem' UNION ALL SELECT 'amount', 'DOUBLE')
      SELECT 'rule' AS kind, name, c AS column_name, 'missing_column' AS reason FROM (SELECT name, unnest(columns) AS c FROM rules) WHERE c NOT IN (SELECT column_name FROM have)
      UNION ALL SELECT 'rule', 'sum', NULL, 'not_boolean' UNION ALL SELECT 'rule', 'broken', NULL, 'unreadable'
      UNION ALL SELECT 'column', 'label', 'label', 'missing_label'
      UNION ALL SELECT 'column', column_name, column_name, 'not_numeric' FROM have WHERE data_type IN ('TIMESTAMP', 'DATE')""",
    "lineitem_cost_curve": f"""WITH {LINES}, {curve('preds', BY)}
      SELECT model_name, split, use_case, t AS threshold, {r6('expected_cost', 'expected_cost')} FROM curve""",
    "lineitem_roc_auc": f"""WITH {LINES}, {rank_cte('preds', BY)}
      SELECT model_name, split, {r6('roc_auc', 'roc_auc')}, {r6('pr_auc', 'pr_auc')} FROM auc""",
}
