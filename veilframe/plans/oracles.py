"""DuckDB SQL for the registered queries: independent formulations over the same tables."""

from __future__ import annotations

from itertools import combinations

from . import fixtures as fx

_PEOPLE = "o_orderkey, o_totalprice, c_acctbal, o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey"
_FRAMES = {
    "people": f"SELECT {_PEOPLE} FROM orders JOIN customer ON o_custkey = c_custkey",
    "mirrored": f"SELECT {_PEOPLE} FROM orders JOIN (SELECT *, (SELECT max(c_custkey) FROM customer) - c_custkey AS mirror_key FROM customer) ON o_custkey = mirror_key",
    "messy": """SELECT o_orderkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN ' ? ' ELSE ' ' || c_mktsegment || ' ' END AS segment,
        o_orderpriority || '. ' AS priority, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE floor(o_totalprice)::BIGINT::VARCHAR END AS price_text,
        CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, nullif(c_mktsegment, 'MACHINERY') AS known_segment, c_nationkey FROM people""",
    "holders": "SELECT 'r' AS side, c_custkey AS key, c_nationkey::VARCHAR AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_suppkey, s_nationkey::VARCHAR, s_acctbal FROM supplier",
}


def sql(body: str, **more: str) -> str:
    """body with the frames and further tables as common table expressions."""
    tables = ", ".join(f"{name} AS ({text})" for name, text in (_FRAMES | more).items())
    return f"WITH RECURSIVE {tables} {body}"


def r6(x: str) -> str:
    return f"round(({x})::DOUBLE, 6) + 0.0"


def u(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || ({key})::VARCHAR), 1, 8))::UBIGINT::DOUBLE / 4294967296e0)"


def pdf(x: str, m: str, s: str) -> str:
    return f"(exp(-0.5e0 * (({x} - {m}) / {s}) * (({x} - {m}) / {s})) / ({s} * sqrt(2e0 * pi())))"


def laplace(x: str, scale: float) -> str:
    return f"(-{scale}::DOUBLE * sign({x} - 0.5e0)::DOUBLE * ln(greatest(1e0 - 2e0 * abs({x} - 0.5e0), 1e-300)))"


_W, _M, _S = (fx.MODES[k] for k in ("weights", "means", "deviations"))
_DENSE = [f"({w}::DOUBLE * {pdf('x', f'{m}::DOUBLE', f'{s}::DOUBLE')})" for w, m, s in zip(_W, _M, _S)]
_BALANCE = f"SELECT c_custkey, c_acctbal AS x, {u('mode', 'c_custkey')} AS u FROM customer"
_POSTERIOR = "SELECT c_custkey, x, u, " + ", ".join(f"{d} / ({' + '.join(_DENSE)} + 1e-8) AS p{i}" for i, d in enumerate(_DENSE)) + " FROM b"
_MODE = "SELECT *, CASE WHEN p0 > u * (p0 + p1 + p2) THEN 0 WHEN p0 + p1 > u * (p0 + p1 + p2) THEN 1 ELSE 2 END AS mode FROM p"
_LIST = lambda v: "[" + ", ".join(f"{x}::DOUBLE" for x in v) + "]"
_SCALAR = f"greatest(-1e0, least(1e0, (x - {_LIST(_M)}[mode + 1]) / (4e0 * {_LIST(_S)}[mode + 1])))"
_SEGMENTS = "SELECT c_mktsegment AS v, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS k FROM customer GROUP BY 1"


def _cut(table: str, column: str, q: int) -> str:
    """Edges with their number, duplicates dropped."""
    points = ", ".join(f"{k / q!r}" for k in range(q + 1))
    return f"SELECT e, row_number() OVER (ORDER BY e) - 1 AS k FROM (SELECT DISTINCT unnest(quantile_cont({column}, [{points}])) AS e FROM {table})"


def _labelled(q: int) -> str:
    """The label of each bin, for edges that whole numbers keep apart."""
    return "SELECT a.k, printf('(%.1f, %.1f]', round(a.e) - CASE WHEN a.k = 0 THEN 1 ELSE 0 END, round(b.e)) AS label, a.e AS lo, b.e AS hi FROM cuts a JOIN cuts b ON b.k = a.k + 1"


_NUMBERS = ["o_totalprice", "c_acctbal", "c_nationkey", "o_orderstatus", "c_mktsegment", "always"]


def _coded(frame: str) -> str:
    return (
        "SELECT o_totalprice::DOUBLE AS o_totalprice, CASE WHEN c_acctbal >= 0 THEN c_acctbal::DOUBLE END AS c_acctbal, c_nationkey::DOUBLE AS c_nationkey, "
        "CASE o_orderstatus WHEN 'F' THEN 0e0 WHEN 'O' THEN 1e0 ELSE 2e0 END AS o_orderstatus, "
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0e0 WHEN 'BUILDING' THEN 1e0 WHEN 'FURNITURE' THEN 2e0 WHEN 'HOUSEHOLD' THEN 3e0 END AS c_mktsegment, "
        f"1e0 AS always FROM {frame}"
    )


def _matrix(coded: str) -> str:
    cell = "SELECT '{a}' AS a, '{b}' AS b, CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END AS r FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    return " UNION ALL ".join(cell.format(a=a, b=b, t=coded) for a in _NUMBERS for b in _NUMBERS)


_CORRELATION = {"coded": _coded("people"), "m1": _matrix("coded")}
_DIFFERENCE = _CORRELATION | {"coded2": _coded("mirrored"), "m2": _matrix("coded2"), "d": "SELECT a, b, abs(coalesce(m1.r, 0) - coalesce(m2.r, 0)) AS difference FROM m1 JOIN m2 USING (a, b)"}
_PAIR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a}::VARCHAR AS x, {b}::VARCHAR AS y FROM lineitem" for a, b in combinations(fx.ITEMS, 2))
_GOWER = {
    "span": "SELECT max(balance) - min(balance) AS w FROM holders",
    "pairs": "SELECT s.key AS synthetic_key, r.key AS real_key, ((CASE WHEN s.nation = r.nation THEN 0e0 ELSE 1e0 END) + abs(s.balance - r.balance) / w) / 2e0 AS distance FROM (FROM holders WHERE side = 's') s, (FROM holders WHERE side = 'r') r, span",
}
_CLOSEST = {
    "span": _GOWER["span"],
    "near": "SELECT s.key AS synthetic_key, min(((CASE WHEN s.nation = r.nation THEN 0e0 ELSE 1e0 END) + abs(s.balance - r.balance) / w) / 2e0) AS distance FROM (FROM holders WHERE side = 'r') s, (FROM holders WHERE side = 's') r, span GROUP BY s.key",
}
_CELL = "parent || '|' || child"
_ORDER = "md5('42|' || o_orderkey)"
_INTERVALS = "SELECT {p} parent, value, coalesce(sum(n) OVER ({w} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(n) OVER ({w}), 0) AS lo, CASE WHEN row_number() OVER ({w} ORDER BY value DESC) = 1 THEN 1e0 ELSE sum(n) OVER ({w} ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(n) OVER ({w}) END AS hi FROM {t}"

# The network: counts of all pairs, the spanning tree (an edge is in it unless heavier ones connect its ends), and its walk.


def _network(table: str, columns: list[str]) -> dict[str, str]:
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a}::VARCHAR AS x, {b}::VARCHAR AS y FROM {table}" for a in columns for b in columns if a != b)
    other = lambda of: f"CASE WHEN e.a = {of}.node THEN e.b ELSE e.a END"
    return {
        "cells": f"SELECT a, b, x, y, count(*)::DOUBLE AS n FROM ({pairs}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL",
        "sums": "SELECT *, sum(n) OVER (PARTITION BY a, b) AS t, sum(n) OVER (PARTITION BY a, b, x) AS nx, sum(n) OVER (PARTITION BY a, b, y) AS ny FROM cells WHERE a < b",
        "ranked": "SELECT a, b, mi, row_number() OVER (ORDER BY mi DESC, a, b) AS r FROM (SELECT a, b, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM sums GROUP BY a, b)",
        "reach": f"SELECT r, a AS node FROM ranked UNION SELECT reach.r, {other('reach')} FROM reach JOIN ranked AS e ON e.r < reach.r AND reach.node IN (e.a, e.b)",
        "tree": "SELECT * FROM ranked WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.r = ranked.r AND reach.node = ranked.b)",
        "first_node": "SELECT node FROM (SELECT a AS node FROM tree UNION ALL SELECT b FROM tree) GROUP BY node ORDER BY count(*) DESC, node LIMIT 1",
        "walk": f"SELECT node, NULL::VARCHAR AS parent, 0 AS level FROM first_node UNION ALL SELECT {other('walk')}, walk.node, level + 1 FROM walk JOIN tree AS e ON walk.node IN (e.a, e.b) AND {other('walk')} IS DISTINCT FROM walk.parent",
    }


_BINNED = ["price_bin", "o_orderstatus", "o_orderpriority", "c_mktsegment"]
_KEYED = "(('0x' || substr(md5({key}), 1, 8))::UBIGINT::DOUBLE / 4294967296e0)"
_PRIVATE = {
    "cuts": _cut("people", "o_totalprice", 5),
    "labels_": _labelled(5),
    "binned": "SELECT label AS price_bin, o_orderstatus, o_orderpriority, c_mktsegment FROM people JOIN labels_ ON (o_totalprice > lo OR (k = 0 AND o_totalprice = lo)) AND o_totalprice <= hi",
    **_network("binned", _BINNED),
    "counts": "SELECT node, NULL::VARCHAR AS parent_value, x AS value, sum(n) AS n, 2e0 AS scale, x AS cell FROM walk JOIN cells ON a = node WHERE parent IS NULL AND b = (SELECT min(b) FROM cells WHERE a = node) GROUP BY node, x "
    "UNION ALL SELECT g.node, g.x, g.y, coalesce(n, 0), 6e0, g.x || '|' || g.y FROM (SELECT node, parent, p.x, c.x AS y FROM walk, LATERAL (SELECT DISTINCT x FROM cells WHERE a = parent) AS p, LATERAL (SELECT DISTINCT x FROM cells WHERE a = node) AS c WHERE parent IS NOT NULL) AS g "
    "LEFT JOIN cells ON cells.a = g.parent AND cells.b = g.node AND cells.x = g.x AND cells.y = g.y",
    "noisy": f"SELECT *, greatest(0e0, n + (-scale * sign(u - 0.5e0)::DOUBLE * ln(greatest(1e0 - 2e0 * abs(u - 0.5e0), 1e-300)))) AS c FROM (SELECT *, {_KEYED.format(key="'42|' || node || '|' || cell")} AS u FROM counts)",
    "probs": "SELECT node, parent_value, value, CASE WHEN sum(c) OVER w > 0 THEN c / sum(c) OVER w ELSE 1e0 / count(*) OVER w END AS prob FROM noisy WINDOW w AS (PARTITION BY node, parent_value)",
    "tables_": "SELECT *, coalesce(sum(prob) OVER (w ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(prob) OVER w, 0) AS lo, "
    "CASE WHEN row_number() OVER (w ORDER BY value DESC) = 1 THEN 1e0 ELSE sum(prob) OVER (w ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(prob) OVER w END AS hi FROM probs WINDOW w AS (PARTITION BY node, parent_value)",
}
_DRAWN = f"""SELECT id AS row, t.node, t.value FROM range({fx.SAMPLE_ROWS}) AS rows_(id), tables_ AS t JOIN walk ON walk.node = t.node AND walk.parent IS NULL
    WHERE {_KEYED.format(key="'42|draw|' || t.node || '|' || id")} >= lo AND {_KEYED.format(key="'42|draw|' || t.node || '|' || id")} < hi
    UNION ALL SELECT d.row, t.node, t.value FROM drawn AS d JOIN walk ON walk.parent = d.node JOIN tables_ AS t ON t.node = walk.node AND t.parent_value = d.value
    WHERE {_KEYED.format(key="'42|draw|' || t.node || '|' || d.row")} >= lo AND {_KEYED.format(key="'42|draw|' || t.node || '|' || d.row")} < hi"""

_SCANNED = sql("SELECT o_orderkey, nullif(c_mktsegment, 'MACHINERY') AS segment, o_orderpriority AS priority FROM people")

ORACLES: dict[str, str] = {
    "scan_csv": _SCANNED,
    "scan_csv_files": _SCANNED,
    "clean_sentinel": sql("SELECT o_orderkey, CASE WHEN trim(segment) <> '?' THEN segment END AS segment FROM messy"),
    "clean_trim": sql("SELECT o_orderkey, trim(segment) AS segment, trim(priority) AS priority FROM messy"),
    "fill_constant": sql("SELECT o_orderkey, coalesce(known_segment, 'Unknown') AS known_segment FROM messy"),
    "drop_column": sql("SELECT * EXCLUDE (c_acctbal, o_totalprice) FROM people"),
    "cast_string": sql("SELECT o_orderkey, c_nationkey::VARCHAR AS c_nationkey, floor(o_totalprice)::BIGINT::VARCHAR AS price FROM people"),
    "cast_numeric": sql("SELECT o_orderkey, c_nationkey::BIGINT AS nation, c_nationkey::DOUBLE AS nation_number FROM people"),
    "to_numeric": sql("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice) END::DOUBLE AS price_text FROM people"),
    "impute_median": sql(f"SELECT o_orderkey, {r6('coalesce(balance, (SELECT median(balance) FROM messy))')} AS balance FROM messy"),
    "impute_median_cross": sql(f"SELECT o_orderkey, {r6('coalesce(balance, (SELECT median(s_acctbal) FROM supplier))')} AS balance FROM messy"),
    "impute_mean": sql(f"SELECT o_orderkey, {r6('coalesce(balance, (SELECT avg(balance) FROM messy))')} AS balance FROM messy"),
    "strip_literal": sql("SELECT o_orderkey, o_orderpriority AS priority FROM people"),
    "drop_nulls": sql("SELECT o_orderkey, known_segment, balance FROM messy WHERE known_segment IS NOT NULL AND balance IS NOT NULL"),
    "infer_roles": sql(
        "SELECT column_name, CASE WHEN text THEN 'categorical' ELSE 'numeric' END AS by_type, CASE WHEN text OR n <= 10 THEN 'categorical' ELSE 'numeric' END AS at_10, CASE WHEN text OR n <= 20 THEN 'categorical' ELSE 'numeric' END AS at_20 FROM c",
        c=" UNION ALL ".join(f"SELECT '{c}' AS column_name, {str(c in ('o_orderstatus', 'o_orderpriority', 'c_mktsegment')).lower()} AS text, count(DISTINCT {c}) AS n FROM people" for c in fx.PEOPLE),
    ),
    "project": sql("SELECT c_mktsegment, o_orderkey, o_orderstatus FROM people"),
    "harmonise": sql(
        f"""SELECT o_orderkey, {r6('coalesce(balance, m)')} AS balance, coalesce(segment, 'nan') AS segment, {r6('c_nationkey')} AS c_nationkey, is_real
        FROM (SELECT o_orderkey, balance, known_segment AS segment, c_nationkey, 1::BIGINT AS is_real FROM messy
              UNION ALL SELECT o_orderkey, CASE WHEN c_acctbal > 1000 THEN c_acctbal END, c_mktsegment, c_nationkey, 0::BIGINT FROM mirrored), (SELECT median(balance) AS m FROM messy)"""
    ),
    "qcut_bins": sql("SELECT o_orderkey, greatest(0, (SELECT count(*) FROM cuts WHERE e < o_totalprice) - 1)::BIGINT AS bin FROM people", cuts=_cut("people", "o_totalprice", 5)),
    "qcut_labels": sql("SELECT o_orderkey, label FROM people JOIN labels_ ON (o_totalprice > lo OR (k = 0 AND o_totalprice = lo)) AND o_totalprice <= hi", cuts=_cut("people", "o_totalprice", 10), labels_=_labelled(10)),
    "zero_inflated_bin": sql(
        "SELECT o_orderkey, CASE WHEN x = 0 THEN 'None' WHEN x <= (SELECT quantile_cont(x, 0.9) FROM e) THEN 'Low' ELSE 'High' END AS level FROM e", e="SELECT o_orderkey, greatest(o_totalprice - 400000, 0) AS x FROM people"
    ),
    "topk_group": sql("SELECT o_orderkey, CASE WHEN c_nationkey IN (SELECT c_nationkey FROM people GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 5) THEN c_nationkey::VARCHAR ELSE 'Other' END AS c_nationkey FROM people"),
    "topk_values": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10",
    "category_codes": "SELECT value, (row_number() OVER (ORDER BY value) - 1)::BIGINT AS code FROM (SELECT c_nationkey::VARCHAR AS value FROM customer UNION SELECT s_nationkey::VARCHAR FROM supplier)",
    "label_encode": sql("SELECT o_orderkey, m.o_orderpriority, (SELECT count(DISTINCT p.o_orderpriority) FROM people p WHERE p.o_orderpriority < m.o_orderpriority)::BIGINT AS code FROM mirrored m"),
    "one_hot": sql("SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::BIGINT AS o_orderstatus_{v}" for v in "FOP") + " FROM people"),
    "one_hot_unknown": sql("SELECT o_orderkey, " + ", ".join(f"(c_mktsegment = '{v}')::BIGINT AS segment_{v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")) + " FROM people"),
    "freq_one_hot": sql(
        "SELECT o_orderkey, " + ", ".join(f"(k = {i + 1})::BIGINT AS slot_{i}" for i in range(5)) + " FROM people JOIN r USING (o_orderpriority)",
        r="SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS k FROM people GROUP BY 1",
    ),
    "standard_scale": sql(
        f"SELECT o_orderkey, {r6('(o_totalprice - pm) / ps')} AS o_totalprice, {r6('(c_acctbal - am) / sa')} AS c_acctbal FROM people, (SELECT avg(o_totalprice) AS pm, stddev_pop(o_totalprice) AS ps, avg(c_acctbal) AS am, stddev_pop(c_acctbal) AS sa FROM people)"
    ),
    "mode_posterior": sql(f"SELECT c_custkey, {r6('p0')} AS p0, {r6('p1')} AS p1, {r6('p2')} AS p2 FROM p", b=_BALANCE, p=_POSTERIOR),
    "mode_draw": sql("SELECT c_custkey, mode::BIGINT AS mode FROM d", b=_BALANCE, p=_POSTERIOR, d=_MODE),
    "mode_normalise": sql(f"SELECT c_custkey, {r6(_SCALAR)} AS scalar FROM d", b=_BALANCE, p=_POSTERIOR, d=_MODE),
    "mode_denormalise": sql(f"SELECT c_custkey, {r6(f'(u * 2 - 1) * 4e0 * {_LIST(_S)}[c_custkey % 3 + 1] + {_LIST(_M)}[c_custkey % 3 + 1]')} AS x FROM b", b=_BALANCE),
    "argmax_slot": "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT AS slot FROM embeddings",
    "filter_components": f"SELECT vec_id, count(x) AS n_kept, {r6('coalesce(sum(x::DOUBLE), 0)')} AS total FROM (SELECT vec_id, unnest(embedding) AS y FROM embeddings) t, LATERAL (SELECT CASE WHEN y > 0.01::DOUBLE THEN y END AS x) GROUP BY vec_id",
    "ctgan_transform": sql(
        f"SELECT c_custkey, {r6(_SCALAR)} AS s0, " + ", ".join(f"{r6(f'(mode = {i})::INT')} AS s{i + 1}" for i in range(3)) + ", " + ", ".join(f"{r6(f'(k = {i + 1})::INT')} AS s{i + 4}" for i in range(5)) + " FROM d JOIN customer USING (c_custkey) JOIN seg ON c_mktsegment = v",
        b=_BALANCE.replace(u("mode", "c_custkey"), u("7|c_acctbal", "c_custkey")), p=_POSTERIOR, d=_MODE, seg=_SEGMENTS,
    ),
    "ctgan_inverse": sql(
        f"SELECT c_custkey, {r6(f'{_SCALAR} * 4e0 * {_LIST(_S)}[mode + 1] + {_LIST(_M)}[mode + 1]')} AS c_acctbal, c_mktsegment FROM d JOIN customer USING (c_custkey)",
        b=_BALANCE.replace(u("mode", "c_custkey"), u("7|c_acctbal", "c_custkey")), p=_POSTERIOR, d=_MODE,
    ),
    "clip_range": sql("SELECT o_orderkey, greatest(c_acctbal, 0) AS low, least(greatest(c_acctbal, -1), 1) AS unit FROM people"),
    "gaussian_density": sql(f"SELECT o_orderkey, {r6(pdf('(c_acctbal / 1000)', '4.5e0', '2.5e0'))} AS density FROM people"),
    "union_tagged": sql(f"SELECT key, nation, {r6('balance')} AS balance, (side = 'r')::BIGINT AS is_real FROM holders"),
    "value_counts": sql("SELECT known_segment AS value, count(*) AS n FROM messy WHERE known_segment IS NOT NULL GROUP BY 1"),
    "value_shares": sql(f"SELECT known_segment AS value, {r6('count(*) / (SELECT count(known_segment) FROM messy)')} AS share FROM messy WHERE known_segment IS NOT NULL GROUP BY 1"),
    "marginals_categorical": sql(
        f"SELECT value, {r6('sum(a) / (SELECT count(known_segment) FROM messy)')} AS real_share, {r6('sum(b) / (SELECT count(*) FROM mirrored)')} AS synthetic_share FROM (SELECT known_segment AS value, 1 AS a, 0 AS b FROM messy UNION ALL SELECT c_mktsegment, 0, 1 FROM mirrored) WHERE value IS NOT NULL GROUP BY value"
    ),
    "distinct_counts": sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM messy" for c in ("known_segment", "price_text", "c_nationkey", "balance"))),
    "constant_columns": "SELECT unnest(['five', 'never']) AS column_name",
    "missing_counts": sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM messy" for c in ("known_segment", "balance", "priority"))),
    "correlation_matrix": sql(f"SELECT a, b, {r6('r')} AS r FROM m1", **_CORRELATION),
    "nan_correlation_columns": sql("SELECT a AS column_name FROM m1 GROUP BY a HAVING count(r) < count(*)", **_CORRELATION),
    "correlation_difference": sql(f"SELECT a, b, {r6('difference')} AS difference FROM d", **_DIFFERENCE),
    "correlation_norm": sql(f"SELECT {r6('sqrt(sum(difference * difference))')} AS norm FROM d", **_DIFFERENCE),
    "contingency": "SELECT parent, child, count(l_tax) AS n FROM (SELECT DISTINCT l_returnflag AS parent FROM lineitem) CROSS JOIN (SELECT DISTINCT l_linenumber::VARCHAR AS child FROM lineitem) LEFT JOIN lineitem ON l_returnflag = parent AND l_linenumber::VARCHAR = child GROUP BY 1, 2",
    "contingency_pivot": "SELECT l_linenumber::VARCHAR AS parent, " + ", ".join(f"count(*) FILTER (l_returnflag = '{v}') AS n_{v}" for v in "ANR") + " FROM lineitem GROUP BY 1",
    "mutual_information": sql(
        f"SELECT a, b, {r6('sum(n / t * ln(n * t / (nx * ny)))')} AS mi FROM (SELECT a, b, n::DOUBLE AS n, sum(n) OVER (PARTITION BY a, b)::DOUBLE AS t, sum(n) OVER (PARTITION BY a, b, x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY a, b, y)::DOUBLE AS ny FROM cells) GROUP BY a, b",
        pairs_=_PAIR, cells="SELECT a, b, x, y, count(*) AS n FROM pairs_ GROUP BY ALL",
    ),
    "quantiles": sql(" UNION ALL ".join(f"SELECT {r6(str(p))} AS probability, {r6(f'quantile_cont(o_totalprice, {p})')} AS value FROM people" for p in (0.0, 0.2, 0.25, 0.4, 0.5, 0.6, 0.75, 0.8, 0.9, 1.0))),
    "median": sql(f"SELECT {r6('median(balance)')} AS median FROM messy"),
    "box_stats": sql(
        f"""SELECT {r6('q1')} AS q1, {r6('q2')} AS median, {r6('q3')} AS q3, {r6('min(x) FILTER (x >= q1 - 1.5 * (q3 - q1))')} AS whisker_low, {r6('max(x) FILTER (x <= q3 + 1.5 * (q3 - q1))')} AS whisker_high,
        count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers
        FROM (SELECT o_totalprice AS x FROM people), (SELECT quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM people) GROUP BY q1, q2, q3"""
    ),
    "kde_curve": sql(
        f"SELECT {r6('g')} AS x, {r6('1000 * avg(' + pdf('g', 'c_acctbal', 'w') + ')')} AS density_per_1000 FROM grid, customer GROUP BY g",
        s="SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, stddev_samp(c_acctbal) * pow(count(*), -0.2) AS w FROM customer", grid="SELECT lo + (hi - lo) * i / 49 AS g, w FROM s, range(50) AS t(i)",
    ),
    "log_frequency": sql(f"SELECT value, {r6('ln(n + 1) / sum(ln(n + 1)) OVER ()')} AS weight FROM (SELECT c_mktsegment AS value, count(*) AS n FROM people GROUP BY 1)"),
    "aggregate_trials": f"SELECT l_returnflag AS metric, l_linestatus AS submetric, {r6('avg(l_tax)')} AS mean, {r6('stddev_pop(l_tax)')} AS std, {r6('min(l_tax)')} AS min, {r6('max(l_tax)')} AS max FROM lineitem GROUP BY 1, 2",
    "tree_degrees": sql(
        "SELECT node, count(*) AS degree, row_number() OVER (ORDER BY count(*) DESC, node) = 1 AS is_root FROM (SELECT unnest([a, b]) AS node FROM e) GROUP BY node",
        e="SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in fx.EDGES) + ") AS t(a, b)",
    ),
    "stratified_split": sql(f"SELECT o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_ORDER}, o_orderkey) <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.3e0))::BIGINT AS is_test FROM people"),
    "seeded_sample": sql(f"SELECT o_orderkey FROM people ORDER BY {_ORDER}, o_orderkey LIMIT {fx.SAMPLE_ROWS}"),
    "aligned_sample": sql(f"SELECT o_orderkey, p.c_mktsegment, m.c_mktsegment AS other_segment FROM people p JOIN mirrored m USING (o_orderkey) ORDER BY {_ORDER}, o_orderkey LIMIT {fx.SAMPLE_ROWS}"),
    "kfold_assign": sql(f"SELECT o_orderkey, ((row_number() OVER (ORDER BY {_ORDER}, o_orderkey) - 1) % 5)::BIGINT AS fold FROM people"),
    "categorical_draw": sql(
        f"SELECT o_orderkey, value AS drawn FROM (SELECT o_orderkey, {u('42', 'o_orderkey')} AS u FROM orders) JOIN i ON u >= lo AND u < hi",
        c="SELECT c_mktsegment AS value, (count(*) / (SELECT count(*) FROM people)::DOUBLE) AS n FROM people GROUP BY 1", i=_INTERVALS.format(p="NULL AS", w="", t="c"),
    ),
    "gower_pairs": sql(f"SELECT synthetic_key, real_key, {r6('distance')} AS distance FROM pairs", **_GOWER),
    "dcr_per_row": sql(f"SELECT synthetic_key, {r6('distance')} AS distance FROM near", **_CLOSEST),
    "dcr_summary": sql(f"SELECT {r6('avg(distance)')} AS mean, {r6('min(distance)')} AS min, {r6('max(distance)')} AS max FROM near", **_CLOSEST),
    "exact_matches": sql("SELECT count(*) AS matches FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey FROM people) JOIN (SELECT DISTINCT o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey FROM mirrored) USING (o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey)"),
    "exact_matches_positional": sql("SELECT count(*) AS matches FROM (SELECT c_mktsegment, o_orderpriority, o_orderstatus, c_nationkey FROM people INTERSECT SELECT o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey FROM mirrored)"),
    "exact_match_pct": sql(
        f"SELECT matches, n, {r6('100.0 * matches / n')} AS percentage FROM (SELECT count(*) AS matches FROM (SELECT o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey FROM mirrored INTERSECT SELECT o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey FROM people)), (SELECT count(*) AS n FROM mirrored)"
    ),
    "laplace_counts": sql(f"SELECT value, {r6('n + ' + laplace(u('noise', 'value'), 2.0))} AS noisy FROM (SELECT c_mktsegment AS value, count(*) AS n FROM people GROUP BY 1)"),
    "chow_liu_edges": sql(f"SELECT parent, node AS child, {r6('mi')} AS weight, level::BIGINT AS level FROM walk JOIN tree ON a = least(parent, node) AND b = greatest(parent, node)", **_network("lineitem", fx.ITEMS)),
    "privbayes_fit": sql(f"SELECT node, parent_value, value, {r6('prob')} AS prob, {r6('lo')} AS lo, {r6('hi')} AS hi FROM tables_", **_PRIVATE),
    "privbayes_sample": sql(f"SELECT {', '.join(f"max(value) FILTER (WHERE node = '{c}') AS {c}" for c in _BINNED)} FROM drawn GROUP BY row HAVING count(*) = {len(_BINNED)}", **_PRIVATE, drawn=_DRAWN),
    "frame_summary": sql(
        "SELECT position, column_name, data_type, n_present, (SELECT count(*) FROM messy) - n_present AS n_missing FROM (VALUES "
        + ", ".join(f"({i}, '{c}', '{t}', (SELECT count({c}) FROM messy))" for i, (c, t) in enumerate([("o_orderkey", "bigint"), ("segment", "string"), ("priority", "string"), ("price_text", "string"), ("balance", "double"), ("known_segment", "string"), ("c_nationkey", "int")]))
        + ") AS v(position, column_name, data_type, n_present)"
    ),
    "noisy_marginal": sql(
        f"SELECT value, {r6('c / sum(c) OVER ()')} AS prob FROM (SELECT l_returnflag AS value, greatest(0, count(*) + {laplace(u('42|l_returnflag', 'l_returnflag'), 2.0)}) AS c FROM lineitem GROUP BY 1)"
    ),
    "noisy_cpt": sql(
        f"SELECT parent AS parent_value, child AS value, {r6('c / sum(c) OVER (PARTITION BY parent)')} AS prob FROM (SELECT parent, child, greatest(0, count(l_tax) + {laplace(u('42|l_linenumber', _CELL), 4.0)}) AS c FROM (SELECT DISTINCT l_linestatus AS parent FROM lineitem) CROSS JOIN (SELECT DISTINCT l_linenumber::VARCHAR AS child FROM lineitem) LEFT JOIN lineitem ON l_linestatus = parent AND l_linenumber::VARCHAR = child GROUP BY 1, 2)"
    ),
    "ancestral_sample": sql(
        """SELECT d.row, a.value AS l_returnflag, b.value AS l_linestatus, c.value AS l_linenumber FROM d
        JOIN ia a ON u1 >= a.lo AND u1 < a.hi JOIN ib b ON b.parent = a.value AND u2 >= b.lo AND u2 < b.hi JOIN ic c ON c.parent = b.value AND u3 >= c.lo AND u3 < c.hi""",
        d=f"SELECT o_orderkey AS row, {u('42|l_returnflag', 'o_orderkey')} AS u1, {u('42|l_linestatus', 'o_orderkey')} AS u2, {u('42|l_linenumber', 'o_orderkey')} AS u3 FROM orders",
        ta="SELECT l_returnflag AS value, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS n FROM lineitem GROUP BY 1",
        tb="SELECT l_returnflag AS parent, l_linestatus AS value, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2",
        tc="SELECT l_linestatus AS parent, l_linenumber::VARCHAR AS value, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2",
        ia=_INTERVALS.format(p="NULL AS", w="", t="ta"), ib=_INTERVALS.format(p="", w="PARTITION BY parent", t="tb"), ic=_INTERVALS.format(p="", w="PARTITION BY parent", t="tc"),
    ),
    "prep_privbayes": sql(
        """SELECT o_orderkey, coalesce(nullif(trim(segment), '?'), 'Unknown') AS segment, coalesce(label, 'nan') AS price_text, trim(replace(priority, '.', '')) AS priority,
        CASE WHEN balance = 0 THEN 'None' WHEN balance <= (SELECT quantile_cont(balance, 0.9) FROM messy) THEN 'Low' ELSE 'High' END AS balance,
        CASE WHEN c_nationkey IN (SELECT c_nationkey FROM messy GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 2) THEN c_nationkey::VARCHAR ELSE 'Other' END AS c_nationkey
        FROM messy LEFT JOIN labels_ ON (try_cast(price_text AS DOUBLE) > lo OR (k = 0 AND try_cast(price_text AS DOUBLE) = lo)) AND try_cast(price_text AS DOUBLE) <= hi""",
        prices="SELECT try_cast(price_text AS DOUBLE) AS x FROM messy WHERE price_text <> 'n/a'", cuts=_cut("prices", "x", 5), labels_=_labelled(5),
    ),
    "prep_ctgan": sql(
        f"""SELECT o_orderkey, coalesce(nullif(trim(segment), '?'), 'Unknown') AS segment, trim(replace(priority, '.', '')) AS priority, {r6('try_cast(price_text AS DOUBLE)')} AS price_text, {r6('balance')} AS balance,
        CASE WHEN c_nationkey IN (SELECT c_nationkey FROM messy GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 5) THEN c_nationkey::VARCHAR ELSE 'Other' END AS c_nationkey FROM messy"""
    ),
    "prep_standard": sql(
        f"""SELECT o_orderkey, coalesce(nullif(trim(segment), '?'), 'Unknown') AS segment, trim(replace(priority, '.', '')) AS priority,
        {r6('coalesce(try_cast(price_text AS DOUBLE), (SELECT median(try_cast(price_text AS DOUBLE)) FROM messy))')} AS price_text, {r6('coalesce(balance, (SELECT median(balance) FROM messy))')} AS balance, c_nationkey::VARCHAR AS c_nationkey FROM messy"""
    ),
    "accuracy": f"SELECT {r6('avg((quality = toxic)::INT)')} AS accuracy FROM labels",
    "weighted_f1": f"""SELECT {r6('sum(s * 2.0 * h / (s + g)) / sum(s)')} AS weighted_f1 FROM (SELECT c, (SELECT count(*) FROM labels WHERE quality = c) AS s, (SELECT count(*) FROM labels WHERE toxic = c) AS g,
        (SELECT count(*) FROM labels WHERE quality = c AND toxic = c) AS h FROM (SELECT DISTINCT quality AS c FROM labels))""",
    "pmse_from_scores": f"SELECT {r6('avg(pow(' + u('score', 'o_orderkey') + ' - 0.5e0, 2))')} AS pmse FROM orders",
    "retention": f"SELECT model, {r6('b')} AS baseline, {r6('t')} AS tstr, {r6('CASE WHEN b > 0 THEN 100 * t / b END')} AS retention FROM (SELECT l_linestatus || '/' || l_returnflag AS model, round(avg((l_linenumber <= 4)::INT), 4) AS b, round(avg((l_tax <= 0.03)::INT), 4) AS t FROM lineitem GROUP BY 1)",
}
