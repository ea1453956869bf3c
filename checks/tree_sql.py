"""SQL that grows the same shallow tree as ``lupa.ml.surrogate``, level by level, as a chain of WITH views."""

from __future__ import annotations

from collections.abc import Sequence

OCTAVE, FINE, MIN_LEAF = 32, 4096, 5


def _bin(value: str) -> str:
    height = f"floor((log2(abs({value})) + 1075) * {OCTAVE}) + 1"
    return f"CAST(CASE WHEN {value} = 0 THEN 0 ELSE sign({value}) * ({height}) END AS BIGINT)"


def _impurity(outliers: str, normal: str) -> str:
    a, b = f"({outliers} * w_outlier)", f"({normal} * w_normal)"
    return f"CASE WHEN {a} + {b} > 0 THEN 2 * {a} * {b} / ({a} + {b}) ELSE 0 END"


def slots(rows: str, plain: Sequence[str], text: Sequence[str]) -> dict[str, str]:
    """Views of the rows and of their entries that are not zero, by slot; ``rows`` has ``label``."""
    tall = " UNION ALL ".join(
        [f"SELECT rid, {i} AS slot, CAST({c} AS DOUBLE) AS value FROM tree_rows WHERE {c} <> 0" for i, c in enumerate(plain)]
        + [
            f"SELECT rid, CAST(first + rank AS INT) AS slot, 1.0 AS value FROM tree_rows JOIN tree_levels ON level = {c} "
            f"AND \"column\" = '{c}' WHERE rank < size - 1"
            for c in text
        ]
    )
    levels = " UNION ALL ".join(f"SELECT DISTINCT {i} AS place, '{c}' AS \"column\", {c} AS level FROM tree_rows" for i, c in enumerate(text))
    names = " UNION ALL ".join([f"SELECT {i} AS slot, '{c}' AS name" for i, c in enumerate(plain)] + [
        "SELECT CAST(first + rank AS INT), \"column\" || '_' || level FROM tree_levels WHERE rank < size - 1"
    ])
    return {
        "tree_rows": f"SELECT row_number() OVER () AS rid, * FROM ({rows}) AS given",
        "tree_found": f"""SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY level DESC) - 1 AS rank,
            count(*) OVER (PARTITION BY "column") AS size FROM ({levels}) AS l""",
        "tree_first": f"""SELECT place, {len(plain)} + coalesce(sum(size - 1) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING), 0) AS first FROM (SELECT DISTINCT place, size FROM tree_found) AS s""",
        "tree_levels": "SELECT * FROM tree_found JOIN tree_first USING (place)",
        "tree_tall": tall,
        "tree_names": names,
        "tree_weights": """SELECT count(*) / (2 * count(*) FILTER (label = -1)) AS w_outlier,
            count(*) / (2 * count(*) FILTER (label <> -1)) AS w_normal FROM tree_rows""",
        "tree_at_0": "SELECT rid, label, 0 AS node FROM tree_rows",
    }


def _counts(value: str) -> str:
    return (
        f"count(*) FILTER (label = -1) AS outliers, count(*) FILTER (label <> -1) AS normal, min({value}) AS lowest, max({value}) AS highest"
    )


def _cuts(bins: str) -> str:
    """Borders of two bins with the rows to the left; ``bins`` has the rows before all bins as base_."""
    along = "OVER (PARTITION BY node, slot ORDER BY bin)"
    left = ["left_outliers", "left_normal"]
    right = ["(node_outliers - left_outliers)", "(node_normal - left_normal)"]
    return f"""
        SELECT node, slot, left_outliers, left_normal, lowest, next_highest, left_outliers - outliers AS base_outliers,
               left_normal - normal AS base_normal,
               CASE WHEN highest + (next - highest) / 2 < next THEN highest + (next - highest) / 2 ELSE highest END AS threshold,
               {_impurity("node_outliers", "node_normal")} - {_impurity(*left)} - {_impurity(*right)} AS decrease
        FROM (SELECT *, base_outliers + sum(outliers) {along} AS left_outliers, base_normal + sum(normal) {along} AS left_normal,
                     lead(lowest) {along} AS next, lead(highest) {along} AS next_highest FROM {bins}) AS b, tree_weights
        WHERE next IS NOT NULL AND left_outliers + left_normal >= {MIN_LEAF}
          AND node_outliers + node_normal - left_outliers - left_normal >= {MIN_LEAF}"""


def _first(cuts: str) -> str:
    return f"SELECT * FROM ({cuts}) AS c WHERE decrease > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY decrease DESC, slot, threshold) = 1"


def level(k: int) -> dict[str, str]:
    """Views that split the nodes of depth ``k`` and place the rows one level lower."""
    low, high = 2**k - 1, 2 ** (k + 1) - 2
    return {
        f"tree_open_{k}": f"""
            SELECT * FROM (SELECT node, count(*) FILTER (label = -1) AS node_outliers, count(*) FILTER (label <> -1) AS node_normal
                           FROM tree_at_{k} WHERE node BETWEEN {low} AND {high} GROUP BY node) AS s
            WHERE node_outliers > 0 AND node_normal > 0 AND node_outliers + node_normal >= {2 * MIN_LEAF}""",
        f"tree_held_{k}": f"""
            SELECT node, slot, {_bin("value")} AS bin, {_counts("value")} FROM tree_tall JOIN tree_at_{k} USING (rid)
            WHERE node IN (SELECT node FROM tree_open_{k}) GROUP BY ALL""",
        f"tree_bins_{k}": f"""
            SELECT *, 0 AS base_outliers, 0 AS base_normal FROM (
                SELECT * FROM tree_held_{k} UNION ALL
                SELECT node, slot, 0, node_outliers - o, node_normal - m, 0.0, 0.0 FROM tree_open_{k}
                JOIN (SELECT node, slot, sum(outliers) AS o, sum(normal) AS m FROM tree_held_{k} GROUP BY node, slot) AS s USING (node)
                WHERE node_outliers - o + node_normal - m > 0) AS b JOIN tree_open_{k} USING (node)""",
        f"tree_coarse_{k}": _first(_cuts(f"tree_bins_{k}")),
        f"tree_near_{k}": f"""
            SELECT node, slot, CAST(floor((value - lowest) / (next_highest - lowest) * {FINE}) AS BIGINT) AS bin,
                   base_outliers, base_normal, {_counts("value").replace("min(value) AS lowest, max(value) AS highest", "min(value) AS l, max(value) AS h")}
            FROM (SELECT a.*, c.slot, c.lowest, c.next_highest, c.base_outliers, c.base_normal, coalesce(t.value, 0) AS value
                  FROM tree_at_{k} AS a JOIN tree_coarse_{k} AS c USING (node)
                  LEFT JOIN tree_tall AS t ON a.rid = t.rid AND c.slot = t.slot) AS v
            WHERE value BETWEEN lowest AND next_highest GROUP BY node, slot, bin, base_outliers, base_normal""",
        f"tree_split_{k}": _first(_cuts(
            f"(SELECT node, slot, bin, base_outliers, base_normal, outliers, normal, l AS lowest, h AS highest, node_outliers, node_normal "
            f"FROM tree_near_{k} JOIN tree_open_{k} USING (node)) AS n"
        )),
        f"tree_at_{k + 1}": f"""
            SELECT a.rid, a.label, CASE WHEN s.slot IS NULL THEN a.node
                   ELSE 2 * a.node + CASE WHEN coalesce(t.value, 0) <= s.threshold THEN 1 ELSE 2 END END AS node
            FROM tree_at_{k} AS a LEFT JOIN tree_split_{k} AS s USING (node)
            LEFT JOIN tree_tall AS t ON a.rid = t.rid AND s.slot = t.slot""",
    }


def tree(rows: str, plain: Sequence[str], text: Sequence[str], depth: int) -> dict[str, str]:
    """All views up to ``tree_splits`` (one row for each split) and ``tree_leaves`` (one row for each leaf)."""
    views = slots(rows, plain, text)
    for k in range(depth):
        views |= level(k)
    views["tree_splits"] = " UNION ALL ".join(
        f"SELECT node, {k} AS depth, slot, threshold, decrease, node_outliers, node_normal FROM tree_split_{k} JOIN tree_open_{k} USING (node)"
        for k in range(depth)
    )
    views["tree_leaves"] = f"""
        SELECT *, row_number() OVER (ORDER BY (node + 1 - (1 << depth)) / (1 << depth)) - 1 AS leaf,
               leaf_outliers * w_outlier / (leaf_outliers * w_outlier + leaf_normal * w_normal) AS share_outlier
        FROM (SELECT node, CAST(floor(log2(node + 1)) AS INT) AS depth, count(*) FILTER (label = -1) AS leaf_outliers,
                     count(*) FILTER (label <> -1) AS leaf_normal FROM tree_at_{depth} GROUP BY node) AS l, tree_weights"""
    # each leaf with the splits above it, from the root down
    views["tree_ways"] = f"""
        SELECT leaf, s.depth AS step, name || CASE WHEN (((node + 1) >> (l.depth - s.depth - 1)) & 1) = 0 THEN ' <= ' ELSE ' > ' END
               || printf('%.2f', threshold) AS condition
        FROM tree_leaves AS l JOIN (SELECT node AS split, depth, slot, threshold FROM tree_splits) AS s
          ON s.depth < l.depth AND ((l.node + 1) >> (l.depth - s.depth)) - 1 = s.split
        JOIN tree_names USING (slot)"""
    return views
