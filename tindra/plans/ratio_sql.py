"""The Gestalt ratio for an engine that only has SQL: matching blocks by recursion.

Equal characters of a pair of texts are points (i, j); a common stretch is a run of points on a diagonal.
A segment's block is its longest run, of equal ones that which starts first in the first text, then in the
second; what lies before and after it are the next segments.  The ratio is twice all blocks' length over
both texts' length.
"""

from __future__ import annotations


def _blocks(segments: str) -> str:
    """The block of each segment (p, alo, ahi, blo, bhi) that has one."""
    runs = "SELECT s.*, m.i, m.j, m.i - row_number() OVER (PARTITION BY s.p, s.alo, s.blo, m.i - m.j ORDER BY m.i) AS run"
    points = f"{runs} FROM ({segments}) s JOIN points m ON m.p = s.p AND m.i >= s.alo AND m.i < s.ahi AND m.j >= s.blo AND m.j < s.bhi WHERE s.alo < s.ahi AND s.blo < s.bhi"
    lengths = f"SELECT p, alo, ahi, blo, bhi, count(*) AS n, min(i) AS i, min(j) AS j FROM ({points}) x GROUP BY p, alo, ahi, blo, bhi, i - j, run"
    return f"SELECT p, alo, ahi, blo, bhi, best.i AS i, best.j AS j, -best.n AS n FROM (SELECT p, alo, ahi, blo, bhi, min(struct_pack(n := -n, i := i, j := j)) AS best FROM ({lengths}) y GROUP BY p, alo, ahi, blo, bhi) z"


def ratios(pairs: str) -> str:
    """Parts of a WITH RECURSIVE list that end in ``ratios`` (a, b, ratio): of all pairs (a, b, least) of
    the statement whose ratio may reach ``least`` by the characters that both have."""
    letters = "SELECT x, c, count(*) AS n FROM (SELECT x, unnest(string_split(x, '')) AS c FROM (SELECT a AS x FROM asked UNION SELECT b FROM asked) t) u GROUP BY x, c"
    may = "SELECT asked.a, asked.b FROM asked JOIN letters l ON l.x = asked.a JOIN letters r ON r.x = asked.b AND r.c = l.c GROUP BY asked.a, asked.b HAVING 2 * sum(least(l.n, r.n)) >= (length(asked.a) + length(asked.b)) * min(asked.least) - 1e-6"
    chars = lambda c: f"SELECT {c}, unnest(string_split({c}, '')) AS ch, generate_subscripts(string_split({c}, ''), 1) - 1 AS k FROM (SELECT DISTINCT {c} FROM pair) t"
    children = "SELECT p, unnest([alo, i + n]) AS alo, unnest([i, ahi]) AS ahi, unnest([blo, j + n]) AS blo, unnest([j, bhi]) AS bhi FROM blocks"
    return f"""asked AS MATERIALIZED (SELECT a, b, min(least) AS least FROM ({pairs}) t WHERE a <> '' AND b <> '' AND 2 * least(length(a), length(b)) >= (length(a) + length(b)) * least - 1e-6 GROUP BY a, b),
      letters AS MATERIALIZED ({letters}), pair AS MATERIALIZED (SELECT row_number() OVER () AS p, a, b FROM ({may}) t),
      points AS MATERIALIZED (SELECT pair.p, l.k AS i, r.k AS j FROM pair JOIN ({chars('a')}) l ON l.a = pair.a JOIN ({chars('b')}) r ON r.b = pair.b AND r.ch = l.ch),
      blocks AS ({_blocks("SELECT p, cast(0 AS bigint) AS alo, cast(length(a) AS bigint) AS ahi, cast(0 AS bigint) AS blo, cast(length(b) AS bigint) AS bhi FROM pair")} UNION ALL {_blocks(children)}),
      ratios AS MATERIALIZED (SELECT a, b, 2.0::double * sum(n) / (length(a) + length(b)) AS ratio FROM pair JOIN blocks USING (p) GROUP BY a, b)"""


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def name_match(a: str, b: str, ratio: str) -> str:
    """1 where the shorter list of words leads the longer, else the best of ratio and share of words."""
    n = f"least(len({words(a)}), len({words(b)}))"
    shared = f"len(list_intersect({words(a)}, {words(b)}))"
    return f"CASE WHEN {n} > 0 AND {words(a)}[1:{n}] = {words(b)}[1:{n}] THEN 1.0::double ELSE greatest(coalesce({ratio}, 0), coalesce({shared}::double / nullif(len(list_distinct(list_concat({words(a)}, {words(b)}))), 0), 0)) END"
