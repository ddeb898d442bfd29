"""SQL for the sparse fits: screening and coordinate descent, step by step, for the queries' second opinion.

A problem is a set of cells and a target: member(pid, cell) and aim(pid, target), over zf(cell, gene, z)
and zr(cell, gene, z).
"""

from __future__ import annotations


def screened() -> str:
    """gm, cr, ty, sc and rk of all problems: moments, screening scores and the sources' order."""
    return (
        "gm AS (SELECT pid, a.gene AS s, b.gene AS t, avg(a.z * b.z) - avg(a.z) * avg(b.z) AS g FROM member JOIN zf a USING (cell) JOIN zf b USING (cell) GROUP BY 1, 2, 3), "
        "cr AS (SELECT pid, a.gene AS s, avg(a.z * b.z) - avg(a.z) * avg(b.z) AS c, avg(a.z) AS mx FROM member JOIN aim USING (pid) JOIN zf a USING (cell) JOIN zr b ON b.cell = member.cell AND b.gene = target GROUP BY 1, 2), "
        "ty AS (SELECT pid, avg(z) AS my, avg(z * z) - avg(z) * avg(z) AS v FROM member JOIN aim USING (pid) JOIN zr ON zr.cell = member.cell AND zr.gene = target GROUP BY 1), "
        "sc AS (SELECT cr.pid, cr.s, target, c, mx, CASE WHEN cr.s = target THEN 0 ELSE abs(c) / sqrt(g + 1e-12) END AS score FROM cr JOIN aim USING (pid) JOIN gm ON gm.pid = cr.pid AND gm.s = cr.s AND gm.t = cr.s), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, s) AS k FROM sc WHERE s <> target)"
    )


def descended(l1: float, l2: float, steps: int = 60, tolerance: float = 1e-6) -> str:
    """problems and solved(pid, n, g, c, b) from chosen(pid, s, c, k): the coefficients in the order of k."""
    return (
        "gl AS (SELECT a.pid, list(g ORDER BY a.k, b.k) AS g FROM chosen a JOIN chosen b ON a.pid = b.pid JOIN gm ON gm.pid = a.pid AND gm.s = a.s AND gm.t = b.s GROUP BY 1), "
        "problems AS (SELECT pid, len(c) AS n, g, c FROM (SELECT pid, list(c ORDER BY k) AS c FROM chosen GROUP BY 1) JOIN gl USING (pid)), "
        "descent(pid, n, g, c, b, step, largest, done) AS (SELECT pid, n, g, c, list_transform(range(n), lambda i: 0e0), 0, 0e0, false FROM problems UNION ALL "
        f"SELECT pid, n, g, c, list_transform(range(1, n + 1), lambda i: CASE WHEN i = j + 1 THEN new ELSE b[i] END), step + 1, top, (j = n - 1 AND top < {tolerance!r}) OR step + 1 >= {steps} * n FROM ("
        "SELECT *, CASE WHEN j = 0 THEN abs(new - b[j + 1]) ELSE greatest(largest, abs(new - b[j + 1])) END AS top FROM ("
        f"SELECT *, sign(rho) * greatest(abs(rho) - {l1!r}, 0e0) / greatest({l2!r} + g[j * n + j + 1], 1e-12) AS new FROM ("
        "SELECT *, c[j + 1] - list_sum(list_transform(range(1, n + 1), lambda i: g[j * n + i] * b[i])) + g[j * n + j + 1] * b[j + 1] AS rho FROM (SELECT *, step % n AS j FROM descent WHERE NOT done))))), "
        "solved AS (SELECT pid, n, g, c, b FROM descent WHERE done)"
    )


def fitted(l1: float, l2: float = 0.05) -> str:
    """eff(pid, target, s, score, beta, imp) and ic(pid, intercept): the fits on the eight best sources."""
    return (
        f"{screened()}, chosen AS (SELECT * FROM rk WHERE k <= 8), {descended(l1, l2)}, "
        "im AS (SELECT pid, b, CASE WHEN v > 1e-12 THEN (2 * list_sum(list_transform(range(1, n + 1), lambda i: b[i] * c[i])) - list_sum(list_transform(range(0, n * n), lambda q: b[q // n + 1] * b[q % n + 1] * g[q + 1]))) / v ELSE 0 END AS imp FROM solved JOIN ty USING (pid)), "
        "eff AS (SELECT sc.pid, sc.target, sc.s, sc.score, sc.mx, imp, CASE WHEN imp >= 0 THEN coalesce(b[k], 0e0) ELSE 0e0 END AS beta FROM sc JOIN im USING (pid) LEFT JOIN chosen ON chosen.pid = sc.pid AND chosen.s = sc.s), "
        "ic AS (SELECT pid, any_value(my) - sum(beta * mx) AS intercept FROM eff JOIN ty USING (pid) GROUP BY 1)"
    )
