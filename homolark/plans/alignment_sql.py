"""DuckDB SQL that aligns sequences by itself, to hold the kernels against: affine Smith-Waterman, a diagonal of a pair's cells at a time."""

from __future__ import annotations

import numpy as np

CELL = 1 << 24  # a cell's key is its score times this, less its place: the largest key is the earliest place of the best score
ROW = 1 << 12


def aligned(name: str, source: str, scores: np.ndarray, gap_open: int, gap_extend: int) -> str:
    """CTEs `name` (x, y, score, e1, e2): best score of each pair of `source` (x, y, ca, cb, n, m: residue codes and lengths), and where it ends."""
    low = -(1 << 40)
    m = "[" + ",".join(str(int(v)) for v in np.asarray(scores).ravel()) + "]"
    start = lambda v: f"list_transform(range(n + 1), lambda i: {v}::bigint)"
    return f"""{name}_d(x, y, n, m, k, h1, h2, e, f, top) as (
  select x, y, n, m, 1, {start(0)}, {start(0)}, {start(low)}, {start(low)}, 0::bigint from {source}
  union all
  select x, y, n, m, k + 1, h, h1, e2, f2, greatest(top, list_max(list_transform(range(1, n + 1), lambda i: h[i + 1] * {CELL} - (k - i) * {ROW} - (i - 1)))) from (
    select q.*, list_transform(range(n + 1), lambda i: case when i >= 1 and k + 1 - i between 1 and q.m
        then greatest(0, h2[i] + {m}[ca[i] * 26 + cb[k + 1 - i] + 1], e2[i + 1], f2[i + 1]) else 0 end) as h from (
      select d.*, p.ca, p.cb, list_transform(range(d.n + 1), lambda i: greatest(e[i + 1] + ({gap_extend}), h1[i + 1] + ({gap_open}))) as e2,
        list_transform(range(d.n + 1), lambda i: case when i >= 1 then greatest(f[i] + ({gap_extend}), h1[i] + ({gap_open})) else {low} end) as f2
      from {name}_d d join {source} p using (x, y) where d.k < d.n + d.m) q)),
{name} as (select x, y, score, (score * {CELL} - top) % {ROW} as e1, (score * {CELL} - top) // {ROW} as e2 from (
  select x, y, top, (top + {CELL - 1}) // {CELL} as score from (select x, y, max(top) as top from {name}_d group by x, y)))"""


CODES = "codes as (select abs_id, len, list_transform(range(1, len + 1), lambda i: ascii(seq[i]) - 65) as c from seqs)"


def pairs(name: str, where: str) -> str:
    return f"{name} as (select a.abs_id as x, b.abs_id as y, a.c as ca, b.c as cb, a.len as n, b.len as m from codes a join codes b on {where})"


def backwards(name: str, source: str, found: str) -> str:
    """The pairs of `source` up to the ends that `found` has, in reverse."""
    return f"""{name} as (select x, y, list_reverse(ca[1:(e1 + 1)::int]) as ca, list_reverse(cb[1:(e2 + 1)::int]) as cb, (e1 + 1)::int as n, (e2 + 1)::int as m
  from {source} join {found} using (x, y))"""
