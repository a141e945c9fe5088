"""DuckDB SQL that merges cluster sets by itself, to hold the clustering against: one recursive query whose row is the whole state, a meeting of two clusters a step.

The state is a queue of sets (lists of clusters, lists of ids) and the merge at hand: both sets, which of their clusters are dead, and the place (i, j). `passed` and `kinds` are
flat matrices over all pairs of ids: whether they pass, and what happens when clusters with these first members meet (0 nothing, 1 into the other, 2 into the own, 3 partial).
"""

from __future__ import annotations

import numpy as np

from . import alignment_sql as A


def edges(scaled: tuple, scores: np.ndarray, gap_open: int, gap_extend: int, max_uncovered: int, full_score: float) -> str:
    """CTEs `passed` and `kinds`, after `seqs`."""
    return ",\n".join([
        A.CODES, A.pairs("p", "a.abs_id < b.abs_id"), A.aligned("whole", "p", *scaled), A.pairs("every", "a.abs_id <> b.abs_id"),
        "ok as (select e.* from every e join whole w on w.x = least(e.x, e.y) and w.y = greatest(e.x, e.y) where w.score >= 65535)",
        A.aligned("ahead", "ok", scores, gap_open, gap_extend), A.backwards("back", "ok", "ahead"), A.aligned("behind", "back", scores, gap_open, gap_extend),
        f"""kind as (select x, y, case when n - b.e1 - 1 < {max_uncovered} and score > {full_score} then 1 when m - b.e2 - 1 < {max_uncovered} and score > {full_score} then 2 else 3 end as k
  from ok join (select x, y, score from ahead) using (x, y) join (select x, y, e1, e2 from behind) b using (x, y))""",
        """passed as (select list(k order by a.abs_id, b.abs_id) as kinds from seqs a, seqs b, lateral (select coalesce((select k from kind where x = a.abs_id and y = b.abs_id), 0) as k))"""])  # fmt: skip


def merged(mode: str, start: str) -> str:
    """CTEs `run` and `done` (q: the last set; l, r, ld, rd: the last merge). start: a query (q, lens) with the queue of sets and the sequences' lengths."""
    at = "kinds[l[i][1] * n + r[{0}][1] + 1]"
    swap = "len(q[1]) < len(q[2])" if mode == "parallel" else "false"
    first, second = f"case when {swap} then q[2] else q[1] end", f"case when {swap} then q[1] else q[2] end"
    live = lambda x: f"list_transform(list_filter(range(1, len({x}) + 1), lambda x: not {x}d[x]), lambda x: {x}[x])"
    if mode == "parallel":
        both = f"list_concat({live('r')}, {live('l')})"
        both = f"list_transform(list_sort(list_transform(range(1, len({both}) + 1), lambda x: {{'k': -lens[{both}[x][1] + 1], 'x': x}})), lambda s: ({both})[s.x])"
    else:
        both = f"list_concat({live('l')}, {live('r')})"
    put = lambda x, at, new: f"list_transform(range(1, len({x}) + 1), lambda x: case when x = {at} then {new} else {x}[x] end)"
    more = lambda a, b, which: f"list_concat({a}, list_filter({b}, lambda m: not list_contains({a}, m) and {which}))"
    tried = lambda a: f"kinds[{a}[1] * n + m + 1] > 0"
    c, o = "l[i]", "r[j2]"
    all_c, all_o = more(c, o, "true"), more(o, c, "true")
    some_c, some_o = more(c, o, f"(m = {o}[1] or {tried(c)})"), more(o, c, f"(m = {c}[1] or {tried(o)})")
    dead = lambda x, at: f"list_transform(range(1, len({x}) + 1), lambda x: {x}[x] or x = {at})"
    ends_row = "k in (1, 2)" if mode != "sequential" else "k = 1"
    over = "k in (1, 2)" if mode == "one" else "false"
    none = "list_transform({0}, lambda x: false)"
    return f"""begin as (select q[3:] as q, lens, kinds, len(lens) as n, {first} as l, {second} as r from ({start}), passed where len(q) > 1),
run as (
  select 0 as step, q, lens, kinds, n, l, r, {none.format('l')} as ld, {none.format('r')} as rd, 1::bigint as i, 1::bigint as j, false as fin from begin
  union all
  select step + 1, case when fin2 then q[3:] else q end, lens, kinds, n, case when fin2 then {first} else l end, case when fin2 then {second} else r end,
    case when fin2 then {none.format(f'({first})')} else ld end, case when fin2 then {none.format(f'({second})')} else rd end, case when fin2 then 1 else i end, case when fin2 then 1 else j end, fin2 and false or (fin1 and not fin2)
  from (select *, fin1 and len(q) > 1 as fin2 from (
    select step, lens, kinds, n, case when i > len(l) then list_append(q, {both}) else q end as q, i > len(l) as fin1,
      case when k = 2 then {put('l', 'i', all_c)} when k = 3 then {put('l', 'i', some_c)} else l end as l,
      case when k = 1 then {put('r', 'j2', all_o)} when k = 3 then {put('r', 'j2', some_o)} else r end as r,
      case when k = 1 then {dead('ld', 'i')} else ld end as ld, case when k = 2 then {dead('rd', 'j2')} else rd end as rd,
      case when {over} then len(l) + 1 when j2 is null or {ends_row} then i + 1 else i end as i, case when j2 is null or {ends_row} then 1 else j2 + 1 end as j
    from (select *, case when j2 is not null then {at.format('j2')} else 0 end as k from (
      select *, list_filter(range(j, len(r) + 1), lambda x: i <= len(l) and not rd[x] and {at.format('x')} > 0)[1] as j2 from run where not fin)))))
, done as (select * from run where fin)"""


SINGLES = "select list([[abs_id]] order by abs_id) as q, list(len order by abs_id) as lens from seqs"
