"""SQL that gives the rows of the rod queries by brute force over all pairs, for comparison."""

from __future__ import annotations

from ..operators.rods import PLACE, TURN

EPS = "1e-6::double"


def rods(table: str, key: str, length: float, radius: float, name: str = "rods") -> str:
    """CTE ``name`` (rod_id, x, y, z, cx, cy, cz, l, a)."""
    place = ", ".join(f"cast((k * {m} + {o}) % {n} as double) / {n}::double as {v}" for v, (m, o, n) in PLACE.items())
    turn = ", ".join(f"cast((k * {m} + {o}) % {n} as double) / {s}::double - 1::double as {v}" for v, (m, o, n, s) in TURN.items())
    return f"""{name} as (select rod_id, x, y, z, 2::double * pa / (1::double + q) as cx, 2::double * pb / (1::double + q) as cy, (q - 1::double) / (1::double + q) as cz, {length}::double as l, {radius}::double as a
  from (select *, pa * pa + pb * pb as q from (select k as rod_id, {place}, {turn} from (select cast({key} as bigint) as k from {table}))))"""


def image(d: str, length: str = "1::double") -> str:
    return f"(({d}) - {length} * floor(({d}) / {length} + 0.5::double))"


def approach(source: str, box: tuple = (1.0, 1.0, 1.0), periodic: tuple = (True, True, True), left: str = "rods", right: str = "rods", on: str = "p.rod_id < q.rod_id", extra: str = "", name: str = "ap") -> str:
    """CTE ``name``: all pairs with their closest approach; ``extra``: more columns of p and q."""
    gap = ", ".join(f"{image(f'q.{v} - p.{v}', f'{n}::double') if w else f'(q.{v} - p.{v})'} as g{v}" for v, n, w in zip("xyz", box, periodic))
    names = ", ".join(f"p.c{v} as c1{v}, q.c{v} as c2{v}" for v in "xyz")
    sign = lambda size, s: f"(case when {s} < 0 then -({size}) else {size} end)"
    clamp = lambda x, h: f"greatest(-{h}, least({h}, {x}))"
    hyp = lambda s, t: "sqrt(" + " + ".join(f"(c1{v} * {s} - g{v} - c2{v} * {t}) * (c1{v} * {s} - g{v} - c2{v} * {t})" for v in "xyz") + ")"
    return f"""{name}0 as (select p.rod_id as i, q.rod_id as j, {gap}, {names}, p.l as l1, q.l as l2, p.a as a1, q.a as a2{extra} from {left} p join {right} q on {on}),
{name}1 as (select *, c1x * c2x + c1y * c2y + c1z * c2z as cc, c1x * gx + c1y * gy + c1z * gz as p1, c2x * gx + c2y * gy + c2z * gz as p2, l1 / 2 as h1, l2 / 2 as h2 from {name}0 where {source}),
{name}2 as (select *, case when 1::double - abs(cc) > {EPS} then (cc * p2 - p1) / (cc * cc - 1::double) else {sign('h1', 'p1')} end as u1 from {name}1),
{name}3 as (select *, case when 1::double - abs(cc) > {EPS} then (p2 - cc * p1) / (cc * cc - 1::double) else cc * u1 - p2 end as u2 from {name}2),
{name}4 as (select *, abs(u1) <= h1 + a1 + {EPS} and abs(u2) <= h2 + a2 + {EPS} as unclamped, abs(u1) - h1 < abs(u2) - h2 as sec, {sign('h1', 'u1')} as e1, {sign('h2', 'u2')} as e2 from {name}3),
{name}5 as (select *, case when unclamped then u1 when sec then {clamp('p1 + cc * e2', 'h1')} else e1 end as t1, case when unclamped then u2 when sec then e2 else {clamp('cc * e1 - p2', 'h2')} end as t2 from {name}4),
{name} as (select *, {hyp('t1', 't2')} as d, {hyp('u1', 'u2')} as du from {name}5)"""


def near(reach: float) -> str:
    """Condition on centre distances, which only saves work."""
    return f"gx * gx + gy * gy + gz * gz <= {reach * reach}::double"


def hits(separation: float, soft: float = 1.0) -> str:
    return f"d < (a1 + a2) * {soft}::double + {separation}::double + {EPS}"


def greedy(rods: str, hits: str, name: str = "stay") -> str:
    """CTEs to insert ``rods`` (rod_id) in the order of ids; ``hits`` (later, first): rods that intersect. ``name`` (rod_id): those that stay. Needs ``with recursive``."""
    return f"""{name}0 as (select later as rod_id, list(first) as before from {hits} group by 1), {name}1 as (select *, row_number() over (order by rod_id) as k from {name}0),
{name}2(k, gone) as (select 0::bigint, []::bigint[] union all select p.k, case when len(list_filter(p.before, lambda x: not list_contains(s.gone, x))) > 0 then list_append(s.gone, p.rod_id) else s.gone end from {name}2 s join {name}1 p on p.k = s.k + 1),
{name} as (select rod_id from {rods} where rod_id not in (select unnest(gone) from (select gone from {name}2 order by k desc limit 1)))"""


def principal(source: str, sweeps: int = 6, name: str = "axes") -> str:
    """CTE ``name`` (cell_id, n, l1, l2, l3, px, py, pz): eigenvalues by size and first axis of the moments (xx ... yz) in ``source``, by Jacobi rotations."""
    entries = {(0, 0): "m00", (0, 1): "m01", (0, 2): "m02", (1, 1): "m11", (1, 2): "m12", (2, 2): "m22"}
    m = lambda i, j: entries[min(i, j), max(i, j)]
    unit = ", ".join(f"{float(i == j)}::double as v{i}{j}" for i in range(3) for j in range(3))
    out = [f"{name}0 as (select cell_id, n, xx as m00, yy as m11, zz as m22, xy as m01, xz as m02, yz as m12, {unit} from {source})"]
    at = 0
    for _ in range(sweeps):
        for p, q in ((0, 1), (0, 2), (1, 2)):
            r = 3 - p - q
            half = f"(({m(q, q)} - {m(p, p)}) / (2 * {m(p, q)}))"
            turn = f"case when abs({m(p, q)}) < 1e-300 then 0 else (case when {half} < 0 then -1 else 1 end) / (abs({half}) + sqrt({half} * {half} + 1)) end"
            out.append(f"{name}{at}t as (select *, {turn} as t from {name}{at})")
            out.append(f"{name}{at}c as (select *, 1 / sqrt(t * t + 1) as c, t / sqrt(t * t + 1) as s from {name}{at}t)")
            new = {m(p, p): f"{m(p, p)} - t * {m(p, q)}", m(q, q): f"{m(q, q)} + t * {m(p, q)}", m(p, q): "0::double", m(r, r): m(r, r), m(p, r): f"c * {m(p, r)} - s * {m(q, r)}", m(q, r): f"s * {m(p, r)} + c * {m(q, r)}"}
            new |= {f"v{i}{p}": f"c * v{i}{p} - s * v{i}{q}" for i in range(3)} | {f"v{i}{q}": f"s * v{i}{p} + c * v{i}{q}" for i in range(3)} | {f"v{i}{r}": f"v{i}{r}" for i in range(3)}
            out.append(f"{name}{at + 1} as (select cell_id, n, {', '.join(f'{e} as {c}' for c, e in new.items())} from {name}{at}c)")
            at += 1
    each = ", ".join(f"{{'k': abs(m{i}{i}), 'w': m{i}{i}, 'x': v0{i}, 'y': v1{i}, 'z': v2{i}}}" for i in range(3))
    out.append(f"{name}s as (select cell_id, n, list_reverse_sort([{each}]) as e from {name}{at})")
    sign = "(case when (case when abs(e[1].z) > 1e-12 then e[1].z when abs(e[1].y) > 1e-12 then e[1].y else e[1].x end) < 0 then -1 else 1 end)"
    out.append(f"{name} as (select cell_id, n, e[1].w as l1, e[2].w as l2, e[3].w as l3, e[1].x * {sign} as px, e[1].y * {sign} as py, e[1].z * {sign} as pz from {name}s)")
    return ",\n".join(out)
