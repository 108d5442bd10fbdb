"""Builds the SQL of queries: a chain of steps that each add columns over named frames."""

from __future__ import annotations

import re


def _frame(name: str) -> str:
    by = "partition by symbol order by bar_id"
    if name == "o":
        return f"o as ({by})"
    if name == "p":
        return f"p as ({by} rows between unbounded preceding and current row)"
    if name == "s":
        return f"s as ({by} rows between current row and unbounded following)"
    if m := re.fullmatch(r"w(\d+)", name):
        return f"{name} as ({by} rows between {int(m[1]) - 1} preceding and current row)"
    a, b = re.fullmatch(r"r_(\w+)_(\w+)", name).groups()
    side = lambda x: "current row" if x == "0" else f"{x[:-1]} {'preceding' if x[-1] == 'p' else 'following'}"
    return f"{name} as ({by} rows between {side(a)} and {side(b)})"


def windows(text: str) -> str:
    names = sorted(set(re.findall(r"\bover (o|p|s|w\d+|r_\w+)\b", text)))
    return " window " + ", ".join(map(_frame, names)) if names else ""


def steps(prelude: str, base: str, adds: list[dict[str, str]], select: str, tail: str = "") -> str:
    """prelude and base; each dict of adds is columns added to what is there so far; then the select list and what follows `from`."""
    out, last = prelude, base
    for k, cols in enumerate(adds):
        text = ", ".join(f"{e} as {n}" for n, e in cols.items())
        out += f",\nstep{k} as (select *, {text} from {last}{windows(text)})"
        last = f"step{k}"
    return f"with recursive {out}\nselect {select} from {last}{windows(select)} {tail}"


def gate(n: int, value: str, x: str) -> str:
    return f"case when count({x}) over w{n} = {n} then {value} end"


def roll(f: str, x: str, n: int) -> str:
    return gate(n, f"{f}({x}) over w{n}", x)


def z(x: str, n: int) -> str:
    return f"({x} - {roll('avg', x, n)}) / nullif({roll('stddev_samp', x, n)}, 0)"
