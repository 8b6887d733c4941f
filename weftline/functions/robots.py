"""robots.txt: parsing, and decisions of rule lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = "array<struct<kind:string,prefix:string,delay:double>>"
#: Seconds between two fetches of a host that names none.
DEFAULT_DELAY = 1.0


def parse_robots(text: str | None, agent: str) -> list[tuple[str, str | None, float | None]]:
    """Rules (kind, prefix, delay) for an agent, in file order: its own section's if it has any, else those of *.

    Comments are dropped, names compared without case; delays that are no
    numbers are left out.  Null or empty texts have no rules.
    """
    sections: dict[str, list[tuple[str, str | None, float | None]]] = {agent.lower(): [], "*": []}
    open_: list[str] = []
    named = False
    for line in (text or "").splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            open_ = [*open_, value.lower()] if named else [value.lower()]
            named = True
            continue
        named = False
        if name in ("allow", "disallow"):
            rule = (name, value, None)
        elif name == "crawl-delay":
            try:
                rule = (name, None, float(value))
            except ValueError:
                continue
        else:
            continue
        for a in open_:
            if a in sections:
                sections[a].append(rule)
    return sections[agent.lower()] or sections["*"]


def allowed(rules: Column, path: Column) -> Column:
    """Whether a path may be fetched: the first rule in file order whose prefix it has decides, without one it may.

    An empty disallow forbids nothing and is passed over; null rules allow all.
    """
    fits = F.filter(
        F.coalesce(rules, F.array().cast(RULES)),
        lambda r: r["kind"].isin("allow", "disallow") & F.coalesce(path.startswith(r["prefix"]), F.lit(False)) & ~((r["kind"] == "disallow") & (r["prefix"] == "")),
    )
    return F.coalesce(F.get(fits, F.lit(0))["kind"] == "allow", F.lit(True))


def delay(rules: Column) -> Column:
    """The last crawl delay of a list of rules, DEFAULT_DELAY without one."""
    delays = F.filter(F.transform(F.coalesce(rules, F.array().cast(RULES)), lambda r: F.when(r["kind"] == "crawl-delay", r["delay"])), lambda d: d.isNotNull())
    return F.coalesce(F.try_element_at(delays, F.lit(-1)), F.lit(DEFAULT_DELAY))
