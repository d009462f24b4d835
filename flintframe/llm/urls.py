"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import json
import re
import string
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (action, host, path) of the host rules.
HOST_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: (action, regular expression over host + path + query, literal tokens that every match holds).
PATTERN_RULES = [
    ("block", r"^(?:[^/?#]*\.)?ads-track\.", ("ads", "track")),
    ("block", r"^(?:[^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    ("block", r"^(?:[^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    ("block", r"^(?:[^/?#]*\.)?free-casino\.", ("free", "casino")),
    ("block", r"[/.-]porn[/.-]", ("porn",)),
]
MOST_RULES = 100_000
_TOKEN_GAP = "[^0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """action on URLs whose target fits pattern; rank orders matches; every match holds all of tokens."""

    action: str
    pattern: str
    tokens: tuple[str, ...]
    name: str | None = None
    rank: int = 0
    order: int = field(default=0, compare=False)


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(_TOKEN_GAP, text) if t]


def host_rule(action: str, host: str, path: str, order: int = 0) -> Rule:
    """A rule for a host, all its subdomains, and paths that start with path. The longest of these wins.

    It is held against host and path alone, so nothing after ``?`` or ``#`` counts.
    """
    sure = path if re.search(_TOKEN_GAP + "$", path) else path[: len(path) - len((_tokens(path) or [""])[-1])]
    quoted = re.sub(r"([^0-9A-Za-z_/-])", r"\\\1", host + path)
    return Rule(action, rf"^(?:[^/?#]*\.)?{quoted}" + ("" if path else r"(?:/|\z)"), tuple(_tokens(host) + _tokens(sure)), f"{host}{path or '/'}", len(host + path), order)


def rules_of_contract() -> list[Rule]:
    return [host_rule(*r, order=k) for k, r in enumerate(HOST_RULES)] + [Rule(a, p, t, order=k) for k, (a, p, t) in enumerate(PATTERN_RULES, len(HOST_RULES))]


def read_rules(table: DataFrame) -> list[Rule]:
    """Host rules from the columns action, host and path of a table of at most MOST_RULES rows; a null path is every path."""
    rows = table.select("action", "host", "path").distinct().orderBy("host", "path", "action").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    return [host_rule(r["action"], r["host"], r["path"] or "", order=k) for k, r in enumerate(rows) if r["host"]]


def parts(url: Column) -> dict[str, Column]:
    """host, path and rest (from ? or #) of a URL; all empty for null or where there is no ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(after, F.lit("")), r"^([^/?#]*)", 1)
    return {
        "host": F.translate(host, string.ascii_uppercase, string.ascii_lowercase),
        "path": F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*([^?#]*)", 1),
        "rest": F.regexp_extract(F.coalesce(after, F.lit("")), r"(?s)^[^?#]*(.*)$", 1),
    }


def _indexed(rules: list[Rule], counts: dict[str, int]) -> tuple[list[list[dict]], list[dict]]:
    """Hash buckets of rules by their rarest token, and the rules without any token."""
    size = 1 << max(4, (2 * len(rules)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    always = []
    for r in rules:
        entry = {"pattern": r.pattern, "action": r.action, "name": r.name, "rank": r.rank, "ord": r.order, "token": None}
        if not r.tokens:
            always.append(entry)
            continue
        rarest = min(set(r.tokens), key=lambda t: (counts.get(t, 0), t))
        buckets[zlib.crc32(rarest.encode()) % size].append(entry | {"token": rarest})
    return buckets, always


def judge(pages: DataFrame, rules: list[Rule] | None = None, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, matched (patterns that fit) and n_candidates added.

    How often each literal token of the rules occurs is counted over all URLs; each rule is filed under its rarest.
    A URL's distinct tokens fetch the rules filed under them, and only those run their regular expressions, with no
    shuffle. Rules are a parameter (at most MOST_RULES), so the index, which travels with the plan, is bounded.

    Among host rules that fit the longest decides; otherwise pages are allowed unless a block pattern fits and no
    allow pattern does. A null URL, or one without ``://``, has empty host and path and is allowed. Rows repeat as
    they come; an empty table stays empty; input columns with the names of the new ones are replaced.
    """
    rules = rules_of_contract() if rules is None else rules
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    new = ("host", "path", "rule", "verdict", "matched", "n_candidates")
    keep = [c for c in pages.columns if c not in new]
    p = parts(F.col(url_col))
    split = pages.select(*keep, p["host"].alias("__host"), p["path"].alias("__path"), p["rest"].alias("__rest"))
    split = split.withColumn("__target", F.concat("__host", "__path", "__rest"))
    split = split.withColumn("__tokens", F.array_distinct(F.split("__target", _TOKEN_GAP)))
    literals = sorted({t for r in rules for t in r.tokens})
    seen = split.select(F.explode(F.filter("__tokens", lambda t: t.isin(literals))).alias("t")).groupBy("t").count()
    buckets, always = _indexed(rules, {r["t"]: r["count"] for r in seen.collect()})  # a row a literal of the rules
    entry = "struct<token:string,pattern:string,action:string,name:string,rank:int,ord:int>"
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{entry}>>")
    found = F.flatten(F.transform("__tokens", lambda t: F.filter(F.get(index, F.pmod(F.crc32(t), F.lit(len(buckets))).cast("int")), lambda e: e["token"] == t)))
    if always:
        found = F.concat(found, F.from_json(F.lit(json.dumps(always)), f"array<{entry}>"))
    where = lambda e: F.when(e["name"].isNull(), F.col("__target")).otherwise(F.concat("__host", "__path"))
    fits = split.withColumn("__found", found).withColumn("__fits", F.filter("__found", lambda e: F.rlike(where(e), e["pattern"])))
    best = F.array_max(F.transform(F.filter("__fits", lambda e: e["name"].isNotNull()), lambda e: F.struct(e["rank"].alias("r"), (-e["ord"]).alias("o"), e["name"].alias("name"), e["action"].alias("action"))))
    plain = F.filter("__fits", lambda e: e["name"].isNull())
    blocked = F.exists(plain, lambda e: e["action"] == "block") & ~F.exists(plain, lambda e: e["action"] == "allow")
    judged = fits.withColumn("__best", best)
    return judged.select(
        *keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.name").alias("rule"),
        F.coalesce(F.col("__best.action"), F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.transform("__fits", lambda e: e["pattern"]).alias("matched"), F.size("__found").alias("n_candidates"),
    )
