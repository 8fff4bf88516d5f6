"""Column expressions on paths, citations, ids and prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column, sha: int = 1) -> Column:
    """prefix and 16 hex digits of a hash over the parts joined by NUL; a null part counts as empty."""
    joined = F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined.cast("binary")) if sha == 1 else F.sha2(joined, 256), 1, 16))


def parse_citation(c: Column) -> Column:
    """repo@commit:path:line[:col] as a struct; parts that are missing are empty, or null for numbers."""
    pattern = r"^(?:(.*)@([^:@]*):)?(.*?)(?::([0-9]+))?(?::([0-9]+))?$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.struct(part(1).alias("repo"), part(2).alias("commit"), part(3).alias("path"), part(4).try_cast("int").alias("line"), part(5).try_cast("int").alias("col"))


def cited_repository(c: Column) -> Column:
    """parse_citation's repo, in one short match."""
    return F.regexp_extract(c, r"^(.*)@[^:@]*:.*$", 1)


def segments(path: Column) -> Column:
    """A route or call path as segments: no query or fragment, no interpolations or wildcards at its begin, then no version segment.

    Segments that stand for a value (they begin with a colon, a brace or a dollar sign) are *.
    """
    bare = F.substring_index(F.substring_index(path, "?", 1), "#", 1)
    parts = F.filter(F.split(bare, "/"), lambda s: s != "")
    begin = F.array_position(F.transform(parts, lambda s: ~(s.startswith("${") | (s == "*"))), True).cast("int")
    named = F.when(begin > 0, F.slice(parts, F.greatest(begin, F.lit(1)), F.greatest(F.size(parts), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    unversioned = F.filter(named, lambda s, i: ~((i == 0) & s.rlike(r"^v[0-9]+$")))
    return F.transform(unversioned, lambda s: F.when(F.substring(s, 1, 1).isin(":", "{", "$"), "*").otherwise(s))


def route_matches(route: Column, call: Column) -> Column:
    """Whether the route's segments, with * for any, begin the call's and at least one named segment agrees."""
    pairs = F.zip_with(route, F.slice(call, 1, F.greatest(F.size(route), F.lit(1))), lambda r, c: F.struct(r.alias("r"), c.alias("c")))
    fits = F.forall(pairs, lambda p: (p["r"] == p["c"]) | (p["r"] == "*") | (p["c"] == "*"))
    named = F.exists(pairs, lambda p: (p["r"] == p["c"]) & (p["r"] != "*"))
    return (F.size(call) >= F.size(route)) & (F.size(route) > 0) & fits & named


def path_prefix(path: Column, depth: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, depth), "/")


def all_prefixes(path: Column) -> Column:
    """The path's own prefixes at each separator, itself last: turns containment into an equi join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


# Names of credentials in configuration and code.
SECRET_KEYS = (
    r"passwords?|passwd|pwd|secret|client[_-]?secret|token|auth[_-]?token|access[_-]?token|refresh[_-]?token|api[_-]?key|apikey|"
    r"access[_-]?key|secret[_-]?key|private[_-]?key|authorization|session[_-]?id|x-api-key"
)


# Fixed value: what stands for a credential.
REDACTED = "<REDACTED>"


def redact(text: Column) -> Column:
    """Credentials replaced: what follows an authorization scheme, then values of keys in quotes, then without, then the user part of URLs.

    A key begins a word but for underscores and hyphens before it. An escaped quote doesn't end a value; a value that
    is only the name of a scheme stays, as what follows it is replaced. Loops give nothing back, so long values need no stack.
    """
    keyed = rf"(?<![a-z0-9])(?:{SECRET_KEYS})[\"']?+\s*+[:=]\s*+"
    body = lambda quote: rf"(?:[^{quote}\\]|\\.)*+"
    scheme = r"(?:bearer|basic)"
    steps = [(rf"(?i)(?<![a-z0-9_])({scheme}\s++)[a-z0-9._~+/=-]++", f"$1{REDACTED}")]
    steps += [(rf"(?is)({keyed}{q}){body(q)}{q}", f"$1{REDACTED}{q}") for q in ('"', "'")]
    steps.append((rf"(?i)({keyed})(?!{scheme}(?:[\s,;\"'}}{{)\]]|$))[^\s,;\"'}}{{)\]]++", f"$1{REDACTED}"))
    steps.append((r"(://)[^/@\s]++@", f"$1{REDACTED}@"))
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def slug(text: Column, most: int = 64) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text, without thousands separators, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda s: F.regexp_replace(s, ",", ""))))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)
