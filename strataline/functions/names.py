"""Column expressions on references, package names, bounded text and prose checks. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataline.functions.sources import matches

# Characters that no portable file name has.
UNPORTABLE = r'<>:"/\|?*%'


def citation(repo: Column, commit: Column, path: Column, line: Column, col: Column) -> Column:
    """repo@commit:path[:line[:col]]; nogit where there is no commit, and no column without a line."""
    known = F.coalesce(F.nullif(commit, F.lit("")), F.lit("nogit"))
    at = F.when(line.isNull(), "").otherwise(F.concat(F.lit(":"), line.cast("string"), F.coalesce(F.concat(F.lit(":"), col.cast("string")), F.lit(""))))
    return F.concat(repo, F.lit("@"), known, F.lit(":"), path, at)


def package_key(spec: Column, is_go: Column) -> Column:
    """The package of an import: three parts for Go, two with a scope, else one."""
    parts = F.when(is_go, 3).when(spec.startswith("@"), 2).otherwise(1)
    return F.array_join(F.slice(F.split(spec, "/"), 1, parts), "/")


def import_folder(spec: Column, module: Column) -> Column:
    """An import path within its module; the module itself is a dot."""
    inner = F.substring(spec, F.length(module) + 2, F.length(spec))
    return F.when(spec == module, ".").when(spec.startswith(F.concat(module, F.lit("/"))), inner).otherwise(spec)


def short_symbol(symbol: Column, module: Column) -> Column:
    """A symbol without its module's prefix, wherever it stands in it."""
    bare = F.replace(F.replace(symbol, F.concat(module, F.lit("/")), F.lit("")), F.concat(module, F.lit(".")), F.lit(""))
    return F.when(F.length(module) > 0, bare).otherwise(symbol)


def artifact_key(reference: Column) -> Column:
    """A reference as one file name: unportable characters, and a last space or dot, as percent codes of their bytes."""
    chars = F.split(reference, "")
    unsafe = lambda c, i: c.isin(*UNPORTABLE) | (c < " ") | (c == "\x7f") | ((i == F.size(chars) - 1) & c.isin(" ", "."))
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    return F.array_join(F.transform(chars, lambda c, i: F.when(unsafe(c, i), code(c)).otherwise(c)), "")


def artifact_reference(key: Column) -> Column:
    """The inverse of artifact_key."""
    return F.url_decode(F.replace(key, F.lit("+"), F.lit("%2B")))


def byte_prefix(text: Column, most: int) -> Column:
    """The longest beginning of a text of at most so many UTF-8 bytes that cuts no character."""
    raw = F.encode(text, "UTF-8")
    inside = lambda n: F.hex(F.substring(raw, n + 1, 1)).rlike("^[89AB]")
    cut = F.lit(most)
    for back in (3, 2, 1, 0):
        if most >= back:
            cut = F.when(~inside(most - back), most - back).otherwise(cut)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def capped(text: Column, most: int, marker: str) -> Column:
    """A text of at most most bytes, its cut disclosed by marker."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(byte_prefix(text, max(0, most - len(marker.encode()))), F.lit(marker)))


def head(text: Column, most: int) -> Column:
    """The first most lines below a line that says how many of how many there are."""
    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    total = F.when(F.length(text) == 0, 0).otherwise(F.size(lines))
    kept = F.least(total, F.lit(most))
    body = F.array_join(F.slice(lines, F.lit(1), kept), "\n")
    return F.concat(F.lit("sample: "), kept.cast("string"), F.lit(" of "), total.cast("string"), F.lit(f" lines (bound={most})\n"), body, F.when(F.length(body) > 0, "\n").otherwise(""))


def scrubbed(text: Column, roots: dict[str, str]) -> Column:
    """Machine-local roots replaced by their placeholders, longer ones first."""
    for root, placeholder in sorted(roots.items(), key=lambda x: (-len(x[0]), x[0])):
        text = F.replace(text, F.lit(root), F.lit(placeholder))
    return text


def between(text: Column, begin: str, end: str) -> Column:
    """From a marker to another, both included, if each occurs exactly once and in this order; else empty."""
    count = lambda m: (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)
    first, last = F.locate(begin, text), F.locate(end, text)
    fine = (count(begin) == 1) & (count(end) == 1) & (last >= first + len(begin))
    return F.when(fine, F.substring(text, first, last - first + len(end))).otherwise("")


def occurrences(text: Column, pattern: str) -> Column:
    """Array of (at, found): every match of a pattern that matches no empty text, with its offset in characters."""
    return F.transform(matches(text, pattern), lambda m: F.struct(m["at"].alias("at"), m["found"].alias("found")))


def unsupported_numbers(prose: Column, allowed: Column) -> Column:
    """Numbers of a text that are not among the allowed ones (both without thousands separators)."""
    from strataline.functions.text import numbers_in

    return F.array_except(numbers_in(prose), allowed)


def percent(part: Column, whole: Column) -> Column:
    """Null where the whole is 0."""
    return F.when(whole != 0, F.round(100.0 * part / whole, 2))


def iso_time(text: Column) -> Column:
    """Null if it is no ISO date or time; a final Z is UTC."""
    return F.try_to_timestamp(text)
