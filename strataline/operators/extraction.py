"""Rows from source files (path, text): routes, calls, imports, environment names, hosts. One pass a file, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import names, sources
from strataline.functions.text import segments

# Names of router objects and of what registers a route on them; what only mounts others.
JS_ROUTERS = ("router", "app")
JS_METHODS = ("get", "post", "put", "patch", "delete", "use")
GO_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "Handle", "HandleFunc", "Group")
MOUNTS = ("USE", "GROUP")
# Methods of calls, words that declare a name, the object that holds bases, characters of a call's path.
CALL_METHODS = ("get", "post", "put", "patch", "delete")
DECLARATIONS = ("const", "let", "var")
CONFIGURATION = "config"
PATH_CHARACTERS = "A-Za-z0-9_./:${}-"
# What stands before the name of an environment variable, and what names look like.
ENVIRONMENTS = ("process.env.", "import.meta.env.", "os.Getenv(")
# Schemes of URLs.
SCHEMES = ("http://", "https://")

_SPACE = r"\s*+"
_COMMENT = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"
_quoted = lambda q: rf"{q}(?:[^{q}\\\n]|\\[^\n])*+{q}"
_TEMPLATE = r"`(?:[^`\\]|\\[\s\S])*+`"
_STRINGS = "|".join((_quoted("'"), _quoted('"'), _TEMPLATE))
_any = lambda words: "(?:" + "|".join(re.escape(w) for w in words) + ")"


def _tokens(files: DataFrame, wanted: str, path: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, line, before, found of what is wanted, read as the language does: not inside comments, nor inside strings unless it is one.

    Comments, then what is wanted, then strings are taken one after the other, whichever begins first.
    """
    each = files.select(path, *keep, F.inline(sources.matches(F.col(text), f"{_COMMENT}|{wanted}|{_STRINGS}")))
    return each.filter(F.col("found").rlike(rf"\A(?:{wanted})\z"))


def _by_language(files: DataFrame, path: str) -> tuple[tuple[DataFrame, bool], ...]:
    is_go = F.col(path).endswith(".go")
    return (files.filter(is_go), True), (files.filter(~is_go), False)


def _argument(found: Column) -> Column:
    """The text of the string that a found call ends with, or of a found string."""
    quote = F.substring(found, -1, 1)
    body = F.substring(found, F.lit(1), F.length(found) - 1)
    return F.element_at(F.split(F.replace(body, quote, F.lit("\0")), "\0"), -1)


def route_registrations(files: DataFrame, path: str = "path", text: str = "text", *, mounts: bool = False) -> DataFrame:
    """path, line, method, route of calls with a path that begins with a slash; mounts and groups only if asked for."""
    parts = []
    for some, go in _by_language(files, path):
        receiver, methods = ("", GO_METHODS) if go else (_any(JS_ROUTERS), JS_METHODS)
        strings = [_quoted('"')] if go else [_quoted("'"), _quoted('"')]
        call = rf"{receiver}{_SPACE}\.{_SPACE}{_any(methods)}{_SPACE}\({_SPACE}(?:{'|'.join(strings)})"
        name = F.trim(F.element_at(F.split(F.split("found", r"\(")[0], r"\."), -1))
        parts.append(_tokens(some, call, path, text).select(path, "line", F.upper(F.regexp_replace(name, r"\s", "")).alias("method"), _argument(F.col("found")).alias("route")))
    rows = parts[0].unionByName(parts[1]).filter(F.col("route").startswith("/"))
    return rows if mounts else rows.filter(~F.col("method").isin(*MOUNTS))


def config_aliases(text: Column) -> Column:
    """Array of (name, base): local names for a base of the configuration object, in the order in which later ones win.

    A declaration binds a name to a member of it, then to a template that begins with one, then names in braces to members.
    """
    declared = rf"\b{_any(DECLARATIONS)}\s++(?:[\w$]++|\{{[^{{}}]*+\}}){_SPACE}={_SPACE}(?:`\$\{{{_SPACE})?{CONFIGURATION}\b(?:{_SPACE}\.{_SPACE}\w++)?"
    each = F.regexp_extract_all(text, F.lit(declared), F.lit(0))
    target = lambda d: F.trim(F.regexp_replace(F.substring_index(d, "=", 1), rf"^{_any(DECLARATIONS)}\s+", ""))
    member = lambda d: F.regexp_extract(d, r"\.\s*(\w+)$", 1)
    pair = lambda d: F.struct(target(d).alias("name"), member(d).alias("base"))
    braces, template = (lambda d: target(d).startswith("{")), (lambda d: d.contains("`"))
    plain = F.filter(each, lambda d: ~braces(d) & ~template(d) & (member(d) != ""))
    written = F.filter(each, lambda d: ~braces(d) & template(d) & (member(d) != ""))
    taken = F.filter(each, lambda d: braces(d) & ~template(d) & (member(d) == ""))
    items = F.flatten(F.transform(taken, lambda d: F.split(F.translate(target(d), "{}", ""), ",")))

    def item(s: Column) -> Column:
        sides = F.transform(F.split(s, ":"), lambda x: F.regexp_extract(x, r"^\s*(\w*)", 1))
        return F.struct(F.element_at(sides, -1).alias("name"), sides[0].alias("base"))

    return F.concat(F.transform(plain, pair), F.transform(written, pair), F.filter(F.transform(items, item), lambda a: a["base"] != ""))


def ui_calls(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line, base, call_path, method (empty if the call shows none) of templates with a base and a path. A bare name stands for what the file binds it to."""
    with_names = files.filter(F.col(text).contains("${")).withColumn("_aliases", config_aliases(F.col(text)))
    templates = _tokens(with_names, _TEMPLATE, path, text, ("_aliases",))
    # each interpolation with what follows it, and the lines before it in the template
    one = rf"\$\{{\s*[\w.]++\s*\}}/[{PATH_CHARACTERS}]*+"
    inner = templates.select(path, "line", "_aliases", "before", "found", F.inline(sources.matches(F.col("found"), one)).alias("at", "lines", "ahead", "call"))
    names = F.split(F.trim(F.regexp_extract("call", r"^\$\{([^}]*)\}", 1)), r"\.")
    own = F.element_at(names, -1)
    global_, bare = (F.size(names) == 2) & (names[0] == CONFIGURATION), F.size(names) == 1
    bound = F.try_element_at(F.filter("_aliases", lambda a: a["name"] == own), F.lit(-1))["base"]
    method = F.upper(F.regexp_extract("before", rf"(?i)(?:^|[.\s(])({'|'.join(CALL_METHODS)})\s*\(\s*$", 1))
    rows = inner.filter(global_ | bare).select(path, (F.col("line") + F.col("lines") - 1).alias("line"), F.when(global_, own).otherwise(F.coalesce(bound, own)).alias("base"), F.regexp_extract("call", r"\}(/.*)$", 1).alias("call_path"), F.when(F.col("at") == 1, method).otherwise("").alias("method"))
    return rows.filter(F.size(segments(F.col("call_path"))) > 0)


def calls_by_base(calls: DataFrame) -> DataFrame:
    """base, paths: distinct normalised paths, sorted."""
    return calls.groupBy("base").agg(F.array_sort(F.collect_set(F.array_join(segments(F.col("call_path")), "/"))).alias("paths"))


def imports(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line, package of imports from outside: strings after the words that import, or alone on a line of Go behind an alias at most."""
    parts = []
    for some, go in _by_language(files, path):
        strings = _quoted('"') if go else f"{_quoted(chr(39))}|{_quoted(chr(34))}"
        rows = _tokens(some, strings, path, text).withColumn("spec", _argument(F.col("found")))
        line = F.element_at(F.split("before", "\n"), -1)
        if go:
            first = F.split("spec", "/")
            kept = line.rlike(r"^\s*(?:[\w.]+\s+)?$") & first[0].rlike(r"^[\w-]+\.[\w.-]+$") & (F.size(first) > 1)
        else:
            kept = (F.col("before").rlike(r"(?:require|import)\s*\(\s*$|from\s+$") | line.rlike(r"^import\s+$")) & ~F.substring("spec", 1, 1).isin(".", "/", "")
        parts.append(rows.filter(kept).select(path, "line", names.package_key(F.col("spec"), F.lit(go)).alias("package")))
    return parts[0].unionByName(parts[1])


def environment(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line, name of environment variables that sources read: a capital, then at least two capitals, digits or underscores."""
    read = rf"{_any(ENVIRONMENTS)}[\s\"]*+[A-Z][A-Z0-9_]++"
    each = files.select(path, F.inline(sources.matches(F.col(text), read)))
    name = F.regexp_extract("found", r"(\w+)$", 1)
    return each.select(path, "line", name.alias("name")).filter(F.length("name") > 2)


def hosts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line, host of URLs, up to their last label of letters, but for hosts that say nothing."""
    each = files.select(path, F.inline(sources.matches(F.col(text), rf"{_any(SCHEMES)}[\w.-]++")))
    host = F.lower(F.regexp_extract(F.element_at(F.split("found", "//"), -1), r"^(.+\.[A-Za-z]{2,})", 1))
    return each.select(path, "line", host.alias("host")).filter((F.col("host") != "") & ~F.col("host").isin(*sources.NOISE_HOSTS) & ~F.col("host").endswith(".invalid"))


def production_files(files: DataFrame, path: str = "path", text: str | None = None, tier2: tuple[str, ...] = ()) -> DataFrame:
    """Eligible files with extension and reason, empty for production sources. With a text, marked Go files are generated."""
    found = files.withColumns({"extension": sources.extension(F.col(path)), "reason": sources.exclusion_reason(F.col(path), tier2)}).filter("extension <> ''")
    if text:
        marked = (F.col("extension") == ".go") & F.substring(text, 1, 4096).rlike("(?i)Code generated .* DO NOT EDIT")
        found = found.withColumn("reason", F.when((F.col("reason") == "") & marked, "generated").otherwise(F.col("reason")))
    return found
