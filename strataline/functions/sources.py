"""Column expressions on source paths and source text: eligibility with reasons, hosts, imports, matches with line numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of eligible sources, and directories and file names with the reason they stand for.
EXTENSIONS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".go")
DIRECTORY_REASONS = {
    "test": "__tests__ test tests testdata __snapshots__",
    "mock": "__mocks__ mock mocks",
    "fixture-or-example": "fixture fixtures example examples demo demos sample samples benchmark benchmarks bench stories __stories__",
    "vendored": "vendor node_modules",
    "build-output": "dist build coverage out .next .nuxt .turbo .output",
    "generated": "generated __generated__",
    "migration-or-seed": "migration migrations seed seeds seeders",
}
NAME_REASONS = (
    (r"\.d\.[mc]?ts$", "declaration"),
    (r"\.(test|spec)\.[cm]?[jt]sx?$", "test"),
    (r"\.stories\.[cm]?[jt]sx?$", "fixture-or-example"),
    (r"_test\.go$", "test"),
    (r"([._]gen|\.pb|\.pb\.gw|_generated)\.go$", "generated"),
    (r"(^mocks?_|_mock\.go$)", "mock"),
    (r"^(\.(eslintrc\.[cm]?|prettierrc\.c?|stylelintrc\.c?|mocharc\.c?|babelrc\.|lintstagedrc\.)js|(gulp|grunt)file\.[jt]s)$", "config"),
    (r"^.+\.config\.[cm]?[jt]s$", "config"),
    (
        r"^(vite|vitest|jest|rollup|webpack|babel|tailwind|postcss|cypress|playwright|next|nuxt|svelte|astro|commitlint|stylelint|prettier|eslint|karma|metro|jasmine|nyc|release|lint-staged|size-limit)"
        r"\.(.*\.)?conf(ig)?\.(.*\.)?[cm]?[jt]s$",
        "config",
    ),
)
OUTSIDE_DIRECTORIES = ("node_modules", "vendor", ".git", "dist", "build", "coverage")
OUTSIDE_NAMES = r"^(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|.*\.min\.(js|css)|.*[._]gen\.go|swagger\.(json|yaml))$"
# What a host's last label may be, what looks like one, and hosts that say nothing.
GENERIC_LABELS = tuple("com net org edu gov mil int biz info pro dev app cloud tech online site store shop xyz".split())
PROPERTY_LABELS = tuple("id in is it to me as by do no at".split())
FILE_LABELS = tuple(
    "json yaml yml xlsx xls csv go js ts tsx jsx mjs cjs html css scss less md txt png svg jpg jpeg gif pdf xml sql sh lock map toml ini conf proto mod sum env tmpl gohtml webp ico".split()
)
NOISE_HOSTS = tuple("localhost 127.0.0.1 0.0.0.0 example.com www.example.com www.w3.org json.schemastore.org schemas.microsoft.com registry.npmjs.org registry.yarnpkg.com".split())
# Automatic committers, in-repository import roots, build files without an extension.
BOTS = (
    r"(?i)\[bot\]|dependabot|renovate|greenkeeper|snyk[-_ ]?bot|github[-_ ]?actions|semantic-release|mergify|whitesource|imgbot|circleci|travis[-_ ]?ci|"
    r"gitlab[-_ ]?runner|teamcity|buildkite|jenkins|noreply@github\.com|actions@github\.com"
)
INTERNAL_ROOTS = ("src", "app", "lib", "@", "@src", "@app")
BUILD_FILES = ("Dockerfile", "Makefile", "Procfile", "Rakefile")

_name = lambda path: F.element_at(F.split(path, "/"), -1)


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def extension(path: Column) -> Column:
    """The extension of an eligible source, .d.ts for every declaration file; else empty."""
    name = F.lower(_name(path))
    last = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.when(name.rlike(r"\.d\.[mc]?ts$"), ".d.ts").when(last.isin(*EXTENSIONS), last).otherwise("")


def exclusion_reason(path: Column, tier2: tuple[str, ...] = ()) -> Column:
    """Why a file isn't production source; empty if it is. The first folder with a reason counts, then the name."""

    def reason(folder: Column) -> Column:
        found = F.when(folder.isin(*tier2), "tier2-excluded")
        for why, names in DIRECTORY_REASONS.items():
            found = found.when(folder.isin(*names.split()), why)
        return found

    name, by_name = F.lower(_name(path)), F.lit("")
    for pattern, why in reversed(NAME_REASONS):
        by_name = F.when(name.rlike(pattern), why).otherwise(by_name)
    return F.coalesce(F.get(F.filter(F.transform(_folders(path), reason), lambda x: x.isNotNull()), F.lit(0)), by_name)


def outside_sources(path: Column, tier2: tuple[str, ...] = ()) -> Column:
    """Whether a repository-relative path is outside what is analysed: by a folder, a generated name, or a path of tier2."""
    parts = F.split(path, "/")
    found = F.arrays_overlap(parts, F.array(*map(F.lit, OUTSIDE_DIRECTORIES))) | _name(path).rlike(OUTSIDE_NAMES)
    for value in filter(None, (x.strip("/") for x in tier2)):
        found = found | (path == value) | path.startswith(value + "/") | F.array_contains(parts, value)
    return found


def is_test(path: Column) -> Column:
    return _name(path).rlike(r"_test\.go$|\.test\.|\.spec\.") | F.exists(_folders(path), lambda p: p.isin("test", "tests"))


def is_env_file(name: Column) -> Column:
    return name.rlike(r"^\.env($|\.)")


def is_source_label(label: Column) -> Column:
    """Whether a label is specific enough to be a path: a separator, an extension or a known build file."""
    value = F.trim(label)
    named = value.isin(*BUILD_FILES) | (value.rlike(r"[^.]\.[^.]+$") & ~value.startswith("."))
    return ~value.isin("", ".", "..", "(unknown)", "unknown") & (value.contains("/") | value.contains("\\") | named)


def is_bot(name: Column, email: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(email, F.lit(""))).rlike(BOTS)


def is_internal_import(spec: Column) -> Column:
    return spec.rlike(r"^[./]") | spec.startswith("~/") | F.split(spec, "/")[0].isin(*INTERNAL_ROOTS)


def in_module(package: Column, module: Column) -> Column:
    return (package == module) | package.startswith(F.concat(module, F.lit("/")))


def import_class(spec: Column, module: Column) -> Column:
    """internal, third-party (its first part has a dot) or stdlib."""
    return F.when(in_module(spec, module), "internal").when(F.split(spec, "/")[0].contains("."), "third-party").otherwise("stdlib")


def is_host(value: Column) -> Column:
    """Whether a string has the shape of a public host and isn't a file name or a property access."""
    v = F.trim(value)
    labels = F.split(v, r"\.")
    last = F.element_at(labels, -1)
    shape = v.rlike(r"^[a-z0-9][a-z0-9-]*(\.[a-z0-9-]+)*\.[a-z]{2,}$")
    noise = v.isin(*NOISE_HOSTS) | v.rlike(r"\.(invalid|local|localhost|test|example)$") | last.isin(*FILE_LABELS)
    return shape & ~noise & ((F.length(last) == 2) | last.isin(*GENERIC_LABELS)) & ~((F.size(labels) == 2) & last.isin(*PROPERTY_LABELS))


def source_reference(ref: Column) -> Column:
    """repository@revision:path:line strictly, as a struct; null if a part is missing."""
    pattern = r"(?s)^(.+)@([^:@]+):([^@]+):([0-9]+)$"
    part = lambda i: F.regexp_extract(ref, pattern, i)
    return F.when(ref.rlike(pattern), F.struct(part(1).alias("repository"), part(2).alias("revision"), part(3).alias("path"), part(4).cast("int").alias("line")))


def references_in(prose: Column) -> Column:
    """Distinct candidates for references in prose, sorted, without what punctuation follows them."""
    found = F.regexp_extract_all(prose, F.lit(r"[A-Za-z0-9._/-]++@[A-Za-z0-9._-]++:[^\s`|<>\"']++"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?)\]}]++$", ""))))


def first_filled(*columns: str) -> Column:
    """The first of some columns that isn't empty."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(""))


def reading_minutes(markdown: Column) -> Column:
    """Minutes to read prose: ideographs by 500, words by 250; no fenced code, no table rows."""
    prose = F.regexp_replace(F.regexp_replace(markdown, r"(?s)```.*?(```|\z)", ""), r"(?m)^\s*\|.*$", "")
    wide = r"[぀-ヿ㐀-䶿一-鿿]"
    return F.regexp_count(prose, F.lit(wide)) / 500.0 + F.regexp_count(F.regexp_replace(prose, wide, " "), F.lit(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*")) / 250.0


TAIL = 120
_MATCH = "struct<at:int,line:int,before:string,found:string>"


def matches(text: Column, pattern: str) -> Column:
    """Every match of a pattern (that matches no empty text): offset in characters, line from 1, up to 120 characters before it, and the match. Linear in the text's length."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    empty = F.array().cast(f"array<{_MATCH}>")
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def step(acc: Column, x: Column) -> Column:
        found = F.coalesce(x["found"], F.lit(""))
        at, line = acc["at"] + F.length(x["piece"]), acc["line"] + breaks(x["piece"])
        before = F.substring(F.concat(acc["tail"], x["piece"]), -TAIL, TAIL)
        one = F.array(F.struct(at.alias("at"), line.alias("line"), before.alias("before"), x["found"].alias("found")))
        # blocks of matches, so that appending to them copies little
        block, full = F.concat(acc["block"], one), F.size(acc["block"]) >= 255
        return F.struct(
            (at + F.length(found)).alias("at"), (line + breaks(found)).alias("line"), F.substring(F.concat(before, found), -TAIL, TAIL).alias("tail"),
            F.when(full, empty).otherwise(block).alias("block"), F.when(full, F.concat(acc["done"], F.array(block))).otherwise(acc["done"]).alias("done"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit("").alias("tail"), empty.alias("block"), F.array().cast(f"array<array<{_MATCH}>>").alias("done"))
    every = F.aggregate(parts, begin, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["block"]))))
    return F.when(text.rlike(pattern), F.filter(every, lambda m: m["found"].isNotNull())).otherwise(empty)
