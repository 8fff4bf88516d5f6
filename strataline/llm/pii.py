r"""Personal data: candidate spans scored by boosted trees, with DataFrame functions only.

Fixed rules find the base spans (emails, IPv4 addresses, card and phone numbers), which always
stay. Wide generators propose further spans: spelled-out emails, long mixed strings that may be
credentials (kind secret), and every piece of a run of digits and separators, from the start of a
group of digits to the end of another, so that candidates overlap. Of each candidate, format
features (digits, separators, groups, checksum, distinct characters, what else the run holds) and
context features (words before it) go through gradient-boosted trees, one set for each kind, whose
calibrated probability must reach a threshold that held precision on rows the trees hadn't seen.
Of overlapping ones in a run the likeliest stays. Candidates never overlap a base span: a run is
cut at its first base span, and what follows that in the run is not searched.

The trees are fitted for each session on ``TRAIN_ROWS`` made-up lines, generated with a fixed seed: positive
and negative strings of each kind among invented words. Only their candidates' features are
collected. At run time the trees are column expressions. There is no shuffle: each text is handled
in its row, in time linear in its length but for sorting its spans; patterns have possessive loops,
which need no stack. Positions are code points, end exclusive.

Nulls count as empty texts and have no spans. Rows with equal ids or texts are rows of their own; a
null id stays null. An empty table gives an empty result. Extra columns are ignored, and kept by
``find_pii`` and ``without_pii``, which name columns of their own only inside a struct.
"""

from __future__ import annotations

import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.boosted_trees import Trees, fit

#: Kinds of base spans, and of all spans.
KINDS = ("email", "ip", "card", "phone")
SPAN_KINDS = (*KINDS, "secret")

# The base patterns, with loops that give nothing back where that can't change a match.
# A match begins a run of its first class, or follows another match directly.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Candidate generators.
SPELLED = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:[(\[{] ?(?i:at) ?[)\]}]| AT | @ ) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{] ?(?i:dot) ?[)\]}]| DOT ) ?[A-Za-z0-9-]++)++"
SECRET = r"(?:\G|(?<![A-Za-z0-9_+/=-]))(?=[A-Za-z_+/=-]{0,80}[0-9])[A-Za-z0-9_+/=-]{16,}+"
NUMBER = r"[(+]?[0-9][0-9()./\x20-]{5,40}[0-9]"

TRAIN_ROWS = 5000
#: Characters before a candidate that are looked at, and characters of the blocks in which long texts are cut.
CONTEXT, BLOCK = 24, 1024

_SPAN = "struct<start:int,end:int,before:string,m:string>"


def _scan(xs: Column, zero: Column, kind: str, step) -> Column:
    """step(state, x) to (state, value) over an array: the values, of type kind. Blocks keep appending linear."""
    empty = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, value = step(acc["state"], x)
        block, full = F.concat(acc["block"], F.array(value)), F.size(acc["block"]) >= 255
        return F.struct(state.alias("state"), F.when(full, empty).otherwise(block).alias("block"), F.when(full, F.concat(acc["done"], F.array(block))).otherwise(acc["done"]).alias("done"))

    begin = F.struct(zero.alias("state"), empty.alias("block"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.aggregate(xs, begin, one, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["block"]))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda s, i: s + F.coalesce(value(i), F.lit(0))) % 10 == 0


def _is_ip(m: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0++", "")
        return (F.length(short) <= 3) & (F.coalesce(F.substring(short, 1, 3).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, r"\."), small)


def _is_card(m: Column) -> Column:
    digits = _digits(m)
    return F.when(F.length(m) < 14, False).when(~F.length(digits).between(14, 19), False).otherwise(luhn(digits))


def _is_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def _found(text: Column, pattern: str, valid, guard: Column) -> Column:
    """Valid matches with their places and what is before them: leftmost, not overlapping. guard: true of every text with a match."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        start = pos + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        return end, F.struct(start.alias("start"), end.alias("end"), F.substring(x["piece"], -CONTEXT, CONTEXT).alias("before"), x["m"].alias("m"))

    spans = F.filter(_scan(parts, F.lit(0), _SPAN, step), lambda s: s["m"].isNotNull())
    return F.when(guard, F.filter(spans, lambda s: valid(s["m"]))).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _base(t: Column) -> dict[str, Column]:
    """Arrays of spans for each of KINDS."""
    return {
        "email": _found(t, EMAIL, lambda m: F.lit(True), F.instr(t, "@") > 0),
        "ip": _found(t, IP, _is_ip, t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        "card": _found(t, CARD, _is_card, t.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}")),
        "phone": _found(t, PHONE, _is_phone, t.rlike(r"\+[0-9]")),
    }


def _candidates(t: Column) -> dict[str, Column]:
    """Arrays of runs in which candidates are."""
    any_ = lambda m: F.lit(True)
    return {
        "spelled": _found(t, SPELLED, any_, t.rlike(r"[(\[{] ?(?i:at) ?[)\]}]| AT | @ ")),
        "secret": _found(t, SECRET, any_, t.rlike(r"[A-Za-z0-9_+/=-]{16}")),
        "number": _found(t, NUMBER, any_, t.rlike(NUMBER)),
    }


_RUN = "struct<start:int,end:int,before:string,m:string,lo:int,hi:int>"


def _free(runs: Column, taken: Column) -> Column:
    """Runs with lo and hi: where in the text what they hold is clear of the taken spans (start, end); those without room are left out."""
    own = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.lit(1).alias("own"), r["end"].alias("end"), r["before"].alias("before"), r["m"].alias("m")))
    other = F.transform(taken, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["end"].alias("end"), F.lit("").alias("before"), F.lit("").alias("m")))
    kind = "struct<start:int,own:int,end:int,before:string,m:string,lo:int>"

    def forward(last: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["own"] == 0, F.greatest(last, x["end"])).otherwise(last), F.struct(*[x[c].alias(c) for c in ("start", "own", "end", "before", "m")], F.greatest(last, x["start"]).alias("lo"))

    def backward(following: Column, x: Column) -> tuple[Column, Column]:
        ahead = F.when(x["own"] == 0, x["start"]).otherwise(following)
        return ahead, F.struct(*[x[c].alias(c) for c in ("start", "end", "before")], F.when(x["own"] == 1, x["m"]).alias("m"), x["lo"].alias("lo"), F.least(following, x["end"]).alias("hi"))

    swept = _scan(F.array_sort(F.concat(other, own)), F.lit(0), kind, forward)
    swept = _scan(F.reverse(swept), F.lit(2**31 - 1), _RUN, backward)
    clear = F.filter(F.reverse(swept), lambda r: r["m"].isNotNull() & (r["lo"] < r["hi"]))
    return F.when(F.size(runs) > 0, clear).otherwise(F.array().cast(f"array<{_RUN}>"))


_PIECE = "struct<start:int,end:int,before:string,m:string,rest:int>"


def _pieces(run: Column) -> Column:
    """The candidates in a run of digits and separators: from the start of a group to the end of one, 7 to 19 digits in at most six groups."""
    m, n = run["m"], F.length(run["m"])
    is_ = lambda i, what: F.substring(m, i, F.lit(1)).rlike(what)
    places = F.sequence(F.lit(1), n)
    starts = F.filter(places, lambda i: is_(i, "[0-9(+]") & ((i == 1) | ~is_(i - 1, "[0-9(+]")) & (run["start"] + i > run["lo"]))
    ends = F.filter(places, lambda i: is_(i, "[0-9]") & ((i == n) | ~is_(i + 1, "[0-9]")) & (run["start"] + i <= run["hi"]))
    digits = F.length(_digits(m))

    def piece(a: Column, b: Column) -> Column:
        own = F.substring(m, a, b - a + 1)
        before = F.substring(F.concat(run["before"], F.substring(m, F.lit(1), a - 1)), -CONTEXT, CONTEXT)
        return F.struct((run["start"] + a - 1).alias("start"), (run["start"] + b).alias("end"), before.alias("before"), own.alias("m"), (digits - F.length(_digits(own))).alias("rest"))

    pairs = F.flatten(F.transform(starts, lambda a: F.transform(F.filter(ends, lambda b: (b - a).between(6, 27)), lambda b: piece(a, b))))
    return F.filter(pairs, lambda p: F.length(_digits(p["m"])).between(7, 19) & (F.regexp_count(p["m"], F.lit("[0-9]+")) <= 6))


def _whole(run: Column) -> Column:
    """A run as its only candidate, if nothing taken touches it."""
    one = F.array(F.struct(*[run[c].alias(c) for c in ("start", "end", "before", "m")], F.lit(0).alias("rest")))
    return F.when((run["lo"] == run["start"]) & (run["hi"] == run["end"]), one).otherwise(F.array().cast(f"array<{_PIECE}>"))


def _features(c: Column) -> list[Column]:
    """Of a candidate, as doubles."""
    match, before = c["m"], F.regexp_replace(F.lower(c["before"]), "\n", " ")
    digits = _digits(match)
    n = F.length(digits)
    count = lambda pattern: F.regexp_count(match, F.lit(pattern))
    columns = [
        n,
        F.length(match) - n,
        count(r"[0-9]+"),
        count(r"\."),
        count("/"),
        count(r"[()]"),
        count("-"),
        F.length(F.regexp_extract(match, r"^[^0-9]*+([0-9]++)", 1)),
        F.length(F.regexp_extract(match, r"(?<![0-9])([0-9]++)$", 1)),
        F.when(n.between(14, 19) & luhn(digits), 1).otherwise(0),
        c["rest"],
        F.when(before.rlike(r"(tel|phone|call|fax|mobile|cell|dial|reach)\W*(me|us|no|nr|number|at|on)?\W*$"), 1).otherwise(0),
        F.when(before.rlike(r"(card|visa|mastercard|amex|credit|debit|pan)\W*(no|nr|number)?\W*$"), 1).otherwise(0),
        F.when(before.rlike(r"(mail|contact|write|reach|to)\W*(me|us|at)?\W*$"), 1).otherwise(0),
        F.when(before.rlike(r"(version|isbn|order|date|id|ref|invoice|serial|build|page|score|at|commit|sha|hash)\W*$"), 1).otherwise(0),
        F.when(match.rlike(r"(?i)\b(com|org|net|edu|example|mail|io|de|fr|es)$"), 1).otherwise(0),
        F.when(before.rlike(r"(token|secret|passw(or)?d|pwd|key|auth\w*|bearer|credentials?)[\"']?\s*[:=]?\s*[\"']?$"), 1).otherwise(0),
        F.when(before.rlike(r"[:=]\s*[\"']?$"), 1).otherwise(0),
        F.size(F.array_distinct(F.split(F.substring(match, 1, 64), ""))),
        count("[a-z][0-9]|[0-9][a-z]|[A-Z][0-9]|[0-9][A-Z]|[a-z][A-Z]"),
        count("[_+/=-]"),
    ]
    return [x.cast("double") for x in columns]


def _training_lines() -> list[dict]:
    """Made-up lines: text, kind of the candidates to look at, and answer, the personal data in it (None if none)."""
    r = random.Random(20240229)
    pick = r.choice
    d = lambda n: "".join(r.choices("0123456789", k=n))
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    base64 = lambda n: "".join(r.choices(string.ascii_letters + string.digits + "+/", k=n - 1)) + pick("0123456789")
    word = lambda: "".join(r.choices("aeioutnrslhdcmäéñ", k=r.randrange(2, 10)))
    joined = lambda sep, *sizes: sep.join(d(n) for n in sizes)
    calls = lambda: pick(["phone: ", "call me at ", "tel. ", "fax ", "mobile "])
    neutral = lambda: pick(["and the ", "version ", "order ", "score ", "we saw ", "ref ", "page ", word() + " "])
    bracketed = lambda: f"({d(3)}) {d(3)}-{d(4)}"
    local = lambda: pick([bracketed(), joined("-", 3, 3, 4), joined(".", 3, 3, 4), f"0{d(3)}/{d(7)}"])
    number = lambda: pick(["12 ", "7 ", joined("/", 2, 2, 4) + " "])
    names = lambda: pick(["token", "api_key", "secret", "password", "access-key", "auth_token", "TOKEN", "API_KEY"]) + pick([" = ", "=", ": ", " : "])
    secret = lambda: pick([hexes(40), hexes(32), hexes(40).upper(), base64(40), base64(24), "sk-" + base64(32)])

    def card(sep: str, right: bool = True) -> str:
        body = [4, *(r.randrange(10) for _ in range(14))]
        rest = -sum(x if i % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(body)) % 10
        digits = "".join(map(str, [*body, rest if right else (rest + r.randrange(1, 10)) % 10]))
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def quoted(before: str, what: str) -> tuple[str, str, str]:
        mark = pick(['"', "'", ""])
        return before + mark, what, mark

    plain = lambda before, what: (before, what, "")
    cases = [
        ("phone", True, lambda: plain(calls(), local())),
        ("phone", True, lambda: plain(pick(["call me at ", "the office ", "reach us on ", calls()]), bracketed())),
        ("phone", True, lambda: plain(calls() + number(), pick([bracketed(), joined("-", 3, 3, 4)]))),
        ("phone", False, lambda: plain(neutral(), joined(pick("-/."), 4, 2, 2))),
        ("phone", False, lambda: plain(neutral(), d(r.randrange(7, 20)))),
        ("phone", False, lambda: plain(neutral(), joined(" ", 3, 2, 3, 2))),
        ("phone", False, lambda: plain(pick(["isbn ", "id ", "serial "]), joined("-", 3, 1, 5, 3))),
        ("phone", False, lambda: plain(neutral(), pick([joined(" ", 4, 4), joined(".", 3, 4), joined(" ", 1, 2, 3, 4)]))),
        ("card", True, lambda: plain(pick(["card ", "visa: ", "paid with ", "card number "]), card("."))),
        ("card", True, lambda: plain(pick(["card ", "visa: ", "credit card ", "card number "]), card("/"))),
        ("card", True, lambda: plain(pick(["card ", "room ", "visa: "]) + pick(["12 ", "3 ", d(3) + " "]), card(pick(" -")))),
        ("card", False, lambda: plain(neutral(), card(".", False))),
        ("card", False, lambda: plain(neutral(), card("", False))),
        ("card", False, lambda: plain(neutral(), joined(" ", 3, 2, 5, 2))),
        ("card", False, lambda: plain(neutral(), joined(".", 1, 2, 8, 4))),
        ("email", True, lambda: plain(pick(["mail me: ", "contact ", "write to ", "and "]), pick(["ann", "jo.doe", "mia_k", "info", "sam99"]) + pick([" (at) ", "[at]", " AT ", " [at] "]) + pick(["example", "mail", "site-a"]) + pick([".", " [dot] ", " DOT ", "(dot)"]) + pick(["com", "org", "net", "de"]))),
        ("email", False, lambda: plain(pick(["we met ", "look ", "sold ", "and "]), pick(["them", "x1", "items", "it"]) + pick([" @ ", " AT "]) + pick(["noon", "5", "3", "work"]) + "." + pick(["30", "Then", "50", "We"]))),
        ("secret", True, lambda: quoted(names(), secret())),
        ("secret", True, lambda: quoted(names(), secret())),
        ("secret", True, lambda: plain(pick(["Authorization: Bearer ", "bearer ", "key "]), secret())),
        ("secret", False, lambda: plain(pick(["commit ", "sha ", "hash ", "id ", "see "]), hexes(40))),
        ("secret", False, lambda: quoted(pick(["the ", "a ", "title = ", "name: "]), pick("-_/").join([word(), word(), word(), d(2), word()]))),
        ("secret", False, lambda: plain(pick(["see www/", "in ", "at "]), "/".join([d(4), d(2), word(), word(), word()]))),
        ("secret", False, lambda: plain(neutral(), pick([d(16), d(18), joined("-", 4, 4, 4, 4)]))),
        ("secret", False, lambda: plain("", word() + word() + word() + word() + d(1))),
    ]
    out = []
    for i in range(TRAIN_ROWS):
        kind, good, make = cases[i % len(cases)]
        before, what, after = make()
        lead = pick(["It was ", "Then ", "", f"{word()} {word()}. ", f"{word()} {word()} {word()} "])
        out.append({"text": lead + before + what + after + pick([" today", ".", "", f" {word()} {word()}"]), "kind": kind, "answer": what if good else None})
    return out


_fitted: dict[str, dict[str, Trees]] = {}


def _training_rows(spark: SparkSession) -> list:
    """kind, good, x (features) of the candidates in the made-up lines."""
    made = _training_lines()
    parts = F.array(*[F.lit(json.dumps(made[i::8])) for i in range(8)])
    lines = spark.range(0, 8, 1, 8).select(F.inline(F.from_json(F.get(parts, F.col("id").cast("int")), "array<struct<text:string,kind:string,answer:string>>")))
    lines = lines.withColumn("r", F.xxhash64("text"))
    found = _candidates(F.col("text"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    runs = F.when(F.col("kind") == "email", found["spelled"]).when(F.col("kind") == "secret", found["secret"]).otherwise(found["number"])
    lines = lines.withColumn("runs", runs).withColumn("runs", _free(F.col("runs"), none))
    number = F.col("kind").isin("phone", "card")
    lines = lines.select("kind", "answer", "r", F.explode("runs").alias("run")).select("kind", "answer", "r", F.explode(F.when(number, _pieces(F.col("run"))).otherwise(_whole(F.col("run")))).alias("c"))
    good = F.coalesce(F.col("c.m") == F.col("answer"), F.lit(False))
    return lines.select("kind", good.alias("good"), F.array(*_features(F.col("c"))).alias("x"), "r", "c.start", "c.end").orderBy("r", "start", "end").collect()


def trees(spark: SparkSession) -> dict[str, Trees]:
    """The trees of each kind; kept for the application, as they depend on nothing else."""
    key = spark.sparkContext.applicationId
    if key not in _fitted:
        rows = _training_rows(spark)
        out = {}
        for kind, others in (("email", ("email",)), ("card", ("card", "phone")), ("phone", ("card", "phone")), ("secret", ("secret",))):
            # other kinds' candidates from the same generator are negatives
            own = [r for r in rows if r["kind"] in others]
            out[kind] = fit(np.array([r["x"] for r in own]), np.array([float(r["good"] and r["kind"] == kind) for r in own]))
        _fitted[key] = out
    return _fitted[key]


def _with_chosen(docs: DataFrame, runs: Column, pieces, kinds: tuple[str, ...], models: dict[str, Trees]) -> DataFrame:
    """Adds chosen to docs, (start, kind, end) of the candidates whose trees reach their threshold; in a run the likeliest of those that overlap."""

    def with_features(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), F.array(*_features(c)).alias("x"))

    def ranked(c: Column) -> Column:
        best = F.array_max(c["p"])
        kind = F.element_at(F.array(*[F.lit(SPAN_KINDS.index(k)) for k in kinds]), F.array_position(c["p"], best).cast("int"))
        return F.struct(best.alias("p"), (c["end"] - c["start"]).alias("n"), (-c["start"]).alias("at"), c["start"].alias("start"), kind.alias("kind"), c["end"].alias("end"))

    def apart(scored: Column) -> Column:
        good = F.filter(F.transform(scored, ranked), lambda s: s["p"] >= 0)
        rank = lambda s: F.struct(s["p"], s["n"], s["at"])
        best = F.filter(good, lambda s: ~F.exists(good, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (rank(o) > rank(s))))
        return F.transform(best, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    docs = docs.withColumn("chosen", F.transform(runs, lambda run: F.transform(pieces(run), with_features)))
    margins = ", ".join(f"{models[k].sql('c.x')} - {models[k].threshold!r}D" for k in kinds)
    docs = docs.withColumn("chosen", F.expr(f"transform(chosen, run -> transform(run, c -> named_struct('start', c.start, 'end', c.end, 'p', array({margins}))))"))
    return docs.withColumn("chosen", F.flatten(F.transform("chosen", apart)))


def find_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds pii to docs: a struct of email, ip, card, phone (base spans of each kind), base and spans, sorted arrays of struct<start, kind (its number in SPAN_KINDS), end>."""
    models = trees(docs.sparkSession)
    t = F.coalesce(F.col("_text"), F.lit(""))
    found = docs.select(F.struct("*").alias("_doc"), F.col(text_col).cast("string").alias("_text")).withColumns(_base(t))
    own = lambda column, k: F.transform(F.col(column), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    found = found.withColumn("base", F.array_sort(F.concat(*[own(k, i) for i, k in enumerate(KINDS)])))
    found = found.withColumns({f"runs_{k}": v for k, v in _candidates(t).items()}).withColumn("taken", F.col("base"))
    for name, pieces, kinds in (("spelled", _whole, ("email",)), ("secret", _whole, ("secret",)), ("number", _pieces, ("phone", "card"))):
        found = _with_chosen(found, _free(F.col(f"runs_{name}"), F.col("taken")), pieces, kinds, models).withColumn("taken", F.concat("taken", "chosen"))
    return found.select("_doc.*", F.struct(*KINDS, "base", F.array_sort("taken").alias("spans")).alias("pii"))


def _listed(spans: str) -> Column:
    kinds = F.array(*map(F.lit, SPAN_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each of its spans, overlapping ones united, replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in SPAN_KINDS])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def between(cut: Column, a: Column, b: Column) -> Column:
        def part(k: Column) -> Column:
            begin = F.greatest(a - k * BLOCK, F.lit(0))
            return F.substring(F.get(cut, k), begin + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - begin)

        return F.when(a < b, F.array_join(F.transform(F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")), part), "")).otherwise("")

    def replaced(cut: Column) -> Column:
        def step(pos: Column, s: Column) -> tuple[Column, Column]:
            return F.greatest(pos, s["end"]), F.when(s["start"] >= pos, F.concat(between(cut, pos, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise("")

        n = F.length(text)
        return F.concat(F.array_join(_scan(spans, F.lit(0), "string", step), ""), between(cut, F.array_max(F.transform(spans, lambda s: s["end"])), n))

    # the blocks are bound once, as the only element of an array
    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(blocks), replaced), F.lit(0))).otherwise(text)


def without_pii(docs: DataFrame) -> DataFrame:
    """docs with the spans found in text replaced, and n_chars, if there is one, counted again; null texts stay."""
    found = find_pii(docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text")))
    changed = F.size("pii.spans") > 0
    found = found.select("doc", changed.alias("changed"), F.when(changed, redacted(F.col("text"), F.col("pii.spans"))).otherwise(F.col("text")).alias("text"))
    new = {"text": F.when(F.col("changed"), F.col("text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    return found.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans (also of kind secret) for each row of docs."""
    found = find_pii(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return found.select("doc_id", *[F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_listed("pii.base"), 256).alias("base_sha256"), _listed("pii.spans").alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
