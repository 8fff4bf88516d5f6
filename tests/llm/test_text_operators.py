"""Each operator against a plain restatement, with nulls, empty texts, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from strataline.llm import chat_format, html_extraction, lm_scoring, packing, pii, quality_rules, toxicity

TEXT = "doc_id long, text string, spans string, kept string, email string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "s", "k", "e") for i, t in enumerate(texts)], TEXT)


def made(seed, n, words="ab cde f Ähre x9 the of".split(), most=60):
    r = random.Random(seed)
    return [r.choice(["", " ", "\n"]).join([""]) + "".join(w + r.choice([" ", "\n", "\t ", " \x0b"]) for w in r.choices(words, k=r.randrange(most))) for _ in range(n)]


def longest(w):
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_quality_rules(spark):
    texts = [None, "", " \n", *made(1, 40), "one two three " * 40, " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i % 60}" for i in range(120))]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w, r = WORD.findall(t), got[i]
        lines = [x for x in t.split("\n") if WORD.search(x)]
        at = collections.defaultdict(list)
        for j in range(len(w) - 2):
            at[tuple(w[j : j + 3])].append(j)
        repeated = {j + k for v in at.values() if len(v) > 1 for j in v for k in range(3)}
        reach = longest(w)
        covered = {j + k for j, n in enumerate(reach) if n >= 8 for k in range(n)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(repeated))
        assert (r["covered_words"], r["longest_repeat"]) == (len(covered), max(reach, default=0))
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        assert r["base_failed"] == failed and r["kept"] == (not failed and len(covered) <= 0.4 * len(w) and max(reach) <= max(50, 0.2 * len(w)))
    kept = quality_rules.good_documents(table(spark, texts))
    assert kept.columns == [x.split()[0] for x in TEXT.split(", ")] and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(packing.byte_bpe_path())
    texts = [None, "", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", *made(2, 150, most=400), "long " * 30000, "é😀" * 500]
    pieces = packing.pack(table(spark, texts), with_ids=True).collect()
    whole, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == len(whole[p["doc_id"]]) and p["length"] == len(p["ids"])
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        whole[p["doc_id"]] += p["ids"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, t in enumerate(texts):
        assert whole[i] == [*reference.encode(t or "", add_special_tokens=False).ids, 1]
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end == 2048 or (end < 2048 and end & (end - 1) == 0)
    assert packing.pack(table(spark, [])).count() == 0


def test_packer_cuts_only_what_it_must():
    packer = packing.Packer(16)
    pieces = list(packer.add([(i, [i] * n) for i, n in enumerate([8, 8, 5, 5, 5, 40])])) + list(packer.finish())
    assert sum(len(p[2]) for p in pieces) == 71 and sum(1 for p in pieces if p[0] < 5) == 5


def test_chat_format(spark):
    rows = [(1, 0, "system", "be kind <s>"), (1, 1, "user", "a" * 3000), (1, 2, "assistant", "x\\;y</s>"), (1, 3, None, None), (1, 3, "assistant", "same"), (1, 3, "assistant", "same"), (2, 5, "assistant", ""), (None, 1, "assistant", "[/INST]\n"), (-7, 0, "user", chat_format.PROBE), (-7, 1, "assistant", chat_format.PROBE)]
    rows += [(3, i, "user" if i % 2 else "assistant", f"turn {i} " * 50) for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_format.format_chats(df, budget=600)
    got = {r["conv_id"]: r for r in chat_format.chat_digests(windows).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    w = windows.filter("conv_id = 1").orderBy("window_no").collect()
    assert all(chat_format.parse(x["formatted"])[0] == ("system", "be kind <s>") for x in w)
    assert any(False in x["new_turns"] for x in windows.filter("conv_id = 3").collect())
    assert chat_format.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"budget": 200, "history_turns": 0}, {"budget": 300, "history_turns": 5, "history_budget": 120}])
def test_chat_windows_keep_their_budget(spark, limits):
    r = random.Random(17)
    encode = packing.byte_bpe(packing.byte_bpe_path())
    piece = lambda: r.choice(["ok", "", "</s>", "[INST]", "\\", "word " * r.randrange(30), "é😀", "]", "[", "\n"])
    rows = [(c, i, r.choice(["user", "assistant", "system", "a\nb"]) if i else r.choice(["system", "user"]), "".join(piece() for _ in range(r.randrange(4)))) for c in range(30) for i in range(r.randrange(1, 60))]
    rows += [(99, i, "user", "") for i in range(3000)] + [(98, 0, "user", "long " * 5000), (98, 1, "system", "late"), (98, 2, "assistant", "x")]
    df = spark.createDataFrame([(*x, "f", 1) for x in rows], "conv_id long, turn long, role string, text string, formatted string, n_tokens int")
    windows = chat_format.format_chats(df, **limits).collect()
    budget, turns, most = ({"budget": 1024, "history_turns": 2, "history_budget": 256} | limits).values()
    size = lambda role, text: len(encode(["".join([*chat_format.written_turn(role, text), chat_format.CLOSE])])[0])
    for c in {x[0] for x in rows}:
        left = [(role, text) for _, _, role, text in sorted(x for x in rows if x[0] == c)]
        system = left[0] if left[0][0] == "system" else None
        done = []
        for w in sorted((w for w in windows if w["conv_id"] == c), key=lambda w: w["window_no"]):
            found = chat_format.parse(w["formatted"])
            new = [t for t, fresh in zip(found, w["new_turns"], strict=True) if fresh]
            old = found[: len(found) - len(new)]
            assert new and new == left[len(done) : len(done) + len(new)] and not any(w["new_turns"][: len(old)])
            if system and done:
                assert old[0] == system
                old = old[1:]
            assert old == (done[-len(old) :] if old else []) and len(old) <= turns and sum(size(*t) for t in old) <= most
            done += new
            length = len(encode([w["formatted"]])[0])
            assert length <= w["n_tokens"] and (length <= budget or len(new) == 1)
            own = [w["formatted"][s["start"] : s["end"]] for s in w["loss_spans"]]
            assert [chat_format.unescape(x) for x in own] == [text for role, text in new if role == "assistant"]
        assert done == left


@pytest.mark.parametrize("text", ["", "\\", "\\;", "<\\;s>", "</s>[INST] ok [/INST]", "<s><s>\\<s>", "a\nb"])
def test_escape_round_trip(text):
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text and not any(c in escaped for c in chat_format.CONTROLS)


def test_lm_scoring(spark):
    texts = [None, "", *made(3, 60)]
    got = {r["doc_id"]: r for r in lm_scoring.lm_scores(table(spark, texts)).collect()}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in enumerate(texts)}
    counts = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["train_tokens"], r["n_tokens"], r["n_known"], r["held_out"]) == (n, len(ws), sum(w in counts for w in ws), zlib.crc32(str(i).encode()) % 5 == 1)
        assert abs(r["base_score"] - base) < 1e-6 * (1 + abs(base)) and r["score"] < 0
    assert lm_scoring.lm_scores(table(spark, [])).count() == 0


def test_lm_scores_equal_a_model_with_all_counts(spark):
    r = random.Random(21)
    texts = [None, "", *[" ".join(f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(r.randrange(120))) for _ in range(200)]]
    got = {x["doc_id"]: x["score"] for x in lm_scoring.lm_scores(table(spark, texts), bits_an_entry=96).collect()}
    tokens = {i: ["<", *WORD.findall(t or ""), ">"] for i, t in enumerate(texts)}
    train = [ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    words = collections.Counter(w for ws in train for w in ws[1:])
    pairs = collections.Counter(p for ws in train for p in zip(ws, ws[1:]))
    level = lambda c: c.bit_length()
    middle = lambda c: (1.5 * 2 ** (level(c) - 1) - 0.5 if c > 1 else c)
    mass = sum(map(middle, words.values()))

    def probability(a, b):
        most, pair = 2 ** level(words[a]) - 1, level(pairs[a, b])
        share = 0.5 * most / (most + 20)
        return share * (2 ** (pair - 1) / most if pair and most else 0) + (1 - share) * (middle(words[b]) + 0.5) / (mass + 0.5 * (len(words) + 1))

    for i, ws in tokens.items():
        want = sum(math.log10(probability(a, b)) for a, b in zip(ws, ws[1:]))
        assert abs(got[i] - want) < 1e-9 * (1 + abs(want))
    for a in list(words)[:50]:  # over all known words and one unseen
        assert sum(probability(a, b) for b in [*words, "unseen"]) <= 1 + 1e-9
    assert abs(sum(probability("unseen", b) for b in [*words, "unseen"]) - 1) < 1e-9


def test_lm_scoring_keeps_its_bits_beyond_the_bound(spark):
    r = random.Random(12)
    texts = [None, "", *[" ".join(f"w{int(r.paretovariate(0.4)) % 3000}" for _ in range(r.randrange(80))) for _ in range(300)]]
    scores = [{x["doc_id"]: x.asDict() for x in lm_scoring.lm_scores(table(spark, texts), **limit).collect()} for limit in ({}, {"max_filter_bytes": 64})]
    assert len(scores[1]) == len(texts)
    for i, x in scores[0].items():
        y = scores[1][i]
        assert abs(x["score"] - y["score"]) < 1e-9 * (1 + abs(x["score"])) and abs(x["base_score"] - y["base_score"]) < 1e-9 * (1 + abs(x["base_score"]))
        assert {k: v for k, v in x.items() if "score" not in k} == {k: v for k, v in y.items() if "score" not in k}


def test_toxicity_score_equals_a_plain_search(spark):
    r = random.Random(14)
    words = [f"word{chr(97 + i)}" for i in range(26)] + ["trash", "can", "trash", "fool", "foolish"]
    texts = [" ".join(r.choices(words, k=60)) + (" idiot fool" if i % 3 == 0 else " trash can") for i in range(400)] + [None, "", "IDI0T f00l! " * 300, "trash can " * 20000 + "idiot"]
    docs, labels = table(spark, texts), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    exceptions = ("fool proof", "wordb idiot wordc")
    lexicon = toxicity.learn(docs, labels, exceptions)
    assert lexicon.weights and " fool proof " in lexicon.exceptions
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, labels, exceptions=exceptions).collect()}
    for i, t in enumerate(texts[:-1]):
        line = toxicity.fold(t or "")
        places = lambda x: [k for k in range(len(line)) if line.startswith(x, k)]
        excused = [(k, k + len(x)) for x in lexicon.exceptions for k in places(x)]
        hits = {}
        for entry, weight in lexicon.weights.items():
            for k in places(entry):
                hits[k] = max(weight, hits.get(k, 0.0))
        hits = {k: w for k, w in hits.items() if not any(a <= k and k + 1 < b - 1 for a, b in excused)}
        distinct = {}
        for k, w in hits.items():
            word = line[k:].split()[0]
            distinct[word] = max(w, distinct.get(word, 0.0))
        x = np.array([[sum(distinct.values()), 100 * sum(hits.values()) / max(len(line.split()), 20) if t else 0.0, max(distinct.values(), default=0.0)]])
        want = 1 / (1 + math.exp(-float((toxicity._scale(x) @ np.array(lexicon.coefficients))[0])))
        assert abs(got[i]["score"] - want) < 1e-9, t
        assert (got[i]["predicted"] == 1) == (got[i]["score"] >= 0.3) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_toxicity(spark):
    r = random.Random(4)
    clean = lambda: " ".join(r.choices([f"word{chr(97 + i)}" for i in range(26)], k=80))
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        texts.append(clean() + (" you 1diоt go" if bad and i % 8 else " idiot! fool" if bad else " trash can" if i % 5 == 0 else ""))
        labels.append((i, int(bad)))
    texts += [None, ""]
    docs, labels = table(spark, texts), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, labels).collect()}
    wrong = [i for i in range(600) if got[i]["held_out"] and got[i]["predicted"] != (i % 4 == 0)]
    assert not wrong and got[600]["predicted"] == got[601]["predicted"] == 0 and all(0 <= x["score"] <= 1 for x in got.values())
    assert toxicity.fold("1DIоT, tr@sh$ Ａb") == " idiot trash ab "
    words = docs.limit(1).select(toxicity.folded_words(F.lit("1DIоT, tr@sh$ Ａb"))).first()[0]
    assert words == ["idiot", "trash", "ab"]
    assert {x["score"] < 0.01 for x in toxicity.toxicity(docs, labels.limit(0)).collect()} == {True}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


PAGES = [
    ("<body><div class=menu><a href=x>Home</a></div><div id=c><h2>T</h2><p>One, two. <i>Three</i><p>Four &lt; five; six.<ul><li>a, b<li>c</ul></div><div class='comments'><p>Nice, post!</p></div><form>x</form>", "T\nOne, two. Three\nFour < five; six.\na, b\nc"),
    ("<html><head><title>no</title><script>var t='</p>';</script></head><body><nav><a>m</a></nav><article><h1>H&amp;M </h1><p><b>First.<br><p>Second  \n line.</article><footer>c</footer>", "H&M\nFirst.\nSecond line."),
    ("plain text", "plain text"), (None, ""), ("", ""), ("<script>never closed", ""), ("<!-- open", ""), ("<p>x" * 3000, "\n".join(["x"] * 3000)), ("<div>" * 2000 + "deep", "deep"),
]


PAGES += [
    ("<article><div class='post-header'><h1>Title</h1></div><p>Long prose, that goes on, and on; it has commas. And more.</p><div class=related-work><p>Prior prose, with a comma, is here. It is long enough.</p></div>"
     "<div>Buy now</div><p>Text with <math><mi>x</mi></math> inside, <foo-bar>yes</foo-bar>.</p><p class=legal>Law, long, and dull; the article cites it. Fine.</p><button>Go</button></article>",
     "Title\nLong prose, that goes on, and on; it has commas. And more.\nPrior prose, with a comma, is here. It is long enough.\nText with x inside, yes.\nLaw, long, and dull; the article cites it. Fine."),
    ("<div class=ad>Buy this, now, and that. Today!</div><article><h1>A</h1><p>B</article>", "A\nB"),
    ("<header><h1>Site</h1></header><h2>Head</h2><div><p>Some prose, with commas, and dots. More of it.</p><p>Short.</p></div><footer>c</footer>", "Head\nSome prose, with commas, and dots. More of it.\nShort."),
]


def test_html_extraction(spark):
    df = spark.createDataFrame([(i, "u", h, "t", 1) for i, (h, _) in enumerate([*PAGES, PAGES[0]])], "page_id long, url string, html string, text string, n_chars int")
    for r in html_extraction.extract(df).collect():
        assert r["text"] == [*PAGES, PAGES[0]][r["page_id"]][1] and r["n_chars"] == len(r["text"])
    assert html_extraction.extract(df.limit(0)).count() == 0
    assert html_extraction.extract(spark.createDataFrame([(None, None, "<p>x")], "page_id long, url string, html string")).first()[:3] == (None, None, "x")


def restated(tree):
    """The operator's rules on a tree of (tag, class, children or text), written down plainly."""
    blocks = []

    def walk(node, way):
        tag, name, inner = node
        way = [*way, (tag, name)]
        if isinstance(inner, str):
            blocks.append((way, inner))
        else:
            for child in inner:
                walk(child, way)

    walk(tree, [])
    blocks = [(way, s) for way, s in blocks if not any(t in html_extraction.BOILERPLATE_TAGS for t, _ in way)]
    value = {}
    for way, _ in blocks:
        own = [s for w, s in blocks if w == way]
        value[tuple(way)] = sum(map(len, own)) / len(own) * (1 + sum(c in ".,;:!?" for s in own for c in s) / len(own))
    raw = [value[tuple(way)] for way, _ in blocks]
    weight = [0.05 ** (2 * sum(name in ("ad", "comments") for _, name in way)) for way, _ in blocks]
    near = [raw[max(0, i - 1) : i + 2] for i in range(len(raw))]
    fused = [(x * sum(y) / len(y)) ** 0.5 * w for x, y, w in zip(raw, near, weight)]
    mean = sum(fused) / len(fused)
    least = 0.6 * (sum((x - mean) ** 2 for x in fused) / len(fused)) ** 0.5
    good = [x >= (least if w == 1 else max(least, 0.9 * mean)) for x, w in zip(fused, weight)]
    region = next(w[: i + 1] for w, _ in blocks for i, x in enumerate(w) if x[0] == "article")
    return [s for g, w, (way, s) in zip(good, weight, blocks) if g or (w == 1 and way[: len(region)] == region)]


LONG = "<p>Ordinary prose, with commas, goes on and on; it has dots. It has more of them. And it goes on still, for some lines.</p>"
PROSE = "Ordinary prose, with commas, goes on and on; it has dots. It has more of them. And it goes on still, for some lines."


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ("<div>Short neutral line</div>", "Short neutral line"),
        ("<div class=lead>A lead sentence of moderate length stands here.</div>", "A lead sentence of moderate length stands here."),
        ("Bare text", "Bare text"),
        ("Bare <b>text</b> with <i>parts</i>", "Bare text with parts"),
        ("<details><summary>More</summary>What is in it<p>and below</p></details>", "More\nWhat is in it\nand below"),
        ("<div class=byline>By A. Writer</div>", "By A. Writer"),
        ("<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>", "One\nTwo"),
        ("<p>Press the <button>OK</button> button.</p>", "Press the OK button."),
        ("<section><div><span>Deep</span></div></section>", "Deep"),
        ("<table><tr><td>1<td>2</table>", "1\n2"),
        ("<h2>Comments</h2><p>Remarks on the method.</p>", "Comments\nRemarks on the method."),
        # and what isn't the article's
        ("<div>Subscribe now!</div>", ""), ("<button>Go</button>", ""), ("<div class=ad>Anything, at all.</div>", ""), ("<nav><p>Menu</p></nav>", ""), ("<form><label>Name</label></form>", ""), ("<aside>Aside</aside>", ""),
    ],
)
def test_the_whole_article_stays(part, text):
    want = lambda *parts: "\n".join(x for x in parts if x)
    assert html_extraction.main_text(f"<body><nav>m</nav><article>{part}{LONG * 3}{part}</article><footer>f</footer>") == want(text, *[PROSE] * 3, text)
    assert html_extraction.main_text(f"<body><nav>m</nav><div id=content><h1>T</h1>{LONG}{part}{LONG}</div><footer>f</footer>") == want("T", PROSE, text, PROSE)


def test_forms_notices_and_replies():
    assert html_extraction.main_text(f"<body><form id=page><div><h1>T</h1>{LONG * 2}<label>x</label></div></form><form><label>Search</label></form>") == f"T\n{PROSE}\n{PROSE}\nx"
    assert html_extraction.main_text("<div class='cookie-banner'><p>We use cookies, and more.</div>") == ""
    assert html_extraction.main_text("<body><form><p>Name, please. And more.</p></form><nav>m</nav>") == "Name, please. And more."
    page = "<body><article><h1>T</h1>" + LONG * 3 + "{}</article><div><h2>{}</h2><p>Nice post, thanks, really! It goes on, and on, for long; x, y, z.</p></div><footer>f</footer>"
    for heading in ("3 replies", "Comments", "12 comments", "Leave a reply", "Reader comments (4)"):
        assert html_extraction.main_text(page.format("", heading)) == f"T\n{PROSE}\n{PROSE}\n{PROSE}"
    assert html_extraction.main_text(page.format("<section><h3>2 comments</h3><p>Well, yes, but no; I agree, in part.</p></section><p>End of it.</p>", "1 reply")).endswith("\nEnd of it.")


def test_html_extraction_equals_a_restatement():
    r = random.Random(11)
    say = lambda least, most: " ".join("".join(r.choices("abcdef", k=r.randrange(1, 8))) + r.choice(["", "", "", ",", "."]) for _ in range(r.randrange(least, most)))
    shown = lambda node: f"<{node[0]}" + (f' class="{node[1]}"' if node[1] else "") + f">{node[2] if isinstance(node[2], str) else ''.join(map(shown, node[2]))}</{node[0]}>"
    for _ in range(300):
        inner = [("h1", "", say(2, 9))]
        for _ in range(r.randrange(2, 12)):
            inner.append(r.choice([("p", "", say(20, 90)), ("p", "", say(1, 5)), ("ul", "", [("li", "", say(1, 6)) for _ in range(3)]), ("div", "", say(1, 4)), ("section", "", [("h2", "", say(1, 4)), ("p", "", say(30, 60))])]))
        page = ("body", "", [("nav", "", [("p", "", say(3, 9))]), ("div", "ad", say(3, 20)), ("article", "", inner), ("div", "comments", [("p", "", say(3, 25)) for _ in range(2)]), ("footer", "", say(3, 9))])
        assert html_extraction.main_text(shown(page)).split("\n") == restated(page)


def test_html_extraction_is_linear():
    for x in ("<div>" * 40000 + "deep", "<b>" * 30000 + "<div>x</div>" * 30000, "<i>x</p>" * 30000, "<li>a<ul>" * 30000, "<span>" * 30000 + "</div>" * 30000):
        began = time.time()
        html_extraction.main_text(x)
        assert time.time() - began < 10, x[:20]


BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    good = (lambda m: True, lambda m: all(int(x) <= 255 for x in m.split(".")), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15)
    return sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in re.finditer(p, t) if good[k](m[0]))


def spans_of(row):
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in row["spans"].split(",") if x)]


def test_pii(spark):
    r = random.Random(6)
    parts = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+1234", "+49 1.2.3.4 99", "😀", "word", "12", "é@ü.de", "\n", ","]
    texts = [None, "", *["".join(r.choices(parts, k=r.randrange(1, 12))) for _ in range(200)], *[" ".join(r.choices(parts, k=r.randrange(1, 12))) for _ in range(150)], "a@b.cc " * 700 + "😀 1.2.3.4 " * 300, "call me at (415) 555-0199 or ann (at) example [dot] com", "call me at (415) 555-0199 or ann (at) example [dot] com"]
    got = {x["doc_id"]: x for x in pii.pii(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[1] == j for w in want) for j in range(4)], t
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest(), t
        assert set(listed) <= set(got[i]["spans"].split(",")) | {""}
        added = [s for s in spans_of(got[i]) if ":".join(map(str, s)) not in listed]
        assert not any(a < e and s < b for _, a, b in added for s, _, e in want)
    clean = pii.without_pii(table(spark, texts)).orderBy("doc_id").collect()
    assert clean[0]["text"] is None and clean[-1]["text"] == clean[-2]["text"] == "call me at [PHONE] or [EMAIL]" and clean[5]["spans"] == "s"
    for i, t in enumerate(texts):
        out, at = [], 0
        for k, a, b in spans_of(got[i]):
            if a >= at:
                out += [t[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        assert clean[i]["text"] == (None if t is None else "".join([*out, t[at:]]))
    assert pii.pii(table(spark, [])).count() == 0
    assert pii.find_pii(table(spark, ["x"])).columns == ["doc_id", "text", "spans", "kept", "email", "pii"]
    assert pii.pii(spark.createDataFrame([(None, "a@b.c")], "doc_id long, text string")).first()["n_email"] == 1


def test_pii_trees_add_spans(spark):
    secret, card = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "4485275742308327"
    cases = [
        (f'foo token = "{secret}" bar', [("secret", 13, 53)]), (f"API_KEY: {secret.upper()}", [("secret", 9, 49)]), (f"commit {secret} fixes it", []),
        (f"Room 12 {card} x", [("card", 8, 24)]), ("call me at 12 555-123-4567", [("phone", 14, 26)]), ("phone: 415-555-0199, fax (212) 555-0100", [("phone", 7, 19), ("phone", 25, 39)]),
        ("version 2024-05-17", []), ("order 1234567890", []), ("Verschlüsselungszertifikatsverwaltung17", []), ("see www/2024/05/some-long-title-here", []), ("mail me: ann (at) example [dot] com", [("email", 9, 35)]),
    ]
    got = {x["doc_id"]: spans_of(x) for x in pii.pii(table(spark, [t for t, _ in cases])).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_pii_trees_give_the_same_in_sql_and_numpy(spark):
    rows = pii._training_rows(spark)
    x = np.array([r["x"] for r in rows[:2000]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    for kind, model in pii.trees(spark).items():
        sql = np.array([r["p"] for r in df.select("i", F.expr(model.sql("x")).alias("p")).orderBy("i").collect()])
        assert np.allclose(sql, model.probability(x)), kind
        own = [r for r in rows if r["kind"] == kind]
        chosen = model.probability(np.array([r["x"] for r in own])) >= model.threshold
        good = np.array([r["good"] for r in own])
        assert (chosen & good).sum() >= 0.9 * good.sum() and (chosen & good).sum() >= 0.95 * chosen.sum(), kind


def test_pii_of_very_long_texts(spark):
    n = 100_000
    texts = ["1" * n, "1 " * (n // 20), "a@b" + ".c" * n, "a AT b" + ".c" * n, "a" * n + " @", "a1" * n, "ab@cd.ef " * (n // 10), "+1 " * (n // 4), "(" * n, "1." * (n // 20), "1.2.3." * (n // 60), "0" * n + ".1.1.1", "'" * n, "token=" * (n // 4)]
    got = {x["doc_id"]: x for x in pii.pii(table(spark, texts)).collect()}
    assert [got[i]["n_email"] for i in range(len(texts))] == [0, 0, 1, 0, 0, 0, n // 10, *[0] * 7] and got[11]["n_ip"] == 1
    assert pii.without_pii(table(spark, texts)).filter("doc_id = 6").first()["text"] == "[EMAIL] " * (n // 10)
