"""Secrets, quality rules, token counts and HTML against brute force and the libraries."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from offerlens.llm import html_text, quality_rules, secrets, token_counts
from offerlens.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_base_spans_by_the_letter():
    text = 'Password = "abc-def_9" xPASSWD:hunter2secret token: token: abcdefgh AKIA' + "A1" * 9 + " " + "0af" * 9 + " ſecret=abcdefgh api_key=/x=y=z=1 AKIA12 é"
    base = {
        "assign": [m for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m[2]) >= 6],
        "access": [m for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24],
    }
    expected = sorted((m.start(), m.end(), k) for k, ms in base.items() for m in ms)
    assert sorted(s for s in secrets.scan(text) if s[2] != "guess") == expected and len(expected) >= 5


def test_guess_costs_order_passwords():
    cost = secrets.guess_cost
    assert cost("password") < cost("P@ssw0rd1") < cost("x8#kQ!z9Lm") and cost("qwertyuiop") < 5 and cost("abcabcabcabc") < 4 and cost("19990101") < 5
    assert cost("") == 0 and cost("aaaaaaaaaaaa") < 4 and cost("extraordinarily") < secrets.MIN_GUESSES <= cost("x8#kQ!z9Lm")


def test_context_values_add_spans_and_base_ones_stay():
    text = "my passphrase is x8#kQ!z9Lm, the password is extraordinarily long; pwd=9f!kLm2@@x and token=abcdefgh"
    spans = secrets.scan(text)
    assert [text[s:e] for s, e, k in spans if k == "guess"] == ["x8#kQ!z9Lm", "9f!kLm2@@x"]
    assert [text[s:e] for s, e, k in spans if k == "assign"] == ["token=abcdefgh"]
    assert secrets.redact_text(text) == "my passphrase is [SECRET], the password is extraordinarily long; pwd=[SECRET] and [SECRET]"


def test_long_context_values_are_whole_spans():
    rng = random.Random(4)
    long = "".join(rng.choice("ABCDEFGHJKMabcdefghjkm23456789") for _ in range(300))
    for before, after in (("Authorization: Bearer ", " end"), ('pwd="', '" end'), ("passphrase = '", "'"), ('"private_key": "-----BEGIN KEY-----', '"')):
        start = before.index("-----") if "-----" in before else len(before)
        text = before + long + after
        assert (start, len(before) + 300, "guess") in secrets.scan(text) and secrets.redact_text(text) == before[:start] + "[SECRET]" + after
    assert [k for *_, k in secrets.scan(f"pwd={'z' * 5000} pwd={'abcxyz' * 900} pwd={'x' * 300}")] == []
    assert len(secrets.redact_text("pwd=" + long * 300)) == 12


def test_values_that_base_spans_cover_in_part_are_scored():
    text = "password: abcdef!$Kx9#zQ and token=abcdefgh, secret='abcdefgh' pwd=" + "0af" * 9 + "!Kx9#zQ2"
    spans = secrets.scan(text)
    assert [text[s:e] for s, e, k in spans if k == "guess"] == ["abcdef!$Kx9#zQ", "0af" * 9 + "!Kx9#zQ2"]
    assert [text[s:e] for s, e, k in spans if k == "assign"] == ["password: abcdef", "token=abcdefgh", "secret='abcdefgh"]
    assert secrets.redact_text(text) == "[SECRET] and [SECRET], [SECRET]' pwd=[SECRET]"


KEYS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
ALIKE = {"4": "a", "@": "a", "3": "e", "0": "o", "1": "i", "!": "i", "5": "s", "$": "s", "7": "t"}


def stated_cost(part, first, value, i, ranks):
    """What the docstring says that a part costs, apart from brute force: by each of its rules, the least."""
    j, low = i + len(part), part.lower()
    plain = "".join(ALIKE.get(c, c) for c in low)
    out = []
    for spelt in (low, plain):
        if len(part) >= 3 and spelt in ranks and (spelt is low or low not in ranks):
            out.append(math.log10(ranks[spelt]) + math.log10(2) * (any(c.isupper() for c in part) + (sum(a != b for a, b in zip(low, plain)) if spelt is plain else 0)))
    day, year, sep = r"\d{1,2}", r"(?:19|20)\d\d", r"[-/.]?"
    if m := re.fullmatch(f"{day}{sep}{day}{sep}({year})|({year}){sep}{day}{sep}{day}|({year})", low):
        y = int(next(filter(None, m.groups())))
        out.append(math.log10(max(20, abs(y - 2020)) * (1 if len(low) == 4 else 365)))
    whole_run = part.isalpha() and not value[max(0, i - 1) : i].isalpha() and not value[j : j + 1].isalpha()
    if whole_run and len(part) >= 3 and (part.islower() or part.isupper() or part.istitle()):
        out.append(min(len(part), 5.0) + max(0, len(part) - 16))
    if not first and len(part) == 1 and part in "-_./":
        out.append(0.0)  # a separator costs half a decade, and no part's own half
    place = {c: (r, k) for r, row in enumerate(KEYS) for k, c in enumerate(row)}
    if len(part) >= 3:
        case = math.log10(2) * sum(c.isupper() for c in part) * (not part.islower() and not part.isupper())
        moves = [(place[b][0] - place[a][0], place[b][1] - place[a][1]) if a in place and b in place else None for a, b in zip(low, low[1:])]
        if all(m is not None and m != (0, 0) and abs(m[0]) <= 1 and abs(m[1]) <= 1 for m in moves):
            turns = 1 + sum(a != b for a, b in zip(moves, moves[1:]))
            out.append(case + math.log10(47 * len(part)) + turns * math.log10(4))
        if {ord(b) - ord(a) for a, b in zip(low, low[1:])} in ({1}, {-1}):
            out.append(case + math.log10(26 * len(part)))
    return min(out, default=math.inf)


def brute_cost(value, ranks, seen=None):
    """The least sum over all segmentations, by the rules as stated; a repeat costs its unit, by itself, times its count."""
    seen = {} if seen is None else seen
    if value not in seen:
        n = len(value)
        least = [0.0] + [math.inf] * n
        for j in range(1, n + 1):
            for i in range(j):
                part = value[i:j]
                cost = min(float(j - i), stated_cost(part, i == 0, value, i, ranks))
                for unit in range(1, (j - i) // 2 + 1):
                    if j - i >= 3 and (j - i) % unit == 0 and part == part[:unit] * ((j - i) // unit):
                        own = float(unit) if unit < 3 else min(float(unit), brute_cost(part[:unit], ranks, seen))
                        cost = min(cost, own + math.log10((j - i) // unit))
                least[j] = min(least[j], least[i] + cost + (0.5 if i else 0.0))
        seen[value] = least[n]
    return seen[value]


def test_guess_costs_are_the_least_over_all_segmentations():
    rng, words = random.Random(5), secrets.known_words()
    pieces = ["password", "Dragon", "1999", "qwer", "aaa", "x", "#", "7", "ab" * 5, "hello", "-", "_", "P@ss", "zxcvb", "Qz", "abab"]
    for _ in range(300):
        value = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        cost = brute_cost(value, words.ranks)
        assert secrets.guess_cost(value) == pytest.approx(cost)
        below = secrets.guess_cost(value, bound=10.0)
        assert below == pytest.approx(cost) if cost < 9.999 else below == math.inf or below > 9.99


def test_runs_of_letters_that_read_like_no_word_cost_brute_force():
    words = secrets.known_words(tokenizer_path(secrets.VOCABULARY))
    spans = {"pwd: xkcdqwzvbn!": [(5, 15, "guess")], "secret_key=zqxjvkwpmf": [(11, 21, "guess")], "pwd: geschwindigkeit": [], "pwd: hehelythatin": [], "credentials: przyjaciel": [], "pwd: вечеринка": []}
    assert {t: secrets.scan(t, words) for t in spans} == spans
    assert secrets.guess_cost("xkcdqwzvbn", words) == 10 and secrets.guess_cost("schadenfreude", words) == 5


def test_ranked_words_come_from_a_vocabulary():
    words = secrets.known_words(tokenizer_path(secrets.VOCABULARY))
    assert len(words.ranks) > 30_000 and words.ranks["password"] == 1 and words.ranks["house"] < words.ranks["battery"]
    prose = "The password is definitely-not-here-yet today, the passphrase is correct-horse-battery-staple"
    assert [prose[s:e] for s, e, _ in secrets.scan(prose, words)] == ["correct-horse-battery-staple"]
    assert secrets.guess_cost("gardenhouse7", words) < secrets.MIN_GUESSES <= secrets.guess_cost("gX4dq7Nh!use7", words)


@pytest.mark.parametrize("n", [129, 200, 10_000])
def test_values_of_any_length_are_masked_whole(spark, n):
    import corpus_pipeline

    rng = random.Random(n)
    value = "".join(rng.choice("ABCDEFGHJKMabcdefghjkm23456789!$") for _ in range(n))
    texts = [f'pwd: "{value}" end', f"pwd: {value} end", f"Authorization: Bearer {value} end", f"token={value} end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [r.text for r in corpus_pipeline.secret_scan(spark, docs, "").collect()]
    assert len(kept) == 4 and all(value[k : k + 6] not in t for t in kept for k in range(0, n - 5)) and all(t.endswith(" end") for t in kept)


def test_scan_and_redact_odd_documents(odd, rows, empty):
    out = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.scan_documents(odd).collect())
    blank = hashlib.sha256(b"").hexdigest()
    assert out == Counter((d, 0, 0, 0, blank, "") for d, _ in rows)
    masked = secrets.redact(odd)
    assert masked.schema == odd.schema and Counter(r.text for r in masked.collect()) == Counter(t for _, t in rows)
    assert secrets.scan_documents(empty).collect() == [] and secrets.redact(empty).collect() == []


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts_are_those_of_brute_force(odd, rows, empty):
    out = quality_rules.quality(odd)
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    assert found == Counter((d, *brute_quality(t)) for d, t in rows)
    assert out.where("base_failed AND kept").count() == 0 and quality_rules.quality(empty).collect() == []


def test_rules_keep_prose_and_drop_junk(spark):
    rng = random.Random(8)
    nouns = "house hill dog sea view room guest door garden letter winter stone boat friend".split()
    small = "the of a was with in and to for that it is".split()
    clean = " ".join(f"{rng.choice(nouns)}{rng.randint(0, 99)} {rng.choice(small)}" for _ in range(80)) + "."
    junk = {2: "a### b$$$ c%%% " * 30, 3: "AN ALL CAPITAL SHOUT NUMBER " + " ".join(f"X{i}" for i in range(80)), 4: "same line\n" * 60, 5: "too short", 6: None}
    docs = spark.createDataFrame([(1, clean, "x")] + [(k, v, "x") for k, v in junk.items()], "doc_id long, text string, `_w` string")
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_the_pipeline_keeps_clean_texts_of_any_size(spark):
    import corpus_pipeline

    rng = random.Random(9)
    clean = " ".join(f"{rng.choice(('house', 'hill', 'garden'))}{rng.randint(0, 9_999_999)} {rng.choice(('the', 'of', 'with'))}" for _ in range(500_050))
    docs = spark.createDataFrame([(1, clean), (2, "a### b$$$ c%%% " * 30)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.quality(spark, docs, "").select("doc_id").collect()] == [1]


@pytest.fixture(scope="module")
def model():
    return tokenizer_path(token_counts.MODEL)


def test_token_counts_are_the_librarys(odd, rows, empty, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    found = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, model).collect())
    counts = [(d, len((t or "").encode()), len(sp.encode(t or ""))) for d, t in rows]
    assert found == Counter((*c, c[2] > 4096) for c in counts) and token_counts.count_tokens(empty, model).collect() == []


def test_chunk_maps_compose_wherever_a_text_is_cut(model):
    import sentencepiece

    sp, (machine, _), rng = sentencepiece.SentencePieceProcessor(model_file=model), token_counts.compiled(model), random.Random(3)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "中", "🙂", "00", ".", "</s>", "<0x0A>", "▁", "\t"]
    for _ in range(1500):
        raw = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        text = token_counts.marked(raw, model)
        size, maps, lacking = rng.randint(1, 9), [], {}
        while True:
            maps = []
            for k, at in enumerate(range(0, len(text), size)):
                entries = machine.entries(text[max(0, at - 5) : at], at <= 5) | lacking.get(k, set())
                maps.append((k, machine.chunk_map(text[at : at + size], entries)))
            (end,) = token_counts.compose_all(maps).values()
            if end.missing < 0:
                break
            lacking.setdefault(end.missing, set()).add(end.state)
        assert end.count == machine.count(text) == machine.count_by_maps(text, size, 5) == len(sp.encode(raw))
        # the maps are associative
        if len(maps) > 2:
            left = token_counts.compose(token_counts.compose(maps[0][1], maps[1][1], 1), token_counts.compose_all(maps[2:]), 2)
            assert left == token_counts.compose_all(maps)


def test_texts_are_counted_over_many_chunks_and_tasks(spark, model):
    import sentencepiece

    sp, rng = sentencepiece.SentencePieceProcessor(model_file=model), random.Random(4)
    texts = ["z" * 700, "the quick brown " * 60, "".join(rng.choice("中文字无空格tion") for _ in range(900)), " " * 300, "a\n" * 200, None, "", "short"]
    docs = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    expected = Counter((i % 7, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in enumerate(texts))
    for chunk, look, arity in ((97, 30, 2), (211, 1, 64)):
        found = token_counts.count_tokens(docs, model, chunk=chunk, look=look, arity=arity).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == expected


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div>
<nav><ul><li><a href="/a">Home</a></ul></nav><div class="wrap"><aside>side</aside><div class="content"><h2>Title &amp; more</h2><p>Long text, with <b>some</b>
punctuation. And more&nbsp;of it, yes.<!-- note --><p>Short.<script>var t="</p>";</script><ul><li>one<li>two</ul><div class="ad">Buy now!</div>
<div class="comments"><p>Reader says, no way. A long comment, longer than the rest. Really, it is.</p></div><form><label>Name</label></form></div></div><footer>foot</footer></body></html>"""


def test_main_text_of_a_page_with_all_kinds_of_clutter():
    assert html_text.main_text(PAGE) == "Title & more\nLong text, with some punctuation. And more of it, yes.\nShort.\none\ntwo"


@pytest.mark.parametrize(
    "page, text", [(None, ""), ("", ""), ("plain &lt;text&gt;  here", "plain <text> here"), ("<p>a<script>x</p></script>b", "a\nb"), ("<article><h1>T</h1><p>x</article><p>out", "T\nx"), ("<nav>only</nav>", ""),
     ("<body><form><div><p>All of it, in a form.</p></div></form>", "All of it, in a form."),
     ("<div class='content has-sidebar'><div class='entry-header'><h1>T</h1></div><p>Body, here.</p><div class='post-comments'>no</div><ul class='share-links'><li>no</ul><div class='footnotes'>1</div></div>", "T\nBody, here.\n1")]
)
def test_main_text_of_odd_pages(page, text):
    assert html_text.main_text(page) == text


PROSE = "Words of a paragraph, and more of them; enough to be read. " * 6
MENU = "<ul>" + "".join(f"<li><a href=x>Item {i}</a></li>" for i in range(9)) + "</ul>"


def test_what_stands_beside_the_body_container_stays():
    read = PROSE.strip()
    page = f"<body><div>{MENU}</div><div class=story><h1>Title</h1><div class=intro><p>A short lead, here.</p></div><div class=text><p>{PROSE}</p><p>{PROSE}</p></div><div class=end><p>The end.</p></div></div>"
    assert html_text.main_text(page) == "\n".join(["Title", "A short lead, here.", read, read, "The end."])
    assert html_text.main_text(f"<div>{MENU}<div><p>One, two.</p></div><div><p>{PROSE * 4}</p></div><div><p>Three.</p></div></div>") == "\n".join(["One, two.", (PROSE * 4).strip(), "Three."])


def test_forms_and_articles_are_judged_by_what_they_hold():
    read = PROSE.strip()
    unseen = "<input type=hidden value=x>" * 9
    assert html_text.main_text(f"<body><div>Site name</div><form id=aspnetForm>{unseen}<input type=submit><article><h1>T</h1><p>{PROSE}</p></article></form>") == f"T\n{read}"
    assert html_text.main_text(f"<body><div>Site name</div><form id=aspnetForm>{unseen}<div><p>{PROSE}</p></div></form>") == f"Site name\n{read}"
    assert html_text.main_text(f"<body><div><p>{PROSE}</p><form><p>Your address, please.</p><input type=text><button>Go</button></form></div>") == read
    assert html_text.main_text(f"<article><p>{PROSE}</p><form><p>Your address, please.</p><input type=text></form></article>") == read
    card = "<article><h2>Another story</h2><p>Its teaser, cut short.</p></article>"
    assert html_text.main_text(f"<body><div class=text><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div>{card}").startswith(f"T\n{read}\n{read}")


@pytest.mark.parametrize("names", ["post type-post tag-news category-legal", "post-search-tips", "content-popular", "page menu-open", "modal-body"])
def test_class_names_are_weighed_against_the_content(names):
    read = PROSE.strip()
    assert html_text.main_text(f"<body><div>Site name</div><div class='{names}'><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p><div class=comments><p>A reader's.</p></div></div>").endswith(f"T\n{read}\n{read}")
    assert "Item" not in html_text.main_text(f"<div><p>{PROSE}</p><div class=tag-list>{MENU}</div></div>")


WRAPPED = "".join(f"<p>Sentence number {k}, with some words, and a second clause; it goes on.</p>" for k in range(12))


@pytest.mark.parametrize("attribute", ['class="hidden md:block"', 'style="display: none"', 'aria-hidden="true"', 'class="hidden"', "hidden"])
def test_hidden_wrappers_are_weighed(attribute):
    page = f"<body><nav><a href=x>Home</a></nav><div {attribute}><h1>Title</h1>{WRAPPED}</div><footer>us</footer></body>"
    assert html_text.main_text(page).split("\n")[0] == "Title" and html_text.main_text(page).count("Sentence") == 12
    small = html_text.main_text(f"<body><div><h1>Title</h1>{WRAPPED}</div><div {attribute}><p>Hidden bit of text, here.</p></div></body>")
    assert small.count("Sentence") == 12 and ("Hidden bit" in small) == ("md:" in attribute)


def test_controls_among_words_are_words():
    page = f"<body><article><h1>Title</h1>{WRAPPED}<p>press the <button>OK</button> now, and <label>this</label>.</p><p><button>Go</button> closes it.</p><button>Alone</button><form><label>Name</label><input></form></article></body>"
    assert html_text.main_text(page).split("\n")[-2:] == ["press the OK now, and this.", "Go closes it."]


def test_a_body_of_links_is_text_where_nothing_else_is():
    links = "".join(f'<p><a href="/{k}">Linked headline number {k} of the day</a></p>' for k in range(20))
    page = f'<body><nav><a href=x>Home</a><a href=y>About</a></nav><h1>Today</h1><div class="content">{links}</div><footer>us</footer></body>'
    assert html_text.main_text(page).split("\n") == ["Today", *(f"Linked headline number {k} of the day" for k in range(20))]


def test_formulas_are_text():
    page = "<p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x = 1</annotation></semantics></math>, as shown.</p>"
    assert html_text.main_text(page) == "So x=1, as shown."


def test_pages_of_a_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    out = html_text.extract(pages).collect()
    assert len(out) == 3 and all(r.n_chars == len(r.text) for r in out) and html_text.extract(pages.limit(0)).collect() == []


def brute_table(found):
    """Ratios of every path, smoothed over the page block by block, with no shared sums."""
    paths = [n.path for n, _, _ in found]
    rows = {p: [(t, min(k, len(t))) for (n, t, k), q in zip(found, paths) if q == p] for p in paths}
    text = [sum(len(t) for t, _ in rows[p]) / len(rows[p]) for p in paths]
    marks = [(1 + sum(t.count(c) for t, _ in rows[p] for c in ".,;:!?") / len(rows[p])) * (1 - sum(k for _, k in rows[p]) / sum(len(t) for t, _ in rows[p]) + 1e-6) for p in paths]
    near = lambda x, i: sum(x[j] * math.exp(-((i - j) ** 2) / 2) for j in range(len(x)) if abs(i - j) < 3) / sum(math.exp(-((i - j) ** 2) / 2) for j in range(len(x)) if abs(i - j) < 3)
    fused = [near(text, i) * near(marks, i) for i in range(len(paths))]
    return {p: sum(x for x, q in zip(fused, paths) if q == p) / paths.count(p) for p in paths}


def test_the_path_table_is_that_of_brute_force():
    for page in (PAGE, f"<body><div>{MENU}<p>{PROSE}</p><p>Short.</p><h2>More, of it</h2><div class=a><p>{PROSE}</p></div></div><div>{MENU}</div></body>"):
        found = html_text.blocks(page)
        table = {p: x for p, (x, _) in html_text.path_ratios(found).items()}
        assert table == pytest.approx(brute_table(found)) and len(table) > 3


def test_ratios_choose_the_text(monkeypatch):
    read = PROSE.strip()
    pages = {
        f"<body><div>{MENU}</div><p>{PROSE}</p><h2>More</h2><p>Short.</p><div>{MENU}</div></body>": [read, "More", "Short."],
        f"<body>{MENU}<div class=tags><h1>T</h1><p>{PROSE}</p></div></body>": ["T", read],
        f"<body><div class=legal-article><h1>T</h1><p>{PROSE}</p></div><div class=foot>{MENU}</div></body>": ["T", read],
        f"<article><h1>T</h1><p>{PROSE}</p><p class=alert>Mind the step.</p><div class=alert>{PROSE}</div></article><footer>Foot, note.</footer>": ["T", read, "Mind the step.", read],
        f"<div class='elementor-widget x'><h1>T</h1></div><div class='elementor-widget y'><p>{PROSE}</p></div><div class=elementor-widget><p>{PROSE}</p></div>": ["T", read, read],
        f"<h1>T</h1><article><p>{PROSE}</p><h2>Sources</h2><ul><li><a href=x>A book, by one</a></ul></article><div>Short.</div>": ["T", read, "Sources", "A book, by one"],
        f"<article><h1>T</h1><p>{PROSE}</p></article><section id=comments>" + f"<p>{PROSE}</p>" * 5 + "</section>": ["T", read],
    }
    for page, text in pages.items():
        assert html_text.main_text(page) == "\n".join(text)
    card = f"<body><div><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div><article class=card>Short teaser</article></body>"
    assert html_text.main_text(card).startswith(f"T\n{read}\n{read}")
    monkeypatch.setattr(html_text, "path_scores", lambda found: ({n.path: 1.0 for n, _, _ in found}, 1.0))
    assert sum(html_text.main_text(page) != "\n".join(text) for page, text in pages.items()) >= 5


def test_a_very_long_page_is_whole():
    page = f"<body><nav>{MENU}</nav><article>" + f"<p>{PROSE}</p>" * 4000 + "</article><footer>Foot.</footer></body>"
    assert html_text.main_text(page) == "\n".join([PROSE.strip()] * 4000)


def test_path_scores_favour_text_over_links():
    found = html_text.blocks("<body><div><p>" + "Words, and more words. " * 9 + "</p><p>" + "Further words, indeed. " * 9 + "</p></div><table><tr><td><a href='x'>link</a></td></tr></table></body>")
    scores, threshold = html_text.path_scores(found)
    assert max(scores, key=scores.get).endswith("/p") and min(scores.values()) < threshold <= max(scores.values())
