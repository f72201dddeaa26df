"""Classifiers, secrets, decontamination, languages, HTML and chat: exact rules, held-out quality, awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeltab.llm import chat_format, decontaminate, html_text, language_id, secret_scan, toxicity
from labeltab.llm.shared import table
from tests.conftest import SF_MID

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---- toxicity ---------------------------------------------------------------------------------

def test_toxicity_held_out_quality(spark):
    labels = table(spark, SF_MID, "labels")
    got = toxicity.classify(table(spark, SF_MID, "documents"), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    caught = [r.predicted for r in held if r.toxic == 1]
    wrong = [r.predicted for r in held if r.toxic == 0]
    assert sum(caught) >= 0.6 * len(caught) and sum(wrong) <= 0.02 * len(wrong)


def test_toxicity_awkward_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, none).collect()
    assert len(got) == len(odd_rows) and all(r.score == 0.5 for r in got)  # nothing learned
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 9)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.classify(docs.where("doc_id = 0"), labels).count() == 0


# ---- secrets ----------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
                    r"""[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_match_brute_force(make_docs, odd_rows):
    rng = random.Random(1)
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    b62 = "".join(rng.choice("ABCDEFGHIJabcdefghijklmnop0123456789") for _ in range(40))
    texts = [f'né token = "{hexa}" end', f"password: x secret:=abc PASSWORD='{b62}'", "token=short token=secret=abcdef", f"AKIA{'Z' * 16} AKIAAKIA1 {hexa}",
             f"plain {b62} words", "an_ordinary_identifier_name_of_some_length and 1234567890123456", f"apikey={hexa}{hexa} api_key : {b62}", "ſecret=abcdefgh"]
    rows = list(odd_rows) + [(20 + i, t) for i, t in enumerate(texts)] + [(60 + i, "plain prose with ordinary words and getUserName calls") for i in range(20)]
    got = secret_scan.find(make_docs(rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        want = brute_base(text[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert r.base_sha256 == SHA(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want))
        base = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert set(base) <= set(r.spans.split(",")) | {""}
    by = {r.doc_id: r.spans for r in got}
    assert by[24] == f"random:6:{6 + len(b62)}" and by[25] == "" and by[5] == ""


def test_redaction_masks_and_keeps_rows(make_docs, odd_rows):
    rows = list(odd_rows) + [(30, "x token=abcdef1234567890 y"), (31, "a AKIA" + "Q" * 20 + " b")]
    out = secret_scan.redact(make_docs(rows))
    assert out.columns == make_docs(rows).columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[30].text == "x <SECRET> y" and got[30].n_chars == len("x <SECRET> y") and got[31].text == "a <SECRET> b"
    assert got[1].text is None and got[6].text == dict(rows)[6]
    assert secret_scan.mask("abcdef", [(1, 3, 0), (2, 4, 1), (4, 5, 2)]) == "a<SECRET>f"


# ---- decontamination --------------------------------------------------------------------------

ITEM = ("In the morning market Alice sold 12 red apples for 3 dollars each and then walked 5 km home "
        "while her neighbour Alice counted the remaining green pears twice")


def test_leaks_and_reparameterised_questions(spark, make_docs, odd_rows):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "six plain words make one window"), (5, ""), (None, ITEM)],
                                  "item_id long, text string")
    other = ITEM.replace("Alice", "Zelda").replace("12", "47").replace("3 dollars", "8 dollars").replace("5 km", "9 mi")
    broken = ITEM.replace("Alice", "Zelda", 1).replace("12", "47").replace("3", "47")  # two values onto one, one name onto two
    torn = broken.replace("home", "back")  # at most ten tokens in a row are verbatim
    rows = list(odd_rows) + [(20, "before. " + ITEM + " after"), (21, "q: " + other), (22, "q: " + broken), (23, ITEM.upper() + "!!"),
                             (24, "In the morning market nothing of this kind was ever sold to them"), (25, "here six plain words make one window again"),
                             (26, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"), (27, " ".join(ITEM.split()[:16])), (28, torn)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(make_docs(rows), bench).collect()}
    assert {k for k in got if k[1] == 1} >= {(20, 1), (21, 1), (23, 1), (27, 1)}
    assert got[(20, 1)].coverage == 1.0 and not got[(20, 1)].reparameterised
    assert got[(21, 1)].reparameterised and got[(21, 1)].n_slots >= 5
    assert got[(22, 1)].coverage < 1 and (25, 4) in got  # its values are in conflict, but 18 tokens in a row are verbatim
    assert (28, 1) not in got
    assert not {k[0] for k in got} & {1, 2, 3, 4, 5, 6, 7, 8, 24, 26}
    kept = decontaminate.clean(make_docs(rows), bench)
    assert kept.columns == make_docs(rows).columns
    assert {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 6, 7, 8, 24, 26, 28}
    assert decontaminate.leaks(make_docs(rows), bench.where("item_id = 99")).count() == 0


APPLES = ("3 red apples and 5 green pears lie on the old wooden table near the kitchen door where the tired farmer "
          "put them after a long walk through his quiet garden while the morning sun was slowly rising over the far blue hills again")
HAUS = ("wir gingen am Abend zum alten Haus hinter dem Wald und sahen dort lange in den hellen Himmel bis es kalt wurde "
        "und wir wieder leise durch das Tor zum anderen Haus am Fluss liefen um dort zu schlafen")


def test_leaks_with_values_in_conflict_at_single_places(spark, make_docs):
    bench = spark.createDataFrame([(1, APPLES), (2, HAUS)], "item_id long, text string")
    assert HAUS.count("Haus") == 2
    rows = [(1, APPLES.replace("3", "5", 1)), (2, APPLES.replace("3", "4", 1)), (3, HAUS.replace("Haus", "Dorf", 1)), (4, APPLES), (5, HAUS),
            (6, APPLES.replace("3", "2.5", 1)), (7, APPLES.replace("3", "-1,250", 1))]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(make_docs(rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 1), (5, 2), (6, 1), (7, 1)}
    assert all(got[k].coverage == 1.0 for k in ((2, 1), (4, 1), (5, 2), (6, 1), (7, 1)))
    assert all(got[k].reparameterised for k in ((2, 1), (6, 1), (7, 1))) and 0.5 < got[(3, 2)].coverage < 1
    assert decontaminate.conflicts({(0, 1, 1), (4, 1, 1), (9, 1, 2)}) == {9}  # the majority stands
    assert decontaminate.conflicts({(0, 1, 1), (9, 1, 2)}) == {0, 9} and decontaminate.conflicts({(0, 1, 3), (5, 2, 3)}) == {0, 5}


SUM = "Compute 17 + 25 - 3 * 4 + 99 / 11 - 6 + 48 * 2 - 13 + 7"


def test_leaks_of_items_poor_in_words_and_whole_numbers(spark, make_docs):
    bench = spark.createDataFrame([(1, SUM), (2, "is 91 prime?"), (3, "a box holds 12 bright marbles so how many bright marbles do four such boxes hold"),
                                   (4, " ")], "item_id long, text string")
    rows = [(1, "please. " + SUM + " now"), (2, SUM.replace("25", "26").replace("6 +", "8 +")), (3, "he asks: is 91 prime? yes"), (4, "is 97 prime"),
            (5, "a box holds 1,250 bright marbles so how many bright marbles do four such boxes hold"), (6, ""), (7, "Please Compute" + SUM[7:])]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(make_docs(rows), bench).collect()}
    assert set(got) == {(1, 1), (3, 2), (5, 3), (7, 1)}
    assert all(r.coverage == 1.0 for r in got.values()) and [got[k].reparameterised for k in sorted(got)] == [False, False, True, False]
    texts = [b"-3 of 1,250 and 2.5, 3/4; 10-3 x-7 (+8) 5.", b",5 end 6", b".7"]
    off = np.cumsum([0, *map(len, texts)])
    _, kind, row = decontaminate.tokens(np.frombuffer(b"".join(texts), np.uint8), off)
    assert [int(x) for x in np.bincount(row)] == [12, 3, 1] and (kind == decontaminate.NUMBER).sum() == 9 + 2 + 1


def _plain_leaks(docs, items, n=8, rich=4, run=13):
    """Pairs by the docstring, window by window, for tokens given as (hash, kind)."""
    def forms(toks):
        for at in range(max(len(toks) - n, 0) + 1):
            w = toks[at: at + n]
            enough = sum(k == decontaminate.PLAIN for _, k in w) >= rich
            for swapped in ({decontaminate.NUMBER, decontaminate.UNIT}, {decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME}, set()):
                if w and (enough or not swapped):
                    yield (at, tuple(("?", k) if k in swapped else h for h, k in w), bool(swapped),
                           [(o, h) for o, (h, k) in enumerate(w) if k in swapped])
    out = {}
    for i, item in items.items():
        own = list(forms(item))
        for d, doc in docs.items():
            runs = {}
            for at, key, _, slots in forms(doc):
                for a, k, template, s in own:
                    if k == key:
                        runs.setdefault(at - a, set()).add((a, template, tuple((a + o, x, y) for (o, x), (_, y) in zip(s, slots))))
            places = set()
            for ws in runs.values():
                bad = decontaminate.conflicts({x for w in ws for x in w[2]})
                places |= {a for a, _, s in ws if not any(x[0] in bad for x in s)}
            if places and len(places) >= min(run - n + 1, len({a for a, *_ in own})):
                out[d, i] = len(places)
    return out


def test_leaks_match_brute_force(spark, make_docs):
    words = ("red apples lie on old tables while seven farmers walk home to Berlin with Anna and Otto after 12 km or 3 hours at 5 percent "
             "of 12 days near Berlin where Otto sold 40 pears for 3 dollars").split()
    rng = np.random.default_rng(3)
    items = {i: [words[k % len(words)] for k in range(s, s + 24)] for i, s in enumerate((0, 5, 11, 17))}
    swap = {"12": ("47", "3"), "3": ("8", "12"), "Anna": ("Zelda", "Otto"), "Otto": ("Hans", "Anna"), "Berlin": ("Paris",), "km": ("mi",), "old": ("new",)}
    docs = {}
    for d in range(60):
        text = list(items[d % 4])
        for k in rng.choice(len(text), int(rng.integers(0, 6)), replace=False):
            text[k] = str(rng.choice(swap.get(text[k], (text[k],))))
        cut = int(rng.integers(0, 10))
        docs[d] = ["so", *text[cut:], "and", *(text[:cut] if d % 3 else [])]

    def tokens(texts):
        raw = [" ".join(t).encode() for t in texts.values()]
        h, kind, row = decontaminate.tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return {k: [(int(a), int(b)) for a, b, r in zip(h, kind, row) if r == j] for j, k in enumerate(texts)}

    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.leaks(make_docs([(d, " ".join(t)) for d, t in docs.items()]), bench).collect()}
    want = _plain_leaks(tokens(docs), tokens(items))
    assert got == want and 20 < len(got) < 200


def test_planted_benchmark_passages(spark):
    docs, bench = table(spark, SF_MID, "documents"), table(spark, SF_MID, "benchmark")
    items = [(r.item_id, re.findall(r"\w+", r.text.lower())) for r in bench.collect()]
    grams = {tuple(w[i: i + 13]): k for k, w in items for i in range(max(1, len(w) - 12))}
    want = set()
    for r in docs.collect():
        w = re.findall(r"\w+", (r.text or "").lower())
        want |= {(r.doc_id, grams[g]) for g in (tuple(w[i: i + 13]) for i in range(len(w) - 12)) if g in grams}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert want and want <= got and len(got) <= 1.1 * len(want)


# ---- languages --------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = table(spark, SF_MID, "documents")
    rows = language_id.classify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_language_spans_scripts_and_awkward_rows(spark, make_docs, odd_rows):
    en = "the quick brown fox jumps over the lazy dog and then the other dog sleeps there while this one was with them"
    de = "der schnelle braune Fuchs springt über den faulen Hund und dann schläft der andere Hund nicht weil dieser mit ihnen war"
    ru = "быстрая лиса прыгает через ленивую собаку и другая собака спит там"
    train = [(100 + i, t) for i, t in enumerate([en, de, ru] * 30)]
    docs = make_docs(train).withColumn("lang", F.expr("case doc_id % 3 when 1 then 'en' when 2 then 'de' else 'ru' end"))
    model = language_id.train(docs)
    assert model.langs == ["de", "en", "ru"]
    rows = list(odd_rows) + [(50, en), (51, f"{en}. {de} {de}"), (52, ru), (53, "— … 😀 123"), (54, "собаку")]
    got = {r.doc_id: r for r in language_id.predict(make_docs(rows), model).collect()}
    assert (got[50].lang_pred, got[50].n_spans) == ("en", 1) and got[51].lang_pred == "de" and got[51].n_spans == 2
    assert 0.5 < got[51].score < 1 and got[52].lang_pred == "ru" and got[54].lang_pred == "ru"
    assert [got[i].lang_pred for i in (1, 2, 3, 53)] == ["und"] * 4 and got[53].score == 0
    nothing = language_id.classify(make_docs(rows).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nothing) == len(rows) and {r.lang_pred for r in nothing} == {"und"}


# ---- HTML -------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">Blog</a></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice"><p>We use cookies, accept them all, please do.</p></div><aside>Side</aside>
<div class="post"><h2>Head &amp; line</h2><p>First&nbsp;paragraph,   with <b>bold</b> text.<p>Second one &lt;here&gt;; it is longer, with commas, and more.
<br>After the break.</p><ul><li>Item one, long enough to count.<li>Item two, too.</ul></div>
<form><p>Sign up now, it is free.</p></form><section id="comments"><p>Great article, thanks a lot, I liked it, really.</p></section>
<footer>&copy; Site</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == ("Head & line\n\nFirst paragraph, with bold text.\n\nSecond one <here>; it is longer, with commas, and more. "
                                         "After the break.\n\nItem one, long enough to count.\n\nItem two, too.")
    for odd in (None, "", "   ", "<", "<p", "<script>x", "<!-- never closed", "<nav>menu</nav>"):
        assert html_text.main_text(odd) in ("", "<", "<p")
    assert html_text.main_text("just text, no markup") == "just text, no markup"


def para(i):
    return f"<p>Paragraph {i} of the text, with enough words to be read as content, and a comma or two.</p>"


def test_all_selected_text_and_its_headings_stay():
    for tag, pre in (("article", ""), ("body", "<div>")):
        many = "".join(map(para, range(20)))
        page = f"<html><body><nav>menu</nav><{tag}>{pre}<h1>Head</h1><section>{many}</section><section>{para(99)}</section></{tag}><footer>f</footer>"
        assert html_text.main_text(page).split("\n\n") == ["Head"] + [para(i)[3:-4] for i in [*range(20), 99]]
    page = f"<body><div class='page'><div class='intro'>{para(0)}</div><div class='body'>{''.join(map(para, range(1, 30)))}</div></div></body>"
    assert len(html_text.main_text(page).split("\n\n")) == 30
    items = [f"Item {i} of the list, which is long enough, as all of its items are, to be the content of this page." for i in range(30)]
    for a, b, c in (("<ul>", "<li>", "</ul>"), ("<table>", "<tr><td>", "</table>")):
        page = f"<body><div><h2>List</h2>{para(0)}{a}{''.join(b + x for x in items)}{c}</div></body>"
        assert html_text.main_text(page).split("\n\n") == ["List", para(0)[3:-4], *items]
    assert html_text.main_text(f"<body><article><h1>T</h1><div>{para(1)}{para(2)}</div></article></body>").startswith("T\n\n")


def test_marks_are_weighed_against_the_text():
    text = [para(i)[3:-4] for i in range(6)]
    for name in ("content no-sidebar", "has-sidebar", "post comment-open", "entry with-header", "hasSidebar", "skip-none", "sidebar"):
        page = f"<body><div class='{name}'><h1>T</h1>{''.join(map(para, range(6)))}</div></body>"
        assert html_text.main_text(page).split("\n\n") == ["T", *text]  # it holds the page's text
    for name in ("related-work", "social-history", "copyright", "skip-none"):
        for tag in ("section", "div"):
            page = (f"<body><article>{''.join(map(para, range(4)))}<{tag} id='{name}'><h2 id='{name}'>Head</h2>{para(4)}</{tag}>{para(5)}"
                    f"<div class='sidebar'>{para(7)}</div><div class='related-posts'><a href='/a'>A long title of some other text, on this site</a></div>"
                    f"<div class='copyright'>(c) Site</div><p>Ends, with <span class='sponsored'>Ad</span> words.</p></article></body>")
            assert html_text.main_text(page).split("\n\n") == [*text[:4], "Head", *text[4:], "Ends, with words."]


def test_a_form_around_the_page_hides_nothing():
    body = "".join(map(para, range(5)))
    ask = "<form><p>Your name, please, and your address.</p><input><button>Send</button></form>"
    text = "\n\n".join(["T", *(para(i)[3:-4] for i in range(5))])
    assert html_text.main_text(f"<body><form id='page'><nav>menu</nav><article><h1>T</h1>{body}{ask}</article><footer>f</footer></form></body>") == text
    assert html_text.main_text(f"<body><article><h1>T</h1>{body}</article>{ask}</body>") == text
    assert html_text.main_text(f"<body><article><header><h1>Site</h1></header><h1>T</h1>{body}</article></body>") == text


BROKEN = {"open": "<p " * 350_000, "quotes": '<p a="\'x ' * 110_000, "odd": '<p "' * 250_000 + ">", "names": "<aaaa" * 200_000, "marks": "<!x " * 250_000,
          "mixed": "<p \">'<" * 140_000, "nested": "<div>" * 100_000 + "some text", "texts": "<div>some text, " * 60_000,
          "adverts": "<div class=ad>some text, " * 40_000, "inline": "<b>" * 100_000 + "<div></div>" * 60_000, "title": "<title>" * 140_000,
          "ends": "<div>" * 100_000 + "</span>" * 70_000, "items": "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 80_000}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_and_deep_pages_are_read_in_proportion(name):
    import time
    import tracemalloc

    start = time.process_time()
    text = html_text.main_text(BROKEN[name])
    assert time.process_time() - start < 8  # about 1 s; hours where the time grows with the square
    assert {"open": text == BROKEN[name].strip(), "nested": text == "some text", "texts": text.count("some text,") == 60_000}.get(name, True)
    tracemalloc.start()
    html_text.main_text(BROKEN[name][: 1 << 18])
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


def test_tags_match_a_plain_reading():
    plain = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/><]*+)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
    rng = np.random.default_rng(1)
    for _ in range(2000):
        page = "".join(rng.choice(["<p ", ">", '"', "'", " ", "x", "<!--", "-->", "<!", "</b ", "<", "/", "?"], int(rng.integers(1, 30))))
        tags, at, got = html_text.Tags(page), 0, []
        while (m := tags.next_tag(at)) is not None:
            got.append(m)
            at = m[1]
        assert [x[:2] for x in got] == [m.span() for m in plain.finditer(page)], page


def test_extract_matches_article_markup(spark):
    import html

    pages = table(spark, SF_MID, "pages")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"<br>", " ", re.sub(r"</?(?:h1|p)>", "\0", re.search(r"(?s)<article>(.*)</article>", r.html)[1]))
        blocks = [" ".join(html.unescape(x).split()) for x in re.sub(r"</?\w+>", "", inner).split("\0")]
        assert got[r.page_id].text == "\n\n".join(x for x in blocks if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2)], "page_id long, url string, html string, text int")
    assert [r.text for r in html_text.extract(odd).collect()] == ["", "", ""]
    assert html_text.extract(odd.where("page_id = 5")).count() == 0


# ---- chat -------------------------------------------------------------------------------------

def test_chat_round_trip_merging_and_mask(spark):
    said = r"\### Assistant: </turn> ok"
    odd = r"<|end|> \l \b \\ <|start|>user<|text|> é漢😀"
    rows = [(1, 0, "user", "hi"), (1, 2, "assistant", odd), (1, 1, "user", said), (1, 3, "assistant", None), (1, 4, None, "x"),
            (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (None, None, "<|x|>", "t"), (3, 0, "user", "")]
    rows += [(9, i, "assistant" if i % 3 else "user", f"turn {i} " + "y" * (i % 7)) for i in range(1000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.digests(out).collect()}
    form = {r.conv_id: r for r in out.collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda x: ((-1 if x[0] is None else x[0]), x[1], x[2]))
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), SHA("".join(f"{a}\n{t}\n" for _, a, t in own)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), SHA(loss), len(form[c].formatted))
        spans = [form[c].formatted[m.start: m.start + m.size] for m in form[c].loss_mask]
        assert "".join(s.replace("\\l", "<").replace("\\b", "\\") for s in spans) == loss
    assert form[1].formatted.count("<|start|>") == 3 and form[2].formatted.count("<|start|>") == 1  # adjacent turns merged
    assert chat_format.digests(chat_format.format_conversations(df.where("turn = 77777"))).count() == 0


def test_chat_runs_without_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat_format.digests(chat_format.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Window", plan) and plan.count("Exchange") == 1
