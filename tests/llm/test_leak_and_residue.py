"""Leak search against word n-grams, and residue cells."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import residue_examples as X
from tillweave.llm import leak_search as L
from tillweave.llm import residue as R

RND = random.Random(5)
WORDS = [f"w{i}" for i in range(120)]
ITEMS = [(i, " ".join(RND.choice(WORDS) for _ in range(RND.choice([5, 11, 12, 40])))) for i in range(1, 25)]


def text_with(n):
    out = [RND.choice(WORDS + ["zz", "yy"]) for _ in range(30)]
    for _ in range(n):
        w = RND.choice(ITEMS)[1].split()
        a = RND.randrange(0, max(1, len(w) - 11))
        out += w[a : a + RND.choice([11, 12, 13, 20])] + [RND.choice(["zz", RND.choice(WORDS)])]
    return RND.choice([" ", "\n> ", "**, _"]).join(out)


def brute(docs):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
    return sorted((i, d) for d, t in docs for i, p in ITEMS if grams(split(p)) & grams(split(t)))


def test_leaks_against_brute_force(spark):
    docs = [(1000 + k, text_with(RND.randrange(0, 4))) for k in range(80)] + [(2000, None), (2001, ""), (2002, " ".join(WORDS) * 200)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as run", "2 as item_id")
    items = spark.createDataFrame(ITEMS + [(77, None), (78, "")], "item_id int, passage string")
    got = L.find_leaks(d, items).filter("run > 0")
    assert sorted((r.item_id, r.doc_id) for r in got.collect()) == brute(docs)
    assert L.find_leaks(d, items.limit(0)).count() == 0 and L.find_leaks(d.limit(0), items).count() == 0
    twice = L.find_leaks(d.unionByName(d), items).filter("run > 0")
    assert twice.count() == 2 * len(brute(docs))


PASSAGE = "seven copper lanterns hung over the quiet harbour while Maro counted 58 ropes and Tilda mended 31 sails before the storm reached the northern pier at dusk on Friday evening with heavy rain and wind from the bay"


def test_rewordings_keep_order_and_telling_words(spark):
    near = PASSAGE.replace("quiet", "calm").replace("mended", "repaired").replace("heavy", "hard")
    short = PASSAGE.split(" before")[0].replace("quiet", "calm").replace("mended", "repaired")
    docs = [(1, "intro " * 20 + near + " outro" * 20), (2, " ".join(reversed(PASSAGE.split())) + " x" * 30), (3, None), (4, "other words " * 40), (5, short), (6, ""), (7, PASSAGE)]
    got = L.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, PASSAGE)], "item_id int, passage string"))
    rows = {r.doc_id: r for r in got.collect()}
    assert sorted(rows) == [1, 5, 7] and all(r.common >= 0.5 and r.answers >= 0.5 for r in rows.values())
    assert rows[7].run == len(PASSAGE.split()) and rows[5].run == 0 and rows[7].common == 1.0


def reworded(words, rnd):
    """A part of a passage with a fifth of its words replaced, some dropped and some changed places."""
    size = rnd.randrange(30, 61)
    start = rnd.randrange(0, len(words) - size + 1)
    part = [f"syn{rnd.randrange(5000)}" if rnd.random() < 0.2 else w for w in words[start : start + size] if rnd.random() > 0.05]
    for k in range(0, len(part) - 1, 9):
        part[k], part[k + 1] = part[k + 1], part[k]
    return part


def test_recall_of_planted_rewordings(spark):
    """220 passages reworded and hidden in documents of the same vocabulary, beside as many without any."""
    rnd = random.Random(11)
    common = [f"c{i}" for i in range(200)]
    items = [(i, [rnd.choice(common) if rnd.random() < 0.55 else f"r{rnd.randrange(2500)}" for _ in range(rnd.randrange(60, 110))]) for i in range(1, 221)]
    prose = lambda n: [rnd.choice(common) if rnd.random() < 0.6 else f"o{rnd.randrange(4000)}" for _ in range(n)]
    docs = [(1000 + i, " ".join(prose(rnd.randrange(0, 300)) + reworded(w, rnd) + prose(rnd.randrange(0, 300)))) for i, w in items]
    docs += [(5000 + i, " ".join(prose(400))) for i in range(220)]
    got = L.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id int, passage string"))
    found = {(r.item_id, r.doc_id) for r in got.filter("common > 0").collect()}
    right = found & {(i, 1000 + i) for i, _ in items}
    print(len(right), len(found))
    assert len(right) >= 0.9 * 220 and len(right) >= 0.95 * len(found)


@pytest.mark.parametrize(
    "body, kinds",
    [
        ("# {{ title }}\n\nPrepared by {{ owner }} for the review", {"placeholder"}),
        ("## [Insert team]\n\n[Your owner], [Department]\n\nReal prose follows here.", {"placeholder"}),
        ("Lorem ipsum dolor sit amet, velit sint ipsa culpa minim", {"filler"}),
        ("Blah blah blah. Blah blah blah. Blah blah blah.", {"filler"}),
        ("<html><head><title>503 Bad Gateway</title></head><body><h1>503 Bad Gateway</h1></body></html>", {"error_page"}),
        ("Seite nicht gefunden. Die angeforderte Datei existiert nicht (Fehler 503).", {"error_page"}),
        ('{"message": "Not Found", "status": 404, "trace": "5de0"}', {"error_page"}),
        ("Please enable JavaScript to view this notebook.\r\n\r\nMore prose about the crane data.", {"script_notice"}),
        ("<noscript>Turn on scripting to see the chart.</noscript>", {"script_notice"}),
        ("The parser drops pages whose body says that the page was not found; 85 of them were in the crawl.", set()),
        ("Responses with status 404 made up 1.1 % of the traffic, those with 503 far less.", set()),
        ("Do not leave the lorem ipsum of the theme in a report: readers notice it at once.", set()),
        ("You can choose whether visitors must have JavaScript; the static export works without it.", set()),
        (r"The number of ways is $\frac{{n}}{{k}} \cdot {{m}\choose{k}}$ for every crane.", set()),
        ("Traceback (most recent call last)\n  File \"f.py\", line 3, in get\nHTTPError: 404 Client Error: Not Found for x.csv", set()),
        ("<|endoftext|> [CLS] <pad>", set()),
        ("", set()),
    ],
)
def test_residue_of_a_cell(body, kinds):
    assert R.cell_kinds(body, True) == kinds


@pytest.mark.parametrize("kind, bodies", [
    ("error_page", ["400 Bad Request", "500 Server Error", "HTTP 503", "Error 500", "410 Gone", "401 <b>Unauthorized</b>", '{"message": "Bad Request"}', '{"detail": "503 upstream"}', "Internal\nServer  Error"]),
    ("placeholder", [
        "{{ owner }}", "@@OWNER@@", "${owner}", "#{owner}", "{% block title %}", "<%= owner %>", "[[owner]]", "[Insert team]", "[Enter project name]", "[Add summary]", "[Your name here]", "# <PROJECT NAME>", "&lt;project name&gt;", "__OWNER__", "%OWNER%", "YOUR_NAME_HERE", "Hi {Name1}", "Dear {Name1}",
        "{1} of {2}", "write your summary here", "put your name here", "add your name here", "(edit me)", "Replace this text with prose", "To be filled in: ____", "<title goes here>", "Click to edit",
    ]),
    ("filler", ["Lorem dolor sit elit sed"]),
])
def test_each_accepted_shape_alone_in_a_cell_is_found(kind, bodies):
    assert [b for b in bodies if kind not in R.cell_kinds(b, True)] == []


def recall(examples):
    flat = [(kind, t) for kind, by in examples.items() for texts in by.values() for t in texts]
    return sum(kind in R.cell_kinds(t, True) for kind, t in flat) / len(flat)


def test_recall_on_residue_in_twenty_languages():
    assert recall(X.DEVELOPED) >= 0.97
    assert recall(X.HELD_OUT) >= 0.9
    assert [t for t in X.PROSE if R.cell_kinds(t, True)] == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["error", "HTTP", "502", "not", "found", "{{owner}}", "[Insert", "name]", "lorem", "ipsum", "dolor", "blah", "page", "JavaScript", "enable", "\n", "\n\n", "<b>", "&amp;", "%OWNER%", "__NAME__", "{a}", "crane", "is", "write your", "here", "页面", "不存在"]), max_size=12))
def test_what_no_automaton_meets_is_no_residue(parts):
    """The trigger automata are the only way into the checks, and hold whatever a check accepts."""
    text = " ".join(parts)
    kinds = R.cell_kinds(text, False)
    met = {c for _, (_, checks) in R.triggers().iter(R._tidy(text)) for c in checks}
    field = next(R.field_marks().iter(text), None)
    assert not kinds & {"error_page", "script_notice"} or "message" in met
    assert "filler" not in kinds or "filler" in met
    assert "placeholder" not in kinds or field or "instruction" in met


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>{}[]%_@$#&;AbZ1 \n\t\u2028é页", max_size=60), st.booleans())
def test_any_cell_has_a_result(text, markdown):
    assert R.cell_kinds(text, markdown) <= {"placeholder", "filler", "error_page", "script_notice"}


@pytest.mark.parametrize("piece", ["[add {x} here] {a} ", "<TD>{b}</TD> ", "Error 500 at line\n", "{{ a.b ", "write your ", "__A %B% @@ ${ ", "lorem 12 ", "see [your ", "not found here] "])
def test_long_paragraphs_take_linear_time(piece):
    began = time.perf_counter()
    R.cell_kinds(piece * (400_000 // len(piece)), True)
    assert time.perf_counter() - began < 8


def test_residue_rows(spark):
    notice, schema = "Please enable JavaScript to view this notebook.", "doc_id long, text string, cells array<struct<cell_type:string,execution_count:int,char_start:int,char_end:int>>, kind int"
    rows = [
        (1, notice, [("markdown", None, 0, len(notice))], 0),
        (2, notice, [("code", 1, 0, len(notice))], 0),
        (3, f"# %%\nx = 1\n\n# %% [markdown]\n{notice}\n", None, 0),
        (4, None, None, 0),
        (5, "", [], 0),
        (6, notice, [("output", None, -5, 10_000), (None, None, 0, 5), ("output", None, None, None)], 0),
        (1, notice, [("markdown", None, 0, len(notice))], 0),
    ]
    df = spark.createDataFrame(rows, schema)
    got = R.find_residue(df)
    assert sorted((r.doc_id, r.kind) for r in got.collect()) == [(i, "script_notice") for i in (1, 1, 3, 6)]
    assert sorted(r.doc_id for r in R.without_residue(df, got).collect()) == [2, 4, 5]
    shares = {r.doc_id: r.share for r in got.collect()}
    assert shares[1] == shares[6] == 1.0 and 0.5 < shares[3] < 1
    assert sorted(r.doc_id for r in R.without_residue(df, got, exclude_share=0.99).collect()) == [2, 3, 4, 5]
    assert R.find_residue(df.limit(0)).count() == 0
