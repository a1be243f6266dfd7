"""Mapping typed values, and the automaton against a plain edit distance."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillweave.llm.canon_map import CanonTrie, Spelling, map_values

CATEGORIES = [(1, "Motor/Fuel"), (2, "Motor/Insurance"), (3, "Dwelling/Insurance"), (4, "Children/Toys & Games"), (5, "Charges/Currency Conversion")]
PAYEES = [(10, "Zuweahal Garage"), (11, "Wiwujoax Laundry"), (12, "Wiwujoax Ceramics"), (13, "Bastemeand Bistro")]


@pytest.mark.parametrize(
    "value, want",
    [("motor > FUEL ", 1), ("Fuel/Motor", 1), ("MotorFuel", 1), ("Mötör (füel)", 1), ("fuel", 1), ("Insurance", 0), ("dweling/insuarnce", 3), ("toys and games", 4), ("Charges/Currency Con.", 5), ("Stud Farm", 0), ("??", 0), (" \t", None), (None, None), ("", None)],
)
def test_categories(value, want):
    assert CanonTrie(CATEGORIES, "last").find(value) == want


@pytest.mark.parametrize(
    "value, want",
    [("POS 5189 zuweahal garage", 10), ("Zwhl Garage", 10), ("zuweahal's", 10), ("Z U W E A H A L  garage", 10), ("Wiwujoax", 0), ("wiwujoax cera.", 12), ("LAUNDRY, WIWUJOX", 11), ("bASTEMEANDbISTRO", 13), ("the Bastemeand Bistro (receipt 9)", 13), ("Quuhioslond Bistro", 0), ("x " * 300, 0)],
)
def test_payees(value, want):
    assert CanonTrie(PAYEES, "first").find(value) == want


def test_equally_near_entries():
    twins = CanonTrie([(1, "Folaistock Pharmacy"), (2, "Folofiock Pharmacy"), (3, "Abcdefgh Shop"), (4, "Abcdefgi Shop")], "first")
    assert twins.find("Folasiock Pharmacy") == 1
    assert twins.find("Abcdefgx Shop") == 0


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=7), min_size=1, max_size=6, unique=True), st.text("abc", min_size=1, max_size=8), st.integers(0, 3))
def test_automaton_is_the_edit_distance(words, text, errors):
    trie = CanonTrie(list(enumerate(words, 1)), "first")
    got = {(n, d) for kind, d, numbers in trie.walk_one(text, errors) if kind == "full" for n in numbers}
    assert got == {(n, osa(text, w)) for n, w in enumerate(words, 1) if osa(text, w) <= errors}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=8, unique=True), st.lists(st.text("abcd", max_size=12), max_size=9))
def test_walking_together_is_walking_alone(words, texts):
    """Texts that walk the trie in one array of machine words meet what each meets by itself."""
    spelling = Spelling("first", errors=(2, 4, 8))
    trie = CanonTrie(list(enumerate([*words, "ab cd"], 1)), spelling)
    order = lambda hits: sorted((k, d, sorted(n)) for k, d, n in hits)
    alone = [order(trie.walk_one(t, spelling.allowed_errors(len(t)))) if t else [] for t in texts]
    assert [order(h) for h in trie.walk(texts)] == alone


def test_the_nearest_of_all_windows_counts():
    trie = CanonTrie([(1, "green market"), (2, "corner bakery")], "first")
    assert trie.find("greeb markit corner bakary") == trie.find("corner bakary greeb markit") == 2
    assert trie.find("x" * 70 + " green markit") == 1
    long = "very " * 20 + "long name"
    assert CanonTrie([(5, long)], "first").find(long.replace("g", "q", 1)) == 5


def test_rows(spark):
    canon = spark.createDataFrame([(n, "category", name) for n, name in CATEGORIES] + [(99, "category", None), (98, "payee", "Fuel Fuel")], "canon_id int, kind string, name string")
    df = spark.createDataFrame([(1, "fuel", 3), (1, "fuel", 3), (2, None, 3), (3, " ", 3), (4, "nothing", 3)], "row_id long, category string, canon_id int")
    assert sorted(map(tuple, map_values(df, canon, "category", "category", "row_id").collect())) == [(1, 1), (1, 1), (4, 0)]
    assert map_values(df.limit(0), canon, "category", "category", "row_id").count() == 0
    assert {r.canon_id for r in map_values(df, canon.limit(0), "category", "category", "row_id").collect()} == {0}
    with pytest.raises(ValueError):
        map_values(df, canon, "category", "category", "row_id", max_entries=2)


def test_a_split_or_joined_name_with_additions_is_found():
    trie = CanonTrie([(1, "Stagraflios Fuels"), (2, "Brosek Hardware")], "first")
    typed = {"Stagra flios Fuels 4412": 1, "StagrafliosFuels 4412": 1, "card StagrafliosFuels 4412 IE": 1, "Sta gra flios Fuels ref 4412": 1, "POS Bro sek Hard ware 77": 2, "S t a g r a f l i o s Fuels 4412": 1, "card 4412 IE": 0}
    assert {v: trie.find(v) for v in typed} == typed
