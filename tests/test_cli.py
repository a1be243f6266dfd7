"""The commands end to end on small files."""

import csv
import io
import json

import pytest

from tillweave.cli import main
from tillweave.config.rules import read_rules

LEDGER = """date,description,amount,balance,currency,account,source_file,page,row,category,subcategory,is_transfer
2025-09-02,Quarry wages 36/25,1712.40,,GBP,tern_main,tern.csv,,1,Work,Wages,False
2025-09-03,Ferry pass Oban,-61.75,,GBP,tern_main,tern.csv,,2,Travel,Ferry,False
2025-09-03,Lamp oil & wicks,-18.05,,GBP,knot_card,knot.csv,,1,,,False
2025-09-09,Sweep to rainy day,-240.00,,GBP,tern_main,tern.csv,,3,Sweep,,True
2025-09-10,Sweep received,240.00,,GBP,knot_card,knot.csv,,2,Sweep,,True
2025-09-28,Stall 14 fair,-33.30,,GBP,tern_main,tern.csv,,4,,,False
2025-09-30,Saving club,-25.00,,GBP,tern_main,tern.csv,,5,Saving,Club,False
"""


@pytest.fixture
def ledger(tmp_path, spark):
    path = tmp_path / "ledger.csv"
    path.write_text(LEDGER)
    return path


def chart(ledger, tmp_path, what, *more, first="2025-09-01", last="2025-09-30"):
    return main(["chart", what, "--in", str(ledger), "--from", first, "--to", last, "--out", str(tmp_path / "out"), *more])


@pytest.mark.parametrize("what", ["sankey", "monthly", "savings", "overview"])
def test_charts_count_and_write(ledger, tmp_path, capsys, what):
    assert chart(ledger, tmp_path, what) == 0
    said = capsys.readouterr().out
    assert "read 7 row(s); 7 in range; 2 uncategorised; 0 unmatched transfer(s)" in said
    assert "Stall 14" not in said
    page = (tmp_path / "out" / f"{what}.html").read_text()
    assert "<svg" in page and "http-equiv" not in page


def test_overview_sections(ledger, tmp_path):
    assert chart(ledger, tmp_path, "overview") == 0
    page = (tmp_path / "out" / "overview.html").read_text()
    for anchor in ("header", "stat-tiles", "sankey", "rankings-movers", "trends", "notables", "data-health"):
        assert f'id="{anchor}"' in page
    assert "monthly-trend" not in page
    assert chart(ledger, tmp_path, "overview", last="2025-10-02") == 0
    assert "monthly-trend" in (tmp_path / "out" / "overview.html").read_text()


def test_unmatched_and_range(ledger, tmp_path, capsys):
    with ledger.open("a") as f:
        f.write("2025-09-20,Sweep to nowhere,-58.90,,GBP,knot_card,knot.csv,,3,Sweep,,True\n")
    assert chart(ledger, tmp_path, "sankey") == 0
    assert "1 unmatched" in capsys.readouterr().out
    rows = list(csv.DictReader((tmp_path / "out" / "unmatched_transfers.csv").open()))
    assert [r["amount"] for r in rows] == ["-58.90"] and "pair_id" not in rows[0] and rows[0]["is_transfer"] == "True"
    assert chart(ledger, tmp_path, "sankey", last="2025-09-09") == 0
    assert "4 in range; 1 uncategorised" in capsys.readouterr().out


def test_errors_tell_no_cell_text(ledger, tmp_path, capsys):
    assert chart(ledger, tmp_path, "overview", first="2030-01-01", last="2030-02-01") == 1
    assert chart(ledger, tmp_path, "monthly", first="2025-10-01", last="2025-09-01") == 1
    ledger.write_text(LEDGER.replace("-61.75", "SECRET"))
    assert chart(ledger, tmp_path, "monthly") == 1
    out = capsys.readouterr()
    assert "SECRET" not in out.err + out.out and "amount" in out.err


RULES = """
- {match: contains, pattern: Ferry, category: Travel/Boat}
- {match: prefix, pattern: Sweep to, category: Sweep, transfer: true}
- {match: regex, pattern: "^Quarry (?P<what>[a-z]+)", category: Work, extract: what}
"""


def test_categorise_gate_and_report(ledger, tmp_path, capsys):
    rules = tmp_path / "rules.yaml"
    rules.write_text(RULES)
    out = tmp_path / "cat.csv"
    args = ["categorise", "--rules", str(rules), "--in", str(ledger), "--out", str(out)]
    # 18.05 + 240.00 + 33.30 + 25.00 stay open.
    assert main([*args, "--tolerance", "316.35"]) == 0
    assert main([*args, "--tolerance", "316.34"]) == 1
    rows = list(csv.DictReader(out.open()))
    assert [r["category"] for r in rows] == ["Work", "Travel", "", "Sweep", "", "", ""]
    assert rows[0]["subcategory"] == "wages" and rows[3]["is_transfer"] == "True" and rows[0]["amount"] == "1712.40"
    assert main(["report", "--in", str(out), "--out", str(tmp_path / "open.csv")]) == 0
    assert [r["description"] for r in csv.DictReader((tmp_path / "open.csv").open())] == ["Sweep received", "Stall 14 fair", "Saving club", "Lamp oil & wicks"]
    assert [r["count"] for r in csv.DictReader((tmp_path / "open_by_description.csv").open())] == ["1"] * 4
    # A path that ends with a slash is a folder of files, which the commands read as they read one file.
    assert main(["categorise", "--rules", str(rules), "--in", str(ledger), "--out", f"{tmp_path}/many/", "--tolerance", "316.35"]) == 0
    assert main(["report", "--in", f"{tmp_path}/many/", "--out", f"{tmp_path}/left/"]) == 0
    assert sorted(r["description"] for f in (tmp_path / "left").glob("*.csv") for r in csv.DictReader(f.open())) == ["Lamp oil & wicks", "Saving club", "Stall 14 fair", "Sweep received"]
    assert list((tmp_path / "left_by_description").glob("*.csv"))


def test_triage(ledger, tmp_path, monkeypatch, capsys):
    rules = tmp_path / "rules.yaml"
    rules.write_text(RULES)
    monkeypatch.setattr("sys.stdin", io.StringIO("//broken\nt\nSweep/In\ns\ns\ns\n"))
    assert main(["triage", "--in", str(ledger), "--rules", str(rules)]) == 0
    last = read_rules(rules)[-1]
    assert (last.pattern, last.category, last.account, last.transfer) == ("Sweep received", "Sweep/In", "knot_card", True)
    assert len(list(tmp_path.glob("rules.yaml.*.bak"))) == 1
    assert "1 rule(s) accepted, 3 skipped; uncategorised before=4 after=3" in capsys.readouterr().out


def test_parse_csv(tmp_path, capsys, spark):
    head = "Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance\n"
    a, out = tmp_path / "a.csv", tmp_path / "rows.csv"
    a.write_text(head + 'CARD,Pot,2025-09-12 07:41:09,,"Kiln, 2 bricks",-7.15,0,GBP,DONE,212.85\nIN,Pot,2025-09-13 18:00:00,,Refund,+3,0,GBP,DONE,215.85\n')
    assert main(["parse", str(a), str(a), "--profile", "revolut_current", "--output", str(out)]) == 0
    rows = list(csv.DictReader(out.open()))
    assert [(r["date"], r["description"], r["amount"], r["balance"], r["row"]) for r in rows] == [("2025-09-12", "Kiln, 2 bricks", "-7.15", "212.85", "1"), ("2025-09-13", "Refund", "3.00", "215.85", "2")]
    a.write_text(head.replace("Amount", "Sum"))
    assert main(["parse", str(a), "--profile", "revolut_current", "--output", str(out)]) == 1
    assert main(["parse", str(a), "--profile", "nowhere", "--output", str(out)]) == 1


def test_migrate_rules(tmp_path, capsys, spark):
    """Sources come as lists of lines or as one text; outputs are never looked at."""
    first = "import math\nif math:\n    details_category_map = rev_details_category_map = {'Old': 'Gone'}\n"
    second = ["details_category_map: dict = {\n", "  'Peat ' 'merchant': 'Home (Heat (Peat))',\n", "  'Pot 3': 'Vault (Rain)'}\n"]
    third = "(x, rev_details_category_map) = (1, {'Oar': 'Boat', 7: 'top-up'})"
    book = {"cells": [
        {"cell_type": "code", "source": first, "outputs": [{"text": "hidden"}]},
        {"cell_type": "markdown", "source": "details_category_map = {'Not': 'Code'}"},
        {"cell_type": "code", "source": second},
        {"cell_type": "code", "source": ["!ls\n", "details_category_map = {}"]},
        {"cell_type": "code", "source": third},
        {"cell_type": "code", "source": "details_category_map = dict(zip('ab', 'cd'))"},
    ]}
    path, out = tmp_path / "n.ipynb", tmp_path / "rules.yaml"
    path.write_text(json.dumps(book))
    assert main(["migrate-rules", str(path), "--out", str(out)]) == 0
    assert [(r.pattern, r.category, r.account, r.transfer) for r in read_rules(out)] == [
        ("Peat merchant", "Home/Heat (Peat)", "boi_current", False), ("Pot 3", "Vault/Rain", "boi_current", True), ("Oar", "Boat", "revolut_current", False), ("7", "top-up", "revolut_current", True),
    ]
    assert main(["migrate-rules", str(path), "--out", str(out)]) == 1
