"""Rules and profiles: what is refused, and patterns in the engine's dialect."""

import copy

import pytest

from tillweave.config.errors import ProfileError, RuleError
from tillweave.config.profile import find_profile, parse_profile
from tillweave.config.rules import BUILTIN, java_pattern, parse_rule, read_rules

GOOD = {"match": "exact", "pattern": "SECRET", "category": "Food/Out"}


@pytest.mark.parametrize(
    "change",
    [
        {"match": "fuzzy"}, {"pattern": ""}, {"pattern": 5}, {"category": " "}, {"category": "Food//Out"}, {"account": ""}, {"transfer": "yes"},
        {"extract": "x"}, {"match": "regex", "pattern": "("}, {"match": "regex", "pattern": "a(?P<b>c)", "extract": "z"}, {"colour": 1},
    ],
)
def test_bad_rules(change):
    with pytest.raises(RuleError) as e:
        parse_rule(GOOD | change, 3, "rules.yaml")
    assert "rule[3]" in str(e.value) and "SECRET" not in str(e.value)


def test_missing_keys_and_files(tmp_path):
    for key in ("match", "pattern", "category"):
        with pytest.raises(RuleError):
            parse_rule({k: v for k, v in GOOD.items() if k != key}, 0, "r")
    path = tmp_path / "r.yaml"
    path.write_text("")
    assert read_rules(path) == []
    path.write_text("a: 1")
    with pytest.raises(RuleError):
        read_rules(path)
    path.write_text("- {match: [")
    with pytest.raises(RuleError):
        read_rules(path)


def test_dialect():
    assert java_pattern(r"(?P<a_b>x)\d") == r"(?dU)(x)\d"
    with pytest.raises(RuleError):
        java_pattern(r"(a)?(?(1)b)")
    assert len(BUILTIN) == 8 and BUILTIN[0].group == 1 and BUILTIN[2].path == ("Fees", "ATM Tax")


CSV = {"meta": {"name": "n", "institution": "i", "country": "IE", "source": "csv"}, "csv": {"column_map": {"D": "date", "T": "description", "A": "amount"}}}
PDF = {
    "meta": {"name": "n", "institution": "i", "country": "IE", "source": "pdf"},
    "page_detect": {},
    "columns": [{"header": h, "field": f, "align": "left_edge"} for h, f in (("Date", "date"), ("Text", "description"), ("Out", "out"), ("In", "in"))],
    "table_end": {},
    "rows": {},
    "amounts": {"style": "in_out"},
}


def changed(base, path, value):
    out = copy.deepcopy(base)
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


@pytest.mark.parametrize(
    "base, path, value",
    [
        (CSV, ["meta"], None), (CSV, ["meta", "name"], None), (CSV, ["meta", "source"], "xls"), (CSV, ["extra"], {}), (CSV, ["csv"], None), (CSV, ["csv", "column_map"], {}),
        (CSV, ["csv", "column_map", "A"], "total"), (CSV, ["csv", "column_map", "D"], None), (CSV, ["csv", "column_map", "B"], "balance"), (CSV, ["balance"], {"present": True}), (CSV, ["dates"], {"year_policy": 1}),
        (CSV, ["dates"], {"fill": "backward"}), (CSV, ["skip_rows"], [{"field": "balance", "equals": "x"}]), (CSV, ["skip_rows"], {}), (CSV, ["amounts"], {"style": "in_out"}), (CSV, ["rows"], {}),
        (PDF, ["csv"], CSV["csv"]), (PDF, ["columns"], []), (PDF, ["columns", 0, "align"], "center"), (PDF, ["columns", 0, "field"], "when"), (PDF, ["table_end"], {"strategy": "footer_text"}), (PDF, ["rows"], None), (PDF, ["amounts"], {"style": "signed"}),
    ],
)
def test_bad_profiles(base, path, value):
    parse_profile(base)
    with pytest.raises(ProfileError):
        parse_profile(changed(base, path, value))


def test_shipped_profiles():
    assert find_profile("boi_current").check_balance == "continuity" and find_profile("revolut_current").column_map["Amount"] == "amount"
    with pytest.raises(ProfileError):
        find_profile("nothing")
