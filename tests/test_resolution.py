"""Every branch of name resolution and of the intervention cascade, on literal rows."""

import pytest

from kgspark.operators import resolution

NAMES = [
    ("zinc", "primary", "Z"), ("iron", "synonym", "I"), ("shared", "brand", "B1"), ("shared", "brand", "B2"), ("shared", "chemical", "X"), ("doxorubicin", "primary", "DOX"),
    ("spaced name", "product", "SN"), ("halfa", "primary", "H1"), ("halfb", "brand", "H2"), ("halfb", "brand", "H3"), ("deep name", "primary", "DN"), ("peginterferon alfa-2a", "primary", "PEG"),
    ("abc-12-long", "primary", "ABC"), ("iron oxide", "primary", "IO"), ("saline", "primary", "SAL"), ("gold", "primary", "G"), ("silver", "primary", "AG"), ("unii-part", "primary", "UP"),
]
CODES = [("1", "external", "E1"), ("2", "vocabulary", "V2"), ("2", "vocabulary", "V1"), ("3", "precomputed", "P3"), ("4", "precomputed", "P4"), ("1", "vocabulary", "V0"), ("6", "precomputed", "P6")]
PREFERRED = [("4", "Zinc (Deep-Name)"), ("5", "Unknown (Words)"), ("6", "Nothing + Nowhere")]
WEB = [("ab-123", "W1"), ("abcd-123", "W2")]


@pytest.fixture(scope="module")
def tables(spark):
    f = spark.createDataFrame
    return f(NAMES, "name string, category string, id string"), f(CODES, "code string, map string, id string"), f(PREFERRED, "code string, preferred string")


def test_resolution_tiers(spark, tables):
    cases = {
        ("zinc", None): (1, ["Z"], 0),
        ("zinc-xr", ""): (1, ["Z"], 0),  # dosage marks are cut
        ("liposomal doxorubicin", ""): (1, ["DOX"], 0),  # rewritten
        ("zinc", "1"): (1, ["Z"], 0),  # before the code
        ("shared", "1"): (2, ["E1"], 0),  # several ids: the code first
        ("unknown", "2"): (3, ["V1", "V2"], 0),
        ("unknown", "4"): (4, ["DN", "Z"], 2),  # parts of the preferred name, one of them by its spaced form; before the precomputed map
        ("unknown", "3"): (5, ["P3"], 0),
        ("unknown", "6"): (5, ["P6"], 0),  # a preferred name that leads nowhere
        ("shared", "5"): (6, ["B1", "B2"], 0),  # one category, nothing by the code
        ("ab-123", ""): (9, ["W1"], 0),
        ("abcd-123", ""): (None, None, None),  # not such a name
        ("spaced-name", ""): (7, ["SN"], 1),
        ("spaced-name", "3"): (5, ["P3"], 0),
        ("halfa-halfb", ""): (8, ["H1", "H2", "H3"], 1),
        ("halfa-nobody", ""): (None, None, None),  # both halves are asked for
        ("abc-12-long", ""): (1, ["ABC"], 0),
        ("nobody", "5"): (None, None, None),
        ("", ""): (None, None, None),
        (None, "1"): (2, ["E1"], 0),
    }
    rows = [(k, *nc) for k, nc in enumerate(cases)]
    out = resolution.resolve(spark.createDataFrame(rows + rows[:3], "key int, name string, code string"), *tables, spark.createDataFrame(WEB, "name string, id string")).collect()
    assert len(out) == len(rows) + 3
    found = {r.key: (r.tier, r.ids, r.round) for r in out}
    assert {nc: found[k] for k, *nc in rows for nc in [tuple(nc)]} == cases
    assert {r.key: r.name for r in out}[1] == "zinc"


def test_no_names_to_resolve(spark, tables):
    none = spark.createDataFrame([], "key int, name string, code string")
    assert resolution.resolve(none, *tables).count() == 0
    one = spark.createDataFrame([(1, "a-b", "")], "key int, name string, code string")
    assert resolution.resolve(one, *(t.where("false") for t in tables)).first().ids is None


M = lambda *pairs: [{"text": t, "code": c} for t, c in pairs]
CASES = {
    # type, name, other names, mentions, other mentions -> ids, incomplete, non_drug
    "device": (("Device", "Pump", ["zinc"], None, None), ([], False, True)),
    "other placebo": (("Other", "Placebo cream", None, None, None), (["PLACEBO"], False, False)),
    "other placebo and more": (("Other", "Placebo + zinc", None, None, None), ([], False, True)),
    "placebo": (("Drug", "Placebo", None, None, None), (["PLACEBO"], False, False)),
    "placebo in other names": (("Drug", "Zinc", ["vehicle"], None, None), (["PLACEBO"], False, False)),
    "all parts placebo": (("Drug", "placebo + saline", None, None, None), (["PLACEBO"], False, False)),
    "placebo then drug is none": (("Drug", "placebo then zinc", None, M(("zinc", "")), None), (["Z"], False, False)),
    "partly placebo": (("Drug", "Zinc powder plus placebo", None, M(("zinc", "")), None), (["PLACEBO", "Z"], False, False)),
    "placebo part out of the text": (("Drug", "gold & zinc placebo", None, M(("zinc", ""), ("gold", "")), None), (["G", "PLACEBO"], False, False)),
    "name": (("Drug", "Zinc", None, M(("iron", "")), None), (["Z"], False, False)),
    "other names": (("Drug", "Unheard", ["Iron", "zinc"], None, None), (["I", "Z"], False, False)),
    "name gives fewer": (("Drug", "Zinc", ["iron", "gold"], None, None), (["Z"], False, False)),
    "name gives more": (("Drug", "shared", ["zinc"], None, None), (["Z"], False, False)),
    "one other name fails": (("Drug", "zinc", ["iron", "nobody"], None, None), (["Z"], False, False)),
    "mentions": (("Drug", "gold with silver wire", None, M(("gold", ""), ("silver", "")), None), (["AG", "G"], False, False)),
    "mention of a code": (("Drug", "gold with extract", None, M(("gold", ""), ("extract", "2")), None), (["G", "V1", "V2"], False, False)),
    "unresolved mention": (("Drug", "gold with nothing", None, M(("gold", ""), ("nothing", "")), None), (["G"], True, False)),
    "completed mention": (("Drug", "dose of abc-12-long daily", None, M(("abc", "")), None), (["ABC"], False, False)),
    "brackets": (("Drug", "mix of gold (silver)", None, M(("gold (silver)", "")), None), (["AG", "G"], False, False)),
    "inside a resolved other name": (("Drug", "unheard", ["iron oxide", "nobody"], None, M(("oxide", ""))), (["IO"], True, False)),  # then the other names' parts, of which nobody is unknown
    "not inside one": (("Drug", "unheard", ["red gold", "nobody"], None, M(("gold", ""))), (["G"], False, False)),
    "parts of other names": (("Drug", "unheard", ["gold + silver", "nobody"], None, None), (["AG", "G"], True, False)),
    "not in the text": (("Drug", "wire", None, M(("gold", "")), None), ([], False, False)),
    "short": (("Drug", "tin and gold wire", None, M(("tin", ""), ("gold", "")), None), (["G"], False, False)),
    "stopped": (("Drug", "vaccine of gold", None, M(("vaccine", ""), ("gold", "")), None), (["G"], False, False)),
    "within another name": (("Drug", "an iron oxide", None, M(("iron", ""), ("iron oxide", "")), None), (["IO"], False, False)),
    "interferon": (("Drug", "pegylated interferon alfa-2a twice", None, M(("interferon", "")), None), (["PEG"], False, False)),
    "own name": (("Drug", "Silver of own", None, M(("silver", ""), ("nothing of", ""), ("of own", "")), None), (["AG"], False, False)),
    "no name at all": (("Drug", None, None, None, None), ([], False, False)),
    "no type": ((None, "zinc", None, None, None), ([], False, True)),
}


def test_intervention_cascade(spark, tables):
    kind = "array<struct<text:string,code:string>>"
    frame = spark.createDataFrame([(k, *row) for k, (row, _) in CASES.items()], f"key string, type string, name string, other_names array<string>, mentions {kind}, other_mentions {kind}")
    primary = spark.createDataFrame([("AG", "silver of OWN"), ("G", "something else")], "id string, name string")
    out = {r.key: (r.ids, r.incomplete, r.non_drug) for r in resolution.link_interventions(frame, *tables, primary).collect()}
    wrong = {k: (out[k], want) for k, (_, want) in CASES.items() if out[k] != want}
    assert not wrong, wrong
    assert resolution.link_interventions(frame.where("false"), *tables, primary).count() == 0
