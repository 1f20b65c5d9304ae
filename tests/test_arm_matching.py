"""Every stage of the arm matcher on literal titles, and the longest common part against all substrings."""

import random
import time

import pytest

from kgspark.operators import arm_matching


def plain(texts):
    s = texts[0] if texts else ""
    best = ""
    for i in range(len(s)):
        for j in range(i + len(best) + 1, len(s) + 1):
            if all(s[i:j] in t for t in texts):
                best = s[i:j]
            else:
                break
    return best


def test_longest_common_part_matches_all_substrings():
    rng = random.Random(2)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefgh "])
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 4))]
        assert arm_matching.longest_common(texts) == plain(texts), texts
    assert arm_matching.longest_common([]) == arm_matching.longest_common(["", "a"]) == ""
    assert arm_matching.longest_common(["xäy🙂z", "äy🙂"]) == "äy🙂"


def test_long_titles_take_linear_time():
    rng = random.Random(3)
    shared = "".join(rng.choice("abc ") for _ in range(2000))
    pad = lambda: "".join(rng.choice("abcdefghijk ") for _ in range(1500))
    texts = [pad() + shared + pad() for _ in range(4)]
    begin = time.perf_counter()
    found = arm_matching.longest_common(texts)
    assert shared in found and time.perf_counter() - begin < 3
    assert arm_matching.longest_common(["a" * 5000, "a" * 4000]) == "a" * 4000


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("Zinc plus Iron & gold", "zinc + iron + gold"), ("Arm A: 5,000 mg.", "arm a : 5,000 mg ."), ("group (high)", "group ( high )"), ("Zäh and", "zh +"), (None, ""), ("plusses android", "plusses android")],
)
def test_normalised(spark, raw, wanted):
    assert spark.createDataFrame([(raw,)], "t string").select(arm_matching.normalised(arm_matching.F.col("t"))).first()[0] == wanted


ARM = {"description": None, "drugs": [], "drug_ids": [], "names": [], "incomplete": False, "non_drug": False}
CASES = {
    # title, other titles, arms in order -> (arm, stage)
    "one and one": ("anything", [], [{"label": "else"}], (0, 0)),
    "no title": ("", ["zinc"], [{"label": ""}, {"label": "zinc"}], None),
    "label": ("Zinc", ["iron"], [{"label": "iron"}, {"label": "ZINC"}], (1, 1)),
    "label given twice": ("Zinc", ["iron"], [{"label": "zinc"}, {"label": "iron"}, {"label": "Zinc"}], (2, 1)),
    "and is plus": ("Zinc and iron", ["x"], [{"label": "zinc + iron"}, {"label": "y"}], (0, 1)),
    "without spaces": ("Zinc-10", ["x"], [{"label": "zinc 10"}, {"label": "y"}], (0, 2)),
    "description": ("daily zinc", ["x"], [{"label": "a1", "description": "daily zinc"}, {"label": "y"}], (0, 3)),
    "description without spaces": ("daily-zinc", ["x"], [{"label": "a1", "description": "daily zinc"}, {"label": "y"}], (0, 4)),
    "cut": ("study of zinc", ["study of iron"], [{"label": "zinc"}, {"label": "iron"}], (0, 5)),
    "cut without spaces": ("study: zinc 10", ["study: gold 7"], [{"label": "zinc-10"}, {"label": "gold-7"}], (0, 6)),
    "cut description": ("study of daily zinc", ["study of old iron"], [{"label": "p", "description": "daily zinc"}, {"label": "r"}], (0, 7)),
    "cut description without spaces": ("study of daily-zinc", ["study of old iron"], [{"label": "p", "description": "daily zinc"}, {"label": "r"}], (0, 8)),
    "cystic fibrosis": ("healthy cystic fibrosis", ["x"], [{"label": "healthy cf"}, {"label": "y"}], (0, 9)),
    "words in another order": ("iron/zinc", ["x"], [{"label": "y"}, {"label": "zinc iron"}], (1, 10)),
    "filler words": ("patients zinc dose", ["x"], [{"label": "y"}, {"label": "zinc"}], (1, 10)),
    "title behind its colon": ("Cohort one: zinc", ["x"], [{"label": "y"}, {"label": "zinc"}], (1, 11)),
    "label behind its colon": ("zinc", ["x"], [{"label": "y"}, {"label": "best: zinc"}], (1, 11)),
    "drugs": ("zinc + iron", ["x"], [{"label": "y"}, {"label": "p", "drugs": ["Iron", "Zinc"]}], (1, 12)),
    "drugs of an incomplete arm": ("zinc + iron", ["x"], [{"label": "y"}, {"label": "p", "drugs": ["Iron", "Zinc"], "incomplete": True}], None),
    "drugs of a device arm": ("zinc + iron", ["x"], [{"label": "y"}, {"label": "p", "drugs": ["Iron", "Zinc"], "non_drug": True}], None),
    "names": ("zincum", ["x"], [{"label": "y"}, {"label": "p", "drugs": ["zinc"], "names": ["Zincum"]}], (1, 12)),
    "names in brackets": ("zn + fe", ["x"], [{"label": "y"}, {"label": "p", "names": ["zinc (Zn)", "iron (Fe)"]}], (1, 12)),
    "first arm by any rule": ("best: zinc", ["x"], [{"label": "p", "drugs": ["zinc"]}, {"label": "zinc"}], (0, 12)),
    "title is a number": ("arm 2", ["x"], [{"label": "y"}, {"label": "arm 2 of gold"}], (1, 13)),
    "label is a number": ("group ii of gold", ["x"], [{"label": "y"}, {"label": "group ii"}], (1, 13)),
    "not the number alone": ("arm 2 gold", ["x"], [{"label": "y"}, {"label": "arm 2 silver"}], None),
    "mentioned drugs": ("some words", ["x"], [{"label": "y", "drug_ids": ["Z"]}, {"label": "p", "drug_ids": ["I", "Z"]}], (1, 14)),
    "nothing": ("nobody", ["x"], [{"label": "y"}, {"label": "p"}], None),
}


def test_stages(spark):
    groups, arms = [], []
    for trial, (title, others, given, _) in CASES.items():
        groups += [(trial, "G", title, ["Z", "I", "Z"])] + [(trial, f"O{k}", t, None) for k, t in enumerate(others)]
        arms += [(trial, k, *({**ARM, **a}[c] for c in ("label", *ARM))) for k, a in enumerate(given)]
    g = spark.createDataFrame(groups, "trial string, group_id string, title string, mention_ids array<string>")
    a = spark.createDataFrame(arms, "trial string, arm_id int, label string, description string, drugs array<string>, drug_ids array<string>, names array<string>, incomplete boolean, non_drug boolean")
    out = arm_matching.match_groups(g, a)
    assert out.count() == len(groups)
    found = {r.trial: None if r.stage is None else (r.arm_id, r.stage) for r in out.where("group_id = 'G'").collect()}
    assert not {k: (found[k], want) for k, (*_, want) in CASES.items() if found[k] != want}
    few = arm_matching.match_groups(g.drop("mention_ids"), a.select("trial", "arm_id", "label"))
    assert few.count() == len(groups) and few.where("stage in (3, 4, 7, 8, 12, 14)").count() == 0
    assert arm_matching.match_groups(g.where("false"), a).count() == 0
