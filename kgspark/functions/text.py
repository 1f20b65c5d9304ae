"""Text normalisers: Column in, Column out, all inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Adjectives without meaning for matching, in lower case (and capitalised).
ADJECTIVES = [
    "major", "active", "primary", "other", "desire", "probable", "additional", "severe", "significant", "poor", "poorer", "suspected", "prescribed",
    "normal", "chronic", "serious", "adequate", "another", "or", "mild", "mildly", "uncontrolled", "treated", "untreated", "controlled",
]
# Suffixes stripped from a drug code, in this order, once each.
CODE_SUFFIXES = ["-", "-single", "-multiple", "-severe", "-moderate", "-xr", "-sr", ".", ";", ",", " er"]
# Names that are looked up under another one.
NAME_REWRITES = {
    "liposomal doxorubicin": "doxorubicin",
    "biphasic insulin aspart": "insulin aspart",
    "as2-1": "astugenal",
    "estrogen": "estradiol",
    "botulinum toxin": "botulinum toxin type a",
    "bupivicaine": "bupivacaine",
    "su011248": "sunitinib",
    "insulin nph": "nph insulin",
    "regular insulin": "insulin regular",
    "recombinant interferon alfa-2b": "interferon alfa-2b, recombinant",
}
# Conditions that are looked up under another heading.
SPECIAL_CONDITIONS = {
    "HIV-1 Infection": "HIV Infections",
    "HIV": "HIV Infections",
    "ADHD": "Attention Deficit Disorder with Hyperactivity",
    "HIV-1": "HIV Infections",
    "Diabetes": "Diabetes Mellitus",
    "HIV/AIDS": "HIV Infections",
    "HIV I Infection": "HIV Infections",
    "HIV-2 Infection": "HIV Infections",
    "HIV-1 Infections": "HIV Infections",
    "HIV-1-infection": "HIV Infections",
    "Type Two Diabetes Mellitus": "Diabetes Mellitus, Type 2",
    "Learning Disorders": "Learning Disabilities",
    "Unspecified Adult Solid Tumor, Protocol Specific": "Neoplasms",
    "Solid Neoplasm": "Neoplasms",
    "Solid Neoplasms": "Neoplasms",
    "Various Neoplasm": "Neoplasms",
}
# What makes a condition a healthy one, in the lower-cased text.
HEALTHY = r"healthy\s*(human)?\s*(volunteer(s)?|subject(s)?)?|health|human volunteer"
# Patterns removed from a drug name, in this order.
DRUG_NOISE = [
    r"[>≥]?\s*\d+\.?\d*\s*(mg|%|micrograms)",
    r"\s+[btq]\.?i\.?d\.?",
    r"[^\x00-\x7F]",
]
# Fixed value: the dose pattern of trials' drug names; without a unit it takes the number alone.
TRIAL_DOSE = r"[>≥]?\s*\d+\.?\d*\s*(mg|mcg||%|micrograms)"
DRUG_CUTS = ["(", "[", "/", ";", ","]
DRUG_FORMS = [
    r"capsule(s)?",
    r"pill(s)?",
    r"tablet[s]?",
    r"cream|antibiotic|gel|spray|drink|ampoule|syrup",
    r"injection(s)?",
    r" [a-z]*[ai]te",
    r" [a-z]*ide",
    r"calcium|hcl",
    r"implant|extended release|concentrate",
    r"(in)?(\s+|^)(low(er)?|high(er)?|mid)(\s+|$)(dose(s)?)?",
    r"intravenous|oral|intranasal|intravitreal",
    r"experimental:?|given|inhibitor|double",
    r"(\s+|^)i{1,3}v?(\s+|$)",
]
# What the heavier normaliser of drug names replaces, in this order, each with its replacement.
DRUG_STEPS = [
    ('"', " "),
    (":", " "),
    (";.*", " "),
    (r"\((.*)\)", "( $1 )"),
    ("®|™", " "),
    (r"([0-9]+[ ]?x[ ]?)?[0-9\.]+[ ]?(mcg|l|mg|milligram|µg|ug|ml|microgram(s)?|%|g|kg|tab.?|t)(/(mcg|mg|ml|l|µg|day|week|month|year|hour|min|sec|micrograms|milliliter|%|g|kg|tab.?|t))?(\s+|$|-|,|\)|\()", " $6 "),
    (r"[0-9]+[ ]?(day|week|month|year|hour|min|sec)s?", " "),
    (r"\s+[btq]\.?i\.?d\.?", " "),
    ("(capsule|pill|tablet|injection)s?", " "),
    ("intravenous|subcutaneous|oral|inhaled|intramuscular|intranasal|ophthalmic|liposomal|suspension|intravitreal|drug|dosage|administration|solution|ointment|nasal|injectable|inhalation", " "),
    (r"[ ](cream|antibiotic|gel|spray|product|troche|oros|drink|dentifrice|lotion|ampoule|tab\.?|syrup|(immediate|slow|controlled|delayed|intermediate|sustained|extended)[ -]release|(dr|cr|sr|xr|er)(\s+tab\.?)?|block?)[ |$},]", " "),
    (" [a-z]*[ai]te ", " "),
    ("calcium|hcl", " "),
    ("implant|extended release|concentrate", " "),
    (r"(in)?(\s+|^)(low(er)?|high(er)?|mid|standard)(\s+|$|-)(dose(s)?)?", " "),
    ("experimental( arm)?|given|double", " "),
    ("[ ](following|prior) (.*)", " "),
    (r"(\s+|^|,)i{1,3}\.?v\.?(\s+|,|$)", " "),
]
# Words dropped from a drug name by the heavier normaliser.
DRUG_STOPWORDS = [
    "bulk", "dose", "formulation", "water", "saline", "weekly", "daily", "monthly", "medicated", "non-medicated", "weight", "a", "an", "the", "of",
    "normal", "sugar", "traditional", "all", "subject", "subjects", "treatment", "arm", "up", "to", "group$", "initial", "for", "qd", "combination",
    "fixed", "once",
]
# English stop words of the outcome tokenizer, without apostrophes (off, who and t are kept as words).
STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a",
    "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "over", "under", "again", "further",
    "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "can", "will", "just", "don", "should", "now", "d", "ll", "m", "o",
    "re", "ve", "y", "ain", "aren", "couldn", "didn", "doesn", "hadn", "hasn", "haven", "isn", "ma", "mightn", "mustn", "needn", "shan", "shouldn",
    "wasn", "weren", "won", "wouldn",
]


def trimmed(c: Column) -> Column:
    """F.trim with one parameter: higher-order functions hand a function of two the index as well."""
    return F.trim(c)


def ascii_only(c: Column, by: str = " ") -> Column:
    """Non-ASCII characters replaced."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", by)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def one_line(c: Column) -> Column:
    """Line breaks, with the white space behind them, as one space."""
    return F.regexp_replace(c, r"\n\s*", " ")


def to_fixpoint(c: Column, step) -> Column:
    """step applied as often as c has words: for a step that drops a word or changes nothing, its fixpoint."""
    return F.aggregate(F.split(c, " "), c, lambda x, _: step(x))


def criterion_term(c: Column) -> Column:
    """A criterion's term: possessives joined, dangling brackets cut, adjectives dropped until none is left."""
    words = "|".join(ADJECTIVES + [w.capitalize() for w in ADJECTIVES])
    c = F.regexp_replace(c, " 's", "'s")
    c = F.regexp_replace(c, r"\([^)]*$", "")
    c = F.regexp_replace(c, r"^[^(]*\)", "")
    return to_fixpoint(c, lambda x: F.regexp_replace(x, f"( |^|$)({words})( |^|$)", ""))


#: Our own rule for a first word that only qualifies: determiners, and words that end as adjectives and adverbs do.
QUALIFIER = r"(?i)^(a|an|the|any|all|some|no|this|that|these|those|each|every|either|neither|another|both|very|not|\w+(ly|ous|ive|al|ic|ful|less|able|ible|ary|ory|ish|ent|ant))$"


def term_relaxations(c: Column, rest: Column | None = None) -> Column:
    """array of candidate terms in order of trial: as it is, without grades and numbers, without non-, without a qualifying first word.

    rest is the last of these as operators.tagging finds it; without it the rule of QUALIFIER stands in.

    A term found without its non- is a negated one: that of place 2.
    """
    bare = F.regexp_replace(c, r"(grade)?\s?\d+", "")
    positive = F.regexp_replace(bare, "non-?", "")
    by_rule = F.when((F.instr(c, " ") > 0) & F.substring_index(c, " ", 1).rlike(QUALIFIER), F.regexp_replace(c, r"^\S+\s+", ""))
    return F.array(c, bare, positive, by_rule if rest is None else rest)


def split_alternatives(c: Column) -> Column:
    """Terms joined by or, and, or a comma."""
    return F.filter(F.transform(F.split(c, " or | and |,"), trimmed), lambda x: x != "")


def clean_drug_name(c: Column) -> Column:
    """A drug name without doses, brackets, forms, salts and routes."""
    for pattern in DRUG_NOISE:
        c = F.regexp_replace(c, pattern, " ")
    for mark in DRUG_CUTS:
        c = F.substring_index(c, mark, 1)
    for pattern in DRUG_FORMS:
        c = F.regexp_replace(c, pattern, " ")
    return squeeze(c)


def clean_trial_drug_name(c: Column) -> Column:
    """A trial's drug name likewise: placebo for placebos, any number gone, and the first alone of several joined by +, or, and."""
    first = c
    for pattern in ['"', TRIAL_DOSE, *DRUG_NOISE[1:]]:
        first = F.regexp_replace(first, pattern, " ")
    for mark in [*DRUG_CUTS, "+", " or ", " and "]:
        first = F.substring_index(first, mark, 1)
    for pattern in [*DRUG_FORMS[:3], "administration of ", *DRUG_FORMS[3:8], "administration of", *DRUG_FORMS[8:]]:
        first = F.regexp_replace(first, pattern, " ")
    return F.when(c.contains("placebo"), "placebo").otherwise(squeeze(first))


def normalise_drug_name(c: Column) -> Column:
    """array of component names: placebo for placebos and for what nothing is left of."""
    low = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, by in DRUG_STEPS:
        low = F.regexp_replace(low, pattern, by)
    low = to_fixpoint(low, lambda x: F.regexp_replace(x, r"(\s+|^|,|\()(" + "|".join(DRUG_STOPWORDS) + r")(\s+|$|\)|,)", " "))
    parts = F.split(squeeze(low), r" (?:and|\+|plus|with|or)|&|,|/[^0-9]|[()\[\]]")
    parts = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[ ()-]+|[ ()-]+$", "")), lambda x: x != "")
    return F.when(c.contains("placebo") | c.contains("mimic") | (F.size(parts) == 0), F.array(F.lit("placebo"))).otherwise(parts)


def alias_parts(c: Column) -> Column:
    """array of names: A and B of "A (B)", else the parts around " + " and " /"."""
    c = ascii_only(c, "")
    c = F.regexp_replace(F.regexp_replace(c, " - ", "-"), " , ", ",")
    c = F.regexp_replace(F.trim(c), r"\.$", "")
    c = F.regexp_replace(c, r"^\(([^()]{2,})\)$", "$1")
    pattern = r"^([^()]{2,}?)[ ]?\(([^()]{2,})\)"
    both = F.array(F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2))
    parts = F.filter(F.transform(F.split(c, r" \+(?: |$)| /(?: |$)"), trimmed), lambda x: F.length(x) > 1)
    return F.when(c.rlike(pattern), F.transform(both, trimmed)).otherwise(parts)


def strip_code(c: Column) -> Column:
    """A drug code without trailing dosage marks (each suffix once, in order) and without a leading colon."""
    cut = lambda x, s: F.when(F.endswith(x, s), F.trim(F.substring(x, F.lit(1), F.length(x) - F.length(s)))).otherwise(x)
    return F.regexp_replace(F.aggregate(F.array(*map(F.lit, CODE_SUFFIXES)), c, cut), "^:\\s*", "")


def complete_code(code: Column, full_name: Column) -> Column:
    """A code that the full name holds only in a longer, hyphenated form, in that form."""
    quoted = F.concat(F.lit(r"\Q"), code, F.lit(r"\E"))
    whole = F.regexp_like(F.lower(full_name), F.concat(F.lit(r"( |\(|^)"), quoted, F.lit(r"( |\)|$|;|,)")))
    longer = F.regexp_substr(F.lower(full_name), F.concat(F.lit(r"\S*"), quoted, F.lit(r"-[^\s;]*")))
    return strip_code(F.when(whole, code).otherwise(F.coalesce(longer, code)))


def interferon(name: Column, full_name: Column) -> Column:
    """Interferons under their registered name, by what the full name says."""
    kind = r"(alpha|alfa|α|a)"
    gamma = (name.contains("interferon") | name.contains("ifn")) & name.contains("gamma")
    is_one = name.contains("interferon") | gamma
    return (
        F.when(is_one & full_name.rlike(rf"(pegylated|peg)([ \-])?interferon([ \-]) ?(\(pegifn\)|\(peg-ifn\)|\(peg ifn\))? ?{kind}([ \-])?(2a|2-a)"), F.lit("peginterferon alfa-2a"))
        .when(is_one & full_name.rlike(rf"interferon([ \-]){kind}([ \-])?(2b|2-b)"), F.lit("interferon alfa-2b"))
        .when(gamma | (is_one & full_name.rlike(r"interferon([- ])?(γ|gamma)")), F.lit("interferon gamma-1b"))
        .otherwise(name)
    )


def rewritten(c: Column, table: dict[str, str]) -> Column:
    """c, or what the table names for it."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, c), c)


def is_placebo(c: Column) -> Column:
    said = c.contains("placebo") | c.contains("saline") | c.contains("vehicle")
    return said & ~c.contains("followed by") & ~c.contains("then")


def is_healthy(c: Column) -> Column:
    return F.lower(c).rlike(HEALTHY)


def _folds() -> tuple[str, str]:
    """Latin letters with marks, and the letters that are left without them, by Unicode decomposition."""
    import unicodedata

    pairs = [(chr(k), "".join(x for x in unicodedata.normalize("NFD", chr(k)) if not unicodedata.combining(x))) for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(c: Column) -> Column:
    return F.translate(c, *_folds())


def tokens(c: Column) -> Column:
    """Lower-case letter tokens of 1 to 25 characters, quotes dropped and accents folded, without stop words."""
    folded = without_accents(F.lower(F.replace(c, F.lit("'"), F.lit(""))))
    words = F.filter(F.regexp_extract_all(folded, F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w) <= 25)
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def list_literal(c: Column) -> Column:
    """array of strings from "('a', 'b')"."""
    inner = F.regexp_replace(c, r"^\s*[\(\[]\s*'?|'?\s*,?\s*[\)\]]\s*$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"'\s*,\s*'"))


def mention_fields(line: Column) -> Column:
    """struct of a mention line's fields: id<TAB>text|drug[..]|brand|form|strength|dose|route|freq|duration|necessity|cui|rx|rx_generic|generic."""
    names = ["drug", "brand", "form", "strength", "dose", "route", "frequency", "duration", "necessity", "cui", "rxnorm", "rxnorm_generic", "generic"]
    body = F.split(F.substring_index(line, "\t", -1), r"\|")
    at = lambda k: F.coalesce(F.get(body, F.lit(k)), F.lit(""))
    fields = [F.regexp_replace(at(k + 1), r"\[.*\]", "").alias(n) for k, n in enumerate(names)]
    return F.struct(F.substring_index(line, "\t", 1).alias("id"), at(0).alias("text"), *fields)


def medication_text(label: Column, description: Column) -> Column:
    """A mention extractor's input: the description, led by the label where it lacks it."""
    described = F.coalesce(description, F.lit(""))
    whole = F.when(F.lower(described).contains(F.lower(label)), described).otherwise(F.concat_ws(" ", label, described))
    return F.concat(F.lit("medication: "), squeeze(ascii_only(whole)))


def year_of(c: Column) -> Column:
    """The year of a date such as "March 2015"."""
    return F.right(F.trim(c), F.lit(4)).try_cast("int")


def preferred_hit(hits: Column, vocabularies: list[str], most: int = 10) -> Column:
    """Of search hits in order: the first of the first `most` from an approved vocabulary (field source), else the first."""
    good = F.filter(F.slice(hits, 1, most), lambda h: h["source"].isin(vocabularies))
    return F.coalesce(F.get(good, F.lit(0)), F.get(hits, F.lit(0)))


def property_value(properties: Column, kind: str) -> Column:
    """The value of the first property of a kind; empty if there is none."""
    return F.coalesce(F.get(F.filter(properties, lambda p: p["kind"] == kind), F.lit(0))["value"], F.lit(""))


def json_field(c: Column, path: str) -> Column:
    """A JSON text's field by its dotted path; null where it is missing."""
    return F.get_json_object(c, f"$.{path}")


def html_text(page: Column, tag: str) -> Column:
    """The text of the first element of a tag that holds no other element."""
    return F.regexp_extract(page, f"<{tag}>([^<]*)</{tag}>", 1)


def html_attribute(page: Column, tag: str, attribute: str) -> Column:
    return F.regexp_extract(page, f'<{tag} {attribute}="([a-z]*)"', 1)


def occurrences(c: Column, part: str) -> Column:
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def canonical_tokens(c: Column, by: str = " ") -> Column:
    """The tokens, sorted and joined: equal for any order of words."""
    return F.array_join(F.array_sort(F.split(c, by)), "")
