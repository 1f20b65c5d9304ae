"""Readers of the flat-file vocabularies and of trial records: a path in, a DataFrame with a declared schema out.

Only Spark's own readers touch a path, so any store that Spark reads will do.
Text files that are cut at a record mark (lineSep) are read in parallel; gzip
files are one task each. Pickles are refused: table() reads Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import trimmed
from kgspark.operators.graph import last_writer
from kgspark.operators.ordered import running_sums

# The columns of the concept names file and of the relations file, in their order.
CONCEPT_COLUMNS = ["CUI", "LAT", "TS", "LUI", "STT", "SUI", "ISPREF", "AUI", "SAUI", "SCUI", "SDUI", "SAB", "TTY", "CODE", "STR", "SRL", "SUPPRESS", "CVF"]
RELATION_COLUMNS = ["CUI1", "AUI1", "STYPE1", "REL", "CUI2", "AUI2", "STYPE2", "RELA", "RUI", "SRUI", "SAB", "SL", "RG", "DIR", "SUPPRESS", "CVF"]
# The columns of a gene association file.
GAF_COLUMNS = ["db", "db_id", "symbol", "qualifier", "go_id", "reference", "evidence_code", "with_from", "aspect", "name", "synonym", "type", "taxon", "date", "assigned_by"]
# Evidence codes of associations from experiments.
EXPERIMENTAL = ["EXP", "IDA", "IMP", "IGI", "HTP", "HDA", "HMP", "HGI"]
# Where the relation, head and tail stand in a triple file, by format.
TRIPLE_ORDERS = {"hrt": (0, 1, 2), "htr": (0, 2, 1), "rht": (1, 0, 2), "rth": (2, 0, 1), "thr": (1, 2, 0), "trh": (2, 1, 0)}
#: Categories of headings that are diseases.
DISEASE_CATEGORIES = ("C", "F01", "F02", "F03")

COUNT = "STRUCT<groupId: STRING, numEvents: INT, numAffected: INT, numAtRisk: INT>"
EVENT = f"STRUCT<term: STRING, organSystem: STRING, sourceVocabulary: STRING, stats: ARRAY<{COUNT}>>"
#: A trial record as its registry serves it, with the parts that are used.
RECORD_SCHEMA = f"""
    protocolSection STRUCT<
        identificationModule: STRUCT<nctId: STRING>,
        armsInterventionsModule: STRUCT<
            armGroups: ARRAY<STRUCT<label: STRING, type: STRING, description: STRING>>,
            interventions: ARRAY<STRUCT<type: STRING, name: STRING, description: STRING, otherNames: ARRAY<STRING>, armGroupLabels: ARRAY<STRING>>>>,
        conditionsModule: STRUCT<conditions: ARRAY<STRING>>,
        outcomesModule: STRUCT<primaryOutcomes: ARRAY<STRUCT<measure: STRING, description: STRING>>, secondaryOutcomes: ARRAY<STRUCT<measure: STRING, description: STRING>>>,
        eligibilityModule: STRUCT<eligibilityCriteria: STRING, sex: STRING, minimumAge: STRING, maximumAge: STRING>,
        descriptionModule: STRUCT<briefSummary: STRING>,
        designModule: STRUCT<studyType: STRING, phases: ARRAY<STRING>, enrollmentInfo: STRUCT<count: BIGINT, type: STRING>>>,
    derivedSection STRUCT<conditionBrowseModule: STRUCT<meshes: ARRAY<STRUCT<id: STRING, term: STRING>>>>,
    resultsSection STRUCT<adverseEventsModule: STRUCT<eventGroups: ARRAY<STRUCT<id: STRING, title: STRING, description: STRING>>, seriousEvents: ARRAY<{EVENT}>, otherEvents: ARRAY<{EVENT}>>>
"""


def _strings(names: list[str]) -> str:
    return ", ".join(f"`{n}` STRING" for n in names)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, at): lines with their order: files by path, the blocks of a file by their start, lines as they stand."""
    meta = F.col("_metadata")
    return spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))


ORDER = ["file", "block", "at"]


def records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Trial records, one JSON document a file (or a folder of landed responses of the registry); a missing part is null."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def tsv(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """A tab-separated table of strings with a header line; columns by their names in the file."""
    return spark.read.schema(_strings(columns)).option("sep", "\t").option("header", str(header).lower()).option("enforceSchema", "false" if header else "true").option("quote", "").csv(path)


def csv_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A comma-separated table with a header and quoted fields that may span lines."""
    return spark.read.schema(_strings(columns)).options(header="true", multiLine="true", escape='"').csv(path)


def id_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(accession, gene) of a selected id mapping, plain or gzipped: the first and third of its columns; of an accession's lines the last counts."""
    lines = _lines(spark, path).select(F.split("value", "\t").alias("f"), F.struct(*ORDER).alias("seq"))
    rows = lines.where(F.size("f") >= 3).select(F.col("f")[0].alias("accession"), F.col("f")[2].alias("gene"), "seq")
    return last_writer(rows, ["accession"], "seq").drop("seq")


def commented_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated table whose header, and all remarks, are lines that start with #; columns by position, missing ones null."""
    cells = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    return lines.select(*[F.get(cells, F.lit(k)).alias(c) for k, c in enumerate(columns)])


def rrf(spark: SparkSession, path: str, columns: list[str], ordered: bool = False) -> DataFrame:
    """A pipe-delimited file in which each field ends with its pipe; empty fields are empty strings. Lines of another arity raise when they are read.

    With `ordered`, a column _seq tells the lines' order.
    """
    cells = F.split("value", r"\|", -1)
    arity = F.raise_error(F.concat(F.lit("a line of another arity: "), F.substring("value", 1, 80)))
    lines = _lines(spark, path) if ordered else spark.read.text(path)
    seq = [F.struct(*ORDER).alias("_seq")] if ordered else []
    checked = lines.where("value <> ''").select(F.when(F.size(cells) == len(columns) + 1, cells).otherwise(arity).alias("f"), *seq)
    return checked.select(*[F.col("f")[k].alias(c) for k, c in enumerate(columns)], *(["_seq"] if ordered else []))


def concept_names(spark: SparkSession, path: str) -> DataFrame:
    """(cui, name) of English preferred names; of several the last line counts."""
    rows = rrf(spark, path, CONCEPT_COLUMNS, ordered=True).where("LAT = 'ENG' and TS = 'P'")
    return last_writer(rows.select(F.col("CUI").alias("cui"), F.col("STR").alias("name"), "_seq"), ["cui"], "_seq").drop("_seq")


def concept_codes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (cui, vocabulary, code) of unsuppressed names."""
    rows = rrf(spark, path, CONCEPT_COLUMNS).where(unsuppressed(F.col("SUPPRESS")))
    return rows.select(F.col("CUI").alias("cui"), F.col("SAB").alias("vocabulary"), F.col("CODE").alias("code")).distinct()


def unsuppressed(suppress: Column) -> Column:
    return suppress.isin("", "N")


def relations(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (rel, parent, child, rela, source, label_source, suppress): the second concept has the relation to the first."""
    names = {"REL": "rel", "CUI1": "parent", "CUI2": "child", "RELA": "rela", "SAB": "source", "SL": "label_source", "SUPPRESS": "suppress"}
    return rrf(spark, path, RELATION_COLUMNS).select(*[F.col(a).alias(b) for a, b in names.items()]).distinct()


def _first(record: Column, field: str) -> Column:
    return F.regexp_extract(record, rf"(?m)^{field}(.*)$", 1)


def _all(record: Column, pattern: str) -> Column:
    return F.regexp_extract_all(record, F.lit(rf"(?m)^{pattern}"), F.lit(1))


def headings(spark: SparkSession, path: str, categories: tuple = DISEASE_CATEGORIES) -> DataFrame:
    """(id, name, entries, tree_numbers, note) of the headings with a tree number in one of the categories.

    Records start at *NEWREC. Unlike a reader that emits a record only when the
    next one starts, this one has the last record too.
    """
    r = F.col("value")
    found = spark.read.option("lineSep", "*NEWREC").text(path).where(F.trim("value") != "")
    entries = F.transform(_all(r, r"(?:PRINT )?(?:ENTRY|PRINT ENTRY)[^=\n]*=(.*)$"), lambda e: F.trim(F.substring_index(F.trim(e), "|", 1)))
    inside = lambda t: F.exists(F.array(*map(F.lit, categories)), lambda c: F.startswith(t, c))
    trees = F.array_sort(F.array_distinct(F.filter(F.transform(_all(r, r"MN =(.*)$"), trimmed), inside)))
    rows = found.select(F.trim(_first(r, "UI =")).alias("id"), F.trim(_first(r, "MH =")).alias("name"), F.array_sort(F.array_distinct(entries)).alias("entries"), trees.alias("tree_numbers"), F.trim(_first(r, "MS =")).alias("note"))
    return rows.where(F.size("tree_numbers") > 0)


def supplementary_headings(spark: SparkSession, path: str) -> DataFrame:
    """(id, headings): of each supplementary record the headings that it is mapped to, lower-cased and without asterisks."""
    r = F.col("value")
    found = spark.read.option("lineSep", "*NEWREC").text(path).where(F.trim("value") != "")
    mapped = F.transform(_all(r, r"HM =(.*)$"), lambda h: F.lower(F.trim(F.replace(h, F.lit("*"), F.lit("")))))
    return found.select(F.trim(_first(r, "UI =")).alias("id"), mapped.alias("headings")).where("id <> ''")


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, namespace, obsolete, parents, relations, alt_ids) of an OBO file's terms; relations: array<struct<relation, target>>."""
    r = F.col("value")
    found = spark.read.option("lineSep", "[Term]").text(path).select(F.split("value", r"\n\[Typedef\]", 2)[0].alias("value"))
    plain = lambda tag: F.trim(_first(r, f"{tag}:"))
    target = lambda e: F.regexp_extract(e, r"^\s*(\S+)", 1)
    linked = F.transform(_all(r, r"relationship:(.*)$"), lambda e: F.struct(F.regexp_extract(e, r"^\s*(\S+)\s+(\S+)", 1).alias("relation"), F.regexp_extract(e, r"^\s*(\S+)\s+(\S+)", 2).alias("target")))
    columns = {
        "id": plain("id"),
        "name": plain("name"),
        "namespace": plain("namespace"),
        "obsolete": plain("is_obsolete") == "true",
        "parents": F.transform(_all(r, r"is_a:(.*)$"), target),
        "relations": linked,
        "alt_ids": F.transform(_all(r, r"alt_id:(.*)$"), trimmed),
    }
    return found.select(*[c.alias(k) for k, c in columns.items()]).where("id <> ''")


def associations(spark: SparkSession, path: str, evidence: list[str] = EXPERIMENTAL) -> DataFrame:
    """Gene associations of the given evidence codes; remarks start with !."""
    rows = spark.read.schema(_strings(GAF_COLUMNS)).options(sep="\t", comment="!", quote="").csv(path)
    names = {"P": "BP", "F": "MF", "C": "CC"}
    namespace = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("aspect"))
    return rows.where(F.col("evidence_code").isin(evidence)).withColumn("namespace", namespace)


DRUG_SCHEMA = """
    `drugbank-id` ARRAY<STRUCT<_VALUE: STRING, _primary: BOOLEAN>>, name STRING,
    synonyms STRUCT<synonym: ARRAY<STRING>>,
    `international-brands` STRUCT<`international-brand`: ARRAY<STRUCT<name: STRING>>>
"""


def drug_names(spark: SparkSession, path: str, row_tag: str = "drug") -> DataFrame:
    """(id, names) of an XML dump of drugs: the id with an attribute, then the name, its synonyms and brands, in order; empty names go."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(DRUG_SCHEMA).load(path)
    none = F.array().cast("array<string>")
    brands = F.transform(F.col("`international-brands`.`international-brand`"), lambda b: b["name"])
    names = F.concat(F.array("name"), F.coalesce("synonyms.synonym", none), F.coalesce(brands, none))
    names = F.filter(F.transform(names, trimmed), lambda n: n.isNotNull() & (n != ""))
    main = F.filter("`drugbank-id`", lambda i: i["_primary"].isNotNull())
    return rows.select(F.get(main, F.lit(0))["_VALUE"].alias("id"), names.alias("names")).where("id is not null")


def synonyms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(names(name, id), drugs(id, name)) of lines `id<TAB>name|name|..`: every name, lower-cased; a drug's first name.

    Of a name on several lines the last line counts.
    """
    cells = F.split("value", "\t")
    lines = _lines(spark, path).where(F.size(cells) >= 2).select(cells[0].alias("id"), F.split(cells[1], r"\|").alias("names"), F.struct(*ORDER).alias("line"))
    clean = lambda c: F.lower(F.trim(c))
    each = lines.select("id", "line", F.posexplode("names").alias("pos", "name")).select("id", clean(F.col("name")).alias("name"), F.struct("line", "pos").alias("seq"))
    drugs = last_writer(lines.select("id", clean(F.col("names")[0]).alias("name"), "line"), ["id"], "line").drop("line")
    return last_writer(each, ["name"], "seq").select("name", "id"), drugs


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; pickles are refused, for they run code when they are read."""
    if path.rstrip("/").endswith((".pkl", ".pickle")):
        raise ValueError("pickles are not read; convert them to Parquet")
    return spark.read.parquet(path)


def embedding_table(spark: SparkSession, path: str, width: int, key: str = "id") -> DataFrame:
    """(key, vector) of a CSV whose first column has no name and whose others are the vector's places."""
    columns = [key, *(f"v{k}" for k in range(width))]
    rows = spark.read.schema(f"`{key}` STRING, " + ", ".join(f"v{k} DOUBLE" for k in range(width))).option("header", "true").csv(path)
    return rows.select(key, F.array(*columns[1:]).alias("vector"))


def triples(spark: SparkSession, path: str, order: str = "hrt", sep: str = "\t", skip_first_line: bool = False) -> DataFrame:
    """(h, r, t) of a triple file, its columns in the given order."""
    rows = spark.read.schema("a STRING, b STRING, c STRING").options(sep=sep, quote="", header=str(skip_first_line).lower()).csv(path)
    return rows.select(*[F.trim(F.col("abc"[k])).alias(n) for n, k in zip("hrt", TRIPLE_ORDERS[order], strict=True)])


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, code) of `id<TAB>name` lines, with a third field where there is one."""
    rows = spark.read.schema("id BIGINT, name STRING, code STRING").options(sep="\t", quote="", mode="PERMISSIVE").csv(path)
    return rows.select("id", F.trim("name").alias("name"), F.trim("code").alias("code"))


def with_optional(rows: DataFrame, path: str | None, read, **how) -> DataFrame:
    """rows and those that `read` finds at the path, if one is given: an extra edge file, or entities of an inference run."""
    return rows if path is None else rows.unionByName(read(rows.sparkSession, path, **how))


def encoded(rows: DataFrame, entities: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples as ids, rows that name something unknown): the strict look-up, which leaves it to the caller to refuse the second."""
    of = lambda d, end: d.select(F.col("name").alias(f"_{end}"), F.col("id").alias(f"{end}_id"))
    joined = rows.join(of(entities, "h"), F.col("h") == F.col("_h"), "left").join(of(names, "r"), F.col("r") == F.col("_r"), "left").join(of(entities, "t"), F.col("t") == F.col("_t"), "left")
    known = F.col("h_id").isNotNull() & F.col("r_id").isNotNull() & F.col("t_id").isNotNull()
    return joined.where(known).select(F.col("h_id").alias("h"), F.col("r_id").alias("r"), F.col("t_id").alias("t")), joined.where(~known).select("h", "r", "t")


def relation_name(c: Column) -> Column:
    """X of "source-..:rel-name-X"."""
    return F.regexp_extract(c, r"rel-name-(.*)$", 1)


def numbered_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(id, cluster, count, tokens) of `tok, tok<TAB>count` lines; the id is the line's 0-based number."""
    rows = running_sums(_lines(spark, path), ORDER, {"id": F.lit(1)}, "clusters").where("value <> ''")
    cells = F.split(F.trim("value"), "\t")
    return rows.select(F.col("id").cast("long").alias("id"), cells[0].alias("cluster"), F.get(cells, F.lit(1)).try_cast("long").alias("count"), F.split(cells[0], ", ").alias("tokens"))


def cached_terms(spark: SparkSession, path: str, key: str, seq: str) -> DataFrame:
    """A folder of checkpoint tables as one cache: of a key's rows that of the largest seq."""
    return last_writer(spark.read.parquet(path), [key], seq)


def regrouped_chunks(spark: SparkSession, pattern: str, sep: str = "_") -> DataFrame:
    """(id, part, lines) of JSON chunks {"id_part": [lines]} matched by a glob, one object a line, the key cut at the last separator."""
    rows = spark.read.text(pattern).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("key", "lines"))
    return rows.select(F.regexp_extract("key", rf"^(.*){sep}[^{sep}]*$", 1).alias("id"), F.substring_index("key", sep, -1).alias("part"), "lines")
