"""Rule tables from an XML corpus: boxes, rules, document variables, alias references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_TAG = "instructionsection"
#: Explicit, since inference turns arrays of one child into structs.
SCHEMA = """
_id STRING, _type STRING, commit_id STRING,
docvars STRUCT<docvar: ARRAY<STRUCT<_key: STRING, _value: STRING>>>,
alias_list STRUCT<_howmany: INT, aliasref: ARRAY<STRUCT<_aliaspageid: STRING, _aliasfile: STRING, text: STRING, aliaspref: STRING>>>,
classes STRUCT<iclass: ARRAY<STRUCT<_id: STRING, _name: STRING,
  arch_variants: STRUCT<arch_variant: ARRAY<STRUCT<_feature: STRING, _name: STRING>>>,
  regdiagram: STRUCT<_form: STRING, _psname: STRING, box: ARRAY<STRUCT<_hibit: INT, _width: INT, _name: STRING, c: ARRAY<STRING>>>>,
  encoding: ARRAY<STRUCT<_name: STRING>>>>>
"""
#: Words in decoding sections that mark a rule as not fully defined, and those sections.
KEYWORDS = ("UNDEFINED", "UNPREDICTABLE", "UnallocatedEncoding", "EndOfInstruction", "ReservedEncoding")
SECTIONS = ("Decode", "Postdecode")
#: Classes that are in scope.
IN_SCOPE = ("general", "advsimd", "float", "fpsimd", "system")

#: Stands in no XML document, nor can be written in one.
NO_CHARACTER = "\uffff"


def read_rule_xml(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """One row per document of the row tag, with its text as ``xml``; malformed documents and other root tags give none.

    A file is a document, or holds many between ``separator``. A document that can't be parsed costs no other one.
    """
    files = spark.read.text(path, wholetext=True) if separator is None else spark.read.text(path, lineSep=separator)
    return parse_rule_xml(files.select(F.col("value").alias("xml")))


def parse_rule_xml(docs: DataFrame, col: str = "xml") -> DataFrame:
    """The same from a column of whole documents; keeps the text, as ``xml``, for path expressions."""
    # from_xml takes any root for a row; the document must begin with the row tag, after a prolog or comments
    root = F.col(col).rlike(rf"^\s*(?:<\?(?s:.*?)\?>\s*|<!(?s:.*?)>\s*)*<{ROW_TAG}[\s>/]")
    parsed = once(docs.where(root), "_doc", F.from_xml(F.col(col), SCHEMA, {"rowTag": ROW_TAG}))
    return parsed.select("*", "_doc.*").drop("_doc").where("_id is not null")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row. It is exploded, as filters and projections on a plain column would
    be pushed below it and parse the document once more each."""
    return df.withColumn(name, F.explode(F.array(value)))


def extract_boxes(docs: DataFrame) -> DataFrame:
    """``_id, iclass, psname, boxes``: per class that has a diagram its boxes (hibit, width, name, fixed_bits).

    A missing width is 1, a missing hibit 0; any cell that isn't 0 or 1 makes the box variable.
    """

    def box(b: Column) -> Column:
        cells = F.transform(b["c"], lambda x: F.trim(F.coalesce(x, F.lit(""))))
        fixed = F.when(b["c"].isNotNull() & (F.size(cells) > 0) & ~F.exists(cells, lambda x: ~x.isin("0", "1")), F.array_join(cells, ""))
        return F.struct(F.coalesce(b["_hibit"], F.lit(0)).alias("hibit"), F.coalesce(b["_width"], F.lit(1)).alias("width"), b["_name"].alias("name"), fixed.alias("fixed_bits"))

    rows = docs.select("*", F.posexplode("classes.iclass").alias("iclass_seq", "ic"))
    return rows.where(F.col("ic.regdiagram._psname").isNotNull()).withColumn("psname", F.col("ic.regdiagram._psname")).withColumn("boxes", F.transform("ic.regdiagram.box", box))


def instructions(docs: DataFrame, allowed: tuple[str, ...] | None = IN_SCOPE) -> DataFrame:
    """Documents of type instruction whose class is in scope (``None``: of any class); needs ``docvars``."""
    found = docs.where("_type = 'instruction'")
    return found if allowed is None else found.where(in_scope(F.col("instr_class"), allowed))


def extract_rules(docs: DataFrame, allowed: tuple[str, ...] | None = IN_SCOPE) -> DataFrame:
    """Rule rows of the instructions in scope: encodings' names joined by ``|``, gating features, boxes."""
    rows = extract_boxes(instructions(docs, allowed))
    names = F.filter(F.transform("ic.encoding", lambda e: e["_name"]), lambda x: x != "")
    gating = F.filter(F.transform("ic.arch_variants.arch_variant", lambda v: v["_feature"]), lambda x: x != "")
    return rows.select(F.col("_id").alias("file"), "iclass_seq", F.col("ic._id").alias("iclass"), "psname", F.array_join(names, "|").alias("encoding_name"), F.coalesce(gating, F.array().cast("array<string>")).alias("gating"), "boxes")


def docvars(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """``docs`` with ``mnemonic`` (first that isn't empty in the whole document, else the id) and ``instr_class`` (the
    first, even if empty). The document must have parsed: paths throw on malformed text."""
    mnemonic, cls = '(//docvar[@key="mnemonic" and @value!=""]/@value)[1]', '//docvar[@key="instr-class"]'
    # one path, as each parses the document anew
    found = F.xpath_string(F.col(f"`{xml}`"), F.lit(f'concat({mnemonic}, "{NO_CHARACTER}", boolean({cls}), "{NO_CHARACTER}", ({cls}/@value)[1])'))
    part = lambda i: F.get("_vars", F.lit(i))
    split = once(docs, "_vars", F.split(found, NO_CHARACTER))
    return split.withColumn("mnemonic", F.coalesce(F.nullif(part(0), F.lit("")), F.col("_id"))).withColumn("instr_class", F.when(part(1) == "true", part(2))).drop("_vars")


def in_scope(cls: Column, allowed: tuple[str, ...] = IN_SCOPE) -> Column:
    return F.coalesce(cls.isin(*allowed), F.lit(False))


def not_fully_defined(xml: Column | str) -> Column:
    """Whether the text of a decoding section, nested tags included, has one of the keywords."""
    name = xml if isinstance(xml, str) else "xml"
    where = " or ".join(f'@section="{s}"' for s in SECTIONS)
    words = " or ".join(f'contains(string(.),"{w}")' for w in KEYWORDS)
    return F.xpath_boolean(F.col(f"`{name}`"), F.lit(f"count(//pstext[({where}) and ({words})]) > 0"))  # one path, as each parses the document anew


def extract_aliases(docs: DataFrame, allowed: tuple[str, ...] | None = IN_SCOPE) -> DataFrame:
    """``file, ref_seq, base, alias, condition`` of the instructions in scope: alias is the first word of the text, else
    the page id up to ``_``."""
    rows = instructions(docs, allowed).select("*", F.posexplode("alias_list.aliasref").alias("ref_seq", "ref"))
    word = F.get(F.split(F.trim("ref.text"), r"\s+"), F.lit(0))
    alias = F.coalesce(F.nullif(word, F.lit("")), F.get(F.split("ref._aliaspageid", "_"), F.lit(0)))
    return rows.select(F.col("_id").alias("file"), "ref_seq", F.col("mnemonic").alias("base"), alias.alias("alias"), F.trim(F.coalesce("ref.aliaspref", F.lit(""))).alias("condition"))


def of_type(docs: DataFrame, types: tuple[str, ...] = ("instruction", "alias"), release: str | None = None) -> DataFrame:
    kept = docs.where(F.col("_type").isin(*types))
    return kept if release is None else kept.where(F.col("commit_id") == release)
