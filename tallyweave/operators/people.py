"""The pool of respondents, their descriptions, and the dictionary of what a request returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.sampling import complete_cases
from tallyweave.sources import files

#: The published code labels of the demographic variables.
CODEBOOK = {
    "sex": {1: "Male", 2: "Female"},
    "race": {1: "White", 2: "Black", 3: "Other"},
    "marital": {1: "Married", 2: "Widowed", 3: "Divorced", 4: "Separated", 5: "Never married"},
    "wrkstat": {
        1: "Working full time", 2: "Working part time", 3: "With a job, but not at work (temporary illness/vacation/strike)",
        4: "Unemployed, laid off, looking for work", 5: "Retired", 6: "In school", 7: "Keeping house", 8: "Other",
    },
    "relig": {
        1: "Protestant", 2: "Catholic", 3: "Jewish", 4: "None", 5: "Other", 6: "Buddhism", 7: "Hinduism", 8: "Other Eastern religions",
        9: "Muslim/Islam", 10: "Orthodox-Christian", 11: "Christian", 12: "Native American", 13: "Inter-nondenominational",
    },
    "region": {1: "Northeast", 2: "Midwest", 3: "South", 4: "West"},
}
#: Fields that a description needs.
CORE_FIELDS = ["age", "sex", "race", "marital", "wrkstat", "relig"]


def people_pool(spark: SparkSession, path: str, fields: list[str], needed: list[str] | None = None) -> DataFrame:
    """Respondents of a CSV file with a header, all fields doubles; those without one of the ``needed`` fields are left out."""
    pool = files.read_csv(spark, path, ", ".join(f"`{f}` double" for f in fields))
    return complete_cases(pool, needed or CORE_FIELDS)


def between(df: DataFrame, column: str, least=None, most=None) -> DataFrame:
    """Rows from ``least`` to ``most``, both included; None is no limit.  Nulls go as soon as there is a limit."""
    for value, test in ((least, F.col(column) >= F.lit(least)), (most, F.col(column) <= F.lit(most))):
        df = df if value is None else df.where(test)
    return df


def label_of(code: Column, labels: dict[int, str]) -> Column:
    """The code's label, the code as text if it has none, ``unknown`` if it is null."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), code.cast("int"))
    return F.coalesce(found, code.cast("string"), F.lit("unknown"))


def described(fields: dict[str, str] | None = None) -> Column:
    """A line on a respondent, from age and coded fields: the age, then each label, as ``name label``.

    ``fields`` maps a coded field to its name in the line.
    """
    fields = fields or {"sex": "", "race": "", "marital": "", "wrkstat": "work", "relig": "religion"}
    age = F.concat(F.lit("age "), F.coalesce(F.floor("age").cast("string"), F.lit("unknown")))
    return F.concat_ws(", ", age, *[F.concat(F.lit(f"{name}: " if name else ""), label_of(F.col(f), CODEBOOK[f])) for f, name in fields.items()])


#: What the columns of a dataset and of its coverage report hold: column, description, values.
COLUMNS = [
    ("educ", "Years of education of the respondent.", ""),
    ("raw", "The provider's score of the item for the respondent, from 0 to 1, before calibration.", ""),
    ("response", "The calibrated answer on the requested scale; 0 or 1 for binary items.", ""),
    ("source", "What the answer was calibrated to.", "calibrated = a known variable or a blend of some; population = the general shape of answers"),
    ("item", "The item's number in the request.", ""),
    ("method", "How known variables were found for the item.", "single_best = one close variable; ensemble = a blend of variables of quality; none = no variable"),
    ("matched", "The known variables that the item was calibrated to.", ""),
    ("similarity_top1", "Similarity of the item and the closest known variable.", ""),
    ("tier", "How far the answers rest on known variables.", "high = one close variable of quality; moderate = a blend; low = the general shape only"),
    ("expected_error", "Mean error of past cases of such a similarity.", ""),
    ("expected_error_n", "Number of those cases.", ""),
    ("n_min", "Fewest respondents of a variable used.", ""),
    ("years_min", "Fewest years in which a variable used was asked.", ""),
]


def data_dictionary(spark: SparkSession) -> DataFrame:
    """(no, column, description, possible_values): the coded fields, then the columns of a dataset and its report."""
    coded = [("age", "Age of the respondent in years.", "")]
    coded += [(f, f"Code of the respondent's {f}.", "; ".join(f"{k} = {v}" for k, v in sorted(labels.items()))) for f, labels in CODEBOOK.items()]
    rows = [(i, *row) for i, row in enumerate(coded + COLUMNS)]
    return spark.createDataFrame(rows, "no int, column string, description string, possible_values string")


def codes_in_use(df: DataFrame, fields: list[str]) -> DataFrame:
    """(column, possible_values, n): the labelled codes that occur in the rows, as ``code = label`` in code order, and the rows that have one.

    One pass over the rows for all fields; a field without a labelled code has no row.
    """
    labels = df.sparkSession.createDataFrame([(f, c, v) for f in fields for c, v in CODEBOOK[f].items()], "column string, code int, label string")
    long = df.select(*[F.col(f).cast("int").alias(f) for f in fields]).unpivot([], fields, "column", "code").where("code IS NOT NULL")
    counts = long.groupBy("column", "code").agg(F.count("*").alias("n")).join(F.broadcast(labels), ["column", "code"])
    line = F.concat(F.col("code").cast("string"), F.lit(" = "), F.col("label"))
    listed = F.array_sort(F.collect_list(F.struct("code", line.alias("line"))))
    return counts.groupBy("column").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "; ").alias("possible_values"), F.sum("n").alias("n"))
