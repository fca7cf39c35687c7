"""Sources: tolerant JSON lines, shards, sequence dumps, tag files, source trees, prebuilt indexes and a seed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "doc_id string, slogan string, statement string, name string, source string, title string, label string, citations bigint, category string"
FINDING = "doc_id string, name string, slogan string, statement string, source string, provenance string, added_ts double, dense boolean, dense_vec array<double>"


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One record a line; blank and broken lines are skipped, or with strict raise."""
    r = spark.read.schema(schema + ("" if strict else ", _corrupt_record string"))
    if strict:
        return r.option("mode", "FAILFAST").json(path)
    return r.option("mode", "PERMISSIVE").json(path).filter("_corrupt_record IS NULL").drop("_corrupt_record")


def shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Shards in order of file name with a stored row number: file name and place, never the order of partitions."""
    t = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_block_start").alias("block"))
    return t.withColumn("row_in_task", F.monotonically_increasing_id())


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """(a_number, terms) of lines like ``A000045 ,0,1,1,2,``; terms stay decimal strings."""
    t = spark.read.text(path).select(F.regexp_extract("value", r"^(A[0-9]{6,})\s+,(.*)$", 1).alias("a_number"), F.regexp_extract("value", r"^(A[0-9]{6,})\s+,(.*)$", 2).alias("rest"))
    return t.filter("a_number <> ''").select("a_number", F.filter(F.split("rest", ","), lambda x: x.rlike("^-?[0-9]+$")).alias("terms"))


def sequence_names(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path)
    return t.select(F.regexp_extract("value", r"^(A[0-9]{6,}):\s*(.*)$", 1).alias("a_number"), F.regexp_extract("value", r"^(A[0-9]{6,}):\s*(.*)$", 2).alias("name")).filter("a_number <> ''")


def tags(spark: SparkSession, path: str) -> DataFrame:
    """(tag, label) of lines ``TAG,label``; comments are skipped."""
    p = F.split("value", ",", 2)
    return spark.read.text(path).filter("NOT startswith(trim(value), '#') AND contains(value, ',')").select(F.trim(p[0]).alias("tag"), F.trim(p[1]).alias("label"))


def source_tree(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, text) of whole files: LaTeX or formal sources."""
    t = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def harvest(xml: DataFrame, column: str) -> DataFrame:
    """(identifier, deleted, title) of harvested XML records, one document a row."""
    schema = "header struct<_status string, identifier string, datestamp string>, metadata struct<title string>"
    r = F.from_xml(F.col(column), schema)
    return xml.select(r.alias("r")).select("r.header.identifier", (F.coalesce("r.header._status", F.lit("")) == "deleted").alias("deleted"), "r.metadata.title")


def atom_entries(df: DataFrame, column: str) -> DataFrame:
    """(title, summary, category) of a feed entry by patterns."""
    tag = lambda n: F.trim(F.regexp_replace(F.regexp_extract(column, rf"(?s)<{n}>(.*?)</{n}>", 1), r"\s+", " "))
    return df.select(tag("title").alias("title"), tag("summary").alias("summary"), F.regexp_extract(column, r'primary_category[^>]*term="([^"]+)"', 1).alias("category"))


def unavailable(service: str) -> dict[str, str]:
    """What an interface to something that is not here answers: never an empty success."""
    return {"status": "unavailable", "service": service, "note": f"{service} cannot be reached from here; nothing was checked"}


#: A small corpus for first steps.
SEED = [
    ("seed::1", "A contraction of a complete metric space has exactly one fixed point", "Let $(X,d)$ be a complete metric space and $T$ a contraction. Then $T$ has a unique fixed point.", "Contraction principle"),
    ("seed::2", "Every bounded real sequence has a convergent subsequence", "If $(x_n)$ is bounded in $\\mathbb{R}$, then it has a convergent subsequence.", "Bolzano-Weierstrass"),
    ("seed::3", "Real symmetric matrices have an orthonormal basis of eigenvectors", "Let $A$ be real symmetric. Then $A = QDQ^T$ with $Q$ orthogonal.", "Spectral theorem"),
    ("seed::4", "The order of a subgroup divides the order of a finite group", "Let $H$ be a subgroup of a finite group $G$. Then $|H|$ divides $|G|$.", "Lagrange"),
    ("seed::5", "The arithmetic mean is at least the geometric mean", "For $a_i \\geq 0$ we have $\\frac1n\\sum a_i \\geq \\prod a_i^{1/n}$.", "AM-GM"),
    ("seed::6", "In every large enough party three people know or do not know each other", "$R(3,3) = 6$.", "Ramsey number"),
    ("seed::7", "Sums over divisors can be inverted", "If $g(n) = \\sum_{d|n} f(d)$ then $f(n) = \\sum_{d|n} \\mu(d) g(n/d)$.", "Möbius inversion"),
    ("seed::8", "Open covers of closed bounded sets have finite subcovers", "A subset of $\\mathbb{R}^n$ is compact if and only if it is closed and bounded.", "Heine-Borel"),
    ("seed::9", "The absolute inner product is at most the product of the norms", "$|\\langle x,y\\rangle| \\leq \\|x\\|\\,\\|y\\|$.", "Cauchy-Schwarz"),
    ("seed::10", "Averages of independent equal variables converge to the mean", "Let $X_i$ be i.i.d. with finite mean. Then $\\bar X_n \\to E X_1$ almost surely.", "Law of large numbers"),
    ("seed::11", "A positive matrix has a simple largest eigenvalue with a positive vector", "Let $A > 0$. Then $\\rho(A)$ is a simple eigenvalue.", "Perron-Frobenius"),
    ("seed::12", "Regular graphs with a large spectral gap mix edges evenly", "For a $d$-regular graph, $|e(S,T) - d|S||T|/n| \\leq \\lambda\\sqrt{|S||T|}$.", "Expander mixing"),
]


def seed_corpus(spark: SparkSession) -> DataFrame:
    rows = [(i, s, t, n, "built-in", None, None, None, None) for i, s, t, n in SEED]
    return spark.createDataFrame(rows, DOCUMENT)
