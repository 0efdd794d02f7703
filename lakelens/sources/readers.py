"""Readers of corpus files: tables, JSON lines, edges, text trees, vectors, manifests, rankings, session logs, golden sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.functions.scalars import collapse

CHUNKS = "chunk_id string, paper_id string, section string, page_start int, page_end int, text string, n_tokens int"
PAPER_TEXT = ["title", "authors", "abstract", "categories", "primary_category", "published"]
PAPER_OPTIONAL = ["version", "venue"]
SNAPSHOT = "id string, title string, abstract string, authors string, categories string, comments string, `journal-ref` string, doi string, license string, update_date string, versions array<struct<version:string,created:string>>, authors_parsed array<array<string>>"
GOLDEN = "id string, type string, question string, expected_chunk_ids array<string>, expected_paper_id string, checks map<string,boolean>"


def read_table(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """A table that has to be there; with a name, also as a view."""
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_papers(papers: DataFrame) -> DataFrame:
    """Collected papers: null texts are blank, blank versions and venues are null, LaTeX is plain text."""
    out = papers
    for c in PAPER_TEXT:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    for c in PAPER_OPTIONAL:
        out = out.withColumn(c, F.when(F.col(c) != "", F.col(c)))
    for c in ("title", "authors", "abstract"):
        out = out.withColumn(c, T.latex_to_text(F.col(c)))
    return out


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as JSON lines; a malformed line fails the read."""
    return spark.read.schema(CHUNKS).option("mode", "FAILFAST").json(path)


def read_records(snapshot: DataFrame, wanted: DataFrame) -> DataFrame:
    """One record of each wanted id (column id)."""
    return snapshot.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot records as JSON lines; blank and malformed lines are dropped."""
    return spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path).filter("id is not null")


def snapshot_papers(records: DataFrame, first: str | None = None, last: str | None = None, by: str = "submitted") -> DataFrame:
    """Records with their submission date, latest version and collapsed texts, within a range of dates; an unknown date always passes."""
    out = records.withColumn("published", T.submitted_date(F.coalesce(F.try_element_at("versions", F.lit(1))["created"], F.lit(""))))
    out = out.withColumn("version", F.try_element_at("versions", F.lit(-1))["version"])
    for c in ("title", "abstract"):
        out = out.withColumn(c, collapse(F.coalesce(F.col(c), F.lit(""))))
    key = F.col("published") if by == "submitted" else F.coalesce("update_date", F.lit(""))
    if first is not None:
        out = out.filter((key == "") | (key >= first))
    if last is not None:
        out = out.filter((key == "") | (key <= last))
    return out


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges as lines of two ids with a tab between; lines without a second id are dropped."""
    return spark.read.schema("citing_id string, cited_id string").csv(path, sep="\t").filter("cited_id <> ''")


def read_cited_works(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("work_id string, title string, authors string, primary_category string, year int, version string").json(path)
    return rows.withColumn("title", T.latex_to_text("title")).withColumn("authors", T.latex_to_text("authors"))


def text_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct stems of folder/*/*.txt; none if there is no such folder. File contents are not read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "pid string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("pid")).distinct()


def text_tree(spark: SparkSession, folder: str) -> DataFrame:
    """pid and text of folder/*/*.txt, a document a file; bytes that are no UTF-8 are replaced."""
    files = spark.read.text(f"{folder}/*/*.txt", wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_name", r"(.+)\.txt$", 1).alias("pid"), F.col("value").alias("text"))


def read_vectors(spark: SparkSession, path: str, slug: str) -> DataFrame:
    """Vectors of one embedding model; a file of another is refused."""
    rows = spark.read.parquet(path)
    other = rows.filter(~F.col("slug").eqNullSafe(F.lit(slug))).select("slug").limit(1).collect()
    if other:
        raise ValueError(f"vectors of {other[0]['slug']!r}, not of {slug!r}")
    return rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The ids of a manifest {"papers": [..]}."""
    return spark.read.schema("papers array<string>").json(path, multiLine=True).select(F.explode("papers").alias("pid")).distinct()


def core_tiers(rankings: DataFrame) -> DataFrame:
    """acronym and tier of venue rankings (columns acronym, rank): A* and A are 3, B and C are 2, the best of several counts."""
    key, rank = F.lower(F.trim("acronym")), F.upper(F.trim("rank"))
    tier = F.when(rank.isin("A*", "A"), 3).when(rank.isin("B", "C"), 2)
    return rankings.select(key.alias("acronym"), tier.alias("tier")).filter("acronym <> '' and tier is not null").groupBy("acronym").agg(F.max("tier").alias("tier"))


def read_core_rankings(spark: SparkSession, path: str) -> DataFrame:
    """Rankings as comma-separated lines: number, title, acronym, source, rank; shorter lines are skipped."""
    return core_tiers(spark.read.schema("number string, title string, acronym string, source string, rank string, rest string").csv(path, mode="PERMISSIVE"))


def indegrees(references: DataFrame) -> DataFrame:
    """pid and n: how often an id stands in the lists of JSON objects {"id": ["id", ..]} (column value)."""
    lists = references.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("k", "ids"))
    return lists.select(F.explode("ids").alias("pid")).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


def session_turns(spark: SparkSession, path: str) -> DataFrame:
    """session_id, turn_no, prompt and lines of session logs (JSON lines, a record each).

    Records without a session, of side chains, meta or summaries, and bad lines do not count. A session that goes on in
    another file keeps the order of files. Lines of a file are numbered where it is read, whole: a log is of one session or a few.
    """
    record = "struct<type:string,sessionId:string,isSidechain:boolean,isMeta:boolean,isCompactSummary:boolean,message:struct<content:string>>"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    lines = whole.select("file", "line", F.from_json("value", record).alias("r"))
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rows = lines.select("file", "line", "r.*").filter("sessionId is not null and type in ('user', 'assistant')").filter(off("isSidechain") & off("isMeta") & off("isCompactSummary"))
    content = F.col("message.content")
    blocks = F.from_json(content, "array<struct<type:string,text:string,name:string>>")
    is_list = F.coalesce(content, F.lit("")).startswith("[")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " ")
    is_result = is_list & F.exists(F.coalesce(blocks, F.array().cast("array<struct<type:string,text:string,name:string>>")), lambda b: b["type"] == "tool_result")
    prompt = F.when((F.col("type") == "user") & ~is_result, T.clean_prompt(F.when(is_list, joined).otherwise(content)))
    said = F.transform(F.filter(blocks, lambda b: ((b["type"] == "text") & (F.trim(b["text"]) != "")) | (b["type"] == "tool_use")), lambda b: F.when(b["type"] == "text", F.concat(F.lit("Reply: "), collapse(b["text"]))).otherwise(F.concat(F.lit("["), b["name"], F.lit("]"))))
    rows = rows.withColumn("prompt", F.when(prompt != "", prompt)).withColumn("said", F.when((F.col("type") == "assistant") & is_list, said))
    w = Window.partitionBy("sessionId").orderBy("file", "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("turn_no", F.count("prompt").over(w)).filter("turn_no > 0")
    parts = rows.groupBy(F.col("sessionId").alias("session_id"), "turn_no").agg(F.max("prompt").alias("prompt"), F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("file", "line", "said")))).alias("s"))
    return parts.select("session_id", F.col("turn_no").cast("int").alias("turn_no"), "prompt", F.flatten(F.transform("s", lambda x: x["said"])).alias("lines"))


CHECKS = ["span_verbatim", "lexical_rule", "question_length", "answerable", "self_contained", "natural", "unambiguous", "type_fits", "not_trivial"]


def counted(golden: DataFrame) -> DataFrame:
    """Records whose checks all hold and whose question was not answered with the book closed."""
    ok = F.lit(True)
    for c in CHECKS:
        ok = ok & F.coalesce(F.try_element_at("checks", F.lit(c)), F.lit(False))
    return golden.filter(ok & ~F.coalesce(F.try_element_at("checks", F.lit("closed_book_correct")), F.lit(False)))


def read_golden(spark: SparkSession, path: str, only_counted: bool = True) -> DataFrame:
    """Golden records as JSON lines; a malformed line fails the read."""
    rows = spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)
    return counted(rows) if only_counted else rows
