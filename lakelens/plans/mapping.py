"""The corpus relations over the driver tables: one place that says which table plays which part."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.operators import ann, inverted
from lakelens.operators.ordered import cached


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, f"{sf_dir}/{name}.parquet") if name == "documents" else rows


#: A row group of a file is read by one task. Below as many bytes a core, rows of texts are dealt to all cores before they are worked on.
ROW_GROUP = 1 << 23


def spread(rows: DataFrame, path: str) -> DataFrame:
    """Rows of a table that is a file or two are dealt out evenly; a large table has enough row groups and is read as it is."""
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = sum(f.getLen() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if size < cores * ROW_GROUP else rows


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers: id, id-month, category, whether text is held, when published."""
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("paper_id"), F.date_format("o_orderdate", "yyMM").alias("month"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") != "P").alias("has_text"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("published"))


def _folder(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of its own only on a single machine that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakelens-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: What is prepared is kept under this; another number makes tables of an older form unknown.
FORMAT = "3"


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _state(spark: SparkSession, sf_dir: str, *sources: str) -> str:
    """The sources' files, their sizes and times: what was made of them holds as long as this stays."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{s}.parquet") for s in sources]
    files = [f for path in paths for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return ";".join(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)


def prepared(spark: SparkSession, sf_dir: str, source: str | tuple[str, ...], name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table made once of its sources and kept as long as their files stay as they are."""
    sources = (source,) if isinstance(source, str) else source
    return cached(f"{_folder(spark)}/lakelens-{name}-{FORMAT}", _state(spark, sf_dir, *sources), build, lambda p: _there(spark, p))


def keep(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """Writes tables to the session's shared folder and reads them back, so that what follows starts from files."""

    def written(df: DataFrame, name: str) -> DataFrame:
        path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return written


def indexed(spark: SparkSession, sf_dir: str, source: str, name: str, rows: Callable[[], DataFrame], key: str, kind: str, *texts: str) -> inverted.Index:
    """An inverted index made once of a source, kept likewise."""
    state = hashlib.sha256(_state(spark, sf_dir, source).encode()).hexdigest()[:16]
    place = f"{_folder(spark)}/lakelens-{name}-{FORMAT}/{state}"
    if _there(spark, f"{place}/stats/_SUCCESS"):
        return inverted.Index(place, key, kind, "plain", BUCKETS)
    return inverted.build(rows(), key, *texts, path=place, buckets=BUCKETS)


BUCKETS = 16


def neighbours(spark: SparkSession, sf_dir: str) -> ann.Ann:
    """The index of approximate neighbours of all vectors, made once."""
    place = f"{_folder(spark)}/lakelens-neighbours-{FORMAT}/{hashlib.sha256(_state(spark, sf_dir, 'embeddings').encode()).hexdigest()[:16]}"
    if _there(spark, f"{place}/head/_SUCCESS"):
        return ann.load(place)
    return ann.build(load(spark, sf_dir, "embeddings"), "vec_id", place)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from papers to works, a table that is made once and sorted by work."""

    def edges() -> DataFrame:
        rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing_id"), F.col("l_partkey").alias("cited_id"))
        return rows.distinct().repartition("cited_id").sortWithinPartitions("cited_id", "citing_id")

    return prepared(spark, sf_dir, "lineitem", "citations", edges)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"), F.col("p_size").alias("year"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks of papers; returned ones make a paper indexed."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").cast("int").alias("n_tokens"), F.col("l_returnflag").alias("section"), F.col("l_linenumber").alias("page_end"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("session_id"), F.to_date("ts").alias("day"), F.col("event_type").alias("tool"), F.col("value").alias("cost"), "ts", "props")


ADJECTIVES = ["red", "small", "quick", "deep", "sparse"]
NOUNS = ["attention", "graph", "model", "search", "index", "chain"]
NAMES = ["Ada Lin", "Bo Chen", "Cy Dorn", "Di Ekman", "Ed Frost", "Fay Gold", "Gus Hale", "Hana Ito"]


def _pick(words: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (at + 1).cast("int"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as catalog entries with all their columns, some of them null or blank."""
    o = load(spark, sf_dir, "orders")
    key, who, month = F.col("o_orderkey"), F.col("o_custkey"), F.date_format("o_orderdate", "yyMM")
    names = F.transform(F.sequence(F.lit(1), (who % 9 + 1).cast("int")), lambda i: _pick(NAMES, (key + i - 1) % 8))
    authors = F.slice(names, 1, (who % 9).cast("int"))
    return o.select(
        key.alias("paper_id"),
        F.concat(month, F.lit("."), F.format_string("%05d", key)).alias("pid"),
        month.alias("month"),
        F.concat(_pick(ADJECTIVES, who % 5), F.lit(" "), _pick(NOUNS, key % 6), F.lit(" study "), (who % 50).cast("string")).alias("title"),
        F.when(who % 2 == 0, F.array_join(authors, ", ")).otherwise(F.array_join(authors, " and ")).alias("authors"),
        F.when(who % 13 != 0, F.col("o_orderpriority")).alias("category"),
        F.when(who % 11 == 0, F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published"),
        F.when(who % 3 == 1, F.lit("CC-BY-4.0")).when(who % 3 == 2, F.lit("other")).alias("license"),
        F.when(who % 5 == 0, F.concat(F.lit("V"), (who % 7).cast("string"))).alias("venue"),
        F.when(who % 4 != 0, F.concat(F.lit("v"), (who % 3 + 1).cast("string"))).alias("version"),
        (F.col("o_orderstatus") != "P").alias("has_text"),
        F.col("o_totalprice").alias("size"),
    )


def short_id(key: Column) -> Column:
    """A key as an id of four and five digits, as the citation patterns ask: another month for each number that five digits hold, so that no two keys share one.

    Months begin with 0701; there are enough for 9,300,000 keys, after which years would need three digits.
    """
    year, month = F.floor(key / 100000).cast("long") + 7, key % 100000 % 12 + 1
    return F.format_string("%02d%02d.%05d", year, month, key % 100000)


#: The same in SQL, of paper_id.
SHORT_ID = "printf('%02d%02d.%05d', paper_id // 100000 + 7, paper_id % 100000 % 12 + 1, paper_id % 100000)"


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog lists a month: nothing for Decembers, less than we hold for Junes, a fifth more for two months."""
    n = papers(spark, sf_dir).groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    mm = F.substring("month", 3, 2)
    listed = F.when(mm == "06", F.col("n") - 1).when(mm.isin("02", "08"), F.col("n") + F.expr("n div 5 + 1")).otherwise(F.col("n") + F.expr("n div 20"))
    return n.filter(mm != "12").select("month", listed.alias("cs_papers"))


#: The same relations for the SQL side.
VIEWS = f"""
WITH papers AS (SELECT o_orderkey AS paper_id, strftime(o_orderdate, '%y%m') AS month, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS category, o_orderstatus <> 'P' AS has_text, o_totalprice AS size, o_orderdate AS published FROM orders),
citations AS (SELECT DISTINCT l_orderkey AS citing_id, l_partkey AS cited_id FROM lineitem),
works AS (SELECT p_partkey AS work_id, p_name AS title, p_brand AS category, p_size AS year FROM part),
chunks AS (SELECT l_orderkey AS paper_id, l_linenumber AS seq, CAST(l_quantity AS INTEGER) AS n_tokens, l_returnflag AS section, l_linenumber AS page_end FROM lineitem),
indexed AS (SELECT DISTINCT paper_id FROM chunks WHERE section = 'R'),
runs AS (SELECT event_id AS run_id, user_id AS session_id, CAST(ts AS DATE) AS day, event_type AS tool, value AS cost, ts, props FROM events)
"""

_NAMES = "[" + ", ".join(f"'{x}'" for x in NAMES) + "]"
_ADJECTIVES = "[" + ", ".join(f"'{x}'" for x in ADJECTIVES) + "]"
_NOUNS = "[" + ", ".join(f"'{x}'" for x in NOUNS) + "]"
#: More relations, on top of VIEWS.
CATALOG = f""", catalog AS (SELECT o_orderkey AS paper_id, strftime(o_orderdate, '%y%m') || '.' || printf('%05d', o_orderkey) AS pid, strftime(o_orderdate, '%y%m') AS month,
  {_ADJECTIVES}[o_custkey % 5 + 1] || ' ' || {_NOUNS}[o_orderkey % 6 + 1] || ' study ' || (o_custkey % 50) AS title,
  coalesce(CASE WHEN o_custkey % 2 = 0 THEN array_to_string(list_transform(range(o_custkey % 9), lambda i: {_NAMES}[(o_orderkey + i) % 8 + 1]), ', ') ELSE array_to_string(list_transform(range(o_custkey % 9), lambda i: {_NAMES}[(o_orderkey + i) % 8 + 1]), ' and ') END, '') AS authors,
  CASE WHEN o_custkey % 13 <> 0 THEN o_orderpriority END AS category,
  CASE WHEN o_custkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published,
  CASE o_custkey % 3 WHEN 1 THEN 'CC-BY-4.0' WHEN 2 THEN 'other' END AS license,
  CASE WHEN o_custkey % 5 = 0 THEN 'V' || (o_custkey % 7) END AS venue,
  CASE WHEN o_custkey % 4 <> 0 THEN 'v' || (o_custkey % 3 + 1) END AS version,
  o_orderstatus <> 'P' AS has_text, o_totalprice AS size FROM orders),
census AS (SELECT month, CASE WHEN month[3:4] = '06' THEN n - 1 WHEN month[3:4] IN ('02', '08') THEN n + n // 5 + 1 ELSE n + n // 20 END AS cs_papers
  FROM (SELECT month, count(*) AS n FROM papers GROUP BY month) WHERE month[3:4] <> '12'),
coverage AS (SELECT p.month, papers_held, papers_parsed, refs_made, CASE WHEN cs_papers >= papers_held THEN cs_papers END AS catalog_papers
  FROM (SELECT month, count(*) AS papers_held, count(*) FILTER (has_text) AS papers_parsed FROM papers GROUP BY month) p
  JOIN (SELECT month, count(cited_id) AS refs_made FROM papers LEFT JOIN citations ON citing_id = paper_id GROUP BY month) r USING (month) LEFT JOIN census USING (month)),
complete AS (SELECT month FROM coverage WHERE papers_held::DOUBLE / catalog_papers >= 0.9),
cohort AS (SELECT month FROM (SELECT month, count(DISTINCT citing_id) AS n, sum(count(DISTINCT citing_id)) OVER () AS total FROM citations JOIN papers ON citing_id = paper_id GROUP BY month) WHERE n >= 0.01 * total)
"""
