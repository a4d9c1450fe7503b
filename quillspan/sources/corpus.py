"""Corpora: XML collections of pages, tables of pages or texts; all become docs(doc_id, url, title, body)."""

import atexit
import html
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.analysis import clean

FILES = "WebIR*.xml"
#: Named references that ``entities`` decodes without a UDF.
NAMED = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&middot;": "·", "&laquo;": "«", "&raquo;": "»", "&zwnj;": "‌", "&amp;": "&"}


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, url, html) of each DOC in the folder's collection files."""
    rows = spark.read.format("xml").option("rowTag", "DOC").option("pathGlobFilter", FILES).schema("DOCID string, URL string, HTML string").load(path)
    return rows.select(F.trim("DOCID").alias("doc_id"), F.trim("URL").alias("url"), F.col("HTML").alias("html"))


@F.pandas_udf(StringType())
def all_entities(text: pd.Series) -> pd.Series:
    """Every character reference, numeric ones too, as HTML has them; column functions have no table of its 2,231 names."""
    return text.map(html.unescape, na_action="ignore")


def entities(text: Column) -> Column:
    """Named entities of the list above; the ampersand last, so that nothing is decoded twice."""
    for name, char in NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def without_scripts(page: Column) -> Column:
    page = F.regexp_replace(page, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style"):
        page = F.regexp_replace(page, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return page


def title_of(page: Column) -> Column:
    return F.regexp_extract(without_scripts(page), r"(?is)<title[^>]*>(.*?)</title>", 1)


def body_of(page: Column) -> Column:
    inner = F.regexp_extract(without_scripts(page), r"(?is)<body[^>]*>(.*?)(?:</body>|\z)", 1)
    return F.regexp_replace(inner, r"(?s)<[^>]*>", "")


Analyser = Callable[[Column], Column]


def parse_pages(pages: DataFrame, id_col: str = "page_id", decode=all_entities, analyse: Analyser = clean) -> DataFrame:
    """docs of pages (id, url, html): title and body text, without markup, comments, scripts and styles.

    ``decode`` turns character references into characters: all_entities for any that there are, entities for those of NAMED.
    """
    page = F.coalesce("html", F.lit(""))
    return with_lengths(pages.select(F.col(id_col).alias("doc_id"), "url", decode(title_of(page)).alias("title"), decode(body_of(page)).alias("body")), analyse)


def parse_texts(texts: DataFrame, analyse: Analyser = clean) -> DataFrame:
    """docs of documents: the title is the first line."""
    text = F.coalesce("text", F.lit(""))
    docs = texts.select("doc_id", F.lit(None).cast("string").alias("url"), F.regexp_extract(text, r"^[^\n]*", 0).alias("title"), F.regexp_replace(text, r"^[^\n]*\n?", "").alias("body"))
    return with_lengths(docs, analyse)


def with_lengths(docs: DataFrame, analyse: Analyser = clean) -> DataFrame:
    """docs with the words of title and body, and their numbers; ``analyse`` makes words of a text, as for lemmas or another normaliser."""
    docs = docs.withColumns({"title_tokens": analyse(F.col("title")), "body_tokens": analyse(F.col("body"))})
    return docs.withColumns({"title_len": F.size("title_tokens"), "body_len": F.size("body_tokens")})


def documents(spark: SparkSession, sf_dir: str, analyse: Analyser = clean) -> DataFrame:
    return parse_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), analyse)


def with_unique_ids(docs: DataFrame) -> DataFrame:
    """docs, if no two have one id; only ids are shuffled for it."""
    twice = docs.groupBy("doc_id").count().where("count > 1").select("doc_id").limit(1).collect()
    if twice:
        raise ValueError(f"document id {twice[0]['doc_id']!r} stands for several documents")
    return docs


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, as in tests, one of this machine is set.

    Executors of other machines would not see that one: there the setting is asked for.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_kept: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _kept:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended before us
            return


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what is read more than once."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of fewer rows, of a word or a query's words each, goes to all tasks.
FEW_ROWS = 200_000


def lookup(df: DataFrame, name: str) -> DataFrame:
    """df, of a batch of queries, as a table; marked for a broadcast where its rows are counted as few."""
    df = kept(df, name)
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table at path was written to its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ensure(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written if it isn't there; it is always read back."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_xml(docs: DataFrame, path: str) -> None:
    """docs (doc_id, url, html) as a collection that read_xml reads."""
    rows = docs.select(F.col("doc_id").cast("string").alias("DOCID"), F.col("url").alias("URL"), F.col("html").alias("HTML"))
    rows.write.format("xml").option("rootTag", "ROOT").option("rowTag", "DOC").save(path)
    jvm, spark = docs.sparkSession._jvm, docs.sparkSession
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("part-"):
            new = name if name.endswith(".xml") else f"{name}.xml"
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/WebIR-{new}"))
