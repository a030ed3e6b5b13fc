"""A lexical index that is built once, searched often and changed by files.

Postings lie in folders by the hash of their term, so that a search reads those of its own terms; within a folder they are in
the order of terms. A change adds a part beside those that are there: postings of new chunks, ids of chunks that are gone,
and by how much the document frequencies of terms change. A search puts the parts together as it reads. Every build, change
and compaction is one commit: a search sees all of it or nothing.

Parts of a version, below their folder: postings (bucket, term, id, tf, dl), terms (bucket, term, df: a difference), chunks
(file_bucket, file, id, dl, terms, tfs, and the columns to filter by), gone (id), and frequencies (df, n: how many terms more
or less have this document frequency), from which the mean idf follows without reading the terms.

Texts are split once, and each chunk's words counted in its own row, as it is written to its part; postings are made from that
table. They travel once, in blocks: of one term, the chunks of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import text as tx
from tidemark.operators.retrieval import PAIRS_PER_TASK, top_per_query
from tidemark.sources import commits
from tidemark.sources.storage import written

FORMAT = "3"
#: Most chunks of a block of postings.
BLOCK = 256
#: Words, or pairs of a chunk and one of its terms, that a task works on at once, about; a chunk with more alone.
AT_ONCE = 1 << 20
#: Columns of the tables whose columns are always the same; {id} is the type of ids.
SCHEMAS = {
    "postings": "id {id}, term string, dl int, tf int, bucket int",
    "terms": "term string, df long, bucket int",
    "gone": "id {id}",
    "frequencies": "df long, n long",
}

def _bucket(term: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the lists of a column hold at most `most` values in each, but for single rows with more."""
    most = most or AT_ONCE
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end
        if not batch.num_rows:
            yield batch


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, file, words and more columns; of words there become dl, terms (distinct, in any order) and tfs."""
    for batch in _slices(batches, "words"):
        words = batch.column("words")
        dl = pc.list_value_length(words)
        row = np.repeat(np.arange(batch.num_rows), dl.to_numpy())
        pairs = pa.table({"row": row, "term": pc.list_flatten(words)}).group_by(["row", "term"]).aggregate([([], "count_all")])
        pairs = pairs.sort_by("row").combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], pairs.schema)]
        sizes = np.bincount(pairs[0]["row"].to_numpy(), minlength=batch.num_rows)
        ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
        lists = {"terms": pa.ListArray.from_arrays(ends, pairs[0]["term"]), "tfs": pa.ListArray.from_arrays(ends, pairs[0]["count_all"].cast(pa.int32()))}
        kept = {name: batch.column(name) for name in batch.schema.names if name != "words"}
        yield pa.RecordBatch.from_pydict(kept | {"dl": dl.cast(pa.int32())} | lists)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, ids, tfs, dls: the chunks of a batch that hold a term, BLOCK at most in a row. batches: id, dl, terms, tfs."""
    for batch in _slices(batches, "terms"):
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("terms")).to_numpy())
        if not len(row):
            continue
        coded = pc.list_flatten(batch.column("terms")).dictionary_encode(null_encoding="encode")
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        code = coded.indices.to_numpy()[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        at = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
        starts = np.flatnonzero(at % BLOCK == 0)
        ends = pa.array(np.r_[starts, len(code)], pa.int32())
        row = row[order]
        columns = [batch.column("id").take(pa.array(row)), pc.list_flatten(batch.column("tfs")).take(pa.array(order)), batch.column("dl").take(pa.array(row))]
        lists = [pa.ListArray.from_arrays(ends, c) for c in columns]
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[starts])), *lists], ["term", "ids", "tfs", "dls"])


def _counted(chunks: DataFrame, id_col: str, text_col: str, file_col: str, columns: tuple[str, ...], tokenize: Callable[[Column], Column]) -> DataFrame:
    """id, file, the columns to filter by, dl, terms and tfs."""
    kept = [chunks[c].alias(f"c_{c}") for c in columns]
    words = F.coalesce(tokenize(chunks[text_col]), F.array().cast("array<string>"))
    rows = chunks.select(chunks[id_col].alias("id"), chunks[file_col].cast("string").alias("file"), *kept, words.alias("words"))
    same = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "words")
    return rows.mapInArrow(_count_words, f"{same}, dl int, terms array<string>, tfs array<int>")


def _write_chunks(rows: DataFrame, folder: str, buckets: int) -> DataFrame:
    """The chunks of a part, as of _counted(), where their task has them: none travels, whatever a file holds. Small row groups in
    the order of file_bucket, so that those of few files are read alone."""
    rows = rows.withColumn("file_bucket", _bucket(F.col("file"), buckets)).sortWithinPartitions("file_bucket", "file")
    rows.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{folder}/chunks")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/chunks")


def _frequencies(before: DataFrame, after: DataFrame) -> DataFrame:
    """df, n: how the number of terms of each document frequency changes. Both: df."""
    up, down = after.select("df", F.lit(1).alias("n")), before.select("df", F.lit(-1).alias("n"))
    counts = up.unionByName(down).where("df > 0").groupBy("df").agg(F.sum("n").cast("long").alias("n"))
    return counts.where("n <> 0")


def _write_postings(chunks: DataFrame, gone: DataFrame, lost: DataFrame, before: DataFrame, folder: str, buckets: int) -> dict:
    """chunks: as of _write_chunks(); gone: id; lost: term, df of chunks that are gone; before: term, df as they were, of the
    terms that change. Gives what a commit says of the part's columns."""
    spark, id_type = chunks.sparkSession, dict(chunks.dtypes)["id"]
    blocks = chunks.select("id", "dl", "terms", "tfs").mapInArrow(_blocks, f"term string, ids array<{id_type}>, tfs array<int>, dls array<int>")
    # By range of term and chunk: a term that every chunk holds is cut into as many tasks as its size asks for.
    dealt = blocks.withColumn("bucket", _bucket(F.col("term"), buckets)).repartitionByRange("bucket", "term", F.col("ids")[0])
    postings = dealt.select("term", "bucket", F.inline(F.arrays_zip("ids", "tfs", "dls")).alias("id", "tf", "dl"))
    postings = postings.select("id", "term", "dl", "tf", "bucket")
    sorted_ = postings.sortWithinPartitions("bucket", "term", "id")
    sorted_.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/postings")
    found = spark.read.schema(postings.schema).parquet(f"{folder}/postings").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    minus = lost.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", (-F.col("df")).alias("df"))
    terms = found.unionByName(minus).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/terms")
    terms = spark.read.schema(terms.schema).parquet(f"{folder}/terms")
    before = before.join(terms.select("term"), "term", "left_semi").select("term", "df")
    after = terms.select("term", "df").unionByName(before).groupBy("term").agg(F.sum("df").alias("df"))
    _frequencies(before, after).write.parquet(f"{folder}/frequencies")
    gone.select("id").distinct().write.parquet(f"{folder}/gone")
    return {"chunks": chunks.schema.jsonValue(), "id_type": id_type, "buckets": buckets, "format": FORMAT}


def _content(spark: SparkSession, base: commits.Commit | None, folder: str, made: dict, n_gone: int = 0, dl_gone: int = 0) -> dict:
    chunks = spark.read.schema(StructType.fromJson(made["chunks"])).parquet(f"{folder}/chunks")
    sums = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
    old = base.content if base else {"n": 0, "dl": 0, "parts": []}
    return made | {"n": old["n"] + sums.n - n_gone, "dl": old["dl"] + sums.dl - dl_gone, "parts": [*old["parts"], folder.rsplit("/", 1)[1]]}


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def build_index(
    chunks: DataFrame,
    root: str,
    *,
    id_col: str,
    text_col: str,
    file_col: str,
    columns: tuple[str, ...] = (),
    buckets: int = 64,
    tokenize: Callable[[Column], Column] = tx.tokens,
) -> commits.Commit:
    """Builds the index of chunks as a version of root that holds nothing else. file_col: what a change names chunks by; columns:
    what a search may filter by. Null text: a chunk without words, which counts in the statistics. Ids should be distinct."""
    spark = chunks.sparkSession
    rows = _counted(chunks, id_col, text_col, file_col, columns, tokenize)
    id_type = dict(rows.dtypes)["id"]

    def write(base: commits.Commit | None, folder: str) -> dict:
        none = _none(spark, "term string, df long")
        part = _write_chunks(rows, folder, buckets)
        return _content(spark, None, folder, _write_postings(part, _none(spark, f"id {id_type}"), none, none, folder, buckets))

    return commits.commit(spark, root, write)


class Index:
    """One version of an index, its parts put together."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        found = commits.read_commit(spark, root, version)
        if found is None:
            raise ValueError(f"no index below {root}")
        if found.content.get("format") != FORMAT:
            raise ValueError(f"an index of format {found.content.get('format')}, not {FORMAT}")
        self.spark, self.version, c = spark, found.version, found.content
        self.n, self.dl, self.buckets, self.id_type = c["n"], c["dl"], c["buckets"], c["id_type"]
        self.parts = [f"{root}/data/{folder}" for folder in c["parts"]]
        chunks = StructType.fromJson(c["chunks"])
        self.columns = [f.name[2:] for f in chunks if f.name.startswith("c_")]
        self.schemas = {name: ddl.format(id=self.id_type) for name, ddl in SCHEMAS.items()} | {"chunks": chunks}

    def table(self, name: str) -> DataFrame:
        """All parts of a table; part: which one, in the order of changes."""
        parts = [self.spark.read.schema(self.schemas[name]).parquet(f"{folder}/{name}").withColumn("part", F.lit(n)) for n, folder in enumerate(self.parts)]
        return reduce(DataFrame.unionByName, parts)

    def alive(self, rows: DataFrame) -> DataFrame:
        """Rows with part and id, but for those of chunks that a later change took away."""
        if len(self.parts) == 1:
            return rows.drop("part")
        gone = self.table("gone").groupBy("id").agg(F.max("part").alias("gone"))
        return rows.join(gone, "id", "left").where("gone is null or part >= gone").drop("part", "gone")

    def in_buckets(self, name: str, terms: DataFrame) -> DataFrame:
        """The folders of a table that hold any of these terms; the driver gets numbers of buckets, `buckets` at most."""
        asked = [r[0] for r in terms.select(_bucket(F.col("term"), self.buckets)).distinct().collect()]
        return self.table(name).where(F.col("bucket").isin(asked))

    def frequencies_of(self, terms: DataFrame) -> DataFrame:
        """term, df of those terms that any chunk holds. terms: term, distinct."""
        found = self.in_buckets("terms", terms).join(terms.select("term"), "term", "left_semi")
        return found.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def mean_idf(self) -> float:
        """Over all terms, negative ones included."""
        counts = self.table("frequencies").groupBy("df").agg(F.sum("n").alias("n")).where("n > 0")
        raw = F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return counts.agg(F.sum(raw * F.col("n")) / F.sum("n")).first()[0] or 0.0

    def idf_of(self, frequencies: DataFrame, floor: float = 0.25) -> DataFrame:
        """term, df, idf; negative ones become `floor` times the mean."""
        raw = F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return frequencies.withColumn("raw", raw).select("term", "df", F.when(F.col("raw") < 0, self.mean_idf() * floor).otherwise(F.col("raw")).alias("idf"))


def index_terms(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """term, df, idf of all terms."""
    index = Index(spark, root, version)
    return index.idf_of(index.table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"))


def index_search(
    spark: SparkSession,
    root: str,
    queries: DataFrame,
    *,
    query_id: str,
    query_text: str,
    k: int,
    k1: float = 1.5,
    b: float = 0.75,
    filters: dict[str, object] | None = None,
    version: int | None = None,
    broadcast_bytes: int = 8 << 20,
    tokenize: Callable[[Column], Column] = tx.tokens,
) -> DataFrame:
    """query_id, id, score, rank: as bm25_search() over the chunks that the index holds now, without reading a text.

    Only the buckets of the queries' terms are read. filters: values of the index's columns, null for null.

    The postings of these terms are dealt by chunk, in as many tasks as their document frequencies ask for, and meet the words of
    all queries there: pairs of query and chunk don't travel, only the best of each task do. That takes a copy of the queries'
    words in each; over `broadcast_bytes` of them, postings and queries are joined by term, and scores summed after a shuffle.
    """
    index = Index(spark, root, version)
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(query_text))).alias("term"))
    asked = written(asked.groupBy("query_id", "term").agg(F.count("*").alias("qf")))
    terms = asked.select("term").distinct()
    weighted = written(asked.join(index.idf_of(index.frequencies_of(terms)), "term"))
    # As a row of a broadcast: the strings, and about 64 bytes for the numbers and pointers.
    size = F.sum(F.octet_length("term") + F.coalesce(F.octet_length(F.col("query_id").cast("string")), F.lit(0)) + 64)
    sums = weighted.agg(F.coalesce(size, F.lit(0)).alias("bytes"), F.coalesce(F.sum("df"), F.lit(0)).alias("pairs")).first()
    postings = index.alive(index.in_buckets("postings", terms).join(terms, "term", "left_semi").select("id", "term", "tf", "dl", "part"))
    if filters:
        if unknown := set(filters) - set(index.columns):
            raise ValueError(f"the index holds no column {sorted(unknown)}")
        right = reduce(Column.__and__, (F.col(f"c_{name}").eqNullSafe(F.lit(v)) for name, v in filters.items()))
        postings = postings.join(index.alive(index.table("chunks").where(right).select("id", "part")), "id", "left_semi")
    mean = index.dl / index.n if index.n and index.dl else 1.0
    length = F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(float(mean))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    if sums.bytes <= broadcast_bytes:
        met = postings.repartition(min(-(-sums.pairs // PAIRS_PER_TASK), 100_000) or 1, "id").join(F.broadcast(weighted), "term")
    else:
        met = weighted.join(postings, "term")
    scored = met.groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    return top_per_query(scored, k)


def change_index(
    root: str,
    changes: DataFrame,
    chunks: DataFrame,
    *,
    id_col: str,
    text_col: str,
    file_col: str,
    tokenize: Callable[[Column], Column] = tx.tokens,
) -> commits.Commit:
    """A version after changes: the chunks of deleted and modified files go, those of added and modified ones come.

    changes: file, change (added, modified or deleted); of a file named twice, deleted wins, then modified. chunks: of the
    added and modified files; others are left out. Only the folders of the changed files and terms are read. If another
    writer commits first, the change is made anew on top of that.
    """
    spark = chunks.sparkSession
    order = F.array(F.lit("deleted"), F.lit("modified"), F.lit("added"))
    ranked = changes.select(F.col("file").cast("string").alias("file"), F.array_position(order, F.col("change")).alias("r"))
    wanted = written(ranked.where("r > 0").groupBy("file").agg(F.min("r").alias("r")))
    first = Index(spark, root)
    coming = chunks.join(wanted.where("r > 1").select(F.col("file").alias("_file")), F.col(file_col).cast("string") == F.col("_file"), "left_semi")
    rows = _counted(coming, id_col, text_col, file_col, tuple(first.columns), tokenize)
    leaving = wanted.where("r < 3").select("file")
    file_buckets = [r[0] for r in leaving.select(_bucket(F.col("file"), first.buckets)).distinct().collect()]

    def write(base: commits.Commit | None, folder: str) -> dict:
        index = Index(spark, root, base.version)
        old = index.table("chunks").where(F.col("file_bucket").isin(file_buckets)).join(leaving, "file", "left_semi")
        old = written(index.alive(old.select("id", "dl", "terms", "part")))
        part = _write_chunks(rows, folder, index.buckets)
        lost = old.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        touched = lost.select("term").unionByName(part.select(F.explode("terms").alias("term"))).distinct()
        before = written(index.frequencies_of(written(touched)))
        sums = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        return _content(spark, base, folder, _write_postings(part, old, lost, before, folder, index.buckets), sums.n, sums.dl)

    return commits.commit(spark, root, write, rests_on_base=True)


def compact_index(spark: SparkSession, root: str) -> commits.Commit:
    """A version with the same chunks in one part; the parts of older versions stay until they are removed."""

    def write(base: commits.Commit | None, folder: str) -> dict:
        index = Index(spark, root, base.version)
        part = _write_chunks(index.alive(index.table("chunks").drop("file_bucket")), folder, index.buckets)
        none = _none(spark, "term string, df long")
        return _content(spark, None, folder, _write_postings(part, _none(spark, f"id {index.id_type}"), none, none, folder, index.buckets))

    return commits.commit(spark, root, write, rests_on_base=True)
