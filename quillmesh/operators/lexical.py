"""BM25 over an inverted table of postings: statistics of the whole corpus, batched search of many queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.analyzer import Analyzer
from quillmesh.functions.filters import SearchFilters, matches
from quillmesh.functions.text import tokens
from quillmesh.session import ship

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Scores that differ less count as equal, so that the order of a sum can't change a rank.
DIGITS = 9


@dataclass(frozen=True)
class LexicalIndex:
    """``texts`` (chunk_id, words) with the terms of each chunk in order as one string (``joined``), ``postings`` (chunk_id, term, tf, dl),
    ``terms`` (term, df, idf), ``corpus`` (n, avgdl), ``chunks``."""

    chunks: DataFrame
    texts: DataFrame
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    analyzer: Analyzer | None = None
    stopwords: tuple[str, ...] = ()


def terms_of(col: Column, stopwords: tuple[str, ...] = (), analyzer: Analyzer | None = None) -> Column:
    """The terms of a text: by a dictionary if there is an analyzer, else by the native rule."""
    return analyzer.column(col) if analyzer is not None else tokens(col, stopwords)


def joined(terms: Column) -> Column:
    """An array of terms as one string, a fraction of its size; no term has white space."""
    return F.array_join(terms, "\n")


def parted(words: Column | str) -> Column:
    """The terms of a string that ``joined`` made; one empty term if there were none."""
    return F.split(words, "\n")


def posted(chunks: DataFrame, text: str = "index_text", stopwords: tuple[str, ...] = (), analyzer: Analyzer | None = None) -> DataFrame:
    """(chunk_id, term, tf, dl): the terms of each chunk with their counts and the chunk's length."""
    return counted(chunks.select("chunk_id", terms_of(F.col(text), stopwords, analyzer).alias("t")))


def counted(texts: DataFrame) -> DataFrame:
    """The postings of texts (chunk_id, t), t an array of terms."""
    each = texts.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").cast("bigint").alias("dl"))


def term_stats(postings: DataFrame) -> DataFrame:
    """(term, df, cf): chunks with the term, and its occurrences."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def inverse_frequencies(stats: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf): negative values are replaced by a quarter of the mean over the vocabulary."""
    raw = stats.join(F.broadcast(corpus.select("n"))).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))  # one row of corpus figures
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def build(chunks: DataFrame, text: str = "index_text", stopwords: tuple[str, ...] = (), keep: bool = True, analyzer: Analyzer | None = None, check: bool = False, words: str | None = None) -> LexicalIndex:
    """The index of chunks with unique ids; ``keep`` persists their terms, and the frequencies, for the searches of a session, ``check`` reads the
    corpus once to refuse one that is empty, repeats an id or has a chunk without terms (T11). ``words`` names a column that has the terms ``joined``
    already, persisted or not by the caller. A chunk's terms are counted in its row, so that the statistics shuffle terms and counts, but no posting."""
    texts = chunks.select("chunk_id", (F.col(words) if words else joined(terms_of(F.col(text), stopwords, analyzer))).alias("words"))
    if keep and words is None:
        texts = texts.persist(StorageLevel.MEMORY_AND_DISK)
    some = texts.where("words != ''").select("chunk_id", parted("words").alias("t"))
    postings = counted(some)
    stats = some.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if keep:
        stats = stats.persist(StorageLevel.MEMORY_AND_DISK)
    corpus = texts.agg(F.count("*").alias("n"), F.sum(F.when(F.col("words") != "", F.size(parted("words"))).otherwise(0)).alias("total")).select("n", (F.col("total") / F.col("n")).alias("avgdl"))
    if check:
        wrong = unfit(chunks, postings).first()
        if wrong is not None:
            raise ValueError(f"{wrong.reason}{': ' + wrong.chunk_id if wrong.chunk_id else ''}")
    return LexicalIndex(chunks, texts, postings, inverse_frequencies(stats, corpus), corpus, analyzer, stopwords)


def unfit(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """(reason, chunk_id) of what keeps a corpus from being indexed: no chunks, a repeated id, a chunk without searchable terms."""
    none = chunks.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("the corpus is empty").alias("reason"), F.lit(None).cast("string").alias("chunk_id"))
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("the chunk id is repeated").alias("reason"), "chunk_id")
    bare = chunks.select("chunk_id").distinct().join(postings.select("chunk_id"), "chunk_id", "left_anti").select(F.lit("the chunk has no searchable terms").alias("reason"), "chunk_id")
    return none.unionByName(twice).unionByName(bare)


def query_terms(queries: DataFrame, stopwords: tuple[str, ...] = (), analyzer: Analyzer | None = None) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, query)."""
    return queries.select("query_id", F.explode(terms_of(F.col("query"), stopwords, analyzer)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def ranked(scores: DataFrame, k: int, *ties: Column | str) -> DataFrame:
    """The k best rows of each query with ``rank`` 1..k."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), *(ties or ("chunk_id",)))
    return scores.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


#: Chunks and queries of one block. Each side is copied once for each block of the other, and a pair of blocks gives k rows a query: so blocks
#: are as large as a task can well hold.
CHUNK_BLOCK, QUERY_BLOCK = 8192, 16384
_FACTS = ("document_id", "heading_path", "page_start", "page_end")


def search(index: LexicalIndex, queries: DataFrame, k: int = 5, filters: SearchFilters | None = None, ties: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k best chunks that share a term with a query, whatever the sign of the score. ``filters`` hold for
    all queries; a ``filters`` column of the queries holds for its own. Statistics are of the unfiltered corpus. ``ties`` are columns of the
    chunks that order equal scores, such as the place in the corpus.

    Queries carry the frequencies of their terms, so that the terms of a chunk are one row that is never joined by term. They are laid out by blocks of
    chunks and queries and counted and weighted there; only the k best of a block, and what ties with them, leave it. So neither a
    frequent term nor the number of queries makes rows of query and chunk."""
    ship(index.chunks.sparkSession)
    asked = query_terms(queries, index.stopwords, index.analyzer).join(index.terms.select("term", "idf"), "term")
    rows = index.texts.where("words != ''")
    own = "filters" in queries.columns
    facts = index.chunks if filters is None else index.chunks.where(filters.predicate())
    extra = [t for t in ties if t != "chunk_id"]
    if own or filters is not None or extra:
        rows = rows.join(facts.select("chunk_id", *(_FACTS if own else ()), *[F.col(t).alias(f"tie_{t}") for t in extra]), "chunk_id")
    whole = index.corpus.select(F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK_BLOCK)).alias("chunk_blocks")).join(F.broadcast(queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / QUERY_BLOCK)).alias("query_blocks"))))
    one = asked.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("qtf") * F.col("idf")).alias("weights")).join(F.broadcast(index.corpus.select("avgdl")))
    if own:
        one = one.join(queries.select("query_id", "filters"), "query_id")

    def placed(df: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        at = df.join(F.broadcast(whole)).withColumn("__m", F.pmod(F.xxhash64(key), mine)).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))  # one row of sizes
        return at.drop("chunk_blocks", "query_blocks")

    a = placed(rows, "chunk_id", "chunk_blocks", "query_blocks").withColumnsRenamed({"__m": "cb", "__o": "qb"})
    b = placed(one, "query_id", "query_blocks", "chunk_blocks").withColumnsRenamed({"__m": "qb", "__o": "cb"})
    tie_types = "".join(f", tie_{t} {facts.schema[t].dataType.simpleString()}" for t in extra)
    ddl = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {index.chunks.schema['chunk_id'].dataType.simpleString()}, score double{tie_types}"

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        return block_hits(x, y, k, [f"tie_{t}" for t in extra], own)

    left = a.select(*[F.col(c).alias(c) for c in a.columns])
    right = b.select(F.col("cb").alias("cb_"), F.col("qb").alias("qb_"), *[F.col(c).alias(c) for c in b.columns if c not in ("cb", "qb")])
    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb_", "qb_")).applyInArrow(best, ddl)
    return ranked(found, k, *[f"tie_{t}" if t != "chunk_id" else t for t in ties]).select("query_id", "chunk_id", "score", "rank")


def block_hits(x: pa.Table, y: pa.Table, k: int, ties: list[str], own: bool) -> pa.Table:
    """The k best chunks of a block ``x`` for each query of ``y``, with all that tie with the last of them."""
    names = ["query_id", "chunk_id", "score", *ties]
    types = [y.schema.field("query_id").type, x.schema.field("chunk_id").type, pa.float64(), *[x.schema.field(t).type for t in ties]]
    schema = pa.schema(list(zip(names, types, strict=True)))
    if not x.num_rows or not y.num_rows:
        return schema.empty_table()
    x, y = x.combine_chunks(), y.combine_chunks()
    n, words, terms = x.num_rows, pc.split_pattern(x["words"].combine_chunks(), "\n"), y["terms"].combine_chunks()
    length, coded = pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode()
    asked = pc.index_in(terms.flatten(), value_set=coded.dictionary).fill_null(-1).to_numpy()  # a code, or -1 for a term that no chunk here has
    first, gain = np.cumsum([0, *pc.list_value_length(terms).to_pylist()]), y["weights"].combine_chunks().flatten().to_numpy()
    needed = np.zeros(len(coded.dictionary) + 1, bool)
    needed[asked] = True
    code = coded.indices.to_numpy()
    held = np.flatnonzero(needed[code])
    key, tf = np.unique(code[held].astype(np.int64) * n + np.repeat(np.arange(n, dtype=np.int32), length)[held], return_counts=True)
    at, low = key % n, np.searchsorted(key, np.arange(len(coded.dictionary) + 1) * n)
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[at] / y["avgdl"][0].as_py()))
    test = BlockFilter(x) if own else None
    who, which, scores = [], [], []
    for q, wanted in enumerate(y["filters"].to_pylist() if own else [None] * y.num_rows):
        score, hit = np.zeros(n), np.zeros(n, bool)
        for i in range(first[q], first[q + 1]):
            if asked[i] >= 0:
                part = slice(low[asked[i]], low[asked[i] + 1])
                score[at[part]] += gain[i] * weight[part]  # a chunk has a term once
                hit[at[part]] = True
        if wanted is not None and test is not None:
            hit &= test.passing(wanted)
        rows = np.flatnonzero(hit)
        if len(rows) > k:
            least = np.round(-np.partition(-score[rows], k - 1)[k - 1], DIGITS)
            rows = rows[np.round(score[rows], DIGITS) >= least]
        who.append(np.full(len(rows), q))
        which.append(rows)
        scores.append(score[rows])
    rows = pa.array(np.concatenate(which))
    columns = [y["query_id"].take(pa.array(np.concatenate(who))), x["chunk_id"].take(rows), pa.chunked_array([np.concatenate(scores)]), *[x[t].take(rows) for t in ties]]
    return pa.Table.from_arrays(columns, schema=schema)


class BlockFilter:
    """Filters of single queries over the chunks of a block; the rule is that of ``functions.filters.matches``."""

    def __init__(self, x: pa.Table) -> None:
        self.documents = np.array(x["document_id"].to_pylist(), object)
        self.paths = [None if p is None else tuple(p) for p in x["heading_path"].to_pylist()]
        self.first, self.last = (np.array([np.nan if v is None else v for v in x[c].to_pylist()], float) for c in ("page_start", "page_end"))

    def passing(self, f: dict) -> np.ndarray:
        ok = np.ones(len(self.paths), bool)
        if f["document_ids"] is not None:
            ok &= np.isin(self.documents, [d for d in f["document_ids"] if d is not None])
        if f["heading_prefix"] is not None:
            want = tuple(f["heading_prefix"])
            ok &= np.array([p is not None and p[: len(want)] == want for p in self.paths], bool)
        with np.errstate(invalid="ignore"):
            if f["page_start"] is not None:
                ok &= self.last >= f["page_start"]
            if f["page_end"] is not None:
                ok &= self.first <= f["page_end"]
        return ok


def candidate_counts(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, candidate_count): chunks that pass each query's filters. Cases with documents or a heading prefix are
    joined by it; page ranges alone meet the chunks' counts by pages, of which there are few."""
    n = chunks.agg(F.count("*").alias("n"))
    f = queries.select("query_id", "filters").withColumn("kind", F.when(F.col("filters").isNull(), "all").when(F.col("filters.document_ids").isNotNull(), "document").when(F.size("filters.heading_prefix") > 0, "heading").when(F.coalesce("filters.page_start", "filters.page_end").isNotNull(), "pages").otherwise("all"))
    facts = chunks.select("document_id", "heading_path", "page_start", "page_end")
    test = matches(F.col("filters"), F.col("document_id"), F.col("heading_path"), F.col("page_start"), F.col("page_end"))
    by_document = f.where("kind = 'document'").withColumn("document_id", F.explode(F.array_distinct("filters.document_ids"))).join(facts, "document_id").where(test)
    head = facts.withColumn("__head", F.try_element_at("heading_path", F.lit(1)))
    by_heading = f.where("kind = 'heading'").withColumn("__head", F.col("filters.heading_prefix")[0]).join(head, "__head").where(test)
    pages = facts.groupBy("page_start", "page_end").agg(F.count("*").alias("c"))
    overlap = F.coalesce(F.col("page_end") >= F.col("filters.page_start"), F.lit(True)) & F.coalesce(F.col("page_start") <= F.col("filters.page_end"), F.lit(True))
    by_page = f.where("kind = 'pages'").join(pages, overlap).groupBy("query_id").agg(F.sum("c").alias("candidate_count"))  # page ranges, not chunks
    some = by_document.select("query_id").unionByName(by_heading.select("query_id")).groupBy("query_id").agg(F.count("*").alias("candidate_count")).unionByName(by_page)
    out = f.join(some, "query_id", "left").join(F.broadcast(n))
    return out.select("query_id", F.when(F.col("kind") == "all", F.col("n")).otherwise(F.coalesce("candidate_count", F.lit(0))).alias("candidate_count"))
