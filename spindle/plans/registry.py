"""Registered search queries, each with its DuckDB SQL, over the whole sample tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as T
from ..operators import analysis, maintenance, rerank, scoring, typo
from ..operators import index as ix
from ..operators.config import EngineConfig, Settings
from ..operators.tables import dealt, shared_folder
from ..sources import catalog
from ..sources.store import Store
from ..streaming import sync
from . import sql
from .engine import SearchEngine, like_baseline

AS_OF = 1_009_843_200  # 2002-01-01, after the last shipping date
PART_QUERIES = [(1, "red widget"), (2, "small bolt 17"), (3, "hot the gear"), (4, "promo ring"), (5, "brand 2"), (6, "widget widget"), (7, "large economy plate"), (8, ""), (9, "zzz qqq"), (10, "Blue ROD Brand#12")]
TYPO_QUERIES = [(1, "red wigdet"), (2, "smal blot"), (3, "hott gera"), (4, "brnd 17"), (5, "gizmoo ring"), (6, "red widget"), (7, "xq99 ring"), (8, "prmo ringg")]
POOL_QUERIES = [(1, "brand red ring"), (2, "brand small bolt")]
CORPUS_QUERIES = [(1, "the idiot"), (2, "apache license"), (3, "qui eaux"), (4, "les és de"), (5, "für die"), (6, "MIT 2.0")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _asked(spark: SparkSession, queries: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(queries, "query_id long, q string").coalesce(1)


def _parts(spark: SparkSession, sf_dir: str) -> ix.Index:
    """The index of parts, written before it is searched, as a published one is."""
    return ix.build(catalog.parts(spark, sf_dir)).checkpointed()


def _tokens(frame: DataFrame, key: str, text: Column) -> DataFrame:
    return analysis.exploded(frame.select(key, analysis.tokens(text).alias("tokens")), "tokens", key).select(key, "p.*")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search over the part catalogue with the shipped re-ranking."""
    attributes = catalog.part_attributes(spark, sf_dir)
    engine = SearchEngine(_parts(spark, sf_dir), reranker=rerank.shipped(attributes, attributes, AS_OF))
    return engine.query(_asked(spark, PART_QUERIES), 20)


def tokenize_documents(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.surfaces(F.col("text"))).alias("pos", "surface"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "surface")


def classify_tokens(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("lang", F.explode(T.surfaces(F.col("text"))).alias("s"))
    return rows.groupBy("lang", T.classify(F.col("s")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def fold_terms(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.explode(T.surfaces(F.col("text"))).alias("s")).distinct().where(F.col("s").rlike(r"[^\x00-\x7F]"))
    return rows.select(F.lower("s").alias("lower"), T.fold_vietnamese(F.col("s")).alias("vi"), T.fold_latin(F.col("s")).alias("latin")).distinct()


def stopword_share(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.surfaces(F.col("text")).alias("words"))
    listed = F.filter("words", lambda w: analysis.listed(w, analysis.AnalyzerConfig()))
    counts = rows.select("doc_id", F.size("words").cast("long").alias("n"), F.size(listed).cast("long").alias("k")).where(F.col("n") > 0)
    return counts.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("k").alias("n_stopwords"))


def code_variants_part(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.concat(F.lit("HS"), F.col("p_partkey"), F.lit("-kx")), "p_brand", F.concat("p_size", F.lit("mm"))).alias("code"))
    # Few bytes make many rows: dealt first, or one task would make those of a whole row group.
    words = dealt(part, "p_partkey").select("p_partkey", F.posexplode_outer(T.surfaces(F.col("code"))).alias("pos", "word")).where("word IS NOT NULL")
    made = F.filter(analysis.variants(F.col("t"), "index", analysis.AnalyzerConfig()), lambda v: v["field"] == "code")
    rows = analysis.exploded(words.withColumn("t", analysis.word_token(F.col("word"))).withColumn("made", made), "made", "p_partkey", "pos")
    return rows.select("p_partkey", F.col("pos").cast("long").alias("pos"), "p.term", "p.kind")


def phrase_bigrams(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(T.surfaces(F.col("text")).alias("words"))
    found = analysis.exploded(rows.select(analysis.pairs(F.col("words"), analysis.AnalyzerConfig()).alias("pairs")), "pairs")
    return found.groupBy(analysis.pair_term(F.col("p")).alias("term")).agg(F.count(F.lit(1)).alias("n"))


def analyze_queries(spark, sf_dir):
    rows = scoring.query_terms(_asked(spark, CORPUS_QUERIES + [(11, "máy của gỗ"), (12, "the of"), (13, "là hs76 đ10mm")]))
    return rows.select("query_id", F.col("pos").cast("long").alias("pos"), "term")


def postings_part(spark, sf_dir):
    return ix.build(catalog.parts(spark, sf_dir)).postings.select("doc_id", "term", "zone", "kw", "tf")


def postings_documents(spark, sf_dir):
    """Postings of the whole corpus, summed up by term."""
    index = ix.build(catalog.corpus(spark, sf_dir))
    return index.postings.groupBy("zone", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), F.max("kw").alias("kw"))


def zone_lengths_part(spark, sf_dir):
    return ix.build(catalog.parts(spark, sf_dir)).doc_zones.select("doc_id", "zone", "len")


def corpus_stats(spark, sf_dir):
    return SearchEngine(ix.build(catalog.corpus(spark, sf_dir))).stats().select("zone", F.round("avg_len", 6).alias("avg_len"), "doc_count")


def term_df(spark, sf_dir):
    return _parts(spark, sf_dir).df_for_terms(scoring.query_terms(_asked(spark, PART_QUERIES)))


def vocabulary_prefix(spark, sf_dir):
    index = ix.build(catalog.corpus(spark, sf_dir))
    return index.vocabulary(["a", "e", "t", "é"], 50).select("first", "term", "df", F.col("place").cast("int").alias("place"))


def _query(queries, every_word=True, corpus=False, limit=20):
    def run(spark, sf_dir):
        terms = scoring.query_terms(_asked(spark, queries))
        index = ix.build(catalog.corpus(spark, sf_dir)).for_batch(terms) if corpus else _parts(spark, sf_dir)
        return scoring.cut(scoring.score(index, terms, every_word=every_word), limit)

    return run


def _reranked(make, limit=50):
    """A search whose scores go through a re-ranker made of the parts' attributes."""

    def run(spark, sf_dir):
        attributes = catalog.part_attributes(spark, sf_dir)
        engine = SearchEngine(_parts(spark, sf_dir), reranker=make(attributes))
        return engine.query(_asked(spark, PART_QUERIES), limit)

    return run


def typo_corrections(spark, sf_dir):
    found = typo.corrections(_parts(spark, sf_dir), scoring.query_terms(_asked(spark, TYPO_QUERIES)), EngineConfig(typo_vocab_cap=4_000))
    return found.select("query_id", F.col("pos").cast("long").alias("pos"), "word", "term", "distance", "applied")


def did_you_mean(spark, sf_dir):
    return SearchEngine(_parts(spark, sf_dir)).did_you_mean(_asked(spark, TYPO_QUERIES))


def typo_search(spark, sf_dir):
    return SearchEngine(_parts(spark, sf_dir)).query(_asked(spark, TYPO_QUERIES), 20)


def edit_distances(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("a")).distinct()
    pairs = part.crossJoin(part.withColumnRenamed("a", "b"))  # every word with every word, as the SQL has it
    d = D.osa(F.col("a"), F.col("b"), 1)
    return pairs.select("a", "b", d.alias("distance"), D.is_code_like(F.col("a")).alias("code_like"), D.is_plausible(F.col("a"), F.col("b")).alias("plausible"))


def rest_search(spark, sf_dir):
    attributes = catalog.part_attributes(spark, sf_dir).withColumn("url", F.concat(F.lit("/p/"), F.col("doc_id")))
    shown = SearchEngine(_parts(spark, sf_dir)).rest_search(_asked(spark, TYPO_QUERIES), attributes, 99)
    return shown.select("query_id", "q", "did_you_mean", "rank", "doc_id", "title", "url", "score")


def site_search(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_retailprice")
    return SearchEngine(_parts(spark, sf_dir)).site_search(_asked(spark, PART_QUERIES), rows)


def catalog_docs(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    posts = part.select(
        F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 5 == 0, "post").otherwise("product").alias("post_type"), F.col("p_name").alias("title"), F.concat(F.lit("<p>A "), "p_type", F.lit(" <b>part</b></p><script>x()</script>")).alias("content"),
        F.lit(" see more").alias("excerpt"), F.when(F.col("p_size") % 3 == 0, "https://x.org/a").otherwise(F.col("p_brand")).alias("sku_v2"), F.concat(F.lit(" "), "p_brand").alias("sku"), F.array("p_type").alias("categories"),
    )
    return catalog.from_posts(posts).select("doc_id", F.explode("fields").alias("f")).select("doc_id", "f.zone", "f.text")


def strip_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(catalog.strip_tags(F.col("html"))).alias("text_md5"))


def candidate_scan(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    posts = part.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") > 40, "draft").otherwise("publish").alias("status"), F.when(F.col("p_size") % 2 == 0, "product").otherwise("note").alias("post_type"))
    return catalog.candidates(posts, ("product", "post"), limit=100, offset=50).select("doc_id")


def timestamps(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    created = F.when(F.col("o_orderkey") % 7 == 0, "0000-00-00 00:00:00").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return catalog.timestamps(orders.select(F.col("o_orderkey").alias("doc_id"), created.alias("created_gmt")))


def like_search(spark, sf_dir):
    return like_baseline(catalog.part_attributes(spark, sf_dir), _asked(spark, PART_QUERIES)).select("query_id", "doc_id", "rank")


def _halves(spark, sf_dir):
    docs = catalog.parts(spark, sf_dir)
    return ix.build(docs.where("doc_id % 3 <> 0")), docs.where("doc_id % 5 <> 0")


def reconcile_orphans(spark, sf_dir):
    return maintenance.orphans(*_halves(spark, sf_dir))


def reconcile_missing(spark, sf_dir):
    return maintenance.missing(*_halves(spark, sf_dir))


def reconciled_postings(spark, sf_dir):
    return maintenance.reconcile(*_halves(spark, sf_dir)).postings.select("doc_id", "term", "zone", "kw", "tf")


def zone_status(spark, sf_dir):
    index = ix.build(catalog.parts(spark, sf_dir).withColumn("fields", F.filter("fields", lambda f: f["zone"] != "attr")))
    return maintenance.zone_status(index, catalog.parts(spark, sf_dir), catalog.parts(spark, sf_dir))


def upsert_equals_rebuild(spark, sf_dir):
    """Postings after a stale version of some documents is replaced and some are deleted."""
    docs = catalog.parts(spark, sf_dir)
    stale = docs.withColumn("fields", F.when(F.col("doc_id") % 4 == 0, F.slice("fields", 1, 1)).otherwise(F.col("fields")))
    index = ix.build(stale).upsert(docs.where("doc_id % 4 = 0")).without(docs.where("doc_id % 9 = 0"))
    return index.postings.select("doc_id", "term", "zone", "kw", "tf")


def _folder(spark: SparkSession) -> str:
    """A new folder for a store, under the shared one."""
    return f"{shared_folder(spark)}/{uuid4().hex}"


def _pooled(make, limit=700):
    """All matches of any word, more than the pool holds, through a re-ranker; ranks on both sides of the pool's end."""

    def run(spark, sf_dir):
        asked = _asked(spark, POOL_QUERIES)
        scores = scoring.score(_parts(spark, sf_dir), scoring.query_terms(asked), every_word=False)
        return scoring.cut(make(catalog.part_attributes(spark, sf_dir))(scores, asked.withColumnRenamed("q", "effective")), limit)

    return run


def typo_gate_off(spark, sf_dir):
    """No suggestions for an index with more documents than the gate lets through."""
    return SearchEngine(_parts(spark, sf_dir), EngineConfig(typo_max_docs=10)).did_you_mean(_asked(spark, TYPO_QUERIES))


def typo_rerank_chain(spark, sf_dir):
    """Corrected queries through the shipped chain: titles are matched with the corrected words."""
    attributes = catalog.part_attributes(spark, sf_dir)
    return SearchEngine(_parts(spark, sf_dir), reranker=rerank.shipped(attributes, attributes, AS_OF)).query(_asked(spark, TYPO_QUERIES), 20)


def bm25f_weights(spark, sf_dir):
    """A search with weights, k1 and b of its own."""
    config = EngineConfig(zone_weights={"title": 2.0, "attr": 5.0}, k1=0.9, b=0.4)
    return scoring.cut(scoring.score(_parts(spark, sf_dir), scoring.query_terms(_asked(spark, PART_QUERIES)), config), 20)


def packs_without_stopwords(spark, sf_dir):
    """Terms of the documents where only the code and generic packs are in use: no word is a stopword."""
    config = analysis.AnalyzerConfig((analysis.code_pack(), analysis.generic_pack()), bigrams=False)
    rows = analysis.exploded(_table(spark, sf_dir, "documents").select(T.surfaces(F.col("text")).alias("words")), "words")
    counted = rows.groupBy(F.col("p").alias("word")).agg(F.count(F.lit(1)).alias("n"))  # a word's terms are the same wherever it stands
    made = counted.withColumn("t", analysis.word_token(F.col("word"))).withColumn("made", analysis.variants(F.col("t"), "query", config))
    return analysis.exploded(made, "made", "n").where("p.field = 'text'").groupBy(F.col("p.term").alias("term")).agg(F.sum("n").alias("n"))


def pack_with_stopwords(spark, sf_dir):
    """Tokens of part names that a pack of its own calls stopwords."""
    own = analysis.Pack("colours", 15, ("WORD_LATIN",), "colours-1", lambda t, _: analysis._no_variants(), ("red", "blue", "the"), makes=False)
    config = analysis.AnalyzerConfig((own, analysis.generic_pack()))
    rows = analysis.exploded(_table(spark, sf_dir, "part").select("p_partkey", analysis.tokens(F.col("p_name"), config).alias("tokens")), "tokens", "p_partkey")
    return rows.groupBy("p_partkey").agg(F.sum(F.col("p.is_stopword").cast("long")).alias("n_stopwords"))


def _changes(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("doc_id"), F.unix_timestamp("ts").alias("ts"), "event_type", "event_id")


def captured_changes(spark, sf_dir):
    """Events that enter the queue: purchases stand for stock changes, the rest counts for some types and no revisions."""
    kind = F.when(F.col("event_type") == "purchase", "stock").otherwise("save")
    events = _changes(spark, sf_dir).select("doc_id", kind.alias("kind"), F.when(F.col("event_id") % 3 == 0, "note").otherwise("product").alias("post_type"), (F.col("event_id") % 4 == 0).alias("is_revision"))
    return sync.captured(events, ("product", "post")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def drain_oldest(spark, sf_dir):
    """The 50 ids that wait longest: a report by rank, as a drain with a limit takes them."""
    return sync.oldest(_changes(spark, sf_dir), 50)


def backlog(spark, sf_dir):
    pending = sync.pending(_changes(spark, sf_dir))
    row = (pending, maintenance.is_stalled(pending, AS_OF - 601, AS_OF), maintenance.is_stalled(pending, AS_OF - 600, AS_OF), maintenance.is_stalled(0, 0, AS_OF))
    return spark.createDataFrame([row], "pending long, stalled boolean, in_time boolean, nothing_waits boolean")


def index_status(spark, sf_dir):
    """The status record of a store: published twice, flushed, and published again without a third of the parts."""
    store, docs = Store(spark, _folder(spark)), catalog.parts(spark, sf_dir)
    few = ix.build(docs.where("doc_id % 3 <> 0")).checkpointed()
    out = [store.status(docs).withColumn("step", F.lit("new"))]
    store.publish(few, built_at=7)
    out.append(store.status(docs).withColumn("step", F.lit("published")))
    store.flush()
    out.append(store.status(docs).withColumn("step", F.lit("flushed")))
    store.publish(few, analysis.AnalyzerConfig(bigrams=False), built_at=8)
    store.expire(keep=1)
    out.append(store.status(docs).withColumn("step", F.lit("other analyzer")))
    store.drop()
    out.append(store.status(docs).withColumn("step", F.lit("dropped")))
    return reduce(DataFrame.unionByName, out).select("step", "version", "built_at", "stale", "active", "docs", "source_docs")


def settings_chain(spark, sf_dir):
    """The shipped chain as sanitized settings have it: dates of the last change, strong, a half-life of 30 days."""
    settings = Settings.sanitized({"enabled": "1", "recency_mode": "strong", "recency_basis": "modified", "recency_halflife": "30"})
    attributes = catalog.part_attributes(spark, sf_dir, "modified")
    posts = attributes.select("doc_id", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss").alias("modified_gmt"))
    return SearchEngine(_parts(spark, sf_dir), reranker=rerank.of_settings(settings, attributes, posts, AS_OF)).query(_asked(spark, PART_QUERIES), 50)


def stream_sync_final(spark, sf_dir):
    """Index after the change feed drained: every fifth user of the events is a changed part, every tenth part is gone."""
    where = _folder(spark)
    docs = catalog.parts(spark, sf_dir)
    store = Store(spark, f"{where}/index")
    store.publish(ix.build(docs.withColumn("fields", F.slice("fields", 1, 1))).checkpointed())
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("doc_id"))
    events.repartition(4, "doc_id").write.parquet(f"{where}/changes")  # each batch writes the index anew: as many however many events there are
    feed = spark.readStream.schema("doc_id long").option("maxFilesPerTrigger", 1).parquet(f"{where}/changes")
    sync.start(feed, store, lambda: docs.where("doc_id % 10 <> 0"), f"{where}/progress", lambda: AS_OF).awaitTermination()
    return store.load().postings.select("doc_id", "term", "zone", "kw", "tf")


def analyzer_hash(spark, sf_dir):
    return spark.createDataFrame([(analysis.AnalyzerConfig().hash(), analysis.AnalyzerConfig(bigrams=False).hash() != analysis.AnalyzerConfig().hash())], "hash string, changes boolean")


_ATTRS = "attrs AS (SELECT p_partkey AS doc_id, p_name AS title, epoch(ts)::BIGINT AS ts FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, min(l_shipdate) AS ts FROM lineitem GROUP BY 1) USING (p_partkey))"
_PART_IDS, _DOC_IDS = "SELECT p_partkey AS doc_id FROM part", "SELECT doc_id FROM documents"


def _searched(queries, every_word=True, corpus=False, limit=20) -> str:
    return f"WITH {sql.index(sql.CORPUS, _DOC_IDS) if corpus else sql.index(sql.PARTS, _PART_IDS)}, {sql.queried(queries)}, {sql.scored(every_word)} {sql.cut('sc', limit)}"


def _reranked_sql(passes: str, last: str, limit: int = 50) -> str:
    return f"WITH {sql.index(sql.PARTS, _PART_IDS)}, {sql.queried(PART_QUERIES)}, {sql.scored()}, {_ATTRS}, {passes} {sql.cut(last, limit)}"


def _of_parts(condition: str) -> str:
    """Fields of the parts that meet a condition on doc_id."""
    return f"SELECT * FROM ({sql.PARTS}) WHERE {condition}"


def _postings_sql(fields: str) -> str:
    return f"WITH {sql.index(fields, _PART_IDS)} SELECT doc_id, term, zone, kw, tf FROM idx"


_Modes = ("light", "medium", "strong", "date")
_SEARCHES = {
    "bm25f_or": dict(queries=PART_QUERIES, every_word=False),
    "bm25f_and": dict(queries=PART_QUERIES),
    "search_batch": dict(queries=CORPUS_QUERIES, corpus=True),
    "suggest_prefix": dict(queries=[(1, "br"), (2, "1"), (3, "17"), (4, "wid"), (5, "brand 17")], limit=10),
    "repeat_word_query": dict(queries=[(1, "red"), (2, "red red"), (3, "red red ring ring")]),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        tokenize_documents, classify_tokens, fold_terms, stopword_share, code_variants_part, phrase_bigrams, analyze_queries, postings_part, postings_documents, zone_lengths_part, corpus_stats, term_df, vocabulary_prefix,
        typo_corrections, did_you_mean, typo_search, edit_distances, rest_search, site_search, catalog_docs, strip_pages, candidate_scan, timestamps, like_search, reconcile_orphans, reconcile_missing, reconciled_postings,
        zone_status, upsert_equals_rebuild, stream_sync_final, analyzer_hash, typo_gate_off, typo_rerank_chain, bm25f_weights, packs_without_stopwords, pack_with_stopwords, captured_changes, drain_oldest, backlog,
        index_status, settings_chain,
    )
    out = {"search_flagship": flagship} | {f.__name__: f for f in plain} | {name: _query(**o) for name, o in _SEARCHES.items()}
    out |= {f"recency_{m}": _reranked(lambda a, m=m: rerank.Recency(a, AS_OF, m)) for m in _Modes}
    out["recency_off"] = _reranked(lambda a: rerank.Recency(a, AS_OF, "off"))
    out["exact_title_tiers"] = _reranked(lambda a: rerank.ExactTitle(a))
    out |= {f"pool_tail_recency_{m}": _pooled(lambda a, m=m: rerank.Recency(a, AS_OF, m)) for m in ("medium", "date")}
    out["pool_tail_exact"] = _pooled(lambda a: rerank.ExactTitle(a))
    out["rerank_chain"] = _reranked(lambda a: rerank.shipped(a, a, AS_OF), 600)
    return out


def oracle_sql() -> dict[str, str]:
    docs = lambda columns: f"WITH {sql.tokens('t', 'documents', 'text', columns)}"
    parts = f"WITH {sql.index(sql.PARTS, _PART_IDS)}"
    typos = f"{parts}, {sql.queried(TYPO_QUERIES)}, {sql.typos()}"
    changed = "SELECT user_id AS doc_id FROM events"
    out = {
        "tokenize_documents": f"{docs('doc_id')} SELECT doc_id, pos::BIGINT AS pos, s AS surface FROM t0",
        "classify_tokens": f"{docs('doc_id, lang')} SELECT lang, class, count(*) AS n FROM t GROUP BY ALL",
        "fold_terms": rf"{docs('doc_id')} SELECT DISTINCT lower, vi, latin FROM t WHERE regexp_matches(s, '[^\x00-\x7F]')",
        "stopword_share": f"{docs('doc_id')} SELECT doc_id, count(*) AS n_tokens, sum(stop::INTEGER)::BIGINT AS n_stopwords FROM t GROUP BY ALL",
        "code_variants_part": f"""WITH c AS (SELECT p_partkey, 'HS' || p_partkey || '-kx ' || p_brand || ' ' || p_size || 'mm' AS code FROM part), {sql.tokens('t', 'c', 'code', 'p_partkey')}, {sql.postings('p', 't', 'p_partkey', 'index')}
          SELECT p_partkey, pos::BIGINT AS pos, term, kind FROM p WHERE field = 'code'""",
        "phrase_bigrams": f"{docs('doc_id')}, {sql.postings('p', 't', 'doc_id', 'query')} SELECT term, count(*) AS n FROM p WHERE field = 'phrase' GROUP BY ALL",
        "analyze_queries": f"WITH {sql.queried(CORPUS_QUERIES + [(11, 'máy của gỗ'), (12, 'the of'), (13, 'là hs76 đ10mm')])} SELECT query_id, pos::BIGINT AS pos, term FROM qp",
        "postings_part": _postings_sql(sql.PARTS),
        "postings_documents": f"WITH {sql.index(sql.CORPUS, _DOC_IDS)} SELECT zone, term, count(*) AS df, sum(tf)::BIGINT AS tf, max(kw) AS kw FROM idx GROUP BY ALL",
        "zone_lengths_part": f"{parts} SELECT doc_id, zone, len FROM zl",
        "corpus_stats": f"WITH {sql.index(sql.CORPUS, _DOC_IDS)} SELECT zone, round(avg_len, 6) AS avg_len, n AS doc_count FROM az, nd",
        "term_df": f"{parts}, {sql.queried(PART_QUERIES)} SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT DISTINCT term FROM qp) LEFT JOIN idx USING (term) GROUP BY term",
        "vocabulary_prefix": f"""WITH {sql.index(sql.CORPUS, _DOC_IDS)} SELECT left(term, 1) AS first, term, df, (row_number() OVER (PARTITION BY left(term, 1) ORDER BY df DESC, term))::INTEGER AS place
          FROM (SELECT term, count(DISTINCT doc_id) AS df FROM idx GROUP BY term) WHERE df >= 2 AND left(term, 1) IN ('a', 'e', 't', 'é') QUALIFY place <= 50""",
        "typo_corrections": f"{parts}, {sql.queried(TYPO_QUERIES)}, {sql.typos(4_000)} SELECT query_id, pos::BIGINT AS pos, word, term, distance, applied FROM fix",
        "did_you_mean": f"{typos} SELECT query_id, did_you_mean FROM said",
        "typo_search": f"{typos}, {sql.scored(terms='qx')} {sql.cut('sc', 20)}",
        "edit_distances": """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS a FROM part) SELECT w.a, v.a AS b, least(damerau_levenshtein(w.a, v.a), 2)::INTEGER AS distance,
          regexp_matches(w.a, '[0-9]') OR NOT regexp_matches(w.a, '[aeiouy]') AS code_like, abs(length(w.a) - length(v.a)) <= 1 AS plausible FROM w, w v""",
        "rest_search": f"{typos}, {sql.scored(terms='qx')} SELECT query_id, q, did_you_mean, rank::INTEGER AS rank, doc_id, p_name AS title, '/p/' || doc_id AS url, round(score, 4) AS score FROM qs JOIN said USING (query_id) LEFT JOIN (SELECT * FROM sc WHERE rank <= 50) USING (query_id) LEFT JOIN part ON p_partkey = doc_id",
        "site_search": f"{parts}, {sql.queried(PART_QUERIES)}, {sql.scored()} SELECT query_id, doc_id, rank::INTEGER AS rank, p_retailprice FROM sc JOIN part ON p_partkey = doc_id WHERE rank <= 500",
        "catalog_docs": """SELECT doc_id, zone, text FROM (
            SELECT p_partkey AS doc_id, 'title' AS zone, p_name AS text FROM part UNION ALL SELECT p_partkey, 'content', 'A ' || p_type || ' part  see more' FROM part
            UNION ALL SELECT p_partkey, 'sku', p_brand FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, 'attr', p_type FROM part WHERE p_size % 5 <> 0) WHERE text <> ''""",
        "strip_pages": """SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g'))) AS text_md5 FROM pages""",
        "candidate_scan": "SELECT p_partkey AS doc_id FROM part WHERE p_size <= 40 AND p_size % 2 = 0 ORDER BY 1 LIMIT 100 OFFSET 50",
        "timestamps": "SELECT o_orderkey AS doc_id, epoch(o_orderdate::TIMESTAMP)::BIGINT AS ts FROM orders WHERE o_orderkey % 7 <> 0 AND epoch(o_orderdate::TIMESTAMP) > 0",
        "like_search": f"""WITH {_ATTRS}, qs AS ({sql.values(PART_QUERIES)}), w AS (SELECT query_id, list_filter(string_split(lower(q), ' '), lambda x: x <> '') AS ws FROM qs)
          SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY ts DESC NULLS LAST, doc_id))::INTEGER AS rank FROM attrs, w
          WHERE len(ws) > 0 AND len(list_filter(ws, lambda x: NOT contains(lower(title), x))) = 0 QUALIFY rank <= 500""",
        "reconcile_orphans": "SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 = 0",
        "reconcile_missing": "SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0",
        "reconciled_postings": _postings_sql(_of_parts("doc_id % 5 <> 0")),
        "zone_status": f"{parts} SELECT doc_id, zone, true AS in_source, zone <> 'attr' AND (zone <> 'code' OR bool_or(src_code)) AS in_index FROM (SELECT doc_id, zone, true AS src_code FROM zl) GROUP BY doc_id, zone",
        "upsert_equals_rebuild": _postings_sql(_of_parts("doc_id % 9 <> 0")),
        "stream_sync_final": _postings_sql(f"SELECT * FROM ({sql.PARTS}) WHERE CASE WHEN doc_id IN ({changed}) THEN doc_id % 10 <> 0 ELSE src = 'title' END"),
        "analyzer_hash": """SELECT substr(sha256('{"packs":["code@10#code-2:minPrefix=2","vi@20#vi-1:fold-1:sw50","en@30#en-1:stem=0","generic@90#generic-1:fold-1"],"tokenizer":"tok-1","folder":"fold-1","options":{"bigrams":true}}'), 1, 16) AS hash, true AS changes""",
    }
    out |= {name: _searched(**o) for name, o in _SEARCHES.items()}
    out |= {f"recency_{m}": _reranked_sql(sql.recency("sc", "rc", m, AS_OF), "rc") for m in _Modes}
    out["recency_off"] = _reranked_sql("x AS (SELECT 1)", "sc")
    out["exact_title_tiers"] = _reranked_sql(sql.exact("sc", "ex"), "ex")
    pooled = lambda passes, last: f"WITH {sql.index(sql.PARTS, _PART_IDS)}, {sql.queried(POOL_QUERIES)}, {sql.scored(False)}, {_ATTRS}, {passes} {sql.cut(last, 700)}"
    out |= {f"pool_tail_recency_{m}": pooled(sql.recency("sc", "rc", m, AS_OF), "rc") for m in ("medium", "date")}
    out["pool_tail_exact"] = pooled(sql.exact("sc", "ex"), "ex")
    out["typo_gate_off"] = f"WITH qs AS ({sql.values(TYPO_QUERIES)}) SELECT query_id, NULL::VARCHAR AS did_you_mean FROM qs"
    # Titles are matched with the corrected words: the corrected queries take the place of the typed ones.
    effective = f"eq AS (SELECT query_id, CASE WHEN p IS NULL THEN q ELSE list_reduce(list_transform(p, lambda x: x.word || chr(1) || x.term), lambda s, x: replace(s, split_part(x, chr(1), 1), split_part(x, chr(1), 2)), lower(q)) END AS q FROM qs LEFT JOIN (SELECT query_id, list(struct_pack(word := word, term := term) ORDER BY pos) AS p FROM fix WHERE applied GROUP BY ALL) USING (query_id)), {sql.tokens('et', 'eq', 'q', 'query_id')}"
    out["typo_rerank_chain"] = f"{typos}, {sql.scored(terms='qx')}, {_ATTRS}, {effective}, {sql.recency('sc', 'rc', 'medium', AS_OF)}, {sql.exact('rc', 'ex').replace('FROM qt WHERE', 'FROM et WHERE')} {sql.cut('ex', 20)}"
    out["bm25f_weights"] = _searched(PART_QUERIES).replace("WHEN 'title' THEN 8.0", "WHEN 'title' THEN 2.0").replace("WHEN 'attr' THEN 3.0", "WHEN 'attr' THEN 5.0").replace("1 - 0.75 + 0.75 * len", "1 - 0.4 + 0.4 * len").replace("(1.2 + wtf)", "(0.9 + wtf)")
    out["packs_without_stopwords"] = f"{docs('doc_id')} SELECT term, count(*) AS n FROM (SELECT lower AS term FROM t UNION ALL SELECT latin FROM t WHERE latin <> '' AND latin <> lower) WHERE term <> '' GROUP BY ALL"
    out["pack_with_stopwords"] = "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: lower(w) IN ('red', 'blue', 'the')))::BIGINT AS n_stopwords FROM part"
    out["captured_changes"] = "SELECT user_id::BIGINT AS doc_id, count(*) AS n FROM events WHERE event_type = 'purchase' OR (event_id % 3 <> 0 AND event_id % 4 <> 0) GROUP BY ALL"
    out["drain_oldest"] = "SELECT user_id::BIGINT AS doc_id, min(floor(epoch(ts))::BIGINT) AS ts FROM events GROUP BY ALL ORDER BY 2, 1 LIMIT 50"
    out["backlog"] = "SELECT least(count(DISTINCT user_id), 5000) AS pending, true AS stalled, false AS in_time, false AS nothing_waits FROM events"
    rows = ("('new', NULL, NULL, false, false, 0)", "('published', 1, 7, false, true, 1)", "('flushed', 2, 0, false, false, 0)", "('other analyzer', 3, 8, true, true, 1)", "('dropped', NULL, NULL, false, false, 0)")
    out["index_status"] = f"SELECT step, version::BIGINT AS version, built_at::BIGINT AS built_at, stale, active, k * (SELECT count(*) FROM part WHERE p_partkey % 3 <> 0)::BIGINT AS docs, (SELECT count(*) FROM part)::BIGINT AS source_docs FROM (VALUES {', '.join(rows)}) AS s(step, version, built_at, stale, active, k)"
    last = _ATTRS.replace("min(l_shipdate)", "max(l_shipdate)")
    out["settings_chain"] = f"WITH {sql.index(sql.PARTS, _PART_IDS)}, {sql.queried(PART_QUERIES)}, {sql.scored()}, {last}, {sql.recency('sc', 'rc', 'strong', AS_OF, 30)}, {sql.exact('rc', 'ex')} {sql.cut('ex', 50)}"
    chained = f"{sql.recency('sc', 'rc', 'medium', AS_OF)}, {sql.exact('rc', 'ex')}"
    out["rerank_chain"] = _reranked_sql(chained, "ex", 600)
    out["search_flagship"] = _reranked_sql(chained, "ex", 20)
    return out
