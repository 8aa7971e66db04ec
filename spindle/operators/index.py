"""Index build and the index tables.

Four tables: postings (doc_id, term, zone, kw, tf, len), doc_zones (doc_id, zone, len), index_docs (doc_id) and meta. A posting
carries its document's zone length, so a query joins no table of the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import analysis
from .analysis import AnalyzerConfig, exploded
from .config import EngineConfig
from .tables import checkpointed, dealt


@dataclass
class Index:
    """The tables of an index as DataFrames; deletes and upserts give a new Index."""

    postings: DataFrame
    doc_zones: DataFrame
    index_docs: DataFrame

    def checkpointed(self) -> "Index":
        """The index with its tables written once, as a published one is; a query reads them several times.

        doc_zones comes from the postings that were written, not from another pass over the texts.
        """
        postings = checkpointed(self.postings)
        return Index(postings, checkpointed(zones_of(postings)), checkpointed(self.index_docs))

    def for_batch(self, terms: DataFrame) -> "Index":
        """The index as far as one batch of queries reads it, written once: the postings of its terms and the lengths of all zones."""
        return Index(checkpointed(self.postings_for_terms(terms)), checkpointed(self.doc_zones), checkpointed(self.index_docs))

    def without(self, ids: DataFrame) -> "Index":
        """The index without the documents of ids (column doc_id)."""
        gone = ids.select("doc_id").distinct()
        return Index(*(t.join(gone, "doc_id", "left_anti") for t in (self.postings, self.doc_zones, self.index_docs)))

    def union(self, other: "Index") -> "Index":
        return Index(*(a.unionByName(b) for a, b in zip((self.postings, self.doc_zones, self.index_docs), (other.postings, other.doc_zones, other.index_docs))))

    def upsert(self, docs: DataFrame, config: EngineConfig | None = None, analyzer: AnalyzerConfig | None = None) -> "Index":
        """The index with documents (doc_id, fields) in place of what it had of them."""
        return self.without(docs).union(build(docs, config, analyzer))

    def doc_count(self) -> int:
        return self.index_docs.count()

    def avg_zone_lengths(self) -> DataFrame:
        """zone, avg_len: summed lengths over all documents, those without the zone included."""
        n = self.index_docs.agg(F.count(F.lit(1)).alias("n"))
        return self.doc_zones.groupBy("zone").agg(F.sum("len").alias("total")).crossJoin(F.broadcast(n)).select("zone", (F.col("total") / F.col("n")).alias("avg_len"))  # n is one row

    def df_for_terms(self, terms: DataFrame) -> DataFrame:
        """term, df (0 for a missing one) of the distinct terms of a frame; the index side is one scan filtered by term."""
        asked = terms.select("term").distinct()
        found = self.postings.select("term", "doc_id").join(asked, "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        return asked.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("df"))

    def postings_for_terms(self, terms: DataFrame) -> DataFrame:
        return self.postings.join(terms.select("term").distinct(), "term", "left_semi")

    def zone_lengths_for_docs(self, ids: DataFrame) -> DataFrame:
        return self.doc_zones.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def document_frequencies(self) -> DataFrame:
        """term, df over all zones. (term, doc) pairs are counted before and after the shuffle, so a hot term is no hot task."""
        return self.postings.select("term", "doc_id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def named_frequencies(self, min_freq: int) -> DataFrame:
        """term, df, first (its first character) of the terms of at least min_freq documents."""
        return self.document_frequencies().withColumn("first", F.substring("term", 1, 1)).where(F.col("df") >= min_freq)

    def vocabulary(self, first_chars: Column | list[str], limit: int, min_freq: int = 2) -> DataFrame:
        """first, term, df, place of the `limit` most frequent terms by first character, ties by term; case counts."""
        named = self.named_frequencies(min_freq)
        named = named.where(F.col("first").isin(first_chars) if isinstance(first_chars, list) else first_chars)
        order = Window.partitionBy("first").orderBy(F.col("df").desc(), "term")
        return named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def zones_of(postings: DataFrame) -> DataFrame:
    """doc_id, zone, len: every zone with a length has a posting that carries it."""
    return postings.select("doc_id", "zone", "len").distinct()


def _entries(fields: Column, config: EngineConfig, analyzer: AnalyzerConfig) -> Column:
    """array<struct<zone, term, place, kw>>, one for each posting of an array of fields; a place is a field's number and a position.

    Text terms stay in the field's zone; code and phrase terms go to the zones of those names, shared by all fields.
    """

    def of_field(f: Column, i: Column) -> Column:
        def entry(p: Column) -> Column:
            place = F.shiftleft(i.cast("long"), 40) + p["pos"]
            return F.struct(F.when(p["field"] == "text", f["zone"]).otherwise(p["field"]).alias("zone"), p["term"].alias("term"), place.alias("place"), config.kind_weight(p["kind"]).alias("kw"))

        return F.transform(analysis.postings(analysis.tokens(f["text"], analyzer), "index", analyzer), entry)

    return F.flatten(F.transform(fields, of_field))


def _zone_counts(parsed: Column, analyzer: AnalyzerConfig) -> Column:
    """array<struct<zone, n>>: places with a term by zone, of fields (zone, words, content, pairs); a zone can come more than once."""
    total = lambda n: F.aggregate(F.transform(parsed, n), F.lit(0), lambda a, b: a + b)
    listed = lambda p: F.size(F.filter(p["words"], lambda w: ~analysis.listed(w, analyzer)))
    text = F.transform(parsed, lambda p: F.struct(p["zone"].alias("zone"), F.when(p["content"], listed(p)).otherwise(F.size(p["words"])).alias("n")))
    having = lambda f: total(lambda p: F.size(F.filter(p["words"], lambda w: analysis.makes(w, f, analyzer))))
    named = {f: having(f) for f in analyzer.fields() if f != "phrase"}
    if "phrase" in analyzer.fields():
        named["phrase"] = total(lambda p: F.size(p["pairs"])) + named.get("phrase", F.lit(0))
    return F.concat(text, *[F.array(F.struct(F.lit(f).alias("zone"), n.alias("n"))) for f, n in named.items()])


def _documents(docs: DataFrame, config: EngineConfig, analyzer: AnalyzerConfig) -> DataFrame:
    """A row for each document, all in one partition: doc_id, parsed (its fields' words), entries, zones and lens.

    A document of one row has its words in `parsed`. Where rows share an id, or a field's zone has the name of an analyzer's field, places can
    coincide: `entries` then has the postings, one for each place. So it has for packs that don't name their fields.
    """
    whole = dealt(docs.select("doc_id", F.col("fields").cast("array<struct<zone:string,text:string>>").alias("fields")), "doc_id").groupBy("doc_id").agg(F.collect_list("fields").alias("rows"))
    plain = (F.size("rows") == 1) & ~F.exists(F.get("rows", F.lit(0)), lambda f: f["zone"].isin(*analyzer.fields()))
    whole = whole.withColumn("plain", F.coalesce(plain, F.lit(False)) if analyzer.known() else F.lit(False))
    words = F.transform(F.get("rows", F.lit(0)), lambda f: F.struct(f["zone"].alias("zone"), T.surfaces(f["text"]).alias("words")))
    whole = whole.withColumn("worded", F.when(F.col("plain"), words))
    of_words = lambda p: F.struct(p["zone"].alias("zone"), p["words"].alias("words"), analysis.has_content(p["words"], analyzer).alias("content"), analysis.pairs(p["words"], analyzer).alias("pairs"))
    # Where a place has a term twice, by an accident of names, the higher weight counts: sorted, the last of a run.
    each = F.flatten(F.transform("rows", lambda r: _entries(r, config, analyzer)))
    whole = whole.select("doc_id", F.transform("worded", of_words).alias("parsed"), F.when(~F.col("plain"), F.sort_array(each)).alias("sorted"))
    steps = F.when(F.size("sorted") > 0, F.sequence(F.lit(0), F.size("sorted") - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get("sorted", i)
    same = lambda a, b: a["zone"].eqNullSafe(b["zone"]) & (a["term"] == b["term"]) & (a["place"] == b["place"])
    last = F.filter(steps, lambda i: (i == F.size("sorted") - 1) | ~same(at(i), at(i + 1)))
    whole = whole.select("doc_id", "parsed", F.when(F.col("sorted").isNotNull(), F.transform(last, at)).alias("entries"))
    places = lambda z: F.size(F.array_distinct(F.transform(F.filter("entries", lambda p: p["zone"] == z), lambda p: p["place"])))
    distinct = F.array_distinct(F.transform("entries", lambda p: p["zone"]))
    counts = F.when(F.col("parsed").isNotNull(), _zone_counts(F.col("parsed"), analyzer)).otherwise(F.transform(distinct, lambda z: F.struct(z.alias("zone"), places(z).alias("n"))))
    whole = whole.withColumn("counts", F.filter(counts, lambda c: c["n"] > 0))
    zones = F.array_distinct(F.transform("counts", lambda c: c["zone"]))
    length = lambda z: F.aggregate(F.filter("counts", lambda c: c["zone"] == z), F.lit(0), lambda a, c: a + c["n"])
    return whole.select("doc_id", "parsed", "entries", zones.alias("zones"), F.transform(zones, length).alias("lens"))


def build(docs: DataFrame, config: EngineConfig | None = None, analyzer: AnalyzerConfig | None = None) -> Index:
    """The index of documents (doc_id, fields). A document without any term still counts; rows that share an id are one document.

    The raw texts are dealt by doc_id once, in so many parts that what is made of one, some ten times its size, keeps in memory. Words are counted
    before they are analysed, since a text repeats them and its terms depend on no place. Every aggregate has doc_id in its keys and needs no
    shuffle more. Zone lengths are counted in the document's row.
    """
    config, analyzer = config or EngineConfig(), analyzer or AnalyzerConfig()
    whole = _documents(docs, config, analyzer)
    made = lambda src, content, word, kw: F.struct(src.alias("src"), content.alias("content"), word.alias("word"), kw.alias("kw"))
    none = F.lit(None).cast("double")
    of_field = lambda p: F.transform(F.concat(p["words"], p["pairs"]), lambda w: made(p["zone"], p["content"], w, none))
    words = F.when(F.col("parsed").isNotNull(), F.flatten(F.transform("parsed", of_field))).otherwise(F.transform("entries", lambda e: made(e["zone"], F.lit(False), e["term"], e["kw"])))
    length = lambda zone: F.get("lens", F.array_position("zones", zone).cast("int") - 1)
    fields = analyzer.fields()
    lens = {f: f"len_{i}" for i, f in enumerate(fields)}
    rows = exploded(whole.withColumn("all", words), "all", "doc_id", "zones", "lens").select("doc_id", "p.*", length(F.col("p.src")).alias("len"), *[length(F.lit(f)).alias(n) for f, n in lens.items()])
    counted = rows.groupBy("doc_id", "src", "content", "word", "kw").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("len", *lens.values())])
    # A word's terms; a phrase's; a posting that was made above stands for itself.
    one = lambda term, name, kind: F.array(F.struct(term.alias("term"), F.lit(name).alias("field"), F.lit(kind).alias("kind")))
    stop = F.col("content") & analyzer.is_stopword(F.col("t.lower"), F.col("t.class"))
    terms = F.filter(analysis.variants(F.col("t"), "index", analyzer), lambda v: ~((v["field"] == "text") & F.col("stop")))
    plain = analysis.is_plain(F.col("t"), analyzer)
    terms = F.when(plain & F.col("stop"), F.array().cast("array<struct<term:string,field:string,kind:string>>")).when(plain, one(F.col("t.lower"), "text", "lower")).otherwise(terms)
    made_of = F.when(F.col("kw").isNotNull(), one(F.col("word"), "text", "lower")).when(F.contains("word", F.lit(" ")), one(analysis.pair_term(F.col("word")), "phrase", "bigram")).otherwise(terms)
    told = counted.withColumn("t", analysis.word_token(F.col("word"))).withColumn("stop", stop).withColumn("made", made_of)
    kept = ("doc_id", "src", "kw", "n", "len", *lens.values())
    own = F.col("p.field") == "text"
    at = F.col("len")
    for f, n in lens.items():
        at = F.when(F.col("p.field") == f, F.col(n)).otherwise(at)
    each = exploded(told, "made", *kept).select("doc_id", F.when(own, F.col("src")).otherwise(F.col("p.field")).alias("zone"), "p.term", F.coalesce("kw", config.kind_weight(F.col("p.kind"))).alias("kw"), "n", at.alias("len"))
    postings = each.groupBy("doc_id", "zone", "term").agg(F.max("kw").alias("kw"), F.sum("n").cast("int").alias("tf"), F.first("len").alias("len"))
    zones = exploded(whole.select("doc_id", F.arrays_zip("zones", "lens").alias("z")), "z", "doc_id").select("doc_id", F.col("p.zones").alias("zone"), F.col("p.lens").alias("len"))
    return Index(postings.select("doc_id", "term", "zone", "kw", "tf", "len"), zones, docs.select("doc_id").distinct())
