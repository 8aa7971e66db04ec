"""The engine against known facts on small catalogues."""

import pytest
from pyspark.sql import functions as F

from spindle.functions import distance as D
from spindle.functions import text as T
from spindle.operators import analysis, maintenance, rerank, scoring
from spindle.operators import index as ix
from spindle.operators.config import EngineConfig, Settings
from spindle.plans.engine import SearchEngine
from spindle.sources import catalog
from spindle.sources.store import Store
from spindle.streaming import sync

CATALOGUE = [
    (1, "Xe đạp địa hình Trekko RX4420 24V", "RX4420", "phụ tùng xe leo núi dành người mới"), (2, "Bơm chân hai nòng Vigo", "BP310", "xe đạp gấp gọn và xe trẻ em"),
    (3, "Giỏ mây treo đầu", None, "giỏ đan chắc"), (4, "Gio lanh dem khuya", None, "nghi chan ben suoi"), (5, "Đèn hậu halo Lumo DH52", "DH52", "đèn nháy halo ba chế độ"),
    (6, "Khóa dây Trekko", None, None), (7, "Chuông đồng", None, None), (8, "Yên lò xo", None, None),
]
CODES = [
    (1, "BỘ LÍP HAI TẦNG ĐỆM KÉP – VT 3100QPRT/VT 3100QPPRT", None, None), (2, "BỘ LÍP ĐỆM ĐƠN – VT 27K", None, None),
    (3, "TRỤC GIỮA 3 VÒNG (VÒNG NGOÀI 6 BI XOAY 180) – PL 2436ZN", None, None), (4, "TRỤC SAU 3 ĐẦU 1500MM – VTRH 1500 3", None, None),
]


def documents(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, title string, sku string, content string")
    return frame.select("doc_id", catalog.fields(title=F.col("title"), sku=F.col("sku"), content=F.col("content")).alias("fields"))


def kept(index):
    """The index with its tables held in memory: tests search it again and again."""
    return ix.Index(*(t.cache() for t in (index.postings, index.doc_zones, index.index_docs)))


def found(engine, spark, *queries, limit=20):
    rows = engine.query(spark.createDataFrame([*enumerate(queries)], "query_id long, q string"), limit).collect()
    return [[r.doc_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == i] for i in range(len(queries))]


@pytest.fixture(scope="module")
def catalogue(spark):
    return SearchEngine(kept(ix.build(documents(spark, CATALOGUE))))


def test_classes_and_folds(spark):
    words = spark.createDataFrame([(x,) for x in ("giỏ", "gio", "RX4420", "24V", "1.5", "漢字", "m²", "5m²", "BT7K-Q", "được", "ươm", "biển", "ñandúç", "groß", "cœur")], "s string")
    got = {r.s: (r.c, r.v, r.l) for r in words.select("s", T.classify(F.col("s")).alias("c"), T.fold_vietnamese(F.col("s")).alias("v"), T.fold_latin(F.col("s")).alias("l")).collect()}
    assert [got[w][0] for w in ("giỏ", "gio", "RX4420", "24V", "1.5", "漢字", "m²", "5m²", "BT7K-Q")] == ["WORD_DIACRITIC", "WORD_LATIN", "ALNUM_CODE", "NUMERIC_UNIT", "NUMERIC_UNIT", "CJK", "WORD_DIACRITIC", "ALNUM_CODE", "ALNUM_CODE"]
    assert (got["được"][1], got["ươm"][1], got["biển"][1]) == ("duoc", "uom", "bien")
    assert got["ñandúç"][1:] == ("ñanduç", "nanduc") and got["groß"][2] == "gross" and got["cœur"][2] == "coeur"


def test_terms_of_a_code_and_of_stopwords(spark):
    texts = spark.createDataFrame([(1, "RX4420"), (2, "giỏ của mây"), (3, "the brass bell"), (4, "the of"), (5, None), (6, " – ")], "id long, text string")
    rows = analysis.exploded(analysis.analyze(texts, "text", "index"), "postings", "id").select("id", "p.*").collect()
    terms = lambda i, f: sorted((r.term, r.kind) for r in rows if r.id == i and r.field == f)
    assert terms(1, "code") == [("4420", "code_digits"), ("rx", "code_letters"), ("rx4", "code_prefix"), ("rx44", "code_prefix"), ("rx442", "code_prefix"), ("rx4420", "code_exact")]
    assert {t for t, _ in terms(2, "text")} == {"giỏ", "gio", "mây", "may"} and {t for t, _ in terms(2, "phrase")} == {"gio_cua", "cua_may"}
    assert {t for t, _ in terms(3, "text")} == {"brass", "bell"} and {t for t, _ in terms(4, "text")} == {"the", "of"}
    assert not [r for r in rows if r.id in (5, 6)]
    assert analysis.AnalyzerConfig().hash() == "a0f4262291a16fa9"


def test_stopwords_are_those_of_the_packs(spark):
    own = analysis.Pack("own", 15, ("WORD_LATIN",), "own-1", lambda t, _: analysis._no_variants(), ("red",), makes=False)
    texts = spark.createDataFrame([(1, "the red giỏ của mây")], "id long, text string")

    def terms(*packs):
        config = analysis.AnalyzerConfig(packs)
        rows = analysis.exploded(analysis.analyze(texts, "text", "index", config), "postings", "id").where("p.kind = 'lower'").select("p.term").collect()
        return [r.term for r in rows], texts.select(analysis.canonical(analysis.tokens(F.col("text"), config), config).alias("c")).first().c

    assert terms(analysis.code_pack(), analysis.generic_pack()) == (["the", "red", "giỏ", "của", "mây"], ["the", "red", "gio", "cua", "may"])
    assert terms(own, analysis.vietnamese_pack()) == (["the", "giỏ", "mây"], ["the", "gio", "may"])
    assert terms(analysis.english_pack()) == (["red", "giỏ", "của", "mây"],) * 2


def test_catalogue_facts(spark, catalogue):
    got = found(catalogue, spark, "xe đạp", "xe dap", "RX4420", "rx44", "4420", "giỏ", "đèn halo", "trekko", "", "zzzxxxqqq", "xe của sứ")
    assert got[0][0] == got[1][0] == got[2][0] == 1 and 2 in got[0] and 1 in got[3] and 1 in got[4]
    assert got[5].index(3) < got[5].index(4) and got[6][0] == 5 and sorted(got[7]) == [1, 6] and got[8] == got[9] == got[10] == []
    lengths = {r.zone: r.len for r in catalogue.index.doc_zones.where("doc_id = 1").collect()}
    assert lengths == {"title": 7, "sku": 1, "content": 8, "code": 3, "phrase": 6}


def test_delete_and_index_anew(spark, catalogue):
    engine = catalogue.delete(spark.createDataFrame([(1,)], "doc_id long")).upsert(documents(spark, [(2, "Bơm chân hai nòng Vigo", "BP310", None)]))
    engine = SearchEngine(kept(engine.index))
    assert engine.index.doc_count() == 7
    got = found(engine, spark, "RX4420", "gấp gọn")
    assert got == [[], []]


def test_codes(spark):
    engine = SearchEngine(kept(ix.build(documents(spark, CODES))))
    got = found(engine, spark, "VT 3100 QPPRT", "VT 3100QPPRT", "3100QPPRT", "QPPRT", "PL 2436ZN", "2436 ZN", "VTRH 1500 3", "VT 27K", "VT 8888YYYY")
    assert [g[0] if g else None for g in got] == [1, 1, 1, 1, 3, 3, 4, 2, None]


def test_score_by_hand_and_repeated_words(spark):
    engine = SearchEngine(kept(ix.build(documents(spark, [(1, "alpha", None, None), (2, "beta", None, None)]))))
    rows = engine.query(spark.createDataFrame([(0, "alpha"), (1, "alpha alpha")], "query_id long, q string"), 0).collect()
    assert [(r.query_id, r.doc_id, r.score) for r in sorted(rows)] == [(0, 1, 0.6027), (1, 1, 0.6027)]


def test_typos(spark):
    rows = [(1, "BỘ LÍP ĐỆM ĐƠN – VT 27K", None, "Dòng QPR 3100 và VT 3100 bền."), (2, "XE ĐẠP GẤP ALTOMO", None, "Xe đạp gấp gọn trong nhà."), (3, "BƠM CHÂN HAI NÒNG", None, "Bơm chân áp suất cao."), (4, "XE ĐẠP LEO NÚI", None, "Xe đạp khung thép.")]
    engine = SearchEngine(kept(ix.build(documents(spark, rows))))
    asked = spark.createDataFrame([(0, "xe dapp"), (1, "xe dap")], "query_id long, q string")
    said = {r.query_id: r.did_you_mean for r in engine.did_you_mean(asked).collect()}
    assert said == {0: "xe dap", 1: None}
    assert set(found(engine, spark, "xe dapp")[0]) == {2, 4}
    seen = []
    spied = SearchEngine(engine.index, reranker=lambda scores, queries: seen.extend(queries.collect()) or scores)
    spied.query(asked).collect()
    assert {r.query_id: r.effective for r in seen} == {0: "xe dap", 1: "xe dap"}
    assert not SearchEngine(engine.index, EngineConfig(typo=False)).did_you_mean(asked).where("did_you_mean is not null").count()


def test_corrections_in_a_large_index(spark):
    rows = spark.range(100_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "red widget").otherwise("ring").alias("title"))
    engine = SearchEngine(kept(ix.build(rows.select("doc_id", catalog.fields(title=F.col("title")).alias("fields")))))
    asked = spark.createDataFrame([(0, "red wigdet")], "query_id long, q string")
    assert engine.did_you_mean(asked).first().did_you_mean == "red widget" and sorted(found(engine, spark, "red wigdet")[0]) == [0, 1, 2]
    assert SearchEngine(engine.index, EngineConfig(typo_max_docs=100_000)).did_you_mean(asked).first().did_you_mean is None


def test_all_terms_are_candidates(spark):
    letters = "abcdefghijklmnop"
    words = [f"w{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:1]] + ["wzzring"]
    words += [f"w{a}{b}{c}x" for a in letters[:2] for b in letters for c in letters]  # 4,609 terms, the one asked for the last of them
    engine = SearchEngine(kept(ix.build(documents(spark, [(1, " ".join(words), None, None), (2, " ".join(words), None, None)]))))
    assert len(words) > 4_000
    assert engine.did_you_mean(spark.createDataFrame([(0, "wzzrnig")], "query_id long, q string")).first().did_you_mean == "wzzring"


def test_distance(spark):
    def plain(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return min(3, d[len(a), len(b)])

    import random

    rng = random.Random(1)
    pairs = [("ca", "abc"), ("dap", "dpa"), ("", "a"), ("", ""), ("abc", "abc"), ("ứa", "aứ")] + [("".join(rng.choices("abc", k=rng.randint(0, 6))), "".join(rng.choices("abc", k=rng.randint(0, 6)))) for _ in range(500)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    assert all(r.d == plain(r.a, r.b) for r in frame.select("a", "b", D.osa(F.col("a"), F.col("b")).alias("d")).collect())
    likes = spark.createDataFrame([(w,) for w in "qpprt vtrh pl rx4420 2436zn mm dap dapp trekko gio bom xe".split()], "w string").select("w", D.is_code_like(F.col("w")).alias("x")).collect()
    assert [r.x for r in likes] == [True] * 6 + [False] * 6


AGES = [(1, 12.0, 1500), (4, 7.0, 150), (2, 6.0, 2), (3, 1.5, 800)]
NOW = 1_700_000_000


def scores_of(spark, rows):
    return scoring.ranked(spark.createDataFrame([(0, d, s) for d, s in rows], "query_id long, doc_id long, score double"))


def in_order(frame):
    return [r.doc_id for r in frame.orderBy("rank").collect()]


def test_recency(spark):
    scores = scores_of(spark, [(d, s) for d, s, _ in AGES])
    dates = spark.createDataFrame([(d, NOW - a * 86_400) for d, _, a in AGES], "doc_id long, ts long")
    run = lambda mode: in_order(rerank.Recency(dates, NOW, mode)(scores, None))
    assert run("off") == [1, 4, 2, 3] == run("no such mode") and run("date") == [2, 4, 3, 1] and run("light")[0] == run("strong")[0] == 1
    pair = scores_of(spark, [(1, 20.0), (2, 11.0)])
    today = spark.createDataFrame([(1, NOW), (2, NOW)], "doc_id long, ts long")
    for mode, lift in (("light", 0.8), ("medium", 2.0), ("strong", 5.0)):
        assert {r.doc_id: round(r.score, 6) for r in rerank.Recency(today, NOW, mode)(pair, None).collect()}[2] == 11 + lift
    none = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, ts long")
    assert in_order(rerank.Recency(none, NOW, "date")(pair, None)) == [1, 2]


def test_exact_titles_and_the_pool(spark):
    rows = [(1, 5.1, "Trục sau VTRH 1500 3 loại tốt"), (2, 5.2, "Trục 3 đầu VTRH bản dài 1500"), (3, 5.3, "Vành VTRH đời mới"), (4, 5.4, "Chuông đồng nhỏ")]
    titles = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, title string")
    asked = spark.createDataFrame([(0, "VTRH 1500 3")], "query_id long, effective string")
    out = rerank.ExactTitle(titles)(scores_of(spark, [(d, s) for d, s, _ in rows]), asked).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 4)) for r in out] == [(1, 24.3), (2, 18.0), (3, 11.7), (4, 5.4)]
    many = scores_of(spark, [(i, 100 - 0.01 * i) for i in range(1, 521)])
    for place, now in ((500, 1), (501, 501)):
        named = spark.createDataFrame([(i, "VTRH 1500 3" if i == place else "khác") for i in range(1, 521)], "doc_id long, title string")
        got = in_order(rerank.ExactTitle(named)(many, asked))
        assert len(got) == 520 and got.index(place) + 1 == now


def test_settings():
    assert Settings.sanitized({}) == Settings(False, ("product",), "medium", "created", 180)
    assert Settings.sanitized({"enabled": "1", "recency_mode": "x", "recency_basis": "modified", "recency_halflife": "9999"}) == Settings(True, ("product",), "medium", "modified", 3650)
    assert Settings.sanitized({"recency_halflife": "0"}).recency_halflife == Settings.sanitized({"recency_halflife": " "}).recency_halflife == 180


def test_posts(spark):
    rows = [(1, "product", "T", "<p>a <b>b</b></p><script>x</script>", "e", "https://x/y", " K1 ", ["c", "d"]), (2, "post", "", None, None, "K", "K", ["c"]), (3, "product", "U", "x", "", "K", "K", [])]
    posts = spark.createDataFrame(rows, "doc_id long, post_type string, title string, content string, excerpt string, sku_v2 string, sku string, categories array<string>")
    got = {r.doc_id: {f.zone: f.text for f in r.fields} for r in catalog.from_posts(posts).collect()}
    assert got == {1: {"title": "T", "content": "a b e", "sku": "K1", "attr": "c d"}, 2: {}, 3: {"title": "U", "content": "x", "sku": "K"}}


def same(a, b):
    rows = lambda i: sorted(map(tuple, i.postings.select("doc_id", "zone", "term", "kw", "tf", "len").collect()))
    return rows(a) == rows(b) and sorted(map(tuple, a.index_docs.collect())) == sorted(map(tuple, b.index_docs.collect()))


def test_store_feed_and_reconciling(spark, tmp_path):
    docs, store = documents(spark, CATALOGUE), Store(spark, str(tmp_path / "index"))
    assert store.load() is None and not store.analyzer_changed()
    store.publish(ix.build(documents(spark, [(1, "old", None, None), (2, "old", None, None), (9, "gone", None, None)])), built_at=5)
    spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "doc_id long").coalesce(1).write.parquet(str(tmp_path / "changes"))
    feed = spark.readStream.schema("doc_id long").parquet(str(tmp_path / "changes"))
    sync.start(feed, store, lambda: docs, str(tmp_path / "progress"), lambda: 77).awaitTermination()
    now = store.load()
    assert same(now, ix.build(docs.where("doc_id in (1, 2)"))) and store.meta()["last_drain"] == 77 and store.meta()["built_at"] == 5
    assert maintenance.missing(now, docs).count() == 6 and maintenance.orphans(now, docs.where("doc_id <> 2")).count() == 1
    assert same(maintenance.reconcile(now, docs.where("doc_id <> 2")), ix.build(docs.where("doc_id <> 2")))
    assert store.analyzer_changed(analysis.AnalyzerConfig(bigrams=False)) and not store.analyzer_changed()
    shown = store.status(docs).first()
    assert (shown.version, shown.built_at, shown.stale, shown.active, shown.docs, shown.source_docs) == (2, 5, False, True, 2, 8)
    late = Store(spark, store.path)
    late._next = lambda: 3  # as read before another writer's publication
    store.publish(now, built_at=5)
    with pytest.raises(RuntimeError, match="version 3"):
        late.publish(now)
    store.expire(keep=1)
    assert same(store.load(), ix.build(docs.where("doc_id in (1, 2)"))) and not store.folders() - {store.meta()["folder"]}
    store.flush()
    assert store.load() is None and store.status(docs).first().active is False
    store.drop()
    assert store.meta() is None and store.load() is None


def test_changes_before_a_first_publication_are_not_lost(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    spark.createDataFrame([(1,), (2,)], "doc_id long").coalesce(1).write.parquet(str(tmp_path / "changes"))
    run = lambda: sync.start(spark.readStream.schema("doc_id long").parquet(str(tmp_path / "changes")), store, lambda: documents(spark, CATALOGUE), str(tmp_path / "progress"), lambda: 77).awaitTermination()
    with pytest.raises(Exception, match="no index"):
        run()
    store.publish(ix.build(documents(spark, CATALOGUE).limit(0)))
    run()
    assert sorted(r.doc_id for r in store.load().index_docs.collect()) == [1, 2]


def test_backlog(spark):
    queue = spark.createDataFrame([(1, 30), (2, 10), (1, 5), (3, 20), (None, 1)], "doc_id long, ts long")
    assert sync.pending(queue) == 3 and [r.doc_id for r in sync.oldest(queue, 2).orderBy("ts").collect()] == [1, 2]
    events = spark.createDataFrame([(1, "save", "product", False), (2, "save", "note", False), (3, "stock", "note", None), (4, "save", "post", True), (5, "remove", "note", False)], "doc_id long, kind string, post_type string, is_revision boolean")
    assert sorted(r.doc_id for r in sync.captured(events, ("product", "post")).collect()) == [1, 3, 5]


def test_stalled():
    assert maintenance.is_stalled(3, 0, 601) and not maintenance.is_stalled(0, 0, 601)


def test_empty_index(spark):
    engine = SearchEngine(ix.build(documents(spark, CATALOGUE).limit(0)))
    assert found(engine, spark, "xe") == [[]] and engine.stats().count() == 0


def test_entry_works_without_the_llm_part():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "search_flagship" in entry.queries()
