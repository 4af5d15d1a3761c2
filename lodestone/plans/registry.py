"""Every registered query of the retrieval engine, and its DuckDB statement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.html_text import rendered
from lodestone.operators import eda, tfidf
from lodestone.operators import scores as S
from lodestone.operators.classifier import logistic_oof, logistic_rows, logistic_scores, numbered_folds
from lodestone.operators.rerank import CANDIDATES, encode, rerank
from lodestone.plans import duck as D
from lodestone.operators.matching import containing
from lodestone.operators.nearest import nearest
from lodestone.operators.pairs import label_products
from lodestone.operators.postings import best_articles
from lodestone.sources.io import settled, table_digest, unknown_labels

QUERIES: dict = {}
ORACLES: dict = {}

#: Memory parameters that fit the test embeddings, beside the defaults.
SCALED = {"neighbors": 30, "power": 2.0, "threshold": 0.2, "frequency_power": 0.25}
SCALED_GATE = {"start": 0.3, "width": 0.15}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("article_id"), "text")


def _bench(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _articles(spark, d):
    """Pages as articles: the first heading is the title."""
    r = _t(spark, d, "pages").select(F.col("page_id").alias("article_id"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"), rendered(F.col("html")).alias("r"))
    return r.select("article_id", "title", F.col("r.clean").alias("clean_body"), F.col("r.dense").alias("dense"))


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))


def _sides(spark, d, targets: str = "vec_id % 5 = 0", references: str = "vec_id % 5 <> 0"):
    """(target_id, v) and (ref_id, u)."""
    v = _vectors(spark, d)
    return v.where(targets).select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("v")), v.where(references).select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("u"))


def _near(spark, d, k: int, targets: str = "vec_id % 5 = 0", references: str = "vec_id % 5 <> 0", folds=None):
    """The k nearest references alone; with folds those of other folds than the target's."""
    return nearest(*_sides(spark, d, targets, references), k, folds=folds)


def _labels(spark, d, where="true"):
    return _vectors(spark, d).where(where).select(F.col("vec_id").alias("ref_id"), F.col("label").alias("article_id"))


def _double_labels(spark, d, where="true"):
    """Two labels for each vector, so that labels occur together."""
    return _vectors(spark, d).where(where).select(F.col("vec_id").alias("ref_id"), F.explode(F.array_distinct(F.array("label", (F.col("vec_id") % 7)))).alias("article_id"))


def _r(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols or ("score",):
        df = df.withColumn(c, F.round(c, 6))
    return df


def _truth(spark, d):
    """(query_id, article_id): documents that contain the benchmark text; settled, since metrics read it several times."""
    return settled(containing(_docs(spark, d), _bench(spark, d)))


@query("select doc_id, trim(regexp_replace(translate(text, 'ёЁ', 'еЕ'), '\\s+', ' ', 'g')) as clean from documents")
def normalize_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("clean"))


@query("select doc_id, array_to_string(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+'), ' ') as lexical from documents")
def normalize_lexical(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.normalize_lexical_text(F.col("text")).alias("lexical"))


@query(f"select page_id, {D.CLEAN} as clean from pages")
def html_to_text(spark, d):
    return _t(spark, d, "pages").select("page_id", rendered(F.col("html"))["clean"].alias("clean"))


@query(f"select page_id, {D.CLEAN} as dense from pages")
def html_to_dense_text(spark, d):
    dense = rendered(F.col("html"))["dense"]
    return _t(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(dense, r"\s+", " ")).alias("dense"))


@query("select page_id, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) as clean_title, " + D.CLEAN + " as clean_body from pages")
def prepare_articles(spark, d):
    from lodestone.plans.pipeline import prepare_articles as prepare

    a = _t(spark, d, "pages").select(F.col("page_id").alias("article_id"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"), F.col("html").alias("body"))
    return prepare(a).select(F.col("article_id").alias("page_id"), "clean_title", "clean_body")


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents),
k as (select *, case when len(w) <= 180 then 0 else ceil((len(w) - 180) / 115.0)::bigint end as k from w where len(w) > 0),
c as (select *, unnest(generate_series(0, k)) as chunk_id from k)
select doc_id, chunk_id, array_to_string(w[chunk_id * 115 + 1 : case when chunk_id = k then len(w) else chunk_id * 115 + 150 end], ' ') as chunk from c""")
def split_text_chunks(spark, d):
    return X.split_text(_t(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "chunk_id", "chunk")


@query("""with w as (select doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents where len(text) > 0),
k as (select *, case when len(w) <= 180 then 0 else ceil((len(w) - 180) / 115.0)::bigint end as k from w where len(w) > 0),
c as (select *, unnest(generate_series(0, k)) as chunk_id from k)
select doc_id as article_id, chunk_id, lang || chr(10) || array_to_string(w[chunk_id * 115 + 1 : case when chunk_id = k then len(w) else chunk_id * 115 + 150 end], ' ') as text from c join documents using (doc_id)""")
def article_chunks(spark, d):
    return X.build_article_chunks(_t(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("lang").alias("clean_title"), F.col("text").alias("clean_body")))


@query("""with w as (select doc_id, lang, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents),
c as (select *, unnest(generate_series(0, (greatest(len(w), 1) - 1) // 90)) as chunk_id from w)
select doc_id as article_id, chunk_id, lang || chr(10) || coalesce(array_to_string(w[chunk_id * 90 + 1 : chunk_id * 90 + 120], ' '), '') as text from c""")
def reranker_chunks(spark, d):
    return X.reranker_chunks(_t(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("lang").alias("title"), F.col("text").alias("dense")))


@query("select doc_id as article_id, lang || chr(10) || substr(text, 1, 6000) as passage from documents")
def article_passages(spark, d):
    return X.article_passages(_t(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("lang").alias("title"), F.col("text").alias("dense")))


@query("select item_id, 'Instruct: Find it' || chr(10) || 'Query: ' || text as prompt from benchmark")
def instructed_queries(spark, d):
    return _t(spark, d, "benchmark").select("item_id", X.instructed(F.col("text"), "Find it").alias("prompt"))


@query("select l_orderkey as query_id, l_suppkey as article_id, count(*) as n from lineitem group by 1, 2")
def parse_ground_truth(spark, d):
    packed = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.concat(F.lit(" "), F.array_join(F.collect_list(F.col("l_suppkey").cast("string")), "  ")).alias("ground_truth"))
    return packed.select("query_id", F.explode(X.parse_ground_truth(F.col("ground_truth"))).alias("article_id")).groupBy("query_id", "article_id").agg(F.count("*").alias("n"))


@query(" union all ".join(f"select '{t}' as name, count(*) as n_rows, {' + '.join(f'count_if({c} is null)' for c in cs)} as n_nulls from {t}" for t, cs in {"documents": ["doc_id", "text"], "pages": ["page_id", "html"], "benchmark": ["item_id", "text"]}.items()))
def table_nulls(spark, d):
    return eda.null_counts({"documents": _t(spark, d, "documents").select("doc_id", "text"), "pages": _t(spark, d, "pages").select("page_id", "html"), "benchmark": _t(spark, d, "benchmark").select("item_id", "text")})


@query("select distinct l_suppkey as article_id from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 3 <> 0)")
def label_fk_check(spark, d):
    return unknown_labels(_t(spark, d, "lineitem").select(F.col("l_suppkey").alias("article_id")), _t(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("article_id")))


_WORD = D.tfidf("documents", "doc_id", "text", "benchmark", "item_id", "text", "word")
_TOP = "select query_id, rank, article_id, round(score, 6) as score from (select query_id, article_id, round(score, 9) as score, row_number() over (partition by query_id order by round(score, 9) desc, article_id) as rank from ({})) where rank <= {}"


def _best(spark, d, k):
    return S.rank(tfidf.best_scores(_docs(spark, d), _bench(spark, d), "word", k), k)


@query(_TOP.format(_WORD, 10))
def word_tfidf_top10(spark, d):
    return _r(_best(spark, d, 10))


@query(_TOP.format(D.tfidf("documents", "doc_id", D.LEXICAL, "benchmark", "item_id", D.LEXICAL, "char", sublinear=True), 10))
def char_tfidf_top10(spark, d):
    lex = lambda df: df.withColumn("text", X.normalize_lexical_text(F.col("text")))
    return _r(S.rank(tfidf.best_scores(lex(_docs(spark, d)), lex(_bench(spark, d)), "char", 10, 1, True)))


@query(_TOP.format(D.tfidf("documents", "doc_id", "text", "pages", "page_id", D.TITLE, "word"), 10))
def indexed_top10(spark, d):
    """Pages' headings, which are short, against all documents, from posting lists with block maxima."""
    asked = _t(spark, d, "pages").select(F.col("page_id").alias("query_id"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("text"))
    return _r(S.rank(best_articles(_docs(spark, d), asked, "word", 10)))


@query("select query_id, article_id, round(score / greatest(max(score) over (partition by query_id), 1e-8), 6) as score from (" + _WORD + ")")
def lexical_article_scores(spark, d):
    return _r(S.row_scale(tfidf.tfidf_scores(_docs(spark, d), _bench(spark, d), "word")))


@query(" union all ".join(f"select '{ch}' as channel, query_id, article_id, round(score, 6) as score from ({D.tfidf('pages', 'page_id', col, 'benchmark', 'item_id', 'text', an, mind, an == 'char')})" for ch, col, an, mind in (("body_word", D.CLEAN, "word", 1), ("body_char", D.CLEAN, "char", 2), ("title_word", D.TITLE, "word", 1), ("title_char", D.TITLE, "char", 1))))
def lexical_channels(spark, d):
    a = _articles(spark, d).select("article_id", F.col("title").alias("clean_title"), "clean_body")
    return _r(tfidf.lexical_channels(a, _bench(spark, d)))


_QSIM = D.query_similarity("benchmark", "item_id", "text", "(select * from conversations where role = 'user')", "conv_id * 1000 + turn", "text")


@query(f"select target_id, ref_id, round(sim, 6) as sim from ({_QSIM})")
def query_similarity(spark, d):
    refs = _t(spark, d, "benchmark").select(F.col("item_id").alias("ref_id"), X.normalize_lexical_text(F.col("text")).alias("text"))
    turns = _t(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("target_id"), X.normalize_lexical_text(F.col("text")).alias("text"))
    return _r(tfidf.query_similarity(refs, turns), "sim")


@query(f"""with t as ({D.transfer_sim('true', 'true')}) select target_id, ref_id, round(sim, 6) as sim from t""")
def dense_similarity(spark, d):
    return _r(S.dense_similarity(*_sides(spark, d, "true", "true")), "sim")


@query(f"""with t as ({D.transfer_sim('true', 'true')}), m as (select target_id, greatest(max(sim), 1e-8) as m from t group by 1)
select target_id as query_id, ref_id as article_id, round(sim / m, 6) as score from t join m using (target_id)""")
def dense_scores(spark, d):
    return _r(S.dense_scores(*_sides(spark, d, "true", "true")))


def _memory_query(name: str, p: dict) -> None:
    def run(spark, d):
        return _r(S.memory_scores(_near(spark, d, p["neighbors"]), _labels(spark, d, "vec_id % 5 <> 0"), p))

    run.__name__ = name
    query(f"with sim as ({D.transfer_sim()}), lab as ({D.LABELS} where vec_id % 5 <> 0) select query_id, article_id, round(score, 6) as score from ({D.memory(p)})")(run)


for _name, _p in (("memory_knn", S.MEMORY), ("dense_memory", S.DENSE), ("robust_memory", S.ROBUST), ("scaled_memory", SCALED)):
    _memory_query(_name, _p)


@query(f"with sim as ({D.transfer_sim()}), lab as ({D.DOUBLE} where vec_id % 5 <> 0), base as ({D.memory(S.MEMORY)}), {D.EXPAND} select query_id, article_id, round(score, 6) as score from scaled")
def cooccurrence_memory(spark, d):
    return _r(S.cooccurrence_scores(_near(spark, d, S.MEMORY["neighbors"]), _double_labels(spark, d, "vec_id % 5 <> 0")))


@query(f"with sim as ({D.transfer_sim()}) select target_id, rank, ref_id, round(sim, 6) as sim from (select *, row_number() over (partition by target_id order by round(sim, 9) desc, ref_id) as rank from sim) where rank <= 10")
def nearest_vectors(spark, d):
    found = _near(spark, d, 10).withColumn("score", F.col("sim")).select(F.col("target_id").alias("query_id"), F.col("ref_id").alias("article_id"), "score")
    return S.rank(found).select(F.col("query_id").alias("target_id"), "rank", F.col("article_id").alias("ref_id"), F.round("score", 6).alias("sim"))


@query(D.loo(SCALED))
def loo_dense_memory(spark, d):
    return _r(S.leave_one_out(_near(spark, d, SCALED["neighbors"] + 1, "true", "true"), _labels(spark, d), SCALED, False))


@query(D.loo(S.MEMORY, True))
def loo_memory(spark, d):
    return _r(S.leave_one_out(_near(spark, d, S.MEMORY["neighbors"] + 1, "true", "true"), _double_labels(spark, d)))


def _folds(spark, d):
    return _vectors(spark, d).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5).cast("int").alias("fold"))


@query(D.fold(SCALED))
def fold_dense_memory(spark, d):
    return _r(S.fold_memory(_near(spark, d, SCALED["neighbors"], "true", "true", _folds(spark, d)), _labels(spark, d), _folds(spark, d), SCALED))


@query(D.fold(S.MEMORY, True))
def fold_memory(spark, d):
    return _r(S.fold_memory(_near(spark, d, S.MEMORY["neighbors"], "true", "true", _folds(spark, d)), _double_labels(spark, d), _folds(spark, d), S.MEMORY, True))


def _order_scores(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("article_id")).agg(F.sum(F.col("l_quantity") - 25).alias("score"))


_ORDERS = "(select l_orderkey as query_id, l_suppkey as article_id, sum(l_quantity - 25) as score from lineitem group by 1, 2)"


@query(f"select query_id, article_id, round(score / greatest(max(score) over (partition by query_id), 1e-8), 6) as score from {_ORDERS}")
def row_scale(spark, d):
    return _r(S.row_scale(_order_scores(spark, d)))


@query(f"select query_id, article_id, round((score - min(score) over w) / greatest(max(score) over w - min(score) over w, 1e-8), 6) as score from {_ORDERS} window w as (partition by query_id)")
def minmax_scores(spark, d):
    return _r(S.minmax(_order_scores(spark, d)))


def _label_channels(targets, references, labels, apart: bool = False):
    """Best and mean absolute product of each target with a label's references, scaled by row."""
    found = settled(label_products(targets, references.join(labels, "ref_id"), apart).withColumnRenamed("target_id", "query_id"))
    best, mean = F.col("best").alias("score"), (F.col("total") / F.col("n")).alias("score")
    return S.row_scale(found.select("query_id", "article_id", best)), S.row_scale(found.select("query_id", "article_id", mean))


def _five(spark, d):
    """Channels from the test embeddings: lexical and classifier are stand-ins made of labels."""
    labels = _labels(spark, d, "vec_id % 5 <> 0")
    sim = settled(_near(spark, d, max(SCALED["neighbors"], S.MEMORY["neighbors"])))
    direct, lexical = _label_channels(*_sides(spark, d), labels)
    memory, lexmem = S.memory_scores(sim, labels, SCALED), S.memory_scores(sim, labels)
    clf = direct.select("query_id", "article_id", (F.col("score") * F.col("score")).alias("score"))
    return lexical, direct, memory, lexmem, clf, sim, labels


@query(D.fusion(SCALED, "select query_id, article_id, round(score, 6) as score from hybrid"))
def hybrid_fusion(spark, d):
    return _r(S.hybrid(*_five(spark, d)[:5]))


@query(D.fusion(SCALED, "select query_id, article_id, round(score, 6) as score from robust", SCALED_GATE))
def robust_fusion(spark, d):
    *channels, sim, labels = _five(spark, d)
    return _r(S.robust(*channels, sim, labels.where("article_id % 3 <> 0"), SCALED_GATE))


@query(D.fusion(SCALED, "select query_id, article_id, round(.84 * h.score + .16 * coalesce(c.score, 0), 6) as score from hybrid h left join clf c using (query_id, article_id)"))
def high_score_fusion(spark, d):
    channels = _five(spark, d)
    return _r(S.high_score(S.hybrid(*channels[:5]), channels[4]))


@query(f"select * from ({_TOP.format(_ORDERS, 10)})")
def rank_top10(spark, d):
    return _r(S.rank(_order_scores(spark, d)))


@query(f"select query_id, rank, article_id from ({_TOP.format(_WORD, 15)})")
def rerank_candidates(spark, d):
    return _best(spark, d, 15).drop("score")


@query(f"select query_id, string_agg(article_id::varchar, ' ' order by rank) as answer from ({_TOP.format('select q.item_id as query_id, a.doc_id as article_id, coalesce(s.score, 0) as score from benchmark q cross join documents a left join (' + _WORD + ') s on s.query_id = q.item_id and s.article_id = a.doc_id', 10)}) group by 1")
def submission(spark, d):
    scores = tfidf.tfidf_scores(_docs(spark, d), _bench(spark, d), "word")
    return S.submission(S.rank(S.complete(scores, _bench(spark, d), _docs(spark, d))))


_TRUTH = "select item_id as query_id, doc_id as article_id from benchmark b join documents d on contains(d.text, b.text)"
_AP = f"""with r as ({_TOP.format(_WORD, 10)}), rel as ({_TRUTH}), n as (select query_id, count(*) as n from rel group by 1),
h as (select r.query_id, r.rank, row_number() over (partition by r.query_id order by r.rank) as h from r join rel using (query_id, article_id)),
ap as (select n.query_id, coalesce(sum(h / rank), 0) / least(any_value(n), 10) as ap from n left join h using (query_id) group by 1) """


def _ranking(spark, d):
    return _best(spark, d, 10)


@query(_AP + "select query_id, round(ap, 6) as ap from ap")
def average_precision(spark, d):
    return _r(S.average_precision(_ranking(spark, d), _truth(spark, d)), "ap")


@query(_AP + "select round(coalesce(avg(ap), 0), 6) as map from ap")
def map_at_10(spark, d):
    return _r(S.mean_average_precision(_ranking(spark, d), _truth(spark, d)), "map")


@query(f"""with r as ({_TOP.format(_WORD, 30)}), rel as ({_TRUTH}), n as (select query_id, count(*) as n from rel group by 1), ks as (select unnest([1, 3, 5, 10, 15, 30])::bigint as k),
h as (select k, n.query_id, any_value(n) as n, count(r.rank) as h from ks cross join n left join (select r.* from r join rel using (query_id, article_id)) r on r.query_id = n.query_id and r.rank <= k group by 1, 2)
select k, round(avg(h / n), 6) as recall from h group by 1""")
def recall_at_k(spark, d):
    return _r(S.recall_at(_best(spark, d, 30), _truth(spark, d)), "recall")


@query("select l_suppkey as article_id, count(*) as n from lineitem group by 1 order by n desc, 1 limit 20")
def eda_label_frequency(spark, d):
    return eda.label_frequency(_t(spark, d, "lineitem").select(F.col("l_suppkey").alias("article_id")))


@query("with b as (select min(value) as lo, max(value) as hi, count(value) as t from events), w as (select lo, t, (hi - lo) / 30 as w from b) select least(floor((value - lo) / w), 29)::bigint as bin, count(*) as n, round(count(*) / any_value(t * w), 6) as density from events, w where value is not null group by 1")
def eda_histogram(spark, d):
    return _r(eda.histogram(_t(spark, d, "events"), "value"), "density")


@query("""with q as (select event_type, quantile_cont(value, .25) as q1, quantile_cont(value, .5) as median, quantile_cont(value, .75) as q3 from events group by 1)
select event_type, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(min(value), 6) as low, round(max(value), 6) as high from events join q using (event_type) where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by 1, 2, 3, 4""")
def eda_boxplot(spark, d):
    return _r(eda.boxplot(_t(spark, d, "events"), "event_type", "value"), "q1", "median", "q3", "low", "high")


@query("""with e as (select quantile_cont(n_chars, 0.0) as a, quantile_cont(n_chars, .25) as b, quantile_cont(n_chars, .5) as c, quantile_cont(n_chars, .75) as d, quantile_cont(n_chars, 1.0) as z from documents)
select greatest(case when n_chars > d then 4 when n_chars > c then 3 when n_chars > b then 2 else 1 end, 1)::bigint as bin, count(*) as n, round(avg(doc_id), 6) as mean from documents, e group by 1""")
def eda_qcut_slice(spark, d):
    return _r(eda.quantile_slices(_t(spark, d, "documents"), "n_chars", "doc_id"), "mean")


@query(_AP + ", m as (select count(*) as n_relevant, query_id from rel group by 2) select query_id, round(ap, 6) as ap, n_relevant from ap join m using (query_id) order by ap, n_relevant desc, query_id limit 12")
def eda_worst_queries(spark, d):
    truth = _truth(spark, d)
    return eda.worst(_r(S.average_precision(_ranking(spark, d), truth), "ap").join(truth.groupBy("query_id").agg(F.count("*").alias("n_relevant")), "query_id"))


@query(_AP + ", m as (select count(*) as n, query_id from rel group by 2) select case when n > 1 then 'several' else 'one' end as kind, count(*) as n_queries, round(avg(ap), 6) as map from ap join m using (query_id) group by 1")
def eda_label_slices(spark, d):
    truth = _truth(spark, d)
    ap = S.average_precision(_ranking(spark, d), truth).join(truth.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    return _r(ap.groupBy(F.when(F.col("n") > 1, "several").otherwise("one").alias("kind")).agg(F.count("*").alias("n_queries"), F.avg("ap").alias("map")), "map")


@query(D.best_chunk(_TOP.format(_WORD, 15)))
def best_chunk_per_candidate(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("lang").alias("title"), F.col("text").alias("dense"))
    pairs = _best(spark, d, 15)
    chunks = X.reranker_chunks(docs).withColumn("text", X.normalize_lexical_text(F.col("text")))
    asked = _bench(spark, d).withColumn("text", X.normalize_lexical_text(F.col("text")))
    return _r(tfidf.best_chunks(chunks, asked, pairs), "sim").select("query_id", "article_id", "chunk_id", "sim")


@query()
def kfold_assignment(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    parts = [numbered_folds(q, s).select("query_id", "pos", F.col("fold").cast("long").alias("fold"), F.lit(s).cast("long").alias("seed")) for s in (7, 42, 2026)]
    return reduce(DataFrame.unionByName, parts)


def _logistic_data(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return q, q.select(F.col("query_id").alias("ref_id"), (F.col("query_id") % 4).alias("article_id"))


@query()
def logistic_query_scores(spark, d):
    q, labels = _logistic_data(spark, d)
    return logistic_scores(q.where("query_id % 5 <> 0"), q.where("query_id % 5 = 0"), labels)


@query()
def logistic_row_scores(spark, d):
    """As logistic_query_scores, without a kernel."""
    q, labels = _logistic_data(spark, d)
    return logistic_rows(q.where("query_id % 5 <> 0"), q.where("query_id % 5 = 0"), labels)


@query()
def logistic_oof_scores(spark, d):
    q, labels = _logistic_data(spark, d)
    return logistic_oof(q, labels, 42)


@query()
def encode_stub(spark, d):
    return encode(_bench(spark, d), "query_id", "text")


@query()
def reranked_scores(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("lang").alias("title"), F.col("text").alias("dense"))
    # no article beyond the candidates and their ties can be among the ten, and the row's maximum is one of theirs
    base = settled(S.row_scale(tfidf.best_scores(_docs(spark, d), _bench(spark, d), "word", CANDIDATES)))
    chunks = X.reranker_chunks(docs).withColumn("text", X.normalize_lexical_text(F.col("text")))
    return S.rank(rerank(base, chunks, _bench(spark, d).withColumn("text", X.normalize_lexical_text(F.col("text")))))


_ROW = " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar || ';', 'null;')" for c in ("doc_id", "text", "lang"))


@query(f"""with r as (select doc_id, sha256({_ROW}) as digest from documents), p as (select digest, row_number() over (order by doc_id, digest) - 1 as pos from r),
a as (select pos // 4096 as pos, sha256(string_agg(digest, '' order by pos)) as digest from p group by pos // 4096),
b as (select pos // 4096 as pos, sha256(string_agg(digest, '' order by pos)) as digest from a group by pos // 4096)
select case when (select count(*) from a) > 1 then (select digest from b) else (select digest from a) end as key""")
def table_content_key(spark, d):
    return spark.createDataFrame([(table_digest(_t(spark, d, "documents").select("doc_id", "text", "lang"), ["doc_id"]),)], "key string")


@query("select doc_id, 'Instruct: Find it' || chr(10) || 'Query: ' || lang || chr(10) || 'Document: ' || text as prompt from documents")
def reranker_prompt(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.rerank_prompt(F.col("lang"), F.col("text"), "Find it").alias("prompt"))


@query(D.fold_robust(SCALED, SCALED_GATE))
def fold_robust_fusion(spark, d):
    labels = _vectors(spark, d).where("label % 3 <> 0 or vec_id % 5 = 1").select(F.col("vec_id").alias("ref_id"), F.col("label").alias("article_id"))
    sim = settled(_near(spark, d, SCALED["neighbors"], "true", "true", _folds(spark, d)))
    dense, lexical = _label_channels(*_sides(spark, d, "true", "true"), labels, True)
    clf = dense.select("query_id", "article_id", (F.col("score") * F.col("score")).alias("score"))
    return _r(S.fold_robust(lexical, dense, lexical, clf, sim, labels, _folds(spark, d), SCALED, SCALED_GATE))


@query("select ref_id, article_id from (select l_orderkey as ref_id, l_suppkey as article_id from lineitem) group by 1, 2")
def label_matrix(spark, d):
    from lodestone.plans.pipeline import label_matrix as matrix

    packed = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_join(F.collect_list(F.col("l_suppkey").cast("string")), " ").alias("ground_truth"))
    return matrix(packed)


@query(f"""with t as ({D._terms('documents', 'doc_id', 'text', 'word')}), c as (select id, term, count(*) as tf from t group by 1, 2)
select term, round(ln((1 + (select count(*) from documents)) / (1 + count(*))) + 1, 6) as idf from c group by 1 having count(*) >= 2 order by sum(tf) desc, term limit 500""")
def frequent_terms(spark, d):
    docs = _docs(spark, d)
    return _r(tfidf.idf(tfidf.counts(docs, "article_id", "word"), docs.agg(F.count("*")), 2, 500).drop("df"), "idf")


@query("select count(*) as n_labels, count_if(n = 1)::bigint as n_single from (select l_suppkey, count(*) as n from lineitem group by 1)")
def eda_label_summary(spark, d):
    return eda.label_summary(_t(spark, d, "lineitem").select(F.col("l_suppkey").alias("article_id")))


@query("select n_labels, count(*) as n_queries from (select l_orderkey, count(*) as n_labels from lineitem group by 1) group by 1")
def eda_labels_per_query(spark, d):
    return eda.labels_per_query(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("article_id")))


@query("select l_linenumber::bigint as value, count(*) as n, round(count(*) / (select count(*) from lineitem), 6) as density from lineitem group by 1")
def eda_discrete_histogram(spark, d):
    return _r(eda.discrete_histogram(_t(spark, d, "lineitem"), "l_linenumber"), "density")


@query("select doc_id, length(text) as n_chars, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''))::bigint as n_words, round(log10(length(text) + 1), 6) as log_chars from documents")
def eda_lengths(spark, d):
    return _r(eda.lengths(_t(spark, d, "documents"), "doc_id", "text"), "log_chars")


@query("select count_if(" + D.CLEAN + " = '')::bigint as n_empty from pages")
def eda_empty_bodies(spark, d):
    return _articles(spark, d).agg(F.count_if(F.col("clean_body") == "").alias("n_empty"))


def _task(spark, d):
    """Pages as articles; benchmark texts as queries, the odd ones labelled by pages whose ids follow from theirs."""
    from lodestone.plans.pipeline import prepare_articles as prepare

    pages = _t(spark, d, "pages").select(F.col("page_id").alias("article_id"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"), F.col("html").alias("body"))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), F.col("item_id").alias("pos"))
    ids = pages.orderBy("article_id").limit(20).agg(F.array_sort(F.collect_list("article_id")).alias("ids"))
    refs = asked.where("query_id % 2 = 1").withColumn("ids", ids.scalar())
    refs = refs.select("query_id", "query_text", F.concat_ws(" ", F.expr("cast(ids[cast(query_id % 7 as int)] as string)"), F.expr("cast(ids[cast(query_id % 20 as int)] as string)")).alias("ground_truth"))
    return prepare(pages), refs, asked.where("query_id % 2 = 0")


def _mode_query(mode: str) -> None:
    def run(spark, d):
        from lodestone.plans.pipeline import answers, final_scores

        articles, refs, test = _task(spark, d)
        return answers(final_scores(articles, refs, test, mode), test, articles)

    run.__name__ = f"answers_{mode.replace('-', '_')}"
    query()(run)


for _mode in ("fast", "high-score", "robust"):
    _mode_query(_mode)


@query()
def evaluation(spark, d):
    from lodestone.plans.pipeline import evaluate

    articles, refs, _ = _task(spark, d)
    return evaluate(articles, refs).drop("seconds")
