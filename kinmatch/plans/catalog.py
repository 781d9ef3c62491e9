"""All queries of the library but those of the llm subpackage, with their oracles in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.functions import text as T
from kinmatch.operators import assembly, compare, decisions, learning, metrics, pairs, similarity, statistics
from kinmatch.plans import views as V
from kinmatch.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- text ---------------------------------------------------------------------------------------------------------

_C = V.clean_sql("coalesce(text,'')")
_DOC_TOKENS = f"select doc_id, lang, {V.TOKENS.format(_C)} t from documents"


@query(f"select doc_id, md5({_C}) clean_md5, cast(length({_C}) as bigint) n from documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("bigint").alias("n"))


@query(f"select item_id, {V.clean_sql('text')} cleaned from benchmark")
def clean_text_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.clean_text_udf("text").alias("cleaned"))


@query(f"with d as ({_DOC_TOKENS}) select doc_id, cast(len(t) as bigint) n_tokens, cast(len(list_distinct(t)) as bigint) n_distinct from d")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(T.clean_text(F.col("text"))).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(f"with d as (select item_id, replace({V.clean_sql('text')},' ','') j from benchmark), g as (select item_id, {V.NGRAMS.format('j')} g from d) select item_id, cast(len(g) as bigint) n, cast(len(list_distinct(g)) as bigint) n_distinct, array_to_string(list_sort(list_distinct(g)),',') grams from g")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "benchmark").select("item_id", T.clean_text(F.col("text")).alias("cleaned")).select("item_id", T.char_ngrams(F.col("cleaned")).alias("g"))
    return d.select("item_id", F.size("g").cast("bigint").alias("n"), F.size(F.array_distinct("g")).cast("bigint").alias("n_distinct"), F.array_join(F.array_sort(F.array_distinct("g")), ",").alias("grams"))


@query(f"select page_id, array_to_string(list_sort({V.KEYS.format('url')}),',') as keys from pages union all select -id, array_to_string(list_sort({V.KEYS.format('address')}),',') from ({V.PARTY_C})")
def numeric_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda c: F.array_join(F.array_sort(T.numeric_keys(F.col(c))), ",").alias("keys")
    return table(spark, sf_dir, "pages").select("page_id", keys("url")).union(V.parties(spark, sf_dir)[1].select(-F.col("id"), keys("address")))


_FORMS = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in T.LEGAL_FORMS.items()) + "}"


@query(f"with d as (select doc_id, unnest({V.TOKENS.format(_C)}) t from documents) select doc_id, sum(case when element_at({_FORMS}, t)[1] is not null then 1 else 0 end)::bigint n_known, sum(case when coalesce(element_at({_FORMS}, t)[1], t)<>t then 1 else 0 end)::bigint n_changed from d group by 1")
def suffix_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(T.clean_text(F.col("text"))).alias("t")).select("doc_id", "t", T.written_out(F.col("t")).alias("w")).where("size(t) > 0")
    known = F.size(F.filter("t", lambda x: x.isin(list(T.LEGAL_FORMS)))).cast("bigint")
    return d.select("doc_id", known.alias("n_known"), F.size(F.filter(F.zip_with("t", "w", lambda a, b: a != b), lambda x: x)).cast("bigint").alias("n_changed"))


@query("select lang country, case when regexp_matches(text,'\\p{L}') then 'Latin' else 'None' end script, count(*) n from documents group by all")
def script_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("country"), "text")
    return statistics.script_census(rows, T.dominant_script("text")).select("country", "script", "n")


@query(f"select id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(array_to_string(string_split(address,',')[-2:],' '),'\\s+'), lambda x: x<>''))),' ') places from ({V.PARTY_C}) where len(string_split(address,','))>1")
def location_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.parties(spark, sf_dir)[1].select("id", T.location_tokens(F.col("address")).alias("l"))
    return c.where("size(l) > 0").select("id", F.array_join(F.array_sort("l"), " ").alias("places"))


# --- statistics ---------------------------------------------------------------------------------------------------

_FREQ = f"with d as ({_DOC_TOKENS}), o as (select lang, doc_id, list_distinct(t) t from d where len(t)>0), n as (select lang, count(*) n from o group by 1), f as (select lang country, token, count(*) cnt, count(*)/any_value(n) frac from (select lang, unnest(t) token from o) join n using(lang) group by all)"


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("country"), F.col("doc_id").alias("id"), "text")
    return statistics.token_frequencies(d, T.tokens(T.clean_text(F.col("text"))))


@query(f"{_FREQ} select country, token, cnt, round(frac,9) frac from f")
def df_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).select("country", "token", "cnt", F.round("frac", 9).alias("frac"))


@query(f"{_FREQ} select country, array_to_string(list_sort(list(token)),',') stop from f where frac>=0.05 group by 1")
def stoplist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.stop_lists(_frequencies(spark, sf_dir)).select("country", F.array_join("stop", ",").alias("stop"))


@query(f"{_FREQ}, s as (select country, list(token) stop from f where frac>=0.05 group by 1), k as (select doc_id, t, case when stop is null then t else list_filter(t, lambda x: not list_contains(stop,x)) end k from d left join s on country=lang) select doc_id, cast(case when len(k)=0 then len(t) else len(k) end as bigint) n_core from k")
def core_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("country"), "text")
    return statistics.core_counts(d, T.tokens(T.clean_text(F.col("text"))), _frequencies(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_core")


@query(f"{_FREQ} select country, token, cnt, rn as rank from (select *, row_number() over(partition by country order by cnt desc, token) rn from f) where rn<=18")
def df_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.top_tokens(_frequencies(spark, sf_dir)).select("country", "token", "cnt", F.col("rank").cast("bigint").alias("rank"))


# --- channels and the similarity join -----------------------------------------------------------------------------


def _features_sql(records: str, channel: str) -> str:
    name, address = V.clean_sql("name"), V.clean_sql("address")
    keys = f"list_transform({V.KEYS.format('address')}, lambda x: 'd:'||x)"
    lists = {"name_token": V.TOKENS.format(name), "name_ngram": V.NGRAMS.format(f"replace({name},' ','')"), "digit_key": keys, "address": f"list_concat({keys}, list_transform({V.TOKENS.format(address)}, lambda x: 'a:'||x))"}
    return f"select distinct country, id, unnest({lists[channel]}) f from ({records})"


_TEXT_Q = "select 'all' country, item_id id, text as name, '' address from benchmark"
_TEXT_C = "select 'all' country, doc_id id, coalesce(text,'') as name, '' address from documents"


def _topk_ctes(q: str, c: str, channel: str, max_df: float, terms: int, p: str = "") -> str:
    return f"""{p}cr as ({c}), {p}qf as ({_features_sql(q, channel)}), {p}cf as ({_features_sql(c, channel)}), {p}n as (select country, count(*) n from {p}cr group by 1),
 {p}df as (select country, f, any_value(n) n, count(*) df, ln(any_value(n)/(1+count(*)))+1 idf from {p}cf join {p}n using(country) group by all having count(*)<=greatest(2,floor({max_df}*any_value(n)))),
 {p}cw as (select country, id, f, idf/sqrt(sum(idf*idf) over(partition by country,id)) w from {p}cf join {p}df using(country,f)),
 {p}q1 as (select * from (select country, id, f, idf, row_number() over(partition by country,id order by idf desc,f) r from {p}qf join {p}df using(country,f)) where r<={terms}),
 {p}qw as (select country, id, f, idf/sqrt(sum(idf*idf) over(partition by country,id)) w from {p}q1),
 {p}sc as (select a.country, a.id q, b.id c, round(sum(a.w*b.w),9) s from {p}qw a join {p}cw b using(country,f) group by all),
 {p}hits as (select country, q, c, s score, row_number() over(partition by country,q order by s desc,c)-1 rank0 from {p}sc)"""


def _topk_sql(q: str, c: str, channel: str, max_df: float, terms: int, k: int) -> str:
    return f"with {_topk_ctes(q, c, channel, max_df, terms)} select country, q, c, rank0, round(score,6) score from hits where rank0<{k}"


def _hits(spark: SparkSession, sf_dir: str, view, channel: str, max_df: float, k: int) -> DataFrame:
    q, c = view(spark, sf_dir)
    return similarity.topk_join(q, c, replace(similarity.CHANNELS[channel], max_df=max_df), k).select("country", "q", "c", F.col("rank0").cast("bigint").alias("rank0"), F.round("score", 6).alias("score"))


@query(_topk_sql(_TEXT_Q, _TEXT_C, "name_token", 0.05, 14, 5))
def topk_join_name_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, V.texts, "name_token", 0.05, 5)


@query(_topk_sql(V.PARTY_Q, V.PARTY_C, "name_ngram", 0.3, 20, 5))
def topk_join_name_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, V.parties, "name_ngram", 0.3, 5)


@query(_topk_sql(V.PARTY_Q, V.PARTY_C, "address", 0.2, 20, 5))
def topk_join_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, V.parties, "address", 0.2, 5)


@query(_topk_sql(V.PARTY_Q, V.PARTY_C, "digit_key", 0.05, 16, 5))
def topk_join_digit_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, V.parties, "digit_key", 0.05, 5)


@query(f"with {_topk_ctes(_TEXT_Q, _TEXT_C, 'name_token', 0.01, 14)} select f feature, df, round(idf,9) idf from df")
def channel_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.texts(spark, sf_dir)[1]
    return similarity.idf_table(c, similarity.features_of(c, similarity.CHANNELS["name_token"]), 0.01).select("feature", "df", F.round("idf", 9).alias("idf"))


@query(f"with {_topk_ctes(V.PARTY_Q, V.PARTY_C, 'address', 0.2, 20)} select country, id, f feature, round(w,9) w from cw")
def postings_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.parties(spark, sf_dir)[1]
    own = similarity.features_of(c, similarity.CHANNELS["address"])
    return similarity.postings(own, similarity.idf_table(c, own, 0.2)).select("country", "id", "feature", F.round("w", 9).alias("w"))


_PARTY_CHANNELS = [replace(similarity.CHANNELS[n], max_df=m) for n, m in (("name_ngram", 0.3), ("address", 0.2))]


def _party_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = V.parties(spark, sf_dir)
    return similarity.channel_hits(q, c, _PARTY_CHANNELS)


_HITS = f"with {_topk_ctes(V.PARTY_Q, V.PARTY_C, 'name_ngram', 0.3, 20, 'a_')}, {_topk_ctes(V.PARTY_Q, V.PARTY_C, 'address', 0.2, 20, 'b_')}, h as (select 0 ch, 1.0 weight, * from a_hits where rank0<1000 union all select 1, 1.0, * from b_hits where rank0<1000), fused as (select country, q, c, sum(weight/(20+rank0)) rrf, count(*) n_hit, min(rank0) best_rank from h group by all)"


@query(f"{_HITS} select country, q, c, round(rrf,9) rrf, n_hit, best_rank from fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.fuse_rrf(_party_hits(spark, sf_dir)).select("country", "q", "c", F.round("rrf", 9).alias("rrf"), "n_hit", F.col("best_rank").cast("bigint").alias("best_rank"))


@query(f"{_HITS} select country, q, c, round(sum(weight*score),6) fused from h group by all")
def fusion_sum_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.fuse_sum(_party_hits(spark, sf_dir)).select("country", "q", "c", F.round("fused", 6).alias("fused"))


@query(f"{_HITS}, z as (select *, stddev_pop(score) over w sd, avg(score) over w mu from h window w as (partition by country,ch,q)) select country, q, c, round(sum(case when sd>1e-9 then (score-mu)/sd else 0 end),5) fused from z group by all")
def fusion_znorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.fuse_znorm(_party_hits(spark, sf_dir)).select("country", "q", "c", F.round("fused", 5).alias("fused"))


@query(f"{_HITS}, m as (select country, q, c, min(rank0*10+ch) place from h group by all) select country, q, c, row_number() over(partition by country,q order by place,c) as position from m")
def fusion_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.fuse_quota(_party_hits(spark, sf_dir)).withColumn("position", F.col("position").cast("bigint"))


@query(f"{_HITS} select country, count(distinct case when n_hit=2 then q||'-'||c end) in_both, count(*) in_any from fused group by 1")
def union_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.fuse_rrf(_party_hits(spark, sf_dir)).groupBy("country").agg(F.count_if(F.col("n_hit") == 2).alias("in_both"), F.count("*").alias("in_any"))


# --- pairs --------------------------------------------------------------------------------------------------------


def _party_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = V.parties(spark, sf_dir)
    fused = similarity.fuse_rrf(_party_hits(spark, sf_dir)).withColumn("is_s3", F.col("c") % 2)
    return pairs.with_forms(fused, pairs.forms(q), pairs.forms(c))


def _dealt_parties(spark: SparkSession, sf_dir: str) -> compare.Dealt:
    q, c = V.parties(spark, sf_dir)
    return compare.fused(q, c, _PARTY_CHANNELS, compare.records(q), compare.records(c.withColumn("is_s3", F.col("id") % 2), "is_s3"))


def _forms_sql(records: str) -> str:
    n, a = V.clean_sql("name"), V.clean_sql("address")
    return f"select country, id, address, {n} nc, {a} ac, list_distinct({V.NGRAMS.format(f'replace({n},chr(32),chr(0))').replace('chr(0)', chr(39) * 2).replace('chr(32)', chr(39) + ' ' + chr(39))}) nt, list_distinct({V.TOKENS.format(n)}) nk, list_distinct({V.TOKENS.format(a)}) ak, {V.KEYS.format('address')} dk from ({records})"


_PAIRS = f"{_HITS}, fq as ({_forms_sql(V.PARTY_Q)}), fc as ({_forms_sql(V.PARTY_C)}), pr as (select f.*, a.nc qn, b.nc cn, a.ac qa, b.ac ca, a.nt qt, b.nt ct, a.nk qk, b.nk ck, a.ak qak, b.ak cak, a.dk qd, b.dk cd from fused f join fq a on a.country=f.country and a.id=q join fc b on b.country=f.country and b.id=c)"


def _jac(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a},{b}))/nullif(len(list_distinct(list_concat({a},{b}))),0),0)"


def _grams_of(c: str) -> str:
    return f"list_distinct({V.NGRAMS.format(f'replace({c},chr(32),repeat(chr(32),0))')})"


@query(f"{_PAIRS} select country, q, c, round({_jac('qt', 'ct')},6) tri, round({_jac('qk', 'ck')},6) tok, round({_jac('qak', 'cak')},6) addr_tok, round({_jac('qd', 'cd')},6) digit, cast(len(list_intersect(qd,cd)) as double) shared, cast(case when qa='' or ca='' then 1 else 0 end as double) addr_missing, round(least(length(qn),length(cn))/greatest(length(qn),length(cn)),6) len_ratio from pr")
def pair_set_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pairs.set_features()
    rows = _party_pairs(spark, sf_dir)
    return rows.select("country", "q", "c", *[F.round(f[a], 6).alias(b) for a, b in (("name_trigram_jaccard", "tri"), ("name_token_jaccard", "tok"), ("addr_token_jaccard", "addr_tok"), ("digit_jaccard", "digit"), ("digit_shared_count", "shared"), ("addr_missing", "addr_missing"), ("name_len_ratio", "len_ratio"))])


@query(f"{_PAIRS} select country, q, c, round(jaro_winkler_similarity(qn,cn),6) jw, case when qa='' or ca='' then 0 else round(jaro_winkler_similarity(qa,ca),6) end addr_jw from pr")
def pair_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pairs.string_features()
    return _party_pairs(spark, sf_dir).select("country", "q", "c", F.round(f["name_jaro_winkler"], 6).alias("jw"), F.round(f["addr_jaro_winkler"], 6).alias("addr_jw"))


@query()
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 16 base features; the token set ratio has no SQL."""
    return pairs.dealt_features(_dealt_parties(spark, sf_dir), pairs.BASE)


@query()
def linear_rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on whether the address number is shared, score by the folded linear model, keep ten a query."""
    dealt = _dealt_parties(spark, sf_dir)
    rows = dealt.compared(["name_trigram_jaccard", "addr_token_jaccard", "digit_shared_count"], {x: pairs.VALUES[x] for x in ("rrf_score", "best_channel_rank")}, pack=True).persist(StorageLevel.DISK_ONLY)
    model = learning.fit_linear_packed(rows, ["name_trigram_jaccard", "addr_token_jaccard", "rrf_score", "best_channel_rank"], "digit_shared_count")
    return similarity.top_per_query(learning.best_of_packed(rows, model, 10, (dealt.q_type, dealt.c_type)), "score", 10).select("country", "q", "c", "rank", "score")


@query(f"{_PAIRS}, g as (select *, {_grams_of('qa')} qg, {_grams_of('ca')} cg from pr) select country, q, c, round(.14*{_jac('qt', 'ct')}+.10*{_jac('qk', 'ck')}+.10*jaro_winkler_similarity(qn,cn)+.20*{_jac('qg', 'cg')}+.20*{_jac('qak', 'cak')}+.16*(case when qa='' or ca='' then 0 else jaro_winkler_similarity(qa,ca) end)+.10*{_jac('qd', 'cd')},6) score from g")
def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical surrogate: all seven weighted similarities."""
    made = pairs.dealt_features(_dealt_parties(spark, sf_dir), list(pairs.LEXICAL_WEIGHTS))
    return made.select("country", "q", "c", F.round(pairs.lexical_score(), 6).alias("score"))


_AF = f"with q as ({_forms_sql(V.PARTY_Q)}), c as ({_forms_sql(V.PARTY_C)}), n as (select country, count(*) n from c group by 1), adf as (select country, t, count(*) df from (select country, unnest(ak) t from c) group by all)"


@query(f"{_AF}, rare as (select country, t from adf join n using(country) where df<=greatest(1,floor(.05*n))), qr as (select country, id q, unnest(ak) t from q), cr as (select country, id c, unnest(ak) t from c) select country, q, c, count(*) shared from qr join rare using(country,t) join cr using(country,t) group by all")
def rare_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = (pairs.forms(x) for x in V.parties(spark, sf_dir))
    df = pairs.address_df(c)
    rare = [pairs.rare_tokens(x, df, 0.05).select("country", F.col("id").alias(n), F.explode("rare").alias("t")) for x, n in ((q, "q"), (c, "c"))]
    return rare[0].join(rare[1], ["country", "t"]).groupBy("country", "q", "c").agg(F.count("*").alias("shared"))


_LOC = "list_distinct(list_filter(regexp_split_to_array(array_to_string(string_split(address,',')[-2:],' '),'\\s+'), lambda x: x<>''))"


@query(f"{_AF}, l as (select 'q' side, country, id, unnest({_LOC}) t from q where len(string_split(address,','))>1 union all select 'c', country, id, unnest({_LOC}) from c where len(string_split(address,','))>1), w as (select side, country, id, t, ln(1+n/(1+coalesce(df,n))) w from l join n using(country) left join adf using(country,t)), s as (select side, country, id, sum(w) s from w group by all), b as (select a.country, a.id q, c.id c, sum(a.w) sh from w a join w c on a.side='q' and c.side='c' and a.country=c.country and a.t=c.t group by all) select b.country, q, c, round(sh/(x.s+y.s-sh),6) agreement from b join s x on x.side='q' and x.country=b.country and x.id=q join s y on y.side='c' and y.country=b.country and y.id=c")
def location_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = V.parties(spark, sf_dir)
    return pairs.agreeing_pairs(q, c, pairs.address_df(pairs.forms(c)))


_S = f"with s as ({V.SCORED})"


@query(f"{_S} select country, q, c, row_number() over(partition by country,q order by p desc,c) candidate_rank, round(max(p) over w-p,6) margin, round(case when abs(max(p) over w)>1e-12 then p/max(p) over w else 0 end,6) ratio, count(*) over w n from s window w as (partition by country,q)")
def forward_rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pairs.forward_ranks(V.scored(spark, sf_dir), "p")
    return r.select("country", "q", "c", F.col("candidate_rank").cast("bigint").alias("candidate_rank"), F.round("score_margin_to_best", 6).alias("margin"), F.round("score_ratio_to_best", 6).alias("ratio"), F.col("candidate_count").alias("n"))


@query(f"{_S} select country, q, c, row_number() over(partition by country,c order by p desc,q) reverse_rank from s")
def reverse_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.reverse_ranks(V.scored(spark, sf_dir), "p").select("country", "q", "c", F.col("reverse_rank").cast("bigint").alias("reverse_rank"))


# --- decisions ----------------------------------------------------------------------------------------------------


def _decide_sql(t: float, m: float, exclusive: bool) -> str:
    kept = f"e as (select *, max(p) over(partition by country,q) best from s), k as (select *, row_number() over(partition by country,c order by p desc,q) rn from e where p>={t} and p>=best-{m})"
    return f"{_S}, {kept}, d as (select country, q, c from k {'where rn=1' if exclusive else ''})"


@query(f"{_decide_sql(0.3, 0.05, True)} select * from d")
def decide_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decide(V.scored(spark, sf_dir), 0.3, 0.05)


@query(f"{_decide_sql(0.3, 0.05, False)} select * from d")
def decide_nonexclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decide(V.scored(spark, sf_dir), 0.3, 0.05, exclusive=False)


@query(f"{_S}, g as (select * from (values (0.2),(0.3),(0.4)) t(threshold), (values (0.02),(0.1)) m(margin), (values (false),(true)) e(exclusive)), e as (select *, max(p) over(partition by country,q) best from s), k as (select g.*, e.*, row_number() over(partition by threshold,margin,exclusive,country,c order by p desc,q) rn from e, g where p>=threshold and p>=best-margin) select cast(threshold as double) threshold, cast(margin as double) margin, exclusive, count(*) n, count(distinct country||'-'||q) n_q from k where not exclusive or rn=1 group by all")
def threshold_margin_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = decisions.decide_grid(V.scored(spark, sf_dir), [0.2, 0.3, 0.4], [0.02, 0.1])
    return g.groupBy("threshold", "margin", "exclusive").agg(F.count("*").alias("n"), F.count_distinct("country", "q").alias("n_q"))


@query(f"{_decide_sql(0.3, 0.05, True)} select q, array_to_string(list_sort(list(c)),',') matched from d group by 1")
def collect_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.id_lists(decisions.decide(V.scored(spark, sf_dir), 0.3, 0.05)).select("q", F.array_join("matched", ",").alias("matched"))


@query(f"{_decide_sql(0.3, 0.05, True)} select c_custkey q, coalesce(m,'') matched from customer left join (select q, array_to_string(list_sort(list(c)),',') m from d group by 1) on q=c_custkey")
def left_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = decisions.id_lists(decisions.decide(V.scored(spark, sf_dir), 0.3, 0.05))
    return decisions.complete(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q")), lists).select("q", F.array_join("matched", ",").alias("matched"))


@query("select c_custkey q from customer where not exists (select 1 from orders where o_custkey=c_custkey and o_orderpriority='1-URGENT')")
def anti_unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q")).join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("q")), "q", "left_anti")


_T = f"t as ({V.TRUTH}), l as ({V.LISTED})"


@query(f"with {_T}, m as (select q, list_filter(ids, lambda x: x%3<>0) ids from l), r as (select 'duplicate_candidate_row' as rule, (select count(*) from (select q from l group by 1 having count(*)>1)) n union all select 'duplicate_match_row', (select count(*) from (select q from m group by 1 having count(*)>1)) union all select 'missing_candidate_row', (select count(*) from t where q not in (select q from l)) union all select 'missing_match_row', (select count(*) from t where q not in (select q from m)) union all select 'unknown_query', 0 union all select 'duplicate_in_list', 0 union all select 'match_not_candidate', 0 union all select 'owned_twice', (select count(*) from (select c from (select q, unnest(ids) c from m) group by 1 having count(distinct q)>1))) select * from r")
def audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = V.listed(spark, sf_dir)
    return decisions.audit(V.truth(spark, sf_dir).select("q"), lists, lists.withColumn("ids", F.filter("ids", lambda x: x % 3 != 0)))


@query(f"with {_T}, a as (select q, unnest(ids) c from l), b as (select q, c from a where c%7<>0), j as (select a.c x, b.c y from a full join b on a.q=b.q and a.c=b.c) select case when y is null then 'missing' when x is null then 'extra' else 'equal' end problem, count(*) n from j group by 1")
def sidecar_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = V.listed(spark, sf_dir)
    return decisions.sidecar_difference(lists, lists.select("q", F.explode("ids").alias("c")).where("c % 7 <> 0"))


@query(f"with {_T}, r as (select 'S1-'||q q, case when q%5=0 then 'S2-1,S2-1' when q%7=0 then ' S3-2' when q%11=0 then 'S1-3' when q%13=0 then 'X-1,' else 'S2-4' end s from t) select 'duplicate_id' as rule, count(*) filter (q in (select 'S1-'||q from t where q%5=0)) n from r union all select 'padded_id', count(*) filter (s=' S3-2') from r union all select 'self_match', count(*) filter (s='S1-3') from r union all select 'empty_id', count(*) filter (s='X-1,') from r union all select 'wrong_prefix', count(*) filter (s='X-1,' or s=' S3-2') from r")
def list_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    raw = F.when(q % 5 == 0, "S2-1,S2-1").when(q % 7 == 0, " S3-2").when(q % 11 == 0, "S1-3").when(q % 13 == 0, "X-1,").otherwise("S2-4")
    rows = V.truth(spark, sf_dir).select(F.concat(F.lit("S1-"), "q").alias("q"), raw.alias("list"))
    return decisions.list_violations(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"{_S} select 'p_outside' as rule, count(*) filter (p<0 or p>1) n from s union all select 'duplicate_pair', 0 n")
def pair_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.pair_violations(V.scored(spark, sf_dir))


# --- metrics ------------------------------------------------------------------------------------------------------

_E = f"with {_T}, p as (select q, list_filter(ids, lambda x: x%3=0) p from l), e as (select country, t.q, len(list_intersect(matched,coalesce(p,[]))) tp, len(coalesce(p,[])) n_p, len(matched) n_t from t left join p on p.q=t.q), f as (select *, case when n_t=0 then case when n_p=0 then 1.0 else 0.0 end when n_p=0 or tp=0 then 0.0 else 1.25*(tp/n_p)*(tp/n_t)/(0.25*(tp/n_p)+tp/n_t) end::double score from e)"


def _entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = V.listed(spark, sf_dir).select("q", F.filter("ids", lambda x: x % 3 == 0).alias("predicted"))
    return metrics.entity_scores(V.truth(spark, sf_dir), predicted)


@query(f"{_E} select coalesce(country,'ALL') country, count(*) entities, round(avg(score),9) macro_f, round(avg(score) filter (n_t=0),9) singleton_accuracy, round(avg(score) filter (n_t>0),9) matched_f, round(sum(tp)/nullif(sum(n_p),0),9) micro_precision, round(sum(tp)/nullif(sum(n_t),0),9) micro_recall, sum(tp)::bigint tp, (sum(n_p)-sum(tp))::bigint fp, (sum(n_t)-sum(tp))::bigint fn from f group by rollup(country)")
def macro_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.macro_report(_entity_scores(spark, sf_dir))
    rounded = {c: F.round(c, 9) for c in ("macro_f", "singleton_accuracy", "matched_f", "micro_precision", "micro_recall")}
    return r.withColumns(rounded)


@query(f"with {_T}, z as (select cast(c_nationkey as varchar) country, count(*)*3 corpus from customer group by 1), b as (select country, corpus, len(matched) t, len(coalesce(ids,[])) k, len(list_intersect(matched,coalesce(ids,[]))) hit from t left join l using(q) join z using(country)) select coalesce(country,'ALL') country, count(*) entities, round(avg(hit/t) filter (t>0),9) macro_recall, round(sum(hit)/sum(t),9) micro_recall, round(avg(k),9) avg_list, max(k)::bigint max_list, round(1-avg(k/corpus),9) reduction, count(*) filter (t>0 and hit=0) all_missed, count(*) filter (t=0) singletons from b group by rollup(country)")
def blocking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = V.truth(spark, sf_dir).groupBy("country").agg((F.count("*") * 3).alias("corpus"))
    lists = V.listed(spark, sf_dir).withColumn("ids", F.filter("ids", lambda x: x >= 0))
    r = metrics.blocking_quality(V.truth(spark, sf_dir), lists, sizes)
    return r.withColumns({c: F.round(c, 9) for c in ("macro_recall", "micro_recall", "avg_list", "reduction")} | {"max_list": F.col("max_list").cast("bigint")})


_R = f"{_S}, r as (select *, row_number() over(partition by country,q order by p desc,c) as rank, case when c%4=0 then 1 else 0 end as label from s)"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = V.scored(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("country", "q").orderBy(F.desc("p"), "c")))
    return ranked.withColumn("label", (F.col("c") % 4 == 0).cast("int"))


@query(f"{_R} select round(sum(case when rank<=1 then label else 0 end)/sum(label),9) r1, round(sum(case when rank<=3 then label else 0 end)/sum(label),9) r3, round(sum(case when rank<=10 then label else 0 end)/sum(label),9) r10 from r")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.recall_at(_ranked(spark, sf_dir), [1, 3, 10])
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@query(f"{_R} select rank::bigint as rank, count(*) n from r where label=1 group by all")
def rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).where("label = 1").groupBy(F.col("rank").cast("bigint").alias("rank")).agg(F.count("*").alias("n"))


@query(f"{_R}, d as (select unnest([2,5,10]) depth), x as (select depth, r.*, row_number() over(partition by depth,country,q order by (c*37)%1009 desc,c) r2 from r, d where rank<=depth) select depth, round(sum(case when r2<=2 then label else 0 end)/(select sum(label) from r),9) recall from x group by 1")
def depth_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _ranked(spark, sf_dir).select("country", "q", "c", F.col("p").alias("rrf"), "label", (F.col("c") * 37 % 1009).alias("score"))
    return metrics.depth_recall(pool, [2, 5, 10], 2).select("depth", F.round("recall", 9).alias("recall"))


_L = f"with d as ({V.LABELLED})"


@query(f"{_L}, r as (select 'n_chars' feature, n_chars::double v, label from d union all select 'mark_share', mark_share, label from d), k as (select feature, v, label, rank() over(partition by feature order by v)+(count(*) over(partition by feature,v)-1)/2 rk from r) select feature, round(a,9) auc, round(greatest(a,1-a),9) neutral from (select feature, (sum(rk) filter (label=1)-sum(label)*(sum(label)+1)/2)/(sum(label)*(count(*)-sum(label))) a from k group by 1)")
def feature_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.labelled(spark, sf_dir)
    out = [metrics.auc(d, x).select(F.lit(x).alias("feature"), F.round("auc", 9).alias("auc"), F.round("neutral", 9).alias("neutral")) for x in ("n_chars", "mark_share")]
    return out[0].union(out[1])


@query(f"{_L}, v as (select n_chars, sum(label) pos, count(*) n from d group by 1), w as (select pos, sum(pos) over o/sum(n) over o prec from v window o as (order by n_chars desc)) select round(sum(prec*pos)/sum(pos),9) average_precision from w")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(V.labelled(spark, sf_dir), "n_chars").select(F.round("average_precision", 9).alias("average_precision"))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 replicates; random draws have no SQL, the test holds them against draws of entities."""
    return metrics.bootstrap(_entity_scores(spark, sf_dir))


@query(f"with {_T} select count(*) n, round(avg(len(ids)),9) mean_candidates, quantile_cont(len(ids),0.5)::double p50, round(quantile_cont(len(ids),0.9),9)::double p90, round(quantile_cont(len(ids),0.99),9)::double p99, avg((len(ids)=0)::int) empty_rate, (select round(avg((len(matched)=0)::int),9) from t) singleton_rate, (select round(avg(len(matched)),9) from t) mean_matches from l")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.drift(V.listed(spark, sf_dir), V.truth(spark, sf_dir).select("q", F.col("matched").alias("ids")))
    return r.withColumns({c: F.round(c, 9) for c in ("mean_candidates", "p90", "p99", "singleton_rate", "mean_matches")})


@query(f"with {_T} select len(matched)::bigint matches, count(*) n from t group by 1")
def gt_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.truth_shape(V.truth(spark, sf_dir)).select(F.col("matches").cast("bigint").alias("matches"), "n")


@query(f"with {_T} select c, count(distinct q) k from (select q, unnest(matched) c from t) group by 1 having count(distinct q)>1")
def one_to_many_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.claimed_often(V.truth(spark, sf_dir))


@query(f"with {_T} select distinct o_orderkey%997 c from orders where o_orderkey%997 not in (select unnest(matched) from t)")
def distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 997).alias("c")).distinct()
    return statistics.distractors(corpus, V.truth(spark, sf_dir))


@query(f"{_PAIRS} select coalesce(country,'ALL') country, count(*) n_pairs, sum(a::int)::bigint by_name, sum(b::int)::bigint by_address, sum((a or b)::int)::bigint by_either, sum((b and not a)::int)::bigint only_address, sum((a and not b)::int)::bigint only_name from (select country, {_jac('qt', 'ct')}>=.15 a, {_jac('qak', 'cak')}>=.2 or len(list_intersect(qd,cd))>0 b from pr) group by rollup(country)")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pairs.set_features()
    rows = _party_pairs(spark, sf_dir).select("country", f["name_trigram_jaccard"].alias("name_j"), f["addr_token_jaccard"].alias("addr_j"), (f["digit_shared_count"] > 0).alias("shared_digits"))
    return statistics.reachability(rows)


@query(f"with r as ({V.PARTY_C}) select count(*) n_rows, count(*) filter (not starts_with(name,'Customer#')) bad_prefix, count(distinct country) countries, count(*) filter (trim(name)='') blank_names, count(*) filter (trim(address)='') blank_addresses, count(*)-count(distinct id) duplicate_ids from r")
def schema_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.parties(spark, sf_dir)[1]
    return statistics.table_report(c.withColumn("id", F.col("name")), "Customer#")


@query(f"with {_T} select count(*) n_rows, sum(len(ids))::bigint n_pairs, min(len(ids))::bigint least, max(len(ids))::bigint most, count(*) filter (len(ids)=0) n_empty from l")
def inspect_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = statistics.candidate_report(V.listed(spark, sf_dir))
    return r.select("n_rows", "n_pairs", F.col("least").cast("bigint").alias("least"), F.col("most").cast("bigint").alias("most"), "n_empty")


@query(f"with {_T} select q, unnest(ids) c, generate_subscripts(ids,1)::bigint as position from l")
def expand_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.expanded(V.listed(spark, sf_dir)).withColumn("position", F.col("position").cast("bigint"))


# --- learning -----------------------------------------------------------------------------------------------------


_SPLIT = f"""with {_T}, r as (select country, len(matched)=0 singleton, q id from t), z as (select country, singleton, count(*) n from r group by all),
 x as (select *, least(100,sum(n) over())*n/sum(n) over() e from z),
 d as (select country, singleton, n, floor(e)+(row_number() over(order by e-floor(e) desc,country,singleton)<=least(100,sum(n) over())-sum(floor(e)) over())::int d from x),
 y as (select *, least(200,sum(n-d) over()) most, least(200,sum(n-d) over())*(n-d)/sum(n-d) over() e from d),
 f as (select country, singleton, d, floor(e)+(row_number() over(order by e-floor(e) desc,country,singleton)<=any_value(most) over()-sum(floor(e)) over())::int f from y),
 h as (select *, ('0x'||substring(md5(concat_ws(':','42',id)),1,15))::bigint h from r),
 p as (select h.*, d, f, row_number() over(partition by country,singleton order by h,id) rn from h join f using(country,singleton))"""


@query(f"{_SPLIT} select country, singleton, id, case when rn<=d then 'dev' else 'confirm' end part from p where rn<=d+f")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By MD5, which SQL has; at most 100 and 200 records where there are so many."""
    rows = V.truth(spark, sf_dir).select("country", (F.size("matched") == 0).alias("singleton"), F.col("q").alias("id"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("42"), "id")), 1, 15), 16, 10).cast("bigint")
    n = rows.count()
    return learning.stratified_split(rows, min(100, n), min(200, max(n - 100, 0)), key=key)


@query("select doc_id, case when h%100<70 then 'fit' when h%100<85 then 'cal' else 'tune' end part from (select doc_id, ('0x'||substring(md5(doc_id::varchar),1,8))::bigint h from documents)")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    return table(spark, sf_dir, "documents").select("doc_id", F.when(h < 70, "fit").when(h < 85, "cal").otherwise("tune").alias("part"))


@query()
def entity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.entity_split(F.col("doc_id").cast("string")).alias("part"))


@query("with r as (select lang, doc_id, row_number() over(partition by lang order by md5(concat_ws(':','42',doc_id)),doc_id) rn from documents) select lang, doc_id from r where rn<=20")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.hash_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 20)


@query(f"{_L} select round(avg(n_chars),6) mean, round(stddev_pop(n_chars),6) sd, round(avg(mark_share),9) mark_mean, round(stddev_pop(mark_share),9) mark_sd from d")
def standard_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.labelled(spark, sf_dir).agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 6).alias("sd"), F.round(F.avg("mark_share"), 9).alias("mark_mean"), F.round(F.stddev_pop("mark_share"), 9).alias("mark_sd"))


@query()
def logreg_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.labelled(spark, sf_dir)
    return rows.select("doc_id", "label", learning.fit_linear(rows, ["n_chars", "mark_share", "n_lines"]).column().alias("score"))


@query()
def gbt_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.labelled(spark, sf_dir).withColumn("part", T.entity_split(F.col("doc_id").cast("string"))).persist()
    features = ["n_chars", "mark_share", "n_lines"]
    model = learning.fit_calibrated(rows.where("part = 'fit'"), rows.where("part = 'cal'"), features)
    return model.transform(rows.where("part = 'tune'")).select("doc_id", "label", "p")


@query("with a as (select vec_id q, embedding e from embeddings where vec_id%100=0), s as (select q, vec_id c, list_cosine_similarity(e::double[],embedding::double[]) s from a join embeddings on vec_id<>q) select q, c, round(s,6) score from (select *, row_number() over(partition by q order by round(s,9) desc,c) rn from s) where rn<=3")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of a stated query set, one vector in a hundred, against all: in blocks, as matrix products."""
    import numpy as np
    import pandas as pd

    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("c"), F.col("embedding").cast("array<double>").alias("e"))
    asked = v.where("c % 100 = 0").withColumn("block", F.floor(F.col("c") / 100_000))
    blocks = asked.groupBy("block").agg(F.collect_list(F.struct("c", "e")).alias("asked"))
    parts = v.withColumn("shard", F.pmod("c", F.lit(8))).groupBy("shard").agg(F.collect_list(F.struct("c", "e")).alias("there"))
    tasks = parts.withColumn("one", F.lit(1)).join(blocks.withColumn("one", F.lit(1)), "one").select("asked", "there")

    def best(frames):
        for frame in frames:
            for asked_rows, there in zip(frame["asked"], frame["there"]):
                q, c = np.array([x["e"] for x in asked_rows]), np.array([x["e"] for x in there])
                qi, ci = np.array([x["c"] for x in asked_rows]), np.array([x["c"] for x in there])
                s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
                s[qi[:, None] == ci[None, :]] = -2
                at = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :3]
                yield pd.DataFrame({"q": np.repeat(qi, at.shape[1]), "c": ci[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel()})

    found = tasks.mapInPandas(best, "q bigint, c bigint, score double").where("score > -2")
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "c")
    return found.withColumn("r", F.row_number().over(w)).where("r <= 3").select("q", "c", F.round("score", 6).alias("score"))


# --- assembly -----------------------------------------------------------------------------------------------------


@query(f"{_PAIRS}, g as (select *, {_grams_of('qa')} qg, {_grams_of('ca')} cg from pr) select country, q, c, round(coalesce(len(list_intersect(qk,ck))/nullif(least(len(qk),len(ck)),0),0),6) containment, round({_jac('qg', 'cg')},6) addr_tri, round(rrf,9) rrf, n_hit::double n_hit, best_rank::double best_rank, (c%2)::double is_s3 from g")
def pair_other_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pairs.set_features()
    rows = _party_pairs(spark, sf_dir)
    return rows.select("country", "q", "c", F.round(f["name_token_containment"], 6).alias("containment"), F.round(f["addr_trigram_jaccard"], 6).alias("addr_tri"), F.round("rrf", 9).alias("rrf"), F.col("n_hit").cast("double").alias("n_hit"), F.col("best_rank").cast("double").alias("best_rank"), F.col("is_s3").cast("double").alias("is_s3"))


@query()
def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 23 features of the fused candidates; the token set ratio has no SQL."""
    q, c = V.parties(spark, sf_dir)
    return assembly.fused_feature_frame(q, c.withColumn("is_s3", F.col("id") % 2), _PARTY_CHANNELS)


_GRID = "(select * from (values " + ",".join(f"({t}::double)" for t in assembly.THRESHOLDS) + ") a(threshold), (values " + ",".join(f"({m}::double)" for m in assembly.MARGINS) + ") b(margin), (values (false),(true)) c(exclusive))"
_SETTINGS = f"""{_S}, t as ({V.TRUTH}), g as {_GRID}, e as (select *, max(p) over(partition by country,q) best from s),
 k as (select g.*, e.*, row_number() over(partition by threshold,margin,exclusive,country,c order by p desc,q) rn from e, g where p>=threshold and p>=best-margin),
 u as (select threshold, margin, exclusive, k.q, count(*) n_p, count(*) filter (list_contains(matched,c)) tp, any_value(len(matched)) n_t from k join t using(q) where not exclusive or rn=1 group by all),
 f as (select *, case when n_t=0 or tp=0 then 0 else 1.25*(tp/n_p)*(tp/n_t)/(0.25*(tp/n_p)+tp/n_t) end sc from u),
 w as (select g.threshold, g.margin, g.exclusive, round((coalesce(sum(sc),0)+(select count(*) from t where len(matched)=0)-count(*) filter (n_t=0))/(select count(*) from t),9) macro_f05 from g left join f using(threshold,margin,exclusive) group by all)"""


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.setting_scores(V.scored(spark, sf_dir), V.truth(spark, sf_dir)).withColumn("macro_f05", F.round("macro_f05", 9))


@query(f"{_SETTINGS} select * from w")
def setting_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settings(spark, sf_dir)


@query(f"{_SETTINGS} select * from w where exclusive order by macro_f05 desc, threshold, margin limit 1")
def best_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.best_setting(_settings(spark, sf_dir))


@query(f"with {_T}, a as (select q, unnest(ids) c from l) select a.q, c, coalesce(list_contains(matched,c),false)::int as label from a left join t using(q)")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.labelled(V.listed(spark, sf_dir).select("q", F.explode("ids").alias("c")), V.truth(spark, sf_dir)).select("q", "c", "label")


@query(f"with {_T} select q, len(ids)::bigint n from l where q in (select q from t where len(matched)>0)")
def holdout_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = V.truth(spark, sf_dir).where("size(matched) > 0")
    return assembly.of_queries(V.listed(spark, sf_dir), held).select("q", F.size("ids").cast("bigint").alias("n"))


@query(f"with {_T}, a as (select t.q, coalesce(ids,[]) ids from t left join l using(q)) select count(*) entities, count(*) filter (len(ids)=0) predicted_singletons, round(avg((len(ids)=0)::int),9) singleton_rate, sum(len(ids))::bigint matched_ids from a")
def assembly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.listed(spark, sf_dir).select("q", F.explode("ids").alias("c"))
    _, matches = assembly.assembled(V.truth(spark, sf_dir), rows, rows)
    return assembly.assembly_report(matches).withColumn("singleton_rate", F.round("singleton_rate", 9))


@query(f"with {_T} select len(ids)::bigint size, count(*) n, round(count(*)/sum(count(*)) over(),9) as share, len(ids)=10 is_full from l group by len(ids)")
def size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.size_distribution(V.listed(spark, sf_dir), 10).withColumns({"size": F.col("size").cast("bigint"), "share": F.round("share", 9)})


@query("select cast(s_nationkey as varchar) country, s_suppkey q, s_suppkey*7 c from supplier where not exists (select 1 from customer where c_nationkey=s_nationkey and c_custkey=s_suppkey*7)")
def outside_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = V.parties(spark, sf_dir)
    return assembly.outside_country(q.select("country", F.col("id").alias("q"), (F.col("id") * 7).alias("c")), c)


@query("select id, count(*) n from (select s_suppkey id from supplier union all select c_custkey from customer) group by 1 having count(*)>1")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = V.parties(spark, sf_dir)
    return assembly.id_collisions({"s2": q, "s3": c})

