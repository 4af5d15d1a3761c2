"""Builders of DuckDB statements for the registry."""

from __future__ import annotations


def _entities(x: str) -> str:
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


_STRIPPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
CLEAN = f"trim(regexp_replace({_entities(_STRIPPED)}, '\\s+', ' ', 'g'))"
TITLE = "regexp_extract(html, '<h1>(.*?)</h1>', 1)"
LEXICAL = "array_to_string(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-zа-я0-9]+'), ' ')"


def _terms(table: str, key: str, text: str, analyzer: str) -> str:
    if analyzer == "word":
        return f"""(with t as (select {key} as id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}') as t from {table})
            select id, unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) as term from t)"""
    return f"""(with w as (select {key} as id, unnest(string_split(trim(regexp_replace(lower({text}), '\\s+', ' ', 'g')), ' ')) as w from {table}),
        p as (select id, ' ' || w || ' ' as w from w where w <> ''),
        n as (select id, w, n from p, (select unnest([3, 4, 5]) as n) where n = 3 or length(w) >= n),
        o as (select id, w, n, unnest(generate_series(1, greatest(length(w) - n + 1, 1))) as i from n)
        select id, substr(w, i, n) as term from o)"""


def tfidf(ct: str, ck: str, cx: str, qt: str, qk: str, qx: str, analyzer: str, min_df: int = 1, sublinear: bool = False) -> str:
    tf = "1 + ln(tf)" if sublinear else "tf"
    return f"""
    with ctf as (select id, term, count(*) as tf from {_terms(ct, ck, cx, analyzer)} group by 1, 2),
    qtf as (select id, term, count(*) as tf from {_terms(qt, qk, qx, analyzer)} group by 1, 2),
    idf as (select term, ln((1 + (select count(*) from {ct})) / (1 + count(*))) + 1 as idf from ctf group by 1 having count(*) >= {min_df}),
    cw as (select id, term, ({tf}) * idf as w from ctf join idf using (term)), qw as (select id, term, ({tf}) * idf as w from qtf join idf using (term)),
    cn as (select id, sqrt(sum(w * w)) as n from cw group by 1), qn as (select id, sqrt(sum(w * w)) as n from qw group by 1)
    select q.id as query_id, c.id as article_id, sum(q.w / qn.n * c.w / cn.n) as score
    from qw q join cw c using (term) join cn on cn.id = c.id join qn on qn.id = q.id group by 1, 2"""


def query_similarity(rt: str, rk: str, rx: str, tt: str, tk: str, tx: str, word: float = 0.3, char: float = 0.7, min_df: int = 1) -> str:
    lex = lambda x: f"array_to_string(regexp_extract_all(translate(lower({x}), 'ё', 'е'), '[a-zа-я0-9]+'), ' ')"
    w = tfidf(rt, rk, lex(rx), tt, tk, lex(tx), "word", 1, True)
    c = tfidf(rt, rk, lex(rx), tt, tk, lex(tx), "char", min_df, True)
    return f"select query_id as target_id, article_id as ref_id, sum(score) as sim from (select query_id, article_id, {word} * score as score from ({w}) union all select query_id, article_id, {char} * score from ({c})) group by 1, 2"


def transfer_sim(targets: str = "vec_id % 5 = 0", refs: str = "vec_id % 5 <> 0") -> str:
    return f"select t.vec_id as target_id, r.vec_id as ref_id, list_dot_product(t.embedding::double[], r.embedding::double[]) as sim from (select * from embeddings where {targets}) t cross join (select * from embeddings where {refs}) r"


LABELS = "select vec_id as ref_id, label::bigint as article_id from embeddings"
DOUBLE = "select distinct vec_id as ref_id, unnest([label::bigint, vec_id % 7]) as article_id from embeddings"


def _transfer(p: dict, sim: str = "sim") -> str:
    return f"select target_id as query_id, article_id, sum(pow(greatest(sim - {p['threshold']}, 0), {p['power']})) as raw from (select *, row_number() over (partition by target_id order by round(sim, 9) desc, ref_id) as r from {sim}) join lab using (ref_id) where r <= {p['neighbors']} group by 1, 2"


def memory(p: dict) -> str:
    return f"""select query_id, article_id, s / greatest(max(s) over (partition by query_id), 1e-8) as score from (
        select query_id, article_id, raw / pow(greatest(f, 1), {p['frequency_power']}) as s from ({_transfer(p)}) join (select article_id, count(*) as f from lab group by 1) using (article_id))"""


_SUM = """ex as (select query_id, b as article_id, sum(score * c) as s from {join} group by 1, 2),
exs as (select query_id, article_id, .15 * s / greatest(max(s) over (partition by query_id), 1e-8) as score from ex),
tot as (select query_id, article_id, sum(score) as s from (select query_id, article_id, score from base union all select query_id, article_id, score from exs) group by 1, 2),
scaled as (select query_id, article_id, s / greatest(max(s) over (partition by query_id), 1e-8) as score from tot)"""
EXPAND = """fr as (select article_id, count(*) as f from lab group by 1),
co as (select x.article_id as a, y.article_id as b, count(*) as n from lab x join lab y on x.ref_id = y.ref_id and x.article_id <> y.article_id group by 1, 2),
cs as (select a, b, n / greatest(sqrt(fa.f * fb.f), 1e-8) as c from co join fr fa on fa.article_id = a join fr fb on fb.article_id = b),
""" + _SUM.format(join="base join cs on base.article_id = cs.a")


def _held_out(p: dict, cooc: bool, exclude: str, own: str, labels: str | None = None, digits: int = 6) -> str:
    """Statement where each target learns from references for which `exclude` is false."""
    lab = labels or (DOUBLE if cooc else LABELS)
    head = f"""with all_sim as ({transfer_sim('true', 'true')}), lab as ({lab}), sim as (select * from all_sim where not ({exclude})),
    q as (select vec_id as query_id from embeddings),
    fr as (select q.query_id, l.article_id, count(*) as f from q join lab l on not ({own}) group by 1, 2),
    rawt as ({_transfer(p)}),
    base as (select query_id, article_id, s / greatest(max(s) over (partition by query_id), 1e-8) as score from (select query_id, article_id, raw / pow(greatest(coalesce(f, 0), 1), {p['frequency_power']}) as s from rawt left join fr using (query_id, article_id)))"""
    if not cooc:
        return head + f" select query_id, article_id, round(score, {digits}) as score from base"
    return head + f""",
    xy as (select x.ref_id, x.article_id as a, y.article_id as b from lab x join lab y on x.ref_id = y.ref_id and x.article_id <> y.article_id),
    co as (select q.query_id, a, b, count(*) as n from q join xy l on not ({own}) group by 1, 2, 3),
    cs as (select co.query_id, a, b, n / greatest(sqrt(fa.f * fb.f), 1e-8) as c from co join fr fa on fa.query_id = co.query_id and fa.article_id = a join fr fb on fb.query_id = co.query_id and fb.article_id = b),
    {_SUM.format(join='(select base.query_id, cs.b, base.score, cs.c from base join cs on base.query_id = cs.query_id and base.article_id = cs.a)')}
    select query_id, article_id, round(score, {digits}) as score from scaled"""


def loo(p: dict, cooc: bool = False) -> str:
    return _held_out(p, cooc, "target_id = ref_id", "l.ref_id = q.query_id")


def fold(p: dict, cooc: bool = False, labels: str | None = None, digits: int = 6) -> str:
    return _held_out(p, cooc, "target_id % 5 = ref_id % 5", "l.ref_id % 5 = q.query_id % 5", labels, digits)


#: Labels of which some occur in one fold only.
FOLD_LABELS = "select vec_id as ref_id, label::bigint as article_id from embeddings where label % 3 <> 0 or vec_id % 5 = 1"


def fold_robust(p: dict, gate: dict) -> str:
    return f"""with t as ({transfer_sim('true', 'true')}), sim as (select * from t where target_id % 5 <> ref_id % 5), lab as ({FOLD_LABELS}),
    sl as (select target_id as query_id, article_id, max(sim) as mx, avg(abs(sim)) as av from t join lab using (ref_id) where target_id <> ref_id group by 1, 2),
    den as ({_scaled('select query_id, article_id, mx as s from sl')}), lex as ({_scaled('select query_id, article_id, av as s from sl')}), clf as (select query_id, article_id, score * score as score from den),
    dm as ({fold(p, False, FOLD_LABELS, 15)}), dir as ({_scaled(_weighted(('.15', 'lex'), ('.85', 'den')))}),
    conf as (select target_id as query_id, least(greatest((max(sim) - {gate['start']}) / {gate['width']}, 0), 1) as conf from sim group by 1),
    gm as (select query_id, article_id, score * conf as score from dm join conf using (query_id)),
    best as (select query_id, article_id from dir qualify row_number() over (partition by query_id order by round(score, 9) desc, article_id) = 1),
    top as (select query_id from best b where not exists (select 1 from lab l where l.article_id = b.article_id and l.ref_id % 5 <> b.query_id % 5)),
    sh as (select query_id, article_id, s as score from ({_weighted(('.275', 'dir'), ('-.275', 'gm'))}) where query_id in (select query_id from top)),
    robust as ({_scaled(_weighted(('.35', 'dir'), ('.45', 'gm'), ('.05', 'lex'), ('.15', 'clf'), ('1', 'sh')))})
    select query_id, article_id, round(score, 6) as score from robust"""


def _scaled(body: str) -> str:
    return f"select query_id, article_id, s / greatest(max(s) over (partition by query_id), 1e-8) as score from ({body})"


def _weighted(*channels: tuple[str, str]) -> str:
    return "select query_id, article_id, sum(s) as s from (" + " union all ".join(f"select query_id, article_id, {w} * score as s from {c}" for w, c in channels) + ") group by 1, 2"


def fusion(p: dict, last: str, gate: dict | None = None) -> str:
    memory_default = {"neighbors": 30, "power": 2.0, "threshold": 0.0, "frequency_power": 0.2}
    out = f"""with sim as ({transfer_sim()}), lab as ({LABELS} where vec_id % 5 <> 0),
    sl as (select target_id as query_id, article_id, max(sim) as mx, avg(abs(sim)) as av from sim join lab using (ref_id) group by 1, 2),
    den as ({_scaled('select query_id, article_id, mx as s from sl')}), lex as ({_scaled('select query_id, article_id, av as s from sl')}),
    dm as ({memory(p)}), lm as ({memory(memory_default)}), clf as (select query_id, article_id, score * score as score from den),
    dir as ({_scaled(_weighted(('.15', 'lex'), ('.85', 'den')))}),
    hybrid as ({_scaled(_weighted(('.35', 'dir'), ('.45', 'dm'), ('.05', 'lm'), ('.15', 'clf')))})"""
    if gate:
        out += f""",
    conf as (select target_id as query_id, least(greatest((max(sim) - {gate['start']}) / {gate['width']}, 0), 1) as conf from sim group by 1),
    gm as (select query_id, article_id, score * conf as score from dm join conf using (query_id)),
    top as (select query_id from (select *, row_number() over (partition by query_id order by round(score, 9) desc, article_id) as r from dir) where r = 1 and article_id % 3 = 0),
    sh as (select query_id, article_id, s as score from ({_weighted(('.275', 'dir'), ('-.275', 'gm'))}) where query_id in (select query_id from top)),
    robust as ({_scaled(_weighted(('.35', 'dir'), ('.45', 'gm'), ('.05', 'lm'), ('.15', 'clf'), ('1', 'sh')))})"""
    return out + " " + last


def best_chunk(top: str) -> str:
    chunks = """(select doc_id as article_id, chunk_id, doc_id * 1000000 + chunk_id as ref, lang || chr(10) || coalesce(array_to_string(w[chunk_id * 90 + 1 : chunk_id * 90 + 120], ' '), '') as text
        from (select *, unnest(generate_series(0, (greatest(len(w), 1) - 1) // 90)) as chunk_id from (select doc_id, lang, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents)))"""
    return f"""with cand as materialized (select query_id, article_id from ({top})), ch as materialized (select * from {chunks}),
    s as materialized ({query_similarity('ch', 'ref', 'text', 'benchmark', 'item_id', 'text', 0.4, 0.6, 2)}),
    j as (select cand.query_id, cand.article_id, ch.chunk_id, round(coalesce(s.sim, 0), 9) as sim from cand join ch using (article_id) left join s on s.target_id = cand.query_id and s.ref_id = ch.ref)
    select query_id, article_id, chunk_id, round(sim, 6) as sim from j qualify row_number() over (partition by query_id, article_id order by sim desc, chunk_id) = 1"""
