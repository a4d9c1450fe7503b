"""DuckDB SQL that gives the same rows as the catalogue's queries, from the tables alone."""

from __future__ import annotations

from ..functions import lexicon as lx
from ..sources.corpus import NAMED
from . import catalog as cat
from . import search as se


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def plain(x: str) -> str:
    spaces = " " * len(lx.SYMBOLS)
    bare = f"lower(trim(regexp_replace(translate(coalesce({x}, ''), {text(lx.SYMBOLS)}, '{spaces}'), '\\s+', ' ', 'g')))"
    return f"list_filter(string_split(translate({bare}, {text(''.join(lx.FOLDED))}, {text(''.join(lx.FOLDED.values()))}), ' '), lambda t: t <> '')"


def clean(x: str) -> str:
    return f"list_filter({plain(x)}, lambda t: length(t) > 1 and not list_contains({texts(lx.STOP_WORDS)}, t))"


def pairs(xs: str) -> str:
    return f"list_transform(range(1, len({xs})), lambda i: {xs}[i] || ' ' || {xs}[i + 1])"


DOCS = f"""d as (select doc_id, regexp_extract(coalesce(text, ''), '^[^\\n]*', 0) as title, regexp_replace(coalesce(text, ''), '^[^\\n]*\\n?', '') as body from documents),
f as (select doc_id, title, body, {clean("title")} as t, {clean("body")} as b from d)"""
INDEX = f"""{DOCS},
e as (select doc_id, unnest(t) as term, 1 as it, 0 as ib from f union all select doc_id, unnest(b), 0, 1 from f),
p0 as (select term, doc_id, count(*) as tf, max(it) * 0.7::double + max(ib) * 0.3::double as weight from e group by all),
p as (select *, tf / sum(tf) over (partition by doc_id) as relative, 0.5::double + 0.5::double * tf / max(tf) over (partition by doc_id) as augmented, 1 + ln(tf) as logarithm from p0),
n as (select count(distinct doc_id) as n, avg(len(t) + len(b)) as avdl from f),
t0 as (select term, count(*) as df, sum(tf)::bigint as cf from p0 group by term),
t1 as (select term, df, cf, ln((1 + n) / df) as idf, case when df < n then ln((n - df) / df) end as prob_idf from t0, n),
tm as (select * from t1 where cf > 10)"""
ITEMS = f"q as (select item_id as qid, text as query, {clean('text')} as tokens from benchmark)"
_TYPED = f"select -i as qid, {texts(cat.SEARCHES)}[i] as query from range(1, {len(cat.SEARCHES) + 1}) r(i)"
ASKED = f"q0 as (select item_id as qid, text as query from benchmark union all {_TYPED}), q as (select qid, query, {clean('query')} as tokens from q0)"
TURNS = f"q0 as (select conv_id as qid, text as query from conversations where turn = 0 union all {_TYPED}), q as (select qid, query, {clean('query')} as tokens from q0)"
QUERY_TERMS = "qt as (select qid, term, count(*) as qtf from (select qid, unnest(tokens) as term from q) group by all)"
UNIGRAMS = f"""{DOCS}, c as (select list_append(t, {text(lx.END)}) as x from f union all select list_append(b, {text(lx.END)}) from f),
u as (select word, count(*) as c from (select unnest(x) as word from c) group by word), us as (select sum(c)::bigint - 1 as total, count(*) as vocabulary from u)"""
MODELS = f"""{UNIGRAMS}, bp as (select x[i] as prev, x[i + 1] as word from (select x, unnest(range(1, len(x))) as i from c)),
bi as (select prev, word, count(*) as c from bp group by all), bs as (select prev, sum(c)::bigint as s, count(*) as continuations from bi group by prev)"""
WORDS = f"w as (select unnest({texts(cat.WORDS)}) as word union select unnest({clean('text')}) from benchmark)"
NEAR = "MAP {" + ", ".join(f"{text(c)}: {texts(near)}" for c, near in lx.NEIGHBOURS.items()) + "}"
FIRST_KEYS = text("".join(lx.KEYBOARDS["en"]))


def is_english(w: str) -> str:
    return f"({w} <> '' and contains({FIRST_KEYS}, {w}[1:1]))"


def edits(w: str) -> str:
    """One edit of the word in column w, as a list with repeats."""
    letters = f"case when {is_english(w)} then string_split({text(lx.ALPHABETS['en'])}, '') else string_split({text(lx.ALPHABETS['fa'])}, '') end"
    n = f"length({w})"
    return f"""list_concat(list_transform(range(1, {n} + 1), lambda i: {w}[:i - 1] || {w}[i + 1:]),
      list_transform(range(1, {n}), lambda i: {w}[:i - 1] || {w}[i + 1:i + 1] || {w}[i:i] || {w}[i + 2:]),
      flatten(list_transform(range(1, {n} + 1), lambda i: list_transform(coalesce(near[{w}[i:i]], []), lambda c: {w}[:i - 1] || c || {w}[i + 1:]))),
      flatten(list_transform(range(1, {n} + 2), lambda i: list_transform({letters}, lambda c: {w}[:i - 1] || c || {w}[i:]))))"""


def swap(w: str) -> str:
    cases = []
    for lang in lx.KEYBOARDS:
        foreign = "".join(c for c in lx.KEYS if c not in lx.SWAPS[lang])
        own = lx.SWAPS[lang]
        mapped = "MAP {" + ", ".join(f"{text(a)}: {text(b)}" for a, b in own.items()) + "}"
        other = f"not {is_english(w)}" if lang == "en" else is_english(w)
        cases.append(f"when {other} and len(list_filter(string_split({w}, ''), lambda c: contains({text(foreign)}, c))) = 0 then array_to_string(list_transform(string_split({w}, ''), lambda c: coalesce({mapped}[c], {text(lx.KEYBOARDS[lang][-1][-1])})), '')")
    return f"case {' '.join(cases)} end"


def near_words(source: str) -> str:
    """nw(word, candidate) of the words in source(word)."""
    return f"""km as (select {NEAR} as near), n1 as (select distinct word, unnest({edits("word")}) as candidate from {source}, km),
n2 as (select distinct word, unnest({edits("candidate")}) as candidate from n1, km),
nw as (select word, candidate from n2 union select word, candidate from n1 union select word, word from {source} union select word, {swap("word")} from {source})"""


def log_of(p: str) -> str:
    return f"case when {p} > 0 then ln({p}) else '-infinity'::double end"


SMOOTHED = "(0.9::double * coalesce(bi.c / bs.s, 0) + (1 - 0.9::double) * coalesce(u.c / us.total, 0))"
FINITE = "case when log_p > '-infinity'::double then round(log_p, 6) end as log_p"


def probability(source: str, smoothed: bool = True) -> str:
    """pr(key, p, log_p) of source(key, tokens)."""
    follows = SMOOTHED if smoothed else "coalesce(bi.c / bs.s, 0)"
    one = "coalesce(u.c / us.total, 0)" if smoothed else "0.0::double"
    return f"""st as (select key, tokens[i] as prev, tokens[i + 1] as word from (select key, tokens, unnest(range(1, len(tokens))) as i from {source})),
pr0 as (select key, sum({log_of(follows)}) as log_p from st left join bi using (prev, word) left join bs using (prev) left join u on u.word = st.word, us group by key
  union all select key, {log_of(one)} from (select key, tokens[1] as w from {source} where len(tokens) = 1) s left join u on u.word = s.w, us
  union all select key, '-infinity'::double from {source} where len(tokens) = 0),
pr as (select key, exp(log_p) as p, log_p from pr0)"""


def top(score_sql: str, k: int = 10) -> str:
    return f"select qid, row_number() over (partition by qid order by score desc, doc_id) as rank, doc_id, score from ({score_sql}) qualify rank <= {k}"


def dot(tf: str, idf: str) -> str:
    inner = f"select qid, doc_id, round(sum(qtf * {tf} * {idf} * weight), 6) as score from qt join tm using (term) join p using (term) group by qid, doc_id having score is not null"
    return f"with {INDEX}, {ITEMS}, {QUERY_TERMS} {top(inner)}"


def cosine(tf: str) -> str:
    return f"""with {INDEX}, {ITEMS}, {QUERY_TERMS}, x as (select term, doc_id, {tf} * idf * weight as x from p join tm using (term)),
nx as (select doc_id, sqrt(sum(x * x)) as norm from x group by doc_id), y as (select qid, term, idf as y from qt join tm using (term)), ny as (select qid, sqrt(sum(y * y)) as size from y group by qid),
dt as (select qid, doc_id, sum(x * y) as dot from x join y using (term) group by all) {top("select qid, doc_id, round(dot / (norm * size), 6) as score from dt join nx using (doc_id) join ny using (qid)")}"""


def bm25(source: str) -> str:
    inner = """select qid, doc_id, round(sum(qtf * (prob_idf * tf * 2.2::double / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * (len(t) + len(b)) / avdl)) * weight)), 6) as score
      from qt join tm using (term) join p using (term) join f using (doc_id), n group by qid, doc_id having score is not null"""
    return f"with {INDEX}, {source}, {QUERY_TERMS} {top(inner)}"


def html_text(x: str) -> str:
    names = x
    for name, char in NAMED.items():
        names = f"replace({names}, {text(name)}, {text(char)})"
    return names


_SCRIPTLESS = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g')"
_PARSED = f"""h as (select page_id, url, {_SCRIPTLESS} as h from pages),
g as (select page_id as doc_id, url, {html_text("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title,
  {html_text("regexp_replace(regexp_extract(h, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1), '(?s)<[^>]*>', '', 'g')")} as body from h)"""

_PHRASE = text(cat.PHRASE)


def snippets(source: str, keys: str) -> str:
    """sn(keys, snippet) of source(keys, body, query)."""
    return f"""s0 as (select {keys}, body, query, string_split(body, query) as ps from {source}),
s1 as (select *, list_transform(range(1, len(ps)), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(query)) as pos from s0),
s2 as (select *, list_transform(pos, lambda x: len(list_filter(pos, lambda y: y >= x and y < x + 160))) as cnt from s1),
s3 as (select *, case when len(pos) > 0 and query <> '' then pos[list_position(cnt, list_max(cnt))] end as st from s2),
s4 as (select *, left(body, greatest(0, st - 20)::bigint) as l, left(body, least(length(body), st + 180)::bigint) as r from s3),
s5 as (select *, case when instr(reverse(l), ' ') = 0 then 0 else length(l) - instr(reverse(l), ' ') + 1 end as beg, case when instr(reverse(r), ' ') = 0 then length(body) - 1 else length(r) - instr(reverse(r), ' ') end as en from s4),
sn as (select {keys}, case when st is null then left(body, 100) || '...' else '...' || replace(substr(body, (beg + 1)::bigint, greatest(en - beg, 0)::bigint), query, '<b>' || query || '</b>') || '...' end as snippet from s5)"""


#: Single characters in place of those that take several bytes: levenshtein() counts bytes.
_BARE = "translate({}, 'àâçéèêëîïôùûüÿœæñáíóúöäß', 'ABCDEFGHIJKLMNOPQRSTUVWX')"
_COMPLETIONS = "cm as (select qid, list_append(tokens[1:len(tokens) - 1], term) as xs from q, tm where len(tokens) > 0 and starts_with(term, tokens[-1]) and term <> tokens[-1])"
_CONTINUATIONS = "cn as (select qid, prev || ' ' || word as text, [prev, word] as tail, c from q join bi on prev = tokens[-1] where len(tokens) > 0 qualify row_number() over (partition by qid order by c desc, word) <= 3)"
_PAIRS = f"t as (select {clean('text')} as t from benchmark), pq as (select distinct t[i] as a, t[i + 1] as b from (select t, unnest(range(1, len(t))) as i from t))"
_MODELS_AND_INDEX = f"{INDEX}, {MODELS.removeprefix(DOCS + ', ')}"
_CANDIDATES = f"""qw as (select distinct unnest(tokens) as word from q), {near_words("qw")},
cs as (select nw.word, candidate, coalesce(u.c / us.total, 0) as p from nw join tm on term = candidate left join u on u.word = candidate, us),
cd as (select word, candidate, p, row_number() over (partition by word order by p desc, candidate) as nth from cs qualify nth <= 3)"""
# the best way to each choice of each place, place by place
_CORRECTED = f"""{_CANDIDATES}, ql as (select qid, pos, tokens[pos] as word, len(tokens) as n from (select qid, tokens, unnest(range(1, len(tokens) + 1)) as pos from q)),
ch as (select qid, 0 as kind, n, pos, 1::bigint as nth, word from ql union all select qid, 1, n, pos, nth, candidate from ql join cd using (word)),
fo as (select b.qid, b.kind, b.n, b.pos, a.nth as prev_nth, b.nth, b.word, {log_of(SMOOTHED)} as log_p from ch a join ch b on a.qid = b.qid and a.kind = b.kind and a.pos + 1 = b.pos
  left join bi on bi.prev = a.word and bi.word = b.word left join bs on bs.prev = a.word left join u on u.word = b.word, us),
vt as (with recursive v as (select qid, kind, n, pos, nth, struct_pack(cost := case when n = 1 then -({log_of("coalesce(u.c / us.total, 0)")}) else 0 end, t := word) as way from ch left join u using (word), us where pos = 1
  union all select qid, kind, n, pos, nth, min(way) from (select fo.qid, fo.kind, fo.n, fo.pos, fo.nth, struct_pack(cost := v.way.cost - fo.log_p, t := v.way.t || ' ' || fo.word) as way
    from v join fo on fo.qid = v.qid and fo.kind = v.kind and fo.pos = v.pos + 1 and fo.prev_nth = v.nth) group by all) select * from v),
co as (select qid, query, case when kind = 1 then way.t else query end as text, coalesce(-way.cost, '-infinity'::double) as log_p, exp(coalesce(-way.cost, '-infinity'::double)) as p
  from q left join (select qid, kind, way from vt where pos = n) using (qid) qualify row_number() over (partition by qid order by way.cost nulls last, kind, way.t) = 1)"""
_CHECKED = f"""{_CORRECTED}, cq as (select q.qid, q.query, text, co.p, tokens, {clean("text")} as own from q join co using (qid)),
hr as (select qid, count(distinct doc_id) as hits from (select qid, unnest(tokens) as term from cq) join tm using (term) join p using (term) group by qid),
ho as (select qid, count(distinct doc_id) as hits from (select qid, unnest(own) as term from cq) join tm using (term) join p using (term) group by qid),
ck as (select qid, query, text, case when query = text then 1 when coalesce(hr.hits, 0) > 10 then 2 when coalesce(ho.hits, 0) > 10 then 3 else 4 end as rule, cq.p from cq left join hr using (qid) left join ho using (qid))"""

#: The cell of row i and column j of the table d for words a and b, row after row, w cells each.
_CELL = """case when i = 0 then j when j = 0 then i else least(d[(i - 1) * w + j + 1] + 1, d[i * w + j] + 1, d[(i - 1) * w + j] + case when a[i:i] = b[j:j] then 0 when list_contains(coalesce(near[a[i:i]], []), b[j:j]) then 1 else 2 end,
  case when i > 1 and j > 1 and a[i:i] = b[j - 1:j - 1] and a[i - 1:i - 1] = b[j:j] then d[(i - 2) * w + j - 1] + 1 else 1000000 end) end"""


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{text(a)}: {text(b)}" for a, b in table.items()) + "}"


DOCS_ONLY = DOCS[: DOCS.index(",\nf as")]


def _lemmas(x: str) -> str:
    normal = f"translate({x}, 'éè', 'ee')"
    first = f"list_filter({plain(normal)}, lambda t: not list_contains({texts(lx.STOP_WORDS)}, t))"
    return f"list_filter(list_transform({first}, lambda t: coalesce({_map(cat.LEMMAS)}[t], t)), lambda t: length(t) > 1 and not list_contains({texts(lx.STOP_WORDS)}, t))"


_SEARCHED = f"""{_CHECKED},
      sx as (select qid, 0 as query_pos, case when rule = 3 then text else query end as query from ck union all select qid, 1, text from ck where rule = 4),
      xt as (select qid, query_pos, term, count(*) as qtf from (select qid, query_pos, unnest({clean("query")}) as term from sx) group by all),
      sc as (select qid, query_pos, doc_id, round(sum(qtf * (prob_idf * tf * 2.2::double / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * (len(t) + len(b)) / avdl)) * weight)), 6) as score
        from xt join tm using (term) join p using (term) join f using (doc_id), n group by all having score is not null),
      rk as (select *, row_number() over (partition by qid, query_pos order by score desc, doc_id) as rank from sc qualify rank <= 10),
      fd as (select qid, query_pos, rank, doc_id, score, title, body, query from rk join sx using (qid, query_pos) join f using (doc_id)), {snippets("fd", "qid, query_pos, rank, doc_id, score, title")}"""
_SUGGESTED = f"""{_COMPLETIONS}, {_CONTINUATIONS},
      sg as (select struct_pack(qid := qid, text := array_to_string(xs, ' ')) as key, xs[greatest(len(xs) - 1, 1):] as tokens from cm union all select struct_pack(qid := qid, text := text), tail from cn), {probability("sg")},
      su as (select key.qid as qid, key.text as text, p as score, row_number() over (partition by key.qid order by p desc, key.text) as rank from pr qualify rank <= 3)"""
_BAD = text(se.BAD_REQUEST)

SQL = {
    "parse_pages": f"with {_PARSED} select doc_id, url, title, body, len({clean('title')})::bigint as title_len, len({clean('body')})::bigint as body_len from g",
    "doc_lengths": f"with {DOCS} select doc_id, len(t)::bigint as title_len, len(b)::bigint as body_len from f",
    "clean_tokens": f"with {DOCS} select doc_id, array_to_string(t, ' ') as title, array_to_string(b, ' ') as body from f",
    "title_body_bigrams": f"with {DOCS} select doc_id, array_to_string(list_concat({pairs('t')}, {pairs('b')}), '|') as bigrams from f",
    "postings": f"with {INDEX} select term, doc_id, tf, round(weight, 9) as weight from p",
    "tf_variants": f"with {INDEX} select term, doc_id, round(relative, 9) as relative, round(augmented, 9) as augmented, round(logarithm, 9) as logarithm from p",
    "max_tf": f"with {INDEX} select doc_id, max(tf) as max_tf, count(*) as distinct_terms from p group by doc_id",
    "term_stats": f"with {INDEX} select term, df, cf, round(idf, 9) as idf, round(prob_idf, 9) as prob_idf from t1",
    "minor_terms": f"with {INDEX} select term, df, cf, round(idf, 9) as idf, round(prob_idf, 9) as prob_idf from t1 where cf <= 10",
    "vocabulary": f"with {INDEX} select term from tm",
    "corpus_stats": f"with {INDEX} select n, round(avdl, 9) as avdl, (select sum(tf)::bigint from p join tm using (term)) as total_terms, (select count(distinct doc_id) from p join tm using (term)) as docs_with_terms from n",
    "token_postings_topk": f"with {INDEX} select term, doc_id, tf from p where term = {text(cat.TOKEN)} order by tf desc, doc_id limit 10",
    "docs_for_query": f"with {INDEX}, {ITEMS}, h as (select qid, count(distinct doc_id) as hits from (select qid, unnest(tokens) as term from q) join tm using (term) join p using (term) group by qid) select qid, coalesce(hits, 0) as hits from q left join h using (qid)",
    "bm25_topk": bm25(ASKED),
    "bm25_batch_queries": bm25(ITEMS),
    "doc_vectors": f"with {INDEX} select doc_id, term, round(relative * idf * weight, 9) as x from p join tm using (term)",
    "unigram_lm": f"with {UNIGRAMS} select word, c from u",
    "bigram_lm": f"with {MODELS} select prev, word, c from bi",
    "bigram_context_totals": f"with {MODELS} select prev, s, continuations from bs",
    "unigram_prob": f"with {UNIGRAMS} select word, round(c / total, 12) as p from u, us",
    "lm_totals": f"with {UNIGRAMS} select total, vocabulary from us",
    "bigram_prob_interpolated": f"with {MODELS}, sq as (select struct_pack(conv_id := conv_id, turn := turn) as key, {clean('text')} as tokens from conversations), {probability('sq')} select key.conv_id as conv_id, key.turn as turn, {FINITE} from pr",
    "bigram_prob_mle": f"with {MODELS}, sq as (select struct_pack(conv_id := conv_id, turn := turn) as key, {clean('text')} as tokens from conversations), {probability('sq', False)} select key.conv_id as conv_id, key.turn as turn, {FINITE} from pr",
    "in_language": f"with {MODELS}, a as (select distinct unnest({clean('text')}) as word from benchmark) select word, word in (select word from u) as is_word, word in (select prev from bs) as is_context from a",
    "bigram_index": f"with {DOCS}, bt as (select doc_id, unnest(list_concat({pairs('t')}, {pairs('b')})) as term from f), bq as (select term, doc_id, count(*) as tf from bt group by all), n as (select count(distinct doc_id) as n from f) select term, count(*) as df, sum(tf)::bigint as cf, round(ln((1 + any_value(n)) / count(*)), 9) as idf from bq, n group by term",
    "bigram_postings_topk": f"with {DOCS}, bt as (select doc_id, unnest(list_concat({pairs('t')}, {pairs('b')})) as term from f) select term, doc_id, count(*) as tf from bt where term = {_PHRASE} group by all order by tf desc, doc_id limit 10",
    "edits1": f"with {WORDS}, km as (select {NEAR} as near) select distinct word, unnest({edits('word')}) as edit from w, km",
    "edits2_vocab": f"with {INDEX}, {WORDS}, {near_words('w')} select word, candidate from nw where candidate in (select term from tm)",
    "layout_swap": f"with {WORDS} select word, {swap('word')} as swapped from w",
    "key_adjacency": "select c, nth::bigint as nth, adjacent from (values " + ", ".join(f"({text(c)}, {i}, {text(n)})" for c, near in lx.NEIGHBOURS.items() for i, n in enumerate(near)) + ") v(c, nth, adjacent)",
    "detect_language": f"with {INDEX} select term, case when {is_english('term')} then 'en' else 'fa' end as language from tm",
    "levenshtein": f"with {_PAIRS} select a, b, levenshtein({_BARE.format('a')}, {_BARE.format('b')})::bigint as distance from pq",
    "weighted_dl_distance": f"""with recursive {_PAIRS}, km as (select {NEAR} as near),
      wd as (select a, b, near, 0::bigint as k, []::bigint[] as d from pq, km union all select a, b, near, k + 1, list_append(d, {_CELL}) from (select *, k // (length(b) + 1) as i, k % (length(b) + 1) as j, length(b) + 1 as w from wd) where k < (length(a) + 1) * (length(b) + 1))
      select a, b, d[-1]::int as distance from wd where k = (length(a) + 1) * (length(b) + 1)""",
    "digit_words": f"with c as (select conv_id, turn, text from conversations union all select -i, 0, {texts(cat.DIGITS)}[i] from range(1, {len(cat.DIGITS) + 1}) r(i)) select conv_id, turn, array_to_string(list_transform({plain('text')}, lambda t: coalesce({_map(lx.DIGIT_WORDS)}[t], t)), ' ') as words from c",
    "lemma_tokens": f"with {DOCS_ONLY}, l as (select doc_id, {_lemmas('title')} as t, {_lemmas('body')} as b from d) select doc_id, array_to_string(t, ' ') as title, array_to_string(b, ' ') as body, len(b)::bigint as body_len from l",
    "spell_candidates_top3": f"with {_MODELS_AND_INDEX}, {ASKED}, {_CANDIDATES} select word, candidate, round(p, 12) as p, nth from cd",
    "spell_correct": f"with {_MODELS_AND_INDEX}, {ASKED}, {_CORRECTED} select qid, query, text, round(p, 12) as p, {FINITE} from co",
    "query_check": f"""with {_MODELS_AND_INDEX}, {ASKED}, {_CHECKED} select qid, case rule when 3 then text when 4 then query || '|' || text else query end as searched,
      case when rule = 3 or rule = 2 and p > 0.0001::double then text else '' end as suggestion, rule = 3 as active from ck""",
    "snippets": f"with {DOCS}, sd as (select doc_id, body, {_PHRASE} as query from d), {snippets('sd', 'doc_id')} select doc_id, snippet from sn",
    "search_results": f"with {_MODELS_AND_INDEX}, {ASKED}, {_SEARCHED} select qid, query_pos::bigint as query_pos, rank, doc_id, title, snippet as body, score from sn",
    "search_response": f"""with {_MODELS_AND_INDEX}, {ASKED}, {_SEARCHED},
      rs as (select qid, list(struct_pack(id := doc_id, url := null::varchar, title := title, body := snippet, score := score) order by query_pos, rank) as documents from sn group by qid)
      select qid, to_json(struct_pack(success := true, result := struct_pack(documents := coalesce(documents, []),
        correction := case when rule = 3 or rule = 2 and p > 0.0001::double then struct_pack(active := rule = 3, query := text) end)))::varchar as response from ck left join rs using (qid)
      union all select -1000, {_BAD}""",
    "prefix_completions": f"with {INDEX}, {TURNS}, {_COMPLETIONS} select qid, array_to_string(xs, ' ') as text from cm",
    "bigram_continuations": f"with {MODELS}, {TURNS}, {_CONTINUATIONS} select qid, text, c from cn",
    "suggestions": f"with {_MODELS_AND_INDEX}, {TURNS}, {_SUGGESTED} select qid, text, round(score, 12) as score, rank from su",
    "xml_corpus": "select page_id::varchar as doc_id, url, html from pages",
}
SQL |= {f"tfidf_dot_{t}_{i}": dot(tf, idf) for t, tf in (("r", "relative"), ("a", "augmented"), ("l", "logarithm")) for i, idf in (("n", "idf"), ("p", "prob_idf"))}
SQL |= {f"tfidf_cosine_{t}": cosine(tf) for t, tf in (("r", "relative"), ("a", "augmented"), ("l", "logarithm"))}
