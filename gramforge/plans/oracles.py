"""SQL for DuckDB that each query is held against."""

from __future__ import annotations

from gramforge.functions.tokenizer import END, UNKNOWN
from gramforge.plans.oracle_text import sentences_sql
from gramforge.plans.queries import FORMS, HASHED, K, LEMMAS, MADE, MINCNT, REQUESTS, SPELLINGS, VERIFIED, T
from gramforge.plans.smoothing import MODELS, bits, layers, layers_sql

_W = ["w1", "w2", "w3", "w4", "w5"]
_CTX = ["x4", "x3", "x2", "x1"]

# --- loaded n-gram data ---

_DATA = """with r as (select fnum, line_no, any_value(n) as n, any_value(w1) as w1, any_value(w2) as w2, any_value(w3) as w3, any_value(w4) as w4, any_value(w5) as w5, any_value(cnt) as cnt
  from ngram_files where ngram is not null and cnt is not null group by fnum, line_no),
a as (select n, w1, w2, w3, w4, w5, cnt from r union all select 1, w1, null, null, null, null, cnt from vocab where w1 is not null and cnt is not null),
g as (select n, w1, w2, w3, w4, w5, cast(sum(cnt) as bigint) as cnt from a group by all)"""
_LAST = "list_extract([w1, w2, w3, w4, w5], n)"
_PATTERNS = _DATA + """,
t as (select distinct list_filter(string_split_regex(pattern, '\\s+'), lambda x: x <> '') as t from pattern_list),
p as (select array_to_string(t, ' ') as pattern, cast(len(t) as integer) as n,
  cast(list_sum(list_transform(t, lambda x, i: case when x = '_' then 1 << (len(t) - i) else 0 end)) as integer) as mask,
  nullif(t[1], '_') as p1, nullif(t[2], '_') as p2, nullif(t[3], '_') as p3, nullif(t[4], '_') as p4, nullif(t[5], '_') as p5 from t where len(t) > 0)"""
_MATCH = "g.n = p.n and " + " and ".join(f"(p.p{i} is null or p.p{i} = g.w{i})" for i in range(1, 6))
_N2 = "bit_count(p.mask) > 1 and p.mask & 1 = 1"


def _counts(join: str, n2: bool) -> str:
    cols = "p.pattern, cast(coalesce(sum(g.cnt), 0) as bigint) as n0, case when any_value(p.mask) > 0 then count(g.n) end as n1"
    if n2:
        cols += f", case when bit_count(any_value(p.mask)) > 1 and any_value(p.mask) & 1 = 1 then count(distinct case when {_N2} then list_extract([g.w1, g.w2, g.w3, g.w4, g.w5], g.n) end) end as n2"
    return f"{_PATTERNS} select {cols} from p {join} g on {_MATCH} group by p.pattern"


def _cube(n: int) -> str:
    w = ", ".join(_W[:n])
    mask = f"cast(grouping_id({w}) as integer)"
    d = f"case when bit_count({mask}) > 1 and {mask} & 1 = 1 then count(distinct last) end as n2"
    return f"{_DATA}, c as (select {w}, w{n} as last, cnt from g where n = {n}) select {w}, {mask} as mask, cast(sum(cnt) as bigint) as n0, case when {mask} > 0 then count(*) end as n1, {d} from c group by cube ({w})"


def _slice(first: str, size: str) -> str:
    return f"array_to_string(list_slice([w1, w2, w3, w4, w5], {first}, {first} + {size} - 1), ' ')"


# --- corpus ---

_SENT = "with " + sentences_sql("lang, ")
_CORPUS = _SENT.replace("sent as (", "sent as materialized (") + f""",
tok as materialized (select doc_id, line_no, generate_subscripts(w, 1) as i, unnest(w) as t from sent),
voc as materialized (select t as w1, count(*) as cnt from tok group by t having count(*) >= {T}),
us as (select doc_id, line_no, list(case when v.w1 is null then '{UNKNOWN}' else t end order by i) as w from tok left join voc v on tok.t = v.w1 group by doc_id, line_no),
posn as (select w, unnest(range(1, len(w) + 1)) as i from us),
win as materialized (select w[i] as w1, w[i + 1] as w2, w[i + 2] as w3, w[i + 3] as w4, w[i + 4] as w5, count(*) as cnt from posn group by all),
""" + ",\n".join(f"o{n} as materialized (select {', '.join(_W[:n])}, cast(sum(cnt) as bigint) as cnt from win where w{n} is not null group by all{f' having sum(cnt) >= {K}' if n > 1 else ''})" for n in range(1, 6)) + """,
known as materialized (select * from sent s where not exists (select 1 from tok k left join voc v on k.t = v.w1 where v.w1 is null and k.doc_id = s.doc_id and k.line_no = s.line_no)),
kpos as materialized (select doc_id, line_no, lang, w, i, w[i + 1] as y, case when i > 3 then w[i - 3] end as x4, case when i > 2 then w[i - 2] end as x3, case when i > 1 then w[i - 1] end as x2, w[i] as x1
  from (select *, unnest(range(1, len(w) - 1)) as i from known where len(w) > 2)),
dpos as (select x4, x3, x2, x1, y, count(*) as times from kpos group by all)"""
_CORPUS = _CORPUS.replace(
    "known as materialized (select * from sent s where not exists (select 1 from tok k left join voc v on k.t = v.w1 where v.w1 is null and k.doc_id = s.doc_id and k.line_no = s.line_no))",
    "odd as (select distinct doc_id, line_no from tok anti join voc on tok.t = voc.w1),\nknown as materialized (select sent.* from sent anti join odd on sent.doc_id = odd.doc_id and sent.line_no = odd.line_no)",
)


def _context_table(k: int) -> str:
    """c1..ck with the counts of a context of k words."""
    keys = [f"c{i}" for i in range(1, k + 1)]
    cols = lambda first: ", ".join(f"w{first + i} as {c}" for i, c in enumerate(keys))
    on = lambda t: " and ".join(f"a.{c} = {t}.{c}" for c in keys)
    parts = [f"select {cols(1)} from o{k}", f"select {cols(1)} from o{k + 1}"] + ([f"select {cols(2)} from o{k + 2}"] if k <= 3 else [])
    out = f"(with a as ({' union '.join(parts)}), x as (select {cols(1)}, cnt from o{k}), r as (select {cols(1)}, sum(cnt) as s, count(*) as c from o{k + 1} group by {', '.join(keys)})"
    sel = f"coalesce(x.cnt, 0) as x0_{k}, coalesce(r.s, 0) as r0_{k}, coalesce(r.c, 0) as r1_{k}"
    join = f"from a left join x on {on('x')} left join r on {on('r')}"
    if k <= 3:
        out += f", m as (select {cols(2)}, sum(cnt) as s, count(*) as c, count(distinct w{k + 2}) as d from o{k + 2} group by {', '.join(keys)})"
        sel += f", coalesce(m.s, 0) as m0_{k}, coalesce(m.c, 0) as m1_{k}, coalesce(m.d, 0) as m2_{k}"
        join += f" left join m on {on('m')}"
    return f"{out} select {', '.join(f'a.{c}' for c in keys)}, {sel} {join})"


def _target_table(k: int) -> str:
    keys = [f"c{i}" for i in range(1, k + 1)]
    cols = lambda first: ", ".join(f"w{first + i} as {c}" for i, c in enumerate(keys))
    on = lambda t: " and ".join(f"a.{c} = {t}.{c}" for c in keys)
    parts = [f"select {cols(1)} from o{k}"] + ([f"select {cols(2)} from o{k + 1}"] if k <= 4 else [])
    out = f"(with a as ({' union '.join(parts)}), x as (select {cols(1)}, cnt from o{k})"
    sel, join = f"coalesce(x.cnt, 0) as y0_{k}", f"from a left join x on {on('x')}"
    if k <= 4:
        out += f", l as (select {cols(2)}, sum(cnt) as s, count(*) as c from o{k + 1} group by {', '.join(keys)})"
        sel += f", coalesce(l.s, 0) as l0_{k}, coalesce(l.c, 0) as l1_{k}"
        join += f" left join l on {on('l')}"
    return f"{out} select {', '.join(f'a.{c}' for c in keys)}, {sel} {join})"


_BAD = "(';', '!', '?', '.')"


def _flags() -> str:
    out = []
    for k in range(1, 5):
        words = [f"x{j}" for j in range(k, 0, -1)]
        bad = " or ".join(f"coalesce({w} in {_BAD}, false)" for w in words)
        ends = f"coalesce(regexp_matches(concat_ws(' ', {', '.join(words)}), '^[^;!?.]*[;!?.]$') and y = '{END}', false)"
        out += [f"({bad}) as bad_{k}", f"(({bad}) and not {ends}) as kbad_{k}"]
    return ", ".join(out)


_STATS = _CORPUS + ",\n" + ",\n".join([f"sx{k} as materialized {_context_table(k)}" for k in range(1, 5)] + [f"sy{k} as materialized {_target_table(k)}" for k in range(1, 6)]) + ",\ntot as (select (select sum(cnt) from o1) as t0, (select count(*) from o2) as t1)"


def _features(source: str) -> str:
    """Rows of ``source`` (y, x4..x1, more) with all counts."""
    counts = [f"{c}_{k}" for k in range(1, 5) for c in ("x0", "r0", "r1")] + [f"{c}_{k}" for k in range(1, 4) for c in ("m0", "m1", "m2")] + [f"y0_{k}" for k in range(1, 6)] + [f"{c}_{k}" for k in range(1, 5) for c in ("l0", "l1")]
    joins = ""
    for k in range(1, 5):
        joins += f" left join sx{k} on " + " and ".join(f"sx{k}.c{i + 1} = d.x{k - i}" for i in range(k))
    for k in range(1, 6):
        words = [*(f"x{j}" for j in range(k - 1, 0, -1)), "y"]
        joins += f" left join sy{k} on " + " and ".join(f"sy{k}.c{i + 1} = d.{w}" for i, w in enumerate(words))
    return f"(select d.*, {', '.join(f'cast(coalesce({c}, 0) as bigint) as {c}' for c in counts)}, cast(t0 as bigint) as t0, t1, {_flags()} from {source} d{joins}, tot)"


def _scored(model: str, source: str = "feats") -> str:
    return layers_sql(source, layers(model, None, K, T))


_FEATS = _STATS + ",\nfeats as materialized " + _features("dpos")


def _bits_sql(model: str) -> str:
    return f"{_FEATS} select x4, x3, x2, x1, y, times, round({bits('p5')}, 6) as bits_5 from {_scored(model)}"


def _entropy(model: str, source: str = "feats", by: str = "") -> str:
    cols = ", ".join(f"round(sum(({bits(f'p{n}')}) * times) / sum(times), 4) as bits_{n}" for n in range(1, 6))
    return f"select {by}{'' if by else f'{chr(39)}{model}{chr(39)} as model, '}cast(sum(times) as bigint) as words, {cols} from {_scored(model, source)}{' group by ' + by.rstrip(', ') if by else ''}"


def _norm() -> str:
    best = f"ctx as (select x4, x3, x2, x1 from (select distinct x4, x3, x2, x1 from dpos) order by md5(concat_ws(' ', x4, x3, x2, x1)) limit {HASHED}), ctx2 as (select * from ctx union select * from {_values(MADE, 'x4, x3, x2, x1')})"
    pairs = "cv as (select x4, x3, x2, x1, w1 as y, 1 as times from ctx2, o1)"
    parts = [
        f"select '{m}' as model, x4, x3, x2, x1, {', '.join(f'round(sum(p{n}), 6) as sum_{n}' for n in range(1, 6))} from {layers_sql('vf', layers(m, None, K, T, pseudo_counts=False))} group by x4, x3, x2, x1"
        for m in VERIFIED
    ]
    return f"{_STATS}, {best}, {pairs}, vf as materialized {_features('cv')} {' union all '.join(parts)}"


def _requested(model: str) -> str:
    """Patterns of a model over all sentences: plain unions, without nulls."""
    join = lambda *p: "concat_ws(' ', " + ", ".join(p) + ")"
    out = ["select y as pattern from f", "select '_' from f where y is not null"]
    for n in range(2, 6):
        k = n - 1
        x = [f"x{j}" for j in range(k, 0, -1)]
        out += [f"select {join(*x)} from f where x{k} is not null", f"select {join(*x, chr(39) + '_' + chr(39))} from f where x{k} is not null"]
        if model not in ("kn", "kn1", "kn3", "kn4", "knmod"):
            out.append(f"select {join(*x, 'y')} from f where x{k} is not null")
            continue
        if n == 5 and model in ("kn", "kn1"):  # has no counts of its own there
            continue
        use = f"x{k} is not null and not kbad_{k}"
        out += [f"select {join(*x, 'y')} from f where {use}", f"select {join(chr(39) + '_' + chr(39), 'y')} from f where {use}", f"select '_ _' from f where {use}"]
        for m in range(2, n):
            j = m - 1
            z = [f"x{i}" for i in range(j, 0, -1)]
            good = f"{use} and not kbad_{j}"
            w = "'_'"
            out += [f"select {join(w, *z, w)} from f where {use}", f"select {join(w, *z, 'y')} from f where {good}", f"select {join(*z, w)} from f where {good}"]
            if model != "kn":
                out += [f"select {join(*z, w)} from f where {use}", f"select {join(*z, 'y')} from f where {good}", f"select {join(*z)} from f where {good}"]
    every = "apos as (select distinct w[i + 1] as y, case when i > 3 then w[i - 3] end as x4, case when i > 2 then w[i - 2] end as x3, case when i > 1 then w[i - 1] end as x2, w[i] as x1 from (select w, unnest(range(1, len(w) - 1)) as i from sent where len(w) > 2))"
    return f"{_SENT}, {every}, f as materialized (select *, {_flags()} from apos) select distinct pattern from ({' union all '.join(out)})"


def _values(rows: list[tuple], cols: str) -> str:
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({cols})"


_REQ = f"with q0 as (select * from {_values(REQUESTS, 'id, head, word, pos')})"
_HEAD = "case when len(string_split({c}, ' ')) = 1 then {c} when pos = 'n' and string_split({c}, ' ')[2] <> 'of' then string_split({c}, ' ')[-1] else string_split({c}, ' ')[1] end"
_HEADS = f"{_REQ}, q as (select id, head as head0, word as word0, pos, {_HEAD.format(c='head')} as head, {_HEAD.format(c='word')} as word from q0)"
_CAP = (
    "case when {h} = lower({h}) then lower({w}) when {h} = upper({h}) and regexp_matches({h}, '[A-Z].*[A-Z]') then upper({w})"
    " when regexp_matches({h}, '^[A-Z]') then array_to_string(list_transform(string_split({w}, ' '), lambda t: upper(t[1]) || t[2:]), ' ') else {w} end"
)
_MORPH = _HEADS + f""",
le as (select * from {_values(LEMMAS, 'lemma_id, lpos')}), fo as (select * from {_values(FORMS, 'wf_id, lemma_id, infl')}), sp as (select * from {_values(SPELLINGS, 'wf_id, str')}),
e as (select * from sp join fo using (wf_id) join le using (lemma_id)),
c as (select *, case pos when 'n' then 1 when 'a' then 2 when 'v' then 4 when 'r' then 7 end as code from q),
f as (select distinct c.id, x.str as form from c join e h on lower(c.head) = h.str and (c.code is null or h.lpos = c.code) join e w on lower(c.word) = w.str and w.lpos = h.lpos join e x on x.lemma_id = w.lemma_id and x.infl = h.infl),
m as (select distinct c.id, coalesce(f.form, c.word) as form from c left join f on f.id = c.id)"""
_FIRST = "case when instr(word0, word) > 0 then word0[1:instr(word0, word) - 1] || form || word0[instr(word0, word) + len(word):] else word0 end"

_MINCNT = (
    "select "
    + ", ".join(f"case when x{k} is not null and coalesce(v{k}.cnt, 0) < {MINCNT} then '{UNKNOWN}' else x{k} end as x{k}" for k in (4, 3, 2, 1))
    + ", y, count(*) as times from kpos "
    + " ".join(f"left join voc v{k} on v{k}.w1 = x{k}" for k in range(1, 5))
    + " group by all"
)

ORACLE = {
    "tokenize_documents": f"{_SENT} select doc_id, count(*) as sentences, cast(sum(len(w) - 2) as bigint) as tokens from sent group by doc_id",
    "token_counts": f"{_SENT} select w1, count(*) as cnt from (select unnest(w) as w1 from sent) group by w1",
    "sentence_stats": f"{_SENT} select lang, count(*) as sentences, cast(sum(len(w)) as bigint) as tokens, cast(max(len(w)) as integer) as longest from sent group by lang",
    **{f"ngram_counts_{n}": f"{_CORPUS} select {', '.join(_W[:n])}, cnt from o{n}" for n in range(1, 6)},
    "vocab_unk": f"{_CORPUS} select w1, cnt from o1",
    "known_sentences": f"{_CORPUS} select doc_id, line_no, cast(len(w) as integer) as size from known",
    "ngram_table": f"{_DATA} select * from g",
    "allwild_totals": f"{_DATA} select n, cast(sum(cnt) as bigint) as n0, count(*) as n1, case when n > 1 then count(distinct {_LAST}) end as n2 from g group by n",
    "cube_counts_2": _cube(2),
    "cube_counts_3": _cube(3),
    **{f"cube_counts_{n}": f"select c.* from ({_cube(n)}) c where mask in (select mask from ({_PATTERNS} select mask from p where n = {n}))" for n in (4, 5)},
    "parsed_patterns": f"{_PATTERNS} select pattern, n, mask, p1, p2, p3, p4, p5, pattern as rendered from p",
    "pattern_counts": _counts("join", False),
    "pattern_counts_n2": _counts("join", True),
    "pattern_counts_zero": _counts("left join", True),
    "match_ngrams": f"{_PATTERNS} select distinct g.* from g join p on {_MATCH} and p.mask > 0 and p.mask < (1 << p.n) - 1 where not exists (select 1 from p where {_MATCH} and p.mask = 0)",
    "match_ngrams_all": f"{_PATTERNS} select distinct g.* from g join p on {_MATCH} and p.mask < (1 << p.n) - 1",
    "prefix_lookup": f"{_DATA} select * from g where n = 3 and w1 = 'the'",
    "second_word_lookup": f"{_DATA} select * from g where n = 3 and w2 = 'of'",
    "point_lookup": f"{_DATA} select n, w1, cnt from g where n = 1 and w1 = 'the'",
    "top_completions": f"{_DATA} select w1 || ' ' || w2 as context, w3 as word, cnt, cast(row_number() over (partition by w1, w2 order by cnt desc, w3) as integer) as rank from g where n = 3 qualify rank <= 3",
    "file_routing": _PATTERNS + ", f as (select n, fnum, first_ngram, lead(first_ngram) over (partition by n order by first_ngram, fnum) as nx from file_index where sortkey = 1 and first_ngram is not null)"
    " select pattern, fnum from p join f on p.n = f.n where p.p1 is not null and p.n > 1 and first_ngram < p1 || '!' and (nx is null or nx >= p1 || ' ')",
    "prefix_totals": f"{_DATA} select n, {_slice('1', '(n - 1)')} as prefix, cast(sum(cnt) as bigint) as n0, count(*) as n1 from g where n > 1 group by all",
    "left_fanout": f"{_DATA} select n, {_slice('2', '(n - 1)')} as suffix, cast(sum(cnt) as bigint) as n0, count(*) as n1 from g where n > 1 group by all",
    "mid_fanout": f"{_DATA} select n, {_slice('2', '(n - 2)')} as middle, cast(sum(cnt) as bigint) as n0, count(*) as n1 from g where n > 2 group by all",
    "pair_counts": f"{_DATA} select n, w1 as a, {_LAST} as b, cast(sum(cnt) as bigint) as n0 from g where n > 2 group by all",
    "window_cooccurrence": f"{_DATA}, ab as (select w1 as a, {_LAST} as b, cnt from g where n > 1), ba as (select * from ab union all select b, a, cnt from ab) select a, b, cast(sum(cnt) as bigint) as n0 from ba where a <= b group by a, b",
    "missing_count": _STATS + " " + " union all ".join(f"select concat_ws(' ', {', '.join(f'c{i + 1}' for i in range(k))}) as context, {k} as k, cast(x0_{k} - r0_{k} as bigint) as missing from sx{k} where x0_{k} > 0" for k in range(1, 5)),
    "n1mod": f"{_STATS} select c1 as x, c2 as y, round(l1_2 + cast({1.0 / K} as double) * (y0_2 - l0_2), 6) as n1mod from sy2",
    "bad_context": f"{_CORPUS} select doc_id, {', '.join(f'cast(sum({b}_{k}::int) as bigint) as {b}_{k}' for k in range(1, 5) for b in ('bad', 'kbad'))} from (select *, {_flags()} from kpos) group by doc_id",
    "mincnt_unk": f"{_CORPUS} {_MINCNT}",
    **{f"bits_{m}": _bits_sql(m) for m in MODELS},
    "token_bits": f"{_FEATS} select k.doc_id, k.line_no, cast(k.i as integer) as i, k.y, {', '.join(f'round({bits(f'p{n}')}, 6) as bits_{n}' for n in range(1, 6))} from kpos k join {_scored('knmod')} s on k.y = s.y and k.x1 = s.x1 and {' and '.join(f'k.x{j} is not distinct from s.x{j}' for j in (2, 3, 4))}",
    "cross_entropy": f"{_FEATS} " + " union all ".join(_entropy(m) for m in MODELS),
    "cross_entropy_by_lang": f"{_STATS}, lpos as (select lang, x4, x3, x2, x1, y, count(*) as times from kpos group by all), lf as {_features('lpos')} {_entropy('knmod', 'lf', 'lang, ')}",
    "verify_norm": _norm(),
    "request_patterns": _requested("knmod"),
    **{f"request_patterns_{m}": _requested(m) for m in MODELS if m not in ("knmod", "gbits")},
    "bits_mincnt": f"{_STATS}, mpos as ({_MINCNT}), mf as {_features('mpos')} select x4, x3, x2, x1, y, times, round({bits('p5')}, 6) as bits_5 from {_scored('knmod', 'mf')}",
    "headword": f"{_HEADS} select id, head, word from q",
    "capmatch": f"{_REQ} select id, {_CAP.format(h='head', w='word')} as result from q0",
    "mormatch": f"{_MORPH} select id, form from m",
    "submatch": f"{_MORPH}, r as (select c.id, head0, {_FIRST} as r from c join m on m.id = c.id) select distinct id, {_CAP.format(h='head0', w='r')} as result from r",
}
