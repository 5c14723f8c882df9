"""DuckDB SQL for the registered queries that SQL can express: counts and verdicts said anew, over whole tables."""

from __future__ import annotations

from inkstream.llm import licenses, mixing, quality, secrets

WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _share_distance(counts: list[str], total: str, shares: list[float]) -> str:
    """Jensen-Shannon distance of counts/total from shares."""
    terms = []
    for count, share in zip(counts, shares):
        p, q = f"({count} / {total}::double)", f"{share!r}::double"
        mid = f"(({p} + {q}) / 2)"
        terms.append(f"(case when {p} > 0 then {p} * log2({p} / {mid}) else 0.0 end + {q} * log2({q} / {mid}))")
    return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0.0))"


def divergence() -> str:
    listed = sorted({w for words in quality.COMMON_WORDS.values() for w in words})
    classes = [(name, pattern.rstrip("+").replace("'", "''")) for name, pattern in quality.CLASSES]
    counts = ", ".join(f"length(regexp_replace(s, '[^{pattern[1:]}', '', 'g')) as c_{name}" for name, pattern in classes)
    own = [f"c_{name}" for name, _ in classes]
    hits = ", ".join(f"len(list_filter(low, lambda x: x = '{w}')) as w_{w}" for w in listed)
    by_class = ", ".join(_share_distance([*own, f"(word_chars - {' - '.join(own)})"], "word_chars", list(shares)) for shares in quality.CLASS_SHARES.values())
    by_word = ", ".join(
        _share_distance([*(f"w_{w}" for w in words), f"(n_words - {' - '.join(f'w_{w}' for w in words)})"], "n_words", [*words.values(), 1 - sum(words.values())]) for words in quality.COMMON_WORDS.values()
    )
    return rf"""with d as (select doc_id, text, {WORDS.format('text')} as w from documents),
 g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
 r as (select doc_id, count(*) as n from (select distinct doc_id, i + k as at from g, range(0, 3) t(k) where n > 1) group by doc_id),
 b as (select d.doc_id, len(w) as n_words, array_to_string(w, '') as s, list_transform(w, lambda x: lower(x)) as low, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
 coalesce(r.n, 0) as n_repeat_words from d left join r using (doc_id)),
 c as (select doc_id, n_words, length(s) as word_chars, len(lines) - len(list_distinct(lines)) as n_dup_lines, n_repeat_words, {counts}, {hits} from b),
 j as (select *, case when word_chars >= {quality.MIN_CHARS} and 2 * (word_chars - {' - '.join(own)}) <= word_chars then least({by_class}) end as by_class, case when n_words >= {quality.MIN_WORDS} and 2 * (word_chars - {' - '.join(own)}) <= word_chars then least({by_word}) end as by_word,
 n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
 select doc_id, n_words, word_chars, c_symbols as n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and not coalesce(by_class > {quality.CLASS_LIMIT}, false) and not coalesce((by_class + by_word) / 2 > {quality.MEAN_LIMIT}, false) as kept, round(by_class, 9) as class_distance, round(by_word, 9) as word_distance from j"""


def _letters(word: str) -> str:
    """A pattern of a word in either case, of A-Z alone."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def secret_spans() -> str:
    names = "|".join(map(_letters, ("password", "passwd", "secret", "token"))) + f"|{_letters('api')}_?{_letters('key')}"
    assign = rf"""(?:{names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    assert secrets.ASSIGN.startswith("(?i:password|passwd|secret|token|api_?key)")
    kinds = [("assign", assign, 1, "length(v) >= 6"), ("access", secrets.ACCESS, 0, "length(v) >= 20"), ("hex", r"[0-9a-f]+", 0, "length(v) >= 24"), ("entropy", secrets.CANDIDATE, 0, f"length(v) >= {secrets.WINDOW}")]
    found = " union all ".join(
        f"select doc_id, {rank} as k, '{kind}' as kind, text, string_split_regex(text, '{pattern}') as p, regexp_extract_all(text, '{pattern}', 0) as m, regexp_extract_all(text, '{pattern}', {group}) as vs from d where regexp_matches(text, '{pattern}')"
        for rank, (kind, pattern, group, _) in enumerate(kinds)
    )
    long_enough = " or ".join(f"k = {rank} and {test}" for rank, (*_, test) in enumerate(kinds))
    allowed = " or ".join(f"regexp_matches(v, '{p}')" for p in secrets.ALLOWED)
    limit = "case " + " ".join(f"when regexp_matches(v, '{p}') then {bits}" for p, bits in secrets.CLASSES.items()) + f" else {secrets.MIXED_BITS} end"
    w = secrets.WINDOW
    joined = "string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e)"
    return f"""with d as (select doc_id, coalesce(text, '') as text from documents), f as ({found}),
 u as (select doc_id, k, kind, p, m, vs, unnest(range(1, len(m) + 1)) as i from f),
 x as (select doc_id, k, kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s, length(m[i]) as n, vs[i] as v from u),
 y as (select doc_id, k, kind, s::bigint as s, (s + n)::bigint as e, v from x where {long_enough}),
 base as (select doc_id, k, kind, s, e from y where k < 3),
 runs as (select doc_id, s, v, {limit} as bits, list_filter(string_split_regex(v, '{secrets.JOINTS}'), lambda x: x <> '') as parts from y where k = 3 and not ({allowed})),
 secret as (select * from runs where not (len(parts) > 1 and len(list_filter(parts, lambda x: not regexp_matches(x, '{secrets.WORD}'))) = 0)),
 windows as (select doc_id, s as run, s + i as s, bits, substr(v, i + 1, {w}) as v from (select *, unnest(range(0, length(v) - {w - 1})) as i from secret)),
 hot as (select doc_id, run, s from windows where list_aggregate(string_split(v, ''), 'entropy') >= bits),
 cut as (select *, s - coalesce(lag(s) over (partition by doc_id, run order by s), -1000000) > {w} as fresh from hot),
 numbered as (select *, sum(fresh::int) over (partition by doc_id, run order by s) as nth from cut),
 spans as (select doc_id, 3 as k, 'entropy' as kind, min(s)::bigint as s, (max(s) + {w})::bigint as e from numbered group by doc_id, run, nth),
 added as (select * from spans a where not exists (select 1 from base b where b.doc_id = a.doc_id and b.s <= a.s and b.e >= a.e)),
 counted as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex, {joined} as line from base group by doc_id),
 every as (select doc_id, {joined} as line, count(*) filter (where k = 3) as n_entropy from (select * from base union all select * from added) group by doc_id)
 select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(c.line, '')) as base_sha256, coalesce(a.line, '') as spans, coalesce(n_entropy, 0) as n_entropy
 from d left join counted c using (doc_id) left join every a using (doc_id)"""


def mixture() -> str:
    weight = "[" + ", ".join(map(str, mixing.WEIGHTS)) + f"][(row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1]"
    most = mixing.MAX_REPEATS
    return f"""with d as (select doc_id, source, len({WORDS.format('text')}) as size, ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', doc_id::varchar, text)), 1, 15))::bigint as h from documents),
 s as (select source, sum(size)::bigint as size, {weight} as weight from d group by source),
 o as (select *, row_number() over (order by {most} * size / weight::double, source nulls last) as k from s),
 t as (select *, ({mixing.OVERSAMPLE} * (select sum(size) from s) - coalesce(sum({most} * size) over (order by k rows between unbounded preceding and 1 preceding), 0))::double / sum(weight) over (order by k rows between current row and unbounded following) as unit from o),
 level as (select min(k) as k from t where unit * weight <= {most} * size),
 target as (select source, t.size, case when t.k < level.k then ({most} * t.size)::double else (select unit from t x where x.k = level.k) * weight end as target from t, level),
 flow as (select *, least(floor(target)::bigint, {most} * size) as routed from target),
 plan as (select *, case when size > 0 then routed // size else 0 end as times, case when size > 0 then routed % size else 0 end as rest from flow),
 cells as (select source, h, sum(size)::bigint as cell, (sum(sum(size)) over (partition by source order by h))::bigint as upto from d group by source, h)
 select doc_id, d.size, plan.size as source_size, target, (times * d.size + case when rest = 0 then 0 when upto <= rest then d.size when upto - cell <= rest then floor(d.size * (rest - (upto - cell)) / greatest(cell, 1)::double) else 0 end)::bigint as taken,
 case when d.source is null then '[null]' else '["' || d.source || '"]' end as pattern
 from d join plan on d.source is not distinct from plan.source join cells c on c.source is not distinct from d.source and c.h = d.h"""


def substrings(k: int = 20) -> str:
    return f"""with d as (select doc_id, {WORDS.format('text')} as w from documents),
 g as (select doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - {k - 2})) as i from d)),
 later as (select doc_id, i from (select doc_id, i, row_number() over (partition by gram order by doc_id, i) as r from g) where r > 1),
 gone as (select distinct doc_id, i + j as pos from later, range(0, {k}) t(j)),
 v as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
 kept as (select v.doc_id, string_agg(word, ' ' order by pos) as line from v anti join gone on v.doc_id = gone.doc_id and v.pos = gone.pos group by v.doc_id),
 n as (select doc_id, count(*) as n from gone group by doc_id)
 select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(line, '')) as kept_sha256 from d left join kept using (doc_id) left join n using (doc_id)"""


def near_groups(width: int = 4, percent: int = 80) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = f"translate(text, '{upper}', '{upper.lower()}')"
    return f"""with recursive d as (select doc_id, {WORDS.format(low)} as w from documents),
 s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) end) as g from d),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
 l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= {percent} * (x.n + y.n - common)),
 e as (select a, b from l union all select b, a from l),
 r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
 c as (select a, min(b) as b from r group by a)
 select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) as component_id, least(d.doc_id, coalesce(b, d.doc_id)) = d.doc_id as kept
 from d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id"""


def _tokens(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex(lower({text}), '{licenses._TOKEN}'), lambda t: trim(t, '.')), lambda t: t <> '')"


def _scored(name: str, units: str, templates: dict[str, tuple[str, ...]], least: float) -> str:
    """Common table expressions that end in ``name``: each unit's best template, of units (doc_id, line, n_tokens, tokens)."""
    rows, idf, unknown = licenses.template_vectors(templates)
    vectors = ", ".join(f"('{a}', {i}, '{t}', {u!r}::double)" for a, i, t, u in rows)
    weights = ", ".join(f"('{t}', {w!r}::double)" for t, w in idf.items())
    return f"""{name}_v(license, template, token, unit) as (values {vectors}), {name}_i(token, idf) as (values {weights}),
 {name}_c as (select doc_id, line, n_tokens, token, count(*) as n from (select doc_id, line, n_tokens, unnest(tokens) as token from {units}) group by all),
 {name}_w as (select c.*, n * coalesce(idf, {unknown!r}) as w, idf is not null as known from {name}_c c left join {name}_i using (token)),
 {name}_n as (select doc_id, line, n_tokens, sqrt(sum(w * w)) as norm from {name}_w group by all having sqrt(coalesce(sum(w * w) filter (where known), 0)) >= {least - 1e-6!r} * sqrt(sum(w * w))),
 {name}_d as (select doc_id, line, n_tokens, license, template, round(sum(w * unit) / any_value(norm), 9) as cosine from {name}_w join {name}_n using (doc_id, line, n_tokens) join {name}_v using (token) group by all),
 {name} as (select doc_id, line, n_tokens, license, cosine from (select *, row_number() over (partition by doc_id, line, n_tokens order by cosine desc, license, template) as k from {name}_d where cosine >= {least}) where k = 1)"""


def license_scan() -> str:
    holder = licenses.HOLDER.replace("(?=all rights reserved)", "(all rights reserved)").replace("\\u00a9", "©")
    spdx = licenses.SPDX.replace(r"(?!(?:NONE|NOASSERTION)\b)", "")
    assert holder != licenses.HOLDER and spdx != licenses.SPDX
    cue, part, gap = licenses.CUE, licenses.PART, licenses.GAP.replace("\\n", "\n")
    return f"""with f as (select doc_id, concat_ws('/', source, lang, doc_id::varchar) as path, text, regexp_matches(text, '{cue}') as cue from documents),
 li as (select doc_id, unnest(string_split(text, chr(10))) as words, generate_subscripts(string_split(text, chr(10)), 1) as line from f where cue),
 lt as (select doc_id, line, len({_tokens('words')}) as n_tokens, {_tokens(f"regexp_replace(words, '{holder}', '{chr(92)}1', 'g')")} as tokens from li where regexp_matches(words, '{cue}')),
 {_scored('notice', 'lt', licenses.TEMPLATES, licenses.MIN_COSINE)},
 bp as (select doc_id, string_split_regex(regexp_replace(text, '{chr(13)}{chr(10)}?', chr(10), 'g'), '{gap}') as parts from f where cue),
 ba as (select doc_id, parts, list_filter(range(1, len(parts) + 1), lambda i: regexp_matches(parts[i], '{part}')) as at_ from bp),
 bu as (select doc_id, unnest(at_) as line, unnest(list_transform(at_, lambda i: parts[i])) as words from ba union all select doc_id, -1, array_to_string(parts[at_[1]:at_[-1]], chr(10)) from ba where len(at_) > 1),
 bt as (select doc_id, line, len({_tokens('words')}) as n_tokens, {_tokens('words')} as tokens from bu),
 {_scored('block', 'bt', licenses.full_texts(), licenses.MIN_BLOCK_COSINE)},
 sp as (select doc_id, list_filter(regexp_extract_all(text, '{spdx}', 1), lambda x: not regexp_matches(x, '^(NONE|NOASSERTION)\\b'))[1] as x from f where cue),
 own as (select doc_id, license, cosine, n_tokens, 'line' as kind from notice union all select doc_id, license, cosine, n_tokens, case when line < 0 then 'joined' else 'block' end from block
 union all select doc_id, regexp_replace(x, '\\b((?:A|L)?GPL-[0-9.]*[0-9])(?:-only|-or-later|\\+)', '\\1', 'g'), 1.0::double, 0, 'spdx' from sp where x is not null),
 rk as (select *, case when kind = 'spdx' then 0 when kind = 'joined' then 1 when license <> 'Proprietary' then 2 else 3 end as rank from own),
 bs as (select doc_id, arg_min(license, (rank, -cosine, license)) as own, arg_min(cosine, (rank, -cosine, license)) as cosine,
 greatest(coalesce(sum(n_tokens) filter (where kind = 'line'), 0), coalesce(sum(n_tokens) filter (where kind = 'block'), 0), coalesce(sum(n_tokens) filter (where kind = 'joined'), 0)) as n_tokens from rk group by doc_id),
 r as (select f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') as at_, own, cosine, coalesce(n_tokens, 0) as n_tokens, len(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')) as n_words from f left join bs using (doc_id)),
 dirs as (select at_ as directory, arg_min(own, path) as theirs from r where own is not null and (regexp_matches(path, '{licenses.FILE}') or n_tokens >= {licenses.FILE_SHARE} * n_words) group by at_),
 above as (select at_, unnest(list_transform(range(0, len(string_split(at_, '/')) + 1), lambda n: array_to_string(string_split(at_, '/')[1:n], '/'))) as directory from (select distinct at_ from r where own is null)),
 nearest as (select at_, arg_max(directory, (length(directory), directory)) as directory, arg_max(theirs, (length(directory), directory)) as theirs from above join dirs using (directory) group by at_)
 select r.doc_id, coalesce(own, theirs) as license, cosine, own is null and theirs is not null as inherited, n.directory from r left join nearest n on r.own is null and n.at_ = r.at_"""
