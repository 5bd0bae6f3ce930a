"""SQL of the line grammar: the same reading of an entry written once more, as list functions over words, with patterns of its own."""

from __future__ import annotations

P1 = "p1 as (select * from part1_vernacular qualify row_number() over (partition by seq order by loaded_at) = 1)"
P2 = "p2 as (select * from part2_scientific qualify row_number() over (partition by seq order by loaded_at) = 1)"

_PLANT = r"'^(\p{Lu}(\p{Ll}|[?\[]|\.\.)|\[\p{Ll}|\?$|\.\.|--)'"
_FOLDED = "'" + "''" * 3 + '"' * 3 + "'"
_READ = r"""
x0 as (select seq, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(translate(raw, '‘’‚“”„', FOLDED), '[\s\x{a0}]*[—–][\s\x{a0}]*', '--', 'g'), '[\s\x{a0}]+([,.;])', '\1', 'g'), '[\s\x{a0}]+', ' ', 'g')), '^[^0-9A-Za-zÀ-ÿ(?\[]+', '') x from p1),
b as (select seq, x, array_to_string(list_transform(string_split(replace(x, '(', ' ('), '('), lambda s, i: case when i = 1 then s else '(' || replace(string_split(s, ')')[1], ' ', chr(2)) || s[length(string_split(s, ')')[1]) + 1:] end), '') y from x0 where x <> ''),
w as (select seq, x, list_filter(string_split(y, ' '), lambda s: s <> '') w from b),
v as (select * from w where not (len(w) = 1 and (regexp_full_match(w[1], '[0-9]{1,3}') or regexp_full_match(w[1], '[A-Z]\.') or (length(w[1]) <= 7 and ltrim(w[1], 'IVXL') = ''))
 or len(w) = 2 and regexp_full_match(w[1], '[0-9]{1,3}') and regexp_full_match(w[2], '[0-9]{1,3}'))),
k as (select *, coalesce(list_position(list_transform(w, lambda s, i: (length(rtrim(s, '-~*')) > 1 and right(rtrim(s, '-~*'), 1) in ('.', ',', ';') and left(right(rtrim(s, '-~*'), 2), 1) not in ('.', ',', ';'))
 or left(coalesce(w[i + 1], ''), 1) = '(' or (length(regexp_replace(s, '[^\p{Lu}]', '', 'g')) >= 2 and regexp_matches(coalesce(w[i + 1], ''), PLANT))), true), 0) k from v),
a as (select *, w[k + 1:] a, array_to_string(w[1:greatest(k, 1)], ' ') h0 from k),
tg as (select *, list_transform(a, lambda s: case when regexp_full_match(s, '([A-Za-z0-9_\[\]|'']{1,5}[.:]|[A-Z]\p{Ll}{1,3}\.-[A-Z]\p{Ll}{1,3}[.:]?)[?]?[,;]?[*=+~-]*') then 'm'
 when left(s, 1) = '(' and right(rtrim(s, '.,;:'), 1) = ')' then 'p' when not regexp_matches(s, '[\p{L}0-9?(\[]') then 'd' else 'o' end) c from a),
m as (select *, coalesce(list_position(c, 'o'), 0) m from tg),
r as (select *, list_filter(a, lambda s, i: i < m and c[i] = 'm') ms, list_filter(a, lambda s, i: i < m and c[i] = 'p')[1] p0, case when m > 0 then replace(ltrim(array_to_string(a[m:], ' '), '''‘’'), chr(2), ' ') end s0 from m),
g as (select seq, x, k, m, h0, regexp_replace(regexp_replace(regexp_replace(h0, '([A-Za-zÀ-ÿ])\.([A-Za-zÀ-ÿ])', '\1\2', 'g'), '([A-Za-zÀ-ÿ])\.([A-Za-zÀ-ÿ])', '\1\2', 'g'), '^[^A-Za-zÀ-ÿ]+|[^A-Za-zÀ-ÿ]+$', '', 'g') h1,
 case when len(ms) > 0 then case when right(rtrim(h0, '-~*'), 1) = ';' then '; ' else ', ' end || rtrim(array_to_string(list_transform(ms, lambda s: rtrim(s, '-~*=+')), ' '), ',;') else '' end l,
 coalesce(trim(regexp_extract(replace(p0, chr(2), ' '), '^\((.*)\)', 1)), '') p, s0 s from r),
e as (select seq, x, case when k > 0 and m > 0 and length(h0) between 2 and 60 and h1 <> '' and regexp_matches(s, PLANT) then h1 end head, l, p, trim(s) s from g)"""

GRAMMAR_SQL = f"with {P1}, " + _READ.replace("PLANT", _PLANT).replace("FOLDED", _FOLDED)
MARKERS_SQL = "list_transform(list_filter(string_split(replace(replace(l, ',', ' '), ';', ' '), ' '), lambda s: s <> ''), lambda s: rtrim(rtrim(s, '?'), '.:'))"
