"""SQL equivalents of the catalogue's queries, for DuckDB over the same tables.

Each is written on its own from the definition of its query, from the tables up.
"""

from __future__ import annotations

import re
import unicodedata

from ..functions import stemming as S
from ..functions import text as T
from ..operators import lemmas
from ..operators.phrase import NOTES
from ..sources.documents import SAMPLE
from . import catalogue as c


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


_WORDS = f"""
with docs as (
    select doc_id, coalesce(text, '') as text from documents
), raw as (
    select doc_id, list_filter(list_transform(regexp_split_to_array(text, {_quoted(T.BLANKS)}), lambda x: regexp_replace(x, {_quoted(T.EDGES)}, '', 'g')), lambda x: x <> '') as raw_tokens from docs
), low as (
    select *, list_transform(raw_tokens, lambda x: lower(x)) as lower_tokens from raw
), hyp as (
    select *, flatten(list_transform(lower_tokens, lambda t: case when contains(t, '-') then list_concat([t], string_split(t, '-')) else [t] end)) as hyph_tokens from low
), cln as (
    select *, list_filter(hyph_tokens, lambda t: regexp_matches(t, '[a-zA-Z0-9]')) as clean_tokens from hyp
), fin as (
    select doc_id, raw_tokens, lower_tokens, hyph_tokens, clean_tokens,
           list_filter(clean_tokens, lambda t: lower(t) not in {_list(T.STOP_WORDS)}) as final_tokens,
           list_filter(clean_tokens, lambda t: lower(t) in {_list(T.STOP_WORDS)}) as removed_sw,
           list_filter(lower_tokens, lambda t: regexp_matches(t, '[a-z0-9]')) as phrase_tokens
    from cln
), toks as (
    select doc_id, unnest(final_tokens) as term, unnest(range(len(final_tokens))) as pos from fin
), post as (
    select term, doc_id, count(*) as tf from toks group by all
), freq as (
    select term, count(*) as df, sum(tf)::bigint as cf from post group by term
), vocabulary as (
    select distinct term from toks
), places as (
    select doc_id, unnest(phrase_tokens) as term, unnest(range(len(phrase_tokens))) as pos from fin
), bi as (
    select distinct a.term || ' ' || b.term as biword, a.doc_id as doc_id from places a join places b on a.doc_id = b.doc_id and b.pos = a.pos + 1
), grams as (
    select term, i, substring('$' || term || '$', i::int, 3) as kgram from (select term, unnest(range(1, length(term) + 1)) as i from vocabulary)
)"""


def _stage(column: str) -> str:
    return f"{_WORDS} select doc_id, unnest(range(len({column})))::int as pos, unnest({column}) as token from fin"


def _has(term: str) -> str:
    return f"doc_id in (select doc_id from post where term = {_quoted(term)})"


def _bool(condition: str) -> str:
    return f"{_WORDS} select doc_id from docs where {condition}"


def _starts(phrase: str) -> str:
    words = phrase.split()
    joins = "".join(f" join places p{i} on p{i}.doc_id = p0.doc_id and p{i}.pos = p0.pos + {i} and p{i}.term = {_quoted(w)}" for i, w in enumerate(words) if i)
    return f"select distinct p0.doc_id as doc_id, p0.pos as start from places p0{joins} where p0.term = {_quoted(words[0])}"


def _positional(phrase: str) -> str:
    return f"{_WORDS} select doc_id, min(start)::int as start from ({_starts(phrase)}) group by doc_id"


def _candidates(phrase: str) -> str:
    words = set(phrase.split())
    return " intersect ".join(f"select doc_id from places where term = {_quoted(w)}" for w in sorted(words))


def _by_biwords(phrase: str) -> str:
    words = phrase.split()
    return " intersect ".join(f"select doc_id from bi where biword = {_quoted(a + ' ' + b)}" for a, b in zip(words, words[1:]))


def _compare(phrase: str, observed: bool) -> str:
    wrong = "fp" if observed else "fp and bw"
    return f"""{_WORDS}, found as (
        select doc_id, doc_id in ({_by_biwords(phrase)}) as bw, doc_id in (select doc_id from ({_starts(phrase)})) as ps,
               doc_id in ({_candidates(phrase)}) and doc_id not in (select doc_id from ({_starts(phrase)})) as fp
        from (select distinct doc_id from docs))
        select doc_id as "Document", if(bw, '✅', '❌') as "Biword Match", if(ps, '✅', '❌') as "Positional Match",
               case when {wrong} then {_quoted(NOTES["false"])} when bw and ps then {_quoted(NOTES["both"])} when ps then {_quoted(NOTES["positional"])}
                    when bw then {_quoted(NOTES["biword"])} else {_quoted(NOTES["none"])} end as "Note" from found"""


def _keys() -> str:
    return "(values " + ", ".join(f"({_quoted(k)})" for k in c.KEYS) + ") k(query)"


_FIRST = """, seen as (select term, count(distinct doc_id) as df, min(doc_id * 4294967296 + pos) as first from toks group by term)"""

_STATS = (
    _FIRST
    + """, stats as (
    select count(*) as vocab_size, coalesce(sum(df), 0)::bigint as total_postings, coalesce(round(avg(df), 2), 0.0) as avg_df,
           (select term from seen order by df desc, first limit 1) as max_df_term, (select term from seen order by df, first desc limit 1) as min_df_term,
           count(*) filter (df = 1) as singleton_terms, (select count(*) from docs) as doc_count from seen)"""
)

_METRICS = (("Vocabulary Size", "vocab_size"), ("Total Postings", "total_postings"), ("Document Count", "doc_count"), ("Average Document Frequency", "avg_df"), ("Max DF Term", "max_df_term"), ("Min DF Term", "min_df_term"), ("Singleton Terms", "singleton_terms"))

_BST = f"""{_WORDS}, tree as (select term, md5(term) as prio from vocabulary),
asked as (select query, (select prio from tree where term = query) as lim from {_keys()}),
sides as (select query, lim, term, prio, term < query as below from tree, asked where term <> query),
walked as (
    select query, prio, lim, case when below then min(prio) over (partition by query, below order by term desc rows between unbounded preceding and 1 preceding)
                                  else min(prio) over (partition by query, below order by term rows between unbounded preceding and 1 preceding) end as least
    from sides)
select query, lim is not null as found, ((select count(*) from walked w where w.query = asked.query and (w.least is null or w.prio < w.least) and (w.lim is null or w.prio < w.lim))
       + if(lim is not null, 1, 0))::bigint as comparisons from asked"""

_VECTORS = f"""{_WORDS}, spaced as (
    select doc_id, unnest(regexp_extract_all(lower(array_to_string(final_tokens, ' ')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from fin
), tf as (select doc_id, term, count(*) as tf from spaced group by all),
idf as (select term, ln((1 + (select count(*) from docs)) / (1 + count(*))) + 1 as idf from tf group by term),
w as (select doc_id, term, tf * idf as w from tf join idf using (term)),
norm as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id),
asked as (select query, unnest(list_filter(list_transform(string_split(query, ' '), lambda x: lower(x)), lambda x: x not in {_list(T.STOP_WORDS)})) as term from (values {", ".join(f"({_quoted(q)})" for q in c.COSINE)}) q(query)),
wq as (select query, term, count(*) * any_value(idf) as w from asked join idf using (term) group by all),
nq as (select query, sqrt(sum(w * w)) as norm from wq group by query)
select wq.query as query, w.doc_id as doc_id, round(sum(w.w / norm.norm * (wq.w / nq.norm)), {c.TFIDF_DIGITS}) as sim
from w join wq using (term) join norm on norm.doc_id = w.doc_id join nq on nq.query = wq.query group by all"""

#: Edit distance by code points: a misspelling is plain ASCII, so what isn't in a term may be any one other byte.
def _distance(term: str, query: str) -> str:
    return f"levenshtein(regexp_replace({term}, '[^\\x00-\\x7f]', chr(1), 'g'), {query})"


def _common(term: str, query: str) -> str:
    """Length of the longest common subsequence, by one bit for each character of the query."""
    bits = f"list_transform(string_split({term}, ''), lambda ch: list_sum(list_transform(range(length({query})), lambda i: if(substring({query}, i::int + 1, 1) = ch, 1::bigint << i::int, 0)))::bigint)"
    full = f"((1::bigint << length({query})::int) - 1)"
    row = f"list_reduce(list_prepend({full}, {bits}), lambda r, m: ((r + (r & m)) | (r & ~m)) & {full})"
    return f"(length({query}) - bit_count({row}))"


_SPELLED = f""", wrong as (select unnest({[q for q in dict.fromkeys(c.MISSPELLED)]}) as query),
pairs as (select query, term, 200.0::double * {_common("term", "query")} / (length(term) + length(query)) as score from vocabulary, wrong where query not in (select term from vocabulary)),
rated as (select *, row_number() over (partition by query order by score desc, term) as n from pairs where score >= 50 qualify n <= 15),
near as (select *, {_distance("term", "query")} as distance from rated where {_distance("term", "query")} <= 2),
placed as (select *, row_number() over (partition by query order by distance, score desc, n) as place from near qualify place <= 5),
suggested as (select query, place::int as place, term, score, distance::int as distance from placed
              union all select query, 1, query, 100.0, 0 from wrong where query in (select term from vocabulary))"""


def _forms() -> str:
    """Characters that Soundex sees otherwise than as their own capital, by rule from the character database (Hangul and Han forms, which have no code, left out)."""
    made = {}
    for o in (*range(0x80, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)):
        form = unicodedata.normalize("NFKD", chr(o)).upper()
        if form != chr(o):
            made[chr(o)] = form
    return "map([" + ", ".join(map(_quoted, made)) + "], [" + ", ".join(map(_quoted, made.values())) + "])"


_SOUNDEX = f""", forms as materialized (select {_forms()} as form),
signs as (select term, array_to_string(list_transform(string_split(term, ''), lambda ch: coalesce(form[ch], upper(ch))), '') as s from vocabulary, forms),
heard as (select term, substring(s, 1, 1) as head, substring(s, 1, 1) || regexp_replace(substring(s, 2), '[HW]', '', 'g') as s from signs),
spoken as (select term, head, list_transform(string_split(s, ''), lambda ch: case when strpos('BFPVCGJKQSXZDTLMNR', ch) > 0 then translate(ch, 'BFPVCGJKQSXZDTLMNR', '111122222222334556') else '0' end) as d from heard),
codes as (select term, substring(head || array_to_string(list_filter(list_transform(range(2, len(d) + 1), lambda i: case when d[i] <> d[i - 1] then d[i] else '0' end), lambda x: x <> '0'), '') || '000', 1, 4) as code from spoken)"""

_MISSED = _quoted(c.MISSPELLED[0])
_SAME_CODE = f"select code, term from codes where code = (select substring(upper({_MISSED}), 1, 1) || '250')"

#: Metaphone, sign by sign: what each gives depends on two signs before it and three after (# where there are none). Signs that a rule before takes along give nothing either way, but for G after D and C after S.
_METAPHONE = f""", plain_signs as (select term, regexp_replace(s, '\\p{{M}}', '', 'g') as s from signs union select {_MISSED}, upper({_MISSED})),
begun as (select term, case when left(s, 2) in ('KN', 'GN', 'PN', 'WR', 'AE') then substring(s, 2) else s end as s from plain_signs),
padded_signs as (select term, '##' || case when left(s, 1) = 'X' then 'S' || substring(s, 2) when left(s, 2) = 'WH' then 'W' || substring(s, 3) else s end || '###' as p from begun),
places_of as (select term, p, unnest(range(3, length(p) - 2))::int as i, length(p) - 5 as n from padded_signs),
around as (select term, i, n, p, substring(p, i, 1) as c, substring(p, i - 1, 1) as b, substring(p, i - 2, 1) as b2, substring(p, i + 1, 1) as a, substring(p, i + 2, 1) as a2 from places_of),
said as (select term, i, case
    when c = b and c <> 'C' then ''
    when c in ('A', 'E', 'I', 'O', 'U') then if(i = 3, c, '')
    when c = 'B' then if(b = 'M' and i = n + 2, '', 'B')
    when c = 'C' and b = 'S' and a = 'H' and b2 <> 'S' then ''
    when c = 'C' and a in ('E', 'I', 'Y') then case when a = 'I' and a2 = 'A' then 'X' when b <> 'S' then 'S' else '' end
    when c = 'C' and a = 'H' then if(b = 'S' or i = 3 and a2 not in ('A', 'E', 'I', 'O', 'U'), 'K', 'X')
    when c in ('C', 'Q') then 'K'
    when c = 'D' then if(a = 'G' and a2 in ('E', 'I', 'Y'), 'J', 'T')
    when c = 'G' and b = 'D' and b2 <> 'D' and a in ('E', 'I', 'Y') then ''
    when c = 'G' and a = 'H' then if(a2 in ('A', 'E', 'I', 'O', 'U'), 'K', '')
    when c = 'G' and a = 'N' and (i + 2 = n + 3 or substring(p, i + 2) = 'ED###') then ''
    when c = 'G' then if(a in ('E', 'I', 'Y'), 'J', 'K')
    when c = 'H' then if(a in ('A', 'E', 'I', 'O', 'U') and b not in ('C', 'G', 'P', 'S', 'T'), 'H', '')
    when c = 'K' then if(b = 'C', '', 'K')
    when c = 'P' then if(a = 'H', 'F', 'P')
    when c in ('S', 'T') and a = 'I' and a2 in ('O', 'A') then 'X'
    when c = 'S' then case when a = 'H' then 'X' when a = 'C' and a2 = 'H' then 'SK' else 'S' end
    when c = 'T' then case when a = 'H' then '0' when a = 'C' and a2 = 'H' then '' else 'T' end
    when c = 'V' then 'F' when c = 'X' then 'KS' when c = 'Z' then 'S'
    when c in ('W', 'Y') then if(a in ('A', 'E', 'I', 'O', 'U'), c, '')
    when c in ('F', 'J', 'L', 'M', 'N', 'R', ' ') then c else '' end as x from around),
sounds as (select term, ltrim(regexp_replace(string_agg(x, '' order by i), ' +', ' ', 'g')) as code from said group by term),
metaphones as (select * from sounds where code <> '' and term in (select term from vocabulary))"""

_SAME_SOUND = f"select code, term from metaphones where code = (select code from sounds where term = {_MISSED})"
_CORRECTED = f"""select coalesce(term, query) as term, 'spelling' as via from wrong left join (from suggested where place = 1) using (query) where query = {_MISSED} and coalesce(term, query) in (select term from vocabulary)
    union all select term, 'soundex' from ({_SAME_CODE}) union all select term, 'metaphone' from ({_SAME_SOUND})"""

_DEPTHS = """, walked(term, prio, part, depth) as (
    select term, md5(term), '', 1::bigint from vocabulary
    union all
    select term, prio, part || if(term < root, 'l', 'r'), depth + 1
    from (select *, first_value(term) over (partition by part order by prio) as root from walked) where term <> root
), depths as (select term, max(depth) as depth from walked group by term),
shape as (select count(*) as size, max(depth) as height from depths)"""


def _rules(pos: str, word: str) -> str:
    """The lemma of a word by the rules of a part of speech."""
    cases = "".join(f" when regexp_matches({word}, {_quoted(p)}) then " + (word if put == "$0" else f"regexp_replace({word}, {_quoted(p)}, {_quoted(re.sub(r'[$](.)', chr(92) + r'\1', put))})") for p, put in lemmas.RULES[pos])
    special = "".join(f" when {word} = {_quoted(a)} then {_quoted(b)}" for a, b in lemmas.IRREGULAR[pos].items())
    return f"case{special}{cases} else {word} end"


def _lemma(word: str) -> str:
    return f"(case when {_rules('n', word)} <> {word} then {_rules('n', word)} else {_rules('v', word)} end)"


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    return f"list_reduce(list_prepend('', list_filter(string_split({word}, ''), lambda x: x <> '')), lambda a, ch: a || case when ch in ('a', 'e', 'i', 'o', 'u') or (ch = 'y' and right(a, 1) = 'c') then 'v' else 'c' end)"


def _porter(source: str) -> str:
    """CTEs up to stems(term, stem): the extended Porter stems of the terms of a relation, one step after another."""
    cut = lambda n: f"left(w, length(w) - {n})"
    ends = lambda s, x="w": f"{x} like '%{s}'"
    m = "((length(s) - length(replace(s, 'vc', ''))) // 2)"
    cvc = "(case when length(s) = 2 then s = 'vc' else right(s, 3) = 'cvc' and right(stem, 1) not in ('w', 'x', 'y') end)"

    def step(n: int, suffixes: list[str], now: str) -> str:
        """One step: which suffix the word has, the stem before it and its shape, and the word after the step."""
        which = "".join(f" when {ends(x)} then '{x}'" for x in suffixes)
        return f""", q{n} as (select term, w, case{which} else '' end as suf from p{n - 1}),
            r{n} as (select *, left(w, length(w) - length(suf)) as stem from q{n}), t{n} as (select *, {_shape("stem")} as s from r{n}),
            p{n} as (select term, {now} as w from t{n})"""

    def table(rules) -> str:
        return "case" + "".join(f" when suf = '{a}' and {m} > 0 then stem || '{b}'" for a, b in rules) + " else w end"

    by_length = lambda rules, key=lambda r: r: sorted(rules, key=lambda r: -len(key(r)))
    step2 = by_length(S._STEP2, lambda r: r[0])
    past = f"""case when suf = 'ied' then {cut("if(length(w) = 4, 1, 2)")} when suf = 'eed' then if({m} > 0, {cut(1)}, w)
        when suf in ('ed', 'ing') and contains(s, 'v') then case when {ends("at", "stem")} or {ends("bl", "stem")} or {ends("iz", "stem")} then stem || 'e'
            when length(stem) > 1 and right(stem, 1) = left(right(stem, 2), 1) and right(s, 1) = 'c' then if(right(stem, 1) in ('l', 's', 'z'), stem, left(stem, length(stem) - 1))
            when {m} = 1 and {cvc} then stem || 'e' else stem end else w end"""
    fixed = "".join(f" when lower(term) = '{a}' then '{b}'" for a, b in S._PORTER_FORMS.items())
    return (
        f""", p0 as (select term, case when {ends("ies")} and length(w) = 4 then {cut(1)} when {ends("sses")} or {ends("ies")} then {cut(2)}
            when {ends("s")} and not {ends("ss")} then {cut(1)} else w end as w from (select distinct term, lower(term) as w from {source}))"""
        + step(1, ["ied", "eed", "ed", "ing"], past)
        + step(2, ["y"], "if(suf = 'y' and length(w) > 2 and right(s, 1) = 'c', stem || 'i', w)")
        + step(3, ["alli", "logi"], f"case when suf = 'alli' and {m} > 0 then {cut(2)} else w end")
        # of -logi the measure is taken with the l
        + step(4, ["ogi"], f"if(suf = 'ogi' and {ends('l', 'stem')} and {m} > 0, {cut(1)}, w)")
        + step(5, [a for a, _ in step2], table(step2))
        + step(6, [a for a, _ in S._STEP3], table(S._STEP3))
        + step(7, by_length(S._STEP4), f"if(suf <> '' and {m} > 1 and (suf <> 'ion' or right(stem, 1) in ('s', 't')), stem, w)")
        + step(8, ["e"], f"if(suf = 'e' and ({m} > 1 or {m} = 1 and not {cvc}), stem, w)")
        + step(9, ["l"], f"if({ends('ll')} and {m} > 1, stem, w)")
        + f", stems as (select term, case{fixed} when length(term) <= 2 then lower(term) else w end as stem from p9)"
    )


def _snowball(source: str) -> str:
    """CTEs up to stems(term, stem): the stems of the second algorithm, with its regions r1 and r2."""
    ends = lambda s, x="w": f"suffix({x}, '{s.replace(chr(39), chr(39) * 2)}')"
    cut = lambda n: f"left(w, length(w) - {n})"
    vowel, after = "[aeiouy]", "'^.*?[aeiouy][^aeiouy]'"
    region = lambda x: f"case when regexp_matches({x}, {after}) then length(regexp_extract({x}, {after})) else length({x}) end"
    short = lambda x: f"(case when length({x}) = 2 then regexp_matches({x}, '^[aeiouy][^aeiouy]$') else regexp_matches({x}, '[^aeiouy][aeiouy][^aeiouywxY]$') end)"

    def step(n: int, suffixes: list[str], now: str) -> str:
        which = "case when false then ''" + "".join(f" when {ends(x)} then {_quoted(x)}" for x in suffixes)
        return f""", q{n} as (select *, {which} else '' end as suf from p{n - 1}), s{n} as (select *, left(w, length(w) - length(suf)) as stem from q{n}),
            p{n} as (select term, r1, r2, alone, {now} as w from s{n})"""

    def table(rules, start, extra) -> str:
        return "case" + "".join(f" when suf = '{a}' and length(stem) >= {start(a)}{extra.get(a, '')} then stem || '{b}'" for a, b in rules) + " else w end"

    doubles = ", ".join(f"'{c}{c}'" for c in "bdfgmnprt")
    past = f"""case when suf in ('eed', 'eedly') then if(length(stem) >= r1, stem || 'ee', w) when suf <> '' and regexp_matches(stem, '{vowel}') then
        case when {ends("at", "stem")} or {ends("bl", "stem")} or {ends("iz", "stem")} then stem || 'e' when right(stem, 2) in ({doubles}) then left(stem, length(stem) - 1)
             when {short("stem")} and r1 >= length(stem) then stem || 'e' else stem end else w end"""
    plural = f"""case when {ends("sses")} then {cut(2)} when {ends("ied")} or {ends("ies")} then if(length(w) > 4, {cut(2)}, {cut(1)}) when {ends("us")} or {ends("ss")} then w
        when {ends("s")} and regexp_matches({cut(2)}, '{vowel}') then {cut(1)} else w end"""
    fixed = "".join(f" when low = '{a}' then '{b}'" for a, b in S._WHOLE.items())
    no = lambda step: f"if(alone, w, {step})"
    return (
        f""", small as (select distinct term, translate(lower(term), '’‘‛', repeat(chr(39), 3)) as low from {source}),
        bare as (select term, if(starts_with(low, chr(39)), substring(low, 2), low) as b from small),
        marked as (select term, array_to_string(list_transform(range(1, length(b) + 1), lambda i: case when substring(b, i::int, 1) = 'y' and (i = 1 or regexp_matches(substring(b, i::int - 1, 1), '{vowel}')) then 'Y' else substring(b, i::int, 1) end), '') as w from bare),
        first as (select term, w, case when starts_with(w, 'gener') or starts_with(w, 'arsen') then 5 when starts_with(w, 'commun') then 6 else {region("w")} end as r1 from marked),
        p0 as (select term, w, r1, r1 + {region("substring(w, r1::int + 1)")} as r2, false as alone from first)"""
        + step(1, ["'s'", "'s", "'"], "stem")
        + step(2, [], plural)
        + ", pa as (select * replace (w in (" + ", ".join(map(_quoted, sorted(S._ALONE))) + ") as alone) from p2)"
        + step(3, ["eedly", "ingly", "edly", "eed", "ing", "ed"], no(past)).replace("from p2)", "from pa)")
        + step(4, ["y", "Y"], no(f"if(suf <> '' and length(w) > 2 and not regexp_matches(right(stem, 1), '{vowel}'), stem || 'i', w)"))
        + step(5, [a for a, _ in S._SECOND2], no(table(S._SECOND2, lambda a: "r1", {"ogi": f" and {ends('l', 'stem')}", "li": " and regexp_matches(stem, '[cdeghkmnrt]$')"})))
        + step(6, [a for a, _ in S._SECOND3], no(table(S._SECOND3, lambda a: "r2" if a == "ative" else "r1", {})))
        + step(7, list(S._SECOND4), no(table([(a, "") for a in S._SECOND4], lambda a: "r2", {"ion": " and regexp_matches(stem, '[st]$')"})))
        + step(8, ["e", "l"], no(f"case when suf = 'e' and (length(stem) >= r2 or length(stem) >= r1 and not {short('stem')}) then stem when suf = 'l' and length(stem) >= r2 and {ends('l', 'stem')} then stem else w end"))
        + f", stems as (select term, case when length(low) <= 2 then low{fixed} else replace(w, 'Y', 'y') end as stem from p8 join small using (term))"
    )


def _treebank(text: str) -> str:
    for pattern, put in T.TREEBANK:
        text = f"{text} || {_quoted(put)}" if pattern == "$" else f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(re.sub('[$]([0-9])', chr(92) * 2 + chr(92) + '1', put))}, 'g')"
        text = f"({text})"
    return f"list_filter(regexp_split_to_array({text}, {_quoted(T.BLANKS)}), lambda x: x <> '')"


_POSTINGS = "select term, doc_id, tf from post"

_STATES = """
with pos as (
    select term, doc_id, count(*) as n_rows, list_sort(list_distinct(flatten(list(positions) filter (positions is not null)))) as positions
    from positional_index where term is not null and doc_id is not null group by all
), inv as (
    select term, p.doc_id as doc_id, count(*) as n_entries, sum(p.tf)::bigint as tf_sum, max(p.tf)::bigint as tf
    from (select term, unnest(posting_list) as p from inverted_index where term is not null)
    where p.doc_id is not null group by all
)"""


def heavy_key_sql() -> dict[str, str]:
    return {
        "p1_found": "select term from positional_index where term is not null group by term having count(*) >= 0.01 * (select count(*) from positional_index)",
        "p1_row_shares": """
            select term, coalesce(n_rows, 0)::bigint as n_rows, coalesce(n_list_rows, 0)::bigint as n_list_rows, coalesce(n_entries, 0)::bigint as n_entries,
                   (coalesce(n_rows, 0) * coalesce(n_list_rows, 0))::bigint as pair_rows, (select count(*) from positional_index)::bigint as total_rows
            from (select term, count(*) as n_rows from positional_index where term is not null group by term)
            full join (select term, count(*) as n_list_rows, sum(coalesce(len(posting_list), 0)) as n_entries from inverted_index where term is not null group by term) using (term)""",
        "p1_term_totals": _STATES
        + """ select term, count(*)::bigint as n_docs, count(*) filter (n_rows is not null and n_entries is not null)::bigint as n_docs_both,
                   coalesce(sum(len(positions)), 0)::bigint as n_positions, coalesce(sum(tf), 0)::bigint as sum_tf,
                   coalesce(sum(n_rows * n_entries), 0)::bigint as pair_rows, coalesce(sum(n_rows * tf_sum), 0)::bigint as pair_tf
            from pos full join inv using (term, doc_id) group by term""",
        "p1_merged_postings": _STATES
        + """ select term, doc_id, case when n_rows is null then null else coalesce(array_to_string(positions, ','), '') end as positions, tf, n_rows, n_entries, tf_sum
            from pos full join inv using (term, doc_id)""",
        "p1_posting_blocks": _STATES
        + f""", both_ as (select term, doc_id, tf, positions from pos full join inv using (term, doc_id)),
            wide as (select term, ceil(count(*) / {c.P1_BLOCK})::int as blocks from both_ group by term)
            select term, if(blocks > 1, (('0x' || substring(md5(doc_id), 1, 8))::bigint % blocks)::int, 0) as block, count(*) as n_docs,
                   string_agg(doc_id || '(' || coalesce(tf::varchar, '') || ')[' || coalesce(array_to_string(positions, ','), '') || ']', ' ' order by doc_id) as postings
            from both_ join wide using (term) group by all""",
    }


def _compared() -> str:
    """Matches and average similarity of each query with stems and with lemmas."""
    word = "'[\\p{L}\\p{N}_]{2,}'"

    def similar(k: str) -> str:
        return f""", joined_{k} as (select doc_id, lower(string_agg(form, ' ' order by pos)) as t from toks join forms_{k} using (term) group by doc_id),
            tf_{k} as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(t, {word})) as term from joined_{k}) group by all),
            idf_{k} as (select term, ln((1 + (select count(*) from docs)) / (1 + count(*))) + 1 as idf from tf_{k} group by term),
            w_{k} as (select doc_id, term, tf * idf as w from tf_{k} join idf_{k} using (term)), norm_{k} as (select doc_id, sqrt(sum(w * w)) as norm from w_{k} group by doc_id),
            text_{k} as (select query, lower(string_agg(form, ' ')) as t from asked join forms_{k} using (term) group by query),
            wq_{k} as (select query, term, count(*) * any_value(idf) as w from (select query, unnest(regexp_extract_all(t, {word})) as term from text_{k}) join idf_{k} using (term) group by all),
            nq_{k} as (select query, sqrt(sum(w * w)) as norm from wq_{k} group by query),
            sim_{k} as (select q.query, d.doc_id, sum(d.w / n.norm * (q.w / m.norm)) as sim from w_{k} d join wq_{k} q using (term) join norm_{k} n on n.doc_id = d.doc_id join nq_{k} m on m.query = q.query group by all),
            sum_{k} as (select query, count(*) filter (sim > 0) as n, round(avg(sim) filter (sim > 0), 4) as a from sim_{k} group by query)"""

    return f"""{_WORDS}, queries(query) as (values {", ".join(f"({_quoted(q)})" for q in c.COSINE)}),
        asked as (select query, unnest(list_filter(string_split(lower(query), ' '), lambda x: x not in {_list(T.STOP_WORDS)})) as term from queries),
        every as (select term from vocabulary union select term from asked){_porter("every")},
        forms_s as (select term, stem as form from stems), forms_l as (select term, {_lemma("term")} as form from every){similar("s")}{similar("l")}
        select query as "Query", coalesce(s.n, 0)::bigint as "Stem matches", coalesce(l.n, 0)::bigint as "Lemma matches", coalesce(s.a, 0) as "Stem Avg. Similarity", coalesce(l.a, 0) as "Lemma Avg. Similarity",
               case when coalesce(s.a, 0) > coalesce(l.a, 0) then 'Stemming' when coalesce(l.a, 0) > coalesce(s.a, 0) then 'Lemmatization' else 'Tie' end as "Better"
        from queries left join sum_s s using (query) left join sum_l l using (query)"""


_RECURSIVE = _WORDS.replace("with docs", "with recursive docs", 1)
_ASKED = [("biword", "mean average"), ("biword", "average precision"), ("biword", "precision zzz"), ("term", "mean"), ("term", "average"), ("term", "precision"), ("term", "zzz")]
#: The observed reading of a wildcard pads each part once more before it is cut in grams.
_OBSERVED = ", padded as (select '$$' || rtrim(" + _quoted(c.WILDCARDS["wildcard_prefix"]) + ", '*') || '$' as p), wanted as (select substring(p, i::int, 3) as gram from padded, unnest(range(1, length(p) - 1)) u(i))"
_SAMPLE = "[" + ", ".join(map(_quoted, SAMPLE)) + "]"


def oracle_sql() -> dict[str, str]:
    w = _WORDS
    ids = lambda key, source: f"string_agg({key}, ', ' order by {source})"
    wild = lambda p: p.replace("*", "%")
    return heavy_key_sql() | {
        "tok_simple": _stage("raw_tokens"),
        "tok_lower": _stage("lower_tokens"),
        "tok_hyphen": _stage("hyph_tokens"),
        "tok_alnum_filter": _stage("clean_tokens"),
        "tok_stopword_kept": _stage("final_tokens"),
        "tok_stopword_removed": _stage("removed_sw"),
        "tok_case_kept": f"{w}, own as (select doc_id, list_filter(raw_tokens, lambda t: regexp_matches(t, '[a-zA-Z0-9]')) as own from fin) select doc_id, unnest(range(len(own)))::int as pos, unnest(own) as token from own",
        "doc_preview": f"""{w} select doc_id, len(list_filter(regexp_split_to_array(text, {_quoted(T.BLANKS)}), lambda x: x <> ''))::bigint as words, length(text)::bigint as chars,
            replace(substring(text, 1, 120), chr(10), ' ') || if(length(text) > 120, '…', '') as preview from docs""",
        "collection_totals": f"{w} select count(*) as documents, coalesce(sum(len(list_filter(regexp_split_to_array(text, {_quoted(T.BLANKS)}), lambda x: x <> ''))), 0)::bigint as words from docs",
        "majority_language": "select lang, count(*) as n from documents where lang is not null group by lang order by n desc, lang limit 1",
        "doc_lengths": f"{w} select doc_id, len(final_tokens)::bigint as n from fin",
        "inv_set": f"{w} select distinct term, doc_id from toks",
        "inv_set_table": f"""{w} select term as "Term", count(*) as "Doc Frequency", {ids("doc_id::varchar", "doc_id")} as "Posting List" from post group by term""",
        "inv_tf_postings": f"{w} {_POSTINGS}",
        "inv_tf_table": f"""{w} select term as "Term", count(*) as "Document Frequency", sum(tf)::bigint as "Term Frequency", {ids("doc_id::varchar || '(' || tf::varchar || ')'", "doc_id")} as "Posting List" from post group by term""",
        "document_frequencies": f"{w} select term, df, cf from freq",
        "tfidf": f"{w} select term, doc_id, tf, df, round(ln((select count(*) from docs) / df), {c.TFIDF_DIGITS}) as idf, round(tf * ln((select count(*) from docs) / df), 6) as tfidf from post join freq using (term)",
        "index_stats": f"{w}{_STATS} select * from stats",
        "index_stats_table": f"{w}{_STATS} " + " union all ".join(f"""select '{m}' as "Metric", {col}::varchar as "Value" from stats""" for m, col in _METRICS),
        "top10_df": f"{w}{_FIRST} select term, df from seen order by df desc, first limit 10",
        "singleton_terms": f"{w} select term from freq where df = 1",
        "vocab": f"{w} select term from vocabulary",
        "biword_index": f"{w} select biword, doc_id from bi",
        "biword_table": f"""{w} select biword as "Biwords", count(*) as "Document Frequency", {ids("doc_id::varchar", "doc_id")} as "Posting List" from bi group by biword""",
        "positional_index": f"{w} select term, doc_id, string_agg(pos::varchar, ',' order by pos) as positions from places group by all",
        "positional_table": f"""{w} select term as "Term", doc_id as "Document", '[' || string_agg(pos::varchar, ', ' order by pos) || ']' as "Positions", count(*) as "Document frequency" from places group by all""",
        "phrase_biword": f"{w} {_by_biwords(c.PHRASES['phrase_biword'])}",
        **{name: _positional(p) for name, p in c.PHRASES.items() if name != "phrase_biword"},
        "phrase_candidates": f"{w} {_candidates(c.PHRASES['phrase_biword'])}",
        "phrase_false_positives": f"{w} select doc_id from ({_candidates(c.PHRASES['phrase_long'])}) where doc_id not in (select doc_id from ({_starts(c.PHRASES['phrase_long'])}))",
        "phrase_starts": f"{w} select doc_id, start::int as start from ({_starts(c.PHRASES['phrase_long'])})",
        "phrase_compare": _compare(c.PHRASES["phrase_biword"], False),
        "phrase_compare_observed": _compare(c.PHRASES["phrase_biword"], True),
        "dict_inorder": f"{w} select term from vocabulary order by term",
        "dict_search_rank": f"{w} select query, query in (select term from vocabulary) as found, (select count(*) from vocabulary where term < query) as idx from {_keys()}",
        "dict_range": f"{w} select term from vocabulary where term between {_quoted(c.RANGE[0])} and {_quoted(c.RANGE[1])}",
        "dict_prefix": f"{w} select term from vocabulary where starts_with(term, {_quoted(c.PREFIX)})",
        "dict_prefix_observed": f"{w} select term from vocabulary where term between {_quoted(c.PREFIX)} and {_quoted(c.PREFIX[:-1] + chr(ord(c.PREFIX[-1]) + 1))}",
        "dict_bst_search": _BST,
        "dict_update": f"{w} select term from (select term from vocabulary union select 'zzz') where term <> 'vaccine'",
        "kgram_index": f"{w} select distinct kgram, term from grams",
        "kgram_top": f"""{w}, top as (select kgram, count(distinct term) as n, min(term) as first_term from grams group by kgram),
            firsts as (select top.kgram, n, first_term, min(i) as i from top join grams on grams.kgram = top.kgram and grams.term = first_term group by all order by n desc, first_term, i limit 50)
            select kgram as "K-gram", n as "Terms", (select array_to_string(list_slice(list_sort(list(distinct term)), 1, 10), ', ') from grams g where g.kgram = firsts.kgram) as "Vocabulary" from firsts""",
        **{name: f"{w} select term from vocabulary where term like {_quoted(wild(p))}" for name, p in c.WILDCARDS.items()},
        "wildcard_observed": f"{w}{_OBSERVED} select term from vocabulary where term like {_quoted(wild(c.WILDCARDS['wildcard_prefix']))} and not exists (select 1 from wanted where not contains('$' || term || '$', gram))",
        "wildcard_docs": f"{w} select distinct doc_id from post where term like {_quoted(wild(c.WILDCARDS['wildcard_prefix']))}",
        "edit_distances": f"{w} select term, {_distance('term', _MISSED)}::bigint as distance from vocabulary",
        "indel_ratios": f"{w} select term, 200.0::double * {_common('term', _MISSED)} / (length(term) + length({_MISSED})) as score from vocabulary",
        "spell_suggest": f"{w}{_SPELLED} select * from suggested",
        "spell_best": f"{w}{_SPELLED} select query, coalesce(distance, -1) = 0 as in_vocab, coalesce(term, query) as best_match from wrong left join (from suggested where place = 1) using (query)",
        "spell_table": f"""{w}{_SPELLED} select term as "Suggested Term", round(score, 2) as "Similarity Score", distance as "Edit Distance" from suggested where query = {_MISSED}""",
        "tolerant_corrected_spelled": f"""{w}{_SPELLED}{_SOUNDEX} select coalesce(term, query) as term, 'spelling' as via from wrong left join (from suggested where place = 1) using (query) where query = {_MISSED}
            union all select term, 'soundex' from ({_SAME_CODE})""",
        "phonetic_index": f"{w}{_SOUNDEX} select 'soundex' as method, code, term from codes where code <> ''",
        "phonetic_match_soundex": f"{w}{_SOUNDEX} {_SAME_CODE}",
        "soundex_groups": f"""{w}{_SOUNDEX} select code as "Code", count(*) as "Terms", string_agg(term, ', ' order by term) as "Vocabulary" from codes where code <> '' group by code having count(*) > 1 order by count(*) desc, min(term) limit 30""",
        "metaphone_groups": f"""{w}{_SOUNDEX}{_METAPHONE} select code as "Code", count(*) as "Terms", string_agg(term, ', ' order by term) as "Vocabulary" from metaphones group by code having count(*) > 1 order by count(*) desc, min(term) limit 30""",
        "metaphone_codes": f"{w}{_SOUNDEX}{_METAPHONE} select term, code from sounds where term in (select term from vocabulary)",
        "phonetic_match": f"{w}{_SOUNDEX}{_METAPHONE} {_SAME_CODE} union all {_SAME_SOUND}",
        "tolerant_corrected": f"{w}{_SPELLED}{_SOUNDEX}{_METAPHONE} {_CORRECTED}",
        "tolerant_corrected_docs": f"{w}{_SPELLED}{_SOUNDEX}{_METAPHONE} select distinct doc_id from post where term in (select term from ({_CORRECTED}))",
        "dict_depths": f"{_RECURSIVE}{_DEPTHS} select term, depth from depths",
        "dict_stats": f"""{_RECURSIVE}{_DEPTHS} select 'Vocabulary size' as "Property", size::varchar as "BST", size::varchar as "B-Tree" from shape
            union all select 'Tree height', height::varchar, 'O(log n)' from shape union all select 'Ideal log₂(n) height', round(log2(size + 1), 2)::varchar, '—' from shape
            union all select 'Is balanced', if(height <= 2 * log2(size + 1), 'True', 'False'), 'Always' from shape
            union all select 'Search complexity', 'O(h) worst O(n)', 'O(log n) guaranteed' union all select 'Insert complexity', 'O(h)', 'O(log n)'""",
        "dict_benchmark": f"""select query as "Query", if(found, '✅', '❌') as "Found (BST)", comparisons as "BST Steps", if(query in ({w} select term from vocabulary), '✅', '❌') as "Found (B-Tree)" from ({_BST})""",
        "tok_treebank": f"""with docs as (select doc_id, coalesce(text, '') as text from documents), raw as (select doc_id, {_treebank("text")} as raw from docs),
            low as (select doc_id, list_transform(raw, lambda x: lower(x)) as low from raw),
            hyp as (select doc_id, flatten(list_transform(low, lambda t: case when contains(t, '-') then list_concat([t], string_split(t, '-')) else [t] end)) as hyp from low),
            fin as (select doc_id, list_filter(hyp, lambda t: regexp_matches(t, '[a-zA-Z0-9]') and lower(t) not in {_list(T.STOP_WORDS)}) as fin from hyp)
            select doc_id, unnest(range(len(fin)))::int as pos, unnest(fin) as token from fin""",
        "timed_tokens": _stage("final_tokens"),
        "lemma": f"{w} select term as token, {_lemma('term')} as lemma from vocabulary where {_lemma('term')} <> term",
        "lemma_final": f"{w}, lemmas as (select term, {_lemma('term')} as lemma from vocabulary) select doc_id, pos::int as pos, lemma as token from toks join lemmas using (term)",
        "stem_porter": f"{w}{_porter('vocabulary')} select term, stem from stems",
        "compare_stem_lemma": _compared(),
        "stem_snowball": f"{w}{_snowball('vocabulary')} select term, stem from stems",
        "stem_map": f"{w}{_porter('vocabulary')} select distinct doc_id, term as token, stem from toks join stems using (term) where stem <> term",
        "lemma_tokens": f"{w}, lemmas as (select term as token, {_lemma('term')} as term from vocabulary){_porter('lemmas')} select doc_id, pos::int as pos, stem as token from toks join lemmas on lemmas.token = toks.term join stems on stems.term = lemmas.term",
        "phrase_demo": """with d(doc_id, first, second) as (values ('demo_doc1', 'information systems are', 'retrieval information is'), ('demo_doc2', 'information retrieval is', ''))
            select 'documents' as kind, doc_id from d union all select unnest(['biword', 'positional']), doc_id from d where contains(first || '|' || second, 'information retrieval')
            union all select 'candidates', doc_id from d where contains(first || second, 'information') and contains(first || second, 'retrieval')
            union all select 'false_positives', doc_id from d where not contains(first || '|' || second, 'information retrieval')""",
        "phrase_account": f"""{w}, asked(kind, item, place) as (values {", ".join(f"({_quoted(k)}, {_quoted(x)}, {i})" for i, (k, x) in enumerate(_ASKED))}),
            have as (select 'biword' as kind, biword as item, count(*) as n_docs from bi group by biword union all select 'term', term, count(distinct doc_id) from places group by term)
            select kind, item, place::int as place, coalesce(n_docs, 0)::bigint as n_docs, n_docs is null as missing from asked left join have using (kind, item)""",
        "collection_answers": f"""{w} select 'boolean' as kind, doc_id from docs where ({_has('vaccine')} or {_has('query')}) and not ({_has('index')} or {_has('ward')})
            union all select 'phrase', doc_id from (select distinct doc_id from ({_starts(c.PHRASES['phrase_positional'])}))
            union all select 'wildcard', doc_id from (select distinct doc_id from post where term like 'vacc%') union all select 'exact', doc_id from (select distinct doc_id from post where term = 'vaccine')""",
        "sample_preview": f"select 'sample' || (i - 1) || '.txt' as doc_id, len(string_split(text, ' '))::bigint as words, length(text)::bigint as chars from (select unnest({_SAMPLE}) as text, unnest(range(1, 9)) as i)",
        "source_csv": "select doc_id::varchar as doc_id, coalesce(text, '') as text from documents",
        "store_json_object": f"{w} {_POSTINGS}",
        "soundex_codes": f"{w}{_SOUNDEX} select term, code from codes",
        **_boolean_sql(),
        "bool_setops": f"{w} select doc_id from post where term = 'query' intersect select doc_id from post where term = 'posting' union (select doc_id from docs except select doc_id from post where term = 'list')",
        "bool_terms_and": f"{w} select doc_id from post where term in ('query', 'posting', 'list') group by doc_id having count(distinct term) = 3",
        "bool_terms_or": f"{w} select distinct doc_id from post where term in ('query', 'posting', 'list')",
        "tolerant_wildcard": f"{w} select distinct doc_id from post where term like 'vacc%'",
        "tolerant_exact": f"{w} select distinct doc_id from post where term = 'vaccine'",
        "cosine_rank": _VECTORS,
        "source_upsert": """select distinct doc_id, text from doc_collection where doc_id not in (select doc_id::varchar from documents)
            union all select doc_id::varchar, text from documents""",
        "stored_boolean": _bool(f"{_has('query')} and {_has('index')} and not {_has('posting')}"),
        "stored_phrase": _positional(c.PHRASES["phrase_positional"]),
        "store_parquet": f"{w} {_POSTINGS}",
        "store_json": f"{w} {_POSTINGS}",
        "stream_postings": f"{w} {_POSTINGS}",
        "stream_windows": """select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as "end", event_type, count(*) as n from events group by all""",
    }


def _boolean_sql() -> dict[str, str]:
    h = _has
    return {
        "bool_and": _bool(f"{h('query')} and {h('posting')}"),
        "bool_or": _bool(f"{h('vaccine')} or {h('verdict')}"),
        "bool_not": _bool(f"not {h('the')}"),
        "bool_nested": _bool(f"({h('vaccine')} or {h('query')}) and not ({h('index')} or {h('ward')})"),
        "bool_implicit_and": _bool(f"{h('query')} and {h('index')} and not {h('posting')}"),
        "bool_precedence": _bool(f"{h('vaccine')} or ({h('query')} and {h('posting')})"),
        "bool_double_not": _bool(h("vaccine")),
        "bool_invalid": _bool("false"),
        "bool_empty": _bool("false"),
    }
