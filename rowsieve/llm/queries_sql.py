"""DuckDB equivalents of the corpus queries that SQL can express."""



def _distance(counts: str, total: str, shares: str) -> str:
    p, q = f"({counts}[i] / {total})", f"{shares}[i]"
    return f"""sqrt(greatest(list_sum(list_transform(range(1, len({shares}) + 1), lambda i:
        case when {counts}[i] > 0 then {p} * log2(2 * {p} / ({p} + {q})) else 0 end / 2
        + case when {q} > 0 then {q} * log2(2 * {q} / ({p} + {q})) else 0 end / 2)), 0))"""


def _kept(characters: str) -> str:
    return f"length(regexp_replace(t, '[^{characters}]+', '', 'g'))"


# Fixed values: as in the quality rules.
_CLASSES = ", ".join(
    map(_kept, [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r".,;:?''\"()-", "#*$%&|<>"])
)
QUALITY = rf"""
    with d as (
      select doc_id, coalesce(text, '') t, coalesce(lang, '') lang from documents
    ), f as (
      select doc_id, lang, t,
        list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
        [{_CLASSES}] own, length(t) len,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) black
      from d
    ), c as (
      select *, list_concat(own, [len - black, black - list_sum(own)]) classes from f
    ), lc as (
      select lang, sum(len(ws)) total, sum(len) chars,
        [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5]),
         sum(classes[6]), sum(classes[7])] sums
      from c group by lang
    ), lw as (
      select lang, w, count(*) n from (select lang, unnest(ws) w from c) where length(w) <= 4
      group by lang, w
      qualify row_number() over (partition by lang order by count(*) desc, w) <= 24
    ), refs as (
      select lc.lang, list_transform(sums, lambda x: x / greatest(chars, 1)) class_share,
        coalesce(list(w order by n desc, w) filter (w is not null), []) common,
        list_transform(
          list_concat(coalesce(list(n order by n desc, w) filter (w is not null), []),
            [total - coalesce(sum(n), 0)]), lambda x: x / greatest(total, 1)) common_share
      from lc left join lw on lc.lang = lw.lang group by lc.lang, sums, chars, total
    ), win as (
      select doc_id, i, ws[i : i + 4] win from (
        select doc_id, ws, unnest(range(1, len(ws) - 3)) i from c where len(ws) >= 5)
    ), rep as (
      select doc_id, count(distinct p) n from (
        select doc_id, unnest(range(i, i + 5)) p from (
          select doc_id, i from win qualify count(*) over (partition by doc_id, win) > 1))
      group by doc_id
    ), j as (
      select c.doc_id, len(ws) n_words, black word_chars, own[5] n_symbols,
        len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(rep.n, 0) n_repeat_words,
        case when black >= 200 then {_distance("classes", "greatest(len, 1)", "class_share")} end cd,
        case when len(ws) >= 40 then {_distance("hits", "greatest(len(ws), 1)", "common_share")} end wd
      from (
        select c.*, common, class_share, common_share,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines,
          list_concat(
            list_transform(common, lambda w: len(list_filter(ws, lambda x: x = w))),
            [len(ws) - len(list_filter(ws, lambda x: list_contains(common, x)))]) hits
        from c join refs on c.lang = refs.lang
      ) c left join rep on c.doc_id = rep.doc_id
    ), b as (
      select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from j
    )
    select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars,
      cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
      cast(n_repeat_words as bigint) n_repeat_words, base_failed,
      not base_failed and not coalesce(cd > 0.3, false) and not coalesce(wd > 0.42, false) kept
    from b
"""

AUDIT = r"""
    with d as (
      select doc_id, coalesce(text, '') t, coalesce(cast(lang as varchar), '') part from documents
    ), w as (
      select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
        min(doc_id) over (partition by t) first_id
      from d
    ), m as (
      select part,
        (len(ws) < 100)::int
        + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int
        + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int
        + 8 * regexp_matches(t, '[#$%&*|]')::int
        + 16 * coalesce(first_id < doc_id, false)::int mask,
        exists (select 1 from labels l where l.doc_id = w.doc_id and l.quality = 1) good,
        exists (select 1 from labels l where l.doc_id = w.doc_id and l.toxic = 1) toxic
      from w
    ), c as (
      select part, mask, count(*) n, count(*) filter (good) g, count(*) filter (toxic) x
      from m group by part, mask
    ), letters(l, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    orders as (
      select l1.l || l2.l || l3.l || l4.l || l5.l o, [l1.b, l2.b, l3.b, l4.b, l5.b] bits
      from letters l1, letters l2, letters l3, letters l4, letters l5
      where l1.b + l2.b + l3.b + l4.b + l5.b = 31
    ), steps as (
      select o, k, bits[k] f, coalesce(list_sum(bits[1:k - 1]), 0) before
      from orders, range(1, 6) r(k)
    ), parts as (select distinct part from c), s as (
      select p.part, o, k, f,
        coalesce(sum(n) filter (mask & f <> 0 and mask & before = 0), 0) removed,
        coalesce(sum(n) filter (mask & (before | f) <> 0), 0) gone,
        coalesce(sum(n) filter (mask & f <> 0 and mask & before <> 0), 0) redundant,
        coalesce(sum(n) filter (mask = f), 0) unique_fails,
        coalesce(sum(g) filter (mask & f <> 0 and mask & before = 0), 0) good_lost,
        coalesce(sum(x) filter (mask & f <> 0 and mask & before = 0), 0) toxic_lost,
        coalesce((select sum(n) from c c2 where c2.part = p.part), 0) total
      from parts p cross join steps left join c on c.part = p.part
      group by p.part, o, k, f, before
    )
    select part, o filter_order, cast(k as integer) step, cast(total - gone as bigint) kept,
      cast(removed as bigint) removed, cast(redundant as bigint) redundant,
      cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost,
      cast(toxic_lost as bigint) toxic_lost,
      cast(sum(removed) over (partition by part, f) as bigint) shapley
    from s
"""

PHRASES = r"""
    with d as (
      select coalesce(lang, 'und') lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
      from documents
    ), p as (
      select lang, unnest(regexp_split_to_array(t, '[.,;:!?
-]')) piece from d
    ), w as (
      select lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') ws
      from p
    ), g as (
      select lang, n, array_to_string(ws[i : i + n - 1], ' ') phrase from (
        select lang, ws, n, unnest(range(1, len(ws) - n + 2)) i
        from w, (values (1), (2), (3)) r(n) where len(ws) >= n)
    ), f as (
      select lang, n, phrase, count(*) f from g group by lang, n, phrase
    ), tot as (
      select lang, sum(len(ws)) total from w group by lang
    ), c as (
      select lang, n, phrase, f a, string_split(phrase, ' ') ws from f where n >= 2 and f >= 10
    ), cuts as (
      select c.lang, c.phrase, c.a, k, l.f l, r.f r,
        (c.a::hugeint * c.a * 1000000) // (l.f::hugeint * r.f) score
      from c, range(1, 3) kk(k)
      join f l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1 : k], ' ')
      join f r on r.lang = c.lang and r.phrase = array_to_string(c.ws[k + 1 : c.n], ' ')
      where k < c.n
    ), best as (
      select * from cuts
      qualify row_number() over (partition by lang, phrase order by score, k) = 1
    ), longer as (
      select lang, s phrase, max(a) outer_a from (
        select lang, a, array_to_string(ws[1 : 2], ' ') s from c where n = 3
        union all select lang, a, array_to_string(ws[2 : 3], ' ') s from c where n = 3)
      group by lang, s
    ), kept as (
      select b.* from best b left join longer o on o.lang = b.lang and o.phrase = b.phrase
      where o.outer_a is null or o.outer_a * 100 < b.a * 50
    ), ranked as (
      select *, row_number() over (partition by lang order by score desc, a desc, phrase) rk
      from kept
    )
    select ranked.lang, rk::bigint "rank", phrase, a::bigint a, l::bigint l, r::bigint r,
      total::bigint n, score::bigint score
    from ranked join tot on tot.lang = ranked.lang where rk <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": QUALITY,
    "op11_filter_audit": AUDIT,
    "op12_phrase_mining": PHRASES,
    "op4_exact_top_k": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) v
          from embeddings
          where embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
          select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) score
          from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
        ), r as (
          select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) "rank"
          from s
        )
        select query_id, "rank", vec_id, score from r where "rank" <= 10
    """,
}
