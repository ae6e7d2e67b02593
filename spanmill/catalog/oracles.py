"""The same results in DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

from spanmill.catalog.inputs import LATIN, SEGMENT, SYLLABLES

ORACLES: dict[str, str] = {}

HANGUL = f"translate(lower(text), '{LATIN}', '{SYLLABLES}')"
SPECIALS = f"concat(replace({HANGUL}, ', ', '<extra_id_7>'), '<extra_id_57><<pad><unk></s>')"
SPECIAL_PATTERN = "</s>|<unk>|<pad>|<extra_id_(?:[0-9]|[1-4][0-9]|5[0-6])>|[^<]+|<"
WHITE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MIXED = r"([0-9]+)\(([0-9]+)/([0-9]+)\)"


def draw(seed: int, tag: str, *keys: str) -> str:
    return f"cast(concat('0x', substr(md5(concat_ws(':', '{seed}', '{tag}', {', '.join(keys)})), 1, 8)) as bigint)"


def digest(seed: int, tag: str, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', '{tag}', {', '.join(keys)}))"


def byte_ids(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: cast('0x' || h as int) + 3)"


def letter_ids(text: str, name: str = "c") -> str:
    return f"""flatten(list_transform(string_split({text}, ''), lambda {name}:
        case when {name} = '' then cast([] as int[])
             when unicode({name}) between 44032 and 55203 then
                 [259 + (unicode({name}) - 44032) // 588, 278 + (unicode({name}) - 44032) % 588 // 28,
                  299 + (unicode({name}) - 44032) % 28]
             else {byte_ids(name)} end))"""


def special_ids(text: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all({text}, '{SPECIAL_PATTERN}'), lambda p:
        case when p = '</s>' then [1] when p = '<unk>' then [2] when p = '<pad>' then [0]
             when p[1:10] = '<extra_id_' then [327 + cast(regexp_extract(p, '[0-9]+') as int)]
             else {letter_ids('p')} end))"""


def joined(ids: str) -> str:
    return f"cast({ids} as varchar)"


def repeated(value: str, count: str) -> str:
    return f"list_transform(range(0, greatest(cast({count} as bigint), 0)), lambda z: {value})"


def padded(ids: str, width: str, value: str = "0") -> str:
    return f"list_concat(({ids})[1:{width}], {repeated(value, f'{width} - len({ids})')})"


def mask(ids: str, width: str) -> str:
    return f"list_concat({repeated('1', f'least(len({ids}), {width})')}, {repeated('0', f'{width} - len({ids})')})"


def ended(ids: str) -> str:
    return f"case when len({ids}) > 0 and ({ids})[-1] = 1 then {ids} else list_append({ids}, 1) end"


COUNT = f"cast(ceil(len(ids) / {SEGMENT}) as bigint)"
CUT = f"list_transform(range(0, {COUNT}), lambda s: ids[s * {SEGMENT} + 1 : (s + 1) * {SEGMENT}])"


def document_segments(ids: str) -> str:
    """(doc_id, segment, ids) of each document on its own."""
    return f"""
    tokens as materialized (select doc_id, {ids} as ids from documents),
    segments as materialized (
        select doc_id, unnest(range(0, {COUNT})) as segment, unnest({CUT}) as ids from tokens where len(ids) > 0)"""


def group_segments(source: str, ids: str) -> str:
    """(group_id, segment, ids) of runs of 128 records joined; source has (record_no, text)."""
    return f"""
    sized as (select record_no, {ids} as ids from {source}),
    chunked as materialized (
        select record_no,
               ids[{draw(1, 'chunk', 'record_no')} % cast(ceil(len(ids) / 65536.0) as bigint) * 65536 + 1 :
                   {draw(1, 'chunk', 'record_no')} % cast(ceil(len(ids) / 65536.0) as bigint) * 65536 + 65536] as ids
        from sized where len(ids) > 0),
    streams as (
        select group_id, unnest(ids) as id, unnest(range(0, len(ids))) as place
        from (select record_no // 128 as group_id, flatten(list(ids order by record_no)) as ids from chunked group by 1)),
    segments as materialized (
        select group_id, place // {SEGMENT} as segment, list(id order by place) as ids from streams group by 1, 2)"""


def noised(keys: list[str], seed: int = 1, density: float = 0.15, mean: float = 20.0) -> str:
    """Adds keep and drop bounds (kb, db) and the span count m to segments."""
    key = ", ".join(keys)

    def bounds(total: str, tag: str) -> str:
        return f"""list_concat([cast(0 as bigint)], list_sort(list_reduce(
            range(cast({total} - m + 1 as bigint), cast({total} as bigint)),
            lambda cuts, top: list_append(cuts, case when list_contains(cuts, {draw(seed, tag, key, 'top')} % top + 1)
                then top else {draw(seed, tag, key, 'top')} % top + 1 end),
            cast([] as bigint[]))), [cast({total} as bigint)])"""

    return f"""
    counted as (
        select *, cast(greatest(least(round_even(len(ids) * {density}::double, 0), len(ids) - 1), 1) as bigint) as noise
        from segments),
    planned as (
        select *, cast(least(greatest(round_even(noise / {mean}::double, 0), 1), len(ids) - noise) as bigint) as m
        from counted),
    noised as materialized (
        select *, case when len(ids) > 1 then {bounds('(len(ids) - noise)', 'keep')} end as kb,
                  case when len(ids) > 1 then {bounds('noise', 'drop')} end as db
        from planned)"""


def cut_inputs(start: int, step: int) -> str:
    return f"""case when len(ids) = 1 then ids else flatten(list_transform(range(0, m), lambda i:
        list_append(ids[kb[i + 1] + db[i + 1] + 1 : kb[i + 2] + db[i + 1]], cast({start} + {step} * i as int)))) end"""


def cut_targets(start: int, step: int) -> str:
    return f"""case when len(ids) = 1 then [{start}] else flatten(list_transform(range(0, m), lambda i:
        list_concat([cast({start} + {step} * i as int)], ids[kb[i + 2] + db[i + 1] + 1 : kb[i + 2] + db[i + 2]]))) end"""


def pairs(keys: list[str], start: int, step: int, lengths: tuple[int, int] | None = None, **noise) -> str:
    trim = ["", ""] if lengths is None else [f"[1:{n - 1}]" for n in lengths]
    return f"""{noised(keys, **noise)},
    pairs as materialized (
        select {', '.join(keys)}, list_append(({cut_inputs(start, step)}){trim[0]}, 1) as inputs,
               list_append(({cut_targets(start, step)}){trim[1]}, 1) as targets
        from noised)"""


PROBLEMS = """
    quantities as (
        select l_orderkey, l_linenumber, l_returnflag, l_linenumber % 6 as form,
               cast(l_quantity as bigint) as q, l_partkey % 97 + 1 as p
        from lineitem),
    problems as (
        select l_orderkey, l_linenumber, l_returnflag, form, q, p,
               concat('It''s ', q, ' and "None" ', p) as question,
               concat('x=', case form
                   when 0 then case when p = 97 then concat(q, '*', p, repeat('+1-1', 1000))
                                    when p % 3 = 1 then concat(q, '^2*', p, '/', q, '^1')
                                    when p % 3 = 2 then concat(q, '*', p, '*1^70000+(2^2000)^0.5/2^1000-1')
                                    else concat(q, '*', p) end
                   when 1 then concat(q, ':', p) when 2 then concat(q, '(1/', p, ')')
                   when 3 then concat(p, '%*', q) when 4 then concat(q, '+', p) else concat(q, '+*', p) end) as equation,
               case form
                   when 0 then cast(q * p as varchar)
                   when 1 then concat(q * 10000 // p // 10000, '.', lpad(cast(q * 10000 // p % 10000 as varchar), 4, '0'))
                   when 2 then concat(q, '(1/', p, ')')
                   when 3 then case when p % 2 = 0 then concat(q * p, 'e-2') else concat(q * p // 100, '.', lpad(cast(q * p % 100 as varchar), 2, '0')) end
                   when 4 then cast(q + p + 1 as varchar)
                   else cast(q as varchar) end as ans
        from quantities),
    valued as (
        select *, case form when 0 then q * p when 1 then q / p when 2 then (q * p + 1) / p when 3 then p / 100 * q
                            when 4 then q + p end as x,
                  case when form = 2 then q + 1 / p else try_cast(ans as double) end as y
        from problems),
    judged as (
        select *, case when x is null or y is null then 'error' when (x - y) * (x - y) < 1e-5 then 'right'
                       else 'wrong' end as verdict
        from valued)"""

PREDICTIONS = """
    scored as (
        select p_partkey, p_brand, concat(p_size, '*', p_partkey) as target_text,
               concat(p_size, '*', p_partkey,
                      case when p_partkey % 10 < 3 then '+1' when p_partkey % 10 = 3 then '+' else '' end) as predicted,
               case when p_partkey % 10 < 3 then 'wrong' when p_partkey % 10 = 3 then 'error' else 'right' end as verdict,
               p_size % 3 as pads
        from part)"""


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


# Sources and sinks

oracle("src_jsonl_shards", "select row_number() over (order by doc_id) - 1 as record_no, doc_id, text from documents")
oracle(
    "src_records_by_number",
    "select row_number() over (order by doc_id) - 1 as number, doc_id, text from documents",
)
oracle(
    "src_literal_lines",
    f"""with {PROBLEMS}
    select case when good then concat(l_orderkey, '-', l_linenumber) end as id,
           case when good then 'It''s None' end as original_text_kr,
           case when good then equation end as equation,
           case when good then ans end as ans,
           case when not good then concat('bad ', l_orderkey, '-', l_linenumber) end as bad_line
    from (select *, l_orderkey % 8 <> 0 as good from problems)""",
)
oracle(
    "src_literal_records",
    f"""with {PROBLEMS}
    select case when good then l_orderkey end as l_orderkey, case when good then l_linenumber end as l_linenumber,
           case when good then concat('It''s A', chr(9), 'é', chr(92), 'n') end as question, case when good then equation end as equation,
           case when good then true end as first, case when good then ans end as ans,
           case when not good then concat('{{''id'': (', l_orderkey, ', ', l_linenumber, '), ''call'': f()}}') end as bad_line
    from (select *, l_orderkey % 8 <> 0 as good from problems)""",
)
oracle("src_union_files", "select doc_id as id, text from documents union all select item_id, text from benchmark")
oracle(
    "src_tsv_as_str",
    """select cast(doc_id as varchar) as prefix, case when doc_id % 10 > 1 then text else 'nan' end as input_text,
              lang as target_text from documents""",
)
oracle(
    "src_named_splits",
    f"""select doc_id, text, lang, 'train' as split from documents
        where lang = 'en' and {draw(1, 'split', 'doc_id')} % 100 < 90""",
)
oracle(
    "src_text_label_zip",
    "select d.doc_id, d.text, l.quality as label from documents d left join labels l on d.doc_id = l.doc_id",
)
oracle(
    "sink_tsv",
    r"""select cast(doc_id as varchar) as prefix,
               concat(' ', chr(9), '\', text, '"', chr(10), '\', chr(9), ' "" ') as input_text, source as target_text
        from documents""",
)
oracle(
    "sink_predictions_text",
    r"""select row_number() over (order by doc_id) - 1 as record_no,
               regexp_replace(concat('<pad>', text), '[\r\n]+', ' ', 'g') as value from documents""",
)
oracle("sink_token_cache", f"select doc_id, {joined(letter_ids(HANGUL))} as ids from documents")

# Split, sample, mix, order

NUMBERED = "select *, row_number() over (order by doc_id) - 1 as record_no from documents"
oracle(
    "split_every_nth",
    f"""with numbered as ({NUMBERED}), ranked as (
            select doc_id, record_no, (record_no + 1) % 100 = 0 as hundredth,
                   count(*) filter (where (record_no + 1) % 100 = 0) over (order by record_no) as k from numbered)
        select doc_id, record_no, case when hundredth and k <= 1000 then 'eval' else 'train' end as split from ranked""",
)
oracle("limit_cap", "select event_id, event_type, value from events order by event_id limit 1000")
oracle(
    "split_fraction",
    f"select doc_id, case when {draw(1, 'split', 'doc_id')} % 100 < 80 then 'train' else 'eval' end as split from documents",
)
oracle("sample_bernoulli", f"select doc_id, text from documents where {draw(1, 'sample', 'doc_id')} < 1073741824")


def mixture(source: str, rates: dict[str, str], total: str, digest_name: str = "lang") -> str:
    cases = " ".join(f"when '{name}' then {rate}" for name, rate in rates.items())
    return f"""
    named as (select * from {source} where lang in ({', '.join(repr(n) for n in rates)})),
    sizes as (
        select lang, count(*) as n, cast(floor((select {total} from {source}) * (case lang {cases} end)) as bigint) as quota
        from named group by lang),
    ranked as (
        select *, row_number() over (partition by lang order by {digest(1, 'mix', digest_name, 'doc_id')}, doc_id) - 1 as r
        from named),
    mixed as (
        select x.*, e as epoch
        from (select k.*, unnest(range(0, cast(quota // n + case when r < quota % n then 1 else 0 end as bigint))) as e
              from ranked k join sizes using (lang)) x)"""


oracle(
    "mix_fixed_rates",
    f"with {mixture('documents', {'fr': '0.7', 'en': '0.3'}, 'count(*)')} select doc_id, lang, epoch from mixed",
)
SHARES = {"de": 2, "en": 3, "fr": 5}
DUE = ", ".join(
    f"case when {lang} * 10 // {w} <= place then (({lang} + 1) * 10 + {w - 1}) // {w} * 10 + {k} else 10000 end"
    for k, (lang, w) in enumerate(SHARES.items())
)
oracle(
    "mix_rate_order",
    f"""with recursive walk as (
            select 0 as place, 0 as de, 0 as en, 0 as fr, -1 as pick
            union all
            select place + 1, de + cast(best % 10 = 0 as int), en + cast(best % 10 = 1 as int), fr + cast(best % 10 = 2 as int), best % 10
            from (select *, least({DUE}) as best from walk where place < 10)),
        places as (
            select ['de', 'en', 'fr'][pick + 1] as lang, place - 1 as place,
                   row_number() over (partition by pick order by place) - 1 as nth, count(*) over (partition by pick) as weight
            from walk where place > 0),
        every as (
            select lang, k * 10 + place as pos, k * weight + nth as row
            from places, range(0, (select count(*) // 10 + 1 from documents)) t(k) where k * 10 + place < (select count(*) from documents)),
        ranked as (
            select doc_id, lang, row_number() over (partition by lang order by {digest(1, 'mix', 'lang', 'doc_id')}, doc_id) - 1 as rank,
                   count(*) over (partition by lang) as size
            from documents)
        select r.doc_id, r.lang, e.row // r.size as epoch, e.pos
        from every e join ranked r on r.lang = e.lang and r.rank = e.row % r.size""",
)
oracle(
    "mix_temperature_rates",
    """select lang, count(*) as n, round(pow(count(*), 0.3) / sum(pow(count(*), 0.3)) over (), 9) as rate
       from documents group by lang""",
)
oracle(
    "shuffle_seeded",
    f"select doc_id, text, row_number() over (order by {digest(1, 'order', 'doc_id')}, doc_id) - 1 as pos from documents",
)
oracle(
    "repeat_epochs",
    f"""select doc_id, cast(epoch as int) as epoch,
               row_number() over (partition by epoch order by {digest(1, 'epoch', 'epoch', 'doc_id')}, doc_id) - 1 as pos
        from documents, range(0, 3) e(epoch)""",
)
oracle(
    "batch_assign",
    f"""with numbered as ({NUMBERED})
        select doc_id, record_no // 16 as batch_id, cast(record_no % 16 as int) as slot from numbered
        where record_no // 16 < (select count(*) // 16 from documents)""",
)
oracle(
    "batch_plan",
    "select count(*) as examples, count(*) // 16 as batches, count(*) // 16 // 4 * 5 as steps from documents",
)

# Projections, filters, joins

oracle("rekey", "select doc_id, '' as inputs, text as targets from documents")
oracle("select_features", "select doc_id, '' as inputs, text as targets from documents")
oracle(
    "project_task_triple",
    f"""with {PROBLEMS} select l_orderkey, l_linenumber, 'Solve' as prefix, question as input_text,
               substr(equation, 3) as target_text from problems""",
)
oracle(
    "prompt_concat",
    "select doc_id, concat(lang, ': ', case when doc_id % 10 > 0 then text else 'nan' end) as prompt from documents",
)
oracle(
    "filter_blacklist",
    f"""with {PROBLEMS} select l_orderkey, l_linenumber, equation from problems p
        where not exists (select 1 from judged j where j.verdict <> 'right' and j.l_orderkey = p.l_orderkey
                          and j.l_linenumber = p.l_linenumber)""",
)
oracle(
    "lookup_by_index",
    """select d.doc_id, d.lang, l.quality as label,
              case l.quality when 0 then 'negative</s>' when 1 then 'positive</s>' end as label_text
       from documents d join labels l on d.doc_id = l.doc_id""",
)
oracle("subset_by_verdict", f"with {PREDICTIONS} select p_partkey, p_brand, target_text from scored where verdict = 'wrong'")
oracle(
    "flatten_batches",
    f"""with numbered as ({NUMBERED})
        select record_no // 16 as batch_id, cast(record_no % 16 as int) as slot, text, record_no as pos from numbered""",
)

# Text cleaning

oracle(
    "clean_review_text",
    rf"""with reviews as (
            select doc_id, concat(' ', chr(9), text, '<br/><br />a-b/c!<br/><br/> ', chr(12288), chr(10)) as t from documents),
        stripped as (select doc_id, regexp_replace(regexp_replace(t, '^{WHITE}+', ''), '{WHITE}+$', '') as t from reviews)
        select doc_id, regexp_replace(regexp_replace(t, '[.;:!''?,"()\[\]]', '', 'g'),
                                      '(<br{WHITE}*/><br{WHITE}*/>)|-|/', '', 'g') as text from stripped""",
)
oracle(
    "normalize_equation",
    rf"""with {PROBLEMS},
        raw as (select l_orderkey, l_linenumber, replace(concat(equation, '+5%-1', ans, '%'), 'x=', '') as t from problems),
        ratios as (select l_orderkey, l_linenumber, regexp_replace(t, '([0-9]+):([0-9]+)', '(\1/\2)', 'g') as t from raw),
        mixed as (select l_orderkey, l_linenumber, regexp_replace(t, '{MIXED}', '(\1*\3+\2)/(\3)', 'g') as t from ratios),
        percents as (
            select l_orderkey, l_linenumber, t, list_reduce(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)?%'),
                       lambda a, s: replace(a, s, concat('(', s[:-2], '/100)')), t) as folded from mixed)
        select l_orderkey, l_linenumber, regexp_replace(folded, '{MIXED}', '(\1*\3+\2)/(\3)', 'g') as plain,
               regexp_replace(regexp_replace(t, '([0-9]+(?:\.[0-9]+)?)%', '(\1/100)', 'g'),
                              '{MIXED}', '(\1*\3+\2)/(\3)', 'g') as strict
        from percents""",
)
oracle(
    "strip_target_prefix",
    f"""with {PROBLEMS} select l_orderkey, l_linenumber, concat(substr(equation, 3), '=', substr(equation, 3)) as target
        from problems""",
)
oracle(
    "clean_prediction",
    f"""with {PREDICTIONS}
        select p_partkey, predicted as legacy, predicted as by_name, concat('<pad> ', predicted, '</s>') as unpadded
        from scored""",
)

# Tokenisation

oracle("tok_byte_encode", f"select doc_id, {joined(byte_ids('text'))} as ids from documents")
oracle("tok_jamo_encode", f"select doc_id, {joined(letter_ids(HANGUL))} as ids from documents")
oracle("tok_special_encode", f"select doc_id, {joined(special_ids(SPECIALS))} as ids from documents")
oracle(
    "tok_vocab_table",
    f"""with used as (
            select id, count(*) as n from (select unnest({special_ids(SPECIALS)}) as id from documents) group by id)
        select cast(v.id as int) as id,
               case when v.id = 0 then '<pad>' when v.id = 1 then '</s>' when v.id = 2 then '<unk>'
                    when v.id < 327 then chr(cast(v.id - 3 as int)) else concat('<extra_id_', v.id - 327, '>') end as token,
               case when v.id < 3 then 'control' when v.id < 259 then 'byte' when v.id < 278 then 'initial'
                    when v.id < 299 then 'vowel' when v.id < 327 then 'final' else 'sentinel' end as kind,
               coalesce(n, 0) as n
        from range(0, 384) v(id) left join used u on u.id = v.id""",
)
oracle(
    "tok_append_eos",
    f"""with t as (select doc_id, {byte_ids('text')} as ids from documents),
        g as (select doc_id, ids, case when doc_id % 2 = 0 then list_append(ids, 1) else ids end as given from t)
        select doc_id, {joined('list_append(ids, 1)')} as once, {joined('list_append(given, 1)')} as always from g""",
)
oracle(
    "tok_trim_then_eos",
    f"select doc_id, {joined(f'list_append(({letter_ids(HANGUL)})[1:1023], 1)')} as ids from documents",
)
oracle(
    "tok_truncate",
    f"""with t as (select doc_id, {letter_ids(HANGUL)} as ids from documents)
        select doc_id, {joined('ids[1:1193]')} as corpus, {joined(ended('ids[1:511]'))} as input,
               {joined(ended('ids[1:127]'))} as target from t""",
)
oracle(
    "tok_pair_inputs",
    f"""with t as (select conv_id, turn, {letter_ids('text')} as ids from conversations)
        select a.conv_id, a.turn,
               {joined("list_concat(list_append(a.ids, 1), case when b.ids is null then [] else list_append(b.ids, 1) end)")} as ids,
               {joined(f"list_concat({repeated('0', 'len(a.ids)')}, [1], case when b.ids is null then [] else list_append({repeated('0', 'len(b.ids)')}, 1) end)")} as special_mask,
               {joined(repeated('0', 'len(a.ids) + 1 + coalesce(len(b.ids) + 1, 0)'))} as type_ids
        from t a left join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.turn % 2 = 0""",
)
PADDED_512 = f"""
    t as (select doc_id, {letter_ids(HANGUL)} as ids from documents),
    cut as (select doc_id, {ended('ids[1:511]')} as ids from t)"""
oracle(
    "pad_fixed",
    f"with {PADDED_512} select doc_id, {joined(padded('ids', '512'))} as ids, {joined(mask('ids', '512'))} as mask from cut",
)
oracle(
    "pad_batch_longest",
    f"""with numbered as ({NUMBERED}),
        t as (select doc_id, record_no // 16 as batch_id, ({letter_ids(HANGUL)})[1:1193] as ids from numbered),
        w as (select *, max(len(ids)) over (partition by batch_id) as width from t)
        select doc_id, batch_id, {joined(padded('ids', 'width'))} as ids, {joined(padded('ids', 'width', '-100'))} as labels
        from w""",
)
oracle(
    "mask_label_pad",
    f"""with t as (select doc_id, {letter_ids(HANGUL)} as ids from documents),
        whole as (select doc_id, {ended('ids')} as ids from t),
        wide as (select *, cast(ceil(len(ids) / 512.0) * 512 as bigint) as width from whole)
        select doc_id, {joined(padded('ids', 'width', '-100'))} as labels from wide""",
)
oracle(
    "assemble_examples",
    f"""with t as (select doc_id, {byte_ids('text')} as ids from documents),
        cut as (select doc_id, {ended('ids[1:511]')} as ids from t)
        select cut.doc_id, {joined(padded('ids', '512'))} as input_ids, {joined(mask('ids', '512'))} as attention_mask,
               case quality when 0 then '{[b + 3 for b in b'negative'] + [1]}' else '{[b + 3 for b in b'positive'] + [1]}' end as labels
        from cut join labels using (doc_id)""",
)
oracle("tok_decode", f"select doc_id, {SPECIALS} as text, text as bytes_text from documents")
oracle(
    "sentinel_remap",
    f"""with {document_segments(byte_ids('text'))}, {noised(['doc_id', 'segment'])}
        select doc_id, segment, {joined(f'list_append({cut_inputs(259, 1)}, 1)')} as inputs,
               {joined(f'list_append({cut_inputs(258, -1)}, 1)')} as down,
               {joined(f'list_append({cut_inputs(259, 1)}, 1)')} as up from noised""",
)

# Span corruption

KEYS = ["doc_id", "segment"]
LETTER_SEGMENTS = document_segments(letter_ids(HANGUL))
oracle(
    "span_lengths",
    f"""with fits as (
            select max(n) as raw from (
                select n, round_even(n * 0.15::double, 0) as noise from range(1024, 2048) r(n)) x
            where n - noise + round_even(noise / 20.0::double, 0) + 1 <= 1024),
        sized as (select doc_id, cast(strlen({HANGUL}) as int) as tokens, cast(raw as bigint) as raw from documents, fits),
        tails as (select *, cast((tokens - 1) % raw + 1 as int) as tail from sized),
        noise as (select *, greatest(least(round_even(tail * 0.15::double, 0), tail - 1), 1) as noise from tails),
        spans as (select *, least(greatest(round_even(noise / 20.0::double, 0), 1), tail - noise) as m from noise)
        select doc_id, tokens, cast(ceil(tokens / raw) as bigint) as segments, tail,
               cast(case when tail > 1 then tail - noise + m + 1 else tail + 1 end as int) as tail_inputs,
               cast(case when tail > 1 then noise + m + 1 else 2 end as int) as tail_targets
        from spans where tokens > 0""",
)
oracle(
    "span_target_guard",
    f"""with {LETTER_SEGMENTS}, {noised(KEYS)}
        select doc_id, segment, cast(case when len(ids) > 1 then noise + m + 1 else 2 end as int) as needed, true as fits
        from noised""",
)
oracle(
    "chunk_random_select",
    f"""with t as (select doc_id, {letter_ids(HANGUL)} as ids from documents),
        s as (select doc_id, ids, {draw(1, 'chunk', 'doc_id')} % cast(ceil(len(ids) / 2048.0) as bigint) * 2048 as b
              from t where len(ids) > 0)
        select doc_id, {joined('ids[b + 1 : b + 2048]')} as ids from s""",
)
oracle(
    "concat_tokens",
    f"""with numbered as ({NUMBERED}), t as (select record_no, {letter_ids(HANGUL)} as ids from numbered),
        s as (select record_no, ids, {draw(1, 'chunk', 'record_no')} % cast(ceil(len(ids) / 65536.0) as bigint) * 65536 as b
              from t where len(ids) > 0)
        select record_no // 128 as group_id, cast(count(*) as int) as records,
               {joined('flatten(list(ids[b + 1 : b + 65536] order by record_no))')} as ids
        from s group by 1""",
)
oracle("split_segments", f"with {LETTER_SEGMENTS} select doc_id, cast(segment as int) as segment, {joined('ids')} as ids from segments")
oracle(
    "noise_spans",
    f"""with {LETTER_SEGMENTS}, {noised(KEYS)},
        each as (select *, unnest(range(0, m)) as i from noised where len(ids) > 1)
        select doc_id, segment, cast(kb[i + 1] + db[i + 1] + 1 as int) as at, cast(kb[i + 2] - kb[i + 1] as int) as keep,
               cast(db[i + 2] - db[i + 1] as int) as drop from each
        union all select doc_id, segment, 1, 1, 0 from segments where len(ids) = 1""",
)


def by_position(name: str, flag: str) -> str:
    """One row per token: runs of the flag become one sentinel each, numbered by a running count."""
    return f"""with {LETTER_SEGMENTS}, {noised(KEYS)},
    masked as (
        select doc_id, segment, ids, case when len(ids) = 1 then [false] else flatten(list_transform(range(0, m), lambda i:
            list_concat({repeated('false', 'kb[i + 2] - kb[i + 1]')}, {repeated('true', 'db[i + 2] - db[i + 1]')}))) end as mask
        from noised),
    tokens1 as (
        select doc_id, segment, unnest(ids) as id, unnest(mask) as dropped, unnest(range(1, len(ids) + 1)) as place from masked),
    flagged as (select doc_id, segment, id, place, {flag} as f from tokens1),
    runs as (
        select *, f and not coalesce(lag(f) over (partition by doc_id, segment order by place), false) as first from flagged),
    numbered as (
        select *, 326 + sum(case when first then 1 else 0 end) over (partition by doc_id, segment order by place) as sentinel
        from runs)
    select doc_id, segment,
           concat('[', string_agg(cast(case when first then sentinel else id end as varchar), ', ' order by place), ']') as {name}
    from numbered where first or not f group by doc_id, segment"""


oracle("corrupt_inputs", by_position("inputs", "dropped"))
oracle("corrupt_targets", by_position("targets", "not dropped"))

RECORDS = f"records as (select row_number() over (order by doc_id) - 1 as record_no, {HANGUL} as text from documents)"
PLAIN_RECORDS = "records as (select row_number() over (order by doc_id) - 1 as record_no, text from documents)"
GROUP_KEYS = ["group_id", "segment"]
oracle(
    "corrupt_pairs",
    f"""with {RECORDS}, {group_segments('records', letter_ids('text'))}, {pairs(GROUP_KEYS, 327, 1, (1024, 189))}
        select group_id, segment, {joined('inputs')} as inputs, {joined('targets')} as targets from pairs""",
)


def scheme_select(name: str, start: int, step: int) -> str:
    return f"""select '{name}' as scheme, group_id, segment,
        {joined(f'list_append(({cut_inputs(start, step)})[1:1023], 1)')} as inputs,
        {joined(f'list_append(({cut_targets(start, step)})[1:188], 1)')} as targets from noised"""


# The documents hold no Hangul here, so all three schemes see the same ids.
oracle(
    "sentinel_schemes",
    f"""with {PLAIN_RECORDS}, {group_segments('records', byte_ids('text'))}, {noised(GROUP_KEYS)}
        {scheme_select('bytes_descending', 258, -1)} union all {scheme_select('bytes_ascending', 259, 1)}
        union all {scheme_select('letters_ascending', 327, 1)}""",
)


def packed(keys: str, bucket: str) -> str:
    """Next-fit by a recursive walk over each bucket's short examples."""
    side = lambda f, n: f"""
        {joined(padded(f'flatten(list({f} order by r))', str(n)))} as {f},
        {joined(padded(f"flatten(list({repeated('slot', f'len({f})')} order by r))", str(n)))} as {f}_segmentation,
        {joined(padded(f"flatten(list(range(0, len({f})) order by r))", str(n)))} as {f}_position"""
    first, second = keys.split(", ")
    return f"""
    sized as (select *, len(inputs) + 2 > 1024 or len(targets) + 1 > 189 as alone, {bucket} as bucket from pairs),
    placed as materialized (
        select *, row_number() over (partition by bucket order by {keys}) as r from sized where not alone),
    walk as (
        select bucket, r, len(inputs) as a, len(targets) as b, 1 as pack from placed where r = 1
        union all
        select p.bucket, p.r,
               case when a + len(p.inputs) <= 1024 and b + len(p.targets) <= 189 then a else 0 end + len(p.inputs),
               case when a + len(p.inputs) <= 1024 and b + len(p.targets) <= 189 then b else 0 end + len(p.targets),
               case when a + len(p.inputs) <= 1024 and b + len(p.targets) <= 189 then pack else pack + 1 end
        from walk w join placed p on p.bucket = w.bucket and p.r = w.r + 1),
    members as (
        select p.*, w.pack, row_number() over (partition by p.bucket, w.pack order by p.r) as slot
        from placed p join walk w on p.bucket = w.bucket and p.r = w.r
        union all select *, 1 as r, -row_number() over (order by {keys}) as pack, 1 as slot from sized where alone)
    select arg_min({first}, r) as {first}, arg_min({second}, r) as {second}, cast(count(*) as int) as members,
        {side('inputs', 1024)}, {side('targets', 189)}
    from members group by bucket, pack"""


oracle(
    "pack_or_pad",
    f"with recursive {LETTER_SEGMENTS}, {pairs(KEYS, 327, 1)}, {packed('doc_id, segment', 'doc_id // 100')}",
)
LAST = lambda ids, n: f"list_append(({padded(ids, str(n))})[1:{n - 1}], least(({padded(ids, str(n))})[{n}], 1))"
oracle(
    "pack_by_lengths",
    f"""with {LETTER_SEGMENTS}, {pairs(KEYS, 327, 1)}
        select doc_id, segment, {joined('inputs')} as inputs, {joined('targets')} as targets from pairs""",
)
oracle(
    "pad_without_packing",
    f"""with {LETTER_SEGMENTS}, {pairs(KEYS, 327, 1)}
        select doc_id, segment, {joined(LAST('inputs', 1024))} as inputs, {joined(LAST('targets', 189))} as targets from pairs""",
)

# Equation verification and evaluation

oracle("verify_equations", f"with {PROBLEMS} select l_orderkey, l_linenumber, equation, ans, verdict from judged")
oracle("score_predictions", f"with {PREDICTIONS} select p_partkey, predicted, p_brand, target_text, verdict from scored")
RATES = ", ".join(
    f"round(100.0 * count(*) filter (where verdict = '{v}') / count(*), 6) as {v}_rate" for v in ("right", "wrong", "error")
)
oracle(
    "verdict_rates",
    f"with {PROBLEMS} select l_returnflag, count(*) as n, {RATES} from judged group by rollup (l_returnflag)",
)
oracle(
    "mean_loss",
    "select event_type, round(avg(value), 6) as mean_loss, count(value) as samples from events group by event_type",
)
oracle(
    "class_metrics",
    """with c as (
           select count(*) as n, sum(case when quality = toxic then 1 else 0 end) as same,
                  sum(case when quality = 1 and toxic = 1 then 1 else 0 end) as tp,
                  sum(case when toxic = 1 then 1 else 0 end) as said,
                  sum(case when quality = 1 then 1 else 0 end) as held from labels)
       select n, round(same / n, 9) as accuracy, round(coalesce(tp / nullif(said, 0), 0), 9) as precision,
              round(coalesce(tp / nullif(held, 0), 0), 9) as recall,
              round(coalesce(2 * tp / nullif(said + held, 0), 0), 9) as f1 from c""",
)
WORDS = lambda t: (
    f"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({t}), '[!-/:-@\\[-`{{-~]', '', 'g'),
    '\\b(a|an|the)\\b', ' ', 'g'), '\\s+'), lambda w: w <> '')"""
)
oracle(
    "text_overlap_metrics",
    f"""with p as (
            select p_partkey, p_brand, p_name, case p_size % 3 when 0 then concat_ws(' ', p_type, p_name, p_name)
                   when 1 then concat('The ', upper(p_name), '!') else p_brand end as predicted from part),
        w as (select p_partkey, p_brand, {WORDS('predicted')} as a, {WORDS('p_name')} as b from p),
        ca as (select p_partkey, t, count(*) as n from (select p_partkey, unnest(a) as t from w) group by all),
        cb as (select p_partkey, t, count(*) as n from (select p_partkey, unnest(b) as t from w) group by all),
        shared as (select p_partkey, sum(least(ca.n, cb.n)) as s from ca join cb using (p_partkey, t) group by p_partkey)
        select p_brand, round(avg(case when a = b then 1.0 else 0.0 end), 9) as exact,
               round(avg(case when len(a) + len(b) = 0 then 1.0 else 2.0 * coalesce(s, 0) / (len(a) + len(b)) end), 9) as f1
        from w left join shared using (p_partkey) group by p_brand""",
)
oracle(
    "corr_metrics",
    """with r as (
           select l_quantity as x, l_extendedprice as y,
                  rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as rx,
                  rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as ry
           from lineitem)
       select count(*) as n, round(corr(x, y), 9) as pearson, round(corr(rx, ry), 9) as spearman from r""",
)

# Streaming

oracle("stream_tokenize", f"select doc_id, {joined(letter_ids(HANGUL))} as ids from documents")
oracle(
    "stream_corrupt",
    f"""with t as (select doc_id, {letter_ids(HANGUL)} as ids from documents),
        segments as (select doc_id, ids[1:{SEGMENT}] as ids from t where len(ids) > 0), {pairs(['doc_id'], 327, 1)}
        select doc_id, {joined('inputs')} as inputs, {joined('targets')} as targets from pairs""",
)
oracle("stream_verify", f"with {PROBLEMS} select verdict, count(*) as n from judged group by verdict")

# Recipes, mixtures and whole jobs

oracle(
    "recipe_registry",
    f"""with {RECORDS}, {group_segments('records', letter_ids('text'))}, {pairs(GROUP_KEYS, 327, 1, (1024, 189))},
        bytes as (select record_no // 128 as group_id, sum(strlen(text)) as n from records group by 1)
        select 'letters_ascending' as recipe, count(*) as examples, cast(sum(len(inputs)) as bigint) as input_ids,
               cast(sum(len(targets)) as bigint) as target_ids from pairs
        union all select 'bytes_ascending', count(*), cast(sum(len(inputs)) as bigint), cast(sum(len(targets)) as bigint) from pairs
        union all select 'bytes_descending', count(*), cast(sum(len(inputs)) as bigint), cast(sum(len(targets)) as bigint) from pairs""",
)
oracle(
    "step_callables",
    f"""with {document_segments(byte_ids('text'))}, {noised(KEYS, 5, 0.5, 3.0)}
        select doc_id, segment, {joined(f'list_append({cut_targets(259, 1)}, 1)')} as inputs,
               {joined(f'list_append({cut_inputs(259, 1)}, 1)')} as targets from noised""",
)
oracle(
    "mixture_registry",
    f"""with docs as (select doc_id, case when lang = 'fr' then 'ko' else lang end as lang from documents),
        {mixture('docs', {'ko': '0.7', 'en': '0.3'}, 'count(*) * 3')}
        select lang, epoch, count(*) as n, cast(sum(doc_id) as bigint) as ids from mixed group by lang, epoch""",
)
oracle(
    "pretraining_corpus",
    f"""with recursive records as (
            select lang as source, {HANGUL} as text,
                   row_number() over (partition by lang order by {digest(1, 'order', 'lang', 'doc_id')}, doc_id) - 1 as record_no
            from documents where lang in ('fr', 'en')),
        texts as (select source, record_no, {letter_ids('text')} as ids from records),
        placed_chunks as (
            select *, {draw(1, 'chunk', 'source', 'record_no')} % cast(ceil(len(ids) / 65536.0) as bigint) * 65536 as b
            from texts where len(ids) > 0),
        streams as (
            select source, group_id, unnest(ids) as id, unnest(range(0, len(ids))) as place
            from (select source, record_no // 128 as group_id, flatten(list(ids[b + 1 : b + 65536] order by record_no)) as ids
                  from placed_chunks group by 1, 2)),
        segments as materialized (
            select source, group_id, place // {SEGMENT} as segment, list(id order by place) as ids from streams group by 1, 2, 3),
        {pairs(['source', *GROUP_KEYS], 327, 1, (1024, 189)).replace('pairs as materialized', 'examples as materialized')},
        sizes as (
            select source, count(*) as n, cast(floor((select count(*) from examples) * case source when 'fr' then 0.7 else 0.3 end) as bigint) as quota
            from examples group by source),
        ranked as (
            select *, row_number() over (partition by source order by {digest(1, 'mix', 'source', 'group_id', 'segment')}, group_id, segment) - 1 as r
            from examples),
        mixed as (
            select ranked.*, unnest(range(0, cast(quota // n + case when r < quota % n then 1 else 0 end as bigint))) as epoch
            from ranked join sizes using (source)),
        pairs as materialized (
            select source, inputs, targets, {digest(1, 'order', 'source', 'group_id', 'segment', 'epoch')} as place,
                   cast(greatest(ceil(ln((select count(*) from examples) / 1000.0) / ln(16)), 0) as int) as digits
            from mixed),
        {packed('place, source', 'place[1:digits]').replace('select arg_min(place', ', packs as (select arg_min(place')}),
        ordered as (select * exclude (place, source), row_number() over (order by place) - 1 as pos from packs)
        select *, pos // 8 as batch_id, cast(pos % 8 as int) as slot from ordered""",
)
oracle(
    "eval_holdout",
    f"""with numbered as ({NUMBERED}),
        segments as (
            select record_no, ({letter_ids(HANGUL)})[1:{SEGMENT}] as ids from numbered
            where (record_no + 1) % 100 = 0 and record_no < 100000), {pairs(['record_no'], 327, 1)}
        select record_no, {joined('inputs')} as inputs, {joined('targets')} as targets from pairs""",
)
oracle(
    "equation_corpus",
    f"""with {PROBLEMS} select l_orderkey, l_linenumber, 'Solve' as prefix, question as input_text,
               substr(equation, 3) as target_text from judged where verdict = 'right'""",
)
CLEAN = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({HANGUL}, '^{WHITE}+', ''), '{WHITE}+$', ''),
    '[.;:!''?,"()\[\]]', '', 'g'), '(<br{WHITE}*/><br{WHITE}*/>)|-|/', '', 'g')"""
oracle(
    "labelled_text",
    f"""with t as (select doc_id, {letter_ids(CLEAN)} as ids from documents),
        cut as (
            select t.doc_id, {ended('ids[1:511]')} as s,
                   list_append({byte_ids("case quality when 0 then 'negative' else 'positive' end")}, 1) as g
            from t join labels using (doc_id))
        select doc_id, {joined(padded('s', '512'))} as source_ids, {joined(mask('s', '512'))} as source_mask,
               {joined(padded('g', '10'))} as target_ids, {joined(mask('g', '10'))} as target_mask,
               {joined(padded('g', '10', '-100'))} as labels from cut""",
)
oracle(
    "corpus_token_counts",
    f"""with t as (select lang, list_append({letter_ids(HANGUL)}, 1) as ids from documents)
        select lang, count(*) as documents, cast(sum(len(ids)) as bigint) as tokens, cast(sum(list_sum(ids)) as bigint) as id_sum
        from t group by lang""",
)
oracle(
    "endless_epochs",
    f"""with sized as (select *, (select count(*) from documents) as n from documents),
        dealt as (
            select doc_id, lang, concat('s', substr({digest(1, 'shard', 'doc_id')}, 1,
                       case when n <= 64 then 0 when n <= 1024 then 1 when n <= 16384 then 2 when n <= 262144 then 3 else 4 end)) as shard
            from sized)
        select doc_id, lang, epoch,
               row_number() over (partition by epoch order by md5(concat_ws(':', '1', 'epoch-shard', epoch, shard)), shard,
                                  md5(concat_ws(':', '1', 'epoch', epoch, doc_id)), doc_id) - 1 as pos
        from dealt, range(0, 3) e(epoch)""",
)
oracle(
    "stream_shuffle",
    f"""with recursive laned as (
            select doc_id, {draw(1, 'lane', 'doc_id')} % 8 as lane from documents),
        arriving as materialized (
            select *, row_number() over (partition by lane order by doc_id) - 1 as n, count(*) over (partition by lane) as total from laned),
        walk as (
            select lane, n, total, [doc_id] as held, cast(null as bigint) as out from arriving where n = 0
            union all
            select a.lane, a.n, a.total,
                   case when a.n < 16 then list_append(held, a.doc_id)
                        else list_concat(list_append(held[1 : slot], a.doc_id), held[slot + 2 :]) end,
                   case when a.n >= 16 then held[slot + 1] end
            from (select w.held, a.*, {draw(1, 'slot', 'a.lane', 'a.n')} % 16 as slot
                  from walk w join arriving a on a.lane = w.lane and a.n = w.n + 1) a),
        rest as (
            select lane, total, unnest(held) as doc_id, unnest(range(0, len(held))) as slot, len(held) as kept from walk where n = total - 1),
        released as (
            select lane, n - 16 as pos, out as doc_id from walk where n >= 16
            union all
            select lane, total - kept + row_number() over (partition by lane order by {draw(1, 'end', 'lane', 'slot')}, slot) - 1, doc_id from rest)
        select lane, pos, doc_id, lang from released join documents using (doc_id)""",
)
oracle(
    "rekey_records",
    """select '' as inputs, text as targets, case doc_id % 3 when 0 then text when 1 then lang else source end as chosen,
              cast(doc_id as varchar) as doc_id
       from documents""",
)
oracle("sink_cached_tokens", f"select doc_id, {joined(letter_ids('text'))} as ids, 1 as builds from documents")
oracle(
    "mixture_tasks",
    f"""with recursive records as (
            select lang, octet_length(encode(case lang when 'fr' then {HANGUL} else text end)) as bytes,
                   row_number() over (partition by lang order by {digest(1, 'order', 'doc_id')}, doc_id) - 1 as record_no
            from documents where lang in ('fr', 'en')),
        chunks as (
            select lang, record_no // 128 as group_id,
                   least(65536, bytes - {draw(1, 'chunk', 'record_no')} % cast(ceil(bytes / 65536.0) as bigint) * 65536) as n
            from records where bytes > 0),
        streams as (select lang, group_id, cast(ceil(sum(n) / {SEGMENT}.0) as bigint) as pieces from chunks group by 1, 2),
        examples as (
            select case lang when 'fr' then 'letters_ascending' else 'bytes_ascending' end as task, group_id, unnest(range(0, pieces)) as segment
            from streams),
        ranked as (
            select *, row_number() over (partition by task order by {digest(1, 'mix', 'task', 'group_id', 'segment')}, group_id, segment) - 1 as rank,
                   count(*) over (partition by task) as size
            from examples),
        walk as (
            select 0 as place, 0 as b, 0 as l, -1 as pick
            union all
            select place + 1, b + cast(best % 10 = 0 as int), l + cast(best % 10 = 1 as int), best % 10
            from (select *, least(case when b * 10 // 3 <= place then ((b + 1) * 10 + 2) // 3 * 10 else 10000 end,
                                  case when l * 10 // 7 <= place then ((l + 1) * 10 + 6) // 7 * 10 + 1 else 10000 end) as best
                  from walk where place < 10)),
        places as (
            select ['bytes_ascending', 'letters_ascending'][pick + 1] as task, place - 1 as place,
                   row_number() over (partition by pick order by place) - 1 as nth, count(*) over (partition by pick) as weight
            from walk where place > 0),
        every as (
            select task, k * 10 + place as pos, k * weight + nth as row
            from places, range(0, (select count(*) // 10 + 1 from examples)) t(k) where k * 10 + place < (select count(*) from examples))
        select r.task, r.group_id, r.segment, e.row // r.size as epoch, e.pos
        from every e join ranked r on r.task = e.task and r.rank = e.row % r.size""",
)
ORACLES["sql_recipe"] = ORACLES["corrupt_pairs"]
