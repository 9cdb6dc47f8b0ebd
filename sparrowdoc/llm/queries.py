"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audio, bpe, decontaminate, divergence, lines, quality, repair, rlz, secrets, setsketch, suffixes, tools
from .registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


OP1_SQL = r"""
with iw as (select item_id::varchar item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, least(10, len(w)) n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') k from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from iw where len(w) > 0)),
dw as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
dwin as (select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, (select distinct n from win))),
hits as (select doc_id, i, n, item_id from dwin join win using (n, k)),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by 1),
o as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from hits group by 1)
select dw.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join h on h.doc_id = dw.doc_id left join o on o.doc_id = dw.doc_id"""

OP2_SQL = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
win as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) k from (select doc_id, w, unnest(range(1, len(w) - 33)) i from w)),
rep as (select k from win group by 1 having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) p from win join rep using (k)),
words as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x from w),
kept as (select words.doc_id, string_agg(x, ' ' order by words.p) t, count(*) n from words anti join gone on gone.doc_id = words.doc_id and gone.p = words.p group by 1)
select w.doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from w left join kept using (doc_id)"""

OP6_SQL = r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w from documents),
s as (select distinct doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) k from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
pairs as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
two as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id r from documents union select reach.doc_id, two.b from reach join two on two.a = reach.r),
least_ as (select doc_id, min(r) component_id from reach group by 1)
select w.doc_id, coalesce(n.n, 0) n_shingles, component_id, w.doc_id = component_id kept from w join least_ using (doc_id) left join n on n.doc_id = w.doc_id"""

OP7_SQL = r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
win as (select doc_id, i, md5(substring(h, 2 * i + 1, 800)) k from (select doc_id, h, unnest(range(0, length(h) // 2 - 399)) i from b)),
rep as (select k from win group by 1 having count(*) > 1),
hit as (select doc_id, i from win join rep using (k)),
edge as (select doc_id, i, case when i <= max(i) over w + 399 + 1 then 0 else 1 end new from hit window w as (partition by doc_id order by i rows between unbounded preceding and 1 preceding)),
run as (select doc_id, r, min(i) lo, max(i) + 400 hi from (select doc_id, i, sum(coalesce(new, 1)) over (partition by doc_id order by i) r from edge) group by 1, 2),
gap as (select doc_id, coalesce(lag(hi) over w, 0) lo, lo hi from run window w as (partition by doc_id order by lo)),
gaps as (select doc_id, lo, hi from gap union all select doc_id, max(hi), 1000000000000 from run group by 1 union all select doc_id, 0, 1000000000000 from b where doc_id not in (select doc_id from run)),
kept as (select doc_id, string_agg(substring(h, 2 * lo + 1, 2 * (least(hi, length(h) // 2) - lo)), '' order by lo) h from gaps join b using (doc_id) group by 1),
n as (select doc_id, count(*) n_spans, sum(hi - lo)::bigint n_removed from run group by 1)
select b.doc_id, length(b.h) // 2 n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(kept.h)) kept_sha256 from b left join n on n.doc_id = b.doc_id left join kept on kept.doc_id = b.doc_id"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark, sf_dir):
    found = decontaminate.find(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found.drop("text"))


@query("op3_byte_bpe")
def op3(spark, sf_dir):
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, digests=True)


@query("op9_telephony_audio")
def op9(spark, sf_dir):
    return audio.digest(audio.expand(audio.store(_documents(spark, sf_dir)).drop("text")))


@query("op10_secret_scan")
def op10(spark, sf_dir):
    return secrets.scan(_documents(spark, sf_dir)).drop("text")


@query("op2_rlz_substring_dedup", OP2_SQL)
def op2(spark, sf_dir):
    out = rlz.dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_suffix_dedup", OP7_SQL)
def op7(spark, sf_dir):
    return suffixes.dedup(_documents(spark, sf_dir), digests=True)


@query("op6_setsketch_near_dedup", OP6_SQL)
def op6(spark, sf_dir):
    return setsketch.near_duplicates(_documents(spark, sf_dir)).drop("uid", "leader")


@query("op5_fuzzy_line_dedup")
def op5(spark, sf_dir):
    out = lines.dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.classify(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


OP8_SQL = """
with t as (select *, cast(conv_id as varchar) || '-' as k from conversations),
calls as (select k || cast(turn as varchar) call_id, conv_id, turn, case when role = 'user' then 'reply' else 'note' end as name, role, text, case when role = 'user' and turn >= 2 then k || cast(turn - 2 as varchar) end after from t where role <> 'assistant'),
c as (select call_id, count(*) n, min({'turn': turn, 'name': name, 'text': text, 'conv_id': conv_id, 'role': role, 'after': after}) x from calls group by 1),
r as (select k || cast(turn - 1 as varchar) call_id, count(*) n, min({'turn': turn, 'text': text, 'conv_id': conv_id}) x from t where role = 'assistant' group by 1),
chain as (select call_id, conv_id, turn, name, turn // 2 - row_number() over (partition by conv_id, turn % 2, name order by turn) island from (select call_id, x.conv_id conv_id, x.turn turn, x.name as name from c)),
steps as (select call_id, row_number() over (partition by conv_id, turn % 2, name, island order by turn) - 1 + (case when name = 'reply' and exists (select 1 from c o where o.call_id = conv_id || '-' || (first - 2) and o.x.name = 'note') then 1 else 0 end) as level
          from (select *, min(turn) over (partition by conv_id, turn % 2, name, island) first from chain)),
j as (select coalesce(c.call_id, r.call_id) call_id, coalesce(c.x.conv_id, r.x.conv_id) conv_id, coalesce(c.x.turn, r.x.turn) turn,
             coalesce(c.n, 0) n_calls, coalesce(r.n, 0) n_results, c.x ask, r.x answer,
             case when c.n is null then 'orphan' when r.n is null then 'open' when r.x.turn < c.x.turn then 'early' else 'linked' end status
      from c full join r on c.call_id = r.call_id)
select conv_id, j.call_id, turn, n_calls, n_results, (case when ask.after is not null and ask.after not in (select call_id from c) then 1 else 0 end)::bigint n_missing, status,
       case when ask is null then null when ask.name = 'note' then 0 else level end::bigint as level, ask is not null as valid,
       '{"arguments":' || (case when ask is null then 'null' when ask.name = 'note' then to_json({'role': ask.role, 'text': ask.text})::varchar
         when ask.after is null then to_json({'prompt': ask.text, 'turn': ask.turn})::varchar else to_json({'after': ask.after, 'prompt': ask.text, 'turn': ask.turn})::varchar end)
       || ',"id":' || to_json(j.call_id)::varchar || ',"name":' || (case when ask is null then 'null' else '"' || ask.name || '"' end) || ',"result":' || (case when answer is null then 'null' else to_json(answer.text)::varchar end)
       || ',"status":"' || status || '"}' as record
from j left join steps on steps.call_id = j.call_id"""


@query("op8_tool_call_linking", OP8_SQL)
def op8(spark, sf_dir):
    calls, results = tools.turns(_table(spark, sf_dir, "conversations"))
    return tools.link(calls, results, tools.TURNS)


@query("op11_repair_token_shards")
def op11(spark, sf_dir):
    import public_tokenizers

    return repair.documents(repair.write(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2))


@query("op12_cross_tokenizer_alignment")
def op12(spark, sf_dir):
    import public_tokenizers

    return alignment.align(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


OP13_SQL = r"""
with d as (select coalesce(text, '') text, coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () r from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
c as (select lang, source, term, count(*) n, count(distinct r) k from w group by all),
kept as (select lang, term, sum(n) n from c group by all having sum(k) >= 10),
lv as (select lang, count(*) v, sum(n) total from kept group by 1),
g as (select distinct lang, source from d),
dense as (select g.lang, g.source, kept.term, coalesce(c.n, 0)::hugeint n, v, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) total, kept.n::hugeint ln, lv.total lt
          from g join kept on kept.lang = g.lang join lv on lv.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
p as (select *, 1 + (1000000000 * (n + 2)) // (total + 2 * v)::hugeint p, 1 + (1000000000 * (ln + 2)) // (lt + 2 * v)::hugeint q from dense),
pair as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) v from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
rows as (select a.lang, a.source, 'pair' part, b.source item, coalesce(v, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
         union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from rows qualify part = 'pair' or rank <= 10"""


@query("op13_source_divergence", OP13_SQL)
def op13(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))
