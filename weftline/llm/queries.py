"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op3_ann
from .fingerprint import op4_fingerprint
from .html_extract import OP9_SQL, op9_html_extract
from .mixing import op6_mixing
from .ngram_join import op5_ngram_join
from .secrets import op7_secrets
from .sentencepiece_codec import op8_sentencepiece
from .sharding import op2_sharding
from .toxicity import op1_toxicity
from .url_filter import OP10_SQL, op10_url_filter

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_ann, op4_fingerprint, op5_ngram_join, op6_mixing, op7_secrets, op8_sentencepiece, op9_html_extract, op10_url_filter)}

OP5_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w
), n as (select doc_id, len(s)::bigint as n from s
), e as materialized (select doc_id, unnest(s) as t from s
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from e a join e b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2
), link as materialized (
  select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)
), both_ways as materialized (select a, b from link union all select b, a from link
), reach(doc_id, node) as (
  select doc_id, doc_id from n union select r.doc_id, l.b from reach r join both_ways l on l.a = r.node
), root as (select doc_id, min(node) as component_id from reach group by 1
), degree as (select a as doc_id, count(*) as k from both_ways group by 1)
select n.doc_id, n.n as n_shingles, coalesce(d.k, 0)::bigint as n_similar, root.component_id
from n join root using (doc_id) left join degree d using (doc_id)
"""

SQL = {"op5_ngram_join": OP5_SQL, "op9_html_extract": OP9_SQL, "op10_url_filter": OP10_SQL}
