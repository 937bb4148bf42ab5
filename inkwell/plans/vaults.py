"""Queries of stored notes: names beside taken ones, and notes that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.operators import notes
from inkwell.plans.catalog import _docs, query, table
from inkwell.sources import note_sink
from inkwell.sources.shared import shared_dir

_ROWS = "select doc_id as seq, 'n/' || doc_id // 5 || '.md' as path, 'h000000' || doc_id % 2 || doc_id % 5 % 3 as identity, doc_id // 5 as k from documents"
_TAKEN = """select 'n/' || k || '.md' as path, case when k % 4 = 0 then 'other' else 'h0000000' || k % 3 end as identity from (select distinct doc_id // 5 as k from documents) where k % 4 < 2
  union all select 'n/' || k || '-h0000000.md', 'other' from (select distinct doc_id // 5 as k from documents) where k % 3 = 0
  union all select 'n/' || k || '-h0000000-3.md', 'h00000001' from (select distinct doc_id // 5 as k from documents) where k % 2 = 0
  union all select 'n/' || k || '-h0000001-2.md', 'h00000010' from (select distinct doc_id // 5 as k from documents) where k % 5 = 0"""


@query(
    "collision_names",
    f"""with recursive r as (select *, row_number() over (partition by path order by seq) as pos from ({_ROWS})),
    t as (select k, list(struct_pack(n := t.path, i := t.identity)) as taken from (select distinct k, path from r) q join ({_TAKEN}) t on t.path = q.path or starts_with(t.path, 'n/' || q.k || '-') group by k),
    f as (select distinct r.k, 0::bigint as pos, coalesce(t.taken, []) as taken, null::bigint as seq, null::varchar as final_path from r left join t using (k)
      union all select k, pos, list_append(taken, struct_pack(n := name, i := identity)), seq, name from (
        select f.k, r.pos, f.taken, r.seq, r.identity, list_filter(list_concat([r.path, stem || '.md'], list_transform(range(2, 12), lambda x: stem || '-' || x || '.md')),
          lambda c: len(list_filter(f.taken, lambda t: t.n = c and t.i <> r.identity)) = 0)[1] as name
        from f join (select *, replace(path, '.md', '-' || left(identity, 8)) as stem from r) r on r.k = f.k and r.pos = f.pos + 1))
    select seq, final_path from f where seq is not null""",
)
def _(spark, d):
    docs = _docs(spark, d)
    rows = docs.selectExpr(*[x.replace("//", "div") for x in ("doc_id as seq", "'n/' || doc_id // 5 || '.md' as path", "'h000000' || doc_id % 2 || doc_id % 5 % 3 as identity")])
    k = docs.selectExpr("doc_id div 5 as k").distinct()
    taken = k.where("k % 4 < 2").selectExpr("'n/' || k || '.md' as path", "case when k % 4 = 0 then 'other' else 'h0000000' || k % 3 end as identity")
    for rule, suffix, identity in (("k % 3 = 0", "-h0000000", "other"), ("k % 2 = 0", "-h0000000-3", "h00000001"), ("k % 5 = 0", "-h0000001-2", "h00000010")):
        taken = taken.union(k.where(rule).selectExpr(f"'n/' || k || '{suffix}.md'", f"'{identity}'"))
    return notes.without_collisions(rows, taken).select("seq", "final_path")


@query(
    "written_notes",
    "select 'c' || page_id % 7 || case when page_id % 2 = 0 then '/2024' else '' end || '/p ' || page_id || '.md' as path, sha256('# ' || url || chr(10) || case when page_id % 7 = 3 then 'again' else html end) as note from pages",
)
def _(spark, d):
    """Two batches of notes, the second with new notes in the places of some, and then read back."""
    pages = table(spark, d, "pages")
    path = F.expr("'c' || page_id % 7 || case when page_id % 2 = 0 then '/2024' else '' end || '/p ' || page_id || '.md'")
    note = lambda body: F.concat(F.lit("# "), "url", F.lit("\n"), body)
    root = f"{shared_dir(spark)}/notes-{uuid.uuid4().hex}"
    note_sink.write_notes(pages.select(path.alias("final_path"), note(F.col("html")).alias("note")), root)
    note_sink.write_notes(pages.where("page_id % 7 = 3").select(path.alias("final_path"), note(F.lit("again")).alias("note")), root)
    return note_sink.read_notes(spark, root).select("path", F.sha2("note", 256).alias("note"))
