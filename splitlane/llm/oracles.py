"""DuckDB SQL giving the same rows as the queries, where SQL can express them in reasonable time."""

ORACLES: dict[str, str] = {}

ORACLES["op3_mix_sources"] = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as ubigint) as hash
  from documents
), sources as (
  select source, cast(sum(size) as double) as source_size,
         [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sized group by source
), levels as (
  select *, 3 * source_size as cap,
         (sum(source_size) over () - coalesce(sum(3 * source_size) over (
            order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by 3 * source_size / weight, source nulls last
                             rows between current row and unbounded following) as level
  from sources
), targets as (
  select source, source_size, least(cap, max(level) over () * weight) as target from levels
), plans as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets
), cells as (
  select source, hash, sum(size) as cell from sized group by source, hash
), sums as (
  select c.*, sum(cell) over (partition by c.source order by hash) as upto, floor(target) - whole * source_size as budget
  from cells c join plans p on c.source is not distinct from p.source
), chosen as (
  select source, hash,
         upto <= budget or (upto - cell <= budget and 2 * (budget - (upto - cell)) > cell) as extra
  from sums
)
select s.doc_id, s.size, cast(p.source_size as bigint) as source_size, p.target,
       cast(s.size * (p.whole + case when c.extra then 1 else 0 end) as bigint) as taken
from sized s
join plans p on s.source is not distinct from p.source
join chosen c on s.source is not distinct from c.source and s.hash = c.hash
"""
