"""The registered queries of the engine: each runs an operator over a whole table and has its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import MIX_LAST, MIX_STEPS, PTYPES, bit_length, mix64, packed_bytes, ptype_class, trailing_zeros
from ..operators import codecs as c
from ..operators import floats, paging, stats
from . import estimates as est

ORDERS = {
    "lineitem": ("l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]),
    "orders": ("o_orderkey", ["o_orderkey"]), "events": ("event_id", ["event_id"]), "documents": ("doc_id", ["doc_id"]), "customer": ("c_custkey", ["c_custkey"]),
}
#: Expressions that both dialects read alike.
LINENO, PART, NULLS, MANY_NULLS = "cast(l_linenumber as bigint)", "l_partkey", "nullif(cast(l_linenumber as bigint), 1)", "case when l_linenumber = 7 and l_returnflag = 'A' then l_partkey end"
SPARSE, CONST, SIGNED, QUANTITY = "case when l_quantity = 50 then l_partkey % 200 else 7 end", "cast(l_linenumber * 0 + 42 as bigint)", "cast(l_linenumber - 4 as bigint)", "cast(l_quantity as bigint)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str, value: str, table: str = "lineitem", order: list[str] | None = None) -> DataFrame:
    key, by = ORDERS[table]
    return paging.paged(load(spark, sf_dir, table), value, key=key, order_by=order or by)


def pages_sql(value: str, table: str = "lineitem", order: list[str] | None = None) -> str:
    key, by = ORDERS[table]
    page = f"cast(floor({key} / 1024) as bigint)"
    return f"p as (select {page} as page_id, row_number() over (partition by {page} order by {', '.join(order or by)}) - 1 as pos, {value} as v from {table})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, fn: Callable[[DataFrame], DataFrame], value: str, sql: str | None, table: str = "lineitem", order: list[str] | None = None) -> None:
    """Register ``fn`` over the pages of an expression; ``sql`` follows ``with p as (...)``."""
    QUERIES[name] = lambda spark, sf_dir: fn(pages(spark, sf_dir, value, table, order))
    if sql is not None:
        ORACLES[name] = f"with {pages_sql(value, table, order)}{sql}"


BITS = lambda x: f"(case when {x} = 0 then 0 else length(bin({x})) end)"
SAME = " select page_id, pos, v from p"

# -- scans, slices, access -------------------------------------------------------------------------------------------
add("scan_pages", lambda p: p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"), F.sum("v").cast("bigint").alias("total")), PART, " select page_id, count(*) as n, max(pos) as last_pos, sum(v)::bigint as total from p group by page_id")
add("null_mask_apply", lambda p: p, NULLS, SAME)
add("string_layout", c.string_layout, "o_orderpriority", " select page_id, pos, coalesce(sum(strlen(v)) over (partition by page_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start_offset, strlen(v)::bigint as len from p", "orders")
add("fsst_layout", c.string_layout, "props", " select page_id, pos, coalesce(sum(strlen(v)) over (partition by page_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start_offset, strlen(v)::bigint as len from p", "events")
add("value_at", lambda p: paging.value_at(p, 100), PART, " select page_id, pos, v from p where pos = 100")
add("slice_window", lambda p: paging.slice_window(p, 100, 300), PART, " select page_id, pos - 100 as pos, v from p where pos >= 100 and pos < 300")
add("null_count", stats.null_count, NULLS, " select page_id, count(*) as n, count(*) filter (v is null) as nulls from p group by page_id")
add("validity_bitmap", paging.validity_bitmap, NULLS, " select page_id, cast(floor(pos / 8) as bigint) as byte_idx, sum(case when v is not null then 1 << (pos % 8)::int else 0 end)::bigint as validity_byte from p group by all")
add("encoded_size", est.encoded_size, PART, f""", x as (select *, case when pos > 0 and v = lag(v) over (partition by page_id order by pos) then 0 else 1 end as ch from p),
s as (select page_id, count(*) as n, {BITS('(max(v) - min(v))')} as rw, sum(ch) as runs from x group by page_id)
select page_id, n, 44 + n * 8 as raw_bytes, (57 + (n * rw + 7) // 8)::bigint as for_bytes, 40::bigint as sequence_bytes, (68 + runs * 8 + 44 + (runs - 1) * 4)::bigint as runend_bytes from s""")

# -- scalars ---------------------------------------------------------------------------------------------------------
add("bit_length", lambda p: p.select("page_id", "pos", bit_length(F.col("v")).cast("bigint").alias("bits")), PART, f" select page_id, pos, {BITS('v')}::bigint as bits from p")
add("packed_bytes", lambda p: p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max(bit_length(F.col("v"))).alias("b")).select("page_id", packed_bytes(F.col("n"), F.col("b")).alias("bytes")), PART, f" select page_id, ((count(*) * max({BITS('v')}) + 7) // 8)::bigint as bytes from p group by page_id")

add("bit_count", lambda p: p.select("page_id", "pos", F.bit_count("v").alias("ones")), SIGNED, " select page_id, pos, bit_count(v)::int as ones from p")
add("trailing_zeros", lambda p: p.select("page_id", "pos", trailing_zeros(F.col("v")).alias("zeros")), SIGNED, " select page_id, pos, (case when v = 0 then 64 else bit_count((v & -v) - 1) end)::int as zeros from p")


def _mix_sql() -> str:
    """The finaliser on unsigned 128-bit numbers, reduced after each product."""
    word, x = "18446744073709551616::hugeint", "(v::hugeint + case when v < 0 then 18446744073709551616::hugeint else 0::hugeint end)"
    steps = [f"m0 as (select page_id, pos, {x} as x from p)"]
    for i, (shift, by) in enumerate(MIX_STEPS):
        # the factor in two halves, so that no product leaves 127 bits
        y = f"xor(x, x // {1 << shift}::hugeint)"
        steps.append(f"m{i + 1} as (select page_id, pos, ((({y} * {by >> 32}::hugeint) % {word}) * {1 << 32}::hugeint % {word} + {y} * {by & 0xFFFFFFFF}::hugeint) % {word} as x from m{i})")
    last = f"xor(x, x // {1 << MIX_LAST}::hugeint)"
    return ", " + ", ".join(steps) + f" select page_id, pos, ({last} - case when {last} >= 9223372036854775808::hugeint then {word} else 0::hugeint end)::bigint as mixed from m{len(MIX_STEPS)}"


add("mix64", lambda p: p.select("page_id", "pos", mix64(F.col("v")).alias("mixed")), SIGNED, _mix_sql())

# -- statistics ------------------------------------------------------------------------------------------------------
RUNS = ", x as (select *, case when pos > 0 and v is not distinct from lag(v) over (partition by page_id order by pos) then 0 else 1 end as ch from p)"
DISTINCT = ", f as (select page_id, v, count(*) as c from p group by page_id, v), g as (select page_id, sum(c)::bigint as n, count(*) as d, max(c) as most from f group by page_id), s as (select page_id, n, (case when d > greatest(1, least(256, n // 2)) then n else d end)::bigint as distinct_v, (case when d > greatest(1, least(256, n // 2)) then 0 else most end)::bigint as most_frequent from g)"
SEQ = ", d as (select *, v - lag(v) over (partition by page_id order by pos) as d from p), q as (select page_id, count(*) as n, min_by(v, pos) as b, min(d) as lo, max(d) as hi from d group by page_id)"
add("int_stats", stats.int_stats, SIGNED, " select page_id, count(*) as n, min(v) as min_v, max(v) as max_v, bool_or(v < 0) as has_negative from p group by page_id")
add("run_stats", stats.run_stats, LINENO, RUNS + " select page_id, count(*) as n, sum(ch)::bigint as runs, sum(ch) = 1 as is_const from x group by page_id")
add("sequence_detect", stats.sequence_stats, "o_orderkey", SEQ + " select page_id, n, coalesce(lo = hi and lo <> 0, false) as is_sequence, case when lo = hi and lo <> 0 then b end as base, case when lo = hi and lo <> 0 then lo end as step from q", "orders")
add("distinct_stats", stats.distinct_stats, LINENO, DISTINCT + " select * from s")
add("distinct_stats_overflow", stats.distinct_stats, PART, DISTINCT + " select * from s")
add("dominance", stats.dominance, SPARSE, DISTINCT + " select page_id, n, most_frequent, least(most_frequent, n) >= n - n // 10 as dominant from s")
add("float_distinct", lambda p: floats.with_bits(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bits").alias("distinct_v")), "l_extendedprice", " select page_id, count(*) as n, count(distinct v) as distinct_v from p group by page_id")
add("float_bits", lambda p: floats.with_bits(p).select("page_id", "pos", "bits"), "l_discount", " select page_id, pos, case when v = 0 then 0 else ((floor(log2(v))::bigint + 1023) << 52) + ((v / pow(2.0, floor(log2(v))) - 1) * 4503599627370496)::bigint end as bits from p")
add("string_stats", stats.string_stats, "l_returnflag", RUNS + " select page_id, count(*) as n, (case when count(distinct v) > 4096 then count(*) else count(distinct v) end)::bigint as distinct_v, sum(ch)::bigint as runs, sum(strlen(v))::bigint as total_bytes from x group by page_id")
add("bitwidth_histogram", stats.bitwidth_histogram, PART, f" select page_id, {BITS('v')}::int as bit_width, count(*) as cnt from p group by all")

# -- codecs ----------------------------------------------------------------------------------------------------------
add("roundtrip_raw", lambda p: p, PART, SAME)
add("const_detect", c.const_encode, CONST, " select page_id, count(*) as n, min(v) = max(v) as is_const, case when min(v) = max(v) then min(v) end as v from p group by page_id")
add("roundtrip_const", lambda p: c.const_decode(c.const_encode(p)), CONST, SAME)
add("roundtrip_sequence", lambda p: c.sequence_decode(c.sequence_encode(p)), "o_orderkey", SAME, "orders")
add("for_encode", c.for_frames, PART, f" select page_id, count(*) as n, min(v) as ref_min, {BITS('(max(v) - min(v))')}::int as bit_width from p group by page_id")
add("roundtrip_for", lambda p: c.for_decode(c.for_encode(p)), PART, SAME)
add("delta_encode", c.delta_encode, "o_custkey", " select page_id, pos, v - coalesce(lag(v) over (partition by page_id order by pos), 0) as d from p", "orders")
add("roundtrip_delta", lambda p: c.delta_decode(c.delta_encode(p)), "o_custkey", SAME, "orders")
add("zigzag_encode", c.zigzag_encode, SIGNED, " select page_id, pos, (case when v < 0 then -2 * v - 1 else 2 * v end)::bigint as z from p")
add("roundtrip_zigzag", lambda p: c.zigzag_decode(c.zigzag_encode(p)), SIGNED, SAME)
WIDTHS = f""", h as (select page_id, {BITS('v')}::int as bit_width, count(*) as cnt from p group by all),
w as (select page_id, bit_width, (sum(cnt) over (partition by page_id))::bigint as n, (sum(cnt) over (partition by page_id) - sum(cnt) over (partition by page_id order by bit_width))::bigint as exceptions from h),
k as (select *, ((n * bit_width + 7) // 8 + exceptions * 12)::bigint as cost from w), best as (select * from k qualify row_number() over (partition by page_id order by cost, bit_width) = 1)"""
OUTLIERS = "case when l_quantity = 50 and l_discount = 0 then l_partkey * 1000000 else l_linenumber end"
add("bitpack_best_width", c.bitpack_widths, OUTLIERS, WIDTHS + " select page_id, bit_width, n, exceptions, cost from best")
add("bitpack_patches", lambda p: c.bitpack_encode(p)[1], OUTLIERS, WIDTHS + f" select p.page_id, pos, v from p join best using (page_id) where {BITS('v')} > bit_width")
add("roundtrip_bitpack", lambda p: c.patch_overlay(*c.bitpack_encode(p), "low"), OUTLIERS, SAME)
add("patch_overlay", lambda p: c.patch_overlay(p.withColumn("v", F.lit(7).cast("bigint")), p.where("v <> 7")), SPARSE, SAME)
DICT = ", f as (select page_id, v, min(pos) as fp, count(*) as cnt from p group by page_id, v), d as (select page_id, row_number() over (partition by page_id order by fp) - 1 as ord, v, cnt from f)"
add("dict_values", lambda p: c.dict_encode(p)[0], LINENO, DICT + " select * from d")
add("dict_cardinality", lambda p: c.dictionary(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("k")), LINENO, " select page_id, count(distinct v) as k from p group by page_id")
add("dict_encode", lambda p: c.dict_encode(p)[1], LINENO, DICT + " select p.page_id, pos, ord from p join d using (page_id, v)")
add("roundtrip_dict", lambda p: c.dict_decode(*c.dict_encode(p)), LINENO, SAME)
add("roundtrip_dict_string", lambda p: c.dict_decode(*c.dict_encode(p)), "l_returnflag", SAME)
add("roundtrip_dict_float", lambda p: c.dict_decode(*c.dict_encode(floats.with_bits(p), F.col("bits"))), "l_discount", SAME)
add("dict_filter_eq", lambda p: c.dict_filter(*c.dict_encode(p), F.col("v") == 3), LINENO, " select page_id, pos from p where v = 3")
add("dict_filter_in", lambda p: c.dict_filter(*c.dict_encode(p), F.col("v").isin("A", "R")), "l_returnflag", " select page_id, pos from p where v in ('A', 'R')")
add("dict_filter_ne", lambda p: c.dict_filter(*c.dict_encode(p), F.col("v") == 3, negate=True), LINENO, " select page_id, pos from p where v <> 3")
add("bsi_equals", lambda p: c.bsi_equals(*c.dict_encode(p), F.lit(3), 3), LINENO, " select page_id, pos from p where v = 3")
EXTREME = "case when l_linenumber = 1 then 9223372036854775807 when l_linenumber = 2 then -9223372036854775807 - 1 else l_partkey end"
add("roundtrip_delta_extremes", lambda p: c.delta_decode(c.delta_encode(p)), EXTREME, SAME)
add("roundtrip_for_extremes", lambda p: c.for_decode(c.for_encode(p)), EXTREME, SAME)
add("roundtrip_zigzag_extremes", lambda p: c.zigzag_decode(c.zigzag_encode(p)), EXTREME, SAME)
add("bsi_equals_many_values", lambda p: c.bsi_equals(*c.dict_encode(p), F.lit(103), 3), PART, " select page_id, pos from p where v = 103")
RARE_PART = "case when l_quantity = 50 and l_discount < 0.05 then l_partkey % 200 else 7 end"
BY_FLAG = ["l_returnflag", *ORDERS["lineitem"][1]]
FLAG = "case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end"
ENC_RUNS = RUNS + ", y as (select *, sum(ch) over (partition by page_id order by pos) - 1 as run from x), r as (select page_id, run::bigint as run, min_by(v, pos) as v, min(pos) as run_start, max(pos) + 1 as run_end from y group by page_id, run)"
add("runend_encode", c.runend_encode, LINENO, ENC_RUNS + " select * from r")
add("roundtrip_runend", lambda p: c.runend_decode(c.runend_encode(p)), f"cast({FLAG} as bigint)", SAME, order=BY_FLAG)
add("roundtrip_runend_string", lambda p: c.runend_decode(c.runend_encode(p)), "l_returnflag", SAME, order=BY_FLAG)
add("runend_decode", lambda p: c.runend_lookup(c.runend_encode(p), p.select("page_id", "pos")), LINENO, SAME)
FILL = ", fl as (select page_id, v as fill, count(*) as cnt from p group by page_id, v qualify row_number() over (partition by page_id order by count(*) desc, max(pos)) = 1)"
add("sparse_fill", c.sparse_fill, SPARSE, FILL + " select * from fl")
add("sparse_encode", lambda p: c.sparse_encode(p)[1], SPARSE, FILL + " select p.page_id, pos, v from p join fl using (page_id) where v <> fill")
add("sparse_exceptions", lambda p: c.sparse_encode(p)[1].groupBy("page_id").agg(F.count(F.lit(1)).alias("num_values"), F.sum("v").cast("bigint").alias("total")), SPARSE, FILL + " select p.page_id, count(*) as num_values, sum(v)::bigint as total from p join fl using (page_id) where v <> fill group by p.page_id")
add("roundtrip_sparse", lambda p: c.sparse_decode(*c.sparse_encode(p)), SPARSE, SAME)
add("roundtrip_sparse_string", lambda p: c.sparse_decode(*c.sparse_encode(p)), "case when l_quantity = 50 then l_returnflag else 'fill' end", SAME)
add("sparse_form_choice", c.sparse_form, SPARSE, FILL + """, k as (select page_id, count(*)::bigint as n, count(*) filter (v <> fill) as k from p join fl using (page_id) group by page_id),
b as (select page_id, n, k, (76 + 88 + k * (case when n <= 256 then 1 when n <= 65536 then 2 else 4 end) + k * 8)::bigint as index_bytes, (76 + (n + 7) // 8 + 44 + k * 8)::bigint as bitmap_bytes from k)
select *, case when bitmap_bytes < index_bytes then 'bitmap' else 'index' end as form from b""")
add("null_sparse", lambda p: c.null_sparse(p, F.lit(0).cast("bigint")), MANY_NULLS, " select page_id, pos, v from p where coalesce(v, 0) <> 0")
add("nullable_split", lambda p: c.nullable_split(p, F.lit(0).cast("bigint")), NULLS, " select page_id, pos, coalesce(v, 0) as masked, case when v is null then 0 else 1 end as valid from p")
add("roundtrip_nullable", lambda p: c.nullable_join(c.nullable_split(p, F.lit(0).cast("bigint"))), NULLS, SAME)
add("nullable_route", c.nullable_route, MANY_NULLS, ", s as (select page_id, count(*) as n, count(*) filter (v is null) as nulls from p group by page_id) select *, case when nulls = 0 then 'plain' when nulls = n then 'all_null' when nulls >= n - n // 10 then 'forced_sparse' else 'masked' end as route from s")

# -- floats ----------------------------------------------------------------------------------------------------------
_TEN = ", ".join(f"({k}, 1e{k}::double, 1e-{k}::double)" for k in range(floats.MAX_E))
_CODE = "round(v * a.t * b.i)"
_ALP = f""", ten(k, t, i) as (values {_TEN}), pr as (select a.k as e, b.k as f, a.t as pe, b.i as nf, a.i as ne, b.t as pf from ten a join ten b on b.k < a.k),
m as (select *, count(*) over (partition by page_id) as n from p), s as (select page_id, v from m where pos % (case when n > 64 then n // 64 else 1 end) = 0),
t as (select page_id, e, f, case when abs(round(v * pe * nf)) < 9.2e18 then coalesce(round(v * pe * nf)::bigint::double * ne * pf <> v, true) else true end as x from s, pr),
g as (select page_id, e, f, count(*) filter (x) as exceptions from t group by all),
bst as (select * from g qualify row_number() over (partition by page_id order by exceptions, e - f, e, f) = 1)"""
_ALP_ROWS = ", y as (select p.page_id, pos, v, e, f, round(v * pe * nf) as sc, ne, pf from p join bst using (page_id) join pr using (e, f)), z as (select *, case when abs(sc) < 9.2e18 then sc::bigint else 0 end as enc from y)"
add("alp_exponents", floats.alp_exponents, "l_extendedprice", _ALP + " select page_id, e, f, exceptions from bst")
add("alp_encode", lambda p: floats.alp_encode(p).select("page_id", "pos", "e", "f", "enc"), "l_extendedprice", _ALP + _ALP_ROWS + " select page_id, pos, e, f, enc from z")
add("alp_exceptions", lambda p: floats.alp_encode(p).where("patch is not null").select("page_id", "pos", F.col("patch").alias("v")), "l_tax", _ALP + _ALP_ROWS + " select page_id, pos, v from z where coalesce(enc::double * ne * pf <> v, true)")
add("roundtrip_alp", lambda p: floats.alp_decode(floats.alp_encode(p)), "l_discount", SAME)
_RD = """, w as (select page_id, pos, v::bit::varchar as bits, count(*) over (partition by page_id) as n from p), c as (select unnest(range(1, 17)) as cut),
t as (select page_id, cut, substr(bits, 1, cut::bigint) as l, count(*) as c from w, c where pos % (case when n > 1024 then n // 1024 else 1 end) = 0 group by all),
r as (select *, row_number() over (partition by page_id, cut order by c desc, l) as r from t),
k as (select page_id, cut, sum(c) as samples, sum(c) filter (r <= 8) as kept, least(max(r), 8) as k from r group by all),
costs as (select page_id, cut::int as cut, (samples - kept)::bigint as exceptions, 64 - cut + (case when k <= 2 then 1 when k <= 4 then 2 else 3 end) + (32 * (samples - kept))::double / samples::double as cost from k)"""
_RD_ROWS = """, b as (select page_id, cut from costs qualify row_number() over (partition by page_id order by cost, cut) = 1)
select w.page_id, pos, b.cut, (r - 1)::int as code, lpad(substr(bits, 1, b.cut), 64, '0')::bit::bigint as left_part, lpad(substr(bits, b.cut + 1), 64, '0')::bit::bigint as right_part
from w join b using (page_id) left join r on r.page_id = w.page_id and r.cut = b.cut and r.l = substr(bits, 1, b.cut) and r.r <= 8"""
add("alprd_cut_cost", floats.alprd_costs, "l_extendedprice * 1.000000001", _RD + " select * from costs")
add("alprd_encode", floats.alprd_encode, "l_extendedprice * 1.000000001", _RD + _RD_ROWS)
add("roundtrip_alprd", lambda p: floats.alprd_decode(floats.alprd_encode(p)), "l_extendedprice", SAME)

# -- planner ---------------------------------------------------------------------------------------------------------
add("sample_plan", est.sample_plan, PART, ", s as (select page_id, count(*) as n from p group by page_id), w as (select *, greatest(16, ((n // 100 // 64 + 15) // 16) * 16) as k from s) select page_id, n, (case when k * 64 >= n then 1 else k end)::bigint as windows, (case when k * 64 >= n then n else k * 64 end)::bigint as sampled from w")
add("raw_size", lambda p: p.groupBy("page_id").agg(est.raw_size(F.count(F.lit(1)), 8).alias("raw_bytes")), PART, " select page_id, 44 + count(*) * 8 as raw_bytes from p group by page_id")
_EST = DISTINCT + SEQ + RUNS + f""", i as (select page_id, count(*) as n, {BITS('(max(v) - min(v))')} as rw, sum(ch) as runs from x group by page_id),
e as (select i.page_id, i.n, rw, runs, coalesce(lo = hi and lo <> 0, false) as sq, distinct_v as d, {BITS('(distinct_v - 1)')} as cb from i join s using (page_id) join q using (page_id)),
cand as (select page_id, 0 as cand_idx, 'const' as codec, 52::bigint as after_bytes from e where runs = 1
union all select page_id, 1, 'sequence', 40 from e where sq
union all select page_id, 2, 'for', 57 + (n * rw + 7) // 8 from e where rw > 0 and rw < 64
union all select page_id, 4, 'dict', case when 44 + 8 * n < 256 then 24 + least(40, 44 + d * 8) + 25 + (n * cb + 7) // 8 else (64 * d + (case when n >= 4 * runs then least(cb * n, (cb + 32) * runs) else cb * n end) + 7) // 8 end from e where d > 1 and d <= n // 2)"""
add("scheme_estimates", est.scheme_estimates, LINENO, _EST + " select page_id, cand_idx, codec, after_bytes::bigint as after_bytes from cand")
add("raw_fallback", est.raw_fallback, LINENO, _EST + ", b as (select * from cand qualify row_number() over (partition by page_id order by after_bytes, cand_idx, codec) = 1) select i.page_id, case when after_bytes < 44 + 8 * n then codec else 'raw' end as codec, (case when after_bytes < 44 + 8 * n then after_bytes else 44 + 8 * n end)::bigint as bytes from i left join b using (page_id)")
_UNSIGNED = DISTINCT + SEQ + RUNS + f""", i as (select page_id, count(*) as n, {BITS('(max(v) - min(v))')} as rw, {BITS('max(v)')} as bl, min(v) as low, sum(ch) as runs from x group by page_id),
e as (select i.page_id, i.n, rw, bl, low, runs, coalesce(lo = hi and lo <> 0, false) as sq, distinct_v as d, {BITS('(distinct_v - 1)')} as cb from i join s using (page_id) join q using (page_id)),
cand as (select page_id, 0 as cand_idx, 'const' as codec, 48::bigint as after_bytes from e where runs = 1
union all select page_id, 1, 'sequence', 32 from e where sq
union all select page_id, 2, 'for', 53 + (n * rw + 7) // 8 from e where rw > 0 and rw < 32 and low <> 0 and rw < bl
union all select page_id, 4, 'dict', case when 44 + 4 * n < 256 then 24 + least(32, 44 + d * 4) + 25 + (n * cb + 7) // 8 else (32 * d + (case when n >= 4 * runs then least(cb * n, (cb + 32) * runs) else cb * n end) + 7) // 8 end from e where d > 1 and d <= n // 2
union all select page_id, 7, 'bitpack', 25 + (n * bl + 7) // 8 from e where 25 + (n * bl + 7) // 8 < 44 + 4 * n)"""
add("scheme_estimates_uint32", lambda p: est.scheme_estimates(p, 4, unsigned=True), "l_orderkey", _UNSIGNED + " select page_id, cand_idx, codec, after_bytes::bigint as after_bytes from cand")
_INT_FACTS = DISTINCT + SEQ + RUNS + ", i as (select page_id, sum(ch) as runs, min(v) as low from x group by page_id), e as (select page_id, s.n, 44 + 8 * s.n as raw, runs, most_frequent as most, low, coalesce(lo = hi and lo <> 0, false) as sq, lo, hi from s join i using (page_id) join q using (page_id))"
_SHARED_VERDICTS = "select page_id, 'runend' as codec, 'sample' as verdict from e where raw >= 256 and n >= 4 * runs union all select page_id, 'sparse', 'sample' from e where raw >= 256 and least(most, n) >= n - n // 10"
_INT_VERDICTS = _INT_FACTS + f" {_SHARED_VERDICTS} union all select page_id, 'zigzag', 'sample' from e where raw >= 256 and low < 0 union all select page_id, 'dict', 'sample' from e where raw >= 256 and most = 0 union all select page_id, 'delta', 'deferred' from e where n >= 1024 and not sq and 0.95::double * raw / (89 + (n - 1 + 7) // 8) > 1.25"
add("estimate_verdicts_int", est.integer_verdicts, SIGNED, _INT_VERDICTS)
add("estimate_verdicts_sparse", est.integer_verdicts, RARE_PART, _INT_VERDICTS)
add("estimate_verdicts_runs", est.integer_verdicts, f"cast({FLAG} as bigint)", _INT_VERDICTS, order=BY_FLAG)
add("delta_estimate", est.delta_estimate, "l_orderkey", _INT_FACTS + f", w as (select page_id, raw, (89 + ((n - 1) * {BITS('(hi - lo)')} + 7) // 8)::bigint as after_bytes from e where n >= 1024 and lo <> hi) select page_id, after_bytes, raw::double / after_bytes::double * 0.95::double as ratio from w where raw::double / after_bytes::double * 0.95::double > 1.25::double")
_FLOAT_FACTS = ", g as (select page_id, v, count(*) as c from p group by page_id, v), d as (select page_id, sum(c)::bigint as n, count(*) as d, max(c) as most from g group by page_id)" + RUNS + f", i as (select page_id, sum(ch) as runs from x group by page_id), e as (select page_id, n, 44 + 8 * n as raw, runs, d, case when d > 256 then 0 else most end as most, (64 * d + {BITS('(d - 1)')} * n)::bigint as after_bits from d join i using (page_id))"
_FLOAT_DICT = "d > 1 and d <= 8192 and d <= n // 2 and after_bits < 64 * n"
_FLOAT_VERDICTS = _FLOAT_FACTS + f" {_SHARED_VERDICTS} union all select page_id, unnest(['alp', 'alprd']), 'sample' from e where raw >= 256 and runs > 1 and not (d >= 2 and d <= 8192 and 16 * d <= n) union all select page_id, 'dict', 'deferred' from e where {_FLOAT_DICT}"
add("estimate_verdicts_float", est.float_verdicts, "l_extendedprice", _FLOAT_VERDICTS)
add("estimate_verdicts_float_few", est.float_verdicts, "l_discount", _FLOAT_VERDICTS)
add("float_dict_estimate", est.float_dict_estimate, "l_discount", _FLOAT_FACTS + f" select page_id, after_bits, (64 * n)::double / after_bits::double as ratio from e where {_FLOAT_DICT}")
_STRING_FACTS = RUNS + ", g as (select page_id, v, count(*) as c from p group by page_id, v), d as (select page_id, sum(c)::bigint as n, count(*) as d, max(c) as most from g group by page_id), i as (select page_id, sum(ch) as runs, sum(strlen(v)) as total from x group by page_id), e as (select page_id, n, runs, total, 48 + (n + 1) * (case when total <= 255 then 1 when total <= 65535 then 2 else 4 end) + total as raw, case when d > 4096 then n else d end as d, case when d > 4096 then 0 else most end as most from d join i using (page_id))"
_STRING_VERDICTS = _STRING_FACTS + f" {_SHARED_VERDICTS} union all select page_id, 'dict', 'sample' from e where raw >= 256 and d <= n // 2 union all select page_id, 'fsst', 'sample' from e where raw >= 256 and n >= 1024 and total >= 1024"
add("estimate_verdicts_string", est.string_verdicts, "l_returnflag", _STRING_VERDICTS)
add("estimate_verdicts_props", est.string_verdicts, "props", _STRING_VERDICTS, "events")
add("raw_size_string", lambda p: stats.string_profile(p).select("page_id", est.string_raw_size(F.col("n"), F.col("total_bytes")).alias("raw_bytes")), "props", _STRING_FACTS + " select page_id, raw::bigint as raw_bytes from e", "events")
QUERIES["exclusions"] = lambda spark, sf_dir: est.exclusions(spark)
ORACLES["exclusions"] = "select * from (values " + ", ".join(f"('{p}', {i}::int, '{x}')" for (p, i), xs in est.EXCLUSIONS.items() for x in xs) + ") t(parent, child_idx, excluded)"

# -- binary pages ----------------------------------------------------------------------------------------------------
from ..sources import pages as sealed  # noqa: E402
from ..wire import nodes, planner  # noqa: E402
from . import report  # noqa: E402

RARE = "case when l_quantity = 50 and l_discount < 0.05 then l_partkey * 1000003 else 7 end"
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of lineitem as sealed pages."""
    key, by = ORDERS["lineitem"]
    return report.compress(load(spark, sf_dir, "lineitem"), LINEITEM, key=key, order_by=by)


def compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.compression_report(compressed(spark, sf_dir))


#: What a page of part keys or line numbers becomes: a frame around packed bits, as no estimate is above its ratio.
_FRAME = f", s as (select page_id, count(*) as n, min(v) as low, max(v) as high, {BITS('(max(v) - min(v))')} as rw from p group by page_id)"
add("page_write", lambda p: sealed.seal(p).drop("blob"), PART, _FRAME + " select page_id, 'int64' as ptype, n as n_rows, 0::bigint as null_count, 'for' as root_codec, 'for(bitpack)' as tree, 44 + 8 * n as raw_bytes, (57 + (n * rw + 7) // 8)::bigint as encoded_bytes, 16 * n as decoded_bytes, low as min_v, high as max_v from s")


def _offsets(windows: int = planner.MIN_WINDOWS) -> str:
    """The generator's first numbers, of which each window takes one: pages of up to 100,000 rows have 16."""
    state, out = planner.SEED, []
    for i in range(windows):
        state = (state * planner.MUL + planner.INC) % 2**64
        out.append(f"({i}, {state >> 33}::bigint)")
    return ", ".join(out)


_OFFSETS = _offsets()
add("page_load", lambda p: sealed.load(sealed.seal(p), "int64", "bigint"), PART, SAME)
add("page_load_nullable", lambda p: sealed.load(sealed.seal(p), "int64", "bigint"), MANY_NULLS, SAME)
add("page_load_float", lambda p: sealed.load(sealed.seal(p), "float64", "double"), "l_extendedprice", SAME)
add("page_load_string", lambda p: sealed.load(sealed.seal(p), "string", "string"), "props", SAME, "events")
add("page_filter_eq", lambda p: sealed.filter_eq(sealed.seal(p), "int64", 3), LINENO, " select page_id, pos from p where v = 3")
add("page_filter_eq_wide", lambda p: sealed.filter_eq(sealed.seal(p), "int64", 103), PART, " select page_id, pos from p where v = 103")
add("page_filter_in", lambda p: sealed.filter_in(sealed.seal(p), "string", ["A", "R"]), "l_returnflag", " select page_id, pos from p where v in ('A', 'R')")
add("page_filter_nullable", lambda p: sealed.filter_in(sealed.seal(p), "int64", [2, 5]), NULLS, " select page_id, pos from p where v in (2, 5)")
add("page_filter_sparse", lambda p: sealed.filter_in(sealed.seal(p), "int64", [7, 11]), SPARSE, " select page_id, pos from p where v in (7, 11)")
add("page_sparse_scan", lambda p: sealed.exceptions(sealed.seal(p, options=_only("sparse")), "int64", "bigint"), RARE, " select page_id, pos, v from p where v <> 7")
add("page_value_at", lambda p: sealed.values_at(sealed.seal(p), "int64", "bigint", 100), MANY_NULLS, " select page_id, pos, v from p where pos = 100")
add("page_value_at_sparse", lambda p: sealed.values_at(sealed.seal(p), "int64", "bigint", 33), SPARSE, " select page_id, pos, v from p where pos = 33")
add("page_value_at_string", lambda p: sealed.values_at(sealed.seal(p), "string", "string", 5), "props", " select page_id, pos, v from p where pos = 5", "events")
add("page_bounds", lambda p: sealed.seal(p).select("page_id", "ptype", "n_rows", "null_count", "min_v", "max_v"), NULLS, " select page_id, 'int64' as ptype, count(*) as n_rows, count(*) filter (v is null) as null_count, min(v) as min_v, max(v) as max_v from p group by page_id")
add("page_header_scan", lambda p: sealed.headers(sealed.seal(p)).select("page_id", "version", "ptype", "n_rows"), PART, " select page_id, 1::bigint as version, 'int64' as ptype, count(*) as n_rows from p group by page_id")
add("page_load_prefix", lambda p: sealed.load_prefixes(sealed.join_blobs(sealed.seal(p), sealed.seal(p)), ["int64", "int64"]).select("page_id", "part", "row_count"), PART, ", c as (select page_id, count(*) as row_count from p group by page_id) select page_id, part::bigint as part, row_count from c, (values (0), (1)) t(part)")
add("read_limits", lambda p: sealed.check(sealed.seal(p), "int64", nodes.Limits(max_length=10)).select("page_id", F.col("error").isNotNull().alias("refused")), PART, " select page_id, count(*) > 10 as refused from p group by page_id")
add("decoded_bytes", lambda p: sealed.seal(p).select("page_id", "decoded_bytes"), PART, " select page_id, 16 * count(*) as decoded_bytes from p group by page_id")
add("roundtrip_fsst", lambda p: sealed.load(sealed.seal(p, options=_only("fsst")), "string", "string"), "text", SAME, "documents")
add("choose_scheme", lambda p: sealed.seal(p).select("page_id", "root_codec", "tree", "encoded_bytes"), LINENO, _FRAME + " select page_id, 'for' as root_codec, 'for(bitpack)' as tree, (57 + (n * rw + 7) // 8)::bigint as encoded_bytes from s")
add("explain_selection", report.explain_selection, "l_extendedprice", None)
add("sample_rows", report.sample_rows, PART, f""", st(i, r) as (values {_OFFSETS}), w as (select *, count(*) over (partition by page_id) as n from p),
l as (select distinct page_id, n from w), o as (select page_id, n, i * (n // 16) + least(i, n % 16) as low, n // 16 + (case when i < n % 16 then 1 else 0 end) as size, r from l, st),
x as (select page_id, low + r % (size - least(size, 64) + 1) as s, least(size, 64) as take from o where n > 1024)
select page_id, pos, v from w where n <= 1024 union all select w.page_id, pos, v from w join x on w.page_id = x.page_id and pos >= s and pos < s + take""")
add("sampled_ratio", lambda p: report.explain_selection(p).where("kind = 'sample'").select("page_id", "codec", "bytes", "ratio"), "l_extendedprice", None)
QUERIES["ptype_map"] = lambda spark, sf_dir: report.ptype_map(spark)
ORACLES["ptype_map"] = "select * from (values " + ", ".join(f"({k}::int, '{n}', {w}::int, '{ptype_class(n)}')" for k, (n, w) in PTYPES.items()) + ") t(code, name, width, class)"
QUERIES["compression_report"] = compression_report


def _only(codec: str):
    """Options that leave a root no choice but this codec (or a constant, or raw)."""
    from ..wire.planner import Options

    return Options(exclude=frozenset({"dict", "runend", "sparse", "for", "delta", "zigzag", "bitpack", "sequence"} - {codec}))
