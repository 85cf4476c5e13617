"""Profiles, key search and semantic types."""

from itertools import combinations

from pyspark.sql import functions as F

from tidewright.functions.domains import DOMAINS
from tidewright.profiling import columns as pc
from tidewright.profiling.domains import infer_domains, registry_frame, value_scores
from tidewright.profiling.keys import key_candidates, promote_key
from tidewright.profiling.suggest import suggested_checks
from tidewright.quality.suite import run_suite
from tidewright.queries import query


def _numeric_sql(table: str, c: str) -> str:
    skew = f"""(avg(x ** 3) - 3 * avg(x) * avg(x ** 2) + 2 * avg(x) ** 3)
        / nullif(power(var_pop(x), 1.5), 0)"""
    return f"""select '{c}' as column_name, count(*) as row_count, count(x) as non_null,
        round(count(x) / count(*), 6) as completeness, count(distinct x) as distinct_count,
        min(x)::double as minimum, max(x)::double as maximum, round(avg(x), 4) as mean,
        round(stddev_samp(x), 4) as stddev, round(round({skew}, 4), 2) as skewness,
        round(round(kurtosis_pop(x), 4), 2) as kurtosis, quantile_cont(x, 0.25) as p25,
        quantile_cont(x, 0.5) as p50, null::bigint as min_length, null::bigint as max_length,
        null::bigint as mean_length, null::double as median_length
      from (select {c}::double x from {table})"""


def _text_sql(table: str, c: str) -> str:
    return f"""select '{c}', count(*), count({c}), round(count({c}) / count(*), 6),
        count(distinct {c}), null, null, null, null, null, null, null, null, min(length({c})),
        max(length({c})), round(avg(length({c})))::bigint, quantile_cont(length({c}), 0.5)
      from {table}"""


PROFILE_SQL = " union all ".join(
    [
        *[_numeric_sql("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_tax")],
        _text_sql("(select case when l_linenumber < 3 then l_returnflag end as l_returnflag "
                  "from lineitem)", "l_returnflag"),
    ]
)


def _profiled(t):
    flag = F.when(F.col("l_linenumber") < 3, F.col("l_returnflag"))
    return t.lineitem.select(
        "l_quantity", "l_extendedprice", "l_tax", flag.alias("l_returnflag")
    )


@query("profile_table", "PRF-01 AGG-04 AGG-06 AGG-08", PROFILE_SQL)
def profile_table(t):
    found = pc.profile_columns(_profiled(t), exact=True)
    shown = {c: F.round(c, 4) for c in ("mean", "stddev")}
    shown |= {c: F.round(c, 2) for c in ("skewness", "kurtosis")}
    shown["completeness"] = F.round("completeness", 6)
    return found.withColumns(shown).select(
        "column_name", "row_count", "non_null", "completeness", "distinct_count", "minimum",
        "maximum", "mean", "stddev", "skewness", "kurtosis", "p25", "p50", "min_length",
        "max_length", "mean_length", "median_length",
    )


@query("profile_table_sketched", "PRF-01 AGG-05 AGG-07")
def profile_table_sketched(t):
    return pc.profile_columns(t.lineitem)


def _topk_sql(table: str, columns: list[str]) -> str:
    parts = " union all ".join(
        f"select '{c}' as column_name, cast({c} as varchar) as value, count(*) as row_count, "
        f"(select count({c}) from {table}) as total, "
        f"(select count(distinct {c}) from {table}) as d "
        f"from {table} where {c} is not null group by 2"
        for c in columns
    )
    return f"""select column_name, value, row_count, ((row_count * 20000 + total) // (2 * total)) / 10000.0::double as fraction, rank
      from (select *, row_number() over (partition by column_name
              order by row_count desc, value) as rank from ({parts}))
      where rank <= case when d <= 50 then 50 else 20 end"""


@query("profile_topk", "TOP-01", _topk_sql("part", ["p_brand", "p_type", "p_size", "p_name"]))
def profile_topk(t):
    found = pc.frequent_values(t.part, ["p_brand", "p_type", "p_size", "p_name"])
    return found.select("column_name", "value", "row_count", "fraction", "rank")


def _shape_sql(c: str) -> str:
    return rf"""regexp_replace(regexp_replace(regexp_replace({c}, '\p{{Lu}}', 'A', 'g'),
        '\p{{Ll}}', 'a', 'g'), '\p{{Nd}}', 'N', 'g')"""


def _short_sql(c: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace({c}, 'A{{3,}}', 'A+', 'g'), "
        f"'a{{3,}}', 'a+', 'g'), 'N{{3,}}', 'N+', 'g')"
    )


def _pattern_sql(table: str, c: str) -> str:
    return f"""select '{c}' as column_name,
        case when pn / n >= 0.8 then p when sn / n >= 0.6 then s end as pattern,
        round(case when pn / n >= 0.8 then pn / n else sn / n end, 4) as share
      from (select count({c}) n from {table}),
        (select {_shape_sql(c)} p, count(*) pn from {table} where {c} is not null
          group by 1 order by 2 desc, 1 limit 1),
        (select {_short_sql(_shape_sql(c))} s, count(*) sn from {table} where {c} is not null
          group by 1 order by 2 desc, 1 limit 1)"""


@query(
    "profile_patterns",
    "PRF-02",
    " union all ".join(
        f"select * from ({_pattern_sql(table, c)})"
        for table, c in (
            ("part", "p_brand"),
            ("part", "p_name"),
            ("part", "p_type"),
            ("customer", "c_name"),
            ("customer", "c_mktsegment"),
        )
    ),
)
def profile_patterns(t):
    return pc.patterns(t.part, ["p_brand", "p_name", "p_type"]).unionAll(
        pc.patterns(t.customer, ["c_name", "c_mktsegment"])
    )


@query(
    "pattern_conformance",
    "PRF-03",
    """select 'c_name' as column_name, 'Aaaaaaaa#NNNNNNNNN' as pattern, count(*) as non_null,
         count(*) as matching, 1.0 as share from customer
       union all select 'c_mktsegment', 'A+', count(*),
         count(*) filter (where regexp_full_match(c_mktsegment, '[A-Z]+')),
         round(count(*) filter (where regexp_full_match(c_mktsegment, '[A-Z]+')) / count(*), 6)
       from customer""",
)
def pattern_conformance(t):
    return pc.conformance(t.customer, {"c_name": "Aaaaaaaa#NNNNNNNNN", "c_mktsegment": "A+"})


@query("sample_values", "TOP-02")
def sample_values(t):
    return pc.sample_values(t.part, ["p_name", "p_brand"])


@query(
    "sample_values_ordered",
    "TOP-02 TOP-03",
    """select p_brand, p_partkey from (select *, row_number() over (partition by p_brand
         order by p_partkey) rn from part) where rn <= 3""",
)
def sample_values_ordered(t):
    from tidewright.operators.ranking import top_n

    rows = t.part.select("p_brand", "p_partkey")
    return top_n(rows, ["p_brand"], [F.col("p_partkey").asc()], 3)


def _key_rows(t):
    """Orders without their own key for every second row, so that keys have two columns."""
    doubled = t.orders.withColumn("copy", F.lit(0)).unionByName(
        t.orders.withColumn("copy", F.lit(1)).withColumn("o_totalprice", F.lit(1.0))
    )
    return doubled.select("o_orderkey", "copy", "o_orderstatus")


@query(
    "key_candidates",
    "PRF-04 PRF-05",
    """with n as (select count(*) * 2 c, count(distinct o_orderkey) k,
                         count(distinct o_orderstatus) s from orders)
       select 'o_orderkey' as columns, 1 as width, k as distinct_count, true as verified,
              false as is_unique, false as minimal from n
       union all select 'copy', 1, 2, true, false, false
       union all select 'o_orderstatus', 1, s, true, false, false from n
       union all select 'o_orderkey,copy', 2, c, true, true, true from n
       union all select 'copy,o_orderstatus', 2, null, true, false, false from n
       union all select 'o_orderkey,o_orderstatus', 2, k, true, false, false from n""",
)
def key_candidates_query(t):
    found = key_candidates(_key_rows(t), max_width=3, exact_counts=True)
    return found.select("columns", "width", "distinct_count", "verified", "is_unique", "minimal")


@query(
    "profile_float_distinct",
    "AGG-05",
    " union all ".join(
        f"select '{c}' as column_name, count(distinct {c}) as distinct_count, count(*) as row_count from lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def profile_float_distinct(t):
    """Floating columns of a sketched profile: their distinct values are counted."""
    found = pc.profile_columns(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return found.select("column_name", "distinct_count", "row_count")


LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()
_SETS = [s for w in (1, 2, 3) for s in combinations(LINEITEM, w)]


@query(
    "key_search",
    "PRF-04 PRF-05",
    "with n as (select count(*) as n from lineitem), sets as ("
    + " union all ".join(
        f"select '{','.join(s)}' as columns, {len(s)} as width, {list(s)!r} as members, (select count(*) from (select distinct {', '.join(s)} from lineitem)) as d"
        for s in _SETS
    )
    + """), keys as (select sets.* from sets, n where d = n)
       select k.columns, k.width, k.d as distinct_count, true as verified, true as minimal from keys k
       where not exists (select 1 from keys s where s.width < k.width and list_has_all(k.members, s.members))""",
)
def key_search(t):
    """Every minimal key of up to three of all columns of lineitem."""
    found = key_candidates(t.lineitem, max_width=3, count_repeated=False).filter("is_unique")
    return found.select("columns", "width", "distinct_count", "verified", "minimal")


@query(
    "key_promotion",
    "PRF-06",
    "select true as any_fit, true as promoted, 'c_custkey' as columns, 'clear lead' as reason",
)
def key_promotion(t):
    rows = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return promote_key(key_candidates(rows, max_width=2))


@query(
    "suite_from_profile",
    "DS-06 PRF-03",
    """with a as (select * from lineitem where l_orderkey % 2 = 0),
            b as (select * from lineitem where l_orderkey % 2 = 1)
       select 'column_values_to_not_be_null:l_quantity' as check_id, 'passed' as status
       union all select 'table_column_count_to_equal', 'passed'
       union all select 'column_values_to_not_be_null:l_returnflag', 'passed'
       union all select 'column_values_to_be_in_set:l_returnflag', case when (select count(*) from b
           where l_returnflag not in (select l_returnflag from a)) = 0 then 'passed' else 'failed' end
       union all select 'column_value_lengths_to_be_between:l_returnflag', 'passed'
       union all select 'column_values_to_match_regex:l_returnflag', 'passed'
       union all select 'column_values_to_be_between:l_quantity', case when (select count(*) from b
           where l_quantity < (select min(l_quantity) - (max(l_quantity) - min(l_quantity)) * 0.1 from a)
              or l_quantity > (select max(l_quantity) + (max(l_quantity) - min(l_quantity)) * 0.1 from a))
           = 0 then 'passed' else 'failed' end
       union all select 'column_quantile_values_to_be_between:l_quantity', 'passed'
       union all select 'column_skewness_to_be_between:l_quantity', 'passed'""",
)
def suite_from_profile(t):
    rows = t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag")
    early = rows.filter("l_orderkey % 2 = 0").drop("l_orderkey")
    later = rows.filter("l_orderkey % 2 = 1").drop("l_orderkey")
    checks = suggested_checks(
        pc.profile_columns(early),
        pc.frequent_values(early, ["l_returnflag"]),
        pc.patterns(early),
    )
    return run_suite(later, checks).select("check_id", "status")


@query(
    "profile_embeddings",
    "PRF-07 EMB-06",
    """select 'embedding' as column_name, 0 as null_count, min(len(embedding)) as min_size,
         max(len(embedding)) as max_size from embeddings""",
)
def profile_embeddings(t):
    return pc.embedding_facts(t.embeddings, "embedding")


@query(
    "corpus_advisories",
    "EMB-06",
    """select 'key_present' as advisory, true as ok, '0' as observed
       union all select 'one_size', min(len(embedding)) = max(len(embedding)),
         min(len(embedding)) || '-' || max(len(embedding)) from embeddings
       union all select 'multiple_of_16', max(len(embedding)) % 16 = 0,
         cast(max(len(embedding)) as varchar) from embeddings""",
)
def corpus_advisories(t):
    return pc.corpus_advisories(t.embeddings, "embedding", ["vec_id"])


SAMPLED_DOMAINS = ("us_state_code", "zip_code", "claim_number", "person_first_name", "yes_no_flag")


def _domain_rows(t):
    return t.customer.select(
        F.lpad((F.col("c_custkey") * 7 % 100000).cast("string"), 5, "0").alias("postal_code"),
        F.when(F.col("c_custkey") % 10 < 8, "CA").otherwise("n/a").alias("mbr_st"),
        F.col("c_mktsegment").alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 2 == 0, "Y").otherwise("N").alias("active_ind"),
    )


VALUES_SQL = """with r as (select lpad(cast(c_custkey * 7 % 100000 as varchar), 5, '0') postal_code,
      case when c_custkey % 10 < 8 then 'CA' else 'n/a' end mbr_st, c_mktsegment,
      case when c_custkey % 2 = 0 then 'Y' else 'N' end active_ind from customer) """


@query(
    "domain_scores",
    "DOM-01",
    VALUES_SQL
    + " union all ".join(
        f"""select '{c}' as column_name, '{d.name}' as domain, count({c}) as non_null,
            count(*) filter (where regexp_matches({c}, '{d.sample}')) as matching,
            round(count(*) filter (where regexp_matches({c}, '{d.sample}')) / count({c}), 6) as share
            from r"""
        for c in ("postal_code", "mbr_st", "c_mktsegment", "active_ind")
        for d in DOMAINS
        if d.name in SAMPLED_DOMAINS
    ),
)
def domain_scores(t):
    chosen = [d for d in DOMAINS if d.name in SAMPLED_DOMAINS]
    columns = ["postal_code", "mbr_st", "c_mktsegment", "active_ind"]
    return value_scores(_domain_rows(t), columns, chosen)


@query(
    "domain_inference",
    "DOM-01 DOM-02",
    """select 'postal_code' as column_name, 'zip_code' as domain, 1.0::double as confidence
       union all select 'mbr_st', 'us_state_code', 1.0
       union all select 'active_ind', 'yes_no_flag', 1.0""",
)
def domain_inference(t):
    rows = _domain_rows(t).drop("c_mktsegment")
    found = infer_domains(rows, rows.columns, {"mbr_st": "The member state"})
    return found.select("column_name", "domain", "confidence")


@query(
    "domain_registry",
    "DOM-04",
    """select 'gender' as domain, count(*) filter (where c_mktsegment in ('M', 'F', 'U', 'N'))
           as matching_rows from customer
       union all select 'us_state_code', 0
       union all select 'load_mode', 0""",
)
def domain_registry(t):
    """Registered value sets beside the values a column holds."""
    registry = registry_frame(t.spark).filter(
        F.col("domain").isin("gender", "us_state_code", "load_mode")
    )
    listed = registry.select("domain", F.explode(F.split("value_set", ",")).alias("v"))
    counts = t.customer.groupBy(F.col("c_mktsegment").alias("v")).agg(F.count("*").alias("n"))
    return (
        listed.join(counts, "v", "left")
        .groupBy("domain")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matching_rows"))
    )
