"""Queries over the company, people and lead tables: scans, joins, counts, state changes, exports."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell import dims
from siftwell.operators import reports, state
from siftwell.operators.dedupe import first_n, first_wins, merge_people, numbered
from siftwell.plans.base import query, table

COMPANIES = """companies as (select n_nationkey::bigint as seq, 'n' || n_nationkey || '.example.com' as domain, r_name as industry, n_name as country, case n_nationkey % 3 when 0 then 'lsp' when 1 then 'client' else '' end as company_type,
  case n_nationkey % 5 when 0 then 'qualified' when 1 then 'rejected' when 2 then 'failed' when 3 then 'qualified' else 'discovered' end as status, (n_nationkey * 7 % 90)::int as score,
  case when n_nationkey % 2 = 0 then 'done' end as people_searched_at from nation join region on n_regionkey = r_regionkey)"""
PEOPLE = """people as (select c_custkey as seq, 'n' || c_nationkey || '.example.com' as domain, c_name as full_name, lower(c_mktsegment) as title, case when c_acctbal < 3000 then 'done' end as email_searched_at, c_acctbal,
  case when c_custkey % 3 = 0 then 'https://www.linkedin.com/in/P' || (c_custkey % 100) || '/' else '' end as linkedin_url from customer)"""
LEADS = """leads as (select c_custkey as seq, lower(replace(c_name, '#', '.')) || '@' || case when c_custkey % 7 = 0 then 'gmail.com' else 'n' || c_nationkey || '.example.com' end as email, case when c_custkey % 4 = 0 then '' else c_name end as full_name,
  '' as first_name, c_name as last_name, case when c_custkey % 5 = 0 then '' else 'n' || c_nationkey || '.example.com' end as domain, case c_custkey % 3 when 0 then 'Site ✓' when 1 then 'EFmt ~' else 'Other' end as email_source from customer where c_acctbal > 2000)"""


def companies(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    k = F.col("n_nationkey")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(
        k.cast("long").alias("seq"), F.concat(F.lit("n"), k, F.lit(".example.com")).alias("domain"), F.col("r_name").alias("industry"), F.col("n_name").alias("country"),
        F.when(k % 3 == 0, "lsp").when(k % 3 == 1, "client").otherwise("").alias("company_type"),
        F.when(k % 5 == 0, "qualified").when(k % 5 == 1, "rejected").when(k % 5 == 2, "failed").when(k % 5 == 3, "qualified").otherwise("discovered").alias("status"),
        (k * 7 % 90).cast("int").alias("score"), F.when(k % 2 == 0, "done").alias("people_searched_at"),
    )


def people(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("seq"), F.concat(F.lit("n"), "c_nationkey", F.lit(".example.com")).alias("domain"), F.col("c_name").alias("full_name"), F.lower("c_mktsegment").alias("title"),
        F.when(F.col("c_acctbal") < 3000, "done").alias("email_searched_at"), "c_acctbal",
        F.when(k % 3 == 0, F.concat(F.lit("https://www.linkedin.com/in/P"), k % 100, F.lit("/"))).otherwise("").alias("linkedin_url"),
    )


def leads(spark, sf):
    k, host = F.col("c_custkey"), F.concat(F.lit("n"), F.col("c_nationkey"), F.lit(".example.com"))
    return table(spark, sf, "customer").where("c_acctbal > 2000").select(
        k.alias("seq"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), F.when(k % 7 == 0, "gmail.com").otherwise(host)).alias("email"),
        F.when(k % 4 == 0, "").otherwise(F.col("c_name")).alias("full_name"), F.lit("").alias("first_name"), F.col("c_name").alias("last_name"),
        F.when(k % 5 == 0, "").otherwise(host).alias("domain"), F.when(k % 3 == 0, "Site ✓").when(k % 3 == 1, "EFmt ~").otherwise("Other").alias("email_source"),
    )


@query("a01_scan_domains", f"with {COMPANIES} select seq, domain, score from companies where status = 'qualified' and people_searched_at is null and industry = 'EUROPE'")
def _(spark, sf):
    return reports.browse(companies(spark, sf), {"status": "qualified", "industry": "EUROPE"}).where("people_searched_at is null").select("seq", "domain", "score")


@query("a02_people_with_company_type", f"with {COMPANIES}, {PEOPLE} select p.seq, p.domain, full_name, company_type from people p join companies c using (domain) where industry = 'EUROPE'")
def _(spark, sf):
    c = companies(spark, sf).where("industry = 'EUROPE'").select("domain", "company_type")
    return people(spark, sf).join(c, "domain").select("seq", "domain", "full_name", "company_type")


@query("a03_people_todo", f"with {COMPANIES}, {PEOPLE} select p.seq, p.domain from people p join companies c using (domain) where email_searched_at is null and country = 'NATION_3'")
def _(spark, sf):
    c = companies(spark, sf).where("country = 'NATION_3'").select("domain")
    return people(spark, sf).where("email_searched_at is null").join(c, "domain", "left_semi").orderBy("seq").select("seq", "domain")


@query("a04_leads_of_companies", f"with {COMPANIES}, {LEADS} select seq, email from leads where domain in (select domain from companies where industry = 'AFRICA')")
def _(spark, sf):
    return leads(spark, sf).join(companies(spark, sf).where("industry = 'AFRICA'"), "domain", "left_semi").select("seq", "email")


_FREE = ", ".join(f"'{d}'" for d in dims.FREE_EMAIL_DOMAINS)


@query("a05_leads_for_export", f"with {LEADS} select seq, email, coalesce(nullif(full_name, ''), trim(first_name || ' ' || last_name)) as full_name, coalesce(nullif(domain, ''), string_split(email, '@')[2]) as domain from leads where string_split(email, '@')[2] not in ({_FREE})")
def _(spark, sf):
    host = F.get(F.split("email", "@"), F.lit(1))
    out = leads(spark, sf).where(~host.isin(dims.FREE_EMAIL_DOMAINS))
    return out.select("seq", "email", F.coalesce(F.nullif("full_name", F.lit("")), F.trim(F.concat("first_name", F.lit(" "), "last_name"))).alias("full_name"), F.coalesce(F.nullif("domain", F.lit("")), host).alias("domain"))


@query("a06_name_sets", f"with {COMPANIES}, {PEOPLE} select domain from companies union select domain from people")
def _(spark, sf):
    return companies(spark, sf).select("domain").union(people(spark, sf).select("domain")).distinct()


@query("a12_insert_or_ignore", f"with {PEOPLE}, t as (select * from people where c_acctbal < 0) select arg_min(seq, seq) as seq, domain, title from people where (domain, title) not in (select (domain, title) from t) group by domain, title")
def _(spark, sf):
    p = people(spark, sf)
    return state.insert_ignore(p.where("c_acctbal < 0"), p, ["domain", "title"], ["seq"]).select("seq", "domain", "title")


def all_sheets(spark, sf):
    c = companies(spark, sf)
    return reports.sheets(c, people(spark, sf), leads(spark, sf), c.where("status = 'failed'").select("domain"))


@query("a13_export_sheets", f"with {COMPANIES}, {PEOPLE}, {LEADS} select status as name, count(*) as n from companies group by 1 union all select 'unreachable', 0 union all select 'people', count(*) from people union all select 'leads', count(*) from leads union all select 'blocked', count(*) from companies where status = 'failed'")
def _(spark, sf):
    return all_sheets(spark, sf)["summary"]


@query("a13_export_rows", f"with {COMPANIES}, {PEOPLE}, {LEADS} select status as sheet, domain as what from companies union all select 'people', full_name || '|' || upper(coalesce(company_type, '')) from people left join companies using (domain) union all select 'leads', email from leads union all select 'blocked', domain from companies where status = 'failed'")
def _(spark, sf):
    s = all_sheets(spark, sf)
    what = lambda name: F.concat("full_name", F.lit("|"), "company_type") if name == "people" else F.col("email" if name == "leads" else "domain")
    return functools.reduce(DataFrame.union, [df.select(F.lit(name).alias("sheet"), what(name).alias("what")) for name, df in s.items() if name != "summary"])


def run_sheets(spark, sf):
    c, p, k = companies(spark, sf), people(spark, sf), F.col("score")
    kept = c.where("status = 'qualified'").select("seq", "domain", F.col("country").alias("company_name"), F.when(k > 40, "strong").alias("tier"), "score", F.lit("").alias("linkedin_url"), "country", F.when(k > 20, F.array(F.lit("has contact page"), F.concat(F.lit("score "), k))).alias("reasons"))
    gone = c.where("status <> 'qualified'").select("seq", "domain", F.col("status").alias("reason"), F.when(k > 40, "a detail").otherwise("").alias("detail"), F.lit("a message").alias("message"))
    who = p.join(c.select("domain", "company_type", F.col("country").alias("company_name")), "domain", "left")
    mail = leads(spark, sf).withColumns({"title": F.lit(None).cast("string"), "company": F.col("domain"), "linkedin_url": F.lit("")})
    return reports.run_sheets(kept, gone, who, mail)


@query("a14_run_export", f"with {COMPANIES} select row_number() over (order by score desc, seq) as row_no, domain, country as company_name, case when score > 40 then 'strong' else '' end as tier, score, country, case when score > 20 then 'has contact page, score ' || score else '' end as signals from companies where status = 'qualified'")
def _(spark, sf):
    return run_sheets(spark, sf)["qualified"].drop("linkedin_url")


@query("a14_not_kept", f"with {COMPANIES} select row_number() over (order by seq) as row_no, domain, status as reason, case when score > 40 then 'a detail' else 'a message' end as detail from companies where status <> 'qualified'")
def _(spark, sf):
    return run_sheets(spark, sf)["not_kept"]


@query("a14_run_people", f"with {COMPANIES}, {PEOPLE} select row_number() over (order by p.seq) as row_no, full_name, title, coalesce(country, '') as company_name, domain, coalesce(nullif(upper(company_type), ''), '—') as type, linkedin_url from people p left join companies using (domain)")
def _(spark, sf):
    return run_sheets(spark, sf)["people"]


@query("a14_run_leads", f"with {LEADS} select row_number() over (order by seq) as row_no, full_name, '' as title, domain as company, email, email_source, domain, '' as linkedin_url from leads")
def _(spark, sf):
    return run_sheets(spark, sf)["leads"]


@query("a15_display_format", "select o_orderkey, replace(substr(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 1, 16), 'T', '  ') as stamp, coalesce(nullif(case when o_orderstatus = 'P' then '' else o_orderstatus end, ''), '—') as status, 'https://' || lower(o_orderpriority) as link from orders")
def _(spark, sf):
    ts = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "orders").select("o_orderkey", reports.pretty(ts).alias("stamp"), reports.dash(F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))).alias("status"), reports.with_scheme(F.lower("o_orderpriority")).alias("link"))


@query("b42_source_family", f"with {LEADS} select seq, upper(email_source) as label, case when contains(email_source, 'Site') then 'Site' when contains(email_source, 'EFmt') then 'EFmt' else 'Other' end as family from leads")
def _(spark, sf):
    from siftwell.functions.contacts import source_family

    return leads(spark, sf).select("seq", F.upper("email_source").alias("label"), source_family(F.col("email_source")).alias("family"))


@query("c20_browse_filters", f"with {PEOPLE} select seq, domain, full_name from people where title = 'building' and (contains(lower(domain), '1.ex') or contains(lower(full_name), '1.ex'))")
def _(spark, sf):
    return reports.browse(people(spark, sf), {"title": "building"}, "1.EX", ["domain", "full_name"]).select("seq", "domain", "full_name")


@query("f01_people_join_domains", f"with {COMPANIES}, {PEOPLE} select p.seq, c.country, c.industry from people p join companies c using (domain) where c.status = 'qualified'")
def _(spark, sf):
    return people(spark, sf).join(companies(spark, sf).where("status = 'qualified'").select("domain", "country", "industry"), "domain").select("seq", "country", "industry")


@query("f02_people_left_join_types", f"with {COMPANIES}, {PEOPLE} select p.seq, coalesce(c.company_type, '') as company_type from people p left join (select * from companies where status <> 'failed') c using (domain)")
def _(spark, sf):
    c = companies(spark, sf).where("status <> 'failed'").select("domain", "company_type")
    return people(spark, sf).join(c, "domain", "left").select("seq", F.coalesce("company_type", F.lit("")).alias("company_type"))


@query("f03_leads_semi_join", f"with {COMPANIES}, {LEADS} select seq from leads where domain in (select domain from companies where country in ('NATION_1', 'NATION_2'))")
def _(spark, sf):
    return leads(spark, sf).join(companies(spark, sf).where("country in ('NATION_1', 'NATION_2')"), "domain", "left_semi").select("seq")


@query("f04_people_anti_join", f"with {COMPANIES}, {PEOPLE} select seq, domain in (select domain from companies where status in ('failed', 'rejected')) as duplicate from people")
def _(spark, sf):
    known = companies(spark, sf).where("status in ('failed', 'rejected')").select("domain").withColumn("hit", F.lit(True))
    return people(spark, sf).join(known, "domain", "left").select("seq", F.col("hit").isNotNull().alias("duplicate"))


@query("f10_distinct_countries_of_people", f"with {COMPANIES}, {PEOPLE} select distinct country, industry from people join companies using (domain)")
def _(spark, sf):
    return people(spark, sf).join(companies(spark, sf), "domain").select("country", "industry").distinct().orderBy("country")


@query("f11_lookup_join", f"with {COMPANIES}, o as (select o_orderkey, c_nationkey from orders join customer on o_custkey = c_custkey) select o_orderkey, country from o join companies on domain = 'n' || c_nationkey || '.example.com'")
def _(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.withColumn("domain", F.concat(F.lit("n"), "c_nationkey", F.lit(".example.com"))).join(companies(spark, sf).select("domain", "country"), "domain").select("o_orderkey", "country")


_PKEY = "case when linkedin_url <> '' then 'u:' || rtrim(lower(linkedin_url), '/') else 'n:' || domain || '|' || lower(title) end"


@query("g04_merge_people", f"with {PEOPLE} select min(seq) as seq from people group by {_PKEY}")
def _(spark, sf):
    p = people(spark, sf).withColumn("full_name", F.col("title")).withColumn("source_rank", F.lit(0))
    return merge_people(p).select("seq")


@query("g05_people_by_domain_name", f"with {PEOPLE} select domain, title, min(seq) as seq from people group by 1, 2")
def _(spark, sf):
    return first_wins(people(spark, sf).select("domain", "title", "seq"), ["domain", "title"], ["seq"])


@query("g06_unique_leads", f"with {LEADS} select string_split(email, '@')[2] as host, min(email) as email from leads group by 1")
def _(spark, sf):
    l = leads(spark, sf).select("email", F.get(F.split("email", "@"), F.lit(1)).alias("host"))  # noqa: E741
    return first_wins(l, ["host"], ["email"]).select("host", "email")


@query("g08_distinct_values", f"with {LEADS} select distinct domain from leads where trim(domain) <> ''")
def _(spark, sf):
    return reports.distinct_values(leads(spark, sf), "domain")


@query("h01_status_counts", "select s.status, count(o.o_orderkey) as n from (values ('F'), ('O'), ('P'), ('X')) s(status) left join orders o on o.o_orderstatus = s.status group by 1")
def _(spark, sf):
    return reports.status_counts(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("h02_counts_by_industry", f"with {COMPANIES} select coalesce(nullif(trim(company_type), ''), '(all)') as company_type, count(*) as n from companies group by 1")
def _(spark, sf):
    return reports.counts_by(companies(spark, sf), "company_type")


@query("h02_counts_by_country", "select coalesce(nullif(trim(n_name), ''), '(all)') as country, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def _(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.counts_by(c.withColumnRenamed("n_name", "country"), "country")


@query("h03_table_counts", "select 'customer' as name, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'pages', count(*) from pages")
def _(spark, sf):
    return reports.table_counts({t: table(spark, sf, t) for t in ("customer", "orders", "pages")})


@query("h04_queue_counts", f"with {COMPANIES} select count(*) filter (status = 'qualified') as qualified, count(*) filter (status = 'qualified' and people_searched_at is not null) as searched, count(*) filter (status = 'qualified' and people_searched_at is null) as queued from companies")
def _(spark, sf):
    q = F.col("status") == "qualified"
    return companies(spark, sf).agg(F.count_if(q).alias("qualified"), F.count_if(q & F.col("people_searched_at").isNotNull()).alias("searched"), F.count_if(q & F.col("people_searched_at").isNull()).alias("queued"))


@query("h05_funnel", f"with {PEOPLE}, {LEADS}, t as (select (select count(*) from people) as people, (select count(*) from people where email_searched_at is not null) as done, (select count(*) from leads) as leads) select people, done, leads, (case when people > 0 then round_even(100 * done / people, 0) else 0 end)::int as done_pct, (case when people > 0 then round_even(100 * leads / people, 0) else 0 end)::int as lead_pct from t")
def _(spark, sf):
    p = people(spark, sf).agg(F.count("*").alias("people"), F.count("email_searched_at").alias("done"))
    l = leads(spark, sf).agg(F.count("*").alias("leads"))  # noqa: E741
    t = p.join(l)
    return t.select("people", "done", "leads", reports.percent(F.col("done"), F.col("people")).alias("done_pct"), reports.percent(F.col("leads"), F.col("people")).alias("lead_pct"))


@query("h06_export_summary", f"with {COMPANIES}, {PEOPLE} select status as name, count(*) as n from companies group by 1 union all select 'people', count(*) from people")
def _(spark, sf):
    c = companies(spark, sf).groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n"))
    return c.unionByName(reports.table_counts({"people": people(spark, sf)}))


@query("h07_people_by_company_type", f"with {COMPANIES}, {PEOPLE} select count(*) filter (company_type = 'lsp') as lsp, count(*) filter (company_type = 'client') as client, count(*) filter (coalesce(company_type, '') = '') as unclassified from people left join companies using (domain)")
def _(spark, sf):
    j = people(spark, sf).join(companies(spark, sf).select("domain", "company_type"), "domain", "left")
    t = F.coalesce("company_type", F.lit(""))
    return j.agg(F.count_if(t == "lsp").alias("lsp"), F.count_if(t == "client").alias("client"), F.count_if(t == "").alias("unclassified"))


@query("h08_leads_by_source_family", f"with {LEADS} select case when contains(email_source, 'Site') then 'Site' when contains(email_source, 'EFmt') then 'EFmt' else 'Other' end as family, count(*) as n from leads group by 1")
def _(spark, sf):
    from siftwell.functions.contacts import source_family

    return leads(spark, sf).groupBy(source_family(F.col("email_source")).alias("family")).agg(F.count("*").alias("n"))


@query("h11_reset_counts", f"with {PEOPLE}, {LEADS} select 'people' as name, count(*) as removed, 0::bigint as rest from people union all select 'leads', count(*), 0 from leads")
def _(spark, sf):
    t = {"people": people(spark, sf), "leads": leads(spark, sf)}
    before = reports.table_counts(t).withColumnRenamed("n", "removed")
    return before.join(reports.table_counts({k: state.wiped(v) for k, v in t.items()}).withColumnRenamed("n", "rest"), "name")


@query("h12_people_search_rollup", f"with {PEOPLE} select domain, count(*) filter (linkedin_url <> '') as raw_profile, count(*) filter (linkedin_url = '') as raw_website, count(*) filter (title in ('building', 'machinery')) as after_filter from people group by 1")
def _(spark, sf):
    kind = F.when(F.col("linkedin_url") != "", "raw_profile").otherwise("raw_website")
    p = people(spark, sf).withColumn("kind", kind)
    raw = p.groupBy("domain").pivot("kind", ["raw_profile", "raw_website"]).agg(F.count(F.lit(1))).fillna(0)
    return raw.join(p.groupBy("domain").agg(F.count_if(F.col("title").isin("building", "machinery")).alias("after_filter")), "domain")


@query("i01_queue_order", f"with {COMPANIES} select domain, row_number() over (order by score desc, seq) as place from companies where status = 'qualified'")
def _(spark, sf):
    return numbered(companies(spark, sf).where("status = 'qualified'"), [F.desc("score"), "seq"], "place").select("domain", F.col("place").cast("long").alias("place"))


@query("i02_browse_order", f"with {PEOPLE} select seq, row_number() over (order by c_acctbal desc, seq desc) as place from people")
def _(spark, sf):
    return numbered(people(spark, sf), [F.desc("c_acctbal"), F.desc("seq")], "place").select("seq", F.col("place").cast("long").alias("place"))


@query("i04_first_ten_per_company", f"with {PEOPLE}, r as (select seq, domain, row_number() over (partition by domain order by seq) as rank from people) select * from r where rank <= 10")
def _(spark, sf):
    return first_n(people(spark, sf).select("seq", "domain"), ["domain"], ["seq"], 10, rank="rank").withColumn("rank", F.col("rank").cast("long"))


COLS = ["status", "score", "note"]
UPDATES = """updates as (select o_orderkey as seq, 'c' || o_custkey as domain, case o_orderstatus when 'F' then 'qualified' when 'O' then 'discovered' else 'rejected' end as status, (o_orderkey % 97)::int as score, case when o_orderkey % 4 = 0 then '' else o_orderpriority end as note,
  o_orderkey % 3 <> 0 as has_status, o_orderkey % 2 = 0 as has_score, o_orderkey % 5 <> 0 as has_note from orders)"""
STATE = """state as (select c_custkey as id, 'c' || c_custkey as domain, case when c_custkey % 6 = 0 then 'qualified' else 'discovered' end as status, 1 as score, c_mktsegment as note from customer where c_acctbal > 0)"""


def updates(spark, sf):
    k = F.col("o_orderkey")
    given = F.array_compact(F.array(F.when(k % 3 != 0, "status"), F.when(k % 2 == 0, "score"), F.when(k % 5 != 0, "note")))
    return table(spark, sf, "orders").select(
        k.alias("seq"), F.concat(F.lit("c"), "o_custkey").alias("domain"), F.when(F.col("o_orderstatus") == "F", "qualified").when(F.col("o_orderstatus") == "O", "discovered").otherwise("rejected").alias("status"),
        (k % 97).cast("int").alias("score"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("note"), given.alias("provided"),
    )


def stored(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), k).alias("domain"), F.when(k % 6 == 0, "qualified").otherwise("discovered").alias("status"), F.lit(1).alias("score"), F.col("c_mktsegment").alias("note"))


def _upsert_sql(source: str) -> str:
    fold = ", ".join(f"arg_max({c}, seq) filter (has_{c}) as {c}, bool_or(has_{c}) as has_{c}, count(*) filter (has_{c} and {c} is null) as null_{c}" for c in COLS)
    pick = ", ".join(f"case when u.has_{c} then u.{c} else t.{c} end as {c}" for c in COLS)
    return f"u as (select domain, {fold} from {source} group by 1) select coalesce(t.domain, u.domain) as domain, {pick} from state t full join u on t.domain = u.domain"


@query("j01_upsert", f"with {UPDATES}, {STATE}, {_upsert_sql('updates')}")
def _(spark, sf):
    return state.upsert(stored(spark, sf), updates(spark, sf), "domain", COLS)


@query("j02_batch_upsert_without_demotion", f"""with {UPDATES}, {STATE}, m as (select *, coalesce(max((has_status and status = 'qualified')::int) over (partition by domain order by seq rows between unbounded preceding and 1 preceding), 0) as earlier from updates),
kept as (select * from m where not has_status or status = 'qualified' or (earlier = 0 and domain not in (select domain from state where status = 'qualified'))), {_upsert_sql('kept')}""")
def _(spark, sf):
    t, u = stored(spark, sf), updates(spark, sf)
    return state.upsert(t, state.without_demotions(t, u, "domain"), "domain", COLS)


@query("j03_merge_keeping_best", f"with {UPDATES}, {STATE}, l as (select domain, arg_max(status, seq) as status, max(score) as score, arg_max(note, seq) as note from updates group by 1) select t.domain, case when t.status = 'qualified' then t.status else coalesce(nullif(l.status, ''), t.status) end as status, greatest(t.score, l.score) as score, coalesce(nullif(l.note, ''), t.note) as note from state t join l using (domain)")
def _(spark, sf):
    last = updates(spark, sf).groupBy("domain").agg(F.max_by("status", "seq").alias("s"), F.max("score").alias("p"), F.max_by("note", "seq").alias("n"))
    j = stored(spark, sf).join(last, "domain")
    best = state.merge_keeping_best
    return j.select("domain", best(F.col("status"), F.col("s"), "status").alias("status"), best(F.col("score"), F.col("p"), "score").alias("score"), best(F.col("note"), F.col("n"), "text").alias("note"))


@query("j04_demote", f"with {COMPANIES}, t as (select *, status = 'qualified' and contains('geo_fail:' || country, 'geo_fail:NATION_1') as hit from companies) select domain, case when hit then 'rejected' else status end as status, hit as demoted from t")
def _(spark, sf):
    c = companies(spark, sf).withColumn("score_reasons", F.array(F.lit("pages:1"), F.concat(F.lit("geo_fail:"), "country")))
    return state.demote(c, "geo_fail:NATION_1").select("domain", "status", "demoted")


@query("j05_stamp", f"with {PEOPLE} select seq, case when seq in (select o_custkey from orders) then 'now' else email_searched_at end as email_searched_at from people")
def _(spark, sf):
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("seq"))
    return state.stamp(people(spark, sf), done, "seq", "email_searched_at", F.lit("now")).select("seq", "email_searched_at")


@query("j06_reset_stamp", f"with {COMPANIES} select domain, case when status = 'qualified' and industry = 'ASIA' then null else people_searched_at end as people_searched_at, status = 'qualified' and industry = 'ASIA' and people_searched_at is not null as was_set from companies")
def _(spark, sf):
    scope = (F.col("status") == "qualified") & (F.col("industry") == "ASIA")
    return state.reset_stamp(companies(spark, sf), "people_searched_at", scope).select("domain", "people_searched_at", "was_set")


@query("j07_wipe", f"with {PEOPLE} select count(*) as n from people where false")
def _(spark, sf):
    return state.wiped(people(spark, sf)).agg(F.count("*").alias("n"))


@query("j09_exists", f"with {PEOPLE} select c_custkey, 'n' || c_nationkey || '.example.com' in (select domain from people where title = 'building') as known from customer")
def _(spark, sf):
    named = people(spark, sf).where("title = 'building'").select("domain").distinct().withColumn("hit", F.lit(True))
    c = table(spark, sf, "customer").withColumn("domain", F.concat(F.lit("n"), "c_nationkey", F.lit(".example.com")))
    return c.join(named, "domain", "left").select("c_custkey", F.col("hit").isNotNull().alias("known"))


@query("j10_schema_evolution", "select c_custkey as id, c_name as name, '' as comment, null::double as balance from customer union all select s_suppkey, s_name, 'new', s_acctbal from supplier")
def _(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("new").alias("comment"), F.col("s_acctbal").alias("balance"))
    return state.evolve(old, new)


@query("k07_resume_todo", f"with {PEOPLE}, d as (select seq from people where email_searched_at is null) select seq, coalesce(email_searched_at, 'stamped') as email_searched_at from people")
def _(spark, sf):
    p = people(spark, sf)
    return state.stamp(p, p.where("email_searched_at is null"), "seq", "email_searched_at", F.lit("stamped")).select("seq", "email_searched_at")


@query("m01_set_union", f"with {COMPANIES}, {LEADS} select domain from companies union select domain from leads where domain <> ''")
def _(spark, sf):
    return companies(spark, sf).select("domain").union(leads(spark, sf).where("domain <> ''").select("domain")).distinct()


@query("m02_word_intersection", "select page_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1)), '\\s+')), ['the', 'of', 'and', 'der', 'le']))::int as n from pages")
def _(spark, sf):
    words = F.array_distinct(F.split(F.lower(F.regexp_extract("html", r"<title[^>]*>(.*?)</title>", 1)), r"\s+"))
    return table(spark, sf, "pages").select("page_id", F.size(F.array_intersect(words, F.array(*map(F.lit, ["the", "of", "and", "der", "le"])))).alias("n"))


@query("o04_browse", f"with {COMPANIES}, {PEOPLE} select p.seq, p.full_name, coalesce(company_type, '') as company_type, country from people p left join companies c using (domain) where country = 'NATION_7' and contains(lower(full_name), '00001')")
def _(spark, sf):
    j = people(spark, sf).join(companies(spark, sf).select("domain", "company_type", "country"), "domain", "left")
    return reports.browse(j, {"country": "NATION_7"}, "00001", ["full_name"], [F.desc("seq")]).select("seq", "full_name", F.coalesce("company_type", F.lit("")).alias("company_type"), "country")


@query("o05_export_people_sheet", f"with {COMPANIES}, {PEOPLE} select p.seq, upper(coalesce(company_type, '')) as company_type from people p left join companies using (domain)")
def _(spark, sf):
    c = companies(spark, sf)
    return reports.sheets(c, people(spark, sf), leads(spark, sf), c.select("domain"), drop_empty=False)["people"].select("seq", "company_type")
