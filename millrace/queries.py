"""The registered queries of the engine, each with the SQL it must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import builder as b
from .engine import Engine
from .operators.durable import scratch
from .operators.validate import differences
from .runtime import Hooks
from .sources.introspect import model_of
from .sources.readers import read_parquet
from .streaming.refresh import ingest, refresh, refresh_slices, stale, windowed

TABLES = "region nation customer supplier part orders lineitem events".split()

#: The model over the driver's tables. lineitem has no natural key: its rows are a bag.
MODEL = """
key region.id int; property region.id.name string;
key nation.id int; property nation.id.name string;
key customer.id int; property customer.id.name string; property customer.id.acctbal float; property customer.id.segment string;
key supplier.id int; property supplier.id.name string; property supplier.id.acctbal float; key supplier.nation int;
key part.id int; property part.id.name string; property part.id.brand string; property part.id.type string; property part.id.size int; property part.id.price float;
key orders.id int; property orders.id.status string; property orders.id.total float; property orders.id.date datetime; property orders.id.priority string;
key line.row rowid; property line.row.number int; property line.row.quantity float; property line.row.price float; property line.row.discount float; property line.row.tax float; property line.row.flag string; property line.row.status string; property line.row.shipped datetime;
key event.id int; property event.id.ts datetime; property event.id.user int; property event.id.type string; property event.id.value float; property event.id.props string;
key doc.id int; property doc.id.lang string; property doc.id.source string; property doc.id.chars int; property doc.id.quality int; property doc.id.toxic int;
key vec.id int; property vec.id.embedding list<float>; property vec.id.label int;

datasource region (r_regionkey: region.id, r_name: region.name) grain (region.id) address region;
datasource nation (n_nationkey: nation.id, n_name: nation.name, n_regionkey: region.id) grain (nation.id) address nation;
datasource customer (c_custkey: customer.id, c_name: customer.name, c_nationkey: ~nation.id, c_acctbal: customer.acctbal, c_mktsegment: customer.segment) grain (customer.id) address customer;
datasource supplier (s_suppkey: supplier.id, s_name: supplier.name, s_nationkey: supplier.nation, s_acctbal: supplier.acctbal) grain (supplier.id) address supplier;
datasource part (p_partkey: part.id, p_name: part.name, p_brand: part.brand, p_type: part.type, p_size: part.size, p_retailprice: part.price) grain (part.id) address part;
datasource orders (o_orderkey: orders.id, o_custkey: ~customer.id, o_orderstatus: orders.status, o_totalprice: orders.total, o_orderdate: orders.date, o_orderpriority: orders.priority) grain (orders.id) address orders;
datasource lineitem (l_orderkey: ~orders.id, l_partkey: ~part.id, l_suppkey: ~supplier.id, l_linenumber: line.number, l_quantity: line.quantity, l_extendedprice: line.price, l_discount: line.discount, l_tax: line.tax, l_returnflag: line.flag, l_linestatus: line.status, l_shipdate: line.shipped) grain (line.row) address lineitem;
datasource events (event_id: event.id, ts: event.ts, user_id: event.user, event_type: event.type, value: event.value, props: event.props) grain (event.id) address events;
datasource documents (doc_id: doc.id, lang: doc.lang, source: doc.source, n_chars: doc.chars) grain (doc.id) address documents;
datasource labels (doc_id: ~doc.id, quality: doc.quality, toxic: doc.toxic) grain (doc.id) address labels;
datasource embeddings (vec_id: vec.id, embedding: vec.embedding, label: vec.label) grain (vec.id) address embeddings;

auto line.revenue <- line.price * (1 - line.discount);
metric revenue <- sum(line.revenue);
metric order_count <- count(orders.id);
metric line_count <- count(line.row);
"""

TEXTS: dict[str, str] = {}
ORACLES: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def add(name: str, text: str, sql: str) -> None:
    TEXTS[name], ORACLES[name] = text, sql
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).query(text)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, tables=sf_dir)
    e.run(MODEL)
    return e


add(
    "q1_pricing",
    """where line.shipped <= '1998-09-02'::datetime
    select line.flag as l_returnflag, line.status as l_linestatus, round(sum(line.quantity), 2) as sum_qty, round(sum(line.price), 2) as sum_base_price, round(sum(line.revenue), 2) as sum_disc_price,
    round(sum(line.revenue * (1 + line.tax)), 2) as sum_charge, round(avg(line.quantity), 4) as avg_qty, round(avg(line.price), 4) as avg_price, round(avg(line.discount), 4) as avg_disc, line_count as count_order
    order by l_returnflag, l_linestatus;""",
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 4) as avg_disc, count(*) as count_order
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by all order by l_returnflag, l_linestatus""",
)
add(
    "q3_shipping",
    """where customer.segment = 'BUILDING' and orders.date < '1998-03-15'::datetime and line.shipped > '1998-03-15'::datetime
    select orders.id as l_orderkey, round(revenue, 2) as revenue_, orders.date as o_orderdate order by revenue_ desc, o_orderdate limit 10;""",
    """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue_, o_orderdate from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15' and l_shipdate > timestamp '1998-03-15' group by all order by revenue_ desc, o_orderdate limit 10""",
)
add(
    "q5_local_volume",
    """where region.name = 'ASIA' and nation.id = supplier.nation and orders.date between '1996-01-01'::datetime and '1998-12-31'::datetime
    select nation.name as n_name, round(revenue, 2) as revenue_ order by revenue_ desc;""",
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue_ from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' and s_nationkey = n_nationkey and o_orderdate between timestamp '1996-01-01' and timestamp '1998-12-31' group by n_name order by revenue_ desc""",
)
add(
    "q6_forecast",
    """where line.shipped >= '1996-01-01'::datetime and line.shipped < '1997-01-01'::datetime and line.discount between 0.05 and 0.07 and line.quantity < 24
    select round(sum(line.price * line.discount), 2) as revenue_;""",
    """select round(sum(l_extendedprice * l_discount), 2) as revenue_ from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24""",
)
add(
    "q13_distribution",
    """select count(orders.id) by customer.id as c_count, count(customer.id) as custdist;""",
    """select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey group by 1) group by 1""",
)
add(
    "q14_promo",
    """where line.shipped >= '1997-09-01'::datetime and line.shipped < '1997-10-01'::datetime
    select round(100 * sum(line.revenue ? part.type like 'PROMO%') / sum(line.revenue), 4) as promo_revenue;""",
    """select round(100 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) end) / sum(l_extendedprice * (1 - l_discount)), 4) as promo_revenue
    from lineitem join part on l_partkey = p_partkey where l_shipdate >= timestamp '1997-09-01' and l_shipdate < timestamp '1997-10-01'""",
)
add(
    "q18_large",
    """where sum(line.quantity) by orders.id > 200 select customer.name as c_name, orders.id as o_orderkey, orders.total as o_totalprice, sum(line.quantity) as qty order by o_totalprice desc, o_orderkey;""",
    """select c_name, o_orderkey, o_totalprice, sum(l_quantity) as qty from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
    where o_orderkey in (select l_orderkey from lineitem group by 1 having sum(l_quantity) > 200) group by all order by o_totalprice desc, o_orderkey""",
)
add("select_grain", "select orders.status, orders.priority;", "select distinct o_orderstatus as orders__status, o_orderpriority as orders__priority from orders")
add("hidden_output", "select orders.status as status, --orders.priority;", "select o_orderstatus as status from (select distinct o_orderstatus, o_orderpriority from orders)")
add("count_key_distinct", "select nation.name as n_name, count(customer.id) as customers, count(orders.id) as n_orders;", "select n_name, count(distinct c_custkey) as customers, count(distinct o_orderkey) as n_orders from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1")
add("chasm", "select customer.segment as segment, round(sum(orders.total), 2) as order_total, round(sum(line.quantity), 2) as qty, round(sum(customer.acctbal), 2) as balance;",
    """select * from (select c_mktsegment as segment, round(sum(o_totalprice), 2) as order_total from customer left join orders on o_custkey = c_custkey group by 1)
    join (select c_mktsegment as segment, round(sum(l_quantity), 2) as qty from customer left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by 1) using (segment)
    join (select c_mktsegment as segment, round(sum(c_acctbal), 2) as balance from customer group by 1) using (segment)""")
add("aggregate_by", "select orders.id as oid, customer.id as cid, round(sum(orders.total) by customer.id, 2) as customer_total, round(orders.total / sum(orders.total) by *, 12) as share;",
    "select o_orderkey as oid, c_custkey as cid, round(sum(o_totalprice) over (partition by c_custkey), 2) as customer_total, round(o_totalprice / sum(o_totalprice) over (), 12) as share from customer left join orders on c_custkey = o_custkey")
add("nested_aggregate", "select customer.segment as segment, round(avg(sum(orders.total) by customer.id), 4) as avg_total;",
    "select c_mktsegment as segment, round(avg(t), 4) as avg_total from (select c_custkey, c_mktsegment, sum(o_totalprice) as t from customer left join orders on o_custkey = c_custkey group by 1, 2) group by 1")
add("aggregates_all", "select event.type as kind, count(event.id) as n, count_distinct(event.user) as users, round(sum(event.value), 4) as s, round(avg(event.value), 6) as m, min(event.value) as lo, max(event.value) as hi, round(stddev(event.value), 6) as sd, round(variance(event.value), 4) as var_, bool_or(event.value > 99) as some, bool_and(event.value >= 0) as every, count(distinct event.user, event.type) as pairs;",
    "select event_type as kind, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as s, round(avg(value), 6) as m, min(value) as lo, max(value) as hi, round(stddev(value), 6) as sd, round(variance(value), 4) as var_, bool_or(value > 99) as some, bool_and(value >= 0) as every, count(distinct (user_id, event_type)) as pairs from events group by 1")
add("array_agg_any", "select region.name as r_name, array_sort(array_agg(nation.name)) as nations, any(region.id) as rid;", "select r_name, list_sort(list(n_name)) as nations, any_value(r_regionkey) as rid from region join nation on n_regionkey = r_regionkey group by 1")
add("filtered_aggregate", "select orders.status as status, count(orders.id ? orders.total > 200000) as big, round(sum(orders.total ? orders.priority in ('1-URGENT', '2-HIGH')), 2) as urgent;",
    "select o_orderstatus as status, count(*) filter (o_totalprice > 200000) as big, round(sum(o_totalprice) filter (o_orderpriority in ('1-URGENT', '2-HIGH')), 2) as urgent from orders group by 1")
add("filtered_measure", "select orders.status as status, round(sum(orders.total ? line.quantity > 45), 2) as s, count(orders.id ? line.quantity > 45) as n;",
    "select o_orderstatus as status, round(sum(o_totalprice) filter (o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)), 2) as s, count(*) filter (o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)) as n from orders group by 1")
add("filtered_output", "select (orders.id ? orders.status = 'P') as oid;", "select o_orderkey as oid from orders where o_orderstatus = 'P'")
add("rollup_filtered", "select orders.status as status, round(sum(orders.total ? line.quantity > 45), 2) as s by rollup (orders.status);",
    "select o_orderstatus as status, round(sum(o_totalprice) filter (o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)), 2) as s from orders group by rollup (o_orderstatus)")
add("rowset_beside", "with big as where orders.total > 350000 select orders.id, orders.total as total; select orders.id as oid, big.total as t;", "select o_orderkey as oid, case when o_totalprice > 350000 then o_totalprice end as t from orders")
add("list_keys", "const size_ <- unnest([1, 2, 3, 50]); where size_ < 10 select size_ as s, size_ * size_ as sq;", "select s, s * s as sq from (values (1), (2), (3)) t(s)")
add("merge_derived", "auto parity <- event.user % 25; merge parity into ~nation.id; select nation.name as n_name, count(event.id) as n;", "select n_name, count(event_id) as n from nation left join events on user_id % 25 = n_nationkey group by 1")
add("where_aggregate", "where count(orders.id) by customer.id > 12 select customer.id as cid, customer.name as c_name;", "select c_custkey as cid, c_name from customer where c_custkey in (select o_custkey from orders group by 1 having count(*) > 12)")
add("staged_where", "where orders.status = 'F' then where count(orders.id) by customer.id >= 6 select customer.id as cid, count(orders.id) as n;",
    "select o_custkey as cid, count(*) as n from orders where o_orderstatus = 'F' and o_custkey in (select o_custkey from orders where o_orderstatus = 'F' group by 1 having count(*) >= 6) group by 1")
add("where_population", "where orders.status = 'F' and count(orders.id) by customer.id >= 14 select customer.id as cid, count(orders.id) as n;",
    "select o_custkey as cid, count(*) as n from orders where o_orderstatus = 'F' and o_custkey in (select o_custkey from orders group by 1 having count(*) >= 14) group by 1")
add("having", "select customer.segment as segment, count(orders.id) as n having n > 100 and avg(orders.total) > 1000;", "select c_mktsegment as segment, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1 having count(o_orderkey) > 100 and avg(o_totalprice) > 1000")
add("in_set", "where customer.id in (customer.id ? customer.acctbal > 9000) select customer.id as cid;", "select c_custkey as cid from customer where c_acctbal > 9000")
add("not_in_set", "where part.id not in (select part.id where line.quantity > 48) select part.id as pid;", "select p_partkey as pid from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 48)")
add("in_select", "where nation.id in (select nation.id where region.name = 'EUROPE') select nation.name as n_name;", "select n_name from nation where n_regionkey in (select r_regionkey from region where r_name = 'EUROPE')")
add("in_list", "where orders.status in ('F', 'P') and orders.priority not in ('5-LOW', '1-URGENT') select orders.status as status, order_count as n;", "select o_orderstatus as status, count(*) as n from orders where o_orderstatus in ('F', 'P') and o_orderpriority not in ('5-LOW', '1-URGENT') group by 1")
add("composite_in", "where (orders.status, orders.priority) in (select orders.status, orders.priority where orders.total > 400000) select orders.status as status, orders.priority as priority, order_count as n;",
    "select o_orderstatus as status, o_orderpriority as priority, count(*) as n from orders where (o_orderstatus, o_orderpriority) in (select o_orderstatus, o_orderpriority from orders where o_totalprice > 400000) group by 1, 2")
add("membership_flag", "select nation.name as n_name, nation.id in (select nation.id where region.name = 'ASIA') as asian;", "select n_name, n_regionkey in (select r_regionkey from region where r_name = 'ASIA') as asian from nation")
add("scalar_subquery", "where orders.total > (select max(orders.total) * 0.95 as t) select orders.id as oid;", "select o_orderkey as oid from orders where o_totalprice > (select max(o_totalprice) * 0.95 from orders)")
add("array_subselect", "select region.name as r_name, subselect(nation.name where nation.name != 'CHINA' order by nation.name desc limit 2) as last2;",
    "select r_name, (select list(n_name order by n_name desc) from (select n_name from nation where n_regionkey = r_regionkey and n_name <> 'CHINA' order by n_name desc limit 2)) as last2 from region")
add("rollup", "select region.name as r_name, nation.name as n_name, count(customer.id) as n, grouping(nation.name) as g by rollup (region.name, nation.name);",
    "select r_name, n_name, count(distinct c_custkey) as n, grouping(n_name)::bigint as g from region join nation on r_regionkey = n_regionkey left join customer on c_nationkey = n_nationkey group by rollup (r_name, n_name)")
add("cube", "select orders.status as status, orders.priority as priority, count(orders.id) as n, grouping_id(orders.status, orders.priority) as g by cube (orders.status, orders.priority);",
    "select o_orderstatus as status, o_orderpriority as priority, count(*) as n, grouping_id(o_orderstatus, o_orderpriority)::bigint as g from orders group by cube (o_orderstatus, o_orderpriority)")
add("grouping_sets", "select orders.status as status, orders.priority as priority, round(sum(orders.total), 2) as s by grouping sets ((orders.status), (orders.priority), ());",
    "select o_orderstatus as status, o_orderpriority as priority, round(sum(o_totalprice), 2) as s from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
add("window_rank", "select nation.name as n_name, count(customer.id) as n, rank(nation.name) over (order by count(customer.id) desc) as r, dense_rank(nation.name) over (order by count(customer.id) desc) as d, row_number(nation.name) over (partition by region.name order by nation.name asc) as k;",
    "select n_name, n, rank() over (order by n desc) as r, dense_rank() over (order by n desc) as d, row_number() over (partition by r_name order by n_name) as k from (select n_name, r_name, count(distinct c_custkey) as n from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2)")
add("window_lag", "select event.id as eid, lag(event.value, 1) over (partition by event.user order by event.id asc) as before, lead(event.value, 2) over (partition by event.user order by event.id asc) as later, round(sum(event.value) over (partition by event.user order by event.id asc), 4) as running;",
    "select event_id as eid, lag(value) over (partition by user_id order by event_id) as before, lead(value, 2) over (partition by user_id order by event_id) as later, round(sum(value) over (partition by user_id order by event_id), 4) as running from events")
add("top_k_by", "select customer.segment as segment, customer.id as cid, customer.acctbal as bal, --rank(customer.id) over (partition by customer.segment order by customer.acctbal desc) as r having r <= 3;",
    "select c_mktsegment as segment, c_custkey as cid, c_acctbal as bal from customer qualify rank() over (partition by c_mktsegment order by c_acctbal desc) <= 3")
add("order_limit", "select orders.id as oid, orders.total as total order by orders.total desc nulls last, orders.id limit 20;", "select o_orderkey as oid, o_totalprice as total from orders order by 2 desc, 1 limit 20")
add("union", "from union((where orders.status = 'F' select orders.priority as p, orders.total as t), (where orders.status = 'O' select orders.priority as q, orders.total as u)) -> (pr, tt) select pr, count(tt) as n, round(sum(tt), 2) as s;",
    "select pr, count(tt) as n, round(sum(tt), 2) as s from (select distinct o_orderpriority as pr, o_totalprice as tt from orders where o_orderstatus = 'F' union all select distinct o_orderpriority, o_totalprice from orders where o_orderstatus = 'O') group by 1")
add("except", "except((select customer.id as a), (select customer.id as b where orders.total > 100000)) -> (cid);", "select c_custkey as cid from customer except select o_custkey from orders where o_totalprice > 100000")
add("intersect", "intersect((select orders.priority as a where orders.status = 'P'), (select orders.priority as b where orders.total > 300000)) -> (priority);", "select o_orderpriority as priority from orders where o_orderstatus = 'P' intersect select o_orderpriority from orders where o_totalprice > 300000")
add("multiselect", "select orders.date::date as d, count(orders.id) as placed merge select line.shipped::date as s, count(line.row) as shipped_ align day: d, s derive coalesce(placed, 0) + coalesce(shipped_, 0) -> both_;",
    "select day, placed, shipped_, coalesce(placed, 0) + coalesce(shipped_, 0) as both_ from (select o_orderdate::date as day, count(*) as placed from orders group by 1) full join (select l_shipdate::date as day, count(*) as shipped_ from lineitem group by 1) using (day)")
add("rowset", "with big as where orders.total > 300000 select orders.id as oid, customer.id as cid, orders.total as total; select big.cid as cid, count(big.oid) as n, round(sum(big.total), 2) as s;",
    "select o_custkey as cid, count(*) as n, round(sum(o_totalprice), 2) as s from orders where o_totalprice > 300000 group by 1")
add("rowset_join", "with big as select customer.id as cid, count(orders.id) as n having n > 14; subset join big.cid = customer.id select customer.name as c_name, big.n as n;",
    "select c_name, n from customer left join (select o_custkey, count(*) as n from orders group by 1 having count(*) > 14) on c_custkey = o_custkey")
add("union_join", "union join event.user = customer.id select customer.id as k, count(event.id) as n_events, count(orders.id) as n_orders;",
    "select coalesce(a.k, b.k) as k, coalesce(n_events, 0) as n_events, coalesce(n_orders, 0) as n_orders from (select user_id as k, count(*) as n_events from events group by 1) a full join (select c_custkey as k, count(o_orderkey) as n_orders from customer left join orders on c_custkey = o_custkey group by 1) b on a.k = b.k")
add("merge_partial", "merge event.user into ~customer.id; select customer.segment as segment, count(event.id) as n;", "select c_mktsegment as segment, count(event_id) as n from customer left join events on c_custkey = user_id group by 1")
add("partial_key", "select doc.lang as lang, count(doc.id) as docs, count(doc.quality) as labelled, sum(doc.quality) as good;", "select lang, count(*) as docs, count(quality) as labelled, sum(quality)::bigint as good from documents left join labels using (doc_id) group by 1")
add("unnest", "select vec.id as vid, unnest(array_distinct([vec.label, 1, 2])) as x;", "select vec_id as vid, unnest(list_distinct([label, 1, 2])) as x from embeddings")
add("arrays", "select vec.id as vid, len(vec.embedding) as n, round(vec.embedding[1]::float, 5) as first_, generate_array(1, 4) as g, array_sum([1, 2, vec.label]) as s, array_to_string(['a', vec.label::string], '-') as t, array_sort([3, vec.label, 2], desc) as z;",
    "select vec_id as vid, len(embedding) as n, round(embedding[1]::double, 5) as first_, generate_series(1, 4) as g, 3 + label as s, 'a-' || label as t, list_reverse_sort([3, label, 2]) as z from embeddings")
add("lambdas", "def double(x) -> x * 2; def big(x) -> x > 2; select vec.id as vid, array_transform([1, 2, vec.label], @double) as d, array_filter([1, 2, 3, vec.label], @big) as f;",
    "select vec_id as vid, [2, 4, 2 * label] as d, list_filter([1, 2, 3, label], lambda x: x > 2) as f from embeddings")
add("maps_structs", "where region.id >= 0 select region.id as rid, map_keys({'a': region.id, 'b': 2}) as k, map_values({'a': region.id, 'b': 2}) as v, {'a': region.id}['a'] as got, struct(region.id -> x, region.name -> y).y as nm;",
    "select r_regionkey as rid, ['a', 'b'] as k, [r_regionkey, 2] as v, r_regionkey as got, r_name as nm from region")
add("strings", "select nation.id as nid, upper(nation.name) as u, lower(nation.name) as l, len(nation.name) as n, substring(nation.name, 2, 3) as sub, strpos(nation.name, 'A') as at, replace(nation.name, 'A', '_') as rep, trim('  ' || nation.name || ' ') as tr, split(nation.name, 'A') as sp, concat(nation.name, null, '!') as cc, concat_ws('-', nation.name, 'x') as ws, contains(nation.name, 'an') as c, nation.name like '%IA' as lk, nation.name ilike 'c%' as il, hash(nation.name, md5) as h, hex(nation.name) as hx;",
    "select n_nationkey as nid, upper(n_name) as u, lower(n_name) as l, length(n_name) as n, substring(n_name, 2, 3) as sub, strpos(n_name, 'A') as at, replace(n_name, 'A', '_') as rep, trim('  ' || n_name || ' ') as tr, string_split(n_name, 'A') as sp, concat(n_name, null, '!') as cc, concat_ws('-', n_name, 'x') as ws, contains(lower(n_name), 'an') as c, n_name like '%IA' as lk, n_name ilike 'c%' as il, md5(n_name) as h, hex(n_name) as hx from nation")
add("regex", "select part.id as pid, regexp_extract(part.name, '([a-z]+) ?([a-z]*)', 1) as e, regexp_replace(part.name, '[aeiou]', '#') as r, regexp_contains(part.type, 'PROMO|STEEL') as c;",
    "select p_partkey as pid, regexp_extract(p_name, '([a-z]+) ?([a-z]*)', 1) as e, regexp_replace(p_name, '[aeiou]', '#') as r, regexp_matches(p_type, 'PROMO|STEEL') as c from part")
add("maths", "select part.id as pid, part.size + 1 as a, part.size - 2 as b, part.size * 3 as m, round(part.size / 7, 6) as d, part.size % 4 as r, part.size ** 2 as p, round(sqrt(part.size), 6) as q, round(log(part.size), 6) as lg, round(log(part.size, 2), 6) as l2, floor(part.price) as fl, ceil(part.price) as ce, abs(0 - part.size) as ab, greatest(part.size, 25) as g, least(part.size, 25) as l;",
    "select p_partkey as pid, p_size + 1 as a, p_size - 2 as b, p_size * 3 as m, round(p_size / 7, 6) as d, p_size % 4 as r, p_size ** 2 as p, round(sqrt(p_size), 6) as q, round(log10(p_size), 6) as lg, round(log2(p_size), 6) as l2, floor(p_retailprice)::bigint as fl, ceil(p_retailprice)::bigint as ce, abs(-p_size) as ab, greatest(p_size, 25) as g, least(p_size, 25) as l from part")
add("conditions", "select orders.id as oid, case when orders.total > 300000 then 'big' when orders.total > 100000 then 'mid' else 'small' end as band, case orders.status when 'F' then 1 when 'O' then 2 end as code, coalesce(nullif(orders.status, 'F'), 'none') as st, (orders.total / 1000)::int as k, bool(nullif(orders.status = 'F', false)) as done, orders.status is null as nn;",
    "select o_orderkey as oid, case when o_totalprice > 300000 then 'big' when o_totalprice > 100000 then 'mid' else 'small' end as band, case o_orderstatus when 'F' then 1 when 'O' then 2 end as code, coalesce(nullif(o_orderstatus, 'F'), 'none') as st, (o_totalprice / 1000)::bigint as k, o_orderstatus = 'F' as done, o_orderstatus is null as nn from orders")
add("dates", "select orders.id as oid, year(orders.date) as y, month(orders.date) as m, day(orders.date) as d, quarter(orders.date) as q, week(orders.date) as w, day_of_week(orders.date) as dw, month_name(orders.date) as mn, day_name(orders.date) as dn, date_trunc(orders.date, month) as tr, date_part(orders.date, year) as yp, date_add(orders.date::date, day, 40) as da, date_sub(orders.date::date, month, 1) as ds, date_diff(orders.date, '2000-01-01'::datetime, month) as dm, date_diff(orders.date, '2000-01-01'::datetime, week) as dk, format_time(orders.date, '%Y/%m') as f, hour(orders.date) as h;",
    "select o_orderkey as oid, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, quarter(o_orderdate) as q, week(o_orderdate) as w, dayofweek(o_orderdate) + 1 as dw, monthname(o_orderdate) as mn, dayname(o_orderdate) as dn, date_trunc('month', o_orderdate)::date as tr, year(o_orderdate) as yp, o_orderdate::date + 40 as da, (o_orderdate::date - interval 1 month)::date as ds, date_diff('month', o_orderdate, timestamp '2000-01-01') as dm, date_diff('week', o_orderdate, timestamp '2000-01-01') as dk, strftime(o_orderdate, '%Y/%m') as f, hour(o_orderdate) as h from orders")
add("macro_aggregate", "def share(x, k: int = 100) -> round(k * sum(x) / sum(x) by *, 6); select orders.status as status, @share(orders.total) as pct;", "select o_orderstatus as status, round(100 * sum(o_totalprice) / sum(sum(o_totalprice)) over (), 6) as pct from orders group by 1")
add("parameter", "parameter least_total int default 400000; where orders.total > least_total select orders.id as oid;", "select o_orderkey as oid from orders where o_totalprice > 400000")
add("date_spine", "select date_spine('2024-01-01'::date, '2024-01-10'::date) as day;", "select unnest(generate_series(date '2024-01-01', date '2024-01-10', interval 1 day))::date as day")
add("geo", "select part.id as pid, round(geo_distance(geo_point(part.size, part.price), geo_point(0, 0)), 6) as d, geo_x(geo_point(part.size, 1)) as x;", "select p_partkey as pid, round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) as d, p_size::double as x from part")
add("grain_function", "select count_distinct(grain(orders.status, orders.priority)) as n;", "select count(distinct (o_orderstatus, o_orderpriority)) as n from orders")
add("group_by_function", "select orders.id as oid, group(customer.segment) by customer.id as segment;", "select o_orderkey as oid, c_mktsegment as segment from orders left join customer on c_custkey = o_custkey")
add("from_clause", "from orders select customer.id as cid, count(orders.id) as n;", "select o_custkey as cid, count(*) as n from orders group by 1")
add("recursion", "key node.id int; property node.id.parent int; datasource nodes (id: node.id, p: ?node.parent) grain (node.id) query '''select id, case when id % 10 = 0 then null else id - 1 end as p from range(1, 60)'''; auto top <- recurse_edge(node.id, node.parent); select node.id as n, top as t;",
    "with recursive w as (select id, case when id % 10 = 0 then null else id - 1 end as p from range(1, 60) r(id)), t as (select id, id as anc from w union all select t.id, w.p from t join w on w.id = t.anc where w.p is not null) select id as n, min(anc) as t from t group by 1")
add("summary_rollup", "datasource by_day (status: orders.status, priority: orders.priority, n: order_count) grain (orders.status, orders.priority) query '''select 'F' as status, '5-LOW' as priority, 7L as n union all select 'F', '1-URGENT', 5L union all select 'O', '5-LOW', 2L'''; select orders.status as status, order_count as n;",
    "select 'F' as status, 12 as n union all select 'O', 2")
add("partition_union", "key channel string; key sale int; property sale.amount float; partial datasource web (c: channel, s: sale, a: amount) grain (sale, channel) complete where channel = 'W' query '''select 'W' as c, id as s, id * 1.5 as a from range(10)'''; partial datasource store (c: channel, s: sale, a: amount) grain (sale, channel) complete where channel = 'S' query '''select 'S' as c, id as s, id * 2.0 as a from range(5)'''; select channel as c, sum(amount) as s;",
    "select 'W' as c, 67.5 as s union all select 'S', 20.0")
add("properties_block", "key box int; properties box (w int[1..9], h float); datasource boxes (id: box, w: w, h: h) grain (box) query '''select id, id % 9 + 1 as w, id * 0.5 as h from range(20)'''; select w as w, sum(h) as s;",
    "select (id % 9 + 1)::bigint as w, sum(id * 0.5)::double as s from range(20) r(id) group by 1")
add("self_import", "self import as twin; merge supplier.nation into ~twin.nation.id; where supplier.id is not null select supplier.id as sid, twin.nation.name as n_name;",
    "select s_suppkey as sid, n_name from supplier left join nation on s_nationkey = n_nationkey")
add("top_x", "import std.ranking as ranking; where @ranking.is_top_x_by(customer.id, customer.acctbal, 5) select customer.id as cid;", "select c_custkey as cid from customer qualify rank() over (order by c_acctbal desc) <= 5")
add("top_x_rest", "import std.report as report; import std.display as display; select region.name as r_name, count(customer.id) as n, @report.top_x_by_metric(region.name, count(customer.id), 2, 'rest') as label, @display.calc_percent(count(customer.id), count(customer.id) by *, 3)::float as share;",
    "select r_name, n, case when rank() over (order by n desc) <= 2 then r_name else 'rest' end as label, round(n / sum(n) over (), 3)::double as share from (select r_name, count(distinct c_custkey) as n from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1)")
add("made_up_rows", "mock datasources customer, orders; select count(customer.id) as customers, count(orders.id) as n_orders, max(orders.id) as last_;", "select 100 as customers, 100 as n_orders, 100 as last_")

# More of the shapes that the tables allow.
add("q4_priority", "where orders.date >= '1997-01-01'::datetime and orders.date < '1997-07-01'::datetime and orders.id in (select orders.id where line.quantity > 45) select orders.priority as o_orderpriority, order_count as n order by o_orderpriority;",
    "select o_orderpriority, count(*) as n from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1997-07-01' and o_orderkey in (select l_orderkey from lineitem where l_quantity > 45) group by 1 order by 1")
add("q7_volume", "self import as twin; merge supplier.nation into ~twin.nation.id; where line.shipped between '1996-01-01'::datetime and '1997-12-31'::datetime and (twin.nation.name = 'FRANCE' and nation.name = 'GERMANY' or twin.nation.name = 'GERMANY' and nation.name = 'FRANCE') select twin.nation.name as supp_nation, nation.name as cust_nation, year(line.shipped) as l_year, round(revenue, 2) as revenue_ order by supp_nation, cust_nation, l_year;",
    """select n1.n_name as supp_nation, n2.n_name as cust_nation, year(l_shipdate) as l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue_ from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey where l_shipdate between timestamp '1996-01-01' and timestamp '1997-12-31'
    and (n1.n_name = 'FRANCE' and n2.n_name = 'GERMANY' or n1.n_name = 'GERMANY' and n2.n_name = 'FRANCE') group by all order by 1, 2, 3""")
add("q8_share", "self import as twin; merge supplier.nation into ~twin.nation.id; where region.name = 'EUROPE' and orders.date between '1995-01-01'::datetime and '1998-12-31'::datetime and line.revenue is not null select year(orders.date) as o_year, round(sum(line.revenue ? twin.nation.name = 'FRANCE') / sum(line.revenue), 6) as mkt_share order by o_year;",
    """select year(o_orderdate) as o_year, round(sum(case when n1.n_name = 'FRANCE' then l_extendedprice * (1 - l_discount) end) / sum(l_extendedprice * (1 - l_discount)), 6) as mkt_share from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation n2 on c_nationkey = n2.n_nationkey join region on n2.n_regionkey = r_regionkey left join supplier on l_suppkey = s_suppkey left join nation n1 on s_nationkey = n1.n_nationkey where r_name = 'EUROPE' and o_orderdate between timestamp '1995-01-01' and timestamp '1998-12-31' group by 1 order by 1""")
add("q9_profit", "where part.name like '%e%' and line.price is not null select supplier.nation as s_nation, year(orders.date) as o_year, round(sum(line.revenue - line.quantity), 2) as profit order by s_nation, o_year desc;",
    "select s_nationkey as s_nation, year(o_orderdate) as o_year, round(sum(l_extendedprice * (1 - l_discount) - l_quantity), 2) as profit from lineitem join part on l_partkey = p_partkey left join orders on l_orderkey = o_orderkey left join supplier on l_suppkey = s_suppkey where p_name like '%e%' group by 1, 2 order by 1 nulls last, 2 desc")
add("q10_returned", "where line.flag = 'R' and orders.date >= '1997-01-01'::datetime select customer.id as c_custkey, customer.name as c_name, customer.acctbal as c_acctbal, nation.name as n_name, round(revenue, 2) as revenue_ order by revenue_ desc, c_custkey limit 20;",
    """select c_custkey, c_name, c_acctbal, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue_ from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
    where l_returnflag = 'R' and o_orderdate >= timestamp '1997-01-01' group by all order by revenue_ desc, c_custkey limit 20""")
add("q12_modes", "where line.shipped >= '1997-01-01'::datetime and line.shipped < '1998-01-01'::datetime select line.status as l_linestatus, count(line.row ? orders.priority in ('1-URGENT', '2-HIGH')) as high, count(line.row ? orders.priority not in ('1-URGENT', '2-HIGH')) as low order by l_linestatus;",
    "select l_linestatus, count(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 end) as high, count(case when o_orderpriority not in ('1-URGENT', '2-HIGH') or o_orderpriority is null then 1 end) as low from lineitem left join orders on l_orderkey = o_orderkey where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' group by 1 order by 1")
add("q15_top_supplier", "with sold as where line.shipped >= '1997-01-01'::datetime and line.shipped < '1997-04-01'::datetime select supplier.id as sid, supplier.name as s_name, round(revenue, 2) as total; where sold.total = (select max(sold.total) as t) select sold.sid as s_suppkey, sold.s_name as s_name, sold.total as total_revenue;",
    """with r as (select s_suppkey, s_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as total_revenue from lineitem join supplier on l_suppkey = s_suppkey where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1997-04-01' group by 1, 2)
    select * from r where total_revenue = (select max(total_revenue) from r)""")
add("q16_suppliers", "where part.size in (1, 5, 9, 14, 23, 36, 45, 49) and part.type not like 'PROMO%' and line.quantity is not null select part.brand as p_brand, part.type as p_type, part.size as p_size, count(supplier.id) as n order by n desc, p_brand, p_type, p_size;",
    "select p_brand, p_type, p_size, count(distinct l_suppkey) as n from lineitem join part on l_partkey = p_partkey where p_size in (1, 5, 9, 14, 23, 36, 45, 49) and p_type not like 'PROMO%' group by 1, 2, 3 order by n desc, 1, 2, 3")
add("q17_small", "where part.size < 10 and line.quantity < 0.6 * avg(line.quantity) by part.id select round(sum(line.price) / 7.0, 4) as avg_yearly;",
    "select round(sum(l_extendedprice) / 7.0, 4) as avg_yearly from lineitem l join part on l_partkey = p_partkey where p_size < 10 and l_quantity < 0.6 * (select avg(l_quantity) from lineitem m where m.l_partkey = l.l_partkey)")
add("q19_disjunction", "where part.size between 1 and 5 and line.quantity between 1 and 11 or part.size between 1 and 10 and line.quantity between 10 and 20 or part.size between 1 and 15 and line.quantity between 20 and 30 select round(revenue, 2) as revenue_;",
    "select round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue_ from lineitem join part on l_partkey = p_partkey where p_size between 1 and 5 and l_quantity between 1 and 11 or p_size between 1 and 10 and l_quantity between 10 and 20 or p_size between 1 and 15 and l_quantity between 20 and 30")
add("q22_no_orders", "where customer.acctbal > (select avg(customer.acctbal ? customer.acctbal > 0) as a) and customer.id not in (where orders.id is not null select customer.id) select nation.name as n_name, count(customer.id) as n, round(sum(customer.acctbal), 2) as total;",
    "select n_name, count(*) as n, round(sum(c_acctbal), 2) as total from customer left join nation on c_nationkey = n_nationkey where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0) and c_custkey not in (select o_custkey from orders) group by 1")

# Joins that keep every row.
LINKS = """key person int; property person.who string; key note int; property note.score int;
datasource people (id: person, n: who) grain (person) query '''select c_custkey as id, c_name as n from customer''';
datasource notes (id: note, p: {marks}person, s: score) grain (note) query '''select o_orderkey as id, case when o_orderkey % 7 = 0 then null else o_custkey end as p, o_orderkey % 100 as s from orders''';"""
_NOTES = "(select o_orderkey as id, case when o_orderkey % 7 = 0 then null else o_custkey end as p, o_orderkey % 100 as s from orders)"


def over_tables(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over a model whose datasources are SQL over the tables, as views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            read_parquet(spark, f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return engine(spark, sf_dir).query(text)

    return run


def add_made(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


add_made("nullable_fk_rows", over_tables(LINKS.format(marks="?") + "select note as i, who as w;"), f"select id as i, c_name as w from {_NOTES} left join customer on p = c_custkey")
add_made("nullable_fk_sum", over_tables(LINKS.format(marks="?") + "select who as w, sum(score) as s;"), f"select c_name as w, sum(s)::bigint as s from {_NOTES} left join customer on p = c_custkey group by 1")
add_made("partial_nullable_fk", over_tables(LINKS.format(marks="~?") + "select who as w, sum(score) as s, count(note) as n;"), f"select c_name as w, sum(s)::bigint as s, count(id) as n from {_NOTES} full join customer on p = c_custkey group by 1")
add_made("null_safe_keys", over_tables("key g int; key a int; key b int; datasource xs (a: a, g: ?g) grain (a) query '''select o_orderkey as a, nullif(o_orderkey % 5, 0) as g from orders'''; property g.m int; datasource gs (g: ?g, m: m) grain (g) query '''select * from values (1, 10), (2, 20), (null, 99) as t(g, m)'''; select g as g, m as m, count(a) as n;"),
    "select g, m, count(a) as n from (select o_orderkey as a, nullif(o_orderkey % 5, 0) as g from orders) x full join (values (1, 10), (2, 20), (null, 99)) t(g2, m) on g is not distinct from g2 group by 1, 2")
add("lookup_adds_no_rows", "where customer.segment = 'BUILDING' select orders.id as oid;", "select o_orderkey as oid from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
add("join_by_expression", "subset join event.user + 1 = customer.id select customer.segment as segment, count(event.id) as n;", "select c_mktsegment as segment, count(event_id) as n from customer left join events on user_id + 1 = c_custkey group by 1")
add("join_chain", "union join event.user = customer.id = supplier.id select customer.id as k, count(event.id) as n_events, count(orders.id) as n_orders, any(supplier.name) as s_name;",
    """select coalesce(a.k, b.k, s_suppkey) as k, coalesce(n_events, 0) as n_events, coalesce(n_orders, 0) as n_orders, s_name from (select user_id as k, count(*) as n_events from events group by 1) a
    full join (select c_custkey as k, count(o_orderkey) as n_orders from customer left join orders on c_custkey = o_custkey group by 1) b on a.k = b.k full join supplier on coalesce(a.k, b.k) = s_suppkey""")
add("presence_probe", "where event.user is null subset join event.user = customer.id select customer.segment as segment, count(customer.id) as n;", "select c_mktsegment as segment, count(*) as n from customer where c_custkey not in (select user_id from events) group by 1")
add("presence_flag", "union join event.user = customer.id select customer.id as k, event.user is not null as seen;", "select coalesce(c_custkey, u) as k, u is not null as seen from customer full join (select distinct user_id as u from events) on c_custkey = u")
add_made("merge_wildcard", over_tables("key w.id int; property w.id.label string; datasource ws (i: w.id, l: w.label) grain (w.id) query '''select n_nationkey as i, n_name as l from nation'''; key v.id int; property v.id.size int; datasource vs (i: v.id, s: v.size) grain (v.id) query '''select n_nationkey as i, n_nationkey * 2 as s from nation'''; merge v.* into w.*; select w.id as i, w.label as l, v.size as s;"),
    "select n_nationkey as i, n_name as l, n_nationkey * 2 as s from nation")

# Summaries and slices.
SUMMARY = """key day date; key cust int; key sale int; property sale.amount float; metric total <- sum(amount); metric buyers <- count(cust); metric biggest <- max(amount);
datasource sales (s: sale, d: day, c: cust, a: amount) grain (sale) query '''select o_orderkey as s, cast(o_orderdate as date) as d, o_custkey as c, o_totalprice as a from orders''';
datasource by_day (d: day, t: total, b: buyers, m: biggest) grain (day) query '''select cast(o_orderdate as date) as d, sum(o_totalprice) as t, count(distinct o_custkey) as b, max(o_totalprice) as m from orders group by 1''';"""
add_made("summary_grand_total", over_tables(SUMMARY + "select round(total, 2) as t, biggest as m;"), "select round(sum(o_totalprice), 2) as t, max(o_totalprice) as m from orders")
add_made("summary_distinct_count", over_tables(SUMMARY + "select buyers as b;"), "select count(distinct o_custkey) as b from orders")
add_made("summary_exact_grain", over_tables(SUMMARY + "select day as d, buyers as b;"), "select o_orderdate::date as d, count(distinct o_custkey) as b from orders group by 1")
add_made("summary_by_property", over_tables(SUMMARY + "property day.quarter int; datasource days (d: day, q: quarter) grain (day) query '''select distinct cast(o_orderdate as date) as d, quarter(o_orderdate) as q from orders'''; select quarter as q, round(total, 2) as t;"), "select quarter(o_orderdate) as q, round(sum(o_totalprice), 2) as t from orders group by 1")
add_made("partial_summary", over_tables(SUMMARY.split("datasource by_day")[0] + "partial datasource late (d: day, t: total) grain (day) complete where day >= '1998-01-01'::date query '''select cast(o_orderdate as date) as d, sum(o_totalprice) as t from orders where o_orderdate >= '1998-01-01' group by 1'''; select round(total, 2) as t;"), "select round(sum(o_totalprice), 2) as t from orders")
add_made("datasource_where", over_tables("key o int; property o.st string; datasource os (k: o, s: st) grain (o) where st = 'F' query '''select o_orderkey as k, o_orderstatus as s from orders'''; select o as k, st as s;"), "select o_orderkey as k, o_orderstatus as s from orders where o_orderstatus = 'F'")
add_made("complete_where", over_tables("key o int; key st string; partial datasource done (k: o, s: st) grain (o, st) complete where st = 'F' query '''select o_orderkey as k, o_orderstatus as s from orders where o_orderstatus = 'F' '''; partial datasource open_ (k: o, s: st) grain (o, st) complete where st in ('O', 'P') query '''select o_orderkey as k, o_orderstatus as s from orders where o_orderstatus <> 'F' '''; where st = 'P' select o as k;"), "select o_orderkey as k from orders where o_orderstatus = 'P'")
add_made("long_chain", over_tables("".join(f"key k{i} int; " for i in range(13)) + "".join(f"datasource d{i} (a: k{i}, b: k{i + 1}) grain (k{i}) query '''select n_nationkey + {i} as a, n_nationkey + {i + 1} as b from nation'''; " for i in range(12)) + "select k0 as first_, k12 as last_;"), "select n_nationkey as first_, n_nationkey + 12 as last_ from nation")

# Groupings.
add("rollup_outside", "select nation.id as nid, nation.name as n_name, count(customer.id) as n by rollup (nation.id);", "select nid, n_name, n from (select n_nationkey as nid, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey group by rollup (n_nationkey)) left join nation on nid = n_nationkey")
add("rollup_pinned", "select orders.status as st, orders.priority as pr, order_count as n, count(orders.id) by orders.status as of_status by rollup (orders.status, orders.priority);",
    "select st, pr, n, of_status from (select o_orderstatus as st, o_orderpriority as pr, count(*) as n from orders group by rollup (1, 2)) left join (select o_orderstatus as s2, count(*) as of_status from orders group by 1) on st = s2")
add("grain_match", "select orders.id as oid, sum(orders.total) as s, count(orders.id) as n, max(orders.date) as d;", "select o_orderkey as oid, o_totalprice as s, 1 as n, o_orderdate as d from orders")

# Windows.
add("window_aggregates", "select event.id as eid, count(event.value) over (partition by event.user order by event.id asc) as n, avg(event.id) over (partition by event.user order by event.id asc) as m, max(event.value) over (partition by event.type order by event.id asc) as hi, min(event.value) over (partition by event.type order by event.id asc) as lo;",
    "select event_id as eid, count(value) over u as n, avg(event_id) over u as m, max(value) over t as hi, min(value) over t as lo from events window u as (partition by user_id order by event_id), t as (partition by event_type order by event_id)")
add("window_unordered", "select customer.id as cid, round(sum(customer.acctbal) over (partition by customer.segment), 2) as s, count_distinct(customer.segment) over (partition by nation.id) as k;",
    "select c_custkey as cid, round(sum(c_acctbal) over (partition by c_mktsegment), 2) as s, k from customer join (select c_nationkey as n, count(distinct c_mktsegment) as k from customer group by 1) on n = c_nationkey")
add("window_legacy", "select customer.id as cid, rank customer.id over customer.segment order by customer.acctbal desc as r;", "select c_custkey as cid, rank() over (partition by c_mktsegment order by c_acctbal desc) as r from customer")
add("window_of_window", "select nation.name as n_name, rank(nation.name) over (order by count(customer.id) desc) as r, max(rank(nation.name) over (order by count(customer.id) desc)) over (order by nation.name asc) as worst;",
    "select n_name, r, max(r) over (order by n_name) as worst from (select n_name, rank() over (order by count(c_custkey) desc) as r from nation left join customer on c_nationkey = n_nationkey group by 1)")
add("order_hidden", "select orders.id as oid order by orders.total desc nulls first, orders.id nulls auto limit 15;", "select oid from (select o_orderkey as oid, o_totalprice as t from orders order by t desc, oid limit 15)")
add("limit_in_rowset", "with top as select orders.id as oid, orders.total as total order by orders.total desc, orders.id limit 25; select count(top.oid) as n, round(sum(top.total), 2) as s;", "select count(*) as n, round(sum(o_totalprice), 2) as s from (select * from orders order by o_totalprice desc, o_orderkey limit 25)")

# Composition.
add("typed_signature", "from union((where orders.status = 'F' select orders.id as a, orders.total as b), (where orders.status = 'P' select orders.id as c, orders.total as d)) -> (k key int, v float?) select count(k) as n, max(v) as v;",
    "select count(*) as n, max(v) as v from (select o_orderkey, o_totalprice as v from orders where o_orderstatus in ('F', 'P'))")
add("stacked_keys", "auto anyone <- union(customer.id, supplier.id); select anyone as a;", "select c_custkey as a from customer union select s_suppkey from supplier")
add("rowset_arrow", "rowset big <- where orders.total > 350000 select orders.id as oid, customer.id as cid; select big.cid as cid, count(big.oid) as n;", "select o_custkey as cid, count(*) as n from orders where o_totalprice > 350000 group by 1")
add("rowset_island", "with few as where nation.id < 5 select nation.id as nid; select nation.id as nid;", "select n_nationkey as nid from nation")
add("constants", "const least <- 5; const rate <- 0.5::float; select part.id as pid, part.size * rate as half, part.size > least as big, rate as r;", "select p_partkey as pid, p_size * 0.5::double as half, p_size > 5 as big, 0.5::double as r from part")
add("source_less", "select 1 + 2 as three, 'x' as letter;", "select 3 as three, 'x' as letter")
add("partial_output", "select ~orders.id as oid, customer.id as cid;", "select o_orderkey as oid, c_custkey as cid from customer left join orders on c_custkey = o_custkey")
add("in_array", "where part.size in [1, 2, 3] select part.id as pid, part.size in [1, part.size] as yes;", "select p_partkey as pid, true as yes from part where p_size in (1, 2, 3)")
add("is_tests", "select orders.id as oid, orders.status is null as a, (orders.total > 100000) is true as b, (orders.total > 100000) is not true as c, nullif(orders.status, 'F') is 'O' as d;", "select o_orderkey as oid, o_orderstatus is null as a, o_totalprice > 100000 as b, not o_totalprice > 100000 as c, nullif(o_orderstatus, 'F') is not distinct from 'O' as d from orders")
add("column_expressions", "key up.id int; property up.id.name string; property up.id.len_ int; datasource ups (n_nationkey + 100: up.id, lower(n_name): up.name, raw('''length(n_name) * 2'''): up.len_) grain (up.id) address nation; select up.id as i, up.name as n, up.len_ as l;", "select n_nationkey + 100 as i, lower(n_name) as n, length(n_name) * 2 as l from nation")
add("table_function", "def table top_names(k) -> select nation.name where nation.id < k order by nation.name desc limit 2; select region.name as r_name, @top_names(20) as names;",
    "select r_name, (select list(n_name order by n_name desc) from (select n_name from nation where n_regionkey = r_regionkey and n_nationkey < 20 order by n_name desc limit 2)) as names from region")
add("custom_type", "type cents int; key c.id int; property c.id.paid cents; datasource cs (o_orderkey: c.id, o_custkey * 100: c.paid) grain (c.id) address orders; select c.id as i, c.paid::cents as p;", "select o_orderkey as i, o_custkey * 100 as p from orders")

# Functions.
add("trims", "select nation.id as nid, ltrim('  ' || nation.name || ' ') as l, rtrim('  ' || nation.name || ' ') as r, strpos(nation.name, 'ZZ') as none;", "select n_nationkey as nid, ltrim('  ' || n_name || ' ') as l, rtrim('  ' || n_name || ' ') as r, strpos(n_name, 'ZZ') as none from nation")
add("times", "select event.id as eid, second(event.ts) as s, minute(event.ts) as m, hour(event.ts) as h, date(event.ts) as d, datetime(event.ts) as dt, timestamp(event.ts)::string as tz, format_time(event.ts, '%F %T') as f, parse_time(format_time(event.ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as back, date_diff(event.ts, date_add(event.ts, hour, 5), hour) as five;",
    "select event_id as eid, second(ts) as s, minute(ts) as m, hour(ts) as h, ts::date as d, ts as dt, regexp_replace(ts::varchar, '(\\.[0-9]*?)0+$', '\\\\1') as tz, strftime(ts, '%Y-%m-%d %H:%M:%S') as f, date_trunc('second', ts) as back, 5 as five from events")
add("now", "select current_date() >= '2020-01-01'::date as d, current_datetime() > '2020-01-01'::datetime as t, current_timestamp() is not null as z, random() < 1 as r;", "select true as d, true as t, true as z, true as r")
add("unix_times", "select region.id as rid, date_diff(unix_to_timestamp(0)::datetime, unix_to_timestamp(region.id * 86400)::datetime, day) as days;", "select r_regionkey as rid, r_regionkey::bigint as days from region")
add("geo_shapes", "select part.id as pid, geo_y(geo_from_text('POINT(' || part.size::string || ' 3)')) as y, geo_x(geo_centroid(geo_from_text('POLYGON((0 0, 4 0, 4 2, 0 2, 0 0))'))) as cx, round(geo_x(geo_transform(geo_point(part.size, 10), 4326, 3857)), 3) as east, round(geo_x(geo_transform(geo_transform(geo_point(part.size, 10), 4326, 3857), 3857, 4326)), 9) as back;",
    "select p_partkey as pid, 3::double as y, 2::double as cx, round(radians(10) * 6378137, 3) as east, p_size::double as back from part")
add("grain_of_values", "select part.id as pid, grain(part.brand, part.size) = grain(part.brand, part.size) as same, grain('a', 'b') = grain('ab', '') as mixed, grain(null, 'a') = grain('a', null) as nulls;", "select p_partkey as pid, true as same, false as mixed, false as nulls from part")
add("array_edges", "select region.id as rid, [1, 2][0] as none, [1, 2][-1] as last_, [1, 2][5] as beyond, {'a': 1}['b'] as no_key;", "select r_regionkey as rid, null::int as none, 2 as last_, null::int as beyond, null::int as no_key from region")


# Sources, sinks and effects: written to the shared folder, read back.
def files(name: str, statements: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    """Statements, with {at} a new folder, then a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, at = engine(spark, sf_dir), scratch(spark, name)
        e.run(statements.replace("{at}", at))
        return e.query(query.replace("{at}", at))

    return run


_BACK = "key b.id int; property b.id.name string; property b.id.bal float; datasource back (cid: b.id, nm: b.name, bal: b.bal) grain (b.id) file `{at}.KIND`; select b.id as cid, b.name as nm, b.bal as bal;"
_CUSTOMERS = "select c_custkey as cid, c_name as nm, c_acctbal as bal from customer"
for _kind in ("csv", "tsv", "json", "parquet", "orc"):
    add_made(f"copy_{_kind}", files(f"copy_{_kind}", f"copy into {_kind} '{{at}}.{_kind}' from select customer.id as cid, customer.name as nm, customer.acctbal as bal;", _BACK.replace("KIND", _kind)), _CUSTOMERS)
add_made("many_files", files("many", "copy into parquet '{at}/a.parquet' from where customer.id < 100 select customer.id as cid, customer.name as nm, customer.acctbal as bal; copy into parquet '{at}/b.parquet' from where customer.id >= 100 select customer.id as cid, customer.name as nm, customer.acctbal as bal;", _BACK.replace("`{at}.KIND`", "[`{at}/a.parquet`, `{at}/b.parquet`]")), _CUSTOMERS)
add_made("file_glob", files("glob", "copy into parquet '{at}/a.parquet' from where customer.id < 100 select customer.id as cid, customer.name as nm, customer.acctbal as bal; copy into parquet '{at}/b.parquet' from where customer.id >= 100 select customer.id as cid, customer.name as nm, customer.acctbal as bal;", _BACK.replace("{at}.KIND", "{at}/*.parquet")), _CUSTOMERS)


def partitioned_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by slices, one of which is written again: the others stay, the one is replaced."""
    e, table = engine(spark, sf_dir), f"slices_{uuid.uuid4().hex}"
    e.run(f"persist a into {table} by orders.status from select orders.id, orders.total, orders.status;")
    e.run(f"append b into {table} by orders.status from where orders.status = 'F' select orders.id, orders.total * 2 as orders.total, orders.status;")
    return spark.table(table).select(F.col("orders__id").alias("oid"), F.col("orders__total").alias("total"), F.col("orders__status").alias("st"))


def persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary written as a table, appended to nothing, then used by a query that asks for it."""
    e, table = engine(spark, sf_dir), f"by_status_{uuid.uuid4().hex}"
    e.run(f"persist kept into {table} from select orders.status, order_count;")
    out = e.query("select orders.status as st, order_count as n;")
    if table not in out._jdf.queryExecution().analyzed().toString():
        raise RuntimeError("the written summary wasn't used")
    return out


def created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A datasource's table created with its data, unpublished until then."""
    e, table = engine(spark, sf_dir), f"made_{uuid.uuid4().hex}"
    e.run(f"datasource made (rid: region.id, nm: region.name) grain (region.id) address {table} state unpublished; create datasource made with data; publish datasource made;")
    e.written.add(table)
    return e.query("from made select region.id as rid, region.name as nm;")


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an incremental key past what the table has, twice."""
    e, table = engine(spark, sf_dir), f"feed_{uuid.uuid4().hex}"
    e.run("datasource feed (event_id: event.id, value: event.value) grain (event.id) incremental by event.id address events;")
    first, again = e.refresh("feed", table), e.refresh("feed", table)
    return spark.table(table).select(F.count("*").alias("n"), F.lit(again).cast("long").alias("again"), (F.lit(first) == F.count("*")).alias("whole"))


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written datasource that lags behind its root is rebuilt, once."""
    e, table = engine(spark, sf_dir), f"daily_{uuid.uuid4().hex}"
    e.run(f"root datasource raw (event_id: event.id, ts: event.ts, value: event.value) grain (event.id) address events; datasource daily (event_id: event.id, ts: event.ts) grain (event.id) freshness by event.ts within 0 seconds address {table};")
    first = refresh(e)
    e.written.add(table)
    second = refresh(e)
    return spark.table(table).select(F.count("*").alias("n"), F.lit(first["daily"]).alias("why"), F.lit(len(second)).cast("long").alias("again"))


def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return e.watermark("events", "event.id").select(F.col("high").alias("high"), F.col("checksum").isNotNull().alias("hashed"))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query("validate datasources nation, orders;").where("check in ('grain', 'null')").select("datasource", "check", "subject", "failures")


def program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that writes the table nation as an Arrow stream, run in a task."""
    text = f"import sys, pyarrow as pa, pyarrow.parquet as pq\nt = pq.read_table({sf_dir + '/nation.parquet'!r}, columns=['n_nationkey', 'n_name'])\nw = pa.ipc.new_stream(sys.stdout.buffer, t.schema)\nw.write_table(t)\nw.close()\n"
    with tempfile.NamedTemporaryFile("w", suffix=".py", delete=False) as f:  # the driver's own: Spark brings it to the executors
        f.write(text)
    e = engine(spark, sf_dir)
    e.run(f"key pn.id int; property pn.id.name string; datasource prog (n_nationkey: pn.id, n_name: pn.name) grain (pn.id) file `{f.name}`;")
    return e.query("select pn.id as nid, pn.name as nm;")


def sql_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = engine(spark, sf_dir), scratch(spark, "sql") + ".sql"
    spark.createDataFrame([(f"select r_regionkey, upper(r_name) as nm from parquet.`{sf_dir}/region.parquet`",)], "value string").coalesce(1).write.text(at)
    e.run(f"key sr.id int; property sr.id.name string; datasource regions_ (r_regionkey: sr.id, nm: sr.name) grain (sr.id) file `{at}`;")
    return e.query("select sr.id as rid, sr.name as nm;")


def frame_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register_frame("my_frame", read_parquet(spark, f"{sf_dir}/nation.parquet").selectExpr("n_nationkey as k", "n_name as v"))
    e.run("key fk.id int; property fk.id.v string; datasource fr (k: fk.id, v: fk.v) grain (fk.id) address my_frame;")
    return e.query("select fk.id as k, fk.v as v;")


add_made("persist_partitioned", partitioned_append, "select o_orderkey as oid, case when o_orderstatus = 'F' then o_totalprice * 2 else o_totalprice end as total, o_orderstatus as st from orders")
add_made("persist_used", persisted, "select o_orderstatus as st, count(*) as n from orders group by 1")
add_made("create_publish", created, "select r_regionkey as rid, r_name as nm from region")
add_made("incremental", appended, "select count(*) as n, 0 as again, true as whole from events")
add_made("refresh", refreshed, "select count(*) as n, 'missing' as why, 0 as again from events")
add_made("watermark", watermarks, "select max(event_id) as high, true as hashed from events")
add_made("validate", checked, "select * from (values ('nation', 'grain', 'nation.id', 0), ('nation', 'null', 'nation.id', 0), ('nation', 'null', 'nation.name', 0), ('nation', 'null', 'region.id', 0), ('orders', 'grain', 'orders.id', 0), ('orders', 'null', 'customer.id', 0), ('orders', 'null', 'orders.date', 0), ('orders', 'null', 'orders.id', 0), ('orders', 'null', 'orders.priority', 0), ('orders', 'null', 'orders.status', 0), ('orders', 'null', 'orders.total', 0)) t(datasource, \"check\", subject, failures)")
add_made("script_scan", program, "select n_nationkey as nid, n_name as nm from nation")
add_made("sql_file_scan", sql_file, "select r_regionkey as rid, upper(r_name) as nm from region")
add_made("frame_scan", frame_source, "select n_nationkey as k, n_name as v from nation")
add_made("raw_sql", lambda spark, sf_dir: engine(spark, sf_dir).query(f"raw_sql('select count(*) as n from parquet.`{sf_dir}/orders.parquet`');"), "select count(*) as n from orders")
add_made("show", lambda spark, sf_dir: engine(spark, sf_dir).query("show datasources;").select("name"), "select unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'labels', 'embeddings']) as name")


def summed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each column of a result: rows, nulls, least and greatest (the approximate number of values isn't compared)."""
    return engine(spark, sf_dir).summary("select orders.id as oid, orders.status as st, orders.priority as pr limit 3;").select("column", "rows", "non_null", "nulls", F.col("min").alias("lo"), F.col("max").alias("hi"))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a datasource: as many rows as were asked for, each of them one of its rows."""
    few = engine(spark, sf_dir).sample("orders", 100)
    return few.select(F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"), "orders__id").groupBy("n").agg(F.count_distinct("orders__id").alias("different"))


def by_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned datasource of which one slice was lost: only that one is written again."""
    e, table = engine(spark, sf_dir), f"sliced_{uuid.uuid4().hex}"
    e.run(f"datasource sliced (oid: orders.id, total: orders.total, st: orders.status) grain (orders.id) partition by orders.status address {table};")
    first = refresh_slices(e, "sliced")
    spark.sql(f"alter table {table} drop partition (st = 'F')")
    again = refresh_slices(e, "sliced")
    return spark.table(table).groupBy("st").agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("total")).withColumns({"slices": F.lit(len(first)).cast("long"), "again": F.lit(",".join(f"{k[0]}:{w}" for k, w in sorted(again.items())))})


def keys_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written datasource that is as new as its root, but lacks some of its keys."""
    e, table = engine(spark, sf_dir), f"hashed_{uuid.uuid4().hex}"
    e.run(f"root datasource raw (event_id: event.id, ts: event.ts) grain (event.id) address events; datasource copied (event_id: event.id, ts: event.ts) grain (event.id) freshness by event.ts address {table};")
    newest = read_parquet(spark, f"{sf_dir}/events.parquet").select("event_id", "ts")
    newest.where(F.col("event_id") % 10 != 3).union(newest.orderBy(F.col("ts").desc()).limit(1)).distinct().write.saveAsTable(table)
    e.written.add(table)
    return spark.createDataFrame([(n, why) for n, why in stale(e).items()], "name string, why string")


def drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written datasource whose table has another type and lacks a column."""
    e, table = engine(spark, sf_dir), f"drift_{uuid.uuid4().hex}"
    e.run(f"root datasource raw (r_regionkey: region.id, r_name: region.name) grain (region.id) address region; datasource old (rid: region.id, nm: region.name) grain (region.id) freshness by region.id address {table};")
    read_parquet(spark, f"{sf_dir}/region.parquet").selectExpr("cast(r_regionkey as string) as rid").write.saveAsTable(table)
    e.written.add(table)
    return spark.createDataFrame([(n, why) for n, why in stale(e).items()], "name string, why string")


def in_an_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written in an environment is read there, then put in use."""
    table, name = f"env_{uuid.uuid4().hex}", f"e{uuid.uuid4().hex[:8]}"
    text = f"datasource kept (rid: region.id, nm: region.name) grain (region.id) address {table} state unpublished; create datasource kept with data; publish datasource kept;"
    e = Engine(spark, tables=sf_dir, environment=name)
    e.run(MODEL + text)
    inside = e.query("from kept select region.id as rid, region.name as nm;").collect()
    e.environment.promote()
    return spark.table(table).select("rid", "nm", F.lit(len(inside)).cast("long").alias("before"))


def by_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement made by Python calls."""
    return engine(spark, sf_dir).execute(b.select(b.c("customer.segment").as_("segment"), b.count("customer.id").as_("n"), b.total("customer.acctbal").cast("int").as_("bal"), where=b.c("nation.id") < 20, order=[b.c("segment")]))


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).scopes("where orders.status = 'F' select customer.segment as segment, count(orders.id) as n, sum(orders.total) by * as every;").select("name", "kind", F.concat_ws(",", "grain").alias("grain"), F.concat_ws(",", "datasources").alias("sources"))


def joins_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.run("merge event.user into ~customer.id;")
    return e.query("validate joins;").groupBy("subset", "whole").agg(F.sum("failures").alias("failures"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to one result, compared row by row."""
    e = engine(spark, sf_dir)
    return differences(e.query("select customer.segment as s, sum(customer.acctbal) as b;"), read_parquet(spark, f"{sf_dir}/customer.parquet").groupBy("c_mktsegment").agg(F.sum("c_acctbal")), 1e-8).agg(F.count("*").alias("n"))


def hooked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datasources that rows came from, as a callback heard of them."""
    seen: list = []
    e = Engine(spark, tables=sf_dir, hooks=Hooks(sources=[seen.append]))
    e.run(MODEL)
    e.query("select nation.name as n, count(orders.id) as c;")
    return spark.createDataFrame([(n,) for n in sorted({n for names in seen for n in names})], "source string")


def windows_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed aggregates of the streaming module, over the whole table as a batch."""
    events = read_parquet(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return windowed(events, "ts", "1 day", "1 hour", ["event_type"], n=F.count("*"), total=F.round(F.sum("value"), 2)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table taken in as a stream of files, twice from one state: each file once."""
    table, state = f"taken_{uuid.uuid4().hex}", scratch(spark, "state")
    at = scratch(spark, "arrivals")
    read_parquet(spark, f"{sf_dir}/events.parquet").write.parquet(at)
    schema = spark.read.parquet(at).schema.simpleString()[7:-1].replace(":", " ")
    for _ in range(2):
        ingest(spark, at, table, state, schema)
    return spark.table(table).groupBy("event_type").agg(F.count("*").alias("n"))


def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model made from the tables alone answers a question over two of them."""
    tables = {t: read_parquet(spark, f"{sf_dir}/{t}.parquet") for t in ("nation", "customer")}
    tables["customer"] = tables["customer"].withColumnRenamed("c_nationkey", "n_nationkey")
    e = Engine(spark)
    for n, df in tables.items():
        e.register_frame(n, df)
    e.run(model_of(spark, tables))
    return e.query("select nation.n_name as n_name, count(customer.c_custkey) as n;")


add_made("summary", summed_up, "select 'oid' as \"column\", count(*) as rows, count(*) as non_null, 0 as nulls, min(o_orderkey)::varchar as lo, max(o_orderkey)::varchar as hi from orders union all select 'st', count(*), count(o_orderstatus), 0, min(o_orderstatus), max(o_orderstatus) from orders union all select 'pr', count(*), count(o_orderpriority), 0, min(o_orderpriority), max(o_orderpriority) from orders")
add_made("sample", sampled, "select 100 as n, 100 as different")
add_made("partition_refresh", by_slices, "select o_orderstatus as st, count(*) as n, round(sum(o_totalprice), 2) as total, (select count(distinct o_orderstatus) from orders) as slices, 'F:missing' as again from orders group by 1")
add_made("key_hashes", keys_compared, "select 'copied' as name, 'keys differ from raw' as why")
add_made("schema_drift", drifted, "select 'old' as name, 'schema: rid is string, not bigint, lacks nm' as why")
add_made("environment", in_an_environment, "select r_regionkey as rid, r_name as nm, (select count(*) from region) as before from region")
add_made("by_calls", by_calls, "select c_mktsegment as segment, count(*) as n, round_even(sum(c_acctbal), 0)::bigint as bal from customer where c_nationkey < 20 group by 1")
add_made("scopes", scopes, "select * from (values ('segment', 'dimension', 'customer.id', 'customer,orders'), ('n', 'aggregate', 'customer.id', 'customer,orders'), ('every', 'aggregate', '', 'orders')) t(name, kind, grain, sources)")
add_made("validate_joins", joins_validated, "select 'events' as subset, 'customer' as whole, count(distinct user_id) as failures from events where user_id not in (select c_custkey from customer) union all select 'orders', 'customer', count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer)")
add_made("compare_rows", compared, "select 0 as n")
add_made("hooks", hooked, "select unnest(['customer', 'nation', 'orders']) as source")
add_made("time_windows", windows_of_time, "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
add_made("file_stream", streamed, "select event_type, count(*) as n from events group by 1")
add_made("model_of_tables", inferred, "select n_name, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey group by 1")
add("chart_rows", "chart layer bar (x_axis <- customer.segment as segment, y_axis <- count(customer.id) as n);", "select c_mktsegment as segment, count(*) as n from customer group by 1")
add("made_up_patterns", "key pn.k int; property pn.k.code string['[A-Z]{3}-\\\\d{2}']; datasource pt (k: pn.k, c: pn.code) grain (pn.k) address pt; mock datasources pt; select count(pn.k) as n, bool_and(regexp_contains(pn.code, '^[A-Z]{3}-[0-9]{2}$')) as all_;", "select 100 as n, true as all_")
